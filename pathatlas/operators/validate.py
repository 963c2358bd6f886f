"""Origin validation against ROAs and route objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ip
from .joins import covering_join

NOT_FOUND, VALID, INVALID_ASN, INVALID_LEN = 0, 1, 2, 3

# Registries whose route objects count as authoritative.
AUTHORITATIVE = ("RIPE", "APNIC", "ARIN", "AFRINIC", "LACNIC", "DN42")


def rpki_classify(route_origin: DataFrame, vrp: DataFrame, keep_not_found: bool = False, **join_args) -> DataFrame:
    """(pid, origin) -> code over all covering VRPs; VRPs of length 0 are ignored.

    VRPs are reduced to the longest maxlen per (prefix, asn) first; the verdict is a pair
    of booleans, so the aggregation is partial on the map side.
    """
    v = vrp.where(F.col("vlen") > 0).groupBy("family", "ip_start", "vlen", "asn").agg(F.max("maxlen").alias("maxlen"))
    hits = covering_join(route_origin.select("pid", "origin", "ip_start", "plen"), v, right_plen="vlen",
                         right_cols={"asn": "_asn", "maxlen": "_maxlen"}, **join_args)
    same = F.col("_asn") == F.col("origin")
    out = hits.groupBy("pid", "origin").agg(
        F.bool_or(same & (F.col("plen") <= F.col("_maxlen"))).alias("_ok"), F.bool_or(same).alias("_same"))
    out = out.select("pid", "origin", F.when(F.col("_ok"), VALID).when(F.col("_same"), INVALID_LEN)
                     .otherwise(INVALID_ASN).alias("rpki"))
    if keep_not_found:
        out = route_origin.select("pid", "origin").distinct().join(out, ["pid", "origin"], "left").withColumn(
            "rpki", F.coalesce("rpki", F.lit(NOT_FOUND)))
    return out


def irr_classify(route_origin: DataFrame, irr_route: DataFrame, keep_not_found: bool = False) -> DataFrame:
    """Exact range match: 1 an object has this origin, 2 objects exist but none has it."""
    objs = irr_route.select("ip_start", "ip_end", F.col("origin").alias("_o")).distinct()
    hits = route_origin.select("pid", "origin", "ip_start", "ip_end").distinct().join(objs, ["ip_start", "ip_end"])
    out = hits.groupBy("pid", "origin").agg(F.when(F.bool_or(F.col("_o") == F.col("origin")), 1).otherwise(2).alias("irr"))
    if keep_not_found:
        out = route_origin.select("pid", "origin").distinct().join(out, ["pid", "origin"], "left").withColumn(
            "irr", F.coalesce("irr", F.lit(0)))
    return out


def irr_objects(prefix: DataFrame, irr_route: DataFrame) -> DataFrame:
    """Observed prefixes that have route objects: sorted distinct sources per (pid, origin).

    The source list is bounded by the number of registries.
    """
    j = prefix.select("pid", "prefix", "ip_start", "ip_end").join(
        irr_route.select("ip_start", "ip_end", "origin", "source"), ["ip_start", "ip_end"])
    return j.groupBy("pid", "prefix", "ip_start", "ip_end", "origin").agg(
        F.array_sort(F.collect_set("source")).alias("sources"))


def irr_best_cover(points: DataFrame, irr_route: DataFrame, point: str = "ip") -> DataFrame:
    """For each address the route objects of its narrowest covering range.

    A first pass finds the best length per address (a maximum), a second equi-join
    fetches the objects of exactly that range; candidates are never ranked in one group.
    """
    wide = ip.is_wide(points, point)
    addrs = points.select(point).where(F.col(point).isNotNull()).distinct()
    ranges = irr_route.select("ip_start", "plen").distinct()
    hits = covering_join(addrs, ranges, left_start=point, left_plen=F.lit(ip.bits_of(wide)),
                         right_cols={"ip_start": "_s", "plen": "_p"})
    best = hits.groupBy(point).agg(F.max("_p").alias("plen"))
    best = best.withColumn("ip_start", ip.network_start(point, "plen", wide))
    objs = irr_route.groupBy("ip_start", "plen", "origin").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return best.join(objs, ["ip_start", "plen"]).select(point, "ip_start", "plen", "origin", "sources")


def status_authority(source) -> Column:
    return F.upper(F.col(source) if isinstance(source, str) else source).isin(*AUTHORITATIVE)


def empty_status(spark, name: str) -> DataFrame:
    """Typed empty table for a missing optional input: every status becomes 0."""
    return spark.createDataFrame([], f"pid bigint, origin bigint, {name} int")
