"""Traceroute and ping measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ip
from . import runs
from .grams import candidates, gram_index
from .geo import coord_resolve
from .search import enrich_text


def hop_enrich(hops: DataFrame, *prefixes: DataFrame, city_coords: DataFrame | None = None) -> DataFrame:
    """Hops (ip text) with ASN from the hop, else from the prefix; bad places lose their coordinates.

    Give a prefix table for each family that is to be looked up; its address type tells which one it is.
    """
    d = enrich_text(hops, prefixes, F.when(~ip.is_private_ip("ip"), F.col("ip")), ("origin_asn", "cc", "city", "province"))
    d = coord_resolve(d, city_coords)
    bad = (F.col("lat").isNull() | F.col("lon").isNull() | ((F.col("lat") == 0) & (F.col("lon") == 0))
           | F.concat_ws(" ", "city", "province", "cc").rlike("(?i)anycast"))
    none = F.lit(None).cast("double")
    return (d.withColumn("asn", F.coalesce("asn", "origin_asn", F.lit(0))).withColumn("lat", F.when(bad, none).otherwise(F.col("lat")))
            .withColumn("lon", F.when(bad, none).otherwise(F.col("lon"))).drop("origin_asn"))


def hop_gaps(hops: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add a row with ``gap`` silent hops wherever the hop number jumps, also before the first.

    The previous number comes from a chunked scan, so one huge trace is no single task.
    """
    keys = list(keys)
    c = runs.with_chunks(hops, [F.col(o) for o in order], keys)
    c = runs.drop_chunks(runs.scan(c, "_prev", F.col(order[0]), "last", [F.col(o) for o in order], keys, inclusive=False))
    gap = F.col(order[0]) - F.coalesce("_prev", F.lit(0)) - 1
    rows = F.concat(F.when(gap > 0, F.array(gap)).otherwise(F.array().cast("array<bigint>")), F.array(F.lit(None).cast("bigint")))
    return c.withColumn("gap", F.explode(rows)).drop("_prev")


def trace_places(hops: DataFrame, keys: Sequence[str], order: str = "idx") -> DataFrame:
    """A trace as its sequence of places -> (keys, pos, place).

    Unknown places are skipped; a run of one place keeps its last hop; a place seen in an
    earlier run is skipped unless it is the last hop. A trace has at most 255 hops (TTL),
    so windows per trace stay small.
    """
    keys = list(keys)
    name = F.trim(F.coalesce(F.nullif("city", F.lit("")), F.nullif("cc", F.lit("")), F.lit("Unknown")))
    coords = F.concat_ws(",", F.format_string("%.3f", "lat"), F.format_string("%.3f", "lon"))
    key = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), coords).otherwise(F.lower(F.regexp_replace(name, "[市县区]$", "")))
    d = hops.withColumn("_place", name).where((F.col("_place") != "Unknown") | (F.coalesce("asn", F.lit(0)) != 0)).withColumn("_k", key)
    w = Window.partitionBy(*keys).orderBy(order)
    per_key = Window.partitionBy(*keys, "_k").orderBy(order)
    d = d.withColumn("_first", F.row_number().over(per_key) == 1).withColumn(
        "_last", F.max(order).over(Window.partitionBy(*keys)) == F.col(order))
    kept = d.where("_first OR _last")
    # the final hop replaces the entry before it when both are the same place
    same = (F.lead("_k").over(w) == F.col("_k")) & F.lead("_last").over(w)
    kept = kept.withColumn("_drop", F.coalesce(same, F.lit(False))).where("NOT _drop")
    return kept.withColumn("pos", F.row_number().over(w).cast("bigint")).select(*keys, "pos", F.col("_place").alias("place"), F.col("_k").alias("place_key"))


def ping_rounds(rounds: DataFrame) -> DataFrame:
    """Running statistics per probe; the same plan runs in batch and as a stream (update mode).

    The mean is rounded half up from whole microseconds, so it depends neither on the order of
    partial sums nor on how a tie is held in binary.
    """
    micros = F.round(F.col("avg_rtt") * 1_000_000).cast("bigint")
    g = rounds.groupBy("probe").agg(
        F.min("min_rtt").alias("_min"), F.max("max_rtt").alias("_max"), F.sum(micros * F.col("rcv")).alias("_s"),
        F.sum("rcv").alias("rcv"), F.sum("total").alias("total"))
    mean = F.expr("(2 * _s + 1000 * rcv) div (2000 * rcv)") / 1000
    return g.select("probe", F.round("_min", 3).alias("min_rtt"), F.round("_max", 3).alias("max_rtt"),
                    F.when(F.col("rcv") > 0, mean).otherwise(0.0).alias("avg_rtt"), "rcv", "total", (F.col("total") - F.col("rcv")).alias("drop"),
                    F.round(F.when(F.col("total") > 0, (1 - F.col("rcv") / F.col("total")) * 100).otherwise(0.0), 3).alias("loss"))


def probe_locations(probes: DataFrame, networks: int | None = None) -> DataFrame:
    """Probes per (country, city): count, mean coordinates, all or the largest ``networks``."""
    p = probes.where("coalesce(city, '') <> '' AND coalesce(country, '') <> ''").withColumn("_c", F.upper("country")).withColumn("_t", F.lower(F.trim("city")))
    base = p.groupBy("_c", "_t").agg(F.min("city").alias("city"), F.count("*").alias("n"), F.avg(F.coalesce("latitude", F.lit(0.0))).alias("lat"),
                                     F.avg(F.coalesce("longitude", F.lit(0.0))).alias("lon"))
    net = p.where("coalesce(network, '') <> ''").groupBy("_c", "_t", "network").agg(F.count("*").alias("k"), F.max("asn").alias("asn"))
    top = runs.ranked(net, "_rn", [F.desc("k"), F.col("network")], ["_c", "_t"], networks).groupBy("_c", "_t").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_rn", "network", "asn", "k"))),
        lambda x: F.struct(x["network"].alias("name"), x["asn"].alias("asn"), x["k"].alias("n"))).alias("networks"))
    return base.join(top, ["_c", "_t"], "left").select(F.col("_c").alias("cc"), "city", "n", "lat", "lon", "networks")


def network_rows(locations: DataFrame) -> DataFrame:
    """(cc, city, name, asn, n): the networks of each place."""
    return locations.select("cc", "city", F.explode("networks").alias("w")).select("cc", "city", "w.*")


def suggest_index(locations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trigram postings of the places and of the networks for ``probe_suggest``."""
    nets = network_rows(locations).select("name", "asn").distinct()
    return (gram_index(locations.select("cc", "city"), ["cc", "city"], [F.concat_ws(" ", "city", "cc")]),
            gram_index(nets, ["name"], [F.col("name"), F.concat(F.lit("as"), F.col("asn").cast("string"))]))


def probe_suggest(locations: DataFrame, term: str, cities_n: int, countries_n: int, networks_n: int,
                  index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Substring search rolled up to the largest cities, countries and networks, as many as asked for."""
    q = term.strip().lower()
    nets = network_rows(locations)
    if index is not None:
        locations, nets = candidates(locations, index[0], ["cc", "city"], q), candidates(nets, index[1], ["name"], q)
    hit = F.lower(F.concat_ws(" ", "city", "cc")).contains(q)
    none = F.lit(None).cast("bigint")
    cities = locations.where(hit).orderBy(F.desc("n"), "cc", "city").limit(cities_n).select(F.lit("city").alias("kind"), F.col("city").alias("label"), none.alias("asn"), "n")
    countries = locations.where(F.lower("cc").contains(q)).groupBy("cc").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "cc").limit(countries_n).select(
        F.lit("country").alias("kind"), F.col("cc").alias("label"), none.alias("asn"), "n")
    nets = nets.where(F.lower("name").contains(q) | F.concat(F.lit("as"), F.col("asn").cast("string")).contains(q))
    nets = nets.groupBy("asn").agg(F.min("name").alias("label"), F.sum("n").alias("n")).orderBy(F.desc("n"), "asn").limit(networks_n).select(
        F.lit("network").alias("kind"), "label", "asn", "n")
    return cities.unionByName(countries).unionByName(nets)
