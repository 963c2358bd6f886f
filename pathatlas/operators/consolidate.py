"""From per-peer RIB rows to merged paths, prefixes and their summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ip, paths
from ..session import cut_lineage
from . import runs

PART = 128  # paths in one part of a bundle

_PREFIX = ("prefix", "ip_start", "ip_end", "family", "plen")


def _ids(df: DataFrame) -> list[str]:
    """Columns that identify a prefix; an id that is already there is carried along."""
    return [*_PREFIX, *(["pid"] if "pid" in df.columns else [])]


def rib_to_paths(rib: DataFrame, feeder: tuple[str, int] | None = None) -> DataFrame:
    """Decoded RIB entries (``path`` ARRAY) -> text form with clean path, length, origin."""
    p = paths.strip_feeder("path", "collector", *feeder) if feeder else F.col("path")
    d = rib.withColumn("path", p).where(F.size("path") > 0)
    return d.select("collector", *_PREFIX, paths.path_text("path").alias("path_raw"))


def obs_dedup(rib: DataFrame) -> DataFrame:
    """One row per (collector, prefix, raw path); n_peers = entries seen.

    The rows are dealt out by prefix and path to a number of tasks that follows the input, so the merge over
    collectors finds them in place and no task's hash table grows with the input.
    """
    g = rib.repartition(runs.tasks(rib), "prefix", "path_raw").groupBy("collector", *_ids(rib), "path_raw").agg(F.count("*").alias("n_peers"))
    arr = paths.path_array("path_raw")
    return (g.withColumn("_a", arr)
            .withColumn("path_clean", paths.path_text(paths.path_clean("_a")))
            .withColumn("path_len", F.size("_a")).withColumn("origin_asn", paths.path_origin("_a")).drop("_a"))


def src_rib_filters(obs: DataFrame, family: int | None = None, first_prefixes: int | None = None) -> DataFrame:
    """Optional ingestion limits: one family, the first N prefixes of each collector."""
    if family is not None:
        obs = obs.where(F.col("family") == family)
    if first_prefixes is not None:
        w = Window.partitionBy("collector").orderBy("ip_start", "plen")
        keep = (obs.select("collector", "prefix", "ip_start", "plen").distinct()
                .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= first_prefixes)
                .select("collector", "prefix"))
        obs = obs.join(keep, ["collector", "prefix"], "left_semi")
    return obs


def pathobs_merge(obs: DataFrame) -> DataFrame:
    """Across collectors: sum the peers of each (prefix, raw path)."""
    return obs.groupBy(*_ids(obs), "path_raw").agg(
        F.sum("n_peers").alias("n_peers"), F.min("path_clean").alias("path_clean"),
        F.min("path_len").alias("path_len"), F.min("origin_asn").alias("origin_asn"))


def repr_origin(pathobs: DataFrame) -> DataFrame:
    """Origin with most peer observations; the smaller ASN wins a tie."""
    per = pathobs.where(F.col("origin_asn").isNotNull()).groupBy("prefix", "origin_asn").agg(
        F.sum("n_peers").alias("ns"))
    return per.groupBy("prefix").agg(
        F.max_by("origin_asn", F.struct(F.col("ns"), -F.col("origin_asn"))).alias("origin_asn"))


def prefix_agg(pathobs: DataFrame) -> DataFrame:
    """Per prefix: observations, distinct paths, distinct origins, representative origin.

    Two aggregations that share the (prefix, origin) pre-aggregate: no distinct expansion
    and no join, and a prefix that holds many paths is reduced before it is shuffled.
    """
    per = pathobs.groupBy(*_ids(pathobs), "origin_asn").agg(
        F.sum("n_peers").alias("ns"), F.count("*").alias("np"))
    return per.groupBy(*_ids(pathobs)).agg(
        F.max_by("origin_asn", F.when(F.col("origin_asn").isNotNull(),
                                      F.struct(F.col("ns"), -F.col("origin_asn")))).alias("origin_asn"),
        F.count("origin_asn").alias("n_origins"),
        F.sum("ns").alias("n_paths"), F.sum("np").alias("n_distinct_paths"))


def pid_assign(prefix: DataFrame, chunks: int | None = None) -> DataFrame:
    """Dense 1-based id by (ip_start, prefix) without sorting everything in one task."""
    return runs.numbered(prefix, "pid", [F.col("ip_start"), F.col("prefix")], chunks=chunks)


def pid_assign_families(tables: list[DataFrame], chunks: int | None = None) -> DataFrame:
    """One dense id range over prefix tables of both families: (pid, family, prefix, start128)."""
    rows = [t.select("family", "prefix", ip.as_u128("ip_start", ip.is_wide(t, "ip_start")).alias("start128")) for t in tables]
    return runs.numbered(reduce(DataFrame.unionByName, rows), "pid", [F.col("family"), F.col("start128"), F.col("prefix")], chunks=chunks)


def attach_pid(pathobs: DataFrame, numbered: DataFrame) -> DataFrame:
    """Path rows with the id of their prefix, in place of one they may carry."""
    return pathobs.drop("pid").join(numbered.select("prefix", "pid"), ["prefix"])


def path_rows(pathobs: DataFrame) -> DataFrame:
    """Every path of every pid in the forms that searches and counts read; a projection."""
    return _forms(pathobs)


def _forms(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(
        "pid", "family", paths.padded("path_clean").alias("path_str"), paths.path_array("path_clean").alias("path_arr"),
        F.when(F.col("path_raw") != F.col("path_clean"), paths.path_array("path_raw")).alias("path_arr_raw"), "path_len", "n_peers", *more)


def paths_topk(pathobs: DataFrame, cap: int | None = None) -> DataFrame:
    """``path_rows`` of all paths, or of the ``cap`` best observed of each pid, with the best of a pid flagged.

    Without a cap the best path is a partial aggregate that is joined back to the rows, which are written
    once for both uses. With one, the rank filter becomes a per-task group limit before the shuffle.
    """
    rows = pathobs.select("pid", "family", "path_raw", "path_clean", "path_len", "n_peers")
    if cap is None:
        rows = cut_lineage(rows)
        order = F.struct((-F.col("n_peers")).alias("o"), "path_len", "path_clean", "path_raw")
        d = rows.join(rows.groupBy("pid").agg(F.min(order).alias("_b")), ["pid"]).withColumn("is_best", F.col("path_raw") == F.col("_b.path_raw"))
    else:
        d = runs.ranked(rows, "_rn", [F.desc("n_peers"), F.col("path_len"), F.col("path_clean"), F.col("path_raw")], ["pid"], cap)
        d = d.withColumn("is_best", F.col("_rn") == 1)
    return _forms(d, "is_best")


def path_totals(top_paths: DataFrame) -> DataFrame:
    """Per pid the peers over its paths and its best path."""
    return top_paths.groupBy("pid").agg(F.sum("n_peers").alias("observed_peers"),
                                        F.max(F.when(F.col("is_best"), F.col("path_str"))).alias("best_path"))


def path_bundle(top_paths: DataFrame, size: int = PART) -> DataFrame:
    """The paths of a pid in numbered parts of ``size``, best observed first -> (pid, part, bundle)."""
    n = runs.numbered(top_paths.select("pid", "path_len", "path_str", "n_peers"), "pos", [F.desc("n_peers"), F.col("path_len"), F.col("path_str")], ["pid"])
    item = F.struct("pos", "n_peers", "path_str")
    return n.groupBy("pid", F.ceil(F.col("pos") / size).alias("part")).agg(F.transform(
        F.array_sort(F.collect_list(item)), lambda x: F.struct(x["n_peers"].alias("n_peers"), x["path_str"].alias("path_str"))).alias("bundle"))


def bundle_text(bundle) -> Column:
    """The published text form '@n@ path |@n@ path '."""
    b = F.col(bundle) if isinstance(bundle, str) else bundle
    return F.array_join(F.transform(b, lambda x: F.concat(
        F.lit("@"), x["n_peers"].cast("string"), F.lit("@"), x["path_str"])), "|")


def route_origin(pathobs: DataFrame) -> DataFrame:
    return pathobs.where(F.col("origin_asn").isNotNull()).select(
        "pid", "family", "ip_start", "ip_end", "plen", F.col("origin_asn").alias("origin")).distinct()


def moas_origins(pathobs: DataFrame, rpki: DataFrame | None = None, irr: DataFrame | None = None) -> DataFrame:
    """Prefixes with several origins: aligned arrays ordered by peers desc, then origin.

    Observations are summed per (pid, origin) first; single-origin prefixes are dropped
    before the arrays are built, so only real multi-origin groups are collected.
    """
    per = pathobs.where(F.col("origin_asn").isNotNull()).groupBy("pid", F.col("origin_asn").alias("origin")).agg(
        F.sum("n_peers").alias("ns"))
    multi = per.groupBy("pid").agg(F.count("*").alias("n")).where("n > 1").select("pid")
    per = with_status(per.join(multi, ["pid"], "left_semi"), rpki, irr)
    item = F.struct((-F.col("ns")).alias("o"), F.col("origin"), F.col("ns"), F.col("rpki"), F.col("irr"))
    lists = per.groupBy("pid").agg(F.array_sort(F.collect_list(item)).alias("m"))
    take = lambda f: F.transform("m", lambda x: x[f])
    return lists.select("pid", take("origin").alias("origin_asns"), take("ns").alias("origin_npaths"),
                        take("rpki").alias("origin_rpki"), take("irr").alias("origin_irr"))


def with_status(df: DataFrame, rpki: DataFrame | None, irr: DataFrame | None, origin: str = "origin") -> DataFrame:
    """Left-join status codes of (pid, origin); an absent table or row means 0."""
    for name, table in (("rpki", rpki), ("irr", irr)):
        if table is None:
            df = df.withColumn(name, F.lit(0).cast("int"))
        else:
            t = table.select("pid", F.col("origin").alias(origin), F.col(name))
            df = df.join(t, ["pid", origin], "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("int"))
    return df


def dfz_ref(prefix: DataFrame) -> DataFrame:
    """Per family the rounded 0.9 quantile of n_paths, at least 1."""
    return prefix.groupBy("family").agg(
        F.greatest(F.round(F.percentile("n_paths", 0.9)).cast("bigint"), F.lit(1)).alias("dfz_ref"))


def low_visibility(prefix: DataFrame, ref: DataFrame) -> DataFrame:
    """Flag prefixes seen by fewer than max(3, 20 % of the reference). Two rows are broadcast."""
    cut = F.greatest(F.lit(3.0), F.col("dfz_ref") * 0.2)
    return (prefix.join(F.broadcast(ref.select("family", "dfz_ref")), ["family"], "left")
            .withColumn("dfz_ref", F.coalesce("dfz_ref", F.lit(1)))
            .withColumn("low_cut", F.ceil(cut)).withColumn("low_vis", F.col("n_paths") < cut).drop("dfz_ref"))


def origin_counts(pathobs: DataFrame) -> DataFrame:
    """Distinct prefixes per origin and family."""
    d = pathobs.where(F.col("origin_asn").isNotNull()).select("origin_asn", "family", "pid").distinct()
    return d.groupBy("origin_asn").agg(F.count_if(F.col("family") == 4).alias("n_v4"),
                                       F.count_if(F.col("family") == 6).alias("n_v6"))


def asn_seen(top_paths: DataFrame, prefix: DataFrame) -> DataFrame:
    a = top_paths.select(F.explode(F.array_distinct("path_arr")).alias("asn"))
    return a.unionByName(prefix.select(F.col("origin_asn").alias("asn"))).where("asn IS NOT NULL").distinct()
