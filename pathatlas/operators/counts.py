"""Counts, names, directories and snapshot facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import runs

def asn_names(seen: DataFrame, handles: DataFrame, curated: DataFrame, orgs: DataFrame) -> DataFrame:
    """Names of the seen ASNs: handle, overridden by the curated name; English; org."""
    h = handles.groupBy("asn").agg(F.min("handle").alias("handle"))
    c = curated.groupBy("asn").agg(F.max("name").alias("_cur"), F.max("name_en").alias("_cur_en"))
    o = orgs.groupBy("asn").agg(F.min("org").alias("org"))
    j = seen.join(h, ["asn"], "left").join(c, ["asn"], "left").join(o, ["asn"], "left")
    return j.select("asn", F.coalesce("_cur", "handle").alias("name"),
                    F.coalesce("_cur_en", "handle").alias("name_en"), "org").where(
        F.coalesce("name", "name_en", "org").isNotNull())


def country_counts(pgeo: DataFrame) -> DataFrame:
    """Prefixes per country, located ones only."""
    return pgeo.where("cc IS NOT NULL").groupBy("cc").agg(F.count("*").alias("n_prefix")).orderBy(
        F.desc("n_prefix"), "cc")


def city_counts(pgeo: DataFrame) -> DataFrame:
    return pgeo.where("cc IS NOT NULL AND city IS NOT NULL").groupBy("cc", "city").agg(
        F.count("*").alias("n_prefix")).where("n_prefix >= 2")


def neighbor_counts(neigh: DataFrame) -> DataFrame:
    return neigh.groupBy("asn").agg(F.count("*").alias("n_neighbors"))


def top_prefixes_per_asn(byorigin: DataFrame, top: int | None = None) -> DataFrame:
    """Prefixes of each origin over both families by rank, or only its ``top`` ones."""
    d = byorigin.where("origin_asn IS NOT NULL").select("origin_asn", "prefix", "cc", "n_paths").distinct()
    return runs.ranked(d, "pos", [F.desc("n_paths"), F.col("prefix")], ["origin_asn"], top).withColumn(
        "bucket", F.pmod("origin_asn", F.lit(256)).cast("int"))


def networks_by_country(origin_counts: DataFrame, asn_cc: DataFrame) -> DataFrame:
    """ASNs with prefixes by registration country, largest first; ``pos`` is the rank."""
    d = origin_counts.join(asn_cc, F.col("asn") == F.col("origin_asn")).select(
        "cc", "asn", (F.col("n_v4") + F.col("n_v6")).alias("total"))
    return runs.numbered(d, "pos", [-F.col("total"), F.col("asn")], ["cc"])


def ixps_by_country(ixs: DataFrame) -> DataFrame:
    d = ixs.withColumn("cc", F.upper(F.trim("country"))).where(F.col("cc").rlike("^[A-Z]{2}$") & F.col("ix_id").isNotNull())
    d = d.select("cc", "ix_id", F.coalesce("name", F.concat(F.lit("IX "), F.col("ix_id").cast("string"))).alias("name"),
                 F.coalesce("city", F.lit("")).alias("city"), F.coalesce("net_count", F.lit(0)).alias("net_count"))
    return runs.numbered(d, "pos", [-F.col("net_count"), F.col("name"), F.col("ix_id")], ["cc"])


def directory_totals(directory: DataFrame) -> DataFrame:
    return directory.groupBy("cc").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cc")


def directory_page(directory: DataFrame, page: int, size: int, cc: str | None = None) -> DataFrame:
    """One page of each (or one) country's directory; the page is clamped to the range."""
    d = directory if cc is None else directory.where(F.col("cc") == cc)
    pages = d.groupBy("cc").agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).cast("bigint").alias("pages"))
    pages = pages.withColumn("page", F.least(F.greatest(F.lit(page), F.lit(1)), "pages").cast("bigint"))
    return d.join(pages, ["cc"]).where(F.col("pos").between((F.col("page") - 1) * size + 1, F.col("page") * size))


def snapshot_stats(prefix: DataFrame, pathobs: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """One row of facts about a snapshot with a content version."""
    p = prefix.agg(
        F.count_if(F.col("family") == 4).alias("prefixes"), F.count_if(F.col("family") == 6).alias("prefixes_v6"),
        *[F.greatest(F.coalesce(F.round(F.percentile(F.when(F.col("family") == f, F.col("n_paths")), 0.9)), F.lit(1.0)).cast("bigint"),
                     F.lit(1)).alias(n) for f, n in ((4, "dfz_ref"), (6, "dfz_ref_v6"))])
    q = pathobs.agg(F.count_if(F.col("family") == 4).alias("paths"), F.count_if(F.col("family") == 6).alias("paths_v6"))
    one = p.withColumn("_k", F.lit(1)).join(q.withColumn("_k", F.lit(1)), ["_k"])  # one row each
    if segments is not None:
        one = one.join(segments.agg(F.count("*").alias("segments")).withColumn("_k", F.lit(1)), ["_k"])
    one = one.drop("_k")
    return one.withColumn("version", F.substring(F.sha1(F.to_json(F.struct(*one.columns))), 1, 12))


def collector_table(obs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per collector: source kind, observations, snapshot time."""
    kind = F.when(F.col("collector").startswith("route-views"), "routeviews").otherwise("ris")
    n = obs.groupBy("collector").agg(F.count("*").alias("n_obs"), F.sum("n_peers").alias("n_entries"))
    return n.join(snapshots, ["collector"], "left").withColumn("src", kind)


def overview_counts(stats: DataFrame, country_counts: DataFrame) -> DataFrame:
    s = stats.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("n")) for k, v in (
        ("prefixes", F.col("prefixes")), ("prefixes_v6", F.col("prefixes_v6")),
        ("paths", F.col("paths") + F.col("paths_v6")))])).alias("m")).select("m.*")
    return s.unionByName(country_counts.agg(F.count("*").alias("n")).select(F.lit("countries").alias("metric"), "n"))


def freshness(ts, now=None):
    """Age class of a snapshot time: live < 3 h, aging < 12 h, else stale; none is na."""
    t = F.col(ts) if isinstance(ts, str) else ts
    n = now if now is not None else F.current_timestamp()
    age = n.cast("timestamp").cast("double") - t.cast("timestamp").cast("double")
    return (F.when(t.isNull(), "na").when(age < 3 * 3600, "live").when(age < 12 * 3600, "aging").otherwise("stale"))
