"""Positional hop index: which distinct AS paths hold a network, and where.

Many prefixes share a path, so paths are kept once under a digest of their text. ``hops`` is sorted by network, so the scan
of a pattern's networks reads their stretch of the files only; positions decide the pattern, no path is interpreted. ``uses``
leads from the paths back to the prefixes and their observations.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..session import cut_lineage


@dataclass(frozen=True)
class HopIndex:
    hops: DataFrame  # asn, path_id, at: sorted by asn
    uses: DataFrame  # pid, path_id, n_peers, and the columns named when it was built
    totals: DataFrame  # pid, observed_peers


def path_id(path_str) -> Column:
    """128 bits of a path's text."""
    return F.unhex(F.md5(F.trim(path_str).cast("binary")))


def hop_rows(path_rows: DataFrame) -> DataFrame:
    """(asn, path_id, at) of every hop of every distinct path; ``at`` counts from 0. Words that are no numbers hold a place only."""
    text = path_rows.select(F.trim("path_str").alias("_t")).distinct()
    hops = text.select(path_id(F.col("_t")).alias("path_id"), F.posexplode(F.split("_t", " ")).alias("at", "asn"))
    return hops.select(F.col("asn").try_cast("bigint").alias("asn"), "path_id", "at").where(F.col("asn").isNotNull())


def sorted_hops(hops: DataFrame, parts: int | None = None) -> DataFrame:
    """Range partitions by (asn, path): a network on very many paths fills several of them."""
    n = parts or int(hops.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return hops.repartitionByRange(n, "asn", "path_id").sortWithinPartitions("asn", "path_id")


def build(path_rows: DataFrame, keep: Sequence[str] = (), parts: int | None = None) -> HopIndex:
    """The index over path rows (pid, path_str, n_peers); the hops are written once to the shared folder, in ``parts`` files."""
    uses = path_rows.select("pid", path_id(F.col("path_str")).alias("path_id"), "n_peers", *keep)
    totals = path_rows.groupBy("pid").agg(F.sum("n_peers").alias("observed_peers"))
    return HopIndex(cut_lineage(sorted_hops(hop_rows(path_rows), parts)), uses, totals)


def save(index: HopIndex, path: str) -> None:
    """Publish the index as three tables below ``path``; the path uses are sorted by path."""
    index.hops.sortWithinPartitions("asn", "path_id").write.mode("overwrite").parquet(f"{path}/hops")
    index.uses.repartitionByRange("path_id").sortWithinPartitions("path_id").write.mode("overwrite").parquet(f"{path}/uses")
    index.totals.write.mode("overwrite").parquet(f"{path}/totals")


def load(spark: SparkSession, path: str) -> HopIndex:
    return HopIndex(*[spark.read.parquet(f"{path}/{name}") for name in ("hops", "uses", "totals")])


def _literals(q: P.PathQuery) -> list[tuple[int, int, int]]:
    """(asn, stretch, offset in it) of the pattern's networks, in order."""
    return [(asn, s, k) for s, stretch in enumerate(q.stretches) for k, asn in enumerate(stretch) if asn is not None]


def matching_paths(index: HopIndex, q: P.PathQuery) -> DataFrame:
    """(path_id) of the distinct paths that pass the include part of a pattern with at least one network.

    Posting joins along the pattern: inside a stretch the distance of two networks is fixed, a later stretch lies behind. The
    lists of all but the rarest network are first reduced to the rarest one's paths.
    """
    lits = _literals(q)
    names = sorted({asn for asn, _, _ in lits})
    posts = index.hops.where(F.col("asn").isin(*names))
    if len(lits) == 1:
        return posts.select("path_id").distinct()
    sizes = {r["asn"]: r["n"] for r in posts.groupBy("asn").agg(F.count("*").alias("n")).collect()}  # a row for each network named
    rare = min(names, key=lambda a: sizes.get(a, 0))
    few = posts.where(F.col("asn") == rare).select("path_id").distinct()
    now = None
    for n, (asn, stretch, offset) in enumerate(lits):
        here = posts.where(F.col("asn") == asn).select("path_id", F.col("at").alias("_next"))
        if asn != rare:
            here = here.join(few, ["path_id"], "left_semi")
        if now is None:
            now = here.withColumnRenamed("_next", "_at")
            continue
        _, before, there = lits[n - 1]
        fits = F.col("_next") - F.col("_at") == offset - there if stretch == before else F.col("_next") > F.col("_at")
        now = now.join(here, ["path_id"]).where(fits).select("path_id", F.col("_next").alias("_at")).distinct()
    return now.select("path_id").distinct()


def hit_uses(index: HopIndex, query: str, excludes: bool = True) -> DataFrame:
    """The rows of ``uses`` whose path passes the pattern (an empty include part passes every path)."""
    q = P.path_query_parse(query)
    hits = index.uses.join(matching_paths(index, q), ["path_id"], "left_semi") if q.include else index.uses
    if excludes and q.excludes:
        barred = index.hops.where(F.col("asn").isin(*q.excludes)).select("path_id").distinct()
        hits = hits.join(barred, ["path_id"], "left_anti")
    return hits


def path_prefilter(index: HopIndex, query: str) -> DataFrame:
    """pids with at least one path that passes the include part."""
    return hit_uses(index, query, excludes=False).select("pid").distinct()


def matched_peers(index: HopIndex, query: str) -> DataFrame:
    """(pid, matched_peers, observed_peers) of the prefixes with a matching path."""
    hits = hit_uses(index, query).groupBy("pid").agg(F.sum("n_peers").alias("matched_peers"))
    return hits.where("matched_peers > 0").join(index.totals, ["pid"])
