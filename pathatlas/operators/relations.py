"""AS adjacency, relation classes, route graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from . import runs


def _adjacent(top_paths: DataFrame, tier1: Sequence[int]) -> DataFrame:
    """Both directions of every step of a path, from one pass over the path and its shift.

    Evidence is weak for the side before which the path has met no tier-1.
    """
    steps = F.zip_with("path_arr", F.slice("path_arr", 2, F.size("path_arr")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    marked = F.transform("path_arr", lambda x: P.is_tier1(x, tier1))
    at = F.when(F.exists(marked, lambda m: m), F.array_position(marked, F.lit(True)))  # 1-based, null without a tier-1
    base = top_paths.where(F.size("path_arr") >= 2).select("pid", F.size("path_arr").alias("L"), at.alias("_t1"), F.posexplode(steps).alias("_i", "_s"))
    base = base.where("_s.a IS NOT NULL AND _s.b IS NOT NULL AND _s.a <> _s.b")
    met = lambda position: F.coalesce(F.col("_t1") < position, F.lit(False))
    side = lambda asn, other, position, left: F.struct(
        asn.alias("asn"), other.alias("neighbor"), (~met(position)).alias("weak"), F.lit(left).alias("is_left"))
    here = F.col("_i") + 1
    return base.select("pid", "L", F.explode(F.array(
        side(F.col("_s.a"), F.col("_s.b"), here, False), side(F.col("_s.b"), F.col("_s.a"), here + 1, True))).alias("p")).select("pid", "L", "p.*")


def _neigh_counts(adj: DataFrame) -> DataFrame:
    left, weak = F.col("is_left"), F.col("weak")
    return adj.groupBy("asn", "neighbor").agg(
        F.count_if(~left & ~weak).alias("d"), F.count_if(left & ~weak).alias("u"),
        F.count_if(left & weak).alias("w"), F.count_if(~left & weak).alias("wd"),
        F.min(F.struct("L", "pid")).alias("_ev")).select(
        "asn", "neighbor", "d", "u", "w", "wd", F.col("_ev.pid").alias("ev_pid"))


def asn_neigh(top_paths: DataFrame, prefix: DataFrame | None = None, tier1: Sequence[int] = P.TIER1) -> DataFrame:
    """Adjacency counts with an evidence prefix; aggregated map-side before the shuffle."""
    out = _neigh_counts(_adjacent(top_paths, tier1))
    if prefix is not None:
        out = out.join(prefix.select(F.col("pid").alias("ev_pid"), F.col("prefix").alias("ev_prefix")), ["ev_pid"], "left")
    return out


def neigh_scan(top_paths: DataFrame, asn: int, tier1: Sequence[int] = P.TIER1) -> DataFrame:
    """The same counts for one subject, from only the paths that contain it."""
    hit = top_paths.where(F.array_contains("path_arr", F.lit(asn).cast("bigint")))
    return _neigh_counts(_adjacent(hit, tier1).where(F.col("asn") == asn)).drop("ev_pid")


def relation_classify(neigh: DataFrame, tier1: Sequence[int] = P.TIER1) -> DataFrame:
    """Add ``rel``: what the neighbour is to the AS - up (provider), down (customer) or peer.

    Two tier-1s are peers and a tier-1 is above everyone else. Otherwise the share of strong
    observations with the neighbour on the far side decides: four fifths make a customer, one
    fifth a provider unless the AS is a tier-1 itself; without strong observations it is a peer.
    """
    strong = F.col("d") + F.col("u")
    far_fifths = F.when(strong > 0, 5 * F.col("d"))
    by_share = (F.when(far_fifths >= 4 * strong, "down")
                .when((far_fifths <= strong) & ~P.is_tier1("asn", tier1), "up").otherwise("peer"))
    by_tier = F.when(P.is_tier1("neighbor", tier1), F.when(P.is_tier1("asn", tier1), "peer").otherwise("up"))
    return neigh.withColumn("rel", F.coalesce(by_tier, by_share))


def relation_groups(neigh: DataFrame, tier1: Sequence[int] = P.TIER1) -> DataFrame:
    """Neighbours of every AS in three groups, most observed first (``pos``)."""
    n = F.when(F.col("rel") == "peer", F.col("d") + F.col("u") + F.col("w") + F.col("wd")).otherwise(
        F.col("d") + F.col("u"))
    g = relation_classify(neigh, tier1).withColumn("n", n)
    return runs.numbered(g, "pos", [-F.col("n"), F.col("neighbor")], ["asn", "rel"])


def relation_evidence(neigh: DataFrame, top_paths: DataFrame) -> DataFrame:
    """Shortest path of the evidence pid in which both are adjacent, with the side."""
    j = neigh.select("asn", "neighbor", F.col("ev_pid").alias("pid")).join(
        top_paths.select("pid", "path_arr", "path_len"), ["pid"])
    idx = F.sequence(F.lit(0), F.size("path_arr") - 1)
    at = lambda i: F.get("path_arr", i)
    down = lambda i: (at(i) == F.col("asn")) & (at(i + 1) == F.col("neighbor"))
    up = lambda i: (at(i) == F.col("asn")) & (at(i - 1) == F.col("neighbor"))
    sides = F.transform(idx, lambda i: F.when(down(i), "d").when(up(i), "u"))
    first = F.get(F.filter(sides, lambda s: s.isNotNull()), 0)
    hits = j.withColumn("side", first).where(F.col("side").isNotNull())
    best = hits.groupBy("asn", "neighbor").agg(F.min_by(
        F.struct("pid", P.path_text("path_arr").alias("path"), "side"),
        F.struct(F.col("path_len"), P.path_text("path_arr"))).alias("b"))
    return best.select("asn", "neighbor", "b.pid", "b.path", "b.side")


def _graph_paths(top_paths: DataFrame, tier1: Sequence[int]) -> DataFrame:
    raw = F.coalesce("path_arr_raw", "path_arr")
    return (top_paths.where(F.size(P.tier1_hops("path_arr", tier1)) > 0)
            .withColumn("_cut", P.trunc_to_tier1(raw, tier1))
            .withColumn("_w", F.when(F.col("n_peers") > 0, F.col("n_peers")).otherwise(F.lit(1)))
            .withColumn("_raw_text", P.path_text(raw)))


def route_graph(top_paths: DataFrame, tier1: Sequence[int] = P.TIER1) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) per prefix over the paths that reach a tier-1."""
    g = _graph_paths(top_paths, tier1)
    nodes = g.select("pid", F.explode(P.distance_nodes("_cut")).alias("n")).select("pid", "n.asn", "n.d").distinct()
    edges = g.select("pid", "_w", F.explode(P.distance_edges("_cut")).alias("e")).groupBy(
        "pid", "e.au", "e.du", "e.av", "e.dv", "e.span").agg(F.sum("_w").alias("weight"))
    return nodes, edges


def route_graph_main(top_paths: DataFrame, tier1: Sequence[int] = P.TIER1) -> DataFrame:
    """Edges of the main route: most peers, then the representative, then the shorter."""
    g = _graph_paths(top_paths, tier1)
    best = g.groupBy("pid").agg(F.min_by("_cut", F.struct(
        -F.col("n_peers"), F.when(F.col("is_best"), 0).otherwise(1), F.size("path_arr"), F.col("_raw_text"))).alias("_cut"))
    return best.select("pid", F.explode(P.distance_edges("_cut")).alias("e")).select("pid", "e.au", "e.du", "e.av", "e.dv")


def tier1_transit(top_paths: DataFrame, tier1: Sequence[int] = P.TIER1) -> DataFrame:
    """Per prefix three sets as rows (what, a, b): tier-1s seen, entries, adjacent pairs."""
    h = P.tier1_hops("path_arr", tier1)
    none = F.lit(None).cast("bigint")
    row = lambda what, a, b: F.struct(F.lit(what).alias("what"), a.alias("a"), b.alias("b"))
    d = top_paths.select("pid", h.alias("h")).where(F.size("h") > 0)
    seen = F.transform("h", lambda x: row("seen", x, none))
    entry = F.array(row("entry", F.get("h", 0), none))
    pairs = F.filter(F.transform("h", lambda x, i: row("pair", x, F.get("h", i + 1))),
                     lambda r: r["b"].isNotNull() & (r["a"] != r["b"]))
    return d.select("pid", F.explode(F.array_distinct(F.concat(seen, entry, pairs))).alias("r")).select("pid", "r.*").distinct()


def upstream_summary(top_paths: DataFrame, top: int | None = None) -> DataFrame:
    """ASes directly before the origin by number of distinct paths, all or the ``top`` ones per prefix."""
    u = top_paths.select("pid", P.upstream_of_origin("path_arr").alias("asn")).where("asn IS NOT NULL")
    n = u.groupBy("pid", "asn").agg(F.count("*").alias("n"))
    return runs.ranked(n, "pos", [F.desc("n"), F.col("asn")], ["pid"], top)
