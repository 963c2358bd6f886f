"""Near-duplicates by SimHash fingerprints, searched exactly through vantage-point trees.

Fingerprints are reduced to distinct values first, so a text that is repeated a billion times is one point. A routing
tree of vantage points, fitted to a bounded sample, gives every fingerprint one home shard. A pair at distance k from
each other differs by at most k in its distance to any vantage point; so a point of the outer side at distance <= r + k
also visits the inner side, and a visitor goes on to every side that its ball of radius k meets. Each linked pair thus
meets in the home shard of one of the two. In a shard the same split goes on until few points are left, and these are
compared shell by shell, skipping the shells that the triangle bound excludes. A shard hands out only the stars of its own
components, never all pairs. Stars are merged by alternating large-star and small-star rounds.

Cost: in 64-bit Hamming space a ball of radius 3 meets about half of all median cuts, so visits grow as about the 0.6th
power of the number of distinct fingerprints. Shard size trades visits against comparisons.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_text, query, saved, table

SHARD = 8192  # fingerprints at home in a shard that is dealt out
SMALL = 1024  # below this a shard is no longer split
SAMPLE = 65536


def simhash(text: str, words: int = 3) -> int:
    """Signed 64-bit SimHash over shingles of ``words`` words; 0 for a text without words."""
    tokens = text.encode("utf-8").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) < words:
        return int(np.uint64(xxhash.xxh64_intdigest(joined, 42)).astype(np.int64))
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(tokens) - words + 1].tolist()
    ends = ends[words - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), 8192):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at:at + 8192], ends[at:at + 8192], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp BIGINT) per row; a null text counts as empty. Other columns are not read."""
    fp = per_text(lambda t: simhash(t, words), "long")
    return docs.select(F.col(id_col).alias("id"), fp(F.col(text_col)).alias("fp"))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _vantage(points: np.ndarray) -> tuple[np.uint64, np.ndarray, int] | None:
    """The candidate that spreads the points most, their distances and the median radius; None if nothing can be split."""
    best = None
    probe = points[:: max(1, len(points) // 512)]
    for v in points[:: max(1, len(points) // 8)][:8]:
        spread = float(np.bitwise_count(probe ^ v).std())
        if best is None or spread > best[0]:
            best = (spread, v)
    d = np.bitwise_count(points ^ best[1]).astype(np.int16)
    r = int(np.median(d))
    r = r if (d > r).any() else r - 1
    return (best[1], d, r) if (d <= r).any() and (d > r).any() else None


def build_tree(sample: np.ndarray, leaves: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, radius, inner, outer) over a sample; a child below zero is shard ``-1 - child``. Empty: one shard."""
    nodes: list[list[int]] = []
    shards = 0
    todo = [(sample, max(1, leaves), None)]
    while todo:
        points, share, slot = todo.pop()
        cut = _vantage(points) if share > 1 and len(points) > 1 else None
        if cut is None:
            at, shards = -1 - shards, shards + 1
        else:
            v, d, r = cut
            at = len(nodes)
            nodes.append([int(v), r, 0, 0])
            todo += [(points[d <= r], share // 2, (at, 2)), (points[d > r], share - share // 2, (at, 3))]
        if slot is not None:
            nodes[slot[0]][slot[1]] = at
    return [tuple(n) for n in nodes]


def route(points: np.ndarray, nodes: list[tuple[int, int, int, int]], k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, positions of its home points, positions of its visitors) for every shard that gets some."""
    everyone = np.arange(len(points))
    if not nodes:
        return [(0, everyone, everyone[:0])]
    out, todo = [], [(0, everyone, everyone[:0])]
    while todo:
        at, home, guests = todo.pop()
        if not len(home) and not len(guests):
            continue
        if at < 0:
            out.append((-1 - at, home, guests))
            continue
        v, r, inner, outer = nodes[at]
        dh = np.bitwise_count(points[home] ^ np.uint64(v)).astype(np.int16)
        dg = np.bitwise_count(points[guests] ^ np.uint64(v)).astype(np.int16)
        todo.append((inner, home[dh <= r], np.concatenate([home[(dh > r) & (dh <= r + k)], guests[dg <= r + k]])))
        todo.append((outer, home[dh > r], guests[dg > r - k]))
    return out


class _Sets:
    """Disjoint sets over positions; ``root`` is kept flat between blocks."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, rows: np.ndarray, cols: np.ndarray) -> None:
        root = self.root
        pairs = np.unique(root[rows] * len(root) + root[cols])
        for a, b in zip((pairs // len(root)).tolist(), (pairs % len(root)).tolist(), strict=True):
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(pairs):
            while (root != root[root]).any():
                root[:] = root[root]


def _shells(points: np.ndarray, home: np.ndarray, guests: np.ndarray, k: int, sets: _Sets) -> None:
    """Compare home points with each other and with guests, skipping what the triangle bound excludes."""
    v = points[home[0]]
    dist = lambda ix: np.bitwise_count(points[ix] ^ v).astype(np.int16)
    home = home[np.argsort(dist(home), kind="stable")]
    dh = dist(home)
    for seekers in (home, guests):
        ds = dist(seekers)
        for d in np.unique(ds):
            near = home[np.searchsorted(dh, d - k):np.searchsorted(dh, d + k, "right")]
            shell = seekers[ds == d]
            for at in range(0, len(shell) if len(near) else 0, 256):
                block = shell[at:at + 256]
                i, j = np.nonzero(np.bitwise_count(points[block][:, None] ^ points[near][None, :]) <= k)
                sets.link(block[i], near[j])


def shard_stars(points: np.ndarray, home: np.ndarray, k: int, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Stars (point, smallest point of its local component) over all pairs within ``k`` that have an end in ``home``."""
    order = np.argsort(points, kind="stable")
    points, home = points[order], home[order]
    sets = _Sets(len(points))
    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while todo:
        mine, guests = todo.pop()
        if not len(mine):
            continue
        cut = _vantage(points[mine]) if len(mine) > small else None
        if cut is None:
            _shells(points, mine, guests, k, sets)
            continue
        v, dh, r = cut
        dg = np.bitwise_count(points[guests] ^ v).astype(np.int16)
        todo.append((mine[dh <= r], np.concatenate([mine[(dh > r) & (dh <= r + k)], guests[dg <= r + k]])))
        todo.append((mine[dh > r], guests[dg > r - k]))
    moved = sets.root != np.arange(len(points))
    return points[moved], points[sets.root[moved]]


def links(points: DataFrame, k: int = 3, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Stars (u, v) that connect exactly the fingerprints of ``points`` (distinct ``fp``) within ``k`` bits.

    The tree is fitted to about ``sample`` fingerprints (chosen by hash); every fingerprint is routed through it.
    """
    total = points.count()
    every = max(1, total // sample)
    picked = points.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("fp").toPandas()["fp"].to_numpy(np.int64)
    nodes = build_tree(np.sort(picked).view(np.uint64), -(-total // shard))

    def deal(batches):
        for pdf in batches:
            fp = pdf["fp"].to_numpy(np.int64)
            for s, home, guests in route(fp.view(np.uint64), nodes, k):
                yield pd.DataFrame({"shard": s, "fp": fp[np.concatenate([home, guests])], "home": np.arange(len(home) + len(guests)) < len(home)})

    def stars(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = shard_stars(pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["home"].to_numpy(bool), k)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    dealt = points.select("fp").mapInPandas(deal, "shard long, fp long, home boolean")
    return dealt.groupBy("shard").applyInPandas(stars, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the smallest node of the component.

    Minimum per node is a partial aggregate and comes back by an equi-join, so a node with very many links is split by
    adaptive execution. Each round is written to the shared folder.
    """
    def down(e: DataFrame) -> DataFrame:
        return e.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    now, before = saved(down(edges)), None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == before or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = down(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = saved(down(small))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, words: int = 3,
                    shard: int = SHARD) -> DataFrame:
    """(id, fp, component) per row: component is the smallest id reachable over fingerprints within ``k`` bits.

    Null or empty texts have fingerprint 0 and are linked like any other. Repeated rows keep a row each. A null id never
    becomes a component while the component has another id; a component of null ids only has a null component.
    An empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    fps = saved(fingerprints(docs, id_col, text_col, words))
    points = saved(fps.groupBy("fp").agg(F.min("id").alias("least_id")))
    roots = saved(components(links(points, k, shard)))
    placed = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least_id").alias("component"))
    by_fp = placed.join(least, "root").select("fp", "component")
    return fps.join(by_fp, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """One row of each group of near-duplicates, with all columns of ``docs``.

    The row with the smallest id stays; of rows that repeat an id, one. Rows without id stay (one of each group) only
    where the group has no id at all.
    """
    found = saved(near_duplicates(docs, id_col, text_col, k))
    named = found.where("id = component").select(F.col("id").alias("_kept_id")).distinct()
    out = docs.join(named, docs[id_col] == named["_kept_id"], "left_semi").dropDuplicates([id_col])
    nameless = found.where("component is null").select("fp").distinct()
    if nameless.isEmpty():
        return out
    roots = components(links(nameless, k)).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    roots = nameless.join(roots, F.col("fp") == F.col("_node"), "left").select("fp", F.coalesce("_root", "fp").alias("_root"))
    rows = docs.where(F.col(id_col).isNull()).select(F.struct(*docs.columns).alias("_row"))
    rest = rows.withColumn("_fp", per_text(simhash, "long")(F.col("_row")[text_col])).join(roots, F.col("_fp") == F.col("fp"))
    return out.union(rest.dropDuplicates(["_root"]).select("_row.*"))


@query("op1_simhash")
def op1(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), as_hex(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
