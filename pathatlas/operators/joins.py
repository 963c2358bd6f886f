"""Containment, as-of and overlap joins built from equi-joins and chunked scans.

A double-inequality join would become a nested loop. Containment of prefixes is instead
an equi-join on (length, masked start): each left row probes only the lengths that occur
on the right (at most 32 or 128). As-of lookups are an ordered scan over the union.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ip
from . import runs

# Prefixes this short or shorter are few (at most 2^13 of them in IPv4) but may cover a
# large share of all rows, so their join keys are salted.
SHORT_V4, SHORT_V6 = 12, 24


def covering_join(left: DataFrame, right: DataFrame, *, left_start: str = "ip_start", left_plen: str | Column = "plen",
                  right_start: str = "ip_start", right_plen: str = "plen", right_cols: dict[str, str] | None = None,
                  strict: bool = False, lengths: Sequence[int] | None = None, salts: int = 8,
                  short: int | None = None) -> DataFrame:
    """Inner join of every left prefix with every right prefix that covers it.

    ``right_cols`` maps right column -> output name. ``strict`` keeps shorter ones only.
    ``lengths`` may name the right side's lengths; else a scalar subquery lists them.
    """
    wide = ip.is_wide(left, left_start)
    short = short if short is not None else (SHORT_V6 if wide else SHORT_V4)
    lplen = F.col(left_plen) if isinstance(left_plen, str) else left_plen
    if lengths is not None:
        lens = F.array(*[F.lit(int(x)) for x in lengths])
    else:
        lens = right.select(F.collect_set(F.col(right_plen).cast("int"))).scalar()
    hi, lo = ip.addr_pair(left_start, wide)
    # the halves are computed once per row, before the lengths multiply it
    probe = left.withColumn("_h0", hi).withColumn("_l0", lo).withColumn("_len", F.explode(lens))
    probe = probe.where((F.col("_len") < lplen) if strict else (F.col("_len") <= lplen))
    kh, kl = ip.mask_pair(F.col("_h0"), F.col("_l0"), F.col("_len"), wide)
    spread = F.pmod(F.xxhash64(left_start, lplen), F.lit(salts)).cast("int")
    probe = (probe.withColumn("_hi", kh).withColumn("_lo", kl)
             .withColumn("_salt", F.when(F.col("_len") <= short, spread).otherwise(F.lit(0))))
    rh, rl = ip.addr_pair(right_start, wide)
    cols = right_cols or {c: c for c in right.columns}
    build = right.select(
        F.col(right_plen).cast("int").alias("_len"), rh.alias("_hi"), rl.alias("_lo"),
        F.explode(F.when(F.col(right_plen) <= short, F.sequence(F.lit(0), F.lit(salts - 1)))
                  .otherwise(F.array(F.lit(0)))).alias("_salt"),
        *[F.col(c).alias(o) for c, o in cols.items()])
    return probe.join(build, ["_len", "_hi", "_lo", "_salt"]).drop("_len", "_hi", "_lo", "_salt", "_h0", "_l0")


def asof_join(points: DataFrame, intervals: DataFrame, *, point: str, start: str, end: str,
              cols: dict[str, str], keys: Sequence[str] = (), chunks: int | None = None) -> DataFrame:
    """Left as-of join: the last interval with start <= point, valid only if point <= end.

    Intervals must not overlap. ``cols`` maps interval column -> output name.
    """
    wide = ip.is_wide(points, point)
    payload = F.struct(F.col(end).alias("_e"), *[F.col(c).alias(o) for c, o in cols.items()])
    rows = F.struct(*[F.col(c) for c in points.columns])
    p = points.select(*[F.col(k) for k in keys], F.col(point).alias("_pos"), F.lit(1).alias("_is_point"),
                      rows.alias("_row"))
    i = intervals.select(*[F.col(k) for k in keys], F.col(start).alias("_pos"), F.lit(0).alias("_is_point"),
                         payload.alias("_iv"))
    u = p.unionByName(i, allowMissingColumns=True)
    # equal addresses share a chunk, so an interval starting at the point is seen first
    c = runs.with_chunks(u, [F.col("_pos"), F.col("_is_point")], keys, chunks)
    s = runs.scan(c, "_hit", F.col("_iv"), "last", [F.col("_pos"), F.col("_is_point")], keys)
    hit = F.when(F.col("_pos") <= F.col("_hit._e"), F.col("_hit"))
    return (s.where(F.col("_is_point") == 1)
            .select("_row.*", *[hit[o].alias(o) for o in cols.values()]))


def overlap_scan(a: DataFrame, b: DataFrame, *, a_start: str, b_start: str, chunks: int | None = None) -> DataFrame:
    """Interleave two sets of disjoint intervals by start -> (_is_a, _pos, _a, _b).

    An a-row carries itself in ``_a`` and the last b starting at or before it in ``_b``;
    a b-row carries itself in ``_b`` and the last a starting strictly before it in ``_a``.
    One write, one exchange, two scans: linear in both inputs, whatever the overlaps.
    """
    wide = ip.is_wide(a, a_start)
    pack = lambda d: F.struct(*[F.col(c) for c in d.columns])
    rows = a.select(F.col(a_start).alias("_pos"), F.lit(1).alias("_is_a"), pack(a).alias("_ra")).unionByName(
        b.select(F.col(b_start).alias("_pos"), F.lit(0).alias("_is_a"), pack(b).alias("_rb")), allowMissingColumns=True)
    order = [F.col("_pos"), F.col("_is_a")]
    c = runs.with_chunks(rows, order, chunks=chunks)
    c = runs.scan(c, "_b", F.col("_rb"), "last", order)
    c = runs.scan(c, "_a", F.col("_ra"), "last", order)
    return c.select("_is_a", "_pos", "_a", "_b")


def overlap_pieces(a: DataFrame, b: DataFrame, *, a_start: str, a_end: str, b_start: str, b_end: str,
                   a_cols: dict[str, str], b_cols: dict[str, str]) -> DataFrame:
    """Intersections (s, e) of two sets of disjoint intervals with columns of both sides.

    Each piece begins either at an a-start inside a b-interval or at a later b-start
    inside an a-interval, so the scan yields every piece exactly once.
    """
    x = overlap_scan(a, b, a_start=a_start, b_start=b_start)
    at_a = (F.col("_is_a") == 1) & (F.col("_pos") <= F.col("_b")[b_end])
    at_b = (F.col("_is_a") == 0) & (F.col("_pos") <= F.col("_a")[a_end])
    ends = (F.col("_a")[a_end], F.col("_b")[b_end])
    return x.where(at_a | at_b).select(
        F.col("_pos").alias("s"), F.when(ends[0] <= ends[1], ends[0]).otherwise(ends[1]).alias("e"),
        *[F.col("_a")[c].alias(o) for c, o in a_cols.items()], *[F.col("_b")[c].alias(o) for c, o in b_cols.items()])
