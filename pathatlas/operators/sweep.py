"""Nearest enclosing prefix by one sweep over sorted prefixes.

Prefixes nest or are apart. In the order (start, length) the prefixes that enclose a row are just those that were opened
before it and have not ended: a stack of at most 32 or 128. The rows are range-partitioned, each partition is swept alone, and
the stack it starts with is looked up for its first address only. So each row meets its parent without a row per candidate
length, and however many rows share a prefix, none of their keys is hot.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import ip
from . import runs
from .joins import covering_join

CHUNK_BYTES = 32 << 20  # of a partition that one task holds at once


def enclosing(rows: DataFrame, *, start: str = "ip_start", plen: str = "plen", ident: str = "pid", real: Column | None = None,
              chunks: int | None = None) -> DataFrame:
    """The rows with ``up_start``, ``up_plen`` and ``up_id`` of the longest real prefix that is shorter and covers them (null: none).

    ``ident`` is a BIGINT that names a prefix. Rows for which ``real`` is false are looked up only; an address is a row of one bit
    more than the family has. Of equal prefixes one stands for all. Other columns are dropped.
    """
    wide = ip.is_wide(rows, start)
    bits = ip.bits_of(wide)
    real = F.lit(True) if real is None else real
    flat = rows.select(F.col(start).alias("pos"), F.col(plen).cast("int").alias("plen"), F.col(ident).cast("bigint").alias("id"), real.alias("real"))
    dealt = runs.with_chunks(flat, [F.col("pos"), F.col("plen")], chunks=chunks, chunk_bytes=CHUNK_BYTES)
    first = dealt.groupBy(runs.CHUNK).agg(F.min(F.struct("pos", "plen")).alias("f")).select(
        F.col(runs.CHUNK).alias("at"), F.col("f.pos").alias("f_pos"), F.col("f.plen").alias("f_plen"))
    over = covering_join(first, dealt.where("real"), left_start="f_pos", left_plen=F.lit(bits), right_start="pos", right_plen="plen",
                         right_cols={"pos": "pos", "plen": "plen", "id": "id"})
    opened = over.where((F.col("pos") < F.col("f_pos")) | (F.col("plen") < F.col("f_plen"))).select("at", "pos", "plen", "id")

    def number(p) -> int:
        return int.from_bytes(p, "big") if wide else int(p)

    def sweep(mine: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        stack = []  # (last address, start, length, id) of the open prefixes, the longest last
        for p, n, i in before.sort_values("plen")[["pos", "plen", "id"]].itertuples(index=False):
            if not stack or stack[-1][2] < n:
                stack.append((number(p) + (1 << bits - n) - 1, p, n, i))
        mine = mine.sort_values(["pos", "plen"], kind="stable")
        up = []
        for p, n, i, keep in zip(mine["pos"], mine["plen"], mine["id"], mine["real"], strict=True):
            at = number(p)
            while stack and stack[-1][0] < at:
                stack.pop()
            same = bool(stack) and stack[-1][2] == n
            above = stack[-2:-1] if same else stack[-1:]
            up.append(above[0][1:] if above else (None, None, None))
            if keep and not same:
                stack.append((at + (1 << bits - n) - 1, p, n, i))
        told = pd.DataFrame(up, columns=["up_start", "up_plen", "up_id"], dtype=object)
        for c in ("pos", "plen", "id", "real"):
            told[c] = mine[c].to_numpy()
        return told

    kind = rows.schema[start].dataType
    out = StructType([StructField("pos", kind), *[f for f in flat.schema.fields if f.name != "pos"], StructField("up_start", kind),
                      StructField("up_plen", LongType()), StructField("up_id", LongType())])
    done = dealt.groupBy(runs.CHUNK).cogroup(opened.groupBy("at")).applyInPandas(sweep, out)
    return done.select(F.col("pos").alias(start), F.col("plen").alias(plen), F.col("id").alias(ident), "real", "up_start",
                       F.col("up_plen").cast("int").alias("up_plen"), "up_id")


def longest_match(points: DataFrame, prefixes: DataFrame, *, point: str, cols: dict[str, str], chunks: int | None = None) -> DataFrame:
    """Longest-prefix match for a table of addresses (left join semantics).

    Distinct addresses join the sweep as rows of their own, one for each; the match is joined back by address (adaptive
    execution splits a hot address). ``cols`` maps prefix column -> output name.
    """
    bits = ip.bits_of(ip.is_wide(points, point))
    known = prefixes.select("ip_start", "plen", *[c for c in cols if c not in ("ip_start", "plen")])
    none = F.lit(None).cast("bigint").alias("_id")
    addrs = points.select(F.col(point).alias("ip_start")).where(F.col("ip_start").isNotNull()).distinct()
    rows = known.select("ip_start", F.col("plen").cast("int").alias("plen"), none, F.lit(True).alias("_real")).unionByName(
        addrs.select("ip_start", F.lit(bits + 1).alias("plen"), none, F.lit(False).alias("_real")))
    found = enclosing(rows, ident="_id", real=F.col("_real"), chunks=chunks).where(~F.col("real") & F.col("up_plen").isNotNull())
    facts = known.dropDuplicates(["ip_start", "plen"]).select(F.struct(*[F.col(c).alias(o) for c, o in cols.items()]).alias("_best"),
                                                              F.col("ip_start").alias("up_start"), F.col("plen").cast("int").alias("up_plen"))
    best = found.select(F.col("ip_start").alias(point), "up_start", "up_plen").join(facts, ["up_start", "up_plen"]).select(point, "_best")
    out = points.where(F.col(point).isNotNull()).join(best, [point], "left")
    out = out.select(*points.columns, *[F.col("_best")[o].alias(o) for o in cols.values()])
    # rows without an address meet nothing and stay out of the join, where they would share one key
    rest = points.where(F.col(point).isNull())
    return out.unionByName(rest.select(*points.columns, *[F.lit(None).cast(out.schema[o].dataType).alias(o) for o in cols.values()]))
