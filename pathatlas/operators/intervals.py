"""Interval algebra per key, safe for hot keys (see ``runs``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ip
from . import runs


def intervals_merge(df: DataFrame, keys: Sequence[str], start: str = "s", end: str = "e",
                    chunks: int | None = None) -> DataFrame:
    """Union of overlapping or adjacent intervals within a key -> (keys, s, e)."""
    wide = ip.is_wide(df, start)
    keys = list(keys)
    base = df.select(*keys, F.col(start).alias("s"), F.col(end).alias("e"))
    order = [F.col("s"), F.col("e")]
    c = runs.with_chunks(base, order, keys, chunks)
    c = runs.scan(c, "_prev", F.col("e"), "max", order, keys, inclusive=False)
    nxt = ip.succ("_prev", wide)
    # a NULL successor means the previous interval reached the end of the space
    touches = F.col("_prev").isNotNull() & (nxt.isNull() | (F.col("s") <= nxt))
    c = runs.scan(c, "_island", F.when(~touches, F.col("s")), "last", order, keys)
    return c.groupBy(*keys, "_island").agg(F.max("e").alias("e")).select(
        *keys, F.col("_island").alias("s"), "e")


def intervals_subtract(base: DataFrame, holes: DataFrame, key: str, start: str = "s", end: str = "e",
                       chunks: int | None = None) -> DataFrame:
    """[s, e] of each key minus its holes; remaining pieces -> (key, s, e).

    One base interval per key. Holes may overlap and may stick out of the base.
    """
    wide = ip.is_wide(base, start)
    b = base.select(F.col(key), F.col(start).alias("_bs"), F.col(end).alias("_be"))
    h = holes.select(F.col(key), F.col(start).alias("hs"), F.col(end).alias("he"))
    order = [F.col("hs"), F.col("he")]
    h = runs.with_chunks(h, order, [key], chunks)
    c = runs.drop_chunks(runs.scan(h, "_prev", F.col("he"), "max", order, [key], inclusive=False))
    cur = ip.succ("_prev", wide)
    # where to resume: after the holes so far, never before the base start
    resume = (F.when(F.col("_prev").isNull(), F.col("_bs"))
              .when(cur.isNull() | (cur < F.col("_bs")), F.when(cur.isNull(), cur).otherwise(F.col("_bs")))
              .otherwise(cur))
    j = c.join(b, [key]).withColumn("s", resume).withColumn("_cut", ip.pred("hs", wide))
    before = (j.where(F.col("s").isNotNull() & F.col("_cut").isNotNull())
              .withColumn("e", F.when(F.col("_cut") <= F.col("_be"), F.col("_cut")).otherwise(F.col("_be")))
              .where(F.col("s") <= F.col("e")).select(key, "s", "e"))
    last = h.groupBy(key).agg(F.max("he").alias("_prev"))
    tail = b.join(last, [key], "left").withColumn("s", resume).where(
        F.col("s").isNotNull() & (F.col("s") <= F.col("_be"))).select(key, "s", F.col("_be").alias("e"))
    return before.unionByName(tail)


def range_to_cidrs(df: DataFrame, start: str, end: str, out: str = "cidrs") -> DataFrame:
    return df.withColumn(out, ip.range_to_cidrs(start, end, ip.is_wide(df, start)))
