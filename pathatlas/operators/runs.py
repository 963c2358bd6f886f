"""Ordered scans that never put a whole key, or a whole table, into one task.

A running maximum, a running "last value" or a row number over a global order normally
forces one sorted task. Here the rows are range-partitioned by keys and full order; every
partition (chunk) is scanned on its own and a small carry (one row per key and chunk)
brings in what came before. Rows that tie in the order may fall into neighbouring chunks,
so neither equal addresses nor one hot key pile up in a task. The chunk numbers are written
with the rows, so a recomputed task sees the same chunks as the first run did.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, settle

CHUNK = "_chunk"
CHUNK_BYTES = 256 << 20  # of a chunk that is scanned by a window, which spills
TASK_BYTES = 16 << 20  # of compressed input to one task; a hash table of its rows takes some 25 times as much


def with_chunks(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), chunks: int | None = None,
                chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Add ``_chunk``: the number of the row's range partition by (keys, ascending ``order``).

    The rows are written once, with their chunk numbers. Only where the estimated size asks for more chunks than the session has
    shuffle partitions is the input written before, as its written size then gives the number of chunks; it goes when the chunks stand.
    """
    def ranged() -> DataFrame:
        base, n = df, chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if not chunks and plan_bytes(df) > n * chunk_bytes:
            base = cut_lineage(df)
            n = max(n, -(-plan_bytes(base) // chunk_bytes))
        dealt = base.repartitionByRange(n, *[F.col(k) for k in keys], *order, F.monotonically_increasing_id())
        return dealt.withColumn(CHUNK, F.spark_partition_id())

    return settle(ranged)


def loads(df: DataFrame, task_bytes: int | None = None) -> int:
    """How many times ``task_bytes`` (``TASK_BYTES``) the tables hold that ``df`` reads; a source without a known size counts as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(s for s in sizes if s < 1 << 60)
    return max(1, -(-known // (task_bytes or TASK_BYTES)))


def tasks(df: DataFrame, task_bytes: int | None = None) -> int:
    """Number of tasks for an aggregation or a join of ``df``: by the size of its tables, at least the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), loads(df, task_bytes))


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a result's size; for a written table the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def scan(df: DataFrame, out: str, value: Column, kind: str, order: Sequence[Column],
         keys: Sequence[str] = (), inclusive: bool = True) -> DataFrame:
    """Running 'max', 'sum', 'count' or 'last' (non-null) of ``value`` over ascending ``order``."""
    fn = {"max": F.max, "sum": F.sum, "count": F.count,
          "last": lambda c: F.last(c, ignorenulls=True)}[kind]
    keys = list(keys)
    v = "_scan_value"
    df = df.withColumn(v, value)
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    local = df.withColumn("_local", fn(F.col(v)).over(w))

    if kind == "last":
        ord_struct = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
        total = F.max_by(F.col(v), F.when(F.col(v).isNotNull(), ord_struct))
    else:
        total = fn(F.col(v))
    totals = df.groupBy(*keys, CHUNK).agg(total.alias("_total"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry_fn = F.sum if kind == "count" else fn
    carry = totals.withColumn("_carry", carry_fn(F.col("_total")).over(before)).drop("_total")

    same = F.lit(True)
    for k in [*keys, CHUNK]:
        same = same & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    joined = local.join(carry.select(*[F.col(k).alias(f"_c_{k}") for k in [*keys, CHUNK]], "_carry"), same, "left").drop(
        *[f"_c_{k}" for k in [*keys, CHUNK]])
    a, b = F.col("_local"), F.col("_carry")
    if kind == "max":
        merged = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.when(a >= b, a).otherwise(b))
    elif kind == "last":
        merged = F.coalesce(a, b)
    else:
        merged = F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return joined.withColumn(out, merged).drop("_local", "_carry", v)


def drop_chunks(df: DataFrame) -> DataFrame:
    return df.drop(CHUNK)


def numbered(df: DataFrame, out: str, order: Sequence[Column], keys: Sequence[str] = (), chunks: int | None = None) -> DataFrame:
    """Dense 1-based numbers in ``order`` (per key, or over everything)."""
    c = with_chunks(df, order, keys, chunks)
    return drop_chunks(scan(c, out, F.lit(1), "count", order, keys)).withColumn(out, F.col(out).cast("bigint"))


def ranked(df: DataFrame, out: str, order: Sequence[Column], keys: Sequence[str], top: int | None = None) -> DataFrame:
    """Rank of every row within its key; with ``top`` only the first rows of each key.

    A named ``top`` becomes a group limit in each task before the shuffle; without one the ranks
    come from chunked scans, so a key with very many rows never meets in one task.
    """
    if top is None:
        return numbered(df, out, order, keys)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= top).withColumn(out, F.col(out).cast("bigint"))
