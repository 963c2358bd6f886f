"""Ordered ADD/DEL operations on route objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs

OBJECT = ("ip_start", "plen", "origin", "source")


def needs_reload(state_serial: int | None, oldest: int, current: int, max_behind: int | None = None) -> bool:
    """A full reload is due when the journal does not reach back to the state, or by choice when it is far behind."""
    gone = state_serial is None or not (oldest - 1 <= state_serial <= current)
    return gone or (max_behind is not None and current - state_serial > max_behind)


def complete(deltas: DataFrame, first: int, last: int) -> bool:
    """True when every serial of the batch is there: a partial batch must not be committed."""
    r = deltas.agg(F.min("serial").alias("a"), F.max("serial").alias("b"), F.count_distinct("serial").alias("n")).first()
    return r["a"] == first and r["b"] == last and r["n"] == last - first + 1


def irr_delta_apply(state: DataFrame, deltas: DataFrame, keys: Sequence[str] = OBJECT) -> DataFrame:
    """State after the batch: the last operation of each object decides.

    The reduction to one operation per object is a partial aggregate, so an object that
    changes all the time costs one row per task.
    """
    last = deltas.groupBy(*keys).agg(F.max_by("op", "serial").alias("op"))
    kept = state.select(*keys).join(last.select(*keys), list(keys), "left_anti")
    return kept.unionByName(last.where("op = 'ADD'").select(*keys)).distinct()


def versioned(state: DataFrame, serial: int) -> DataFrame:
    """A plain set of objects as a state that knows its serial: (object, serial, op)."""
    return state.select(*OBJECT, F.lit(serial).cast("bigint").alias("serial"), F.lit("ADD").alias("op")).distinct()


def advance(state: DataFrame, deltas: DataFrame) -> DataFrame:
    """State after the batch: per object the operation with the highest serial, deletes included.

    As deleted objects stay as marks, an older operation that comes late changes nothing. One
    partial aggregate over state and batch; an object that changes all the time costs one row per task.
    """
    rows = state.select(*OBJECT, "serial", "op").unionByName(deltas.select(*OBJECT, F.col("serial").cast("bigint").alias("serial"), "op"))
    return rows.groupBy(*OBJECT).agg(F.max("serial").alias("_s"), F.max_by("op", "serial").alias("op")).select(*OBJECT, F.col("_s").alias("serial"), "op")


def live(state: DataFrame) -> DataFrame:
    return state.where("op = 'ADD'").select(*OBJECT)


def irr_delta_counts(state: DataFrame, deltas: DataFrame, keys: Sequence[str] = OBJECT) -> DataFrame:
    """Effective adds and deletes: operations that changed the set when they were applied."""
    keys = list(keys)
    c = runs.with_chunks(deltas, [F.col("serial")], keys)
    c = runs.drop_chunks(runs.scan(c, "_prev", F.col("op"), "last", [F.col("serial")], keys, inclusive=False))
    had = state.select(*keys).distinct().withColumn("_had", F.lit(True))
    before = F.coalesce(F.col("_prev") == "ADD", F.col("_had"), F.lit(False))
    d = c.join(had, keys, "left").withColumn("_in", before)
    return d.agg(F.count_if((F.col("op") == "ADD") & ~F.col("_in")).alias("added"), F.count_if((F.col("op") == "DEL") & F.col("_in")).alias("deleted"))
