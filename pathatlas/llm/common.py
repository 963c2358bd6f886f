"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS_PER_BATCH = 1000


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under a name, with its SQL where there is one."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def importable(spark: SparkSession) -> None:
    """Python workers that share this machine find the package whatever folder the driver was started in.

    Rows are whole texts, so a batch of Spark's usual 10,000 of them takes far more memory than of plain numbers; unless the
    session has a size of its own, batches get ROWS_PER_BATCH.
    """
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(ROWS_PER_BATCH))
    home, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH", ""), home]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder: later steps survive a lost executor without a second run."""
    return cut_lineage(df)


def per_text(fn: Callable[[str], object], returns: str) -> Callable[[Column], Column]:
    """A column function that applies ``fn`` to each text of an Arrow batch (null reads as the empty text)."""
    @F.pandas_udf(returns)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fn(t or "") for t in texts], dtype=object)
    return run


def part_count(df: DataFrame) -> int:
    """Shuffle partitions of the session, for work that is dealt out without a key."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


WORD_BLOCK = 1 << 20
_WORD_BYTE = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])
_P = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """P**i and its inverse modulo 2**64 for the positions of a block."""
    def run(base: int) -> np.ndarray:
        out = np.full(WORD_BLOCK + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)
    return run(_P), run(pow(_P, -1, 1 << 64))


def words_at(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """32-bit hashes of the words of a text in order, the byte each starts at, and the bytes of the lower-cased text.

    A word is a run of ASCII letters, digits, underscores and non-ASCII characters of the lower-cased text (a run of more
    than 2**20 bytes is cut there). Its hash is a polynomial of its bytes, taken as a difference of running sums, so no step
    runs per word in Python.
    """
    raw = np.frombuffer((text or "").lower().encode("utf-8"), np.uint8)
    power, inverse = _powers()
    out, begun, at = [], [], 0
    while at < len(raw):
        part = raw[at:at + WORD_BLOCK]
        word = _WORD_BYTE[part]
        if at + len(part) < len(raw):
            gaps = np.flatnonzero(~word)
            if len(gaps):
                part, word = part[:gaps[-1] + 1], word[:gaps[-1] + 1]
        edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
        start, end = edges[::2], edges[1::2]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=sums[1:])
        h = (sums[end] - sums[start]) * inverse[start]
        out.append((((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32))
        begun.append(at + start)
        at += len(part)
    if not out:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), raw
    return np.concatenate(out), np.concatenate(begun), raw


def word_hashes(text: str | None) -> np.ndarray:
    """32-bit hashes of the words of a text, in order (see ``words_at``)."""
    return words_at(text)[0]


def pieces(total: np.ndarray, n: int = 16) -> pd.DataFrame:
    """A fixed-size array of a task (its size a multiple of ``n``) as rows (lot, piece, v) that ``added`` sums; tasks that
    follow one another share a lot."""
    at = TaskContext.get()
    lot = at.partitionId() // 32 % LOTS if at else 0
    return pd.DataFrame({"lot": np.int32(lot), "piece": np.arange(n, dtype=np.int32),
                         "v": [p.astype(np.float64).tobytes() for p in np.split(total.reshape(-1), n)]})


LOTS = 256
PIECES = "lot int, piece int, v binary"


def added(df: DataFrame) -> np.ndarray:
    """Sum over all tasks of the arrays they handed out as ``pieces``; empty without tasks.

    The arrays of a lot are added first, piece by piece, then the at most LOTS sums of each piece: no task reads the arrays
    of more than a 256th of the tasks (or of 32).
    """
    def add(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0.0
        for pdf in parts:
            for v in pdf["v"]:
                total = total + np.frombuffer(v, np.float64)
        yield pd.DataFrame({"lot": np.int32(0), "piece": [key[-1]], "v": [total.tobytes()]})

    lots = df.groupBy("lot", "piece").applyInPandas(add, PIECES)
    got = lots.groupBy("piece").applyInPandas(add, PIECES).toPandas().sort_values("piece")
    return np.concatenate([np.frombuffer(v, np.float64) for v in got["v"]]) if len(got) else np.zeros(0)
