"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased and cut into overlapping n-grams of code points, hashed to 2^20 buckets and taken once per text. From a
bounded sample of labelled rows (``max_rows`` of each class, chosen by hash) the ratio r = log((p / |p|) / (q / |q|)) of every
bucket is counted in Spark tasks; the buckets whose ratio stands out most from its counting error become features, with value
r where present. A logistic regression over them is trained in numpy; its intercept is moved from the sample's share of toxic
rows to that of all labelled rows. Scoring reads every whole text once, in blocks, and needs only the fixed-size weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import query, saved, table

BITS = 20
SIZES = (3, 4, 5)
BLOCK = 1 << 20


def buckets(text: str, keep: np.ndarray | None = None, sizes: tuple[int, ...] = SIZES, bits: int = BITS) -> np.ndarray:
    """Sorted distinct buckets of all n-grams of the text padded with blanks; with ``keep`` only those it marks."""
    points = np.frombuffer(" ".join(("", *text.lower().split(), "")).encode("utf-32-le"), np.uint32)
    found = []
    for at in range(0, max(1, len(points)), BLOCK):
        part = points[at:at + BLOCK + max(sizes) - 1]
        h = np.zeros(len(part), np.uint32)
        for n in range(1, max(sizes) + 1):
            if len(part) < n:
                break
            h = h[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1:]
            if n in sizes:
                b = ((h ^ np.uint32(n << 24)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
                found.append(np.unique(b[keep[b]] if keep is not None else b))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


@dataclass
class Model:
    """``weight`` per bucket (already times r), ``keep`` marks the features; without features the score is the prior."""
    weight: np.ndarray
    keep: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        z = self.bias + float(self.weight[buckets(text, self.keep)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def log_count_ratios(pos: np.ndarray, neg: np.ndarray, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Naive Bayes log-count ratio of each bucket and how many standard errors it is from zero."""
    p, q = alpha + pos, alpha + neg
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    return r, np.abs(r) / np.sqrt(1 / p + 1 / q)


def logistic(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, width: int, l2: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept of a sparse logistic regression by Adam on all rows; classes weigh the same."""
    w, b = np.zeros(width), 0.0
    cost = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        z = np.bincount(rows, vals * w[cols], len(y)) + b
        g = cost * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        grad = np.append(np.bincount(cols, vals * g[rows], width) + l2 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_rows: int = 6000, features: int = 1024, l2: float = 1e-3) -> Model:
    """Model from the labelled rows of ``docs``.

    Labels other than 0 and 1, and null ids, are no labels; an id with both labels counts for both. If either class is
    missing, there are no features and the score is the share of toxic labels (0 without labels).
    """
    marks = saved(labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
                  .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1)).distinct())
    share = {r["_y"]: r["n"] for r in marks.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = share.get(1, 0), share.get(0, 0)
    none = Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, bool), float(np.log(n1 / n0)) if n1 and n0 else (50.0 if n1 else -50.0))
    if not (n1 and n0):
        return none
    order = F.xxhash64("_id")
    ids = marks.where("_y = 1").orderBy(order).limit(max_rows).union(marks.where("_y = 0").orderBy(order).limit(max_rows))
    # at most 2 * max_rows rows of two numbers
    rows = saved(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(ids), "_id")
                 .select("_y", "_text").repartition(8))

    def count(batches):
        seen = np.zeros((2, 1 << BITS), np.uint16)
        for pdf in batches:
            for y, t in zip(pdf["_y"], pdf["_text"], strict=True):
                seen[y, buckets(t or "")] += 1
        yield pd.DataFrame({"neg": [seen[0].tobytes()], "pos": [seen[1].tobytes()]})

    neg, pos = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r in rows.mapInPandas(count, "neg binary, pos binary").toLocalIterator():  # at most 8 rows of fixed size
        neg += np.frombuffer(r["neg"], np.uint16)
        pos += np.frombuffer(r["pos"], np.uint16)
    ratio, sure = log_count_ratios(pos, neg)
    sure[pos + neg < 3] = 0
    chosen = np.argsort(-sure, kind="stable")[:features]
    chosen = np.sort(chosen[sure[chosen] > 3])
    if not len(chosen):
        return none
    keep = np.zeros(1 << BITS, bool)
    keep[chosen] = True

    def cut(batches):
        for pdf in batches:
            yield pd.DataFrame({"y": pdf["_y"], "f": [np.searchsorted(chosen, buckets(t or "", keep)).astype(np.int16).tobytes() for t in pdf["_text"]]})

    got = rows.mapInPandas(cut, "y int, f binary").toPandas()  # at most 2 * max_rows rows of at most ``features`` numbers
    lists = [np.frombuffer(f, np.int16).astype(np.int64) for f in got["f"]]
    cols = np.concatenate(lists)
    at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    w, b = logistic(at, cols, ratio[chosen][cols], got["y"].to_numpy(np.float64), len(chosen), l2)
    weight = np.zeros(1 << BITS, np.float32)
    weight[chosen] = w * ratio[chosen]
    return Model(weight, keep, float(b + np.log(n1 / n0)))


def scorer(spark, model: Model):
    """Column function text -> probability; null reads as the empty text. The model has a fixed size of 5 MB."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(t or "") for t in texts], dtype=float)
    return score


def held_out(doc_id):
    """Rows that never train: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(spark, sf_dir: str, docs: DataFrame) -> Model:
    return fit(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``.

    Null and empty texts get the score of a text without n-grams; repeated rows and null ids keep a row each (a null id is
    not held out); an empty table gives an empty result; other columns are not read.
    """
    score = scorer(docs.sparkSession, model)
    out = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op2_toxicity")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, train(spark, sf_dir, docs))
