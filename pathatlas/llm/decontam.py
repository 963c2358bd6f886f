"""Benchmark decontamination by latent semantic retrieval, then subsequence and answer checks.

Words are hashed once to 32 bits and kept as bytes. Passages of 256 words are TF-IDF rows over 4096 hashed features. One
pass of all passages gives W = A'A G for a Gaussian G (per task a fixed-size sum, added up in Spark); the Nystrom form of the
randomised SVD turns W into right singular vectors and values of A. In their whitened space every window of 32 words, taken
each 16 words of every whole text, is compared by cosine with all items; candidates are verified on the words around the
window: the longest common subsequence with the item, and with its answer (its last quarter), each as a share of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PIECES, added, per_text, pieces, query, saved, table, word_hashes

FEATURES = 4096
PASSAGE = 256
RANK, OVERSAMPLE = 96, 32
BLOCK = 16  # a window is two neighbouring blocks
CLOSE = 0.6  # a candidate has at least this share of the cosine that an exact occurrence is expected to have
SURE, LIKELY, ANSWER = 0.8, 0.6, 0.8  # shares of an item's words in order; of its answer's words in order
SHORT = 8  # items of fewer words must occur as they are
ITEMS = 20_000  # items of one search pass, which bounds what is broadcast


def hashed_words(text: Column) -> Column:
    """Column of the word hashes of a text as bytes."""
    return per_text(lambda t: word_hashes(t).tobytes(), "binary")(text)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    """Blocks of passage rows (at most 512) with the counts of all features."""
    held, size = [], 0
    for pdf in batches:
        for raw in pdf["words"]:
            f = np.frombuffer(raw, np.uint32) & (FEATURES - 1)
            for at in range(0, len(f), PASSAGE):
                held.append(f[at:at + PASSAGE])
                if len(held) == 512:
                    yield _matrix(held)
                    held = []
    if held:
        yield _matrix(held)


def _matrix(passages: list[np.ndarray]) -> np.ndarray:
    rows = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
    flat = np.bincount(rows * FEATURES + np.concatenate(passages), minlength=len(passages) * FEATURES)
    return flat.reshape(len(passages), FEATURES).astype(np.float32)


@dataclass
class Space:
    """``vectors`` maps a feature to its whitened latent coordinates times idf (float32, FEATURES x RANK)."""
    vectors: np.ndarray

    def of(self, words: np.ndarray) -> np.ndarray:
        v = self.vectors[words & (FEATURES - 1)].sum(axis=0)
        return v / max(1e-12, float(np.linalg.norm(v)))


def fit(words: DataFrame, seed: int = 7) -> Space:
    """Latent space of all passages of ``words`` (column ``words``: hashes as bytes). Without words it is empty (zeros)."""
    def frequencies(batches):
        total = np.zeros(FEATURES + 16)
        for m in _counts(batches):
            total[:FEATURES] += (m > 0).sum(axis=0)
            total[FEATURES] += len(m)
        yield pieces(total)

    df = added(words.mapInPandas(frequencies, PIECES))
    passages = df[FEATURES] if len(df) else 0
    if not passages:
        return Space(np.zeros((FEATURES, RANK), np.float32))
    idf = np.log((1 + passages) / (1 + df[:FEATURES])).astype(np.float32)
    width = RANK + OVERSAMPLE
    gauss = np.random.default_rng(seed).standard_normal((FEATURES, width)).astype(np.float32)

    def sketch(batches):
        total = np.zeros((FEATURES, width))
        for m in _counts(batches):
            m *= idf
            m /= np.maximum(1e-12, np.linalg.norm(m, axis=1))[:, None]
            total += m.T @ (m @ gauss)
        yield pieces(total)

    w = added(words.mapInPandas(sketch, PIECES)).reshape(FEATURES, width)
    core = gauss.T.astype(np.float64) @ w
    val, vec = np.linalg.eigh((core + core.T) / 2)
    ok = val > val.max() * 1e-10
    u, s, _ = np.linalg.svd(w @ (vec[:, ok] / np.sqrt(val[ok])), full_matrices=False)
    k = min(RANK, int((s > s[0] * 1e-6).sum()))
    vectors = np.zeros((FEATURES, RANK))
    vectors[:, :k] = u[:, :k] / s[:k] * idf[:, None]
    return Space(vectors.astype(np.float32))


def lcs(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence with a sequence of ``size`` words, whose positions are bits in ``masks``."""
    full = state = (1 << size) - 1
    for w in words:
        hit = state & masks.get(w, 0)
        if hit:
            state = ((state + hit) | (state - hit)) & full
    return size - state.bit_count()


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Finder:
    """Matches of items in texts given as word hashes."""

    def __init__(self, space: Space, items: list[tuple[int, str]]):
        self.items = [(i, word_hashes(t)) for i, t in items]
        self.items = [(i, w) for i, w in self.items if len(w)]
        self.table = np.vstack([space.vectors, np.zeros((1, space.vectors.shape[1]), np.float32)])
        self.long = [(i, w, _masks(w), _masks(w[len(w) - self.answer_size(w):])) for i, w in self.items if len(w) >= SHORT]
        self.short = [(i, w) for i, w in self.items if len(w) < SHORT]
        self.least = CLOSE * np.array([self.expected(len(w)) for _, w, _, _ in self.long], np.float32)
        self.q = np.array([space.of(w) for _, w, _, _ in self.long], np.float32).reshape(len(self.long), space.vectors.shape[1])

    @staticmethod
    def expected(m: int) -> float:
        """Cosine of an item of ``m`` words with the window that holds most of it, if other words are unrelated."""
        width = 2 * BLOCK
        return min((m / width) ** 0.5, (width / m) ** 0.5, 0.75)

    @staticmethod
    def answer_size(words: np.ndarray) -> int:
        return max(3, len(words) // 4)

    def windows(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, unit vector) of all windows of some texts."""
        counts = np.array([-(-len(t) // BLOCK) for t in texts])
        owner = np.repeat(np.arange(len(texts)), counts)
        first = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        feats = np.full(len(owner) * BLOCK, FEATURES, np.int64)
        at = 0
        for t, n in zip(texts, counts, strict=True):
            feats[at:at + len(t)] = t & (FEATURES - 1)
            at += n * BLOCK
        blocks = np.empty((len(owner), self.table.shape[1]), np.float32)
        for i in range(0, len(owner), 2048):
            part = self.table[feats[i * BLOCK:(i + 2048) * BLOCK]]
            blocks[i:i + 2048] = part.reshape(-1, BLOCK, part.shape[1]).sum(axis=1)
        blocks[:-1] += np.where((owner[:-1] == owner[1:])[:, None], blocks[1:], 0)
        blocks /= np.maximum(1e-12, np.linalg.norm(blocks, axis=1))[:, None]
        return owner, first * BLOCK, blocks

    def candidates(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, float]]:
        """(text, first word, long item, cosine) of every window and item that may be an occurrence."""
        if not self.long:
            return
        owner, first, vectors = self.windows(texts)
        for i in range(0, len(owner), 4096):
            for j in range(0, len(self.q), 4096):
                cos = vectors[i:i + 4096] @ self.q[j:j + 4096].T
                for a, b in zip(*np.nonzero(cos >= self.least[j:j + 4096]), strict=True):
                    yield int(owner[i + a]), int(first[i + a]), int(j + b), float(cos[a, b])

    @staticmethod
    def occurs(share: float, answer: float) -> bool:
        return share >= SURE or (share >= LIKELY and answer >= ANSWER)

    def verify(self, words: np.ndarray, start: int, item: int) -> tuple[float, float]:
        """Shares of the item's and of its answer's words that the text around a window holds in order.

        They are the best over stretches of a quarter more words than the item has, each begun an eighth of it later, if
        the whole neighbourhood holds enough at all; so words strewn over a longer text do not add up. A stretch that is
        an occurrence goes before all that are none, however much of the item those hold.
        """
        _, own, masks, answer = self.long[item]
        m, n = len(own), self.answer_size(own)
        near = words[max(0, start - m):start + 2 * BLOCK + m].tolist()
        best = (lcs(masks, m, near) / m, 0.0)
        if best[0] < LIKELY:
            return best
        width, step = m + m // 4, max(1, m // 8)
        stretches = [near[i:i + width] for i in range(0, max(1, len(near) - width + step), step)]
        return max(((lcs(masks, m, s) / m, lcs(answer, n, s) / n) for s in stretches), key=lambda x: (self.occurs(*x), x))

    def find(self, texts: list[np.ndarray]) -> list[dict[int, tuple[float, float, float]]]:
        """For each text the items it holds: item id -> (cosine, share of the item, share of the answer)."""
        out: list[dict] = [{} for _ in texts]
        for t, start, item, cos in self.candidates(texts):
            got = (cos, *self.verify(texts[t], start, item))
            if self.occurs(*got[1:]):
                key = self.long[item][0]
                out[t][key] = max(out[t].get(key, (0.0, 0.0, 0.0)), got, key=lambda x: (x[1], x[2], x[0]))
        for t, words in enumerate(texts):
            for key, own in self.short:
                n = len(words) - len(own) + 1
                if n > 0 and np.logical_and.reduce([words[k:n + k] == own[k] for k in range(len(own))]).any():
                    out[t][key] = (1.0, 1.0, 1.0)
        return out

    def stream(self, rows: Iterator[np.ndarray]) -> Iterator[dict[int, tuple[float, float, float]]]:
        """``find`` for many texts, about 100,000 words at a time."""
        held, size = [], 0
        for words in rows:
            held.append(words)
            size += len(words)
            if size > 100_000 or len(held) >= 4096:
                yield from self.find(held)
                held, size = [], 0
        if held:
            yield from self.find(held)


def item_slices(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The items in slices of at most ITEMS rows; null ids and texts without words name nothing to look for."""
    held: list[tuple[int, str]] = []
    for r in benchmark.select(id_col, text_col).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).toLocalIterator():
        held.append((r[0], r[1]))
        if len(held) == ITEMS:
            yield held
            held = []
    if held:
        yield held


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, item_share, answer_share): one row for each document id and item that it holds.

    Repeated rows and ids give one row with the best values. Null and empty texts hold nothing, and neither does an empty
    table; a null id is reported as null. Items of fewer than SHORT words are looked for as exact runs of words. Other
    columns are not read.
    """
    spark = docs.sparkSession
    words = saved(docs.select(F.col(id_col).alias("doc_id"), hashed_words(F.col(text_col)).alias("words")))
    space, parts = fit(words.select("words")), []
    for items in item_slices(benchmark):
        shared = spark.sparkContext.broadcast((space, items))

        def search(batches, shared=shared):
            finder = Finder(*shared.value)
            for pdf in batches:
                out = []
                for doc, found in zip(pdf["doc_id"].astype("Int64"), finder.stream(np.frombuffer(w, np.uint32) for w in pdf["words"]), strict=True):
                    out += [(doc, item, *got) for item, got in found.items()]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "cosine", "item_share", "answer_share"]).astype({"doc_id": "Int64"})

        parts.append(words.mapInPandas(search, "doc_id long, item_id long, cosine double, item_share double, answer_share double"))
    if not parts:
        return spark.createDataFrame([], "doc_id long, item_id long, cosine double, item_share double, answer_share double")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    best = F.max(F.struct("item_share", "answer_share", "cosine")).alias("_best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "_best.cosine", "_best.item_share", "_best.answer_share")


def holds_item(shared):
    """Column function text -> whether it holds an item of the broadcast (space, items)."""
    @F.pandas_udf("boolean")
    def leaked(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(*shared.value)
        for t in texts:
            yield pd.Series([bool(x) for x in finder.stream(map(word_hashes, t))], dtype=bool)
    return leaked


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; null and empty texts stay."""
    spark: SparkSession = docs.sparkSession
    words = saved(docs.select(hashed_words(F.col(text_col)).alias("words")))
    space, out = fit(words), docs
    for items in item_slices(benchmark):
        out = out.where(~holds_item(spark.sparkContext.broadcast((space, items)))(F.col(text_col)))
    return out


@query("op4_decontamination")
def op4(spark, sf_dir):
    return matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
