"""Importance resampling towards a target distribution over hashed word n-grams.

Each feature (a run of 1 to ``ORDER`` consecutive words) falls into a bucket by its CRC-32. The buckets of a text are found
without a step per feature in Python. CRC-32 is linear but for a constant of the length, so the CRC of a span is the XOR
of one table entry for each byte, chosen by the byte and its distance from the span's end, and of the length's constant. The
entries of all spans are gathered at once and folded by ``bitwise_xor.reduceat``. Spans longer than the table are cut into
blocks that end where the table ends; the blocks' sums are shifted by tables for 1, 2, 4, ... blocks and folded in pairs.

A bucket's gain is the log ratio of its smoothed shares in target and corpus, a document's weight the mean gain of its features.
Gumbel noise from the document's id turns the weights into a draw without replacement: the highest scores are drawn.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.runs import numbered
from .common import query, saved, table

BUCKETS = 10_000
ORDER = 2  # words of the longest feature
LEAST_WORDS = 20
SHARE = 25  # per cent of the documents of at least LEAST_WORDS words
DEPTH = 64  # bytes from a span's end that the position table covers
CHUNK = 1 << 18  # bytes of texts, or of spans, that are handled at once

_WORD = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def _through(image: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit values, given by its values ``image`` [byte of the value, its content]."""
    v = values.astype(np.int64)
    return image[0][v & 255] ^ image[1][v >> 8 & 255] ^ image[2][v >> 16 & 255] ^ image[3][v >> 24]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The contribution [distance from the end, byte] and the map that moves a sum DEPTH bytes further from the end."""
    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    place = np.empty((DEPTH, 256), np.uint32)
    place[0] = step
    for i in range(1, DEPTH):
        place[i] = place[i - 1] >> np.uint32(8) ^ step[place[i - 1] & np.uint32(255)]
    image = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    for _ in range(DEPTH):
        image = image >> np.uint32(8) ^ step[image & np.uint32(255)]
    return place, image


@lru_cache(maxsize=1)
def _constants() -> np.ndarray:
    """CRC-32 of 0, 1, 2, ... zero bytes."""
    out = np.zeros(4 * DEPTH, np.uint32)
    for n in range(1, len(out)):
        out[n] = zlib.crc32(b"\0", int(out[n - 1]))
    return out


def _of_zeros(lengths: np.ndarray) -> np.ndarray:
    known = _constants()
    out = known[np.minimum(lengths, len(known) - 1)]
    for i in np.flatnonzero(lengths >= len(known)):
        whole, rest = divmod(int(lengths[i]), CHUNK)
        crc, block = 0, bytes(CHUNK)
        for _ in range(whole):
            crc = zlib.crc32(block, crc)
        out[i] = zlib.crc32(block[:rest], crc)
    return out


def crc_of_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of ``raw[start:end]`` for every span; memory is bounded by the spans' number and CHUNK, not by their bytes."""
    place, image = _tables()
    sizes = end - start
    blocks = np.maximum(1, -(-sizes // DEPTH))
    first = np.cumsum(blocks) - blocks
    back = np.arange(blocks.sum()) - np.repeat(first, blocks)  # blocks from the span's end
    hi = np.repeat(end, blocks) - back * DEPTH
    lo = np.maximum(hi - DEPTH, np.repeat(start, blocks))
    sums, size = np.zeros(len(lo), np.uint32), hi - lo
    ends = np.cumsum(size)
    at = 0
    while at < len(lo):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
        n = size[at:to]
        filled = np.flatnonzero(n)
        if len(filled):
            n = n[filled]
            begun = np.cumsum(n) - n
            inside = np.arange(n.sum()) - np.repeat(begun, n)
            part = place[np.repeat(n, n) - 1 - inside, raw[np.repeat(lo[at:to][filled], n) + inside]]
            sums[at + filled] = np.bitwise_xor.reduceat(part, begun)
        at = to
    out = sums[first]
    many = np.flatnonzero(blocks > 1)
    if len(many):
        rows = np.repeat(np.arange(len(many)), blocks[many])  # block sums of the long spans, nearest to the end first
        held = sums[np.repeat(first[many], blocks[many]) + np.arange(len(rows)) - np.repeat(np.cumsum(blocks[many]) - blocks[many], blocks[many])]
        while len(rows) > len(many):
            begun = np.flatnonzero(np.diff(rows, prepend=-1))
            nth = np.arange(len(rows)) - np.repeat(begun, np.diff(np.append(begun, len(rows))))
            odd = np.flatnonzero(nth % 2)
            held[odd - 1] ^= _through(image, held[odd])
            rows, held = np.delete(rows, odd), np.delete(held, odd)
            image = _through(image, image)  # two steps of this level are one of the next
        out[many] = held
    return out ^ _of_zeros(sizes)


def _features(texts: list[bytes], order: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts that are handled together: the text and the bucket of every feature, and the number of words per text."""
    raw = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]  # a line feed belongs to no word
    word = _WORD[raw]
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edges[::2], edges[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(ends, start, side="right")
    word[end] = True  # one sign after each word stays, as the space
    raw[end] = 0x20
    moved = np.cumsum(word) - word
    raw, start, end = raw[word], moved[start], moved[end]
    at, crcs = [], []
    for n in range(order):
        whole = np.flatnonzero(owner[: len(owner) - n] == owner[n:])  # features do not cross texts
        at.append(owner[whole])
        crcs.append(crc_of_spans(raw, start[whole], end[whole + n]))
    return np.concatenate(at), np.concatenate(crcs).astype(np.int64) % count, np.bincount(owner, minlength=len(texts))


def buckets(texts, order: int = ORDER, count: int = BUCKETS):
    """For each text the buckets of all its features, repeats included, and its number of words.

    A word is a run of ASCII digits, letters (A-Z lower-cased) and bytes of other characters; a feature's words are
    joined by one space. A null text has no words. Texts are handled in groups of about CHUNK bytes.
    """
    def told(held):
        at, bucket, words = _features(held, order, count)
        bucket = bucket[np.argsort(at, kind="stable")]
        return zip(np.split(bucket, np.cumsum(np.bincount(at, minlength=len(held)))[:-1]), words.tolist(), strict=True)

    held, size = [], 0
    for text in texts:
        held.append((text or "").encode("utf-8"))
        size += len(held[-1])
        if size > CHUNK:
            yield from told(held)
            held, size = [], 0
    if held:
        yield from told(held)


def bucket_counts(texts: DataFrame, text_col: str = "text", order: int = ORDER, count: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket. Each task counts for itself; the sums meet by bucket, so no key is hot."""
    def tally(batches):
        total = np.zeros(count, np.int64)
        for pdf in batches:
            for at, _ in buckets(pdf["_text"], order, count):
                np.add.at(total, at, 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    rows = texts.select(F.col(text_col).alias("_text")).mapInPandas(tally, "bucket long, n long")
    got = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most ``count`` rows
    out = np.zeros(count, np.int64)
    out[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the ratio of smoothed shares, for each bucket."""
    s, t, n = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(id, n_words, n_features, weight) per row; ``gain`` is a fixed-size array."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weigh(texts: pd.Series) -> pd.DataFrame:
        g, rows = shared.value, []
        for at, words in buckets(texts, order, len(g)):
            rows.append((words, len(at), int(g[at].sum()) // len(at) if len(at) else 0))
        return pd.DataFrame(rows, columns=["n_words", "n_features", "weight"])
    return docs.select(F.col(id_col).alias("id"), weigh(F.col(text_col)).alias("_w")).select("id", "_w.*")


def gumbel(id_col, seed: int = 7):
    """floor(1000 * Gumbel noise) from the first 32 bits of the SHA-256 of ``seed:id``; a null id reads as the empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
             share: int = SHARE, least_words: int = LEAST_WORDS, count: int = BUCKETS, order: int = ORDER, seed: int = 7) -> DataFrame:
    """(id, n_features, weight, score, rank) per row of ``docs``; rank is null where the row is not drawn.

    Of the N rows with at least ``least_words`` words, floor(share * N / 100) are drawn: the highest scores, ties by the
    smaller id (null ids last). Null and empty texts have no features and weight 0. Repeated rows keep a row each, have the same
    score and may both be drawn. Empty tables give empty results; an empty target leaves the corpus counts alone to decide. Other
    columns are not read. Ranks come from range partitions with carried counts, so neither the order nor ties meet in one task.
    """
    gain = gains(bucket_counts(docs, text_col, order, count), bucket_counts(target, target_text_col, order, count))
    rows = weighed(docs, gain, id_col, text_col, order).withColumn("score", (F.col("weight") + gumbel(F.col("id"), seed)).cast("long"))
    rows = saved(rows)
    able = rows.where(F.col("n_words") >= least_words)
    draw = share * able.count() // 100
    ranked = numbered(able, "rank", [F.col("score").desc(), F.isnull("id"), F.col("id")])
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("id", "n_features", "weight", "score", "rank")


_SQL = r"""
WITH RECURSIVE crc_step(k, i, c) AS (
  SELECT k, 0, k FROM range(256) r(k)
  UNION ALL SELECT k, i + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc_step WHERE i < 8
), crc_table AS (SELECT list(c ORDER BY k) AS crc FROM crc_step WHERE i = 8),
texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), words AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), features AS (
  SELECT side, id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS f FROM words
), used AS (SELECT side, id, f, count(*) AS n FROM features GROUP BY ALL
), named AS (SELECT DISTINCT f, hex(encode(f)) AS h FROM used
), crcs AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(h, 2 * i - 1, 2))::BIGINT for i in range(1, len(h) // 2 + 1)]),
                            lambda a, b: xor(a // 256, crc[xor(a % 256, b) + 1])), 4294967295) % 10000 AS bucket
  FROM named, crc_table
), sums AS (
  SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM used JOIN crcs USING (f) GROUP BY bucket
), totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS ss, coalesce(sum(t), 0)::DOUBLE AS tt FROM sums
), gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (ss + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (tt + 10000))))::BIGINT AS g FROM sums, totals
), weights AS (
  SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight
  FROM used JOIN crcs USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS (
  SELECT w.id AS doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words w LEFT JOIN weights ON weights.id = w.id WHERE side = 'd'
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS r, 25 * count(*) OVER (PARTITION BY able) // 100 AS draw FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= draw THEN r END AS rank FROM placed
"""


@query("op11_resample", _SQL)
def op11(spark, sf_dir):
    found = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")
