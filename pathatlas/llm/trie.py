"""Prefix trie of conversations: what each shared beginning would save if it were processed once.

A conversation is the sequence of its turns' digests. Equal sequences become one row with a count, so copies cost nothing
further. The distinct sequences are dealt into shards by ranges of their order; the ranges' bounds are sequences of the table,
chosen by hash. A shard is a matrix of turn ids, padded, in column blocks: lexsort orders it, OR-accumulated masks of column
changes mark where nodes start, and reduceat sums every depth over the rows of each node.

A node that reaches over a shard's end is a prefix of the bound there, so every shard knows such nodes by itself. All values of
a node are sums of what shards hold, as long as a node's own share is counted in its last shard only. So the parts of boundary
nodes, one for each shard they touch, recombine by a plain sum; all other nodes are whole already.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import query, saved, table

WIDTH = 32  # columns of a block of the padded matrix
SHARD = 2048  # sequences a shard holds on average, at least
SHARDS = 16_384  # shards from which they grow instead of becoming more
IDS = 512  # conversation ids whose digits are joined in one row
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) with the array of a conversation's turns (turn, a, b, w): 120 bits of a digest of role and text,
    and the words of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role), F.lit(":"), role, text).cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long").alias("ab"[at > 1])
    words = F.expr(r"regexp_count(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')").alias("w")
    one = F.struct(F.col("turn"), half(1), half(16), words)
    return turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))


def rebuilt(convs: DataFrame, step: int = 20, modulus: int = 4) -> DataFrame:
    """(conv_id, seq, words): the first h turns of conversation c - c % step, then c's own turns after its first h.

    ``seq`` holds two numbers per turn. h is the CRC-32 of c's decimal digits modulo ``modulus``.
    """
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % modulus).cast("int")
    base = convs.where(c % step == 0).select(c.alias("_base"), F.slice("turns", 1, modulus - 1).alias("_head"))
    both = convs.withColumn("_h", h).join(base, c - c % step == F.col("_base"), "left")
    head = F.slice(F.coalesce("_head", F.slice("turns", 1, 0)), F.lit(1), F.col("_h"))
    all_turns = F.concat(head, F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0))))
    return both.select(c, all_turns.alias("_t")).select(
        c, F.flatten(F.transform("_t", lambda t: F.array(t["a"], t["b"]))).alias("seq"), F.transform("_t", lambda t: t["w"]).alias("words"))


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """(seq, words, n, lo, ends) per distinct sequence: how many conversations, the smallest id, and the SHA-256 of all ids.

    The ids are joined in blocks before they meet, and the blocks stream through the digest in order: a sequence of very many
    conversations is never held as a whole.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    blocks = convs.groupBy("seq", "words", F.floor(F.col("conv_id") / IDS).alias("block")).agg(
        F.count("*").alias("n"), F.min("conv_id").alias("lo"), ids.alias("ids"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, row, sha = None, None, None
        for pdf in batches:
            out = []
            for seq, words, n, lo, text in zip(pdf["seq"], pdf["words"], pdf["n"], pdf["lo"], pdf["ids"], strict=True):
                key = np.asarray(seq, np.int64).tobytes()
                if key != now:
                    if row is not None:
                        out.append((*row, sha.hexdigest()))
                    now, row, sha = key, [seq, words, 0, lo], hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(text.encode())
                row[2] += n
                row[3] = min(row[3], lo)
            if out:
                yield pd.DataFrame(out, columns=["seq", "words", "n", "lo", "ends"])
        if row is not None:
            yield pd.DataFrame([(*row, sha.hexdigest())], columns=["seq", "words", "n", "lo", "ends"])

    ordered = blocks.repartition("seq").sortWithinPartitions("seq", "block")
    return ordered.mapInPandas(digest, "seq array<long>, words array<int>, n long, lo long, ends string")


def prefix_keys(seq: tuple[int, ...]) -> list[bytes]:
    """A digest of each prefix of a sequence, the empty one first."""
    sha, out = hashlib.md5(), []
    for i in range(0, len(seq) + 2, 2):
        out.append(sha.digest())
        sha.update(np.array(seq[i:i + 2], np.int64).tobytes())
    return out


def _turn_ids(seqs: list[np.ndarray], extra: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Dense turn ids from 1 for the joined sequences and for each of ``extra``."""
    flat = np.concatenate([*seqs, *extra, np.zeros(0, np.int64)]).astype(np.int64).reshape(-1, 2)
    order = np.lexsort((flat[:, 1], flat[:, 0]))
    new = (flat[order][1:] != flat[order][:-1]).any(axis=1)
    ids = np.empty(len(flat), np.int64)
    ids[order] = np.concatenate([[0], np.cumsum(new)])[: len(flat)] + 1
    cut = np.cumsum([sum(map(len, seqs)) // 2, *[len(e) // 2 for e in extra]])
    return ids[: cut[0]], [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


class _Block:
    """Sorted rows of WIDTH columns: positions in the shard's order, padded ids, start masks, shared columns with the bounds."""

    def __init__(self, at: np.ndarray, start: np.ndarray, near: list[np.ndarray]):
        self.at, self.start, self.near = at, start, near


def _sorted_blocks(ids: np.ndarray, sizes: np.ndarray, bounds: list[np.ndarray]) -> tuple[np.ndarray, list[_Block]]:
    """The order of the rows and the blocks of all columns. A block holds only the rows that reach it."""
    first = np.cumsum(sizes) - sizes
    order, blocks = np.arange(len(sizes)), []
    group = np.zeros(len(sizes), np.int64)  # of the row at each position: the node it stands in before the block
    alike = [np.ones(len(sizes), bool) for _ in bounds]
    for base in range(0, int(sizes.max(initial=0)), WIDTH):
        at = np.flatnonzero(sizes[order] > base)
        rows = order[at]
        width = min(WIDTH, int(sizes[rows].max()) - base)
        inside = base + np.arange(width)
        cells = np.zeros((len(rows), width), np.int64)
        filled = inside < sizes[rows][:, None]
        cells[filled] = ids[(first[rows][:, None] + inside)[filled]]
        by = np.lexsort((*cells.T[::-1], group[at]))
        cells, order[at] = cells[by], rows[by]
        change = np.ones(cells.shape, bool)
        moved = group[at][1:] != group[at][:-1]
        change[1:] = np.logical_or.accumulate((cells[1:] != cells[:-1]) | moved[:, None], axis=1)
        near = []
        for b, same in zip(bounds, alike, strict=True):
            there = np.zeros(width, np.int64)
            there[: max(0, min(width, len(b) - base))] = b[base:base + width]
            near.append(np.logical_and.accumulate((cells == there) & (there > 0), axis=1) & same[at][by][:, None])
            same[at] = near[-1][:, -1]
        blocks.append(_Block(at, change & (cells > 0), near))
        group[at] = np.cumsum(change[:, -1])
    return order, blocks


def shard_nodes(seqs: list, words: list, n: np.ndarray, lo: np.ndarray, ends: list, left: tuple | None, right: tuple | None) -> pd.DataFrame:
    """All nodes of the distinct sequences of a shard that begins at ``left`` and ends before ``right`` (None: at the ends).

    A node at the shard's edge has a ``key``, a node below such one a ``parent_key``; their values are the shard's shares.
    """
    bounds = [np.array(b or (), np.int64) for b in (left, right)]
    ids, bounds_ids = _turn_ids([np.asarray(s, np.int64) for s in seqs], bounds)
    sizes = np.array([len(s) // 2 for s in seqs], np.int64)
    order, blocks = _sorted_blocks(ids, sizes, bounds_ids)
    first = (np.cumsum(sizes) - sizes)[order]
    flat = np.concatenate([np.asarray(w, np.int64) for w in words] or [np.zeros(0, np.int64)])
    sizes, n, lo = sizes[order], n[order], lo[order]
    ends = np.array(ends, object)[order]
    keys = [prefix_keys(tuple(b.tolist())) for b in bounds]

    cost = np.zeros(len(sizes), np.int64)  # words of the rows from the depth on, less those of the nodes that end in the shard
    begins = np.zeros(len(sizes), np.int64)  # nodes of the next depth that begin at the position and end in the shard
    leaf = np.ones(len(sizes), np.int64)
    out, below = [], None
    for depth in range(int(sizes.max(initial=0)), -1, -1):
        if depth:
            block, col = blocks[(depth - 1) // WIDTH], (depth - 1) % WIDTH
            reach = sizes[block.at] >= depth
            at = block.at[reach]
            start = np.flatnonzero(block.start[reach, col])
            at_left, at_right = (near[reach, col][start] for near in block.near)
            w = flat[first[at] + depth - 1]
            cost[at] += n[at] * w
        else:
            at, start = np.arange(len(sizes)), np.zeros(1, np.int64)
            at_left, at_right = np.array([left is not None]), np.array([right is not None])
            w = np.zeros(len(sizes), np.int64)
        top = at[start]
        own = ~at_right
        ended = sizes[top] == depth
        rows = np.diff(np.append(start, len(at)))
        cost[top[own]] -= w[start[own]]
        leaf[top[ended & ((rows > 1) | at_right)]] = 0
        total = {name: np.add.reduceat(v[at], start) for name, v in
                 (("n_convs", n), ("n_children", begins), ("n_leaves", leaf), ("saved_tokens", cost))}
        key = np.full(len(top), None, object)
        for near, k in zip((at_right, at_left), (keys[1], keys[0]), strict=True):
            if near.any():
                key[near] = k[depth]
        if depth == 0:
            key[0] = keys[0][0]
        least = np.minimum.reduceat(lo[at], start)
        if below is not None:  # tells the nodes of the next depth their parent
            over = np.searchsorted(top, below["_at"], side="right") - 1
            below["parent_conv_id"] = pd.array([None if k is not None else c for k, c in zip(key[over], least[over].tolist(), strict=True)], "Int64")
            below["parent_key"] = key[over]
            out.append(below)
        below = pd.DataFrame({"depth": depth, "conv_id": least, **total, "ends": np.where(ended, ends[top], None), "key": key, "_at": top})
        begins[:] = 0
        begins[top[own]] = 1
    below["parent_conv_id"], below["parent_key"] = pd.array([None] * len(below), "Int64"), None
    return pd.concat([*out, below])[[*[c.split()[0] for c in NODE.split(", ")], "key", "parent_key"]]


def nodes_of(sequences: DataFrame, shard: int = SHARD) -> DataFrame:
    """All nodes of the trie over distinct ``sequences`` (seq, words, n, lo, ends), with the columns of NODE."""
    spark = sequences.sparkSession
    every = max(shard, sequences.count() // SHARDS)
    picked = sequences.where((F.size("seq") > 0) & (F.pmod(F.xxhash64("seq"), F.lit(every)) == 0)).select("seq").collect()
    bounds = sorted(tuple(r["seq"]) for r in picked)  # about SHARDS sequences at the most
    shared = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("long")
    def placed(seqs: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(shared.value, tuple(s.tolist())) for s in seqs], dtype="int64")

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = key[0]
        left, right = shared.value[at - 1] if at else None, shared.value[at] if at < len(shared.value) else None
        return shard_nodes(list(pdf["seq"]), list(pdf["words"]), pdf["n"].to_numpy(np.int64), pdf["lo"].to_numpy(np.int64),
                           list(pdf["ends"]), left, right)

    dealt = sequences.withColumn("shard", placed(F.col("seq"))).repartition(len(bounds) + 1, "shard")
    parts = saved(dealt.groupBy("shard").applyInPandas(build, f"{NODE}, key binary, parent_key binary"))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    edge = saved(parts.where("key is not null").groupBy("depth", "key").agg(
        F.min("conv_id").alias("conv_id"), *sums, F.max("ends").alias("ends"), F.max("parent_key").alias("parent_key")))
    names = edge.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    whole, inner = [c.split()[0] for c in NODE.split(", ")], parts.where("key is null")
    return inner.where("parent_key is null").select(whole).unionByName(
        inner.where("parent_key is not null").drop("parent_conv_id").join(names, "parent_key").select(whole)).unionByName(
        edge.join(names, "parent_key", "left").select(whole))


def prefix_trie(turns: DataFrame, step: int = 20, modulus: int = 4, shard: int = SHARD) -> DataFrame:
    """The nodes of the trie over the rebuilt conversations of ``turns`` (conv_id, turn, role, text); see ``rebuilt``.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node. Turns are ordered by
    ``turn`` (null first), ties by the digest of role and text; null roles and texts are empty; repeated rows are turns of their own. Rows
    without conv_id belong to no conversation. Without conversations there are no nodes. Other columns are not read. A conversation
    is one row of 20 bytes a turn.
    """
    sequences = saved(distinct_sequences(rebuilt(saved(conversations_of(turns)), step, modulus)))
    nodes = nodes_of(sequences, shard)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))


_SQL = r"""
WITH RECURSIVE crc_step(k, i, c) AS (
  SELECT k, 0, k FROM range(256) r(k)
  UNION ALL SELECT k, i + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc_step WHERE i < 8
), crc_table AS (SELECT list(c ORDER BY k) AS crc FROM crc_step WHERE i = 8),
convs AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(substr(c::VARCHAR, i, 1))::BIGINT for i in range(1, len(c::VARCHAR) + 1)]),
                            lambda a, b: xor(a // 256, crc[xor(a % 256, b) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL), crc_table
), digests AS (
  SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL
), turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS i FROM digests),
parts AS (
  SELECT c, 0 AS part, i, k, w FROM convs JOIN turns ON conv_id = c - c % 20 AND i <= h
  UNION ALL SELECT c, 1, i, k, w FROM convs JOIN turns ON conv_id = c AND i > h
), placed AS (SELECT c, k, w, row_number() OVER (PARTITION BY c ORDER BY part, i) AS depth FROM parts),
members AS (
  SELECT c, 0 AS depth, '' AS p, NULL::VARCHAR AS pp, 0 AS w, NOT EXISTS (SELECT 1 FROM placed WHERE placed.c = convs.c) AS ended FROM convs
  UNION ALL
  SELECT c, depth, p, coalesce(lag(p) OVER (PARTITION BY c ORDER BY depth), ''), w, depth = max(depth) OVER (PARTITION BY c)
  FROM (SELECT *, string_agg(k, ',') OVER (PARTITION BY c ORDER BY depth) AS p FROM placed)
), nodes AS (
  SELECT depth, p, min(pp) AS pp, min(c) AS conv_id, count(*) AS n_convs, min(w) AS w,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '')) AS ends_sha256
  FROM members GROUP BY depth, p
), children AS (SELECT depth - 1 AS depth, pp AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (depth, p)),
sums AS (
  SELECT m.depth, m.p, sum((u.n_convs - 1) * u.w)::BIGINT AS saved_tokens, count(*) FILTER (u.n_children = 0) AS n_leaves
  FROM counted u JOIN members m ON m.c = u.conv_id AND m.depth <= u.depth GROUP BY ALL
)
SELECT n.conv_id, n.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM counted n JOIN sums s USING (depth, p) LEFT JOIN nodes q ON q.depth = n.depth - 1 AND q.p = n.pp
"""


@query("op12_prefix_trie", _SQL)
def op12(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))
