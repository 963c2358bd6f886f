"""Exact Jaccard self-join of word-shingle sets by adaptive multi-match prefixes.

The tokens of all sets have one order, rare ones first (by counts in a table of fixed size; any common order gives right results).
At similarity t a set of n tokens misses at most e = n - ceil(t n) of any partner's, and at most f = n - ceil(2t/(1+t) n) of a partner
that is no smaller. So two similar sets share at least k tokens among the first e + k of the larger and the first f + k of the
smaller one, for every k. Each set takes the k that its own counts make cheapest: a longer prefix costs more rows, but as k shared
tokens are required, fewer pairs must be verified. A pair must share the smaller k of the two.

Sets of a large group of near-copies share nearly all tokens, so pairs are not formed at once. First every set meets only the most
typical set of each of its tokens (its prefix has the most common tokens, so it is likely what the others are copies of), and is
compared with the one it shares most with; what is verified is joined to components. Then only tokens that still hold several
components form pairs, across these and in blocks, so no token's sets meet in one task; a pair whose parity maps (wider for large sets) differ in more
bits than a similar pair has differing tokens is no candidate. This loses no link between components.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import PIECES, added, pieces, query, saved, table
from .simhash import components

CELLS = 1 << 20  # of the table of token counts
MOST = 16  # shared tokens a set may require
OTHERS = 0.05  # sets that hold a rare token too, below what the cells can tell
VERIFY = 0.4  # cost of verifying a pair, in rows for each token of the set
BITS = 16  # words of 64 bits of a set's parity map
LARGE, WIDE = 1024, 64  # sets of so many tokens have a second map, of so many words: the first one says little of them
HANDED = 1 << 20  # rows of an id table that is handed to all tasks; a larger one is joined by exchange
BLOCK = 1024  # sets of a token that meet another block of them in one cell



@dataclass(frozen=True)
class Rule:
    """Texts link whose sets of runs of ``words`` words have at least the similarity num / den (compared without rounding)."""

    words: int = 3
    num: int = 90
    den: int = 100
    blank: bool = False  # whether texts without words have a set, one that is the same for all

    def shingles(self, text: str | None) -> np.ndarray:
        return shingles(text, self.words, self.blank)

    def missing(self, n, ceil=lambda a, b: -(-a // b)):
        """How many tokens a set of n may lack of a similar one's."""
        return n - ceil(n * self.num, self.den)

    def missing_of_larger(self, n, ceil=lambda a, b: -(-a // b)):
        """The same where the other set is no smaller."""
        return n - ceil(n * (2 * self.num), self.num + self.den)

    def sized(self, n: Column, m: Column) -> Column:
        return F.least(n, m) * self.den >= F.greatest(n, m) * self.num

    def near(self, differing: Column, n: Column, m: Column) -> Column:
        """Whether sets that differ in so many tokens at least can be similar."""
        return differing * (self.num + self.den) <= (n + m) * (self.den - self.num)

    def alike(self, shared: Column, n: Column, m: Column) -> Column:
        return shared * (self.num + self.den) >= (n + m) * self.num


def parity(held: np.ndarray, words: int = BITS) -> np.ndarray:
    """For each of 64 * ``words`` classes of tokens whether the set holds an odd number of them. Two maps differ in no more bits than
    the sets differ in tokens."""
    odd = np.bincount(((held >> np.uint64(3)) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _ceil(a: Column, b: int) -> Column:
    return F.ceil(a / b).cast(LongType())


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, words: int, blank: bool = False) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``words`` words; fewer words are one run. A-Z are lower-cased."""
    tokens = (text or "").encode("utf-8").lower().split()  # bytes: ASCII letters and white space only
    if not tokens:
        return np.zeros(int(blank), np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    n = min(words, len(tokens))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mixed(out * _A + h[i:len(h) - n + 1 + i] * _B)
    return np.unique(out)


def _cells(held: np.ndarray) -> np.ndarray:
    return (held >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def token_counts(docs: DataFrame, text_col: str, rule: Rule) -> np.ndarray:
    """How many sets hold the tokens of each cell, over all rows."""
    def count(batches):
        total = np.zeros(CELLS, np.uint32)
        for pdf in batches:
            for t in pdf["_text"]:
                np.add.at(total, _cells(rule.shingles(t)), np.uint32(1))
        yield pieces(total)

    got = added(docs.select(F.col(text_col).alias("_text")).mapInPandas(count, PIECES))
    return got if len(got) else np.zeros(CELLS)


def head(held: np.ndarray, counts: np.ndarray, load: float, rule: Rule) -> tuple[int, np.ndarray]:
    """The shared tokens k that a set requires, and its first e + k tokens in the common order.

    A cell's count less the tokens expected there anyway (OTHERS at least) estimates a token's other sets; the pairs that share k
    tokens are at most the sum of these over the prefix, divided by k.
    """
    n = len(held)
    seen = counts[_cells(held)]
    order = np.lexsort((held, seen))
    e = rule.missing(n)
    held, others = held[order], np.cumsum(np.maximum(OTHERS, seen[order] - load))
    k = np.arange(1, min(MOST, n - e) + 1)
    met = others[e + k - 1]
    best = int(np.argmin(e + k + met + VERIFY * n * met / k))
    return int(k[best]), held[: e + k[best]]


def heads(docs: DataFrame, text_col: str, rule: Rule) -> DataFrame:
    """(key, node, n, k, bits, wide, head) per distinct text that has a set; ``key`` is the text's MD5, ``node`` a number.

    ``wide`` is null for sets of fewer than LARGE tokens.
    """
    counts = token_counts(docs, text_col, rule)
    mean = float(counts.mean())
    shared = docs.sparkSession.sparkContext.broadcast((counts.astype(np.float32), mean + 2 * mean**0.5))

    @F.pandas_udf("n long, k int, bits array<long>, wide array<long>, head array<long>")
    def told(texts: pd.Series) -> pd.DataFrame:
        seen, load = shared.value
        rows = []
        for t in texts:
            held = rule.shingles(t)
            k, first = head(held, seen, load, rule) if len(held) else (0, held)
            rows.append((len(held), k, parity(held), parity(held, WIDE) if len(held) >= LARGE else None, first.view(np.int64)))
        return pd.DataFrame(rows, columns=["n", "k", "bits", "wide", "head"])

    rows = docs.select(text_key(text_col).alias("key"), told(F.col(text_col)).alias("_h")).groupBy("key").agg(F.first("_h").alias("_h"))
    return saved(rows.select("key", "_h.*").where("n > 0").withColumn("node", F.monotonically_increasing_id()))


def text_key(text_col) -> Column:
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def verified(docs: DataFrame, text_col: str, nodes: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """Those of ``pairs`` (u, v; a written table) whose whole sets are similar enough.

    ``nodes`` has the text's key of each node. Sets are made of the texts that stand in a pair only, once for each.
    """
    @F.pandas_udf("array<long>")
    def held(texts: pd.Series) -> pd.Series:
        return pd.Series([rule.shingles(t).view(np.int64) for t in texts], dtype=object)

    if pairs.isEmpty():
        return pairs
    asked = saved(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().join(nodes.select("node", "key"), "node"))
    texts = docs.select(text_key(text_col).alias("key"), F.col(text_col).alias("_text")).join(handed(asked), "key")
    sets = texts.select("node", held(F.col("_text")).alias("held")).groupBy("node").agg(F.first("held").alias("held"))
    sets = saved(sets)
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("held").alias("a")), "u").join(
        sets.select(F.col("node").alias("v"), F.col("held").alias("b")), "v")
    return saved(both.where(rule.alike(F.size(F.array_intersect("a", "b")), F.size("a"), F.size("b"))).select("u", "v"))


def handed(table: DataFrame) -> DataFrame:
    """A written table of ids, marked to be handed to all tasks if it is small enough, so that the texts need not move."""
    return F.broadcast(table) if table.count() <= HANDED else table


def rooted(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """The rows with the root of their node's component among the links ``found`` (None: no links yet)."""
    if found is None:
        return rows.withColumn("root", F.col("node"))
    roots = components(found).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return rows.join(roots, F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("_root", "node")).drop("_node", "_root")


def meetings(now: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """(u, v, least) for each token that two sets of unlike roots share in their prefixes, where sizes, places and parity maps allow that
    they are similar; ``now`` has (node, token, at, n, k, root), and ``least`` tokens must be shared."""
    held = now.groupBy("token").agg(*[f(c).alias(f"{a}_{c}") for a, f, c in (("lo", F.min, "root"), ("hi", F.max, "root"), ("lo", F.min, "n"),
                                                                             ("hi", F.max, "n"), ("lo", F.min, "k"))], F.count("*").alias("c"))
    held = held.where((F.col("lo_root") < F.col("hi_root")) & ((F.col("c") > 2) | rule.sized(F.col("lo_n"), F.col("hi_n"))))
    now = saved(now.join(held.select("token", "lo_k", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "token"))
    # maps are wide, so only sets have them that hold as many such tokens as any of their partners may require
    enough = now.groupBy("node").agg(F.count("*").alias("_c"), F.least(F.first("k"), F.min("lo_k")).alias("_least")).where("_c >= _least")
    now = now.join(nodes.select("node", "wide", *[F.get("bits", i).alias(f"b{i}") for i in range(BITS)]).join(enough, "node"), "node")
    maps = [f"b{i}" for i in range(BITS)]
    facts = ("node", "n", "k", "at", "root", "wide", *maps)
    mine, every = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    big = now.select("token", mine.alias("i"), every.alias("j"), *[F.col(c).alias(f"x_{c}") for c in facts])
    small = now.where(F.col("at") < rule.missing_of_larger(F.col("n"), _ceil) + F.col("k")).select(
        "token", every.alias("i"), mine.alias("j"), *[F.col(c).alias(f"y_{c}") for c in facts])
    n, m, p, q = F.col("x_n"), F.col("y_n"), F.col("x_at"), F.col("y_at")
    larger = (n > m) | ((n == m) & (F.col("x_node") > F.col("y_node")))
    shared = F.least(p, q) + F.least(n - p, m - q)  # at most, given this token's places
    differing = sum((F.bit_count(F.col(f"x_{b}").bitwiseXOR(F.col(f"y_{b}"))) for b in maps), F.lit(0))
    apart = F.zip_with("x_wide", "y_wide", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.coalesce(F.aggregate(apart, F.lit(0), lambda total, c: total + c), F.lit(0))
    able = larger & rule.sized(n, m) & (F.col("x_root") != F.col("y_root")) & rule.alike(shared, n, m) & rule.near(differing, n, m)
    return big.join(small, ["token", "i", "j"]).where(able & rule.near(apart, n, m)).select(
        F.col("x_node").alias("u"), F.col("y_node").alias("v"), F.least("x_k", "y_k").alias("least"))


def links(docs: DataFrame, nodes: DataFrame, text_col: str, rule: Rule, found: DataFrame | None = None) -> DataFrame:
    """Links (u, v) that connect the nodes of ``heads`` just as all pairs of similar sets would.

    ``found`` may hold links that are known already.
    """
    facts = saved(nodes.select("node", "n", "k"))
    flat = nodes.select("node", F.posexplode("head").alias("at", "token"))
    often = saved(flat.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"))
    rows = saved(flat.join(often, "token").join(facts, "node"))
    typical = saved(rows.groupBy("node").agg((-F.sum("c") / (rule.missing(F.first("n"), _ceil) + F.first("k"))).alias("by")))
    rows = rows.drop("c")
    places = rule.missing_of_larger(F.least("n", "hub.n"), _ceil) + F.least("k", "hub.k")
    now = rooted(rows, found).join(typical, "node")
    first = F.min(F.struct(F.col("by"), F.col("node"), F.col("n"), F.col("k"), F.col("root"))).alias("hub")
    hubs = now.groupBy("token").agg(first, F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token", "hub")
    met = now.join(hubs, "token").where((F.col("root") != F.col("hub.root")) & rule.sized(F.col("n"), F.col("hub.n")))
    met = met.groupBy("node", F.col("hub.node").alias("other")).agg(
        F.count("*").alias("c"), F.first(F.least("k", "hub.k")).alias("least"), F.first(places).alias("places"))
    best = met.where("c >= least and 2 * c >= places").groupBy("node").agg(F.max(F.struct("c", "other")).alias("b"))
    pairs = saved(best.select(F.least("node", "b.other").alias("u"), F.greatest("node", "b.other").alias("v")).distinct())
    new = verified(docs, text_col, nodes, pairs, rule)
    found = new if found is None else saved(found.union(new))
    now = saved(rooted(rows, found))
    met = meetings(now, nodes, rule).groupBy("u", "v").agg(F.count("*").alias("c"), F.first("least").alias("least"))
    pairs = saved(met.where("c >= least").select("u", "v"))
    return saved(found.union(verified(docs, text_col, nodes, pairs, rule)))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule()) -> DataFrame:
    """(id, n_shingles, component) per row: component is the smallest id reachable over the links of ``rule``.

    A text's set are its distinct runs of words, fewer words are one run. Null texts and texts without words have the
    empty set and are linked with nothing, not even with one another. Equal texts are linked, also repeated rows. Null ids come
    last: a component has a null id only where no row of it has one. An empty table gives an empty result. Other columns are not
    read.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = saved(docs.select("id", text_key("text").alias("key")))
    nodes = heads(docs, "text", rule)
    roots = components(links(docs, nodes, "text", rule)).select(F.col("node").alias("_node"), "root")
    least = ids.groupBy("key").agg(F.min("id").alias("lo"))
    placed = nodes.select("key", "node", "n").join(least, "key").join(roots, F.col("node") == F.col("_node"), "left").select(
        "key", "n", "lo", F.coalesce("root", "node").alias("root"))
    placed = saved(placed)
    named = placed.join(placed.groupBy("root").agg(F.min("lo").alias("component")), "root").select("key", "n", "component")
    return ids.join(named, "key", "left").select(
        "id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))


@query("op13_jaccard_join")
def op13(spark, sf_dir):
    found = jaccard_join(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
