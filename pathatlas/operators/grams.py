"""Trigram postings for substring search.

A row that contains a term contains each of the term's trigrams. The postings are sorted by trigram, so a search reads the
stretch of the rarest one, and only the rows named there are compared with the whole term. Terms of fewer than three letters
have no trigram and scan all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ip import let
from ..session import cut_lineage

GRAM = 3
POSTINGS_PER_PART = 2_000_000


def grams(text: Column) -> Column:
    """The distinct trigrams of a lower-cased text (none for a shorter one or null)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return let(low, lambda s: F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(s) - (GRAM - 1), F.lit(1))), lambda i: F.substring(s, i, F.lit(GRAM)))))


def gram_index(rows: DataFrame, ident: Sequence[str], texts: Sequence[Column]) -> DataFrame:
    """(gram, *ident): which rows hold a trigram in any of ``texts``; range-partitioned and sorted by trigram, written once."""
    all_grams = F.array_distinct(F.flatten(F.array(*[grams(t) for t in texts])))
    posts = cut_lineage(rows.select(F.explode(all_grams).alias("gram"), *ident).where(F.length("gram") == GRAM).distinct())
    parts = max(1, -(-posts.count() // POSTINGS_PER_PART))
    return cut_lineage(posts.repartitionByRange(parts, "gram", *ident).sortWithinPartitions("gram", *ident))


def candidates(rows: DataFrame, index: DataFrame, ident: Sequence[str], term: str) -> DataFrame:
    """The rows that may contain the term: those with its rarest trigram. All of them for a shorter term."""
    low = term.lower()
    asked = sorted({low[i:i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not asked:
        return rows
    posts = index.where(F.col("gram").isin(*asked))
    sizes = {r["gram"]: r["n"] for r in posts.groupBy("gram").agg(F.count("*").alias("n")).collect()}  # a row for each trigram of the term
    rare = min(asked, key=lambda g: (sizes.get(g, 0), g))
    return rows.join(posts.where(F.col("gram") == rare).select(*ident), list(ident), "left_semi")
