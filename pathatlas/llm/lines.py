"""Boilerplate lines by site-relative frequency.

Lines of a page are counted once each, per host, as (host, 128-bit hash) with a partial aggregate; a line is boilerplate
of a host when more than ``ratio`` of the host's pages, and at least ``min_pages`` pages, hold it. A host has at most (mean
lines of a page / ratio) such lines, however many pages it has, so the list of a host is one short array. The lists are written and
counted: up to HANDED lines they are handed to all tasks and no text moves; more meet the pages by an equi-join on host and a salt, so that
a host's pages spread over SALTS tasks. Texts are never exploded on the way back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import query, saved, table

RATIO = 0.1
MIN_PAGES = 3
HANDED = 1 << 18  # lines (16 bytes each) of all lists that are handed to all tasks
SALTS = 32


def line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def boilerplate(pages: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines) with the keys of each host's boilerplate lines. Blank lines never count; a null host is a host."""
    per_page = pages.select(F.col(host_col).alias("_host"), F.explode(F.array_distinct(F.split(F.col(text_col), "\n"))).alias("_line"))
    seen = per_page.where(F.trim("_line") != "").groupBy("_host", line_key(F.col("_line")).alias("_key")).agg(F.count("*").alias("_n"))
    total = pages.groupBy(F.col(host_col).alias("_h")).agg(F.count("*").alias("_total"))
    often = seen.where(F.col("_n") >= min_pages).join(total, F.col("_host").eqNullSafe(F.col("_h")))
    return often.where(F.col("_n") > ratio * F.col("_total")).groupBy("_host").agg(F.collect_list("_key").alias("_drop"))


def drop_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES, dropped_col: str | None = None) -> DataFrame:
    """``pages`` with ``text_col`` rid of its host's boilerplate lines, and the number of dropped lines if a name is given.

    The order of the other lines, blank lines and all other columns stay. A null text stays null and has no lines; an
    empty text has one blank line. A repeated row is a page of its own. A text of boilerplate only becomes empty.
    """
    rules = saved(boilerplate(pages, host_col, text_col, ratio, min_pages))
    rows = pages.select(F.struct(*pages.columns).alias("_row"))  # so that no column name of the caller can clash
    host = F.col("_row")[host_col]
    if (rules.agg(F.sum(F.size("_drop"))).first()[0] or 0) <= HANDED:
        joined = rows.join(F.broadcast(rules), host.eqNullSafe(F.col("_host")), "left")
    else:
        rows = rows.withColumn("_s", F.pmod(F.xxhash64(F.col("_row")[text_col]), F.lit(SALTS)).cast("int"))
        rules = rules.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(rules, host.eqNullSafe(F.col("_host")) & (F.col("_s") == F.col("_salt")), "left")
    lines = F.split(F.col("_row")[text_col], "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains("_drop", line_key(x)))
    joined = joined.withColumn("_kept", F.when(F.col("_drop").isNull(), lines).otherwise(kept))
    cols = [(F.array_join("_kept", "\n") if c == text_col else F.col("_row")[c]).alias(c) for c in pages.columns]
    if dropped_col:
        cols.append(F.coalesce(F.size(lines) - F.size("_kept"), F.lit(0)).cast("long").alias(dropped_col))
    return joined.select(*cols)


SQL = f"""WITH p AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT DISTINCT doc_id, source, unnest(lines) AS line FROM p),
b AS (SELECT l.source, l.line FROM l JOIN (SELECT source, count(*) AS total FROM documents GROUP BY source) t ON t.source IS NOT DISTINCT FROM l.source
  WHERE trim(l.line) <> '' GROUP BY l.source, l.line, t.total HAVING count(*) >= {MIN_PAGES} AND count(*) > {RATIO} * t.total),
o AS (SELECT doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM p),
k AS (SELECT o.doc_id, count(*) AS n_lines, count(b.line) AS n_dropped,
  string_agg(o.line, chr(10) ORDER BY i) FILTER (WHERE b.line IS NULL) AS kept
  FROM o LEFT JOIN b ON b.source IS NOT DISTINCT FROM o.source AND b.line = o.line GROUP BY o.doc_id)
SELECT doc_id, n_lines, n_dropped, CAST(length(coalesce(kept, '')) AS BIGINT) AS kept_chars, sha256(coalesce(kept, '')) AS kept_sha256 FROM k"""


@query("op6_line_dedup", SQL)
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    out = drop_boilerplate(docs, "source", "text", dropped_col="n_dropped")
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"),
                      F.sha2(F.col("text"), 256).alias("kept_sha256"))
