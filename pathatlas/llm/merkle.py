"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections, in built-in functions only.

A section ends after an empty line, a paragraph after a line break, a leaf after white space that follows a sign other than
a letter or digit, or one of the vowels a, e, o; nothing of the text is lost, so the root is equal exactly for equal texts. A paragraph hashes the
hashes of its leaves, a section those of its paragraphs, the root (SHA-256) those of its sections. The fingerprint string is

    root/section:paragraph.leaf.leaf,paragraph.leaf/section:...

with 8 hex digits for sections and paragraphs and 6 for leaves. Equal branches are skipped and differing ones walked down to
locate an edit. Leaves are cut by content, so an insertion moves no other boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import query, saved, table

SECTION_CUT = r"(?<=\n\n)(?=[^\n])"
PARAGRAPH_CUT = r"(?<=\n)"
LEAF_CUT = r"(?<=[^\p{L}\p{N}\s]\s|[aeo]\s)(?=\S)"


def fingerprint(text: Column) -> Column:
    """Fingerprint string of a whole text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    hashed = F.transform(F.split(text, SECTION_CUT), lambda s: F.transform(
        F.split(s, PARAGRAPH_CUT), lambda p: F.transform(F.split(p, LEAF_CUT), lambda x: F.md5(x))))
    paragraphs = F.transform(hashed, lambda ps: F.transform(ps, lambda leaves: F.struct(
        F.md5(F.array_join(leaves, "")).alias("h"), F.array_join(F.transform(leaves, lambda x: F.substring(x, 1, 6)), ".").alias("l"))))
    sections = F.transform(paragraphs, lambda ps: F.struct(
        F.md5(F.array_join(F.transform(ps, lambda p: p["h"]), "")).alias("h"),
        F.array_join(F.transform(ps, lambda p: F.concat(F.substring(p["h"], 1, 8), F.lit("."), p["l"])), ",").alias("l")))
    root = F.transform(F.array(sections), lambda ss: F.concat(
        F.sha2(F.array_join(F.transform(ss, lambda s: s["h"]), ""), 256), F.lit("/"),
        F.array_join(F.transform(ss, lambda s: F.concat(F.substring(s["h"], 1, 8), F.lit(":"), s["l"])), "/")))
    return root[0]


def root(fp: Column) -> Column:
    return F.substring(fp, 1, 64)


def leaves(fp: Column) -> Column:
    """Distinct leaf hashes of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(fp, F.lit(r"\.([0-9a-f]{6})"), 1))


def likeness(a: Column, b: Column, a_leaves: Column | None = None) -> Column:
    """1 for equal roots, else shared distinct leaves over the mean number of distinct leaves (0 to 1)."""
    x, y = leaves(a) if a_leaves is None else a_leaves, leaves(b)
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(
        2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def differing(a: Column, b: Column) -> Column:
    """Positions (section, paragraph; from 0) of the branches of ``a`` that differ from ``b`` at the same place.

    Sections with equal hashes are not looked into. A branch that only ``a`` has differs; equal roots give an empty array.
    """
    parts = lambda fp: F.slice(F.split(fp, "/"), 2, 1 << 30)
    inner = lambda s: F.split(F.substring(s, 10, 1 << 30), ",")
    other = parts(b)
    rows = F.transform(parts(a), lambda s, i: F.when(
        F.substring(s, 1, 8).eqNullSafe(F.substring(F.try_element_at(other, i + 1), 1, 8)), F.array().cast("array<struct<section:int,paragraph:int>>"),
    ).otherwise(F.filter(F.transform(inner(s), lambda p, j: F.when(
        ~F.substring(p, 1, 8).eqNullSafe(F.substring(F.try_element_at(inner(F.try_element_at(other, i + 1)), j + 1), 1, 8)),
        F.struct(i.cast("int").alias("section"), j.cast("int").alias("paragraph")))), lambda x: x.isNotNull())))
    return F.flatten(rows)


def next_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_prev, _id, _need): for each distinct id the one before it (the first follows the last) and a quarter of that
    one's longest text. Only ids and lengths are sorted: range partitions, a window in each, and one row per partition.
    """
    ids = docs.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.length(F.coalesce(text_col, F.lit("")))).alias("_n"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(ids.repartitionByRange(n, F.asc_nulls_first("_id")).withColumn("_part", F.spark_partition_id()))
    order = Window.partitionBy("_part").orderBy(F.asc_nulls_first("_id"))
    local = ranged.withColumn("_at", F.row_number().over(order)).withColumn("_next", F.lead(F.struct("_id")).over(order))
    ends = ranged.groupBy("_part").agg(F.min(F.struct(F.col("_id").isNotNull().alias("set"), F.col("_id").alias("_id"))).alias("_first"))
    by_part = Window.orderBy("_part")  # one row per partition
    ends = ends.select(F.col("_part").alias("_p"), F.coalesce(
        F.lead("_first").over(by_part), F.min_by("_first", "_part").over(Window.orderBy("_part").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))).alias("_after"))
    return local.join(ends, F.col("_part") == F.col("_p")).select(
        F.col("_id").alias("_prev"), F.when(F.col("_next").isNull(), F.col("_after._id")).otherwise(F.col("_next._id")).alias("_id"),
        F.floor(F.col("_n") / 4).cast("int").alias("_need"))


def compare_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document.

    Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited text has its
    last quarter (floor of code points) replaced by the first as many, or all, of the next document in ascending id; the first
    follows the last. Null texts count as empty. Repeated rows keep a row each; rows that share an id have the same next
    document, and as a next document they stand with their smallest text. A null id comes before all others. A single document
    is its own next. An empty table gives an empty result; other columns are not read.
    """
    keyed = lambda c: [F.coalesce(c, F.lit(0)).alias("_k"), F.isnull(c).alias("_null")]  # noqa: E731  null is a key of its own
    # both joins use exactly these columns, so that one exchange of the texts serves both
    rows = docs.select(*keyed(F.col(id_col)), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    link = next_ids(docs.select(id_col, text_col), id_col, text_col)
    after = rows.join(link.select(*keyed(F.col("_id")), "_prev", "_need"), ["_k", "_null"]).select(
        *keyed(F.col("_prev")), F.expr("substring(_text, 1, _need)").alias("head"), fingerprint(F.col("_text")).alias("fp"))
    after = after.groupBy("_k", "_null").agg(F.min(F.struct("head", "fp")).alias("_after"))
    both = rows.join(after, ["_k", "_null"])
    k = "cast(floor(length(_text) / 4) as int)"
    doc = F.when(~F.col("_null"), F.col("_k")).alias("_doc")
    both = both.select(doc, "_text", "_after", F.expr(
        f"concat(substring(_text, 1, length(_text) - {k}), substring(_after.head, 1, {k}))").alias("_edited"))
    made = both.select("_doc", F.length("_text").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
                       fingerprint(F.col("_text")).alias("fingerprint"), fingerprint(F.col("_edited")).alias("edited_fingerprint"),
                       F.col("_after.fp").alias("_next_fp"))
    made = made.withColumn("_leaves", leaves(F.col("fingerprint")))
    return made.select(
        F.col("_doc").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), F.col("_leaves")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next_fp"), F.col("_leaves")).alias("near_next"))


@query("op7_merkle")
def op7(spark, sf_dir):
    return compare_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
