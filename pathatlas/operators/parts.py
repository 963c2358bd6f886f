"""Nested rows whose lists have any length: numbered parts of several lists side by side.

A list that belongs to a key is numbered by chunked scans and cut into parts of ``size`` items, so no task holds more than a
part. Lists of one key meet part by part: row (key, part) has the part-th piece of each of them, null where a list is shorter.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from . import runs

SIZE = 128


def cut_list(rows: DataFrame, key: str, order: Sequence[Column], item: Column, out: str, size: int = SIZE) -> DataFrame:
    """(key, part, out): the items of a key in ``order``, ``size`` to a part, counted from 1."""
    flat = rows.select(key, item.alias("_item"), *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    n = runs.numbered(flat, "_pos", [F.col(f"_o{i}") for i in range(len(order))], [key])
    return n.groupBy(key, F.ceil(F.col("_pos") / size).alias("part")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_item"))), lambda x: x["_item"]).alias(out))


def side_by_side(key: str, lists: Sequence[DataFrame]) -> DataFrame:
    """(key, part, one column per list) of lists that ``cut_list`` made."""
    return reduce(lambda a, b: a.join(b, [key, "part"], "full"), lists)


def with_parts(facts: DataFrame, key: str, lists: Sequence[DataFrame]) -> DataFrame:
    """The facts of a key on each of its part rows; a key without any list has one row, part 1."""
    return facts.join(side_by_side(key, lists), [key], "left").withColumn("part", F.coalesce("part", F.lit(1)))


def prefix_detail(facts: DataFrame, top_paths: DataFrame, relatives: DataFrame, size: int = SIZE) -> DataFrame:
    """Prefix facts with all paths (shortest first) and all relatives in parts."""
    text = P.path_text(F.coalesce("path_arr_raw", "path_arr"))
    best = cut_list(top_paths, "pid", [F.col("path_len"), -F.col("n_peers"), text], F.struct(
        text.alias("path"), F.col("n_peers").alias("peers"), F.col("is_best")), "paths", size)
    sides = [cut_list(relatives.where(F.col("side") == s), "pid", [F.col("pos")], F.col("rel_prefix"), s, size) for s in ("sup", "sub")]
    return with_parts(facts, "pid", [best, *sides])


def probe_paths(hits: DataFrame, top_paths: DataFrame, upstreams: DataFrame, size: int = SIZE) -> DataFrame:
    """Looked-up addresses with the upstreams and the paths of their prefix (the best first) in parts."""
    text = P.path_text(F.coalesce("path_arr_raw", "path_arr"))
    found = cut_list(top_paths, "pid", [F.when(F.col("is_best"), 0).otherwise(1), F.col("path_len"), -F.col("n_peers"), text], text, "paths", size)
    ups = cut_list(upstreams, "pid", [F.col("pos")], F.struct("asn", "n"), "upstreams", size)
    return with_parts(hits, "pid", [found, ups])


def asn_overview(facts: DataFrame, byorigin: DataFrame, member_of: DataFrame, size: int = SIZE) -> DataFrame:
    """Facts of an origin (asn, ...) with all its prefixes, the best observed first, and the sets it is a member of, in parts."""
    own = byorigin.select(F.col("origin_asn").alias("asn"), "pid", "prefix", "n_paths")
    sets = member_of.where(F.col("member").rlike("^AS[0-9]+$")).withColumn("asn", F.substring("member", F.lit(3), F.length("member")).try_cast("bigint"))
    return with_parts(facts, "asn", [cut_list(own, "asn", [-F.col("n_paths"), F.col("pid")], F.col("prefix"), "prefixes", size),
                                     cut_list(sets, "asn", [F.col("parent_key")], F.col("parent_key"), "member_of", size)])


def person_directory(registry: DataFrame, counts: DataFrame, seen: DataFrame, size: int = SIZE) -> DataFrame:
    """Persons of ASNs that are seen (person, person_name, n_asn, n_prefix) with their ASNs in parts."""
    rows = registry.where("person IS NOT NULL").join(seen.select("asn"), ["asn"], "left_semi").select("person", "person_name", "asn").distinct()
    facts = rows.join(counts.withColumnRenamed("origin_asn", "asn"), ["asn"], "left").groupBy("person", "person_name").agg(
        F.count("*").alias("n_asn"), F.sum(F.coalesce("n_prefix", F.lit(0))).alias("n_prefix"))
    return with_parts(facts, "person", [cut_list(rows, "person", [F.col("asn")], F.col("asn"), "asns", size)])
