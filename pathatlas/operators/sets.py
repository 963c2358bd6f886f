"""as-sets: extraction, resolution, reverse edges, expansion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import runs

# Registries in order of trust, for resolving and for picking a set.
RESOLVE_ORDER = ("RIPE", "APNIC", "ARIN", "AFRINIC", "LACNIC", "RIPE-NONAUTH", "RADB")
PICK_ORDER = (*RESOLVE_ORDER, "DN42")


def _rank(source: str, order: Sequence[str]):
    out = F.lit(99)
    for i, s in enumerate(order):
        out = F.when(F.upper(source) == s, i).otherwise(out)
    return out


def as_set_extract(objects: DataFrame, default_source: str = "") -> DataFrame:
    """RPSL objects (obj_no, attrs) -> (name, source, descr, members); a later object wins."""
    first = lambda k: F.get(F.filter("attrs", lambda a: a["k"] == k), 0)["v"]
    cut = lambda c: F.trim(F.element_at(F.split(c, "#"), 1))
    o = objects.where(F.get("attrs", 0)["k"] == "as-set")
    vals = F.transform(F.filter("attrs", lambda a: a["k"] == "members"), lambda a: F.split(F.element_at(F.split(a["v"], "#"), 1), "[ ,]+"))
    members = F.filter(F.transform(F.flatten(vals), lambda m: F.upper(F.trim(m))), lambda m: m != "")
    src = F.upper(cut(first("source")))
    rows = o.select("obj_no", F.upper(cut(first("as-set"))).alias("name"),
                    F.coalesce(F.nullif(src, F.lit("")), F.lit(default_source)).alias("source"),
                    F.coalesce(first("descr"), F.lit("")).alias("descr"), members.alias("members"))
    return rows.where("name <> ''").groupBy("name", "source").agg(
        F.max_by(F.struct("descr", "members"), "obj_no").alias("b")).select("name", "source", "b.*")


def as_set_resolve(sets: DataFrame, order: Sequence[str] = RESOLVE_ORDER) -> tuple[DataFrame, DataFrame]:
    """(directory, edges): child names become SOURCE::NAME of the best source, unknown stay bare."""
    key = F.concat_ws("::", "source", "name")
    best = sets.groupBy("name").agg(F.min_by("source", F.struct(_rank("source", order), F.col("source"))).alias("_src"))
    m = sets.select(key.alias("set_key"), F.posexplode("members").alias("ord", "m"))
    e = m.join(best.select(F.col("name").alias("m"), "_src"), ["m"], "left")
    is_asn = F.col("m").rlike("^AS[0-9]+$")
    edges = e.select("set_key", "ord", F.when(is_asn, "asn").otherwise("set").alias("kind"),
                     F.when(is_asn | F.col("_src").isNull(), F.col("m")).otherwise(F.concat_ws("::", "_src", "m")).alias("val"))
    directory = sets.select(key.alias("set_key"), "source", "name", "descr", F.size("members").alias("n_members"))
    return directory, edges


def as_set_reverse(edges: DataFrame, cap: int | None = None) -> DataFrame:
    """member -> parents, distinct and numbered in order, all or the first ``cap`` of each."""
    d = edges.select(F.col("val").alias("member"), F.col("set_key").alias("parent_key")).distinct()
    return runs.ranked(d, "pos", [F.col("parent_key")], ["member"], cap)


def as_set_pick(sets: DataFrame, order: Sequence[str] = PICK_ORDER) -> DataFrame:
    """One set per name: non-empty first, then source priority, then size."""
    rank = F.struct(F.when(F.col("n_members") > 0, 0).otherwise(1), _rank("source", order), -F.col("n_members"), F.col("set_key"))
    return sets.groupBy("name").agg(F.min_by(F.struct("set_key", "source", "n_members"), rank).alias("b")).select("name", "b.*")


def as_set_expand(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Tree below every root -> (root, path, depth, kind, val, cycle, unresolved).

    One join per level against the edge list; a set that is its own ancestor is marked and not
    opened again, which ends the loop at any depth. Every level is written once. The tree lists
    each path, so name the roots that are to be shown.
    """
    known = edges.select(F.col("set_key").alias("val")).distinct().withColumn("_known", F.lit(True))
    front = roots.select(F.col("set_key").alias("root"), F.col("set_key").alias("val"), F.array("set_key").alias("path"))
    levels: list[DataFrame] = []
    while not levels or not front.isEmpty():
        kids = front.select("root", F.col("val").alias("set_key"), "path").join(
            edges.select("set_key", "kind", F.col("val").alias("kid")), ["set_key"])
        cycle = (F.col("kind") == "set") & F.array_contains("path", F.col("kid"))
        levels.append(cut_lineage(kids.select("root", F.array_append("path", F.col("kid")).alias("path"), F.lit(len(levels) + 1).alias("depth"),
                                              "kind", F.col("kid").alias("val"), cycle.alias("cycle"))))
        front = levels[-1].where((F.col("kind") == "set") & ~F.col("cycle")).select("root", "val", "path")
    out = reduce(DataFrame.unionByName, levels).join(known, ["val"], "left")
    return out.withColumn("unresolved", (F.col("kind") == "set") & F.col("_known").isNull()).drop("_known")


def strong_components(links: DataFrame) -> DataFrame:
    """(set_key, component) of the sets of ``links`` (set_key, kid) that lie on a cycle; others are components of their own.

    Sets without a parent or without a child lie on no cycle and are peeled off first. Then every set takes the
    smallest name that leads to it; a set that keeps its own name forms a component with all sets that lead back to it through
    sets of the same name. What is left over goes round again. Each step writes one narrow table.
    """
    done: list[DataFrame] = []
    live = cut_lineage(links.where("set_key != kid").distinct())
    while True:
        size = None
        while size != (now := live.count()):
            size = now
            ends = live.select(F.col("kid").alias("set_key")).distinct()
            starts = live.select(F.col("set_key").alias("kid")).distinct()
            live = cut_lineage(live.join(ends, ["set_key"], "left_semi").join(starts, ["kid"], "left_semi").select("set_key", "kid"))
        if not size:
            break
        names = cut_lineage(live.select("set_key", F.col("set_key").alias("name")).distinct())
        moved = True
        while moved:
            told = live.join(names, ["set_key"]).groupBy("kid").agg(F.min("name").alias("_n"))
            step = cut_lineage(names.join(told.withColumnRenamed("kid", "set_key"), ["set_key"], "left").select(
                "set_key", F.least("name", "_n").alias("name"), (F.col("_n") < F.col("name")).alias("_moved")))
            moved = not step.where("_moved").isEmpty()
            names = step.select("set_key", "name")
        inside = live.join(names, ["set_key"]).join(names.select(F.col("set_key").alias("kid"), F.col("name").alias("_k")), ["kid"])
        inside = cut_lineage(inside.where("name = _k").select("set_key", "kid"))
        found = [cut_lineage(names.where("set_key = name"))]
        while not found[-1].isEmpty():
            back = inside.join(found[-1].select(F.col("set_key").alias("kid"), "name"), ["kid"]).select("set_key", "name").distinct()
            found.append(cut_lineage(back.join(reduce(DataFrame.unionByName, found), ["set_key"], "left_anti")))
        done.append(cut_lineage(reduce(DataFrame.unionByName, found)))
        gone = done[-1].select("set_key")
        live = cut_lineage(live.join(gone, ["set_key"], "left_anti").join(gone.withColumnRenamed("set_key", "kid"), ["kid"], "left_anti")
                           .select("set_key", "kid"))
    if not done:
        return links.select("set_key", F.col("set_key").alias("component")).limit(0)
    return reduce(DataFrame.unionByName, done).select("set_key", F.col("name").alias("component"))


def cones(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(set_key, component) of every set, and (component, asn): the distinct ASNs reachable from it, at any depth.

    Sets of a cycle share one cone. On the graph of components cones grow from the leaves up: an ASN that is new to a
    component goes on to the components above, so every ancestor takes over what the child has already united.
    """
    links = edges.where("kind = 'set'").select("set_key", F.col("val").alias("kid"))
    known = edges.select("set_key").distinct()
    comp = cut_lineage(known.join(strong_components(links), ["set_key"], "left").select(
        "set_key", F.coalesce("component", "set_key").alias("component")))
    up = links.join(comp, ["set_key"]).join(comp.select(F.col("set_key").alias("kid"), F.col("component").alias("below")), ["kid"])
    up = cut_lineage(up.where("component != below").select(F.col("component").alias("above"), F.col("below").alias("component")).distinct())
    new = edges.where("kind = 'asn'").join(comp, ["set_key"]).select("component", F.col("val").alias("asn")).distinct()
    levels = [cut_lineage(new)]
    while not levels[-1].isEmpty():
        step = levels[-1].join(up, ["component"]).select(F.col("above").alias("component"), "asn").distinct()
        levels.append(cut_lineage(step.join(reduce(DataFrame.unionByName, levels), ["component", "asn"], "left_anti")))
    return comp, reduce(DataFrame.unionByName, levels)


def as_set_cone(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Number of distinct ASNs below each root, or below every set (sets without any are left out)."""
    comp, held = cones(edges)
    sizes = held.groupBy("component").agg(F.count("*").alias("n_asns"))
    wanted = comp if roots is None else comp.join(roots.select("set_key").distinct(), ["set_key"], "left_semi")
    return wanted.join(sizes, ["component"]).select(F.col("set_key").alias("root"), "n_asns")


def as_set_sample(sets: DataFrame, edges: DataFrame, members: int, descr_len: int | None = None) -> DataFrame:
    """Directory rows with their first ``members`` members (rank filter before the lists are built)."""
    first = runs.ranked(edges, "_rn", [F.col("ord"), F.col("val")], ["set_key"], members)
    lists = first.groupBy("set_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "val"))), lambda x: x["val"]).alias("members"))
    out = sets.join(lists, ["set_key"], "left")
    return out if descr_len is None else out.withColumn("descr", F.substring("descr", 1, descr_len))


def as_set_tokens(df: DataFrame, col: str) -> DataFrame:
    """Split a multi-value as-set field, one row per token."""
    toks = F.filter(F.split(F.trim(F.col(col)), r"[\s,]+"), lambda x: x != "")
    return df.withColumn("token", F.explode(toks))
