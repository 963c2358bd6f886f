"""Search and lookup: origins, path patterns, subnets, addresses, detail rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ip, paths as P
from . import consolidate as C
from . import runs
from .joins import covering_join
from .sweep import longest_match


# ---- published search tables ------------------------------------------------

def origin_rows(pathobs: DataFrame) -> DataFrame:
    """One row per (prefix, origin): observations of the prefix, its number of origins, and whether this is the
    representative one. Everything comes from the (prefix, origin) sums, which shrink in each task."""
    sums = pathobs.groupBy("pid", "prefix", "family", "origin_asn").agg(F.sum("n_peers").alias("_n"))
    whole = sums.groupBy("pid").agg(
        F.sum("_n").alias("n_paths"), F.count("origin_asn").alias("n_origins"),
        F.min_by("origin_asn", F.when(F.col("origin_asn").isNotNull(), F.struct(-F.col("_n"), F.col("origin_asn")))).alias("_main"))
    return sums.join(whole, ["pid"]).select("pid", "prefix", "family", "origin_asn", "n_origins", "n_paths",
                                            F.col("origin_asn").eqNullSafe(F.col("_main")).alias("is_primary"))


def pathsearch_build(pgeo: DataFrame, pathobs: DataFrame, totals: DataFrame | None,
                     rpki: DataFrame | None = None, irr: DataFrame | None = None) -> DataFrame:
    """The published (prefix, origin) rows: place, status of that origin and, if given, the path totals of the prefix."""
    place = pgeo.select("pid", F.coalesce("cc", F.lit("ZZ")).alias("cc"))
    d = C.with_status(origin_rows(pathobs).join(place, ["pid"]), rpki, irr, origin="origin_asn")
    return d if totals is None else d.join(totals, ["pid"], "left")


def byorigin_view(pathsearch: DataFrame) -> DataFrame:
    """The same rows without the path totals that only a path search needs: a projection, the scan prunes the column."""
    return pathsearch.drop("observed_peers")


# ---- shared tail ------------------------------------------------------------

def low_vis_filter(df: DataFrame, dfz_ref: DataFrame) -> DataFrame:
    """Hide prefixes below the rounded-up visibility cut of their family."""
    ref = dfz_ref.select(F.col("family").alias("_f"), F.ceil(F.greatest(F.lit(3.0), F.col("dfz_ref") * 0.2)).alias("_cut"))
    j = df.withColumn("_f", ip.family_of("prefix")).join(F.broadcast(ref), ["_f"], "left")
    return j.where(F.col("n_paths") >= F.coalesce("_cut", F.lit(3))).drop("_f", "_cut")


def search_page(df: DataFrame, order: Sequence[Column], limit: int, page: int = 0) -> DataFrame:
    """One page of ``limit`` rows with ``pos`` and a ``more`` flag.

    The first page is a top-n. Deeper pages number the rows by range partitions and take a stretch, so no task
    gathers the rows before the page.
    """
    if page == 0:
        rows = df.orderBy(*order).limit(limit + 1)
        rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy().orderBy(*order)).cast("bigint"))
    else:
        first = page * limit
        rows = runs.numbered(df, "pos", order).where(F.col("pos").between(first + 1, first + limit + 1)).withColumn("pos", F.col("pos") - first)
    # at most limit + 1 rows from here on
    return rows.withColumn("more", F.count("*").over(Window.partitionBy()) > limit).where(F.col("pos") <= limit)


def search_sort(df: DataFrame, col: str, descending: bool = True) -> DataFrame:
    """Re-sort by any column; a NULL is the smallest value."""
    return df.orderBy(F.col(col).desc_nulls_last() if descending else F.col(col).asc_nulls_first())


# ---- path patterns ----------------------------------------------------------

def matched_peers(top_paths: DataFrame, query: str) -> DataFrame:
    """Per pid: peers of the matching paths and of all kept paths, one aggregation."""
    hit = P.path_query_parse(query).cond(F.col("path_str"))
    return top_paths.groupBy("pid").agg(
        F.sum(F.when(hit, F.col("n_peers")).otherwise(F.lit(0))).alias("matched_peers"),
        F.sum("n_peers").alias("observed_peers"))


def path_prefilter(top_paths: DataFrame, query: str) -> DataFrame:
    """pids with at least one path that passes the include part."""
    return top_paths.where(P.path_query_parse(query).include_cond(F.col("path_str"))).select("pid").distinct()


def with_hits(rows: DataFrame, hits: DataFrame, *, origins: Sequence[int] | None = None, cc: str | None = None) -> DataFrame:
    """(prefix, origin) rows of the prefixes in ``hits`` (pid, matched_peers, observed_peers), with ratio and majority.

    A global search keeps one row per prefix (``is_primary``). Order with ``path_order``.
    """
    d = rows
    if cc is not None:
        d = d.where(F.col("cc") == cc)
    if origins:
        d = d.where(F.col("origin_asn").isin(*origins))
    elif "is_primary" in d.columns:
        d = d.where("is_primary")
    return (d.drop("observed_peers").join(hits, ["pid"])
            .withColumn("match_ratio", P.match_ratio("matched_peers", "observed_peers"))
            .withColumn("dominant", P.match_dominant("matched_peers", "observed_peers")))


def search_path(rows: DataFrame, all_paths: DataFrame, query: str, *, origins: Sequence[int] | None = None, cc: str | None = None) -> DataFrame:
    """AS-path search over (prefix, origin) rows and path rows, without an index.

    The paths are filtered and summed per prefix first (a partial aggregate), so only prefixes with a match meet
    their rows. ``hops.matched_peers`` gives the same hits from a hop index.
    """
    return with_hits(rows, matched_peers(all_paths, query).where("matched_peers > 0"), origins=origins, cc=cc)


def path_order() -> list[Column]:
    return [F.desc("match_ratio"), F.desc("matched_peers"), F.desc("n_paths"), F.asc("pid")]


def search_path_unweighted(rows: DataFrame, all_paths: DataFrame, query: str) -> DataFrame:
    """Without weights: include on any path, no path with an excluded AS, hits on the best path flagged."""
    q = P.path_query_parse(query)
    d = rows.where("is_primary") if "is_primary" in rows.columns else rows
    path = F.col("path_str")
    include = q.include_cond(path) if q.include else F.lit(True)
    barred = F.lit(False)
    for a in q.excludes:
        barred = barred | path.contains(f" {a} ")
    hits = all_paths.groupBy("pid").agg(
        F.bool_or(include).alias("_in"), F.bool_or(barred).alias("_out"),
        F.bool_or(F.col("is_best") & (include if q.include else F.lit(False))).alias("best_hit")).where("_in AND NOT _out")
    return d.join(hits.drop("_in", "_out"), ["pid"])


# ---- filters by key ---------------------------------------------------------

def search_country(geo_full: DataFrame, cc: str, city: str | None = None, family: str = "all") -> DataFrame:
    d = geo_full.where(F.col("cc") == cc)
    if city:
        d = d.where(F.col("city") == city)
    return ip.fam_filter(d, family)


def search_origin(byorigin: DataFrame, asns: Sequence[int] | DataFrame) -> DataFrame:
    """Rows of given origins; secondary origins of a prefix stay."""
    if isinstance(asns, DataFrame):
        return byorigin.join(asns.select(F.col("asn").alias("origin_asn")), ["origin_asn"], "left_semi")
    return byorigin.where(F.col("origin_asn").isin(*asns))


def prefix_exact(prefixes: DataFrame, queries: DataFrame) -> DataFrame:
    """(q_start, q_end) -> the row with exactly that range, most observed first."""
    j = queries.join(prefixes, (F.col("ip_start") == F.col("q_start")) & (F.col("ip_end") == F.col("q_end")))
    best = F.max_by(F.struct("pid", "prefix", "n_paths"), F.struct(F.col("n_paths"), -F.col("pid")))
    return j.groupBy("q_start", "q_end").agg(best.alias("b")).select("q_start", "q_end", "b.*")


# ---- subnets and addresses --------------------------------------------------

def subnet_search(prefixes: DataFrame, queries: DataFrame, cols: Sequence[str] = ("pid", "prefix", "plen", "ip_start")) -> DataFrame:
    """All prefixes overlapping each query range (q_start, q_plen): covering or inside.

    CIDR ranges either nest or are apart, so two containment joins cover every case.
    """
    names = {c: c for c in dict.fromkeys([*cols, "plen", "ip_start"])}
    over = covering_join(queries, prefixes.select(*names), left_start="q_start", left_plen="q_plen", right_cols=names)
    keys = {c: c for c in queries.columns}
    inside = covering_join(prefixes.select(*names), queries, right_start="q_start", right_plen="q_plen",
                           strict=True, right_cols=keys)
    out = [*queries.columns, *names]
    return over.select(*out).unionByName(inside.select(*out))


def subnet_lookup(prefixes: DataFrame, start, end) -> DataFrame:
    """One interactive range as a pushed-down filter over address-sorted files."""
    return prefixes.where((F.col("ip_start") <= F.lit(end)) & (F.col("ip_end") >= F.lit(start)))


def subnet_order() -> list[Column]:
    return [F.desc("plen"), F.asc("ip_start")]


def ip_enrich(points: DataFrame, prefixes: DataFrame, point: str = "ip",
              cols: Sequence[str] = ("pid", "prefix", "origin_asn", "n_paths", "cc", "city", "province")) -> DataFrame:
    """Longest-prefix match: the narrowest prefix covering each address, with its facts."""
    have = [c for c in cols if c in prefixes.columns]
    return longest_match(points, prefixes, point=point, cols={c: c for c in have})


def enrich_text(rows: DataFrame, tables: Sequence[DataFrame], address: Column, cols: Sequence[str]) -> DataFrame:
    """Longest-prefix match of addresses given as text, each family in its own table; other rows get nulls."""
    # the one-element explode keeps the optimizer from copying the address expression into every use of it
    d = rows.withColumn("_text", F.explode(F.array(address))).withColumn("_six", F.coalesce(F.col("_text").contains(":"), F.lit(False)))
    sides = {ip.is_wide(t, "ip_start"): t for t in tables}
    facts = next(iter(sides.values()))
    out = None
    for wide in (False, True):
        part = d.where(F.col("_six") == wide)
        if wide in sides:
            part = part.withColumn("_ip", (ip.ip6_to_bin if wide else ip.ip4_to_int)("_text"))
            part = ip_enrich(part, sides[wide], "_ip", cols).drop("_ip")
        for c in cols:
            if c in facts.columns and c not in part.columns:
                part = part.withColumn(c, F.lit(None).cast(facts.schema[c].dataType))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.drop("_text", "_six")


def dns_enrich(answers: DataFrame, prefixes: DataFrame | Sequence[DataFrame], type_codes: dict[str, int]) -> DataFrame:
    """DNS answers (domain, qtype, atype, name, data) of the asked type; addresses get a prefix.

    ``prefixes`` is a table of one family or one of each; A looks in the first, AAAA in the second.
    """
    spark = answers.sparkSession
    codes = spark.createDataFrame(list(type_codes.items()), "qtype string, _code int")  # one row per record type
    d = answers.join(F.broadcast(codes), ["qtype"]).where(F.col("atype") == F.col("_code")).drop("_code")
    quoted = F.startswith(F.col("data"), F.lit('"')) & F.endswith(F.col("data"), F.lit('"'))
    unq = F.when(quoted, F.array_join(F.regexp_extract_all("data", F.lit('"([^"]*)"'), 1), "")).otherwise(F.col("data"))  # strings of one value are joined
    d = d.withColumn("data", F.when(F.col("qtype") == "TXT", unq).otherwise(F.col("data")))
    tables = [prefixes] if isinstance(prefixes, DataFrame) else list(prefixes)
    return enrich_text(d, tables, F.when(F.col("qtype").isin("A", "AAAA"), F.col("data")),
                       ("pid", "prefix", "origin_asn", "n_paths", "cc", "city", "province"))


def prefix_relatives(prefix: DataFrame, up: int | None = None, down: int | None = None) -> DataFrame:
    """(pid, side, pos, rel_pid, rel_prefix): enclosing prefixes narrowest first, contained by start.

    All of them, or the first ``up`` and ``down``; either way a very wide prefix never gathers
    all of its contents in one task.
    """
    p = prefix.select("pid", "ip_start", "plen")
    r = prefix.select("pid", "prefix", "ip_start", "plen")
    pairs = covering_join(p, r, strict=True, right_cols={"pid": "a_pid", "plen": "a_plen", "prefix": "a_prefix"})
    sup = runs.ranked(pairs, "pos", [F.desc("a_plen")], ["pid"], up).select(
        "pid", F.lit("sup").alias("side"), "pos", F.col("a_pid").alias("rel_pid"))
    sub = runs.ranked(pairs, "pos", [F.col("ip_start"), F.col("plen")], ["a_pid"], down).select(
        F.col("a_pid").alias("pid"), F.lit("sub").alias("side"), "pos", F.col("pid").alias("rel_pid"))
    names = prefix.select(F.col("pid").alias("rel_pid"), F.col("prefix").alias("rel_prefix"))
    return sup.unionByName(sub).join(names, ["rel_pid"]).withColumn("pos", F.col("pos").cast("bigint"))


# ---- detail rows ------------------------------------------------------------

def _listed(df: DataFrame, key: str, order: Column, item: Column, out: str) -> DataFrame:
    """Ordered array per key; callers bound the group first."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("i")))),
                                           lambda x: x["i"]).alias(out))


def prefix_detail(pgeo: DataFrame, top_paths: DataFrame, relatives: DataFrame, irr_objects: DataFrame | None = None) -> DataFrame:
    """Prefix facts + all kept paths + origins + relatives + route objects, one nested row each."""
    arr = F.coalesce("path_arr_raw", "path_arr")
    plist = _listed(top_paths, "pid", F.struct(F.col("path_len"), -F.col("n_peers"), P.path_text(arr)),
                    F.struct(P.path_text(arr).alias("path"), F.col("n_peers").alias("peers"), F.col("is_best")), "paths")
    ends = top_paths.groupBy("pid", P.path_origin("path_arr").alias("asn")).agg(
        F.sum("n_peers").alias("peers"), F.count("*").alias("paths"))
    single = _listed(ends.where("asn IS NOT NULL"), "pid", F.struct(-F.col("peers"), -F.col("paths"), F.col("asn")),
                     F.struct("asn", "peers", "paths"), "_single")
    multi = F.transform(F.arrays_zip("origin_asns", "origin_npaths"), lambda x: F.struct(
        x["origin_asns"].alias("asn"), x["origin_npaths"].alias("peers"), F.lit(0).cast("bigint").alias("paths")))
    side = lambda s: _listed(relatives.where(F.col("side") == s), "pid", F.col("pos"), F.col("rel_prefix"), s)
    d = (pgeo.join(plist, ["pid"], "left").join(single, ["pid"], "left")
         .join(side("sup"), ["pid"], "left").join(side("sub"), ["pid"], "left"))
    d = d.withColumn("origins", F.coalesce(multi, "_single") if "origin_asns" in pgeo.columns else F.col("_single")).drop("_single")
    if irr_objects is not None:
        objs = _listed(irr_objects, "pid", F.col("origin"), F.struct("origin", "sources"), "irr_objects")
        d = d.join(objs, ["pid"], "left")
    return d


def probe_report(points: DataFrame, prefixes: DataFrame, top_paths: DataFrame, upstreams: DataFrame, point: str = "ip") -> DataFrame:
    """Address -> prefix, origin, place, upstreams, path list."""
    hit = ip_enrich(points, prefixes, point)
    ups = _listed(upstreams, "pid", F.col("pos"), F.struct("asn", "n"), "upstreams")
    arr = F.coalesce("path_arr_raw", "path_arr")
    pl = _listed(top_paths, "pid", F.struct(F.when(F.col("is_best"), 0).otherwise(1), F.col("path_len"), -F.col("n_peers"), P.path_text(arr)),
                 P.path_text(arr), "paths")
    return hit.join(ups, ["pid"], "left").join(pl, ["pid"], "left")


def asn_overview(byorigin: DataFrame, counts: DataFrame, names: DataFrame, relations: DataFrame,
                 member_of: DataFrame | None = None, networks: DataFrame | None = None, top: int | None = None) -> DataFrame:
    """One nested row per origin: counts, names, top prefixes, relations, memberships."""
    best = runs.ranked(byorigin.select("origin_asn", "pid", "prefix", "n_paths"), "_rn", [F.desc("n_paths"), F.col("pid")], ["origin_asn"], top)
    pl = _listed(best, "origin_asn", F.col("_rn"), F.col("prefix"), "prefixes").withColumnRenamed("origin_asn", "asn")
    rel = relations.groupBy("asn").agg(*[F.count_if(F.col("rel") == r).alias(f"n_{r}") for r in ("up", "peer", "down")])
    d = (counts.withColumnRenamed("origin_asn", "asn").join(names, ["asn"], "left").join(pl, ["asn"], "left")
         .join(rel, ["asn"], "left"))
    if member_of is not None:
        m = member_of.where(F.col("member").rlike("^AS[0-9]+$")).withColumn(
            "asn", F.substring("member", F.lit(3), F.length("member")).try_cast("bigint"))
        d = d.join(_listed(m, "asn", F.col("parent_key"), F.col("parent_key"), "member_of"), ["asn"], "left")
    if networks is not None:
        d = d.join(networks.select("asn", F.col("name").alias("pdb_name"), "info_type"), ["asn"], "left")
    return d


# ---- export -----------------------------------------------------------------

def export_rows(df: DataFrame, order: Sequence[Column], cols: dict[str, Column], cap: int | None = None) -> DataFrame:
    """Chosen and derived columns of a search in order, all rows or the first ``cap``."""
    ordered = df.orderBy(*order)
    return (ordered if cap is None else ordered.limit(cap)).select(*[c.alias(n) for n, c in cols.items()])


def match_share_text() -> Column:
    share = F.when(F.col("observed_peers") > 0, F.col("matched_peers") / F.col("observed_peers") * 100).otherwise(F.lit(0.0))
    return F.concat(F.format_string("%.2f", share), F.lit("%"))
