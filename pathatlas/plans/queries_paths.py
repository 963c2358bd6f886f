"""Consolidation and AS-path queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import consolidate as C
from ..operators import counts as N
from ..operators import hops as H
from .catalog import T1, all_paths, obs, pathobs, prefix, query, top_paths

_PREFIX_COLS = ("prefix", "ip_start", "ip_end", "plen")


@query("obs_dedup", """SELECT collector, prefix, path_raw, path_clean, CAST(len(string_split(path_raw, ' ')) AS INTEGER) AS path_len,
  origin_asn, count(*) AS n_peers FROM fx_rib GROUP BY ALL""")
def obs_dedup(t):
    return obs(t).select("collector", "prefix", "path_raw", "path_clean", "path_len", "origin_asn", "n_peers")


@query("src_rib_filters", """SELECT collector, prefix, count(*) AS n FROM (SELECT *,
  dense_rank() OVER (PARTITION BY collector ORDER BY ip_start, plen) AS r FROM (SELECT DISTINCT collector, prefix, path_raw, ip_start, plen FROM fx_rib) d) x WHERE r <= 500 GROUP BY collector, prefix""")
def src_rib_filters(t):
    return C.src_rib_filters(obs(t), family=4, first_prefixes=500).groupBy("collector", "prefix").agg(F.count("*").alias("n"))


@query("pathobs_merge", "SELECT prefix, path_raw, path_clean, path_len, origin_asn, n_peers FROM o_pathobs")
def pathobs_merge(t):
    return C.pathobs_merge(obs(t)).select("prefix", "path_raw", "path_clean", "path_len", "origin_asn", "n_peers")


@query("prefix_agg", "SELECT prefix, ip_start, ip_end, plen, origin_asn, n_origins, n_paths, n_distinct_paths FROM o_prefix")
def prefix_agg(t):
    return C.prefix_agg(C.pathobs_merge(obs(t))).select(*_PREFIX_COLS, "origin_asn", "n_origins", "n_paths", "n_distinct_paths")


@query("repr_origin", "SELECT prefix, origin_asn FROM o_prefix")
def repr_origin(t):
    return C.repr_origin(C.pathobs_merge(obs(t)))


@query("pid_assign", "SELECT row_number() OVER (ORDER BY ip_start, prefix) AS pid, prefix, n_paths FROM o_prefix")
def pid_assign(t):
    return C.pid_assign(prefix(t).drop("pid")).select("pid", "prefix", "n_paths")


def _topk(cap):
    return f"""SELECT pid, ' ' || path_clean || ' ' AS path_str, CASE WHEN path_raw <> path_clean THEN path_raw END AS raw_text,
  path_len, n_peers, rn = 1 AS is_best FROM o_ranked WHERE rn <= {cap}"""


@query("paths_topk", _topk(1_000_000_000))
def paths_topk(t):
    return top_paths(t).select("pid", "path_str", P.path_text("path_arr_raw").alias("raw_text"), "path_len", "n_peers", "is_best")


@query("paths_topk_small_cap", _topk(8))
def paths_topk_small_cap(t):
    return C.paths_topk(pathobs(t), 8).select(
        "pid", "path_str", P.path_text("path_arr_raw").alias("raw_text"), "path_len", "n_peers", "is_best")


@query("path_bundle", "SELECT pid, part, bundle FROM o_bundle")
def path_bundle(t):
    return C.path_bundle(all_paths(t)).select("pid", "part", C.bundle_text("bundle").alias("bundle"))


@query("route_origin", "SELECT DISTINCT pid, origin_asn AS origin, ip_start, plen FROM o_pathobs")
def route_origin(t):
    return C.route_origin(pathobs(t)).select("pid", "origin", "ip_start", "plen")


@query("dfz_ref", "SELECT family, dfz_ref FROM o_dfz")
def dfz_ref(t):
    return C.dfz_ref(prefix(t))


@query("low_visibility", """SELECT p.prefix, p.n_paths, CAST(ceil(greatest(3.0, 0.2 * d.dfz_ref)) AS BIGINT) AS low_cut,
  p.n_paths < greatest(3.0, 0.2 * d.dfz_ref) AS low_vis FROM o_prefix p JOIN o_dfz d ON d.family = p.family""")
def low_visibility(t):
    p = prefix(t)
    return C.low_visibility(p, C.dfz_ref(p)).select("prefix", "n_paths", "low_cut", "low_vis")


@query("origin_counts", """SELECT origin_asn, count(DISTINCT pid) FILTER (WHERE family = 4) AS n_v4,
  count(DISTINCT pid) FILTER (WHERE family = 6) AS n_v6 FROM o_pathobs GROUP BY origin_asn""")
def origin_counts(t):
    return C.origin_counts(pathobs(t))


@query("asn_seen", "SELECT DISTINCT unnest(path_arr) AS asn FROM o_paths UNION SELECT origin_asn FROM o_prefix")
def asn_seen(t):
    return C.asn_seen(all_paths(t), prefix(t))


# ---- AS-path functions ------------------------------------------------------

@query("path_clean", "SELECT DISTINCT path_raw, path_clean AS cleaned FROM fx_rib")
def path_clean(t):
    return t["fx_rib"].select("path_raw").distinct().withColumn(
        "cleaned", P.path_text(P.path_clean(P.path_array("path_raw"))))


@query("path_origin", "SELECT DISTINCT path_raw, string_split(path_raw, ' ')[-1]::BIGINT AS origin FROM fx_rib")
def path_origin(t):
    return t["fx_rib"].select("path_raw").distinct().withColumn("origin", P.path_origin(P.path_array("path_raw")))


@query("path_len", "SELECT DISTINCT path_raw, CAST(len(path_raw) - len(replace(path_raw, ' ', '')) + 1 AS INTEGER) AS n FROM fx_rib")
def path_len(t):
    return t["fx_rib"].select("path_raw").distinct().withColumn("n", P.path_len(P.path_array("path_raw")))


@query("path_tokens", f"""SELECT path_raw, asn, CAST(count(*) AS INTEGER) AS rep, asn IN ({T1}) AS tier1 FROM (
  SELECT DISTINCT path_raw, unnest(string_split(path_raw, ' ')::BIGINT[]) AS asn, unnest(range(1, len(string_split(path_raw, ' ')) + 1)) AS i FROM fx_rib) x GROUP BY path_raw, asn""")
def path_tokens(t):
    d = t["fx_rib"].select("path_raw").distinct().select("path_raw", F.explode(P.path_tokens(P.path_array("path_raw"))).alias("k"))
    return d.select("path_raw", "k.asn", "k.rep", P.is_tier1("k.asn").alias("tier1"))


@query("strip_feeder", """SELECT DISTINCT collector, path_raw, CASE WHEN collector = 'c1' AND peer_asn = 101 THEN path_raw[5:] ELSE path_raw END AS stripped FROM fx_rib""")
def strip_feeder(t):
    d = t["fx_rib"].select("collector", "path_raw").distinct()
    return d.withColumn("stripped", P.path_text(P.strip_feeder(P.path_array("path_raw"), "collector", "c1", 101)))


@query("path_contains_seq", """SELECT DISTINCT path_raw, ' ' || path_raw || ' ' LIKE '% 1299 3004 %' AS hit FROM fx_rib""")
def path_contains_seq(t):
    return t["fx_rib"].select("path_raw").distinct().withColumn(
        "hit", P.path_contains_seq(P.path_array("path_raw"), [1299, 3004]))


_PATTERNS = {"adjacent": "1299 3004", "gap": "100 * 64510", "one_hop": "1299 ? 64510", "exclude": "101 * 64510 !174",
             "arrow": "1299->3004, -101", "only_exclude": "!1299"}


@query("path_match", """SELECT DISTINCT path_clean, ' ' || path_clean || ' ' LIKE '% 1299 3004 %' AS adjacent,
  list_position(a, 100) < list_position(a, 64510) AND list_contains(a, 100) AND list_contains(a, 64510) AS gap,
  list_contains(a, 1299) AND coalesce(a[list_position(a, 1299) + 2] = 64510, FALSE) AS one_hop,
  coalesce(list_position(a, 101) < list_position(a, 64510), FALSE) AND list_contains(a, 101) AND list_contains(a, 64510) AND NOT list_contains(a, 174) AS exclude,
  ' ' || path_clean || ' ' LIKE '% 1299 3004 %' AND NOT list_contains(a, 101) AS arrow, NOT list_contains(a, 1299) AS only_exclude
  FROM (SELECT path_clean, string_split(path_clean, ' ')::BIGINT[] AS a FROM fx_rib) x""".replace(
    "list_position(a, 100) < list_position(a, 64510) AND", "coalesce(list_position(a, 100) < list_position(a, 64510), FALSE) AND"))
def path_match(t):
    d = t["fx_rib"].select("path_clean").distinct()
    return d.select("path_clean", *[P.path_match("path_clean", q).alias(k) for k, q in _PATTERNS.items()])


_PARSED = {"* 1299 *": "list_contains(a, 1299)", " 1299,3004 ": "strpos(p, ' 1299 3004 ') > 0", "100 ?? 64510": "a[1] = 100 AND a[4] = 64510",
           "junk 101 * ? 64510 !174 -6939": "list_contains(a, 101) AND list_contains(a, 64510) AND list_position(a, 101) < list_position(a, 64510) AND NOT list_has_any(a, [174, 6939]::BIGINT[])",
           "": "TRUE", "? *": "TRUE"}


@query("path_query_parse", " UNION ALL ".join(f"""SELECT '{q}' AS pattern, count(*) AS n FROM (SELECT DISTINCT ' ' || path_clean || ' ' AS p, string_split(path_clean, ' ')::BIGINT[] AS a FROM fx_rib) x WHERE {c}"""
                                              for q, c in _PARSED.items()))
def path_query_parse(t):
    d = t["fx_rib"].select("path_clean").distinct()
    hits = F.array(*[F.struct(F.lit(q).alias("pattern"), F.when(P.path_match("path_clean", q), 1).otherwise(0).alias("hit")) for q in _PARSED])
    return d.select(F.explode(hits).alias("h")).groupBy("h.pattern").agg(F.sum("h.hit").alias("n"))


@query("matched_peers", """SELECT p.pid, CAST(coalesce(sum(o.n_peers) FILTER (WHERE list_contains(o.path_arr, 1299) AND NOT list_contains(o.path_arr, 101)), 0) AS BIGINT) AS matched_peers,
  CAST(sum(o.n_peers) AS BIGINT) AS observed_peers FROM o_prefix p JOIN o_paths o ON o.pid = p.pid GROUP BY p.pid""")
def matched_peers(t):
    from ..operators import search as S
    return S.matched_peers(all_paths(t), "1299 !101")


@query("path_prefilter", "SELECT DISTINCT pid FROM o_paths WHERE list_contains(path_arr, 6939)")
def path_prefilter(t):
    return H.path_prefilter(H.build(all_paths(t)), "6939")


@query("match_dominance", """SELECT pid, m / o::DOUBLE AS ratio, 2 * m > o AS dominant FROM (
  SELECT pid, coalesce(sum(n_peers) FILTER (WHERE list_contains(path_arr, 1299)), 0) AS m, sum(n_peers) AS o FROM o_paths GROUP BY pid) x""")
def match_dominance(t):
    from ..operators import search as S
    m = S.matched_peers(all_paths(t), "1299")
    return m.select("pid", P.match_ratio("matched_peers", "observed_peers").alias("ratio"),
                    P.match_dominant("matched_peers", "observed_peers").alias("dominant"))


@query("trunc_to_tier1", f"""SELECT DISTINCT path_raw, array_to_string(CASE WHEN f IS NOT NULL THEN a[f:] WHEN len(a) > 1 THEN a[2:] ELSE a END, ' ') AS cut
  FROM (SELECT path_raw, a, list_min([i FOR x, i IN a IF x IN ({T1})]) AS f FROM (SELECT path_raw, string_split(path_raw, ' ')::BIGINT[] AS a FROM fx_rib) y) z""")
def trunc_to_tier1(t):
    return t["fx_rib"].select("path_raw").distinct().withColumn(
        "cut", P.path_text(P.trunc_to_tier1(P.path_array("path_raw"))))


_RAW_CUT = f"""SELECT pid, n_peers, is_best, path_len, path_raw, len(path_arr) AS clean_len, raw_arr[list_min([i FOR x, i IN raw_arr IF x IN ({T1})]):] AS a FROM o_paths
  WHERE len([x FOR x IN path_arr IF x IN ({T1})]) > 0"""
_NODES = """SELECT pid, n_peers, path_raw, asn, min(d) AS d FROM (SELECT pid, n_peers, path_raw, len(a) - i AS d, a[i] AS asn FROM (
  SELECT pid, n_peers, path_raw, a, unnest(range(1, len(a) + 1)) AS i FROM cutp) q) r GROUP BY ALL"""
_EDGES = """SELECT pid, n_peers, path_raw, lead(asn) OVER w AS au, lead(d) OVER w AS du, asn AS av, d AS dv FROM nodes WINDOW w AS (PARTITION BY pid, path_raw ORDER BY d)"""


def _with(*parts):
    return "WITH " + ", ".join(f"{n} AS ({s})" for n, s in parts) + " "


_GRAPH = f"(SELECT * FROM (WITH cutp AS ({_RAW_CUT}), nodes AS ({_NODES}) {_EDGES}) e0 WHERE au IS NOT NULL)"


@query("route_graph", f"""SELECT pid, au, CAST(du AS INTEGER) AS du, av, CAST(dv AS INTEGER) AS dv, CAST(du - dv AS INTEGER) AS span, CAST(sum(n_peers) AS BIGINT) AS weight
  FROM {_GRAPH} e GROUP BY ALL""")
def route_graph(t):
    from ..operators import relations as R
    return R.route_graph(top_paths(t))[1]


@query("route_graph_nodes", f"""SELECT DISTINCT pid, asn, CAST(d AS INTEGER) AS d FROM (WITH cutp AS ({_RAW_CUT}) {_NODES}) n""")
def route_graph_nodes(t):
    from ..operators import relations as R
    return R.route_graph(top_paths(t))[0]


@query("route_graph_main", f"""SELECT e.pid, e.au, CAST(e.du AS INTEGER) AS du, e.av, CAST(e.dv AS INTEGER) AS dv FROM {_GRAPH} e JOIN (
  SELECT pid, path_raw, row_number() OVER (PARTITION BY pid ORDER BY n_peers DESC, is_best DESC, clean_len, path_raw) AS r FROM ({_RAW_CUT}) c) b
  ON b.pid = e.pid AND b.path_raw = e.path_raw AND b.r = 1""")
def route_graph_main(t):
    from ..operators import relations as R
    return R.route_graph_main(top_paths(t))


@query("tier1_transit", f"""WITH p AS (SELECT pid, [x FOR x IN path_arr IF x IN ({T1})] AS h FROM o_paths)
  SELECT pid, 'seen' AS what, unnest(h) AS a, CAST(NULL AS BIGINT) AS b FROM p UNION SELECT pid, 'entry', h[1], NULL FROM p WHERE len(h) > 0
  UNION SELECT pid, 'pair', h[i], h[i + 1] FROM (SELECT pid, h, unnest(range(1, len(h))) AS i FROM p) x WHERE h[i] <> h[i + 1]""")
def tier1_transit(t):
    from ..operators import relations as R
    return R.tier1_transit(all_paths(t))


@query("upstream_summary", """SELECT pid, asn, n, CAST(r AS BIGINT) AS pos FROM (SELECT pid, asn, n, row_number() OVER (PARTITION BY pid ORDER BY n DESC, asn) AS r FROM (
  SELECT pid, path_arr[-2] AS asn, count(*) AS n FROM o_paths GROUP BY ALL) a) b""")
def upstream_summary(t):
    from ..operators import relations as R
    return R.upstream_summary(all_paths(t))


# ---- counts and directories -------------------------------------------------

_CC_OF = "SELECT 64500 + s_suppkey AS asn, CASE s_nationkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' ELSE 'JP' END AS cc FROM supplier"
_DIR = f"""SELECT cc, asn, total, row_number() OVER (PARTITION BY cc ORDER BY total DESC, asn) AS pos FROM (
  SELECT a.cc, o.origin_asn AS asn, count(DISTINCT pid) AS total FROM o_pathobs o JOIN ({_CC_OF}) a ON a.asn = o.origin_asn GROUP BY ALL) d"""


@query("top_prefixes_per_asn", """SELECT origin_asn, prefix, cc, n_paths, CAST(origin_asn % 256 AS INTEGER) AS bucket, r AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY origin_asn ORDER BY n_paths DESC, prefix) AS r FROM (
    SELECT DISTINCT o.origin_asn, p.prefix, coalesce(p.cc, 'ZZ') AS cc, p.n_paths FROM o_pathobs o JOIN o_pgeo p ON p.pid = o.pid) x) y""", shared=True)
def top_prefixes_per_asn(t):
    from .queries_search import byorigin
    return N.top_prefixes_per_asn(byorigin(t))


@query("networks_by_country", _DIR)
def networks_by_country(t):
    return N.networks_by_country(C.origin_counts(pathobs(t)), t.sql(_CC_OF))


@query("networks_by_country_totals", f"SELECT cc, count(*) AS n FROM ({_DIR}) d GROUP BY cc")
def networks_by_country_totals(t):
    return N.directory_totals(N.networks_by_country(C.origin_counts(pathobs(t)), t.sql(_CC_OF)))


@query("directory_page", f"""WITH d AS ({_DIR}), c AS (SELECT *, ceil(count(*) OVER (PARTITION BY cc) / 7.0) AS pages FROM d)
  SELECT cc, asn, total, pos, CAST(pages AS BIGINT) AS pages, CAST(least(2, pages) AS BIGINT) AS page FROM c WHERE ceil(pos / 7.0) = least(2, pages)""")
def directory_page(t):
    return N.directory_page(N.networks_by_country(C.origin_counts(pathobs(t)), t.sql(_CC_OF)), page=2, size=7)


@query("ixps_by_country", """SELECT upper(country) AS cc, ix_id, name, city, net_count, row_number() OVER (PARTITION BY upper(country) ORDER BY net_count DESC, name, ix_id) AS pos
  FROM (SELECT i.*, (SELECT count(DISTINCT asn) FROM fx_pdb_netixlan n WHERE n.ix_id = i.ix_id) AS net_count FROM fx_pdb_ix i) x WHERE regexp_full_match(country, '[A-Za-z]{2}')""")
def ixps_by_country(t):
    from .queries_sets import pdb_ix
    return N.ixps_by_country(pdb_ix(t))


@query("asn_names", """WITH h AS (SELECT asn, name FROM fx_asn_name WHERE kind = 'handle'), c AS (SELECT asn, name FROM fx_asn_name WHERE kind = 'curated')
  SELECT s.asn, coalesce(c.name, h.name) AS name, h.name AS name_en, n.name AS org FROM (SELECT DISTINCT unnest(path_arr) AS asn FROM o_paths) s
  LEFT JOIN h USING (asn) LEFT JOIN c USING (asn) LEFT JOIN fx_pdb_net n USING (asn) WHERE coalesce(c.name, h.name, n.name) IS NOT NULL""")
def asn_names(t):
    names = t["fx_asn_name"]
    seen = C.asn_seen(all_paths(t), prefix(t))
    handles = names.where("kind = 'handle'").select("asn", F.col("name").alias("handle"))
    curated = names.where("kind = 'curated'").select("asn", "name", F.lit(None).cast("string").alias("name_en"))
    orgs = t["fx_pdb_net"].select("asn", F.col("name").alias("org"))
    return N.asn_names(seen, handles, curated, orgs)


_STATS = """SELECT (SELECT count(*) FROM o_prefix) AS prefixes, (SELECT count(*) FROM o_prefix p JOIN fx_v6 v ON v.pk = p.pid) AS prefixes_v6,
  (SELECT count(*) FROM o_pathobs) AS paths, (SELECT count(*) FROM o_pathobs p JOIN fx_v6 v ON v.pk = p.pid) AS paths_v6, (SELECT dfz_ref FROM o_dfz) AS dfz_ref,
  (SELECT greatest(CAST(round(quantile_cont(p.n_paths, 0.9)) AS BIGINT), 1) FROM o_prefix p JOIN fx_v6 v ON v.pk = p.pid) AS dfz_ref_v6, (SELECT count(*) FROM fx_geo_raw) AS segments"""
_KEYS = ("prefixes", "prefixes_v6", "dfz_ref", "dfz_ref_v6", "paths", "paths_v6", "segments")


def both_families(t):
    from .queries_geo import pathobs6, prefix6
    return (prefix(t).select("family", "n_paths").unionByName(prefix6(t).select("family", "n_paths")),
            pathobs(t).select("family").unionByName(pathobs6(t).select("family")))


@query("snapshot_stats", f"""SELECT *, sha1('{{' || {" || ',' || ".join(f"'{chr(34)}{k}{chr(34)}:' || {k}" for k in _KEYS)} || '}}')[1:12] AS version FROM ({_STATS}) s""", shared=True)
def snapshot_stats(t):
    return N.snapshot_stats(*both_families(t), t["fx_geo_raw"])


@query("overview_counts", """SELECT 'prefixes' AS metric, count(*) AS n FROM o_prefix UNION ALL SELECT 'prefixes_v6', count(*) FROM o_prefix p JOIN fx_v6 v ON v.pk = p.pid
  UNION ALL SELECT 'paths', count(*) + (SELECT count(*) FROM o_pathobs p JOIN fx_v6 v ON v.pk = p.pid) FROM o_pathobs UNION ALL SELECT 'countries', count(DISTINCT cc) FROM o_pgeo""", shared=True)
def overview_counts(t):
    from .queries_geo import pgeo
    return N.overview_counts(N.snapshot_stats(*both_families(t)), N.country_counts(pgeo(t)))
