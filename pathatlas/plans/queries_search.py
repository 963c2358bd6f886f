"""Adjacency, search and detail queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ip
from ..operators import consolidate as C
from ..operators import counts as N
from ..operators import grams as T
from ..operators import hops as H
from ..operators import parts as PT
from ..operators import relations as R
from ..operators import search as S
from ..operators import validate as V
from .catalog import T1, all_paths, pathobs, prefix, query, top_paths
from .queries_geo import _WORK, irr, pgeo, rpki, v6, working_set


def pathsearch(t):
    return S.pathsearch_build(pgeo(t), pathobs(t), C.path_totals(top_paths(t)), rpki(t), irr(t))


def byorigin(t):
    """The slim rows: built without the path totals, as column pruning would."""
    return S.pathsearch_build(pgeo(t), pathobs(t), None, rpki(t), irr(t))


def neigh(t):
    return R.asn_neigh(all_paths(t))


@query("asn_neigh", "SELECT n.*, p.prefix AS ev_prefix FROM o_neigh n JOIN fx_prefix p ON p.pk = n.ev_pid")
def asn_neigh(t):
    return R.asn_neigh(all_paths(t), t["fx_prefix"].withColumnRenamed("pk", "pid"))


@query("neigh_scan", "SELECT asn, neighbor, d, u, w, wd FROM o_neigh WHERE asn = 1299")
def neigh_scan(t):
    return R.neigh_scan(all_paths(t), 1299)


@query("neighbor_counts", "SELECT asn, count(*) AS n_neighbors FROM o_neigh GROUP BY asn")
def neighbor_counts(t):
    return N.neighbor_counts(neigh(t))


_REL = f"""SELECT *, CASE WHEN asn IN ({T1}) AND neighbor IN ({T1}) THEN 'peer' WHEN neighbor IN ({T1}) THEN 'up' WHEN d + u = 0 THEN 'peer'
  WHEN d >= 0.8 * (d + u) THEN 'down' WHEN asn NOT IN ({T1}) AND d <= 0.2 * (d + u) THEN 'up' ELSE 'peer' END AS rel FROM o_neigh"""


@query("relation_classify", f"SELECT asn, neighbor, rel FROM ({_REL}) r")
def relation_classify(t):
    return R.relation_classify(neigh(t)).select("asn", "neighbor", "rel")


@query("relation_groups", f"""SELECT asn, rel, neighbor, n, row_number() OVER (PARTITION BY asn, rel ORDER BY n DESC, neighbor) AS pos FROM (
  SELECT asn, rel, neighbor, CASE WHEN rel = 'peer' THEN d + u + w + wd ELSE d + u END AS n FROM ({_REL}) r) x""")
def relation_groups(t):
    return R.relation_groups(neigh(t)).select("asn", "rel", "neighbor", "n", "pos")


@query("relation_evidence", """SELECT asn, neighbor, pid, path, side FROM (SELECT n.asn, n.neighbor, p.pid, array_to_string(p.path_arr, ' ') AS path,
  CASE WHEN p.path_arr[list_position(p.path_arr, n.asn) + 1] = n.neighbor THEN 'd' ELSE 'u' END AS side,
  row_number() OVER (PARTITION BY n.asn, n.neighbor ORDER BY p.path_len, array_to_string(p.path_arr, ' ')) AS r FROM o_neigh n JOIN o_paths p ON p.pid = n.ev_pid
  WHERE list_position(p.path_arr, n.asn) > 0 AND (p.path_arr[list_position(p.path_arr, n.asn) + 1] = n.neighbor
    OR (list_position(p.path_arr, n.asn) > 1 AND p.path_arr[list_position(p.path_arr, n.asn) - 1] = n.neighbor))) x WHERE r = 1""")
def relation_evidence(t):
    return R.relation_evidence(neigh(t), all_paths(t))


_PS = "pid, prefix, cc, origin_asn, n_origins, n_paths, is_primary, rpki, irr"


@query("pathsearch_build", f"SELECT {_PS}, observed_peers, best_path FROM o_pathsearch", shared=True)
def pathsearch_build(t):
    return pathsearch(t).drop("family")


@query("byorigin_view", f"SELECT {_PS}, best_path FROM o_pathsearch", shared=True)
def byorigin_view(t):
    return S.byorigin_view(pathsearch(t)).drop("family")


@query("search_origin", f"SELECT {_PS} FROM o_pathsearch WHERE origin_asn IN (64510, 64511)", shared=True)
def search_origin(t):
    return S.search_origin(byorigin(t), [64510, 64511]).drop("family")


@query("search_origin_by_name", f"SELECT {_PS} FROM o_pathsearch WHERE origin_asn IN (SELECT asn FROM fx_asn_name WHERE strpos(lower(name), '#00000001') > 0)", shared=True)
def search_origin_by_name(t):
    from ..functions.text import asn_name_search
    names = t["fx_asn_name"]
    found = T.candidates(names, T.gram_index(names, ["asn"], [F.col("name")]), ["asn"], "#00000001")
    return S.search_origin(byorigin(t), asn_name_search(found, "#00000001")).drop("family")


@query("search_country", f"SELECT pid, prefix, city, province, plen, origin_asn, n_paths, segs, best_path FROM ({_WORK}) w WHERE cc = 'CN' AND city = 'city1'", shared=True)
def search_country(t):
    return S.search_country(working_set(t), "CN", "city1").select(
        "pid", "prefix", "city", "province", "plen", "origin_asn", "n_paths", F.array_join("segs", " ").alias("segs"), "best_path")


def _matched(cond):
    return f"(SELECT pid, CAST(coalesce(sum(n_peers) FILTER (WHERE {cond}), 0) AS BIGINT) AS matched_peers FROM o_paths GROUP BY pid)"


def _search_path_sql(cond, keep, cols="s.pid, s.prefix, s.origin_asn, s.n_paths, m.matched_peers, s.observed_peers"):
    return f"""SELECT {cols}, m.matched_peers / s.observed_peers::DOUBLE AS match_ratio, 2 * m.matched_peers > s.observed_peers AS dominant
  FROM o_pathsearch s JOIN {_matched(cond)} m ON m.pid = s.pid WHERE m.matched_peers > 0 AND {keep}"""


_COLS = ("pid", "prefix", "origin_asn", "n_paths", "matched_peers", "observed_peers", "match_ratio", "dominant")


def _by_index(t, pattern, **where):
    return S.with_hits(S.origin_rows(pathobs(t)), H.matched_peers(H.build(all_paths(t)), pattern), **where)


@query("search_path", _search_path_sql("list_contains(path_arr, 1299)", "s.is_primary"), shared=True)
def search_path(t):
    return _by_index(t, "1299").select(*_COLS)


@query("search_path_pattern", _search_path_sql("path_arr[1] = 101 AND list_contains(path_arr, 64510) AND NOT list_contains(path_arr, 174)", "s.is_primary"), shared=True)
def search_path_pattern(t):
    return _by_index(t, "101 * 64510 !174").select(*_COLS)


@query("search_path_in_origin", _search_path_sql("list_contains(path_arr, 6939)", "s.origin_asn = 64520"), shared=True)
def search_path_in_origin(t):
    return _by_index(t, "6939", origins=[64520]).select(*_COLS)


@query("search_path_scan", _search_path_sql("list_contains(path_arr, 3004) AND coalesce(path_arr[list_position(path_arr, 3004) - 1] = 1299, FALSE)", "s.is_primary"), shared=True)
def search_path_scan(t):
    return S.search_path(S.origin_rows(pathobs(t)), all_paths(t), "1299 3004").select(*_COLS)


@query("search_path_adjacent", _search_path_sql("list_contains(path_arr, 3004) AND coalesce(path_arr[list_position(path_arr, 3004) - 1] = 1299, FALSE)", "s.is_primary"), shared=True)
def search_path_adjacent(t):
    return _by_index(t, "1299 3004").select(*_COLS)


@query("hop_index", 'SELECT DISTINCT CAST(asn AS BIGINT) AS asn, trim(path_str) AS path, "at" FROM (SELECT path_str, unnest(path_arr) AS asn, unnest(range(0, len(path_arr)))::INTEGER AS "at" FROM o_paths) x')
def hop_index(t):
    rows = all_paths(t)
    names = rows.select(F.trim("path_str").alias("path")).distinct().withColumn("path_id", H.path_id(F.col("path")))
    return H.sorted_hops(H.hop_rows(rows)).join(names, ["path_id"]).select("asn", "path", "at")


@query("search_path_unweighted", """SELECT s.pid, s.n_paths, list_contains(string_split(trim(s.best_path), ' '), '1299') AS best_hit FROM o_pathsearch s WHERE s.is_primary
  AND EXISTS (SELECT 1 FROM o_paths p WHERE p.pid = s.pid AND list_contains(p.path_arr, 1299)) AND NOT EXISTS (SELECT 1 FROM o_paths p WHERE p.pid = s.pid AND list_contains(p.path_arr, 174))""", shared=True)
def search_path_unweighted(t):
    return S.search_path_unweighted(S.origin_rows(pathobs(t)), top_paths(t), "1299 !174").select("pid", "n_paths", "best_hit")


@query("search_common", f"""SELECT pid, n_paths, pos, n > 100 AS more FROM (SELECT pid, n_paths, r - 100 AS pos, (SELECT count(*) FROM ({_search_path_sql("list_contains(path_arr, 1299)", "s.is_primary")}) q JOIN o_dfz d ON q.n_paths >= ceil(greatest(3.0, 0.2 * d.dfz_ref))) - 100 AS n FROM (
  SELECT q.*, row_number() OVER (ORDER BY match_ratio DESC, matched_peers DESC, q.n_paths DESC, pid) AS r FROM ({_search_path_sql("list_contains(path_arr, 1299)", "s.is_primary")}) q JOIN o_dfz d ON q.n_paths >= ceil(greatest(3.0, 0.2 * d.dfz_ref))) x WHERE r BETWEEN 101 AND 200) y""", shared=True)
def search_common(t):
    hits = S.low_vis_filter(_by_index(t, "1299"), C.dfz_ref(prefix(t)))
    return S.search_page(hits, S.path_order(), limit=100, page=1).select("pid", "n_paths", "pos", "more")


@query("search_sort", "SELECT prefix, city, n_paths FROM (SELECT *, row_number() OVER (ORDER BY city NULLS FIRST) AS r FROM o_pgeo) x")
def search_sort(t):
    return S.search_sort(pgeo(t).select("prefix", "city", "n_paths"), "city", descending=False)


_Q14 = "SELECT DISTINCT CAST(floor(ip / 262144e0) AS BIGINT) * 262144 AS q_start, 14 AS q_plen FROM fx_hops"


@query("subnet_search", f"""SELECT q_start, q_plen, p.pk AS pid, p.prefix, p.plen, p.ip_start FROM (SELECT * FROM ({_Q14}) a UNION ALL SELECT DISTINCT ip, 32 FROM fx_hops) q
  JOIN fx_prefix p ON p.ip_start <= q_start + CAST(power(2, 32 - q_plen) AS BIGINT) - 1 AND p.ip_end >= q_start""")
def subnet_search(t):
    q = t.sql(_Q14).unionByName(t.sql("SELECT DISTINCT ip AS q_start, 32 AS q_plen FROM fx_hops"))
    return S.subnet_search(t["fx_prefix"].withColumnRenamed("pk", "pid"), q)


@query("subnet_lookup", """SELECT pid, prefix, plen, pos, n > 20 AS more FROM (SELECT *, row_number() OVER (ORDER BY plen DESC, ip_start) AS pos, count(*) OVER () AS n FROM o_prefix WHERE ip_start <= 17104895 AND ip_end >= 16842752) x WHERE pos <= 20""")
def subnet_lookup(t):
    d = S.subnet_lookup(prefix(t), 16842752, 17104895)
    return S.search_page(d, S.subnet_order(), limit=20).select("pid", "prefix", "plen", "pos", "more")


@query("prefix_exact", "SELECT ip_start AS q_start, ip_end AS q_end, pid, prefix, n_paths FROM o_prefix")
def prefix_exact(t):
    return S.prefix_exact(prefix(t), t["fx_prefix"].select(F.col("ip_start").alias("q_start"), F.col("ip_end").alias("q_end")))


_LPM = """SELECT h.event_id, h.ip, arg_max(struct_pack(pid := p.pid, prefix := p.prefix, origin_asn := p.origin_asn, cc := p.cc), p.plen) AS m FROM fx_hops h
  LEFT JOIN o_pgeo p ON p.ip_start <= h.ip AND p.ip_end >= h.ip GROUP BY h.event_id, h.ip"""


@query("ip_enrich", f"SELECT event_id, ip, m.pid AS pid, m.prefix AS prefix, m.origin_asn AS origin_asn, m.cc AS cc FROM ({_LPM}) x")
def ip_enrich(t):
    return S.ip_enrich(t["fx_hops"].select("event_id", "ip"), pgeo(t), cols=("pid", "prefix", "origin_asn", "cc"))


@query("ip_enrich_v6", """SELECT a.h, arg_max(p.pk, p.plen) AS pid FROM (SELECT pk, rpad(start_hex[1:20] || 'AB', 32, '7') AS h FROM fx_v6) a
  LEFT JOIN fx_v6 p ON p.start_hex <= a.h AND p.end_hex >= a.h GROUP BY a.h, a.pk""")
def ip_enrich_v6(t):
    p = t.once("v6", lambda: v6(t))
    pts = p.select(F.unhex(F.rpad(F.concat(F.substring(F.hex("ip_start"), 1, 20), F.lit("AB")), 32, "7")).alias("ip"))
    return S.ip_enrich(pts, p, cols=("pid",)).select(F.hex("ip").alias("h"), "pid")


_DNS = """SELECT 'd' || CAST(trace_id AS VARCHAR(20)) || '.example.net' AS domain, CASE event_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'TXT' WHEN 2 THEN 'NS' ELSE 'A' END AS qtype,
  CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 16 WHEN 2 THEN 2 ELSE 5 END AS atype, event_id, ip FROM fx_hops"""


@query("dns_enrich", f"""SELECT d.event_id, d.qtype, CASE d.qtype WHEN 'A' THEN (d.ip // 16777216) || '.' || (d.ip // 65536 % 256) || '.' || (d.ip // 256 % 256) || '.' || (d.ip % 256) WHEN 'TXT' THEN 'v=' || d.event_id || 'tail' ELSE 'ns.x' END AS data,
  CASE WHEN d.qtype = 'A' THEN x.m.prefix END AS prefix FROM ({_DNS}) d JOIN ({_LPM}) x ON x.event_id = d.event_id WHERE d.event_id % 4 <> 3""")
def dns_enrich(t):
    d = t.sql(_DNS)
    data = F.when(F.col("qtype") == "A", ip.int_to_ip4("ip")).when(
        F.col("qtype") == "TXT", F.concat(F.lit('"v='), F.col("event_id").cast("string"), F.lit('" "tail"'))).otherwise(F.lit("ns.x"))
    codes = {"A": 1, "AAAA": 28, "CNAME": 5, "NS": 2, "MX": 15, "TXT": 16, "SOA": 6, "CAA": 257}
    return S.dns_enrich(d.withColumn("data", data).drop("ip"), pgeo(t), codes).select("event_id", "qtype", "data", "prefix")


_RELATIVES = """SELECT pid, side, pos, rel_pid, rel_prefix FROM (
  SELECT c.pk AS pid, 'sup' AS side, row_number() OVER (PARTITION BY c.pk ORDER BY p.plen DESC) AS pos, p.pk AS rel_pid, p.prefix AS rel_prefix FROM fx_prefix c
    JOIN fx_prefix p ON p.ip_start <= c.ip_start AND p.ip_end >= c.ip_end AND p.pk <> c.pk
  UNION ALL SELECT p.pk, 'sub', row_number() OVER (PARTITION BY p.pk ORDER BY c.ip_start, c.plen), c.pk, c.prefix FROM fx_prefix c
    JOIN fx_prefix p ON p.ip_start <= c.ip_start AND p.ip_end >= c.ip_end AND p.pk <> c.pk) x"""


def relatives(t):
    return S.prefix_relatives(t["fx_prefix"].withColumnRenamed("pk", "pid"))


@query("prefix_relatives", _RELATIVES)
def prefix_relatives(t):
    return relatives(t)


@query("prefix_detail", f"""SELECT p.pid, p.prefix, p.origin_asn, p.n_paths, p.rpki, p.irr, p.cc, a.paths, a.n AS n_kept,
  (SELECT string_agg(rel_prefix, ' ' ORDER BY pos) FROM ({_RELATIVES}) r WHERE r.pid = p.pid AND side = 'sup') AS sup, (SELECT string_agg(rel_prefix, ' ' ORDER BY pos) FROM ({_RELATIVES}) r WHERE r.pid = p.pid AND side = 'sub') AS sub,
  (SELECT string_agg(origin_asn || ':' || ns || ':' || np, ' ' ORDER BY ns DESC, np DESC, origin_asn) FROM (SELECT origin_asn, CAST(sum(n_peers) AS BIGINT) AS ns, CASE WHEN p.n_origins > 1 THEN 0 ELSE count(*) END AS np FROM o_pathobs o WHERE o.pid = p.pid GROUP BY origin_asn) g) AS origins
  FROM o_pgeo p JOIN (SELECT pid, string_agg(path_raw, '|' ORDER BY path_len, n_peers DESC, path_raw) AS paths, count(*) AS n FROM o_paths GROUP BY pid) a ON a.pid = p.pid""", shared=True)
def prefix_detail(t):
    m = C.moas_origins(pathobs(t))
    d = S.prefix_detail(pgeo(t).join(m, ["pid"], "left"), top_paths(t), relatives(t),
                        V.irr_objects(t["fx_prefix"].withColumnRenamed("pk", "pid"), t["fx_irr_route"]))
    triple = lambda x: F.concat_ws(":", x["asn"].cast("string"), x["peers"].cast("string"), x["paths"].cast("string"))
    return d.select("pid", "prefix", "origin_asn", "n_paths", "rpki", "irr", "cc",
                    F.array_join(F.transform("paths", lambda x: x["path"]), "|").alias("paths"), F.size("paths").cast("bigint").alias("n_kept"),
                    F.array_join("sup", " ").alias("sup"), F.array_join("sub", " ").alias("sub"),
                    F.array_join(F.transform("origins", triple), " ").alias("origins"))


@query("probe_report", f"""SELECT x.ip, x.m.prefix AS prefix, x.m.origin_asn AS origin_asn, u.ups AS upstreams, a.n AS n_kept FROM (SELECT DISTINCT ON (ip) * FROM ({_LPM}) l) x
  LEFT JOIN (SELECT pid, string_agg(asn || ':' || n, ' ' ORDER BY n DESC, asn) AS ups FROM (SELECT pid, path_arr[-2] AS asn, count(*) AS n FROM o_paths GROUP BY ALL) b GROUP BY pid) u ON u.pid = x.m.pid
  LEFT JOIN (SELECT pid, count(*) AS n FROM o_paths GROUP BY pid) a ON a.pid = x.m.pid""", shared=True)
def probe_report(t):
    tp = top_paths(t)
    d = S.probe_report(t["fx_hops"].select("ip").distinct(), pgeo(t), tp, R.upstream_summary(tp))
    pair = lambda x: F.concat_ws(":", x["asn"].cast("string"), x["n"].cast("string"))
    return d.select("ip", "prefix", "origin_asn", F.array_join(F.transform("upstreams", pair), " ").alias("upstreams"),
                    F.when(F.col("paths").isNotNull(), F.size("paths")).cast("bigint").alias("n_kept"))


@query("asn_overview", f"""SELECT o.asn, o.n_v4, n.name, l.prefixes, coalesce(r.up, 0) AS n_up, coalesce(r.peer, 0) AS n_peer, coalesce(r.down, 0) AS n_down, m.sets AS member_of, b.name AS pdb_name
  FROM (SELECT origin_asn AS asn, count(DISTINCT pid) AS n_v4 FROM o_pathobs GROUP BY origin_asn) o
  LEFT JOIN (SELECT asn, coalesce(max(name) FILTER (WHERE kind = 'curated'), max(name) FILTER (WHERE kind = 'handle')) AS name FROM fx_asn_name GROUP BY asn) n ON n.asn = o.asn
  LEFT JOIN (SELECT origin_asn, string_agg(prefix, ' ' ORDER BY n_paths DESC, pid) AS prefixes FROM (SELECT *, row_number() OVER (PARTITION BY origin_asn ORDER BY n_paths DESC, pid) AS k FROM o_pathsearch) x GROUP BY origin_asn) l ON l.origin_asn = o.asn
  LEFT JOIN (SELECT asn, count(*) FILTER (WHERE rel = 'up') AS up, count(*) FILTER (WHERE rel = 'peer') AS peer, count(*) FILTER (WHERE rel = 'down') AS down FROM ({_REL}) q GROUP BY asn) r ON r.asn = o.asn
  LEFT JOIN (SELECT val, string_agg(DISTINCT set_key, ' ' ORDER BY set_key) AS sets FROM fx_as_member GROUP BY val) m ON m.val = 'AS' || o.asn
  LEFT JOIN fx_pdb_net b ON b.asn = o.asn""", shared=True)
def asn_overview(t):
    from ..operators import sets as A
    from .queries_sets import edges
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("name")))
    names = t["fx_asn_name"].groupBy("asn").agg(F.coalesce(of("curated"), of("handle")).alias("name"))
    d = S.asn_overview(byorigin(t), C.origin_counts(pathobs(t)), names, R.relation_classify(neigh(t)),
                       A.as_set_reverse(edges(t)), t["fx_pdb_net"])
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return d.select("asn", "n_v4", "name", F.array_join("prefixes", " ").alias("prefixes"), zero("n_up"), zero("n_peer"), zero("n_down"),
                    F.array_join("member_of", " ").alias("member_of"), "pdb_name")


@query("prefix_detail_parts", f"""WITH a AS (SELECT pid, (r - 1) // 4 + 1 AS part, string_agg(path_raw, '|' ORDER BY r) AS paths FROM (
    SELECT *, row_number() OVER (PARTITION BY pid ORDER BY path_len, n_peers DESC, path_raw) AS r FROM o_paths) x GROUP BY ALL),
  s AS (SELECT pid, (pos - 1) // 4 + 1 AS part, string_agg(rel_prefix, ' ' ORDER BY pos) FILTER (side = 'sup') AS sup, string_agg(rel_prefix, ' ' ORDER BY pos) FILTER (side = 'sub') AS sub FROM ({_RELATIVES}) r GROUP BY ALL)
  SELECT p.pid, p.prefix, k.part, k.paths, k.sup, k.sub FROM o_prefix p JOIN (SELECT coalesce(a.pid, s.pid) AS pid, coalesce(a.part, s.part) AS part, paths, sup, sub FROM a FULL JOIN s ON s.pid = a.pid AND s.part = a.part) k ON k.pid = p.pid""", shared=True)
def prefix_detail_parts(t):
    d = PT.prefix_detail(prefix(t).select("pid", "prefix"), top_paths(t), relatives(t), size=4)
    return d.select("pid", "prefix", "part", F.array_join(F.transform("paths", lambda x: x["path"]), "|").alias("paths"),
                    F.array_join("sup", " ").alias("sup"), F.array_join("sub", " ").alias("sub"))


@query("asn_overview_parts", """WITH l AS (SELECT origin_asn AS asn, (r - 1) // 8 + 1 AS part, string_agg(prefix, ' ' ORDER BY r) AS prefixes FROM (
    SELECT *, row_number() OVER (PARTITION BY origin_asn ORDER BY n_paths DESC, pid) AS r FROM o_pathsearch) x GROUP BY ALL),
  m AS (SELECT asn, (r - 1) // 8 + 1 AS part, string_agg(set_key, ' ' ORDER BY r) AS member_of FROM (SELECT *, row_number() OVER (PARTITION BY asn ORDER BY set_key) AS r FROM (
    SELECT DISTINCT CAST(substr(val, 3) AS BIGINT) AS asn, set_key FROM fx_as_member WHERE regexp_matches(val, '^AS[0-9]+$')) d) y GROUP BY ALL),
  k AS (SELECT coalesce(l.asn, m.asn) AS asn, coalesce(l.part, m.part) AS part, prefixes, member_of FROM l FULL JOIN m ON m.asn = l.asn AND m.part = l.part)
  SELECT o.asn, o.n_v4, k.part, k.prefixes, k.member_of FROM (SELECT origin_asn AS asn, count(DISTINCT pid) AS n_v4 FROM o_pathobs GROUP BY origin_asn) o JOIN k ON k.asn = o.asn""", shared=True)
def asn_overview_parts(t):
    from ..operators import sets as A
    from .queries_sets import edges
    facts = C.origin_counts(pathobs(t)).withColumnRenamed("origin_asn", "asn")
    d = PT.asn_overview(facts, byorigin(t), A.as_set_reverse(edges(t)), size=8)
    return d.select("asn", "n_v4", "part", F.array_join("prefixes", " ").alias("prefixes"), F.array_join("member_of", " ").alias("member_of"))


@query("probe_report_parts", f"""WITH a AS (SELECT pid, (r - 1) // 8 + 1 AS part, string_agg(path_raw, '|' ORDER BY r) AS paths FROM (
    SELECT *, row_number() OVER (PARTITION BY pid ORDER BY is_best DESC, path_len, n_peers DESC, path_raw) AS r FROM o_paths) x GROUP BY ALL),
  u AS (SELECT pid, (r - 1) // 8 + 1 AS part, string_agg(asn || ':' || n, ' ' ORDER BY r) AS upstreams FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY n DESC, asn) AS r FROM (
    SELECT pid, path_arr[-2] AS asn, count(*) AS n FROM o_paths GROUP BY ALL) b) y GROUP BY ALL),
  k AS (SELECT coalesce(a.pid, u.pid) AS pid, coalesce(a.part, u.part) AS part, paths, upstreams FROM a FULL JOIN u ON u.pid = a.pid AND u.part = a.part)
  SELECT x.ip, x.m.prefix AS prefix, coalesce(k.part, 1) AS part, k.paths, k.upstreams FROM (SELECT DISTINCT ON (ip) * FROM ({_LPM}) l) x LEFT JOIN k ON k.pid = x.m.pid""", shared=True)
def probe_report_parts(t):
    tp = top_paths(t)
    d = PT.probe_paths(S.ip_enrich(t["fx_hops"].select("ip").distinct(), pgeo(t)), tp, R.upstream_summary(tp), size=8)
    pair = lambda x: F.concat_ws(":", x["asn"].cast("string"), x["n"].cast("string"))
    return d.select("ip", "prefix", "part", F.array_join("paths", "|").alias("paths"), F.array_join(F.transform("upstreams", pair), " ").alias("upstreams"))


@query("sink_csv", f"""SELECT prefix, origin_asn, printf('%.2f', round(100.0 * matched_peers / observed_peers, 2)) || '%' AS share FROM ({_search_path_sql("list_contains(path_arr, 1299)", "s.is_primary")}) q""", shared=True)
def sink_csv(t):
    hits = S.search_path(S.origin_rows(pathobs(t)), all_paths(t), "1299")
    return S.export_rows(hits, S.path_order(), {"prefix": F.col("prefix"), "origin_asn": F.col("origin_asn"), "share": S.match_share_text()})


_LPM6 = """SELECT a.pk, arg_max(p.pk, p.plen) AS pid, arg_max(p.origin, p.plen) AS origin FROM (SELECT pk, rpad(start_hex[1:20] || 'AB', 32, '7') AS h FROM fx_v6) a
  LEFT JOIN fx_v6 p ON p.start_hex <= a.h AND p.end_hex >= a.h GROUP BY a.pk"""


def points6(t):
    """An address below every 128-bit prefix."""
    h = F.unhex(F.rpad(F.concat(F.substring("start_hex", 1, 20), F.lit("AB")), 32, "7"))
    return t["fx_v6"].select("pk", ip.ip6_text(h).alias("ip"))


@query("subnet_search_v6", "SELECT q.pk AS q, p.pk AS pid FROM fx_v6 q JOIN fx_v6 p ON p.start_hex <= q.end_hex AND p.end_hex >= q.start_hex")
def subnet_search_v6(t):
    q = v6(t).select(F.col("pid").alias("q"), F.col("ip_start").alias("q_start"), F.col("plen").alias("q_plen"))
    return S.subnet_search(v6(t), q, cols=("pid",)).select("q", "pid")


@query("hop_enrich_v6", f"""SELECT 'v4' AS fam, h.event_id AS id, coalesce(x.m.origin_asn, 0) AS asn FROM fx_hops h JOIN ({_LPM}) x ON x.event_id = h.event_id
  UNION ALL SELECT 'v6', pk, coalesce(origin, 0) FROM ({_LPM6}) y""")
def hop_enrich_v6(t):
    """Hops of both families in one table."""
    from ..operators import measure as M
    none = F.lit(None).cast("bigint")
    hops = t["fx_hops"].select(F.lit("v4").alias("fam"), F.col("event_id").alias("id"), ip.int_to_ip4("ip").alias("ip"), none.alias("asn")).unionByName(
        points6(t).select(F.lit("v6").alias("fam"), F.col("pk").alias("id"), "ip", none.alias("asn")))
    text = F.lit(None).cast("string")
    six = v6(t).withColumnRenamed("origin", "origin_asn").withColumns({c: text for c in ("cc", "city", "province")})
    four = prefix(t).withColumns({c: text for c in ("cc", "city", "province")})
    return M.hop_enrich(hops, four, six).select("fam", "id", "asn")


@query("dns_enrich_v6", f"""SELECT 'A' AS qtype, h.event_id AS id, x.m.pid AS pid FROM fx_hops h JOIN ({_LPM}) x ON x.event_id = h.event_id UNION ALL SELECT 'AAAA', pk, pid FROM ({_LPM6}) y""", shared=True)
def dns_enrich_v6(t):
    """A and AAAA answers in one call."""
    a = t["fx_hops"].select(F.lit("A").alias("qtype"), F.lit(1).alias("atype"), F.col("event_id").alias("id"), ip.int_to_ip4("ip").alias("data"))
    b = points6(t).select(F.lit("AAAA").alias("qtype"), F.lit(28).alias("atype"), F.col("pk").alias("id"), F.col("ip").alias("data"))
    return S.dns_enrich(a.unionByName(b), [pgeo(t), v6(t).drop("origin")], {"A": 1, "AAAA": 28}).select("qtype", "id", "pid")
