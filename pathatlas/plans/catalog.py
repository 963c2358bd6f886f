"""Registry of runnable queries and their SQL twins, plus shared pieces of both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import consolidate as C
from .fixtures import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
T1 = "174, 1299, 3356, 6939"

# Shared CTEs of the SQL twins (DuckDB dialect), written unlike the Spark operators.
TWINS: dict[str, str] = {
    "o_pathobs": """SELECT pk AS pid, prefix, ip_start, ip_end, family, plen, path_raw, path_clean, origin_asn,
  CAST(len(string_split(path_raw, ' ')) AS INTEGER) AS path_len, count(*) AS n_peers
  FROM fx_rib GROUP BY ALL""",
    "o_prefix": """SELECT pid, prefix, ip_start, ip_end, family, plen, CAST(sum(n_peers) AS BIGINT) AS n_paths,
  count(*) AS n_distinct_paths, count(DISTINCT origin_asn) AS n_origins,
  (SELECT origin_asn FROM o_pathobs i WHERE i.pid = o.pid GROUP BY origin_asn ORDER BY sum(n_peers) DESC, origin_asn LIMIT 1) AS origin_asn
  FROM o_pathobs o GROUP BY pid, prefix, ip_start, ip_end, family, plen""",
    "o_ranked": """SELECT *, row_number() OVER (PARTITION BY pid ORDER BY n_peers DESC, path_len, path_clean, path_raw) AS rn FROM o_pathobs""",
    "o_paths": """SELECT pid, family, ' ' || path_clean || ' ' AS path_str, string_split(path_clean, ' ')::BIGINT[] AS path_arr,
  string_split(path_raw, ' ')::BIGINT[] AS raw_arr, path_raw, path_len, n_peers, rn = 1 AS is_best FROM o_ranked""",
    "o_bundle": """SELECT pid, CAST(ceil(r / 128.0) AS BIGINT) AS part, string_agg('@' || n_peers || '@' || path_str, '|' ORDER BY r) AS bundle
  FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY n_peers DESC, path_len, path_str) AS r FROM o_paths) x GROUP BY ALL""",
    "o_totals": """SELECT pid, CAST(sum(n_peers) AS BIGINT) AS observed_peers, arg_max(path_str, is_best) AS best_path FROM o_paths GROUP BY pid""",
    "o_dfz": """SELECT family, greatest(CAST(round(quantile_cont(n_paths, 0.9)) AS BIGINT), 1) AS dfz_ref FROM o_prefix GROUP BY family""",
    "o_rpki": """SELECT pid, origin, CASE WHEN bool_or(v.asn = r.origin AND r.plen <= v.maxlen) THEN 1 WHEN bool_or(v.asn = r.origin) THEN 3 ELSE 2 END AS rpki
  FROM fx_route_origin r JOIN fx_vrp v ON v.vlen > 0 AND v.vlen <= r.plen AND v.ip_start <= r.ip_start
    AND r.ip_end <= v.ip_start + CAST(power(2, 32 - v.vlen) AS BIGINT) - 1 GROUP BY pid, origin""",
    "o_irr": """SELECT r.pid, r.origin, CASE WHEN max(CASE WHEN i.origin = r.origin THEN 1 ELSE 0 END) = 1 THEN 1 ELSE 2 END AS irr
  FROM fx_route_origin r JOIN fx_irr_route i ON i.ip_start = r.ip_start AND i.ip_end = r.ip_end GROUP BY r.pid, r.origin""",
    "o_geo_merge": """SELECT CAST(min(s) AS BIGINT) AS start_num, CAST(max(e) AS BIGINT) AS end_num, family, r.cc AS cc, r.province AS province, r.city AS city, r.provider AS provider FROM (
  SELECT c.family, c.s, c.e, arg_min(struct_pack(cc := g.cc, province := g.province, city := g.city, provider := g.provider, a := g.start_num, b := g.end_num),
    struct_pack(a := g.start_num, p := list_position(['ipdb', 'geolite', 'other'], CASE WHEN g.provider IN ('ipdb', 'geolite') THEN g.provider ELSE 'other' END), b := g.end_num, c := coalesce(g.cc, ''), d := coalesce(g.city, ''))) AS r
  FROM (SELECT family, cut AS s, lead(cut) OVER (PARTITION BY family ORDER BY cut) - 1 AS e FROM (SELECT DISTINCT family, unnest([start_num, end_num + 1]) AS cut FROM fx_geo_raw) d) c
  JOIN fx_geo_raw g ON g.family = c.family AND g.start_num <= c.s AND g.end_num >= c.e GROUP BY ALL) owned GROUP BY family, r""",
    "o_geo_head": """SELECT * FROM o_geo_merge g WHERE NOT EXISTS (SELECT 1 FROM o_geo_merge p WHERE p.family = g.family AND p.end_num = g.start_num - 1
  AND p.cc IS NOT DISTINCT FROM g.cc AND p.province IS NOT DISTINCT FROM g.province AND p.city IS NOT DISTINCT FROM g.city)""",
    "o_geo": """SELECT h.start_num, max(g.end_num) AS end_num, h.family, h.cc, h.province, h.city, h.provider FROM o_geo_merge g JOIN o_geo_head h ON h.family = g.family
  AND h.start_num = (SELECT max(k.start_num) FROM o_geo_head k WHERE k.family = g.family AND k.start_num <= g.start_num) GROUP BY ALL""",
    "o_pgeo": """SELECT p.*, g.cc, g.province, g.city, coalesce(r.rpki, 0) AS rpki, coalesce(i.irr, 0) AS irr FROM o_prefix p
  LEFT JOIN o_geo g ON g.family = p.family AND p.ip_start BETWEEN g.start_num AND g.end_num
  LEFT JOIN o_rpki r ON r.pid = p.pid AND r.origin = p.origin_asn LEFT JOIN o_irr i ON i.pid = p.pid AND i.origin = p.origin_asn""",
    "o_parent": """SELECT child, arg_max(parent, pplen) AS parent FROM (SELECT c.pk AS child, p.pk AS parent, p.plen AS pplen
  FROM fx_prefix c JOIN fx_prefix p ON p.ip_start <= c.ip_start AND p.ip_end >= c.ip_end AND p.pk <> c.pk) x GROUP BY child""",
    "o_pathsearch": """SELECT t.pid, p.prefix, t.family, coalesce(p.cc, 'ZZ') AS cc, t.origin_asn, p.n_origins, p.n_paths, t.origin_asn IS NOT DISTINCT FROM p.origin_asn AS is_primary,
  coalesce(r.rpki, 0) AS rpki, coalesce(i.irr, 0) AS irr, b.observed_peers, b.best_path
  FROM (SELECT pid, family, origin_asn, sum(n_peers) FROM o_pathobs GROUP BY ALL) t JOIN o_pgeo p ON p.pid = t.pid JOIN o_totals b ON b.pid = t.pid
  LEFT JOIN o_rpki r ON r.pid = t.pid AND r.origin = t.origin_asn LEFT JOIN o_irr i ON i.pid = t.pid AND i.origin = t.origin_asn""",
    "o_step": f"""SELECT pid, len(path_arr) AS l, st[1] AS a, st[2] AS b, list_has_any(path_arr[:i - 1], [{T1}]::BIGINT[]) AS met_a, list_has_any(path_arr[:i], [{T1}]::BIGINT[]) AS met_b
  FROM (SELECT pid, path_arr, unnest(list_transform(list_zip(path_arr[:-2], path_arr[2:]), lambda z: [z[1], z[2]])) AS st, unnest(range(1, len(path_arr))) AS i FROM o_paths WHERE len(path_arr) > 1) z
  WHERE st[1] <> st[2]""",
    "o_neigh": """SELECT asn, neighbor, count(*) FILTER (far AND met) AS d, count(*) FILTER (NOT far AND met) AS u, count(*) FILTER (NOT far AND NOT met) AS w, count(*) FILTER (far AND NOT met) AS wd,
  arg_min(pid, l * 1000000000 + pid) AS ev_pid FROM (SELECT a AS asn, b AS neighbor, TRUE AS far, met_a AS met, l, pid FROM o_step
  UNION ALL SELECT b, a, FALSE, met_b, l, pid FROM o_step) both_sides GROUP BY asn, neighbor""",
}


def query(name: str, sql: str | None = None, shared: bool = False):
    """Register ``fn(tables) -> DataFrame`` under a name, with its SQL twin.

    ``shared`` queries use the merged paths several times and write them once first.
    """
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir, shared))
        if sql is not None:
            ORACLES[name] = with_views(sql, TWINS)
        return fn
    return register


# ---- shared Spark inputs ----------------------------------------------------

def obs(t: Tables) -> DataFrame:
    """Observations; the part key of the fixture serves as prefix id."""
    return C.obs_dedup(t["fx_rib"].withColumnRenamed("pk", "pid"))


def pathobs(t: Tables) -> DataFrame:
    make = lambda: C.pathobs_merge(obs(t))
    return t.once("pathobs", make) if t.shared else make()


def prefix(t: Tables) -> DataFrame:
    make = lambda: C.prefix_agg(pathobs(t))
    return t.once("prefix", make) if t.shared else make()


def top_paths(t: Tables) -> DataFrame:
    make = lambda: C.paths_topk(pathobs(t))
    return t.once("paths", make) if t.shared else make()


def all_paths(t: Tables) -> DataFrame:
    """Path rows without the flag of the best one, which needs a join."""
    return C.path_rows(pathobs(t))
