"""as-set, peering database and exchange queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import peering as D
from ..operators import sets as S
from .catalog import query


def edges(t):
    return t["fx_as_member"].select("set_key", "kind", "val")


def pdb_ix(t, ixs=None):
    n = t["fx_pdb_netixlan"].select("ix_id", "asn").distinct().groupBy("ix_id").agg(F.count("*").alias("net_count"))
    return (t["fx_pdb_ix"] if ixs is None else ixs).join(n, ["ix_id"], "left").withColumn("net_count", F.coalesce("net_count", F.lit(0)))


_IX = "(SELECT i.*, (SELECT count(DISTINCT asn) FROM fx_pdb_netixlan n WHERE n.ix_id = i.ix_id) AS net_count FROM fx_pdb_ix i)"

# sets of two registries: names with members, an empty shell in ARIN for every third nation
_SETS = """SELECT 'AS-N' || CAST(n_nationkey AS VARCHAR(20)) AS name, 'RADB' AS source, 'descr ' || n_name AS descr, 1 + n_nationkey % 3 AS n FROM nation
  UNION ALL SELECT 'AS-N' || CAST(n_nationkey AS VARCHAR(20)), CASE WHEN n_nationkey % 2 = 0 THEN 'RIPE' ELSE 'LACNIC' END, n_name, 2 + n_nationkey % 2 FROM nation
  UNION ALL SELECT 'AS-N' || CAST(n_nationkey AS VARCHAR(20)), 'ARIN', '', 0 FROM nation"""


def sets(t):
    d = t.sql(_SETS)
    member = lambda i: F.when(i == 0, F.concat(F.lit("AS"), F.length("name").cast("string"))).when(
        i == 1, F.concat(F.lit("AS-N"), F.length("descr").cast("string"))).otherwise(F.lit("AS-GONE"))
    return d.select("name", "source", "descr", F.transform(F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: i < F.col("n")), member).alias("members"))


_RESOLVED = f"""SELECT s.source || '::' || s.name AS set_key, i AS ord, CASE i WHEN 0 THEN 'asn' ELSE 'set' END AS kind,
  CASE i WHEN 0 THEN 'AS' || length(s.name) WHEN 1 THEN CASE WHEN length(s.descr) < 25 THEN (CASE WHEN length(s.descr) % 2 = 0 THEN 'RIPE' ELSE 'ARIN' END) || '::AS-N' || length(s.descr) ELSE 'AS-N' || length(s.descr) END ELSE 'AS-GONE' END AS val
  FROM ({_SETS}) s, (SELECT unnest([0, 1, 2]) AS i) k WHERE i < s.n"""


@query("as_set_resolve", _RESOLVED)
def as_set_resolve(t):
    return S.as_set_resolve(sets(t))[1]


@query("as_set_directory", f"SELECT source || '::' || name AS set_key, source, name, descr, CAST(n AS INTEGER) AS n_members FROM ({_SETS}) s")
def as_set_directory(t):
    return S.as_set_resolve(sets(t))[0]


@query("as_set_reverse", "SELECT member, parent_key, row_number() OVER (PARTITION BY member ORDER BY parent_key) AS pos FROM (SELECT DISTINCT val AS member, set_key AS parent_key FROM fx_as_member) x")
def as_set_reverse(t):
    return S.as_set_reverse(edges(t))


@query("as_set_pick", f"""SELECT name, source || '::' || name AS set_key, source, CAST(n AS INTEGER) AS n_members FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN n > 0 THEN 0 ELSE 1 END,
  list_position(['RIPE', 'APNIC', 'ARIN', 'AFRINIC', 'LACNIC', 'RIPE-NONAUTH', 'RADB', 'DN42'], source), n DESC) AS r FROM ({_SETS}) s) x WHERE r = 1""")
def as_set_pick(t):
    return S.as_set_pick(S.as_set_resolve(sets(t))[0])


_EXPAND = """WITH RECURSIVE walk AS (SELECT DISTINCT set_key AS root, set_key AS val, [set_key] AS path, 0 AS depth, 'set' AS kind, FALSE AS cycle FROM fx_as_member
  UNION ALL SELECT w.root, m.val, list_append(w.path, m.val), w.depth + 1, m.kind, m.kind = 'set' AND list_contains(w.path, m.val)
  FROM walk w JOIN fx_as_member m ON m.set_key = w.val WHERE w.kind = 'set' AND NOT w.cycle)"""


def _recursive(body: str) -> str:
    """Recursive CTEs sit in a subquery so that the fixture CTEs can precede them."""
    return f"SELECT * FROM ({_EXPAND} {body}) q"


@query("as_set_expand", _recursive("""SELECT root, array_to_string(path, ' > ') AS path, depth, kind, val, cycle,
  kind = 'set' AND val NOT IN (SELECT set_key FROM fx_as_member) AS unresolved FROM walk WHERE depth > 0"""))
def as_set_expand(t):
    e = edges(t)
    return S.as_set_expand(e, e.select("set_key").distinct()).withColumn("path", F.array_join("path", " > "))


@query("as_set_cone", _recursive("SELECT root, count(DISTINCT val) AS n_asns FROM walk WHERE kind = 'asn' GROUP BY root"))
def as_set_cone(t):
    return S.as_set_cone(edges(t))


@query("as_set_components", """WITH RECURSIVE reach AS (SELECT DISTINCT set_key AS a, set_key AS b FROM fx_as_member
  UNION SELECT r.a, m.val FROM reach r JOIN fx_as_member m ON m.set_key = r.b WHERE m.kind = 'set')
  SELECT x.a AS set_key, min(x.b) AS component FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY x.a""")
def as_set_components(t):
    return S.cones(edges(t))[0]


@query("as_set_sample", f"""SELECT s.source || '::' || s.name AS set_key, s.descr, CAST(s.n AS INTEGER) AS n_members, m.members FROM ({_SETS}) s
  LEFT JOIN (SELECT set_key, string_agg(val, ' ' ORDER BY ord) FILTER (WHERE ord < 2) AS members FROM ({_RESOLVED}) r GROUP BY set_key) m ON m.set_key = s.source || '::' || s.name""")
def as_set_sample(t):
    d, e = S.as_set_resolve(sets(t))
    return S.as_set_sample(d, e, members=2).select("set_key", "descr", "n_members", F.array_join("members", " ").alias("members"))


@query("as_set_tokens", "SELECT asn, unnest(['RIPE::AS-' || asn, 'AS-X' || net_id]) AS token FROM fx_pdb_net")
def as_set_tokens(t):
    d = t["fx_pdb_net"].withColumn("f", F.concat(F.lit(" RIPE::AS-"), F.col("asn").cast("string"), F.lit(",  AS-X"), F.col("net_id").cast("string"), F.lit(" ")))
    return S.as_set_tokens(d, "f").select("asn", "token")


@query("pdb_normalize", """SELECT 64500 + s_suppkey AS asn, s_suppkey AS net_id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey AS BIGINT) ELSE 0 END AS info_prefixes4,
  s_acctbal > 0 AS info_ipv6, CASE WHEN s_suppkey % 3 = 0 THEN 'http://x/' || s_suppkey ELSE '' END AS social_url FROM supplier""")
def pdb_normalize(t):
    raw = t["supplier"].select(
        F.concat(F.lit(" "), (F.col("s_suppkey") + 64500).cast("string")).alias("asn"), F.col("s_suppkey").alias("id"),
        F.concat(F.lit("  "), F.col("s_name"), F.lit(" \x00")).alias("name"),
        F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey").cast("string")).otherwise(F.lit("n/a")).alias("info_prefixes4"),
        (F.col("s_acctbal") > 0).alias("info_ipv6"),
        F.when(F.col("s_suppkey") % 3 == 0, F.array(F.struct(F.lit(None).cast("string").alias("identifier")),
               F.struct(F.concat(F.lit("http://x/"), F.col("s_suppkey").cast("string")).alias("identifier")))).alias("social_media"))
    return D.pdb_normalize(raw, "net").select("asn", "net_id", "name", "info_prefixes4", "info_ipv6", "social_url")


_KINDS = ("net", "ix", "ixlan", "ixpfx", "fac", "netixlan", "netfac", "ixfac")


@query("pdb_normalize_kinds", " UNION ALL ".join(
    f"SELECT '{k}' AS kind, s_suppkey AS obj, {'NULL' if k == 'ixpfx' else 's_name'} AS name, 'u' || s_suppkey AS updated FROM supplier" for k in _KINDS))
def pdb_normalize_kinds(t):
    raw = t["supplier"].select(F.col("s_suppkey").cast("string").alias("id"), F.concat(F.lit(" "), F.col("s_name")).alias("name"),
                               F.concat(F.lit("u"), F.col("s_suppkey").cast("string"), F.lit(" ")).alias("updated"))
    out = None
    for k in _KINDS:
        d = D.pdb_normalize(raw, k)
        key = f"{k}_id" if f"{k}_id" in d.columns else "id"
        name = F.col("name") if "name" in d.columns else F.lit(None).cast("string")
        d = d.select(F.lit(k).alias("kind"), F.col(key).cast("bigint").alias("obj"), name.alias("name"), "updated")
        out = d if out is None else out.unionByName(d)
    return out


@query("pdb_as_set_fallback", "SELECT asn, CASE WHEN net_id % 2 = 0 THEN 'AS-OWN' WHEN net_id % 3 = 0 THEN 'AS-MAP' || asn ELSE '' END AS irr_as_set FROM fx_pdb_net")
def pdb_as_set_fallback(t):
    net = t["fx_pdb_net"].select("asn", "net_id", F.when(F.col("net_id") % 2 == 0, "AS-OWN").otherwise("").alias("irr_as_set"))
    m = t["fx_pdb_net"].select("asn", F.when(F.col("net_id") % 3 == 0, F.concat(F.lit("AS-MAP"), F.col("asn").cast("string"))).alias("irr_as_set"))
    return D.pdb_as_set_fallback(net, m).select("asn", "irr_as_set")


@query("pdb_presence", """SELECT n.net_id, n.ix_id, CASE WHEN p.net_id IS NOT NULL THEN p.asn ELSE n.asn END AS asn FROM (SELECT net_id, ix_id, CASE WHEN net_id % 3 = 0 THEN NULL ELSE asn + 1 END AS asn FROM fx_pdb_netixlan) n
  LEFT JOIN (SELECT asn, CASE WHEN net_id % 2 = 0 THEN net_id ELSE -net_id END AS net_id FROM fx_pdb_net) p ON p.net_id = n.net_id WHERE p.net_id IS NOT NULL OR n.asn IS NOT NULL""")
def pdb_presence(t):
    ni = t["fx_pdb_netixlan"].select("net_id", "ix_id", F.when(F.col("net_id") % 3 == 0, 0).otherwise(F.col("asn") + 1).cast("bigint").alias("asn"))
    net = t["fx_pdb_net"].withColumn("net_id", F.when(F.col("net_id") % 2 == 0, F.col("net_id")).otherwise(-F.col("net_id")))
    return D.pdb_presence(ni, net).select("net_id", "ix_id", "asn")


@query("pdb_netfac", """SELECT f.net_id, f.fac_id, p.asn FROM (SELECT DISTINCT net_id + 3 AS net_id, ix_id % 5 AS fac_id FROM fx_pdb_netixlan) f JOIN fx_pdb_net p ON p.net_id = f.net_id""")
def pdb_netfac(t):
    f = t["fx_pdb_netixlan"].select((F.col("net_id") + 3).alias("net_id"), (F.col("ix_id") % 5).alias("fac_id")).distinct()
    return D.pdb_netfac(f, t["fx_pdb_net"]).select("net_id", "fac_id", "asn")


@query("pdb_asn_profile", """SELECT asn, ix_id, ix_name, speed, operational, pos FROM (SELECT n.asn, n.ix_id, i.name AS ix_name, n.speed, n.operational,
  row_number() OVER (PARTITION BY n.asn ORDER BY n.operational DESC, n.speed DESC, i.name, n.ix_id) AS pos FROM fx_pdb_netixlan n LEFT JOIN fx_pdb_ix i ON i.ix_id = n.ix_id) x WHERE pos <= 10""")
def pdb_asn_profile(t):
    return D.pdb_asn_profile(t["fx_pdb_netixlan"], t["fx_pdb_ix"], ix_cap=10)[0].select("asn", "ix_id", "ix_name", "speed", "operational", "pos")


@query("ix_list", f"SELECT ix_id, name, city, country, net_count FROM {_IX} x")
def ix_list(t):
    return D.ix_list(pdb_ix(t)).select("ix_id", "name", "city", "country", "net_count")


_MEMBERS = """SELECT n.ix_id, n.asn, p.name AS net_name, p.info_type, n.speed, n.operational, row_number() OVER (PARTITION BY n.ix_id ORDER BY n.operational DESC, n.speed DESC, n.asn) AS pos
  FROM fx_pdb_netixlan n LEFT JOIN fx_pdb_net p ON p.asn = n.asn"""


@query("ix_detail", _MEMBERS)
def ix_detail(t):
    return D.ix_members(t["fx_pdb_netixlan"], t["fx_pdb_net"]).select("ix_id", "asn", "net_name", "info_type", "speed", "operational", "pos")


@query("ix_detail_facilities", """SELECT f.ix_id, f.fac_id, CASE WHEN f.fac_id < 3 THEN 'own' ELSE 'City' || f.fac_id END AS fac_name, CASE WHEN f.fac_id < 3 THEN NULL ELSE f.fac_id END AS net_count
  FROM (SELECT DISTINCT ix_id, net_id % 5 AS fac_id FROM fx_pdb_netixlan) f""")
def ix_detail_facilities(t):
    none = F.lit(None).cast("string")
    ixfac = t["fx_pdb_netixlan"].select("ix_id", (F.col("net_id") % 5).alias("fac_id")).distinct().select(
        "ix_id", "fac_id", F.lit("own").alias("name"), none.alias("city"), none.alias("country"))
    fac = t["fx_pdb_netixlan"].select((3 + F.col("net_id") % 2).alias("fac_id")).distinct().select(
        "fac_id", F.concat(F.lit("City"), F.col("fac_id").cast("string")).alias("name"), none.alias("city"), none.alias("country"), F.col("fac_id").alias("net_count"))
    lan = t["fx_pdb_ix"].select(F.col("ix_id").alias("ixlan_id"), "ix_id", "name")
    pfx = t["fx_pdb_ix"].select(F.col("ix_id").alias("ixlan_id"), F.lit("IPv4").alias("protocol"), F.lit("x").alias("prefix"))
    return D.ix_detail(t["fx_pdb_ix"], lan, pfx, ixfac, fac)["facilities"].select("ix_id", "fac_id", "fac_name", "net_count")


@query("ix_detail_lans", "SELECT ix_id, name AS lan_name, ix_id || '.0.0.0/24' AS prefix FROM fx_pdb_ix")
def ix_detail_lans(t):
    lan = t["fx_pdb_ix"].select((F.col("ix_id") + 7).alias("ixlan_id"), "ix_id", "name")
    pfx = t["fx_pdb_ix"].select((F.col("ix_id") + 7).alias("ixlan_id"), F.lit("IPv4").alias("protocol"),
                                F.concat(F.col("ix_id").cast("string"), F.lit(".0.0.0/24")).alias("prefix"))
    ixfac = t["fx_pdb_ix"].select("ix_id", F.col("ix_id").alias("fac_id"), "name", "city", "country")
    fac = ixfac.drop("ix_id").withColumn("net_count", F.lit(0))
    return D.ix_detail(t["fx_pdb_ix"], lan, pfx, ixfac, fac)["prefixes"].select("ix_id", "lan_name", "prefix")


@query("ix_members_view", f"""SELECT m.ix_id, m.asn, m.net_name, m.speed, CAST(s.total AS BIGINT) AS total_speed FROM ({_MEMBERS}) m JOIN (SELECT ix_id, sum(speed) AS total FROM fx_pdb_netixlan GROUP BY ix_id) s ON s.ix_id = m.ix_id
  WHERE strpos(m.asn || ' ' || lower(coalesce(m.net_name, '')), '05') > 0""")
def ix_members_view(t):
    m = D.ix_members(t["fx_pdb_netixlan"], t["fx_pdb_net"])
    return D.ix_members_view(m, "05").select("ix_id", "asn", "net_name", "speed", "total_speed")
