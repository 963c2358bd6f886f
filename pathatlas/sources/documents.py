"""JSON and free-text answers (RDAP, WHOIS, peering dumps, measurements) -> flat tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# ---- dates ------------------------------------------------------------------

def plain_date(c: Column) -> Column:
    """First date in a text as YYYY-MM-DD; the trimmed text when there is none."""
    date = r"(\d{4})[-./]\s*(\d{1,2})[-./]\s*(\d{1,2})"
    part = lambda i, n: F.lpad(F.regexp_extract(c, date, i), n, "0")
    return F.when(c.rlike(date), F.concat_ws("-", part(1, 4), part(2, 2), part(3, 2))).otherwise(F.trim(c))


# ---- RDAP -------------------------------------------------------------------

_RDAP = """struct<handle:string,name:string,startAutnum:bigint,endAutnum:bigint,ldhName:string,unicodeName:string,startAddress:string,
endAddress:string,cidr0_cidrs:array<struct<v4prefix:string,v6prefix:string,length:int>>,type:string,parentHandle:string,country:string,
status:array<string>,events:array<struct<eventAction:string,eventDate:string>>,nameservers:array<struct<ldhName:string,handle:string>>,
secureDNS:struct<delegationSigned:boolean>,remarks:array<struct<title:string,description:array<string>>>,entities:array<string>>"""
_ENTITY = "struct<handle:string,roles:array<string>,vcardArray:array<string>,entities:array<string>>"
# Names of card properties and event kinds in the output.
VCARD_KEYS = {"fn": "fullname", "org": "org", "adr": "address", "tel": "phone", "email": "email", "kind": "kind", "role": "role", "title": "title", "url": "url"}
EVENT_KEYS = {"registration": "registration", "last changed": "lastchanged", "expiration": "expiration", "reregistration": "lastchanged"}


def _mapped(c: Column, table: dict[str, str], default: Column | None = None) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c), default) if default is not None else F.try_element_at(m, c)


def _kv(k, v: Column) -> Column:
    return F.struct((F.lit(k) if isinstance(k, str) else k).alias("k"), v.cast("string").alias("v"))


def src_rdap(docs: DataFrame) -> dict[str, DataFrame]:
    """(doc, kind, json) -> head, entity, entity_rows, remarks (kind: autnum, ip or domain).

    Entities are opened one level per step, to any depth; nothing is collected.
    """
    d = docs.withColumn("d", F.from_json("json", _RDAP)).select("doc", "kind", "d.*")
    kind = F.col("kind")
    asrange = F.when(F.col("startAutnum") == F.col("endAutnum"), F.concat(F.lit("AS"), F.col("startAutnum").cast("string"))).otherwise(
        F.concat(F.lit("AS"), F.col("startAutnum").cast("string"), F.lit(" – AS"), F.col("endAutnum").cast("string")))
    cidrs = F.array_join(F.transform(F.coalesce("cidr0_cidrs", F.array().cast("array<struct<v4prefix:string,v6prefix:string,length:int>>")),
                                     lambda c: F.concat(F.coalesce(c["v4prefix"], c["v6prefix"]), F.lit("/"), c["length"].cast("string"))), ", ")
    aut = F.array(_kv("handle", F.coalesce("handle", F.concat(F.lit("AS"), F.col("doc")))), _kv("name", F.col("name")), _kv("asrange", asrange))
    dom = F.array(_kv("ldhname", F.coalesce("ldhName", "doc")),
                  _kv("name", F.when(~F.col("unicodeName").eqNullSafe(F.col("ldhName")), F.col("unicodeName"))), _kv("handle", F.col("handle")))
    net = F.array(_kv("name", F.col("name")), _kv("handle", F.coalesce("handle", "doc")),
                  _kv("iprange", F.concat("startAddress", F.lit(" – "), "endAddress")), _kv("cidr", cidrs),
                  _kv("iptype", F.col("type")), _kv("parent", F.col("parentHandle")))
    events = F.transform("events", lambda e: _kv(_mapped(e["eventAction"], EVENT_KEYS), plain_date(e["eventDate"])))
    common = F.array(_kv("country", F.col("country")), _kv("status", F.array_join("status", ", ")))
    ns = F.transform("nameservers", lambda n: _kv("ns", F.coalesce(n["ldhName"], n["handle"])))
    sec = F.array(_kv("dnssec", F.when(F.col("secureDNS").isNotNull(), F.when(F.col("secureDNS.delegationSigned"), "signed").otherwise("unsigned"))))
    none = F.array().cast("array<struct<k:string,v:string>>")
    rows = F.concat(F.when(kind == "autnum", aut).when(kind == "domain", dom).otherwise(net), common, F.coalesce(events, none),
                    F.when(kind == "domain", F.concat(F.coalesce(ns, none), sec)).otherwise(none))
    rows = F.filter(rows, lambda r: r["k"].isNotNull() & r["v"].isNotNull() & (r["v"] != ""))
    head = d.select("doc", F.posexplode(rows).alias("ord", "r")).select("doc", "ord", "r.k", "r.v")

    remarks = d.select("doc", F.posexplode("remarks").alias("ord", "r")).select(
        "doc", "ord", F.coalesce("r.title", F.lit("")).alias("title"), F.trim(F.array_join("r.description", "\n")).alias("v")).where("v <> ''")

    level = d.select("doc", F.lit("").alias("up"), F.posexplode("entities").alias("ord", "e"))
    levels: list[DataFrame] = []
    while True:  # one written table per nesting depth, until a depth has no entities
        x = cut_lineage(level.withColumn("x", F.from_json("e", _ENTITY)).select(
            "doc", F.when(F.col("up") == "", F.col("ord").cast("string")).otherwise(F.concat_ws(".", "up", F.col("ord").cast("string"))).alias("entity"),
            F.lit(len(levels)).alias("depth"), "ord", "x.*"))
        levels.append(x)
        if x.isEmpty():
            break
        level = x.select("doc", F.col("entity").alias("up"), F.posexplode("entities").alias("ord", "e"))
    found = reduce(DataFrame.unionByName, levels)
    items = F.from_json(F.get("vcardArray", 1), "array<array<string>>")
    found = found.withColumn("_items", F.coalesce(items, F.array().cast("array<array<string>>")))
    fn = F.get(F.filter("_items", lambda i: F.get(i, 0) == "fn"), 0)
    name = F.coalesce(F.nullif(F.get(fn, 3), F.lit("")), "handle", F.get("roles", 0), F.lit("?"))
    entity = found.select("doc", "entity", "depth", "ord", "handle", F.coalesce("roles", F.array().cast("array<string>")).alias("roles"), name.alias("name"))

    def row(i: Column) -> Column:
        """(key, text) of one card property: an address in its printed lines if it has them, a list joined, else the value."""
        prop, value = F.get(i, 0), F.get(i, 3)
        extra = lambda name: F.get_json_object(F.get(i, 1), f"$.{name}")
        is_adr = prop == "adr"
        filled = lambda items: F.filter(items, lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
        items = filled(F.from_json(value, "array<string>"))
        listed = F.when(value.startswith("["), F.when(is_adr, F.array_join(items, ", ")).otherwise(F.array_join(items, " ")))
        printed = F.when(is_adr, F.array_join(F.transform(filled(F.split(extra("label"), "\n")), lambda x: F.trim(x)), ", "))
        text = F.coalesce(F.nullif(printed, F.lit("")), listed, value)
        is_fax = (prop == "tel") & F.contains(F.lower(F.coalesce(extra("type"), F.lit(""))), F.lit("fax"))
        return F.struct(F.when(is_fax, "fax").otherwise(_mapped(prop, VCARD_KEYS, prop)).alias("k"), F.trim(text).alias("v"))

    cards = F.array_distinct(F.filter(F.transform(F.filter("_items", lambda i: F.get(i, 0) != "version"), row), lambda r: F.coalesce(r["v"], F.lit("")) != ""))
    entity_rows = found.select("doc", "entity", F.posexplode(cards).alias("ord", "r")).select("doc", "entity", "ord", "r.k", "r.v")
    return {"head": head, "entity": entity, "entity_rows": entity_rows, "remarks": remarks}


# ---- WHOIS text -------------------------------------------------------------

# Labels of registries by canonical key, with hyphens and underscores read as blanks.
WHOIS_LABELS = {
    "ldhname": ["domain", "domain name", "domainname", "nom de domaine", "nombre de dominio", "ドメイン名"],
    "org": ["org", "organization", "organisation", "organization name", "org name", "holder", "holder of domain name", "owner",
        "owner name", "owner contact", "registrant", "registrant name", "registrant org", "registrant organization",
        "registrant organisation", "registrant contact", "registrant contact name", "descr", "titular", "company english name",
        "organization using domain name", "domain holder organization", "組織名", "そしきめい"],
    "registrar": ["registrar", "registrar name", "registrar handle", "sponsoring registrar",
        "sponsoring registrar organization", "authorized agency", "registration service provider", "record maintained by",
        "registered by"],
    "registration": ["created", "created on", "created date", "creation date", "creationdate", "registered", "registered on",
        "registered date", "registration date", "registration time", "record created", "record created on", "domain created",
        "domain registered", "domain registration date", "domain record activated", "domain name commencement date",
        "first registration date", "domain dateregistered", "date de création", "登録年月日"],
    "lastchanged": ["changed", "modified", "modified date", "modification date", "updated", "updated date", "updated on",
        "updateddate", "last update", "last updated", "last updated on", "last updated date", "last modified",
        "record last updated on", "domain record last updated", "domain last updated date", "entry updated",
        "domain datelastmodified", "dernière modification", "最終更新"],
    "expiration": ["expire", "expires", "expires on", "expire date", "expiry", "expiry date", "exp date", "expiration",
        "expiration date", "expiration time", "registry expiry date", "registrar registration expiration date",
        "record expires on", "record will expire on", "domain expires", "domain expiration date", "paid till", "valid until",
        "validity", "renewal", "renewal date", "domain datebilleduntil", "date d'expiration"],
    "status": ["status", "state", "domain status", "registration status", "registry status", "transfer status", "query status",
        "statut", "状態"],
    "ns": ["nserver", "nameserver", "nameservers", "name server", "name servers", "name servers information",
        "name server information", "name servers in the listed order", "domain servers in listed order", "domain name servers",
        "domain nameservers", "dns servers", "host name", "hostname", "serveur de noms", "ネームサーバ"],
    "dnssec": ["dnssec", "signed", "signed delegation", "domain signed", "nsec", "signing key", "署名鍵"],
    "country": ["country", "registrant country", "org country", "domain holder country", "registrant country/economy", "país"],
    "email": ["e mail", "email", "holder email", "registrant contact email"],
}
# Labels that open a list of name servers.
NS_HEADERS = ["name servers", "nameservers", "name server", "domain servers", "name servers information", "name servers in the listed order",
              "domain servers in listed order", "domain name servers", "domain nameservers"]
# Beginnings of values that hide what they stand for.
WITHHELD = ["redacted", "not disclosed", "gdpr", "please visit", "see "]


def _label(c: Column) -> Column:
    """Lower-case label without list marks in front, dots behind, or hyphens and underscores."""
    bare = F.rtrim(F.ltrim(c, F.lit(" \t*>")), F.lit(" \t.\u3000"))
    return F.array_join(F.filter(F.split(F.lower(F.translate(bare, "-_", "  ")), " "), lambda x: x != ""), " ")


def _whois_key(label: Column) -> Column:
    """Canonical key of a label: a known one, else by how it begins and ends."""
    known = _mapped(label, {name: key for key, names in WHOIS_LABELS.items() for name in names})
    rules = (F.when(label.startswith("registrar abuse contact email"), "email")
             .when(label.startswith("ns name "), "ns")
             .when(label.startswith("registrant ") & label.endswith(" organization"), "org"))
    return F.coalesce(known, rules)


def _bracketed(line: Column) -> tuple[Column, Column]:
    """(label, value) of '[Label]  value', also behind an enumerator like 'a. '; nulls for other lines."""
    numbered = line.rlike("^[A-Za-z][.]")
    rest = F.when(numbered, F.ltrim(F.substring(line, 3, 1 << 20))).otherwise(line)
    close = F.instr(rest, "]")
    behind = F.substring(rest, close + 1, F.lit(1 << 20))
    value = F.trim(behind, F.lit(" \t"))
    ok = rest.startswith("[") & (close > 2) & behind.rlike(r"^\s") & (value != "")
    return F.when(ok, F.substring(rest, F.lit(2), close - 2)), F.when(ok, value)


def src_whois_text(df: DataFrame) -> DataFrame:
    """(doc, domain, text) -> (doc, domain, ord, k, v): canonical rows of free-text answers, one answer per ``doc``.

    Lines are rows; which label an indented value belongs to is the last state set above
    it, found with window functions over the lines of one answer. Answers of one domain stay apart.
    """
    lines = df.select("doc", "domain", F.posexplode(F.split("text", r"\r?\n")).alias("i", "raw"))
    blanks = F.lit(" \t\u3000")
    d = lines.withColumn("line", F.trim("raw", blanks)).withColumn("ind", F.col("raw") != F.ltrim("raw", blanks))
    label, value = _bracketed(F.col("line"))
    d = d.withColumn("_bl", label).withColumn("_bv", value).withColumn("_at", F.instr("line", ":"))
    comment = F.col("line").startswith("%") | F.col("line").startswith("#")
    d = d.withColumn("cls", F.when((F.col("line") == "") | comment, "blank").when(F.col("_bl").isNotNull(), "bracket")
                     .when(F.col("_at") > 0, "colon").otherwise("plain"))
    is_br, is_col = F.col("cls") == "bracket", F.col("cls") == "colon"
    before, after = F.substring("line", F.lit(1), F.col("_at") - 1), F.substring("line", F.col("_at") + 1, F.length("line"))
    d = d.withColumn("label", _label(F.when(is_br, F.col("_bl")).when(is_col, before).otherwise(F.col("line"))))
    d = d.withColumn("val", F.when(is_br, F.col("_bv")).when(is_col, F.trim(after)))
    d = d.withColumn("ck", F.when(is_br | is_col, _whois_key(F.col("label"))))
    is_ns = F.col("label").isin(*NS_HEADERS)
    dependent = (F.col("cls") == "plain") & F.col("ind")
    # the key that values below a line belong to
    opened = (F.when(is_col & (F.col("val") == ""), F.coalesce("ck", F.when(is_ns, "ns")))
              .when(is_col & (F.col("ck") == "ns"), "ns").when((F.col("cls") == "plain") & is_ns, "ns"))
    w = Window.partitionBy("doc").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_set", F.when(~dependent, F.struct(F.coalesce(opened, F.lit("")).alias("s"), F.col("i").alias("i"))))
    d = d.withColumn("_abs", F.last("_set", ignorenulls=True).over(w)).withColumn("_nsat", F.max(F.when(dependent & is_ns, F.col("i"))).over(w))
    s, j = F.coalesce(F.col("_abs.s"), F.lit("")), F.coalesce(F.col("_abs.i"), F.lit(-1))
    late = F.col("_nsat") > F.when(s == "", j).otherwise(j + 1)  # a bare header among the indented lines
    pending = F.when((s == "ns") | late, "ns").when((s != "") & (F.col("i") == j + 1), s)
    d = d.withColumn("k", F.when(is_br | is_col, F.when(F.col("val") != "", F.col("ck"))).when(dependent, pending))
    d = d.withColumn("v", F.when(dependent, F.col("line")).otherwise(F.col("val")))
    dated = F.col("k").isin("registration", "lastchanged", "expiration")
    d = d.withColumn("v", F.trim(F.when(dated, plain_date(F.col("v"))).otherwise(F.col("v"))))
    withheld = reduce(lambda x, y: x | y, [F.lower("v").startswith(w) for w in WITHHELD])
    rows = d.where("k IS NOT NULL AND k <> 'ldhname' AND v <> ''").where(~withheld)
    first = rows.groupBy("doc", "domain", "k", "v").agg(F.min("i").alias("ord"))
    head = df.select("doc", "domain", F.lit("ldhname").alias("k"), F.col("domain").alias("v"), F.lit(-1).alias("ord")).distinct()
    return head.unionByName(first)


# ---- peering dump -----------------------------------------------------------

def read_peeringdb(spark: SparkSession, path: str, items: dict[str, str], multi_line: bool = True) -> dict[str, DataFrame]:
    """Object lists of a dump by kind, with the item schema named for each; only status 'ok' (networks also need an ASN).

    A file is one document, or with ``multi_line`` off one document per line, which Spark can split.
    """
    schema = ", ".join(f"{kind} struct<data:array<{item}>>" for kind, item in items.items())
    raw = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    return {kind: _ok(raw.select(F.explode(F.col(kind)["data"]).alias("r")), kind) for kind in items}


def _ok(rows: DataFrame, kind: str) -> DataFrame:
    d = rows.select("r.*").where("status = 'ok'")
    return d.where("asn IS NOT NULL AND asn <> 0") if kind == "net" else d


def src_peeringdb(df: DataFrame, kind: str, item: str, col: str = "json") -> DataFrame:
    """The same from a JSON text column and an explicit item schema."""
    data = F.from_json(col, f"struct<{kind}:struct<data:array<{item}>>>")[kind]["data"]
    return _ok(df.select(F.explode(data).alias("r")), kind)


# ---- measurements -----------------------------------------------------------

_TIMINGS = "array<struct<rtt:double>>"
_STATS = "struct<min:double,max:double,avg:double,total:bigint,rcv:bigint,drop:bigint,loss:double>"
MEASUREMENT = f"""struct<id:string,type:string,target:string,results:array<struct<
 probe:struct<city:string,country:string,network:string,asn:bigint,latitude:double,longitude:double>,
 result:struct<status:string,resolvedAddress:string,resolvedHostname:string,stats:{_STATS},timings:{_TIMINGS},
  hops:array<struct<resolvedAddress:string,resolvedHostname:string,asn:array<bigint>,stats:{_STATS},timings:{_TIMINGS}>>>>>>"""
TRACE_MAP = """struct<schema:string,id:string,target:struct<ip:string>,probes:array<struct<id:string,hops:array<struct<idx:int,ip:string,rdns:string,
 asn:bigint,name:string,cc:string,city:string,lat:double,lon:double,rtt:double,loss:double,isTarget:boolean>>>>>"""


def hop_rtt(stats: Column, timings: Column) -> Column:
    """min of the statistics when something was received, else the smallest timing; 1 decimal."""
    best = F.array_min(F.filter(F.transform(timings, lambda t: t["rtt"]), lambda x: x.isNotNull()))
    return F.when(stats["rcv"] > 0, F.round(F.coalesce(stats["min"], stats["avg"], F.lit(0.0)), 1)).otherwise(F.round(best, 1))


def src_measurement(df: DataFrame, col: str = "json") -> DataFrame:
    """mtr, traceroute and ping results -> one hop schema; a ping becomes one synthetic hop."""
    m = df.select(F.from_json(col, MEASUREMENT).alias("m"))
    r = m.select(F.col("m.id").alias("trace"), F.col("m.type").alias("type"), F.col("m.target").alias("target"),
                 F.posexplode("m.results").alias("probe", "r"))
    res = F.col("r.result")
    tgt = F.coalesce(res["resolvedAddress"], F.col("target"))
    none_asn = F.lit(None).cast("array<bigint>")
    ping = F.array(F.struct(res["resolvedAddress"].alias("resolvedAddress"), res["resolvedHostname"].alias("resolvedHostname"), none_asn.alias("asn"),
                            res["stats"].alias("stats"), res["timings"].alias("timings")))
    hops = F.when(F.col("type") == "ping", ping).otherwise(res["hops"])
    h = r.select("trace", "type", "probe", tgt.alias("target_ip"), F.posexplode(hops).alias("i", "h"))
    ip_ = F.when(F.col("type") == "ping", F.col("target_ip")).otherwise(F.col("h.resolvedAddress"))
    return h.select("trace", "probe", (F.col("i") + 1).alias("idx"), ip_.alias("ip"), F.get("h.asn", 0).alias("asn"),
                    F.when(~F.col("h.resolvedHostname").eqNullSafe(ip_), F.col("h.resolvedHostname")).alias("rdns"),
                    hop_rtt(F.col("h.stats"), F.col("h.timings")).alias("rtt"), F.round(F.coalesce("h.stats.loss", F.lit(0.0))).cast("int").alias("loss"),
                    ((F.col("type") == "ping") | ip_.eqNullSafe(F.col("target_ip"))).alias("is_target")).where("ip IS NOT NULL")


def rtt_samples(df: DataFrame, col: str = "json") -> DataFrame:
    """RTT samples of the last hop (ping: of the result itself)."""
    r = df.select(F.from_json(col, MEASUREMENT).alias("m")).select(
        F.col("m.id").alias("trace"), F.col("m.type").alias("type"), F.posexplode("m.results").alias("probe", "r"))
    t = F.when(F.col("type") == "ping", F.col("r.result.timings")).otherwise(F.try_element_at("r.result.hops", F.lit(-1))["timings"])
    return r.select("trace", "probe", F.posexplode(t).alias("n", "t")).where("t.rtt IS NOT NULL").select(
        "trace", "probe", "n", F.round("t.rtt", 1).alias("rtt"))


def src_trace_map(df: DataFrame, col: str = "json", schema_tag: str | None = None) -> DataFrame:
    """Trace-map documents -> the same hop schema; the last hop is the target if none is marked."""
    m = df.select(F.from_json(col, TRACE_MAP).alias("m"))
    if schema_tag is not None:
        m = m.where(F.col("m.schema") == schema_tag)
    p = m.select(F.col("m.id").alias("trace"), F.posexplode("m.probes").alias("probe", "p"))
    marked = F.exists("p.hops", lambda h: F.coalesce(h["isTarget"], F.lit(False)))
    h = p.select("trace", "probe", marked.alias("_m"), F.size("p.hops").alias("_n"), F.posexplode("p.hops").alias("i", "h"))
    return h.select("trace", "probe", F.coalesce("h.idx", F.col("i") + 1).alias("idx"), F.col("h.ip").alias("ip"), F.coalesce("h.asn", F.lit(0)).alias("asn"),
                    F.coalesce("h.cc", F.lit("")).alias("cc"), F.coalesce("h.city", F.lit("")).alias("city"), F.col("h.lat").alias("lat"), F.col("h.lon").alias("lon"),
                    F.col("h.rtt").alias("rtt"), F.round(F.coalesce("h.loss", F.lit(0.0))).cast("int").alias("loss"),
                    F.when(F.col("_m"), F.coalesce("h.isTarget", F.lit(False))).otherwise(F.col("i") == F.col("_n") - 1).alias("is_target"))
