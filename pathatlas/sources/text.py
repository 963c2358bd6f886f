"""Registry and statistics texts -> tables. Parsers take a text column; readers add files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ip

ATTRS = "array<struct<k:string,v:string>>"


BLANK_LINE = r"\r?\n[ \t]*\r?\n"


def read_rpsl_text(spark: SparkSession, path: str, line_end: str = "\n") -> DataFrame:
    """RPSL dumps split at blank lines -> (source_file, obj_no, obj); bytes are latin-1.

    Spark splits the file at doubled line ends (name ``\\r\\n`` for such dumps); lines of blanks only
    then split what is left.
    """
    raw = spark.read.text(path, lineSep=line_end * 2)
    d = raw.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_b"),
                   F.monotonically_increasing_id().alias("_i"), F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("_text"))
    d = d.select("source_file", "_b", "_i", F.posexplode(F.split("_text", BLANK_LINE)).alias("_j", "obj"))
    return d.where(F.trim(F.regexp_replace("obj", r"\s+", " ")) != "").select(
        "source_file", F.struct("source_file", "_b", "_i", "_j").alias("obj_no"), "obj")


def rpsl_attrs(obj, registry_style: bool = False) -> Column:
    """One object text -> ordered ARRAY<STRUCT<k, v>>.

    Comment lines go away, continuation lines (space, tab, '+') join the value before
    them, keys are lower-case. Linear in the text: joins happen by pattern, not by fold.
    """
    t = F.regexp_replace(F.col(obj) if isinstance(obj, str) else obj, "\r", "")
    if not registry_style:
        t = F.regexp_replace(t, r"(?m)^[#%].*\n?", "")
    t = F.regexp_replace(t, r"^(?:[ \t+][^\n]*(?:\n|$)|\n)+", "")
    if registry_style:  # blank lines are skipped, leading plus signs are not part of the value
        t = F.regexp_replace(F.regexp_replace(t, r"\n[ \t]*(?=\n)", ""), r"[ \t]*(?:\n[ \t+]+)+", " ")
    else:
        t = F.regexp_replace(F.regexp_replace(t, r"[ \t]*\n(?=\+)", " "), r"[ \t]*\n[ \t]+", " ")
    keep = r"^[A-Za-z0-9][A-Za-z0-9_-]*:" if registry_style else ":"
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(keep))
    return F.transform(lines, lambda x: F.struct(
        F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"),
        F.regexp_replace(F.substring(x, F.locate(":", x) + 1, F.length(x)), r"^\s+|\s+$", "").alias("v")))


def src_rpsl(df: DataFrame, obj: str = "obj") -> DataFrame:
    # the one-element explode keeps the optimizer from copying the parser into filters on its result
    return df.withColumn("attrs", F.explode(F.array(rpsl_attrs(obj))))


def src_registry(spark: SparkSession, root: str) -> DataFrame:
    """Registry tree (one object per file under <type>/) -> (type, key, attrs)."""
    d = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(root)
    path = F.col("_metadata.file_path")
    return registry_objects(d.select(F.element_at(F.split(path, "/"), -2).alias("type"),
                                     F.element_at(F.split(path, "/"), -1).alias("key"), F.col("value").alias("obj")))


def registry_objects(df: DataFrame) -> DataFrame:
    return df.select("type", "key", rpsl_attrs("obj", registry_style=True).alias("attrs"))


def attr_first(name: str, attrs: str = "attrs") -> Column:
    return F.get(F.filter(attrs, lambda a: a["k"] == name), 0)["v"]


def attr_all(name: str, attrs: str = "attrs") -> Column:
    return F.transform(F.filter(attrs, lambda a: a["k"] == name), lambda a: a["v"])


def _uncomment(c: Column) -> Column:
    return F.trim(F.element_at(F.split(c, "#"), 1))


def asn_value(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(c)), "^AS", "").try_cast("bigint")


def irr_route_extract(objects: DataFrame, default_source: str, family: int = 4) -> DataFrame:
    """route / route6 objects -> (family, ip_start, ip_end, plen, origin, source), whole-row distinct."""
    kind = "route" if family == 4 else "route6"
    b = (ip.cidr4_bounds if family == 4 else ip.cidr6_bounds)(_uncomment(attr_first(kind)))
    d = objects.where(F.get("attrs", 0)["k"] == kind).select(
        F.explode(F.array(b)).alias("b"), asn_value(_uncomment(attr_first("origin"))).alias("origin"),
        F.coalesce(F.nullif(F.upper(_uncomment(attr_first("source"))), F.lit("")), F.lit(default_source)).alias("source"))
    return d.where("b IS NOT NULL AND origin IS NOT NULL").select(
        F.lit(family).alias("family"), F.col("b.start").alias("ip_start"), F.col("b.end").alias("ip_end"),
        F.col("b.plen").alias("plen"), "origin", "source").distinct()


def src_irr_journal(df: DataFrame, text: str = "text", default_source: str = "") -> DataFrame:
    """Journal texts of blocks ``ADD n`` / ``DEL n``, each followed by its object ->
    (serial, op, family, start4 or start6, plen, origin, source).

    Other blocks (headers, ends, objects of other classes) and malformed objects say nothing.
    """
    blocks = F.split(F.regexp_replace(text, "^\\s+", ""), BLANK_LINE)
    paired = F.zip_with(blocks, F.slice(blocks, 2, 1 << 30), lambda head, body: F.struct(F.trim(head).alias("head"), body.alias("body")))
    d = df.select(F.explode(paired).alias("p")).select(
        F.upper(F.substring_index("p.head", " ", 1)).alias("op"), F.trim(F.substring_index("p.head", " ", -1)).try_cast("bigint").alias("serial"),
        rpsl_attrs(F.col("p.body")).alias("attrs")).where("op IN ('ADD', 'DEL') AND serial IS NOT NULL")
    kind = F.get("attrs", 0)
    key = _uncomment(kind["v"])
    d = d.select("serial", "op", F.when(kind["k"] == "route", ip.cidr4_bounds(key)).alias("b4"), F.when(kind["k"] == "route6", ip.cidr6_bounds(key)).alias("b6"),
                 asn_value(_uncomment(attr_first("origin"))).alias("origin"),
                 F.coalesce(F.nullif(F.upper(_uncomment(attr_first("source"))), F.lit("")), F.lit(default_source)).alias("source"))
    d = d.where("(b4 IS NOT NULL OR b6 IS NOT NULL) AND origin IS NOT NULL")
    return d.select("serial", "op", F.when(F.col("b4").isNotNull(), 4).otherwise(6).alias("family"), F.col("b4.start").alias("start4"),
                    F.col("b6.start").alias("start6"), F.coalesce("b4.plen", "b6.plen").alias("plen"), "origin", "source")


# ---- ROA documents ----------------------------------------------------------

VRP_JSON = "struct<roas:array<struct<prefix:string,asn:string,maxLength:string>>>"


def read_vrp(spark: SparkSession, path: str, family: int = 4, multi_line: bool = True) -> DataFrame:
    """ROA files: one document each, or with ``multi_line`` off one document per line, which Spark can split."""
    schema = "roas array<struct<prefix:string,asn:string,maxLength:string>>"
    return vrp_rows(spark.read.schema(schema).option("multiLine", multi_line).json(path), "roas", family)


def src_vrp(df: DataFrame, col: str = "json", family: int = 4) -> DataFrame:
    return vrp_rows(df.select(F.from_json(col, VRP_JSON)["roas"].alias("roas")), "roas", family)


def vrp_rows(df: DataFrame, roas: str, family: int) -> DataFrame:
    """Bad rows are dropped; maxLength defaults to the prefix length."""
    b = (ip.cidr4_bounds if family == 4 else ip.cidr6_bounds)(F.col("r.prefix"))
    d = df.select(F.explode(roas).alias("r")).select(b.alias("b"), asn_value(F.col("r.asn")).alias("asn"),
                                                     F.col("r.maxLength").alias("m"))
    n = F.nullif(F.col("m").try_cast("int"), F.lit(0))
    return d.where("b IS NOT NULL AND asn IS NOT NULL").where(F.col("m").isNull() | F.col("m").try_cast("int").isNotNull()).select(
        F.lit(family).alias("family"), F.col("b.start").alias("ip_start"), F.col("b.end").alias("ip_end"),
        F.col("b.plen").alias("vlen"), F.coalesce(n, F.col("b.plen")).alias("maxlen"), "asn")


# ---- geography texts --------------------------------------------------------

_GEO = ("start_num", "end_num", "family", "cc", "province", "city", "provider")


def src_delegated(df: DataFrame, col: str = "value") -> DataFrame:
    """Delegated-extended statistics: allocated or assigned IPv4 -> country-level intervals."""
    p = F.split(F.col(col), r"\|")
    s, n = ip.ip4_to_int(F.get(p, 3)), F.get(p, 4).try_cast("bigint")
    ok = (~F.col(col).startswith("#") & (F.size(p) >= 7) & (F.get(p, 2) == "ipv4") & (F.get(p, 1) != "")
          & (F.get(p, 3) != "*") & F.get(p, 6).isin("allocated", "assigned") & s.isNotNull() & n.isNotNull())
    none = F.lit(None).cast("string")
    return df.where(ok).select(s.alias("start_num"), (s + n - 1).alias("end_num"), F.lit(4).alias("family"), F.get(p, 1).alias("cc"),
                               none.alias("province"), none.alias("city"), F.lit("rir").alias("provider"))


def src_city_intervals(df: DataFrame, col: str = "value", only_cc: str | None = "CN") -> DataFrame:
    """'|' text of at least 13 fields: bounds 3-4, country name 6, province 7, city 8, code 13."""
    p = F.split(F.col(col), r"\|")
    f = lambda i: F.get(p, i)
    s, e = f(2).try_cast("bigint"), f(3).try_cast("bigint")
    ok = (F.size(p) >= 13) & s.isNotNull() & e.isNotNull() & ~F.col(col).startswith("start_ip")
    d = df.where(ok if only_cc is None else ok & (f(12) == only_cc))
    return d.select(s.alias("start_num"), e.alias("end_num"), F.lit(4).alias("family"), f(12).alias("cc"),
                    F.nullif(f(6), F.lit("")).alias("province"), F.nullif(f(7), F.lit("")).alias("city"), F.lit("ipdb").alias("provider"))


def src_geo_networks(networks: DataFrame, have_cn_source: bool = True, family: int = 4) -> DataFrame:
    """Tabular network -> place rows (network, country, registered_country, province_en, city_zh, city_en)."""
    b = (ip.cidr4_bounds if family == 4 else ip.cidr6_bounds)("network")
    cc = F.coalesce("country", "registered_country")
    d = networks.withColumn("_b", b).withColumn("cc", cc).where("_b IS NOT NULL AND cc IS NOT NULL")
    if have_cn_source and family == 4:
        d = d.where("cc <> 'CN'")
    return d.select(F.col("_b.start").alias("start_num"), F.col("_b.end").alias("end_num"), F.lit(family).alias("family"), "cc",
                    F.nullif("province_en", F.lit("")).alias("province"),
                    F.nullif(F.coalesce("city_zh", "city_en"), F.lit("")).alias("city"), F.lit("geolite").alias("provider"))


# ---- AS names ---------------------------------------------------------------

def src_asn_org(networks: DataFrame, start: str = "ip_start") -> DataFrame:
    """(start, asn, org) -> first organisation of each ASN."""
    ok = networks.where("asn IS NOT NULL AND asn <> 0 AND org IS NOT NULL AND org <> ''")
    return ok.groupBy("asn").agg(F.min_by("org", F.struct(start, "org")).alias("org"))


def src_autnums(df: DataFrame, col: str = "value") -> DataFrame:
    """'<asn> NAME - descr, CC' -> asn, handle, registration country."""
    t = F.trim(F.col(col))
    asn = F.regexp_extract(t, r"^(\d+)\s+", 1)
    rest = F.regexp_replace(t, r"^\d+\s+", "")
    full = F.trim(F.regexp_replace(rest, r",[^,]*$", ""))
    cc = F.upper(F.trim(F.regexp_extract(rest, r",([^,]*)$", 1)))
    d = df.where(asn != "").select(
        asn.try_cast("bigint").alias("asn"), F.nullif(F.trim(F.substring_index(full, " - ", 1)), F.lit("")).alias("handle"),
        F.when(cc.rlike("^[A-Z]{2}$"), cc).alias("cc"))
    return d.where("handle IS NOT NULL OR cc IS NOT NULL")


def src_asn_registry(df: DataFrame, col: str = "value") -> DataFrame:
    """Curated CSV lines 'asn,name,name_en,op' with '#' comments; non-numeric rows are dropped."""
    r = F.from_csv(F.col(col), "asn string, name string, name_en string, op string")
    d = df.where(~F.trim(F.col(col)).startswith("#") & (F.trim(F.col(col)) != "")).select(r.alias("r")).select("r.*")
    clean = lambda c: F.nullif(F.trim(c), F.lit("")).alias(c)
    return d.where(F.trim("asn").rlike(r"^\d+$")).select(F.trim("asn").try_cast("bigint").alias("asn"), clean("name"), clean("name_en"), clean("op"))
