"""Registry objects (type, key, attrs): people, ROAs, whois rows, zones, holders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ip
from ..sources.text import asn_value, attr_all, attr_first
from . import runs

DOMAIN_BYTES = 4 << 20  # of compressed input to one task of a suffix join, where a domain is a row for each of its labels
DROPPED_ATTRS = ("auth", "pgp-fingerprint")  # fixed values: never published


def roa_from_registry(objects: DataFrame, family: int = 4) -> DataFrame:
    """Route objects as ROAs and route objects, one row per origin."""
    kind = "route" if family == 4 else "route6"
    b = (ip.cidr4_bounds if family == 4 else ip.cidr6_bounds)(attr_first(kind))
    maxl = attr_first("max-length")
    d = objects.where(F.col("type") == kind).select(b.alias("b"), maxl.alias("m"), attr_all("origin").alias("os"))
    d = d.select("b", "m", F.explode("os").alias("o"))
    d = d.withColumn("asn", asn_value(F.col("o"))).where("b IS NOT NULL AND asn IS NOT NULL")
    d = d.where(F.coalesce("m", F.lit("")).isin("") | F.col("m").try_cast("int").isNotNull())
    return d.select(F.lit(family).alias("family"), F.col("b.start").alias("ip_start"), F.col("b.end").alias("ip_end"),
                    F.col("b.plen").alias("vlen"), F.coalesce(F.col("m").try_cast("int"), F.col("b.plen")).alias("maxlen"), "asn")


def registry_asn_person(objects: DataFrame) -> DataFrame:
    """ASN -> responsible person: admin-c, else tech-c; else those of the maintainer."""
    contact = F.coalesce(attr_first("admin-c"), attr_first("tech-c"))
    people = objects.where("type = 'person'").select(F.col("key").alias("person"), F.coalesce(attr_first("person"), F.col("key")).alias("person_name"))
    mnt = objects.where("type = 'mntner'").select(F.col("key").alias("_mnt"), contact.alias("_mc"))
    a = objects.where(F.col("type") == "aut-num").where(F.col("key").rlike(r"^AS\d+$")).select(
        asn_value(F.col("key")).alias("asn"), attr_first("as-name").alias("as_name"), contact.alias("_c"), attr_first("mnt-by").alias("_mnt"))
    known = people.select(F.col("person").alias("_c"), F.lit(True).alias("_ok"))
    a = a.join(known, ["_c"], "left").join(mnt, ["_mnt"], "left")
    a = a.withColumn("person", F.when(F.col("_ok"), F.col("_c")).otherwise(F.col("_mc")))
    return a.join(people, ["person"], "left").select(
        "asn", "as_name", F.when(F.col("person_name").isNotNull(), F.col("person")).alias("person"), "person_name")


def person_directory(asn_person: DataFrame, origin_prefixes: DataFrame, seen: DataFrame) -> DataFrame:
    """Per person: ASNs seen in the data and their prefixes; order by size, then name."""
    d = (asn_person.where("person IS NOT NULL").join(seen.select("asn").distinct(), ["asn"], "left_semi")
         .join(origin_prefixes.select(F.col("origin_asn").alias("asn"), "n_prefix"), ["asn"], "left"))
    return d.groupBy("person", "person_name").agg(
        F.array_sort(F.collect_set("asn")).alias("asns"), F.sum(F.coalesce("n_prefix", F.lit(0))).alias("n_prefix")).orderBy(
        F.desc("n_prefix"), F.lower("person_name"), "person")


def _public(attrs: str = "attrs"):
    return F.filter(attrs, lambda a: ~a["k"].isin(*DROPPED_ATTRS))


def registry_whois(objects: DataFrame, kind: str = "aut-num") -> DataFrame:
    """Head rows and entity rows of every object: (key, part, role, handle, ord, k, v)."""
    o = objects.where(F.col("type") == kind).select("key", "attrs")
    head = o.select("key", F.lit("head").alias("part"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("handle"),
                    F.posexplode(_public()).alias("ord", "a")).select("key", "part", "role", "handle", "ord", "a.k", "a.v")
    wanted = F.filter("attrs", lambda a: a["k"].isin("admin-c", "tech-c", "mnt-by"))
    refs = o.select("key", F.explode(F.array_distinct(wanted)).alias("r")).select(
        "key", F.col("r.k").alias("role"), F.col("r.v").alias("handle"), F.when(F.col("r.k") == "mnt-by", "mntner").otherwise("person").alias("type"))
    targets = objects.where("type IN ('person', 'mntner')").select("type", F.col("key").alias("handle"), _public().alias("attrs"))
    ents = refs.join(targets, ["type", "handle"]).select(
        "key", F.lit("entity").alias("part"), "role", "handle", F.posexplode("attrs").alias("ord", "a")).select(
        "key", "part", "role", "handle", "ord", "a.k", "a.v")
    return head.unionByName(ents)


def zone_lookup(domains: DataFrame, zones: DataFrame) -> DataFrame:
    """Closest registered zone of each domain: one equi-join on its suffixes.

    A zone of one label may end a large share of all domains, so its join key is salted. The number of tasks follows the input.
    """
    n = runs.tasks(domains, DOMAIN_BYTES)
    labels = F.filter(F.split(F.regexp_replace(F.lower("domain"), r"\.$", ""), r"\."), lambda x: x != "")
    known = domains.select("domain").repartition(n, "domain").distinct()
    d = known.withColumn("_l", labels)
    suffix = d.select("domain", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_l"), F.lit(1))), lambda i: F.array_join(
        F.slice("_l", i, F.size("_l")), "."))).alias("depth", "zone"))
    short = ~F.col("zone").contains(".")
    salted = suffix.withColumn("_salt", F.when(short, F.pmod(F.xxhash64("domain"), F.lit(n)).cast("int")).otherwise(F.lit(0)))
    build = zones.select("zone").distinct().withColumn("_salt", F.explode(F.when(short, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))))
    hit = salted.repartition(n, "zone", "_salt").join(build, ["zone", "_salt"])
    best = hit.select("domain", "depth").repartition(n, "domain").groupBy("domain").agg(F.min("depth").alias("_depth"))
    zone = F.when(F.col("_depth").isNotNull(), F.array_join(F.slice("_l", F.col("_depth") + 1, F.greatest(F.size("_l"), F.lit(1))), "."))
    return known.join(best, ["domain"], "left").withColumn("_l", labels).select("domain", zone.alias("zone"))


def ip_holder(entities: DataFrame, entity_rows: DataFrame, head: DataFrame) -> DataFrame:
    """(doc) -> org, netname, cc: registrant entity, else administrative, else the first."""
    rank = F.when(F.array_contains("roles", "registrant"), 0).when(F.array_contains("roles", "administrative"), 1).otherwise(2)
    top = entities.where("depth = 0").groupBy("doc").agg(F.min_by(F.struct("entity", "name"), F.struct(rank, F.col("ord"))).alias("e")).select("doc", "e.*")
    orgs = entity_rows.where("k = 'org'").groupBy("doc", "entity").agg(F.min_by("v", "ord").alias("_org"))
    row = lambda k: F.min_by(F.when(F.col("k") == k, F.col("v")), F.when(F.col("k") == k, F.col("ord")))
    h = head.groupBy("doc").agg(row("name").alias("netname"), row("country").alias("cc"))
    org = F.coalesce(F.col("_org"), F.when(F.col("name") != "?", F.col("name")), F.lit(""))
    return (h.join(top, ["doc"], "left").join(orgs, ["doc", "entity"], "left")
            .select("doc", org.alias("org"), F.coalesce("netname", F.lit("")).alias("netname"), F.coalesce("cc", F.lit("")).alias("cc")))
