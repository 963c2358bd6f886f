"""Peering database: cleaned tables and the profile queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runs

# Columns of the published tables as (name, kind, length). Kinds:
# s text, i integer (bad -> 0), f float (bad -> NULL), b boolean, u first social URL.
NORMAL_COLUMNS = {
    "net": (("asn", "i"), ("id", "i"), ("org_id", "i"), ("name", "s"), ("aka", "s"), ("name_long", "s"),
            ("website", "s"), ("social_media", "u"), ("looking_glass", "s"), ("route_server", "s"),
            ("irr_as_set", "s"), ("info_type", "s"), ("info_prefixes4", "i"), ("info_prefixes6", "i"),
            ("info_traffic", "s"), ("info_ratio", "s"), ("info_scope", "s"), ("info_unicast", "b"),
            ("info_multicast", "b"), ("info_ipv6", "b"), ("info_never_via_route_servers", "b"), ("ix_count", "i"),
            ("fac_count", "i"), ("policy_url", "s"), ("policy_general", "s"), ("policy_locations", "s"),
            ("policy_ratio", "b"), ("policy_contracts", "s"), ("status_dashboard", "s"), ("rir_status", "s"),
            ("updated", "s")),
    "ix": (("id", "i"), ("org_id", "i"), ("name", "s"), ("aka", "s"), ("name_long", "s"), ("city", "s"),
           ("country", "s"), ("region_continent", "s"), ("media", "s"), ("proto_unicast", "b"),
           ("proto_multicast", "b"), ("proto_ipv6", "b"), ("website", "s"), ("social_media", "u"),
           ("url_stats", "s"), ("net_count", "i"), ("fac_count", "i"), ("ixf_net_count", "i"),
           ("ixf_last_import", "s"), ("service_level", "s"), ("terms", "s"), ("updated", "s")),
    "ixlan": (("id", "i"), ("ix_id", "i"), ("name", "s"), ("descr", "s"), ("mtu", "i"), ("dot1q_support", "s"),
              ("rs_asn", "i"), ("arp_sponge", "s"), ("ixf_ixp_import_enabled", "b"), ("updated", "s")),
    "ixpfx": (("id", "i"), ("ixlan_id", "i"), ("protocol", "s"), ("prefix", "s"), ("in_dfz", "b"), ("updated", "s")),
    "fac": (("id", "i"), ("org_id", "i"), ("org_name", "s"), ("campus_id", "i"), ("name", "s"), ("aka", "s"),
            ("name_long", "s"), ("website", "s"), ("social_media", "u"), ("clli", "s"), ("net_count", "i"),
            ("ix_count", "i"), ("carrier_count", "i"), ("region_continent", "s"), ("address1", "s"), ("address2", "s"),
            ("city", "s"), ("country", "s"), ("state", "s"), ("zipcode", "s"), ("latitude", "f"), ("longitude", "f"),
            ("updated", "s")),
    "netixlan": (("asn", "i"), ("net_id", "i"), ("ix_id", "i"), ("ixlan_id", "i"), ("id", "i"), ("name", "s"),
                 ("speed", "i"), ("ipaddr4", "s"), ("ipaddr6", "s"), ("is_rs_peer", "b"), ("bfd_support", "b"),
                 ("operational", "b"), ("updated", "s")),
    "netfac": (("net_id", "i"), ("fac_id", "i"), ("id", "i"), ("name", "s"), ("city", "s"), ("country", "s"),
               ("local_asn", "i"), ("updated", "s")),
    "ixfac": (("id", "i"), ("ix_id", "i"), ("fac_id", "i"), ("name", "s"), ("city", "s"), ("country", "s"),
              ("updated", "s")),
}
RENAMES = {"social_media": "social_url"}


def _clean(c: Column) -> Column:
    return F.trim(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("\x00"), F.lit("")))


def pdb_normalize(raw: DataFrame, kind: str) -> DataFrame:
    """Trimmed and typed columns of one object list; absent columns get the default."""
    have = set(raw.columns)
    out = []
    for name, k in NORMAL_COLUMNS[kind]:
        c = F.col(name) if name in have else F.lit(None)
        if k == "s":
            v = _clean(c)
        elif k == "i":
            v = F.coalesce(c.cast("string").try_cast("bigint"), F.lit(0).cast("bigint"))
        elif k == "f":
            v = F.nullif(c.cast("string"), F.lit("")).try_cast("double")
        elif k == "b":
            v = F.coalesce(c.cast("string").isin("true", "1"), F.lit(False))
        else:
            ids = F.filter(F.transform(c, lambda x: x["identifier"]), lambda x: x.isNotNull() & (x != "")) if name in have else None
            v = _clean(F.get(ids, 0)) if ids is not None else F.lit("")
        target = f"{kind}_id" if name == "id" else RENAMES.get(name, name)
        out.append(v.alias(target))
    if kind == "net":
        types = F.array_join(F.transform("info_types", lambda x: _clean(x)), "|") if "info_types" in have else F.lit("")
        out.append(F.coalesce(types, F.lit("")).alias("info_types"))
    return raw.select(*out)


def pdb_as_set_fallback(net: DataFrame, as_set: DataFrame) -> DataFrame:
    """IRR as-set of the network, else of the separate map."""
    m = as_set.select("asn", F.col("irr_as_set").alias("_m"))
    return net.join(m, ["asn"], "left").withColumn(
        "irr_as_set", F.coalesce(F.nullif("irr_as_set", F.lit("")), "_m", F.lit(""))).drop("_m")


def pdb_presence(netixlan: DataFrame, net: DataFrame) -> DataFrame:
    """ASN from the row's network, else its own; rows without an ASN are dropped."""
    n = net.where("asn > 0").select("net_id", F.col("asn").alias("_a"))
    return (netixlan.join(n, ["net_id"], "left").withColumn("asn", F.coalesce("_a", F.nullif("asn", F.lit(0)))).drop("_a")
            .where("asn IS NOT NULL"))


def pdb_netfac(netfac: DataFrame, net: DataFrame) -> DataFrame:
    """Facility presence, ASN only through the network."""
    return netfac.join(net.where("asn > 0").select("net_id", "asn"), ["net_id"])


def pdb_asn_profile(netixlan: DataFrame, ix: DataFrame, netfac: DataFrame | None = None, fac: DataFrame | None = None,
                    ix_cap: int | None = None, fac_cap: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Per ASN: exchanges (operational, speed, name) and facilities (net_count, nulls last)."""
    j = netixlan.join(ix.select("ix_id", F.col("name").alias("ix_name"), F.col("city").alias("ix_city"), F.col("country").alias("ix_country")),
                      ["ix_id"], "left")
    exchanges = runs.ranked(j, "pos", [F.desc("operational"), F.desc("speed"), F.col("ix_name"), F.col("ix_id")], ["asn"], ix_cap)
    if netfac is None:
        return exchanges, None
    f = netfac.join(fac.select("fac_id", F.col("name").alias("fac_name"), "net_count"), ["fac_id"], "left")
    return exchanges, runs.ranked(f, "pos", [F.desc_nulls_last("net_count"), F.col("fac_name"), F.col("fac_id")], ["asn"], fac_cap)


def ix_list(ix: DataFrame) -> DataFrame:
    return ix.orderBy(F.desc("net_count"), "name")


def ix_members(netixlan: DataFrame, net: DataFrame, cap: int | None = None) -> DataFrame:
    """Members of each exchange with network facts, operational and fast ones first."""
    facts = [c for c in ("info_type", "info_traffic") if c in net.columns]
    j = netixlan.join(net.select("asn", F.col("name").alias("net_name"), *facts), ["asn"], "left")
    return runs.ranked(j, "pos", [F.desc("operational"), F.desc("speed"), F.col("asn")], ["ix_id"], cap)


def ix_detail(ix: DataFrame, ixlan: DataFrame, ixpfx: DataFrame, ixfac: DataFrame, fac: DataFrame) -> dict[str, DataFrame]:
    """LANs, prefixes and facilities of every exchange (filter by ix_id for one)."""
    lans = ix.select("ix_id").join(ixlan, ["ix_id"])
    prefixes = ixlan.select("ixlan_id", "ix_id", F.col("name").alias("lan_name")).join(
        ixpfx.select("ixlan_id", "protocol", "prefix"), ["ixlan_id"])
    f = fac.select("fac_id", F.col("name").alias("_n"), F.col("city").alias("_c"), F.col("country").alias("_k"), "net_count")
    facilities = ixfac.join(f, ["fac_id"], "left").select(
        "ix_id", "fac_id", F.coalesce("_n", "name").alias("fac_name"), F.coalesce("_c", "city").alias("city"),
        F.coalesce("_k", "country").alias("country"), "net_count")
    return {"lans": lans, "prefixes": prefixes, "facilities": facilities}


def ix_members_view(members: DataFrame, term: str = "", sort: str = "speed", descending: bool = True) -> DataFrame:
    """Filter by asn/name/address substring; every row carries the exchange's total capacity."""
    total = members.groupBy("ix_id").agg(F.sum("speed").alias("total_speed"))
    hay = [F.col("asn").cast("string"), *[F.coalesce(F.col(c), F.lit("")) for c in ("net_name", "ipaddr4", "ipaddr6") if c in members.columns]]
    d = members.where(F.lower(F.concat_ws(" ", *hay)).contains(term.strip().lower())) if term.strip() else members
    key = {"asn": F.col("asn"), "speed": F.coalesce("speed", F.lit(0)), "name": F.lower(F.coalesce("net_name", F.lit("")))}[sort]
    return d.join(total, ["ix_id"]).orderBy(key.desc() if descending else key.asc(), "asn")
