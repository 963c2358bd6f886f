"""Geography: non-overlapping intervals, as-of lookup, prefix forest, carving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ip, text
from . import consolidate as C
from . import runs
from .intervals import intervals_merge, intervals_subtract
from .joins import asof_join, overlap_scan
from .sweep import enclosing

DEFAULT_POINT = (20.0, 0.0)

# Country centroids (latitude, longitude).
CENTROIDS = {
    "CN": (35.0, 103.0), "HK": (22.32, 114.17), "TW": (23.7, 121.0), "MO": (22.16, 113.55), "JP": (36.2, 138.3),
    "KR": (36.5, 127.9), "SG": (1.35, 103.82), "MY": (4.2, 101.9), "TH": (15.0, 101.0), "VN": (16.2, 107.8),
    "IN": (22.0, 79.0), "ID": (-2.5, 118.0), "PH": (12.8, 121.8), "AU": (-25.0, 134.0), "NZ": (-41.0, 174.0),
    "US": (39.0, -98.0), "CA": (56.0, -106.0), "MX": (23.6, -102.5), "BR": (-10.0, -52.0), "AR": (-34.0, -64.0),
    "GB": (54.0, -2.0), "IE": (53.4, -8.0), "FR": (46.6, 2.4), "DE": (51.2, 10.4), "NL": (52.2, 5.3), "BE": (50.6, 4.6),
    "LU": (49.8, 6.1), "CH": (46.8, 8.2), "AT": (47.6, 14.1), "IT": (42.8, 12.8), "ES": (40.0, -3.7), "PT": (39.6, -8.0),
    "SE": (62.0, 15.0), "NO": (64.0, 11.0), "FI": (64.0, 26.0), "DK": (56.0, 9.5), "PL": (52.0, 19.0), "CZ": (49.8, 15.5),
    "RU": (61.5, 99.0), "UA": (48.4, 31.2), "TR": (39.0, 35.2), "IL": (31.4, 35.0), "AE": (24.0, 54.0), "SA": (24.0, 45.0),
    "ZA": (-29.0, 24.0), "EG": (26.8, 30.8), "NG": (9.1, 8.7), "KE": (0.2, 37.9),
}


def geo_merge(raw: DataFrame, chunks: int | None = None) -> DataFrame:
    """Providers -> disjoint intervals (one family per call).

    Earlier start wins, then provider priority; covered rows vanish, partly covered
    starts move behind the running maximum end.
    """
    wide = ip.is_wide(raw, "start_num")
    prio = F.when(F.col("provider") == "ipdb", 3).when(F.col("provider") == "geolite", 2).otherwise(1)
    d = raw.withColumn("_np", -prio)
    order = [F.col("start_num"), F.col("_np"), F.col("end_num"), F.coalesce("cc", F.lit("")), F.coalesce("city", F.lit(""))]
    c = runs.with_chunks(d, order, chunks=chunks)
    c = runs.drop_chunks(runs.scan(c, "_max", F.col("end_num"), "max", order, inclusive=False))
    keep = F.col("_max").isNull() | (F.col("end_num") > F.col("_max"))
    start = F.when(F.col("start_num") <= F.col("_max"), ip.succ("_max", wide)).otherwise(F.col("start_num"))
    return c.where(keep).withColumn("start_num", start).drop("_max", "_np")


def geo_coalesce(geo: DataFrame, chunks: int | None = None) -> DataFrame:
    """Join touching neighbours that agree on country, province and city (null-safe)."""
    wide = ip.is_wide(geo, "start_num")
    order = [F.col("start_num")]
    c = runs.with_chunks(geo, order, chunks=chunks)
    c = runs.scan(c, "_prev", F.struct("end_num", "cc", "province", "city"), "last", order, inclusive=False)
    same = F.coalesce(F.col("start_num") == ip.succ(F.col("_prev.end_num"), wide), F.lit(False))
    for k in ("cc", "province", "city"):
        same = same & F.col(k).eqNullSafe(F.col(f"_prev.{k}"))
    c = runs.scan(c, "_island", F.when(~same, F.col("start_num")), "last", order)
    return c.groupBy("family", "_island").agg(
        F.max("end_num").alias("end_num"),
        F.min_by(F.struct("cc", "province", "city", "provider"), "start_num").alias("_f")).select(
        F.col("_island").alias("start_num"), "end_num", "family", "_f.*")


def country_dim(names: DataFrame) -> DataFrame:
    """(cc, lang, name, ord) -> one row per cc; first name seen, four fixed wordings."""
    first = names.where("cc IS NOT NULL AND name IS NOT NULL").groupBy("cc").agg(
        *[F.min_by(F.when(F.col("lang") == l, F.col("name")), F.when(F.col("lang") == l, F.col("ord"))).alias(f"name_{l}")
          for l in ("zh", "en")])
    fixed = names.sparkSession.createDataFrame(
        [(cc, text.REGION_NAMES["zh"][cc], text.REGION_NAMES["en"][cc]) for cc in text.REGION_NAMES["zh"]],
        "cc string, _zh string, _en string")
    return (first.join(F.broadcast(fixed), ["cc"], "full").select(
        "cc", F.coalesce("_zh", "name_zh").alias("name_zh"), F.coalesce("_en", "name_en").alias("name_en")))


def geo_point_join(prefix: DataFrame, geo: DataFrame, point: str = "ip_start", chunks: int | None = None) -> DataFrame:
    return asof_join(prefix, geo, point=point, start="start_num", end="end_num",
                     cols={"cc": "cc", "province": "province", "city": "city"}, chunks=chunks)


def pgeo_build(prefix: DataFrame, geo: DataFrame | None = None, rpki: DataFrame | None = None,
               irr: DataFrame | None = None, moas: DataFrame | None = None) -> DataFrame:
    """Prefix + multi-origin arrays + status of the representative origin + place."""
    d = C.with_status(prefix, rpki, irr, origin="origin_asn")
    if moas is not None:
        d = d.join(moas, ["pid"], "left")
    if geo is None:
        return d.select("*", *[F.lit(None).cast("string").alias(c) for c in ("cc", "province", "city")])
    return geo_point_join(d, geo)


def prefix_forest(prefix: DataFrame, chunks: int | None = None) -> DataFrame:
    """Immediate parent of each prefix that has one: (child, child_start, child_end, parent), by one sweep."""
    found = enclosing(prefix.select("pid", "ip_start", "plen"), chunks=chunks).where("up_id is not null")
    end = ip.network_end("ip_start", F.col("plen"), ip.is_wide(prefix, "ip_start"))
    return found.select(F.col("pid").alias("child"), F.col("ip_start").alias("child_start"), end.alias("child_end"), F.col("up_id").alias("parent"))


def effective_range(prefix: DataFrame, forest: DataFrame | None = None, chunks: int | None = None) -> DataFrame:
    """Prefix range minus its direct children -> (pid, s, e)."""
    forest = forest if forest is not None else prefix_forest(prefix)
    base = prefix.select("pid", F.col("ip_start").alias("s"), F.col("ip_end").alias("e"))
    holes = forest.select(F.col("parent").alias("pid"), F.col("child_start").alias("s"), F.col("child_end").alias("e"))
    return intervals_subtract(base, holes, "pid", chunks=chunks)


def geo_carve(ranges: DataFrame, geo: DataFrame, cap: int | None = None) -> DataFrame:
    """Cut effective ranges at place borders -> (pid, cc, province, city, s, e).

    If a ``cap`` is named, a range with more interval starts becomes one country-level piece
    (the country at its first address) or nothing. Both inputs are disjoint, so the pieces
    and the start counts each come from linear as-of scans.
    """
    r = ranges.select("pid", "s", "e")
    g = geo.select("start_num", "end_num", "cc", "province", "city")
    x = overlap_scan(r, g, a_start="s", b_start="start_num")
    first = F.col("_pos") <= F.col("_b.end_num")
    heads = x.where("_is_a = 1").select(
        F.col("_a.pid").alias("pid"), F.col("_a.s").alias("s"), F.col("_a.e").alias("e"),
        F.when(first, F.col("_b")).alias("g"), F.coalesce(first & (F.col("_b.start_num") == F.col("_pos")), F.lit(False)).alias("_at"))
    inner = x.where((F.col("_is_a") == 0) & (F.col("_pos") <= F.col("_a.e"))).select(
        F.col("_a.pid").alias("pid"), F.col("_a.s").alias("rs"), F.col("_a.e").alias("re"), F.col("_b").alias("g"))
    none = F.lit(None).cast("string")
    low = lambda p, q: F.when(p <= q, p).otherwise(q)
    if cap is None:
        place = [F.col(f"g.{c}").alias(c) for c in ("cc", "province", "city")]
        first_pieces = heads.where("g.cc IS NOT NULL").select("pid", *place, "s", low(F.col("e"), F.col("g.end_num")).alias("e"))
        return first_pieces.unionByName(inner.where("g.cc IS NOT NULL").select(
            "pid", *place, F.col("g.start_num").alias("s"), low(F.col("re"), F.col("g.end_num")).alias("e")))
    starts = inner.select("pid", F.col("rs").alias("s")).unionByName(heads.where("_at").select("pid", "s"))
    crowded = starts.groupBy("pid", "s").agg(F.count("*").alias("n")).where(F.col("n") > cap).select(
        "pid", "s", F.lit(True).alias("_coarse"))
    h = heads.join(crowded, ["pid", "s"], "left").where("g.cc IS NOT NULL")
    is_coarse = F.col("_coarse").isNotNull()
    head_pieces = h.select(
        "pid", F.col("g.cc").alias("cc"), F.when(is_coarse, none).otherwise(F.col("g.province")).alias("province"),
        F.when(is_coarse, none).otherwise(F.col("g.city")).alias("city"), "s",
        F.when(is_coarse, F.col("e")).otherwise(low(F.col("e"), F.col("g.end_num"))).alias("e"))
    inner_pieces = inner.join(crowded.withColumnRenamed("s", "rs"), ["pid", "rs"], "left_anti").where("g.cc IS NOT NULL").select(
        "pid", F.col("g.cc").alias("cc"), F.col("g.province").alias("province"), F.col("g.city").alias("city"),
        F.col("g.start_num").alias("s"), low(F.col("re"), F.col("g.end_num")).alias("e"))
    return head_pieces.unionByName(inner_pieces)


def geo_segments(carved: DataFrame, prefix: DataFrame, part: int = 1024) -> DataFrame:
    """Per (pid, cc, city): merged pieces as address-ordered CIDR lists.

    All CIDRs are listed, in numbered parts of at most ``part`` blocks, so a wide prefix never
    builds an unbounded list.
    """
    wide = ip.is_wide(carved, "s")
    keyed = carved.withColumn("_city", F.coalesce("city", F.lit("")))
    prov = keyed.groupBy("pid", "cc", "_city").agg(F.max_by("province", "s").alias("province"))
    merged = intervals_merge(keyed, ["pid", "cc", "_city"])
    blocks = merged.select("pid", "cc", "_city", F.explode(ip.range_to_cidr_blocks("s", "e", wide)).alias("b")).select(
        "pid", "cc", "_city", "b.start", "b.plen")
    top = runs.numbered(blocks, "_rn", [F.col("start")], ["pid", "cc", "_city"]).withColumn("part", F.ceil(F.col("_rn") / part))
    cidr = F.concat(ip.addr_text("start", wide), F.lit("/"), F.col("plen").cast("string"))
    segs = top.groupBy("pid", "cc", "_city", "part").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_rn", cidr.alias("c")))), lambda x: x["c"]).alias("segs"))
    return (segs.join(prov, ["pid", "cc", "_city"]).join(prefix.select("pid", "plen", "origin_asn", "n_paths"), ["pid"])
            .select("pid", "cc", "province", F.nullif("_city", F.lit("")).alias("city"), "part", "segs", "plen", "origin_asn", "n_paths"))


def geo_working_set(segments: DataFrame, prefix: DataFrame, totals: DataFrame,
                    rpki: DataFrame | None = None, irr: DataFrame | None = None) -> DataFrame:
    d = C.with_status(segments, rpki, irr, origin="origin_asn")
    return (d.join(totals, ["pid"], "left").join(prefix.select("pid", "prefix", "n_origins"), ["pid"], "left"))


def coord_resolve(df: DataFrame, city_coords: DataFrame | None = None) -> DataFrame:
    """lat, lon and their source: city table, else country centroid, else a fixed point."""
    spark = df.sparkSession
    cen = spark.createDataFrame([(k, *v) for k, v in CENTROIDS.items()], "_cc string, _clat double, _clon double")
    cc = F.when(F.coalesce(F.col("cc"), F.lit("")).isin("", "ZZ"), F.lit(None).cast("string")).otherwise(F.col("cc"))
    d = df.withColumn("_cc", F.upper(cc)).join(F.broadcast(cen), ["_cc"], "left")
    if city_coords is None:
        d = d.withColumn("_lat", F.lit(None).cast("double")).withColumn("_lon", F.lit(None).cast("double"))
    else:
        cities = city_coords.select(F.upper("cc").alias("_cc"), F.lower(F.trim("city")).alias("_ct"),
                                    F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
        d = d.withColumn("_ct", F.lower(F.trim("city"))).join(cities, ["_cc", "_ct"], "left").drop("_ct")
    has_cc, by_city = F.col("_cc").isNotNull(), F.col("_lat").isNotNull()
    pick = lambda a, b, dflt: F.when(by_city, F.col(a)).when(has_cc, F.coalesce(F.col(b), F.lit(dflt)))
    return (d.withColumn("lat", pick("_lat", "_clat", DEFAULT_POINT[0])).withColumn("lon", pick("_lon", "_clon", DEFAULT_POINT[1]))
            .withColumn("coord_source", F.when(by_city, "city").when(has_cc, "centroid").otherwise("none"))
            .drop("_cc", "_lat", "_lon", "_clat", "_clon"))
