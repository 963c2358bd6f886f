import bz2
import gzip
import struct

import pytest
from pyspark.sql import functions as F

from pathatlas import sinks
from pathatlas.operators import consolidate as C
from pathatlas.sources import rib, text


def record(subtype, body, kind=13):
    return struct.pack(">IHHI", 0, kind, subtype, len(body)) + body


def peer_table():
    v4 = bytes([2]) + b"\0\0\0\1" + bytes([192, 0, 2, 1]) + struct.pack(">I", 65010)
    v6 = bytes([1]) + b"\0\0\0\2" + bytes(15) + b"\1" + struct.pack(">H", 65011)
    return record(1, struct.pack(">IH", 7, 3) + b"abc" + struct.pack(">H", 2) + v4 + v6)


def path_attr(*segments, long_form=False):
    value = b"".join(struct.pack(">BB", t, len(a)) + struct.pack(f">{len(a)}I", *a) for t, a in segments)
    head = struct.pack(">BBH", 0x50, 2, len(value)) if long_form else struct.pack(">BBB", 0x40, 2, len(value))
    return b"\x40\x01\x01\x00" + head + value  # an ORIGIN attribute comes first


def rib_record(subtype, plen, packed, entries, add_path=False):
    body = struct.pack(">IB", 1, plen) + packed + struct.pack(">H", len(entries))
    for peer, attrs in entries:
        body += struct.pack(">H", peer) + (b"\0\0\0\7" if add_path else b"") + struct.pack(">IH", 0, len(attrs)) + attrs
    return record(subtype, body)


def sample():
    return (peer_table() + rib_record(2, 20, bytes([10, 1, 16]), [(0, path_attr((2, [1, 2, 2]))), (1, path_attr((2, [1, 5]), (1, [7, 8]), long_form=True)), (0, b"\x40\x01\x01\x00")])
            + rib_record(2, 0, b"", [(0, path_attr((2, [1])))]) + record(2, b"", kind=16)
            + rib_record(10, 33, bytes.fromhex("20010db880"), [(1, path_attr((2, [9, 4294967295])))], add_path=True))


@pytest.mark.parametrize("suffix,pack", [("", lambda b: b), (".gz", gzip.compress), (".bz2", bz2.compress)])
def test_rib_decoding(spark, tmp_path, suffix, pack):
    d = tmp_path / "rrc01"
    d.mkdir()
    (d / f"bview.20240102.0300{suffix}").write_bytes(pack(sample()))
    v4 = rib.src_rib(spark, str(tmp_path / "*" / "*"), 4).collect()
    assert sorted((r.prefix, r.peer_asn, r.peer_ip, r.path) for r in v4) == [
        ("10.1.16.0/20", 65010, "192.0.2.1", [1, 2, 2]), ("10.1.16.0/20", 65011, "::1", [1, 5, 7, 8])]
    assert {r.collector for r in v4} == {"rrc01"} and str(v4[0].snap_ts) == "2024-01-02 03:00:00"
    assert v4[0].ip_end - v4[0].ip_start == 4095
    v6 = rib.src_rib(spark, str(tmp_path / "*" / "*"), 6).collect()
    assert [(r.prefix, r.path) for r in v6] == [("2001:db8:8000::/33", [9, 4294967295])]


def test_rib_source_reads_byte_ranges(spark, tmp_path):
    """Any size of the ranges gives the rows of the whole file; compressed files stream; a family filter is pushed down."""
    from pathatlas.sources.rib_source import RibReader, border, read_rib
    rows = [rib_record(2 + 6 * (i % 2), 24, bytes([10, i % 256, i // 256]), [(i % 2, path_attr((2, [1, i, 13, 13 << 16 | 2]))), (1, path_attr((2, [i])))], add_path=i % 2)
            if i % 3 else rib_record(4, 40, bytes([0x20, 1, 0, 13, i % 256]), [(0, path_attr((2, [5, i])))]) for i in range(300)]
    raw = peer_table() + b"".join(rows) + record(2, b"other", kind=16) + rows[7]
    want = sorted(map(repr, rib.decode_rib("x", raw)))
    (tmp_path / "rrc09").mkdir()
    plain = tmp_path / "rrc09" / "bview.20240102.0300"
    plain.write_bytes(raw)
    for size in (97, 1000, 1 << 20):
        reader = RibReader({"path": str(plain), "rangebytes": str(size)})
        parts = reader.partitions()
        assert len(parts) == -(-len(raw) // size)
        got = [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert sorted(repr(r[1:]) for r in got) == want
    with open(plain, "rb") as f:
        assert border(f, 0, len(raw)) == 0 and border(f, 1, len(raw)) == len(peer_table())
    (tmp_path / "rrc09" / "bview.20240102.0400.gz").write_bytes(gzip.compress(raw))
    d = read_rib(spark, f"{tmp_path}/rrc09", rangeBytes=5000)
    assert d.count() == 2 * len(want) and d.rdd.getNumPartitions() == 1 + -(-len(raw) // 5000)
    both = rib.all_entries(d)
    assert {r[0] for r in both.select("family").distinct().collect()} == {4, 6}
    six = read_rib(spark, str(plain)).where("family = 6")
    assert "Filter (family" not in six._jdf.queryExecution().executedPlan().toString()  # the source has taken it over
    assert six.count() == sum(1 for r in rib.decode_rib("x", raw) if r[0] == 6)


def test_cut_off_file_ends_quietly():
    whole = list(rib.decode_rib("x", sample()))
    cut = list(rib.decode_rib("x.gz", gzip.compress(sample())[:-12]))
    assert len(whole) == 3 and whole[:len(cut)] == cut
    assert list(rib.decode_rib("x", sample()[:-3])) == whole[:2]


def test_ties_and_representative(spark):
    rows = [("1.0.0.0/8", "1 2", "c0"), ("1.0.0.0/8", "1 3", "c0"), ("1.0.0.0/8", "1 3 3", "c1"), ("1.0.0.0/8", "4 2", "c1")]
    rib_rows = spark.createDataFrame([(p, 16777216, 33554431, 4, 8, r, c) for p, r, c in rows],
                                     "prefix string, ip_start bigint, ip_end bigint, family int, plen int, path_raw string, collector string")
    po = C.pathobs_merge(C.obs_dedup(rib_rows))
    r = C.prefix_agg(po).first()
    assert (r.origin_asn, r.n_origins, r.n_paths, r.n_distinct_paths) == (2, 2, 4, 4)
    top = C.paths_topk(po.withColumn("pid", F.lit(1).cast("bigint")), cap=2).collect()
    assert [t.path_str for t in sorted(top, key=lambda t: not t.is_best)] == [" 1 2 ", " 1 3 "]


def test_rpsl_file_with_latin1_and_order(spark, tmp_path):
    f = tmp_path / "x.db"
    f.write_bytes("route: 1.0.0.0/8\ndescr: é\norigin: AS1 # c\n\n% note\nroute: 2.0.0.0/8\n# c\norigin: AS2\n\trest\n".encode("latin-1"))
    objs = text.src_rpsl(text.read_rpsl_text(spark, str(f)))
    got = [[(a.k, a.v) for a in r.attrs] for r in objs.orderBy("obj_no").collect()]
    assert got == [[("route", "1.0.0.0/8"), ("descr", "é"), ("origin", "AS1 # c")], [("route", "2.0.0.0/8"), ("origin", "AS2 rest")]]
    routes = text.irr_route_extract(objs, "ripe").collect()
    assert {(r.ip_start, r.origin, r.source) for r in routes} == {(16777216, 1, "ripe")}


def test_sinks(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("ip_start"), (F.col("id") % 7).alias("v"))
    out = str(tmp_path / "sorted")
    sinks.sink_sorted(df, out, ["ip_start"], partitions=4)
    files = spark.read.parquet(out).groupBy(F.input_file_name().alias("f")).agg(F.min("ip_start").alias("a"), F.max("ip_start").alias("b")).orderBy("a").collect()
    assert len(files) > 1 and all(x.b < y.a for x, y in zip(files, files[1:]))
    listing = sinks.list_files(spark, out)
    assert listing.count() == len(files) and sinks.publishable(listing, listing)
    manifest = listing.unionByName(spark.createDataFrame([("gone.parquet",)], "file string"))
    assert not sinks.publishable(manifest, listing)
    assert not sinks.publishable(listing.limit(0), listing)
    obs = spark.createDataFrame([("c9", "p", "1 2")], "collector string, prefix string, path_raw string")
    sinks.sink_collector_replace(obs.withColumn("collector", F.lit("c1")), str(tmp_path / "o"), base_load=True)
    with pytest.raises(ValueError):
        sinks.sink_collector_replace(obs, str(tmp_path / "o"))
