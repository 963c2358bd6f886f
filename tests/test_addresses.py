import ipaddress
import random

from pyspark.sql import functions as F

from pathatlas.functions import ip, text


def b16(n):
    return bytearray(n.to_bytes(16, "big"))


def test_cover_is_minimal_and_exact_v4(spark):
    random.seed(7)
    rows = [tuple(sorted(random.getrandbits(b) for _ in range(2))) for b in (8, 16, 31, 32) for _ in range(200)]
    rows += [(0, 2**32 - 1), (0, 0), (2**32 - 1, 2**32 - 1), (1, 2**32 - 2)]
    df = spark.createDataFrame(rows, "s bigint, e bigint")
    for r in df.select("s", "e", ip.range_to_cidrs("s", "e", False).alias("c")).collect():
        assert r.c == [str(n) for n in ipaddress.summarize_address_range(ipaddress.IPv4Address(r.s), ipaddress.IPv4Address(r.e))]


def test_wide_cover_text_and_neighbours(spark):
    random.seed(8)
    rows = []
    for bits in (8, 63, 64, 65, 100, 128):
        for _ in range(40):
            a, b = sorted(random.getrandbits(bits) for _ in range(2))
            rows.append((b16(a), b16(b)))
    rows += [(b16(0), b16(2**128 - 1)), (b16(2**128 - 1), b16(2**128 - 1))]
    df = spark.createDataFrame(rows, "s binary, e binary")
    out = df.select("s", "e", ip.range_to_cidrs("s", "e", True).alias("c"), ip.succ("s", True).alias("n"), ip.pred("s", True).alias("p"),
                    ip.ip6_to_bin(ip.ip6_text("s")).alias("back"), ip.network_end("s", F.lit(37), True).alias("last")).collect()
    for r in out:
        s, e = int.from_bytes(r.s, "big"), int.from_bytes(r.e, "big")
        assert r.c == [str(n) for n in ipaddress.summarize_address_range(ipaddress.IPv6Address(s), ipaddress.IPv6Address(e))]
        assert (r.n is None) if s == 2**128 - 1 else int.from_bytes(r.n, "big") == s + 1
        assert (r.p is None) if s == 0 else int.from_bytes(r.p, "big") == s - 1
        assert r.back == r.s
        assert int.from_bytes(r.last, "big") == int(ipaddress.ip_network((s, 37), strict=False).broadcast_address)


def test_bad_addresses_are_null(spark):
    bad = ["300.1.1.1", "1.1.1.1/33", "1::2::3", ":::", "2001:db8::/129", "1:2:3", "x", "", None]
    df = spark.createDataFrame([(x,) for x in bad], "s string")
    assert all(r.b is None for r in df.select(ip.cidr_bounds("s").alias("b")).collect())


def test_private(spark):
    want = {"10.0.0.1": True, "100.64.0.1": True, "100.63.0.1": False, "172.31.0.1": True, "8.8.8.8": False, "fe80::1": True,
            "2001:db8::1": False, "fd00::1": True, "junk": True, "": True}
    df = spark.createDataFrame([(k,) for k in want], "s string")
    assert {r.s: r.p for r in df.select("s", ip.is_private_ip("s").alias("p")).collect()} == want


def test_classify(spark):
    want = {"": "empty", "AS-FOO": "asset", "RADB::AS-FOO": "asset", "AS1:AS-X": "asset", "2001:db8::/32": "ipv6", "zz:1": "text",
            "1.2.3.0/24": "ipv4", "Example.COM.": "domain", "1.2.3": "text", "as 4538": "asn", "4538": "asn", "cernet": "name"}
    df = spark.createDataFrame([(k,) for k in want], "s string")
    assert {r.s: r.k for r in df.select("s", text.classify_query("s")["kind"].alias("k")).collect()} == want
    dom = {"a.b.example.co.uk": "example.co.uk", "mail.google.com": "google.com", "x.com": "x.com"}
    df = spark.createDataFrame([(k,) for k in dom], "s string")
    assert {r.s: r.k for r in df.select("s", text.registrable_domain("s").alias("k")).collect()} == dom
