import random

from pyspark.sql import functions as F

from pathatlas.operators import geo as G
from pathatlas.operators import intervals as I
from pathatlas.operators import joins as J
from pathatlas.operators import runs


def brute(ivs):
    return {x for s, e in ivs for x in range(s, e + 1)}


def test_merge_and_subtract_with_a_hot_key(spark):
    random.seed(3)
    rows = [("hot" if i % 3 else f"k{i % 7}", s, s + random.randint(0, 9)) for i, s in enumerate(random.choices(range(2000), k=400))]
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint")
    got = {}
    for r in I.intervals_merge(df, ["k"], chunks=13).collect():
        got.setdefault(r.k, []).append((r.s, r.e))
    for k in {r[0] for r in rows}:
        assert brute(got[k]) == brute([(s, e) for kk, s, e in rows if kk == k])
        iv = sorted(got[k])
        assert all(a[1] + 1 < b[0] for a, b in zip(iv, iv[1:]))
    base = spark.createDataFrame([(k, 100, 1900) for k in got], "k string, s bigint, e bigint")
    left = {}
    for r in I.intervals_subtract(base, df, "k", chunks=7).collect():
        left.setdefault(r.k, []).append((r.s, r.e))
    for k in got:
        assert brute(left.get(k, [])) == set(range(100, 1901)) - brute(got[k])


def test_merge_wide_to_the_end_of_the_space(spark):
    top = 2**128 - 1
    b = lambda n: bytearray(n.to_bytes(16, "big"))
    df = spark.createDataFrame([("k", b(top - 9), b(top)), ("k", b(top - 3), b(top - 1)), ("k", b(0), b(2**64 - 1)), ("k", b(2**64), b(2**64))],
                               "k string, s binary, e binary")
    got = sorted((int.from_bytes(r.s, "big"), int.from_bytes(r.e, "big")) for r in I.intervals_merge(df, ["k"], chunks=3).collect())
    assert got == [(0, 2**64), (top - 9, top)]


def test_numbers_are_dense_for_any_chunk_count(spark):
    vals = [random.Random(5).randint(0, 50) for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i bigint, v bigint")
    for n in (1, 4, 64):
        out = runs.numbered(df, "pos", [F.col("v"), F.col("i")], chunks=n).collect()
        assert [r.i for r in sorted(out, key=lambda r: r.pos)] == [i for i, v in sorted(enumerate(vals), key=lambda x: (x[1], x[0]))]
        assert sorted(r.pos for r in out) == list(range(1, 301))


def test_asof_and_overlap_against_brute_force(spark):
    rnd = random.Random(9)
    cuts = sorted(rnd.sample(range(5000), 200))
    ivs = [(cuts[i], cuts[i + 1] - rnd.choice([1, 1, 1, 2]), f"c{i % 5}") for i in range(0, 198, 2) if cuts[i + 1] - 2 >= cuts[i]]
    iv = spark.createDataFrame(ivs, "s bigint, e bigint, c string")
    pts = [rnd.randint(0, 5100) for _ in range(300)] + [ivs[3][0]] * 200  # one hot address
    p = spark.createDataFrame([(i, x) for i, x in enumerate(pts)], "i bigint, x bigint")
    got = {r.i: r.c for r in J.asof_join(p, iv, point="x", start="s", end="e", cols={"c": "c"}, chunks=9).collect()}
    assert got == {i: next((c for s, e, c in ivs if s <= x <= e), None) for i, x in enumerate(pts)}
    other = [(a, a + 60, i) for i, a in enumerate(range(30, 5000, 61))]
    o = spark.createDataFrame(other, "s bigint, e bigint, pid bigint")
    pieces = J.overlap_pieces(o, iv, a_start="s", a_end="e", b_start="s", b_end="e", a_cols={"pid": "pid"}, b_cols={"c": "c"})
    want = sorted((max(a, s), min(b, e), i, c) for a, b, i in other for s, e, c in ivs if s <= b and e >= a)
    assert sorted((r.s, r.e, r.pid, r.c) for r in pieces.collect()) == want


def test_geo_merge_keeps_the_union_without_overlap(spark):
    rnd = random.Random(4)
    rows = [(s, s + rnd.randint(0, 30), 4, f"C{s % 3}", None, f"t{s % 2}", rnd.choice(["ipdb", "geolite", "rir"])) for s in rnd.sample(range(3000), 150)]
    df = spark.createDataFrame(rows, "start_num bigint, end_num bigint, family int, cc string, province string, city string, provider string")
    m = sorted((r.start_num, r.end_num) for r in G.geo_merge(df, chunks=11).collect())
    assert all(a[1] < b[0] for a, b in zip(m, m[1:]))
    assert brute(m) == brute([(r[0], r[1]) for r in rows])
    c = G.geo_coalesce(G.geo_merge(df), chunks=6)
    assert brute([(r.start_num, r.end_num) for r in c.collect()]) == brute(m)


def test_forest_parent_is_the_smallest_superset_over_any_number_of_partitions(spark):
    rnd = random.Random(6)
    nets = {(p, (rnd.getrandbits(32) >> (32 - p)) << (32 - p)) for p in [rnd.choice([8, 9, 12, 16, 20, 24]) for _ in range(60)]}
    nets |= {(24, (s + (k << 8)) & 0xFFFFFFFF) for p, s in list(nets) if p < 20 for k in range(8)}
    rows = [(i, s, s + 2 ** (32 - p) - 1, p) for i, (p, s) in enumerate(sorted(nets))]
    df = spark.createDataFrame(rows, "pid bigint, ip_start bigint, ip_end bigint, plen int")
    want = {}
    for i, s, e, p in rows:
        over = [r for r in rows if r[1] <= s and r[2] >= e and r[3] < p]
        if over:
            want[i] = max(over, key=lambda r: r[3])[0]
    wide = df.select("pid", "plen", F.unhex(F.lpad(F.hex("ip_start"), 8, "0")).alias("_b")).select(
        "pid", F.unhex(F.rpad(F.hex("_b"), 32, "0")).alias("ip_start"), "plen")  # the same nets in the upper bits of 128
    for chunks in (None, 1, 7, 40):
        for table in (df, wide):
            got = G.prefix_forest(table, chunks=chunks).collect()
            assert len(got) == len(want) and {r.child: r.parent for r in got} == want
            ends = {r["pid"]: r["ip_end"] for r in df.collect()}
            assert table is wide or all(r.child_end == ends[r.child] for r in got)


def test_longest_match_has_one_row_per_address(spark, monkeypatch):
    """Addresses of a hot network spread over partitions, repeated addresses, none at all, equal prefixes."""
    from pathatlas.operators import sweep
    rnd = random.Random(9)
    nets = {(p, (rnd.getrandbits(32) >> (32 - p)) << (32 - p) if p else 0) for p in [0, *[rnd.choice([4, 8, 15, 16, 21, 24, 31, 32]) for _ in range(150)]]}
    hot = next(s for p, s in nets if p == 8)
    ips = [rnd.getrandbits(32) for _ in range(300)] + [hot + rnd.getrandbits(24) for _ in range(500)] + [s for _, s in list(nets)[:50]] + [hot + 5] * 40
    want = [max((p, s) for p, s in nets if p == 0 or a >> (32 - p) == s >> (32 - p)) for a in ips]
    nets = sorted(nets) + sorted(nets)[:20]
    points = spark.createDataFrame(list(enumerate(ips)) + [(9999, None)], "id int, ip long")
    prefixes = spark.createDataFrame([(s, p, f"{s}/{p}") for p, s in nets], "ip_start long, plen int, name string")
    seen = []
    plain = sweep.enclosing
    monkeypatch.setattr(sweep, "enclosing", lambda rows, **args: seen.append(rows.count()) or plain(rows, **args))
    got = {r["id"]: (r["name"], r["plen"]) for r in sweep.longest_match(points, prefixes, point="ip", cols={"name": "name", "plen": "plen"}, chunks=13).collect()}
    assert got == {**{i: (f"{s}/{p}", p) for i, (p, s) in enumerate(want)}, 9999: (None, None)}
    assert seen == [len(nets) + len(set(ips))]
