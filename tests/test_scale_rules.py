"""Nothing is cut by default, ties and hot keys spread over partitions, streams neither lose nor reorder."""
import pytest
from pyspark.sql import functions as F

from pathatlas.functions import paths as P
from pathatlas.operators import consolidate as C
from pathatlas.operators import deltas as D
from pathatlas.operators import runs
from pathatlas.operators import search as S
from pathatlas.operators import sets as A
from pathatlas.operators import sweep as W
from pathatlas.session import cut_lineage, release_cuts
from pathatlas.streaming import refresh as T


def spread(df):
    return [r["n"] for r in df.groupBy(runs.CHUNK).agg(F.count("*").alias("n")).collect()]


def test_equal_addresses_fall_into_many_chunks(spark):
    d = spark.range(20_000).select(F.lit(7).cast("bigint").alias("a"), "id")
    sizes = spread(runs.with_chunks(d, [F.col("a")], chunks=8))
    assert len(sizes) == 8 and max(sizes) < 6_000
    ranks = runs.numbered(d, "pos", [F.col("a")], chunks=8).agg(F.min("pos"), F.max("pos"), F.count_distinct("pos")).first()
    assert tuple(ranks) == (1, 20_000, 20_000)


def test_hosts_of_one_small_net_fall_into_many_chunks(spark):
    host = F.unhex(F.concat(F.lit("20010DB800000001"), F.lpad(F.hex("id"), 16, "0"))).alias("a")
    sizes = spread(runs.with_chunks(spark.range(20_000).select(host), [F.col("a")], chunks=8))
    assert len(sizes) == 8 and max(sizes) < 6_000


def test_running_values_across_chunks(spark):
    d = spark.createDataFrame([("k", i, (i * 37) % 11) for i in range(200)] + [(None, i, i) for i in range(50)], "g string, i int, v int")
    c = runs.scan(runs.with_chunks(d, [F.col("i")], ["g"], chunks=7), "m", F.col("v"), "max", [F.col("i")], ["g"])
    got = {(r["g"], r["i"]): r["m"] for r in c.collect()}
    assert len(got) == 250
    for g, i in got:
        assert got[g, i] == max((j * 37) % 11 if g else j for j in range(i + 1))


def test_all_paths_of_a_prefix_are_kept(spark):
    obs = spark.createDataFrame([(1, "10.0.0.0/8", 4, f"{i} 7", f"{i} 7", 2, i % 5 + 1) for i in range(1, 401)],
                                "pid long, prefix string, family int, path_raw string, path_clean string, path_len int, n_peers long")
    top = C.paths_topk(obs)
    assert top.count() == 400 and top.where("is_best").count() == 1
    parts = C.path_bundle(top, size=128).select("part", F.size("bundle").alias("n")).orderBy("part").collect()
    assert [tuple(r) for r in parts] == [(1, 128), (2, 128), (3, 128), (4, 16)]
    assert C.path_totals(top).first()["observed_peers"] == sum(i % 5 + 1 for i in range(1, 401))
    assert C.paths_topk(obs, cap=3).count() == 3


def test_deep_chains_of_sets(spark):
    chain = [(f"S{i}", 0, "set", f"S{i + 1}") for i in range(40)] + [("S40", 0, "asn", "AS2"), ("S0", 1, "asn", "AS1"), ("S40", 1, "set", "S0")]
    edges = spark.createDataFrame(chain, "set_key string, ord int, kind string, val string")
    root = spark.createDataFrame([("S0",)], "set_key string")
    assert A.as_set_cone(edges, root).first()["n_asns"] == 2
    tree = A.as_set_expand(edges, root)
    assert tree.agg(F.max("depth")).first()[0] == 41 and tree.where("cycle").count() == 1


def test_cones_of_random_graphs(spark):
    """Cycles inside cycles, self-loops, chains of depth 30, unresolved names: components and cones equal plain reachability."""
    import random
    rnd = random.Random(11)
    for n, m in ((30, 40),):
        links = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)} | {(n + i, n + i + 1) for i in range(30)} | {(0, n), (n + 5, n + 2)}
        rows = [(f"S{a:03}", "set", f"S{b:03}") for a, b in links] + [("S000", "set", "GONE")]
        rows += [(f"S{a:03}", "asn", f"AS{rnd.randrange(20)}") for a in rnd.sample(range(n + 31), 25)] + [("S900", "asn", "AS1"), ("S901", "set", "S901")]
        edges = spark.createDataFrame(rows, "set_key string, kind string, val string")
        keys = {r[0] for r in rows}
        kids = {k: {v for s, kind, v in rows if s == k and kind == "set" and v in keys} for k in keys}
        reach = {}
        for k in keys:
            todo, seen = [k], {k}
            while todo:
                for v in kids[todo.pop()] - seen:
                    seen.add(v)
                    todo.append(v)
            reach[k] = seen
        comp, held = A.cones(edges)
        assert {tuple(r) for r in comp.collect()} == {(k, min(v for v in reach[k] if k in reach[v])) for k in keys}
        want = {k: len({v for s, kind, v in rows if kind == "asn" and s in reach[k]}) for k in keys}
        assert {tuple(r) for r in A.as_set_cone(edges).collect()} == {(k, c) for k, c in want.items() if c}


def test_trigrams_find_what_the_scan_finds(spark):
    from pathatlas.functions.text import asn_name_search
    from pathatlas.operators import grams as G
    names = ["Alpha Net", "alphabet", "ALPHA", "aaaa", "aa", "", None, "Überall Net", "net-net", "x", "日本 Net 日本語", "a.b.c", "100% net_1"]
    d = spark.createDataFrame([(64500 + i, n) for i, n in enumerate(names)], "asn long, name string")
    index = G.gram_index(d, ["asn"], [F.col("name")])
    for term in ("alpha", "net", "aa", "aaaaa", "日本語", "ÜBER", "100%", "zzz", "et n", ""):
        found = G.candidates(d, index, ["asn"], term.strip())
        assert sorted(map(tuple, asn_name_search(found, term).collect())) == sorted(map(tuple, asn_name_search(d, term).collect())), term
    text = G.candidates(d, index, ["asn"], "alphabet")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in text and "gram" in text.split("PushedFilters")[1]
    assert G.candidates(d, index, ["asn"], "alphabet").count() == 1


def test_hop_index_equals_the_scan(spark):
    import random
    from pathatlas.operators import hops as H
    rnd = random.Random(21)
    rows = []
    for pid in range(120):
        for _ in range(rnd.randrange(1, 5)):
            hops = [rnd.choice([1, 2, 3, 4, 5, 6, 77, 88]) if rnd.random() < 0.9 else 1000 + rnd.randrange(300) for _ in range(rnd.randrange(1, 7))]
            rows.append((pid, " " + " ".join(map(str, hops)) + " ", rnd.randrange(1, 9)))
    d = spark.createDataFrame(rows, "pid long, path_str string, n_peers long")
    index = H.build(d)
    for q in ("1 ? 2", "1 2 * 3 ? 4", "77 * 88 !1", "!2", "1 1 * 1", "1 999999"):
        want = {(r["pid"], r["matched_peers"], r["observed_peers"]) for r in S.matched_peers(d, q).where("matched_peers > 0").collect()}
        assert {tuple(r) for r in H.matched_peers(index, q).select("pid", "matched_peers", "observed_peers").collect()} == want, q
        want = {r["pid"] for r in S.path_prefilter(d, q).collect()}
        assert {r["pid"] for r in H.path_prefilter(index, q).collect()} == want, q
    rare = H.matching_paths(index, P.path_query_parse("1000"))
    plan = rare._jdf.queryExecution().executedPlan().toString()
    assert "asn" in plan.split("PushedFilters")[1]
    assert index.hops.where("asn = 1000").count() * 10 < d.count()


def test_hop_index_can_be_published(spark, tmp_path):
    from pathatlas.operators import hops as H
    d = spark.createDataFrame([(1, " 1 2 3 ", 4), (1, " 1 3 ", 1), (2, " 1 3 ", 7)], "pid long, path_str string, n_peers long")
    H.save(H.build(d), str(tmp_path))
    got = H.matched_peers(H.load(spark, str(tmp_path)), "2 3").collect()
    assert [(r["pid"], r["matched_peers"], r["observed_peers"]) for r in got] == [(1, 4, 5)]


def test_deep_pages(spark):
    d = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    for page in (0, 3, 9):
        rows = S.search_page(d, [F.desc("v")], limit=100, page=page).orderBy("pos").collect()
        assert [r["v"] for r in rows] == list(range(999 - 100 * page, 899 - 100 * page, -1)) and {r["more"] for r in rows} == {page < 9}


def test_rows_without_an_address_stay(spark):
    points = spark.createDataFrame([(1, 5), (2, None), (3, None)], "id int, ip long")
    prefixes = spark.createDataFrame([(0, 0, "all")], "ip_start long, plen int, name string")
    got = {r["id"]: r["name"] for r in W.longest_match(points, prefixes, point="ip", cols={"name": "name"}).collect()}
    assert got == {1: "all", 2: None, 3: None}


@pytest.mark.parametrize(("text", "stretches", "excludes"), [
    ("1299 * 4538", ((1299,), (4538,)), ()), ("1 ? 2 ?? 3", ((1, None, 2, None, None, 3),), ()), ("* 1 * ? 2 !7 -8", ((1,), (2,)), (7, 8)),
    ("1->2,3 junk *?", ((1, 2, 3),), ()), ("", (), ()), ("? *", (), ())])
def test_path_patterns(text, stretches, excludes):
    q = P.path_query_parse(text)
    assert (q.stretches, q.excludes) == (stretches, excludes)


def test_path_patterns_match(spark):
    d = spark.createDataFrame([("1 2 3 2 4",), ("1 4",), ("2 9 4 4",)], "p string")
    hits = lambda q: [r[0] for r in d.where(P.path_match("p", q)).select("p").collect()]
    assert hits("2 * 4") == ["1 2 3 2 4", "2 9 4 4"] and hits("2 ? 4") == ["2 9 4 4"] and hits("2 ? 2 4") == ["1 2 3 2 4"] and hits("1 * 4 !2") == ["1 4"]


def test_late_operations_do_not_win(spark):
    cols = "ip_start long, plen int, origin long, source string"
    state = D.versioned(spark.createDataFrame([(1, 8, 1, "A"), (2, 8, 1, "A")], cols), 10)
    step = lambda rows: spark.createDataFrame(rows, cols + ", serial long, op string")
    after = D.advance(D.advance(state, step([(1, 8, 1, "A", 15, "DEL")])), step([(1, 8, 1, "A", 12, "ADD"), (3, 8, 1, "A", 11, "ADD")]))
    assert sorted(r["ip_start"] for r in D.live(after).collect()) == [2, 3]
    assert D.needs_reload(None, 1, 2) and D.needs_reload(3, 5, 9) and not D.needs_reload(4, 5, 9) and D.needs_reload(4, 5, 9, max_behind=2)


def test_journal_state(spark, tmp_path):
    """Late and repeated serials change nothing, a gap commits nothing and can be closed; the log holds only what arrived."""
    import random
    cols = "ip_start long, plen int, origin long, source string"
    base, log, ck, src = (str(tmp_path / x) for x in ("base", "log", "ck", "src"))
    start = spark.createDataFrame([(i, 8, 1, "A") for i in range(50)], cols)
    T.write_initial_state(start, base, 10)
    rnd = random.Random(1)
    ops = [(rnd.randrange(8), 8, 1, "A", s, rnd.choice(["ADD", "DEL"])) for s in range(11, 41)]

    def feed(rows):
        spark.createDataFrame(rows, cols + ", serial long, op string").write.mode("append").parquet(src)
        stream = spark.readStream.schema(cols + ", serial long, op string").parquet(src)
        T.irr_delta_stream(stream, base, log, ck).awaitTermination()

    def live():
        return sorted(r["ip_start"] for r in T.read_state(spark, base, log).collect())

    def after(rows):
        now = {i: "ADD" for i in range(50)} | {r[0]: r[5] for r in sorted(rows, key=lambda r: r[4])}
        return sorted(i for i, op in now.items() if op == "ADD")

    feed(ops[:10])
    assert live() == after(ops[:10])
    feed(ops[5:20] + [(3, 8, 1, "A", 9, "DEL")])
    assert live() == after(ops[:20]) and spark.read.parquet(log).count() == 26
    with pytest.raises(Exception, match="missing"):
        feed(ops[21:])
    assert live() == after(ops[:20])
    whole = T.read_state(spark, base, log)
    base, log, ck, src = (str(tmp_path / f"{x}2") for x in ("base", "log", "ck", "src"))
    T.write_initial_state(whole, base, 30)
    feed(ops[20:])
    assert live() == after(ops)


def test_written_tables_can_be_released(spark):
    d = cut_lineage(spark.range(5))
    files = d.inputFiles()
    assert d.count() == 5 and files
    release_cuts(spark)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(files[0]).count()
