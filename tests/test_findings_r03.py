"""Findings of round 3: each test builds its own rows."""

import __spark_entry__ as entry
from pathatlas.operators import consolidate as C
from pathatlas.operators import registry as R
from pathatlas.operators import runs
from pathatlas.plans import queries_text


def tables(spark, path, **rows):
    """One parquet file per named table: (schema, rows)."""
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_as_set_expand_opens_every_set(spark, tmp_path):
    sf = tables(spark, tmp_path, nation=("n_nationkey int, n_regionkey int", [(1, 0), (2, 0), (3, 1)]),
                supplier=("s_suppkey int, s_nationkey int", [(1, 1), (2, 3)]))
    got = entry.queries()["as_set_expand"](spark, sf).select("root", "path").collect()
    assert {r["root"] for r in got} == {"RIPE::AS-R0", "RIPE::AS-R1", "RIPE::AS-N1", "RIPE::AS-N2", "RIPE::AS-N3"}
    assert ("RIPE::AS-R1", "RIPE::AS-R1 > RIPE::AS-N3 > AS64502") in {tuple(r) for r in got}
    assert len(got) == len({r["path"] for r in got}) == 29


LINES = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double"


def lines(n):
    return [(i % 9, 1 + i % 40, i % 7, 1 + i % 7, float(i % 50)) for i in range(n)]


def test_derived_tables_are_written_once(spark, tmp_path):
    """No parser and no place lookup runs on the observations below a DISTINCT."""
    sf = tables(spark, tmp_path, lineitem=(LINES, lines(300)), supplier=("s_suppkey bigint, s_name string, s_acctbal double, s_nationkey int", [(1, "a", 1.0, 1)]))
    for name in ("src_city_intervals", "irr_route6_extract", "src_rpsl", "irr_route_extract", "search_origin", "pathsearch_build", "top_prefixes_per_asn", "paths_topk_v6"):
        df = entry.queries()[name](spark, sf)
        assert df.count() > 0 and not [f for f in df.inputFiles() if "lineitem" in f], name


def test_tasks_of_the_merge_follow_the_input(spark, tmp_path, monkeypatch):
    sf = tables(spark, tmp_path, rib=("collector string, prefix string, ip_start bigint, ip_end bigint, family int, plen int, pid bigint, path_raw string",
                                      [(f"c{i % 3}", f"1.0.{i % 20}.0/24", i % 20, i % 20, 4, 24, i % 20, f"{i % 4} 5") for i in range(400)]))
    rib = spark.read.parquet(f"{sf}/rib.parquet")
    few = C.pathobs_merge(C.obs_dedup(rib))
    monkeypatch.setattr(runs, "TASK_BYTES", 100)
    many = C.pathobs_merge(C.obs_dedup(rib))
    assert runs.tasks(rib) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert many._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the merge needs no second one
    assert many.rdd.getNumPartitions() == runs.tasks(rib)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_batches_of_a_refresh_consist_of_bounded_files(spark, tmp_path, monkeypatch):
    sf = tables(spark, tmp_path, lineitem=(LINES, lines(300)))
    asked = []
    in_files = queries_text.in_files
    monkeypatch.setattr(queries_text, "in_files", lambda t, df, by, n: asked.append(n) or in_files(t, df, by, n))
    want = sorted(map(str, entry.queries()["collector_refresh"](spark, sf).collect()))
    monkeypatch.setattr(runs, "TASK_BYTES", 100)
    assert sorted(map(str, entry.queries()["collector_refresh"](spark, sf).collect())) == want
    assert asked[0] == 4 < asked[1]


def test_a_zone_of_one_label_is_no_hot_key(spark):
    domains = spark.createDataFrame([("www.A.Net42.",), ("b.u1.net42",), ("net42",), (".",), ("",), ("x.org",), (None,), ("b.u1.net42",)], "domain string")
    zones = spark.createDataFrame([("net42",), ("u1.net42",), ("net42",), ("",), (None,)], "zone string")
    got = R.zone_lookup(domains, zones)
    assert {tuple(r) for r in got.collect()} == {("www.A.Net42.", "net42"), ("b.u1.net42", "u1.net42"), ("net42", "net42"), (".", ""), ("", ""), ("x.org", None), (None, None)}
    assert got.count() == 7 and "_salt" in got._jdf.queryExecution().executedPlan().toString()
