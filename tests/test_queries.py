"""Registered queries against their SQL twins on the smallest data set, in groups."""
import duckdb
import pytest

import __spark_entry__ as entry
from pathatlas.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"
CORE = ("prefix_agg", "pid_assign", "paths_topk", "path_bundle", "moas_origins", "rpki_classify", "irr_classify", "prefix_forest_v6",
        "effective_range", "geo_coalesce", "asn_neigh", "relation_evidence", "route_graph", "as_set_expand", "subnet_search",
        "src_rdap_entities", "src_whois_text", "irr_delta_stream", "collector_refresh", "search_path_pattern")


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 140


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CORE)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted((tuple(norm(v) for v in r) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got and got == want
