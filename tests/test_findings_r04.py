"""Findings of round 4: each test builds its own rows."""

import glob
import os

from pyspark.sql import functions as F

import __spark_entry__ as entry
from pathatlas import session
from pathatlas.operators import runs
from pathatlas.plans import fixtures, queries_text
from pathatlas.sources import rib
from tests.test_findings_r03 import LINES, lines, tables


def held(spark):
    """Tables below the checkpoint folder."""
    session.ensure_checkpoint_dir(spark)
    return set(glob.glob(f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}/cut-*"))


def test_dump_files_are_streamed_by_the_tasks(spark, tmp_path, monkeypatch):
    """No row holds a file: the tasks get single records, and write one file of a collector each."""
    sf = tables(spark, tmp_path, lineitem=(LINES, lines(400)))
    seen = []
    written = queries_text._written
    monkeypatch.setattr(queries_text, "_written", lambda t, *a: seen.append((a[0], *written(t, *a))) or seen[-1][1:])
    rows = {(r["family"], r["collector"], r["prefix"], r["peer_asn"], r["path"]): r["n"] for r in entry.queries()["src_rib_families"](spark, sf).collect()}
    t = fixtures.Tables(spark, sf)
    four = t["fx_rib"].groupBy("collector", "prefix", "peer_asn", "path_raw").count().collect()
    assert {k: n for k, n in rows.items() if k[0] == 4} == {(4, r["collector"], r["prefix"], r["peer_asn"], r["path_raw"]): r["count"] for r in four}
    assert sum(n for k, n in rows.items() if k[0] == 6) == t["fx_v6"].count()
    records, root, size = seen[0]
    assert records.count() == sum(rows.values()) and records.select(F.max(F.length("rec"))).first()[0] < 100
    assert "collect_list" not in records._jdf.queryExecution().toString()
    files = [f for f in glob.glob(f"{root.removeprefix('file:')}/*/*") if os.path.isfile(f)]
    assert size == sum(map(os.path.getsize, files)) and not [f for f in files if os.path.basename(f).startswith("_")]


def test_a_dump_file_without_a_whole_task_is_passed_over(spark, tmp_path):
    t = fixtures.Tables(spark, str(tmp_path))
    d = spark.createDataFrame([("c1", bytearray(b"ab")), (None, bytearray(b"cd")), ("c1", None)], "collector string, rec binary").repartition(3)
    root, size = queries_text._written(t, d, "FF")
    found = {f.split("/")[-2]: open(f, "rb").read() for f in glob.glob(f"{root.removeprefix('file:')}/*/bview*")}
    assert found == {"c1": b"\xffab", "None": b"\xffcd"} and size == 6


def test_collector_of_a_file(spark):
    names = ["s3://x/rrc01/2024.01/bview.gz", "/x/c1/f", "c1/f", "f", "/f", "a//f", "a/b/", "a\nb/c"]
    d = spark.createDataFrame([(n,) for n in names], "f string")
    got = d.select(F.regexp_extract("f", rib.COLLECTOR, 1).alias("a"), F.regexp_extract("f", r"([^/]+)/[^/]+$", 1).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] == ["2024.01", "c1", "c1", "", "", "", "", "a\nb"]


def test_segments_read_the_observations_once(spark, tmp_path):
    """The result rests on the prefixes written once, and the tables of the steps before are gone."""
    sf = tables(spark, tmp_path, lineitem=(LINES, lines(400)))
    before = held(spark)
    df = entry.queries()["geo_segments"](spark, sf)
    assert df.count() > 0 and not [f for f in df.inputFiles() if "lineitem" in f]
    # left: prefixes, (prefix, origin) rows, raw places, the carved pieces, and the chunks of merge and numbering
    assert len(held(spark) - before) <= 7


def test_a_step_leaves_only_its_result(spark, tmp_path):
    before = held(spark)
    kept = []

    def make():
        kept.append(session.cut_lineage(spark.range(3), keep=True))
        inner = session.settle(lambda: session.cut_lineage(spark.range(5)).where("id > 0"))
        return inner.join(session.cut_lineage(spark.range(4)), ["id"])

    out = session.settle(make)
    assert sorted(r[0] for r in out.collect()) == [1, 2, 3] and kept[0].count() == 3
    assert len(held(spark) - before) == 2
    c = runs.with_chunks(spark.range(1000).repartition(4), [F.col("id")], chunk_bytes=10)
    assert c.count() == 1000 and len(held(spark) - before) == 3


def test_a_written_step_keeps_no_shuffle_files(spark):
    live = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().size()
    was = live()
    d = session.cut_lineage(spark.range(1000).repartition(4).groupBy((F.col("id") % 7).alias("k")).count())
    assert d.count() == 7 and live() <= was + 10 and spark.conf.get(session.SHUFFLE_CLEANUP) == "false"


def test_a_table_of_many_row_groups_keeps_its_splits(spark, tmp_path):
    one, many = f"{tmp_path}/one.parquet", f"{tmp_path}/many dir/many.parquet"
    spark.range(10_000).coalesce(1).write.parquet(one)
    spark.range(10_000).repartition(6).write.parquet(many)
    assert fixtures.scan_tasks(spark.read.parquet(one), 4) == 1
    assert fixtures.scan_tasks(spark.read.parquet(many), 4) == 6
    assert 1 <= fixtures.scan_tasks(spark.read.parquet(many), 100) <= 6
