"""Published files: key-sorted Parquet, per-country directories, collector replacement, CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import runs


def sink_sorted(df: DataFrame, path: str, keys: Sequence[str | Column], partitions: int | None = None,
                max_records: int = 2_000_000, mode: str = "overwrite") -> None:
    """Files with disjoint key ranges, so footers and row groups prune lookups."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    ranged = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    ranged.sortWithinPartitions(*cols).write.mode(mode).option("maxRecordsPerFile", max_records).parquet(path)


def sink_country(working_set: DataFrame, path: str, max_records: int = 500_000) -> None:
    """One directory per country, inside by city (nulls first) and n_paths desc.

    Range partitioning by (cc, city, n_paths) splits a dominant country over many tasks.
    """
    d = working_set.where("cc IS NOT NULL")
    order = [F.col("cc"), F.col("city").asc_nulls_first(), F.col("n_paths").desc()]
    d.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("cc").option(
        "maxRecordsPerFile", max_records).parquet(path)


def _dealt(obs: DataFrame) -> DataFrame:
    """By collector and hash in ranges, in more than the session's shuffle partitions where the size asks for it."""
    n = runs.tasks(obs)
    more = [n] if n > int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    return obs.repartitionByRange(*more, "collector", F.xxhash64("prefix", "path_raw"))


def sink_collector_replace(obs: DataFrame, path: str, *, base_load: bool = False, rebuild: bool = False) -> None:
    """Write observations by collector. A base load replaces everything; later loads replace
    only the collectors they bring and must name known ones."""
    if base_load and rebuild:
        raise ValueError("a full reset and a collector replacement exclude each other")
    if base_load:
        _dealt(obs).write.mode("overwrite").partitionBy("collector").parquet(path)
        return
    spark = obs.sparkSession
    known = spark.read.parquet(path).select("collector").distinct()  # a missing base load fails here
    unknown = obs.select("collector").distinct().join(known, ["collector"], "left_anti").limit(5).collect()
    if unknown:
        raise ValueError(f"unknown collectors: {sorted(r['collector'] for r in unknown)}")
    (_dealt(obs).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("collector").parquet(path))


def sink_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Relative names of the Parquet files below a folder, listed by Spark."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    return f.select(F.element_at(F.split("path", base), -1).alias("file"))


def integrity_gate(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Files the manifest names that do not exist; publish only when this is empty."""
    return manifest.select("file").distinct().join(listing.select("file"), ["file"], "left_anti")


def publishable(manifest: DataFrame, listing: DataFrame) -> bool:
    return not manifest.isEmpty() and integrity_gate(manifest, listing).isEmpty()
