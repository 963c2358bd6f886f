"""Incremental work as Structured Streaming: collector refresh, route-object deltas, pings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import consolidate as C
from ..operators import deltas as D
from ..operators import measure as M
from ..operators import runs
from ..sinks import sink_collector_replace


def collector_refresh(rib: DataFrame, stage_path: str, checkpoint: str) -> StreamingQuery:
    """Stream of RIB rows of new snapshots into a staging area, one partition per batch.

    A batch overwrites only its own partition, so a repeated one is harmless, and a snapshot may span any
    number of batches. Nothing is visible before ``publish_refresh``.
    """
    def stage(batch: DataFrame, batch_id: int) -> None:
        C.obs_dedup(batch).write.mode("overwrite").parquet(f"{stage_path}/batch={batch_id}")

    return rib.writeStream.foreachBatch(stage).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish_refresh(spark: SparkSession, stage_path: str, base_path: str) -> None:
    """Once a snapshot is whole: its batches are summed and replace the collectors they bring; the rest stays."""
    staged = spark.read.parquet(stage_path).drop("batch")
    staged = staged.repartition(runs.tasks(staged), "prefix", "path_raw")
    keys = [c for c in staged.columns if c != "n_peers"]
    sink_collector_replace(staged.groupBy(*keys).agg(F.sum("n_peers").alias("n_peers")).select(*staged.columns), base_path)


def rebuilt_tables(spark: SparkSession, base_path: str) -> tuple[DataFrame, DataFrame]:
    """Merged paths and prefixes from the current observations."""
    current = spark.read.parquet(base_path)
    merged = C.pathobs_merge(current.repartition(runs.tasks(current), "prefix", "path_raw"))
    return merged, C.prefix_agg(merged)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # fixed value: Spark's store for keyed state


class SerialGap(ValueError):
    """The batch does not follow the state: operations are missing and nothing was committed."""


class LastOperation(StatefulProcessor):
    """Per route object the serial and the kind of its last operation; one row for every operation that arrives.

    An operation takes effect if its serial is higher than the object's, so late and repeated ones change nothing, and
    only objects with operations are written.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "serial long, op string")

    def handleInputRows(self, key, rows, timer_values):  # noqa: N802
        at, kind = self.last.get() if self.last.exists() else (None, None)
        before = at
        for pdf in rows:
            effect = []
            for serial, op in zip(pdf["serial"].tolist(), pdf["op"].tolist(), strict=True):
                if at is None or serial > at:
                    at, kind = serial, op
            for serial in pdf["serial"].tolist():
                effect.append(before is None or serial > before)
            out = pdf.assign(effective=effect)
            for name, part in zip(D.OBJECT, key, strict=True):
                out[name] = part
            yield out[[*D.OBJECT, "serial", "op", "effective"]]
        if at is not None and at != before:
            self.last.update((at, kind))

    def handleInitialState(self, key, state, timer_values) -> None:  # noqa: N802
        row = state.sort_values("serial").iloc[-1]
        self.last.update((int(row["serial"]), row["op"]))

    def close(self) -> None:
        pass


def irr_delta_stream(deltas: DataFrame, base_path: str, log_path: str, checkpoint: str) -> StreamingQuery:
    """Journal operations applied to keyed state; each batch of n operations writes at most n rows of state and of log.

    The state starts from the dump at ``base_path`` (see ``write_initial_state``). A batch commits only if no serial is missing after
    the last one committed; else it fails with ``SerialGap`` before its offsets are committed, and a restart repeats it on the state as it
    was. A repeated batch overwrites its own part of the log. ``deltas.needs_reload`` tells whether the journal can still close
    the gap; then ``read_state`` is the dump from which a new checkpoint goes on with all operations that follow.
    """
    spark = deltas.sparkSession
    spark.conf.set(STATE_STORE, ROCKSDB)
    base = spark.read.parquet(base_path)
    start = base.agg(F.max("serial")).first()[0]
    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*D.OBJECT, "serial", "op")) + ", effective boolean"
    rows = deltas.select(*D.OBJECT, F.col("serial").cast("bigint").alias("serial"), "op")
    applied = rows.groupBy(*D.OBJECT).transformWithStateInPandas(
        LastOperation(), schema, "Update", "None", base.where("op IS NOT NULL").groupBy(*D.OBJECT))

    def commit(batch: DataFrame, batch_id: int) -> None:
        part = f"{log_path}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(part)
        spark = batch.sparkSession
        log = spark.read.schema(batch.schema).parquet(part)
        before = spark.read.parquet(log_path).where(F.col("batch") < batch_id).agg(F.max("serial")).first()[0] if batch_id else None
        at = start if before is None else max(start, before)
        new = log.where(F.col("serial") > at)
        last = new.agg(F.max("serial")).first()[0]
        if last is not None and not D.complete(new, at + 1, last):
            batch.limit(0).write.mode("overwrite").parquet(part)
            raise SerialGap(f"operations after {at} are missing")

    return (applied.writeStream.outputMode("update").foreachBatch(commit).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def write_initial_state(state: DataFrame, base_path: str, serial: int) -> None:
    """The full dump that a journal continues after ``serial``; an empty dump keeps the serial in a row without an operation."""
    rows = D.versioned(state, serial)
    mark = state.sparkSession.range(1).select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in D.OBJECT],
                                              F.lit(serial).cast("bigint").alias("serial"), F.lit(None).cast("string").alias("op"))
    rows.unionByName(mark).write.mode("overwrite").parquet(base_path)


def read_state(spark: SparkSession, base_path: str, log_path: str | None = None) -> DataFrame:
    """Live route objects: the dump and the log of the committed batches, the last operation of each object."""
    base = spark.read.parquet(base_path).where("op IS NOT NULL")
    if log_path is None:
        return D.live(base)
    return D.live(D.advance(base, spark.read.parquet(log_path).where("effective")))


def ping_stream(rounds: DataFrame, checkpoint: str, sink: str) -> StreamingQuery:
    """Running statistics per probe in update mode; each batch upserts into ``sink`` by version."""
    def emit(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return (M.ping_rounds(rounds).writeStream.outputMode("update").foreachBatch(emit)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_pings(spark: SparkSession, sink: str) -> DataFrame:
    """Last emitted row of each probe."""
    d = spark.read.parquet(sink)
    cols = [c for c in d.columns if c != "batch"]
    return d.groupBy("probe").agg(F.max_by(F.struct(*cols), "batch").alias("r")).select("r.*")
