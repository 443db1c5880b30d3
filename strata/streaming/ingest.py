"""Streams of records into staging tables and quarantine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from strata.operators.joins import validity
from strata.operators.rules import Rule, quarantine
from strata.sources.release import new_rows


def read_files(spark: SparkSession, path: str, schema, *, files_per_batch: int = 100, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def use_rocksdb(spark: SparkSession) -> None:
    """State of streams that start from now on is kept in RocksDB, on disk beside its changelog, not in the executors' heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def held_keys(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """The keys that a table holds now; none where there is no table yet."""
    try:
        return spark.read.parquet(target).select(*schema.names)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def _append_new(batch: DataFrame, target: str, keys: list[str]) -> None:
    have = held_keys(batch.sparkSession, target, batch.select(*keys).schema)
    new_rows(batch.dropDuplicates(keys), have, keys).write.mode("append").parquet(target)


def stage(stream: DataFrame, target: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Appends rows whose keys, nulls among them, aren't in the target yet, all that is there now, then stops.

    What the stream has brought is held as state, in the RocksDB store of the checkpoint; what the target held before,
    from other streams or a batch that failed half-way, is read once a run. So no batch reads what the others appended.
    """
    spark = stream.sparkSession
    use_rocksdb(spark)
    have = held_keys(spark, target, stream.select(*keys).schema).persist()
    once = stream.dropDuplicates(keys)
    return once.writeStream.foreachBatch(lambda batch, _: new_rows(batch, have, keys).write.mode("append").parquet(target)).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_by_hash(stream: DataFrame, event_time: str, sha: str, *, delay: str = "1 hour") -> DataFrame:
    """Each content hash once within the watermark."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([sha])


def validate(stream: DataFrame, rules: list[Rule], good: str, bad: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Rows that pass all rules go to one table, the others with their reason to another."""

    def handle(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        fine, refused = quarantine(batch, rules)
        _append_new(fine, good, keys)
        _append_new(refused, bad, keys)
        batch.unpersist()

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def check_validity(stream: DataFrame, windows: DataFrame) -> DataFrame:
    """A stream of records (calibration, at) with the state of their calibration window, from a static table."""
    return validity(stream, windows)


BEST = "run bigint, seq bigint, best double, since bigint, late bigint"


class BestSoFar(StatefulProcessor):
    """Of each run its last seq, its best and the evaluations since; one value of state a run, however long it is."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("best", "seq bigint, best double, since bigint, late bigint", self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seq, best, since, late = self.state.get() if self.state.exists() else (None, None, 0, 0)
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")  # a run's rows of one micro-batch
        fresh = ~batch["seq"].duplicated() & (batch["seq"] > (seq if seq is not None else -np.inf))
        late += int((~fresh).sum())
        batch = batch[fresh]
        if len(batch):
            value = batch["objective"].where(batch["feasible"].astype("boolean").fillna(False)).to_numpy(np.float64, na_value=np.nan)
            before = np.fmax.accumulate(np.concatenate(([np.nan if best is None else best], value)))
            better = np.flatnonzero((value > before[:-1]) | (np.isnan(before[:-1]) & ~np.isnan(value)))
            since = len(value) - 1 - int(better[-1]) if len(better) else since + len(value)
            best = None if np.isnan(before[-1]) else float(before[-1])
            seq = int(batch["seq"].iloc[-1])
        self.state.update((seq, best, since, late))
        yield pd.DataFrame({"run": [key[0]], "seq": [seq], "best": [best], "since": [since], "late": [late]}).astype({"best": "float64", "seq": "Int64"})

    def close(self) -> None:
        pass


def best_so_far(stream: DataFrame, *, idle_ms: int | None = None) -> DataFrame:
    """A stream (run, seq, objective, feasible): after each micro-batch, each run's last seq, best, evaluations since it improved, and late rows.

    Rows are taken in the order of their seq. One that isn't beyond what the run has had, a replay or a straggler, is
    counted as late and changes nothing else. With `idle_ms` the state of a run that gets no rows for so long is dropped,
    and a later row begins it anew; that needs a trigger that goes on, as one that takes what is there never ends with
    it. State is kept in RocksDB.
    """
    use_rocksdb(stream.sparkSession)
    return stream.groupBy("run").transformWithStateInPandas(BestSoFar(idle_ms), BEST, "update", "processingTime" if idle_ms else "none")


def windowed_counts(stream: DataFrame, event_time: str, *, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts by tumbling window; rows later than the watermark are left out."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
