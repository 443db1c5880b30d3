"""Streams with state: replays, stragglers and tables that hold rows before."""

import time

import pytest

from strata.streaming import ingest

ROWS = "run bigint, seq bigint, objective double, feasible boolean"


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def last(spark, path):
    got = {}
    for r in spark.read.parquet(path).orderBy("batch").collect():
        got[r.run] = (r.seq, r.best, r.since, r.late)
    return got


def run(spark, path, schema):
    stream = ingest.read_files(spark, f"{path}/in", schema, files_per_batch=1)

    def keep(batch, number):
        from pyspark.sql import functions as F

        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{path}/out")

    ingest.best_so_far(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def test_best_over_batches_replays_and_stragglers(spark, tmp_path):
    path = str(tmp_path)
    feed(spark, f"{path}/in", [(1, 2, 5.0, True), (1, 1, 3.0, True), (1, 3, 9.0, False), (2, 1, None, True), (2, 2, None, None), (2, 2, 4.0, True)], ROWS)
    run(spark, path, ROWS)
    assert last(spark, f"{path}/out") == {1: (3, 5.0, 1, 0), 2: (2, None, 2, 1)}
    feed(spark, f"{path}/in", [(1, 4, 5.0, True), (1, 5, 1.0, True), (2, 3, 1.0, True)], ROWS)
    run(spark, path, ROWS)
    assert last(spark, f"{path}/out") == {1: (5, 5.0, 3, 0), 2: (3, 1.0, 0, 1)}
    feed(spark, f"{path}/in", [(1, 4, 50.0, True), (1, 6, 6.0, True), (3, 1, 0.0, False)], ROWS)  # a straggler, an improvement, a new run
    run(spark, path, ROWS)
    assert last(spark, f"{path}/out") == {1: (6, 6.0, 0, 1), 2: (3, 1.0, 0, 1), 3: (1, None, 1, 0)}


def test_state_with_a_time_to_live(spark, tmp_path):
    path = str(tmp_path)
    feed(spark, f"{path}/in", [(1, 1, 2.0, True)], ROWS)
    stream = ingest.best_so_far(ingest.read_files(spark, f"{path}/in", ROWS), idle_ms=1_000)
    got = []
    query = stream.writeStream.foreachBatch(lambda batch, _: got.extend(map(tuple, batch.collect()))).outputMode("update").option("checkpointLocation", f"{path}/state").trigger(processingTime="1 second").start()
    try:
        for count, rows in ((1, None), (2, [(1, 1, 3.0, True)])):  # the state is gone: the same seq is no straggler
            if rows:
                time.sleep(3)
                feed(spark, f"{path}/in", rows, ROWS)
            for _ in range(60):
                if len(got) >= count:
                    break
                time.sleep(1)
    finally:
        query.stop()
    assert got == [(1, 1, 2.0, 0, 0), (1, 1, 3.0, 0, 0)]


@pytest.mark.parametrize("before", [False, True])
def test_staging_holds_keys_as_state(spark, tmp_path, before):
    schema, path = "k bigint, v string", str(tmp_path)
    if before:
        feed(spark, f"{path}/target", [(1, "old"), (None, "old")], schema)
    for rows in ([(1, "a"), (2, "a"), (2, "again"), (None, "a")], [(2, "b"), (3, "b"), (None, "b")]):
        feed(spark, f"{path}/in", rows, schema)
    for checkpoint in ("c1", "c1", "c2"):  # a second run of the stream, and one that has lost its state
        ingest.stage(ingest.read_files(spark, f"{path}/in", schema, files_per_batch=1), f"{path}/target", f"{path}/{checkpoint}", ["k"]).awaitTermination()
    got = spark.read.parquet(f"{path}/target").collect()
    assert sorted(str(r.k) for r in got) == ["1", "2", "3", "None"]
    assert not before or {r.v for r in got if r.k in (1, None)} == {"old"}
