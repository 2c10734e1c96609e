"""Events of runs and streams, and runs that are stopped."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from plumage.streaming import progress


def slow(spark, tasks, seconds):
    def batches(source):
        for pdf in source:
            time.sleep(seconds)
            yield pdf

    return spark.range(0, tasks, 1, tasks).mapInPandas(batches, "id long")


def test_a_run_tells_start_ticks_and_end(spark):
    seen = []
    result = progress.Run(spark, seen.append, 0.1)(lambda: slow(spark, 24, 0.4).count())
    assert result == 24
    assert seen[0] == {"kind": "start", "done": 0, "total": 1} and seen[-1]["kind"] == "done" and seen[-1]["done"] == seen[-1]["total"] >= 24
    ticks = [e["done"] for e in seen[1:-1]]
    assert ticks and ticks == sorted(set(ticks)) and all(e["kind"] == "tick" for e in seen[1:-1])
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None

    def broken(event):
        raise ValueError("a callback's fault")

    assert progress.Run(spark, broken)(lambda: spark.range(5).count()) == 5
    with pytest.raises(ZeroDivisionError):
        progress.Run(spark, seen.append)(lambda: 1 / 0)
    assert seen[-1]["kind"] == "failed"


def test_a_stopped_run_leaves_no_half_table(spark, tmp_path):
    target, seen = str(tmp_path / "table"), []
    run = progress.Run(spark, seen.append, 0.1)

    def stop():
        while not any(e["kind"] == "tick" for e in seen):
            time.sleep(0.05)
        run.cancel()

    threading.Thread(target=stop).start()
    began = time.time()
    with pytest.raises(progress.Cancelled):
        progress.write_whole(slow(spark, 200, 1.0), target, run)
    assert time.time() - began < 40 and seen[-1]["kind"] == "cancelled" and seen[-1]["done"] < 200
    assert os.listdir(tmp_path) == []  # neither the table nor a part of it
    with pytest.raises(progress.Cancelled):
        run(lambda: spark.range(5).count())  # what is stopped doesn't begin again
    progress.write_whole(spark.range(9), target)
    assert spark.read.parquet(target).count() == 9 and os.listdir(tmp_path) == ["table"]
    with pytest.raises(FileExistsError):
        progress.write_whole(spark.range(1), target)
    assert spark.range(3).count() == 3  # later jobs of the session run


def test_a_stream_tells_its_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(0, 30, 1, 3).write.parquet(folder)
    seen = []
    listener = progress.StreamProgress(seen.append, 30, "followed")
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(folder)
        for name in ("followed", "other"):
            query = stream.select(F.col("id") * 2).writeStream.queryName(name).format("memory").trigger(availableNow=True).start()
            query.awaitTermination(120)
        for _ in range(100):
            if seen and seen[-1]["kind"] == "done":
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert [(e["kind"], e["done"], e["total"]) for e in seen] == [("start", 0, 30), ("tick", 10, 30), ("tick", 20, 30), ("tick", 30, 30), ("done", 30, 30)]


def test_remaining_seconds():
    phases = [{"est": 10.0, "finished": True}, {"est": 20.0, "items": 10, "items_done": 4, "rate": 3.0}, {"est": 5.0}]
    assert progress.remaining_seconds(phases) == 23.0
    phases[1] |= {"rate": None}
    assert progress.remaining_seconds(phases) == 17.0
    phases[1] |= {"items_done": 10}
    assert progress.remaining_seconds(phases) == 5.0
    assert progress.remaining_seconds([{"est": 20.0, "began": 100.0}, {"est": 1.0}], now=112.0) == 9.0
    assert progress.remaining_seconds([{"est": 20.0, "began": 100.0}], now=190.0) == 0.0
    assert progress.remaining_seconds([]) is None and progress.remaining_seconds([{"finished": True}]) == 0.0
