"""Progress of runs as events, and ways to stop them that leave nothing half done.

Events are dicts as callers expect them: ``kind`` (``start``, ``tick``, ``done``,
``cancelled``, ``failed``), ``done`` and ``total``. Batch runs are told by their tasks,
which Spark's status tracker counts; streams by their listener, which counts rows.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

Callback = Callable[[dict], None]


class Cancelled(RuntimeError):
    """The run was stopped by :meth:`Run.cancel`."""


class Run:
    """STM2, STM3, UDF3: one action, with progress by its tasks and a way to stop it.

    ``callback`` hears of ``start``, of ``tick`` where the number of finished tasks has
    risen, and of the end; what it raises is ignored, as it must not end the run.
    Stages become known as the action goes on, so ``total`` rises too.
    """

    def __init__(self, spark: SparkSession, callback: Callback | None = None, every: float = 0.2):
        self.spark, self.callback, self.every = spark, callback, every
        self.tag = f"plumage-{uuid.uuid4().hex}"
        self.stopped = threading.Event()
        self.over = threading.Event()
        self.last = (0, 0)

    def _tell(self, kind: str, done: int, total: int) -> None:
        if self.callback:
            try:
                self.callback({"kind": kind, "done": done, "total": max(1, total)})
            except Exception:  # noqa: BLE001
                pass

    def counts(self) -> tuple[int, int]:
        """Finished and known tasks of the run's jobs."""
        tracker = self.spark.sparkContext.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(self.tag)]
        stages = {s for j in jobs if j for s in j.stageIds}
        found = [i for i in map(tracker.getStageInfo, stages) if i]
        return sum(i.numCompletedTasks for i in found), sum(i.numTasks for i in found)

    def _watch(self) -> None:
        while not self.over.wait(self.every):
            if self.stopped.is_set():
                self.spark.interruptTag(self.tag)  # again and again: a job may have begun since
                self.spark.sparkContext.cancelJobGroup(self.tag)
            done, total = self.counts()
            if done > self.last[0]:
                self.last = (done, total)
                self._tell("tick", done, total)

    def __call__(self, action: Callable[[], object]) -> object:
        """The action's result; :class:`Cancelled` if it was stopped, else what it raised."""
        context = self.spark.sparkContext
        watcher = threading.Thread(target=self._watch, daemon=True)
        self._tell("start", 0, 0)
        context.setJobGroup(self.tag, self.tag, interruptOnCancel=True)
        self.spark.addTag(self.tag)
        watcher.start()
        kind = "failed"
        try:
            if self.stopped.is_set():
                raise Cancelled(self.tag)
            result = action()
            kind = "done"
            return result
        except Exception as e:
            if self.stopped.is_set():
                kind = "cancelled"
                raise Cancelled(self.tag) from e
            raise
        finally:
            self.over.set()
            watcher.join()
            self.spark.removeTag(self.tag)
            context.setLocalProperty("spark.jobGroup.id", None)
            context.setLocalProperty("spark.job.description", None)
            done, total = self.counts()
            self._tell(kind, total if kind == "done" else done, total)

    def cancel(self) -> None:
        """Stop the run, from any thread; before it has begun, it doesn't begin."""
        self.stopped.set()


def write_whole(df: DataFrame, path: str, run: Run | None = None) -> None:
    """Write ``df`` to ``path`` as Parquet so that there is the whole table or none.

    It is written under another name beside ``path`` and renamed at the end; a run that
    is stopped or fails takes what it wrote with it. There must be no such path yet.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    beside = f"{path}.{uuid.uuid4().hex}.part"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    system = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(hadoop(path)):
        raise FileExistsError(path)
    try:
        (run or Run(spark))(lambda: df.write.parquet(beside))
        if not system.rename(hadoop(beside), hadoop(path)):
            raise OSError(f"{beside} could not be renamed")
    finally:
        system.delete(hadoop(beside), True)


class StreamProgress(StreamingQueryListener):
    """STM2 for streams: ``start``, a ``tick`` with the rows so far for each batch, and the end.

    Register with ``spark.streams.addListener``. ``total`` is what the caller expects,
    or the rows so far. One query is followed, by its ``name``; None: every one.
    """

    def __init__(self, callback: Callback, total: int | None = None, name: str | None = None):
        super().__init__()
        self.callback, self.total, self.name = callback, total, name
        self.rows: dict[str, int] = {}

    def _tell(self, kind: str, done: int) -> None:
        try:
            self.callback({"kind": kind, "done": done, "total": max(1, done if self.total is None else self.total)})
        except Exception:  # noqa: BLE001
            pass

    def onQueryStarted(self, event) -> None:
        if self.name in (None, event.name):
            self.rows[str(event.runId)] = 0
            self._tell("start", 0)

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        if run in self.rows and event.progress.numInputRows:
            self.rows[run] += event.progress.numInputRows
            self._tell("tick", self.rows[run])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        if run in self.rows:
            self._tell("failed" if event.exception else "done", self.rows.pop(run))


def remaining_seconds(phases: list[dict], now: float | None = None) -> float | None:
    """MTH7: seconds that the phases still take; None without phases.

    A phase has ``est`` and may have ``finished``, ``began`` and, where it counts items,
    ``items``, ``items_done`` and ``rate`` (seconds an item, see ``bursts.moving_rate``).
    The first that isn't finished is under way; those after it take what is estimated.
    """
    if not phases:
        return None
    now = time.monotonic() if now is None else now
    left = [p for p in phases if not p.get("finished")]
    total = sum(float(p.get("est", 0.0)) for p in left[1:])
    if left:
        p = left[0]
        est, items = float(p.get("est", 0.0)), p.get("items") or 0
        if items > 0:
            done = p.get("items_done") or 0
            open_items = max(0, items - done)
            total += open_items * p["rate"] if p.get("rate") is not None and done > 0 else est * (open_items / items)
        else:
            total += est if p.get("began") is None else max(0.0, est - (now - p["began"]))
    return max(0.0, total)
