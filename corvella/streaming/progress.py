"""Progress of background jobs, and a manifest stream that applies each batch of changes."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POLL_S, KEEP_S = 0.5, 5.0


class Jobs:
    """Background jobs by id; events() tells phase, current, total, status and error until the job ends."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.jobs, self.clock, self.lock = {}, clock, threading.Lock()

    def start(self, work: Callable[[Callable[[str, int, int], None]], object]) -> str:
        key = str(uuid.uuid4())
        job = {"phase": "starting", "current": 0, "total": 0, "status": "running", "error": None, "result": None, "ended": None}
        with self.lock:
            self.jobs = {k: j for k, j in self.jobs.items() if j["ended"] is None or self.clock() - j["ended"] < KEEP_S}
            self.jobs[key] = job

        def run() -> None:
            try:
                job["result"] = work(lambda phase, current, total: job.update(phase=phase, current=current, total=total))
                job["status"] = "completed"
            except Exception as e:
                job.update(status="failed", error=str(e))
            job["ended"] = self.clock()

        threading.Thread(target=run, daemon=True).start()
        return key

    def events(self, key: str, poll: float = POLL_S) -> Iterator[dict]:
        job = self.jobs[key]
        while True:
            yield dict(job)
            if job["status"] != "running":
                return
            time.sleep(poll)


class Progress:
    """Tells how many rows have passed a place in the running jobs: tell(phase, done, total), every POLL_S seconds and at the end.

    A row counts in an accumulator of its task, which Spark adds up as tasks end; a retried task counts once more, so
    what is told never passes the total."""

    def __init__(self, spark, phase: str, total: int, tell: Callable[[str, int, int], None], poll: float = POLL_S):
        self.phase, self.total, self.tell, self.poll = phase, total, tell, poll
        self.seen = spark.sparkContext.accumulator(0)
        self.over = threading.Event()

    def counted(self, df: DataFrame) -> DataFrame:
        """df itself; its rows are counted as they pass."""
        seen = self.seen

        def run(batches):
            for batch in batches:
                yield batch
                seen.add(batch.num_rows)

        return df.mapInArrow(run, df.schema)

    def _tell(self) -> None:
        self.tell(self.phase, min(self.seen.value, self.total), self.total)

    def __enter__(self) -> Progress:
        self._tell()
        self.thread = threading.Thread(target=self._follow, daemon=True)
        self.thread.start()
        return self

    def _follow(self) -> None:
        while not self.over.wait(self.poll):
            self._tell()

    def __exit__(self, *_) -> None:
        self.over.set()
        self.thread.join()
        self._tell()


def changed_files(manifest: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Stream of (filePath, fileHash, ts) rows → each version of a file once; state is dropped after the delay."""
    return manifest.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["filePath", "fileHash"])


def changes_per_window(manifest: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    return manifest.withWatermark("ts", delay).groupBy(F.window("ts", window)).agg(F.count("*").alias("changes"), F.approx_count_distinct("filePath").alias("files"))


def rescan_on(manifest: DataFrame, rescan: Callable[[], object], checkpoint: str):
    """Starts a stream that calls rescan() for every batch with changes."""

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            rescan()

    return manifest.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
