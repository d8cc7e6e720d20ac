"""Progress of a job of several sections: who runs it sees each section begin and end, and can cancel the rest."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from queue import Queue

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.scratch import shared_folder

REPORT = "seq int, section string, status string, completed int, total int, n_rows long, error string"


@dataclass(frozen=True)
class Step:
    """type: start, progress, cancelled or done; status of a section: running, success or error."""

    type: str
    section: str | None = None
    status: str | None = None
    completed: int = 0
    total: int = 0
    n_rows: int | None = None
    error: str | None = None


class Batch:
    """Runs sections one after another, each as a job group of its own, and writes each result to a folder.

    A section that fails is reported and doesn't stop the others.  cancel() ends the running section and starts no other.  The
    work goes on in its own thread whether or not anybody reads steps().
    """

    def __init__(self, spark: SparkSession, sections: dict[str, Callable[[], DataFrame]], folder: str | None = None):
        self.spark, self.sections, self.folder = spark, sections, folder or shared_folder(spark)
        self._queue: Queue[Step | None] = Queue()
        self._cancelled = threading.Event()
        self._name = self.folder.rpartition("/")[2]
        self._thread = threading.Thread(target=self._run, daemon=True)

    def start(self) -> Batch:
        self._thread.start()
        return self

    def cancel(self) -> None:
        self._cancelled.set()
        self.spark.sparkContext.cancelJobsWithTag(self._name)

    def steps(self) -> Iterator[Step]:
        """The steps as they come, until the job is done or cancelled."""
        while (step := self._queue.get()) is not None:
            yield step

    def result(self, section: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{section}")

    def _run(self) -> None:
        total, done = len(self.sections), 0
        self._queue.put(Step("start", total=total))
        self.spark.sparkContext.addJobTag(self._name)
        try:
            for name, make in self.sections.items():
                if self._cancelled.is_set():
                    break
                self._queue.put(Step("progress", name, "running", done, total))
                try:
                    make().write.mode("overwrite").parquet(f"{self.folder}/{name}")
                    rows, status, error = self.result(name).count(), "success", None
                except Exception as e:  # whatever a section raises is its own; the next ones still run
                    if self._cancelled.is_set():
                        break
                    rows, status, error = None, "error", f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
                done += 1
                self._queue.put(Step("progress", name, status, done, total, rows, error))
            self._queue.put(Step("cancelled" if self._cancelled.is_set() else "done", completed=done, total=total))
        finally:
            self.spark.sparkContext.removeJobTag(self._name)
            self._queue.put(None)


def report(batch: Batch) -> DataFrame:
    """Run a batch; a row for each section that ended."""
    ended = [asdict(s) for s in batch.start().steps() if s.type == "progress" and s.status != "running"]
    rows = [(k + 1, s["section"], s["status"], s["completed"], s["total"], s["n_rows"], s["error"]) for k, s in enumerate(ended)]
    return batch.spark.createDataFrame(rows, REPORT)
