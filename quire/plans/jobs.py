"""Jobs in one session: submit, poll, cancel, fetch, forget.

A job's rows are written to the shared folder by the tasks that make them; the driver keeps
the path, and reads a result where it is fetched.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import Accumulator
from pyspark.sql import DataFrame, Row, SparkSession

from quire.staging import forget, written


class NotReady(Exception):
    """The job has not finished, or has failed."""


@dataclass
class Job:
    tag: str
    state: str = "PENDING"
    total: int = 0
    done: Accumulator | None = None
    result: DataFrame | None = None
    path: str | None = None
    error: str | None = None
    thread: threading.Thread | None = None
    lock: threading.Lock = field(default_factory=threading.Lock)


class Jobs:
    """Each job runs in a thread of its own under a job group, by which its stages are counted and cancelled."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._jobs = spark, {}

    def submit(self, work: Callable[[], DataFrame], total: int = 0, done: Accumulator | None = None) -> str:
        """Starts a job; ``done`` counts its steps, of which there are ``total``."""
        job = Job(f"job-{uuid.uuid4().hex}", total=total, done=done)

        def run() -> None:
            self.spark.sparkContext.setJobGroup(job.tag, "quire", interruptOnCancel=True)
            with job.lock:
                if job.state == "REVOKED":
                    return
                job.state = "PROGRESS"
            try:
                rows, path = written(work(), "job")
                with job.lock:
                    if job.state != "REVOKED":
                        job.result, job.path, job.state = rows, path, "SUCCESS"
            except Exception as failure:  # noqa: BLE001  kept as the job's error
                with job.lock:
                    if job.state != "REVOKED":
                        job.error, job.state = f"{type(failure).__name__}: {failure}", "FAILURE"
            finally:
                self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

        job.thread = threading.Thread(target=run, daemon=True)
        self._jobs[job.tag] = job
        job.thread.start()
        return job.tag

    def known(self, job_id: str) -> bool:
        return job_id in self._jobs

    def status(self, job_id: str) -> dict:
        """The state; while it runs, also steps done (n) of the total.

        Without a counter of its own, a job's finished tasks count.
        """
        job = self._jobs[job_id]
        out: dict = {"state": job.state}
        if job.state == "PROGRESS":
            if job.done is not None:
                n = min(job.total, job.done.value)  # a task that runs twice counts twice
            else:
                tracker = self.spark.sparkContext.statusTracker()
                stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(job_id) if (info := tracker.getJobInfo(j)) for s in info.stageIds]
                n = sum(s.numCompletedTasks for s in stages if s)
            out["info"] = {"n": n, "total": job.total}
        return out

    def cancel(self, job_id: str) -> dict:
        job = self._jobs[job_id]
        with job.lock:
            if job.state in ("PENDING", "PROGRESS"):
                job.state = "REVOKED"
        self.spark.sparkContext.cancelJobGroup(job_id)
        return {"state": job.state}

    def fetch(self, job_id: str) -> DataFrame:
        """The job's rows, from where they were written."""
        job = self._jobs[job_id]
        if job.state != "SUCCESS":
            raise NotReady(job.error or f"the job is {job.state.lower()}")
        return job.result

    def forget(self, job_id: str) -> None:
        """Drops a job that is over, and its rows."""
        job = self._jobs.pop(job_id)
        if job.path:
            forget(self.spark, job.path)

    def wait(self, job_id: str, seconds: float | None = None) -> str:
        self._jobs[job_id].thread.join(seconds)
        return self._jobs[job_id].state
