"""Jobs: queued, run one after the other by one worker, looked at, cancelled while queued, cleared when over."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Job:
    id: str
    type: str
    request: dict
    state: str = "queued"
    ok: bool = False
    exit_code: int = 0
    message: str = ""
    result: dict | None = None
    created_at: float = 0.0
    started_at: float = 0.0
    finished_at: float = 0.0

    def shown(self) -> dict:
        return {
            "id": self.id, "type": self.type, "state": self.state, "ok": self.ok, "exitCode": self.exit_code, "message": self.message,
            "inputPath": self.request.get("inputPath") or self.request.get("inputDir") or "", "outputPath": self.request.get("outputPath") or self.request.get("outputDir") or "",
            "createdAt": int(self.created_at), "startedAt": int(self.started_at), "finishedAt": int(self.finished_at),
        }


OVER = ("succeeded", "failed", "canceled")


class Jobs:
    """run: from a type and a request to a result (a dict), on the one worker thread; without start the queue stands still."""

    def __init__(self, run: Callable[[str, dict], dict], start: bool = True):
        self._run = run
        self._jobs: OrderedDict[str, Job] = OrderedDict()
        self._made = 0
        self._changed = threading.Condition()
        self._stopped = False
        self._worker = threading.Thread(target=self._work, daemon=True) if start else None
        if self._worker:
            self._worker.start()

    def submit(self, kind: str, request: dict) -> Job:
        with self._changed:
            self._made += 1
            job = Job(f"job-{self._made:06d}", kind, dict(request), created_at=time.time())
            self._jobs[job.id] = job
            self._changed.notify_all()
            return job

    def get(self, name: str) -> Job | None:
        with self._changed:
            return self._jobs.get(name)

    def all(self) -> list[Job]:
        with self._changed:
            return list(self._jobs.values())

    def cancel(self, name: str) -> tuple[bool, Job | None]:
        """(done, job): only a queued job can be cancelled."""
        with self._changed:
            job = self._jobs.get(name)
            if job is None or job.state != "queued":
                return False, job
            return True, self._set(job, state="canceled", message="canceled", finished_at=time.time())

    def clear_finished(self) -> int:
        with self._changed:
            over = [k for k, j in self._jobs.items() if j.state in OVER]
            for k in over:
                del self._jobs[k]
            return len(over)

    def wait(self, name: str, timeout: float | None = None) -> Job | None:
        with self._changed:
            self._changed.wait_for(lambda: name not in self._jobs or self._jobs[name].state in OVER, timeout)
            return self._jobs.get(name)

    def stop(self) -> None:
        with self._changed:
            self._stopped = True
            self._changed.notify_all()
        if self._worker:
            self._worker.join()

    def _set(self, job: Job, **change) -> Job:
        self._jobs[job.id] = job = replace(job, **change)
        self._changed.notify_all()
        return job

    def _next(self) -> Job | None:
        return next((j for j in self._jobs.values() if j.state == "queued"), None)

    def _work(self) -> None:
        while True:
            with self._changed:
                self._changed.wait_for(lambda: self._stopped or self._next() is not None)
                if self._stopped:
                    return
                job = self._set(self._next(), state="running", started_at=time.time())
            try:
                over = {"state": "succeeded", "ok": True, "message": "done", "result": self._run(job.type, job.request)}
            except Exception as e:  # noqa: BLE001
                over = {"state": "failed", "exit_code": 1, "message": (str(e) or type(e).__name__).splitlines()[0]}
            with self._changed:
                self._set(job, finished_at=time.time(), **over)
