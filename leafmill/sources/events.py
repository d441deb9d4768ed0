"""What tasks are doing, told while they do it: lines that they append to files in a shared folder, and a thread of the driver that follows them."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from collections.abc import Callable
from pathlib import Path

from .pages import Response


class EventLog:
    """A folder of files of JSON lines; each process appends to one of its own, so no two ever write to one file."""

    def __init__(self, folder: str):
        self.folder = folder
        self._file = None

    def __getstate__(self):
        return {"folder": self.folder, "_file": None}

    def append(self, **event) -> None:
        if self._file is None:
            os.makedirs(self.folder, exist_ok=True)
            self._file = open(os.path.join(self.folder, f"{uuid.uuid4().hex}.jsonl"), "a", encoding="utf-8")  # noqa: SIM115  open as long as its task
        self._file.write(json.dumps({"at": time.time()} | event, ensure_ascii=False) + "\n")
        self._file.flush()


class Follower:
    """Within it, every event of a log is told once, soon after it was written; at its end nothing is left untold. An error of the function that is told ends
    the following, and is raised at the end."""

    def __init__(self, log: EventLog, told: Callable[[dict], None], every_seconds: float = 0.1):
        self._folder, self._told, self._every = Path(log.folder), told, every_seconds
        self._at: dict[str, int] = {}
        self._over, self._error = threading.Event(), None

    def _read(self) -> None:
        found = []
        for file in self._folder.glob("*.jsonl"):
            with file.open("rb") as f:
                f.seek(self._at.get(file.name, 0))
                whole = f.read().rpartition(b"\n")[0]  # what is half written is read next time
            if whole:
                self._at[file.name] = self._at.get(file.name, 0) + len(whole) + 1
                found += map(json.loads, whole.decode().split("\n"))
        for event in sorted(found, key=lambda e: e["at"]):
            self._told(event)

    def _follow(self) -> None:
        try:
            while not self._over.wait(self._every):
                self._read()
            self._read()
        except BaseException as e:  # noqa: BLE001  raised where it was begun
            self._error = e

    def __enter__(self) -> Follower:
        self._thread = threading.Thread(target=self._follow, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, kind, value, trace) -> None:
        self._over.set()
        self._thread.join()
        if self._error is not None and kind is None:
            raise self._error


class Told:
    """A fetch function that says when it starts and when it has an answer."""

    def __init__(self, fetch: Callable[[str], Response], log: EventLog):
        self._fetch, self._log = fetch, log

    def __call__(self, url: str) -> Response:
        self._log.append(what="started", url=url)
        try:
            r = self._fetch(url)
        except Exception as e:
            self._log.append(what="failed", url=url, error=str(e))
            raise
        self._log.append(what="answered", url=url, status=r.status)
        return r
