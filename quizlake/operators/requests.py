"""A window of open requests to a responder, and a log of its replies.

Both run inside a task, beside the rows of one partition. They know prompts and replies only.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

#: Given to prompts that were never asked, because the responder had stopped answering.
SILENT = "not asked: the responder does not answer"

#: Reply, error text and number of attempts.
Outcome = tuple[str | None, str | None, int]


@dataclass(frozen=True)
class Window:
    """How a task keeps requests open: at most ``in_flight`` at once, each with ``deadline`` seconds for
    all its attempts; after a failure the next attempt waits ``wait`` seconds, then twice as long
    each time, at most ``longest_wait``."""

    in_flight: int = 8
    deadline: float = 60.0
    wait: float = 0.5
    longest_wait: float = 30.0


def digest(asked: tuple[str, ...]) -> str:
    """Name of a request in a reply log."""
    return hashlib.md5(json.dumps(asked).encode()).hexdigest()


@dataclass(frozen=True)
class ReplyLog:
    """Replies in a folder that all machines see under one path, by prompt.

    A request belongs to one of ``buckets`` folders; a task writes files of its own there, a line per
    reply as soon as it has it. A line that was cut off by a lost task is passed over. Errors are not
    logged: those prompts are asked again.
    """

    folder: str
    buckets: int = 256

    def bucket(self, name: str) -> int:
        return int(name[:8], 16) % self.buckets

    def known(self, bucket: int) -> dict[str, Outcome]:
        place, found = f"{self.folder}/{bucket}", {}
        for name in sorted(os.listdir(place)) if os.path.isdir(place) else []:
            with open(f"{place}/{name}", encoding="utf-8") as file:
                for line in file:
                    if line.endswith("\n"):
                        key, reply, attempts = json.loads(line)
                        found[key] = (reply, None, attempts)
        return found


class _Pages:
    """What one task reads of a reply log, and its own files in it."""

    def __init__(self, log: ReplyLog) -> None:
        self.log, self.name = log, f"{uuid.uuid4().hex}.jsonl"
        self.known: dict[int, dict[str, Outcome]] = {}

    def get(self, name: str) -> Outcome | None:
        bucket = self.log.bucket(name)
        if bucket not in self.known:
            self.known[bucket] = self.log.known(bucket)
        return self.known[bucket].get(name)

    def put(self, name: str, outcome: Outcome) -> None:
        bucket = self.log.bucket(name)
        self.known[bucket][name] = outcome
        place = f"{self.log.folder}/{bucket}"
        os.makedirs(place, exist_ok=True)
        with open(f"{place}/{self.name}", "a", encoding="utf-8") as file:
            file.write(json.dumps([name, outcome[0], outcome[2]]) + "\n")


class _Requests:
    """The open requests of one task."""

    def __init__(self, respond: Callable[..., list[str]], window: Window, attempts: int) -> None:
        self.respond, self.window, self.attempts = respond, window, attempts
        self.done: queue.SimpleQueue = queue.SimpleQueue()
        self.silent = False

    def _ask(self, number: int, attempt: int, asked: tuple[str, ...]) -> None:
        def call() -> None:
            try:
                reply = self.respond(*[[value] for value in asked])
                if len(reply) != 1:
                    raise ValueError("one reply per prompt expected")
                self.done.put((number, attempt, reply[0], None))
            except Exception as problem:  # noqa: BLE001 - whatever it was is recorded with the row
                self.done.put((number, attempt, None, f"{type(problem).__name__}: {problem}"))

        # A thread that hangs is left behind; it ends with the worker.
        threading.Thread(target=call, daemon=True).start()

    def run(self, requests: Iterable[tuple[int, tuple[str, ...]]]) -> Iterator[tuple[int, Outcome]]:
        """Outcomes in the order in which they come, never more than a window ahead of the input."""
        waiting, left = iter(requests), True
        open_: dict[int, tuple[tuple[str, ...], float, int]] = {}  # asked, deadline, attempt
        later: list[tuple[float, int]] = []  # attempts put off
        late = 0  # deadlines missed since the last reply
        while True:
            # After a missed deadline the requests still open show first whether anybody answers.
            while left and len(open_) < self.window.in_flight and (not late or not open_ or self.silent):
                number, asked = next(waiting, (None, ()))
                if number is None:
                    left = False
                elif self.silent:
                    yield number, (None, SILENT, 0)
                else:
                    open_[number] = (asked, time.monotonic() + self.window.deadline, 1)
                    self._ask(number, 1, asked)
            if not open_:
                return
            now = time.monotonic()
            while later and later[0][0] <= now:
                _, number = heapq.heappop(later)
                if number in open_:
                    asked, deadline, attempt = open_[number]
                    self._ask(number, attempt, asked)
            due = min([deadline for _, deadline, _ in open_.values()] + [at for at, _ in later])
            try:
                number, attempt, reply, error = self.done.get(timeout=max(0.0, due - time.monotonic()))
            except queue.Empty:
                now = time.monotonic()
                for number, (_, deadline, attempt) in list(open_.items()):
                    if deadline <= now:
                        del open_[number]
                        late += 1
                        yield number, (None, f"TimeoutError: no reply within {self.window.deadline:g} s", attempt)
                # A whole window without a reply: the rest would cost a deadline each and learn nothing.
                self.silent = self.silent or late >= self.window.in_flight
                continue
            if number not in open_ or open_[number][2] != attempt:
                continue  # a reply after its deadline
            asked, deadline, _ = open_[number]
            late = 0
            if error is None:
                del open_[number]
                yield number, (reply, None, attempt)
                continue
            pause = min(self.window.wait * 2 ** (attempt - 1), self.window.longest_wait)
            if attempt == self.attempts or time.monotonic() + pause >= deadline:
                del open_[number]
                yield number, (None, error, attempt)
            else:
                open_[number] = (asked, deadline, attempt + 1)
                heapq.heappush(later, (time.monotonic() + pause, number))


class Desk:
    """Asks one task's prompts: each distinct one once, and none that the log knows."""

    def __init__(self, respond: Callable[..., list[str]], window: Window, attempts: int, log: ReplyLog | None) -> None:
        self.requests = _Requests(respond, window, attempts)
        self.pages = _Pages(log) if log else None

    def answer(self, rows: list[tuple[str, ...]]) -> list[Outcome]:
        """Outcomes of one batch of rows."""
        names = [digest(row) for row in rows]
        found: dict[str, Outcome] = {}
        open_: dict[str, tuple[str, ...]] = {}
        for name, row in zip(names, rows):
            known = self.pages.get(name) if self.pages else None
            if known is not None:
                found[name] = known
            else:
                open_.setdefault(name, row)
        order = list(open_)
        for number, outcome in self.requests.run(enumerate(open_.values())):
            found[order[number]] = outcome
            if self.pages and outcome[1] is None:
                self.pages.put(order[number], outcome)
        return [found[name] for name in names]
