"""Streams with state a key that lives by the clock: first jobs of idempotency keys, and delayed retries.

Both use transformWithState, which needs the RocksDB state store
(spark.sql.streaming.stateStore.providerClass). State and timers are in the checkpoint, so they outlive a restart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from loam.operators.telemetry import kind_of

#: Milliseconds before the second attempt, the most before any, and attempts at most.
BASE, MOST, ATTEMPTS = 200, 30_000, 5


class _First(StatefulProcessor):
    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.job = handle.getValueState("job", "job string", self.ttl_ms or None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        for job in sorted((r.job for r in rows), key=lambda j: (j is None, j)):
            if key[0] is None:
                yield Row(key=None, job=job, first=job, repeated=False)
                continue
            held = self.job.get()[0] if self.job.exists() else None
            if held is None and job is not None:
                self.job.update((job,))
            yield Row(key=key[0], job=job, first=held or job, repeated=held is not None)

    def close(self) -> None:
        pass


def first_jobs(stream: DataFrame, ttl_ms: int) -> DataFrame:
    """key, job, first, repeated of requests (key, job): a key that came before gets the job that it got then, whenever the request
    comes, until ttl_ms after its first (0: for ever). Of requests of one batch the smallest job is first; a request without a key is always its own."""
    rows = stream.select(F.col("key").cast("string"), F.col("job").cast("string"))
    return rows.groupBy("key").transformWithState(_First(ttl_ms), "key string, job string, first string, repeated boolean", "append", "ProcessingTime")


def delay_ms(id: str, attempt: int, base: int = BASE, most: int = MOST) -> int:
    """Doubled from attempt to attempt up to `most`; then between a half and all of it, by a hash, so that rows that failed together come back apart."""
    full = min(base * 2 ** (attempt - 1), most)
    return int(full / 2 + full / 2 * int.from_bytes(hashlib.sha256(f"{id}:{attempt}".encode()).digest()[:4]) / 2**32)


class _Retry(StatefulProcessor):
    def __init__(self, work: Callable[[str], str], attempts: int, base: int, most: int) -> None:
        self.work, self.attempts, self.base, self.most = work, attempts, base, most

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "payload string, attempts int, due long")

    def _tried(self, id: str, payload: str | None, attempt: int, now: int) -> Row:
        made = {"id": id, "result": None, "error": None, "attempts": attempt, "due": None}
        try:
            return Row(**made | {"status": "indexed", "result": self.work(payload)})
        except Exception as e:  # noqa: BLE001 - whatever the work raises is the row's outcome
            made["error"] = str(e) or type(e).__name__
            if kind_of(e) == "fatal" or attempt >= self.attempts:
                return Row(**made | {"status": "dead_lettered"})
        due = now + max(1, delay_ms(id, attempt, self.base, self.most))
        self.waiting.update((payload, attempt, due))
        self.handle.registerTimer(due)
        return Row(**made | {"status": "waiting", "due": due})

    def _forgotten(self) -> None:
        if self.waiting.exists():
            self.handle.deleteTimer(self.waiting.get()[2])
            self.waiting.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for row in rows:
            self._forgotten()
            yield self._tried(key[0], row.payload, 1, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.waiting.exists():
            payload, attempts, due = self.waiting.get()
            if due <= expiredTimerInfo.getExpiryTimeInMs():
                self.waiting.clear()
                yield self._tried(key[0], payload, attempts + 1, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def retrying(stream: DataFrame, work: Callable[[str], str], attempts: int = ATTEMPTS, base_ms: int = BASE, most_ms: int = MOST) -> DataFrame:
    """id, status, result, error, attempts, due of every attempt at work(payload) for rows (id, payload): indexed; waiting (until due,
    when a timer makes the next attempt); or dead_lettered: at once where telemetry.kind_of calls the error fatal, else after the last
    attempt. A row that comes again while it waits starts anew with its new payload."""
    rows = stream.select(F.col("id").cast("string"), F.col("payload").cast("string"))
    return rows.groupBy("id").transformWithState(_Retry(work, attempts, base_ms, most_ms), "id string, result string, error string, attempts int, due long, status string", "append", "ProcessingTime")
