"""What running streams tell: each batch's progress goes to those who subscribed and to a short memory."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

UPDATE = "query string, name string, event string, batch long, at timestamp, rows long, rows_per_second double, state_rows long, watermark timestamp, message string"


def _moment(text: str | None) -> datetime | None:
    return datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(timezone.utc) if text else None


class Updates(StreamingQueryListener):
    """Rows of UPDATE for the events started, progress, idle and terminated; the newest `keep` stay.

    A subscriber that fails keeps none of the others from their update.
    """

    def __init__(self, keep: int = 1000):
        self._rows: deque[tuple] = deque(maxlen=keep)
        self._told: list[Callable[[dict], None]] = []
        self._lock = threading.Lock()
        self._names: dict[str, str | None] = {}
        self.failures: deque[Exception] = deque(maxlen=keep)

    def subscribe(self, told: Callable[[dict], None]) -> Callable[[], None]:
        """told gets each update as a dict; what is returned ends it."""
        with self._lock:
            self._told.append(told)

        def end() -> None:
            with self._lock:
                if told in self._told:
                    self._told.remove(told)

        return end

    def _tell(self, query, name, event, at, batch=None, rows=None, rate=None, state=None, watermark=None, message=None) -> None:
        row = (str(query), name, event, batch, at, rows, rate, state, watermark, message)
        with self._lock:
            self._rows.append(row)
            told = list(self._told)
        names = [c.strip().split(" ")[0] for c in UPDATE.split(",")]
        for one in told:
            try:
                one(dict(zip(names, row)))
            except Exception as failed:  # noqa: BLE001 - kept for whoever asks
                self.failures.append(failed)

    def onQueryStarted(self, event) -> None:
        self._names[str(event.id)] = event.name
        self._tell(event.id, event.name, "started", _moment(event.timestamp))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        state = sum(s.numRowsTotal for s in p.stateOperators) if p.stateOperators else None
        mark = _moment((p.eventTime or {}).get("watermark"))
        self._tell(p.id, p.name, "progress", _moment(p.timestamp), p.batchId, p.numInputRows, p.processedRowsPerSecond, state, mark)

    def onQueryIdle(self, event) -> None:
        self._tell(event.id, self._names.get(str(event.id)), "idle", _moment(event.timestamp))

    def onQueryTerminated(self, event) -> None:
        name = self._names.pop(str(event.id), None)
        self._tell(event.id, name, "terminated", datetime.now(timezone.utc), message=event.exception)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The updates in memory, `keep` at most."""
        with self._lock:
            rows = list(self._rows)
        return spark.createDataFrame(rows, UPDATE)


@contextmanager
def listening(spark: SparkSession, keep: int = 1000):
    """Updates of all streams of the session within the block."""
    updates = Updates(keep)
    spark.streams.addListener(updates)
    try:
        yield updates
    finally:
        spark.streams.removeListener(updates)
