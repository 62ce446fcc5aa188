"""Cool-down of firings as state with a clock of its own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FIRING = "rule_id string, topic string, at_ms long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CoolDown(StatefulProcessor):
    """State of a rule and topic: the time last let through. A timer ends it forget_ms later, by the time of the firings."""

    def __init__(self, cooldown_ms: int, forget_ms: int):
        self.cooldown_ms, self.forget_ms = cooldown_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get()[0] if self.last.exists() else None
        last, out = before, []
        for at in sorted(t for batch in rows for t in batch["at_ms"].tolist()):
            if last is None or at - last >= self.cooldown_ms:
                out.append(at)
                last = at
        if not out:
            return
        if before is not None:
            self.handle.deleteTimer(before + self.forget_ms)
        self.last.update((last,))
        self.handle.registerTimer(last + self.forget_ms)
        yield pd.DataFrame({"rule_id": [key[0]] * len(out), "topic": [key[1]] * len(out), "at_ms": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """For streams started from now on; states with timers need it."""
    spark.conf.set(_PROVIDER, ROCKSDB)


def cooled_down(firings: DataFrame, cooldown_ms: int = 1_800_000, forget_ms: int = 86_400_000, delay: str = "1 hour") -> DataFrame:
    """Of firings (rule_id, topic, at_ms) those that come a cool-down after the last one let through, by the times of the firings.

    Firings of a micro-batch are taken by time; equal ones count once. Those that come more than `delay` behind the
    newest one are dropped, and so are those without a time or one before 1970. A state ends forget_ms after its last firing, so
    forget_ms is at least the cool-down.
    """
    if forget_ms < cooldown_ms:
        raise ValueError("a state must outlive its cool-down")
    if firings.sparkSession.conf.get(_PROVIDER) != ROCKSDB:
        raise ValueError("states with timers are kept in RocksDB: call use_rocksdb(spark) first")
    timed = firings.filter("at_ms IS NOT NULL").select("rule_id", "topic", "at_ms", F.timestamp_millis("at_ms").alias("at")).withWatermark("at", delay)
    return timed.groupBy("rule_id", "topic").transformWithStateInPandas(CoolDown(cooldown_ms, forget_ms), FIRING, "Append", "EventTime")
