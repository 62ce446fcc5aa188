"""Cool-down in a stream by the times of the firings: what is let through, and that states end."""

import pytest
from pyspark.sql import functions as F

from tidewatch.streaming import cooldown

HOUR = 3_600_000
NOON = 490_000 * HOUR  # times below are after it


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(cooldown._PROVIDER)
    cooldown.use_rocksdb(spark)
    yield
    spark.conf.set(cooldown._PROVIDER, before)


def run(spark, folder, batches, **options):
    """The firings let through by micro-batch, a batch of them a time, the query started anew for each."""
    out = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, cooldown.FIRING).withColumn("at_ms", F.col("at_ms") + NOON).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(cooldown.FIRING).parquet(f"{folder}/in")
        seen = []
        made = cooldown.cooled_down(stream, **options).writeStream.foreachBatch(lambda b, _: seen.extend((r.rule_id, r.topic, r.at_ms - NOON) for r in b.collect())).option("checkpointLocation", f"{folder}/c")
        assert made.trigger(availableNow=True).start().awaitTermination(180)
        out.append(sorted(seen, key=str))
    return out


def states(spark, folder):
    rows = spark.read.format("statestore").option("stateVarName", "last").load(f"{folder}/c")
    return {(r.rule_id, r.topic): r.at_ms - NOON for r in rows.select("key.*", F.col("value.at_ms").alias("at_ms")).collect()}


def test_firings_cool_down_and_states_end_by_event_time(spark, rocksdb, tmp_path):
    folder, half = str(tmp_path), HOUR // 2
    first = [("r", "t", 0), ("r", "t", 60_000), ("r", "t", half), ("r", "t", half), ("r", "u", 5), (None, "u", 7), ("r", "t", None)]
    second = [("r", "t", half + 1), ("r", "u", half + 5), ("r", "t", 2 * half)]
    out = run(spark, folder, [first, second])
    assert out[0] == [("r", "t", 0), ("r", "t", half), ("r", "u", 5), (None, "u", 7)]
    assert out[1] == [("r", "t", 2 * half), ("r", "u", half + 5)]
    assert states(spark, folder) == {("r", "t"): 2 * half, ("r", "u"): half + 5, (None, "u"): 7}


def test_a_state_ends_a_day_after_its_last_firing(spark, rocksdb, tmp_path):
    folder = str(tmp_path)
    out = run(spark, folder, [[("r", "old", 0), ("r", "kept", 0)], [("r", "kept", 20 * HOUR)], [("r", "new", 26 * HOUR)], [("r", "new", 27 * HOUR)]])
    assert out == [[("r", "kept", 0), ("r", "old", 0)], [("r", "kept", 20 * HOUR)], [("r", "new", 26 * HOUR)], [("r", "new", 27 * HOUR)]]
    assert states(spark, folder) == {("r", "kept"): 20 * HOUR, ("r", "new"): 27 * HOUR}


def test_what_cannot_be_kept_is_refused(spark):
    rows = spark.createDataFrame([], cooldown.FIRING)
    with pytest.raises(ValueError, match="outlive"):
        cooldown.cooled_down(rows, 10, 9)
    with pytest.raises(ValueError, match="RocksDB"):
        cooldown.cooled_down(rows)
