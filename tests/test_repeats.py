"""Rows of a post that came more than once."""

import duckdb
from pyspark.sql import functions as F

from tidewatch.operators import activity
from tidewatch.plans import registry

from .oracle import connect, same

SF = "/root/testdata/sf0.001"


def test_report_counts_repeated_posts_once(spark, tmp_path):
    """A word of a post that stands in six rows counts once."""
    duckdb.connect().execute(f"COPY (SELECT e.* FROM '{SF}/events.parquet' e, range(6)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    db = connect(SF)
    db.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    same(registry.QUERIES["activity_report"](spark, str(tmp_path)).toPandas(), db.sql(registry.ORACLES["activity_report"]).df())


def test_words_by_key(spark):
    rows = [(1, "s0", "t", "glacier melts"), (1, "s0", "t", "glacier melts glacier"), (1, "s1", "t", "glacier"), (2, "s0", "t", "glacier")]
    posts = spark.createDataFrame(rows, "id long, source string, topic string, body string")
    counts = lambda **more: {r.word: r.posts for r in activity.hot_keywords(posts, F.col("body"), **more).collect()}
    assert counts() == {"glacier": 4, "melts": 2} and counts(key="id") == {"glacier": 3, "melts": 1}
