"""Queries return all their rows, and read all of their texts."""

from pyspark.sql import functions as F

from tidewatch.functions.text import squeeze_tags
from tidewatch.plans import registry

from .oracle import connect, same

SF = "/root/testdata/sf0.001"


def test_squeeze_tags_keeps_long_pages(spark):
    page = "<p>" + "word " * 1000 + "<b>end</b>"
    row = spark.createDataFrame([(page,)], "html string").select(squeeze_tags(F.col("html"), None).alias("whole"), squeeze_tags(F.col("html")).alias("body")).first()
    assert row.whole == "word " * 1000 + "end" and row.body == row.whole[:1500]


def test_page_texts_whole(spark):
    want = connect(SF).sql("SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS body_md5 FROM pages").df()
    same(registry.QUERIES["page_texts"](spark, SF).toPandas(), want)
