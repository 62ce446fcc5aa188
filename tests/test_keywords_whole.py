"""All words are counted, the rare ones too."""

from tidewatch.plans import posts_sql, registry

from .oracle import connect, same

SF = "/root/testdata/sf0.001"


def test_keyword_counts_whole(spark):
    got = registry.QUERIES["keyword_counts"](spark, SF).toPandas()
    assert got["posts"].min() == 1
    same(got, connect(SF).sql(f"WITH {posts_sql._DOCS} SELECT word, posts, sources::INT AS sources, topics::INT AS topics FROM ({posts_sql._HOT})").df())
