"""Landed payloads taken apart record by record: each gives a raw post or an error, so that one bad record keeps no other back.

A page that holds many records is split into their texts first, and each text is parsed alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from . import flatten

#: Where a page of a source holds its records.
PAGES = {"bluesky": ["posts"], "reddit": ["data", "children"], "github": ["items"]}
NO_JSON, NO_FIT, NO_IDENTITY, NO_SOURCE = "not a JSON object", "values of other types than expected", "neither id nor address", "no source"
#: Columns that raw posts bear besides flatten.RAW: the text of a failed record and what is wrong with it.
ERROR = "record string, message string"


def _parsed(text: Column, schema: StructType) -> Column:
    """A struct of the schema and _corrupt, the text where it doesn't fit."""
    return F.from_json(text, schema.add("_corrupt", "string") if "_corrupt" not in schema.names else schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})


def _nested(path: list[str], kind) -> StructType:
    return StructType().add(path[0], kind if len(path) == 1 else _nested(path[1:], kind))


def _message(text: Column, parsed: str) -> Column:
    """What is wrong with a record; null if nothing is."""
    # A text that is an object by itself has values of other types.
    wrong = F.when(F.try_parse_json(text).isNotNull() & F.startswith(F.ltrim(text), F.lit("{")), NO_FIT).otherwise(NO_JSON)
    return F.when(text.isNull() | F.col(f"{parsed}._corrupt").isNotNull() | F.col(parsed).isNull(), wrong)


def split_records(lines: DataFrame, source: str) -> DataFrame:
    """lines (value: a JSON document) of a source to its payload columns, a record each, with record and message; both are null if it is fine."""
    whole = StructType.fromDDL(flatten.SCHEMAS[source])
    path = PAGES.get(source)
    if path is None:
        rows = lines.filter("trim(value) <> ''").select(F.col("value").alias("text_"), _parsed(F.col("value"), whole).alias("p"))
        rows = rows.withColumn("message", _message(F.col("text_"), "p"))
        payload = [F.col(f"p.{c}").alias(c) for c in whole.names if c != "_corrupt"]
        return rows.select(*payload, F.when(F.col("message").isNotNull(), F.col("text_")).alias("record"), "message")
    element = whole
    for name in path:
        kind = element[name].dataType
        element = kind.elementType if isinstance(kind, ArrayType) else kind
    pages = lines.filter("trim(value) <> ''").select("value", _parsed(F.col("value"), _nested(path, ArrayType(StringType()))).alias("page"))
    pages = pages.withColumn("wrong", _message(F.col("value"), "page")).withColumn("texts", F.col("page." + ".".join(path)))
    texts = F.when(F.col("wrong").isNotNull(), F.array("value")).otherwise(F.col("texts"))
    rows = pages.select("wrong", F.explode(texts).alias("text_")).withColumn("text_", F.coalesce("text_", F.lit("null")))
    rows = rows.select("wrong", "text_", _parsed(F.col("text_"), StructType(list(element.fields))).alias("p"))
    rows = rows.withColumn("message", F.coalesce("wrong", _message(F.col("text_"), "p")))
    one = F.array(F.struct(*[F.col(f"p.{c}").alias(c) for c in element.names]))
    for name in reversed(path[1:]):
        one = F.struct(one.alias(name))
    return rows.select(one.alias(path[0]), F.when(F.col("message").isNotNull(), F.col("text_")).alias("record"), "message")


def raw_posts(records: DataFrame, source: str) -> DataFrame:
    """Raw posts (flatten.RAW) of split records, and the failed ones with record and message and nothing else but their source."""
    good = flatten.CONNECTORS[source](records.filter("message IS NULL").drop("record", "message"))
    kinds = [c.strip().split(" ", 1) for c in flatten.RAW.split(", ")]
    failed = records.filter("message IS NOT NULL").select(*[(F.lit(source) if c == "source" else F.lit(None)).cast(kind).alias(c) for c, kind in kinds], "record", "message")
    return good.withColumns({"record": F.lit(None).cast("string"), "message": F.lit(None).cast("string")}).unionByName(failed)


def read_posts(spark: SparkSession, source: str, path: str, stream: bool = False) -> DataFrame:
    """Raw posts and failed records of payloads as landed, a JSON document a line; as a stream of files if asked."""
    reader = spark.readStream if stream else spark.read
    return raw_posts(split_records(reader.text(path), source), source)


def told_apart(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw posts that can be normalised, and (source, record, message) of those that can't, with or without failed records among them.

    A post needs a source, and an id or an address to be known by.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    checks = [(blank("source"), NO_SOURCE), (blank("external_id") & blank("url"), NO_IDENTITY)]
    found = reduce(lambda rest, c: F.when(c[0], c[1]).otherwise(rest), reversed(checks), F.lit(None).cast("string"))
    own = [c for c in raw.columns if c not in ("record", "message")]
    text = F.to_json(F.struct(*own))
    told = raw.withColumn("wrong_", F.coalesce("message", found) if "message" in raw.columns else found)
    text = F.coalesce("record", text) if "record" in raw.columns else text
    return told.filter("wrong_ IS NULL").select(*own), told.filter("wrong_ IS NOT NULL").select("source", text.alias("record"), F.col("wrong_").alias("message"))
