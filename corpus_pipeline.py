"""The corpus pipeline: five stages from raw documents to encoded texts.

Each stage reads all that its predecessor kept, which is written as Parquet between them, and all
but the last return the columns of documents: quality rules drop rejected texts, the n-gram
Jaccard join keeps one text of each group of near copies, decontamination drops texts that hold
benchmark windows, the secret scan replaces what it reports, and the last stage encodes and decodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm.bpe_codec import bpe_encode
from tidewatch.llm.common import live_folders, load, release, release_since, written
from tidewatch.llm.decontaminate import drop_contaminated
from tidewatch.llm.jaccard_join import drop_near_copies
from tidewatch.llm.quality_rules import keep_passing
from tidewatch.llm.secret_scan import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that pass the fixed rules and the fences of their language and source.

    Null and empty texts go, since they have no 50 words; a null language or source is a group of its
    own. Repeated rows stay or go together, a value equal to its fence stays, no rows give no rows, and
    all columns of docs are kept, whatever their names.
    """
    return keep_passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group of linked texts: the one with the least id, nulls last.

    Of repeated rows and of ties in the id one stays. Texts without words, null ones too, all stay. No rows
    give no rows, and all columns of docs are kept, whatever their names.
    """
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs whose text holds no window of a benchmark item.

    Null and empty texts stay; repeated rows stay or go together. An empty benchmark drops none. All columns
    of docs are kept, whatever their names.
    """
    return drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of docs, each reported span of the text replaced by the name of its kind in angle brackets.

    Null texts stay null, and empty ones empty; a null source is an owner of its own. Repeated rows are
    changed alike, and spans that overlap are replaced together. All columns of docs are kept.
    """
    return redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of all rows of docs.

    A null text is encoded as an empty one, which has no tokens. Repeated rows are encoded alike, no rows
    give no rows, and columns of docs other than these three are left out.
    """
    return bpe_encode(docs.select("doc_id", "lang", "source", "text"), digests=True).select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality_rules", quality), ("jaccard_join", near_duplicates), ("decontaminate", decontamination), ("secret_scan", secrets), ("bpe_codec", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has written, and what it read, is deleted when its result is written."""
    docs, read = load(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        before = live_folders()
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
            release_since(spark, before, (docs,))
            if read is not None:
                release(read)
            read = docs
    return docs


#: The last stage has no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
