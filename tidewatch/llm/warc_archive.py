"""WARC archives: a distributed writer and a sequential reader.

Each task of the writer puts its pages into one archive in the shared folder, one gzip member for
each record, and hands on the archive's place; an archive gets its name only when it is whole, so
a task that is lost or run twice leaves nothing that the reader takes. Pages with equal payloads
are found by digest; all but one become revisit records, which carry no payload.

The reader goes through an archive member by member: it inflates as it reads, frames a record by
its content length, and checks the digests of block and payload. It holds one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import load, shared_dir, written

#: The date of all records: what is written depends on the pages alone.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 16


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member with one record; a revisit has the HTTP head but no payload."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if revisit:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("WARC-Payload-Digest", _digest(payload)), ("WARC-Block-Digest", _digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def members(stream) -> Iterator[bytes]:
    """Each gzip member of a stream, inflated; the stream is read in chunks."""
    rest = b""
    while True:
        rest = rest or stream.read(CHUNK)
        if not rest:
            return
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            rest = rest or stream.read(CHUNK)
            if not rest:
                raise ValueError("the archive ends inside a record")
            out.append(unpack.decompress(rest))
            rest = unpack.unused_data if unpack.eof else b""
        yield b"".join(out)


def parse_record(record: bytes) -> dict:
    """Header fields (names in lower case) and the block of one record; checks the frame and the digests."""
    head, mark, body = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    length = int(fields["content-length"])
    block, end = body[:length], body[length:]
    if len(block) < length or end != b"\r\n\r\n":
        raise ValueError("the content length doesn't frame the record")
    http, _, payload = block.partition(b"\r\n\r\n")
    if _digest(block) != fields["warc-block-digest"]:
        raise ValueError("the block digest differs")
    if fields["warc-type"] == "response" and _digest(payload) != fields["warc-payload-digest"]:
        raise ValueError("the payload digest differs")
    return fields | {"http": http, "payload": payload}


def _number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def duplicates(pages: DataFrame, least: int) -> DataFrame:
    """(page, digest, refers_to) of the pages that revisit another one.

    Only ids and digests are grouped; largest ids are found before the shuffle.
    """
    narrow = written(pages.select(F.col("page"), F.col("digest"), F.col("size")), "digests").filter(F.col("size") >= least)
    first = narrow.groupBy("digest").agg(F.max("page").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    first = written(first.select("digest", "refers_to"), "first")
    return written(narrow.join(first, "digest").filter("page IS NULL OR page < refers_to").filter("refers_to IS NOT NULL").select("page", "digest", "refers_to").distinct(), "revisits")


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, folder: str | None = None) -> DataFrame:
    """Writes a record for each row and returns the manifest: (archive, records, bytes), one row for each archive.

    Of pages with equal payloads of at least `least` bytes, that with the largest id is a response
    and the others revisit it; rows that repeat its id are responses too, a null id counts as the
    smallest. All smaller ones are responses. A null html is an empty payload.
    """
    target = (folder or f"{shared_dir(pages.sparkSession)}/tidewatch-warc-{uuid.uuid4().hex}").rstrip("/")
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("size"))
    again = duplicates(rows, least).select(F.col("page").alias("p"), F.col("digest").alias("d"), "refers_to")
    # Ids spread evenly whatever the copies, so the records of a payload that is everywhere fill no one archive.
    joined = rows.join(again, F.col("page").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").select("page", "url", "html", "refers_to")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        stream, n, size = None, 0, 0
        for batch in batches:
            for page, url, text, refers_to in zip(batch["page"], batch["url"], batch["html"], batch["refers_to"]):
                if stream is None:
                    store, root = _store(fs, target)
                    store.create_dir(root, recursive=True)
                    name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    stream = store.open_output_stream(name + ".part", compression=None)
                record = record_bytes(None if pd.isna(page) else int(page), url, text.encode("utf-8", "replace"), None if pd.isna(refers_to) else int(refers_to))
                stream.write(record)
                n, size = n + 1, size + len(record)
        if stream is not None:
            stream.close()
            store.move(name + ".part", name)
            yield pd.DataFrame({"archive": [f"{target}/{name.rpartition('/')[2]}"], "records": [n], "bytes": [size]})

    # Integers with nulls would come as floats, which can't hold every id.
    exact = joined.select(F.col("page").cast("string").alias("page"), "url", "html", F.col("refers_to").cast("string").alias("refers_to"))
    return written(exact.mapInPandas(write, "archive string, records long, bytes long"), "manifest")


def _store(fs, path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row for each record of the archives that the manifest names.

    page_id, url, record_type, refers_to, payload_bytes and payload_digest (bare lower-case hex
    SHA-1), both of the full payload, also for a revisit; with_payload adds payload (binary, null
    for a revisit). A record that is cut or whose digests differ raises an error.
    """
    kind = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * with_payload
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_payload
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                store, path = _store(fs, archive)
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for member in members(stream):
                        r = parse_record(member)
                        length = next(int(line.split(b":")[1]) for line in r["http"].split(b"\r\n") if line.lower().startswith(b"content-length:"))
                        digest = base64.b32decode(r["warc-payload-digest"].removeprefix("sha1:")).hex()
                        payload = [r["payload"] if r["warc-type"] == "response" else None] * with_payload
                        rows.append((_number(r["warc-record-id"]), r.get("warc-target-uri"), r["warc-type"], _number(r.get("warc-refers-to")), length, digest, *payload))
                        held += len(member)
                        if len(rows) >= 5000 or with_payload and held > 1 << 25:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    spread = manifest.select("archive").repartition(max(1, manifest.count()), "archive")
    return spread.mapInArrow(read, kind)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(load(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to FROM g
"""
