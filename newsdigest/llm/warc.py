"""Operator 6, WARC archives with revisit resolution.

Headers (page id, url, payload digest and size) are shuffled by digest; in each group of equal payloads the page with
the largest id stays the response and the others become revisit records that refer to it.  A digest's headers are joined
in parts, so that one with very many pages is not one task's.

Archives are ``.warc.gz`` files: a warcinfo record first, a gzip member for every record, headers made anew with the time
of writing.  Tasks write them into the shared folder, a new one after ``most_bytes``; a manifest that Spark writes names
the files of the tasks that counted, so a task that is lost or runs twice leaves nothing that is read.  They are read back
as streams, record by record by their Content-Length.

Defined results: a null html is an empty payload; a null page id never is the response of another page and is a
revisit if its group has an id; rows that repeat the largest id of a group are all responses; rows equal in id, payload
and kind share their record id; null or odd urls write no or an escaped target header; an empty table writes no record;
other columns are not read.
"""

from __future__ import annotations

import datetime as dt
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EOL = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes of an archive after which the next one begins.
MOST_BYTES = 128 << 20
#: Parts of a digest's headers in the join.
PARTS = 32
_FIELDS = T.StructType([T.StructField("page_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()),
                        T.StructField("target_uri", T.StringType()), T.StructField("refers_to", T.StringType()),
                        T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
                        T.StructField("intact", T.BooleanType()), T.StructField("payload", T.BinaryType())])


def revisits(heads: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, payload_digest, response_id, response_url) of the pages that repeat another page's payload."""
    large = heads.filter(F.col("payload_bytes") >= least_bytes)
    groups = (large.groupBy("payload_digest").agg(F.max(F.struct("page_id", "url")).alias("response"), F.count(F.lit(1)).alias("n"))
              .filter("n > 1 AND response.page_id IS NOT NULL")
              .select("payload_digest", F.col("response.page_id").alias("response_id"), F.col("response.url").alias("response_url"),
                      F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")))
    parted = large.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS)).cast("int"))
    return (parted.join(groups, ["payload_digest", "part"]).filter("page_id IS NULL OR page_id < response_id")
            .groupBy("page_id", "payload_digest").agg(F.max(F.struct("response_id", "response_url")).alias("r"))
            .select("page_id", "payload_digest", "r.response_id", "r.response_url"))


def record_urn(kind: str, page_id: str | None, digest: str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{kind} {page_id} {digest}").urn


def record(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record; fields without a value are left out, and line ends in a value are escaped."""
    out = [b"WARC/1.1", b"WARC-Type: " + kind.encode()]
    for name, value in [*fields, ("Content-Length", str(len(block)))]:
        if value is not None:
            out.append(f"{name}: ".encode() + value.replace("\r", "%0D").replace("\n", "%0A").encode("utf-8", "surrogatepass"))
    return EOL.join([*out, b"", block]) + EOL * 2


def page_record(page_id: str | None, url: str | None, payload: bytes, response_id: str | None, response_url: str | None, date: str) -> bytes:
    digest, again = hashlib.sha1(payload).hexdigest(), response_id is not None
    kind = "revisit" if again else "response"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return record(kind, [
        ("WARC-Record-ID", f"<{record_urn(kind, page_id, digest)}>"), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Page-ID", page_id),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Refers-To", f"<{record_urn('response', response_id, digest)}>" if again else None), ("WARC-Refers-To-Page-ID", response_id),
        ("WARC-Refers-To-Target-URI", response_url if again else None), ("WARC-Refers-To-Date", date if again else None),
        ("WARC-Profile", REVISIT_PROFILE if again else None), ("Content-Type", "application/http; msgtype=response")],
        http if again else http + payload)


def _open_folder(path: str) -> tuple[files.FileSystem, str]:
    return (files.LocalFileSystem(), path.removeprefix("file:")) if path.startswith(("file:", "/")) else files.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 1000, date: str | None = None, most_bytes: int = MOST_BYTES) -> None:
    """Write one record per row into archives below ``path``, which all executors can reach; ``date`` (of the records) is the time
    of the call unless given."""
    date = date or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    text = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    url = F.col("url").cast("string")
    heads = pages.select("page_id", url.alias("url"), F.sha1(text).alias("payload_digest"), F.octet_length(text).cast("long").alias("payload_bytes"))
    again = revisits(heads, least_bytes).select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"),
                                                F.col("response_id").cast("string").alias("response_id"), "response_url")
    rows = pages.select("page_id", url.alias("url"), text.alias("payload"), F.sha1(text).alias("digest"))
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    rows = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "response_id", "response_url")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder, base = _open_folder(path)
        folder.create_dir(base, recursive=True)
        out, name, size, n = None, "", 0, 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = folder.open_output_stream(f"{base}/{name}", compression=None)
                    head = record("warcinfo", [("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", date), ("WARC-Filename", name),
                                               ("Content-Type", "application/warc-fields")], b"software: newsdigest\r\nformat: WARC File Format 1.1\r\n")
                    size += out.write(gzip.compress(head, 6, mtime=0))
                page, url, response, response_url = (v if isinstance(v, str) else None for v in (row.page_id, row.url, row.response_id, row.response_url))
                size += out.write(gzip.compress(page_record(page, url, bytes(row.payload), response, response_url, date), 6, mtime=0))
                n += 1
                if size >= most_bytes:
                    out.close()
                    out = None
                    yield pd.DataFrame({"name": [name], "records": [n], "bytes": [size]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"name": [name], "records": [n], "bytes": [size]})

    rows.mapInPandas(run, "name string, records long, bytes long").write.parquet(f"{path}/manifest")


def parse_archive(stream) -> Iterator[dict]:
    """The records of one archive, a readable binary file, in order; sizes come from the headers, never from the payload's text."""
    with gzip.GzipFile(fileobj=stream) as f:
        while line := f.readline():
            if not line.strip():
                continue
            head = {}
            while (line := f.readline()).strip():
                name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
                head[name.lower()] = value.strip()
            block = f.read(int(head["content-length"]))
            if head["warc-type"] not in ("response", "revisit"):
                continue
            http, _, payload = block.partition(b"\r\n\r\n")
            stated = int(http.rpartition(b"Content-Length:")[2])
            digest = head["warc-payload-digest"].removeprefix("sha1:")
            full = head["warc-type"] == "response"
            yield {"page_id": head.get("warc-page-id"), "record_type": head["warc-type"], "record_id": head["warc-record-id"].strip("<>"),
                   "target_uri": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to-page-id"),
                   "payload_digest": digest, "payload_bytes": stated,
                   "intact": len(payload) == stated and hashlib.sha1(payload).hexdigest() == digest if full else not payload,
                   "payload": payload if full else None}


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per page record of the archives that the manifest names; ``intact`` tells that digest and size hold for what was
    read.  An archive is read as a stream, so it needs no room as a whole."""
    named = spark.read.schema("name string").parquet(f"{path}/manifest")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder, base = _open_folder(path)
        columns, rows, size = [f.name for f in _FIELDS], [], 0
        for batch in batches:
            for name in batch["name"]:
                with folder.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for found in parse_archive(stream):
                        if not payload:
                            found["payload"] = None
                        rows.append(found)
                        size += len(found["payload"] or b"") + 300
                        if size > 1 << 22:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return named.repartition("name").mapInPandas(run, _FIELDS)


def archived_pages(spark: SparkSession, path: str, id_type: T.DataType) -> DataFrame:
    """The archives' records as pages: page_id, payload_bytes, payload_digest, record_type, refers_to, intact."""
    number = lambda c: F.expr(f"try_cast({c} AS {id_type.simpleString()})")          # noqa: E731
    return read_archives(spark, path, payload=False).select(
        number("page_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "intact")
