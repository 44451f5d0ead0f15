"""WARC archives with revisit records for payloads that another page already has."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import passes, sieve
from meterlake.sources.storage import settle, shared_folder

#: Payloads of fewer bytes are always stored.
LEAST = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolve(headers: DataFrame) -> DataFrame:
    """(digest, original) of digests that more than one page has: original is the smallest page_id.

    Only digests and ids are shuffled, counted before the shuffle, so a payload that a third of all pages have costs
    one row a task.
    """
    seen = headers.where(F.col("payload_bytes") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
    return seen.where("n > 1 and original is not null").select("digest", "original")


def _with_payload(pages: DataFrame) -> DataFrame:
    payload = F.coalesce("html", F.lit(""))
    raw = F.encode(payload, "UTF-8")
    return pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha2(raw, 256).alias("digest"))


def _record() -> Column:
    """One archive record without the two line ends that close it."""
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c, F.lit(">"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    revisit = F.col("original").isNotNull()
    clean = F.regexp_replace("url", r"[\x00-\x20]", "")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(name)),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("original").cast("string"))))).otherwise(F.lit("")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a record for every row of ``pages`` (page_id, url, html; other columns are ignored) to gzip archives.

    Of rows with equal payloads of at least LEAST bytes the one with the smallest page_id is a response and the others
    revisit it; repeated rows of that page_id are all responses. A null html is an empty payload. Rows without a
    page_id are never an original; if no row of a payload has one, all are responses. An empty table gives an empty
    archive. White space and control characters are cut out of the target URI.

    Payloads stay where they are read unless their digest may be a repeated one (a sieve of fixed size tells), so
    unique payloads are never shuffled; the others are joined to their originals.
    """
    full = _with_payload(pages)
    originals = settle(resolve(full.select("page_id", "payload_bytes", "digest")), "originals")
    key = F.xxhash64("digest")
    shared = pages.sparkSession.sparkContext.broadcast(sieve(originals.select(key.alias("k")), "k"))

    def part(repeated: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                through = passes(shared.value, b.column(b.schema.get_field_index("k")).to_numpy())
                yield b.filter(pa.array(through if repeated else ~through))

        return run

    keyed = full.withColumn("k", key)
    alone = keyed.mapInArrow(part(False), keyed.schema).withColumn("original", F.lit(None).cast("bigint"))
    maybe = keyed.mapInArrow(part(True), keyed.schema).join(originals, "digest", "left")
    other = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    maybe = maybe.withColumn("original", F.when(other & (F.col("payload_bytes") >= LEAST), F.col("original")))
    records = alone.select(_record().alias("value")).unionByName(maybe.select(_record().alias("value")))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def read_archives(spark, path: str) -> DataFrame:
    """Records of archives: record_id, type, refers_to, uri, digest, payload_bytes, payload (null for revisits).

    Archives are read as text that ends at two line ends, a stream per file; a payload that holds two line ends
    itself comes in several rows. They are joined again and cut by Content-Length, and payloads must fit their digest.
    """
    lines = spark.read.option("lineSep", "\r\n\r\n").text(path).select("value")
    return lines.mapInArrow(_parsed, "record_id string, type string, refers_to string, uri string, digest string, payload_bytes bigint, payload string")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "type", "refers_to", "uri", "digest", "payload_bytes", "payload"]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string()]
    end = b"\r\n\r\n"
    stream = bytearray()
    head: dict[str, str] | None = None
    want = 0
    for batch in batches:
        rows = []
        for value in batch.column(0).to_pylist():
            stream += value.encode() + end  # the bytes of the archive again
            while True:
                if head is None:
                    del stream[: len(stream) - len(stream.lstrip(b"\r\n"))]  # line ends too many, at the end of a file
                    cut = stream.find(end)
                    if cut < 0:
                        break
                    head = dict(x.split(": ", 1) for x in stream[:cut].decode().split("\r\n")[1:])
                    want = int(head["Content-Length"])
                    del stream[: cut + 4]
                if len(stream) < want + 4:
                    break
                payload = bytes(stream[:want])
                revisit = head["WARC-Type"] == "revisit"
                digest = head["WARC-Payload-Digest"].partition(":")[2]
                n = int(head["X-Payload-Length"])
                if stream[want : want + 4] != end or not revisit and (n != want or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"damaged record {head['WARC-Record-ID']}")
                del stream[: want + 4]
                rows.append((head["WARC-Record-ID"], head["WARC-Type"], head.get("WARC-Refers-To"), head["WARC-Target-URI"], digest, n, None if revisit else payload.decode()))
                head = None
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    if head is not None or stream.strip(b"\r\n"):
        raise ValueError("an archive ends within a record")


def deduplicated(pages: DataFrame) -> DataFrame:
    """Write archives to the shared folder and read them back."""
    path = shared_folder(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
