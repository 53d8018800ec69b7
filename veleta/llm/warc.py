"""WARC records as a chunked record table (operator 4).

An archive is a Parquet file whose rows are slices of WARC/1.1 records: the data of a record's rows in the order of
chunk_no, and of an archive's records one after the other, are the bytes of a WARC file. Payloads are cut to rows before
they reach Python, so that no task there holds a whole record; digests are carried from row to row.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 65_536
REVISIT_FROM = 0  # least payload bytes of a record that may be a revisit
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"

CHUNKS = "record_no LONG, chunk_no INT, chunks INT, running_digest STRING, data BINARY"
RECORDS = "page_id STRING, payload_bytes LONG, payload_digest STRING, record_type STRING, refers_to STRING"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def record_id(page_id: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _present(value) -> bool:
    return value is not None and value == value


def header(page_id, url, record_type: str, refers_to, size: int, digest: str) -> bytes:
    """Record header, and the HTTP header that opens its block. A revisit's block holds nothing else."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode("ascii")
    length = len(http) + (size if record_type == "response" else 0)
    fields = [("WARC-Type", record_type), ("WARC-Record-ID", record_id(page_id if _present(page_id) else None)), ("WARC-Date", DATE)]
    if _present(url):
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if _present(page_id):
        fields.append(("WARC-Page-ID", page_id))
    if record_type == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("WARC-Refers-To-Page-ID", refers_to)]
    fields += [
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(length)),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8") + b"\r\n" + http


def _written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of the archive. The rows of a record come one after the other, so one running digest is enough."""
    running = hashlib.sha1()
    for batch in batches:
        data, digests = [], []
        for r in batch.itertuples(index=False):
            part = bytes(r.part) if r.part is not None else b""
            out = b""
            if r.chunk_no == 0:
                running = hashlib.sha1()
                out = header(r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, base32(bytes.fromhex(r.digest)))
            running.update(part)
            digests.append(base32(running.digest()))
            data.append(out + part + (END if r.chunk_no == r.chunks - 1 else b""))
        yield pd.DataFrame(
            {"record_no": batch["record_no"], "chunk_no": batch["chunk_no"], "chunks": batch["chunks"], "running_digest": digests, "data": data}
        )


def write_archives(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, revisit_from: int = REVISIT_FROM) -> None:
    """Write a record per page. Of equal payloads, the smallest page_id has the response and others revisit it.

    A null html is an empty payload, a null url leaves out its field. Pages with a null id are the response only where no
    page of the same payload has an id. Repeated rows of the smallest page_id are all responses, with one record id.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({"digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    repeated = (
        rows.filter(F.col("payload_bytes") >= revisit_from).groupBy("digest")
        .agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    )
    revisits = F.coalesce(F.col("first_page") != F.col("page_id"), F.col("first_page").isNotNull())
    told = rows.join(repeated, "digest", "left").select(
        F.monotonically_increasing_id().alias("record_no"), F.col("page_id").cast("string").alias("page_id"), "url", "digest", "payload_bytes",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("first_page").cast("string")).alias("refers_to"),
        F.when(~revisits, F.col("payload")).alias("payload"),
    )
    last = F.coalesce(F.floor((F.octet_length("payload") - 1) / F.lit(chunk_bytes)).cast("int"), F.lit(0))
    parts = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(F.col("payload"), i * chunk_bytes + 1, F.lit(chunk_bytes)))
    kept = ["record_no", "page_id", "url", "digest", "payload_bytes", "record_type", "refers_to"]
    chunks = told.select(*kept, parts.alias("parts")).select(*kept, F.size("parts").alias("chunks"), F.posexplode("parts").alias("chunk_no", "part"))
    chunks.mapInPandas(_written, CHUNKS).write.option("compression", "zstd").parquet(path)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines if line)


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per record. Rows come in the order of chunk_no; only the current one is held."""
    for batch in batches:
        out = []
        for number, chunks, data in zip(batch["chunk_no"], batch["chunks"], batch["data"]):
            data = bytes(data)
            if number == 0:
                head, rest = data.split(END, 1)
                fields = _fields(head)
                http, data = rest.split(END, 1)
                size = int(_fields(http)["Content-Length"])
                told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                running, seen = hashlib.sha1(), 0
            if number == chunks - 1:
                if not data.endswith(END):
                    raise ValueError(f"record of page {fields.get('WARC-Page-ID')} has no end")
                data = data[: -len(END)]
            running.update(data)
            seen += len(data)
            if number < chunks - 1:
                continue
            kind = fields["WARC-Type"]
            if kind == "response" and (seen != size or base32(running.digest()) != told):
                raise ValueError(f"payload of page {fields.get('WARC-Page-ID')} is damaged")
            out.append((fields.get("WARC-Page-ID"), size, told, kind, fields.get("WARC-Refers-To-Page-ID")))
        yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Read the records back: digests and sizes of responses are taken from their payloads anew and must agree.

    Records of one row are read where they lie; rows of larger ones are brought together and sorted first.
    """
    rows = spark.read.schema(CHUNKS).parquet(path).select("record_no", "chunk_no", "chunks", "data")
    single = rows.filter("chunks = 1").mapInPandas(_parsed, RECORDS)
    large = rows.filter("chunks > 1").repartition("record_no").sortWithinPartitions("record_no", "chunk_no").mapInPandas(_parsed, RECORDS)
    both = single.unionByName(large)
    return both.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


def export_archive(spark: SparkSession, path: str) -> Iterator[bytes]:
    """The bytes of one WARC file holding all records, row by row; the driver holds one partition at a time."""
    for row in spark.read.schema(CHUNKS).parquet(path).orderBy("record_no", "chunk_no").select("data").toLocalIterator():
        yield bytes(row["data"])


def round_trip(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Write the archives and read them: page_id, payload_bytes, payload_digest, record_type and refers_to per page.

    An empty table gives no rows.
    """
    write_archives(pages, path, chunk_bytes, revisit_from)
    return read_archives(pages.sparkSession, path)
