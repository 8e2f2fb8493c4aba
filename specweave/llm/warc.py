"""WARC archives with revisit records for repeated payloads.

Headers (identifier, payload digest and length) are shuffled by digest, not
the payloads: of records with equal payloads of at least LEAST_BYTES, that
with the largest page_id is the response and the others are revisits that
refer to it. The archives are written with fresh headers, one gzip member a
record, a file for each task; a file appears only when it is whole. Reading
gives a row for each record, with the digest of what was read.

Only headers of groups that occur more than once are joined, so a payload that
a third of the pages share costs a skewed join of slim rows, which the
adaptive planner splits; payloads move once at most, by identifier. Rows of
one page_id and payload are counted before they move, and rows without page_id
do not move at all.

Defined results: a null html is an empty payload; payloads below LEAST_BYTES
are responses; of rows with equal page_id and payload the first by url is the
response, the others revisit it; rows without page_id are responses; a null
url is left out; an empty table gives no archive and an empty result. Columns
other than page_id, url and html are not looked at.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.llm.common import small_batches
from specweave.llm.files import NewFile, open_stream
from specweave.workspace import Workspace

LEAST_BYTES = 1000
RECORDS = "page_id long, copy long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_copy long"
_DATE = "2024-01-01T00:00:00Z"


def resolve(pages: DataFrame, ws: Workspace, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, copy (1: the first of its page_id and payload; null without page_id), refers_to (null: a response)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha1(F.encode("html", "UTF-8"))})
    none = F.lit(None).cast("long")
    nameless = rows.where(F.col("page_id").isNull()).withColumns({"copy": none, "refers_to": none})
    rows = rows.where(F.col("page_id").isNotNull())
    key = ["page_id", "payload_digest"]
    headers = ws.stage(rows.groupBy(*key, "payload_bytes").agg(F.count(F.lit(1)).alias("rows"), F.min("url").alias("first")), "headers")
    large = headers.where(F.col("payload_bytes") >= least)
    originals = large.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.sum("rows").alias("all")).where("all > 1").drop("all")
    revisits = ws.stage(large.join(ws.stage(originals, "originals"), "payload_digest").select(*key, "refers_to"), "revisits")

    # rows of one page_id and payload: one for each url, with their count, then one for each again
    groups = ws.stage(headers.where("rows > 1").select(*key, "first"), "groups")
    leads = F.col("url").eqNullSafe(F.col("first"))
    several = rows.join(groups, key).withColumn("html", F.when(leads | (F.col("payload_bytes") < least), F.col("html")))
    several = several.groupBy(*key, "payload_bytes", "url", "first").agg(F.count(F.lit(1)).alias("rows"), F.first("html").alias("html"))
    several = several.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    several = several.withColumn("copy", F.when(leads & (F.col("k") == 0), 1).otherwise(2 + F.pmod(F.xxhash64("url", "k"), F.lit(1 << 62))).cast("long"))
    rows = rows.join(groups, key, "left_anti").withColumn("copy", F.lit(1).cast("long"))
    rows = rows.unionByName(several.select(rows.columns)).join(revisits, key, "left")
    own = (F.col("page_id") == F.col("refers_to")) & (F.col("copy") == 1)
    return rows.withColumn("refers_to", F.when(~own, F.col("refers_to"))).unionByName(nameless)


def record(kind: str, name: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", _DATE), *fields, ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def _name(page_id, copy) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{copy}>"


def _http(payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def _clean(url: str) -> str:
    """A header value has no line ends; per cent signs keep the value readable again."""
    return url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _read(url: str) -> str:
    return url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def write(resolved: DataFrame, folder: str) -> list[str]:
    """Writes the archives; their paths (one for each task that had rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, n = f"{folder}/part-{TaskContext.get().partitionId():05d}.warc.gz", 0
        batches = (b for b in batches if len(b))
        if (first := next(batches, None)) is None:
            return
        with NewFile(path) as out:
            out.write(record("warcinfo", f"<urn:archive:{TaskContext.get().partitionId()}>", [("Content-Type", "application/warc-fields")], b"software: specweave\r\n"))
            batch = first
            while batch is not None:
                for i in range(len(batch)):
                    page_id, copy, url, size, digest, refers, html = (batch.column(k)[i].as_py() for k in range(7))
                    copy = copy or (TaskContext.get().partitionId() << 32 | n) + 1  # without page_id: by place
                    fields = [
                        ("WARC-Target-URI", None if url is None else _clean(url)),
                        ("WARC-Payload-Digest", f"sha1:{digest}"),
                        ("WARC-Profile", None if refers is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                        ("WARC-Refers-To", None if refers is None else _name(refers, 1)),
                        ("X-Payload-Length", None if refers is None else size),
                        ("Content-Type", "application/http;msgtype=response"),
                    ]
                    block = _http((html or "").encode("utf-8", "surrogatepass")) if refers is None else b"HTTP/1.1 200 OK\r\n\r\n"
                    out.write(record("response" if refers is None else "revisit", _name(page_id, copy), fields, block))
                    n += 1
                batch = next(batches, None)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    slim = resolved.select("page_id", "copy", "url", "payload_bytes", "payload_digest", "refers_to", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"))
    return sorted(r.path for r in slim.sortWithinPartitions("page_id", "copy").mapInArrow(run, "path string, records long").collect())


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an open archive."""
    with gzip.GzipFile(fileobj=stream) as f:
        while True:
            line = f.readline()
            if not line:
                return
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            head = {}
            while (line := f.readline().rstrip(b"\r\n")):
                key, _, value = line.decode("utf-8").partition(":")
                head[key.strip().lower()] = value.strip()
            n = int(head["content-length"])
            block = f.read(n)
            if len(block) != n:
                raise ValueError("an archive ends within a record")
            yield head, block


def _number(name: str, k: int) -> int | None:
    part = name.strip("<>").split(":")[2 + k]
    return int(part) if part else None


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row for each response and revisit of the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with open_stream(path) as stream:
                    for head, block in records(stream):
                        kind = head["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        digest = head["warc-payload-digest"].partition(":")[2]
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            size = len(payload)
                            if hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"{path}: payload and digest of {head['warc-record-id']} differ")
                        else:
                            size = int(head["x-payload-length"])
                        name, refers = head["warc-record-id"], head.get("warc-refers-to")
                        url = head.get("warc-target-uri")
                        rows.append((_number(name, 0), _number(name, 1), None if url is None else _read(url), size, digest, kind, refers and _number(refers, 0), refers and _number(refers, 1)))
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return listed.mapInArrow(run, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[f.split()[0] for f in RECORDS.split(", ")])


def archive(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Writes the pages' archives to the shared folder and reads them back."""
    small_batches(pages.sparkSession)
    ws = Workspace(pages.sparkSession, "warc")
    paths = write(resolve(pages, ws, least), f"{ws.path}/archives")
    ws.drop("headers", "originals", "revisits", "groups")
    return read(pages.sparkSession, paths)
