"""WARC archives: writing, normalising one gzip stream into members, and reading back.

An archive is a row ``archive_id, blob``, so any table format that Spark writes can hold it
and a lost executor only repeats its tasks; ``export_files`` puts the blobs out as files.
The writer makes one gzip stream of a whole archive. The normaliser inflates such a stream
once, front to back, and writes each record as a gzip member of its own, with an index of
offsets by which the reader then opens single records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylink.llm.common import read, stored

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
ARCHIVE_BYTES = 8 << 20
LEVEL = 4
MIN_REVISIT_BYTES = 0

ARCHIVES = "archive_id string, blob binary"
NORMALISED = "archive_id string, blob binary, index array<struct<offset: bigint, length: bigint, record_id: string, record_type: string>>"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, archive_id string, offset bigint"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, as WARC digests are written."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{payload_digest}')}>"


def _line(value: str) -> str:
    """A header value without control characters (they are percent-encoded)."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed record. A revisit keeps the HTTP header and leaves the payload out."""
    sha = digest(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if revisit else payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, sha)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", _line(url)))
    if page_id is not None:
        head.append(("WARC-Page-ID", str(page_id)))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, sha)), ("WARC-Refers-To-Page-ID", str(refers_to))]
    head += [("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in head), b"", b""]) + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode("utf-8", "replace").split("\r\n")[1:])}


def records_of(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Cut a stream of inflated bytes into whole records; at most one record is held."""
    held = bytearray()
    done = False
    while True:
        end = held.find(b"\r\n\r\n")
        size = end + 4 + int(_headers(bytes(held[:end]))["content-length"]) + 4 if end >= 0 else None
        if size is not None and len(held) >= size:
            yield bytes(held[:size])
            del held[:size]
            continue
        if done:
            if held.strip():
                raise ValueError("the archive ends within a record")
            return
        more = next(stream, None)
        done = more is None
        held += more or b""


def inflate(blob: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Inflate a gzip stream of one or more members, a bounded piece at a time."""
    rest = blob
    while rest:
        z = zlib.decompressobj(31)
        while not z.eof:
            piece = z.decompress(rest, step)
            rest = z.unconsumed_tail
            if piece:
                yield piece
            elif not rest and not z.eof:
                raise ValueError("the gzip stream is cut short")
        rest = z.unused_data


def parse(raw: bytes) -> dict:
    """The fields of a record. A response's length and digest come from its payload, a revisit's from its headers."""
    end = raw.index(b"\r\n\r\n") + 4
    head = _headers(raw[: end - 4])
    block = raw[end : end + int(head["content-length"])]
    at = block.index(b"\r\n\r\n") + 4
    page, refers = head.get("warc-page-id"), head.get("warc-refers-to-page-id")
    revisit = head["warc-type"] == "revisit"
    http = _headers(block[: at - 4])
    sha = head["warc-payload-digest"].removeprefix("sha1:") if revisit else digest(block[at:])
    if not revisit and f"sha1:{sha}" != head["warc-payload-digest"]:
        raise ValueError(f"the payload of {head['warc-record-id']} has another digest")
    return {
        "page_id": None if page is None else int(page), "url": head.get("warc-target-uri"), "payload_bytes": int(http["content-length"]) if revisit else len(block) - at,
        "payload_digest": sha, "record_type": head["warc-type"], "refers_to": int(refers) if refers not in (None, "None") else None, "record_id": head["warc-record-id"], "payload": None if revisit else block[at:],
    }


def with_revisits(pages: DataFrame, page_id: str = "page_id", payload: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``pages`` as ``page_id, url, payload, refers_to``: which record each repeat refers to.

    Only digests are shuffled, one row for each digest and task. The digests that repeat are
    written and joined back; Spark broadcasts them if their table is small and else deals
    both sides by digest, with hot digests split.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url"), body.alias("payload"))
    key = F.when(F.octet_length("payload") >= min_bytes, F.sha1("payload"))
    first = p.select(key.alias("sha"), "page_id").filter("sha is not null").groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = stored(first.filter("n > 1").select("sha", "first"), "repeated-payloads")
    marked = p.withColumn("key", key).join(first, F.col("key") == F.col("sha"), "left")
    return marked.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(marked: DataFrame, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Archives of one gzip stream each; a new one starts when ``archive_bytes`` of records are in."""

    def run(batches):
        from pyspark import TaskContext

        part, n, size, z, out = TaskContext.get().partitionId(), 0, 0, None, []
        for batch in batches:
            for page, url, body, refers in zip(*(batch.column(i) for i in range(4)), strict=True):
                raw = record(page.as_py(), url.as_py(), body.as_py(), refers.as_py(), refers.is_valid)
                z = z or zlib.compressobj(level, zlib.DEFLATED, 31)
                out.append(z.compress(raw))
                size += len(raw)
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_pydict({"archive_id": [f"{part:06d}-{n:06d}"], "blob": [b"".join([*out, z.flush()])]})
                    n, size, z, out = n + 1, 0, None, []
        if z:
            yield pa.RecordBatch.from_pydict({"archive_id": [f"{part:06d}-{n:06d}"], "blob": [b"".join([*out, z.flush()])]})

    return marked.select("page_id", "url", "payload", "refers_to").mapInArrow(run, ARCHIVES)


def normalise(archives: DataFrame, level: int = LEVEL) -> DataFrame:
    """Each record as its own gzip member, and the sidecar index of the members' offsets."""

    def run(batches):
        schema = pa.schema([("archive_id", pa.string()), ("blob", pa.binary()), ("index", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())])))])
        for batch in batches:
            for name, blob in zip(batch.column(0), batch.column(1), strict=True):
                out, index, at = [], [], 0
                for raw in records_of(inflate(blob.as_py())):
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = z.compress(raw) + z.flush()
                    head = _headers(raw[: raw.index(b"\r\n\r\n")])
                    index.append({"offset": at, "length": len(member), "record_id": head["warc-record-id"], "record_type": head["warc-type"]})
                    out.append(member)
                    at += len(member)
                yield pa.RecordBatch.from_pydict({"archive_id": [name.as_py()], "blob": [b"".join(out)], "index": [index]}, schema=schema)

    return archives.select("archive_id", "blob").mapInArrow(run, NORMALISED)


def read_records(normalised: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record, each opened by its offset in the index."""
    names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * with_payload

    def run(batches):
        ints = {"page_id", "payload_bytes", "refers_to", "offset"}
        schema = pa.schema([(n, pa.int64() if n in ints else pa.binary() if n == "payload" else pa.string()) for n in names])
        for batch in batches:
            for name, blob, index in zip(*(batch.column(i) for i in range(3)), strict=True):
                data, rows = blob.as_py(), []
                for x in index.as_py():
                    raw = zlib.decompress(data[x["offset"] : x["offset"] + x["length"]], 31)
                    rows.append(parse(raw) | {"archive_id": name.as_py(), "offset": x["offset"]})
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in rows], schema=schema)

    return normalised.select("archive_id", "blob", "index").mapInArrow(run, RECORDS + ", payload binary" * with_payload)


def export_files(normalised: DataFrame, uri: str) -> None:
    """Write ``<archive_id>.warc.gz`` and its index ``<archive_id>.cdxj`` under a folder of any store pyarrow reaches."""

    def run(batches):
        import json

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        store.create_dir(base)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_output_stream(f"{base}/{row['archive_id']}.warc.gz", compression=None) as f:
                    f.write(row["blob"])
                with store.open_output_stream(f"{base}/{row['archive_id']}.cdxj") as f:
                    f.write("".join(json.dumps(x) + "\n" for x in row["index"]).encode())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    normalised.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def archive(pages: DataFrame, page_id: str = "page_id", payload: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write a record for each page, normalise the archives, store them, and read them back.

    Of records with equal payloads of at least ``min_bytes`` the smallest page id is the
    response and the others revisit it; shorter payloads are all responses. A null payload
    is empty. A null id is a record without an id, and revisits unless no equal record has
    an id. Repeated rows with the smallest id are all responses. A null url is left out;
    control characters in urls are percent-encoded. Extra columns are ignored.
    """
    return read_records(stored(normalise(write_archives(with_revisits(pages, page_id, payload, min_bytes))), "warc"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through WARC archives and back."""
    return archive(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
