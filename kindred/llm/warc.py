"""WARC archives whose records are Zstandard frames of their own, compressed with a dictionary built from them.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, followed by one frame for each
record, so that a reader can start at any record once it has read the first frame.  Of records with equal payloads of
``MIN_REVISIT`` bytes or more, the one with the largest page id is a response and the others are revisits of it.

Archives lie in the folder that all executors share, under names that no other attempt of a task uses; only the
manifest that a finished write job committed says which of them count, so lost executors and repeated tasks leave no
trace in what is read.  A writer holds at most ``BUFFER`` bytes of records, a reader one archive of such records.

Defined results: a null html is an empty payload; a null page id is less than all others and is read back as null;
rows equal in id and payload are all responses where their id is the largest; archives of few or very small records
have no dictionary and no leading frame; an empty table writes no archive; columns other than id, url and html are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import shared_dir, table, written

MIN_REVISIT = 1000
BUFFER = 24 << 20
DICT_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
LEVEL = 3
MAGIC = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def decide(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to.

    Largest ids are found by digest with map-side combining; the join back carries no payload on its small side and
    is left to the planner, which splits a hot digest.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    copies = d.filter(F.length("payload") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first_id")
    # written, so that the join has a plain exchange on either side and a hot digest can be split
    d = d.join(written(copies, "warc-copies"), "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return d.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record; a revisit has the payload's HTTP head but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if kind == "response" else http
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}:{digest}')}>"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').translate({13: None, 10: None})}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response", f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {_REVISIT_PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Built from records spread evenly over the archive, up to SAMPLE_BYTES of them; None where there is too little."""
    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    sample = [r[: 128 << 10] for r in records[::step]]
    if len(sample) < 8 or sum(map(len, sample)) < 16 << 10:
        return None
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, sample)) // 4), sample, k=256, d=8)
    except zstandard.ZstdError:
        return None


def pack(records: list[bytes]) -> bytes:
    """The bytes of an archive."""
    trained = dictionary(records)
    out = []
    if trained is not None:
        trained.precompute_compress(level=LEVEL)
        kept = zstandard.ZstdCompressor(level=LEVEL).compress(trained.as_bytes())
        out.append(struct.pack("<II", MAGIC, len(kept)) + kept)
    c = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained) if trained is not None else zstandard.ZstdCompressor(level=LEVEL)
    out.extend(map(c.compress, records))
    return b"".join(out)


def unpack(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    at, trained, view = 0, None, memoryview(archive)
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == MAGIC:
        n = struct.unpack_from("<I", archive, 4)[0]
        trained = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(view[8 : 8 + n]))
        at = 8 + n
    d = zstandard.ZstdDecompressor(dict_data=trained) if trained is not None else zstandard.ZstdDecompressor()
    while at < len(archive):
        frame, parts = d.decompressobj(), []
        while not frame.eof:
            piece = view[at : at + 8192]
            if not piece:
                raise ValueError("archive ends within a record")
            parts.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data if frame.eof else b"")
        yield b"".join(parts)


def parse(rec: bytes) -> dict:
    """Header fields by lower-case name, with the record's block under ''."""
    head, _, rest = rec.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    fields[""] = rest[: int(fields["content-length"])]
    return fields


def write(decided: DataFrame, folder: str) -> DataFrame:
    """Writes archives below folder; path, n_records and n_bytes of each, as committed by the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)

        def put(records: list[bytes]) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{base}/{name}") as f:
                f.write(data := pack(records))
            return pa.RecordBatch.from_pydict({"path": [name], "n_records": [len(records)], "n_bytes": [len(data)]}, pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

        held, size = [], 0
        for b in batches:
            for i in range(0, b.num_rows, 64):
                for row in zip(*(c.to_pylist() for c in b.slice(i, 64).columns), strict=True):
                    held.append(record(*row))
                    size += len(held[-1])
                    if size >= BUFFER:
                        yield put(held)
                        held, size = [], 0
        if held:
            yield put(held)

    rows = decided.select("page_id", "url", "payload", "digest", "record_type", "refers_to")
    return written(rows.mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-manifest")


def read(manifest: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """One row a record: page_id, payload_bytes, payload_digest, record_type, refers_to, and the payload of responses.

    A response's digest and length are taken from its payload and held against its header; a revisit's are those of
    the payload it refers to, as its header has them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        kinds = pa.schema([("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])
        for b in batches:
            for path in b.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{path}") as f:
                    data = f.read()
                held, size = [], 0
                for rec in unpack(data):
                    r = parse(rec)
                    http, _, payload = r[""].partition(b"\r\n\r\n")
                    n = int(http.rpartition(b"Content-Length: ")[2])
                    digest = base64.b32decode(r["warc-payload-digest"].removeprefix("sha1:")).hex()
                    kind = r["warc-type"]
                    if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"record {r['warc-record-id']} does not hold the payload its header names")
                    held.append((r["x-page-id"] or None, n, digest, kind, r.get("x-refers-to-page-id"), payload if kind == "response" else None))
                    size += len(payload)
                    if size >= 4 << 20 or len(held) >= 2048:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds.types, strict=True)], schema=kinds)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds.types, strict=True)], schema=kinds)

    # an archive takes a task little time, so files are dealt out one by one
    n = max(1, min(manifest.count(), 4096))
    rows = manifest.select("path").repartition(n).mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    return rows.withColumns({"page_id": F.col("page_id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    folder = f"{shared_dir(pages.sparkSession)}/kindred/warc-{uuid.uuid4().hex}"
    manifest = write(decide(pages, id_col, url_col, html_col), folder)
    return read(manifest, folder, pages.schema[id_col].dataType.simpleString())


def op9_warc(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM m
"""
