"""WARC archives: pages written with one gzip member a record, and a sequential reader.

Of pages with equal payloads of at least ``LEAST_REVISIT`` bytes, that with the smallest page_id is a response and the others are revisits, which
carry no payload but its digest, its length and the id they refer to.  Pages tied on the smallest page_id are all responses, null page_ids count as the
largest, and smaller payloads are all responses.

The reader goes through a file once, feeds blocks of ``READ_BLOCK`` bytes to one decompressor a member, frames header and content by
Content-Length, and verifies the block digest of every record and the payload digest of every response.  Its memory is one record and one block.

Null html counts as empty.  Null urls are written as an empty target.  Repeated rows give records of their own; no rows give no file.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage

LEAST_REVISIT, READ_BLOCK, FILE_BYTES = 100, 1 << 16, 256 << 20
#: Fixed value: records need a date; pages have none.
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_MARK = "WARC-Page-"


def record_id(page_id: int | None) -> str:
    return f"<urn:kinfold:page:{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, level: int = 6) -> bytes:
    """One gzip member."""
    digest = hashlib.sha256(payload).hexdigest()
    block = HTTP if revisit else HTTP + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Payload-Digest: sha256:{digest}",
        "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(), "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
        f"{_MARK}Id: {'' if page_id is None else page_id}", f"{_MARK}Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"{_MARK}Refers-To: {refers_to}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class BadRecord(ValueError):
    """What the archive holds breaks the format or a digest."""


def members(stream, block: int = READ_BLOCK) -> Iterator[Iterator[bytes]]:
    """For each gzip member its decompressed pieces; a member must be used up before the next is asked for."""
    left = b""
    while True:
        left = left or stream.read(block)
        if not left:
            return
        machine, state = zlib.decompressobj(31), [left]

        def pieces(machine=machine, state=state) -> Iterator[bytes]:
            while not machine.eof:
                data = machine.unconsumed_tail or state[0] or stream.read(block)
                state[0] = b""
                if not data:
                    raise BadRecord("the file ends within a member")
                piece = machine.decompress(data, 1 << 20)
                if piece:
                    yield piece

        yield pieces()
        if not machine.eof:
            raise BadRecord("a member was left unread")
        left = machine.unused_data


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, in order."""
    for pieces in members(stream):
        have = bytearray()
        while (at := have.find(b"\r\n\r\n")) < 0:
            piece = next(pieces, None)
            if piece is None:
                raise BadRecord("a record has no end of its header")
            have += piece
        lines = bytes(have[:at]).decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise BadRecord("a record begins otherwise than WARC/")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(headers["content-length"])
        del have[: at + 4]
        for piece in pieces:
            have += piece
            if len(have) > length + 4:
                break
        if len(have) != length + 4 or have[length:] != b"\r\n\r\n":
            raise BadRecord("content doesn't end where Content-Length says")
        yield headers, bytes(have[:length])


def verified(headers: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None, bytes]:
    """(page_id, payload bytes, digest, type, refers_to, payload) once the digests hold."""
    if base64.b32encode(hashlib.sha1(block).digest()).decode() != headers["warc-block-digest"].partition(":")[2]:
        raise BadRecord("a block's digest is wrong")
    kind, digest, mark = headers["warc-type"], headers["warc-payload-digest"].partition(":")[2], _MARK.lower()
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    size = int(headers[f"{mark}payload-length"])
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise BadRecord("a payload's digest or length is wrong")
    own, other = headers[f"{mark}id"], headers.get(f"{mark}refers-to", "")
    return int(own) if own else None, size, digest, kind, int(other) if other else None, payload


def with_roles(pages: DataFrame) -> DataFrame:
    """page_id, url, html and ``first``: for a revisit the page it refers to, else null.

    Only digests are gathered; a payload that many pages share is one group of sums, and the pages' side of the join is one that Spark may split.
    """
    rows = pages.select(storage.as_long("page_id").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    large = rows.where(F.octet_length("html") >= LEAST_REVISIT)
    shared = large.groupBy("digest").agg(F.min("page_id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1 and low is not null").select("digest", "low")
    joined = rows.join(shared, "digest", "left")
    return joined.select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("low")), F.col("low")).alias("first"))


def write_warc(pages: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Writes all pages (page_id, url, html) as archives; returns the staged manifest: uri, records."""

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        out, n, done = None, 0, []
        for batch in storage.slices(batches, "html"):
            for p, url, html, first in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "first"))):
                out = out or storage.Writer(folder, f"part-{TaskContext.get().partitionId():06d}-{len(done):04d}", ".warc.gz")
                out.write(record(p, url, html.encode("utf-8", "surrogatepass"), first, first is not None, level))
                n += 1
                if out.size > FILE_BYTES:
                    done.append((out.close(), n))
                    out, n = None, 0
        if out:
            done.append((out.close(), n))
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["uri", "records"])

    return storage.staged(storage.arrow_map(with_roles(pages), write, "uri string, records long"), "warc-manifest")


def read_warc(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and payload) of every record of the archives; a task a file."""

    def read(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        wide = len(names) if with_payload else len(names) - 1

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(wide)], names=names[:wide])

        for batch in batches:
            for uri, want in zip(batch["uri"].to_pylist(), batch["records"].to_pylist()):
                fs, path = storage.open_fs(uri)
                rows, n, size = [], 0, 0
                with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                    for headers, block in read_records(stream):
                        row = verified(headers, block)
                        rows.append(row if with_payload else row[:5])
                        n, size = n + 1, size + with_payload * len(block)
                        if len(rows) == 5_000 or size > 8 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if n != want:
                    raise BadRecord(f"{uri} has {n} records, not {want}")
                if rows:
                    yield batch_of(rows)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return manifest.repartition(storage.partitions_for(manifest.sparkSession), "uri").mapInArrow(read, schema)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_warc(write_warc(pages, storage.new_folder(spark, "warc")))


OP4_SQL = """
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS low FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id > low THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > low THEN low END AS refers_to
FROM f
"""
