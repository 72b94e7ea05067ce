"""Token ids as patched frame-of-reference files.

Layout of a file, all little endian::

    "KPFR" u32 version | blocks | documents | index | trailer
    block     u32 minimum, u8 width, u16 exceptions, u16 ids, packed residuals,
              exceptions as u16 position and u32 residual >> width
    documents per document i64 doc_id, u8 null, u32 tokens
    index     u64 start of each block
    trailer   u64 documents' start, u64 index's start, u64 ids, u32 documents, u32 blocks, u32 block size, "KPFR"

A block holds ``BLOCK`` ids (the last fewer).  From each id the block's minimum is taken; residuals are packed
at the width that holds ``PERCENTILE`` percent of them, and what is wider leaves its high bits in the exceptions.
Memory: a writer holds one slice of documents and one super-block, a reader one super-block.

Null texts count as empty; every document gets the end id, so none has no token.  Null ids come first, equal ids
are ordered by a hash of the text.  No rows: no file and no rows.  Other columns of the input are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import storage, wordbpe

MAGIC, VERSION = b"KPFR", 1
BLOCK, PERCENTILE = 1024, 90
#: Blocks packed or unpacked at a time.
TOGETHER = 128
#: Characters that a task encodes at a time, and pre-tokens that a worker remembers: more than where other operators share the worker.
SLICE_CHARS, REMEMBERED = 1_000_000, 120_000
TRAILER = struct.Struct("<QQQIII4s")
HEAD = struct.Struct("<IBHH")


def pack_blocks(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> list[bytes]:
    """Each block's bytes.  ids: unsigned, any number."""
    out: list[bytes] = []
    for a in range(0, len(ids), block * TOGETHER):
        part = ids[a : a + block * TOGETHER].astype(np.uint32)
        whole = len(part) // block
        out += _pack(part[: whole * block].reshape(whole, block), percentile) if whole else []
        if len(part) % block:
            out += _pack(part[whole * block :][None], percentile)
    return out


def _pack(rows: np.ndarray, percentile: int) -> list[bytes]:
    n = rows.shape[1]
    low = rows.min(axis=1)
    rest = rows - low[:, None]
    rank = min(n - 1, -(-n * percentile // 100) - 1)
    wide = np.partition(rest, rank, axis=1)[:, rank]
    widths = np.array([int(x).bit_length() for x in wide], dtype=np.int64)
    out: list[bytes] = [b""] * len(rows)
    for w in np.unique(widths).tolist():
        mine = np.flatnonzero(widths == w)
        packed = [b""] * len(mine)
        if w:
            bits = (rest[mine][:, :, None] >> np.arange(w, dtype=np.uint32)).astype(np.uint8) & 1
            packed = [x.tobytes() for x in np.packbits(bits.reshape(len(mine), -1), axis=1, bitorder="little")]
        for k, i in enumerate(mine.tolist()):
            high = rest[i] >> np.uint32(w)
            at = np.flatnonzero(high)
            out[i] = HEAD.pack(int(low[i]), w, len(at), n) + packed[k] + at.astype("<u2").tobytes() + high[at].astype("<u4").tobytes()
    return out


def unpack_blocks(data: memoryview, starts: list[int]) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` within data, in order."""
    heads = [HEAD.unpack_from(data, s) for s in starts]
    out = [None] * len(starts)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, (_, w, _, n) in enumerate(heads):
        kinds.setdefault((w, n), []).append(i)
    for (w, n), mine in kinds.items():
        size = -(-w * n // 8)
        rows = np.zeros((len(mine), n), dtype=np.uint32)
        if w:
            raw = np.stack([np.frombuffer(data, dtype=np.uint8, count=size, offset=starts[i] + HEAD.size) for i in mine])
            bits = np.unpackbits(raw, axis=1, bitorder="little", count=w * n).reshape(len(mine), n, w)
            for k in range(w):
                rows |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
        for k, i in enumerate(mine):
            low, _, many, _ = heads[i]
            if many:
                at = np.frombuffer(data, dtype="<u2", count=many, offset=starts[i] + HEAD.size + size)
                high = np.frombuffer(data, dtype="<u4", count=many, offset=starts[i] + HEAD.size + size + 2 * many)
                rows[k, at] |= high << np.uint32(w)
            rows[k] += np.uint32(low)
            out[i] = rows[k]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


class FileWriter:
    """Documents in, one file out; made when the first document comes."""

    def __init__(self, folder: str, stem: str):
        self.out = storage.Writer(folder, stem, ".kpfr")
        self.out.write(MAGIC + struct.pack("<I", VERSION))
        self.pending = np.zeros(0, dtype=np.uint32)
        self.docs: list[bytes] = []
        self.starts: list[int] = []
        self.ids = self.n_docs = 0

    def add(self, doc_ids: list[int | None], lists: list[np.ndarray]) -> None:
        self.docs.append(b"".join(struct.pack("<qBI", d or 0, d is None, len(x)) for d, x in zip(doc_ids, lists)))
        self.n_docs += len(doc_ids)
        self.pending = np.concatenate([self.pending, *lists])
        self._flush(len(self.pending) // BLOCK * BLOCK)

    def size(self) -> int:
        """Bytes written, and those that pending ids will need at most but for exceptions."""
        return self.out.size + 2 * len(self.pending)

    def _flush(self, n: int) -> None:
        for b in pack_blocks(self.pending[:n]):
            self.starts.append(self.out.size)
            self.out.write(b)
        self.ids += n
        self.pending = self.pending[n:].copy()

    def close(self) -> tuple[str, int, int]:
        self._flush(len(self.pending))
        docs = self.out.size
        self.out.write(b"".join(self.docs))
        index = self.out.size
        self.out.write(np.array(self.starts, dtype="<u8").tobytes())
        self.out.write(TRAILER.pack(docs, index, self.ids, self.n_docs, len(self.starts), BLOCK, MAGIC))
        return self.out.close(), self.ids, self.n_docs


def read_file(uri: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start within the file, ids) of each document, reading a super-block at a time by the index of block starts."""
    fs, path = storage.open_fs(uri)
    with fs.open_input_file(path) as f:
        total = f.size()
        docs_at, index_at, _, n_docs, n_blocks, _, magic = TRAILER.unpack(f.read_at(TRAILER.size, total - TRAILER.size))
        if magic != MAGIC or f.read_at(4, 0) != MAGIC:
            raise ValueError(f"{uri} is no token file")
        starts = np.frombuffer(f.read_at(8 * n_blocks, index_at), dtype="<u8").astype(np.int64)
        ends = np.append(starts[1:], docs_at)
        table = np.frombuffer(f.read_at(13 * n_docs, docs_at), dtype=np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4")]))
        have, base, next_block = np.zeros(0, dtype=np.uint32), 0, 0
        upto = np.cumsum(table["n"].astype(np.int64))
        for d, null, n, end in zip(table["id"].tolist(), table["null"].tolist(), table["n"].tolist(), upto.tolist()):
            pieces = [have]
            got = base + len(have)
            while got < end:
                last = min(next_block + TOGETHER, n_blocks)
                a = int(starts[next_block])
                more = unpack_blocks(memoryview(f.read_at(int(ends[last - 1]) - a, a)), (starts[next_block:last] - a).tolist())
                pieces.append(more)
                got, next_block = got + len(more), last
            if len(pieces) > 1:
                have = np.concatenate(pieces)
            yield (None if null else d), end - n, have[end - n - base : end - base]
            if end - base >= len(have) or end - base > 1 << 20:
                have, base = have[end - base :], end


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = 2, file_bytes: int = 64 << 20) -> DataFrame:
    """Writes ``docs`` (doc_id, text) in ascending doc_id order; returns the staged manifest: seq, part, uri, ids, docs.

    ``end_id`` is appended to every document.  A file is closed with the first document that brings it to about ``file_bytes`` packed bytes.
    """

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = wordbpe.encoder(path, REMEMBERED).encode
        seq, end, rows, out = TaskContext.get().partitionId(), np.array([end_id], dtype="<u2"), [], None
        for batch in storage.slices(batches, "text", SLICE_CHARS):
            lists, ids = [np.concatenate((x, end)) for x in encode(batch["text"].to_pylist())], batch["doc_id"].to_pylist()
            # Documents go in by runs of an eighth of a file, one longer document being a run.
            run = np.cumsum([len(x) for x in lists]) * 16 // max(1, file_bytes)
            cuts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(lists)]
            for a, b in zip(cuts, cuts[1:]):
                out = out or FileWriter(folder, f"part-{seq:06d}-{len(rows):04d}")
                out.add(ids[a:b], lists[a:b])
                if out.size() >= file_bytes:
                    rows.append((seq, len(rows), *out.close()))
                    out = None
        if out:
            rows.append((seq, len(rows), *out.close()))
        names = ["seq", "part", "uri", "ids", "docs"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=pa.schema([("seq", pa.int64()), ("part", pa.int64()), ("uri", pa.string()), ("ids", pa.int64()), ("docs", pa.int64())]))

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    made = storage.arrow_map(ordered, write, "seq long, part long, uri string, ids long, docs long")
    return storage.staged(made, "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone; a task a file."""

    def read(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for uri, base in zip(batch["uri"].to_pylist(), batch["base"].to_pylist()):
                rows = []
                for d, at, ids in read_file(uri):
                    rows.append((d, base + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    # One row a file, far fewer than documents: a running sum over them needs one small task.
    files = manifest.withColumn("base", F.coalesce(F.sum("ids").over(Window.orderBy("seq", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    spread = files.repartition(storage.partitions_for(manifest.sparkSession), "uri")
    return storage.arrow_map(spread.select("uri", "base"), read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_tokens(docs, storage.new_folder(spark, "tokens"), wordbpe.vocabulary_path(), end_id=2)
    return read_tokens(manifest)
