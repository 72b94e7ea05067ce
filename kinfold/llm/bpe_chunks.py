"""BPE encoding with reuse of content-defined chunks, and decoding.

Each text's UTF-8 bytes are cut where a rolling hash of the last 32 bytes has ``CUT_BITS`` zero bits: the same passage is cut in the same
places in whichever document it stands.  Chunks are known by a 128-bit digest and counted over the whole corpus.  A chunk that occurs twice or more is
encoded once, by the one task that its digest falls to, and its ids are joined to all the documents that hold it.  What lies between such chunks is encoded
where its document is read.

To know shared chunks while reading, tasks get a filter of ``FILTER_BITS`` bits in which each shared chunk sets one.  A chunk that is let through by chance
costs a detour and changes nothing.  Only documents with a shared chunk are shuffled, as pieces of ids; texts never are.

A piece's first and last word may go on in its neighbours.  So a join is repaired: a window around it grows to the left and right, over as many pieces as
need be, until both edges stand at white space, and takes in the next word beyond on either side.  Its encoding must agree, id by id, with the pieces' own
encoding of those words; else it grows by a further word.  Between the words on which both agree the window's ids stand.

Null texts count as empty: no ids, decoded text empty.  Whole texts of any length, one slice at a time.  Repeated rows give repeated rows,
no rows none; doc_id may be null or repeated; other columns are not read.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage, wordbpe

CUT_BITS = 9
#: Bits of the filter that is sent to the tasks: 4 MB whatever the corpus.
FILTER_BITS = 1 << 25
#: Words beyond a join's edges with which agreement is tried before the vocabulary is held unfit.
EDGE_WORDS = 2
#: Shared chunks that a task remembers having sent, so that it doesn't send them again.
SENT = 50_000
_GEAR = np.random.default_rng(7).integers(0, 2**32, size=256, dtype=np.uint32)


def cuts(data: np.ndarray) -> np.ndarray:
    """Where new chunks begin: before a byte that begins a character, after 32 bytes whose hash ends in zeros."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):  # after each turn the sum of twice as many bytes, each shifted by its distance
        shifted = h[:-k] << np.uint32(k) if k < len(h) else h[:0]
        h = h.copy()
        h[k:] += shifted
    hit = (h >> np.uint32(32 - CUT_BITS)) == 0  # the high bits depend on all 32 bytes
    at = np.flatnonzero(hit[:-1]) + 1
    return at[(data[at] & 0xC0) != 0x80]


def chunks_of(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    at = [0, *cuts(np.frombuffer(raw, dtype=np.uint8)).tolist(), len(raw)] if raw else [0]
    return [raw[a:b] for a, b in zip(at, at[1:])]


def digest(chunk: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(chunk, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class Piece(NamedTuple):
    """Some bytes of a text: up to the first white space, the ids from there to the last one, and what follows it (None if there is no white space).

    first, last: the first and last ``EDGE_WORDS`` words of those that the ids stand for.
    """

    head: bytes
    ids: np.ndarray
    tail: bytes | None
    first: list[bytes]
    last: list[bytes]


class Joined:
    """Encodes pieces and joins them."""

    def __init__(self, path: str):
        self.encoder = wordbpe.encoder(path)

    def _ids(self, raws: list[bytes]) -> list[np.ndarray]:
        return self.encoder.encode([r.decode("utf-8", "surrogatepass") for r in raws])

    def pieces(self, raws: list[bytes]) -> list[Piece]:
        edges, inner = [], []
        for c in raws:
            first = min((i for i in map(c.find, (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if i >= 0), default=-1)
            last = max(map(c.rfind, (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")))
            edges.append((c[:first], c[last + 1 :]) if first >= 0 else (c, None))
            inner.append(c[first:last] if first >= 0 else b"")
        made = []
        for (head, tail), raw, ids in zip(edges, inner, self._ids(inner)):
            left, right = raw.split(None, EDGE_WORDS), raw.rsplit(None, EDGE_WORDS)
            made.append(Piece(head, ids, tail, left[:EDGE_WORDS], right[-EDGE_WORDS:]))
        return made

    def join(self, texts: list[list[Piece]]) -> list[np.ndarray]:
        """The ids of texts given as their pieces in order."""
        plans: list[list] = []  # per text in turn: number of a window, ids of a piece, number of a window, ...
        windows: list[tuple[bytes, Piece | None, Piece | None]] = []  # what stands between the white spaces, and the pieces on both sides
        for pieces in texts:
            plan, open_, before = [], [], None
            for p in pieces:
                open_.append(p.head)
                if p.tail is not None:
                    plan += [len(windows), p.ids]
                    windows.append((b"".join(open_), before, p))
                    open_, before = [p.tail], p
            plan.append(len(windows))
            windows.append((b"".join(open_), before, None))
            plans.append(plan)
        between = self._between(windows, 1)
        return [np.concatenate([between[x] if isinstance(x, int) else x for x in plan]) for plan in plans]

    def _between(self, windows: list[tuple], words: int) -> list[np.ndarray]:
        """The ids between the pieces of each window, on whose words at both edges the window's encoding and the pieces' own agree."""
        left = [b" ".join(p.last[-words:]) if p else b"" for _, p, _ in windows]
        right = [b" ".join(p.first[:words]) if p else b"" for _, _, p in windows]
        whole = self._ids([b" ".join((a, w, b)) for a, (w, _, _), b in zip(left, windows, right)])
        out, again = [], []
        for i, (ids, a, b, (_, p, q)) in enumerate(zip(whole, self._ids(left), self._ids(right), windows)):
            upto = len(ids) - len(b)
            agree = len(a) <= upto and np.array_equal(ids[: len(a)], a) and np.array_equal(ids[upto:], b)
            agree = agree and (p is None or not len(a) or np.array_equal(p.ids[-len(a) :], a)) and (q is None or np.array_equal(q.ids[: len(b)], b))
            out.append(ids[len(a) : upto])
            if not agree:
                again.append(i)
        if again:
            if words == EDGE_WORDS:
                raise ValueError("tokens of this vocabulary span white space, so chunks can't be joined there")
            for i, ids in zip(again, self._between([windows[i] for i in again], words + 1)):
                # The wider window's words are the pieces' own, so what is between them is what it has between.
                out[i] = ids
        return out


class Decoder:
    """Ids to text as the library's decode without a decoder: the tokens' own strings, joined by blanks."""

    def __init__(self, path: str):
        names = wordbpe.encoder(path).spec.names
        self.names = [n.encode() for n in names]
        self.decimals = [str(i).encode() for i in range(len(names))]

    def decode(self, ids: list[int]) -> bytes:
        return b" ".join([self.names[i] for i in ids])


FIELDS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
_MADE: dict[str, tuple[Joined, Decoder]] = {}


def _tools(path: str) -> tuple[Joined, Decoder]:
    if path not in _MADE:
        _MADE[path] = Joined(path), Decoder(path)
    return _MADE[path]


def _field(name: str, row: list[int], decoder: Decoder, plain: bytes):
    if name == "n_tokens":
        return len(row)
    if name == "ids":
        return row
    if name == "decoded":
        return plain.decode()
    return hashlib.sha256(plain if name == "decoded_sha256" else b" ".join([decoder.decimals[i] for i in row])).hexdigest()


def _columns(lists: list[np.ndarray | None], fields: list[str], decoder: Decoder) -> list:
    """Arrow columns of the wanted fields; null where there are no ids to tell them from."""
    import pyarrow as pa

    kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
    rows = []
    for ids in lists:
        row = None if ids is None else ids.tolist()
        plain = decoder.decode(row) if row is not None and {"decoded", "decoded_sha256"} & {*fields} else b""
        rows.append([None if row is None else _field(f, row, decoder, plain) for f in fields])
    return [pa.array([r[k] for r in rows], kinds.get(f, pa.string())) for k, f in enumerate(fields)]


_PIECE = "struct<head: binary, ids: binary, tail: binary, first: array<binary>, last: array<binary>>"


def _packed(p: Piece) -> dict:
    return p._asdict() | {"ids": p.ids.astype("<u2").tobytes()}


def _unpacked(p: dict) -> Piece:
    return Piece(p["head"], np.frombuffer(p["ids"], "<u2"), p["tail"], p["first"], p["last"])


def shared_chunks(docs: DataFrame) -> DataFrame:
    """k0, k1 of the chunks that occur twice or more in the texts, staged."""

    def run(batches):
        import pyarrow as pa

        for batch in storage.slices(batches, "text"):
            n: dict[bytes, int] = {}
            for t in batch["text"].to_pylist():
                for c in chunks_of(t):
                    n[c] = n.get(c, 0) + 1
            keys = [digest(c) for c in n]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(list(n.values()), pa.int64())], names=["k0", "k1", "n"])

    counts = storage.arrow_map(docs.select("text"), run, "k0 long, k1 long, n long").groupBy("k0", "k1").agg(F.sum("n").alias("n"))
    return storage.staged(counts.where("n > 1").select("k0", "k1"), "shared-chunks")


def _filter(shared: DataFrame) -> np.ndarray:
    """One bit for each shared chunk, by the low bits of its digest: FILTER_BITS / 64 numbers."""
    at = F.col("k0").bitwiseAND(F.lit(FILTER_BITS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    words = shared.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def _read(docs: DataFrame, path: str, fields: list[str], shared: DataFrame) -> DataFrame:
    """Each document read once, staged: number, doc_id; ``whole`` with its fields, or its ``pieces``, each a piece or the digest of a shared chunk; ``chunks``: bytes of such."""
    sent = docs.sparkSession.sparkContext.broadcast(_filter(shared))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        joined, decoder = _tools(path)
        bits, number, told = sent.value, TaskContext.get().partitionId() << 40, set()
        key = [pa.field("k0", pa.int64()), pa.field("k1", pa.int64())]
        piece = pa.struct([("head", pa.binary()), ("ids", pa.binary()), ("tail", pa.binary()), ("first", pa.list_(pa.binary())), ("last", pa.list_(pa.binary()))])
        for batch in storage.slices(batches, "text"):
            plans, raws, chunks = [], [], []  # a plan: digests of shared chunks and numbers of raws
            for t in batch["text"].to_pylist():
                plan, open_, new = [], [], []
                for c in chunks_of(t):
                    k = digest(c)
                    at = k[0] & FILTER_BITS - 1
                    if not int(bits[at >> 6]) >> (at & 63) & 1:
                        open_.append(c)
                        continue
                    if open_:
                        plan.append(len(raws))
                        raws.append(b"".join(open_))
                        open_ = []
                    plan.append(k)
                    if k not in told:
                        told.add(k)
                        new.append({"k0": k[0], "k1": k[1], "raw": c})
                if open_ or not plan:
                    plan.append(len(raws))
                    raws.append(b"".join(open_))
                plans.append(plan)
                chunks.append(new)
            if len(told) > SENT:
                told.clear()
            pieces = joined.pieces(raws)
            alone = [i for i, plan in enumerate(plans) if len(plan) == 1 and isinstance(plan[0], int)]
            lists: list = [None] * len(plans)
            for i, ids in zip(alone, joined.join([[pieces[plans[i][0]]] for i in alone])):
                lists[i] = ids
            rows = [None if lists[i] is not None else [{"k0": None, "k1": None, "piece": _packed(pieces[x])} if isinstance(x, int) else {"k0": x[0], "k1": x[1], "piece": None} for x in plan] for i, plan in enumerate(plans)]
            numbers = pa.array(range(number, number + len(plans)), pa.int64())
            number += len(plans)
            columns = [numbers, batch["doc_id"], *_columns(lists, fields, decoder), pa.array(rows, pa.list_(pa.struct([*key, ("piece", piece)]))), pa.array(chunks, pa.list_(pa.struct([*key, ("raw", pa.binary())])))]
            yield pa.RecordBatch.from_arrays(columns, names=["number", "doc_id", *fields, "pieces", "chunks"])

    schema = ["number long", "doc_id long", *(f"{f} {FIELDS[f]}" for f in fields), f"pieces array<struct<k0: long, k1: long, piece: {_PIECE}>>", "chunks array<struct<k0: long, k1: long, raw: binary>>"]
    return storage.staged(storage.arrow_map(docs, run, ", ".join(schema)), "read")


def encoded_chunks(read: DataFrame, path: str) -> DataFrame:
    """k0, k1, piece: each chunk that the documents point to, encoded once; staged."""

    def run(batches):
        import pyarrow as pa

        joined, _ = _tools(path)
        for batch in storage.slices(batches, "raw"):
            pieces = [_packed(p) for p in joined.pieces(batch["raw"].to_pylist())]
            kind = pa.struct([("head", pa.binary()), ("ids", pa.binary()), ("tail", pa.binary()), ("first", pa.list_(pa.binary())), ("last", pa.list_(pa.binary()))])
            yield pa.RecordBatch.from_arrays([batch["k0"], batch["k1"], pa.array(pieces, kind)], names=["k0", "k1", "piece"])

    chunks = read.select(F.explode("chunks").alias("c")).select("c.*").dropDuplicates(["k0", "k1"])
    return storage.staged(storage.arrow_map(chunks, run, f"k0 long, k1 long, piece {_PIECE}"), "encoded-chunks")


def encode_decode(docs: DataFrame, path: str, fields: list[str]) -> DataFrame:
    """doc_id and the wanted ``FIELDS`` of docs (doc_id, text); ``decoded`` is decoded from the ids."""
    rows = docs.select(storage.as_long("doc_id").alias("doc_id"), docs["text"].cast("string").alias("text"))
    read = _read(rows, path, fields, shared_chunks(rows))
    encoded = encoded_chunks(read, path)
    pieces = read.where("pieces is not null").select("number", "doc_id", F.posexplode("pieces").alias("at", "x")).select("number", "doc_id", "at", "x.*")
    own = pieces.where("k0 is null").select("number", "doc_id", "at", "piece")
    theirs = pieces.where("k0 is not null").drop("piece").join(encoded.hint("merge"), ["k0", "k1"]).select("number", "doc_id", "at", "piece")
    met = own.unionByName(theirs).repartition("number").sortWithinPartitions("number", "at").select("number", "doc_id", "piece")

    def assemble(batches):
        import pyarrow as pa

        joined, decoder = _tools(path)

        def batch_of(ids, texts):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *_columns(joined.join(texts), fields, decoder)], names=["doc_id", *fields])

        ids, texts, last, size = [], [], None, 0
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                for number, doc_id, p in zip(*(c.to_pylist() for c in part.columns)):
                    if number != last:
                        if size > storage.BATCH_CHARS // 4:
                            yield batch_of(ids, texts)
                            ids, texts, size = [], [], 0
                        ids.append(doc_id)
                        texts.append([])
                        last = number
                    texts[-1].append(_unpacked(p))
                    size += len(p["ids"])
        if ids:
            yield batch_of(ids, texts)

    joined = storage.arrow_map(met, assemble, ", ".join(["doc_id long", *(f"{f} {FIELDS[f]}" for f in fields)]))
    return read.where("pieces is null").select("doc_id", *fields).unionByName(joined)


def op6_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_decode(docs, wordbpe.vocabulary_path(), ["n_tokens", "ids_sha256", "decoded_sha256"])
