"""Benchmark passages in documents, by SimHash windows of the items' sizes.

Words are runs of letters, digits and underscores, lower-cased; shingles have ``WORDS`` words (an item with fewer is one shingle).
For every shingle of a document that stands in an item too, the window of the item's size is laid so that the two meet; windows without
any such shingle have similarity zero and need no fingerprint.  A window's 64-bit SimHash comes from prefix sums of its shingles' votes.
Items are indexed by each of ``BLOCKS`` blocks of their fingerprint.  Fingerprints within ``RADIUS`` bits have a block within RADIUS // BLOCKS bits, so
looking up all block values within that distance finds all of them.  They are verified by the weighted Jaccard similarity of the shingles with
their counts, which must be ``SIMILARITY`` or more.

The benchmark goes to the workers in slices of ``SLICE_BYTES`` at most, with one pass over the documents a slice, so that what is sent has a
bound whatever the benchmark's size.  Documents are read whole.  Null or wordless texts and items match nothing.  Null item_ids are kept as they are;
repeated items and repeated rows give a row each.  Empty tables give no rows.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import storage

WORDS, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 19, 4
SLICE_BYTES = 4_000_000
WORD = re.compile(r"\w+")
_BITS = 64 // BLOCKS


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingles_of(words: list[str], size: int) -> list[tuple[str, ...]]:
    return list(zip(*(words[i:] for i in range(size)))) if len(words) >= size else []


def similarity(a: Counter, b: Counter) -> float:
    """Sum of the smaller counts over sum of the larger ones."""
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def votes(shingles: list[tuple[str, ...]]) -> np.ndarray:
    """Prefix sums, one row more than shingles: how many of the first hashes have each bit."""
    from xxhash import xxh64_intdigest

    hashes = np.fromiter((xxh64_intdigest(" ".join(s), 42) for s in shingles), dtype="<u8", count=len(shingles))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.concatenate((np.zeros((1, 64), dtype=np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))


def prints(votes_: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of votes among n shingles each."""
    return np.packbits(2 * votes_ > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _near_masks() -> np.ndarray:
    out = [sum(1 << b for b in chosen) for k in range(RADIUS // BLOCKS + 1) for chosen in combinations(range(_BITS), k)]
    return np.array(out, dtype=np.uint64)


class Items:
    """The index of one slice of the benchmark."""

    def __init__(self, rows: list[tuple]):
        kept = [(i, w) for i, w in ((i, words_of(t)) for i, t in rows) if w]
        self.ids = [i for i, _ in kept]
        self.sizes = [len(w) for _, w in kept]
        self.steps = [min(WORDS, n) for n in self.sizes]
        self.number: dict[str, int] = {}
        self.counts, self.fp = [], np.zeros(len(kept), dtype=np.uint64)
        #: Shingle size: (sorted codes of shingles, for each the (item, position) pairs).
        self.places: dict[int, dict[tuple[str, ...], list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, ((_, words), step) in enumerate(zip(kept, self.steps)):
            for w in words:
                self.number.setdefault(w, len(self.number) + 1)
            shingles = shingles_of(words, step)
            for at, s in enumerate(shingles):
                self.places[step][s].append((k, at))
            self.counts.append(Counter(shingles))
            self.fp[k] = prints(votes(shingles)[-1:], np.array([len(shingles)]))[0]
        self.codes = {step: np.unique(np.array([self._code_words(s) for s in found], dtype=np.uint64)) for step, found in self.places.items()}
        self.masks = _near_masks()
        self.block: list[dict[int, list[int]]] = []
        self.filled: list[np.ndarray] = []
        for b in range(BLOCKS):
            table: dict[int, list[int]] = defaultdict(list)
            for k, v in enumerate(self._part(self.fp, b).tolist()):
                table[v].append(k)
            filled = np.zeros(1 << _BITS, dtype=bool)
            filled[list(table)] = True
            self.block.append(table)
            self.filled.append(filled)

    @staticmethod
    def _part(fp, b: int):
        return fp >> np.uint64(b * _BITS) & np.uint64((1 << _BITS) - 1)

    _ODD = np.uint64(0x9E3779B97F4A7C15)

    def _code_words(self, words) -> int:
        x = 0
        for w in words:
            x = (x * int(self._ODD) + self.number[w]) & 0xFFFFFFFFFFFFFFFF
        return x

    def _hits(self, numbers: np.ndarray, step: int) -> np.ndarray:
        """Positions where a shingle of an item may stand (exactly checked by the caller)."""
        if len(numbers) < step:
            return np.zeros(0, dtype=np.int64)
        known = numbers > 0
        run = known[: len(known) - step + 1].copy()
        for k in range(1, step):
            run &= known[k : len(known) - step + 1 + k]
        at = np.flatnonzero(run)
        if not at.size:
            return at
        code = np.zeros(at.size, dtype=np.uint64)
        for k in range(step):
            code = code * self._ODD + numbers[at + k]
        codes = self.codes[step]
        where = np.searchsorted(codes, code)
        return at[codes[np.minimum(where, codes.size - 1)] == code]

    def near(self, fp: int) -> list[int]:
        """Items within RADIUS bits of a fingerprint: all of them, by the blocks."""
        found: set[int] = set()
        for b in range(BLOCKS):
            near = np.uint64(int(self._part(np.uint64(fp), b))) ^ self.masks
            for v in near[self.filled[b][near]].tolist():
                found.update(self.block[b][v])
        return [k for k in found if (int(self.fp[k]) ^ int(fp)).bit_count() <= RADIUS]

    def matches(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, bits apart) of the best window of each item found in the text."""
        words = words_of(text)
        numbers = np.fromiter(map(self.number.get, words, (0 for _ in words)), dtype=np.uint64, count=len(words)) if words else np.zeros(0, dtype=np.uint64)
        windows: dict[tuple[int, int], set[int]] = defaultdict(set)  # (shingle size, window size): starts
        for step, places in self.places.items():
            for at in self._hits(numbers, step).tolist():
                for k, j in places.get(tuple(words[at : at + step]), ()):
                    size = min(self.sizes[k], len(words))
                    windows[step, size].add(min(max(at - j, 0), len(words) - size))
        best: dict[int, tuple[int, float, int, int]] = {}
        for (step, size), starts in windows.items():
            for start, fp, shingles in self._prints(words, step, size, sorted(starts)):
                count = None
                for k in self.near(fp):
                    if self.steps[k] != step or self.sizes[k] != size and size != len(words):
                        continue
                    count = count or Counter(shingles)
                    s = similarity(count, self.counts[k])
                    if s >= SIMILARITY and s > best.get(k, (0, 0.0))[1]:
                        best[k] = (k, s, start, (int(self.fp[k]) ^ fp).bit_count())
        return sorted(best.values())

    @staticmethod
    def _prints(words: list[str], step: int, size: int, starts: list[int]) -> Iterator[tuple[int, int, list]]:
        """Windows at the starts, run by run of overlapping ones so that their shingles are hashed once."""
        i = 0
        while i < len(starts):
            j = i + 1
            while j < len(starts) and starts[j] <= starts[j - 1] + size and starts[j] - starts[i] < 100_000:
                j += 1
            base = starts[i]
            shingles = shingles_of(words[base : starts[j - 1] + size], step)
            sums, n = votes(shingles), size - step + 1
            at = np.array(starts[i:j]) - base
            fps = prints(sums[at + n] - sums[at], np.full(len(at), n))
            for start, a, fp in zip(starts[i:j], at.tolist(), fps.tolist()):
                yield start, fp, shingles[a : a + n]
            i = j


def slices_of(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The items in lists of at most SLICE_BYTES of text (one larger item is a list of its own), read one partition at a time."""
    part, size = [], 0
    for row in benchmark.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        n = len(row["text"] or "")
        if part and size + n > SLICE_BYTES:
            yield part
            part, size = [], 0
        part.append((row["item_id"], row["text"]))
        size += n
    if part:
        yield part


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start_word, bits_apart: for each row of docs (doc_id, text) and item found in it, its best window."""
    spark, made = docs.sparkSession, None
    kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id long, item_id {kind}, similarity double, start_word long, bits_apart int"
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    rows = docs.select(storage.as_long("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for part in slices_of(benchmark):
        sent = spark.sparkContext.broadcast(part)

        def run(batches, sent=sent):
            import pyarrow as pa

            items = Items(sent.value)
            for batch in storage.slices(batches, "text"):
                out = [(d, items.ids[k], s, start, apart) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()) for k, s, start, apart in items.matches(t)]
                columns = zip(*out) if out else [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        found = storage.arrow_map(rows, run, schema)
        made = found if made is None else made.unionByName(found)
    return made if made is not None else spark.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, in whose text no item is found."""
    spark, out, position = docs.sparkSession, docs, docs.columns.index("text")
    for part in slices_of(benchmark):
        sent = spark.sparkContext.broadcast(part)

        def run(batches, sent=sent):
            import pyarrow as pa

            items = Items(sent.value)
            for batch in storage.slices(batches, position):
                yield batch.filter(pa.array([not items.matches(t) for t in batch.column(position).to_pylist()], pa.bool_()))

        out = storage.arrow_map(out, run, docs.schema)
    return out


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
