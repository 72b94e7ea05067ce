"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints that differ in at most r bits, cut into s > r / 2 segments, have a segment that differs in one bit at
most.  So the index holds, for every segment, the segment itself and all its variants with one bit wiped out; equal
signatures are joined and the pairs verified on all 64 bits.  Only different fingerprints are indexed: copies have met before.  Where a pair differs in
the wiped bit, one side has it set and the other not, so these two sides are joined and no group is joined with itself.

A segment value that more than ``CROWD`` fingerprints share takes no part in that join.  Its fingerprints (and those one bit
away) are keyed by the whole segment and by the rest of the fingerprint with the remaining radius wiped out: under such a key there are 2**r
fingerprints at most, all of them linked.  So rows stay in proportion to the crowd and no group of links falls apart.  Radii above 2 have no such way
(keys are too many) and join crowds as any other; ``near_dedup`` is for those.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage
from .components import components

CROWD = 512
#: Bytes of one text turned at a time; longer ones are cut at white space and their votes added.
PIECE = 1_000_000


def shingle_hashes(text: str | None, words: int, seed: int = 42):
    """XXH64 hashes of a whole text's shingles, piece by piece.

    Words are runs without ASCII white space, A-Z lower-cased; fewer than ``words`` make one shingle; none, none.
    """
    from xxhash import xxh64_intdigest

    raw = (text or "").encode("utf-8", "surrogatepass")
    n, carry, at = 0, [], 0
    while True:
        end = min(at + PIECE, len(raw))
        while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        got = carry + raw[at:end].lower().split()
        at = end
        if len(got) >= words:
            shingles = map(b" ".join, zip(*(got[i:] for i in range(words))))
            carry = got[len(got) - words + 1 :]
        elif at == len(raw) and got and not n:
            shingles, carry = iter([b" ".join(got)]), []
        else:
            shingles, carry = iter(()), got
        hashes = np.fromiter((xxh64_intdigest(s, seed) for s in shingles), dtype="<u8")
        n += len(hashes)
        yield hashes
        if at == len(raw):
            return


def remixed(hashes: np.ndarray) -> np.ndarray:
    """Other 64-bit hashes made of them, for a further independent fingerprint."""
    x = hashes * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(29)


def fingerprint(text: str | None, words: int, seed: int = 42, prints: int = 1) -> list[int]:
    """``prints`` independent fingerprints as signed 64-bit numbers; a bit is 1 if over half the shingle hashes have it."""
    votes, n = np.zeros((prints, 64), dtype=np.int64), 0
    for hashes in shingle_hashes(text, words, seed):
        n += len(hashes)
        for k in range(prints):
            hashes = remixed(hashes) if k else hashes
            for a in range(0, len(hashes), 65536):
                part = hashes[a : a + 65536]
                votes[k] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > n, axis=1, bitorder="little").view("<i8").ravel().tolist()


def fingerprints(docs: DataFrame, words: int, seed: int = 42) -> DataFrame:
    """doc_id, fp of each row of docs (doc_id, text).  Null texts count as empty: fingerprint 0."""

    def run(batches):
        import pyarrow as pa

        for batch in storage.slices(batches, "text"):
            fps = [fingerprint(t, words, seed)[0] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(storage.as_long("doc_id").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return storage.arrow_map(rows, run, "doc_id long, fp long")


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def segment_masks(segments: int) -> list[int]:
    edges = [round(64 * k / segments) for k in range(segments + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def _variants(fps: DataFrame, masks: list[int]) -> DataFrame:
    """fp, sig, key, side: for each bit its segment without that bit (side: the bit); as 64 + segment the whole segment (side 2)."""
    of = [next(k for k, m in enumerate(masks) if m >> bit & 1) for bit in range(64)]
    rows = [F.struct(F.lit(bit).alias("sig"), F.col("fp").bitwiseAND(F.lit(_signed(masks[of[bit]] & ~(1 << bit)))).alias("key"), F.shiftrightunsigned("fp", bit).bitwiseAND(F.lit(1)).cast("int").alias("side")) for bit in range(64)]
    rows += [F.struct(F.lit(64 + k).alias("sig"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"), F.lit(2).alias("side")) for k, m in enumerate(masks)]
    return fps.select("fp", F.explode(F.array(*rows)).alias("x")).select("fp", "x.sig", "x.key", "x.side")


def links(fps: DataFrame, radius: int, segments: int, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b), a < b, of the different fingerprints in fps (fp) that differ in ``radius`` bits at most; of crowds enough of them to connect what they connect."""
    if not segments > radius / 2:
        raise ValueError("too few segments for this radius")
    masks = segment_masks(segments)
    # Fingerprints are few and short beside the variants made of them: dealt out anew, so that many tasks make these.
    variants = _variants(fps.repartition(storage.partitions_for(fps.sparkSession), "fp"), masks)
    found = None
    if radius <= 2:
        whole = variants.where("side = 2").groupBy("sig", "key").count().where(F.col("count") > crowd).select("sig", "key")
        crowded = storage.staged(whole, "crowded")
        if not crowded.isEmpty():
            near = [F.struct(F.lit(bit).alias("sig"), F.col("key").bitwiseAND(F.lit(_signed(~(1 << bit)))).alias("key"), F.col("sig").alias("of")) for bit in range(64)]
            of = F.element_at(F.array(*(F.lit(64 + next(k for k, m in enumerate(masks) if m >> bit & 1)) for bit in range(64))), F.col("x.sig") + 1)
            around = crowded.select(F.explode(F.array(*near)).alias("x")).where(of == F.col("x.of")).select("x.sig", "x.key").distinct()
            shut = storage.staged(crowded.unionByName(around), "crowded")
            shut = storage.bounded(shut)
            found = _crowd_links(variants.join(shut, ["sig", "key"], "left_semi"), masks, radius)
            variants = variants.join(shut, ["sig", "key"], "left_anti")
    # Spark sizes an exploded table as if it had a row for each of its input's, and would send variants through the driver: hence the hint.
    left = variants.where("side <> 1").select("sig", "key", F.col("fp").alias("a"))
    right = variants.where("side <> 0").select("sig", "key", F.col("fp").alias("b"))
    pairs = left.hint("merge").join(right.hint("merge"), ["sig", "key"]).where((F.col("sig") < 64) | (F.col("a") < F.col("b")))
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return (pairs if found is None else pairs.unionByName(found)).distinct()


def _crowd_links(rows: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Links of fingerprints that share a crowded signature: the rest is wiped in the bits that the signature leaves of the radius."""
    made = None
    for k, mask in enumerate(masks):
        rest = [bit for bit in range(64) if not mask >> bit & 1]
        for wild in (False, True):
            own = rows.where(F.col("sig").isin([b for b in range(64) if mask >> b & 1] if wild else [64 + k]))
            left = radius - wild
            wiped = [sum(1 << b for b in chosen) for chosen in combinations(rest, left)]
            keys = own.select("sig", "key", "fp", F.explode(F.array(*(F.lit(_signed(w)) for w in wiped))).alias("wiped"))
            keys = keys.withColumn("rest", F.col("fp").bitwiseAND(F.lit(_signed(~mask))).bitwiseAND(F.bitwise_not("wiped")))
            groups = keys.groupBy("sig", "key", "wiped", "rest").agg(F.sort_array(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)
            edges = groups.select(F.col("fps")[0].alias("a"), F.explode("fps").alias("b")).where("a < b")
            made = edges if made is None else made.unionByName(edges)
    return made.distinct()


def classes(docs_fp: DataFrame, pairs: DataFrame) -> DataFrame:
    """fp, component_id (the smallest doc_id among all fingerprints linked to it) for every different fp of docs_fp (doc_id, fp).

    Joins here are by shuffle, whatever Spark takes a compressed file for: these tables grow with the input.
    """
    first = docs_fp.groupBy("fp").agg(F.min("doc_id").alias("first"))
    member = components(pairs).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    known = first.hint("merge").join(member.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    known = storage.staged(known, "classes")
    low = known.groupBy("root").agg(F.min("first").alias("component_id"))
    return known.hint("merge").join(low.hint("merge"), "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, segments: int = 2) -> DataFrame:
    """doc_id, fp, component_id of every row of docs (doc_id, text).

    Rows without words have fingerprint 0 and are linked like any other.  Equal doc_ids give a row each.  A component all of
    whose doc_ids are null has a null component_id.  Empty table: no rows.  Other columns are not read.
    """
    known = storage.staged(fingerprints(docs, words), "fingerprints")
    pairs = links(known.select("fp").distinct(), radius, segments)
    # A fingerprint may be most documents': its side of this join is the one that Spark splits when it is skewed.
    return known.hint("merge").join(classes(known, pairs).hint("merge"), "fp", "left").select("doc_id", "fp", "component_id")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, radius=2, segments=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
