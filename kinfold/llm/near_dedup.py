"""Near-duplicate documents: shingle sets of at least a given Jaccard similarity, found by deletion-variant signatures of SimHashes.

A document's fingerprint has ``PRINTS`` * 64 bits, each by a vote of its different shingles.  It is cut into ``PRINTS`` * ``SEGMENTS`` segments, and the
index holds every segment whole and with one bit wiped out.  So two fingerprints of which one segment differs in at most one bit meet in an equality join;
those within ``PRINT_RADIUS`` bits of the print and ``RADIUS`` bits of the whole are verified by the exact Jaccard similarity of the shingle sets.
Every link is verified before it is used, and none is thinned before that.

Large groups would meet in pairs without end, so links are sought in steps:

1. Every node (a different shingle set) is verified against one leader: the closest one among the leaders of the buckets of equal segments that it is in.
   In buckets of over ``FULL`` nodes those that are not of the bucket's largest group yet are held against other members of that group, turn by turn.
   The links so found give each node a label; what has one label is known to be of one group.
2. The index is joined for pairs of *different* labels.  Labels of ``LARGE`` nodes or more don't take part node by node.  In the buckets that they are in, a semi-join tells
   which other nodes come near the bucket's largest label at all, a row a node, and only nodes of other labels are joined in pairs.
3. Nodes that come near a large label are held against all its members, block by block, until a link is found or none is left.

All links together join what all the links that the index can find join.  Rows grow as the nodes, and as the pairs of near fingerprints of small groups.

A document without words has the empty set, and all of those are copies.  Null texts count as empty.  doc_ids may have any type that can be ordered;
rows without one all stay, as there is nothing to tell them by.  Of rows equal in doc_id and text one stays.  An empty table gives no rows.
All columns are kept as they are, and may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage
from .components import components
from .simhash_dedup import remixed, segment_masks, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
PRINTS, SEGMENTS = 4, 3
#: Bits that may differ in one print and in all.  At similarity 0.8 about 15 % of the bits do: 9.7 +- 2.9 and 38.7 +- 5.7.
PRINT_RADIUS, RADIUS = 13, 50
#: In buckets of more nodes than this, those outside the largest group look for it, for so many turns at most.
FULL, TURNS = 32, 2
#: Nodes of a label from which on it is not joined node by node.
LARGE = 16
#: Nodes of a large label, and bytes of their sets, that a task holds against others at a time.
BLOCK, BLOCK_BYTES = 1024, 16_000_000
#: Members that a task holds against one leader.
FAN = 256
_NAMES = [f"p{k}" for k in range(PRINTS)]
_MASKS = segment_masks(SEGMENTS)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The different shingle hashes of a whole text, sorted."""
    return np.unique(np.concatenate(list(shingle_hashes(text, words))))


def prints_of(hashes: np.ndarray, prints: int = PRINTS) -> np.ndarray:
    """The fingerprint of a set of hashes, as signed 64-bit numbers."""
    votes = np.zeros((prints, 64), dtype=np.int64)
    for a in range(0, len(hashes), 65536):
        part = hashes[a : a + 65536]
        for k in range(prints):
            part = remixed(part) if k else part
            votes[k] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes), axis=1, bitorder="little").view("<i8").ravel()


def _known(rows: DataFrame, words: int) -> DataFrame:
    """id, h, d0, d1 (a digest of the shingle set) and the prints of each row of rows (id, h, text)."""
    kind = rows.schema["id"].dataType
    fields = [T.StructField("id", kind), *(T.StructField(n, T.LongType()) for n in ("h", "d0", "d1", *_NAMES))]

    def run(batches):
        import pyarrow as pa

        for batch in storage.slices(batches, "text"):
            out = np.empty((batch.num_rows, 2 + PRINTS), dtype=np.int64)
            for i, t in enumerate(batch["text"].to_pylist()):
                hashes = shingle_set(t, words)
                out[i, :2] = np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), dtype="<i8")
                out[i, 2:] = prints_of(hashes)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["h"], *(pa.array(out[:, k]) for k in range(2 + PRINTS))], names=[f.name for f in fields])

    return storage.arrow_map(rows.select("id", "h", "text"), run, T.StructType(fields))


def _apart(a: str, b: str) -> Column:
    """Bits that differ between two fingerprints, given as prefixes of the prints' names."""
    return sum((F.bit_count(F.col(f"{a}{n}").bitwiseXOR(F.col(f"{b}{n}"))) for n in _NAMES[1:]), F.bit_count(F.col(f"{a}{_NAMES[0]}").bitwiseXOR(F.col(f"{b}{_NAMES[0]}"))))


#: Lowest bit and length of each segment of a print, and the length of the longest.
_AT = [((m & -m).bit_length() - 1, m.bit_count()) for m in _MASKS]
_LONGEST = max(n for _, n in _AT)


def _wholes(nodes: DataFrame) -> DataFrame:
    """All columns of nodes and k, once for each whole segment: the segment's number and, in the low 32 bits, its value."""
    keys = [F.lit((n * SEGMENTS + s) << 32) + F.shiftrightunsigned(name, low).bitwiseAND(F.lit((1 << size) - 1)) for n, name in enumerate(_NAMES) for s, (low, size) in enumerate(_AT)]
    return nodes.withColumn("k", F.explode(F.array(*keys)))


def _wiped(k: Column, bit: Column) -> Column:
    """The signature of a whole segment with one of its bits wiped out; the segment itself for bit -1."""
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    number = F.lit(PRINTS * SEGMENTS) + F.shiftright(k, 32) * _LONGEST + bit
    return F.when(bit < 0, k).otherwise(F.call_function("shiftleft", number, F.lit(32)) + k.bitwiseAND(F.lit((1 << 32) - 1)).bitwiseAND(F.bitwise_not(mark)))


def _with_bits(rows: DataFrame) -> DataFrame:
    """rows (with k of whole segments) once for each ``bit`` of the segment and once for -1."""
    size = F.element_at(F.array(*(F.lit(n) for _, n in _AT)), (F.shiftright("k", 32) % SEGMENTS + 1).cast("int"))
    return rows.withColumn("bit", F.explode(F.sequence(F.lit(-1), F.lit(_LONGEST - 1)))).where(F.col("bit") < size)


def _variants(nodes: DataFrame, side: int | None) -> DataFrame:
    """k, node, label, fp: whole segments, and those with one bit wiped that is ``side`` in this fingerprint (None: either, and a column with it; whole segments: 2)."""
    fp = F.element_at(F.array(*_NAMES), (F.floor(F.shiftright("k", 32) / SEGMENTS) + 1).cast("int")).alias("fp")
    own = F.when(F.col("bit") < 0, 2).otherwise(F.call_function("shiftright", F.col("k"), F.greatest("bit", F.lit(0))).bitwiseAND(F.lit(1)).cast("int"))
    rows = _with_bits(_wholes(nodes).select("k", "node", "label", fp)).withColumn("side", own)
    rows = rows if side is None else rows.where(F.col("side").isin(side, 2))
    return rows.select(_wiped(F.col("k"), F.col("bit")).alias("k"), *(["side"] if side is None else []), "node", "label", "fp")


class _Verifier:
    """Holds pairs of nodes against the similarity.  rows: id, h, text; nodes: node, rep (struct of id and h)."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, words: int, similarity: float):
        self.rows, self.nodes, self.words, self.similarity = rows, nodes, words, similarity

    def sets(self, wanted: DataFrame) -> DataFrame:
        """node, hashes of the wanted nodes (node)."""
        words = self.words

        def run(batches):
            import pyarrow as pa

            for batch in storage.slices(batches, "text"):
                found = [shingle_set(t, words).tobytes() for t in batch["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch["node"], pa.array(found, pa.binary())], names=["node", "hashes"])

        at = storage.staged(wanted.join(self.nodes, "node").select("node", "rep.id", "rep.h"), "wanted")
        texts = self.rows.join(storage.bounded(at), ["id", "h"]).select("node", "text")
        out = storage.staged(storage.arrow_map(texts, run, "node long, hashes binary").dropDuplicates(["node"]), "shingle-sets")
        storage.remove(at)
        return out

    def alike(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b; staged, and removed) whose sets are alike, staged."""
        similarity = self.similarity

        def compare(batches):
            import pyarrow as pa

            leader, own = None, None
            for batch in batches:
                a, b = [], []
                for lead, salt, role, node, raw in storage.rows_of([batch], ("a", "salt", "role", "node", "hashes")):
                    if not role:
                        leader, own = (lead, salt), np.frombuffer(raw, "<u8")
                        continue
                    if leader != (lead, salt):
                        raise RuntimeError("a member came without its leader")
                    other = np.frombuffer(raw, "<u8")
                    if min(own.size, other.size) < similarity * max(own.size, other.size):
                        continue
                    both = np.intersect1d(own, other, assume_unique=True).size
                    if both >= similarity * (own.size + other.size - both):
                        a.append(lead)
                        b.append(node)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        sets = self.sets(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
        salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("n"))
        members = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("n")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("node"))
        leaders = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("node"))
        met = leaders.unionByName(members).join(sets.hint("merge"), "node")
        met = met.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").select("a", "salt", "role", "node", "hashes")
        out = storage.staged(storage.arrow_map(met, compare, "a long, b long"), "alike")
        storage.remove(sets)
        return out


    def near_large(self, near: DataFrame, labelled: DataFrame) -> DataFrame:
        """Links (a, b), staged, between nodes and the large labels that they come near: one at least for each pair of labels and block that has any.

        near: node, label, large (another label); staged.  labelled: node, label and the prints.
        """
        similarity = self.similarity

        def compare(batches):
            import pyarrow as pa

            group, ids, prints, sets, linked = None, [], [], [], set()
            for batch in batches:
                a, b = [], []
                for row in storage.rows_of([batch], ("large", "block", "role", "node", "label", *_NAMES, "hashes")):
                    large, block, role, node, label = row[:5]
                    if group != (large, block):
                        group, ids, prints, sets, linked = (large, block), [], [], [], set()
                    own = np.frombuffer(row[-1], "<u8")
                    if not role:
                        ids.append(node)
                        prints.append(row[5:-1])
                        sets.append(own)
                        continue
                    if isinstance(prints, list):
                        prints = np.array(prints, dtype=np.int64).reshape(-1, PRINTS).view(np.uint64)
                    if label in linked:
                        continue
                    apart = np.bitwise_count(prints ^ np.array(row[5:-1], dtype=np.int64).view(np.uint64)).sum(axis=1)
                    for j in np.argsort(apart, kind="stable").tolist():
                        if apart[j] > RADIUS:
                            break
                        both = np.intersect1d(own, sets[j], assume_unique=True).size
                        if both >= similarity * (own.size + sets[j].size - both):
                            a.append(ids[j])
                            b.append(node)
                            linked.add(label)
                            break
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        large = storage.bounded(near.select(F.col("large").alias("label")).distinct())
        members = storage.staged(labelled.join(large, "label").select(F.col("label").alias("large"), "node"), "of-large")
        stored = self.sets(members.select("node").unionByName(near.select("node")).distinct())
        sets = stored.hint("merge")
        prints = labelled.select("node", "label", *_NAMES)
        mine = members.join(sets, "node").select("large", "node", F.length("hashes").alias("size"))
        blocks = storage.staged(mine.groupBy("large").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_BYTES, F.lit(1))).cast("int").alias("n")), "blocks")
        ours = members.join(blocks, "large").select("large", F.pmod(F.xxhash64("node"), F.col("n")).cast("int").alias("block"), F.lit(0).alias("role"), "node")
        theirs = near.join(blocks, "large").select("large", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"), F.lit(1).alias("role"), "node")
        met = ours.unionByName(theirs).join(prints, "node").join(sets, "node").repartition("large", "block").sortWithinPartitions("large", "block", "role")
        met = met.select("large", "block", "role", "node", "label", *_NAMES, "hashes")
        out = storage.staged(storage.arrow_map(met, compare, "a long, b long"), "alike")
        storage.remove(members, stored, blocks)
        return out


def _labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    member = components(edges)
    out = storage.staged(nodes.join(member, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"), "labelled")
    storage.remove(member)
    return out


def _led(members: DataFrame, leaders: DataFrame) -> DataFrame:
    """a, b: each node b of the members (k, node, label, prints) and its closest leader a of another label among those (one a key k) of its keys."""
    near = members.join(leaders, "k").where((F.col("l.label") != F.col("label")) & (_apart("", "l.") <= RADIUS))
    best = near.groupBy("node").agg(F.min_by("l.node", _apart("", "l.")).alias("a"))
    return storage.staged(best.select("a", F.col("node").alias("b")), "led")


def _leaders(members: DataFrame, turn: int) -> DataFrame:
    order = F.xxhash64("node", F.lit(turn)).alias("o")
    return members.groupBy("k").agg(F.min(F.struct(order, "node", "label", *_NAMES)).alias("l"), F.count(F.lit(1)).alias("n"))


def links(nodes: DataFrame, verifier: _Verifier) -> DataFrame:
    """Verified pairs (a, b) that join what all pairs that meet in the index and are alike join.  nodes: node and the prints, staged."""
    labelled = nodes.withColumn("label", F.col("node"))
    members = _wholes(labelled)
    found = verifier.alike(_led(members, _leaders(members, 0).where("n > 1").drop("n")))
    full = storage.staged(members.groupBy("k").count().where(F.col("count") > FULL).select("k"), "full")
    # Only the nodes of full buckets are looked at turn by turn.
    inside = storage.staged(members.drop("label").join(storage.bounded(full), "k"), "inside")
    for turn in range(1, 1 if full.isEmpty() else TURNS + 1):
        own = _labelled(inside, found)
        major = storage.staged(own.groupBy("k", "label").count().groupBy("k").agg(F.max_by("label", "count").alias("major")), "major")
        held = own.join(storage.bounded(major), "k")
        more = verifier.alike(_led(held.where("label <> major").drop("major"), _leaders(held.where("label = major"), turn).drop("n")))
        storage.remove(own, major)
        if more.isEmpty():
            break
        both = storage.staged(found.unionByName(more), "found")
        storage.remove(found, more)
        found = both
    labelled = _labelled(nodes, found)
    rows = [_variants(labelled, 0), _variants(labelled, 1)]
    wild = F.shiftright("x.k", 32) >= PRINTS * SEGMENTS
    unlike = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    near = F.bit_count(unlike) <= PRINT_RADIUS
    # A pair counts at the first segment of a print in which it meets.
    segment = F.when(wild, F.floor((F.shiftright("x.k", 32) - PRINTS * SEGMENTS) / _LONGEST)).otherwise(F.shiftright("x.k", 32)) % SEGMENTS
    for s, mask in enumerate(_MASKS[:-1]):
        near = near & ((segment <= s) | (F.bit_count(unlike.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))) > 1))
    other = F.col("x.label") != F.col("y.label")
    sides = (F.col("x.side") == 2) | (F.col("x.side") != F.col("y.side"))
    pair = [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")]
    large = storage.staged(labelled.groupBy("label").count().where(F.col("count") >= LARGE), "large")
    some = not large.isEmpty()
    if some:
        of_large = labelled.join(storage.bounded(large), "label")
        counts = storage.staged(_variants(of_large, None).groupBy("k", "label").count().groupBy("k").agg(F.max_by("label", "count").alias("major")), "major")
        rows = [r.join(storage.bounded(counts), "k", "left_anti") for r in rows]
    met = rows[0].alias("x").join(rows[1].hint("merge").alias("y"), "k").where(other & near & (wild | (F.col("x.node") < F.col("y.node")))).select(*pair)
    if some:
        minor = storage.staged(_variants(labelled, None).join(storage.bounded(counts), "k").where("label <> major"), "minor")
        met = met.unionByName(minor.alias("x").join(minor.alias("y"), "k").where(other & near & sides & (F.col("x.node") < F.col("y.node"))).select(*pair))
        theirs = _variants(of_large, None).hint("merge").alias("y")
        close = minor.alias("x").join(theirs, (F.col("x.k") == F.col("y.k")) & (F.col("x.major") == F.col("y.label")) & near & sides, "left_semi")
        close = storage.staged(close.select("node", "label", F.col("major").alias("large")).distinct(), "near-large")
        found = storage.staged(found.unionByName(verifier.near_large(close, labelled)), "found")
    prints = nodes.select("node", *_NAMES)
    both = met.distinct().join(prints.select(F.col("node").alias("a"), F.struct(*_NAMES).alias("u")), "a").join(prints.select(F.col("node").alias("b"), F.struct(*_NAMES).alias("v")), "b")
    pairs = storage.staged(both.where(_apart("u.", "v.") <= RADIUS).select("a", "b"), "pairs")
    return storage.staged(found.unionByName(verifier.alike(pairs)), "links")


def keep_first(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs, with all its columns, but of each group of near-duplicates only the row with the smallest doc_id."""
    key = [F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h")]
    rows = docs.select(*key, F.col("text").cast("string").alias("text")).where("id is not null")
    known = storage.staged(_known(rows, words), "known")
    nodes = known.groupBy("d0", "d1").agg(*(F.min(n).alias(n) for n in _NAMES), F.min(F.struct("id", "h")).alias("rep"), F.count(F.lit(1)).alias("n"))
    nodes = storage.staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    proper = links(nodes.select("node", *_NAMES), _Verifier(rows, nodes.select("node", "rep"), words, similarity))
    member = nodes.join(components(proper), "node", "left").withColumn("root", F.coalesce("component", "node"))
    member = storage.staged(member.select("d0", "d1", "rep", "n", "root"), "members")
    first = member.groupBy("root").agg(F.min("rep").alias("first"), F.sum("n").alias("all")).where(F.col("all") > 1).select("root", "first")
    of = member.join(first, "root").select("d0", "d1", "first")
    lost = known.join(of, ["d0", "d1"]).where(F.struct("id", "h") != F.col("first")).select("id", "h").distinct()
    lost = storage.staged(lost, "lost")
    # Names of docs' own columns are put into a struct, so that none can clash.
    kept = docs.select(*key, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).join(storage.bounded(lost), ["id", "h"], "left_anti")
    twice = storage.staged(known.groupBy("id", "h").count().where("count > 1").drop("count"), "twice")
    if not twice.isEmpty():
        one = kept.join(storage.bounded(twice), ["id", "h"], "left_semi").dropDuplicates(["id", "h"])
        kept = kept.join(storage.bounded(twice), ["id", "h"], "left_anti").unionByName(one)
    return kept.select("row.*")
