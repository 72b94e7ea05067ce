"""Shards of near-equal bytes by sampled splitters.  DataFrame operations only.

Records are ordered by (hash of the text, doc_id, a number of their own).  Keys are sampled with a chance in proportion to the record's size, the sample's
quantiles split the order into ranges, and every range's bytes are then summed exactly.  Ranges above twice the mean are subdivided: by new
samples within them, and where one text fills a range, by doc_id and number.  A running sum inside the ranges, added to the sums before
them, gives each record its place in the whole order.  So no task holds more than a range, not even of records that are equal in text and doc_id.

Records of one text (or, by chance of 2**-64, of one hash) are a group.  Groups above ``HEAVY`` of a shard that fit a shard are dealt out whole, the
largest first, each to the shard with the fewest bytes.  All other records then fill the shards up in order: every shard gets as many bytes as it still
lacks, and a group stays with the shard in which its middle falls.  Only groups larger than a shard are divided, record by record.

To the driver come ``SAMPLES`` keys for each range, one row for each range and shard in it, and at most shards / HEAVY groups.

Null texts weigh the 8 bytes that any record does, hash like the empty text, and stay null.  Null doc_ids come first.  Repeated rows are
records of their own.  Fewer records than shards leave shards empty.  An empty table gives no rows.  All columns of the records are kept.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import storage

RANGES_PER_SHARD, SAMPLES, MOST_RANGES = 16, 32, 65_536
#: Bytes of records that a range should have at most, while there may be more ranges.
RANGE_BYTES = 256 << 20
HEAVY = 1 / 64
RECORD_BYTES = 8
_PREFIXES = 4096


def _key(h: str = "h", doc_id: str = "doc_id", own: str = "own") -> list[F.Column]:
    return [F.col(h).alias("h"), F.col(doc_id).alias("doc_id"), F.col(own).alias("own")]


def _sample(rows: DataFrame, per_byte: float, seed: int) -> list[tuple]:
    """Sampled (hash, doc_id, number, weight) in order; a record's chance is its size times ``per_byte``."""
    chance = F.col("size") * F.lit(per_byte)
    draw = F.xxhash64("h", "doc_id", "own", F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    taken = rows.where(draw < chance).select(*_key(), F.greatest(chance, F.lit(1.0)).alias("w"))
    return [tuple(r) for r in taken.orderBy("h", F.col("doc_id").asc_nulls_first(), "own").collect()]


def _splits(sample: list[tuple], pieces: int, within: bool) -> list[tuple]:
    """Keys at the sample's weighted quantiles; a text's first place in the order unless ``within`` a text."""
    step, upto, due, out = sum(x[3] for x in sample) / pieces, 0.0, 1, []
    for h, d, own, w in sample:
        upto += w
        if upto >= due * step and due < pieces:
            out.append((h, d, own) if within else (h, None, None))
            due = int(upto / step) + 1
    return sorted(set(out), key=_order)


def _order(s: tuple) -> tuple:
    return s[0], s[1] is not None, s[1] or 0, s[2] is not None, s[2] or 0


def _ranged(rows: DataFrame, splits: list[tuple]) -> DataFrame:
    """rows and their range: the number of splits at or before their key, found by the hash's first 12 bits and then among the splits there."""
    spark, table, keys = rows.sparkSession, [], [s[0] >> 52 for s in splits]
    for p in range(-_PREFIXES // 2, _PREFIXES // 2):
        lo, hi = bisect_right(keys, p - 1), bisect_right(keys, p)
        table.append((p, lo, splits[lo:hi]))
    # One row a prefix and MOST_RANGES splits in all at most: small whatever the input.
    small = F.broadcast(spark.createDataFrame(table, "p int, base int, splits array<struct<h: bigint, doc_id: bigint, own: bigint>>"))
    found = rows.withColumn("p", F.shiftright("h", 52).cast("int")).join(small, "p")
    return found.withColumn("range", F.col("base") + F.size(F.filter("splits", lambda s: s <= F.struct(*_key())))).drop("p", "base", "splits")


def balanced_ranges(rows: DataFrame, shards: int) -> tuple[DataFrame, list[tuple], int, int]:
    """(rows with range, (range, rows, bytes) in order, rows, bytes).  rows: doc_id, size, h, own."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    want = min(MOST_RANGES // 4, max(shards * RANGES_PER_SHARD, -(-total["b"] // RANGE_BYTES)))
    splits = _splits(_sample(rows, SAMPLES * want / max(1, total["b"]), 1), want, False) if total["b"] else []
    for turn in range(2, 8):
        found = _ranged(rows, splits)
        sums = sorted(tuple(r) for r in found.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"), F.min("h").alias("lo"), F.max("h").alias("hi"), (F.count(F.lit(1)) > 1).alias("several")).collect())
        mean = total["b"] / want
        full = [s for s in sums if s[2] > 2 * mean and (s[3] != s[4] or s[5])]
        if not full or len(splits) > MOST_RANGES // 2:
            break
        more, marked = set(splits), found.join(F.broadcast(rows.sparkSession.createDataFrame([(s[0],) for s in full], "range int")), "range")
        sample = _sample(marked.select("h", "doc_id", "own", "size"), SAMPLES / mean, turn)
        for s in full:
            own = [x for x in sample if s[3] <= x[0] <= s[4]]
            one = s[3] == s[4]
            if not one:
                heavy = [x[0] for x in own]
                for h in {h for h in heavy if heavy.count(h) * mean / SAMPLES > mean}:  # a text that fills a range gets one for itself
                    more |= {(h, None, None), (h + 1, None, None)} if h < (1 << 63) - 1 else {(h, None, None)}
            if own:
                more |= set(_splits(own, max(2, round(s[2] / mean)), one))
        if more == set(splits):
            break
        splits = sorted(more, key=_order)
    return found, [s[:3] for s in sums], total["n"], total["b"]


def dealt_groups(groups: list[tuple[int, int]], shards: int, total: int) -> tuple[dict[int, int], list[float]]:
    """(shard of each group, bytes that end in each shard's fill).  groups: (h, bytes) of those above HEAVY.  The second are running sums of what the shards lack."""
    load, of = [0] * shards, {}
    for h, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        if size * shards <= total:
            of[h] = min(range(shards), key=lambda s: (load[s], s))
            load[of[h]] += size
    lacks = [max(0.0, total / shards - x) for x in load]
    rest, upto, ends = total - sum(load), 0.0, []
    for x in lacks:
        upto += x * rest / (sum(lacks) or 1.0)
        ends.append(upto)
    return of, ends


def shard_records(records: DataFrame, shards: int = 24) -> DataFrame:
    """records with ``shard`` and ``slot``.  records: doc_id (bigint), size (bigint), h (bigint: a hash of the text) and any others."""
    spark = records.sparkSession
    # The number must not change when a task is run again, so it's written down.
    row = F.struct(*(F.col(f"`{c}`") for c in records.columns)).alias("row")
    rows = storage.staged(records.select("doc_id", "size", "h", F.monotonically_increasing_id().alias("own"), row), "records")
    found, sums, n, total = balanced_ranges(rows, shards)
    heavy = rows.groupBy("h").agg(F.sum("size").alias("b")).where(F.col("b") > max(total, 1) * HEAVY / shards).collect()
    of, ends = dealt_groups([tuple(r) for r in heavy], shards, total)
    small = F.broadcast(spark.createDataFrame([(h, s, True) for h, s in of.items()] + [(r["h"], None, False) for r in heavy if r["h"] not in of], "h bigint, dealt int, whole boolean"))
    found = found.join(small, "h", "left").withColumn("loose", F.when(F.col("dealt").isNull(), F.col("size")).otherwise(0))
    before, bases = 0, []
    for r, size in sorted(tuple(x) for x in found.groupBy("range").agg(F.sum("loose")).collect()):
        bases.append((r, before))
        before += size
    bases = F.broadcast(spark.createDataFrame(bases, "range int, before bigint"))
    order = [F.col("h"), F.col("doc_id").asc_nulls_first(), F.col("own")]
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("range", "h")
    placed = found.join(bases, "range").withColumn("upto", F.col("before") + F.sum("loose").over(inside))
    # Groups too large for a shard have a ``whole`` that is false; light ones are not in ``small`` and lie in one range.
    middle = F.when(F.col("whole").isNull(), F.max("upto").over(group) - F.sum("loose").over(group) / 2).otherwise(F.col("upto") - F.col("size") / 2)
    filled = F.least(F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= middle)), F.lit(shards - 1))
    placed = storage.staged(placed.select("row", "h", "doc_id", "own", "range", F.coalesce("dealt", filled).alias("shard")), "placed")
    upto, starts = [0] * shards, []
    for r, s, n in sorted(tuple(x) for x in placed.groupBy("range", "shard").count().collect()):
        starts.append((r, s, upto[s]))
        upto[s] += n
    starts = F.broadcast(spark.createDataFrame(starts, "range int, shard int, start bigint"))
    slot = F.col("start") + F.row_number().over(Window.partitionBy("range", "shard").orderBy(*order)) - 1
    return placed.join(starts, ["range", "shard"]).withColumn("slot", slot).select("row.*", "shard", "slot")


def op7_sampled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    records = docs.select(storage.as_long("doc_id").alias("doc_id"), (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    found = shard_records(records, shards=24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
