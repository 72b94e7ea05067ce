"""Spellings and noise words mined from true pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compare import jaro_winkler_sim
from ..functions.text import skeleton, tokens
from .checkpoints import checkpointed


def counted(pairs: DataFrame) -> DataFrame:
    """pair, text_a, text_b, n: the different pairs of texts and how many pairs have them; words are cut and compared once for each."""
    return pairs.groupBy("text_a", "text_b").agg(F.count(F.lit(1)).alias("n")).withColumn("pair", F.struct("text_a", "text_b"))


def leftovers(pairs: DataFrame) -> DataFrame:
    """pair, n, a, b: the distinct words that only one side of a pair has.  pairs: as ``counted`` gives them."""
    a, b = tokens(F.col("text_a")), tokens(F.col("text_b"))
    return pairs.select("pair", "n", F.array_except(a, b).alias("a"), F.array_except(b, a).alias("b"))


def aligned(pairs: DataFrame, least: float = 0.75) -> DataFrame:
    """n, variant, canonical of every pair: a single leftover with a single one, else each variant with its likest, if like enough."""
    rest = leftovers(pairs).where((F.size("a") > 0) & (F.size("b") > 0))
    single = rest.where((F.size("a") == 1) & (F.size("b") == 1)).select("pair", "n", F.get("b", F.lit(0)).alias("variant"), F.get("a", F.lit(0)).alias("canonical"))
    many = rest.where((F.size("a") > 1) | (F.size("b") > 1)).select("pair", "n", F.posexplode("b").alias("vi", "variant"), "a").select("pair", "n", "vi", "variant", F.posexplode("a").alias("ci", "canonical"))
    many = many.withColumns({"alike": skeleton(F.col("variant")) == skeleton(F.col("canonical")), "sim": jaro_winkler_sim(F.col("canonical"), F.col("variant"))})
    best = Window.partitionBy("pair", "vi").orderBy(F.col("alike").desc(), F.col("sim").desc(), "ci")
    found = many.withColumn("__n", F.row_number().over(best)).where((F.col("__n") == 1) & (F.col("alike") | (F.col("sim") >= least)))
    return single.unionByName(found.select("pair", "n", "variant", "canonical"))


def mine_variants(pairs: DataFrame, min_count: int = 15, min_ratio: float = 0.6, least: float = 0.75) -> DataFrame:
    """variant, canonical, n: what a word is written for often and mostly; a canonical form is never itself replaced."""
    pairs = checkpointed(counted(pairs))
    counts = aligned(pairs, least).groupBy("variant", "canonical").agg(F.sum("n").alias("n"))
    seen = leftovers(pairs).select("n", F.explode("b").alias("variant")).groupBy("variant").agg(F.sum("n").alias("seen"))
    good = counts.where((F.col("variant") != F.col("canonical")) & (F.length("variant") > 1) & ~F.col("variant").rlike(r"^\d+$") & (F.col("n") >= min_count)).join(seen, "variant").where(F.col("n") / F.col("seen") >= min_ratio)
    best = good.groupBy("variant").agg(F.max_by("canonical", F.struct(F.col("n"), F.col("canonical"))).alias("canonical"), F.max("n").alias("n"))
    return best.join(best.select(F.col("variant").alias("canonical")), "canonical", "left_anti").select("variant", "canonical", "n")


def mine_noise(pairs: DataFrame, min_count: int = 15, min_ratio: float = 0.6) -> DataFrame:
    """word, one_sided, total: words that stand on one side only in most of the true pairs that have them."""
    a, b = (F.array_distinct(tokens(F.col(c))) for c in ("text_a", "text_b"))
    rows = counted(pairs).select("n", F.explode(F.array_union(a, b)).alias("word"), a.alias("a"), b.alias("b"))
    one = ~(F.array_contains(F.col("a"), F.col("word")) & F.array_contains(F.col("b"), F.col("word")))
    counts = rows.groupBy("word").agg(F.sum(F.when(one, F.col("n")).otherwise(0)).alias("one_sided"), F.sum("n").alias("total"))
    return counts.where((F.col("total") >= min_count) & (F.col("one_sided") / F.col("total") >= min_ratio))
