"""The driver's tables seen as linkage data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.views import Retriever


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words() -> Column:
    return F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+")


def records(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """documents as records: the first eight words are the name, the last eight the address, the language the country, the id's rest by three the source.

    What counts or joins tokens reads the whole text instead (``light``).  more: further columns of documents.
    """
    docs = table(spark, sf_dir, "documents").withColumn("w", _words())
    source = (F.col("doc_id") % 3 + 1).cast("long")
    return docs.select(
        F.concat(F.lit("S"), source, F.lit("-"), F.col("doc_id")).alias("entity_id"), F.array_join(F.slice("w", 1, 8), " ").alias("business_name"),
        F.array_join(F.slice("w", F.greatest(F.size("w") - 7, F.lit(1)), F.lit(8)), " ").alias("business_address"), F.col("lang").alias("country"), source.alias("source"), "n_chars", *more,
    )


def light(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records with ``toks``: the runs of plain letters in the whole text."""
    toks = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]+)"), F.lit(1))
    return records(spark, sf_dir, "text").select("entity_id", "country", "source", "business_name", toks.alias("toks"))


def word_view() -> Column:
    return F.col("toks")


WORDS = Retriever("words", word_view)
EVERY_WORD = Retriever("words", word_view, max_df=None)


def split_sources(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("source = 1"), df.where("source > 1")


def weak_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s1_id, cand_id: equal names and languages, lengths within five percent."""
    r = records(spark, sf_dir)
    a, b = split_sources(r)
    a = a.select(F.col("entity_id").alias("s1_id"), "business_name", "country", F.col("n_chars").alias("n_a"))
    b = b.select(F.col("entity_id").alias("cand_id"), "business_name", "country", F.col("n_chars").alias("n_b"))
    return a.join(b, ["business_name", "country"]).where("20 * abs(n_a - n_b) <= greatest(n_a, n_b)").select("s1_id", "cand_id")


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s1_id, cand_id, p, label made of lineitem's keys by arithmetic."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    s, c = F.col("l_orderkey") % 997, F.col("l_partkey")
    rows = l.select(s.alias("s"), c.alias("c"), (((F.col("l_orderkey") * 7919 + c * 104729 + F.col("l_linenumber") * 31) % 1000) / F.lit(1000.0)).alias("p"))
    rows = rows.groupBy("s", "c").agg(F.max("p").alias("p"))
    return rows.select(F.concat(F.lit("S1-"), "s").alias("s1_id"), F.concat(F.lit("S"), (F.col("c") % 2 + 2).cast("string"), F.lit("-"), "c").alias("cand_id"), "p", ((F.col("s") * 13 + F.col("c") * 7) % 4 == 0).cast("int").alias("label"))


def block_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(block, s, c, p; block, c): scored_pairs and edges by their numbers, pairs perhaps repeated with a smaller p.  A block is a brand and size, in which all edges lie; null for other pairs."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    p = ((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_linenumber") * 31) % 1000) / F.lit(1000.0)
    parts = table(spark, sf_dir, "part").where("p_brand is not null and p_size is not null").select(F.concat_ws("|", "p_brand", "p_size").alias("block"), F.col("p_partkey").alias("c"))
    pairs = l.select((F.col("l_orderkey") % 997).alias("s"), F.col("l_partkey").alias("c"), p.alias("p"))
    return pairs.join(parts, "c", "left").select("block", "s", "c", "p"), parts


def block_names(s: int, c: int) -> tuple[str, str]:
    return f"S1-{s}", f"S{c % 2 + 2}-{c}"


def block_sib(x: int, y):
    """sib of a part with each of many, as ``edges`` has it; numbers and an array of them."""
    return (x * y) % 100 / 100.0


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cand_id, nbr_id, sib among parts of one brand and size."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    a, b = p.select(F.col("p_partkey").alias("x"), "p_brand", "p_size"), p.select(F.col("p_partkey").alias("y"), "p_brand", "p_size")
    name = lambda c: F.concat(F.lit("S"), (F.col(c) % 2 + 2).cast("string"), F.lit("-"), c)
    both = a.join(b, ["p_brand", "p_size"]).where("x <> y")
    return both.select(name("x").alias("cand_id"), name("y").alias("nbr_id"), (((F.col("x") * F.col("y")) % 100) / F.lit(100.0)).alias("sib"))


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts of one brand, type and size: x, y, a, b (names)."""
    p = table(spark, sf_dir, "part")
    keys = ["p_brand", "p_type", "p_size"]
    a = p.select(F.col("p_partkey").alias("x"), F.col("p_name").alias("a"), *keys)
    b = p.select(F.col("p_partkey").alias("y"), F.col("p_name").alias("b"), *keys)
    return a.join(b, keys).where("x < y").select("x", "y", "a", "b")


def part_pairs_by_name(spark: SparkSession, sf_dir: str, measures: dict[str, Column]) -> DataFrame:
    """x, y and measures of a and b for the rows of ``part_pairs``; each measure is taken once for each different pair of names that meet."""
    keys = ["p_brand", "p_type", "p_size"]
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), *keys)
    names = parts.select("name", *keys).distinct()
    met = names.withColumnRenamed("name", "a").join(names.withColumnRenamed("name", "b"), keys)
    measured = met.select("a", "b").distinct().select("a", "b", *(c.alias(k) for k, c in measures.items()))
    m, q = met.alias("m"), measured.alias("q")
    met = m.join(q, F.col("m.a").eqNullSafe(F.col("q.a")) & F.col("m.b").eqNullSafe(F.col("q.b"))).select("m.*", *(F.col(f"q.{k}") for k in measures)).alias("m")
    x, y = parts.alias("x"), parts.alias("y")
    same = lambda l, r: [F.col(f"{l}.{k}") == F.col(f"{r}.{k}") for k in keys]
    left = x.join(met, [*same("x", "m"), F.col("x.name").eqNullSafe(F.col("m.a"))]).select(F.col("x.id").alias("x"), "m.b", *(f"m.{k}" for k in (*keys, *measures))).alias("l")
    both = left.join(y, [*same("l", "y"), F.col("l.b").eqNullSafe(F.col("y.name")), F.col("l.x") < F.col("y.id")])
    return both.select("l.x", F.col("y.id").alias("y"), *(f"l.{k}" for k in measures))
