"""Quality rules whose cutoffs carry a guarantee on labelled holdouts.

Each rule is a score of the text, higher being worse.  For every stratum (``lang``; null is a stratum of its own, ``und``) the good
documents among the labelled ones are a sample of those that a cutoff may wrongly reject.  Cutoffs of a fixed grid are tested from the most
lenient on: H0 says that the cutoff rejects a share of good documents above ``risk / rules``.  Its exact binomial p-value must not exceed
``level / (strata * rules)`` (Bonferroni); the walk along a grid stops at the first cutoff that fails, which needs no further correction
(fixed-sequence testing).  So with probability 1 - level, in every stratum the rules together reject at most a share ``risk`` of
good documents, whichever certified cutoffs are used.  Of these the one with the largest share of bad rejected less ``WEIGHT`` times the
share of good ones is taken; a rule without a useful one is off in that stratum.

The bound is for independent trials, so labelled documents of one text are one trial, good if any of them is.  Near copies are still trials
of their own: where a corpus has many among its labelled documents the bound is that much weaker.  "Good documents" are those that the base rules keep.

Null texts have no words.  A doc_id with several labels is good if any label says so; null labels, and labels of unknown ids, are ignored.  Without
labels only the base rules hold.  Rows are never merged: repeated rows give repeated rows, no rows none.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage

#: Rule: its grid of cutoffs, from the most lenient; a score above the cutoff rejects.
GRIDS = {
    "symbols_per_word": [3.0, 2.5, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "repeated_lines": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2],
    "repeated_words": [0.2, 0.19, 0.18, 0.16, 0.14, 0.12, 0.1],
    "long_words": [14.0, 12.0, 11.0, 10.0, 9.5, 9.0, 8.5, 8.0, 7.5, 7.0, 6.5],
    "short_words": [-1.5, -2.0, -2.5, -3.0, -3.25, -3.5, -3.75, -4.0, -4.25, -4.5],
}
WEIGHT = 20
#: More strata than this are joined by shuffle, fewer by broadcast.
FEW_STRATA = 5_000
BLANKS = " \t\n\r\x0b\x0c"
#: Above so many words 5-word windows are numbered with numpy rather than kept as tuples.
MANY_WORDS = 50_000
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def repeat_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that stand at least twice in the list, the first time included."""
    if len(words) < 6:
        return 0
    if len(words) <= MANY_WORDS:
        grams = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(grams)) == len(grams):
            return 0
        count = Counter(grams)
        twice = np.fromiter((count[g] > 1 for g in grams), dtype=bool, count=len(grams))
    else:
        number: dict[bytes, int] = {}
        one = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
        code = one
        for k in range(1, 5):
            pairs = code[:-1] * len(number) + one[k:]
            code = np.unique(pairs, return_inverse=True)[1]
        twice = np.bincount(code)[code] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(5):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The ``MEASURES`` of a whole text."""
    if not text:
        return (0,) * 6
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    blank = sum(map(text.count, BLANKS))
    return len(words), len(text) - blank, sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), repeat_words(words), len(lines)


def with_measures(df: DataFrame, drop_text: bool = False, name: str = "__measures") -> DataFrame:
    """All columns of df (without text if so wanted) and a struct of the ``MEASURES`` of its text."""
    kept = [f for f in df.schema.fields if not (drop_text and f.name == "text")]
    schema = T.StructType([*kept, T.StructField(name, T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))])
    position = df.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in storage.slices(batches, position):
            rows = np.array([measure(t) for t in batch.column(position).to_pylist()], dtype=np.int64).reshape(-1, len(MEASURES))
            struct = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(MEASURES))], names=MEASURES)
            columns = [c for k, c in enumerate(batch.columns) if not (drop_text and k == position)]
            yield pa.RecordBatch.from_arrays([*columns, struct], names=[f.name for f in schema.fields])

    return storage.arrow_map(df, run, schema)


def _scores(m: str) -> dict[str, F.Column]:
    words, lines = F.nullif(F.col(f"{m}.n_words"), F.lit(0)), F.nullif(F.col(f"{m}.n_lines"), F.lit(0))
    return {
        "symbols_per_word": F.col(f"{m}.n_symbols") / words,
        "repeated_lines": F.col(f"{m}.n_dup_lines") / lines,
        "repeated_words": F.col(f"{m}.n_repeat_words") / words,
        "long_words": F.col(f"{m}.word_chars") / words,
        "short_words": -F.col(f"{m}.word_chars") / words,
    }


def base_failed(m: str = "__measures") -> F.Column:
    return (F.col(f"{m}.n_words") < 10) | (100 * F.col(f"{m}.n_repeat_words") > 20 * F.col(f"{m}.n_words"))


def _stratum(c: str = "lang") -> F.Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("und"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of X ~ Binomial(n, p), by the continued fraction of the incomplete beta function."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p  # I_{1-p}(n-k, k+1)
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 1_000_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            f *= step
        if abs(step - 1) < 1e-14:
            break
    value = min(1.0, max(0.0, front * f))
    return 1 - value if flip else value


def choose(grid: list[float], good: list[int], bad: list[int], risk: float, level: float) -> float | None:
    """The cutoff of one rule and stratum, or None.  good, bad: documents by how many cutoffs of the grid they exceed."""
    n_good, n_bad = sum(good), sum(bad)
    best, gain = None, 0.0
    for i, cutoff in enumerate(grid):  # what exceeds this cutoff exceeds all stricter ones, so len(grid) - i at least
        k = sum(good[len(grid) - i :])
        if not n_good or binomial_tail(k, n_good, risk) > level:
            break
        use = (sum(bad[len(grid) - i :]) / n_bad if n_bad else 0.0) - WEIGHT * k / n_good
        if use > gain:
            best, gain = cutoff, use
    return best


def _text_hash() -> F.Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.05, level: float = 0.05) -> DataFrame:
    """stratum, rule, cutoff for every certified and useful cutoff.  measured: doc_id, __stratum, __copy (a hash of the text), __measures; labels: doc_id, quality."""
    known = labels.select(storage.as_long("doc_id").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = measured.where(~base_failed()).join(known, "doc_id")
    rows = rows.groupBy("__stratum", "__copy", "__measures").agg(F.max("quality").alias("quality"))
    scored = [F.struct(F.lit(rule).alias("rule"), sum(F.when(score > c, 1).otherwise(0) for c in GRIDS[rule]).alias("above")) for rule, score in _scores("__measures").items()]
    counts = rows.select("__stratum", "quality", F.explode(F.array(*scored)).alias("s")).groupBy("__stratum", "s.rule", "s.above").agg(F.sum(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") > 0, 0).otherwise(1)).alias("bad"))
    counts = storage.staged(counts, "quality-counts")
    strata = max(1, counts.select("__stratum").distinct().count())

    def pick(key, pdf):
        import pandas as pd

        grid = GRIDS[key[1]]
        good, bad = [0] * (len(grid) + 1), [0] * (len(grid) + 1)
        for above, g, b in zip(pdf["above"], pdf["good"], pdf["bad"]):
            good[int(above)] += int(g)
            bad[int(above)] += int(b)
        got = choose(grid, good, bad, risk / len(GRIDS), level / (strata * len(GRIDS)))
        return pd.DataFrame([(key[0], key[1], got)] if got is not None else [], columns=["stratum", "rule", "cutoff"])

    return storage.staged(counts.groupBy("__stratum", "rule").applyInPandas(pick, "stratum string, rule string, cutoff double"), "quality-cutoffs")


def judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """measured (with __stratum and __measures) and a boolean __kept: no base rule and no cutoff of the stratum speaks against the row."""
    wide = limits.groupBy("stratum").pivot("rule", list(GRIDS)).agg(F.max("cutoff"))
    wide = wide.select(F.col("stratum").alias("__stratum"), *(F.col(r).alias(f"__cut_{r}") for r in GRIDS))
    few = limits.select("stratum").distinct().limit(FEW_STRATA + 1).count() <= FEW_STRATA
    rows = measured.join(F.broadcast(wide) if few else wide, "__stratum", "left")
    over = [F.coalesce(score > F.col(f"__cut_{r}"), F.lit(False)) for r, score in _scores("__measures").items()]
    out = base_failed()
    for x in over:
        out = out | x
    return rows.withColumn("__kept", ~out).drop(*(f"__cut_{r}" for r in GRIDS))


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, level: float = 0.05) -> DataFrame:
    """doc_id, the ``MEASURES`` but n_lines, base_failed and kept of every row of docs (doc_id, text and the stratum's column)."""
    rows = docs.select(storage.as_long("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"), _stratum(stratum).alias("__stratum"), _text_hash().alias("__copy"))
    measured = storage.staged(with_measures(rows, drop_text=True), "quality-measures")
    verdict = judged(measured, cutoffs(measured, labels, risk, level))
    return verdict.select("doc_id", *(F.col(f"__measures.{m}").alias(m) for m in MEASURES[:5]), base_failed().alias("base_failed"), F.col("__kept").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, level: float = 0.05) -> DataFrame:
    """The rows of docs that no rule rejects, with the columns that docs has.  Cutoffs come from the labelled rows of docs."""
    # All rows are measured twice rather than labelled ones picked out first: a join would move whole texts.
    skinny = docs.select(storage.as_long("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"), _stratum(stratum).alias("__stratum"), _text_hash().alias("__copy"))
    limits = cutoffs(with_measures(skinny, drop_text=True), labels, risk, level)
    rows = with_measures(docs.withColumn("__stratum", _stratum(stratum)))
    return judged(rows, limits).where("__kept").select(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
