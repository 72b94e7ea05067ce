"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of 1 to 3 characters of the lower-cased text, other things than letters counting as one blank, are hashed into ``BUCKETS``.  A text's vector is
(1 + ln tf) * idf at unit length.  Document frequencies are counted over all documents that may be learned from.  The weights are fitted on a bounded
sample of at most ``TRAIN_ROWS`` of them, spread evenly over the languages, by follow-the-regularised-leader with L1 and L2 penalties, so most stay zero.  The
temperature that scales the logits is fitted by likelihood on ``CALIBRATION_ROWS`` others.

Every text is read whole, in pieces of ``PIECE`` characters.  Texts that are null or have no letter get ``und`` with score 0, and so does every text if there is nothing to
learn from.  Rows whose doc_id or language is null are predicted but not learned from.  Repeated rows give repeated rows, no rows none; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage, wordbpe

BUCKETS = 1 << 16
TRAIN_ROWS, CALIBRATION_ROWS = 4_000, 1_000
PIECE = 1_000_000
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 0.02, 0.05, 3
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - 16)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a whole text, the same whatever ``PIECE`` is; both empty if it has no letter."""
    total, within, any_letter = np.zeros(BUCKETS, dtype=np.int64), False, False
    # The letters, one blank before the first, one after each run, and one more at the end; its last two go with the next piece.
    last = np.array([32], dtype=np.uint64)
    text = (text or "").replace("Σ", "σ")  # the one letter whose lower case depends on its neighbours
    for a in range(0, len(text), PIECE):
        cp = wordbpe.code_points(text[a : a + PIECE].lower())
        letter = wordbpe.classes()[cp] == wordbpe.LETTER
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= within
        within, any_letter = bool(letter[-1]), any_letter or bool(letter.any())
        new = np.where(letter, cp, 32)[keep].astype(np.uint64)
        if a + PIECE >= len(text):
            new = np.append(new, np.uint64(32))
        c = np.concatenate((last, new))
        two = c[:-1] * np.uint64(0x110000) + c[1:]
        three = two[:-1] * np.uint64(0x110000) + c[2:]
        code = np.concatenate((new[new != 32], two[len(last) - 1 :], three))
        total += np.bincount(((code + np.uint64(1)) * _ODD >> _SHIFT).astype(np.int64), minlength=BUCKETS)
        last = c[-2:]
    if not any_letter:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(total)
    return at, total[at]


def vector(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(counts)) * idf[at]
    return v / (math.sqrt(float(v @ v)) or 1.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit(rows: list[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, k: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) by FTRL-proximal with an elastic net.  rows: (buckets, values)."""
    z, n = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
    bias, bias_n = np.zeros(k), np.full(k, 1e-6)

    def weights(at):
        part, size = z[at], (BETA + np.sqrt(n[at])) / ALPHA + L2
        return np.where(np.abs(part) <= L1, 0.0, -(part - np.sign(part) * L1) / size)

    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            w = weights(at)
            error = softmax(v @ w + bias)
            error[classes[i]] -= 1
            g = v[:, None] * error
            squares = n[at]
            sigma = (np.sqrt(squares + g * g) - np.sqrt(squares)) / ALPHA
            z[at] += g - sigma * w
            n[at] = squares + g * g
            bias_n += error * error
            bias -= 0.1 * error / np.sqrt(bias_n)
    return weights(np.arange(BUCKETS)).astype(np.float32), bias.astype(np.float32)


def temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature of largest likelihood, by golden section over its logarithm.

    One more row than there are is taken to be spread evenly over the classes, else rows without an error would ask for no temperature at all.
    """
    if not len(logits):
        return 1.0
    even = 1 / (len(logits) + 1)

    def loss(t: float) -> float:
        x = logits / math.exp(t)
        x = x - x.max(axis=1, keepdims=True)
        logs = np.log(np.exp(x).sum(axis=1, keepdims=True)) - x
        return float((1 - even) * logs[np.arange(len(x)), classes].mean() + even * logs.mean())

    lo, hi, r = math.log(0.02), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _frequencies(learn: DataFrame) -> tuple[int, np.ndarray]:
    """(documents, of them with each bucket), over all of learn.  A task sends a row a bucket; the sums are BUCKETS rows."""

    def count(batches):
        import pyarrow as pa

        total, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in storage.slices(batches, "text"):
            for t in batch["text"].to_pylist():
                total[ngrams(t)[0]] += 1
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["bucket", "n"])

    sums = storage.arrow_map(learn.select("text"), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    at, n = sums["bucket"].to_numpy(dtype=np.int64), sums["n"].to_numpy(dtype=np.int64)
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return int(n[at < 0].sum()), out


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, heat: float):
        self.langs, self.idf, self.weights, self.bias, self.heat = langs, idf, weights, bias, heat

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return vector(at, counts, self.idf).astype(np.float32) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        at, counts = ngrams(text)
        if not at.size or not self.langs:
            return "und", 0.0
        p = softmax(self.logits(at, counts).astype(np.float64) / self.heat)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def train(docs: DataFrame) -> Model:
    """A model from docs (doc_id, text, lang), leaving out those held out."""
    learn = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    totals = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}
    langs = sorted(totals)
    n, df = _frequencies(learn)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    if not langs:
        return Model([], idf, np.zeros((BUCKETS, 0), dtype=np.float32), np.zeros(0, dtype=np.float32), 1.0)
    share = (TRAIN_ROWS + CALIBRATION_ROWS) / len(langs)
    chance = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(share / totals[lang])) for lang in langs))
    draw = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    own = learn.where(draw < chance).withColumn("fitted", F.pmod(F.xxhash64("text", "doc_id"), F.lit(TRAIN_ROWS + CALIBRATION_ROWS)) < TRAIN_ROWS)

    def features(batches):
        import pyarrow as pa

        for batch in storage.slices(batches, "text"):
            rows = [ngrams(t) for t in batch["text"].to_pylist()]
            at = [a.astype("<u2").tobytes() for a, _ in rows]
            counts = [c.astype("<u4").tobytes() for _, c in rows]
            yield pa.RecordBatch.from_arrays([batch["lang"], batch["fitted"], pa.array(at, pa.binary()), pa.array(counts, pa.binary())], names=["lang", "fitted", "at", "counts"])

    # The limit only matters where many rows are equal in doc_id and text; it keeps the sample bounded there too.
    sample = storage.arrow_map(own.select("lang", "fitted", "text"), features, "lang string, fitted boolean, at binary, counts binary").limit(2 * (TRAIN_ROWS + CALIBRATION_ROWS)).collect()
    index = {lang: i for i, lang in enumerate(langs)}
    parts: dict[bool, list] = {True: [], False: []}
    for r in sample:
        parts[r["fitted"]].append((np.frombuffer(r["at"], dtype="<u2").astype(np.int64), np.frombuffer(r["counts"], dtype="<u4"), index[r["lang"]]))
    del sample
    fitted, rest = parts[True] or parts[False], parts[False]
    fitted.sort(key=lambda x: (x[2], x[0].size, int(x[1].sum()), x[0].tobytes()))  # whatever order they came in
    weights, bias = fit([(a, vector(a, c, idf)) for a, c, _ in fitted], np.array([k for *_, k in fitted], dtype=np.int64), len(langs))
    model = Model(langs, idf, weights, bias, 1.0)
    model.heat = temperature(np.array([model.logits(a, c) for a, c, _ in rest], dtype=np.float64), np.array([k for *_, k in rest], dtype=np.int64))
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs; only its text is looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of a weight a language

    def run(batches):
        import pyarrow as pa

        for batch in storage.slices(batches, "text"):
            got = [sent.value.predict(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return storage.arrow_map(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(storage.as_long("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return identify(docs, train(docs))
