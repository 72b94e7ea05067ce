"""Token counts of whole texts by a compiled transducer (see ``token_transducer``).

Null texts count as empty and have no token.  Special strings inside texts count one token each, as the library's
default has it.  Texts of any length are run whole; a slice holds about ``storage.BATCH_CHARS`` characters or one text.
Repeated rows give repeated rows, no rows give none, other columns are not read.  No shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import storage, wordbpe
from .token_transducer import Transducer, symbols_of

_MADE: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One a process: what a worker has compiled serves all its tasks."""
    if path not in _MADE:
        _MADE[path] = Transducer(path)
    return _MADE[path]


def without_special(texts: list[str], special) -> tuple[list[str], np.ndarray]:
    """Texts with a line end for each special string, and how many each had."""
    n = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        for s in special:
            if s in t:
                n[i] += t.count(s)
                t = t.replace(s, "\n")
        texts[i] = t
    return texts, n


def count_texts(path: str, texts: list[str | None]) -> np.ndarray:
    """Tokens of each text; those with code points that the transducer's alphabet of classes doesn't know are counted by the library."""
    machine = transducer(path)
    plain, extra = without_special([t or "" for t in texts], machine.spec.special)
    for i, t in enumerate(plain):
        if wordbpe.unknown(t):
            extra[i] += len(wordbpe.encoder(path).library.encode(t, add_special_tokens=False).ids)
            plain[i] = ""
    symbols, bounds = symbols_of(plain)
    _, emitted = machine.run(symbols, want_tokens=False)
    upto = np.concatenate(([0], np.cumsum(emitted, dtype=np.int64)))
    return upto[bounds[1:]] - upto[bounds[:-1]] + extra


def token_counts(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of each row of docs (doc_id, text)."""

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in storage.slices(batches, "text"):
            n = count_texts(path, batch["text"].to_pylist())
            size = pc.fill_null(pc.binary_length(batch["text"]), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(storage.as_long("doc_id").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return storage.arrow_map(rows, count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), wordbpe.vocabulary_path(), limit=2048)
