"""Connected components of an edge table by alternating large and small stars.

Every round keeps the components and makes the graph flatter, until each node hangs on its component's smallest node.
Rounds are staged in the shared folder, so lineage stays short; only a row of totals comes to the driver.
Up to ``FEW_EDGES`` edges, which are counted first, are put together in one task instead: that needs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage


#: Edges that a task may hold: some megabytes.
FEW_EDGES = 100_000


def _in_one_task(e: DataFrame) -> DataFrame:
    """node, component of few edges (u, v), by union-find."""

    def run(batches):
        import pyarrow as pa

        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist()):
                u, v = root(u), root(v)
                parent[max(u, v)] = min(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([root(x) for x in list(parent)], pa.int64())], names=["node", "component"])

    return storage.staged(storage.arrow_map(e.repartition(1), run, "node long, component long"), "components")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node of edges (a, b).  Loops and nulls are ignored; no edges: no rows."""
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = storage.staged(e, "edges")
    if e.limit(FEW_EDGES + 1).count() <= FEW_EDGES:
        out = _in_one_task(e)
        storage.remove(e)
        return out
    before = _state(e)
    for _ in range(most_rounds):
        if not before[0]:
            break
        flatter = storage.staged(_small_star(_large_star(e)), "edges")
        storage.remove(e)
        e = flatter
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    out._staged_at = e._staged_at  # for storage.remove, when the result has been used
    return out


def _state(e: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.withColumnRenamed("m", "v")).distinct()
