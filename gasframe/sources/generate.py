"""Random graphs for the built-in programs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gasframe.operators.graph import Graph

APPS = ("sssp", "pagerank", "bfs", "ar", "wcc", "cc", "coloring", "als")


class GenerateError(ValueError):
    """A graph that cannot be: UnknownApp, InvalidNodeCount, InvalidEdgeCount or EdgeCountTooLarge."""


def _hashed(seed: int, salt: str, *cols) -> Column:
    """A reproducible number in [0, 2^40) for a row."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *cols), F.lit(1 << 40))


def _unit(seed: int, salt: str, *cols) -> Column:
    return _hashed(seed, salt, *cols) / float(1 << 40)


#: Edges that one task draws at once, about, and the most cells of the nodes x nodes square that it draws them from.
LEAF_EDGES, LEAF_CELLS = 1 << 18, 1 << 62
#: Beyond so many cells, numpy's draw without replacement gives way to one with replacement, which is then as good.
_EXACT = 10**9


def _left_share(rng: np.random.Generator, edges: int, left: int, right: int) -> int:
    """How many of ``edges`` cells, drawn without replacement, fall in the left part of two."""
    if not edges or not right:
        return edges
    if left + right < _EXACT:
        return int(rng.hypergeometric(left, right, edges))
    return min(max(int(rng.binomial(edges, left / (left + right))), edges - right), edges, left)


def leaf(seed: int, nodes: int, edges: int, leaves: int, at: int) -> tuple[int, int, int, int]:
    """(first source, sources, edges, edges before) of range ``at`` of ``leaves`` ranges of sources.

    The square of pairs is halved again and again, and each half gets its share of the edges by a draw that depends on the
    seed and its place alone; so a task knows its range's edges, and how many lie before, without the others.
    """
    low, high, before, n = 0, leaves, 0, edges
    row = lambda k: k * nodes // leaves
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = _left_share(rng, n, (row(middle) - row(low)) * nodes, (row(high) - row(middle)) * nodes)
        if at < middle:
            high, n = middle, left
        else:
            low, before, n = middle, before + left, n - left
    return row(low), row(high) - row(low), n, before


def _cells(rng: np.random.Generator, cells: int, n: int) -> np.ndarray:
    """``n`` different numbers below ``cells``, ascending, each set as likely as another."""
    if cells <= 4 * n:
        return np.sort(rng.permutation(cells)[:n])
    held = np.zeros(0, np.int64)
    while len(held) < n:
        drawn = np.concatenate([held, rng.integers(0, cells, n - len(held) + 16)])
        held = drawn[np.sort(np.unique(drawn, return_index=True)[1])][:n]
    return np.sort(held)


def _pairs(spark: SparkSession, nodes: int, edges: int, seed: int) -> DataFrame:
    """(eid, src, dst): exactly ``edges`` distinct pairs, each pair as likely as another, numbered by (src, dst)."""
    leaves = min(nodes, max(-(-edges // LEAF_EDGES), -(-nodes * nodes // LEAF_CELLS)))
    schema = pa.schema([(c, pa.int64()) for c in ("eid", "src", "dst")])

    def draw(batches):
        for batch in batches:
            for at in batch.column(0).to_pylist():
                low, rows, n, before = leaf(seed, nodes, edges, leaves, at)
                cell = _cells(np.random.default_rng([seed, at, leaves, 1]), rows * nodes, n)
                for cut in range(0, n, 1 << 16):
                    some = cell[cut : cut + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(before + cut + np.arange(len(some))), pa.array(low + some // nodes), pa.array(some % nodes)], schema=schema)

    return spark.range(0, leaves, 1, min(leaves, 1 << 16)).mapInArrow(draw, "eid long, src long, dst long")


def generate_graph(spark: SparkSession, app: str, nodes: int, edges: int, seed: int = 42) -> Graph:
    """A graph of ``nodes`` nodes and ``edges`` distinct directed edges (loops allowed), with first values for ``app``.

    The same arguments give the same graph, however it is partitioned; ``eid`` numbers edges by (src, dst).
    """
    if app not in APPS:
        raise GenerateError(f"UnknownApp: {app}")
    if nodes <= 0:
        raise GenerateError(f"InvalidNodeCount: {nodes}")
    if edges <= 0:
        raise GenerateError(f"InvalidEdgeCount: {edges}")
    if edges > nodes * nodes:
        raise GenerateError(f"EdgeCountTooLarge: {edges} > {nodes * nodes}")
    e = _pairs(spark, nodes, edges, seed)
    draw = lambda salt, low, high: (F.lit(low) + F.floor(_unit(seed, salt, "id") * (high - low))).cast("bigint")
    n = spark.range(nodes)
    if app in ("pagerank", "ar"):
        degree = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
        n = n.join(degree, "id", "left").withColumn("d", F.coalesce("d", F.lit(0)))
    root, big = F.col("id") == 0, lambda v: F.lit(v).cast("bigint")
    props = {
        "sssp": {"dist": F.when(root, big(0)).otherwise(draw("dist", 5, 50))},
        "pagerank": {"rank": 0.5 + _unit(seed, "rank", "id"), "out_deg": F.greatest("d", big(1)) if app == "pagerank" else None},
        "bfs": {"prop": F.when(root, big(0x80000001)).otherwise(big(0x7FFFFFFE))},
        "ar": {"score": big(0), "out_deg": F.greatest(F.col("d") + edges // nodes, big(1)) if app == "ar" else None},
        "wcc": {"label": F.when(root, big(1)).otherwise(big(0))},
        "cc": {"label": F.col("id")},
        "coloring": {"color": F.col("id"), "priority": draw("priority", 0, 1000)},
        "als": {"vec": F.array(*(_unit(seed, f"vec{i}", "id") for i in range(16)))},
    }[app]
    extra = {"sssp": [(F.lit(1) + F.floor(_unit(seed, "weight", "src", "dst") * 9)).cast("bigint").alias("weight")], "als": [(_unit(seed, "rating", "src", "dst") * 5).alias("rating")]}
    return Graph(n.withColumns(props).drop("d"), e.select("eid", "src", "dst", *extra.get(app, [])))
