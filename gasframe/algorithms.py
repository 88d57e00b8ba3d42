"""The built-in programs, and variants of them with semantics of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gasframe.operators.graph import Graph


def _program(node: str, edge: str, value: str, reducer: str, apply: str = "", target: str = "") -> str:
    """The text of a program that sends ``value`` along each edge to its destination."""
    after = f"    applied = map([got], {apply})\n" if apply else ""
    return f"""{{
    Node: {{ {node} }}
    Edge: {{ {edge} }}
}}
{{
    links = iteration_input(G.EDGES)
    to = map([links], lambda e: e.dst)
    sent = map([links], lambda e: {value})
    got = reduce(key=to, values=[sent], function={reducer})
{after}    return {"applied" if apply else "got"} as result_node_prop.{target}
}}"""


LEAST, MOST, TOTAL = "lambda a, b: a < b ? a : b", "lambda a, b: a > b ? a : b", "lambda a, b: a + b"
INF, LOW, ACTIVE = (1 << 31) - 2, (1 << 31) - 1, 1 << 31
#: 32 bits. Literals have 64, and a program whose types meet those has no mask of its own.
WORD = (1 << 32) - 1


def sssp(kind: str = "int<32>", weight: str = "int<32>", extra: int = 0) -> str:
    """Weighted shortest paths; ``extra`` edge properties that no expression reads."""
    more = "".join(f" p{i}: int<32>" for i in range(1, extra + 1))
    return _program(f"dist: {kind}", f"weight: {weight}{more}", "e.src.dist + e.weight", LEAST, "lambda d: d < self.dist ? d : self.dist", "dist")


PROGRAMS = {
    "sssp": sssp(),
    "sssp_unweighted": _program("dist: int<32>", "", "e.src.dist + 1", LEAST, "lambda d: d < self.dist ? d : self.dist", "dist"),
    "pagerank": _program("rank: float out_deg: int<32>", "", "e.src.rank", TOTAL, "lambda r: 0.15 + 0.85 * (r / self.out_deg)", "rank"),
    "cc": _program("label: int<32>", "", "e.src.label", LEAST, "", "label"),
    "wcc": _program("label: int<32>", "", "e.src.label", MOST, "", "label"),
    "bfs": _program(
        "prop: int<32>", "", f"(e.src.prop & {ACTIVE}) != 0 ? e.src.prop + 1 : 0",
        f"lambda a, b: b == 0 ? a : (a == 0 ? b : ((a & {LOW}) > (b & {LOW}) ? b : a))",
        f"lambda u: u == 0 ? (self.prop & {LOW}) : (self.prop == {INF} ? u : (self.prop & {LOW}))", "prop",
    ),
    "ar": _program("score: int<32> out_deg: int<32>", "", "e.src.score", TOTAL, "lambda t: (108 * t + 1258291) * (65536 / self.out_deg)", "score"),
    "ar_average": _program("score: int<32> out_deg: int<32> avg_out_deg: int<32>", "", "e.src.score", TOTAL, "lambda t: (108 * t + 1258291) * (65536 / (self.out_deg + self.avg_out_deg))", "score"),
    "coloring": _program("color: int<32> priority: int<32>", "", "make_set(e.src.color)", "lambda a, b: set_union(a, b)", "lambda s: mex(s)", "color"),
    "als": _program("vec: vector<float, 16>", "rating: float", "pair(outer_product(e.src.vec, e.src.vec), vector_scale(e.src.vec, e.rating))", "lambda a, b: pair(matrix_add(a.0, b.0), vector_add(a.1, b.1))", "lambda t: solve_linear(t.0, t.1)", "vec"),
    "cc_bitmask": _program("label: int<32>", "", "e.src.label", "lambda a, b: a | b", "lambda d: self.label | d", "label"),
    "cc_self": _program("label: int<32>", "", "e.src.label", LEAST, "lambda d: d < self.label ? d : self.label", "label"),
    "wcc_self": _program("label: int<32>", "", "e.src.label", MOST, "lambda d: d > self.label ? d : self.label", "label"),
    "sssp_fixed": sssp("fixed<32, 16>", "int<10>"),
    "sssp_8bit": sssp("int<8>", "int<10>"),
    "sssp_light": sssp().replace("to = map([links]", "light = filter([links], lambda e: e.weight <= 6 && !(e.weight == 3))\n    to = map([light]").replace("sent = map([links]", "sent = map([light]"),
    "difference": _program("label: int<32>", "", "e.src.label", "lambda a, b: a - b", "", "label"),
    "bits": _program("label: int<32>", "", "(~e.src.label) & 1023", MOST, f"lambda d: d > 512 || self.label == 0 ? (d - self.label) & {WORD} : self.label", "label"),
    "own_gap": _program("color: int<32>", "", "make_set(e.src.color)", "lambda a, b: set_union(a, b)", "lambda s: mex(set_insert(s, self.color))", "color"),
    "vector_sum": _program("vec: vector<float, 16>", "rating: float", "vector_scale(e.src.vec, e.rating)", "lambda a, b: vector_add(a, b)", "", "vec"),
    "reach": _program("seen: set<int<32>>", "", "e.src.seen", "lambda a, b: set_union(a, b)", "lambda s: set_union(self.seen, s)", "seen"),
    "sssp_extra": sssp(extra=2),
    "sssp_inverted": sssp().replace("d < self.dist ? d : self.dist", "d < self.dist ? self.dist : d"),
}


def bfs_depth(nodes: DataFrame) -> DataFrame:
    """(id, depth) from the packed property of the ``bfs`` program; null where it has not been."""
    low = F.col("prop").bitwiseAND(F.lit(LOW))
    return nodes.select("id", F.when(low != INF, low - 1).alias("depth"))


def classified(step) -> str:
    """Which built-in family a program belongs to, by its reducer and what it sends."""
    from gasframe.plans.dsl import Binary, Lit
    from gasframe.plans.superstep_plan import classify

    kind = classify(step.reducer)[0]
    if kind == "min":
        return "sssp" if isinstance(step.value, Binary) and step.value.op == "+" else "cc"
    if kind == "sum":
        target = step.program.node.get(step.target)
        return "pagerank" if target is not None and target.kind in ("float", "fixed") else "ar"
    return {"max": "wcc", "masked_min": "bfs", "or": "cc_bitmask", "union": "coloring", "each": "als"}.get(kind, "custom")


#: Steps that the families with a fixed number of iterations make.
FIXED_STEPS = {"pagerank": 16, "ar": 10}


def pagerank_fixed_point(graph: Graph, steps: int = 200, tolerance: int = 1, scale_bits: int = 30) -> DataFrame:
    """(id, contribution): page rank in integers, as what a node sends along each of its edges, scaled by 2^30.

    A node's score is its share of 15 % of the scale plus 108/128 of the contributions it receives; it sends the
    score by a 16-bit reciprocal of its out-degree, and nothing without an outgoing edge. The run ends after
    ``steps``, or when no contribution moves by more than ``tolerance``.
    """
    from pyspark.sql import Observation

    from gasframe.sources.scratch import forget, written

    n = max(graph.nodes.count(), 1)
    share, base = (1 << scale_bits) // n, (1 << scale_bits) * 15 // (100 * n)
    edges = graph.edges.select("src", "dst") if hasattr(graph.edges, "_scratch_path") else written(graph.edges.select("src", "dst"), "edges")
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    start = graph.nodes.select("id").join(degree, "id", "left").select("id", "d", F.expr(f"coalesce({share}L div d, 0L)").alias("c"))
    now = written(start, "ranks")
    for _ in range(steps):
        sums = edges.join(now.select(F.col("id").alias("s_id"), "c"), F.col("src") == F.col("s_id")).groupBy("dst").agg(F.sum("c").alias("s"))
        score = F.lit(base) + F.shiftright(F.coalesce("s", F.lit(0)) * 108, 7)
        sent = F.when(F.col("d").isNotNull(), F.shiftright(score * F.expr("65536L div d"), 16)).otherwise(F.lit(0)).cast("bigint")
        seen = Observation()
        nxt = now.join(sums, F.col("id") == F.col("dst"), "left").select("id", "d", sent.alias("new"), "c")
        out = written(nxt.observe(seen, F.max(F.abs(F.col("new") - F.col("c"))).alias("moved")).select("id", "d", F.col("new").alias("c")), "ranks")
        forget(now)
        now = out
        if (seen.get["moved"] or 0) <= tolerance:
            break
    return now.select("id", F.col("c").alias("contribution"))
