import numpy as np
import pytest
from pyspark.sql import functions as F

from gasframe.algorithms import PROGRAMS, bfs_depth
from gasframe.operators.graph import Graph, NoConvergence, Until, compare, converge, converge_until, iterate, run, timed
from gasframe.plans.columns import CallError, Compiler, Typed, TypeMismatch, divided, equal, float_divided, wrapped
from gasframe.plans.dsl import Call, Lit


def graph(spark, props, nodes, edges, weights=""):
    n = spark.createDataFrame(nodes, f"id long, {props}")
    e = spark.createDataFrame([(i, *x) for i, x in enumerate(edges)], f"eid long, src long, dst long{weights}")
    return Graph(n, e)


def values(nodes, prop):
    return {r["id"]: r[prop] for r in nodes.collect()}


BIG = 1_000_000


def test_shortest_paths(spark):
    g = graph(spark, "dist long", [(0, 0), (1, BIG), (2, BIG), (9, BIG)], [(0, 1, 2), (0, 2, 5), (1, 2, 1), (2, 1, 4), (2, 2, 1)], ", weight long")
    out = converge(PROGRAMS["sssp"], g, 16)
    assert values(out.nodes, "dist") == {0: 0, 1: 2, 2: 3, 9: BIG} and out.converged
    bounded = graph(spark, "dist long", [(0, 0), (1, BIG), (2, BIG)], [(1, 2, 1), (0, 1, 1)], ", weight long")
    assert values(iterate(PROGRAMS["sssp"], bounded, 1).nodes, "dist") == {0: 0, 1: 1, 2: BIG}
    assert values(run(PROGRAMS["sssp"], bounded).nodes, "dist") == {0: 0, 1: 1, 2: 2}
    wrong = iterate(PROGRAMS["sssp_inverted"], g, 3).nodes
    assert compare(wrong, out.nodes, "dist").count() > 0 and compare(out.nodes, out.nodes, "dist").count() == 0
    assert timed(PROGRAMS["sssp"], g, 2)["edges"] == 5


def test_no_message_keeps_the_current_value(spark):
    g = graph(spark, "rank double, out_deg long", [(0, 3.0, 2), (1, 1.0, 1)], [(0, 1)])
    assert values(iterate(PROGRAMS["pagerank"], g, 1).nodes, "rank") == pytest.approx({0: 0.15 + 0.85 * 1.5, 1: 0.15 + 0.85 * 3.0})
    assert values(iterate(PROGRAMS["pagerank"], g, 1, no_message=0).nodes, "rank")[0] == pytest.approx(0.15)
    assert values(iterate(PROGRAMS["pagerank"], g, 1, no_message="skip").nodes, "rank")[0] == 3.0
    c = graph(spark, "color long, priority long", [(0, 5, 0), (1, 1, 0)], [(0, 1)])
    assert values(iterate(PROGRAMS["coloring"], c, 1).nodes, "color") == {0: 5, 1: 0}


def test_two_cycle_oscillates_without_self(spark):
    g = graph(spark, "label long", [(0, 0), (1, 1)], [(0, 1), (1, 0)])
    with pytest.raises(NoConvergence):
        converge(PROGRAMS["cc"], g, 5)
    assert run(PROGRAMS["cc"], g).converged is False
    assert values(converge(PROGRAMS["cc_self"], g, 5).nodes, "label") == {0: 0, 1: 0}
    assert values(converge(PROGRAMS["wcc_self"], g, 5).nodes, "label") == {0: 1, 1: 1}


def test_bfs_article_rank_bitmask(spark):
    first = (1 << 31) + 1
    g = graph(spark, "prop long", [(0, first), *((i, (1 << 31) - 2) for i in (1, 2, 3, 4, 7))], [(0, 1), (1, 2), (0, 3), (3, 4)])
    out = converge(PROGRAMS["bfs"], g, 64).nodes
    assert values(bfs_depth(out), "depth") == {0: 0, 1: 1, 3: 1, 2: 2, 4: 2, 7: None}
    full = [(i, j) for i in range(3) for j in range(3) if i != j]
    a = graph(spark, "score long, out_deg long", [(i, 0, 4) for i in range(3)], full)
    assert set(values(iterate(PROGRAMS["ar"], a, 10).nodes, "score").values()) == {1288486912}
    zero = graph(spark, "score long, out_deg long", [(0, 7, 0)], [(0, 0)])
    assert values(iterate(PROGRAMS["ar"], zero, 1).nodes, "score") == {0: 0}
    m = graph(spark, "label long", [(0, 1), (1, 2), (2, 4)], [(0, 1), (1, 2)])
    assert values(converge(PROGRAMS["cc_bitmask"], m, 9).nodes, "label") == {0: 1, 1: 3, 2: 7}


def test_least_squares(spark):
    rng = np.random.default_rng(1)
    vecs = rng.random((4, 16))
    links = [(s, d, float(s + d)) for d in range(3) for s in range(4)]
    g = graph(spark, "vec array<double>", [(i, v.tolist()) for i, v in enumerate(vecs)], links, ", rating double")
    out = values(iterate(PROGRAMS["als"], g, 1).nodes, "vec")
    for d in range(3):
        a = sum(np.outer(vecs[s], vecs[s]) for s in range(4)) + 1e-6 * np.eye(16)
        assert np.allclose(out[d], np.linalg.solve(a, sum(vecs[s] * (s + d) for s in range(4))), atol=1e-4)
    assert out[3] == vecs[3].tolist()


def program(value, reducer="lambda a, b: a + b", apply="", node="p: int<32>", edge="w: int<32>", before="", prop="p"):
    return f"{{ Node: {{ {node} }} Edge: {{ {edge} }} }} {{ e = iteration_input(G.EDGES) {before} k = map([{'f' if before else 'e'}], lambda x: x.dst) v = map([{'f' if before else 'e'}], lambda x: {value}) r = reduce(key=k, values=[v], function={reducer}) {f'm = map([r], {apply})' if apply else ''} return {'m' if apply else 'r'} as result_node_prop.{prop} }}"


def test_filter_chain_fold_and_new_property(spark):
    g = graph(spark, "p long", [(0, 10), (1, 3), (2, 1)], [(1, 0, 1), (2, 0, 5), (1, 0, 7)], ", w long")
    filtered = program("x.src.p * x.w", before="f = filter([e], lambda x: x.w > 2)")
    assert values(iterate(filtered, g, 1).nodes, "p") == {0: 26, 1: 3, 2: 1}
    fold = program("x.w", "lambda a, b: a - b", node="p: int<64>", edge="w: int<64>")
    assert values(iterate(fold, g, 1).nodes, "p")[0] == 1 - 5 - 7
    masked = program("x.w", "lambda a, b: a - b")
    assert values(iterate(masked, g, 1).nodes, "p")[0] == (1 - 5 - 7) & (2**32 - 1)
    new = program("x.w", "lambda a, b: a > b ? a : b", prop="q")
    assert values(iterate(new, g, 2).nodes, "q") == {0: 7, 1: None, 2: None}
    reverse = program("x.w").replace("x.dst", "x.src")
    assert values(iterate(reverse, g, 1).nodes, "p") == {0: 10, 1: 8, 2: 5}


def test_arithmetic(spark):
    edge = [(5, 3), (-7, 2), (2**63 - 1, 2), (-(2**63), -1), (2**40, 2**40), (0, 0), (9, 0), (2**32 - 1, 2**32 - 1)]
    df = spark.createDataFrame(edge, "a long, b long")
    wrap = lambda v, m: (v if m is None else v & m) if m is not None else (v + 2**63) % 2**64 - 2**63
    a, b = F.col("a"), F.col("b")
    for mask in (None, 2**32 - 1, 2**8 - 1, 2**63 - 1, 2**47 - 1):
        got = df.select("a", "b", *(wrapped(o, a, b, mask).alias(n) for o, n in (("+", "s"), ("-", "d"), ("*", "p"))), divided(a, b, mask).alias("q")).collect()
        for r in got:
            x, y = r["a"], r["b"]
            assert (r["s"], r["d"], r["p"]) == (wrap(x + y, mask), wrap(x - y, mask), wrap(x * y, mask))
            assert r["q"] == wrap((x % 2**64) // (y % 2**64) if y else 0, mask)
    f = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (3.0, 2.0), (1.0, 1.0 + 5e-7), (float("nan"), float("nan"))], "a double, b double")
    out = f.select(float_divided(a, b).alias("q"), equal(Typed(a, "float"), Typed(b, "float")).alias("e")).collect()
    assert [str(r["q"]) for r in out[:4]] == ["inf", "-inf", "nan", "1.5"] and [r["e"] for r in out] == [False, False, True, False, True, False]


def test_functions(spark):
    c = Compiler(None, lambda base, name: None)
    one = spark.range(1)
    call = lambda name, *a: c.compile(Call(name, a), {"s": Typed(F.array(F.lit(0).cast("long"), F.lit(2).cast("long")), "set"), "v": Typed(F.array(F.lit(1.0), F.lit(2.0)), "vector", (), (2,)), "w": Typed(F.array(F.lit(3.0)), "vector", (), (1,))})
    from gasframe.plans.dsl import Var

    s, v, w = Var("s"), Var("v"), Var("w")
    got = one.select(call("mex", s).column, call("set_insert", s, Lit(1)).column, call("set_union", s, Call("make_set", (Lit(5),))).column, call("vector_add", v, w).column, call("vector_scale", v, Lit(2)).column, call("outer_product", v, w).column).first()
    assert list(got)[:5] == [1, [0, 1, 2], [0, 2, 5], [4.0], [2.0, 4.0]] and got[5].asDict() == {"rows": 2, "cols": 1, "data": [3.0, 6.0]}
    with pytest.raises(CallError):
        call("nothing", s)
    with pytest.raises(CallError):
        call("mex", v)
    with pytest.raises(TypeMismatch):
        Compiler(None, lambda b, n: None)._binary("&&", Typed(F.lit(1), "int"), Typed(F.lit(1), "int"))


def test_ways_to_end(spark):
    g = graph(spark, "label long", [(0, 0), (1, 1)], [(0, 1), (1, 0)])
    least = converge_until(PROGRAMS["cc"], g, 9, Until("improve", "min"))
    assert values(least.nodes, "label") == {0: 0, 1: 0} and least.converged
    assert converge_until(PROGRAMS["cc"], g, 4, Until()).converged is False
    assert values(converge_until(PROGRAMS["wcc"], g, 9, Until(update="max")).nodes, "label") == {0: 1, 1: 1}
    fixed = converge_until(PROGRAMS["cc"], g, 3, Until("fixed"))
    assert fixed.steps == 3 and fixed.converged is None and values(fixed.nodes, "label") == {0: 1, 1: 0}
    ranks = graph(spark, "rank double, out_deg long", [(0, 1.0, 2), (1, 9.0, 2)], [(0, 1), (1, 0), (0, 0), (1, 1)])
    out = converge_until(PROGRAMS["pagerank"], ranks, 50, Until("delta", threshold=1e-3))
    assert out.converged and out.steps < 50
    inf = (1 << 31) - 2
    b = graph(spark, "prop long", [(0, (1 << 31) + 1), (1, inf), (2, inf)], [(0, 1), (1, 2), (2, 0)])
    seen = converge_until(PROGRAMS["bfs"], b, 20, Until("newly_discovered", active_mask=1 << 31, unreached=inf))
    assert seen.converged and seen.steps == 3 and {k: v & inf | v & 1 for k, v in values(seen.nodes, "prop").items()}[2] == 3
    with pytest.raises(ValueError):
        Until("never")


def test_many_nodes_and_a_hub(spark):
    import re

    from gasframe.operators.graph import _prepared, superstep
    from gasframe.plans.superstep_plan import lower

    links = [(0, i, 1 + i % 3) for i in range(1, 300)] + [(i, (i * 7) % 300, 2) for i in range(1, 300)]
    g = graph(spark, "dist long", [(i, 0 if i == 5 else BIG) for i in range(300)], links, ", weight long")
    want = values(converge(PROGRAMS["sssp"], g, 32).nodes, "dist")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert values(converge(PROGRAMS["sssp"], g, 32).nodes, "dist") == want
        nodes, edges = _prepared(lower(PROGRAMS["sssp"]), g)
        assert [r.h_id for r in edges.ids.collect()] == [0] and edges.hot.count() == 299 and edges.cold.count() == 299
        plan = superstep(lower(PROGRAMS["sssp"]), nodes, edges)._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange hashpartitioning\(src", plan) and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_bit_operators_wrap_at_the_declared_width(spark):
    """Literals have 64 bits, so that the program has no mask: a label above what is gathered became negative."""
    g = graph(spark, "label long", [(0, 100), (1, 2000), (2, 2**32 - 1)], [(0, 1), (1, 2)])
    assert values(iterate(PROGRAMS["bits"], g, 1).nodes, "label") == {0: 100, 1: (923 - 2000) & (2**32 - 1), 2: 2**32 - 1}
    assert values(iterate(PROGRAMS["bits"], g, 3).nodes, "label") == plain_bits({0: 100, 1: 2000, 2: 2**32 - 1}, {1: [0], 2: [1]}, 3)


def plain_bits(label, sources, steps):
    for _ in range(steps):
        got = {k: max(~label[s] & 1023 for s in sources[k]) if k in sources else label[k] for k in label}
        label = {k: (got[k] - label[k]) & (2**32 - 1) if got[k] > 512 or not label[k] else label[k] for k in label}
    return label
