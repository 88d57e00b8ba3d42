"""Property graphs and supersteps over them."""

from __future__ import annotations

import time
from dataclasses import dataclass, fields, is_dataclass, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gasframe.operators.folding import folded, folds
from gasframe.operators.normal import normal_sums, suits
from gasframe.plans.columns import Compiler, Typed, equal, kind_of, masked
from gasframe.plans.dsl import Call, Lambda, Member, Program, Var
from gasframe.plans.superstep_plan import EDGE_VAR, SELF, Superstep, classify, lower, walk
from gasframe.sources.scratch import bucketed, forget, in_ranges, written

#: Steps after which a run without a limit gives up.
DEFAULT_STEPS = 32
#: Columns of nodes between steps in which only changed ones send (``frontier``).
MARKS = ("$g", "$lost", "$sent")
#: Where edges are dealt in ranges of sources: their bucket key, and that of the edges that start at a node.
HOME = "$home"
#: Whether joined tables must be dealt by all of their join columns. Edges in ranges are dealt by one of two: while they
#: are there this is off, else each step would shuffle them.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


class NoConvergence(RuntimeError):
    """The property still changed after the last step allowed."""


@dataclass(frozen=True)
class Graph:
    """nodes(id, properties...) and edges(eid, src, dst, properties...). Parallel edges and loops are kept; ids are
    longs and need not be dense; ``eid`` orders the edges for reducers that are no algebra."""

    nodes: DataFrame
    edges: DataFrame

    def distinct_nodes(self) -> Graph:
        """The graph with one row per node id. Of rows that share an id the last by all properties stays."""
        rest = [c for c in self.nodes.columns if c != "id"]
        if not rest:
            return replace(self, nodes=self.nodes.distinct())
        last = self.nodes.groupBy("id").agg(F.max(F.struct(*rest)).alias("p"))
        return replace(self, nodes=last.select("id", "p.*"))

    def missing_nodes(self) -> DataFrame:
        """Edge endpoints that no node has."""
        ends = self.edges.select(F.col("src").alias("id")).union(self.edges.select("dst")).distinct()
        return ends.join(self.nodes, "id", "left_anti")


def once(step: Superstep, name: object, make):
    """What ``make`` gives, made once for a step: columns are the same in each of a run's supersteps, and to make them
    anew takes as long as a small step."""
    held = step.__dict__.setdefault("$made", {})
    if name not in held:
        held[name] = make()
    return held[name]


def _used(step: Superstep) -> tuple[set[str], set[str]]:
    """The source-node and edge properties that the scatter reads."""
    source, edge = set(), set()
    for e in (step.key, step.value, *step.tests):
        for x in walk(e):
            if isinstance(x, Member):
                if x.base == Member(EDGE_VAR, "src") and x.name != "id":
                    source.add(x.name)
                elif x.base == EDGE_VAR and x.name not in ("src", "dst"):
                    edge.add(x.name)
    return source, edge


def _scatter_member(step: Superstep):
    node, edge = step.program.node, step.program.edge

    def member(base, name):
        if base == EDGE_VAR and name in ("src", "dst"):
            return Typed(F.col(name), "int")
        if base == EDGE_VAR and name in edge:
            return Typed(F.col(f"e_{name}"), *kind_of(edge[name]))
        if base == Member(EDGE_VAR, "src") and name in node:
            return Typed(F.col(f"s_{name}"), *kind_of(node[name]))
        return None

    return member


def _apply_member(step: Superstep):
    node = step.program.node

    def member(base, name):
        if base == SELF:
            if name in ("", "id"):
                return Typed(F.col("id"), "int")
            if name in node:
                return Typed(F.col(f"`{name}`"), *kind_of(node[name]))
        return None

    return member


def _sent(step: Superstep, compiler: Compiler) -> Typed:
    """The value that goes along an edge. Where it is an outer product or a scaled vector that is only summed, its
    factors go instead (kinds ``outer`` and ``scaled``), so that no matrix is built for an edge."""

    def part(kind: tuple, e) -> Typed:
        if isinstance(e, Call) and len(e.args) == 2 and (kind[0], e.name) in (("matrix_sum", "outer_product"), ("vector_sum", "vector_scale")):
            a, b = (compiler.compile(x, {}) for x in e.args)
            if a.kind == "vector" and a.size and (b.kind == "vector" and b.size if kind[0] == "matrix_sum" else b.kind in ("int", "float")):
                if kind[0] == "vector_sum":
                    return Typed(F.struct(a.column.alias("u"), b.column.cast("double").alias("w")), "scaled", (), a.size)
                both = [a.column.alias("u")] + [b.column.alias("w")] * (e.args[0] != e.args[1])
                return Typed(F.struct(*both), "outer", ("same",) if len(both) == 1 else (), a.size + b.size)
        return compiler.compile(e, {})

    kind, e = classify(step.reducer), step.value
    if kind[0] == "each" and isinstance(e, Call) and e.name == "pair":
        parts = [part(k, x) for k, x in zip(kind[1], e.args)]
        return Typed(F.struct(*(p.column.alias(f"_{i}") for i, p in enumerate(parts))), "tuple", tuple((p.kind, p.parts, p.size) for p in parts))
    return part(kind, e)


#: Numbers that one group holds when the least gap of a set is sought.
GAP_BLOCK = 1024


def _least_gap(step: Superstep) -> Superstep | None:
    """For a program that unites one-element sets and asks for nothing but their least gap, the step whose gathered
    value is that gap: no node's set is ever held in one place."""
    if classify(step.reducer)[0] != "union" or step.apply is None or not (isinstance(step.value, Call) and step.value.name == "make_set" and len(step.value.args) == 1):
        return None
    name = step.apply.params[0]
    gap = Call("mex", (Var(name),))

    def without(e):
        return Var(name) if e == gap else replace(e, **{f.name: v for f in fields(e) if (v := inner(getattr(e, f.name))) is not None}) if is_dataclass(e) else e

    def inner(x):
        return tuple(without(y) for y in x) if isinstance(x, tuple) else without(x) if is_dataclass(x) else None

    bare = sum(x == Var(name) for x in walk(step.apply.body)) - sum(x == gap for x in walk(step.apply.body))
    return None if bare else replace(step, apply=Lambda(step.apply.params, without(step.apply.body)))


def _gaps(messages: DataFrame) -> DataFrame:
    """(k, g): the least number from zero on that no message of a key has. Numbers go in blocks of ``GAP_BLOCK``, by
    key and block; a full block says so, and any other names its own least gap."""
    x = F.col("v")[0]
    low = F.col("b") * GAP_BLOCK
    blocks = messages.groupBy("k", F.floor(x / F.lit(GAP_BLOCK)).alias("b")).agg(F.collect_set(x).alias("xs"))
    own = F.array_min(F.array_except(F.sequence(low, low + F.size("xs")), F.col("xs")))
    real = F.col("b") >= 0
    blocks = blocks.select("k", "b", real.alias("real"), (F.size("xs") == GAP_BLOCK).alias("full"), F.when(real, own).alias("gap"))
    per = blocks.groupBy("k").agg(
        F.sort_array(F.collect_list(F.when(F.col("real") & F.col("full"), F.col("b")))).alias("full"),
        F.min(F.when(F.col("real") & ~F.col("full"), F.struct("b", "gap"))).alias("open"),
    )
    run = F.size(F.filter("full", lambda b, i: b == i)).cast("bigint")
    per = per.select("k", run.alias("first"), "open")
    return per.select("k", F.when(F.col("open.b") == F.col("first"), F.col("open.gap")).otherwise(F.col("first") * GAP_BLOCK).cast("bigint").alias("g"))


def _slots(v: Column, size: int) -> Column:
    return F.array(*(F.sum(v[i]) for i in range(size)))


def _aggregate(kind: tuple, v: Typed, step: Superstep, reducer: Lambda) -> tuple[Column, Typed] | None:
    """(aggregate column, what it holds) for an algebraic reducer, or nothing for one that must fold."""
    c, name = v.column, kind[0]
    if name == "sum" and v.kind == "int":
        narrow = step.mask is not None and step.mask < 1 << 40
        if narrow:
            return masked(F.sum(masked(c, step.mask)), step.mask), v
        return _wide_sum(c, step.mask), v
    if name == "sum" and v.kind == "float" or name in ("min", "max") and v.kind in ("int", "float"):
        return {"sum": F.sum, "min": F.min, "max": F.max}[name](c), v
    if name == "or" and v.kind == "int":
        return masked(F.bit_or(c), step.mask), v
    if name == "masked_min" and v.kind == "int":
        real = F.when(c != 0, c)
        return F.coalesce(F.min_by(real, real.bitwiseAND(F.lit(kind[1]))), F.lit(0).cast("bigint")), v
    if name == "union" and v.kind == "set":
        return F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))), v
    if name in ("sum", "vector_sum") and v.kind == "vector" and v.size:
        return _slots(c, v.size[0]), v
    if name == "matrix_sum" and v.kind == "matrix" and len(v.size) == 2:
        rows, cols = v.size
        return F.struct(F.lit(rows).alias("rows"), F.lit(cols).alias("cols"), _slots(c["data"], rows * cols).alias("data")), v
    if name == "each" and v.kind == "tuple" and len(v.parts) == 2:
        parts = [_aggregate(k, Typed(c[f"_{i}"], *v.parts[i]), step, reducer) for i, k in enumerate(kind[1])]
        if all(parts):
            held = tuple((p[1].kind, p[1].parts, p[1].size) for p in parts)
            return F.struct(*(p[0].alias(f"_{i}") for i, p in enumerate(parts))), Typed(c, "tuple", held)
    return None


def _wide_sum(c: Column, mask: int | None) -> Column:
    from gasframe.plans.columns import _signed

    return masked(_signed(F.sum(c.cast("decimal(20,0)"))), mask)


@dataclass(frozen=True)
class _Edges:
    """Edges in buckets by source, or by ``HOME`` where each bucket is a range of sources, and apart from them the edges of
    the sources in ``ids``, each of which would fill a bucket alone; there are fewer such sources than buckets. all_keys:
    what ``ALL_KEYS`` was before edges were dealt in ranges."""

    cold: DataFrame
    hot: DataFrame
    ids: DataFrame
    all_keys: str | None = None

    @property
    def ranged(self) -> bool:
        return self.all_keys is not None

    def all(self) -> DataFrame:
        return self.cold.drop(HOME).unionByName(self.hot)


def _bytes(df: DataFrame) -> int:
    """The planner's estimate of a table's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _dealt(edges: DataFrame, ranged: bool = True) -> _Edges:
    """Edges in buckets. In ranges of sources, sources with near ids send from one task, and what they send to the same
    nodes is merged before the shuffle: by hash, each such node would get a message from nearly every bucket."""
    spark = edges.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = edges.groupBy("src").agg(F.count("*").alias("n"))
    total = edges.agg((F.count("*") / buckets).alias("share"))
    ids = written(counts.join(F.broadcast(total)).where(F.col("n") > F.col("share")).select(F.col("src").alias("h_id")), "hubs")
    hub = F.col("src") == F.col("h_id")
    hot = written(edges.join(F.broadcast(ids), hub, "left_semi"), "hub-edges")
    rest = edges.join(F.broadcast(ids), hub, "left_anti")
    if not ranged:
        return _Edges(bucketed(rest, "edges", buckets, "src"), hot, ids)
    return _Edges(in_ranges(rest, "edges", buckets, "src", HOME), hot, ids, spark.conf.get(ALL_KEYS))


def _at_home(nodes: DataFrame, edges: _Edges) -> DataFrame:
    """``nodes`` with the bucket key of their edges, null where they have none in buckets. ``ALL_KEYS`` is off from here
    until the edges are put away."""
    nodes.sparkSession.conf.set(ALL_KEYS, "false")
    homes = edges.cold.select(F.col("src").alias("h_id"), F.col(f"`{HOME}`")).distinct()
    return written(nodes.join(homes, F.col("id") == F.col("h_id"), "left").drop("h_id"), "nodes")


def _source_home(edges: DataFrame | _Edges) -> list[Column]:
    """The column of sources that ``met`` finds their bucket by."""
    return [F.col(f"`{HOME}`").alias("s_home")] if isinstance(edges, _Edges) and edges.ranged else []


def _number(edges: DataFrame | _Edges) -> list[str]:
    """The column of edge numbers, where edges have it."""
    return ["eid"] if "eid" in (edges.cold if isinstance(edges, _Edges) else edges).columns else []


def met(step: Superstep, s: DataFrame, edges: DataFrame | _Edges) -> DataFrame:
    """The edges, with properties that the program reads, joined with their sources ``s`` (s_id, ..., and s_home where
    edges lie in ranges)."""
    number = _number(edges)
    wanted, at = once(step, ("met", *number), lambda: ([*number, "src", "dst", *(F.col(f"`{p}`").alias(f"e_{p}") for p in sorted(_used(step)[1]))], F.col("src") == F.col("s_id")))
    own = lambda df: df.select(*wanted)
    if isinstance(edges, _Edges):
        few = F.broadcast(s.join(F.broadcast(edges.ids), F.col("s_id") == F.col("h_id"), "left_semi"))
        if not edges.ranged:
            return own(edges.cold).join(s, at).union(own(edges.hot).join(few, at))
        cold = edges.cold.select(*wanted, F.col(f"`{HOME}`")).join(s, at & (F.col(f"`{HOME}`") == F.col("s_home"))).drop(HOME)
        return cold.union(own(edges.hot).join(few, at))
    return own(edges).join(s, at)


def scattered(step: Superstep, nodes: DataFrame, edges: DataFrame | _Edges) -> tuple[DataFrame, Typed]:
    """Messages (k, v, and eid if edges have it): the edges joined with the source properties they read, tested and
    projected."""
    number = _number(edges)

    def columns():
        source, edge = _used(step)
        compiler = Compiler(step.mask, _scatter_member(step))
        tests = [compiler.compile(test, {}).column for test in step.tests]
        key, value = compiler.compile(step.key, {}), _sent(step, compiler)
        from_nodes = [F.col("id").alias("s_id"), *(F.col(f"`{p}`").alias(f"s_{p}") for p in sorted(source))]
        from_edges = [*number, "src", "dst", *(F.col(f"`{p}`").alias(f"e_{p}") for p in sorted(edge))]
        return bool(source), from_nodes, from_edges, tests, [key.column.alias("k"), value.column.alias("v"), *number], value

    reads, from_nodes, from_edges, tests, out, value = once(step, ("scattered", *number), columns)
    e = met(step, nodes.select(*from_nodes, *_source_home(edges)), edges) if isinstance(edges, _Edges) or reads else edges.select(*from_edges)
    for test in tests:
        e = e.where(test)
    return e.select(*out), value


def gathered(step: Superstep, messages: DataFrame, value: Typed) -> tuple[DataFrame, Typed]:
    """(k, g): one row per key. Sums of outer products and scaled vectors are made in Arrow batches. Other sums, minima, maxima, unions and the like are grouped aggregates with partial sums; any
    other reducer folds the messages in edge order, from the first: over numbers as ``folding`` does, over other values
    in an array of a key's messages."""
    v = Typed(F.col("v"), value.kind, value.parts, value.size)
    if suits(value) and classify(step.reducer)[0] in ("each", "matrix_sum", "vector_sum"):
        return normal_sums(messages, value)
    done = once(step, "aggregate", lambda: _aggregate(classify(step.reducer), v, step, step.reducer))
    if done:
        column, held = done
        return messages.groupBy("k").agg(column.alias("g")), Typed(F.col("g"), held.kind, held.parts, held.size)
    a, b = step.reducer.params
    compiler = Compiler(step.mask, lambda base, name: None)
    wrap = lambda c: Typed(c, value.kind, value.parts, value.size)
    probe = compiler.compile(step.reducer.body, {a: v, b: v})
    if probe.kind != value.kind:
        raise TypeError(f"the reducer makes {probe.kind} of {value.kind}")
    if folds(step.reducer, value.kind):
        return folded(messages, step.reducer, value.kind, step.mask), Typed(F.col("g"), value.kind)
    listed = F.array_sort(F.collect_list(F.struct("eid", "v")))
    lists = messages.groupBy("k").agg(F.transform(listed, lambda p: p["v"]).alias("vs"))
    fold = F.reduce(F.slice("vs", 2, F.size("vs")), F.col("vs")[0], lambda x, y: compiler.compile(step.reducer.body, {a: wrap(x), b: wrap(y)}).column)
    return lists.select("k", fold.alias("g")), Typed(F.col("g"), value.kind, value.parts, value.size)


def superstep(step: Superstep, nodes: DataFrame, edges: DataFrame | _Edges, no_message: object = "current", keep_old: bool = False) -> DataFrame:
    """``nodes`` after one step, with the column ``$changed``, and with ``keep_old`` the value before as ``$old``.

    A node without a message gathers its current value and applies to it; where the types differ it keeps its value.
    ``no_message`` may instead be "skip" (keep the value), or a number to gather.
    """
    messages, value = scattered(step, nodes, edges)
    gap = _least_gap(step) if value.kind == "set" else None
    if gap:
        agg, g, step = _gaps(messages), Typed(F.col("g"), "int"), gap
    else:
        agg, g = gathered(step, messages, value)
    agg = agg.withColumn("$has", F.lit(True))
    joined = nodes.join(agg, nodes["id"] == agg["k"], "left")
    return applied(step, joined, nodes.columns, F.coalesce(F.col("`$has`"), F.lit(False)), g, no_message, keep_old, bool(gap))


def applied(step: Superstep, joined: DataFrame, columns: list[str], has: Column, g: Typed, no_message: object = "current", keep_old: bool = False, gap: bool = False, keep: tuple[Column, ...] = ()) -> DataFrame:
    """The apply of a step over nodes (``columns``) with their gathered value ``g``, where they have one; ``gap`` says
    that a set stands behind ``g``. Columns to ``keep`` go along."""
    target = step.target
    declared = target in step.program.node and target in columns

    def made():
        old = Typed(F.col(f"`{target}`"), *kind_of(step.program.node[target])) if declared else None
        stays = no_message == "skip" or no_message == "current" and (old is None or old.kind != ("set" if gap else g.kind))
        if stays:
            held = g
        else:
            other = old.column if no_message == "current" else F.lit(no_message)
            kind = "double" if g.kind == "float" else "bigint"
            held = Typed(F.when(has, g.column).otherwise(other if no_message == "current" else other.cast(kind)), g.kind, g.parts, g.size)
        compiler = Compiler(step.mask, _apply_member(step))
        new = compiler.compile(step.apply.body, {step.apply.params[0]: held}) if step.apply else held
        if old is not None and {old.kind, new.kind} == {"int", "float"}:
            new = Typed(new.column.cast("double" if old.kind == "float" else "bigint"), old.kind)
        column = new.column
        if stays:
            column = F.when(has, column).otherwise(old.column if old is not None else F.lit(None))
        rest = [F.col(f"`{c}`") for c in columns if c not in (target, "$changed", "$old", *MARKS)]
        listed = [*rest, *keep, *([F.col(f"`{target}`").alias("$old")] if declared else []), column.alias(target)]
        if not declared:
            return listed, F.col(f"`{target}`").isNotNull() if target not in columns else F.lit(True)
        before, after = Typed(F.col("`$old`"), new.kind, new.parts, new.size), Typed(F.col(f"`{target}`"), new.kind, new.parts, new.size)
        return listed, ~F.coalesce(equal(before, after), before.column.isNull() & after.column.isNull())

    listed, changed = once(step, ("applied", tuple(columns), str(no_message), gap, bool(keep)), made)
    marked = joined.select(*listed).withColumn("$changed", changed)
    return marked.drop("$old") if declared and not keep_old else marked


def _declare(step: Superstep) -> Superstep:
    """The step as later steps see it: a target that was never declared has the result's type from then on."""
    if step.target in step.program.node or step.result_type.kind == "unknown":
        return step
    program: Program = replace(step.program, node={**step.program.node, step.target: step.result_type})
    return replace(step, program=program)


def _prepared(step: Superstep, graph: Graph, ordered: bool = True, ranged: bool = True) -> tuple[DataFrame, DataFrame | _Edges]:
    """(nodes, edges) to iterate over: written once, the edges with the columns that the program reads, and with their
    numbers if messages are ``ordered`` by them. Tables that lie in the shared folder already are read from there. Nodes
    have the column ``HOME`` if edges are dealt in ranges (``ranged``: if they are dealt at all)."""
    _, edge = _used(step)
    ready = lambda df: hasattr(df, "_scratch_path")
    narrow = graph.edges.select(*["eid"] * ordered, "src", "dst", *(F.col(f"`{p}`") for p in sorted(edge)))
    nodes = graph.nodes if ready(graph.nodes) else written(graph.nodes, "nodes")
    limit = nodes.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    small = _bytes(nodes) <= _sized(limit)
    if not small and _used(step)[0]:
        dealt = _dealt(narrow) if ranged else _dealt(narrow, ranged)
        if not ranged:
            return nodes, dealt
        placed = _at_home(nodes, dealt)
        if nodes is not graph.nodes:
            forget(nodes)
        return placed, dealt
    return nodes, narrow if ready(graph.edges) else written(narrow, "edges")


def _put_away(edges: DataFrame | _Edges) -> None:
    """Drop the buckets of edges that no plan reads any more."""
    if isinstance(edges, _Edges):
        if edges.ranged:
            edges.cold.sparkSession.conf.set(ALL_KEYS, edges.all_keys)
        for x in (edges.cold, edges.hot, edges.ids):
            forget(x)


def _sized(setting: str) -> int:
    """Bytes of a setting such as 10485760b or 10MB."""
    number = setting.strip().lower().removesuffix("b")
    units = {"k": 10, "m": 20, "g": 30, "t": 40}
    return int(number[:-1]) << units[number[-1]] if number[-1:] in units else int(number)


@dataclass(frozen=True)
class Run:
    """Nodes after a run, the steps made, and whether the last one changed nothing (None if that was not asked); where
    only changed nodes send, also the messages of each step."""

    nodes: DataFrame
    steps: int
    converged: bool | None
    messages: tuple[int, ...] | None = None


def _advance(step: Superstep, nodes: DataFrame, edges: DataFrame | _Edges, no_message: object) -> tuple[DataFrame, int]:
    """One step, written to the shared folder; the same job counts the changes."""
    seen = Observation()
    nxt = superstep(step, nodes, edges, no_message)
    out = written(nxt.observe(seen, F.count_if(F.col("`$changed`")).alias("n")).drop("$changed"), "step")
    return out, seen.get["n"]


def iterate(program: Program | str, graph: Graph, steps: int, no_message: object = "current") -> Run:
    """Exactly ``steps`` supersteps."""
    step = lower(program)
    if steps <= 0:
        return Run(graph.nodes, 0, None)
    (nodes, edges), last = _prepared(step, graph), None
    for i in range(steps):
        if i == steps - 1:
            nodes = superstep(step, nodes, edges, no_message).drop("$changed")
            if isinstance(edges, _Edges):
                nodes = written(nodes.drop(HOME), "step")
                _put_away(edges)
            break
        nodes = written(superstep(step, nodes, edges, no_message).drop("$changed"), "step")
        step = _declare(step)
        if last is not None:
            forget(last)
        last = nodes
    return Run(nodes, steps, None)


@dataclass(frozen=True)
class Until:
    """When a run ends, and how a new value meets the old.

    mode: "equality" (nothing changes), "improve" (nothing improves, the same test), "delta" (no value moves by
    ``threshold`` or more), "newly_discovered" (no value that was ``unreached`` has a bit of ``active_mask``), or
    "fixed" (never before the limit). update: "overwrite", "min" or "max". Nodes without a message keep their values.
    """

    mode: str = "equality"
    update: str = "overwrite"
    threshold: float = 0.0
    active_mask: int = 0
    unreached: int = 0

    def __post_init__(self):
        if self.mode not in ("equality", "improve", "delta", "newly_discovered", "fixed") or self.update not in ("overwrite", "min", "max"):
            raise ValueError(f"unknown mode {self.mode} or update {self.update}")

    def open_(self, old: Column, new: Column, changed: Column) -> Column:
        """An aggregate that is zero (or null) once the run may end."""
        if self.mode == "delta":
            return F.count_if(F.abs(new - old) >= self.threshold)
        if self.mode == "newly_discovered":
            return F.count_if((new.bitwiseAND(F.lit(self.active_mask)) != 0) & (old == self.unreached))
        moved = {"overwrite": changed, "min": new < old, "max": new > old}[self.update]
        return F.count_if(moved)


def converge_until(program: Program | str, graph: Graph, limit: int, until: Until) -> Run:
    """Supersteps until ``until`` says so, ``limit`` at most; of the run it is told whether it ended by itself."""
    step = lower(program)
    if step.target not in step.program.node:
        raise ValueError(f"{step.target} has no first value")
    (nodes, edges), last = _prepared(step, graph), None
    for i in range(limit):
        raw = superstep(step, nodes, edges, "skip", keep_old=True)
        new, old, seen = F.col(f"`{step.target}`"), F.col("`$old`"), Observation()
        raw = raw.observe(seen, until.open_(old, new, F.col("`$changed`")).alias("n"))
        value = {"overwrite": new, "min": F.least(old, new), "max": F.greatest(old, new)}[until.update]
        nodes = written(raw.withColumn(step.target, value).drop("$changed", "$old"), "step")
        if last is not None:
            forget(last)
        last = nodes
        if until.mode != "fixed" and not seen.get["n"]:
            _put_away(edges)
            return Run(nodes.drop(HOME), i + 1, True)
    _put_away(edges)
    return Run(nodes.drop(HOME), limit, None if until.mode == "fixed" else False)


def _settled(program: Program | str, graph: Graph, limit: int, no_message: object) -> Run:
    """Supersteps until no node changes, ``limit`` at most."""
    from gasframe.operators import frontier

    step = lower(program)
    if no_message == "current" and limit > 1 and frontier.suits(step, graph.nodes.columns):
        return frontier.settled(step, graph, limit)
    (nodes, edges), last, done = _prepared(step, graph), None, Run(graph.nodes, 0, False)
    for i in range(limit):
        nodes, changes = _advance(step, nodes, edges, no_message)
        step = _declare(step)
        if last is not None:
            forget(last)
        last, done = nodes, Run(nodes.drop(HOME), i + 1, not changes)
        if not changes:
            break
    _put_away(edges)
    return done


def converge(program: Program | str, graph: Graph, limit: int, no_message: object = "current") -> Run:
    """Supersteps until no node changes; ``NoConvergence`` if one still does in step ``limit``."""
    done = _settled(program, graph, limit, no_message)
    if not done.converged:
        raise NoConvergence(f"still changing after {limit} steps")
    return done


def run(program: Program | str, graph: Graph, max_iters: int | None = None, no_message: object = "current") -> Run:
    """``max_iters`` steps exactly if given; else steps to the fixpoint, or ``DEFAULT_STEPS`` of them."""
    return iterate(program, graph, max_iters, no_message) if max_iters is not None else _settled(program, graph, DEFAULT_STEPS, no_message)


def timed(program: Program | str, graph: Graph, steps: int) -> dict:
    """Seconds for exactly ``steps`` steps, and edges per second in millions; the result is thrown away."""
    edges = graph.edges.count()
    began = time.perf_counter()
    iterate(program, graph, steps).nodes.write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - began
    return {"seconds": took, "steps": steps, "edges": edges, "mteps": edges * steps / took / 1e6}


def compare(actual: DataFrame, expected: DataFrame, prop: str, kind: str = "int") -> DataFrame:
    """(id, expected, actual) of the nodes of ``expected`` whose property differs or is missing."""
    both = expected.select("id", F.col(prop).alias("expected")).join(actual.select("id", F.col(prop).alias("actual")), "id", "left")
    same = equal(Typed(F.col("expected"), kind), Typed(F.col("actual"), kind))
    return both.where(~F.coalesce(same, F.lit(False)))


def explain(program: Program | str) -> str:
    """What a program computes in a step."""
    return lower(program).explain()


__all__ = ["Graph", "NoConvergence", "Run", "Until", "Var", "compare", "converge", "converge_until", "explain", "iterate", "run", "superstep", "timed"]
