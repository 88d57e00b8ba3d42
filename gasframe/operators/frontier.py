"""Supersteps in which only nodes that changed send.

Each node keeps what it has gathered. A node whose property moved sends along each of its edges what the message was and
what it is now; a destination merges the new messages into what it keeps. That is exact as long as messages only get
better. Where one got worse that may have been the best of its destination, that destination gathers anew from all of
its edges, so that the result is that of steps in which all nodes send, for any program with these reducers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gasframe.operators.graph import HOME, MARKS, Graph, Run, _Edges, _aggregate, _bytes, _prepared, _put_away, _scatter_member, _sized, _source_home, _used, applied, gathered, met, once, scattered
from gasframe.plans.columns import Compiler, Typed, kind_of
from gasframe.plans.dsl import Member
from gasframe.plans.superstep_plan import EDGE_VAR, Superstep, classify, walk
from gasframe.sources.scratch import forget, written

#: Reducers of which a node keeps the result, and those whose messages of zero are none.
KEPT, SPARSE = ("min", "max", "or"), ("masked_min",)
#: Changed nodes whose ids are named in the scan of bucketed edges, so that it reads their buckets alone.
NAMED = 256


def _reads(step: Superstep, e) -> bool:
    """Whether an expression reads the property that the program writes, of an edge's source."""
    return any(isinstance(x, Member) and x.base == Member(EDGE_VAR, "src") and x.name == step.target for x in walk(e))


def suits(step: Superstep, columns: list[str]) -> bool:
    """Whether a program can run so: its reducer keeps a best message, and where messages go does not change."""
    kind, target = classify(step.reducer)[0], step.target
    if target not in step.program.node or target not in columns or _reads(step, step.key):
        return False
    sent = Compiler(step.mask, _scatter_member(step)).compile(step.value, {}).kind
    if kind_of(step.program.node[target])[0] not in ("int", "float") or sent not in (("int", "float") if kind in ("min", "max") else ("int",)):
        return False
    return kind in KEPT or kind in SPARSE and not any(_reads(step, t) for t in step.tests)


def _message(step: Superstep, target: str) -> tuple[Column, Typed]:
    """The message of an edge, null if its tests fail, with the source's written property in the column ``target``."""
    plain = _scatter_member(step)

    def member(base, name):
        if base == Member(EDGE_VAR, "src") and name == step.target:
            return Typed(F.col(target), *kind_of(step.program.node[name]))
        return plain(base, name)

    compiler = Compiler(step.mask, member)
    value = compiler.compile(step.value, {})
    column = value.column
    for test in step.tests:
        column = F.when(compiler.compile(test, {}).column, column)
    return column, value


def changes(step: Superstep, nodes: DataFrame, edges: DataFrame | _Edges, moved: int) -> tuple[DataFrame, Typed]:
    """(k, new, old): the messages of the ``moved`` nodes whose property moved in the last step, as they are and were."""
    def columns():
        moving = ~F.col(f"`{step.target}`").eqNullSafe(F.col("`$old`"))
        (new, value), (old, _) = _message(step, f"s_{step.target}"), _message(step, "o_target")
        key = Compiler(step.mask, _scatter_member(step)).compile(step.key, {}).column
        source = [F.col("id").alias("s_id"), *(F.col(f"`{p}`").alias(f"s_{p}") for p in sorted(_used(step)[0])), F.col("`$old`").alias("o_target")]
        return moving, source, [key.alias("k"), new.alias("new"), old.alias("old")], value

    moving, source, out, value = once(step, "changes", columns)
    changed = nodes.where(moving)
    s = changed.select(*source, *_source_home(edges))
    if isinstance(edges, _Edges) and moved <= NAMED:
        named = changed.select("id", HOME).collect()
        ids, homes = [r[0] for r in named], [r[1] for r in named if r[1] is not None]
        edges = edges.cold.where(F.col(f"`{HOME}`").isin(homes) & F.col("src").isin(ids)).drop(HOME).unionByName(edges.hot.where(F.col("src").isin(ids)))
    if moved * 16 * len(s.columns) <= max(_sized(nodes.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")), 0):
        s = F.broadcast(s)
        if isinstance(edges, _Edges):
            edges = edges.all()
    return met(step, s, edges).select(*out), value


def _few(agg: DataFrame, total: int) -> DataFrame:
    """What ``total`` nodes at most have gathered, to be broadcast if that is small enough: then the nodes stay where
    they are."""
    limit = _sized(agg.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    return F.broadcast(agg) if total * 16 * len(agg.columns) <= limit else agg


def _merging(kind: str, columns: list[str]) -> tuple[list[Column], list[Column]]:
    """What is gathered of new and old messages, and the columns of nodes with it merged in."""
    new, old, g, d, lost = (F.col(c) for c in ("new", "old", "`$g`", "d", "lost"))
    zero = F.lit(0).cast("bigint")
    if kind == "or":
        agg = [F.bit_or("new").alias("d"), F.bit_or(old.bitwiseAND(F.bitwise_not(F.coalesce(new, zero)))).alias("lost")]
        merged, worse = F.coalesce(g.bitwiseOR(d), g, d), lost.bitwiseAND(F.bitwise_not(F.coalesce(d, zero))) != 0
    else:
        pick, best = (F.min, F.least) if kind == "min" else (F.max, F.greatest)
        back = new > old if kind == "min" else new < old
        agg = [pick("new").alias("d"), pick(F.when(old.isNotNull() & (new.isNull() | back), old)).alias("lost")]
        covered = d <= lost if kind == "min" else d >= lost
        merged, worse = best(g, d), (lost == g) & ~F.coalesce(covered, F.lit(False))
    rest = [F.col(f"`{c}`") for c in columns if c not in (*MARKS, "$old", "$changed")]
    return [F.count("*").alias("n"), *agg], [*rest, merged.alias("$g"), F.coalesce(worse, F.lit(False)).alias("$lost"), F.coalesce("n", F.lit(0)).alias("$sent")]


def _merged(step: Superstep, kind: str, nodes: DataFrame, messages: DataFrame, total: int) -> DataFrame:
    """``nodes`` with the new messages merged into ``$g``; ``$lost`` where a message got worse that may have made it."""
    agg, out = once(step, "merging", lambda: _merging(kind, nodes.columns))
    gathered_ = messages.groupBy("k").agg(*agg)
    return nodes.drop("$lost", "$sent", "$old", "$changed").join(_few(gathered_, total), once(step, "here", lambda: F.col("id") == F.col("k")), "left").select(*out)


def _gathered_anew(step: Superstep, merged: DataFrame, nodes: DataFrame, edges: DataFrame | _Edges) -> DataFrame:
    """``merged`` with ``$g`` of the lost nodes gathered from all their edges. ``nodes`` are those of the last step."""
    messages, value = scattered(step, nodes, edges)
    lost = merged.where("`$lost`").select(F.col("id").alias("k"))
    if _bytes(lost) <= max(_sized(nodes.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")), 0):
        lost = F.broadcast(lost)
    agg, _ = gathered(step, messages.join(lost, "k", "left_semi"), value)
    joined = merged.join(agg, F.col("id") == F.col("k"), "left")
    return joined.select(*(F.col(f"`{c}`") for c in merged.columns if c != "$g"), F.when(F.col("`$lost`"), F.col("g")).otherwise(F.col("`$g`")).alias("$g"))


def _stepped(step: Superstep, joined: DataFrame, columns: list[str], g: Typed) -> tuple[DataFrame, dict]:
    """The apply over gathered values ``$g``, written; the same job counts the nodes that changed, that moved at all, and
    that lost a message, and the messages that came to any."""
    def made():
        moved = ~F.col(f"`{step.target}`").eqNullSafe(F.col("`$old`"))
        counts = {"changed": F.col("`$changed`"), "moved": moved, "lost": F.col("`$lost`")}
        observed = [*(F.count_if(c).alias(n) for n, c in counts.items()), F.sum("`$sent`").alias("sent"), F.count("*").alias("nodes")]
        return F.col("`$g`").isNotNull(), tuple(F.col(f"`{c}`") for c in MARKS), observed

    (has, marks, observed), seen = once(step, "stepped", made), Observation()
    out = applied(step, joined, columns, has, g, keep_old=True, keep=marks)
    return written(out.observe(seen, *observed), "step"), seen.get


def _gathering(step: Superstep, messages: DataFrame, value: Typed) -> tuple[DataFrame, Typed]:
    """(k, g, n): what each destination gathers, and of how many messages."""
    column, held = _aggregate(classify(step.reducer), Typed(F.col("v"), value.kind, value.parts, value.size), step, step.reducer)
    return messages.groupBy("k").agg(column.alias("g"), F.count("*").alias("n")), held


def _kept_step(step: Superstep, kind: str, now: DataFrame, edges: DataFrame | _Edges, columns: list[str], g: Typed, told: dict) -> tuple[DataFrame, dict]:
    messages, _ = changes(step, now, edges, told["moved"])
    out, told = _stepped(step, _merged(step, kind, now, messages, told["nodes"]), columns, g)
    if not told["lost"]:
        return out, told
    before = now.select(*(F.col(f"`{c}`") for c in columns))
    merged = before.join(out.select("id", *(F.col(f"`{c}`") for c in MARKS)), "id")
    again = _stepped(step, _gathered_anew(step, merged, before, edges), columns, g)
    forget(out)
    return again


def _active(step: Superstep, nodes: DataFrame) -> DataFrame:
    """The nodes whose message is not zero, where that depends on the node alone; else all."""
    if _used(step)[1] or any(x == Member(EDGE_VAR, "dst") for x in walk(step.value)):
        return nodes

    def member(base, name):
        if base == EDGE_VAR and name == "src":
            return Typed(F.col("id"), "int")
        if base == Member(EDGE_VAR, "src") and name in step.program.node:
            return Typed(F.col(f"`{name}`"), *kind_of(step.program.node[name]))
        return None

    return nodes.where(Compiler(step.mask, member).compile(step.value, {}).column != 0)


def _sparse_step(step: Superstep, now: DataFrame, edges: DataFrame | _Edges, columns: list[str], g: Typed) -> tuple[DataFrame, dict]:
    """Only messages other than zero are sent; a node that has edges but no such message gathers zero."""
    messages, value = scattered(step, _active(step, now), edges)
    agg, _ = _gathering(step, messages.where("v != 0"), value)
    joined = now.drop("$old", "$changed", "$sent").withColumnRenamed("$g", "$had").join(agg, F.col("id") == F.col("k"), "left")
    zero = F.when(F.col("`$had`").isNotNull(), F.coalesce("g", F.lit(0).cast("bigint")))
    return _stepped(step, joined.withColumns({"$g": zero, "$sent": F.coalesce("n", F.lit(0))}), columns, g)


def settled(step: Superstep, graph: Graph, limit: int) -> Run:
    """Supersteps until no node changes, ``limit`` at most; all nodes send in the first, and then those that moved."""
    kind = classify(step.reducer)[0]
    nodes, edges = _prepared(step, graph, ordered=False)
    columns = nodes.columns
    messages, value = scattered(step, nodes, edges)
    agg, g = _gathering(step, messages, value)
    g = Typed(F.col("`$g`"), g.kind, g.parts, g.size)
    joined = nodes.join(agg.withColumnRenamed("g", "$g"), F.col("id") == F.col("k"), "left")
    now, told = _stepped(step, joined.withColumns({"$lost": F.lit(False), "$sent": F.coalesce("n", F.lit(0))}), columns, g)
    sent = [told["sent"] or 0]
    while told["changed"] and len(sent) < limit:
        last = now
        now, told = _sparse_step(step, now, edges, columns, g) if kind in SPARSE else _kept_step(step, kind, now, edges, columns, g, told)
        sent.append(told["sent"] or 0)
        forget(last)
    _put_away(edges)
    return Run(now.select(*(F.col(f"`{c}`") for c in columns if c != HOME)), len(sent), not told["changed"], tuple(sent))
