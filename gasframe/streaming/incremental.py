"""Keeping a converged property up to date while edges stream in and out."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gasframe.operators.graph import Graph, NoConvergence, _scatter_member
from gasframe.plans.columns import Compiler, Typed, kind_of
from gasframe.plans.dsl import Binary, Lit, Member, Ternary, Var
from gasframe.plans.superstep_plan import EDGE_VAR, SELF, PlanError, Superstep, classify, lower, walk
from gasframe.sources.scratch import forget, shared_dir, written

MONOTONE = ("min", "max", "or")
#: Tables of edges that are read side by side.
MOST_PARTS = 64
#: The edge, and its source, that gave a node its value; and the value that it had at first.
_MARKS = ("$edge", "$from", "$first")


def _static(step: Superstep, e) -> bool:
    return not any(x == Member(Member(EDGE_VAR, "src"), step.target) for x in walk(e))


def _rising(step: Superstep, e) -> bool:
    """Whether a message never falls where the source's property rises: the property itself, with what does not depend
    on it added or taken away, masked or united, or times a number."""
    if e == Member(Member(EDGE_VAR, "src"), step.target) or _static(step, e):
        return True
    if isinstance(e, Binary):
        a, b = e.left, e.right
        if e.op in "+&|":
            return _rising(step, a) and _rising(step, b) and (e.op == "+" or classify(step.reducer)[0] == "or")
        if e.op == "-":
            return _rising(step, a) and _static(step, b)
        if e.op == "*":
            return any(isinstance(x, Lit) and x.value >= 0 and _rising(step, y) for x, y in ((a, b), (b, a)))
    return isinstance(e, Ternary) and _static(step, e.test) and _rising(step, e.then) and _rising(step, e.other)


def _keeps(step: Superstep, kind: str) -> bool:
    """Whether the apply gives the better of the gathered value and the node's own."""
    own, got, e = Member(SELF, step.target), Var(step.apply.params[0]), step.apply.body
    if kind == "or":
        return isinstance(e, Binary) and e.op == "|" and {e.left, e.right} == {own, got}
    if not (isinstance(e, Ternary) and isinstance(e.test, Binary) and e.test.op in ("<", "<=", ">", ">=")):
        return False
    t = e.test
    if {t.left, t.right} != {own, got} or {e.then, e.other} != {own, got}:
        return False
    return ((t.op[0] == "<") == (e.then == t.left)) == (kind == "min")


def checked(program: str) -> tuple[Superstep, str]:
    """The step of a program that can be kept up to date, and its reducer's kind; or ``PlanError``."""
    step = lower(program)
    kind = classify(step.reducer)[0]
    good = kind in MONOTONE and step.apply is not None and step.target in step.program.node and step.key == Member(EDGE_VAR, "dst")
    if not good or not _keeps(step, kind) or not _rising(step, step.value) or not all(_static(step, t) for t in step.tests):
        raise PlanError("NotMonotone", step.target)
    return step, kind


class Incremental:
    """Re-converges from the last state after each micro-batch of added and deleted edges.

    For programs whose reducer moves a property one way (minimum, maximum, or), whose apply gives the better of the
    gathered value and the node's own, and whose messages rise with the property they come from. New edges send once,
    and then the nodes that changed. Each node knows the edge that gave it its value. Where an edge is deleted, the
    nodes that have their value from it, directly or through others, get their first value back, gather from all their
    edges, and the rest follows. With or-reducers, and where messages are better than what their source has (a
    negative weight), that edge alone proves nothing: then all nodes behind a deleted edge start anew.

    ``state`` is a folder in shared storage. A batch writes new tables there and is committed by renaming a small file
    that names them; a batch number that has been committed before is passed over, and a new ``Incremental`` on the
    same folder goes on from the last commit. Edges are known by ``eid``.
    """

    def __init__(self, program: str, graph: Graph | None, first: Column, limit: int = 1000, state: str | None = None, spark: SparkSession | None = None):
        self.step, self.kind = checked(program)
        self.spark = spark or graph.nodes.sparkSession
        self.target, self.first, self.limit = self.step.target, first, limit
        self.state = (state or f"{shared_dir(self.spark)}/incremental-{uuid.uuid4().hex}").rstrip("/")
        self.batch = -1
        if not self._resume():
            if graph is None:
                raise ValueError(f"{self.state} holds no state, and there is no graph to start from")
            self._edge_schema = graph.edges.schema
            self.parts, self.gone, self.better = [self._put(graph.edges.withColumn("$batch", F.lit(-1).cast("long")), "edges")], [], False
            nodes = graph.nodes.withColumn("$first", F.col(f"`{self.target}`"))
            nodes = nodes.withColumns({"$edge": F.lit(None).cast("long"), "$from": F.lit(None).cast("long")})
            self._nodes = written(nodes, "stream-nodes")
            self._settle(self._messages(self._nodes, self.edges))
            self._commit(-1)

    # -- state -------------------------------------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _put(self, df: DataFrame, label: str) -> str:
        path = f"{self.state}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _resume(self) -> bool:
        p, fs = self._fs(f"{self.state}/commits")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        numbers = [int(n) for n in names if n.lstrip("-").isdigit()]
        if not numbers:
            return False
        text = "".join(r.value for r in self.spark.read.text(f"{self.state}/commits/{max(numbers)}").collect())
        held = json.loads(text)
        self.batch, self.parts, self.gone, self.better = held["batch"], held["edges"], held["gone"], held["better"]
        self._edge_schema = StructType.fromJson(held["schema"])
        self._nodes = self.spark.read.parquet(held["nodes"])
        return True

    def _commit(self, batch: int) -> None:
        """Write the nodes, and then name the tables of the state in a file that appears by a rename."""
        path = self._put(self._nodes, "nodes")
        held = {"batch": batch, "edges": self.parts, "gone": self.gone, "better": self.better, "nodes": path, "schema": self._edge_schema.jsonValue()}
        temp, fs = self._fs(f"{self.state}/writing-{uuid.uuid4().hex}")
        out = fs.create(temp)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        final, _ = self._fs(f"{self.state}/commits/{batch}")
        fs.mkdirs(final.getParent())
        if not fs.rename(temp, final):
            raise RuntimeError(f"batch {batch} is already committed by another writer")
        forget(self._nodes)
        self._nodes, self.batch = self.spark.read.parquet(path), batch

    @property
    def nodes(self) -> DataFrame:
        """The nodes with their properties, as of the last committed batch."""
        return self._nodes.drop(*_MARKS)

    @property
    def edges(self) -> DataFrame:
        """All edges that were added and not deleted since."""
        held = self.spark.read.parquet(*self.parts)
        if self.gone:
            gone = self.spark.read.parquet(*self.gone).groupBy(F.col("eid").alias("g_eid")).agg(F.max("batch").alias("g_batch"))
            held = held.join(gone, (F.col("eid") == F.col("g_eid")) & (F.col("$batch") < F.col("g_batch")), "left_anti")
        return held.drop("$batch")

    # -- a batch -----------------------------------------------------------------------------------------------------

    def add(self, batch: DataFrame, batch_id: int | None = None) -> None:
        """Take in edges (eid, src, dst, properties...), added, or deleted where a column ``deleted`` is true; of these
        only ``eid`` counts, and edges of earlier batches are meant. ``first`` gives new nodes their property as a
        column over id. Fits ``foreachBatch``: a batch number that was committed is passed over."""
        batch_id = self.batch + 1 if batch_id is None else batch_id
        if batch_id <= self.batch:
            return
        batch = written(batch, "stream-batch")
        out = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in batch.columns else F.lit(False)
        columns = [f.name for f in self._edge_schema]
        fresh = batch.where(~out).select(*(F.col(f"`{c}`") for c in columns))
        cut = batch.where(out).select("eid").distinct()
        ends = fresh.select(F.col("src").alias("id")).union(fresh.select("dst")).distinct().join(self._nodes, "id", "left_anti")
        new = ends.withColumn(self.target, self.first).withColumn("$first", F.col(f"`{self.target}`"))
        self._nodes = written(self._nodes.unionByName(new, allowMissingColumns=True), "stream-nodes")
        reset = None
        if not cut.isEmpty():
            before = self.edges
            reset = self._unsupported(cut, before)
            self.gone = [*self.gone, self._put(cut.withColumn("batch", F.lit(batch_id).cast("long")), "gone")]
        self.parts = [*self.parts, self._put(fresh.withColumn("$batch", F.lit(batch_id).cast("long")), "edges")]
        if len(self.parts) > MOST_PARTS:
            self.parts, self.gone = [self._put(self.edges.withColumn("$batch", F.lit(batch_id).cast("long")), "edges")], []
        messages = self._messages(self._nodes, fresh)
        if reset is not None:
            self._reset(reset)
            into = self.edges.join(reset.select(F.col("id").alias("dst")), "dst", "left_semi")
            messages = self._messages(self._nodes, fresh.select(*columns).unionByName(into.select(*columns)))
        self._settle(messages)
        self._commit(batch_id)
        forget(batch)

    def start(self, stream: DataFrame, checkpoint: str):
        """The running query over a stream of edges."""
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).start()

    def _messages(self, senders: DataFrame, edges: DataFrame) -> DataFrame:
        """(k, v, eid, src): what ``senders`` send along ``edges``."""
        props = [c for c in senders.columns if c in self.step.program.node]
        s = senders.select(F.col("id").alias("s_id"), *(F.col(f"`{c}`").alias(f"s_{c}") for c in props))
        known = [f.name for f in self._edge_schema if f.name in self.step.program.edge]
        e = edges.select("eid", "src", "dst", *(F.col(f"`{c}`").alias(f"e_{c}") for c in known)).join(s, F.col("src") == F.col("s_id"))
        compiler = Compiler(self.step.mask, _scatter_member(self.step))
        for test in self.step.tests:
            e = e.where(compiler.compile(test, {}).column)
        value = compiler.compile(self.step.value, {}).column
        own = F.col(f"s_{self.target}")
        better = value < own if self.kind == "min" else value > own
        return e.select(F.col("dst").alias("k"), value.alias("v"), "eid", "src", F.coalesce(better, F.lit(False)).alias("better"))

    def _best(self, messages: DataFrame) -> DataFrame:
        """(k, v, eid, src, better): the best message of a destination, of equal ones that of the least edge, and whether
        any is better than what its source has."""
        if self.kind == "or":
            return messages.groupBy("k").agg(F.bit_or("v").alias("v"), F.lit(None).cast("long").alias("eid"), F.lit(None).cast("long").alias("src"), F.lit(False).alias("better"))
        sign = 1 if self.kind == "min" else -1
        best = F.min(F.struct((F.col("v") * sign).alias("by"), "eid", "src", "v"))
        return messages.where(F.col("v").isNotNull()).groupBy("k").agg(best.alias("b"), F.max("better").alias("better")).select("k", "b.v", "b.eid", "b.src", "better")

    def _settle(self, messages: DataFrame) -> None:
        """Merge messages into the nodes, and let those that improve send, until none does."""
        own, v, edges = F.col(f"`{self.target}`"), F.col("v"), None
        kind = kind_of(self.step.program.node[self.target])[0]
        for _ in range(self.limit):
            seen, best = Observation(), self._best(messages)
            joined = self._nodes.drop("$moved").join(best, F.col("id") == F.col("k"), "left")
            gain = own.bitwiseOR(v) != own if self.kind == "or" else v < own if self.kind == "min" else v > own
            gain = F.coalesce(gain, F.lit(False))
            value = own.bitwiseOR(v) if self.kind == "or" else v.cast("double" if kind == "float" else "bigint")
            rest = [F.col(f"`{c}`") for c in self._nodes.columns if c not in (self.target, "$edge", "$from", "$moved")]
            out = joined.select(*rest, "better", F.when(gain, value).otherwise(own).alias(self.target), F.when(gain, F.col("eid")).otherwise(F.col("`$edge`")).alias("$edge"), F.when(gain, F.col("src")).otherwise(F.col("`$from`")).alias("$from"), gain.alias("$moved"))
            out = out.withColumn("$odd", F.coalesce("better", F.lit(False))).observe(seen, F.count_if("`$moved`").alias("n"), F.count_if("`$odd`").alias("odd"))
            last, self._nodes = self._nodes, written(out.drop("$odd", "better"), "stream-nodes")
            forget(last)
            self.better = self.better or bool(seen.get["odd"])
            if not seen.get["n"]:
                path, self._nodes = self._nodes._scratch_path, self._nodes.drop("$moved")
                self._nodes._scratch_path = path
                return
            edges = self.edges if edges is None else edges
            messages = self._messages(self._nodes.where("`$moved`"), edges)
        raise NoConvergence(f"still changing after {self.limit} steps")

    def _unsupported(self, cut: DataFrame, edges: DataFrame) -> DataFrame:
        """(id): the nodes whose value hangs on a deleted edge; or, where it cannot be told, all nodes behind one."""
        tree = self.kind != "or" and not self.better
        if tree:
            links = self._nodes.where("`$edge` IS NOT NULL").select(F.col("id").alias("dst"), F.col("`$from`").alias("src"), F.col("`$edge`").alias("eid"))
            front = links.join(cut, "eid", "left_semi").select(F.col("dst").alias("id")).distinct()
        else:
            links = edges.select("src", "dst", "eid")
            front = links.join(cut, "eid", "left_semi").select(F.col("dst").alias("id")).distinct()
        links = written(links.select("src", "dst"), "stream-links")
        found = front = written(front, "stream-reset")
        while not front.isEmpty():
            after = links.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
            front = written(after.join(found, "id", "left_anti"), "stream-reset")
            found = written(found.union(front), "stream-reset")
        forget(links)
        return found

    def _reset(self, reset: DataFrame) -> None:
        """Give the nodes of ``reset`` their first value."""
        marked = self._nodes.join(reset.withColumn("$reset", F.lit(True)), "id", "left")
        again, none = F.col("`$reset`").isNotNull(), F.lit(None).cast("long")
        out = marked.withColumns({self.target: F.when(again, F.col("`$first`")).otherwise(F.col(f"`{self.target}`")), "$edge": F.when(again, none).otherwise(F.col("`$edge`")), "$from": F.when(again, none).otherwise(F.col("`$from`"))})
        last, self._nodes = self._nodes, written(out.select(*(F.col(f"`{c}`") for c in self._nodes.columns)), "stream-nodes")
        forget(last)
