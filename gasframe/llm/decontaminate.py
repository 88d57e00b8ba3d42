"""Benchmark decontamination by latent semantic retrieval and verification of what it finds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gasframe.llm.common import checked_broadcast, written

#: Words of a benchmark passage and their overlap; words of half a document window; words between the starts of the
#: parts of a long item that are verified.
PASSAGE, OVERLAP, HALF, SHIFT = 64, 16, 16, 12
#: Benchmark passages that share a basis (one of more than ``HEAVY`` bytes counts for as many as these would hold), blocks
#: of them that one pass over the documents searches for, rank of a basis, and extra columns.
BLOCK, HEAVY, BLOCKS, RANK, EXTRA = 512, 4096, 4, 256, 16
#: Of a candidate: least share of a passage's latent vector that the window's projection on it reaches, least cosine.
MIN_SHARE, MIN_COSINE = 0.3, 0.4
#: Share of a passage's words, as longest common subsequence, that proves a copy; and a paraphrase if the answer is there,
#: which is this share of the weight of the answer's words.
COPY, PARAPHRASE, ANSWER = 0.8, 0.6, 0.8
#: Items with fewer words are found only where all their words stand side by side.
MIN_ITEM = 5
#: Every ASCII character but letters and digits parts words.
_PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased and in UTF-8: runs of ASCII letters, digits and characters beyond ASCII."""
    return (text or "").lower().encode().translate(_PLAIN).split()


def _chunks(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


@dataclass(frozen=True)
class Unit:
    """A benchmark passage: a hash of its item, words of the item around it, where in these it starts and ends, the
    words of the item, and those of its answer."""

    item: int
    words: list[bytes]
    start: int
    end: int
    length: int
    answer: list[bytes]

    @property
    def passage(self) -> list[bytes]:
        return self.words[self.start : self.end]

    @property
    def short(self) -> bool:
        return self.length < MIN_ITEM


def units_of(item: int, text: str, answer: str | None) -> Iterator[Unit]:
    """The passages of an item; none if it has no word. The answer is the one given or else the last sentence, and of
    a long one its last ``PASSAGE`` words."""
    words, step = words_of(text), PASSAGE - OVERLAP
    if not words:
        return
    last = words_of(answer) if answer is not None else words_of([x for x in re.split(r"(?<=[.!?])\s+", text.strip()) if words_of(x)][-1])
    for at in range(0, max(1, len(words) - OVERLAP), step):
        low = max(0, at - step)
        part = words[low : at + PASSAGE + step]
        yield Unit(item, part, at - low, min(at - low + PASSAGE, len(part)), len(words), last[-PASSAGE:])


def _numbered(benchmark: DataFrame, item_text: str, answer_col: str | None) -> tuple[DataFrame, int]:
    """The units of the different texts of a benchmark, as a written table with the number of each one's block, and the
    number of blocks. Units are numbered by running weight, within each task and then over tasks, so that no block holds
    more than ``BLOCK`` and the last unit's, however the texts repeat and however long one is."""
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    texts = benchmark.select(F.col(item_text).cast("string").alias("text"), answer.alias("answer")).where("text IS NOT NULL").distinct()
    texts = texts.select(F.xxhash64("text", "answer").alias("item"), "text", "answer")

    def cut(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for item, text, answer in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                for u in units_of(item, text, answer):
                    body = b" ".join(u.words)
                    rows.append((part, at, u.item, body, u.start, u.end, u.length, b" ".join(u.answer)))
                    at += 1 + len(body) // HEAVY
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["part", "at", "item", "words", "start", "stop", "length", "answer"])

    units = written(texts.mapInArrow(cut, "part long, at long, item long, words binary, start long, stop long, length long, answer binary"), "units")
    ends = units.groupBy("part").agg((F.max(F.col("at") + 1 + F.floor(F.octet_length("words") / HEAVY))).alias("size")).orderBy("part").collect()
    before = np.cumsum([0, *(r["size"] for r in ends)]).tolist()
    if not ends:
        return units, 0
    first = F.element_at(F.create_map(*(F.lit(x) for r, n in zip(ends, before) for x in (r["part"], n))), F.col("part"))
    return units.withColumn("block", F.floor((first + F.col("at")) / BLOCK)), -(-before[-1] // BLOCK)


def vocabulary(units: list[Unit]) -> dict[bytes, int]:
    """The words of passages that are long enough to be searched for, and their numbers."""
    return {w: i for i, w in enumerate(sorted({w for u in units if not u.short for w in u.words}))}


def document_weights(docs: DataFrame, known: dict[bytes, int], text_col: str = "text") -> np.ndarray:
    """Inverse document frequencies of the ``known`` words, over all rows of ``docs``; partial counts are summed by
    Spark, and what comes to the driver is as large as the number of words. A word of every document weighs
    log 2, so that no word is left out, however many documents hold it."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches):
        place = sent.value
        wanted, n, total = set(place), np.zeros(len(place), np.int64), 0
        for part in _chunks(batches):
            for text in part.column(0):
                total += 1
                n[[place[w] for w in wanted.intersection(words_of(text.as_py()))]] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[n[at], total])], ["word", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    at, seen = rows.column("word").to_numpy(), rows.column("n").to_numpy()
    n = np.zeros(len(known), np.int64)
    n[at[at >= 0]] = seen[at >= 0]
    return np.log1p((float(seen[at < 0].sum()) + 1.0) / (n + 1.0)).astype(np.float32)


def _row(words: list[bytes], place: dict[bytes, int], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    f, tf = np.unique(np.fromiter(map(place.__getitem__, words), np.int64, len(words)), return_counts=True)
    w = tf * weight[f]
    return f, (w / max(float(np.linalg.norm(w)), 1e-12)).astype(np.float64)


def latent_basis(units: DataFrame, place: dict[bytes, int], weight: np.ndarray, rank: int = RANK, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(words, basis): the numbers of the words of the passages of ``units``, and the leading right singular
    vectors of their TF-IDF matrix, a row per word.

    Randomised: with a fixed random matrix O, the columns of A'(A O) span the range, orthonormalised once; the small
    matrix (A Q)'(A Q) gives the rotation to singular vectors. Both products are summed by Spark from a partial block
    per partition, row by row. A block of passages is bounded (``_numbered``), and with it words and basis.
    """
    spark = units.sparkSession
    wide = rank + EXTRA
    held = spark.sparkContext.broadcast((place, weight))

    def rows_of(batches):
        place, weight = held.value
        for part in _chunks(batches):
            for words, start, stop in zip(*(c.to_pylist() for c in part.columns)):
                yield _row(words.split()[start:stop], place, weight)

    def random_rows(f: np.ndarray) -> np.ndarray:
        return np.stack([np.random.default_rng([seed, int(x)]).standard_normal(wide) for x in f])

    def packed(index, rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], ["i", "v"])

    def spread(batches):
        total: dict[int, np.ndarray] = {}
        for f, w in rows_of(batches):
            y = w @ random_rows(f)
            for x, v in zip(f.tolist(), w.tolist()):
                total[x] = total.get(x, 0.0) + v * y
        yield packed(list(total), total.values())

    def summed(f) -> tuple[np.ndarray, np.ndarray]:
        parts = units.select("words", "start", "stop").mapInArrow(f, "i long, v array<double>")
        got = parts.groupBy("i").agg(F.array(*(F.sum(F.col("v")[c]) for c in range(wide))).alias("v")).orderBy("i").toArrow()
        return got.column("i").to_numpy(), got.column("v").combine_chunks().flatten().to_numpy().reshape(got.num_rows, wide)

    index, sketch = summed(spread)
    if not len(index):
        return index, np.zeros((0, 1), np.float32)
    q, _ = np.linalg.qr(sketch)
    cols = q.shape[1]
    basis = spark.sparkContext.broadcast((index, q))

    def small(batches):
        index, q = basis.value
        total = np.zeros((wide, wide))
        for f, w in rows_of(batches):
            y = w @ q[np.searchsorted(index, f)]
            total[:cols, :cols] += np.outer(y, y)
        yield packed(range(cols), total[:cols])

    _, gram = summed(small)
    value, vector = np.linalg.eigh(gram[:, :cols])
    keep = np.argsort(value)[::-1][:rank]
    keep = keep[value[keep] > 1e-9 * max(value.max(), 1e-30)]
    basis.destroy()
    return index, (q @ vector[:, keep]).astype(np.float32)


def common_length(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, a bit per word of ``a``."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & at.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _parts(u: Unit) -> list[list[bytes]]:
    """Of a passage of a longer item, runs of ``PASSAGE`` words of the item around it, so close that any run of that
    length shares most of its words with one of them."""
    if len(u.words) <= PASSAGE:
        return []
    return [u.words[x : x + PASSAGE] for x in sorted({min(x, len(u.words) - PASSAGE) for x in range(0, len(u.words), SHIFT)})]


class _Search:
    """Candidate windows of documents for one block of benchmark passages, and their verification."""

    def __init__(self, units: list[Unit], place: dict[bytes, int], weight: np.ndarray, index: np.ndarray, basis: np.ndarray):
        self.units = [u for u in units if not u.short]
        self.short: dict[bytes, list[tuple[list[bytes], int]]] = {}
        for u in units:
            if u.short:
                self.short.setdefault(u.passage[0], []).append((u.passage, u.item))
        row = {int(x): i for i, x in enumerate(index)}
        self.vocabulary = {w: row[place[w]] for u in self.units for w in u.passage}
        self.basis = basis * weight[index][:, None] if len(index) else basis
        self.weight = {w: float(weight[i]) for w, i in place.items()}
        rows = [self.basis[[self.vocabulary[w] for w in u.passage]].sum(axis=0) for u in self.units]
        self.queries = np.array(rows, np.float32).reshape(len(rows), self.basis.shape[1])
        self.size = np.maximum(np.linalg.norm(self.queries, axis=1), 1e-9).astype(np.float32)
        self.queries /= self.size[:, None]
        self.least = MIN_SHARE * float(self.size.min(initial=np.inf))

    def candidates(self, words: list[bytes]) -> dict[int, list[tuple[float, int]]]:
        """Of each unit, the windows (cosine, first word) of a document that lie near it."""
        got = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words))
        held = np.flatnonzero(got >= 0)
        if not len(held):
            return {}
        half = held // HALF
        first = np.flatnonzero(np.r_[True, half[1:] != half[:-1]])
        place = half[first]
        out: dict[int, list[tuple[float, int]]] = {}
        for cut in range(0, len(place), _WINDOWS):
            mine = place[cut : cut + _WINDOWS]
            over = place[cut + len(mine) : cut + len(mine) + 1]  # the half after the last belongs to the last window too
            ends = first[cut + len(mine) + len(over)] if cut + len(mine) + len(over) < len(first) else len(held)
            starts = first[cut : cut + len(mine) + len(over)]
            sums = np.add.reduceat(self.basis[got[held[starts[0] : ends]]], starts - starts[0], axis=0)
            own = np.r_[mine, over]
            window = np.unique(np.r_[mine, mine[mine > 0] - 1])
            latent = np.zeros((len(window), sums.shape[1]), np.float32)
            latent[np.searchsorted(window, mine)] = sums[: len(mine)]
            at = np.minimum(np.searchsorted(window, own - 1), len(window) - 1)
            after = window[at] == own - 1
            latent[at[after]] += sums[after]
            norm = np.linalg.norm(latent, axis=1)
            near = np.flatnonzero(norm >= self.least)
            if not len(near):
                continue
            dot = latent[near] @ self.queries.T
            hit = (dot >= MIN_COSINE * norm[near][:, None]) & (dot >= MIN_SHARE * self.size)
            for i, j in zip(*np.nonzero(hit)):
                out.setdefault(int(j), []).append((float(dot[i, j] / norm[near[i]]), int(window[near[i]]) * HALF))
        return out

    def verified(self, words: list[bytes]) -> Iterator[tuple]:
        """(item, first word, cosine, share, kind) of each unit that a document holds."""
        for n, windows in self.candidates(words).items():
            u, best = self.units[n], None
            want, near = u.passage, len(u.passage)
            for cosine, at in windows:
                part = words[max(0, at - near) : at + 2 * HALF + near]
                share = common_length(want, part) / near
                if share < COPY:
                    held = max((common_length(p, part) / len(p) for p in _parts(u)), default=0.0)
                    share = held if held >= COPY else share
                if share >= PARAPHRASE and (best is None or share > best[2]):
                    copied = share >= COPY
                    if not copied:
                        around = set(words[max(0, at - u.length) : at + 2 * HALF + u.length])
                        weight = [self.weight.get(w, 1.0) for w in u.answer]
                        copied = None if weight and sum(x for w, x in zip(u.answer, weight) if w in around) >= ANSWER * sum(weight) else False
                    if copied is not False:
                        best = (at, cosine, share, "copy" if copied else "paraphrase")
                        if share == 1:
                            break
            if best:
                yield (u.item, *best)
        if self.short:
            for at, w in enumerate(words):
                for want, item in self.short.get(w, ()):
                    if words[at : at + len(want)] == want:
                        yield item, at, 1.0, 1.0, "words"


#: Windows that are compared with all passages of a block at once.
_WINDOWS = 4096


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None) -> DataFrame:
    """(doc_id, key, item_id, at, cosine, share, kind) for each document and benchmark item that it holds; key is a
    hash of the text, at the first word of the best window.

    Benchmark items are the stated query set. Their different texts are cut into passages, and these into blocks of
    ``BLOCK``; for each block, the basis is fitted on all its passages, and all whole texts pass by in windows of 2 x
    16 words, half overlapping. A window near a passage in the latent space is a candidate, and verified by the
    longest common subsequence of the passage's words and the window with as many words around it: a copy holds
    ``COPY`` of them, or of ``PASSAGE`` words around it in a longer item, a paraphrase ``PARAPHRASE`` and the words
    of the answer (``answer_col``, or else the item's last sentence), by weight. An item of fewer than ``MIN_ITEM``
    words has too little to compare; it is found where its words stand side by side (kind ``words``).

    Null and empty texts hold nothing and items without a word are held by nothing; items of the same text are found
    alike, whatever their ids, null ones too; rows of the same id and text give one result; extra columns are not
    read; no rows on either side give no rows. Texts and items of any length are searched whole. One pass over the
    documents counts words and one searches, for each ``BLOCKS`` blocks.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    raw = f"doc_id {kind}, key long, item long, at long, cosine double, share double, kind string"
    units, blocks = _numbered(benchmark, item_text, answer_col)
    if not blocks:
        return spark.createDataFrame([], raw.replace("item long", f"item_id {item_kind}"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("key"))
    found = None
    for b in range(0, blocks, BLOCKS):
        some = rows.mapInArrow(_searcher(docs, units, range(b, min(b + BLOCKS, blocks)), text_col, raw), raw)
        found = some if found is None else found.union(some)
    best = found.groupBy("doc_id", "key", "item").agg(F.max(F.struct("share", "cosine", (-F.col("at")).alias("at"), "kind")).alias("b"))
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    named = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_col).alias("item_id"), F.xxhash64(F.col(item_text).cast("string"), answer).alias("item")).distinct()
    return written(best, "best").join(named, "item").select("doc_id", "key", "item_id", (-F.col("b.at")).alias("at"), "b.cosine", "b.share", "b.kind")


def _searcher(docs: DataFrame, units: DataFrame, blocks: range, text_col: str, schema: str):
    """The search for the units of some blocks, as a function on batches of documents."""
    spark = docs.sparkSession
    of = {b: [] for b in blocks}
    for r in units.where(F.col("block").between(blocks[0], blocks[-1])).collect():
        of[r["block"]].append(Unit(r["item"], bytes(r["words"]).split(), r["start"], r["stop"], r["length"], bytes(r["answer"]).split()))
    known = vocabulary([u for us in of.values() for u in us])
    weight = document_weights(docs, known, text_col)
    states = []
    for b, us in of.items():
        own = units.where((F.col("block") == b) & (F.col("length") >= MIN_ITEM))
        states.append((us, known, weight, *latent_basis(own, known, weight)))
    sent = spark.sparkContext.broadcast(states)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        tasks = None
        for part in _chunks(batches):
            tasks = tasks or [_Search(*x) for x in sent.value]
            rows = []
            for doc, text, key in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist()):
                words = words_of(text.as_py())
                best: dict[int, tuple] = {}
                for task in tasks:
                    for item, at, cosine, share, kind in task.verified(words):
                        if item not in best or (share, cosine, -at) > best[item][0]:
                            best[item] = (share, cosine, -at), kind
                rows += [(doc, key, item, -b[2], b[1], b[0], kind) for item, (b, kind) in best.items()]
            if rows:
                kinds = [part.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", few_words: bool = False, **names: str) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; rows and columns of the others are as they were. That a
    text has the words of an item of fewer than ``MIN_ITEM`` words proves no leak; such rows go only with
    ``few_words``."""
    found = search(docs, benchmark, id_col, text_col, **names)
    hit = written((found if few_words else found.where("kind != 'words'")).select(F.col("doc_id").alias("__d"), F.col("key").alias("__k")).distinct(), "leaks")
    same = F.col(id_col).eqNullSafe(F.col("__d")) & (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col("__k"))
    return docs.join(checked_broadcast(hit), same, "left_anti")
