"""Spelling variants: the words of a corpus that differ by one letter, found with forward and backward automata."""

from __future__ import annotations

import re
from collections import Counter
from itertools import groupby
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gasframe.llm.common import checked_broadcast, forget, written

MIN_LENGTH, MIN_COUNT = 5, 3
#: A form is this many times as frequent as its variant, at least.
FORM_RATIO = 2
_RUN = re.compile(f"[a-zÀ-ÿ]{{{MIN_LENGTH},}}")
_DELETES = 97
#: Distinct words that a task counts before it hands them on.
_HELD = 400_000
#: Words of one half that are matched together, and words of which one automaton is built, about.
SHARD, BLOCK = 100_000, 50_000


def words_of(doc_id: object, data: bytes) -> Counter:
    """Counts of one UTF-8 text's words of ``MIN_LENGTH`` letters or more: its runs with A-Z lower-cased, less a letter
    in the runs that the checksum of document and run picks."""
    out: Counter = Counter()
    seed = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(_RUN.findall(data.lower().decode())).items():
        h = crc32(run.encode(), seed)
        if not h % _DELETES:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < MIN_LENGTH:
                continue
        out[run] += n
    return out


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that occur ``min_count`` times or more."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                held.update(words_of(i.as_py(), text.as_py() or b""))
                if len(held) >= _HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)
                    held = Counter()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)

    partial = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Automaton:
    """The minimal acyclic automaton of sorted, distinct words. ``edges`` holds for each state its labels with the state
    they lead to and the words that are passed over by taking them, so that the sum along a word is its number: its place
    in the sorted list."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._size: list[int] = []
        known: dict[tuple, int] = {}
        open_: list[list] = [[False, []]]
        before = ""
        for word in [*words, ""]:
            same = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                same += 1
            while len(open_) > same + 1:
                done = self._closed(known, *open_.pop())
                open_[-1][1].append((before[len(open_) - 1], done))
            for _ in range(len(word) - same):
                open_.append([False, []])
            if word:
                open_[-1][0] = True
            before = word
        self.start = self._closed(known, *open_[0])

    def _closed(self, known: dict, final: bool, edges: list) -> int:
        key = (final, *edges)
        if key not in known:
            passed, out = int(final), {}
            for label, to in edges:
                out[label] = (to, passed)
                passed += self._size[to]
            known[key] = len(self.edges)
            self.edges.append(out)
            self.final.append(final)
            self._size.append(passed)
        return known[key]

    def _rest(self, state: int, number: int, word: str, at: int) -> int:
        """The number of the word that goes on with ``word[at:]``, or -1."""
        edges = self.edges
        for c in word[at:]:
            found = edges[state].get(c)
            if found is None:
                return -1
            state, passed = found
            number += passed
        return number if self.final[state] else -1

    def number(self, word: str) -> int:
        """The place of ``word`` in the sorted list, or -1."""
        return self._rest(self.start, 0, word, 0)

    def completions(self, word: str, half: int) -> set[int]:
        """The numbers of the words that begin with the first ``half`` letters of ``word`` and go on like it with exactly
        one letter inserted, deleted or replaced. A letter is deleted or inserted at the first place only of a run of equal
        ones, where it makes no other word."""
        state, number, found = self.start, 0, set()
        for c in word[:half]:
            step = self.edges[state].get(c)
            if step is None:
                return found
            state, number = step[0], number + step[1]
        for at in range(half, len(word) + 1):
            here = word[at : at + 1]
            last = word[at - 1] if at > half else ""
            for label, (to, passed) in self.edges[state].items():
                if here and label != here:
                    found.add(self._rest(to, number + passed, word, at + 1))
                if label != last:
                    found.add(self._rest(to, number + passed, word, at))
            if not here:
                break
            if here != last:
                found.add(self._rest(state, number, word, at + 1))
            step = self.edges[state].get(here)
            if step is None:
                break
            state, number = step[0], number + step[1]
        found.discard(-1)
        return found


def _completed(back: bool, rows: list[tuple]) -> list[tuple]:
    """(word, n, near words, their counts) of the queries among ``rows`` (word, n, whether listed, whether a query); with
    ``back``, words are read from their ends."""
    turned = (lambda w: w[::-1]) if back else (lambda w: w)
    listed = sorted({(turned(w), n) for w, n, held, _ in rows if held})
    automaton, out = Automaton([w for w, _ in listed]), []
    for word, n in {(w, n) for w, n, _, asked in rows if asked}:
        half = (len(word) + back) // 2
        near = [listed[i] for i in automaton.completions(turned(word), half)]
        out.append((word, n, [turned(w) for w, _ in near], [c for _, c in near]))
    return out


def _routed(words: DataFrame, shard: int) -> DataFrame:
    """(key, shard, back, word, n, held, asked): each word where its own half leads, and where the halves lead of words
    that are one letter shorter or longer. The few halves of more than ``shard`` words deal these out in shards, and
    their queries to each of them."""
    length = F.length("word")
    sides = []
    for back in (False, True):
        low = F.floor((length - 1 + int(back)) / 2)
        half = F.floor((length + int(back)) / 2)
        sides += [F.struct(F.lit(back).alias("back"), h.cast("int").alias("half"), (h == half).alias("asked")) for h in (low, low + 1)]
    rows = words.select("word", "n", F.explode(F.array(*sides)).alias("s")).select("word", "n", "s.*")
    text = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
    rows = rows.select("word", "n", "back", "asked", F.xxhash64("back", F.substring(text, F.lit(1), F.col("half"))).alias("key"))
    rows = written(rows, "halves")
    hot = written(rows.groupBy("key").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards")).where("shards > 1"), "hot")
    mark = lambda x, shard, held, asked: x.select("key", shard.alias("shard"), "back", "word", "n", held.alias("held"), asked.alias("asked"))
    yes, no = F.lit(True), F.lit(False)
    cold = mark(rows.join(F.broadcast(hot), "key", "left_anti"), F.lit(0), yes, F.col("asked"))
    many = rows.join(F.broadcast(hot), "key")
    lists = mark(many, F.pmod(F.xxhash64("word"), F.col("shards")).cast("int"), yes, no)
    queries = many.where("asked").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    return cold.union(lists).union(mark(queries, F.col("shard"), no, yes))


def near_words(words: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(word, n, near) for each row of ``words`` (word, n): near is an array of (n, word) of the words that differ from
    it by exactly one inserted, deleted or replaced letter.

    One of the word's halves then stands in the other word as it is, at its front or at its end. Words meet by such
    halves; in a task, those of a direction are read into a forward or a backward automaton, ``block`` at a time or a
    half's at least, in which a query follows its half exactly and completes the rest with one error. A pair that both
    directions find counts once. A word has no more near words than its letters have variants.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def run(batches):
        def all_rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(7)))

        def flushed(held):
            for back in (False, True):
                rows = [r[3:] for r in held if r[2] == back]
                if any(r[3] for r in rows):
                    out = _completed(back, rows)
                    for at in range(0, len(out), 10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[at : at + 10_000]), schema)], schema=schema)

        held: list[tuple] = []
        for _, rows in groupby(all_rows(), key=lambda r: r[:2]):
            held += rows
            if len(held) >= block:
                yield from flushed(held)
                held = []
        yield from flushed(held)

    rows = _routed(words, shard).repartition("key", "shard").sortWithinPartitions("key", "shard")
    found = rows.mapInArrow(run, "word string, n long, near array<string>, counts array<bigint>")
    pairs = F.zip_with("counts", "near", lambda n, w: F.struct(n.alias("n"), w.alias("word")))
    both = F.array_distinct(F.flatten(F.collect_list(pairs)))
    return found.groupBy("word").agg(F.first("n").alias("n"), both.alias("near"))


def _roots(forms: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(word, root) by doubling: a step replaces each word's root by its root's. Forms grow by their ratio each, so that
    chains are short."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max_rounds):
        targets = checked_broadcast(written(now.select(F.col("root").alias("word")).distinct(), "targets"))
        further = written(now.join(targets, "word", "left_semi").select(F.col("word").alias("root"), F.col("root").alias("next")), "further")
        if further.isEmpty():
            return now
        nxt = written(now.join(checked_broadcast(further), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        forget(now)
        now = nxt
    raise RuntimeError(f"roots did not settle in {max_rounds} rounds")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row per word of ``docs``.

    Words are runs of Latin letters of which five are left at least (``words_of``) and that occur three times or more
    overall; two are near if they differ by one inserted, deleted or replaced code point. A word's form is its most
    frequent near word, of equal ones the first by code points, if it is twice as frequent at least; its root is the last
    of the forms that follow from it, or itself.

    Null and empty texts have no words; a null id is written as nothing before the colon of the checksum; repeated rows
    count again; very long texts and words are read whole; other columns are not read; an empty table gives no rows.
    """
    near = near_words(written(count_words(docs, id_col, text_col), "words"))
    best = F.array_sort(F.transform("near", lambda x: F.struct((-x["n"]).alias("n"), x["word"].alias("word"))))
    good = F.when(-F.get(best, F.lit(0))["n"] >= FORM_RATIO * F.col("n"), F.get(best, F.lit(0)))
    found = written(near.select("word", "n", F.size("near").cast("long").alias("n_near"), good.alias("best")).select("word", "n", "n_near", F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n")), "near")
    roots = _roots(found.where(F.col("form").isNotNull()))
    return found.join(checked_broadcast(roots), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
