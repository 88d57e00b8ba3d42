"""Substring deduplication by sliding spans of sentences, and of passages by words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gasframe.llm.common import SPACES, let, space_words, written

#: A sentence: up to the white space after full stops, question or exclamation marks, or after a line feed, or the end.
SENTENCE = r"((?:[^.!?\n]++|[.!?]++(?!\s))*+(?:[.!?]++\s++|\n\s*+|\z))"
#: Consecutive sentences of a span; a document of two sentences, or as many as there are less than these, is one span.
SPAN = 3
#: Words in a row that make a passage, and words in a row of which a passage is known by its equals.
PASSAGE, GRAM = 51, 32
#: A word with the white space after it, and before it where the text begins.
WORD = "((?:^[ \\t\\n\\x0B\\f\\r]++)?[^ \\t\\n\\x0B\\f\\r]++[ \\t\\n\\x0B\\f\\r]*+)"
#: Multipliers of the rolling hashes.
_BASES = 6364136223846793005, 2862933555777941757


def sentences(text: Column) -> Column:
    """The sentences of a text with the white space after them; joined, they are the text."""
    return F.filter(F.regexp_extract_all(text, F.lit(SENTENCE), 1), lambda s: s != "")


def _spans(docs: DataFrame, id_col: str, text_col: str, span: int) -> DataFrame:
    """(doc_id, key, copy, at, n, h, g) of the span that starts at each sentence; h and g are hashes of its words, key
    is one of the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), F.transform(sentences(F.lower(text)), lambda s: F.btrim(s, F.lit(SPACES))).alias("ss"))
    rows = rows.where(F.size("ss") > 1)
    hashed = lambda s, i: F.struct(F.xxhash64(s).alias("h"), F.hash(s).alias("g"), i.alias("i"), (s != "").alias("full"))
    rows = rows.select("doc_id", "key", F.filter(F.transform("ss", hashed), lambda s: s["full"]).alias("ss")).where(F.size("ss") > 1)
    wide = F.least(F.lit(span), F.size("ss"))
    at = lambda i, j, name: F.get(F.col("ss"), i + j)[name]

    def made(i: Column) -> Column:
        last = at(i, wide - 1, "i")
        parts = [F.struct(at(i, j, "h"), at(i, j, "g")) for j in range(span)]
        return F.struct(at(i, 0, "i").alias("at"), (last - at(i, 0, "i") + 1).alias("n"), F.xxhash64(*parts).alias("h"), F.hash(*parts).alias("g"))

    return rows.select("doc_id", "key", F.explode(F.transform(F.sequence(F.lit(0), F.size("ss") - wide), made)).alias("r")).select("doc_id", "key", "r.*")


def repeated_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """(doc_id, key, lost): the numbers of the sentences that lie in a span that is not the first of its kind, for
    each document with any; key is a hash of the text.

    The first of equal spans is the one of the smallest (id, text hash, place), a null id before any other; so of two
    texts under one id, or without one, the later loses what both have. Rows that share id and text are one document.
    Spans are hashed once and matched over the whole corpus by 96 bits: a count and a smallest place per span, with
    map-side partial sums, then an equality join of the spans with those that occur twice or more, of which only the
    places that are lost go on.
    """
    spans = written(_spans(docs, id_col, text_col, span), "spans")
    place = F.struct("doc_id", "key", "at")
    again = spans.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("h", "g", "first")
    found = spans.join(written(again, "again"), ["h", "g"]).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key")) & (F.col("at") == F.col("first.at"))))
    runs = F.flatten(F.collect_set(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)))
    return found.groupBy("doc_id", "key").agg(F.sort_array(F.array_distinct(runs)).alias("lost"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """``docs`` (as the struct ``row``) with lost (numbers of the sentences removed) and clean, the text without them.

    A null text counts as empty and loses nothing, nor does a text of one sentence; a document of which nothing is left
    has an empty text; equal rows get equal results; no rows give no rows; columns that are not named are carried in
    ``row``, whatever their names. Texts are never cut; the sentences of a very long one are hashed one by one. The
    texts are joined with what they lose once, by id and hash.
    """
    return _without(docs, repeated_sentences(docs, id_col, text_col, span), sentences, id_col, text_col)


def _without(docs: DataFrame, lost: DataFrame, cut, id_col: str, text_col: str) -> DataFrame:
    """(row, lost, clean): ``docs`` with the texts joined from those of their pieces, by ``cut``, that are not lost."""
    lost = written(lost.select(F.col("doc_id").alias("__d"), F.col("key").alias("__k"), "lost"), "lost")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("text"))
    both = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("key") == F.col("__k")), "left")

    def without(parts: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("lost")), lambda i: F.get(parts, i)), "")

    clean = F.when(F.col("lost").isNull(), F.col("text")).otherwise(let(cut(F.col("text")), without))
    return both.select("row", F.coalesce("lost", F.array().cast("array<int>")).alias("lost"), clean.alias("clean"))


def _powers(base: int, n: int) -> np.ndarray:
    return np.array([pow(base, n - 1 - j, 1 << 64) for j in range(n)], dtype=np.uint64)


def _rolled(v: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``n`` of the values ``v``, made from those of half as many."""
    if n == 1:
        return v
    k, base = n // 2, _BASES[0]
    half = _rolled(v, k)
    both = half[:-k] * np.uint64(pow(base, k, 1 << 64)) + half[k:]
    return both if n % 2 == 0 else both[:-1] * np.uint64(base) + v[n - 1 :]


def _picked(words: np.ndarray, passage: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and two hashes of the runs of ``gram`` words that have the least hash of all in some passage, and of the
    first and last. Of equal runs, those at places that ``passage - gram + 1`` divides go first, so that few of a text
    of one word are picked."""
    if len(words) < passage:
        none = np.zeros(0, np.uint64)
        return none.astype(np.int32), none, none
    h = _rolled(words, gram)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_BASES[1])
    wide = passage - gram + 1
    low = np.uint64((1 << wide.bit_length()) - 1)
    at = np.arange(len(h), dtype=np.uint64)
    least, size = (h & ~low) | (at % np.uint64(wide)), 1
    while size < wide:
        step = min(size, wide - size)
        least, size = np.minimum(least[:-step], least[step:]), size + step
    start = np.arange(len(least))
    places = np.unique(np.r_[0, start + ((least & low).astype(np.int64) - start) % wide, len(h) - 1])
    second = words[places[:, None] + np.arange(gram)] @ _powers(_BASES[1], gram)
    return places.astype(np.int32), h[places], second


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """(doc_id, key, lost): the numbers of the words, in lower case, that lie in a passage that an earlier document has,
    for each document with any; key is a hash of the text.

    Of each run of ``passage`` words, the run of ``gram`` words with the least hash is picked (winnowing: Schleimer,
    Wilkerson and Aiken, 2003), about 2 in ``passage - gram + 2`` of all. Two equal passages pick equal runs, so each is found,
    wherever its sentences end; no words are lost that are not among ``gram`` in a row of an earlier document. Of a
    passage, up to ``passage - gram`` words at either end may stay; a copy of a whole text loses all. Runs that one
    document alone repeats stay. The earlier document is the one of the smaller (id, text hash), a null id before any
    other; runs are matched as the spans of ``repeated_sentences`` are, by 128 bits.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), F.transform(space_words(F.lower(text)), lambda w: F.xxhash64(w)).alias("ws"))
    rows = rows.where(F.size("ws") >= passage)

    def pick(batches):
        for b in batches:
            words = b.column("ws")
            ends, flat = words.offsets.to_numpy(), words.values.to_numpy().view(np.uint64)
            found = [_picked(flat[i:j], passage, gram) for i, j in zip(ends[:-1], ends[1:])]
            if not found:
                continue
            of = pa.array(np.repeat(np.arange(len(found)), [len(p) for p, _, _ in found]))
            at, h, g = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(of), b.column("key").take(of), pa.array(at), pa.array(h.view(np.int64)), pa.array(g.view(np.int64))], ["doc_id", "key", "at", "h", "g"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    grams = written(rows.mapInArrow(pick, f"doc_id {kind}, key long, at int, h long, g long"), "grams")
    place = F.struct("doc_id", "key")
    again = grams.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("h", "g", "first")
    found = grams.join(written(again, "again"), ["h", "g"]).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))))
    runs = F.flatten(F.collect_set(F.sequence(F.col("at"), F.col("at") + gram - 1)))
    return found.groupBy("doc_id", "key").agg(F.sort_array(F.array_distinct(runs)).alias("lost"))


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """``docs`` (as the struct ``row``) with lost (numbers of the words removed) and clean, the text without them and
    without the white space after each.

    Unlike ``remove_repeats`` it finds passages inside one sentence, texts of one sentence, and passages whose first and
    last sentences go on differently, and keeps short sentences that recur. Nulls, equal rows and columns as there.
    """
    words = lambda text: F.regexp_extract_all(text, F.lit(WORD), 1)
    return _without(docs, repeated_words(docs, id_col, text_col, passage, gram), words, id_col, text_col)
