"""Passages of 51 words found in an earlier document, against brute force."""

import random
import re

from pyspark.sql import functions as F

from gasframe.llm import substrings

from .conftest import LONG, SCHEMA, table

WORD = r"[^ \t\n\x0b\f\r]+"


def windows(words, n):
    return {tuple(words[i : i + n]): i for i in reversed(range(len(words) - n + 1))}


def held_passages(spark, df):
    """What is lost, by row, after these are checked: each passage of an earlier document loses 32 words in a row at
    least, no word is lost outside 32 that an earlier document has, and clean is the text without the words lost."""
    keyed = df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.coalesce("text", F.lit("")).alias("text")).distinct().collect()
    order = sorted(keyed, key=lambda r: (r.doc_id is not None, r.doc_id, r.key) if r.doc_id is not None else (False, 0, r.key))
    low = [re.findall(WORD, r.text.lower()) for r in order]
    out = substrings.remove_passages(df).select("row.doc_id", F.coalesce("row.text", F.lit("")).alias("text"), "lost", "clean").collect()
    got = {(r.doc_id, r.text): r for r in out}
    assert len(out) == df.count()
    passages, grams = set(), set()
    for r, words in zip(order, low):
        lost, clean = set(got[r.doc_id, r.text].lost), got[r.doc_id, r.text].clean
        for i in range(len(words) - 50):
            if tuple(words[i : i + 51]) in passages:
                assert any(lost >= set(range(j, j + 32)) for j in range(i, i + 20))
        held = {k for i in range(len(words) - 31) if tuple(words[i : i + 32]) in grams for k in range(i, i + 32)}
        assert lost <= held
        parts = re.findall(rf"(?:\A\s+)?{WORD}[ \t\n\x0b\f\r]*", r.text)
        assert clean == ("".join(p for i, p in enumerate(parts) if i not in lost) if lost else r.text)
        passages |= set(windows(words, 51))
        grams |= set(windows(words, 32))
    return [got[r.doc_id, r.text] for r in order]


def test_passages_inside_sentences(spark):
    rng = random.Random(4)
    fresh = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    passage, short = fresh(51), fresh(31)
    stock = "Yes. No. Well. Of course. Not now. "
    texts = [
        f"{fresh(40)} {passage} {fresh(30)}",
        f"{fresh(25)}\n{passage.upper()}\t {fresh(60)}",  # in one sentence, other case and white space
        passage,  # the whole of a text
        f"{stock}{fresh(80)}",
        f"{stock}{fresh(80)}",  # short sentences recur
        f"{fresh(50)} {short} {fresh(50)}",
        f"{fresh(50)} {short} {fresh(50)}",
        f"  {passage} {passage}",
        "the " * 300 + "end",
        "a few words before " + "the " * 200,
        f"{fresh(10)} {passage.rsplit(' ', 1)[0]} {fresh(10)}",  # 50 words of it
        fresh(51) + " " + " ".join(["again and again"] * 40),  # repeats itself only
    ]
    got = held_passages(spark, table(spark, texts))
    assert [bool(r.lost) for r in got[:10]] == [False, True, True, False, False, False, False, True, False, True] and not got[11].lost
    assert got[3].clean == texts[3] and got[4].clean == texts[4]


def test_passages_at_random_places(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    pool, texts = [fresh(n) for n in (51, 52, 60, 120, 51)], []
    for _ in range(60):
        words = fresh(rng.randrange(80))
        for _ in range(rng.randrange(3)):
            words += rng.choice(pool) + fresh(rng.randrange(5))
        texts.append(" ".join(words))
    got = held_passages(spark, table(spark, texts))
    assert sum(bool(r.lost) for r in got) > 20


def test_passages_of_hard_rows(spark, hard, empty):
    got = held_passages(spark, hard)
    assert next(r for r in got if r.doc_id == 5).clean == "" and substrings.remove_passages(empty).count() == 0
    rows = [(d, f"{t} {LONG[:900]}", "en", "s", 1, "k", 1, 0.5, "w", 1, 1) for d, t in [(7, "An early line."), (7, "Another early line."), (None, "No id."), (None, "No id.")]]
    out = held_passages(spark, spark.createDataFrame(rows, SCHEMA))
    assert [bool(r.lost) for r in out] == [False, True, True], "equal rows are one document, and of different ones under one id the later loses"
