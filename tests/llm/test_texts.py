"""Operators that change, find or make texts, and the pipeline."""

import collections
import random
import re
import time

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from gasframe.llm import chat, decontaminate, html_text, substrings
from gasframe.llm.html_text import render
from gasframe.llm.queries import ORACLES, QUERIES

from .conftest import LONG, PASSAGE, SCHEMA, table


def brute_removed(rows):
    """Numbers of the sentences in a span of three (or of both of two) that is not the first by id, text hash and place."""
    parts = [re.findall(r"(?:[^.!?\n]|[.!?]+(?![\s.!?]))*(?:[.!?]+\s+|\n\s*|\Z)", t) for _, _, t in rows]
    spans = []
    for row, (d, key, _) in enumerate(rows):
        own = [(i, p.strip().lower()) for i, p in enumerate(parts[row]) if p.strip()]
        wide = min(3, len(own))
        if wide > 1:
            spans += [(tuple(x for _, x in own[k : k + wide]), (d is not None, d, key, own[k][0]), row, own[k][0], own[k + wide - 1][0]) for k in range(len(own) - wide + 1)]
    first = {}
    for words, place, *_ in sorted(spans, key=lambda s: s[1]):
        first.setdefault(words, place)
    out = [set() for _ in rows]
    for words, place, row, low, high in spans:
        if place != first[words]:
            out[row] |= set(range(low, high + 1))
    return [sorted(x) for x in out]


def held_spans(spark, df):
    keyed = df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = [tuple(r) for r in keyed.collect()]
    want = collections.Counter((d, t, tuple(x)) for (d, _, t), x in zip(rows, brute_removed(rows)))
    out = substrings.remove_repeats(df).select("row.doc_id", F.coalesce("row.text", F.lit("")).alias("text"), "lost", "clean").collect()
    assert collections.Counter((r.doc_id, r.text, tuple(r.lost)) for r in out) == want
    return out


def test_repeated_spans(spark, hard, empty):
    rng = random.Random(9)
    words = "amber birch coral delta ember fjord grove heath inlet jetty".split()
    fresh = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(4, 9))).capitalize() + "."
    texts = [" ".join(fresh() for _ in range(8)) for _ in range(12)]
    texts[3] = f"{texts[3]} {PASSAGE} {fresh()}"
    texts[7] = f"{fresh()}\n{PASSAGE}\n{texts[7]}"
    texts[9] = f"{texts[3]} {texts[3]}"
    texts[10] = texts[2]
    texts[11] = texts[5] = "TH!! AND!! A!! OF!! IT!! HE!! ON!! IN!! TO!! BY!! OR!! AT!! " + texts[11]
    texts += ["Two short ones. Go.", "Two short ones. Go.", "A. B. C.", "x. A. B. C. y", "Wait... what?! no.\n\n\n A.\tB. C.", "one sentence", "one sentence"]
    got = {r.doc_id: r for r in held_spans(spark, table(spark, texts))}
    assert PASSAGE in got[3].clean and "lighthouse" not in got[7].clean and got[10].clean == "" and got[0].clean == texts[0]
    assert got[13].clean == "" and got[15].clean == "x. y" and got[18].clean == "one sentence"
    out = held_spans(spark, hard)
    assert len(out) == hard.count() and substrings.remove_repeats(empty).count() == 0
    assert next(r for r in out if r.doc_id == 5).clean == ""


def test_repeated_spans_of_equal_ids(spark):
    texts = ["An early line. " + PASSAGE, "Another early line. " + PASSAGE, PASSAGE, "Nothing to see here."]
    rows = [(d, t, "en", "s", 1, "k", 1, 0.5, "w", 1, 1) for d, t in [(7, texts[0]), (7, texts[1]), (None, texts[2]), (None, texts[2]), (8, texts[3])]]
    out = held_spans(spark, spark.createDataFrame(rows, SCHEMA))
    held = [r.doc_id for r in out if "lighthouse" in r.clean]
    assert held == [None, None], "equal rows are one document, and of different ones under one id the later loses"


BENCH = ["Which tide gate opened first when the northern canal froze over in the long winter of the great comet? The warden replied the copper gate beside the mill.", "short one", None, "", "How many marble steps lead from the observatory terrace down to the drowned garden where cedar boats are moored? Seventy three steps carved by monks."]


def test_leaks(spark, hard, empty):
    bench = spark.createDataFrame(list(enumerate(BENCH)), "item_id long, text string")
    filler = "people walk and talk about many common things every day in this town while rain falls "
    para = BENCH[4].replace("marble ", "").replace("lead", "go").replace("drowned", "sunken")
    texts = [filler * 3 + BENCH[0] + filler * 3, filler * 5, BENCH[4].upper(), filler + para + filler, None, "", filler + "Which tide gate opened first when the river rose", "Seventy three steps carved by monks."]
    docs = table(spark, texts + [f"{filler} {i} " * 4 for i in range(40)])
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.search(docs, bench).collect()}
    assert got == {(0, 0): "copy", (2, 4): "copy", (3, 4): got.get((3, 4))} and got[(3, 4)] in ("copy", "paraphrase")
    out = decontaminate.without_leaks(docs, bench)
    assert out.columns == docs.columns and out.count() == docs.count() - 3
    assert decontaminate.without_leaks(hard, bench).count() == hard.count()
    assert decontaminate.search(empty, bench).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.search(docs, none).count() == 0 and decontaminate.without_leaks(docs, none).count() == docs.count()


def test_recall_on_planted_passages(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: r.text for r in bench.collect()}
    true = {(r.doc_id, i) for r in docs.collect() for i, b in items.items() if b in r.text}
    got = {(r.doc_id, r.item_id) for r in decontaminate.search(docs, bench).collect()}
    assert true and len(true & got) / len(true) >= 0.9


@pytest.mark.parametrize("held", [0.5, 1.0])
def test_items_in_very_many_documents(spark, held):
    bench = spark.createDataFrame(list(enumerate(BENCH)), "item_id long, text string")
    rng = random.Random(3)
    words = [f"word{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=60)) + (f" {BENCH[0]} " if i < 200 * held else " ") + " ".join(rng.choices(words, k=60)) for i in range(200)]
    got = {(r.doc_id, r.item_id, r.kind) for r in decontaminate.search(table(spark, texts), bench).collect()}
    assert got == {(i, 0, "copy") for i in range(int(200 * held))}


def test_quoted_passage_of_a_long_item(spark):
    rng = random.Random(8)
    item = [f"item{rng.randint(0, 10**6)}" for _ in range(200)]
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    fill = lambda: [f"word{rng.randint(0, 300)}" for _ in range(50)]
    texts = [" ".join(fill() + item[at : at + n] + fill()) for at, n in ((0, 64), (48, 64), (24, 64), (70, 64), (136, 64), (90, 20), (0, 0))]
    assert {(r.doc_id, r.kind) for r in decontaminate.search(table(spark, texts), bench).collect()} == {(i, "copy") for i in range(5)}


def test_short_repeated_and_nameless_items(spark, hard, empty):
    bench = spark.createDataFrame([(1, "Short one!"), (None, BENCH[0]), (2, BENCH[0]), (2, BENCH[0]), (3, "?!"), (4, None), (5, ""), (6, "One")], "item_id long, text string")
    texts = ["it was a short one indeed", "short and one", f"before it {BENCH[0]} after", "shortone", None, ""]
    docs = table(spark, texts)
    got = collections.Counter((r.doc_id, r.item_id, r.kind, r.at) for r in decontaminate.search(docs.union(docs.where("doc_id = 2")), bench).collect())
    at = next(r.at for r in decontaminate.search(docs, bench).collect() if r.doc_id == 2 and r.item_id == 2)
    want = {(0, 1, "words", 3): 1, (0, 6, "words", 4): 1, (1, 6, "words", 2): 1, (2, None, "copy", at): 1, (2, 2, "copy", at): 1}
    assert {k: n for k, n in got.items() if k[0] != 2 or k[1] != 6} == want
    assert {r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()} == {0, 1, 3, 4, 5}
    assert {r.doc_id for r in decontaminate.without_leaks(docs, bench, few_words=True).collect()} == {3, 4, 5}
    assert decontaminate.search(hard, bench.where("item_id = 1")).count() == 0 and decontaminate.search(empty, bench).count() == 0


def test_blocks_are_bounded(spark):
    rng = random.Random(6)
    long = [f"term{rng.randint(0, 10**7)}" for _ in range(100_000)]
    rows = [(i, BENCH[0]) for i in range(10_000)] + [(10_000, " ".join(long)), (10_001, "z" * 3_000_000 + " and five more words here")]
    bench = spark.createDataFrame(rows, "item_id long, text string").repartition(3)
    units, blocks = decontaminate._numbered(bench, "text", None)
    sizes = {r.block: (r.n, r.bytes) for r in units.groupBy("block").agg(F.count("*").alias("n"), F.sum(F.octet_length("words")).alias("bytes")).collect()}
    assert units.count() == 1 + -(-(100_000 - 16) // 48) + 1 and set(sizes) <= set(range(blocks))
    assert all(n <= decontaminate.BLOCK for n, _ in sizes.values()) and sum(b > 2**21 for _, b in sizes.values()) == 1
    docs = table(spark, [" ".join(long[15_000:15_070]), f"so {BENCH[0]} it", "nothing of that"])
    part = spark.createDataFrame([*rows[:10_000], (10_000, " ".join(long[:30_000]))], "item_id long, text string")
    got = decontaminate.search(docs, part)
    per = {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert per == {0: 1, 1: 10_000}


@pytest.mark.parametrize("changed", [0.0, 0.15])
def test_recall_on_planted_paraphrases(spark, changed):
    rng = random.Random(15)
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    fill = [r.text for r in docs.where("length(text) > 500").limit(60).collect()]
    common = "the of and to in a is that for it".split()
    want, rows = set(), []
    for r in bench.limit(50).collect():
        words = [rng.choice(common) if rng.random() < changed else w for w in r.text.split()]
        before, after = rng.choice(fill)[:400], rng.choice(fill)[:400]
        rows.append(f"{before} {' '.join(words)} {after}")
        item = decontaminate.words_of(r.text)
        if decontaminate.common_length(item, decontaminate.words_of(" ".join(words))) >= decontaminate.COPY * len(item):
            want.add((len(rows) - 1, r.item_id))
    got = {(r.doc_id, r.item_id) for r in decontaminate.search(table(spark, rows), bench).collect()}
    assert len(want) > 20 and len(want & got) >= 0.98 * len(want)


def test_common_length():
    a, b = b"a b c d e f".split(), b"x a c c f d".split()
    assert decontaminate.common_length(a, b) == 3 and decontaminate.common_length([], b) == 0 and decontaminate.common_length(a, a) == 6


@pytest.mark.parametrize("page,want", [
    ("", ""), ("plain & simple &lt;b&gt;", "plain & simple <b>"), ("a < b and 3 > 2", "a < b and 3 > 2"), ("<p>one<p>two", "one\n\ntwo"), ("a<br>b<br/>c", "a\nb\nc"),
    ("<div>a</div><div>b <b>c</b>d</div>", "a\nb cd"), ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"), ("<ol start=3><li>x</li><li>y</ol>", "3. x\n4. y"),
    ("<table><tr><td>aa<td>b<tr><td>c<td>d</table>", "aa  b\nc   d"), ("<table><tr><td colspan=2>wide cell<tr><td>1<td>2</table>", "wide cell\n1  2"), ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
    ("x<script>var a='</p>';</script>y<style>p{}</style>", "xy"), ("<div hidden>no</div><p style='display: none'>no</p><span style=visibility:hidden>no</span>yes", "yes"),
    ("<head><title>t</title></head><body>b", "b"), ("<title>t</title>b", "b"), ("<pre>a\n  b\tc</pre>", "a\n  b    c"), ("a<!-- x > y -->b<!-- open", "ab"), ("<p title='a>b'>c</p>", "c"), ("</div>a</p>b", "a\n\nb"),
    ("<select><option>one<option>two</select>", "one\ntwo"), ("<dl><dt>t<dd>d</dl>", "t\n  d"), ("<h1>A</h1>b<hr>c", "A\n\nb\n\nc"), ("<a href=x", "<a href=x"), ("<textarea><b>x</textarea>", "<b>x"), ("<input type=submit value=Go> <input type=hidden value=no>", "Go"),
])
def test_rendering(page, want):
    assert render(page) == want


def test_rendering_is_deep_and_wide(spark):
    assert render("<div>" * 20000 + "deep") == "deep"
    assert render("<ul><li>" * 200 + "x").endswith("x")
    assert len(render("<table>" + "<tr><td>" + "y" * 9000 + "<td>z" + "<tr><td>a<td>b" * 500 + "</table>")) < 80_000
    df = spark.createDataFrame([(1, None, "a", 0), (1, "<p>a", "b", 1), (None, "b", "c", 2), (2, "", "d", 3)], "page_id long, html string, text string, page long")
    assert collections.Counter(map(tuple, html_text.extract(df).collect())) == collections.Counter([(1, ""), (1, "a"), (None, "b"), (2, "")])
    assert html_text.extract(df.where("page_id = 9")).count() == 0


MB = 1_000_000
HOSTILE = {
    "open tags": "<a " * (MB // 3), "open quotes": '<a "' * (MB // 4), "odd quotes": "<a \"' >x'" * (MB // 9), "open cdata": "<![CDATA[" * (MB // 9), "open comments": "<!-" * (MB // 3),
    "end tags": "<div>" * (MB // 9) + "</p>" * (MB // 9), "far end tags": "<b><table>" + "<div>" * (MB // 10) + "</b>" * (MB // 8), "cells": "<table><tr>" + "<td>x" * (MB // 5),
    "nested cells": "<table><tr><td>" + ("<div>" * 1000 + "<td>") * (MB // 5004), "lists": "<ul><li>x" * (MB // 9), "quotations": "<blockquote>x" * (MB // 13), "tables": "<table><tr><td>x" * (MB // 16),
    "spans": "<table>" + "<tr><td colspan=1000 rowspan=60000>x" * (MB // 40), "rowspans": "<table><tr>" + "<td rowspan=9999>x" * (MB // 36) + "<tr><td>y" * (MB // 18), "definitions": "<dl><dt>x<dd>y" * (MB // 14),
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_time_of_hostile_pages(name):
    """A page of five times the length takes about five times as long; the square would be 25 times."""
    page, took = HOSTILE[name], []
    for part in (page[: len(page) // 20], page[: len(page) // 4]):
        began = time.process_time()
        render(part)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


def naive_tree(page):
    """The tree builder as its rules read: each tag searches the stack of open elements."""
    root = ["html", []]
    stack = [root]

    def close(tags, boundary):
        first = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in boundary:
                break
            if stack[i][0] in tags:
                first = i
                if stack[i][0] not in ("td", "th", "tr", "option"):
                    break
        if first is not None:
            del stack[first:]

    for slash, tag, words in re.findall(r"<(/?)(\w+)>|([^<]+)", page):
        if words:
            stack[-1][1].append(words)
        elif slash:
            if tag == "p" and all(x[0] != "p" for x in stack):
                stack[-1][1].append(["p", []])
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][0] == "table" and tag not in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption", "table"):
                    break
        else:
            if tag in html_text.P_CLOSERS:
                close({"p"}, {"button", "td", "th", "table", "caption"})
            if tag in html_text.CLOSES:
                close(html_text.CLOSES[tag], html_text.BOUNDARY.get(tag, {"table"}))
            node = [tag, []]
            stack[-1][1].append(node)
            if tag not in html_text.VOID:
                stack.append(node)
    return root


def plain(node):
    return node if isinstance(node, str) else [node.tag, [plain(c) for c in node.children]]


TAGS = "p div b ul ol li dl dt dd table tr td th tbody thead caption select option optgroup button br hr h1 blockquote span".split()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([f"<{t}>" for t in TAGS] + [f"</{t}>" for t in TAGS]), st.sampled_from(["one", "two ", " three"])), max_size=40))
def test_trees_are_those_of_the_rules(parts):
    page = "".join(parts)
    assert plain(html_text.parse(page)) == naive_tree(page)
    assert collections.Counter(re.findall("one|two|three", render(page))) == collections.Counter(re.findall("one|two|three", page))


def turns(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "pair_id long, turn long, role string, text string, side string")


def test_preferences(spark):
    c = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "and"), (1, 3, "assistant", "good"), (2, 0, "user", "only"), (3, 0, None, None), (3, None, "system", "s"), (None, 0, "user", "lost")]
    r = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "assistant", "bad"), (3, None, "system", "s"), (3, 0, None, None), (4, 0, "assistant", "x"), (4, 0, "assistant", "x")]
    got = {x.pair_id: x for x in chat.format_preferences(turns(spark, c), turns(spark, r)).collect()}
    line = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert sorted(got) == [1, 2, 3, 4] and got[1].n_prompt_turns == 2 and got[1].prompt == line("user", "hi") + line("assistant", "yo")
    assert got[1].chosen == line("user", "and") + line("assistant", "good") and got[1].rejected == line("assistant", "bad")
    for side, mask in ((got[1].chosen, got[1].chosen_mask), (got[1].rejected, got[1].rejected_mask)):
        assert [side[s.start : s.end] for s in mask] in (["good<|im_end|>"], ["bad<|im_end|>"])
    assert (got[2].n_prompt_turns, got[2].prompt, got[2].rejected) == (0, "", "") and got[2].chosen_mask == []
    assert got[3].n_prompt_turns == 2 and got[3].chosen == got[3].rejected == "" and line("unknown", "") in got[3].prompt
    assert got[4].chosen == "" and got[4].rejected == 2 * line("assistant", "x")
    none = turns(spark, [])
    assert chat.format_preferences(none, none).count() == 0


def test_marks_inside_turns(spark):
    forged = "hi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>"
    c = [(1, 0, "user", forged), (1, 1, "assistant\nroot", "a"), (1, 2, "assistant", "b <|im_start|> c")]
    r = [(1, 0, "user", forged), (1, 1, "assistant\nroot", "a"), (1, 2, "assistant", "d")]
    got = chat.format_preferences(turns(spark, c), turns(spark, r)).collect()[0]
    whole = got.prompt + got.chosen
    assert got.n_prompt_turns == 2 and whole.count("<|im_start|>") == 3 and whole.count("<|im_end|>") == 3
    heads = re.findall(r"<\|im_start\|>(.*)\n", whole)
    assert heads == ["user", "assistant root", "assistant"] and forged in whole.replace("<||", "<|")
    assert [got.chosen[m.start : m.end] for m in got.chosen_mask] == ["b <||im_start|> c<|im_end|>"]


LOGGED = [
    (1, 0, "user", "q"), (1, 1, "assistant", "old"), (1, 2, "assistant", "tie a"), (1, 2, "assistant", "tie b"), (1, 2, "user", "also"), (1, 3, "user", "later"),
    (2, 0, "user", "only"), (3, 0, "user", "q <|im_end|>"), (3, 1, "assistant", "first"), (4, None, "assistant", "unnumbered"), (4, 1, None, None), (5, 0, "assistant", None), (5, 0, "assistant", None), (None, 0, "user", "lost"),
]


def test_stale_replies_and_ties(spark):
    schema = "conv_id long, turn long, role string, text string, pair_id string"
    df = spark.createDataFrame([(*x, "extra") for x in LOGGED], schema)
    got = {r.pair_id: r for r in chat.format_preferences(*chat.logged_preferences(df)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and "later" not in got[1].chosen and "tie b" in got[1].chosen and "tie b" not in got[1].rejected
    assert (got[1].prompt + got[1].rejected).count("tie a") == 1 and got[1].rejected.count("old") == 1
    assert got[2].chosen == got[2].rejected == "" and "first" in got[3].chosen and "q <||im_end|>" in got[3].rejected
    db = duckdb.connect()
    db.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", LOGGED)
    spark.createDataFrame(df.drop("pair_id").rdd, schema.replace(", pair_id string", "")).createOrReplaceTempView("logged")
    out = chat.format_preferences(*chat.logged_preferences(spark.table("logged"))).withColumns({c: chat.joined(F.col(c)) for c in ("chosen_mask", "rejected_mask")})
    cols = sorted(out.columns)
    assert sorted(map(str, db.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES['op2_chat']})").fetchall())) == sorted(str(tuple(r)) for r in out.select(*cols).collect())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("conversations", "documents"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    got, want = QUERIES[name](spark, "/root/testdata/sf0.01"), db.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = [tuple(r) for r in got.select(*cols).collect()], want.select(*cols).fetchall()
    assert a and sorted(a, key=str) == sorted(b, key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count()


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sf, cols, now = "/root/testdata/sf0.001", docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == cols and 0 < out.count() <= now.count(), name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in now.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, sf).agg(F.sum("length")).first()[0] == pieces.agg(F.sum("length")).first()[0]


def test_pipeline_on_hard_tables(spark, hard, empty):
    for df in (hard, empty):
        now = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, "/root/testdata/sf0.001")
            assert now.columns == df.columns
        left = now.collect()
        pieces = corpus_pipeline.STAGES[-1][1](spark, now, "/root/testdata/sf0.001").collect()
        assert {r.doc_id for r in pieces} == {r.doc_id for r in left} and all(r.length > 0 for r in pieces)
        assert bool(left) == bool(df is not empty and any(r.text == LONG for r in left))


def test_stages_say_what_hard_rows_become(spark, hard, empty):
    """Each stage alone, on null and empty texts, a very long one, repeated rows and null ids."""
    sf, texts = "/root/testdata/sf0.001", lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    whole = texts(hard)
    rng, words = random.Random(4), "the of and harbour lamp to in quiet a night is sail rope tide that".split()
    good = " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(250))
    mixed = table(spark, [good, good.upper(), "", None, "#%$ " * 80], lang=None)
    assert {r.doc_id for r in stages["quality_rules"](spark, mixed, sf).collect()} == {0}
    assert set(texts(stages["near_duplicates"](spark, hard, sf))) <= set(whole)
    assert texts(stages["benchmark_decontamination"](spark, hard, sf)) == whole
    clean = texts(stages["personal_data"](spark, hard, sf))
    mail = next(t for d, t in whole if d == 7).replace("a@b.cd", "[EMAIL]")
    assert clean[(7, mail)] == 1 and clean[(1, None)] == 1 and sum(clean.values()) == sum(whole.values())
    for stage in stages.values():
        assert stage(spark, empty, sf).count() == 0
