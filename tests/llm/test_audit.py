"""The audit of filters against applying every order to every document, and its SQL."""

import collections
import itertools
import random
import re

import duckdb
import numpy as np

from gasframe.llm import filter_audit
from gasframe.llm.queries import ORACLES, QUERIES

from .conftest import table

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
LABELS = "doc_id long, quality int, toxic int"


def brute_audit(rows, labels):
    """{(part, order, step): counts} of (id, text, part) rows, by applying every order to every document."""
    rows = [(i, t or "", p or "") for i, t, p in rows]
    orders = ["".join(p) for p in itertools.permutations("ABCDE")]
    out = {(p, o, s): collections.Counter() for p in {p for *_, p in rows} for o in orders for s in range(1, 6)}
    for i, text, part in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set("A" * (len(words) < 200)) | set("B" * (100 * len(set(words)) < 50 * len(words))) | set("C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)))
        fails |= set("D" * bool(re.search(r"[#$%&*|]", text))) | set("E" * any(i is not None and j is not None and j < i and t == text for j, t, _ in rows))
        good, toxic = labels.get(i, (0, 0))
        for o in orders:
            gone = False
            for s, f in enumerate(o, 1):
                x = out[part, o, s]
                x["unique_fails"] += fails == {f}
                x["redundant"] += gone and f in fails
                if f in fails and not gone:
                    gone = True
                    x.update(removed=1, good_lost=good, toxic_lost=toxic)
                x["kept"] += not gone
    shapley = collections.Counter()
    for (part, o, s), x in out.items():
        shapley[part, o[s - 1]] += x["removed"]
    return {(p, o, s): tuple(x[c] for c in COUNTS[:-1]) + (shapley[p, o[s - 1]],) for (p, o, s), x in out.items()}


def held(df):
    rows = df.collect()
    assert len(rows) == len({(r.part, r.filter_order, r.step) for r in rows})
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in rows}


def test_first_failures():
    t = filter_audit.first_failures()
    assert t.shape == (32, 120) and (t[0] == 5).all() and (t[31] == 0).all()
    for mask, (k, o) in itertools.product(range(32), enumerate(filter_audit.ORDERS)):
        assert t[mask, k] == next((s for s, f in enumerate(o) if mask >> "ABCDE".index(f) & 1), 5)


def test_audit_is_brute_force(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdeé") for _ in range(n))
    texts = [" ".join(word(rng.choice((1, 6))) + rng.choice(("", "", "", "#")) * (k % 3 == 0) for _ in range(rng.choice((20, 199, 200, 260)))) for k in range(60)]
    texts = [t.upper() if k % 7 == 0 else t for k, t in enumerate(texts)] + ["A" + "b" * 49, "A" + "b" * 48, "", None, "\x0b \x1c x", "x"] * 2
    texts += texts[:20] + texts[:20]
    rows = [(rng.randrange(90), t, rng.choice(("a", "a", "b", "", None))) for t in texts] + [(None, texts[0], "a"), (None, None, None), (7, "same id", "a"), (7, "same id", "a")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, part int, `mask` int").repartition(3)
    marks = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 80, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None), (1000, 1, 1)]
    labels = {}
    for i, q, t in marks:
        if i is not None:
            labels[i] = tuple(max(a, b or 0) for a, b in zip(labels.get(i, (0, 0)), (q, t)))
    assert held(filter_audit.audit(docs, spark.createDataFrame(marks, LABELS))) == brute_audit(rows, labels)


def test_hot_and_many(spark, monkeypatch):
    """Hot texts, chunks and parts beyond what a task holds give the same counts."""
    rng = random.Random(5)
    rows = [(i, rng.choice(("x", "y")) if i % 3 else f"text {i} #", f"p{rng.randrange(40)}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(300)], LABELS)
    want = brute_audit(rows, {i: (i % 2, int(i % 5 == 0)) for i in range(300)})
    monkeypatch.setattr(filter_audit, "HOT_SHARE", 4)
    assert held(filter_audit.audit(docs, labels)) == want
    mask, part = np.array([rng.randrange(32) for _ in range(500)]), np.array([rng.randrange(3) for _ in range(500)])
    once = filter_audit._partial(mask, part, mask % 2, part % 2, 3)
    monkeypatch.setattr(filter_audit, "_CHUNK", 7)
    assert (filter_audit._partial(mask, part, mask % 2, part % 2, 3) == once).all()


def test_hard_rows(spark, hard, empty):
    none = spark.createDataFrame([], LABELS)
    rows = [(r.doc_id, r.text, r.source) for r in hard.select("doc_id", "text", "source").collect()]
    assert held(filter_audit.audit(hard, none)) == brute_audit(rows, {})
    assert filter_audit.audit(empty, none).count() == 0
    assert held(filter_audit.audit(table(spark, ["a"]), none))["s", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = {tuple(r[:3]): tuple(r[3:]) for r in c.sql(f"SELECT part, filter_order, step, {', '.join(COUNTS)} FROM ({ORACLES['op13_filter_audit']})").fetchall()}
    assert held(QUERIES["op13_filter_audit"](spark, "/root/testdata/sf0.001")) == want
