"""Spelling variants against comparing every word with every other."""

import collections
import random
import re
import zlib

from gasframe.llm import spelling

from .conftest import table


def brute_counts(rows):
    out = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute_variants(counts):
    out, form = {}, {}
    for w, n in counts.items():
        near = sorted((-m, v) for v, m in counts.items() if one_apart(w, v))
        if near and -near[0][0] >= 2 * n:
            form[w] = near[0][1]
        out[w] = [form.get(w), None, n, len(near), counts.get(form.get(w))]
    for w, x in out.items():
        root = w
        while root in form:
            root = form[root]
        x[1] = root
    return {w: tuple(x) for w, x in out.items()}


def held(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def words(rng, n, letters="abé", lengths=(5, 6, 7, 8)):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.choice(lengths))) for _ in range(n)})


def test_automaton():
    rng = random.Random(1)
    own = words(rng, 700) + ["z" * 4000]
    a = spelling.Automaton(own)
    assert [a.number(w) for w in own] == list(range(len(own)))
    assert a.number("") == a.number("ab") == a.number(own[0] + "q") == -1
    # Minimal: no two states have the same words before them.
    assert len({(f, tuple(e.items())) for f, e in zip(a.final, a.edges)}) == len(a.edges)
    back = spelling.Automaton(sorted(w[::-1] for w in own))
    turned = sorted(w[::-1] for w in own)
    for w in [*own[::9], *words(rng, 60), "z" * 3999, "z" * 4001, "y" + "z" * 3999]:
        front = {own[i] for i in a.completions(w, len(w) // 2)}
        end = {turned[i][::-1] for i in back.completions(w[::-1], (len(w) + 1) // 2)}
        assert front | end == {v for v in own if one_apart(w, v)}
    assert spelling.Automaton([]).completions("abcde", 2) == set()


def test_variants_are_brute_force(spark):
    rng = random.Random(2)
    own = words(rng, 260) + words(rng, 60, "xyzü", (4, 9, 10))
    often = [w for w in own for _ in range(rng.choice((1, 3, 3, 4, 7, 15, 40)))]
    rng.shuffle(often)
    texts = [rng.choice((" ", ", ", "1")).join(w.upper() if k % 5 == 0 else w for w in often[k : k + 37]) for k in range(0, len(often), 37)]
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[3]), (3, None), (8, "")]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    counts = brute_counts(rows)
    assert {r.word: r.n for r in spelling.count_words(docs).collect()} == counts
    want = brute_variants(counts)
    assert sum(x[0] is not None for x in want.values()) > 20 and any(x[1] != x[0] for x in want.values() if x[0])
    assert held(spelling.variants(docs)) == want


def test_hot_halves_and_blocks(spark):
    """Shards of hot halves and blocks of an automaton lose and double nothing."""
    rng = random.Random(4)
    own = words(rng, 500, "ab", (5, 6, 7))
    df = spark.createDataFrame([(w, i + 3) for i, w in enumerate(own)], "word string, n long")
    want = {w: {(i + 3, v) for i, v in enumerate(own) if one_apart(w, v)} for w in own}
    for shard, block in ((4, 6), (1000, 10**6)):
        rows = spelling.near_words(df, shard, block).collect()
        assert len(rows) == len(own)
        assert {r.word: {(x.n, x.word) for x in r.near} for r in rows} == want and all(len(r.near) == len(want[r.word]) for r in rows)


def test_flushing(spark, monkeypatch):
    docs = table(spark, ["alpha gamma delta", "alpha alpha gamma omega omega omega", "gamma"])
    once = {r.word: r.n for r in spelling.count_words(docs).collect()}
    monkeypatch.setattr(spelling, "_HELD", 1)
    assert {r.word: r.n for r in spelling.count_words(docs).collect()} == once


def test_hard_rows(spark, hard, empty):
    rows = [(r.doc_id, r.text) for r in hard.select("doc_id", "text").collect()]
    assert held(spelling.variants(hard)) == brute_variants(brute_counts(rows))
    assert spelling.variants(empty).count() == 0
    assert held(spelling.variants(table(spark, ["word " * 3]))) == {}
