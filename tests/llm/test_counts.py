"""Contracts with a value for every document: fingerprints, tokens, packing, licences, quality, personal data."""

import collections
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from gasframe.llm import common, licenses, packing, pii, quality, simhash, token_counts

from .conftest import LONG, table

SP, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def text_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def brute_print(text):
    w = WORD.findall(text.translate(LOWER))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def test_fingerprints_and_components(spark, hard):
    got = simhash.near_duplicates(hard).collect()
    want = collections.Counter((d, f"{brute_print(t):016x}") for d, t in text_of(hard))
    assert collections.Counter((r.doc_id, r.fingerprint) for r in got) == want
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.component_id for r in zero} == {0} and len(zero) == 4


def components(prints, distance=2):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("distance,crowd", [(1, 64), (2, 64), (1, 6), (2, 6)])
def test_links_are_whole_in_crowded_buckets(spark, distance, crowd):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {centre, 0, 2**64 - 1, 1 << 63, 1}
    for _ in range(150):
        prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    chain = rng.getrandbits(64)
    for b in range(0, 40, 2):
        chain ^= 3 << b
        prints.add(chain)
    prints |= {rng.getrandbits(64) for _ in range(100)}
    prints = sorted(prints)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r.node: r.root for r in common.connected_components(simhash.links(df, distance, crowd)).collect()}
    groups = collections.defaultdict(set)
    for s in signed:
        groups[roots.get(s, s)].add(s)
    want = collections.defaultdict(set)
    for s, c in zip(signed, components(prints, distance)):
        want[c].add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_near_copies_are_proposed_by_fingerprints(spark, monkeypatch):
    """Without any band, sets whose SimHashes differ in one or two bits meet by the variants of their segments."""
    words = [f"w{i * 7919 % 4001}" for i in range(3000)]
    print_of = lambda w: simhash._simhash(simhash.shingle_set(" ".join(w).encode()))
    copies = [[*words[:i], "changed", *words[i + 1 :]] for i in range(0, 3000, 97)]
    near = next(w for w in copies if 0 < (print_of(w) ^ print_of(words)).bit_count() <= 2)
    df = table(spark, [" ".join(words), " ".join(near), " ".join(words[::-1]), " ".join(words) + "  ", ""])
    monkeypatch.setattr(simhash, "_bands", lambda held: [])
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4}


def test_keep_one(spark, hard, empty):
    out = simhash.keep_one(hard)
    assert out.columns == hard.columns
    kept = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert kept[(4, LONG)] == 1 and (5, LONG) not in kept and kept[(0, "")] == 1 and (1, None) not in kept
    assert kept[(None, "no id here")] == 1 and (None, None) not in kept
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_near_copies_of_the_stage(spark, hard, empty):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(12):
        one = rng.choices(words, k=rng.randint(60, 400))
        texts.append(" ".join(one))
        for changes in (1, 2, 3, 5, 9, 20):
            other = list(one)
            for at in rng.sample(range(len(one)), changes):
                other[at] = "changed"
            texts.append(" ".join(other))
    sets = [set(zip(*((w := t.split())[i:] for i in range(5)))) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    df = table(spark, texts)
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()} == dict(enumerate(root))
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(root)
    out = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, hard, "").collect())
    assert out[(4, LONG)] == 1 and (5, LONG) not in out and out[(0, "")] == 1 and (1, None) not in out and out[(None, "no id here")] == 1
    assert corpus_pipeline.near_duplicates(spark, empty, "").count() == 0


def crowd(rng, n, kind):
    """Texts with much in common: their own beginnings and a common end, or single words changed, or copies of it."""
    shared = [f"t{i}" for i in range(300)]
    out = []
    for d in range(n):
        if kind == "ends":
            tail = shared[rng.randrange(60) :]
            out.append([f"d{d}x{i}" for i in range(int(len(tail) * rng.uniform(0.05, 0.6)))] + tail)
        else:
            out.append([f"d{d}x{i}" if rng.random() < rng.choice((0.004, 0.02)) else w for i, w in enumerate(shared)])
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("kind", ["ends", "words"])
def test_crowds_meet_by_what_can_be_alike(spark, kind):
    """All pairs of different roots that are alike, and for twice the crowd not four times as many others."""
    made = {}
    for n in (150, 300):
        rng = random.Random(n)
        held = {k: simhash.shingle_set(t.encode()).astype(np.int64) for k, t in enumerate(crowd(rng, n, kind))}
        sets = {k: set(x.tolist()) for k, x in held.items()}
        alike = [(a, b) for a in sets for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
        # Roots as after the comparison with one central set: the one that most are like.
        degree = collections.Counter(x for p in alike for x in p)
        center = max(sets, key=lambda k: (degree[k], k))
        root = {k: center if k == center or (max(k, center), min(k, center)) in set(alike) else k for k in sets}
        df = spark.createDataFrame([(k, len(x), root[k], x.tolist()) for k, x in held.items()], "fp long, n long, root long, held array<bigint>")
        got = {(r.b, r.a) for r in simhash.prefix_pairs(df, 0.8).collect()}
        assert {p for p in alike if root[p[0]] != root[p[1]]} <= got and all(root[a] != root[b] for a, b in got)
        made[n] = len(got - set(alike)), len(alike)
    assert made[300][0] <= 2.5 * made[150][0] + (kind == "words") * made[300][1] + 50, made


@pytest.fixture(scope="session")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=SP)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t▁<s>aeth́日\x00"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=6))
def test_token_counts_are_the_library_s(texts):
    import sentencepiece

    model = token_counts.piece_model(SP)
    lib = sentencepiece.SentencePieceProcessor(model_file=SP)
    assert model.count_batch(texts) == [len(lib.encode(t)) for t in texts]


def test_token_counts(spark, hard, empty, sp):
    got = collections.Counter(tuple(r) for r in token_counts.count_tokens(hard, SP).collect())
    want = collections.Counter((d, len(t.encode()), n := len(sp.encode(t)), n > 4096) for d, t in text_of(hard))
    assert got == want and token_counts.count_tokens(empty, SP).count() == 0
    rng = random.Random(1)
    soup = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    long = ["the" * 20000, " " * 9999, "日本" * 7000, "a" * 60001, "ab" * 9000 + "abc" * 900, soup("etaoin", 20000), soup("0123456789abcdef", 20000), soup("abcdefghijklmnopqrstuvwxyz", 20000), soup(["in", "the", "tion", " "], 9000), soup("日本中国人é", 9000)]
    assert token_counts.piece_model(SP).count_batch(long) == [len(sp.encode(t)) for t in long]


def check_packing(docs, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    ids = [(d, [*lib.encode(t, add_special_tokens=False).ids, 1]) for d, t in docs]
    want = collections.Counter()
    sequences, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    for d, x in ids:
        want[d, len(x)] += len(x)
    got = collections.Counter()
    for r in rows:
        got[r.doc_id, r.doc_tokens] += r.length
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for d, x in ids if d == r.doc_id and len(x) == r.doc_tokens)
    assert got == want
    return by_doc


def test_packing(spark, hard, empty):
    check_packing(text_of(hard), packing.pack(hard, BPE).collect())
    assert packing.pack(empty, BPE).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs.repartition(3), BPE).collect()
    by_doc = check_packing(text_of(docs), rows)
    for parts in by_doc.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at
            at += r.length
    steps = collections.Counter()
    for r in rows:
        steps[r.step_group] += r.length
    assert max(steps.values()) <= 16 * 2048
    whole = packing.pack(docs.limit(5), BPE, with_ids=True).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in whole)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("<|endoftext|> 's\n\t "), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_byte_level_ids_are_the_library_s(text):
    b = packing.byte_bpe(BPE)
    assert b.ids(text).tolist() == b.library.encode(text, add_special_tokens=False).ids


def test_special_string_inside_a_text():
    b = packing.byte_bpe(BPE)
    assert 50256 in b.ids("a <|endoftext|> b").tolist()


LICENCE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_licences(spark, hard, empty):
    texts = ["under the MIT license, UNDER the mit-license", "cc by nc by nc CC-BY-NC 4.0", "Apache License, Version 2.0 K", None, "Permission is hereby granted, free of charge, to anybody obtaining a copy of this software and the associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "under the mit", "Éunder the mit licenseé"]
    df = table(spark, texts)
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, t in enumerate(texts):
        w = LICENCE_WORD.findall((t or "").translate(LOWER))
        want = sorted((i, i + len(p.split()), lab) for lab, p in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert [tuple(x) for x in got[i].places] == want and got[i].n_words == len(w)
    assert [f.label for f in got[4].found] == ["mit"] and 0.5 < got[4].found[0].coverage < 1
    assert not got[5].found and not got[3].found
    out = licenses.scan(hard).collect()
    assert collections.Counter((r.doc_id, r.n_words) for r in out) == collections.Counter((d, len(LICENCE_WORD.findall(t))) for d, t in text_of(hard))
    assert licenses.scan(empty).count() == 0


def brute_quality(text):
    w = WORD.findall(text)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    cover = {i + j for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def test_quality(spark, hard, empty):
    q = quality.quality(hard).select("row.doc_id", "row.text", "q.*", "kept", "row.key")
    for r in q.collect():
        want = brute_quality(r.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.base_failed and r.kept)
    assert q.count() == hard.count() and quality.quality(empty).count() == 0
    rng = random.Random(2)
    words = ["the", "of", "and", "harbour", "lamp", "to", "in", "quiet", "a", "night", "is", "sail", "rope", "tide", "that"]
    good = [" ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(300)) for _ in range(40)]
    junk = [" ".join(f"{rng.choice('#%&*$')}{rng.randint(0, 99999)}{rng.choice('#%&*$|<>')}" for _ in range(300)) for _ in range(3)]
    out = {r.doc_id: r.kept for r in quality.quality(table(spark, good + junk)).select("row.doc_id", "kept").collect()}
    assert all(out[i] for i in range(40)) and not any(out[40 + i] for i in range(3))
    for lang in ("EN", "en-GB", "xx", None):
        for some in (good + junk, good[:1] + junk[:1]):
            other = {r.doc_id: r for r in quality.quality(table(spark, some, lang=lang)).select("row.doc_id", "kept", "word_distance").collect()}
            assert [other[i].kept for i in range(len(some))] == [t in good for t in some], "a verdict depends on the document alone"
            assert all((r.word_distance is None) == (lang in ("xx", None)) for r in other.values())


def brute_distance(p, q):
    p, q = [x / max(sum(p), 1e-9) for x in p], [x / sum(q) for x in q]
    side = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x > 0)
    return math.sqrt(max((side(p, q) + side(q, p)) / 2, 0))


def test_distances_of_histograms(spark):
    import unicodedata

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in quality.quality(docs).select("row.text", "row.lang", "q.n_words", "class_distance", "word_distance").collect():
        if not r.n_words:
            continue
        held = [0] * 6
        for c in r.text:
            kind = unicodedata.category(c)
            held[0 if kind == "Ll" else 1 if kind == "Lu" else 2 if kind == "Nd" else 3 if c in ".,;:!?'\"()-" else 4 if c in " \t\n\x0b\f\r" else 5] += 1
        words = [w.rstrip(".,;:!?").lower() for w in WORD.findall(r.text)]
        commons = [words.count(w) for w in quality.COMMON_WORDS[r.lang]]
        shares = quality.WORD_SHARES[r.lang]
        assert r.class_distance == pytest.approx(brute_distance(held, quality.CLASS_SHARES[r.lang]), abs=1e-6)
        assert r.word_distance == pytest.approx(brute_distance([*commons, len(words) - sum(commons)], [*shares, 1 - sum(shares)]), abs=1e-6)


def test_references_can_be_fitted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = quality.fit_references(docs)
    assert set(found.classes) == set(quality.CLASS_SHARES) and 0.5 < sum(found.classes["en"]) <= 1.01
    assert quality.quality(docs, references=found).where("kept").count() > 0


def luhn(d):
    return sum((x := int(c) * (1 + i % 2)) - 9 * (x > 9) for i, c in enumerate(reversed(d))) % 10 == 0


PLAIN = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_pii(t):
    out = []
    for rank, (kind, p) in enumerate(PLAIN):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


TRICKY = ["a@b.c%d@e.f x@y..z me.you+1@a-b.co.uk", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111111", "+1 (268) 555-9530 +12 34 +1-23-456-7890-1234567 +49 +1+2 3456789012", "é\U0001f600 a@b.cd \U0001f600+1 (268) 555-9530 10.0.0.1" * 3, "@ + 1.2", "x" * 3000 + "@y.z"]


def test_base_spans(spark, hard, empty):
    rng = random.Random(4)
    noise = ["".join(rng.choice("0123456789.+-() @ab") for _ in range(60)) for _ in range(300)]
    df = table(spark, TRICKY + noise).unionByName(hard)
    got = pii.find(df).select("doc_id", pii.joined(F.col("base")).alias("b")).collect()
    assert collections.Counter((r.doc_id, r.b) for r in got) == collections.Counter((d, brute_pii(t)) for d, t in text_of(df))
    assert pii.find(empty).count() == 0 and pii.sanitise(empty).count() == 0


def test_disclosing_terms_and_rewriting(spark):
    mail = "keeper@light.example"
    texts = [f"number {i} the zanzibar harbour wrote to {mail} in the winter {i * 7}" for i in range(4)] + [f"the harbour in winter wrote to nobody {i}" for i in range(60)] + ["call +1 (268) 555-9530 or 10.0.0.1", None]
    df = table(spark, texts)
    found = {r.doc_id: r for r in pii.find(df).select("doc_id", "base", "spans").collect()}
    hit = [(s.kind, s.value) for s in found[0].spans]
    assert ("drop", "zanzibar") in hit and ("email", mail) in hit and not any(v in ("the", "harbour", "winter") for _, v in hit)
    assert not [s for s in found[10].spans]
    out = pii.sanitise(df)
    assert out.columns == df.columns
    clean = {r.doc_id: r.text for r in out.collect()}
    assert "zanzibar" not in clean[0] and "[EMAIL]" in clean[0] and mail not in clean[0] and clean[64] == "call [PHONE] or [IP]" and clean[65] is None and clean[10] == texts[10]


def brute_disclosure(rows):
    """The added spans of different (id, text) rows, entity by entity and term by term, as the docstrings have it."""
    digits = lambda v: re.sub("[^0-9]", "", v)
    term = re.compile(r"[^\W\d_]{3,}")
    n, documents, mentions = len(rows), collections.Counter(), collections.defaultdict(set)
    free, df = [], collections.Counter()
    for at, (_, text) in enumerate(rows):
        df.update({w.lower() for w in term.findall(text)})
        spans = [x.split(":") for x in brute_pii(text).split(",") if x]
        spans = [(kind, int(a), int(b)) for kind, a, b in spans]
        for kind, a, b in spans:
            v = text[a:b].lower()
            group = {"email": v.split("@")[-1], "ip": ".".join(v.split(".")[:3]), "card": digits(v)[:6], "phone": digits(v)[:-4]}[kind]
            for e in (f"{kind}:{digits(v) if kind in ('card', 'phone') else v}", f"{kind}/{group}", kind):
                mentions[e].add(at)
        free.append([(m[0].lower(), m.start(), m.end()) for m in term.finditer(text) if spans and not any(a < m.end() and m.start() < b for _, a, b in spans)])
    most = collections.defaultdict(float)
    for e, held in mentions.items():
        n_e, joint = len(held), collections.defaultdict(set)
        for at in held:
            for w in {w for w, _, _ in free[at]}:
                joint[w].add(at)
        for w, both in joint.items():
            if len({rows[at][1] for at in both}) < 2 or n_e == n:
                continue
            disclosure = min(1.0, math.log2(n * len(both) / (n_e * df[w])) / math.log2(n / n_e))
            if disclosure >= pii.GENERALISE and (math.e * n_e * df[w] / (n * len(both))) ** len(both) <= pii.MAX_CHANCE:
                for at in held:
                    most[at, w] = max(most[at, w], disclosure)
    return {row: sorted((a, b, "drop" if most[at, w] >= pii.REMOVE else "term") for w, a, b in free[at] if (at, w) in most) for at, row in enumerate(rows)}


def test_disclosure_is_that_of_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names = ["zanzibar", "Quillon", "harbour", "obsidian", "velvet"]
    rng, extra = random.Random(17), []
    for i in range(60):
        own = [names[i % 5]] if rng.random() < 0.8 else []
        extra.append((5000 + i, f"note {i} {' '.join(own)} {rng.choice(names)} " + rng.choice([f"to a{i % 3}@firm{i % 5}.example", f"call +1 (20{i % 5}) 555-10{i:02d}", f"host 10.{i % 4}.0.{i}", "nobody"])))
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    want = brute_disclosure([(r.doc_id, r.text or "") for r in df.collect()])
    got = {(r.doc_id, r.text): sorted((x.start, x.end, x.kind) for x in r.spans if x.kind in ("term", "drop")) for r in pii.find(df, carry=True).select("doc_id", "text", "spans").collect()}
    assert got == want and sum(map(len, want.values())) >= 50 and {k for x in want.values() for *_, k in x} == {"term", "drop"}


def test_disclosing_terms_far_from_the_mention(spark):
    mail, gap = "keeper@light.example", "the harbour in winter was calm and grey all day long " * 8
    texts = [f"Zanzibar {i} {gap} wrote to {mail} about zanzibar, then {gap} ZANZIBAR" for i in range(4)] + [f"{gap} wrote to nobody about then {i}" for i in range(60)]
    clean = {r.doc_id: r.text for r in pii.sanitise(table(spark, texts)).collect()}
    assert all("zanzibar" not in clean[i].lower() and mail not in clean[i] and "harbour" in clean[i] for i in range(4))
    assert all(clean[i] == texts[i] for i in range(4, 64))


def test_very_many_spans(spark):
    """Rewriting and the search for terms take time in proportion to a text's spans; overlaps and blots are right."""
    rng = random.Random(3)
    for n in (3, 1000):
        text = "".join(rng.choice((f"name{i}@mail{i % 9}.org ", "call +49 1234 567890 ", "4111 1111 1111 1111, ", "né\ue000b@c.de ", "wördé plain ", "+12345678901234567 ")) for i in range(n)) + "end"
        row = spark.createDataFrame([(text,), (text.replace("\ue000", "e"),)], "text string").select("text", pii.base_spans(F.col("text")).alias("base"))
        for r in row.select("text", "base", pii._terms(F.col("text"), F.col("base")).alias("terms"), pii.sanitised(F.col("text"), F.col("base")).alias("clean")).collect():
            spans = [(x.start, x.end, x.kind) for x in r.base]
            words = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", r.text)]
            assert [tuple(t) for t in r.terms] == [w for w in words if not any(a < w[2] and w[1] < b for a, b, _ in spans)]
            at, out = 0, []
            for a, b, kind in spans:
                out += [r.text[at:a], pii.LABELS[kind]] if a >= at else []
                at = max(at, b)
            assert r.clean == "".join(out) + r.text[at:]
    many = spark.createDataFrame([(1, " ".join(f"user{i}@host{i % 50}.example.com" for i in range(100_000)))], "doc_id long, text string")
    began = time.perf_counter()
    done = many.select(pii.base_spans(F.col("text")).alias("base"), "text").select(F.length(pii.sanitised(F.col("text"), F.col("base"))).alias("n"), F.size(pii._terms(F.col("text"), F.col("base"))).alias("t")).first()
    assert done.n == 100_000 * 8 - 1 and done.t == 0 and time.perf_counter() - began < 60
