"""Boosted trees against exhaustive search and row-wise descent, and the classifier on held-out rows."""

import math
import random
import zlib

import numpy as np
import pandas as pd

from gasframe.llm import quality_model as qm
from gasframe.llm.queries import QUERIES

from .conftest import table

LABELS = "doc_id long, quality int, toxic int"


def one_score(model, row):
    total = model.start
    for feature, cut, leaf in zip(model.feature, model.cut, model.leaf):
        at = 0
        while at < len(feature):
            at = 2 * at + (2 if row[feature[at]] > cut[at] else 1)
        total += leaf[at - len(feature)]
    return 1 / (1 + math.exp(-total))


def test_scores_are_row_by_row():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5000, 6)).astype(np.float32)
    x[::7, 2] = 0.5
    y = (x[:, 0] > 0) & (x[:, 1] > -0.5) | (x[:, 2] > 1)
    model = qm.fit(x, y, trees=20, depth=3)
    got = model.scores(x)
    assert np.allclose(got[::50], [one_score(model, r) for r in x[::50]])
    assert ((got > 0.5) == y).mean() > 0.95
    assert len(model.scores(x[:0])) == 0


def test_splits_are_exhaustive():
    rng = np.random.default_rng(2)
    bins, node = rng.integers(0, 8, (300, 4)), rng.integers(0, 3, 300)
    slope, curve = rng.normal(size=300), rng.uniform(0.05, 0.25, 300)
    gain, feature, at = qm.best_splits(bins, node, 4, slope, curve, 8)
    part = lambda rows: slope[rows].sum() ** 2 / (curve[rows].sum() + qm.SHRINK)
    for k in range(3):
        own, best = node == k, 0.0
        for f in range(4):
            for b in range(8):
                left = own & (bins[:, f] <= b)
                right = own & ~left
                if min(curve[left].sum(), curve[right].sum()) >= qm.MIN_LEAF:
                    best = max(best, part(left) + part(right) - part(own))
        assert abs(best - gain[k]) < 1e-9 and best > 0
    assert gain[3] == 0


def test_fit_without_choice():
    one = qm.fit(np.zeros((4, 2), np.float32), np.array([True] * 4))
    assert (one.scores(np.zeros((3, 2), np.float32)) > 0.8).all()
    assert (qm.fit(np.zeros((0, 2), np.float32), np.zeros(0)).scores(np.ones((3, 2), np.float32)) == 0.5).all()


def test_statistics():
    x = dict(zip(qm.STATISTICS, qm.statistics_of("Aé b! B.\n\nAé b! B.\n|9#".encode())))
    assert x["log_words"] == math.log1p(7) and x["distinct_words"] == 4 / 7 and x["distinct_lines"] == 2 / 3
    assert x["upper"] == 4 / 22 and x["wide"] == 2 / 22 and x["bars"] == x["digits"] == x["signs"] == 1 / 22 and x["commonest_word"] == 2 / 7
    assert x["lines_with_stop"] == 2 / 3 and x["words_with_sign"] == 3 / 7 and x["words_in_capitals"] == 4 / 7 and x["words_a_stop"] == 7 / 5
    assert qm.statistics_of(b"") == [0.0] * len(qm.STATISTICS) and all(map(math.isfinite, qm.statistics_of(b" \n")))


def area(scores, labels):
    rank = pd.Series(scores).rank().to_numpy()
    n = labels.sum()
    return (rank[labels].sum() - n * (n + 1) / 2) / (n * (len(labels) - n))


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op11_quality_model"](spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all() and (got.predicted == (got.score >= 0.3)).all()
    both = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    out = both[both.held_out]
    assert area(out.score.to_numpy(), out.quality.to_numpy() == 1) > 0.97
    assert (out.predicted == out.quality).mean() > 0.93


def test_only_learning_rows_count(spark):
    """Labels of held-out rows, ids and other columns change nothing."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(("good", "words", "stand", "here.")) + ("#" if i % 2 else "") for _ in range(rng.randrange(5, 60))) for i in range(200)]
    docs = table(spark, texts)
    out = {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}
    score = lambda d, marks: [r.score for r in qm.classify(d, spark.createDataFrame(marks, LABELS)).orderBy("doc_id").collect()]
    own = [(i, int(i % 2 == 0), 0) for i in range(200)]
    a = score(docs, own)
    assert a == score(table(spark, texts, "fr"), [(i, 1 - q if i in out else q, 1) for i, q, _ in own] + [(None, 1, 1), (2, None, None)])
    assert all((x >= 0.5) == (i % 2 == 0) for i, x in enumerate(a))


def test_hard_rows(spark, hard, empty):
    none, some = spark.createDataFrame([], LABELS), spark.createDataFrame([(4, 1, 0), (4, 0, 0), (1, 0, 0), (7, 1, 1), (None, 0, 0)], LABELS)
    rows = qm.classify(hard, none).collect()
    assert len(rows) == hard.count() and {r.score for r in rows} == {0.5} and all(r.held_out for r in rows if r.doc_id is None)
    rows = qm.classify(hard, some).collect()
    assert len(rows) == hard.count() and len({r.score for r in rows if r.doc_id in (4, 5)}) == 1
    assert qm.classify(empty, some).count() == 0
