"""A quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gasframe.llm.common import written

#: Labelled rows that a model is fitted on at most: those of the least hashes of their ids.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 60, 4, 64, 0.2
#: Least curvature (rows weighted by how open their label still is) of a leaf, and what is added to it.
MIN_LEAF, SHRINK = 1.0, 1.0
#: Rows of every five by the checksum of the id that are never learned from, and the score from which label 1 is predicted.
FOLDS, LIMIT = 5, 0.3
_CHUNK = 4096

STATISTICS = (
    "log_words", "log_bytes_a_line", "word_length", "word_length_deviation", "longest_word", "distinct_words", "distinct_pairs", "distinct_triples",
    "commonest_word", "same_as_before", "lower", "upper", "wide", "digits", "spaces", "stops", "commas", "marks", "signs", "bars", "entropy",
    "distinct_lines", "lines_with_stop", "words_with_sign", "words_in_capitals", "words_a_stop",
)
_BYTES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "wide": bytes(range(0xC0, 0x100)),
    "digits": b"0123456789",
    "spaces": b" \t\n\x0b\f\r",
    "stops": b".?",
    "commas": b",;:'\"()-",
    "marks": b"!",
    "signs": b"#$%&*+/<=>@[\\]^_`{}~",
    "bars": b"|",
}
_CLASSES = np.array([[b in held for b in range(256)] for held in _BYTES.values()], np.float64).T
_SIGNS = tuple(bytes([b]) for b in _BYTES["signs"] + _BYTES["marks"])


def statistics_of(data: bytes) -> list[float]:
    """The ``STATISTICS`` of one whole UTF-8 text; all zero if it is empty."""
    if not data:
        return [0.0] * len(STATISTICS)
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = len(data) - int(by_byte[0x80:0xC0].sum())
    share = by_byte[by_byte > 0] / len(data)
    shares = (by_byte @ _CLASSES / max(chars, 1)).tolist()
    words = data.split()
    n, some = len(words), max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    rows = max(len(lines), 1)
    stops = int(by_byte[ord(".")] + by_byte[ord("?")] + by_byte[ord("!")])
    return [
        np.log1p(n), np.log1p(len(data) / rows), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        len(set(words)) / some, len(set(zip(words, words[1:]))) / max(n - 1, 1), len(set(zip(words, words[1:], words[2:]))) / max(n - 2, 1),
        max(Counter(words).values(), default=0) / some, sum(map(bytes.__eq__, words, words[1:])) / some, *shares, -float(share @ np.log2(share)),
        len(set(lines)) / rows, sum(x.rstrip().endswith((b".", b"?", b"!")) for x in lines) / rows, sum(w.endswith(_SIGNS) for w in words) / some, sum(map(bytes.isupper, words)) / some, n / (stops + 1),
    ]


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth, flattened: the children of place i are 2 i + 1 and 2 i + 2, a row goes to the
    second if its value of ``feature`` is above ``cut``, and the places after the last cut are those of ``leaf``."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row of ``x``: all rows go down all trees together, a level at a time."""
        trees, places = self.feature.shape
        depth, each = (places + 1).bit_length() - 1, np.arange(trees)
        out = np.empty(len(x))
        for low in range(0, len(x), _CHUNK):
            part = x[low : low + _CHUNK]
            at, row = np.zeros((len(part), trees), np.int64), np.arange(len(part))[:, None]
            for _ in range(depth):
                at = 2 * at + 1 + (part[row, self.feature[each, at]] > self.cut[each, at])
            out[low : low + _CHUNK] = self.start + self.leaf[each, at - places].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def best_splits(bins: np.ndarray, node: np.ndarray, nodes: int, slope: np.ndarray, curve: np.ndarray, n_bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, feature, bin) of the best split of each node, from histograms of slope and curvature by node, feature and
    bin; rows of that bin and below go left. Without a split that gains, gain is zero."""
    rows, width = bins.shape
    cell = ((node[:, None] * width + np.arange(width)) * n_bins + bins).ravel()
    held = lambda v: np.bincount(cell, np.repeat(v, width), nodes * width * n_bins).reshape(nodes, width, n_bins)
    g, h = held(slope).cumsum(axis=2), held(curve).cumsum(axis=2)
    all_g, all_h = g[:, :, -1:], h[:, :, -1:]
    gain = g**2 / (h + SHRINK) + (all_g - g) ** 2 / (all_h - h + SHRINK) - all_g**2 / (all_h + SHRINK)
    gain = np.where((h >= MIN_LEAF) & (all_h - h >= MIN_LEAF), gain, 0.0).reshape(nodes, -1)
    best = gain.argmax(axis=1)
    return np.maximum(gain[np.arange(nodes), best], 0.0), best // n_bins, best % n_bins


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, n_bins: int = BINS, rate: float = RATE) -> Trees:
    """Trees for labels ``y`` (0 or 1), each fitted to the slope of the logistic loss of those before. Without rows, every
    score is one half."""
    y = y.astype(np.float64)
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    places = (1 << depth) - 1
    feature, cut, leaf = np.zeros((trees, places), np.int64), np.full((trees, places), np.inf), np.zeros((trees, places + 1))
    if not len(y):
        return Trees(start, feature, cut, leaf)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, n_bins + 1)[1:-1], method="inverted_cdf")) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], axis=1)
    total, row = np.full(len(y), start), np.arange(len(y))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        slope, curve, node = p - y, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(depth):
            gain, f, b = best_splits(bins, node, 1 << level, slope, curve, n_bins)
            first = (1 << level) - 1
            for k in np.flatnonzero(gain > 1e-9):
                feature[t, first + k], cut[t, first + k] = f[k], cuts[f[k]][b[k]]
            right = (gain[node] > 1e-9) & (bins[row, f[node]] > b[node])
            node = 2 * node + right
        leaf[t] = -rate * np.bincount(node, slope, places + 1) / (np.bincount(node, curve, places + 1) + SHRINK)
        total += leaf[t, node]
    return Trees(start, feature, cut, leaf)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of each row's whole text."""

    def run(batches):
        for batch in batches:
            x = np.array([statistics_of(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())], np.float32).reshape(-1, len(STATISTICS))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], ["id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, x array<float>")


def held_out(id_col) -> F.Column:
    """Whether a row is left out of learning: the checksum of its id as text, an empty one without id, is divisible."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def learned(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = SAMPLE_ROWS) -> Trees:
    """A model from the ``rows`` of ``measured`` whose ids have a label and are not held out: ``max_rows`` ids, those of the
    least hashes, are looked up, and of rows with one id one is taken."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).alias("y"))
    some = written(known.orderBy(F.xxhash64("id"), "id").limit(max_rows), "sample")
    found = rows.join(F.broadcast(some), "id").groupBy("id", "y").agg(F.min("x").alias("x")).orderBy("id").toPandas()
    x = np.stack(found["x"]).astype(np.float32) if len(found) else np.zeros((0, len(STATISTICS)), np.float32)
    return fit(x, found["y"].to_numpy() == 1)


def scored(rows: DataFrame, model: Trees) -> DataFrame:
    """(id, score) of the ``rows`` of ``measured``."""

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x), pa.float64())], ["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per row of ``docs``.

    Texts are read once, for their ``STATISTICS``; a bounded sample of labelled rows (``max_rows``) fits the trees on the
    driver, and every row is scored with their flat arrays. Identifiers, languages and sources are no input.

    A null text counts as empty, and an empty one is scored like another; a row without an id counts as held out;
    repeated rows have equal scores, and count once for learning; of several labels of an id, 1 stands; a null label is none;
    very long texts are read whole; other columns are not read; an empty table gives no rows, and without labels every
    score is one half.
    """
    rows = written(measured(docs, id_col, text_col), "statistics")
    out = scored(rows, learned(rows, labels, id_col, label_col, max_rows))
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
