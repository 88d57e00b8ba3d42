"""Token counts by rank-synchronous merging of batched pre-tokens held as ragged numpy arrays."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARK = "▁"
_NONE = np.iinfo(np.int32).max
#: Entries that a worker remembers before it forgets all of them.
CACHE = 400_000


class PieceModel:
    """The merges of a sentencepiece BPE model with byte fallback, as arrays.

    A symbol is a string: each character of a piece and each piece. A pair of symbols merges if the joined string is a
    piece; the piece of the highest score goes first, the leftmost on ties. A symbol that is left over counts as one
    token if it is a piece, else as its UTF-8 bytes.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        if any(re.search(f"[^{_MARK}]{_MARK}|\n", p) for p in pieces) or sum(sp.is_byte(i) for i in range(n)) != 256:
            raise ValueError("a model is asked for whose pieces hold no inner word mark and no line feed, with byte fallback")
        names = list(dict.fromkeys([*(c for p in pieces for c in p), *pieces]))
        of = {s: i for i, s in enumerate(names)}
        self.unknown = len(names)
        self.width = len(names) + 1
        self.cost = np.array([1 if s in pieces else len(s.encode()) for s in names] + [0], np.int64)
        ranks = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        table = {of[p[:i]] * self.width + of[p[i:]]: (ranks[s], of[p]) for p, s in pieces.items() for i in range(1, len(p)) if p[:i] in of and p[i:] in of}
        self.pairs = table
        self.inner = np.array(sorted({of[a] * self.width + of[b] for p in pieces for a, b in zip(p, p[1:])}), np.int64)
        self.keys = np.array(sorted(table), np.int64)
        self.rank = np.array([table[k][0] for k in self.keys.tolist()] + [_NONE], np.int32)
        self.joined = np.array([table[k][1] for k in self.keys.tolist()] + [-1], np.int32)
        self.char = np.full(0x110000, self.unknown, np.int32)
        for s, i in of.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        self.splitter = re.compile(f"{_MARK}*[^{_MARK}\n]+|{_MARK}+|\n")
        self.cache: dict[str, int] = {}

    def pretokens(self, text: str) -> list[str]:
        """The parts of a text that no merge can cross."""
        return self.splitter.findall(_MARK + text.replace(" ", _MARK)) if text else []

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, len(self.keys))

    def merge_counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token.

        Two neighbouring characters that no piece holds side by side are never merged across; there, a pre-token is
        cut into sequences. In each round every sequence applies its own lowest-rank pair, at all its places at once,
        from the left and without overlap. That is what merging one by one comes to, unless a merge makes a new pair
        of that rank or a lower one, which goes before the places to its right; such a sequence's round is made from
        left to right. So a sequence takes as many rounds as it merges different pairs, whatever its length.
        """
        out = np.zeros(len(words), np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.char[code]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        lost = sym == self.unknown
        if lost.any():
            c = code[lost]
            np.add.at(out, word[lost], 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF).astype(np.int64))
        none = len(self.keys)
        if not len(sym):
            return out
        key = sym[:-1].astype(np.int64) * self.width + sym[1:]
        whole = (word[:-1] == word[1:]) & (self.inner[np.minimum(np.searchsorted(self.inner, key), len(self.inner) - 1)] == key)
        seq = np.cumsum(np.r_[True, ~whole]) - 1
        owner = word[np.flatnonzero(np.r_[True, ~whole])]
        found = np.full(len(sym), none)
        at = np.flatnonzero(whole)
        found[at] = self._find(sym[at], sym[at + 1])
        while len(sym):
            rank = self.rank[found]
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(seq)])
            live = np.repeat(least != _NONE, size)
            if not live.all():
                done = ~live
                np.add.at(out, owner[seq[done]], self.cost[sym[done]])
                sym, seq, found, rank = sym[live], seq[live], found[live], rank[live]
                least, size = least[least != _NONE], size[least != _NONE]
                if not len(sym):
                    break
            hits = np.flatnonzero(rank == np.repeat(least, size))
            start = np.maximum.accumulate(np.where(np.r_[True, hits[1:] != hits[:-1] + 1], hits, 0))
            hits = hits[(hits - start) % 2 == 0]
            made, r = self.joined[found[hits]], rank[hits]
            before = np.where(np.r_[False, hits[1:] == hits[:-1] + 2], np.r_[made[:1], made[:-1]], sym[hits - 1])
            left = np.where((hits > 0) & (seq[hits - 1] == seq[hits]), self.rank[self._find(before, made)], _NONE)
            after = np.minimum(hits + 2, len(sym) - 1)
            right = np.where((hits + 2 < len(sym)) & (seq[after] == seq[hits]), self.rank[self._find(made, sym[after])], _NONE)
            kept, low, again = np.ones(len(sym), bool), (left <= r) | (right <= r), [hits[:0]]
            if low.any():
                for q in np.unique(seq[hits[low]]).tolist():
                    a, b = np.searchsorted(seq, (q, q + 1)).tolist()
                    part = self._round(sym[a:b].tolist(), int(rank[a:b].min()))
                    sym[a : a + len(part)] = part
                    kept[a + len(part) : b] = False
                    again.append(np.arange(a, a + len(part)))
                whole = ~np.isin(seq[hits], seq[hits[low]])
                hits, made = hits[whole], made[whole]
            sym[hits] = made
            kept[hits + 1] = False
            new = np.cumsum(kept)[np.concatenate([hits, *again])] - 1
            sym, seq, found = sym[kept], seq[kept], found[kept]
            near = np.unique(np.r_[new, new - 1])
            near = near[(near >= 0) & (near < len(sym))]
            inner = near[near + 1 < len(sym)]
            inner = inner[seq[inner] == seq[inner + 1]]
            found[near] = none
            found[inner] = self._find(sym[inner], sym[inner + 1])
        return out

    def _round(self, sym: list[int], rank: int) -> list[int]:
        """A sequence after a round at ``rank``, its lowest: each merge is followed at once by those of new pairs
        beside it that do not rank behind it."""
        out, i, n, none = [], 0, len(sym), (_NONE, -1)
        pair = lambda a, b: self.pairs.get(a * self.width + b, none)
        while i < n:
            now = sym[i]
            i += 1
            if i < n and (hit := pair(now, sym[i]))[0] == rank:
                now = hit[1]
                i += 1
                while True:
                    left = pair(out[-1], now) if out else none
                    right = pair(now, sym[i]) if i < n else none
                    if min(left, right)[0] > rank:
                        break
                    if left[0] <= right[0]:
                        out.pop()
                        now = left[1]
                    else:
                        now = right[1]
                        i += 1
            out.append(now)
        return out

    def count_batch(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        split = [self.pretokens(t) for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        fresh = [w for w in set().union(*split) if w not in self.cache]
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            self.cache.update(zip(part, self.merge_counts(part).tolist()))
        return [sum(map(self.cache.__getitem__, words)) for words in split]


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``.

    Tokens are those of the sentencepiece BPE model at ``model_path`` (a file that all executors have), without begin
    and end; over_limit says whether there are more than ``limit``. A null text counts as empty and has no bytes and no
    tokens; a null id is kept. A very long text is counted whole, by the same merging as any other. Rows keep their
    number and order, repeated ones too; no rows give no rows; other columns are not read. One pass, no shuffle.
    """

    def run(batches):
        model = piece_model(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t.as_py() or "" for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(model.count_batch(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
