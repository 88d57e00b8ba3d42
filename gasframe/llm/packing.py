"""Hierarchical multi-length packing of tokenised documents, in one pass and without a shuffle."""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Context sizes; the last is the sequence limit.
TIERS = (256, 512, 1024, 2048)
#: Remainders that wait in a tier before one of them opens a window.
WAITING = 256
#: Tokens of a training step (in windows of the longest tier) and steps that are balanced together.
STEP_WINDOWS, STEP_GROUPS = 16, 4

#: The pre-token pattern that byte-level BPE vocabularies of this family share (a fixed value).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteBpe:
    """Ids as the ``tokenizers`` library gives them for a byte-level BPE file, at the speed of ``tiktoken``.

    The file's vocabulary becomes a rank table. Texts that ``tiktoken`` cannot take go to the library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in set(kept)]
        byte = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        self.fast = tiktoken.Encoding(path, pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


_loaded: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


class Packer:
    """Packs pieces as they come. A piece is (length, arrival, doc, start, ids, doc_tokens).

    Documents give whole windows of the longest tier; what is left of one waits in the smallest tier that holds it.
    Once more than ``waiting`` pieces wait in a tier, its longest opens a window there. The gap of the window takes
    the longest waiting pieces that fit, which are of shorter tiers; if none fits, the longest piece of the nearest
    shorter tier with any is cut to fill it. So every window is full. At the end the waiting pieces are packed alike,
    longest tier first; the tokens that fill no window any more, less than one, are cut at powers of two.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS, waiting: int = WAITING):
        self.tiers, self.waiting = tuple(sorted(tiers)), waiting
        self.pools: list[list] = [[] for _ in self.tiers]
        self.open: list[list] = [[] for _ in self.tiers]
        self.arrival = self.sequences = self.steps = 0

    def _wait(self, doc, start: int, ids: np.ndarray, total: int) -> int:
        t = bisect_left(self.tiers, len(ids))
        self.arrival += 1
        insort(self.pools[t], (len(ids), self.arrival, doc, start, ids, total), key=lambda p: p[:2])
        return t

    def add(self, doc, ids: np.ndarray):
        """Rows of the windows that this document completes."""
        top, n = self.tiers[-1], len(ids)
        whole = n - n % top
        for at in range(0, whole, top):
            yield from self._close(len(self.tiers) - 1, [(doc, at, ids[at : at + top], n)])
        if n > whole:
            t = self._wait(doc, whole, ids[whole:].copy(), n)
            if len(self.pools[t]) > self.waiting:
                yield from self._window(t)

    def _window(self, t: int):
        size, pool = self.tiers[t], self.pools[t]
        _, _, doc, start, ids, total = pool.pop()
        taken, gap = [(doc, start, ids, total)], size - len(ids)
        while gap:
            best = None
            for s in range(t, -1, -1):
                at = bisect_right(self.pools[s], gap, key=lambda p: p[0]) - 1
                if at >= 0:
                    best = (s, at)
                    break
            if best:
                _, _, doc, start, ids, total = self.pools[best[0]].pop(best[1])
                taken.append((doc, start, ids, total))
                gap -= len(ids)
                continue
            s = next((s for s in (*range(t, -1, -1), *range(t + 1, len(self.tiers))) if self.pools[s]), None)
            if s is None:
                break
            _, _, doc, start, ids, total = self.pools[s].pop()
            taken.append((doc, start, ids[:gap], total))
            self._wait(doc, start + gap, ids[gap:], total)
            gap = 0
        if not gap:
            yield from self._close(t, taken)
            return
        for bit in range(size.bit_length() - 1, -1, -1):
            want, part = (size - gap) & (1 << bit), []
            while want:
                doc, start, ids, total = taken.pop(0)
                part.append((doc, start, ids[:want], total))
                if len(ids) > want:
                    taken.insert(0, (doc, start + want, ids[want:], total))
                want -= len(part[-1][2])
            if part:
                yield from self._close(bisect_left(self.tiers, 1 << bit), part)

    def _close(self, t: int, pieces: list):
        """A sequence joins its tier's open steps; full steps are balanced by the attention cost of their pieces."""
        self.open[t].append((sum(len(p[2]) ** 2 for p in pieces), self.sequences, pieces))
        self.sequences += 1
        if len(self.open[t]) >= STEP_GROUPS * STEP_WINDOWS * self.tiers[-1] // self.tiers[t]:
            yield from self._deal(t)

    def _deal(self, t: int):
        each = STEP_WINDOWS * self.tiers[-1] // self.tiers[t]
        groups = -(-len(self.open[t]) // each)
        load, room = [0] * groups, [each] * groups
        for cost, sequence, pieces in sorted(self.open[t], key=lambda s: (-s[0], s[1])):
            g = min((g for g in range(groups) if room[g]), key=lambda g: (load[g], g))
            load[g] += cost
            room[g] -= 1
            offset = 0
            for doc, start, ids, total in pieces:
                yield doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset, self.tiers[t], self.steps + g, ids
                offset += len(ids)
        self.steps += groups
        self.open[t] = []

    def end(self):
        for t in range(len(self.tiers) - 1, -1, -1):
            while self.pools[t]:
                yield from self._window(t)
        for t in range(len(self.tiers)):
            if self.open[t]:
                yield from self._deal(t)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", eos: int = 1, tiers: tuple[int, ...] = TIERS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group, and
    ids with ``with_ids``.

    A document is its token ids and then ``eos``; a null text counts as empty, so that its one token is ``eos``.
    Every id lies in exactly one piece, pieces of a sequence follow each other without gaps, and the length of a
    sequence is a power of two, never above the last tier. Each partition is packed on its own as it streams by:
    ``sequence_id`` and ``step_group`` hold the partition's number in their upper bits, and memory holds a bounded
    number of waiting pieces. A task that runs again over the same rows in the same order, as tables in files give
    them, gives the same pieces; write the result of a shuffle before packing it. Repeated rows and ids are packed
    like others, a null id is kept; no rows give no rows; a very long text fills sequences of its own; other columns
    are not read.
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"] + ["ids"] * with_ids

    def run(batches):
        bpe, packer, base = byte_bpe(tokenizer_path), Packer(tiers), TaskContext.get().partitionId() << 40
        id_type = None
        end = np.array([eos], np.uint32)

        def frame(rows):
            cols = list(zip(*rows)) or [[]] * 10
            arrays = [pa.array(cols[0], id_type)] + [pa.array(c, pa.int64()) for c in cols[1:5]] + [pa.array([base + x for x in cols[5]], pa.int64()), pa.array(cols[6], pa.int64()), pa.array(cols[7], pa.int64()), pa.array([base + x for x in cols[8]], pa.int64())]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int64).tolist() for x in cols[9]], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, names)

        rows = []
        for batch in batches:
            id_type = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows.extend(packer.add(doc, np.concatenate([bpe.ids(text.as_py() or ""), end])))
                if len(rows) >= 4096:
                    yield frame(rows)
                    rows = []
        if id_type is not None:
            rows.extend(packer.end())
            if rows:
                yield frame(rows)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long" + ", ids array<long>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
