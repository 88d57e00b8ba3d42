"""Near-duplicate documents by SimHash fingerprints and one-wildcard segment variants."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gasframe.llm.common import checked_broadcast, connected_components, written

_CHUNK = 1 << 16
#: Bands and rows of the minima that propose pairs of similar shingle sets: two sets of Jaccard similarity 0.8 miss every
#: band with probability (1 - 0.8 ** 5) ** 32 = 3e-6.
BANDS, ROWS = 32, 5
_MIX = np.random.default_rng(11).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


#: Members of a bucket whose pairs are verified one by one.
CROWD = 64


def _simhash(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of the hashes of a text's shingles; zero if there is none."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        votes += _votes(hashes[at : at + _CHUNK])
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_of(data: bytes, k: int = 3) -> int:
    """The 64-bit SimHash of one UTF-8 text: A-Z lower-cased, words split at ASCII white space, k-word shingles."""
    words = data.lower().split()
    n = len(words)
    if not n:
        return 0
    if n < k:
        total, votes = 1, _votes(np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64))
    else:
        total, votes = n - k + 1, np.zeros(64, np.int64)
        for at in range(0, total, _CHUNK):
            part = words[at : at + _CHUNK + k - 1]
            shingles = map(b" ".join, zip(*(part[i:] for i in range(k))))
            votes += _votes(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(part) - k + 1))
    return int(np.packbits(2 * votes > total, bitorder="little").view("<u8")[0])


def _votes(h: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def shingle_set(data: bytes, k: int = 5) -> np.ndarray:
    """The distinct hashes of the k-word shingles of a text, ascending; the whole text is one if it has fewer words."""
    words = data.lower().split()
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)))) if len(words) >= k else [b" ".join(words)] if words else []
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64))


def set_print(data: bytes, k: int = 5) -> int:
    """One hash of a text's shingle set, the same for equal sets; zero if there is no word."""
    held = shingle_set(data, k)
    return xxhash.xxh64_intdigest(held.astype("<u8").tobytes()) if len(held) else 0


def _bands(held: np.ndarray) -> list[int]:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(held), 4096):
        least = np.minimum(least, (_MIX[0][:, None] * held[None, at : at + 4096] + _MIX[1][:, None]).min(axis=1))
    keys = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.astype("<u8").reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).astype(np.int64).tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, of=fingerprint_of) -> DataFrame:
    """(doc_id, fp) for each row of ``docs``; fp holds the 64 bits as a signed long. A null text counts as empty, and an
    empty text has fingerprint zero. Repeated rows give repeated rows."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            out = [of(t.as_py() or b"", k) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.array(out, np.uint64).astype(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _variants(fps: DataFrame) -> DataFrame:
    """64 keys a fingerprint: clear bit j, take the 32-bit segment that holds it, and tag it with j. Two segments share
    a key exactly if they differ in bit j at most."""
    masked = F.expr("fp & ~shiftleft(1L, j)")
    segment = F.when(F.col("j") < 32, masked.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(masked, 32))
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("j")).select("fp", F.expr("shiftleft(CAST(j AS BIGINT), 32)").bitwiseOR(segment).alias("key"))


def _near(m: Column, distance: int) -> Column:
    """The pairs of a sorted array of fingerprints that differ in ``distance`` bits at most."""
    later = lambda a, i: F.transform(F.filter(F.slice(m, i + 2, F.size(m)), lambda b: differing(a, b) <= distance), lambda b: F.struct(a.alias("a"), b.alias("b")))
    return F.flatten(F.transform(m, later))


def links(fps: DataFrame, distance: int = 2, crowd: int = CROWD) -> DataFrame:
    """(a, b) pairs of distinct fingerprints that connect all fingerprints within ``distance`` (2 or less) bits.

    Cut into two 32-bit segments, two fingerprints within two bits have a segment that differs by one bit at most, so
    that they share one of its one-wildcard variants. Variants are matched by equality: a count, a minimum, a maximum
    and an exclusive-or of each bucket name the members of buckets of two and three, larger ones list theirs, and the
    pairs of a bucket are verified. A bucket of more than ``crowd`` members is split before its members are listed:
    to the shared variant of one segment comes a one-bit variant of both, a fingerprint itself or with one bit
    turned. Two fingerprints within two bits share such a variant, and no more than 65 can, so that no bucket's pairs
    grow with its square; each of these links its fingerprints to the smallest. For ``distance`` 1, only variants
    that are fingerprints themselves link. By chance a key holds as many as it has fingerprints in 2 ** 31, 5 at 10
    ** 10 documents, so that only crowds of near copies are split.
    """
    if not 0 < distance <= 2:
        raise ValueError("distance must be 1 or 2")
    keys = _variants(fps)
    buckets = written(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.bit_xor("fp").alias("x")).where("n > 1"), "buckets")
    lo, hi, mid = F.col("lo"), F.col("hi"), F.col("x").bitwiseXOR(F.col("lo")).bitwiseXOR(F.col("hi"))
    two = buckets.where("n = 2").select(lo.alias("a"), hi.alias("b"))
    three = buckets.where("n = 3").select(F.explode(F.array(*(F.struct(p.alias("a"), q.alias("b")) for p, q in ((lo, hi), (lo, mid), (mid, hi))))).alias("p")).select("p.a", "p.b")
    few = two.union(three).where(differing(F.col("a"), F.col("b")) <= distance)
    more = written(buckets.where(f"n BETWEEN 4 AND {crowd}").select("key"), "more")
    listed = keys.join(checked_broadcast(more), "key", "left_semi").groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    pairs = few.union(listed.select(F.explode(_near(F.col("m"), distance)).alias("p")).select("p.a", "p.b"))
    hot = written(buckets.where(F.col("n") > crowd).select("key"), "hot")
    crowded = written(keys.join(checked_broadcast(hot), "key", "left_semi").select("fp").distinct(), "crowded")
    ball = crowded.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("j")).select("fp", F.expr("CASE WHEN j < 0 THEN fp ELSE fp ^ shiftleft(1L, j) END").alias("c"))
    stars = ball.groupBy("c").agg(F.array_sort(F.collect_list("fp")).alias("m")).where(F.size("m") > 1)
    if distance == 1:
        stars = stars.where(F.array_contains("m", F.col("c"))).select(F.col("c"), F.col("m"))
        spokes = stars.select(F.col("c").alias("a"), F.explode("m").alias("b")).where("a != b")
    else:
        spokes = stars.select(F.col("m")[0].alias("a"), F.explode(F.slice("m", 2, 65)).alias("b"))
    return pairs.union(spokes).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id for each row of ``docs``.

    component_id is the smallest doc_id that can be reached over links, the document's own included; it is null only if
    no document of the component has an id. Exact copies share one fingerprint and are linked without pairs. Columns of
    ``docs`` beyond the two named ones are not read. An empty table gives an empty table.
    """
    fps = written(fingerprints(docs, id_col, text_col, k), "fingerprints")
    heads = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "heads")
    return _grouped(fps, heads, connected_components(links(heads.select("fp"), distance)))


def _grouped(fps: DataFrame, heads: DataFrame, components: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of ``fps`` (doc_id, fp), with the ``components`` (node, root) of linked
    ones."""
    roots = written(components, "roots")
    linked = heads.join(roots, heads.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = written(linked, "linked")
    least = linked.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = written(linked.join(written(least, "least"), "root").select("fp", "component_id"), "components")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """As ``near_duplicates``, with documents linked whose sets of k-word shingles have that Jaccard similarity or
    more (0.8 at least; below, the bands propose fewer of the pairs).

    Equal sets are one node, with the SimHash of the set as its fingerprint. Fingerprints are linked as in
    ``near_duplicates``, by one-wildcard variants of their segments, equality on keys and differing bits, and the sets
    behind a link are compared by their shingles. Two bits reach few sets of similarity 0.8, which differ in three to
    eleven; so sets that share a band of minima are compared too: first those of a bucket with its most central one,
    which shares most bands. Then the sets of buckets that are not yet one component meet by
    their rarest shingles (``prefix_pairs``), which two sets that are alike must share, and not by their buckets, so that
    a crowd that has much in common, but less than asked for, makes no pairs for it. So the components are those of all
    proposed pairs. Null and empty texts have the empty set; a null id counts only where no other is in the component;
    equal rows are copies; extra columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batches):
        for batch in batches:
            rows = []
            for t in batch.column(2).cast(pa.binary()):
                held = shingle_set(t.as_py(), k)
                rows.append((xxhash.xxh64_intdigest(held.astype("<u8").tobytes()) if len(held) else 0, len(held), _bands(held) if len(held) else [], _simhash(held)))
            bits = lambda i: pa.array(np.array([x[i] for x in rows], np.uint64).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bits(0), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.list_(pa.int64())), bits(3)], ["doc_id", "tkey", "fp", "n", "bands", "sim"])

    def sets(batches):
        for batch in batches:
            held = [shingle_set(t.as_py(), k) for t in batch.column(0).cast(pa.binary())]
            fp = np.array([xxhash.xxh64_intdigest(x.astype("<u8").tobytes()) if len(x) else 0 for x in held], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(fp.astype(np.int64)), pa.array([x.astype(np.int64).tolist() for x in held], pa.list_(pa.int64()))], ["fp", "held"])

    signed = written(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tkey"), text.alias("text")).mapInArrow(sign, f"doc_id {kind}, tkey long, fp long, n long, bands array<bigint>, sim long"), "signed")
    heads = written(signed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("tkey").alias("tkey"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sim").alias("sim")), "heads")
    sims = written(heads.where("n > 0").groupBy("sim").agg(F.min("fp").alias("fp"), F.max("fp").alias("last")), "sims")
    of = lambda x: sims.select(F.col("sim").alias(x), F.col("fp").alias(f"fp_{x}"))
    linked = links(sims.select(F.col("sim").alias("fp"))).join(of("a"), "a").join(of("b"), "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
    same = heads.where("n > 0").select("sim", F.col("fp").alias("b")).join(sims.where("fp != last").select("sim", F.col("fp").alias("a")), "sim").where("a != b").select("a", "b")
    linked = written(linked.union(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "links")
    keys = heads.select("fp", "n", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    members = written(keys.join(buckets, "key").select("key", "fp", "n", "c"), "members")
    weight = written(members.groupBy("fp").agg(F.sum("c").alias("weight")), "weight")
    central = members.join(checked_broadcast(weight), "fp").groupBy("key").agg(F.max(F.struct("weight", "fp"))["fp"].alias("rep"))
    ends = members.select("fp").union(linked.select("a")).union(linked.select("b")).distinct()
    wanted = written(ends.join(heads, "fp").select("tkey"), "wanted")
    held = docs.select(text.alias("text")).join(checked_broadcast(wanted), F.xxhash64("text") == F.col("tkey"), "left_semi").select("text").mapInArrow(sets, "fp long, held array<bigint>")
    held = written(held.dropDuplicates(["fp"]), "sets")

    def alike(pairs: DataFrame) -> DataFrame:
        n = heads.select("fp", "n")
        near = pairs.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b").where(F.least("na", "nb") >= similarity * F.greatest("na", "nb"))
        both = near.join(held.toDF("a", "sa"), "a").join(held.toDF("b", "sb"), "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
        return both.where(F.col("common") >= similarity * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")

    with_rep = members.join(central, "key").where("fp != rep").select(F.least("fp", "rep").alias("a"), F.greatest("fp", "rep").alias("b")).distinct()
    first = written(alike(linked.union(with_rep).distinct()), "first")
    roots = written(connected_components(first), "first_roots")

    def mixed(x: DataFrame) -> DataFrame:
        return x.join(x.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key"), "key")

    placed = written(members.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", "n", F.coalesce("root", "fp").alias("root")), "placed")
    left = written(mixed(placed).select("fp", "n", "root").distinct(), "left")
    rest = written(prefix_pairs(left.join(held, "fp"), similarity), "pairs")
    ends = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    more = written(alike(rest).join(ends("a"), "a", "left").join(ends("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")), "rest")
    top = written(connected_components(more), "second_roots").toDF("root", "top")
    final = roots.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = top.join(roots.select(F.col("node").alias("root")), "root", "left_anti").toDF("node", "root")
    return _grouped(signed.select("doc_id", "fp"), heads.select("fp", "least"), final.union(alone))


def prefix_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of different roots among ``sets`` (fp, n, root, held: n hashes), all that can have that Jaccard
    similarity, and few others.

    Each set is ordered by how many of ``sets`` hold a hash, the rarest first. Two sets of sizes n <= m that are alike
    have s (n + m) / (1 + s) in common at least, and therefore one of the first n - 2 s n / (1 + s) + 1 of the smaller
    and of the first m - s m + 1 of the larger set. They meet by it, if their sizes allow, and if enough is left of both
    behind it. Sets that share a hash and have one root are not paired: at each hash, those of its commonest root meet
    only the others. What a set has alone fills its front, so that what all of a crowd share brings two sets together
    only if they can be alike or both have little of their own.
    """
    s = F.lit(similarity)
    tokens = sets.select("fp", "n", "root", F.explode("held").alias("h"))
    often = tokens.groupBy("h").agg(F.count("*").alias("c"), (F.min("root") != F.max("root")).alias("mixed"))
    ordered = tokens.join(often, "h").groupBy("fp", "n", "root").agg(F.sort_array(F.collect_list(F.struct("c", "h", "mixed"))).alias("m"))
    front = lambda share: (F.col("n") - F.ceil(share * F.col("n") - 1e-6) + 1).cast("int")
    first = ordered.select("fp", "n", "root", front(2 * s / (1 + s)).alias("short"), F.posexplode(F.slice("m", F.lit(1), front(s))))
    first = first.where("col.mixed").select("fp", "n", "root", (F.col("pos") < F.col("short")).alias("short"), (F.col("n") - F.col("pos")).alias("behind"), F.col("col.h").alias("h"))
    # Sizes in classes of a factor 1 / s: two sets that can be alike are in one class or in neighbouring ones.
    first = written(first.withColumn("size", F.floor(F.ln("n") / -F.ln(s)).cast("int")), "fronts")
    roots = first.groupBy("h", "root").agg(F.count("*").alias("c")).groupBy("h").agg(F.max(F.struct("c", "root"))["root"].alias("top"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
    roots = written(roots, "tops")
    known = first.join(roots, "h")
    side = lambda df, x: df.select("h", "size", "top", *(F.col(c).alias(f"{c}_{x}") for c in ("fp", "n", "root", "short", "behind")))
    others = known.where("root != top").withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)))
    once = (F.col("root_b") == F.col("top")) | (F.col("fp_a") < F.col("fp_b"))
    smaller = F.when(F.struct("n_a", "fp_a") < F.struct("n_b", "fp_b"), F.col("short_a")).otherwise(F.col("short_b"))
    want = s / (1 + s) * (F.col("n_a") + F.col("n_b")) - 1e-6
    able = (F.col("root_a") != F.col("root_b")) & once & smaller & (F.least("n_a", "n_b") >= s * F.greatest("n_a", "n_b") - 1e-6) & (F.least("behind_a", "behind_b") >= want)
    pairs = side(others, "a").join(side(known, "b").drop("top"), ["h", "size"]).where(able)
    return pairs.select(F.least("fp_a", "fp_b").alias("a"), F.greatest("fp_a", "fp_b").alias("b")).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, k: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the one with the smallest id. With ``similarity``, the
    components are those of ``similar_documents``, and else those of ``near_duplicates``.

    Rows that share an id and a component count as copies too; of these, one row stays. A row without an id stays only
    if its component has no row with an id, and then as one of several equal rows at most. Texts are not shuffled, but
    for rows whose id occurs more than once or is null.
    """
    near = near_duplicates(docs, id_col, text_col, k) if similarity is None else similar_documents(docs, id_col, text_col, k, similarity)
    found = written(near, "near")
    lost = written(found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct(), "lost")
    again = written(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("__id")), "again")
    key = F.col(id_col).eqNullSafe(F.col("__id"))
    if not again.count():
        return docs.join(checked_broadcast(lost), key, "left_anti")
    once = docs.join(checked_broadcast(lost.union(again).distinct()), key, "left_anti")
    rows = docs.join(checked_broadcast(again), key, "left_semi")
    own = fingerprints(rows.select(F.struct(*[rows[f"`{c}`"] for c in rows.columns]).alias("row"), F.col(text_col).alias("text")), "row", "text", k, fingerprint_of if similarity is None else set_print).select(F.col("doc_id").alias("row"), "fp")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id"), F.conv("fingerprint", 16, -10).cast("long").alias("__fp"), "component_id").distinct()
    good = own.join(kept, F.col(f"row.`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("fp") == F.col("__fp")))
    least = good.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone")).agg(F.min_by("row", F.xxhash64(F.col(f"row.`{text_col}`"))).alias("row"))
    return once.unionByName(least.select("row.*"))
