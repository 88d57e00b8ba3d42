"""Information-theoretic sanitisation: personal data, and the terms around it that give it away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gasframe.llm.common import checked_broadcast, let, written

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive repeats and the look-behinds skip only starts that cannot match, so that matches are
#: those of the plain patterns, found in linear time and without recursion.
_EMAIL = r"((?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)"
_IP = r"((?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++)"
_CARD = r"([0-9](?:[ -]?[0-9])++)"
_PHONE = r"(\+[0-9][ ().0-9-]+[0-9])"
PATTERNS = dict(zip(KINDS, (_EMAIL, _IP, _CARD, _PHONE)))
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Text that must occur for a pattern to match at all.
_NEEDS = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){13}"), "phone": lambda t: t.contains("+")}
#: The letters of a term.
TERM = r"(\p{L}{3,})"
#: A character, no letter, that stands for the letters of spans where terms are sought.
_BLOT = "\ue000"
#: Matches whose places are summed together, and spans that are replaced together.
_BLOCK = 256
#: Different texts that must show a term and an entity before their co-occurrence counts, and the probability at most
#: that they would meet as often by chance.
MIN_TEXTS, MAX_CHANCE = 2, 1e-3
#: Mentions from which an entity counts as hot: more than one in so many, so that there are no more of them than this.
HOT_SHARE = 10_000
#: Shares of the entity's information from which a term is generalised, and removed.
GENERALISE, REMOVE = 0.75, 0.9
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "drop": ""}


def _located(text: Column, pattern: str) -> Column:
    """Structs (start, end, value) of the leftmost non-overlapping matches, in code points.

    Positions are running sums of the lengths of the gaps and matches, taken in blocks of ``_BLOCK`` matches, so that
    the work stays close to linear for texts with very many.
    """
    kind = "array<struct<start:int,end:int,value:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + F.length(p["gap"])
        end = start + F.length(p["value"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value")))).alias("out"))

    def shifted(a: Column):
        return lambda m: F.struct((m["start"] + a["at"]).alias("start"), (m["end"] + a["at"]).alias("end"), m["value"].alias("value"))

    def place(gaps: Column, found: Column) -> Column:
        both = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
        blocks = let(both, lambda ps: F.transform(F.sequence(F.lit(0), (F.size(ps) / _BLOCK).cast("int")), lambda i: F.aggregate(F.slice(ps, i * _BLOCK + 1, _BLOCK), zero, step)))
        return F.aggregate(blocks, zero, lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["out"], F.transform(x["out"], shifted(a))).alias("out")), lambda a: a["out"])

    return place(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 1))


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes Luhn's check."""

    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _sound(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        return v.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), let(digits, _luhn)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Sorted array of structs (start, rank, end, kind, value) of the base matches in a text."""
    found = []
    for rank, kind in enumerate(KINDS):
        sound = F.filter(_located(text, PATTERNS[kind]), _check(kind))
        structs = F.transform(sound, _span(rank, kind))
        found.append(F.when(_NEEDS[kind](text), structs).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")))
    return F.sort_array(F.concat(*found))


def _check(kind: str):
    return lambda m: _sound(kind, m["value"])


def _span(rank: int, kind: str):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _rewritten(text: Column, spans: Column, label) -> Column:
    """``text`` with each of the sorted ``spans`` replaced by ``label(span, over)``, where so many letters of the span lie
    in spans before it.

    Spans go in blocks of ``_BLOCK``, each with its own part of the text, so that a span costs what its block is long.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / _BLOCK).cast("int")), lambda i: F.slice(spans, i * _BLOCK + 1, _BLOCK))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("out"))

    def bound(a: Column, own: Column) -> Column:
        to = F.greatest(a["at"], F.array_max(F.transform(own, lambda s: s["end"])))
        return F.struct(to.alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("from"), to.alias("to")))).alias("out"))

    def part(own: Column, ends: Column) -> Column:
        def cut(body: Column) -> Column:
            def step(a: Column, s: Column) -> Column:
                between = F.substring(body, a["at"] - ends["from"] + 1, s["start"] - a["at"])
                over = F.greatest(a["at"] - s["start"], F.lit(0))
                return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], between, label(s, over)).alias("out"))

            return F.aggregate(own, F.struct(ends["from"].alias("at"), F.lit("").alias("out")), step, lambda a: a["out"])

        return let(F.substring(text, ends["from"] + 1, ends["to"] - ends["from"]), cut)

    def whole(bs: Column) -> Column:
        def join(ends: Column) -> Column:
            rest = F.substring(text, F.element_at(ends, -1)["to"] + 1, F.length(text))
            return F.concat(F.array_join(F.zip_with(bs, ends, part), ""), rest)

        return let(F.aggregate(bs, none, bound, lambda a: a["out"]), join)

    return F.when(F.size(spans) == 0, text).otherwise(let(blocks, whole))


def _terms(text: Column, spans: Column) -> Column:
    """The terms of a text (lower-cased, with their places) outside every base span: the letters of spans are blotted
    out, and runs of letters that touch a blot are none."""
    free = lambda w: ~F.exists(spans, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"]))
    blotted = _rewritten(text, spans, lambda s, over: F.regexp_replace(F.substring(s["value"], over + 1, F.length(s["value"])), r"\p{L}", _BLOT))
    found = F.when(text.contains(_BLOT), F.filter(_located(text, TERM), free)).otherwise(let(blotted, lambda t: _located(t, rf"(?<![\p{{L}}{_BLOT}])(\p{{L}}{{3,}}+)(?!{_BLOT})")))
    return F.transform(found, lambda w: F.struct(F.lower(w["value"]).alias("term"), w["start"].alias("start"), w["end"].alias("end")))


def entities_of(span: Column) -> Column:
    """The entities that a base span names: the value itself (numbers by their digits); the group it belongs to: an
    address's domain, an IP address's first three parts, a card's issuer (six digits), a phone number's exchange (all
    but the last four digits); and its kind."""
    kind, low = span["kind"], F.lower(span["value"])
    digits = F.regexp_replace(low, "[^0-9]", "")
    name = F.when(kind.isin("card", "phone"), digits).otherwise(low)
    group = F.when(kind == "email", F.substring_index(low, "@", -1)).when(kind == "ip", F.substring_index(low, ".", 3)).when(kind == "card", F.left(digits, F.lit(6))).otherwise(F.left(digits, F.length(digits) - 4))
    return F.array(F.concat(kind, F.lit(":"), name), F.concat(kind, F.lit("/"), group), kind)


def _rows(docs: DataFrame, id_col: str, text_col: str, extra: list[str]) -> DataFrame:
    """Each row with its base spans; two hashes, of id and text and of the text, stand for the document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    carried = [F.struct(*[docs[f"`{c}`"] for c in extra]).alias("row")] if extra else []
    one = docs.select(*carried, F.col(id_col).alias("doc_id"), text.alias("text"))
    return one.withColumns({"base": base_spans(F.col("text")), "doc": F.xxhash64("doc_id", "text"), "key": F.xxhash64("text")})


def _protected(hit: DataFrame, min_texts: int) -> DataFrame:
    """(doc, key, entity, n_e) of the entities of ``min_texts`` (one or two) different texts or more, with the number
    of their documents. Entities of the same documents are one, named by a hash of these, so that a list of addresses
    in copies does not multiply the terms beside it."""
    named = written(hit.select("doc", "key", F.explode(F.array_distinct(F.flatten(F.transform("base", entities_of)))).alias("entity")).distinct(), "named")
    place = F.xxhash64("doc", "key")
    many = named.groupBy("entity").agg(F.count("*").alias("n_e"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.bit_xor(place).alias("x"), F.sum(F.pmod(place, F.lit(1_000_000_007))).alias("s"))
    live = many.where((F.col("lo") != F.col("hi")) | F.lit(min_texts < 2)).select("entity", "n_e", F.xxhash64("n_e", "x", "s").alias("class"))
    live = written(live, "live")
    few = checked_broadcast(live)
    if few is not live:
        held = named.join(few, "entity")
    else:
        # Kinds and large groups, of which there are few, stay out of the shuffle.
        limit = named.count() / HOT_SHARE
        hot, cold = live.where(F.col("n_e") > limit), live.where(F.col("n_e") <= limit)
        held = named.join(F.broadcast(hot), "entity").select("doc", "key", "class", "n_e")
        rest = named.join(F.broadcast(hot.select("entity")), "entity", "left_anti")
        held = held.union(rest.join(cold, "entity").select("doc", "key", "class", "n_e"))
    return held.select("doc", "key", F.col("class").alias("entity"), "n_e").distinct()


def disclosing_terms(mentions: DataFrame, terms: DataFrame, docs: DataFrame, text_col: str = "text", min_texts: int = MIN_TEXTS, threshold: float = GENERALISE, max_chance: float = MAX_CHANCE) -> DataFrame:
    """(entity, term, disclosure): how much of an entity's information a term gives away, where it is ``threshold``
    or more.

    ``mentions`` has a row (doc, key, entity, n_e) per entity of a document, ``terms`` a row (doc, key, term) per
    term of a document that mentions any. Probabilities are document frequencies over all of ``docs``: an entity's
    information is log(N / n(e)), the point-wise mutual information log(N n(e,t) / (n(e) n(t))), and disclosure their
    quotient, 1 if the term occurs in documents of the entity only. A pair counts if ``min_texts`` (one or two)
    different texts show it, so that the rare words of one text and its copies do not count, and if chance would
    bring entity and term together as often with probability ``max_chance`` at most (a bound of the Poisson tail). An
    entity that all documents mention has no information to give away. A term meets an entity in as many documents at
    most as it meets any, and as mention the entity; that bounds disclosure from above, and pairs whose bound is too
    low are never made.
    """
    total = F.lit(float(docs.count()))
    info = F.log2(total / F.col("n_e"))
    several = (F.col("lo") != F.col("hi")) | F.lit(min_texts < 2)
    mutual = lambda joint: F.log2(total * joint / (F.col("n_e") * F.col("n_t")))
    beside = terms.groupBy("term").agg(F.count("*").alias("n_beside"), F.min("key").alias("lo"), F.max("key").alias("hi")).where(several).drop("lo", "hi")
    beside = written(beside, "beside")
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), r"[^\p{L}]+"))).alias("term"))
    hashes = written(beside.select(F.xxhash64("term").alias("h")), "hashes")
    few = checked_broadcast(hashes)
    counted = words if few is hashes else words.join(few, F.xxhash64("term") == F.col("h"), "left_semi")
    # Of all entities, one of as many documents as the term meets any in would be disclosed most.
    best = F.log2(total / F.col("n_t")) >= threshold * F.log2(total / F.col("n_beside")) - 1e-9
    known = written(counted.groupBy("term").agg(F.count("*").alias("n_t")).join(beside, "term").where(best), "known")
    bound = mutual(F.least("n_beside", "n_e")) >= threshold * info - 1e-9
    pairs = terms.join(checked_broadcast(known), "term").join(checked_broadcast(mentions), ["doc", "key"]).where((info > 0) & bound)
    joint = pairs.groupBy("entity", "term").agg(F.count("*").alias("joint"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"), F.min("key").alias("lo"), F.max("key").alias("hi")).where(several)
    scored = joint.withColumn("disclosure", F.least(mutual(F.col("joint")) / info, F.lit(1.0)))
    chance = F.pow(F.lit(2.718281828459045) * F.col("n_e") * F.col("n_t") / (total * F.col("joint")), F.col("joint"))
    return scored.where((F.col("disclosure") >= threshold) & (chance <= max_chance)).select("entity", "term", "disclosure")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, generalise: float = GENERALISE, remove: float = REMOVE, min_texts: int = MIN_TEXTS, max_chance: float = MAX_CHANCE) -> DataFrame:
    """Per row of ``docs``: doc_id, base (the base spans) and spans (all spans, by start and kind), as arrays of structs
    (start, rank, end, kind, value); with ``carry`` also the input row and the text.

    Base spans are e-mail addresses, IP addresses, card numbers and phone numbers; the method adds ``term`` spans
    (generalised) and ``drop`` spans (removed): all occurrences, in the documents that mention a protected entity (a
    value, its group or its kind, ``entities_of``), of the terms that disclose it, outside base spans.
    A null text counts as empty. Equal rows get equal results; a null id is an id like another; columns that are not
    named are carried or left out, whatever their names. An empty table gives an empty table. Texts are never cut: a
    very long one costs what its matches and its distinct terms cost.
    """
    rows = _rows(docs, id_col, text_col, docs.columns if carry else [])
    hit = written(_rows(docs, id_col, text_col, []).where(F.size("base") > 0).select("doc", "key", "text", "base"), "hits")
    if not hit.groupBy("doc", "key").count().where("count > 1").isEmpty():
        hit = written(hit.dropDuplicates(["doc", "key"]), "hits")
    mentions = written(_protected(hit, min_texts), "mentions")
    named = checked_broadcast(written(mentions.select("doc", "key").distinct(), "mentioning"))
    word = F.array_distinct(F.transform(_terms(F.col("text"), F.col("base")), lambda w: w["term"]))
    terms = written(hit.join(named, ["doc", "key"], "left_semi").select("doc", "key", F.explode(word).alias("term")), "mentioned")
    flagged = written(disclosing_terms(mentions, terms, docs, text_col, min_texts, generalise, max_chance), "flagged")
    some = written(flagged.select("term").distinct(), "some")
    shown = terms.join(checked_broadcast(some), "term").join(checked_broadcast(mentions), ["doc", "key"]).join(checked_broadcast(flagged), ["entity", "term"])
    shown = written(shown.groupBy("doc", "key", "term").agg(F.max("disclosure").alias("disclosure")), "shown")
    changed = checked_broadcast(written(shown.select("doc", "key").distinct(), "changed"))
    places = hit.join(changed, ["doc", "key"], "left_semi").select("doc", "key", F.explode(_terms(F.col("text"), F.col("base"))).alias("w")).select("doc", "key", "w.*")
    kind = F.when(F.col("disclosure") >= remove, "drop").otherwise("term")
    spans = F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", kind.alias("kind"), F.col("term").alias("value"))
    added = written(places.join(shown, ["doc", "key", "term"]).groupBy("doc", "key").agg(F.collect_list(spans).alias("added")), "added")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")
    out = [*(["row", "text"] if carry else []), "doc_id", "base"]
    if not added.count():
        return rows.select(*out, F.col("base").alias("spans"))
    return rows.join(checked_broadcast(added), ["doc", "key"], "left").select(*out, F.sort_array(F.concat("base", F.coalesce("added", none))).alias("spans"))


def sanitised(text: Column, spans: Column, labels: dict = LABELS) -> Column:
    """``text`` with each span replaced by its kind's label. Of spans that overlap, the first stands; the part of a
    later one that reaches beyond it goes with it."""
    label = lambda s: F.coalesce(*(F.when(s["kind"] == k, F.lit(v)) for k, v in labels.items()))
    return _rewritten(text, spans, lambda s, over: F.when(over > 0, F.lit("")).otherwise(label(s)))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: float) -> DataFrame:
    """``docs`` with the same columns and rows, personal data in ``text_col`` replaced by labels, and the terms that
    disclose it generalised or removed. A null text stays null."""
    found = find(docs, id_col, text_col, carry=True, **limits)
    clean = F.when(F.col(f"row.`{text_col}`").isNotNull(), sanitised(F.col("text"), F.col("spans")))
    return found.select(*(clean.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
