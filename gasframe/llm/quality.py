"""Quality rules: surface counts, and the divergence of a document's histograms from its language's reference."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gasframe.llm.common import let, space_words

#: Very common words by language (fixed values); a parameter of ``measure``.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "au"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"),
}
#: Character classes, each with the Java pattern of a run of it; what is left over is the last class.
CLASSES = (("lower", r"\p{Ll}+"), ("upper", r"\p{Lu}+"), ("digit", r"\p{Nd}+"), ("stop", r"[.,;:!?'\"()-]+"))
#: Usual shares in running prose, by language (fixed values, from general knowledge and not from any corpus here): of the
#: common words above, and of the character classes lower, upper, digit, stop, white space and the rest. Parameters.
WORD_SHARES = {
    "en": (0.060, 0.030, 0.028, 0.026, 0.020, 0.022, 0.011, 0.011, 0.010, 0.010, 0.008, 0.009, 0.008, 0.006, 0.006, 0.007),
    "de": (0.032, 0.034, 0.028, 0.019, 0.013, 0.011, 0.011, 0.011, 0.010, 0.008, 0.009, 0.008, 0.009, 0.008, 0.008, 0.009),
    "fr": (0.045, 0.028, 0.022, 0.022, 0.019, 0.016, 0.014, 0.012, 0.012, 0.011, 0.011, 0.010, 0.009, 0.009, 0.008, 0.007),
    "es": (0.055, 0.036, 0.029, 0.027, 0.026, 0.026, 0.020, 0.016, 0.013, 0.012, 0.011, 0.011, 0.010, 0.009, 0.010, 0.009),
}
CLASS_SHARES = {
    "en": (0.775, 0.025, 0.005, 0.027, 0.168, 0.0),
    "de": (0.768, 0.050, 0.005, 0.030, 0.147, 0.0),
    "fr": (0.780, 0.022, 0.005, 0.028, 0.165, 0.0),
    "es": (0.780, 0.022, 0.005, 0.028, 0.165, 0.0),
}
MIN_WORDS = 50
#: Jensen-Shannon distances (base 2, 0 to 1) beyond which a document is rejected. Texts of fewer than ``FULL_WORDS`` words
#: stray further by chance and have a wider limit on characters.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, MAX_SHORT_DISTANCE, FULL_WORDS = 0.18, 0.45, 0.32, 200


def _covered(positions: Column, k: int) -> Column:
    """Words in windows of k words that start at the given ascending positions."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, p: F.struct((a["n"] + p + k - F.greatest(p, a["end"])).alias("n"), (p + k).alias("end"))
    return F.aggregate(positions, start, step, lambda a: a["n"].cast("long"))


def _repeat_words(words: Column, n: Column, k: int = 3) -> Column:
    """Words in k-word windows that a text holds twice or more, by 64-bit hashes of windows; linear but for texts that
    do repeat a window, which sort them."""
    windows = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k)))))
    return F.when(n >= k, windows).otherwise(F.array().cast("array<bigint>"))


def _starts_of_repeats(windows: Column) -> Column:
    mark = lambda s: lambda i: F.when((F.get(s, i)["h"] == F.get(s, i - 1)["h"]) | (F.get(s, i)["h"] == F.get(s, i + 1)["h"]), F.get(s, i)["i"])
    marked = let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1), mark(s)))
    return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))


def _divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(p, q, lambda x, y: term(x, (x + y) / 2) + term(y, (x + y) / 2))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def measure(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: dict = COMMON_WORDS) -> DataFrame:
    """``docs`` as a struct ``row``, and a struct ``q``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, lang, and the histograms chars and commons (null for a language without a word list)."""
    text = F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    one = rows.select("row", F.lower(F.substring_index(F.col(f"row.`{lang_col}`").cast("string"), "-", 1)).alias("lang"), text.alias("text"), space_words(text).alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    wanted = sorted({w for ws in common.values() for w in ws})
    two = one.select(
        "row", "lang", "text", "words",
        F.size("words").alias("n"),
        lines.alias("lines"),
        F.filter(F.transform("words", lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?")))), lambda w: w.isin(wanted)).alias("hits"),
        *(F.length(F.regexp_replace("text", p, "")).alias(f"no_{c}") for c, p in CLASSES),
        F.length("text").alias("n_chars"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
    )
    three = two.select("row", "lang", "words", "hits", "n", "word_chars", "n_chars", *(f"no_{c}" for c, _ in CLASSES), F.size(F.regexp_extract_all("text", F.lit(r"([#*$%&|<>])"), 1)).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), _repeat_words(F.col("words"), F.col("n")).alias("windows"))
    repeats = F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("long")).otherwise(_covered(_starts_of_repeats(F.col("windows")), 3))
    four = three.withColumn("n_repeat_words", repeats)
    counted = [(F.col("n_chars") - F.col(f"no_{c}")).cast("double") for c, _ in CLASSES]
    spaces = (F.col("n_chars") - F.col("word_chars")).cast("double")
    rest = F.greatest(F.col("n_chars") - sum(counted[1:], counted[0]) - spaces, F.lit(0.0))

    def commons(words: tuple[str, ...]) -> Column:
        same = lambda w: lambda h: h == F.lit(w)
        counts = [F.size(F.filter(F.col("hits"), same(w))).cast("double") for w in words]
        return F.array(*counts, (F.col("n") - sum(counts[1:], counts[0])).cast("double"))

    by_lang = None
    for lang, words in common.items():
        by_lang = (F if by_lang is None else by_lang).when(F.col("lang") == lang, commons(words))
    failed = (F.col("n") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n"))
    q = F.struct(F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "lang", F.array(*counted, spaces, rest).alias("chars"), by_lang.alias("commons"))
    return four.select("row", q.alias("q"))


@dataclass(frozen=True)
class References:
    """By language: shares of the character classes, and of the words of ``COMMON_WORDS`` (the rest is any other
    word)."""

    classes: dict = field(default_factory=lambda: dict(CLASS_SHARES))
    words: dict = field(default_factory=lambda: dict(WORD_SHARES))


def fit_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> References:
    """References from a corpus that is known to be sound: the median share of each bin over the documents of each
    language with a word list that pass the base rules. An option; nothing here calls it."""
    sound = measure(docs, text_col, lang_col).where(~F.col("q.base_failed") & F.col("q.commons").isNotNull()).select("q.lang", _shares(F.col("q.chars")).alias("chars"), _shares(F.col("q.commons")).alias("commons"))
    middle = lambda c, n: F.array(*(F.percentile_approx(F.col(c)[i], 0.5, 1000) for i in range(n)))
    bins = len(next(iter(COMMON_WORDS.values())))
    rows = sound.groupBy("lang").agg(middle("chars", len(CLASSES) + 2).alias("chars"), middle("commons", bins).alias("commons")).collect()
    return References(CLASS_SHARES | {r.lang: tuple(r.chars) for r in rows}, WORD_SHARES | {r.lang: tuple(r.commons) for r in rows})


def quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", references: References | None = None, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE, max_short: float = MAX_SHORT_DISTANCE) -> DataFrame:
    """``docs`` (as the struct ``row``) with its measures (the struct ``q``), class_distance, word_distance and kept.

    Every text is measured whole, in one pass without a shuffle, and compared with the references of its language, so
    that a verdict depends on the document alone. A language is known by the letters before a hyphen, in either case.
    A document of a null or unknown language is compared with the characters of the nearest reference, and has no
    word_distance. A null or empty text fails and has no distances; a very long text takes time in proportion to its
    length, and n log n of it where it repeats a window. Rows are judged one by one, so that repeated rows stay
    repeated; no rows give no rows; columns that are not named are carried in ``row``, whatever their names.
    """
    refs = references or References()
    measured = measure(docs, text_col, lang_col).withColumn("shares", _shares(F.col("q.chars"))).withColumn("words", _shares(F.col("q.commons")))
    some = F.col("q.n_words") > 0
    bins = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    classes = {lang: _divergence(F.col("shares"), bins(x)) for lang, x in refs.classes.items()}
    words = {lang: _divergence(F.col("words"), bins((*x, max(0.0, 1 - sum(x))))) for lang, x in refs.words.items()}

    def of(distances: dict, other: Column) -> Column:
        out = F
        for lang, distance in distances.items():
            out = out.when(F.col("q.lang") == lang, distance)
        return out.otherwise(other)

    nearest = F.least(*classes.values()) if len(classes) > 1 else next(iter(classes.values()))
    far = measured.select("row", "q", F.when(some, of(classes, nearest)).alias("class_distance"), F.when(some, of(words, F.lit(None).cast("double"))).alias("word_distance"))
    strange = F.coalesce(F.col("class_distance") > F.when(F.col("q.n_words") < FULL_WORDS, max_short).otherwise(max_class), F.lit(False)) | F.coalesce(F.col("word_distance") > max_word, F.lit(False))
    done = far.withColumn("kept", ~F.col("q.base_failed") & ~strange)
    # A generator is no place that a filter on ``kept`` can be pushed through, which would measure each text again.
    return done.select("row", F.inline(F.array(F.struct("q", "class_distance", "word_distance", "kept"))))
