"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gasframe.llm import chat, decontaminate, filter_audit, html_text, licenses, packing, pii, quality, quality_model, simhash, spelling, substrings, token_counts


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), of("term").alias("n_term"), of("drop").alias("n_drop"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.format_preferences(*chat.logged_preferences(_table(spark, sf_dir, "conversations")))
    return out.withColumns({c: chat.joined(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), F.size("lost").cast("long").alias("n_removed"), F.array_join(F.col("lost").cast("array<string>"), ",").alias("removed"), F.length("clean").cast("long").alias("clean_chars"), F.sha2("clean", 256).alias("clean_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def _labels(c: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(c)), ",")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(_table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"].cast("long"))
    base, more = F.transform("places", lambda p: p["label"]), F.transform("found", lambda p: p["label"])
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda p: p["coverage"])), F.lit(0.0)))
    return out.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), _labels(base).alias("base_labels"), _labels(F.concat(base, more)).alias("labels"), score.alias("score"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("at").alias("at_word"), F.round("cosine", 4).alias("cosine"), F.round("share", 4).alias("share"), "kind")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(_table(spark, sf_dir, "pages"))
    return out.select("page_id", F.length("text").cast("long").alias("n_chars"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"), "text")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return out.select(F.col("row.doc_id").alias("doc_id"), *(f"q.{c}" for c in cols), "kept", F.round("class_distance", 4).alias("class_distance"), F.round("word_distance", 4).alias("word_distance"))


def op11_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_chat, op3_simhash, op4_substrings, op5_token_counts, op6_licenses, op7_decontaminate, op8_packing, op9_html, op10_quality, op11_quality_model, op12_spelling, op13_filter_audit)}

_OP2 = """
WITH t AS (SELECT conv_id AS pair_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, coalesce(role = 'assistant', false) AND turn IS NOT NULL AS reply FROM t),
k AS (SELECT *, reply AND row_number() OVER (PARTITION BY pair_id ORDER BY reply DESC, turn DESC NULLS LAST, text DESC) = 1 AS swap, max(turn) FILTER (WHERE reply) OVER (PARTITION BY pair_id) AS last FROM o),
stale AS (SELECT pair_id, coalesce((max({'n': turn, 'x': text}) FILTER (WHERE role = 'assistant')).x, (max({'n': turn, 'x': text}) FILTER (WHERE role = 'user')).x, '') AS stale FROM k WHERE turn < last GROUP BY 1),
upto AS (SELECT pair_id, turn, swap, replace(replace(coalesce(role, 'unknown'), '<|', '<||'), chr(10), ' ') AS role, replace(text, '<|', '<||') AS text, replace(coalesce(stale, ''), '<|', '<||') AS stale
  FROM k LEFT JOIN stale USING (pair_id) WHERE last IS NULL OR turn IS NULL OR turn <= last),
c AS (SELECT pair_id, role, text, row_number() OVER (PARTITION BY pair_id ORDER BY turn NULLS FIRST, role, text) AS i FROM upto),
r AS (SELECT pair_id, role, CASE WHEN swap THEN stale ELSE text END AS text, row_number() OVER (PARTITION BY pair_id ORDER BY turn NULLS FIRST, role, CASE WHEN swap THEN stale ELSE text END) AS i FROM upto),
n AS (SELECT c.pair_id, coalesce(min(c.i) FILTER (WHERE c.role <> r.role OR c.text <> r.text) - 1, max(c.i)) AS n FROM c JOIN r ON c.pair_id = r.pair_id AND c.i = r.i GROUP BY 1),
both_sides AS (SELECT 'c' AS side, c.* FROM c UNION ALL SELECT 'r', r.* FROM r),
placed AS (SELECT side, b.pair_id, b.i, n.n, role, text, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line FROM both_sides b JOIN n USING (pair_id)),
ends AS (SELECT *, sum(length(line)) OVER (PARTITION BY side, pair_id, i > n ORDER BY i) AS stop FROM placed),
s AS (SELECT side, pair_id, any_value(n) AS n, coalesce(string_agg(line, '' ORDER BY i) FILTER (WHERE i <= n), '') AS prompt, coalesce(string_agg(line, '' ORDER BY i) FILTER (WHERE i > n), '') AS body,
  coalesce(string_agg((stop - 11 - length(text)) || ':' || (stop - 1), ',' ORDER BY i) FILTER (WHERE i > n AND role = 'assistant'), '') AS mask FROM ends GROUP BY 1, 2)
SELECT c.pair_id, CAST(c.n AS BIGINT) AS n_prompt_turns, c.prompt, c.body AS chosen, r.body AS rejected, c.mask AS chosen_mask, r.mask AS rejected_mask
FROM s c JOIN s r USING (pair_id) WHERE c.side = 'c' AND r.side = 'r'
"""

_SPACES = " \\t\\n\\x0B\\f\\r"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Sentences by number, spans of three that are not blank (or of both of two), and what is left without the later of equal ones.
_OP4 = f"""
WITH s AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?][{_SPACES}]+|\\n[{_SPACES}]*)', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ss FROM documents),
w AS (SELECT doc_id, unnest(range(len(ss))) AS i, unnest(ss) AS raw FROM s),
f AS (SELECT doc_id, i, trim(lower(raw), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM w),
g AS (SELECT doc_id, i, x, row_number() OVER d AS k, count(*) OVER (PARTITION BY doc_id) AS n, lead(x) OVER d AS x1, lead(x, 2) OVER d AS x2, lead(i) OVER d AS i1, lead(i, 2) OVER d AS i2 FROM f WHERE x <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, x, x1, coalesce(x2, '') AS x2, n = 2 AS two, CASE WHEN n = 2 THEN i1 ELSE i2 END AS last FROM g WHERE n > 1 AND k <= n - least(n, 3) + 1),
o AS (SELECT *, row_number() OVER (PARTITION BY two, x, x1, x2 ORDER BY doc_id, i) AS place FROM r),
l AS (SELECT doc_id, list_sort(list_distinct(flatten(list(range(i, last + 1))))) AS lost FROM o WHERE place > 1 GROUP BY 1),
c AS (SELECT doc_id, text, coalesce(lost, []) AS lost, CASE WHEN lost IS NULL THEN text ELSE array_to_string(list_filter(ss, lambda x, i: NOT list_contains(lost, i - 1)), '') END AS clean FROM s LEFT JOIN l USING (doc_id))
SELECT doc_id, len(lost)::BIGINT AS n_removed, array_to_string(lost, ',') AS removed, length(clean)::BIGINT AS clean_chars, sha256(clean) AS clean_sha256 FROM c
"""


def _op6() -> str:
    """Matches of template places, diagonals, runs of neighbouring diagonals, and coverage."""
    places = licenses._places(licenses.PHRASES, licenses.TEMPLATES, licenses.K)
    rows = ", ".join(f"({t}, '{label}', {exact}, {grams}, {place}, '{gram}')" for t, label, exact, grams, place, gram in places)
    return f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOW}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
t(t, label, exact, grams, place, gram) AS (VALUES {rows}),
g AS (SELECT doc_id, pos, w[pos + 1] || ' ' || w[pos + 2] || ' ' || w[pos + 3] AS gram FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS pos FROM d)),
h AS (SELECT doc_id, t, any_value(label) AS label, bool_or(exact) AS exact, any_value(grams) AS grams, pos - place AS diagonal, list(DISTINCT place) AS places FROM g JOIN t USING (gram) GROUP BY doc_id, t, pos - place),
a AS (SELECT *, CASE WHEN NOT exact AND diagonal - lag(diagonal) OVER o <= {licenses.NEIGHBOURS} THEN 0 ELSE 1 END AS apart FROM h WINDOW o AS (PARTITION BY doc_id, t ORDER BY diagonal)),
n AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS run FROM a),
m AS (SELECT doc_id, t, any_value(label) AS label, bool_or(exact) AS exact, any_value(grams) AS grams, min(diagonal + list_min(places)) AS start, len(list_distinct(flatten(list(places)))) AS held FROM n GROUP BY doc_id, t, run),
b AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS labels FROM m WHERE exact AND held = grams GROUP BY 1),
f AS (SELECT doc_id, list(DISTINCT label) AS labels, max(held / grams) AS coverage FROM m WHERE NOT exact AND held >= {licenses.MIN_COVERAGE} * grams GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(coverage, 0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id)
"""


def _op10() -> str:
    """Counts, repeated windows by row number, histograms, and their distances to the references."""
    classes = ", ".join(f"('{lang}', {list(x)})" for lang, x in quality.CLASS_SHARES.items())
    words = ", ".join(f"('{lang}', {list(quality.COMMON_WORDS[lang])}, {[*x, 1 - sum(x)]})" for lang, x in quality.WORD_SHARES.items())
    cut = lambda p: f"(length(text) - length(regexp_replace(text, '{p}', '', 'g')))"
    counts = [cut(p.replace("'", "''")) for _, p in quality.CLASSES]
    side = lambda p, q: f"CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END"
    far = lambda p, q: f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: {side('z[1]', 'z[2]')} + {side('z[2]', 'z[1]')})) / 2, 0))"
    return f"""
WITH c(lang, cs) AS (VALUES {classes}), v(lang, vocabulary, vs) AS (VALUES {words}),
d AS (SELECT doc_id, lower(split_part(lang, '-', 1)) AS lang, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[{_SPACES}]+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT doc_id, i, x0, lead(x0) OVER o AS x1, lead(x0, 2) OVER o AS x2 FROM (SELECT doc_id, unnest(w) AS x0, unnest(range(len(w))) AS i FROM d) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x0, x1, x2) AS times FROM x WHERE x2 IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM g WHERE times > 1) GROUP BY 1),
m AS (SELECT doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {cut('[#*$%&|<>]')} AS n_symbols, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_SPACES}]')) AS lines, coalesce(r.n, 0) AS n_repeat_words,
  [{', '.join(counts)}, length(text) - length(array_to_string(w, '')), 0] AS held, length(text) AS n_chars, list_transform(w, lambda x: lower(rtrim(x, '.,;:!?'))) AS lw FROM d LEFT JOIN r USING (doc_id)),
p AS (SELECT *, list_transform(list_concat(held[1:5], [greatest(n_chars - list_sum(held), 0)]), lambda x: CASE WHEN n_chars > 0 THEN x / n_chars ELSE 0 END) AS cp, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
k AS (SELECT p.*, c.cs, v.vs, list_transform(vocabulary, lambda x: len(list_filter(lw, lambda y: y = x))) AS vn FROM p LEFT JOIN c USING (lang) LEFT JOIN v USING (lang)),
q AS (SELECT *, list_transform(list_concat(vn, [n_words - list_sum(vn)]), lambda x: x / n_words) AS vp FROM k),
z AS (SELECT *, CASE WHEN n_words > 0 THEN CASE WHEN cs IS NOT NULL THEN {far('cp', 'cs')} ELSE (SELECT min({far('q.cp', 'c.cs')}) FROM c) END END AS cd, CASE WHEN n_words > 0 AND vs IS NOT NULL THEN {far('vp', 'vs')} END AS wd FROM q)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(cd > CASE WHEN n_words < {quality.FULL_WORDS} THEN {quality.MAX_SHORT_DISTANCE} ELSE {quality.MAX_CLASS_DISTANCE} END, false) AND NOT coalesce(wd > {quality.MAX_WORD_DISTANCE}, false) AS kept, round(cd, 4) AS class_distance, round(wd, 4) AS word_distance FROM z
"""


def _op13() -> str:
    """Failures of each document, the first of each order, and counts by part, order and step."""
    orders = ", ".join(f"('{o}')" for o in filter_audit.ORDERS)
    return f"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[{_SPACES}]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY 1),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS t FROM d GROUP BY 1, 2),
o(filter_order) AS (VALUES {orders}),
s AS (SELECT *, filter_order[step] AS f, filter_order[:step - 1] AS before FROM o, range(1, 6) AS r(step)),
x AS (SELECT part, filter_order, step, n, g, t, contains(fails, f) AS failing, fails = f AS only_this, translate(fails, before, '') <> fails AS gone FROM m, s),
c AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, sum(CASE WHEN gone OR failing THEN 0 ELSE n END)::BIGINT AS kept, sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN failing AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN only_this THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN failing AND NOT gone THEN g ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN failing AND NOT gone THEN t ELSE 0 END)::BIGINT AS toxic_lost FROM x GROUP BY 1, 2, 3)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM c
"""


ORACLES = {"op2_chat": _OP2, "op4_substrings": _OP4, "op6_licenses": _op6(), "op10_quality": _op10(), "op13_filter_audit": _op13()}
