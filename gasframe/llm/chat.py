"""Preference formatting: one prompt for the turns that a chosen and a rejected conversation share, and two
completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gasframe.llm.common import let

#: How a turn is written: before the role, between role and text, after the text, and between turns.
OPEN, HEAD, CLOSE, BETWEEN = "<|im_start|>", "\n", "<|im_end|>", "\n"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    """``text`` with each ``<|`` written ``<||``, so that no turn can hold a mark; the way back is one-to-one."""
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(HEAD), t["text"], F.lit(CLOSE + BETWEEN))), "")


def _mask(turns: Column, trained: str) -> Column:
    """(start, end) of the code points that carry loss: text and close mark of each trained turn."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + len(OPEN) + F.length(t["role"]) + len(HEAD)
        end = start + F.length(t["text"]) + len(CLOSE)
        out = F.when(t["role"] == trained, F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(a["out"])
        return F.struct((end + len(BETWEEN)).alias("at"), out.alias("out"))

    return F.aggregate(turns, zero, step, lambda a: a["out"])


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair_col: str = "pair_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = TRAINED) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask for each pair with a turn on either
    side.

    The prompt is the longest common prefix of turns (equal role and text), written once; chosen and rejected are the
    turns that follow it, and their masks the spans of code points that carry loss. Marks inside a role or text are
    escaped (``escaped``), a line feed in a role is a space. A side without turns has an empty completion. Turns go by
    number, then role and text, which settles ties; a turn given twice counts twice. A null role is ``unknown``, a
    null text empty, a turn without a number comes first, and a turn without a pair belongs to none. Very long texts are
    kept whole; extra columns are not read; no turns give no rows. One shuffle, by pair; what is gathered is one pair
    of conversations.
    """
    one = lambda d, side: d.where(F.col(pair_col).isNotNull()).select(F.col(pair_col).alias("pair_id"), F.lit(side).alias("side"), F.col(turn_col).alias("turn"), F.translate(escaped(F.coalesce(F.col(role_col).cast("string"), F.lit("unknown"))), "\n", " ").alias("role"), escaped(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    both = one(chosen, 0).union(one(rejected, 1)).groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("side", "turn", "role", "text"))).alias("ts"))
    sides = both.select("pair_id", F.filter("ts", lambda t: t["side"] == 0).alias("c"), F.filter("ts", lambda t: t["side"] == 1).alias("r"))
    same = lambda i: (F.get(F.col("c"), i)["role"] == F.get(F.col("r"), i)["role"]) & (F.get(F.col("c"), i)["text"] == F.get(F.col("r"), i)["text"])
    least = F.least(F.size("c"), F.size("r"))
    places = F.when(least > 0, F.sequence(F.lit(0), least - 1)).otherwise(F.array().cast("array<int>"))
    cut = sides.withColumn("n", F.coalesce(F.array_min(F.filter(places, lambda i: ~same(i))), least))
    rest = lambda c: F.slice(F.col(c), F.col("n") + 1, F.size(c))
    parts = cut.select("pair_id", "n", F.slice("c", 1, F.col("n")).alias("p"), F.when(F.size("c") > 0, rest("c")).otherwise(F.col("c")).alias("c"), F.when(F.size("r") > 0, rest("r")).otherwise(F.col("r")).alias("r"))
    return parts.select("pair_id", F.col("n").cast("long").alias("n_prompt_turns"), _rendered(F.col("p")).alias("prompt"), _rendered(F.col("c")).alias("chosen"), _rendered(F.col("r")).alias("rejected"), _mask(F.col("c"), trained).alias("chosen_mask"), _mask(F.col("r"), trained).alias("rejected_mask"))


def logged_preferences(turns: DataFrame, id_col: str = "conv_id", trained: str = TRAINED) -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) turns for logged conversations, with the column pair_id.

    Chosen is a conversation up to its last reply, the one of the highest turn number, and of several with that
    number the one whose text is last in order. Rejected has in place of that one reply a stale one: the last reply
    of a lower number, or for want of one the last question of a lower number, or nothing. A conversation without a
    numbered reply is the same on both sides; a turn without a conversation belongs to none.
    """
    w = Window.partitionBy(id_col)
    reply = F.col("role") == trained
    own = turns.where(F.col(id_col).isNotNull()).select(id_col, "turn", "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    numbered = F.coalesce(reply, F.lit(False)) & F.col("turn").isNotNull()
    first = F.row_number().over(w.orderBy(numbered.desc(), F.col("turn").desc(), F.col("text").desc()))
    marked = own.withColumn("swap", numbered & (first == 1)).withColumn("last", F.max(F.when(numbered, F.col("turn"))).over(w))
    before = lambda cond: F.max(F.when(cond & (F.col("turn") < F.col("last")), F.struct("turn", "text"))).over(w)["text"]
    marked = marked.withColumn("stale", F.coalesce(before(reply), before(F.col("role") == "user"), F.lit("")))
    upto = marked.where(F.col("last").isNull() | F.col("turn").isNull() | (F.col("turn") <= F.col("last")))
    swap = F.when(F.col("swap"), F.col("stale")).otherwise(F.col("text"))
    out = lambda text: upto.select(F.col(id_col).alias("pair_id"), "turn", "role", text.alias("text"))
    return out(F.col("text")), out(swap)


def joined(mask: Column) -> Column:
    """``start:end`` of each span, comma-joined."""
    return let(mask, lambda m: F.array_join(F.transform(m, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ","))
