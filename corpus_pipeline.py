"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gasframe.llm import decontaminate, packing, pii, quality, simhash
from gasframe.llm.common import written
from gasframe.llm.queries import _table, _tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep.

    Each row is judged by its own text and language: null, empty and short texts go, a null or unknown language is
    compared with the nearest reference, and equal rows stay or go together. Columns pass as they are, whatever their
    names; an empty table stays empty; a very long text is judged whole.
    """
    return quality.quality(docs).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of documents that share 80 % of their five-word shingles.

    The one with the smallest id stays, and of several rows with that id one. Null and empty texts have the same, empty,
    set of shingles, a text of fewer words has one shingle. A row without an id stays only if its component has no row
    with one. Columns pass as they are; an empty table stays empty.
    """
    return simhash.keep_one(docs, similarity=0.8, k=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item.

    Null and empty texts hold none and stay; equal rows stay or go together; of a very long text any place counts.
    Items of fewer than five words prove no leak, and items without a word match nothing. Columns pass as they are;
    an empty table stays empty, and an empty benchmark keeps all rows.
    """
    return decontaminate.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sanitised; n_chars follows the text.

    A null text stays null with a null n_chars, an empty one empty; equal rows get equal texts; a null id is an id like
    another. Other columns pass as they are; an empty table stays empty.
    """
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    A null or empty text is one token, its end; a very long one fills sequences of its own; repeated rows are packed
    each; an empty table gives no pieces. Columns but id and text are not read.
    """
    return packing.pack(docs, _tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("pack_sequences", pack_sequences),
]

#: No stage but for parts of the first can be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is written and read again by the next."""
    docs = _table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
