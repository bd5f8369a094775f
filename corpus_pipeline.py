"""The corpus pipeline: five stages over documents, each on all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of docs. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.language_id import UNKNOWN, fit, predict
from tidemark.llm.mixing import mix
from tidemark.llm.packing import pack
from tidemark.llm.similar_groups import keep_one
from tidemark.llm.substring_dedup import remove_repeats
from tidemark.plans.scratch import drop, scope, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a recognized language: with letters, and a best language that has over half of the likelihood.

    Rejects null and empty texts, texts without letters, and ties at half or less. Repeated rows and null ids stay as they are; an
    empty table (or one without labels) gives an empty one.
    """
    found = predict(docs, fit(docs), carry=True)
    said, score = found.columns[-2:]
    return found.where((F.col(said) != UNKNOWN) & (F.col(score) > 0.5)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of exact and near copies (five-word shingles, similarity of 0.8 or more).

    The smallest id stays; rows without id give way to one; repeated rows are copies; texts without words are one group; an
    empty table gives an empty one.
    """
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words under any window of 35 words that starts anywhere else; a document left without words goes.

    Null and blank texts go too; all places of a window go, first and repeated ones alike; null ids are rows like any other; an
    empty table gives an empty one. A text that loses nothing stays as it is, and n_chars follows the text.
    """
    left = remove_repeats(docs, window=35, rewrite=True)
    left = left.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of its source does: a row for each time.

    A null source is a source of its own; texts without words are taken never; rows of one id go together, whatever their
    texts; an empty table gives an empty one.
    """
    taken = mix(docs, carry=True)
    copies = taken.columns[-1]
    return taken.where(F.col(copies) > 0).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences of at most 4,096 tokens; a row for each piece.

    A null text is an empty one (its end id alone); repeated rows and null ids are packed like any other; longer texts are cut into
    pieces, none is dropped; an empty table gives no rows.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("mixed_sources", mixed_sources),
    ("packed", packed),
]

#: SQL cannot express suffix automata, similarity joins or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's own scratch tables go when it is written, its output when the next one is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before = docs
        with scope() as keep:
            docs = keep(written(stage(spark, before, sf_dir), f"stage-{name}"))
        if i:
            drop(before)
    return docs
