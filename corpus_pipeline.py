"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept
and returns a DataFrame; it is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``; other columns are left
out. An empty table gives an empty result at every stage, very long texts are taken
whole, and null in ``lang``, ``source`` or ``n_chars`` stays as it is.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import cut, drop, scratch, table
from quarry.llm.mixing import mix_sources
from quarry.llm.ngram_join import keep_one
from quarry.llm.ordinal import grade_texts
from quarry.llm.piece_codec import encode_decode
from quarry.llm.queries import quality_model
from quarry.llm.substring_dedup import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier expects in the top grade.

    A text without a word (null, empty, blank) is rejected. Equal rows are judged alike;
    ids don't matter but to find the labelled rows.
    """
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return grade_texts(docs, model).filter("kept").select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a stored number per row: ids may be null or repeat."""
    return cut(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_n")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram similarity links: its smallest id.

    Rows without id, and different texts under one id, are documents of their own; of
    equal rows one stays; a text without a word links with nothing and stays.
    """
    return keep_one(docs.select(*COLUMNS))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that an earlier document holds; emptied documents go.

    A text that loses nothing stays as it is, of others the kept words are joined by one
    blank. A text without a word goes. A null id comes last; rows that share an id don't
    cut each other.
    """
    spans = substring_dedup(docs, keep=("text", "lang", "source"))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    return (
        spans.select("doc_id", text.alias("text"), "lang", "source", "n_words", "n_removed")
        .filter("n_words > n_removed")
        .select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    )


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, twice at most.

    Every row counts on its own, whatever its id; a null source is a source; a text
    without a word is never taken.
    """
    docs = numbered(docs)
    taken = mix_sources(docs, keep=("_n",)).filter("times > 0").select("_n", "times")
    return (
        docs.join(taken, "_n")
        .select(*COLUMNS, F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("_copy"))
        .select(*COLUMNS)
    )


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row, its end id included; a null text has the end id alone."""
    ids = encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded=False)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("mixing to target weights", mixture),
    ("SentencePiece encoding", encoded),
]

#: SQL can't express the classifier, the join or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the table ``documents``; a stage's table goes once the next one stands."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            drop(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
