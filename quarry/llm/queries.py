"""The ``opN_<name>`` queries over the provided tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import cut, hashed, scratch, table
from quarry.llm.embedding_dedup import embedding_dedup
from quarry.llm.html_extract import extract_main
from quarry.llm.line_rules import line_rules
from quarry.llm.mixing import mix_sources
from quarry.llm.ngram_join import ngram_join
from quarry.llm.oracles import ORACLE_SQL
from quarry.llm.ordinal import Model, grade_texts, train
from quarry.llm.piece_codec import digests, encode_decode
from quarry.llm.shards import ShardStore
from quarry.llm.substring_dedup import substring_dedup
from quarry.llm.token_counts import token_counts


#: Arrivals that the sharding query splits ``documents`` into, by hash of the id.
ARRIVALS = 4


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append ``documents`` in arrivals, compact, and tell where each row lies."""
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, scratch(spark, "shards"), keep_versions=1)
    store.append_parts(docs, F.pmod(hashed("doc_id", seed=1), F.lit(ARRIVALS)))
    store.compact()
    store.vacuum(grace_seconds=0)
    manifest = store.manifest()
    entries = spark.createDataFrame(
        [(s.path, i, s.level, s.rows, s.bytes) for i, s in enumerate(manifest.shards)],
        "shard string, shard_id int, level int, shard_rows long, shard_bytes long",
    )
    placed = cut(
        store.located(["doc_id", "n_chars"])
        .join(entries, "shard")
        .select("doc_id", "n_chars", "shard_id", "level", "shard_rows", "shard_bytes", F.lit(manifest.version).alias("version"))
    )
    store.drop()  # its answer is stored; no one else reads it
    return placed


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digests(encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).drop("_row")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(table(spark, sf_dir, "documents"))


def rating() -> Column:
    """Graded rating of a labelled document: one point for quality, one for not being toxic."""
    return F.col("quality") + 1 - F.col("toxic")


def quality_model(docs: DataFrame, labels: DataFrame) -> Model:
    return train(docs, labels, rating(), 3)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return grade_texts(docs.select("doc_id", "text"), model).drop("text")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_ngram_join": op5_ngram_join,
    "op6_mixing": op6_mixing,
    "op7_html_extraction": op7_html_extraction,
    "op8_quality_rules": op8_quality_rules,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_token_counts": op10_token_counts,
}
