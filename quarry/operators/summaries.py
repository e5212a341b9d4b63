"""Counts, rates, choices and lists over findings, runs, calls and corpora."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import seeds
from quarry.functions.text import tokens


def counts(rows: DataFrame, by: str, name: str = "n") -> DataFrame:
    """(by, name): rows per value; null is a value."""
    return rows.groupBy(by).agg(F.count("*").alias(name))


def totals(rows: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    """One row: how many rows pass each named test."""
    return rows.agg(*(F.count_if(test).alias(name) for name, test in tests.items()))


def coverage(scoped: DataFrame, analysed: DataFrame, key: str, by: str, flag: Column) -> DataFrame:
    """(by, scoped, analysed, flagged): of the scoped rows those with an analysis, and those it flags."""
    held = analysed.withColumnRenamed(key, "_key").withColumn("_flag", flag)
    both = scoped.select(key, by).join(held, F.col(key) == F.col("_key"), "left")
    return both.groupBy(by).agg(F.count("*").alias("scoped"), F.count("_key").alias("analysed"), F.count_if("_flag").alias("flagged"))


def usage(calls: DataFrame, model: str, text: str) -> DataFrame:
    """(model, calls, tokens): calls per model and the estimate of their tokens."""
    return calls.groupBy(F.col(model).alias("model")).agg(F.count("*").alias("calls"), F.sum(tokens(F.col(text))).cast("long").alias("tokens"))


def latency(calls: DataFrame, by: str, value: str, digits: int = 6) -> DataFrame:
    """(by, latency): the mean."""
    return calls.groupBy(by).agg(F.round(F.avg(value), digits).alias("latency"))


def app_type(files: DataFrame, project: str, kind: Column, order: list[str] = seeds.APP_ORDER) -> DataFrame:
    """(project, app_type): of the kinds a project's files point to the first in ``order``."""
    place = F.array_position(F.array(*map(F.lit, order)), kind)
    return files.groupBy(project).agg(F.min_by(kind, place).alias("app_type"))


def value_sets(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """(by, name): the distinct values of each group, sorted."""
    return rows.groupBy(by).agg(F.array_sort(F.collect_set(value)).alias(name))


def longest_sample(rows: DataFrame, key: str, text: str, rows_limit: int = 15, chars: int = 8000) -> DataFrame:
    """One row ``sample``: the longest texts, longest first, joined by line feeds and cut to ``chars``.

    The limits are the feature: a sample that fits a prompt.
    """
    top = rows.select(key, text, F.length(text).alias("_n")).orderBy(F.desc("_n"), key).limit(rows_limit)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("_k"), key, text))), lambda x: x[text])
    return top.agg(F.substring(F.array_join(ordered, "\n"), 1, chars).alias("sample"))


def first_rows(rows: DataFrame, order: list[Column | str], limit: int) -> DataFrame:
    """The first rows in order: inventories and newest runs."""
    return rows.orderBy(*order).limit(limit)


def missing(rows: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the kept."""
    return rows.join(kept.select(key), key, "left_anti")


def tasks_by_tier(tasks: DataFrame, tier: str, key: str) -> DataFrame:
    """(tier, n, first_task)."""
    return tasks.groupBy(F.col(tier).alias("tier")).agg(F.count("*").alias("n"), F.min(key).alias("first_task"))


def adjacency(edges: DataFrame, kind: str) -> DataFrame:
    """(id, n, first): per node the distinct nodes its edges of one type lead to, and the smallest."""
    steps = edges.filter(F.col("type") == kind).select("src", "dst").distinct()
    return steps.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.min("dst").alias("first"))


def with_status(rows: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """Rows whose status is one of ``wanted``."""
    return rows.filter(F.col(column).isin(wanted))


def sink_counts(chunks: DataFrame, languages: DataFrame) -> DataFrame:
    """``chunks`` with ``sinks``: how many sink patterns their language defines; 0 without a definition."""
    sizes = languages.select(F.col("id").alias("language"), F.size("sink_patterns").alias("_sinks"))
    return chunks.join(sizes, "language", "left").withColumn("sinks", F.coalesce("_sinks", F.lit(0))).drop("_sinks")


def content_hash(c: Column) -> Column:
    """SHA-256 of a text, lower-case hexadecimal."""
    return F.sha2(c, 256)
