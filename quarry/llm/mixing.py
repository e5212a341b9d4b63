"""Mixing sources to target weights by subset-sum budget fitting.

Sources in code-point order (null last) take the weights in turn and share
``share`` times all words; a target stops at ``cap`` times its source's words and
the excess is shared again by weight. A source takes its whole documents
``target // size`` times over; the remaining budget is fitted on counts of
documents by exact length: in proportion to the counts but for a last stretch of a
few longest documents, which a bounded-knapsack dynamic programme fits over the
documents still left. Which documents of a length are taken is decided by a seeded hash.

Defined results: a null text has size 0; documents of size 0 take nothing; null is
a source of its own; equal rows count each on their own; reruns agree because all
choices depend on ids and the seed alone, between equal hashes on ids, between equal
ids on none but the number of them; very long texts are counted whole; an empty table
gives an empty result; columns with clashing names don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, cut, hashed
from quarry.operators.ranges import running

#: Longest documents' worth of words that the dynamic programme fits.
RESERVE = 4

#: Documents of one source and length are ranked within this many hash ranges.
RANGES_BITS = 10


def level(sizes: DataFrame, share: float, cap: float) -> float:
    """Words per weight at which the sources (_size, _weight) below their cap share what the others leave.

    A source is above its cap where the level passes ``cap * size / weight``; the level
    only rises as more are, so it settles. The driver sees three sums a round.
    """
    above = F.lit(float(cap)) * F.col("_size") / F.col("_weight")
    now = -1.0
    while True:
        got = sizes.agg(
            F.sum("_size").alias("all"),
            F.coalesce(F.sum(F.when(above < now, F.col("_size"))), F.lit(0)).alias("full"),
            F.sum(F.when(above >= now, F.col("_weight"))).alias("open"),
        ).first()
        if not got["open"]:
            return math.inf if got["all"] is not None else 0.0
        after = max(share * got["all"] - cap * got["full"], 0.0) / got["open"]
        if after <= now:
            return now
        now = after


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(_key, _source_size, _target) from (_key, _size): the words each source should contribute.

    Sources are numbered over ranges of their names and never leave Spark, however many there are.
    """
    order = [(F.col("_key") == "").alias("_null"), F.col("_key")]
    numbered = running(sizes, [], order)
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("n") - 1) % len(weights)).cast("int"))
    weighed = cut(numbered.select("_key", "_size", weight.alias("_weight")))
    top = level(weighed, share, cap)
    own = F.lit(float(cap)) * F.col("_size")
    goal = own if math.isinf(top) else F.least(own, F.lit(top) * F.col("_weight"))
    return weighed.select("_key", F.col("_size").alias("_source_size"), goal.alias("_target"))


def subset_sum(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length come nearest to ``budget`` from below: a bounded-knapsack programme."""
    taken = np.zeros_like(counts)
    items: list[tuple[int, int]] = []  # (index, how many): powers of two, so that any number is a sum
    for i in np.argsort(-lengths, kind="stable").tolist():
        left, k = min(int(counts[i]), budget // int(lengths[i])), 1
        while left > 0:
            items.append((i, min(k, left)))
            left -= k
            k *= 2
    items.sort(key=lambda x: x[1] * int(lengths[x[0]]), reverse=True)
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    first = np.full(budget + 1, -1, np.int32)  # the item with which a sum was reached first
    for j, (i, k) in enumerate(items):
        if reach[budget]:
            break
        step = int(lengths[i]) * k
        new = np.zeros_like(reach)
        new[step:] = reach[: budget + 1 - step]
        new &= ~reach
        first[new] = j
        reach |= new
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, k = items[first[at]]
        taken[i] += k
        at -= int(lengths[i]) * k
    return taken


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come to ``budget``, never above it.

    All but the last ``RESERVE`` longest documents' worth of the budget goes to the
    lengths in proportion to their words; what a length can't use is handed to the next
    shorter one. The programme fits what remains on all documents that are left. Its
    size depends on the longest document alone, never on how many there are.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = np.zeros_like(counts)
    if budget <= 0:
        return taken
    aim, due, spent = max(0, budget - RESERVE * int(lengths.max())), 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n, length = int(counts[i]), int(lengths[i])
        due += n * length
        taken[i] = min(n, (aim * due // total - spent) // length)
        spent += int(taken[i]) * length
    return taken + subset_sum(lengths, counts - taken, budget - spent)


def mix_sources(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, size, source_size, target, taken, times, *keep) per row of ``docs``.

    The driver sees a few sums; the fit of a source sees one row per distinct length. Documents are only ever dealt by (source, length,
    hash range), so one source or length that holds a third of them is split.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    sized = cut(
        docs.select(
            F.col(id_col).alias("_id"),
            key.alias("_key"),
            F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
            F.shiftrightunsigned(hashed(F.col(id_col), seed=seed), 64 - RANGES_BITS).cast("int").alias("_range"),
            hashed(F.col(id_col), seed=seed).alias("_hash"),
            *(F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)),
        )
    )
    by_range = sized.groupBy("_key", "_size", "_range").agg(F.count("*").alias("_n"))
    by_length = by_range.groupBy("_key", "_size").agg(F.sum("_n").alias("_n"))
    sizes = sized.groupBy("_key").agg(F.sum("_size").alias("_size"))
    full = F.when(F.col("_source_size") > 0, F.least(F.floor(F.col("_target") / F.col("_source_size")), F.lit(int(cap)))).otherwise(0)
    goals = cut(
        targets(sizes, weights, share, cap)
        .withColumn("_full", full.cast("int"))
        .withColumn("_rest", F.rint("_target").cast("long") - F.col("_full") * F.col("_source_size"))
    )

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        lengths, counts = group["_size"].to_numpy(), group["_n"].to_numpy()
        return group[["_key", "_size"]].assign(_x=fit(lengths, counts, int(group["_rest"].iloc[0])))

    x = (
        by_length.filter("_size > 0")
        .join(goals.filter("_rest > 0").select("_key", "_rest"), "_key")
        .groupBy("_key")
        .applyInPandas(plan, "_key string, _size long, _x long")
    )
    before = Window.partitionBy("_key", "_size").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    due = (
        by_range.join(x.filter("_x > 0"), ["_key", "_size"])
        .select("_key", "_size", "_range", (F.col("_x") - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_due"))
        .filter("_due > 0")
    )
    rank = F.row_number().over(Window.partitionBy("_key", "_size", "_range").orderBy("_hash", "_id"))
    chosen = (rank <= F.coalesce(F.col("_due"), F.lit(0))).cast("int")
    out = sized.join(due, ["_key", "_size", "_range"], "left").withColumn("_chosen", chosen).join(goals, "_key")
    times = F.when(F.col("_size") > 0, F.col("_full") + F.col("_chosen")).otherwise(F.lit(0))
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * times).alias("taken"),
        times.alias("times"),
        *(F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)),
    )
