"""Exact and near deduplication, neighbours and caches over embeddings."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.graph import cut


def exact_dedup(rows: DataFrame, digest: str, order: str, protected: Column | None = None) -> DataFrame:
    """First row of each digest; protected rows always stay and register their digest too.

    The first is found by partial aggregation, so a digest with very many rows is one
    row per task before anything meets.
    """
    first = rows.groupBy(F.col(digest).alias("_d")).agg(F.min(order).alias("_first"))
    keep = F.col(order) == F.col("_first")
    if protected is not None:
        keep = keep | protected
    return rows.join(first, F.col(digest) == F.col("_d")).filter(keep).drop("_d", "_first")


def sign_codes(vectors: DataFrame, tables: int, bits: int, key: str = "id", vector: str = "embedding", seed: int = 1) -> DataFrame:
    """(key, table, code): random-hyperplane codes."""

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = None
        for batch in batches:
            if not len(batch):
                continue
            x = np.array([np.asarray(v, np.float64) for v in batch["v"]])
            if planes is None:
                planes = np.random.Generator(np.random.PCG64(seed)).standard_normal((tables, x.shape[1], bits))
            for t in range(tables):
                c = ((x @ planes[t]) > 0) @ (1 << np.arange(bits, dtype=np.int64))
                yield pd.DataFrame({"key": batch["key"], "table": t, "code": c})

    return vectors.select(F.col(key).alias("key"), F.col(vector).alias("v")).mapInPandas(
        code, f"key {dict(vectors.dtypes)[key]}, table int, code long"
    )


#: Vectors of a bucket that are compared within one group.
TILE = 512


def near_pairs(
    vectors: DataFrame, threshold: float, *, recall: float = 0.9999, per_bucket: int = 64, key: str = "id", vector: str = "embedding"
) -> DataFrame:
    """(a, b, sim) with a < b and cosine > threshold, between the first rows of equal vectors.

    Codes are as long as buckets of about ``per_bucket`` rows take, and as many as a pair at
    the threshold needs to share one with probability ``recall``. Buckets are cut into
    tiles, and every pair of tiles is one task's group that returns near pairs alone.
    ``copies_of`` gives the rows that equal vectors leave out.
    """
    heads = cut(vectors.groupBy(F.col(vector).alias("v")).agg(F.min(key).alias("key")))
    n = max(heads.count(), 1)
    bits = min(40, max(2, math.ceil(math.log2(n / per_bucket)))) if n > per_bucket else 0
    same = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - same))) if same < 1 else 1
    codes = cut(sign_codes(heads, tables, bits, "key", "v"))
    tiles = codes.groupBy("table", "code").agg(F.count("*").alias("_n")).filter("_n > 1").select("table", "code", F.ceil(F.col("_n") / TILE).cast("int").alias("tiles"))
    placed = codes.join(tiles, ["table", "code"]).withColumn("tile", F.pmod(F.xxhash64("key", "table"), "tiles").cast("int"))
    both = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    grouped = both.select("table", "code", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), F.col("tile").alias("side"), "key").join(heads, "key")
    kind = dict(heads.dtypes)["key"]

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        x, keys, side = _unit(rows["v"]), rows["key"].to_numpy(dtype=object), rows["side"].to_numpy()
        near = x @ x.T
        hit = np.triu(near > threshold, 1)
        if rows["i"].iloc[0] != rows["j"].iloc[0]:
            hit &= side[:, None] != side[None, :]
        p, q = np.nonzero(hit)
        return pd.DataFrame({"a": np.minimum(keys[p], keys[q]), "b": np.maximum(keys[p], keys[q]), "sim": near[p, q]})

    found = grouped.groupBy("table", "code", "i", "j").applyInPandas(score, f"a {kind}, b {kind}, sim double")
    return found.groupBy("a", "b").agg(F.max("sim").alias("sim"))


def copies_of(vectors: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(key, head): rows whose vector an earlier row, ``head``, has as well."""
    heads = vectors.groupBy(F.col(vector).alias("_v")).agg(F.min(key).alias("head"))
    return vectors.join(heads, F.col(vector) == F.col("_v")).filter(F.col(key) > F.col("head")).select(key, "head")


def near_dedup(vectors: DataFrame, threshold: float, key: str = "id", vector: str = "embedding", **how) -> DataFrame:
    """Rows that stay if each, in order of ``key``, is dropped when near to one kept before it.

    A copy goes with the first row of its vector: either that stays, or both are near to
    the row that drops it.
    """
    pairs = near_pairs(vectors, threshold, key=key, vector=vector, **how)
    firsts = vectors.join(copies_of(vectors, key, vector), key, "left_anti")
    return greedy_dedup(firsts, pairs, key)


def greedy_dedup(rows: DataFrame, pairs: DataFrame, order: str) -> DataFrame:
    """Rows that stay if each, in order, is dropped when near to one kept before it.

    ``pairs`` (a, b) name rows by ``order``. A round decides all rows whose earlier
    neighbours are all decided; the first undecided row is always one, so the rounds end,
    after as many as the longest such chain.
    """
    edges = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    undecided = cut(edges.select(F.col("b").alias("k")).distinct())
    dropped = undecided.limit(0)
    while not undecided.isEmpty():
        kept_before = edges.join(undecided.withColumnRenamed("k", "a"), "a", "left_anti").join(dropped.withColumnRenamed("k", "a"), "a", "left_anti")
        out = undecided.join(kept_before.select(F.col("b").alias("k")).distinct(), "k", "left_semi")
        open_before = edges.join(undecided.withColumnRenamed("k", "a"), "a", "left_semi").select(F.col("b").alias("k")).distinct()
        stay = undecided.join(out, "k", "left_anti").join(open_before, "k", "left_anti")
        dropped = cut(dropped.union(out))
        undecided = cut(undecided.join(out, "k", "left_anti").join(stay, "k", "left_anti"))
    return rows.join(dropped.withColumnRenamed("k", order), order, "left_anti")


#: Queries and rows that meet in one group, and queries that are scored at a time.
BLOCK, STRETCH, STEP = 32_768, 65_536, 256


def _unit(values: pd.Series) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in values])
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def in_blocks(queries: DataFrame, rows: DataFrame, score, schema: str, key: str = "id", vector: str = "embedding") -> DataFrame:
    """``score(query frame, row frame)`` over every pair of a query block and a stretch of rows.

    A stated query set against all rows: queries fall into blocks of about ``BLOCK``,
    rows into stretches of about ``STRETCH``, both by hash, and each pair of them is
    one bounded group; neither side is collected or broadcast. ``score`` takes ``STEP``
    queries at a time.
    """
    blocks = max(1, -(-queries.count() // BLOCK))
    stretches = max(1, -(-rows.count() // STRETCH))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(F.col(key).alias("key"), F.col(vector).alias("v")).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("stretch", number(stretches))
    r = rows.select(F.col(key).alias("key"), F.col(vector).alias("v")).withColumn("stretch", F.pmod(F.xxhash64("key"), F.lit(stretches)).cast("int")).withColumn("block", number(blocks))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return score(a, b) if len(a) and len(b) else score(a.head(0), b.head(0))

    return q.groupBy("block", "stretch").cogroup(r.groupBy("block", "stretch")).applyInPandas(run, schema)


def rescue_similar(rows: DataFrame, queries: DataFrame, threshold: float, cap: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, score): the ``cap`` rows most similar to any other row's query, at least ``threshold``; for query sets of any size."""
    kind = dict(rows.dtypes)[key]

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        best, x, own = np.full(len(b), -2.0), _unit(b["v"]) if len(b) else None, b["key"].to_numpy()
        for at in range(0, len(a) if len(b) else 0, STEP):
            part = a.iloc[at : at + STEP]
            s = _unit(part["v"]) @ x.T
            s[part["key"].to_numpy()[:, None] == own[None, :]] = -2.0  # no row answers for itself
            best = np.maximum(best, s.max(axis=0))
        return pd.DataFrame({key: b["key"].to_numpy(dtype=object), "score": best})

    each = in_blocks(queries, rows, score, f"{key} {kind}, score double", key, vector)
    return each.groupBy(key).agg(F.max("score").alias("score")).filter(F.col("score") >= threshold).orderBy(F.desc("score"), key).limit(cap)


def neighbours(seeds: DataFrame, rows: DataFrame, threshold: float, k: int, key: str = "id", vector: str = "embedding", *, among_seeds: bool = False) -> DataFrame:
    """(id, seed, sim): per seed its ``k`` nearest other rows at ``threshold`` or more; a row keeps its best seed.

    Rows that are seeds themselves are left out unless ``among_seeds``. A group returns at
    most ``k`` rows per seed (more only where they tie) before the final choice.
    """
    kind = dict(rows.dtypes)[key]

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({key: [], "seed": [], "sim": []}, dtype=object)
        x, ids, own, out = _unit(b["v"]), b["key"].to_numpy(dtype=object), b["key"].to_numpy(), []
        for at in range(0, len(a), STEP):
            part = a.iloc[at : at + STEP]
            s = _unit(part["v"]) @ x.T
            s[part["key"].to_numpy()[:, None] == own[None, :]] = -2.0
            floor = np.maximum(threshold, np.partition(s, -k, axis=1)[:, -k]) if s.shape[1] > k else np.full(len(part), threshold)
            seed, row = np.nonzero(s >= floor[:, None])
            out.append(pd.DataFrame({key: ids[row], "seed": part["key"].to_numpy(dtype=object)[seed], "sim": s[seed, row]}))
        return pd.concat(out)

    others = rows if among_seeds else rows.join(seeds.select(key), key, "left_anti")
    each = in_blocks(seeds, others, score, f"{key} {kind}, seed {kind}, sim double", key, vector)
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("sim"), key))
    top = each.withColumn("_r", rank).filter(F.col("_r") <= k)
    best = Window.partitionBy(key).orderBy(F.desc("sim"), "seed")
    return top.withColumn("_b", F.row_number().over(best)).filter("_b = 1").select(key, "seed", "sim")


def cached_vectors(rows: DataFrame, cache: DataFrame, model: str, digest: str = "hash") -> tuple[DataFrame, DataFrame]:
    """(rows with a cached vector of this model, rows without); vectors are kept to 6 digits."""
    held = cache.filter(F.col("model") == model).select(F.col("key").alias(digest), F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))
    return rows.join(held, digest), rows.join(held.select(digest), digest, "left_anti")
