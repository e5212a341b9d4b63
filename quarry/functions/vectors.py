"""Vector expressions and the hashing embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z_]\w*|[^\s\w]"


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 for empty, unequal or zero vectors."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    return F.when((F.size(a) == F.size(b)) & (na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def hash_embed(df: DataFrame, id_col: str, text_col: str, dim: int = 256) -> DataFrame:
    """(id, embedding array<double>): signed token hashing, L2-normalised.

    Tokens are counted per text before anything is hashed; the dense vector is laid
    out per text, so the shuffle carries one row per text and used slot.
    """
    token = F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(f"({TOKEN})"), 1))
    counted = df.select(F.col(id_col).alias("_id"), token.alias("_t")).groupBy("_id", "_t").count()
    digest = F.sha2("_t", 256)
    slot = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dim).cast("int")
    sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)
    slots = counted.groupBy("_id", slot.alias("_slot")).agg(F.sum(sign * F.col("count")).cast("double").alias("_v"))
    per_id = slots.groupBy("_id").agg(
        F.map_from_entries(F.collect_list(F.struct("_slot", "_v"))).alias("_m"), F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("_n")
    )
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.when(F.col("_n") > 0, F.coalesce(F.element_at("_m", i), F.lit(0.0)) / F.col("_n")).otherwise(0.0),
    )
    return (
        df.select(F.col(id_col).alias("_id"))
        .join(per_id, "_id", "left")
        .select(F.col("_id").alias(id_col), F.coalesce(dense, F.array_repeat(F.lit(0.0), dim)).alias("embedding"))
    )
