"""Numbers and running totals within groups of any size: a group is many ranges, not one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.graph import cut


def running(rows: DataFrame, by: list[str], order: list[Column | str], value: Column | str | None = None) -> DataFrame:
    """Adds ``n``, the row's number in order within ``by`` from 1, and ``before``, the sum of ``value`` over earlier rows.

    Rows are dealt to ranges of (by, order) and stored; each range counts and sums its own,
    and takes over what earlier ranges of its group have. Rows that tie in ``order`` are
    numbered as they come, so an order should end in a key.
    """
    own = F.lit(0) if value is None else (F.col(value) if isinstance(value, str) else value)
    ordered = cut(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()).withColumn("_value", own))
    here = Window.partitionBy("_range", *by).orderBy(*order)
    local = ordered.withColumn("n", F.row_number().over(here)).withColumn(
        "before", F.coalesce(F.sum("_value").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    sizes = ordered.groupBy("_range", *by).agg(F.count("*").alias("_rows"), F.coalesce(F.sum("_value"), F.lit(0)).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select(
        F.col("_range").alias("_r"), *(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_s0"),
    )
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return local.join(start, same).select(*rows.columns, (F.col("n") + F.col("_n0")).alias("n"), (F.col("before") + F.col("_s0")).alias("before"))


def over_last(rows: DataFrame, by: str, at: Column, span: int, value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of ``by`` whose time ``at`` lies up to ``span`` before the row's, its own included.

    Rows meet in bins of ``span`` and stand in the next one as well, so a group is as many tasks as bins.
    """
    placed = rows.withColumn("_at", at).withColumn("_own", F.floor(F.col("_at") / span))
    both = placed.withColumn("_bin", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    w = Window.partitionBy(by, "_bin").orderBy("_at").rangeBetween(-span, 0)
    return both.withColumn(name, F.sum(value).over(w)).filter(F.col("_bin") == F.col("_own")).drop("_at", "_own", "_bin")
