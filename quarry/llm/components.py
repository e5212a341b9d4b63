"""Connected components of an edge table by alternating star contractions.

Large-star links every larger neighbour of a node to the smallest node around it,
small-star every smaller one; the two in turn leave one star per component after
about log(n) rounds. Groups are only ever reduced to their minimum (partial
aggregation) and joined back by an equi-join that Spark may split, so a node with
very many neighbours is no task of its own. Every round is cut to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut


def _tidy(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) with a > b."""
    return edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return _tidy(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _tidy(moved.union(least.select("a", F.col("m").alias("b"))))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node of the component; only nodes with an edge.

    ``edges`` has two columns of one orderable type. Ends when a round changes nothing.
    """
    a, b = edges.columns
    now = cut(_tidy(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))))
    seen = None
    for _ in range(max_rounds):
        now = cut(_small(_large(now)))
        state = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.hash("b", "a").cast("long"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
