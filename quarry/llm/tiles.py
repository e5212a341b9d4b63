"""Comparing all pairs inside blocks, tile by tile, without emitting the pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Groups of rows that agree in their first ``keys`` columns, from rows in that order."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if row[:keys] != key and held:
                yield held
                held = []
            key = row[:keys]
            held.append(row)
    if held:
        yield held


def place(blocks: DataFrame, tile: int) -> DataFrame:
    """(node, root) to (node, root, tiles, tile): blocks cut into tiles of about ``tile`` nodes by hash."""
    tiles = blocks.groupBy("root").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    return blocks.join(tiles, "root").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))


def pair_tiles(placed: DataFrame, payload: list[str]) -> DataFrame:
    """Rows (root, i, j, side, *payload), sorted: every pair of tiles of a block is one group."""
    both = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    keys = ["root", "i", "j"]
    return (
        both.select(
            "root",
            F.least("tile", "other").alias("i"),
            F.greatest("tile", "other").alias("j"),
            F.col("tile").alias("side"),
            *payload,
        )
        .repartition(*keys)
        .sortWithinPartitions(*keys)
    )


#: Rows gathered from small groups before they are handed on.
FLUSH = 10_000
LINKS = "v long, links long, a long, b long"


def count_links(pairs: Callable[[list[tuple], list[tuple]], Iterator[tuple[int, object]]]):
    """Batch function over ``pair_tiles`` rows (root, i, j, side, v, copies, data).

    ``pairs(first, second)`` yields (position, linked later positions) over the rows
    of both tiles; ``second`` is empty if they are one. Returned are each class's
    linked rows and the links that join classes, at most one less than there are.
    """

    def links_of(rows: list[tuple]) -> Iterator[tuple]:
        same = rows[0][1] == rows[0][2]
        first = [r[4:] for r in rows if same or r[3] == r[1]]
        second = [] if same else [r[4:] for r in rows if r[3] == r[2]]
        every = first + second
        if len(every) < 2 or not same and not (first and second):
            return
        copies = [r[1] for r in every]
        degree = [0] * len(every)
        root = list(range(len(every)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for i, hits in pairs(first, second):
            for j in hits.tolist():
                degree[i] += copies[j]
                degree[j] += copies[i]
                x, y = find(i), find(j)
                if x != y:
                    root[y] = x
                    yield None, None, every[i][0], every[j][0]
        for r, d in zip(every, degree):
            if d:
                yield r[0], d, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], ["v", "links", "a", "b"])

        held: list[tuple] = []
        for rows in grouped(batches, 3):
            held.extend(links_of(rows))
            if len(held) >= FLUSH:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    return run
