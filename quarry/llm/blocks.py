"""Rows packed into compressed blocks of bounded size.

A block is one row: an Arrow record batch of about ``limit`` bytes of text. Cut to
the shared folder, blocks are a stable copy of the input in which every row has a
number, at less than half of the texts' size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, release, slices

#: Bytes of text in a block.
BLOCK = 2 << 20
#: Compression: blocks are written once, stored, and moved once or twice.
LEVEL = 6
#: Bits of a row's number that count within its block, and that count blocks of a task.
WITHIN, BLOCKS = 16, 24


def pack(column: int, limit: int, facts: Callable[[pa.RecordBatch], pa.Array] | None):
    """Arrow batches to rows (data, facts): about ``limit`` bytes of ``column``, and a list about them."""

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        one = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        with pa.ipc.new_stream(sink, one.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as w:
            w.write_batch(one)
        out = {"data": pa.array([sink.getvalue().to_pybytes()], pa.binary())}
        if facts:
            found = facts(one)
            out["facts"] = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found)
        return pa.RecordBatch.from_arrays(list(out.values()), list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[pa.RecordBatch] = []
        size = rows = 0
        for batch in batches:
            for piece in slices(batch, column, limit // 4):
                for at in range(0, piece.num_rows, 1 << WITHIN - 1):
                    part = piece.slice(at, 1 << WITHIN - 1)
                    if held and rows + part.num_rows > 1 << WITHIN:
                        yield packed(held)
                        held, size, rows = [], 0, 0
                    held.append(part)
                    size += part.column(column).nbytes + 64 * part.num_rows
                    rows += part.num_rows
                    if size >= limit:
                        yield packed(held)
                        held, size, rows = [], 0, 0
        if held:
            yield packed(held)
        release()

    return run


def unpack(data: pa.Scalar) -> pa.RecordBatch:
    """The rows of a block."""
    return pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks().to_batches()[0]


def store(rows: DataFrame, text: str, limit: int, facts=None, kind: str = "") -> DataFrame:
    """(c, data[, facts]): the blocks of ``rows``, numbered and cut to the shared folder.

    A block's number is that of its task, then that within the task, so that
    ``c << WITHIN`` plus the place in the block is a row's.
    """
    rows.sparkSession.sparkContext._jvm.System.gc()  # lets Spark delete the shuffles and checkpoints that nothing refers to any more
    schema = "data binary" + (f", facts array<{kind}>" if facts else "")
    packed = rows.mapInArrow(pack(rows.columns.index(text), limit, facts), schema)
    n = F.monotonically_increasing_id()
    number = F.shiftleft(F.shiftright(n, 33), BLOCKS).bitwiseOR(n.bitwiseAND(F.lit((1 << 33) - 1)))
    return cut(packed.select(number.alias("c"), *packed.columns))
