"""Substring dedup: repeated fixed-length token windows, cut at every later document.

1. Texts are packed into blocks of a bounded size, written once to the shared folder.
2. A text whose whole word sequence also is that of a smaller id goes whole: all of its
   windows start there too. It needs no further look, and no other text needs it.
3. Seeds: the smallest 5-word hash inside each 13-word window; neighbouring windows
   mostly share it. Equal windows have equal seeds, so a window whose seed occurs in
   one block alone can repeat in that block only. Spark counts seeds over blocks.
4. Every other window gets two independent 64-bit Rabin-Karp hashes. A block sends a
   distinct window once, with its smallest id; Spark finds each window's smallest id
   over all blocks, and the blocks that hold it under larger ids alone are told.
5. Each block marks its windows that also start under a smaller id, there or in
   another block, merges them into maximal removal intervals, and cuts its texts.

A text or passage in a third of all documents is one row per block, however many
documents hold it, so no task grows with its copies. What moves: about 16 bytes per
seed, 25 per window that may repeat, and the compressed blocks. Texts and windows are
equal if both hashes are, which two different windows of n in all meet with
probability n**2 / 2**129.

Defined results: a null text has no words; texts below the window length lose
nothing; windows that repeat only inside one document stay; each row is cut on its
own, rows that share an id don't cut each other, so equal rows stay alike; a null id
comes after all others; very long texts are blocks of their own, cut whole; an empty
table gives an empty result; extra columns are left out unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.blocks import BLOCK, store, unpack
from quarry.llm.common import release
from quarry.llm.rolling import Words, mix, sequences, windows, words_of

U = np.uint64
LAST = np.iinfo(np.int64).max


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` values from each position on."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


# -- blocks --------------------------------------------------------------------


def texts_of(rows: pa.RecordBatch) -> pa.Array:
    """(k, l, lo): the distinct word sequences of a block, by both hashes, and their smallest id."""
    k, l = (sequences(words_of(rows.column(1), second)) for second in (False, True))
    ids = rows.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
    order, heads = groups(k, l)
    first = order[heads]
    lo = np.minimum.reduceat(ids[order], heads) if len(heads) else ids[:0]
    return pa.StructArray.from_arrays([pa.array(x) for x in (k[first].view(np.int64), l[first].view(np.int64), lo)], ["k", "l", "lo"])


class Block:
    """Hashes of a block's windows; columns 0 and 1 are the id and the text.

    ``told`` lists the (k, l) of word sequences that smaller ids hold elsewhere.
    """

    def __init__(self, data: pa.Scalar, told: pa.Scalar, window: int, seed_words: int):
        self.rows = unpack(data)
        self.window, self.seed_words = window, seed_words
        self.words: Words = words_of(self.rows.column(1))
        self.others: Words = words_of(self.rows.column(1), second=True)
        self.ids = self.rows.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
        self.copies = later(sequences(self.words), sequences(self.others), self.ids, told)
        text = np.repeat(np.arange(len(self.ids)), self.words.counts)
        h, whole = windows(self.words, window)
        self.at = np.flatnonzero(whole & ~self.copies[text[: len(h)]])  # first words of the windows, over the whole block
        self.h = h[self.at]
        self.owner = self.ids[text[self.at]]

    def seeds(self) -> np.ndarray:
        """The seed of each window."""
        if not len(self.at):
            return np.zeros(0, np.int64)
        inner, _ = windows(self.words, self.seed_words)
        return mix(sliding_min(inner, self.window - self.seed_words + 1)[self.at]).view(np.int64)

    def second(self) -> np.ndarray:
        """The other hash of each window."""
        return windows(self.others, self.window)[0][self.at]


def groups(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads): positions sorted by both hashes, and where each distinct pair begins."""
    order = np.lexsort((g, h))
    h, g = h[order], g[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    return order, np.flatnonzero(new)


def later(h: np.ndarray, g: np.ndarray, ids: np.ndarray, told: pa.Scalar) -> np.ndarray:
    """Which of the keys (h, g) a smaller id holds as well, here or, as ``told``, elsewhere."""
    n = len(h)
    if told.is_valid:
        other = [x.to_numpy().view(U) for x in told.values.flatten()]
        h, g = np.concatenate([h, other[0]]), np.concatenate([g, other[1]])
        ids = np.concatenate([ids, np.full(len(h) - n, np.iinfo(np.int64).min)])
    order, heads = groups(h, g)
    if not len(heads):
        return np.zeros(0, bool)
    least = np.empty(len(h), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(ids[order], heads), np.diff(np.append(heads, len(h))))
    return ids[:n] > least[:n]


def seeds_of(window: int, seed_words: int):
    """(c, data, copies) to (m, c): the distinct seeds of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, data, copies in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                m = np.unique(Block(data, copies, window, seed_words).seeds())
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(np.full(len(m), c, np.int64))], ["m", "c"])
        release()

    return run


def windows_of(window: int, seed_words: int):
    """(c, data, copies, shared) to (h, g, c, lo): the distinct windows of each block over the
    seeds it shares, with their smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, data, copies, shared in zip(batch.column(0).to_pylist(), *(batch.column(k) for k in (1, 2, 3))):
                block = Block(data, copies, window, seed_words)
                due = np.isin(block.seeds(), shared.values.to_numpy())
                h, g, ids = block.h[due], block.second()[due], block.owner[due]
                order, heads = groups(h, g)
                if not len(heads):
                    continue
                one = order[heads]
                lo = np.minimum.reduceat(ids[order], heads)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[one].view(np.int64)), pa.array(g[one].view(np.int64)), pa.array(np.full(len(one), c, np.int64)), pa.array(lo)],
                    ["h", "g", "c", "lo"],
                )
        release()

    return run


def told(rows: DataFrame, h: str, g: str, name: str) -> DataFrame:
    """(c, name): per block the keys of ``rows`` (h, g, c, lo) that another block holds under a smaller id."""
    first = F.min("lo").over(Window.partitionBy(h, g))
    return rows.withColumn("first", first).filter("first < lo").groupBy("c").agg(F.collect_list(F.struct(h, g)).alias(name))


def intervals(at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal [first word, word after the last) that sorted windows of one text cover, touching ones joined."""
    new = np.ones(len(at), bool)
    new[1:] = at[1:] > at[:-1] + window
    head = np.flatnonzero(new)
    return at[head], at[np.append(head[1:], len(at))[: len(head)] - 1] + window


def cut_words(text: str, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(words, removed words, kept words joined by one blank)."""
    words = text.encode("utf-8").split()
    if not spans:
        return len(words), 0, b" ".join(words)
    kept, at = [], 0
    for a, b in spans:
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept)


def substring_dedup(
    docs: DataFrame,
    *,
    window: int = 13,
    seed_words: int = 5,
    block_bytes: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, n_words, n_removed, spans array<struct<start,end>>, kept_text, *keep) per row of ``docs``.

    ``spans`` are the maximal removal intervals in words, end excluded.
    """
    names = [f"_keep_{i}" for i in range(len(keep))]
    kinds = dict(docs.dtypes)
    slim = docs.select(
        F.col(id_col).cast("long").alias("_id"),
        F.col(text_col).alias("_text"),
        F.col(id_col).alias("_own"),
        *(F.col(c).alias(n) for c, n in zip(keep, names)),
    )
    stored = store(slim, "_text", block_bytes, texts_of, "struct<k:long,l:long,lo:long>")
    blocks = stored.select("c", "data")
    copies = told(stored.select("c", F.inline("facts")), "k", "l", "copies")
    known = blocks.join(copies, "c", "left").select("c", "data", "copies")
    shared = (
        known.mapInArrow(seeds_of(window, seed_words), "m long, c long")
        .withColumn("n", F.count("*").over(Window.partitionBy("m")))
        .filter("n > 1")
        .groupBy("c")
        .agg(F.collect_list("m").alias("shared"))
    )
    found = known.join(shared, "c").select("c", "data", "copies", "shared").mapInArrow(
        windows_of(window, seed_words), "h long, g long, c long, lo long"
    )
    repeats = told(found, "h", "g", "repeats")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, own, others in zip(*(batch.column(k) for k in range(3))):
                block = Block(data, own, window, seed_words)
                at = block.at[later(block.h, block.second(), block.owner, others)]
                ends = np.searchsorted(at, block.words.first)
                counts = block.words.counts
                out: list[list] = [[], [], [], []]
                for k, text in enumerate(block.rows.column(1).to_pylist()):
                    spans = []
                    if block.copies[k] and counts[k] >= window:
                        spans = [(0, int(counts[k]))]
                    elif ends[k] < ends[k + 1]:
                        own = at[ends[k] : ends[k + 1]] - block.words.first[k]
                        spans = list(zip(*(x.tolist() for x in intervals(own, window))))
                    n, removed, kept = cut_words(text or "", spans)
                    for x, v in zip(out, (n, removed, [{"start": a, "end": b} for a, b in spans], kept)):
                        x.append(v)
                yield pa.RecordBatch.from_arrays(
                    [
                        block.rows.column(2),
                        pa.array(out[0], pa.int64()),
                        pa.array(out[1], pa.int64()),
                        pa.array(out[2], span),
                        pa.array(out[3], pa.binary()).cast(pa.string()),
                        *(block.rows.column(3 + i) for i in range(len(keep))),
                    ],
                    ["_own", "n_words", "n_removed", "spans", "kept_text", *names],
                )
        release()

    schema = f"_own {kinds[id_col]}, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"
    schema += "".join(f", {n} {kinds[c]}" for c, n in zip(keep, names))
    out = known.join(repeats, "c", "left").select("data", "copies", "repeats").mapInArrow(finish, schema)
    return out.select(
        F.col("_own").alias(id_col),
        "n_words",
        "n_removed",
        "spans",
        "kept_text",
        *(F.col(n).alias(c) for c, n in zip(keep, names)),
    )
