"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

1. Texts are packed into numbered blocks, cut to the shared folder. Every text becomes
   the set of its 5-word n-grams; documents with equal sets (two 64-bit hashes) are
   one class. Rows and bands are the most selective ones that reach the target recall
   at the similarity with at most ``max_hashes`` MinHashes.
2. Classes shuffle on their band hashes. A pair belongs to the first band that both
   share, so it is met once, however many bands it shares. Within a bucket the pairs
   that belong there are estimated from one byte of every MinHash; classes with a pair
   that may reach the similarity stay in the bucket. No bucket is chained to another.
3. The texts of these classes come from the blocks, and each bucket's pairs are
   verified on full n-gram sets. Links are counted per class; a bucket returns at most
   one joining link per class, from which connected components follow.

Buckets are cut into tiles, by number for the estimate and by bytes of text for the
verification, and every pair of tiles is a group of its own: no task holds a bucket,
and pairs never leave the task that compares them.

A pair at the similarity is missed if it shares no band (``1 - recall``) or if the
estimate from ``rows * bands`` MinHashes falls ``SLACK`` below the similarity (seven
standard deviations); nothing else is probabilistic. ``measured_recall`` holds
a result against all pairs of sampled rows.

Defined results: texts with fewer words than an n-gram have one n-gram, their whole
word sequence; texts without a word (null, empty, blank) link with nothing; words
are taken unchanged; equal rows are one class and count as links of each other;
rows that share an id, or have none, stay rows of their own; null ids come last; very
long texts are compared whole; an empty table gives an empty result; extra columns are
left out unless named in ``keep``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.blocks import BLOCK, WITHIN, store, unpack
from quarry.llm.common import cut, hashed, release, slices
from quarry.llm.components import components
from quarry.llm.rolling import mix, windows, words_of

U = np.uint64
#: Classes of a bucket's tile in the estimate; in the verification, and its bytes of text.
TILE, VERIFY_TILE, VERIFY_BYTES = 512, 1024, 8 << 20
#: Cells of a comparison matrix at a time.
CELLS = 4_000_000
#: How far an estimate may fall below the similarity.
SLACK = 0.25


def banding(similarity: float, recall: float, max_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): as many rows as ``max_hashes`` allows for a pair at ``similarity`` to share a band with probability ``recall``."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))) if similarity < 1 else 1
        if bands * rows <= max_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("max_hashes is too small for this similarity and recall")
    return best


def gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of every text, sorted within it, and where each text's begin."""
    words = words_of(texts)
    counts = words.counts
    text = np.repeat(np.arange(len(counts)), counts)
    h, whole = windows(words, n)
    grams, owner = h[whole], text[: len(h)][whole]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        own = np.array(
            [int(mix(np.array([_chain(words.hashes[words.first[i] : words.first[i + 1]])], U))[0]) for i in short], U
        )
        grams, owner = np.concatenate([grams, own]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[fresh], owner[fresh]
    return grams, np.searchsorted(owner, np.arange(len(counts) + 1))


def _chain(hashes: np.ndarray) -> int:
    out = len(hashes)
    for h in hashes.tolist():
        out = (out * 0xD6E8FEB86659FD93 + h) % (1 << 64)
    return out


def set_keys(grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers per non-empty set that are equal for equal sets."""
    starts = first[:-1][np.diff(first) > 0]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.diff(first)[np.diff(first) > 0].astype(U)
    total = np.add.reduceat(mix(grams ^ U(0xA5A5A5A5A5A5A5A5)), starts)
    folded = np.add.reduceat(mix(grams * U(3) + U(1)), starts)
    return mix(total + size).view(np.int64), mix(folded ^ size).view(np.int64)


def signatures(grams: np.ndarray, first: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per non-empty set its band hashes, and the low byte of every MinHash."""
    full = np.flatnonzero(np.diff(first))
    starts = first[full]
    draw = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, (bands * rows, 2), dtype=np.uint64)
    out, low = np.empty((len(full), bands), np.int64), np.empty((len(full), bands * rows), np.uint8)
    for b in range(bands):
        joined = np.full(len(full), b, U)
        for r in range(rows):
            a, c = draw[b * rows + r]
            permuted = grams * (a | U(1)) + c
            permuted ^= permuted >> U(32)
            permuted *= U(0x9E3779B97F4A7C15)
            least = np.minimum.reduceat(permuted, starts)
            low[:, b * rows + r] = mix(least) & U(255)
            joined = mix(joined * U(31) + least)
        out[:, b] = joined.view(np.int64)
    return out, low


def met(keys: list[np.ndarray], side: np.ndarray, bands: np.ndarray, t: np.ndarray, upto: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) position arrays of the pairs that belong to their group, lag by lag.

    Rows are sorted by ``keys`` (group, i, j); in a group of two tiles only pairs across
    them count. A pair belongs to band ``t`` if no earlier band is equal.
    """
    n = len(side)
    mixed = keys[1] != keys[2]
    for lag in range(1, n):
        i = np.flatnonzero(upto[: n - lag] > np.arange(lag, n))
        if not len(i):
            return
        j = i + lag
        i, j = (x[~mixed[i] | (side[i] != side[j])] for x in (i, j))
        if len(i):
            first = (bands[i] == bands[j]).argmax(axis=1)
            hit = first == t[i]
            if hit.any():
                yield i[hit], j[hit]


def group_ends(keys: list[np.ndarray]) -> np.ndarray:
    """For every row the end of its group of rows with equal keys."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, n))
    return np.repeat(head + size, size)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Batches that end where a group of equal first ``keys`` columns ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        if held and any(held[-1].column(k)[-1].as_py() != columns[k][0] for k in range(keys)):
            new[0] = True
        last = np.flatnonzero(new)
        if len(last):
            cutoff = int(last[-1])
            yield joined_batch([*held, batch.slice(0, cutoff)])
            held = [batch.slice(cutoff)]
        else:
            held.append(batch)
    if held:
        yield joined_batch(held)


def joined_batch(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if sum(p.num_rows for p in parts) else parts[0]


def matrix(column: pa.Array, kind) -> np.ndarray:
    """Rows of equally long binary values."""
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1) if n else np.zeros((0, 1), kind)


def estimate(similarity: float):
    """(band, i, j, side, t, node, bands, low) to (band, t, node): who has a likely pair that belongs to the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, 3):
            if not batch.num_rows:
                continue
            keys = [batch.column(k).to_numpy() for k in range(3)]
            t, node = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            bands, low = matrix(batch.column(6), "<i8"), matrix(batch.column(7), np.uint8)
            due = np.zeros(len(node), bool)
            for i, j in met(keys, batch.column(3).to_numpy(), bands, t, group_ends(keys)):
                for at in range(0, len(i), 65_536):
                    x, y = i[at : at + 65_536], j[at : at + 65_536]
                    same = (low[x] == low[y]).mean(axis=1)
                    likely = (same - 1 / 256) / (1 - 1 / 256) >= similarity - SLACK
                    due[x[likely]] = due[y[likely]] = True
            if due.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[due]) for c in (keys[0], t, node)], ["band", "t", "node"])
        release()

    return run


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common members of the pairs of sets."""
    n = len(sets)
    if len(i) <= 4 * n:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())], np.int64)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, gram, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[gram] > 1
    gram, owner = gram[shared], owner[shared]
    used, gram = np.unique(gram, return_inverse=True)
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    common = np.zeros((n, n), np.float32)
    width = max(1, CELLS // n)
    for a in range(0, len(used), width):
        lo, hi = np.searchsorted(gram, [a, a + width])
        part = np.zeros((n, min(width, len(used) - a)), np.float32)
        part[owner[lo:hi], gram[lo:hi] - a] = 1
        common += part @ part.T  # whole numbers below 2**24: exact
    return common[i, j].astype(np.int64)


def verify(similarity: float, n: int):
    """(band, i, j, side, t, node, bands, copies, text) to links per class and the links that join classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in whole_groups(batches, 3):
            if not batch.num_rows:
                continue
            keys = [batch.column(k).to_numpy() for k in range(3)]
            t, node, copies = (batch.column(k).to_numpy() for k in (4, 5, 7))
            bands, ends = matrix(batch.column(6), "<i8"), group_ends(keys)
            heads = np.unique(ends, return_index=True)[1]
            pairs = list(met(keys, batch.column(3).to_numpy(), bands, t, ends))
            if not pairs:
                continue
            i, j = (np.concatenate(x) for x in zip(*pairs))
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            out: list[list[np.ndarray]] = [[], [], [], []]
            for a, b in zip(heads.tolist(), ends[heads].tolist()):
                lo, hi = np.searchsorted(i, [a, b])
                if lo == hi:
                    continue
                sets = []
                for part in slices(batch.slice(a, b - a), 8, 1 << 19):
                    grams, first = gram_sets(part.column(8), n)
                    sets += [grams[x:y] for x, y in zip(first[:-1], first[1:])]
                x, y = i[lo:hi] - a, j[lo:hi] - a
                sizes = np.array([len(s) for s in sets], np.int64)
                small, large = np.minimum(sizes[x], sizes[y]), np.maximum(sizes[x], sizes[y])
                fit = small >= similarity * large - 1e-6
                x, y = x[fit], y[fit]
                common = overlaps(sets, x, y)
                linked = common / np.maximum(sizes[x] + sizes[y] - common, 1) >= similarity
                x, y = x[linked], y[linked]
                if not len(x):
                    continue
                own, held = node[a:b], copies[a:b]
                links = np.bincount(x, held[y], b - a) + np.bincount(y, held[x], b - a)
                some = np.flatnonzero(links)
                p, q = joining(x, y, b - a)
                for column, value in zip(out, (own[some], links[some].astype(np.int64), own[p], own[q])):
                    column.append(value)
            if out[0]:
                v, links, p, q = (np.concatenate(x) for x in out)
                none = [None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in ([*v, *none * len(p)], [*links, *none * len(p)], [*none * len(v), *p], [*none * len(v), *q])],
                    ["v", "links", "a", "b"],
                )
        release()

    return run


def joining(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A chain through the members of each component of the pairs (x, y): less than one a member."""
    root = list(range(n))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = a = root[root[a]]
        return a

    for a, b in zip(x.tolist(), y.tolist()):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    top = np.array([find(a) for a in range(n)])
    order = np.argsort(top, kind="stable")
    same = np.flatnonzero(top[order][1:] == top[order][:-1])
    return order[same], order[same + 1]


def tiled(members: DataFrame, tiles: DataFrame, payload: list[str]) -> DataFrame:
    """Rows (band, i, j, side, t, node, *payload), sorted: every pair of tiles of a bucket is a group.

    ``tiles``: (band, tiles).
    """
    placed = members.join(tiles, "band").withColumn("tile", F.pmod(F.xxhash64("node", "band"), "tiles").cast("int"))
    both = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    keys = ["band", "i", "j"]
    return (
        both.select("band", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), F.col("tile").alias("side"), "t", "node", *payload)
        .repartition(*keys)
        .sortWithinPartitions(*keys)
    )


def ngram_join(docs: DataFrame, **how) -> DataFrame:
    """(id, class_id, n_links, component_id, kept, _row, *keep) per row of ``docs``.

    ``n_links`` counts the other rows with Jaccard similarity >= ``similarity``,
    ``class_id`` is the smallest id with the same n-gram set, ``component_id`` the
    smallest id reachable by links; kept marks one row of each component. For ``how``
    see ``linked``.
    """
    return linked(docs, **how)[0]


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are ``kept``, whole: one of each component.

    They come out of the stored blocks by their numbers, so ids may be null or repeat.
    """
    text, names = how.get("text_col", "text"), docs.columns
    result, blocks = linked(docs, **{**how, "keep": tuple(c for c in names if c != text)})
    rows = result.filter("kept").groupBy(F.shiftright("_row", WITHIN).alias("c")).agg(F.collect_list("_row").alias("rows"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, data, kept in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                own = unpack(data)
                yield own.select(own.schema.names[1:]).take(pa.array(np.sort(kept.values.to_numpy()) - (c << WITHIN)))
        release()

    stored = [text, *(c for c in names if c != text)]  # in the blocks' order
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"_c{i} {kinds[c]}" for i, c in enumerate(stored))

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in pick(batches):
            yield out.rename_columns([f"_c{i}" for i in range(len(stored))])

    out = blocks.join(rows, "c").select("c", "data", "rows").mapInArrow(renamed, schema)
    return out.toDF(*stored).select(*(F.col(f"`{c}`") for c in names))


def linked(
    docs: DataFrame,
    *,
    n: int = 5,
    similarity: float = 0.8,
    recall: float = 0.9999999,
    max_hashes: int = 128,
    block_bytes: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """What ``ngram_join`` returns, and the blocks (c, data) that hold the rows by their numbers."""
    bands, rows = banding(similarity, recall, max_hashes)
    names = [f"_keep_{i}" for i in range(len(keep))]
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *(F.col(c).alias(k) for c, k in zip(keep, names)))
    blocks = store(slim, "_text", block_bytes)
    carried = [f for f in slim.schema if f.name != "_text"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for c, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                at = c << WITHIN
                for part in slices(unpack(data), 1, 1 << 19):
                    grams, first = gram_sets(part.column(1), n)
                    full = np.flatnonzero(np.diff(first))
                    null = np.ones(part.num_rows, bool)
                    null[full] = False
                    v, w = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                    v[full], w[full] = set_keys(grams, first)
                    lists: list = [None] * part.num_rows
                    lows: list = [None] * part.num_rows
                    if len(full):
                        own, low = signatures(grams, first, bands, rows)
                        for i, x, y in zip(full.tolist(), own, low):
                            lists[i], lows[i] = x.astype("<i8").tobytes(), y.tobytes()
                    size = pc.fill_null(pc.binary_length(part.column(1)), 0)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(part.column(f.name) for f in carried),
                            pa.array(np.arange(at, at + part.num_rows)),
                            pa.array(v, mask=null),
                            pa.array(w, mask=null),
                            size.cast(pa.int64()),
                            pa.array(lists, pa.binary()),
                            pa.array(lows, pa.binary()),
                        ],
                        [f.name for f in carried] + ["_row", "v", "w", "size", "bands", "low"],
                    )
                    at += part.num_rows
        release()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in carried)
    signed = cut(blocks.mapInArrow(sign, schema + ", _row long, v long, w long, size long, bands binary, low binary"))
    # a class is named by its first row, whose text stands for all of them
    classes = cut(
        signed.filter("v IS NOT NULL")
        .groupBy("v", "w")
        .agg(F.min("_id").alias("class_id"), F.count("*").alias("copies"), F.min("_row").alias("node"))
    )
    facts = signed.join(classes.select(F.col("node").alias("_row"), "copies"), "_row").select(F.col("_row").alias("node"), "copies", "size", "bands", "low")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = matrix(batch.column(1), "<i8")
            node = batch.column(0).to_numpy()
            for t in range(own.shape[1] if len(node) else 0):
                yield pa.RecordBatch.from_arrays([pa.array(own[:, t]), pa.array(np.full(len(node), t, np.int32)), pa.array(node)], ["band", "t", "node"])

    facts = cut(facts)
    banded = facts.select("node", "bands").mapInArrow(split, "band long, t int, node long")
    # of buckets with the same classes the first band's stays: no pair belongs to a later one
    same = F.bit_xor(F.xxhash64("node")).alias("_x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("_y")
    size_of = (
        banded.groupBy("band")
        .agg(F.count("*").alias("_n"), *same, F.min("t").alias("t"))
        .filter("_n > 1")
        .groupBy("_n", "_x", "_y")
        .agg(F.min(F.struct("t", "band")).alias("_first"))
        .select(F.col("_first.band").alias("band"), "_n")
    )
    tiles = size_of.select("band", F.ceil(F.col("_n") / TILE).cast("int").alias("tiles"))
    buckets = banded.join(tiles.select("band"), "band", "left_semi").join(facts.select("node", "bands", "low"), "node")
    likely = cut(tiled(buckets, tiles, ["bands", "low"]).mapInArrow(estimate(similarity), "band long, t int, node long").distinct())

    wanted = (
        likely.select("node").distinct().groupBy(F.shiftright("node", WITHIN).alias("c")).agg(F.collect_list("node").alias("nodes"))
    )

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, data, nodes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                own = nodes.values.to_numpy()
                text = unpack(data).column(1).take(pa.array(own - (c << WITHIN)))
                yield pa.RecordBatch.from_arrays([pa.array(own), text], ["node", "text"])

    texts = blocks.join(wanted, "c").select("c", "data", "nodes").mapInArrow(pick, "node long, text string")
    weighed = likely.join(facts.select("node", "size", "copies", "bands"), "node")
    verify_tiles = weighed.groupBy("band").agg(
        F.greatest(F.ceil(F.count("*") / VERIFY_TILE), F.ceil(F.sum("size") / VERIFY_BYTES)).cast("int").alias("tiles")
    )
    members = weighed.join(texts, "node").select("band", "t", "node", "bands", "copies", "text")
    compared = cut(tiled(members, verify_tiles, ["bands", "copies", "text"]).mapInArrow(verify(similarity, n), "v long, links long, a long, b long"))
    links = compared.filter("v IS NOT NULL").groupBy(F.col("v").alias("node")).agg(F.sum("links").alias("links"))
    joined = components(compared.filter("a IS NOT NULL").select("a", "b"))
    named = classes.join(links, "node", "left").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    per_class = named.join(least, "root").select(
        "v", "w", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", "root"
    )
    plain = signed.select("_id", "_row", *names, "v", "w")
    found = plain.filter("v IS NOT NULL").join(per_class, ["v", "w"])
    return _keep_one(found.unionByName(plain.filter("v IS NULL"), allowMissingColumns=True), id_col, keep), blocks


def _keep_one(rows: DataFrame, id_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Mark one row of each component: its smallest id, the first such row.

    The marks are joined back by row, so a component of very many rows is no task.
    """
    heads = (
        rows.filter(F.col("root").isNotNull() & F.col("_id").eqNullSafe(F.col("component_id")))
        .groupBy("root")
        .agg(F.min("_row").alias("_row"))
        .select("_row", F.lit(True).alias("_head"))
    )
    return rows.join(heads, "_row", "left").select(
        F.col("_id").alias(id_col),
        F.coalesce("class_id", "_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "_id").alias("component_id"),
        F.coalesce("_head", F.col("root").isNull()).alias("kept"),
        "_row",
        *(F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)),
    )


def measured_recall(docs: DataFrame, result: DataFrame, *, n: int = 5, similarity: float = 0.8, every: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> float:
    """Share of the links of sampled rows that ``result`` holds, from comparisons with all rows.

    One row in ``every`` is a query, by hash of its id, and ids must be unique; the query
    texts go to the tasks, so their number should stay in the thousands.
    """
    asked = docs.filter(F.col(id_col).isNotNull() & (F.pmod(hashed(F.col(id_col).cast("long"), seed=9), F.lit(every)) == 0))
    held = [(r[0], r[1]) for r in asked.select(F.col(id_col).cast("long"), text_col).collect()]
    grams, first = gram_sets(pa.array([t for _, t in held], pa.string()), n)
    own = [(i, grams[a:b]) for (i, _), a, b in zip(held, first[:-1], first[1:]) if b > a]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 19):
                grams, first = gram_sets(part.column(1), n)
                text = np.repeat(np.arange(part.num_rows), np.diff(first))
                sizes, ids = np.diff(first), part.column(0).to_numpy(zero_copy_only=False)
                for i, mine in own:
                    at = np.minimum(np.searchsorted(mine, grams), len(mine) - 1)
                    common = np.bincount(text[mine[at] == grams], minlength=part.num_rows)
                    hit = (common / np.maximum(sizes + len(mine) - common, 1) >= similarity) & (ids != i)
                    if hit.any():
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([int(hit.sum())], pa.int64())], ["_id", "_n"])

    true = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t")).mapInArrow(run, "_id long, _n long")
    both = true.groupBy("_id").agg(F.sum("_n").alias("_n")).join(result.select(F.col(id_col).cast("long").alias("_id"), "n_links"), "_id")
    got = both.agg(F.sum(F.least("_n", "n_links")), F.sum("_n")).first()
    return got[0] / got[1] if got[1] else 1.0
