"""Embedding near-dedup by NN-descent, within equal labels.

1. Equal vectors of one label are one class. Random-hyperplane trees, as many as a
   pair at the threshold needs to meet in a leaf with the target probability, give
   each class its first neighbours; large leaves are cut by hash.
2. NN-descent: the neighbours and reverse neighbours of a class are compared with each
   other; better ones replace worse ones, round by round. Lists reach as far as twice the
   threshold's angle: two links of one class are never further apart.
3. A list that is full of threshold edges is saturated: the room for such edges doubles,
   round by round, up to ``room``, and the search goes on until the lists stand still and
   none that may still grow is saturated. In saturated neighbourhoods, where the lists of
   all members hold nearly the same, a few members drawn anew each round stand for all.
4. The threshold edges of the lists are the links; components follow from them. Only where
   a class has more than ``room`` links, its component is compared whole, tile by tile:
   listing m such members would take m**2 entries, counting their links takes m rows.
5. Recall is audited: a seeded sample of classes, dealt over the labels and over those
   with and without a link found, meets all vectors of its label; recall is the mean
   over classes with true links. As long as it misses ``min_recall``, trees and lists
   double and the search goes on from the lists it has; after ``max_tries`` searches that
   is an error.

Defined results: vectors that are null, zero or hold null or non-finite components,
and vectors with a null label, link with nothing; vectors of different lengths never
link; equal rows count as links of each other; rows with a null id stay rows and come
last; an empty table gives an empty result; other columns, whatever their names, are
ignored; one output row per input row.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut, hashed
from quarry.llm.components import components
from quarry.llm.tiles import FLUSH, LINKS, count_links, grouped, pair_tiles, place

LEAF, LEAF_LIMIT = 64, 256
TILE = 1024
BITS = 28
#: Most threshold edges a list holds.
ROOM = 256
#: Members that stand for a saturated neighbourhood in each round.
PIVOTS = 8


def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, part, vec): the vector's bytes as they come, float32 or float64; null where it can't link."""
    for batch in batches:
        kind = np.float32 if batch.column(1).type.value_type == pa.float32() else np.float64
        vecs, parts = [], []
        for label, values in zip(batch.column(2).to_pylist(), batch.column(1)):
            vec = None
            if label is not None and values.is_valid and len(values.values) and not values.values.null_count:
                x = values.values.to_numpy(zero_copy_only=False).astype(kind)
                if np.isfinite(x).all() and x.any():
                    vec = x
            vecs.append(None if vec is None else (vec + kind(0)).tobytes())
            parts.append(None if vec is None else f"{len(vec)}:{label}")
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(parts, pa.string()), pa.array(vecs, pa.binary())], ["_id", "part", "vec"]
        )


def matrix(blobs: list[bytes], kind: str) -> np.ndarray:
    """Float64 rows of length one."""
    x = np.frombuffer(b"".join(blobs), kind).astype(np.float64).reshape(len(blobs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest entries of each row, the diagonal left out."""
    n = len(sims)
    np.fill_diagonal(sims, -2)
    k = min(k, n - 1)
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(-sims, axis=1)[:, :k]
    return np.repeat(np.arange(n), k), top.ravel()


def reach(threshold: float) -> float:
    """Similarity at twice the threshold's angle: a neighbour beyond leads to no link that a nearer one doesn't."""
    return 2 * threshold * threshold - 1 if threshold > 0.5**0.5 else -1.0


#: What local joins return.
PAIRS = "v long, w long, sim double"


def local_join(keys: int, k: int, threshold: float, kind: str):
    """Compare the members of each group with each other; each keeps its ``k`` best there
    and all of its threshold edges, but none below ``reach``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], ["v", "w", "sim"])

        held, size = [], 0
        for rows in grouped(batches, keys):
            if len(rows) < 2:
                continue
            v = np.array([r[keys] for r in rows], np.int64)
            x = matrix([r[keys + 1] for r in rows], kind)
            sims = x @ x.T
            a, b = best(sims, k)
            near = sims >= threshold
            near[a, b] = True  # the diagonal is out
            a, b = np.nonzero(near & (sims >= reach(threshold)))
            held.append((v[a], v[b], sims[a, b]))
            size += len(a)
            if size >= FLUSH:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    return run


def trees_for(threshold: float, recall: float, depth: int) -> int:
    """Trees with which a pair at ``threshold`` shares a leaf with probability ``recall``."""
    same = (1 - math.acos(threshold) / math.pi) ** depth
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - same))) if same < 1 else 4


def leaves(trees: int, seed: int, kind: str):
    """(leaf, v) rows: the sign code of each class in every tree, as deep as its part needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False)
            part = batch.column(1).to_numpy(zero_copy_only=False)  # hashed
            depth = batch.column(2).to_numpy(zero_copy_only=False)
            blobs = batch.column(3).to_pylist()
            sizes = np.array(list(map(len, blobs)))
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                dim = size // np.dtype(kind).itemsize
                if dim not in planes:
                    draw = np.random.Generator(np.random.PCG64([seed, dim]))
                    planes[dim] = draw.standard_normal((trees, dim, BITS))
                x = matrix([blobs[i] for i in at], kind)
                for t in range(trees):
                    signs = (x @ planes[dim][t] > 0).astype(np.int64)
                    code = (signs << np.arange(BITS)).cumsum(axis=1)
                    d = depth[at]
                    held = np.where(d > 0, code[np.arange(len(at)), np.maximum(d, 1) - 1], 0)
                    leaf = part[at] ^ ((held << 16 | t) * np.int64(-7046029254386353131))
                    yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(v[at]), pa.array(np.full(len(at), t, np.int32))], ["leaf", "v", "t"])

    return run


def listed(pairs: DataFrame, k: int, room: int, threshold: float) -> DataFrame:
    """(v, w, sim, place): each class's ``k`` best distinct neighbours, and up to ``room`` threshold edges; ties fall by hash."""
    one = pairs.groupBy("v", "w").agg(F.max("sim").alias("sim"))
    place = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), F.xxhash64("v", "w")))
    held = one.withColumn("place", place).filter(F.col("place") <= max(k, room))
    return held.filter((F.col("place") <= k) | (F.col("sim") >= threshold))


def descend(held: DataFrame, vectors: DataFrame, k: int, room: int, threshold: float, kind: str) -> DataFrame:
    """Neighbours-of-neighbours rounds until the lists gain less than a thousandth and no list that may grow is saturated.

    The sum of sim + 1 and the number of threshold edges only grow and are bounded, so the rounds end.
    """
    before, space = (None, None), min(2 * k, room)
    for turn in itertools.count():
        near = (F.col("sim") >= threshold).cast("long")
        sizes = held.groupBy("v").agg(F.sum(near).alias("_near"))
        both = held.select("v", "w", "sim").union(held.select(F.col("w").alias("v"), F.col("v").alias("w"), "sim"))
        around = listed(both, 2 * k, space, threshold).select(F.col("v").alias("u"), "w")
        # a saturated neighbourhood of s members is compared by about PIVOTS of them
        draw = F.pmod(hashed("v", seed=1000 + turn), F.lit(1 << 20)) / (1 << 20)
        pivots = sizes.filter((F.col("_near") <= 2 * k) | (draw * F.col("_near") < PIVOTS)).select(F.col("v").alias("u"))
        members = around.join(pivots, "u", "left_semi").join(vectors, around["w"] == vectors["v"]).select("u", "w", "vec")
        found = members.repartition("u").sortWithinPartitions("u").mapInArrow(local_join(1, 3, threshold, kind), PAIRS)
        held = cut(listed(held.select("v", "w", "sim").union(found), k, space, threshold))
        per = held.groupBy("v").agg(F.sum(near).alias("_near"), F.sum(F.when(F.col("place") <= k, F.col("sim") + 1)).alias("_best"))
        got = per.agg(F.sum("_best"), F.sum("_near"), F.max("_near")).first()
        now = got[0] or 0.0, got[1] or 0
        saturated = (got[2] or 0) >= space
        still = before[0] is not None and now[0] - before[0] <= 0.001 * before[0] and now[1] - before[1] <= 0.001 * before[1]
        before = now
        if saturated and space < room:
            space = min(2 * space, room)
        elif still:
            return held


def near_pairs(threshold: float, kind: str):
    def pairs(first: list[tuple], second: list[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        x = matrix([r[2] for r in first], kind)
        if second:
            hit = x @ matrix([r[2] for r in second], kind).T >= threshold
            for i in range(len(first)):
                yield i, np.flatnonzero(hit[i]) + len(first)
        else:
            hit = x @ x.T >= threshold
            for i in range(len(first)):
                yield i, np.flatnonzero(hit[i, i + 1 :]) + i + 1

    return pairs


#: Sampled classes with true links from which a label's own recall is judged.
ENOUGH = 200


def audit(classes: DataFrame, linked: DataFrame, threshold: float, size: int, kind: str) -> float:
    """Mean recall of ``linked`` (v, links) per class with true links, or that of the worst label.

    About ``size`` classes are drawn: equally many from the classes of each label with a
    link found and from those without, weighted by how many each draw stands for. A
    label with ``ENOUGH`` such classes in the sample is also judged alone.
    """
    known = classes.join(linked, "v", "left").select(
        "v", "part", "vec", F.coalesce("links", F.lit(0)).alias("links"), (F.coalesce("links", F.lit(0)) > 0).alias("some")
    )
    strata = cut(known.groupBy("part", "some").agg(F.count("*").alias("_s")))
    each = size / max(1, strata.count())
    draw = F.pmod(hashed("v", seed=3), F.lit(1 << 30)) / (1 << 30)
    rate = F.least(F.lit(1.0), F.lit(each) / F.col("_s"))
    sample = known.join(strata, ["part", "some"]).filter(draw < rate).select("v", "part", "vec", "links", rate.alias("rate"))
    drawn = {r["v"]: r for r in sample.collect()}
    if not drawn:
        return 1.0
    held = [(r["v"], r["part"], bytes(r["vec"])) for r in drawn.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[str, list[tuple[int, bytes]]] = {}
        for v, part, vec in held:
            by_part.setdefault(part, []).append((v, vec))
        ready = {p: (np.array([v for v, _ in x], np.int64), matrix([b for _, b in x], kind)) for p, x in by_part.items()}
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False)
            rows: dict[str, list[int]] = {}
            for i, p in enumerate(batch.column(1).to_pylist()):
                rows.setdefault(p, []).append(i)
            copies = batch.column(2).to_numpy(zero_copy_only=False)
            blobs = batch.column(3).to_pylist()
            for p, at in rows.items():
                if p in ready:
                    own, x = ready[p]
                    hit = (x @ matrix([blobs[i] for i in at], kind).T >= threshold) & (own[:, None] != v[at][None, :])
                    links = hit @ copies[at]
                    yield pa.RecordBatch.from_arrays([pa.array(own[links > 0]), pa.array(links[links > 0])], ["v", "true_links"])

    truth = classes.select("v", "part", "copies", "vec").mapInArrow(run, "v long, true_links long")
    by_part: dict[str, list[tuple[float, float]]] = {}
    for r in truth.groupBy("v").agg(F.sum("true_links").alias("t")).collect():
        own = drawn[r["v"]]
        by_part.setdefault(own["part"], []).append((min(r["t"], own["links"]) / r["t"], 1 / own["rate"]))

    def mean(found: list[tuple[float, float]]) -> float:
        return sum(f * w for f, w in found) / sum(w for _, w in found)

    every = [x for found in by_part.values() for x in found]
    return min([mean(every), *(mean(found) for found in by_part.values() if len(found) >= ENOUGH)]) if every else 1.0


def embedding_dedup(
    vectors: DataFrame,
    *,
    threshold: float = 0.93,
    recall: float = 0.999,
    min_recall: float = 0.995,
    k: int = 6,
    room: int = ROOM,
    audit_size: int = 4096,
    max_tries: int = 6,
    seed: int = 13,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(id, n_links, component_id, kept, audit_recall) per row of ``vectors``."""
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"
    slim = vectors.select(
        F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_v"), F.col(label_col).cast("string").alias("_l")
    )
    rows = cut(slim.mapInArrow(prepare, "_id long, part string, vec binary").select(
        "*", F.monotonically_increasing_id().alias("_row"), F.when(F.col("vec").isNotNull(), F.xxhash64("part", "vec")).alias("key")
    ))
    # a class is named by its first row; the key only deals the rows, vectors decide
    classes = cut(
        rows.filter("key IS NOT NULL")
        .groupBy("key", "part", "vec")
        .agg(F.min("_id").alias("class_id"), F.count("*").alias("copies"), F.min("_row").alias("v"))
    )
    parts = classes.groupBy("part").agg(F.count("*").alias("_n"))
    most = parts.agg(F.max("_n")).first()[0] or 1
    depth = max(0, min(BITS, math.ceil(math.log2(max(most, 1) / LEAF))))
    trees = trees_for(threshold, recall, depth)
    held = None
    for tried in range(1, max_tries + 1):
        held = search(classes, parts, held, threshold, k, max(k, room), trees, seed, kind)
        links, joined = links_of(held, classes, threshold, max(k, room), kind)
        share = audit(classes, links, threshold, audit_size, kind)
        if share >= min_recall:
            break
        if tried == max_tries:
            raise RuntimeError(f"recall {share:.4f} is below {min_recall} with {trees} trees and lists of {k}")
        trees, k, seed = 2 * trees, 2 * k, seed + 1
    named = (
        classes.select("v", "key", "part", "class_id", "copies")
        .join(links, "v", "left")
        .join(joined.select(F.col("node").alias("v"), "root"), "v", "left")
        .withColumn("root", F.coalesce("root", "v"))
    )
    least = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    per_class = named.join(least, "root").select(
        F.col("v").alias("_class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    of_class = classes.select("key", "part", "vec", F.col("v").alias("_class"))
    linking = rows.filter("key IS NOT NULL").join(of_class, ["key", "part", "vec"]).select("_id", "_class").join(per_class, "_class")
    out = linking.drop("_class").unionByName(rows.filter("key IS NULL").select("_id"), allowMissingColumns=True)
    component = F.coalesce("component_id", "_id")
    return out.select(
        F.col("_id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("_id") == component).alias("kept"),
        F.lit(float(share)).alias("audit_recall"),
    )


def search(
    classes: DataFrame, parts: DataFrame, known: DataFrame | None, threshold: float, k: int, room: int, trees: int, seed: int, kind: str
) -> DataFrame:
    """One pass of trees and descent from the lists that are ``known``: (v, w, sim, place)."""
    bare = classes.select("v", "vec")
    deep = F.greatest(F.lit(0), F.least(F.lit(BITS), F.ceil(F.log2(F.col("_n") / LEAF)))).cast("int")
    coded = cut(
        classes.select("v", "part", "vec")
        .join(parts, "part")
        .select("v", F.xxhash64("part").alias("p"), deep.alias("depth"), "vec")
        .mapInArrow(leaves(trees, seed, kind), "leaf long, v long, t int")
    )
    cuts = coded.groupBy("leaf").agg(F.count("*").alias("_m")).filter("_m > 1")
    salt = F.pmod(F.xxhash64("v", "t"), F.ceil(F.col("_m") / LEAF_LIMIT)).cast("int")
    in_leaf = coded.join(cuts, "leaf").select("leaf", salt.alias("salt"), "v")
    members = in_leaf.join(bare, "v").select("leaf", "salt", "v", "vec")
    first = members.repartition("leaf", "salt").sortWithinPartitions("leaf", "salt").mapInArrow(
        local_join(2, 4, threshold, kind), PAIRS
    )
    if known is not None:
        first = first.union(known.select("v", "w", "sim"))
    return descend(cut(listed(first, k, min(2 * k, room), threshold)), bare, k, room, threshold, kind)


def links_of(lists: DataFrame, classes: DataFrame, threshold: float, room: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """((v, links), components): from the lists' threshold edges; whole components where a list has no more room."""
    near = lists.filter(F.col("sim") >= threshold)
    over = near.groupBy("v").agg(F.count("*").alias("_n")).filter(F.col("_n") >= room).select("v")
    edges = cut(near.select("v", "w").union(near.select(F.col("w").alias("v"), F.col("v").alias("w"))).distinct())
    joined = cut(components(edges))
    listed_links = (
        edges.join(classes.select(F.col("v").alias("w"), "copies"), "w").groupBy("v").agg(F.sum("copies").alias("links"))
    )
    crowded = cut(joined.join(over, F.col("node") == F.col("v"), "left_semi").select("root").distinct())
    if crowded.isEmpty():
        return cut(listed_links), joined
    dense = joined.join(crowded, "root", "left_semi").select("node", "root")
    placed = (
        place(dense, TILE)
        .join(classes.select("v", "copies", "vec"), F.col("node") == F.col("v"))
        .select("root", "tiles", "tile", "v", "copies", "vec")
    )
    compared = pair_tiles(placed, ["v", "copies", "vec"]).mapInArrow(count_links(near_pairs(threshold, kind)), LINKS)
    counted = compared.filter("v IS NOT NULL").groupBy("v").agg(F.sum("links").alias("links"))
    sparse = listed_links.join(dense.select(F.col("node").alias("v")), "v", "left_anti")
    return cut(sparse.select("v", "links").union(counted.select("v", "links"))), joined
