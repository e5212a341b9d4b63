"""Quality classifier: ordinal cumulative-link regression on hashed text.

Graded ratings 0..K-1 share one weight vector over hashed features; K-1 ordered
thresholds cut the score: P(grade >= k) = sigmoid(score - threshold_k). Features
are the distinct lower-cased words of a text and their beginnings, and the shares of
its word shapes (letters, digits and signs with runs shortened); those that tell
no grades apart in the sample get no weight. Words may only lower the score, so a
long text gains nothing from its length. The fit sees at most
``max_rows`` labelled rows, those with the smallest seeded hash of their id;
scoring covers every row.

Defined results: a text without a word (null, empty, blank) has expected grade
and tail probability 0 and is rejected; without any labelled row nothing is known
and every text with a word is kept; labels with a null rating are left out;
several ratings of one id count each, as do several rows of one id; of rows with equal
hashes the sample takes the smaller id, then the smaller rating; very long texts and
words are taken whole; an empty table gives an empty result; one output row per input row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WORD, hashed, release, slices

BITS = 18
#: Word features take the buckets below, shape features those from here on.
SHAPES = 3 << (BITS - 2)
#: Features seen in fewer sampled documents, or whose means on the two sides of no
#: threshold differ by so many standard errors, carry no weight.
MIN_DOCS, MIN_Z = 8, 4.0
_WORDS = re.compile(WORD)
#: White space that ``str.split`` knows and the engine's words don't.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_RUNS = re.compile(r"(\W|_)\1+")
_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_a-zß-öø-ÿ]{2,}"), re.compile(r"[a-zß-öø-ÿ]+"), re.compile(r"\d+")


def bucket(feature: str) -> int:
    """Words share the lower three quarters of the buckets, shapes the last quarter."""
    h = xxhash.xxh32_intdigest(feature.encode("utf-8", "surrogatepass"))
    return SHAPES + h % (SHAPES // 3) if feature[0] == "s" else h % SHAPES


def shape(word: str) -> str:
    """Pattern of a whole word: runs of small letters, capitals, digits and equal signs shortened."""
    return _RUNS.sub(r"\1\1", _DIGIT.sub("0", _LOWER.sub("a", _UPPER.sub("AA", word))))


def words_of(text: str | None) -> list[str]:
    """The engine's words: only blank and U+0009..U+000D part them."""
    if not text:
        return []
    return _WORDS.findall(text) if _OTHER_SPACE.search(text) else text.split()


def repeated(words: list[str]) -> float:
    """Share of the words that equal the word before."""
    return sum(map(eq, words, words[1:])) / len(words) if words else 0.0


def word_buckets(word: str) -> list[int]:
    """Of the whole word and of its first four and five letters."""
    return [bucket("w:" + word), *(bucket(f"p:{word[:k]}") for k in (4, 5) if len(word) > k)]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text."""
    words = words_of(text)
    found: dict[int, float] = {}
    for w in set(map(str.lower, words)):
        for b in word_buckets(w):
            found[b] = found.get(b, 0.0) + 1.0
    for w in words:
        b = bucket("s:" + shape(w))
        found[b] = found.get(b, 0.0) + SHAPE_WEIGHT / len(words)
    if same := repeated(words):
        found[bucket("s=")] = SHAPE_WEIGHT * same
    return np.fromiter(found, np.int32, len(found)), np.fromiter(found.values(), np.float32, len(found))


#: Scale of the shape shares against the word indicators.
SHAPE_WEIGHT = 10.0


@dataclass(frozen=True)
class Model:
    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def tails(self, score: float) -> list[float]:
        """P(grade >= k) for k = 1, 2, ..."""
        return [1 / (1 + math.exp(min(60.0, max(-60.0, t - score)))) for t in self.thresholds]


def cuts_of(theta: np.ndarray) -> np.ndarray:
    """Ordered thresholds from the first one and the logarithms of the gaps."""
    return theta[0] + np.concatenate([[0], np.cumsum(np.exp(theta[1:]))])


def likelihood(
    x: np.ndarray, n_weights: int, cols: np.ndarray, vals: np.ndarray, doc: np.ndarray, y: np.ndarray, grades: int, l2: float
) -> tuple[float, np.ndarray]:
    """Mean penalised negative log-likelihood of the cumulative-link model, and its gradient.

    ``x`` holds the weights, then the thresholds as ``cuts_of`` reads them; feature ``cols[i]``
    has the value ``vals[i]`` in row ``doc[i]``.
    """
    n, w, theta = len(y), x[:n_weights], x[n_weights:]
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    cuts = np.concatenate([[-np.inf], cuts_of(theta), [np.inf]])
    score = np.bincount(doc, weights=vals * w[cols], minlength=n)
    low, high = sig(score - cuts[y]), sig(score - cuts[y + 1])  # P(>= y), P(>= y + 1)
    low, high = np.where(y == 0, 1.0, low), np.where(y == grades - 1, 0.0, high)
    p = np.maximum(low - high, 1e-9)
    dl, dh = low * (1 - low), high * (1 - high)
    ds = -(dl - dh) / p / n
    grad = np.empty_like(x)
    grad[:n_weights] = np.bincount(cols, weights=vals * ds[doc], minlength=n_weights) + l2 * w / n
    dcut = np.zeros(grades + 1)
    np.add.at(dcut, y, dl / p / n)
    np.add.at(dcut, y + 1, -dh / p / n)
    inner = dcut[1:grades]
    grad[n_weights] = inner.sum()
    for k in range(1, grades - 1):
        grad[n_weights + k] = inner[k:].sum() * math.exp(theta[k])
    return float(-np.log(p).sum() / n + l2 * (w * w).sum() / 2 / n), grad


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int, steps: int = 250, l2: float = 0.5) -> Model:
    """Penalised maximum likelihood by full-batch Adam; deterministic for given rows."""
    if not rows:
        return Model({}, (-60.0,) * (grades - 1))
    y = np.array([g for g, _, _ in rows])
    sizes = np.array([len(b) for _, b, _ in rows])
    cols, vals = np.concatenate([b for _, b, _ in rows]), np.concatenate([v for _, _, v in rows]).astype(np.float64)
    doc = np.repeat(np.arange(len(rows)), sizes)
    seen = np.bincount(cols, minlength=1 << BITS)
    size = 1 << BITS
    one, two = np.bincount(cols, vals, size), np.bincount(cols, vals * vals, size)
    spread = np.maximum(two / len(y) - (one / len(y)) ** 2, 1e-12)
    z = np.zeros(size)
    shapes = np.arange(size) >= SHAPES
    for k in range(1, grades):
        up = (y >= k)[doc]
        n1 = max(1, int((y >= k).sum()))
        n0 = max(1, len(y) - int((y >= k).sum()))
        above = np.bincount(cols, vals * up, size)
        step = (above / n1 - (one - above) / n0) / np.sqrt(spread * (1 / n1 + 1 / n0))
        z = np.maximum(z, np.where(shapes, np.abs(step), -step))
    fine = (seen[cols] >= MIN_DOCS) & (z[cols] >= MIN_Z)
    cols, vals, doc = cols[fine], vals[fine], doc[fine]
    used, cols = np.unique(cols, return_inverse=True)
    w = np.zeros(len(used))
    roof = np.where(used >= SHAPES, np.inf, 0.0)  # words only ever lower the score
    share = np.clip([np.mean(y >= k) for k in range(1, grades)], 0.01, 0.99)
    first, gaps = np.log(1 / share[0] - 1), np.diff(np.log(1 / share - 1))
    theta = np.concatenate([[first], np.log(np.maximum(gaps, 0.05))])  # threshold 1 and log gaps
    x = np.concatenate([w, theta])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        _, grad = likelihood(x, len(used), cols, vals, doc, y, grades, l2)
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        rate = 0.1 * (1 - 0.9 * step / steps)
        x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        x[: len(used)] = np.minimum(x[: len(used)], roof)
    w, theta = x[: len(used)], x[len(used) :]
    cuts = cuts_of(theta)
    return Model({int(b): float(c) for b, c in zip(used, w) if c}, tuple(map(float, cuts)))


class Scorer:
    """Scores whole texts; the memo of words is bounded."""

    def __init__(self, model: Model, limit: int = 150_000):
        self.model, self.limit = model, limit
        self.word: dict[str, float] = {}
        self.shaped: dict[str, float] = {}

    def _word(self, w: str) -> float:
        weight = self.model.weights.get
        return math.fsum(weight(b, 0.0) for b in word_buckets(w))

    def _shape(self, w: str) -> float:
        return SHAPE_WEIGHT * self.model.weights.get(bucket("s:" + shape(w)), 0.0)

    @staticmethod
    def _sum(keys, memo: dict[str, float], make, limit: int) -> float:
        keys = list(keys)
        found = list(map(memo.get, keys))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    key = keys[i]
                    x = memo.get(key)
                    if x is None:
                        x = make(key)
                        if len(memo) >= limit:
                            memo.clear()
                        if len(key) <= 64:
                            memo[key] = x
                    found[i] = x
        return math.fsum(found)

    def score(self, text: str | None) -> float | None:
        words = words_of(text)
        if not words:
            return None
        distinct = sorted(set(map(str.lower, words)))
        return (
            self._sum(distinct, self.word, self._word, self.limit)
            + self._sum(words, self.shaped, self._shape, self.limit) / len(words)
            + SHAPE_WEIGHT * self.model.weights.get(bucket("s="), 0.0) * repeated(words)
        )


def train(
    docs: DataFrame,
    labels: DataFrame,
    grade: Column,
    grades: int,
    *,
    max_rows: int = 6_000,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Fit on at most ``max_rows`` labelled rows; only their features reach the driver."""
    rated = labels.select(F.col(id_col).alias("_id"), grade.cast("int").alias("_grade")).filter(
        F.col("_grade").between(0, grades - 1) & F.col("_id").isNotNull()
    )
    sample = rated.orderBy(hashed("_id", seed=seed), "_id", "_grade").limit(max_rows)
    id_type = docs.schema[id_col].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in slices(batch, 2):
                found = [features(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([b.tolist() for b, _ in found], pa.list_(pa.int32())),
                        pa.array([v.tolist() for _, v in found], pa.list_(pa.float32())),
                    ],
                    ["_id", "_grade", "b", "v"],
                )
        release()

    got = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .join(F.broadcast(sample), "_id")
        .select("_id", "_grade", "_text")
        .mapInArrow(extract, f"_id {id_type}, _grade int, b array<int>, v array<float>")
        .toArrow()
    )
    got = got.combine_chunks()
    lists = [got.column(k).combine_chunks() for k in (2, 3)] if got.num_rows else []
    ids, rated = got.column(0).to_pylist(), got.column(1).to_pylist()

    def part(k: int, i: int) -> np.ndarray:
        return lists[k][i].values.to_numpy()

    order = sorted(range(got.num_rows), key=lambda i: (ids[i], rated[i], part(0, i).tobytes()))
    return fit([(rated[i], part(0, i), part(1, i)) for i in order], grades)


def grade_texts(
    docs: DataFrame,
    model: Model,
    *,
    min_tail: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with expected_grade, tail_probability (of the top grade) and kept added.

    Columns of ``docs`` that have one of these names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = ["expected_grade", "tail_probability"]
    rest = [f for f in docs.schema.fields if f.name not in (*names, "kept")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", expected_grade double, tail_probability double"
    at = [f.name for f in rest].index(text_col)
    width = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scorer = Scorer(held.value)
        for batch in batches:
            for part in slices(batch, at, 4 << 20):
                scores = [scorer.score(t) for t in part.column(at).to_pylist()]
                tails = [[0.0] * len(scorer.model.thresholds) if s is None else scorer.model.tails(s) for s in scores]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(i) for i in range(width)),
                        pa.array([math.fsum(t) for t in tails], pa.float64()),
                        pa.array([t[-1] for t in tails], pa.float64()),
                    ],
                    [f.name for f in rest] + names,
                )
        del scorer
        release()

    out = docs.select(*(f"`{f.name}`" for f in rest)).mapInArrow(run, schema)
    return out.withColumn("kept", F.col("tail_probability") >= min_tail)
