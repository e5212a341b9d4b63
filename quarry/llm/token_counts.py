"""Token counts of a byte-level BPE vocabulary by the whole-token shortcut.

Offline, once per vocabulary, every vocabulary string is encoded by the merge
rules alone; those that come back as exactly one token are *proved*. A
pre-token that equals a proved string counts one without any merging; only the
others run the merges (a queue of pairs, n log n in a pre-token's length), and each
distinct one once per worker and cache generation.

Defined results: a null text counts as empty (0 bytes, 0 tokens); blank and
very long texts are whole, never truncated; added special strings that occur in
a text count one token each, as the library does by default; extra columns, whatever
their names, are left out, repeated rows stay (one output row per input row); an
empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import release, slices, worker_state

#: Splits a text before the merges (fixed value of the byte-level vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Entries of one cache generation; two generations are alive at a time.
CACHE = 300_000


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """Printable stand-in of every byte: printable Latin-1 stays, the rest is moved up."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    moved = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(moved)}


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Apply the merge rules, lowest rank first, leftmost first.

    A queue holds every pair that a rule merges, ordered by (rank, place); neighbours
    are linked, so a pre-token of n symbols takes n log n steps. Entries whose place
    has changed since are skipped.
    """
    n = len(symbols)
    rank = ranks.get
    queue = [r * n + i for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := rank(pair)) is not None]
    if not queue:
        return symbols
    heapify(queue)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    part: list[str | None] = list(symbols)
    while queue:
        due, i = divmod(heappop(queue), n)
        j = after[i]
        if part[i] is None or j == n or rank((part[i], part[j])) != due:
            continue
        part[i], part[j] = part[i] + part[j], None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := rank((part[i], part[k]))) is not None:
                heappush(queue, r * n + i)
        if (h := before[i]) >= 0 and (r := rank((part[h], part[i]))) is not None:
            heappush(queue, r * n + h)
    return [p for p in part if p is not None]


class Vocabulary:
    """Merge ranks, proved whole tokens and added strings of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pairs = (m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.letters = byte_letters()
        self.table = {ord(chr(b)): s for b, s in self.letters.items()}
        self.added = [a["content"] for a in spec.get("added_tokens") or []]
        self.vocab = model["vocab"]

    def symbols(self, piece: str) -> list[str]:
        return list(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table))

    def proved(self) -> frozenset[str]:
        """The texts that the merge rules alone turn into one vocabulary token."""
        back = {s: b for b, s in self.letters.items()}
        out = set()
        for token in self.vocab:
            if not all(c in back for c in token) or len(merged(list(token), self.ranks)) != 1:
                continue
            try:
                out.add(bytes(back[c] for c in token).decode("utf-8"))
            except UnicodeDecodeError:
                continue
        return frozenset(out)


class Cache(dict):
    """Bounded memo of a pure function: two generations, the older dropped when the newer fills."""

    def __init__(self, make, limit: int = CACHE):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> int:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Counter:
    """Counts tokens of whole texts; per-worker state, memory bounded by the caches."""

    def __init__(self, path: str, proved: Iterable[str] | None = None, cache: int = CACHE):
        self.vocabulary = Vocabulary(path)
        self.whole = frozenset(self.vocabulary.proved() if proved is None else proved)
        self.findall = regex.compile(PATTERN).findall
        added = sorted(self.vocabulary.added, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.splitter = None
        self.path = path
        self.bare = Cache(self.segment, cache // 8)
        self.spaced = Cache(lambda chunk: self.segment(" " + chunk), cache)
        self.newline = self.segment("\n")

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of ``text``.

        Code points this Python's Unicode tables don't know may belong to another
        class in the library's, so texts that hold any are split by the library.
        """
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text)):
            if self.splitter is None:
                from tokenizers import Tokenizer

                self.splitter = Tokenizer.from_file(self.path).pre_tokenizer
            return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]
        return self.findall(text)

    def piece(self, piece: str) -> int:
        """Tokens of one pre-token: one if proved whole, else what the merges leave."""
        return 1 if piece in self.whole else len(merged(self.vocabulary.symbols(piece), self.vocabulary.ranks))

    def segment(self, text: str) -> int:
        return sum(map(self.piece, self.pieces(text)))

    def plain(self, text: str) -> int:
        """Tokens of a text without added strings.

        A pre-token never holds a blank or line feed after another character, so
        where all white space is single blanks and line feeds the text falls apart
        into chunks that are counted on their own.
        """
        if text.replace("\n", " ").split(" ") != text.split():
            return self.segment(text)
        lines = text.split("\n")
        total = self.newline * (len(lines) - 1)
        spaced, bare = self.spaced.__getitem__, self.bare
        for line in lines:
            chunks = line.split(" ")
            total += bare[chunks[0]]
            del chunks[0]
            total += sum(map(spaced, chunks))
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        found = len(self.special.findall(text))
        return found + sum(self.plain(part) for part in self.special.split(text) if part)


def _counter(path: str, proved: frozenset[str]) -> Counter:
    state = worker_state("token_counts")
    if path not in state:
        state.clear()
        state[path] = Counter(path, proved)
    return state[path]


def token_counts(
    docs: DataFrame,
    vocabulary: str,
    *,
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    ``vocabulary`` is the path of a byte-level BPE file every machine has. No
    shuffle: the map side reads two columns and returns fixed-size rows. The
    proved strings are broadcast; their number is at most the vocabulary's.
    """
    sc = docs.sparkSession.sparkContext
    proved = sc.broadcast(Vocabulary(vocabulary).proved())
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keep="token_counts")
        counter = _counter(vocabulary, proved.value)
        for batch in batches:
            for part in slices(batch, 1):
                sizes = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
                counts = pa.array([counter.count(t) for t in part.column(1).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, counts], ["_id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        run, f"_id {id_type}, n_bytes long, n_tokens long"
    )
    return counted.select(
        F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
