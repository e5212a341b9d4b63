"""SentencePiece encoding and decoding by a merge-type prefix table.

A piece model of the merge type joins, again and again, the adjacent pair whose
concatenation is the best-scored piece. The result has two properties: the
encoding of a prefix has one last token, and a token sequence is an encoding
exactly if every adjacent pair of it is (``compatible``). So one left-to-right
pass suffices: at each position an automaton lists the pieces that end there,
the pair test against the last token of the remaining prefix leaves one, and
that one is stored. Reading the table backwards from the end gives the ids, in
time linear in the text whatever its length.

Runs of several blanks are joined directly: their pieces share one score, and
ties break the second property.

Defined results: null text encodes as the empty text; characters that are no
piece become their UTF-8 bytes' pieces; control strings inside a text are plain
text; decoding replaces bytes that form no UTF-8 by U+FFFD; very long texts are whole;
an empty table gives an empty result; columns with clashing names are ignored; one output row per
input row, repeated rows included.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import release, slices, worker_state

BLANK = "▁"
CACHE = 200_000


def _one_by_one(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("quarry-bytewise", _one_by_one)


class Memo(dict):
    """Bounded memo of a pure function, two generations deep."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class PieceCodec:
    """Vocabulary, automaton and pair tests of a merge-type piece model."""

    def __init__(self, model: str, cache: int = CACHE):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=model)  # read for its vocabulary only
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_id = [0] * 256
        self.shown: list[str] = []
        self.control: set[int] = set()
        for i in range(own.vocab_size()):
            piece = own.id_to_piece(i)
            if own.is_control(i):
                self.shown.append("")
                self.control.add(i)
            elif own.is_unknown(i):
                self.shown.append(" ⁇ ")
            elif own.is_byte(i):
                b = int(piece[1:-1], 16)
                self.byte_id[b] = i
                self.shown.append(chr(b) if b < 128 else chr(0xDC00 + b))
            else:
                self.ids[piece] = i
                self.score[piece] = own.get_score(i)
                self.shown.append(piece.replace(BLANK, " "))
        self.end_id = own.eos_id()
        self.normal = frozenset(self.ids.values())
        self.text_of = {i: p for p, i in self.ids.items()}
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece crosses a blank: not a model that splits at blanks")
        self.cut_lines = not any("\n" in p for p in self.ids)
        self.newline = self.byte_id[10]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.bare = Memo(self.unit, cache // 8)
        self.spaced = Memo(lambda word: self.unit(BLANK + word), cache)

    # -- joining by scores -------------------------------------------------

    def joined(self, text: str) -> list[str]:
        """The merge process itself: best score first, leftmost first among equals."""
        if len(text) > 48:
            return self._joined_long(text)
        score, parts = self.score.get, list(text)
        low = float("-inf")
        due = [score(a + b, low) for a, b in zip(parts, parts[1:])]
        while due:
            best = max(due)
            if best == low:
                break
            i = due.index(best)
            parts[i] += parts[i + 1]
            del parts[i + 1], due[i]
            if i < len(due):
                due[i] = score(parts[i] + parts[i + 1], low)
            if i:
                due[i - 1] = score(parts[i - 1] + parts[i], low)
        return parts

    def _joined_long(self, text: str) -> list[str]:
        """The same over a heap of pairs and a linked list: n log n."""
        score, n = self.score.get, len(text)
        part: list[str | None] = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (s := score(both := part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, both))

        for i in range(n):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if part[i] is None or (j := after[i]) >= n or len(part[i]) + len(part[j]) != len(both) or part[i] + part[j] != both:
                continue
            part[i], part[j] = both, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in part if p is not None]

    # -- the prefix table --------------------------------------------------

    def stands_alone(self, i: int) -> bool:
        held = self.alone.get(i)
        if held is None:
            held = self.alone[i] = len(self.joined(self.text_of[i])) == 1
        return held

    def compatible(self, a: int, b: int) -> bool:
        """Whether the texts of a and b, put together, encode as a, b."""
        held = self.pairs.get((a, b))
        if held is None:
            if len(self.pairs) >= 300_000:
                self.pairs.clear()
            left, right = self.text_of[a], self.text_of[b]
            held = self.pairs[a, b] = self.joined(left + right) == [left, right]
        return held

    def unit(self, text: str) -> tuple[int, ...]:
        """Ids of a stretch that no piece crosses."""
        if not text:
            return ()
        if text.startswith(BLANK * 2):
            found: list[int] = []
            for part in self.joined(text):
                i = self.ids.get(part)
                found.extend([i] if i is not None else [self.byte_id[b] for b in part.encode()])
            return tuple(found)
        n = len(text)
        last = [-1] * (n + 1)  # id of the last token of each prefix; -1: none, a character of bytes
        size = [1] * (n + 1)
        pairs, alone = self.pairs, self.alone
        for end, (i, length) in self.automaton.iter(text):
            if last[end + 1] >= 0:
                continue
            left = last[end + 1 - length]
            if left < 0:
                fits = alone.get(i)
                if fits is None:
                    fits = self.stands_alone(i)
            else:
                fits = pairs.get((left, i))
                if fits is None:
                    fits = self.compatible(left, i)
            if fits:
                last[end + 1], size[end + 1] = i, length
        back: list[int] = []
        at = n
        while at:
            if last[at] < 0:
                back.extend(self.byte_id[b] for b in reversed(text[at - 1].encode()))
            else:
                back.append(last[at])
            at -= size[at]
        back.reverse()
        return tuple(back)

    # -- whole texts -------------------------------------------------------

    def _line(self, line: str) -> Iterable[tuple[int, ...]]:
        words = line.split(BLANK)
        if "" in words[1:-1] or len(words) > 2 and words[-1] == "" == words[-2]:
            return map(self.unit_of_run, re.findall(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", line))
        return chain((self.bare[words[0]],), map(self.spaced.__getitem__, words[1:]))

    def unit_of_run(self, text: str) -> tuple[int, ...]:
        if text.startswith(BLANK) and not text.startswith(BLANK * 2):
            return self.spaced[text[1:]]
        return self.bare[text]

    def encode(self, text: str | None, end: bool = False) -> list[int]:
        """Ids of the whole text; with ``end`` the end id follows."""
        found: list[int] = []
        if text:
            whole = BLANK + text.replace(" ", BLANK)
            for k, line in enumerate(whole.split("\n") if self.cut_lines else [whole]):
                if k:
                    found.append(self.newline)
                if line:
                    found.extend(chain.from_iterable(self._line(line)))
        if end:
            found.append(self.end_id)
        return found

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids; the blank put before a text is taken away again."""
        ids = list(ids)
        text = "".join(map(self.shown.__getitem__, ids))
        if text.startswith(" ") and next((i for i in ids if i not in self.control), -1) in self.normal:
            text = text[1:]
        if text.isascii():
            return text
        try:
            text.encode("utf-8")
            return text
        except UnicodeEncodeError:
            return text.encode("utf-8", "surrogateescape").decode("utf-8", "quarry-bytewise")


def codec(model: str) -> PieceCodec:
    """The worker's codec of a model file; one at a time is kept."""
    held = worker_state("piece_codec")
    if model not in held:
        release("piece_codec")
        held.clear()
        held[model] = PieceCodec(model)
    return held[model]


def encode_decode(
    docs: DataFrame,
    model: str,
    *,
    end: bool = True,
    decoded: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, ids array<int>[, decoded string]) for every row of ``docs``.

    No shuffle; Python holds one slice of a batch (about 4 MB of text) at a time.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                encoded = [np.array(own.encode(t, end), np.int32) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, encoded)], dtype=np.int32)
                flat = np.concatenate(encoded) if encoded else np.zeros(0, np.int32)
                columns = [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if decoded:
                    columns.append(pa.array([own.decode(x.tolist()) for x in encoded], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["_id", "ids", "decoded"][: len(columns)])
        release("piece_codec")

    schema = f"_id {id_type}, ids array<int>" + ", decoded string" * decoded
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)
    return out.withColumnRenamed("_id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of what ``encode_decode`` returns."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
