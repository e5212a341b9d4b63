"""Token counts, piece codec, substring dedup, n-gram join, line rules."""

import math
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarry.llm import ngram_join as nj
from quarry.llm.line_rules import line_rules
from quarry.llm.ngram_join import banding, ngram_join
from quarry.llm.piece_codec import PieceCodec, encode_decode
from quarry.llm.substring_dedup import substring_dedup
from quarry.llm.token_counts import Counter, token_counts

from . import brute

ODD = [
    "", " ", "  ", "\n", "\n\n a", "   \t  b\n  ", "a  b", "  a b ", "▁x y", "\x00é", "<s>a</s>", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>",
    "it's  \n\n x\t\ty  ", "日本語 𐥀 ab՘c", "\r\n\x0b\x85 　x", "a" * 3000, " " * 1000, "x" + " " * 37 + "y", "😀👍🏽", "<0x0A>", "a\n\t\tb",
]


def noise(seed, n, letters):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(60)) for _ in range(n)]


LETTERS = "ab é\n\t'st1９ñ日😀‍̀ ▁  thein"


def test_token_counts_equal_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ODD + noise(1, 400, LETTERS)
    want = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    counter = Counter(path, cache=50)
    assert [counter.count(t) for t in texts] == want
    assert counter.count(None) == 0
    assert {" the", "a"} <= counter.whole


def test_token_counts_of_long_words_equal_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    r = random.Random(7)
    texts = ["".join(r.choice("abcdeté") for _ in range(300_000)), "a" * 200_001, "ab" * 50_000, "!" * 70_000, " " * 50_000, "日" * 20_000]
    library, counter = Tokenizer.from_file(path), Counter(path)
    assert [counter.count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_counts_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "é x", 5), (3, "é x", 5), (4, "hi " * 1100, 5)], "doc_id long, text string, n_tokens int")
    docs = docs.withColumn("_id", F.lit("clash")).withColumn("n_bytes", F.lit(None))
    got = sorted(map(tuple, token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()))
    assert got[:2] == [(1, 0, 0, False), (2, 0, 0, False)] and got[2] == got[3] and got[2][1] == 4 and got[4][3]
    assert token_counts(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    return PieceCodec(path, cache=100), sentencepiece.SentencePieceProcessor(model_file=path)


def test_pieces_equal_the_library_and_come_back(pieces):
    own, library = pieces
    r = random.Random(2)
    keys = list(own.ids)
    texts = ODD + noise(3, 600, LETTERS) + noise(4, 300, "etaoinshrdlu ") + ["".join(r.choice(keys) for _ in range(20)) for _ in range(400)]
    encoded = [own.encode(t) for t in texts]
    assert encoded == library.encode(texts, num_threads=1)
    assert [own.decode([*x, 2]) for x in encoded] == [library.decode([*x, 2]) for x in encoded]
    assert [own.decode(x) for x in encoded] == [t.replace("▁", " ") for t in texts]


def test_decoding_of_any_ids(pieces):
    own, library = pieces
    r = random.Random(5)
    for _ in range(300):
        ids = [r.randrange(3, 300) for _ in range(9)]
        assert own.decode(ids) == library.decode(ids)


def test_piece_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b")], "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("_text", F.lit("clash"))
    assert encode_decode(docs.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    got = sorted((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")).collect())
    assert got == [(1, (2,), ""), (2, (2,), ""), (3, (264, 287, 2), "a b"), (3, (264, 287, 2), "a b")]


def test_substrings_equal_brute_force(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["a", "b", "é", "x\ty", "\n"]) for _ in range(r.randrange(0, 90)))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "a " * 40), (903, "a " * 40), (904, "long " + "w " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash")).repartition(3)
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_text) for x in substring_dedup(docs).collect()}
    assert got == brute.substring(rows)
    assert substring_dedup(docs.limit(0)).count() == 0


def test_substring_rows_that_share_an_id_are_cut_each_on_its_own(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b + " " + c), (None, c), (None, c), (4, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((x.doc_id, x.text, x.n_words, x.n_removed, x.kept_text) for x in substring_dedup(docs, keep=("text",)).collect()), key=repr)
    want = [(1, a, 30, 0, a), (2, a, 30, 30, ""), (2, b, 30, 0, b), (2, b, 30, 0, b), (3, b + " " + c, 60, 30, c)]
    want += [(None, c, 30, 30, "")] * 2 + [(4, None, 0, 0, "")] * 2
    assert got == sorted(want, key=repr)


def test_substrings_of_a_hot_passage_and_of_long_texts(spark):
    r = random.Random(11)
    hot = " ".join(f"h{i}" for i in range(40))
    words = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    rows = [(i, f"{words(r.randrange(30))} {hot} {words(r.randrange(30))}") for i in range(400)]
    long = words(150_000)
    rows += [(500, long), (501, "x " + long[1000:]), (502, words(40) + " " + long[5000:9000]), (503, "y" * 400_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_text) for x in substring_dedup(docs, block_bytes=20_000).collect()}
    assert got == brute.substring(rows)


def test_substring_spans_are_maximal(spark):
    a = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, a), (2, "x " + a + " y"), (None, a)], "doc_id long, text string")
    got = {x.doc_id: [(s["start"], s["end"]) for s in x.spans] for x in substring_dedup(docs, keep=("text",)).collect()}
    assert got == {1: [], 2: [(1, 21)], None: [(0, 20)]}


def edits(seed):
    r = random.Random(seed)

    def edit(t, k):
        w = t.split()
        for _ in range(k):
            w[r.randrange(len(w))] = f"zz{r.randrange(999)}"
        return " ".join(w)

    base = [" ".join(f"w{r.randrange(300)}" for _ in range(r.randrange(1, 200))) for _ in range(40)]
    rows = list(enumerate(base)) + [(100 + i, edit(r.choice(base), r.randrange(0, 4))) for i in range(120)]
    rows += [(900, None), (901, ""), (902, "a b"), (903, "a  b"), (904, "a b c d e"), (905, " ")]
    big = " ".join(f"q{r.randrange(300)}" for _ in range(150))
    return rows + [(1000 + i, edit(big, r.randrange(0, 3))) for i in range(150)]


@pytest.mark.parametrize("tile", [32, 256])
def test_ngram_join_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(nj, "TILE", tile)
    monkeypatch.setattr(nj, "VERIFY_TILE", tile)
    monkeypatch.setattr(nj, "VERIFY_BYTES", 100 * tile)
    rows = edits(3)
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string").withColumn("v", F.lit(1)).repartition(3)).collect()
    assert sorted((x.doc_id, x.n_links, x.component_id, x.kept) for x in got) == brute.jaccard(rows)


def test_ngram_join_of_equal_rows_keeps_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (3, None)], "doc_id long, text string")
    got = sorted((x.doc_id, x.n_links, x.kept) for x in ngram_join(docs).collect())
    assert got == [(1, 2, False), (1, 2, True), (2, 2, False), (3, 0, True), (3, 0, True)]
    assert ngram_join(docs.limit(0)).count() == 0


def test_banding_reaches_the_recall():
    bands, rows = banding(0.8, 0.999999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999999 > 1 - (1 - 0.8**rows) ** (bands - 1)
    more = math.ceil(math.log(1e-6) / math.log(1 - 0.8 ** (rows + 1)))
    assert bands * rows <= 128 < more * (rows + 1)


def test_ngram_join_of_long_texts_and_its_recall(spark):
    r = random.Random(12)
    long = [f"w{r.randrange(9000)}" for _ in range(60_000)]
    near = long[:30_000] + ["x"] * 200 + long[30_200:]
    texts = [" ".join(long), " ".join(near), " ".join(long[:20_000]), "z" * 300_000, "z" * 300_000, "a " * 50_000]
    rows = [(2000 + i, t) for i, t in enumerate(texts)] + edits(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_join(docs, block_bytes=50_000)
    assert sorted((x.doc_id, x.n_links, x.component_id, x.kept) for x in got.collect()) == brute.jaccard(rows)
    assert nj.measured_recall(docs, got, every=5) == 1.0
    assert nj.measured_recall(docs, got.withColumn("n_links", F.lit(0)), every=5) == 0.0


def line_truth(rows, share, least, max_lost, min_words):
    """(id, lost words, kept) per row by the definition, for documents with ids."""
    norm = lambda line: " ".join(brute.WORDS.findall(line)).lower()
    lines = [[norm(x) for x in (t or "").split("\n") if brute.WORDS.search(x)] for _, _, t in rows]
    docs, held = {}, {}
    for (i, host, _), own in zip(rows, lines):
        docs.setdefault(host, set()).add(i)
        for x in own:
            held.setdefault((host, x), set()).add(i)
    out = []
    for (i, host, t), own in zip(rows, lines):
        words = brute.WORDS.findall(t or "")
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        twice = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
        lost = sum(len(x.split(" ")) for x in own if len(held[host, x]) > max(least, share * len(docs[host])))
        fine = len(words) >= 50 and 100 * len(twice) <= 50 * len(words)
        out.append((i, lost, fine and not (lost and (len(words) - lost < min_words or lost > max_lost * len(words)))))
    return sorted(out)


def test_line_rules_equal_their_definition_where_they_decide(spark):
    r = random.Random(13)
    common = [" ".join(f"c{k}x{j}" for j in range(r.randrange(5, 30))) for k in range(8)]
    rows = []
    for i in range(400):
        lines = [r.choice(common).title() for _ in range(r.choice([0, 0, 1, 3]))] + [" ".join(f"w{r.randrange(3000)}" for _ in range(r.randrange(1, 40))) for _ in range(r.randrange(0, 5))]
        r.shuffle(lines)
        rows.append((i, r.choice(["a", "a", "b", None]), "\n".join(lines)))
    rows += [(500, "a", None), (501, "a", ""), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("kept", F.lit(1)).repartition(3)
    want = line_truth(rows, 0.05, 4, 0.5, 20)
    got = line_rules(docs, max_share=0.05, min_docs=4, max_lost=0.5).collect()
    assert sorted((x["doc_id"], x["n_lost_words"], x["kept"]) for x in got) == want
    depleted = [x for x in got if not x["kept"] and not x["base_failed"]]
    assert len(depleted) > 20 and sum(x["kept"] for x in got) > 20
    assert line_rules(docs.limit(0)).count() == 0


def test_line_rules_of_very_long_texts(spark):
    rows = [(1, "s", " ".join(f"w{i}" for i in range(200_000))), (2, "s", "x" * 1_000_000 + "\n"), (3, "s", "a b c\n" * 50_000)]
    got = {x["doc_id"]: x for x in line_rules(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got[1]["kept"] and got[1]["n_words"] == 200_000 and got[2]["base_failed"] and got[3]["n_repeat_words"] == 150_000 and got[3]["n_dup_lines"] == 49_999


def test_line_rules(spark):
    text = lambda k: "\n".join(" ".join(f"{k}w{i}x{j}" for j in range(20)) for i in range(5))
    notice = "All Rights  reserved by the owner of this page"
    rows = [(i, "s", text(i) + "\n" + notice) for i in range(30)]
    rows += [(100 + i, "s", "\n".join([notice.upper()] * 8) + f"\nonly {i}") for i in range(5)]
    rows += [(300, "s", None), (301, None, ""), (302, None, "a b a b a b " * 20), (303, None, text("z")), (303, None, text("z"))]
    rows += [(None, None, text("y"))] * 11 + [(400, "t", text("copy"))] * 40
    got = {}
    for r in line_rules(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert all(got[i][0]["kept"] and got[i][0]["n_lost_words"] == 9 for i in range(30))
    assert not any(got[100 + i][0]["kept"] for i in range(5))
    assert len(got[400]) == 40 and all(x["kept"] for x in got[400])  # one document
    assert len(got[None]) == 11 and not any(x["kept"] for x in got[None])  # eleven documents
    assert [got[i][0]["base_failed"] for i in (300, 301, 302)] == [True] * 3 and len(got[303]) == 2
    assert got[302][0]["n_repeat_words"] == got[302][0]["n_words"] == 120 and got[100][0]["n_dup_lines"] == 7
