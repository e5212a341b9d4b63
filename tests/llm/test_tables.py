"""Shards, embeddings, mixing, pages, classifier, pipeline."""

import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm import embedding_dedup as near
from quarry.llm.embedding_dedup import audit, embedding_dedup
from quarry.llm.html_extract import blocks, covered, decide, extract_main, furniture, suffix_order
from quarry.llm.mixing import RESERVE, fit, mix_sources, subset_sum, targets
from quarry.llm.ordinal import Model, Scorer, cuts_of, fit as fit_ordinal, features, grade_texts, likelihood, shape, train, words_of
from quarry.llm.shards import CommitConflict, Manifest, Shard, ShardStore

from . import brute

SF = "/root/testdata/sf0.01"


def test_shards_compact_by_tiers_and_keep_every_row(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=40_000, small_bytes=2_000)
    for k in range(9):
        store.append(spark.range(k * 100, k * 100 + 100).repartition(2))
    before = store.manifest()
    after = store.compact()
    assert len(after.shards) < len(before.shards) == 18 and sum(s.rows for s in after.shards) == 900
    assert sorted(r["id"] for r in store.read().collect()) == list(range(900))
    assert store.read(before.version).count() == 900
    with pytest.raises(CommitConflict):
        store._commit(Manifest(after.version - 1, after.schema, after.shards), after.schema, list(after.shards))
    assert store.manifest() == after
    store.append(spark.range(5).repartition(1))
    store.append(spark.range(5).repartition(1))
    store.vacuum()
    assert store.versions() == [after.version + 1, after.version + 2] and store.read().count() == 910
    with pytest.raises(ValueError):
        store.append(spark.range(1).withColumnRenamed("id", "other"))


def test_two_writers_of_a_store(spark, tmp_path, monkeypatch):
    one, two = (ShardStore(spark, f"file://{tmp_path}/s", target_bytes=40_000, small_bytes=2_000) for _ in range(2))
    one.append(spark.range(10).repartition(1))
    written = one._written  # the other writer commits between this one's look and its commit
    monkeypatch.setattr(one, "_written", lambda *a: (monkeypatch.setattr(one, "_written", written), two.append(spark.range(10, 20).repartition(4)), written(*a))[2])
    one.append(spark.range(20, 30).repartition(4))
    assert one.manifest().version == 3 and sorted(r["id"] for r in one.read().collect()) == list(range(30))
    monkeypatch.setattr(one, "plan", lambda m, plan=one.plan: (monkeypatch.undo(), two.compact(), plan(m))[2])
    merged = one.compact()
    assert merged == two.manifest() and sorted(r["id"] for r in one.read().collect()) == list(range(30))


def test_vacuum_removes_what_no_version_names(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", keep_versions=1)
    store.append(spark.range(10).repartition(2))
    spark.range(5).write.parquet(f"{tmp_path}/s/data/lost")  # a writer that never committed
    (tmp_path / "s/manifest/.draft-x").write_text("{")
    assert store.vacuum() == 0 and (tmp_path / "s/data/lost").exists()
    assert store.vacuum(grace_seconds=-5) >= 2
    assert not (tmp_path / "s/data/lost").exists() and not (tmp_path / "s/manifest/.draft-x").exists() and store.read().count() == 10
    store.drop()
    assert not (tmp_path / "s").exists()


def test_arrivals_in_one_pass_and_clashing_names(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 20)
    rows = spark.createDataFrame([(i, f"x{i}", "y" * 300_000 if i == 7 else None) for i in range(50)], "id int, shard string, part_ string").repartition(3)
    done = store.append_parts(rows, F.col("id") % 4)
    assert done.version == 4 and sum(s.rows for s in done.shards) == 50
    store.compact()
    got = store.located(["id", "shard", "part_"])
    assert got.columns == ["id", "shard", "part_", "shard_"]
    assert sorted((r["id"], r["shard"], len(r["part_"] or "")) for r in got.collect()) == [(i, f"x{i}", 300_000 * (i == 7)) for i in range(50)]
    assert {r["shard_"] for r in got.collect()} == {s.path for s in store.manifest().shards}
    assert store.append_parts(rows.limit(0), F.col("id")) == store.manifest()


def test_tiers_hold_similar_sizes_and_merges_end(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=100_000, small_bytes=1_000, fan_in=4)
    r = random.Random(10)
    for _ in range(200):
        shards = tuple(Shard(f"data/{k}", int(10 ** r.uniform(1, 5.5)), 1, 0, 1) for k in range(r.randrange(40)))
        total, steps = sum(s.bytes for s in shards), 0
        while step := store.plan(Manifest(1, "{}", shards)):
            run, files = step
            sizes = [s.bytes for s in run]
            assert max(sizes) < 50_000 and (max(sizes) <= 1_000 or max(sizes) <= 4 * min(sizes)) and 4 <= len(run) > files
            smaller = [s for s in shards if store.tier(s) < store.tier(run[0])]
            assert all(sum(store.tier(s) == t for s in smaller) < 4 for t in range(20))
            left = [s for s in shards if s not in run]
            shards = (*left, *(Shard(f"m{steps}-{k}", sum(sizes) // files, 1, 1, 1) for k in range(files)))
            steps += 1
        assert steps <= 40 and abs(sum(s.bytes for s in shards) - total) <= 40 * 40
        assert all(sum(store.tier(s) == t for s in shards if s.bytes < 50_000) < 4 for t in range(20))


def test_empty_store(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s")
    with pytest.raises(ValueError):
        store.read()
    store.append(spark.range(0))
    assert store.read().count() == 0 and store.compact().shards == () and store.located(["id"]).count() == 0
    store.append(spark.createDataFrame([(None,), (1,), (1,)], "id long"))
    assert store.located(["id"]).filter("shard != ''").count() == 3


def test_components_equal_brute_force(spark):
    r = random.Random(1)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(500, i) for i in range(501, 700)] + [(i, i + 1) for i in range(800, 840)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {x: find(x) for x in touched}


def cosine_truth(rows, threshold=0.93):
    unit = []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) if ok else None
        unit.append((label, x / np.linalg.norm(x)) if ok else None)

    def sim(a, b):
        x, y = unit[a], unit[b]
        return bool(x and y and x[0] == y[0] and len(x[1]) == len(y[1]) and x[1] @ y[1] >= threshold)

    return brute.linked(rows, sim)


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 8))
    rows = [(i, (base[rng.integers(30)] + rng.standard_normal(8) * rng.choice([0, 0.2, 0.35, 1])).tolist(), int(rng.integers(3))) for i in range(400)]
    rows += [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [1.0, None] * 4, 1), (1003, [float("nan")] * 8, 1), (1004, [1.0] * 8, None)]
    rows += [(1005, [1.0] * 8, None), (1006, [], 1), (1007, [1.0], 1), (1008, [2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit("clash")).repartition(3)
    got = embedding_dedup(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == cosine_truth(rows)
    assert got[0]["audit_recall"] == 1.0
    assert embedding_dedup(df.limit(0)).count() == 0


def test_full_lists_do_not_hide_links_of_nested_groups(spark):
    axes = np.eye(64)
    rows = []
    for side in range(2):  # within a side 0.99, across 0.935
        for i in range(20):
            v = 0.935**0.5 * axes[0] + 0.055**0.5 * axes[1 + side] + 0.01**0.5 * axes[3 + 20 * side + i]
            rows.append((20 * side + i, v.tolist(), 1))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {(r["n_links"], r["component_id"]) for r in embedding_dedup(df).collect()} == {(39, 0)}


def test_audit_sees_lost_pairs_beside_a_hot_group(spark, monkeypatch):
    r = np.random.default_rng(4)
    hot = np.eye(32)[0] + 0.01 * r.standard_normal((300, 32))
    rows = [(i, "hot", 1, x.tobytes()) for i, x in enumerate(hot)]
    for i, x in enumerate(r.standard_normal((40, 32))):
        rows += [(1000 + 2 * i + j, "pairs", 1, (x + 0.001 * j).tobytes()) for j in range(2)]
    classes = spark.createDataFrame([(v, p, c, bytearray(b)) for v, p, c, b in rows], "v long, part string, copies long, vec binary")
    whole = spark.createDataFrame([(v, 299 if v < 1000 else 1) for v, *_ in rows], "v long, links long")
    assert audit(classes, whole, 0.93, 4096, "<f8") == 1.0
    assert audit(classes, whole.filter("v < 1000"), 0.93, 4096, "<f8") == pytest.approx(300 / 380)

    monkeypatch.setattr(near, "search", lambda *_: spark.createDataFrame([], "v long, w long, sim double, place int"))
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(hot[:9])], "vec_id long, embedding array<double>, label int")
    with pytest.raises(RuntimeError, match="recall"):
        embedding_dedup(df)


def planted(seed, groups, size, spread, pairs):
    """Groups of ``size`` distinct vectors around centres, pairs, and lone vectors, with some equal rows."""
    r = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    vectors = []
    for _ in range(groups):
        vectors += list(unit(r.standard_normal(48)) + spread * unit(r.standard_normal((size, 48))))
    for x in unit(r.standard_normal((pairs, 48))):
        vectors += [x, x + 0.25 * unit(r.standard_normal(48)), unit(r.standard_normal(48))]
    vectors += [vectors[i] for i in r.integers(0, len(vectors), 40)]
    order = r.permutation(len(vectors))
    return [(int(i), vectors[j].tolist(), 1 + int(j) % 2 if j >= groups * size else 1) for i, j in enumerate(order)]


def test_links_of_saturated_lists_come_from_the_lists(spark, monkeypatch):
    rows = planted(3, 3, 90, 0.27, 60)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    monkeypatch.setattr(near, "pair_tiles", None)  # no component is compared whole
    got = embedding_dedup(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == cosine_truth(rows)
    assert max(r.n_links for r in got) > 60


def test_links_of_large_groups(spark):
    rows = planted(4, 2, 500, 0.26, 40)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = embedding_dedup(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == cosine_truth(rows)
    assert max(r.n_links for r in got) > 300


def shares(sizes, weights, share, cap):
    """Targets of sources in order by sharing again until none is above its cap."""
    names = sorted(sizes, key=lambda x: (x == "", x))
    weight = {x: weights[i % len(weights)] for i, x in enumerate(names)}
    full, left = set(), share * sum(sizes.values())
    while True:
        total = sum(weight[x] for x in names if x not in full)
        over = {x for x in names if x not in full and left * weight[x] / total > cap * sizes[x]}
        if not over:
            return {x: cap * sizes[x] if x in full else left * weight[x] / total for x in names}
        full |= over
        left = max(0.0, share * sum(sizes.values()) - cap * sum(sizes[x] for x in full))
        if len(full) == len(names):
            return {x: cap * sizes[x] for x in names}


def test_targets_equal_sharing_by_hand(spark):
    r = random.Random(15)
    cases = [{"=a": 100, "=b": 1000, "": 10}, {"=x": 0}, {"=x": 5, "": 0}, {f"=s{i}": int(10 ** r.uniform(0, 5)) for i in range(60)}]
    for sizes in cases:
        df = spark.createDataFrame(list(sizes.items()), "_key string, _size long").repartition(3)
        got = {x["_key"]: x["_target"] for x in targets(df, (5, 2, 1), 1.5, 2.0).collect()}
        assert got == pytest.approx(shares(sizes, (5, 2, 1), 1.5, 2.0))
    assert targets(df.limit(0), (5, 2, 1), 1.5, 2.0).count() == 0


def nearest(lengths, counts, budget):
    """The largest sum up to ``budget`` of at most so many of each length, by listing all sums."""
    sums = {0}
    for n, k in zip(lengths.tolist(), counts.tolist()):
        sums = {x + j * n for x in sums for j in range(k + 1) if x + j * n <= budget}
    return max(sums)


def test_fit_comes_as_near_as_brute_force():
    r = random.Random(6)
    for _ in range(150):
        lengths = np.array(sorted(r.sample(range(3, 90), r.randrange(1, 7))))
        counts = np.array([r.randrange(1, 30) for _ in lengths])
        total = int((lengths * counts).sum())
        budget = r.randrange(0, total + 1)
        got = subset_sum(lengths, counts, budget)
        assert (got <= counts).all() and (got >= 0).all() and int((got * lengths).sum()) == nearest(lengths, counts, budget)
        taken = fit(lengths, counts, budget)
        spent = int((taken * lengths).sum())
        assert (taken <= counts).all() and (taken >= 0).all() and spent <= budget
        if budget <= RESERVE * lengths.max():
            assert spent == nearest(lengths, counts, budget)
        else:
            assert nearest(lengths, counts, budget) - spent < lengths.max()
    for budget in (12_345_678, 99_999, 31_000_001):
        big = fit(np.arange(1, 3000), np.full(2999, 7), budget)
        assert int((big * np.arange(1, 3000)).sum()) == budget


def test_mix_of_ties_and_long_texts(spark):
    rows = [(i // 2, "w " * 5, "a") for i in range(60)] + [(100, "w " * 300_000, "b"), (101, "w " * 200_000, "b"), (None, "w " * 5, "a"), (None, "w " * 5, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [mix_sources(docs.repartition(n)).collect() for n in (1, 5)]
    assert sorted(runs[0], key=str) == sorted(runs[1], key=str)
    by = {k: sum(r["taken"] for r in runs[0] if (r["size"] > 5) == k) for k in (False, True)}
    assert by[False] == 620 and abs(by[True] - (1.5 * 500_310 - 620)) <= 100_000


def test_mix(spark):
    rows = [(i, "w " * (i % 37), f"s{i % 4}" if i % 5 else None) for i in range(600)] + [(1000, None, "s1"), (1001, "", "zero"), (599, "w " * 7, "s3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mix_sources(docs, keep=("source",)).collect()
    again = mix_sources(docs.repartition(7), keep=("source",)).collect()
    assert len(got) == len(rows) and sorted(got, key=str) == sorted(again, key=str)
    by = {}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        s = by.setdefault(r["source"], [r["target"], 0])
        s[1] += r["taken"]
    assert all(abs(t - taken) <= 1 for t, taken in by.values())
    assert mix_sources(docs.limit(0)).count() == 0


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>'
    '<!-- ad --><div class="ad">Buy</div><article><h1>Head &amp; line</h1><p><b>One<br>two&nbsp;three.<p>Four <span class="ad-slot">x</span> five.</p>'
    '<div class="comments"><p>Nice</p></div></article><aside>side</aside><footer>&copy; x</footer></body></html>'
)


def test_roles():
    assert [t for _, t in blocks(PAGE)] == ["Head & line", "One two three.", "Four five."]
    assert blocks(None) == [] and blocks("") == []
    assert [t for _, t in blocks("plain < text & co")] == ["plain < text & co"]
    assert [t for _, t in blocks("<p title='a>b'>x</p><!-- open")] == ["x"]


@pytest.mark.parametrize(
    "inner",
    [
        '<section id="related-work"><p>text</p></section>',
        '<p class="share-price">text</p>',
        '<div class="post social-history"><p>text</p></div>',
        '<p data-id="share">text</p>',
        '<svg/><p>text</p>',
        '<svg width="1"/><p>text</p>',
        '<iframe src="x"/><p>text</p>',
        "<style-x/><p>text</p>",
        "<nav/><p>text</p>",
        '<p title="class=&quot;ad&quot;">text</p>',
        '<iframe src="x"><p>no</p></iframe><svg><text>no</text></svg><p>text</p><div class="ad-slot">no</div><ul class="site-nav">no</ul>',
    ],
)
def test_markup_keeps_the_article(inner):
    assert [t for _, t in blocks(f"<article>{inner}</article>")] == ["text"]
    assert [t for _, t in blocks(f"<div>{inner}</div>")] == ["text"]


def test_names_of_furniture():
    assert all(map(furniture, "ad ad-slot siteFooter main_nav comments-area cookie-banner breadcrumbs2".split()))
    assert not any(map(furniture, "related-work share-price social-history post content main readme adventure list".split()))


def covers(streams, size, pages):
    held = {}
    for s in streams:
        for i in range(len(s) - size + 1):
            held.setdefault(tuple(s[i : i + size]), set()).add(tuple(s))
    want = [np.zeros(len(s), bool) for s in streams]
    for k, s in enumerate(streams):
        for i in range(len(s) - size + 1):
            if len(held[tuple(s[i : i + size])]) >= pages:
                want[k][i : i + size] = True
    return want


def test_suffixes_equal_brute_force():
    r = random.Random(8)
    for _ in range(30):
        streams = [np.array([r.randrange(3) for _ in range(r.randrange(0, 40))], np.int64) for _ in range(5)]
        streams.append(streams[0].copy())
        number = {}
        same = np.array([number.setdefault(s.tobytes(), len(number)) for s in streams])
        assert all((a == b).all() for a, b in zip(covered(streams, same, 4, 3), covers(streams, 4, 3)))


def host_truth(pages, size=8, least=3):
    """Main texts of open pages (host, blocks) by the definition."""
    out = []
    hosts = {}
    for host, page in pages:
        hosts.setdefault(host, []).append(page)
    for host, page in pages:
        every = hosts[host]
        streams = [" | ".join(p).split() for p in every]
        mask = covers(streams, size, least)[every.index(page)]
        kept, at = [], 0
        for text in page:
            words = text.split()
            own = mask[at : at + len(words)]
            at += len(words) + 1
            twins = {tuple(s) for s, p in zip(streams, every) if len(words) < size and text in p}
            left = " ".join(w for w, c in zip(words, own) if not c)
            if left and len(twins) < least:
                kept.append(left)
        out.append("\n\n".join(kept))
    return out


def test_open_pages_equal_the_definition_whatever_the_size_of_hosts(spark):
    r = random.Random(14)
    notices = [" ".join(f"n{k}x{j}" for j in range(r.randrange(2, 25))) for k in range(6)]
    pages = []
    for i in range(120):
        page = []
        for _ in range(r.randrange(1, 6)):
            own = " ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(1, 30)))
            kind = r.randrange(4)
            page.append(own if kind < 2 else r.choice(notices) if kind == 2 else own + " " + r.choice(notices) + " tail" + str(i))
        pages.append((r.choice("aab"), page))
    pages += [pages[3]] * 4  # copies are one page
    want = host_truth(pages)
    html_of = lambda i, p: "".join(f"<div>{t}</div>" for t in p) if i % 2 else "<nav>Menu</nav><main>" + "".join(f"<p>{t}" for t in p) + "</main><div>out</div>"
    rows = [(i, f"http://{h}.example/{i}", html_of(i, p)) for i, (h, p) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for n, limit in ((1, 1 << 25), (7, 1 << 25), (1, 10), (5, 10)):
        got = {x["page_id"]: x["text"] for x in extract_main(df.repartition(n), host_bytes=limit).collect()}
        assert [got[i] for i in range(len(pages))] == want


def test_repeats_decide_where_roles_do_not(spark):
    legal = "<div><p>This site uses text that every page repeats word by word again.</p></div>"
    pages = [(i, "http://h.org/x", f"<div><p>Story {i} " + " ".join(f"word{i}x{j}" for j in range(12)) + f"</p></div>{legal}<p>Back</p>") for i in range(6)]
    pages += [(50, "http://h.org/y", None), (51, None, ""), (52, "http://h.org/z", PAGE), (52, "http://h.org/z", PAGE)]
    pages += [(60, "http://big.org/z", "<p>" + "long " * 200_000 + "</p>"), (61, "http://h.org/w", "<p>" + "a<br>" * 50_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("open", F.lit(1))
    for limit in (1 << 25, 10):
        got = {}
        for r in extract_main(df, host_bytes=limit).collect():
            got.setdefault(r["page_id"], []).append(r)
        assert all(got[i][0]["text"].startswith(f"Story {i} ") and "repeats" not in got[i][0]["text"] and "Back" not in got[i][0]["text"] for i in range(6))
        assert got[50][0]["text"] == got[51][0]["text"] == "" and len(got[52]) == 2
        assert got[52][0]["text"] == "Head & line\n\nOne two three.\n\nFour five." and got[52][0]["n_chars"] == len(got[52][0]["text"])
        assert got[60][0]["n_chars"] == 999_999 and got[61][0]["n_chars"] == 99_999
    assert extract_main(df.limit(0)).count() == 0


def test_a_rare_notice_goes_from_a_large_host(spark):
    notice = "we use cookies on this site to make it better for all our readers"
    pages = []
    for i in range(3000):
        own = " ".join(f"w{i}x{j}" for j in range(12))
        extra = f"<p>{notice}</p><p>Log in</p>" if i % 300 == 0 else f"<p>pair {i // 2}</p>"
        pages.append((i, f"https://a.example/{i}", f"<div><p>{own}</p>{extra}</div>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    for limit in (1 << 25, 1000):
        got = {r["page_id"]: r["text"] for r in extract_main(df, host_bytes=limit).collect()}
        assert not any("cookies" in t or "Log" in t for t in got.values()) and "pair 3" in got[7]


def test_a_large_hosts_suffixes_are_ranked_in_order(spark):
    r = random.Random(21)
    pages = [(i, i % 2, [" ".join(r.choice("abc") for _ in range(r.randrange(1, 25))) for _ in range(r.randrange(0, 4))]) for i in range(24)]
    df = spark.createDataFrame(pages, "s long, host long, texts array<string>").repartition(5)
    for size in (1, 4, 5):
        begin = {(s, i): (host, t[i : i + size]) for s, host, texts in pages for t in [" \x1f ".join(texts).split(" ") if texts else []] for i in range(len(t) - size + 1)}
        on = {}
        for (s, _), b in begin.items():
            on.setdefault((b[0], *b[1]), set()).add(s)
        want = {k: (b[0], *b[1]) for k, b in begin.items() if len(on[(b[0], *b[1])]) >= 3}
        order, short = suffix_order(df, size, 3)
        got = {(x["s"], x["i"]): x["r"] for x in order.collect()}
        assert set(got) == set(want)
        known = sorted({(got[k], b) for k, b in want.items()})
        assert len({rank for rank, _ in known}) == len({b for _, b in known}) == len(known)
        assert [b for _, b in known] == sorted(b for _, b in known)
        held = {}
        for s, host, texts in pages:
            for t in texts:
                held.setdefault((host, t), set()).add(s)
        stale = {(s, -1 - j) for s, host, texts in pages for j, t in enumerate(texts) if len(t.split()) < size and len(held[host, t]) >= 3}
        assert {tuple(x) for x in short.select("s", "i").collect()} == stale


def test_unique_runs_stay_where_polynomial_hashes_of_words_collide(spark):
    even = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))  # the Thue-Morse word and its complement
    odd = even.translate(str.maketrans("ab", "ba"))
    pages = [(i, f"http://h.org/{i}", f"<p>one two three four five six {x} {y}</p><p>own {i}</p>") for i, (x, y) in enumerate((x, y) for x in (even, odd) for y in (even, odd))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = {i: page[3:-4].replace("</p><p>", "\n\n") for i, _, page in pages}
    for limit in (1 << 25, 10):
        assert {r["page_id"]: r["text"] for r in extract_main(df, host_bytes=limit).collect()} == want


def test_whole_pages_of_the_table(spark):
    def truth(page):
        inner = page[page.index("<article>") + 9 : page.index("</article>")]
        parts = (" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?p>|</?h1>", inner))
        return "\n\n".join(p for p in parts if p)

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r["page_id"]: truth(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in extract_main(pages).collect()} == want
    assert decide([["a"]], 8, 3) == ["a"]


def test_ordinal_thresholds_and_order():
    r = random.Random(9)
    rows = []
    for _ in range(400):
        bad, good = r.random() < 0.3, r.random() < 0.5
        text = " ".join(["Plain"] * 5 + (["awful"] if bad else []) + (["FINE"] * 4 if good else ["meh"] * 4))
        b, v = features(text)
        rows.append((0 if bad else 2 if good else 1, b, v))
    model = fit_ordinal(rows, 3)
    score = Scorer(model).score
    assert model.thresholds[0] <= model.thresholds[1]
    assert score("Plain awful meh meh") < score("Plain Plain meh meh meh meh")
    tails = model.tails(score("Plain Plain"))
    assert tails[0] >= tails[1] and Scorer(model).score(" ") is None
    assert fit_ordinal([], 3).tails(0.0) == [pytest.approx(1.0)] * 2


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    grade = F.col("quality") + 1 - F.col("toxic")
    model = train(docs, labels.filter("doc_id % 4 != 0"), grade, 3, max_rows=2500)
    held = docs.join(labels.filter("doc_id % 4 = 0"), "doc_id").withColumn("kept", F.lit("clash"))
    got = grade_texts(held, model).select("quality", "toxic", "kept").collect()
    clean = [r["kept"] for r in got if r["quality"] == 1 and r["toxic"] == 0]
    junk = [r["kept"] for r in got if r["quality"] == 0]
    toxic = [r["kept"] for r in got if r["toxic"] == 1]
    assert sum(clean) / len(clean) > 0.98 and sum(junk) / len(junk) < 0.08 and sum(toxic) / len(toxic) < 0.35


def test_likelihood_by_its_definition_and_its_gradient():
    r = np.random.default_rng(5)
    n, m, grades = 40, 6, 4
    x = np.concatenate([r.normal(size=m), [-0.4, 0.1, -0.3]])
    dense = r.normal(size=(n, m)) * (r.random((n, m)) < 0.5)
    doc, cols = np.nonzero(dense)
    y = r.integers(0, grades, n)
    args = (m, cols, dense[doc, cols], doc, y, grades, 0.5)
    loss, grad = likelihood(x, *args)
    tail = lambda s, k: 1.0 if k == 0 else 0.0 if k == grades else 1 / (1 + np.exp(cuts_of(x[m:])[k - 1] - s))
    p = [tail(s, k) - tail(s, k + 1) for s, k in zip(dense @ x[:m], y)]
    assert loss == pytest.approx(-np.log(p).mean() + 0.25 * (x[:m] ** 2).sum() / n)
    for i in range(len(x)):
        step = np.zeros(len(x))
        step[i] = 1e-6
        assert grad[i] == pytest.approx((likelihood(x + step, *args)[0] - likelihood(x - step, *args)[0]) / 2e-6, abs=1e-6)
    assert (np.diff(cuts_of(x[m:])) > 0).all()


def test_words_and_shapes_are_whole():
    assert words_of("a\x1cb\xa0c d\te\x0bf\u2003g") == ["a\x1cb\xa0c", "d", "e", "f\u2003g"]
    assert shape("a1" * 50 + "!") != shape("a1" * 50 + "?") and shape("Abc9") == "Aa0"


def test_grading_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, " "), (3, "word"), (3, "word")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["expected_grade"], r["kept"]) for r in grade_texts(docs, Model({}, (-60.0, -60.0))).collect())
    assert got[:2] == [(1, 0.0, False), (2, 0.0, False)] and [g[2] for g in got[2:]] == [True, True]
    assert train(docs, spark.createDataFrame([], "doc_id long, g int"), F.col("g"), 3).weights == {}
    assert grade_texts(docs.limit(0), Model({}, (-60.0, -60.0))).count() == 0
    long = spark.createDataFrame([(1, "word " * 400_000), (2, "x" * 2_000_000)], "doc_id long, text string")
    assert [r["kept"] for r in grade_texts(long, Model({}, (-60.0, -60.0))).collect()] == [True, True]


def test_the_sample_is_the_same_whatever_the_order(spark):
    texts = [(i % 50, f"word{i % 7} text{i % 3} " * 4) for i in range(120)]
    rated = [(i % 60, i % 3) for i in range(180)] + [(None, 1), (5, None), (6, 9)]
    models = []
    for n in (1, 4):
        docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(n)
        labels = spark.createDataFrame(rated, "doc_id long, g int").repartition(n)
        models.append(train(docs, labels, F.col("g"), 3, max_rows=40))
    assert models[0] == models[1]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p
    import public_tokenizers
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.collect())
        if k < 4:
            assert set(docs.columns) == set(p.COLUMNS)
    ids = [sorted(r["doc_id"] for r in rows) for rows in kept]
    near = brute.jaccard([(r["doc_id"], r["text"]) for r in kept[0]])
    assert ids[1] == sorted(i for i, _, _, first in near if first)
    cut = brute.substring([(r["doc_id"], r["text"]) for r in kept[1]])
    for r in kept[2]:
        n, gone, text = cut[r["doc_id"]]
        assert r["n_chars"] == len(r["text"]) and (gone == 0 or r["text"] == text)
    assert set(ids[3]) <= set(ids[2]) and max(ids[3].count(i) for i in set(ids[3])) <= 2
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r["doc_id"]: r["text"] for r in kept[3]}
    assert all(r["ids"] == [*library.encode(text[r["doc_id"]]), 2] for r in kept[4]) and ids[4] == ids[3]


def test_pipeline_keeps_rows_without_or_with_shared_ids(spark):
    import corpus_pipeline as p

    words = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    texts = [(None, words(0)), (None, words(0) + " end"), (None, words(1)), (7, words(2)), (7, words(3)), (7, words(3)), (8, words(3) + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"].removesuffix(" end")) for r in p.near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=repr) == sorted([(None, words(0)), (None, words(1)), (7, words(2)), (7, words(3))], key=repr)
    mixed = [r["text"] for r in p.mixture(spark, docs.limit(5).repartition(1), "").collect()]
    assert set(mixed) == {t for _, t in texts[:5]} and max(mixed.count(t) for t in mixed) <= 2


def test_pipeline_stages_of_odd_tables(spark):
    import corpus_pipeline as p

    words = lambda k, n=60: " ".join(f"w{k}x{j}" for j in range(n))
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id string, size int, kept string, c int"
    extra = ("clash", 1, "clash", 2)
    rows = [(1, words(1), "en", "s", 5), (1, words(1), "en", "s", 5), (2, None, None, None, None), (3, "", "en", None, 0), (4, " \n", None, "s", 2)]
    rows += [(None, words(2), None, None, None), (5, words(3, 100_000), "en", "t", 9), (6, words(3, 99_000) + " end", "en", "t", 9)]
    docs = spark.createDataFrame([(*r, *extra) for r in rows], schema).repartition(3)
    near_ = sorted(((r["doc_id"], r["text"]) for r in p.near_duplicates(spark, docs, "").collect()), key=repr)
    assert near_ == sorted([(1, words(1)), (2, None), (3, ""), (4, " \n"), (None, words(2)), (5, words(3, 100_000))], key=repr)
    cut_ = {r["doc_id"]: r for r in p.substrings(spark, docs, "").collect()}
    assert set(cut_) == {1, None, 5, 6} and cut_[6]["text"] == "end" and cut_[6]["n_chars"] == 3 and cut_[None]["source"] is None
    mixed = [r["doc_id"] for r in p.mixture(spark, docs, "").collect()]
    assert not {2, 3, 4} & set(mixed) and max(mixed.count(i) for i in (None, 5, 6)) <= 2 and mixed.count(1) <= 4
    tokens = sorted(((r["doc_id"], r["n_tokens"]) for r in p.encoded(spark, docs, "").collect()), key=repr)
    assert len(tokens) == 8 and (2, 1) in tokens and (3, 1) in tokens
    none = docs.limit(0)
    for _, stage in p.STAGES[1:]:
        out = stage(spark, none, "")
        assert out.count() == 0 and (stage is p.encoded or out.columns == list(p.COLUMNS))
    labels = spark.read.parquet(f"{SF}/labels.parquet").limit(0)
    assert p.grade_texts(none, p.quality_model(none, labels)).count() == 0
    first = p.quality(spark, docs, SF)
    assert first.columns == list(p.COLUMNS) and not {2, 3, 4} & {r["doc_id"] for r in first.collect()}
    assert p.quality(spark, none, SF).count() == 0
