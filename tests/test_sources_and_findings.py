"""Readers, guards, stores, dedup, budgets, reports."""

import json
import os
import zipfile

import numpy as np
import pytest

from pyspark.sql import functions as F

from quarry import seeds
from quarry.functions import text as T
from quarry.operators import findings as fo, prefilter as pf, vectors as vo
from quarry.sources import files, stores


def test_scan_leaves_links_and_pruned_folders_out(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "src/real.py").write_text("x = 1")
    (tmp_path / ".git/config").write_text("no")
    (tmp_path / "bin.dat").write_bytes(b"a\x00b")
    os.symlink("/etc/hostname", tmp_path / "link.py")
    found = files.scan_tree(spark, str(tmp_path))
    assert sorted(r["path"] for r in found.collect()) == ["bin.dat", "src/real.py"]
    assert [r["code"] for r in files.decode(found).collect()] == ["x = 1"]
    assert files.scan_tree(spark, str(tmp_path / ".git" / "none")).count() == 0


def test_zip_slip_and_links_are_refused(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("../../escape.txt", "no")
        z.writestr("ok.py", "yes")
        link = zipfile.ZipInfo("link")
        link.external_attr = 0o120777 << 16
        z.writestr(link, "/etc/passwd")
    archive = spark.read.format("binaryFile").load(str(tmp_path / "a.zip"))
    assert [r["path"] for r in files.unzip(archive).collect()] == ["ok.py"]


def test_languages(spark):
    rows = [("a.PY", ""), ("b", "#!/usr/bin/env python3\n"), ("c", "#!/usr/bin/env -S node --x\n"), ("d", "#!/usr/bin/php8\n"), ("e", "#!/usr/bin/ruby2.7\n"), ("f", "#!/bin/bash\n"), ("g", "")]
    df = spark.createDataFrame(rows, "path string, code string")
    got = {r["path"]: r["language"] for r in files.with_language(df, seeds.languages(spark)).collect()}
    assert got == {"a.PY": "python", "b": "python", "c": "javascript", "d": "php", "e": "ruby", "f": None, "g": None}


def test_source_kinds(spark):
    urls = ["git@x.org:a/b", "https://github.com/a/b", "https://x.org/a.git", "https://x.org/a", "file:///a.git", "a.zip", "folder"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(T.source_kind(F.col("u"))).collect()]
    assert got == ["git", "git", "git", "url", "git", "zip", None]


def test_project_limit_stops(spark):
    rows = spark.createDataFrame([(1, 5), (2, 50), (3, 4), (4, 9), (5, 1)], "o int, size int")
    assert [r["o"] for r in files.within_limits(rows, "o", "size", 20, 10).orderBy("o").collect()] == [1, 3]


def test_graph_store_rejects_in_order(spark, tmp_path):
    store = stores.GraphStore(spark, str(tmp_path / "g"))
    assert store.load("s") == (None, "missing")
    a = spark.createDataFrame([(1, "x")], "id int, name string")
    store.save(a, a, a, "s", "v1")
    tables, why = store.load("s", "v1")
    assert why == "" and tables["nodes"].count() == 1
    assert store.load("t", "v1")[1] == "source" and store.load("s", "v2")[1] == "source"
    spark.createDataFrame([(2, "y")], "id int, name string").write.mode("overwrite").parquet(str(tmp_path / "g/edges"))
    assert store.load("s", "v1")[1] == "digest"


def test_redaction_and_categories(spark):
    df = spark.createDataFrame([('password = "supersecretvalue123"',), ("// api_key: abcdefgh12345",), ("nothing",)], "t string")
    got = df.select(T.redact(F.col("t")), T.secret_categories(F.col("t"))).collect()
    assert "supersecret" not in got[0][0] and "[REDACTED]" in got[0][0] and got[0][0].startswith("password = ")
    assert got[0][1] == ["password"] and got[1][1] == ["token"] and got[2][1] == [] and got[2][0] == "nothing"


def test_segment_match_needs_whole_segments(spark):
    row = spark.range(1).select(
        T.segment_match(F.lit("self.execute"), F.lit("exec")), T.segment_match(F.lit("sp.Popen"), F.lit("open")),
        T.segment_match(F.lit("os.path.join"), F.lit("path.join")), T.call_core(F.lit("open(")), T.call_core(F.lit("a b(")),
    ).first()
    assert tuple(row) == (False, False, True, "open", None)


def test_dedup_exact_near_and_protected(spark):
    rows = spark.createDataFrame([(1, "h1"), (2, "h1"), (3, "h2")], "o int, h string")
    assert [r["o"] for r in vo.exact_dedup(rows, "h", "o").orderBy("o").collect()] == [1, 3]
    assert vo.exact_dedup(rows, "h", "o", F.col("o") == 2).count() == 3
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a int, b int")
    ids = spark.createDataFrame([(i,) for i in range(1, 6)], "o int")
    assert sorted(r["o"] for r in vo.greedy_dedup(ids, chain, "o").collect()) == [1, 3, 5]
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.999, 0.01]), (3, [0.0, 1.0])], "id int, embedding array<double>")
    assert [(r["a"], r["b"]) for r in vo.near_pairs(vec, 0.95).collect()] == [(1, 2)]


def test_near_dedup_equals_the_loop(spark, monkeypatch):
    r = np.random.default_rng(2)
    centres = r.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + r.standard_normal(16) * r.choice([0.0, 0.1, 0.3, 1.0])).tolist()) for i in range(500)]
    line = [(1000 + i, [float(np.cos(0.2 * i)), float(np.sin(0.2 * i))] + [0.0] * 14) for i in range(130)]  # a chain of neighbours
    rows += line
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    kept = []
    for k in range(len(rows)):
        if not kept or (unit[kept] @ unit[k]).max() <= 0.95:
            kept.append(k)
    df = spark.createDataFrame(rows, "id int, embedding array<double>").repartition(3)
    monkeypatch.setattr(vo, "TILE", 32)
    assert sorted(x["id"] for x in vo.near_dedup(df, 0.95, per_bucket=32).collect()) == [rows[k][0] for k in kept]
    assert vo.near_dedup(df.limit(0), 0.95).count() == 0


def test_rescue_by_similarity(spark):
    chunks = spark.createDataFrame([("c", [0.95, 0.31, 0.0]), ("inert", [0.0, 1.0, 0.0])], "id string, embedding array<double>")
    queries = spark.createDataFrame([("q", [1.0, 0.0, 0.0]), ("inert", [0.0, 1.0, 0.0])], "id string, embedding array<double>")
    assert [r["id"] for r in vo.rescue_similar(chunks, queries, 0.32, 10).collect()] == ["c"]  # no row answers for itself
    assert vo.rescue_similar(chunks, queries.limit(0), 0.22, 10).count() == 0
    assert [pf.rescue_budget(k) for k in (50, 6610, 1, 0)] == [25, 661, 25, 25]


def test_variant_hunt(spark):
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.98, 0.05]), ("c", [0.97, 0.08]), ("z", [0.0, 1.0])], "id string, embedding array<double>")

    def near(frontier, seen):
        return vo.neighbours(vec.join(frontier, "id", "left_semi"), vec, 0.9, 10)

    def judge(fresh):
        return fresh.withColumn("status", F.when(F.col("id") == "b", "confirmed").otherwise("false_positive"))

    found, rounds = fo.hunt_variants(vec.filter("id = 'a'").select("id"), near, judge)
    got = {r["id"]: (r["variant_of"], r["status"]) for r in found.collect()}
    assert got == {"b": ("a", "confirmed"), "c": ("a", "false_positive")} and rounds == 2
    found, rounds = fo.hunt_variants(vec.filter("id = 'a'").select("id"), near, lambda x: x.withColumn("status", F.lit("false_positive")))
    assert rounds == 1


def test_pacing_models_are_independent(spark):
    rows = spark.createDataFrame([("m", 0, 8000), ("m", 10, 8000), ("n", 10, 8000), ("m", 100, 20000)], "model string, s int, tokens int")
    rows = rows.withColumn("ts", F.timestamp_seconds("s"))
    got = {(r["model"], r["s"]): r["passes"] for r in fo.pacing(rows, "tokens", "ts", "model", 10_000).collect()}
    assert got == {("m", 0): True, ("m", 10): False, ("n", 10): True, ("m", 100): True}


def test_sarif(spark, tmp_path):
    rows = [
        ("r", 1, "F1", "sql_injection", "critical", "m", "", ["a.py"], ["a.py:0"], "V", 9.75),
        ("r", 2, "F2", "xss", "medium", "", "cause", [], ["x", "b.py:7"], "V", 5.0),
        ("r", 3, "F3", "sql_injection", "low", "", "", [], [], "V", 0.0),
        ("other", 4, "F4", "xss", "high", "m", "", [], [], "V", 0.0),
    ]
    causes = spark.createDataFrame(
        rows,
        "run_id string, ord int, finding_id string, type string, severity string, summary string, root_cause string, "
        "affected_files array<string>, affected_lines array<string>, cvss_vector string, cvss_score double",
    ).repartition(3)
    for own, want in ((causes, 3), (causes.limit(0), 0)):
        fo.write_sarif(own, "r", str(tmp_path / "sarif"))
        doc = json.loads("".join(p.read_text() for p in sorted((tmp_path / "sarif").glob("part-*"))))
        assert doc["version"] == "2.1.0" and len(doc["runs"][0]["results"]) == want
        if want:
            run = doc["runs"][0]
            assert [(r["id"], r["shortDescription"]["text"]) for r in run["tool"]["driver"]["rules"]] == [("sql_injection", "Sql Injection"), ("xss", "Xss")]
            assert [r["level"] for r in run["results"]] == ["error", "warning", "note"]
            places = [r["locations"][0]["physicalLocation"] for r in run["results"]]
            assert [(p["artifactLocation"]["uri"], p["region"]["startLine"]) for p in places] == [("a.py", 1), ("b.py", 7), ("unknown", 1)]
            assert [r["message"]["text"] for r in run["results"]] == ["m", "cause", "sql_injection"]
            assert [r["properties"]["security-severity"] for r in run["results"]] == ["9.8", "5.0", "0.0"]



def test_importers(spark):
    kinds = spark.createDataFrame([("command-injection", "command_injection")], "kind string, sink_type string")
    rows = spark.createDataFrame(
        [("sinkModel", "java.lang.Runtime", "exec", "command-injection"), ("sinkModel", "org.Log", "info", "log-injection"), ("sinkModel", "java.io.Writer", "write", "command-injection")],
        "model string, receiver string, method string, kind string",
    )
    assert [tuple(r) for r in stores.import_sink_rows(rows, kinds, ["write"]).collect()] == [("Runtime.exec", "command_injection")]
    types = spark.createDataFrame([("78", "command_injection")], "cwe string, sink_type string")
    rules = spark.createDataFrame([("taint", "CWE-78: x", "exec.Command($A)"), ("taint", "CWE-78: x", "$TOKEN.SignedString($B)"), ("search", "CWE-78", "os.Run(x)")], "mode string, cwe string, pattern string")
    assert [tuple(r) for r in stores.import_rules(rules, types).collect()] == [("exec.Command", "command_injection")]


def test_json_in_noise():
    assert fo.balanced_json('Sure:\n```json\n[{"a": 1}, 2]\n```') == [{"a": 1}]
    assert fo.balanced_json('x {"findings": [{"b": "}"}]} y') == [{"b": "}"}]
    assert fo.balanced_json("none") == []


def test_findings_reader_and_verdicts(spark):
    rows = spark.createDataFrame([("F001", "run-1", "confirmed"), ("F001", "run-2", "needs_review"), ("F002", "run-2", "confirmed")], "id string, run_id string, status string")
    assert stores.findings_in(rows).count() == 2 and stores.findings_in(rows, run="all").count() == 3
    assert stores.findings_in(rows, finding="f001").count() == 2 and stores.findings_in(rows, status="confirmed").count() == 1
    assert fo.replace_one(rows, spark.createDataFrame([("f002", "false_positive")], "id string, status string")).filter("status = 'false_positive'").count() == 1
    verdicts = spark.createDataFrame([("F001", "CONFIRMED", None), ("F002", None, "token budget spent")], "id string, verdict string, failure string")
    got = {r["id"]: (r["status"], r["review_reason"]) for r in fo.merge_verdicts(spark.createDataFrame([("F001",), ("F002",), ("F003",)], "id string"), verdicts).collect()}
    assert got == {"F001": ("confirmed", ""), "F002": ("needs_review", "token budget spent"), "F003": ("needs_review", "not evaluated")}


def test_numbers_and_totals_run_over_ranges(spark):
    from quarry.operators.ranges import running

    rows = [(None if i % 5 == 0 else "hot" if i % 5 < 4 else f"s{i % 3}", i, i % 7) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(5)
    got = {r["k"]: (r["n"], r["before"]) for r in running(df, ["g"], ["k"], "v").collect()}
    seen = {}
    for g, k, v in rows:
        n, before = seen.get(g, (0, 0))
        assert got[k] == (n + 1, before)
        seen[g] = n + 1, before + v
    assert [r["n"] for r in running(df, [], [F.desc("k")]).orderBy("n").limit(3).collect()] == [1, 2, 3]
    assert running(df.limit(0), ["g"], ["k"]).count() == 0


def test_embedders(spark):
    from quarry.functions.embedders import FunctionEmbedder, embedder, register

    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b")], "id int, text string")
    assert embedder("hash", dim=8).embed(rows, "id", "text").count() == 3
    register("length", lambda dim=2: FunctionEmbedder("length", lambda: lambda texts: [[len(t), 1.0] for t in texts], dim))
    got = {r["id"]: r["embedding"] for r in embedder("length").embed(rows, "id", "text").collect()}
    assert got[2] == [0.0, 1.0] and got[1] == got[3] and abs(sum(x * x for x in got[1]) - 1) < 1e-12
    with pytest.raises(ValueError):
        embedder("nothing")


def test_learned_sinks_and_models_by_tier(spark):
    from quarry.operators import definitions as d

    samples = spark.createDataFrame([("lua", "x"), ("perl", "y"), ("c", "z"), ("tcl", " ")], "language string, sample string")
    covered = spark.createDataFrame([("c",)], "language string")

    def learner(language, sample):
        if language == "perl":
            raise RuntimeError
        return ["OS.Execute(", "os.execute(", "", "x" * 101, 5, *(f"p{i}" for i in range(50))]

    got = [r["pattern"] for r in d.learn_sinks(samples, covered, learner).collect()]
    assert got == ["os.execute(", *(f"p{i}" for i in range(39))]
    fallback = {"cheap": "a", "mid": "b", "deep": "c"}
    assert d.models_by_tier({"one_model_deep": "z", "model": "old"}, "one", fallback, "one") == {"cheap": "a", "mid": "old", "deep": "z"}
    assert d.models_by_tier({"one_model_mid": "m", "model": "old"}, "one", fallback, "one")["mid"] == "m"
    assert d.models_by_tier({"model": "old"}, "two", fallback, "one") == fallback
    assert d.resolve_model(fallback, "mid") == "b"
    with pytest.raises(ValueError):
        d.resolve_model({"mid": ""}, "mid")


def test_reports_of_root_causes():
    cause = {
        "finding_id": "F1", "type": "sql_injection", "severity": "high", "cvss_score": 9.0, "cvss_vector": "AV:N", "summary": "a | b", "root_cause": "joined *text*",
        "affected_files": ["a.py"], "affected_lines": ["a.py:3"], "vulnerable_code": 'password = "hunter22"\n```', "fixed_code": "",
    }
    text = fo.executive_report(cause)
    assert "a \\| b" in text and "hunter" not in text and text.count("not available") == 2
    text = fo.technical_report(cause)
    assert "hunter22" not in text and "[REDACTED]" in text and "````" in text and "`a.py:3`" in text
    assert fo.consolidated_report([cause, {**cause, "finding_id": "F2"}]).count("sql\\_injection") == 4


def test_renderers():
    from quarry.operators import graph as g

    nodes = [{"id": 1, "name": 'a"b', "is_entry_point": True, "is_sink": False}, {"id": 2, "name": "c", "is_entry_point": False, "is_sink": True}]
    edges = [{"src": 1, "dst": 2, "type": "calls"}, {"src": 1, "dst": 2, "type": "data_flow"}, {"src": 2, "dst": 1, "type": "calls"}, {"src": 2, "dst": 9, "type": "calls"}]
    assert g.render(nodes, edges, "tree").split("\n") == ['a"b', "  calls,data_flow: c (sink)", '    calls: a"b ...']
    assert 'label="a\\"b" color=green' in g.render(nodes, edges) and "style n1 stroke:red" in g.render(nodes, edges, "mermaid")
    assert len(json.loads(g.render(nodes, edges, "json"))["edges"]) == 3
    paths = [{"path": [1, 2], "hops": ["x (unsanitized)"], "tainted": True}]
    assert g.render_paths(paths, {1: "a", 2: "c"}).split("\n") == ["[1] unsanitized", "    1. a", "       | x (unsanitized)", "    2. c"]
    assert "no path" in g.render_paths([], {})


def test_sources_are_told_apart_and_archives_guarded(spark, tmp_path):
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree/a.py").write_text("x")
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("ok.py", "y")
        z.writestr("big.py", "0" * 5_000)
        z.writestr("../out.py", "z")
    want = {"git@host:a/b": "git", "https://github.com/a/b": "git", "https://x.org/a.git": "git", "https://x.org/a": "url", str(tmp_path / "tree"): "directory", str(tmp_path / "z.zip"): "zip"}
    assert {k: files.classify(k) for k in want} == want
    with pytest.raises(ValueError):
        files.classify(str(tmp_path / "missing"))
    assert [r["path"] for r in files.read_source(spark, str(tmp_path / "tree")).collect()] == ["a.py"]
    assert sorted(r["path"] for r in files.read_source(spark, str(tmp_path / "z.zip")).collect()) == ["big.py", "ok.py"]
    archive = spark.read.format("binaryFile").load(str(tmp_path / "z.zip")).select("content")
    assert [r["path"] for r in files.unzip(archive, max_file=100).collect()] == ["ok.py"]
    with pytest.raises(Exception, match="more than 1000 bytes"):
        files.unzip(archive, max_archive=1000).collect()
    with pytest.raises(ValueError):
        files.read_source(spark, "https://x.org/a")


def test_pattern_predicate(spark):
    df = spark.createDataFrame([("a###b",), ("say Password now",), ("passwords",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(T.matches_any(F.col("t"), ["#{3}", r"(?i)\bpassword\b"])).collect()]
    assert got == [True, True, False, False, False]
    assert not any(r[0] for r in df.select(T.matches_any(F.col("t"), [])).collect())
