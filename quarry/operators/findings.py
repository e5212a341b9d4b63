"""Findings: coercion, attribution, verdicts, variants, budgets, evaluation, reports."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import clamp, redact_text
from quarry.operators.graph import CALLS, DATA, cut, evidence, origin, shortest_paths
from quarry.operators.ranges import over_last, running

CONFIRMED = ("confirmed", "conditional")


def coerce(raw: DataFrame, head_file: Column) -> DataFrame:
    """Loose fields to typed ones: line int else 0, confidence in [0, 1], texts cut, file defaulted."""
    return raw.select(
        "id",
        F.coalesce(F.expr("try_cast(line AS int)"), F.lit(0)).alias("line"),
        F.coalesce(clamp(F.expr("try_cast(confidence AS double)"), 0.0, 1.0), F.lit(0.0)).alias("confidence"),
        F.coalesce(F.when(F.trim("file") != "", F.col("file")), head_file).alias("file"),
        F.substring(F.coalesce("snippet", F.lit("")), 1, 500).alias("snippet"),
    )


#: Lines of one bin: a span of lines meets a line where they share one.
BIN = 64


def _bins(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(F.least(start, end) / BIN), F.floor(end / BIN)))


def attribute(findings: DataFrame, chunks: DataFrame) -> DataFrame:
    """(finding, chunk, tier): same batch and file with the line inside (0), else same file (1), else the batch's first (2).

    Three equi-joins, the first on bins of lines, so the findings of one file don't meet all of its chunks.
    """
    first = F.min(F.struct("ord", "id"))
    spans = chunks.select("batch", "file", "ord", "id", "line_start", "line_end", _bins(F.col("line_start"), F.col("line_end")).alias("_bin"))
    lines = findings.select("finding", "batch", "file", "line", F.floor(F.col("line") / BIN).alias("_bin"))
    inside = lines.join(spans, ["batch", "file", "_bin"]).filter(F.col("line").between(F.col("line_start"), F.col("line_end"))).groupBy("finding").agg(first.alias("_0"))
    in_file = chunks.groupBy("batch", "file").agg(first.alias("_1"))
    in_batch = chunks.groupBy("batch").agg(first.alias("_2"))
    tier = F.when(F.col("_0").isNotNull(), 0).when(F.col("_1").isNotNull(), 1).otherwise(2)
    met = findings.select("finding", "batch", "file").join(in_batch, "batch").join(in_file, ["batch", "file"], "left").join(inside, "finding", "left")
    return met.select("finding", F.coalesce("_0", "_1", "_2")["id"].alias("chunk"), tier.alias("tier"))


def locate(findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """(finding, node): the node of that name in the file, else the narrowest one around the line."""
    best = F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("_w"), "id"))
    named = findings.select("finding", "file", F.col("function").alias("name")).join(nodes, ["file", "name"]).groupBy("finding").agg(best.alias("_0"))
    spans = nodes.select("file", "id", "line_start", "line_end", _bins(F.col("line_start"), F.col("line_end")).alias("_bin"))
    lines = findings.select("finding", "file", "line", F.floor(F.col("line") / BIN).alias("_bin"))
    around = lines.join(spans, ["file", "_bin"]).filter(F.col("line").between(F.col("line_start"), F.col("line_end"))).groupBy("finding").agg(best.alias("_1"))
    return named.join(around, "finding", "full_outer").select("finding", F.coalesce("_0", "_1")["id"].alias("node"))


def default_verdict(evidence: DataFrame) -> Column:
    """Rule-based stand-in of a reviewer: needs path_kind, unsanitized and guards."""
    flow = F.col("path_kind") == "data_flow"
    return (
        F.when(flow & ~F.col("unsanitized"), "false_positive")
        .when(flow & (F.size("guards") > 0), "conditional")
        .when(flow, "confirmed")
        .otherwise("needs_review")
    )


def verdict_status(verdict: Column) -> Column:
    v = F.lower(F.trim(verdict))
    return F.when(v.isin("confirmed", "conditional", "false_positive"), v).otherwise("needs_review")


def merge_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every finding with its status; without a verdict it needs review, with the reason."""
    joined = findings.join(verdicts.select("id", "verdict", "failure"), "id", "left")
    return joined.withColumn("status", verdict_status(F.coalesce("verdict", F.lit("")))).withColumn(
        "review_reason", F.when(F.col("verdict").isNull(), F.coalesce("failure", F.lit("not evaluated"))).otherwise("")
    ).drop("verdict", "failure")


def replace_one(findings: DataFrame, checked: DataFrame) -> DataFrame:
    """The set with the rechecked findings in place of the old, all other columns as they were."""
    key = F.lower("id")
    new = checked.select(F.lower("id").alias("_k"), F.col("status").alias("_s"))
    return findings.withColumn("_k", key).join(new, "_k", "left").withColumn("status", F.coalesce("_s", "status")).drop("_k", "_s")


def merge_variants(findings: DataFrame, variants: DataFrame) -> DataFrame:
    """Adds the variants that aren't known by (file, line, type) yet."""
    return findings.unionByName(variants.join(findings, ["file", "line", "type"], "left_anti"))


def finding_id(run: Column, file: Column, line: Column, kind: Column, ordinal: Column) -> Column:
    """Unique and stable across runs and sub-analyses."""
    return F.concat(F.lit("F-"), F.substring(F.sha2(F.concat_ws("\x1f", run, file, line.cast("string"), kind, ordinal.cast("string")), 256), 1, 12))


def hunt_variants(
    seeds: DataFrame,
    near: Callable[[DataFrame, DataFrame], DataFrame],
    judge: Callable[[DataFrame], DataFrame],
    *,
    max_rounds: int = 5,
    max_total: int = 50,
) -> tuple[DataFrame, int]:
    """Fixpoint: neighbours of confirmed findings are judged, the confirmed ones go on.

    ``near(frontier, seen)`` gives (id, seed, sim), ``judge`` adds status. Returns
    (id, variant_of, status, round) and the number of rounds. The total is a limit
    of the operator: the most similar candidates of a round come first.
    """
    seen = cut(seeds.select("id").distinct())
    frontier, found, total, rounds = seen, None, 0, 0
    while rounds < max_rounds and total < max_total and not frontier.isEmpty():
        rounds += 1
        fresh = near(frontier, seen).join(seen, "id", "left_anti").orderBy(F.desc("sim"), "id").limit(max_total - total)
        judged = cut(judge(fresh).select("id", F.col("seed").alias("variant_of"), "status").withColumn("round", F.lit(rounds)))
        n = judged.count()
        if not n:
            break
        total += n
        found = judged if found is None else found.union(judged)
        seen = cut(seen.union(judged.select("id")))
        frontier = judged.filter(F.col("status").isin(*CONFIRMED)).select("id")
    if found is None:
        found = seen.select("id", F.col("id").alias("variant_of"), F.lit("").alias("status"), F.lit(0).alias("round")).limit(0)
    return found, rounds


def within_budget(rows: DataFrame, tokens: str, budget: int, order: list, by: list[str]) -> DataFrame:
    """Adds ``runs``: whether what was spent before is still below the budget."""
    return running(rows, by, order, tokens).withColumn("runs", F.col("before") < budget).drop("n", "before")


def pacing(calls: DataFrame, tokens: str, ts: str, model: str, limit: int, seconds: int = 60) -> DataFrame:
    """Adds ``window_tokens`` of the last ``seconds`` and ``passes``: fits the limit or is alone."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return over_last(calls, model, at, seconds * 1_000_000, tokens, "window_tokens").withColumn(
        "passes", (F.col("window_tokens") <= limit) | (F.col("window_tokens") == F.col(tokens))
    )


def evaluation(rows: DataFrame, by: str, actual: str, predicted: str) -> DataFrame:
    """Confusion counts and rates per category; a rate without cases is null."""
    a, p = F.col(actual), F.col(predicted)
    counts = rows.groupBy(by).agg(
        F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn")
    )
    recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    precision = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    fpr = F.try_divide(F.col("fp"), F.col("fp") + F.col("tn"))
    f1 = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return counts.select("*", recall.alias("recall"), precision.alias("precision"), fpr.alias("fpr"), f1.alias("f1"), (recall - fpr).alias("youden"))


def balanced(rows: DataFrame, positive: Column, order: str, limit: int) -> DataFrame:
    """Up to half of ``limit`` positives, filled up with negatives, each in order.

    Both halves are top-k queries, so nothing is sorted whole.
    """
    up = rows.filter(positive).orderBy(order).limit(limit // 2)
    n = up.count()
    return up.unionByName(rows.filter(~positive).orderBy(order).limit(limit - n))


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def primary_location(files: Column, lines: Column) -> tuple[Column, Column]:
    """(file, line) of a root cause: its first file, and the first reference ``file:line`` that ends in digits.

    Lines begin at 1; without a file the reference's is taken, without either ``unknown``.
    """
    found = F.get(F.filter(lines, lambda x: x.rlike(r":\d+$")), 0)
    own = F.coalesce(F.get(files, 0), F.lit(""))
    file = F.when(own != "", own).otherwise(F.coalesce(F.regexp_extract(found, r"^(.*):\d+$", 1), F.lit("")))
    line = F.greatest(F.coalesce(F.regexp_extract(found, r":(\d+)$", 1).try_cast("int"), F.lit(1)), F.lit(1))
    return F.when(file != "", file).otherwise("unknown"), line


def sarif_results(causes: DataFrame) -> DataFrame:
    """(run_id, ord, json): one SARIF result per root cause (run_id, ord, finding_id, type, severity, summary,
    root_cause, affected_files, affected_lines, cvss_vector, cvss_score).

    Rows stay rows; ``write_sarif`` puts them together as text.
    """
    file, line = primary_location(F.col("affected_files"), F.col("affected_lines"))
    text = F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in ("summary", "root_cause")), F.col("type"))
    result = F.struct(
        F.col("type").alias("ruleId"),
        sarif_level(F.col("severity")).alias("level"),
        F.struct(text.alias("text")).alias("message"),
        F.array(
            F.struct(
                F.struct(F.struct(file.alias("uri")).alias("artifactLocation"), F.struct(line.alias("startLine")).alias("region")).alias("physicalLocation")
            )
        ).alias("locations"),
        F.struct(
            F.format_string("%.1f", F.col("cvss_score").cast("double")).alias("security-severity"),
            F.col("cvss_vector").alias("cvss-vector"),
            F.col("finding_id").alias("finding-id"),
        ).alias("properties"),
    )
    return causes.select("run_id", "ord", F.to_json(result).alias("json"))


def sarif_rules(causes: DataFrame) -> DataFrame:
    """(run_id, ord, json): the distinct types of each run, numbered by where they come first."""
    title = F.initcap(F.replace("type", F.lit("_"), F.lit(" ")))
    rule = F.struct(F.col("type").alias("id"), F.col("type").alias("name"), F.struct(title.alias("text")).alias("shortDescription"))
    return causes.groupBy("run_id", "type").agg(F.min("ord").alias("ord")).select("run_id", "ord", F.to_json(rule).alias("json"))


def write_sarif(causes: DataFrame, run_id, path: str, tool: str = "quarry", version: str = "1") -> None:
    """Write a run's SARIF 2.1.0 document as text files whose contents, in order of their names, are the document.

    Results are sorted by ranges of ``ord``; no task holds them all.
    """
    own = causes.filter(F.col("run_id") == F.lit(run_id))
    head = json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0"})[:-1]
    spark = causes.sparkSession
    fixed = lambda at, text: spark.createDataFrame([(at, 0, text)], "part int, ord long, json string")
    rows = lambda at, df: df.select(F.lit(at).alias("part"), F.col("ord").cast("long"), "json")
    each = [
        fixed(0, f'{head}, "runs": [{{"tool": {{"driver": {{"name": {json.dumps(tool)}, "version": {json.dumps(version)}, "rules": ['),
        rows(1, sarif_rules(own)),
        fixed(2, ']}}, "results": ['),
        rows(3, sarif_results(own)),
        fixed(4, "]}]}"),
    ]
    lines = each[0]
    for df in each[1:]:
        lines = lines.union(df)
    comma = F.when(F.col("part").isin(1, 3) & (F.col("ord") > F.col("_least")), F.lit(",")).otherwise(F.lit(""))
    starts = lines.groupBy("part").agg(F.min("ord").alias("_least"))
    ordered = lines.join(F.broadcast(starts), "part").repartitionByRange("part", "ord").sortWithinPartitions("part", "ord")
    ordered.select(F.concat(comma, "json").alias("value")).write.mode("overwrite").text(path)


def confirm(findings: DataFrame, nodes: DataFrame, edges: DataFrame, verdict: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Every finding (finding, file, line, function) with its node, path, evidence, origin and status.

    The path is the shortest data flow from an entry point to the node; where there is
    none the shortest chain of calls, else there is no path. ``verdict`` makes a column from
    the evidence; it is asked for every finding, as a missing path proves nothing.
    """
    entries = nodes.filter("is_entry_point").select("id")
    edges = cut(edges)
    found = findings.join(locate(findings, nodes), "finding", "left")
    data = shortest_paths(edges, entries, (DATA,), None, alone=False).select(F.col("id").alias("node"), F.col("path").alias("_data"))
    call = shortest_paths(edges, entries, (CALLS,), None, alone=True).select(F.col("id").alias("node"), F.col("path").alias("_call"))
    none = F.array().cast(dict(call.dtypes)["_call"])
    placed = found.join(data, "node", "left").join(call, "node", "left").select(
        "finding", "node",
        F.coalesce("_data", "_call", none).alias("path"),
        F.when(F.col("_data").isNotNull(), "data_flow").when(F.col("_call").isNotNull(), "calls").otherwise("none").alias("path_kind"),
    )
    proof = evidence(placed, edges, "finding").withColumn("tainted_vars", F.coalesce("tainted_vars", F.array().cast("array<string>"))).withColumn(
        "unsanitized", F.coalesce("unsanitized", F.lit(False))
    ).withColumn("guards", F.coalesce("guards", F.array().cast("array<string>")))
    judged = proof.withColumn("verdict", (verdict or default_verdict)(proof))
    return judged.withColumn("status", verdict_status(F.coalesce("verdict", F.lit("")))).withColumn("origin", origin(F.col("path"), F.col("verdict")))


def to_json(findings: DataFrame) -> DataFrame:
    return findings.select(F.to_json(F.struct(*findings.columns)).alias("json"))


def _escaped(text) -> str:
    """Text in which Markdown marks nothing."""
    return "".join("\\" + c if c in "\\`*_{}[]()#+-|<>" else c for c in str(text))


def markdown_report(findings: list[dict], title: str = "Findings") -> str:
    """Text of a small collected set of findings, most severe first."""
    from quarry.seeds import SEVERITIES

    rank = {s: i for i, s in enumerate(SEVERITIES)}
    esc = _escaped
    lines = [f"# {esc(title)}", "", f"{len(findings)} findings", ""]
    for f in sorted(findings, key=lambda f: (rank.get(f.get("severity"), 9), f["id"])):
        lines += [f"## {esc(f['id'])}: {esc(f['type'])} ({f.get('severity', 'info')})", "", f"`{f['file']}:{f['line']}`", ""]
        if f.get("snippet"):
            fence = "```"
            while fence in f["snippet"]:
                fence += "`"
            lines += [fence, f["snippet"], fence, ""]
    return "\n".join(lines)


def executive_report(cause: dict) -> str:
    """One root cause for readers without code: risk, impact, advice."""
    part = lambda title, text: [f"## {title}", "", _escaped(text) or "not available", ""]
    lines = [f"# {_escaped(cause['finding_id'])}", "", f"Severity: {cause['severity']}, CVSS {cause['cvss_score']:.1f}", ""]
    lines += part("Risk", cause.get("summary", "")) + part("Impact", cause.get("blast_radius", "")) + part("Advice", cause.get("remediation_summary", ""))
    return "\n".join(lines)


def technical_report(cause: dict) -> str:
    """One root cause with its places and code, secrets redacted."""
    lines = [f"## {_escaped(cause['finding_id'])}: {_escaped(cause['type'])}", "", f"Severity: {cause['severity']}, CVSS {cause['cvss_score']:.1f} ({cause.get('cvss_vector', '')})", ""]
    lines += [_escaped(cause.get("root_cause", "")) or "not available", ""]
    lines += [f"- `{x}`" for x in [*cause.get("affected_files", []), *cause.get("affected_lines", [])]]
    for title, field in (("Vulnerable", "vulnerable_code"), ("Fixed", "fixed_code")):
        if cause.get(field):
            code = redact_text(cause[field])
            fence = "```"
            while fence in code:
                fence += "`"
            lines += ["", f"### {title}", "", fence, code, fence]
    return "\n".join(lines)


def consolidated_report(causes: list[dict]) -> str:
    """All root causes: a table, then the technical report of each, in the order given."""
    head = ["# Findings", "", f"{len(causes)} findings", "", "| id | type | severity | CVSS |", "|-|-|-|-|"]
    head += [f"| {_escaped(c['finding_id'])} | {_escaped(c['type'])} | {c['severity']} | {c['cvss_score']:.1f} |" for c in causes]
    return "\n\n".join(["\n".join(head), *map(technical_report, causes)])


def balanced_json(text: str) -> list[dict]:
    """Objects of the first JSON value in noisy text: a fenced block, else the first balanced brackets."""
    decoder = json.JSONDecoder()
    for at, c in enumerate(text):
        if c in "[{":
            try:
                value, _ = decoder.raw_decode(text[at:])
            except ValueError:
                continue
            items = value if isinstance(value, list) else value.get("findings", [value]) if isinstance(value, dict) else []
            return [x for x in items if isinstance(x, dict)]
    return []


def taint_steps(paths: DataFrame, key: str, limit: int = 300) -> DataFrame:
    """(key, steps): each node of ``path`` with its hop and note as one text."""
    each = F.arrays_zip("path", "hops", "notes")
    note = lambda x: F.substring(F.concat_ws(" — ", F.when(x["hops"] != "", x["hops"]), F.when(x["notes"] != "", x["notes"])), 1, limit)
    return paths.select(key, F.transform(each, lambda x: F.struct(x["path"].alias("node"), note(x).alias("note"))).alias("steps"))


def root_causes(findings: DataFrame, by: str) -> DataFrame:
    """Fallback causes: per type its sorted files and the number of findings."""
    return findings.groupBy(by).agg(F.array_sort(F.collect_set("file")).alias("affected_files"), F.count("*").alias("findings"))


def backend(memory_gb: Column) -> Column:
    """Embedding backend by memory."""
    return F.when(memory_gb >= 40, "local_gpu").when(memory_gb >= 16, "local_cpu").otherwise("hash")
