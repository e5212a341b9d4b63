"""The whole code graph of a corpus: nodes, entry points, sinks and edges, and notes on its flows."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import seeds
from quarry.functions.text import signature, squash
from quarry.operators import flow
from quarry.operators.graph import CONTROL, DATA, call_graph, cut, merge_edges, node_type
from quarry.operators.prefilter import is_entry, match_qualified, match_sinks

#: The name of code outside all functions.
MODULE = "<module>"


def decorators(chunks: DataFrame) -> DataFrame:
    """(id, decorators): dotted names of the decorators of the definition that a Python chunk is.

    A call is named by what it calls; other expressions have no name and are left out.
    Chunks that don't parse have no row.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, code in zip(batch["id"], batch["code"]):
                tree = flow._parse(code or "")
                if tree is None:
                    continue
                top = tree.body[0] if tree.body else None
                held = top.decorator_list if isinstance(top, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else []
                names = (flow.dotted(d.func if isinstance(d, ast.Call) else d) for d in held)
                rows.append((key, [n for n in names if n]))
            yield pd.DataFrame(rows, columns=["id", "decorators"])

    kind = dict(chunks.dtypes)["id"]
    return chunks.filter("language = 'python'").select("id", "code").mapInPandas(find, f"id {kind}, decorators array<string>")


def build_graph(
    files: DataFrame, chunks: DataFrame, patterns: DataFrame, models: DataFrame | None = None,
    *, sources: list[str] | None = None, sanitizers: list[str] | None = None,
) -> dict[str, DataFrame]:
    """``nodes``, ``sinks`` and ``edges`` of a corpus.

    ``files``: (file, language, code); ``chunks`` as ``chunking.chunk`` makes them;
    ``patterns``: (language, entry_patterns, sink_patterns); ``models``: (pattern, sink_type)
    of qualified calls; ``sources`` and ``sanitizers`` replace those of Python.

    Where a chunk has a syntax tree, entry points are found by name, decorator or text,
    sinks by resolved calls, and edges carry data and guards. Elsewhere patterns are
    looked for in the text and only calls by name are known. Nodes are numbered in order
    of file and line, module nodes after all others: they span whole files, so a search
    by line has to meet them last.
    """
    chunks = cut(chunks.select("id", "file", "language", "name", "qualname", "kind", "code", "line_start", "line_end"))
    python = chunks.filter("language = 'python'")
    known = decorators(chunks)
    edges, calls = flow.python_graph(files.filter("language = 'python'"), python, sources, sanitizers)
    calls = cut(calls)
    names = calls.groupBy(F.col("src").alias("id")).agg(F.collect_set("resolved").alias("names"))
    facts = cut(
        chunks.join(known, "id", "left").join(names, "id", "left").withColumn("precise", F.col("decorators").isNotNull())
        .withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    )
    entries = patterns.select("language", F.explode("entry_patterns").alias("pattern"))
    by_entry = facts.join(entries, "language").filter(
        F.when(F.col("precise"), is_entry(F.col("name"), F.coalesce("decorators", F.array().cast("array<string>")), F.col("code"), F.col("pattern")))
        .otherwise(F.contains("code", F.col("pattern")))
    ).select("id").distinct()
    kinds = F.create_map(*(F.lit(x) for pair in seeds.SINK_TYPES for x in pair))
    held = patterns.select("language", F.explode("sink_patterns").alias("pattern"))
    held = held.withColumn("sink_type", F.coalesce(F.element_at(kinds, F.regexp_replace("pattern", r"\($", "")), F.lit("unknown")))
    matched = match_sinks(facts, held).select("id", "pattern", "sink_type")
    if models is not None:
        qualified = match_qualified(calls.select(F.col("src").alias("id"), F.col("resolved").alias("name")), models)
        matched = matched.union(qualified.select("id", "pattern", "sink_type").distinct())
    sinks = cut(matched)
    order = F.struct((F.col("type") == "module").alias("m"), "file", "line_start", "line_end", "id")
    nodes = (
        chunks.join(by_entry.withColumn("is_entry_point", F.lit(True)), "id", "left")
        .join(sinks.select("id").distinct().withColumn("is_sink", F.lit(True)), "id", "left")
        .select(
            "id", node_type(F.col("kind"), F.col("name")).alias("type"), "name", "file", "line_start", "line_end", signature(F.col("code")).alias("signature"),
            F.coalesce("is_entry_point", F.lit(False)).alias("is_entry_point"), F.coalesce("is_sink", F.lit(False)).alias("is_sink"),
        )
        .withColumn("tags", F.when(F.col("is_entry_point"), F.array(F.lit("user_input"))).otherwise(F.array().cast("array<string>")))
        .withColumn("ord", order)
    )
    plain = facts.filter("NOT precise").select("id")
    named = chunks.withColumn("ord", F.struct("file", "line_start", "id")).withColumn("name", F.when(F.col("name") != MODULE, F.col("name")))
    by_name = call_graph(named).join(plain.withColumnRenamed("id", "src"), "src", "left_semi").select(
        "src", "dst", "type", F.array().cast("array<string>").alias("data_vars"), F.lit("").alias("condition"), F.lit(False).alias("sanitized")
    )
    return {"nodes": nodes, "sinks": sinks, "edges": merge_edges(edges.unionByName(by_name))}


def field(c: Column, limit: int = 80) -> Column:
    """Text of the analysed code for a line of notes: on one line and short."""
    return squash(c, limit)


def flow_notes(nodes: DataFrame, edges: DataFrame, limit: int = 4) -> DataFrame:
    """(id, incoming, outgoing): what is known of the data that enters and leaves each node.

    Incoming are data flows from other nodes; outgoing are data flows, then calls that a
    condition guards. Of each at most ``limit``, by the name of the other node.
    """
    ends = nodes.select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    both = edges.join(ends.toDF("src", "_from"), "src").join(ends.toDF("dst", "_to"), "dst")
    state = F.when(F.col("sanitized"), " (sanitized)").otherwise(" (unsanitized)")
    data = both.filter((F.col("type") == DATA) & (F.size("data_vars") > 0)).withColumn("_vars", field(F.array_join("data_vars", ", ")))
    guard = both.filter((F.col("type") == CONTROL) & (F.col("condition") != ""))
    coming = data.select(F.col("dst").alias("id"), F.lit(0).alias("_way"), field(F.col("_from")).alias("_other"), F.concat("_vars", F.lit(" from "), field(F.col("_from")), state).alias("_note"))
    going = data.select(F.col("src").alias("id"), F.lit(1).alias("_way"), field(F.col("_to")).alias("_other"), F.concat("_vars", F.lit(" to "), field(F.col("_to")), state).alias("_note"))
    only = guard.select(F.col("src").alias("id"), F.lit(2).alias("_way"), field(F.col("_to")).alias("_other"), F.concat(F.lit("calls "), field(F.col("_to")), F.lit(" only if "), field(F.col("condition"))).alias("_note"))
    notes = coming.union(going).union(only)
    each = F.array_sort(F.collect_list(F.struct("_way", "_other", "_note")))
    held = notes.groupBy("id").agg(each.alias("_n"))
    take = lambda test: F.slice(F.transform(F.filter("_n", test), lambda x: x["_note"]), 1, limit)
    return held.select("id", take(lambda x: x["_way"] == 0).alias("incoming"), take(lambda x: x["_way"] > 0).alias("outgoing"))


def chunk_header(nodes: DataFrame, sinks: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, header): place, roles and flows of each node in lines before its code."""
    kinds = sinks.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("sink_type", F.lit("unknown")))), ", ").alias("_kinds"))
    roles = F.concat_ws("; ", F.when(F.col("is_entry_point"), "entry point"), F.concat(F.lit("sink: "), "_kinds"))
    line = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(title), F.array_join(c, "; ")))
    place = F.format_string("FILE: %s FUNC: %s LINES: %d-%d", "file", "name", "line_start", "line_end")
    return (
        nodes.join(kinds, "id", "left").join(flow_notes(nodes, edges), "id", "left")
        .select("id", F.concat_ws("\n", place, F.when(roles != "", F.concat(F.lit("ROLE: "), roles)), line("IN: ", "incoming"), line("OUT: ", "outgoing")).alias("header"))
    )
