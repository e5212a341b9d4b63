"""Building and querying the code graph as node and edge tables.

Edges are (src, dst, type, data_vars, condition, sanitized). Searches run level by
level: each level joins the frontier with the edges and drops visited nodes by an
anti-join; levels are cut to reliable storage so that plans stay short.
"""

from __future__ import annotations

import itertools
import json
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CALLS, DATA, CONTROL = "calls", "data_flow", "control_flow"
CALL_SITE = r"\b([A-Za-z_]\w*)\s*\("


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint into the session's shared folder; only a session on one machine may name none."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quarry-"))
    return df.checkpoint(eager=True)


# -- construction ------------------------------------------------------------


def squash_condition(c: Column, limit: int = 160) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, limit)


def emit_edges(calls: DataFrame) -> DataFrame:
    """Resolved calls (src, dst, data_vars, returns_to, guards, sanitized) to edges.

    A call is an edge; with tainted arguments also a data flow; a used result is a
    data flow back; guards give a control flow. Self edges are dropped.
    """
    none = F.array().cast("array<string>")
    lit = lambda s, d, t, v, c, z: F.struct(
        s.alias("src"), d.alias("dst"), F.lit(t).alias("type"), v.alias("data_vars"), c.alias("condition"), z.alias("sanitized")
    )
    src, dst = F.col("src"), F.col("dst")
    no, guard = F.lit(""), squash_condition(F.array_join("guards", " & "))
    rows = F.array(
        lit(src, dst, CALLS, none, no, F.lit(False)),
        F.when(F.size("data_vars") > 0, lit(src, dst, DATA, F.array_sort("data_vars"), no, F.col("sanitized"))),
        F.when(F.col("returns_to").isNotNull(), lit(dst, src, DATA, F.array(F.col("returns_to")), no, F.lit(False))),
        F.when(F.size("guards") > 0, lit(src, dst, CONTROL, none, guard, F.lit(False))),
    )
    return calls.filter("src != dst").select(F.explode(F.array_compact(rows)).alias("e")).select("e.*")


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst, type): variables united, sanitized only if all are, distinct conditions joined."""
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("data_vars"))))
    texts = F.filter(F.array_sort(F.collect_set("condition")), lambda c: c != "")
    return edges.groupBy("src", "dst", "type").agg(
        names.alias("data_vars"), F.array_join(texts, " | ").alias("condition"), F.every("sanitized").alias("sanitized")
    )


def first_edges(edges: DataFrame, order: list) -> DataFrame:
    """First edge per (src, dst, type)."""
    w = Window.partitionBy("src", "dst", "type").orderBy(*order)
    return edges.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def call_graph(chunks: DataFrame, order: str = "ord") -> DataFrame:
    """Calls by name where only text is known: call sites met with the first chunk of that name.

    An equi-join on exploded call sites, never a comparison of every chunk with every name.
    """
    sites = chunks.select(F.col("id").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(CALL_SITE), 1))).alias("name"))
    names = chunks.groupBy("name").agg(F.min_by("id", order).alias("dst"))
    return sites.join(names, "name").filter("src != dst").select("src", "dst", F.lit(CALLS).alias("type")).distinct()


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Binds call names to symbols: same file first, then the only one of that name; ambiguity binds nothing.

    ``calls``: (src, file, name); ``symbols``: (id, file, name).
    """
    own = symbols.groupBy(F.col("file").alias("_f"), F.col("name").alias("_n")).agg(F.min("id").alias("_own"), F.count_distinct("id").alias("_k"))
    every = symbols.groupBy(F.col("name").alias("_m")).agg(F.min("id").alias("_only"), F.count_distinct("id").alias("_c"))
    return (
        calls.join(own.filter("_k = 1"), (F.col("file") == F.col("_f")) & (F.col("name") == F.col("_n")), "left")
        .join(every.filter("_c = 1"), F.col("name") == F.col("_m"), "left")
        .withColumn("dst", F.coalesce("_own", "_only"))
        .drop("_f", "_n", "_own", "_k", "_m", "_only", "_c")
    )


def expand_aliases(calls: DataFrame, aliases: DataFrame) -> DataFrame:
    """``resolved``: the first segment replaced by what the file imported under it. ``aliases``: (file, alias, target)."""
    head, rest = F.regexp_extract("name", r"^([^.]*)", 1), F.regexp_extract("name", r"^[^.]*(\..*)?$", 1)
    return calls.withColumn("_h", head).withColumn("_t", rest).join(
        aliases.select("file", F.col("alias").alias("_h"), "target"), ["file", "_h"], "left"
    ).withColumn("resolved", F.concat(F.coalesce("target", "_h"), "_t")).drop("_h", "_t", "target")


def module_suffixes(files: DataFrame, path: str = "file") -> DataFrame:
    """(suffix, file) of dotted module names; a suffix two files share maps to ''."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), r"/__init__$", ""), "/")
    each = files.select(path, parts.alias("_p")).distinct().select(
        path, F.explode(F.transform(F.sequence(F.lit(1), F.size("_p")), lambda i: F.array_join(F.slice("_p", i, 10_000), "."))).alias("suffix")
    )
    return each.groupBy("suffix").agg(F.when(F.count_distinct(path) == 1, F.min(path)).otherwise("").alias(path))


def node_type(kind: Column, name: Column) -> Column:
    return F.coalesce(F.when(kind.isin("function", "method", "class", "module"), kind), F.when(name == "<module>", "module").otherwise("function"))


# -- searches ----------------------------------------------------------------


def reach(edges: DataFrame, targets: DataFrame, hops: int, kinds: tuple[str, ...] = (CALLS,)) -> DataFrame:
    """(id, hop): nodes that reach a target along at most ``hops`` edges; targets have hop 0."""
    back = edges.filter(F.col("type").isin(*kinds)).select(F.col("dst").alias("id"), F.col("src").alias("_from")).distinct()
    return _spread(back, targets, hops)


def _spread(steps: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    steps = cut(steps)  # read and made distinct once, not once per level
    seen = cut(start.select("id").distinct().withColumn("hop", F.lit(0)))
    frontier = seen
    for level in range(1, hops + 1):
        frontier = cut(
            frontier.select("id").join(steps, "id").select(F.col("_from").alias("id")).distinct()
            .join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(level))
        )
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def neighbourhood(edges: DataFrame, focus: DataFrame, depth: int) -> DataFrame:
    """(id, hop) within ``depth`` edges in either direction."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("_from")).union(edges.select(F.col("dst").alias("id"), F.col("src").alias("_from")))
    return _spread(both.distinct(), focus, depth)


def shortest_paths(edges: DataFrame, sources: DataFrame, kinds: tuple[str, ...], max_hops: int | None, *, alone: bool) -> DataFrame:
    """(id, path): for every node reached from ``sources`` its shortest path, the smallest among equals.

    ``alone``: sources count as paths of one node. Paths grow level by level; each
    node keeps one, so a level is never larger than the set of nodes. Without ``max_hops``
    the search goes on until no new node is found.
    """
    steps = edges.filter(F.col("type").isin(*kinds)).select(F.col("src").alias("id"), F.col("dst").alias("_to")).distinct()
    steps = cut(steps)
    seen = cut(sources.select("id").distinct().withColumn("path", F.array(F.col("id"))))
    frontier = seen
    for _ in itertools.count() if max_hops is None else range(max_hops):
        grown = frontier.join(steps, "id").select(F.col("_to").alias("id"), F.concat("path", F.array("_to")).alias("path"))
        frontier = cut(grown.join(seen.select("id"), "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen if alone else seen.filter(F.size("path") > 1)


def match_nodes(nodes: DataFrame, spec: str) -> DataFrame:
    """``file::name`` or a name; parts of names, whatever their case, only if no name is equal."""
    if "::" in spec:
        file, name = spec.split("::", 1)
        return nodes.filter((F.col("name") == name) & F.contains("file", F.lit(file)))
    exact = nodes.filter(F.col("name") == spec)
    return exact if not exact.isEmpty() else nodes.filter(F.contains(F.lower("name"), F.lit(spec.lower())))


def induced(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The subgraph on ``ids``."""
    ids = ids.select("id").distinct()
    inner = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes.join(ids, "id", "left_semi"), inner


def select_view(nodes: DataFrame, edges: DataFrame, *, kinds: tuple[str, ...] = (), focus: str | None = None, depth: int = 1, only_flows: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges of the kinds, nodes around the focus, and of those the ones on data or control flows."""
    shown = edges.filter(F.col("type").isin(*kinds)) if kinds else edges
    ids = nodes.select("id")
    if focus is not None:
        ids = neighbourhood(shown, match_nodes(nodes, focus).select("id"), depth).select("id")
    if only_flows:
        flow = edges.filter(F.col("type").isin(DATA, CONTROL))
        ids = ids.join(flow.select(F.col("src").alias("id")).union(flow.select(F.col("dst").alias("id"))).distinct(), "id", "left_semi")
    return induced(nodes, shown, ids)


def hop_labels(paths: DataFrame, edges: DataFrame, key: str = "key") -> DataFrame:
    """(key, hops): for each step of ``path`` the label of its edges: variables and state, then conditions."""
    pairs = paths.select(key, "path", F.posexplode(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1)))).alias("_i", "_k")).filter(
        F.size("path") > 1
    ).select(key, "_i", F.get("path", F.col("_k") - 1).alias("src"), F.get("path", F.col("_k")).alias("dst"))
    state = F.when(F.col("sanitized"), "sanitized").otherwise("unsanitized")
    text = F.when(F.col("type") == DATA, F.concat(F.array_join("data_vars", ", "), F.lit(" ("), state, F.lit(")"))).when(
        F.col("type") == CONTROL, F.concat(F.lit("only "), "condition")
    )
    each = pairs.join(edges.filter(F.col("type").isin(DATA, CONTROL)), ["src", "dst"], "left")
    hop = each.groupBy(key, "_i").agg(F.array_join(F.array_sort(F.collect_set(text)), " · ").alias("_h"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_h"))), lambda x: x["_h"])
    return hop.groupBy(key).agg(ordered.alias("hops"))


def tainted(hops: Column) -> Column:
    """A path is tainted if a hop is unsanitized or nothing is known of any hop."""
    return F.exists(hops, lambda h: F.contains(h, F.lit("unsanitized"))) | F.forall(hops, lambda h: h == "")


def flow_paths(nodes: DataFrame, edges: DataFrame, *, max_hops: int | None = None, limit: int = 40) -> DataFrame:
    """(kind, sink, path, hops, tainted): the shortest path from any entry to each sink, data flows first."""
    entries, sinks = nodes.filter("is_entry_point").select("id"), nodes.filter("is_sink").select("id")
    edges = cut(edges)
    found = None
    for kind in (DATA, CALLS):
        part = shortest_paths(edges, entries, (kind,), max_hops, alone=True).join(sinks, "id", "left_semi")
        part = part.select(F.lit(kind).alias("kind"), F.col("id").alias("sink"), "path")
        found = part if found is None else found.unionByName(part)
    order = F.when(F.col("kind") == DATA, 0).otherwise(1)
    one = found.groupBy("path").agg(F.min_by("kind", order).alias("kind"), F.first("sink").alias("sink"))
    one = one.withColumn("key", F.sha2(F.array_join("path", "\x1f"), 256))
    labelled = one.join(hop_labels(one, edges), "key", "left").withColumn("hops", F.coalesce("hops", F.array().cast("array<string>")))
    return (
        labelled.select("kind", "sink", "path", "hops", tainted(F.col("hops")).alias("tainted"))
        .orderBy(F.desc("tainted"), F.when(F.col("kind") == DATA, 0).otherwise(1), F.size("path"), "path")
        .limit(limit)
    )


def evidence(paths: DataFrame, edges: DataFrame, key: str = "key", max_guards: int = 5) -> DataFrame:
    """Per path: tainted variables, whether a hop is unsanitized, guards, path kind."""
    pairs = paths.filter(F.size("path") > 1).select(
        key, "path", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("_k")
    ).select(key, F.get("path", F.col("_k") - 1).alias("src"), F.get("path", F.col("_k")).alias("dst"))
    hops = pairs.join(edges, ["src", "dst"])
    data, guard = F.col("type") == DATA, F.col("type") == CONTROL
    facts = hops.groupBy(key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(data, F.col("data_vars")))))).alias("tainted_vars"),
        F.coalesce(F.bool_or(F.when(data, ~F.col("sanitized"))), F.lit(False)).alias("unsanitized"),
        F.slice(F.array_sort(F.collect_set(F.when(guard, F.col("condition")))), 1, max_guards).alias("guards"),
    )
    return paths.join(facts, key, "left")


def origin(path: Column, verdict: Column) -> Column:
    """What a finding rests on."""
    return F.when(F.coalesce(F.size(path), F.lit(0)) <= 0, "llm").when(verdict.isNotNull(), "graph+llm").otherwise("graph")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, n)."""
    return (
        nodes.agg(F.count("*").alias("nodes"), F.count_if("is_entry_point").alias("entry_points"), F.count_if("is_sink").alias("sinks"))
        .unpivot([], ["nodes", "entry_points", "sinks"], "metric", "n")
        .union(edges.groupBy(F.concat(F.lit("edges:"), "type").alias("metric")).agg(F.count("*").alias("n")))
    )


def _tree(nodes: list[dict], edges: list[dict], depth: int) -> list[str]:
    """Nodes below each entry point, or below the first twenty if there is none; what stands above a node ends there."""
    by_id = {n["id"]: n for n in nodes}
    below: dict = {}
    for e in edges:
        if e["src"] in by_id and e["dst"] in by_id:
            below.setdefault(e["src"], {}).setdefault(e["dst"], []).append(e)
    roots = [n for n in nodes if n.get("is_entry_point")] or sorted(nodes, key=lambda n: n["name"])[:20]
    lines = []
    todo = [(n["id"], 0, "", frozenset()) for n in reversed(roots)]
    while todo:
        at, level, how, above = todo.pop()
        mark = " (sink)" if by_id[at].get("is_sink") else ""
        lines.append("  " * level + how + by_id[at]["name"] + mark + (" ..." if at in above or level == depth else ""))
        if at in above or level == depth:
            continue
        for dst, group in sorted(below.get(at, {}).items(), key=lambda x: by_id[x[0]]["name"], reverse=True):
            todo.append((dst, level + 1, ",".join(sorted({e["type"] for e in group})) + ": ", above | {at}))
    return lines


def render_paths(paths: list[dict], names: dict) -> str:
    """Text of collected ``flow_paths``: each path's nodes with the label of the hop that leads on."""
    lines = []
    for i, p in enumerate(paths, 1):
        lines.append(f"[{i}] {'unsanitized' if p['tainted'] else 'sanitized'}")
        for k, node in enumerate(p["path"]):
            lines.append(f"    {k + 1}. {names.get(node, node)}")
            if k < len(p["hops"]) and p["hops"][k]:
                lines.append(f"       | {p['hops'][k]}")
    return "\n".join(lines) if lines else "no path from an entry point to a sink"


def render(nodes: list[dict], edges: list[dict], kind: str = "dot", depth: int = 6) -> str:
    """Text of a small collected view: ``dot``, ``mermaid``, ``tree`` or ``json``; entry points and sinks are marked."""
    def quote(s: str) -> str:
        return s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", " ")

    number = {n["id"]: f"n{i}" for i, n in enumerate(nodes)}
    edges = [e for e in edges if e["src"] in number and e["dst"] in number]
    colour = lambda n: "red" if n.get("is_sink") else "green" if n.get("is_entry_point") else ""
    if kind == "dot":
        lines = ["digraph code {"]
        lines += [f'  {number[n["id"]]} [label="{quote(n["name"])}"{f" color={colour(n)}" if colour(n) else ""}];' for n in nodes]
        lines += [f'  {number[e["src"]]} -> {number[e["dst"]]} [label="{quote(e["type"])}"];' for e in edges]
        return "\n".join([*lines, "}"])
    if kind == "mermaid":
        clean = str.maketrans('"[]{}|<>', "'()()/  ")
        lines = ["flowchart TD"]
        lines += [f'  {number[n["id"]]}["{n["name"].translate(clean)}"]' for n in nodes]
        lines += [f'  {number[e["src"]]} -->|{e["type"].translate(clean)}| {number[e["dst"]]}' for e in edges]
        lines += [f"  style {number[n['id']]} stroke:{colour(n)}" for n in nodes if colour(n)]
        return "\n".join(lines)
    if kind == "tree":
        return "\n".join(_tree(nodes, edges, depth))
    if kind == "json":
        return json.dumps({"nodes": nodes, "edges": edges}, ensure_ascii=False, default=str)
    raise ValueError(f"unknown kind {kind}")


def graph_tables(spark: SparkSession, nodes: list[tuple], edges: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of literal rows."""
    return (
        spark.createDataFrame(nodes, "id string, name string, file string, is_entry_point boolean, is_sink boolean"),
        spark.createDataFrame(edges, "src string, dst string, type string, data_vars array<string>, condition string, sanitized boolean"),
    )
