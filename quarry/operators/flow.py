"""Facts about Python functions: calls, what flows into them, guards; and the graph they form."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import seeds
from quarry.operators.graph import emit_edges, expand_aliases, merge_edges, resolve_calls

CALLS = "src string, file string, name string, data_vars array<string>, returns_to string, guards array<string>, sanitized boolean"


@dataclass
class State:
    """Names that carry outside data, and those that did before they were made harmless."""

    dirty: set[str] = field(default_factory=set)
    clean: set[str] = field(default_factory=set)

    def copy(self) -> State:
        return State(set(self.dirty), set(self.clean))

    def join(self, other: State) -> State:
        """After a branch: dirty if dirty on either way, clean if clean on both and dirty on none."""
        dirty = self.dirty | other.dirty
        return State(dirty, (self.clean & other.clean) - dirty)


def dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = dotted(node.value)
        return f"{head}.{node.attr}" if head else node.attr
    return ""


def _matches(name: str, patterns: list[str]) -> bool:
    segments = f".{name}."
    return any(f".{p.rstrip('(')}." in segments for p in patterns)


class FlowVisitor:
    """One pass over a function body in order of execution; every expression is visited."""

    def __init__(self, sources: list[str], sanitizers: list[str], fields: set[str] = frozenset()):
        self.sources, self.sanitizers = sources, sanitizers
        self.calls: list[dict] = []
        self.guards: list[str] = []
        self.state = State(set(fields), set())
        self.written: set[str] = set()

    def run(self, node: ast.AST) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a = node.args
            every = [*a.posonlyargs, *a.args, *a.kwonlyargs, *(x for x in (a.vararg, a.kwarg) if x)]
            self.state.dirty |= {x.arg for x in every if x.arg not in ("self", "cls")}
        self.block(node.body)

    def block(self, body: list[ast.stmt]) -> None:
        for statement in body:
            self.statement(statement)

    def names(self, node: ast.AST) -> tuple[set[str], set[str]]:
        """(dirty, clean) names an expression reads, those inside sanitizer calls counted as clean."""
        if isinstance(node, ast.Call):
            inner = [*node.args, *(k.value for k in node.keywords)]
            dirty, clean = set(), set()
            for x in [*inner, *([node.func.value] if isinstance(node.func, ast.Attribute) else [])]:
                d, c = self.names(x)
                dirty, clean = dirty | d, clean | c
            if _matches(dotted(node.func), self.sanitizers):
                return set(), clean | dirty
            return dirty, clean
        if isinstance(node, (ast.Name, ast.Attribute)) and (name := dotted(node)):
            if name in self.state.dirty or name.split(".")[0] in self.state.dirty:
                return {name}, set()
            if name in self.state.clean or name.split(".")[0] in self.state.clean:
                return set(), {name}
            return set(), set()
        dirty, clean = set(), set()
        for x in ast.iter_child_nodes(node):
            d, c = self.names(x)
            dirty, clean = dirty | d, clean | c
        return dirty, clean

    def from_source(self, node: ast.AST) -> bool:
        return any(isinstance(x, (ast.Call, ast.Attribute, ast.Name)) and _matches(dotted(x.func if isinstance(x, ast.Call) else x), self.sources) for x in ast.walk(node))

    def expression(self, node: ast.AST | None, returns_to: str | None = None) -> None:
        """Record the calls of an expression, inner ones first."""
        if node is None:
            return
        for x in ast.iter_child_nodes(node):
            self.expression(x)
        if isinstance(node, ast.Call) and (name := dotted(node.func)):
            dirty, clean = set(), set()
            for x in [*node.args, *(k.value for k in node.keywords)]:
                d, c = self.names(x)
                dirty, clean = dirty | d, clean | c
            self.calls.append(
                {
                    "name": name,
                    "data_vars": sorted(dirty | clean),
                    "returns_to": returns_to,
                    "guards": list(self.guards),
                    "sanitized": bool(clean) and not dirty,
                }
            )

    def assign(self, targets: list[ast.AST], value: ast.AST) -> None:
        names = [dotted(t) for target in targets for t in (target.elts if isinstance(target, (ast.Tuple, ast.List)) else [target])]
        names = [n for n in names if n]
        self.expression(value, names[0] if names and isinstance(value, ast.Call) else None)
        dirty, clean = self.names(value)
        washed = any(isinstance(x, ast.Call) and _matches(dotted(x.func), self.sanitizers) for x in ast.walk(value))
        for n in names:
            self.state.dirty.discard(n)
            self.state.clean.discard(n)
            if washed:
                self.state.clean.add(n)
            elif dirty or self.from_source(value):
                self.state.dirty.add(n)
                self.written.add(n)
            elif clean:
                self.state.clean.add(n)

    def guarded(self, text: str, body: list[ast.stmt]) -> None:
        self.guards.append(text)
        self.block(body)
        self.guards.pop()

    def statement(self, s: ast.stmt) -> None:
        if isinstance(s, ast.Assign):
            self.assign(s.targets, s.value)
        elif isinstance(s, (ast.AnnAssign, ast.AugAssign)):
            if s.value is not None:
                self.assign([s.target], s.value)
        elif isinstance(s, ast.If):
            self.expression(s.test)
            before = self.state.copy()
            self.guarded(f"if {ast.unparse(s.test)}", s.body)
            after, self.state = self.state, before
            if s.orelse:
                self.guarded(f"if not ({ast.unparse(s.test)})", s.orelse)
            self.state = self.state.join(after)
        elif isinstance(s, (ast.For, ast.AsyncFor)):
            self.assign([s.target], s.iter)
            before = self.state.copy()
            self.guarded(f"for {ast.unparse(s.target)} in {ast.unparse(s.iter)}", s.body)
            self.state = self.state.join(before)
            self.block(s.orelse)
        elif isinstance(s, ast.While):
            self.expression(s.test)
            before = self.state.copy()
            self.guarded(f"while {ast.unparse(s.test)}", s.body)
            self.state = self.state.join(before)
            self.block(s.orelse)
        elif isinstance(s, (ast.With, ast.AsyncWith)):
            for item in s.items:
                if item.optional_vars is not None:
                    self.assign([item.optional_vars], item.context_expr)
                else:
                    self.expression(item.context_expr)
            self.block(s.body)
        elif isinstance(s, ast.Try):
            before = self.state.copy()
            self.block(s.body)
            done = self.state
            for h in s.handlers:
                self.state = before.copy()
                self.block(h.body)
                done = done.join(self.state)
            self.state = done
            self.block(s.orelse)
            self.block(s.finalbody)
        elif isinstance(s, ast.Match):
            self.expression(s.subject)
            before, done = self.state.copy(), self.state.copy()
            for case in s.cases:
                self.state = before.copy()
                self.guarded(f"case {ast.unparse(case.pattern)}", case.body)
                done = done.join(self.state)
            self.state = done
        elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            self.block(s.body)
        else:
            for x in ast.iter_child_nodes(s):
                self.expression(x)


def imports(tree: ast.Module) -> list[tuple[str, str]]:
    """(alias, target) of a module's imports."""
    out = []
    for x in ast.walk(tree):
        if isinstance(x, ast.Import):
            out += [(a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0]) for a in x.names]
        elif isinstance(x, ast.ImportFrom):
            base = x.module or ""
            out += [(a.asname or a.name, f"{base}.{a.name}" if base else a.name) for a in x.names]
    return out


def _parse(code: str) -> ast.Module | None:
    import textwrap

    try:
        return ast.parse(textwrap.dedent(code))
    except (SyntaxError, ValueError, RecursionError):
        return None


def aliases(files: DataFrame) -> DataFrame:
    """(file, alias, target) of Python files (file, code)."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, a, t) for f, c in zip(batch["file"], batch["code"]) if (tree := _parse(c or "")) for a, t in imports(tree)]
            yield pd.DataFrame(rows, columns=["file", "alias", "target"])

    return files.select("file", "code").mapInPandas(find, "file string, alias string, target string").distinct()


def calls(chunks: DataFrame, sources: list[str] | None = None, sanitizers: list[str] | None = None, fields: DataFrame | None = None) -> DataFrame:
    """Call facts of Python chunks (id, file, code[, fields array<string>])."""
    src, san = sources or seeds.PY_SOURCES, sanitizers or seeds.PY_SANITIZERS
    if fields is not None:
        chunks = chunks.withColumn("_c", F.regexp_extract("qualname", r"^(.*)\.[^.]+$", 1)).join(fields.withColumnRenamed("class", "_c"), ["file", "_c"], "left").drop("_c")
    else:
        chunks = chunks.withColumn("fields", F.lit(None).cast("array<string>"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CALLS.split(", ")]
        for batch in batches:
            rows = []
            for i, file, code, held in zip(batch["id"], batch["file"], batch["code"], batch["fields"]):
                tree = _parse(code or "")
                if tree is None:
                    continue
                top = tree.body[0] if len(tree.body) == 1 else tree
                v = FlowVisitor(src, san, set(held) if held is not None else set())
                v.run(top if isinstance(top, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else tree)
                rows += [(i, file, c["name"], c["data_vars"], c["returns_to"], c["guards"], c["sanitized"]) for c in v.calls]
            yield pd.DataFrame(rows, columns=names)

    return chunks.select("id", "file", "code", "fields").mapInPandas(find, CALLS)


def parsed_calls(chunks: DataFrame, parsers: Mapping[str, Callable[[str], list[dict] | None]]) -> DataFrame:
    """Call facts of chunks (id, file, language, code) by parsers of their languages, in the columns of ``calls``.

    A parser returns dicts with ``name`` and, where known, ``data_vars``, ``returns_to``, ``guards`` and
    ``sanitized``; None if the chunk doesn't parse. Languages without a parser give no rows.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CALLS.split(", ")]
        for batch in batches:
            rows = []
            for i, file, language, code in zip(batch["id"], batch["file"], batch["language"], batch["code"]):
                for c in parsers[language](code or "") or []:
                    rows.append((i, file, c["name"], sorted(set(c.get("data_vars", ()))), c.get("returns_to"), list(c.get("guards", ())), bool(c.get("sanitized", False))))
            yield pd.DataFrame(rows, columns=names)

    held = chunks.filter(F.col("language").isin(list(parsers)))
    return held.select("id", "file", "language", "code").mapInPandas(find, CALLS)


def class_fields(chunks: DataFrame, sources: list[str] | None = None, sanitizers: list[str] | None = None) -> DataFrame:
    """(file, class, fields): attributes that some method of the class fills with outside data (first pass)."""
    src, san = sources or seeds.PY_SOURCES, sanitizers or seeds.PY_SANITIZERS

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, qual, code in zip(batch["file"], batch["qualname"], batch["code"]):
                tree = _parse(code or "")
                if tree is None or "." not in (qual or "") or not tree.body:
                    continue
                v = FlowVisitor(src, san)
                v.run(tree.body[0] if hasattr(tree.body[0], "body") else tree)
                rows += [(file, qual.rpartition(".")[0], n) for n in v.written if n.startswith("self.")]
            yield pd.DataFrame(rows, columns=["file", "class", "field"])

    each = chunks.select("file", "qualname", "code").mapInPandas(find, "file string, class string, field string")
    return each.groupBy("file", "class").agg(F.array_sort(F.collect_set("field")).alias("fields"))


def python_graph(files: DataFrame, chunks: DataFrame, sources: list[str] | None = None, sanitizers: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, calls) of Python files: two passes of flow facts, aliases, binding, emission and merge."""
    fields = class_fields(chunks, sources, sanitizers)
    named = expand_aliases(calls(chunks, sources, sanitizers, fields), aliases(files))
    short = F.element_at(F.split("resolved", r"\."), -1)
    known = chunks.filter("kind IN ('function', 'method')").select("id", "file", "name", "kind")
    bare = named.filter(~F.contains("resolved", F.lit("."))).withColumn("call", F.col("resolved")).drop("name").withColumnRenamed("call", "name")
    owned = named.filter(F.contains("resolved", F.lit("."))).drop("name").withColumn("name", short)
    own = known.filter("kind = 'function'")
    mine = owned.filter(F.col("resolved").startswith("self."))
    other = owned.filter(~F.col("resolved").startswith("self."))
    bound = resolve_calls(bare, own).unionByName(resolve_calls(mine, known.filter("kind = 'method'"))).unionByName(resolve_calls(other, own))
    return merge_edges(emit_edges(bound.filter("dst IS NOT NULL"))), named
