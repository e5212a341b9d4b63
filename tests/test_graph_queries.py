"""Searches and views against small graphs and brute force."""

import random
from collections import deque

import pytest

from quarry.operators import graph as g

NODES = [
    ("a", "handler", "src/api.py", True, False),
    ("b", "run", "src/api.py", False, True),
    ("c", "render", "src/view.py", False, True),
    ("m", "<module>", "src/api.py", False, False),
]
EDGES = [
    ("a", "b", "calls", [], "", False),
    ("a", "b", "data_flow", ["cmd"], "", False),
    ("a", "c", "data_flow", ["x"], "", True),
    ("a", "c", "calls", [], "", False),
    ("m", "a", "calls", [], "", False),
]


@pytest.fixture(scope="module")
def tables(spark):
    return g.graph_tables(spark, NODES, EDGES)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_views(tables):
    nodes, edges = tables
    assert [x.count() for x in g.select_view(nodes, edges)] == [4, 5]
    assert ids(g.select_view(nodes, edges, focus="run", depth=1)[0]) == ["a", "b"]
    assert ids(g.select_view(nodes, edges, focus="src/api.py::run", depth=0)[0]) == ["b"]
    assert ids(g.select_view(nodes, edges, focus="nobody")[0]) == []
    assert "m" not in ids(g.select_view(nodes, edges, only_flows=True)[0])


def test_flow_paths_put_unsanitized_first(tables):
    rows = g.flow_paths(*tables).collect()
    assert rows[0]["path"] == ["a", "b"] and rows[0]["tainted"] and "cmd" in rows[0]["hops"][0]
    assert [r["path"] for r in rows if not r["tainted"]] == [["a", "c"]]


def test_hop_budget(spark):
    nodes, edges = g.graph_tables(
        spark,
        [("h", "handler", "f", True, False), ("x", "middle", "f", False, False), ("r", "run", "f", False, True), ("i", "inert", "f", False, False)],
        [("h", "x", "calls", [], "", False), ("x", "r", "calls", [], "", False)],
    )
    sinks = nodes.filter("is_sink")
    assert ids(g.reach(edges, sinks, 0)) == ["r"]
    assert ids(g.reach(edges, sinks, 1)) == ["r", "x"]
    assert ids(g.reach(edges, sinks, 5)) == ["h", "r", "x"]


def test_search_equals_brute_force_for_any_partitioning(spark):
    r = random.Random(4)
    n = 30
    pairs = {(str(r.randrange(n)), str(r.randrange(n))) for _ in range(60)}
    nodes = [(str(i), f"n{i}", "f", i < 3, i > 26) for i in range(n)]
    _, edges = g.graph_tables(spark, nodes, [(a, b, "calls", [], "", False) for a, b in pairs])
    sources = spark.createDataFrame([(str(i),) for i in range(3)], "id string")
    best = {str(i): (str(i),) for i in range(3)}
    queue = deque(sorted(best))
    level = list(best.values())
    while level:
        grown = {}
        for p in level:
            for a, b in pairs:
                if a == p[-1] and b not in best:
                    grown[b] = min(grown.get(b, p + (b,)), p + (b,))
        best.update(grown)
        level = list(grown.values())
    assert queue
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r["id"]: tuple(r["path"]) for r in g.shortest_paths(edges, sources, ("calls",), 30, alone=True).collect()}
        assert got == best
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_merge_unites_variables_and_needs_all_sanitized(spark):
    _, edges = g.graph_tables(
        spark, NODES, [("a", "b", "data_flow", ["a"], "if x", True), ("a", "b", "data_flow", ["b"], "if xy", False), ("a", "b", "data_flow", ["b"], "if x", True)]
    )
    one = g.merge_edges(edges).collect()
    assert len(one) == 1
    assert (one[0]["data_vars"], one[0]["sanitized"], one[0]["condition"]) == (["a", "b"], False, "if x | if xy")


def test_rendering_escapes():
    nodes = [{"id": "1", "name": 'a"b'}, {"id": "2", "name": "c|d"}]
    edges = [{"src": "1", "dst": "2", "type": "calls"}]
    assert 'label="a\\"b"' in g.render(nodes, edges, "dot")
    assert "c/d" in g.render(nodes, edges, "mermaid") and "'" in g.render(nodes, edges, "mermaid")
    with pytest.raises(ValueError):
        g.render(nodes, edges, "png")


def test_ambiguous_calls_bind_nothing(spark):
    symbols = spark.createDataFrame([(1, "a", "f"), (2, "b", "f"), (3, "b", "h")], "id long, file string, name string")
    calls = spark.createDataFrame([(9, "a", "f"), (9, "c", "f"), (9, "c", "h"), (9, "c", "z")], "src long, file string, name string")
    got = {(r["file"], r["name"]): r["dst"] for r in g.resolve_calls(calls, symbols).collect()}
    assert got == {("a", "f"): 1, ("c", "f"): None, ("c", "h"): 3, ("c", "z"): None}




def test_flow_paths_have_no_depth(spark):
    nodes = spark.createDataFrame([(i, i == 0, i == 15) for i in range(16)], "id long, is_entry_point boolean, is_sink boolean")
    edges = spark.createDataFrame(
        [(i, i + 1, "calls", [], "", False) for i in range(15)], "src long, dst long, type string, data_vars array<string>, condition string, sanitized boolean"
    )
    assert [r["path"] for r in g.flow_paths(nodes, edges).collect()] == [list(range(16))]


def test_headers_and_notes_of_a_built_graph(spark):
    from quarry.operators import code_graph as cg
    from quarry.plans import samples

    built = cg.build_graph(samples.sources(spark), samples.chunks(spark), samples.patterns(spark))
    notes = {r["id"]: r for r in cg.flow_notes(built["nodes"], built["edges"]).collect()}
    order = notes["app/shop.py::1"]
    assert order["incoming"] == ["note from describe (unsanitized)"]
    assert order["outgoing"] == ["item to describe (unsanitized)", "note to run (unsanitized)", "item to run_safe (sanitized)", "calls run only if if mode == 'admin'"]
    text = {r["id"]: r["header"] for r in cg.chunk_header(built["nodes"], built["sinks"], built["edges"]).collect()}
    assert text["app/shop.py::3"].split("\n") == ["FILE: app/shop.py FUNC: run LINES: 22-23", "ROLE: sink: unknown", "IN: note from order (unsanitized)"]
    assert text["app/shop.py::0"] == "FILE: app/shop.py FUNC: <module> LINES: 1-5"
    many = spark.createDataFrame([(f"n{i}", "f", "data_flow", ["a" * 100 + "\n", "b"], "", False) for i in range(9)], built["edges"].schema)
    nodes = spark.createDataFrame([(f"n{i}", f"name {i}\n x") for i in range(9)] + [("f", "f")], "id string, name string")
    held = cg.flow_notes(nodes, many).filter("id = 'f'").first()
    assert held["incoming"] == ["a" * 80 + f" from name {i} x (unsanitized)" for i in range(4)] and held["outgoing"] == []
