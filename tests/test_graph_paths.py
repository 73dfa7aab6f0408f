"""Paths with edges and ends of edges against plain searches."""

import itertools
import random

from docweave.operators import graph


def plain_path(edges, source, target, depth):
    """All walks without a repeated node, shortest first, then by edge ids."""
    ways = {}
    for i, a, b in edges:
        if a != b:
            ways.setdefault(a, []).append((i, b))
            ways.setdefault(b, []).append((i, a))
    level = [((), (source,))]
    for _ in range(depth + 1):
        hits = [w for w in level if w[1][-1] == target]
        if hits:
            e, n = min(hits)
            return list(n), list(e)
        level = [(e + (i,), n + (b,)) for e, n in level for i, b in ways.get(n[-1], ()) if b not in n]
    return None


def frame(spark, edges):
    return spark.createDataFrame([(i, a, b, "T") for i, a, b in edges], "id string, src string, dst string, type string")


def test_paths_against_plain_search(spark):
    rnd = random.Random(6)
    edges = [(f"e{k:02}", f"n{rnd.randrange(9)}", f"n{rnd.randrange(9)}") for k in range(13)]
    df = frame(spark, edges).cache()
    for a, b in [("n0", "n5"), ("n3", "n8"), ("n2", "n7"), ("n1", "n1")]:
        got, want = graph.path_of_edges(df, a, b, 6).collect(), plain_path(edges, a, b, 6)
        assert [(r.nodes, r.edges) for r in got] == ([want] if want else [])
        assert all(r.length == len(r.edges) for r in got)


def test_long_path_and_depth(spark):
    line = [(f"e{k:02}", f"n{k:02}", f"n{k + 1:02}") for k in range(12)]
    df = frame(spark, line)
    r = graph.path_of_edges(df, "n00", "n07").first()
    assert r.edges == [f"e{k:02}" for k in range(7)] and r.nodes == [f"n{k:02}" for k in range(8)]
    assert graph.path_of_edges(df, "n00", "n07", depth=6).count() == 0
    assert graph.path_of_edges(df, "n00", "far").count() == 0


def test_walked_edges(spark):
    edges = [("1", "a", "b"), ("2", "b", "c"), ("3", "c", "d"), ("4", "a", "c"), ("5", "c", "c"), ("6", "x", "y")]
    df = frame(spark, edges)
    both = df.selectExpr("src", "dst", "type", "1.0D as confidence")
    got = graph.walked(df, graph.within_depth(both, spark.createDataFrame([("a",)], "node string"), 1))
    assert {(r.id, r.depth) for r in got.collect()} == {("1", 1), ("2", 1), ("4", 1)}


def test_ends_by_id_or_name(spark):
    nodes = [("p1", "Pump", "d1"), ("p0", "Pump", "d1"), ("p2", "Pump", "d2"), ("v", "Valve", None), ("n", None, "d1")]
    cases = list(itertools.product(["p1", "p9", None], ["Pump", "Valve", None], ["d1", "d2", None]))
    edges = [(f"e{k}", src, "v", name, None, doc) for k, (src, name, doc) in enumerate(cases)]
    got = {r.id: r for r in graph.resolved_edges(spark.createDataFrame(edges, "id string, src string, dst string, src_name string, dst_name string, document string"), spark.createDataFrame(nodes, "id string, name string, document string")).collect()}
    assert len(got) == len(edges)
    for k, (src, name, doc) in enumerate(cases):
        named = min((i for i, n, d in nodes if n == name and d == doc and n and d), default=None)
        want = (src if src in {n[0] for n in nodes} else None) if src else named
        assert got[f"e{k}"].src_node == want and got[f"e{k}"].dst_node == "v"
