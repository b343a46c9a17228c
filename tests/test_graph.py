"""Graph operators on literal graphs and against a small model."""

from __future__ import annotations

import random

import pytest

from inkmesh.operators import graph


def frames(spark, edges, more=()):
    nodes = sorted({x for e in edges for x in e} | set(more))
    return spark.createDataFrame([(n,) for n in nodes], "path string"), spark.createDataFrame(list(edges), "src string, dst string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def model(edges, anchors, depth, direction):
    """Queue-based search."""
    nodes = {x for e in edges for x in e}
    queue, seen = [], {}
    for a in dict.fromkeys(anchors):
        if a in nodes:
            seen[a] = (0, "anchor")
            queue.append(a)
    for a in queue:
        hop = seen[a][0]
        if hop == depth:
            continue
        near = [(d, "outgoing") for s, d in edges if s == a and direction != "incoming"]
        near += [(s, "backlink") for s, d in edges if d == a and direction != "outgoing"]
        for n, how in sorted(near):
            if n not in seen:
                seen[n] = (hop + 1, how)
                queue.append(n)
    return sorted((h, p, r) for p, (h, r) in seen.items())


def test_neighbors_against_model(spark):
    rng = random.Random(1)
    for _ in range(6):
        names = [f"n{i}" for i in range(12)]
        edges = sorted({(a, b) for a, b in ((rng.choice(names), rng.choice(names)) for _ in range(16)) if a != b})
        v, e = frames(spark, edges)
        direction = rng.choice(graph.DIRECTIONS)
        anchors = rng.sample(names, 2) + ["missing"]
        got = [(r["hop"], r["path"], r["relation"]) for r in graph.neighbors(v, e, anchors, 3, direction).collect()]
        assert got == model(edges, anchors, 3, direction)


def test_neighbors_arguments(spark):
    v, e = frames(spark, [("a", "b"), ("c", "a")])
    assert rows(graph.neighbors(v, e, ["a"], 0)) == [("a", 0, "anchor")]
    assert rows(graph.neighbors(v, e, ["a"], 1, limit=2)) == [("a", 0, "anchor"), ("b", 1, "outgoing")]
    with pytest.raises(ValueError):
        graph.neighbors(v, e, ["a"], -1)
    with pytest.raises(ValueError):
        graph.neighbors(v, e, ["a"], 1, "sideways")


def test_expand_keeps_fields(spark):
    v, e = frames(spark, [("a", "b"), ("b", "c")])
    hits = spark.createDataFrame([("a", 0.9, "search", "x"), ("gone", 0.8, "search", "y"), ("c", 0.1, "search", "z")], "path string, score double, source string, note string")
    got = [(r["path"], r["hop"], r["source"], r["anchor_score"], r["note"]) for r in graph.expand(v, e, hits, 1).collect()]
    assert got == [("a", 0, "search", 0.9, "x"), ("c", 0, "search", 0.1, "z"), ("b", 1, "graph", None, None)]


def test_similar_and_pairs(spark):
    edges = [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", "x")]
    v, e = frames(spark, edges, ["lone"])
    got = {r["path"]: r["score"] for r in graph.similar(v, e, "a").collect()}
    assert got == {"b": 1.0, "c": 0.5, "lone": 0.0, "x": 0.0, "y": 0.0}
    assert rows(graph.similar(v, e, "nobody")) == []
    pairs = [(r["left"], r["right"], r["score"]) for r in graph.structural_pairs(e, 0.5).collect()]
    assert pairs == [("a", "b", 1.0), ("x", "y", 0.666667), ("a", "c", 0.5), ("b", "c", 0.5)]
    with pytest.raises(ValueError):
        graph.structural_pairs(e, 1.5)


@pytest.mark.parametrize(("threshold", "limit"), [(0.0, None), (0.25, None), (0.25, 3), (0.6, 40), (1.0, 5)])
def test_structural_pairs_against_model(spark, threshold, limit):
    rng = random.Random(6)
    edges = {(f"n{i}", rng.choice(["hub", "hub2", f"n{rng.randint(0, 39)}"])) for i in range(40) for _ in range(rng.randint(1, 4))}
    edges = sorted((a, b) for a, b in edges if a != b)
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = []
    for a in near:
        for b in near:
            i = len(near[a] & near[b])
            if a < b and i and i / len(near[a] | near[b]) >= threshold:
                want.append((-i / len(near[a] | near[b]), a, b))
    want = [(a, b) for _, a, b in sorted((round(s, 6), a, b) for s, a, b in want)][:limit]
    _, e = frames(spark, edges)
    assert [(r["left"], r["right"]) for r in graph.structural_pairs(e, threshold, limit).collect()] == want


def test_structural_links_are_all_pairs(spark):
    edges = [(f"f{i:02d}", "hub") for i in range(20)] + [(f"g{i}", h) for i in range(3) for h in ("hub", "other")]
    _, e = frames(spark, edges)
    found = graph.structural_links(e, 0.25).collect()
    peers, across = {}, []
    for r in found:
        peers.setdefault(r["left"], {r["left"]})
        if r["same_class"]:
            peers[r["left"]].add(r["right"])
        else:
            across.append((r["left"], r["right"]))
    got = {tuple(sorted((p, q))) for a, b in across for p in peers.get(a, {a}) for q in peers.get(b, {b})}
    got |= {(p, q) for own in peers.values() for p in own for q in own if p < q}
    want = {(r["left"], r["right"]) for r in graph.structural_pairs(e, 0.25, None).collect()}
    assert len(want) > 100 and got == want and len(found) < 50


def test_degrees_and_ties(spark):
    v, e = frames(spark, [("a", "b"), ("c", "b"), ("d", "c")], ["z"])
    assert [r["path"] for r in graph.hubs(v, e, 3).collect()] == ["b", "c", "a"]
    assert rows(graph.islands(v, e)) == [("z", 0)]
    assert rows(graph.link_stats(v, e)) == [(5, 3, 3)]


def test_communities(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(5) for j in range(5) if i < j]
    edges = [*clique("a"), *clique("b"), *clique("c"), ("a0", "b0")]
    v, e = frames(spark, edges, ["lone"])
    groups = {r["path"]: r["community"] for r in graph.communities(v, e).collect()}
    assert all(len({groups[f"{p}{i}"] for i in range(5)}) == 1 for p in "abc")
    assert groups["c3"] == "c0" and groups["lone"] == "lone"
    for n in groups:  # where it stops, everyone holds a most frequent label around
        near = [groups[b if a == n else a] for a, b in edges if n in (a, b)]
        assert not near or near.count(groups[n]) == max(map(near.count, near))
    report = graph.community_report(graph.communities(v, e)).collect()
    assert sum(r["size"] for r in report) == len(groups) and all(len(r["members"]) == min(5, r["size"]) for r in report)


def test_communities_settle(spark):
    rng = random.Random(4)
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(80)] + sorted({(f"r{rng.randint(0, 60)}", f"q{rng.randint(0, 60)}") for _ in range(120)})
    v, e = frames(spark, edges)
    groups = {r["path"]: r["community"] for r in graph.communities(v, e).collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(groups[b])
        near.setdefault(b, []).append(groups[a])
    assert all(own.count(groups[n]) == max(map(own.count, own)) for n, own in near.items())


def test_empty_graph(spark):
    v, e = frames(spark, [])
    assert graph.hubs(v, e).count() == graph.structural_pairs(e).count() == graph.communities(v, e).count() == 0


def test_hub_of_a_third_of_all_notes(spark, monkeypatch):
    """A hub in a third of all neighbourhoods, its classes met by blocks: the pairs equal those of a model."""
    from itertools import combinations

    from inkmesh.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", 5)
    rows = [(f"n{i}", "hub") for i in range(30)] + [(f"n{i}", f"t{i % 7}") for i in range(60)] + [(f"n{i}", f"u{i % 4}") for i in range(0, 90, 2)]
    e = spark.createDataFrame(rows, "src string, dst string")
    near: dict = {}
    for a, b in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {(a, b) for a, b in combinations(sorted(near), 2) if len(near[a] & near[b]) / len(near[a] | near[b]) >= 0.25}
    got = graph.structural_pairs(e, 0.25, None).select("left", "right").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    first = [tuple(r) for r in graph.structural_pairs(e, 0.25, 40).select("left", "right").collect()]
    assert first == [tuple(r) for r in graph.structural_pairs(e, 0.25, None).select("left", "right").limit(40).collect()]


def test_context_of_several_anchors_and_repeated_results(spark):
    v = spark.createDataFrame([(x,) for x in "abcdef"], "path string")
    e = spark.createDataFrame([("a", "b"), ("c", "d"), ("e", "f")], "src string, dst string")
    assert [tuple(r) for r in graph.context(v, e, ["a", "c"]).collect()] == [("a", 0, "anchor"), ("c", 0, "anchor"), ("b", 1, "outgoing"), ("d", 1, "outgoing")]
    assert graph.context(v, e, "a").count() == 2
    hits = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 2.0)], "path string, score double").coalesce(1)
    assert graph.expand(v, e, hits).where("path = 'a'").select("anchor_score").first()[0] == 2.0
