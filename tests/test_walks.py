"""Ways back along sequence edges, and walks, against their definitions."""

import random

import pytest

from weftgraph.operators import components, walks

EDGE = "src_part string, src_id long, dst_part string, dst_id long, weight double, co_firings long, edge_type string, role string"


def plain_heads(edges):
    """Head and steps of each node with a sequence edge, back over the heaviest; a cycle is cut at its least node."""
    before, nodes = {}, set()
    for u, v, w, _, kind in edges:
        if kind == "Sequential":
            nodes |= {u, v}
            if u != v and w > 0 and (v not in before or (-w, u) < before[v]):
                before[v] = (-w, u)
    before = {v: u for v, (_, u) in before.items()}
    out = {}
    for n in nodes:
        way = [n]
        while way[-1] in before and before[way[-1]] not in way:
            way.append(before[way[-1]])
        if way[-1] in before:
            way = way[: way.index(min(way[way.index(before[way[-1]]) :])) + 1]
        out[n] = (way[-1], len(way) - 1)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_sequence_heads(spark, seed):
    """Chains, trees, cycles with tails, loops, edges without weight and of another kind."""
    r = random.Random(seed)
    edges = {(k, k + 1): (0.5, 0, "Sequential") for k in range(40)} | {(100 + k, 100 + (k + 1) % 7): (0.9, 0, "Sequential") for k in range(7)}
    edges |= {(103, 200): (0.9, 0, "Sequential"), (200, 201): (0.9, 0, "Sequential"), (300, 300): (0.9, 0, "Sequential"), (5, 301): (0.0, 0, "Sequential")}
    for _ in range(60):
        edges[r.randrange(60), r.randrange(60)] = (r.choice([0.0, 0.3, 0.6, 0.9]), 0, r.choice(["Sequential", "Semantic"]))
    rows = [(u, v, *x) for (u, v), x in edges.items()]
    frame = spark.createDataFrame([("a", u, "a", v, w, c, kind, None) for u, v, w, c, kind in rows], EDGE)
    got = {x.node_id: (x.head_id, x.steps) for x in walks.sequence_heads(frame).collect()}
    assert got == plain_heads(rows)
    assert walks.sequence_heads(frame.limit(0)).count() == 0


def test_a_chain_of_5000_takes_few_rounds(spark, monkeypatch):
    size, made = 5_000, []
    doubled = walks._doubled
    monkeypatch.setattr(walks, "_doubled", lambda jumps: made.append(1) or doubled(jumps))
    edges = spark.createDataFrame([("a", k, "a", k + 1, 0.85, 0, "Sequential", None) for k in range(size)], EDGE)
    nodes = spark.createDataFrame([("a", k, f"node {k}") for k in range(size + 1)], "part string, node_id long, content string")
    active = spark.createDataFrame([(1, "a", size, 1.0), (2, "a", 3, 1.0)], "query_id long, part string, node_id long, act double")
    found = walks.walks(active, edges, nodes).collect()
    assert len(made) <= 15
    assert sorted((r.query_id, r.step, r.node_id) for r in found if r.path == 0) == [(q, k, k) for q in (1, 2) for k in range(8)]


def plain_labels(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_follow_changes(spark, seed):
    """Chains, joins and splits, nodes that come and go, a component that is untouched; nothing before, nothing after."""
    r = random.Random(seed)
    before = {(k, k + 1) for k in range(0, 40) if k % 10 != 9} | {(r.randrange(60), r.randrange(60)) for _ in range(15)} | {(100, 101), (101, 102)}
    after = {e for e in before if r.random() > 0.15 or e[0] >= 100} | {(r.randrange(80), r.randrange(80)) for _ in range(8)} | {(7, 7)}
    frame = lambda edges: spark.createDataFrame(sorted((b, a) if r.random() < 0.5 else (a, b) for a, b in edges), "a long, b long")
    for old, new in ((before, after),) if seed == 1 else ((set(), before), (before, set())):
        labels = components.connected_components(frame(old))
        assert dict(components.updated_components(labels, frame(old), frame(new)).collect()) == plain_labels(new)
