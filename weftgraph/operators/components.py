"""Connected components of an undirected graph by alternating star contractions, and how they follow changes of the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.skew import joined_by_share
from weftgraph.session import dropped, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the least node of its component.

    Each round hangs a node's larger neighbours, then all its smaller ones, below the least (Kiveris et al. 2014): long
    chains shrink in O(log n) rounds, and no round makes more edges than it got. A star's centre is a hot key: its least
    neighbour is broadcast and its edges stay spread. A round's edges are written to the shared folder, so its plan doesn't
    grow and a lost executor costs only the running round. Edges with a null end are ignored; loops and repeated edges make no
    difference; no edges give no rows.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    loops = edges.where("a = b").select("a", "b")
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    loops = written(loops.distinct(), "loops")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = joined_by_share(both.where("b > a"), least, "a", "n", 2 * state[0])
        large = written(large.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "stars")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = joined_by_share(large, least, "a", "n", state[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, old, edges = state, edges, written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        dropped(old)
        dropped(large)
        state = _state(edges)
        if state == before:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    alone = loops.select(F.col("a").alias("node"), F.col("a").alias("component")).join(nodes.union(roots).select("node"), "node", "left_anti")
    return nodes.union(roots).union(alone)


def updated_components(labels: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(node, component) for edges after (a, b), from labels, which connected_components gave for edges before.

    A component that lost an edge is found anew, within its own nodes. New edges then join what is left: they are taken as edges
    between labels, so what is contracted is as large as the change. All other nodes keep their label. Which way round an edge is
    written makes no difference; edges with a null end are ignored.
    """
    ends = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    before, after = (written(x.where("a is not null and b is not null").select(*ends).distinct(), "ends") for x in (before, after))
    added, lost = after.join(before, ["a", "b"], "left_anti"), before.join(after, ["a", "b"], "left_anti")
    node = labels.select("node", "component")
    touched = lost.select(F.col("a").alias("node")).join(node, "node").select("component").distinct()
    broken = written(node.join(touched, "component", "left_semi"), "broken")
    inside = after.join(before, ["a", "b"], "left_semi").join(broken.select(F.col("node").alias("a")), "a", "left_semi")
    held = written(node.join(touched, "component", "left_anti").select("node", "component").unionByName(connected_components(inside)), "labels")
    ends = written(added.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "new-ends")
    named = written(ends.join(held, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "new-labels")
    of = lambda end: named.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    between = added.join(of("a"), "a").join(of("b"), "b").select("of_a", "of_b")
    moved = connected_components(between, "of_a", "of_b").select(F.col("node").alias("component"), F.col("component").alias("to"))
    whole = held.unionByName(named.join(held.select("node"), "node", "left_anti").select("node", "component"))
    sizes = written(whole.groupBy("component").agg(F.count("*").alias("n")).join(moved, "component", "left"), "sizes")
    found = joined_by_share(whole, sizes, "component", "n", whole.count())
    return found.select("node", F.coalesce("to", "component").alias("component"))
