"""Two-sided search and levelled visited sets against plain breadth-first search."""

from collections import deque

import numpy as np

from evigraph.operators import traversal as tr
from evigraph.session import cut_lineage

EDGES = "source string, target string, ord long"


def graph(random, nodes, edges):
    return [(f"n{a}", f"n{b}", int(o)) for o, (a, b) in zip(
        random.permutation(edges), random.integers(0, nodes, (edges, 2)))]


def queue_path(edges, known, start, goal):
    """Breadth-first with edges in order: the first path the queue completes."""
    out = {}
    for s, t, o in sorted(edges, key=lambda e: e[2]):
        out.setdefault(s, []).append(t)
    if start not in known or goal not in known:
        return None
    came, todo = {start: None}, deque([start])
    while todo:
        at = todo.popleft()
        if at == goal:
            path = [at]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            return path[::-1]
        for t in out.get(at, []) if at in known else []:
            if t not in came:
                came[t] = at
                todo.append(t)
    return None


def depths(edges, start):
    found, todo = {start: 0}, deque([start])
    while todo:
        at = todo.popleft()
        for s, t, _ in edges:
            if s == at and t not in found:
                found[t] = found[at] + 1
                todo.append(t)
    return found


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def path_of(spark, edges, known, start, goal, depth=None):
    found = tr.shortest_path(spark.createDataFrame(edges, EDGES), ids(spark, known),
                             ids(spark, [start]), ids(spark, [goal]), depth)
    rows = sorted((r.step, r.id) for r in found.collect())
    assert [s for s, _ in rows] == list(range(len(rows)))
    return [n for _, n in rows] or None


def test_paths_with_ties(spark):
    random = np.random.default_rng(1)
    edges = graph(random, 40, 110)
    known = [f"n{i}" for i in range(40) if i % 9]
    for start, goal in random.integers(0, 40, (4, 2)):
        want = queue_path(edges, known, f"n{start}", f"n{goal}")
        assert path_of(spark, edges, known, f"n{start}", f"n{goal}") == want


def test_limits(spark):
    edges = [("a", "b", 1), ("b", "c", 2), ("c", "d", 3), ("x", "y", 4)]
    known = list("abcdxy")
    assert path_of(spark, edges, known, "a", "a") == ["a"]
    assert path_of(spark, edges, known, "a", "d", 3) == list("abcd")
    assert path_of(spark, edges, known, "a", "d", 2) is None
    assert path_of(spark, edges, known, "a", "y") is None
    assert path_of(spark, edges, known, "a", "nobody") is None


def test_hub_is_read_from_one_side(spark, monkeypatch):
    """A goal behind a chain is found without the crowd around the start."""
    edges = [("hub", f"c{i}", i) for i in range(500)] + [(f"c{i}", f"d{i}", 1000 + i)
                                                         for i in range(500)]
    edges += [("c7", "e0", 5000), ("e0", "e1", 5001), ("e1", "goal", 5002)]
    known = sorted({n for s, t, _ in edges for n in (s, t)})
    sizes = []
    real = tr._Side.grow
    monkeypatch.setattr(tr._Side, "grow", lambda self, *a: (real(self, *a), sizes.append(self.size))[0])
    assert path_of(spark, edges, known, "hub", "goal") == ["hub", "c7", "e0", "e1", "goal"]
    assert sum(sizes) < 10


def test_long_chain(spark):
    """A hundred levels; the visited tables stay few."""
    n = 100
    edges = [(str(i), str(i + 1), i) for i in range(n)]
    assert path_of(spark, edges, [str(i) for i in range(n + 1)], "0", str(n)) == [
        str(i) for i in range(n + 1)]


def test_levels_and_visited(spark):
    edges = graph(np.random.default_rng(4), 60, 90)
    table = spark.createDataFrame(edges, EDGES)
    found = tr.levels(table, ids(spark, ["n3"])).collect()
    assert {r.id: r.depth for r in found} == depths(edges, "n3")
    seen = tr.Visited(cut_lineage(ids(spark, ["a"])), 1)
    for i in range(1, 16):
        seen.add(ids(spark, [f"x{i}"]), 1)
    assert len(seen.parts) == 1 and seen.all().count() == 16
    assert [r.id for r in seen.unmet(ids(spark, ["x3", "new"])).collect()] == ["new"]
