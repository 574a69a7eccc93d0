import math

import numpy as np
import pytest

from evigraph.llm import ball_search
from evigraph.llm.ball_search import BallTree, top_k

SCHEMA = "vec_id long, embedding array<float>, v int, n int, shard string, rank int"


def brute(rows, k, every):
    """All rows scored one by one with Python integers."""
    kept = []
    for vec_id, x in rows:
        if x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        kept.append((vec_id, [math.floor(1024 * float(np.float32(c))) for c in x]))
    out = []
    for i, (q, x) in enumerate(kept):
        if q is None or q % every:
            continue
        scored = []
        for j, (c, y) in enumerate(kept):
            if i != j and len(x) == len(y):
                s = sum(a * b for a, b in zip(x, y))
                s = min(max(s, -2**63), 2**63 - 1)
                scored.append((-s, c is None, c))
        for rank, (s, _, c) in enumerate(sorted(scored, key=lambda t: (t[0], t[1], t[2] or 0))[:k]):
            out.append((q, rank + 1, c, -s))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([(r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()], key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 1, 1, "a", 1) for i, x in rows], SCHEMA)


def odd_rows():
    random = np.random.default_rng(3)
    rows = [(i, random.normal(size=6).tolist()) for i in range(60)]
    rows += [(i, [0.5] * 6) for i in range(100, 180)]          # a hot group of equal vectors
    rows += [(20, [0.5] * 6)] * 14 + [(105, [9.0] * 6)] * 13     # repeated rows
    rows += [(None, [0.5] * 6), (None, [0.1] * 6), (None, None), (200, None)]
    rows += [(205, [math.nan] * 6), (210, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (215, [math.inf] * 6)]
    rows += [(20, [math.nan] * 6), (-5, [-1.0] * 6), (-10, [-0.0001] * 6)]
    rows += [(300, []), (301, []), (305, [1.0]), (310, [2.0]), (311, [-3.0])]
    rows += [(400, [3e9, -3e9]), (401, [3e9, 3e9]), (405, [-3e9, 1e9]), (410, [3e38, 3e38])]
    return rows


@pytest.mark.parametrize("shard_rows", [7, 10_000])
def test_odd_rows(spark, shard_rows):
    rows = odd_rows()
    found = rows_of(top_k(frame(spark, rows), k=5, every=5, shard_rows=shard_rows))
    clipped = [(i, x) for i, x in rows if not x or 3e38 not in x]
    huge = {400, 401, 405, 410}
    assert [r for r in found if r[0] not in huge] == [
        r for r in brute(clipped, 5, 5) if r[0] not in huge]
    assert {r[:2] for r in found if r[0] in huge} == {
        (q, r) for q in (400, 405, 410) for r in (1, 2, 3)}
    assert all(-2**63 <= r[3] < 2**63 for r in found)


def test_many_shards(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    assert rows_of(top_k(table, k=10, every=20, shard_rows=40)) == brute(rows, 10, 20)


def test_slices(spark, sf, monkeypatch):
    """Many visits and balls are cut into pieces; the answers stay."""
    monkeypatch.setattr(ball_search, "QUERIES", 9)
    monkeypatch.setattr(ball_search, "BALLS", 3)
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    assert rows_of(top_k(table, k=3, every=10, shard_rows=60)) == brute(rows, 3, 10)


def test_empty(spark):
    assert top_k(frame(spark, [(1, [1.0])]).limit(0)).collect() == []
    assert top_k(frame(spark, [(0, None), (100, [1.0])])).collect() == []


def test_tree_bounds_and_pruning():
    """No node promises less than it holds, and close groups are not all opened."""
    random = np.random.default_rng(5)
    centers = random.normal(size=(20, 8)) * 4000
    points = np.floor(np.repeat(centers, 100, axis=0) + random.normal(size=(2000, 8)) * 20)
    points = points.astype(np.int64)
    tree = BallTree(points, np.arange(2000), leaf=16)
    queries = points[::100].astype(np.float64)
    bounds = ball_search.upper_bounds(queries, tree.centers, tree.radii, tree.lengths)
    for (a, b), bound in zip(tree.nodes, bounds.T):
        assert ((tree.real[a:b] @ queries.T).max(axis=0) <= bound).all()
    opened = []
    real = ball_search.scores_of
    try:
        ball_search.scores_of = lambda p, q, e: opened.append(len(p)) or real(p, q, e)
        found = list(tree.search(points[::100], 5, [None] * 20))
    finally:
        ball_search.scores_of = real
    assert sum(opened) < 0.2 * 20 * 2000
    for q, (scores, ids) in zip(points[::100], found):
        every = points @ q
        best = np.lexsort((np.arange(2000), -every))[:5]
        assert scores.tolist() == every[best].tolist() and ids.tolist() == best.tolist()
