"""Exact top-k by inner product: ball trees per shard, searched by branch and bound."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.common import groups_of, mapped, ship, stored

#: Vectors of one tree; a cell of more is several shards.
SHARD_ROWS = 8192
LEAF = 96
#: Cells at most, and the bytes of the bounded sample from which their pivots are learnt.
#: Both steer which vectors share a tree, never which are found.
CELLS = 256
SAMPLE_BYTES = 4 << 20
#: Queries of one visit to a shard, and balls of one visit of queries.
QUERIES = 8192
BALLS = 512
#: Integers below this are exact as doubles.
EXACT = float(1 << 53)
LARGEST = (1 << 63) - 1


def quantised(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v = floor(scale * x) per component of every row that takes part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (
        F.abs(x.cast("double")) == F.lit(math.inf)))
    return embeddings.where(F.col("embedding").isNotNull() & ~bad).select(
        F.col("vec_id").cast("long"), F.transform(
            "embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def by_length(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vectors of a list column as matrices, one per length: their places, their rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    starts = np.asarray(column.offsets)[:len(column) + 1].astype(np.int64)
    values = np.asarray(column.values)
    lengths = np.diff(starts)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield rows, values[starts[rows][:, None] + np.arange(length)]


def scores_of(points: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as 64-bit integers; sums beyond 64 bits saturate."""
    if exact:
        return (points @ query).astype(np.int64)
    sums = points.astype(object) @ query.astype(object)
    return np.array([min(max(int(s), -LARGEST - 1), LARGEST) for s in sums], np.int64)


class BallTree:
    """Integer vectors in nested balls, cut in two halves along their widest direction."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        real = points.astype(np.float64)
        nodes: list[tuple[int, int]] = []
        centers, radii, children, least = [], [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            a, b, parent = todo.pop()
            part = order[a:b]
            inside = real[part]
            center = inside.mean(axis=0)
            far = ((inside - center) ** 2).sum(axis=1)
            if parent >= 0:
                children[parent].append(len(nodes))
            nodes.append((a, b))
            centers.append(center)
            radii.append(math.sqrt(far.max()))
            least.append(int(ids[part].min()))
            children.append([])
            if b - a <= leaf:
                continue
            if radii[-1] == 0:
                split = np.argsort(ids[part], kind="stable")
            else:
                one = inside[far.argmax()]
                two = inside[((inside - one) ** 2).sum(axis=1).argmax()]
                split = np.argpartition(inside @ (two - one), (b - a) // 2)
            order[a:b] = part[split]
            middle = (a + b) // 2
            todo += [(middle, b, len(nodes) - 1), (a, middle, len(nodes) - 1)]
        self.nodes, self.children, self.least = nodes, children, least
        self.centers, self.radii = np.array(centers), np.array(radii)
        self.lengths = np.sqrt((self.centers ** 2).sum(axis=1))
        self.points, self.ids = points[order], ids[order]
        self.real = real[order]
        self.longest = float(np.sqrt((real ** 2).sum(axis=1)).max(initial=0))

    def search(self, queries: np.ndarray, k: int, floors: list[int | None],
               chunk: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per query the scores and ids of its ``k`` best, best first, ties by least id;
        those below its floor, a score that ``k`` vectors elsewhere reach, are left out.

        Nodes are opened in the order of their upper bound; the first whose bound falls
        short of the kth score ends the search."""
        for start in range(0, len(queries), chunk):
            part = queries[start:start + chunk]
            real = part.astype(np.float64)
            bounds = upper_bounds(real, self.centers, self.radii, self.lengths)
            longest = np.sqrt((real ** 2).sum(axis=1)) * self.longest
            for i in range(len(part)):
                exact = longest[i] < EXACT / 4
                yield self._best(real[i] if exact else part[i], bounds[i].tolist(), k,
                                 floors[start + i], exact)

    def _best(self, query: np.ndarray, bounds: list[float], k: int, floor: int | None,
              exact: bool) -> tuple[np.ndarray, np.ndarray]:
        points = self.real if exact else self.points
        found, names = np.zeros(0, np.int64), np.zeros(0, np.int64)
        kth, last = -math.inf if floor is None else floor, LARGEST
        heap = [(-bounds[0], self.least[0], 0)]
        while heap:
            bound, least, node = heapq.heappop(heap)
            if -bound < kth or (-bound == kth and least > last):
                break
            if self.children[node]:
                for child in self.children[node]:
                    if bounds[child] >= kth:
                        heapq.heappush(heap, (-bounds[child], self.least[child], child))
                continue
            a, b = self.nodes[node]
            scores = scores_of(points[a:b], query, exact)
            good = scores >= kth
            if not good.any():
                continue
            found = np.concatenate((found, scores[good]))
            names = np.concatenate((names, self.ids[a:b][good]))
            first = np.lexsort((names, -found))[:k] if exact else (
                np.array(sorted(range(len(found)), key=lambda j: (-int(found[j]), names[j]))[:k]))
            found, names = found[first], names[first]
            if len(found) == k:
                kth, last = int(found[-1]), int(names[-1])
        return found, names


def upper_bounds(queries: np.ndarray, centers: np.ndarray, radii: np.ndarray,
                 lengths: np.ndarray) -> np.ndarray:
    """No vector of a ball has a greater integer product with a query: the product with the
    center plus length times radius, rounded down after a margin for rounding errors."""
    size = np.sqrt((queries ** 2).sum(axis=1))[:, None]
    reach = size * radii
    return np.floor(queries @ centers.T + reach + 1e-9 * (size * lengths + reach) + 1e-6)


def _pivots(rows: DataFrame, cells: int) -> dict[int, np.ndarray]:
    """Cell centers per vector length, by a few rounds of k-means over a bounded sample."""
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    take = max(cells, min(4096, SAMPLE_BYTES // (8 * max(longest, 1))))
    sample = [r.v for r in rows.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v")
              .limit(take).collect()]
    found = {}
    for length in {len(v) for v in sample}:
        points = np.array([v for v in sample if len(v) == length], np.float64)
        centers = points[:cells].copy()
        for _ in range(5):
            own = _nearest(points, centers)
            for c in range(len(centers)):
                if (own == c).any():
                    centers[c] = points[own == c].mean(axis=0)
        found[length] = centers
    return found


def _nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers ** 2).sum(axis=1) - 2 * (points @ centers.T)).argmin(axis=1)


def sharded(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``rows`` with their shard: vector length, nearest pivot and, in a cell of more than
    ``shard_rows``, one of as many parts as its number asks for. A group of equal or close
    vectors spreads over parts like any other cell."""
    count = rows.count()
    if not count:
        return rows.withColumn("shard", F.lit(""))
    pivots = _pivots(rows, min(CELLS, math.ceil(count / shard_rows)))

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            size = np.zeros(batch.num_rows, np.int32)
            for places, points in by_length(batch.column(1)):
                size[places] = points.shape[1]
                if points.shape[1] in pivots:
                    cell[places] = _nearest(points.astype(np.float64), pivots[points.shape[1]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(cell)],
                                             ["vec_id", "v", "n", "size", "cell"])

    cells = stored(mapped(rows.select("vec_id", "v", "n"), celled,
                          "vec_id long, v array<long>, n long, size int, cell int"))
    parts = cells.groupBy("size", "cell").agg(F.ceil(F.count("*") / shard_rows).alias("parts"))
    return cells.join(parts, ["size", "cell"]).select("vec_id", "v", "n", F.concat_ws(
        "-", "size", "cell", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))).alias("shard"))


def _entries(vec_ids: pa.ChunkedArray, copies: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and ids of the vectors, equal rows up to k + 1 times; null ids sort last."""
    ids = np.asarray(vec_ids.fill_null(LARGEST)).astype(np.int64)
    places = np.repeat(np.arange(len(ids)), np.minimum(copies, k + 1))
    return places, ids[places]


RESULT = "query_id long, v array<long>, n long, home string, scores array<long>, ids array<long>"
_LISTS = [pa.list_(pa.int64())] * 2


def top_k(embeddings: DataFrame, k: int = 10, every: int = 100, scale: int = 1024,
          shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``k`` vectors of the greatest integer inner product with each query.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows of
    the same length but the query's own. First each shard builds its ball tree and answers
    the queries it holds; their kth scores are the floors that all other shards share: a
    shard whose ball cannot reach a query's floor is not visited, and in a visited one the
    search starts with it. Shards and queries meet in bounded pieces, joined on their keys.

    Null vectors, and those with a null, NaN or infinite component, take no part. Components
    and scores saturate at 64 bits. Rows with a null vec_id are candidates only; their
    vec_id is null and comes last among ties. Repeated rows are candidates each, and a
    repeated query is answered as often as it occurs. Empty vectors meet only each other
    (score 0). An empty table gives no rows; other columns are not read.
    """
    spark = embeddings.sparkSession
    every_row = quantised(embeddings, scale)
    rows = stored(sharded(stored(every_row.groupBy("vec_id", "v").agg(F.count("*").alias("n"))),
                          shard_rows))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, part in groups_of(batches):
            yield _home(shard, part, k, every)

    first = stored(mapped(
        rows.select("shard", "vec_id", "v", "n").repartition("shard").sortWithinPartitions("shard"),
        home, RESULT + ", center array<double>, radius double"))
    answers = first.where("center is null").drop("center", "radius")
    balls = first.where("center is not null").select(
        F.col("home").alias("shard"), "center", "radius")
    visits = stored(_visits(answers, balls, k))
    slices = visits.groupBy("shard").agg(F.ceil(F.count("*") / QUERIES).alias("slices"))
    many = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice")
    trees = rows.join(slices, "shard").select("shard", many, "vec_id", "v", "n")
    asked = visits.join(slices, "shard").withColumn(
        "slice", F.pmod(F.xxhash64("query_id", "v"), "slices")).drop("slices")

    def search(shard: pa.Table, queries: pa.Table) -> pa.Table:
        return _visit(shard, queries, k)

    ship(spark)
    others = trees.groupBy("shard", "slice").cogroup(
        asked.groupBy("shard", "slice")).applyInArrow(search, RESULT)
    pairs = answers.unionByName(others).select("query_id", "v", "n", F.explode(
        F.arrays_zip("scores", "ids")).alias("e")).select(
        "query_id", "v", "n", F.col("e.scores").alias("score"), F.nullif(
            F.col("e.ids"), F.lit(LARGEST)).alias("vec_id"))
    order = Window.partitionBy("query_id", "v").orderBy(
        F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    best = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    once = best.where("n = 1").select("query_id", "rank", "vec_id", "score")
    # Equal query rows: the answers meet the rows themselves, so no task repeats a hot one.
    asking = every_row.where(F.col("vec_id") % every == 0).toDF("query_id", "v")
    again = asking.join(best.where("n > 1"), ["query_id", "v"])
    return once.unionByName(again.select("query_id", "rank", "vec_id", "score"))


def _home(shard: str, part: pa.Table, k: int, every: int) -> pa.RecordBatch:
    """The shard's ball, and the answers of its tree to its own queries."""
    (_, points), = by_length(part.column("v"))
    copies = np.asarray(part.column("n"))
    places, ids = _entries(part.column("vec_id"), copies, k)
    tree = BallTree(points[places], ids)
    own = np.asarray(part.column("vec_id").fill_null(1)) % every == 0 if every > 1 else (
        np.asarray(part.column("vec_id").is_valid()))
    asked = np.flatnonzero(own)
    names = np.asarray(part.column("vec_id").fill_null(LARGEST))
    answers = []
    found = tree.search(points[asked], k + 1, [None] * len(asked))
    for at, (scores, hits) in zip(asked, found):
        # One entry with the query's id and score is its own row: all such are alike.
        itself = np.flatnonzero(hits == names[at])
        mine = scores_of(points[at:at + 1], points[at], False)[0]
        itself = itself[scores[itself] == mine][:1]
        answers.append((np.delete(scores, itself)[:k], np.delete(hits, itself)[:k]))
    m = len(asked)
    vectors = [points[i].tolist() for i in asked]
    return pa.RecordBatch.from_arrays([
        pa.array([int(names[i]) for i in asked] + [None], pa.int64()),
        pa.array(vectors + [None], _LISTS[0]),
        pa.array([int(copies[i]) for i in asked] + [None], pa.int64()),
        pa.array([shard] * (m + 1)),
        pa.array([s.tolist() for s, _ in answers] + [None], _LISTS[0]),
        pa.array([h.tolist() for _, h in answers] + [None], _LISTS[0]),
        pa.array([None] * m + [tree.centers[0].tolist()], pa.list_(pa.float64())),
        pa.array([None] * m + [float(tree.radii[0])], pa.float64()),
    ], ["query_id", "v", "n", "home", "scores", "ids", "center", "radius"])


VISIT = "query_id long, v array<long>, n long, floor long, shard string"


def _visits(answers: DataFrame, balls: DataFrame, k: int) -> DataFrame:
    """Queries with the shards, other than their own, whose ball reaches their floor."""
    floor = F.when(F.size("scores") >= k, F.element_at("scores", -1)).alias("floor")
    asked = answers.select("query_id", "v", "n", "home", floor)
    groups = max(1, math.ceil(balls.count() / BALLS))
    slices = max(1, math.ceil(asked.count() / QUERIES))
    left = asked.withColumn("slice", F.pmod(F.xxhash64("query_id", "v"), F.lit(slices))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = balls.withColumn("block", F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int")
                             ).withColumn("slice", F.explode(F.sequence(
                                 F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))

    def reach(queries: pa.Table, near: pa.Table) -> pa.Table:
        return _reached(queries, near)

    ship(answers.sparkSession)
    return left.groupBy("block", "slice").cogroup(
        right.groupBy("block", "slice")).applyInArrow(reach, VISIT)


def _reached(queries: pa.Table, balls: pa.Table) -> pa.Table:
    take, shards = [np.zeros(0, np.int64)], []
    if queries.num_rows and balls.num_rows:
        homes = np.asarray(queries.column("home").to_pylist(), object)
        names = np.asarray(balls.column("shard").to_pylist(), object)
        floors = np.array([-math.inf if f is None else f
                           for f in queries.column("floor").to_pylist()])
        radii = np.asarray(balls.column("radius"))
        sizes = {}
        for places, centers in by_length(balls.column("center")):
            sizes[centers.shape[1]] = places, centers
        for rows, vectors in by_length(queries.column("v")):
            if vectors.shape[1] not in sizes:
                continue
            places, centers = sizes[vectors.shape[1]]
            bound = upper_bounds(vectors.astype(np.float64), centers, radii[places],
                                 np.sqrt((centers ** 2).sum(axis=1)))
            open_ = (bound >= floors[rows][:, None]) & (homes[rows][:, None] != names[places])
            q, s = np.nonzero(open_)
            take.append(rows[q])
            shards += names[places][s].tolist()
    picked = queries.select(["query_id", "v", "n", "floor"]).take(pa.array(np.concatenate(take)))
    return picked.append_column("shard", pa.array(shards, pa.string()))


def _visit(shard: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """What a shard's tree adds to the answers of its visitors."""
    scores: list[list[int]] = []
    ids: list[list[int]] = []
    if shard.num_rows and queries.num_rows:
        (_, points), = by_length(shard.column("v"))
        places, names = _entries(shard.column("vec_id"), np.asarray(shard.column("n")), k)
        tree = BallTree(points[places], names)
        (_, asked), = by_length(queries.column("v"))
        for s, h in tree.search(asked, k, queries.column("floor").to_pylist()):
            scores.append(s.tolist())
            ids.append(h.tolist())
    queries = queries.slice(0, len(scores))
    return pa.table([queries.column("query_id"), queries.column("v"), queries.column("n"),
                     queries.column("shard"), pa.array(scores, _LISTS[0]), pa.array(ids, _LISTS[0])],
                    ["query_id", "v", "n", "home", "scores", "ids"])


#: The same rows for the table ``embeddings``.
SQL = """
with vectors as materialized (
  select row_number() over () as place, vec_id,
         list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v
  from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.place, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from vectors q join vectors c on len(q.v) = len(c.v) and q.place <> c.place
  where q.vec_id % 100 = 0),
ranked as (
  select query_id, vec_id, score, row_number() over (
    partition by place order by score desc, vec_id nulls last) as rank
  from scored)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 10
"""
