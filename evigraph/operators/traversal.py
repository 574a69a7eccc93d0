"""Traversals and neighbourhoods: paths, levels, ego networks, peers, contemporaries.

Each breadth-first round joins only the new frontier to the edges, drops visited nodes
with an anti join and checkpoints, so lineage stays short and a lost executor can
recompute from reliable storage.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.session import cut_lineage


def symmetric(edges: DataFrame) -> DataFrame:
    """Edges in both directions as (source, target, ord)."""
    ends = edges.select("source", "target", "ord")
    return ends.unionByName(ends.select(F.col("target").alias("source"),
                                        F.col("source").alias("target"), "ord"))


class Visited:
    """Nodes met so far in tables that double in size: a new one is merged with those before
    it that are no larger, so a search of n nodes reads log n tables and writes each node
    log n times."""

    def __init__(self, first: DataFrame, size: int):
        self.parts = [(first, size)]

    def add(self, found: DataFrame, size: int) -> None:
        self.parts.append((found, size))
        while len(self.parts) > 1 and self.parts[-2][1] <= self.parts[-1][1]:
            (one, n), (two, m) = self.parts.pop(), self.parts.pop()
            both = one.unionByName(two).repartition("id")
            self.parts.append((cut_lineage(both), n + m))

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [df for df, _ in self.parts])

    def unmet(self, step: DataFrame) -> DataFrame:
        """The rows of ``step`` whose node is in no table."""
        for df, _ in self.parts:
            step = step.join(df.select("id"), "id", "left_anti")
        return step


def levels(edges: DataFrame, start: DataFrame, max_depth: int | None = None,
           within: DataFrame | None = None) -> DataFrame:
    """Minimum depth of every node reached from ``start(id)``, in ``max_depth`` steps if given."""
    links = edges.select("source", "target").distinct()
    if within is not None:
        links = links.join(within.select(F.col("id").alias("target")), "target", "left_semi")
    links = cut_lineage(links)  # read by every round
    frontier = cut_lineage(start.select("id").distinct().withColumn("depth", F.lit(0)))
    seen = Visited(frontier, frontier.count())
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = links.join(frontier.select(F.col("id").alias("source")), "source", "left_semi")
        step = step.select(F.col("target").alias("id")).distinct()
        frontier = cut_lineage(seen.unmet(step).withColumn("depth", F.lit(depth)))
        size = frontier.count()
        if not size:
            break
        seen.add(frontier, size)
    return seen.all()


def reachable(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Undirected depth of every node connected to ``start``."""
    return levels(symmetric(edges), start, max_depth)


def level_sample(edges: DataFrame, people: DataFrame, start: DataFrame, max_depth: int = 3,
                 per_level: int = 8) -> DataFrame:
    """Directed levels around the start with the first people of each level."""
    found = levels(edges, start, max_depth).filter("depth > 0").join(
        people.select("id", "ord"), "id")
    order = Window.partitionBy("depth").orderBy("ord")
    return found.withColumn("_rn", F.row_number().over(order)).filter(
        F.col("_rn") <= per_level).drop("_rn")


class _Side:
    """One end of a two-sided search: its newest level, all levels and their table."""

    def __init__(self, ids: DataFrame):
        self.frontier = cut_lineage(ids.select("id").distinct())
        self.size = self.frontier.count()
        self.levels = [self.frontier]
        self.seen = Visited(self.frontier, self.size)

    def grow(self, step: DataFrame, other: _Side) -> bool:
        """Take the new nodes of ``step``; whether one is in the other side's newest level."""
        fresh = self.seen.unmet(step).join(
            other.frontier.select("id", F.lit(True).alias("met")), "id", "left")
        level = cut_lineage(fresh)
        found = level.agg(F.count(F.lit(1)).alias("n"), F.count("met").alias("met")).first()
        self.frontier, self.size = level.drop("met"), found["n"]
        self.levels.append(self.frontier)
        if self.size:
            self.seen.add(self.frontier.select("id"), self.size)
        return found["met"] > 0


def shortest_path(edges: DataFrame, people: DataFrame, source: DataFrame, target: DataFrame,
                  max_depth: int | None = None) -> DataFrame:
    """Fewest-edges directed path, ties as a queue would meet them: rows (step, id).

    Levels grow from both ends, the smaller newest one first, until they meet: what is read
    is the neighbourhood of both ends, not all within the path's length of one. Nodes from
    the goal's side keep the least-ordered edge that leads on to it; those of the other side
    get theirs on the way back from where the sides met. No node carries a path: pointers
    are followed in doubling steps. The search ends when a side meets no new node, or after
    ``max_depth`` edges if given.
    """
    known = people.select("id")
    links = edges.groupBy("source", "target").agg(F.min("ord").alias("ord")).join(
        known.withColumnRenamed("id", "source"), "source", "left_semi")
    links = cut_lineage(links)  # read by every round
    ahead = _Side(source.select("id").join(known, "id", "left_semi"))
    back = _Side(target.select("id").join(known, "id", "left_semi"))
    nexts: list[DataFrame] = []
    length = 0
    met = not ahead.frontier.join(back.frontier, "id", "left_semi").isEmpty()
    while not met and ahead.size and back.size and (max_depth is None or length < max_depth):
        length += 1
        if back.size <= ahead.size:
            into = links.join(back.frontier.withColumnRenamed("id", "target"), "target")
            met = back.grow(_first_steps(into), ahead)
            nexts.append(back.frontier.select("id", "next"))
        else:
            out = links.join(ahead.frontier.select(F.col("id").alias("source")), "source",
                             "left_semi").select(F.col("target").alias("id")).distinct()
            met = ahead.grow(out, back)
    if not met:
        return ahead.frontier.limit(0).select(F.lit(0).alias("step"), "id")
    useful = ahead.frontier.select("id").join(back.frontier.select("id"), "id", "left_semi")
    for level in reversed(ahead.levels[:-1]):
        steps = links.join(useful.withColumnRenamed("id", "target"), "target").join(
            level.select(F.col("id").alias("source")), "source", "left_semi")
        useful = cut_lineage(_first_steps(steps))
        nexts.append(useful)
        useful = useful.select("id")
    path = useful.join(ahead.levels[0].select("id"), "id", "left_semi").select(
        F.lit(0).alias("step"), "id")
    return _followed(path, nexts, length)


def _first_steps(steps: DataFrame) -> DataFrame:
    """Of every source the target of its least-ordered edge."""
    return steps.groupBy(F.col("source").alias("id")).agg(F.min_by("target", "ord").alias("next"))


def _followed(path: DataFrame, nexts: list[DataFrame], length: int) -> DataFrame:
    """The nodes met from ``path(step, id)`` along ``length`` pointers (id, next), by jumps of
    twice as many steps each time."""
    if not length:
        return path
    jump, hops = cut_lineage(reduce(DataFrame.unionByName, nexts)), 1
    path = cut_lineage(path)
    while True:
        ahead = path.join(jump, "id").select((F.col("step") + hops).alias("step"),
                                             F.col("next").alias("id"))
        path = cut_lineage(path.unionByName(ahead))
        hops *= 2
        if hops > length:
            return path
        jump = cut_lineage(jump.join(jump.select(F.col("id").alias("next"), F.col("next").alias(
            "after")), "next").select("id", F.col("after").alias("next")))


def path_edges(path: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge of each step of a (step, id) path; the last of several edges is shown."""
    after = path.select((F.col("step") - 1).alias("step"), F.col("id").alias("target"))
    pairs = path.withColumnRenamed("id", "source").join(after, "step")
    shown = edges.groupBy("source", "target").agg(
        F.max_by(F.struct("id", "type"), "ord").alias("e"))
    return pairs.join(shown, ["source", "target"], "left").select(
        "step", "source", "target", F.col("e.id").alias("edge_id"), "e.type")


def ego_network(edges: DataFrame, people: DataFrame, start: DataFrame,
                hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """(people within ``hops``, edges among the visible nodes)."""
    visible = levels(symmetric(edges), start, hops).select("id")
    inside = edges
    for end in ["source", "target"]:
        inside = inside.join(visible.withColumnRenamed("id", end), end, "left_semi")
    return people.join(visible, "id", "left_semi"), inside


def neighborhood(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(focus_id, id, direction) of the immediate relations of the chosen people."""
    ids = start.select(F.col("id").alias("focus_id"))
    out = edges.select(F.col("source").alias("focus_id"), F.col("target").alias("id"))
    into = edges.select(F.col("target").alias("focus_id"), F.col("source").alias("id"))
    both = out.withColumn("direction", F.lit("out")).unionByName(
        into.withColumn("direction", F.lit("in")))
    return both.join(ids, "focus_id", "left_semi").distinct()


def neighborhood_summary(edges: DataFrame) -> DataFrame:
    """Distinct neighbours and links of every node."""
    touched = symmetric(edges).filter("source <> target")
    links = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id"))
    near = touched.select("source", "target").distinct().groupBy(
        F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("neighbors"))
    total = links.groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    return total.join(near, "id", "left").withColumn(
        "neighbors", F.coalesce("neighbors", F.lit(0).cast("long")))


def genealogy(edges: DataFrame, people: DataFrame, start: DataFrame,
              max_depth: int = 3) -> DataFrame:
    """Ancestors and descendants with their minimum depth and the linking type.

    The type shown is that of the first edge from the previous generation.
    """
    up = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "ord",
                      "type")
    parts = []
    for name, links in [("ancestor", up), ("descendant", edges.select(
            "source", "target", "ord", "type"))]:
        found = levels(links, start, max_depth, within=people)
        previous = found.select(F.col("id").alias("source"), (F.col("depth") + 1).alias("depth"))
        kinds = links.join(previous, "source").select(
            F.col("target").alias("id"), "depth", "ord", "type").groupBy("id", "depth").agg(
            F.min_by("type", "ord").alias("type"))
        parts.append(found.filter("depth > 0").join(kinds, ["id", "depth"]).select(
            F.lit(name).alias("line"), "id", "depth", "type"))
    return parts[0].unionByName(parts[1])


def relation_rows(people: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """Relations of the chosen people, weak ones first, then by strength."""
    from evigraph.operators.normalize import has_evidence

    facts = edges.select(
        "id", "ord", "source", "target", "type", "strength",
        (F.coalesce(F.col("status") == "needs_source", F.lit(False)) | ~has_evidence())
        .alias("needs_source"), (F.coalesce("confidence", F.lit(1.0)) < 0.5).alias("low"))
    ids = start.select(F.col("id").alias("focus_id"))
    out = facts.withColumns({"focus_id": F.col("source"), "other_id": F.col("target"),
                             "direction": F.lit("out")})
    into = facts.filter("source <> target").withColumns({
        "focus_id": F.col("target"), "other_id": F.col("source"), "direction": F.lit("in")})
    rows = out.unionByName(into).join(ids, "focus_id", "left_semi").join(
        people.select(F.col("id").alias("other_id"), F.col("name").alias("other")), "other_id")
    return rows.withColumn("weak", F.col("needs_source") | F.col("low"))


def nearest_relations(people: DataFrame, edges: DataFrame, limit: int = 6) -> DataFrame:
    """The first ``limit`` relations of every person in edge order.

    The limit counts edges before the other end is looked up.
    """
    ends = edges.select("id", "ord", F.explode(F.array_distinct(F.array(
        F.struct(F.col("source").alias("me"), F.col("target").alias("other"),
                 F.lit("out").alias("direction")),
        F.when(F.col("source") != F.col("target"), F.struct(
            F.col("target").alias("me"), F.col("source").alias("other"),
            F.lit("in").alias("direction")))))).alias("x")).filter("x is not null").select(
        F.col("id").alias("edge_id"), "ord", "x.*")
    order = Window.partitionBy("me").orderBy("ord")
    return (ends.withColumn("position", F.row_number().over(order))
            .filter(F.col("position") <= limit)
            .join(people.select(F.col("id").alias("other")), "other", "left_semi"))


def top_relatives(people: DataFrame, edges: DataFrame, limit: int = 5) -> DataFrame:
    """Best-bridging parents and children of every person, edge order breaking ties."""
    bridge = people.select(F.col("id").alias("other"), F.coalesce("bridge_score", F.lit(2))
                           .alias("bridge"))
    parents = edges.select(F.lit("parent").alias("side"), F.col("target").alias("id"),
                           F.col("source").alias("other"), "ord")
    children = edges.select(F.lit("child").alias("side"), F.col("source").alias("id"),
                            F.col("target").alias("other"), "ord")
    order = Window.partitionBy("side", "id").orderBy(F.desc("bridge"), "ord")
    return (parents.unionByName(children).join(bridge, "other")
            .withColumn("position", F.row_number().over(order))
            .filter(F.col("position") <= limit))


def field_peers(people: DataFrame, limit: int = 8) -> DataFrame:
    """Best-bridging people sharing a field with each person.

    Only the ``limit + 1`` best of a field can be peers of anyone. Their list is made once
    per set of fields, and every person takes the first of it.
    """
    rows = people.select("id", "ord", F.coalesce("bridge_score", F.lit(1)).alias("bridge"),
                         F.explode(F.array_distinct("fields")).alias("field"))
    order = Window.partitionBy("field").orderBy(F.desc("bridge"), "ord")
    best = rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= limit + 1)
    # People with the same fields have the same peers but for themselves.
    mine = rows.groupBy(F.col("id").alias("person_id")).agg(
        F.array_sort(F.collect_set("field")).alias("shared"))
    lists = mine.select("shared").distinct().withColumn("field", F.explode("shared")).join(
        best.select("field", F.struct((-F.col("bridge")).alias("bridge"), "ord", "id").alias("peer")),
        "field").groupBy("shared").agg(F.sort_array(F.collect_set("peer")).alias("peers"))
    met = mine.join(lists, "shared").select("person_id", F.posexplode(F.slice(F.filter(
        "peers", lambda p: p["id"] != F.col("person_id")), 1, limit)).alias("pos", "peer"))
    return met.select("person_id", F.col("peer.id").alias("peer_id"),
                      (F.col("pos") + 1).alias("position"))


def era_peers(people: DataFrame, limit: int = 8) -> DataFrame:
    """People of the same era born closest to each person.

    Per era and birth year only the first ``limit + 1`` people can matter, and only the
    ``limit + 1`` nearest occupied years on either side; peers are found once per year.
    """
    rows = people.filter("era is not null and era <> ''").select("id", "ord", "era", "birth")
    inside = Window.partitionBy("era", "birth").orderBy("ord")
    first = rows.withColumn("_rn", F.row_number().over(inside)).filter(
        F.col("_rn") <= limit + 1).drop("_rn")
    years = rows.select("era", "birth").distinct()
    order = Window.partitionBy("era").orderBy("birth")
    near = years.withColumn("near", F.array_compact(F.array(
        "birth", *[F.lag("birth", n).over(order) for n in range(1, limit + 2)],
        *[F.lead("birth", n).over(order) for n in range(1, limit + 2)])))
    pool = near.select("era", F.col("birth").alias("year"), F.explode("near").alias("birth")).join(
        first, ["era", "birth"])
    closest = Window.partitionBy("era", "year").orderBy(
        F.abs(F.col("birth") - F.col("year")), "ord")
    best = pool.withColumn("_rn", F.row_number().over(closest)).filter(
        F.col("_rn") <= limit + 1).select(
        "era", F.col("year").alias("birth"), F.col("id").alias("peer_id"), "_rn")
    peers = rows.select(F.col("id").alias("person_id"), "era", "birth").join(
        best, ["era", "birth"]).filter("person_id <> peer_id")
    rank = Window.partitionBy("person_id").orderBy("_rn")
    return peers.withColumn("position", F.row_number().over(rank)).filter(
        F.col("position") <= limit).select("person_id", "peer_id", "position")


def contemporaries(people: DataFrame, limit: int = 8, as_of_year: int = 2026,
                   min_overlap: int = 20) -> DataFrame:
    """People whose lives overlap most with each person, more than ``min_overlap`` years.

    Overlap depends only on the two (birth, death) spans. Spans are at most years
    squared, whatever the number of people, so the ranking runs span against span, on
    the first ``limit + 1`` people of each span, and is then looked up per person.
    """
    rows = people.select("id", "ord", "birth",
                         F.coalesce("death", F.lit(as_of_year)).alias("death"))
    inside = Window.partitionBy("birth", "death").orderBy("ord")
    first = rows.withColumn("_rn", F.row_number().over(inside)).filter(
        F.col("_rn") <= limit + 1).drop("_rn")
    spans = rows.select("birth", "death").distinct()
    overlapping = _span_pairs(spans, min_overlap)
    # Only spans that can hold one of the limit + 1 best are kept before people join.
    best_spans = Window.partitionBy("birth", "death").orderBy(F.desc("overlap"), "_first")
    firsts = first.groupBy(F.col("birth").alias("b"), F.col("death").alias("d")).agg(
        F.min("ord").alias("_first"))
    short = (overlapping.join(firsts, ["b", "d"])
             .withColumn("_rn", F.row_number().over(best_spans))
             .filter(F.col("_rn") <= limit + 1).drop("_rn", "_first"))
    pool = short.join(first.select(F.col("birth").alias("b"), F.col("death").alias("d"),
                                   F.col("id").alias("peer_id"), "ord"), ["b", "d"])
    order = Window.partitionBy("birth", "death").orderBy(F.desc("overlap"), "ord")
    best = pool.withColumn("_rn", F.row_number().over(order)).filter(
        F.col("_rn") <= limit + 1).select("birth", "death", "peer_id", "overlap", "_rn")
    peers = rows.select(F.col("id").alias("person_id"), "birth", "death").join(
        best, ["birth", "death"]).filter("person_id <> peer_id")
    rank = Window.partitionBy("person_id").orderBy("_rn")
    return peers.withColumn("position", F.row_number().over(rank)).filter(
        F.col("position") <= limit).select("person_id", "peer_id", "overlap", "position")


def _span_pairs(spans: DataFrame, min_overlap: int) -> DataFrame:
    """Ordered span pairs overlapping by more than ``min_overlap`` years.

    An overlap longer than the bucket width fully covers a bucket boundary, so spans
    meet on the boundaries they share; the first shared boundary emits the pair.
    """
    width = max(1, min_overlap)
    low = F.ceil(F.col("birth") / F.lit(width)).cast("int")
    high = F.floor(F.col("death") / F.lit(width)).cast("int")
    marks = spans.filter(low <= high).withColumn("k", F.explode(F.sequence(low, high)))
    other = marks.select(F.col("birth").alias("b"), F.col("death").alias("d"), "k")
    overlap = F.least("death", "d") - F.greatest("birth", "b")
    first_shared = F.ceil(F.greatest("birth", "b") / F.lit(width)).cast("int")
    return (marks.join(other, "k").filter((F.col("k") == first_shared)
                                          & (overlap > min_overlap))
            .select("birth", "death", "b", "d", overlap.alias("overlap")))


def visible_arcs(edges: DataFrame, people: DataFrame, focus: DataFrame | None = None,
                 path: DataFrame | None = None, as_of_year: int = 2024) -> DataFrame:
    """Edges between shown people with mid-life years; a focus keeps its own arcs."""
    middle = F.floor((F.col("birth") + F.coalesce("death", F.lit(as_of_year))) / F.lit(2))
    side = lambda c: people.select(F.col("id").alias(c), middle.alias(f"{c}_year"))
    arcs = edges.join(side("source"), "source").join(side("target"), "target")
    kept = [df.select("id") for df in (focus, path) if df is not None]
    if not kept:
        return arcs
    touching = reduce(DataFrame.union, kept).distinct()
    marks = arcs.select("ord", F.explode(F.array("source", "target")).alias("id")).join(
        touching, "id", "left_semi").select("ord").distinct()
    return arcs.join(marks, "ord", "left_semi")
