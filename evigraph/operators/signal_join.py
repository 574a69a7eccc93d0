"""Exact top-k join by weighted signals, in growing slices of people.

People are taken in the order of their numbers, the first few, then ever larger slices. An
asker's k-th best score so far is what later people must exceed, as ties go to the smaller
number; so a slice holds few who still count. They are met at the asker's rarest signals: only
keys that can still lead above that score, and a key that brings many and does not suffice by
itself is made longer by each later signal, until it is rare or proves the score. A pair is
scored where it is met, and only pairs above the score are shuffled.

Tables between the rounds are narrow (an asker's signals are looked up by his number) and are
removed when the round after them is written, so the folder holds one round at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.session import Scratch, cut_lineage

#: People of the first slice, how many times all before it a later slice is, and the people of
#: one key that are cheaper to score than to tell apart. They change no answer.
SEEDS, GROWTH, OPEN = 64, 8, 16


def time_points(known: Column, gap: Column) -> Column:
    """Points for the years between two lives, in halves."""
    return F.when(~known, 0).when(gap <= 60, 6).when(gap <= 150, 4).when(gap <= 300, 2).otherwise(-4)


def life_gap(c_birth: str, c_death: str, birth: str, death: str) -> Column:
    """Years between two lives: the nearer of both distances from birth to the other's end."""
    return F.least(F.abs(F.col(birth) - F.coalesce(c_death, c_birth)),
                   F.abs(F.col(c_birth) - F.coalesce(death, birth)))


def _wanted(held: DataFrame, wanted: DataFrame, tables: Scratch) -> DataFrame:
    """People with the wanted among their signals, repeats included."""
    flat = held.select("p_ord", "birth", "death", F.explode("keys").alias("k"))
    return tables.keep(flat.join(wanted, "k", "left_semi").groupBy("p_ord").agg(
        F.first("birth").alias("birth"), F.first("death").alias("death"),
        F.sort_array(F.collect_list("k")).alias("keys")))


def _codes(people: DataFrame, tables: Scratch) -> DataFrame:
    """A number for each signal that people have, the rarest first, and how often one person
    has it at most."""
    counted = F.transform(F.array_distinct("keys"), lambda k: F.struct(
        k.alias("k"), F.size(F.filter("keys", lambda v: v == k)).alias("times")))
    found = people.select(F.inline(counted)).groupBy("k").agg(
        F.count(F.lit(1)).alias("length"), F.max("times").alias("times"))
    return tables.keep(found.orderBy("length", "k").select(
        "k", "times", F.monotonically_increasing_id().alias("code")))


def _askers(asked: DataFrame, codes: DataFrame, tables: Scratch) -> DataFrame:
    """A row per asker and life with the ``wants`` of his signals, what each is ``worth``, and
    for each of them in ``steps``, the rarest first, what it (``own``, ``tokens``) and all later
    ones (``own_after``, ``tokens_after``) give at most."""
    flat = asked.select("c_ord", F.inline("signals")).groupBy("c_ord", "k").agg(
        F.sum("points").alias("points"), F.max("token").alias("token")).join(codes, "k")
    later = Window.partitionBy("c_ord").orderBy(F.desc("code")).rowsBetween(
        Window.unboundedPreceding, -1)
    flat = flat.withColumns({"own": F.col("points") * F.col("times"),
                             "tokens": F.col("token") * F.col("times")})
    flat = flat.withColumns({f"{c}_after": F.coalesce(F.sum(c).over(later), F.lit(0))
                             for c in ("own", "tokens")})
    listed = lambda *columns: F.array_sort(F.collect_list(F.struct(*columns)))
    signals = flat.groupBy("c_ord").agg(
        F.array_sort(F.collect_list("code")).alias("wants"),
        F.map_from_entries(listed("code", F.struct("code", "points", "token", "times")))
        .alias("worth"),
        listed("code", "own", "tokens", "own_after", "tokens_after").alias("steps"))
    lives = asked.groupBy("c_ord", "c_birth", "c_death").agg(F.count(F.lit(1)).alias("copies"))
    return tables.keep(lives.join(signals, "c_ord").withColumn(
        "asker", F.monotonically_increasing_id()))


def _limits(people: DataFrame) -> list[int]:
    """The last numbers of all slices but the last one, about; that moves work only."""
    n, sizes = people.count(), []
    size = SEEDS
    while size < n:
        sizes.append(size)
        size *= GROWTH
    if not sizes:
        return []
    found = people.agg(F.percentile_approx("p_ord", [s / n for s in sizes], 100000)).first()[0]
    return sorted(set(found))


def _bounded(pairs: DataFrame, cap: int, points: int) -> DataFrame:
    """The pairs of an asker and a person whose score exceeds his floor: repeats count again;
    tokens, signals of no points of their own, give ``points`` up to ``cap`` times."""
    nothing = F.struct(F.lit(0).cast("long").alias("own"), F.lit(0).cast("long").alias("tokens"))

    def add(acc, x):
        times = F.when(x["times"] == 1, 1).otherwise(F.size(F.filter(
            "codes", lambda v: v == x["code"])))
        return F.struct((acc["own"] + x["points"] * times).alias("own"),
                        (acc["tokens"] + x["token"] * times).alias("tokens"))

    gap = F.when(F.col("c_birth").isNotNull(), life_gap("c_birth", "c_death", "birth", "death")
                 ).otherwise(300)
    time = time_points(F.col("c_birth").isNotNull(), F.col("gap"))
    # The few codes in common are found by compiled code; the rest looks at these alone.
    hits = F.transform(F.array_intersect("wants", "codes"), lambda v: F.element_at("worth", v))
    base = F.aggregate(hits, nothing, add, lambda acc: acc["own"] + points * F.least(
        acc["tokens"], F.lit(cap)))
    return pairs.withColumn("gap", gap).withColumn("score", base + time).filter(
        F.col("score") > F.col("floor")).select(
        "c_ord", "c_birth", "c_death", "copies", "p_ord", "score", "gap")


def _above(askers: DataFrame, people: DataFrame, cap: int, points: int,
           tables: Scratch) -> DataFrame:
    """All pairs whose score exceeds the asker's ``floor``, some of them several times."""
    root = {"key": F.lit(0).cast("long"), "last": F.lit(-1).cast("long")}
    paths = askers.select("asker", "c_birth", "steps", "floor")
    lives = askers.select("asker", "c_ord", "c_birth", "c_death", "copies", "wants", "worth", "floor")
    mine = paths.withColumns({**root, "sum": F.lit(0).cast("long"),
                              "count": F.lit(0).cast("long")})
    theirs = people.withColumns(root)
    # What time gives at most.
    time = F.when(F.col("c_birth").isNotNull(), 6).otherwise(0)
    own, tokens = F.col("sum") + F.col("x.own"), F.col("count") + F.col("x.tokens")
    most = lambda a, b: a + points * F.least(b, F.lit(cap)) + time
    longer = F.xxhash64("key", "code")
    tasks = int(people.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found, before = [], None
    while True:
        step = Scratch(people.sparkSession)
        mine = mine.withColumn("x", F.explode(F.filter(
            "steps", lambda x: x["code"] > F.col("last")))).filter(
            most(own + F.col("x.own_after"), tokens + F.col("x.tokens_after")) > F.col("floor"))
        mine = step.keep(mine.withColumn("code", F.col("x.code")).select(
            "asker", longer.alias("key"), F.col("code").alias("last"), own.alias("sum"),
            tokens.alias("count"), (most(own, tokens) > F.col("floor")).alias("sure")))
        theirs = theirs.withColumn("code", F.explode(F.array_distinct(F.filter(
            "codes", lambda v: v > F.col("last"))))).select(
            "p_ord", "birth", "death", "codes", longer.alias("key"), F.col("code").alias("last"))
        theirs = step.keep(theirs.join(mine.select("key").distinct(), "key", "left_semi"))
        lengths = theirs.groupBy("key").agg(F.count(F.lit(1)).alias("length"))
        mine = step.keep(mine.join(lengths, "key").withColumn(
            "open", F.col("sure") | (F.col("length") <= OPEN)).drop("length", "sure"))
        if before is not None:
            before.remove()
        opened = mine.filter("open").select("asker", "key")
        hosts = theirs.drop("last").join(opened.select("key").distinct(), "key", "left_semi")
        # Few rows meet many: however small their file, all tasks share the scoring.
        met = opened.repartition(tasks, "asker", "key").join(lives, "asker").join(hosts, "key")
        found.append(tables.keep(_bounded(met, cap, points)))
        mine = mine.filter("not open").drop("open")
        if mine.isEmpty():
            step.remove()
            return reduce(DataFrame.unionByName, found)
        theirs = theirs.join(mine.select("key").distinct(), "key", "left_semi")
        mine, before = mine.join(paths, "asker"), step


def _allowed(pairs: DataFrame, rejected: DataFrame | None) -> DataFrame:
    """The pairs that are not rejected; those of askers who reject nobody are not shuffled."""
    if rejected is None:
        return pairs
    choosy = rejected.select("c_ord").distinct()
    return pairs.join(choosy, "c_ord", "left_anti").unionByName(
        pairs.join(choosy, "c_ord", "left_semi").join(rejected, ["c_ord", "p_ord"], "left_anti"))


def top_matches(asked: DataFrame, held: DataFrame, limit: int, cutoff: float, token_points: int,
                token_cap: int, rejected: DataFrame | None = None) -> DataFrame:
    """The best ``limit`` people of every asker, by score and then ``p_ord``.

    ``asked(c_ord, c_birth, c_death, signals array<struct<k, points, token, flags>>)``;
    ``held(p_ord, birth, death, keys array<string>)``. Points, none of them negative, and
    ``cutoff`` are halves. A person counts who shares a signal and is not in
    ``rejected(c_ord, p_ord)``. An asker's own rejections widen his search, and nobody else's.
    """
    spark = asked.sparkSession
    tables = Scratch(spark)
    people = _wanted(held, asked.select(F.inline("signals")).select("k").distinct(), tables)
    codes = _codes(people, tables)
    askers = _askers(asked, codes, tables)
    coded = tables.keep(people.select("p_ord", "birth", "death", F.explode("keys").alias("k")).join(
        codes.select("k", "code"), "k").groupBy("p_ord").agg(
        F.first("birth").alias("birth"), F.first("death").alias("death"),
        F.sort_array(F.collect_list("code")).alias("codes")))
    if rejected is not None:
        rejected = tables.keep(rejected.select("c_ord", "p_ord"))
    rank = Window.partitionBy("c_ord").orderBy(F.desc("score"), "p_ord")
    place = F.row_number().over(rank)
    best, low, before = None, None, None
    for high in [*_limits(people), None]:
        part = coded if low is None else coded.filter(F.col("p_ord") > low)
        part = part if high is None else part.filter(F.col("p_ord") <= high)
        floor = F.lit(int(cutoff) - 1).cast("long")
        live = askers.withColumn("floor", floor)
        if best is not None:
            full = best.groupBy("c_ord").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias(
                "least")).filter(F.col("n") >= limit)
            live = askers.join(full, "c_ord", "left").withColumn(
                "floor", F.coalesce("least", floor)).drop("n", "least")
        passing, lasting = Scratch(spark), Scratch(spark)
        new = _allowed(_above(passing.keep(live), part, token_cap, token_points, passing), rejected)
        # A pair met several times has one rank, so the first ranks hold the first rows.
        new = new.withColumn("place", F.dense_rank().over(rank)).filter(
            F.col("place") <= limit).drop("place").distinct()
        new = new if best is None else best.unionByName(new)
        best = lasting.keep(new.withColumn("place", place).filter(
            F.col("place") <= limit).drop("place"))
        passing.remove()
        if before is not None:
            before.remove()
        low, before = high, lasting
    # The rows of an asker who comes several times are joined with each other.
    given = asked.groupBy("c_ord").agg(F.count(F.lit(1)).alias("given"))
    times = F.least(F.lit(limit), F.pow("given", F.lit(4)) * F.col("copies")).cast("int")
    top = best.join(given, "c_ord").withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    top = top.withColumn("position", place).filter(F.col("position") <= limit).select(
        "c_ord", "p_ord", "position", "score", "gap")
    shared = F.aggregate("signals", F.lit(0), lambda acc, x: F.when(
        F.array_contains("keys", x["k"]), acc.bitwiseOR(x["flags"])).otherwise(acc))
    matches = cut_lineage(top.join(asked.select("c_ord", "signals"), "c_ord").join(
        people.select("p_ord", "keys"), "p_ord").select(
        "c_ord", "p_ord", "position", (F.col("score") / F.lit(2.0)).alias("score"), "gap",
        shared.alias("flags")))
    tables.remove()
    before.remove()
    return matches
