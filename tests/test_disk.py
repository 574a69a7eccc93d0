"""Jobs must not hold on disk what they need no more."""

import random

from pyspark.sql import functions as F

from evigraph import session
from evigraph.operators import groups as gr
from evigraph.operators import missing_edges as me
from evigraph.sources import dumps
from tests.fixtures import claims, edges, people, threads
from tests.test_growth import plan


def shuffle_files(spark) -> int:
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_kept_tables_free_their_shuffles(spark):
    held = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before, setting = shuffle_files(spark), spark.conf.get(session.FREE_SHUFFLES, None)
    tables = session.Scratch(spark)
    kept, cut = tables.keep(held, "zstd"), session.cut_lineage(held)
    assert sorted(kept.collect()) == sorted(cut.collect())
    assert shuffle_files(spark) <= before
    assert spark.conf.get(session.FREE_SHUFFLES, None) == setting
    tables.remove()
    assert cut.count() == held.count() == 7


def test_coauthors_in_passes(spark, monkeypatch):
    rng, rows, last = random.Random(8), [], {}
    for n in range(60):
        names = [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 6))]
        rows.append((f"w/W{n}", n, [((f"a/A{c}", f"{c} of {n}"),) for c in names]))
        last.update({(f"a{p}", f"a{q}"): f"w{n}" for p in names for q in names if p != q})
    rows += [("w/W98", 98, None), ("w/W99", 99, [((None, "x"),), (("a/Aa", None),)])]
    dump = spark.createDataFrame(rows, "id string, ord long, authorships array<struct<author:"
                                       "struct<id:string,display_name:string>>>")
    for size in (1, 40, 10**6):
        monkeypatch.setattr(dumps, "PASS_PAIRS", size, raising=False)
        out = dumps.coauthors(dump)
        if size < 100:  # the pairs of all authors are not shuffled at once
            assert "Aggregate" not in plan(out)
        got = [((r.source_id[7:], r.target_id[7:]), r.claim_id.split("-")[-1]) for r in out.collect()]
        assert dict(got) == last and len(got) == len(last)
    empty = dump.limit(0)
    assert dumps.coauthors(empty).count() == 0


def largest_plan(monkeypatch, modules, job) -> int:
    """Lines of the largest plan of the tables that a job keeps, and of its result."""
    sizes = []
    for module in modules:
        cut = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, cut=cut: (
            sizes.append(plan(df).count("\n")), cut(df))[1])
    out = job()
    return max([*sizes, plan(out).count("\n")])


def crowd_of(spark, n=40):
    """People, a focus that takes joins to find, and what claims and threads say of them."""
    rng = random.Random(9)
    names = [f"p{i}" for i in range(n)]
    table = people(spark, *[{"id": i, "birth": rng.randrange(1500, 1900), "movement": rng.choice(
        ["M1", "M2", None]), "influenced": rng.sample(names, 2)} for i in names])
    for _ in range(3):
        table = table.join(table.select("id").distinct(), "id")
    told = threads(spark, *[{"id": f"t{k}", "people": rng.sample(names, 3)} for k in range(20)])
    said = claims(spark, *[{"id": f"c{k}", "subject_id": "relationship:person:{}:Influence:person:{}"
                            .format(*rng.sample(names, 2))} for k in range(20)])
    linked = edges(spark, *[{"id": f"e{k}", "source": rng.choice(names), "target": rng.choice(names)}
                            for k in range(20)])
    return table, linked, said, told, table.filter("ord % 4 = 0").select("id")


def test_focus_is_planned_once(spark, monkeypatch):
    table, linked, said, told, focus = crowd_of(spark)
    rows = {}

    def job():
        found = me.discover(table, linked, said, told, focus)
        rows["now"] = sorted(map(tuple, found.select("source", "target", "type", "evidence").collect()))
        return found

    assert largest_plan(monkeypatch, [me], job) < 150
    chosen = {r.id for r in focus.collect()}
    assert rows["now"] and all({s, t} & chosen for s, t, _, _ in rows["now"])
    stated = [(r.source, r.target, r.type) for r in me.from_threads(told, table).collect()
              if {r.source, r.target} & chosen]
    assert sorted(stated) == sorted((r.source, r.target, r.type) for r in me.from_threads(
        told, table, focus).collect())


def test_touching_rows_come_once(spark):
    rows = spark.createDataFrame([("a", "b", 1), ("b", "a", 2), ("a", "c", 3), ("c", "d", 4),
                                  (None, "a", 5), (None, "c", 6), ("c", None, 7), ("a", "b", 1)],
                                 "s string, t string, n int")
    focus = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "id string")
    assert sorted(r.n for r in gr.touching(rows, focus, "s", "t").collect()) == [1, 1, 2, 3, 5]
