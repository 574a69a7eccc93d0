"""Jobs whose work must not outgrow their input: right results by plans without the old growth."""

import itertools
import random

from pyspark.sql import functions as F

from evigraph.functions import text as tx
from evigraph.operators import groups as gr
from evigraph.operators import linkage as ln
from evigraph.operators import missing_edges as me
from evigraph.operators import traversal as tr
from evigraph.sources import dumps
from tests.fixtures import claims, edges, people, threads


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def crowd(spark, n=60):
    rng = random.Random(5)
    rows = [{"id": f"p{i}", "birth": rng.randrange(1500, 1900),
             "movement": rng.choice(["M1", "M2", "", None]),
             "region": rng.choice(["R1", "R2", None])} for i in range(n)]
    return rows, people(spark, *rows)


def test_context_pairs_are_not_grouped(spark):
    rows, table = crowd(spark)
    focus = table.filter("ord % 4 = 0").select("id")
    want = {}
    for (i, a), (j, b) in itertools.combinations(enumerate(rows), 2):
        same = [(c, a[c]) for c in ("movement", "region") if a[c] and a[c] == b[c]]
        if same and abs(a["birth"] - b["birth"]) <= 125 and (i % 4 == 0 or j % 4 == 0):
            ends = (a["id"], b["id"]) if a["birth"] <= b["birth"] else (b["id"], a["id"])
            want[ends] = "Chronology-constrained shared {}: {}.".format(*same[0])
    out = me.context_pairs(table, focus)
    assert "Aggregate" not in plan(out).split("Join")[0]
    got = out.collect()
    assert {(r.source, r.target): r.note for r in got} == want and len(got) == len(want)


def test_field_peers_by_set_of_fields(spark):
    table = people(spark, *[{"id": f"p{n}", "birth": 1800, "fields": [f"f{n % 3}", f"g{n % 2}"],
                             "bridge_score": n % 4} for n in range(60)])
    out = tr.field_peers(table, 3)
    assert "windowspecdefinition(person_id" not in plan(out)
    best = lambda n: sorted((m for m in range(60) if m != n and (
        m % 3 == n % 3 or m % 2 == n % 2)), key=lambda m: (-(m % 4), m))[:3]
    assert {(r.person_id, r.position): r.peer_id for r in out.collect()} == {
        (f"p{n}", i + 1): f"p{m}" for n in range(60) for i, m in enumerate(best(n))}


def test_coauthors_meet_once(spark):
    rng, rows, last = random.Random(3), [], {}
    for n in range(40):
        names = rng.sample("abcdefg", rng.randrange(1, 5))
        rows.append((f"w/W{n}", n, [((f"a/A{c}", f"{c} of {n}"),) for c in names]))
        last.update({(f"a{p}", f"a{q}"): (f"{q} of {n}", f"w{n}")
                     for p, q in itertools.permutations(names, 2)})
    dump = spark.createDataFrame(rows, "id string, ord long, authorships array<struct<author:"
                                       "struct<id:string,display_name:string>>>")

    def got(df):
        return {(r.source_id[7:], r.target_id[7:]): (
            r.label.split(" collaborated with ")[1], r.claim_id.split("-")[-1])
            for r in df.collect()}

    out = dumps.coauthors(dump)
    assert "xxhash64" in plan(out)
    assert got(out) == last
    focal = spark.createDataFrame([("a/Aa",), ("a/Ac",)], "id string")
    assert got(dumps.coauthors(dump, focal)) == {
        k: v for k, v in last.items() if k[0] in ("aa", "ac")}


def test_evidence_tokens_without_lambdas(spark):
    texts = ["Known Theory of QUANTUM quantum-fields, 12345 1234", "", None, "a\x0blonger\tlonger"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(
        tx.evidence_tokens(F.col("text")).alias("w"))
    assert [r.w for r in df.collect()] == [["quantum", "fields", "12345"], [], None, ["longer"]]
    assert "lambda" not in plan(df)


def test_first_pairs_of_many_rows(spark):
    often = spark.range(1, 400).select(F.lit("p1").alias("a_id"), F.lit("p2").alias("b_id"),
                                       F.lit(18).alias("score"), F.lit(1).alias("a_ord"),
                                       F.lit(2).alias("b_ord"))
    rest = spark.range(3, 50).select(F.lit("p1"), F.concat(F.lit("p"), "id"), F.lit(9), F.lit(1),
                                     F.col("id").cast("int"))
    out = ln._first_pairs(often.union(rest), 5).collect()
    assert [(r.b_id, r.score) for r in out] == [("p2", 18), *[(f"p{n}", 9) for n in range(3, 7)]]


def test_context_of_chosen_people_alone(spark):
    """Pairs of mere context, pairs with other evidence and people listed twice."""
    rows, table = crowd(spark)
    table = table.unionByName(table.filter("ord % 9 = 2").withColumn("birth", F.col("birth") + 1))
    table = table.withColumn("influenced", F.array().cast("array<string>"))
    focus = table.filter("ord % 3 = 0").select("id").distinct()
    told = threads(spark, *[{"id": f"t{n}", "people": [f"p{n}", f"p{n + 3}"]} for n in range(50)])
    linked = edges(spark, *[{"source": f"p{n}", "target": f"p{n + 6}", "type": me.NEIGHBOR}
                            for n in range(40)])
    none = claims(spark)
    rows = me.evidence_rows(table, linked, none, told, focus)
    pairs = gr.partners(me._context(table), focus).select(
        F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    stated = rows.filter("channel <> 2").drop("key_a", "key_b")
    whole = me.without_existing(stated.unionByName(me._context_rows(pairs, table)), linked)
    columns = ["key_a", "key_b", "type", "source", "target", "strength", "confidence", "evidence"]
    pick = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert rows.count() < whole.count() / 2
    assert pick(me.discover(table, linked, none, told, focus)) == pick(me.merge(whole))
    for few in (0, 64):
        me.FEW, before = few, me.FEW
        alone = me.lone_context(table, linked, rows, focus)
        me.FEW = before
        assert pick(alone.unionByName(me.merge(rows), allowMissingColumns=True)) == pick(
            me.merge(whole))
