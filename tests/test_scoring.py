"""Pairs are scored from the codes in common, repeats included, without a look at all others."""

import random

from pyspark.sql import functions as F

from evigraph.operators import signal_join as sj
from evigraph.session import Scratch
from tests.test_growth import plan


def test_scores_from_common_codes(spark):
    rng = random.Random(4)
    asked = [(i, None, None, [(rng.choice("abcdefgh"), rng.choice([0, 3, 8]), rng.choice([0, 1]), 0)
                              for _ in range(rng.randrange(1, 7))]) for i in range(12)]
    held = [(i, 1800, None, [rng.choice("abcdefghij") for _ in range(rng.randrange(1, 7))])
            for i in range(25)]
    tables = Scratch(spark)
    people = spark.createDataFrame(held, "p_ord long, birth int, death int, keys array<string>")
    codes = sj._codes(people, tables)
    askers = sj._askers(spark.createDataFrame(
        asked, "c_ord long, c_birth int, c_death int, signals array<struct<k:string,points:int,"
               "token:int,flags:int>>"), codes, tables)
    number = {r.k: r.code for r in codes.collect()}
    coded = spark.createDataFrame([(*r[:3], [number[k] for k in r[3]]) for r in held],
                                  "p_ord long, birth int, death int, codes array<long>")
    met = askers.withColumn("floor", F.lit(-1).cast("long")).crossJoin(coded)
    scored = sj._bounded(met, 3, 5)
    assert "array_contains" not in plan(scored)
    want = {}
    for c, _, _, signals in asked:
        for p, _, _, keys in held:
            own = sum(x[1] * keys.count(x[0]) for x in signals)
            # One name that is a token in several lists is one token.
            tokens = sum(keys.count(k) for k in {x[0] for x in signals if x[2]})
            want[c, p] = own + 5 * min(3, tokens)
    got = {(r.c_ord, r.p_ord): r.score for r in scored.collect()}
    known = {r.c_ord for r in askers.collect()}
    assert got == {k: v for k, v in want.items() if k[0] in known}
    tables.remove()
