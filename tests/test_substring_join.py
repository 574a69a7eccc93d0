"""Texts and the patterns they hold, against every pair compared."""

import numpy as np

from evigraph.operators import substring_join as sub
from evigraph.operators.substring_join import contained


def brute(texts, patterns):
    return sorted((i, p) for i, t in texts if t for p in {x for x in patterns if x} if p in t)


def found(spark, texts, patterns):
    out = contained(spark.createDataFrame(texts, "id long, text string"),
                    spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    return sorted((r.id, r.pattern) for r in out.collect())


def words(random, many, letters, longest):
    return ["".join(random.choice(list(letters), int(random.integers(1, longest))))
            for _ in range(many)]


def test_against_every_pair(spark):
    random = np.random.default_rng(8)
    texts = list(enumerate(words(random, 150, "ab", 14) + words(random, 100, "abcdé🎉", 30)))
    patterns = words(random, 60, "ab", 12) + words(random, 60, "abcdé🎉", 5)
    patterns += [t[2:11] for _, t in texts[::3]] + [texts[7][1], "", None, "zzz", "zzzzzzzzz"]
    texts += [(900, ""), (901, None), (902, texts[3][1])]
    assert found(spark, texts, patterns + patterns[:9]) == brute(texts, patterns)


def test_hot_pattern(spark):
    """A short name within a third of all names: just its pairs, few rows a name."""
    random = np.random.default_rng(5)
    names = [f"{'johnsmith' if i % 3 == 0 else ''}{w}" for i, w in enumerate(
        words(random, 600, "abcdefghijklmnop", 30))]
    texts = [(i, n) for i, n in enumerate(names)]
    patterns = ["johnsmith", *{n for n in names if len(n) > 6}]
    assert found(spark, texts, patterns) == brute(texts, patterns)
    known = spark.createDataFrame([(p,) for p in patterns], "pattern string").withColumn(
        "q", sub._gram_length("pattern"))
    waiting = known.select("pattern", "q", sub.F.explode(sub._grams("pattern")).alias("gram"))
    rows = sub.text_grams(spark.createDataFrame(texts, "id long, text string"), waiting).count()
    assert rows < 50 * len(texts)


def test_empty(spark):
    assert found(spark, [], ["a"]) == [] and found(spark, [(1, "a")], []) == []
