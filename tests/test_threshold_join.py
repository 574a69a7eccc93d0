"""Person linkage at its rarest sufficient signals, against every pair scored on its own."""

import itertools
import random

from evigraph.operators import linkage as ln
from evigraph.operators.threshold_join import sufficient_pairs

CONTEXTS = ln.PERSON_CONTEXTS
PEOPLE = ("id string, ord long, name string, alternate_names array<string>, birth int, death int, "
          "external_ids map<string,array<string>>, " + ", ".join(
              f"{c} array<string>" for c in CONTEXTS))
SIGNALS = "id string, kind string, value string, points int"


def crowd(seed, count, prefix):
    """People of whom a third have one name and a third one year and field."""
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        some = lambda values, most: rng.sample(values, rng.randrange(most + 1))
        rows.append((
            f"{prefix}{i}", i, "John Smith" if i % 3 == 0 else f"Person {rng.randrange(60)}",
            rng.choice([None, [], ["J. Smith"], ["John  Smith!", f"Person {rng.randrange(60)}"]]),
            1800 if i % 3 == 1 else rng.choice([None, 1799, 1801, 1802, 1805]),
            rng.choice([None, 1850, 1860]),
            rng.choice([None, {}, {"viaf": [f"V{rng.randrange(40)}", f"V{rng.randrange(40)}"]},
                        {"isni": [f"I{rng.randrange(5)}"], "viaf": ["V1"]}]),
            ["Logic"] if i % 3 == 1 else some(["Logic", "Music", "Law"], 2),
            some(["writer", "judge"], 2), some([f"W{k}" for k in range(30)], 4),
            rng.choice([None, ["A"], ["A", "B", "C"]]), some(["M", "N"], 1)))
    return rows


def key(text):
    return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


def score(a, b):
    names = [{key(n) for n in [r[2], *(r[3] or [])]} for r in (a, b)]
    points = 35 * bool(names[0] & names[1])
    if a[4] is not None and b[4] is not None:
        gap = abs(a[4] - b[4])
        points += 18 if gap == 0 else 8 if gap <= 2 else 0
    points += 8 * (a[5] is not None and a[5] == b[5])
    ids = [{(k, v) for k, vs in (r[6] or {}).items() for v in vs} for r in (a, b)]
    points += min(30, 15 * len(ids[0] & ids[1]))
    for i in range(7, 12):
        points += min(8, 4 * len(set(a[i] or []) & set(b[i] or [])))
    return min(100, points)


def test_linkage_equals_brute_force_with_a_hot_name(spark):
    left, right = crowd(1, 150, "c"), crowd(2, 240, "p")
    expected = {(a[0], b[0], score(a, b)) for a, b in itertools.product(left, right)
                if score(a, b) >= 55}
    out = ln.person_linkage(spark.createDataFrame(left, PEOPLE),
                            spark.createDataFrame(right, PEOPLE)).collect()
    got = {(r.candidate_profile, r.existing_profile, round(100 * r.score)) for r in out}
    # No two rows are equal, so every profile is one record.
    assert len(out) == len(got) and got == expected and len(expected) > 300


def test_block_size_changes_no_answer(spark):
    frames = [spark.createDataFrame(crowd(s, 90, p), PEOPLE) for s, p in ((3, "c"), (4, "p"))]
    profiles = [ln.person_profiles(df)[0] for df in frames]
    signals = [ln.person_signals(df, n == 0) for n, df in enumerate(profiles)]
    wanted = {(a[0], b[0]) for a, b in itertools.product(crowd(3, 90, "c"), crowd(4, 90, "p"))
              if score(a, b) >= 55}
    for size in (1, 20, 10**9):
        got = {(r.l, r.r) for r in sufficient_pairs(*signals, ln.PERSON_CAPS, 55, size).collect()}
        assert wanted <= got


def test_common_signals_bring_nobody_together(spark):
    """A name and a year reach 53 points: 500 x 500 people who share only these meet nowhere."""
    def side(name):
        rows = [(f"{name}{i}", kind, value, points) for i in range(500) for kind, value, points in (
            ("name", "john smith", 35), ("birth", "1800", 18), ("fields", f"{name}{i}", 4),
            ("works", f"shared {i}" if i < 3 else f"{name}{i}", 4))]
        return spark.createDataFrame(rows, SIGNALS)

    pairs = sufficient_pairs(side("l"), side("r"), ln.PERSON_CAPS, 55).collect()
    assert {(r.l, r.r) for r in pairs} == {(f"l{i}", f"r{i}") for i in range(3)}


def test_hot_pairs_that_suffice_are_all_kept(spark):
    rows = lambda n, p: spark.createDataFrame(
        [(f"{p}{i}", k, "x", w) for i in range(n) for k, w in (("name", 35), ("birth", 18),
                                                              ("death", 8))], SIGNALS)
    out = sufficient_pairs(rows(60, "l"), rows(70, "r"), ln.PERSON_CAPS, 55, 10)
    assert out.count() == 60 * 70


def test_absent_signals_and_empty_sides(spark):
    none = spark.createDataFrame([], SIGNALS)
    some = spark.createDataFrame([("a", "name", None, 35), (None, "name", "x", 35),
                                  ("b", "name", "x", 35), ("b", "id", "1", 15),
                                  ("b", "id", "1", 15), ("b", "id", "2", 15)], SIGNALS)
    assert sufficient_pairs(some, none, ln.PERSON_CAPS, 55).count() == 0
    assert [(r.l, r.r) for r in sufficient_pairs(some, some, ln.PERSON_CAPS, 55).collect()] == [
        ("b", "b")]
    # A repeated id counts once.
    assert sufficient_pairs(some.filter("value <> '2'"), some, ln.PERSON_CAPS, 55).count() == 0
