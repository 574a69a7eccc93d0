"""The pruned top-k join of weighted signals against every pair scored one by one."""

from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest

from evigraph.operators import signal_join as sj
from evigraph.session import shared_folder

ASKED = ("c_ord long, c_birth int, c_death int, "
         "signals array<struct<k: string, points: int, token: int, flags: int>>")
HELD = "p_ord long, birth int, death int, keys array<string>"
POINTS = {"f": 8, "t": 6, "l": 4, "m": 8, "n": 16, "w": 0}
FLAGS = {"f": 1, "t": 1, "l": 1, "m": 0, "n": 2, "w": 0}


def halves(asker, person):
    """Score, gap and flags of a pair, None if it shares nothing."""
    _, c_birth, c_death, signals = asker
    _, birth, death, keys = person
    hits = [(k, p, t, f) for k, p, t, f in signals for _ in range(keys.count(k))]
    if not hits:
        return None
    score = sum(p for _, p, _, _ in hits) + 3 * min(3, sum(t for _, _, t, _ in hits))
    gap = 300
    if c_birth is not None:
        ends = [abs(a - b) for a, b in ((birth, c_death if c_death is not None else c_birth),
                                        (death if death is not None else birth, c_birth))
                if a is not None]
        gap = min(ends, default=None)
        score += 2 * (-2 if gap is None else 3 if gap <= 60 else 2 if gap <= 150 else
                      1 if gap <= 300 else -2)
    flags = 0
    for *_, f in hits:
        flags |= f
    return score, gap, flags


def brute(asked, held, limit, cutoff, refused=()):
    out = []
    for asker in asked:
        found = []
        for person in held:
            scored = halves(asker, person)
            if scored and scored[0] >= cutoff and (asker[0], person[0]) not in refused:
                found.append((-scored[0], person[0], *scored[1:]))
        out += [(asker[0], p, i + 1, -s / 2, gap, flags)
                for i, (s, p, gap, flags) in enumerate(sorted(found, key=lambda x: x[:2])[:limit])]
    return sorted(out)


def rows_of(df):
    return sorted((r.c_ord, r.p_ord, r.position, r.score, r.gap, r.flags) for r in df.collect())


def signals(random, many):
    kinds = random.choice(list("fftllmwww"), many)
    return sorted({f"{k}={int(random.zipf(1.6)) % 12}" for k in kinds})


@pytest.fixture(scope="module")
def tables():
    random = np.random.default_rng(21)
    year = lambda: None if random.random() < 0.1 else int(random.integers(1000, 1900))
    asked, held = [], []
    for c in range(40):
        names = [f"n={int(random.integers(300))}"] if c % 3 == 0 else []
        keys = signals(random, int(random.integers(0, 9))) + names
        given = [(k, POINTS[k[0]], int(k[0] == "w"), FLAGS[k[0]]) for k in keys]
        if c % 9 == 0:          # a name in two lists counts twice
            given += [x for x in given if x[0][0] == "n"]
        asked.append((c, year(), year(), given))
    for p in range(300):
        keys = signals(random, int(random.integers(0, 8))) + [f"n={p}"]
        held.append((p, year(), year(), keys + keys[:1] * int(p % 5 == 0)))
    # A hot signature: equal signals, a few lives.
    held += [(1000 + i, 1500 + i % 4, None, ["f=1", "l=1", "w=1"]) for i in range(400)]
    return asked, held


def test_against_every_pair(spark, tables):
    asked, held = tables
    found = sj.top_matches(spark.createDataFrame(asked, ASKED), spark.createDataFrame(held, HELD),
                           5, 8, 3, 3)
    assert rows_of(found) == brute(asked, held, 5, 8)


def test_rejections_widen_only_their_asker(spark, tables, monkeypatch):
    asked, held = tables
    monkeypatch.setattr(sj, "SEEDS", 4)
    # One asker rejects the hot signature's first 150 people, others their best match.
    best = brute(asked, held, 1, 2)
    refused = {(c, p) for c, p, *_ in best[::2]} | {(7, 1000 + i) for i in range(150)}
    found = sj.top_matches(
        spark.createDataFrame(asked, ASKED), spark.createDataFrame(held, HELD), 4, 2, 3, 3,
        spark.createDataFrame(sorted(refused), "c_ord long, p_ord long"))
    assert rows_of(found) == brute(asked, held, 4, 2, refused)


def test_few_pairs_are_scored(spark, monkeypatch):
    """Common signals alone bring nobody in: the scored pairs follow the rare ones."""
    monkeypatch.setattr(sj, "SEEDS", 5)
    random = np.random.default_rng(3)
    held = [(p, 1800, 1850, ["w=1", "l=1", f"m={p % 50}", f"t={p % 40}"]) for p in range(3000)]
    asked = [(c, 1800, 1850, [(k, POINTS[k[0]], int(k[0] == "w"), 0) for k in (
        "w=1", "l=1", f"m={int(random.integers(50))}", f"t={int(random.integers(40))}")])
        for c in range(30)]
    counted = []
    real = sj._bounded
    monkeypatch.setattr(sj, "_bounded", lambda pairs, *rest: counted.append(
        pairs.count()) or real(pairs, *rest))
    found = sj.top_matches(spark.createDataFrame(asked, ASKED), spark.createDataFrame(held, HELD),
                           5, 8, 3, 3)
    assert rows_of(found) == brute(asked, held, 5, 8)
    # 200 signatures of (m, t), 30 askers: all pairs would be 6,000.
    assert sum(counted) < 1500


def test_ties_of_a_common_signal_are_not_all_scored(spark, monkeypatch):
    """People who tie at an asker's best score are met only as far as the order needs them."""
    held = [(p, 1800, 1850, ["f=1", f"m={p % 3}", f"k={p}"]) for p in range(1200)]
    asked = [(c, 1800, 1850, [("f=1", 8, 0, 1), (f"m={c % 3}", 8, 0, 0), *[
        (f"k={6 * c + n}", 10, 0, 2) for n in range(6) if (6 * c + n) % 3 != c % 3]])
        for c in range(200)]
    counted = []
    real = sj._bounded
    monkeypatch.setattr(sj, "_bounded", lambda pairs, *rest: counted.append(
        pairs.count()) or real(pairs, *rest))
    found = sj.top_matches(spark.createDataFrame(asked, ASKED), spark.createDataFrame(held, HELD),
                           5, 8, 3, 3)
    assert rows_of(found) == brute(asked, held, 5, 8)
    # Every asker ties with 400 people: 80,000 pairs.
    assert sum(counted) < 40000


def test_an_asker_in_several_rows(spark):
    """Whoever is given twice gets his best row in all places, as before."""
    asked = [(1, 1800, 1850, [("f=1", 8, 0, 1)])] * 2 + [(2, 1800, 1850, [("f=1", 8, 0, 1)])]
    held = [(p, 1800, 1850, ["f=1"]) for p in range(9)]
    found = sj.top_matches(spark.createDataFrame(asked, ASKED), spark.createDataFrame(held, HELD),
                           3, 8, 3, 3)
    best = [(1, 0, n, 7.0 + 4, 50, 1) for n in (1, 2, 3) for _ in range(2)]
    assert [r[:3] for r in rows_of(found)] == [r[:3] for r in sorted(
        best + [(2, p, p + 1, 11.0, 50, 1) for p in range(3)])]


def test_the_folder_holds_one_round_at_a_time(spark, tables, monkeypatch):
    """Tables are removed when the next are written; in the end only the answer is left."""
    asked, held = tables
    monkeypatch.setattr(sj, "SEEDS", 4)
    folder = Path(urlparse(shared_folder(spark)).path)
    before, most = set(folder.iterdir()), []
    real = sj._bounded
    monkeypatch.setattr(sj, "_bounded", lambda pairs, *rest: most.append(
        len(set(folder.iterdir()) - before)) or real(pairs, *rest))
    refused = spark.createDataFrame([(c, 1000 + c) for c in range(20)], "c_ord long, p_ord long")
    found = sj.top_matches(spark.createDataFrame(asked, ASKED), spark.createDataFrame(held, HELD),
                           4, 2, 3, 3, refused)
    assert len(most) > 5
    # The tables of the whole job, two slices' best, this slice's and this round's.
    assert max(most) <= 5
    assert len(set(folder.iterdir()) - before) == 1
    assert rows_of(found) == brute(asked, held, 4, 2, {(c, 1000 + c) for c in range(20)})


def test_empty(spark):
    asked = spark.createDataFrame([(1, None, None, [])], ASKED)
    held = spark.createDataFrame([(1, None, None, ["f=1"])], HELD)
    assert sj.top_matches(asked, held, 5, 0, 3, 3).collect() == []
    assert sj.top_matches(asked.limit(0), held.limit(0), 5, 0, 3, 3).collect() == []
