import re

import numpy as np
import pytest

from evigraph.llm import decontamination as dc


def plain_words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_align(doc, item):
    """Smith-Waterman cell by cell."""
    best = 0
    row = [0] * (len(doc) + 1)
    for w in item:
        new = [0]
        for j, v in enumerate(doc, 1):
            new.append(max(0, row[j - 1] + (dc.FITS if v == w else dc.DIFFERS),
                           row[j] + dc.GAP, new[j - 1] + dc.GAP))
            best = max(best, new[j])
        row = new
    return best


@pytest.mark.parametrize("seed", range(30))
def test_alignment(seed):
    rng = np.random.default_rng(seed)
    doc = rng.integers(0, 4, int(rng.integers(1, 40))).astype(np.uint64)
    item = rng.integers(0, 4, int(rng.integers(1, 20))).astype(np.uint64)
    score, a, b = dc.align(doc, item)
    assert score == plain_align(doc.tolist(), item.tolist())
    assert 0 <= a <= b <= len(doc)
    if score:
        assert dc.align(doc[a:b], item)[0] == score


def test_brute_force(spark, sf):
    """Every pair aligned whole: none above the limit is missed, none below it reported."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.score for r in dc.contaminated(docs, bench).collect()}
    items = {r.item_id: plain_words(r.text) for r in bench.collect()}
    ids = {}
    coded = {k: np.array([ids.setdefault(x, len(ids)) for x in w], np.uint64) for k, w in items.items()}
    want = {}
    for r in docs.collect():
        words = np.array([ids.get(x, 1 << 40) for x in plain_words(r.text)], np.uint64)
        for k, item in coded.items():
            if len(np.intersect1d(words, item)) * 2 >= len(set(item.tolist())):
                score = dc.align(words, item)[0] / (dc.FITS * len(item))
                if score >= dc.MIN_SCORE:
                    want[r.doc_id, k] = score
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


ITEM = ("The committee found that seventeen of the bridges built before the war had been "
        "repaired without any record of the work being kept by the county")


def test_edited_copies_and_hot_items(spark):
    words = ITEM.split()
    edited = " ".join("another" if i % 6 == 5 else w for i, w in enumerate(words))
    half = " ".join(words[:10])
    other = "Nothing here has to do with it at all, in any of the ways one could think of."
    docs = [(i, f"intro {i} {ITEM} outro") for i in range(40)]
    docs += [(100, f"before {edited} after"), (101, half), (102, other), (103, ITEM.upper())]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (4, "")], "item_id long, text string")
    got = {r.doc_id: r for r in dc.contaminated(df, bench).collect()}
    assert set(got) == {*range(40), 100, 103}
    assert got[0].score == 1 and (got[0].first_word, got[0].last_word) == (2, len(words) + 1)
    assert 0.5 < got[100].score < 1
    assert {r.doc_id for r in dc.clean(df, bench).collect()} == {101, 102}


def test_blocks_of_items(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted(map(tuple, dc.contaminated(docs, bench).collect()))
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 17)
    assert sorted(map(tuple, dc.contaminated(docs, bench).collect())) == whole


def test_odd(spark, odd, none):
    bench = spark.createDataFrame([(1, "The quick brown fox. The quick brown fox."), (1, None),
                                   (None, "word0 of0 word1 of1 word2 of2")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(odd, bench).collect()}
    assert {(1, 1), (5, None), (6, None)} <= got
    assert dc.contaminated(none, bench).count() == 0
    assert dc.contaminated(odd, bench.limit(0)).count() == 0
    assert dc.clean(odd, bench.limit(0)).count() == odd.count()
    assert dc.clean(odd, bench).columns == odd.columns


def dense(doc, item):
    """The most points of a stretch, faults at FAULT, cell by cell."""
    best, row = 0, [0] * (len(doc) + 1)
    for w in item:
        new = [0]
        for j, v in enumerate(doc, 1):
            new.append(max(0, row[j - 1] + (dc.FITS if v == w else dc.FAULT),
                           row[j] + dc.FAULT, new[j - 1] + dc.FAULT))
            best = max(best, new[j])
        row = new
    return best


def test_long_passages_and_short_items(spark):
    """Partial quotes of long items count, a few words of short ones do not."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    long = {1: rng.choice(vocabulary, 59).tolist(), 2: rng.choice(vocabulary, 1000).tolist()}
    short = {k: f"what is the {' '.join(f'k{k}x{i}' for i in range(k - 3))}".split() for k in range(3, 15)}
    noise = lambda n: rng.choice(vocabulary, n).tolist()
    docs = [noise(20) + long[1][10:35] + noise(20), noise(20) + long[2][300:700] + noise(5),
            noise(9) + long[2][5:17] + noise(9), noise(9) + long[2][5:18] + noise(9),
            ["what", "is", "the"] + noise(9), noise(100)]
    for gap in (5, 6, 9):
        docs.append([v if i % gap else "other" for i, v in enumerate(long[2][200:400])])
    for k, item in short.items():
        docs += [noise(5) + item[:n] + noise(5) for n in range(3, k + 1)]
    items = long | {100 + k: v for k, v in short.items()}
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(
        spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string"),
        spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string"),
    ).collect()}
    want = set()
    for i, doc in enumerate(docs):
        for k, item in items.items():
            full, score = dc.FITS * len(item), plain_align(doc, item)
            if score >= max(full / 2, min(0.9 * full, 14)) or score >= 26 and dense(doc, item) >= 26:
                want.add((i, k))
    assert got == want
    assert {(0, 1), (1, 2), (3, 2), (7, 2), (8, 2)} <= got and (2, 2) not in got
    assert {k for i, k in got if i == 4} == {103}
