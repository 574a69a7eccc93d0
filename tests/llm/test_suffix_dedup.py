import hashlib

import numpy as np
import pytest

from evigraph.llm import suffix_dedup, suffixes


def plain(rows, length=100):
    """n_bytes, n_removed, n_spans and checksum of each row, by a set of all windows."""
    seen, out = set(), []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            window = raw[p:p + length]
            if window in seen:
                gone[p:p + length] = True
            seen.add(window)
        runs = int((gone & ~np.append(False, gone[:-1])).sum()) if len(raw) else 0
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((doc_id, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                   for r in df.collect()), key=str)


def test_brute_force(documents, texts):
    assert rows_of(suffix_dedup.digests(documents)) == sorted(plain(sorted(texts.items())), key=str)


@pytest.mark.parametrize("hot", [1, 10_000])
def test_many_runs_and_parts(documents, texts, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 30_000)
    monkeypatch.setattr(suffix_dedup, "PART_WINDOWS", 2_000)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    assert rows_of(suffix_dedup.digests(documents)) == sorted(plain(sorted(texts.items())), key=str)


def test_shared_passages(spark):
    """Passages at all offsets, with equal and different surroundings, within texts too."""
    rng = np.random.default_rng(3)

    def noise(n):
        return "".join(rng.choice(list("abcdefgh "), n))

    passages = [noise(n) for n in (99, 100, 101, 130, 400)]
    rows = []
    for i in range(120):
        parts = [noise(int(rng.integers(0, 150)))]
        for p in rng.permutation(5)[:int(rng.integers(0, 4))]:
            parts += [passages[p], noise(int(rng.integers(0, 40)))]
        rows.append((i, "".join(parts)))
    rows += [(200, "x" * 700), (201, "xy" * 300), (202, "x" * 99), (203, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(suffix_dedup.digests(df)) == sorted(plain(rows), key=str)


def test_odd(odd, none):
    got = rows_of(suffix_dedup.digests(odd))
    assert len(got) == odd.count()
    # Repeated ids are ordered by a hash of the row; of equal rows the first stays whole.
    fox = sorted(r[2] for r in got if r[0] == 1)
    raw = ("The quick brown fox. " * 20)
    once = plain([(1, raw)])[0][2]
    assert fox == [0, once, len(raw)]
    assert suffix_dedup.digests(none).count() == 0
    kept = suffix_dedup.without_repeats(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {1, 4, 5, 6, 7, None}
    assert suffix_dedup.without_repeats(none).count() == 0


def test_family_levels_are_geometric():
    rng = np.random.default_rng(5)
    family, seen, repeated = suffix_dedup.Family(), {}, 0
    for run in range(40):
        rows = np.zeros(50, suffix_dedup.RECORD)
        rows["k"] = rng.integers(0, 600, 50)
        rows["s"], rows["d"], rows["p"], rows["n"] = rows["k"], run, np.arange(50), 1
        array, inside, contested = suffix_dedup.suffix_array(rows)
        again, more = family.add(array)
        repeated += len(inside) + len(again)
        assert not len(contested) and not len(more)
        for k in rows["k"]:
            seen[int(k)] = seen.get(int(k), 0) + 1
    sizes = [len(x) for x in family.levels]
    assert repeated == sum(n - 1 for n in seen.values())
    assert sum(sizes) == len(seen) and all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
    assert len(np.unique(np.concatenate([x["k"] for x in family.levels]))) == len(seen)


def test_equal_windows_pick_equal_suffixes():
    rng = np.random.default_rng(7)
    passage = rng.integers(97, 105, 100).astype(np.uint8)
    a = np.concatenate((rng.integers(97, 105, 57).astype(np.uint8), passage))
    b = np.concatenate((passage, rng.integers(97, 105, 33).astype(np.uint8)))

    def picks(data, at):
        k, _, _, p, n = suffixes.sampled(data, np.array([0, len(data)]))
        return {int(x) for x, q, m in zip(k, p, n) if q <= at < q + m}

    assert picks(a, 57) == picks(b, 0)
