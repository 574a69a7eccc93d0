import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from evigraph.llm import components, simhash


def plain_fingerprint(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=3):
    """Least id of each row's component; fps is a list of (id, fingerprint)."""
    root = list(range(len(fps)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    f = np.array([v for _, v in fps], np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1:] ^ f[i]) <= radius):
            a, b = top(i), top(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    groups = {}
    for i, (d, _) in enumerate(fps):
        groups.setdefault(top(i), []).append(d)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return [least[top(i)] for i in range(len(fps))]


def compare(df, rows):
    fps = [(d, plain_fingerprint(t)) for d, t in rows]
    want = sorted(((d, f"{v:016x}", c) for (d, v), c in zip(fps, plain_components(fps))), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str) == want


def test_brute_force(documents, texts):
    compare(simhash.near_duplicates(documents), list(texts.items()))


def test_odd(odd, none):
    compare(simhash.near_duplicates(odd), [(r.doc_id, r.text) for r in odd.collect()])
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    # Zero fingerprints, each of the texts of id 1, the long pair, the id-less text, id 7.
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "2", "5", "7", "None"]


def test_hot_shard_is_split(spark):
    """A cluster of fingerprints in one shard, cut into several trees, is one component."""
    rng = np.random.default_rng(1)
    base, values = int(rng.integers(0, 1 << 63)), set()
    value = base
    for _ in range(600):
        value ^= 1 << int(rng.integers(0, 64))
        values.add(value)
    far = [int(x) for x in rng.integers(0, 1 << 63, 300)]
    fps = [(i, v) for i, v in enumerate([*values, *far])]
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for _, v in fps], "fp long")
    links = simhash.links(df, tree=50)
    assert links.count() < 40 * len(fps)
    roots = {r.node: r.root for r in components.components(links).collect()}
    signed = [v - (1 << 64) if v >> 63 else v for _, v in fps]
    got = [roots.get(v, v) for v in signed]
    want = plain_components(fps)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=40), st.integers(0, 20))
@settings(max_examples=100, deadline=None)
def test_tree_finds_all(values, radius):
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:5]:
        found = sorted(tree.nodes[i] for i in tree.within(q, radius))
        assert found == sorted(v for v in values if (v ^ q).bit_count() <= radius)


def test_keys_cover_the_radius():
    keys = simhash.shard_keys()
    rng = np.random.default_rng(2)
    for _ in range(2000):
        flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not flips & k for k in keys)


def test_chain_of_links(spark):
    n = 300
    df = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {r.root for r in components.components(df).collect()} == {0}
