import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from evigraph.llm import prefix_trie
from evigraph.llm.prefix_trie import DoubleArray, nodes

SCHEMA = "conv_id long, turn long, role string, text string, n int, part int, shard int, place int"


def brute(rows):
    """The contract read line by line, over dictionaries of prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role,
                              hashlib.md5(text.encode()).hexdigest(), text))
    for turns in own.values():
        turns.sort()
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        paths[c] = tuple((t[2], t[4]) for t in own.get(base, [])[:h] + own[c][h:])
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, path in paths.items():
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[:d - 1]].add(path[:d])
    out = []
    below = {p: [q for q in members if q[:len(p)] == p] for p in members}
    for p, convs in members.items():
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below[p] if q)
        leaves = sum(not children[q] for q in below[p])
        names = ",".join(map(str, sorted(ends[p])))
        out.append((min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs),
                    len(children[p]), leaves, saved, hashlib.sha256(names.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                    r.saved_tokens, r.ends_sha256) for r in df.collect()], key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1, 1) for r in rows], SCHEMA)


def odd_rows():
    random = np.random.default_rng(7)
    rows = []
    for c in [*range(-103, -95), 0, 100, 200, *range(1, 60), *range(101, 130), *range(205, 230)]:
        for t in range(int(random.integers(1, 9))):
            word = "hi" if t == 0 and c > 20 else f"w{random.integers(3)}"
            rows.append((c, t, ["user", "assistant"][t % 2], word))
    rows += [(1, 0, "user", "hi")] * 3 + [(2, None, None, None), (2, None, "user", None)]
    rows += [(None, 1, "user", "x"), (None, None, None, None), (300, 1, None, "🎉é"), (301, 1, "", "🎉é")]
    rows += [(c, t, "user", "same") for c in range(400, 440) for t in range(9)]   # copies
    rows += [(500 + c, t, "user", f"{t if t < 17 else c}") for c in range(12) for t in range(19)]
    return rows


@pytest.mark.parametrize("segment, shard_turns", [(4096, 1 << 15), (7, 12)])
def test_odd_rows(spark, segment, shard_turns):
    rows = odd_rows()
    found = nodes(frame(spark, rows), segment, shard_turns, rows_per_block=37)
    assert rows_of(found) == brute(rows)


def test_empty_and_turnless(spark):
    assert nodes(frame(spark, [(1, 1, "a", "b")]).limit(0)).collect() == []
    assert nodes(frame(spark, [(None, 1, "a", "b")])).collect() == []
    # More turns to skip than there are, and no conversation to take them from.
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 0)
    assert rows_of(nodes(frame(spark, [(c, 1, "a", "b")]))) == brute([(c, 1, "a", "b")])


def test_long_conversation(spark):
    rows = [(0, t, "user", str(t % 7)) for t in range(9000)]
    rows += [(100, t, "user", str(t % 7)) for t in range(8500)] + [(100, 9999, "user", "end")]
    found = rows_of(nodes(frame(spark, rows), 4500, 3000, rows_per_block=2000))
    by_depth = {(r[0], r[1]): r for r in found}
    shared = 8500
    assert len(found) == 9000 + 1 + 1
    assert by_depth[0, shared][3:6] == (2, 2, 2) and by_depth[100, shared + 1][2] == 0
    assert by_depth[0, 0][3:7] == (2, 1, 2, shared) and by_depth[0, 4000][6] == shared - 3999


def test_double_array():
    """Every path is found, no other one is, and the arrays are near full."""
    random = np.random.default_rng(1)
    seqs = sorted({tuple(random.integers(0, 50, random.integers(1, 7)).tolist())
                   for _ in range(500)} | {(3,) * 40, (9, 1)})
    starts = np.cumsum([0, *map(len, seqs)])
    turns = np.array([t for s in seqs for t in s])
    trie = DoubleArray(turns, starts, 60)
    prefixes = {s[:d] for s in seqs for d in range(1, len(s) + 1)}
    places = {(): 0}
    for p in sorted(prefixes, key=len):
        at = int(trie.step(np.array([places[p[:-1]]]), np.array([p[-1]]))[0])
        assert at > 0 and trie.check[at] == places[p[:-1]]
        places[p] = at
    assert len(set(places.values())) == len(prefixes) + 1
    for p in list(prefixes)[:200]:
        for t in range(60):
            found = int(trie.step(np.array([places[p]]), np.array([t]))[0])
            assert found == places.get((*p, t), -1)
    assert trie.end < 1.3 * len(places)


def test_packed(spark, sf):
    """A conversation can be looked up in the stored arrays."""
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    turns, _ = prefix_trie.rebuilt(table)
    tries = prefix_trie.packed(table).collect()
    seqs = defaultdict(list)
    for r in turns.orderBy("conv_id", "place").collect():
        seqs[r.conv_id].append((r.a, r.b))
    for seq in seqs.values():
        hits = 0
        for trie in tries:
            codes = {k: i for i, k in enumerate(zip(trie.code_a, trie.code_b))}
            node = 0
            for key in [(0, 0), *seq]:
                code = codes.get(key)
                child = None if code is None else trie.base[node] + code
                if child is None or child >= len(trie.check) or trie.check[child] != node:
                    break
                node = child
            else:
                hits += 1
        assert hits == 1
