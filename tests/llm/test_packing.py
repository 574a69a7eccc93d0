import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evigraph.llm import packing
from evigraph.llm.queries import tokenizer_file
from evigraph.llm.tokens import WordTokenizer


@pytest.fixture(scope="module")
def words():
    return WordTokenizer(tokenizer_file())


def test_ids_are_the_tokenizers(words, texts):
    odd = ["Don't stop: WE'LL go, it's 12³!", "Σας ΣΑΣ", "İstanbul", "a\x85b\x1cc", "x<|endoftext|>y",
           "a<|startoftext|>", "ﬁ ŉ é", "", "\n\t ", "'s'T 'Re", "_a-b_", "日本語 text"]
    for text in [*texts.values(), *odd]:
        assert words(text) == words.encode_whole(text), text[:50]


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_any_text(text):
    words = WORDS or WORDS_INIT()
    assert words(text) == words.encode_whole(text)


WORDS = None


def WORDS_INIT():
    global WORDS
    WORDS = WordTokenizer(tokenizer_file())
    return WORDS


@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=4), st.integers(0, 14))
@settings(max_examples=200, deadline=None)
def test_fullest_is_best(counts, room):
    chosen = packing.fullest(counts, room)
    assert all(n <= counts[k] for k, n in chosen.items())
    best = max(s for s in (sum(k * n for k, n in zip(counts, c)) for c in product(
        *[range(n + 1) for n in counts.values()])) if s <= room)
    assert sum(k * n for k, n in chosen.items()) == best


def check(df, rows, capacity):
    tk = Tokenizer.from_file(tokenizer_file())
    ids = Counter()
    for doc_id, text in rows:
        whole = np.array(tk.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        for at in range(0, len(whole), capacity):
            piece = whole[at:at + capacity]
            ids[doc_id, at, len(piece), zlib.crc32(piece.tobytes()), len(whole)] += 1
    got = df.toPandas()
    none = got.doc_id.isna()
    assert Counter((None if m else int(d), int(a), int(b), int(c), int(e)) for m, d, a, b, c, e in zip(
        none, got.doc_id, got.start, got.length, got.ids_crc32, got.doc_tokens)) == ids
    fills = []
    for _, g in got.groupby("sequence_id"):
        at = 0
        for r in g.sort_values("offset").itertuples():
            assert r.offset == at
            at += r.length
        assert at <= capacity
        fills.append(at)
    return fills


def test_brute_force(documents, texts):
    fills = check(packing.pack(documents, tokenizer_file()), texts.items(), 4096)
    assert sum(fills) / (4096 * len(fills)) > 0.97
    assert sum(f < 4090 for f in fills) <= 1


def test_small_capacity(documents, texts):
    check(packing.pack(documents, tokenizer_file(), capacity=64), texts.items(), 64)


def test_odd(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check(packing.pack(odd, tokenizer_file()), rows, 4096)
    assert packing.pack(none, tokenizer_file()).count() == 0


def test_many_equal_lengths():
    places = packing.plan({10: 1_000_000, 5: 7}, 64)
    assert len(places) < 20
    assert sum(m * t for _, _, m, t, _, _ in places) == 1_000_007
