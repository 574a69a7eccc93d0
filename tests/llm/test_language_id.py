import zlib

import numpy as np

from evigraph.llm import language_id


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = {r.doc_id: r for r in language_id.predicted(docs).collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(rows[d].held_out for d in held)
    assert np.mean([rows[d].lang_pred == truth[d] for d in held]) > 0.97


def test_counts_are_complete(documents):
    from collections import Counter
    want = Counter()
    for r in documents.collect():
        for w in language_id.LETTERS.findall(r.text.lower()):
            want[r.lang, w] += 1
    counts = language_id.word_counts(documents)
    assert {(r.lang, r.word): r.n for r in counts.collect()} == dict(want)


def test_backoff():
    model = language_id.Model(
        ["x", "y"], {"x": 100, "y": 100}, {"known": {"x": 5}},
        {"nown": {"y": 5}, "abc": {"y": 3}, "z": {"x": 9}})
    assert model.predict("known")[0] == "x"       # the word itself goes first
    assert model.predict("unown")[0] == "y"       # then its longest known n-grams
    assert model.predict("abcq")[0] == "y"
    assert model.predict("qz")[0] == "x"
    assert model.predict("12 ² !") == ("und", 0.0)


def test_odd(odd, none):
    rows = {(r.doc_id, r.lang_pred) for r in language_id.predicted(odd).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (None, "und")} <= rows
    assert language_id.predicted(odd).count() == odd.count()
    assert language_id.predicted(none).count() == 0


def plain_model(docs):
    """The model of all words and n-grams, counted in one process."""
    from collections import Counter
    words, grams = {}, {}
    for r in docs.collect():
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            for w in language_id.LETTERS.findall(r.text.lower()):
                words.setdefault(w, Counter())[r.lang] += 1
                for g in language_id.grams(w):
                    grams.setdefault(g, Counter())[r.lang] += 1
    sizes = sum(words.values(), Counter())
    return language_id.Model(sorted(sizes), dict(sizes), words, grams)


def check_against_plain(docs, **kept):
    model = plain_model(docs)
    want = sorted((str(r.doc_id), *model.predict(r.text)) for r in docs.collect())
    got = sorted((str(r.doc_id), r.lang_pred, r.score) for r in language_id.predicted(docs, **kept).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-9)


def test_words_beyond_the_model_count_in_full(documents):
    """Few or no words at hand in the tasks, and all of them, give the answers of all counts."""
    for kept in (0, 300, 10**6):
        check_against_plain(documents, words_kept=kept)


def test_ties_at_the_limit(spark):
    """A language of 25,000 words that all occur once is known as well as one of 100."""
    rng = np.random.default_rng(3)
    made = ["".join(rng.choice(list("abcdefghij"), 8)) for _ in range(27_000)]
    tail, other = list(dict.fromkeys(made))[:25_000], [f"k{x}" for x in made[-100:]]
    learn = [i for i in range(1, 400) if zlib.crc32(str(i).encode()) % 5]
    held = [i for i in range(1, 400) if not zlib.crc32(str(i).encode()) % 5]
    rows = [(d, " ".join(tail[k * 125:(k + 1) * 125]), "rich") for k, d in enumerate(learn[:200])]
    rows += [(d, " ".join(other) + " " + " ".join(x[::-1] for x in tail[k::200]), "poor") for k, d in enumerate(learn[200:])]
    rows += [(d, " ".join(rng.choice(tail, 5)), "rich") for d in held]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.predicted(docs).collect()}
    assert np.mean([got[d] == "rich" for d in held]) > 0.97
    check_against_plain(docs)
