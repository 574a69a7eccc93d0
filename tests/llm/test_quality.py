import re
import zlib
from collections import Counter

import numpy as np

from evigraph.llm import quality_classifier, quality_rules


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in quality_classifier.scored(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(rows[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d in rows)
    assert np.mean([rows[d].predicted == truth[d] for d in held]) > 0.97
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows.values())


def test_held_out_labels_are_never_learned(spark, documents, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = quality_classifier.held_out(labels["doc_id"])
    from pyspark.sql import functions as F
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    features = quality_classifier.measured(documents)
    a, b = (quality_classifier.fit(features, x) for x in (labels, turned))
    assert np.allclose(a.means, b.means) and np.allclose(a.whiten, b.whiten)


def test_density_difference():
    """Scores against densities computed without a Cholesky factor."""
    rng = np.random.default_rng(0)
    d = len(quality_classifier.FEATURES)
    cov = [np.cov(rng.normal(size=(d, 40)) * (k + 1)) + np.eye(d) for k in (0, 1)]
    means = rng.normal(size=(2, d))
    factors = [np.linalg.cholesky(c) for c in cov]
    model = quality_classifier.Discriminant(
        means, np.array([np.linalg.inv(f) for f in factors]),
        np.array([np.log(np.diag(f)).sum() for f in factors]), np.log([0.3, 0.7]))
    x = rng.normal(size=(50, d))
    logs = [np.log(p) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum(
        "ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) for p, c, m in zip((0.3, 0.7), cov, means)]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_classifier_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (3, None, 0), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    rows = quality_classifier.scored(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_classifier.scored(none, labels).count() == 0
    empty = labels.limit(0)
    assert {r.score for r in quality_classifier.scored(odd, empty).collect()} == {0.5}
    model = quality_classifier.fit(quality_classifier.measured(odd), labels)
    kept = quality_classifier.accepted(odd, model)
    assert kept.columns == odd.columns
    assert kept.count() == sum(r.score >= 0.3 for r in rows)


def plain_rules(rows, limit, left):
    """The rules one document after the other."""
    space = " \t\n\x0b\x0c\r"
    found = Counter()
    plain = []
    for _, text, host in rows:
        lines = {x.lower().strip(space) for x in (text or "").split("\n")} - {""}
        plain.append(lines)
        found.update((host, x) for x in lines)
    out = []
    for (doc_id, text, host), lines in zip(rows, plain):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
        covered = {i + j for i in range(len(words) - 2) for j in range(3)
                   if windows[tuple(words[i:i + 3])] > 1}
        solid = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = {x: len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines}
        gone = sum(n[x] for x in lines if found[host, x] > limit)
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        out.append((doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
                    len(solid) - len(set(solid)), len(covered), gone, failed,
                    not failed and sum(n.values()) - gone >= left * sum(n.values())))
    return sorted(out, key=str)


def got_rules(df):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                    r.n_removed_words, r.base_failed, r.kept) for r in df.collect()), key=str)


def test_rules_brute_force(documents):
    rows = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    assert got_rules(quality_rules.verdicts(documents, max_documents=2, min_left=0.5)) == \
        plain_rules(rows, 2, 0.5)


def test_rules_odd(odd, none):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert got_rules(quality_rules.verdicts(odd, max_documents=1)) == plain_rules(
        rows, 1, quality_rules.MIN_LEFT)
    assert quality_rules.verdicts(none).count() == 0


def test_lines_are_taken_out(spark):
    rows = [(i, f"common line\nown line {i}\n", "h") for i in range(5)] + [(9, "common line", "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r.text for r in quality_rules.without_common_lines(df, max_documents=3).collect()}
    assert out[0] == "own line 0\n" and out[9] == "common line"
    hot = quality_rules.verdicts(df, max_documents=3)
    assert {r.doc_id: r.n_removed_words for r in hot.collect()}[0] == 2


def test_rules_are_native(documents):
    plan = quality_rules.verdicts(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
