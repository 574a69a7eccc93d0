import corpus_pipeline
from evigraph.llm import decontamination, quality_classifier, simhash, suffix_dedup
from evigraph.llm.common import stored
from tests.llm.test_packing import check
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_suffix_dedup import plain


def test_stages(spark, documents, sf):
    """Each stage against its own definition, on what the one before kept."""
    docs, columns = documents, documents.columns
    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{sf}/labels.parquet")

    out = stored(stages["quality classifier"](spark, docs, sf))
    scores = {r.doc_id: r.score for r in quality_classifier.scored(docs, labels).collect()}
    assert {r.doc_id for r in out.collect()} == {d for d, s in scores.items() if s >= 0.3}
    rejected = {r.doc_id for r in labels.where("quality = 0").collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    left = {r.doc_id for r in out.collect()}
    assert len(left & rejected) <= 0.1 * len(rejected) and len(good - left) <= 0.03 * len(good)

    docs = out
    out = stored(stages["SimHash near-dedup"](spark, docs, sf))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    roots = plain_components([(d, plain_fingerprint(t)) for d, t in rows])
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(roots))

    docs = out
    out = stored(stages["suffix-array dedup"](spark, docs, sf))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    cut = {d: n for d, _, n, *_ in plain(rows)}
    sizes = {r.doc_id: len(r.text.encode()) for r in out.collect()}
    for d, text in rows:
        assert 0 <= len(text.encode()) - cut[d] - sizes.get(d, 0) <= 6 * (cut[d] > 0)

    docs = out
    out = stored(stages["benchmark decontamination"](spark, docs, sf))
    leaks = {r.doc_id for r in decontamination.contaminated(
        docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - leaks
    assert out.columns == columns

    check(stages["packing"](spark, out, sf), [(r.doc_id, r.text) for r in out.collect()], 4096)


def test_odd_documents(spark, odd, none, sf):
    odd, none = (x.withColumn("n_chars", x["n"].cast("long")) for x in (odd, none))
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, sf))
            if name != "packing":
                assert docs.columns == odd.columns
