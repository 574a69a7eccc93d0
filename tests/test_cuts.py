"""No rule changes at a size: lists, lengths, depths and names beyond the former limits."""

from pyspark.sql import functions as F

from evigraph.functions import taxonomy as tax
from evigraph.functions import text as tx
from evigraph.operators import edge_validation as ev
from evigraph.operators import linkage as ln
from evigraph.operators import traversal as tr
from evigraph.sources import dumps, files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_topics_match_in_one_piece(spark):
    none = F.array().cast("array<string>")
    found = one(spark, tax.auto_topics(none, F.lit("a theory of justice"), none))
    assert sorted(found) == ["Justice", "Theory"]


def test_letters_without_decomposition(spark):
    for name in ["Jǿrgen", "Jørgen", "JØRGEN"]:
        assert one(spark, tx.person_key(F.lit(name))) == "jorgen"
    assert one(spark, tx.person_key(F.lit("Ǽlfric"))) == "aelfric"
    assert one(spark, tx.text_key(F.lit("𝐀da 𝟙"))) == "ada 1"


def test_long_slugs_stay_apart(spark):
    a, b = (one(spark, tx.slug(F.lit("long title " * 9 + end))) for end in ("one", "two"))
    assert a != b and a[:80] == b[:80]
    assert one(spark, tx.slug(F.lit("x" * 80))) == "x" * 80


def test_long_paths(spark):
    n = 66
    edges = spark.createDataFrame([(str(i), str(i + 1), i) for i in range(n)],
                                  "source string, target string, ord long")
    people = spark.createDataFrame([(str(i),) for i in range(n + 1)], "id string")
    start, goal = (spark.createDataFrame([(str(i),)], "id string") for i in (0, n))
    path = tr.shortest_path(edges, people, start, goal)
    assert [r.id for r in path.orderBy("step").collect()] == [str(i) for i in range(n + 1)]


def test_long_reference_lists(spark):
    refs = [f"https://x.example.org/W{i}" for i in range(21)]
    dump = spark.createDataFrame([("https://x.example.org/W99", "Name", None, None, refs)],
                                 "id string, display_name string, title string, doi string, "
                                 "referenced_works array<string>")
    assert dumps.citations(dump).count() == 21
    assert dumps.citations(dump, 20).count() == 20


def test_equal_names_keep_their_rows(spark):
    raw = spark.createDataFrame([("Ann Lee", "1800"), ("Ann Lee", "1850")], "name string, birth string")
    assert files.csv_candidates(raw).select("id").distinct().count() == 2
    lines = spark.createDataFrame([("Ann Lee|1800||Logic",), ("Ann Lee|1850||Logic",)], "value string")
    assert files.pipe_candidates(lines).select("id").distinct().count() == 2


def test_joined_spelling_is_known(spark):
    people = spark.createDataFrame([("p1", "Ibn Sina")], "id string, name string")
    rows = [("c1", 1, "IbnSina", 980), ("c2", 2, "Al Razi", 854), ("c3", 3, "AlRazi", 854)]
    found = ln.accept_queue(spark.createDataFrame(rows, "id string, ord int, name string, birth int"), people)
    assert [r.id for r in found.collect()] == ["c2"]


def test_reports_round_trip(spark, tmp_path):
    report = spark.createDataFrame([("e1", "missing-target"), ("e2", None)], "id string, flag string")
    files.write_json({"report": report}, str(tmp_path))
    back = spark.read.schema(report.schema).json(f"{tmp_path}/report")
    assert sorted(map(tuple, back.collect())) == [("e1", "missing-target"), ("e2", None)]


def test_repeated_ids_count_once(spark):
    from tests.fixtures import claims, edges, people

    folk = people(spark, {"id": "a", "birth": 1800}, {"id": "a", "birth": 1810}, {"id": "b", "birth": 1820})
    links = edges(spark, {"source": "a", "target": "b", "claim_ids": ["k"]})
    assert ev.structure(folk, links).count() == 1
    twice = claims(spark, {"id": "k"}, {"id": "k"})
    support = ev.claim_support(links, twice, F.lit("2026-01-01").cast("timestamp")).collect()
    assert [r.n_attached for r in support] == [1]
