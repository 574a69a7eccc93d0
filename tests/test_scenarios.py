"""Small scenarios with known outcomes."""

import datetime as dt

from pyspark.sql import functions as F

from evigraph.functions import text as tx
from evigraph.operators import canonical as cn
from evigraph.operators import edge_validation as ev
from evigraph.operators import entities as en
from evigraph.operators import evidence_policy as policy
from evigraph.operators import graph_quality as gq
from evigraph.operators import linkage as ln
from evigraph.operators import missing_edges as me
from evigraph.operators import relationship_candidates as rc
from evigraph.operators import suggestions as sg
from evigraph.operators import threads as th
from evigraph.sources import dumps, files
from tests.fixtures import LINKS, claims, edges, people, table, threads

def now():
    return F.to_timestamp(F.lit("2026-06-05 00:00:00"))


def test_metrics(spark):
    folk = people(spark, {"id": "a"}, {"id": "b"}, {"id": "c", "name": "Same"},
                  {"id": "d", "name": "Same"}, {"id": "e"})
    links = edges(spark, {"source": "a", "target": "b", "confidence": 0.8, "status": "accepted",
                          "source_claims": ["u"]},
                  {"source": "b", "target": "e", "confidence": 0.4, "status": "suggested"})
    seen = claims(spark, {"id": "k", "observed_at": dt.datetime(2026, 6, 1)})
    rows = gq.metrics(folk, links, seen, threads(spark, {"id": "t", "people": ["a", "b"]}), now())
    assert {r.metric: r.value for r in rows.collect()} == {
        "sourced_edge_percentage": 0.5, "accepted_edge_percentage": 0.5,
        "average_edge_confidence": 0.6, "isolated_node_count": 2.0, "duplicate_risk_count": 2.0,
        "average_source_freshness_days": 4.0, "canonical_thread_coverage": 0.4}


def test_audit_finds_every_code(spark):
    folk = people(
        spark, {"id": "a", "name": "X", "bridge_score": 5, "death": 1700, "works": [],
                "region": None, "fields": ["Philosophy"], "subfields": []},
        {"id": "b", "name": "X"})
    links = edges(spark, {"source": "b", "target": "ghost"})
    old = claims(spark, {"id": "k", "observed_at": dt.datetime(2000, 1, 1)})
    found = gq.audit(folk, links, old, now()).select("code").distinct().collect()
    assert {r.code for r in found} == set(gq.FINDINGS)


def test_existing_edge_scores(spark):
    folk = people(spark, {"id": "a"}, {"id": "b"})
    links = edges(spark, {"id": "e", "source": "a", "target": "b", "confidence": 0.91,
                          "status": "accepted", "claim_ids": ["k"]})
    backing = claims(spark, {"id": "k", "observed_at": dt.datetime(2026, 1, 1)})
    row = ev.relationship_rules(folk, links, backing, now()).collect()[0]
    assert (row.confidence_score, row.final_disposition) == (0.955, "confirmed-existing-edge")
    assert ev.acceptance_gate(ev.relationship_rules(folk, links, backing, now())).collect()[0].passed


def test_candidate_promotion(spark):
    folk = people(spark, {"id": "a"}, {"id": "b"})
    found = edges(spark, {"id": "candidate:1", "source": "a", "target": "b", "confidence": 0.9,
                          "status": "suggested", "claim_ids": ["k"]})
    backing = claims(spark, {"id": "k", "observed_at": dt.datetime(2026, 1, 1)})
    checked = ev.validate_candidates(folk, found, backing, now())
    assert checked.collect()[0].confidence_score == 0.95
    out = ev.promote(edges(spark).limit(0), checked).collect()[0]
    assert (out.id, out.status, out.note) == ("edge:1", "accepted",
                                              "Added by bulk edge validation.")


def test_person_linkage_score(spark):
    schema = ("id string, ord long, name string, alternate_names array<string>, birth int, "
              "death int, external_ids map<string,array<string>>, fields array<string>, "
              "occupations array<string>, works array<string>, institutions array<string>, "
              "movements array<string>")
    row = ("Hannah Arendt", ["H. Arendt"], 1906, 1975, {"viaf": ["1"], "loc": ["2"]}, ["P"],
           ["writer"], ["Vita Activa"], ["New School"], ["Existentialism"])
    left = spark.createDataFrame([("q", 0, *row)], schema)
    right = spark.createDataFrame([("p", 0, *row)], schema)
    out = ln.person_linkage(left, right).collect()[0]
    # Name, birth, death, two ids and five single context hits, capped at one.
    assert out.score == 1.0 and len(out.reasons) == 9 and out.decision == "auto-merge"


def test_work_linkage_needs_identifier(spark):
    schema = ("id string, ord long, title string, translated_titles array<string>, "
              "author_ids array<string>, author_names array<string>, date int, "
              "identifiers struct<doi:string,isbn:string,openalex:string,wikidata:string>")
    ids = ("https://doi.org/10.1/K", "978", None, None)
    left = spark.createDataFrame([("c", 0, "Kritik", ["Critique"], ["p"], None, 1781, ids)], schema)
    right = spark.createDataFrame(
        [("e", 0, "Critique", None, ["p"], None, 1781, ("10.1/k", "978", None, None))], schema)
    out = ln.work_linkage(left, right).collect()[0]
    assert out.score == 1.0 and out.reasons == ["doi", "isbn", "title", "author", "date"]


CANDIDATES = ("id string, ord long, name string, aliases array<string>, birth int, death int, "
              "works array<string>, source_url string, wikipedia_url string")


def test_first_duplicate(spark):
    folk = people(
        spark, {"id": "sina", "name": "Avicenna (Ibn Sina)", "birth": 980, "death": 1037},
        {"id": "noted", "name": "N", "birth": 1, "death": 2,
         "notes": "see https://x.org/wiki/Q12 for more"},
        {"id": "near", "name": "M", "birth": 1500, "death": 1560, "works": ["Opus One"]})
    rows = [("c1", 0, "Ibn Sina", None, None, None, None, "u", None),
            ("c2", 1, "Z", ["ibn-sina"], None, None, None, "u", None),
            ("c3", 2, "Y", None, None, None, None, "https://x.org/wiki/Q1", None),
            ("c4", 3, "W", None, 1501, 1561, None, "u", None),
            ("c5", 4, "V", None, 1501, 1573, ["opus one"], "u", None),
            ("c6", 5, "U", None, 1501, 1573, None, "u", None),
            ("c7", 6, "T", None, None, None, None, "for more", None)]
    out = ln.first_duplicate(spark.createDataFrame(rows, CANDIDATES), folk).collect()
    # The text "u" is part of no note, and a url matches as a plain substring.
    assert {r.candidate_id: r.duplicate_id for r in out} == {
        "c1": "sina", "c2": "sina", "c3": "noted", "c4": "near", "c5": "near", "c7": "noted"}


def test_conservative_match(spark):
    folk = people(spark, {"id": "curie", "name": "Maria Sklodowska", "birth": 1867},
                  {"id": "feynman", "name": "Richard Feynman", "birth": 1918},
                  {"id": "kenneth", "name": "Kenneth Wilson", "birth": 1936})
    rows = [("1", "Maria Skłodowska", 1867), ("2", "Richard P. Feynman", 1918),
            ("3", "Robert Wilson", 1936)]
    wanted = spark.createDataFrame(rows, "id string, name string, birth int")
    out = {r.id: r.person_id for r in ln.conservative_match(wanted, folk).collect()}
    assert out == {"1": "curie", "2": "feynman", "3": None}


def test_confidence_and_thresholds(spark):
    names = list(policy.CONFIDENCE_WEIGHTS)
    values = dict(zip(names, [1.0, 0.8, 0.7, 0.6, 0.9, 0.5]))
    df = spark.range(1).select(
        policy.composed_confidence({k: F.lit(v) for k, v in values.items()}).alias("c"),
        F.lit("relationship").alias("kind"), F.lit(True).alias("on"))
    strict = policy.thresholds(F.col("kind"), strict={m: "on" for m in [
        "direct_influence", "canonical_thread_edge", "cross_century_jump",
        "high_bridge_score_node", "disputed_or_sparse_topic"]})
    row = df.select("c", strict[0].alias("a"), strict[1].alias("p")).collect()[0]
    assert (row.c, row.a, row.p) == (0.755, 0.99, 0.75)


def links(spark, *rows):
    return table(spark, LINKS, [dict(zip(["person_id", "ord", "kind", "value", "section"], r))
                                for r in rows])


def test_collaboration_channels_fold_into_one_pair(spark):
    rows = [("a", 0, "coauthor", "b", None), ("a", 0, "correspondent", "b", None),
            ("a", 0, "institution", "I", None), ("b", 1, "institution", "I", None),
            ("a", 0, "work", "W", None), ("b", 1, "work", "W", None)]
    out = rc.collaboration(links(spark, *rows)).filter("row_kind = 'pair'").collect()
    assert [(r.source_id, r.target_id, r.confidence) for r in out] == [
        ("person:a", "person:b", 0.95)]
    chosen = spark.createDataFrame([("a",)], "id string")
    only = rc.collaboration(links(spark, *rows[2:4]), chosen).collect()[0]
    assert only.confidence == 0.6


def test_influence_channels(spark):
    kinds = ["explicit_influence", "citation_target", "named_mention", "advisor",
             "received_work"]
    rows = [("b", 1, k, "a", None) for k in kinds] + [
        ("a", 0, "movement", "M", None), ("b", 1, "movement", "M", None)]
    folk = people(spark, {"id": "a", "birth": 1800}, {"id": "b", "birth": 1830})
    out = rc.influence(links(spark, *rows), folk).filter("row_kind = 'pair'").collect()
    assert [(r.source_id, r.target_id, r.evidence) for r in out] == [("person:a", "person:b", 7)]


def test_equal_births_influence_both_ways(spark):
    rows = [("a", 0, "movement", "M", None), ("b", 1, "movement", "M", None)]
    folk = people(spark, {"id": "a"}, {"id": "b"})
    chosen = spark.createDataFrame([("a",)], "id string")
    out = rc.influence(links(spark, *rows), folk, chosen).collect()
    assert {(r.source_id, r.confidence) for r in out} == {("person:a", 0.5), ("person:b", 0.5)}


def test_missing_edge_channels(spark):
    folk = people(spark, {"id": "a", "influenced": ["b"], "movement": "M", "region": None},
                  {"id": "b", "birth": 1810, "region": None},
                  {"id": "c", "birth": 1820, "movement": "M", "region": None})
    existing = edges(spark, {"source": "a", "target": "b"})
    seen = claims(
        spark, {"id": "k1", "subject_id": "relationship:person:b:Influence:person:c"},
        {"id": "k2", "subject_type": "Person", "subject_id": "person:c", "field": "advisor",
         "value": "person:b"},
        {"id": "k3", "subject_type": "Person", "subject_id": "person:a", "field": "coauthor",
         "value": "person:c"})
    paths = threads(spark, {"id": "t", "people": ["a", "c"]})
    found = me.discover(folk, existing, seen, paths).collect()
    got = sorted(f"{r.source}->{r.target}:{r.type}" for r in found)
    assert got == ["a->c:Collaboration", "a->c:Source-context neighbor", "b->c:Influence",
                   "b->c:Mentorship"]
    neighbor = [r for r in found if r.type == me.NEIGHBOR][0]
    # The thread row (.82) follows the shared movement (.42).
    assert neighbor.confidence == 0.85


def test_candidate_merge(spark):
    rows = edges(spark, {"source": "a", "target": "b", "type": "Collaboration",
                         "confidence": 0.7, "claim_ids": ["one"], "note": "n1"},
                 {"source": "b", "target": "a", "type": "Collaboration", "confidence": 0.8,
                  "claim_ids": ["two"], "note": "n2"},
                 {"source": "a", "target": "c"})
    out = me.deduplicate(rows, edges(spark, {"source": "a", "target": "c"})).collect()
    assert [(r.source, r.target, r.confidence, r.n_claims) for r in out] == [("a", "b", 0.83, 2)]


def test_thread_junctions_and_convergence(spark):
    paths = threads(
        spark, {"id": "1", "people": ["b", "a", "c"]}, {"id": "2", "people": ["e", "a", "d"]},
        {"id": "3", "people": ["a", "f"]}, {"id": "4", "people": ["a", "g"]},
        {"id": "5", "people": ["f", "d"]})
    out = {r.entity_id: (r.kind, r.incoming, r.outgoing) for r in th.junctions(paths).collect()}
    assert out == {"a": ("both", 2, 4), "d": ("convergence", 2, 1)} or out == {
        "a": ("both", 2, 4), "d": ("convergence", 2, 0)}
    logic = threads(spark, {"id": "logic", "people": ["boole", "turing"]},
                    {"id": "math", "people": ["hilbert", "turing"]})
    row = th.convergence(logic).collect()[0]
    assert (row.entity_id, row.incoming, row.threads) == ("turing", 2, 2)


def test_metadata_edges(spark):
    folk = people(spark, {"id": "a", "influenced": ["a", "b", "ghost", "c"]},
                  {"id": "b", "name": "Ada Byron"}, {"id": "c"})
    out = en.metadata_edges(folk, edges(spark, {"source": "a", "target": "c"})).collect()
    assert [(r.source, r.target, r.strength, r.confidence, r.source_claims) for r in out] == [
        ("a", "b", 3, 0.85, ["https://en.wikipedia.org/wiki/Ada_Byron"])]


def test_changelog_counts(spark):
    before = claims(spark, {"id": "1"}, {"id": "2"}, {"id": "3"}, {"id": "4"}, {"id": "5"})
    after = claims(spark, {"id": "1"}, {"id": "2", "value": "new"},
                   {"id": "3", "status": "candidate"}, {"id": "4", "status": "rejected"},
                   {"id": "5", "status": "conflicting"}, {"id": "6"})
    out = cn.claim_changelog(before, after).groupBy("change").count().collect()
    assert {r.change: r["count"] for r in out} == {
        "added": 1, "changed": 1, "demoted": 1, "rejected": 1, "conflicting": 1}


def test_roster_html(spark):
    html = ('<section>The Fields Medalists, chronologically listed'
            '<div class="list__group"><h3>2006</h3><ul><li class="blue-link">'
            '<a href="x">Grigori <b>Perelman</b>*</a></li></ul></div>'
            '<div class="list__group"><h3>2022</h3><ul><li class="blue-link">'
            '<a href="y">Maryna Viazovska</a></li></ul></div></section>')
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    out = dumps.roster_items(pages, **dumps.MEDAL_ROSTER).orderBy("g").collect()
    assert [(r.name, r.year, r.status) for r in out] == [
        ("Grigori Perelman", 2006, "declined"), ("Maryna Viazovska", 2022, "received")]


def test_files_round_trip(spark, tmp_path):
    folk = people(spark, {"id": "a", "name": 'Ann "A", x', "notes": "two\nlines"}, {"id": "b"})
    files.write_people_csv(folk.coalesce(1), str(tmp_path / "csv"))
    back = files.read_people_csv(spark, str(tmp_path / "csv"))
    assert {r.name for r in back.collect()} == {'Ann "A", x', "b"}
    bundle = tmp_path / "state.json"
    bundle.write_text('{"version": 8, "people": [{"id": "a", "name": "A", "birth": 1, "death": '
                      'null, "fields": ["Logic"]}, {"id": "x"}], "edges": [{"source": "a", '
                      '"target": "a", "type": "Influence", "strength": 2}]}')
    tables = files.read_state_bundle(spark, str(bundle))
    assert tables["people"].count() == 1 and tables["people_rejects"].count() == 1
    assert tables["edges"].collect()[0].status == "needs_source"
    files.write_state({k: tables[k] for k in ["people", "edges"]}, str(tmp_path / "out"), 8, now())
    assert files.read_state(spark, str(tmp_path / "out"))["people"].count() == 1
    assert files.read_latest_state(spark, [str(tmp_path / "none.json"), str(bundle)]) is not None
    rows = tmp_path / "rows.txt"
    rows.write_text("Ada|1815|1852|Computing|first | programmer\nBo|1900|||\nno pipes\n")
    out = files.read_pipe_rows(spark, str(rows)).orderBy("name").collect()
    assert [(r.name, r.death, r.confidence) for r in out] == [("Ada", 1852, 90), ("Bo", None, 70)]
    assert out[0].description == "first | programmer"


def test_text_helpers(spark):
    df = spark.createDataFrame([("Élan ﬁnal Ångström", "Łukasiewicz, Jan Jr.", "!a b'(c)*")],
                               "a string, b string, c string")
    row = df.select(
        tx.text_key(F.col("a")).alias("k"), tx.person_key(F.col("b")).alias("p"),
        tx.encode_component(F.col("c")).alias("u"),
        tx.signed_year(F.lit("-0427-01-01")).alias("y"),
        tx.year_label(F.lit(-427)).alias("l"),
        tx.merge_unique_trimmed(F.array(F.lit(" 11"), F.lit("11 "))).alias("m")).collect()[0]
    assert (row.k, row.p, row.u) == ("elan final angstrom", "lukasiewicz jan", "!a%20b'(c)*")
    assert (row.y, row.l, row.m) == (-427, "427 BCE", ["11"])


def test_suggestion_reasons(spark):
    schema = ("id string, ord long, name string, description string, birth int, death int, "
              "fields array<string>, topics array<string>, works array<string>, "
              "movement string, era string, region string, advisors array<string>")
    found = spark.createDataFrame([("q", 0, "Q", "a mathematician", 1810, 1860, ["Logic"], [],
                                    ["Opus"], "M", None, None, ["Ann Lee"])], schema)
    folk = people(spark, {"id": "lee", "name": "Ann Lee", "movement": "M", "works": ["Opus"]},
                  {"id": "far", "fields": ["Music"], "birth": -400, "subfields": ["Z"]})
    best = sg.candidate_suggestions(found, folk)
    row = sg.with_reasons(best, found, folk).collect()[0]
    assert row.person_id == "lee" and row.category == "direct mentorship"
    assert row.reasons[0] == "Wikidata advisor" and "movement: M" in row.reasons
