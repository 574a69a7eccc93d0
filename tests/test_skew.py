"""Hot keys, large groups and copies: exact against brute force on small tables."""

import itertools
import random

from pyspark.sql import functions as F

from evigraph.operators import groups as gr
from evigraph.operators import linkage as ln
from evigraph.operators import missing_edges as me
from evigraph.operators import relationship_candidates as rc
from evigraph.operators import suggestions as sg
from evigraph.operators import traversal as tr
from tests.fixtures import claims, edges, people, threads
from tests.test_scenarios import CANDIDATES, links


def evidence(spark, kinds):
    """Thirty people, a third of all memberships in one group per kind."""
    rng = random.Random(7)
    rows = set()
    for kind in kinds:
        for n in range(30):
            if n % 3 == 0 or n < 12:
                rows.add((f"p{n}", n, kind, f"{kind}-hot", None))
            rows.add((f"p{n}", n, kind, f"{kind}-{rng.randrange(6)}", None))
    for n in range(12):
        a, b = rng.sample(range(30), 2)
        rows.add((f"p{a}", a, rng.choice(["coauthor", "explicit_influence", "advisor"]),
                  f"p{b}", None))
    return links(spark, *sorted(rows, key=str))


def folk(spark, n=30):
    return people(spark, *[{"id": f"p{i}", "birth": 1800 + (i * 7) % 40} for i in range(n)])


def rows_of(df):
    return {(r.source_id, r.target_id): (r.confidence, r.evidence) for r in df.collect()
            if r.row_kind == "pair"}


GROUP_CASES = [
    (rc.collaboration, ["institution", "work"], False), (rc.influence, ["movement"], True),
    (rc.parallel_development, ["concept"], False), (rc.source_neighbors, ["source_context"], False)]


def test_groups_and_chosen_people_agree(spark):
    """The pairs of all people, chosen by halves, are the pairs of everyone; those that other
    evidence names are the same in the table-wide rows; groups state the rest."""
    for operator, kinds, dated in GROUP_CASES:
        table, extra = evidence(spark, kinds), (folk(spark),) if dated else ()
        focus = lambda keep: spark.createDataFrame(
            [(f"p{n}",) for n in range(30) if keep(n)], "id string")
        full = rows_of(operator(table, *extra, focus=focus(lambda n: True)))
        some = rows_of(operator(table, *extra, focus=focus(lambda n: n % 4 == 0)))
        chosen = {f"person:p{n}" for n in range(0, 30, 4)}
        assert some == {k: v for k, v in full.items() if chosen & set(k)}
        whole = operator(table, *extra).collect()
        stated = {(r.source_id, r.target_id): (r.confidence, r.evidence) for r in whole
                  if r.row_kind == "pair"}
        assert all(full[k] == v for k, v in stated.items())
        members = {}
        for r in table.filter(F.col("kind").isin(kinds)).collect():
            members.setdefault((r.kind, r.value), set()).add(f"person:{r.person_id}")
        groups = {(r.group_kind, r.group_value): (r.members, r.pairs) for r in whole
                  if r.row_kind == "group"}
        assert groups == {k: (len(m), len(m) * (len(m) - 1) // 2) for k, m in members.items()}
        assert all(any({*k} <= m for m in members.values()) for k in set(full) - set(stated))


def test_one_form_for_every_group_size(spark):
    for size in (1, 64, 65, 5000):
        rows = spark.range(size).select(
            F.concat(F.lit("p"), "id").alias("person_id"), F.col("id").alias("ord"),
            F.lit("institution").alias("kind"), F.lit("x").alias("value"),
            F.lit(None).cast("string").alias("section"))
        out = rc.collaboration(rows).collect()
        assert [(r.row_kind, r.members, r.pairs) for r in out] == [
            ("group", size, size * (size - 1) // 2)]
        focus = spark.createDataFrame([("p0",)], "id string")
        assert rc.collaboration(rows, focus).count() == size - 1


def test_context_alone_makes_candidates(spark):
    folk_ = people(spark, *[{"id": i, "birth": y, "region": "R"} for i, y in
                            (("a", 1800), ("b", 1810), ("c", 1950))])
    none = (edges(spark).limit(0), claims(spark).limit(0), threads(spark).limit(0))
    focus = spark.createDataFrame([("a",)], "id string")
    found = me.discover(folk_, *none, focus=focus).collect()
    assert [(r.source, r.target, r.type, r.confidence) for r in found] == [
        ("a", "b", me.NEIGHBOR, .42)]


def test_partners_of_chosen_people(spark):
    table = evidence(spark, ["concept"]).filter("kind = 'concept'")
    focus = spark.createDataFrame([("p0",), ("p5",)], "id string")
    got = {(r.person_id, r.partner_id) for r in gr.expand_for(table, focus).collect()}
    rows = table.collect()
    want = {(a.person_id, b.person_id) for a in rows for b in rows
            if a.value == b.value and a.person_id in ("p0", "p5") and a.person_id != b.person_id}
    assert got == want


def test_hot_candidate_key(spark):
    many = [{"id": f"k{i}", "confidence": (i * 37 % 100) / 100,
             "subject_id": "relationship:person:a:Influence:person:b"} for i in range(120)]
    few = [{"id": f"f{i}", "confidence": c, "subject_id": "relationship:person:b:Influence:person:c"}
           for i, c in enumerate([0.2, 0.1, 0.5])]
    found = me.discover(people(spark, {"id": "a"}, {"id": "b"}, {"id": "c"}), edges(spark).limit(0),
                        claims(spark, *many, *few), threads(spark).limit(0)).collect()
    got = {(r.source, r.target): (r.confidence, r.n_claims) for r in found}
    assert got == {("a", "b"): (0.98, 120), ("b", "c"): (0.53, 3)}


def crowd(spark):
    """A third of all people are copies; names nest in one another."""
    rng = random.Random(3)
    rows = [{"id": f"h{i}", "name": "John Smithson", "birth": 1800, "fields": ["Logic"]}
            for i in range(40)]
    for i in range(80):
        rows.append({"id": f"x{i}", "birth": 1790 + rng.randrange(30),
                     "name": rng.choice(["John Smithson", "John Smithson Jr", "Anna Lee Jones",
                                         "Anna Lee", f"Nobody {i}"]),
                     "fields": rng.sample(["Logic", "Music", "Physics"], rng.choice([1, 2]))})
    rng.shuffle(rows)
    return rows


def test_duplicate_pairs_with_copies(spark):
    rows = crowd(spark)
    key = lambda r: "".join(c for c in r["name"].lower() if c.isalnum())
    scored = []
    for (i, a), (j, b) in itertools.combinations(enumerate(rows), 2):
        ka, kb = key(a), key(b)
        score = 8 * (ka == kb) + 3 * (abs(a["birth"] - b["birth"]) <= 3)
        score += 5 * (len(ka) > 6 and len(kb) > 6 and (ka in kb or kb in ka))
        score += 2 * bool(set(a["fields"]) & set(b["fields"]))
        if score >= 7:
            scored.append((-score, i, j))
    for limit in (20, 400):
        out = ln.duplicate_pairs(people(spark, *rows), limit).collect()
        assert [(-r.score, r.a_ord, r.b_ord) for r in out] == sorted(scored)[:limit]


def test_peers_with_copies(spark):
    rows = crowd(spark)
    for n, r in enumerate(rows):
        r.update(death=r["birth"] + 30 + n % 50, era="E" if n % 3 else "F", bridge_score=n % 5)
    table = people(spark, *rows)

    def brute(fits, rank):
        out = {}
        for i, a in enumerate(rows):
            hits = sorted((rank(a, b), j) for j, b in enumerate(rows) if i != j and fits(a, b))
            out[a["id"]] = [rows[j]["id"] for _, j in hits[:8]]
        return {k: v for k, v in out.items() if v}

    def got(df):
        out = {}
        for r in df.orderBy("person_id", "position").collect():
            out.setdefault(r.person_id, []).append(r.peer_id)
        return out

    over = lambda a, b: min(a["death"], b["death"]) - max(a["birth"], b["birth"])
    assert got(tr.contemporaries(table)) == brute(lambda a, b: over(a, b) > 20,
                                                  lambda a, b: -over(a, b))
    assert got(tr.field_peers(table)) == brute(
        lambda a, b: set(a["fields"]) & set(b["fields"]), lambda a, b: -b["bridge_score"])
    assert got(tr.era_peers(table)) == brute(
        lambda a, b: a["era"] == b["era"], lambda a, b: abs(a["birth"] - b["birth"]))


def test_profile_copies_count_once(spark):
    schema = ("id string, ord long, label string, type string, alternate_labels array<string>, "
              "city string, start int, end int, fields array<string>, "
              "broader_terms array<string>, external_ids map<string,array<string>>")
    copy = ("Royal Institute", "Institution", None, "Rome", None, None, ["Logic"], None,
            {"viaf": ["1"]})
    table = spark.createDataFrame([(f"e{i}", i, *copy) for i in range(50)], schema)
    out = ln.entity_linkage(table, table).collect()
    assert [(r.candidate_copies, r.existing_copies, r.score) for r in out] == [(50, 50, 0.75)]
    _, members = ln.entity_profiles(table)
    assert members.count() == 50


def test_first_duplicate_with_hot_name(spark):
    table = people(spark, *crowd(spark))
    rows = [(f"c{i}", i, "John Smithson", None, None, None, None, "", None) for i in range(30)]
    out = ln.first_duplicate(spark.createDataFrame(rows, CANDIDATES), table)
    first = table.filter("name = 'John Smithson'").agg(F.min_by("id", "ord")).collect()[0][0]
    assert {r.duplicate_id for r in out.collect()} == {first}


def test_suggestions_skip_only_copies(spark):
    rows = crowd(spark)
    schema = ("id string, ord long, name string, description string, birth int, death int, "
              "fields array<string>, topics array<string>, works array<string>, "
              "movement string, era string, region string")
    found = spark.createDataFrame(
        [(f"q{i}", i, "Q", "about formal logic", 1800 + i, 1850, ["Logic"], ["T"], [], None, None,
          "R") for i in range(3)], schema)
    none = spark.createDataFrame([], "candidate_id string, person_id string")
    table = people(spark, *rows)
    short = sg.candidate_suggestions(found, table)
    full = sg.candidate_suggestions(found, table, rejected=none)
    pick = lambda df: sorted((r.candidate_id, r.position, r.person_id, r.score)
                             for r in df.collect())
    assert pick(short) == pick(full)


def test_result_does_not_depend_on_partitions(spark):
    table = evidence(spark, ["institution"])
    one = rc.collaboration(table.coalesce(1)).select("source_id", "target_id", "confidence")
    many = rc.collaboration(table.orderBy(F.rand(1)).repartition(7)).select(*one.columns)
    assert set(map(tuple, one.collect())) == set(map(tuple, many.collect()))
