"""Exact pair numbers of groups against pairs listed one by one."""

from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from evigraph.operators import linkage as ln
from evigraph.operators import pair_counts as pc
from evigraph.operators import relationship_candidates as rc

SCHEMA = "person_id string, ord long, kind string, value string, section string"


def rows_of(people, kind="source_context"):
    return [(f"p{i:05}", i, kind, value, section) for i, value, section in people]


def listed_sources(rows):
    found = defaultdict(lambda: defaultdict(set))
    for person, _, kind, value, section in rows:
        if kind == "source_context":
            found[value][person].add(section or None)
    out = {}
    for value, people in found.items():
        pairs = sum(None in a or None in b or bool(a & b)
                    for a, b in combinations(people.values(), 2))
        out[value] = (len(people), sum(None in s for s in people.values()), pairs)
    return out


def listed_concepts(rows):
    groups, told = defaultdict(set), set()
    for person, _, kind, value, _ in rows:
        if kind == "concept":
            groups[value].add(person)
        elif kind in ("explicit_influence", "advisor", "student"):
            told |= {(person, value), (value, person)}
    return {v: (len(g), len(list(combinations(g, 2))),
                sum(p in told for p in combinations(sorted(g), 2))) for v, g in groups.items()}


@pytest.fixture(scope="module")
def links():
    random = np.random.default_rng(4)
    people = []
    for i in range(70):
        for value in random.choice(["s1", "s2", "s3"], random.integers(1, 4), replace=False):
            wide = random.random() < 0.25
            pool = [None, "", *"abcdefghijklmnop"] if random.random() < 0.3 else list("abcdefghijklmnop")
            for section in random.choice(pool, random.integers(7, 13) if wide else
                                         random.integers(1, 5), replace=False):
                people.append((i, str(value), section if section is None else str(section)))
    rows = rows_of(people) + rows_of([(i, f"c{i % 3}", None) for i in range(60)], "concept")
    rows += rows_of([(i, "c0", None) for i in range(0, 60, 4)], "concept")
    for i in range(0, 60, 2):
        kind = ["explicit_influence", "advisor", "student", "coauthor"][i // 2 % 4]
        rows.append((f"p{i:05}", i, kind, f"p{(i + 3 * (i % 7)) % 60:05}", None))
    return rows + rows[:20] + [("p00001", 1, "concept", "alone", None)]


def test_sources(spark, links):
    found = {r.source: (r.members, r.unplaced, r.pairs)
             for r in pc.source_pairs(spark.createDataFrame(links, SCHEMA)).collect()}
    assert found == listed_sources(links)


def test_concepts(spark, links):
    found = {r.concept: (r.members, r.shared_pairs, r.linked_pairs, r.pairs)
             for r in pc.concept_pairs(spark.createDataFrame(links, SCHEMA)).collect()}
    assert found == {v: (n, s, k, s - k) for v, (n, s, k) in listed_concepts(links).items()}
    assert any(k for _, _, k, _ in found.values())


def test_counts_are_those_of_the_listed_pairs(spark, links):
    """The pairs listed for everyone as chosen people, counted per group."""
    table = spark.createDataFrame(links, SCHEMA)
    everyone = table.selectExpr("person_id as id").distinct()
    evidence = {rc.source_neighbors: pc.source_pairs, rc.parallel_development: pc.concept_pairs}
    for pairs, counts in evidence.items():
        if pairs is rc.parallel_development:
            total = pairs(table, everyone).agg({"evidence": "sum"}).first()[0]
            assert total == counts(table).agg({"pairs": "sum"}).first()[0]
        else:
            one = table.filter("value = 's1' and coalesce(section, 'x') <> ''")
            assert pairs(one, everyone).count() == counts(one).first().pairs


def test_hot_groups(spark):
    """A source and a concept of 5,000 people, without a row per pair."""
    random = np.random.default_rng(9)
    masks = [1 << int(a) | 1 << int(b) for a, b in random.integers(0, 9, (5000, 2))]
    people = [(i, "hot", str(s)) for i, m in enumerate(masks) for s in range(9) if m >> s & 1]
    people += [(i, "hot", None) for i in range(0, 5000, 100)]
    rows = rows_of(people) + rows_of([(i, "hot", None) for i in range(5000)], "concept")
    rows += [(f"p{i:05}", i, "advisor", f"p{(i * 7) % 5000:05}", None) for i in range(1, 5000, 3)]
    table = spark.createDataFrame(rows, SCHEMA)
    m = np.array(masks)
    m[::100] = -1
    fits = (m[:, None] & m[None, :]) != 0
    fits[m == -1, :] = fits[:, m == -1] = True
    source = pc.source_pairs(table).collect()
    assert [(r.members, r.unplaced, r.pairs) for r in source] == [
        (5000, 50, (int(fits.sum()) - 5000) // 2)]
    told = {frozenset((i, i * 7 % 5000)) for i in range(1, 5000, 3) if i != i * 7 % 5000}
    concept = pc.concept_pairs(table).collect()
    assert [(r.linked_pairs, r.pairs) for r in concept] == [
        (len(told), 5000 * 4999 // 2 - len(told))]


def test_empty(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert pc.source_pairs(table).collect() == [] and pc.concept_pairs(table).collect() == []


def test_near_misses(spark):
    """A third of all records on one surname: a row of numbers, equal to the listed pairs."""
    random = np.random.default_rng(6)
    name = lambda i: "Hot Smith" if i % 3 == 0 else ["Ann Lee", "", "-", "Bo Kane"][i % 4]
    rows = [(f"r{i}", name(i), int(1800 + random.integers(3)) if i % 7 else None) for i in range(90)]
    folk = [(f"p{i}", name(i), int(1800 + random.integers(3))) for i in range(120)]
    schema = "id string, name string, birth int"
    records, people = spark.createDataFrame(rows, schema), spark.createDataFrame(folk, schema)
    counts = pc.near_miss_counts(records, people)
    listed = ln.near_misses(records.filter("name not in ('', '-')"), people)
    assert {r.surname for r in counts.collect()} == {"smith", "lee", "kane"}
    assert counts.agg({"pairs": "sum"}).first()[0] == listed.count()
