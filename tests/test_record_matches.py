"""Matches and conflicts of every record, with large groups of copies on both sides."""

from evigraph.operators import linkage as ln
from tests.test_threshold_join import PEOPLE


def records(spark, prefix, count, births, names):
    return spark.createDataFrame(
        [(f"{prefix}{i}", i, names[i % len(names)], None, births[i % len(births)], 1850,
          {"viaf": ["1"]}, ["Logic"], None, ["W"], None, None) for i in range(count)], PEOPLE)


def test_every_copy_appears_once_a_match(spark):
    left, right = records(spark, "c", 1000, [1800], ["Ada"]), records(spark, "p", 900, [1801], ["Ada"])
    matches = ln.person_linkage(left, right)
    assert matches.count() == 1
    members = [ln.person_profiles(df)[1] for df in (left, right)]
    out = ln.matched_records(matches, members[0], "candidate").unionByName(
        ln.matched_records(matches, members[1], "existing")).collect()
    assert len(out) == 1900
    assert {r.record_id for r in out if r.side == "candidate"} == {f"c{i}" for i in range(1000)}
    assert {(r.candidate_profile, r.existing_profile) for r in out} == {("c0", "p0")}
    conflicts = ln.record_conflicts(matches, (left, members[0]), (right, members[1]),
                                    ["birth", "death"])
    assert sorted(map(tuple, conflicts.collect())) == [
        ("c0", "p0", "birth", "candidate", "1800", 1000),
        ("c0", "p0", "birth", "existing", "1801", 900)]


def test_values_of_later_copies_and_their_claims_are_kept(spark):
    left, right = records(spark, "c", 3, [1800], ["Ada"]), records(spark, "p", 2, [1800], ["Ada"])
    regions = {"c0": "Rome", "c1": None, "c2": "Oslo", "p0": "Rome", "p1": None}
    table = spark.createDataFrame(list(regions.items()), "id string, region string")
    left, right = left.join(table, "id"), right.join(table, "id")
    matches = ln.person_linkage(left, right)
    members = [ln.person_profiles(df)[1] for df in (left, right)]
    conflicts = ln.record_conflicts(matches, (left, members[0]), (right, members[1]),
                                    ["region", "birth"])
    # The first copies agree; the third of the candidates does not.
    assert sorted((r.side, r.value, r.records) for r in conflicts.collect()) == [
        ("candidate", "Oslo", 1), ("candidate", "Rome", 1), ("existing", "Rome", 1)]
    claims = spark.createDataFrame(
        [("k1", "o1", "c2", "region", "Oslo"), ("k2", None, "p1", "region", "Rome"),
         ("k3", "o1", "c0", "region", "Bern"), ("k4", "o2", "c0", "birth", "1800"),
         ("k5", "o2", "x", "region", "Rome")],
        "id string, observation_id string, subject_id string, field string, value string")
    out = ln.conflict_evidence(conflicts, members[0], members[1], claims).collect()
    assert sorted((r.side, r.value, r.record_id, r.claim_id, r.observation_id) for r in out) == [
        ("candidate", "Oslo", "c2", "k1", "o1"), ("existing", "Rome", "p1", "k2", None)]


def test_nothing_matched(spark):
    left = records(spark, "c", 2, [1800], ["Ada"])
    none = left.limit(0)
    matches = ln.person_linkage(left, none)
    members = [ln.person_profiles(df)[1] for df in (left, none)]
    assert ln.matched_records(matches, members[0], "candidate").count() == 0
    assert ln.record_conflicts(matches, (left, members[0]), (none, members[1]), ["birth"]).count() == 0
