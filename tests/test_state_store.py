"""Bundles of several files, and versions that are committed, damaged and restored."""

import json

import pytest
from pyspark.sql import functions as F

from evigraph.sources import state_store as st


def now():
    return F.lit("2034-01-12").cast("timestamp")


def bundle(path, people, **more):
    rows = [{"id": p, "name": p.upper(), "birth": 1800 + i, "death": None, "fields": ["Logic"]}
            for i, p in enumerate(people)]
    path.write_text(json.dumps({"version": 8, "exportedAt": "2030-01-01", "people": rows + [
        {"id": "bad"}, None], "edges": [], **more}))


@pytest.fixture
def tables(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    edge = lambda s, t: {"source": s, "target": t, "type": "Influence", "strength": 2}
    bundle(folder / "1.json", ["a", "b"], edges=[edge("a", "b"), edge("a", "gone")],
           importConfidenceThreshold=30, rejectedLinkSuggestionKeys=["a::b", None, "b::a"],
           importReviewQueue=[{"id": "q1", "candidateId": "Q", "candidateName": "N",
                               "confidence": 140}, {"id": "q2"}])
    bundle(folder / "2.json", ["c"], edges=[edge("c", "a")], importConfidenceThreshold="250",
           rejectedLinkSuggestionKeys=["a::b", "c::a"],
           linkReviewQueue=[{"id": "l1", "sourceId": "a", "targetId": "c"}, {"id": "l2"}],
           importAuditLog=[{"id": "x", "action": "accepted"}, None])
    return st.read_bundles(spark, str(folder))


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_bundles_of_two_files(tables):
    span = st.FILE_SPAN
    assert rows_of(tables["people"], "id", "ord") == [("a", 0), ("b", 1), ("c", span)]
    assert rows_of(tables["edges"], "ord", "id") == [(0, "a:Influence:b"), (span, "c:Influence:a")]
    assert tables["people_rejects"].count() == 2 and tables["edge_rejects"].count() == 1
    assert rows_of(tables["rejected_keys"], "ord", "key") == [
        (0, "a::b"), (2, "b::a"), (span + 1, "c::a")]
    assert rows_of(tables["import_queue"], "id", "confidence", "status") == [("q1", 100, "queued")]
    link, = tables["link_queue"].collect()
    assert (link.id, link.source_name, link.score, link.created_at) == ("l1", "a", 1.0, "2030-01-01")
    assert rows_of(tables["audit"], "id", "ord") == [("x", span)]
    assert tables["settings"].collect()[0].threshold == 100.0


def test_threshold_and_people_are_checked(spark, tmp_path):
    bundle(tmp_path / "one.json", ["a"], importConfidenceThreshold="many")
    assert st.read_bundles(spark, str(tmp_path))["settings"].collect()[0].threshold == 80.0
    bundle(tmp_path / "one.json", [])
    with pytest.raises(st.NoValidPeople):
        st.read_bundles(spark, str(tmp_path))


def test_round_trip(spark, tables, tmp_path):
    root = str(tmp_path / "store")
    assert st.restore(spark, root) is None and st.versions(spark, root) == []
    kept = {n: tables[n] for n in st.TABLES}
    assert st.commit(kept, root, now()) == 1
    assert st.commit(kept | {"people": tables["people"].limit(2)}, root, now()) == 2
    version, back = st.restore(spark, root)
    assert version == 2 and sorted(back) == sorted(st.TABLES) and back["people"].count() == 2
    for name in st.TABLES[1:]:
        columns = [F.to_json(F.struct(*sorted(tables[name].columns)))]
        assert rows_of(back[name], *columns) == rows_of(tables[name], *columns)
    assert st.restored_entities(back).count() == 4


@pytest.mark.parametrize("damage", ["row added", "file gone", "table gone", "no manifest"])
def test_damaged_newest_is_passed_over(spark, tables, tmp_path, damage):
    root = tmp_path / "store"
    kept = {n: tables[n] for n in ("people", "edges")}
    st.commit(kept, str(root), now())
    st.commit(kept, str(root), now())
    (_, folder), _ = st.versions(spark, str(root))
    if damage == "row added":
        tables["people"].limit(1).write.mode("append").parquet(f"{root}/{folder}/people")
    elif damage == "file gone":
        next(iter((root / folder / "people").glob("part-*"))).write_bytes(b"")
    elif damage == "table gone":
        (root / folder / "edges").rename(root / "elsewhere")
    else:
        tables["people"].write.parquet(f"{root}/versions/00000003-x/people")
        tables["edges"].limit(1).write.mode("append").parquet(f"{root}/{folder}/edges")
    version, back = st.restore(spark, str(root))
    assert version == 1 and back["people"].count() == 3
