"""The fold of queue events against a walk through them one by one."""

import random
from pathlib import Path
from urllib.parse import urlparse

from evigraph.operators import import_review as ir
from evigraph.session import shared_folder
from tests.fixtures import people

EVENTS = ("ord long, kind string, candidate_id string, confidence int, duplicate_id string, "
          "threshold int")
CANDIDATES = ("id string, ord long, name string, birth int, source_url string, "
              "wikipedia_url string")
KINDS = ["queue"] * 6 + ["accept", "accept", "skip", "merge"]


def story(seed, count, names):
    """Events of which a third concern one candidate, with an order that has holes."""
    rng = random.Random(seed)
    rows, at = [], 0
    for _ in range(count):
        at += rng.choice([1, 1, 2, 9])
        if rng.random() < 0.04:
            kind = rng.choice(["clear_duplicates", "clear_low", "clear_all"])
            rows.append((at, kind, None, None, None,
                         rng.randrange(101) if kind == "clear_low" else None))
            continue
        who = "q0" if rng.random() < 1 / 3 else f"q{rng.randrange(names)}"
        rows.append((at, rng.choice(KINDS), who, rng.choice([None, rng.randrange(-5, 120)]),
                     rng.choice([None, None, "p1"]), None))
    return rows


def walk(events, candidates, known):
    """Queue, audit and accepted, event by event."""
    facts = {c[0]: c for c in candidates}
    names = {"".join(x for x in n.lower() if x.isalnum()) for n in known}
    queue, audit, accepted = {}, [], []

    def out(at, who, kind):
        level = queue.pop(who)[1]
        audit.append((at, who, level, ir.REASONS[kind][0], ir.REASONS[kind][1]))

    for at, kind, who, confidence, double, threshold in sorted(events):
        if kind == "queue" and who in facts and who not in queue:
            queue[who] = (at, max(0, min(100, confidence or 0)), double)
        elif kind in ("skip", "merge") and who in queue:
            out(at, who, kind)
        elif kind == "accept" and who in queue and facts[who][3] is not None:
            key = "".join(x for x in facts[who][2].lower() if x.isalnum())
            if key not in names:
                names.add(key)
                accepted.append((who, at))
                out(at, who, kind)
        elif kind.startswith("clear"):
            for name, (_, level, double) in list(queue.items()):
                if kind == "clear_all" or (kind == "clear_duplicates" and double) or (
                        kind == "clear_low" and level < threshold):
                    out(at, name, kind)
    return {(w, *v) for w, v in queue.items()}, sorted(audit), sorted(accepted)


def found(spark, names):
    # Several candidates have one name, one has a person's, some have no birth.
    rows = [(f"q{i}", i, f"Name {i % (names // 2)}" if i else "Known One", None if i % 7 == 3 else
             1800 + i, f"s{i}", f"w{i}" if i % 2 else None) for i in range(names)]
    return rows, spark.createDataFrame(rows, CANDIDATES)


def check(spark, events, names, block):
    rows, candidates = found(spark, names)
    folk = people(spark, {"id": "p1", "name": "Known-One"})
    out = ir.review_fold(spark.createDataFrame(events, EVENTS), candidates, folk, block)
    queue, audit, accepted = walk(events, rows, ["Known-One"])
    assert {(r.candidate_id, r.ord, r.confidence, r.duplicate_id)
            for r in out["queue"].collect()} == queue
    assert sorted((r.ord, r.candidate_id, r.confidence, r.status, r.reason)
                  for r in out["audit"].collect()) == audit
    assert sorted((r.candidate_id, r.ord) for r in out["accepted"].collect()) == accepted
    return queue, audit, accepted


def test_fold_equals_walk(spark):
    # Blocks of seven orders, so that a candidate's events lie in hundreds of them.
    queue, audit, accepted = check(spark, story(5, 600, 24), 24, 7)
    assert queue and len(audit) > 100 and len(accepted) > 5
    assert len({r[4] for r in audit}) == len(ir.REASONS)


def test_fold_of_few_and_no_events(spark):
    check(spark, [], 6, 1 << 16)
    check(spark, [(5, "accept", "q1", None, None, None), (6, "queue", "q1", 50, None, None),
                  (7, "accept", "q1", None, None, None), (8, "queue", "q1", 60, None, None),
                  (9, "accept", "q1", None, None, None), (10, "dance", "q1", 1, None, None),
                  (11, "queue", "nobody", 1, None, None)], 6, 1 << 16)


def test_best_suggestion_becomes_an_edge(spark):
    _, candidates = found(spark, 6)
    folk = people(spark, {"id": "p1", "birth": 1700}, {"id": "p2", "birth": 1900})
    schema = ("candidate_id string, person_id string, position int, category string, "
              "explanation string, reasons array<string>")
    rows = [("q1", "p1", 1, "collaboration", "direct claim", ["a", "b"]),
            ("q1", "p2", 2, "x", "y", []), ("q2", "p2", 1, "needs review", "thin evidence", []),
            ("q4", "p1", 1, "x", "y", [])]
    accepted = spark.createDataFrame([("q1", 3), ("q2", 9), ("q5", 11)],
                                     "candidate_id string, ord long")
    new = ir.accepted_people(accepted, candidates, folk)
    assert sorted(r.candidate_id for r in new.collect()) == ["q1", "q2", "q5"]
    edges = ir.accepted_links(new, spark.createDataFrame(rows, schema), candidates, folk)
    got = sorted((r.source, r.target, r.type, r.note, r.source_claims) for r in edges.collect())
    ids = {r.candidate_id: r.new_id for r in new.collect()}
    assert got == sorted([
        ("p1", ids["q1"], "collaboration",
         "Imported with suggested context: direct claim; a, b", ["w1"]),
        (ids["q2"], "p2", "needs review",
         "Imported with suggested context: thin evidence; nearby chronology", ["s2"])])


def test_walked_and_jumped_entries_agree(spark, monkeypatch):
    """Candidates with many entries take another way than those with few."""
    monkeypatch.setattr(ir, "WALKED", 8)
    events = story(9, 240, 24)
    check(spark, events, 24, 1 << 16)
    counts = [sum(e[1] == "queue" and e[2] == f"q{n}" for e in events) for n in range(24)]
    assert min(counts) <= 8 < max(counts)


def test_the_fold_removes_its_tables(spark, monkeypatch):
    """Whoever asks for the accepted follows the entries once and leaves no other table."""
    _, candidates = found(spark, 12)
    folk = people(spark, {"id": "p1", "name": "Known-One"})
    folder = Path(urlparse(shared_folder(spark)).path)
    before, calls = set(folder.iterdir()), []
    real = ir._entries
    monkeypatch.setattr(ir, "_entries", lambda *given: calls.append(1) or real(*given))
    events = story(3, 120, 12)
    fold = ir.review_fold(spark.createDataFrame(events, EVENTS), candidates, folk)
    accepted = fold["accepted"]
    assert len(calls) == 1
    # The fold's own tables and the accepted.
    assert len(set(folder.iterdir()) - before) == 2
    fold.remove()
    assert len(set(folder.iterdir()) - before) == 1
    assert sorted((r.candidate_id, r.ord) for r in accepted.collect()) == walk(
        events, found(spark, 12)[0], ["Known-One"])[2] != []
