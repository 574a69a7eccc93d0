import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from evigraph.llm.structure_repair import (
    BLANK, CLOSED, DUPLICATE, TRUNCATED, audited, block_costs, cheapest, damaged, repaired,
)

SCHEMA = "conv_id long, turn long, role string, text string, part int, kind int, key int, plan int"
SPACE = " \t\n\x0b\x0c\r"


def broken(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(name.encode()) % 20
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def best_edits(turns):
    """(cost, audit, lines) least of all, by trying every edit of every turn: a table of the
    best for each sequence of initials so far, cut down to what decides the future."""
    table = {"": (0, "", ())}

    def put(found, said, entry):
        if re.fullmatch("s?(ua)*u?", said) and (said not in found or entry < found[said]):
            found[said] = entry

    def inserted(table):
        found = dict(table)
        for _ in range(3):
            for said, (cost, audit, lines) in list(found.items()):
                for role in ("user", "assistant"):
                    longer = said + role[0]
                    if re.fullmatch("s?(ua)*u?", longer):
                        put(found, longer, (cost + 5, audit + "I", (*lines, f"{role}:")))
        return found

    for role, text, fault in turns:
        found = {}
        for said, (cost, audit, lines) in inserted(table).items():
            put(found, said, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 * (fault == "truncated")
            put(found, said + role[:1] if role else said + "?",
                (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
            for other in ("user", "assistant"):
                put(found, said + other[0], (cost + extra + 1, audit + "R", (*lines, f"{other}:{text}")))
        table = {}
        for said, entry in found.items():
            key = "s" if said[:1] == "s" else ""
            tail = said[len(key):]
            short = key + ("ua"[: 1 + (len(tail) % 2 == 0)] if tail else "")
            if short not in table or entry < table[short]:
                table[short] = entry
    done = [e for said, e in inserted(table).items() if re.fullmatch("(s?(ua)+)?", said)]
    return min(done)


def brute(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in broken(rows):
        groups[conv].append((turn is not None, turn or 0, role,
                             hashlib.md5(text.encode()).hexdigest(), text))
    out = []
    for conv in {r[0] for r in rows}:
        turns, seen, coded, counts = sorted(groups[conv]), set(), [], Counter()
        for _, _, role, _, text in turns:
            last = text.strip(SPACE)[-1:]
            fault = ("blank" if not last else "duplicate" if (role, text) in seen
                     else "truncated" if last not in ".!?" else None)
            seen.add((role, text))
            counts[fault] += 1
            coded.append((role, text, fault))
        numbers = [t for known, t, *_ in turns if known]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = best_edits(coded)
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal,
                    cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        "repaired_sha256").collect()], key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1, 1) for r in rows], SCHEMA)


def odd_rows():
    random = np.random.default_rng(11)
    roles = ["user", "assistant", "system", "tool", "", None, "agent", "u", "Sage"]
    texts = ["Yes.", "no", " ", "", None, "what?\n", "\x0b!", "é🎉", "ok.  ", "a:b."]
    rows = []
    for c in range(60):
        for t in range(int(random.integers(1, 12))):
            role = ["user", "assistant"][t % 2] if random.random() < 0.7 else (
                roles[random.integers(len(roles))])
            text = f"{t}." if random.random() < 0.6 else texts[random.integers(len(texts))]
            rows.append((c, t + (t > 4) * 3, role, text))
    rows += [(70, 1, "user", "same."), (70, 1, "user", "same."), (70, 1, "assistant", "a."),
             (71, None, None, None), (72, None, "user", "x."), (72, None, "user", "b"),
             (None, 1, "user", "null id"), (None, 2, "assistant", "y."), (None, None, "user", "z.")]
    rows += [(80, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(300)]
    rows += [(81, 5, "user", "hot.")] * 40 + [(c, 0, "user", "dropped?") for c in range(100, 160)]
    return rows


@pytest.mark.parametrize("block", [256, 4])
def test_odd_rows(spark, block):
    rows = odd_rows()
    table = frame(spark, rows)
    found = audited(damaged(table), table, block, rows_per_block=61)
    assert rows_of(found) == brute(rows)
    assert any(not broken([r for r in rows if r[0] == c]) for c in range(100, 160))


def test_repaired_turns(spark):
    """The repaired turns are legal, and their digest is the audit's."""
    rows = odd_rows()
    table = damaged(frame(spark, rows))
    lines = defaultdict(list)
    for r in repaired(table, 16, 61).orderBy("conv_id", "place").collect():
        assert r.place == len(lines[r.conv_id])
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for r in audited(table, None, 16, 61).collect():
        said = lines[r.conv_id]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in said))
        assert hashlib.sha256("\n".join(said).encode()).hexdigest() == r.repaired_sha256


def test_empty(spark):
    table = frame(spark, odd_rows()).limit(0)
    assert audited(damaged(table), table).collect() == []
    assert repaired(table).collect() == []


def test_long_conversation(spark):
    """Blocks give the answer that one search over the whole would give."""
    random = np.random.default_rng(2)
    rows = [(7, t, ["user", "assistant", "tool"][int(random.choice(3, p=[.48, .47, .05]))],
             f"{t}{'.' if random.random() < 0.95 else ''}") for t in range(5000)]
    table = frame(spark, rows)
    assert rows_of(audited(damaged(table), table, rows_per_block=700)) == brute(rows)


def test_search_is_exact():
    """Every short block, from every state, against all edit sequences spelled out."""
    codes = [0, 1, 2, 3, 1 + BLANK, 2 + DUPLICATE, 1 + TRUNCATED, 2 + TRUNCATED]
    roles = ["system", "user", "assistant", "tool"]
    faults = {BLANK: "blank", DUPLICATE: "duplicate", TRUNCATED: "truncated", 0: None}
    for n in range(4):
        for block in itertools.product(codes, repeat=n):
            cost, plan, last = cheapest(bytes(block), 0, CLOSED)
            audit = "".join("I" if p.islower() else "R" if p in "UA" else p for p in plan)
            want = best_edits([(roles[c & 3], "x", faults[c & ~3]) for c in block])
            assert cost == want[0] and want[1] == audit + "I" * (CLOSED[last] // 5)
            costs = block_costs(bytes(block))
            assert cost == min(costs[t] + CLOSED[t] for t in range(4))
