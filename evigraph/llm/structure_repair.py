"""Repair of conversation structure by iterative-deepening A* over edits."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.common import mapped, stored
from evigraph.llm.prefix_trie import CRC32
from evigraph.llm.sharding import in_blocks

#: Turns that one search edits; longer conversations are several blocks with exact costs at
#: their ends, so that the answer is that of one search.
BLOCK = 256
SPACE = " \t\n\x0b\x0c\r"
# A turn's code: its role's initial, and its faults.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
BLANK, DUPLICATE, TRUNCATED = 4, 8, 16
#: Costs of the edits, and of each truncated turn that stays.
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 2, 5, 1, 5
#: What was said so far, as states of ``(s?(ua)+)?``: nothing, s, ...u, ...a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state after a user's or assistant's turn, and that turn's initial.
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
TURN = "uuau"
#: State after each state by initial; what is missing is not allowed.
STEPS = {(START, SYSTEM): AFTER_S, (START, USER): AFTER_U, (AFTER_S, USER): AFTER_U,
         (AFTER_U, ASSISTANT): AFTER_A, (AFTER_A, USER): AFTER_U}
#: Insertions that complete each state at the very end.
CLOSING = (0, 2, 1, 0)


def turn_steps(code: int, state: int) -> Iterator[tuple[str, str, int, int]]:
    """Edits of a turn in ASCII order: letter, plan letter, state after it, cost."""
    yield "D", "D", state, DELETE_COST
    if code & (BLANK | DUPLICATE):
        return
    extra = TRUNCATED_COST if code & TRUNCATED else 0
    kept = STEPS.get((state, code & 3))
    if kept is not None:
        yield "K", "K", kept, extra
    yield "R", TURN[state].upper(), NEXT[state], REROLE_COST + extra


@lru_cache(maxsize=1024)
def _expansions(code: int, state: int) -> tuple[tuple[str, int, int, int], ...]:
    """Plan letter, whether the turn is done, state and cost, in ASCII order of the edits."""
    done = [(letter, plan, 1, after, cost) for letter, plan, after, cost in turn_steps(code, state)]
    done.append(("I", TURN[state], 0, NEXT[state], INSERT_COST))
    return tuple(e[1:] for e in sorted(done, key=lambda e: e[0]))


@lru_cache(maxsize=20_000)
def cheapest(codes: bytes, state: int, ends: tuple[int, ...]) -> tuple[int, str, int]:
    """Cost, plan and last state of the cheapest edits of a block's turns, the ASCII-least
    of these; ``ends`` is the cost of all that follows, by last state.

    Depth-first in ASCII order under a bound on cost so far plus the deletions that the
    remaining turns need at least; the next bound is the least sum that exceeded this one.
    A state that failed is not entered again with as little or less to spend. Inserted
    turns come before a turn, never after a block's last one, so that blocks compose.
    """
    n = len(codes)
    need = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        need[i] = need[i + 1] + (DELETE_COST if codes[i] >= BLANK else 0)
    least = min(ends)
    need = [x + least for x in need]
    bound = need[0]
    while True:
        beyond = math.inf
        failed: dict[int, int] = {}
        path: list[str] = []
        stack = [(0, state, 0, iter(_expansions(codes[0], state) if n else ()))]
        while stack:
            i, at, spent, edits = stack[-1]
            if i == n:
                total = spent + ends[at]
                if total <= bound:
                    return total, "".join(path), at
                beyond = min(beyond, total)
            for plan, done, after, cost in edits:
                j, now = i + done, spent + cost
                if now + need[j] > bound:
                    beyond = min(beyond, now + need[j])
                elif failed.get(4 * j + after, -1) < bound - now:
                    path.append(plan)
                    stack.append((j, after, now,
                                  iter(_expansions(codes[j], after) if j < n else ())))
                    break
            else:
                failed[4 * i + at] = max(failed.get(4 * i + at, -1), bound - spent)
                stack.pop()
                if path:
                    path.pop()
        bound = beyond


def block_costs(codes: bytes) -> list[int]:
    """Least cost of a block's edits from each state to each state, row by row."""
    far = 1 << 40
    costs = np.full((4, 4), far)
    costs[range(4), range(4)] = 0
    for code in codes:
        for _ in range(3):
            for s in range(4):
                costs[:, NEXT[s]] = np.minimum(costs[:, NEXT[s]], costs[:, s] + INSERT_COST)
        after = np.full((4, 4), far)
        for s in range(4):
            for _, _, t, cost in turn_steps(code, s):
                after[:, t] = np.minimum(after[:, t], costs[:, s] + cost)
        costs = after
    return np.minimum(costs, far).ravel().tolist()


CLOSED = tuple(c * INSERT_COST for c in CLOSING)


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns, damaged by the CRC-32 of ``conv_id:turn`` mod 20: 0 drops a turn, 1
    empties it, 2 removes its ``[.!?]``, 3 repeats it, 4 makes it the user's. A null is one
    space, but for a null turn's place in the order."""
    space = F.lit(" ")
    fate = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                                fate.alias("fate")).where("fate <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, F.lit("user")).otherwise(
            F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, F.lit("")).when(
            F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(
            F.col("text")).alias("text"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(
            F.array(F.lit(0)))).alias("copy")).drop("copy")


def _turns(conversations: DataFrame) -> DataFrame:
    """The turns with nulls as one space and their key in the order of turns."""
    return conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" "))
        .alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).withColumn(
        "key", F.md5("text"))


def _code() -> Column:
    """Initial and fault of a turn, without the fault of being a duplicate."""
    text = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    return F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(
        initial == "a", ASSISTANT).otherwise(OTHER) + F.when(text == "", BLANK).when(
        F.substring(text, -1, 1).isin(".", "!", "?"), 0).otherwise(TRUNCATED)


def _blocks(turns: DataFrame, block: int, rows_per_block: int) -> DataFrame:
    """Codes of every block of turns of a conversation, with its first turn's order key."""
    order = ["conv_id", "turn", "role", "key"]
    dealt = in_blocks(turns.select(*order, _code().alias("code")), order, rows_per_block)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("block").agg(F.count("*").alias("rows")).select(
        "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("block").orderBy(*order, "tie")
    ranked = stored(dealt.join(starts, "block").select(
        *order, "code", (F.col("rows_before") + F.row_number().over(inside)).alias("rank")))
    said = ranked.groupBy("conv_id", "role", "key").agg(F.min("rank").alias("rank")).select(
        "rank", F.lit(True).alias("new"))
    convs = ranked.groupBy(F.col("conv_id").alias("c")).agg(
        F.min("rank").alias("first"), F.count("*").alias("turns"))
    code = F.when(F.col("new") | ((F.col("code").bitwiseAND(BLANK)) != 0), F.col("code")).otherwise(
        F.col("code").bitwiseAND(3) + DUPLICATE)
    placed = ranked.join(said, "rank", "left").join(
        convs, F.col("conv_id").eqNullSafe(F.col("c"))).withColumn(
        "place", F.col("rank") - F.col("first")).withColumn("new", F.coalesce("new", F.lit(False)))
    return stored(placed.withColumn("part", F.floor(F.col("place") / block)).groupBy(
        "conv_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("place", code.alias("code")))).alias("coded"),
        F.min_by(F.struct("turn", "role", "key"), "place").alias("head"),
        F.ceil(F.first("turns") / block).alias("parts")).select(
        "conv_id", "part", "parts", "head", F.col("coded.code").alias("codes")))


def _chained(rows: DataFrame, backward: bool, step: Callable, schema: str,
             *names: str) -> DataFrame:
    """``step`` along the blocks of every conversation, carrying one value; a conversation
    is a stream of small rows, never held as a whole."""
    dealt = rows.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("part").desc() if backward else F.col("part").asc())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, carried = (), None
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if (row["conv_id"],) != held:
                    held, carried = (row["conv_id"],), None
                values, carried = step(row, carried)
                made.append(values)
            yield _with(batch, made, *names)

    return mapped(dealt, walk, schema)


KINDS = {"costs": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()),
         "found": pa.list_(pa.int64()), "plans": pa.list_(pa.string()),
         "lasts": pa.list_(pa.int64()), "cost": pa.int64(), "plan": pa.string()}


def _with(batch: pa.RecordBatch, values: list[dict], *names: str) -> pa.RecordBatch:
    """The batch with columns added."""
    added = [pa.array([v[name] for v in values], KINDS[name]) for name in names]
    return pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])


HEAD = "head struct<turn: long, role: string, key: string>"
BLOCKS = f"conv_id long, part long, parts long, {HEAD}, codes array<int>"


def _priced(row: dict, after: list[int] | None) -> tuple[dict, list[int]]:
    """The cost of all that follows a block, by state; carried on across the block."""
    ends = list(CLOSED) if after is None else after
    costs = row["costs"]
    return {"ends": ends}, [min(costs[4 * s + t] + ends[t] for t in range(4)) for s in range(4)]


def _searched(row: dict) -> dict:
    """The answers of a block from every state in which it can be entered."""
    answers = [cheapest(bytes(row["codes"]), s, tuple(row["ends"]))
               for s in range(4 if row["part"] else 1)]
    last = row["part"] == row["parts"] - 1
    plans = [plan + _closing(at) if last else plan for _, plan, at in answers]
    return {"found": [a[0] for a in answers], "plans": plans, "lasts": [a[2] for a in answers]}


def _closing(state: int) -> str:
    letters = ""
    for _ in range(CLOSING[state]):
        letters += TURN[state]
        state = NEXT[state]
    return letters


def _picked(row: dict, state: int | None) -> tuple[dict, int]:
    """The answer of a block from the state its predecessor left."""
    state = state or START
    return ({"cost": row["found"][state], "plan": row["plans"][state]}, row["lasts"][state])


def plans(conversations: DataFrame, block: int = BLOCK, rows_per_block: int = 50_000) -> DataFrame:
    """The edits of every block of turns, as a plan: u and a insert an empty turn, K keeps
    the next turn, D deletes it, U and A give it to user or assistant.

    A conversation of one block is one search. For a longer one the blocks' costs from
    state to state are chained from its end, every block is searched on its own under the
    exact cost of all that follows, and a walk from the start picks the answers that meet.
    """
    blocks = _blocks(_turns(conversations), block, rows_per_block)
    one = blocks.where("parts = 1").withColumn("ends", F.array(*map(F.lit, CLOSED)).cast(
        "array<long>"))
    several = blocks.where("parts > 1")

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _with(batch, [{"costs": block_costs(bytes(codes))}
                                for codes in batch.column("codes").to_pylist()], "costs")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _with(batch, [_searched(row) for row in batch.to_pylist()],
                        "found", "plans", "lasts")

    priced = mapped(several, price, BLOCKS + ", costs array<long>")
    priced = _chained(priced, True, _priced, BLOCKS + ", costs array<long>, ends array<long>",
                      "ends")
    ready = one.unionByName(priced.drop("costs").repartition("conv_id", "part"))
    answers = BLOCKS + (", ends array<long>, found array<long>, plans array<string>, "
                        "lasts array<long>")
    found = stored(mapped(ready, search, answers))
    whole = found.where("parts = 1").withColumn("cost", F.col("found")[0]).withColumn(
        "plan", F.col("plans")[0])
    chained = _chained(found.where("parts > 1"), False, _picked,
                       answers + ", cost long, plan string", "cost", "plan")
    return whole.unionByName(chained).select("conv_id", "part", "head", "codes", "cost", "plan")


STREAM = ["conv_id", "turn", "role", "key", "kind", "part", "text", "codes", "cost", "plan"]


def _stream(conversations: DataFrame, block: int, rows_per_block: int) -> DataFrame:
    """Turns and plans in one sorted stream, each plan before its block's first turn."""
    edits = plans(conversations, block, rows_per_block).select(
        "conv_id", "head.turn", "head.role", "head.key", F.lit(0).alias("kind"), "part",
        F.lit(None).cast("string").alias("text"), "codes", "cost", "plan")
    turns = _turns(conversations).select(
        "conv_id", "turn", "role", "key", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("part"),
        "text", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("cost"),
        F.lit(None).cast("string").alias("plan"))
    return edits.unionByName(turns).repartition("conv_id").sortWithinPartitions(
        "conv_id", "turn", "role", "key", "kind", "part").select(*STREAM)


class _Editor:
    """The turns of one conversation, edited as they pass by."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.plans: list[str] = []
        self.plan, self.at = "", 0
        self.blank = self.duplicate = self.truncated = 0
        self.cost = None
        self.audit: list[str] = []
        self.illegal, self.initial = 0, None
        self.turns = 0
        self.first = self.last = None

    def expect(self, codes: list[int], cost: int, plan: str) -> None:
        # Equal turns may bring the plans of later blocks along before their time.
        self.plans.append(plan)
        for c in codes:
            self.blank += c & BLANK > 0
            self.duplicate += c & DUPLICATE > 0
            self.truncated += c & TRUNCATED > 0
        if self.cost is None:
            self.cost = cost
        self.audit.append("".join("I" if p.islower() else "R" if p in "UA" else p for p in plan))

    def turn(self, turn: int | None, role: str, text: str) -> Iterator[tuple[str, str]]:
        """The turns that take this one's place."""
        if turn is not None:
            if self.last != turn:
                self.turns += 1
            if self.first is None:
                self.first = turn
            self.last = turn
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        yield from self._inserted()
        step = self.plan[self.at]
        self.at += 1
        if step == "K":
            yield role, text
        elif step != "D":
            yield ("user" if step == "U" else "assistant"), text

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while True:
            if self.at == len(self.plan):
                if not self.plans:
                    return
                self.plan, self.at = self.plans.pop(0), 0
            if self.plan[self.at:self.at + 1].isupper():
                return
            while self.at < len(self.plan) and self.plan[self.at].islower():
                yield ("user" if self.plan[self.at] == "u" else "assistant"), ""
                self.at += 1

    def close(self) -> Iterator[tuple[str, str]]:
        """The turns inserted at the very end."""
        yield from self._inserted()


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Editor, str | None, str | None]]:
    """Editor, role and text of every turn after the edits; role None ends a conversation."""
    editor = None
    for batch in batches:
        for conv_id, turn, role, _, kind, _, text, codes, cost, plan in zip(
                *(c.to_pylist() for c in batch.columns)):
            if editor is None or editor.conv_id != conv_id:
                if editor is not None:
                    yield from ((editor, r, t) for r, t in editor.close())
                    yield editor, None, None
                editor = _Editor(conv_id)
            if kind == 0:
                editor.expect(codes, cost, plan)
            else:
                yield from ((editor, r, t) for r, t in editor.turn(turn, role, text))
    if editor is not None:
        yield from ((editor, r, t) for r, t in editor.close())
        yield editor, None, None


def repaired(conversations: DataFrame, block: int = BLOCK,
             rows_per_block: int = 50_000) -> DataFrame:
    """The repaired conversations: conv_id, place, role and text of every turn they keep or
    get. Same order, nulls and edits as in ``audited``."""

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = place = 0
        for editor, role, text in _edited(batches):
            if role is None:
                place = 0
                continue
            rows.append((editor.conv_id, place, role, text))
            place += 1
            size += len(text)
            if len(rows) >= 5000 or size > 1 << 22:
                yield _rows(rows)
                rows, size = [], 0
        yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        ids, places, roles, texts = zip(*rows) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(roles, pa.string()),
             pa.array(texts, pa.string())], ["conv_id", "place", "role", "text"])

    return mapped(_stream(conversations, block, rows_per_block), turns,
                  "conv_id long, place long, role string, text string")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def audited(conversations: DataFrame, every: DataFrame | None = None, block: int = BLOCK,
            rows_per_block: int = 50_000) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired turns of every conversation of
    ``every`` (of ``conversations`` if none), one row each.

    Turns are ordered by turn (null first), then role and MD5 of the text. A null role or
    text is one space, so such a text is blank; blank texts and repeats of role and text
    must go. A null conv_id is a conversation like any other. A conversation without turns
    has zeros, an empty audit and the digest of nothing; an empty table has no rows; other
    columns are not read. Blocks spread over tasks whatever a conversation's length; the
    digest of one conversation is one stream of its turns, held one at a time.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        running, lines = hashlib.sha256(), 0
        for editor, role, text in _edited(batches):
            if role is not None:
                running.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1
                continue
            gaps = 0 if editor.first is None else editor.last - editor.first + 1 - editor.turns
            done.append((editor.conv_id, gaps, editor.blank, editor.duplicate, editor.truncated,
                         editor.illegal, editor.cost, "".join(editor.audit), running.hexdigest()))
            running, lines = hashlib.sha256(), 0
            if len(done) >= 1000:
                yield _rows(done)
                done = []
        yield _rows(done)

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * 9
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          ["conv_id", *COUNTS, "audit", "repaired_sha256"])

    found = mapped(_stream(conversations, block, rows_per_block), digest,
                   "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS)
                   + ", audit string, repaired_sha256 string")
    ids = (conversations if every is None else every).select(
        F.col("conv_id").cast("long")).distinct()
    found = found.withColumnRenamed("conv_id", "_id")
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


#: The same rows for the table ``conversations``: the cheapest edits of the turns so far, by
#: state, one turn after another.
SQL = f"""
with recursive fated as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {CRC32.format(
    "(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '))")} % 20 as fate
  from conversations),
damaged as (
  select conv_id, turn, case when fate = 4 then 'user' else role end as role,
         case fate when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
  from fated, (values (0), (1)) copies(copy)
  where fate <> 0 and (copy = 0 or fate = 3)),
placed as (
  select *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as trimmed,
         row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) as place
  from damaged),
coded as (
  select *, left(role, 1) as initial,
         case when trimmed = '' then 'blank'
              when row_number() over (partition by conv_id, role, text order by place) > 1 then 'duplicate'
              when right(trimmed, 1) not in ('.', '!', '?') then 'truncated' end as fault,
         lag(left(role, 1)) over (partition by conv_id order by place) || left(role, 1) as pair
  from placed),
inserts(state, letters, lines, after) as (values
  (0, '', [], 0), (0, 'I', ['user:'], 2), (0, 'II', ['user:', 'assistant:'], 3),
  (1, '', [], 1), (1, 'I', ['user:'], 2), (1, 'II', ['user:', 'assistant:'], 3),
  (2, '', [], 2), (2, 'I', ['assistant:'], 3), (2, 'II', ['assistant:', 'user:'], 2),
  (3, '', [], 3), (3, 'I', ['user:'], 2), (3, 'II', ['user:', 'assistant:'], 3)),
edits(after, letter, initial, role, next, cost) as (values
  (0, 'K', 's', null, 1, 0), (0, 'K', 'u', null, 2, 0), (1, 'K', 'u', null, 2, 0),
  (2, 'K', 'a', null, 3, 0), (3, 'K', 'u', null, 2, 0),
  (0, 'R', null, 'user', 2, 1), (1, 'R', null, 'user', 2, 1), (2, 'R', null, 'assistant', 3, 1),
  (3, 'R', null, 'user', 2, 1),
  (0, 'D', null, null, 0, 2), (1, 'D', null, null, 1, 2), (2, 'D', null, null, 2, 2),
  (3, 'D', null, null, 3, 2)),
walked as (
  select distinct conv_id, cast(0 as bigint) as place, 0 as state, '0000000000' as best,
         cast([] as varchar[]) as lines
  from conversations
  union all
  select conv_id, place, next, min(best), arg_min(lines, best)
  from (
    select w.conv_id, c.place, e.next, list_concat(w.lines, i.lines, case e.letter
             when 'D' then [] else [coalesce(e.role, c.role) || ':' || c.text] end) as lines,
           lpad(cast(cast(left(w.best, 10) as bigint) + 5 * len(i.letters) + e.cost
                + case when c.fault = 'truncated' and e.letter <> 'D' then 5 else 0 end as varchar), 10, '0')
           || substr(w.best, 11) || i.letters || e.letter as best
    from walked w
    join coded c on c.conv_id is not distinct from w.conv_id and c.place = w.place + 1
    join inserts i on i.state = w.state
    join edits e on e.after = i.after and coalesce(e.initial, c.initial) = c.initial
                and (e.letter = 'D' or coalesce(c.fault, '') not in ('blank', 'duplicate')))
  group by conv_id, place, next),
lengths as (
  select o.conv_id, max(place) as n, max(turn) - min(turn) + 1 - count(distinct turn) as gaps,
         count(*) filter (where fault = 'blank') as blank,
         count(*) filter (where fault = 'duplicate') as duplicate,
         count(*) filter (where fault = 'truncated') as truncated,
         count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal
  from (select distinct conv_id from conversations) o
  left join coded c on c.conv_id is not distinct from o.conv_id
  group by o.conv_id),
ended as (
  select w.conv_id, min(lpad(cast(cast(left(best, 10) as bigint) + 5 * len(letters) as varchar), 10, '0')
                        || substr(best, 11) || letters) as best,
         arg_min(list_concat(w.lines, i.lines),
                 lpad(cast(cast(left(best, 10) as bigint) + 5 * len(letters) as varchar), 10, '0')
                 || substr(best, 11) || letters) as lines
  from walked w
  join lengths l on l.conv_id is not distinct from w.conv_id and w.place = coalesce(l.n, 0)
  join inserts i on i.state = w.state and i.after in (0, 3)
  group by w.conv_id)
select l.conv_id, coalesce(gaps, 0) as gaps, blank, duplicate, truncated, illegal,
       cast(left(best, 10) as bigint) as cost, substr(best, 11) as audit,
       sha256(array_to_string(lines, chr(10))) as repaired_sha256
from lengths l join ended e on e.conv_id is not distinct from l.conv_id
"""
