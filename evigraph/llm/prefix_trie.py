"""Prefix tries of conversations as double arrays, one per prefix shard.

A conversation is a sequence of turns, cut into segments so that any length fits. Equal
segments below equal prefixes are one sequence with a count. A shard holds whole groups of
sequences that agree in their first turns; where such a group is large, more turns are
compared. Nodes above that point can lie in several shards: their partial aggregates are
merged by node, and the subtrees below are added to them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.common import groups_of, mapped, stored
from evigraph.llm.sharding import in_blocks

#: Turns of one segment, and of one shard's sequences: what one task holds at a time.
SEGMENT = 4096
SHARD_TURNS = 1 << 15
FREE = -1
NO_MEMBERS = hashlib.sha256().hexdigest()


class DoubleArray:
    """A trie in two arrays: the child of node s by code c is t = base[s] + c, if check[t]
    is s. Node 0 is the root. Codes are dealt in the order in which the turns first appear,
    level by level, so that siblings have neighbouring codes and arrays stay short."""

    def __init__(self, turns: np.ndarray, starts: np.ndarray, alphabet: int):
        lengths = np.diff(starts)
        self.code_of = np.full(alphabet, FREE, np.int64)
        self.codes = 0
        self.base = np.zeros(64 + alphabet, np.int64)
        self.check = np.full(64 + alphabet, FREE, np.int64)
        self.check[0] = -2
        self.low, self.end = 1, 1
        at = np.zeros(len(lengths), np.int64)
        for depth in range(int(lengths.max(initial=0))):
            active = np.flatnonzero(lengths > depth)
            pairs, own = np.unique(at[active] * alphabet + turns[starts[active] + depth],
                                   return_inverse=True)
            at[active] = self._add(pairs // alphabet, pairs % alphabet)[own]

    def _add(self, parents: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Places of new children, given as sorted, distinct (parent, turn)."""
        fresh, first = np.unique(turns[self.code_of[turns] == FREE], return_index=True)
        self.code_of[fresh[np.argsort(first)]] = self.codes + np.arange(len(fresh))
        self.codes += len(fresh)
        codes = self.code_of[turns]
        order = np.lexsort((codes, parents))
        parents_, codes_ = parents[order], codes[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(parents_)) + 1, [len(parents_)]))
        sizes = np.diff(cuts)
        slots = np.zeros(len(parents_), np.int64)
        for a, b in zip(cuts[:-1][sizes > 1].tolist(), cuts[1:][sizes > 1].tolist()):
            slots[a:b] = self._fit(codes_[a:b])
            self.check[slots[a:b]] = parents_[a]
        single = cuts[:-1][sizes == 1]
        slots[single] = self._free(len(single))
        self.check[slots[single]] = parents_[single]
        self.base[parents_] = slots - codes_
        if len(slots):
            self.end = max(self.end, int(slots.max()) + 1)
        back = np.empty(len(slots), np.int64)
        back[order] = slots
        return back

    def _grow(self, size: int) -> None:
        if size > len(self.base):
            more = max(size, 2 * len(self.base)) - len(self.base)
            self.base = np.concatenate((self.base, np.zeros(more, np.int64)))
            self.check = np.concatenate((self.check, np.full(more, FREE, np.int64)))

    def _fit(self, codes: np.ndarray) -> np.ndarray:
        """The first free places that keep the distances of several codes."""
        while self.low < self.end and self.check[self.low] != FREE:
            self.low += 1
        gaps = self.low + np.flatnonzero(self.check[self.low:self.end] == FREE)[:256]
        self._grow(self.end + int(codes[-1] - codes[0]) + 1)
        for gap in (*gaps.tolist(), self.end):
            slots = codes + (gap - codes[0])
            if slots[-1] >= len(self.check):
                self._grow(int(slots[-1]) + 1)
            if (self.check[slots] == FREE).all():
                self.end = max(self.end, int(slots[-1]) + 1)
                return slots
        raise AssertionError("the end is free")

    def _free(self, count: int) -> np.ndarray:
        gaps = self.low + np.flatnonzero(self.check[self.low:self.end] == FREE)[:count]
        self._grow(self.end + count)
        return np.concatenate((gaps, self.end + np.arange(count - len(gaps))))

    def step(self, nodes: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Children of ``nodes`` by ``turns``; FREE where there is none."""
        codes = self.code_of[turns]
        places = self.base[nodes] + codes
        inside = (codes != FREE) & (places > 0) & (places < len(self.check))
        found = np.where(inside, places, 0)
        return np.where(inside & (self.check[found] == nodes), found, FREE)


def _numbered(conversations: DataFrame, rows_per_block: int) -> DataFrame:
    """conv_id, rank over all rows in order, and the turn's keys and size."""
    role = F.coalesce(F.col("role"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"), F.md5(text).alias("text_key"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(text, role).alias("b"),
        F.length(text).alias("size"))
    order = ["conv_id", "turn", "role", "text_key"]
    blocks = in_blocks(rows, order, rows_per_block)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.groupBy("block").agg(F.count("*").alias("rows")).select(
        "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("block").orderBy(*order, "tie")
    return blocks.join(starts, "block").select(
        "conv_id", (F.col("rows_before") + F.row_number().over(inside)).alias("rank"),
        "a", "b", "size")


def rebuilt(conversations: DataFrame, rows_per_block: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, place, a, b, size) of the rebuilt conversations, and the
    conversations with their length.

    Conversation c takes the first h turns of conversation c - c % 100, h being the CRC-32
    of its digits mod 6, and goes on with its own turns after its first h."""
    ranked = stored(_numbered(conversations, rows_per_block))
    own = stored(ranked.groupBy("conv_id").agg(F.min("rank").alias("first"),
                                               F.count("*").alias("n")))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    base = F.col("conv_id") - F.col("conv_id") % 100
    convs = own.withColumn("h", h).withColumn("base", base).join(
        own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left"
    ).withColumn("kept", F.least("h", F.coalesce("n_base", F.lit(0)))).select(
        "conv_id", "base", "first", "h", "kept",
        (F.col("kept") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    convs = stored(convs)
    turns = ranked.join(convs, "conv_id").withColumn("at", F.col("rank") - F.col("first"))
    tails = turns.where("at >= h").select(
        "conv_id", (F.col("at") - F.col("h") + F.col("kept")).alias("place"), "a", "b", "size",
        "length")
    heads = turns.where("conv_id % 100 = 0 and at < 5").select(
        F.col("conv_id").alias("base"), F.col("at").alias("place"), "a", "b", "size")
    heads = convs.where("kept > 0").join(heads, "base").where("place < h").select(*tails.columns)
    return tails.unionByName(heads), convs


def _sequences(turns: DataFrame, convs: DataFrame, segment: int) -> tuple[DataFrame, int]:
    """The distinct segments with the number and the least of their conversations, the
    digest of those that end with it, and the number of segments of the longest."""
    parts = turns.withColumn("part", F.floor(F.col("place") / segment).cast("int")).groupBy(
        "conv_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("place", "a", "b", "size"))).alias("t"),
        F.max("length").alias("length"))
    parts = parts.select("conv_id", "part", "length", F.col("t.a").alias("a"),
                         F.col("t.b").alias("b"), F.col("t.size").alias("size"))
    none = F.array().cast("array<long>")
    parts = parts.unionByName(convs.where("length = 0").select(
        "conv_id", F.lit(0).alias("part"), "length", none.alias("a"), none.alias("b"),
        F.array().cast("array<int>").alias("size")))
    parts = parts.withColumn("x", F.xxhash64("part", "a", "b")).withColumn(
        "y", F.xxhash64("b", "part", "a"))
    longest = convs.agg(F.max("length")).first()[0] or 0
    count = max(1, math.ceil(longest / segment))
    if count > 1:
        earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(
            Window.unboundedPreceding, -1)
        above = [F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"above_{c}")
                 for c in "xy"]
    else:
        above = [F.lit(0).cast("long").alias(f"above_{c}") for c in "xy"]
    ended = F.col("length") <= (F.col("part") + 1) * segment
    parts = stored(parts.select(
        "*", ended.alias("ended"), *above).withColumn(
        "end_x", F.col("above_x").bitwiseXOR(F.col("x"))).withColumn(
        "end_y", F.col("above_y").bitwiseXOR(F.col("y"))))
    groups = parts.groupBy("part", "above_x", "above_y", "end_x", "end_y").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("least"),
        F.first("a").alias("a"), F.first("b").alias("b"), F.first("size").alias("size"))
    digests = _digests(parts.where("ended").select("end_x", "end_y", "conv_id"))
    return stored(groups.join(digests, ["end_x", "end_y"], "left")), count


def _digests(ended: DataFrame, rows_per_block: int = 50_000) -> DataFrame:
    """SHA-256 of the comma-joined ids per group: blocks of a sort join theirs, and the
    pieces of a group, in order, go through one running digest, never held together."""
    groups = ended.groupBy("end_x", "end_y").agg(F.count("*").alias("n"),
                                                 F.min("conv_id").alias("only"))
    groups = stored(groups)
    single = groups.where("n = 1").select("end_x", "end_y", F.sha2(
        F.col("only").cast("string"), 256).alias("ends_sha256"))
    many = ended.join(groups.where("n > 1").select("end_x", "end_y"), ["end_x", "end_y"],
                      "left_semi")
    pieces = in_blocks(many, ["end_x", "end_y", "conv_id"], rows_per_block).groupBy(
        "end_x", "end_y", "block").agg(F.array_join(F.transform(F.sort_array(
            F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    dealt = pieces.repartition("end_x", "end_y").sortWithinPartitions("end_x", "end_y", "block")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, running = None, None
        done: list[tuple] = []
        for batch in batches:
            for x, y, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (x, y) == held:
                    running.update(b",")
                else:
                    if held is not None:
                        done.append((*held, running.hexdigest()))
                    held, running = (x, y), hashlib.sha256()
                running.update(ids.encode())
            yield _digest_rows(done)
            done = []
        if held is not None:
            yield _digest_rows([(*held, running.hexdigest())])

    return single.unionByName(mapped(dealt.select("end_x", "end_y", "ids"), digested,
                                     "end_x long, end_y long, ends_sha256 string"))


def _digest_rows(done: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*done)) or [(), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
         pa.array(columns[2], pa.string())], ["end_x", "end_y", "ends_sha256"])


def _prefix(level: Column | int) -> Column:
    return F.xxhash64(F.slice("a", 1, level), F.slice("b", 1, level))


def _sharded(sequences: DataFrame, shard_turns: int) -> DataFrame:
    """``sequences`` with ``level``, the number of first turns that their group shares, and
    the shard. Groups of more than ``shard_turns`` are told apart by twice as many turns,
    until none is left; a sequence shorter than its level is a group of its own."""
    total = sequences.agg(F.sum(F.size("a") + 1)).first()[0] or 0
    dealt = sequences.withColumn("level", F.lit(1)).withColumn("prefix", _prefix(1))
    key, level = ["above_x", "above_y", "prefix"], 1
    while True:
        large = stored(dealt.where((F.col("level") == level) & (F.size("a") >= level)).groupBy(
            *key).agg(F.sum(F.size("a")).alias("turns")).where(F.col("turns") > shard_turns)
            .select(*key, F.lit(True).alias("large")))
        if large.isEmpty():
            break
        split = F.col("large") & (F.col("level") == level)
        dealt = dealt.join(large, key, "left").withColumn("large", F.coalesce(split, F.lit(False)))
        dealt = dealt.withColumn("prefix", F.when(F.col("large"), _prefix(2 * level)).otherwise(
            F.col("prefix"))).withColumn("level", F.when(F.col("large"), 2 * level).otherwise(
                F.col("level"))).drop("large")
        level *= 2
    shards = max(1, math.ceil(total / shard_turns))
    return dealt.withColumn("shard", F.pmod(
        F.xxhash64(*key, "level"), F.lit(shards)).cast("int"))


NODE = ("id binary, parent_id binary, ancestors array<binary>, above_x long, above_y long, "
        "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, size long, ends_sha256 string, end_x long, end_y long")
_IN = ["shard", "level", "above_x", "above_y", "a", "b", "size", "n", "least", "ends_sha256",
       "end_x", "end_y", "more_children", "more_leaves", "more_saved"]


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and starts of a list column."""
    column = column.combine_chunks()
    starts = np.asarray(column.offsets)[:len(column) + 1].astype(np.int64)
    return np.asarray(column.values)[starts[0]:starts[-1]], starts - starts[0]


def _shard_arrays(rows: pa.Table) -> tuple[DoubleArray, np.ndarray, np.ndarray, np.ndarray]:
    """The double array of a shard, the dense turn ids of its sequences, where each starts,
    and the keys; the first id of a sequence stands for all that comes before its segment."""
    a, starts = _lists(rows.column("a"))
    b, _ = _lists(rows.column("b"))
    m = len(starts) - 1
    keys = np.zeros((len(a) + m, 2), np.int64)
    heads = starts[:-1] + np.arange(m)
    inner = np.ones(len(keys), bool)
    inner[heads] = False
    keys[inner, 0], keys[inner, 1] = a, b
    keys[heads, 0] = np.asarray(rows.column("above_x"))
    keys[heads, 1] = np.asarray(rows.column("above_y"))
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    new = np.concatenate(([0], np.any(np.diff(keys[order], axis=0), axis=1).cumsum()))
    turns = np.empty(len(keys), np.int64)
    turns[order] = new[:len(keys)]
    starts = starts + np.arange(m + 1)
    return DoubleArray(turns, starts, int(turns.max(initial=0)) + 1), turns, starts, keys


def _nodes(rows: pa.Table, first_depth: int) -> pa.RecordBatch:
    """The nodes of one shard, by a walk of all its sequences through the double array.

    Nodes at or below their group's level are complete but for the merge of their parent;
    those above come with an id and what this shard knows of them."""
    trie, turns, starts, keys = _shard_arrays(rows)
    size, _ = _lists(rows.column("size"))
    level = np.asarray(rows.column("level")).astype(np.int64)
    n = np.asarray(rows.column("n"))
    least = np.asarray(rows.column("least"))
    lengths = np.diff(starts)
    slots = trie.end
    count, first = np.zeros(slots, np.int64), np.full(slots, np.iinfo(np.int64).max)
    shared, depth_of = np.zeros(slots, bool), np.zeros(slots, np.int64)
    last, through = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    leaves, saved = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    at, levels = np.zeros(len(lengths), np.int64), []
    ends = np.zeros(len(lengths), np.int64)
    for depth in range(int(lengths.max(initial=0))):
        active = np.flatnonzero(lengths > depth)
        at[active] = trie.step(at[active], turns[starts[active] + depth])
        here = at[active]
        np.add.at(count, here, n[active])
        np.minimum.at(first, here, least[active])
        shared[here] = depth < level[active]
        depth_of[here] = depth
        through[here] = active
        if depth:
            last[here] = size[starts[active] - active + depth - 1]
        levels.append(np.unique(here))
        done = active[lengths[active] == depth + 1]
        ends[done] = at[done]
    children = np.bincount(trie.check[:slots][trie.check[:slots] > 0], minlength=slots)
    np.add.at(children, ends, np.asarray(rows.column("more_children")))
    np.add.at(leaves, ends, np.asarray(rows.column("more_leaves")))
    np.add.at(saved, ends, np.asarray(rows.column("more_saved")))
    whole = ~shared
    leaves[whole & (children == 0)] += 1
    saved[whole] += (count[whole] - 1) * last[whole]
    parent = trie.check[:slots]
    for nodes in reversed(levels):
        nodes = nodes[whole[nodes]]
        nodes = nodes[whole[parent[nodes]]]
        np.add.at(leaves, parent[nodes], leaves[nodes])
        np.add.at(saved, parent[nodes], saved[nodes])
    # What other shards may know too: a node's own further children, from the next segment.
    more = np.zeros(slots, np.int64)
    np.add.at(more, ends, np.asarray(rows.column("more_children")))
    children[shared] = more[shared]
    ended = np.full(slots, -1)
    ended[ends] = np.arange(len(ends))
    every = np.concatenate(levels) if levels else np.zeros(0, np.int64)
    names: dict[int, tuple] = {}
    for node in every[shared[every]].tolist():
        s, d = through[node], depth_of[node]
        key = keys[starts[s] + d].tobytes()
        if d == 0:
            names[node] = (hashlib.blake2b(key, digest_size=16), [])
        else:
            above, chain = names[int(parent[node])]
            digest = above.copy()
            digest.update(key)
            names[node] = (digest, [*chain, above.digest()])
    ids, parents, chains = [], [], []
    for node in every.tolist():
        if node in names:
            digest, chain = names[node]
            ids.append(digest.digest())
        else:
            ids.append(None)
            above = names.get(int(parent[node]))
            chain = [*above[1], above[0].digest()] if above else None
        chains.append(chain)
        parents.append(chain[-1] if chain else None)
    inner = np.array([c is None for c in chains], bool)
    end = ended[every]
    end_rows = rows.select(["ends_sha256", "end_x", "end_y"]).take(
        pa.array(np.maximum(end, 0), mask=end < 0))
    seq = through[every]
    return pa.Table.from_arrays([
        pa.array(ids, pa.binary()), pa.array(parents, pa.binary()),
        pa.array(chains, pa.list_(pa.binary())),
        rows.column("above_x").take(pa.array(seq)), rows.column("above_y").take(pa.array(seq)),
        pa.array(depth_of[every] + first_depth), pa.array(first[every]),
        pa.array(first[np.maximum(parent[every], 0)], mask=~inner), pa.array(count[every]),
        pa.array(children[every]), pa.array(leaves[every]), pa.array(saved[every]),
        pa.array(last[every]), *end_rows.columns,
    ], names=[c.split()[0] for c in NODE.split(", ")]).combine_chunks().to_batches()[0]


def packed(conversations: DataFrame, segment: int = SEGMENT,
           shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The tries themselves: per part and shard BASE, CHECK and the two keys of every code.

    A lookup starts at node 0 with the code of (above_x, above_y) and follows a turn's code
    c from node s to base[s] + c, as long as check of that place is s."""
    sequences, _ = _sequences(*rebuilt(conversations), segment)
    dealt = _sharded(sequences, shard_turns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups_of(batches):
            trie, turns, _, keys = _shard_arrays(rows)
            by_code = np.zeros((trie.codes, 2), np.int64)
            by_code[trie.code_of[turns]] = keys
            yield pa.RecordBatch.from_arrays([
                rows.column("part").slice(0, 1).combine_chunks(),
                rows.column("shard").slice(0, 1).combine_chunks(),
                *(pa.array([v.tolist()], pa.list_(pa.int64())) for v in (
                    trie.base[:trie.end], trie.check[:trie.end], by_code[:, 0], by_code[:, 1]))],
                ["part", "shard", "base", "check", "code_a", "code_b"])

    rows = dealt.select(F.concat_ws("-", "part", "shard").alias("name"), "part", "shard", "above_x",
                        "above_y", "a", "b").repartition("name").sortWithinPartitions("name")
    return mapped(rows, pack, "part int, shard int, base array<long>, check array<long>, "
                              "code_a array<long>, code_b array<long>")


def nodes(conversations: DataFrame, segment: int = SEGMENT, shard_turns: int = SHARD_TURNS,
          rows_per_block: int = 50_000) -> DataFrame:
    """One row per distinct sequence of first turns of the rebuilt conversations.

    Turns are ordered by turn (null first), then role and MD5 of the text; a null role or
    text is empty, repeated rows are turns of their own. Rows with a null conv_id take no
    part. A conversation without turns is a member of the root alone. An empty table has no
    nodes, not even a root; other columns are not read. Turns are told apart by two 64-bit
    hashes of role and text.
    """
    turns, convs = rebuilt(conversations, rows_per_block)
    sequences, count = _sequences(turns, convs, segment)
    dealt = stored(_sharded(sequences, shard_turns))
    found, below = [], None
    for part in reversed(range(count)):
        rows = dealt.where(F.col("part") == part)
        more = ["more_children", "more_leaves", "more_saved"]
        if below is None:
            rows = rows.select("*", *[F.lit(0).cast("long").alias(c) for c in more])
        else:
            rows = rows.join(below, ["end_x", "end_y"], "left").withColumns(
                {c: F.coalesce(c, F.lit(0)) for c in more})
        first_depth = part * segment

        def walk(batches: Iterator[pa.RecordBatch], first_depth: int = first_depth
                 ) -> Iterator[pa.RecordBatch]:
            for _, shard in groups_of(batches):
                yield _nodes(shard, first_depth)

        raw = stored(mapped(rows.select(*_IN).repartition("shard").sortWithinPartitions("shard"),
                            walk, NODE))
        merged = _merged(raw)
        found.append(merged if part == 0 else merged.where(F.col("depth") > first_depth))
        if part:
            below = stored(merged.where(F.col("depth") == first_depth).select(
                F.col("above_x").alias("end_x"), F.col("above_y").alias("end_y"),
                F.col("n_children").alias("more_children"),
                F.col("n_leaves").alias("more_leaves"), F.col("saved_tokens").alias("more_saved")))
    for i in range(len(found) - 1):
        ends = found[i + 1].where(F.col("depth") == (count - 1 - i) * segment).select(
            F.col("end_x").alias("above_x"), F.col("end_y").alias("above_y"),
            F.col("conv_id").alias("upper"))
        found[i] = found[i].join(ends, ["above_x", "above_y"]).withColumn(
            "parent_conv_id", F.when(F.col("depth") == (count - 1 - i) * segment + 1,
                                     F.col("upper")).otherwise(F.col("parent_conv_id")))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
           "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256")]
    result = found[0].select(*out)
    for other in found[1:]:
        result = result.unionByName(other.select(*out))
    return result


def _merged(raw: DataFrame) -> DataFrame:
    """The nodes of all shards: those known to several are merged, and what lies below the
    levels of the shards is added to every node above."""
    columns = [c for c in raw.columns if c not in ("id", "parent_id", "ancestors")]
    shared = raw.where("id is not null").groupBy("id").agg(
        F.first("parent_id").alias("parent_id"), F.first("ancestors").alias("ancestors"),
        *[F.first(c).alias(c) for c in ("above_x", "above_y", "depth", "size")],
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        *[F.max(c).alias(c) for c in ("ends_sha256", "end_x", "end_y")],
        *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    shared = stored(shared)
    tops = raw.where("id is null and parent_id is not null")
    kids = shared.where("parent_id is not null").select("parent_id").unionByName(
        tops.select("parent_id")).groupBy(F.col("parent_id").alias("id")).agg(
        F.count("*").alias("kids"))
    counted = stored(shared.join(kids, "id", "left").withColumn(
        "n_children", F.col("n_children") + F.coalesce("kids", F.lit(0))).withColumn(
        "n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).withColumn(
        "saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size")).drop("kids"))
    given = counted.select(F.concat("ancestors", F.array("id")).alias("to"), "n_leaves",
                           "saved_tokens").unionByName(
        tops.select(F.col("ancestors").alias("to"), "n_leaves", "saved_tokens"))
    sums = given.select(F.explode("to").alias("id"), "n_leaves", "saved_tokens").groupBy("id").agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    upper = counted.drop("n_leaves", "saved_tokens").join(sums, "id")
    names = counted.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("upper_id"))
    edge = upper.withColumn("parent_conv_id", F.lit(None).cast("long")).select(
        "parent_id", *columns).unionByName(tops.select("parent_id", *columns))
    edge = edge.join(names, "parent_id", "left").withColumn("parent_conv_id", F.col("upper_id"))
    return edge.select(*columns).unionByName(
        raw.where("id is null and parent_id is null").select(*columns))


#: CRC-32 of a string column, as DuckDB has none.
CRC32 = ("xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}, ''), "
         "lambda c: ord(c)::bigint)), lambda s, c: list_reduce(list_prepend(xor(s, c), range(8)), "
         "lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)")

#: The same rows for the table ``conversations``.
SQL = f"""
with turns as (
  select conv_id, {{'k': md5(length(role) || ':' || role || text), 's': length(text)}} as t, place
  from (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (
      partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) as place
    from conversations where conv_id is not null)),
own as (
  select conv_id, count(*) as n, conv_id - conv_id % 100 as base,
         {CRC32.format("cast(conv_id as varchar)")} % 6 as h
  from turns group by conv_id),
convs as (
  select own.conv_id, own.base, own.h, least(own.h, coalesce(b.n, 0)) as kept
  from own left join own b on b.conv_id = own.base),
rebuilt as (
  select c.conv_id, t.place, t.t from convs c join turns t on t.conv_id = c.base where t.place <= c.h
  union all
  select c.conv_id, t.place - c.h + c.kept, t.t
  from convs c join turns t on t.conv_id = c.conv_id where t.place > c.h),
paths as (
  select c.conv_id, coalesce(p, []) as p
  from convs c left join (
    select conv_id, list(t order by place) as p from rebuilt group by conv_id) using (conv_id)),
members as (
  select conv_id, d as depth, p[1:d] as prefix, d = len(p) as ended
  from (select conv_id, p, unnest(range(len(p) + 1)) as d from paths)),
nodes as (
  select prefix, depth, min(conv_id) as conv_id, count(*) as n_convs,
         sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id)
                         filter (where ended), '')) as ends_sha256
  from members group by prefix, depth),
linked as (
  select n.*, p.conv_id as parent_conv_id, coalesce(k.n_children, 0) as n_children,
         (n.n_convs - 1) * coalesce(n.prefix[n.depth].s, 0) as own
  from nodes n
  left join nodes p on p.depth = n.depth - 1 and p.prefix = n.prefix[1:n.depth - 1]
  left join (select prefix[1:depth - 1] as prefix, count(*) as n_children
             from nodes where depth > 0 group by 1) k on k.prefix = n.prefix),
sums as (
  select prefix[1:d] as prefix, sum(own) as saved_tokens, sum(cast(n_children = 0 as int)) as n_leaves
  from (select prefix, own, n_children, unnest(range(depth + 1)) as d from linked) group by 1)
select conv_id, cast(depth as bigint) as depth, parent_conv_id, n_convs, n_children,
       cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, ends_sha256
from linked join sums using (prefix)
"""
