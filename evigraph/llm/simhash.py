"""SimHash near-duplicates: fingerprints, BK-trees over shards of them, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import mapped, stored, text_steps
from evigraph.llm.components import components

RADIUS = 3
#: 64 bits in so many bands: fingerprints RADIUS apart agree in all but RADIUS of them.
BANDS = 5
#: Fingerprints in one tree; a larger shard is several trees, each searched by all of it.
TREE = 4096


def fingerprint(text: bytes, width: int = 3) -> int:
    """The SimHash of a text's ``width``-word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    plain = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(plain, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-width])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(plain[a:b], 42) for a, b in zip(starts, (ends[width - 1:] - 1).tolist())]
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int.from_bytes(np.packbits(ones).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, a hash of the text and fp, the fingerprint as a signed number, of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for first, last, data, starts in text_steps(batch, 1):
                raw = data.tobytes()
                for i in range(first, last):
                    out[i] = fingerprint(raw[starts[i - first]:starts[i - first + 1]], width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(out.view(np.int64))],
                ["doc_id", "text_hash", "fp"])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")), hashed,
                  "doc_id long, text_hash long, fp long")


def bands(count: int = BANDS, bits: int = 64) -> list[int]:
    """Masks of ``count`` bands of neighbouring bits."""
    cuts = [bits * i // count for i in range(count + 1)]
    return [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def shard_keys(radius: int = RADIUS, count: int = BANDS) -> list[int]:
    """Masks such that fingerprints within ``radius`` agree on one of them at least."""
    return [sum(c) for c in combinations(bands(count), count - radius)]


class BKTree:
    """Fingerprints as nodes; a node's children are keyed by their distance to it."""

    def __init__(self) -> None:
        self.nodes: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.nodes.append(value)
        self.children.append({})
        if len(self.nodes) == 1:
            return
        at = 0
        while True:
            d = (self.nodes[at] ^ value).bit_count()
            down = self.children[at].get(d)
            if down is None:
                self.children[at][d] = len(self.nodes) - 1
                return
            at = down

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Places of the nodes within ``radius``, following only edges that can lead there."""
        stack = [0] if self.nodes else []
        while stack:
            at = stack.pop()
            d = (self.nodes[at] ^ value).bit_count()
            if d <= radius:
                yield at
            children = self.children[at]
            if len(children) <= 2 * radius + 1:
                stack.extend(c for e, c in children.items() if d - radius <= e <= d + radius)
            else:
                stack.extend(children[e] for e in range(d - radius, d + radius + 1)
                             if e in children)


def _star(tree: list[int], queries: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links that join whatever a search of ``tree`` by ``queries`` finds: a chain of unions
    within the two lists, so a group of n near copies gives n links, not n squared."""
    bk, root = BKTree(), {}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for value in tree:
        bk.add(value)
    for value in (*tree, *queries):
        root.setdefault(value, value)
    for value in queries:
        for at in bk.within(value, radius):
            a, b = top(value), top(bk.nodes[at])
            if a != b:
                root[max(a, b)] = min(a, b)
                yield value, bk.nodes[at]


def links(fps: DataFrame, radius: int = RADIUS, count: int = BANDS,
          tree: int = TREE) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` that join all within ``radius``.

    Each fingerprint goes to one shard per band mask; a shard of up to ``tree`` of them is
    one BK-tree, searched by its own members. A larger shard is cut by a hash into trees of
    that size at most on average, and its members visit each of them in turn: more tasks,
    the same answers. No tree is larger than a few times ``tree``, none reaches the driver.
    """
    masks = shard_keys(radius, count)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select("fp", F.posexplode(F.array(*[
        F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("mask", "key"))
    sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(sizes, ["mask", "key"]).withColumn(
        "trees", F.ceil(F.col("n") / tree).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    visits = keyed.withColumn("own", own).withColumn(
        "tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    placed = visits.select("mask", "key", "tree", "fp", (F.col("own") == F.col("tree"))
                           .alias("member"))
    placed = placed.repartition("mask", "key", "tree").sortWithinPartitions("mask", "key", "tree")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        members, visitors, out = [], [], ([], [])

        def flush() -> None:
            for a, b in _star(members, members + visitors, radius):
                out[0].append(a - (1 << 64) if a >> 63 else a)
                out[1].append(b - (1 << 64) if b >> 63 else b)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for mask, key, part, fp, member in zip(*columns):
                if (mask, key, part) != held:
                    flush()
                    held = (mask, key, part)
                    members, visitors = [], []
                (members if member else visitors).append(fp & (1 << 64) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b"])
            out = ([], [])
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b"])

    return mapped(placed, search, "a long, b long").distinct()


def _classes(docs: DataFrame, width: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their fingerprints; each distinct one with its least id and its root.

    Searches and components read distinct fingerprints; texts stay where they are."""
    rows = stored(fingerprints(docs, width))
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp"), radius))
    return rows, nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = RADIUS) -> DataFrame:
    """Fingerprint and component of every row of ``docs``.

    A row is fingerprinted from its whole text, lower-cased in A-Z, split at ASCII white
    space. Equal fingerprints are one node, whatever their number; nodes within ``radius``
    differing bits link, and a component's id is the least doc_id of its rows. Null and
    blank texts have the fingerprint zero, a text of fewer words than a shingle that of all
    its words. A null doc_id takes part but never names a component, unless it has no
    other. Repeated rows get the same answer; an empty table gives no rows; other columns
    are not read. Every link counts: there is no limit on partners.
    """
    rows, members = _classes(docs, width, radius)
    ids = members.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = members.join(ids, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, width: int = 3, radius: int = RADIUS) -> DataFrame:
    """The documents without all but one of each component: the row with the least doc_id
    stays; of rows that share it the one with the least hash.

    Fingerprints this close belong to texts that share nearly all shingles; texts with more
    edits stay, so documents that are not copies are safe.
    """
    rows, members = _classes(docs, width, radius)
    first = rows.join(members.select("fp", "root"), "fp").groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("k"))
    keys = rows.groupBy(F.col("doc_id").alias("_kept_id"), F.col("text_hash").alias("_kept_hash")
                        ).agg(F.count("*").alias("_kept_rows"))
    keep = keys.join(first, F.col("_kept_id").eqNullSafe(F.col("k.doc_id"))
                     & (F.col("_kept_hash") == F.col("k.text_hash"))).drop("root", "k")
    found = docs.join(keep, docs["doc_id"].eqNullSafe(keep["_kept_id"])
                      & (F.xxhash64(docs["text"]) == keep["_kept_hash"]))
    once = found.where("_kept_rows = 1").select(*docs.columns)
    every = [F.col(c) for c in docs.columns]
    several = found.where("_kept_rows > 1").groupBy("_kept_id", "_kept_hash").agg(
        F.min_by(F.struct(*every), F.xxhash64(*every)).alias("_kept_row"))
    return once.unionByName(several.select("_kept_row.*"))
