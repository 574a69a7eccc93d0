"""Exact removal of repeated byte strings with a logarithmic family of suffix arrays.

The suffix arrays are sparse: they hold the suffixes that ``suffixes.sampled`` picks by
content, one in about thirty bytes, sorted by the hash of their first bytes. Two equal
windows of LENGTH bytes always pick the same suffix, so nothing is lost.

1. Each task turns a run of texts into a suffix array and cuts it into parts of the key
   range. A part's task takes the runs as they come: each is merge-scanned against the
   levels of the part's family, and what is new becomes a level; levels of equal size
   merge. A suffix whose whole context (all windows that picked it) is in a level already
   marks those windows as repeated. One whose first bytes are known with another context is
   contested.
2. Contested contexts, a few in a hundred, are compared window by window. The contexts of
   one gram meet in one task; those of a gram with very many contexts go as single windows.
3. The repeated windows of each document meet its text, which is cut.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import mapped, stored, text_steps
from evigraph.llm.suffixes import LENGTH, Hashed, sampled

#: Text bytes of one run; text bytes behind one part; windows compared in one task; and the
#: contexts of a gram beyond which its windows are compared one by one.
RUN_BYTES, PART_BYTES, PART_WINDOWS, HOT = 8 << 20, 16 << 20, 1 << 20, 2000
RECORD = np.dtype([("k", "u8"), ("s", "u8"), ("d", "i8"), ("p", "u4"), ("n", "u2"), ("f", "u1")])
#: What a payload holds: suffix records, repeated windows, contested contexts; then texts of
#: contexts, and single windows.
SUFFIXES, REPEATED, CONTESTED, CONTEXTS, WINDOWS = range(5)
SPAN = np.dtype([("k", "u8"), ("d", "i8"), ("p", "u4"), ("n", "u4")])
WINDOW = np.dtype([("h", "u8"), ("g", "u8"), ("d", "i8"), ("p", "u4")])
SENT = "part int, kind int, payload binary"
FOUND = "row long, start long, n long, gram long"


def pack(a: np.ndarray) -> bytes:
    """Columns of a record array, one after the other, compressed."""
    columns = b"".join(np.ascontiguousarray(a[c]).tobytes() for c in a.dtype.names)
    return zstandard.compress(columns, 1)


def unpack(payload: bytes, dtype: np.dtype) -> np.ndarray:
    raw = zstandard.decompress(payload)
    out, at = np.empty(len(raw) // dtype.itemsize, dtype), 0
    for c in dtype.names:
        size = dtype[c].itemsize * len(out)
        out[c] = np.frombuffer(raw, dtype[c], len(out), at)
        at += size
    return out


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Parts are equal ranges of the 64-bit keys, so a sorted array is cut in slices."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _sent(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, payload = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())],
        ["part", "kind", "payload"])


def _slices(a: np.ndarray, key: str, kind: int, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """``a``, sorted by ``key``, cut at the parts."""
    part = part_of(a[key], parts)
    cuts = np.flatnonzero(np.diff(part)) + 1
    for piece in np.split(a, cuts) if len(a) else ():
        yield int(part_of(piece[key][:1], parts)[0]), kind, pack(piece)


def _spans(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), SPAN)
    for c in ("k", "d", "p", "n"):
        out[c] = rows[c]
    return out


def suffix_array(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of a run: for each gram its first suffix, in order of grams; the
    repeats of whole contexts; and the contexts of grams that have several. The entry of
    such a gram only says so (flag 1)."""
    rows = rows[np.lexsort((rows["p"], rows["d"], rows["s"], rows["k"]))]
    k, s = rows["k"], rows["s"]
    new_k = np.ones(len(rows), bool)
    new_k[1:] = k[1:] != k[:-1]
    new_s = new_k.copy()
    new_s[1:] |= s[1:] != s[:-1]
    gram = np.cumsum(new_k) - 1
    several = np.bincount(gram, new_s, minlength=1)[gram] > 1 if len(rows) else new_k
    array = rows[new_k].copy()
    array["f"] = several[new_k]
    return array, _spans(rows[~new_s]), _spans(rows[several & new_s])


class Family:
    """Levels of suffix arrays; no gram is in two of them."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def add(self, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge-scan a sorted run against the levels. Returns the windows now known to be
        repeated and the contexts now known to be contested."""
        repeated, contested = [], []
        for level in self.levels:
            at = np.searchsorted(level["k"], run["k"])
            at[at == len(level)] = 0
            met = level["k"][at] == run["k"]
            if not met.any():
                continue
            at, new, run = at[met], run[met].copy(), run[~met]
            old = level[at]
            same = (old["s"] == new["s"]) & (old["f"] == 0) & (new["f"] == 0)
            earlier = (new["d"] < old["d"]) | (new["d"] == old["d"]) & (new["p"] < old["p"])
            repeated += [_spans(new[same & ~earlier]), _spans(old[same & earlier])]
            level[at[same & earlier]] = new[same & earlier]
            contested += [_spans(new[~same & (new["f"] == 0)]), _spans(old[~same & (old["f"] == 0)])]
            level["f"][at[~same]] = 1
        if len(run):
            self.levels.append(run)
        while len(self.levels) > 1 and len(self.levels[-1]) * 2 > len(self.levels[-2]):
            both = np.concatenate((self.levels.pop(), self.levels.pop()))
            self.levels.append(both[np.argsort(both["k"], kind="stable")])
        none = np.zeros(0, SPAN)
        return np.concatenate([none, *repeated]), np.concatenate([none, *contested])


def _runs(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Suffix arrays of runs of texts, cut into parts."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        array, repeated, contested = suffix_array(np.concatenate(held))
        return _sent([row for rows, kind in (
            (array, SUFFIXES), (repeated, REPEATED), (contested, CONTESTED))
            for row in _slices(rows, "k", kind, parts)])

    for batch in batches:
        ids = batch.column(0).to_numpy()
        for first, last, data, starts in text_steps(batch, 1):
            k, s, text, p, n = sampled(data, starts)
            rows = np.zeros(len(k), RECORD)
            rows["k"], rows["s"], rows["d"], rows["p"], rows["n"] = k, s, ids[first:last][text], p, n
            held.append(rows)
            size += len(data)
            if size >= RUN_BYTES:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _found(repeated: np.ndarray, contested: np.ndarray) -> pa.RecordBatch:
    both = np.concatenate((repeated, contested))
    gram = pa.array(both["k"].view(np.int64), mask=np.arange(len(both)) < len(repeated))
    return pa.RecordBatch.from_arrays(
        [pa.array(both["d"]), pa.array(both["p"].astype(np.int64)),
         pa.array(both["n"].astype(np.int64)), gram], ["row", "start", "n", "gram"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The family of each part that meets in this task."""
    families: dict[int, Family] = {}
    none = np.zeros(0, SPAN)
    for batch in batches:
        for part, kind, payload in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == SUFFIXES:
                yield _found(*families.setdefault(part, Family()).add(unpack(payload, RECORD)))
            else:
                spans = unpack(payload, SPAN)
                yield _found(spans, none) if kind == REPEATED else _found(none, spans)


def _windows(data: np.ndarray, at: np.ndarray, rows: np.ndarray, length: int) -> np.ndarray:
    """The windows of contexts whose bytes begin at ``at`` in ``data``."""
    n = rows["n"].astype(np.int64)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.repeat(at, n) + nth
    out = np.zeros(len(begin), WINDOW)
    out["h"], out["g"] = (Hashed(data, i).of(begin, length) for i in (0, 1))
    out["d"], out["p"] = np.repeat(rows["d"], n), np.repeat(rows["p"], n) + nth
    return out


def _firsts(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each distinct window, in order of hashes, and all the others."""
    w = w[np.lexsort((w["p"], w["d"], w["g"], w["h"]))]
    new = np.ones(len(w), bool)
    new[1:] = (w["h"][1:] != w["h"][:-1]) | (w["g"][1:] != w["g"][:-1])
    return w[new], w[~new]


def _joined(w: np.ndarray) -> np.ndarray:
    """Windows as spans of neighbouring ones."""
    w = np.sort(w[["d", "p"]])
    new = np.ones(len(w), bool)
    new[1:] = (w["d"][1:] != w["d"][:-1]) | (w["p"][1:] != w["p"][:-1] + 1)
    first = np.flatnonzero(new)
    out = np.zeros(len(first), SPAN)
    out["d"], out["p"] = w["d"][first], w["p"][first]
    out["n"] = np.diff(np.append(first, len(w)))
    return out


def _contexts(batches: Iterator[pa.RecordBatch], parts: int, length: int) -> Iterator[pa.RecordBatch]:
    """Texts with their contested contexts: the bytes of each to the part of its gram, or
    single windows to the part of their hash."""
    for batch in batches:
        spans, pieces, hot_flags = [], [], []
        for row, text, contexts in zip(*(c.to_pylist() for c in batch.columns)):
            text = zstandard.decompress(text)
            for c in contexts:
                spans.append((c["gram"] % (1 << 64), row, c["start"], c["n"]))
                pieces.append(text[c["start"]:c["start"] + c["n"] + length - 1])
                hot_flags.append(c["hot"])
        rows = np.array(spans, SPAN) if spans else np.zeros(0, SPAN)
        hot = np.array(hot_flags, bool)
        part = part_of(rows["k"], parts)
        out = []
        for p in np.unique(part[~hot]):
            some = np.flatnonzero((part == p) & ~hot)
            body = b"".join(pieces[i] for i in some)
            head = pack(rows[some])
            out.append((int(p), CONTEXTS, len(head).to_bytes(8, "little") + head
                        + zstandard.compress(body, 1)))
        some = np.flatnonzero(hot)
        if len(some):
            data = np.frombuffer(b"".join(pieces[i] for i in some), np.uint8)
            sizes = rows["n"][some].astype(np.int64) + length - 1
            first, rest = _firsts(_windows(data, np.cumsum(sizes) - sizes, rows[some], length))
            out += _slices(first, "h", WINDOWS, parts)
            if len(rest):
                out.append((int(rest["h"][-1] % np.uint64(parts)), REPEATED, pack(_joined(rest))))
        yield _sent(out)


def _compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every window of the contexts of a part but the first of its kind."""
    windows, none = [np.zeros(0, WINDOW)], np.zeros(0, SPAN)
    for batch in batches:
        for _, kind, payload in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == WINDOWS:
                windows.append(unpack(payload, WINDOW))
            elif kind == REPEATED:
                yield _found(unpack(payload, SPAN), none)
            else:
                size = 8 + int.from_bytes(payload[:8], "little")
                rows = unpack(payload[8:size], SPAN)
                data = np.frombuffer(zstandard.decompress(payload[size:]), np.uint8)
                sizes = rows["n"].astype(np.int64) + length - 1
                windows.append(_windows(data, np.cumsum(sizes) - sizes, rows, length))
    yield _found(_joined(_firsts(np.concatenate(windows))[1]), none)


def with_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_suffix_row``, an order of all rows: doc_id itself where it tells them
    apart; otherwise places after sorting by doc_id and then by a hash of the row."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("n > 1 or doc_id is null").isEmpty():
        return docs.withColumn("_suffix_row", F.col("doc_id").cast("long"))
    order = [F.col("doc_id"), F.xxhash64(*docs.columns), F.monotonically_increasing_id()]
    named = docs.select("*", *[c.alias(f"_order{i}") for i, c in enumerate(order)])
    names = [f"_order{i}" for i in range(len(order))]
    placed = named.repartitionByRange(*names).sortWithinPartitions(*names)
    return stored(placed.drop(*names).withColumn("_suffix_row", F.monotonically_increasing_id()))


def zipped(docs: DataFrame) -> DataFrame:
    """row, doc_id and the compressed text."""

    def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = [squeeze((t.as_py() or "").encode()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.binary())],
                ["row", "doc_id", "zipped"])

    rows = docs.select(F.col("_suffix_row").alias("row"), F.col("doc_id").cast("long"), "text")
    return mapped(rows, pack_texts,
                  "row long, doc_id long, zipped binary")


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """row, start, n: the windows ``start`` to ``start + n - 1`` of a text also start
    earlier, in a row before it or before in the same text. ``docs`` has _suffix_row, doc_id
    and text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / PART_BYTES))
    runs = mapped(docs.select("_suffix_row", "text"), lambda b: _runs(b, parts), SENT)
    found = stored(mapped(runs.repartitionById(parts, "part"), _scan, FOUND))
    sure = found.where("gram is null").select("row", "start", "n")
    open_ = found.where("gram is not null")
    windows = open_.agg(F.sum("n")).first()[0] or 0
    if not windows:
        return sure
    hot = open_.groupBy("gram").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select(
        "gram", F.lit(True).alias("hot"))
    contexts = open_.join(hot, "gram", "left").groupBy("row").agg(F.collect_list(F.struct(
        "gram", "start", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("contexts"))
    parts = max(1, math.ceil(windows / PART_WINDOWS))
    sent = mapped(zipped(docs).join(contexts, "row").select("row", "zipped", "contexts"),
                  lambda b: _contexts(b, parts, length), SENT)
    more = mapped(sent.repartitionById(parts, "part"), lambda b: _compare(b, length), FOUND)
    return sure.unionByName(stored(more).select("row", "start", "n"))


def cut(text: bytes, windows: list, length: int) -> tuple[bytes, int, int]:
    """The bytes that no window covers; how many are gone, in how many runs."""
    kept, at, removed, runs = [], 0, 0, 0
    end = -1
    for start, n in sorted((w["start"], w["n"]) for w in windows):
        stop = start + n - 1 + length
        if start > end:
            kept.append(text[max(end, 0):start])
            runs += 1
            removed += stop - start
            end = stop
        elif stop > end:
            removed += stop - end
            end = stop
    kept.append(text[max(end, 0):])
    return b"".join(kept), removed, runs


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """What is removed of every document, and the checksum of what is left.

    A byte goes if a string of ``length`` bytes covers it that also starts earlier: in a
    document of smaller doc_id or before in the same one. Strings are judged on the input.
    A null text is empty; texts shorter than ``length`` stay whole; a null doc_id comes
    before all others. Rows of one doc_id are documents of their own, ordered by a hash of
    the row, so that of equal rows the first stays. An empty table gives no rows; columns
    other than doc_id and text are not read.
    """
    rows = with_rows(docs.select(F.col("doc_id").cast("long"), "text"))
    lists = repeated_windows(rows, length).groupBy("row").agg(
        F.collect_list(F.struct("start", "n")).alias("windows"))
    joined = zipped(rows).join(lists, "row", "left").select("doc_id", "zipped", "windows")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text, windows in zip(*(c.to_pylist() for c in batch.columns)):
                text = zstandard.decompress(text)
                kept, removed, runs = cut(text, windows or [], length)
                for column, value in zip(out, (doc_id, len(text), removed, runs,
                                               hashlib.sha256(kept).hexdigest())):
                    column.append(value)
            types = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return mapped(joined, digest, "doc_id long, n_bytes long, n_removed long, n_spans long,"
                  " kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents without their repeated bytes; those left with nothing go. A character
    that loses some of its bytes goes too."""
    rows = with_rows(docs)
    lists = repeated_windows(rows, length).groupBy(F.col("row").alias("_suffix_row")).agg(
        F.collect_list(F.struct("start", "n")).alias("_windows"))
    names, at = docs.columns, docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, windows in zip(batch.column(at), batch.column(len(names))):
                text, windows = text.as_py(), windows.as_py()
                if text and windows:
                    text = cut(text.encode(), windows, length)[0].decode("utf-8", "ignore")
                texts.append(text or None)
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    joined = rows.join(lists, "_suffix_row", "left").select(*names, "_windows")
    kept = mapped(joined, clean, docs.schema).where("text is not null")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept
