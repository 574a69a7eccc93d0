"""Benchmark passages in training documents: rare n-gram seeds, then local alignment."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import mapped, text_steps
from evigraph.llm.suffixes import Hashed, mixed

#: Words of a seed; of each SPREAD neighbouring n-grams of an item the rarest is a seed, so
#: that a copy with GRAM + SPREAD - 1 words in a row unchanged is always compared.
GRAM, SPREAD = 3, 3
#: Alignment: points for a word that fits, for one that does not, and for a gap.
FITS, DIFFERS, GAP = 2, -1, -1
#: Share of an item's best possible score from which a document counts as contaminated.
MIN_SCORE = 0.5
#: So many words in a row count however long the item is. A fault among them costs FAULT, so
#: each asks for four more words; some five in a row are then unchanged and hold a seed.
LONG_WORDS, FAULT = 13, -8
#: Items too short for half of them to mean anything: so many words must fit, or WHOLE of all.
SHORT_WORDS, WHOLE = 7, 0.9
#: Words around the place a seed points to, as a share of the item, that are aligned too.
SLACK = 0.5
#: Items searched for in one pass; their text is what each task holds.
BLOCK_ITEMS = 20_000
_PLAIN = np.full(256, 32, np.uint8)
for _b in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _PLAIN[_b] = _b
for _b in range(65, 91):
    _PLAIN[_b] = _b + 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word: runs of letters and digits, A-Z lower-cased.
    Bytes beyond ASCII count as letters."""
    plain = _PLAIN[data]
    solid = np.zeros(len(plain) + 2, bool)
    solid[1:-1] = plain != 32
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    first, last = edge[::2], edge[1::2]
    # Texts touch each other: a word is cut where a text begins.
    inner = starts[1:-1]
    if len(first) and len(inner):
        at = np.searchsorted(first, inner, "right") - 1
        crossed = (at >= 0) & (first[at] < inner) & (last[at] > inner)
        cuts = np.unique(inner[crossed])
        first, last = np.sort(np.append(first, cuts)), np.sort(np.append(last, cuts))
    text = np.searchsorted(starts, first, "right") - 1
    if not len(first):
        return np.zeros(0, np.uint64), text
    return mixed(Hashed(plain).of(first, last - first) + (last - first).astype(np.uint64)), text


def grams_of(words: np.ndarray, text: np.ndarray, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram at each word, and whether it lies in one text."""
    k = len(words) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = np.zeros(k, np.uint64)
    for i in range(n):
        out = out * _MULTIPLIER + words[i:i + k]
    return mixed(out), text[:k] == text[n - 1:n - 1 + k]


def _arrays(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), starts


class Items:
    """The words of a block of benchmark items, and where each n-gram lies in them."""

    def __init__(self, ids: list, texts: list[str | None], n: int = GRAM):
        self.ids, self.n = ids, n
        words, item = words_of(*_arrays(texts))
        bounds = np.searchsorted(item, np.arange(len(ids) + 1))
        self.words = [words[a:b] for a, b in zip(bounds, bounds[1:])]
        hashes, whole = grams_of(words, item, n)
        at = np.flatnonzero(whole)
        self.hash, self.item = hashes[at], item[at]
        self.place = at - bounds[self.item]
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.place = self.hash[order], self.item[order], self.place[order]
        self.known = np.unique(self.hash)
        self._mark()

    def _mark(self) -> None:
        self.marks = np.zeros(1 << 20, bool)
        self.marks[(self.known >> np.uint64(44)).astype(np.int64)] = True

    def met(self, hashes: np.ndarray) -> np.ndarray:
        """Places in ``hashes`` that hold one of the known n-grams."""
        at = np.flatnonzero(self.marks[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.known):
            return at[:0]
        near = np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)
        return at[self.known[near] == hashes[at]]

    def keep_rare(self, df: dict[int, int], spread: int = SPREAD) -> None:
        """Keep the seeds: of every ``spread`` neighbouring n-grams of an item the one found
        in fewest documents. However common all of an item's n-grams are, some stay."""
        count = np.array([df.get(int(h), 0) for h in self.hash], np.int64)
        order = np.lexsort((self.place, self.item))
        seeds = np.zeros(len(order), bool)
        for run in np.split(order, np.flatnonzero(np.diff(self.item[order])) + 1):
            if not len(run):
                continue
            for i in range(max(1, len(run) - spread + 1)):
                near = run[i:i + spread]
                seeds[near[np.argmin(count[near])]] = True
        self.hash, self.item, self.place = self.hash[seeds], self.item[seeds], self.place[seeds]
        self.known = np.unique(self.hash)
        self._mark()


def align(doc: np.ndarray, item: np.ndarray, differs: int = DIFFERS,
          gap_cost: int = GAP) -> tuple[int, int, int]:
    """Smith-Waterman over words: best score, and the words of ``doc`` it spans.

    Rows follow the item. Gaps along the document are a running maximum of the row, because
    their cost is linear."""
    n = len(doc)
    ramp = gap_cost * np.arange(n + 1)
    score, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, best_from, best_to = 0, 0, 0
    columns = np.arange(n + 1)
    for w in item:
        step = np.where(doc == w, FITS, differs)
        diagonal, above = score[:-1] + step, score[1:] + gap_cost
        up = above > diagonal
        row = np.concatenate(([0], np.where(up, above, diagonal)))
        start = np.concatenate(([0], np.where(up, begin[1:], begin[:-1])))
        fresh = row <= 0
        row[fresh], start[fresh] = 0, columns[fresh]
        lifted = row - ramp
        source = np.maximum.accumulate(np.where(
            lifted >= np.maximum.accumulate(lifted), columns, 0))
        through = lifted[source] + ramp
        gap = through > row
        score = np.where(gap, through, row)
        begin = np.where(gap, start[source], start)
        top = int(np.argmax(score))
        if score[top] > best:
            best, best_from, best_to = int(score[top]), int(begin[top]), top
    return best, best_from, best_to


def enough(size: int, min_score: float = MIN_SCORE) -> float:
    """The score from which an item of ``size`` words counts as found."""
    full = FITS * size
    return max(min_score * full, min(WHOLE * full, FITS * SHORT_WORDS))


def long_passage(doc: np.ndarray, item: np.ndarray, score: int) -> bool:
    """Whether LONG_WORDS words or more fit densely; ``score`` is that of ``align``, which
    is never below the dense one."""
    least = FITS * LONG_WORDS
    return score >= least and align(doc, item, FAULT, FAULT)[0] >= least


def _regions(at: np.ndarray, size: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Stretches of a document's words around the places where an item would begin."""
    slack = math.ceil(SLACK * size) + 2
    a = b = None
    for p in np.unique(at).tolist():
        first, last = max(low, p - slack), min(high, p + size + slack)
        if b is not None and first <= b:
            b = max(b, last)
        else:
            if b is not None:
                yield a, b
            a, b = first, last
    if b is not None:
        yield a, b


def _blocks(benchmark: DataFrame, n: int) -> Iterator[Items]:
    """The items in blocks of BLOCK_ITEMS, ordered by id."""
    rows = benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator()
    ids, texts = [], []
    for r in rows:
        ids.append(r["item_id"])
        texts.append(r["text"])
        if len(ids) == BLOCK_ITEMS:
            yield Items(ids, texts, n)
            ids, texts = [], []
    if ids:
        yield Items(ids, texts, n)


def _document_counts(docs: DataFrame, items: Items) -> dict[int, int]:
    """In how many documents each n-gram of the items occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(len(known.known), np.int64)
        for batch in batches:
            for _, _, data, starts in text_steps(batch, 0):
                words, text = words_of(data, starts)
                hashes, whole = grams_of(words, text, known.n)
                at = known.met(hashes)
                at = at[whole[at]]
                pairs = np.unique(np.column_stack(
                    (np.searchsorted(known.known, hashes[at]), text[at])), axis=0)
                np.add.at(total, pairs[:, 0], 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(known.known[some].view(np.int64)), pa.array(total[some])], ["gram", "n"])

    rows = mapped(docs.select("text"), count, "gram long, n long").groupBy("gram").agg(
        F.sum("n").alias("n")).collect()
    return {r["gram"] % (1 << 64): r["n"] for r in rows}


def _search(known: Items, batch: pa.RecordBatch, column: int,
            min_score: float) -> Iterator[tuple[int, int, float, int, int]]:
    """Row, item, score, first and last word of the contaminated pairs of a batch."""
    for first, _, data, starts in text_steps(batch, column):
        words, text = words_of(data, starts)
        hashes, whole = grams_of(words, text, known.n)
        at = known.met(hashes)
        at = at[whole[at]]
        bounds = np.searchsorted(text, np.arange(len(starts)))
        low = np.searchsorted(known.hash, hashes[at], "left")
        count = np.searchsorted(known.hash, hashes[at], "right") - low
        seed = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(
            np.cumsum(count) - count, count)
        at = np.repeat(at, count)
        item = known.item[seed]
        order = np.lexsort((item, text[at]))
        at, item, seed = at[order], item[order], seed[order]
        change = np.flatnonzero((np.diff(text[at]) != 0) | (np.diff(item) != 0)) + 1
        for group in np.split(np.arange(len(at)), change) if len(at) else ():
            which, doc = int(item[group[0]]), int(text[at[group[0]]])
            target, base = known.words[which], int(bounds[doc])
            best, limit, found = (0, 0, 0), enough(len(target), min_score), False
            for a, b in _regions(at[group] - known.place[seed[group]], len(target), base,
                                 int(bounds[doc + 1])):
                score, x, y = align(words[a:b], target)
                found = found or score >= limit or long_passage(words[a:b], target, score)
                if score > best[0]:
                    best = (score, a + x - base, a + y - base)
            if found:
                share = best[0] / (FITS * len(target))
                yield first + doc, which, share, int(best[1]), int(best[2]) - 1


def _aligned(docs: DataFrame, items: Items, min_score: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    schema = "doc_id long, item_id long, score double, first_word long, last_word long"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = [(ids[row], shared.value.ids[item], *rest)
                   for row, item, *rest in _search(shared.value, batch, 1, min_score)]
            columns = list(zip(*out)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                [f.split()[0] for f in schema.split(", ")])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), search, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE,
                 gram: int = GRAM) -> DataFrame:
    """doc_id, item_id, score, first_word and last_word of every contaminated pair.

    A pair is compared if they share a seed, an n-gram that is the rarest of its
    neighbours in the item by the number of documents that hold it, counted over all
    documents. The score is the best local alignment of the item's words with the
    document's, as a share of the score of a full copy; the words are those it spans.
    A pair is contaminated if that share is ``min_score`` or more, with SHORT_WORDS words
    or nearly all of a shorter item, or if LONG_WORDS words fit densely, whatever the share.

    The documents are read twice for each block of BLOCK_ITEMS items and never shuffled;
    only a block of items is broadcast. Items of fewer words than a seed, null and empty
    texts match nothing. Repeated documents or items give a row each; a null id stays null.
    Empty tables give no rows; columns other than the ids and texts are not read.
    """
    found = None
    for items in _blocks(benchmark, gram):
        items.keep_rare(_document_counts(docs, items))
        rows = _aligned(docs, items, min_score)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return docs.limit(0).select(
            F.col("doc_id").cast("long"), F.col("doc_id").cast("long").alias("item_id"),
            F.lit(0.0).alias("score"), F.col("doc_id").cast("long").alias("first_word"),
            F.col("doc_id").cast("long").alias("last_word"))
    return found


def clean(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE,
          gram: int = GRAM) -> DataFrame:
    """The documents that no item aligns with; texts are filtered where they are read."""
    at, kept = docs.columns.index("text"), docs
    for items in _blocks(benchmark, gram):
        items.keep_rare(_document_counts(docs, items))
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def free(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for row, *_ in _search(shared.value, batch, at, min_score):
                    good[row] = False
                yield batch.filter(pa.array(good))

        kept = mapped(kept, free, docs.schema)
    return kept
