"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.common import held_out, mapped, stored

LETTERS = re.compile(r"[^\W\d_]+")
#: Words per language whose evidence every task holds; that of all others is joined.
WORDS = 20_000
ORDERS = (4, 3, 2, 1)
#: Words whose counts one task holds before it passes them on.
COUNTED = 400_000
#: Evidence beyond so many words no longer raises the score.
FULL_WORDS = 20
CACHED = 300_000


def _counts(rows: Iterator[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 3
    types = (pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n over the whole texts of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            out = _counts(((lang, w, n) for lang, words in seen.items() for w, n in words.items()),
                          ["lang", "word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen.setdefault(lang, Counter()).update(LETTERS.findall(text.as_py().lower()))
                if sum(map(len, seen.values())) > COUNTED:
                    yield flush()
        yield flush()

    counted = mapped(docs.where("text is not null and lang is not null").select("lang", "text"),
                     count, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """lang, gram, n of the n-grams of all words, each word between two blanks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                for gram in grams(word):
                    seen[lang, gram] += n
            yield _counts(((a, b, n) for (a, b), n in seen.items()), ["lang", "gram", "n"])

    return mapped(words, cut, "lang string, gram string, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))


def grams(word: str, orders: tuple[int, ...] = ORDERS) -> list[str]:
    padded = f" {word} "
    return [padded[i:i + k] for k in orders for i in range(len(padded) - k + 1)]


class _Places(dict):
    """Word to row of the evidence matrix; a word met for the first time gets one."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: str) -> int:
        self[word] = place = self.model.add(word)
        return place


class Model:
    """Log frequencies by language of the given words and n-grams.

    A row of ``matrix`` is the evidence of one word: of a known word its own, of any other
    the mean over its longest known n-grams. Rows of unknown words are kept as a cache."""

    def __init__(self, langs: list[str], sizes: dict[str, int], words: dict, grams_: dict):
        self.langs = langs
        total = np.array([max(sizes[x], 1) for x in langs], float)

        def logs(counts: dict[str, int]) -> np.ndarray:
            return np.log((np.array([counts.get(x, 0) for x in langs], float) + 0.05) / total)

        self.grams = {g: logs(c) for g, c in grams_.items()}
        self.known = list(words)
        self.matrix = np.array([logs(words[w]) for w in self.known]).reshape(
            len(self.known), len(langs))
        self.prior = np.log(total / total.sum()) if langs else total
        self.places: _Places | None = None
        self.held: dict[str, int] | None = None

    def add(self, word: str) -> int:
        found = np.zeros(len(self.langs))
        for order in ORDERS:
            known = [self.grams[g] for g in grams(word, (order,)) if g in self.grams]
            if known:
                found = sum(known) / len(known)
                break
        if self.used == len(self.matrix):
            self.matrix = np.concatenate((self.matrix, np.zeros((max(1000, self.used), len(found)))))
        self.matrix[self.used] = found
        self.used += 1
        return self.used - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        words = LETTERS.findall(text.lower()) if text else []
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        if self.places is None or self.used > len(self.known) + CACHED:
            self.used, self.places = len(self.known), _Places(self)
            self.places.update(zip(self.known, range(self.used)))
        places = list(map(self.places.__getitem__, words))
        return self.decide(self.matrix[places].sum(axis=0), len(words))

    def decide(self, evidence: np.ndarray, words: int) -> tuple[str, float]:
        """The language and score of a text of so many words with that sum of evidence."""
        logs = evidence / words * min(words, FULL_WORDS) + 1e-3 * self.prior
        best = int(np.argmax(logs))
        return self.langs[best], float(1 / np.exp(logs - logs[best]).sum())

    def partial(self, text: str | None) -> tuple[int, np.ndarray, Counter]:
        """Words of the text (0 if it gives no evidence), the sum over those the model has,
        and how often each of the others occurs."""
        words = LETTERS.findall(text.lower()) if text else []
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return 0, self.prior, Counter()
        if self.held is None:
            self.held = {w: i for i, w in enumerate(self.known)}
            self.rows = np.vstack((self.matrix[:len(self.known)], np.zeros(len(self.langs))))
        places = list(map(self.held.get, words, repeat(-1)))
        rest = Counter(w for w, i in zip(words, places) if i < 0) if -1 in places else Counter()
        return len(words), self.rows[places].sum(axis=0), rest


def most_frequent(counts: DataFrame, key: list[str], kept: int) -> DataFrame:
    """The rows of ``counts`` above the least frequency that at most ``kept`` rows of their
    ``key`` exceed. Frequencies are counted first, so no task sees all rows of a key."""
    several = counts.groupBy(*key, "n").agg(F.count("*").alias("rows"))
    above = Window.partitionBy(*key).orderBy(F.desc("n"))
    limits = several.withColumn("above", F.sum("rows").over(above)).groupBy(*key).agg(
        F.coalesce(F.max(F.when(F.col("above") > kept, F.col("n"))), F.lit(0)).alias("limit"))
    return counts.join(F.broadcast(limits), key).where(F.col("n") > F.col("limit")).drop("limit")


def vectors(counts: DataFrame, key: str, sizes: dict[str, int]) -> DataFrame:
    """``key`` and its log frequency e0, e1, ... in each language, for all rows of ``counts``."""
    langs = sorted(sizes)
    found = counts.groupBy(key).agg(*[
        F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"e{i}")
        for i, x in enumerate(langs)])
    return found.select(key, *[F.log((F.col(f"e{i}") + 0.05) / float(max(sizes[x], 1)))
                               .alias(f"e{i}") for i, x in enumerate(langs)])


def evidence(words: DataFrame, counts: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """word, e0, e1, ... of the distinct ``words``: of a word in ``counts`` its own, of any
    other the mean over its longest n-grams that occur in those words. Words without any
    have no row. All counts take part, by joins."""
    own = stored(vectors(counts.join(words, "word", "left_semi"), "word", sizes))
    left = stored(words.join(own, "word", "left_anti"))
    gram_rows, found = stored(gram_counts(counts)), own
    for order in ORDERS:

        def cut(batches: Iterator[pa.RecordBatch], order=order) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = [(w, g) for w in batch.column(0).to_pylist() for g in grams(w, (order,))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in pairs], pa.string()) for i in (0, 1)],
                    ["word", "gram"])

        known = vectors(gram_rows.where(F.length("gram") == order), "gram", sizes)
        hits = stored(mapped(left, cut, "word string, gram string").join(known, "gram").groupBy(
            "word").agg(*[F.avg(f"e{i}").alias(f"e{i}") for i in range(len(sizes))]))
        found, left = found.unionByName(hits), left.join(hits, "word", "left_anti")
    return found


def fit(docs: DataFrame, words_kept: int = WORDS) -> tuple[Model, DataFrame, dict[str, int]]:
    """Count over all documents that are not held out and have a language: a model of up to
    ``words_kept`` most frequent words of each language, the counts of all words, and how
    many each language has.

    Only the model's words reach the driver, with their full counts in every language, a
    bound that does not grow with the data. Languages are few: one row each.
    """
    counts = stored(word_counts(docs.where(~held_out(F.col("doc_id")))))
    sizes = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    names = most_frequent(counts, ["lang"], words_kept).select("word").distinct()
    words: dict[str, dict[str, int]] = {}
    for r in counts.join(names, "word").select("word", "lang", "n").collect():
        words.setdefault(r["word"], {})[r["lang"]] = r["n"]
    return Model(sorted(sizes), sizes, words, {}), counts, sizes


def predicted(docs: DataFrame, words_kept: int = WORDS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    Every word counts with its evidence from the full tables of words and n-grams: that of
    the ``words_kept`` most frequent ones of each language is at hand in every task, that
    of a document's other words is joined, so ``words_kept`` changes no answer.

    ``und`` with score 0 for a null text or one without a letter, or if nothing was learned.
    A null lang or doc_id teaches nothing but is predicted; repeated rows teach as often as
    they occur; an empty table gives no rows. Columns other than doc_id, text and lang are
    not read, and lang only where it may be learned from.
    """
    fitted, counts, sizes = fit(docs, words_kept)
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    names = ["doc_id", "words", "part", "rest"]
    types = (pa.int64(), pa.int64(), pa.list_(pa.float64()),
             pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                n, part, rest = model.value.partial(text.as_py())
                out.append((n, part.tolist(), [{"word": w, "n": k} for w, k in rest.items()]))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(
                pa.array(c, t) for c, t in zip(columns, types[1:]))], names)

    rows = stored(mapped(
        docs.select(F.col("doc_id").cast("long"), "text"), read,
        "doc_id long, words long, part array<double>, rest array<struct<word: string, n: long>>",
    ).withColumn("row", F.monotonically_increasing_id()))
    if not sizes:
        return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                           F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    cells = rows.select("row", F.explode("rest").alias("c")).select("row", "c.word", "c.n")
    found = evidence(cells.select("word").distinct(), counts, sizes)
    sums = cells.join(found, "word").groupBy("row").agg(
        *[F.sum(F.col("n") * F.col(f"e{i}")).alias(f"e{i}") for i in range(len(sizes))])
    added = F.array(*[F.coalesce(f"e{i}", F.lit(0.0)) for i in range(len(sizes))])
    whole = rows.where(F.size("rest") > 0).drop("rest").join(sums, "row", "left").select(
        "doc_id", "words", "part", added.alias("added")).unionByName(
        rows.where(F.size("rest") == 0).select(
            "doc_id", "words", "part", F.array().cast("array<double>").alias("added")))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, part, more in zip(*(c.to_pylist() for c in batch.columns[1:])):
                total = np.array(part) + np.array(more) if more else np.array(part)
                out.append(model.value.decide(total, n) if n else ("und", 0.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in out], pa.string()),
                 pa.array([f[1] for f in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    return mapped(whole, decide, "doc_id long, lang_pred string, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
