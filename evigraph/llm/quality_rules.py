"""Line-frequency rules across documents, in DataFrame expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import stored

#: A line found in more documents of one host than this is boilerplate there.
MAX_DOCUMENTS = 20
#: A document is depleted once less than this share of its distinct lines' words is left.
MIN_LEFT = 0.2
MIN_WORDS = 50
SPACE = r"[ \t-\r]+"


def _plain_lines(text: Column) -> Column:
    """The lines of ``text``, lower-cased and trimmed."""
    return F.transform(F.split(F.lower(text), "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\x0c\r")))


def base_statistics(docs: DataFrame, host: str) -> DataFrame:
    """The counts that need no other document, one row per input row.

    Each three-word window becomes one number, its hash with the low bits replaced by its
    position. In the sorted numbers repeats are neighbours; the words of neighbours are
    compared, and the covered words are counted from the gaps between sorted positions.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", F.col(host).alias("host"), t.alias("t"),
        F.array_remove(F.split(t, SPACE), "").alias("words"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("lines"))
    rows = rows.withColumn("bits", F.expr("if(size(words) < 1048576, 20, 32)"))
    rows = rows.withColumn("s", F.expr(
        "sort_array(if(size(words) >= 3, transform(sequence(0, size(words) - 3), i -> "
        "shiftleft(shiftright(xxhash64(words[i], words[i + 1], words[i + 2]), bits), bits) | i),"
        " array()))"))
    rows = rows.withColumn("twice", F.expr(
        "filter(zip_with(slice(s, 1, greatest(size(s) - 1, 0)), slice(s, 2, greatest(size(s) - 1, 0)),"
        " (a, b) -> if(shiftright(a, bits) = shiftright(b, bits),"
        " array(int(a - shiftleft(shiftright(a, bits), bits)),"
        " int(b - shiftleft(shiftright(b, bits), bits))), null)), x -> x is not null)"))
    rows = rows.withColumn("at", F.expr(
        "if(size(twice) > 0, sort_array(array_distinct(flatten(filter(twice, x -> "
        "words[x[0]] = words[x[1]] and words[x[0] + 1] = words[x[1] + 1]"
        " and words[x[0] + 2] = words[x[1] + 2])))), cast(array() as array<int>))"))
    covered = F.expr(
        "case when size(at) > 0 then 3 + aggregate(zip_with(slice(at, 1, size(at) - 1),"
        " slice(at, 2, size(at) - 1), (a, b) -> least(3, b - a)), 0, (n, x) -> n + x) else 0 end")
    return rows.select(
        "doc_id", "host", F.xxhash64("t").alias("text_hash"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"))


def line_words(docs: DataFrame, host: str) -> DataFrame:
    """One row per input row and distinct normalised line: the line's hash and words, and
    the words of all distinct lines of the row."""
    t = F.coalesce(F.col("text"), F.lit(""))
    plain = F.array_remove(F.array_distinct(_plain_lines(t)), "")
    rows = docs.select("doc_id", F.col(host).alias("host"), F.xxhash64(t).alias("text_hash"),
                       F.transform(plain, lambda x: F.struct(
                           F.xxhash64(x).alias("line"),
                           F.size(F.split(x, SPACE)).alias("words"))).alias("x"))
    total = F.aggregate("x.words", F.lit(0), lambda n, w: n + w)
    return rows.select("doc_id", "host", "text_hash", total.alias("of_words"),
                       F.explode("x").alias("x")).select(
        "doc_id", "host", "text_hash", "of_words", "x.line", "x.words")


def verdicts(docs: DataFrame, host: str = "source", max_documents: int = MAX_DOCUMENTS,
             min_left: float = MIN_LEFT) -> DataFrame:
    """Statistics and verdict of every row.

    Lines are compared lower-cased and trimmed. A row counts once for
    a line, however often it holds it; repeated rows are copies and count as such. A line
    found in more than ``max_documents`` documents of a host is removed; a document that
    keeps less than ``min_left`` of the words of its distinct lines is depleted and
    rejected, as is one that fails a base rule.

    Counts of lines combine before the shuffle, so a hot line is one row per task and a hot
    host spreads over its lines; the join back is a plain join whose hot side Spark can
    split. Texts are never shuffled: the lines are written once as hashes.

    Null or empty texts have no words and fail the base rule. A null host is a host of its
    own, a null doc_id an id like any other. An empty table gives no rows. Other columns
    are not read.
    """
    key = ["doc_id", "text_hash", "host"]
    docs = docs.select("doc_id", "text", F.coalesce(F.col(host), F.lit("\0")).alias("host"))
    lines = stored(line_words(docs, "host"))
    common = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(
        F.col("n") > max_documents).drop("n")
    removed = lines.join(common, ["host", "line"], "left_semi").select(
        *key, F.col("words").alias("removed"), "of_words", F.lit(0).alias("rows"))
    base = stored(base_statistics(docs, "host"))
    # Equal rows share a key: their removed words add up and are divided by their number.
    cut = removed.unionByName(base.select(*key, F.lit(0).alias("removed"),
                                          F.lit(0).alias("of_words"), F.lit(1).alias("rows")))
    cut = cut.groupBy(*key).agg(
        F.expr("sum(removed) div sum(rows)").alias("n_removed_words"),
        F.max("of_words").cast("long").alias("of_words"))
    same = reduce(lambda a, b: a & b, (base[k].eqNullSafe(cut[k]) for k in key))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("of_words") - F.col("n_removed_words") >= min_left * F.col("of_words")
    return base.join(cut, same).select(
        base["doc_id"], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_removed_words", failed.alias("base_failed"), (~failed & left).alias("kept"))


def without_common_lines(docs: DataFrame, host: str = "source",
                         max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """The documents with the lines that are common in their host taken out."""
    rows = docs.select("doc_id", "text", F.coalesce(F.col(host), F.lit("\0")).alias("host"))
    lines = stored(line_words(rows, "host"))
    common = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(
        F.col("n") > max_documents).drop("n")
    cut = lines.join(common, ["host", "line"], "left_semi").groupBy(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.collect_set("line").alias("_cut"))
    t = F.coalesce(F.col("text"), F.lit(""))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(t) == F.col("_hash"))
    left = F.array_join(F.filter(F.split(t, "\n"), lambda x: ~F.array_contains(
        F.col("_cut"), F.xxhash64(F.trim(F.lower(x), F.lit(" \t\x0b\x0c\r"))))), "\n")
    return docs.join(cut, same, "left").select(
        *[F.when(F.col("_cut").isNull(), F.col("text")).otherwise(left).alias("text")
          if c == "text" else docs[c] for c in docs.columns])
