"""Main text of web pages by union-free wrappers inferred per host.

A wrapper is a union-free regular expression over the balanced token streams of a host's
pages: a sequence of elements and text slots in which an entry can be optional, repeated,
or the end of a group that repeats from an earlier entry. It grows by aligning one stream
after another. A mismatch of two texts makes a slot; an entry that only one side has
becomes optional; an entry met again becomes repeated, or closes a repeated group.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import mapped, stored
from evigraph.llm.html_tree import TEXT, parse

#: Tags and words of class, id and role that frame menus, notices, adverts and the like.
FURNITURE_TAGS = frozenset("nav footer aside form head menu dialog address figcaption".split())
FURNITURE = re.compile(
    r"(?:^|[.#@ _-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice\w*|"
    r"alert|sidebar|side|nav\w*|menu\w*|breadcrumb\w*|footer|foot|masthead|topbar|toolbar|header|"
    r"comments?|commentlist|replies|reply|disqus|discussion|respond|share|sharing|social|related|"
    r"recommend\w*|newsletter|subscribe|signup|login|popup|modal|overlay|widget\w*|pagination|"
    r"pager|tags|toc|copyright|complementary|contentinfo|navigation|search|hidden)(?:$|[.#@ _-])")
MAIN = re.compile(r"^(?:article|main)\b|@main\b|[.#](?:article|post|entry|story|main)?-?"
                  r"(?:content|body|text|article)\b")
#: A text that never changes is part of the template if it is on this share of a host's
#: distinct pages, copies counted once. Fewer pages than CONSTANT_PAGES tell nothing.
NEARLY_ALL, CONSTANT_PAGES = 0.95, 12
#: First-level groups a hot host's wrappers are merged in.
SALTS = 32
#: Wrappers of all hosts up to this size are broadcast; beyond it pages are joined to them.
BROADCAST_BYTES = 32 << 20
#: Entries in one sequence of a wrapper. Pages may hold others beyond them: these are read
#: by their own tags and names.
WIDE = 400


def is_furniture(label: str) -> bool:
    tag = re.split(r"[.#@]", label, maxsplit=1)[0]
    return tag in FURNITURE_TAGS or bool(FURNITURE.search(label[len(tag):]))


# A wrapper entry: label, pages with it, repeated, constant text or None, jump, entries.
# ``jump`` is how far back a repeated group that ends here begins, 0 if none does.
LABEL, COUNT, REPEATED, CONSTANT, JUMP, ENTRIES = range(6)


def _entry(node: list) -> list:
    """A page's node, or an entry of another wrapper, as an entry of its own."""
    if len(node) == 6:
        return node
    if node[0] == TEXT:
        return [TEXT, 1, 0, node[1], 0, []]
    fresh = [node[0], 1, 0, None, 0, []]
    align(fresh[ENTRIES], node[1])
    return fresh


def _fold(entry: list, node: list, again: bool) -> None:
    """Align ``node`` with the entry it was found to match."""
    other = node if len(node) == 6 else None
    if again:
        entry[REPEATED] = 1
    else:
        entry[COUNT] += other[COUNT] if other else 1
    if other and other[REPEATED]:
        entry[REPEATED] = 1
    if entry[LABEL] == TEXT:
        if entry[CONSTANT] != (other[CONSTANT] if other else node[1]):
            entry[CONSTANT] = None
    else:
        align(entry[ENTRIES], other[ENTRIES] if other else node[1])


def _next(entries: list, at: int, label: str) -> int | None:
    """The entry that ``label`` matches after entry ``at``: that one again, the next one
    with the label, or one before, where a group begins anew. None if there is none."""
    if at >= 0 and entries[at][LABEL] == label:
        return at
    for i in (*range(at + 1, len(entries)), *range(at - 1, -1, -1)):
        if entries[i][LABEL] == label:
            return i
    return None


def places(entries: list, labels: list[str]) -> Iterator[int | None]:
    """The entries that the labels of a sequence match, one after the other."""
    at = -1
    for label in labels:
        found = _next(entries, at, label)
        yield found
        at = at if found is None else found


def align(entries: list, nodes: list) -> None:
    """Align a sequence of nodes (or of another wrapper's entries) with ``entries``."""
    at, met = -1, set()
    for node in nodes:
        found = _next(entries, at, node[0])
        if found is None:
            if len(entries) >= WIDE:
                continue
            found = at + 1
            entries.insert(found, _entry(node) if len(node) == 2 else json.loads(json.dumps(node)))
            met = {i + (i >= found) for i in met}
        else:
            if found < at:
                entries[at][JUMP] = max(entries[at][JUMP], at - found)
            _fold(entries[found], node, found in met)
        met.add(found)
        at = found


def merge(wrappers: Iterator[list]) -> list:
    """One wrapper of several, [pages, entries] each."""
    total: list = [0, []]
    for pages, entries in wrappers:
        total[0] += pages
        align(total[1], entries)
    return total


class Reader:
    """A finished wrapper: which of its entries hold the main text. ``template`` has the
    numbers, in the order of the wrapper, of the texts that belong to the template."""

    def __init__(self, wrapper: list, template: list[int] | None = None):
        self.pages, self.entries = wrapper
        self.template = frozenset(template or ())
        self.number: dict[int, int] = {}
        self._count(self.entries)
        self.main = self._has_main(self.entries, False)
        self.varied = self._has_slot(self.entries, not self.main)

    def _count(self, entries: list) -> None:
        for e in entries:
            self.number[id(e)] = len(self.number)
            self._count(e[ENTRIES])

    def _has_main(self, entries: list, out: bool) -> bool:
        return any(not is_furniture(e[LABEL]) and (
            bool(MAIN.search(e[LABEL])) or self._has_main(e[ENTRIES], out)) for e in entries)

    def _has_slot(self, entries: list, inside: bool) -> bool:
        for e in entries:
            if e[LABEL] == TEXT:
                if inside and e[CONSTANT] is None:
                    return True
            elif not is_furniture(e[LABEL]) and self._has_slot(
                    e[ENTRIES], inside or bool(MAIN.search(e[LABEL]))):
                return True
        return False

    def _constant(self, entry: list) -> bool:
        return entry[CONSTANT] is not None and not entry[REPEATED] and self.varied

    def texts(self, nodes: list, entries: list, inside: bool,
              main: bool) -> Iterator[tuple[str, int | None]]:
        """The texts of a page's main part in page order, each with the number of its entry
        if the wrapper has it as constant."""
        for node, place in zip(nodes, places(entries, [n[0] for n in nodes])):
            entry = entries[place] if place is not None else None
            if node[0] == TEXT:
                if inside:
                    yield node[1], (self.number[id(entry)] if entry and self._constant(entry)
                                    else None)
            elif not is_furniture(node[0]) and not (
                    node[0].startswith("header") and not inside):
                own = inside or main and bool(MAIN.search(node[0]))
                yield from self.texts(node[1], entry[ENTRIES] if entry else [], own, main)

    def _main_texts(self, tree: list) -> Iterator[tuple[str, int | None]]:
        main = self.main and self._page_has_main(tree[1])
        return self.texts(tree[1], self.entries, not main, main)

    def constants(self, tree: list) -> set[int]:
        """The constant texts that the page's main part holds."""
        return {number for _, number in self._main_texts(tree) if number is not None}

    def read(self, tree: list) -> str:
        return "\n".join(text for text, number in self._main_texts(tree)
                         if number not in self.template)

    def _page_has_main(self, nodes: list) -> bool:
        return any(n[0] != TEXT and not is_furniture(n[0]) and (
            bool(MAIN.search(n[0])) or self._page_has_main(n[1])) for n in nodes)


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^/]*//([^/?#]*)", 1))
    return pages.withColumn("host", host)


def wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper (JSON) of the pages with host and html.

    Every page takes part. Each task first aligns its own pages of a host, then up to SALTS
    tasks merge what the first made, then one merges those; what moves is wrappers, not
    pages, so a host with most pages costs no more than any other.
    """

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                wrapper = found.setdefault(host, [0, []])
                wrapper[0] += 1
                align(wrapper[1], parse(page.as_py() or "", is_furniture)[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()),
             pa.array([json.dumps(w) for w in found.values()], pa.string())], ["host", "wrapper"])

    def joined(table: pa.Table) -> pa.Table:
        whole = merge(json.loads(w) for w in sorted(table.column("wrapper").to_pylist()))
        return pa.table({"host": table.column("host")[:1],
                         "wrapper": pa.array([json.dumps(whole)], pa.string())})

    schema = "host string, wrapper string"
    first = mapped(pages.select("host", "html"), infer, schema)
    salted = first.groupBy("host", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    return salted.applyInArrow(joined, schema).groupBy("host").applyInArrow(joined, schema)


def each_page(pages: DataFrame, found: DataFrame, rows, schema: str) -> DataFrame:
    """``rows(batch, reader)`` of all pages with the readers of their hosts; ``found`` has
    host, wrapper and template. Wrappers are broadcast up to BROADCAST_BYTES, else joined."""
    size = found.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    columns = [F.col("page_id").cast("long").alias("page_id"), "url", "html", "host", "copy"]
    if size <= BROADCAST_BYTES:
        known = pages.sparkSession.sparkContext.broadcast(
            {r["host"]: (r["wrapper"], r["template"]) for r in found.collect()})

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            readers: dict[str, Reader] = {}
            for batch in batches:
                hosts = batch.column(3).to_pylist()
                for h in set(hosts).difference(readers):
                    wrapper, template = known.value[h]
                    readers[h] = Reader(json.loads(wrapper), template)
                yield rows(batch, lambda i: readers[hosts[i]])

        return mapped(pages.select(*columns), read, schema)

    def read_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, reader = None, None
        for batch in batches:
            hosts, made = batch.column(3).to_pylist(), {}
            for h, w, t in zip(hosts, batch.column(5), batch.column(6)):
                if h not in made:
                    if h != held:
                        held, reader = h, Reader(json.loads(w.as_py()), t.as_py())
                    made[h] = reader
            yield rows(batch, lambda i: made[hosts[i]])

    return mapped(pages.select(*columns).join(found, "host").select(
        "page_id", "url", "html", "host", "copy", "wrapper", "template"), read_joined, schema)


def templates(pages: DataFrame, found: DataFrame) -> DataFrame:
    """host and template, the numbers of the constant texts on nearly all distinct pages."""

    def rows(batch: pa.RecordBatch, reader) -> pa.RecordBatch:
        hosts, copies = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        out = {(hosts[i], n, copies[i]) for i, page in enumerate(batch.column(2))
               for n in (-1, *reader(i).constants(parse(page.as_py() or "", is_furniture)))}
        columns = list(zip(*out)) or [()] * 3
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64()))],
            ["host", "number", "copy"])

    seen = stored(each_page(pages, found, rows, "host string, number int, copy long").distinct()
                  .groupBy("host", "number").agg(F.count("*").alias("n")))
    whole = seen.where("number = -1").select("host", F.col("n").alias("of"))
    return seen.where("number >= 0").join(whole, "host").where(
        (F.col("of") >= CONSTANT_PAGES) & (F.col("n") >= NEARLY_ALL * F.col("of"))).groupBy(
        "host").agg(F.collect_list("number").alias("template"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    The text is what the wrapper of the page's host marks as the article: inside article or
    main elements where the host has them, without navigation, headers, footers, asides,
    forms, adverts, notices and comments, and without texts that never change and are on nearly
    all of at least CONSTANT_PAGES distinct pages of the host. Blocks keep the page's order, one per line; br starts a
    new one. Nothing is cut short.

    A null or empty page has an empty text; broken markup is read as far as it makes
    sense; a page without a host shares one wrapper with others like it; repeated rows get
    equal results; an empty table gives no rows; other columns are not read.
    """
    pages = with_host(pages).select("page_id", "url", "html", "host",
                                    F.xxhash64("html").alias("copy"))
    found = stored(wrappers(pages))
    bare = found.withColumn("template", F.lit(None).cast("array<int>"))
    found = stored(found.join(templates(pages, bare), "host", "left"))

    def rows(batch: pa.RecordBatch, reader) -> pa.RecordBatch:
        texts = [reader(i).read(parse(page.as_py() or "", is_furniture))
                 for i, page in enumerate(batch.column(2))]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return each_page(pages, found, rows, "page_id long, url string, text string, n_chars long")
