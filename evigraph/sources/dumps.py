"""Normalizers for bibliographic, registry, encyclopedia, prize and roster dumps.

Each takes a DataFrame read from a dump with the columns named in its docstring.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions import taxonomy as tax
from evigraph.functions import text as tx
from evigraph.operators import normalize as nz
from evigraph.operators.edge_validation import listed
from evigraph.session import Scratch


class AdapterResult(NamedTuple):
    """What every adapter yields."""

    observations: DataFrame
    claims: DataFrame
    records: DataFrame


def filled(*columns: Column) -> Column:
    """First non-empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def id_part(value: Column) -> Column:
    return F.element_at(F.split(value, "/"), -1)


def openalex_work(work_id: Column, display_name: Column, title: Column, doi: Column):
    """(entity id, title, identifiers) of a work record."""
    name = filled(display_name, title, id_part(work_id))
    ids = F.map_filter(F.create_map(F.lit("openalex"), work_id, F.lit("doi"), doi),
                       lambda k, v: v.isNotNull() & (v != ""))
    return tx.work_id(F.lit("openalex"), name), name, ids


def openalex_works(dump: DataFrame) -> DataFrame:
    """Works of (id, display_name, title, publication_year, doi)."""
    entity, name, ids = openalex_work(F.col("id"), F.col("display_name"), F.col("title"),
                                      F.col("doi"))
    return dump.select(entity.alias("id"), name.alias("title"),
                       F.col("publication_year").alias("date"), ids.alias("identifiers"),
                       F.col("id").alias("source_id"))


def openalex_institutions(dump: DataFrame) -> DataFrame:
    """Institutions of (id, display_name, city)."""
    name = filled(F.col("display_name"), id_part(F.col("id")))
    return dump.select(tx.entity_id("institution", name).alias("id"), name.alias("label"), "city")


def openalex_concepts(dump: DataFrame) -> DataFrame:
    """Concepts of (id, display_name, description, field, domain)."""
    part = id_part(F.col("id"))
    return dump.select(
        F.concat(F.lit("concept:"), F.lower(part)).alias("id"),
        filled(F.col("display_name"), part).alias("label"),
        filled(F.col("description"), F.col("domain")).alias("description"),
        F.filter(F.array("field", "domain"), lambda v: v.isNotNull() & (v != ""))
        .alias("fields"))


def openalex_persons(dump: DataFrame) -> DataFrame:
    """Person placeholders of (id, display_name)."""
    part = id_part(F.col("id"))
    return dump.select(
        F.concat(F.lit("person:"), F.lower(part)).alias("id"),
        filled(F.col("display_name"), part).alias("label"),
        F.concat(F.lit("openalex:"), part).alias("thinker_id"), F.lit(0).alias("birth"),
        F.lit(None).cast("int").alias("death"), F.array(F.lit("Unclassified")).alias("fields"))


def search_hits(dump: DataFrame) -> DataFrame:
    """Search results with a bounded relevance; (id, display_name, title, relevance_score)."""
    score = F.col("relevance_score")
    return dump.select(
        F.col("id").alias("source_id"),
        filled(F.col("display_name"), F.col("title"), F.col("id")).alias("label"),
        F.when(nz.finite(score), F.least(F.lit(1.0), score / F.lit(1000.0))).otherwise(0.7)
        .alias("confidence"))


#: Pairs of one pass, about, and the most passes; they change no answer.
PASS_PAIRS, PASSES = 10_000_000, 8


def coauthors(dump: DataFrame, authors: DataFrame | None = None) -> DataFrame:
    """Collaborations of focal authors with the authors of their works; last work wins.

    ``dump(id, ord, authorships)``. A work's own author list supplies the pairs, so the
    output is bounded by the lists themselves for the given focal ``authors(id)``. Pairs take
    more room than works and results together, so only those of some authors are shuffled at a
    time; each pass leaves its results and frees the rest.
    """
    tables, found = Scratch(dump.sparkSession), Scratch(dump.sparkSession)
    works = tables.keep(dump.select(
        F.col("id").alias("work_id"), "ord", F.transform("authorships", lambda a: F.struct(
            a["author"]["id"].alias("id"), a["author"]["display_name"].alias("name")))
        .alias("authors")), "zstd")
    n = F.size("authors").cast("double")
    pairs = works.agg(F.sum(F.when(n > 0, n * (n - 1) / 2))).first()[0] or 0
    passes = max(1, min(PASSES, math.ceil(pairs / PASS_PAIRS)))
    rows = works.select("work_id", "ord", "authors", F.explode("authors").alias("a"))
    if passes == 1:
        last = _last_works(rows, authors)
    else:
        last = reduce(DataFrame.unionByName, [found.keep(_last_works(rows.filter(F.pmod(
            F.xxhash64("a.id"), F.lit(passes)) == i), authors), "zstd") for i in range(passes)])
        tables.remove()
    person = lambda c: F.concat(F.lit("person:"), F.lower(id_part(F.col(c))))
    way = lambda a, c, name: F.struct(F.col(a).alias("author_id"),
                                      F.col(c).alias("coauthor_id"), F.struct(
        "w.work_id", F.col(f"w.{name}").alias("name")).alias("w"))
    ways = [way("author_id", "coauthor_id", "name")]
    if authors is None:
        ways.append(way("coauthor_id", "author_id", "author_name"))
    last = last.select(F.inline(F.array(*ways)))
    kind = F.lit("person collaborated with person")
    rel = tx.relationship_id(person("author_id"), person("coauthor_id"), kind)
    return last.select(
        rel.alias("id"), person("author_id").alias("source_id"),
        person("coauthor_id").alias("target_id"), kind.alias("relationship_type"),
        F.concat(person("author_id"), F.lit(" collaborated with "),
                 filled(F.col("w.name"), person("coauthor_id"))).alias("label"),
        tx.claim_id(rel, F.lit("authorships"), F.lit("OpenAlex"), F.col("w.work_id"))
        .alias("claim_id"))


def _last_works(rows: DataFrame, authors: DataFrame | None) -> DataFrame:
    """The last work ``w`` of each pair of an author ``a`` of the rows and one of ``authors``."""
    rows = rows.select("work_id", "ord", "authors", F.col("a.id").alias("author_id"),
                       F.col("a.name").alias("author_name"))
    met = "author_id < coauthor_id"
    if authors is not None:
        rows = rows.join(authors.select(F.col("id").alias("author_id")), "author_id", "left_semi")
        met = "author_id <> coauthor_id"
    # Without focal authors a pair is met once and read in both directions.
    pairs = rows.select("work_id", "ord", "author_id", "author_name",
                        F.explode("authors").alias("c")).select(
        "work_id", "ord", "author_id", F.col("c.id").alias("coauthor_id"), "author_name",
        F.col("c.name").alias("name")).filter(met)
    # Ids begin alike, so a hash comes first in the sort that groups them.
    return pairs.groupBy(F.xxhash64("author_id", "coauthor_id").alias("h"), "author_id",
                         "coauthor_id").agg(
        F.max_by(F.struct("work_id", "name", "author_name"), "ord").alias("w")).drop("h")


def _first(values: Column, limit: int | None) -> Column:
    return values if limit is None else F.slice(values, 1, limit)


def citations(dump: DataFrame, limit: int | None = None) -> DataFrame:
    """Reference-to-work influences of the references of each work, the first ``limit`` if given."""
    target, label, _ = openalex_work(F.col("id"), F.col("display_name"), F.col("title"),
                                     F.col("doi"))
    rows = dump.select(target.alias("target_id"), label.alias("_label"),
                       F.posexplode(_first(F.col("referenced_works"), limit)).alias("pos", "ref"))
    source = tx.work_id(F.lit("openalex"), id_part(F.col("ref")))
    kind = F.lit("work influenced work")
    return rows.select(tx.relationship_id(source, F.col("target_id"), kind).alias("id"),
                       source.alias("source_id"), "target_id", kind.alias("relationship_type"),
                       F.concat(source, F.lit(" influenced "), "_label").alias("label"), "pos")


def observations(records: DataFrame, source_name: str, source_type: str, prefix: str,
                 key: Column, url: Column, at: Column) -> DataFrame:
    """Observation envelope of raw records with the record kept as JSON."""
    return records.select(
        F.concat(F.lit(f"observation:{prefix}:"), key).alias("id"),
        F.lit(source_name).alias("source_name"), url.alias("source_url"),
        F.lit(source_type).alias("source_type"), at.alias("observed_at"),
        F.to_json(F.struct(*records.columns)).alias("raw"))


def crossref(dump: DataFrame, at: Column) -> AdapterResult:
    """Works and title/date claims of (DOI, URL, title[], issued_year, published_year)."""
    title = filled(F.get("title", F.lit(0)), F.col("DOI"), F.lit("Untitled Crossref work"))
    # A zero year counts as missing.
    year = F.coalesce(F.nullif("issued_year", F.lit(0)), F.nullif("published_year", F.lit(0)))
    url = filled(F.col("URL"), F.concat(F.lit("https://doi.org/"), F.nullif("DOI", F.lit(""))),
                 F.lit(""))
    ids = F.map_filter(F.create_map(F.lit("doi"), F.col("DOI"), F.lit("crossref"), F.col("URL")),
                       lambda k, v: v.isNotNull() & (v != ""))
    works = dump.select(tx.work_id(F.lit("crossref"), title).alias("id"), title.alias("title"),
                        year.alias("date"), ids.alias("identifiers"), url.alias("source_url"))
    drafts = works.select("id", "source_url", F.explode(F.array_compact(F.array(
        F.struct(F.lit("title").alias("field"), F.col("title").alias("value")),
        F.when(F.col("date").isNotNull(), F.struct(
            F.lit("date").alias("field"), F.col("date").cast("string").alias("value"))))))
        .alias("c")).select(
        F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("label"),
        F.lit("Crossref").alias("source_name"), "source_url",
        F.lit("bibliographic").alias("source_type"), F.lit(0.85).alias("source_reliability"),
        F.lit("api_field").alias("extraction_method"), F.col("id").alias("subject_id"),
        F.lit("Work").alias("subject_type"), F.col("c.field").alias("field"),
        F.col("c.value").alias("value"), F.lit(0.85).alias("confidence"),
        F.lit("observed").alias("status"))
    seen = observations(dump, "Crossref", "bibliographic", "crossref",
                        filled(F.col("DOI"), F.col("URL"), title), url, at)
    return AdapterResult(seen, nz.claims(drafts), works)


def crossref_references(dump: DataFrame, limit: int | None = None) -> DataFrame:
    """References with a DOI, the first ``limit`` if given: (DOI, title[], reference[]{DOI, article_title})."""
    title = filled(F.get("title", F.lit(0)), F.col("DOI"), F.lit("Untitled Crossref work"))
    cited = _first(F.filter("reference", lambda r: F.coalesce(r["DOI"], F.lit("")) != ""), limit)
    rows = dump.select(tx.work_id(F.lit("crossref"), title).alias("target_id"),
                       F.posexplode(cited).alias("pos", "r"))
    source = tx.work_id(F.lit("crossref"), filled(F.col("r.article_title"), F.col("r.DOI")))
    return rows.select(
        tx.relationship_id(source, F.col("target_id"), F.lit("work influenced work")).alias("id"),
        source.alias("source_id"), "target_id", F.col("r.DOI").alias("doi"), "pos")


def summaries(dump: DataFrame, kind: str = "Person") -> DataFrame:
    """Low-confidence summary claims of (title, page_url, extract)."""
    part = F.regexp_replace(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    drafts = dump.select(
        F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("label"),
        F.lit("Wikipedia").alias("source_name"), F.col("page_url").alias("source_url"),
        F.lit("encyclopedia").alias("source_type"), F.lit(0.45).alias("source_reliability"),
        F.lit("text_extraction").alias("extraction_method"),
        F.concat(F.lit(f"{kind.lower()}:"), part).alias("subject_id"),
        F.lit(kind).alias("subject_type"), F.lit("summary").alias("field"),
        F.coalesce("extract", F.lit("")).alias("value"), F.lit(0.45).alias("confidence"),
        F.lit("candidate").alias("status"))
    return nz.claims(drafts)


def lookup_docs(docs: DataFrame, query: Column) -> DataFrame:
    """Lookup hits of (id, resource[], uri[], label[], comment[], description[])."""
    head = lambda c: F.get(c, F.lit(0))
    return docs.select(
        F.coalesce(head("resource"), head("uri"), "id").alias("source_id"),
        F.coalesce(head("label"), query).alias("label"),
        F.coalesce(head("comment"), head("description")).alias("description"),
        F.coalesce(head("resource"), head("uri")).alias("source_url"),
        F.lit(0.4).alias("confidence"))


def curated_entries(entries: DataFrame, query: str = "") -> AdapterResult:
    """Curated reference entries matching a word: (id, title, source_name, source_url,
    source_type, claims[], subjects[]{label, entity_type})."""
    needle = query.lower()
    hit = F.exists(F.concat(F.array("title", "source_name"), F.transform(
        "subjects", lambda s: s["label"])), lambda v: F.lower(v).contains(needle))
    df = entries.filter(hit) if needle else entries
    primary = F.col("source_type") == "primary_text"
    claims = df.select(
        F.explode("claims").alias("c"), "source_name", "source_url", "source_type",
        F.when(primary, 0.95).otherwise(0.8).alias("source_reliability")).select(
        F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("label"), "c.*",
        "source_name", "source_url", "source_type", "source_reliability",
        F.lit("manual_seed").alias("extraction_method"))
    subjects = df.select("id", "title", "source_url", primary.alias("p"),
                         F.explode("subjects").alias("s"))
    records = subjects.select(
        F.col("id").alias("source_id"), F.col("s.label").alias("label"),
        F.when(F.col("s.entity_type") == "Relationship", "Person")
        .otherwise(F.col("s.entity_type")).alias("entity_type"),
        F.col("title").alias("description"), "source_url",
        F.when(F.col("p"), 0.85).otherwise(0.75).alias("confidence"))
    seen = df.select(F.concat(F.lit("observation:manual:"), "id").alias("id"), "source_name",
                     "source_url", "source_type", F.to_json(F.struct(*df.columns)).alias("raw"))
    return AdapterResult(seen, nz.claims(claims), records)


# Registry property -> (column, how many statements count).
REGISTRY_LISTS = {
    "P106": ("occupations", 8), "P31": ("instance_of", 4), "P101": ("fields_of_work", 8),
    "P27": ("countries", 3), "P135": ("movements", 4), "P800": ("works", 6),
    "P166": ("awards", 6), "P184": ("advisors", 6), "P185": ("doctoral_students", 6),
    "P802": ("named_students", 6), "P737": ("influenced_by", 8), "P108": ("employers", 6),
    "P69": ("educated_at", 6), "P463": ("member_of", 6),
}


def registry_candidates(entities: DataFrame, statements: DataFrame,
                        labels: DataFrame, capped: bool = False) -> DataFrame:
    """Import candidates of a registry dump.

    ``entities(id, ord, label, description, birth_time, death_time, article)``,
    ``statements(id, property, pos, value_id)`` and ``labels(id, label)``. All statements
    count; with ``capped`` those of the importer's screen, by position before missing ids
    are removed.
    """
    caps = F.create_map(*[x for p, (_, n) in REGISTRY_LISTS.items()
                          for x in (F.lit(p), F.lit(n))])
    kept = statements.filter(F.col("property").isin(list(REGISTRY_LISTS))).filter(
        F.col("value_id").isNotNull() & (
            (F.col("pos") < caps[F.col("property")]) if capped else F.lit(True)))
    named = kept.join(labels.select(F.col("id").alias("value_id"), F.col("label").alias("_l")),
                      "value_id", "left").withColumn("text", F.coalesce("_l", "value_id"))
    ordered = lambda p: F.transform(F.array_sort(F.collect_list(F.when(
        F.col("property") == p, F.struct("pos", "text")))), lambda e: e["text"])
    lists = named.groupBy("id").agg(*[ordered(p).alias(c) for p, (c, _) in REGISTRY_LISTS.items()])
    df = entities.join(lists, "id", "left")
    names = [c for c, _ in REGISTRY_LISTS.values()]
    df = df.withColumns({c: listed(c) for c in names}).withColumns({
        "birth": tx.signed_year(F.col("birth_time")), "death": tx.signed_year(F.col("death_time"))})
    description = F.coalesce("description", F.lit(""))
    text = F.concat_ws(" ", description, "occupations", "fields_of_work")
    return df.select(
        "id", "ord", F.coalesce("label", "id").alias("name"), description.alias("description"),
        "birth", "death", tax.infer_entity_type(description, F.col("instance_of"),
                                                F.col("birth").isNotNull()).alias("entity_type"),
        F.array(tax.infer_field(text, tax.SERVER_FIELD_PATTERNS)).alias("fields"),
        F.when(F.size("fields_of_work") > 0, F.col("fields_of_work"))
        .otherwise(_first(F.col("occupations"), 4 if capped else None)).alias("topics"),
        F.nullif(F.array_join("countries", "/"), F.lit("")).alias("region"),
        tax.import_era(F.col("birth")).alias("era"),
        F.get("movements", F.lit(0)).alias("movement"), "works", "movements", "occupations",
        "fields_of_work", "awards", "advisors", "influenced_by", "employers", "educated_at",
        "member_of", F.concat("doctoral_students", "named_students").alias("students"),
        F.array_distinct(F.concat("employers", "educated_at", "member_of")).alias("institutions"),
        "instance_of", F.concat(F.lit("https://www.wikidata.org/wiki/"), "id").alias("source_url"),
        F.when(F.col("article").isNotNull(), tx.article_url(F.col("article")))
        .alias("wikipedia_url"))


def batch_people(candidates: DataFrame, people: DataFrame, statements: DataFrame,
                 anchors: DataFrame, limit: int | None = None, stem_only: bool = False) -> DataFrame:
    """New people one influence or mentorship step from the anchors.

    Humans with a label, a birth year, a five-word description and a labelled work whose
    name is unknown; the first ``limit`` in dump order, if the run is limited.
    """
    near = statements.filter(F.col("property").isin("P737", "P184", "P185", "P802")).join(
        anchors.select("id"), "id", "left_semi").select(F.col("value_id").alias("id"))
    pool = candidates.join(near.union(anchors.select("id")).distinct(), "id", "left_semi")
    plain = F.trim(F.regexp_replace("description", r"\([^)]*\)", ""))
    works = F.filter("works", lambda w: ~w.rlike(r"^Q\d+$"))
    text = F.concat_ws(" ", "description", "occupations", "fields_of_work")
    # Property and value that mark a human.
    humans = statements.filter("property = 'P31' and value_id = 'Q5'").select("id")
    pool = pool.join(humans, "id", "left_semi")
    df = pool.filter((F.col("birth").isNotNull()) & (F.col("name") != F.col("id"))
                     & (F.size(F.split(plain, r"\s+")) >= 5)).withColumn("works", works).filter(
        F.size("works") > 0)
    if stem_only:
        # Fixed value: the scientific-occupation pattern of the century filter.
        pattern = ("(?i)(scientist|engineer|computer|physic|chemist|mathematic|inventor"
                   "|programmer|cybernetic|astronom)")
        df = df.filter(F.col("birth").between(1870, 1980) & text.rlike(pattern))
    key = tx.spaced_name_key(F.col("name"))
    fresh = df.withColumn("_k", key).join(people.select(key.alias("_k")).distinct(), "_k",
                                          "left_anti")
    first = nz.first_per(fresh, ["_k"], "ord")
    if limit is not None:
        first = first.orderBy("ord").limit(limit)
    era = tax.import_era(F.col("birth"), F.col("description"))
    topics = F.when(F.size("fields_of_work") > 0, F.col("fields_of_work")).otherwise(
        F.col("occupations"))
    return first.select(
        tx.underscore_slug(F.col("name")).alias("id"), F.col("id").alias("registry_id"), "name",
        "birth", "death", F.array(tax.infer_field(text, tax.BATCH_FIELD_PATTERNS)).alias("fields"),
        _first(topics, limit and 3).alias("subfields"), "region", era.alias("era"),
        F.coalesce("movement", F.when(era == "Islamic Golden Age", era)).alias("movement"),
        F.lit(3).alias("bridge_score"), "works",
        F.concat(F.regexp_replace("description", r"[.\s]+$", ""), F.lit(".")).alias("notes"))


# Prize categories that count, and the field of a category.
PRIZE_CATEGORIES = ["Physics", "Chemistry", "Physiology or Medicine"]
CATEGORY_FIELDS = {"Physiology or Medicine": "Biology", "Fields Medal": "Mathematics"}


def prize_awards(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(award rows, rejects without a registry id) of a prize feed.

    ``feed(id, registry_id, links[]{rel, href}, prizes[]{year, category, links[]{rel,
    class, href}})``.
    """
    link = lambda links, test: F.get(F.transform(F.filter(
        links, test), lambda x: x["href"]), F.lit(0))
    rows = feed.select("id", "registry_id", "links", F.explode("prizes").alias("p"))
    external = lambda x: F.coalesce(x["rel"] == "external", F.lit(False))
    facts = lambda x: external(x) & F.array_contains(x["class"], "laureate facts")
    url = F.coalesce(link(F.col("p.links"), facts), link(F.col("links"), external), F.concat(
        F.lit("https://www.nobelprize.org/laureate/"), "id"))
    table = F.create_map(*[F.lit(x) for kv in CATEGORY_FIELDS.items() for x in kv])
    awards = rows.filter(F.col("p.category").isin(PRIZE_CATEGORIES)).select(
        "registry_id", F.lit("Nobel Prize").alias("award"), F.col("p.category").alias("category"),
        F.col("p.year").cast("int").alias("year"), url.alias("url"),
        F.coalesce(F.try_element_at(table, F.col("p.category")), F.col("p.category"))
        .alias("field"), F.lit("received").alias("status"))
    return awards.filter("registry_id is not null"), awards.filter("registry_id is null")


def roster_items(pages: DataFrame, section: str, group: str, year: str, item: str) -> DataFrame:
    """List items of a page section: groups hold a year and items, a trailing star means
    declined. The patterns' first groups capture the content."""
    parts = F.regexp_extract_all("html", F.lit(group), 1)
    scope = pages.withColumn("html", F.regexp_extract("html", section, 0))
    groups = scope.select("page_id", F.posexplode(parts).alias("g", "body"))
    rows = groups.select("page_id", "g", F.regexp_extract("body", year, 1).alias("y"),
                         F.posexplode(F.regexp_extract_all("body", F.lit(item), 1))
                         .alias("i", "raw"))
    name = tx.strip_html(F.col("raw"))
    return rows.filter("y <> ''").select(
        "page_id", "g", "i", F.trim(F.regexp_replace(name, r"\*$", "")).alias("name"),
        F.col("y").cast("int").alias("year"),
        F.when(name.endswith("*"), "declined").otherwise("received").alias("status"))


# The patterns of the medal roster page.
MEDAL_ROSTER = dict(
    section=r"(?is)The Fields Medalists, chronologically listed.*?</section>",
    group=r'(?is)<div class="list__group">(.*?)</div>', year=r"(?i)<h3>(\d{4})</h3>",
    item=r'(?is)<li class="blue-link">\s*<a[^>]*>(.*?)</a>\s*</li>')


def registry_of_sources(spark: SparkSession) -> DataFrame:
    """The external sources and what each can supply."""
    # Source registry.
    rows = [
        ("wikidata", "Wikidata", ["Person", "Work", "Institution", "Movement", "Claim"],
         "ready-to-design"),
        ("openalex", "OpenAlex", ["Person", "Work", "Concept", "Relationship"],
         "ready-to-design"),
        ("semantic-scholar", "Semantic Scholar", ["Work", "Person", "Relationship"],
         "requires-api-key"),
    ]
    return spark.createDataFrame(rows, "id string, name string, targets array<string>, "
                                       "status string")
