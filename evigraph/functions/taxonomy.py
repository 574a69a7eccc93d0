"""Era, field, domain, topic and lens expressions over the fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions import text as tx
from evigraph.functions import vocab


def _first_match(cases, default) -> Column:
    """``CASE`` over (condition, value) pairs, first hit wins."""
    chain = None
    for condition, value in cases:
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain.otherwise(default)


def era_from_year(year: Column) -> Column:
    """Era band of a year; outside the bands the nearest end applies."""
    bands = [(year < end, label) for _, end, label in vocab.ERA_BANDS[:-1]]
    return F.when(year.isNotNull(), _first_match(bands, vocab.ERA_BANDS[-1][2]))


def import_era(birth: Column, description: Column | None = None) -> Column:
    """The importers' coarser era table; a description adds the regional rule."""
    cases = [(birth < bound, F.lit(label)) for bound, label in vocab.IMPORT_ERA_BOUNDS]
    if description is not None:
        # Fixed value: the regional pattern of the batch importer.
        regional = description.rlike(
            "(?i)(persian|arab|iraqi|andalus|islam|muslim|bahrain|iranian)")
        cases.insert(1, ((birth < 1400) & F.coalesce(regional, F.lit(False)),
                         F.lit("Islamic Golden Age")))
    return F.when(birth.isNotNull(), _first_match(cases, F.lit("Contemporary")))


def laureate_era(birth: Column) -> Column:
    return (F.when(birth < 1900, "19th Century").when(birth < 1945, "Modernism")
            .when(birth < 1980, "Postwar").otherwise("Contemporary"))


# Keyword patterns per inferred field, in order of precedence.
SERVER_FIELD_PATTERNS = [
    ("mathematician|mathematics", "Mathematics"), ("logician", "Logic"),
    ("computer|programmer|software", "Computing"), ("physicist|physics", "Physics"),
    ("astronomer|astronomy", "Astronomy"), ("cosmologist|cosmology", "Cosmology"),
    ("chemist|chemistry", "Chemistry"), ("biologist|naturalist|biology", "Biology"),
    ("engineer|inventor", "Engineering"), ("economist", "Economics"), ("historian", "History"),
    ("psychologist", "Psychology"), ("linguist", "Linguistics"),
    ("writer|poet|novelist", "Literature"), ("composer|music", "Music"),
    ("political|sociologist", "Political Thought"),
]
BATCH_FIELD_PATTERNS = [
    ("computer|programmer|software|informatics|machine learning", "Computing"),
    ("engineer|inventor|networking|electrical", "Engineering"),
    ("chemist|chemistry", "Chemistry"), ("biolog|genetic|biochem", "Biology"),
    ("mathematic|geometry|algebra", "Mathematics"), ("astronom", "Astronomy"),
    ("physic", "Physics"), ("histor", "History"), ("logic", "Logic"),
]
DRAFT_FIELD_PATTERNS = [
    ("mathematician", "Mathematics"), ("philosopher", "Philosophy"), ("physicist", "Physics"),
    ("chemist", "Chemistry"), ("biologist|naturalist", "Biology"),
    ("computer|programmer", "Computing"), ("economist", "Economics"),
    ("writer|poet|novelist", "Literature"), ("astronomer", "Astronomy"),
    ("engineer|inventor", "Engineering"), ("historian", "History"),
]


def infer_field(text: Column, patterns=None) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    chosen = patterns or DRAFT_FIELD_PATTERNS
    return _first_match([(lowered.rlike(p), F.lit(f)) for p, f in chosen], F.lit("Philosophy"))


def infer_entity_type(description: Column, instance_of: Column, has_birth: Column) -> Column:
    text = F.lower(F.concat_ws(" ", description, instance_of))
    return _first_match([
        (F.coalesce(has_birth, F.lit(False)) | text.contains("human"), F.lit("Person")),
        (text.rlike("book|written work|publication|treatise"), F.lit("Work")),
        (text.rlike("university|institute|organization|academy"), F.lit("Institution")),
        (text.rlike("movement|school of thought"), F.lit("Movement")),
    ], F.lit("Concept"))


def domain_of(field: Column) -> Column:
    cases = [(field.isin(fields), F.lit(d)) for d, fields in vocab.FIELD_DOMAINS.items()]
    return _first_match(cases, F.lit("Other Domains"))


def lens_text(fields, subfields, works, notes, movement) -> Column:
    return F.lower(F.concat_ws(" ", fields, subfields, works, notes, movement))


def lens_tags(text: Column) -> Column:
    """Option ids whose keywords occur in the text, in vocabulary order."""
    options = []
    for lens in vocab.LENSES.values():
        for option, (_, words) in lens.items():
            hit = text.rlike("|".join(words))
            options.append(F.when(hit, F.lit(option)))
    return F.array_compact(F.array(*options))


def person_lens_tags() -> Column:
    """Lens tags of a people row."""
    return lens_tags(lens_text(*[F.col(c) for c in
                                 ["fields", "subfields", "works", "notes", "movement"]]))


def lens_label(option: Column) -> Column:
    cases = [(option == o, F.lit(label)) for lens in vocab.LENSES.values()
             for o, (label, _) in lens.items()]
    return _first_match(cases, option)


def topic_dimension(spark: SparkSession) -> DataFrame:
    """(field, group, topic) rows of the controlled vocabulary; about 75 rows."""
    rows = [(field, group, topic) for field, groups in vocab.TOPIC_GROUPS.items()
            for group, topics in groups.items() for topic in topics]
    return spark.createDataFrame(rows, "field string, topic_group string, topic string")


def _topics_of(field: str) -> list[str]:
    return [t for group in vocab.TOPIC_GROUPS.get(field, {}).values() for t in group]


def controlled_topics(fields: Column) -> Column:
    """Controlled topics of each field of an array, first seen first."""
    mapping = F.create_map(*[
        item for field in vocab.TOPIC_GROUPS
        for item in (F.lit(field), F.array(*[F.lit(t) for t in _topics_of(field)]))])
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.transform(
        F.coalesce(fields, empty), lambda f: F.coalesce(F.try_element_at(mapping, f), empty))))


def auto_topics(fields: Column, text: Column, topics: Column, limit: int | None = None) -> Column:
    """Given topics, then the controlled ones of the fields, then the others whose letters
    and digits occur in those of the text in one piece; the first ``limit`` if given."""
    source = tx.name_key(text)
    every = [t for field in vocab.TOPIC_GROUPS for t in _topics_of(field)]
    conditions = {}
    for topic in dict.fromkeys(every):
        key = "".join(c for c in topic.lower() if c.isascii() and c.isalnum())
        conditions[topic] = F.contains(source, F.lit(key))
    matched = F.array_compact(F.array(*[F.when(c, F.lit(t)) for t, c in conditions.items()]))
    own = F.array_intersect(controlled_topics(fields), matched)
    every = tx.merge_unique(topics, own, matched)
    return every if limit is None else F.slice(every, 1, limit)


def topic_suggestions(fields: Column, tags: Column, limit: int | None = None) -> Column:
    every = tx.merge_unique(controlled_topics(fields), F.transform(tags, lens_label))
    return every if limit is None else F.slice(every, 1, limit)
