"""Faceted, ranked exploration: filters, search, cohorts, groups and timeline bands."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import taxonomy as tax
from evigraph.functions import text as tx
from evigraph.operators.edge_validation import listed
from evigraph.operators.graph_quality import with_degree
from evigraph.operators.normalize import has_evidence


def text_score(query: str) -> Column:
    """Additive relevance of a people row for a query; zero unless every word occurs."""
    q = query.lower().strip()
    words = q.split()
    joined = lambda c: F.lower(F.concat_ws(" ", c))
    parts = {c: joined(c) for c in ["name", "fields", "subfields", "works", "movement", "region",
                                    "era", "notes"]}
    everything = F.concat_ws(" ", *parts.values())
    name = parts["name"]
    all_in = lambda text: reduce(lambda a, b: a & b, [text.contains(w) for w in words])
    # Points per matching part.
    score = (F.lit(1) + F.when(name == q, 90).when(name.startswith(q), 65)
             .when(name.contains(q), 45).otherwise(0) + F.when(all_in(name), 20).otherwise(0))
    for part, points in [("fields", 18), ("subfields", 16), ("works", 14), ("movement", 12),
                         ("notes", 5)]:
        score = score + F.when(parts[part].contains(q), points).otherwise(0)
    score = score + F.when(parts["region"].contains(q) | parts["era"].contains(q), 8).otherwise(0)
    return F.when(all_in(everything), score).otherwise(0)


@dataclass
class Explore:
    """Parameters of one exploration; ``run`` gives the matching people, ranked."""

    min_year: int = -650
    max_year: int = 2030
    fields: list[str] = field(default_factory=list)
    subfields: list[str] = field(default_factory=list)
    lens_tags: list[str] = field(default_factory=list)
    eras: list[str] = field(default_factory=list)
    regions: list[str] = field(default_factory=list)
    query: str = ""
    focus: str | None = None
    only_connected: bool = False
    thread: str | None = None
    only_gaps: bool = False
    sort: str = "birth"
    as_of_year: int = 2026

    def run(self, people: DataFrame, edges: DataFrame | None = None,
            threads: DataFrame | None = None, collection: DataFrame | None = None) -> DataFrame:
        lit = lambda values: F.array(*[F.lit(v) for v in values])
        df = people.filter((F.col("birth") <= self.max_year) & (
            F.coalesce("death", F.lit(self.as_of_year)) >= self.min_year))
        if self.fields:
            df = df.filter(F.arrays_overlap("fields", lit(self.fields)))
        if self.subfields:
            df = df.filter(F.arrays_overlap(listed("subfields"), lit(self.subfields)))
        if self.lens_tags:
            df = df.filter(F.size(F.array_except(lit(self.lens_tags),
                                                 tax.person_lens_tags())) == 0)
        if self.eras:
            df = df.filter(F.col("era").isin(self.eras))
        if self.regions:
            df = df.filter(F.col("region").isin(self.regions))
        searched = text_score(self.query) if self.query.strip() else F.lit(0)
        if self.query.strip():
            df = df.filter(searched > 0)
        if self.only_connected and self.focus:
            near = neighbors(edges, self.focus).union(
                people.filter(F.col("id") == self.focus).select("id"))
            df = df.join(near, "id", "left_semi")
        if self.thread:
            members = threads.filter(F.col("id") == self.thread).select(
                F.explode("people").alias("id"))
            df = df.join(members, "id", "left_semi")
        if self.only_gaps:
            df = review_gaps(df, edges)
        if collection is not None:
            df = df.join(collection, "id", "left_semi")
        return self._ranked(df, edges, searched)

    def _ranked(self, df: DataFrame, edges: DataFrame | None, searched: Column) -> DataFrame:
        score = F.coalesce("bridge_score", F.lit(1)) + searched
        if self.focus and edges is not None:
            near = neighbors(edges, self.focus).distinct().withColumn("_near", F.lit(8))
            df = df.join(near, "id", "left")
            score = score + F.coalesce("_near", F.lit(0)) + F.when(
                F.col("id") == self.focus, 12).otherwise(0)
        if self.fields:
            score = score + F.when(F.arrays_overlap("fields", F.array(
                *[F.lit(f) for f in self.fields])), 3).otherwise(0)
        if self.eras:
            score = score + F.when(F.col("era").isin(self.eras), 2).otherwise(0)
        df = df.withColumn("relevance", score).drop("_near")
        orders = {
            "birth": [F.asc("birth")], "name": [F.asc("name")],
            "field": [F.coalesce(F.get("fields", F.lit(0)), F.lit("")).asc(), F.asc("birth")],
            "bridge": [F.coalesce("bridge_score", F.lit(1)).desc()],
            "relevance": [F.desc("relevance"), F.asc("birth")]}
        return df.orderBy(*orders[self.sort], "ord")


# Named filter presets.
PRESETS = {
    "ancient": dict(min_year=-650, max_year=500, eras=["Ancient"]),
    "science": dict(fields=["Physics", "Astronomy", "Mathematics", "Biology", "Chemistry"],
                    sort="relevance"),
    "review": dict(only_gaps=True, sort="relevance"),
    "focus": dict(only_connected=True, sort="relevance"),
}


def preset(name: str, **changes) -> Explore:
    return Explore(**{**PRESETS[name], **changes})


def neighbors(edges: DataFrame, focus: str) -> DataFrame:
    """Ids linked to one person in either direction."""
    touching = edges.filter((F.col("source") == focus) | (F.col("target") == focus))
    return touching.select(F.explode(F.array("source", "target")).alias("id")).filter(
        F.col("id") != focus)


def review_gaps(people: DataFrame, edges: DataFrame) -> DataFrame:
    """People with at most one link or without topics."""
    return with_degree(people, edges, loops_once=True).filter(
        (F.col("degree") <= 1) | (F.size(listed("subfields")) == 0)).drop("degree")


# Cohort -> text pattern or attribute rule.
COHORT_PATTERNS = {
    "logic-to-computation": "comput|lambda|formal system|algorithm|turing|program",
    "quantum-physics": "quantum|relativity|qed|uncertainty|atomic|field symmetries",
    "ai-lineage": r"artificial intelligence|\bai\b|symbolic ai|lisp|transformer"
                  "|machine learning|neural|cognitive",
    "critical-theory-postmodernism": "critical|postmodern|structural|power-knowledge|gender"
                                     "|genealogical|ideology|alienation",
}
BIOLOGY_PATTERN = "evolution|darwin|genetic|selection|taxonomy|anatomy|naturalist"


def cohorts(people: DataFrame) -> DataFrame:
    """(cohort, person id) of the curated cohorts; empty cohorts do not appear."""
    text = tx.person_search_text()
    has = lambda *names: F.exists("fields", lambda f: f.isin(list(names)))
    is_movement = lambda m: F.coalesce(F.col("movement") == m, F.lit(False))
    matches = {k: text.rlike(p) for k, p in COHORT_PATTERNS.items()}
    matches["logic-to-computation"] = has("Logic", "Computing") | matches["logic-to-computation"]
    matches.update({
        "ancient-foundations": F.col("era") == "Ancient",
        "scientific-revolution": is_movement("Scientific Revolution")
        | text.contains("scientific revolution"),
        "enlightenment-political-thought": (F.col("era") == "Enlightenment")
        & has("Political Thought", "Economics", "Philosophy"),
        "german-idealism": is_movement("German Idealism") | text.contains("idealism")
        | F.col("id").isin("kant", "hegel"),
        "evolution-and-biology": has("Biology") & text.rlike(BIOLOGY_PATTERN)})
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in matches.items()]))
    return people.select(F.explode(names).alias("cohort"), "id")


def edge_filter(edges: DataFrame, kind: str | None = None, min_confidence: float = 0.0,
                sources: str = "all") -> DataFrame:
    """Edges of a type, above a confidence, sourced or in need of sources."""
    df = edges if kind is None else edges.filter(F.col("type") == kind)
    df = df.filter(F.coalesce("confidence", F.lit(1.0)) >= min_confidence)
    if sources == "sourced":
        df = df.filter(has_evidence())
    if sources == "needs_source":
        df = df.filter(F.coalesce(F.col("status") == "needs_source", F.lit(False))
                       | ~has_evidence())
    return df


def edge_flags(edges: DataFrame) -> DataFrame:
    """Suggested, needs-source and low-confidence flags."""
    needs = F.coalesce(F.col("status") == "needs_source", F.lit(False)) | ~has_evidence()
    return edges.select(
        "id", F.coalesce(F.col("status") == "suggested", F.lit(False)).alias("suggested"),
        needs.alias("needs_source"),
        (F.coalesce("confidence", F.lit(1.0)) < 0.5).alias("low_confidence"))


def lookup(people: DataFrame, text: str) -> DataFrame:
    """First person whose id or name equals the text or whose name contains it."""
    q = text.lower().strip()
    hit = (F.lower("id") == q) | (F.lower("name") == q) | F.lower("name").contains(q)
    return people.filter(hit).agg(F.min_by("id", "ord").alias("id"))


def timeline_matches(people: DataFrame, text: str) -> DataFrame:
    q = text.lower().strip()
    inside = lambda c: F.exists(listed(c), lambda v: F.lower(v).contains(q))
    return people.filter(F.lower("name").contains(q) | inside("works") | inside("subfields"))


def facet_values(people: DataFrame, limit: int = 24) -> DataFrame:
    """Sorted distinct topics, eras and regions; the first ``limit`` of each."""
    one = lambda c: F.transform(F.array_compact(F.array(c)), lambda v: F.struct(
        F.lit(c).alias("facet"), v.alias("value")))
    topics = F.transform(listed("subfields"), lambda v: F.struct(
        F.lit("topic").alias("facet"), v.alias("value")))
    rows = people.select(F.explode(F.concat(topics, one("era"), one("region"))).alias("x"))
    values = rows.select("x.*").filter("value <> ''").distinct()
    order = Window.partitionBy("facet").orderBy("value")
    return values.withColumn("_rn", F.row_number().over(order)).filter(
        F.col("_rn") <= limit).drop("_rn")


def fit_range(people: DataFrame, as_of_year: int = 2026) -> DataFrame:
    """Year range that frames the given people with a margin."""
    ends = people.agg(F.min("birth").alias("low"),
                      F.max(F.coalesce("death", F.lit(as_of_year))).alias("high"))
    margin = F.greatest(F.lit(15), F.floor((F.col("high") - F.col("low")) * 0.2 + 0.5))
    return ends.filter("low is not null").select(
        F.greatest(F.lit(-650), F.col("low") - margin).cast("int").alias("min_year"),
        F.least(F.lit(2030), F.col("high") + margin).cast("int").alias("max_year"))


def group_keys() -> dict[str, Column]:
    """Group key expressions of a people row (``institution`` needs its column)."""
    first = F.coalesce(F.get("fields", F.lit(0)), F.lit(""))
    filled = lambda c, d: F.coalesce(F.nullif(c, F.lit("")), F.lit(d))
    return {"domain": tax.domain_of(first), "era": filled(F.col("era"), "Unclassified"),
            "movement": filled(F.col("movement"), "Unclassified movement"),
            "field": filled(first, "Unclassified")}


def concept_key() -> Column:
    """First topic up to a slash, or the field's domain."""
    topic = F.trim(F.element_at(F.split(F.get("subfields", F.lit(0)), "/"), 1))
    return F.coalesce(F.nullif(topic, F.lit("")), group_keys()["domain"])


def group_index(people: DataFrame, key: Column) -> DataFrame:
    """Group title of every person; sort by title and ord to read it as an index."""
    return people.select(key.alias("title"), "id", "ord")


def group_sizes(people: DataFrame, key: Column) -> DataFrame:
    return people.groupBy(key.alias("title")).agg(F.count(F.lit(1)).alias("people"))


def person_institutions(people: DataFrame, institutions: DataFrame) -> DataFrame:
    """First institution listing each person, or Unaffiliated."""
    listed_in = institutions.select(F.explode("figures").alias("id"), "name", "ord").groupBy(
        "id").agg(F.min_by("name", "ord").alias("institution"))
    return people.join(listed_in, "id", "left").withColumn(
        "institution", F.coalesce("institution", F.lit("Unaffiliated")))


def institution_bands(people: DataFrame, institutions: DataFrame, limit: int = 6) -> DataFrame:
    """Institutions with the most listed people present."""
    present = institutions.select("name", "ord", F.explode("figures").alias("id")).join(
        people.select("id"), "id", "left_semi")
    return present.groupBy("name", "ord").agg(F.count(F.lit(1)).alias("people")).orderBy(
        F.desc("people"), "ord").limit(limit)


def movement_bands(people: DataFrame, limit: int = 8) -> DataFrame:
    """Span and size of the largest movements with at least three people."""
    name = F.trim("movement")
    return (people.filter((name != "") & (name != "Imported")).groupBy(name.alias("movement"))
            .agg(F.min("birth").alias("start"), F.max(F.coalesce("death", "birth")).alias("end"),
                 F.count(F.lit(1)).alias("people"), F.min("ord").alias("_first"))
            .filter("people >= 3").orderBy(F.desc("people"), "_first").limit(limit)
            .drop("_first"))


def cluster_fields(people: DataFrame, key: Column, limit: int = 5) -> DataFrame:
    """Most frequent first fields within each cluster."""
    counts = people.groupBy(key.alias("cluster"), F.get("fields", F.lit(0)).alias("field")).agg(
        F.count(F.lit(1)).alias("people"), F.min("ord").alias("_first"))
    order = Window.partitionBy("cluster").orderBy(F.desc("people"), "_first")
    return counts.withColumn("_rn", F.row_number().over(order)).filter(
        F.col("_rn") <= limit).drop("_rn", "_first")


def facet_counts(people: DataFrame) -> DataFrame:
    """People per field, topic, era, region and movement."""
    pair = lambda facet, v: F.struct(F.lit(facet).alias("facet"), v.alias("value"))
    rows = F.concat(
        F.transform(F.array_distinct("fields"), lambda v: pair("field", v)),
        F.transform(F.array_distinct(listed("subfields")), lambda v: pair("topic", v)),
        F.array(*[pair(c, F.col(c)) for c in ["era", "region", "movement"]]))
    return (people.select(F.explode(rows).alias("x")).select("x.*").filter("value is not null")
            .groupBy("facet", "value").agg(F.count(F.lit(1)).alias("people")))


def discipline_groups(people: DataFrame) -> DataFrame:
    """Observed fields under their domains."""
    fields = people.select(F.explode("fields").alias("field")).distinct()
    return fields.select(tax.domain_of(F.col("field")).alias("domain"), "field")


def topics_by_field(people: DataFrame) -> DataFrame:
    """Controlled and observed topics per observed field with their topic group."""
    observed = people.select(F.explode("fields").alias("field"), "subfields")
    seen = observed.select("field", F.explode(listed("subfields")).alias("topic")).filter(
        "topic <> ''").distinct()
    groups = tax.topic_dimension(people.sparkSession)
    fields = observed.select("field").distinct()
    controlled = groups.join(fields, "field", "left_semi")
    return seen.join(controlled, ["field", "topic"], "full_outer").withColumn(
        "topic_group", F.coalesce("topic_group", F.lit("Local Additions")))


def high_bridge(people: DataFrame, limit: int = 12) -> DataFrame:
    return people.filter(F.coalesce("bridge_score", F.lit(0)) >= 4).orderBy(
        F.desc("bridge_score"), "birth", "ord").limit(limit)


def recently_reviewed(audit: DataFrame, people: DataFrame, limit: int = 12) -> DataFrame:
    """People named by audit rows (by id or name), newest row first, each once."""
    lower = F.lower("name")
    by_id = audit.join(people.select(F.col("id").alias("candidate_id"), F.col("ord").alias("p_ord"),
                                     F.col("id").alias("person_id")), "candidate_id")
    names = people.groupBy(lower.alias("_k")).agg(F.min(F.struct("ord", "id")).alias("p"))
    by_name = audit.withColumn("_k", F.lower("candidate_name")).join(names, "_k").select(
        *audit.columns, F.col("p.ord").alias("p_ord"), F.col("p.id").alias("person_id"))
    found = by_id.select(*by_name.columns).unionByName(by_name)
    first = found.groupBy("ord").agg(F.min(F.struct("p_ord", "person_id")).alias("p"))
    return (first.groupBy(F.col("p.person_id").alias("person_id"))
            .agg(F.min("ord").alias("position")).orderBy("position").limit(limit))


def edge_counts(people: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges and sourced edges touching each person."""
    from evigraph.operators.graph_quality import endpoints

    touched = endpoints(edges.withColumn("_s", has_evidence()), loops_once=True).groupBy("id").agg(
        F.count(F.lit(1)).alias("edges"), F.count_if("_s").alias("sourced_edges"))
    zero = F.lit(0).cast("long")
    return people.select("id").join(touched, "id", "left").select(
        "id", F.coalesce("edges", zero).alias("edges"),
        F.coalesce("sourced_edges", zero).alias("sourced_edges"))


def context_index(people: DataFrame, edges: DataFrame, matches: DataFrame, focus: DataFrame,
                  likely: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(lane, id) rows of the context index around one selected person ``focus(id)``.

    ``matches`` is the current result; ``likely`` and ``reviewed`` list ids.
    """
    from evigraph.operators.graph_quality import source_gap_people
    from evigraph.operators.traversal import neighborhood

    chosen = focus.select("id")
    others = matches.join(chosen, "id", "left_anti")
    near = neighborhood(edges, chosen).select("id").distinct().join(
        chosen, "id", "left_anti").join(people.select("id"), "id", "left_semi")
    lanes = {
        "Selected": people.join(chosen, "id", "left_semi").select("id"),
        "Connected": near,
        "Likely Links": likely.select("id"),
        "Recently Added": others.orderBy(F.desc("ord")).limit(12).select("id"),
        "Recently Reviewed": reviewed.select("id").join(matches.select("id"), "id", "left_semi"),
        "Orphans": with_degree(people, edges).filter("degree = 0").orderBy("ord").limit(20)
        .select("id"),
        "High Bridge Score": high_bridge(others).select("id"),
        "Needs Source": source_gap_people(people, edges).join(people.select("id", "ord"), "id")
        .orderBy("ord").limit(12).select("id"),
        "Current Matches": others.join(near, "id", "left_anti").join(likely, "id", "left_anti")
        .orderBy("birth", "ord").limit(30).select("id"),
    }
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(name).alias("lane"), "id") for name, df in lanes.items()])


def lane_heights(people: DataFrame, lane: Column, gap: int = 20,
                 as_of_year: int = 2024) -> DataFrame:
    """Rows each lifespan lane needs, and the first row of the lane.

    Placing lifespans in birth order on the first free row uses exactly as many rows as
    padded lifespans overlap at most. That maximum is read off a per-year tally, so a
    lane holding most people costs no more than its years.
    """
    spans = people.select(lane.alias("lane"), (F.col("birth") - gap).alias("start"), (
        F.coalesce("death", F.lit(as_of_year)) + gap).alias("end"))
    marks = spans.select("lane", F.explode(F.array(
        F.struct(F.col("start").alias("year"), F.lit(1).alias("change")),
        F.struct(F.col("end").alias("year"), F.lit(-1).alias("change")))).alias("m")).groupBy(
        "lane", F.col("m.year").alias("year")).agg(F.sum("m.change").alias("change"))
    running = Window.partitionBy("lane").orderBy("year")
    heights = marks.withColumn("open", F.sum("change").over(running)).groupBy("lane").agg(
        F.max("open").alias("rows"))
    # Lanes are fields or domains: a handful of rows.
    before = heights.select(F.col("lane").alias("other"), F.col("rows").alias("n"))
    return heights.join(before, F.col("other") < F.col("lane"), "left").groupBy(
        "lane", "rows").agg(F.coalesce(F.sum(F.col("n") + 1), F.lit(0)).alias("first_row"))
