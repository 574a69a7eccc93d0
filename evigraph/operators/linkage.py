"""Record linkage as table jobs: block, join on equal keys, score, decide.

Linkage first folds identical profiles into one, so a large group of copies costs one
profile. People meet at their rarest signals, common ones only together with others; works
and entities at two attributes that any pair reaching the cutoff must share. No pair at or
above the cutoff is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import text as tx
from evigraph.operators.edge_validation import listed, reasons
from evigraph.operators.normalize import first_per
from evigraph.operators.substring_join import contained
from evigraph.operators.threshold_join import sufficient_pairs
from evigraph.session import cut_lineage

# Merge thresholds in hundredths.
AUTO, PROVISIONAL = 85, 55


def profiles(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(one row per distinct profile with its first id and copies, id -> profile)."""
    content = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    keyed = df.withColumn("_profile", F.sha2(content, 256))
    folded = (keyed.groupBy("_profile")
              .agg(F.min_by(F.struct("id", *keys), "ord").alias("p"),
                   F.count(F.lit(1)).alias("copies"))
              .select("_profile", F.col("p.id").alias("profile_id"),
                      *[F.col("p")[k].alias(k) for k in keys], "copies"))
    members = keyed.select("id", "_profile").join(
        folded.select("_profile", "profile_id"), "_profile").drop("_profile")
    return folded.drop("_profile"), members


def _tagged(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(f"{kind}="), v))


def _cross(tag: str, left: Column, right: Column) -> Column:
    """All two-part block keys of two key arrays of one record."""
    return F.flatten(F.transform(left, lambda a: F.transform(
        right, lambda b: F.concat(F.lit(f"{tag}|"), a, F.lit("|"), b))))


def _years(year: Column, spread: int) -> Column:
    """The year itself, or every year within ``spread``, as strings."""
    span = F.transform(F.sequence(year - spread, year + spread), lambda y: y.cast("string"))
    return F.when(year.isNotNull(), span).otherwise(F.array().cast("array<string>"))


def _blocked(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Distinct (l, r) profile pairs sharing a block key; ``keys(spread)`` builds them."""
    a = left.select(F.col("profile_id").alias("l"), F.explode(F.array_distinct(keys(True)))
                    .alias("k"))
    b = right.select(F.col("profile_id").alias("r"), F.explode(F.array_distinct(keys(False)))
                     .alias("k"))
    return a.join(b, "k").select("l", "r").distinct()


def _both(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    rename = lambda df, p, key: df.select(F.col("profile_id").alias(key), *[
        F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "profile_id"])
    return pairs.join(rename(left, "l", "l"), "l").join(rename(right, "r", "r"), "r")


def _hit(name: str) -> Column:
    return tx.overlap(F.col(f"l_{name}"), F.col(f"r_{name}"))


def _ids(column: str) -> Column:
    """``kind=value`` keys of a map from authority to ids."""
    entries = F.map_entries(F.coalesce(F.col(column), F.create_map().cast(
        "map<string,array<string>>")))
    return F.array_distinct(F.flatten(F.transform(entries, lambda e: F.transform(
        F.filter(tx.key_set(e["value"]), lambda v: v != ""),
        lambda v: F.concat(e["key"], F.lit("="), v)))))


PERSON_CONTEXTS = ["fields", "occupations", "works", "institutions", "movements"]


def person_profiles(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles of (id, ord, name, alternate_names, birth, death, external_ids, contexts)."""
    names = F.concat(F.array("name"), listed("alternate_names"))
    keyed = df.select("id", "ord", F.array_sort(F.array_distinct(F.array_compact(F.transform(
        names, tx.text_key)))).alias("names"), "birth", "death",
        F.array_sort(_ids("external_ids")).alias("ids"),
        *[F.array_sort(tx.key_set(F.col(c))).alias(c) for c in PERSON_CONTEXTS])
    return profiles(keyed, ["names", "birth", "death", "ids", *PERSON_CONTEXTS])


# Weights of linked people in hundredths; ids and contexts count twice at most.
NAME, BIRTH, NEAR_BIRTH, DEATH, ID, CONTEXT = 35, 18, 8, 8, 15, 4
PERSON_CAPS = {"name": (1, NAME), "birth": (1, BIRTH), "death": (1, DEATH), "id": (2, 2 * ID),
               **{c: (2, 2 * CONTEXT) for c in PERSON_CONTEXTS}}


def person_signals(df: DataFrame, near: bool) -> DataFrame:
    """(id, kind, value, points) of person profiles; the ``near`` side asks for near births."""
    def signals(kind, values, points):
        return F.transform(values, lambda v: F.struct(
            F.lit(kind).alias("kind"), v.cast("string").alias("value"),
            F.lit(points).alias("points")))

    year = F.col("birth")
    around = F.filter(_years(year, 2), lambda y: y != year.cast("string")) if near else (
        _years(year, 0))
    lists = [signals("name", F.col("names"), NAME), signals("birth", _years(year, 0), BIRTH),
             signals("birth", around, NEAR_BIRTH),
             signals("death", _years(F.col("death"), 0), DEATH),
             signals("id", F.col("ids"), ID),
             *[signals(c, F.col(c), CONTEXT) for c in PERSON_CONTEXTS]]
    return df.select(F.col("profile_id").alias("id"), F.explode(F.concat(*lists)).alias("s")
                     ).select("id", "s.*")


def person_linkage(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Scored profile pairs at or above the provisional cutoff, with reasons."""
    # Folded once, as signals and scores both read them.
    left, right = (cut_lineage(person_profiles(df)[0]) for df in (candidates, existing))
    pairs = sufficient_pairs(person_signals(left, True), person_signals(right, False),
                             PERSON_CAPS, PROVISIONAL)
    df = _both(pairs, left, right)
    gap = F.abs(F.col("l_birth") - F.col("r_birth"))
    checks = [(_hit("names") > 0, F.lit(NAME), "name"), (gap == 0, F.lit(BIRTH), "birth"),
              ((gap > 0) & (gap <= 2), F.lit(NEAR_BIRTH), "near-birth"),
              (F.col("l_death") == F.col("r_death"), F.lit(DEATH), "death"),
              (_hit("ids") > 0, F.least(F.lit(2 * ID), _hit("ids") * ID), "external-id")]
    checks += [(_hit(c) > 0, F.least(F.lit(2 * CONTEXT), _hit(c) * CONTEXT), c.rstrip("s"))
               for c in PERSON_CONTEXTS]
    return _decided(df, checks)


def _decided(df: DataFrame, checks: list) -> DataFrame:
    total = F.lit(0)
    for condition, points, _ in checks:
        total = total + F.when(condition, points).otherwise(0)
    scored = df.select(
        F.col("l").alias("candidate_profile"), F.col("r").alias("existing_profile"),
        F.col("l_copies").alias("candidate_copies"), F.col("r_copies").alias("existing_copies"),
        F.least(F.lit(100), total).alias("_points"),
        reasons(*[(c, r) for c, _, r in checks]).alias("reasons"))
    return scored.filter(F.col("_points") >= PROVISIONAL).withColumn(
        "score", F.col("_points") / F.lit(100.0)).withColumn(
        "decision", decision(F.col("_points"), F.lit(False))).drop("_points")


def decision(points: Column, conflict: Column, auto: int = AUTO,
             provisional: int = PROVISIONAL) -> Column:
    return (F.when(conflict, "conflict").when(points >= auto, "auto-merge")
            .when(points >= provisional, "provisional-merge").otherwise("keep-separate"))


def needs_manual_review(verdict: Column) -> Column:
    return verdict.isin("provisional-merge", "conflict")


def with_conflicts(matches: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Decisions after preserved conflicts of the same profile pair are considered."""
    counted = conflicts.groupBy("candidate_profile", "existing_profile").agg(
        F.count(F.lit(1)).alias("conflicts"))
    points = F.round(F.col("score") * 100).cast("int")
    return (matches.join(counted, ["candidate_profile", "existing_profile"], "left")
            .withColumn("conflicts", F.coalesce("conflicts", F.lit(0).cast("long")))
            .withColumn("decision", decision(points, F.col("conflicts") > 0))
            .withColumn("manual_review", needs_manual_review(F.col("decision"))))


def preserved_conflicts(matches: DataFrame, candidates: DataFrame, existing: DataFrame,
                        fields: list[str]) -> DataFrame:
    """Scalar fields on which matched records disagree, both values kept."""
    left = candidates.select(F.col("id").alias("candidate_profile"),
                             *[F.col(f).cast("string").alias(f"l_{f}") for f in fields])
    right = existing.select(F.col("id").alias("existing_profile"),
                            *[F.col(f).cast("string").alias(f"r_{f}") for f in fields])
    values = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"l_{f}").alias("candidate_value"),
                                F.col(f"r_{f}").alias("existing_value")) for f in fields])
    return (matches.join(left, "candidate_profile").join(right, "existing_profile")
            .select("candidate_profile", "existing_profile", F.explode(values).alias("x"))
            .select("candidate_profile", "existing_profile", "x.*")
            .filter("candidate_value <> existing_value"))


def matched_records(matches: DataFrame, members: DataFrame, side: str) -> DataFrame:
    """(candidate_profile, existing_profile, side, record_id): every record of one side.

    A row per record and match, never one per pair of records: copies meet through their
    profiles. ``members`` is (id, profile_id) of that side.
    """
    return matches.select("candidate_profile", "existing_profile").join(
        members.select(F.col("profile_id").alias(f"{side}_profile"), F.col("id").alias(
            "record_id")), f"{side}_profile").select(
        "candidate_profile", "existing_profile", F.lit(side).alias("side"), "record_id")


def _stated(records: DataFrame, members: DataFrame, fields: list[str]) -> DataFrame:
    """(profile_id, field, value, records): what a profile's records state, counted."""
    values = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))
                       for f in fields])
    return (records.select("id", F.explode(values).alias("x")).select("id", "x.*")
            .filter("value is not null").join(members, "id")
            .groupBy("profile_id", "field", "value").agg(F.count(F.lit(1)).alias("records")))


def record_conflicts(matches: DataFrame, candidates: tuple[DataFrame, DataFrame],
                     existing: tuple[DataFrame, DataFrame], fields: list[str]) -> DataFrame:
    """Every value of a field on which any two records of a match disagree.

    Each side is (records, members). Values are counted per profile before matches meet them,
    so copies cost nothing. Rows are (candidate_profile, existing_profile, field, side, value,
    records); a field that one side leaves out is no conflict.
    """
    pairs = matches.select("candidate_profile", "existing_profile").distinct()

    def stated(side, records, members):
        values = _stated(records, members, fields).withColumnRenamed(
            "profile_id", f"{side}_profile")
        return pairs.join(values, f"{side}_profile").select(
            "candidate_profile", "existing_profile", "field", F.lit(side).alias("side"), "value",
            "records")

    keys = ["candidate_profile", "existing_profile", "field"]
    rows = stated("candidate", *candidates).unionByName(stated("existing", *existing))
    torn = rows.groupBy(*keys).agg(
        F.min("side").alias("_a"), F.max("side").alias("_b"), F.min("value").alias("_low"),
        F.max("value").alias("_high")).filter("_a <> _b and _low <> _high").select(*keys)
    return rows.join(torn, keys, "left_semi")


def conflict_evidence(conflicts: DataFrame, candidates: DataFrame, existing: DataFrame,
                      claims: DataFrame) -> DataFrame:
    """The claims and observations that state a side's value of a conflict, one a row.

    ``candidates`` and ``existing`` are members (id, profile_id); ``claims`` are (id,
    observation_id, subject_id, field, value) about records of either side.
    """
    told = claims.select(F.col("id").alias("claim_id"), "observation_id",
                         F.col("subject_id").alias("id"), "field", "value")

    def backed(side, members):
        rows = told.join(members, "id").select(
            F.col("profile_id").alias(f"{side}_profile"), "field", "value",
            F.col("id").alias("record_id"), "claim_id", "observation_id")
        return conflicts.filter(F.col("side") == side).join(
            rows, [f"{side}_profile", "field", "value"]).select(
            *conflicts.columns, "record_id", "claim_id", "observation_id")

    return backed("candidate", candidates).unionByName(backed("existing", existing))


WORK_IDS = {"doi": 35, "isbn": 25, "openalex": 25, "wikidata": 25}


def work_profiles(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles of (id, ord, title, translated_titles, author_ids, author_names, date, ids)."""
    titles = F.concat(F.array("title"), listed("translated_titles"))
    authors = F.concat(_tagged("i", tx.key_set(F.col("author_ids"))),
                       _tagged("n", tx.key_set(F.col("author_names"))))
    keyed = df.select(
        "id", "ord", F.array_sort(F.array_distinct(F.transform(titles, tx.text_key)))
        .alias("titles"), F.array_sort(authors).alias("authors"), "date",
        *[F.nullif(tx.identifier_key(F.col("identifiers")[k]), F.lit("")).alias(k)
          for k in WORK_IDS])
    return profiles(keyed, ["titles", "authors", "date", *WORK_IDS])


def work_linkage(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Scored work pairs at or above the provisional cutoff; an identifier must match."""
    left, _ = work_profiles(candidates)
    right, _ = work_profiles(existing)

    def keys(_):
        ids = F.array_compact(F.array(*[F.concat(F.lit(f"{k}="), F.col(k)) for k in WORK_IDS]))
        pairs = F.filter(F.flatten(F.transform(ids, lambda a: F.transform(
            ids, lambda b: F.when(a < b, F.concat(F.lit("ii|"), a, F.lit("|"), b))))),
            lambda k: k.isNotNull())
        return F.concat(_cross("it", ids, F.col("titles")),
                        _cross("ia", ids, F.col("authors")), pairs)

    df = _both(_blocked(left, right, keys), left, right)
    gap = F.abs(F.col("l_date") - F.col("r_date"))
    checks = [(F.col(f"l_{k}") == F.col(f"r_{k}"), F.lit(w), k) for k, w in WORK_IDS.items()]
    checks += [(_hit("titles") > 0, F.lit(25), "title"), (_hit("authors") > 0, F.lit(15), "author"),
               (gap == 0, F.lit(10), "date"), ((gap > 0) & (gap <= 2), F.lit(4), "near-date")]
    return _decided(df, checks)


def entity_profiles(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles of institutions, movements and concepts."""
    labels = F.concat(F.array("label"), listed("alternate_labels"))
    keyed = df.select(
        "id", "ord", "type", F.array_sort(F.array_distinct(F.transform(labels, tx.text_key)))
        .alias("labels"), F.array_sort(_ids("external_ids")).alias("ids"),
        F.nullif(tx.text_key(F.col("city")), F.lit("")).alias("city"), "start", "end",
        F.array_sort(tx.key_set(F.col("fields"))).alias("fields"),
        F.array_sort(tx.key_set(F.col("broader_terms"))).alias("broader"))
    return profiles(keyed, ["type", "labels", "ids", "city", "start", "end", "fields", "broader"])


def entity_linkage(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Scored entity pairs of one type at or above the provisional cutoff."""
    left, _ = entity_profiles(candidates)
    right, _ = entity_profiles(existing)

    def keys(spread):
        wide = 10 if spread else 0
        traits = F.concat(
            _tagged("id", F.col("ids")), _tagged("b", F.col("broader")),
            _tagged("c", F.array_compact(F.array("city"))),
            _tagged("s", _years(F.col("start"), wide)), _tagged("e", _years(F.col("end"), wide)))
        pairs = F.filter(F.flatten(F.transform("ids", lambda a: F.transform(
            "ids", lambda b: F.when(a < b, F.concat(F.lit("ii|"), a, F.lit("|"), b))))),
            lambda k: k.isNotNull())
        return F.transform(F.concat(_cross("l", F.col("labels"), traits), pairs),
                           lambda k: F.concat(F.col("type"), F.lit("|"), k))

    df = _both(_blocked(left, right, keys), left, right)
    kind = F.col("l_type")
    near = lambda c: F.coalesce(F.abs(F.col(f"l_{c}") - F.col(f"r_{c}")) <= 10,
                                F.lit(False))
    checks = [
        (_hit("labels") > 0, F.lit(40), "label"),
        (_hit("ids") > 0, F.least(F.lit(30), _hit("ids") * 15), "external-id"),
        ((kind == "Institution") & (F.col("l_city") == F.col("r_city")), F.lit(15), "city"),
        ((kind == "Movement") & (near("start") | near("end")),
         F.when(near("start") & near("end"), 20).otherwise(10), "chronology"),
        ((kind == "Concept") & (_hit("broader") > 0), F.lit(15), "broader-term"),
        (_hit("fields") > 0, F.least(F.lit(10), _hit("fields") * 5), "field")]
    return _decided(df, checks)


def _first_people(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(F.struct("ord", "id")).alias("hit"))


def first_duplicate(candidates: DataFrame, people: DataFrame) -> DataFrame:
    """First person, in order, that each candidate duplicates.

    Only the earliest person per key matters, so people shrink to one row per name, url
    text, year pair or (work, year) before any join.
    """
    variants = F.array_distinct(F.flatten(F.transform(
        F.concat(F.array("name"), listed("aliases")), tx.name_variants)))
    by_name = candidates.select("id", F.explode(variants).alias("k")).join(
        _first_people(people.select("id", "ord", F.explode(tx.name_variants(F.col("name")))
                                    .alias("k")), ["k"])
        .select("k", "hit"), "k").select("id", "hit")
    links = candidates.select("id", F.explode(F.array_compact(F.array(
        F.nullif(F.col("source_url"), F.lit("")), F.nullif(F.col("wikipedia_url"), F.lit("")))))
        .alias("url"))
    by_url = links.join(_noted(people, links.select("url").distinct()), "url").select("id", "hit")
    near = lambda c: F.transform(F.sequence(F.col(c) - 2, F.col(c) + 2), lambda y: y)
    dated = candidates.filter("birth is not null").withColumn("birth", F.explode(near("birth")))
    lives = _first_people(people.filter("birth is not null and death is not null"),
                          ["birth", "death"])
    by_life = (dated.filter("death is not null").withColumn("death", F.explode(near("death")))
               .join(lives, ["birth", "death"]).select("id", "hit"))
    titles = lambda df: df.withColumn("k", F.explode(tx.key_set(
        F.col("works"), tx.name_key)))
    by_work = titles(dated).select("id", "k", "birth").join(
        _first_people(titles(people).select("id", "ord", "k", "birth"), ["k", "birth"]),
        ["k", "birth"]).select("id", "hit")
    found = by_name.unionByName(by_url).unionByName(by_life).unionByName(by_work)
    return found.groupBy("id").agg(F.min("hit").alias("hit")).select(
        F.col("id").alias("candidate_id"), F.col("hit.id").alias("duplicate_id"))


def _noted(people: DataFrame, urls: DataFrame) -> DataFrame:
    """First person whose notes contain each url; equal notes are looked through once."""
    notes = _first_people(people.filter("notes <> ''"), ["notes"]).select(
        F.col("hit").alias("id"), F.col("notes").alias("text"))
    met = contained(notes, urls.withColumnRenamed("url", "pattern"))
    return met.groupBy(F.col("pattern").alias("url")).agg(F.min("id").alias("hit"))


def duplicate_pairs(people: DataFrame, limit: int = 20) -> DataFrame:
    """The ``limit`` best-scored likely duplicate pairs within one people table.

    A pair can rank only if both people are among the first ``limit + 1`` of those who
    share their name, birth year and field: an earlier twin scores at least as well and
    comes first. Keeping that many per class makes every join small and the list exact.
    """
    keep = limit + 1
    rows = people.select("id", "ord", "birth", tx.name_key(F.col("name")).alias("nk"),
                         F.array_sort(F.array_distinct(listed("fields"))).alias("fields"))
    fielded = rows.withColumn("field", F.explode(F.concat(
        "fields", F.array(F.lit(None).cast("string")))))

    def first(df, keys):
        ranked = df.withColumn("_rn", F.row_number().over(
            Window.partitionBy(*keys).orderBy("ord")))
        return ranked.filter(F.col("_rn") <= keep).drop("_rn")

    by_name = first(rows, ["nk"])
    by_birth = first(rows, ["nk", "birth"])
    by_field = first(fielded.filter("field is not null"), ["nk", "field"])
    by_both = first(fielded.filter("field is not null"), ["nk", "birth", "field"])
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    years = F.explode(F.sequence(F.col("a_birth") - 3, F.col("a_birth") + 3))
    base = ["id", "ord", "birth", "nk", "fields"]
    out = [f"{p}_{c}" for p in "ab" for c in base]

    def joined(df, on_birth, on_field, names=None):
        left, right = side(df, "a"), side(df, "b")
        if names is None:
            condition = F.col("a_nk") == F.col("b_nk")
        else:
            left = left.join(names, F.col("a_nk") == F.col("short"))
            condition = F.col("long") == F.col("b_nk")
        if on_birth:
            left = left.withColumn("y", years)
            condition = condition & (F.col("y") == F.col("b_birth"))
        if on_field:
            condition = condition & (F.col("a_field") == F.col("b_field"))
        return left.join(right, condition).filter("a_ord <> b_ord").select(*out)

    names = rows.select("nk").filter("length(nk) > 6").distinct()
    contained_names = contained(names.select(F.col("nk").alias("id"), F.col("nk").alias("text")),
                                names.select(F.col("nk").alias("pattern"))).select(
        F.col("id").alias("long"), F.col("pattern").alias("short")).filter("long <> short")
    found = joined(by_name, False, False)
    for df, on_birth, on_field in [(by_birth, True, False), (by_field, False, True),
                                   (by_both, True, True)]:
        found = found.unionByName(joined(df, on_birth, on_field)).unionByName(
            joined(df, on_birth, on_field, contained_names))
    flip = F.col("a_ord") > F.col("b_ord")
    ordered = found.select(*[F.when(flip, F.col(f"{q}_{c}")).otherwise(F.col(f"{p}_{c}"))
                             .alias(f"{p}_{c}") for p, q in ("ab", "ba") for c in base])
    long_names = (F.length("a_nk") > 6) & (F.length("b_nk") > 6)
    within = long_names & (F.col("a_nk").contains(F.col("b_nk"))
                           | F.col("b_nk").contains(F.col("a_nk")))
    points = (F.when(F.col("a_nk") == F.col("b_nk"), 8).otherwise(0)
              + F.when(within, 5).otherwise(0)
              + F.when(F.abs(F.col("a_birth") - F.col("b_birth")) <= 3, 3).otherwise(0)
              + F.when(F.arrays_overlap("a_fields", "b_fields"), 2).otherwise(0))
    scored = ordered.select("a_id", "b_id", points.alias("score"), "a_ord", "b_ord").filter(
        "score >= 7")
    return _first_pairs(scored, limit)


def _first_pairs(scored: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` pairs by score and order, each once. A pair comes as often as there
    are ways to meet it, so a short list of the best rows is taken, longer if it has too few
    pairs; the rows themselves are never sorted or grouped."""
    order = [F.desc("score"), "a_ord", "b_ord"]
    rows = 32 * limit
    while True:
        best = cut_lineage(scored.orderBy(*order).limit(rows))
        pairs = best.groupBy("a_ord", "b_ord").agg(
            F.max("score").alias("score"), F.min("a_id").alias("a_id"), F.min("b_id").alias("b_id"))
        if best.count() < rows or pairs.count() >= limit:
            return pairs.orderBy(*order).limit(limit).select(
                "a_id", "b_id", "score", "a_ord", "b_ord")
        rows *= 8


def conservative_match(records: DataFrame, people: DataFrame) -> DataFrame:
    """Match by name and birth, by a unique name, or by birth, surname and given token.

    People shrink to one row per name, (name, birth) and (birth, surname, token).
    """
    keyed = people.select("id", "ord", "birth", tx.person_key(F.col("name")).alias("k"))
    wanted = records.select("id", "birth", tx.person_key(F.col("name")).alias("k"))
    exact = _first_people(keyed, ["k", "birth"])
    unique = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(
        "ord", "id")).alias("only")).filter("n = 1").drop("n")
    named = (wanted.join(exact, ["k", "birth"], "left").join(unique, "k", "left")
             .withColumn("person_id", F.coalesce("hit.id", "only.id")))

    def tokens(df):
        # Honorifics that never identify a person.
        words = F.filter(F.split("k", " "), lambda t: (F.length(t) > 1)
                         & ~t.isin("sir", "jr", "sr"))
        split = df.withColumn("t", words).filter(F.size("t") > 0)
        return split.select("id", "birth", F.element_at("t", -1).alias("surname"), F.explode(
            F.array_distinct(F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0)))))
            .alias("token"))

    holders = tokens(keyed).groupBy("birth", "surname", "token").agg(
        F.min("id").alias("one"), F.max("id").alias("two"))
    near = (tokens(named.filter("person_id is null").select("id", "birth", "k"))
            .join(holders, ["birth", "surname", "token"]).groupBy("id")
            .agg(F.min("one").alias("one"), F.max("two").alias("two")).filter("one = two")
            .select("id", F.col("one").alias("near_id")))
    method = (F.when(F.col("person_id").isNotNull(), "normalized-name")
              .when(F.col("near_id").isNotNull(), "birth-surname-shared-token"))
    return named.join(near, "id", "left").select(
        "id", F.coalesce("person_id", "near_id").alias("person_id"), method.alias("method"))


def near_misses(records: DataFrame, people: DataFrame) -> DataFrame:
    """New records that share birth year and surname with an existing person."""
    surname = F.element_at(F.split(tx.person_key(F.col("name")), " "), -1)
    left = records.select(F.col("id").alias("record_id"), "birth", surname.alias("s"))
    right = people.select(F.col("id").alias("existing_id"), "birth", surname.alias("s"))
    return left.join(right, ["birth", "s"]).select("record_id", "existing_id")


# Roster spellings and the registry names they stand for.
ROSTER_ALIASES = {
    "curtis t mcmullen": "curtis mcmullen",
    "gregori alexandrovitch margulis": "grigory margulis",
    "ngo bao chau": "ngo bao chau",
    "pierre rene deligne": "pierre deligne",
    "vaughan f r jones": "vaughan jones",
    "w timothy gowers": "timothy gowers",
}


def roster_match(roster: DataFrame, registry: DataFrame) -> DataFrame:
    """Best registry row per roster name: exact, without initials, first and last name,
    unique surname, then containment of whole names."""
    aliases = F.create_map(*[F.lit(x) for kv in ROSTER_ALIASES.items() for x in kv])
    key = tx.person_key(F.col("name"))
    long_words = lambda k: F.array_join(F.filter(
        F.split(k, " "), lambda t: F.length(t) > 1), " ")
    ends = lambda k: F.when(F.size(F.split(k, " ")) > 1, F.concat_ws(
        "|", F.element_at(F.split(k, " "), 1), F.element_at(F.split(k, " "), -1)))
    last = lambda k: F.when(F.size(F.split(k, " ")) > 1,
                            F.element_at(F.split(k, " "), -1))
    wanted = roster.select("id", F.coalesce(F.try_element_at(aliases, key), key).alias("k"))
    rows = registry.select("id", "ord", key.alias("k"))
    stages = []
    for rank, make in enumerate([lambda k: k, long_words, ends]):
        index = _first_people(rows.withColumn("x", make(F.col("k"))), ["x"])
        stages.append(wanted.withColumn("x", make(F.col("k"))).join(index, "x").select(
            "id", F.lit(rank).alias("rank"), "hit"))
    surname = rows.withColumn("x", F.element_at(F.split("k", " "), -1)).groupBy("x").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "id")).alias("hit")).filter("n = 1")
    stages.append(wanted.withColumn("x", last(F.col("k"))).join(surname, "x").select(
        "id", F.lit(3).alias("rank"), "hit"))
    # Containment in either direction.
    firsts = _first_people(rows.filter("k <> ''"), ["k"])
    inside = contained(wanted.select("id", F.col("k").alias("text")),
                       firsts.select(F.col("k").alias("pattern"))).join(
        firsts.withColumnRenamed("k", "pattern"), "pattern")
    around = contained(firsts.select(F.col("k").alias("id"), F.col("k").alias("text")),
                       wanted.select(F.col("k").alias("pattern"))).join(
        firsts.withColumnRenamed("k", "id"), "id").groupBy("pattern").agg(F.min("hit").alias("hit"))
    around = wanted.withColumnRenamed("k", "pattern").join(around, "pattern")
    stages += [df.select("id", F.lit(4).alias("rank"), "hit") for df in (inside, around)]
    found = stages[0]
    for stage in stages[1:]:
        found = found.unionByName(stage)
    return found.groupBy("id").agg(F.min(F.struct("rank", "hit")).alias("best")).select(
        "id", F.col("best.hit.id").alias("registry_id"), F.col("best.rank").alias("rank"))


def award_rows(records: DataFrame) -> DataFrame:
    """(registry_id, year, category, url) of every award occurrence."""
    return records.select("registry_id", F.explode("awards").alias("a")).select(
        "registry_id", F.col("a.year"), F.col("a.category"), F.col("a.url"))


def merge_awards(records: DataFrame) -> DataFrame:
    """One record per registry id: first name, award count and range, fields, sources.

    ``records(registry_id, ord, name, birth, awards, fields, provenance)`` hold arrays;
    the awards themselves stay rows (``award_rows``), the fields are a small vocabulary.
    """
    head = records.groupBy("registry_id").agg(F.min_by(F.struct("name", "birth"), "ord").alias("h"))
    place = F.struct("year", "category")
    awards = award_rows(records).groupBy("registry_id").agg(
        F.count(F.lit(1)).alias("awards"), F.min(place).alias("first_award"),
        F.max(place).alias("last_award"))
    fields = records.select("registry_id", F.explode("fields").alias("f")).groupBy(
        "registry_id").agg(F.array_sort(F.collect_set("f")).alias("fields"))
    sources = first_per(records.select("registry_id", "ord", F.explode("provenance").alias("p"))
                        .select("registry_id", "ord", "p.*"), ["registry_id", "source_url"], "ord")
    counted = sources.groupBy("registry_id").agg(F.count(F.lit(1)).alias("sources"))
    return (head.join(awards, "registry_id", "left").join(fields, "registry_id", "left")
            .join(counted, "registry_id", "left")
            .select("registry_id", "h.name", "h.birth", F.coalesce("awards", F.lit(0))
                    .alias("awards"), "first_award", "last_award", "fields", "sources"))


def award_report(records: DataFrame, merged: DataFrame, matches: DataFrame) -> DataFrame:
    """Long (metric, value) rows: occurrences, people, existing, new, repeated."""
    one = F.count(F.lit(1))
    occurrences = records.agg(F.coalesce(F.sum(F.size("awards")), F.lit(0)).alias("value"))
    people = merged.join(matches, F.col("registry_id") == F.col("id"), "left").agg(
        one.alias("unique_people"), F.count("person_id").alias("existing_matches"),
        F.count_if(F.col("person_id").isNull()).alias("new_people"),
        F.count_if(F.col("awards") > 1).alias("repeat_laureates"))
    rows = people.unpivot([], people.columns, "metric", "value")
    return occurrences.select(F.lit("award_occurrences").alias("metric"), "value").unionByName(rows)


def candidate_confidence(query: Column) -> Column:
    """0..100 match confidence of a candidate row for a query name."""
    # Points per signal.
    signals = [(tx.name_key(query) == tx.name_key(F.col("name")), 55),
               (F.col("birth").isNotNull(), 15),
               (F.coalesce("description", F.lit("")) != "", 10),
               (F.size(listed("fields")) > 0, 8), (F.size(listed("topics")) > 0, 6),
               (F.coalesce("wikipedia_url", F.lit("")) != "", 6)]
    total = F.lit(0)
    for condition, points in signals:
        total = total + F.when(condition, points).otherwise(0)
    return F.least(F.lit(100), total)


def quality_labels(confidence: Column, threshold: int = 70) -> Column:
    """First four quality labels of a candidate row."""
    signals = [F.col("birth").isNotNull(), F.size(listed("fields")) > 0,
               F.size(listed("topics")) > 0, F.size(listed("works")) > 0,
               F.coalesce("movement", F.lit("")) != ""]
    rich = sum((s.cast("int") for s in signals), F.lit(0))
    manual = F.coalesce(F.col("source_url") == "manual-paste", F.lit(False))
    article = F.coalesce("wikipedia_url", F.lit("")) != ""
    url = F.when(manual, "").when(article, F.col("wikipedia_url")).otherwise(
        F.coalesce("source_url", F.lit("")))
    labels = F.array(
        F.when(manual, "Manual paste").when(article, "Wikidata article")
        .otherwise("Wikidata entity"),
        F.when(rich >= 4, "Rich metadata").when(rich >= 2, "Usable metadata")
        .otherwise("Sparse metadata"),
        F.when(confidence >= threshold, "Auto-ready").otherwise("Needs review"),
        F.when(url == "", "Source gap"), F.when(F.col("birth").isNull(), "Missing dates"),
        F.when(F.size(listed("works")) > 0, "Works found"))
    return F.slice(F.array_compact(labels), 1, 4)


def merge_into_people(people: DataFrame, merges: DataFrame, drafts: DataFrame) -> DataFrame:
    """Union candidate metadata into the person each candidate duplicates.

    ``merges(candidate_id, duplicate_id)``; the first candidate per person supplies the
    scalars, all of them the lists.
    """
    offered = merges.join(drafts.withColumnRenamed("id", "candidate_id"), "candidate_id")
    scalars = offered.groupBy("duplicate_id").agg(F.min_by(F.struct(
        "region", "era", "movement"), "ord").alias("s"))
    lists = None
    for column in ["fields", "subfields", "works", "notes"]:
        values = offered.select("duplicate_id", (
            F.col(column) if column == "notes" else F.explode(column)).alias("v")).filter(
            "v is not null").distinct().groupBy("duplicate_id").agg(
            F.array_sort(F.collect_set(F.trim("v"))).alias(f"_{column}"))
        lists = values if lists is None else lists.join(values, "duplicate_id", "full_outer")
    df = (people.join(scalars.withColumnRenamed("duplicate_id", "id"), "id", "left")
          .join(lists.withColumnRenamed("duplicate_id", "id"), "id", "left"))
    filled = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"s.{c}"))
    own_note = F.array_compact(F.array(F.nullif(F.col("notes"), F.lit(""))))
    return df.withColumns({
        **{c: tx.merge_unique_trimmed(F.col(c), F.col(f"_{c}"))
           for c in ["fields", "subfields", "works"]},
        **{c: filled(c) for c in ["region", "era", "movement"]},
        "notes": F.nullif(F.array_join(tx.merge_unique(own_note, F.col("_notes")), " "),
                          F.lit(""))}).select(*people.columns)


def accept_queue(candidates: DataFrame, people: DataFrame) -> DataFrame:
    """Candidates that become people: dated, name unknown and first of their name."""
    from evigraph.operators.entities import unique_ids

    key = tx.name_key(F.col("name"))
    known = people.select(key.alias("_k")).distinct()
    fresh = candidates.filter("birth is not null").withColumn("_k", key).join(
        known, "_k", "left_anti")
    return unique_ids(first_per(fresh, ["_k"], "ord").drop("_k"), people)


def enqueue(queue: DataFrame, arriving: DataFrame) -> DataFrame:
    """Queue plus arriving candidates that are not queued yet, first arrival wins."""
    fresh = first_per(arriving, ["candidate_id"], "ord").join(
        queue.select("candidate_id"), "candidate_id", "left_anti")
    return queue.unionByName(fresh.select(*queue.columns))


def acceptable(candidates: DataFrame, duplicates: DataFrame, confidence: Column,
               threshold: int = 70) -> DataFrame:
    """Dated, confident candidates without a duplicate."""
    return candidates.withColumn("confidence", confidence).filter(
        F.col("birth").isNotNull() & (F.col("confidence") >= threshold)).join(
        duplicates.select(F.col("candidate_id").alias("id")), "id", "left_anti")


def batch_lookup(names: DataFrame, dump: DataFrame) -> DataFrame:
    """Best candidate per queried name, by confidence then dump order."""
    best = (dump.withColumn("_k", tx.name_key(F.col("name"))).withColumn(
        "confidence", candidate_confidence(F.col("name"))).groupBy("_k").agg(
        F.max_by(F.struct("id", "confidence"), F.struct("confidence", -F.col("ord"))).alias("b")))
    return names.withColumn("_k", tx.name_key(F.col("query"))).join(best, "_k", "left").select(
        "query", F.col("b.id").alias("candidate_id"),
        F.coalesce("b.confidence", F.lit(0)).alias("confidence"))
