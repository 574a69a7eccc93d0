"""Record linkage and import review over the bound tables."""

from pyspark.sql import functions as F

from evigraph.operators import entities as en
from evigraph.operators import linkage as ln
from evigraph.operators import pair_counts as pc
from evigraph.plans.catalog import query


def _ids(key):
    return F.create_map(F.lit("viaf"), F.array(F.concat(F.lit("V"), key.cast("string"))),
                        F.lit("isni"), F.array(F.concat(F.lit("I"), (key % 7).cast("string"))))


def _person_records(b):
    none = F.lit(None).cast("array<string>")
    people = b.people.select(
        "id", "ord", "name", none.alias("alternate_names"), "birth", "death",
        F.when(F.col("ord") % 2 == 0, _ids(F.col("ord"))).alias("external_ids"), "fields",
        none.alias("occupations"), "works", "subfields", F.col("subfields").alias("institutions"),
        F.array_compact(F.array("movement")).alias("movements"))
    found = b.candidates.select(
        "id", "ord", "name", F.col("aliases").alias("alternate_names"), "birth", "death",
        _ids(F.col("ord") * 3).alias("external_ids"), "fields", none.alias("occupations"),
        "works", F.col("topics").alias("institutions"),
        F.array_compact(F.array("movement")).alias("movements"))
    return found, people


TEXT_KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def text_key(expression):
    return TEXT_KEY.format(expression)


PERSON_PAIRS = f"""
works_of as (select id, list(distinct {text_key('title')}) as works from person_works group by id),
pairs as (
  select c.id as cid, p.id as pid,
    case when {text_key('c.name')} = {text_key('p.name')} or {text_key('c.alias')} = {text_key('p.name')} then 35 else 0 end as name,
    case when c.birth = p.birth then 18 when abs(c.birth - p.birth) <= 2 then 8 else 0 end as birth,
    case when c.death = p.death then 8 else 0 end as death,
    case when p.pid % 2 = 0 then least(30, 15 * (cast(c.ord * 3 = p.pid as int) + cast((c.ord * 3) % 7 = p.pid % 7 as int))) else 0 end as ids,
    least(8, 4 * len(list_intersect(list_transform(c.fields, lambda f: {text_key('f')}), [{text_key('p.field1')}, {text_key('p.field2')}]))) as fields,
    least(8, 4 * len(list_intersect(list_transform(c.works, lambda f: {text_key('f')}), coalesce(w.works, [])))) as works,
    least(8, 4 * len(list_intersect(list_transform(c.topics, lambda f: {text_key('f')}), case when p.subfield is null then [] else [{text_key('p.subfield')}] end))) as inst,
    case when c.movement = p.movement then 4 else 0 end as mov
  from candidates c cross join people p left join works_of w on w.id = p.id)"""


@query("person_linkage", f"""with {PERSON_PAIRS},
scored as (select *, least(100, name + birth + death + ids + fields + works + inst + mov) as points from pairs)
select cid as candidate_profile, pid as existing_profile, points / 100.0::double as score,
  case when points >= 85 then 'auto-merge' else 'provisional-merge' end as decision,
  array_to_string(list_filter([case when name > 0 then 'name' end, case when birth = 18 then 'birth' end, case when birth = 8 then 'near-birth' end,
    case when death > 0 then 'death' end, case when ids > 0 then 'external-id' end, case when fields > 0 then 'field' end,
    case when works > 0 then 'work' end, case when inst > 0 then 'institution' end, case when mov > 0 then 'movement' end], lambda x: x is not null), '|') as reasons
from scored where points >= 55""")
def person_linkage(b):
    return ln.person_linkage(*_person_records(b)).select(
        "candidate_profile", "existing_profile", "score", "decision",
        F.array_join("reasons", "|").alias("reasons"))


@query("merge_decisions", f"""with {PERSON_PAIRS},
scored as (select p.*, least(100, p.name + p.birth + p.death + p.ids + p.fields + p.works + p.inst + p.mov) as points,
    cast(c.birth <> e.birth as int) as cb, cast(c.death <> e.death as int) as cd
  from pairs p join candidates c on c.id = p.cid join people e on e.id = p.pid),
counted as (select *, coalesce(cb, 0) + coalesce(cd, 0) as conflicts from scored where points >= 55)
select cid as candidate_profile, pid as existing_profile, conflicts,
  case when conflicts > 0 then 'conflict' when points >= 85 then 'auto-merge' else 'provisional-merge' end as decision,
  not (conflicts = 0 and points >= 85) as manual_review
from counted""")
def merge_decisions(b):
    found, people = _person_records(b)
    matches = ln.person_linkage(found, people)
    conflicts = ln.preserved_conflicts(matches, found, people, ["birth", "death"])
    return ln.with_conflicts(matches, conflicts).select(
        "candidate_profile", "existing_profile", "conflicts", "decision", "manual_review")


def _copied_records(b):
    """Candidates, every third of them twice, and people, each with their members."""
    found, people = _person_records(b)
    copies = found.filter("ord % 3 = 0").withColumns({
        "id": F.concat("id", F.lit("-copy")), "ord": F.col("ord") + 1000000000})
    both, people = (df.withColumn("movement", F.get("movements", F.lit(0)))
                    for df in (found.unionByName(copies), people))
    return (both, ln.person_profiles(both)[1]), (people, ln.person_profiles(people)[1])


COPIES = """copies as (select id, id as rid from candidates union all select id, id || '-copy' from candidates where ord % 3 = 0),
matched as (select cid, pid from pairs where name + birth + death + ids + fields + works + inst + mov >= 55)"""
CONFLICTS = COPIES + """,
facts as (select c.id as profile, 'candidate' as side, unnest([{'f': 'birth', 'v': cast(birth as varchar)}, {'f': 'death', 'v': cast(death as varchar)}, {'f': 'movement', 'v': movement}]) as x, rid from candidates c join copies using (id)
  union all select id, 'existing', unnest([{'f': 'birth', 'v': cast(birth as varchar)}, {'f': 'death', 'v': cast(death as varchar)}, {'f': 'movement', 'v': movement}]), id from people),
stated as (select m.cid, m.pid, f.side, f.x.f as field, f.x.v as value, count(*) as records from matched m join facts f
  on f.profile = case f.side when 'candidate' then m.cid else cast(m.pid as varchar) end where f.x.v is not null group by all),
torn as (select cid, pid, field from stated group by all having count(distinct side) = 2 and count(distinct value) > 1),
conflicts as (select s.* from stated s join torn using (cid, pid, field))"""


@query("record_matches", f"""with {PERSON_PAIRS}, {COPIES}
select m.cid as candidate_profile, cast(m.pid as varchar) as existing_profile, 'candidate' as side, c.rid as record_id from matched m join copies c on c.id = m.cid
union all select cid, cast(pid as varchar), 'existing', cast(pid as varchar) from matched""")
def record_matches(b):
    (found, copies), (people, known) = _copied_records(b)
    matches = ln.person_linkage(found, people)
    return ln.matched_records(matches, copies, "candidate").unionByName(
        ln.matched_records(matches, known, "existing"))


@query("record_conflicts", f"""with {PERSON_PAIRS}, {CONFLICTS}
select cid as candidate_profile, cast(pid as varchar) as existing_profile, field, side, value, records from conflicts""")
def record_conflicts(b):
    left, right = _copied_records(b)
    matches = ln.person_linkage(left[0], right[0])
    return ln.record_conflicts(matches, left, right, ["birth", "death", "movement"])


@query("conflict_evidence", f"""with {PERSON_PAIRS}, {CONFLICTS}
select c.cid as candidate_profile, cast(c.pid as varchar) as existing_profile, c.field, c.side, c.value, c.records, 'q' || cast(e.user_id as varchar) as record_id,
  'c' || cast(e.event_id as varchar) as claim_id, 'o' || cast(e.event_id // 10 as varchar) as observation_id
from conflicts c join events e on c.cid = 'q' || cast(e.user_id as varchar) join candidates q on q.id = c.cid
where c.side = 'candidate' and e.event_id % 2 = 1 and c.field = 'birth' and c.value = cast(q.birth as varchar)
union all
select c.cid, cast(c.pid as varchar), c.field, c.side, c.value, c.records, cast(c.pid as varchar), 'c' || cast(e.event_id as varchar), 'o' || cast(e.event_id // 10 as varchar)
from conflicts c join events e on e.event_id // 7 = c.pid join people p on p.pid = c.pid
where c.side = 'existing' and e.event_id % 2 = 0 and c.field = 'birth' and c.value = cast(p.birth as varchar)""")
def conflict_evidence(b):
    """Odd events state the birth of a candidate, even ones that of a person."""
    n = F.col("event_id")
    left, right = _copied_records(b)
    subject = F.when(n % 2 == 1, F.concat(F.lit("q"), F.col("user_id").cast("string"))
                     ).otherwise(F.expr("event_id div 7").cast("string"))
    facts = left[0].select("id", F.lit("birth").alias("field"), F.col("birth").alias("v")).union(
        right[0].select("id", F.lit("birth"), "birth")).select(
        F.col("id").alias("subject_id"), "field", F.col("v").cast("string").alias("value"))
    claims = b.table("events").select(
        F.concat(F.lit("c"), n.cast("string")).alias("id"), F.concat(
            F.lit("o"), F.expr("event_id div 10").cast("string")).alias("observation_id"),
        subject.alias("subject_id")).join(facts, "subject_id")
    matches = ln.person_linkage(left[0], right[0])
    conflicts = ln.record_conflicts(matches, left, right, ["birth", "death", "movement"])
    return ln.conflict_evidence(conflicts, left[1], right[1], claims)


@query("work_linkage", """with
works as (select p_partkey as k, 'w' || cast(p_partkey as varchar) as id, p_name || ' ' || cast(p_partkey % 300 as varchar) as title, 'a' || cast(p_size as varchar) as author,
  cast(1800 + p_size as int) as date, '10.1/' || cast(p_partkey // 2 as varchar) as doi, case when p_partkey % 3 = 0 then 'i' || cast(p_partkey // 4 as varchar) end as isbn from part),
pairs as (
  select c.id as cid, e.id as eid, case when c.doi = e.doi then 35 else 0 end + case when c.isbn = e.isbn then 25 else 0 end
   + case when c.title = e.title then 25 else 0 end + case when c.author = e.author then 15 else 0 end
   + case when c.date = e.date then 10 when abs(c.date - e.date) <= 2 then 4 else 0 end as points
  from works c join works e on c.k % 2 = 0 and e.k % 2 = 1 or (c.k % 2 = 0 and e.k % 3 = 0))
select cid as candidate_profile, eid as existing_profile, least(100, points) / 100.0::double as score from pairs where points >= 55""")
def work_linkage(b):
    key = F.col("p_partkey")
    works = b.table("part").select(
        key.alias("ord"), F.concat(F.lit("w"), key.cast("string")).alias("id"),
        F.concat("p_name", F.lit(" "), (key % 300).cast("string")).alias("title"),
        F.lit(None).cast("array<string>").alias("translated_titles"),
        F.array(F.concat(F.lit("a"), F.col("p_size").cast("string"))).alias("author_ids"),
        F.lit(None).cast("array<string>").alias("author_names"),
        (1800 + F.col("p_size")).cast("int").alias("date"),
        F.struct(F.concat(F.lit("https://doi.org/10.1/"), F.expr("p_partkey div 2").cast("string"))
                 .alias("doi"),
                 F.when(key % 3 == 0, F.concat(F.lit("I"), F.expr("p_partkey div 4")
                                               .cast("string"))).alias("isbn"),
                 F.lit(None).cast("string").alias("openalex"),
                 F.lit(None).cast("string").alias("wikidata")).alias("identifiers"))
    return ln.work_linkage(works.filter("ord % 2 = 0"),
                           works.filter("ord % 2 = 1 or ord % 3 = 0")).select(
        "candidate_profile", "existing_profile", "score")


@query("entity_linkage", """with
ents as (select s_suppkey as k, 'e' || cast(s_suppkey as varchar) as id, case s_suppkey % 3 when 0 then 'Institution' when 1 then 'Movement' else 'Concept' end as type,
  'Label ' || cast(s_suppkey // 6 as varchar) as label, 'v' || cast(s_suppkey // 6 as varchar) as ext, case when s_suppkey % 2 = 0 then 'City ' || cast(s_suppkey // 12 as varchar) end as city,
  cast(1700 + s_suppkey % 30 as int) as start, cast(1800 + s_suppkey % 17 as int) as fin, 'Field ' || cast(s_nationkey % 3 as varchar) as field, 'Broad ' || cast(s_suppkey % 4 as varchar) as broad from supplier),
pairs as (
  select a.id as cid, b.id as eid, case when a.label = b.label then 40 else 0 end + case when a.ext = b.ext then 15 else 0 end
    + case when a.type = 'Institution' and a.city = b.city then 15 else 0 end
    + case when a.type = 'Movement' then 10 * (cast(abs(a.start - b.start) <= 10 as int) + cast(abs(a.fin - b.fin) <= 10 as int)) else 0 end
    + case when a.type = 'Concept' and a.broad = b.broad then 15 else 0 end + case when a.field = b.field then 5 else 0 end as points
  from ents a join ents b on a.type = b.type)
select cid as candidate_profile, eid as existing_profile, points / 100.0::double as score from pairs where points >= 55""")
def entity_linkage(b):
    key = F.col("s_suppkey")
    s = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    none = F.lit(None).cast("array<string>")
    table = b.table("supplier").select(
        key.alias("ord"), s("e", key).alias("id"),
        F.when(key % 3 == 0, "Institution").when(key % 3 == 1, "Movement").otherwise("Concept")
        .alias("type"), s("Label ", F.expr("s_suppkey div 6")).alias("label"),
        none.alias("alternate_labels"),
        F.create_map(F.lit("viaf"), F.array(s("v", F.expr("s_suppkey div 6"))))
        .alias("external_ids"),
        F.when(key % 2 == 0, s("City ", F.expr("s_suppkey div 12"))).alias("city"),
        (1700 + key % 30).cast("int").alias("start"), (1800 + key % 17).cast("int").alias("end"),
        F.array(s("Field ", F.col("s_nationkey") % 3)).alias("fields"),
        F.array(s("Broad ", key % 4)).alias("broader_terms"))
    return ln.entity_linkage(table, table).select("candidate_profile", "existing_profile", "score")


FIRST_DUPLICATE = """
name_key as (select id, pid, birth, death, notes, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') as k from people),
cand_names as (
  select id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') as k from candidates
  union select id, regexp_replace(lower(alias), '[^a-z0-9]', '', 'g') from candidates where alias is not null
  union select id, 'alias' from candidates where alias is not null
  union select id, regexp_replace(lower(regexp_extract(alias, '\\(([^)]*)\\)', 1)), '[^a-z0-9]', '', 'g') from candidates where alias is not null),
hits as (
  select c.id as cid, p.pid from cand_names c join name_key p on p.k = c.k
  union select c.id, p.pid from candidates c join name_key p on contains(p.notes, c.source_url) or contains(p.notes, c.wikipedia_url)
  union select c.id, p.pid from candidates c join name_key p on abs(c.birth - p.birth) <= 2 and (
     abs(c.death - p.death) <= 2 or exists (select 1 from person_works w where w.id = p.id and list_contains(c.works, w.title)))),
dupes as (select cid as candidate_id, cast(min(pid) as varchar) as duplicate_id from hits group by cid)"""


@query("candidate_duplicates", f"with {FIRST_DUPLICATE} select * from dupes")
def candidate_duplicates(b):
    return ln.first_duplicate(b.candidates, b.people)


@query("duplicate_pairs", """with
keys as (select *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') as nk from people),
pairs as (
  select a.id as a_id, b.id as b_id, a.pid as ap, b.pid as bp,
    case when a.nk = b.nk then 8 else 0 end + case when length(a.nk) > 6 and length(b.nk) > 6 and (contains(a.nk, b.nk) or contains(b.nk, a.nk)) then 5 else 0 end
    + case when abs(a.birth - b.birth) <= 3 then 3 else 0 end
    + case when a.field1 in (b.field1, b.field2) or a.field2 in (b.field1, b.field2) then 2 else 0 end as score
  from keys a join keys b on a.pid < b.pid)
select a_id, b_id, score from pairs where score >= 7 order by score desc, ap, bp limit 20""")
def duplicate_pairs(b):
    return ln.duplicate_pairs(b.people_core).select("a_id", "b_id", "score")


def _short_candidates(b):
    """Candidates whose names keep only the given word and the number for some."""
    n = F.col("ord")
    words = F.split("name", " ")
    name = F.when(n % 3 == 0, F.concat_ws(" ", words[0], F.element_at(words, -1))).otherwise(
        F.col("name"))
    return b.candidates.filter("birth is not null").select(
        "id", "ord", name.alias("name"), (F.col("birth") - n % 3).cast("int").alias("birth"))


SHORT = """
short as (
  select id, ord, case when ord % 3 = 0 then split_part(name, ' ', 1) || ' ' || string_split(name, ' ')[-1] else name end as name, cast(birth - ord % 3 as int) as birth
  from candidates where birth is not null),
toks as (select *, list_filter(string_split(name, ' '), lambda t: length(t) > 1 and t not in ('sir', 'jr', 'sr')) as t from short),
ptoks as (select *, list_filter(string_split(name, ' '), lambda t: length(t) > 1 and t not in ('sir', 'jr', 'sr')) as t from people)"""


@query("conservative_match", f"""with {SHORT},
exact as (select s.id, min(p.pid) as pid from short s join people p on p.name = s.name and p.birth = s.birth group by 1),
single as (select s.id, min(p.pid) as pid from short s join people p on p.name = s.name group by 1 having count(*) = 1),
named as (select s.id, coalesce(e.pid, u.pid) as pid from short s left join exact e on e.id = s.id left join single u on u.id = s.id),
near as (
  select s.id, min(p.pid) as pid from toks s join ptoks p on p.birth = s.birth and p.t[-1] = s.t[-1] and len(list_intersect(s.t[:-2], p.t[:-2])) > 0
  where s.id in (select id from named where pid is null) group by 1 having count(*) = 1)
select n.id, cast(coalesce(n.pid, r.pid) as varchar) as person_id,
  case when n.pid is not null then 'normalized-name' when r.pid is not null then 'birth-surname-shared-token' end as method
from named n left join near r on r.id = n.id""")
def conservative_match(b):
    return ln.conservative_match(_short_candidates(b), b.people_core)


@query("near_misses", f"""with {SHORT}
select s.id as record_id, p.id as existing_id from short s join people p on p.birth = s.birth and string_split(p.name, ' ')[-1] = string_split(s.name, ' ')[-1]""")
def near_misses(b):
    return ln.near_misses(_short_candidates(b), b.people_core)


@query("near_miss_counts", f"""with {SHORT},
a as (select birth, lower(string_split(name, ' ')[-1]) as surname, count(*) as records from short group by 1, 2),
b as (select birth, lower(string_split(name, ' ')[-1]) as surname, count(*) as people from people group by 1, 2)
select birth, surname, records, people, records * people as pairs from a join b using (birth, surname)""")
def near_miss_counts(b):
    return pc.near_miss_counts(_short_candidates(b), b.people_core)


@query("roster_match", f"""with {SHORT},
r as (select id, pid, name as k from people),
sig as (select s.id, s.name as k, array_to_string(list_filter(string_split(s.name, ' '), lambda t: length(t) > 1), ' ') as sg, string_split(s.name, ' ') as t from short s),
rs as (select *, array_to_string(list_filter(string_split(k, ' '), lambda t: length(t) > 1), ' ') as sg, string_split(k, ' ') as t from r),
stages as (
  select s.id, 0 as rank, min(r.pid) as pid from sig s join rs r on r.k = s.k group by 1
  union all select s.id, 1, min(r.pid) from sig s join rs r on r.sg = s.sg group by 1
  union all select s.id, 2, min(r.pid) from sig s join rs r on r.t[1] = s.t[1] and r.t[-1] = s.t[-1] group by 1
  union all select s.id, 3, min(r.pid) from sig s join rs r on r.t[-1] = s.t[-1] group by 1 having count(*) = 1
  union all select s.id, 4, min(r.pid) from sig s join rs r on contains(s.k, r.k) or contains(r.k, s.k) group by 1)
select id, cast(min_by(pid, rank) as varchar) as registry_id, min(rank) as rank from stages group by id""")
def roster_match(b):
    return ln.roster_match(_short_candidates(b), b.people_core)


def _awards(b):
    """Award records: one per event, keyed by user."""
    n = F.col("event_id")
    return b.table("events").select(
        F.concat(F.lit("Q"), F.col("user_id").cast("string")).alias("registry_id"),
        n.alias("ord"), F.concat(F.lit("Laureate "), n.cast("string")).alias("name"),
        (1900 + n % 50).cast("int").alias("birth"),
        F.array(F.struct((1950 + n % 40).cast("int").alias("year"),
                         F.col("event_type").alias("category"),
                         F.lit("https://prize.example.org").alias("url"))).alias("awards"),
        F.array(F.concat(F.lit("f"), (n % 3).cast("string"))).alias("fields"),
        F.array(F.struct(F.concat(F.lit("https://s"), (n % 4).cast("string")).alias("source_url")))
        .alias("provenance"))


@query("award_merge", """with a as (select 'Q' || cast(user_id as varchar) as registry_id, event_id, event_type, 1950 + event_id % 40 as year from events)
select registry_id, min_by('Laureate ' || cast(event_id as varchar), event_id) as name, count(*) as awards,
  min(cast(year as varchar) || event_type) as first_award, max(cast(year as varchar) || event_type) as last_award,
  array_to_string(list_sort(list(distinct 'f' || cast(event_id % 3 as varchar))), '|') as fields, count(distinct event_id % 4) as sources
from a group by 1""")
def award_merge(b):
    text = lambda c: F.concat(F.col(f"{c}.year").cast("string"), F.col(f"{c}.category"))
    return ln.merge_awards(_awards(b)).select(
        "registry_id", "name", "awards", text("first_award").alias("first_award"),
        text("last_award").alias("last_award"), F.array_join("fields", "|").alias("fields"),
        "sources")


@query("award_rows", "select 'Q' || cast(user_id as varchar) as registry_id, cast(1950 + event_id % 40 as int) as year, event_type as category from events")
def award_rows(b):
    return ln.award_rows(_awards(b)).select("registry_id", "year", "category")


@query("award_report", """with m as (select user_id, min(event_id) as e, count(*) as n from events group by 1),
x as (select m.*, exists (select 1 from people p where p.pid = m.user_id and p.pid % 3 = 0) as known from m)
select 'award_occurrences' as metric, count(*) as value from events
union all select 'unique_people', count(*) from x union all select 'existing_matches', count(*) filter (where known) from x
union all select 'new_people', count(*) filter (where not known) from x union all select 'repeat_laureates', count(*) filter (where n > 1) from x""")
def award_report(b):
    records = _awards(b)
    matches = b.people_core.filter("ord % 3 = 0").select(
        F.concat(F.lit("Q"), "id").alias("id"), F.col("id").alias("person_id"))
    return ln.award_report(records, ln.merge_awards(records), matches)


CONFIDENCE = """case when ord % 2 = 0 then 55 else 0 end + case when birth is not null then 15 else 0 end + case when description is not null then 10 else 0 end
  + case when len(fields) > 0 then 8 else 0 end + case when len(topics) > 0 then 6 else 0 end + case when wikipedia_url is not null then 6 else 0 end"""


def _confidence():
    asked = F.when(F.col("ord") % 2 == 0, F.upper("name")).otherwise(F.lit("someone else"))
    return ln.candidate_confidence(asked)


@query("candidate_confidence", f"select id, {CONFIDENCE} as confidence from candidates")
def candidate_confidence(b):
    return b.candidates.select("id", _confidence().alias("confidence"))


@query("quality_labels", f"""with s as (select *, {CONFIDENCE} as conf,
  cast(birth is not null as int) + cast(len(fields) > 0 as int) + cast(len(topics) > 0 as int) + 1 + cast(movement is not null as int) as rich from candidates)
select id, array_to_string(list_filter([case when wikipedia_url is not null then 'Wikidata article' else 'Wikidata entity' end,
  case when rich >= 4 then 'Rich metadata' when rich >= 2 then 'Usable metadata' else 'Sparse metadata' end,
  case when conf >= 70 then 'Auto-ready' else 'Needs review' end, case when birth is null then 'Missing dates' end, 'Works found'], lambda x: x is not null)[1:4], '|') as labels from s""")
def quality_labels(b):
    return b.candidates.select("id", F.array_join(ln.quality_labels(_confidence()), "|")
                               .alias("labels"))


@query("merged_duplicates", f"""with {FIRST_DUPLICATE},
offered as (select d.duplicate_id as id, c.ord, unnest(c.works) as w from dupes d join candidates c on c.id = d.candidate_id),
scal as (select d.duplicate_id as id, min_by(coalesce(c.movement, 'Imported'), c.ord) as movement from dupes d join candidates c on c.id = d.candidate_id group by 1),
all_works as (select id, title as w from person_works union select id, w from offered)
select p.id, coalesce(p.movement, s.movement) as movement, (select count(*) from all_works a where a.id = p.id) as works from people p left join scal s on s.id = p.id""")
def merged_duplicates(b):
    merges = ln.first_duplicate(b.candidates, b.people)
    return ln.merge_into_people(b.people, merges, en.drafts(b.candidates)).select(
        "id", "movement", F.size("works").cast("long").alias("works"))


@query("accepted_imports", """with k as (select *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') as nk from candidates where birth is not null),
firsts as (select *, row_number() over (partition by nk order by ord) as rn from k)
select id, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') as person_id from firsts where rn = 1
  and nk not in (select regexp_replace(lower(name), '[^a-z0-9]', '', 'g') from people)""")
def accepted_imports(b):
    return ln.accept_queue(b.candidates, b.people_core).select("id", "person_id")


@query("import_queue_growth", "select id as candidate_id from candidates")
def import_queue_growth(b):
    rows = b.candidates.select(F.col("id").alias("candidate_id"), "ord", "name")
    return ln.enqueue(rows.filter("ord % 2 = 0"), rows.unionByName(rows)).select("candidate_id")


NAME_DUPLICATE = FIRST_DUPLICATE[:FIRST_DUPLICATE.index("  union select c.id, p.pid from candidates c join name_key p on abs(")] + """),
dupes as (select cid as candidate_id, min(pid) as duplicate_id from hits group by cid)"""


@query("acceptable_imports", f"""with {NAME_DUPLICATE}
select id, {CONFIDENCE} as confidence from candidates where birth is not null and {CONFIDENCE} >= 30 and id not in (select candidate_id from dupes)""")
def acceptable_imports(b):
    # Without dates of death and works only names and addresses make duplicates.
    undated = b.candidates.withColumns({
        "death": F.lit(None).cast("int"), "works": F.array().cast("array<string>")})
    dupes = ln.first_duplicate(undated, b.people)
    return ln.acceptable(b.candidates, dupes, _confidence(), 30).select("id", "confidence")


@query("batch_lookup", """with best as (
  select *, 70 + case when description is not null then 10 else 0 end + case when len(fields) > 0 then 8 else 0 end + case when len(topics) > 0 then 6 else 0 end
    + case when wikipedia_url is not null then 6 else 0 end - case when birth is null then 15 else 0 end as confidence from candidates),
tops as (select name, max_by(id, row(confidence, -ord)) as id, max(confidence) as confidence from best group by name)
select distinct p.name as query, t.id as candidate_id, coalesce(t.confidence, 0) as confidence from people p left join tops t on t.name = p.name""")
def batch_lookup(b):
    names = b.people_core.select(F.col("name").alias("query")).distinct()
    return ln.batch_lookup(names, b.candidates)
