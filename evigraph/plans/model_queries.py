"""Schema enforcement and entity builders over the bound tables."""

from pyspark.sql import functions as F

from evigraph.functions import taxonomy as tax
from evigraph.functions import text as tx
from evigraph.operators import entities as en
from evigraph.operators import normalize as nz
from evigraph.operators.edge_validation import listed
from evigraph.functions import vocab
from evigraph.plans.catalog import query

_WHOLE_SLUG = "trim(regexp_replace(replace(replace(lower(trim({0})), '''', ''), '\"', ''), '[^a-z0-9]+', '-', 'g'), '-')"
SLUG = (f"case when length({_WHOLE_SLUG}) > 80 then substr({_WHOLE_SLUG}, 1, 80) || '-' || substr(md5({_WHOLE_SLUG}), 1, 8) "
        f"else coalesce(nullif({_WHOLE_SLUG}, ''), 'untitled') end")


def slug(expression: str) -> str:
    return SLUG.format(expression)


def _raw_people(b):
    """People with injected schema faults."""
    n = F.col("ord")
    return b.people_core.withColumns({
        "name": F.when(n % 31 != 0, F.col("name")),
        "birth": F.when(n % 37 == 0, float("nan")).otherwise(F.col("birth").cast("double")),
        "fields": F.when(n % 41 == 0, F.array().cast("array<string>")).otherwise(F.col("fields"))})


@query("people_enforced", """
select id, cast(birth as double) as birth, len(case when subfield is not null then [subfield] else [] end) as n_subfields
from people where pid % 31 <> 0 and pid % 37 <> 0 and pid % 41 <> 0""")
def people_enforced(b):
    kept, _ = nz.people(_raw_people(b))
    return kept.select("id", "birth", F.size("subfields").cast("long").alias("n_subfields"))


@query("people_issues", """
select 'people[' || id || ']' as path, array_to_string(list_filter([
   case when pid % 31 = 0 then 'name must be a string' end, case when pid % 37 = 0 then 'birth must be a number' end,
   case when pid % 41 = 0 then 'fields must not be empty' end], lambda x: x is not null), '; ') as message
from people where pid % 31 = 0 or pid % 37 = 0 or pid % 41 = 0""")
def people_issues(b):
    _, rejects = nz.people(_raw_people(b))
    return nz.issues("people", rejects)


@query("edges_enforced", """
select e.id, e.source, e.target, conf100 / 100.0::double as confidence,
       coalesce(status, case when not has_evidence then 'needs_source' when coalesce(conf100, 0) >= 75 then 'accepted' else 'suggested' end) as status,
       coalesce(len(source_claims), 0) as n_urls, coalesce(len(claim_ids), 0) as n_claims
from edge_flags e where e.source in (select id from people) and e.target in (select id from people)""")
def edges_enforced(b):
    kept, _ = nz.edges(b.edges, b.people_core)
    return kept.select("id", "source", "target", "confidence", "status",
                       F.size("source_claims").cast("long").alias("n_urls"),
                       F.size("claim_ids").cast("long").alias("n_claims"))


@query("edge_rejects", """
select 'edges[' || id || ']' as path, array_to_string(list_filter([
   case when source not in (select id from people) then 'source person is missing' end,
   case when target not in (select id from people) then 'target person is missing' end], lambda x: x is not null), '; ') as message
from edges where source not in (select id from people) or target not in (select id from people)""")
def edge_rejects(b):
    _, rejects = nz.edges(b.edges, b.people_core)
    return nz.issues("edges", rejects)


@query("edge_dedupe", """
select source, target, id, coalesce(status, case when not has_evidence then 'needs_source' when coalesce(conf100, 0) >= 75 then 'accepted' else 'suggested' end) as status
from (select *, row_number() over (partition by source, target order by eid) as rn from edge_flags) where rn = 1""")
def edge_dedupe(b):
    return nz.seed_edges(b.edges).select("source", "target", "id", "status")


@query("canonical_integrity", """
select code, count(*) as findings from (
  select 'impossible-dates' as code from people where death < birth
  union all select 'self-link' from edges where source = target
  union all select 'missing-source' from edges where source not in (select id from people)
  union all select 'missing-target' from edges where target not in (select id from people)) group by code""")
def canonical_integrity(b):
    return nz.integrity(b.people_core, b.edges).groupBy("code").agg(
        F.count(F.lit(1)).alias("findings"))


@query("import_queue_rows", """
select id, cast(ord % 140 as int) as raw_confidence, least(100, cast(ord % 140 as int)) as confidence,
       case when ord % 5 = 0 then 'edited' when ord % 3 = 0 then 'duplicate' else 'queued' end as status
from candidates where ord % 9 <> 0""")
def import_queue_rows(b):
    n = F.col("ord")
    rows = b.candidates.select(
        "id", F.when(n % 9 != 0, F.col("id")).alias("candidate_id"),
        F.col("name").alias("candidate_name"), (n % 140).cast("int").alias("raw_confidence"),
        (n % 140).cast("double").alias("confidence"),
        F.when(n % 3 == 0, F.lit("x")).alias("duplicate_id"),
        F.when(n % 5 == 0, "edited").when(n % 7 == 0, "bogus").alias("status"))
    return nz.import_queue(rows).select("id", "raw_confidence", "confidence", "status")


@query("link_queue_rows", """
select id, source as source_id, source as source_name, coalesce(note, 'Queued suggested relationship.') as reason,
       case when conf100 is null then 1.0::double else conf100 / 100.0::double end as score from edges""")
def link_queue_rows(b):
    rows = b.edges.select(
        "id", F.col("source").alias("source_id"), F.col("target").alias("target_id"),
        F.lit("").alias("source_name"), F.lit(None).cast("string").alias("target_name"),
        F.col("note").alias("reason"), F.col("confidence").alias("score"),
        F.lit(None).cast("timestamp").alias("created_at"))
    return nz.link_queue(rows, b.now).select("id", "source_id", "source_name", "reason", "score")


@query("claims_materialized", f"""
select 'claim:' || {slug("subject_id")} || ':' || {slug("field")} || ':' || {slug("source_name")} || ':' || {slug("value")} as id,
       source_name || ': ' || field as label, case when event_id % 3 = 0 then 'observed' else status end as status,
       case when event_id % 2 = 0 then 1.0 else 0.5 end::double as confidence
from claims""")
def claims_materialized(b):
    n = F.col("ord")
    drafts = b.claims.withColumns({
        "id": F.lit(None).cast("string"), "label": F.lit(None).cast("string"),
        "status": F.when(n % 3 == 0, "whatever").otherwise(F.col("status")),
        "confidence": F.when(n % 2 == 0, 1.7)})
    return nz.claims(drafts).select("id", "label", "status", "confidence")


@query("unusable_urls", """
select id, 'claim' as kind, 'Source claim ' || id || ' has no usable source URL.' as message from claims where source_url is null
union all
select 'p' || cast(page_id as varchar), 'observation', 'Source observation p' || cast(page_id as varchar) || ' has no usable source URL.'
from pages where not regexp_matches(lower(url), '^https?://')""")
def unusable_urls(b):
    pages = b.table("pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"),
        F.col("url").alias("source_url"))
    return nz.unusable_urls(b.claims, "claim").unionByName(
        nz.unusable_urls(pages, "observation"))


@query("person_nodes", "select 'person:' || id as id, name as label, birth, death, field1 || '|' || field2 as fields from people")
def person_nodes(b):
    return en.persons(b.people_core).select("id", "label", "birth", "death",
                                            F.array_join("fields", "|").alias("fields"))


@query("work_nodes", f"""
select 'work:' || {slug('id')} || ':' || {slug('title')} as id, title as label, 'person:' || id as author
from person_works where id in (select id from people)""")
def work_nodes(b):
    return en.works(b.people).select("id", "label", F.col("author_ids")[0].alias("author"))


@query("authorship", f"""
select 'relationship:person:' || id || ':person authored work:work:' || {slug('id')} || ':' || {slug('title')} as id,
       'person:' || id || ' authored ' || title as label, 'accepted' as status
from person_works where id in (select id from people)""")
def authorship(b):
    return en.authorship(b.people).select("id", "label", "status")


@query("concept_nodes", f"""
select 'concept:' || {slug('subfield')} as id, max_by(subfield, p.pid) as label,
       array_to_string(list_sort(list(distinct field)), '|') as fields
from people p join person_fields f using (id) where subfield is not null group by 1""")
def concept_nodes(b):
    return en.concepts(b.people_core).select("id", "label",
                                             F.array_join("fields", "|").alias("fields"))


@query("movement_nodes", f"""with curated as (
  select n_name as name, cast(1500 + n_nationkey as int) as start_year, 'Music' as field from nation where n_nationkey % 2 = 0),
ids as (select 'movement:' || {slug('movement')} as id, movement, field, p.pid from people p join person_fields f using (id) where movement is not null),
seen as (select id, min_by(movement, pid) as label from ids group by 1),
cur as (select 'movement:' || {slug('name')} as id, name, start_year, field from curated),
all_fields as (select id, field from ids union select id, field from cur),
joined as (select coalesce(c.id, s.id) as id, coalesce(c.name, s.label) as label, c.start_year from cur c full join seen s on s.id = c.id)
select j.id, j.label, j.start_year as start, array_to_string(list_sort(list(f.field)), '|') as fields
from joined j join all_fields f on f.id = j.id group by 1, 2, 3""")
def movement_nodes(b):
    n = F.col("n_nationkey")
    curated = b.table("nation").filter(n % 2 == 0).select(
        F.col("n_name").alias("name"), (1500 + n).cast("int").alias("start"),
        F.lit(None).cast("int").alias("end"), F.array(F.lit("Music")).alias("fields"))
    return en.movements(b.people_core, curated).select(
        "id", "label", "start", F.array_join("fields", "|").alias("fields"))


@query("relationship_nodes", f"""
select id, 'person:' || source || ' ' || type || ' person:' || target as label, type as relationship_type, status,
  case when coalesce(len(source_claims), 0) > 0 then
    'claim:' || {slug('id')} || ':sourceclaims-0:' || {slug("regexp_extract(source_claims[1], '^https?://(www[.])?([^/]+)', 2)")} || ':' || {slug('source_claims[1]')}
  end as first_claim from edges""")
def relationship_nodes(b):
    return en.relationships(b.edges).select(
        "id", "label", "relationship_type", "status",
        F.get("claim_ids", F.lit(0)).alias("first_claim"))


@query("edge_claims_built", f"""
select 'claim:' || {slug('id')} || ':sourceclaims-0:' || {slug("regexp_extract(source_claims[1], '^https?://(www[.])?([^/]+)', 2)")} || ':' || {slug('source_claims[1]')} as id,
  id as subject_id, regexp_extract(source_claims[1], '^https?://(www[.])?([^/]+)', 2) as source_name, source_claims[1] as value,
  coalesce(conf100, 50) / 100.0::double as confidence
from edges where coalesce(len(source_claims), 0) > 0""")
def edge_claims_built(b):
    return en.edge_claims(b.edges).select("id", "subject_id", "source_name", "value", "confidence")


@query("expanded_entities", f"""
select type, count(*) as entities from (
  select 'Person' as type from people
  union all select 'Work' from person_works where id in (select id from people)
  union all select 'Concept' from (select distinct {slug('subfield')} from people where subfield is not null)
  union all select 'Movement' from (select distinct {slug('movement')} from people where movement is not null)
  union all select 'Relationship' from edges
  union all select 'SourceClaim' from edges where coalesce(len(source_claims), 0) > 0) group by type""")
def expanded_entities(b):
    return en.expanded(b.people, b.edges).groupBy("type").agg(F.count(F.lit(1)).alias("entities"))


@query("entities_enforced", """
select type, count(*) as kept from (
  select 'Person' as type from people where pid % 7 <> 0
  union all select 'Relationship' from edges where eid % 5 <> 0) group by type""")
def entities_enforced(b):
    people = en.persons(b.people_core.withColumn(
        "fields", F.when(F.col("ord") % 7 != 0, F.col("fields"))))
    edges = en.relationships(b.edges.withColumn(
        "target", F.when(F.col("ord") % 5 != 0, F.col("target"))))
    columns = ["id", "type", "label", "thinker_id", "birth", "fields", "source_id", "target_id",
               "relationship_type"]
    mixed = people.unionByName(edges, allowMissingColumns=True).select(*columns)
    kept, _ = nz.entities(mixed.withColumn("label", F.coalesce("label", "id")))
    return kept.groupBy("type").agg(F.count(F.lit(1)).alias("kept"))


@query("metadata_edges", """
select i.id as source, i.target, 'https://en.wikipedia.org/wiki/' || replace(t.name, ' ', '_') as url
from person_influenced i join people p on p.id = i.id join people t on t.id = i.target
where i.id <> i.target and not exists (select 1 from edges e where e.source = i.id and e.target = i.target)""")
def metadata_edges(b):
    return en.metadata_edges(b.people, b.edges).select(
        "source", "target", F.col("source_claims")[0].alias("url"))


@query("candidate_drafts", """
select id, coalesce(birth, 0) as birth,
  case when birth is null then null when birth < 1600 then 'Renaissance' when birth < 1700 then 'Scientific Revolution' when birth < 1800 then 'Enlightenment'
       when birth < 1900 then '19th Century' when birth < 1945 then 'Modernism' when birth < 1980 then 'Postwar' else 'Contemporary' end as era,
  case when len(fields) > 0 then array_to_string(fields, '|') when ord % 3 = 0 then 'Mathematics' when ord % 3 = 1 then 'Physics' else 'Philosophy' end as fields,
  coalesce(movement, 'Imported') as movement
from candidates""")
def candidate_drafts(b):
    return en.drafts(b.candidates).select("id", "birth", "era",
                                          F.array_join("fields", "|").alias("fields"), "movement")


@query("unique_import_ids", """with slugs as (
  select *, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') as slug from candidates)
select id, case when row_number() over (partition by slug order by ord) > 1 then slug || '_' || id else slug end as person_id from slugs""")
def unique_import_ids(b):
    return en.unique_ids(b.candidates, b.people_core).select("id", "person_id")


#: (place, field, topic, letters and digits of the topic) of the controlled vocabulary.
TOPIC_KEYS = ", ".join(
    f"({i}, '{topic}', '{''.join(c for c in topic.lower() if c.isascii() and c.isalnum())}')"
    for i, topic in enumerate(dict.fromkeys(
        t for groups in vocab.TOPIC_GROUPS.values() for topics in groups.values() for t in topics)))


@query("auto_topics", f"""with known(place, topic, key) as (values {TOPIC_KEYS}),
texts as (select id, topics, regexp_replace(lower(concat_ws(' ', description, 'a theory of justice, formal-logic')), '[^a-z0-9]', '', 'g') as source from candidates),
hits as (select t.id, list(k.topic order by k.place) as found from texts t join known k on contains(t.source, k.key) and not list_contains(t.topics, k.topic) group by 1)
select t.id, array_to_string(list_concat(t.topics, coalesce(h.found, [])), '|') as topics from texts t left join hits h on h.id = t.id""")
def auto_topics(b):
    text = F.concat_ws(" ", "description", F.lit("a theory of justice, formal-logic"))
    topics = tax.auto_topics(F.array().cast("array<string>"), text, listed("topics"))
    return b.candidates.select("id", F.array_join(topics, "|").alias("topics"))


@query("import_notes_stripped", """
select id, case when pid % 17 = 0 then null else notes end as notes from people""")
def import_notes_stripped(b):
    return b.people_core.select("id", tx.strip_import_notes(F.col("notes")).alias("notes"))


@query("text_keys", """
select doc_id, trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')) as text_key from documents""")
def text_keys(b):
    return b.table("documents").select("doc_id", tx.text_key(F.col("text")).alias("text_key"))


@query("evidence_tokens", """
select doc_id, count(distinct t) as tokens from (
  select doc_id, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9 \\t\\n\\r]', ' ', 'g'), '[ \\t\\n\\r]+')) as t from documents)
where length(t) > 4 and t not in ('philosopher','mathematician','scientist','writer','known','notable','theory','school') group by doc_id""")
def evidence_tokens(b):
    return (b.table("documents").select(
        "doc_id", F.size(tx.evidence_tokens(F.col("text"))).cast("long").alias("tokens"))
        .filter("tokens > 0"))
