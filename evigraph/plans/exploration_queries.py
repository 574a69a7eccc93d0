"""Exploration and suggestion queries over the bound tables."""

from pyspark.sql import functions as F

from evigraph.functions import taxonomy as tax
from evigraph.functions import text as tx
from evigraph.functions import vocab
from evigraph.operators import exploration as ex
from evigraph.operators import graph_quality as gq
from evigraph.operators import suggestions as sg
from evigraph.plans.catalog import query
from evigraph.plans.quality_queries import REVIEW

LENS_WORDS = {o: words for lens in vocab.LENSES.values() for o, (_, words) in lens.items()}


def lens_list(text: str) -> str:
    cases = ", ".join(f"case when regexp_matches({text}, '{'|'.join(w)}') then '{o}' end"
                      for o, w in LENS_WORDS.items())
    return f"list_filter([{cases}], lambda x: x is not null)"


def _domain(field: str) -> str:
    cases = " ".join(f"when {field} in ({', '.join(repr(f) for f in fields)}) then '{d}'"
                     for d, fields in vocab.FIELD_DOMAINS.items())
    return f"case {cases} else 'Other Domains' end"


FACTS = f"""
work_text as (select id, string_agg(title, ' ' order by title) as works, list(title order by title) as titles from person_works group by id),
facts as (
  select p.*, coalesce(w.works, '') as works, coalesce(w.titles, []) as titles,
    lower(concat_ws(' ', field1, field2, subfield, nullif(w.works, ''), notes, movement)) as lens_text,
    lower(concat_ws(' ', name, era, movement, region, field1, field2, subfield, nullif(w.works, ''), notes)) as search_text
  from people p left join work_text w on w.id = p.id),
lensed as (select *, {lens_list('lens_text')} as lens from facts)"""

HUB = "(select id from degrees where id in (select id from people) order by degree desc, length(id), id limit 1)"


def hub(b):
    """The best-connected person, as the selected one."""
    known = gq.degree(b.edges).join(b.people_core.select("id"), "id", "left_semi")
    return known.orderBy(F.desc("degree"), F.length("id"), "id").limit(1).select("id")


@query("lens_tags", f"with {FACTS} select id, array_to_string(lens, '|') as lens from lensed")
def lens_tags(b):
    return b.people.select("id", F.array_join(tax.person_lens_tags(), "|").alias("lens"))


@query("faceted_search", f"""with {FACTS}
select id, bridge_score + 3 + case when era in ('Enlightenment', '19th Century') then 2 else 0 end as relevance from lensed
where birth <= 1880 and coalesce(death, 2026) >= 1650 and (field1 in ('Physics', 'Mathematics') or field2 in ('Physics', 'Mathematics'))
  and era in ('Enlightenment', '19th Century') and region in ('ASIA', 'EUROPE', 'AMERICA') and list_contains(lens, 'proof')""")
def faceted_search(b):
    chosen = ex.Explore(min_year=1650, max_year=1880, fields=["Physics", "Mathematics"],
                        eras=["Enlightenment", "19th Century"], lens_tags=["proof"],
                        regions=["ASIA", "EUROPE", "AMERICA"], sort="relevance")
    return chosen.run(b.people).select("id", "relevance")


@query("ranked_search", f"""with {FACTS},
scored as (select *, lower(name) as n, lower(concat_ws(' ', field1, field2)) as f, lower(coalesce(subfield, '')) as t, lower(works) as w,
   lower(coalesce(movement, '')) as m, lower(coalesce(notes, '')) as o, 'formal proof' as q from facts)
select id, bridge_score + 1 + case when n = q then 90 when starts_with(n, q) then 65 when contains(n, q) then 45 else 0 end
  + case when contains(n, 'formal') and contains(n, 'proof') then 20 else 0 end + case when contains(f, q) then 18 else 0 end + case when contains(t, q) then 16 else 0 end
  + case when contains(w, q) then 14 else 0 end + case when contains(m, q) then 12 else 0 end + case when contains(lower(region), q) or contains(lower(era), q) then 8 else 0 end
  + case when contains(o, q) then 5 else 0 end as relevance
from scored where contains(search_text, 'formal') and contains(search_text, 'proof')""")
def ranked_search(b):
    return ex.Explore(query="Formal Proof", sort="relevance").run(b.people).select(
        "id", "relevance")


@query("name_search", f"""with {FACTS}
select id, bridge_score + 1 + case when lower(name) = 'red widget' then 90 when starts_with(lower(name), 'red widget') then 65 when contains(lower(name), 'red widget') then 45 else 0 end
  + case when contains(lower(name), 'red') and contains(lower(name), 'widget') then 20 else 0 end as relevance
from facts where contains(search_text, 'red') and contains(search_text, 'widget')""")
def name_search(b):
    return ex.Explore(query="red widget", sort="name").run(b.people).select("id", "relevance")


@query("connected_search", f"""
select id from people where id = {HUB} or id in (select case when source = {HUB} then target else source end from edges where source = {HUB} or target = {HUB})""")
def connected_search(b):
    # The selected person is found by a query, so the filter stays a join.
    chosen = hub(b)
    ends = b.edges.select("source", "target")
    near = ends.join(chosen.withColumnRenamed("id", "source"), "source").select(
        F.col("target").alias("id")).union(
        ends.join(chosen.withColumnRenamed("id", "target"), "target").select("source"))
    return ex.Explore().run(b.people_core, collection=near.union(chosen)).select("id")


@query("review_gaps", f"with {REVIEW} select id from statuses where degree <= 1 or subfield is null")
def review_gaps(b):
    return ex.preset("review").run(b.people_core, b.edges).select("id")


@query("cohorts", f"""with {FACTS}
select * from (
  select 'ancient-foundations' as cohort, id from facts where era = 'Ancient'
  union all select 'scientific-revolution', id from facts where movement = 'Scientific Revolution' or contains(search_text, 'scientific revolution')
  union all select 'enlightenment-political-thought', id from facts where era = 'Enlightenment' and (field1 = 'Philosophy' or field2 = 'Philosophy')
  union all select 'german-idealism', id from facts where contains(search_text, 'idealism')
  union all select 'evolution-and-biology', id from facts where field1 = 'Biology' and regexp_matches(search_text, 'evolution|darwin|genetic|selection|taxonomy|anatomy|naturalist')
  union all select 'logic-to-computation', id from facts where regexp_matches(search_text, 'comput|lambda|formal system|algorithm|turing|program')
  union all select 'quantum-physics', id from facts where regexp_matches(search_text, 'quantum|relativity|qed|uncertainty|atomic|field symmetries')
  union all select 'ai-lineage', id from facts where regexp_matches(search_text, 'artificial intelligence|\\bai\\b|symbolic ai|lisp|transformer|machine learning|neural|cognitive')
  union all select 'critical-theory-postmodernism', id from facts where regexp_matches(search_text, 'critical|postmodern|structural|power-knowledge|gender|genealogical|ideology|alienation'))""")
def cohorts(b):
    return ex.cohorts(b.people)


@query("edge_review_filter", """
select id from edge_flags where type = 'Influence' and coalesce(conf100, 100) >= 40 and (status = 'needs_source' or not has_evidence)""")
def edge_review_filter(b):
    return ex.edge_filter(b.edges, "Influence", 0.4, "needs_source").select("id")


@query("edge_visual_flags", """
select id, coalesce(status = 'suggested', false) as suggested, coalesce(status = 'needs_source', false) or not has_evidence as needs_source,
  coalesce(conf100, 100) < 50 as low_confidence from edge_flags""")
def edge_visual_flags(b):
    return ex.edge_flags(b.edges)


@query("person_lookup", "select min_by(id, pid) as id from people where contains(lower(name), 'hot gear')")
def person_lookup(b):
    return ex.lookup(b.people_core, "Hot Gear")


@query("timeline_matches", f"""with {FACTS} select id from facts
where contains(lower(name), 'brand#1') or contains(lower(works), 'brand#1') or contains(lower(coalesce(subfield, '')), 'brand#1')""")
def timeline_matches(b):
    return ex.timeline_matches(b.people, "Brand#1").select("id")


@query("facet_values", """
select facet, value from (select facet, value, row_number() over (partition by facet order by value) as rn from (
  select distinct 'topic' as facet, subfield as value from people where subfield is not null
  union all select distinct 'era', era from people union all select distinct 'region', region from people)) where rn <= 24""")
def facet_values(b):
    return ex.facet_values(b.people_core)


@query("fit_range", """
select cast(greatest(-650, lo - m) as int) as min_year, cast(least(2030, hi + m) as int) as max_year from (
  select lo, hi, greatest(15, cast(floor((hi - lo) * 0.2 + 0.5) as int)) as m from (
    select min(birth) as lo, max(coalesce(death, 2026)) as hi from people where era = '19th Century' and birth <= 2030))""")
def fit_range(b):
    return ex.fit_range(ex.Explore(eras=["19th Century"]).run(b.people_core))


@query("group_index", f"""
select kind, title, count(*) as people from (
  select 'domain' as kind, {_domain('field1')} as title from people union all select 'era', era from people
  union all select 'movement', coalesce(movement, 'Unclassified movement') from people union all select 'field', field1 from people) group by 1, 2""")
def group_index(b):
    parts = [ex.group_sizes(b.people_core, key).withColumn("kind", F.lit(kind))
             for kind, key in ex.group_keys().items()]
    return gq.union_all(parts).select("kind", "title", "people")


@query("review_groups", f"with {REVIEW} select review_status as title, count(*) as people from statuses group by 1")
def review_groups(b):
    facts = gq.review_facts(b.people_core, b.edges)
    return ex.group_sizes(facts, F.col("review_status"))


@query("cluster_keys", f"""
select id, {_domain('field1')} as domain, coalesce(subfield, {_domain('field1')}) as concept from people""")
def cluster_keys(b):
    return b.people_core.select("id", ex.group_keys()["domain"].alias("domain"),
                                ex.concept_key().alias("concept"))


@query("cluster_fields", """
select cluster, field, people from (
  select movement as cluster, field1 as field, count(*) as people, row_number() over (partition by movement order by count(*) desc, min(pid)) as rn
  from (select coalesce(movement, 'Unclassified movement') as movement, field1, pid from people) group by 1, 2) where rn <= 5""")
def cluster_fields(b):
    return ex.cluster_fields(b.people_core, ex.group_keys()["movement"])


@query("facet_counts", """
select 'field' as facet, field as value, count(*) as people from person_fields group by 2
union all select 'topic', subfield, count(*) from people where subfield is not null group by 2
union all select 'era', era, count(*) from people group by 2 union all select 'region', region, count(*) from people group by 2
union all select 'movement', movement, count(*) from people where movement is not null group by 2""")
def facet_counts(b):
    return ex.facet_counts(b.people_core)


@query("movement_bands", """
select movement, min(birth) as start, max(coalesce(death, birth)) as end, count(*) as people from people
where movement is not null and movement <> 'Imported' group by 1 having count(*) >= 3 order by count(*) desc, min(pid) limit 8""")
def movement_bands(b):
    return ex.movement_bands(b.people_core)


def _institutions(b):
    """Institutions with the people of their evidence links as figures."""
    figures = b.evidence_links.filter("kind = 'institution'").groupBy("value").agg(
        F.array_sort(F.collect_set("person_id")).alias("figures"))
    return figures.select(
        F.col("value").alias("name"), F.lit("City").alias("city"), "figures",
        F.regexp_extract("value", r"(\d+)$", 1).cast("long").alias("ord"))


@query("person_institutions", """
select p.id, coalesce(i.name, 'Unaffiliated') as institution from people p left join (
  select person_id, min_by(value, cast(regexp_extract(value, '(\\d+)$', 1) as bigint)) as name from evidence_links where kind = 'institution' group by 1) i on i.person_id = p.id""")
def person_institutions(b):
    return ex.person_institutions(b.people_core, _institutions(b)).select("id", "institution")


@query("institution_bands", """
select value as name, count(*) as people from evidence_links where kind = 'institution' and person_id in (select id from people)
group by 1 order by 2 desc, cast(regexp_extract(value, '(\\d+)$', 1) as bigint) limit 6""")
def institution_bands(b):
    return ex.institution_bands(b.people_core, _institutions(b)).select("name", "people")


@query("discipline_groups", f"select distinct {_domain('field')} as domain, field from person_fields")
def discipline_groups(b):
    return ex.discipline_groups(b.people_core)


TOPICS = ", ".join(f"('{f}', '{g}', '{t}')" for f, groups in vocab.TOPIC_GROUPS.items()
                   for g, topics in groups.items() for t in topics)


@query("topics_by_field", f"""with known(field, topic_group, topic) as (values {TOPICS}),
seen as (select distinct f.field, p.subfield as topic from people p join person_fields f on f.id = p.id where p.subfield is not null),
here as (select * from known where field in (select field from person_fields))
select coalesce(s.field, h.field) as field, coalesce(s.topic, h.topic) as topic, coalesce(h.topic_group, 'Local Additions') as topic_group
from seen s full join here h on h.field = s.field and h.topic = s.topic""")
def topics_by_field(b):
    return ex.topics_by_field(b.people_core)


@query("topic_suggestions", f"""with {FACTS}, known(field, topic_group, topic) as (values {TOPICS})
select l.id, least(14, (select count(*) from known k where k.field in (l.field1, l.field2)) + len(l.lens)) as n from lensed l""")
def topic_suggestions(b):
    picked = tax.topic_suggestions(F.col("fields"), tax.person_lens_tags(), 14)
    return b.people.select("id", F.size(picked).cast("long").alias("n"))


@query("edge_types", "select distinct type from edges")
def edge_types(b):
    return b.edges.select("type").distinct()


@query("high_bridge", "select id, bridge_score from people where bridge_score >= 4 order by bridge_score desc, birth, pid limit 12")
def high_bridge(b):
    return ex.high_bridge(b.people_core).select("id", "bridge_score")


@query("recently_reviewed", """with audit as (
  select event_id as ord, cast(user_id as varchar) as candidate_id, case when event_id % 2 = 0 then 'unknown' else 'RED WIDGET ' || cast(event_id % 400 as varchar) end as candidate_name from events),
hits as (select a.ord, p.pid from audit a join people p on p.id = a.candidate_id union all select a.ord, p.pid from audit a join people p on lower(p.name) = lower(a.candidate_name)),
firsts as (select ord, min(pid) as pid from hits group by 1)
select cast(pid as varchar) as person_id, min(ord) as position from firsts group by 1 order by 2 limit 12""")
def recently_reviewed(b):
    n = F.col("event_id")
    audit = b.table("events").select(
        n.alias("ord"), F.col("user_id").cast("string").alias("candidate_id"),
        F.when(n % 2 == 0, "unknown").otherwise(F.concat(
            F.lit("RED WIDGET "), (n % 400).cast("string"))).alias("candidate_name"))
    return ex.recently_reviewed(audit, b.people_core)


@query("person_edge_counts", """
select p.id, count(e.eid) as edges, count(e.eid) filter (where e.has_evidence) as sourced_edges from people p left join (
  select source as id, eid, has_evidence from edge_flags union select target, eid, has_evidence from edge_flags) e on e.id = p.id group by 1""")
def person_edge_counts(b):
    return ex.edge_counts(b.people_core, b.edges)


@query("lifespans", """
select id, death - birth as years, case when death is null then 'present' when death < 0 then cast(-death as varchar) || ' BCE' else cast(death as varchar) end as until from people""")
def lifespans(b):
    return b.people_core.select("id", (F.col("death") - F.col("birth")).alias("years"),
                                tx.year_label(F.col("death")).alias("until"))


@query("link_suggestions", f"""with {FACTS},
focus as (select * from lensed where id = {HUB}),
pairs as (
  select f.id as focus_id, p.id as person_id, p.pid,
    600 * (cast(p.field1 in (f.field1, f.field2) as int) + cast(p.field2 in (f.field1, f.field2) as int)) + 450 * coalesce(cast(p.subfield = f.subfield as int), 0)
    + 300 * len(list_intersect(p.lens, f.lens)) + case when p.era = f.era then 300 else 0 end
    - least(600, least(abs(p.birth - coalesce(f.death, f.birth)), abs(f.birth - coalesce(p.death, p.birth)))) as points
  from focus f join lensed p on p.id <> f.id
  where not exists (select 1 from edges e where (e.source = f.id and e.target = p.id) or (e.target = f.id and e.source = p.id))),
ranked as (select *, row_number() over (partition by focus_id order by points desc, pid) as position from pairs where points > 150)
select focus_id, person_id, cast(position as int) as position, points / 150.0::double as score, points >= 600 as high_confidence from ranked where position <= 8""")
def link_suggestions(b):
    return sg.link_suggestions(b.people, hub(b), b.edges)


STOP = ", ".join(f"'{w}'" for w in vocab.EVIDENCE_STOPWORDS)


def _tokens(text: str) -> str:
    return (f"list_distinct(list_filter(string_split(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'), ' '), "
            f"lambda t: length(t) > 4 and t not in ({STOP})))")


@query("candidate_suggestions", f"""with {FACTS}, known(field, topic_group, topic) as (values {TOPICS}),
topic_keys as (select distinct topic, regexp_replace(lower(topic), '[^a-z0-9]', '', 'g') as k from known),
c0 as (select *, case when len(fields) > 0 then fields when ord % 3 = 0 then ['Mathematics'] when ord % 3 = 1 then ['Physics'] else ['Philosophy'] end as df from candidates),
c1 as (select *, trim(regexp_replace(lower(concat_ws(' ', description, movement, array_to_string(works, ' '), array_to_string(df, ' '))), '[^a-z0-9]', '', 'g')) as src from c0),
hit_topics as (
  select c.id, t.topic, case when exists (select 1 from known k where k.topic = t.topic and list_contains(c.df, k.field)) then 0 else 1 end as own from c1 c join topic_keys t
   on contains(c.src, t.k)),
topic_lists as (select id, list(topic) as hits, count(*) as n from hit_topics group by 1),
cands as (
  select c.*, list_distinct(list_concat(topics, coalesce(hits, []))) as dt, coalesce(movement, 'Imported') as dm,
     case when birth is null then null else birth end as b from c1 c left join topic_lists t on t.id = c.id),
cl as (
  select *, {lens_list("lower(concat_ws(' ', array_to_string(df, ' '), nullif(array_to_string(dt, ' '), ''), array_to_string(works, ' '), description, dm))")} as lens,
     {_tokens("concat_ws(' ', description, movement, array_to_string(works, ' '), nullif(array_to_string(topics, ' '), ''))")} as toks from cands),
pl as (select *, {_tokens("concat_ws(' ', notes, movement, nullif(works, ''), subfield)")} as toks from lensed),
pairs as (
  select c.id as candidate_id, p.id as person_id, p.pid,
    case when c.birth is null then 300 else least(abs(p.birth - coalesce(c.death, c.birth)), abs(c.birth - coalesce(p.death, p.birth))) end as gap, c.birth is not null as known,
    8 * (cast(list_contains(c.df, p.field1) as int) + cast(list_contains(c.df, p.field2) as int)) + 6 * coalesce(cast(list_contains(c.dt, p.subfield) as int), 0)
    + 4 * len(list_intersect(c.lens, p.lens)) + case when c.movement = p.movement then 8 else 0 end + 10 * len(list_intersect(c.works, p.titles))
    + 3 * least(3, len(list_intersect(c.toks, p.toks))) as base
  from cl c cross join pl p),
scored as (select *, (base + 2 * case when not known then 0 when gap <= 60 then 3 when gap <= 150 then 2 when gap <= 300 then 1 else -2 end) / 2.0::double as score from pairs),
ranked as (select *, row_number() over (partition by candidate_id order by score desc, pid) as position from scored where score >= 4)
select candidate_id, person_id, score, case when score >= 12 then 'strong' when score >= 7 then 'medium' else 'weak' end as confidence, cast(position as int) as position
from ranked where position <= 5""")
def candidate_suggestions(b):
    return sg.candidate_suggestions(b.candidates, b.people).select(
        "candidate_id", "person_id", "score", "confidence", "position")


@query("candidate_matches", f"""with {FACTS}, refused as (select 'q' || cast(a.ord as varchar) as candidate_id, cast(p.pid as varchar) as person_id from candidates a join people p on p.pid // 400 = a.ord // 10 where a.ord % 10 = 0),
known(field, topic_group, topic) as (values {TOPICS}),
topic_keys as (select distinct topic, regexp_replace(lower(topic), '[^a-z0-9]', '', 'g') as k from known),
c0 as (select *, case when len(fields) > 0 then fields when ord % 3 = 0 then ['Mathematics'] when ord % 3 = 1 then ['Physics'] else ['Philosophy'] end as df from rich_candidates),
c1 as (select *, trim(regexp_replace(lower(concat_ws(' ', description, movement, array_to_string(works, ' '), array_to_string(df, ' '))), '[^a-z0-9]', '', 'g')) as src from c0),
hit_topics as (
  select c.id, t.topic, case when exists (select 1 from known k where k.topic = t.topic and list_contains(c.df, k.field)) then 0 else 1 end as own from c1 c join topic_keys t
   on contains(c.src, t.k)),
topic_lists as (select id, list(topic) as hits, count(*) as n from hit_topics group by 1),
cands as (
  select c.*, list_distinct(list_concat(topics, coalesce(hits, []))) as dt, coalesce(movement, 'Imported') as dm,
     case when birth is null then null else birth end as b from c1 c left join topic_lists t on t.id = c.id),
cl as (
  select *, {lens_list("lower(concat_ws(' ', array_to_string(df, ' '), nullif(array_to_string(dt, ' '), ''), array_to_string(works, ' '), description, dm))")} as lens,
     {_tokens("concat_ws(' ', description, movement, array_to_string(works, ' '), nullif(array_to_string(topics, ' '), ''), nullif(array_to_string(list_concat(influenced_by, advisors, students, employers, educated_at, member_of), ' '), ''))")} as toks from cands),
pl as (select *, {_tokens("concat_ws(' ', notes, movement, nullif(works, ''), subfield)")} as toks from lensed),
pairs as (
  select c.id as candidate_id, p.id as person_id, p.pid,
    case when c.birth is null then 300 else least(abs(p.birth - coalesce(c.death, c.birth)), abs(c.birth - coalesce(p.death, p.birth))) end as gap, c.birth is not null as known,
    8 * (cast(list_contains(c.df, p.field1) as int) + cast(list_contains(c.df, p.field2) as int)) + 6 * coalesce(cast(list_contains(c.dt, p.subfield) as int), 0)
    + 4 * len(list_intersect(c.lens, p.lens)) + case when c.movement = p.movement then 8 else 0 end + 10 * len(list_intersect(c.works, p.titles))
    + case when c.era = p.era then 4 else 0 end + case when c.region = p.region then 3 else 0 end
    + 16 * (cast(list_contains(c.influenced_by, p.name) as int) + cast(list_contains(c.advisors, p.name) as int) + cast(list_contains(c.students, p.name) as int)
            + cast(list_contains(c.employers, p.name) as int) + cast(list_contains(c.educated_at, p.name) as int) + cast(list_contains(c.member_of, p.name) as int))
    + 3 * least(3, len(list_intersect(c.toks, p.toks))) as base,
    list_contains(c.advisors, p.name) or list_contains(c.students, p.name) as taught, list_contains(c.influenced_by, p.name) as influenced,
    list_contains(c.employers, p.name) or list_contains(c.educated_at, p.name) or list_contains(c.member_of, p.name) as joined_in,
    len(list_intersect(c.works, p.titles)) > 0 as worked,
    list_contains(c.df, p.field1) or list_contains(c.df, p.field2) or coalesce(list_contains(c.dt, p.subfield), false) or len(list_intersect(c.lens, p.lens)) > 0 as alike
  from cl c cross join pl p
  where not exists (select 1 from refused r where r.candidate_id = c.id and r.person_id = p.id)),
scored as (select *, (base + 2 * case when not known then 0 when gap <= 60 then 3 when gap <= 150 then 2 when gap <= 300 then 1 else -2 end) / 2.0::double as score from pairs),
ranked as (select *, row_number() over (partition by candidate_id order by score desc, pid) as position from scored where score >= 4)
select candidate_id, person_id, score, cast(gap as int) as gap, case when taught then 'direct mentorship' when influenced then 'likely influence'
  when worked or joined_in then 'collaboration' when score < 7 then 'needs review' when gap <= 40 and alike then 'parallel development' else 'source-context neighbor' end as category,
  case when taught or influenced or joined_in then 'direct Wikidata claim' when score >= 12 then 'multiple matching signals' when score >= 7 then 'shared context signals' else 'thin evidence' end as explanation,
  case when score >= 12 then 'strong' when score >= 7 then 'medium' else 'weak' end as confidence, cast(position as int) as position
from ranked where position <= 5""")
def candidate_matches(b):
    """Suggestions from every signal, without a candidate's rejected people."""
    return matched_candidates(b, 5).select(
        "candidate_id", "person_id", "score", "confidence", "position", "gap", "category",
        "explanation")


def matched_candidates(b, limit, chosen=None):
    """The best ``limit`` people of all candidates, or of the ``chosen(candidate_id)``."""
    asked = b.rich_candidates
    if chosen is not None:
        asked = asked.join(chosen.select(F.col("candidate_id").alias("id")), "id", "left_semi")
    tens = b.candidates.filter("ord % 10 = 0").select(
        F.col("id").alias("candidate_id"), F.expr("ord div 10").alias("page"))
    refused = tens.join(b.people_core.select(
        F.col("id").alias("person_id"), F.expr("ord div 400").alias("page")), "page").drop("page")
    return sg.candidate_suggestions(asked, b.people, refused, limit=limit)


@query("suggested_edges", """with pairs as (select distinct person_id as a, value as b from evidence_links where kind = 'coauthor' and person_id <> value)
select case when p.birth <= q.birth then p.id else q.id end as source, case when p.birth <= q.birth then q.id else p.id end as target, 'shared authorship' as note
from pairs join people p on p.id = a join people q on q.id = b
where not exists (select 1 from edges e where (e.source = a and e.target = b) or (e.source = b and e.target = a))""")
def suggested_edges(b):
    pairs = b.evidence_links.filter("kind = 'coauthor' and person_id <> value").select(
        F.col("person_id").alias("a_id"), F.col("value").alias("b_id"),
        F.lit("shared authorship").alias("reason"))
    return sg.suggested_edges(pairs, b.people_core, b.edges).select("source", "target", "note")


@query("registry_edges", """with props as (
  select 'Q' || person_id as rid, ord, case kind when 'advisor' then 'P184' when 'student' then 'P185' when 'named_mention' then 'P802' when 'explicit_influence' then 'P737' end as prop,
    case kind when 'advisor' then 0 when 'student' then 1 when 'named_mention' then 2 else 3 end as rank, value as other, person_id from evidence_links
  where kind in ('advisor', 'student', 'named_mention', 'explicit_influence')),
rows_ as (select case when prop in ('P184', 'P737') then other else person_id end as source, case when prop in ('P184', 'P737') then person_id else other end as target,
    case when prop = 'P737' then 'Influence' else 'Mentorship' end as type, prop, ord, rank, person_id from props),
firsts as (select source, target, type, min_by(prop, row(ord, rank)) as property, min_by(person_id, row(ord, rank)) as ev from rows_
  where source <> target and source in (select id from people) and target in (select id from people) group by 1, 2, 3)
select source, target, type, property, 'Q' || ev || ' ' || property || ' Q' || case when property in ('P184', 'P737') then source else target end as evidence_claim from firsts""")
def registry_edges(b):
    # Which evidence kind stands for which property.
    kinds = {"advisor": "P184", "student": "P185", "named_mention": "P802",
             "explicit_influence": "P737"}
    table = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    statements = b.evidence_links.filter(F.col("kind").isin(list(kinds))).select(
        F.concat(F.lit("Q"), "person_id").alias("registry_id"), "ord",
        table[F.col("kind")].alias("property"), F.lit(0).alias("pos"),
        F.concat(F.lit("Q"), "value").alias("related_id"))
    ids = b.people_core.select(F.concat(F.lit("Q"), "id").alias("registry_id"),
                               F.col("id").alias("person_id"))
    return sg.registry_edges(statements, ids).filter(sg.is_supported_statement()).select(
        "source", "target", "type", "property", "evidence_claim")


@query("decision_feed", """with queue as (select 0 as lane, ord, name as label, case when ord % 3 = 0 then 'conflicting' when birth is null then 'rejected' when ord % 100 < 70 then 'held' else 'accepted' end as status from candidates order by ord limit 4),
links as (select 1 as lane, pid as ord, name as label, case when bridge_score >= 4 then 'accepted' else 'held' end as status from people order by pid limit 4),
audit as (select 2 as lane, event_id as ord, event_type as label, case event_id % 4 when 0 then 'accepted' when 1 then 'conflicting' when 2 then 'rejected' else 'held' end as status from events order by event_id limit 4)
select lane, label, status from (select * from queue union all select * from links union all select * from audit) order by lane, ord limit 8""")
def decision_feed(b):
    n = F.col("ord")
    queue = b.candidates.select(
        "id", "ord", F.col("name").alias("label"), "birth", (n % 100).alias("confidence"),
        F.when(n % 3 == 0, "dup").alias("duplicate_id"), F.lit(70).alias("threshold"))
    links = b.people_core.select("id", "ord", F.col("name").alias("label"),
                                 F.col("bridge_score").alias("score"))
    e = F.col("event_id")
    audit = b.table("events").select(
        e.cast("string").alias("id"), e.alias("ord"), F.col("event_type").alias("label"),
        F.when(e % 4 == 0, "accepted").when(e % 4 == 1, "duplicate").when(e % 4 == 2, "skipped")
        .otherwise("edited").alias("status"), F.lit("r").alias("reason"))
    return sg.decision_feed(queue, links, audit).select("lane", "label", "status")


@query("automation_counters", f"""with {REVIEW}
select 'held' as counter, count(*) as value from edge_flags where coalesce(status = 'needs_source', false) or coalesce(conf100, 100) < 50 or not has_evidence
union all select 'conflicts', (select count(*) from people where death < birth) + (select count(*) from edges where source not in (select id from people) or target not in (select id from people))
  + (select cast(coalesce(sum(n), 0) as bigint) from (select count(*) as n from people group by trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) having count(*) > 1))""")
def automation_counters(b):
    gaps = b.edges.filter(gq.is_source_gap()).agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("held").alias("counter"), "value")
    codes = ["duplicate-entity-risk", "dangling-reference", "impossible-dates"]
    found = gq.audit(b.people, b.edges, b.claims, b.now).filter(F.col("code").isin(codes))
    return gaps.unionByName(found.agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("conflicts").alias("counter"), "value"))


@query("lane_heights", f"""with spans as (select {_domain('field1')} as lane, birth - 20 as s, coalesce(death, 2024) + 20 as e from people),
starts as (select distinct lane, s as t from spans),
heights as (select lane, max(n) as rows from (select k.lane, k.t, count(*) as n from starts k join spans x on x.lane = k.lane and x.s <= k.t and k.t < x.e group by 1, 2) group by 1)
select lane, rows, (select coalesce(sum(o.rows + 1), 0)::bigint from heights o where o.lane < h.lane) as first_row from heights h""")
def lane_heights(b):
    return ex.lane_heights(b.people_core, ex.group_keys()["domain"])


@query("context_index", f"""with {REVIEW},
matches as (select * from people where era = '19th Century'),
hub as {HUB},
near as (select distinct case when source = (select id from hub) then target else source end as id from edges where source = (select id from hub) or target = (select id from hub)),
near_known as (select id from near where id in (select id from people) and id <> (select id from hub)),
likely as (select id from people where bridge_score = 5 and birth between 1850 and 1855),
others as (select * from matches where id <> (select id from hub)),
added as (select id from others order by pid desc limit 12),
orphans as (select p.id from people p where p.id not in (select id from ends) order by pid limit 20),
bridges as (select id from others where bridge_score >= 4 order by bridge_score desc, birth, pid limit 12),
gaps as (select id from statuses where gap_edges > 0 order by pid limit 12),
current as (select id from others where id not in (select id from near_known) and id not in (select id from likely) order by birth, pid limit 30)
select 'Selected' as lane, id from hub union all select 'Connected', id from near_known union all select 'Likely Links', id from likely
union all select 'Recently Added', id from added union all select 'Recently Reviewed', id from matches where pid % 9 = 0
union all select 'Orphans', id from orphans union all select 'High Bridge Score', id from bridges union all select 'Needs Source', id from gaps union all select 'Current Matches', id from current""")
def context_index(b):
    people = b.people_core
    matches = ex.Explore(eras=["19th Century"]).run(people)
    likely = people.filter("bridge_score = 5 and birth between 1850 and 1855").select("id")
    return ex.context_index(people, b.edges, matches, hub(b), likely,
                            people.filter("ord % 9 = 0").select("id"))
