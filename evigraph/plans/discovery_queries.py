"""Relationship candidates and missing-edge discovery over the bound tables."""

from pyspark.sql import functions as F

from evigraph.operators import edge_validation as ev
from evigraph.operators import missing_edges as me
from evigraph.operators import pair_counts as pc
from evigraph.operators import relationship_candidates as rc
from evigraph.plans.catalog import query
from evigraph.plans.evidence_queries import _list
from evigraph.functions import vocab
from evigraph.session import cut_lineage

NON_DIRECTIONAL = _list(vocab.NON_DIRECTIONAL)

# Ordered fold over single encounters: first value stands, later ones add the step.
FOLD = "list_reduce(list(x order by o, r), lambda acc, v: least({cap}, greatest(acc, v) + {step}))"
FOLD95 = FOLD.format(cap=95, step=5)

GROUPED = """
members as (select distinct kind, value, person_id, ord from evidence_links),
group_sizes as (select kind, value, count(distinct person_id) as n from members group by 1, 2)"""

GROUP_ROWS = """
select 'group' as row_kind, kind as group_kind, value as group_value, null as source_id, null as target_id, null::double as confidence,
       null::bigint as evidence, n as members, n * (n - 1) // 2 as pairs from group_sizes where kind in {kinds}"""

#: The chosen people of the ``_for`` queries.
FOCUS = "focus as (select id from people where pid % 20 = 0)"


def _focus(b):
    return b.people_core.filter("ord % 20 = 0").select("id")


def _pairs(scored: str, score: str) -> str:
    return (f"select 'pair' as row_kind, null as group_kind, null as group_value, source_id, target_id, {score} / 100.0::double as confidence, evidence, "
            f"null::bigint as members, null::bigint as pairs from {scored}")


@query("mentorship", """
select source_id, target_id, max_by(evidence, row(o, r)) as evidence from (
  select 'person:' || value as source_id, 'person:' || person_id as target_id, 'advisor/student evidence' as evidence, ord as o, 0 as r
  from evidence_links where kind = 'advisor'
  union all select 'person:' || person_id, 'person:' || value, 'student/advisor evidence', ord, 1 from evidence_links where kind = 'student')
group by 1, 2""")
def mentorship(b):
    return rc.mentorship(b.evidence_links).select("source_id", "target_id", "evidence")


def _collaboration(pool: str) -> str:
    return f"""with {GROUPED}, {FOCUS},
encounters as (
  select person_id as p, value as q, ord as o, case kind when 'coauthor' then 0 else 1 end as r, case kind when 'coauthor' then 80 else 75 end as x
  from evidence_links where kind in ('coauthor', 'correspondent')
  union all select a.person_id, c.person_id, a.ord, case a.kind when 'institution' then 2 else 3 end, case a.kind when 'institution' then 55 else 85 end
  from members a join members c on a.kind = c.kind and a.value = c.value and a.person_id <> c.person_id where a.kind in ('institution', 'work')),
pool as ({pool}),
folded as (
  select least('person:' || p, 'person:' || q) as source_id, greatest('person:' || p, 'person:' || q) as target_id, {FOLD95} as score, count(*) as evidence
  from encounters e where exists (select 1 from pool where a = least(p, q) and b = greatest(p, q)) group by 1, 2)
"""


TOUCHING = "select distinct least(p, q) as a, greatest(p, q) as b from {0} where p in (select id from focus) or q in (select id from focus)"


@query("collaboration", _collaboration(
    "select distinct least(p, q) as a, greatest(p, q) as b from encounters where r < 2") + _pairs("folded", "score")
    + " union all " + GROUP_ROWS.format(kinds="('institution', 'work')"))
def collaboration(b):
    return rc.collaboration(b.evidence_links)


@query("collaboration_for", _collaboration(TOUCHING.format("encounters")) + _pairs("folded", "score"))
def collaboration_for(b):
    return rc.collaboration(b.evidence_links, _focus(b))


def _influence_links(b):
    movements = b.people_core.filter("movement is not null").select(
        F.col("id").alias("person_id"), "ord", F.lit("movement").alias("kind"),
        F.col("movement").alias("value"), F.lit(None).cast("string").alias("section"))
    return b.evidence_links.unionByName(movements)


def _influence(pool: str) -> str:
    return f"""with {FOCUS},
members as (select 'movement' as kind, movement as value, id as person_id, pid as ord, birth from people where movement is not null),
group_sizes as (select kind, value, count(*) as n from members group by 1, 2),
told as (
  select l.value as p, l.person_id as q, l.ord as o,
         case kind when 'explicit_influence' then 0 when 'citation_target' then 1 when 'named_mention' then 2 when 'advisor' then 3 else 4 end as r,
         case kind when 'explicit_influence' then 85 when 'citation_target' then 65 when 'named_mention' then 55 else 70 end as x
  from evidence_links l left join people s on s.id = l.value left join people t on t.id = l.person_id
  where kind in ('explicit_influence', 'citation_target', 'named_mention', 'advisor', 'received_work') and l.value <> l.person_id
    and coalesce(s.birth <= t.birth + 20, true)),
met as (
  select case when c.birth <= a.birth then c.person_id else a.person_id end as p, case when c.birth <= a.birth then a.person_id else c.person_id end as q,
         a.ord as o, 5 as r, 50 as x
  from members a join members c on a.value = c.value and a.person_id <> c.person_id),
encounters as (select * from told union all select * from met),
pool as ({pool}),
folded as (
  select 'person:' || p as source_id, 'person:' || q as target_id, {FOLD95} as score, count(*) as evidence
  from encounters where exists (select 1 from pool where a = p and b = q) group by 1, 2)
"""


@query("influence", _influence("select distinct p as a, q as b from told") + _pairs("folded", "score")
       + " union all " + GROUP_ROWS.format(kinds="('movement')"))
def influence(b):
    return rc.influence(_influence_links(b), b.people_core)


@query("influence_for", _influence(
    "select distinct p as a, q as b from encounters where p in (select id from focus) or q in (select id from focus)")
    + _pairs("folded", "score"))
def influence_for(b):
    return rc.influence(_influence_links(b), b.people_core, _focus(b))


@query("parallel_development", f"with {GROUPED}" + GROUP_ROWS.format(kinds="('concept')"))
def parallel_development(b):
    return rc.parallel_development(b.evidence_links)


@query("parallel_development_for", f"""with {GROUPED}, {FOCUS},
shared as (
  select a.person_id as p, c.person_id as q, count(*) as evidence
  from members a join members c on a.value = c.value and a.person_id < c.person_id where a.kind = 'concept' and c.kind = 'concept'
    and (a.person_id in (select id from focus) or c.person_id in (select id from focus)) group by 1, 2),
linked as (select least(person_id, value) as p, greatest(person_id, value) as q from evidence_links where kind in ('explicit_influence', 'advisor', 'student')),
scored as (
  select least('person:' || p, 'person:' || q) as source_id, greatest('person:' || p, 'person:' || q) as target_id, least(95, 45 + 5 * (evidence - 1)) as score, evidence
  from shared where not exists (select 1 from linked l where l.p = shared.p and l.q = shared.q))
""" + _pairs("scored", "score"))
def parallel_development_for(b):
    return rc.parallel_development(b.evidence_links, _focus(b))


@query("source_neighbors", f"with {GROUPED}" + GROUP_ROWS.format(kinds="('source_context')"))
def source_neighbors(b):
    return rc.source_neighbors(b.evidence_links)


@query("source_neighbors_for", f"""with {FOCUS},
members as (select distinct value, person_id, ord, section from evidence_links where kind = 'source_context'),
hits as (
  select distinct a.person_id as p, c.person_id as q, a.value, a.section from members a join members c on a.value = c.value and a.ord < c.ord
  where (a.section is null or c.section is null or a.section = c.section)
    and (a.person_id in (select id from focus) or c.person_id in (select id from focus))),
scored as (
  select least('person:' || p, 'person:' || q) as source_id, greatest('person:' || p, 'person:' || q) as target_id, least(95, 35 + 5 * (count(*) - 1)) as score, count(*) as evidence
  from hits group by p, q)
""" + _pairs("scored", "score"))
def source_neighbors_for(b):
    return rc.source_neighbors(b.evidence_links, _focus(b))


@query("parallel_development_counts", """
with members as (select distinct value, person_id from evidence_links where kind = 'concept'),
told as (select person_id as p, value as q from evidence_links where kind in ('explicit_influence', 'advisor', 'student')),
pairs as (
  select a.value, exists (select 1 from told t where (t.p = a.person_id and t.q = c.person_id) or (t.p = c.person_id and t.q = a.person_id)) as linked
  from members a join members c on a.value = c.value and a.person_id < c.person_id)
select m.value as concept, m.members, coalesce(shared_pairs, 0) as shared_pairs, coalesce(linked_pairs, 0) as linked_pairs, coalesce(shared_pairs - linked_pairs, 0) as pairs
from (select value, count(*) as members from members group by 1) m
left join (select value, count(*) as shared_pairs, count(*) filter (where linked) as linked_pairs from pairs group by 1) p using (value)""")
def parallel_development_counts(b):
    """Exact numbers of parallel developments per concept, linked pairs left out."""
    return pc.concept_pairs(b.evidence_links)


@query("source_neighbor_counts", """
with members as (select distinct value, person_id, section from evidence_links where kind = 'source_context'),
pairs as (
  select distinct a.value, a.person_id as p, c.person_id as q from members a join members c on a.value = c.value and a.person_id < c.person_id
  where a.section is null or c.section is null or a.section = c.section)
select m.value as source, m.members, m.unplaced, coalesce(p.n, 0) as pairs
from (select value, count(distinct person_id) as members, count(distinct person_id) filter (where section is null) as unplaced from members group by 1) m
left join (select value, count(*) as n from pairs group by 1) p using (value)""")
def source_neighbor_counts(b):
    """Exact numbers of source neighbours per source, by the sections that they share."""
    return pc.source_pairs(b.evidence_links)


@query("direction_checks", """
select e.id, array_to_string(list_filter([
   case when e.source = e.target then 'self-link' end, case when s.birth > t.birth + 20 then 'chronology-direction' end,
   case when e.eid % 8 = 0 then 'wording-suggests-reverse-direction' end], lambda x: x is not null), '|') as warnings,
   coalesce(s.birth > t.birth + 20, false) or e.eid % 8 = 0 as swap
from edges e left join people s on s.id = e.source left join people t on t.id = e.target""")
def direction_checks(b):
    births = b.people_core.select("id", "birth")
    df = b.edges
    for end in ["source", "target"]:
        df = df.join(births.select(F.col("id").alias(end), F.col("birth").alias(f"{end}_birth")),
                     end, "left")
    wording = F.when(F.col("ord") % 8 == 0, "was Influenced By").otherwise("wrote about")
    warned = df.withColumn("w", rc.direction_check(
        F.col("source"), F.col("target"), F.col("type"), F.col("source_birth"),
        F.col("target_birth"), wording))
    return warned.select("id", F.array_join("w", "|").alias("warnings"),
                         rc.suggests_swap(F.col("w")).alias("swap"))


@query("suggestion_categories", """
select id, case when regexp_matches(t, 'mentored|advisor|student') then 'direct mentorship'
  when regexp_matches(t, 'collaborated|coauthor|correspondence|jointly authored') then 'collaboration'
  when regexp_matches(t, 'parallel development|shared concept without transmission') then 'parallel development'
  when regexp_matches(t, 'source proximity') then 'source-context neighbor'
  when regexp_matches(t, 'influenced|influence|citation|reception') then 'likely influence' else 'needs review' end as category
from (select id, lower(type || ' ' || coalesce(note, '')) as t from edges)""")
def suggestion_categories(b):
    return b.edges.select("id", rc.category(F.col("type"), F.array("note")).alias("category"))


@query("candidate_store", """
with mentors as (
  select distinct case kind when 'advisor' then value else person_id end as s, case kind when 'advisor' then person_id else value end as t
  from evidence_links where kind in ('advisor', 'student'))
select 'person:' || s as source_id, 'person:' || t as target_id from mentors
where not exists (select 1 from edges e where e.source = s and e.target = t and e.type = 'Mentorship')""")
def candidate_store(b):
    accepted = b.edges.filter("type = 'Mentorship'").select(F.concat(
        F.lit("relationship:person:"), "source", F.lit(":person mentored person:person:"),
        "target").alias("id"))
    return rc.candidate_store(rc.mentorship(b.evidence_links), accepted).select(
        "source_id", "target_id")


@query("candidate_explanations", """
select id, coalesce(note, 'none') || ': ' || source || ' -> ' || target || ' (' || cast(coalesce(conf100, 50) as varchar) || '%). Evidence: '
   || coalesce(array_to_string(claim_ids, '; '), 'no evidence details recorded') || '.'
   || case when coalesce(len(source_claims), 0) > 0 then ' Sources: ' || array_to_string(source_claims, ', ') || '.' else '' end as explanation,
   case when coalesce(conf100, 50) < 50 or status = 'needs_source' or note is null then 'review' else 'automated' end as lane
from edges""")
def candidate_explanations(b):
    confidence = F.coalesce("confidence", F.lit(0.5))
    label = F.when(F.col("note").isNull(), "needs review").otherwise(F.col("note"))
    return b.edges.select(
        "id", rc.explanation(F.coalesce("note", F.lit("none")), F.col("source"), F.col("target"),
                             confidence, ev.listed("claim_ids"), ev.listed("source_claims"))
        .alias("explanation"),
        rc.review_lane(confidence, F.col("status"), label).alias("lane"))


@query("candidate_provenance", """
select l.id, coalesce(len(list_distinct(list_concat(coalesce(l.source_claims, []), ['https://x.example.org/' || l.id]))), 0) as urls,
       coalesce(len(list_distinct(list_concat(coalesce(l.claim_ids, []), coalesce(l.claim_ids, [])))), 0) as claims
from edges l""")
def candidate_provenance(b):
    candidates = b.edges.select(F.col("id").alias("candidate_id"),
                                F.col("source_claims").alias("source_urls"), "claim_ids")
    extra = b.edges.select(
        F.col("id").alias("candidate_id"), "claim_ids",
        F.array(F.concat(F.lit("https://x.example.org/"), "id")).alias("source_urls"))
    joined = rc.with_provenance(candidates, extra)
    return joined.select(F.col("candidate_id").alias("id"),
                         F.size("source_urls").cast("long").alias("urls"),
                         F.size("claim_ids").cast("long").alias("claims"))


def _discovery(neighbor_pairs: str, chosen: str = "") -> str:
    return f"""
live as (select * from claims where status not in ('rejected', 'stale', 'conflicting')),
stated as (
  select i.id as source, i.target, 'Influence' as type, 680 as x, 3 as strength, null as claim_id, null as url, null as thread_id, 'Metadata explicit influence signal.' as note, 0 as channel, p.pid as ord,
         cast(row_number() over (partition by i.id order by i.target) as int) as pos
  from person_influenced i join people p on p.id = i.id where i.target in (select id from people)
  union all
  select case when event_id % 4 = 1 then regexp_extract(subject_id, '^relationship:person:([^:]+):(.+):person:([^:]+)$', 1) else cast(event_id // 7 as varchar) end,
         case when event_id % 4 = 1 then regexp_extract(subject_id, '^relationship:person:([^:]+):(.+):person:([^:]+)$', 3) else cast(event_id // 9 as varchar) end,
         case when event_id % 4 = 1 then 'Influence' when event_id % 3 = 0 then 'Influence' when event_id % 3 = 1 then 'Mentorship' else 'Collaboration' end,
         conf100 * 10, greatest(1, cast(floor(conf100 * 5 / 100.0 + 0.5) as int)), id, source_url, null, 'Relationship claim from ' || source_name || ': ' || value, 1, event_id, 0
  from live where subject_type = 'Relationship'
  union all
  select case when field in ('doctoral advisor') then substr(value, 8) else substr(subject_id, 8) end,
         case when field in ('doctoral advisor') then substr(subject_id, 8) else substr(value, 8) end, 'Mentorship',
         conf100 * 10, greatest(1, cast(floor(conf100 * 5 / 100.0 + 0.5) as int)), id, source_url, null, 'Advisor/student lineage claim from ' || source_name || '.', 1, event_id, 1
  from live where subject_type = 'Person' and field in ('doctoral advisor', 'student of', 'notable student') and substr(subject_id, 8) <> substr(value, 8)
    and substr(subject_id, 8) in (select id from people) and substr(value, 8) in (select id from people)
  union all
  select substr(subject_id, 8), substr(value, 8), 'Collaboration', conf100 * 10, greatest(1, cast(floor(conf100 * 5 / 100.0 + 0.5) as int)), id, source_url, null, 'Collaboration claim from ' || source_name || '.', 1, event_id, 2
  from live where subject_type = 'Person' and field in ('coauthor', 'correspondent') and substr(subject_id, 8) <> substr(value, 8)
    and substr(subject_id, 8) in (select id from people) and substr(value, 8) in (select id from people)
  union all
  select left_id, right_id, coalesce(t.edge_type, 'Source-context neighbor'), case when t.confidence = 'high' then 820 else 640 end, 3, null, null, t.id,
         'Canonical thread gap candidate: ' || t.title || '.', 3, t.tid, p.step
  from thread_pairs p join threads t on t.id = p.thread_id
  where left_id in (select id from people) and right_id in (select id from people)),
{neighbor_pairs}
context as (
  select case when (p.birth, p.pid) <= (q.birth, q.pid) then a else b end as source, case when (p.birth, p.pid) <= (q.birth, q.pid) then b else a end as target,
         'Source-context neighbor' as type, 420 as x, 2 as strength, null as claim_id, null as url, null as thread_id,
         'Chronology-constrained shared ' || case when coalesce(p.movement = q.movement, false) then 'movement: ' || p.movement else 'region: ' || p.region end || '.' as note, 2 as channel, least(p.pid, q.pid) as ord, 0 as pos
  from neighbor_pairs n join people p on p.id = n.a join people q on q.id = n.b
  where (coalesce(p.movement = q.movement, false) or coalesce(p.region = q.region, false)) and abs(p.birth - q.birth) <= 125),
keyed as (
  select *, case when type in {NON_DIRECTIONAL} then least(source, target) else source end as key_a,
            case when type in {NON_DIRECTIONAL} then greatest(source, target) else target end as key_b
  from (select * from stated {chosen} union all select * from context)),
taken as (
  select distinct type, case when type in {NON_DIRECTIONAL} then least(source, target) else source end as key_a,
         case when type in {NON_DIRECTIONAL} then greatest(source, target) else target end as key_b from edges),
evidence as (select k.* from keyed k anti join taken t on t.type = k.type and t.key_a = k.key_a and t.key_b = k.key_b),
merged as (
  select key_a, key_b, type, min_by(source, row(channel, ord, pos)) as source, min_by(target, row(channel, ord, pos)) as target,
         min_by(strength, row(channel, ord, pos)) as strength,
         list_reduce(list(x order by channel, ord, pos), lambda acc, v: least(980, greatest(acc, v) + 30)) as score,
         count(*) as evidence, count(claim_id) as n_claims, count(thread_id) as n_threads, count(url) as n_urls,
         string_agg(coalesce(note, '') || ' ' || coalesce(url, ''), ' ; ' order by channel, ord, pos) as texts
  from evidence group by 1, 2, 3)"""


DISCOVERY = _discovery("""neighbor_pairs as (select distinct least(source, target) as a, greatest(source, target) as b from stated where type = 'Source-context neighbor' and source <> target),""")
#: Everything that touches the chosen people, pairs of mere context included.
DISCOVERY_FOR = _discovery(f"""{FOCUS},
neighbor_pairs as (
  select distinct least(p.id, q.id) as a, greatest(p.id, q.id) as b from people p join people q on p.id <> q.id
    and (coalesce(p.movement = q.movement, false) or coalesce(p.region = q.region, false)) where p.id in (select id from focus)),""",
    "where source in (select id from focus) or target in (select id from focus)")


@query("missing_edges", f"""with {DISCOVERY}
select type, source, target, strength, score / 1000.0::double as confidence, evidence, n_claims, n_threads from merged""")
def missing_edges(b):
    return me.discover(b.people, b.edges, b.claims, b.threads).select(
        "type", "source", "target", "strength", "confidence", "evidence", "n_claims",
        "n_threads")


@query("missing_edges_for", f"""with {DISCOVERY_FOR}
select type, source, target, strength, score / 1000.0::double as confidence, evidence, n_claims, n_threads from merged""")
def missing_edges_for(b):
    return me.discover(b.people, b.edges, b.claims, b.threads, _focus(b)).select(
        "type", "source", "target", "strength", "confidence", "evidence", "n_claims",
        "n_threads")


@query("context_groups", """with ctx as (
  select 'movement' as kind, movement as value, birth, pid from people where movement is not null
  union all select 'region', region, birth, pid from people
  union all select 'both', movement || '|' || region, birth, pid from people where movement is not null)
select a.kind, a.value, count(distinct a.pid) as members, count(b.pid) as pairs
from ctx a left join ctx b on a.kind = b.kind and a.value = b.value and a.pid < b.pid and abs(a.birth - b.birth) <= 125 group by 1, 2""")
def context_groups(b):
    return me.context_groups(b.people_core)


@query("context_pairs", f"""with {FOCUS}, ctx as (
  select 'movement' as kind, movement as value, birth, pid, id from people where movement is not null
  union all select 'region', region, birth, pid, id from people),
hits as (
  select case when a.birth <= b.birth then a.id else b.id end as source, case when a.birth <= b.birth then b.id else a.id end as target, a.kind, a.value
  from ctx a join ctx b on a.kind = b.kind and a.value = b.value and a.pid < b.pid and abs(a.birth - b.birth) <= 125
  where a.id in (select id from focus) or b.id in (select id from focus))
select source, target, 'Chronology-constrained shared ' || min_by(kind || ': ' || value, kind) || '.' as note from hits group by 1, 2""")
def context_pairs(b):
    return me.context_pairs(b.people_core, _focus(b))


VALIDATION = f"""
attached as (
  select key_a, key_b, e.type, count(c.id) as n_attached, count(*) filter (where c.subject_type = 'Relationship') as n_direct,
         count(*) filter (where c.subject_type = 'Relationship' and c.status not in ('rejected', 'stale', 'conflicting')) as n_usable,
         count(*) filter (where c.recency > 3650) as n_stale,
         bool_or(regexp_matches(lower(coalesce(e.note, '') || ' ' || coalesce(e.url, '') || ' ' || coalesce(c.field || ' ' || c.value || ' ' || c.source_name, '')), 'explicit|influence|influenced|citation|reception|named mention|mentor|advisor|student')) as hit_i,
         bool_or(regexp_matches(lower(coalesce(e.note, '') || ' ' || coalesce(e.url, '') || ' ' || coalesce(c.field || ' ' || c.value || ' ' || c.source_name, '')), 'mentor|mentored|advisor|student|supervisor|tutor')) as hit_m,
         bool_or(regexp_matches(lower(coalesce(e.note, '') || ' ' || coalesce(e.url, '') || ' ' || coalesce(c.field || ' ' || c.value || ' ' || c.source_name, '')), 'collaborat|coauthor|co-author|correspondence|jointly|worked with')) as hit_c,
         bool_or(regexp_matches(lower(coalesce(e.note, '') || ' ' || coalesce(e.url, '') || ' ' || coalesce(c.field || ' ' || c.value || ' ' || c.source_name, '')), 'source-context|source proximity|context|same source|neighbor|co-mentioned')) as hit_s
  from evidence e left join claim_ages c on c.id = e.claim_id group by 1, 2, 3),
directions as (
  select least(source, target) as lo, greatest(source, target) as hi, type, count(*) filter (where source <= target) as up, count(*) filter (where source > target) as down
  from merged group by 1, 2, 3),
judged as (
  select m.*, a.*exclude(key_a, key_b, type), s.id is null as no_source, t.id is null as no_target,
         coalesce(m.type not in {NON_DIRECTIONAL} and s.birth > t.birth + 20, false) as impossible,
         d.up > 0 and d.down > 0 as opposite,
         m.n_claims + m.n_urls as n_refs,
         (m.strength >= 4 or m.n_threads > 0) and m.score < 750 as weak
  from merged m join attached a on a.key_a = m.key_a and a.key_b = m.key_b and a.type = m.type
  join directions d on d.lo = least(m.source, m.target) and d.hi = greatest(m.source, m.target) and d.type = m.type
  left join people s on s.id = m.source left join people t on t.id = m.target),
flagged as (
  select *, no_source or no_target or source = target or impossible or opposite as invalid,
    n_refs = 0 or n_stale > 0 or weak or (n_attached > 0 and n_direct = 0) as ev_bad,
    (type = 'Influence' and not hit_i) or (type = 'Mentorship' and not hit_m) or (type = 'Collaboration' and not hit_c) or (type = 'Source-context neighbor' and not hit_s)
      or (n_threads > 0 and (score < 850 or n_refs = 0)) as rule_bad,
    case when n_refs = 0 then 0 else ((n_usable + n_urls) * 2000 + n_refs) // (2 * n_refs) end as coverage
  from judged)
select type, source, target, case when invalid then 'discard' when not ev_bad and not rule_bad and coverage > 0 then 'add' else 'auto-investigate' end as recommended_action,
       (case when invalid then score else least(1000, (score + coverage + 1) // 2) end) / 1000.0::double as confidence_score
from flagged"""


def _validated(b, focus=None):
    people = b.people_core
    if focus is not None:  # several steps read them, and each would plan their joins anew
        people = cut_lineage(people.select("id", "ord", "birth", "movement", "region"))
        focus = cut_lineage(focus)
    rows = me.evidence_rows(b.people, b.edges, b.claims, b.threads, focus)
    merged = me.merge(rows)
    if focus is not None:
        merged = cut_lineage(merged)
    found = ev.validate_discovered(people, merged, rows, b.claims, b.now)
    columns = ["type", "source", "target", "recommended_action", "confidence_score"]
    if focus is None:
        return found.select(*columns)

    def judged(notes):
        return ev.validate_lone(notes.select(
            "note", F.lit(me.NEIGHBOR).alias("type"), F.lit(2).alias("strength"),
            F.lit(0.42).alias("confidence"))).select(
            "note", "recommended_action", "confidence_score")

    return found.select(*columns).unionByName(me.lone_context(
        people, b.edges, rows, focus, judged).select(*columns))


@query("candidate_validation", f"with {DISCOVERY},{VALIDATION}")
def candidate_validation(b):
    return _validated(b)


@query("candidate_validation_for", f"with {DISCOVERY_FOR},{VALIDATION}")
def candidate_validation_for(b):
    return _validated(b, _focus(b))
