"""Quality metrics, audits and repair plans over the bound tables."""

from pyspark.sql import functions as F

from evigraph.operators import graph_quality as gq
from evigraph.plans.catalog import query

AUDIT = """
name_counts as (select trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) as k, count(*) as n from people group by 1),
person_facts as (
  select p.*, coalesce(d.degree, 0) as degree, n.n as same_name,
         (select count(*) from person_works w where w.id = p.id) as n_works
  from people p left join degrees d on d.id = p.id
  join name_counts n on n.k = trim(regexp_replace(lower(p.name), '[^a-z0-9]+', ' ', 'g'))),
findings as (
  select 'dangling-reference' as code, 'critical' as severity, source || '->' || target as target_id from edges
    where source not in (select id from people) or target not in (select id from people)
  union all select 'unsupported-edge', 'warning', source || '->' || target from edge_flags where n_sources = 0
  union all select 'isolated-node', 'warning', id from person_facts where degree = 0
  union all select 'sparse-high-bridge-node', 'warning', id from person_facts where bridge_score >= 4 and degree <= 1
  union all select 'impossible-dates', 'critical', id from person_facts where death < birth
  union all select 'missing-works', 'info', id from person_facts where n_works = 0
  union all select 'over-broad-tag', 'info', id from person_facts where subfield is null and (field1 = 'Philosophy')
  union all select 'duplicate-entity-risk', 'warning', id from person_facts where same_name > 1
  union all select 'stale-source-claim', 'warning', id from claim_ages where recency > 3650)"""

GAP = "(coalesce(status = 'needs_source', false) or coalesce(conf100, 100) < 50 or not has_evidence)"

REVIEW = f"""
touching as (
  select id, count(*) as degree, count(*) filter (where gap) as gap_edges from (
    select source as id, eid, {GAP} as gap from edge_flags
    union select target, eid, {GAP} from edge_flags) group by id),
review as (
  select p.*, coalesce(t.degree, 0) as degree, coalesce(t.gap_edges, 0) as gap_edges,
         coalesce(movement = 'Imported', false) or coalesce(notes like '%Imported from%', false) as imported
  from people p left join touching t on t.id = p.id),
statuses as (
  select *, case when imported and degree = 0 then 'Unlinked import' when gap_edges > 0 then 'Needs source review'
                 when subfield is null then 'Needs tags' when degree = 0 then 'Orphan' when degree <= 1 then 'Sparse links'
                 when imported then 'Imported linked' else 'Connected' end as review_status
  from review)"""


@query("degree", "select id, degree from degrees")
def degree(b):
    return gq.degree(b.edges)


@query("isolated_nodes", "select id from people where id not in (select id from ends)")
def isolated_nodes(b):
    return b.people_core.join(gq.endpoints(b.edges).select("id").distinct(), "id", "left_anti").select("id")


@query("graph_metrics", """
select 'sourced_edge_percentage' as metric, (count(*) filter (where n_sources > 0) * 2000 + count(*)) // (2 * count(*)) / 1000.0::double as value from edge_flags
union all select 'accepted_edge_percentage', (count(*) filter (where status = 'accepted') * 2000 + count(*)) // (2 * count(*)) / 1000.0::double from edges
union all select 'average_edge_confidence', cast((sum(coalesce(conf100, 50)) * 20 + count(*)) // (2 * count(*)) as bigint) / 1000.0::double from edges
union all select 'isolated_node_count', cast(count(*) as double) from people where id not in (select id from ends)
union all select 'duplicate_risk_count', cast(coalesce(sum(n), 0) as double) from (
  select count(*) as n from people group by trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'))) where n > 1
union all select 'average_source_freshness_days', cast((sum(recency) * 20 + count(recency)) // (2 * count(recency)) as bigint) / 10.0::double from claim_ages
union all select 'canonical_thread_coverage', ((select count(distinct person_id) from thread_steps) * 2000 + count(*)) // (2 * count(*)) / 1000.0::double from people""")
def graph_metrics(b):
    return gq.metrics(b.people_core, b.edges, b.claims, b.threads, b.now)


@query("graph_audit", f"with {AUDIT} select code, severity, target_id from findings")
def graph_audit(b):
    return gq.audit(b.people, b.edges, b.claims, b.now).select("code", "severity", "target_id")


@query("audit_summary", f"with {AUDIT} select severity, count(*) as findings from findings group by severity")
def audit_summary(b):
    return gq.severity_summary(gq.audit(b.people, b.edges, b.claims, b.now))


@query("repair_triggers", f"""with {AUDIT}
select 'repair:' || severity || '-findings' as id, cast(count(*) as varchar) || ' ' || severity || ' graph quality findings' as reason,
       array_to_string(list_sort(list(distinct code)), '|') as finding_codes
from findings where severity <> 'info' group by severity having count(*) >= case severity when 'critical' then 1 else 5 end""")
def repair_triggers(b):
    found = gq.audit(b.people, b.edges, b.claims, b.now)
    return gq.repair_triggers(found).select(
        "id", "reason", F.array_join("finding_codes", "|").alias("finding_codes"))


@query("isolated_connections", """with mentors as (
  select distinct case kind when 'advisor' then value else person_id end as s, case kind when 'advisor' then person_id else value end as t
  from evidence_links where kind in ('advisor', 'student'))
select s as source, t as target, 'person mentored person' as type, 4 as strength, 0.85::double as confidence
from mentors where s in (select id from people where id not in (select id from ends)) or t in (select id from people where id not in (select id from ends))""")
def isolated_connections(b):
    from evigraph.operators import relationship_candidates as rc

    found = rc.mentorship(b.evidence_links)
    return gq.connect_isolated(b.people_core, b.edges, found).select(
        "source", "target", "type", "strength", "confidence")


@query("demotions", """
select id, 'needs_source' as status from edge_flags
where coalesce(conf100, 50) < 50 and n_sources = 0 and coalesce(status, '') <> 'needs_source'""")
def demotions(b):
    return gq.demote_weak(b.edges).select("id", "status")


@query("attach_claims", """
select e.id, c.id as claim_id from edge_flags e
join claims c on c.subject_id = 'relationship:person:' || e.source || ':' || e.type || ':person:' || e.target
where e.status = 'accepted' and e.n_sources = 0 and c.subject_type = 'Relationship' and c.reliability10 >= 8 and c.status not in ('rejected', 'stale')
union all
select e.id, c.id from edge_flags e join claims c on c.subject_id = 'rel-' || cast(e.eid % 50 as varchar)
where e.status = 'accepted' and e.n_sources = 0 and c.subject_type = 'Relationship' and c.reliability10 >= 8 and c.status not in ('rejected', 'stale')""")
def attach_claims(b):
    known = b.edges.withColumnRenamed("id", "_id")
    derived = gq.attach_claims(known.withColumn("id", F.lit(None).cast("string")), b.claims)
    named = gq.attach_claims(known.withColumn("id", F.concat(
        F.lit("rel-"), (F.col("ord") % 50).cast("string"))), b.claims)
    return derived.unionByName(named).select(F.col("ord").cast("string").alias("id"), "claim_id")


@query("source_gap_people", f"with {REVIEW} select id, gap_edges from statuses where gap_edges > 0")
def source_gap_people(b):
    return gq.source_gap_people(b.people_core, b.edges)


@query("review_status", f"with {REVIEW} select id, degree, gap_edges, review_status from statuses")
def review_status(b):
    return gq.review_facts(b.people_core, b.edges).select("id", "degree", "gap_edges",
                                                          "review_status")


@query("review_lists", f"""with {REVIEW},
unlinked as (select 'unlinked' as list, id from statuses where degree = 0 order by pid limit 20),
sparse as (select 'sparse' as list, id from statuses where degree = 1 order by pid limit 20),
weak as (select 'weakly-tagged' as list, id from statuses where subfield is null order by pid limit 20)
select * from unlinked union all select * from sparse union all select * from weak
union all select 'unlinked-import', id from statuses where degree = 0 and imported""")
def review_lists(b):
    return gq.review_lists(b.people_core, b.edges)


@query("field_report", f"""with {REVIEW},
broad as (
  select e.eid, e.source, e.target from edges e where type = 'Influence' and (
    regexp_matches(lower(type || ' ' || coalesce(note, '')), 'mentor|advisor|supervisor|student|tutor|succeeded as head|direct .*teacher'
      || '|collaborat|co-created|co-developed|co-authored|correspondence|friendship|rivalry|worked with|parallel|independent|concurrent|rival school|contrast|challenged'
      || '|context|transmission|translation|translated|preserved|revived|precursor|anticipated|thread bridge|maps to|fed '))),
touched as (
  select distinct b.eid, f.field from broad b join person_fields f on f.id in (b.source, b.target)),
meta as (select distinct i.id from person_influenced i where not exists (select 1 from edges e where e.source = i.id and e.target = i.target))
select f.field, count(*) as people, count(*) filter (where degree = 0) as isolated,
       count(*) filter (where degree = 0 and s.id in (select id from meta)) as metadata_only,
       count(*) filter (where bridge_score >= 4 and degree < 2) as sparse_high_bridge,
       (select count(*) from touched t where t.field = f.field) as refinement_candidates
from statuses s join person_fields f on f.id = s.id group by f.field""")
def field_report(b):
    return gq.field_report(b.people, b.edges)


@query("edge_conflicts", """
select least(source, target) as low, greatest(source, target) as high, count(*) as edges from edges
group by 1, 2 having count(distinct source || '->' || target) > 1 or count(distinct type) > 1""")
def edge_conflicts(b):
    return gq.conflicting_pairs(b.edges)


@query("thread_coverage", """
select 'field' as facet, field as value, count(*) filter (where id in (select person_id from thread_steps)) as covered, count(*) as total
from person_fields group by field
union all
select 'era', era, count(*) filter (where id in (select person_id from thread_steps)), count(*) from people group by era""")
def thread_coverage(b):
    return gq.thread_coverage(b.people_core, b.threads)


@query("missing_thread_people", "select distinct person_id as id from thread_steps where person_id not in (select id from people)")
def missing_thread_people(b):
    return gq.missing_thread_people(b.people_core, b.threads)
