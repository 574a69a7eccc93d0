"""Ordered-path analytics over the bound tables."""

from pyspark.sql import functions as F

from evigraph.operators import threads as th
from evigraph.plans.catalog import query

PAIR_EDGES = """
pair_edges as (
  select low, high, conf100, status, has_evidence, n_sources from (
    select *, least(source, target) as low, greatest(source, target) as high,
           row_number() over (partition by least(source, target), greatest(source, target) order by eid) as rn from edge_flags)
  where rn = 1),
walked as (
  select p.*, e.low is not null as has_edge, e.conf100, e.status, e.has_evidence, e.n_sources, l.birth as lb, r.birth as rb
  from thread_pairs p left join pair_edges e on e.low = least(left_id, right_id) and e.high = greatest(left_id, right_id)
  left join people l on l.id = left_id left join people r on r.id = right_id)"""

LINKS = """
links as (select distinct left_id, right_id from thread_pairs),
outs as (select left_id as entity_id, count(*) as outgoing from links group by 1),
ins as (select right_id as entity_id, count(*) as incoming from links group by 1),
junctions as (
  select coalesce(o.entity_id, i.entity_id) as entity_id, coalesce(outgoing, 0) as outgoing, coalesce(incoming, 0) as incoming
  from outs o full join ins i on i.entity_id = o.entity_id where coalesce(outgoing, 0) > 1 or coalesce(incoming, 0) > 1),
markers as (select *, case when outgoing > 1 and incoming > 1 then 'both' when outgoing > 1 then 'branch' else 'convergence' end as kind from junctions)"""


@query("thread_tags", """
select distinct id, thread_id from (
  select id, unnest(thread_ids) as thread_id from edges
  union all select e.id, p.thread_id from edges e join thread_pairs p
    on (e.source = p.left_id and e.target = p.right_id) or (e.source = p.right_id and e.target = p.left_id))""")
def thread_tags(b):
    return th.tag_edges(b.edges, b.threads).select("id", "thread_id")


@query("thread_gaps", f"""with {PAIR_EDGES}
select thread_id, 'missing-intermediate-figure' as code, 'critical' as severity, step as step_index, person_id as source_id, null as target_id
from thread_steps where person_id not in (select id from people)
union all select thread_id, 'missing-edge', 'critical', step, left_id, right_id from walked where not has_edge
union all select thread_id, 'missing-edge-source', 'warning', step, left_id, right_id from walked where has_edge and n_sources = 0
union all select thread_id, 'weak-claim', 'warning', step, left_id, right_id from walked where has_edge and (coalesce(conf100, 100) < 50 or status = 'needs_source')
union all select thread_id, 'overlong-chronology-jump', 'info', step, left_id, right_id from walked where abs(rb - lb) > 250""")
def thread_gaps(b):
    return th.gap_audit(b.threads, b.people_core, b.edges)


@query("thread_junctions", f"with {LINKS} select entity_id, kind, incoming, outgoing from markers")
def thread_junctions(b):
    return th.junctions(b.threads).select("entity_id", "kind", "incoming", "outgoing")


@query("thread_marker_counts", f"""with {LINKS},
touch as (select distinct thread_id, person_id from thread_steps)
select t.id as thread_id, count(*) filter (where m.kind in ('branch', 'both')) as branches,
       count(*) filter (where m.kind in ('convergence', 'both')) as convergences
from threads t left join touch s on s.thread_id = t.id left join markers m on m.entity_id = s.person_id group by 1""")
def thread_marker_counts(b):
    return th.junction_counts(b.threads)


@query("thread_convergence", """
select right_id as entity_id, count(distinct left_id) as incoming, count(distinct thread_id) as threads
from thread_pairs group by 1 having count(distinct left_id) > 1""")
def thread_convergence(b):
    return th.convergence(b.threads)


@query("thread_convergence_members", """
select distinct right_id as entity_id, left_id as incoming_id, thread_id from thread_pairs
where right_id in (select right_id from thread_pairs group by 1 having count(distinct left_id) > 1)""")
def thread_convergence_members(b):
    return th.convergence_members(b.threads)


@query("thread_resolution", f"""with {PAIR_EDGES},
known as (
  select thread_id, person_id, row_number() over (partition by thread_id order by step) as pos from thread_steps
  where person_id in (select id from people)),
sizes as (select thread_id, count(*) as n_resolved from known group by 1 having count(*) >= 2),
adjacent as (select a.thread_id, a.person_id as l, c.person_id as r from known a join known c on a.thread_id = c.thread_id and c.pos = a.pos + 1),
gaps as (
  select thread_id, count(*) filter (where e.low is null) as edge_gaps,
         count(*) filter (where e.low is not null and (coalesce(conf100, 100) < 50 or not has_evidence)) as weak_edges
  from adjacent left join pair_edges e on e.low = least(l, r) and e.high = greatest(l, r) group by 1)
select s.thread_id, n_resolved, (select count(*) from thread_steps t where t.thread_id = s.thread_id) - n_resolved as n_missing, edge_gaps, weak_edges
from sizes s join gaps g on g.thread_id = s.thread_id""")
def thread_resolution(b):
    return th.resolve(b.threads, b.people_core, b.edges).select(
        F.col("id").alias("thread_id"), F.size("resolved").cast("long").alias("n_resolved"),
        F.size("missing").cast("long").alias("n_missing"), "edge_gaps", "weak_edges")


@query("thread_continuation", """
with known as (
  select tid, thread_id, person_id, cast(row_number() over (partition by tid order by step) - 1 as int) as step,
         count(*) over (partition by tid) as n
  from thread_steps where person_id in (select id from people))
select person_id, thread_id, cast(greatest(0, least(step, n - 2)) as int) as step from (
  select *, row_number() over (partition by person_id order by tid, step) as rn from known where n >= 2) where rn = 1""")
def thread_continuation(b):
    return th.continue_from(th.resolve(b.threads, b.people_core, b.edges))


@query("thread_projection", """
select s.thread_id, t.title, s.step, s.person_id as entity_id,
       case t.confidence when 'high' then 'sourced' when 'medium' then 'partial' else 'needs-source' end as source_status
from thread_steps s join threads t on t.id = s.thread_id""")
def thread_projection(b):
    return th.project(b.threads).select("thread_id", "title", "step", "entity_id",
                                        "source_status")


@query("thread_import", """
select id, confidence from threads where tid % 2 = 0
union all select id, case when tid % 3 = 1 then 'needs-review' else confidence end from threads where tid % 2 = 1""")
def thread_import(b):
    bundled = b.threads.filter("ord % 2 = 0")
    imported = b.threads.unionByName(
        b.threads.filter("ord % 3 = 1").withColumns({
            "confidence": F.lit("needs-review"), "ord": F.col("ord") + 1000000000000}))
    return th.merge_imported(bundled, imported).select("id", "confidence")
