"""Traversal and neighbourhood queries over the bound tables."""

from pyspark.sql import functions as F

from evigraph.operators import traversal as tr
from evigraph.plans.catalog import query
from evigraph.plans.exploration_queries import HUB, hub


def _levels_sql(links: str, depth: int) -> str:
    return f"""
hub as {HUB},
links as (select distinct source, target from ({links})),
walk(id, depth) as (
  select id, 0 from hub union select l.target, w.depth + 1 from walk w join links l on l.source = w.id where w.depth < {depth}),
depths as (select id, min(depth) as depth from walk group by id)"""


DIRECTED = "select source, target from edges"
BOTH = "select source, target from edges union select target, source from edges"


@query("bfs_levels", f"""with recursive {_levels_sql(DIRECTED, 3)}
select depth, id from (
  select d.depth, d.id, row_number() over (partition by depth order by p.pid) as rn from depths d join people p on p.id = d.id where depth > 0) where rn <= 8""")
def bfs_levels(b):
    return tr.level_sample(b.edges, b.people_core, hub(b)).select("depth", "id")


@query("reachable_depths", f"with recursive {_levels_sql(BOTH, 40)} select id, depth from depths")
def reachable_depths(b):
    return tr.reachable(b.edges, hub(b))


@query("ego_network", f"""with recursive {_levels_sql(BOTH, 2)}
select 'person' as kind, id from depths where id in (select id from people)
union all select 'edge', id from edges where source in (select id from depths) and target in (select id from depths)""")
def ego_network(b):
    people, edges = tr.ego_network(b.edges, b.people_core, hub(b))
    return people.select(F.lit("person").alias("kind"), "id").unionByName(
        edges.select(F.lit("edge").alias("kind"), "id"))


PATH = f"""
hub as {HUB},
links as (select source, target, min(eid) as ord from edges where source in (select id from people) group by 1, 2),
walk(id, depth, orders, path) as (
  select id, 0, [0::bigint], [id] from hub
  union all
  select target, depth, orders, path from (
    select l.target, w.depth + 1 as depth, min(list_append(w.orders, l.ord)) as orders, arg_min(list_append(w.path, l.target), list_append(w.orders, l.ord)) as path
    from walk w join links l on l.source = w.id where w.depth < 5 group by l.target, w.depth)),
depths as (select id, min(depth) as depth from walk group by id),
goal as (select d.id from depths d join people p on p.id = d.id order by d.depth desc, p.pid limit 1),
best as (select path from walk where id in (select id from goal) order by depth limit 1),
steps as (select unnest(path) as id, cast(unnest(range(len(path))) as int) as step from best)"""


def _path(b):
    start = hub(b)
    far = tr.levels(b.edges.join(b.people_core.select(F.col("id").alias("source")), "source",
                                 "left_semi"), start, 5)
    goal = far.join(b.people_core.select("id", "ord"), "id").orderBy(
        F.desc("depth"), "ord").limit(1).select("id")
    return tr.shortest_path(b.edges, b.people_core, start, goal)


@query("shortest_path", f"with recursive {PATH} select step, id from steps")
def shortest_path(b):
    return _path(b)


@query("path_edges", f"""with recursive {PATH}
select a.step, a.id as source, c.id as target, max_by(e.id, e.eid) as edge_id from steps a join steps c on c.step = a.step + 1
left join edges e on e.source = a.id and e.target = c.id group by 1, 2, 3""")
def path_edges(b):
    return tr.path_edges(_path(b), b.edges).select("step", "source", "target", "edge_id")


@query("neighborhood", f"""
select distinct source as focus_id, target as id, 'out' as direction from edges where source = {HUB}
union select distinct target, source, 'in' from edges where target = {HUB}""")
def neighborhood(b):
    return tr.neighborhood(b.edges, hub(b))


@query("neighborhood_summary", """with bothways as (
  select source as id, target as o, eid from edges union select target, source, eid from edges)
select id, count(distinct case when o <> id then o end) as neighbors, count(distinct eid) as links from bothways group by 1""")
def neighborhood_summary(b):
    return tr.neighborhood_summary(b.edges)


@query("genealogy", f"""with recursive
hub as {HUB},
up(id, depth) as (select id, 0 from hub union select e.source, u.depth + 1 from up u join edges e on e.target = u.id where u.depth < 3 and e.source in (select id from people)),
down(id, depth) as (select id, 0 from hub union select e.target, d.depth + 1 from down d join edges e on e.source = d.id where d.depth < 3 and e.target in (select id from people)),
ups as (select id, min(depth) as depth from up group by 1), downs as (select id, min(depth) as depth from down group by 1)
select 'ancestor' as line, a.id, a.depth, min_by(e.type, e.eid) as type from ups a join ups p on p.depth + 1 = a.depth join edges e on e.source = a.id and e.target = p.id where a.depth > 0 group by 1, 2, 3
union all
select 'descendant', a.id, a.depth, min_by(e.type, e.eid) from downs a join downs p on p.depth + 1 = a.depth join edges e on e.target = a.id and e.source = p.id where a.depth > 0 group by 1, 2, 3""")
def genealogy(b):
    return tr.genealogy(b.edges, b.people_core, hub(b))


@query("relation_rows", f"""with r as (
  select e.*, target as other_id, 'out' as direction from edge_flags e where source = {HUB}
  union all select e.*, source, 'in' from edge_flags e where target = {HUB} and source <> target)
select r.id, r.other_id, p.name as other, direction, strength,
  coalesce(status = 'needs_source', false) or not has_evidence or coalesce(conf100, 100) < 50 as weak
from r join people p on p.id = r.other_id""")
def relation_rows(b):
    return tr.relation_rows(b.people_core, b.edges, hub(b)).select(
        "id", "other_id", "other", "direction", "strength", "weak")


@query("nearest_relations", """with ends_of as (
  select id as edge_id, eid, source as me, target as other, 'out' as direction from edges
  union all select id, eid, target, source, 'in' from edges where source <> target),
ranked as (select *, row_number() over (partition by me order by eid) as position from ends_of)
select edge_id, me, other, direction, cast(position as int) as position from ranked where position <= 6 and other in (select id from people)""")
def nearest_relations(b):
    return tr.nearest_relations(b.people_core, b.edges).select(
        "edge_id", "me", "other", "direction", "position")


@query("top_relatives", """with rel as (
  select 'parent' as side, target as id, source as other, eid from edges union all select 'child', source, target, eid from edges),
ranked as (select r.*, p.bridge_score, row_number() over (partition by side, r.id order by p.bridge_score desc, eid) as position from rel r join people p on p.id = r.other)
select side, id, other, cast(position as int) as position from ranked where position <= 5""")
def top_relatives(b):
    return tr.top_relatives(b.people_core, b.edges).select("side", "id", "other", "position")


@query("field_peers", """with pairs as (
  select a.id as person_id, p.id as peer_id, row_number() over (partition by a.id order by p.bridge_score desc, p.pid) as position
  from people a join people p on p.id <> a.id and (p.field1 in (a.field1, a.field2) or p.field2 in (a.field1, a.field2)))
select person_id, peer_id, cast(position as int) as position from pairs where position <= 8""")
def field_peers(b):
    return tr.field_peers(b.people_core)


@query("era_peers", """with pairs as (
  select a.id as person_id, p.id as peer_id, row_number() over (partition by a.id order by abs(p.birth - a.birth), p.pid) as position
  from people a join people p on p.id <> a.id and p.era = a.era)
select person_id, peer_id, cast(position as int) as position from pairs where position <= 8""")
def era_peers(b):
    return tr.era_peers(b.people_core)


@query("contemporaries", """with lives as (select id, pid, birth, coalesce(death, 2026) as death from people),
pairs as (
  select a.id as person_id, p.id as peer_id, least(a.death, p.death) - greatest(a.birth, p.birth) as overlap, p.pid
  from lives a join lives p on p.id <> a.id and least(a.death, p.death) - greatest(a.birth, p.birth) > 20),
ranked as (select *, row_number() over (partition by person_id order by overlap desc, pid) as position from pairs)
select person_id, peer_id, overlap, cast(position as int) as position from ranked where position <= 8""")
def contemporaries(b):
    return tr.contemporaries(b.people_core)


@query("visible_arcs", f"""
select e.id, cast(floor((s.birth + coalesce(s.death, 2024)) / 2) as bigint) as source_year, cast(floor((t.birth + coalesce(t.death, 2024)) / 2) as bigint) as target_year
from edges e join people s on s.id = e.source join people t on t.id = e.target where e.source = {HUB} or e.target = {HUB}""")
def visible_arcs(b):
    return tr.visible_arcs(b.edges, b.people_core, hub(b)).select(
        "id", "source_year", "target_year")
