"""Canonical build, merges and changelog over the bound tables."""

from pyspark.sql import functions as F

from evigraph.operators import canonical as cn
from evigraph.operators import edge_validation as ev
from evigraph.operators import missing_edges as me
from evigraph.plans.catalog import query
from evigraph.plans.discovery_queries import NON_DIRECTIONAL


def _previous_claims(b):
    n = F.col("ord")
    status = (F.when(n % 8 == 1, "accepted").when(n % 8 == 2, "candidate")
              .otherwise(F.col("status")))
    return b.claims.filter(n % 10 != 0).withColumns({
        "status": status, "value": F.when(n % 9 == 0, "old").otherwise(F.col("value"))})


@query("claim_changelog", """with prev as (
  select id, case when event_id % 8 = 1 then 'accepted' when event_id % 8 = 2 then 'candidate' else status end as was, event_id % 9 = 0 as edited from claims where event_id % 10 <> 0),
ranks(s, r) as (values ('accepted', 5), ('candidate', 4), ('observed', 3), ('stale', 2), ('conflicting', 1), ('rejected', 0)),
joined as (select c.id as claim_id, c.status as current_status, p.was as previous_status, p.id is null as fresh, p.edited, a.r as nr, w.r as wr
  from claims c left join prev p on p.id = c.id join ranks a on a.s = c.status left join ranks w on w.s = p.was)
select * from (select claim_id, previous_status, current_status, case when fresh then 'added' when current_status = 'conflicting' and previous_status <> 'conflicting' then 'conflicting'
   when current_status = 'rejected' and previous_status <> 'rejected' then 'rejected' when nr < wr then 'demoted' when edited or current_status <> previous_status then 'changed' end as change from joined)
where change is not null""")
def claim_changelog(b):
    return cn.claim_changelog(_previous_claims(b), b.claims).select(
        "claim_id", "previous_status", "current_status", "change")


def _patches(b):
    """Repair patches: updates of existing edges, adds of new ones, later overlays."""
    n = F.col("ord")
    order = lambda p: F.concat(F.lit(p), F.lpad((n % 1000).cast("string"), 4, "0"))
    raise_it = b.edges.filter(n % 13 == 0).withColumns({
        "decision_id": order("d1-"), "action": F.lit("update-edge"),
        "confidence": F.lit(0.99), "status": F.lit(None).cast("string")})
    accept = b.edges.filter(n % 26 == 0).withColumns({
        "decision_id": order("d2-"), "action": F.lit("update-edge"),
        "confidence": F.lit(None).cast("double"), "status": F.lit("accepted")})
    fresh = b.edges.filter(n % 17 == 0).withColumns({
        "id": F.concat(F.lit("new-"), "id"), "decision_id": order("d3-"),
        "action": F.lit("add-edge"), "ord": n + 10000000000000})
    later = fresh.filter(n % 2 == 0).withColumns({
        "decision_id": order("d4-"), "action": F.lit("update-edge"), "confidence": F.lit(0.01),
        "status": F.lit(None).cast("string")})
    early = fresh.withColumns({"decision_id": order("d0-"), "action": F.lit("update-edge"),
                               "confidence": F.lit(0.77)})
    refused = fresh.withColumns({"id": F.concat(F.lit("no-"), "id"), "accepted": F.lit(False)})
    union = raise_it.unionByName(accept).unionByName(fresh).unionByName(later).unionByName(early)
    return union.withColumn("accepted", F.lit(True)).unionByName(refused).withColumn(
        "diff", F.lit(0))


REPAIRED = """
repaired as (
  select id, source, target, case when eid % 13 = 0 then 99 else conf100 end as c100, case when eid % 26 = 0 then 'accepted' else status end as status from edges
  union all select 'new-' || id, source, target, case when eid % 2 = 0 then 1 else conf100 end, status from edges where eid % 17 = 0)"""


@query("apply_repairs", f"with {REPAIRED} select id, c100 / 100.0::double as confidence, status from repaired")
def apply_repairs(b):
    return cn.apply_repairs(b.edges, _patches(b)).select("id", "confidence", "status")


@query("canonical_manifest", f"""with {REPAIRED}
select 'people' as "table", count(*) as rows, cast(sum(cast('0x' || substr(md5(id), 1, 8) as bigint) % 1000003) as bigint) as fingerprint from people
union all select 'edges', count(*), cast(sum(cast('0x' || substr(md5(id || '|' || source || '|' || target), 1, 8) as bigint) % 1000003) as bigint) from repaired
union all select 'claims', count(*), cast(sum(cast('0x' || substr(md5(id || '|' || status), 1, 8) as bigint) % 1000003) as bigint) from claims
union all select 'manual_overrides', count(*), cast(sum(cast('0x' || substr(md5(id), 1, 8) as bigint) % 1000003) as bigint) from candidates""")
def canonical_manifest(b):
    return cn.build(b.people_core, b.edges, b.claims, _patches(b), b.candidates)["manifest"]


def _two_states(b):
    n = F.col("ord")
    stored = b.people.filter(n % 4 != 0)
    canonical = b.people.filter(n % 6 != 0).withColumns({
        "name": F.concat("name", F.lit(" canonical")), "works": F.array(F.lit("Canon")),
        "notes": F.lit(None).cast("string")})
    retired = b.people_core.filter(n % 50 == 0).select("id")
    return stored, canonical, retired


@query("merge_people", """
select p.id, case when pid % 4 <> 0 and pid % 50 <> 0 then (case when imported and pid % 6 <> 0 then name || ' canonical' else name end) else name || ' canonical' end as name,
  case when pid % 4 <> 0 and pid % 50 <> 0 then (select count(*) from person_works w where w.id = p.id) + case when imported and pid % 6 <> 0 then 1 else 0 end else 1 end as works,
  case when pid % 4 <> 0 and pid % 50 <> 0 then case when pid % 17 = 0 then null else notes end end as notes
from (select *, coalesce(movement = 'Imported', false) or coalesce(notes like '%Imported from Wikidata%', false) as imported from people) p
where (pid % 4 <> 0 and pid % 50 <> 0) or pid % 6 <> 0""")
def merge_people(b):
    return cn.merge_people(*_two_states(b)).select(
        "id", "name", F.size("works").cast("long").alias("works"), "notes")


@query("merge_edges", """with
inside as (select * from edge_flags where source in (select id from people) and target in (select id from people)),
mine as (
  select source, target, type, max_by(id, eid) as id, max_by(conf100, eid) filter (where true) as c0, max(eid) as eid from inside
  where eid % 3 <> 0 and cast(source as bigint) % 50 <> 0 and cast(target as bigint) % 50 <> 0 group by 1, 2, 3),
mine_rows as (select i.* from inside i join mine m on m.eid = i.eid),
seed as (select source, target, type, max(eid) as eid, max(conf100) as best, bool_or(coalesce(status, case when not has_evidence then 'needs_source' when coalesce(conf100, 0) >= 75 then 'accepted' else 'suggested' end) = 'accepted') as acc
  from inside where eid % 5 <> 0 group by 1, 2, 3),
seed_lists as (
  select source, target, type, list(distinct u) filter (where u is not null) as urls, list(distinct c) filter (where c is not null) as cids from (
    select source, target, type, unnest(source_claims) as u, null as c from inside where eid % 5 <> 0
    union all select source, target, type, null, unnest(claim_ids) from inside where eid % 5 <> 0) group by 1, 2, 3),
fixed as (select *, coalesce(status, case when not has_evidence then 'needs_source' when coalesce(conf100, 0) >= 75 then 'accepted' else 'suggested' end) as st from mine_rows),
seed_rows as (select i.*, coalesce(status, case when not has_evidence then 'needs_source' when coalesce(conf100, 0) >= 75 then 'accepted' else 'suggested' end) as st from inside i join seed s on s.eid = i.eid),
joined as (
  select coalesce(a.id, b.id) as id, a.eid is not null and b.eid is not null as paired,
    case when a.eid is not null and b.eid is not null then nullif(greatest(coalesce(a.conf100, 0), coalesce(s.best, 0)), 0) when a.eid is not null then a.conf100 else b.conf100 end as c100,
    a.st as ast, b.st as bst, s.acc,
    len(list_distinct(list_concat(coalesce(a.source_claims, case when a.eid is null then b.source_claims end, []), case when a.eid is not null and b.eid is not null then coalesce(l.urls, []) else [] end))) as urls,
    len(list_distinct(list_concat(coalesce(a.claim_ids, case when a.eid is null then b.claim_ids end, []), case when a.eid is not null and b.eid is not null then coalesce(l.cids, []) else [] end))) as cids
  from fixed a full join seed_rows b on b.source = a.source and b.target = a.target and b.type = a.type
  left join seed s on s.source = b.source and s.target = b.target and s.type = b.type
  left join seed_lists l on l.source = b.source and l.target = b.target and l.type = b.type),
final as (select id, c100 / 100.0::double as confidence, urls, cids,
   case when not paired then coalesce(ast, bst) when ast = 'rejected' then 'rejected' when acc or ast = 'accepted' then 'accepted' else ast end as status from joined)
select * from final where status <> 'accepted' or urls + cids > 0""")
def merge_edges(b):
    n = F.col("ord")
    retired = b.people_core.filter(n % 50 == 0).select("id")
    merged = cn.merge_edges(b.edges.filter(n % 3 != 0), b.edges.filter(n % 5 != 0),
                            b.people_core, retired)
    return merged.select("id", "confidence", F.size("source_claims").cast("long").alias("urls"),
                         F.size("claim_ids").cast("long").alias("cids"), "status")


@query("promote_edges", f"""with found as (
  select * from edges where eid % 3 = 0 union all select * replace ('candidate:' || id as id, type || ' x' as type) from edges where eid % 5 = 0),
keys as (select type, case when type in {NON_DIRECTIONAL} then least(source, target) else source end as a, case when type in {NON_DIRECTIONAL} then greatest(source, target) else target end as b from edges)
select id, status, note from edges
union all
select replace(f.id, 'candidate:', 'edge:'), 'accepted', concat_ws(' ', note, 'Added by bulk edge validation.') from found f
where not exists (select 1 from keys k where k.type = f.type and k.a = (case when f.type in {NON_DIRECTIONAL} then least(f.source, f.target) else f.source end)
  and k.b = (case when f.type in {NON_DIRECTIONAL} then greatest(f.source, f.target) else f.target end))""")
def promote_edges(b):
    n = F.col("ord")
    found = b.edges.filter(n % 3 == 0).unionByName(b.edges.filter(n % 5 == 0).withColumns({
        "id": F.concat(F.lit("candidate:"), "id"), "type": F.concat("type", F.lit(" x"))}))
    results = found.withColumns({"origin": F.lit("discovered-candidate"),
                                 "final_disposition": F.lit("added-confirmed-edge")})
    return ev.promote(b.edges, results).select("id", "status", "note")


@query("candidate_dedupe", f"""with rows_ as (
  select type, source, target, case when type in {NON_DIRECTIONAL} then least(source, target) else source end as a,
    case when type in {NON_DIRECTIONAL} then greatest(source, target) else target end as b, coalesce(conf100, 50) * 10 as x, eid from edges where eid % 2 = 0),
taken as (select distinct type, case when type in {NON_DIRECTIONAL} then least(source, target) else source end as a,
    case when type in {NON_DIRECTIONAL} then greatest(source, target) else target end as b from edges where eid % 2 = 1 and eid % 3 = 0)
select r.type, min_by(source, eid) as source, min_by(target, eid) as target, count(*) as evidence,
  list_reduce(list(x order by eid), lambda acc, v: least(980, greatest(acc, v) + 30)) / 1000.0::double as confidence
from rows_ r anti join taken t on t.type = r.type and t.a = r.a and t.b = r.b group by r.type, r.a, r.b""")
def candidate_dedupe(b):
    n = F.col("ord")
    return me.deduplicate(b.edges.filter(n % 2 == 0),
                          b.edges.filter((n % 2 == 1) & (n % 3 == 0))).select(
        "type", "source", "target", "evidence", "confidence")
