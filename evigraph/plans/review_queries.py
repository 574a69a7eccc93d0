"""The import review queue after a run of events over the bound tables."""

from pyspark.sql import functions as F

from evigraph.functions import text as tx
from evigraph.operators import import_review as ir
from evigraph.operators import suggestions as sg
from evigraph.plans.catalog import query, sql_of
from evigraph.plans.exploration_queries import matched_candidates


def _events(b):
    """Every event decides something about the candidate of its user, or clears the queue."""
    n = F.col("event_id")
    known = b.people_core.groupBy(tx.name_key(F.col("name")).alias("key")).agg(
        F.min_by("id", "ord").alias("duplicate_id"))
    doubles = b.candidates.select(F.col("id").alias("candidate_id"), tx.name_key(F.col("name"))
                                  .alias("key")).join(known, "key").drop("key")
    kind = (F.when(n % 997 == 996, "clear_all").when(n % 499 == 1, "clear_low")
            .when(n % 601 == 2, "clear_duplicates").when(n % 7 < 4, "queue")
            .when(n % 7 == 4, "accept").when(n % 7 == 5, "skip").otherwise("merge"))
    return b.table("events").select(
        n.alias("ord"), kind.alias("kind"), F.concat(F.lit("q"), F.col("user_id").cast("string"))
        .alias("candidate_id"), (n % 101).cast("int").alias("confidence"),
        (n % 60).cast("int").alias("threshold")).join(doubles, "candidate_id", "left")


def _folded(b):
    return ir.review_fold(_events(b), b.candidates, b.people_core)


NAME_KEY = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"


def _chain(number: int, removals: str) -> str:
    """Entries that count, with their ends: the first of a candidate, then those after an end."""
    n = number
    return f"""
own{n} as (select q.id, q.ord, min(r.ord) as ended from q join {removals} r on r.id = q.id and r.ord > q.ord group by 1, 2),
swept{n} as (select q.id, q.ord, min(s.ord) as ended from q join sweeps s on s.ord > q.ord
  and (s.kind = 'clear_all' or (s.kind = 'clear_duplicates' and q.dup is not null) or (s.kind = 'clear_low' and q.level < s.threshold)) group by 1, 2),
ends{n} as (select q.*, least(o.ended, s.ended) as ended from q left join own{n} o using (id, ord) left join swept{n} s using (id, ord)),
onward{n} as (select e.id, e.ord, min(q.ord) as next from ends{n} e join q on q.id = e.id and q.ord > e.ended group by 1, 2),
chain{n} as (select id, min(ord) as ord from q group by id union all
  select c.id, o.next from chain{n} c join onward{n} o on o.id = c.id and o.ord = c.ord),
entries{n} as (select e.* from ends{n} e join chain{n} c on c.id = e.id and c.ord = e.ord)"""


FOLD = f"""recursive ppl as (select {NAME_KEY.format('name')} as nk, min(pid) as pid from people group by 1),
cand as (select c.id, c.name, c.birth, coalesce(c.wikipedia_url, c.source_url) as url, {NAME_KEY.format('c.name')} as nk, p.pid as dup
  from candidates c left join ppl p on p.nk = {NAME_KEY.format('c.name')}),
ev as (select event_id as ord, 'q' || cast(user_id as varchar) as id, event_id % 101 as level, event_id % 60 as threshold,
  case when event_id % 997 = 996 then 'clear_all' when event_id % 499 = 1 then 'clear_low' when event_id % 601 = 2 then 'clear_duplicates'
       when event_id % 7 < 4 then 'queue' when event_id % 7 = 4 then 'accept' when event_id % 7 = 5 then 'skip' else 'merge' end as kind from events),
sweeps as (select * from ev where kind like 'clear%'),
mine as (select ev.*, cand.dup, cand.nk, cand.birth from ev join cand using (id)),
q as (select id, ord, level, dup from mine where kind = 'queue'),
taken as (select id, ord, kind from mine where kind in ('skip', 'merge')),
{_chain(1, 'taken')},
accepted as (select min_by(a.id, a.ord) as id, min(a.ord) as ord from mine a join entries1 e on e.id = a.id and e.ord < a.ord and (e.ended is null or e.ended > a.ord)
  where a.kind = 'accept' and a.birth is not null and a.nk not in (select nk from ppl) group by a.nk),
removed as (select * from taken union all select id, ord, 'accept' from accepted),
{_chain(2, 'removed')}"""


@query("import_review_queue", f"""with {FOLD}
select e.ord, e.id as candidate_id, c.name as candidate_name, cast(e.level as int) as confidence, cast(e.dup as varchar) as duplicate_id,
  case when e.dup is null then 'queued' else 'duplicate' end as status from entries2 e join cand c on c.id = e.id where e.ended is null""")
def import_review_queue(b):
    return _folded(b)["queue"]


@query("import_review_audit", f"""with {FOLD},
ending as (select ord, kind from removed union all select ord, kind from sweeps)
select e.ended as ord, e.id as candidate_id, c.name as candidate_name, cast(e.level as int) as confidence, c.url as source_url,
  case n.kind when 'clear_duplicates' then 'duplicate' when 'skip' then 'skipped' when 'merge' then 'accepted' when 'accept' then 'accepted' else 'skipped' end as status,
  case n.kind when 'skip' then 'Skipped from review queue' when 'merge' then 'Merged duplicate metadata into an existing thinker' when 'accept' then 'Bulk accepted from review queue'
    when 'clear_duplicates' then 'Cleared duplicate candidates' when 'clear_low' then 'Cleared below threshold' else 'Cleared entire review queue' end as reason
from entries2 e join cand c on c.id = e.id join ending n on n.ord = e.ended""")
def import_review_audit(b):
    return _folded(b)["audit"].drop("threshold")


@query("accepted_import_links", f"""with {FOLD}, matches as ({sql_of('candidate_matches')}),
chosen_ends as (select m.category, m.explanation, m.person_id, p.birth as p_birth, c.birth as c_birth, c.url, trim(regexp_replace(lower(c.name), '[^a-z0-9]+', '_', 'g'), '_') as new_id
  from accepted a join cand c on c.id = a.id join matches m on m.candidate_id = a.id and m.position = 1 join people p on p.id = m.person_id)
select case when p_birth <= c_birth then person_id else new_id end as source, case when p_birth <= c_birth then new_id else person_id end as target,
  category as type, 2 as strength, 0.35::double as confidence, 'suggested' as status, 'Imported with suggested context: ' || explanation as context, url as source_url from chosen_ends""")
def accepted_import_links(b):
    """Edges of the accepted, without the list of reasons at the end of their notes."""
    fold = _folded(b)
    accepted = fold["accepted"]
    fold.remove()
    # Nobody else's suggestions become edges.
    best = matched_candidates(b, 1, accepted)
    reasoned = sg.with_reasons(best, b.rich_candidates, b.people)
    new = ir.accepted_people(accepted, b.candidates, b.people_core)
    return ir.accepted_links(new, reasoned, b.candidates, b.people_core).select(
        "source", "target", "type", "strength", "confidence", "status",
        F.substring_index("note", "; ", 1).alias("context"),
        F.element_at("source_claims", 1).alias("source_url"))
