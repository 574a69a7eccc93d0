"""Edge validation and evidence policy over the bound tables."""

from pyspark.sql import functions as F

from evigraph.functions import vocab
from evigraph.operators import edge_validation as ev
from evigraph.operators import evidence_policy as policy
from evigraph.plans.catalog import query


def _list(values):
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


STRUCTURE = f"""
edge_stats as (
  select *, count(*) over (partition by source, target, type) as n_same,
         (select count(*) from edges r where r.source = e.target and r.target = e.source and r.type = e.type) as n_reverse
  from edge_flags e),
structured as (
  select e.*, s.id is null as no_source, t.id is null as no_target, e.source = e.target as self_link,
         coalesce(e.type not in {_list(vocab.NON_DIRECTIONAL)} and s.birth > t.birth + 20, false) as impossible,
         n_same > 1 as dup_same, source <> target and n_reverse > 0 as dup_opposite,
         e.type not in {_list(vocab.VALID_RELATIONSHIPS)} as bad_type
  from edge_stats e left join people s on s.id = e.source left join people t on t.id = e.target),
checked as (
  select *, array_to_string(list_filter([
           case when no_source then 'missing-source' end, case when no_target then 'missing-target' end,
           case when self_link then 'self-link' end, case when impossible then 'impossible-chronology' end,
           case when dup_same then 'duplicate-same-direction' end,
           case when dup_opposite then 'duplicate-opposite-direction' end,
           case when bad_type then 'invalid-relationship-type' end], lambda x: x is not null), '|') as blocking
  from structured)"""

EVIDENCE = STRUCTURE + """,
refs as (
  select eid, unnest(claim_ids) as cid, unnest(range(len(claim_ids))) as pos from edges where claim_ids is not null),
support as (
  select r.eid, count(c.id) as n_attached,
         count(*) filter (where c.subject_type = 'Relationship') as n_direct,
         count(*) filter (where c.subject_type = 'Relationship' and c.status not in ('rejected','stale','conflicting')) as n_usable,
         count(*) filter (where c.recency > 3650 or c.status = 'stale') as n_stale,
         count(*) filter (where c.status in ('rejected','conflicting')) as n_refuted,
         string_agg(coalesce(c.field || ' ' || c.value || ' ' || c.source_name, ''), ' ' order by r.pos) as claim_text
  from refs r left join claim_ages c on c.id = r.cid group by 1),
weighed as (
  select k.*, coalesce(n_attached, 0) as n_attached, coalesce(n_direct, 0) as n_direct, coalesce(n_usable, 0) as n_usable,
         coalesce(n_stale, 0) as n_stale, coalesce(n_refuted, 0) as n_refuted,
         coalesce(len(claim_ids), 0) as n_claims, coalesce(len(source_claims), 0) as n_urls,
         coalesce(conf100, 50) as c100, coalesce(len(thread_ids), 0) > 0 as in_thread,
         coalesce(status = 'accepted', false) as is_accepted,
         lower(coalesce(note, '') || ' ' || coalesce(array_to_string(source_claims, ' '), '') || ' ' || coalesce(claim_text, '')) as evidence_text
  from checked k left join support s on s.eid = k.eid),
judged as (
  select *, n_claims + n_urls as n_refs,
         (is_accepted or strength >= 4 or in_thread) and c100 < 75 as weak,
         case when n_claims + n_urls = 0 then 0
              else ((n_usable + n_urls) * 2000 + n_claims + n_urls) // (2 * (n_claims + n_urls)) end as coverage
  from weighed),
found as (
  select *, list_filter([
           case when n_refs = 0 then 'missing-source-evidence' end,
           case when n_stale > 0 then 'stale-source-claim' end,
           case when is_accepted and n_refuted > 0 then 'rejected-or-conflicting-claim-on-accepted-edge' end,
           case when weak then 'weak-confidence-high-impact-edge' end,
           case when n_attached > 0 and n_direct = 0 then 'endpoint-only-source-claims' end], lambda x: x is not null) as reasons,
         case when n_refuted > 0 then 'conflicting' when weak then 'weak' when coverage > 0 then 'supported' else 'unsupported' end as ev_status,
         least(1000, (c100 * 10 + coverage + 1) // 2) as score
  from judged),
ruled as (
  select *, list_filter([
           case when type in ('Influence','person influenced person') and not regexp_matches(evidence_text, 'explicit|influence|influenced|citation|reception|named mention|mentor|advisor|student') then 'direct-influence-needs-transmission-evidence' end,
           case when type = 'Mentorship' and not regexp_matches(evidence_text, 'mentor|mentored|advisor|student|supervisor|tutor') then 'mentorship-needs-advisor-student-evidence' end,
           case when type = 'Collaboration' and not regexp_matches(evidence_text, 'collaborat|coauthor|co-author|correspondence|jointly|worked with') then 'collaboration-needs-shared-work-evidence' end,
           case when in_thread and (c100 < 85 or n_refs = 0) then 'canonical-thread-edge-needs-high-confidence-source-support' end], lambda x: x is not null) as broken
  from found),
verdicts as (
  select eid, id, source, target, type, blocking, blocking = '' as valid,
         case when blocking <> '' then 'unsupported' when len(broken) > 0 and ev_status <> 'conflicting' then 'weak' else ev_status end as evidence_status,
         case when blocking <> '' then 0 else coverage end as coverage,
         case when blocking <> '' then c100 * 10 else score end as score,
         case when blocking <> '' then blocking else array_to_string(list_concat(reasons, broken), '|') end as blocking_reasons,
         case when blocking <> '' then 'removed-existing-edge'
              when ev_status = 'supported' and len(reasons) = 0 and len(broken) = 0 then 'confirmed-existing-edge' end as final_disposition
  from ruled)"""

LANES = EVIDENCE + """,
laned as (
  select *, case when final_disposition is not null then final_disposition
                 when evidence_status = 'conflicting' or blocking_reasons like '%conflict%' then 'auto-resolving-conflict'
                 else 'auto-investigating-missing-source' end as lane
  from verdicts)"""


@query("edge_structure", f"""with {STRUCTURE}
select id, source, target, type, case when blocking = '' then 'valid' else 'invalid' end as structural_status,
       case when impossible then 'impossible' else 'valid' end as chronology_status,
       coalesce(conf100, 50) / 100.0::double as confidence_score, blocking as blocking_reasons
from checked""")
def edge_structure(b):
    return ev.structure(b.people_core, b.edges).select(
        "id", "source", "target", "type", "structural_status", "chronology_status",
        "confidence_score", F.array_join("blocking_reasons", "|").alias("blocking_reasons"))


@query("edge_structure_report", f"""with {STRUCTURE}
select code, count(*) as edges from (
  select unnest(string_split(case when blocking = '' then 'valid' else blocking end, '|')) as code from checked) group by code""")
def edge_structure_report(b):
    checked = ev.structure(b.people_core, b.edges)
    codes = F.when(F.size("blocking_reasons") == 0, ev.strings("valid")).otherwise(
        F.col("blocking_reasons"))
    return checked.select(F.explode(codes).alias("code")).groupBy("code").agg(
        F.count(F.lit(1)).alias("edges"))


@query("edge_evidence", f"""with {EVIDENCE}
select id, case when blocking <> '' then 'unsupported' else ev_status end as evidence_status,
       (case when blocking <> '' then 0 else coverage end) / 1000.0::double as source_claim_coverage,
       (case when blocking <> '' then c100 * 10 else score end) / 1000.0::double as confidence_score,
       case when blocking <> '' then blocking else array_to_string(reasons, '|') end as blocking_reasons,
       case when blocking <> '' then 'removed-existing-edge' when ev_status = 'supported' and len(reasons) = 0 then 'confirmed-existing-edge' end as final_disposition
from found""")
def edge_evidence(b):
    return _flat(ev.evidence(b.people_core, b.edges, b.claims, b.now))


def _flat(results):
    return results.select(
        "id", "evidence_status", "source_claim_coverage", "confidence_score",
        F.array_join("blocking_reasons", "|").alias("blocking_reasons"), "final_disposition")


def _ruled(b):
    return ev.relationship_rules(b.people_core, b.edges, b.claims, b.now)


@query("edge_rules", f"""with {EVIDENCE}
select id, evidence_status, coverage / 1000.0::double as source_claim_coverage, score / 1000.0::double as confidence_score,
       blocking_reasons, final_disposition from verdicts""")
def edge_rules(b):
    return _flat(_ruled(b))


@query("edge_report", f"with {LANES} select lane, count(*) as results from laned group by lane")
def edge_report(b):
    return ev.report_summary(_ruled(b))


@query("repair_decisions", f"""with {LANES}
select case lane when 'removed-existing-edge' then 'repair:remove:' when 'auto-investigating-missing-source' then 'repair:investigate:'
            else 'repair:conflict:' end || id as decision_id,
       case lane when 'removed-existing-edge' then 'remove-edge' when 'auto-investigating-missing-source' then 'auto-investigate-source'
            else 'auto-resolve-conflict' end as action,
       coalesce(nullif(replace(blocking_reasons, '|', '; '), ''),
                case lane when 'auto-investigating-missing-source' then 'Acquire stronger source evidence before final disposition.'
                     else 'Resolve conflicting evidence before final disposition.' end) as reason
from laned where lane <> 'confirmed-existing-edge'""")
def repair_decisions(b):
    return ev.repair_decisions(_ruled(b)).select("decision_id", "action", "reason")


@query("edge_gate", f"""with {EVIDENCE}
select count(*) = 0 as passed, count(*) as unresolved,
       case when count(*) = 0 then 'Bulk edge validation acceptance gate passed.'
            else 'Bulk edge validation acceptance gate failed for ' || cast(count(*) as varchar) || ' unresolved result(s).' end as message
from verdicts where final_disposition is null""")
def edge_gate(b):
    return ev.acceptance_gate(_ruled(b))


@query("source_gaps", """
select e.id from edges e where e.id not in (
  select subject_id from claims where subject_type = 'Relationship' and status not in ('rejected', 'stale'))""")
def source_gaps(b):
    return ev.source_gaps(b.edges, b.claims).select("id")


@query("relationship_source_gaps", """
select distinct 'relationship:person:' || source || ':' || type || ':person:' || target as id from edges
where 'relationship:person:' || source || ':' || type || ':person:' || target not in (
  select subject_id from claims where subject_type = 'Relationship' and status not in ('rejected', 'stale'))""")
def relationship_source_gaps(b):
    person = F.lit("person:")
    keyed = b.edges.select(F.concat_ws(
        ":", F.lit("relationship"), F.concat(person, "source"), "type",
        F.concat(person, "target")).alias("id")).distinct()
    return ev.source_gaps(keyed, b.claims)


@query("refined_edge_types", """with texts as (
  select id, type, lower(type || ' ' || coalesce(note, '')) as t from edges),
refined as (
  select id, type, case when regexp_matches(t, 'mentor|advisor|supervisor|student|tutor|succeeded as head|direct .*teacher') then 'Mentorship'
    when regexp_matches(t, 'collaborat|co-created|co-developed|co-authored|correspondence|friendship|rivalry|worked with') then 'Collaboration'
    when regexp_matches(t, 'parallel|independent|concurrent|rival school|contrast|challenged') then 'Parallel development'
    when regexp_matches(t, 'context|transmission|translation|translated|preserved|revived|precursor|anticipated|thread bridge|maps to|fed ') then 'Source-context neighbor'
    else 'Influence' end as refined_type from texts)
select id, refined_type, type in ('Influence','Indirect influence','Recorded influence','Parallel') and refined_type <> 'Influence' and refined_type <> type as is_candidate
from refined""")
def refined_edge_types(b):
    return b.edges.select("id", ev.refined_type(F.col("type"), F.col("note")).alias("refined_type"),
                          ev.is_refinement_candidate().alias("is_candidate"))


@query("claim_rollup", """
select subject_type, subject_id, count(*) as claims,
       count(*) filter (where status = 'observed') as n_observed, count(*) filter (where status = 'candidate') as n_candidate,
       count(*) filter (where status = 'accepted') as n_accepted, count(*) filter (where status = 'rejected') as n_rejected,
       count(*) filter (where status = 'stale') as n_stale, count(*) filter (where status = 'conflicting') as n_conflicting,
       sum(conf100) / (100.0::double * count(*)) as average_confidence
from claims group by 1, 2""")
def claim_rollup(b):
    return policy.claim_rollup(b.claims)


@query("claim_recency", "select id, cast(recency as bigint) as recency_days from claim_ages")
def claim_recency(b):
    return policy.claim_recency(b.claims, b.now).select("id", "recency_days")


def _component():
    """Components derived from the claim's own scores."""
    return {
        "identity": F.col("confidence"), "factual": F.col("source_reliability"),
        "relationship": F.when(F.col("subject_type") == "Relationship", F.col("confidence")),
        "source_quality": F.col("source_reliability"),
        "extraction": F.when(F.col("source_url").isNotNull(), 1.5),
    }


def _scored_claims(b):
    ordinal = F.col("ord")
    kinds = sorted(vocab.ACCEPTANCE_HUNDREDTHS)
    kind = F.array(*[F.lit(k) for k in kinds])[(ordinal % 7).cast("int")]
    claims = b.claims.withColumns({
        "claim_type": kind, "is_direct": ordinal % 2 == 0, "in_thread": ordinal % 3 == 0,
        "crosses": ordinal % 5 == 0, "high_bridge": ordinal % 11 == 0, "sparse": ordinal % 13 == 0,
        "basic": ordinal % 4 == 0, "stable_id": ordinal % 6 == 0, "work_id": ordinal % 9 == 0,
        "direct_source": ordinal % 10 == 0})
    scored = claims.withColumn("score", policy.composed_confidence(_component()))
    strict = policy.thresholds(F.col("claim_type"), strict={
        "direct_influence": "is_direct", "canonical_thread_edge": "in_thread",
        "cross_century_jump": "crosses", "high_bridge_score_node": "high_bridge",
        "disputed_or_sparse_topic": "sparse"})
    loose = policy.thresholds(F.col("claim_type"), loose={
        "basic_metadata": "basic", "stable_external_id": "stable_id",
        "work_stable_identifier": "work_id", "direct_institution_source": "direct_source"})
    return scored.withColumns({
        "accept": strict[0], "provisional": strict[1], "loose_accept": loose[0],
        "loose_provisional": loose[1]})


POLICY = """
scored as (
  select c.*, ['basic_metadata','direct_influence','external_id','identity','institution_affiliation','relationship','work_metadata'][event_id % 7 + 1] as claim_type,
    (conf100 * 1000 * 20 + reliability10 * 10000 * 20 + case when subject_type = 'Relationship' then conf100 * 1000 else 50000 end * 20
     + reliability10 * 10000 * 15 + case when source_url is not null then 100000 else 50000 end * 10 + 50000 * 15 + 5000) // 10000 as score1000,
    case when event_id % 2 = 0 then 50 else 0 end + case when event_id % 3 = 0 then 40 else 0 end + case when event_id % 5 = 0 then 40 else 0 end
      + case when event_id % 11 = 0 then 30 else 0 end + case when event_id % 13 = 0 then 40 else 0 end as up,
    case when event_id % 4 = 0 then 40 else 0 end + case when event_id % 6 = 0 then 60 else 0 end + case when event_id % 9 = 0 then 50 else 0 end
      + case when event_id % 10 = 0 then 40 else 0 end as down
  from claims c),
limits as (
  select *, case claim_type when 'identity' then 900 when 'basic_metadata' then 750 when 'external_id' then 700 when 'work_metadata' then 750
                 when 'institution_affiliation' then 800 when 'direct_influence' then 920 else 850 end as a0,
            case claim_type when 'identity' then 700 when 'basic_metadata' then 550 when 'external_id' then 500 when 'work_metadata' then 550
                 when 'institution_affiliation' then 600 when 'direct_influence' then 750 else 650 end as p0
  from scored),
bounded as (
  select *, least(990, a0 + up) as accept, least(950, p0 + up // 2) as provisional,
         greatest(500, a0 - down) as loose_accept, greatest(350, p0 - down // 2) as loose_provisional
  from limits)"""


@query("policy_scores", f"""with {POLICY}
select id, claim_type, score1000 / 1000.0::double as score, accept / 1000.0::double as accept, provisional / 1000.0::double as provisional,
       loose_accept / 1000.0::double as loose_accept, loose_provisional / 1000.0::double as loose_provisional from bounded""")
def policy_scores(b):
    return _scored_claims(b).select("id", "claim_type", "score", "accept", "provisional",
                                    "loose_accept", "loose_provisional")


@query("policy_decisions", f"""with {POLICY},
rejections as (
  select b.*, array_to_string(list_filter([
     case when event_id % 17 = 0 then 'self-link' end,
     case when 1500 + event_id % 90 > 1500 + event_id % 70 + 20 then 'impossible-chronology' end,
     case when event_id % 19 = 0 then 'duplicate-opposite-direction' end,
     case when event_id % 2 = 0 and not (event_id % 3 = 0) then 'unsupported-direct-influence-from-shared-tags' end], lambda x: x is not null), '|') as rejection_reasons
  from bounded b)
select id, rejection_reasons,
       case when rejection_reasons <> '' then 'rejected' when score1000 >= accept then 'accepted' when score1000 >= provisional then 'provisional' else 'rejected' end as decision,
       case when rejection_reasons = '' and score1000 >= accept then accept / 1000.0::double end as applied_threshold
from rejections""")
def policy_decisions(b):
    ordinal = F.col("ord")
    evidence = F.when(ordinal % 3 == 0, ev.strings("shared movement", "explicit claim")).otherwise(
        ev.strings("Shared institution", "shared era"))
    rejections = policy.rejection_reasons(
        F.lit("a"), F.when(ordinal % 17 == 0, "a").otherwise("b"),
        F.when(ordinal % 2 == 0, "person influenced person").otherwise("Influence"),
        1500 + ordinal % 90, 1500 + ordinal % 70, ordinal % 19 == 0, evidence)
    decided = policy.decide(_scored_claims(b).withColumn("rejection_reasons", rejections),
                            "default", b.now)
    return decided.select(
        "id", F.array_join("rejection_reasons", "|").alias("rejection_reasons"), "decision",
        F.col("policy_metadata.threshold").alias("applied_threshold"))


@query("adapter_runs", """with runs as (
  select cast(user_id as varchar) as adapter_id,
         case event_type when 'error' then 'failed' when 'signup' then 'held' when 'view' then 'running' else 'completed' end as status,
         strftime(ts, '%Y-%m-%d %H:%M:%S') as run_at, case when event_id % 2 = 0 then 'timeout' end as error_message from events)
select count(*) as total_runs, count(*) filter (where status = 'completed') as completed_runs,
       count(*) filter (where status = 'failed') as failed_runs, count(*) filter (where status = 'held') as held_runs,
       max(run_at) as latest_run_at,
       count(*) filter (where status = 'failed' and error_message is not null) as errors from runs""")
def adapter_runs(b):
    status = (F.when(F.col("event_type") == "error", "failed")
              .when(F.col("event_type") == "signup", "held")
              .when(F.col("event_type") == "view", "running").otherwise("completed"))
    runs = b.table("events").select(
        F.col("user_id").cast("string").alias("adapter_id"),
        F.concat(F.lit("Adapter "), F.col("user_id").cast("string")).alias("adapter_name"),
        status.alias("status"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("run_at"),
        F.when(F.col("event_id") % 2 == 0, "timeout").alias("error_message"))
    return policy.adapter_run_summary(runs)
