"""Source normalizers over dumps derived from the given tables."""

import uuid

from pyspark.sql import functions as F

from evigraph.functions import taxonomy as tax
from evigraph.functions import text as tx
from evigraph.operators import normalize as nz
from evigraph.plans.catalog import query
from evigraph.plans.model_queries import slug
from evigraph.session import shared_folder
from evigraph.sources import dumps, files, state_store


def _s(value):
    return F.col(value).cast("string") if isinstance(value, str) else value.cast("string")


def _works_dump(b):
    """One work per order: its parts are references, its buyers and suppliers authors."""
    line = b.table("lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set("l_partkey")).alias("parts"),
        F.array_sort(F.collect_set("l_suppkey")).alias("supps"))
    author = lambda v: F.struct(F.struct(
        F.concat(F.lit("https://openalex.org/A"), v.cast("string")).alias("id"),
        F.concat(F.lit("Author "), v.cast("string")).alias("display_name")).alias("author"))
    n = F.col("o_orderkey")
    return b.table("orders").join(line, n == F.col("l_orderkey")).select(
        F.concat(F.lit("https://openalex.org/W"), _s(n)).alias("id"), n.alias("ord"),
        F.when(n % 3 != 0, F.concat(F.lit("Work "), _s(n))).alias("display_name"),
        F.when(n % 2 == 0, F.concat(F.lit("Title "), _s(n))).alias("title"),
        F.year("o_orderdate").alias("publication_year"),
        F.when(n % 4 == 0, F.concat(F.lit("10.1/"), _s(n))).alias("doi"),
        F.transform("parts", lambda p: F.concat(F.lit("https://openalex.org/W"),
                                                p.cast("string"))).alias("referenced_works"),
        F.transform("supps", author).alias("authorships"),
        F.col("o_totalprice").alias("relevance_score"))


NAME = "case when o_orderkey % 3 <> 0 then 'Work ' || cast(o_orderkey as varchar) when o_orderkey % 2 = 0 then 'Title ' || cast(o_orderkey as varchar) else 'W' || cast(o_orderkey as varchar) end"


@query("openalex_works", f"""
select 'work:openalex:' || {slug(NAME)} as id, {NAME} as title, cast(year(o_orderdate) as int) as date, case when o_orderkey % 4 = 0 then 2 else 1 end as n_ids
from orders where o_orderkey in (select l_orderkey from lineitem)""")
def openalex_works(b):
    return dumps.openalex_works(_works_dump(b)).select("id", "title", "date",
                                                       F.size("identifiers").alias("n_ids"))


@query("search_hits", f"""
select 'https://openalex.org/W' || cast(o_orderkey as varchar) as source_id, least(1.0, o_totalprice / 1000.0) as confidence
from orders where o_orderkey in (select l_orderkey from lineitem)""")
def search_hits(b):
    return dumps.search_hits(_works_dump(b)).select("source_id", "confidence")


@query("coauthors", """with a as (select distinct l_orderkey as k, l_suppkey as s from lineitem where l_orderkey in (select o_orderkey from orders)),
pairs as (select x.s as p, y.s as q, max(x.k) as k from a x join a y on x.k = y.k and x.s <> y.s group by 1, 2)
select 'person:a' || cast(p as varchar) as source_id, 'person:a' || cast(q as varchar) as target_id, 'person:a' || cast(p as varchar) || ' collaborated with Author ' || cast(q as varchar) as label,
  'claim:relationship-person-a' || cast(p as varchar) || '-person-collaborated-with-person-person-a' || cast(q as varchar) || ':authorships:openalex:https-openalex-org-w' || cast(k as varchar) as claim_id from pairs""")
def coauthors(b):
    return dumps.coauthors(_works_dump(b)).select("source_id", "target_id", "label", "claim_id")


@query("citations", f"""with refs as (select distinct l_orderkey as k, l_partkey as p from lineitem),
ranked as (select *, row_number() over (partition by k order by p) as rn from refs)
select 'work:openalex:w' || cast(p as varchar) as source_id, 'work:openalex:' || {slug(NAME)} as target_id, cast(rn - 1 as int) as pos from ranked join orders on o_orderkey = k""")
def citations(b):
    return dumps.citations(_works_dump(b)).select("source_id", "target_id", "pos")


def _doi_dump(b):
    n = F.col("p_partkey")
    refs = F.transform(F.sequence(F.lit(1), (n % 5 + 1).cast("int")), lambda i: F.struct(
        F.when(i % 2 == 1, F.concat(F.lit("10.2/"), (n + i).cast("string"))).alias("DOI"),
        F.when(i == 1, F.concat(F.lit("Ref "), n.cast("string"))).alias("article_title")))
    return b.table("part").select(
        F.concat(F.lit("10.9/"), _s(n)).alias("DOI"),
        F.when(n % 3 == 0, F.concat(F.lit("https://x.example.org/"), _s(n))).alias("URL"),
        F.when(n % 4 != 0, F.array(F.concat("p_name", F.lit(" "), _s(n)))).otherwise(
            F.array().cast("array<string>")).alias("title"),
        F.when(n % 5 != 0, F.lit(1900) + F.col("p_size")).alias("issued_year"),
        F.when(n % 2 == 0, F.lit(1800) + F.col("p_size")).alias("published_year"),
        refs.alias("reference"))


DOI_TITLE = "case when p_partkey % 4 <> 0 then p_name || ' ' || cast(p_partkey as varchar) else '10.9/' || cast(p_partkey as varchar) end"
DOI_YEAR = "case when p_partkey % 5 <> 0 then 1900 + p_size when p_partkey % 2 = 0 then 1800 + p_size end"


@query("doi_claims", f"""
select 'work:crossref:' || {slug(DOI_TITLE)} as subject_id, 'title' as field, {DOI_TITLE} as value,
  case when p_partkey % 3 = 0 then 'https://x.example.org/' || cast(p_partkey as varchar) else 'https://doi.org/10.9/' || cast(p_partkey as varchar) end as source_url from part
union all
select 'work:crossref:' || {slug(DOI_TITLE)}, 'date', cast({DOI_YEAR} as varchar),
  case when p_partkey % 3 = 0 then 'https://x.example.org/' || cast(p_partkey as varchar) else 'https://doi.org/10.9/' || cast(p_partkey as varchar) end from part where {DOI_YEAR} is not null""")
def doi_claims(b):
    return dumps.crossref(_doi_dump(b), b.now).claims.select("subject_id", "field", "value",
                                                             "source_url")


@query("doi_references", f"""with r as (select *, unnest(range(1, cast(p_partkey % 5 + 2 as int))) as i from part)
select 'work:crossref:' || case when i = 1 then 'ref-' || cast(p_partkey as varchar) else '10-2-' || cast(p_partkey + i as varchar) end as source_id,
  'work:crossref:' || {slug(DOI_TITLE)} as target_id, cast((i - 1) // 2 as int) as pos from r where i % 2 = 1""")
def doi_references(b):
    return dumps.crossref_references(_doi_dump(b)).select("source_id", "target_id", "pos")


@query("summary_claims", f"""
select 'concept:' || trim(regexp_replace(lower(source || ' ' || cast(doc_id as varchar)), '[^a-z0-9]+', '-', 'g'), '-') as subject_id, text as value, 0.45::double as confidence from documents""")
def summary_claims(b):
    docs = b.table("documents").select(
        F.concat("source", F.lit(" "), _s("doc_id")).alias("title"),
        F.lit(None).cast("string").alias("page_url"), F.col("text").alias("extract"))
    return dumps.summaries(docs, "Concept").select("subject_id", "value", "confidence")


@query("lookup_docs", "select coalesce(url, 'p' || cast(page_id as varchar)) as source_id, case when page_id % 2 = 0 then 'page' else 'asked' end as label, 0.4::double as confidence from pages")
def lookup_docs(b):
    one = lambda c: F.array_compact(F.array(c))
    docs = b.table("pages").select(
        F.concat(F.lit("p"), _s("page_id")).alias("id"),
        F.lit(None).cast("array<string>").alias("resource"), one(F.col("url")).alias("uri"),
        one(F.when(F.col("page_id") % 2 == 0, "page")).alias("label"),
        F.lit(None).cast("array<string>").alias("comment"),
        F.lit(None).cast("array<string>").alias("description"))
    return dumps.lookup_docs(docs, F.lit("asked")).select("source_id", "label", "confidence")


@query("curated_entries", """
select 'e' || cast(doc_id as varchar) as source_id, 'Subject ' || lang as label, case when doc_id % 2 = 0 then 'Person' else 'Concept' end as entity_type,
  case when doc_id % 3 = 0 then 0.85 else 0.75 end::double as confidence from documents where contains(lower(source), 'src1') or contains(lower('Subject ' || lang), 'src1')""")
def curated_entries(b):
    n = F.col("doc_id")
    entries = b.table("documents").select(
        F.concat(F.lit("e"), _s(n)).alias("id"), F.lit("entry").alias("title"),
        F.col("source").alias("source_name"), F.lit("https://c.example.org").alias("source_url"),
        F.when(n % 3 == 0, "primary_text").otherwise("reference").alias("source_type"),
        F.array(F.struct(
            F.lit("person:x").alias("subject_id"), F.lit("Person").alias("subject_type"),
            F.lit("note").alias("field"), F.lit("v").alias("value"),
            F.lit(0.7).alias("confidence"), F.lit("observed").alias("status"))).alias("claims"),
        F.array(F.struct(F.concat(F.lit("Subject "), "lang").alias("label"), F.when(
            n % 2 == 0, "Relationship").otherwise("Concept").alias("entity_type")))
        .alias("subjects"))
    return dumps.curated_entries(entries, "Src1").records.select(
        "source_id", "label", "entity_type", "confidence")


def _registry(b):
    """Registry entities from customers; statements from their evidence links."""
    props = {"advisor": "P184", "student": "P185", "explicit_influence": "P737",
             "institution": "P108", "work": "P800", "concept": "P106"}
    table = F.create_map(*[F.lit(x) for kv in props.items() for x in kv])
    n = F.col("ord")
    pos = F.regexp_extract("value", r"(\d+)$", 1).cast("long") % 9
    links = b.evidence_links.filter(F.col("kind").isin(list(props)))
    statements = links.select(
        F.concat(F.lit("Q"), "person_id").alias("id"), table[F.col("kind")].alias("property"),
        pos.alias("pos"), F.concat(F.lit("Q"), F.regexp_replace("value", "[^0-9]", ""))
        .alias("value_id")).unionByName(b.people_core.filter(n % 6 != 0).select(
            F.concat(F.lit("Q"), "id").alias("id"), F.lit("P31").alias("property"),
            F.lit(0).cast("long").alias("pos"), F.lit("Q5").alias("value_id")))
    year = F.col("birth").cast("string")
    entities = b.people_core.select(
        F.concat(F.lit("Q"), "id").alias("id"), "ord",
        F.when(n % 7 != 0, F.concat(F.lit("Entity "), "id")).alias("label"),
        F.when(n % 4 == 0, "a university of note").when(
            n % 4 == 1, "an English physicist and careful writer").alias("description"),
        F.when(n % 5 != 0, F.concat(F.lit("+"), year, F.lit("-03-14T00:00:00Z"))).when(
            n % 10 == 5, F.concat(F.lit("-0"), F.substring(year, 2, 3), F.lit("-00-00T00:00:00Z")))
        .alias("birth_time"), F.lit(None).cast("string").alias("death_time"),
        F.when(n % 2 == 0, F.concat(F.lit("Entity "), "id")).alias("article"))
    labels = entities.select("id", "label").filter("label is not null")
    return entities, statements, labels


REGISTRY = """
ents as (select id, pid, case when pid % 7 <> 0 then 'Entity ' || id else 'Q' || id end as name,
   case when pid % 4 = 0 then 'a university of note' when pid % 4 = 1 then 'an English physicist and careful writer' else '' end as description,
   case when pid % 5 <> 0 then birth when pid % 10 = 5 then -(birth % 1000) end as birth from people),
works_n as (select person_id as id, count(*) as n from (select person_id, value, cast(regexp_extract(value, '(\\d+)$', 1) as bigint) % 9 as pos from evidence_links where kind = 'work') group by 1),
students_n as (select person_id as id, count(*) as n from (select person_id, cast(regexp_extract(value, '(\\d+)$', 1) as bigint) % 9 as pos from evidence_links where kind = 'student') group by 1)"""


@query("registry_candidates", f"""with {REGISTRY}
select 'Q' || e.id as id, name, e.birth,
  case when e.birth is null then null when e.birth < 500 then 'Ancient' when e.birth < 1400 then 'Medieval' when e.birth < 1600 then 'Renaissance' when e.birth < 1800 then 'Enlightenment'
     when e.birth < 1900 then '19th Century' when e.birth < 1945 then 'Modernism' when e.birth < 1980 then 'Postwar' else 'Contemporary' end as era,
  case when e.birth is not null then 'Person' when pid % 4 = 0 then 'Institution' else 'Concept' end as entity_type,
  case when pid % 4 = 1 then 'Physics' else 'Philosophy' end as field, coalesce(w.n, 0) as works, coalesce(s.n, 0) as students,
  case when pid % 2 = 0 then 'https://en.wikipedia.org/wiki/Entity_' || e.id end as wikipedia_url
from ents e left join works_n w on w.id = e.id left join students_n s on s.id = e.id""")
def registry_candidates(b):
    return dumps.registry_candidates(*_registry(b)).select(
        "id", "name", "birth", "era", "entity_type", F.col("fields")[0].alias("field"),
        F.size("works").cast("long").alias("works"),
        F.size("students").cast("long").alias("students"), "wikipedia_url")


@query("batch_people", f"""with {REGISTRY},
near as (select value as id from evidence_links where kind in ('advisor', 'student', 'explicit_influence') and ord % 2 = 0 union select id from people where pid % 2 = 0),
labelled as (select person_id as id, count(*) as n from (
   select person_id, regexp_extract(value, '(\\d+)$', 1) as v from evidence_links where kind = 'work') x join people p on p.id = x.v and p.pid % 7 <> 0 group by 1)
select 'Q' || e.id as registry_id, 'entity_' || e.id as id, 'an English physicist and careful writer.' as notes
from ents e join labelled l on l.id = e.id where e.birth is not null and pid % 6 <> 0 and pid % 7 <> 0 and pid % 4 = 1 and e.id in (select id from near)""")
def batch_people(b):
    entities, statements, labels = _registry(b)
    found = dumps.registry_candidates(entities, statements, labels)
    anchors = entities.filter("ord % 2 = 0").select("id")
    return dumps.batch_people(found, b.people_core, statements, anchors).select(
        "registry_id", "id", "notes")


@query("prize_awards", """
select case when event_id % 11 <> 0 then 'Q' || cast(user_id as varchar) end as registry_id, case event_type when 'view' then 'Physics' else 'Physiology or Medicine' end as category,
  cast(1950 + event_id % 70 as int) as year, case when event_id % 2 = 0 then 'https://facts/' || cast(event_id as varchar) when event_id % 3 = 0 then 'https://home/' || cast(event_id as varchar)
   else 'https://www.nobelprize.org/laureate/' || cast(event_id as varchar) end as url, case event_type when 'view' then 'Physics' else 'Biology' end as field
from events where event_type in ('view', 'click') and event_id % 11 <> 0""")
def prize_awards(b):
    n = F.col("event_id")
    category = (F.when(F.col("event_type") == "view", "Physics").when(
        F.col("event_type") == "click", "Physiology or Medicine").otherwise("Peace"))
    facts = F.struct(F.when(n % 2 == 0, "external").otherwise("other").alias("rel"),
                     F.array(F.lit("laureate facts")).alias("class"),
                     F.concat(F.lit("https://facts/"), _s(n)).alias("href"))
    feed = b.table("events").select(
        _s(n).alias("id"), F.when(n % 11 != 0, F.concat(F.lit("Q"), _s("user_id")))
        .alias("registry_id"), F.when(n % 3 == 0, F.array(F.struct(
            F.lit("external").alias("rel"), F.concat(F.lit("https://home/"), _s(n))
            .alias("href")))).alias("links"),
        F.array(F.struct((1950 + n % 70).cast("string").alias("year"), category.alias("category"),
                         F.array(facts).alias("links"))).alias("prizes"))
    good, _ = dumps.prize_awards(feed)
    return good.select("registry_id", "category", "year", "url", "field")


@query("html_roster", """with items as (select page_id, unnest(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<li>\\s*<a[^>]*>(.*?)</a>\\s*</li>', 1, 's')) as raw from pages)
select page_id, count(*) as items, count(*) filter (where raw like '%,') as commas from items group by 1""")
def html_roster(b):
    # Link lists carry no year headings, so one is put in front of each list.
    pages = b.table("pages").withColumn("html", F.replace(
        "html", F.lit("<nav>"), F.lit("<nav><h3>2000</h3>")))
    rows = dumps.roster_items(
        pages, section=r"(?is)<nav>.*?</nav>", group=r"(?is)<nav>(.*?)</nav>",
        year=r"(?i)<h3>(\d{4})</h3>", item=r"(?is)<li>\s*<a[^>]*>(.*?)</a>\s*</li>")
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("items"),
                                       F.count_if(F.col("name").endswith(",")).alias("commas"))


@query("url_hosts", "select page_id, regexp_replace(regexp_extract(lower(url), '^https?://([^/:?#]+)', 1), '^www[.]', '') as host from pages")
def url_hosts(b):
    return b.table("pages").select("page_id", tx.url_host(F.col("url")).alias("host"))


@query("pipe_rows", """
select 'manual-' || trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) || '-' || substr(md5(concat_ws('|', trim(name), cast(birth as varchar), coalesce(cast(death as varchar), ''), field1, case when pid % 3 = 0 then 'a|b' else '' end)), 1, 8) as id, name, cast(birth as int) as birth, death, field1 as field, case when pid % 3 = 0 then 85 + case when death is not null then 5 else 0 end else 70 + case when death is not null then 5 else 0 end end as confidence from people""")
def pipe_rows(b):
    parts = F.concat_ws("|", "name", _s("birth"), F.coalesce(_s("death"), F.lit("")),
                        F.col("fields")[0], F.when(F.col("ord") % 3 == 0, " a | b ").otherwise(""))
    return files.pipe_candidates(b.people_core.select(parts.alias("value"))).select(
        "id", "name", "birth", "death", F.col("fields")[0].alias("field"), "confidence")


@query("people_csv_export", """
select id, name, coalesce(cast(death as varchar), '') as death, field1 || '; ' || field2 as fields, coalesce(subfield, '') as topics, coalesce(notes, '') as notes from people""")
def people_csv_export(b):
    return files.people_csv(b.people).select("id", "name", "death", "fields", "topics", "notes")


@query("csv_rows", """
select 'csv-' || trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) || '-' || substr(md5(concat_ws('|', name, cast(birth as varchar), '', field1, '', coalesce(subfield, ''), 'https://x.example.org', '', '', '', '')), 1, 8) as id, name, birth, field1 as field, len(case when subfield is null then [] else [subfield] end) as topics, 80 + case when subfield is not null then 10 else 0 end as confidence from people where pid % 13 <> 0""")
def csv_rows(b):
    raw = b.people_core.select(
        F.col("name").alias("Thinker"), F.when(F.col("ord") % 13 != 0, _s("birth")).otherwise("x")
        .alias("Birth Year"), F.col("fields")[0].alias("Discipline"),
        F.concat_ws("; ", "subfields").alias("Tags"), F.lit("https://x.example.org").alias("URL"))
    return files.csv_candidates(raw).select(
        "id", "name", "birth", F.col("fields")[0].alias("field"),
        F.size("topics").cast("long").alias("topics"), "confidence")


@query("inferred_attributes", """
select id, case when birth < 1400 then 'Medieval' when birth < 1600 then 'Renaissance' when birth < 1800 then 'Enlightenment' when birth < 1900 then '19th Century' when birth < 1945 then 'Modernism' when birth < 1980 then 'Postwar' else 'Contemporary' end as import_era,
  case when birth < 1900 then '19th Century' when birth < 1945 then 'Modernism' when birth < 1980 then 'Postwar' else 'Contemporary' end as laureate_era,
  case when contains(lower(notes), 'formal') or notes is null then 'Philosophy' else 'Philosophy' end as draft_field,
  case when bridge_score >= 3 then 'Person' when contains(notes, 'Imported') then 'Concept' else 'Concept' end as entity_type from people""")
def inferred_attributes(b):
    return b.people_core.select(
        "id", tax.import_era(F.col("birth")).alias("import_era"),
        tax.laureate_era(F.col("birth")).alias("laureate_era"),
        tax.infer_field(F.col("notes")).alias("draft_field"),
        tax.infer_entity_type(F.col("notes"), F.col("subfields"), F.col("bridge_score") >= 3)
        .alias("entity_type"))


@query("authority_ids", """
select p_partkey, case when p_partkey % 3 = 0 then 1 else 2 end as authorities, case when p_partkey % 2 = 0 then 1 else 2 end as viaf from part""")
def authority_ids(b):
    n = F.col("p_partkey")
    ids = F.create_map(
        F.lit("viaf"), F.array(F.concat(F.lit(" "), _s(n)), F.when(n % 2 == 0, _s(n)).otherwise(
            F.lit("other")), F.lit("  ")),
        F.lit("loc"), F.when(n % 3 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit("l"))))
    cleaned = nz.authority_ids(ids)
    return b.table("part").select(
        "p_partkey", F.size(F.map_keys(cleaned)).alias("authorities"),
        F.size(cleaned["viaf"]).alias("viaf"))


@query("state_restore", """
select 2::bigint as version, 'people' as part, id, pid as ord from people
union all select 2, 'edges', id, eid from edges
union all select 2, 'rejected_keys', cast(pid as varchar) || '::' || cast(pid + 1 as varchar), pid from people where pid % 9 = 0""")
def state_restore(b):
    """Three versions are committed; the newest is altered afterwards and passed over."""
    root = f"{shared_folder(b.spark)}/state-{uuid.uuid4().hex}"
    people = b.people.select("id", "ord", "name", "birth", "death", "fields", "works", "notes")
    keys = b.people_core.filter("ord % 9 = 0").select("ord", F.concat(
        "id", F.lit("::"), _s(F.col("ord") + 1)).alias("key"))
    state = {"people": people, "edges": b.edges, "rejected_keys": keys}
    state_store.commit(state | {"people": people.filter("ord % 2 = 0")}, root, b.now)
    state_store.commit(state, root, b.now)
    state_store.commit(state, root, b.now)
    _, folder = state_store.versions(b.spark, root)[0]
    people.limit(1).write.mode("append").parquet(f"{root}/{folder}/people")
    version, tables = state_store.restore(b.spark, root)
    part = lambda n, key="id": tables[n].select(
        F.lit(version).cast("long").alias("version"), F.lit(n).alias("part"),
        F.col(key).alias("id"), "ord")
    return part("people").unionByName(part("edges")).unionByName(part("rejected_keys", "key"))


@query("bundle_state", """
with bundles as (select pid, pid % 3 as file, row_number() over (partition by pid % 3 order by pid) - 1 as pos from people)
select 'person' as part, p.id, cast(b.file * 4294967296 + b.pos as bigint) as ord from people p join bundles b using (pid)
union all select 'import', p.id, cast(b.file * 4294967296 + b.pos as bigint) from people p join bundles b using (pid)
union all select 'key', p.id, cast(b.file * 4294967296 + b.pos as bigint) from people p join bundles b using (pid)
union all select 'threshold', '100.0', null""")
def bundle_state(b):
    """Three bundles of the people, as a reader finds them: places are unique over files."""
    ordered = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("ord", x))),
                                    lambda v: v["x"])
    n = F.col("ord")
    person = F.struct("id", "name", F.col("birth").cast("double").alias("birth"),
                      F.col("death").cast("double").alias("death"), "fields").alias("x")
    queued = F.struct("id", F.concat(F.lit("q"), "id").alias("candidateId"), F.col("name").alias(
        "candidateName"), F.lit(50.0).alias("confidence"), F.lit(None).cast("string").alias(
        "duplicateId"), F.lit("queued").alias("status")).alias("x")
    bundles = b.people_core.groupBy((n % 3).alias("file")).agg(
        ordered(person).alias("people"), ordered(queued).alias("importReviewQueue"),
        ordered(F.col("id").alias("x")).alias("rejectedLinkSuggestionKeys"))
    empty = {"edges": state_store.EDGE, "linkReviewQueue": state_store.LINKED,
             "importAuditLog": state_store.AUDITED}
    typed = bundles.select(
        F.concat(F.lit("bundle-"), _s("file")).alias("path"), F.lit(8).alias("version"),
        F.lit("2034-01-01").alias("exportedAt"), "importReviewQueue", "rejectedLinkSuggestionKeys",
        F.from_json(F.to_json("people"), f"array<{state_store.PERSON}>").alias("people"),
        F.concat(_s(F.col("file") * 70), F.lit("")).alias("importConfidenceThreshold"),
        *[F.array().cast(f"array<{t}>").alias(c) for c, t in empty.items()])
    tables = state_store.bundle_tables(typed)
    part = lambda n, name, key="id": tables[n].select(
        F.lit(name).alias("part"), F.col(key).alias("id"), "ord")
    return part("people", "person").unionByName(part("import_queue", "import")).unionByName(
        part("rejected_keys", "key", "key")).unionByName(tables["settings"].select(
            F.lit("threshold").alias("part"), _s("threshold").alias("id"),
            F.lit(None).cast("long").alias("ord")))
