"""People, edges, claims, threads and candidates derived from the star-schema tables.

``Bindings`` builds them with DataFrames; ``PREAMBLE`` states the same tables in SQL
so that a second engine can answer the same questions. Faults are wanted: dangling
targets, self-links, duplicate and opposite edges, invalid types, impossible dates.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions.taxonomy import era_from_year

NOW = "2034-01-12 00:00:00"

FIELD_BY_SEGMENT = {
    "AUTOMOBILE": "Engineering", "BUILDING": "Mathematics", "FURNITURE": "Philosophy",
    "HOUSEHOLD": "Literature", "MACHINERY": "Physics",
}

# What candidates with context are given in turn.
ERAS = ["Renaissance", "Scientific Revolution", "Enlightenment", "19th Century"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]

# Evidence kinds, each about a thirteenth of the line items.
LINK_KINDS = ["received_work", "named_mention", "citation_target", "explicit_influence",
              "student", "advisor", "correspondent", "coauthor", "source_context", "concept",
              "institution", "work"]
#: Every line item is an edge or evidence of one kind, by its quantity.
ROLES = ["edge", *LINK_KINDS]
_ROLES_SQL = "[" + ", ".join(f"'{r}'" for r in ROLES) + "]"
ROLE_SQL = f"{_ROLES_SQL}[cast(l_quantity as int) % {len(ROLES)} + 1]"


def role() -> Column:
    """What a line item stands for."""
    roles = F.array(*[F.lit(r) for r in ROLES])
    return F.element_at(roles, (F.col("l_quantity").cast("int") % len(ROLES)) + 1)


def _s(value) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


class Bindings:
    """Lazily built tables over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def now(self) -> Column:
        return F.to_timestamp(F.lit(NOW))

    @cached_property
    def people_core(self) -> DataFrame:
        """People without the works list (no line-item scan)."""
        key = F.col("c_custkey")
        birth = (F.lit(1500) + (key * 7919) % 450).cast("int")
        death = (F.when(key % 11 == 0, None)
                 .when(key % 97 == 0, 1495 + (key * 7919) % 450)
                 .otherwise(1530 + (key * 7919) % 450 + key % 60)).cast("int")
        segment = F.create_map(*[F.lit(x) for kv in FIELD_BY_SEGMENT.items() for x in kv])
        notes = (F.when(key % 17 == 0, F.concat(
                    F.lit("Imported from Wikidata: https://data.example.org/Q"), _s(key)))
                 .when(key % 19 == 0, "Pioneered a formal proof of quantum selection.")
                 .when(key % 23 == 0, "Critic of idealism; translated commentaries."))
        nations = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return (
            self.table("customer")
            .join(self.table("part"), F.col("p_partkey") == key)
            .join(nations, F.col("n_nationkey") == F.col("c_nationkey"))
            .select(
                _s(key).alias("id"), key.alias("ord"),
                F.concat("p_name", F.lit(" "), _s(key % 400)).alias("name"),
                birth.alias("birth"), death.alias("death"),
                F.array(segment[F.col("c_mktsegment")], F.col("p_type")).alias("fields"),
                F.when(key % 5 != 0, F.array("p_brand")).alias("subfields"),
                F.col("r_name").alias("region"), era_from_year(birth).alias("era"),
                F.when(key % 29 == 0, "Imported").when(key % 3 != 0, F.col("n_name"))
                .alias("movement"),
                (1 + key % 5).cast("int").alias("bridge_score"),
                notes.alias("notes"),
            )
        )

    @cached_property
    def sales(self) -> DataFrame:
        """Line items with their customer."""
        return self.table("lineitem").join(
            self.table("orders").select("o_orderkey", "o_custkey"),
            F.col("o_orderkey") == F.col("l_orderkey"))

    @cached_property
    def people(self) -> DataFrame:
        """People with works and the influence metadata of their line items."""
        title = F.concat(F.lit("Volume "), _s("l_partkey"))
        works = (self.sales.withColumn("role", role())
                 .filter("role in ('work', 'explicit_influence')")
                 .groupBy(_s("o_custkey").alias("id"))
                 .agg(F.array_sort(F.collect_set(
                         F.when(F.col("role") == "work", title))).alias("works"),
                      F.array_sort(F.collect_set(
                          F.when(F.col("role") == "explicit_influence", _s("l_partkey"))))
                      .alias("influenced")))
        empty = F.array().cast("array<string>")
        return self.people_core.join(works, "id", "left").withColumns({
            "works": F.coalesce("works", empty),
            "influenced": F.coalesce("influenced", empty)})

    @cached_property
    def _raw_edges(self) -> DataFrame:
        lines = (self.table("lineitem").filter(role() == "edge")
                 .groupBy("l_orderkey", "l_linenumber")
                 .agg(*[F.min(c).alias(c) for c in
                        ["l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
                         "l_discount"]]))
        kind = (F.when(F.col("l_returnflag") == "A", "Influence")
                .when(F.col("l_returnflag") == "R", "Mentorship")
                .when(F.col("l_linestatus") == "O", "Collaboration").otherwise("Legacy link"))
        return lines.join(self.table("orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(
            "l_orderkey", "l_partkey", "l_suppkey",
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("eid"),
            F.col("o_custkey").alias("src"), F.col("l_partkey").alias("tgt"),
            kind.alias("type"),
            (1 + (F.col("l_orderkey") + F.col("l_partkey")) % 5).cast("int").alias("strength"),
            (F.round(F.col("l_discount") * 100).cast("int") * 10).alias("conf100"))

    @cached_property
    def edges(self) -> DataFrame:
        raw = self._raw_edges
        order = F.col("l_orderkey")
        copies = raw.withColumn("copy", F.explode(F.array_compact(F.array(
            F.lit(0).cast("long"), F.when(order % 50 == 0, 1), F.when(order % 70 == 0, 2),
            F.when(order % 200 == 0, 3)))))
        flat = copies.select(
            "l_orderkey", "l_partkey", "l_suppkey", "type", "strength", "conf100",
            (F.col("eid") + F.col("copy") * 1000000000).alias("eid"),
            F.when(F.col("copy") == 1, F.col("tgt")).otherwise(F.col("src")).alias("src"),
            F.when(F.col("copy") == 1, F.col("src"))
            .when(F.col("copy") == 3, F.col("src")).otherwise(F.col("tgt")).alias("tgt"))
        eid, empty = F.col("eid"), F.array().cast("array<string>")
        url = F.concat(F.lit("https://www.site"), _s("l_suppkey"), F.lit(".example.org/e/"),
                       _s(eid))
        status = (F.when(eid % 7 < 2, "accepted").when(eid % 7 == 2, "suggested")
                  .when(eid % 7 == 3, "needs_source").when(eid % 7 == 4, "rejected")
                  .when(eid % 7 == 6, "accepted"))
        note = (F.when(eid % 6 == 0, "explicit influence").when(eid % 6 == 1, "mentor and student")
                .when(eid % 6 == 2, "coauthor of a jointly written work")
                .when(eid % 6 == 3, "parallel and independent")
                .when(eid % 6 == 4, "co-mentioned in the same source"))
        return flat.select(
            _s(eid).alias("id"), eid.alias("ord"), _s("src").alias("source"),
            _s("tgt").alias("target"), F.lit("Person").alias("source_type"),
            F.lit("Person").alias("target_type"), "type", "strength",
            F.when(eid % 23 != 0, F.col("conf100") / F.lit(100.0)).alias("confidence"),
            status.alias("status"), note.alias("note"),
            F.when(eid % 4 == 2, F.when(eid % 3 == 0, empty).otherwise(F.array(url)))
            .when(eid % 4 == 3, F.array(url)).alias("source_claims"),
            F.when(eid % 3 == 1, F.array(F.concat(F.lit("c"), _s("l_orderkey"))))
            .when(eid % 3 == 2, F.array(F.concat(F.lit("c"), _s("l_orderkey")),
                                        F.concat(F.lit("c"), _s("l_partkey"))))
            .alias("claim_ids"),
            F.when(eid % 11 == 0, F.array(F.concat(F.lit("t"), _s("l_orderkey"))))
            .alias("thread_ids"))

    @cached_property
    def claims(self) -> DataFrame:
        eid = F.col("event_id")
        person = F.concat(F.lit("person:"), _s(F.floor(eid / 7)))
        other = F.concat(F.lit("person:"), _s(F.floor(eid / 9)))
        subject_type = F.when(eid % 4 == 0, "Person").otherwise("Relationship")
        status = (F.when(F.col("event_type") == "error", "rejected")
                  .when(F.col("event_type") == "signup", "conflicting")
                  .when(F.col("event_type") == "view", "observed")
                  .when(F.col("event_type") == "click", "candidate").otherwise("accepted"))
        field = (F.when(eid % 6 == 0, "doctoral advisor").when(eid % 6 == 1, "student of")
                 .when(eid % 6 == 2, "coauthor").when(eid % 6 == 3, "influence")
                 .when(eid % 6 == 4, "notable student").otherwise("correspondent"))
        wording = F.concat(_s(F.floor(eid / 7)),
                           F.when(eid % 3 == 0, " influenced ").when(eid % 3 == 1, " mentored ")
                           .otherwise(" collaborated with "), _s(F.floor(eid / 9)))
        return self.table("events").select(
            F.concat(F.lit("c"), _s(eid)).alias("id"), eid.alias("ord"),
            F.concat(F.lit("Source "), _s(eid % 20)).alias("source_name"),
            F.when(eid % 5 != 0, F.concat(F.lit("https://src"), _s(eid % 20),
                                          F.lit(".example.org/"), _s(eid))).alias("source_url"),
            F.lit("reference").alias("source_type"),
            ((eid % 10) / F.lit(10.0)).alias("source_reliability"),
            F.lit("adapter_import").alias("extraction_method"),
            F.when(eid % 31 != 0, F.col("ts").cast("timestamp")).alias("observed_at"),
            F.when(subject_type == "Person", person)
            .when(eid % 4 == 1, F.concat(F.lit("relationship:"), person, F.lit(":Influence:"),
                                         other))
            .otherwise(F.concat(F.lit("rel-"), _s(F.col("user_id")))).alias("subject_id"),
            subject_type.alias("subject_type"), field.alias("field"),
            F.when(subject_type == "Person", other).otherwise(wording).alias("value"),
            ((eid % 100) / F.lit(100.0)).alias("confidence"), status.alias("status"))

    @cached_property
    def threads(self) -> DataFrame:
        """One ordered path per order: its customer, then the part of each line."""
        slots = [F.min(F.when(F.col("l_linenumber") == i, F.col("l_partkey"))).alias(f"s{i}")
                 for i in range(1, 8)]
        lines = self.table("lineitem").groupBy("l_orderkey").agg(*slots)
        order = F.col("o_orderkey")
        return (
            self.table("orders").join(lines, order == F.col("l_orderkey"), "left")
            .select(
                F.concat(F.lit("t"), _s(order)).alias("id"), order.alias("ord"),
                F.concat(F.lit("Thread "), _s(order)).alias("title"),
                F.array_compact(F.array(_s("o_custkey"), *[_s(f"s{i}") for i in range(1, 8)]))
                .alias("people"),
                F.when(order % 3 == 0, "high").when(order % 3 == 1, "medium").otherwise("needs-review")
                .alias("confidence"),
                F.when(F.col("o_orderstatus") == "F", F.array(F.lit("Influence"))).alias(
                    "edge_types")))

    @cached_property
    def evidence_links(self) -> DataFrame:
        """(person_id, kind, value, section) evidence rows, one per typed line item."""
        kind = role()
        value = (F.when(kind == "work", F.concat(F.lit("Volume "), _s("l_partkey")))
                 .when(kind == "institution", F.concat(F.lit("Institute "), _s("l_suppkey")))
                 .when(kind == "concept", F.concat(F.lit("Concept "), _s("l_suppkey")))
                 .when(kind == "source_context", F.concat(F.lit("src"), _s("l_suppkey")))
                 .otherwise(_s("l_partkey")))
        section = F.when((kind == "source_context") & (F.col("l_linenumber") % 3 != 0),
                         F.concat(F.lit("s"), _s(F.col("l_linenumber") % 3)))
        return (self.sales.filter(role() != "edge")
                .select(_s("o_custkey").alias("person_id"), F.col("o_custkey").alias("ord"),
                        kind.alias("kind"), value.alias("value"), section.alias("section"))
                .distinct())

    @cached_property
    def candidates(self) -> DataFrame:
        key = F.col("s_suppkey")
        part = self.table("part").select("p_partkey", "p_name", "p_type", "p_brand")
        empty = F.array().cast("array<string>")
        return (
            self.table("supplier")
            .join(part, F.col("p_partkey") == key * 3)
            .join(self.table("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
            .select(
                F.concat(F.lit("q"), _s(key)).alias("id"), key.alias("ord"),
                F.concat("p_name", F.when(key % 2 == 0, " ").otherwise(" x"),
                         _s((key * 3) % 400)).alias("name"),
                F.when(key % 4 == 0, F.array(F.concat(F.lit("Alias ("), F.col("p_name"),
                                                      F.lit(" "), _s((key * 7) % 400),
                                                      F.lit(")"))))
                .otherwise(empty).alias("aliases"),
                F.when(key % 3 == 0, "English mathematician and formal logic pioneer")
                .when(key % 3 == 1, "physicist working on quantum theory").alias("description"),
                F.when(key % 13 != 0, (1500 + (key * 3 * 7919) % 450 + key % 3).cast("int"))
                .alias("birth"),
                F.when(key % 5 != 0, (1530 + (key * 3 * 7919) % 450 + (key * 3) % 60).cast("int"))
                .alias("death"),
                F.when(key % 6 == 0, empty).when(key % 2 == 0, F.array(F.lit("Mathematics")))
                .otherwise(F.array(F.lit("Physics"), F.col("p_type"))).alias("fields"),
                F.when(key % 4 == 1, F.array("p_brand")).otherwise(empty).alias("topics"),
                F.array(F.concat(F.lit("Volume "), _s(key * 3)),
                        F.concat(F.lit("Volume "), _s(key * 5))).alias("works"),
                F.when(key % 7 != 0, F.col("n_name")).alias("movement"),
                F.lit(None).cast("string").alias("era"),
                F.lit(None).cast("string").alias("region"),
                F.concat(F.lit("https://data.example.org/Q"), _s(key * 17)).alias("source_url"),
                F.when(key % 2 == 1, F.concat(F.lit("https://en.example.org/"), _s(key)))
                .alias("wikipedia_url")))

    @cached_property
    def rich_candidates(self) -> DataFrame:
        """Candidates with era, region and the external name lists of a registry entry."""
        key = F.col("ord")
        names = self.people_core.select(F.col("ord").alias("pid"), "name")
        df = self.candidates
        for alias, number in (("teacher", key * 2), ("model", key * 2 + 1), ("pupil", key * 3 + 2)):
            side = names.select(F.col("pid").alias(alias), F.col("name").alias(f"{alias}_name"))
            df = df.join(side, number == F.col(alias), "left")
        listed = lambda *names: F.array_compact(F.array(*names))
        eras = F.array(*[F.lit(e) for e in ERAS])
        regions = F.array(*[F.lit(r) for r in REGIONS])
        return df.withColumns({
            "era": F.when(key % 5 != 0, F.element_at(eras, (key % 4 + 1).cast("int"))),
            "region": F.when(key % 3 != 0, F.element_at(regions, (key % 5 + 1).cast("int"))),
            "influenced_by": listed(F.when(key % 4 == 0, F.col("model_name")), F.when(
                key % 8 == 0, F.lit("Unknown Master"))),
            "advisors": listed(F.when(key % 3 == 1, F.col("teacher_name"))),
            "students": listed(F.when(key % 5 == 2, F.col("pupil_name"))),
            "employers": listed(F.when(key % 2 == 0, F.concat(F.lit("Institute "), _s(key)))),
            "educated_at": listed(F.when(key % 6 == 1, F.lit("Institute 1"))),
            "member_of": listed(F.when(key % 10 == 3, F.col("teacher_name"))),
        }).drop("teacher", "model", "pupil", "teacher_name", "model_name", "pupil_name")


PREAMBLE = """
customers_n as (select count(*) as n from customer),
people_base as (
  select c.c_custkey as pid,
         p.p_name || ' ' || cast(c.c_custkey % 400 as varchar) as name,
         cast(1500 + (c.c_custkey * 7919) % 450 as int) as birth,
         cast(case when c.c_custkey % 11 = 0 then null
                   when c.c_custkey % 97 = 0 then 1495 + (c.c_custkey * 7919) % 450
                   else 1530 + (c.c_custkey * 7919) % 450 + c.c_custkey % 60 end as int) as death,
         case c.c_mktsegment when 'AUTOMOBILE' then 'Engineering' when 'BUILDING' then 'Mathematics'
              when 'FURNITURE' then 'Philosophy' when 'HOUSEHOLD' then 'Literature'
              when 'MACHINERY' then 'Physics' end as field1,
         p.p_type as field2,
         case when c.c_custkey % 5 <> 0 then p.p_brand end as subfield,
         r.r_name as region,
         case when c.c_custkey % 29 = 0 then 'Imported' when c.c_custkey % 3 <> 0 then n.n_name end as movement,
         cast(1 + c.c_custkey % 5 as int) as bridge_score,
         case when c.c_custkey % 17 = 0 then 'Imported from Wikidata: https://data.example.org/Q' || cast(c.c_custkey as varchar)
              when c.c_custkey % 19 = 0 then 'Pioneered a formal proof of quantum selection.'
              when c.c_custkey % 23 = 0 then 'Critic of idealism; translated commentaries.' end as notes
  from customer c join part p on p.p_partkey = c.c_custkey
  join nation n on n.n_nationkey = c.c_nationkey join region r on r.r_regionkey = n.n_regionkey),
people as (
  select *, cast(pid as varchar) as id,
         case when birth < 500 then 'Ancient' when birth < 1400 then 'Medieval' when birth < 1600 then 'Renaissance'
              when birth < 1700 then 'Scientific Revolution' when birth < 1800 then 'Enlightenment'
              when birth < 1900 then '19th Century' when birth < 1945 then 'Modernism'
              when birth < 1980 then 'Postwar' else 'Contemporary' end as era
  from people_base),
person_fields as (
  select id, pid, 1 as pos, field1 as field from people
  union all select id, pid, 2, field2 from people),
sales as (select *, $ROLE as role from lineitem join orders on o_orderkey = l_orderkey),
person_works as (
  select distinct cast(o_custkey as varchar) as id, 'Volume ' || cast(l_partkey as varchar) as title
  from sales where role = 'work'),
person_influenced as (
  select distinct cast(o_custkey as varchar) as id, cast(l_partkey as varchar) as target
  from sales where role = 'explicit_influence'),
edge_lines as (
  select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey,
         min(l_returnflag) as l_returnflag, min(l_linestatus) as l_linestatus, min(l_discount) as l_discount
  from lineitem where $ROLE = 'edge' group by 1, 2),
raw_edges as (
  select l_orderkey, l_partkey, l_suppkey, l_orderkey * 10 + l_linenumber as eid0, o_custkey as s0, l_partkey as t0,
         case when l_returnflag = 'A' then 'Influence' when l_returnflag = 'R' then 'Mentorship'
              when l_linestatus = 'O' then 'Collaboration' else 'Legacy link' end as type,
         cast(1 + (l_orderkey + l_partkey) % 5 as int) as strength,
         cast(round(l_discount * 100) as int) * 10 as conf100
  from edge_lines join orders on o_orderkey = l_orderkey),
edge_copies as (
  select *, eid0 as eid, s0 as src, t0 as tgt from raw_edges
  union all select *, eid0 + 1000000000, t0, s0 from raw_edges where l_orderkey % 50 = 0
  union all select *, eid0 + 2000000000, s0, t0 from raw_edges where l_orderkey % 70 = 0
  union all select *, eid0 + 3000000000, s0, s0 from raw_edges where l_orderkey % 200 = 0),
edges as (
  select eid, cast(eid as varchar) as id, cast(src as varchar) as source, cast(tgt as varchar) as target, type, strength,
         case when eid % 23 <> 0 then conf100 end as conf100,
         case when eid % 7 < 2 then 'accepted' when eid % 7 = 2 then 'suggested' when eid % 7 = 3 then 'needs_source'
              when eid % 7 = 4 then 'rejected' when eid % 7 = 6 then 'accepted' end as status,
         case eid % 6 when 0 then 'explicit influence' when 1 then 'mentor and student'
              when 2 then 'coauthor of a jointly written work' when 3 then 'parallel and independent'
              when 4 then 'co-mentioned in the same source' end as note,
         case when eid % 4 = 2 then (case when eid % 3 = 0 then [] else
                ['https://www.site' || cast(l_suppkey as varchar) || '.example.org/e/' || cast(eid as varchar)] end)
              when eid % 4 = 3 then
                ['https://www.site' || cast(l_suppkey as varchar) || '.example.org/e/' || cast(eid as varchar)] end as source_claims,
         case when eid % 3 = 1 then ['c' || cast(l_orderkey as varchar)]
              when eid % 3 = 2 then ['c' || cast(l_orderkey as varchar), 'c' || cast(l_partkey as varchar)] end as claim_ids,
         case when eid % 11 = 0 then ['t' || cast(l_orderkey as varchar)] end as thread_ids
  from edge_copies),
edge_flags as (
  select *, coalesce(len(source_claims), 0) + coalesce(len(claim_ids), 0) > 0 as has_evidence,
         coalesce(len(coalesce(source_claims, claim_ids)), 0) as n_sources
  from edges),
ends as (
  select eid, source as id from edges union all select eid, target from edges),
degrees as (select id, count(*) as degree from ends group by id),
claims as (
  select 'c' || cast(event_id as varchar) as id, event_id, 'Source ' || cast(event_id % 20 as varchar) as source_name,
         case when event_id % 5 <> 0 then 'https://src' || cast(event_id % 20 as varchar) || '.example.org/' || cast(event_id as varchar) end as source_url,
         cast(event_id % 10 as int) as reliability10,
         case when event_id % 31 <> 0 then ts end as observed_at,
         case when event_id % 4 = 0 then 'person:' || cast(event_id // 7 as varchar)
              when event_id % 4 = 1 then 'relationship:person:' || cast(event_id // 7 as varchar) || ':Influence:person:' || cast(event_id // 9 as varchar)
              else 'rel-' || cast(user_id as varchar) end as subject_id,
         case when event_id % 4 = 0 then 'Person' else 'Relationship' end as subject_type,
         case event_id % 6 when 0 then 'doctoral advisor' when 1 then 'student of' when 2 then 'coauthor'
              when 3 then 'influence' when 4 then 'notable student' else 'correspondent' end as field,
         case when event_id % 4 = 0 then 'person:' || cast(event_id // 9 as varchar)
              else cast(event_id // 7 as varchar) || case event_id % 3 when 0 then ' influenced ' when 1 then ' mentored '
                   else ' collaborated with ' end || cast(event_id // 9 as varchar) end as value,
         cast(event_id % 100 as int) as conf100,
         case event_type when 'error' then 'rejected' when 'signup' then 'conflicting' when 'view' then 'observed'
              when 'click' then 'candidate' else 'accepted' end as status
  from events),
claim_ages as (
  select *, case when observed_at is not null then
           greatest(0, (epoch_ms(timestamp '2034-01-12 00:00:00') - epoch_ms(observed_at)) // 86400000) end as recency
  from claims),
thread_lines as (
  select l_orderkey, l_linenumber, min(l_partkey) as part from lineitem
  where l_linenumber between 1 and 7 group by 1, 2),
thread_members as (
  select o_orderkey as tid, 0 as line, o_custkey as pid from orders
  union all select l_orderkey, l_linenumber, part from thread_lines
            where l_orderkey in (select o_orderkey from orders)),
thread_steps as (
  select 't' || cast(tid as varchar) as thread_id, tid, cast(row_number() over (partition by tid order by line) - 1 as int) as step,
         cast(pid as varchar) as person_id
  from thread_members),
thread_pairs as (
  select a.thread_id, a.tid, a.step, a.person_id as left_id, b.person_id as right_id
  from thread_steps a join thread_steps b on a.tid = b.tid and b.step = a.step + 1),
threads as (
  select 't' || cast(o_orderkey as varchar) as id, o_orderkey as tid, 'Thread ' || cast(o_orderkey as varchar) as title,
         case o_orderkey % 3 when 0 then 'high' when 1 then 'medium' else 'needs-review' end as confidence,
         case when o_orderstatus = 'F' then 'Influence' end as edge_type
  from orders),
evidence_links as (
  select distinct cast(o_custkey as varchar) as person_id, o_custkey as ord,
    role as kind,
    case role when 'work' then 'Volume ' || cast(l_partkey as varchar)
      when 'institution' then 'Institute ' || cast(l_suppkey as varchar) when 'concept' then 'Concept ' || cast(l_suppkey as varchar)
      when 'source_context' then 'src' || cast(l_suppkey as varchar) else cast(l_partkey as varchar) end as value,
    case when role = 'source_context' and l_linenumber % 3 <> 0 then 's' || cast(l_linenumber % 3 as varchar) end as section
  from sales where role <> 'edge'),
candidates as (
  select s_suppkey as ord, 'q' || cast(s_suppkey as varchar) as id,
         p_name || case when s_suppkey % 2 = 0 then ' ' else ' x' end || cast((s_suppkey * 3) % 400 as varchar) as name,
         case when s_suppkey % 4 = 0 then 'Alias (' || p_name || ' ' || cast((s_suppkey * 7) % 400 as varchar) || ')' end as alias,
         case s_suppkey % 3 when 0 then 'English mathematician and formal logic pioneer'
              when 1 then 'physicist working on quantum theory' end as description,
         case when s_suppkey % 13 <> 0 then cast(1500 + (s_suppkey * 3 * 7919) % 450 + s_suppkey % 3 as int) end as birth,
         case when s_suppkey % 5 <> 0 then cast(1530 + (s_suppkey * 3 * 7919) % 450 + (s_suppkey * 3) % 60 as int) end as death,
         case when s_suppkey % 6 = 0 then [] when s_suppkey % 2 = 0 then ['Mathematics'] else ['Physics', p_type] end as fields,
         case when s_suppkey % 4 = 1 then [p_brand] else [] end as topics,
         ['Volume ' || cast(s_suppkey * 3 as varchar), 'Volume ' || cast(s_suppkey * 5 as varchar)] as works,
         case when s_suppkey % 7 <> 0 then n_name end as movement,
         'https://data.example.org/Q' || cast(s_suppkey * 17 as varchar) as source_url,
         case when s_suppkey % 2 = 1 then 'https://en.example.org/' || cast(s_suppkey as varchar) end as wikipedia_url
  from supplier join part on p_partkey = s_suppkey * 3 join nation on n_nationkey = s_nationkey),
rich_candidates as (
  select c.*, case when c.ord % 5 <> 0 then $ERAS[c.ord % 4 + 1] end as era, case when c.ord % 3 <> 0 then $REGIONS[c.ord % 5 + 1] end as region,
         list_filter([case when c.ord % 4 = 0 then m.name end, case when c.ord % 8 = 0 then 'Unknown Master' end], lambda x: x is not null) as influenced_by,
         list_filter([case when c.ord % 3 = 1 then t.name end], lambda x: x is not null) as advisors,
         list_filter([case when c.ord % 5 = 2 then p.name end], lambda x: x is not null) as students,
         case when c.ord % 2 = 0 then ['Institute ' || cast(c.ord as varchar)] else [] end as employers,
         case when c.ord % 6 = 1 then ['Institute 1'] else [] end as educated_at,
         list_filter([case when c.ord % 10 = 3 then t.name end], lambda x: x is not null) as member_of
  from candidates c left join people t on t.pid = c.ord * 2 left join people m on m.pid = c.ord * 2 + 1 left join people p on p.pid = c.ord * 3 + 2)
""".replace("$ROLE", ROLE_SQL).replace("$ERAS", str(ERAS)).replace("$REGIONS", str(REGIONS))


def sql_with_bindings(sql: str) -> str:
    """Prefix a statement with the bound tables; ``with`` lists may be continued."""
    words = sql.split(None, 1)
    if words[0].lower() != "with":
        return f"with {PREAMBLE.strip()}\n{sql.strip()}"
    body = words[1]
    recursive = ""
    if body.split(None, 1)[0].lower() == "recursive":
        recursive, body = "recursive ", body.split(None, 1)[1]
    return f"with {recursive}{PREAMBLE.strip()},\n{body}"
