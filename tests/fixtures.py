"""Small DataFrame builders with defaults for the columns a test does not set."""

PEOPLE = ("id string, ord long, name string, birth int, death int, fields array<string>, "
          "subfields array<string>, region string, era string, movement string, "
          "bridge_score int, works array<string>, influenced array<string>, "
          "claim_ids array<string>, notes string")
EDGES = ("id string, ord long, source string, target string, source_type string, "
         "target_type string, type string, strength int, confidence double, status string, "
         "note string, source_claims array<string>, claim_ids array<string>, "
         "thread_ids array<string>")
CLAIMS = ("id string, ord long, source_name string, source_url string, source_type string, "
          "source_reliability double, extraction_method string, observed_at timestamp, "
          "subject_id string, subject_type string, field string, value string, "
          "confidence double, status string")
THREADS = ("id string, ord long, title string, people array<string>, confidence string, "
           "edge_types array<string>")
LINKS = "person_id string, ord long, kind string, value string, section string"


def names(schema):
    return [part.strip().split(" ")[0] for part in schema.split(",") if " " in part.strip()]


def table(spark, schema, rows, **defaults):
    columns = names(schema)
    filled = []
    for n, row in enumerate(rows):
        merged = {"ord": n, **defaults, **row}
        filled.append(tuple(merged.get(c) for c in columns))
    return spark.createDataFrame(filled, schema)


def people(spark, *rows, **defaults):
    base = dict(birth=1800, fields=["Logic"], works=["W"], region="R", subfields=["T"])
    made = [{**base, "name": r["id"], **r} for r in rows]
    return table(spark, PEOPLE, made, **defaults)


def edges(spark, *rows):
    base = dict(type="Influence", strength=3, source_type="Person", target_type="Person")
    return table(spark, EDGES, [{**base, **r} for r in rows])


def claims(spark, *rows):
    base = dict(source_name="S", source_type="reference", source_reliability=0.8,
                extraction_method="manual_seed", subject_id="x", subject_type="Relationship",
                field="influence", value="v", confidence=0.8, status="accepted")
    return table(spark, CLAIMS, [{**base, **r} for r in rows])


def threads(spark, *rows):
    base = dict(title="T", confidence="high")
    return table(spark, THREADS, [{**base, **r} for r in rows])
