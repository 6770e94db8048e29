import json

from pyspark.sql import functions as F

from quern.operators.properties import page_metadata, typed

ID = "12345678123412341234123456789ABC"
OWN = "12345678-1234-1234-1234-123456789abc"
GOOD = [
    ({"type": "title", "title": [{"plain_text": "a"}, {"plain_text": "b"}]}, ("text", "ab")),
    ({"type": "rich_text", "rich_text": []}, ("text", "")),
    ({"type": "number", "number": -1.5}, ("number", -1.5)),
    ({"type": "number", "number": None}, ("null", None)),
    ({"type": "checkbox", "checkbox": False}, ("flag", False)),
    ({"type": "url", "url": "x"}, ("text", "x")),
    ({"type": "email", "email": None}, ("null", None)),
    ({"type": "phone_number", "phone_number": "1"}, ("text", "1")),
    ({"type": "created_time", "created_time": "t"}, ("text", "t")),
    ({"type": "select", "select": {"name": "n"}}, ("text", "n")),
    ({"type": "status", "status": None}, ("null", None)),
    ({"type": "multi_select", "multi_select": [{"name": "b"}, {"name": "a"}]}, ("strings", ["a", "b"])),
    ({"type": "date", "date": {"start": "2024-01-01", "end": None}}, ("date", "2024-01-01")),
    ({"type": "people", "people": [{"id": ID}]}, ("person_ids", [OWN])),
    ({"type": "relation", "relation": [{"id": ID}], "has_more": False}, ("page_ids", [OWN])),
    ({"type": "created_by", "created_by": {"id": ID}}, ("person_ids", [OWN])),
    ({"type": "formula", "formula": {"type": "string", "string": "s"}}, ("text", "s")),
    ({"type": "rollup", "rollup": {"type": "number", "number": 2}}, ("number", 2.0)),
    ({"type": "formula", "formula": {"type": "date", "date": None}}, ("null", None)),
]
BAD = [
    ({"type": "number", "number": "5"}, "invalid"),
    ({"type": "number"}, "invalid"),
    ({"type": "checkbox", "checkbox": None}, "invalid"),
    ({"type": "checkbox", "checkbox": "true"}, "invalid"),
    ({"type": "title", "title": None}, "invalid"),
    ({"type": "url", "url": 5}, "invalid"),
    ({"type": "select", "select": {"name": 5}}, "invalid"),
    ({"type": "multi_select", "multi_select": [{"name": "a"}, {}]}, "invalid"),
    ({"type": "date", "date": {"start": None}}, "invalid"),
    ({"type": "people", "people": [{"id": "broken"}]}, "invalid"),
    ({"type": "relation", "relation": []}, "invalid"),
    ({"number": 5}, "invalid"),
    ({"type": "button", "button": {}}, "unsupported"),
    ({"type": "relation", "relation": [], "has_more": True}, "unsupported"),
    ({"type": "people", "people": [{"id": ID}] * 25}, "unsupported"),
    ({"type": "rollup", "rollup": {"type": "array", "array": []}}, "unsupported"),
    ({"type": "rich_text", "rich_text": [{"type": "mention", "plain_text": "@x"}] * 25}, "unsupported"),
]


def test_every_type(spark):
    df = spark.createDataFrame([(i, json.dumps(p)) for i, (p, _) in enumerate(GOOD + BAD)] + [(999, None), (998, "{"), (997, "[]")], "n int, said string")
    got = {r.n: r.t for r in df.select("n", typed(F.col("said")).alias("t")).collect()}
    for i, (said, (kind, value)) in enumerate(GOOD):
        t = got[i]
        assert t.reason is None and t.value.kind == kind, (said, t)
        assert {"text": t.value.text, "number": t.value.number, "flag": t.value.flag, "date": t.value.start, "null": None}.get(kind, t.value["items"]) == value, (said, t)
    for i, (said, reason) in enumerate(BAD, len(GOOD)):
        assert got[i].reason == reason, (said, got[i])
    assert got[999].reason == got[998].reason == got[997].reason == "invalid"


def test_pages_are_taken_whole_or_not(spark):
    base = {"object": "page", "id": ID, "url": f"https://h.example/T-{ID}", "last_edited_time": "2026-10-03T12:30:00Z", "is_archived": True, "properties": {"Name": {"id": "title", "type": "title", "title": [{"plain_text": "T"}]}, "R": {"id": "r", "type": "relation", "relation": [], "has_more": False}}}
    change = lambda **c: {k: v for k, v in {**base, **c}.items() if v is not None}
    more = lambda name, p: change(properties={**base["properties"], name: p})
    cases = [
        base, change(is_archived=None), change(object="database"), change(url="https://h.example/T-" + "a" * 32), change(id="x"), change(last_edited_time="yesterday"), change(is_archived="odd"), change(properties={}),
        more("B", {"id": "b", "type": "title", "title": []}), more("B", {"id": "r", "type": "checkbox", "checkbox": True}), more("B", {"id": "", "type": "checkbox", "checkbox": True}), more("B", {"id": "b", "type": "button"}), more("B", {"id": "b", "type": "number", "number": 1}),
    ]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)] + [(99, None), (98, "not json")], "n int, said string")
    got = {r.n: r for r in page_metadata(df, "n", "said", ["h.example"]).collect()}
    assert [got[i].reason for i in range(len(cases))] == [None] + ["invalid"] * 10 + ["unsupported", None]
    assert got[99].reason == got[98].reason == "invalid" and got[1].properties is None
    r = got[0]
    assert (r.id, r.title, r.archived, r.relations) == (OWN, "T", True, {"r": "R"}) and set(r.properties) == {"title", "r"}
    assert page_metadata(df.limit(0), "n", "said", ["h.example"]).count() == 0


def test_a_list_is_read_a_few_times_only(spark):
    """Lambdas are interpreted: what stands in them twice is read twice."""
    made = spark.createDataFrame([('{"type":"url","url":"x"}',)], "said string").select(typed(F.col("said")).alias("t"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("from_json(") < 50


def test_orders_in_one_file_become_many_tasks(spark):
    from quern.plans.registry import queries

    assert queries()["page_metadata_typed"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4
