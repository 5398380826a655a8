import json

import pytest
from pyspark.sql import functions as F

from tessera.functions.schema import export_schema, exported, scrub, struct_type
from tessera.operators import graph
from tessera.operators.graph import Definition, Relation, decode_ref, denormalize, denormalize_documents, encode_ref, identify, walk

REGISTRY = {"contact": Definition(id_field="contactId"), "order": Definition(id_field="orderId"), "member": Definition(get_id=lambda x: f"{x['orgId']}-{x['userId']}" if "orgId" in x and "userId" in x else None)}


def ref(kind, own):
    return {"__cdb_ref": True, "entityType": kind, "id": own, "key": f"{kind}:{own}"}


@pytest.mark.parametrize(
    ("value", "key"),
    [
        ({"contactId": 1, "name": "x"}, ("contact", "1")), ({"contactId": 1.0}, ("contact", "1")), ({"contactId": "a:b"}, ("contact", "a:b")), ({"__typename": "User", "id": 7}, ("User", "7")),
        ({"id": "1", "name": "x"}, None), ({"__typename": "User"}, None), ({"__typename": 3, "id": 1}, None), ({"orgId": "acme", "userId": 42}, ("member", "acme-42")), ({"contactId": None}, None),
    ],
)
def test_identify(value, key):
    assert identify(value, REGISTRY) == key


def test_walk_finds_inner_entities_first():
    payload = {"orderId": "o1", "total": 5, "customer": {"contactId": "c1", "name": "n"}, "rows": [{"contactId": "c2"}, {"plain": 1}], "kept": ref("contact", "c9")}
    value, found = walk(payload, REGISTRY)
    assert value == ref("order", "o1")
    assert [(k, i) for k, i, _ in found] == [("contact", "c1"), ("contact", "c2"), ("order", "o1")]
    assert found[-1][2] == {"orderId": "o1", "total": 5, "customer": ref("contact", "c1"), "rows": [ref("contact", "c2"), {"plain": 1}], "kept": ref("contact", "c9")}
    assert walk([1, {"page": 2}], REGISTRY) == ([1, {"page": 2}], [])
    twice = walk([{"contactId": 1, "a": 1}, {"contactId": 1, "b": 2}], REGISTRY)[1]
    assert [d for _, _, d in twice] == [{"contactId": 1, "a": 1}, {"contactId": 1, "b": 2}]


def test_documents_of_any_shape(spark):
    payloads = [(1, json.dumps({"contacts": [{"contactId": 1, "v": 2.0}], "pagination": {"page": 1}})), (2, None), (3, "[]")]
    found = graph.normalize_documents(spark.createDataFrame(payloads, "seq bigint, payload string"), REGISTRY).collect()
    assert [tuple(r) for r in found] == [(1, 0, "contact", "1", '{"contactId":1,"v":2}')]


def test_declared_payloads(spark):
    registry = {"order": Definition(id_field="o", relations={"who": Relation("who"), "lines": Relation("line", many=True)}), "who": Definition(id_field="w"), "line": Definition(get_id=lambda x: F.concat(F.lit("l"), x["n"]))}
    rows = [(1, 10.0, (5, "x"), [(1,), (2,)]), (2, 11.5, None, None), (3, None, (5, "y"), [])]
    df = spark.createDataFrame(rows, "seq bigint, o double, who struct<w:bigint,name:string>, lines array<struct<n:bigint>>")
    found = graph.normalize(df, "order", registry)
    assert sorted((r.entity_id, r.who.key if r.who else None, [x.key for x in r.lines] if r.lines is not None else None) for r in found["order"].collect()) == [("10", "who:5", ["line:l1", "line:l2"]), ("11.5", None, None)]
    assert sorted((r.seq, r.entity_id, r.name) for r in found["who"].collect()) == [(1, "5", "x"), (3, "5", "y")]
    assert sorted(r.entity_id for r in found["line"].collect()) == ["l1", "l2"]


def test_refs_have_a_whole_shape(spark):
    good = ref("contact", "1")
    values = [good, {**good, "id": 1}, {k: v for k, v in good.items() if k != "key"}, {**good, "__cdb_ref": "true"}, {**good, "__cdb_ref": False}, {"a": 1}, None, [good]]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, t string").select("i", F.parse_json("t").alias("d"))
    assert [r.r for r in df.select("i", graph.is_ref(F.col("d")).alias("r")).orderBy("i").collect()] == [True] + [False] * 7


def test_resolution(spark):
    people = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None), ("d", "zzz")], "id string, friend string")
    one = graph.resolve_one(people, "friend", people.select("id", F.upper("id").alias("name")), "id", "found")
    assert sorted((r.id, r.found.name if r.found else None) for r in one.collect()) == [("a", "B"), ("b", "A"), ("c", None), ("d", None)]
    lists = spark.createDataFrame([(1, ["b", "x", "a", "b"]), (2, []), (3, None)], "k int, refs array<string>")
    many = graph.resolve_many(lists, ["k"], "refs", people.select("id"), "id", "found")
    assert {r.k: None if r.found is None else [x.id if x else None for x in r.found] for r in many.collect()} == {1: ["b", None, "a", "b"], 2: [], 3: None}


def test_cycles_end(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "a string, b string")
    found = graph.reachable(edges, spark.createDataFrame([("a",)], "node string"), 10)
    assert sorted((r.reached, r.steps) for r in found.collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_schema():
    registry = {"a": Definition(id_field="id", fields={"n": "number", "t": {"type": "string", "description": "d"}}, relations={"b": Relation("b"), "c": Relation("c", many=True, description="x")}, description="e"), "b": Definition(get_id=len), "c": Definition(local=True)}
    schema = export_schema(registry, "key")
    assert schema["version"] == 1 and schema["defaultIdField"] == "key" and schema["entities"]["b"]["idField"] is None and schema["entities"]["b"]["computedId"]
    assert schema["entities"]["a"]["relations"] == {"b": {"entity": "b", "many": False}, "c": {"entity": "c", "many": True, "description": "x"}}
    assert schema["entities"]["c"]["local"] and json.loads(json.dumps(schema)) == schema
    scrubbed = scrub(schema, {"a", "b"})
    assert set(scrubbed["entities"]) == {"a", "b"} and set(scrubbed["entities"]["a"]["relations"]) == {"b"} and "c" in schema["entities"]
    kind = struct_type(schema["entities"]["a"])
    assert kind.simpleString() == "struct<n:double,t:string>" and exported(kind) == {"n": {"type": "number"}, "t": {"type": "string"}}


def test_typed_tables_resolve_all_the_way_down(spark):
    registry = {
        "order": Definition(id_field="o", relations={"customer": Relation("customer"), "lines": Relation("line", many=True)}),
        "customer": Definition(id_field="c", relations={"nation": Relation("nation"), "friend": Relation("customer")}),
        "nation": Definition(id_field="n"),
        "line": Definition(id_field="l", relations={"part": Relation("part")}),
    }
    ref = "struct<entity_type:string,id:string,key:string>"
    r = lambda t, i: None if i is None else (t, i, f"{t}:{i}")
    tables = {
        "order": spark.createDataFrame([("1", r("customer", "a"), [r("line", "x"), r("line", "gone"), r("line", "y")]), ("2", r("customer", "gone"), []), ("3", None, None)], f"entity_id string, customer {ref}, lines array<{ref}>"),
        "customer": spark.createDataFrame([("a", "Ann", r("nation", "N"), r("customer", "a"))], f"entity_id string, name string, nation {ref}, friend {ref}"),
        "nation": spark.createDataFrame([("N", "Land")], "entity_id string, name string"),
        "line": spark.createDataFrame([("x", 1, r("part", "p")), ("y", 2, None)], f"entity_id string, qty int, part {ref}"),
    }
    found = {x.entity_id: x.asDict(recursive=True) for x in denormalize(tables, "order", registry).collect()}
    assert found["1"]["customer"] == {"entity_id": "a", "name": "Ann", "nation": {"entity_id": "N", "name": "Land"}, "friend": {"entity_type": "customer", "id": "a", "key": "customer:a"}}
    assert [x and x["entity_id"] for x in found["1"]["lines"]] == ["x", None, "y"] and found["1"]["lines"][0]["part"]["key"] == "part:p"
    assert found["2"] == {"entity_id": "2", "customer": None, "lines": []} and found["3"] == {"entity_id": "3", "customer": None, "lines": None}


def wire(kind, id):
    return {"__cdb_ref": True, "entityType": kind, "id": id, "key": f"{kind}:{id}"}


def test_documents_resolve_with_cycles_and_missing_entities(spark):
    entities = {
        ("c", "1"): {"name": "Ann", "org": wire("o", "9"), "tags": [wire("t", "1"), wire("t", "none"), 3]},
        ("o", "9"): {"title": "Org", "boss": wire("c", "1"), "gone": wire("c", "none")},
        ("t", "1"): {"t": "x"},
        ("l", "1"): {"next": wire("l", "2")}, ("l", "2"): {"next": wire("l", "3")}, ("l", "3"): {"next": wire("l", "1")},
    }
    marked = {"__cdb_ref": True, "entityType": "c", "id": 1, "key": "c:1"}
    documents = {1: {"who": wire("c", "1"), "again": [wire("c", "1")]}, 2: wire("l", "1"), 3: {"plain": marked, "n": None}, 4: wire("none", "1"), 5: [wire("t", "none"), wire("t", "1")], 6: {"a": wire("t", "none")}}
    df = spark.createDataFrame([*((k, json.dumps(v)) for k, v in documents.items()), (7, None)], "row bigint, data string")
    rows = spark.createDataFrame([(*k, json.dumps(v)) for k, v in entities.items()], "entity_type string, id string, data string")
    found = {r.row: r.data and json.loads(r.data) for r in denormalize_documents(df, rows).collect()}
    tags = [{"t": "x"}, None, 3]
    ann = {"name": "Ann", "org": {"title": "Org", "boss": {**entities["c", "1"]}}, "tags": tags}
    assert found[1] == {"who": ann, "again": [ann]}
    assert found[2] == {"next": {"next": {"next": {"next": wire("l", "2")}}}}
    assert found[3] == documents[3] and found[4] is None and found[5] == [None, {"t": "x"}] and found[6] == {} and found[7] is None


def test_reference_codec(spark):
    df = spark.createDataFrame([(json.dumps(x),) for x in (wire("c", "1"), {**wire("c", "1"), "id": 1}, {"__cdb_ref": "true", **{k: "x" for k in ("entityType", "id", "key")}}, {"a": 1}, None)], "t string").withColumn("d", F.parse_json("t"))
    back = df.select("t", decode_ref(F.col("d")).alias("r")).withColumn("again", F.to_json(encode_ref(F.col("r")))).collect()
    assert [r.r and tuple(r.r) for r in back] == [("c", "1", "c:1"), None, None, None, None]
    assert json.loads(back[0].again) == wire("c", "1") and back[1].again is None
