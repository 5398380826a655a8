import json

import pytest

from tessera.operators.graph import Definition, Relation
from tessera.surface import QuerySurface, SurfaceConfigError, allowlist

REGISTRY = {"contact": Definition(id_field="id", relations={"org": Relation("organization"), "vault": Relation("secret")}), "organization": Definition(id_field="id"), "secret": Definition(local=True)}


@pytest.fixture(scope="module")
def surface(spark):
    rows = spark.createDataFrame([(str(i), "active" if i % 2 else "inactive", i if i % 5 else None) for i in range(30)], "id string, status string, age int")
    log = spark.createDataFrame([(i, "contact" if i % 3 else "secret", str(i % 4), "f") for i in range(20)], "seq int, entity_type string, id string, field string")
    return QuerySurface(lambda kind: rows, REGISTRY, ["contact", "organization"], log)


def test_query(surface):
    found = surface.query_entities({"entityType": "contact", "filter": {"op": "eq", "field": "status", "value": "active"}, "limit": 4})
    assert (found["count"], found["truncated"], found["untrusted"], found["scope"]) == (15, True, True, "memory-projection") and len(found["entities"]) == 4
    assert found["entities"][0] == {"id": "1", "data": {"id": "1", "status": "active", "age": 1}}
    whole = surface.query_entities({"entityType": "contact"})
    assert whole["count"] == 30 and not whole["truncated"] and json.dumps(whole)
    assert "age" not in next(e for e in whole["entities"] if e["id"] == "5")["data"]


@pytest.mark.parametrize(
    ("args", "code"),
    [
        ({"entityType": "contact", "sort": 1}, "INVALID_ARGUMENT"), ({}, "INVALID_ARGUMENT"), ({"entityType": ""}, "INVALID_ARGUMENT"), ({"entityType": 3}, "INVALID_ARGUMENT"),
        *(({"entityType": "contact", "limit": x}, "INVALID_ARGUMENT") for x in (0, 1_001, 1.5, "3", True)), ({"entityType": "secret", "limit": 0}, "INVALID_ARGUMENT"),
        ({"entityType": "secret"}, "TYPE_NOT_ALLOWED"), ({"entityType": "nonexistent"}, "TYPE_NOT_ALLOWED"), ({"entityType": "secret", "filter": {"op": "x"}}, "TYPE_NOT_ALLOWED"),
        ({"entityType": "contact", "filter": {"op": "like", "field": "a", "value": "x"}}, "INVALID_FILTER"), ({"entityType": "contact", "filter": "x"}, "INVALID_FILTER"),
    ],
)
def test_refusals(surface, args, code):
    found = surface.query_entities(args)
    assert found["isError"] and found["error"]["code"] == code
    if code == "INVALID_FILTER":
        assert found["error"]["matcher"]["path"].startswith("$")


def test_refusals_tell_nothing(surface):
    a, b = (surface.query_entities({"entityType": k})["error"]["message"].replace(k, "?") for k in ("secret", "nonexistent"))
    assert a == b


def test_history(surface):
    found = surface.read_history({"entityType": "contact", "limit": 3})
    assert found["truncated"] and [r["seq"] for r in found["rows"]] == [16, 17, 19] and found["count"] == 13
    one = surface.read_history({"entityType": "contact", "id": "1"})
    assert {r["id"] for r in one["rows"]} == {"1"} and not one["truncated"]
    for bad in ({"entityType": "contact", "id": ""}, {"entityType": "contact", "id": 1}, {"entityType": "contact", "filter": {}}):
        assert surface.read_history(bad)["error"]["code"] == "INVALID_ARGUMENT"
    assert surface.read_history({"entityType": "secret"})["error"]["code"] == "TYPE_NOT_ALLOWED"


def test_schema_is_scrubbed_and_frozen(surface):
    schema = surface.schema()
    assert set(schema["entities"]) == {"contact", "organization"} and set(schema["entities"]["contact"]["relations"]) == {"org"}
    schema["entities"].clear()
    assert surface.schema()["entities"] and surface.tools == ["query_entities", "read_history"]


@pytest.mark.parametrize("bad", ["contact", None, ["a", "a"], [""], [1], {"a"}])
def test_allowlists(bad):
    with pytest.raises(SurfaceConfigError):
        allowlist(bad)


def test_an_empty_allowlist_denies_all(spark):
    surface = QuerySurface(lambda kind: spark.range(3), {}, [])
    assert surface.query_entities({"entityType": "contact"})["error"]["code"] == "TYPE_NOT_ALLOWED" and surface.tools == ["query_entities"]
