"""More queries over the driver's tables, each with its SQL: engines, stores, persistence, transactions, sync and the
read surface by their handles, and what of the filter language and the wire needs no table."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import wire
from tessera.functions.matcher import CODES, M, MatcherParseError, Node, classify, parse, serialize
from tessera.operators import graph, history, hydration, sync, views
from tessera.operators.coordinator import Coordinator, Entry, Subscription, by_priority
from tessera.operators.graph import Definition, Relation
from tessera.operators.transactions import PolicyVeto, Transactions
from tessera.persistence import Persistence
from tessera.queries import GEOGRAPHY, KEYS, MEMBERS, REMOTE, SCHEMA, TX_FIELDS, geography, payloads, query, remote, some_keys, table, view_changes
from tessera.sources import durable, entities
from tessera.sources.rest import RestAdapter, WireError, push_sink
from tessera.sources.scratch import scratch, stored
from tessera.store import EntityStore
from tessera.streaming import live
from tessera.surface import QuerySurface, SurfaceConfigError

KEYED = "entity_type string, id string"


def documents_of(spark: SparkSession, sf_dir: str, name: str, key: str, *fields: str) -> DataFrame:
    """A table as entities of its name: key and data as JSON text."""
    rows = table(spark, sf_dir, name)
    return rows.select(F.lit(name).alias("entity_type"), F.col(key).cast("string").alias("id"), F.to_json(F.struct(*fields)).alias("data"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_of(spark, sf_dir, "nation", "n_nationkey", F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))


def number() -> Column:
    return F.col("id").cast("long")


def name() -> Column:
    return F.variant_get("data", "$.name", "string").alias("name")


def region() -> Column:
    return F.variant_get("data", "$.region", "long").alias("region")


# ---- sources ----


@query(f"SELECT k.entity_type, k.id, g.name FROM {KEYS} JOIN ({GEOGRAPHY}) g USING (entity_type, id)")
def boundary_point_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.lookup(geography(spark, sf_dir), some_keys(spark), phantoms=False).select("entity_type", "id", "name")


@query("SELECT r_regionkey::VARCHAR AS id, r_name AS name FROM region")
def boundary_type_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.of_type(geography(spark, sf_dir), "region").select("id", "name")


def supplier_batches(spark: SparkSession, sf_dir: str, backend) -> None:
    """All suppliers, then new rows for every third and no more of every fifth."""
    rows = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("entity_type"), F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("data"))
    backend.open()
    backend.write_batch(rows, rows.limit(0))
    backend.write_batch(rows.where((number() % 3 == 0) & (number() % 5 != 0)).withColumn("data", F.lit("new")), rows.where(number() % 5 == 0))


SUPPLIERS = "SELECT s_suppkey::VARCHAR AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE s_name END AS data, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS row_version FROM supplier WHERE s_suppkey % 5 <> 0"


@query(SUPPLIERS)
def engine_full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    backend = durable.ParquetBackend(spark, scratch(spark, "engine"), buckets=8)
    supplier_batches(spark, sf_dir, backend)
    return backend.load_all().select("id", "data", "row_version")


@query(f"SELECT * FROM ({SUPPLIERS}) WHERE id::BIGINT % 7 = 0")
def engine_keyed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    backend = durable.ParquetBackend(spark, scratch(spark, "engine"), buckets=8)
    supplier_batches(spark, sf_dir, backend)
    keys = table(spark, sf_dir, "supplier").where("s_suppkey % 7 = 0").select(F.lit("supplier").alias("entity_type"), F.col("s_suppkey").cast("string").alias("id"))
    return backend.load_many(keys.unionByName(spark.createDataFrame([("supplier", "none")], KEYED))).select("id", "data", "row_version")


@query(SUPPLIERS)
def engine_in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    backend = durable.MemoryBackend(spark)
    supplier_batches(spark, sf_dir, backend)
    return backend.snapshot().select("id", "data", "row_version")


@query("""SELECT * FROM (VALUES ('memory', false, true, 'entity_type,id,data,row_version,updated_at'), ('parquet', true, true, 'entity_type,id,data,row_version,updated_at'))
AS t(engine, persistent, supported, row_columns)""")
def engine_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    engines = {"memory": durable.MemoryBackend(spark), "parquet": durable.ParquetBackend(spark, scratch(spark, "engine"))}
    rows = []
    for name, engine in engines.items():
        engine.open()
        rows.append((name, engine.persistent, engine.is_supported() and entities.durable_storage(), ",".join(engine.load_all().columns)))
        engine.close()
    return spark.createDataFrame(rows, "engine string, persistent boolean, supported boolean, row_columns string")


@query("SELECT 2::BIGINT AS version, 1::BIGINT AS format, count(*) AS n FROM supplier WHERE s_suppkey % 5 <> 0")
def engine_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second handle, opened with retries and a deadline, has what the first wrote."""
    path = scratch(spark, "engine")
    supplier_batches(spark, sf_dir, durable.ParquetBackend(spark, path, buckets=8))
    again = durable.ParquetBackend(spark, path, attempts=2, gap=0.25, deadline=60)
    again.open()
    counted = again.load_all().agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.lit(again.version()).cast("long").alias("version"), F.lit(again.format_version()).cast("long").alias("format"), "n")


@query("""SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 4 <> 0 THEN 'region:' || n_regionkey END AS key, n_nationkey % 4 <> 0 AS whole FROM nation""")
def reference_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References through their stored form and back; an object that is marked but lacks a part is plain data."""
    region = F.col("n_regionkey").cast("string")
    struct = F.struct(F.lit("region").alias("entity_type"), region.alias("id"), F.concat(F.lit("region:"), region).alias("key"))
    broken = F.parse_json(F.lit('{"__cdb_ref":true,"entityType":"region","id":1,"key":"region:1"}'))
    rows = table(spark, sf_dir, "nation").withColumn("document", F.when(F.col("n_nationkey") % 4 == 0, broken).otherwise(graph.encode_ref(struct)))
    return rows.select(F.col("n_nationkey").cast("long").alias("id"), graph.decode_ref(F.col("document"))["key"].alias("key"), graph.is_ref(F.col("document")).alias("whole"))


@query("SELECT c_custkey::VARCHAR AS id, row_number() OVER (ORDER BY c_custkey) AS seq, (row_number() OVER (ORDER BY c_custkey) - 1) // 100 AS request, c_name AS name FROM customer")
def http_push_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client's outbox in requests of 100, as the server gets them."""
    seen = []

    def transport(url: str, headers: dict, body: bytes) -> tuple[int, bytes]:
        seen.append(json.loads(body)["changes"])
        return 200, json.dumps({"results": [{"mutationId": x["mutationId"], "status": "ack"} for x in seen[-1]]}).encode()

    rows = documents_of(spark, sf_dir, "customer", "c_custkey", F.col("c_name").alias("name"))
    place = F.row_number().over(Window.partitionBy("client_id").orderBy(number())).cast("long")
    outbox = rows.withColumns({"client_id": F.lit("c"), "op": F.lit("set"), "mutation_id": F.concat(F.lit("m-"), "id")}).withColumn("client_seq", place)
    push_sink(RestAdapter("http://server", transport=transport), most=100)(outbox, 0)
    told = [(x["id"], x["seq"], n, x["data"]["name"]) for n, batch in enumerate(seen) for x in batch]
    return spark.createDataFrame(told, "id string, seq bigint, request bigint, name string")


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name, (n_nationkey // 10)::BIGINT AS page FROM nation")
def http_pull_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of ten changes by cursor, until one is complete."""
    feed = [(r.id, json.loads(r.data)) for r in nations(spark, sf_dir).orderBy(number()).collect()]

    def transport(url: str, headers: dict, body: bytes) -> tuple[int, bytes]:
        at = int(json.loads(body)["cursor"] or 0)
        changes = [{"type": "set", "entityType": "nation", "id": i, "version": int(i) + 1, "data": d} for i, d in feed[at : at + 10]]
        return 200, json.dumps({"type": "changes", "changes": changes, "cursor": str(at + 10), "complete": at + 10 >= len(feed)}).encode()

    adapter, cursor, pages = RestAdapter("http://server", transport=transport), None, []
    while not pages or not pages[-1]["complete"]:
        pages.append(adapter.pull(cursor))
        cursor = pages[-1]["cursor"]
    rows = [(x["id"], x["data"]["name"], n) for n, page in enumerate(pages) for x in page["changes"]]
    return spark.createDataFrame(rows, "id string, name string, page bigint")


@query("SELECT * FROM (VALUES (200, 'answer'), (401, 'permanent'), (408, 'transient'), (409, 'schema'), (503, 'transient'), (0, 'transient'), (299, 'malformed')) AS t(status, told)")
def http_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the adapter makes of statuses, of no answer and of one that is no page."""
    page = json.dumps({"type": "changes", "changes": [], "cursor": "c", "complete": True}).encode()
    rows = []
    for status in (200, 401, 408, 409, 503, 0, 299):

        def transport(url: str, headers: dict, body: bytes, status: int = status) -> tuple[int, bytes]:
            if not status:
                raise WireError("transient", "no answer")
            return status, page if status == 200 else b"<html>"

        try:
            RestAdapter("http://server", transport=transport).pull(None)
            rows.append((status, "answer"))
        except WireError as error:
            rows.append((status, "malformed" if "malformed" in str(error) else error.outcome))
    return spark.createDataFrame(rows, "status int, told string")


# ---- the filter language ----

EQ = {"op": "eq", "field": "a", "value": 1}


def deep(levels: int) -> dict:
    node: dict = EQ
    for _ in range(levels - 1):
        node = {"op": "not", "node": node}
    return node


REFUSED = {
    "no object": 3, "no operator": {"op": "like", "field": "a", "value": "x"}, "reserved field": {"op": "eq", "field": "__proto__", "value": 1}, "empty field": {"op": "eq", "field": "", "value": 1},
    "list for a value": {"op": "eq", "field": "a", "value": [1]}, "order of truths": {"op": "gt", "field": "a", "value": True}, "no list": {"op": "in", "field": "a", "values": 1},
    "long list": {"op": "in", "field": "a", "values": [1] * 10_001}, "no nodes": {"op": "and", "nodes": 1}, "further key": {"op": "and", "nodes": [EQ, {**EQ, "x": 1}]},
    "too deep": deep(33), "too much": {"op": "or", "nodes": [{"op": "in", "field": "a", "values": list(range(10_000))}] * 7}, "fine": deep(32),
}


@query("""SELECT * FROM (VALUES ('no object', 'not-a-node', '$'), ('no operator', 'unknown-operator', '$.op'), ('reserved field', 'invalid-field', '$.field'), ('empty field', 'invalid-field', '$.field'),
('list for a value', 'invalid-value', '$.value'), ('order of truths', 'invalid-value', '$.value'), ('no list', 'invalid-list', '$.values'), ('long list', 'list-too-large', '$.values'),
('no nodes', 'invalid-nodes', '$.nodes'), ('further key', 'unexpected-key', '$.nodes[1].x'), ('too deep', 'depth-exceeded', NULL), ('too much', 'budget-exceeded', NULL), ('fine', NULL, NULL)) AS t(input, code, path)""")
def filter_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name, raw in REFUSED.items():
        try:
            parse(raw)
            rows.append((name, None, None))
        except MatcherParseError as error:
            assert error.code in CODES
            rows.append((name, error.code, None if error.code.endswith("exceeded") else error.path))
    return spark.createDataFrame(rows, "input string, code string, path string")


@query("""SELECT * FROM (VALUES ('{"field":"a","op":"eq","value":1}', true), ('{"field":"ä","op":"in","values":[null,true,"x",0.5,1e+21]}', true),
('{"nodes":[{"field":"a","op":"exists","value":false},{"node":{"field":"b","op":"lt","value":-2},"op":"not"}],"op":"and"}', true)) AS t(text, same)""")
def filter_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical text of a tree, and whether the tree read from it is the same."""
    nodes = [M.eq("a", 1.0), M.in_("ä", [None, True, "x", 0.5, 1e21]), M.and_(M.exists("a", False), M.not_(M.lt("b", -2)))]
    return spark.createDataFrame([(serialize(n), parse(json.loads(serialize(n))) == parse(n)) for n in nodes], "text string, same boolean")


@query("""SELECT * FROM (VALUES ('tree', 'encodable'), ('function', 'function-filter'), ('text', 'not-a-node at $'), ('unknown', 'unknown-operator at $.op')) AS t(input, told)""")
def filter_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a view can do with a filter; one that is neither a tree nor a function is refused when the view is made."""
    rows = []
    for name, raw in {"tree": EQ, "function": lambda row: True, "text": "a = 1", "unknown": {"op": "regex"}}.items():
        found = classify(raw)
        rows.append((name, "encodable" if isinstance(getattr(found, "node", None), Node) else found.reason))
    refused = 0
    for raw in ("a = 1", {"op": "regex"}):
        try:
            live.live_view(table(spark, sf_dir, "events"), raw)
        except ValueError:
            refused += 1
    assert refused == 2
    return spark.createDataFrame(rows, "input string, told string")


# ---- graphs ----

DEEP = {
    "order": Definition(id_field="o_orderkey", relations={"customer": Relation("customer"), "lines": Relation("line", many=True)}),
    "customer": Definition(id_field="c_custkey", relations={"nation": Relation("nation")}),
    "nation": Definition(id_field="n_nationkey", relations={"region": Relation("region")}),
    "region": Definition(id_field="r_regionkey"),
    "line": Definition(get_id=lambda x: F.concat_ws("-", x["l_orderkey"], x["l_linenumber"])),
}


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, max(l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber) AS q FROM lineitem),
g AS (SELECT l_orderkey, count(*) AS n_places, count(*) FILTER (l_linenumber <> 3) AS n_lines, sum(q) FILTER (l_linenumber <> 3) AS quantity FROM l GROUP BY l_orderkey)
SELECT o_orderkey::VARCHAR AS id, c_name AS customer, n_name AS nation, r_name AS region, coalesce(n_lines, 0) AS n_lines, coalesce(n_places, 0) AS n_places, quantity
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 10 <> 0 LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN g ON l_orderkey = o_orderkey""")
def denormalize_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders all the way down to regions and lines; every tenth customer and every third line is missing."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nation = nation.select("n_nationkey", F.struct("n_nationkey", "n_name", F.struct("r_regionkey", "r_name").alias("region")).alias("nation"))
    customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    customer = customer.select(F.col("c_custkey").alias("key"), F.struct("c_custkey", "c_name", "nation").alias("customer"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_quantity"))).alias("lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(customer, F.col("o_custkey") == F.col("key"), "left")
    found = graph.normalize(orders.select(F.col("o_orderkey").alias("seq"), "o_orderkey", "customer", "lines"), "order", DEEP)
    tables = {name: rows.drop("seq").dropDuplicates(["entity_id"]) for name, rows in found.items()}
    tables["customer"] = tables["customer"].where(F.col("entity_id").cast("long") % 10 != 0)
    line = found["line"].groupBy("entity_id").agg(F.max("l_linenumber").alias("l_linenumber"), F.max("l_quantity").alias("l_quantity"))
    tables["line"] = line.where("l_linenumber <> 3")
    rows = graph.denormalize(tables, "order", DEEP)
    there = F.filter("lines", lambda x: x.isNotNull())
    quantity = F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x["l_quantity"].cast("double")))
    n = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return rows.select(
        F.col("entity_id").alias("id"), F.col("customer.c_name").alias("customer"), F.col("customer.nation.n_name").alias("nation"), F.col("customer.nation.region.r_name").alias("region"),
        n(there).alias("n_lines"), n(F.col("lines")).alias("n_places"), quantity.alias("quantity"),
    )


def wire_ref(kind: str, id: Column) -> Column:
    id = id.cast("string")
    return F.struct(F.lit(True).alias(graph.REF_MARK), F.lit(kind).alias("entityType"), id.alias("id"), F.concat(F.lit(f"{kind}:"), id).alias("key"))


@query("""SELECT c_custkey::BIGINT AS "row", n_name AS nation, CASE WHEN n_regionkey <> 2 THEN r_name END AS region, CASE WHEN n_regionkey <> 2 THEN r_name END AS first_of_list, 2::BIGINT AS n_list
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def denormalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of customers: a nation, its region, and a list of the region and something else. Region 2 is missing."""
    region = documents_of(spark, sf_dir, "region", "r_regionkey", F.col("r_name").alias("name")).where("id <> '2'")
    ref = wire_ref("region", F.col("n_regionkey"))
    nation = documents_of(spark, sf_dir, "nation", "n_nationkey", F.col("n_name").alias("name"), ref.alias("region"), F.array(F.to_json(ref)).alias("none"), F.array(ref).alias("list"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("row"), F.to_json(F.struct(wire_ref("nation", F.col("c_nationkey")).alias("nation"), F.lit("x").alias("plain"))).alias("data"))
    found = graph.denormalize_documents(customers, nation.unionByName(region))
    at = lambda path: F.get_json_object("data", path)
    n = F.size(F.from_json(at("$.nation.none"), "array<string>")) + F.size(F.from_json(at("$.nation.list"), "array<string>"))
    return found.select("row", at("$.nation.name").alias("nation"), at("$.nation.region.name").alias("region"), at("$.nation.list[0].name").alias("first_of_list"), n.cast("long").alias("n_list"))


@query("""WITH RECURSIVE r AS (SELECT n_nationkey AS origin, n_nationkey AS node, [n_nationkey] AS path FROM nation UNION ALL
SELECT origin, (node * 2) % 25, list_append(path, (node * 2) % 25) FROM r WHERE NOT list_contains(path, (node * 2) % 25))
SELECT origin::BIGINT AS "row", (max(len(path)) + 1)::BIGINT AS n_entities FROM r GROUP BY origin""")
def denormalize_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation leads to another, round and round: one inside itself stays as it is stored."""
    next_ = wire_ref("nation", F.col("n_nationkey") * 2 % 25)
    rows = documents_of(spark, sf_dir, "nation", "n_nationkey", F.col("n_name").alias("name"), next_.alias("next"))
    starts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("row"), F.to_json(wire_ref("nation", F.col("n_nationkey"))).alias("data"))
    found = graph.denormalize_documents(starts, rows)
    return found.select("row", F.regexp_count("data", F.lit('"name"')).cast("long").alias("n_entities"))


@query("""SELECT 'order' AS entity_type, o_orderkey::VARCHAR AS id, 'merge' AS op, 1::BIGINT AS wave FROM orders UNION ALL
SELECT 'customer', c_custkey::VARCHAR, 'set', 0 FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def write_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted entities as writes: types that merge by themselves come after all others."""
    registry = {"order": Definition(id_field="o_orderkey", merge=lambda a, b: b), "customer": Definition(id_field="c_custkey")}
    rows = payloads(spark, sf_dir).select(F.col("seq").cast("long").alias("seq"), F.to_json(F.struct("o_orderkey", "customer")).alias("payload"))
    found = graph.write_order(graph.normalize_documents(rows, registry), registry)
    return found.select("entity_type", "id", "op", F.col("seq.wave").cast("long").alias("wave")).distinct()


@query("""SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN greatest(o_totalprice, 100000.0::DOUBLE) WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 100000.0::DOUBLE END AS price
FROM (SELECT o_orderkey, o_totalprice::DOUBLE AS o_totalprice FROM orders) WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def custom_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge of one's own: the greater price wins where there are two."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").cast("double").alias("price"))
    incoming = rows.where(number() % 3 == 0).withColumn("price", F.lit(100_000.0))
    return graph.merged(rows.where(number() % 2 == 0), incoming, ["id"], lambda a, b: {"price": F.greatest(a["price"], b["price"])})


# ---- values ----


@query("""SELECT p_partkey::BIGINT AS id, length('{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '"}')::BIGINT AS bytes FROM part""")
def json_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), history.row_bytes("p_partkey", "p_name").alias("bytes"))


@query("SELECT '5-' || event_id || '-c' || (user_id % 4) AS mutation_id FROM events")
def mutation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    client = F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string"))
    return table(spark, sf_dir, "events").select(wire.mutation_id(F.lit(5), F.col("event_id"), client).alias("mutation_id"))


@query(f"""WITH {REMOTE}, r AS (SELECT id, max(arrival) AS gone FROM ac WHERE op = 'remove' GROUP BY id)
SELECT ac.id, count(*) AS gen, arg_max(op, arrival) = 'remove' AS removed, arg_max(last_event, arrival) FILTER (last_event IS NOT NULL AND (gone IS NULL OR arrival > gone)) AS last_event,
arg_max(value, arrival) FILTER (value IS NOT NULL AND (gone IS NULL OR arrival > gone)) AS value FROM ac LEFT JOIN r USING (id) GROUP BY ac.id""")
def server_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The server's truth of each key, patch over patch, and how often it wrote."""
    return sync.shadow(sync.accepted(remote(spark, sf_dir)), TX_FIELDS, order="arrival").select("id", "gen", "removed", *TX_FIELDS)


# ---- views and streams ----


@query(f"""WITH {MEMBERS}, sd AS (SELECT DISTINCT user_id::VARCHAR AS id, user_id AS pos FROM events WHERE user_id % 4 = 0),
u AS (SELECT id, -1000000 + pos AS seq, 'add' AS delta FROM sd UNION ALL SELECT id, seq, delta FROM dl)
SELECT id, row_number() OVER (ORDER BY max(CASE WHEN delta = 'add' THEN seq END)) AS place FROM u GROUP BY id HAVING arg_max(delta, seq) = 'add'""")
def view_seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds first, as they were scanned; later entries after them."""
    seeds = table(spark, sf_dir, "events").where("user_id % 4 = 0").select(F.lit("user").alias("entity_type"), F.col("user_id").cast("string").alias("id"), F.col("user_id").cast("long").alias("seed_pos")).distinct()
    found = views.members(view_changes(spark, sf_dir), seeds=seeds)
    return found.select("id", F.row_number().over(Window.orderBy("entered")).cast("long").alias("place"))


@query("SELECT true AS same, false AS fewer, false AS twice")
def view_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = geography(spark, sf_dir).select("entity_type", "id")
    told = views.same(rows, rows.orderBy("id")), views.same(rows, rows.where("id <> '3'")), views.same(rows, rows.unionByName(rows.where("id = '3'")))
    return spark.createDataFrame([told], "same boolean, fewer boolean, twice boolean")


@query(f"WITH {MEMBERS} SELECT id, 'held' AS told FROM vm UNION ALL SELECT id, 'missing' FROM vm WHERE id::BIGINT % 5 = 0 UNION ALL SELECT '100000', 'extra'")
def view_healed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view that has lost some members and has one too many: what the guard reports, and what is held after it."""
    truth = stored(views.members(view_changes(spark, sf_dir)).select("entity_type", "id"), "truth")
    held, told = [truth.where(number() % 5 != 0).unionByName(spark.createDataFrame([("user", "100000")], KEYED))], []
    live.guarded(lambda: truth, lambda: held[0], told.append, lambda right: held.__setitem__(0, right))(truth, 0)
    return held[0].select("id", F.lit("held").alias("told")).unionByName(told[0].select("id", F.col("divergence").alias("told")))


@query("SELECT p_partkey::VARCHAR AS id FROM part WHERE p_size > 25")
def view_opaque_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view by a closure, scanned again once for a batch of its type and not for another's."""
    rows = table(spark, sf_dir, "part").select(F.lit("part").alias("entity_type"), F.col("p_partkey").cast("string").alias("id"), "p_size")
    out: list[DataFrame] = []
    sink = live.rescanned(lambda: rows, lambda row: row["p_size"] > 25, ["part"], out.append)
    sink(geography(spark, sf_dir), 0)
    sink(rows, 1)
    assert len(out) == 1
    return out[0].select("id")


@query("SELECT 'every' AS listener, count(*) AS n FROM events UNION ALL SELECT 'clicks', count(*) FROM events WHERE event_type = 'click' UNION ALL SELECT 'one', count(*) FROM events WHERE event_type = 'click' AND user_id = 7 UNION ALL SELECT 'failed', 1")
def listener_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listeners of everything, of a type and of a key; one that fails stops no other."""
    rows, told = table(spark, sf_dir, "events").select(F.col("event_type").alias("entity_type"), F.col("user_id").cast("string").alias("id")), []
    boundary = live.Boundary(lambda error: told.append(("failed", 1)))
    boundary.subscribe(lambda batch, _: told.append(("one", batch.count())), "click", "7")
    boundary.subscribe(lambda batch, _: 1 / 0)
    boundary.subscribe(lambda batch, _: told.append(("clicks", batch.count())), "click")
    boundary.subscribe(lambda batch, _: told.append(("every", batch.count())))
    boundary.sink(rows, 0)
    return spark.createDataFrame(told, "listener string, n bigint")


@query("SELECT 1::BIGINT AS flush, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 UNION ALL SELECT 2, count(*) FROM lineitem WHERE l_linenumber = 4")
def coalesced_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches go on together when the delay is over, a fourth when asked; nothing gathered makes no call."""
    now, told = [0.0], []
    one = live.Coalescer(lambda batch: told.append((len(told) + 1, batch.count())), delay=1, clock=lambda: now[0])
    lines = table(spark, sf_dir, "lineitem")
    for number, at in ((1, 0.0), (2, 0.5), (3, 1.5)):
        now[0] = at
        one.add(lines.where(F.col("l_linenumber") == number))
    one.flush()
    one.add(lines.where("l_linenumber = 4"))
    one.flush()
    one.flush()
    return spark.createDataFrame(told, "flush bigint, n bigint")


# ---- the store ----


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'late' END AS note FROM customer WHERE c_custkey % 7 <> 0")
def store_set_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of sets, a batch of patches over some, a batch of removals."""
    store = EntityStore(spark)
    rows = documents_of(spark, sf_dir, "customer", "c_custkey", F.col("c_name").alias("name"))
    store.set_many(rows)
    store.compact()
    store.set_many(rows.where(number() % 3 == 0).withColumn("data", F.lit('{"note":"late"}')))
    store.write(rows.where(number() % 7 == 0).select("entity_type", "id"), "remove")
    return store.get_by_type("customer").select("id", name(), F.variant_get("data", "$.note", "string").alias("note"))


@query("SELECT n_nationkey::VARCHAR AS id, CASE n_nationkey % 3 WHEN 0 THEN 'agent' WHEN 1 THEN 'undo' END AS origin, CASE n_nationkey % 3 WHEN 0 THEN 'tx-1' END AS tx_id FROM nation")
def store_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inner context takes the place of the outer one, whole."""
    store, rows = EntityStore(spark), nations(spark, sf_dir)
    with store.run_with("agent", "tx-1"):
        store.set_many(rows.where(number() % 3 == 0))
        with store.run_with("undo"):
            store.set_many(rows.where(number() % 3 == 1))
    store.set_many(rows.where(number() % 3 == 2))
    return store.log().select("id", "origin", "tx_id")


@query("SELECT * FROM (VALUES (1::BIGINT, 'first', 25::BIGINT), (2, 'second', 25), (3, 'first', 5), (4, 'second', 5)) AS t(place, listener, n)")
def store_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listener that writes is told of it after all have been told of the batch before."""
    store, told = EntityStore(spark), []
    region = documents_of(spark, sf_dir, "region", "r_regionkey", F.col("r_name").alias("name"))

    def first(batch: DataFrame) -> None:
        told.append(("first", batch.count()))
        if len(told) == 1:
            store.set_many(region)

    store.subscribe(first)
    store.subscribe(lambda batch: told.append(("second", batch.count())))
    store.set_many(nations(spark, sf_dir))
    return spark.createDataFrame([(i + 1, *x) for i, x in enumerate(told)], "place bigint, listener string, n bigint")


@query("SELECT 'every' AS listener, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n UNION ALL SELECT 'region', count(*) FROM region")
def store_listeners(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, told = EntityStore(spark), {"every": 0, "region": 0}

    def count(name: str):
        return lambda batch: told.__setitem__(name, told[name] + batch.count())

    store.subscribe(count("every"))
    store.subscribe(count("region"), "region")
    stop = store.subscribe(lambda batch: 1 / 0)
    stop()
    store.set_many(nations(spark, sf_dir))
    store.set_many(documents_of(spark, sf_dir, "region", "r_regionkey", F.col("r_name").alias("name")))
    return spark.createDataFrame(list(told.items()), "listener string, n bigint")


@query("SELECT 1::BIGINT AS told, count(*) AS n FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 2, count(*) FROM nation WHERE n_regionkey IN (1, 2)")
def store_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query that is told again when what it gives changes, and only then."""
    store, told = EntityStore(spark), []
    rows = nations(spark, sf_dir)
    store.set_many(rows)
    store.watch("nation", M.eq("region", 2), lambda found: told.append((len(told) + 1, found.count())))
    store.set_many(rows.where(F.get_json_object("data", "$.region") == "3"))
    store.set_many(rows.where(F.get_json_object("data", "$.region") == "1").withColumn("data", F.lit('{"region":2}')))
    return spark.createDataFrame(told, "told bigint, n bigint")


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 9 ELSE n_regionkey END::BIGINT AS region, CASE WHEN n_nationkey < 5 THEN 1 ELSE 0 END::BIGINT AS held FROM nation WHERE n_nationkey <> 24")
def store_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another handle on the same path: log, base and holds."""
    path, rows = scratch(spark, "store"), nations(spark, sf_dir)
    store = EntityStore(spark, path)
    store.set_many(rows)
    store.compact()
    store.set_many(rows.where(number() % 2 == 0).withColumn("data", F.lit('{"region":9}')))
    store.write(rows.where("id = '24'").select("entity_type", "id"), "evict")
    store.retain(rows.where(number() < 5).select("entity_type", "id"))
    again = EntityStore(spark, path)
    held = again.counts().select("id", F.col("n").alias("held"))
    return again.entities().join(held, "id", "left").select("id", name(), region(), F.coalesce("held", F.lit(0)).cast("long").alias("held"))


# ---- persistence ----


def persisted(spark: SparkSession, backend) -> DataFrame:
    rows = backend.load_all().where("entity_type = 'nation'").withColumn("data", F.parse_json("data"))
    return rows.select("id", name(), region(), F.variant_get("data", "$.note", "string").alias("note"))


@query("""SELECT n_nationkey::VARCHAR AS id, n_name AS name, n_regionkey::BIGINT AS region, CASE WHEN n_nationkey % 2 = 0 THEN 'patched' END AS note FROM nation WHERE n_nationkey % 5 <> 1
UNION ALL SELECT n_nationkey::VARCHAR, NULL, NULL, 'after eviction' FROM nation WHERE n_nationkey % 5 = 1 AND n_nationkey < 10""")
def persistence_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are images: patches merge, evictions delete nothing, a write after one starts anew, removals delete."""
    backend, store, rows = durable.ParquetBackend(spark, scratch(spark, "engine"), buckets=4), EntityStore(spark), nations(spark, sf_dir)
    with Persistence(store, backend) as kept:
        store.set_many(rows)
        kept.flush()
        store.set_many(rows.where(number() % 2 == 0).withColumn("data", F.lit('{"note":"patched"}')))
        store.write(rows.where(number() % 5 == 1).select("entity_type", "id"), "evict")
        kept.flush()
        store.set_many(rows.where((number() % 5 == 1) & (number() < 10)).withColumn("data", F.lit('{"note":"after eviction"}')))
        store.write(rows.where((number() % 5 == 1) & (number() >= 10)).select("entity_type", "id"), "remove")
    return persisted(spark, backend)


@query("SELECT n_nationkey::VARCHAR AS id FROM nation WHERE n_nationkey % 2 = 0")
def persistence_skips_hydration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes from the engine isn't written back to it."""
    behind = durable.WriteBehind(durable.MemoryBackend(spark))
    rows = nations(spark, sf_dir)
    origin = F.when(number() % 2 == 0, "local-mutation").otherwise("hydration")
    behind.add(rows.select(number().alias("seq"), F.lit("set").alias("op"), "entity_type", "id", "data", origin.alias("origin")))
    behind.flush()
    return behind.backend.load_all().select("id")


@query("SELECT * FROM (VALUES (1::BIGINT, false, false, 0::BIGINT, 1::BIGINT), (2, true, true, 25, 1), (3, true, true, 25, 1)) AS t(step, durable, enabled, n, errors)")
def persistence_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failed flush is told and keeps what it had; the next one writes it; with nothing to write all is durable."""
    backend, errors, told = durable.MemoryBackend(spark), [], []
    write = backend.write_batch
    behind = durable.WriteBehind(backend, errors.append)
    behind.add(nations(spark, sf_dir).select(number().alias("seq"), F.lit("set").alias("op"), "entity_type", "id", "data", F.lit("x").alias("origin")))

    def broken(*_: DataFrame) -> None:
        raise OSError("disk")

    for step, action in enumerate((broken, write, write)):
        backend.write_batch = action
        told.append((step + 1, behind.flush(), behind.enabled, backend.load_all().count(), len(errors)))
    return spark.createDataFrame(told, "step bigint, durable boolean, enabled boolean, n bigint, errors bigint")


@query("""SELECT n_nationkey::VARCHAR AS id, n_name AS name, n_regionkey::BIGINT AS region, CASE WHEN n_nationkey % 3 = 0 THEN 'committed' END AS note FROM nation""")
def persistence_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of a transaction reach the engine when it commits, and never else."""
    backend, store, rows = durable.ParquetBackend(spark, scratch(spark, "engine"), buckets=4), EntityStore(spark), nations(spark, sf_dir)
    with Persistence(store, backend):
        store.set_many(rows)
        tx = Transactions(store)
        for rest, note in enumerate(("committed", "rolled back", "open")):
            one = tx.begin()
            with store.run_with("local-mutation", one):
                store.set_many(rows.where(number() % 3 == rest).withColumn("data", F.lit(json.dumps({"note": note}))))
            if rest < 2:
                (tx.commit if rest == 0 else tx.rollback)(one)
    return persisted(spark, backend)


def manifest_engine(spark: SparkSession, sf_dir: str):
    """An engine with the nations, and a scope for each of the regions 0, 1 and 2 with those of its nations."""
    backend, store, rows = durable.ParquetBackend(spark, scratch(spark, "engine"), buckets=4), EntityStore(spark), nations(spark, sf_dir)
    with Persistence(store, backend) as kept:
        store.set_many(rows)
        for region in range(3):
            kept.set_manifest(f"region-{region}", rows.where(F.get_json_object("data", "$.region") == str(region)))
    return backend


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name, 1::BIGINT AS held FROM nation WHERE n_regionkey < 3")
def persistence_boot_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = EntityStore(spark)
    Persistence(store, manifest_engine(spark, sf_dir), hydration="manifest")
    return store.entities().join(store.counts(), ["entity_type", "id"], "left").select("id", name(), F.col("n").alias("held"))


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name FROM nation")
def persistence_boot_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entities, and none of the manifests' rows."""
    store = EntityStore(spark)
    Persistence(store, manifest_engine(spark, sf_dir))
    return store.entities().select("id", name())


@query("""SELECT 'one scope' AS step, (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS n UNION ALL SELECT 'all scopes', (SELECT count(*) FROM nation WHERE n_regionkey IN (0, 2))
UNION ALL SELECT 'again', 0 UNION ALL SELECT 'pending', 1""")
def persistence_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What evicted scopes bring back, alone and together; what was never flushed comes from the pending writes."""
    store = EntityStore(spark)
    kept = Persistence(store, manifest_engine(spark, sf_dir), hydration="manifest")
    store.write(store.entities().select("entity_type", "id"), "evict")
    told = [("one scope", kept.hydrate_scope("region-1")), ("all scopes", kept.preload()), ("again", kept.preload())]
    kept.set_manifest("new", spark.createDataFrame([("nation", "new")], KEYED))
    store.set("nation", "new", {"name": "never flushed"})
    store.evict("nation", "new")
    told.append(("pending", kept.hydrate_scope("new")))
    return spark.createDataFrame(told, "step string, n bigint")


@query("SELECT n_nationkey::VARCHAR AS id, n_regionkey = 2 AS evicted FROM nation WHERE n_regionkey < 3")
def persistence_remove_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scope that goes releases what it pinned; what nothing else pins is evicted, once it is durable."""
    store = EntityStore(spark)
    kept = Persistence(store, manifest_engine(spark, sf_dir), hydration="manifest")
    gone = spark.createDataFrame([(x.split(":", 1)[1],) for x in kept.remove_manifest("region-2")], "id string").withColumn("evicted", F.lit(True))
    return store.entities().select("id", F.lit(False).alias("evicted")).unionByName(gone)


@query("SELECT 'region-' || n_regionkey AS scope_id, count(*) AS n_hydrated FROM nation WHERE n_nationkey % 2 = 0 GROUP BY n_regionkey")
def hydrated_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0")
    return hydration.totals(rows.select(F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("scope_id")))


# ---- transactions ----


@query("""SELECT 'tx-' || (n_nationkey + 1) AS tx_id, n_nationkey::VARCHAR AS id, CASE WHEN n_regionkey = 1 THEN 'rollback' WHEN n_regionkey <> 2 THEN 'commit' END AS outcome FROM nation""")
def tx_handle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One handle for a store: a transaction for each nation, some settled, told in order."""

    class Store:
        pass

    store, told = Store(), []
    tx = Transactions(store)
    assert Transactions(store) is tx
    tx.on_settled(lambda tx_id, outcome: told.append((tx_id, outcome)))
    for r in nations(spark, sf_dir).orderBy(number()).collect():
        own = tx.begin()
        data = json.loads(r.data)
        tx.set(own, "nation", r.id, data)
        if data["region"] != 2:
            (tx.rollback if data["region"] == 1 else tx.commit)(own)
    log, settled = tx.tables(spark)
    assert told == [tuple(r) for r in settled.orderBy("settle_seq").select("tx_id", "outcome").collect()]
    return log.join(settled, "tx_id", "left").select("tx_id", "id", "outcome")


@query("""SELECT n_nationkey::VARCHAR AS id, CASE WHEN n_regionkey = 0 THEN 'apply' WHEN n_regionkey = 1 THEN 'commit' END AS vetoed_at, CASE WHEN n_regionkey < 2 THEN 'rollback' ELSE 'commit' END AS outcome FROM nation""")
def tx_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions in one call: a gate on writes refuses region 0, one on the whole refuses region 1; both settle themselves."""

    class Store:
        pass

    store = Store()
    tx, rows = Transactions(store), []
    tx.use_gate(will_apply=lambda write: write[3]["region"] != 0, will_commit=lambda net: all(x["region"] != 1 for x in net.values()))
    for r in nations(spark, sf_dir).orderBy(number()).collect():
        vetoed = None
        try:
            tx.apply([("set", "nation", r.id, json.loads(r.data))])
        except PolicyVeto as veto:
            vetoed = veto.phase
        rows.append((r.id, vetoed, tx.outcomes[f"tx-{tx.count}"][0]))
    return spark.createDataFrame(rows, "id string, vetoed_at string, outcome string")


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 7 ELSE n_regionkey END::BIGINT AS region FROM nation")
def tx_store_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after two transactions over the same nations, one rolled back: what was, and the other's writes again."""
    store, rows = EntityStore(spark), nations(spark, sf_dir)
    store.set_many(rows)
    tx = Transactions(store)
    gone, kept = tx.begin(), tx.begin()
    with store.run_with("local-mutation", gone):
        store.set_many(rows.withColumn("data", F.lit('{"name":"x","region":0}')))
    with store.run_with("local-mutation", kept):
        store.set_many(rows.where(number() % 2 == 0).withColumn("data", F.lit('{"region":7}')))
    with store.run_with("local-mutation", gone):
        store.write(rows.where(number() < 10).select("entity_type", "id"), "remove")
    tx.rollback(gone)
    return store.entities().select("id", name(), region())


# ---- sync ----


class Script:
    """A server that answers in turn; an exception is raised."""

    def __init__(self, pages: tuple = (), answers: tuple = ()) -> None:
        self.pages, self.answers, self.asked, self.pushed = list(pages), list(answers), [], []

    def pull(self, cursor: str | None, subscription: str | None) -> dict:
        self.asked.append((cursor, subscription))
        return self._next(self.pages)

    def push(self, batch: list[dict]) -> list[dict]:
        self.pushed.append([x["mutationId"] for x in batch])
        answer = self._next(self.answers)
        return [told for x in batch if (told := answer(x)) is not None]

    @staticmethod
    def _next(script: list):
        found = script.pop(0)
        if isinstance(found, Exception):
            raise found
        return found


def ack(change: dict) -> dict:
    return {"mutationId": change["mutationId"], "status": "ack", "version": 1}


def synced(spark: SparkSession, sf_dir: str, server: Script, **settings) -> tuple[EntityStore, Coordinator]:
    """A store with the nations, and a local mutation of each that takes it to region 9."""
    store, rows = EntityStore(spark), nations(spark, sf_dir)
    store.set_many(rows)
    one = Coordinator(spark, server, store=store, client_id="me", chance=lambda: 0.5, pause=lambda ms: None, **settings)
    with store.run_with("local-mutation"):
        store.set_many(rows.orderBy(number()).coalesce(1).withColumn("data", F.lit('{"region":9}')))
    return store, one


def changes_page(*changes: tuple, cursor: str = "c", complete: bool = True, **more: object) -> dict:
    return {"type": "changes", "changes": [{"type": t, "entityType": k, "id": i, "version": v, "data": d} for t, k, i, v, d in changes], "cursor": cursor, "complete": complete, **more}


@query("""SELECT 1::BIGINT AS request, 'm' AS kind, n_nationkey::VARCHAR AS id FROM nation UNION ALL SELECT 2, 'm', n_nationkey::VARCHAR FROM nation UNION ALL SELECT 3, 'm', n_nationkey::VARCHAR FROM nation WHERE n_nationkey % 2 = 1""")
def sync_push_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that isn't pushed, in order: again after a failure, and then what got no answer."""
    server = Script(answers=(WireError("transient", "x"), lambda x: ack(x) if int(x["id"]) % 2 == 0 else None, ack))
    _, one = synced(spark, sf_dir, server)
    ids = {e.mutation_id: e.id for e in one.outbox}
    one.push()
    one.run()
    one.push()
    assert one.push() and all(e.pushed for e in one.outbox) and [ids[m] for m in server.pushed[0]] == sorted(ids.values(), key=int)
    return spark.createDataFrame([(n + 1, "m", ids[m]) for n, batch in enumerate(server.pushed) for m in batch], "request bigint, kind string, id string")


@query("""SELECT n_nationkey::VARCHAR AS id, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN n_regionkey WHEN n_nationkey % 3 = 1 THEN 9 ELSE 100 END::BIGINT AS region, n_nationkey % 3 <> 0 AS waiting FROM nation""")
def sync_reject_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By id mod 3: 0 is rejected and goes back to what was, 1 acked, 2 pulled from the server since and rejected: its truth stays."""
    rows = [r.id for r in nations(spark, sf_dir).collect()]
    pulled = changes_page(*(("set", "nation", i, 5, {"region": 100, "name": None}) for i in rows if int(i) % 3 == 2))
    server = Script((pulled,), (lambda x: {**ack(x), "status": "ack" if int(x["id"]) % 3 == 1 else "reject"},))
    store, one = synced(spark, sf_dir, server)
    one.poke()
    one.push()
    waiting = spark.createDataFrame([(e.id,) for e in one.outbox], "id string").withColumn("waiting", F.lit(True))
    # the server's truth of a third group names no name: those nations are told apart by the table's
    named = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("own"))
    found = store.entities().select("id", name(), region()).join(waiting, "id", "left").join(named, "id")
    return found.select("id", F.coalesce("name", "own").alias("name"), "region", (F.coalesce("waiting", F.lit(False)) | (number() % 3 == 2)).alias("waiting"))


@query("""SELECT CASE WHEN n_nationkey % 2 = 0 THEN 's' ELSE '' END || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'server' ELSE n_name END AS name, 9::BIGINT AS region FROM nation""")
def sync_transform_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even nations get the server's entity under an id of its own; the others are acked."""
    told = lambda x: {**ack(x), "status": "transform", "remappedId": f"s{x['id']}", "data": {"name": "server", "region": 9}} if int(x["id"]) % 2 == 0 else ack(x)
    store, one = synced(spark, sf_dir, Script(answers=(told,)))
    one.push()
    return store.entities().select("id", name(), region())


@query("""SELECT n_nationkey::VARCHAR AS id, n_regionkey::BIGINT AS region, 'r1' AS asked FROM nation WHERE n_regionkey = 1""")
def sync_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reset's cursor is taken and the pull made again; what the run before had gathered doesn't apply."""
    rows = {r.id: json.loads(r.data) for r in nations(spark, sf_dir).collect()}
    first = changes_page(*(("set", "nation", i, 1, d) for i, d in rows.items()), cursor="c1", complete=False)
    last = changes_page(*(("set", "nation", i, 1, d) for i, d in rows.items() if d["region"] == 1), cursor="c2")
    server, store = Script((first, {"type": "reset", "cursor": "r1"}, last)), EntityStore(spark)
    one = Coordinator(spark, server, store=store, chance=lambda: 0.5, pause=lambda ms: None)
    one.start()
    one.run()
    return store.entities().select("id", region(), F.lit(server.asked[-1][0]).alias("asked"))


@query("SELECT * FROM (VALUES (1::BIGINT, true, 0::BIGINT, 25::BIGINT, 25::BIGINT), (2, true, 0, 25, 25), (3, false, 0, 25, 0)) AS t(step, suspended, attempt, pending, unpushed)")
def sync_schema_suspends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema conflict suspends pushes until they are resumed; nothing leaves the outbox."""
    _, one = synced(spark, sf_dir, Script(answers=(WireError("schema", "409"), ack)))
    told = []
    for step, action in enumerate((one.push, one.push, one.resume)):
        action()
        state = one.retry_state()
        told.append((step + 1, state["suspendedForSchema"], state["attempt"], one.pending_count(), sum(not e.pushed for e in one.outbox)))
    return spark.createDataFrame(told, "step bigint, suspended boolean, attempt bigint, pending bigint, unpushed bigint")


@query("SELECT * FROM (VALUES (1::BIGINT, 500::BIGINT), (2, 1000), (3, 2000), (4, 4000), (5, 8000), (6, 16000), (7, 30000), (8, 30000)) AS t(attempt, wait)")
def sync_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits of failing pushes, by a chance of one half: doubled up to half a minute, without an end."""
    waits: list[float] = []
    _, one = synced(spark, sf_dir, Script(answers=tuple(WireError("transient", "x") for _ in range(8))), sleep=waits.append)
    one.push()
    one.run(7)
    return spark.createDataFrame([(n + 1, int(w)) for n, w in enumerate(waits)], "attempt bigint, wait bigint")


@query("SELECT 'old-' || r_regionkey AS mutation_id, (r_regionkey + 1)::BIGINT AS place FROM region UNION ALL SELECT n_nationkey::VARCHAR, n_nationkey + 6 FROM nation")
def sync_adopted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another session's writes come first, as they are, and once."""
    _, one = synced(spark, sf_dir, Script())
    ids = {e.mutation_id: e.id for e in one.outbox}
    stranded = [Entry(f"old-{r.id}", "other", int(r.id), "set", "region", r.id) for r in documents_of(spark, sf_dir, "region", "r_regionkey", "r_name").orderBy(number()).collect()]
    one.adopt(stranded)
    one.adopt(stranded)
    return spark.createDataFrame([(ids.get(e.mutation_id, e.mutation_id), n + 1) for n, e in enumerate(one.outbox)], "mutation_id string, place bigint")


@query("SELECT r_regionkey::VARCHAR AS name, row_number() OVER (ORDER BY r_regionkey % 2 DESC, r_regionkey) AS place FROM region UNION ALL SELECT '3', 6")
def sync_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions pull by priority, ties as declared; a poke has one of them pull."""
    names = [r.id for r in documents_of(spark, sf_dir, "region", "r_regionkey", "r_name").orderBy(number()).collect()]
    subscriptions = [Subscription(n, priority=int(n) % 2) for n in names]
    server = Script(tuple(changes_page() for _ in range(len(names) + 1)))
    one = Coordinator(spark, server, subscriptions=subscriptions)
    one.start()
    one.poke("3")
    assert [s.name for s in by_priority(subscriptions)] == [n for _, n in server.asked[:-1]]
    return spark.createDataFrame([(name, n + 1) for n, (_, name) in enumerate(server.asked)], "name string, place bigint")


@query("SELECT n_nationkey::VARCHAR AS id, n_regionkey::BIGINT AS region FROM nation WHERE n_regionkey <> 4")
def sync_local_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a type that stays on the device are left out, and its mutations aren't pushed."""
    rows, warned = {r.id: json.loads(r.data) for r in nations(spark, sf_dir).collect()}, []
    page = changes_page(*(("set", "local" if d["region"] == 4 else "nation", i, 1, d) for i, d in rows.items()))
    store = EntityStore(spark)
    one = Coordinator(spark, Script((page,)), store=store, local_types=frozenset(["local"]), warn=warned.append)
    one.start()
    with store.run_with("local-mutation"):
        store.set("local", "1", {})
    assert len(warned) == sum(d["region"] == 4 for d in rows.values()) and one.pending_count() == 0
    return store.get_by_type("nation").select("id", region())


@query("SELECT * FROM (VALUES ('stopped', 0::BIGINT, false), ('running', 1, true)) AS t(state, pulls, applied)")
def sync_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = []
    for state in ("stopped", "running"):
        server, applied = Script((changes_page(("set", "t", "1", 1, {})),)), []
        one = Coordinator(spark, server, applied.append)
        if state == "stopped":
            one.stop()
        one.start()
        told.append((state, len(server.asked), bool(applied)))
    return spark.createDataFrame(told, "state string, pulls bigint, applied boolean")


# ---- the read surface ----


@query("""SELECT 'history' AS told, (SELECT count(*) FROM region)::BIGINT AS n UNION ALL SELECT 'shown', 2 UNION ALL SELECT 'tools with history', 2 UNION ALL SELECT 'tools without', 1
UNION ALL SELECT 'refused', 2 UNION ALL SELECT 'write tools', 0 UNION ALL SELECT 'schema', 2""")
def surface_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History by type, newest first in number; one tool less without it; none writes; the schema is as it was made."""
    log = documents_of(spark, sf_dir, "region", "r_regionkey", "r_name").select("entity_type", "id", number().alias("seq"), F.lit("name").alias("field"))
    definitions = dict(SCHEMA)
    surface = QuerySurface(lambda _: None, definitions, ["region", "contact", "organization"], history=log)
    plain = QuerySurface(lambda _: None, definitions, ["region"])
    definitions.clear()
    found = surface.read_history({"entityType": "region", "limit": 2})
    refused = [surface.read_history(x) for x in ({"entityType": "secret"}, {"entityType": "region", "limit": 0})]
    tools = surface.tools + plain.tools
    rows = [("history", found["count"]), ("shown", len(found["rows"])), ("tools with history", len(surface.tools)), ("tools without", len(plain.tools)), ("refused", sum(x.get("isError", False) for x in refused)),
            ("write tools", sum(x.startswith(("set", "write", "remove")) for x in tools)), ("schema", len(surface.schema()["entities"]))]
    return spark.createDataFrame(rows, "told string, n bigint")


@query("SELECT * FROM (VALUES ('none', 0::BIGINT), ('two', 2), ('no list', -1), ('twice', -1), ('no name', -1)) AS t(given, allowed)")
def surface_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name, types in {"none": [], "two": ["part", "order"], "no list": "part", "twice": ["part", "part"], "no name": [""]}.items():
        try:
            rows.append((name, len(QuerySurface(lambda _: None, {}, types).allowed)))
        except SurfaceConfigError:
            rows.append((name, -1))
    return spark.createDataFrame(rows, "given string, allowed bigint")
