"""The queries of the entity engine over the driver's tables, each with the SQL that says the same.

``events`` plays the change log: its users are entities, sign-ups replace, errors remove, views evict, all else sets.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import wire
from tessera.functions.matcher import M
from tessera.functions.schema import export_schema, scrub
from tessera.operators import changes, graph, history, hydration, pagination, retention, sync, transactions, views
from tessera.operators.graph import Definition, Relation
from tessera.plans.compile import documents, matches, matching
from tessera.sources import durable, entities
from tessera.sources.scratch import scratch
from tessera.streaming import live
from tessera.surface import QuerySurface

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    from tessera import handle_queries  # noqa: F401 - registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from tessera import handle_queries  # noqa: F401 - registers its own

    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- filters ----

FLAGSHIP = M.and_(M.eq("o_orderstatus", "O"), M.gt("o_totalprice", 100_000), M.not_(M.in_("o_orderpriority", ["1-URGENT", "2-HIGH"])))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000 AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(table(spark, sf_dir, "orders"), FLAGSHIP).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(table(spark, sf_dir, "orders"), M.eq("o_orderstatus", "O")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def filter_neq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(table(spark, sf_dir, "orders"), M.neq("o_orderstatus", "F")).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 30 AND l_discount <= 0.05 AND l_tax >= 0.02 AND l_extendedprice < 50000")
def filter_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = M.and_(M.gt("l_quantity", 30), M.lte("l_discount", 0.05), M.gte("l_tax", 0.02), M.lt("l_extendedprice", 50_000))
    return matching(table(spark, sf_dir, "lineitem"), node).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment >= 'FURNITURE' AND c_mktsegment < 'MACHINERY'")
def filter_string_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = M.and_(M.gte("c_mktsegment", "FURNITURE"), M.lt("c_mktsegment", "MACHINERY"))
    return matching(table(spark, sf_dir, "customer"), node).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def filter_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(table(spark, sf_dir, "orders"), M.in_("o_orderpriority", ["1-URGENT", "5-LOW", 3, None])).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 5 = 0 AND l_partkey < 2500")
def filter_in_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(table(spark, sf_dir, "lineitem"), M.in_("l_partkey", list(range(0, 2_500, 5)))).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
def filter_nin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(table(spark, sf_dir, "orders"), M.nin("o_orderpriority", ["1-URGENT", "5-LOW"])).select("o_orderkey")


SPARSE = "SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'NaN'::DOUBLE ELSE value END AS value FROM events"


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", "event_type", value.alias("value"))


@query(f"SELECT event_id FROM ({SPARSE}) WHERE value IS NOT NULL")
def filter_nin_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(sparse(spark, sf_dir), M.nin("value", [])).select("event_id")


@query(f"SELECT event_id FROM ({SPARSE}) WHERE value IS NULL")
def filter_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(sparse(spark, sf_dir), M.exists("value", False)).select("event_id")


@query(f"SELECT event_id FROM ({SPARSE}) WHERE NOT coalesce(value > 50 AND NOT isnan(value), false)")
def filter_not_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(sparse(spark, sf_dir), M.not_(M.gt("value", 50))).select("event_id")


@query(f"SELECT event_id FROM ({SPARSE}) WHERE value IS NULL OR (NOT isnan(value) AND value < 10)")
def filter_present_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(sparse(spark, sf_dir), M.or_(M.eq("value", None), M.lt("value", 10)), null_as="null").select("event_id")


@query(f"SELECT event_id FROM ({SPARSE}) WHERE value IS NOT NULL AND isnan(value)")
def filter_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN is present, equals nothing, and is neither above nor below."""
    node = M.and_(M.exists("value"), M.neq("value", 1), M.not_(M.gte("value", -1e300)), M.not_(M.lt("value", 1e300)), M.nin("value", [1, 2]))
    return matching(sparse(spark, sf_dir), node).select("event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag = 'R' OR (l_shipdate IS NOT NULL AND l_quantity < 5)) AND NOT (l_linestatus = 'O' AND (l_tax > 0.04 OR l_discount = 0.1))")
def filter_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = M.and_(M.eq("l_linestatus", "O"), M.or_(M.gt("l_tax", 0.04), M.eq("l_discount", 0.1)))
    node = M.and_(M.or_(M.eq("l_returnflag", "R"), M.and_(M.exists("l_shipdate"), M.lt("l_quantity", 5))), M.not_(inner))
    return matching(table(spark, sf_dir, "lineitem"), node).select("l_orderkey", "l_linenumber")


@query("SELECT n_nationkey, true AS every, false AS some FROM nation")
def filter_empty_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation")
    return rows.select("n_nationkey", matches(rows, M.and_()).alias("every"), matches(rows, M.or_()).alias("some"))


@query("SELECT c_custkey, false AS text_is_number, true AS text_is_not_number, false AS number_above_text, false AS missing_differs FROM customer")
def filter_type_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    told = {"text_is_number": M.eq("c_name", 1), "text_is_not_number": M.neq("c_name", 1), "number_above_text": M.gt("c_acctbal", "1"), "missing_differs": M.neq("nothing", 1)}
    return rows.select("c_custkey", *(matches(rows, node).alias(name) for name, node in told.items()))


@query("SELECT event_id FROM events WHERE (props::JSON->>'k')::BIGINT > 50 AND (props::JSON->>'k')::BIGINT NOT IN (60, 70)")
def filter_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("data"))
    node = M.and_(M.gt("k", 50), M.nin("k", [60, 70]), M.neq("k", "50"), M.exists("a.b", False))
    return matching(rows, node, fields=documents("data")).select("event_id")


@query("SELECT p_partkey FROM part WHERE p_size % 7 = 3 AND p_size <> 10")
def filter_opaque(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closure over rows: one that raises doesn't match, and only True does."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return matching(rows, lambda row: 1 / (row["p_size"] - 10) != 2 and row["p_size"] % 7 == 3).select("p_partkey")


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal * 2 > s_nationkey")
def filter_column_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(table(spark, sf_dir, "supplier"), lambda df: df["s_acctbal"] * 2 > df["s_nationkey"]).select("s_suppkey")


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_totalprice > 150000) AS n_matched FROM orders WHERE o_totalprice > 150000 ORDER BY o_orderkey LIMIT 100")
def query_limit_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    surface = QuerySurface(lambda _: table(spark, sf_dir, "orders"), {}, ["order"], order="o_orderkey")
    matched, window, _ = surface.plan({"entityType": "order", "filter": {"op": "gt", "field": "o_totalprice", "value": 150_000}})
    return window.select("o_orderkey", "o_totalprice", matched.agg(F.count(F.lit(1))).scalar().alias("n_matched"))


# ---- scans and snapshots ----


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions as entities of two types."""
    nation = table(spark, sf_dir, "nation").select(F.lit("nation").alias("entity_type"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("seed_pos"))
    region = table(spark, sf_dir, "region").select(F.lit("region").alias("entity_type"), F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("seed_pos"))
    return nation.unionByName(region)


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name FROM nation")
def type_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.entries(geography(spark, sf_dir), "nation").select("id", "name")


KEYS = "(VALUES ('nation', '3'), ('nation', '99'), ('region', '2'), ('planet', '1')) AS k(entity_type, id)"
GEOGRAPHY = "SELECT 'nation' AS entity_type, n_nationkey::VARCHAR AS id, n_name AS name FROM nation UNION ALL SELECT 'region', r_regionkey::VARCHAR, r_name FROM region"


def some_keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("nation", "3"), ("nation", "99"), ("region", "2"), ("planet", "1")], "entity_type string, id string")


@query(f"SELECT k.entity_type, k.id, g.name FROM {KEYS} LEFT JOIN ({GEOGRAPHY}) g USING (entity_type, id)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.lookup(geography(spark, sf_dir), some_keys(spark)).select("entity_type", "id", "name")


@query(f"SELECT k.entity_type, k.id, g.name IS NOT NULL AS found FROM {KEYS} LEFT JOIN ({GEOGRAPHY}) g USING (entity_type, id)")
def has_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.has(geography(spark, sf_dir), some_keys(spark))


@query("SELECT 'part:' || p_partkey AS key, p_size::BIGINT AS size FROM part")
def snapshot_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.lit("part").alias("entity_type"), F.col("p_partkey").cast("string").alias("id"), F.to_variant_object(F.struct(F.col("p_size").alias("size"), F.col("p_name").alias("name"))).alias("data"))
    return entities.to_snapshot(rows).select("key", F.get_json_object("data", "$.size").cast("long").alias("size"))


@query("SELECT 'part' AS entity_type, 'a:' || p_partkey AS id, p_size::BIGINT AS size FROM part WHERE p_partkey % 3 <> 0")
def snapshot_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids may hold colons; keys without one are left out."""
    part = table(spark, sf_dir, "part")
    key = F.when(F.col("p_partkey") % 3 == 0, F.lit("nokey")).otherwise(F.concat(F.lit("part:a:"), F.col("p_partkey").cast("string")))
    found = entities.from_snapshot(part.select(key.alias("key"), F.to_json(F.struct(F.col("p_size").alias("size"))).alias("data")))
    return found.select("entity_type", "id", F.variant_get("data", "$.size", "long").alias("size"))


# ---- the change log ----

FIELDS = ("last_event", "value", "k")
LOG = """
log AS (SELECT event_id AS seq, 'user' AS entity_type, user_id::VARCHAR AS id,
    CASE event_type WHEN 'signup' THEN 'replace' WHEN 'error' THEN 'remove' WHEN 'view' THEN 'evict' ELSE 'set' END AS op,
    CASE WHEN event_type NOT IN ('error', 'view') THEN event_type END AS last_event,
    CASE WHEN event_type NOT IN ('error', 'view') AND event_id % 3 <> 0 THEN value END AS value,
    CASE WHEN event_type NOT IN ('error', 'view') AND event_id % 4 = 0 THEN (props::JSON->>'k')::BIGINT END AS k FROM events)"""
IMAGES = f"""{LOG},
ep AS (SELECT *, op IN ('set', 'replace') AS live, sum(CASE WHEN op IN ('replace', 'remove', 'evict') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY seq) AS epoch FROM log),
now AS (SELECT *, CASE WHEN live THEN last_value(last_event IGNORE NULLS) OVER l END AS now_last_event, CASE WHEN live THEN last_value(value IGNORE NULLS) OVER l END AS now_value,
    CASE WHEN live THEN last_value(k IGNORE NULLS) OVER l END AS now_k FROM ep WINDOW l AS (PARTITION BY id, epoch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
im AS (SELECT *, lag(now_last_event) OVER w AS prev_last_event, lag(now_value) OVER w AS prev_value, lag(now_k) OVER w AS prev_k, coalesce(lag(live) OVER w, false) AS existed
    FROM now WINDOW w AS (PARTITION BY id ORDER BY seq)),
ev AS (SELECT * FROM im WHERE CASE op WHEN 'set' THEN NOT existed OR (last_event IS NOT NULL AND last_event IS DISTINCT FROM prev_last_event)
    OR (value IS NOT NULL AND value IS DISTINCT FROM prev_value) OR (k IS NOT NULL AND k IS DISTINCT FROM prev_k) WHEN 'evict' THEN existed ELSE true END)"""


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, carries = F.col("event_type"), ~F.col("event_type").isin("error", "view")
    op = F.when(kind == "signup", "replace").when(kind == "error", "remove").when(kind == "view", "evict").otherwise("set")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.lit("user").alias("entity_type"), F.col("user_id").cast("string").alias("id"), op.alias("op"),
        F.when(carries, kind).alias("last_event"), F.when(carries & (F.col("event_id") % 3 != 0), F.col("value")).alias("value"),
        F.when(carries & (F.col("event_id") % 4 == 0), F.get_json_object("props", "$.k").cast("long")).alias("k"),
    )


def event_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.images(change_log(spark, sf_dir), FIELDS)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.emitted(event_images(spark, sf_dir), FIELDS)


LAST = "SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM im"


@query(f"WITH {IMAGES} SELECT id, now_last_event AS last_event, now_value AS value, now_k AS k FROM ({LAST}) WHERE n = 1 AND live")
def fold_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.fold(change_log(spark, sf_dir), FIELDS).select("id", *FIELDS)


@query(f"""WITH {IMAGES}, e AS (SELECT id, max(CASE WHEN live THEN seq END) AS written, coalesce(max(CASE WHEN op = 'remove' THEN seq END), -1) AS removed FROM log JOIN (SELECT seq, live FROM ep) USING (seq) GROUP BY id)
SELECT im.id, now_last_event AS last_event, now_value AS value, now_k AS k, (SELECT count(*) FROM ep x WHERE x.id = e.id AND x.live AND x.seq > e.removed) AS row_version
FROM e JOIN im ON im.id = e.id AND im.seq = e.written WHERE written > removed""")
def fold_durable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.durable_fold(change_log(spark, sf_dir), FIELDS).select("id", *FIELDS, "row_version")


@query(f"WITH {IMAGES} SELECT id, now_last_event AS last_event, now_value AS value, now_k AS k FROM ({LAST}) WHERE n = 1 AND live")
def fold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir)
    data = F.parse_json(F.to_json(F.struct(*FIELDS)))
    found = changes.fold_documents(log.select("seq", "op", "entity_type", "id", data.alias("data")))
    return found.select("id", F.variant_get("data", "$.last_event", "string").alias("last_event"), F.variant_get("data", "$.value", "double").alias("value"), F.variant_get("data", "$.k", "long").alias("k"))


@query(f"WITH {IMAGES} SELECT seq, id, op, now_last_event, now_value, now_k, prev_last_event, prev_value, prev_k FROM im")
def prev_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_images(spark, sf_dir).select("seq", "id", "op", *(f"{w}_{f}" for w in ("now", "prev") for f in FIELDS))


@query(f"WITH {IMAGES} SELECT seq, id, op FROM ev")
def noop_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).select("seq", "id", "op")


@query(f"WITH {IMAGES} SELECT id, 'replace' AS op, now_last_event AS last_event, now_value * 2 AS value FROM ({LAST}) WHERE n = 1 AND live")
def update_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = changes.fold(change_log(spark, sf_dir), FIELDS)
    return changes.update(now, {"value": F.col("value") * 2}).select("id", "op", "last_event", "value")


@query(f"WITH {IMAGES} SELECT 99999 + row_number() OVER (ORDER BY id) AS seq, 'remove' AS op, id FROM ({LAST}) WHERE n = 1 AND live")
def clear_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.clear(changes.fold(change_log(spark, sf_dir), FIELDS), 100_000).select(F.col("seq").cast("long").alias("seq"), "op", "id")


# ---- views ----

VIEW = M.and_(M.gt("value", 20), M.neq("last_event", "signup"))
DELTAS = f"""{IMAGES}, mm AS (SELECT *, coalesce(live AND now_value > 20 AND now_last_event <> 'signup', false) AS member FROM im),
dl AS (SELECT seq, id, CASE WHEN member THEN 'add' ELSE 'remove' END AS delta FROM (SELECT *, coalesce(lag(member) OVER (PARTITION BY id ORDER BY seq), false) AS was FROM mm) WHERE member <> was)"""


def view_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.deltas(event_images(spark, sf_dir), VIEW, FIELDS).select("seq", "entity_type", "id", "delta")


@query(f"WITH {DELTAS} SELECT seq, id, delta FROM dl")
def view_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view_changes(spark, sf_dir).select("seq", "id", "delta")


MEMBERS = f"{DELTAS}, vm AS (SELECT id, max(CASE WHEN delta = 'add' THEN seq END) AS entered FROM dl GROUP BY id HAVING arg_max(delta, seq) = 'add')"


@query(f"WITH {MEMBERS} SELECT id, row_number() OVER (ORDER BY entered) AS place FROM vm")
def view_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = views.members(view_changes(spark, sf_dir))
    return found.select("id", F.row_number().over(Window.orderBy("entered")).cast("long").alias("place"))


@query(f"""WITH {MEMBERS}, held AS (SELECT id FROM vm WHERE id::BIGINT % 5 <> 0 UNION ALL SELECT '100000')
SELECT id, 'missing' AS divergence FROM vm WHERE id NOT IN (SELECT id FROM held) UNION ALL SELECT id, 'extra' FROM held WHERE id NOT IN (SELECT id FROM vm)""")
def view_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = views.members(view_changes(spark, sf_dir)).select("entity_type", "id")
    extra = spark.createDataFrame([("user", "100000")], "entity_type string, id string")
    held = truth.where(F.col("id").cast("long") % 5 != 0).unionByName(extra)
    return views.divergence(held, truth).select("id", "divergence")


@query(f"WITH {MEMBERS} SELECT id, 1::BIGINT AS n FROM vm UNION ALL SELECT id, 0 FROM (SELECT DISTINCT id FROM dl) WHERE id NOT IN (SELECT id FROM vm)")
def view_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.counts(views.retentions(view_changes(spark, sf_dir), "view:hot")).select("id", "n")


@query(f"WITH {IMAGES} SELECT seq, row_number() OVER (ORDER BY seq) AS version_tick FROM ev")
def version_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.version_ticks(event_log(spark, sf_dir)).select("seq", "version_tick")


def streamed(deltas: DataFrame, at: str) -> DataFrame:
    """What a stream of deltas gives for all that its source holds now."""
    spark = deltas.sparkSession
    with live.with_store(spark):
        run = deltas.writeStream.format("parquet").option("path", f"{at}/deltas").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(live.DELTAS).parquet(f"{at}/deltas")


@query(f"WITH {DELTAS} SELECT seq, id, delta FROM dl")
def folding_view_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deltas of the plain change log, which the stream folds itself."""
    at = scratch(spark, "stream")
    log = change_log(spark, sf_dir)
    log.select("seq", "op", "entity_type", "id", F.to_json(F.struct(*FIELDS)).alias("data")).write.parquet(f"{at}/log")
    source = spark.readStream.schema("seq bigint, op string, entity_type string, id string, data string").parquet(f"{at}/log")
    return streamed(live.folding_view(source, VIEW), at).select("seq", "id", "delta")


@query(f"WITH {DELTAS} SELECT seq, id, delta FROM dl")
def live_view_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deltas again, by a stream over what the images come to."""
    at = scratch(spark, "stream")
    source = views.after(event_images(spark, sf_dir), FIELDS).select("seq", "entity_type", "id", "op", *FIELDS)
    source.write.parquet(f"{at}/events")
    stream = live.live_view(spark.readStream.schema(source.schema).parquet(f"{at}/events"), VIEW)
    return streamed(stream, at).select("seq", "id", "delta")


# ---- history ----

WRITES = f"{IMAGES}, wr AS (SELECT *, CASE WHEN op <> 'evict' THEN sum(CASE WHEN op <> 'evict' THEN 1 ELSE 0 END) OVER (ORDER BY seq) END AS write_no FROM ev)"
ROWS = f"""{WRITES}, hr AS (
SELECT seq, id, 'w-' || write_no AS mutation_id, 'last_event' AS field, 'set' AS type FROM wr WHERE live AND prev_last_event IS DISTINCT FROM now_last_event UNION ALL
SELECT seq, id, 'w-' || write_no, 'value', 'set' FROM wr WHERE live AND prev_value IS DISTINCT FROM now_value UNION ALL
SELECT seq, id, 'w-' || write_no, 'k', 'set' FROM wr WHERE live AND prev_k IS DISTINCT FROM now_k UNION ALL
SELECT seq, id, 'w-' || write_no, NULL, 'remove' FROM wr WHERE op = 'remove')"""
PURGED = f"{ROWS}, hp AS (SELECT hr.* FROM hr LEFT JOIN (SELECT id, max(seq) AS erased FROM hr WHERE type = 'remove' GROUP BY id) e USING (id) WHERE erased IS NULL OR seq >= erased)"
SHAPE = ("seq", "id", "mutation_id", "field", "type")


def history_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.rows(history.write_ids(event_log(spark, sf_dir)), FIELDS)


@query(f"WITH {WRITES} SELECT seq, 'w-' || write_no AS mutation_id FROM wr")
def write_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.write_ids(event_log(spark, sf_dir)).select("seq", "mutation_id")


@query(f"WITH {ROWS} SELECT {', '.join(SHAPE)} FROM hr")
def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_of(spark, sf_dir).select(*SHAPE)


@query(f"WITH {PURGED} SELECT {', '.join(SHAPE)} FROM hp")
def history_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.purged(history_of(spark, sf_dir)).select(*SHAPE)


@query(f"WITH {PURGED} SELECT {', '.join(SHAPE)} FROM hp ORDER BY seq DESC, field DESC NULLS LAST LIMIT 50")
def history_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.newest(history.purged(history_of(spark, sf_dir)), 50).select(*SHAPE)


@query(f"""WITH {PURGED}, c AS (SELECT *, row_number() OVER o AS n, sum(length(id) + length(mutation_id)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM hp
WINDOW o AS (ORDER BY seq DESC, field DESC NULLS LAST)) SELECT {', '.join(SHAPE)} FROM c WHERE n <= 200 AND spent <= 1500""")
def history_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("id") + F.length("mutation_id")
    return history.capped(history.purged(history_of(spark, sf_dir)), max_rows=200, max_bytes=1_500, size=size).select(*SHAPE)


@query(f"WITH {PURGED} SELECT {', '.join(SHAPE)} FROM hp WHERE id = '7'")
def history_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.listed(history.purged(history_of(spark, sf_dir)), entity_type="user", id="7", origin=None).select(*SHAPE)


# ---- graphs ----

REGISTRY = {
    "order": Definition(id_field="o_orderkey", relations={"customer": Relation("customer"), "lines": Relation("line", many=True)}),
    "customer": Definition(id_field="c_custkey"),
    "line": Definition(get_id=lambda x: F.concat_ws("-", x["l_orderkey"], x["l_linenumber"])),
}


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer and lines nested."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_quantity")).alias("lines"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.struct("c_custkey", "c_name").alias("customer"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    joined = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select(F.col("o_orderkey").alias("seq"), "o_orderkey", "o_totalprice", "customer", "lines")


@query("""SELECT 'order' AS entity_type, o_orderkey::VARCHAR AS id, o_orderkey AS seq FROM orders UNION ALL
SELECT 'customer', o_custkey::VARCHAR, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL
SELECT 'line', l_orderkey || '-' || l_linenumber, l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def normalize_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.normalize(payloads(spark, sf_dir), "order", REGISTRY)
    parts = [rows.select(F.lit(name).alias("entity_type"), F.col("entity_id").alias("id"), "seq") for name, rows in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT o_orderkey AS seq, 'customer:' || c_custkey AS customer_key, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_lines FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def normalize_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.normalize(payloads(spark, sf_dir), "order", REGISTRY)["order"]
    return rows.select("seq", F.col("customer.key").alias("customer_key"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"))


@query("""SELECT n_nationkey::BIGINT AS seq, 0 AS place, 'region' AS entity_type, r_regionkey::VARCHAR AS id, r_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL
SELECT n_nationkey::BIGINT, 1, 'nation', n_nationkey::VARCHAR, n_name FROM nation""")
def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of no given shape: entities inside out, found by an id field and by a typename."""
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    region = F.struct(F.lit("region").alias("__typename"), F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    body = F.to_json(F.struct(F.struct(F.col("n_nationkey").alias("nationId"), F.col("n_name").alias("name"), F.array(region).alias("regions")).alias("data"), F.lit(1).alias("page")))
    found = graph.normalize_documents(joined.select(F.col("n_nationkey").cast("long").alias("seq"), body.alias("payload")), {"nation": Definition(id_field="nationId")})
    return found.select("seq", "place", "entity_type", "id", F.get_json_object("data", "$.name").alias("name"))


@query("SELECT o_orderkey, c_name AS customer_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def denormalize_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.resolve_one(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, sf_dir, "customer"), "c_custkey", "customer", ["c_name"])
    return rows.select("o_orderkey", F.col("customer.c_name").alias("customer_name"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN c_name END AS customer_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def denormalize_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    rows = graph.resolve_one(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", half, "c_custkey", "customer", ["c_name"])
    return rows.select("o_orderkey", F.col("customer.c_name").alias("customer_name"))


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def denormalize_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = graph.resolve_one(table(spark, sf_dir, "nation"), "n_regionkey", table(spark, sf_dir, "region"), "r_regionkey", "region")
    customer = graph.resolve_one(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_nationkey", nation, "n_nationkey", "nation")
    rows = graph.resolve_one(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", customer, "c_custkey", "customer")
    return rows.select("o_orderkey", "customer.c_name", "customer.nation.n_name", "customer.nation.region.r_name")


@query("SELECT r_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS place FROM region JOIN nation ON n_regionkey = r_regionkey")
def denormalize_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_nationkey")).alias("nations"))
    rows = graph.resolve_many(region, ["r_regionkey"], "nations", nation, "n_nationkey", "found")
    return rows.select("r_regionkey", F.posexplode("found").alias("place", "x")).select("r_regionkey", F.col("x.n_nationkey"), F.col("x.n_name"), F.col("place").cast("long").alias("place"))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 2) % 25 AS b FROM nation),
r AS (SELECT a AS node, a AS reached, 0 AS steps FROM e UNION ALL SELECT node, b, steps + 1 FROM r JOIN e ON reached = a WHERE steps < 4)
SELECT node, reached, min(steps)::INTEGER AS steps FROM r GROUP BY ALL""")
def reachable_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    edges = nation.select(F.col("n_nationkey").alias("a"), (F.col("n_nationkey") * 2 % 25).alias("b"))
    return graph.reachable(edges, nation.select(F.col("n_nationkey").alias("node")), 4)


# ---- pages ----

PAGES = """pn AS (SELECT l_orderkey, (l_linenumber - 1) // 2 AS page, list(l_linenumber::BIGINT ORDER BY l_linenumber) AS items FROM lineitem GROUP BY ALL),
pg AS (SELECT *, row_number() OVER w AS n, first_value(items) OVER w AS x, count(*) OVER (PARTITION BY l_orderkey) AS n_pages FROM pn WINDOW w AS (PARTITION BY l_orderkey ORDER BY page))"""


def line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of an order's lines, two to a page: items, offset, cursor."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.floor((F.col("l_linenumber") - 1) / 2).alias("page"), F.struct(F.col("l_linenumber").cast("long").alias("id"), F.col("l_quantity").alias("qty")).alias("item"))
    return lines.groupBy("l_orderkey", "page").agg(F.array_sort(F.collect_list("item")).alias("items")).withColumn("offset", F.col("page") * 2)


def folded(pages: DataFrame, merge: Callable[[F.Column, F.Column], F.Column], more: Callable[[F.Column, F.Column], F.Column] = lambda first, items: items) -> DataFrame:
    """Each order's pages, one merged into the other in their order: items of all, and the first and the last page.

    ``merge`` gets what is there and the page that comes in; ``more`` adds to a later page what it shall hold besides.
    An order of one page keeps it as it is.
    """
    rows = pages.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("page", "offset", "items"))).alias("pages"))
    first, rest = F.element_at("pages", 1), F.slice("pages", 2, F.size("pages"))
    page = lambda p, items: F.struct(p["page"].alias("page"), p["offset"].alias("offset"), items.alias("items"))
    # a column of its own, since a lambda's variable can't be bound twice
    rows = rows.withColumn("first", first).withColumn("rest", F.transform(rest, lambda p: page(p, more(F.col("first.items"), p["items"]))))
    merged = F.aggregate("rest", F.col("first"), lambda a, p: page(p, merge(a, p)))
    return rows.select("l_orderkey", merged["items"].alias("items"), "first", F.element_at("pages", -1).alias("last"), F.size("pages").alias("n_pages"))


def listed(rows: DataFrame, items: str = "items", key: str = "l_orderkey") -> DataFrame:
    """One row per place, ids as they lie."""
    return rows.select(key, F.posexplode(F.transform(items, lambda x: x["id"])).alias("place", "id")).select(key, F.col("place").cast("long").alias("place"), "id")


def unnested(expression: str) -> str:
    """Places and ids of a list made of an order's pages."""
    return f"WITH {PAGES}, m AS (SELECT l_orderkey, {expression} AS items FROM pg GROUP BY l_orderkey) SELECT l_orderkey, unnest(range(len(items))) AS place, unnest(items) AS id FROM m"


def kept_last(more: str) -> str:
    """All pages, the later ones with ``more`` at their ends, each id at its last place; an only page as it is."""
    return f"""WITH {PAGES}, l AS (SELECT l_orderkey, max(n_pages) AS n_pages, flatten(list(CASE WHEN n = 1 THEN items ELSE items || {more} END ORDER BY page)) AS l FROM pg GROUP BY l_orderkey),
m AS (SELECT l_orderkey, CASE WHEN n_pages = 1 THEN l ELSE list_filter(l, lambda v, i: NOT list_contains(l[i + 1:], v)) END AS items FROM l) SELECT l_orderkey, unnest(range(len(items))) AS place, unnest(items) AS id FROM m"""


def cursor_of(page: F.Column) -> F.Column:
    return F.concat(F.lit("p"), page["page"].cast("string"))


@query(unnested("flatten(list(items ORDER BY page))"))
def cursor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(folded(line_pages(spark, sf_dir), lambda a, p: pagination.merge_cursor(a["items"], p["items"], cursor_of(a), cursor_of(p))))


@query(unnested("flatten(list(items ORDER BY page DESC))"))
def cursor_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return listed(folded(line_pages(spark, sf_dir), lambda a, p: pagination.merge_cursor(a["items"], p["items"], none, none, backward=True)))


@query(unnested("arg_max(items, page)"))
def cursor_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page under the cursor that is there takes its place."""
    return listed(folded(line_pages(spark, sf_dir), lambda a, p: pagination.merge_cursor(a["items"], p["items"], F.lit("a"), F.lit("a"))))


@query(kept_last("list_filter(x, lambda v: v = 2)"))
def cursor_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later pages end with item 2 of the first, which moves."""
    again = lambda first, items: F.concat(items, F.filter(first, lambda v: v["id"] == 2))
    return listed(folded(line_pages(spark, sf_dir), lambda a, p: pagination.merge_cursor(a["items"], p["items"], cursor_of(a), cursor_of(p), key="id"), again))


@query(f"""WITH RECURSIVE {PAGES}, f AS (SELECT l_orderkey, n, page AS o, items FROM pg WHERE n = 1 UNION ALL
SELECT f.l_orderkey, g.n, g.page, list_filter([CASE WHEN p >= g.page AND p < g.page + len(g.items) THEN g.items[p - g.page + 1] WHEN p >= f.o AND p < f.o + len(f.items) THEN f.items[p - f.o + 1] END
    FOR p IN range(0, greatest(f.o + len(f.items), g.page + len(g.items)))], lambda v: v IS NOT NULL)
FROM f JOIN pg g ON g.l_orderkey = f.l_orderkey AND g.n = f.n + 1),
m AS (SELECT l_orderkey, arg_max(items, n) AS items FROM f GROUP BY l_orderkey) SELECT l_orderkey, unnest(range(len(items))) AS place, unnest(items) AS id FROM m""")
def offset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page laid over what is there from the place of its number on."""
    return listed(folded(line_pages(spark, sf_dir), lambda a, p: pagination.merge_offset(a["items"], p["items"], a["page"], p["page"])))


@query(f"""WITH {PAGES}, sp AS (SELECT l_orderkey, page, unnest(range(len(items))) + page * 2 AS place, unnest(items) AS id FROM pg), la AS (SELECT l_orderkey, place, arg_max(id, page) AS id FROM sp GROUP BY ALL),
de AS (SELECT l_orderkey, id, max(place) AS place FROM la GROUP BY ALL) SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY place) - 1 AS place, id FROM de""")
def assembled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(pagination.assemble(line_pages(spark, sf_dir), ["l_orderkey"], items="items", offset="offset", arrival="page", dedupe="id"))


def edges_of(c: str) -> F.Column:
    return F.transform(c, lambda v: F.struct(v["id"].alias("id"), F.concat(F.lit("c"), v["id"].cast("string")).alias("cursor")))


@query(kept_last("list_filter(x, lambda v: v = 1)"))
def relay_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge whose cursor comes again moves to its later place."""
    pages = line_pages(spark, sf_dir).withColumn("items", edges_of("items"))
    again = lambda first, items: F.concat(items, F.filter(first, lambda e: e["id"] == 1))
    return listed(folded(pages, lambda a, p: pagination.merge_edges(a["items"], p["items"]), again))


@query(f"WITH {PAGES} SELECT l_orderkey, 'c' || arg_min(items, page)[1] AS start_cursor, 'c' || list_last(arg_max(items, page)) AS end_cursor, false AS has_previous, len(arg_max(items, page)) = 2 AS has_next FROM pg GROUP BY l_orderkey")
def relay_pageinfo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The start of the first page and the end of the last, whatever came between."""

    def info(c: str, later: F.Column) -> F.Column:
        cursor = lambda x: F.concat(F.lit("c"), x["id"].cast("string"))
        return F.struct((F.size(c) == 2).alias("hasNextPage"), later.alias("hasPreviousPage"), cursor(F.element_at(c, 1)).alias("startCursor"), cursor(F.element_at(c, -1)).alias("endCursor"))

    rows = folded(line_pages(spark, sf_dir), lambda a, p: p["items"])
    told = rows.withColumns({"a": info("first.items", F.lit(False)), "b": info("last.items", F.col("n_pages") > 1)})
    told = told.withColumn("i", pagination.merge_page_info(F.col("a"), F.col("b"), F.col("first.items"), F.col("last.items")))
    return told.select("l_orderkey", F.col("i.startCursor").alias("start_cursor"), F.col("i.endCursor").alias("end_cursor"), F.col("i.hasPreviousPage").alias("has_previous"), F.col("i.hasNextPage").alias("has_next"))


# ---- residency ----

HOLDS = "ho AS (SELECT event_id AS seq, user_id::VARCHAR AS id, CASE event_type WHEN 'click' THEN 'retain' ELSE 'release' END AS op FROM events WHERE event_type IN ('click', 'view'))"
COUNTS = f"""{HOLDS}, st AS (SELECT *, sum(CASE op WHEN 'retain' THEN 1 ELSE -1 END) OVER (PARTITION BY id ORDER BY seq) AS s FROM ho),
rc AS (SELECT id, (arg_max(s, seq) - least(0, min(s)))::BIGINT AS n FROM st GROUP BY id HAVING count(*) FILTER (op = 'retain') > 0)"""


def holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    return events.select(F.col("event_id").alias("seq"), F.lit("user").alias("entity_type"), F.col("user_id").cast("string").alias("id"), F.when(F.col("event_type") == "click", "retain").otherwise("release").alias("op"))


@query(f"WITH {COUNTS} SELECT id, n FROM rc")
def refcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.counts(holds(spark, sf_dir)).select("id", "n")


@query(f"WITH {COUNTS} SELECT DISTINCT user_id::VARCHAR AS id FROM events WHERE user_id::VARCHAR IN (SELECT id FROM rc WHERE n <= 0)")
def gc_evictable(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.lit("user").alias("entity_type"), F.col("user_id").cast("string").alias("id")).distinct()
    return retention.evictable(users, retention.counts(holds(spark, sf_dir))).select("id")


MANIFESTS = "mf AS (SELECT c_mktsegment AS scope_id, o_orderkey::VARCHAR AS id FROM orders JOIN customer ON c_custkey = o_custkey)"
ORDER_KEY = ("entity_type", "id")


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("c_mktsegment").alias("scope_id"), F.lit("order").alias("entity_type"), F.col("o_orderkey").cast("string").alias("id"))


def stored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.lit("order").alias("entity_type"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 10).alias("digit"))


@query(f"WITH {MANIFESTS} SELECT DISTINCT id FROM mf WHERE scope_id IN ('BUILDING', 'MACHINERY')")
def manifest_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hydration.scope_keys(manifests(spark, sf_dir), ["BUILDING", "MACHINERY"]).select("id")


@query(f"WITH {MANIFESTS} SELECT o_orderkey::VARCHAR AS id, o_totalprice AS price FROM orders WHERE o_orderkey::VARCHAR IN (SELECT id FROM mf WHERE scope_id = 'BUILDING')")
def hydrate_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = manifests(spark, sf_dir).where("scope_id = 'BUILDING'")
    return hydration.boot_manifest(stored_orders(spark, sf_dir), scope).select("id", "price")


@query(f"WITH {MANIFESTS} SELECT DISTINCT id FROM mf WHERE scope_id = 'BUILDING' AND id::BIGINT % 10 <> 1")
def hydrate_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    memory = stored_orders(spark, sf_dir).where("digit = 1")
    return hydration.to_load(manifests(spark, sf_dir), memory, ["BUILDING"]).select("id")


@query("SELECT o_orderkey::VARCHAR AS id, o_totalprice AS price FROM orders WHERE o_orderkey % 10 <> 1")
def hydrate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored_orders(spark, sf_dir)
    return hydration.boot_all(rows, rows.where("digit = 1")).select("id", "price")


@query("""SELECT o_orderkey::VARCHAR AS id, CASE o_orderkey % 10 WHEN 2 THEN 'dirty' WHEN 4 THEN 'inflight' ELSE 'engine' END AS source,
CASE o_orderkey % 10 WHEN 2 THEN o_totalprice + 2 WHEN 4 THEN o_totalprice + 4 ELSE o_totalprice END AS price
FROM orders WHERE o_orderkey % 10 NOT IN (0, 1, 3, 5)""")
def hydrate_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By last digit: 0 is masked by a transaction, 1 in memory, 2 dirty, 3 dirtily deleted, 4 in flight (2 too), 5 deleted in flight."""
    rows = stored_orders(spark, sf_dir)
    put = lambda d, op: rows.where(F.col("digit") == d).select(*ORDER_KEY, F.lit(op).alias("op"), (F.col("price") + d).alias("price"))
    dirty = put(2, "put").unionByName(put(3, "delete"))
    inflight = put(4, "put").unionByName(put(5, "delete")).unionByName(put(2, "delete"))
    overlay = hydration.overlaid(rows, dirty, inflight, rows.where("digit = 0"), ["price"])
    return hydration.hydrated(overlay, rows.where("digit = 1")).select("id", "source", "price")


@query(f"WITH {MANIFESTS} SELECT id FROM mf WHERE scope_id = 'BUILDING' AND id::BIGINT % 2 = 1")
def manifest_shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = manifests(spark, sf_dir)
    kept = every.where("scope_id = 'BUILDING' AND cast(id AS bigint) % 2 = 0")
    return hydration.set_manifest(every, "BUILDING", kept)[1].select("id")


@query(f"WITH {MANIFESTS} SELECT id, 1::BIGINT AS n FROM mf")
def manifest_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.held(hydration.pins(manifests(spark, sf_dir))).select("id", "n")


# ---- durability ----


@query("""SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS data,
CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS row_version FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT 'x', 'new', 1""")
def write_batch_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.lit("order").alias("entity_type"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("data"), F.lit(1).cast("long").alias("row_version"), F.lit(0).cast("long").alias("updated_at"))
    number = F.col("id").cast("long")
    extra = spark.createDataFrame([("order", "x", "new")], "entity_type string, id string, data string")
    puts = rows.where((number % 3 == 0) & (number % 5 != 0)).select("entity_type", "id", F.lit("new").alias("data")).unionByName(extra)
    return durable.upserted(rows, puts, rows.where(number % 5 == 0)).select("id", "data", "row_version")


@query(f"WITH {LOG}, l AS (SELECT id, arg_max(op, seq) AS op, arg_max(last_event, seq) AS data FROM log WHERE op <> 'evict' GROUP BY id) SELECT id, op, CASE WHEN op <> 'remove' THEN data END AS data FROM l")
def write_behind(spark: SparkSession, sf_dir: str) -> DataFrame:
    behind = durable.WriteBehind(durable.MemoryBackend(spark))
    behind.add(change_log(spark, sf_dir).select("seq", "op", "entity_type", "id", F.coalesce("last_event", F.lit("")).alias("data"), F.lit("local-mutation").alias("origin")))
    return behind.pending().select("id", "op", F.when(F.col("op") != "remove", F.col("data")).alias("data"))


# ---- transactions ----

TX = """tl AS (SELECT 'tx-' || (event_id // 5) AS tx_id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'set' END AS op, user_id::VARCHAR AS id,
    CASE WHEN event_type <> 'error' THEN event_type END AS last_event, CASE WHEN event_type <> 'error' AND event_id % 2 = 0 THEN value END AS value, event_id // 5 AS t FROM events),
ts AS (SELECT DISTINCT tx_id, CASE t % 3 WHEN 0 THEN 'commit' WHEN 1 THEN 'rollback' END AS outcome, 1000000 - t AS settle_seq FROM tl WHERE t % 3 < 2)"""
TX_FIELDS = ("last_event", "value")


def tx_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Five events a transaction; a third commits (in reverse order), a third rolls back, a third stays open."""
    t, sets = F.floor(F.col("event_id") / 5), F.col("event_type") != "error"
    log = table(spark, sf_dir, "events").select(
        F.concat(F.lit("tx-"), t.cast("string")).alias("tx_id"), F.col("event_id").alias("seq"), F.when(sets, "set").otherwise("remove").alias("op"),
        F.lit("user").alias("entity_type"), F.col("user_id").cast("string").alias("id"), F.when(sets, F.col("event_type")).alias("last_event"),
        F.when(sets & (F.col("event_id") % 2 == 0), F.col("value")).alias("value"), t.alias("t"),
    )
    settle = log.where("t % 3 < 2").select("tx_id", F.when(F.col("t") % 3 == 0, "commit").otherwise("rollback").alias("outcome"), (1_000_000 - F.col("t")).alias("settle_seq")).distinct()
    return log.drop("t"), settle


@query(f"WITH {TX} SELECT tl.tx_id, seq, settle_seq, id FROM tl JOIN ts ON ts.tx_id = tl.tx_id AND outcome = 'commit'")
def tx_commit_graduates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transactions.graduated(*tx_tables(spark, sf_dir))
    return found.select("tx_id", F.col("seq.seq").alias("seq"), F.col("seq.settle_seq").alias("settle_seq"), "id")


@query(f"""WITH {TX}, a AS (SELECT tl.* FROM tl LEFT JOIN ts USING (tx_id) WHERE coalesce(outcome, 'open') <> 'rollback'),
r AS (SELECT id, max(seq) AS removed FROM a WHERE op = 'remove' GROUP BY id),
b AS (SELECT DISTINCT user_id::VARCHAR AS id, 'base' AS last_event, user_id::DOUBLE AS value FROM events WHERE user_id % 2 = 0),
e AS (SELECT a.id, seq, last_event, value FROM a LEFT JOIN r USING (id) WHERE op = 'set' AND (removed IS NULL OR seq > removed) UNION ALL SELECT b.id, -1, last_event, value FROM b LEFT JOIN r USING (id) WHERE removed IS NULL)
SELECT id, arg_max(last_event, seq) FILTER (last_event IS NOT NULL) AS last_event, arg_max(value, seq) FILTER (value IS NOT NULL) AS value FROM e GROUP BY id""")
def tx_rollback_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").where("user_id % 2 = 0").distinct()
    base = users.select(F.lit("user").alias("entity_type"), F.col("user_id").cast("string").alias("id"), F.lit("base").alias("last_event"), F.col("user_id").cast("double").alias("value"))
    return transactions.rolled_back(base, *tx_tables(spark, sf_dir), TX_FIELDS).select("id", *TX_FIELDS)


NET = f"""{TX}, lr AS (SELECT tx_id, id, max(seq) AS removed FROM tl WHERE op = 'remove' GROUP BY ALL),
nt AS (SELECT tl.tx_id, tl.id, arg_max(op, seq) AS op, arg_max(last_event, seq) FILTER (last_event IS NOT NULL AND (removed IS NULL OR seq > removed)) AS last_event,
    arg_max(value, seq) FILTER (value IS NOT NULL AND (removed IS NULL OR seq > removed)) AS value FROM tl LEFT JOIN lr ON lr.tx_id = tl.tx_id AND lr.id = tl.id GROUP BY ALL)"""


@query(f"WITH {NET} SELECT tx_id, id, op, last_event, value FROM nt")
def tx_net_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.net_changes(tx_tables(spark, sf_dir)[0], TX_FIELDS).select("tx_id", "id", "op", *TX_FIELDS)


@query(f"WITH {TX} SELECT seq, id, CASE WHEN NOT coalesce(value < 90, true) THEN 0 WHEN op = 'remove' THEN 1 END AS vetoed_by FROM tl")
def gate_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tx_tables(spark, sf_dir)[0]
    gates = [F.coalesce(F.col("value") < 90, F.lit(True)), F.col("op") != "remove"]
    accepted, vetoed = transactions.gated(log, gates)
    return accepted.select("seq", "id", F.lit(None).cast("int").alias("vetoed_by")).unionByName(vetoed.select("seq", "id", "vetoed_by"))


@query(f"WITH {NET} SELECT tx_id, CASE WHEN bool_and(op <> 'remove' AND coalesce(value < 95, true)) THEN 'commit' ELSE 'rollback' END AS verdict FROM nt GROUP BY tx_id")
def gate_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = transactions.net_changes(tx_tables(spark, sf_dir)[0], TX_FIELDS)
    return transactions.commit_gate(net, (F.col("op") != "remove") & F.coalesce(F.col("value") < 95, F.lit(True)))


@query(f"""WITH {TX}, c AS (SELECT tl.*, settle_seq FROM tl JOIN ts ON ts.tx_id = tl.tx_id AND outcome = 'commit'),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY settle_seq, seq) AS n FROM c), r AS (SELECT id, max(n) AS removed FROM o WHERE op = 'remove' GROUP BY id),
b AS (SELECT DISTINCT user_id::VARCHAR AS id, 'base' AS last_event, user_id::DOUBLE AS value FROM events WHERE user_id % 2 = 0),
e AS (SELECT o.id, n, last_event, value FROM o LEFT JOIN r USING (id) WHERE op = 'set' AND (removed IS NULL OR n > removed) UNION ALL SELECT b.id, -1, last_event, value FROM b LEFT JOIN r USING (id) WHERE removed IS NULL)
SELECT id, arg_max(last_event, n) FILTER (last_event IS NOT NULL) AS last_event, arg_max(value, n) FILTER (value IS NOT NULL) AS value FROM e GROUP BY id""")
def tx_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").where("user_id % 2 = 0").distinct()
    base = users.select(F.lit("user").alias("entity_type"), F.col("user_id").cast("string").alias("id"), F.lit("base").alias("last_event"), F.col("user_id").cast("double").alias("value"))
    return transactions.truth_after(base, *tx_tables(spark, sf_dir), TX_FIELDS).select("id", *TX_FIELDS)


@query(f"WITH {TX} SELECT DISTINCT tx_id, id FROM tl")
def tx_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.affected(tx_tables(spark, sf_dir)[0]).select("tx_id", "id")


# ---- sync ----

OUTBOX = """ob AS (SELECT event_id AS seq, 'c' || (user_id % 4) AS client_id, event_type AS entity_type, user_id::VARCHAR AS id, 'm-' || event_id AS mutation_id,
    row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS client_seq FROM events WHERE event_id % 2 = 0 AND event_type <> 'view')"""


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events are local mutations; views are of a type that stays on the device."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("client_id"), F.col("event_type").alias("entity_type"),
        F.col("user_id").cast("string").alias("id"), F.concat(F.lit("m-"), F.col("event_id").cast("string")).alias("mutation_id"), F.lit("set").alias("op"),
        F.when(F.col("event_id") % 2 == 0, "local-mutation").otherwise("sync-pull").alias("origin"),
    )
    return sync.outbox(events, ["view"])


@query(f"WITH {OUTBOX} SELECT seq, client_id, client_seq FROM ob")
def sync_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending(spark, sf_dir).select("seq", "client_id", "client_seq")


@query(f"WITH {OUTBOX} SELECT mutation_id FROM ob WHERE NOT (client_id = 'c0' AND client_seq <= 100) AND NOT (client_id = 'c1' AND client_seq <= 7)")
def sync_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = spark.createDataFrame([("c0", 100), ("c1", 7), ("c9", 1)], "client_id string, seq bigint")
    return sync.unconfirmed(pending(spark, sf_dir), marks).select("mutation_id")


@query(f"""WITH {OUTBOX} SELECT mutation_id, CASE WHEN ob.id IN (SELECT id FROM ob WHERE seq % 7 = 3 AND entity_type = 'click') AND entity_type = 'click' THEN 'new-' || id ELSE id END AS id,
seq % 7 IN (2, 3) AS pushed, CASE WHEN seq % 7 = 2 THEN 'v' || seq WHEN NOT (entity_type = 'click' AND ob.id IN (SELECT id FROM ob WHERE seq % 7 = 3 AND entity_type = 'click')) THEN 'base' END AS base_version
FROM ob WHERE seq % 7 <> 1""")
def sync_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By seq mod 7: 1 is rejected, 2 acked, 3 transformed (clicks to a new id), the rest unanswered."""
    own = pending(spark, sf_dir).withColumn("base_version", F.lit("base"))
    kind = F.col("seq") % 7
    told = own.where(kind.isin(1, 2, 3)).select(
        "mutation_id", F.when(kind == 1, "reject").when(kind == 2, "ack").otherwise("transform").alias("status"), F.concat(F.lit("v"), F.col("seq").cast("string")).alias("version"),
        F.when((kind == 3) & (F.col("entity_type") == "click"), F.concat(F.lit("new-"), "id")).alias("remapped_id"),
    )
    return sync.after_verdicts(own, told).select("mutation_id", "id", "pushed", "base_version")


REMOTE = """rm AS (SELECT event_id AS arrival, 'user' AS entity_type, user_id::VARCHAR AS id, (event_id * 7919) % 1000 AS v, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'set' END AS op,
    CASE WHEN event_type <> 'error' THEN event_type END AS last_event, CASE WHEN event_type <> 'error' AND event_id % 2 = 0 THEN value END AS value FROM events),
ac AS (SELECT * FROM (SELECT *, max(v) OVER (PARTITION BY id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM rm) WHERE top IS NULL OR v > top)"""


def remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = F.col("event_type") != "error"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("arrival"), F.lit("user").alias("entity_type"), F.col("user_id").cast("string").alias("id"), (F.col("event_id") * 7919 % 1000).cast("string").alias("version"),
        F.when(sets, "set").otherwise("remove").alias("op"), F.when(sets, F.col("event_type")).alias("last_event"), F.when(sets & (F.col("event_id") % 2 == 0), F.col("value")).alias("value"),
    )


@query(f"WITH {REMOTE} SELECT arrival, id, v::VARCHAR AS version FROM ac")
def sync_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.accepted(remote(spark, sf_dir)).select("arrival", "id", "version")


@query(f"WITH {REMOTE} SELECT arrival, id, v::VARCHAR AS version FROM ac")
def sync_accepted_by_comparator(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = lambda a, b: "same" if int(a) == int(b) else "newer" if int(a) > int(b) else "older"
    return sync.accepted(remote(spark, sf_dir), compare=order).select("arrival", "id", "version")


@query(f"""WITH {REMOTE}, r AS (SELECT id, max(arrival) AS removed FROM ac WHERE op = 'remove' GROUP BY id), s AS (SELECT ac.* FROM ac LEFT JOIN r USING (id) WHERE op = 'set' AND (removed IS NULL OR arrival > removed))
SELECT s.id, arg_max(last_event, arrival) FILTER (last_event IS NOT NULL) AS last_event, arg_max(value, arrival) FILTER (value IS NOT NULL) AS value, max(v)::VARCHAR AS version FROM s GROUP BY s.id""")
def sync_apply_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.applied(remote(spark, sf_dir), TX_FIELDS).select("id", *TX_FIELDS, "version")


@query("""WITH u AS (SELECT DISTINCT user_id AS u FROM events) SELECT u::VARCHAR AS id,
CASE WHEN u % 5 = 0 THEN 'sibling' WHEN u % 2 = 0 THEN 'before' ELSE 'truth' END AS last_event, CASE WHEN u % 2 = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS value FROM u WHERE NOT (u % 3 = 0 AND u % 5 <> 0 AND u % 2 = 0) AND NOT (u % 3 = 0 AND u % 2 = 0)
UNION ALL SELECT u::VARCHAR, 'sibling', NULL FROM u WHERE u % 3 = 0 AND u % 2 = 0 AND u % 5 = 0""")
def sync_reject_revert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even users go back to what was (nothing, for multiples of 3), odd ones to server truth that came since; of every fifth a sibling is replayed."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("u")).distinct().withColumns({"entity_type": F.lit("user"), "id": F.col("u").cast("string")})
    existed = F.col("u") % 3 != 0
    rejected = users.select("entity_type", "id", existed.alias("existed"), F.lit("before").alias("prev_last_event"), F.lit(1.0).alias("prev_value"), F.lit(0).cast("long").alias("base_gen"))
    truth = users.where("u % 2 = 1").select("entity_type", "id", F.lit(1).cast("long").alias("gen"), F.lit(False).alias("removed"), F.lit("truth").alias("last_event"), F.lit(2.0).alias("value"))
    siblings = users.where("u % 5 = 0").select(F.col("u").alias("seq"), F.lit("set").alias("op"), "entity_type", "id", F.lit("sibling").alias("last_event"), F.lit(None).cast("double").alias("value"))
    return sync.reverted(rejected, truth, siblings, TX_FIELDS).select("id", *TX_FIELDS)


@query("SELECT event_id AS version, user_id::VARCHAR AS id, event_type = 'error' AS deleted FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 200")
def sync_feed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("version"), F.col("user_id").cast("string").alias("id"), (F.col("event_type") == "error").alias("deleted"))
    return sync.feed_page(rows, 500, 200)


PUSHES = "ps AS (SELECT event_id AS arrival, 'm-' || (event_id // 2) AS mutation_id, 'c' || ((event_id // 2) % 3) AS client_id, ((event_id // 2) // 3) + 1 + CASE WHEN (event_id // 2) % 50 = 0 THEN 1 ELSE 0 END AS client_seq FROM events)"
ONCE = f"{PUSHES}, oc AS (SELECT client_id, client_seq, mutation_id, min(arrival) AS arrival FROM ps GROUP BY ALL)"


def pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every write pushed twice; of each fiftieth the number is one too high."""
    m = F.floor(F.col("event_id") / 2)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("arrival"), F.concat(F.lit("m-"), m.cast("string")).alias("mutation_id"), F.concat(F.lit("c"), (m % 3).cast("string")).alias("client_id"),
        (F.floor(m / 3) + 1 + F.when(m % 50 == 0, 1).otherwise(0)).alias("client_seq"),
    )


@query(f"WITH {ONCE} SELECT arrival, mutation_id FROM oc")
def sync_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.replayed_once(pushes(spark, sf_dir)).select("arrival", "mutation_id")


@query(f"WITH {ONCE}, g AS (SELECT client_id, client_seq, lag(client_seq) OVER (PARTITION BY client_id ORDER BY client_seq) AS before, arrival FROM (SELECT DISTINCT client_id, client_seq, 0 AS arrival FROM oc)) SELECT client_id, client_seq, coalesce(before, 0) + 1 AS expected FROM g WHERE client_seq <> coalesce(before, 0) + 1")
def sync_seq_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = sync.replayed_once(pushes(spark, sf_dir)).select("client_id", "client_seq").distinct()
    return sync.gaps(once).select("client_id", "client_seq", "expected")


@query(f"WITH {ONCE} SELECT client_id, max(client_seq) AS last_seen FROM oc GROUP BY client_id")
def sync_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.last_seen(sync.replayed_once(pushes(spark, sf_dir)))


@query("SELECT event_id AS page FROM events WHERE (event_id // 10) % 3 = 0")
def sync_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of ten pages: a third ends well, a third has an error, a third never completes."""
    run, last = F.floor(F.col("event_id") / 10), F.col("event_id") % 10 == 0
    pages = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("page"), F.lit("s").alias("subscription"), run.alias("run"), (last & (run % 3 != 2)).alias("complete"),
        F.when((run % 3 == 1) & last, "error").otherwise("changes").alias("type"),
    )
    return sync.staged(pages).select("page")


@query("SELECT n_nationkey AS n_nationkey, n_name FROM nation WHERE n_regionkey <> 1")
def sync_local_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").withColumn("entity_type", F.col("n_regionkey").cast("string"))
    registry = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("entity_type"), (F.col("r_regionkey") == 1).alias("local"))
    return sync.shared(rows, registry).select("n_nationkey", "n_name")


# ---- wire ----


@query("SELECT i AS status, CASE WHEN i BETWEEN 200 AND 299 THEN 'verdict' WHEN i = 409 THEN 'schema' WHEN i IN (408, 429) THEN 'transient' WHEN i BETWEEN 400 AND 499 THEN 'permanent' ELSE 'transient' END AS outcome, NOT (i BETWEEN 200 AND 299) AS raises FROM range(100, 600) t(i)")
def wire_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(100, 600).select(F.col("id").alias("status")).withColumn("outcome", wire.status_class(F.col("status")))
    return rows.withColumn("raises", wire.raises(F.col("outcome")))


@query("SELECT i AS attempt, floor(0.5 * least(60000, 1000 * pow(2, greatest(0, i - 1))))::BIGINT AS wait FROM range(0, 40) t(i)")
def wire_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(0, 40).select(F.col("id").alias("attempt"), wire.backoff(F.col("id"), F.lit(0.5)).alias("wait"))


VERSIONS = [("10", "9"), ("9", "10"), ("1.0", "1"), ("a", "b"), ("b", "10"), ("", "0"), ("0x1f", "31"), ("1e3", "999"), ("abc", "abc"), (" 7 ", "7"), ("-1", "1"), ("v10", "v9")]


@query("SELECT * FROM (VALUES ('10', '9', 'newer'), ('9', '10', 'older'), ('1.0', '1', 'same'), ('a', 'b', 'older'), ('b', '10', 'newer'), ('', '0', 'same'), ('0x1f', '31', 'same'), ('1e3', '999', 'newer'), ('abc', 'abc', 'same'), (' 7 ', '7', 'same'), ('-1', '1', 'older'), ('v10', 'v9', 'older')) AS t(a, b, answer)")
def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(VERSIONS, "a string, b string").withColumn("answer", wire.compare_versions(F.col("a"), F.col("b")))


# ---- schema and surface ----

SCHEMA = {
    "contact": Definition(id_field="id", fields={"id": "string", "age": "number"}, relations={"org": Relation("organization"), "vault": Relation("vaultSecret", many=True)}),
    "organization": Definition(get_id=lambda x: x["a"], fields={"title": {"type": "string", "description": "shown"}}, merge=lambda a, b: a),
    "vaultSecret": Definition(local=True),
}


def _flat(spark: SparkSession, schema: dict) -> DataFrame:
    rows = [(name, json.dumps(e["idField"]), e["computedId"], e["customMerge"], e["local"], ",".join(e["fields"]), ",".join(f"{n}>{r['entity']}{'*' * r['many']}" for n, r in e["relations"].items())) for name, e in schema["entities"].items()]
    return spark.createDataFrame(rows, "entity string, id_field string, computed_id boolean, custom_merge boolean, local boolean, fields string, relations string")


@query("""SELECT * FROM (VALUES ('contact', '"id"', false, false, false, 'id,age', 'org>organization,vault>vaultSecret*'), ('organization', 'null', true, true, false, 'title', ''),
('vaultSecret', 'null', false, false, true, '', '')) AS t(entity, id_field, computed_id, custom_merge, local, fields, relations)""")
def schema_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, export_schema(SCHEMA))


@query("""SELECT * FROM (VALUES ('contact', '"id"', false, false, false, 'id,age', 'org>organization'), ('organization', 'null', true, true, false, 'title', '')) AS t(entity, id_field, computed_id, custom_merge, local, fields, relations)""")
def schema_relations_scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, scrub(export_schema(SCHEMA), {"contact", "organization"}))


@query("SELECT 'part' AS entity_type, count(*) AS n, NULL AS refusal FROM part WHERE p_size > 40 UNION ALL SELECT 'secret', NULL, 'TYPE_NOT_ALLOWED' UNION ALL SELECT 'bad', NULL, 'INVALID_FILTER'")
def surface_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    surface = QuerySurface(lambda _: table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id"), SCHEMA, ["part"])
    good = surface.query_entities({"entityType": "part", "filter": {"op": "gt", "field": "p_size", "value": 40}, "limit": 5})
    refused = surface.query_entities({"entityType": "secret"})
    bad = surface.query_entities({"entityType": "part", "filter": {"op": "like", "field": "p_size", "value": "4%"}})
    rows = [("part", good["count"], None), ("secret", None, refused["error"]["code"]), ("bad", None, bad["error"]["code"])]
    return spark.createDataFrame(rows, "entity_type string, n bigint, refusal string")
