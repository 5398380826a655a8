"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations.

Every source has a weight schedule over training time t in [0, 1], rate(t) = share * (1 + tilt * (2 t - 1)), whose
integral is the source's share. Shares come from the weights, stopped at ``cap`` times a source's size with the
excess reshared by weight (water filling in closed form). A source's documents, in a hashed order and repeated in
whole passes, form its token stream; the cumulative demand D(t) is inverted at the middle of each occurrence, which
gives its training position, and the mix is range-sorted by position.

Texts are read once for their sizes; what follows works on a narrow table, and ``mix`` joins the documents to it by
their place in the input. The running totals that place a document in its source's stream are two-level: hash buckets
are summed first, and rows are only ranked within a bucket, so that a source with a third of all rows is spread over
many tasks. Rows that share a doc_id are told apart by a digest of their text, equal rows by their place; where they are
more than a bucket holds, these spread them over buckets of their own.

Defined cases: null text has size 0 and is never taken; null source is a source of its own, last in order; a row
without doc_id is ordered by its text; repeated rows are rows of their own; an empty table gives an empty mix; further
columns are kept by ``mix`` under their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import FILE, ROW, WORD, placed_rows, stored

WEIGHTS = (3.0, 1.0, 2.0)
#: Rows of a bucket in which a window ranks, about.
BUCKET_ROWS = 2_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], total: float, cap: float) -> DataFrame:
    """sizes (source, source_size) -> with weight, rank and target; the targets' sum is ``total`` times all sizes.

    With sources in the order of cap * size / weight, the stopped ones are a prefix; the level of the others is the
    rest of the demand over the rest of the weights, and a source is stopped where that level exceeds its own.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    by_level = Window.orderBy("level", "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rank = F.row_number().over(by_name) - 1
    ranked = sizes.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")))
    every = Window.partitionBy()
    filled = (
        ranked.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("level", F.col("most") / F.col("weight"))
        .withColumn("rest", F.sum("source_size").over(every) * F.lit(total) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("share", F.col("rest") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("open", F.col("level") > F.col("share"))
    )
    first = F.min(F.when(F.col("open"), F.struct("level", "rank"))).over(every)
    stopped = F.coalesce(F.struct("level", "rank") < first, F.lit(True))
    # the share of the first open source holds for all later ones
    flat = F.min(F.when(F.struct("level", "rank") == F.col("first"), F.col("share"))).over(every)
    return (
        filled.withColumn("first", first).withColumn("flat", flat)
        .withColumn("target", F.when(stopped, F.col("most")).otherwise(F.least(F.col("flat") * F.col("weight"), F.col("most"))))
        .select("source", "source_size", "weight", "rank", "target")
    )


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with the file and the row in it of each row; a table of its own if it is no plain scan."""
    rows = placed_rows(docs)
    return placed_rows(stored(docs, "rows", compression="zstd")) if rows is None else rows


def _digits(n: Column) -> Column:
    """Hexadecimal digits by which n rows fall into buckets of BUCKET_ROWS, about."""
    return F.greatest(F.ceil(F.log(16.0, n / F.lit(float(BUCKET_ROWS)))), F.lit(1)).cast("int")


def curriculum(
    docs: DataFrame, *, weights: Sequence[float] = WEIGHTS, total: float = 1.5, cap: float = 2.0, tilt: float = 0.5,
    key: Column | None = None, kept: Sequence[str] = (),
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, start (of its place in the source's
    stream), tilt and the columns in ``kept``, its place (tessera_file, tessera_row) being among those it may name.
    ``key`` orders a source's stream and defaults to a digest of doc_id."""
    docs = docs if FILE in docs.columns else placed(docs)
    body = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), body.cast("string")))) if key is None else key
    source = F.col("source").cast("string")
    narrow = stored(docs.select(
        "doc_id", source.alias("source"), F.coalesce(F.concat(F.lit("s"), source), F.lit("")).alias("name"), word_count().alias("size"),
        key.alias("key"), body.alias("body"), F.xxhash64(FILE, ROW).alias("spot"), *kept,
    ), "sizes")
    digits = narrow.agg(_digits(F.count(F.lit(1)).cast("double"))).first()[0] or 1
    rows = narrow
    for by, count in ((["key"], "texts"), (["key", "body"], "copies")):  # at most a row for BUCKET_ROWS rows
        many = narrow.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n")).where(F.col("n") > BUCKET_ROWS)
        rows = rows.join(many.select(*by, _digits(F.col("n")).alias(count)), by, "left")
    # copies are together whatever their places, so that the mix doesn't depend on these
    some = {"body": "if(copies IS NULL, texts, 16)", "spot": "copies"}
    apart = [F.coalesce(F.expr(f"substring(lpad(hex({c}), 16, '0'), 1, {n})"), F.lit("")) for c, n in some.items()]
    rows = rows.withColumn("bucket", F.concat(F.substring("key", 1, digits), *apart))
    buckets = rows.groupBy("name", "source", "bucket").agg(F.sum("size").alias("in_bucket"))
    sizes = buckets.groupBy("name", "source").agg(F.sum("in_bucket").alias("source_size"))
    targets = source_targets(sizes.select("source", "source_size"), weights, total, cap).withColumn(
        "name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    )
    upto = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        buckets.withColumn("offset", F.coalesce(F.sum("in_bucket").over(upto), F.lit(0)))
        .select("name", "bucket", "offset").join(targets.drop("source"), "name")
    )
    within = Window.partitionBy("name", "bucket").orderBy("key", "body", "spot").rowsBetween(Window.unboundedPreceding, -1)
    dealt = rows.withColumn("local", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["name", "bucket"])
    quota = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0).cast("long")
    start = F.col("offset") + F.col("local")
    rest = quota - passes * F.col("source_size") - start
    taken = passes * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least("size", rest))
    slope = F.when(F.pmod("rank", F.lit(2)) == 0, F.lit(tilt)).otherwise(F.lit(-tilt))
    return dealt.select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("taken"), start.alias("start"), slope.alias("tilt"), *kept
    )


def position(midpoint: Column, target: Column, tilt: Column) -> Column:
    """Inverts D(t) = target * (t + tilt * (t^2 - t)) at ``midpoint``."""
    y = F.least(F.greatest(midpoint / target, F.lit(0.0)), F.lit(1.0))
    b = F.lit(1.0) - tilt
    return 2 * y / (b + F.sqrt(b * b + 4 * tilt * y))


def occurrences(mixed: DataFrame) -> DataFrame:
    """A row for each pass in which the mix takes words of a document: + pass, words and position."""
    upto = F.ceil(F.col("taken") / F.col("size")).cast("int")
    each = mixed.where("taken > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), upto - 1)))
    words = F.least("size", F.col("taken") - F.col("pass") * F.col("size"))
    return each.withColumn("words", words).withColumn(
        "position", position(F.col("pass") * F.col("source_size") + F.col("start") + F.col("words") / 2, F.col("target"), F.col("tilt"))
    )


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The documents' own columns: a row for each pass that takes at least half of a document, sorted by position."""
    rows = placed(docs)
    taken = occurrences(curriculum(rows, kept=[FILE, ROW], **settings)).where(F.col("words") * 2 >= F.col("size"))
    whole = rows.select(FILE, ROW, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    mixed = taken.select(FILE, ROW, "position", F.col("doc_id").alias("own"), "pass").join(whole, [FILE, ROW])
    return mixed.orderBy("position", "own", "pass", FILE, ROW).select("whole.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    first = position(F.col("start") + F.least("size", "taken") / 2, F.col("target"), F.col("tilt"))
    placed = mixed.withColumn("position", F.when(F.col("taken") > 0, F.round(first, 9)))
    return placed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id").select(
        "doc_id", "size", "source_size", "target", "taken", "position"
    )


ORACLE = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                  md5(doc_id::VARCHAR) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
             source_size * 2.0::DOUBLE AS most FROM s),
l AS (SELECT *, most / weight AS level FROM w),
f AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER b, 0)) /
             (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS share FROM l
      WINDOW b AS (ORDER BY level, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT level AS first_level, rank AS first_rank, share AS flat FROM f WHERE level > share ORDER BY level, rank LIMIT 1),
t AS (SELECT source, source_size, rank, CASE WHEN (level, rank) < (first_level, first_rank) THEN most
             ELSE least(flat * weight, most) END AS target FROM f, k),
p AS (SELECT d.*, t.source_size, t.target, t.rank, round(t.target)::BIGINT AS quota,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS passes,
             CASE WHEN rank % 2 = 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS tilt FROM p),
r AS (SELECT *, (passes * size + greatest(0, least(size, quota - passes * source_size - start)))::BIGINT AS taken FROM q),
y AS (SELECT *, least(greatest((start + least(size, taken) / 2.0::DOUBLE) / target, 0.0::DOUBLE), 1.0::DOUBLE) AS y FROM r)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(2 * y / ((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * y)), 9) END AS position
FROM y
"""
