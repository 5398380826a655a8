"""Exact dedup as a log-structured merge index over text digests, in DataFrame operations only.

Arrivals go to memtables (the scan's tasks, dealt to a fixed number of tables), one after the other. A memtable is
flushed as a run: one row per digest, sorted by digest, with the least and the greatest digest and a filter, a table
of bitmaps in which each digest has three bits (made when the run is first probed: some are merged before). Before that run counts as part of the index, its digests are probed
against the older runs, newest first: only those between a run's ends whose bits are all set are looked up in it.
Digests that occur twice in a memtable or are found in an older run are the hits. Once ``fanout`` runs of a level have
gathered, compaction merges them to a run of the next level and keeps one identifier a digest (the smallest or the
largest, as asked for), so that later memtables probe few runs.

A digest without a hit is that of a unique text. For hits, the runs say which row stays; the texts of their rows are
joined with that row's text and compared byte by byte, and rows that only share the digest are regrouped by the text
itself.

Defined cases: null text counts as empty; null doc_id sorts below all others; of rows that tie on text and doc_id
exactly one stays; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import scratch, stored, whole

#: A filter's bits in a row (what a bitmap function holds), a digest's share of bits, and the bits it sets.
BLOCK, BITS_A_KEY, SPOTS = 32_768, 16, 3
FANOUT = 2


def sha256(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


@dataclass(frozen=True)
class Run:
    name: str
    level: int


@dataclass(frozen=True)
class Filter:
    """A run's ends, and the blocks of its table of bitmaps."""

    n_blocks: int
    least: bytes
    most: bytes


class DigestIndex:
    """Runs of (digest, best, copies) below ``path``, oldest first; ``best`` is struct(doc_id, row)."""

    SCHEMA = "digest binary, best struct<doc_id:bigint,row:bigint>, copies bigint"

    def __init__(self, spark: SparkSession, path: str, keep: str = "smallest", fanout: int = FANOUT) -> None:
        if keep not in ("smallest", "largest"):
            raise ValueError("keep must be 'smallest' or 'largest'")
        if fanout < 2:
            raise ValueError("a merge takes two runs at least")
        self.spark, self.path, self.keep, self.fanout, self.made = spark, path, keep, fanout, 0
        self.runs: list[Run] = []
        self.filters: dict[str, Filter] = {}

    def _best(self, column: str | Column) -> Column:
        return (F.min if self.keep == "smallest" else F.max)(column)

    def _write(self, rows: DataFrame, level: int, files: int | None = None) -> Run | None:
        """A run; None if there are no rows."""
        name, self.made = f"level{level}-{self.made}", self.made + 1
        rows = rows if files is None else rows.coalesce(files)
        options = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
        rows.sortWithinPartitions("digest").write.options(**options).parquet(f"{self.path}/{name}")
        return None if self._read(name).isEmpty() else Run(name, level)

    def filter(self, run: Run) -> Filter:
        """The filter of a run that has rows, made once."""
        if run.name not in self.filters:
            n, least, most = self._read(run.name).agg(F.count(F.lit(1)), F.min("digest"), F.max("digest")).first()
            made = Filter(-(-n * BITS_A_KEY // BLOCK), bytes(least), bytes(most))
            spots = self._read(run.name).select(self._block(made).alias("block"), F.explode(F.array(*self._spots())).alias("spot"))
            # dealt by block first, so that a task holds whole bitmaps and sends none
            spots.repartition("block").groupBy("block").agg(F.bitmap_construct_agg("spot").alias("bits")).write.parquet(f"{self.path}/filter-{run.name}")
            self.filters[run.name] = made
        return self.filters[run.name]

    @staticmethod
    def _block(of: Filter) -> Column:
        return F.pmod(F.xxhash64("digest"), F.lit(of.n_blocks))

    @staticmethod
    def _spots() -> list[Column]:
        return [F.pmod(F.xxhash64("digest", F.lit(i)), F.lit(BLOCK)) for i in range(SPOTS)]

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/{name}")

    def flush(self, keyed: DataFrame, files: int | None = None) -> DataFrame:
        """keyed (digest, doc_id, row), a memtable: writes it as a run of so many files and returns the hits' digests."""
        own = keyed.groupBy("digest").agg(self._best(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("copies"))
        run = self._write(own, 0, files)
        if run is None:
            return keyed.select("digest").limit(0)
        hits = self._read(run.name).where("copies > 1").select("digest")
        for older in reversed(self.runs):
            hits = hits.unionByName(self.probe(self._read(run.name), older))
        hits = stored(hits.distinct(), "hits")
        self.runs.append(run)
        return hits

    def maybe(self, asked: DataFrame, run: Run) -> DataFrame:
        """The rows of ``asked`` whose digests lie between the run's ends and pass its filter."""
        own = self.filter(run)
        ends = F.col("digest").between(F.lit(own.least), F.lit(own.most))
        bits = self.spark.read.schema("block bigint, bits binary").parquet(f"{self.path}/filter-{run.name}")
        byte = lambda spot: F.conv(F.hex(F.substring("bits", (F.floor(spot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        is_set = [F.getbit(byte(spot), (spot % 8).cast("int")) == 1 for spot in self._spots()]
        near = asked.where(ends).withColumn("block", self._block(own)).join(bits, "block")
        passed = is_set[0]
        for more in is_set[1:]:
            passed = passed & more
        return near.where(passed).select(*asked.columns)

    def probe(self, asked: DataFrame, run: Run) -> DataFrame:
        """The digests of ``asked`` that the run holds."""
        return self._read(run.name).join(self.maybe(asked.select("digest"), run), "digest", "left_semi").select("digest")

    def _merged(self, runs: list[Run]) -> DataFrame:
        rows = self._read(runs[0].name)
        for run in runs[1:]:
            rows = rows.unionByName(self._read(run.name))
        return rows.groupBy("digest").agg(self._best("best").alias("best"), F.sum("copies").alias("copies"))

    def tier(self) -> None:
        """Merges the runs of each level that holds ``fanout`` of them to one of the next."""
        while True:
            full = next((x for x in sorted({r.level for r in self.runs}) if sum(r.level == x for r in self.runs) >= self.fanout), None)
            if full is None:
                return
            old = [r for r in self.runs if r.level == full]
            self.runs = [self._write(self._merged(old), full + 1) if r is old[0] else r for r in self.runs if r not in old[1:]]

    def compact(self) -> DataFrame:
        """Merges all runs to one and returns it."""
        self.runs = [self._write(self._merged(self.runs), max(r.level for r in self.runs) + 1)]
        return self._read(self.runs[0].name)

    def lookup(self, asked: DataFrame) -> DataFrame:
        """digest, best and copies of the digests of ``asked``, over all runs."""
        found = None
        for run in reversed(self.runs):
            own = self._read(run.name).join(self.maybe(asked.select("digest"), run), "digest", "left_semi")
            found = own if found is None else found.unionByName(own)
        if found is None:
            return self.spark.createDataFrame([], self.SCHEMA)
        return found.groupBy("digest").agg(self._best("best").alias("best"), F.sum("copies").alias("copies"))


def exact_dedup(
    docs: DataFrame, *, keep: str = "smallest", memtables: int = 4, digest: Callable[[Column], Column] = sha256, hot: int = 1000
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest (binary).

    ``hot``: rows of one group that a copy of its kept text serves; larger groups get salted copies of it.
    """
    spark = docs.sparkSession
    bodies = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("body")).withColumn("digest", digest(F.col("body")))
    memtable = F.pmod(F.spark_partition_id(), F.lit(memtables)).alias("memtable")
    keyed = stored(bodies.select("doc_id", "digest", F.monotonically_increasing_id().alias("row"), memtable), "digests")
    index, hits = DigestIndex(spark, scratch(spark, "lsm"), keep), None
    for k in range(memtables):
        found = index.flush(keyed.where(F.col("memtable") == k).select("digest", "doc_id", "row"))
        hits = found if hits is None else hits.unionByName(found)
        index.tier()

    repeated = stored(index.lookup(hits.distinct()), "repeated")
    # the hits grow with the input: one plan at every size, and none that broadcasts them
    texts = stored(bodies.join(repeated.hint("merge"), "digest").select("digest", "doc_id", "body", "best", "copies"), "texts", compression="zstd")
    salts = F.ceil(F.col("copies") / hot).cast("int")
    models = (
        texts.where(F.col("doc_id").eqNullSafe(F.col("best.doc_id")))
        .groupBy("digest", "copies").agg(F.max("body").alias("model"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("copies")
    )
    # the copies of one doc_id, null included, are dealt as evenly as others
    salted = texts.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), salts).cast("int"))
    collided = stored(salted.join(models, ["digest", "salt"]).where("body != model").select("digest").distinct(), "collided")

    own = keyed.select("doc_id", "row", "digest")
    if collided.isEmpty():
        placed = own.join(repeated, "digest", "left")
    else:
        extreme = F.min if keep == "smallest" else F.max
        marked = stored(bodies.withColumn("row", F.monotonically_increasing_id()).join(collided, "digest", "left_semi"), "marked")
        groups = marked.groupBy("digest", "body").agg(extreme(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("copies"))
        placed = (
            own.join(collided, "digest", "left_anti").join(repeated, "digest", "left").select("doc_id", "row", "digest", "best", "copies")
            .unionByName(marked.join(groups, ["digest", "body"]).select("doc_id", "row", "digest", "best", "copies"))
        )
    alone = F.col("copies").isNull()
    return placed.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
        F.when(alone, F.lit(True)).otherwise(F.col("row") == F.col("best.row")).alias("kept"), "digest",
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
