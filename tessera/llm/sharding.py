"""Sharding by size-tiered compaction.

A store is a folder of immutable runs and of numbered manifests. Arrivals are appended as runs of small shards, one
for each task that writes, without a shuffle. Compaction takes runs of similar size (those less than ``fanout`` times
the smallest of them) once ``fanout`` of them have gathered, and writes their rows as one run of target-sized shards,
one file each, in the order of arrival. A run whose shards have reached the target is full and is not merged again;
runs that too few others resemble stay as they are. A merge is written by jobs of a bounded number of shards.

A manifest lists the runs of a version. Its file is written aside and renamed into place, which only one writer can
do; it follows the version its writer has read, so that no other writer's runs are lost. A writer that comes second
reads again: an append adds its runs to the later version, a merge does so if all that it has merged is still listed.
A reader of an older version keeps its runs until ``vacuum``; what a failed writer leaves is in no manifest.

Rows are dealt to shards by the running total of bytes in the order of arrival: totals are taken for pieces of 100
rows, summed within a file and over files, and a shard takes whole pieces until it is full. So a shard exceeds the
target by less than a piece, whatever document, key or source fills it.

Defined cases: null text counts 0 bytes; repeated rows and null doc_id are rows like others; a document larger than the
target gets a shard for its piece; an empty table gives a version without rows; all columns are kept, and one that
has a name of the store's own (tessera_*) is an error; where ``docs`` has a column shard or place, the added ones are
called tessera_shard and tessera_place.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import FILE, ROW, commit_file, hadoop_path, passing, placed_rows, scratch, stored

TARGET, FANOUT, PIECE = 64 << 20, 4, 100
#: Shards that one job of a merge writes.
MERGE_SHARDS = 4_096
BYTES, RUN, SHARD, HELD_PIECE = "tessera_bytes", "tessera_run", "tessera_shard", "tessera_piece"


@dataclass(frozen=True)
class Run:
    path: str
    n_docs: int
    n_bytes: int
    #: Shards are numbered below it.
    span: int
    n_shards: int
    #: Where the first of its rows lay on arrival.
    first_file: str
    first_row: int
    full: bool = False


class Conflict(Exception):
    """Another writer has committed the version."""


def arrivals(docs: DataFrame) -> DataFrame:
    """``docs`` with the order of their rows: that of the files they are read from, else that of their partitions."""
    if taken := [c for c in docs.columns if c.lower().startswith("tessera_")]:
        raise ValueError(f"columns with names of the store's own: {', '.join(taken)}")
    found = placed_rows(docs)
    if found is None:
        found = docs.select("*", F.lpad(F.spark_partition_id().cast("string"), 10, "0").alias(FILE), F.monotonically_increasing_id().alias(ROW))
    return found


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, *, target: int = TARGET, fanout: int = FANOUT) -> None:
        if fanout < 2:
            raise ValueError("a merge takes two runs at least")
        self.spark, self.path, self.target, self.fanout = spark, path, target, fanout

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifests/{version:012d}.json"

    def version(self) -> int:
        """The last version; 0 for a new store."""
        fs, folder = hadoop_path(self.spark, f"{self.path}/manifests")
        if not fs.exists(folder):
            return 0
        return max((int(x.getPath().getName()[:12]) for x in fs.listStatus(folder) if x.getPath().getName().endswith(".json")), default=0)

    def snapshot(self, version: int | None = None) -> tuple[int, list[Run]]:
        """A version, the last one unless given, and its runs."""
        version = self.version() if version is None else version
        if not version:
            return 0, []
        text = self.spark.read.text(self._manifest(version), wholetext=True).first()[0]
        return version, [Run(**x) for x in json.loads(text)["runs"]]

    def runs(self, version: int | None = None) -> list[Run]:
        return self.snapshot(version)[1]

    def commit(self, runs: list[Run], version: int) -> int:
        """Makes ``runs`` the given version, if nobody else has made it; the one before must be what they were made of."""
        text = json.dumps({"version": version, "runs": [asdict(x) for x in runs]})
        try:
            commit_file(self.spark, self._manifest(version), text)
        except FileExistsError as error:
            raise Conflict(f"version {version} exists") from error
        return version

    def append(self, docs: DataFrame, *, runs: int = 1) -> int:
        """Adds the rows of ``docs``, dealt by task to as many runs, as the next version."""
        at = f"{self.path}/data/append-{uuid.uuid4().hex}"
        size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
        task = F.spark_partition_id()
        rows = arrivals(docs).withColumns({BYTES: size, RUN: F.pmod(task, F.lit(runs)), SHARD: F.floor(task / runs).cast("int")})
        rows.write.option("compression", "zstd").partitionBy(RUN, SHARD).parquet(at)
        written = self.spark.read.schema(rows.schema).parquet(at)
        first = F.min(F.struct(FILE, ROW))
        held = written.groupBy(RUN).agg(F.count(F.lit(1)), F.sum(BYTES), F.max(SHARD) + 1, F.countDistinct(SHARD), first).orderBy(RUN).collect()
        new = [Run(f"{at}/{RUN}={k}", n, b, span, shards, *place) for k, n, b, span, shards, place in held]
        while True:
            version, found = self.snapshot()
            try:
                return self.commit(found + new, version + 1)
            except Conflict:
                continue  # the runs don't depend on others: they are added to what is there now

    def _rows(self, runs: list[Run]) -> DataFrame | None:
        """The rows of some runs, + the run's place in the list and the shard."""
        found = None
        for at, run in enumerate(runs):
            part = self.spark.read.option("basePath", run.path).parquet(run.path).withColumn(RUN, F.lit(at))
            found = part if found is None else found.unionByName(part, allowMissingColumns=True)
        return found

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows, with tessera_run and tessera_shard; None for an empty store."""
        return self._rows(self.runs(version))

    def similar(self, runs: list[Run]) -> list[Run]:
        """The smallest runs of one size that are enough for a merge, in the order of the list; none if there are not."""
        left = sorted((x for x in runs if not x.full), key=lambda x: x.n_bytes)
        while left:
            tier = [x for x in left if x.n_bytes < self.fanout * max(1, left[0].n_bytes)]
            if len(tier) >= self.fanout:
                return [x for x in runs if x in tier]
            left = left[len(tier) :]
        return []

    def compact(self) -> int:
        """Merges runs of similar size, a new version for each merge, until too few are left of any."""
        while True:
            version, runs = self.snapshot()
            tier = self.similar(runs)
            if not tier:
                return version
            merged = self._merge(tier)
            while set(tier) <= set(runs):
                at = runs.index(tier[0])
                left = [x for x in runs if x not in tier]
                try:
                    self.commit([*left[:at], merged, *left[at:]], version + 1)
                    break
                except Conflict:
                    version, runs = self.snapshot()

    def _merge(self, runs: list[Run]) -> Run:
        with passing(self.spark):
            rows = self._rows(runs).drop(SHARD, RUN).withColumn(HELD_PIECE, F.floor(F.col(ROW) / PIECE))
            pieces = stored(rows.groupBy(FILE, HELD_PIECE).agg(F.sum(BYTES).alias("held")), "pieces")
            files = pieces.groupBy(FILE).agg(F.sum("held").alias("held"))
            # a row for each file of arrivals
            offsets = files.select(FILE, F.coalesce(F.sum("held").over(Window.orderBy(FILE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
            within = F.coalesce(F.sum("held").over(Window.partitionBy(FILE).orderBy(HELD_PIECE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            start = (F.col("offset") + F.col("within")).cast("double")
            placed = pieces.withColumn("within", within).join(offsets, FILE).select(FILE, HELD_PIECE, F.floor(start / self.target).cast("int").alias(SHARD))
            placed = stored(placed, "placed")
            n_bytes = sum(x.n_bytes for x in runs)
            span = max(1, math.ceil(n_bytes / self.target))
            at = f"{self.path}/data/merged-{uuid.uuid4().hex}"
            for low in range(0, span, MERGE_SHARDS):
                own, part = placed.where(F.col(SHARD).between(low, low + MERGE_SHARDS - 1)), rows
                if span > MERGE_SHARDS:  # the scan leaves out what lies in other jobs' files
                    least, most = own.agg(F.min(FILE), F.max(FILE)).first()
                    part = rows.where(F.col(FILE).between(least, most))
                dealt = part.join(own, [FILE, HELD_PIECE]).drop(HELD_PIECE).repartitionById(min(MERGE_SHARDS, span - low), F.col(SHARD) - low)
                dealt.sortWithinPartitions(SHARD, FILE, ROW).write.mode("append").option("compression", "zstd").partitionBy(SHARD).parquet(at)
            n_shards = placed.select(SHARD).distinct().count()
            first = min((x.first_file, x.first_row) for x in runs)
            return Run(at, sum(x.n_docs for x in runs), n_bytes, span, n_shards, *first, full=n_bytes * 2 >= n_shards * self.target)

    def vacuum(self) -> None:
        """Deletes runs that the last version doesn't list. Only for a store without other writers, or readers of older versions."""
        kept = {x.path for x in self.runs()}
        fs, folder = hadoop_path(self.spark, f"{self.path}/data")
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            path = status.getPath()
            if not any(f"{x}/".startswith(f"{self.path}/data/{path.getName()}/") for x in kept):
                fs.delete(path, True)


def sharded(docs: DataFrame, path: str, *, target: int = TARGET, fanout: int = FANOUT) -> DataFrame:
    """What the store at ``path`` holds after ``docs`` is appended and compacted: their columns, shard and place.

    Shards are numbered by where their runs' first rows lay on arrival; place is the row in the shard.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, path, target=target, fanout=fanout)
    store.append(docs, runs=fanout)
    store.compact()
    store.vacuum()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    taken = {"shard", "place"} & {c.lower() for c in docs.columns}
    names = ("tessera_shard", "tessera_place") if taken else ("shard", "place")
    final = sorted(store.runs(), key=lambda x: (x.first_file, x.first_row))
    if not final:
        return docs.limit(0).select(*columns, *(F.lit(0).cast("long").alias(x) for x in names))
    offsets, n = [], 0
    for run in final:
        offsets.append(n)
        n += run.span
    offset = F.element_at(F.array(*map(F.lit, offsets)), F.col(RUN) + 1)
    found = None
    for at, run in enumerate(final):
        rows = spark.read.option("basePath", run.path).parquet(run.path)
        part = rows.select("*", F.lit(at).alias(RUN), F.col("_metadata.row_index").alias("tessera_place"))
        found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    return found.select(*columns, (offset + F.col(SHARD)).cast("long").alias(names[0]), F.col("tessera_place").alias(names[1]))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, shard and place of every document, n_bytes of its text."""
    docs = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch(spark, "shards"))
    return docs.select("doc_id", "shard", "place", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
