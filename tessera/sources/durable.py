"""The durable table of entities: Parquet snapshots behind a version pointer, with the engine contract.

A write makes a new snapshot (old rows without the written and deleted keys, and the puts) in a folder of its own, and
then commits the pointer file of the version after the one it has read, which only one writer can. Readers see whole
versions. Snapshots are split in buckets by key: a write rewrites only the buckets that it touches, a read by keys reads
only theirs. The number of buckets is set by a store's first write and kept in its pointer; it should make buckets of
about a gigabyte.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
import warnings
from collections.abc import Callable, Sequence
from typing import Protocol, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.changes import fold_documents
from tessera.sources.scratch import commit_file, hadoop_path, read_text, stored

FORMAT_VERSION = 1
#: Tries to open a store, seconds between them and for each.
ATTEMPTS, GAP, OPEN_DEADLINE = 2, 0.25, 30.0
SCHEMA = "entity_type string, id string, data string, row_version bigint, updated_at bigint"
KEY = ["entity_type", "id"]


Result = TypeVar("Result")


def within(seconds: float, action: Callable[[], Result]) -> Result:
    """What ``action`` returns or raises; TimeoutError if it takes longer. It is not stopped then, only left."""
    done: list[tuple[bool, object]] = []

    def run() -> None:
        try:
            done.append((True, action()))
        except BaseException as error:  # told to the caller
            done.append((False, error))

    worker = threading.Thread(target=run, daemon=True)
    worker.start()
    worker.join(seconds)
    if not done:
        raise TimeoutError(f"no result within {seconds} s")
    good, found = done[0]
    if not good:
        raise found
    return found


def attempted(action: Callable[[], Result], attempts: int = ATTEMPTS, gap: float = GAP, deadline: float = OPEN_DEADLINE, pause: Callable[[float], None] = time.sleep) -> Result:
    """The first result of several tries, each within the deadline; the last failure if all fail."""
    for attempt in range(attempts):
        if attempt:
            pause(gap)
        try:
            return within(deadline, action)
        except Exception as error:
            last = error
    raise last


class StorageBackend(Protocol):
    """open, load_all, load_many, write_batch, close; ``persistent`` says whether data outlives the session."""

    persistent: bool

    def open(self) -> None: ...

    def load_all(self) -> DataFrame: ...

    def load_many(self, keys: DataFrame) -> DataFrame: ...

    def write_batch(self, puts: DataFrame, deletes: DataFrame) -> None: ...

    def close(self) -> None: ...


def upserted(old: DataFrame, puts: DataFrame, deletes: DataFrame, now: int = 0) -> DataFrame:
    """old with puts replacing whole rows, without deletes; a row's version counts its writes while it exists."""
    before = old.select(*KEY, F.col("row_version").alias("before"))
    new = puts.join(before, KEY, "left").select(*KEY, "data", (F.coalesce("before", F.lit(0)) + 1).alias("row_version"), F.lit(now).cast("long").alias("updated_at"))
    gone = puts.select(*KEY).unionByName(deletes.select(*KEY))
    fresh = new.join(deletes.select(*KEY), KEY, "left_anti")
    return old.join(gone, KEY, "left_anti").unionByName(fresh)


class MemoryBackend:
    """Rows as a table of the session, written anew by each batch so that its plan doesn't grow."""

    persistent = False

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.rows = spark, None

    @staticmethod
    def is_supported() -> bool:
        return True

    def open(self) -> None:
        if self.rows is None:
            self.rows = self.spark.createDataFrame([], SCHEMA)

    def load_all(self) -> DataFrame:
        self.open()
        return self.rows

    def load_many(self, keys: DataFrame) -> DataFrame:
        return self.load_all().join(keys.select(*KEY), KEY, "left_semi")

    def write_batch(self, puts: DataFrame, deletes: DataFrame) -> None:
        self.rows = stored(upserted(self.load_all(), puts, deletes), "memory-rows")

    def snapshot(self) -> DataFrame:
        return self.load_all()

    def close(self) -> None:
        """Nothing is held."""


class Conflict(Exception):
    """Another writer has committed the version."""


class ParquetBackend:
    """Snapshots below ``path``. ``buckets`` counts for a new store; the session's shuffle partitions unless given."""

    persistent = True

    def __init__(self, spark: SparkSession, path: str, *, buckets: int | None = None, attempts: int = ATTEMPTS, gap: float = GAP, deadline: float = OPEN_DEADLINE) -> None:
        self.spark, self.path, self.asked, self.warned = spark, path.rstrip("/"), buckets, False
        self.attempts, self.gap, self.deadline = attempts, gap, deadline

    @staticmethod
    def is_supported() -> bool:
        return True

    def _fs(self, path: str):
        return hadoop_path(self.spark, path)

    def open(self) -> None:
        def action() -> None:
            fs, folder = self._fs(f"{self.path}/versions")
            fs.mkdirs(folder)
            if (found := self.format_version()) > FORMAT_VERSION and not self.warned:
                self.warned = True
                warnings.warn(f"the store has format {found}, newer than {FORMAT_VERSION}", stacklevel=2)

        attempted(action, self.attempts, self.gap, self.deadline)

    def version(self) -> int:
        fs, folder = self._fs(f"{self.path}/versions")
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def _pointer(self) -> tuple[int, dict]:
        """The last version and what its pointer says: format, number of buckets, the folder of each."""
        version = self.version()
        if not version:
            return 0, {"format": FORMAT_VERSION, "n": self.asked or max(16, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "buckets": {}}
        return version, json.loads(read_text(self.spark, f"{self.path}/versions/{version:012d}.json"))

    def format_version(self) -> int:
        return self._pointer()[1].get("format", 1)

    @staticmethod
    def _bucket(n: int):
        return F.pmod(F.xxhash64(*KEY), F.lit(n)).cast("int")

    def _read(self, folders: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMA)

    def _touched(self, keys: DataFrame, n: int) -> list[int]:
        """The buckets of some keys: at most n rows."""
        return sorted(r[0] for r in keys.select(self._bucket(n).alias("b")).distinct().collect())

    def load_all(self) -> DataFrame:
        return self._read(sorted(self._pointer()[1]["buckets"].values()))

    def load_many(self, keys: DataFrame) -> DataFrame:
        """Rows of the given keys, from their buckets alone; keys without a row are left out, and no keys read nothing."""
        pointer = self._pointer()[1]
        folders = [pointer["buckets"][str(b)] for b in self._touched(keys, pointer["n"]) if str(b) in pointer["buckets"]]
        return self._read(folders).join(keys.select(*KEY), KEY, "left_semi")

    def write_batch(self, puts: DataFrame, deletes: DataFrame, now: int = 0) -> None:
        version, pointer = self._pointer()
        n, parts = pointer["n"], pointer["buckets"]
        touched = self._touched(puts.select(*KEY).unionByName(deletes.select(*KEY)), n)
        if not touched:
            return
        old = self._read([parts[str(b)] for b in touched if str(b) in parts])
        at = f"{self.path}/data/{uuid.uuid4().hex}"
        rows = upserted(old, puts, deletes, now).withColumn("bucket", self._bucket(n))
        rows.repartitionById(n, F.col("bucket")).write.partitionBy("bucket").parquet(at)
        fs, folder = self._fs(at)
        made = {x.getPath().getName().partition("=")[2] for x in fs.listStatus(folder) if x.getPath().getName().startswith("bucket=")}
        new = {k: v for k, v in parts.items() if int(k) not in touched} | {b: f"{at}/bucket={b}" for b in made}
        try:
            commit_file(self.spark, f"{self.path}/versions/{version + 1:012d}.json", json.dumps({"format": FORMAT_VERSION, "n": n, "buckets": new}))
        except FileExistsError as error:
            raise Conflict(f"version {version + 1} exists") from error

    def close(self) -> None:
        """Every write is durable when it returns."""


OPAQUE = "\x00"


def _images(log: DataFrame) -> DataFrame:
    """Folds changes (seq, op, key, data text) to key and data text. Data that is no JSON object replaces as it is."""
    data = F.expr("try_parse_json(data)")
    is_object = F.coalesce(F.schema_of_variant(data).startswith("OBJECT"), F.lit(False))
    shaped = F.when(is_object, data).otherwise(F.to_variant_object(F.create_map(F.lit(OPAQUE), F.col("data"))))
    op = F.when((F.col("op") == "set") & ~is_object, "replace").otherwise(F.col("op"))
    folded = fold_documents(log.select("seq", op.alias("op"), *KEY, shaped.alias("data")))
    fields = F.expr("cast(data AS map<string, variant>)")
    alone = (F.size(fields) == 1) & F.map_contains_key(fields, F.lit(OPAQUE))
    others = F.to_json(F.to_variant_object(F.map_filter(fields, lambda k, _: k != OPAQUE)))
    return folded.select(*KEY, F.when(alone, F.variant_get("data", f'$["{OPAQUE}"]', "string")).otherwise(others).alias("data"))


class WriteBehind:
    """Collects changes and writes each written key's image on ``flush``; a failure keeps them and is told once.

    A row is the image at the key's last write: patches merge onto the durable row, unless the key was replaced,
    removed or evicted in between. What was hydrated isn't written back, and evictions delete nothing.
    """

    def __init__(self, backend: StorageBackend, on_error: Callable[[Exception], None] | None = None) -> None:
        self.backend, self.on_error, self.dirty, self.gone, self.enabled = backend, on_error, None, None, True

    def _log(self) -> DataFrame:
        return self.dirty if self.gone is None else self.gone.unionByName(self.dirty)

    def add(self, changes: DataFrame) -> None:
        """changes (seq, op, key, data, origin)."""
        hydrated = F.coalesce(F.col("origin") == "hydration", F.lit(False))
        own = changes.select("seq", "op", *KEY, "data", (F.col("op").isin("set", "replace", "remove") & ~hydrated).alias("writes"))
        self.dirty = own if self.dirty is None else self.dirty.unionByName(own)

    def pending(self) -> DataFrame | None:
        """key, op ('put' as the last write's name, or 'remove') and the image to put."""
        if self.dirty is None:
            return None
        log = self._log()
        last = log.where("writes").groupBy(*KEY).agg(F.max_by("op", "seq").alias("last_op"), F.max("seq").alias("last_seq"))
        first = log.groupBy(*KEY).agg(F.min("seq").alias("first_seq"), F.min_by("op", "seq").alias("first_op"))
        merging = first.where("first_op = 'set'").join(last.where("last_op != 'remove'"), KEY, "left_semi")
        base = self.backend.load_many(merging.select(*KEY)).join(merging, KEY).select((F.col("first_seq") - 1).alias("seq"), F.lit("replace").alias("op"), *KEY, "data")
        # what comes after a key's last write, an eviction say, is not part of its row
        told = log.select("seq", "op", *KEY, "data").unionByName(base).join(last, KEY).where("seq <= last_seq")
        images = _images(told.select("seq", "op", *KEY, "data"))
        return last.join(images, KEY, "left").select(*KEY, F.col("last_op").alias("op"), "data")

    def flush(self) -> bool:
        """Whether everything added before is durable."""
        last = self.pending()
        if last is None:
            return True
        try:
            last = last.cache()
            self.backend.write_batch(last.where("op != 'remove'").select(*KEY, "data"), last.where("op = 'remove'").select(*KEY))
        except Exception as error:
            self.enabled = False
            if self.on_error is not None:
                self.on_error(error)
            return False
        finally:
            last.unpersist()
        # a key that was evicted last has a durable row that later patches don't merge onto
        end = self._log().groupBy(*KEY).agg(F.max_by(F.struct("seq", "op"), "seq").alias("end")).where("end.op = 'evict'")
        gone = end.select("end.seq", "end.op", *KEY, F.lit(None).cast("string").alias("data"), F.lit(False).alias("writes"))
        self.gone, self.dirty, self.enabled = stored(gone, "evicted"), None, True
        return True

    def close(self, deadline: float | None = None) -> bool:
        """Flushes; False if that fails or, with a deadline, isn't done in time."""
        if deadline is None:
            return self.flush()
        try:
            return within(deadline, self.flush)
        except TimeoutError:
            return False

    def __enter__(self) -> WriteBehind:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
