"""The shared folder for intermediate tables, which cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session. Only where driver and executors are one machine is a temporary one set instead."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get() if current.isDefined() else None
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(root)
        root = "file://" + root
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{checkpoint_root(spark)}/tessera-{name}-{uuid.uuid4().hex}"


_passing = threading.local()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside are deleted at the end, but for those to ``keep``."""
    outer, own = getattr(_passing, "paths", None), []
    _passing.paths = own
    try:
        yield
    finally:
        _passing.paths = outer
        for path in own:
            fs, folder = hadoop_path(spark, path)
            fs.delete(folder, True)


def stored(df: DataFrame, name: str, path: str | None = None, keep: bool = False, **options: str) -> DataFrame:
    """Writes ``df`` below the shared folder and reads it again."""
    path = path or scratch(df.sparkSession, name)
    if not keep and getattr(_passing, "paths", None) is not None:
        _passing.paths.append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) through which the driver can list, create and rename in any store Spark knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's content, read by the driver."""
    fs, p = hadoop_path(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def commit_file(spark: SparkSession, path: str, text: str) -> None:
    """Makes a file with all its content appear at once, once: FileExistsError if there is one.

    The content is written aside and renamed without overwriting, which a file system with atomic renames lets only
    one writer do.
    """
    jvm = spark.sparkContext._jvm
    fs, final = hadoop_path(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(final.getParent(), f".pending-{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(final).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(final), options)
    except Exception as error:
        fs.delete(aside, False)
        if "FileAlreadyExists" in str(getattr(error, "java_exception", error)):
            raise FileExistsError(path) from error
        raise
