"""Shared column idioms of the training-data operators, and the scratch folder."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import checkpoint_root, commit_file, hadoop_path, passing, scratch, stored

__all__ = ["FILE", "ROW", "WORD", "placed_rows", "checkpoint_root", "commit_file", "hadoop_path", "passing", "scratch", "stored", "whole"]

#: Words as most contracts define them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Where a row lies: names no input may have.
FILE, ROW = "tessera_file", "tessera_row"


def placed_rows(docs: DataFrame) -> DataFrame | None:
    """``docs`` with the file and the row in it that each row is read from; None if ``docs`` is no plain scan."""
    try:
        return docs.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
    except AnalysisException:
        return None


def whole(text: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))
