"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

An item is found in a document if at least ``threshold`` of the item's distinct five-word shingles occur in the
document, wherever they stand. Items are partitioned by size (powers of two of their shingle counts). An item of k
shingles gets the sketch of its m smallest shingle hashes, m = k - ceil(threshold * k) + 1: a document without any of
these misses more than the threshold allows, so the candidates are complete for documents of any length. (Banded
signatures would have to find a Jaccard similarity of about 0.002 for an item inside a document of 20,000 words, and
would lose items.) A partition also bounds the hashes worth probing: those up to the largest in its sketches.
Candidates are verified by their exact shingles, as words.

The benchmark is the small side and is read in blocks of bounded size; each block is broadcast and all documents are
scanned once for it, so that no document moves and a larger benchmark means more blocks, not larger broadcasts.

Words are runs of letters and digits, lower-cased. Defined cases: an item with fewer than five words is one shingle of
all its words; items and documents without words match nothing; null texts count as empty; repeated rows give rows
of their own; empty tables give empty results; further columns are ignored (``without_leaks`` keeps them).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

WORDS = re.compile(r"[^\W_]+").findall
WIDTH, THRESHOLD = 5, 0.8
#: Words of benchmark text in a block, which bounds a broadcast to some 100 MB.
BLOCK_WORDS = 1_000_000
#: Words of document text that a task handles at once.
CHUNK_WORDS = 500_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
FOUND = "doc_id bigint, item_id bigint, n_shingles bigint, n_shared bigint, containment double"


def mixed(values: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values."""
    values = (values ^ (values >> np.uint64(31))) * FACTOR
    return values ^ (values >> np.uint64(29))


class ContainmentIndex:
    """Sketches and shingles of a block of items."""

    def __init__(self, items: list[tuple[int, str]], width: int = WIDTH, threshold: float = THRESHOLD) -> None:
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, int, frozenset[str], int]] = []
        sketches: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for item_id, text in items:
            words = WORDS((text or "").lower())
            if not words:
                continue
            for word in words:
                self.vocabulary.setdefault(word, len(self.vocabulary) + 1)
            span = min(width, len(words))
            shingles = {" ".join(words[i : i + span]) for i in range(len(words) - span + 1)}
            ids = np.array([[self.vocabulary[w] for w in s.split(" ")] for s in shingles], np.uint64)
            hashes = np.sort(np.unique(self.hash_rows(ids)))
            needed = math.ceil(threshold * len(shingles) - 1e-9)
            number = len(self.items)
            self.items.append((item_id, span, frozenset(shingles), needed))
            size = sketches.setdefault(span, {}).setdefault(len(shingles).bit_length(), [])
            size += [(int(h), number) for h in hashes[: len(shingles) - needed + 1]]
        #: span -> for each size partition: sorted hashes, their items
        self.partitions = {
            span: [tuple(np.array(x, kind) for x, kind in zip(zip(*sorted(pairs), strict=True), (np.uint64, np.int64), strict=True)) for pairs in sizes.values()]
            for span, sizes in sketches.items()
        }

    @staticmethod
    def hash_rows(ids: np.ndarray) -> np.ndarray:
        found = np.zeros(ids.shape[0], np.uint64)
        for column in range(ids.shape[1]):
            found = mixed(found + ids[:, column] + np.uint64(column + 1))
        return found

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(row, item_id, shingles of the item, of these in the text) of the items that the texts contain."""
        rows: list[list[str]] = []
        first, held = 0, 0
        for at, text in enumerate(texts):
            rows.append(WORDS(text.lower()) if text else [])
            held += len(rows[-1])
            if held >= CHUNK_WORDS or at + 1 == len(texts):
                for row, *rest in self._search(rows):
                    yield (first + row, *rest)
                first, held, rows = at + 1, 0, []

    def _search(self, rows: list[list[str]]) -> Iterator[tuple[int, int, int, int]]:
        ends = np.cumsum([len(x) for x in rows])
        if not len(ends) or not ends[-1]:
            return
        get = self.vocabulary.get
        ids = np.fromiter((x for words in rows for x in map(get, words, repeat(0))), np.uint64, ends[-1])
        owner = np.repeat(np.arange(len(rows)), np.diff(ends, prepend=0))
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        candidates: set[tuple[int, int]] = set()
        starts: dict[int, np.ndarray] = {}
        for span, sizes in self.partitions.items():
            n = len(ids) - span + 1
            if n <= 0:
                continue
            at = np.flatnonzero((known[span:] - known[:n] == span) & (owner[:n] == owner[span - 1 :]))
            starts[span] = at
            hashes = self.hash_rows(ids[at[:, None] + np.arange(span)])
            for sketch, items in sizes:
                probed = np.flatnonzero(hashes <= sketch[-1])
                low, high = (np.searchsorted(sketch, hashes[probed], side) for side in ("left", "right"))
                for p, a, b in zip(probed[high > low], low[high > low], high[high > low], strict=True):
                    candidates.update((int(owner[at[p]]), int(x)) for x in items[a:b])
        offsets = ends - np.array([len(x) for x in rows])
        held: dict[tuple[int, int], set[str]] = {}
        for row, number in sorted(candidates):
            item_id, span, shingles, needed = self.items[number]
            if (row, span) not in held:
                held = {k: v for k, v in held.items() if k[0] == row}
                at, words = starts[span], rows[row]
                own = at[np.searchsorted(at, offsets[row]) : np.searchsorted(at, ends[row])] - offsets[row]
                held[row, span] = {" ".join(words[i : i + span]) for i in own.tolist()}
            if (shared := len(shingles & held[row, span])) >= needed:
                yield row, item_id, len(shingles), shared


def blocks(items: DataFrame, most: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about ``most`` words; the driver holds one at a time."""
    block, words = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        block.append((row[0], row[1]))
        words += len(row[1] or "") // 4
        if words >= most:
            yield block
            block, words = [], 0
    if block:
        yield block


def containments(docs: DataFrame, items: DataFrame, *, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_shared, containment of all pairs at the threshold or above."""
    spark, found = docs.sparkSession, None
    for block in blocks(items, block_words):
        index = spark.sparkContext.broadcast(ContainmentIndex(block, threshold=threshold))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[i], item, k, n, n / k) for i, item, k, n in index.value.search(batch.column("text").to_pylist())]
                columns = zip(*rows, strict=True) if rows else [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=FOUND.replace(",", "").split()[::2])

        part = docs.select("doc_id", "text").mapInArrow(run, FOUND)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], FOUND) if found is None else found


def without_leaks(docs: DataFrame, items: DataFrame, *, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns."""
    for block in blocks(items, block_words):
        index = docs.sparkSession.sparkContext.broadcast(ContainmentIndex(block, threshold=threshold))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaks = {row for row, *_ in index.value.search(batch.column("text").to_pylist())}
                yield batch.filter(pa.array([i not in leaks for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containments(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, w, least(5, len(w)) AS span FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM benchmark) WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, span, array_to_string(w[i : i + span - 1], ' ') AS s FROM (SELECT item_id, w, span, unnest(range(1, len(w) - span + 2)) AS i FROM b)),
ds AS (SELECT DISTINCT doc_id, span, array_to_string(w[i : i + span - 1], ' ') AS s
       FROM (SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS i FROM d, (SELECT DISTINCT span FROM b))),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles AS containment
FROM bs JOIN ds USING (span, s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles
"""
