"""SimHash near-dedup: fingerprints, and exact links between them through a forest of vantage-point trees.

A fingerprint has a bit set where over half of a text's shingle hashes have it. Two link at ``radius`` or fewer
differing bits. Distances between unrelated 64-bit fingerprints lie within a few bits of 32, so a single tree that is
searched with radius 4 sends two of three fingerprints both ways at each node. The bits are therefore cut in three
blocks: linked fingerprints differ by at most 1 bit in one of them. Each block has a vantage-point tree over the
Hamming distance of that block, a metric too: a node holds a vantage point and a median distance t; a fingerprint at
distance d lives inside if d <= t and outside otherwise, and by the triangle bound it has to visit the inside only if
d <= t + 1 and the outside only if d > t - 1. Leaves are the shards. A fingerprint is sent to its home and to the
later shards that its ball overlaps, where whole fingerprints are compared; so all pairs are found, exactly.

Vantage points come from a bounded sample of fingerprints, which only decides how even the shards are; nodes that
too few of it reach take a point at random and half the block's bits. Trees deepen with the fingerprints, a level for
each doubling, down to where leaves would hold single values of a block. Equal fingerprints are one point. Shards are
cut into cells of bounded size, and a cell returns a minimum spanning forest of its links (at most one a point), not
its pairs. Links are joined to components by star rounds.

``near_dedup`` takes fingerprints of five-word shingles, compares the texts they link by whole shingle sets, and
completes the links exactly (``near_copies``).

Defined cases: null text counts as empty; a text without words has fingerprint zero and links like any other; a null
doc_id takes part but never names a component unless all are null; repeated rows stay rows; an empty table gives an
empty result; further columns are kept by ``near_dedup`` and ignored by ``near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import FILE, ROW, placed_rows, stored
from tessera.llm.components import components, nearest_forest
from tessera.llm.near_copies import without_near_copies
from tessera.llm.shingles import hashed, majorities

WIDTH, SEED, RADIUS = 4, 42, 4
BLOCKS = ((0, 22), (22, 21), (43, 21))
SAMPLE, LEAF, DEPTH = 20_000, 512, 20
#: Sampled points below which a node doesn't take its median from them.
ENOUGH = 8
#: Points whose visits a task holds at once.
VISIT_POINTS = 4_096
#: Texts that a task holds as words at once, about.
ROWS = 1_000
#: Points at home and visitors in a cell.
HOME_CELL, VISITOR_CELL = 4_096, 65_536
#: Pairs that a task compares at once.
PAIRS = 1_000_000


def prints(texts: Sequence[str | None], width: int = WIDTH) -> np.ndarray:
    """The texts' fingerprints, unsigned."""
    found = [majorities(hashes, bounds) for _, hashes, bounds in hashed(texts, width, SEED)]
    return np.concatenate([np.zeros(0, np.uint64), *found])


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Unsigned; words are separated by ASCII white space, and only A-Z are lower-cased."""
    return int(prints([text], width)[0])


def fingerprints(docs: DataFrame, *kept: str) -> DataFrame:
    """``kept`` columns and fp (long, the fingerprint's bits)."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*kept).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.slice(i, ROWS)
                found = prints(part.column("text").to_pylist()).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), pa.array(found, pa.int64())], names=[*kept, "fp"])

    return docs.select(*kept, "text").mapInArrow(run, f"{kinds}, fp bigint")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class VantageTree:
    """A complete tree over the bits of ``mask``; node i has children 2i + 1 (inside) and 2i + 2 (outside)."""

    def __init__(self, sample: np.ndarray, mask: int, depth: int, reach: int, seed: int) -> None:
        self.depth, self.reach, nodes = depth, reach, 2**depth - 1
        self.mask = np.uint64(mask)
        chooser = np.random.default_rng(seed)
        self.vantage = chooser.integers(0, 2**64, nodes, np.uint64) & self.mask
        self.median = np.full(nodes, mask.bit_count() // 2, np.int8)
        points = sample & self.mask
        node = np.zeros(len(points), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            held = np.bincount(node - first, minlength=count)
            starts, full = np.cumsum(held) - held, np.flatnonzero(held >= ENOUGH)
            chosen = np.argsort(node, kind="stable")[starts[full] + chooser.integers(0, held[full])]
            self.vantage[first + full] = points[chosen]
            d = distance(points, self.vantage[node]).astype(np.int64)
            in_order = d[np.lexsort((d, node))]
            self.median[first + full] = in_order[starts[full] + (held[full] - 1) // 2]
            node = 2 * node + 1 + (d > self.median[node])

    def visits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, whether it is the row's home) for all leaves that a row's ball overlaps."""
        masked = points & self.mask
        row, node, home = np.arange(len(points)), np.zeros(len(points), np.int64), np.ones(len(points), bool)
        for _ in range(self.depth):
            d = distance(masked[row], self.vantage[node]).astype(np.int64)
            t = self.median[node].astype(np.int64)
            inside, outside = d <= t + self.reach, d > t - self.reach
            row, home, node = (
                np.concatenate([row[inside], row[outside]]),
                np.concatenate([home[inside] & (d <= t)[inside], home[outside] & (d > t)[outside]]),
                np.concatenate([2 * node[inside] + 1, 2 * node[outside] + 2]),
            )
        return row, node - (2**self.depth - 1), home


class Forest:
    """A tree for each block of bits; shards are numbered through."""

    def __init__(self, sample: np.ndarray, depth: int, radius: int = RADIUS) -> None:
        self.leaves = 2**depth
        self.trees = [VantageTree(sample, ((1 << n) - 1) << first, depth, radius // len(BLOCKS), i) for i, (first, n) in enumerate(BLOCKS)]

    def visits(self, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, shard, home) by tree, without visits to shards before the home: the other point makes those."""
        for first in range(0, len(points), VISIT_POINTS):
            part = points[first : first + VISIT_POINTS]
            for i, tree in enumerate(self.trees):
                row, leaf, home = tree.visits(part)
                own = np.zeros(len(part), np.int64)
                own[row[home]] = leaf[home]
                later = leaf >= own[row]
                yield row[later] + first, leaf[later] + i * self.leaves, home[later]


def linked(home: np.ndarray, visitors: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A minimum spanning forest (a, b) of the links between the two sets."""
    points = np.unique(np.concatenate([home, visitors]))
    home = np.unique(home)
    of_home, step, every = np.searchsorted(points, home), max(1, PAIRS // max(1, len(home))), np.arange(len(points))
    found = [np.zeros((3, 0), np.int64)]
    for i in range(0, len(visitors), step):
        part = visitors[i : i + step]
        apart = distance(part[:, None], home[None, :])
        v, h = np.nonzero(apart <= radius)
        a, b, d = np.searchsorted(points, part)[v], of_home[h], apart[v, h].astype(np.int64)
        found.append(np.stack([a, b, d])[:, nearest_forest(a, b, d, every)])
    a, b, d = np.concatenate(found, axis=1)
    kept = nearest_forest(a, b, d, every)
    return points[a[kept]], points[b[kept]]


def links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """points (fp, distinct) -> edges (a, b) that connect exactly the fingerprints that links connect."""
    spark = points.sparkSession
    n = points.count()
    depth = min(DEPTH, max(1, (n // LEAF).bit_length()))
    sample = points.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas().fp.to_numpy(np.int64).view(np.uint64)
    forest = spark.sparkContext.broadcast(Forest(sample, depth, radius))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_home, visiting = (np.zeros(len(BLOCKS) * forest.value.leaves, np.int64) for _ in range(2))
        for batch in batches:
            for _, shard, home in forest.value.visits(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)):
                at_home += np.bincount(shard[home], minlength=len(at_home))
                visiting += np.bincount(shard, minlength=len(at_home))
        shards = np.flatnonzero(visiting)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (shards, at_home[shards], visiting[shards])], names=["shard", "n_home", "n_visits"])

    # a row for each shard, at most 3 * 2**DEPTH of them, and LEAF times as many points
    sizes = points.mapInArrow(count, "shard bigint, n_home bigint, n_visits bigint").groupBy("shard").agg(F.sum("n_home").alias("n_home"), F.sum("n_visits").alias("n_visits")).toPandas()
    cuts = np.ones((len(BLOCKS) * 2**depth, 2), np.int64)
    cuts[sizes.shard] = np.maximum(1, -(-sizes[["n_home", "n_visits"]].to_numpy() // np.array([HOME_CELL, VISITOR_CELL])))
    first = np.concatenate([[0], np.cumsum(cuts.prod(axis=1))])
    plan = spark.sparkContext.broadcast((cuts, first))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, start = plan.value
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            mixed = (fps ^ (fps >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(20)
            for row, shard, home in forest.value.visits(fps):
                for own, side in ((np.ones(len(row), bool), 1), (home, 0)):
                    r, s = row[own], shard[own]
                    part = (mixed[r] % cut[s, side].astype(np.uint64)).astype(np.int64)
                    times = cut[s, 1 - side]
                    other = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    r, s, part = (np.repeat(x, times) for x in (r, s, part))
                    h, v = (other, part) if side else (part, other)
                    columns = [pa.array(start[s] + h * cut[s, 1] + v, pa.int64()), pa.array(fps[r].view(np.int64), pa.int64()), pa.array(np.full(len(r), side == 0), pa.bool_())]
                    yield pa.RecordBatch.from_arrays(columns, names=["cell", "fp", "home"])

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        fps = cell.fp.to_numpy(np.int64).view(np.uint64)
        a, b = linked(fps[cell.home.to_numpy(bool)], fps[~cell.home.to_numpy(bool)], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return points.mapInArrow(send, "cell bigint, fp bigint, home boolean").groupBy("cell").applyInPandas(compare, "a bigint, b bigint")


def placed(rows: DataFrame) -> DataFrame:
    """rows (doc_id, fp, ...) -> with component_id."""
    points = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    roots = components(links(points.select("fp"))).select(F.col("node").alias("fp"), "root")
    rooted = points.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(stored(named, "named"), "fp")  # a table, so that the rows of a hot fingerprint can be split


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    rows = stored(fingerprints(docs, "doc_id"), "fingerprints")
    return placed(rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of near copies: that of the smallest doc_id (null last), the first in the input.

    Near copies are texts whose five-word shingles have a Jaccard similarity of 0.8 or more (``near_copies``).
    """
    rows = placed_rows(docs)
    if rows is None:  # a table of its own gives rows a place that doesn't change
        rows = placed_rows(stored(docs, "rows", compression="zstd"))
    gone = without_near_copies(rows.select("doc_id", FILE, ROW, "text"), links)
    return rows.join(gone, [FILE, ROW], "left_anti").drop(FILE, ROW)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
