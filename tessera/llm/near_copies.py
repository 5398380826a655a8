"""Near copies: texts whose five-word shingles have a Jaccard similarity of 0.8 or more, linked to components.

Texts with equal sets of shingles are one point.

1. SimHash: points whose fingerprints the forest of vantage-point trees links are compared by whole sets. This finds
   most links; later steps look only at points that it leaves in different components.
2. What it can't see, a prefix filter finds: shingles have one order for all texts; of two sets of n and k shingles at
   the threshold, the n - ceil(0.8 n) + 1 first of the one and as many of the other share one, so texts that share none
   of those are no candidates and none is lost. The order puts shingles that are common in a bounded sample last, the
   rest by hash; the sample only decides how many candidates there are. A pair that shares s of those first shingles
   has at most s + r in common, r being the larger number of later ones, which rules most candidates out. What is left
   is compared by whole sets.
3. A shingle that more than ``HOT`` points of several components have first makes no pairs. Its points are dealt to
   cells of bounded size and compared there by 512-bit SimHash fingerprints; a cell returns a minimum spanning forest
   over components of what lies within ``FAR`` bits, at most one edge a point, which is then compared by whole sets.
   For sets at the threshold FAR is over four standard deviations above the distance to be expected, so that this step
   may miss a link that no other path makes up for, once in about 100,000.

Sets are of 64-bit hashes (``shingles``); texts without words are copies of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import FILE, ROW, passing, stored
from tessera.llm.components import components, nearest_forest
from tessera.llm.shingles import distinct, hashed, majorities

WIDTH, SEED = 5, 42
#: Texts that a task holds as words at once, about.
ROWS = 1_000
SAMPLE, COMMON, MOST_COMMON = 20_000, 4, 500_000
#: Points that a shingle pairs, and those of a larger group in a cell.
HOT, SALT = 50, 1_000
#: 64-bit words of a wide fingerprint; bits in which sets at the threshold may differ, and sets of under FEW shingles.
SIGN_WORDS, FAR, FAR_FEW, FEW = 8, 115, 160, 64


def signature(hashes: np.ndarray) -> np.ndarray:
    """The wide fingerprint."""
    words, bounds = [], np.array([0, len(hashes)])
    for i in range(SIGN_WORDS):
        mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1) ** 3) % 2**64)
        words.append(majorities(mixed ^ (mixed >> np.uint64(32)), bounds))
    return np.concatenate(words)


def shingle_sets(texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some texts at a time: the hashes of each one's distinct shingles, ascending, and their bounds."""
    for _, hashes, bounds in hashed(texts, WIDTH, SEED):
        yield distinct(hashes, bounds)


def first(found: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of which a set at the threshold has to share one."""
    n = len(found) - (4 * len(found) + 4) // 5 + 1 if len(found) else 0
    at = np.searchsorted(common, found)
    held = np.zeros(len(found), np.int64)
    inside = at < len(common)
    inside[inside] = common[at[inside]] == found[inside]
    held[inside] = rank[at[inside]]
    return found[np.argsort(held, kind="stable")[:n]]


def _sets(rows: DataFrame, *kept: str) -> DataFrame:
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*kept).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part, at = batch.slice(i, ROWS), 0
                for found, bounds in shingle_sets(part.column("text").to_pylist()):
                    n = len(bounds) - 1
                    held = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([*(part.column(k).slice(at, n) for k in kept), held], names=[*kept, "held"])
                    at += n

    return rows.select(*kept, "text").mapInArrow(run, f"{kinds}, held array<bigint>")


def common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles that are common in a sample, ascending; how common they are)."""
    every = max(1, rows.count() // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64(FILE, ROW), F.lit(every)) == 0)
    counts = _sets(sample, ROW).select(F.explode("held").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    found = counts.orderBy(F.desc("n"), "token").limit(MOST_COMMON).toPandas()
    tokens, n = found.token.to_numpy(np.int64).view(np.uint64), found.n.to_numpy(np.int64)
    order = np.argsort(tokens)
    return tokens[order], n[order]


def marked(rows: DataFrame) -> DataFrame:
    """rows (doc_id, tessera_file, tessera_row, text) -> with point, n (its shingles), fp and firsts instead of the text."""
    common = rows.sparkSession.sparkContext.broadcast(common_shingles(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, sizes, prints, firsts = [], [], [], []
            for i in range(0, len(batch), ROWS):
                for found, bounds in shingle_sets(batch.column("text").slice(i, ROWS).to_pylist()):
                    prints.append(majorities(found, bounds))
                    sizes.append(np.diff(bounds))
                    for own in np.split(found, bounds[1:-1]):
                        points.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                        firsts.append(first(own, *common.value).view(np.int64))
            numbers = [np.array(points, np.uint64), *(np.concatenate([np.zeros(0, np.uint64), *x]).astype(np.uint64) for x in (sizes, prints))]
            numbers = [pa.array(x.view(np.int64)) for x in numbers]
            columns = [batch.column("doc_id"), batch.column(FILE), batch.column(ROW), *numbers, pa.array(firsts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", FILE, ROW, "point", "n", "fp", "firsts"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select("doc_id", FILE, ROW).schema)
    return rows.select("doc_id", FILE, ROW, "text").mapInArrow(run, f"{kinds}, point bigint, n bigint, fp bigint, firsts array<bigint>")


def _alike(shared: Column) -> Column:
    """Whether two sets of na and nb shingles with so many in common are at the threshold."""
    return shared * 9 >= (F.col("na") + F.col("nb")) * 4


#: Conditions on sets of na and nb shingles: sizes within the threshold, and the larger number of later ones.
SIZES = "least(na, nb) * 5 >= greatest(na, nb) * 4"
LATER = "greatest((4 * na + 4) div 5 - 1, (4 * nb + 4) div 5 - 1)"


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs (x, nx, y, ny) of points as (a, b, na, nb) with a < b, once each, without those whose sizes are too unlike."""
    turned = F.col("x") > F.col("y")
    pick = lambda one, other, name: F.when(turned, F.col(one)).otherwise(F.col(other)).alias(name)
    own = pairs.where("x != y").select(pick("y", "x", "a"), pick("x", "y", "b"), pick("ny", "nx", "na"), pick("nx", "ny", "nb"))
    return own.where(SIZES).distinct()


def _verified(pairs: DataFrame, rows: DataFrame, points: DataFrame) -> DataFrame:
    """Of pairs (a, b, na, nb) those at the threshold, by whole sets."""
    pairs = stored(pairs.select("a", "b", "na", "nb"), "candidates")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("point")).distinct()
    places = points.join(asked, "point", "left_semi").select("point", F.col("least")[FILE].alias(FILE), F.col("least")[ROW].alias(ROW))
    sets = stored(_sets(rows.select("text", FILE, ROW).join(places, [FILE, ROW]), "point"), "sets")
    both = pairs.join(sets.select(F.col("point").alias("a"), F.col("held").alias("x")), "a").join(sets.select(F.col("point").alias("b"), F.col("held").alias("y")), "b")
    return stored(both.where(_alike(F.size(F.array_intersect("x", "y")))).select("a", "b"), "alike")


def by_fingerprint(points: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a, b, na, nb): those of equal fingerprints with one that stands for them, and of these what ``near`` links."""
    stand = stored(points.groupBy("fp").agg(F.min(F.struct("point", "n")).alias("s")).select("fp", "s.point", "s.n"), "prints")
    same = points.select("fp", F.col("point").alias("x"), F.col("n").alias("nx")).join(stand.select("fp", F.col("point").alias("y"), F.col("n").alias("ny")), "fp")
    ends = [stand.select(F.col("fp").alias(f), F.col("point").alias(p), F.col("n").alias(f"n{p}")) for f, p in (("a", "x"), ("b", "y"))]
    far = near(stand.select("fp")).join(ends[0], "a").join(ends[1], "b")
    return _ordered(same.select("x", "nx", "y", "ny").unionByName(far.select("x", "nx", "y", "ny")))


def _hot(hot: DataFrame, rows: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb) among the points of each hot shingle, hot being (token, point, n, root, c points)."""
    # shingles of one passage are first in the same points: one of them stands for all
    sets = hot.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.expr("bit_xor(xxhash64(point))").alias("x"), F.expr("bit_xor(point)").alias("y"))
    hot = hot.join(sets.groupBy("c", "x", "y").agg(F.min("token").alias("token")).select("token"), "token", "left_semi")
    places = points.join(hot.select("point").distinct(), "point", "left_semi").select("point", F.col("least")[FILE].alias(FILE), F.col("least")[ROW].alias(ROW))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for i in range(0, len(batch), ROWS):
                for found, bounds in shingle_sets(batch.column("text").slice(i, ROWS).to_pylist()):
                    told += [signature(own).tobytes() for own in np.split(found, bounds[1:-1])]
            yield pa.RecordBatch.from_arrays([batch.column("point"), pa.array(told, pa.binary())], names=["point", "sign"])

    signs = rows.select("text", FILE, ROW).join(places, [FILE, ROW]).select("point", "text").mapInArrow(sign, "point bigint, sign binary")
    signs = stored(signs, "signs")

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.drop_duplicates("point")
        signs = np.frombuffer(b"".join(cell.sign), np.uint64).reshape(-1, SIGN_WORDS)
        n, part, root = (cell[c].to_numpy() for c in ("n", "p", "root"))
        low, high = np.flatnonzero(part == cell.lo.iloc[0]), np.flatnonzero(part == cell.hi.iloc[0])
        found = [np.zeros((3, 0), np.int64)]
        for i in range(0, len(low), 200):
            own = low[i : i + 200]
            apart = np.zeros((len(own), len(high)), np.int64)
            for w in range(SIGN_WORDS):
                apart += np.bitwise_count(signs[own, w][:, None] ^ signs[high, w][None, :])
            less, more = np.minimum(n[own][:, None], n[high][None, :]), np.maximum(n[own][:, None], n[high][None, :])
            x, y = np.nonzero((apart <= np.where(less < FEW, FAR_FEW, FAR)) & (less * 5 >= more * 4) & (root[own][:, None] != root[high][None, :]))
            found.append(np.stack([own[x], high[y], apart[x, y]]))
        a, b, d = np.concatenate(found, axis=1)
        kept = nearest_forest(a, b, d, np.unique(root, return_inverse=True)[1])
        point = cell.point.to_numpy()
        return pd.DataFrame({"x": point[a[kept]], "nx": n[a[kept]], "y": point[b[kept]], "ny": n[b[kept]]})

    parts = F.ceil(F.col("c") / SALT).cast("int")
    sent = hot.withColumn("p", F.pmod(F.xxhash64("point"), parts).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), parts - 1)))
    sent = sent.select("token", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), "p", "point", "n", "root").join(signs, "point")
    return _ordered(sent.groupBy("token", "lo", "hi").applyInPandas(compare, "x bigint, nx bigint, y bigint, ny bigint"))


def links(rows: DataFrame, found: DataFrame, points: DataFrame) -> DataFrame:
    """(a, b): edges that connect what pairs at the threshold connect beyond the points' components.

    ``found`` are rows as ``marked`` gives them, ``points`` (point, least, root) a row with the place of each point's
    text and its component.
    """
    tokens = found.select("point", "n", F.explode("firsts").alias("token"))
    shared = tokens.groupBy("token").agg(F.min("point").alias("lo"), F.max("point").alias("hi")).where("lo < hi").select("token")
    kept = tokens.join(stored(shared, "shared"), "token", "left_semi").distinct()
    kept = stored(kept.join(points.select("point", "root"), "point"), "shared-tokens")
    open_ = kept.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo < hi")
    kept = stored(kept.join(stored(open_.select("token", "c"), "open"), "token"), "open-tokens")
    hot = kept.where(F.col("c") > HOT)
    held = hot.groupBy("point").agg(F.count(F.lit(1)).alias("h"))
    cold = kept.where(F.col("c") <= HOT).join(held, "point", "left").select("token", "point", "n", "root", F.coalesce("h", F.lit(0)).alias("h"))
    cold = stored(cold, "cold-tokens")

    left, right = (cold.select("token", F.col("point").alias(x), *(F.col(c).alias(f"{c}{x}") for c in ("n", "h", "root"))) for x in "ab")
    pairs = left.join(right, "token").where("a < b AND roota != rootb").where(SIZES).groupBy("a", "b", "na", "nb", "ha", "hb").agg(F.count(F.lit(1)).alias("s"))
    pairs = pairs.where(_alike(F.col("s") + F.least("ha", "hb") + F.expr(LATER))).select("a", "b", "na", "nb")
    if not hot.isEmpty():
        pairs = pairs.unionByName(_hot(hot, rows, points)).distinct()
    return _verified(pairs, rows, points)


def _rooted(points: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """``points`` with the component that the edges between their roots put them in."""
    roots = components(edges).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return stored(points.join(roots, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top"), name)


def without_near_copies(rows: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(tessera_file, tessera_row) of the rows that go: all but the least of each component, by doc_id (null last) and place.

    ``near`` gives edges (a, b) between fingerprints (fp) that differ in few bits.
    """
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", FILE, ROW)  # names one row, whatever doc_ids repeat
    with passing(rows.sparkSession):
        found = stored(marked(rows), "marked")
        points = found.groupBy("point").agg(F.min(own).alias("least"), F.min("n").alias("n"), F.min("fp").alias("fp")).withColumn("root", F.col("point"))
        points = stored(points, "points")
        points = _rooted(points, _verified(by_fingerprint(points, near), rows, points), "near-points")
        root = points.select("point", "root")
        more = links(rows, found, points)
        more = more.join(root.toDF("a", "x"), "a").join(root.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        points = _rooted(points, more, "all-points")
        named = stored(points.join(points.groupBy("root").agg(F.min("least").alias("stays")), "root").select("point", "stays"), "named")
        gone = found.join(named, "point").where(own != F.col("stays")).select(FILE, ROW)
        return stored(gone, "gone", keep=True)
