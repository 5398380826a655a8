"""Substring dedup by recompression: repeated word windows of a fixed width, found and removed exactly.

Recompression rewrites a text in rounds: first runs of one word, then, round after round, pairs of neighbouring
symbols whose hashed sides are left and right are named by one new symbol. Names are hashes of what they stand for, so
every task gives the same name to the same run or pair without asking. Whether two symbols join depends on these two
alone, so equal substrings get equal symbols but near their ends. With each symbol goes the stretch of words that
decided it: a symbol whose stretch lies inside a window appears in every text that holds the window.

1. One scan rewrites every text and keeps its symbols. Spark counts which occur in different word sequences.
2. A window is ruled out if a symbol decided inside it occurs in one sequence only. What is left (true repeats, nearly)
   is named by a 128-bit digest of its words, and Spark finds the smallest document of each name.
3. Words under a window that also starts in a smaller document are removed.

Long symbols (five words or more) are used; shorter ones only inside windows that hold no long one, and windows that
hold no symbol at all are never ruled out. Equal word sequences are one sequence: copies of it with a larger doc_id
lose every word, if they are as long as a window, and don't count as repeats of its symbols.

Rows are told apart by their place in the input, whatever doc_ids repeat or lack.

Defined cases: null text has no words; texts shorter than a window keep all words; rows that share a doc_id don't
remove each other's words; a null doc_id counts as the largest; empty tables give empty results; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import FILE, ROW, placed_rows, stored
from tessera.llm.shingles import xxh64

WINDOW, ROUNDS, SPAN, LONG = 50, 7, 16, 5
#: Words that a task rewrites at once.
CHUNK_WORDS = 150_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
FAR = 1 << 40


def mixed(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(31))) * FACTOR
    return v ^ (v >> np.uint64(29))


def split(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, in UTF-8."""
    return text.encode().split() if text else []


class Rewritten:
    """Symbols of concatenated texts after all rounds: value, words [start, end), deciding words [low, high)."""

    def __init__(self, words: np.ndarray, ends: np.ndarray, rounds: int = ROUNDS) -> None:
        n = len(words)
        if not n:
            self.value, none = words, np.zeros(0, np.int64)
            self.start = self.end = self.low = self.high = self.owner = none
            return
        lengths = np.diff(ends, prepend=0)
        owner = np.repeat(np.arange(len(ends)), lengths)
        joined = np.append(False, (words[1:] == words[:-1]) & (owner[1:] == owner[:-1]))
        run = np.cumsum(~joined) - 1
        size = np.diff(np.append(np.flatnonzero(~joined), n))[run]
        short = size <= SPAN
        kept = ~(joined & short)
        at = np.flatnonzero(kept)
        value = np.where(short & (size > 1), mixed(words + size.astype(np.uint64) * np.uint64(7)), words)[at]
        start, end, owner = at, np.where(short, at_end(size, short), np.arange(n) + 1)[at], owner[at]
        # the words beside a run decide where it ends; a run over SPAN looks shorter from within a window
        low, high = np.where(short[at], start - 1, -FAR), np.where(short[at], end + 1, FAR)
        for r in range(rounds):
            value, start, end, low, high, owner = self._pairs(value, start, end, low, high, owner, r)
        self.value, self.start, self.end, self.low, self.high, self.owner = value, start, end, low, high, owner

    @staticmethod
    def _pairs(value, start, end, low, high, owner, r):
        right = (mixed(value + np.uint64(1_000_003 * r + 12_345)) >> np.uint64(40)) & np.uint64(1) == 1
        beside = owner[1:] == owner[:-1]
        pair = np.append(beside & ~right[:-1] & right[1:] & (end[1:] - start[:-1] <= SPAN), False)
        second = np.append(False, pair[:-1])
        beside_next, beside_last = np.append(beside, False), np.append(False, beside)
        alone = ~pair & ~second
        new_low, new_high = low.copy(), high.copy()
        # a left symbol stays alone because of the next, a right one because of the last; a text's end may be another's middle
        for side, there, step in ((alone & ~right, beside_next, 1), (alone & right, beside_last, -1)):
            i = np.flatnonzero(side & there)
            new_low[i], new_high[i] = np.minimum(low[i], low[i + step]), np.maximum(high[i], high[i + step])
            new_high[np.flatnonzero(side & ~there)] = FAR
        i = np.flatnonzero(pair)
        new_low[i], new_high[i] = np.minimum(low[i], low[i + 1]), np.maximum(high[i], high[i + 1])
        value, end = value.copy(), end.copy()
        value[i] = mixed(value[i] * np.uint64(3) + mixed(value[i + 1]) + np.uint64(r))
        end[i] = end[i + 1]
        kept = ~second
        return value[kept], start[kept], end[kept], new_low[kept], new_high[kept], owner[kept]


def at_end(size: np.ndarray, short: np.ndarray) -> np.ndarray:
    return np.arange(len(size)) + np.where(short, size, 1)


class Windows:
    """Windows and deciding symbols of some texts."""

    def __init__(self, texts: list[list[bytes]], window: int = WINDOW) -> None:
        self.window = window
        lengths = np.array([len(x) for x in texts], np.int64)
        self.ends = np.cumsum(lengths)
        n = int(self.ends[-1]) if len(texts) else 0
        self.firsts = self.ends - lengths
        flat = list(chain.from_iterable(texts))
        sizes = np.fromiter(map(len, flat), np.int64, n)
        words = xxh64(b" ".join(flat), np.cumsum(sizes + 1) - 1 - sizes, sizes, 0)
        self.n, owner = n, np.repeat(np.arange(len(texts)), np.diff(self.ends, prepend=0))
        self.whole = np.arange(n) + window <= (self.ends[owner] if n else 0)
        found = Rewritten(words, self.ends)
        inside = (found.low >= self.firsts[found.owner]) & (found.high <= self.ends[found.owner]) & (found.high - found.low <= window)
        self.value, self.low, self.high, self.owner = (x[inside] for x in (found.value, found.low, found.high, found.owner))
        self.long = (found.end - found.start)[inside] >= LONG
        self.bare = self.whole & ~self.over(self.long)
        # short symbols that windows without a long one hold
        held = np.append(0, np.cumsum(self.bare))
        a, b = np.maximum(self.high - window, self.firsts[self.owner]), self.low + 1
        self.used = self.long | ((b > a) & (held[np.maximum(b, a)] > held[a]))

    def over(self, chosen: np.ndarray) -> np.ndarray:
        """Whether the window that starts at each word holds one of the chosen symbols."""
        steps = np.zeros(self.n + 2, np.int64)
        first = np.maximum(self.high[chosen] - self.window, self.firsts[self.owner[chosen]])
        last = self.low[chosen]
        good = last >= first
        np.add.at(steps, first[good], 1)
        np.add.at(steps, last[good] + 1, -1)
        return np.cumsum(steps)[: self.n] > 0

    def left(self, shared: np.ndarray) -> np.ndarray:
        """Starts of the windows that are not ruled out; shared: of each symbol."""
        return np.flatnonzero(self.whole & ~self.over(self.long & ~shared) & ~(self.bare & self.over(self.used & ~self.long & ~shared)))

    def unruled(self) -> np.ndarray:
        """Whether a text has windows that no symbol can rule out."""
        free = self.whole & ~self.over(self.used)
        held = np.append(0, np.cumsum(free))
        return held[self.ends] > held[self.firsts]


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The texts' words, some texts at a time, with the number of the first."""
    first, rows, held = 0, [], 0
    for at, text in enumerate(texts):
        rows.append(split(text))
        held += len(rows[-1])
        if held >= CHUNK_WORDS or at + 1 == len(texts):
            yield first, rows
            first, rows, held = at + 1, [], 0


TEXTS = "doc_id bigint, file bigint, row bigint, n_words bigint, sha string, sequence bigint, unruled boolean, symbols array<bigint>"
LEFT = "doc_id bigint, sha string, text string, starts array<int>, names array<binary>"
KEPT = "sha string, n_removed bigint, kept_sha256 string"


def _batch(columns, schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary())}
    names, types = zip(*(x.split(" ") for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, k in zip(columns, types, strict=True)], names=list(names))


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, file and row (where it lies, as numbers), text."""
    rows = placed_rows(docs)
    if rows is None:  # a table of its own gives rows a place that doesn't change
        rows = placed_rows(stored(docs.select("doc_id", "text"), "rows", compression="zstd"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(FILE).alias("file"), F.col(ROW).alias("row"), F.col("text").cast("string").alias("text"))


def rewrite(texts: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in chunks(batch.column("text").to_pylist()):
                shas = [hashlib.sha256(b" ".join(x)).digest() for x in part]
                found = Windows(part, window)
                used = np.flatnonzero(found.used)
                cuts = np.searchsorted(found.owner[used], np.arange(1, len(part)))
                symbols = [np.unique(x) for x in np.split(found.value[used].view(np.int64), cuts)]
                sequences = [int.from_bytes(x[:8], "little", signed=True) for x in shas]
                own = [batch.column(c).slice(first, len(part)) for c in ("doc_id", "file", "row")]
                yield _batch([*own, [len(x) for x in part], [x.hex() for x in shas], sequences, found.unruled().tolist(), symbols], TEXTS)

    return texts.select("doc_id", "file", "row", "text").mapInArrow(run, TEXTS)


def name_windows(texts: DataFrame, window: int) -> DataFrame:
    """texts (doc_id, text, sha, shared) -> those with windows left, and the windows' starts and names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, shas, ids, shares = (batch.column(c).to_pylist() for c in ("text", "sha", "doc_id", "shared"))
            for first, part in chunks(texts):
                # a place is a digest of the file's name: another row that met these symbols by it is left out
                own = [k for k, x in enumerate(part) if hashlib.sha256(b" ".join(x)).hexdigest() == shas[first + k]]
                at, part = [first + k for k in own], [part[k] for k in own]
                found = Windows(part, window)
                keys = [np.array(shares[i] or [], np.int64).view(np.uint64) + np.uint64(k * int(FACTOR) % 2**64) for k, i in enumerate(at)]
                shared = np.isin(found.value + found.owner.astype(np.uint64) * FACTOR, np.concatenate([np.zeros(0, np.uint64), *keys]))
                starts = found.left(shared)
                out = []
                cuts = np.searchsorted(starts, np.append(found.firsts, found.n))
                for k, i in enumerate(at):
                    own_starts = (starts[cuts[k] : cuts[k + 1]] - found.firsts[k]).tolist()
                    if own_starts:
                        joined = b" ".join(part[k])
                        ends = np.cumsum([len(w) + 1 for w in part[k]]) - 1
                        begins = np.append(0, ends[:-1] + 1)
                        names = [xxhash.xxh3_128_digest(joined[begins[s] : ends[s + window - 1]]) for s in own_starts]
                        out.append((ids[i], shas[i], texts[i], own_starts, names))
                if out:
                    yield _batch(zip(*out, strict=True), LEFT)

    return texts.select("doc_id", "sha", "text", "shared").mapInArrow(run, LEFT)


def remove(texts: DataFrame, window: int) -> DataFrame:
    """texts (sha, text, repeats: starts of repeated windows) -> what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for sha, text, starts in zip(*(batch.column(c).to_pylist() for c in ("sha", "text", "repeats")), strict=True):
                words = split(text)
                steps = np.zeros(len(words) + 1, np.int64)
                np.add.at(steps, starts, 1)
                np.add.at(steps, np.array(starts) + window, -1)
                gone = np.cumsum(steps)[:-1] > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                out.append((sha, int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            if out:
                yield _batch(zip(*out, strict=True), KEPT)

    return texts.select("sha", "text", "repeats").mapInArrow(run, KEPT)


def substring_dedup(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    texts = placed(docs)
    rows = stored(rewrite(texts, window), "texts")
    # of each sequence the row that stands for it: that of the smallest doc_id, null last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "file", "row")).alias("first")
    groups = rows.groupBy("sha").agg(first, F.first("sequence").alias("sequence"), F.first("n_words").alias("n_words"), F.first("unruled").alias("unruled"))
    groups = stored(groups.select("sha", "sequence", "n_words", "unruled", F.col("first.doc_id").alias("first_id"), "first.file", "first.row"), "groups")
    each = rows.where(F.size("symbols") > 0).select("sequence", F.explode("symbols").alias("symbol"))
    shared = each.groupBy("symbol").agg(F.min("sequence").alias("least"), F.max("sequence").alias("most")).where("least != most").select("symbol")
    # a table of its own, so that a hot symbol's rows can be split over tasks; likewise the names below
    shared = stored(shared, "shared")
    held = each.join(shared, "symbol", "left_semi").groupBy("sequence").agg(F.collect_set("symbol").alias("shared"))
    asked = groups.where(F.col("n_words") >= window).join(held, "sequence", "left").where("unruled OR shared IS NOT NULL").select("file", "row", "sha", "shared")
    left = stored(name_windows(texts.join(asked, ["file", "row"]), window), "windows", compression="zstd")

    spots = left.select("doc_id", "sha", F.explode(F.arrays_zip("starts", "names")).alias("at")).select("doc_id", "sha", F.col("at.starts").alias("start"), F.col("at.names").alias("name"))
    least = spots.groupBy("name").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("named"))
    least = stored(least.where("least IS NOT NULL AND (least < most OR named < n)").select("name", "least"), "names")
    repeats = spots.join(least, "name").where("doc_id IS NULL OR doc_id > least").groupBy("sha").agg(F.collect_set("start").alias("repeats"))
    kept = remove(left.select("sha", "text").join(repeats, "sha"), window).withColumnRenamed("sha", "kept_of").dropDuplicates(["kept_of"])

    empty = hashlib.sha256(b"").hexdigest()
    copy = (F.col("n_words") >= window) & F.col("first_id").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first_id")))
    done = rows.select("doc_id", "n_words", "sha", "row").join(groups.select("sha", "first_id"), "sha").withColumn("copy", F.coalesce(copy, F.lit(False)))
    # copies of a sequence don't need its removals and get a key that meets none, so the join's key is not hot
    key = F.when(F.col("copy"), F.concat(F.lit("-"), F.col("row").cast("string"))).otherwise(F.col("sha"))
    joined = done.withColumn("key", key).join(kept, F.col("key") == F.col("kept_of"), "left")
    return joined.select(
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS name FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
f AS (SELECT name, min(doc_id) AS first_id FROM s GROUP BY name),
r AS (SELECT s.doc_id, s.i FROM s JOIN f USING (name) WHERE s.doc_id > first_id),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
c AS (SELECT p.doc_id, p.i, word, max(CASE WHEN r.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
      FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.i = p.i),
k AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '')) AS kept_sha256 FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
