"""Toxicity by multiple-instance learning: a document is a bag of sentences and is toxic if one of them is.

A sentence's score is logistic in its words and word beginnings; a document's is the noisy-or of its sentences',
1 - prod(1 - p). Only documents carry labels, so the sentence model is trained through the noisy-or, and the same
model then locates the offending sentences.

Training: at most ``most_labelled`` labelled documents (those smallest in a hash of their identifier; all of them where
there are fewer), never held-out ones. Executors count in how many toxic and clean of these documents each feature
occurs. Those whose presence tells ``least_told`` nats or more by the likelihood-ratio statistic (5 nats: chance gives
one in 600) go into the model, all of them; only their occurrences travel to the driver, which fits the weights until
they stand still. So what the driver holds is bounded by the labelled documents. Scoring reads whole texts and nothing
else.

Defined cases: null text is empty, and a text without words scores 0; rows with null or repeated identifiers are
scored alike; documents without a label are only scored; a document with several labels counts as toxic if one is;
without both kinds of labels every text with words gets the share of toxic ones; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import passing, stored

#: Words, and the marks that end sentences.
TOKENS = re.compile(r"[^\W\d_]+|[.!?\n]").findall
SENTENCE_ENDS = ".!?\n"
ENDS = re.compile(r"[.!?\n]")
BEGINNINGS = (3, 4, 5, 6)
MOST_LABELLED, MEMO = 20_000, 300_000
THRESHOLD, SENTENCE_THRESHOLD = 0.3, 0.3
#: What a feature's presence must tell at least, in nats over the labelled documents.
LEAST_TOLD = 5.0
#: Steps of the fit at most, and the share of the loss that twenty of them must win for it to go on.
ROUNDS, STILL = 400, 1e-3
SCORED = "score double, n_sentences bigint, n_offending bigint, worst_start bigint, worst_score double"


def features(word: str) -> list[str]:
    """The word itself, and its beginnings marked as such."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def sentences(text: str) -> list[list[str]]:
    """The lower-cased words of each sentence with words."""
    found: list[list[str]] = [[]]
    for token in TOKENS(text.lower()):
        if token in SENTENCE_ENDS:
            if found[-1]:
                found.append([])
        else:
            found[-1].append(token)
    return found if found[-1] else found[:-1]


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


@dataclass
class SentenceModel:
    """Additive over words: z = bias + the sum of the weights of each distinct word's features."""

    bias: float = -30.0
    weights: dict[str, float] = field(default_factory=dict)
    #: Words met: their numbers, and by number what they add; number 0 ends sentences.
    numbers: dict[str, int] = field(default_factory=dict)
    added: np.ndarray = field(default_factory=lambda: np.zeros(1_024))

    def meet(self, words: set[str]) -> None:
        """Numbers words that have none yet."""
        first, weight = len(self.numbers) - len(SENTENCE_ENDS) + 1, self.weights.get
        while first + len(words) > len(self.added):
            self.added = np.concatenate([self.added, np.zeros(len(self.added))])
        for n, word in enumerate(words, first):
            self.numbers[word] = n
            self.added[n] = sum(weight(f, 0.0) for f in features(word))

    def score(self, text: str) -> tuple[float, int, int, int | None, float | None]:
        """The document's score, its sentences, the offending ones, and start and score of the worst."""
        if not 0 < len(self.numbers) <= MEMO:
            self.numbers = dict.fromkeys(SENTENCE_ENDS, 0)
        tokens = TOKENS(text.lower())
        if new := set(tokens).difference(self.numbers):
            self.meet(new)
        own = np.array(list(map(self.numbers.__getitem__, tokens)), np.int64)
        marks = np.cumsum(own == 0)
        sentence, at = marks[own > 0], own[own > 0]
        if not len(at):
            return 0.0, 0, 0, None, None
        first = np.flatnonzero(np.diff(sentence, prepend=-1))
        z = np.full(len(first), self.bias)
        added = self.added[at]
        telling = np.flatnonzero(added)
        if len(telling):
            place = np.searchsorted(sentence[first], sentence[telling])
            distinct = np.unique(place * len(self.added) + at[telling], return_index=True)[1]
            np.add.at(z, place[distinct], added[telling[distinct]])
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        worst = int(p.argmax())
        before = int(sentence[first[worst]])
        start = next(islice(ENDS.finditer(text), before - 1, None)).end() if before else 0
        return float(-np.expm1(-softplus(z).sum())), len(first), int((p >= SENTENCE_THRESHOLD).sum()), start, float(p[worst])


def constant(share: float) -> SentenceModel:
    """The model where there is but one kind of label, or none."""
    return SentenceModel(bias=30.0 if share == 1 else -30.0)


def fit(
    labels: np.ndarray, plain: np.ndarray, bags: np.ndarray, lengths: np.ndarray, columns: np.ndarray, names: list[str], rounds: int = ROUNDS, ridge: float = 1e-4
) -> SentenceModel:
    """Of each document the label, its sentences without features, and those with; of each of these the number of
    features; the features, one after the other."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    owner = np.repeat(np.arange(len(labels)), bags)
    theta = np.zeros(len(names) + 1)
    theta[-1] = np.log(labels.mean() / max(1.0, (plain + np.bincount(owner, minlength=len(labels))).mean()))
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    losses: list[float] = []
    for step in range(1, rounds + 1):
        w, b = theta[:-1], theta[-1]
        z = b + np.bincount(rows, w[columns], len(lengths))
        total = np.bincount(owner, softplus(z), len(labels)) + plain * softplus(b)
        losses.append(float(np.where(labels > 0, -np.log(-np.expm1(-np.clip(total, 1e-9, 500))), total).mean()))
        if step > 60 and losses[-21] - losses[-1] < STILL * losses[-1]:
            break
        slope = np.where(labels > 0, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0) / len(labels)
        at = slope[owner] / (1 + np.exp(-np.clip(z, -500, 500)))
        gradient = np.append(np.bincount(columns, at[rows], len(names)) + ridge * w, at.sum() + (slope * plain).sum() / (1 + np.exp(-b)))
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        rate = 0.1 * min(1.0, 2.0 * (1 - step / (rounds + 1)))
        theta = theta - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return SentenceModel(float(theta[-1]), {n: float(x) for n, x in zip(names, theta[:-1], strict=True) if abs(x) > 1e-3})


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def told(positive: Column, held: Column, n_positive: int, n: int) -> Column:
    """The likelihood-ratio statistic, in nats, of a feature's presence: in ``held`` of n documents, ``positive`` toxic ones."""

    def entropy(a: Column, n: Column) -> Column:
        part = lambda x: F.when(x > 0, x * F.log(x / n)).otherwise(0.0)
        return -(part(a) + part(n - a))

    a, h, every = positive.cast("double"), held.cast("double"), n_positive / n
    whole = -n * (every * math.log(every) + (1 - every) * math.log(1 - every))
    return F.lit(whole) - entropy(a, h) - F.when(h < n, entropy(F.lit(float(n_positive)) - a, F.lit(float(n)) - h)).otherwise(0.0)


def train(docs: DataFrame, labels: DataFrame, *, most_labelled: int = MOST_LABELLED, least_told: float = LEAST_TOLD) -> SentenceModel:
    """The model of the labelled documents that are not held out."""
    with passing(docs.sparkSession):  # the model is the driver's
        ids = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        ids = ids.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
        # bounded by most_labelled rows of two numbers
        sample = stored(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("toxic", "text"), "labelled", compression="zstd")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for batch in batches:
                for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                    words = {w for words in sentences(text or "") for w in words}
                    seen[toxic > 0].update({f for w in words for f in features(w)})
                    seen[toxic > 0][""] += 1
            names = list(seen[0].keys() | seen[1].keys())
            for i in range(0, len(names), 100_000):
                part = names[i : i + 100_000]
                columns = [pa.array(part, pa.string()), *(pa.array([seen[k][x] for x in part], pa.int64()) for k in (1, 0))]
                yield pa.RecordBatch.from_arrays(columns, names=["feature", "positive", "negative"])

        counts = sample.mapInArrow(count, "feature string, positive bigint, negative bigint").groupBy("feature")
        counts = stored(counts.agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative")), "features")
        every = counts.where("feature = ''").collect()
        n_positive, n_negative = (every[0]["positive"], every[0]["negative"]) if every else (0, 0)
        if not n_positive or not n_negative:
            return constant(float(n_positive > 0))
        tells = told(F.col("positive"), F.col("positive") + F.col("negative"), n_positive, n_positive + n_negative)
        names = [r[0] for r in counts.where("feature != ''").where(tells >= least_told).select("feature").orderBy("feature").collect()]
        numbers = docs.sparkSession.sparkContext.broadcast({x: i for i, x in enumerate(names)})

        def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            get = numbers.value.get
            for batch in batches:
                plain, lengths, flat = [], [], []
                for text in batch.column("text").to_pylist():
                    found = [[i for w in set(words) for f in features(w) if (i := get(f)) is not None] for words in sentences(text or "")]
                    lengths.append([len(x) for x in found if x])
                    flat.append([i for x in found for i in x])
                    plain.append(len(found) - len(lengths[-1]))
                columns = [batch.column("toxic").cast(pa.int64()), pa.array(plain, pa.int64()), *(pa.array(x, pa.list_(pa.int32())) for x in (lengths, flat))]
                yield pa.RecordBatch.from_arrays(columns, names=["toxic", "plain", "lengths", "features"])

        rows = sample.mapInArrow(bag, "toxic bigint, plain bigint, lengths array<int>, features array<int>").toArrow()
        lengths, flat = (rows.column(c).combine_chunks() for c in ("lengths", "features"))
        return fit(
            rows.column("toxic").to_numpy().astype(float), rows.column("plain").to_numpy().astype(float),
            pa.compute.list_value_length(lengths).to_numpy(), lengths.flatten().to_numpy(), flat.flatten().to_numpy(), names,
        )


def scored(docs: DataFrame, model: SentenceModel) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id and the columns of SCORED."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SentenceModel(*shared.value)
        for batch in batches:
            rows = [own.score(x or "") for x in batch.column("text").to_pylist()]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            kinds = (pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            arrays = [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *SCORED.replace(",", "").split()[::2]])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id bigint, {SCORED}")


def clean(docs: DataFrame, model: SentenceModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SentenceModel(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array([own.score(x or "")[0] < threshold for x in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """doc_id, held_out, score, predicted and where the worst sentence starts."""
    found = scored(docs, train(docs, labels, **settings))
    return found.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
        "n_sentences", "n_offending", "worst_start", "worst_score",
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
