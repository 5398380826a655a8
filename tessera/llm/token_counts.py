"""Token counts behind a digest cache.

The cache is a table (digest, version, n_tokens): the digest is SHA-256 of the content, the version that of the
tokenizer's file and library. Contents are joined to stored counts by both digests; of those missing, one document a
digest is encoded, and the counts are appended to the cache. The file's own normaliser is part of the version, so
the content is digested as it is: two texts share a count only if they are the same text. Writers don't wait for each
other: what two of them append for one digest, or one that is run again, counts once.

Encoding takes a short cut that keeps the library's results: this kind of tokenizer splits a text into pieces and
encodes each alone, so the library is asked once for each distinct piece and a bounded memo keeps its answer. Texts
with characters for which the normaliser could do more than lower-casing, or with a special string, go to the library
whole. A tokenizer of another make goes to the library whole, always.

Defined cases: null text is empty and has 0 tokens; rows with a null or repeated doc_id keep a row each; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from importlib import metadata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import hadoop_path, scratch, stored, whole

VOCABULARY = "word_bpe_49k.json"
#: Pieces that a worker remembers; it starts anew beyond.
MEMO = 200_000
#: Rows of one content beyond which it is a hot one.
HOT = 1_000
CACHE = "digest string, version string, n_tokens bigint"
#: The split that the short cut reproduces, as the tokenizer's file states it.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer_path(vocabulary: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(vocabulary))


def library_counter(path: str) -> Callable[[str], int]:
    """Tokens of a text as the library for the file counts them, without added special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text, num_threads=1))
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda text: len(model.encode(text, add_special_tokens=False).ids)


def separable(path: str) -> bool:
    """Whether the file is a BPE over lower-cased pieces of PIECES, so that pieces can be counted alone."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    return kinds == ["NFC", "Replace", "Lowercase"] and splits[0].get("pattern") == {"Regex": PIECES} and all(x["content"].startswith("<|") for x in spec["added_tokens"])


def counter(path: str) -> Callable[[str], int]:
    library = library_counter(path)
    if not separable(path):
        return library
    import regex

    pieces = regex.compile(PIECES).findall
    # below U+0300 nothing composes; U+0130 and above U+024F lower-casing is left to the library
    odd = regex.compile("[İɐ-\U0010ffff\x1c-\x1f\x85]|<\\|").search

    class Memo(dict):
        def __init__(self, count: Callable[[str], int]) -> None:
            self.count = count

        def __missing__(self, piece: str) -> int:
            if len(self) > MEMO:
                self.clear()
            self[piece] = n = self.count(piece)
            return n

    # no piece holds white space, so that words are remembered first and the pieces of new words second
    of_piece = Memo(library).__getitem__
    of_word = Memo(lambda word: sum(map(of_piece, pieces(word)))).__getitem__
    return lambda text: library(text) if odd(text) else sum(map(of_word, text.lower().split()))


def library_version(path: str) -> str:
    """Name and version of the library that reads the file."""
    name = "sentencepiece" if path.endswith(".model") else "tokenizers"
    return f"{name} {metadata.version(name)}"


def version(path: str) -> str:
    """Digest of the tokenizer: its file, the library's version and the rules of counting."""
    with open(path, "rb") as file:
        return hashlib.sha256(f"1\n{library_version(path)}\n".encode() + file.read()).hexdigest()


def encode(missing: DataFrame, vocabulary: str) -> DataFrame:
    """missing (digest, body) -> (digest, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path(vocabulary))
        for batch in batches:
            counts = [count(x.as_py()) for x in batch.column("body")]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return missing.mapInArrow(run, "digest string, n_tokens bigint")


def known_counts(spark: SparkSession, cache: str, own: str) -> DataFrame:
    """digest and n_tokens of the cache for a version, a row for each digest however often it was appended."""
    rows = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == own)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache: str, *, vocabulary: str = VOCABULARY, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; ``cache`` is the path of the cache table and may not exist yet."""
    spark = docs.sparkSession
    own = version(tokenizer_path(vocabulary))
    bodies = docs.select("doc_id", whole().alias("body"))
    keyed = stored(
        bodies.select("doc_id", F.sha2("body", 256).alias("digest"), F.octet_length("body").cast("long").alias("n_bytes")), "digests"
    )
    fs, path = hadoop_path(spark, cache)
    if not fs.exists(path):
        spark.createDataFrame([], CACHE).write.parquet(cache)
    known = known_counts(spark, cache, own)
    # one document a digest is encoded: its identifier is dealt evenly, however large a group of copies is
    groups = stored(keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")), "groups")
    chosen = groups.join(known, "digest", "left_anti")
    named = chosen.where("doc_id IS NOT NULL")
    texts = bodies.join(named, "doc_id").where(F.sha2("body", 256) == F.col("digest")).select("digest", "body")
    if not chosen.where("doc_id IS NULL").isEmpty():
        nameless = bodies.where("doc_id IS NULL").withColumn("digest", F.sha2("body", 256))
        texts = texts.unionByName(nameless.join(chosen.where("doc_id IS NULL"), "digest", "left_semi").select("digest", "body"))
    counted = encode(texts, vocabulary).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counted.select("digest", F.lit(own).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    counts = known_counts(spark, cache, own)
    # the counts of hot digests are few (one for HOT rows at least), and meet their rows apart from the others
    hot = counts.join(groups.where(F.col("copies") > HOT), "digest", "left_semi").select("digest", F.col("n_tokens").alias("hot_tokens"))
    told = keyed.join(stored(hot, "hot"), "digest", "left")
    rest = told.where("hot_tokens IS NULL").drop("hot_tokens").join(counts, "digest")
    every = told.where("hot_tokens IS NOT NULL").withColumnRenamed("hot_tokens", "n_tokens").unionByName(rest)
    return every.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the cache that the session's spark.tessera.tokenCache names, else over a new one."""
    cache = spark.conf.get("spark.tessera.tokenCache", None) or scratch(spark, "token-cache")
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), cache)
