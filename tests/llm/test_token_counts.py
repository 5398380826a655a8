import random

from pyspark.sql import functions as F

from tessera.llm import token_counts as tc

COLUMNS = ("doc_id", "n_bytes", "n_tokens", "over_limit")


def test_short_cut_counts_as_the_library():
    path = tc.tokenizer_path(tc.VOCABULARY)
    assert tc.separable(path)
    own, library = tc.counter(path), tc.library_counter(path)
    chosen = random.Random(1)
    letters = " \t\n\x0b\x1c\x85\xa0'stremvdl.,<|>09½ßéÉñÑaAİıΣσς́e٣中😀 "
    texts = ["".join(chosen.choice(letters) for _ in range(chosen.randrange(25))) for _ in range(4_000)]
    texts += ["", "<|endoftext|>", "a<|startoftext|>b", "word " * 3_000, "x" * 5_000] + [f"{chr(c)}a {chr(c)}" for c in range(0x300)]
    assert [t for t in texts if own(t) != library(t)] == []


def test_other_makes_go_to_the_library():
    for vocabulary in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        path = tc.tokenizer_path(vocabulary)
        assert not tc.separable(path) and tc.counter(path)("a few words") > 1


def test_table_and_cache(docs, rows, spark, tmp_path):
    library = tc.library_counter(tc.tokenizer_path(tc.VOCABULARY))
    texts = [(1, "some words"), (2, "some words"), (2, "some words"), (3, None), (4, ""), (None, "näme"), (None, "other"), (5, "long " * 2_049), (6, "a b c " * 40_000)]
    cache = f"file://{tmp_path}/cache"
    expected = sorted([(i, len((t or "").encode()), library(t or ""), library(t or "") > 2_048) for i, t in texts], key=repr)
    assert rows(tc.token_counts(docs(*texts), cache), *COLUMNS) == expected
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t in texts})
    assert rows(tc.token_counts(docs(*texts, (7, "new")), cache), *COLUMNS) == sorted([*expected, (7, 3, 1, False)], key=repr)
    assert spark.read.parquet(cache).count() == stored.count() + 1
    # what the cache says counts, for its own version only
    spark.read.parquet(cache).withColumn("n_tokens", F.lit(9).cast("long")).write.parquet(f"{cache}2")
    assert {r[2] for r in rows(tc.token_counts(docs((1, "some words")), f"{cache}2"), *COLUMNS)} == {9}
    other = tc.token_counts(docs((1, "some words")), f"{cache}2", vocabulary="byte_bpe_50k.json")
    assert {r[2] for r in rows(other, *COLUMNS)} == {2}


def test_empty_table(docs, tmp_path):
    assert tc.token_counts(docs(), f"file://{tmp_path}/cache").count() == 0


def test_a_digest_that_is_cached_twice_counts_once(docs, rows, spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    given = docs(*((i, f"text {i}") for i in range(10)))
    expected = rows(tc.token_counts(given, cache), *COLUMNS)
    spark.read.parquet(cache).write.mode("append").parquet(f"{cache}2")
    spark.read.parquet(cache).write.mode("append").parquet(f"{cache}2")
    assert rows(tc.token_counts(given, f"{cache}2"), *COLUMNS) == expected and len(expected) == 10


def test_another_library_is_another_version(monkeypatch):
    path = tc.tokenizer_path(tc.VOCABULARY)
    before = tc.version(path)
    monkeypatch.setattr(tc.metadata, "version", lambda name: "99")
    assert tc.version(path) != before and tc.library_version("x.model") == "sentencepiece 99"


def test_hot_contents(docs, rows, monkeypatch, tmp_path):
    monkeypatch.setattr(tc, "HOT", 5)
    given = [(i, "hot words") for i in range(40)] + [(100 + i, f"text {i}") for i in range(10)] + [(None, "hot words")] * 3 + [(200 + i, None) for i in range(7)]
    library = tc.library_counter(tc.tokenizer_path(tc.VOCABULARY))
    expected = sorted([(i, len((t or "").encode()), library(t or ""), False) for i, t in given], key=repr)
    assert rows(tc.token_counts(docs(*given), f"file://{tmp_path}/cache"), *COLUMNS) == expected
