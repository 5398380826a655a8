import hashlib
import random

import pytest

from tessera.llm import substring_dedup as sd

COLUMNS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def brute(documents, window=50):
    first, found = {}, []
    split = [(i, (t or "").encode().split()) for i, t in documents]
    for i, words in split:
        if i is not None:
            for k in range(len(words) - window + 1):
                key = tuple(words[k : k + window])
                first[key] = min(first.get(key, i), i)
    for i, words in split:
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            least = first.get(tuple(words[k : k + window]))
            if least is not None and (i is None or least < i):
                gone[k : k + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        found.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=repr)


def words(chosen, n, vocabulary=300):
    return [f"v{int(vocabulary ** chosen.random())}" for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(docs, rows, seed):
    chosen = random.Random(seed)
    passages = [words(chosen, n) for n in (49, 50, 51, 75, 200)] + [["run"] * 120, ["a", "b"] * 60, ["a", "b", "c"] * 40, ["r"] * 30 + words(chosen, 20)]
    documents = []
    for i in range(90):
        text = words(chosen, chosen.randrange(120))
        for _ in range(chosen.randrange(3)):
            passage = chosen.choice(passages)
            a = chosen.randrange(len(passage))
            part = passage if chosen.random() < 0.7 else passage[a:]
            at = chosen.randrange(len(text) + 1)
            text[at:at] = part
        documents.append((chosen.randrange(1_000), chosen.choice([" ", "\n", "\t "]).join(text)))
    documents += [(2_000, documents[0][1]), (2_001, documents[0][1]), (1, None), (2, ""), (None, documents[3][1]), (None, " ".join(passages[4])), documents[5], (documents[5][0], " ".join(passages[3]))]
    documents += [(3_000, " ".join(["run"] * 5_000)), (3_001, " ".join(["run"] * 60)), (3_002, " ".join(["a", "b"] * 500))]
    assert rows(sd.substring_dedup(docs(*documents)), *COLUMNS) == brute(documents)


def test_small_windows_and_chunks(docs, rows, monkeypatch):
    chosen = random.Random(9)
    documents = [(i, " ".join(words(chosen, 40, 6))) for i in range(60)]
    for window in (2, 5, 9):
        assert rows(sd.substring_dedup(docs(*documents), window=window), *COLUMNS) == brute(documents, window)


def test_hot_passage_and_long_text(docs, rows):
    chosen = random.Random(2)
    hot = " ".join(words(chosen, 60))
    documents = [(i, f"{' '.join(words(chosen, 20))} {hot} {i}") for i in range(400)] + [(900, " ".join(words(chosen, 20_000)) + " " + hot)]
    assert rows(sd.substring_dedup(docs(*documents)), *COLUMNS) == brute(documents)


def test_empty_table(docs):
    assert sd.substring_dedup(docs()).count() == 0
    assert sd.substring_dedup(docs((1, None), (2, "short"))).count() == 2


def test_long_texts_of_one_doc_id(docs, rows):
    chosen = random.Random(3)
    a, b = (" ".join(words(chosen, 160_000, 100_000)) for _ in range(2))
    documents = [(1, a), (1, b), (2, " ".join(a.split()[1_000:1_200])), (1, None), (1, a), (None, b)]
    assert rows(sd.substring_dedup(docs(*documents)), *COLUMNS) == brute(documents)


def test_many_rows_without_doc_id_are_not_paired(docs, rows):
    chosen = random.Random(4)
    shared = words(chosen, 70)
    documents = [(None, " ".join(words(chosen, 30) + shared + words(chosen, 30))) for _ in range(1_000)] + [(8, " ".join(shared))]
    df = docs(*documents)
    met = sd.name_windows
    seen = []

    def counted(texts, window):
        seen.append(texts.count())
        return met(texts, window)

    sd.name_windows = counted
    try:
        assert rows(sd.substring_dedup(df), *COLUMNS) == brute(documents)
    finally:
        sd.name_windows = met
    assert seen == [1_001]  # each text is read once


def test_columns_with_clashing_names(docs, rows):
    from pyspark.sql import functions as F

    df = docs((1, "a b"), (2, " ".join(["x"] * 60))).withColumns({c: F.lit("other") for c in ("sha", "symbols", "file", "sequence", "first", "kept_of", "shared", "key")})
    assert rows(sd.substring_dedup(df), *COLUMNS) == brute([(1, "a b"), (2, " ".join(["x"] * 60))])
