import random
import zlib

import pytest

from tessera.llm import toxicity as tx


@pytest.fixture
def labels(spark):
    return lambda *rows: spark.createDataFrame([(*r, "en", "x") for r in rows], "doc_id bigint, toxic int, lang string, text string")


def corpus(n, seed=0):
    chosen, bad = random.Random(seed), ("vile", "rotten", "blahface")
    texts, toxic = [], []
    for i in range(n):
        lines = [" ".join(f"w{chosen.randrange(40)}" for _ in range(8)) for _ in range(1 + chosen.randrange(12))]
        if i % 4 == 0:
            lines[chosen.randrange(len(lines))] += " " + chosen.choice(bad) + chosen.choice(("", "s", "ly"))
        texts.append(". ".join(lines))
        toxic.append(int(i % 4 == 0))
    return texts, toxic


def test_learns_and_locates(docs, labels):
    texts, toxic = corpus(1_200)
    df = docs(*enumerate(texts), (5_000, None), (5_001, ""), (5_002, "... !"), (None, "vile w1"), (3, texts[3]), (6_000, "w1 w2. " * 20_000))
    found = tx.toxicity(df, labels(*enumerate(toxic), (None, 1), (9_999, 1), (1, None))).collect()
    by_id = {r.doc_id: r for r in found}
    held = [i for i in range(1_200) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(found) == 1_206 and {r.doc_id for r in found if r.held_out and r.doc_id is not None and r.doc_id < 1_200} == set(held)
    right = sum((by_id[i].predicted == 1) == (toxic[i] == 1) for i in held) / len(held)
    assert right > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert by_id[5_000].score == by_id[5_001].score == by_id[5_002].score == 0 and by_id[None].predicted == 1 and not by_id[None].held_out
    spot = [i for i in held if toxic[i] and by_id[i].predicted]
    hits = sum(any(b in texts[i][by_id[i].worst_start :].split(".")[0] for b in ("vile", "rotten", "blahface")) for i in spot)
    assert hits > 0.9 * len(spot)


def test_held_out_labels_tell_nothing(docs, labels):
    texts, toxic = corpus(300)
    df = docs(*enumerate(texts))
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in enumerate(toxic)]
    a, b = (sorted((r.doc_id, r.score) for r in tx.toxicity(df, labels(*x)).collect()) for x in (list(enumerate(toxic)), turned))
    assert a == b


def test_bound_on_labelled_rows(docs, labels):
    texts, toxic = corpus(300)
    model = tx.train(docs(*enumerate(texts)), labels(*enumerate(toxic)), most_labelled=150)
    assert model.weights


@pytest.mark.parametrize("y", [(), (0,), (1,)])
def test_without_both_classes(docs, labels, y):
    texts, _ = corpus(40)
    found = tx.toxicity(docs(*enumerate(texts)), labels(*((i, v) for i in range(40) for v in y))).collect()
    assert {r.predicted for r in found} == {int(y == (1,))}


def test_clean_keeps_rows(docs, labels):
    texts, toxic = corpus(800)
    df = docs(*enumerate(texts), (None, None))
    left = tx.clean(df, tx.train(df, labels(*enumerate(toxic))))
    assert left.columns == df.columns
    gone = {i for i in range(800)} - {r.doc_id for r in left.collect()}
    assert gone and sum(toxic[i] for i in gone) >= 0.95 * len(gone)
    assert tx.toxicity(docs(), labels()).count() == 0


def test_scores_against_a_plain_reading():
    """Sentences, distinct words and their features, one after the other."""
    import math
    import re

    chosen = random.Random(4)
    weights = {"vile": 5.0, "rot*": 2.0, "rotten": 1.0, "été": -3.0, "calm": -2.0}
    model = tx.SentenceModel(-3.0, weights)
    words = ["vile", "rotten", "rotting", "calm", "Été", "plain", "x1y", "VILE", "", ".", "...", "!?", "\n", "İx", " "]
    for _ in range(400):
        text = " ".join(chosen.choice(words) for _ in range(chosen.randrange(30)))
        clean, found = 1.0, []
        for m in re.finditer(r"[^.!?\n]+", text):
            own = set(re.findall(r"[^\W\d_]+", m[0].lower()))
            if own:
                z = -3.0 + sum(weights.get(f, 0.0) for w in own for f in tx.features(w))
                found.append((m.start(), 1 / (1 + math.exp(-z))))
                clean *= 1 - found[-1][1]
        score, n, offending, start, worst = model.score(text)
        assert math.isclose(score, 1 - clean, abs_tol=1e-9) and n == len(found) and offending == sum(p >= 0.3 for _, p in found)
        if found:
            at, p = max(found, key=lambda x: x[1])
            assert start == at and math.isclose(worst, p, rel_tol=1e-9)
        else:
            assert start is None and worst is None


def test_the_statistic_in_columns(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rows = [(0, 5), (5, 0), (3, 40), (40, 60), (40, 0), (0, 60), (1, 1)]
    found = [r[0] for r in spark.createDataFrame(rows, "p bigint, n bigint").select(tx.told(F.col("p"), F.col("p") + F.col("n"), 40, 100)).collect()]

    def entropy(a, n):
        return -sum(x * np.log(x / n) for x in (a, n - a) if x > 0)

    assert np.allclose(found, [entropy(40, 100) - entropy(p, p + n) - entropy(40 - p, 100 - p - n) for p, n in rows])


def test_very_long_labelled_text(docs, labels):
    texts, toxic = corpus(200)
    df = docs(*enumerate(texts), (1_000, "w1 w2. " * 100_000), (1_001, None))
    assert tx.train(df, labels(*enumerate(toxic), (1_000, 0), (1_001, 1))).weights
