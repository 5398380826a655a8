import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing
from tessera.llm.mixing import curriculum, mix, occurrences


def fill(sizes, weights, total, cap):
    """Reshares what exceeds the caps, round after round."""
    names = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, rest = {n: 0.0 for n in names}, total * sum(sizes.values())
    open_ = set(names)
    while rest > 1e-9 and open_:
        share = rest / sum(weight[n] for n in open_)
        rest = 0.0
        for n in sorted(open_, key=str):
            target[n] += share * weight[n]
        for n in list(open_):
            if target[n] >= cap * sizes[n]:
                rest += target[n] - cap * sizes[n]
                target[n] = cap * sizes[n]
                open_.discard(n)
    return target


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, "c": 500, None: 300, "B": 50, "é": 5}, {"a": 7}, {"a": 3000, "b": 1, "c": 2, "d": 1}])
def test_targets_and_takes(docs, sizes):
    rows, i = [], 0
    for source, size in sizes.items():
        left = size
        while left:
            n = min(left, 1 + (i * 7) % 13)
            rows.append((i, "w " * n, source))
            left, i = left - n, i + 1
    found = curriculum(docs(*rows)).collect()
    target = fill(sizes, mixing.WEIGHTS, 1.5, 2.0)
    for name in sizes:
        own = [r for r in found if r.source == name]
        assert {r.source_size for r in own} == {sizes[name]}
        assert own[0].target == pytest.approx(target[name])
        assert sum(r.taken for r in own) == int(own[0].target + 0.5)
        assert all(0 <= r.taken <= 2 * r["size"] for r in own)
    assert sorted(map(str, found)) == sorted(map(str, curriculum(docs(*rows)).collect()))


def test_buckets_change_nothing(docs, monkeypatch):
    rows = [(i, "w " * (i % 9), "hot" if i % 3 else f"s{i % 5}") for i in range(600)]
    one = sorted(map(tuple, curriculum(docs(*rows)).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    assert sorted(map(tuple, curriculum(docs(*rows)).collect())) == one


def test_positions_follow_the_schedules(docs):
    df = docs(*((i, "w " * 10, "up" if i % 2 else "down") for i in range(400)))
    placed = occurrences(curriculum(df, weights=(1.0, 1.0), tilt=0.5)).collect()
    assert all(0 <= r.position <= 1 for r in placed)
    early = [r for r in placed if r.position < 0.5]
    share = sum(r.words for r in early if r.source == "down") / sum(r.words for r in placed if r.source == "down")
    assert share == pytest.approx(0.5 - 0.5 / 4, abs=0.02)  # the first source's rate rises


def test_mix_keeps_columns_and_repeats(docs):
    df = docs(*((i, "w " * 20, "a" if i < 30 else "b") for i in range(200)), (500, None, "a"), (501, "", None), (7, "w " * 20, "a"), (None, "w", None))
    mixed = mix(df)
    assert mixed.columns == df.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert max(n for i, n in counts.items() if i != 7) <= 2 and 500 not in counts and 501 not in counts
    assert mixed.where("source = 'a'").agg(F.count("*")).first()[0] == 62


def test_empty_table(docs):
    assert curriculum(docs()).count() == 0
    assert mix(docs()).count() == 0


def test_repeated_and_missing_ids_are_spread(docs, monkeypatch):
    """A third of the rows under one doc_id and a third under none: the sums hold, and no bucket has them all."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    rows = [(7, "w " * (1 + i % 5), "a") for i in range(200)] + [(None, "w " * (1 + i % 3), "a") for i in range(200)] + [(i, "w w", "ab"[i % 2]) for i in range(1_000, 1_200)]
    own = curriculum(docs(*rows)).collect()
    assert len(own) == 600
    for name in "ab":
        part = sorted((r.start, r["size"]) for r in own if r.source == name)
        assert [s for s, _ in part] == [sum(n for _, n in part[:i]) for i in range(len(part))]
        assert sum(r.taken for r in own if r.source == name) == int(next(r.target for r in own if r.source == name) + 0.5)
    assert sorted(map(str, own)) == sorted(map(str, curriculum(docs(*rows)).collect()))


def test_very_long_text_and_clashing_names(docs):
    df = docs((1, "w " * 300_000, "a"), (2, "w", "b"), (3, "w " * 50_000, None)).withColumns({c: F.lit(9) for c in ("key", "name", "bucket", "position", "pass", "own", "whole", "spot", "target")})
    mixed = mix(df)
    assert mixed.columns == df.columns and {r.doc_id for r in mixed.collect()} == {1, 2, 3}
    assert {r["size"] for r in curriculum(df).collect()} == {300_000, 1, 50_000}
