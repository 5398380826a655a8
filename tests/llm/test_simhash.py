import random

import numpy as np
import pytest
import xxhash

from tessera.llm import near_copies, simhash
from tessera.llm.components import components
from tessera.llm.simhash import fingerprint, near_dedup, near_duplicates


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def slow_components(pairs):
    """pairs: (doc_id, fingerprint)."""
    parent = {i: i for i, _ in pairs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in pairs:
        for j, b in pairs:
            if i < j and (a ^ b).bit_count() <= 4:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in pairs}


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One Two three", "a b c d", "A b C d e", "É É é a", "x " * 20_000, "a\x0bb\x0cc\xa0d e f", "ab " * 9 + "cd " * 9])
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


def near(chosen, n, groups):
    texts = []
    for g in range(groups):
        words = [f"w{chosen.randrange(5_000)}" for _ in range(120)]
        for _ in range(n):
            copy = list(words)
            for _ in range(chosen.randrange(3)):
                copy[chosen.randrange(len(copy))] = f"x{chosen.randrange(100)}"
            texts.append(" ".join(copy))
    return texts


def test_components_against_brute_force(docs, rows, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 8)  # a deep forest on few fingerprints
    monkeypatch.setattr(simhash, "HOME_CELL", 3)
    monkeypatch.setattr(simhash, "VISITOR_CELL", 5)
    texts = near(random.Random(3), 6, 40) + ["", None, "one", "one", "One"]
    order = list(range(len(texts)))
    random.Random(4).shuffle(order)
    pairs = [(i, slow_fingerprint(texts[k])) for i, k in enumerate(order)]
    expected = slow_components(pairs)
    found = rows(near_duplicates(docs(*((i, texts[k]) for i, k in enumerate(order)))), "doc_id", "fingerprint", "component_id")
    assert found == sorted(((i, f"{fp:016x}", expected[i]) for i, fp in pairs), key=repr)
    assert len(set(expected.values())) < len(texts) - 50


def test_forest_loses_no_pair():
    chosen = np.random.default_rng(5)
    base = chosen.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2)
    flips = np.array([sum(1 << int(b) for b in chosen.choice(64, chosen.integers(0, 5), replace=False)) for _ in base], np.uint64)
    points = np.unique(np.concatenate([base, base ^ flips]))
    forest = simhash.Forest(points[:100], 7)
    met = set()
    for row, shard, home in forest.visits(points):
        at = {}
        for r, s in zip(row[home], shard[home], strict=True):
            at.setdefault(s, []).append(r)
        for r, s in zip(row, shard, strict=True):
            met.update((min(r, q), max(r, q)) for q in at.get(s, ()))
    near_pairs = {(i, j) for i in range(len(points)) for j in range(i + 1, len(points)) if (int(points[i]) ^ int(points[j])).bit_count() <= 4}
    assert near_pairs and near_pairs <= met


def test_hot_group_of_near_copies(docs, rows):
    texts = near(random.Random(6), 300, 1)
    found = rows(near_duplicates(docs(*enumerate(texts))), "doc_id", "component_id")
    expected = slow_components([(i, slow_fingerprint(t)) for i, t in enumerate(texts)])
    assert found == sorted(expected.items(), key=repr)


def test_one_of_each_group_stays(docs, rows):
    text = " ".join(f"w{i}" for i in range(60))
    df = docs((5, text), (3, text), (3, text), (9, "other words altogether here"), (None, text), (None, "lone null row of its own"), (7, None), (8, ""))
    left = near_dedup(df)
    assert left.columns == df.columns
    assert rows(left, "doc_id", "text") == sorted([(3, text), (9, "other words altogether here"), (None, "lone null row of its own"), (7, None)], key=repr)
    assert near_dedup(docs()).count() == 0 and near_duplicates(docs()).count() == 0


def test_unlike_texts_without_or_with_one_doc_id_all_stay(docs, rows):
    texts = [" ".join(f"{t}{i}" for i in range(60)) for t in "abcde"]
    df = docs(*((None, t) for t in texts[:3]), (None, texts[0]), (5, texts[3]), (5, texts[4]), (5, texts[4]))
    assert rows(near_dedup(df), "doc_id", "text") == sorted([(None, t) for t in texts[:3]] + [(5, t) for t in texts[3:]], key=repr)


@pytest.mark.parametrize("hot", [50, 1])
def test_near_dedup_against_all_pairs_at_the_threshold(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(near_copies, "HOT", hot)
    monkeypatch.setattr(near_copies, "SALT", 3)
    chosen = random.Random(9)
    texts = []
    for _ in range(12):
        base = [f"w{chosen.randrange(5_000)}" for _ in range(chosen.choice([30, 90, 200]))]
        for k in range(7):
            copy = list(base)
            for _ in range(k // 2):
                copy[chosen.randrange(len(copy))] = f"x{chosen.randrange(100)}"
            texts.append(" ".join(copy))
    chosen.shuffle(texts)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    kept = sorted(set(root))
    assert 20 < len(kept) < len(texts) - 20
    assert rows(near_dedup(docs(*enumerate(texts))), "doc_id") == sorted(((i,) for i in kept), key=repr)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1_000, i) for i in range(1_001, 1_400)] + [(2_000, 2_000)]
    random.Random(1).shuffle(chain)
    found = dict(map(tuple, components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()))
    assert found == {i: 0 for i in range(1, 201)} | {i: 1_000 for i in range(1_001, 1_400)}


def test_nearest_forest_against_prims():
    from tessera.llm.components import nearest_forest

    chosen = np.random.default_rng(2)
    for n in (1, 2, 30, 80):
        a, b = chosen.integers(0, n, (2, 300))
        d, group = chosen.integers(0, 6, 300), np.arange(n) // 2
        kept = nearest_forest(a, b, d, group)
        for most in range(6):  # what edges up to a distance connect, the forest's edges up to it connect too
            roots = []
            for edges in (np.arange(300), kept):
                root = group.copy()
                for e in edges[d[edges] <= most]:
                    x, y = sorted((root[a[e]], root[b[e]]))
                    root[root == y] = x
                roots.append(root)
            assert (roots[0] == roots[1]).all()
        assert len(kept) < max(1, len(np.unique(group)))


def test_trees_deepen_with_few_sampled_points():
    chosen = np.random.default_rng(5)
    points = chosen.integers(0, 2**63, 3_000, dtype=np.uint64) * np.uint64(2)
    pairs = np.concatenate([points, points ^ np.uint64(0b1010000000000000000000000000000000100000000000000000000000001)])
    forest = simhash.Forest(points[:50], 16)
    homes, visits = {}, {}
    for tree, (row, shard, home) in enumerate(forest.visits(pairs)):
        for r, s, h in zip(row.tolist(), shard.tolist(), home.tolist(), strict=True):
            visits.setdefault(r, set()).add(s)
            if h:
                homes.setdefault(r, set()).add(s)
    assert all(len(homes[r]) == 3 for r in range(6_000))
    assert all(visits[r] & homes[r + 3_000] or visits[r + 3_000] & homes[r] for r in range(3_000))


def test_hot_family_beyond_one_cell(docs, rows, monkeypatch):
    """Many texts that share most of a passage, some of them copies of each other: exact against all pairs."""
    monkeypatch.setattr(near_copies, "HOT", 5)
    monkeypatch.setattr(near_copies, "SALT", 20)
    chosen = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(60):
        own = list(base)
        for _ in range(7):
            own[chosen.randrange(150)] = f"x{k}-{chosen.randrange(10_000)}"
        texts.append(" ".join(own))
        if k % 3 == 0:
            own[chosen.randrange(150)] = "changed"
            texts.append(" ".join(own))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    assert 20 < len(set(root)) < len(texts)
    assert rows(near_dedup(docs(*enumerate(texts))), "doc_id") == sorted(((i,) for i in set(root)), key=repr)
