import random

import numpy as np
import pytest
import xxhash

from tessera.llm import shingles


@pytest.mark.parametrize("seed", [0, 42, 2**64 - 1])
def test_digests_of_all_lengths(seed):
    chosen = random.Random(1)
    data = bytes(chosen.randrange(256) for _ in range(4_000))
    stretches = [(chosen.randrange(3_000), n) for n in [*range(140), 500, 999, 1_000]] + [(3_999, 1), (3_990, 10), (0, 4_000)]
    chosen.shuffle(stretches)
    starts, lengths = np.array(stretches).T
    expected = [xxhash.xxh64_intdigest(data[a : a + n], seed) for a, n in stretches]
    assert shingles.xxh64(data, starts, lengths, seed).tolist() == expected
    assert shingles.xxh64(b"", np.zeros(0, np.int64), np.zeros(0, np.int64), 1).tolist() == []


@pytest.mark.parametrize("chunk", [1, 7, 100_000])
@pytest.mark.parametrize("width", [1, 4, 5])
def test_against_one_text_at_a_time(monkeypatch, chunk, width):
    monkeypatch.setattr(shingles, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(shingles, "BIT_ROWS", 16)
    chosen = random.Random(2)
    words = ["a", "B", "word", "É", "longer-word-than-most-of-them-are", "😀", "x\xa0y"]
    texts = [None, "", " \t\n\x0b\x0c\r", *(chosen.choice(" \n").join(chosen.choice(words) for _ in range(chosen.randrange(1, 40))) for _ in range(60)), "a " * 3]
    found = []
    for first, hashes, bounds in shingles.hashed(texts, width, 42):
        assert first == len(found)
        majorities, (own, own_bounds) = shingles.majorities(hashes, bounds), shingles.distinct(hashes, bounds)
        found += [(hashes[a:b].tolist(), int(m), own[c:d].tolist()) for a, b, m, c, d in zip(bounds, bounds[1:], majorities, own_bounds, own_bounds[1:], strict=False)]
    assert len(found) == len(texts)
    for text, (hashes, majority, own) in zip(texts, found, strict=True):
        parts = (text or "").encode().lower().split()
        grams = [b" ".join(parts[i : i + width]) for i in range(len(parts) - width + 1)] or ([b" ".join(parts)] if parts else [])
        expected = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        assert hashes == expected and own == sorted(set(expected))
        assert majority == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in expected) * 2 > len(expected))
    assert list(shingles.hashed([], width, 42)) == []
