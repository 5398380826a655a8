"""Word shingles of many texts at once, and their XXH64 digests.

Words are separated by ASCII white space and only A-Z are lower-cased. A text of fewer words than a shingle has is one
shingle, a text without words has none. Digests are taken over arrays: every step of the hash runs on all shingles
that it concerns, read from one buffer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

# The multipliers of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Words that are hashed together.
CHUNK_WORDS = 100_000
#: Hashes whose bits are counted together.
BIT_ROWS = 65_536


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _mixed(lane: np.ndarray) -> np.ndarray:
    return _turned(lane * P2, 31) * P1


def xxh64(data: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each stretch of ``data``."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64)
    padded = np.frombuffer(data + bytes(8), np.uint8)
    eights, fours = (np.ndarray((len(padded) - size + 1,), f"<u{size}", padded, 0, (1,)) for size in (8, 4))
    order = np.argsort(-lengths, kind="stable")  # so that those a step concerns come first
    at, left = starts[order].astype(np.int64), lengths[order].astype(np.int64)
    whole, start = left.astype(np.uint64), lambda n, *more: np.full(n, (seed + sum(map(int, more))) % 2**64, np.uint64)
    h = start(n, P5)

    if n_long := int(np.count_nonzero(left >= 32)):
        lanes = [start(n_long, P1, P2), start(n_long, P2), start(n_long), start(n_long, -int(P1))]
        stripes = left[:n_long] // 32
        for k in range(int(stripes[0])):
            m = int(np.count_nonzero(stripes > k))
            for i, v in enumerate(lanes):
                v[:m] = _turned(v[:m] + eights[at[:m] + (32 * k + 8 * i)] * P2, 31) * P1
        made = sum((_turned(v, bits) for v, bits in zip(lanes, (1, 7, 12, 18), strict=True)), np.zeros(n_long, np.uint64))
        for v in lanes:
            made = (made ^ _mixed(v)) * P1 + P4
        h[:n_long] = made
        at[:n_long] += 32 * stripes
        left[:n_long] -= 32 * stripes
    h += whole

    for _ in range(3):
        own = np.flatnonzero(left >= 8)
        h[own] = _turned(h[own] ^ _mixed(eights[at[own]]), 27) * P1 + P4
        at[own] += 8
        left[own] -= 8
    own = np.flatnonzero(left >= 4)
    h[own] = _turned(h[own] ^ (fours[at[own]].astype(np.uint64) * P1), 23) * P2 + P3
    at[own] += 4
    left[own] -= 4
    for _ in range(3):
        own = np.flatnonzero(left > 0)
        h[own] = _turned(h[own] ^ (padded[at[own]].astype(np.uint64) * P5), 11) * P1
        at[own] += 1
        left[own] -= 1

    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    found = np.empty(n, np.uint64)
    found[order] = h ^ (h >> np.uint64(32))
    return found


def hashed(texts: Sequence[str | None], width: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Some texts at a time: the number of the first, the hashes of all their shingles, and where each text's begin and
    the last one's end."""
    first, words, counts = 0, [], []
    for at, text in enumerate(texts):
        own = text.encode().lower().split() if text else []
        words += own
        counts.append(len(own))
        if len(words) >= CHUNK_WORDS or at + 1 == len(texts):
            n = np.array(counts, np.int64)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(lengths + 1) - 1
            begins = ends - lengths
            begin_word = np.cumsum(n) - n
            shingles = np.where(n > width, n - width + 1, np.minimum(n, 1))
            bounds = np.append(0, np.cumsum(shingles))
            owner = np.repeat(np.arange(len(n)), shingles)
            low = begin_word[owner] + np.arange(bounds[-1]) - bounds[owner]
            high = low + np.minimum(width, n[owner]) - 1
            yield first, xxh64(b" ".join(words), begins[low], ends[high] - begins[low], seed), bounds
            first, words, counts = at + 1, [], []


def majorities(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text the bits that over half of its hashes have; zero for one without hashes."""
    sizes = np.diff(bounds)
    counts, owner = np.zeros((len(sizes), 64), np.int64), np.repeat(np.arange(len(sizes)), sizes)
    for i in range(0, len(hashes), BIT_ROWS):
        part, own = hashes[i : i + BIT_ROWS], owner[i : i + BIT_ROWS]
        bits = np.unpackbits(part.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        counts[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes ascending and once each, and their bounds."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))[: len(hashes)]
    return hashes[new], np.append(0, np.cumsum(np.bincount(owner[new], minlength=len(bounds) - 1)))
