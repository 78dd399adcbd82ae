"""Static binary-fuse filters (Graf and Lemire, 2022), built and probed with numpy.

Three-wise, 8-bit fingerprints: about nine bits a key and one false positive in 256 probes, never a
false negative. A filter is immutable; its bytes hold the seed, the layout and the fingerprints.
"""

from __future__ import annotations

import math

import numpy as np

from tessera.llm.shared import mix

_HEAD = 4  # 64-bit words before the fingerprints: seed, segment length, segment count, number of keys


def _places(keys: np.ndarray, seed: int, seg: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h = mix(keys + np.uint64(seed))
    a = ((h >> np.uint64(32)) * np.uint64(seg * count)) >> np.uint64(32)
    mask = np.uint64(seg - 1)
    b = (a + np.uint64(seg)) ^ ((h >> np.uint64(18)) & mask)
    c = (a + np.uint64(2 * seg)) ^ (h & mask)
    return a.astype(np.int64), b.astype(np.int64), c.astype(np.int64), (h ^ (h >> np.uint64(32))).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """The filter of a set of 64-bit keys; repeated keys count once, no keys give a filter that holds nothing."""
    keys = np.unique(np.asarray(keys, np.uint64))
    n = len(keys)
    if not n:
        return np.zeros(_HEAD, np.uint64).tobytes()
    seg = 1 << max(2, min(18, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25))))
    room = int(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))) + 8
    for attempt in range(200):
        count = max(1, -(-room // seg) - 2)
        seed = (0x9E3779B97F4A7C15 * (attempt + 1)) % 2**63
        order = _peel(keys, seed, seg, count)
        if order is not None:
            table = _assign(keys, seed, seg, count, order)
            return np.array([seed, seg, count, n], np.uint64).tobytes() + table.tobytes()
        room += room // 16 if attempt % 10 == 9 else 0
    raise RuntimeError("no seed peels these keys")


def _peel(keys, seed, seg, count):
    """Rounds of (key number, own slot); None if the keys can't be peeled under this seed."""
    at = np.stack(_places(keys, seed, seg, count)[:3])
    size = seg * (count + 2)
    load = np.bincount(at.ravel(), minlength=size)
    held = np.zeros(size, np.int64)
    for row in at:
        np.bitwise_xor.at(held, row, np.arange(len(keys)))
    rounds, done = [], 0
    front = np.flatnonzero(load == 1)
    while len(front):
        who, first = np.unique(held[front], return_index=True)
        rounds.append((who, front[first]))
        done += len(who)
        touched = at[:, who]
        np.subtract.at(load, touched.ravel(), 1)
        np.bitwise_xor.at(held, touched.ravel(), np.tile(who, 3))
        near = np.unique(touched)
        front = near[load[near] == 1]
    return rounds if done == len(keys) else None


def _assign(keys, seed, seg, count, rounds):
    a, b, c, mark = _places(keys, seed, seg, count)
    table = np.zeros(seg * (count + 2), np.uint8)
    for who, own in reversed(rounds):
        table[own] = 0
        table[own] = mark[who] ^ table[a[who]] ^ table[b[who]] ^ table[c[who]]
    return table


def contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """For each key, whether it may be in the filter; always true for those it was built from."""
    seed, seg, count, n = (int(x) for x in np.frombuffer(blob, np.uint64, _HEAD))
    if not n:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(blob, np.uint8, offset=8 * _HEAD)
    a, b, c, mark = _places(np.asarray(keys, np.uint64), seed, seg, count)
    return (table[a] ^ table[b] ^ table[c]) == mark
