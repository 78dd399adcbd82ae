"""What the operators share: scratch tables, table reading and vectorised token hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_root, written as materialize  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(modulus: int, id_col: str = "doc_id"):
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def release() -> None:
    """Gives a Python worker's free memory back: workers live on between stages, and what they hold counts against their executor."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc
        pass


def tidy(run):
    """A function of Arrow batches that releases what it freed once it is through."""

    def through(batches):
        yield from run(batches)
        release()

    return through


# ---- vectorised token hashing over Arrow string buffers

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
CHUNK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; returns a new array."""
    h = h ^ (h >> _S33)
    h *= _M1
    h ^= h >> _S33
    h *= _M2
    h ^= h >> _S33
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "a" not in _POW or len(_POW["a"]) < n:
        size = max(n, CHUNK + 1)
        for key, base in (("a", _BASE), ("b", _BASE_INV)):
            run = np.full(size, np.uint64(base), dtype=np.uint64)
            run[0] = 1
            _POW[key] = np.cumprod(run)
    return _POW["a"][:n], _POW["b"][:n]


def byte_class(predicate) -> np.ndarray:
    return np.array([bool(predicate(b)) for b in range(256)])


#: Words are runs of anything but the six ASCII white-space characters.
NON_SPACE = byte_class(lambda b: b not in b" \t\n\x0b\x0c\r")
#: Words are runs of ASCII letters and of all non-ASCII characters.
LETTERS = byte_class(lambda b: b >= 128 or chr(b).isalpha())
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def ranges(raw: np.ndarray, offsets: np.ndarray, word: np.ndarray):
    """Ranges of at most about CHUNK bytes that end between documents or, in a long one, between words."""
    lo, end = 0, int(offsets[-1])
    while lo < end:
        hi = min(end, lo + CHUNK)
        if hi < end:
            at = int(offsets[np.searchsorted(offsets, hi, "right") - 1])
            if at > lo:
                hi = at
            else:
                last = int(offsets[np.searchsorted(offsets, lo, "right")])
                while hi < last:
                    gap = np.flatnonzero(~word[raw[hi : min(last, hi + CHUNK)]])
                    if len(gap):
                        hi += int(gap[0])
                        break
                    hi = min(last, hi + CHUNK)
        yield lo, hi
        lo = hi


def token_hashes(raw: np.ndarray, offsets: np.ndarray, word: np.ndarray, lower: bool = True, prefixes: tuple[int, ...] = ()):
    """64-bit hashes of every word in order, and the number of words of each document.

    Each hash depends on the word's bytes alone. With `prefixes`, also returns one array for each
    length, of hashes of the words' first so many bytes (of the whole word where it is shorter).
    """
    starts_all, out, heads = [], [], [[] for _ in prefixes]
    inner = offsets[1:-1]
    for lo, hi in ranges(raw, offsets, word):
        seg = raw[lo:hi]
        is_word = word[seg]
        edge = np.zeros(hi - lo + 1, bool)
        edge[inner[(inner >= lo) & (inner < hi)] - lo] = True
        edge[0] = edge[-1] = True
        left = is_word.copy()
        left[1:] &= ~is_word[:-1] | edge[1:-1]
        right = is_word.copy()
        right[:-1] &= ~is_word[1:] | edge[1:-1]
        first, last = np.flatnonzero(left), np.flatnonzero(right)
        pw, inv = _powers(hi - lo)
        vals = _BYTE[LOWER[seg] if lower else seg]
        vals *= pw
        run = np.cumsum(vals)
        base, scale = run[first] - vals[first], inv[first]
        out.append(mix((run[last] - base) * scale))
        for k, size in enumerate(prefixes):
            heads[k].append(mix((run[np.minimum(last, first + size - 1)] - base) * scale ^ np.uint64(size)))
        starts_all.append(first + lo)
    empty = np.empty(0, np.uint64)
    starts = np.concatenate(starts_all) if starts_all else np.empty(0, np.int64)
    counts = np.diff(np.searchsorted(starts, offsets))
    hashes = np.concatenate(out) if out else empty
    if not prefixes:
        return hashes, counts
    return hashes, counts, [np.concatenate(h) if h else empty for h in heads]
