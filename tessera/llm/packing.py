"""Packing token sequences: Martello-Toth dominance reduction, then best fit for the remainder.

The instance is the histogram of piece lengths, at most `capacity` numbers whatever the input, so the
driver solves it whole. Equal pieces are interchangeable: the plan is a list of (pattern of lengths,
how often), and a piece's place follows from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import materialize, text_buffer, tidy

CACHE_WORDS, CACHE_BYTES, PART_BYTES = 300_000, 48, 4 << 20
RANK_ROWS = 50_000
_END = (0).to_bytes(4, "little")


def starts_visible(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether characters that start at `at` are surely no white space: those whose first byte is C2 or E1 to E3 may be."""
    byte = raw[at]
    return (byte > 32) & (byte != 0xC2) & ((byte < 0xE1) | (byte > 0xE3))


def ends_visible(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same of characters that end at `at`."""
    byte, two, three = raw[at], raw[np.maximum(at - 1, 0)], raw[np.maximum(at - 2, 0)]
    return (byte > 32) & ((byte < 0x80) | (two != 0xC2) & ((three < 0xE1) | (three > 0xE3)))


def word_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts can be cut so that their parts have the ids of the whole: at their starts, and at spaces between two visible characters.

    There the byte-level splitting pattern always begins a new word.
    """
    opens = np.zeros(len(raw), bool)
    opens[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    at = np.flatnonzero(raw == 32)
    at = at[(at > 0) & (at < len(raw) - 1)]
    opens[at[starts_visible(raw, at + 1) & ends_visible(raw, at - 1)]] = True
    return np.flatnonzero(opens)


def byte_ranks(path: str) -> tuple[dict[bytes, int], list[str]]:
    """Bytes and ids of a byte-level BPE's tokens, whose ids are in the order of the merges; and its special tokens."""
    import json

    with open(path, encoding="utf-8") as lines:
        told = json.load(lines)
    # Byte-level vocabularies write bytes that don't print as the characters from 256 on.
    printed = [b for b in range(256) if chr(b).isprintable() and b not in (32, 173)]
    byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printed)))}
    special = [x["content"] for x in told["added_tokens"]]
    return {bytes(byte[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}, special


class Encoder:
    """Ids of a byte-level BPE in a `tokenizers` file, as its `encode(text, add_special_tokens=False)` gives them.

    Texts are cut into words (word_starts) and each distinct word of a part is encoded once. Known
    words are looked up; the others are put together and encoded at once, by the same ranks. Words
    that could join with their neighbours, or that hold a special token, go to the tokenizer itself.
    Special tokens in a text have their own ids; with `special=False` they are ordinary text.
    """

    def __init__(self, path: str, pattern: str, special: bool = True):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.encode_special_tokens = not special
        ranks, names = byte_ranks(path)
        self.special = [x.encode() for x in names] if special else []
        self.plain = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)
        self.known, self.ids, self.ends = pa.array([], pa.large_binary()), np.empty(0, "<u4"), np.zeros(1, np.int64)

    def words(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after another, and where each word's end."""
        at, (raw, offsets) = np.arange(len(words)), text_buffer(words)
        size = np.diff(offsets)
        second = np.minimum(offsets[:-1] + 1, len(raw) - 1)
        apart = (size > 1) & (raw[offsets[:-1]] == 32) & starts_visible(raw, second) & ends_visible(raw, offsets[1:] - 1)
        whole = raw.tobytes()
        for name in self.special:
            found = whole.find(name)
            while found >= 0:
                apart[np.searchsorted(offsets, found, "right") - 1] = False
                found = whole.find(name, found + 1)
        joined = at[apart]
        ids = np.array(self.plain(text_buffer(words.take(pa.array(joined)))[0].tobytes().decode()), "<u4")
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(size[joined])) + 1
        rest = at[~apart]
        lone = [np.array(x.ids, "<u4") for x in self.coder.encode_batch([x.decode("utf-8", "replace") for x in words.take(pa.array(rest)).to_pylist()], add_special_tokens=False)]
        count = np.zeros(len(words), np.int64)
        count[joined], count[rest] = np.diff(ends, prepend=0), [len(x) for x in lone]
        begin = np.zeros(len(words), np.int64)
        begin[joined], begin[rest] = ends - count[joined], len(ids) + np.cumsum(count[rest]) - count[rest]
        return gathered(np.concatenate([ids, *lone]), begin, count), np.cumsum(count)

    def texts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin (and the last's end)."""
        starts = word_starts(raw, offsets)
        if not len(starts):
            return np.empty(0, "<u4"), np.zeros(len(offsets), np.int64)
        bounds = np.append(starts, len(raw))
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        distinct, of = words.dictionary, words.indices.to_numpy()
        spot = np.array(pc.fill_null(pc.index_in(distinct, value_set=self.known), -1), np.int64)
        lost = np.flatnonzero(spot < 0)
        fresh = distinct.take(pa.array(lost))
        more, ends = self.words(fresh) if len(lost) else (np.empty(0, "<u4"), np.empty(0, np.int64))
        flat = np.concatenate([self.ids, more])
        spot[lost] = len(self.ends) - 1 + np.arange(len(lost))
        every = np.concatenate([self.ends, len(self.ids) + ends])
        begin, count = every[spot], np.diff(every)[spot]
        ids = gathered(flat, begin[of], count[of])
        first = np.concatenate([[0], np.cumsum(count[of])])[np.searchsorted(starts, offsets)]
        # Words that recur are remembered; too many are forgotten at once.
        keep = np.flatnonzero((np.bincount(of, minlength=len(distinct))[lost] > 1) & (np.diff(text_buffer(fresh)[1]) <= CACHE_BYTES))[:CACHE_WORDS]
        if len(self.known) + len(keep) > CACHE_WORDS:
            self.known, self.ids, self.ends = self.known[:0], self.ids[:0], self.ends[:1]
        size = np.diff(ends, prepend=0)
        self.known = pa.concat_arrays([self.known, fresh.take(pa.array(keep))])
        self.ids = np.concatenate([self.ids, gathered(more, (ends - size)[keep], size[keep])])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size[keep])])
        return ids, first


def gathered(flat: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """flat[b:b + c] for each b and c, one after another."""
    ends = np.cumsum(count)
    return flat[np.repeat(begin - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]


_ENCODERS: dict[tuple[str, str, bool], Encoder] = {}


def encoder_of(path: str, pattern: str, special: bool = True) -> Encoder:
    """Built once in each Python worker."""
    if (path, pattern, special) not in _ENCODERS:
        _ENCODERS[path, pattern, special] = Encoder(path, pattern, special)
    return _ENCODERS[path, pattern, special]


def pieces(docs: DataFrame, tokenizer: str, pattern: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", special: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and an end id, cut only where longer than `capacity`.

    The first piece takes what the others, all of `capacity`, leave. A null text is empty: one piece
    that holds the end id. Texts are encoded in parts of about PART_BYTES; a longer text is one part.
    """

    def cut(batches):
        coder = encoder_of(tokenizer, pattern, special)
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PART_BYTES, "right")) - 1)
                ids, first = coder.texts(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield rows(batch.column(0).slice(lo, hi - lo), memoryview(np.ascontiguousarray(ids)).cast("B"), first)
                lo = hi

    def rows(names, ids, first):
        size = np.diff(first) + 1
        many = -(-size // capacity)
        at = np.repeat(np.arange(len(size)), many)
        piece = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        head = (size - 1) % capacity + 1
        start = np.where(piece > 0, head[at] + (piece - 1) * capacity, 0)
        length = np.where(piece > 0, capacity, head[at])
        low = first[at] + start
        high = np.minimum(low + length, first[at + 1])  # the end id isn't among the ids
        crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        for i in (np.cumsum(many) - 1).tolist():
            crc[i] = zlib.crc32(_END, crc[i])
        return pa.RecordBatch.from_arrays([names.take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(tidy(cut), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# ---- the plan, over the histogram


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Martello-Toth reduction: bins that some best solution contains, and the lengths left.

    For a piece j with room r beside it, among all pieces that aren't fixed: j stands alone if nothing
    fits; with k, the longest that fits, if k fills r, or no two more fit together, or at most two do
    and no pair that fits is longer than k; with k and r - k if at most two fit and no length lies
    between those two. Each of these sets dominates all others that j can be in. Pieces are tried
    longest first, again until nothing changes.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    sizes = sorted(left)
    fixed = []

    def take(pattern: tuple[int, ...]) -> None:
        need = {s: pattern.count(s) for s in pattern}
        times = min(left[s] // k for s, k in need.items())
        fixed.append((pattern, times))
        for s, k in need.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
                sizes.pop(bisect_left(sizes, s))

    def shortest(j: int, n: int) -> list[int]:
        """The n shortest pieces beside one of length j."""
        out: list[int] = []
        for s in sizes:
            out += [s] * min(n - len(out), left[s] - (s == j))
            if len(out) == n:
                break
        return out

    def dominating(j: int) -> tuple[int, ...] | None:
        room = capacity - j
        i = bisect_right(sizes, room) - 1
        if i >= 0 and left[sizes[i]] == (sizes[i] == j):
            i -= 1
        if i < 0:
            return (j,)
        k = sizes[i]
        two, three = shortest(j, 2), shortest(j, 3)
        if k == room or len(two) < 2 or sum(two) > room:
            return (j, k)
        if len(three) == 3 and sum(three) <= room:
            return None
        best = 0
        for b in sizes[: i + 1]:
            if 2 * b > room:
                break
            if left[b] == (b == j):
                continue
            p = bisect_right(sizes, room - b) - 1
            while p >= 0 and left[sizes[p]] - (sizes[p] == j) - (sizes[p] == b) <= 0:
                p -= 1
            if p >= 0:
                best = max(best, sizes[p] + b)
        if k >= best:
            return (j, k)
        b = room - k
        if left.get(b, 0) - (b == j) - (b == k) > 0 and bisect_right(sizes, min(b, k)) >= bisect_left(sizes, max(b, k)):
            return (j, k, b)
        return None

    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while j in left and (pattern := dominating(j)):
                take(pattern)
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, for all pieces of a length at a time: the fullest open bins that still hold it come first."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], times: int, room: int) -> None:
        if not room:
            done.append((pattern, times))
            return
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append((pattern, times))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                each = min(capacity // s, n)
                put((s,) * each, n // each, capacity - s * each)
                n -= n // each * each
                continue
            room = rooms[i]
            pattern, times = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(i)
            each = min(room // s, n)
            used = min(times, n // each)
            if used < times:
                put(pattern, times - used, room)
            put(pattern + (s,) * each, used, room - s * each)
            n -= used * each
    return done + [x for bins in open_bins.values() for x in bins]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def placements(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, sequence of the first rank, offset): within a range, sequences follow ranks."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for s in pattern:
            lo = ranks.get(s, 0)
            out.append((s, lo, lo + times - 1, sequence, offset))
            ranks[s] = lo + times
            offset += s
        sequence += times
    return out


def pack(cut: DataFrame, capacity: int) -> DataFrame:
    """`cut` (as of pieces(); must give the same rows whenever read) with sequence_id and offset.

    Ranks come from a window over (length, share), where the shares split each length by a hash of
    the piece, and from sums of the shares' counts, so a frequent length is in many tasks. Repeated
    rows have ranks of their own. The plan that is sent to the executors has a few rows for each
    length at most.
    """
    spark = cut.sparkSession
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-cut.count() // RANK_ROWS))
    shared = cut.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shares)).cast("int"))
    by_share = shared.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    before = by_share.select("length", "share", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = np.array(sorted(placements(plan(counts, capacity))), np.int64).reshape(-1, 5)
    own = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = shared.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "share"]).withColumn("rank", F.col("own") + F.col("before"))
    fields = ["doc_id", "piece", "start", "length", "ids_crc32"]
    limits = rows[:, 0].astype(object) * 2**44 + rows[:, 1]  # ranges by (length, first rank); ranks stay under 2**44
    firsts = limits.astype(np.int64)

    def place(batches):
        for batch in batches:
            rank = batch.column(5).to_numpy()
            at = np.searchsorted(firsts, batch.column(3).to_numpy() * 2**44 + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(rows[at, 3] + rank - rows[at, 1]), pa.array(rows[at, 4])], [*fields, "sequence_id", "offset"])

    kind = dict(cut.dtypes)["doc_id"]
    return ranked.select(*fields, "rank").mapInArrow(tidy(place), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", special: bool = True) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. `tokenizer` is a file of byte-level BPE, `pattern` how it splits texts.

    No documents give no rows. Repeated documents are packed as often as they occur. Other columns
    are not read.
    """
    return pack(materialize(pieces(docs, tokenizer, pattern, capacity, id_col, text_col, special), "pieces"), capacity)
