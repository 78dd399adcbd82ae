"""Exact Jaccard join of shingle sets in the metric space of the Jaccard distance d = 1 - |x&y| / |x|y||.

Two texts link if 100 |x&y| >= 75 |x|y|, that is d <= 1/4. Nearly all pairs of texts are at distance
1 and so at distance 1 from any few documents picked as pivots: Voronoi cells of such pivots would
hold everything at once. The join therefore goes from coarse pivots to fine ones; each step keeps
every link, by a bound that the triangle inequality gives.

1. Singleton pivots, support. A linked pair shares at least ceil(3/4 |x|) shingles, so a text can
   only have a partner if that many of its shingles occur in some other text. One shuffle of
   truncated shingle hashes, in regions of the hash space, counts them; truncation only adds to the
   count. About a tenth of the texts are left; the others are alone.
2. Singleton pivots, windows. The distance to the pivot {s} is 1 - 1/|x| for each s in x: ties, which
   a fixed order of shingles breaks. As |x \\ y| <= |x| - ceil(3/4 |x|), one of the first
   |x| - ceil(3/4 |x|) + 1 pivots of x is shared with each partner, and is in its window as well.
   Very frequent shingles come last in that order; their list has a proven bound.
3. Document pivots. The texts that meet at a shingle choose the least of them as their pivot. A text
   belongs to the Voronoi region of that document, and is replicated to the regions of the other
   documents whose windows it is in. In a region of more than REGION texts each text first meets the
   pivot alone. The least pivot that is near enough is the text's home: texts of one home all link
   (for components, those within 1/4 of it link to it; for numbers of links, those that differ from it
   by so little, about 1/8, that any two of them link), so they aren't compared. The others are cut into shares, and meet each other and the
   texts at home in tiles. A group of near copies so goes to as many rows as it has texts.
4. Recursion. Within a region (or tile) the longest text left is the pivot p. Texts within 1/4 link
   to it. Those within 1/2 are the boundary: each may also link to texts within 1/4, but only to
   those i with |d(w,p) - d(i,p)| <= 1/4. Texts beyond 1/2 can't. The rest, boundary included, is
   joined by the next pivot. What is compared is compared exactly, on whole sets.

For components, links that connect are enough. For numbers of links every pair that links is found:
two texts near one pivot link uncompared if d(i,p) + d(j,p) <= 1/4, and are compared otherwise. A pair
that meets in many regions or tiles counts in one: the region of its least common centre. Pairs of one
home are counted by what the home holds. Only sums leave a tile, so rows don't grow with the pairs.

Texts of one set are one point: they are linked without being compared, and count once in every step
(as many partners as they are, in the numbers of links).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shared import NON_SPACE, materialize, mix, release, text_buffer, tidy, token_hashes

#: Link if DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
REGIONS, SUPPORT_TOKENS, REGION, PACK_TOKENS, BROADCAST_ROWS = 64, 4_000_000, 512, 1_500_000, 1_000_000
#: Up to so many pairs are compared one by one; more by matrices of so many columns at a time.
PAIRWISE, COLUMNS = 32, 4096
#: A shingle is frequent if it is in this share of the texts; at most (mean set size) / FREQUENT are.
FREQUENT = 1 / 1000
_SALT = np.uint64(0x2545F4914F6CDD1D)


def least_shared(n):
    """The fewest shingles that a set of n shares with a linked one: ceil(NUM / DEN * n)."""
    return -(-n * NUM // DEN)


def shingle_sets(column, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in a string column, one after another, and their numbers.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. A text of fewer than k
    words has its whole sequence as one shingle; without words, or null, it has none.
    """
    raw, offsets = text_buffer(column)
    words, counts = token_hashes(raw, offsets, NON_SPACE)
    if not len(words):
        return np.empty(0, np.uint64), np.zeros(len(counts), np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    whole = np.zeros(len(words), np.uint64)
    factor = mix(np.arange(1, k + 1, dtype=np.uint64) * _SALT) | np.uint64(1)
    span = max(0, len(words) - k + 1)
    for i in range(k):
        whole[:span] += words[i : i + span] * factor[i]
    for c in range(1, k):
        at = first[:-1][counts == c]
        if len(at):
            whole[at] = sum((words[at + i] * factor[i] for i in range(c)), np.full(len(at), np.uint64(c) * _SALT))
    keep = np.repeat(first[:-1] + made, counts) > np.arange(len(words))
    flat = mix(whole[keep])
    ends = np.cumsum(made)
    for lo, hi in zip(ends - made, ends, strict=True):
        flat[lo:hi].sort()
    fresh = np.ones(len(flat), bool)
    fresh[1:] = flat[1:] != flat[:-1]
    fresh[(ends - made)[made > 0]] = True
    total = np.concatenate([[0], np.cumsum(fresh)])
    return flat[fresh], total[ends] - total[ends - made]


def entities(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; equal sets have equal names."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat ^ _SALT))])
    ends = np.cumsum(sizes)
    return mix((total[ends] - total[ends - sizes]) ^ (sizes.astype(np.uint64) * _SALT)).view(np.int64)


def _sized(batches, k: int):
    """(batch part, flat, sizes) for parts of at most about PACK_TOKENS words."""
    for batch in batches:
        raw, offsets = text_buffer(batch.column(1))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + 6 * PACK_TOKENS, "right")) - 1)
            part = batch.slice(lo, hi - lo)
            yield part, *shingle_sets(part.column(1), k)
            lo = hi


def _named(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """doc_id, n_shingles, entity for each row."""

    def name(batches):
        for part, flat, sizes in _sized(batches, k):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(entities(flat, sizes))], ["doc_id", "n_shingles", "entity"])

    return docs.select(id_col, text_col).mapInArrow(tidy(name), f"doc_id {dict(docs.dtypes)[id_col]}, n_shingles long, entity long")


def _supported(docs: DataFrame, text_col: str, k: int, tokens: int, texts: int) -> tuple[DataFrame, DataFrame, int]:
    """(entity, support): how many of a set's shingles another set has as well; (frequent): the very frequent ones, truncated; and the number of regions.

    A region of the hash space gets, from each batch, 24 bits of every shingle that falls in it. The
    number of regions follows the shingles alone, so a region's work is the same at any size.
    """
    regions = max(REGIONS, -(-tokens // SUPPORT_TOKENS))
    often = max(64, int(texts * FREQUENT))

    def deal(batches):
        for part, flat, sizes in _sized(batches, k):
            entity, first = np.unique(entities(flat, sizes), return_index=True)
            once = np.zeros(len(sizes), bool)
            once[first] = True
            owner = np.repeat(np.arange(len(sizes)), sizes)
            mine = once[owner]
            flat, owner = flat[mine], owner[mine]
            names = entities_by_row(entity, first, len(sizes))
            region = region_of(flat, regions)
            order = np.argsort(region.astype(np.uint16) if regions < 65536 else region, kind="stable")
            region, owner, short = region[order], owner[order], (flat[order] & np.uint64(0xFFFFFF)).astype("<u4")
            packed = short.view(np.uint8).reshape(-1, 4)[:, :3]
            edge = np.flatnonzero(np.concatenate([[True], (region[1:] != region[:-1]) | (owner[1:] != owner[:-1])])) if len(region) else np.empty(0, np.int64)
            runs = np.diff(np.append(edge, len(region))).astype("<u4")
            ids = names[owner[edge]]
            cut = np.flatnonzero(np.concatenate([[True], region[edge][1:] != region[edge][:-1]])) if len(edge) else np.empty(0, np.int64)
            stop = np.append(cut[1:], len(edge))[: len(cut)]
            out = {"region": [], "ids": [], "runs": [], "short": []}
            for lo, hi in zip(cut, stop, strict=True):
                end = edge[hi] if hi < len(edge) else len(region)
                out["region"].append(int(region[edge[lo]]))
                out["ids"].append(ids[lo:hi].tobytes())
                out["runs"].append(runs[lo:hi].astype("<u2").tobytes() if runs[lo:hi].max() < 65536 else b"w" + runs[lo:hi].tobytes())
                out["short"].append(np.ascontiguousarray(packed[edge[lo] : end]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["region"], pa.int32()), *(pa.array(out[x], pa.binary()) for x in ("ids", "runs", "short"))], list(out))

    def count(part: pa.Table) -> pa.Table:
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in part.column("ids").to_pylist()])
        runs = np.concatenate([np.frombuffer(x, "<u2").astype(np.int64) if len(x) % 2 == 0 else np.frombuffer(x, "<u4", offset=1).astype(np.int64) for x in part.column("runs").to_pylist()])
        three = np.frombuffer(b"".join(part.column("short").to_pylist()), np.uint8).reshape(-1, 3).astype(np.uint32)
        short = three[:, 0] | three[:, 1] << np.uint32(8) | three[:, 2] << np.uint32(16)
        _, first = np.unique(ids, return_index=True)
        once = np.zeros(len(ids), bool)
        once[first] = True
        short, ids, runs = short[np.repeat(once, runs)], ids[once], runs[once]
        found = np.zeros(1 << 24, np.uint32)  # half of what bincount takes
        np.add.at(found, short, np.uint32(1))
        shared = (found[short] > 1).astype(np.int64)
        support = np.add.reduceat(shared, np.cumsum(runs) - runs)
        hot = np.flatnonzero(found >= often)
        often_found = found[hot]
        n = len(ids) + len(hot)
        pad = lambda x, size, front: np.concatenate([np.zeros(front, np.int64), x, np.zeros(size - front - len(x), np.int64)])
        keep = pad(support, n, 0) > 0
        keep[len(ids) :] = True
        region = part.column("region")[0].as_py()
        del three, short, found, shared
        release()
        return pa.table({"entity": pad(ids, n, 0)[keep], "support": pad(support, n, 0)[keep], "frequent": pad(hot * regions + region, n, len(ids))[keep], "n": pad(often_found, n, len(ids))[keep]})

    dealt = docs.select(F.lit(0).alias("unused"), text_col).mapInArrow(tidy(deal), "region int, ids binary, runs binary, short binary")
    counted = materialize(dealt.groupBy("region").applyInArrow(count, "entity long, support long, frequent long, n long"), "support")
    support = counted.filter("support > 0").groupBy("entity").agg(F.sum("support").alias("support"))
    return support, counted.filter("n > 0").select("frequent"), regions


def entities_by_row(entity: np.ndarray, first: np.ndarray, rows: int) -> np.ndarray:
    names = np.zeros(rows, np.int64)
    names[first] = entity
    return names


def region_of(flat: np.ndarray, regions: int) -> np.ndarray:
    return ((flat >> np.uint64(24)) % np.uint64(regions)).astype(np.int64)


def _sets(docs: DataFrame, id_col: str, text_col: str, k: int, frequent: np.ndarray, regions: int) -> DataFrame:
    """entity, n, items (all shingles, sorted), window (the first pivots in the order of step 2)."""

    def build(batches):
        for part, flat, sizes in _sized(batches, k):
            late = np.isin((flat & np.uint64(0xFFFFFF)).astype(np.int64) * regions + region_of(flat, regions), frequent)
            signed, windows = flat.view(np.int64), []
            ends = np.cumsum(sizes)
            for n, hi in zip(sizes.tolist(), ends.tolist(), strict=True):
                lo, take = hi - n, n - least_shared(n) + 1
                rare = signed[lo:hi][~late[lo:hi]][:take]
                windows.append(rare if len(rare) == take else np.concatenate([rare, signed[lo:hi][late[lo:hi]][: take - len(rare)]]))
            lengths = np.concatenate([[0], np.cumsum([len(w) for w in windows])]).astype(np.int32)
            window = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(windows) if windows else np.empty(0, np.int64)))
            items = pa.array([flat[hi - n : hi].tobytes() for n, hi in zip(sizes, ends, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(entities(flat, sizes)), pa.array(sizes), items, window], ["entity", "n", "items", "window"])

    return docs.select(id_col, text_col).mapInArrow(tidy(build), "entity long, n long, items binary, window array<long>")


def ball_join(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between the sets (sorted, not empty) that connect all that links connect: step 4."""
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links: list[tuple[int, int]] = []

    def link(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            links.append((i, j))

    sizes = np.array([len(s) for s in sets])
    left = np.argsort(-sizes, kind="stable")
    flat, at = np.concatenate([sets[i] for i in left]), np.concatenate([[0], np.cumsum(sizes[left])[:-1]])
    while len(left) > 1:
        pivot, n = sets[left[0]], sizes[left]
        inter = _overlap(pivot, flat, at)
        union = n + n[0] - inter
        near = DEN * inter >= NUM * union
        edge = ~near & (2 * inter >= union)
        for j in left[near][1:]:
            link(left[0], j)
        if edge.any() and near.sum() > 1:
            gap = 1 - inter / union
            inner = np.flatnonzero(near)[1:]
            for w in np.flatnonzero(edge):
                close = inner[np.abs(gap[w] - gap[inner]) <= 1 - NUM / DEN + 1e-9]
                close = close[(DEN * np.minimum(n[close], n[w]) >= NUM * np.maximum(n[close], n[w]))]
                for i in close:  # the inner texts are one component already: one link is enough
                    if find(left[w]) == find(left[i]):
                        break
                    both = _pair(sets[left[w]], sets[left[i]])
                    if DEN * both >= NUM * (n[w] + n[i] - both):
                        link(left[w], left[i])
                        break
        rest = ~near
        if not rest.any():
            break
        flat, left = flat[np.repeat(rest, n)], left[rest]
        at = np.concatenate([[0], np.cumsum(sizes[left])[:-1]])
        # Of texts that a single component holds, no further link is needed.
        if len({find(int(i)) for i in left}) == 1:
            break
    return links


def ball_pairs(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All links between the sets (sorted, not empty), each once: step 4 without a stop at the first link."""
    sizes, reach = np.array([len(s) for s in sets]), 1 - NUM / DEN
    left = np.argsort(-sizes, kind="stable")
    first, second = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(left) > 1:
        n = sizes[left]
        inter = _overlap(sets[left[0]], np.concatenate([sets[i] for i in left]), np.concatenate([[0], np.cumsum(n)[:-1]]))
        union = n + n[0] - inter
        near = DEN * inter >= NUM * union
        inner, edge = np.flatnonzero(near)[1:], np.flatnonzero(~near & (2 * inter >= union))
        first.append(np.full(len(inner), left[0]))
        second.append(left[inner])
        if len(inner):
            others, gap = np.concatenate([inner, edge]), 1 - inter / union
            later = np.arange(len(inner))[:, None] < np.arange(len(others))
            a, b = gap[inner][:, None], gap[others]
            sure = later & (a + b <= reach - 1e-9)
            fits = DEN * np.minimum(n[inner][:, None], n[others]) >= NUM * np.maximum(n[inner][:, None], n[others])
            i, j = np.nonzero(later & ~sure & fits & (np.abs(a - b) <= reach + 1e-9))
            both = _shared([sets[x] for x in left[others]], i, j)
            linked = DEN * both >= NUM * (n[inner[i]] + n[others[j]] - both)
            for i, j in (np.nonzero(sure), (i[linked], j[linked])):
                first.append(left[inner[i]])
                second.append(left[others[j]])
        left = left[~near]
    return np.concatenate(first), np.concatenate(second)


def _shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many items sets i[k] and j[k] share: pair by pair, or by products of incidence matrices if there are many pairs."""
    if len(i) <= PAIRWISE:
        return np.array([_pair(sets[a], sets[b]) if len(sets[a]) and len(sets[b]) else 0 for a, b in zip(i, j, strict=True)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    known = times[column] > 1
    column, owner = (np.cumsum(times > 1) - 1)[column[known]], owner[known]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        at = slice(*np.searchsorted(column, [lo, lo + COLUMNS]))
        marks = np.zeros((len(sets), COLUMNS), np.float32)
        marks[owner[at], column[at] - lo] = 1
        both += marks @ marks.T
    return both[i, j].astype(np.int64)


def _overlap(pivot: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    spot = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
    return np.add.reduceat((pivot[spot] == flat).astype(np.int64), at)


def _pair(a: np.ndarray, b: np.ndarray) -> int:
    small, large = (a, b) if len(a) < len(b) else (b, a)
    return int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())


def _homes(sets: DataFrame, big: DataFrame, counted: bool) -> DataFrame:
    """(entity, home): the least centre of a big region (centre, entity, g) that the text is near enough to. One row for each text and region moves."""

    def at_home(pivot: int, own: int, both: int) -> bool:
        if not counted:
            return DEN * both >= NUM * (pivot + own - both)
        # x and y share at least |p| - |p - x| - |p - y|, and their union has at most |p| + |x - p| + |y - p|.
        return 2 * (DEN * (pivot - both) + NUM * (own - both)) <= (DEN - NUM) * pivot

    mine = F.pmod(F.xxhash64("entity", "centre"), F.col("g"))
    rows = big.select("centre", mine.alias("share"), F.lit(1).alias("no"), "entity")
    heads = big.select("centre", "g").distinct().select("centre", F.explode(F.expr("sequence(0L, g - 1)")).alias("share"), F.lit(0).alias("no"), F.col("centre").alias("entity"))
    ordered = rows.unionByName(heads).join(sets.select("entity", "items"), "entity").repartition("centre", "share").sortWithinPartitions("centre", "share", "no")

    def meet(batches):
        head = None
        for batch in batches:
            out = []
            for centre, no, entity, data in zip(*(batch.column(x) for x in ("centre", "no", "entity", "items")), strict=True):
                own = np.frombuffer(data.as_py(), np.uint64)
                if no.as_py() == 0:
                    head = own
                    continue
                if at_home(len(head), len(own), _pair(head, own)):
                    out.append((entity.as_py(), centre.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["entity", "home"])

    near = ordered.select("centre", "no", "entity", "items").mapInArrow(tidy(meet), "entity long, home long")
    return near.groupBy("entity").agg(F.min("home").alias("home"))


def _links(sets: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(a, b, n): links between entities, which connect all that links connect, with n = 0.

    With `rows` (entity, rows) also (a, null, n): parts of the number of rows that the rows of a link to.
    """
    window = sets.select("entity", F.explode("window").alias("pivot"))
    centre = window.groupBy("pivot").agg(F.min("entity").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    members = materialize(window.join(centre, "pivot").select("centre", "entity").distinct(), "regions")
    half = REGION // 2
    large = members.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > REGION)
    large = materialize(large.withColumn("g", F.ceil(F.col("n") / half).cast("long")), "large")
    plain = members.withColumn("home", F.lit(None).cast("long"))
    own = None
    if not large.isEmpty():
        homes = materialize(_homes(sets, members.join(large, "centre"), rows is not None), "homes")
        plain = members.join(homes, "entity", "left")
        own = homes
    mine = F.pmod(F.xxhash64("entity", "centre"), F.greatest(F.lit(1).cast("long"), F.col("g")))
    away = F.col("home").isNull() | (F.col("home") != F.col("centre"))
    # Shares of a region: first those of the texts that aren't at home (out), then those of the others (g - out).
    outside = plain.join(large.select("centre"), "centre", "left_semi").filter(away).groupBy("centre").agg(F.count(F.lit(1)).alias("m"))
    sized = large.join(outside, "centre", "left").select("centre", F.ceil(F.coalesce("m", F.lit(0)) / half).cast("long").alias("out"), F.ceil((F.col("n") - F.coalesce("m", F.lit(0))) / half).cast("long").alias("inn"))
    shared = plain.join(sized, "centre", "left").withColumn("g", F.when(away, F.col("out")).otherwise(F.col("inn")))
    shared = shared.withColumn("mine", F.when(F.col("out").isNull(), 0).when(away, mine).otherwise(F.col("out") + mine)).select("centre", "entity", "home", "out", "inn", "mine", away.alias("away"))
    # A text that isn't at home meets all shares, one at home those of the others.
    others = F.when(F.col("out").isNull(), F.array(F.lit(0).cast("long"))).when(F.col("out") == 0, F.array().cast("array<long>")).when(F.col("away"), F.expr("sequence(0L, out + inn - 1)")).otherwise(F.expr("sequence(0L, out - 1)"))
    dealt = shared.withColumn("other", F.explode(others))
    alone = (F.col("out") == 1) & (F.col("inn") == 0)
    tiles = dealt.filter(F.col("out").isNull() | alone | (F.col("mine") != F.col("other"))).select("entity", "centre", "home", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    full = tiles.join(sets.select("entity", "items"), "entity")
    carried, joined = ["entity", "items"], _joined
    if rows is not None:
        lists = members.groupBy("entity").agg(F.sort_array(F.collect_list("centre")).alias("centres")).join(rows, "entity")
        full, carried, joined = full.join(lists, "entity"), ["entity", "items", "mine", "rows", "home", "centres"], _counted

    def join(batches):
        key, held = None, []
        for batch in batches:
            keys = zip(*(batch.column(x).to_pylist() for x in ("centre", "i", "j")), strict=True)
            for new, *row in zip(keys, *(batch.column(x) for x in carried), strict=True):
                if new != key and held:
                    yield from joined(key, held)
                    held = []
                key = new
                held.append((row[0].as_py(), np.frombuffer(row[1].as_py(), np.uint64), *(x.as_py() for x in row[2:5]), *(np.asarray(x.values) for x in row[5:])))
        if held:
            yield from joined(key, held)

    # Sorted, a region's rows follow each other: a task holds one region at a time.
    ordered = full.repartition("centre", "i", "j").sortWithinPartitions("centre", "i", "j")
    found = ordered.select("centre", "i", "j", *carried).mapInArrow(tidy(join), "a long, b long, n long")
    if own is None:
        return found
    found = found.unionByName(own.filter("entity <> home").select(F.col("entity").alias("a"), F.col("home").alias("b"), F.lit(0).cast("long").alias("n")))
    if rows is None:
        return found
    held = own.join(rows, "entity")
    total = held.groupBy("home").agg(F.sum("rows").alias("total"))
    return found.unionByName(held.join(total, "home").filter("total > rows").select(F.col("entity").alias("a"), F.lit(None).cast("long").alias("b"), (F.col("total") - F.col("rows")).alias("n")))


def _batch(a, b, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])


def _joined(key: tuple, held: list[tuple]):
    found = ball_join([x[1] for x in held]) if len(held) > 1 else []
    if found:
        yield _batch([held[i][0] for i, _ in found], [held[j][0] for _, j in found], [0] * len(found))


def _counted(key: tuple, held: list[tuple]):
    """Of the pairs of a tile that link, those that no other tile or region has to count."""
    if len(held) < 2:
        return
    (centre, low, high), (names, items, mine, rows, homes, centres) = key, zip(*held, strict=True)
    names, mine, rows = np.array(names, np.int64), np.array(mine, np.int64), np.array(rows, np.int64)
    settled, home = np.array([x is not None for x in homes]), np.array([x or 0 for x in homes], np.int64)
    i, j = ball_pairs(list(items))
    # Texts of one home are counted there.
    apart = ~(settled[i] & settled[j] & (home[i] == home[j]))
    i, j = i[apart], j[apart]
    # Texts of one share of a region meet in each of the share's tiles, and count in the first.
    here = (mine[i] != mine[j]) | (low == high) | ((low == 0) & (high == np.where(mine[i] == 0, 1, mine[i])))
    i, j = i[here], j[here]
    alone = _shared([c[c < centre] for c in centres], i, j) == 0
    i, j = i[alone], j[alone]
    if not len(i):
        return
    n = np.zeros(len(names), np.int64)
    np.add.at(n, i, rows[j])
    np.add.at(n, j, rows[i])
    label, before = np.arange(len(names)), None
    while not np.array_equal(label, before):
        before, least = label.copy(), np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
    far, some = np.flatnonzero(label != np.arange(len(names))), np.flatnonzero(n)
    yield _batch(names[far], names[label[far]], np.zeros(len(far), np.int64))
    yield _batch(names[some], [None] * len(some), n[some])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id (the least id that links reach).

    Texts without words (null ones too) have no shingles and are alone. Texts of equal sets, repeated
    rows among them, are linked. A null id is never the least unless all ids of a component are null.
    No rows give no rows; other columns of `docs` are not read.
    """
    return _joined_rows(docs, id_col, text_col, k, False)


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """`jaccard_components` with n_links: how many other rows a row's text links to, those of equal sets included."""
    return _joined_rows(docs, id_col, text_col, k, True)


def _joined_rows(docs: DataFrame, id_col: str, text_col: str, k: int, counted: bool) -> DataFrame:
    named = materialize(_named(docs, id_col, text_col, k), "shingles")
    classes = named.filter("n_shingles > 0").groupBy("entity").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("rows"))
    classes = materialize(classes, "classes")
    tokens, texts = classes.agg(F.sum("n"), F.count(F.lit(1))).first()
    nodes = None
    if texts:
        support, frequent, regions = _supported(docs, text_col, k, tokens, texts)
        able = classes.join(support, "entity").filter(F.col("support") >= F.ceil(F.col("n") * NUM / DEN)).select("entity", "least", "rows")
        able = materialize(able, "able")
        hot = np.array(sorted(r[0] for r in frequent.collect()), np.int64)
        chosen = named.select("doc_id", "entity").join(able.drop("rows"), "entity").filter(F.col("doc_id").eqNullSafe(F.col("least"))).select(F.col("doc_id").alias("__tessera_able")).distinct()
        small = able.count() <= BROADCAST_ROWS
        picked = docs.join(F.broadcast(chosen) if small else chosen, docs[id_col].eqNullSafe(chosen["__tessera_able"]), "left_semi")
        sets = materialize(_sets(picked, id_col, text_col, k, hot, regions).dropDuplicates(["entity"]), "sets")
        found = _links(sets, able.select("entity", "rows") if counted else None)
        found = materialize(found, "links") if counted else found
        linked = components(found.filter("n = 0").select("a", "b"))
        # From the least entity of a component to the least document.
        named_nodes = linked.join(classes.select(F.col("entity").alias("node"), "least"), "node")
        least = named_nodes.groupBy("component").agg(F.min("least").alias("component_id"))
        nodes = linked.join(least, "component").select(F.col("node").alias("entity"), F.col("component_id").alias("linked_id"))
        if counted:
            nodes = nodes.join(found.filter("n > 0").groupBy(F.col("a").alias("entity")).agg(F.sum("n").alias("n")), "entity", "left")
        nodes = materialize(nodes if counted else nodes.withColumn("n", F.lit(0)), "nodes")
    owners = classes.withColumns({"linked_id": F.lit(None), "more": F.lit(0)}) if nodes is None else classes.join(nodes.withColumnRenamed("n", "more"), "entity", "left")
    owners = owners.select("entity", F.coalesce("linked_id", "least").alias("component_id"), (F.col("rows") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    grown = named.join(owners.withColumnRenamed("entity", "owner"), (F.col("entity") == F.col("owner")) & (F.col("n_shingles") > 0), "left")
    out = grown.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out if counted else out.drop("n_links")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """The rows of `docs` whose id is the least of their component, with all their columns; rows without shingles stay.

    Rows of one id are kept or dropped together, and kept if any of them is the least: repeated rows
    are for exact dedup. One shuffle of the texts at most.
    """
    found = jaccard_components(docs, id_col, text_col, k)
    least = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = found.groupBy("doc_id").agg(least.alias("least")).filter("NOT least").select(F.col("doc_id").alias("__tessera_gone"))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__tessera_gone"]), "left_anti")
