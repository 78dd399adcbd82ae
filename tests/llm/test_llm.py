"""The llm operators against brute force, on small tables with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, exact_dedup, fingerprints, fuse_filter, html_extract, jaccard_join, language_id, mixing, packing, shared, token_counts, toxicity, warc
from tessera.llm.queries import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, digest string, n long, entity long, piece int, length long, id string, block int, parts string, next_text string, mix_epoch int, kept boolean"


def _rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = [rng.choice(words) for _ in range(200)]
    texts = [" ".join(base), None, "", "   \t\n", "One", "one", "a b c d", "A b  c\nd", "a b c d e", " ".join(base), " ".join(base[:195] + ["zz"] * 5), " ".join(base[20:])]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(30)]
    texts.append(" ".join(rng.choice(words) for _ in range(40_000)))
    texts.append("ünïcödé 😀 " * 9)
    rows = [(i * 3, t, "en" if i % 2 else "de", None if i == 4 else f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [rows[8], (rows[9][0], "another text with this id", "en", "s0"), (None, "a text without an id", None, "s1"), (None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *["x", 1, 2, 3, 4, "i", 5, "p", "q", 6, True]) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_hashes_do_not_depend_on_chunks(monkeypatch):
    texts = ["Ab ab", None, "", "  x\ty ", "é" * 50 + " é", "no-space" * 40]
    raw, off = shared.text_buffer(pa.array(texts))
    whole, counts, (heads,) = shared.token_hashes(raw, off, shared.NON_SPACE, prefixes=(2,))
    assert counts.tolist() == [2, 0, 0, 2, 2, 1] and whole[0] == whole[1] and heads[0] == heads[1]
    monkeypatch.setattr(shared, "CHUNK", 7)
    again, _, (again_heads,) = shared.token_hashes(raw, off, shared.NON_SPACE, prefixes=(2,))
    assert (again == whole).all() and (again_heads == heads).all()
    sliced, off2 = shared.text_buffer(pa.array(texts).slice(3, 2))
    assert (shared.token_hashes(sliced, off2, shared.NON_SPACE)[0] == whole[2:6]).all() or len(off2) == 3


def test_token_counts(spark, docs, none, rows):
    path = vocabulary_path("piece_bpe_32k.model")
    counter = token_counts.counter_of(path)
    tiny = token_counts.GreedyCounter(["▁a", "▁ab", "abc", "b", "bcd", "c", "cde"])
    for word in map("".join, itertools.product("abcdeé", repeat=4)):
        s, i, n = "▁" + word, 0, 0
        while i < len(s):
            hit = next((j for j in range(len(s), i, -1) if s[i:j] in {"▁a", "▁ab", "abc", "b", "bcd", "c", "cde"}), None)
            n, i = (n + 1, hit) if hit else (n + len(s[i].encode()), i + 1)
        assert tiny.word(word) == n, word
    got = sorted(map(tuple, token_counts.token_counts(docs, path).collect()), key=str)
    assert got == sorted(((r[0], len(r[1] or ""), len((r[1] or "").split()), sum(counter.word(w) for w in (r[1] or "").split())) for r in rows), key=str)
    assert token_counts.token_counts(none, path).count() == 0


def _sets(rows):
    out = []
    for _, text, *_ in rows:
        words = bytes(b + 32 if 65 <= b < 91 else b for b in (text or "").encode()).split()
        out.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    return out


def _components(rows):
    sets = _sets(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)]


def test_jaccard_join(spark, docs, none, rows):
    got = jaccard_join.jaccard_components(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(_components(rows), key=str)
    assert jaccard_join.jaccard_components(none).count() == 0
    kept = jaccard_join.representatives(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {c for _, _, c in _components(rows)}


def test_jaccard_join_with_small_regions(spark, monkeypatch):
    """Hot shingles and groups larger than a region: tiles find the same components."""
    rng = random.Random(3)
    hot = [f"h{i}" for i in range(60)]
    rows = []
    for i in range(160):
        words = hot + [f"x{rng.randint(0, 9)}" for _ in range(rng.randint(0, 30))] if i % 2 else [f"g{rng.randint(0, 2)}_{j}" if rng.random() < 0.04 else f"c{i % 6}_{j}" for j in range(90)]
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(jaccard_join, "REGION", 8)
    monkeypatch.setattr(jaccard_join, "REGIONS", 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard_join.jaccard_components(docs).collect()
    assert sorted(map(tuple, got)) == sorted(_components([(*r, None) for r in rows]))


def test_ball_join_connects_what_links():
    rng = np.random.default_rng(1)
    for _ in range(40):
        base = [np.unique(rng.integers(0, 10_000, 40)) for _ in range(4)]
        sets = [np.unique(np.where(rng.random(len(b)) < 0.12, rng.integers(0, 10_000, len(b)), b)).astype(np.uint64) for b in (base[int(rng.integers(4))] for _ in range(25))]
        links = {(i, j) for i, j in itertools.combinations(range(25), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
        found = jaccard_join.ball_join(sets)
        assert {tuple(sorted(map(int, x))) for x in found} <= links

        def parts(edges):
            root = list(range(25))
            find = lambda i: i if root[i] == i else find(root[i])
            for a, b in edges:
                root[find(int(a))] = find(int(b))
            return [find(i) == find(j) for i, j in itertools.combinations(range(25), 2)]

        assert parts(found) == parts(links)


def _links(rows):
    sets = _sets(rows)
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)
    return [(r[0], sum(linked(s, o) for o in sets) - bool(s)) for r, s in zip(rows, sets, strict=True)]


def test_ball_pairs_finds_every_link():
    rng = np.random.default_rng(2)
    for _ in range(20):
        base = [np.unique(rng.integers(0, 10_000, 40)) for _ in range(3)]
        sets = [np.unique(np.where(rng.random(len(b)) < 0.1, rng.integers(0, 10_000, len(b)), b)).astype(np.uint64) for b in (base[int(rng.integers(3))] for _ in range(30))]
        links = [(i, j) for i, j in itertools.combinations(range(30), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]
        found = [tuple(sorted(map(int, x))) for x in zip(*jaccard_join.ball_pairs(sets), strict=True)]
        assert sorted(found) == links


def test_jaccard_links_count_every_pair(spark, docs, rows, monkeypatch):
    got = jaccard_join.jaccard_links(docs)
    assert sorted([(r["doc_id"], r["n_links"]) for r in got.collect()], key=str) == sorted(_links(rows), key=str)
    rng = random.Random(4)
    near = [(i, " ".join(f"g{rng.randint(0, 2)}_{j}" if rng.random() < 0.02 else f"c{i % 3}_{j}" for j in range(90))) for i in range(90)]
    near += [(i + 90, near[i][1]) for i in range(0, 20, 2)]
    monkeypatch.setattr(jaccard_join, "REGION", 8)
    got = jaccard_join.jaccard_links(spark.createDataFrame(near, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r["doc_id"], r["n_links"]) for r in got) == sorted(_links(near))
    assert sorted(tuple(r)[:3] for r in got) == sorted(_components([(*r, None) for r in near]))


def test_near_copies_replicate_linearly(spark, monkeypatch):
    """Regions of many shares: a group's texts meet their home once, and few of them meet in tiles; the counts stay exact."""
    rng = random.Random(14)
    def edited(words, k):
        out = list(words)
        for at in rng.sample(range(len(out)), k):
            out[at] = f"e{rng.randint(0, 30)}"
        return " ".join(out)

    base = [[f"b{k}_{i}" for i in range(150)] for k in range(2)]
    texts = [edited(base[0], rng.choice([0, 1, 1, 2])) for _ in range(200)] + [edited(base[1], rng.choice([1, 2, 4, 6])) for _ in range(120)] + [edited(base[0][:75] + base[1][75:], 1) for _ in range(20)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(jaccard_join, "REGION", 16)
    made = {}
    real = jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, name="step": made.setdefault(name, real(df, name)))
    got = jaccard_join.jaccard_links(docs).collect()
    assert sorted((r["doc_id"], r["n_links"]) for r in got) == sorted(_links(rows))
    assert sorted(tuple(r)[:3] for r in got) == sorted(_components([(*r, None) for r in rows]))
    assert made["homes"].count() >= 100
    made.clear()
    assert sorted(map(tuple, jaccard_join.jaccard_components(docs).collect())) == sorted(_components([(*r, None) for r in rows]))
    assert made["homes"].count() >= 200


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 100), (200, 200)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def trained():
    return html_extract.trained()


def test_toxicity(spark, docs, none):
    rng = random.Random(2)
    calm = [f"calm{i}" for i in range(300)]
    texts = [(i, " ".join(rng.choices(calm, k=30) + (rng.choices(["grumbo", "snarfel", "idiot", "loser"], k=2) if i % 4 == 0 else []))) for i in range(600)]
    train = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 600)] + [(1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(train, labels, shared.fold_of(5) != 0)
    got = {r[0]: r[2] for r in toxicity.score(train, model).collect()}
    assert all(got[i] == int(i % 4 == 0) for i in range(600))
    assert {r[0] for r in toxicity.clean(train, model).select("doc_id").collect()} == {i for i in range(600) if i % 4}
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r[1] <= 1 and r[2] == int(r[1] >= 0.5) for r in scored)
    assert toxicity.clean(docs, model).columns == docs.columns and toxicity.score(none, model).count() == 0
    lone = toxicity.fit(none, labels.limit(0), F.lit(True))
    assert lone.scores(pa.array(["you idiot", "hello", None, ""])).round().tolist() == [1, 0, 0, 0]


def test_toxicity_training_gives_memory_back(spark, none, monkeypatch):
    freed = []
    monkeypatch.setattr(toxicity, "release", lambda: freed.append(1), raising=False)
    toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert freed == [1]


def test_toxicity_without_labels_of_both_kinds(spark, none):
    """The label model of the seed voters: it finds what stands beside no label."""
    rng = random.Random(2)
    calm = [f"calm{i}" for i in range(300)]
    texts = [(i, " ".join(rng.choices(calm, k=30) + (rng.choices(["idiot", "loser", "scum"], k=3) if i % 5 == 0 else []))) for i in range(300)] + [(7, None), (None, "an idiot")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for labels in ([], [(i, 0) for i in range(50)], [(0, 1), (5, 1)], [(0, None)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
        got = [(r[0], r[2]) for r in toxicity.score(docs, model).collect() if r[0] not in (None, 7)]
        assert all(p == int(i % 5 == 0) for i, p in got), labels
    assert toxicity.score(none, model).count() == 0


def test_label_model_agrees_with_enumeration():
    """Posteriors by the definition: for each row, both classes' probabilities of the votes, from rates that one more round of EM leaves as they are."""
    rng = np.random.default_rng(3)
    y = rng.random(400) < 0.3
    table = np.stack([np.where(rng.random(400) < 0.7, np.where(rng.random(400) < a, y, ~y), -1) for a in (0.9, 0.85, 0.8, 0.6)], 1).astype(np.int8)
    post, keep = toxicity.label_model(table, rounds=3000)
    usual = [[(table[:, v] == o).mean() + 1e-6 for o in (-1, 0, 1)] for v in range(4)]
    rate = [[[(sum(p if c else 1 - p for p, x in zip(post, table[:, v], strict=True) if x == o) + 2 * usual[v][k]) / (sum(post if c else 1 - post) + 2) for k, o in enumerate((-1, 0, 1))] for v in range(4)] for c in (0, 1)]
    for i in range(0, 400, 7):
        odds = post.mean() / (1 - post.mean())
        for v in range(4):
            o = table[i, v] + 1
            odds *= np.exp(np.clip(np.log(rate[1][v][o] / rate[0][v][o]), -toxicity.CERTAIN, toxicity.CERTAIN) * keep[v])
        assert post[i] == pytest.approx(odds / (1 + odds), abs=2e-3)


def test_scores_are_the_sum_of_the_terms_found(spark):
    """The query's score against its definition, word by word."""
    words = ["idiot", "loser", "calm", "Idiotic", "losers", "été"]
    known = sorted({int(h) for h in toxicity.features(pa.array(["idiot", "calm"]))[0]})
    weight = dict(zip(known, np.linspace(-1, 2, len(known)), strict=True))
    model = toxicity.Model.of(np.array(known, np.uint64), np.array([weight[k] for k in known]), -0.5)
    texts = ["", None, "idiot", "idiot idiot", "a calm loser", " ".join(words * 3), "calm " * 50_000 + "idiot"]
    own = lambda t: {int(h) for w in (t or "").split() for h in toxicity.features(pa.array([w]))[0]}
    want = [1 / (1 + np.exp(0.5 - sum(weight.get(h, 0) for h in (own(t) if len(t or "") < 1000 else own("calm idiot"))))) for t in texts]
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["score"] for r in got] == pytest.approx(want)


def test_label_model_discounts_repeated_voters():
    rng = np.random.default_rng(0)
    y = rng.random(3000) < 0.3
    good = [np.where(rng.random(3000) < 0.9, y, ~y) for _ in range(3)]
    bad = np.where(rng.random(3000) < 0.55, y, ~y)
    table = np.stack([*good, *[bad] * 3], 1).astype(np.int8)
    post, keep = toxicity.label_model(table)
    assert keep[3:].max() < keep[:3].min() and ((post > 0.5) == y).mean() > 0.93


def test_warc(spark, small):
    html = ["<p>é</p>", None, "", "<p>é</p>", "x" * 300_000, "\r\n\r\nWARC/1.0\r\n\r\n", "<p>é</p>"]
    rows = [(i, None if i == 2 else f"http://h/ü?{i}\r\nX: y", h, "e", i) for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, first int").repartition(3)
    archives = shared.materialize(warc.write_archives(warc.plan_records(pages, "page_id", "url", "html", 0), archive_bytes=500))
    read = {int(r["page"]): r for r in warc.read_archives(archives, payloads=True).collect()}
    assert len(read) == len(html)
    for i, h in enumerate(html):
        first = min(j for j, x in enumerate(html) if (x or "") == (h or ""))
        r = read[i]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == i else ("revisit", str(first)))
        assert r["payload_bytes"] == len((h or "").encode()) and r["payload_digest"] == warc.base32_sha1((h or "").encode())
        assert r["url"] == rows[i][1] and (r["payload"] == (h or "").encode() if first == i else r["payload"] is None)
    assert warc.read_archives(warc.write_archives(warc.plan_records(pages.limit(0), "page_id", "url", "html", 0))).count() == 0
    told = warc.plan_records(pages, "page_id", "url", "html", 1)
    assert {r["page_id"]: r["refers_to"] for r in told.collect()}[2] is None


def test_warc_of_repeated_and_null_ids(spark):
    rows = [(3, "u", "a"), (3, "u", "a"), (1, "u", "b"), (None, None, "b"), (None, None, "c"), (3, "v", "b")]
    read = warc.read_archives(shared.materialize(warc.write_archives(warc.plan_records(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html", 0)))).collect()
    digest = {warc.base32_sha1(x.encode()): x for x in "abc"}
    got = sorted((r["page"] or "", digest[r["payload_digest"]], r["record_type"], r["refers_to"] or "") for r in read)
    assert got == [("", "b", "revisit", "1"), ("", "c", "response", ""), ("1", "b", "response", ""), ("3", "a", "response", ""), ("3", "a", "response", ""), ("3", "b", "revisit", "1")]


def test_mixing_in_many_blocks(spark, monkeypatch):
    """The number of blocks follows the rows; every document once at least, and the target is met."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), "a" if i % 7 else "b") for i in range(3000)], "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "BLOCKS", 4)
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 100)
    assert mixing.blocks_of(docs) == 30
    got = mixing.mix(docs, 2.0).groupBy("source").agg(F.count("*").alias("n"), F.max("mix_block").alias("b")).collect()
    assert {r["source"]: round(r["n"] / (428 if r["source"] == "b" else 2572), 1) for r in got} in ({"a": 1.0, "b": 2.0}, {"a": 1.0, "b": 1.9}) and max(r["b"] for r in got) > 20


def test_warc_faults():
    good = warc.record("response", "1", "http://a", "2024-01-01T00:00:00Z", b"payload", None)
    assert [f["warc-type"] for f, _ in warc.read_records([good[:10], good[10:]])] == ["response"]
    with pytest.raises(ValueError):
        list(warc.read_records([good[:-5]]))
    plain = zlib.decompress(good, 31).replace(b"payload\r\n", b"Payload\r\n")
    with pytest.raises(ValueError):
        [warc.parse(f, b) for f, b in warc.read_records([zlib.compress(plain, wbits=31)])]


def test_warc_files(spark, tmp_path):
    archive = warc.record("response", "7", "http://a", "2024-01-01T00:00:00Z", b"one", None) + warc.record("revisit", "8", "http://b", "2024-01-01T00:00:00Z", b"one", "7")
    warc.write_files(spark.createDataFrame([("a.warc.gz", bytearray(archive))], warc.ARCHIVES), str(tmp_path))
    got = warc.read_archives(warc.read_files(spark, str(tmp_path))).orderBy("page").collect()
    assert [(r["page"], r["record_type"], r["payload_bytes"], r["refers_to"]) for r in got] == [("7", "response", 3, None), ("8", "revisit", 3, "7")]


def _prints(texts, every):
    """Brute force: the parts of each text, as a function of the distinct texts' terms."""
    import xxhash

    hashed = lambda s: xxhash.xxh64_intdigest(s.encode(), seed=42)
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    words = lambda t: {signed(hashed(w)) for w in "".join(c if c.isalpha() or c.isnumeric() else " " for c in t.lower()).split()}
    df, distinct = {}, set(every)
    for text in distinct:
        for w in words(text):
            df[w] = df.get(w, 0) + 1
    n = len(distinct)
    band = {w: 1 + sum(c > fingerprints.HIGH * n * 2**i for i in range(fingerprints.OCTAVES)) for w, c in df.items() if c >= max(2, fingerprints.LOW * n)}
    size = 1 << 10
    while size < fingerprints.SLOTS * len(band):
        size *= 2
    slots = {}
    for w, octave in band.items():
        slots[w % size] = min(octave, slots.get(w % size, 99))
    out = []
    for text in texts:
        own = words(text)
        kept = next((k for top in range(1, 2 + fingerprints.OCTAVES) if len(k := [w for w in own if slots.get(w % size, 99) <= top]) >= fingerprints.LEAST), own)
        best = {}
        for w in kept:
            u = w % 2**64
            zeros = min(63, (u & -u).bit_length() - 1)
            level, names = best.get(u >> 58, (-1, []))
            if zeros >= level:
                best[u >> 58] = (zeros, [*(names if zeros == level else []), u % 2**52])
        runs = {g: "".join(chr(fingerprints.FAMILIES + g) + chr(fingerprints.LEVELS + 63 - level) + f"{x:X}" for x in sorted(names)) for g, (level, names) in best.items()}
        out.append({f"{g:02x}{hashed(r) >> 40:06x}" for g, r in runs.items()} or {f"zz{hashed(text):x}"})
    return out


def _alike(a, b):
    return len(a & b) / len({x[:2] for x in a | b})


def test_fingerprints(spark, docs, none, rows):
    got = fingerprints.fingerprints(docs).collect()
    assert "Python" not in fingerprints.fingerprints(docs)._jdf.queryExecution().toString()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [r[1] or "" for r in order]
    after = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(texts, after, strict=True)]
    own, changed, of_next = (_prints(x, texts) for x in (texts, edited, after))
    parts = lambda s: {s} if s.startswith("zz") else {s[i : i + 8] for i in range(0, len(s), 8)}
    want = [(r[0], len(t), hashlib.sha256(e.encode()).hexdigest(), sorted(p), sorted(c), round(_alike(p, c), 9), round(_alike(p, x), 9)) for r, t, e, p, c, x in zip(order, texts, edited, own, changed, of_next, strict=True)]
    plain = [(r[0], r[1], r[2], sorted(parts(r[3])), sorted(parts(r[4])), round(r[5], 9), round(r[6], 9)) for r in got]
    assert sorted(plain, key=str) == sorted(want, key=str)
    assert fingerprints.fingerprints(none).count() == 0
    one = fingerprints.fingerprints(docs.filter("doc_id = 30")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_neighbours_in_many_ranges(spark, monkeypatch):
    """Ranges, empty ones among them, give each row the next id, and null ids and repeated rows come where they should."""
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)
    ids = [*range(0, 300, 3), None, None, 6]
    docs = spark.createDataFrame([(i, f"text {i} {k % 2}" if i is None else f"text {i}") for k, i in enumerate(ids)], "doc_id int, text string").repartition(5)
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).filter("doc_id IS NOT NULL").collect()}
    for i in range(0, 300, 3):
        text, after = f"text {i}", f"text {i - 3}" if i else "text None 0"
        half = len(text) // 2
        assert got[i]["edited_sha256"] in {hashlib.sha256((text[: len(text) - half] + x[:half]).encode()).hexdigest() for x in ([text, after] if i == 6 else [after])}
    assert fingerprints.fingerprints(docs).count() == len(ids)


def test_fingerprints_of_a_large_group(spark):
    """Copies don't move the lexicon, and near copies that hold a third of the rows are still alike."""
    rng = random.Random(6)
    words, base = [f"v{i}" for i in range(2000)], [f"b{i}" for i in range(100)]
    other = [(i, " ".join(rng.choices(words, k=100))) for i in range(200)]
    near = [(1000 + i, " ".join(base[:i] + [f"edit{i}"] + base[i + 1 :])) for i in range(100)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    slots = lambda rows: fingerprints.lexicon(named := fingerprints.named(frame(rows), "doc_id", "text"), fingerprints.keys_of(named))
    assert slots(other + [(5000 + i, other[0][1]) for i in range(150)]) == slots(other)
    got = {r["doc_id"]: r["near_next"] for r in fingerprints.fingerprints(frame(other + near)).collect()}
    assert min(got[1000 + i] for i in range(1, 100)) > 0.5
    assert max(got[i] for i in range(1, 200)) < 0.5


def test_html_extraction(spark, trained):
    pages = html_extract.labelled_pages(150, seed=77)
    assert sum(trained.text(p) == m for p, m in pages) >= 135
    page = '<html><head><title>t</title><script>var x="</p><p>no";</script></head><body><nav><ul><li><a href="/a">Home</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy now.</div><article><h1>The  title\n of it</h1><p><b>First &amp; 2 &lt; 3.<br>more<p>Second paragraph of the text, long enough.</p><aside><p>Related things</p></aside></article><section class="comments"><p>First!</p></section><footer>&copy; me</footer>'
    assert trained.text(page) == "The title of it\nFirst & 2 < 3. more\nSecond paragraph of the text, long enough."
    odd = [None, "", "   ", "<", "<p", "plain < text & more", "<article><p>a</article></p></p></div>", "<script>", "<!-- ", "<p>" * 3000 + "deep", "&#0;&bogus;"]
    rows = [(i, "u", h, "clash", 1) for i, h in enumerate(odd)] + [(0, "u", odd[0], "clash", 1)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"), trained).collect()
    assert len(got) == len(rows) and all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string"), trained).count() == 0


def test_html_head_left_open_and_closed_svg():
    texts = lambda page: [b.text for b in html_extract.blocks(page)]
    for start in ("<body>", "<body class=x><main>", "<article>", "<div><svg/>", '<svg viewBox="0 0 1 1" /><object data="x" />'):
        assert texts(f"<html><head><title>t</title><meta charset=utf-8><link rel=x>{start}<p>The text.</p><p>More.</p>") == ["The text.", "More."], start
    assert texts("<head><title>t</title><style>p {}</style><noscript>no</noscript></head><body><p>a</p><svg><path/>no</svg><p>b</p>") == ["a", "b"]
    assert texts("<head> <title>t</title>\nPlain <b>text</b>.") == ["Plain text."]
    assert texts("<head><script src=x />no</script><p>a</p>") == ["a"]


def test_html_loses_no_text(trained):
    """However long a page is, whatever its letters' case mappings, and wherever quotes stand."""
    texts = lambda page: [b.text for b in html_extract.blocks(page)]
    page = "<article><p>" + "İ" * 30 + " first.</p><script>var a;</script><p>Second paragraph.</p></article>"
    assert texts(page) == texts(f"<!--{'x' * 5000}-->" + page) == ["İ" * 30 + " first.", "Second paragraph."]
    for odd in ("data-x=don't", "data-x=5\"", "title=a'b'c", "x='", 'x="', "'", '"', "=", "= 'a>b' c", 'alt="a > b"', "a=b/"):
        assert texts(f"<article><p {odd}>First paragraph of the text.</p><p>Second.</p></article>") == ["First paragraph of the text.", "Second."], odd
    assert texts("<p>a</p><!--><p>b</p><!---><p>c</p><!-- no --!><p>d</p></><p>e</p></ no><p>f</p>") == list("abcdef")
    assert texts("<p>a</p><scriſt>b</scriſt><SCRIPT>no</scripty></SCRIPT\n><p>c</p>") == ["a", "b", "c"]
    assert texts("<p>a</p><svg><p>b</p><object><p>c</p><noscript><p>no</p></noscript><p>d</p>") == ["a", "b", "c", "d"]
    rng = random.Random(12)
    parts = ["<p>", "</p>", "<div class=x>", "</div>", "<b>", "</b>", "<script>x<y</script>", "<style>p{}</style>", "<!-- c -->", "İ", "ſ", "don't", "a b", " ", "&amp;", "<br>", "<p title=\"a>b\">", "<p x='", "\"", "'", "=", ">", "<", "</", "<svg/>", "<li>", "K"]
    for _ in range(400):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert texts(page) == texts(f"<!--{'x' * 5000}-->{page}"), page


def test_html_extraction_of_all_pages_agrees_with_a_parser(spark, small, trained):
    """The pages of the tables have one article each; Python's parser reads its headings and paragraphs."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.on, self.parts = False, [[]]

        def handle_starttag(self, tag, attrs):
            self.on |= tag == "article"
            if tag in ("p", "h1", "article"):
                self.parts.append([])
            if tag == "br" and self.on:
                self.parts[-1].append(" ")

        def handle_endtag(self, tag):
            self.on &= tag != "article"
            if tag in ("p", "h1"):
                self.parts.append([])

        def handle_data(self, data):
            if self.on:
                self.parts[-1].append(data)

    def article(page):
        reader = Article()
        reader.feed(page or "")
        reader.close()
        return "\n".join(x for x in (" ".join("".join(p).split()) for p in reader.parts) if x)

    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = sorted(map(tuple, html_extract.extract(pages, trained).collect()))
    assert got == sorted((r["page_id"], r["url"], article(r["html"]), len(article(r["html"]))) for r in pages.collect())


def test_viterbi_and_likelihood_agree_with_enumeration(trained):
    found = html_extract.blocks(html_extract.labelled_pages(1, seed=4)[0][0])[:8]
    gains = [sum(trained.weights.get(f, 0.0) for f in html_extract.path_features(b.path) + html_extract.text_features(b, i, len(found))) for i, b in enumerate(found)]
    value = lambda s: sum(g for g, x in zip(gains, s, strict=True) if x) + sum(trained.moves[a][b] for a, b in itertools.pairwise(s))
    best = max(itertools.product((0, 1), repeat=len(found)), key=value)
    assert value(trained.states(found)) == pytest.approx(value(best))


def test_language_id(spark, docs, none):
    rng = random.Random(1)
    parts = {"aa": ["ba", "lo", "mi"], "bb": ["thr", "str", "ing"], "cc": ["oeu", "aie", "üé"]}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(12)), lang) for i, lang in enumerate(list(parts) * 100)]
    table = spark.createDataFrame([*rows, (1000, None, "aa"), (1001, "words", None), (1002, "12 !?", "bb")], "doc_id long, text string, lang string")
    model = language_id.fit(table, shared.fold_of(4) != 2)
    got = {r[0]: (r[1], r[2]) for r in language_id.predict(table, model).collect()}
    assert sum(got[i][0] == lang for i, _, lang in rows) >= 297 and got[1000][0] == got[1002][0] == "und"
    assert len(language_id.predict(docs, model).collect()) == docs.count() and language_id.predict(none, model).count() == 0
    lost = language_id.predict(table, language_id.fit(table.filter("lang IS NULL"), F.lit(True))).collect()
    assert {r[1] for r in lost} == {"und"}
    single = language_id.fit(table.filter("lang = 'aa'"), F.lit(True))
    assert {r[1] for r in language_id.predict(table.filter("lang = 'aa' AND text IS NOT NULL"), single).collect()} == {"aa"}


def test_training_rows_do_not_depend_on_order_or_partitions(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 200) if i % 9 else None, None if i % 11 == 0 else "".join(rng.choices("abcdefg ", k=30)), f"l{i % 3}") for i in range(500)]
    fits = [language_id.fit(spark.createDataFrame(x, "doc_id long, text string, lang string").repartition(k), F.lit(True)) for x, k in ((rows, 1), (rows[::-1], 5))]
    assert (fits[0].weights == fits[1].weights).all() and (fits[0].slope == fits[1].slope).all()


def test_decoding_agrees_with_its_definition():
    """Means of a bit's weights over a text's n-grams, margins, and the codeword with the least weighted loss."""
    rng = random.Random(8)
    texts = ["".join(rng.choices(alphabet, k=60)) for alphabet in ("abc de", "fgh ij", "aéü bx", "klmno ") for _ in range(40)]
    model = language_id.train(texts, [lang for lang in "abcd" for _ in range(40)])
    size = 1 << language_id.BUCKET_BITS
    for text in [*texts[::13], "abc fgh", "é", "x1y", "a" * 300_000]:
        raw = bytes(b + 32 if 65 <= b < 91 else b if b >= 128 or chr(b).isalpha() else 32 for b in text.encode())
        total, n = np.zeros(model.code.shape[1]), 0
        for k, order in enumerate(language_id.ORDERS) if len(raw) < 1000 else ():
            for i in range(len(raw) - order + 1):
                code = int.from_bytes(raw[i : i + order], "big")
                if raw[i : i + order] != b" " * order:
                    total, n = total + model.weights[(code * 0x9E3779B97F4A7C15 % 2**64 >> 64 - language_id.BUCKET_BITS) + k * size], n + 1
        means = model.means(*shared.text_buffer(pa.array([text])))
        if len(raw) < 1000:
            assert means[0] == pytest.approx(total / max(n, 1), abs=1e-5)
        margin = np.clip(means[0] * model.slope + model.offset, -12, 12)
        loss = [sum(t * np.log1p(np.exp(-m * c)) for t, m, c in zip(model.trust, margin, word, strict=True)) for word in model.code]
        at, score, ambiguous = model.decode(means)
        assert at[0] == int(np.argmin(loss)) and score[0] == pytest.approx(np.exp(-min(loss)) / sum(np.exp(-x) for x in loss)) and ambiguous[0] == (sorted(loss)[1] - min(loss) < language_id.LEAD)


def test_codewords_are_apart():
    for n in (2, 4, 7, 9, 30):
        code = language_id.codewords(n)
        assert min((code[i] != code[j]).sum() for i, j in itertools.combinations(range(n), 2)) >= max(1, code.shape[1] // 4)


def test_mixing(spark, docs, none, rows):
    mixed = mixing.mix(docs, max_repeats=2.0)
    got = mixed.groupBy("source").agg(F.count("*").alias("n")).collect()
    plain = {}
    for r in rows:
        plain[r[3]] = plain.get(r[3], 0) + 1
    assert all(r["n"] >= plain[r["source"]] for r in got) and {r["source"] for r in got} == set(plain)
    assert set(docs.columns) <= set(mixed.columns) and "Python" not in mixed._jdf.queryExecution().toString()
    assert mixing.mix(none).count() == 0


def test_mixing_meets_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "big" if i % 10 else "tiny" if i % 20 else "small") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    mixed = mixing.mix(docs, max_repeats=3.0)
    used = {r[0]: r[1] for r in mixed.groupBy("source").agg(F.sum(mixing.tokens(F.col("text")))).collect()}
    repeats = {s: used[s] / size[s] for s in size}
    assert min(repeats.values()) == 1 and max(repeats.values()) == pytest.approx(3, abs=0.03)
    told = mixing.plan(docs, "doc_id", "text", "source", None, 0.9, 10_000, 1).collect()
    assert -sum(r["weight"] * np.log(r["weight"]) for r in told) == pytest.approx(0.9, abs=1e-6)
    fixed = mixing.mix(docs, max_repeats=None, entropy=0.9, budget=10_000)
    total = fixed.agg(F.sum(mixing.tokens(F.col("text")))).first()[0]
    assert 9_900 <= total <= 10_000
    epochs = fixed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("mix_epoch").alias("e")).filter("n <> e + 1")
    assert epochs.count() == 0


def test_fuse_filter():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 10, 100, 5000, 60_000):
        keys = rng.integers(0, 2**63, n, dtype=np.uint64)
        blob = fuse_filter.build(np.concatenate([keys, keys[:5]]))
        assert fuse_filter.contains(blob, keys).all()
        other = rng.integers(2**63, 2**64, 20_000, dtype=np.uint64)
        assert fuse_filter.contains(blob, other).mean() < 0.01
        assert n < 5000 or len(blob) < 1.3 * n + 5000


def _dedup_want(rows):
    out, seen = [], set()
    for r in rows:
        same = [x[0] for x in rows if (x[1] or "") == (r[1] or "")]
        keep = max((x for x in same if x is not None), default=None)
        key = (r[0], r[1] or "")
        out.append((r[0], keep, len(same), r[0] == keep and key not in seen, hashlib.sha256((r[1] or "").encode()).hexdigest()))
        seen.add(key)
    return sorted(out, key=str)


def test_exact_dedup(spark, docs, none, rows):
    for older in (shared.fold_of(2) == 0, F.lit(True), F.lit(False)):
        got = exact_dedup.exact_dedup(docs, older).collect()
        assert sorted(map(tuple, got), key=str) == _dedup_want(rows)
    assert exact_dedup.exact_dedup(none, F.lit(True)).count() == 0
    kept = exact_dedup.surviving(docs, shared.fold_of(2) == 0)
    assert kept.columns == docs.columns
    assert sorted([(r["doc_id"], r["text"] or "") for r in kept.collect()], key=str) == sorted({(r[0], t) for r in rows for t in [r[1] or ""] if r[0] == max((x[0] for x in rows if (x[1] or "") == t and x[0] is not None), default=None)}, key=str)


def test_exact_dedup_of_hot_groups_and_small_broadcasts(spark, docs, rows, monkeypatch):
    """Groups sent to their rows, texts joined by shuffles, buckets that hold few digests: the same answer."""
    monkeypatch.setattr(exact_dedup, "LEAST_HOT", 1)
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(exact_dedup, "BUCKET_ROWS", 2)
    got = exact_dedup.exact_dedup(docs, shared.fold_of(2) == 0).collect()
    assert sorted(map(tuple, got), key=str) == _dedup_want(rows)
    assert spark.catalog.listTables() == [] or not any(t.name.startswith("tessera") for t in spark.catalog.listTables())


def test_the_snapshot_is_not_shuffled(spark, docs):
    """Positives move to the snapshot's buckets; between these and the join there is no exchange."""
    rows = exact_dedup.digests(docs, "doc_id", "text")
    snapshot = exact_dedup.take_snapshot(rows.filter("doc_id % 2 = 0"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = exact_dedup.merge(rows.filter("doc_id % 2 = 1"), snapshot)
        merged.collect()
        plan = merged._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.split("\n")
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "Bucketed: true" in x)
    join = max(i for i in range(scan) if "Join" in lines[i])
    other = max((i for i in range(join, scan) if "FileScan" in lines[i]), default=join)
    assert "Exchange" in plan and not any("Exchange" in x for x in lines[other + 1 : scan])


def test_exact_dedup_checks_bytes(spark, docs, rows):
    """With a digest that collides, texts still decide."""
    weak = lambda text: F.concat(F.lit("d"), (F.crc32(text.cast("binary")) % 3).cast("string"))
    got = exact_dedup.exact_dedup(docs, shared.fold_of(2) == 0, digest=weak).collect()
    assert sorted([tuple(r)[:4] for r in got], key=str) == sorted([w[:4] for w in _dedup_want(rows)], key=str)


def _packed(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark, docs, none, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    marked = [(1, "<|endoftext|>"), (2, "two <|endoftext|> parts<|endoftext|>"), (3, " <|endoftext|>\n\n x")]
    docs = docs.unionByName(spark.createDataFrame(marked, "doc_id long, text string"), allowMissingColumns=True)
    for capacity in (64, 2048):
        got = packing.pack_documents(docs, vocabulary_path("byte_bpe_50k.json"), public_tokenizers.PATTERN, capacity).collect()
        want = []
        for r in [*rows, *marked]:
            ids = [*coder.encode(r[1] or "", add_special_tokens=False).ids, 0]
            cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
            want += [(r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(itertools.pairwise(cuts))]
        assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
        used, least = _packed(got, capacity), -(-sum(w[3] for w in want) // capacity)
        assert used <= least + 2
    assert packing.pack_documents(none, vocabulary_path("byte_bpe_50k.json"), public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("special", [True, False])
def test_ids_are_those_of_the_tokenizer(monkeypatch, special):
    """The default call of the tokenizer's file, special tokens included; and with a cache that overflows."""
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    coder.encode_special_tokens = not special
    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    own = packing.Encoder(vocabulary_path("byte_bpe_50k.json"), public_tokenizers.PATTERN, special)
    assert special is False or coder.encode("<|endoftext|>", add_special_tokens=False).ids == [50256]
    rng = random.Random(9)
    parts = ["a", "the", "é", " ", " ", "\n", "'s", "12", "!?", "<|endoftext|>", "\t", " ", "中", "😀", "\u3000", "\xa0", "\x1c", "\x85", "ß", "–", "\u2009", "\u200b", "c'est", "\r\n", "½"]
    for _ in range(150):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(20)] + [None, ""]
        ids, first = own.texts(*shared.text_buffer(pa.array(texts)))
        for i, text in enumerate(texts):
            assert ids[first[i] : first[i + 1]].tolist() == coder.encode(text or "", add_special_tokens=False).ids, text


def test_plan_uses_every_piece_and_is_near_the_least():
    rng = random.Random(6)
    for _ in range(60):
        capacity = rng.choice([10, 17, 100])
        counts = {}
        for _ in range(rng.randint(0, 60)):
            s = rng.randint(1, capacity)
            counts[s] = counts.get(s, 0) + 1
        patterns = packing.plan(counts, capacity)
        used = {}
        for pattern, times in patterns:
            assert sum(pattern) <= capacity and times > 0
            for s in pattern:
                used[s] = used.get(s, 0) + times
        assert used == counts
        bins, least = sum(t for _, t in patterns), -(-sum(s * n for s, n in counts.items()) // capacity)
        assert bins <= 11 / 9 * max(least, sum(n for s, n in counts.items() if 2 * s > capacity)) + 2


def test_reduction_fixes_only_bins_of_a_best_solution():
    def best(pieces, capacity):
        pieces = sorted(pieces, reverse=True)
        answer = [len(pieces)]

        def place(i, bins):
            if len(bins) >= answer[0]:
                return
            if i == len(pieces):
                answer[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + pieces[i] <= capacity and bins[k] not in bins[:k]:
                    place(i + 1, bins[:k] + (bins[k] + pieces[i],) + bins[k + 1 :])
            place(i + 1, (*bins, pieces[i]))

        place(0, ())
        return answer[0]

    rng = random.Random(8)
    for _ in range(250):
        capacity = rng.choice([9, 12, 20])
        pieces = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]
        fixed, rest = packing.reduce_instance({s: pieces.count(s) for s in pieces}, capacity)
        left = [s for s, n in rest.items() for _ in range(n)]
        assert best(pieces, capacity) == sum(t for _, t in fixed) + (best(left, capacity) if left else 0), pieces
