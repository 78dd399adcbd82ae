"""The pipeline against a brute-force version of its decisions, and the registered queries."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
import corpus_pipeline
from tessera.llm import queries


def test_stages_keep_columns_and_chain(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    seen, rows = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, small)
        assert seen.columns == docs.columns, name
        rows[name] = seen.select("doc_id", "text", "source").collect()
        seen = spark.createDataFrame(seen.collect(), docs.schema)
    plain = rows["toxicity"]
    assert 0.8 * docs.count() <= len(plain) < docs.count()
    last = {}
    for r in plain:
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"])
    assert {r["doc_id"] for r in rows["exact dedup"]} == set(last.values())
    sets = {}
    for r in rows["exact dedup"]:
        words = bytes(b + 32 if 65 <= b < 91 else b for b in (r["text"] or "").encode()).split()
        sets[r["doc_id"]] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            small_, large = sorted((len(sets[i]), len(sets[j])))
            if small_ and 100 * small_ >= 75 * large and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {r["doc_id"] for r in rows["n-gram Jaccard join"]} == {find(i) for i in ids}
    assert {r["doc_id"] for r in rows["mixing sources to target weights"]} == {find(i) for i in ids}
    out = corpus_pipeline.run(spark, small)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {find(i) for i in ids}


def test_stages_take_odd_tables(spark, small):
    """Nulls in any column, empty texts, repeated rows, clashing columns and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, digest string, entity long, mix_block int, piece int, range int"
    rows = [(i, t, None, s, None, "d", 1, 2, 3, 4) for i, (t, s) in enumerate([("one two three four five six", "a"), (None, "a"), ("", None), ("one two three four five six", "b"), ("word " * 3000, "b"), ("one two three four five seven", None)])]
    rows += [rows[0], (None, "no id", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    for made in (rows, []):
        docs = spark.createDataFrame(made, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, small).collect(), schema)
            if made and name == "exact dedup":
                assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect()) == [(False, 2, ""), (False, 3, rows[0][1]), (False, 4, rows[4][1]), (False, 5, rows[5][1]), (True, 0, "no id")]
        out = corpus_pipeline.STAGES[-1][1](spark, docs, small)
        assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
        assert bool(made) == bool(out.count())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, small, name):
    for t in ("documents", "pages"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = duckdb.sql(queries.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, small).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda v: "" if v is None or v is pd.NA or v != v else int(v) if isinstance(v, float) and v == int(v) else v
    rows = lambda f: sorted(str([plain(v) for v in r]) for r in f[columns].itertuples(index=False, name=None))
    assert rows(got) == rows(want)
