"""Extraction, resolution, scoring, audit, sources and sinks on small cases."""

import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.operators import audit, index, resolve, runs, score
from tessera.operators.extract import extract
from tessera.sources import readers, sinks

#: A folder of texts and a file of labels to test extraction on, where there are such.
TEXTS, LABELS = os.environ.get("TESSERA_TEXTS", ""), os.environ.get("TESSERA_LABELS", "")


def found(spark, texts, **how):
    rows = extract(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "documento_id string, texto string"), **how).orderBy("documento_id", "start").collect()
    out = [[] for _ in texts]
    for r in rows:
        assert texts[int(r["documento_id"])][r["start"] : r["end"]] == r["literal"]
        out[int(r["documento_id"])].append((r["explicit_type"], r["literal"]))
    return out


CASES = [
    ("Cita o REsp nº 1.883.715/SP, no ponto.", [("case", "REsp nº 1.883.715/SP")]),
    ("Vide artigo 373, inciso I, da Lei nº 13.105/2015.", [("law", "artigo 373, inciso I, da Lei nº 13.105/2015")]),
    ("A Súmula nº 211 do STJ incide.", [("sumula", "Súmula nº 211 do STJ")]),
    ("Há jurisprudência dominante e dispositivos aplicáveis.", []),
    ("precedente da Terceira Turma, sem mais.", []),
    ("REsp n° 1.883.7l5 – SP.", [("case", "REsp n° 1.883.7l5 – SP")]),
    ("RE5p n° 1.883.715; Súmu1a 2ll do STJ.", [("case", "RE5p n° 1.883.715"), ("sumula", "Súmu1a 2ll do STJ")]),
    ("😀\r\nAgRg no Rec. Esp. n. 1.522.200 (SC) decidiu.", [("case", "AgRg no Rec. Esp. n. 1.522.200 (SC)")]),
    ("Processo HC 111\nRelator X\nFUNDAMENTAÇÃO\nCita HC 222333.", [("case", "HC 222333")]),
    ("código HC 123456 do hospital; arquivo interno denominado RESP 2024.", []),
    ("precedente do STJ de 2018, da relatoria de Maria Silva.", [("incomplete", "precedente do STJ de 2018, da relatoria de Maria Silva")]),
    ("ED no AgR no AREspEl 0601514-91.2020.6.05.0000.", [("case", "ED no AgR no AREspEl 0601514-91.2020.6.05.0000")]),
    ("tema 123 da repercussão geral e TST-AIRR-1234-56.2019.", [("sumula", "tema 123 da repercussão geral"), ("case", "TST-AIRR-1234-56.2019")]),
    ("R-Rp nº 4321, e HC nº 123.456/SP (julgado em 2020).", [("case", "R-Rp nº 4321"), ("case", "HC nº 123.456/SP")]),
    # quirks that are kept: an ordinal after a stop isn't a marker, a summary's number may be letters, numbers absorb o, l, s, g
    ("REsp n.º 123 e Súmula n.º 7 e súmula sobre.", [("sumula", "Súmula n.º"), ("sumula", "súmula so")]),
    ("REsp 123 os autos.", [("case", "REsp 123 os")]),
    ("", []),
]


def test_extraction(spark):
    assert found(spark, [t for t, _ in CASES]) == [w for _, w in CASES]


def test_null_text(spark):
    assert extract(spark.createDataFrame([("a", None)], "documento_id string, texto string")).count() == 0


@pytest.mark.skipif(not (os.path.isdir(TEXTS) and os.path.isfile(LABELS)), reason="no labelled texts are named")
def test_labelled_texts(spark):
    texts, gold = readers.texts(spark, TEXTS), readers.labels(spark, LABELS)
    got = {(r["documento_id"], r["start"], r["end"]) for r in extract(texts).collect()}
    want = {(r["documento_id"], r["inicio"], r["fim"]) for r in gold.collect()}
    assert got == want and want
    assert audit.wrong_literals(gold, texts).count() == 0 and audit.uncovered(gold, texts).count() == 0
    solution = readers.solution(gold)
    perfect = solution.select("documento_id", F.array_join(F.transform(F.split("citacoes", r"\|"), lambda b: F.concat(b, F.lit(",1.0"))), "|").alias("citacoes"))
    assert score.score(solution, perfect) == pytest.approx(1.1, abs=1e-12)
    assert {r["macro_f1"] for r in score.evaluate(solution, perfect).collect()} == {1.0}


def test_collisions_resolve_to_nothing(spark):
    rows = [(1, None, "Art. 5. Texto A", "dispositivo", "Constituição Federal", None), (2, None, "Art. 5. Texto B", "dispositivo", "Constituição Federal", None), (3, "STJ", "Texto A", "sumula", None, "83"), (4, "STJ", "Texto B", "sumula", None, "83"), (5, "STF", "Viola a cláusula de reserva de plenário", "sumula", None, None), (6, None, "sem artigo", "dispositivo", None, None)]
    table = spark.createDataFrame(rows, "id long, tribunal string, texto string, natureza string, diploma string, numero string")
    assert [tuple(r) for r in index.law_index(table).collect()] == [("constituicao_federal", "5", [1, 2])]
    assert sorted(tuple(r) for r in index.summary_index(table).collect()) == [("stf", "10", [5]), ("stj", "83", [3, 4])]
    assert [r["id"] for r in index.recoveries(table).collect()] == [5]
    assert [(r["id"], r["missing"]) for r in index.unindexed(table).collect()] == [(6, ["artigo", "diploma"])]
    laws = spark.createDataFrame([("art. 5º da Constituição Federal",)], "literal string")
    sums = spark.createDataFrame([("Súmula 83 do STJ",), ("Súmula Vinculante 10",), ("súmula 10",), ("Súmula vinculante 10 do STJ",)], "literal string")
    assert resolve.resolve_laws(laws, index.law_index(table)).first()["canonical_id"] is None
    got = dict(map(tuple, resolve.resolve_summaries(sums, index.summary_index(table)).collect()))
    assert got == {"Súmula 83 do STJ": None, "Súmula Vinculante 10": 5, "súmula 10": 5, "Súmula vinculante 10 do STJ": None}
    bare = table.drop("diploma", "numero")
    assert index.law_index(bare).count() == 0


def test_cases_near_the_best_must_agree(spark):
    rows = [
        (10, "STJ", 2019, "A", "RECURSO ESPECIAL Nº 111222"), (11, "STJ", 2019, "a", " RECURSO ESPECIAL Nº 111222"),
        (20, "STJ", 2019, "A", "RECURSO ESPECIAL Nº 333444"), (21, "STJ", 2020, "A", "RECURSO ESPECIAL Nº 333444"),
        (30, "STJ", 2019, "A", "HABEAS CORPUS Nº 555666"), (40, "STJ", 2019, "A", "x" * 450 + " REsp Nº 777888"), (41, "TST", 2019, "A", "x" * 450 + " Nº 777889"),
    ]
    table = spark.createDataFrame(rows, "id long, tribunal string, ano int, relator string, texto string").withColumn("natureza", F.lit("acordao"))
    literals = ["REsp nº 111222", "REsp nº 333444", "REsp 555666", "HC nº 555666", "REsp 777888", "RR-777889", "REsp 99", "REsp 1l1222"]
    got = {r[0]: tuple(r)[1:] for r in resolve.resolve_cases(spark.createDataFrame([(x,) for x in literals], "literal string"), index.number_index(table)).collect()}
    assert got == {"REsp nº 111222": ("real", 10), "REsp nº 333444": ("incompleta", None), "REsp 555666": ("inventada", None), "HC nº 555666": ("real", 30), "REsp 777888": ("inventada", None), "RR-777889": ("real", 41), "REsp 99": ("incompleta", None), "REsp 1l1222": ("real", 10)}


METRIC = [
    ("0,10,real,7", "0,10,real,7,1", 1.1),
    ("0,10,real,7", "0,10,real,8,1", 0.0),
    ("0,10,inventada,-|20,30,real,7", "0,10,real,9,0.9|20,30,real,7,0.8", 0.17625),
    ("0,20,incompleta,-", "0,20,incompleta,-,-|2,6,incompleta,-,-", 1.0),
    ("0,20,incompleta,-", "0,20,incompleta,-,-|15,25,incompleta,-,-", 2 / 3),
    ("0,2,incompleta,-|2,4,incompleta,-", "0,4,incompleta,-,-|1,2,incompleta,-,-", 2 / 3),
    ("0,10,incompleta,-", "0,10,incompleta,-,-|50,60,real,1,-", 1.0),
    ("0,10,real,7:08", " 0 , 10 , REAL , 008 , - ", 1.0),
    ("0,10,real,7", "-", 0.0),
]


@pytest.mark.parametrize(("gold", "cell", "want"), METRIC)
def test_score(spark, gold, cell, want):
    solution = spark.createDataFrame([("d", 1, gold, "Public")], "documento_id string, nivel int, citacoes string, Usage string")
    submission = spark.createDataFrame([("d", cell), ("unknown", "bad cell")], "documento_id string, citacoes string")
    assert score.score(solution, submission) == pytest.approx(want, abs=1e-12)


def test_levels_weigh(spark):
    solution = spark.createDataFrame([("a", 1, METRIC[3][0]), ("b", 2, METRIC[4][0])], "doc string, nivel int, citacoes string")
    submission = spark.createDataFrame([("a", METRIC[3][1], 0), ("b", METRIC[4][1], 1), ("b", "broken", 2)], "doc string, citacoes string, no int")
    assert score.score(solution, submission, "doc", "no") == pytest.approx(7 / 9, abs=1e-12)


@pytest.mark.parametrize(("cell", "kind"), [("0,10", score.SubmissionError), ("0,10,real,-,1", score.SubmissionError), ("0,10,incompleta,-,1|1,10,incompleta,-,1", score.SubmissionError), (None, score.SubmissionError)])
def test_faults(spark, cell, kind):
    solution = spark.createDataFrame([("d", 1, "0,10,real,7"), ("e", 1, "0,10,real,7")][: 2 if cell is None else 1], "documento_id string, nivel int, citacoes string")
    with pytest.raises(kind):
        score.score(solution, spark.createDataFrame([("d", cell or "-")], "documento_id string, citacoes string"))
    with pytest.raises(score.SubmissionError):
        score.score(solution, spark.createDataFrame([("d",)], "documento_id string"))


def test_the_first_row_of_a_file_counts(spark, tmp_path):
    """Whatever order a shuffle might bring rows in: the reader says where each stood."""
    path = tmp_path / "sub.csv"
    path.write_text("documento_id,citacoes\n" + "".join(f'd{i},"0,10,incompleta,-,-"\nd{i},broken\nd{i},-\n' for i in range(300)), encoding="utf-8")
    solution = spark.createDataFrame([(f"d{i}", 1, "0,10,incompleta,-") for i in range(300)], "documento_id string, nivel int, citacoes string")
    read = readers.submission(spark, str(path))
    assert score.score(solution, read) == score.score(solution, read.repartition(7)) == pytest.approx(1.0, abs=1e-12)


@pytest.mark.parametrize("gold", ["0,10,real,-", "0,10,real,1|5,12,incompleta,-", "0,10,incompleta", "0,10"])
def test_label_faults(spark, gold):
    with pytest.raises(score.GoldError):
        score.score(spark.createDataFrame([("d", 1, gold)], "documento_id string, nivel int, citacoes string"), spark.createDataFrame([("d", "-")], "documento_id string, citacoes string"))


def test_report(spark):
    gold = spark.createDataFrame([("a", 1, 0, 10, "real", "7"), ("b", 2, 0, 10, "incompleta", None)], "documento_id string, nivel int, inicio int, fim int, classificacao string, id_canonico string")
    solution = readers.solution(gold)
    subs = spark.createDataFrame([("x", "a", "0,10,real,7,1"), ("x", "b", "0,10,incompleta,-,1"), ("y", "a", "0,9,real,7,1"), ("y", "b", "-")], "mode string, documento_id string, citacoes string")
    families = spark.createDataFrame([("a", "f1"), ("b", "f2")], "documento_id string, family string")
    told = audit.report(gold, solution, subs, families, "x", "y")
    assert {(r["mode"], r["family"]): round(r["score_final"], 6) for r in told["scores"]} == {("x", "overall"): 1.1, ("x", "f1"): 1.1, ("x", "f2"): 1.1, ("y", "overall"): round(1.1 / 3, 6), ("y", "f1"): 1.1, ("y", "f2"): 0.0}
    assert told["changed_documents"] == [{"documento_id": "a"}, {"documento_id": "b"}]
    assert [(r["mode"], r["worst_family"], round(r["population_stddev"], 6)) for r in told["summaries"]] == [("x", "f1", 0.0), ("y", "f2", 0.55)]
    assert [(r["mode"], r["true_positive"], r["false_positive"]) for r in told["exact_spans"]] == [("x", 2, 0), ("y", 0, 1)]
    with pytest.raises(ValueError):
        audit.report(gold, solution, subs, families.limit(1), "x", "y")
    assert [(r["family"], r["real"], r["incompleta"]) for r in told["family_support"]] == [("f1", 1, 0), ("f2", 0, 1)]
    assert told["headline"]["changed_document_count"] == 2 and told["headline"]["metric_sensitive"] and told["headline"]["score_delta"] == pytest.approx(1.1 / 3 - 1.1)
    assert told["headline"]["worst_family_score"] == {"x": pytest.approx(1.1), "y": 0.0} and told["estimated_unseen_score"] is None
    with pytest.raises(ValueError, match="lacks documents"):
        audit.sliced_scores(solution, subs, families.unionByName(spark.createDataFrame([("c", "f2")], families.schema)))
    with pytest.raises(score.SubmissionError):
        audit.sliced_scores(solution, subs.filter("mode = 'x' OR documento_id = 'a'"), families)
    with pytest.raises(score.GoldError):
        audit.report(gold.unionByName(gold.withColumn("nivel", F.lit(3)).limit(1)), solution, subs, families, "x", "y")
    assert score.require_score(1.1, 1.1 + 1e-13) == 1.1
    with pytest.raises(score.SubmissionError):
        score.require_score(1.1, 1.0)


def test_corpus_hash(spark):
    import hashlib

    files = {"b.txt": b"two\r\n", "a.txt": "é".encode()}
    digest = hashlib.sha256()
    for name in sorted(files):
        digest.update(len(name).to_bytes(8, "big") + name.encode() + len(files[name]).to_bytes(8, "big") + files[name])
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "name string, content binary")
    assert audit.corpus_hash(rows).first()[0] == digest.hexdigest()


def test_sources_and_sinks(spark, tmp_path):
    texts = tmp_path / "txt"
    texts.mkdir()
    (texts / "a.txt").write_bytes("Cita HC 123456.\r\nFim".encode())
    (texts / "b.txt").write_bytes(b"nada")
    docs = readers.texts(spark, str(texts))
    assert {r["documento_id"]: r["texto"] for r in docs.collect()}["a"] == "Cita HC 123456.\r\nFim"
    db = tmp_path / "c.db"
    with sqlite3.connect(db) as made:
        made.execute("CREATE TABLE documentos(id INTEGER, tribunal TEXT, ano INTEGER, relator TEXT, texto TEXT, natureza TEXT)")
        made.executemany("INSERT INTO documentos VALUES (?,?,?,?,?,?)", [(5, "STJ", 2019, "A", "HABEAS CORPUS Nº 123456", "acordao"), (6, None, None, None, "Art. 1", "dispositivo")])
    canonical = readers.canonical(spark, str(db))
    assert canonical.filter("natureza = 'acordao'").count() == 1 and canonical.count() == 2
    assert readers.canonical(spark, str(db), equals="natureza=acordao").count() == 1
    cites = resolve.predict(docs, canonical)
    assert [(r["classification"], r["canonical_id"]) for r in cites.collect()] == [("real", "5")]
    assert resolve.violations(cites, docs).count() == 0
    out = tmp_path / "json"
    sinks.write_contract(sinks.contract(docs, cites), str(out))
    told = json.loads((out / "a.json").read_text(encoding="utf-8"))
    assert told == {"schema_version": "1.2", "documento_id": "a", "citacoes": [{"citacao_id": "p1", "inicio": 5, "fim": 14, "trecho": "HC 123456", "tipo": "jurisprudencia", "classificacao": "real", "resolucao": {"id_canonico": "5"}, "confianca": 1.0}]}
    cells = readers.contract_cells(readers.contract_json(spark, str(out)))
    assert dict(map(tuple, cells.collect())) == {"a": "5,14,real,5,1.0000", "b": "-"} == dict(map(tuple, score.cells(docs, cites).collect()))
    assert sinks.stale(spark, str(out), docs.filter("documento_id = 'a'")).collect()[0][0] == "b"
    sinks.write_submission(cells, str(tmp_path / "csv"))
    part = next(p for p in (tmp_path / "csv").iterdir() if p.suffix == ".csv")
    assert part.read_bytes() == b'documento_id,citacoes\r\na,"5,14,real,5,1.0000"\r\nb,-\r\n'
    assert {r["documento_id"]: r["citacoes"] for r in readers.submission(spark, str(tmp_path / "csv")).collect()} == {"a": "5,14,real,5,1.0000", "b": "-"}


@pytest.fixture
def corpus(tmp_path):
    """Two texts, a database and labels."""
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt" / "a.txt").write_bytes("Cita HC 123456.\r\nFim, e HC 777888.".encode())
    (tmp_path / "txt" / "b.txt").write_bytes(b"nada")
    with sqlite3.connect(tmp_path / "c.db") as made:
        made.execute("CREATE TABLE documentos(id INTEGER, tribunal TEXT, ano INTEGER, relator TEXT, texto TEXT, natureza TEXT)")
        made.execute("INSERT INTO documentos VALUES (5, 'STJ', 2019, 'A', 'HABEAS CORPUS Nº 123456', 'acordao')")
    rows = ["nivel,documento_id,citacao_id,inicio,fim,trecho,tipo,classificacao,id_canonico", "1,a,g1,5,14,HC 123456,jurisprudencia,real,5.0", "1,a,g2,24,33,HC 777888,jurisprudencia,inventada,"]
    (tmp_path / "gold.csv").write_text("\ufeff" + "\n".join(rows) + "\n", encoding="utf-8")
    (tmp_path / "families.csv").write_text("documento_id,family\na,f1\n", encoding="utf-8")
    return tmp_path


def test_command_line(spark, corpus, capsys):
    from tessera.__main__ import main

    out, docs = corpus / "new" / "sub.csv", corpus / "json"
    assert main([str(corpus / "c.db"), str(corpus / "txt"), str(out)]) == 0
    want = b'documento_id,citacoes\r\na,"5,14,real,5,1.0000|24,33,inventada,-,1.0000"\r\nb,-\r\n'
    assert out.read_bytes() == want
    assert main(["evaluate", str(out), "--gold", str(corpus / "gold.csv"), "--expect", "1.1"]) == 0
    assert json.loads(capsys.readouterr().out)["score_final"] == pytest.approx(1.1, abs=1e-12)
    assert main(["evaluate", str(out), "--gold", str(corpus / "gold.csv"), "--expect", "1"]) == 1
    assert main(["oracle", str(corpus / "gold.csv"), str(corpus / "txt"), str(corpus / "oracle.csv"), "--json-dir", str(docs)]) == 0
    assert (corpus / "oracle.csv").read_bytes() == want
    assert [c["citacao_id"] for c in json.loads((docs / "a.json").read_text(encoding="utf-8"))["citacoes"]] == ["g1", "g2"]
    (docs / "old.json").write_text("{}")
    assert main(["oracle", str(corpus / "gold.csv"), str(corpus / "txt"), str(corpus / "oracle.csv"), "--json-dir", str(docs)]) == 2
    assert main(["predict", str(corpus / "none.db"), str(corpus / "txt"), str(out)]) == 2
    assert "another run" in capsys.readouterr().err
    out.write_text("documento_id,citacoes\na,-\n")
    (corpus / "gold.csv").write_text((corpus / "gold.csv").read_text(encoding="utf-8") + "2,b,g1,0,4,nada,lei,incompleta,\n", encoding="utf-8")
    assert main(["evaluate", str(out), "--gold", str(corpus / "gold.csv")]) == 2


def test_validation_command(spark, corpus):
    import hashlib

    from tessera.__main__ import main

    (corpus / "txt" / "b.txt").unlink()
    assert main(["validate", *[str(corpus / x) for x in ("c.db", "txt", "gold.csv", "families.csv", "report.json")]]) == 0
    told = json.loads((corpus / "report.json").read_text(encoding="utf-8"))
    assert told["provenance"]["document_count"] == 1 and told["provenance"]["database_sha256"] == hashlib.sha256((corpus / "c.db").read_bytes()).hexdigest()
    text = (corpus / "txt" / "a.txt").read_bytes()
    assert told["provenance"]["text_corpus_sha256"] == hashlib.sha256((5).to_bytes(8, "big") + b"a.txt" + len(text).to_bytes(8, "big") + text).hexdigest()
    assert told["headline"]["score"]["generic"] == pytest.approx(1.1, abs=1e-12) and told["headline"]["changed_document_count"] == 0


def test_oracle_faults(spark, corpus):
    docs, labels = readers.texts(spark, str(corpus / "txt")), readers.labels(spark, str(corpus / "gold.csv"))
    assert dict(map(tuple, runs.oracle_submission(labels, docs).collect())) == {"a": "5,14,real,5,1.0000|24,33,inventada,-,1.0000", "b": "-"}
    for wrong in (labels.withColumn("documento_id", F.lit("z")), labels.withColumn("trecho", F.lit("HC 1")), labels.withColumn("id_canonico", F.lit("x1"))):
        with pytest.raises(score.GoldError):
            runs.oracle_citations(wrong, docs)


def test_long_numbers_are_read_whole(spark):
    """A number that starts near the limit and is longer than what is read past it."""
    number = "1 " * 900 + "7"
    rows = spark.createDataFrame([(1, "STJ", 2019, "A", "x " * 190 + "RECURSO ESPECIAL " + number + " fim", "acordao")], "id long, tribunal string, ano int, relator string, texto string, natureza string")
    assert [r["key"] for r in index.number_index(rows).collect()] == ["1" * 900 + "7"]


def test_scratch_tables_ease_the_driver(spark, monkeypatch):
    from tessera import session

    assert session.ease(spark) in (True, False)
    eased = []
    monkeypatch.setattr(session, "ease", lambda spark: eased.append(1))
    assert session.written(spark.range(5), "some").count() == 5 and eased == [1]


def test_scratch_tables_are_deleted(spark):
    from pathlib import Path

    from tessera.session import clear, scratch_root, written

    rows = written(spark.range(5), "some")
    folder = Path(scratch_root(spark).removeprefix("file:").replace("//", "/"))
    assert rows.count() == 5 and list(folder.glob("some-*"))
    other = folder.parent / "other"
    other.mkdir(exist_ok=True)
    clear(spark)
    assert not folder.exists() and other.exists()
    assert written(spark.range(3)).count() == 3


def test_violations(spark):
    docs = spark.createDataFrame([("d", "x" * 30)], "documento_id string, texto string")
    cites = spark.createDataFrame([("d", 0, 10, "real", "x"), ("d", 1, 10, "incompleta", None), ("d", 25, 31, "incompleta", None)], "documento_id string, start int, end int, classification string, canonical_id string")
    assert sorted(r["reason"] for r in resolve.violations(cites, docs).collect()) == ["id", "overlap", "span"]


def test_stream(spark, tmp_path):
    from tessera.streaming.predict import predict_stream, text_stream

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("Cita HC 123456.", encoding="utf-8")
    canonical = spark.createDataFrame([(5, "STJ", 2019, "A", "HABEAS CORPUS Nº 123456", "acordao")], "id long, tribunal string, ano int, relator string, texto string, natureza string")
    running = predict_stream(text_stream(spark, str(folder)), canonical, str(tmp_path / "out"), str(tmp_path / "state"))
    running.awaitTermination(120)
    assert [(r["documento_id"], r["classification"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", "real")]
