"""Views and spans against Python's unicodedata and re."""

import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import patterns as P
from tessera.functions import text as T

TEXTS = ["REsp nº 1.883.715/SP – 2ª Turma", "ação É ß ﬁ № ½ 😀 Ǆ İ", "nfd: é", "𝐀𝐁 ⓐ 한글", "", "\r\n\r\n"]


def view(text):
    other = {" ": " ", "–": "-", "—": "-", "−": "-", "º": "o", "°": "o"}
    out = []
    for c in text:
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        low = c.lower()
        out.append(other.get(c) or (plain if len(plain) == 1 else low if len(low) == 1 else c))
    return "".join(out)


def test_matching_view(spark):
    texts = TEXTS + ["".join(chr(c) for c in range(lo, lo + 200)) for lo in (0xA0, 0x100, 0x1E00, 0x2000, 0xFB00, 0x1D400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.matching_view(F.col("t")).alias("v")).collect()
    for r in rows:
        assert len(r["v"]) == len(r["t"]) and r["v"] == view(r["t"])


def test_short_view(spark):
    rows = spark.createDataFrame([(" Constituição   FEDERAL\n§ 1º – ß ﬁm ", )], "t string").select(T.short_view(F.col("t")).alias("v")).collect()
    assert rows[0]["v"] == "constituicao federal § 1o - ss fim"


def test_short_view_folds_all_of_unicode(spark):
    """Code point by code point, against Python's decomposition and case folding."""
    import unicodedata

    def folded(text):
        text = text.translate({ord(c): "-" for c in "–—−"} | {ord(c): "o" for c in "º°"})
        plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        return " ".join(plain.casefold().split())

    codes = [c for c in range(0x21, 0x110000) if not 0xD800 <= c < 0xE000 and (unicodedata.normalize("NFKD", chr(c)) != chr(c) or chr(c).casefold() != chr(c) or unicodedata.combining(chr(c)))]
    texts = ["a" + "x".join(map(chr, codes[i : i + 50])) + "z" for i in range(0, len(codes), 50)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.short_view(F.col("t")).alias("v")).collect()
    assert [(r["i"], r["v"]) for r in got if r["v"] != folded(texts[r["i"]])][:3] == []


def test_short_view_keeps_the_degree_of_an_expansion(spark):
    rows = spark.createDataFrame([("20 ℃, 5° º ℉ ßﬁ℃",)], "t string").select(T.short_view(F.col("t")).alias("v")).collect()
    assert rows[0]["v"] == "20 °c, 5o o °f ssfi°c"


@pytest.fixture(scope="module")
def spans_of(spark):
    def run(texts, pattern):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.find_spans(F.col("t"), P.flagged(pattern)).alias("s")).orderBy("i").collect()
        return [[(s["start"], s["end"]) for s in r["s"]] for r in rows]

    return run


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab1 .é😀\n", max_size=20), min_size=1, max_size=30))
def test_spans_count_code_points(spans_of, texts):
    pattern = r"a[b1]*|1\.?"
    assert spans_of(texts, pattern) == [[m.span() for m in re.finditer(pattern, t)] for t in texts]


def test_spans_at_the_ends(spans_of):
    assert spans_of(["a", "aa", "xax", "", "x", "😀a😀a"], "a") == [[(0, 1)], [(0, 1), (1, 2)], [(1, 2)], [], [], [(1, 2), (3, 4)]]


def test_body_start(spark):
    texts = ["cabecalho\n\n\ncorpo", "Processo 1\nRelator: X\n RELATÓRIO \r\ncorpo", "Processo 1\nRelatório\ncorpo", "sem nada", "a\n \n\t\nb"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.body_start(F.col("t"), T.matching_view(F.col("t"))).alias("b")).orderBy("i").collect()
    assert [r["b"] for r in rows] == [12, texts[1].index("\ncorpo"), 0, 0, 6]


def test_phrase_end(spark):
    cases = {
        "precedente do STJ de 2018, da relatoria de Maria Silva, no ponto": "precedente do STJ de 2018, da relatoria de Maria Silva",
        "acordao do STF rel. Min. J. Souza de 2019. Depois": "acordao do STF rel. Min. J. Souza de 2019",
        "decisao do TST sobre a materia; fim": "decisao do TST",
        "julgado do STJ para sustentar o pedido": "julgado do STJ",
        "precedente sem fim algum": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("v", T.matching_view(F.col("t"))).select("t", T.phrase_end(F.col("v"), F.lit(0)).alias("e")).collect()
    for r in rows:
        want = cases[r["t"]]
        assert r["e"] == (len(want) if want else None), r["t"]


def test_number_variants(spark):
    cases = {"REsp nº 1.883.7l5/SP": ["1883715"], "HC 12g": ["126", "129"], "HC 12": [], "Súmula 5": [], "RR-1o-g34.12": ["1063412", "1093412"], "HC " + "1g" * 7: [], "REsp 123 / SP": ["123"]}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.number_variants(T.matching_view(F.col("t"))).alias("v")).collect()
    for r in rows:
        assert r["v"] == cases[r["t"]], r["t"]


def test_families_and_keys(spark):
    row = spark.createDataFrame([("agint no agravo em recurso especial", "art. 1.021 do codigo de processo civil", "lei 9.504/1997", "x 007")], "a string, b string, c string, d string")
    got = row.select(T.families(F.col("a")).alias("f"), T.families(F.lit("rec"), F.lit("tst")).alias("t"), T.statute(F.col("b")).alias("s"), T.article(F.col("b")).alias("n"), T.statute(F.col("c")).alias("none"), T.digits_key(F.col("d")).alias("d")).first()
    assert (got["f"], got["t"], got["s"], got["n"], got["none"], got["d"]) == (["aresp", "agint"], ["tst"], "codigo_processo_civil_2015", "1021", None, "7")
