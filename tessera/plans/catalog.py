"""Named queries over the corpora of known answers, each with its SQL counterpart.

The counterparts don't repeat the patterns: they derive what must be found from how a corpus was made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import patterns as P
from tessera.functions import text as T
from tessera.operators import audit, extract, index, resolve, runs, score
from tessera.plans import corpora as C
from tessera.plans import spelled

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = C.duck(sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One small file makes texts for all cores.
    return C.frame(spark, sf_dir, C.BRIEFS).repartition(spark.sparkContext.defaultParallelism)


# ---- text


@query("SELECT doc_id, strip_accents(lower(text)) AS view, length(text) AS n FROM documents WHERE text IS NOT NULL")
def fold_accents(spark, sf_dir):
    view = T.matching_view(F.col("text"))
    return _table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", view.alias("view"), F.char_length(view).cast("long").alias("n"))


@query("SELECT doc_id, trim(regexp_replace(replace(strip_accents(lower(text)), 'ß', 'ss'), '\\s+', ' ', 'g')) AS view FROM documents WHERE text IS NOT NULL")
def short_view(spark, sf_dir):
    return _table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", T.short_view(F.col("text")).alias("view"))


@query("SELECT c_custkey, coalesce(nullif(ltrim(regexp_replace(c_name, '[^0-9]', '', 'g'), '0'), ''), '0') AS key FROM customer")
def digits_key(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", T.digits_key(F.col("c_name")).alias("key"))


@query(f"SELECT id, length(texto) - length(ltrim(texto)) + 20 AS start, 6 + length(CAST(number AS STRING)) - 6 AS n, CAST(number AS STRING) AS token FROM ({C.RECORDS}) r")
def number_tokens(spark, sf_dir):
    rows = C.frame(spark, sf_dir, C.RECORDS)
    spans = rows.withColumn("s", F.explode(T.find_spans(F.col("texto"), "(?U)" + P.NUMBER_TOKEN)))
    return spans.select("id", F.col("s.start").cast("long").alias("start"), (F.col("s.end") - F.col("s.start")).cast("long").alias("n"), T.part(F.col("texto"), F.col("s.start"), F.col("s.end")).alias("token"))


@query(f"SELECT documento_id, CASE WHEN k = 9 THEN length(pre) + length(literal) + 4 WHEN k = 10 THEN 0 ELSE strpos(texto, chr(10) || chr(10) || chr(10)) + 2 END AS body FROM ({C.BRIEFS}) b")
def body_start(spark, sf_dir):
    return _briefs(spark, sf_dir).select("documento_id", T.body_start(F.col("texto"), T.matching_view(F.col("texto"))).cast("long").alias("body"))


@query("""
SELECT o_orderkey, start, "end" FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 6 ELSE 4 END AS start, CASE WHEN o_orderkey % 3 = 0 THEN 6 ELSE 4 END + length(o_orderstatus || CAST(o_orderkey AS STRING)) AS "end" FROM {orders}) t
""")
def trimmed_spans(spark, sf_dir):
    """Spans of ' \\t<status><key> ,;: ' within brackets, trimmed."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 3 == 0, "é[[ \t ").otherwise("é[[ "), "o_orderstatus", F.col("o_orderkey").cast("string"), F.lit(" ,; : ]")).alias("t"))
    span = F.struct(F.lit(3).alias("start"), (F.char_length("t") - 1).alias("end"))
    return rows.select("o_orderkey", T.trimmed(F.col("t"), span).alias("s")).select("o_orderkey", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


# ---- extraction


def _found(kinds: str, kind: str, explicit: str) -> str:
    return f"""SELECT documento_id, length(pre) AS start, length(pre) + length(literal) AS "end", '{kind}' AS kind, '{explicit}' AS explicit_type, literal FROM ({C.BRIEFS}) b WHERE k IN ({kinds})"""


def _spans(rows: DataFrame, items) -> DataFrame:
    rows = rows.withColumn("view", T.matching_view(F.col("texto"))).withColumn("x", F.explode(items(F.col("view"))))
    return rows.select("documento_id", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"), "x.kind", "x.explicit_type", T.part(F.col("texto"), F.col("x.start"), F.col("x.end")).alias("literal"))


def _grammar(name: str, pattern: str, kinds: str) -> None:
    g = next(x for x in extract.GRAMMAR if x[0] == pattern)

    def run(spark, sf_dir):
        return _spans(_briefs(spark, sf_dir), lambda view: extract.explicit_candidates(view, *g))

    run.__name__ = name
    # A case followed by a year in brackets ends before it.
    query(_found(kinds, g[1], g[2]).replace("length(literal) AS", "length(literal) - CASE WHEN k = 11 THEN 18 ELSE 0 END AS").replace(", literal FROM", ", left(literal, length(literal) - CASE WHEN k = 11 THEN 18 ELSE 0 END) AS literal FROM"))(run)


_grammar("law_citations", P.LAW, "1, 10")
_grammar("summary_citations", P.SUMMARY, "2, 6")
_grammar("topic_citations", P.TOPIC, "3")
_grammar("tst_citations", P.TST_CASE, "4")
_grammar("tse_citations", P.TSE_CASE, "5")
_grammar("case_citations", P.CASE, "0, 8, 9, 11")


@query(_found("7", "jurisprudencia", "incomplete"))
def vague_citations(spark, sf_dir):
    return _spans(_briefs(spark, sf_dir), extract.vague_candidates)


@query(f"SELECT documento_id, length(pre) AS start, k = 8 AS distractor FROM ({C.BRIEFS}) b WHERE k IN (0, 8, 9, 11)")
def distractor_filter(spark, sf_dir):
    g = extract.GRAMMAR[-1]
    rows = _briefs(spark, sf_dir).withColumn("view", T.matching_view(F.col("texto"))).withColumn("x", F.explode(extract.explicit_candidates(F.col("view"), *g)))
    return rows.select("documento_id", F.col("x.start").cast("long").alias("start"), extract.is_distractor(F.col("view"), F.col("x")).alias("distractor"))


_ALL = f"""
SELECT documento_id, length(pre) AS start, length(pre) + length(literal) - CASE WHEN k = 11 THEN 18 ELSE 0 END AS "end", CASE WHEN k IN (1, 10) THEN 'lei' ELSE 'jurisprudencia' END AS kind,
  CASE WHEN k IN (1, 10) THEN 'law' WHEN k IN (2, 3, 6) THEN 'sumula' WHEN k = 7 THEN 'incomplete' ELSE 'case' END AS explicit_type, left(literal, length(literal) - CASE WHEN k = 11 THEN 18 ELSE 0 END) AS literal
FROM ({C.BRIEFS}) b WHERE k NOT IN (8, 9)
"""


@query(_ALL)
def extract_citations(spark, sf_dir):
    found = extract.extract(_briefs(spark, sf_dir))
    return found.withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})


@query("""
WITH RECURSIVE s AS (
  SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber * 5, l_partkey, l_extendedprice) AS rk, CAST(l_linenumber * 5 AS INT) AS lo, CAST(l_linenumber * 5 + floor(l_quantity / 5) + 1 AS INT) AS hi, CAST(l_quantity AS INT) AS q
  FROM {lineitem}),
u AS (SELECT doc, lo, hi, q, row_number() OVER (PARTITION BY doc ORDER BY q DESC, hi - lo DESC, lo) AS rk FROM (SELECT DISTINCT doc, lo, hi, q FROM s)),
f AS (
  SELECT doc, 1 AS rk, [lo] AS los, [hi] AS his FROM u WHERE rk = 1
  UNION ALL
  SELECT f.doc, u.rk, CASE WHEN len(list_filter(range(1, len(los) + 1), lambda i: least(his[i], u.hi) > greatest(los[i], u.lo))) = 0 THEN list_append(los, u.lo) ELSE los END,
         CASE WHEN len(list_filter(range(1, len(los) + 1), lambda i: least(his[i], u.hi) > greatest(los[i], u.lo))) = 0 THEN list_append(his, u.hi) ELSE his END
  FROM f JOIN u ON u.doc = f.doc AND u.rk = f.rk + 1),
w AS (SELECT doc, max_by(los, rk) AS los, max_by(his, rk) AS his FROM f GROUP BY doc)
SELECT doc, unnest(los) AS start, unnest(his) AS "end" FROM w
""")
def arbitrate_spans(spark, sf_dir):
    q = F.col("l_quantity")
    item = F.struct((F.col("l_linenumber") * 5).cast("int").alias("start"), (F.col("l_linenumber") * 5 + F.floor(q / 5) + 1).cast("int").alias("end"), F.lit("lei").alias("kind"), F.lit("law").alias("explicit_type"), q.cast("int").alias("priority"))
    rows = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.collect_set(item).alias("items"))
    return rows.select("doc", F.explode(extract.arbitrate(F.col("items"))).alias("x")).select("doc", "x.start", "x.end")


@query(f"SELECT documento_id, length(pre) AS start, length(pre) + length(literal) AS \"end\" FROM ({C.BRIEFS}) b WHERE k NOT IN (8, 9)")
def template_spans(spark, sf_dir):
    rows = _briefs(spark, sf_dir).withColumn("x", F.explode(extract.template_candidates(F.col("texto"), T.matching_view(F.col("texto")))))
    return rows.select("documento_id", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"))


def _spell(values: list, key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} % {len(values)} = {i} THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for i, v in enumerate(values)) + " END"


_CASE_TEXTS = f"SELECT o_orderkey, concat({_spell(spelled.CASES, 'o_orderkey')}, ' n', chr(186), ' ', CAST(100000 + o_orderkey AS STRING), '/SP') AS literal FROM {{orders}}"


@query(f"SELECT CAST(o_orderkey AS STRING) AS documento_id, 14 AS start, 14 + length(literal) AS \"end\", 'case' AS explicit_type, literal FROM ({_CASE_TEXTS}) t")
def case_classes(spark, sf_dir):
    """Every class of cases, through the whole extraction."""
    rows = C.frame(spark, sf_dir, _CASE_TEXTS).select(F.col("o_orderkey").cast("string").alias("documento_id"), F.concat(F.lit("Confira-se o: "), "literal", F.lit(", no ponto em que decide.")).alias("texto"))
    return extract.extract(rows).select("documento_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "explicit_type", "literal")


_TEMPLATE_TEXTS = f"""SELECT o_orderkey, opening, concat('REsp n', chr(186), ' ', CAST(100000 + o_orderkey AS STRING), '/SP') AS literal, ending
FROM (SELECT o_orderkey, {_spell(spelled.OPENINGS, 'o_orderkey')} AS opening, {_spell(spelled.ENDINGS, '(o_orderkey // 37)')} AS ending FROM {{orders}}) u"""


@query(f"SELECT CAST(o_orderkey AS STRING) AS documento_id, length(opening) AS start, length(opening) + length(literal) AS \"end\", 'jurisprudencia' AS kind, 'case' AS explicit_type FROM ({_TEMPLATE_TEXTS}) t")
def template_forms(spark, sf_dir):
    """Every opening with every ending, and the type of what stands between them."""
    rows = C.frame(spark, sf_dir, _TEMPLATE_TEXTS).select(F.col("o_orderkey").cast("string").alias("documento_id"), F.concat("opening", "literal", "ending", F.lit(" do caso")).alias("texto"))
    rows = rows.withColumn("x", F.explode(extract.template_candidates(F.col("texto"), T.matching_view(F.col("texto")))))
    return rows.select("documento_id", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"), "x.kind", "x.explicit_type")


_VAGUE_TEXTS = f"SELECT o_orderkey, {_spell([v for v, _, _ in spelled.VAGUE], 'o_orderkey')} AS literal, {_spell([e for _, e, _ in spelled.VAGUE], 'o_orderkey')} AS ending, {_spell([w for _, _, w in spelled.VAGUE], 'o_orderkey')} AS whole FROM {{orders}}"


@query(f"SELECT CAST(o_orderkey AS STRING) AS documento_id, 12 AS start, 12 + length(literal) AS \"end\", 'incomplete' AS explicit_type, literal FROM ({_VAGUE_TEXTS}) t WHERE whole")
def vague_forms(spark, sf_dir):
    """References without a number: named by court or class, ended by each kind of phrase end, or lacking a part and so none."""
    rows = C.frame(spark, sf_dir, _VAGUE_TEXTS).select(F.col("o_orderkey").cast("string").alias("documento_id"), F.concat(F.lit("Confira-se: "), "literal", "ending", F.lit(" o mais.")).alias("texto"))
    return extract.extract(rows).select("documento_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "explicit_type", "literal")


# ---- keys and indexes


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN list_sort(['12' || d || '934', '12' || d || '634']) ELSE ['1' || d || '05'] END AS variants
FROM (SELECT o_orderkey, CAST(o_orderkey % 1000 + 100 AS STRING) AS d FROM {orders}) t
""")
def ocr_variants(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 1000 + 100).cast("string").alias("d"))
    literal = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("REsp nº 12."), "d", F.lit("-g34/SP"))).otherwise(F.concat(F.lit("HC 1"), "d", F.lit("os (RJ)")))
    return rows.select("o_orderkey", T.number_variants(T.matching_view(literal)).alias("variants"))


_CLASSES = [("Recurso Especial Eleitoral", "respe"), ("Agravo em Recurso Especial", "aresp"), ("R.Esp.", "resp"), ("RHC", "rhc"), ("Reclamação", "rcl"), ("RMS", "rms"), ("Apelação", "apl"), ("HC", "hc"), ("Recurso Extraordinário", "re"), ("AgInt na Suspensão de Liminar e de Sentença", "agint,sls"), ("TST-RR", "tst"), ("R-Rp", "rp"), ("ação rescisória", "ar")]


def _class_case(column: str, at: int) -> str:
    return "CASE " + " ".join(f"WHEN {column} % {len(_CLASSES)} = {i} THEN '{x[at]}'" for i, x in enumerate(_CLASSES)) + " END"


@query(f"SELECT o_orderkey, {_class_case('o_orderkey', 1)} AS families FROM {{orders}}")
def families(spark, sf_dir):
    literal = F.concat(F.expr(_class_case("o_orderkey", 0)), F.when(F.col("o_orderkey") % 13 >= 10, F.lit("-")).otherwise(F.lit("")), F.lit(" nº "), F.col("o_orderkey").cast("string"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(T.families(T.matching_view(literal)), ",").alias("families"))


@query(f"""SELECT documento_id, CASE k WHEN 1 THEN 'codigo_processo_civil_2015' WHEN 10 THEN 'constituicao_federal' END AS statute, CASE WHEN k IN (1, 10) THEN CAST(a AS STRING) END AS article FROM ({C.BRIEFS}) b""")
def law_key(spark, sf_dir):
    rows = _briefs(spark, sf_dir).select("documento_id", "literal")
    keys = resolve.law_keys(rows.select("literal").distinct())
    return rows.join(keys, "literal").select("documento_id", "statute", "article")


_LAWS = f"(SELECT * FROM ({C.RULES}) x WHERE natureza = 'dispositivo')"
_SUMS = f"(SELECT * FROM ({C.RULES}) x WHERE natureza = 'sumula')"


def _rules(spark, sf_dir) -> DataFrame:
    return C.frame(spark, sf_dir, C.RULES).select("id", "tribunal", "texto", "natureza", "diploma", "numero")


@query(f"SELECT statute, article, array_to_string(list_sort(list(DISTINCT id)), ',') AS ids FROM {_LAWS} r WHERE statute IS NOT NULL AND article IS NOT NULL GROUP BY ALL")
def law_index(spark, sf_dir):
    return index.law_index(_rules(spark, sf_dir)).select("statute", "article", F.array_join("ids", ",").alias("ids"))


@query(f"SELECT court, number, array_to_string(list_sort(list(DISTINCT id)), ',') AS ids FROM {_SUMS} r WHERE court IS NOT NULL AND number IS NOT NULL GROUP BY ALL")
def summary_index(spark, sf_dir):
    return index.summary_index(_rules(spark, sf_dir)).select("court", "number", F.array_join("ids", ",").alias("ids"))


_RECOVERED = [*((i, "dispositivo", "diploma", s) for i, _, s, _ in C.WORDING), *((i, "sumula", "numero", n) for i, _, n, _ in C.SUMMARY_WORDING)]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{a}', '{b}', '{v}', 'canonical_text_signature')" for i, a, b, v in _RECOVERED) + ") t(id, nature, field, \"value\", method)")
def recoveries(spark, sf_dir):
    return index.recoveries(_rules(spark, sf_dir))


@query(f"""
SELECT id, 'dispositivo' AS nature, concat_ws(',', CASE WHEN article IS NULL THEN 'artigo' END, CASE WHEN statute IS NULL THEN 'diploma' END) AS missing FROM {_LAWS} r WHERE article IS NULL OR statute IS NULL
UNION ALL SELECT id, 'sumula', concat_ws(',', CASE WHEN court IS NULL THEN 'tribunal' END, CASE WHEN number IS NULL THEN 'numero' END) FROM {_SUMS} r WHERE court IS NULL OR number IS NULL
""")
def unindexed(spark, sf_dir):
    return index.unindexed(_rules(spark, sf_dir)).select("id", "nature", F.array_join("missing", ",").alias("missing"))


@query(f"SELECT CAST(number AS STRING) AS key, id, 20 + pad AS position, tribunal, ano AS year, relator AS reporter, CASE WHEN tribunal = 'TST' THEN 'tst,resp' ELSE 'resp' END AS families FROM ({C.RECORDS}) r")
def number_index(spark, sf_dir):
    rows = index.number_index(C.frame(spark, sf_dir, C.RECORDS))
    return rows.select("key", "id", F.col("position").cast("long").alias("position"), "tribunal", "year", "reporter", F.array_join("families", ",").alias("families"))


# ---- resolution


@query(f"""
WITH one AS (SELECT article, min(id) AS id FROM {_LAWS} r WHERE statute = 'codigo_civil' AND article IS NOT NULL GROUP BY article HAVING count(DISTINCT id) = 1)
SELECT p_partkey, one.id AS canonical_id FROM {{part}} LEFT JOIN one ON one.article = CAST(p_partkey + 10 AS STRING)
""")
def resolve_law(spark, sf_dir):
    parts = _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("artigo "), (F.col("p_partkey") + 10).cast("string"), F.lit("º, inciso II, do Códig0 Civil")).alias("literal"))
    return parts.join(resolve.resolve_laws(parts.select("literal").distinct(), index.law_index(_rules(spark, sf_dir))), "literal", "left").select("p_partkey", "canonical_id")


@query(f"""
WITH s AS (SELECT DISTINCT court, number, id FROM {_SUMS} r WHERE court IS NOT NULL AND number IS NOT NULL),
one AS (SELECT court, number, min(id) AS id FROM s GROUP BY ALL HAVING count(*) = 1), any1 AS (SELECT number, min(id) AS id FROM s GROUP BY ALL HAVING count(*) = 1),
q AS (SELECT p_partkey, p_partkey % 5 AS form, CAST(1 + p_partkey % 90 AS STRING) AS n FROM {{part}})
SELECT p_partkey, CASE form WHEN 0 THEN a.id WHEN 1 THEN b.id WHEN 2 THEN c.id WHEN 3 THEN d.id END AS canonical_id
FROM q LEFT JOIN one a ON a.court = 'stj' AND a.number = q.n LEFT JOIN one b ON b.court = 'stf' AND b.number = q.n LEFT JOIN any1 c ON c.number = q.n LEFT JOIN one d ON d.court = 'tst' AND d.number = q.n
""")
def resolve_summary(spark, sf_dir):
    """Forms: named court, binding (of the STF), no court, misread digits, and binding of another court (none)."""
    n = (1 + F.col("p_partkey") % 90).cast("string")
    form = F.col("p_partkey") % 5
    literal = (
        F.when(form == 0, F.concat(F.lit("Súmula nº "), n, F.lit(" do STJ"))).when(form == 1, F.concat(F.lit("Súmula Vinculante "), n)).when(form == 2, F.concat(F.lit("5umula "), n))
        .when(form == 3, F.concat(F.lit("SÚMULA "), F.translate(n, "150", "lso"), F.lit(" do TST"))).otherwise(F.concat(F.lit("Súmula vinculante "), n, F.lit(" do STJ")))
    )
    parts = _table(spark, sf_dir, "part").select("p_partkey", literal.alias("literal"))
    return parts.join(resolve.resolve_summaries(parts.select("literal").distinct(), index.summary_index(_rules(spark, sf_dir))), "literal", "left").select("p_partkey", "canonical_id")


_CASES = f"""
SELECT number, CASE WHEN count(DISTINCT (tribunal, ano, lower(relator))) > 1 THEN 'incompleta' ELSE 'real' END AS classification, min(id) AS id FROM ({C.RECORDS}) r GROUP BY number
"""


@query(f"WITH r AS ({_CASES}) SELECT o_orderkey, coalesce(classification, 'inventada') AS classification, CASE WHEN classification = 'real' THEN r.id END AS canonical_id FROM ({C.CASE_LITERALS}) l LEFT JOIN r ON r.number = l.number")
def resolve_case(spark, sf_dir):
    """A citation of every order's number, misread as in CASE_LITERALS, whose own texts all start with a 1 and so cite other numbers from 200000 on."""
    digits, form = F.col("number").cast("string"), F.col("o_orderkey") % 5
    rest = F.substring(digits, 2, 20)
    misread = F.when(form == 0, F.translate(rest, "1", "l")).when(form == 1, F.translate(rest, "0", "o")).otherwise(rest)
    literals = C.frame(spark, sf_dir, C.CASE_LITERALS).select("o_orderkey", F.concat(F.lit("REsp nº "), F.substring(digits, 1, 1), misread).alias("literal"))
    answers = resolve.resolve_cases(literals.select("literal").distinct(), index.number_index(C.frame(spark, sf_dir, C.RECORDS)))
    # An order without a key has no text, and no answer.
    return literals.join(answers, "literal", "left").select("o_orderkey", F.coalesce("classification", F.lit("inventada")).alias("classification"), "canonical_id")


def _canonical(spark, sf_dir) -> DataFrame:
    cases = C.frame(spark, sf_dir, C.RECORDS).select("id", "tribunal", "ano", "relator", "texto", "natureza")
    return cases.unionByName(_rules(spark, sf_dir), allowMissingColumns=True)


@query(f"""
WITH c AS ({_CASES}), b AS ({C.BRIEFS}),
s AS (SELECT DISTINCT court, number, id FROM {_SUMS} r WHERE court IS NOT NULL AND number IS NOT NULL),
stj AS (SELECT number, min(id) AS id FROM s WHERE court = 'stj' GROUP BY number HAVING count(*) = 1), every AS (SELECT number, min(id) AS id FROM s GROUP BY number HAVING count(*) = 1),
cpc AS (SELECT article, min(id) AS id FROM {_LAWS} r WHERE statute = 'codigo_processo_civil_2015' AND article IS NOT NULL GROUP BY article HAVING count(DISTINCT id) = 1),
cf AS (SELECT article, min(id) AS id FROM {_LAWS} r WHERE statute = 'constituicao_federal' AND article IS NOT NULL GROUP BY article HAVING count(DISTINCT id) = 1),
f AS (
  SELECT b.*, CASE k WHEN 1 THEN cpc.id WHEN 2 THEN stj.id WHEN 6 THEN e6.id WHEN 10 THEN cf.id END AS rule_id, c.classification AS cls, c.id AS case_id
  FROM b LEFT JOIN c ON c.number = b.n AND k = 0 LEFT JOIN stj ON stj.number = CAST(a AS STRING) LEFT JOIN every e6 ON e6.number = CAST(1000 + a AS STRING)
  LEFT JOIN cpc ON cpc.article = CAST(a AS STRING) LEFT JOIN cf ON cf.article = CAST(a AS STRING))
SELECT documento_id, length(pre) AS start, CASE WHEN k IN (1, 10) THEN 'lei' ELSE 'jurisprudencia' END AS kind,
  CASE WHEN k = 7 THEN 'incompleta' WHEN k = 0 THEN coalesce(cls, 'inventada') WHEN rule_id IS NOT NULL THEN 'real' ELSE 'inventada' END AS classification,
  CAST(CASE WHEN k = 0 THEN CASE WHEN cls = 'real' THEN case_id END ELSE rule_id END AS STRING) AS canonical_id, 1.0::DOUBLE AS confidence
FROM f WHERE k NOT IN (8, 9)
""")
def classify_citations(spark, sf_dir):
    """Texts to classes, end to end. Numbers that only records of other families have (k = 4, 5, 11) are `inventada`."""
    return resolve.predict(_briefs(spark, sf_dir), _canonical(spark, sf_dir)).select("documento_id", F.col("start").cast("long").alias("start"), "kind", "classification", "canonical_id", "confidence")


# ---- cells and scores


def _gold_frame(spark, sf_dir) -> DataFrame:
    return C.golds(spark, sf_dir)


def _preds_frame(spark, sf_dir) -> DataFrame:
    return C.preds(spark, sf_dir).withColumnsRenamed({"end_": "end"})


_CELLS = f"""{C.PAIRS}
SELECT documento_id, string_agg(concat_ws(',', start, end_, classe, coalesce(id, '-'), CASE WHEN conf IS NULL THEN '-' ELSE printf('%.4f', conf) END), '|' ORDER BY start, end_) AS citacoes FROM p GROUP BY documento_id"""


def _encoded(spark, sf_dir) -> DataFrame:
    return score.encode(_preds_frame(spark, sf_dir).withColumnsRenamed({"classe": "classification", "id": "canonical_id", "conf": "confidence"}))


@query(_CELLS)
def encode_cells(spark, sf_dir):
    return _encoded(spark, sf_dir)


@query(f"{C.PAIRS} SELECT documento_id, row_number() OVER (PARTITION BY documento_id ORDER BY start, end_) - 1 AS pos, start, end_ AS \"end\", classe, id, conf, CAST(NULL AS STRING) AS error FROM p")
def parse_cells(spark, sf_dir):
    return score.parse_submission(_encoded(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


_FAULTS = ["fields", "offset", "span", "class", "no id", "id", "confidence", "confidence range", None, None]
_BAD = ["1,2,real,3", "x,2,real,3,1", "5,5,real,3,1", "1,2,falsa,3,1", "1,2,real,-,1", "1,2,real,3a,1", "1,2,real,3,alta", "1,2,real,3,1.5", " 1 , 2 , REAL , 007 , - ", "-"]


def _pick(values: list, column: str) -> str:
    quoted = ["NULL" if v is None else "'" + v + "'" for v in values]
    return "CASE " + " ".join(f"WHEN {column} % {len(values)} = {i} THEN {q}" for i, q in enumerate(quoted)) + " END"


@query(f"SELECT CAST(p_partkey AS STRING) AS documento_id, {_pick(_FAULTS, 'p_partkey')} AS error, CASE WHEN p_partkey % 10 = 8 THEN '7' END AS id FROM {{part}} WHERE p_partkey % 10 <> 9")
def invalid_cells(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("documento_id"), F.expr(_pick(_BAD, "p_partkey")).alias("citacoes"))
    return score.parse_submission(rows).select("documento_id", "error", F.when(F.col("error").isNull(), F.col("id")).alias("id"))


@query(f"{C.PAIRS} SELECT documento_id, nivel, string_agg(concat_ws(',', inicio, fim, classificacao, coalesce(id_canonico, '-')), '|' ORDER BY inicio, fim) AS citacoes FROM g GROUP BY ALL")
def gold_cells(spark, sf_dir):
    from tessera.sources.readers import solution

    return solution(_gold_frame(spark, sf_dir))


@query(f"{C.PAIRS} SELECT documento_id, nivel, inicio AS start, fim AS \"end\", classificacao AS classe, coalesce(id_canonico, '') AS ids FROM g")
def parse_solution_cells(spark, sf_dir):
    return score.parse_solution(gold_cells(spark, sf_dir)).select("documento_id", "nivel", "start", "end", "classe", F.array_join("ids", ":").alias("ids"))


_NEAR = """
m AS (
  SELECT g.*, p.start, p.end_, p.classe, p.id, p.conf, p.no, greatest(0, least(fim, end_) - greatest(inicio, start)) AS inter, (fim - inicio) + (end_ - start) - greatest(0, least(fim, end_) - greatest(inicio, start)) AS uni
  FROM g JOIN p USING (documento_id) WHERE least(fim, end_) > greatest(inicio, start)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY inter / uni DESC, start, end_) AS rk FROM m WHERE 2 * inter >= uni) WHERE rk = 1)
"""


@query(f"{C.PAIRS}, {_NEAR} SELECT documento_id, inicio, start, inter, uni AS union_size FROM m WHERE 2 * inter >= uni")
def iou_pairs(spark, sf_dir):
    both = _gold_frame(spark, sf_dir).join(_preds_frame(spark, sf_dir).select("documento_id", "start", "end"), "documento_id")
    inter = F.least("fim", "end") - F.greatest("inicio", "start")
    both = both.withColumn("inter", inter).withColumn("union_size", F.col("fim") - F.col("inicio") + F.col("end") - F.col("start") - F.col("inter"))
    return both.filter("inter > 0 AND 2 * inter >= union_size").select("documento_id", "inicio", "start", "inter", "union_size")


def _documents(spark, sf_dir) -> DataFrame:
    golds = score.parse_solution(gold_cells(spark, sf_dir))
    return score.documents(golds, score.parse_submission(_encoded(spark, sf_dir)), ["documento_id"])


def _events(spark, sf_dir) -> DataFrame:
    return score.events(_documents(spark, sf_dir), ["documento_id"])


@query(f"{C.PAIRS}, {_NEAR} SELECT documento_id, inicio, start FROM best")
def greedy_match(spark, sf_dir):
    rows = _documents(spark, sf_dir).withColumn("x", F.explode("pairs"))
    at = lambda xs, i: F.filter(xs, lambda y: y["i"] == i)[0]["start"]
    return rows.select("documento_id", at("golds", F.col("x.gi")).alias("inicio"), at("preds", F.col("x.pi")).alias("start"))


@query(f"{C.PAIRS}, {_NEAR} SELECT documento_id, 'gold' AS side, inicio AS start FROM g WHERE rn NOT IN (SELECT rn FROM best) UNION ALL SELECT p.documento_id, 'pred', p.start FROM p WHERE (p.rn, p.no) NOT IN (SELECT (rn, no) FROM best)")
def unmatched(spark, sf_dir):
    rows = _documents(spark, sf_dir)
    lone = lambda side, name, key: rows.select("documento_id", F.lit(side).alias("side"), F.explode(F.filter(name, lambda x: ~F.exists("pairs", lambda y: y[key] == x["i"]))).alias("x")).select("documento_id", "side", "x.start")
    return lone("gold", "golds", "gi").unionByName(lone("pred", "preds", "pi"))


@query(f"{C.PAIRS}, {_NEAR}, lone AS (SELECT * FROM p WHERE (rn, no) NOT IN (SELECT (rn, no) FROM best)) SELECT l.documento_id, l.start FROM lone l WHERE EXISTS (SELECT 1 FROM best b WHERE b.documento_id = l.documento_id AND greatest(0, least(b.fim, l.end_) - greatest(b.inicio, l.start)) >= 0.9 * (l.end_ - l.start))")
def extra_contained(spark, sf_dir):
    rows = _documents(spark, sf_dir)
    met = F.filter("golds", lambda g: F.exists("pairs", lambda y: y["gi"] == g["i"]))
    rows = rows.select("documento_id", met.alias("met"), F.explode(F.filter("preds", lambda x: ~F.exists("pairs", lambda y: y["pi"] == x["i"]))).alias("x"))
    inside = F.exists("met", lambda g: F.least(g["end"], F.col("x.end")) - F.greatest(g["start"], F.col("x.start")) >= P.CONTAINED_SHARE * (F.col("x.end") - F.col("x.start")))
    return rows.filter(inside).select("documento_id", "x.start")


_EVENTS = f"""{C.PAIRS}, {_NEAR},
lone AS (SELECT * FROM p WHERE (rn, no) NOT IN (SELECT (rn, no) FROM best) AND NOT EXISTS (SELECT 1 FROM best b WHERE b.documento_id = p.documento_id AND greatest(0, least(b.fim, p.end_) - greatest(b.inicio, p.start)) >= 0.9 * (p.end_ - p.start))),
x AS (SELECT *, classificacao = classe AND (classe <> 'real' OR id = id_canonico) AS ok, classificacao = classe AS same FROM best),
e AS (
  SELECT documento_id, nivel, classificacao AS classe, 0 AS tp, 0 AS fp, 0 AS fn, 1 AS suporte, 0 AS grave, (classificacao = 'inventada')::INT AS invented, NULL::DOUBLE AS brier FROM g
  UNION ALL SELECT documento_id, nivel, classificacao, ok::INT, 0, (NOT same)::INT, 0, 0, 0, NULL FROM x
  UNION ALL SELECT documento_id, nivel, classe, 0, (NOT ok)::INT, 0, 0, (classificacao = 'inventada' AND classe = 'real')::INT, 0, (conf - ok::INT) ** 2 FROM x
  UNION ALL SELECT documento_id, nivel, classificacao, 0, 0, 1, 0, 0, 0, NULL FROM g WHERE rn NOT IN (SELECT rn FROM best)
  UNION ALL SELECT lone.documento_id, nivel, classe, 0, 1, 0, 0, 0, 0, NULL FROM lone JOIN (SELECT DISTINCT documento_id, nivel FROM g) d ON d.documento_id = lone.documento_id),
c AS (SELECT nivel, classe, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(suporte) AS suporte, sum(grave) AS grave, sum(invented) AS invented, sum(brier) AS brier_sum, count(brier) AS brier_n FROM e GROUP BY ALL),
l AS (SELECT nivel, avg(CASE WHEN suporte > 0 THEN 2 * tp / (2 * tp + fp + fn) END) AS macro_f1, sum(grave) / sum(invented) AS tau, sum(brier_sum) / sum(brier_n) AS brier FROM c GROUP BY nivel),
s AS (SELECT *, macro_f1 * (1 - 0.5 * tau) * (1 + 0.1 * (1 - brier)) AS score FROM l)"""


@query(f"{_EVENTS} SELECT nivel, classe, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, suporte::BIGINT AS suporte FROM c")
def confusion(spark, sf_dir):
    return score.confusion(_events(spark, sf_dir), [])


def _levels(spark, sf_dir) -> DataFrame:
    return score.level_scores(_events(spark, sf_dir), [])


@query(f"{_EVENTS} SELECT nivel, round(macro_f1, 10) AS macro_f1 FROM l")
def macro_f1(spark, sf_dir):
    return _levels(spark, sf_dir).select("nivel", F.round("macro_f1", 10).alias("macro_f1"))


@query(f"{_EVENTS} SELECT nivel, round(tau, 10) AS tau FROM l")
def tau(spark, sf_dir):
    return _levels(spark, sf_dir).select("nivel", F.round("tau", 10).alias("tau"))


@query(f"{_EVENTS} SELECT nivel, round(brier, 10) AS brier, round(0.1 * (1 - brier), 10) AS bonus FROM l")
def brier_bonus(spark, sf_dir):
    return _levels(spark, sf_dir).select("nivel", F.round("brier", 10).alias("brier"), F.round("b", 10).alias("bonus"))


@query(f"{_EVENTS} SELECT nivel, round(score, 10) AS score FROM s")
def level_scores(spark, sf_dir):
    return _levels(spark, sf_dir).select("nivel", F.round("score", 10).alias("score"))


@query(f"{_EVENTS} SELECT round(sum(nivel * score) / sum(nivel), 10) AS score_final FROM s")
def final_score(spark, sf_dir):
    return score.final_scores(_levels(spark, sf_dir), []).select(F.round("score_final", 10).alias("score_final"))


@query("SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey FROM {orders} GROUP BY o_custkey")
def dedup_keep_first(spark, sf_dir):
    return score.first_rows(_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0)")
def missing_rows(spark, sf_dir):
    some = _table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return _table(spark, sf_dir, "customer").join(some, "c_custkey", "left_anti").select("c_custkey")


@query(f"{C.PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY documento_id ORDER BY start, end_) AS rk FROM p) SELECT DISTINCT b.documento_id, b.start, b.end_ AS \"end\" FROM n a JOIN n b ON a.documento_id = b.documento_id AND a.rk < b.rk WHERE least(a.end_, b.end_) > greatest(a.start, b.start)")
def overlap_violations(spark, sf_dir):
    """Predictions that overlap an earlier one at all."""
    return resolve.overlapping(_preds_frame(spark, sf_dir).select("documento_id", "start", "end"), ["documento_id"], 1e-9)


# ---- audit


@query(f"{C.PAIRS} SELECT documento_id FROM p WHERE start % 7 = 0 GROUP BY documento_id")
def changed_documents(spark, sf_dir):
    """A second predictor that widens every prediction whose start is a multiple of seven."""
    preds = _preds_frame(spark, sf_dir).withColumnsRenamed({"classe": "classification", "id": "canonical_id", "conf": "confidence"})
    return audit.changed(score.encode(preds), score.encode(preds.withColumn("end", F.col("end") + F.when(F.col("start") % 7 == 0, 1).otherwise(0))))


@query("SELECT CAST(c_custkey AS STRING) AS documento_id, CASE WHEN c_custkey % 10 = 0 THEN 'duplicados' WHEN c_custkey % 10 = 1 THEN 'sem_familia' ELSE 'fora_do_gold' END AS fault FROM customer WHERE c_custkey % 10 IN (0, 1, 2)")
def partition_check(spark, sf_dir):
    ids = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("documento_id"), F.col("c_mktsegment").alias("family"))
    fams = ids.filter("c_custkey % 10 <> 1").unionByName(ids.filter("c_custkey % 10 = 0").withColumn("family", F.lit("other")))
    return audit.partition_faults(fams.select("documento_id", "family"), ids.filter("c_custkey % 10 <> 2"))


@query("SELECT CAST(c_custkey AS STRING) AS documento_id, CASE WHEN c_custkey % 7 = 0 THEN 'gold' ELSE 'text' END AS side FROM customer WHERE c_custkey % 7 IN (0, 1)")
def coverage_check(spark, sf_dir):
    ids = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("documento_id"))
    return audit.uncovered(ids.filter("c_custkey % 7 <> 1"), ids.filter("c_custkey % 7 <> 0"))


@query(f"SELECT documento_id, length(pre) AS inicio, length(pre) + length(literal) AS fim FROM ({C.BRIEFS}) b WHERE k = 3")
def literal_check(spark, sf_dir):
    """Labels of which one in twelve has a wrong literal, and with a line end written as \\n."""
    rows = _briefs(spark, sf_dir)
    gold = rows.select("documento_id", F.char_length("pre").cast("long").alias("inicio"), (F.char_length("pre") + F.char_length("literal")).cast("long").alias("fim"), F.when(F.col("k") == 3, F.lit("outro")).otherwise(F.replace("literal", F.lit("\n"), F.lit("\\n"))).alias("trecho"))
    return audit.wrong_literals(gold, rows)


@query(f"{C.PAIRS} SELECT nivel, count(*) AS citations, count(*) FILTER (classificacao = 'real') AS \"real\", count(*) FILTER (classificacao = 'inventada') AS inventada, count(*) FILTER (classificacao = 'incompleta') AS incompleta FROM g GROUP BY nivel")
def support(spark, sf_dir):
    return audit.support(_gold_frame(spark, sf_dir), ["nivel"])


@query(f"""{C.PAIRS}, a AS (SELECT DISTINCT nivel, documento_id, inicio AS s, fim AS e FROM g), b AS (SELECT DISTINCT nivel, p.documento_id, start AS s, end_ AS e FROM p JOIN (SELECT DISTINCT documento_id, nivel FROM g) d USING (documento_id)),
n AS (SELECT nivel, count(*) FILTER (a.s IS NOT NULL AND b.s IS NOT NULL) AS tp, count(*) FILTER (a.s IS NULL) AS fp, count(*) FILTER (b.s IS NULL) AS fn FROM a FULL JOIN b USING (nivel, documento_id, s, e) GROUP BY nivel)
SELECT nivel, tp AS true_positive, fp AS false_positive, fn AS false_negative, round(tp / (tp + fp), 10) AS precision, round(tp / (tp + fn), 10) AS recall, round(2 * tp / (2 * tp + fp + fn), 10) AS f1 FROM n""")
def exact_span_prf(spark, sf_dir):
    gold = _gold_frame(spark, sf_dir).select("nivel", "documento_id", F.col("inicio").alias("start"), F.col("fim").alias("end"))
    preds = _preds_frame(spark, sf_dir).join(gold.select("documento_id", "nivel").distinct(), "documento_id").select("nivel", "documento_id", "start", "end")
    rows = audit.exact_spans(gold, preds, ["nivel"])
    return rows.withColumns({c: F.round(c, 10) for c in ("precision", "recall", "f1")})


@query("""
SELECT c_mktsegment AS mode, round(avg(x), 6) AS macro_family_score, round(stddev_pop(x), 6) AS population_stddev, min_by(family, (x, family)) AS worst_family, min(x) AS worst_family_score, max(x) AS best_family_score, count(*) AS family_count
FROM (SELECT c_mktsegment, CAST(c_nationkey AS STRING) AS family, max(floor(c_acctbal / 1000)) AS x FROM customer GROUP BY ALL) t GROUP BY ALL
""")
def family_summary(spark, sf_dir):
    scores = _table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("mode"), F.col("c_nationkey").cast("string").alias("family")).agg(F.max(F.floor(F.col("c_acctbal") / 1000)).cast("double").alias("score_final"))
    return audit.family_summary(scores, ["mode"]).withColumns({c: F.round(c, 6) for c in ("macro_family_score", "population_stddev")})


@query("SELECT CAST(o_custkey AS STRING) AS documento_id, count(DISTINCT o_orderstatus) AS levels FROM {orders} GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) <> 1")
def level_consistency(spark, sf_dir):
    return audit.inconsistent_levels(_table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("documento_id"), F.col("o_orderstatus").alias("nivel")))


_FAMILY = "concat('f', CAST(CAST(substring(documento_id, 2, 9) AS BIGINT) % 5 AS STRING))"


@query(f"""{_EVENTS.split('c AS (SELECT nivel')[0]}
z AS (SELECT {_FAMILY} AS family, * FROM e UNION ALL SELECT 'overall', * FROM e),
c AS (SELECT family, nivel, classe, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(suporte) AS suporte, sum(grave) AS grave, sum(invented) AS invented, sum(brier) AS brier_sum, count(brier) AS brier_n FROM z GROUP BY ALL),
l AS (SELECT family, nivel, avg(CASE WHEN suporte > 0 THEN 2 * tp / (2 * tp + fp + fn) END) AS macro_f1, coalesce(sum(grave) / nullif(sum(invented), 0), 0) AS tau, sum(brier_sum) / nullif(sum(brier_n), 0) AS brier FROM c GROUP BY ALL HAVING macro_f1 IS NOT NULL),
s AS (SELECT *, macro_f1 * (1 - 0.5 * tau) * (1 + coalesce(0.1 * (1 - brier), 0)) AS score FROM l)
SELECT family, 'a' AS mode, round(sum(nivel * score) / sum(nivel), 10) AS score_final FROM s GROUP BY family""")
def family_scores(spark, sf_dir):
    """All slices of a predictor's score from one matching."""
    solution = gold_cells(spark, sf_dir)
    cells = solution.select("documento_id").join(_encoded(spark, sf_dir), "documento_id", "left").fillna("-", ["citacoes"])
    rows = audit.sliced_scores(solution, cells.withColumn("mode", F.lit("a")), solution.select("documento_id", F.expr(_FAMILY).alias("family")))
    return rows.withColumn("score_final", F.round("score_final", 10))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def file_hashes(spark, sf_dir):
    return _table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.encode("text", "utf-8").alias("content")).select("doc_id", audit.file_hash().alias("digest"))


@query("""
SELECT sha256(unhex(string_agg(printf('%016x', strlen(CAST(doc_id AS STRING))) || hex(CAST(doc_id AS STRING)) || printf('%016x', strlen(text)) || hex(text), '' ORDER BY CAST(doc_id AS STRING)))) AS corpus_sha256
FROM documents WHERE text IS NOT NULL
""")
def corpus_hash(spark, sf_dir):
    """Every text of documents as a file, named by its id."""
    files = _table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("name"), F.encode("text", "utf-8").alias("content"))
    return audit.corpus_hash(files)


_LABELS = "SELECT documento_id, concat('g', CAST(k AS STRING)) AS citacao_id, length(pre) AS inicio, length(pre) + length(literal) AS fim, literal AS trecho, CASE WHEN k IN (1, 10) THEN 'lei' ELSE 'jurisprudencia' END AS tipo, " \
    "CASE WHEN k % 3 = 0 THEN 'real' WHEN k % 3 = 1 THEN 'inventada' ELSE 'incompleta' END AS classificacao, CASE WHEN k % 3 < 2 THEN CAST(n AS STRING) END AS id_canonico FROM (" + C.BRIEFS + ") b WHERE k <> 9"


@query(f"""SELECT documento_id, concat_ws(',', inicio, fim, classificacao, CASE WHEN classificacao = 'real' THEN id_canonico ELSE '-' END, '1.0000') AS citacoes FROM ({_LABELS}) g
UNION ALL SELECT documento_id, '-' FROM ({C.BRIEFS}) b WHERE k = 9""")
def oracle_submission(spark, sf_dir):
    """Labels to a submission, by way of contract documents; texts without labels have an empty cell."""
    return runs.oracle_submission(C.frame(spark, sf_dir, _LABELS), _briefs(spark, sf_dir))


@query(f"SELECT documento_id, CASE WHEN k IN (8, 9) THEN 0 ELSE 1 END AS citations FROM ({C.BRIEFS}) b")
def predict_submission(spark, sf_dir):
    """Texts to the checked cells of a submission."""
    cells = runs.predict_submission(_briefs(spark, sf_dir), _canonical(spark, sf_dir))
    return cells.select("documento_id", F.when(F.col("citacoes") == "-", 0).otherwise(F.size(F.split("citacoes", r"\|"))).alias("citations"))


@query(f"""SELECT documento_id, 1 AS citations, length(pre) AS inicio FROM ({C.BRIEFS}) b WHERE k NOT IN (8, 9) UNION ALL SELECT documento_id, 0, NULL FROM ({C.BRIEFS}) b WHERE k IN (8, 9)""")
def contract_documents(spark, sf_dir):
    """Predictions to contract JSON and back through the converter."""
    from tessera.sources import readers, sinks

    briefs = _briefs(spark, sf_dir)
    documents = sinks.contract(briefs, resolve.predict(briefs, _canonical(spark, sf_dir)))
    parsed = documents.select(F.from_json("json", readers.CONTRACT).alias("d")).select("d.*")
    cells = readers.contract_cells(parsed)
    start = F.split(F.nullif("citacoes", F.lit("-")), ",")[0].cast("long")
    return cells.select("documento_id", F.when(F.col("citacoes") == "-", 0).otherwise(F.size(F.split("citacoes", r"\|"))).alias("citations"), start.alias("inicio"))
