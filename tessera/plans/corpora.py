"""Corpora whose answers are known by construction, made from the star-schema tables.

Each is one SQL text that Spark and DuckDB read alike; {table} names are filled in for either.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: k = o_orderkey % 12 picks the form of the citation; pre + literal + post is the text.
BRIEFS = r"""
SELECT documento_id, k, n, a, concat(head, lead) AS pre, literal, concat(head, lead, literal, tail) AS texto
FROM (
  SELECT documento_id, k, n, a,
    CASE WHEN k = 9 THEN '' WHEN k = 10 THEN 'Sem cabecalho. ' ELSE concat('Processo ', chr(233), ' de 1a via 😀', chr(10), chr(10), chr(10)) END AS head,
    CASE WHEN k = 8 THEN 'Consta o c' || chr(243) || 'digo: ' ELSE 'Invoca-se, ainda, o ' END AS lead,
    CASE k
      WHEN 0 THEN concat('REsp n', chr(186), ' ', CAST(n AS STRING), '/SP')
      WHEN 1 THEN concat('artigo ', CAST(a AS STRING), ', inciso I, da Lei n', chr(186), ' 13.105/2015')
      WHEN 2 THEN concat('S', chr(250), 'mula n', chr(186), ' ', CAST(a AS STRING), ' do STJ')
      WHEN 3 THEN concat('Tema ', CAST(a AS STRING), ' da repercuss', chr(227), 'o geral')
      WHEN 4 THEN concat('TST-AIRR-', CAST(n AS STRING))
      WHEN 5 THEN concat('R-Rp n', chr(186), ' ', CAST(n AS STRING))
      WHEN 6 THEN concat('Su', chr(109), 'u1a ', replace(CAST(1000 + a AS STRING), '1', 'l'))
      WHEN 7 THEN concat('precedente do STJ de ', CAST(2000 + a % 20 AS STRING), ', da relatoria de Maria Silva')
      WHEN 8 THEN concat('HC ', CAST(n AS STRING))
      WHEN 9 THEN concat('RMS ', CAST(n AS STRING))
      WHEN 10 THEN concat('art. ', CAST(a AS STRING), chr(186), ', XXXV, da Constitui', chr(231), chr(227), 'o Federal')
      ELSE concat('HC n', chr(186), ' ', CAST(n AS STRING), '/SP (julgado em 2020)') END AS literal,
    CASE WHEN k = 9 THEN concat(chr(10), chr(10), ' ', chr(10), 'nada consta.') WHEN k = 8 THEN ' no hospital.' ELSE ', no ponto em que decide.' END AS tail
  FROM (SELECT CAST(o_orderkey AS STRING) AS documento_id, o_orderkey % 12 AS k, 100000 + o_orderkey AS n, 1 + o_orderkey % 900 AS a FROM {orders}) t
) u
"""

#: Of every three orders, two have a record; some share a number, with the same or another reporter.
RECORDS = """
SELECT id, tribunal, ano, relator, concat(substring('      ', 1, CAST(pad AS INT)), 'RECURSO ESPECIAL N', chr(186), ' ', CAST(number AS STRING), ' - SP. Ementa.') AS texto, 'acordao' AS natureza, number, pad
FROM (
  SELECT o_orderkey + 1000 AS id, CASE o_orderkey % 4 WHEN 0 THEN 'STJ' WHEN 1 THEN 'STF' WHEN 2 THEN 'TST' ELSE 'TSE' END AS tribunal,
         CAST(year(o_orderdate) AS INT) AS ano, concat('Min. ', CAST(o_custkey AS STRING)) AS relator, 100000 + o_orderkey AS number, o_orderkey % 5 AS pad
  FROM {orders} WHERE o_orderkey % 3 <> 0
  UNION ALL
  SELECT o_orderkey + 50000000 AS id, CASE o_orderkey % 4 WHEN 0 THEN 'STJ' WHEN 1 THEN 'STF' WHEN 2 THEN 'TST' ELSE 'TSE' END AS tribunal,
         CAST(year(o_orderdate) AS INT) AS ano, CASE WHEN o_orderkey % 14 = 0 THEN 'Min. Outro' ELSE concat('MIN. ', CAST(o_custkey AS STRING)) END AS relator, 100000 + o_orderkey AS number, (o_orderkey + 2) % 5 AS pad
  FROM {orders} WHERE o_orderkey % 7 = 0 AND o_orderkey % 3 <> 0
) t
"""

#: A citation of every order's number; one in five misreads 1 as l, another 0 as o.
CASE_LITERALS = """
SELECT o_orderkey, 100000 + o_orderkey AS number,
  concat('REsp n', chr(186), ' 1', CASE o_orderkey % 5 WHEN 0 THEN replace(substring(CAST(100000 + o_orderkey AS STRING), 2, 12), '1', 'l') WHEN 1 THEN replace(substring(CAST(100000 + o_orderkey AS STRING), 2, 12), '0', 'o') ELSE substring(CAST(100000 + o_orderkey AS STRING), 2, 12) END) AS literal
FROM {orders}
"""

#: Provisions of two statutes: an article of their own each (every fifth shares its predecessor's); every ninth without a declared statute; every
#: eleventh without an article. Summaries, some numbers twice. And a record for each wording that tells a statute or a number.
WORDING = [
    (999101, "276", "codigo_eleitoral", "As decisões dos Tribunais Regionais são terminativas."),
    (999102, "290", "codigo_penal_militar", "Receber, preparar, produzir, vender, fornecer."),
    (999103, "14", "codigo_defesa_consumidor", "O fornecedor de serviços responde."),
    (999104, "93", "constituicao_federal", "Lei de iniciativa do Supremo Tribunal Federal disporá sobre o Estatuto da Magistratura."),
    (999105, "896", "clt", "Cabe recurso de revista para Turma do Tribunal Superior do Trabalho."),
    (999106, "7", "constituicao_federal", "São direitos dos trabalhadores urbanos e rurais."),
    (999107, "5", "constituicao_federal", "Todos são iguais perante a lei."),
    (999108, "818", "clt", "O ônus da prova incumbe ao reclamante."),
    (999109, "312", "codigo_processo_penal", "A prisão preventiva poderá ser decretada como garantia da ordem pública."),
    (999110, "477", "clt", "Na extinção do contrato de trabalho."),
    (999111, "186", "codigo_civil", "Aquele que, por ação ou omissão voluntária, comete ato ilícito."),
    (999112, "1", "lei_complementar_64_1990", "São inelegíveis."),
    (999113, "373", "codigo_processo_civil_2015", "O ônus da prova incumbe ao autor."),
]
SUMMARY_WORDING = [
    (999201, "STF", "10", "Viola a cláusula de reserva de plenário a decisão."),
    (999202, "TST", "331", "Contrato de prestação de serviços: a contratação de trabalhadores por empresa interposta é ilegal."),
]


def _worded() -> str:
    null = "CAST(NULL AS STRING)"
    laws = [f"UNION ALL SELECT {i}, {null}, 'Art. {a}. {t}', 'dispositivo', {null}, {null}, '{a}', '{s}', {null}, {null}" for i, a, s, t in WORDING]
    sums = [f"UNION ALL SELECT {i}, '{c}', '{t}', 'sumula', {null}, {null}, {null}, {null}, '{c.lower()}', '{n}'" for i, c, n, t in SUMMARY_WORDING]
    return "\n  ".join(laws + sums)


RULES = """
SELECT id, tribunal, texto, natureza, diploma, numero, article, statute, court, number FROM (
  SELECT p_partkey + 10000000 AS id, CAST(NULL AS STRING) AS tribunal,
    CASE WHEN p_partkey % 11 = 5 THEN 'Texto sem numero.' ELSE concat('Art. ', CAST(p_partkey + 10 - CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 0 END AS STRING), chr(186), ' Texto da norma.') END AS texto, 'dispositivo' AS natureza,
    CASE WHEN p_partkey % 9 = 4 THEN CAST(NULL AS STRING) WHEN p_partkey % 2 = 0 THEN concat('C', chr(243), 'digo Civil') ELSE concat('C', chr(243), 'digo de Processo Civil') END AS diploma, CAST(NULL AS STRING) AS numero,
    CASE WHEN p_partkey % 11 = 5 THEN CAST(NULL AS STRING) ELSE CAST(p_partkey + 10 - CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 0 END AS STRING) END AS article,
    CASE WHEN p_partkey % 9 = 4 THEN CAST(NULL AS STRING) WHEN p_partkey % 2 = 0 THEN 'codigo_civil' ELSE 'codigo_processo_civil_2015' END AS statute,
    CAST(NULL AS STRING) AS court, CAST(NULL AS STRING) AS number
  FROM {part}
  UNION ALL
  SELECT s_suppkey + 990000 AS id, CASE s_suppkey % 4 WHEN 0 THEN 'STJ' WHEN 1 THEN 'TST' WHEN 2 THEN 'STF' ELSE CAST(NULL AS STRING) END AS tribunal,
    CASE WHEN s_suppkey % 5 = 0 THEN 'Texto sem numero.' ELSE concat('S', chr(250), 'mula n', chr(186), ' ', CAST(1 + s_suppkey % 80 AS STRING), '. Texto.') END AS texto, 'sumula' AS natureza, CAST(NULL AS STRING) AS diploma,
    CASE WHEN s_suppkey % 10 = 0 THEN CAST(1 + s_suppkey % 80 AS STRING) ELSE CAST(NULL AS STRING) END AS numero, CAST(NULL AS STRING) AS article, CAST(NULL AS STRING) AS statute,
    CASE s_suppkey % 4 WHEN 0 THEN 'stj' WHEN 1 THEN 'tst' WHEN 2 THEN 'stf' ELSE CAST(NULL AS STRING) END AS court,
    CASE WHEN s_suppkey % 5 = 0 AND s_suppkey % 10 <> 0 THEN CAST(NULL AS STRING) ELSE CAST(1 + s_suppkey % 80 AS STRING) END AS number
  FROM {supplier}
  WORDED
) t
""".replace("WORDED", _worded())

#: Gold spans, 100 apart, of pseudo-documents, one for each order, and predictions: exact, shifted, of another class or link, contained extras, strays, or none.
#: A line's number follows from its order and its place there, so no step orders the whole table.
GOLDS = """
SELECT concat('d', CAST(l_orderkey AS STRING)) AS documento_id, CAST(1 + l_orderkey % 2 AS INT) AS nivel, CAST(no * 100 AS INT) AS inicio, CAST(no * 100 + 20 + q AS INT) AS fim,
  CASE f WHEN 'A' THEN 'real' WHEN 'N' THEN 'inventada' ELSE 'incompleta' END AS classificacao, CASE f WHEN 'A' THEN CAST(700 + rn % 50 AS STRING) END AS id_canonico, rn, q, f
FROM (
  SELECT l_orderkey, no, CAST(l_orderkey * 67 + no AS BIGINT) AS rn, q, f
  FROM (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS BIGINT) AS no, CAST(l_quantity AS INT) AS q, l_returnflag AS f FROM {lineitem}) s
) t
"""
PREDS = """
SELECT documento_id, CAST(start AS INT) AS start, CAST(end_ AS INT) AS end_, classe, CASE WHEN classe = 'real' THEN id END AS id, conf, rn, no FROM (
  SELECT documento_id, inicio + CASE rn % 6 WHEN 1 THEN 3 WHEN 2 THEN (fim - inicio) * 2 // 3 ELSE 0 END AS start, fim + CASE rn % 6 WHEN 1 THEN 2 ELSE 0 END AS end_,
    CASE WHEN rn % 11 = 3 THEN 'real' ELSE classificacao END AS classe, CAST(CASE WHEN rn % 13 = 0 THEN 1 ELSE 700 + rn % 50 END AS STRING) AS id, CASE WHEN rn % 4 = 0 THEN NULL ELSE CAST(rn % 10 AS DOUBLE) / 10 END AS conf, rn, 0 AS no
  FROM g WHERE rn % 6 <> 5
  UNION ALL SELECT documento_id, inicio + 2, inicio + 7, 'incompleta', NULL, CAST(0.5 AS DOUBLE), rn, 1 FROM g WHERE rn % 6 = 0
  UNION ALL SELECT documento_id, fim + 5, fim + 15, 'inventada', NULL, CAST(0.25 AS DOUBLE), rn, 2 FROM g WHERE rn % 9 = 0
) p
"""


def duck(sql: str) -> str:
    """For DuckDB: tables by their names, and DuckDB's integer division is Spark's div."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql.replace("//", " div "), **tables)


def golds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, GOLDS)


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("WITH g AS (SELECT * FROM {golds}) " + PREDS.replace("//", " div "), golds=golds(spark, sf_dir))


PAIRS = f"WITH g AS ({GOLDS}), p AS ({PREDS})"
