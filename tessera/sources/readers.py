"""Sources: text folders, labels, submissions, contract JSON, and the canonical SQLite file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.operators.score import POSITION, GoldError


def _stem(suffix: str) -> Column:
    return F.regexp_extract("_metadata.file_name", rf"^(.*)\.{suffix}$", 1)


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """documento_id, texto of each .txt file; line ends and all other characters stay as they are."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt")
    if rows.isEmpty():
        raise ValueError(f"no .txt in {folder}")
    return rows.select(_stem("txt").alias("documento_id"), F.col("value").alias("texto"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """The citation-level labels: nivel, documento_id, citacao_id, inicio, fim, trecho, tipo, classificacao, id_canonico."""
    rows = spark.read.csv(path, header=True, escape='"', encoding="UTF-8")
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    lacking = {"nivel", "documento_id", "inicio", "fim", "classificacao", "id_canonico"} - set(rows.columns)
    if lacking:
        raise GoldError(f"the labels lack columns {sorted(lacking)}")
    return rows.withColumns({"nivel": F.col("nivel").cast("int"), "inicio": F.col("inicio").cast("int"), "fim": F.col("fim").cast("int"), "id_canonico": clean_id(F.col("id_canonico"))})


def clean_id(value: Column) -> Column:
    """Digits without a .0 that a number column leaves."""
    return F.regexp_replace(F.trim(value), r"\.0$", "")


def solution(labelled: DataFrame) -> DataFrame:
    """documento_id, nivel, citacoes: the labels of a document in one cell, by span. Raises on bad ids or levels."""
    bad = labelled.filter(F.col("id_canonico").isNotNull() & ~F.col("id_canonico").rlike(r"\A\d+\z")).take(1)
    if bad:
        raise GoldError(f"invalid id_canonico {bad[0]['id_canonico']!r}")
    block = F.concat_ws(",", F.col("inicio").cast("string"), F.col("fim").cast("string"), "classificacao", F.coalesce("id_canonico", F.lit("-")))
    rows = labelled.groupBy("documento_id").agg(F.min("nivel").alias("nivel"), F.max("nivel").alias("other"), F.array_sort(F.collect_list(F.struct("inicio", "fim", block.alias("block")))).alias("blocks"))
    odd = rows.filter("nivel <> other").take(1)
    if odd:
        raise GoldError(f"{odd[0]['documento_id']} has several levels")
    return rows.select("documento_id", "nivel", F.array_join(F.transform("blocks", lambda b: b["block"]), "|").alias("citacoes"))


def submission(spark: SparkSession, path: str) -> DataFrame:
    """documento_id, citacoes as text, and where each row stands (of rows of one document the first counts); an empty cell is an empty text."""
    rows = spark.read.csv(path, header=True, escape='"', nullValue="\x01none\x01", emptyValue="")
    if not {"documento_id", "citacoes"} <= set(rows.columns):
        return rows
    # Within a block of a file, rows are numbered in order.
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select("documento_id", F.coalesce("citacoes", F.lit("")).alias("citacoes"), place.alias(POSITION))


CITATIONS = "array<struct<citacao_id:string,inicio:int,fim:int,trecho:string,tipo:string,classificacao:string,resolucao:struct<id_canonico:string>,confianca:double>>"
CONTRACT = f"schema_version string, documento_id string, citacoes {CITATIONS}"


def contract_json(spark: SparkSession, folder: str) -> DataFrame:
    """Contract documents of a folder; the file's name stands in for a missing id."""
    rows = spark.read.schema(CONTRACT).json(folder, multiLine=True, pathGlobFilter="*.json")
    return rows.withColumn("documento_id", F.coalesce(F.nullif("documento_id", F.lit("")), _stem("json")))


def contract_cells(docs: DataFrame) -> DataFrame:
    """documento_id, citacoes (a cell; - without citations) of contract documents, in their own order."""
    field = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("-"))
    block = lambda c: F.concat_ws(",", c["inicio"].cast("string"), c["fim"].cast("string"), c["classificacao"], field(c["resolucao"]["id_canonico"]), F.when(c["confianca"].isNull(), F.lit("-")).otherwise(F.format_string("%.4f", c["confianca"])))
    cell = F.array_join(F.transform(F.coalesce("citacoes", F.array().cast(CITATIONS)), block), "|")
    return docs.select("documento_id", F.coalesce(F.nullif(cell, F.lit("")), F.lit("-")).alias("citacoes"))


class _Slice(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.table = schema, options["path"], options.get("dbtable", "documentos")
        self.slices = int(options.get("numpartitions", "8"))
        column, _, value = options.get("equals", "").partition("=")
        self.where = [(column, value)] if column else []

    def _open(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        with self._open() as db:
            lo, hi = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if lo is None:
            return [_Slice(0, -1)]
        step = max(1, -(-(hi - lo + 1) // self.slices))
        return [_Slice(x, min(hi, x + step - 1)) for x in range(lo, hi + 1, step)]

    def read(self, part):
        names = ", ".join(f'"{f.name}"' for f in self.schema)
        tests = " AND ".join(["rowid BETWEEN ? AND ?", *[f'"{c}" = ?' for c, _ in self.where]])
        db = self._open()
        try:
            for row in db.execute(f'SELECT {names} FROM "{self.table}" WHERE {tests}', [part.lo, part.hi, *[v for _, v in self.where]]):
                yield tuple(None if v is None else int(v) if isinstance(f.dataType, T.LongType) else str(v) if isinstance(f.dataType, T.StringType) else v for v, f in zip(row, self.schema, strict=True))
        finally:
            db.close()


class SqliteSource(DataSource):
    """A read-only SQLite table; columns are found at run time, row ranges are read in parallel.

    The option `equals`, as in "natureza=acordao", is tested by SQLite. (Filters that Spark pushes to a
    Python reader stay with the table for later queries on 4.1, so this reader takes none.)
    """

    @classmethod
    def name(cls):
        return "tessera_sqlite"

    def schema(self):
        import sqlite3

        kinds = {"INT": T.LongType(), "REA": T.DoubleType(), "FLO": T.DoubleType(), "DOU": T.DoubleType()}
        db = sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)
        try:
            found = db.execute(f'PRAGMA table_info("{self.options.get("dbtable", "documentos")}")').fetchall()
        finally:
            db.close()
        return T.StructType([T.StructField(r[1], kinds.get(r[2].upper()[:3], T.StringType())) for r in found])

    def reader(self, schema):
        return _Reader(schema, self.options)


def canonical(spark: SparkSession, path: str, table: str = "documentos", equals: str = "") -> DataFrame:
    """The canonical table: SQLite where the path ends in .db or .sqlite (every executor must see the file), else Parquet."""
    if path.endswith((".db", ".sqlite", ".sqlite3")):
        spark.dataSource.register(SqliteSource)
        return spark.read.format("tessera_sqlite").option("dbtable", table).option("equals", equals).load(path)
    rows = spark.read.parquet(path)
    column, _, value = equals.partition("=")
    return rows.filter(F.col(column) == value) if column else rows
