"""Every query of the catalog against its SQL, at the smallest scale; and what stays when the llm folders go."""

import datetime
import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from tessera.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents".split()


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is None or value is pd.NA or value != value:
        return ""
    return str(int(value)) if isinstance(value, float) and value == int(value) else str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, small, name):
    got = rows(catalog.queries()[name](spark, small).toPandas())
    assert got[1], "no rows"
    if name in catalog.oracle_sql():
        for t in TABLES:
            duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
        assert got == rows(duckdb.sql(catalog.oracle_sql()[name]).df())


def test_cases_of_numbers_of_any_first_digit(spark, tmp_path):
    keys = [*range(99990, 100020), *range(899990, 900020), *range(8999980, 9000000), 5 * 10**12, 5 * 10**12 + 1, None]
    columns = "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz"
    made = spark.createDataFrame([(k, None if k is None else k // 10, datetime.datetime(1990 + (k or 0) % 9, 1, 2)) for k in keys], columns)
    made.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = rows(catalog.queries()["resolve_case"](spark, str(tmp_path)).toPandas())
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
        assert got == rows(db.sql(catalog.oracle_sql()["resolve_case"]).df())
    assert len(got[1]) == len(keys) and {r[got[0].index("classification")] for r in got[1]} == {"real", "inventada", "incompleta"}


def test_no_python_on_the_executors(spark, small):
    plans = [catalog.queries()[n](spark, small)._jdf.queryExecution().executedPlan().toString() for n in ("extract_citations", "number_index", "resolve_case", "confusion")]
    assert not any(word in plan for plan in plans for word in ("Python", "Pandas", "Arrow"))


def test_without_the_llm_folders(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
