"""Prediction over arriving text files: extraction is stateless, and the canonical indexes are static."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.extract import extract
from tessera.operators.resolve import classify, indexes


def text_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    rows = spark.readStream.option("wholetext", "true").option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", str(files_per_trigger)).text(folder)
    return rows.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.txt$", 1).alias("documento_id"), F.col("value").alias("texto"))


def predict_stream(docs: DataFrame, canonical: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends classified citations; each batch is one batch prediction, written under its number, so a batch that is run again replaces its own output.

    The indexes are made once, before the stream starts.
    """
    known = indexes(canonical, keep=True)

    def batch(rows: DataFrame, number: int) -> None:
        classify(extract(rows), known).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
