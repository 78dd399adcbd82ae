"""Whole runs: predictions, or the labels themselves, to contract documents and a submission, with all their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import audit, resolve, score
from tessera.sources import readers, sinks


def checked(citations: DataFrame, docs: DataFrame) -> DataFrame:
    """The citations, if none is out of its text, without a numeric id where it needs one, or a duplicate."""
    bad = resolve.violations(citations, docs).take(3)
    if bad:
        raise ValueError(f"invalid predictions: {[tuple(r) for r in bad]}")
    return citations


def predict_submission(docs: DataFrame, canonical: DataFrame, templates: bool = False) -> DataFrame:
    """documento_id, citacoes: a cell for every document, predicted without labels; the predictions are checked first."""
    return score.cells(docs, checked(resolve.predict(docs, canonical, templates=templates), docs))


def oracle_citations(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """The labels as citations of certainty 1. Raises where a label has no text or its literal isn't at its span."""
    lost = labels.select("documento_id").distinct().join(docs, "documento_id", "left_anti").select("documento_id").take(3)
    if lost:
        raise score.GoldError(f"labels of documents without a text: {[r[0] for r in lost]}")
    wrong = audit.wrong_literals(labels, docs).take(3)
    if wrong:
        raise score.GoldError(f"literals that aren't at their span: {[tuple(r) for r in wrong]}")
    bad = labels.filter(F.col("id_canonico").isNotNull() & ~F.col("id_canonico").rlike(r"\A\d+\z")).take(1)
    if bad:
        raise score.GoldError(f"invalid id_canonico {bad[0]['id_canonico']!r}")
    return labels.select(
        "documento_id", "citacao_id", F.col("inicio").alias("start"), F.col("fim").alias("end"), F.col("tipo").alias("kind"), F.col("classificacao").alias("classification"),
        F.when(F.col("classificacao") == "real", F.col("id_canonico")).alias("canonical_id"), F.lit(1.0).alias("confidence"), F.replace("trecho", F.lit("\\n"), F.lit("\n")).alias("literal"),
    )


def oracle_submission(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """documento_id, citacoes of the labels, by way of contract documents and their converter; the score's upper end."""
    documents = sinks.contract(docs, oracle_citations(labels, docs))
    return readers.contract_cells(documents.select(F.from_json("json", readers.CONTRACT).alias("d")).select("d.*"))


def write(docs: DataFrame, citations: DataFrame, submission: str, json_folder: str | None = None) -> None:
    """A submission at `submission` and, if named, contract documents in a folder without documents of another run."""
    import os

    if json_folder:
        if os.path.isdir(json_folder) and any(x.endswith(".json") for x in os.listdir(json_folder)):
            old = sinks.stale(docs.sparkSession, json_folder, docs).take(3)
            if old:
                raise ValueError(f"{json_folder} holds documents of another run: {[r[0] for r in old]}")
        sinks.write_contract(sinks.contract(docs, citations), json_folder)
    sinks.write_submission_file(score.cells(docs, citations), submission)
