"""Audit of a score: coverage, families, exact spans, changes between two predictors, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import patterns as P
from tessera.operators import score as S


def changed(a: DataFrame, b: DataFrame) -> DataFrame:
    """documento_id of documents whose cells differ."""
    other = b.select("documento_id", F.col("citacoes").alias("other"))
    return a.join(other, "documento_id").filter(~F.col("citacoes").eqNullSafe(F.col("other"))).select("documento_id")


def partition_faults(families: DataFrame, docs: DataFrame) -> DataFrame:
    """documento_id, fault: documents in two families (duplicados), in none (sem_familia), or unknown ones (fora_do_gold)."""
    per_doc = families.groupBy("documento_id").agg(F.count(F.lit(1)).alias("n"))
    both = per_doc.join(docs.select("documento_id").distinct().withColumn("known", F.lit(True)), "documento_id", "full_outer")
    faults = F.array_compact(F.array(F.when(F.col("n") > 1, "duplicados"), F.when(F.col("n").isNull(), "sem_familia"), F.when(F.col("known").isNull(), "fora_do_gold")))
    return both.select("documento_id", F.explode(faults).alias("fault"))


def uncovered(gold: DataFrame, texts: DataFrame) -> DataFrame:
    """documento_id, side: in the labels without a text, or the other way round."""
    g, t = gold.select("documento_id").distinct(), texts.select("documento_id").distinct()
    return g.join(t, "documento_id", "left_anti").withColumn("side", F.lit("gold")).unionByName(t.join(g, "documento_id", "left_anti").withColumn("side", F.lit("text")))


def wrong_literals(gold: DataFrame, texts: DataFrame) -> DataFrame:
    """Labels whose literal (line ends written as \\n) isn't the text at their span."""
    both = gold.join(texts.select("documento_id", "texto"), "documento_id")
    literal = F.replace("trecho", F.lit("\\n"), F.lit("\n"))
    return both.filter(F.substring("texto", F.col("inicio") + 1, F.col("fim") - F.col("inicio")) != literal).select("documento_id", "inicio", "fim")


def support(gold: DataFrame, by: list[str]) -> DataFrame:
    """by, citations, and a count of each class."""
    counts = [F.count_if(F.col("classificacao") == c).alias(c) for c in P.CLASSES]
    return gold.groupBy(*by).agg(F.count(F.lit(1)).alias("citations"), *counts)


def exact_spans(gold: DataFrame, preds: DataFrame, by: list[str]) -> DataFrame:
    """by, true_positive, false_positive, false_negative, precision, recall, f1 over distinct (document, start, end)."""
    keys = [*by, "documento_id", "start", "end"]
    marked = gold.select(*keys).distinct().withColumn("g", F.lit(1)).join(preds.select(*keys).distinct().withColumn("p", F.lit(1)), keys, "full_outer")
    n = marked.groupBy(*by).agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("true_positive"), F.count_if(F.col("g").isNull()).alias("false_positive"), F.count_if(F.col("p").isNull()).alias("false_negative"))
    tp = F.col("true_positive")
    ratio = lambda whole: F.coalesce(tp / F.nullif(whole, F.lit(0)), F.lit(0.0))
    out = n.withColumn("precision", ratio(tp + F.col("false_positive"))).withColumn("recall", ratio(tp + F.col("false_negative")))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def family_summary(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, macro_family_score, population_stddev, worst_family (the first by name of the worst), worst and best score, family_count."""
    worst = F.min(F.struct("score_final", "family"))
    return scores.groupBy(*by).agg(
        F.avg("score_final").alias("macro_family_score"), F.stddev_pop("score_final").alias("population_stddev"), worst["family"].alias("worst_family"), worst["score_final"].alias("worst_family_score"),
        F.max("score_final").alias("best_family_score"), F.count(F.lit(1)).alias("family_count"),
    )


def inconsistent_levels(gold: DataFrame) -> DataFrame:
    """documento_id, levels of documents that don't have just one level."""
    return gold.groupBy("documento_id").agg(F.count_distinct("nivel").alias("levels")).filter("levels <> 1")


def sliced_scores(solution: DataFrame, submissions: DataFrame, families: DataFrame) -> DataFrame:
    """mode, family, score_final for every mode of `submissions` (mode, documento_id, citacoes), each family, and `overall`.

    The documents are matched once for all slices; a slice only adds up events again. A document of a
    family that the solution lacks is an error, as is a submission without a row for a document.
    """
    lacking = families.select("documento_id").distinct().join(solution, "documento_id", "left_anti").select("documento_id").take(3)
    if lacking:
        raise ValueError(f"the solution lacks documents of families: {[r[0] for r in lacking]}")
    told = per_mode(solution.select("documento_id"), submissions).join(submissions, ["mode", "documento_id"], "left_anti").take(3)
    if told:
        raise S.SubmissionError(f"no row for {[(r['mode'], r['documento_id']) for r in told]}")
    golds = per_mode(S.parse_solution(solution).drop("error"), submissions)
    preds = S.parse_submission(submissions, ("mode", "documento_id")).drop("error")
    rows = S.events(S.documents(golds, preds, ["mode", "documento_id"]), ["mode", "documento_id"])
    slices = families.select("documento_id", "family").unionByName(solution.select("documento_id", F.lit("overall").alias("family")))
    sliced = rows.join(slices, "documento_id")
    return S.final_scores(S.level_scores(sliced, ["mode", "family"]), ["mode", "family"])


def per_mode(rows: DataFrame, submissions: DataFrame) -> DataFrame:
    """`rows` once for every mode of `submissions`, of which there are a few: the predictors that are compared."""
    modes = sorted(r[0] for r in submissions.select("mode").distinct().collect())
    return rows.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))


def file_hash(content: str = "content"):
    return F.sha2(F.col(content), 256)


def corpus_hash(files: DataFrame) -> DataFrame:
    """corpus_sha256 over all files (name, content as binary) by name: 8-byte lengths before each name and content.

    A digest over a whole corpus is one sequence by definition. The files are sorted by Spark, which
    spills, and one task reads them in order and hashes them as they come: it holds a batch at a time.
    """

    def run(batches):
        import hashlib

        import pyarrow as pa

        digest = hashlib.sha256()
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                for value in (name.as_buffer(), content.as_buffer()):
                    digest.update(len(value).to_bytes(8, "big"))
                    digest.update(value)
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], ["corpus_sha256"])

    ordered = files.select(F.col("name").cast("binary").alias("name"), F.coalesce("content", F.lit(bytearray())).alias("content"))
    return ordered.repartition(1).sortWithinPartitions("name").mapInArrow(run, "corpus_sha256 string")


def provenance(texts: DataFrame, **files: str) -> dict[str, str]:
    """Hashes of a corpus (documento_id, texto; names end in .txt) and of the files named, and the number of documents."""
    import hashlib

    told = {"document_count": texts.count(), "text_corpus_sha256": corpus_hash(texts.select(F.concat("documento_id", F.lit(".txt")).alias("name"), F.encode("texto", "utf-8").alias("content"))).first()[0]}
    for name, path in sorted(files.items()):
        digest = hashlib.sha256()
        with open(path, "rb") as data:
            while block := data.read(1 << 20):
                digest.update(block)
        told[f"{name}_sha256"] = digest.hexdigest()
    return told


def report(gold: DataFrame, solution: DataFrame, submissions: DataFrame, families: DataFrame, baseline: str, other: str, hashes: dict | None = None) -> dict:
    """The whole audit: scores by slice, summaries, support by level and family, exact spans, changed documents, the two modes' difference, provenance.

    Raises where families aren't a partition of the documents, or a document has several levels.
    """
    faults = partition_faults(families, solution).take(3)
    if faults:
        raise ValueError(f"invalid partition into families: {[tuple(r) for r in faults]}")
    odd = inconsistent_levels(gold).take(3)
    if odd:
        raise S.GoldError(f"documents without just one level: {[r['documento_id'] for r in odd]}")
    scores = sliced_scores(solution, submissions, families)
    spans = per_mode(gold.select("documento_id", F.col("inicio").alias("start"), F.col("fim").alias("end")), submissions)
    of = lambda m: submissions.filter(F.col("mode") == m)
    pieces = {
        "scores": scores, "summaries": family_summary(scores.filter("family <> 'overall'"), ["mode"]), "support": support(gold, ["nivel"]),
        "family_support": support(gold.join(families.select("documento_id", "family"), "documento_id"), ["family"]), "families": families.select("family", "documento_id"),
        "exact_spans": exact_spans(spans, S.parse_submission(submissions, ("mode", "documento_id")), ["mode"]), "changed_documents": changed(of(baseline), of(other)),
    }
    told = {name: [r.asDict() for r in df.orderBy(*df.columns).collect()] for name, df in pieces.items()}
    final = {r["mode"]: r["score_final"] for r in told["scores"] if r["family"] == "overall"}
    worst = {r["mode"]: r["worst_family_score"] for r in told["summaries"]}
    delta = final[other] - final[baseline]
    told["headline"] = {"score": final, "worst_family_score": worst, "score_delta": delta, "changed_document_count": len(told["changed_documents"]), "metric_sensitive": abs(delta) > 1e-12}
    return told | {"claim_status": "post_hoc_diagnostic_only", "estimated_unseen_score": None, "provenance": hashes or {}}
