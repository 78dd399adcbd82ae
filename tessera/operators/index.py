"""Indexes over the canonical table: numbers of decisions, provisions of statutes, courts' summaries.

`canonical` has id, tribunal, ano, relator, texto, natureza, and may have diploma or fonte_normativa,
and numero or numero_sumula; which of them exist is seen while the plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import patterns as P
from tessera.functions import text as T

#: Code points read past the last position at which a number may start; all of the text if a number may go on there.
SLACK = 1000


def number_hits(canonical: DataFrame) -> DataFrame:
    """key, id, position, tribunal, year, reporter, families for every number near the start of a decision, with a named family."""
    court = F.coalesce(F.col("tribunal"), F.lit(""))
    limit = F.when(F.col("tribunal") == "TST", P.TST_NUMBER_LIMIT).otherwise(P.NUMBER_LIMIT)
    rows = canonical.filter((F.col("natureza") == "acordao") & F.col("texto").isNotNull()).select(
        F.col("id").cast("long").alias("id"), court.alias("tribunal"), F.col("ano").cast("int").alias("year"), F.coalesce(F.col("relator").cast("string"), F.lit("")).alias("reporter"),
        limit.alias("limit"), F.substring("texto", F.lit(1), limit + SLACK).alias("head"), "texto",
    )
    rows = rows.withColumn("head", F.when(F.col("head").rlike(P.NUMBER_OPEN), F.col("texto")).otherwise(F.col("head"))).drop("texto")
    spans = F.filter(T.find_spans(F.col("head"), "(?U)" + P.NUMBER_TOKEN), lambda s: s["start"] <= F.col("limit"))
    tokens = rows.withColumn("span", F.explode(spans))
    start, end = F.col("span.start"), F.col("span.end")
    key = F.regexp_replace(T.part(F.col("head"), start, end), r"(?U)\D", "")
    near = T.part(F.col("head"), F.greatest(start - P.NUMBER_BEFORE, F.lit(0)), end + P.NUMBER_AFTER)
    keyed = tokens.select("id", "tribunal", "year", "reporter", start.alias("position"), key.alias("key"), T.matching_view(near).alias("near")).filter(F.char_length("key") >= 3)
    return T.kept(keyed.withColumn("families", T.families(F.col("near"), F.col("tribunal"))), F.size("families") > 0).drop("near")


def number_index(canonical: DataFrame) -> DataFrame:
    """The first hit of each (key, id); combined in each task before the one shuffle."""
    hit = F.struct("position", "tribunal", "year", "reporter", "families")
    return number_hits(canonical).groupBy("key", "id").agg(F.min_by(hit, "position").alias("hit")).select("key", "id", "hit.*")


def _optional(canonical: DataFrame, names: tuple[str, str]) -> Column:
    found = next((n for n in names if n in canonical.columns), None)
    return F.col(found).cast("string") if found else F.lit(None).cast("string")


def provisions(canonical: DataFrame) -> DataFrame:
    """id, article, statute, recovered for every provision; null where unknown."""
    rows = canonical.filter("natureza = 'dispositivo'").select(F.col("id").cast("long").alias("id"), F.coalesce("texto", F.lit("")).alias("texto"), _optional(canonical, ("diploma", "fonte_normativa")).alias("said"))
    # Views are columns of their own, so that each is computed, and stands in the plan, once.
    rows = rows.withColumns({"view": T.short_view(F.col("texto")), "head": T.short_view(F.substring("texto", 1, 200)), "said_view": T.short_view(F.col("said"))})
    rows = rows.withColumn("article", F.nullif(T.article(F.col("head")), F.lit("")))
    declared = F.when(F.coalesce("said", F.lit("")) != "", T.statute(F.col("said_view")))
    wording = T.only(F.array_compact(F.array(*[F.when((F.col("article") == a) & F.col("view").rlike(p), F.lit(s)) for a, s, p in P.PROVISION_WORDING])))
    rows = rows.withColumn("declared", declared).withColumn("worded", F.when(F.col("declared").isNull(), wording))
    return rows.select("id", "article", F.coalesce("declared", "worded").alias("statute"), F.col("worded").isNotNull().alias("recovered"))


def summaries(canonical: DataFrame) -> DataFrame:
    """id, court, number, recovered for every summary; null where unknown."""
    rows = canonical.filter("natureza = 'sumula'").select(F.col("id").cast("long").alias("id"), F.coalesce("texto", F.lit("")).alias("texto"), F.coalesce("tribunal", F.lit("")).alias("tribunal"), _optional(canonical, ("numero", "numero_sumula")).alias("said"))
    rows = rows.withColumns({"view": T.short_view(F.col("texto")), "court_view": T.short_view(F.col("tribunal"))}).withColumn("court", F.nullif("court_view", F.lit("")))
    said = F.nullif(T.digits_key(F.coalesce("said", F.lit(""))), F.lit(""))
    told = F.nullif(T.digits_key(F.regexp_extract("view", "(?U)" + P.SUMMARY_NUMBER, 1)), F.lit(""))
    wording = T.only(F.array_compact(F.array(*[F.when((F.col("court") == c) & F.col("view").rlike(p), F.lit(n)) for c, n, p in P.SUMMARY_WORDING])))
    rows = rows.withColumn("known", F.coalesce(said, told)).withColumn("worded", F.when(F.col("known").isNull(), wording))
    return rows.select("id", "court", F.coalesce("known", "worded").alias("number"), F.col("worded").isNotNull().alias("recovered"))


def _known(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows that have all keys; kept(), since a plain filter would put their long expressions into the plan again and again."""
    return T.kept(rows, F.concat(*keys).isNotNull())


def _collected(rows: DataFrame, *keys: str) -> DataFrame:
    return _known(rows, *keys).groupBy(*keys).agg(F.array_sort(F.collect_set("id")).alias("ids"))


def law_index(canonical: DataFrame) -> DataFrame:
    """(statute, article) → ids in order; collisions stay."""
    return _collected(provisions(canonical), "statute", "article")


def summary_index(canonical: DataFrame) -> DataFrame:
    """(court, number) → ids in order; collisions stay."""
    return _collected(summaries(canonical), "court", "number")


def _ends(rows: DataFrame, *keys: str) -> DataFrame:
    return _known(rows, *keys).groupBy(*keys).agg(F.min("id").alias("least"), F.max("id").alias("most"))


def law_ends(canonical: DataFrame) -> DataFrame:
    """(statute, article) → the least and the largest id: all that resolution needs, of one size however many collide."""
    return _ends(provisions(canonical), "statute", "article")


def summary_ends(canonical: DataFrame) -> DataFrame:
    """(court, number) → the least and the largest id."""
    return _ends(summaries(canonical), "court", "number")


def recoveries(canonical: DataFrame) -> DataFrame:
    """Audit: fields recovered from wording."""
    law = T.kept(provisions(canonical), F.col("recovered")).select("id", F.lit("dispositivo").alias("nature"), F.lit("diploma").alias("field"), F.col("statute").alias("value"))
    summary = T.kept(summaries(canonical), F.col("recovered")).select("id", F.lit("sumula").alias("nature"), F.lit("numero").alias("field"), F.col("number").alias("value"))
    return law.unionByName(summary).withColumn("method", F.lit("canonical_text_signature"))


def unindexed(canonical: DataFrame) -> DataFrame:
    """Audit: records that lack a key, and what they lack."""

    def lacking(rows: DataFrame, nature: str, names: list[tuple[str, str]]) -> DataFrame:
        missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(n)) for n, c in names]))
        return T.kept(rows.select("id", F.lit(nature).alias("nature"), missing.alias("missing")), F.size("missing") > 0)

    return lacking(provisions(canonical), "dispositivo", [("artigo", "article"), ("diploma", "statute")]).unionByName(lacking(summaries(canonical), "sumula", [("tribunal", "court"), ("numero", "number")]))
