"""Citations to canonical records: real, inventada or incompleta.

Literals are resolved once each, however often they are cited, and the answers joined back: the
indexes meet a table of distinct literals, not of citations.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import patterns as P
from tessera.functions import text as T
from tessera.operators import index
from tessera.operators.extract import extract
from tessera.session import written


def law_keys(literals: DataFrame) -> DataFrame:
    """literal, statute, article; null where the literal names none."""
    view = F.col("view")
    return literals.select("literal", T.short_view(F.col("literal")).alias("view")).select("literal", T.statute(view).alias("statute"), F.nullif(T.article(view), F.lit("")).alias("article"))


def _ends(found: DataFrame) -> DataFrame:
    """Of an index with lists of ids, their ends."""
    return found.withColumns({"least": F.array_min("ids"), "most": F.array_max("ids")}).drop("ids") if "ids" in found.columns else found


def resolve_laws(literals: DataFrame, law_index: DataFrame) -> DataFrame:
    """literal, canonical_id: the one provision of that statute and article, else null. `law_index` has ids, or least and most."""
    # A null-safe join: Spark would put tests for nulls, with all that the keys are made of, below a plain one.
    single = _ends(law_index).filter("least = most").select(F.col("statute").alias("of"), F.col("article").alias("at"), F.col("least").alias("canonical_id"))
    return law_keys(literals).join(single, F.col("statute").eqNullSafe(F.col("of")) & F.col("article").eqNullSafe(F.col("at")), "left").select("literal", "canonical_id")


def summary_keys(literals: DataFrame) -> DataFrame:
    """literal, number, court (empty if none is named or implied), valid (a binding summary is of the STF)."""
    view, literals = F.col("view"), literals.select("literal", T.short_view(F.col("literal")).alias("view"))
    pattern = "(?U)" + P.SUMMARY_PARTS
    named = F.regexp_extract(view, "(?U)" + P.COURT, 1)
    binding = F.regexp_extract(view, pattern, 1) != ""
    number = T.digits_key(F.translate(F.regexp_extract(view, pattern, 2), "olisg", "01159"))
    court = F.when(named != "", named).when(binding, F.lit("stf")).otherwise(F.lit(""))
    return literals.select("literal", number.alias("number"), court.alias("court"), (view.rlike(pattern) & ~(binding & ~named.isin("", "stf"))).alias("valid"))


def resolve_summaries(literals: DataFrame, summary_index: DataFrame) -> DataFrame:
    """literal, canonical_id: by court and number, or by number alone where no court is named; null unless just one record fits. `summary_index` has ids, or least and most."""
    keyed = T.kept(summary_keys(literals), F.col("valid"))
    by_court = _ends(summary_index).select("court", "number", "least", "most")
    anywhere = by_court.groupBy("number").agg(F.min("least").alias("least"), F.max("most").alias("most")).select(F.lit("").alias("court"), "number", "least", "most")
    single = by_court.unionByName(anywhere).filter("least = most").select(F.col("court").alias("of"), F.col("number").alias("at"), F.col("least").alias("canonical_id"))
    found = keyed.join(single, F.col("court").eqNullSafe(F.col("of")) & F.col("number").eqNullSafe(F.col("at"))).select("literal", "canonical_id")
    return literals.select("literal").join(found, "literal", "left")


def resolve_cases(literals: DataFrame, number_index: DataFrame) -> DataFrame:
    """literal, classification, canonical_id.

    Without a usable number: incompleta. Without a record that has one of the number's readings and a
    family in common: inventada. If records about as near the start as the best differ in court, year
    or reporter: incompleta. Else the least id of those.
    """
    rows = literals.withColumn("view", T.matching_view(F.col("literal"))).withColumn("variants", T.number_variants(F.col("view"))).withColumn("wanted", T.families(F.col("view")))
    rows = rows.select("literal", "variants", "wanted")
    keys = rows.select("literal", "wanted", F.explode("variants").alias("key"))
    hits = keys.join(number_index, "key").filter((F.size("wanted") == 0) | F.arrays_overlap("wanted", "families"))
    hit = F.struct("position", "tribunal", "year", F.lower("reporter").alias("reporter"))
    best = hits.groupBy("literal", "id").agg(F.min_by(hit, "position").alias("hit"))
    near = best.withColumn("least", F.min("hit.position").over(Window.partitionBy("literal"))).filter(F.col("hit.position") <= F.col("least") + P.NEAR_BEST)
    told = near.groupBy("literal").agg(F.min("id").alias("id"), F.count_distinct(F.struct("hit.tribunal", "hit.year", "hit.reporter")).alias("kinds"))
    verdict = F.when(F.size("variants") == 0, "incompleta").when(F.col("kinds").isNull(), "inventada").when(F.col("kinds") > 1, "incompleta").otherwise("real")
    both = rows.join(told, "literal", "left").withColumn("classification", verdict)
    return both.select("literal", "classification", F.when(F.col("classification") == "real", F.col("id")).alias("canonical_id"))


class Indexes(NamedTuple):
    """The three indexes of a canonical table."""

    numbers: DataFrame
    laws: DataFrame
    summaries: DataFrame


def indexes(canonical: DataFrame, keep: bool = False) -> Indexes:
    """`keep` writes them, for several uses."""
    made = Indexes(index.number_index(canonical), index.law_ends(canonical), index.summary_ends(canonical))
    return Indexes(*[written(x, "index") for x in made]) if keep else made


def classify(citations: DataFrame, canonical: DataFrame | Indexes) -> DataFrame:
    """documento_id, start, end, kind, classification, canonical_id, confidence, literal.

    The citations, far smaller than the texts, are written once: four branches read them, and none
    runs the extraction again.
    """
    known = canonical if isinstance(canonical, Indexes) else indexes(canonical)
    citations = written(citations, "citations")
    distinct = citations.filter("explicit_type <> 'incomplete'").select("explicit_type", "literal").distinct()
    of = lambda kind: distinct.filter(F.col("explicit_type") == kind).select("literal")
    verdict = F.when(F.col("canonical_id").isNull(), "inventada").otherwise("real")
    laws = resolve_laws(of("law"), known.laws).select(F.lit("law").alias("explicit_type"), "literal", verdict.alias("classification"), "canonical_id")
    sums = resolve_summaries(of("sumula"), known.summaries).select(F.lit("sumula").alias("explicit_type"), "literal", verdict.alias("classification"), "canonical_id")
    cases = resolve_cases(of("case"), known.numbers).select(F.lit("case").alias("explicit_type"), "literal", "classification", "canonical_id")
    answers = laws.unionByName(sums).unionByName(cases)
    return citations.join(answers, ["explicit_type", "literal"], "left").select(
        "documento_id", "start", "end", "kind", F.coalesce("classification", F.lit("incompleta")).alias("classification"),
        F.col("canonical_id").cast("string").alias("canonical_id"), F.lit(1.0).alias("confidence"), "literal",
    )


def predict(docs: DataFrame, canonical: DataFrame | Indexes, id_col: str = "documento_id", text_col: str = "texto", templates: bool = False) -> DataFrame:
    """Texts to classified citations."""
    return classify(extract(docs, id_col, text_col, templates), canonical)


def violations(citations: DataFrame, docs: DataFrame, id_col: str = "documento_id", text_col: str = "texto") -> DataFrame:
    """documento_id, start, end, reason: citations out of bounds, real ones without a numeric id, and duplicates (IoU of 1/2 or more)."""
    sizes = docs.select(F.col(id_col).alias("documento_id"), F.char_length(text_col).alias("size"))
    cites = citations.join(sizes, "documento_id")
    outside = cites.filter(~((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("size")))).withColumn("reason", F.lit("span"))
    unlinked = cites.filter((F.col("classification") == "real") & ~F.coalesce(F.col("canonical_id").rlike(r"\A\d+\z"), F.lit(False))).withColumn("reason", F.lit("id"))
    fields = ["documento_id", "start", "end", "reason"]
    return outside.select(fields).unionByName(unlinked.select(fields)).unionByName(overlapping(citations, ["documento_id"], P.IOU_LEAST).withColumn("reason", F.lit("overlap")).select(fields))


def overlapping(spans: DataFrame, by: list[str], least: float) -> DataFrame:
    """Spans that have an IoU of `least` (over 0) or more with an earlier one of the same group; an equi-join with a residual."""
    numbered = spans.withColumn("no", F.row_number().over(Window.partitionBy(*by).orderBy("start", "end")))
    left = numbered.select(*by, F.col("start").alias("s0"), F.col("end").alias("e0"), F.col("no").alias("n0"))
    both = numbered.join(left, by).filter("n0 < no")
    inter = F.greatest(F.least("end", "e0") - F.greatest("start", "s0"), F.lit(0))
    union = F.col("end") - F.col("start") + F.col("e0") - F.col("s0") - inter
    return both.filter((inter > 0) & (inter >= least * union)).select(*by, "start", "end").distinct()
