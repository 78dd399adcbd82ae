"""Citation spans from texts: candidates, filters and greedy arbitration in one narrow stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import patterns as P
from tessera.functions import text as T

CANDIDATE = "struct<start:int,end:int,kind:string,explicit_type:string,priority:int>"
#: pattern, kind, explicit type, priority
GRAMMAR = [
    (P.LAW, "lei", "law", 80),
    (P.SUMMARY, "jurisprudencia", "sumula", 80),
    (P.TOPIC, "jurisprudencia", "sumula", 80),
    (P.TST_CASE, "jurisprudencia", "case", 70),
    (P.TSE_CASE, "jurisprudencia", "case", 70),
    (P.CASE, "jurisprudencia", "case", 60),
]


def candidate(span: Column, kind: Column | str, explicit: Column | str, priority: int) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(span["start"].alias("start"), span["end"].alias("end"), lit(kind).alias("kind"), lit(explicit).alias("explicit_type"), F.lit(priority).alias("priority"))


def explicit_candidates(view: Column, pattern: str, kind: str, explicit: str, priority: int) -> Column:
    """Trimmed matches of one pattern of the grammar."""
    spans = F.transform(T.find_spans(view, P.flagged(pattern)), lambda s: T.trimmed(view, s))
    return F.transform(F.filter(spans, lambda s: s["end"] > s["start"]), lambda s: candidate(s, kind, explicit, priority))


def vague_candidates(view: Column) -> Column:
    """Phrases without a number that name a class or court, a year and a reporter."""
    heads = F.array_union(T.find_spans(view, P.flagged(P.VAGUE_HEAD)), T.find_spans(view, P.flagged(P.DESCRIBED_CASE)))
    starts = F.array_sort(F.array_distinct(F.transform(heads, lambda s: s["start"])))
    # What the phrase must have, the window it is cut from has too: few starts are left for the search for an end.
    able = F.filter(starts, lambda at: T.names_a_case(F.substring(view, at + 1, F.lit(P.PHRASE_LIMIT))))
    spans = F.transform(able, lambda at: F.struct(at.alias("start"), T.phrase_end(view, at).alias("end")))
    whole = F.filter(spans, lambda s: s["end"].isNotNull() & T.names_a_case(T.part(view, s["start"], s["end"])))
    return F.transform(whole, lambda s: candidate(s, "jurisprudencia", "incomplete", 70))


def template_candidates(text: Column, view: Column) -> Column:
    """Spans between prose that the development corpus puts around citations; a diagnostic, off by default."""
    flags = "(?iusU)"
    delimiter = "(?U)" + P.BODY_DELIMITER
    body = F.when(text.rlike(delimiter), F.char_length(F.split(text, delimiter, 2)[0]) + F.char_length(F.regexp_extract(text, delimiter, 0))).otherwise(F.lit(0))
    starts = F.array_union(F.array().cast("array<int>"), F.flatten(F.array(*[F.transform(T.find_spans(text, flags + p), lambda s: F.when(s["start"] >= body, s["end"])) for p in P.TEMPLATE_BEFORE])))
    words = "|".join([r"[\wº°]", *P.TEMPLATE_ABBREVIATIONS])
    stop = rf"(?U)(?<!(?:\A|[^\wº°])(?i:{words})\s{{0,14}})\.(?=\s*(?:\p{{Lu}}|\z))(?=\s|\z)"

    def end(at: Column) -> Column:
        window = F.substring(text, at + 1, F.lit(P.TEMPLATE_LIMIT))
        wider = F.substring(text, at + 1, F.lit(2 * P.TEMPLATE_LIMIT))
        period = T.length_before(wider, stop)
        near = F.array_min(F.array(*[T.length_before(window, flags + p) for p in P.TEMPLATE_AFTER], F.when(period < P.TEMPLATE_LIMIT, period)))
        return (at + near).cast("int")

    spans = F.filter(F.transform(F.array_sort(F.array_compact(starts)), lambda at: F.struct(at.alias("start"), end(at).alias("end"))), lambda s: s["end"] > s["start"])

    def typed(s: Column) -> Column:
        literal = T.part(view, s["start"], s["end"])
        fits = lambda *ps: literal.rlike(P.flagged(r"\A(?:" + "|".join(ps) + r")\z"))
        vague_law = literal.rlike(r"\A(?:" + "|".join(P.LAW_CUES) + ")")
        explicit = F.when(fits(P.LAW), "law").when(fits(P.SUMMARY, P.TOPIC), "sumula").when(fits(P.TST_CASE, P.TSE_CASE, P.CASE), "case").otherwise("incomplete")
        kind = F.when(fits(P.LAW) | ((explicit == "incomplete") & vague_law), "lei").otherwise("jurisprudencia")
        return candidate(s, kind, explicit, 110)

    return F.transform(spans, typed)


def is_distractor(view: Column, item: Column) -> Column:
    """A case number that an administrative word introduces."""
    lo = F.greatest(item["start"] - P.DISTRACTOR_WINDOW, F.lit(0))
    return (item["explicit_type"] == "case") & T.part(view, lo, item["start"]).rlike("(?U)" + P.DISTRACTOR)


def arbitrate(items: Column) -> Column:
    """Greedy choice: explicit before vague, then priority, length, start; what overlaps a chosen one goes. By position."""
    rank = lambda x: F.struct((x["explicit_type"] == "incomplete").cast("int").alias("a"), (-x["priority"]).alias("b"), (x["start"] - x["end"]).alias("c"), x["start"].alias("d"), x.alias("item"))
    ordered = F.transform(F.array_sort(F.transform(items, rank)), lambda r: r["item"])
    clash = lambda a, b: F.least(a["end"], b["end"]) > F.greatest(a["start"], b["start"])
    chosen = F.aggregate(ordered, F.array().cast(f"array<{CANDIDATE}>"), lambda acc, x: F.when(F.exists(acc, lambda y: clash(x, y)), acc).otherwise(F.array_append(acc, x)))
    return F.array_sort(chosen)


def extract(docs: DataFrame, id_col: str = "documento_id", text_col: str = "texto", templates: bool = False) -> DataFrame:
    """A row for each citation: documento_id, start, end, kind, explicit_type, literal.

    Narrow: one pass over the texts, no shuffle, no Python. The view is a column of its own, so it is
    computed once for all patterns.
    """
    text, view = F.col("texto"), F.col("view")
    rows = docs.select(F.col(id_col).alias("documento_id"), F.col(text_col).alias("texto")).filter("texto IS NOT NULL").withColumn("view", T.matching_view(text))
    found = [explicit_candidates(view, *g) for g in GRAMMAR] + [vague_candidates(view)] + ([template_candidates(text, view)] if templates else [])
    rows = rows.withColumn("items", F.concat(*[x.cast(f"array<{CANDIDATE}>") for x in found]))
    rows = T.kept(rows, F.size("items") > 0).withColumn("body", T.body_start(text, view))
    kept = F.filter("items", lambda x: (x["start"] >= F.col("body")) & ~is_distractor(view, x))
    rows = rows.withColumn("kept", kept).withColumn("item", F.explode(arbitrate(F.col("kept"))))
    return rows.select("documento_id", "item.start", "item.end", "item.kind", "item.explicit_type", T.part(text, F.col("item.start"), F.col("item.end")).alias("literal"))
