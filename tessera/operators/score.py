"""The official score: cells to spans, greedy IoU matching, class F1, grave errors, calibration, level weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import patterns as P


#: Where a row stands in the file it was read from.
POSITION = "_position"


class SubmissionError(ValueError):
    """A fault of the submission, shown to its author."""


class GoldError(ValueError):
    """A fault of the labels."""


def norm_id(value: Column) -> Column:
    """Without white space around it and zeros before it."""
    value = F.trim(value)
    return F.when(value.rlike(r"\A\d+\z"), F.regexp_replace(value, r"^0+(?=\d)", "")).otherwise(value)


def encode(citations: DataFrame) -> DataFrame:
    """documento_id, citacoes: blocks start,end,class,id,confidence in order; a missing id or confidence is -."""
    block = F.concat_ws(",", F.col("start").cast("string"), F.col("end").cast("string"), "classification", F.coalesce(F.nullif(F.trim("canonical_id"), F.lit("")), F.lit("-")), F.when(F.col("confidence").isNull(), F.lit("-")).otherwise(F.format_string("%.4f", F.col("confidence"))))
    ordered = F.array_sort(F.collect_list(F.struct("start", "end", block.alias("block"))))
    return citations.groupBy("documento_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "|").alias("citacoes"))


def cells(docs: DataFrame, citations: DataFrame) -> DataFrame:
    """A cell for every document; - if it has no citation."""
    return docs.select("documento_id").join(encode(citations), "documento_id", "left").select("documento_id", F.coalesce("citacoes", F.lit("-")).alias("citacoes"))


def _blocks(frame: DataFrame, carried: list[str]) -> DataFrame:
    cell = F.trim(F.coalesce(F.col("citacoes"), F.lit("")))
    rows = frame.select(*carried, cell.alias("cell")).filter("cell NOT IN ('', '-')").select(*carried, F.posexplode(F.split("cell", r"\|")).alias("pos", "block"))
    return rows.filter(F.trim("block") != "").withColumn("f", F.transform(F.split(F.trim("block"), ","), lambda x: F.trim(x)))


def parse_submission(frame: DataFrame, by: tuple[str, ...] = ("documento_id",)) -> DataFrame:
    """by, pos, start, end, classe, id, conf, error (null if the block is valid)."""
    rows = _blocks(frame, list(by))
    f = lambda i: F.get("f", F.lit(i))
    start, end, name, conf = f(0).try_cast("int"), f(1).try_cast("int"), F.lower(f(2)), f(4).try_cast("double")
    blank = lambda x: x.isin("", "-")
    error = (
        F.when(F.size("f") != 5, "fields").when(start.isNull() | end.isNull(), "offset").when((start < 0) | (end <= start), "span").when(~name.isin(P.CLASSES), "class")
        .when((name == "real") & blank(f(3)), "no id").when((name == "real") & ~f(3).rlike(r"\A\d+\z"), "id").when(~blank(f(4)) & conf.isNull(), "confidence")
        .when(~blank(f(4)) & ~conf.between(0.0, 1.0), "confidence range")
    )
    return rows.select(*by, "pos", start.alias("start"), end.alias("end"), name.alias("classe"), F.when(~blank(f(3)), norm_id(f(3))).alias("id"), F.when(~blank(f(4)), conf).alias("conf"), error.alias("error"))


def parse_solution(frame: DataFrame, by: tuple[str, ...] = ("documento_id", "nivel")) -> DataFrame:
    """by, pos, start, end, classe, ids, error."""
    rows = _blocks(frame, list(by))
    f = lambda i: F.get("f", F.lit(i))
    ids = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(F.coalesce(f(3), F.lit("")), ":"), lambda x: ~F.trim(x).isin("", "-")), norm_id)))
    start, end, name = f(0).try_cast("int"), f(1).try_cast("int"), F.lower(f(2))
    error = F.when(F.size("f") < 4, "fields").when(start.isNull() | end.isNull(), "offset").when((name == "real") & (F.size(ids) == 0), "no id")
    return rows.select(*by, "pos", start.alias("start"), end.alias("end"), name.alias("classe"), ids.alias("ids"), error.alias("error"))


def _inter(a: Column, b: Column) -> Column:
    return F.greatest(F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]), F.lit(0))


def _union(a: Column, b: Column) -> Column:
    return a["end"] - a["start"] + b["end"] - b["start"] - _inter(a, b)


def matched(golds: Column, preds: Column) -> Column:
    """Greedy one-to-one pairs (gi, pi) by IoU, then gold and prediction order. Greedy even where, at IoU 1/2, more pairs could be made."""
    pair = lambda g, p: F.struct((-(_inter(g, p) / _union(g, p))).alias("v"), g["i"].alias("gi"), p["i"].alias("pi"))
    near = F.flatten(F.transform(golds, lambda g: F.transform(F.filter(preds, lambda p: (_inter(g, p) > 0) & (2 * _inter(g, p) >= _union(g, p))), lambda p: pair(g, p))))
    none = F.array().cast("array<struct<gi:int,pi:int>>")
    taken = lambda acc, x: F.exists(acc, lambda y: (y["gi"] == x["gi"]) | (y["pi"] == x["pi"]))
    return F.aggregate(F.array_sort(near), none, lambda acc, x: F.when(taken(acc, x), acc).otherwise(F.array_append(acc, F.struct(x["gi"], x["pi"]))))


_GOLD = "array<struct<i:int,start:int,end:int,classe:string,ids:array<string>>>"
_PRED = "array<struct<i:int,start:int,end:int,classe:string,id:string,conf:double>>"


def documents(golds: DataFrame, preds: DataFrame, by: list[str]) -> DataFrame:
    """by, nivel, golds, preds, pairs: one row for each document that has a gold or a prediction.

    golds (by, nivel, pos, start, end, classe, ids); preds (by, pos, start, end, classe, id, conf).
    Two shuffles on `by`; matching is a fold over a document's few spans.
    """
    g = golds.groupBy(*by, "nivel").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("i"), "start", "end", "classe", "ids"))).alias("golds"))
    p = preds.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("i"), "start", "end", "classe", "id", "conf"))).alias("preds"))
    both = g.join(p, by, "left").withColumn("golds", F.col("golds").cast(_GOLD)).withColumn("preds", F.coalesce(F.col("preds").cast(_PRED), F.array().cast(_PRED)))
    return both.withColumn("pairs", matched(F.col("golds"), F.col("preds")))


_EVENT = "struct<classe:string,tp:int,fp:int,fn:int,suporte:int,grave:int,invented:int,brier:double>"


def events(docs: DataFrame, by: list[str]) -> DataFrame:
    """A row for each count that a document adds: by, nivel, classe, tp, fp, fn, suporte, grave, invented, brier."""

    def event(classe: Column, tp=0, fp=0, fn=0, sup=0, grave=0, invented=0, brier=None) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        names = ["classe", "tp", "fp", "fn", "suporte", "grave", "invented", "brier"]
        values = [classe, tp, fp, fn, sup, grave, invented, F.lit(None).cast("double") if brier is None else brier]
        return F.struct(*[lit(v).alias(n) for v, n in zip(values, names, strict=True)]).cast(_EVENT)

    of = lambda xs, i: F.get(F.filter(xs, lambda x: x["i"] == i), F.lit(0))
    one = lambda c: F.when(c, 1).otherwise(0)

    def paired(x: Column) -> Column:
        g, p = of(F.col("golds"), x["gi"]), of(F.col("preds"), x["pi"])
        same = g["classe"] == p["classe"]
        right = same & ((g["classe"] != "real") | F.coalesce(F.array_contains(g["ids"], p["id"]), F.lit(False)))
        miss = F.pow(p["conf"] - one(right), F.lit(2))
        grave = one((g["classe"] == "inventada") & (p["classe"] == "real"))
        return F.array(event(g["classe"], tp=one(right), fn=one(~same)), event(p["classe"], fp=one(~right), grave=grave, brier=miss))

    support = F.transform("golds", lambda g: event(g["classe"], sup=1, invented=one(g["classe"] == "inventada")))
    lone_gold = F.transform(F.filter("golds", lambda g: ~F.exists("pairs", lambda x: x["gi"] == g["i"])), lambda g: event(g["classe"], fn=1))
    met = F.filter("golds", lambda g: F.exists("pairs", lambda x: x["gi"] == g["i"]))
    inside = lambda p: F.exists(met, lambda g: _inter(p, g) / (p["end"] - p["start"]) >= P.CONTAINED_SHARE)
    lone_pred = F.transform(F.filter("preds", lambda p: ~F.exists("pairs", lambda x: x["pi"] == p["i"]) & ~inside(p)), lambda p: event(p["classe"], fp=1))
    every = F.concat(support, F.flatten(F.transform("pairs", paired)), lone_gold, lone_pred)
    return docs.select(*by, "nivel", F.explode(every).alias("e")).select(*by, "nivel", "e.*")


def confusion(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, nivel, classe and sums of the counts."""
    names = ["tp", "fp", "fn", "suporte"]
    return rows.groupBy(*by, "nivel", "classe").agg(*[F.sum(n).alias(n) for n in names])


def level_scores(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, nivel, macro_f1, tau, brier, s, b, score. Classes without gold don't count; a level needs one with gold."""
    sums = rows.groupBy(*by, "nivel", "classe").agg(
        *[F.sum(n).alias(n) for n in ("tp", "fp", "fn", "suporte", "grave", "invented")], F.sum("brier").alias("brier_sum"), F.count("brier").alias("brier_n"))
    whole = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f1 = F.when(F.col("suporte") > 0, F.when(whole > 0, 2 * F.col("tp") / whole).otherwise(0.0))
    level = sums.withColumn("f1", f1).groupBy(*by, "nivel").agg(
        F.avg("f1").alias("macro_f1"), (F.sum("grave") / F.nullif(F.sum("invented"), F.lit(0))).alias("tau"), (F.sum("brier_sum") / F.nullif(F.sum("brier_n"), F.lit(0))).alias("brier")).filter("macro_f1 IS NOT NULL")
    level = level.withColumn("tau", F.coalesce("tau", F.lit(0.0))).withColumn("s", F.col("macro_f1") * (1 - P.GRAVE_WEIGHT * F.col("tau")))
    bonus = F.greatest(F.lit(0.0), F.least(F.lit(P.BONUS_CAP), P.BONUS_CAP * (1 - F.col("brier"))))
    level = level.withColumn("b", F.when(F.col("brier").isNull(), 0.0).otherwise(bonus))
    return level.withColumn("score", F.col("s") * (1 + F.col("b")))


def final_scores(levels: DataFrame, by: list[str]) -> DataFrame:
    """by, score_final: the mean of the levels present, by their weights."""
    weight = F.lit(1.0)
    for level, w in P.LEVEL_WEIGHTS.items():
        weight = F.when(F.col("nivel") == level, F.lit(w)).otherwise(weight)
    return levels.groupBy(*by).agg((F.sum(weight * F.col("score")) / F.sum(weight)).alias("score_final"))


def first_rows(frame: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by an explicit order."""
    return frame.withColumn("_no", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_no = 1").drop("_no")


def check_columns(solution: DataFrame, submission: DataFrame, row_id: str) -> None:
    for frame, name, wanted in ((solution, "solution", {row_id, "nivel", "citacoes"}), (submission, "submission", {row_id, "citacoes"})):
        if lacking := wanted - set(frame.columns):
            raise SubmissionError(f"the {name} lacks columns {sorted(lacking)}")


def evaluate(solution: DataFrame, submission: DataFrame, row_id: str = "documento_id", order: str | None = None) -> DataFrame:
    """Level rows (level_scores) after all checks; raises SubmissionError or GoldError.

    `order` names a column that says which of repeated submission rows is first: by default POSITION,
    which the CSV reader adds. Without either, repeated rows must be equal to count as one. The driver
    sees one example of a fault, not the data.
    """
    order = order or (POSITION if POSITION in submission.columns else None)
    check_columns(solution, submission, row_id)
    gold = solution.drop("Usage").withColumnRenamed(row_id, "documento_id")
    sub = submission.withColumnRenamed(row_id, "documento_id")
    sub = first_rows(sub, "documento_id", order) if order else sub.select("documento_id", "citacoes").distinct()
    absent = gold.join(sub, "documento_id", "left_anti").select("documento_id").take(1)
    if absent:
        raise SubmissionError(f"no row for {absent[0][0]} and maybe others")
    golds, preds = parse_solution(gold), parse_submission(sub.join(gold.select("documento_id").distinct(), "documento_id", "left_semi"))
    from tessera.operators.resolve import overlapping

    for found, kind in ((golds.filter("error IS NOT NULL"), GoldError), (overlapping(golds, ["documento_id"], 1e-12), GoldError), (preds.filter("error IS NOT NULL"), SubmissionError), (overlapping(preds.filter("error IS NULL"), ["documento_id"], P.IOU_LEAST), SubmissionError)):
        bad = found.take(1)
        if bad:
            raise kind(f"invalid block: {bad[0].asDict()}")
    return level_scores(events(documents(golds, preds, ["documento_id"]), ["documento_id"]).drop("documento_id"), [])


def score(solution: DataFrame, submission: DataFrame, row_id: str = "documento_id", order: str | None = None) -> float:
    levels = final_scores(evaluate(solution, submission, row_id, order), []).first()
    if levels is None or levels[0] is None:
        raise SubmissionError("nothing to evaluate")
    return float(levels[0])


def require_score(score: float, expected: float) -> float:
    """The gate of a release: raises unless the score is the expected one."""
    if abs(score - expected) > 1e-12:
        raise SubmissionError(f"score {score:.12f}, expected {expected:.12f}")
    return score
