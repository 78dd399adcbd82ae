"""Temperature mixing of sources, with SQL functions alone.

A source with a share q of the tokens gets the weight q**e / sum(q**e). The exponent e is found by
bisection (CUTS cuts at a time) so that the weights' entropy meets a target, or so that no source is
repeated more than a limit allows; e = 1 leaves the shares, e = 0 makes them equal. The budget is the
least at which every document is used at least once, or a given number of tokens.

A weight is realised as whole epochs of its source and one partial epoch. For the latter, documents
are dealt to blocks by a hash, the blocks are permuted, and blocks are taken in that order
until the budget is met; of the block in which it runs out, documents are taken in hash order while
they fit. Each source's decision is four numbers, so documents aren't shuffled: the table of sources
is joined to them, and Spark broadcasts it only if its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import materialize

#: At least so many blocks; of more rows, one for each BLOCK_ROWS, so that the one block a source is cut in stays small.
BLOCKS, BLOCK_ROWS, CUTS, ROUNDS = 1024, 10_000, 32, 9


def tokens(text: Column) -> Column:
    """Words between single spaces and line ends; a null text has none."""
    spaces = lambda c: F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit("")))
    return F.coalesce(F.lit(1) + spaces(" ") + spaces("\n"), F.lit(0)).cast("long")


def _hash(first: int, digits: int, *parts) -> Column:
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), first, digits), 16, 10).cast("long")


def exponent(sources: DataFrame, max_repeats: float | None = None, entropy: float | None = None) -> float:
    """The exponent in [0, 1] that meets the limit or target as flatly as it can; `sources` has `n` tokens (over 0) a row."""
    total = sources.agg(F.sum("n")).first()[0]
    if not total:
        return 1.0
    q = F.col("n") / F.lit(total)
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        tried = [lo + (hi - lo) * i / CUTS for i in range(CUTS + 1)]
        if max_repeats is not None:  # falls with e: epochs of the rarest source when the most frequent has one
            told = [F.max(F.pow(q, F.lit(e - 1))) / F.min(F.pow(q, F.lit(e - 1))) for e in tried]
            goal = max_repeats
        else:  # falls with e
            z = [F.sum(F.pow(q, F.lit(e))) for e in tried]
            told = [F.log(s) - F.lit(e) * F.sum(F.pow(q, F.lit(e)) * F.log(q)) / s for s, e in zip(z, tried, strict=True)]
            goal = entropy
        value = sources.agg(*[t.alias(f"v{i}") for i, t in enumerate(told)]).first()
        if value[0] <= goal and max_repeats is not None:
            return lo
        over = [i for i in range(CUTS + 1) if value[i] > goal]
        k = over[-1] if over else 0
        if k == CUTS:
            return hi
        lo, hi = tried[k], tried[k + 1]
    return hi


def blocks_of(docs: DataFrame) -> int:
    return max(BLOCKS, -(-docs.count() // BLOCK_ROWS))


def plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, max_repeats: float | None, entropy: float | None, budget: int | None, seed: int, among: int | None = None) -> DataFrame:
    """A row for each source: source, n, weight, epochs (whole ones), cut, last_block, last_cut; `among` so many blocks."""
    among = among or blocks_of(docs)
    sized = docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("n"))
    per_block = sized.select("source", "n", _hash(1, 8, seed, F.col("id")).alias("h")).groupBy("source", F.pmod("h", F.lit(among)).alias("block")).agg(F.sum("n").alias("n"))
    blocks = materialize(per_block, "blocks")
    sources = blocks.groupBy("source").agg(F.sum("n").alias("n"))
    some = materialize(sources.filter("n > 0"), "sources")
    e = exponent(some, max_repeats, entropy)
    total, z = some.agg(F.sum("n"), F.sum(F.pow(F.col("n"), F.lit(e)))).first()
    weight = F.pow(F.col("n"), F.lit(e)) / F.lit(float(z or 1))
    # The budget: by default, the most frequent source (by tokens over weight) has one epoch.
    used = some.agg(F.max(F.col("n") / weight)).first()[0] if budget is None else budget
    epochs = F.lit(float(used or 0)) * weight / F.col("n") + F.lit(1e-9)
    split = some.select("source", F.col("n").alias("total"), weight.alias("weight"), F.floor(epochs).alias("epochs"), ((epochs - F.floor(epochs)) * F.col("n")).alias("wanted"))
    order = _hash(1, 8, seed, F.col("source"), F.col("block"), F.col("epochs")) * among + F.col("block")
    parts = split.select(F.col("source").alias("split_source"), "epochs", "wanted")
    placed = blocks.join(parts, F.col("source").eqNullSafe(F.col("split_source"))).select("source", "block", "n", "epochs", "wanted", order.alias("spot"))
    run = F.sum("n").over(Window.partitionBy("source").orderBy("spot"))
    dealt = placed.withColumn("run", run).withColumn("fits", F.col("run") <= F.col("wanted"))
    last = dealt.filter("not fits").groupBy("source").agg(F.min_by(F.struct("block", (F.col("wanted") - F.col("run") + F.col("n")).alias("left")), "spot").alias("last"))
    cut = dealt.filter("fits").groupBy("source").agg(F.max("spot").alias("cut"))
    edge = materialize(last.select(F.col("source").alias("edge_source"), F.col("last.block").alias("last_block"), F.col("last.left").alias("left")), "edges")
    # The documents of one block of each source, in hash order.
    inside = sized.join(F.broadcast(edge) if edge.count() <= 100_000 else edge, F.col("source").eqNullSafe(F.col("edge_source")) & (F.pmod(_hash(1, 8, seed, F.col("id")), F.lit(among)) == F.col("last_block")))
    line = inside.withColumn("v", _hash(9, 12, seed, F.col("id")))
    taken = line.withColumn("run", F.sum("n").over(Window.partitionBy("edge_source").orderBy("v"))).filter(F.col("run") <= F.col("left"))
    last_cut = taken.groupBy("edge_source").agg(F.max("v").alias("last_cut"))
    none = F.lit(-1).cast("long")
    empty = sources.filter("n = 0").select("source", F.lit(0).cast("long").alias("total"), F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("epochs"), F.lit(0.0).alias("wanted"))
    every = split.unionByName(empty)
    every = every.join(cut.withColumnRenamed("source", "cut_source"), F.col("source").eqNullSafe(F.col("cut_source")), "left").join(edge, F.col("source").eqNullSafe(F.col("edge_source")), "left").drop("edge_source")
    every = every.join(last_cut, F.col("source").eqNullSafe(F.col("edge_source")), "left")
    return materialize(every.select("source", "total", "weight", "epochs", F.coalesce("cut", none).alias("cut"), F.coalesce(F.col("last_block"), none).alias("last_block"), F.coalesce("last_cut", none).alias("last_cut")), "mixture")


def mix(docs: DataFrame, max_repeats: float | None = 1.5, entropy: float | None = None, budget: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1) -> DataFrame:
    """The rows of `docs`, each as often as its source's weight asks, with `mix_` columns: source weight, epoch, block.

    Without a budget every row occurs at least once. A null source is a source; a source without any
    token has weight 0 and one epoch. Rows of one id are in one block and are taken together. No rows
    give no rows. Columns that are already called as the new ones are replaced.
    """
    docs = docs.drop("mix_weight", "mix_epoch", "mix_block")
    among = blocks_of(docs)
    told = plan(docs, id_col, text_col, source_col, max_repeats, entropy, budget, seed, among)
    plans = told.select(*[F.col(c).alias(f"__mix_{c}") for c in told.columns])
    both = docs.join(plans, docs[source_col].eqNullSafe(plans["__mix_source"]))
    block = F.pmod(_hash(1, 8, seed, F.col(id_col)), F.lit(among))
    both = both.withColumn("mix_block", block)
    spot = _hash(1, 8, seed, F.col("__mix_source"), F.col("mix_block"), F.col("__mix_epochs")) * among + F.col("mix_block")
    more = (spot <= F.col("__mix_cut")) | ((F.col("mix_block") == F.col("__mix_last_block")) & (_hash(9, 12, seed, F.col(id_col)) <= F.col("__mix_last_cut")))
    copies = F.col("__mix_epochs") + F.when(more, 1).otherwise(0)
    rows = both.withColumn("__mix_copies", copies).filter("__mix_copies > 0").withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__mix_copies") - 1)))
    return rows.select(*docs.columns, F.col("__mix_weight").alias("mix_weight"), "mix_epoch", "mix_block")
