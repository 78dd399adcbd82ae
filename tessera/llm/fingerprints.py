"""I-Match fingerprints, with SQL functions alone.

A text's terms are kept if their document frequency, so their inverse document frequency, is in a
chosen band. The distinct terms of a text are sorted, and the terms it has in each of several random
subsets of the lexicon are hashed.

Subsets come in 64 families, to which a hash deals the terms. Those of a family are nested: the n-th
holds its terms whose hash ends in n zero bits or more, so about half of the one before. A text uses
of each family the smallest subset that holds one of its terms: one or two terms, however long the
text is. (Subsets of one size would hold many terms of a long text, and one changed term breaks them.)
Two texts agree in about as many families as they share terms, of all they have.

The lexicon has at most (mean number of distinct terms of a text) / LOW terms, however large the
corpus; it goes to the executors as one byte string with SLOTS slots a term, in which a term's hash
names a slot. A term outside the band passes with a probability of 1 / SLOTS at most, and then
always, so equal texts have equal fingerprints.

Frequencies count distinct texts, so exact copies don't move the band. Terms of a large group of near
copies can still be above it: a text with fewer than LEAST terms in the lexicon takes the more
frequent terms as well, octave by octave, and at last all its terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import materialize

#: Shares of the texts that a term of the lexicon is in.
LOW, HIGH, FAMILY_BITS, SLOTS, RANGE_ROWS, MOST_RANGES, BROADCAST_ROWS = 0.005, 0.1, 6, 64, 20_000, 500_000, 1_000_000
#: Least number of terms of a fingerprint, if a text has them; octaves above the band.
LEAST, OCTAVES = 8, 3
#: First code points of the families' and the levels' signs; hex digits kept of each hash; code points that order rows of one id.
FAMILIES, LEVELS, TAIL, LEAD = 0x4E00, 0x3400, 6, 32
_LOW_BITS = 52


def terms(text: Column) -> Column:
    """Distinct runs of letters and digits, in lower case, as 64-bit hashes."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(F.array_distinct(words), lambda w: w != ""), lambda w: F.xxhash64(w))


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, row1, row2: rows with a 128-bit name of their id and text. A null text is empty."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    null = F.col("doc_id").isNull()
    return rows.withColumns({"row1": F.xxhash64(null, "doc_id", "text"), "row2": F.xxhash64("text", F.lit(7), null, "doc_id")})


def keys_of(rows: DataFrame) -> DataFrame:
    """What orders rows and tells repeats, without the texts: written once, read often."""
    told = {"lead": F.substring("text", 1, LEAD), "text1": F.xxhash64("text"), "text2": F.xxhash64("text", F.lit(7)), "n": F.char_length("text")}
    return materialize(rows.withColumns(told).select("doc_id", "row1", "row2", *told), "keys")


def lexicon(rows: DataFrame, keys: DataFrame, low: float = LOW, high: float = HIGH) -> bytes:
    """Slots of the terms whose document frequency is at least `low`: 1 in the band, 2 to 1 + OCTAVES above it.

    Counts distinct texts: of rows with equal texts (`keys` tell them), the others than the one of the
    least name are left out, by a broadcast of their names only where they are few.
    """
    texts = keys.groupBy("text1", "text2").agg(F.min(F.struct("row1", "row2")).alias("first"), F.max(F.struct("row1", "row2")).alias("last"))
    texts = materialize(texts, "texts")
    n, repeated = texts.count(), texts.filter("first <> last").select("text1", "text2", "first")
    others = materialize(keys.join(repeated, ["text1", "text2"]).filter(F.struct("row1", "row2") != F.col("first")).select("row1", "row2").distinct(), "others")
    many = others.count()
    one = rows.join(F.broadcast(others) if many <= BROADCAST_ROWS else others, ["row1", "row2"], "left_anti") if many else rows
    df = one.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    octave = F.lit(1)
    for i in range(OCTAVES):
        octave = octave + (F.col("df") > high * n * 2**i).cast("int")
    band = materialize(df.filter(F.col("df") >= max(2, low * n)).select("term", octave.alias("octave")), "lexicon")
    size, wanted = 1 << 10, SLOTS * band.count()
    while size < wanted:
        size *= 2
    slots = bytearray(size)
    for slot, mark in band.groupBy(F.pmod("term", F.lit(size))).agg(F.min("octave")).collect():
        slots[slot] = mark
    return bytes(slots)


def with_parts(rows: DataFrame, text_col: str, out: str, slots: bytes) -> DataFrame:
    """`rows` with `out`, a string for each family of subsets: its number and a hash of the text's sorted terms in the smallest subset that has any.

    A text without terms has one part, a hash of the whole text under a number of its own.
    """
    marks, text, own = F.lit(bytearray(slots)), F.col(text_col), F.col(f"{out}_terms")
    # The slots are a large literal: each term is marked once, in one place.
    marked = F.transform(terms(text), lambda t: F.struct(F.substring(marks, (F.pmod(t, F.lit(len(slots))) + 1).cast("int"), F.lit(1)).alias("octave"), t.alias("term")))
    within = lambda top: F.filter(own, lambda t: t["octave"].isin([bytearray([x]) for x in range(1, top + 1)]))["term"]
    rows = rows.withColumn(f"{out}_terms", marked).withColumn(f"{out}_band", within(1))
    enough = F.when(F.size(f"{out}_band") >= LEAST, F.col(f"{out}_band"))
    for top in range(2, 2 + OCTAVES):
        enough = enough.when(F.size(within(top)) >= LEAST, within(top))
    # Sorted by family (the first bits), then from the smallest subset up (by the zero bits at the end), then by the rest.
    spare = 64 - FAMILY_BITS - _LOW_BITS
    level = lambda t: F.lit((1 << spare) - 1) - F.least(F.bit_count(t.bitwiseAND(-t) - 1), F.lit((1 << spare) - 1))
    family = F.lit(-(1 << (64 - FAMILY_BITS)))
    placed = F.transform(enough.otherwise(own["term"]), lambda t: t.bitwiseAND(family).bitwiseOR(F.shiftleft(level(t).cast("long"), _LOW_BITS)).bitwiseOR(t.bitwiseAND(F.lit((1 << _LOW_BITS) - 1))))
    sign = lambda first, n, at: F.substring(F.lit("".join(chr(first + i) for i in range(n))), at.cast("int") + 1, F.lit(1))
    line = F.transform(F.sort_array(placed), lambda v: F.concat(
        sign(FAMILIES, 1 << FAMILY_BITS, F.shiftrightunsigned(v, 64 - FAMILY_BITS)), sign(LEVELS, 1 << spare, F.shiftrightunsigned(v, _LOW_BITS).bitwiseAND(F.lit((1 << spare) - 1))), F.hex(v.bitwiseAND(F.lit((1 << _LOW_BITS) - 1)))))
    # Of each family, the run of the first level; the rest of the family goes.
    f, lv = f"[{chr(FAMILIES)}-{chr(FAMILIES + 63)}]", f"[{chr(LEVELS)}-{chr(LEVELS + 63)}]"
    runs = F.regexp_extract_all(F.array_join(line, ""), F.lit(rf"(({f})({lv})[0-9A-F]+(?:\2\3[0-9A-F]+)*)(?:\2{lv}[0-9A-F]+)*"), F.lit(1))
    short = lambda h: F.lower(F.substring(F.lpad(F.hex(h), 16, "0"), 1, TAIL))
    found = F.transform(runs, lambda r: F.concat(F.lpad(F.lower(F.hex(F.ascii(r) - FAMILIES)), 2, "0"), short(F.xxhash64(r))))
    none = F.array(F.concat(F.lit("zz"), F.lower(F.hex(F.xxhash64(text)))))
    # Two steps, so that `found` is computed once.
    return rows.withColumn(out, found).withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(none)).drop(f"{out}_terms", f"{out}_band")


def likeness(a: Column, b: Column) -> Column:
    """Families in which two fingerprints agree, over those that either has; 0 to 1."""
    families = lambda x: F.transform(x, lambda p: F.substring(p, 1, 2))
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(families(a), families(b)))


def _order(*first: str) -> list:
    return [*first, F.col("doc_id").desc_nulls_last(), "lead", "row1", "row2"]


def limits_of(keys: DataFrame) -> DataFrame:
    """range, doc_id, lead, row1, row2: the first row of each range of distinct rows, by _order.

    A range has about RANGE_ROWS rows, and more only where there would be over MOST_RANGES of them.

    Only keys are sorted and sampled; rows of one id, or without one, are as many ranges as they need.
    """
    spark = keys.sparkSession
    rows = keys.select("doc_id", "lead", "row1", "row2").dropDuplicates(["row1", "row2"])
    ranges = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // RANGE_ROWS)))
    ranged = materialize(rows.repartitionByRange(ranges, *_order()).withColumn("range", F.spark_partition_id()), "ranged")
    firsts = ranged.withColumn("no", F.row_number().over(Window.partitionBy("range").orderBy(*_order()))).filter("no = 1").drop("no")
    line = Window.orderBy("range")  # one row a range
    return materialize(firsts.withColumn("range", F.row_number().over(line) - 1), "limits")


def with_next(rows: DataFrame, keys: DataFrame, carried: list[str]) -> DataFrame:
    """`rows` (distinct ones) with next_<c> for each carried column: that of the next row by descending id, after the last that of the first.

    Rows go to ranges in one shuffle, and each range gets a copy of the first row of the range that
    follows, so no task sees more than a range. A row finds its range by halving the list of limits,
    of at most MOST_RANGES rows, which is sent to all tasks.
    """
    limits = limits_of(keys)
    ranges = limits.count()
    if not ranges:
        return rows.withColumns({f"next_{c}": F.col(c) for c in carried})
    fields = ["doc_id", "lead", "row1", "row2"]
    every = limits.agg(F.transform(F.array_sort(F.collect_list(F.struct("range", *fields))), lambda x: F.struct(*[x[c].alias(c) for c in fields])).alias("limits")).withColumn("all", F.lit(0))
    tie = lambda x: F.struct(x["lead"], x["row1"], x["row2"])
    own = F.struct(*fields)
    reached = lambda x: F.when(x["doc_id"].eqNullSafe(own["doc_id"]), tie(x) <= tie(own)).otherwise(own["doc_id"].isNull() | F.coalesce(x["doc_id"] > own["doc_id"], F.lit(False)))
    steps = F.array(*[F.lit(1 << i) for i in range(ranges.bit_length() - 1, -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(at + step < ranges, F.when(reached(F.get("limits", at + step)), at + step).otherwise(at)).otherwise(at))
    placed = rows.withColumn("lead", F.substring("text", 1, LEAD)).withColumn("all", F.lit(0)).join(F.broadcast(every), "all").withColumn("range", found)
    first = F.get("limits", F.col("range"))
    heads = (first["row1"] == F.col("row1")) & (first["row2"] == F.col("row2"))
    spots = F.array(F.struct(F.col("range").alias("at"), F.lit(0).alias("ghost")), F.when(heads, F.struct(F.pmod(F.col("range") - 1, F.lit(ranges)).alias("at"), F.lit(1).alias("ghost"))))
    dealt = placed.withColumn("spot", F.explode(F.array_compact(spots))).select(*rows.columns, "lead", F.col("spot.at").alias("at"), F.col("spot.ghost").alias("ghost"))
    order = Window.partitionBy("at").orderBy(*_order("ghost"))
    out = dealt.select(*rows.columns, "ghost", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
    return out.filter("ghost = 0").drop("ghost")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by as many
    first ones of the next document's text (or all of it), by descending id; the last one's next is
    the first, so a single document's next is itself. A null text is empty. Null ids come last. Rows
    that repeat an id follow each other by the first LEAD code points of their text, then by their
    name; of repeats of a whole row, the next of each but the last is the row itself. No rows give no
    rows; other columns are not read.

    Texts are read three times, for their keys, for the lexicon, and for the parts, and shuffled once.
    """
    rows = named(docs, id_col, text_col)
    keys = keys_of(rows)
    repeats = materialize(keys.groupBy("row1", "row2").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "repeats")
    repeated = not repeats.isEmpty()
    rows = rows.dropDuplicates(["row1", "row2"]) if repeated else rows
    slots = lexicon(rows, keys)
    paired = with_next(with_parts(rows, "text", "parts", slots), keys, ["text", "parts"])
    if repeated:
        paired = paired.join(repeats, ["row1", "row2"], "left").withColumn("turn", F.explode(F.sequence(1 - F.coalesce("copies", F.lit(1)), F.lit(0).cast("long"))))
        paired = paired.withColumns({f"next_{c}": F.when(F.col("turn") == 0, F.col(f"next_{c}")).otherwise(F.col(c)) for c in ("text", "parts")})
    size = F.char_length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - half), F.substring("next_text", F.lit(1), half))
    out = with_parts(paired.select("doc_id", size.cast("long").alias("n_chars"), "parts", "next_parts", edited.alias("edited")), "edited", "edited_parts", slots)
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.array_join("parts", "").alias("fingerprint"), F.array_join("edited_parts", "").alias("edited_fingerprint"),
        likeness(F.col("parts"), F.col("edited_parts")).alias("near_edited"), likeness(F.col("parts"), F.col("next_parts")).alias("near_next"),
    )
