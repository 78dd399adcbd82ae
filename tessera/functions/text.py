"""Text views and spans as Column expressions; offsets count code points and are half-open."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import patterns as P

_OTHER = {" ": " ", "–": "-", "—": "-", "−": "-", "º": "o", "°": "o"}
SPAN = "struct<start:int,end:int>"


def _plain(c: str) -> str:
    """Compatibility decomposition without combining marks."""
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


@cache
def view_map() -> tuple[str, str]:
    """Code points that the matching view changes and what they become; one to one, made from Unicode's tables."""
    pairs = {}
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        base = _plain(c).lower()
        to = _OTHER.get(c) or (base if len(base) == 1 else c.lower())
        if to != c and len(to) == 1:
            pairs[c] = to
    return "".join(pairs), "".join(pairs.values())


def kept(rows: DataFrame, condition: Column) -> DataFrame:
    """A filter on columns that are dear to compute. Catalyst would put a plain one below them, with their expressions in it, and compute them twice."""
    return rows.withColumn("_kept", F.explode(F.when(condition, F.array(F.lit(1))))).drop("_kept")


def matching_view(text: Column) -> Column:
    """Accents and case folded, dashes and ordinal signs made plain; as long as the text, so spans carry over."""
    source, target = view_map()
    return F.translate(text, source, target)


@cache
def folded_map() -> tuple[str, str, dict[str, str]]:
    """As view_map, for the short view: single foldings, what is deleted (its tail has no target), and all expansions to several characters."""
    pairs, gone, longer = {}, [], {}
    dashes = {"–": "-", "—": "-", "−": "-", "º": "o", "°": "o"}
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        to = dashes.get(c) or _plain(c).casefold()
        if to == c:
            continue
        if len(to) == 1:
            pairs[c] = to
        elif not to:
            gone.append(c)
        else:
            longer[c] = to
    return "".join(pairs) + "".join(gone), "".join(pairs.values()), longer


@cache
def expanding() -> str:
    """A character class of what folds to several characters, in ranges."""
    codes = {ord(c) for c in folded_map()[2]}
    starts, ends = sorted(c for c in codes if c - 1 not in codes), sorted(c for c in codes if c + 1 not in codes)
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True)) + "]"


def _expansion(c: Column) -> Column:
    """What a character of expanding() folds to: a Hangul syllable's parts by arithmetic, others from a list."""
    longer = {k: v for k, v in folded_map()[2].items() if not 0xAC00 <= ord(k) < 0xD7A4}
    letters = lambda first, n: F.lit("".join(chr(first + i) for i in range(n)))
    at = F.ascii(c) - 0xAC00
    syllable = F.concat(F.substring(letters(0x1100, 19), F.floor(at / 588).cast("int") + 1, F.lit(1)), F.substring(letters(0x1161, 21), F.floor(at % 588 / 28).cast("int") + 1, F.lit(1)), F.when(at % 28 > 0, F.substring(letters(0x11A8, 27), (at % 28).cast("int"), F.lit(1))).otherwise(""))
    listed = F.split_part(F.lit("\x01".join(longer.values())), F.lit("\x01"), F.instr(F.lit("".join(longer)), c))
    return F.when(at.between(0, 11171), syllable).otherwise(listed)


def short_view(text: Column) -> Column:
    """Accents, case and white space folded and trimmed; not of the text's length.

    Characters that fold to several (ligatures, letters like ß, syllables) are replaced one kind at a
    time, in the few texts that have any, after all others: the degree sign that ℃ folds to is no ordinal sign.
    """
    source, target, _ = folded_map()
    single = F.translate(text, source, target)
    kinds = F.array_distinct(F.regexp_extract_all(single, F.lit(expanding()), F.lit(0)))
    whole = F.when(text.rlike(expanding()), F.aggregate(kinds, single, lambda acc, c: F.replace(acc, c, _expansion(c)))).otherwise(single)
    return F.trim(F.regexp_replace(whole, r"(?U)\s+", " "))


def digits_key(value: Column) -> Column:
    """The digits without leading zeros; empty if there are none."""
    return F.regexp_replace(F.regexp_replace(value, r"(?U)\D", ""), r"^0+(?=\d)", "")


def length_before(text: Column, pattern: str) -> Column:
    """Code points before the first match; null if there is none."""
    return F.when(text.rlike(pattern), F.char_length(F.split(text, pattern, 2)[0]))


def find_spans(text: Column, pattern: str) -> Column:
    """array<struct<start,end>> of all matches, which must not be empty.

    What lies between matches and the matches themselves alternate, so offsets are running sums of
    lengths; Spark's own match offsets would count UTF-16 units.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(F.split(text, pattern, -1), found, lambda gap, hit: F.struct(F.char_length(gap).alias("gap"), F.char_length(hit).alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        lo = acc["at"] + piece["gap"]
        hi = lo + piece["hit"]
        return F.struct(F.coalesce(hi, lo).alias("at"), F.when(piece["hit"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], F.struct(lo.alias("start"), hi.alias("end")))).alias("out"))

    none = F.array().cast(f"array<{SPAN}>")
    return F.when(text.rlike(pattern), F.aggregate(pieces, start, step)["out"]).otherwise(none)


def part(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def trimmed(view: Column, span: Column) -> Column:
    """The span without white space at its start, and without white space or , ; : at its end."""
    inner = part(view, span["start"], span["end"])
    lead = F.char_length(F.regexp_extract(inner, r"(?U)\A\s*", 0))
    tail = F.char_length(F.regexp_extract(F.substring(inner, lead + 1, F.char_length(inner)), r"(?U)[\s,;:]*\z", 0))
    return F.struct((span["start"] + lead).cast("int").alias("start"), (span["end"] - tail).cast("int").alias("end"))


def body_start(text: Column, view: Column) -> Column:
    """Where the argument starts: after the first two blank lines, else after a section heading whose header names a case, else 0."""
    delimiter = "(?U)" + P.BODY_DELIMITER
    after = F.char_length(F.split(text, delimiter, 2)[0]) + F.char_length(F.regexp_extract(text, delimiter, 0))
    early = F.substring(view, F.lit(1), F.lit(P.HEADER_LIMIT))

    def in_header(span: Column) -> Column:
        header = F.substring(early, F.lit(1), span["start"])
        cues = [F.when(header.rlike("(?U)" + cue), 1).otherwise(0) for cue in P.HEADER_CUES]
        return sum(cues[1:], cues[0]) >= 2

    heading = F.filter(find_spans(early, P.flagged(P.BODY_HEADING)), in_header)
    return F.when(text.rlike(delimiter), after).otherwise(F.coalesce(F.get(heading, F.lit(0))["end"], F.lit(0))).cast("int")


#: A full stop before white space or the end, not after a single character or an abbreviation.
SENTENCE_STOP = r"(?U)(?<!(?:\A|[^a-z0-9])(?:[a-z0-9]|" + "|".join(P.ABBREVIATIONS) + r")\s{0,15})\.(?=\s|\z)"


def phrase_end(view: Column, start: Column) -> Column:
    """The nearest end of a vague reference that starts at `start`, trimmed; null if there is none near."""
    window = F.substring(view, start + 1, F.lit(P.PHRASE_LIMIT))
    wider = F.substring(view, start + 1, F.lit(P.PHRASE_LIMIT + 1))
    subject = P.flagged(P.SUBJECT)
    stop = length_before(wider, SENTENCE_STOP)
    ends = F.array(
        length_before(window, "(?U)" + P.BLANK_LINE), length_before(window, ";"), length_before(window, "(?U)" + P.CONTINUATION),
        length_before(window, subject) + F.char_length(F.regexp_extract(window, subject, 0)) - F.char_length(F.regexp_extract(window, subject, 1)),
        F.when(stop < P.PHRASE_LIMIT, stop), length_before(window, "(?U)" + P.ENDING_COMMA),
    )
    # The phrase starts with a letter, so trimming can only move the end.
    phrase = F.regexp_replace(F.substring(window, F.lit(1), F.array_min(ends)), r"(?U)[\s,;:]*\z", "")
    return F.when(F.array_min(ends).isNotNull(), start + F.char_length(F.regexp_replace(phrase, r"\.*\z", ""))).cast("int")


def names_a_case(phrase: Column) -> Column:
    """A vague reference counts if it names a class or court, a year and a reporter."""
    head = phrase.rlike("(?U)\\A(?:" + P.DESCRIBED_CASE + "|" + P.NAMED_DECISION + ")")
    return (F.char_length(phrase) > 0) & head & phrase.rlike("(?U)" + P.PHRASE_YEAR) & phrase.rlike("(?U)" + P.PHRASE_REPORTER)


def families(view: Column, court: Column | None = None) -> Column:
    """Procedural families that a context names."""
    tst = view.rlike("(?U)" + P.TST_FAMILY)
    if court is not None:
        tst = tst | (F.upper(court) == "TST")
    first = F.lit(None).cast("string")
    for name, pattern in reversed(P.EXCLUSIVE_FAMILIES):
        first = F.when(view.rlike("(?U)" + pattern), F.lit(name)).otherwise(first)
    rest = [F.when(view.rlike("(?U)" + pattern), F.lit(name)) for name, pattern in P.FAMILIES]
    return F.array_compact(F.array(F.when(tst, F.lit("tst")), first, *rest))


def only(values: Column) -> Column:
    """The one distinct value, or null."""
    distinct = F.array_distinct(values)
    return F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0)))


def statute(view: Column) -> Column:
    """The statute that a short view names, if just one."""
    return only(F.array_compact(F.array(*[F.when(view.rlike("(?U)" + pattern), F.lit(name)) for name, pattern in P.STATUTES])))


def article(view: Column) -> Column:
    """The first article number of a short view; null if there is none."""
    return F.when(view.rlike("(?U)" + P.ARTICLE), digits_key(F.regexp_extract(view, "(?U)" + P.ARTICLE, 1)))


def number_variants(view: Column) -> Column:
    """Digit keys that a cited number may stand for: misread letters are digits, and a g is a 9 or a 6. Longest first."""
    base = F.regexp_replace(view, P.VARIANT_STATE.replace("(?i)", "(?iU)"), "")
    chunks = F.regexp_extract_all(base, F.lit("(?U)" + P.VARIANT_CHUNK), F.lit(0))

    def expand(chunk: Column) -> Column:
        symbols = F.regexp_replace(F.translate(chunk, "olis", "0115"), r"(?U)[^\dg]", "")
        g = F.char_length(symbols) - F.char_length(F.replace(symbols, F.lit("g"), F.lit("")))
        grown = F.aggregate(
            F.split(symbols, ""), F.array(F.lit("")),
            lambda acc, c: F.when(c == "g", F.concat(F.transform(acc, lambda a: F.concat(a, F.lit("9"))), F.transform(acc, lambda a: F.concat(a, F.lit("6"))))).otherwise(F.transform(acc, lambda a: F.concat(a, c))),
        )
        fits = (F.char_length(symbols) > 0) & (F.char_length(symbols) <= 30) & (g <= 6)
        return F.when(fits, grown).otherwise(F.array().cast("array<string>"))

    every = F.array_distinct(F.flatten(F.transform(chunks, expand)))
    long = F.filter(every, lambda k: F.char_length(k) >= 3)
    ranked = F.array_sort(F.transform(long, lambda k: F.struct((-F.char_length(k)).alias("n"), k.alias("key"))))
    return F.transform(ranked, lambda s: s["key"])
