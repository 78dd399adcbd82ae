"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit, a binary classifier over hashed byte n-grams tells
the languages that have it from the others: its weights are smoothed log ratios, averaged over a
text's n-grams, and a fitted slope and offset turn the mean into a margin. Decoding adds up, for each
codeword, the logistic losses of the margins, weighted by how well each bit does on training rows;
the least loss wins, and a small lead over the second is flagged.

Training reads at most TRAIN_ROWS rows, picked by a hash of the id, in two scans of ids and languages
and one of texts, however many languages there are; prediction is a narrow map.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import LETTERS, LOWER, text_buffer

#: Bound of the training sample, shared equally by the languages.
TRAIN_ROWS = 4000
#: So many times a language's part is picked, since some picks may have no text.
SPARE = 4
ORDERS, BUCKET_BITS, LEAD, CHUNK = (2, 4), 14, 0.2, 1 << 18
UNDETERMINED = "und"
_FOLD = np.where(LETTERS, LOWER, 32).astype(np.uint64)
_STIR = np.uint64(0x9E3779B97F4A7C15)


def grams(raw: np.ndarray, offsets: np.ndarray):
    """Ranges of texts with the hashed n-grams of each order: (first text, last, owner of each byte's gram, slots).

    Bytes that aren't letters are spaces; a gram that leaves its text or holds only spaces has the
    last slot, which weighs nothing. A long text comes in overlapping pieces.
    """
    size, span = 1 << BUCKET_BITS, max(ORDERS)
    ends = offsets[1:]
    lo = 0
    while lo < offsets[-1]:
        hi = min(int(offsets[-1]), lo + CHUNK)
        seg = _FOLD[raw[lo : min(len(raw), hi + span)]]
        n = hi - lo
        seg = np.concatenate([seg, np.full(max(0, n + span - len(seg)), 32, np.uint64)])
        owner = np.searchsorted(ends, np.arange(lo, hi), "right")
        room = ends[owner] - np.arange(lo, hi)
        slots = []
        for k, order in enumerate(ORDERS):
            code = np.zeros(n, np.uint64)
            for i in range(order):
                code = code << np.uint64(8) | seg[i : i + n]
            blank = (room < order) | (code == np.uint64(int.from_bytes(b" " * order, "big")))
            slot = ((code * _STIR) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) + k * size
            slot[blank] = len(ORDERS) * size
            slots.append(slot)
        yield owner, slots
        lo = hi


def codewords(languages: int) -> np.ndarray:
    """Languages by bits, of -1 and 1: all splits for up to seven languages, else the best of 50 random codes."""
    if languages < 2:
        return np.ones((languages, 0))
    if languages <= 7:
        masks = np.arange(1, 1 << (languages - 1))
        return np.where((masks[None] >> np.arange(languages)[:, None]) & 1, 1.0, -1.0)
    bits = int(np.ceil(10 * np.log2(languages)))
    best, apart = None, -1
    for seed in range(50):
        code = np.where(np.random.default_rng(seed).random((languages, bits)) < 0.5, -1.0, 1.0)
        least = min(int((code[i] != code[j]).sum()) for i in range(languages) for j in range(i))
        if least > apart and (np.abs(code.sum(0)) < languages).all():
            best, apart = code, least
    return best


@dataclass(frozen=True)
class Model:
    """Languages in order, code (languages by bits), weights (slots by bits), slope, offset and trust of each bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    slope: np.ndarray
    offset: np.ndarray
    trust: np.ndarray

    def means(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, blank = len(offsets) - 1, len(ORDERS) << BUCKET_BITS
        total, seen = np.zeros((n, self.code.shape[1])), np.zeros(n)
        for owner, slots in grams(raw, offsets):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            for slot in slots:
                total[owner[first]] += np.add.reduceat(self.weights[slot], first)
                seen[owner[first]] += np.add.reduceat((slot != blank).astype(np.int64), first)
        return total / np.maximum(seen, 1)[:, None]

    def decode(self, means: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language numbers, scores and ambiguity flags."""
        if len(self.languages) == 1:
            return np.zeros(len(means), np.int64), np.ones(len(means)), np.zeros(len(means), bool)
        margin = np.clip(means * self.slope + self.offset, -12, 12)
        loss = (np.logaddexp(0, -margin[:, None] * self.code[None]) * self.trust).sum(2)
        least = np.sort(loss, 1)
        like = np.exp(least[:, :1] - loss)
        return loss.argmin(1), 1 / like.sum(1), least[:, 1] - least[:, 0] < LEAD


def train(texts: list[str], langs: list[str]) -> Model | None:
    languages = sorted(set(langs))
    if not languages:
        return None
    code = codewords(len(languages))
    size = (len(ORDERS) << BUCKET_BITS) + 1
    raw, offsets = text_buffer(pa.array(texts))
    of = np.array([languages.index(x) for x in langs])
    counts = np.zeros((len(languages), size))
    for owner, slots in grams(raw, offsets):
        for slot in slots:
            counts += np.bincount(of[owner] * size + slot, minlength=len(languages) * size).reshape(counts.shape)
    counts[:, -1] = 0
    counts /= np.maximum(counts.sum(1, keepdims=True), 1)  # every language weighs the same
    weights = np.zeros((size, code.shape[1]), np.float32)
    smooth = 1e-6
    for b in range(code.shape[1]):
        one, two = counts[code[:, b] > 0].mean(0), counts[code[:, b] < 0].mean(0)
        weights[:, b] = np.log(one + smooth) - np.log(two + smooth)
    weights[-1] = 0
    bits = code.shape[1]
    raw_model = Model(languages, code, weights, np.ones(bits), np.zeros(bits), np.ones(bits))
    means, goal = raw_model.means(raw, offsets), code[of]
    slope, offset = np.full(bits, 4.0), np.zeros(bits)
    for _ in range(300):  # a line for each bit, by damped Newton steps
        z = np.clip(means * slope + offset, -30, 30)
        p = 1 / (1 + np.exp(-z))
        err, bend = p - (goal > 0), p * (1 - p) + 1e-3
        slope -= np.clip(((err * means).sum(0) + 0.02 * slope) / ((bend * means**2).sum(0) + 0.02), -1, 1)
        offset -= np.clip(err.sum(0) / bend.sum(0), -0.5, 0.5)
    right = ((means * slope + offset) * goal > 0).mean(0)
    return Model(languages, code, weights, slope, offset, np.maximum(right - 0.5, 0.01) * 2)


def fit(docs: DataFrame, in_training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learns from rows with a text and a language for which `in_training` holds; None if there are none.

    Of each language, ids are picked by a hash, without reading texts: a share that its number of rows
    sets, so few rows meet in a task. Of the rows that have a text among them, a language has as many
    as its part of TRAIN_ROWS: by the hash, then by text, so the rows' order doesn't matter.
    """
    named = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), in_training.alias("__known")).filter("__known AND __lang IS NOT NULL").drop("__known")
    # One row for each language; languages are few (a documented limit of the driver's memory).
    found = {r[0]: r[1] for r in named.groupBy("__lang").count().collect()}
    if not found:
        return None
    each, place = max(20, TRAIN_ROWS // len(found)), F.xxhash64("__id", F.lit(7))
    shares = docs.sparkSession.createDataFrame([(lang, int((1 << 40) * min(1.0, SPARE * each / n))) for lang, n in sorted(found.items())], "__of string, __cut long")
    near = named.join(F.broadcast(shares), F.col("__lang") == F.col("__of")).filter(F.pmod(place, F.lit(1 << 40)) <= F.col("__cut"))
    first = Window.partitionBy("__lang").orderBy(F.pmod(place, F.lit(1 << 40)), "__id")
    chosen = near.select("__id", "__lang").distinct().withColumn("no", F.row_number().over(first)).filter(F.col("no") <= SPARE * each)
    chosen = chosen.select(F.col("__id").alias("__pick"), F.col("__lang").alias("__of"))
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text"))
    met = texts.join(F.broadcast(chosen), F.col("__id").eqNullSafe(F.col("__pick")) & (F.col("__lang") == F.col("__of")))
    last = Window.partitionBy("__lang").orderBy(F.pmod(place, F.lit(1 << 40)), "__id", F.xxhash64("__text"))
    rows = met.withColumn("no", F.row_number().over(last)).filter(F.col("no") <= each).select("__text", "__lang", "no").orderBy("__lang", "no").toArrow()
    return train(rows.column(0).to_pylist(), rows.column(1).to_pylist())


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for each row; `und`, score 0, where the text is null or has no letter, or nothing was learned.

    Repeated rows, null ids, very long texts and clashing names are like any others; equal texts have
    equal answers, and of languages that score the same the first by name is chosen. No rows give no rows.
    """

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            ascii_letters = np.concatenate([[0], np.cumsum(LETTERS[raw] & (raw < 128))])
            lettered = np.diff(ascii_letters[offsets]) > 0
            for i in np.flatnonzero(~lettered):
                lettered[i] = any(c.isalpha() for c in bytes(raw[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace"))
            if model is None:
                lettered[:] = False
                at, score, flag = (np.zeros(len(lettered), t) for t in (np.int64, float, bool))
            else:
                at, score, flag = model.decode(model.means(raw, offsets))
            names = np.where(lettered, np.array(model.languages if model else [UNDETERMINED], object)[at], UNDETERMINED)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.where(lettered, score, 0.0)), pa.array(flag | ~lettered)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, lang_pred string, score double, ambiguous boolean")
