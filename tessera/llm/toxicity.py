"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. Voters. Lexicon voters hold words or word beginnings; each votes "toxic" where it finds one and
   abstains otherwise, or, in the last of them, votes "clean" where none finds any. Pattern voters
   look at density, repetition and shouting. Lexicons are a short fixed list and terms that labelled
   training rows show to be far more frequent in toxic texts.
2. Label model. Votes depend on a hidden class. Expectation-maximisation estimates each voter's rates
   without looking at labels; correlations left between voters, given the class, discount those that
   repeat each other.
3. Classifier. A logistic regression on the presence of hashed terms is trained on the posterior
   labels. It alone scores texts; labels, language, source and id are no inputs.

Training reads at most TOXIC_ROWS + CLEAN_ROWS labelled rows, picked by a hash of the id. Where no
labels tell toxic from clean texts, it is the same model of the seed voters alone, on as many texts
picked alike. Scores follow the mix of the picked rows, so the line at 0.5 weighs a missed toxic text
like a clean one that goes. Scoring is a narrow map over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.jaccard_join import shingle_sets
from tessera.llm.shared import LETTERS, mix, ranges, release, text_buffer, tidy, token_hashes

#: Bounds of the training sample.
TOXIC_ROWS, CLEAN_ROWS, PART_ROWS = 2000, 4000, 50
PREFIXES, SELECTED, GROUPS, MIN_ROWS = (4, 5, 6, 7, 8), 20_000, 6, 4
#: Log odds of one vote at most; least evidence (nats) and log ratio of a found term.
CERTAIN, EVIDENCE, LIFT, SKETCH = 3.0, 10.0, 3.5, 12
BITS = 20

# Insults in four languages, the seed lexicon.
SEED = [
    "idiot", "moron", "stupid", "loser", "worthless", "pathetic", "scum", "trash", "disgusting", "clown", "imbecile", "dumb", "jerk", "scumbag", "bastard",
    "dummkopf", "trottel", "arschloch", "drecksack", "abschaum", "vollidiot", "blödmann", "hurensohn",
    "imbécile", "connard", "salaud", "abruti", "crétin", "ordure", "connasse", "débile",
    "imbécil", "estúpido", "idiota", "cabrón", "gilipollas", "escoria", "basura", "payaso",
]


def features(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words and word beginnings of each text: hashes, kinds (0 words, then PREFIXES), owners, and words a text."""
    return features_of(*text_buffer(column))


def features_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    words, counts, heads = token_hashes(raw, offsets, LETTERS, prefixes=PREFIXES)
    owner = np.repeat(np.arange(len(counts)), counts)
    every = np.concatenate([words, *heads])
    return every, np.repeat(np.arange(1 + len(PREFIXES), dtype=np.int8), len(words)), np.tile(owner, 1 + len(PREFIXES)), counts


@dataclass(frozen=True)
class Model:
    """Selected term hashes in order, their weights, and the bias; `filter` has a bit for each."""

    terms: np.ndarray
    weights: np.ndarray
    bias: float
    filter: np.ndarray

    @staticmethod
    def of(terms: np.ndarray, weights: np.ndarray, bias: float) -> Model:
        order = np.argsort(terms)
        bits = np.zeros(1 << BITS, bool)
        bits[(terms & np.uint64((1 << BITS) - 1)).astype(np.int64)] = True
        return Model(terms[order], weights[order], float(bias), bits)

    def found(self, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, term number) pairs of selected terms."""
        if not len(self.terms):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        near = np.flatnonzero(self.filter[(hashes & np.uint64((1 << BITS) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, hashes[near]), len(self.terms) - 1)
        hit = self.terms[at] == hashes[near]
        pair = np.unique(owner[near][hit] * len(self.terms) + at[hit])
        return pair // len(self.terms), pair % len(self.terms)

    def scores(self, column) -> np.ndarray:
        """Works on ranges of about a megabyte, which may end between words of a long text."""
        raw, offsets = text_buffer(column)
        pairs = [np.empty(0, np.int64)]
        for lo, hi in ranges(raw, offsets, LETTERS):
            first, last = int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, hi, "left"))
            hashes, _, owner, _ = features_of(raw[lo:hi], np.clip(offsets[first : last + 1], lo, hi) - lo)
            text, term = self.found(hashes, owner + first)
            pairs.append(text * len(self.terms) + term)
        pair = np.unique(np.concatenate(pairs))
        logit = self.bias + np.bincount(pair // max(1, len(self.terms)), self.weights[pair % max(1, len(self.terms))], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def seed_terms() -> np.ndarray:
    return np.unique(features(pa.array(SEED))[0][: len(SEED)])


def _terms(texts: list[str]):
    """For parts of the texts: hashes, kinds and owners of each text's terms, and its numbers of words."""
    for lo in range(0, len(texts), PART_ROWS):
        hashes, kinds, owner, words = features(pa.array(texts[lo : lo + PART_ROWS], pa.string()))
        yield hashes, kinds, owner + lo, words


def _distinct(texts: list[str]):
    """_terms without a text's repeats, which in sorted order follow each other."""
    for hashes, kinds, owner, words in _terms(texts):
        order = np.lexsort((hashes, owner))
        hashes, kinds, owner = hashes[order], kinds[order], owner[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        yield hashes[fresh], kinds[fresh], owner[fresh], words


def _sketches(texts: list[str]):
    for lo in range(0, len(texts), PART_ROWS):
        flat, sizes = shingle_sets(pa.array(texts[lo : lo + PART_ROWS]), 3)
        for n, end in zip(sizes.tolist(), np.cumsum(sizes).tolist(), strict=True):
            yield flat[end - n : end][:SKETCH].tolist()


def without_copies(texts: list[str]) -> np.ndarray:
    """Numbers of the texts that don't share a third of their sketch, the SKETCH least hashes of three words, with an earlier one.

    Copies of one toxic text would make all its words look toxic.
    """
    seen: dict[int, list[int]] = {}
    keep = []
    for i, sketch in enumerate(_sketches(texts)):
        met: dict[int, int] = {}
        for h in sketch:
            for j in seen.get(h, ()):
                met[j] = met.get(j, 0) + 1
        if not met or 3 * max(met.values()) < len(sketch):
            keep.append(i)
            for h in sketch:
                seen.setdefault(h, []).append(i)
    return np.array(keep, np.int64)


def _frequent(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Terms in at least MIN_ROWS of the texts, and their kinds; one kind at a time."""
    parts = [(h, k) for h, k, _, _ in _distinct(texts)]
    terms, kinds = [], []
    for kind in range(1 + len(PREFIXES)):
        term, n = np.unique(np.concatenate([h[k == kind] for h, k in parts]), return_counts=True)
        terms.append(term[n >= MIN_ROWS])
        kinds.append(np.full(len(terms[-1]), kind, np.int8))
    term, at = np.unique(np.concatenate(terms), return_index=True)
    return term, np.concatenate(kinds)[at]


def _select(n1: np.ndarray, n0: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Numbers of the terms whose share in toxic texts far exceeds that in clean ones, at most SELECTED; n1, n0: texts of either kind with a term."""
    lift = np.log((n1 + 0.5) / (toxic.sum() + 1)) - np.log((n0 + 0.5) / ((~toxic).sum() + 1))
    share, n = toxic.mean(), np.maximum(n0 + n1, 1)
    p = n1 / n  # a bound of the binomial tail: terms are many, and some lean to toxic texts by chance
    sure = n1 * np.log(np.maximum(p, 1e-12) / share) + n0 * np.log(np.maximum(1 - p, 1e-12) / (1 - share))
    good = np.flatnonzero((n1 >= MIN_ROWS) & (lift > LIFT) & (sure > EVIDENCE))
    return good[np.argsort(-sure[good], kind="stable")][:SELECTED]


def shouted(texts: list[str]) -> np.ndarray:
    """The share of A-Z among each text's ASCII letters."""
    raw, offsets = text_buffer(pa.array(texts, pa.string()))
    plain = LETTERS[raw] & (raw < 128)
    count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
    return count(plain & (raw <= 90)) / np.maximum(1, count(plain))


def votes(text: np.ndarray, voter_of: np.ndarray, term: np.ndarray, texts: int, voters: int, words: np.ndarray, shouting: np.ndarray) -> np.ndarray:
    """Texts by voters: 1 toxic, 0 clean, -1 no vote."""
    out = np.full((texts, voters + 4), -1, np.int8)
    out[text, voter_of[term]] = 1
    hits = np.bincount(text, minlength=texts)
    out[hits / np.maximum(words, 1) >= 0.02, voters] = 1
    out[hits >= 3, voters + 1] = 1
    out[shouting >= 0.3, voters + 2] = 1
    out[hits == 0, voters + 3] = 0
    return out


def _discounts(table: np.ndarray, post: np.ndarray | None) -> np.ndarray:
    """1 / (1 + what a voter's votes have in common with the others'), beyond what the classes `post` explain."""
    said = (table == 1).astype(float)
    if post is None:
        rest = said - said.mean(0)
    else:
        sure = post >= 0.5
        means = [said[x].mean(0) if x.any() else np.zeros(said.shape[1]) for x in (sure, ~sure)]
        rest = said - np.where(sure[:, None], means[0], means[1])
    spread = np.sqrt((rest**2).mean(0))
    corr = np.clip((rest.T @ rest) / len(rest) / (np.outer(spread, spread) + 1e-12), 0, 1)
    corr[spread < 1e-6, :] = corr[:, spread < 1e-6] = 0
    np.fill_diagonal(corr, 0)
    return 1 / (1 + (corr**2).sum(1))


def label_model(table: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the toxic class, and each voter's discount for its correlations; no vote counts more than CERTAIN.

    A voter's three outcomes have a distribution under either class. The start is the discounted share
    of toxic votes, so it assumes that votes are better than chance; labels are not used. The first
    pass discounts by all that voters share, the second by what the classes found then don't explain.
    """
    hot = np.stack([table == -1, table == 0, table == 1], 2).astype(float)
    usual = hot.mean(0) + 1e-6  # smooths either class alike, so a voter that never votes says nothing
    keep = _discounts(table, None)
    cast = hot[:, :, 1:].sum(2) @ keep
    post = np.where(cast > 0, np.clip((hot[:, :, 2] @ keep) / np.maximum(cast, 1e-9), 0.05, 0.95), 0.3)
    for again in range(2):
        for _ in range(rounds):
            both = np.stack([1 - post, post])
            rate = (np.einsum("cn,nvo->cvo", both, hot) + 2 * usual) / (both.sum(1)[:, None, None] + 2)
            share = min(max(post.mean(), 0.02), 0.98)
            gain = (np.clip(np.log(rate[1]) - np.log(rate[0]), -CERTAIN, CERTAIN) * keep[:, None])[None] * hot
            fresh = 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + gain.sum((1, 2)), -30, 30)))
            moved, post = np.abs(fresh - post).max(), fresh
            if moved < 1e-4:
                break
        if not again:
            keep = _discounts(table, post)
    return post, keep


def train(texts: list[str], toxic: np.ndarray | None) -> Model:
    """The classifier from labelled texts; without labels of both classes (or toxic=None), from the votes of the seed words' voters."""
    seeds = seed_terms()
    if toxic is not None:
        own = without_copies(texts)
        texts, toxic = [texts[i] for i in own], toxic[own]
    if toxic is None or toxic.all() or not toxic.any():
        return _unlabelled(texts, seeds)
    # Terms of a few toxic texts or more, then how many texts of either kind have them, then where the chosen ones are: in parts.
    known, kinds = _frequent([x for x, t in zip(texts, toxic, strict=True) if t])
    new = ~np.isin(seeds, known)
    known, kinds = np.concatenate([known, seeds[new]]), np.concatenate([kinds, np.zeros(new.sum(), np.int8)])
    every = Model.of(known, kinds.astype(float), 0)
    seen = np.zeros((2, len(known)))
    for hashes, _, owner, _ in _terms(texts):
        text, at = every.found(hashes, owner)
        for kind in (0, 1):
            seen[kind] += np.bincount(at[toxic[text] == kind], minlength=len(known))
    chosen = np.union1d(_select(seen[1], seen[0], toxic), np.flatnonzero(np.isin(every.terms, seeds)))
    term, kind = every.terms[chosen], every.weights[chosen].astype(np.int64)
    # Voters: the seed list, and the found terms of each kind in GROUPS random groups.
    voter = np.where(np.isin(term, seeds), 0, 1 + kind * GROUPS + (mix(term) % np.uint64(GROUPS)).astype(np.int64))
    return _voted(texts, term, voter, 1 + (1 + len(PREFIXES)) * GROUPS)


def _unlabelled(texts: list[str], seeds: np.ndarray) -> Model:
    """Seed words in GROUPS voters. The words themselves, and as many empty texts, are among the texts: they stand for what the texts may lack."""
    own = [texts[i] for i in without_copies(texts)]
    return _voted([*own, *SEED, *[""] * len(SEED)], seeds, (mix(seeds) % np.uint64(GROUPS)).astype(np.int64), GROUPS)


def _voted(texts: list[str], term: np.ndarray, voter: np.ndarray, voters: int) -> Model:
    """The classifier that learns what the label model makes of the voters' votes."""
    model = Model.of(term, voter.astype(float), 0)
    found = [(*model.found(h, o), w) for h, _, o, w in _terms(texts)]
    text, at, words = (np.concatenate([f[i] for f in found]) for i in range(3))
    upper = np.concatenate([shouted(texts[i : i + PART_ROWS]) for i in range(0, len(texts), PART_ROWS)])
    post, _ = label_model(votes(text, model.weights.astype(np.int64), at, len(texts), voters, words, upper))
    weights, bias = _regression(text, at, len(model.terms), post)
    return Model.of(model.terms, weights, bias)


def _regression(text: np.ndarray, term: np.ndarray, terms: int, target: np.ndarray, rounds: int = 400, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Logistic regression on term presence against soft labels; Adam, weights kept from growing without need."""
    w = np.zeros(terms + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(w[-1] + np.bincount(text, w[term], minlength=len(target)), -30, 30)))
        err = p - target
        g = np.append(np.bincount(term, err[text], minlength=terms) + 0.02 * w[:-1], err.sum()) / len(target)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:-1], w[-1]


def fit(docs: DataFrame, labels: DataFrame, in_training: Column, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from labelled rows for which `in_training` (an expression of `id_col`) holds.

    Rows with a null text or label teach nothing. An id with several texts or labels counts for each.
    Picks go by a hash of the id, then by id, text and label, so they don't depend on the rows' order:
    TOXIC_ROWS and CLEAN_ROWS ids, and as many rows of them in all. The driver's Python gives back what training took.
    """
    model = _fit(docs, labels, in_training, id_col, text_col)
    release()
    return model


def _fit(docs: DataFrame, labels: DataFrame, in_training: Column, id_col: str, text_col: str) -> Model:
    most = TOXIC_ROWS + CLEAN_ROWS
    known = labels.filter(in_training & F.col("toxic").isNotNull()).select(F.col(id_col).alias("__tessera_id"), (F.col("toxic") == 1).alias("__tessera_toxic"))
    picks = [known.filter(F.col("__tessera_toxic") == kind).orderBy(F.xxhash64("__tessera_id"), "__tessera_id").limit(rows) for kind, rows in ((True, TOXIC_ROWS), (False, CLEAN_ROWS))]
    chosen = picks[0].unionByName(picks[1])
    texts = docs.filter(F.col(text_col).isNotNull()).join(F.broadcast(chosen), F.col(id_col) == F.col("__tessera_id"))
    rows = texts.select("__tessera_id", F.col(text_col).alias("text"), "__tessera_toxic").orderBy(F.xxhash64("__tessera_id"), "__tessera_id", F.xxhash64("text"), "__tessera_toxic").limit(most).toArrow()
    texts, toxic = rows.column("text").to_pylist(), np.array(rows.column("__tessera_toxic").to_pylist(), bool)
    del rows
    if not len(texts) or toxic.all() or not toxic.any():
        own = docs.filter(in_training & F.col(text_col).isNotNull()).select(F.xxhash64(id_col).alias("at"), F.col(text_col).alias("text"))
        return train(own.orderBy("at", F.xxhash64("text")).limit(most).toArrow().column("text").to_pylist(), None)
    order = np.argsort(np.array([hash_text(x) for x in texts], np.uint64), kind="stable")
    return train([texts[i] for i in order], toxic[order])


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5) for each row, repeated rows and null ids included.

    Null texts are scored as empty ones, equal texts alike. No rows give no rows; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            found = model.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"doc_id {dict(docs.dtypes)[id_col]}, score double, predicted int")


def clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that aren't predicted toxic, with all their columns; a narrow filter.

    A null text is an empty one. Repeated rows stay or go together; no rows give no rows.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at)) < 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)
