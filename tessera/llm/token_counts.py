"""Token counts by greedy longest match, with a linear-time automaton that builds no pieces.

The vocabulary is a trie with failure links (Song et al., "Fast WordPiece Tokenization", 2021).
A failure link leads from the node of a string s to the node of what remains of s after greedy
longest matching has taken its pieces; beside it stands the cost of the pieces so taken, so a
word's length in pieces is a sum of integers met on one pass over its characters.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

CACHE_WORDS, CACHE_CHARS = 200_000, 48


class GreedyCounter:
    """Counts the pieces of white-space separated words.

    `marker` stands before every word and is part of the vocabulary's word-initial pieces. A
    character that starts no piece costs as many tokens as it has UTF-8 bytes. Null and empty
    texts have 0 words and 0 tokens.
    """

    def __init__(self, pieces: list[str], marker: str = "▁"):
        self.marker = marker
        known = set(pieces) - {""}
        cost = dict.fromkeys(known, 1)
        for piece in known:
            for c in piece:
                cost.setdefault(c, len(c.encode("utf-8", "surrogatepass")))
        self.next: list[dict[str, int]] = [{}]
        value = [0]
        for piece, price in cost.items():
            at = 0
            for c in piece:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    value.append(0)
                at = self.next[at][c]
            value[at] = price
        self.fail, self.popped = [0] * len(value), [0] * len(value)
        queue = [0]
        for u in queue:
            for c, v in self.next[u].items():
                queue.append(v)
                if value[v]:
                    self.popped[v] = value[v]
                else:  # u isn't the root: single characters all have a value
                    z, taken = self.fail[u], self.popped[u]
                    while c not in self.next[z]:
                        taken += self.popped[z]
                        z = self.fail[z]
                    self.popped[v], self.fail[v] = taken, self.next[z][c]
        self.cache = _Cache(self.word)

    def word(self, word: str) -> int:
        nxt, fail, popped = self.next, self.fail, self.popped
        at = total = 0
        for c in self.marker + word:
            step = nxt[at].get(c)
            while step is None and at:
                total += popped[at]
                at = fail[at]
                step = nxt[at].get(c)
            if step is None:
                total += len(c.encode("utf-8", "surrogatepass"))
            else:
                at = step
        while at:
            total += popped[at]
            at = fail[at]
        return total

    def text(self, text: str | None) -> tuple[int, int]:
        words = (text or "").split()
        return len(words), sum(map(self.cache.__getitem__, words))


class _Cache(dict):
    """Remembers a bounded number of short words."""

    def __init__(self, count):
        self.count = count

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


_COUNTERS: dict[str, GreedyCounter] = {}


def counter_of(path: str) -> GreedyCounter:
    """The automaton over a SentencePiece vocabulary file; built once in each Python worker."""
    if path not in _COUNTERS:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)
        _COUNTERS[path] = GreedyCounter([model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i)])
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, n_chars, n_words, n_tokens (all 0 for null or empty texts).

    Other columns, whatever their names, are not read. A narrow map: no shuffle. `vocabulary` names a
    file that every executor has, as an installed package's data.
    """

    def count(batches):
        tokens = counter_of(vocabulary).text
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [tokens(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x or "") for x in texts], pa.int64()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())],
                [id_col, "n_chars", "n_words", "n_tokens"],
            )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, n_chars long, n_words long, n_tokens long")
