"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is read in one pass into its leaf blocks, the runs of text between block-level tags, each with
its ancestors' tags and class words. Two states, text and boilerplate, are scored by features of the
ancestors and of the text; the chain's transitions let neighbours agree; Viterbi picks the states.
The field is trained by gradient ascent on its likelihood, on labelled pages that a generator lays
out in varied templates; no page of the tables is needed, so a model is the same for any input.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# HTML's elements by how they are read.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object"}
#: Of these, what isn't closed lasts to the end of the page; of the others only the tag is skipped.
TO_THE_END = {"script", "style", "textarea", "title"}
#: Elements of RAW that a slash closes: svg as foreign content, object as pages write it.
EMPTY = {"svg", "object"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
#: Elements that may stand in a head; any other one, or text, ends it.
IN_HEAD = set("base basefont bgsound head html link meta noframes noscript script style template title".split())
HIDDEN = RAW - {"textarea", "object"} | {"head"}

# A comment, a section, a declaration, or a tag with its attributes, of which a quote belongs to a value only after "=" and if it is closed.
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</(?:[^a-zA-Z>][^>]*)?>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*)>?", re.S)
_NAMES = re.compile(r"(?<![^\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: The end tag of each raw element. Spelled in ASCII letters alone: others (the long s) would fit without case.
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in RAW}
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int = 0


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order; white space inside is one space, character references are decoded."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []  # (tag, path so far)
    parts: list[str] = []
    linked, page, at = 0, page or "", 0

    def path() -> tuple[str, ...]:
        return stack[-1][1] if stack else ()

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = _SPACE.sub(" ", html.unescape(raw) if "&" in raw else raw).strip()
            if text:
                out.append(Block(text, next((p for t, p in reversed(stack) if t not in INLINE), ()), min(linked, len(text))))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            if stack and stack[-1][0] == "head" and not text.isspace():
                stack.pop()
            parts.append(text)
            if stack and "a" in stack[-1][1]:
                linked += len(text)

    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        found = _TOKEN.match(page, lt)
        if found is None:
            add(page[at : lt + 1])
            at = lt + 1
            continue
        add(page[at:lt])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag in ("br", "img", "wbr"):
                parts.append("" if tag == "wbr" else " ")
        else:
            flush()
        if found[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if tag not in IN_HEAD:
            for i in range(len(stack)):
                if stack[i][0] == "head":
                    del stack[i:]
                    break
        if tag in EMPTY and found[3].endswith("/"):
            continue
        if tag in RAW:
            end = _ENDS[tag].search(page, at)
            if end:
                at = page.find(">", end.end()) + 1 or len(page)
            elif tag in TO_THE_END:
                at = len(page)
            continue
        if tag in VOID:
            continue
        ends = {"p"} if tag in CLOSES_P else SAME.get(tag, set())
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    del stack[i:]
                elif stack[i][0] not in INLINE and not (ends == {"p"} and stack[i][0] == "p"):
                    break
        names = tuple(f".{w}" for m in _NAMES.finditer(found[3]) for w in _WORDS.findall((m[1] or m[2] or m[3] or "").lower())) if found[3] else ()
        stack.append((tag, path() + (tag,) + names))
    flush()
    return [b for b in out if not HIDDEN.intersection(b.path)]


def path_features(path: tuple[str, ...]) -> list[str]:
    return sorted({f"in {x}" for x in path} | ({f"own {[x for x in path if x[0] != '.'][-1]}"} if path else {"own -"}))


_BINS = np.array([2, 4, 8, 16, 32, 64, 128])


def text_features(block: Block, i: int, n: int) -> list[str]:
    text = block.text
    words = text.count(" ") + 1
    share = block.linked / len(text)
    out = ["bias", f"words {int(np.searchsorted(_BINS, words))}", f"links {0 if share == 0 else 1 if share < 0.4 else 2}", "stop" if text[-1] in ".!?…\"”»" else "open"]
    if "©" in text or "copyright" in text.lower():
        out.append("copyright")
    if i == 0 or i == n - 1:
        out.append("first" if i == 0 else "last")
    return out


@dataclass
class Field:
    """Weights of each feature for state 1 over state 0, and the scores of the four transitions."""

    weights: dict[str, float]
    moves: np.ndarray
    seen: dict[tuple[str, ...], float] = field(default_factory=dict)

    def path_weight(self, path: tuple[str, ...]) -> float:
        if path not in self.seen:
            if len(self.seen) > 50_000:
                self.seen.clear()
            self.seen[path] = sum(self.weights.get(f, 0.0) for f in path_features(path))
        return self.seen[path]

    def states(self, found: list[Block]) -> list[int]:
        """Viterbi."""
        n, get = len(found), self.weights.get
        (a, b), (c, d) = self.moves.tolist()
        zero, one, back = 0.0, 0.0, []
        for i, block in enumerate(found):
            gain = self.path_weight(block.path) + sum(get(f, 0.0) for f in text_features(block, i, n))
            if i:
                from0, from1 = zero + a >= one + c, zero + b > one + d
                back.append((0 if from0 else 1, 0 if from1 else 1))
                zero, one = (zero + a if from0 else one + c), (zero + b if from1 else one + d) + gain
            else:
                one = gain
        out = [int(one > zero)] if n else []
        for pair in reversed(back):
            out.append(pair[out[-1]])
        return out[::-1]

    def text(self, page: str | None) -> str:
        found = blocks(page)
        return "\n".join(b.text for b, s in zip(found, self.states(found), strict=True) if s)


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 300, rate: float = 0.2, decay: float = 0.0005) -> Field:
    """Maximum likelihood with a weight penalty; forward-backward over all pages at once."""
    names: dict[str, int] = {}
    steps = max(len(b) for b, _ in pages)
    rows, cols, gold, mask = [], [], np.zeros((len(pages), steps), int), np.zeros((len(pages), steps), bool)
    for p, (found, states) in enumerate(pages):
        for i, block in enumerate(found):
            mask[p, i], gold[p, i] = True, states[i]
            for f in path_features(block.path) + text_features(block, i, len(found)):
                rows.append(p * steps + i)
                cols.append(names.setdefault(f, len(names)))
    rows, cols = np.array(rows), np.array(cols)
    w, moves = np.zeros(len(names)), np.zeros((2, 2))
    m, v = np.zeros(len(names) + 4), np.zeros(len(names) + 4)
    total = mask.sum()
    for step in range(1, rounds + 1):
        gain = np.bincount(rows, w[cols], minlength=mask.size).reshape(mask.shape)
        emit = np.stack([np.zeros_like(gain), gain], 2)
        alpha = np.zeros_like(emit)
        alpha[:, 0] = emit[:, 0]
        for t in range(1, steps):
            nxt = np.logaddexp(alpha[:, t - 1, :1] + moves[0], alpha[:, t - 1, 1:] + moves[1]) + emit[:, t]
            alpha[:, t] = np.where(mask[:, t, None], nxt, alpha[:, t - 1])
        beta = np.zeros_like(emit)
        pairs = np.zeros((2, 2))
        log_z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        for t in range(steps - 2, -1, -1):
            ahead = (emit[:, t + 1] + beta[:, t + 1])[:, None, :] + moves
            on = mask[:, t + 1]
            joint = np.exp(alpha[:, t, :, None] + ahead - log_z[:, None, None])
            pairs += joint[on].sum(0)
            beta[:, t] = np.where(on[:, None], np.logaddexp(ahead[:, :, 0], ahead[:, :, 1]), beta[:, t + 1])
        one = np.exp(alpha[:, :, 1] + beta[:, :, 1] - log_z[:, None])
        err = np.where(mask, gold - one, 0).ravel()
        told = np.zeros((2, 2))
        both = mask[:, 1:]
        np.add.at(told, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        g = np.append(np.bincount(cols, err[rows], minlength=len(w)) / total - decay / 10 * w, ((told - pairs) / total - decay / 10 * moves).ravel())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, moves = w + move[:-4], moves + move[-4:].reshape(2, 2)
    return Field({f: float(w[i]) for f, i in names.items()}, moves)


# ---- labelled pages

# Names that page templates give to their parts.
BODIES = [["article"], ["main"], ["main", "article"], ["div .content"], ["div .post .body"], ["section .article"], ["div .entry", "article"], ["div #main", "div .text"], ["article .story"]]
ASIDE = ["nav", "nav .menu", "header", "div .header", "div .topbar", "footer", "div .footer", "aside", "div .sidebar", "aside .related", "div .ad", "div .advert", "div .ads .banner", "div .sponsored", "div .promo", "div .cookie .notice",
         "div .notice", "div .consent", "div .popup", "form", "form .search", "form .newsletter", "div .newsletter", "div .subscribe", "section .comments", "div .comment .list", "ol .comments", "div .share", "ul .social", "div .breadcrumb", "div .pagination", "div .widget", "div .login", "table .toolbar"]
NEUTRAL = ["div", "section", "div .wrap", "div .page", "div .container", "div .row", "div .col"]
SYLLABLES = "an the er ion ing re ti ha on ou ed st le en che ge ver un ei ich ar os do que la men".split()


def labelled_pages(n: int = 400, seed: int = 11) -> list[tuple[str, str]]:
    """(html, main text) pairs: article blocks among menus, notices, adverts, forms and comments, with untidy markup."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]

    def words(lo: int, hi: int, end: str = ".") -> str:
        made = ["".join(pick(SYLLABLES) for _ in range(int(rng.integers(1, 5)))) for _ in range(int(rng.integers(lo, hi)))]
        return " ".join(made).capitalize() + (end if rng.random() < 0.8 else "")

    def opened(spec: str) -> tuple[str, str]:
        tag, *names = spec.split()
        kinds = [x[1:] for x in names if x[0] == "."]
        return f"<{tag}" + (f' class="{" ".join(kinds)}"' if kinds else "") + "".join(f' id="{x[1:]}"' for x in names if x[0] == "#") + ">", f"</{tag}>"

    def aside() -> str:
        spec = pick(ASIDE)
        first, last = opened(spec)
        kind, tag = rng.random(), spec.split()[0]
        if tag in ("nav", "ul", "ol") or kind < 0.3:
            inner = "".join(f"<li>{'<a href=/x>' if rng.random() < 0.8 else ''}{words(1, 5, '')}</a></li>" for _ in range(int(rng.integers(1, 8))))
            return first + (inner if tag in ("ul", "ol") else f"<ul>{inner}</ul>") + last
        if tag == "form":
            return first + f"<label>{words(1, 4, ':')}</label><input type=text><button>{words(1, 3, '')}</button>" + last
        many = int(rng.integers(1, 5))
        inner = "".join(f"<p>{words(2, 60)}</p>" if rng.random() < 0.6 else f"<div>{words(2, 25)}</div>" for _ in range(many)) if kind < 0.75 else words(1, 30)
        return first + ("&copy; " if "footer" in spec and rng.random() < 0.7 else "") + inner + last

    out = []
    for _ in range(n):
        main, body = [], ""
        if rng.random() < 0.85:
            main.append(words(1, 14, ""))
            body += f"<h1>{main[-1]}</h1>"
        for _ in range(int(rng.integers(1, 14))):
            text = words(1, 90)
            kind = rng.random()
            if kind < 0.1 and body:
                body += aside()
                continue
            main.append(text)
            body += f"<p><b>{text}<br>" if kind < 0.2 else f"<h2>{text}</h2>" if kind < 0.28 else f"<ul><li>{text}</li></ul>" if kind < 0.33 else f"<blockquote>{text}</blockquote>" if kind < 0.37 else f"<p>{text}" + "</p>" * int(rng.random() < 0.85)
        for spec in reversed(pick(BODIES)):
            first, last = opened(spec)
            body = first + body + last
        before, after = ("".join(aside() for _ in range(int(rng.integers(0, 5)))) for _ in range(2))
        page = before + body + after
        for _ in range(int(rng.integers(0, 3))):
            first, last = opened(pick(NEUTRAL))
            page = first + page + last
        out.append((f"<!DOCTYPE html><html><head><title>{words(2, 9)}</title><style>p{{margin:0}}</style></head><body><script>var t=\"</p>\";</script>{page}" + "</body></html>" * int(rng.random() < 0.8), "\n".join(main)))
    return out


def label(page: str, main: str) -> tuple[list[Block], list[int]]:
    """States of a page's blocks: its main lines are met in order."""
    wanted, found = main.split("\n"), blocks(page)
    states, i = [], 0
    for block in found:
        hit = i < len(wanted) and block.text == wanted[i]
        states.append(int(hit))
        i += hit
    return found, states


_TRAINED: list[Field] = []


def trained() -> Field:
    """The field of the generator's pages, trained once in a driver process."""
    if not _TRAINED:
        _TRAINED.append(train([x for x in (label(*p) for p in labelled_pages()) if x[0]]))
    return _TRAINED[0]


def extract(pages: DataFrame, model: Field, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row, repeated rows and null ids included. A narrow map.

    A null, empty or textless page has an empty text. Pages are read whole, however long, and equal
    pages have equal texts. Where two readings score the same, a block is dropped. No rows give no
    rows; other columns, whatever their names, are not read.
    """
    weights, moves = model.weights, model.moves

    def run(batches):
        own = Field(weights, moves)
        for batch in batches:
            texts = [own.text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
