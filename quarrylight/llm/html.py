"""HTML main-text extraction with a recurrent block labeller (operator 2).

A page becomes the sequence of its leaf blocks: stretches of text between block-level tags. Each block is
described by its tag path (names, classes and ids of the elements around it, hashed to learned vectors), by its
words (hashed likewise), and by a few numbers such as its length and the share of its text inside links. A
bidirectional LSTM, in numpy, reads the whole sequence in both directions and labels every block as main text or
not, so a decision can rest on what stands anywhere else in the page.

The labeller is trained where it is used, with numpy: on pages made up from many layouts, whose blocks are known,
filled with words of a bounded sample of the given pages, and on those sampled pages whose mark-up states what
their blocks are. Part of the layouts name nothing, name parts by words that say nothing, or stand in tables, so that links,
lengths and places are learned for themselves.

Mark-up is read once, by the states of the HTML standard; the time is in proportion to the page also where it is broken.

Defined results: null and empty html, and pages without main text, give an empty text; repeated rows are extracted
each; an empty table gives no rows; other columns are ignored. Work and memory are in proportion to a page: of elements
nested deeper than 64 the 32 outermost and the 32 innermost describe a block, by 16 names each at most; its text stays whole. Scripts, styles, templates, titles, frames and comments
are never blocks (without an end tag only the start tag is skipped); formulas, drawings and fallback contents are text like any other. White space inside a block becomes one space; blocks are joined by two line feeds.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import SPACED, word_hashes

#: HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template title iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br canvas cite code data del dfn em font i img ins kbd label mark math noscript object q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split())
#: Inside these all elements but those of HTML's own blocks are inline.
FOREIGN = frozenset("math svg".split())
CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())
PARAGRAPH_ENDS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

#: How much of a path describes a block: elements at either end of a deep path, and names of an element.
NEAREST, NAMES = 32, 16
#: White space between attributes, by the HTML standard.
_WS = r"\t\n\f\r "
#: A tag by the states of the standard: attributes in quotes, bare ones (in which quotes are ordinary characters), and none.
_TAG = re.compile(rf"""<(/?)([a-zA-Z][^{_WS}/>]*+)((?>[{_WS}/]*+[^{_WS}/>][^{_WS}/>=]*+(?:[{_WS}]*+=[{_WS}]*+(?:"[^"]*+"|'[^']*+'|(?=>)|[^{_WS}>]++))?+)*+)([{_WS}/]*+)>""")
_START = re.compile(r"</?[a-zA-Z]|<[!?]|</")
_COMMENT_END = re.compile(r"--!?>")
_LONG_REFERENCE = re.compile(r"&#(?:0*+([0-9]{8,})|[xX]0*+([0-9a-fA-F]{7,}));?")
_ZEROS = re.compile(r"&#([xX]?)0{4,}")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")


class Tags:
    """The tags and comments of a page, each found by one reading of it.

    A tag that would run past the page's end ends at its first `>` instead, and so do all after it: only one is ever
    read to the end in vain. Where no `>` follows, `<` is text."""

    def __init__(self, page: str):
        self.page, self.last, self.quoted = page, page.rfind(">"), True

    def next(self, at: int) -> tuple[int, int, str, str, str, bool] | None:
        """Start, end, `/` of an end tag, name (empty for comments and the like), attributes, and whether it closes itself."""
        page = self.page
        while m := _START.search(page, at):
            start = m.start()
            if page.startswith("<!--", start):
                if page.startswith((">", "->"), start + 4):
                    return start, page.index(">", start) + 1, "", "", "", False
                close = _COMMENT_END.search(page, start + 4)
                return start, close.end() if close else len(page), "", "", "", False
            if start > self.last:
                return None
            first = page[start + 1 : start + 3].lstrip("/")[:1]
            if not (first.isascii() and first.isalpha()):
                return start, page.index(">", start) + 1, "", "", "", False
            if self.quoted:
                if tag := _TAG.match(page, start):
                    return start, tag.end(), tag[1], tag[2].lower(), tag[3], tag[4].endswith("/")
                self.quoted = False
            end = page.index(">", start)
            name, _, rest = re.sub(rf"[{_WS}/]", " ", page[start + 1 : end].lstrip("/"), count=1).partition(" ")
            return start, end + 1, "/" if page.startswith("</", start) else "", name.lower(), rest, rest.endswith("/")
        return None


def unescape(raw: str) -> str:
    """Character references decoded; numbers beyond all characters become the replacement character."""
    if "&" not in raw:
        return raw
    return entities.unescape(_LONG_REFERENCE.sub("\ufffd", _ZEROS.sub(r"&#\g<1>0", raw)))


@dataclass
class Block:
    path: tuple[str, ...]
    pieces: list[str] = field(default_factory=list)
    link_chars: int = 0
    text: str = ""


def parse(page: str) -> list[Block]:
    """The leaf blocks of a page, in order."""
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    open_names: dict[str, int] = {}
    current: Block | None = None
    links = foreign = 0
    unclosed: set[str] = set()

    def end_block():
        nonlocal current
        if current:
            current.text = " ".join("".join(current.pieces).split())
            if current.text:
                blocks.append(current)
        current = None

    def add(raw: str):
        nonlocal current
        text = unescape(raw)
        if current is None:
            if text.isspace():
                return
            around = stack if len(stack) <= 2 * NEAREST else stack[:NEAREST] + stack[-NEAREST:]
            current = Block(tuple(x for _, own in around for x in own))
        current.pieces.append(text)
        if links:
            current.link_chars += len(text)

    def inline(name: str) -> bool:
        return name in INLINE or (foreign > 0 and name not in PARAGRAPH_ENDS and name not in CLOSES_ITSELF)

    def close(name: str):
        nonlocal links, foreign
        while stack:
            last = stack.pop()[0]
            open_names[last] -= 1
            links -= last == "a"
            if not inline(last):
                end_block()
            foreign -= last in FOREIGN
            if last == name:
                return

    at, tags = 0, Tags(page)
    while tag := tags.next(at):
        start, end, closing, name, attributes, selfclosing = tag
        if start > at:
            add(page[at:start])
        at = end
        if not name:
            continue
        if closing:
            ends = not inline(name)
            if open_names.get(name):
                close(name)
            if ends:
                end_block()
            continue
        if name in UNSEEN:
            if name not in unclosed and not selfclosing:
                if hidden := re.compile(rf"</{name}(?=[{_WS}/>])[^>]*+>", re.I).search(page, at, tags.last + 1):
                    at = hidden.end()
                else:
                    unclosed.add(name)
            continue
        if name == "br" or (foreign and name in ("text", "tspan")):
            if current:
                current.pieces.append(" ")
            continue
        if not inline(name):
            while foreign and not (open_names.get("foreignobject") or open_names.get("annotation-xml")):
                close(next(n for n, _ in reversed(stack) if n in FOREIGN))
            end_block()
            if name in PARAGRAPH_ENDS and open_names.get("p"):
                close("p")
            elif name in CLOSES_ITSELF and any(n == name for n, _ in stack[-3:]):
                close(name)
        if name in VOID or selfclosing:
            continue
        words = [p for g in _NAMES.findall(attributes) for p in _PARTS.findall("".join(g).lower())]
        stack.append((name, (name, *(f".{w}" for w in words[:NAMES]))))
        open_names[name] = open_names.get(name, 0) + 1
        links += name == "a"
        foreign += name in FOREIGN
    if at < len(page):
        add(page[at:])
    end_block()
    return blocks


# --- features -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    """sample_pages bounds the pages whose words and labels are learned from, by a hash of page_id. word_decay shrinks the
    word vectors at each step: the words of made-up pages tell nothing, so that only those of labelled pages should grow."""

    path_bits: int = 12
    word_bits: int = 11
    path_dim: int = 20
    word_dim: int = 6
    hidden: int = 16
    pages: int = 1500
    epochs: int = 6
    batch: int = 32
    rate: float = 0.01
    sample_pages: int = 200
    seed: int = 3
    word_decay: float = 0.95


NUMBERS = 5


@dataclass
class Page:
    """A page's blocks as numbers."""

    path_ids: np.ndarray
    path_sizes: np.ndarray
    word_ids: np.ndarray
    word_sizes: np.ndarray
    numbers: np.ndarray
    labels: np.ndarray


_path_cache: dict[str, int] = {}


def describe(blocks: list[Block], settings: Settings, labels=None) -> Page:
    path_mask = (1 << settings.path_bits) - 1
    ids: list[int] = []
    sizes = []
    for b in blocks:
        own = ("/", *b.path, f"{b.path[-1]}|") if b.path else ("/",)
        sizes.append(len(own))
        for token in own:
            if (n := _path_cache.get(token)) is None:
                if len(_path_cache) > 50_000:
                    _path_cache.clear()
                n = _path_cache[token] = zlib.crc32(token.encode())
            ids.append(n & path_mask)
    raw = [b.text.encode() for b in blocks]
    hashes, starts = word_hashes(b"\n".join(raw), SPACED)
    ends = np.cumsum([len(r) + 1 for r in raw])
    words = np.diff(np.r_[0, np.searchsorted(starts, ends)])
    chars = np.array([len(b.text) for b in blocks])
    numbers = np.stack(
        [
            np.log1p(words) / 4,
            np.minimum(1, np.array([b.link_chars for b in blocks]) / chars),
            np.array([b.text[-1] in ".!?:;…" for b in blocks]),
            np.minimum(1, chars / 200),
            np.ones(len(blocks)),
        ],
        axis=1,
    ).astype(np.float32)
    return Page(np.array(ids), np.array(sizes), (hashes & np.uint64((1 << settings.word_bits) - 1)).astype(np.int64), words, numbers, np.array(labels if labels is not None else [0] * len(blocks)))


# --- the network ----------------------------------------------------------------------------------


def initial(settings: Settings) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(settings.seed)
    size, h = settings.path_dim + settings.word_dim + NUMBERS, settings.hidden
    out = {
        "path": rng.normal(0, 0.3, (1 << settings.path_bits, settings.path_dim)),
        "word": rng.normal(0, 0.1, (1 << settings.word_bits, settings.word_dim)),
        "out": rng.normal(0, 0.2, (2 * h + size,)),
        "bias": np.zeros(1),
    }
    for d in "fb":
        out[f"{d}x"] = rng.normal(0, 1 / np.sqrt(size), (size, 4 * h))
        out[f"{d}h"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
        out[f"{d}0"] = np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)]
    return {k: v.astype(np.float32) for k, v in out.items()}


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _read(x: np.ndarray, wx, wh, b, keep: bool = True):
    """One direction of the LSTM over (pages, steps, features); outputs and, if kept, what _unread() needs."""
    pages, steps, _ = x.shape
    h = wh.shape[0]
    state, cell = np.zeros((pages, h), np.float32), np.zeros((pages, h), np.float32)
    outs, saved = np.empty((pages, steps, h), np.float32), []
    for t in range(steps):
        if t % 1024 == 0:
            z = x[:, t : t + 1024] @ wx + b
        g = z[:, t % 1024] + state @ wh
        s = _sigmoid(g[:, : 3 * h])
        i, f, o = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
        c = np.tanh(g[:, 3 * h :])
        before = cell
        cell = f * cell + i * c
        squashed = np.tanh(cell)
        if keep:
            saved.append((state, before, i, f, o, c, squashed))
        state = o * squashed
        outs[:, t] = state
    return outs, saved


def _unread(d_outs, x, saved, wx, wh):
    pages, steps, _ = x.shape
    h = wh.shape[0]
    d_state, d_cell = np.zeros((pages, h), np.float32), np.zeros((pages, h), np.float32)
    d_z = np.empty((pages, steps, 4 * h), np.float32)
    d_wh = np.zeros_like(wh)
    for t in range(steps - 1, -1, -1):
        state, before, i, f, o, c, squashed = saved[t]
        d_state = d_state + d_outs[:, t]
        d_cell = d_cell + d_state * o * (1 - squashed**2)
        d = np.concatenate([d_cell * c * i * (1 - i), d_cell * before * f * (1 - f), d_state * squashed * o * (1 - o), d_cell * i * (1 - c**2)], axis=1)
        d_z[:, t] = d
        d_wh += state.T @ d
        d_state = d @ wh.T
        d_cell = d_cell * f
    flat = d_z.reshape(-1, 4 * h)
    return d_z @ wx.T, x.reshape(-1, x.shape[2]).T @ flat, d_wh, flat.sum(axis=0)


def _pooled(table, ids, sizes):
    starts = np.cumsum(sizes) - sizes
    return np.add.reduceat(table[ids], starts) / np.sqrt(sizes)[:, None].astype(np.float32)


class Batch:
    """Pages laid out as (page, step), with each page's reversed order beside it."""

    def __init__(self, pages: list[Page]):
        self.sizes = np.array([len(p.path_sizes) for p in pages])
        self.path_ids, self.path_sizes = np.concatenate([p.path_ids for p in pages]), np.concatenate([p.path_sizes for p in pages])
        self.word_ids, self.word_sizes = np.concatenate([p.word_ids for p in pages]), np.concatenate([p.word_sizes for p in pages])
        self.numbers = np.concatenate([p.numbers for p in pages])
        self.labels = np.concatenate([p.labels for p in pages])
        self.row = np.repeat(np.arange(len(pages)), self.sizes)
        first = np.cumsum(self.sizes) - self.sizes
        self.step = np.arange(len(self.row)) - np.repeat(first, self.sizes)
        self.back = np.repeat(self.sizes, self.sizes) - 1 - self.step
        self.shape = (len(pages), int(self.sizes.max()))

    def forward(self, p: dict[str, np.ndarray], keep: bool = True):
        x = np.concatenate([_pooled(p["path"], self.path_ids, self.path_sizes), _pooled(p["word"], self.word_ids, self.word_sizes), self.numbers], axis=1).astype(np.float32)
        padded, turned = (np.zeros((*self.shape, x.shape[1]), np.float32) for _ in range(2))
        padded[self.row, self.step] = x
        turned[self.row, self.back] = x
        f, f_saved = _read(padded, p["fx"], p["fh"], p["f0"], keep)
        b, b_saved = _read(turned, p["bx"], p["bh"], p["b0"], keep)
        features = np.concatenate([f[self.row, self.step], b[self.row, self.back], x], axis=1)
        return _sigmoid(features @ p["out"] + p["bias"]), (x, padded, turned, f_saved, b_saved, features)

    def gradients(self, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        chance, (x, padded, turned, f_saved, b_saved, features) = self.forward(p)
        error = ((chance - self.labels) / len(chance)).astype(np.float32)
        h = p["fh"].shape[0]
        d_features = error[:, None] * p["out"]
        g = {"out": features.T @ error, "bias": np.array([error.sum()], np.float32)}
        d_x = d_features[:, 2 * h :].copy()
        for d, seq, saved, at, part in (("f", padded, f_saved, self.step, slice(0, h)), ("b", turned, b_saved, self.back, slice(h, 2 * h))):
            d_outs = np.zeros((*self.shape, h), np.float32)
            d_outs[self.row, at] = d_features[:, part]
            d_seq, g[f"{d}x"], g[f"{d}h"], g[f"{d}0"] = _unread(d_outs, seq, saved, p[f"{d}x"], p[f"{d}h"])
            d_x += d_seq[self.row, at]
        split = p["path"].shape[1]
        for name, ids, sizes, part in (("path", self.path_ids, self.path_sizes, slice(0, split)), ("word", self.word_ids, self.word_sizes, slice(split, split + p["word"].shape[1]))):
            g[name] = np.zeros_like(p[name])
            np.add.at(g[name], ids, np.repeat(d_x[:, part] / np.sqrt(sizes)[:, None], sizes, axis=0))
        return g


def train(pages: list[Page], settings: Settings) -> dict[str, np.ndarray]:
    p = initial(settings)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    rng = np.random.default_rng(settings.seed)
    step, total = 0, settings.epochs * -(-len(pages) // settings.batch)
    by_size = np.array([len(x.labels) for x in pages])
    for _ in range(settings.epochs):
        order = np.argsort(by_size + rng.uniform(0, 8, len(pages)), kind="stable")
        groups = [order[a : a + settings.batch] for a in range(0, len(order), settings.batch)]
        for k in rng.permutation(len(groups)):
            step += 1
            rate = settings.rate * (1 - step / (total + 1))
            for name, g in Batch([pages[i] for i in groups[k]]).gradients(p).items():
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            p["word"] *= settings.word_decay
    return p


# --- training pages -------------------------------------------------------------------------------

#: Names that mark-up uses for parts of a page.
PARTS = {
    "menu": ("nav div ul", "nav navbar menu navigation main-menu breadcrumb breadcrumbs topbar toc tabs pagination pager skip-links"),
    "header": ("header div", "header site-header masthead top branding logo hero-top page-header tagline"),
    "footer": ("footer div", "footer site-footer copyright legal colophon bottom site-info credits"),
    "sidebar": ("aside div section", "sidebar widget side related recommended popular trending more-stories tags categories secondary rail"),
    "notice": ("div section aside", "cookie cookie-banner consent notice alert gdpr newsletter subscribe signup popup modal paywall disclaimer warning"),
    "advert": ("div aside ins section", "ad ads advert advertisement banner sponsored promo adsense ad-slot sponsor partner"),
    "form": ("form div", "search login contact-form subscribe-form signup-form poll"),
    "comments": ("section div ol ul", "comments comment comment-list discussion replies responses disqus respond user-comments reader-comments"),
    "share": ("div ul", "share social social-links follow sharing"),
}
MAIN = ("article main div section", "content article post entry entry-content article-body post-content story main body-text text page-content article-content")
NEUTRAL = "container wrapper row col inner box block layout page region grid cell group item panel left right wide".split()
KEEP = ""  # a private-use character that begins the blocks to keep in a training page


#: How training pages name their parts, and the share of each: as is usual, with names that say nothing, without any, and
#: in the cells of a table without any.
LAYOUTS = {"named": 0.46, "strange": 0.16, "bare": 0.19, "table": 0.19}
SEMANTIC = frozenset("nav header footer aside form article main section".split())


class PageMaker:
    """Pages of known structure, filled with given words."""

    def __init__(self, words: list[str], seed: int, layout: str | None = None):
        self.words, self.rng = words, np.random.default_rng(seed)
        self.wanted, self.layout = layout, layout or "named"

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def text(self, low: int, high: int) -> str:
        n = int(np.exp(self.rng.uniform(np.log(low), np.log(high + 1))))
        out = " ".join(self.words[i] for i in self.rng.integers(len(self.words), size=max(1, n)))
        return entities.escape(out) + self.pick(["", ".", ".", ".", "!", "?"])

    def named(self, tag: str, names: str, inner: str) -> str:
        if self.layout != "named" and tag in SEMANTIC:
            tag = "div"
        if self.layout in ("bare", "table"):
            return f"<{tag}>{inner}</{tag}>"
        if self.layout == "strange":
            names = "".join(chr(97 + int(x)) for x in self.rng.integers(26, size=int(self.rng.integers(1, 6))))
        kind = self.pick(["class", "class", "class", "id"])
        extra = f" {self.pick(NEUTRAL)}" if kind == "class" and self.rng.random() < 0.2 else ""
        return f'<{tag} {kind}="{names}{extra}">{inner}</{tag}>'

    def wrapped(self, inner: str) -> str:
        for _ in range(int(self.rng.integers(0, 3))):
            tag = self.pick(["div", "div", "section"]) if self.layout == "named" else "div"
            inner = f'<{tag} class="{self.pick(NEUTRAL)}">{inner}</{tag}>' if self.rng.random() < 0.7 and self.layout == "named" else f"<{tag}>{inner}</{tag}>"
        return inner

    def inline(self, text: str) -> str:
        if self.rng.random() < 0.25:
            words = text.split(" ")
            at = int(self.rng.integers(len(words)))
            tag = self.pick(["b", "i", "em", "strong", "code", 'a href="/x"', "span"])
            words[at] = f"<{tag}>{words[at]}</{tag.split()[0]}>"
            text = " ".join(words)
        return text

    def links(self, low=2, high=8) -> str:
        items = [f'<a href="/{k}">{self.text(1, 3)}</a>' for k in range(int(self.rng.integers(low, high)))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.rng.random() < 0.7 else self.pick([" ", " | ", ""]).join(items)

    def part(self, kind: str) -> str:
        tags, names = (x.split() for x in PARTS[kind])
        tag = self.pick(tags)
        r = self.rng.random()
        prose = "".join(f"<{t}>{self.text(2, 40)}</{t}>" for t in ["p"] * int(self.rng.integers(1, 4)))
        if kind in ("menu", "share"):
            inner = self.links()
        elif kind == "form":
            inner = f"<label>{self.text(1, 4)}</label><input type='text' name='q'><button>{self.text(1, 2)}</button>" + (f"<p>{self.text(3, 20)}</p>" if r < 0.4 else "")
        elif kind == "comments":
            one = lambda: self.named(self.pick(["div", "li", "article"]), self.pick(["comment", "reply", "comment-body"]), (f"<b>{self.text(1, 2)}</b>" if r < 0.5 else "") + f"<p>{self.text(3, 80)}</p>")
            inner = (f"<h3>{self.text(1, 3)}</h3>" if r < 0.6 else "") + "".join(one() for _ in range(int(self.rng.integers(1, 5))))
        elif kind == "header":
            inner = (f"<h1>{self.text(1, 5)}</h1>" if r < 0.3 else f"<a href='/'>{self.text(1, 4)}</a>") + (f"<p>{self.text(2, 10)}</p>" if r < 0.5 else "")
        elif kind == "footer":
            inner = self.pick(["", "<p>"]) + f"&copy; {self.text(1, 25)}" + (self.links() if r < 0.3 else "")
        elif self.layout != "named":  # without a telling name only links tell such a part from the article
            inner = (f"<h3>{self.text(1, 4)}</h3>" if r < 0.4 else "") + (self.links() if r < 0.7 else f'{self.text(2, 12)} <a href="/y">{self.text(2, 6)}</a>')
        else:
            inner = (f"<h3>{self.text(1, 4)}</h3>" if r < 0.4 else "") + (self.text(2, 30) if r < 0.4 else self.links() if r < 0.6 else prose)
        if self.layout == "named" and tag in ("nav", "header", "footer", "aside", "form") and self.rng.random() < 0.5:
            return f"<{tag}>{inner}</{tag}>"
        return self.named(tag, self.pick(names), inner)

    def main(self) -> str:
        keep = lambda low, high: KEEP + self.inline(self.text(low, high))
        out = [f"<h1>{keep(2, 12)}</h1>"] if self.rng.random() < 0.85 else []
        if out and self.rng.random() < 0.15:
            out = [f"<header>{out[0]}</header>"] if self.layout == "named" else out
        for _ in range(int(self.rng.integers(1, 14))):
            r = self.rng.random()
            if r < 0.68:
                p = keep(1, 160)
                out.append(f"<p><b>{p}<br><p>" if self.rng.random() < 0.08 else f"<p>{p}</p>")
            elif r < 0.78:
                level = self.pick("234")
                out.append(f"<h{level}>{keep(1, 8)}</h{level}>")
            elif r < 0.86:
                out.append("<ul>" + "".join(f"<li>{keep(1, 25)}</li>" for _ in range(int(self.rng.integers(2, 6)))) + "</ul>")
            elif r < 0.9:
                out.append(f"<blockquote>{keep(4, 50)}</blockquote>")
            elif r < 0.93:
                out.append(f"<pre>{keep(3, 30)}</pre>")
            elif r < 0.96:
                out.append("<table>" + "".join(f"<tr><td>{keep(1, 4)}</td><td>{keep(1, 6)}</td></tr>" for _ in range(int(self.rng.integers(1, 4)))) + "</table>")
            else:
                out.append(f"<div>{keep(3, 60)}</div>")
        for kind in ("advert", "share", "notice", "sidebar", "form"):
            if self.rng.random() < 0.12:
                out.insert(int(self.rng.integers(len(out) + 1)), self.part(kind))
        if self.rng.random() < 0.15:
            out.append(self.part("comments"))
        tags, names = (x.split() for x in MAIN)
        tag, inner = self.pick(tags), "".join(out)
        r = self.rng.random()
        if r < 0.12:
            return inner
        if self.layout == "named" and tag in ("article", "main") and r < 0.6:
            return f"<{tag}>{inner}</{tag}>"
        return self.named(tag, self.pick(names), inner)

    def page(self) -> str:
        self.layout = self.wanted or str(self.rng.choice(list(LAYOUTS), p=list(LAYOUTS.values())))
        before = [self.wrapped(self.part(k)) for k, chance in (("notice", 0.25), ("header", 0.55), ("menu", 0.75), ("form", 0.25), ("advert", 0.4), ("menu", 0.15)) if self.rng.random() < chance]
        after = [self.wrapped(self.part(k)) for k, chance in (("share", 0.2), ("comments", 0.4), ("sidebar", 0.45), ("advert", 0.25), ("form", 0.15), ("notice", 0.15), ("footer", 0.75)) if self.rng.random() < chance]
        self.rng.shuffle(before)
        if self.rng.random() < 0.2:
            before.append(self.wrapped(self.part("sidebar")))
        if self.layout == "table":
            rows = [f"<tr><td>{x}</td></tr>" for x in before]
            beside = [f"<td>{after.pop(int(self.rng.integers(len(after))))}</td>" for _ in range(int(self.rng.integers(0, 2))) if after]
            if rows and self.rng.random() < 0.5:
                beside.insert(0, rows.pop().removeprefix("<tr>").removesuffix("</tr>"))
            middle = [*beside, f"<td>{self.main()}</td>"] if self.rng.random() < 0.5 else [f"<td>{self.main()}</td>", *beside]
            rows += ["<tr>" + "".join(middle) + "</tr>", *(f"<tr><td>{x}</td></tr>" for x in after)]
            return "<html><body><table>" + "".join(rows) + "</table></body></html>"
        return "<html><head><title>x</title></head><body>" + self.wrapped("".join(before) + self.wrapped(self.main()) + "".join(after)) + "</body></html>"


_OUTSIDE = frozenset(f".{w}" for _, names in PARTS.values() for n in names.split() for w in _PARTS.findall(n)) - {".page", ".main", ".more", ".top", ".side", ".form", ".body", ".text", ".link", ".links", ".list", ".user", ".story", ".stories"}


def stated(block: Block) -> int | None:
    """What the mark-up itself says of a block: 1 main text, 0 not, None if it says nothing."""
    path = set(block.path)
    if path & {"nav", "footer", "aside", "form"} or path & _OUTSIDE or ("header" in path and "article" not in path):
        return 0
    return 1 if path & {"article", "main"} else None


def training_pages(sample: list[str], settings: Settings) -> list[Page]:
    parsed = [parse(s) for s in sample]
    words = [w for blocks in parsed for b in blocks for w in b.text.split()[:200]] or ["text"]
    maker = PageMaker(words, settings.seed)
    pages = []
    for _ in range(settings.pages):
        blocks = parse(maker.page())
        labels = [b.text.startswith(KEEP) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(KEEP, "") or "x"
        pages.append(describe(blocks, settings, labels))
    for blocks in parsed:
        labels = [stated(b) for b in blocks]
        if blocks and None not in labels:
            pages.append(describe(blocks, settings, labels))
    return pages


# --- on Spark -------------------------------------------------------------------------------------


def fit(pages: DataFrame, settings: Settings | None = None) -> dict[str, np.ndarray]:
    """Train the labeller; of `pages` it sees at most `sample_pages` rows."""
    settings = settings or Settings()
    hashed = pages.select(F.xxhash64("page_id", "html").alias("h"), "html").filter("html is not null")
    # The hashes come first, so that whole pages come to the driver from those tasks only that hold a chosen one.
    least = [r["h"] for r in hashed.select("h").orderBy("h").limit(settings.sample_pages).collect()]
    sample = hashed.filter(F.col("h") <= least[-1]).groupBy("h").agg(F.first("html").alias("html")).collect() if least else []
    return train(training_pages([r["html"] for r in sorted(sample)], settings), settings)


def label_pages(parsed: list[list[Block]], model: dict[str, np.ndarray], settings: Settings, group: int = 64, steps: int = 8192) -> list[np.ndarray]:
    """For each page the chance of each block to be main text.

    Pages of like size are read together: at most `group` of them and, with the longest one's blocks for each, `steps`
    blocks, so that a long page stands alone and pads no other."""
    out = [np.empty(0, np.float32)] * len(parsed)
    filled = sorted((i for i in range(len(parsed)) if parsed[i]), key=lambda i: len(parsed[i]))
    while filled:
        many = max(1, min(group, steps // len(parsed[filled[-1]])))
        part, filled = filled[-many:], filled[:-many]
        batch = Batch([describe(parsed[i], settings) for i in part])
        chances, _ = batch.forward(model, keep=False)
        for i, c in zip(part, np.split(chances, np.cumsum(batch.sizes)[:-1]), strict=True):
            out[i] = c
    return out


def _slices(sizes: list[int], rows: int = 512, limit: int = 4 << 20):
    """Bounds of stretches of at most `rows` rows and, where they have several, about `limit` in size."""
    begin = held = 0
    for at, size in enumerate(sizes):
        if at > begin and (at - begin >= rows or held + size > limit):
            yield begin, at
            begin, held = at, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def extract(pages: DataFrame, model: dict[str, np.ndarray], settings: Settings | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    settings = settings or Settings()
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for at, end in _slices(pc.fill_null(pc.binary_length(whole.column(2)), 0).to_pylist()):
                batch = whole.slice(at, end - at)
                parsed = [parse(h.as_py() or "") for h in batch.column(2)]
                texts = ["\n\n".join(b.text for b, c in zip(blocks, chances, strict=True) if c >= 0.5) for blocks, chances in zip(parsed, label_pages(parsed, shared.value, settings), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
