"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks of text. Each block is a vector: its tag path (tags,
words of classes and ids, hashed), its words (hashed) and a few ratios. A bidirectional
LSTM, in numpy, reads the blocks of the whole page in both directions and labels each as
article or not, so every decision sees the document around it.

The labeller is trained here, on pages that ``synthetic_page`` draws from many layouts
with the labels known by construction; nothing of the pages to be read is used. Training
takes ``TRAIN_PAGES`` pages and a few seconds, once in each driver process.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._spark import require, table
from tidemill.llm._text import ALNUM, LOWER, byte_values, hashes, passes, runs, utf8

PATH_BINS, WORD_BINS, RATIOS = 512, 64, 12
HIDDEN = 24
TRAIN_PAGES, EPOCHS, BATCH, RATE = 900, 7, 30, 0.01
#: Elements around a block, from the nearest, whose tags and names are its features.
NEAREST = 12
#: Blocks that the labeller reads side by side (padded), at most; a longer page is read alone.
GRID = 1 << 15

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*)[^>]*>?", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Elements of HTML, by how they part text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template iframe title".split())
_PHRASE = frozenset("noscript svg object canvas audio video".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()) | frozenset(
    "math semantics annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover tspan textpath".split()
)
_SPACED = frozenset("br annotation annotation-xml mtd mtr".split())
_OUT_OF_SVG = frozenset("blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 hr li listing menu meta ol p pre table ul".split())
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
_ENDS = {t: re.compile(rf"</{t}(?=[\s>/])[^>]*>?", re.I) for t in _RAW}
_ENDS_IN_SVG = {t: re.compile(rf"</{t}(?=[\s>/])[^>]*>?|(?=</svg[\s>/])|(?=<(?:{'|'.join(sorted(_OUT_OF_SVG))})[\s>/])|\Z", re.I) for t in _RAW}


class Block(NamedTuple):
    path: str
    text: str
    linked: int


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks in page order: path, text with single spaces, and how much of it is linked.

    The whole page is read, to any depth; a path names the elements nearest to the block.

    Scripts, styles, titles, templates and frames are skipped to their end tag, to the end
    of the page without one; inside svg, no further than that reaches. ``/>`` ends
    an element only on svg and inside it, as in HTML; the elements of math are inline.
    """
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, str]] = []
    open_: Counter[str] = Counter()
    parts, linked, in_link, at, drawings = [], 0, 0, 0, 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                out.append(Block("".join(f">{step}" for _, step in stack[-NEAREST:]), text, linked))
            parts.clear()
        linked = 0

    def pop_to(i: int) -> None:
        for gone, _ in stack[i:]:
            open_[gone] -= 1
        del stack[i:]

    def svg_at() -> int:
        """Where the innermost svg is in the stack; -1 in none, or in HTML inside it."""
        for i in range(len(stack) - 1 if drawings else -1, -1, -1):
            if stack[i][0] in ("svg", "foreignobject"):
                return i if stack[i][0] == "svg" else -1
        return -1

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                in_link = 0
            if name in _INLINE:
                continue
            end_block()
            if open_[name]:
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                pop_to(i)
            continue
        if name in _INLINE:
            if name == "a":
                in_link = 1
            elif name in _SPACED:
                parts.append(" ")
            continue
        end_block()
        in_link = 0
        if name == "head":
            continue
        svg = svg_at()
        if svg >= 0 and name in _OUT_OF_SVG:
            pop_to(svg)
            svg = -1
        if (svg >= 0 or name == "svg") and m[0].endswith("/>"):
            continue
        if name in _RAW:
            e = (_ENDS_IN_SVG if svg >= 0 else _ENDS)[name].search(page, at)
            at = e.end() if e else n
            continue
        drawings += name == "svg"
        if stack and stack[-1][0] == "p" and name not in _PHRASE:
            pop_to(len(stack) - 1)
        if name in _CLOSES and any(open_[t] for t in _CLOSES[name]):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in _CLOSES[name]:
                    pop_to(i)
                    break
                if stack[i][0] in ("ul", "ol", "table", "dl", "select"):
                    break
        if name in _VOID:
            continue
        step = name
        if m[3]:
            words = [w.lower() for a, b, c in _NAMED.findall(m[3]) for w in _PART.findall(a or b or c)]
            step = ".".join([name, *words])
        stack.append((name, step))
        open_[name] += 1
    end_block()
    return out


@lru_cache(maxsize=200_000)
def _bin(token: str) -> int:
    return xxhash.xxh32_intdigest(token) % PATH_BINS


def path_bins(path: str) -> list[int]:
    """Bins of a path: its tags, words of classes and ids, and the two nearest elements apart.

    A path names the ``NEAREST`` elements around a block, however deep it stands.
    """
    steps = path.split(">")
    tokens = {t for s in steps for t in [s.split(".")[0] + "!", *s.split(".")[1:]]}
    for i, s in enumerate(reversed(steps[-2:])):
        tokens |= {f"{i}:{t}" for t in s.split(".")}
    return sorted({_bin(t) for t in tokens})


def ratios(blocks: list[Block]) -> np.ndarray:
    """Sizes, links, marks and place of each block."""
    out = np.zeros((len(blocks), RATIOS), np.float32)
    n = len(blocks)
    for i, b in enumerate(blocks):
        t, size = b.text, len(b.text)
        words = t.count(" ") + 1
        out[i] = (
            np.log1p(size) / 6, np.log1p(words) / 5, min(1.0, b.linked / size), (t.count(".") + t.count(",") + t.count("!") + t.count("?")) / words,
            t[-1] in ".!?…:\"'”»", t[0].isupper(), size / words / 10, words <= 3, i / n, i < 3, n - i <= 3, 1.0,
        )
    return out


def word_vectors(texts: list[str]) -> np.ndarray:
    """Counts of hashed words of each text, as a unit vector."""
    out = np.zeros((len(texts), WORD_BINS), np.float32)
    column = pa.array(texts, pa.string())
    buf, offsets = utf8(column)
    for i, j in passes(offsets):
        part, off = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends = runs(ALNUM[part], off)
        h = hashes(part, starts, ends, byte_values(LOWER))
        row = np.searchsorted(off, starts, "right") - 1
        out[i:j] = np.bincount(row * WORD_BINS + (h >> np.uint64(58)).astype(np.int64), minlength=(j - i) * WORD_BINS).reshape(-1, WORD_BINS)
    return out / np.maximum(1, np.sqrt((out**2).sum(1, keepdims=True)))


class Labeller:
    """Weights of the two LSTMs and of the output."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = PATH_BINS + WORD_BINS + RATIOS
        draw = lambda *s: (rng.standard_normal(s) * (1.0 / np.sqrt(s[0]) if s[0] < PATH_BINS else 0.06)).astype(np.float32)
        self.w = {k: v for side in "fb" for k, v in ((f"x{side}", draw(d, 4 * HIDDEN)), (f"h{side}", draw(HIDDEN, 4 * HIDDEN)), (f"c{side}", np.zeros(4 * HIDDEN, np.float32)))}
        for side in "fb":
            self.w[f"c{side}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        self.w["o"], self.w["p"] = draw(2 * HIDDEN, 1), np.zeros(1, np.float32)
        self.paths: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return {"w": self.w, "paths": {}}

    def _path(self, path: str) -> np.ndarray:
        """What a path adds to the gates of both directions; kept for the paths seen last."""
        have = self.paths.get(path)
        if have is None:
            if len(self.paths) >= 20_000:
                self.paths.clear()
            bins = path_bins(path)
            have = self.paths[path] = np.concatenate([self.w[f"x{s}"][bins].sum(0) / np.sqrt(max(1, len(bins))) for s in "fb"])
        return have

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, the probability of each block to be article."""
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        out: list[np.ndarray] = [np.empty(0, np.float32)] * len(pages)
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and (b + 1 - a) * len(pages[order[b]]) <= GRID:
                b += 1
            part = order[a:b]
            flat = [x for i in part for x in pages[i]]
            gates = np.stack([self._path(x.path) for x in flat])
            rest = np.concatenate([word_vectors([x.text for x in flat]), np.concatenate([ratios(pages[i]) for i in part])], axis=1)
            gates += rest @ np.concatenate([self.w["xf"][PATH_BINS:], self.w["xb"][PATH_BINS:]], axis=1)
            sizes = np.array([len(pages[i]) for i in part])
            p = self._read(gates, sizes)
            ends = np.cumsum(sizes)
            for i, s, e in zip(part, (ends - sizes).tolist(), ends.tolist(), strict=True):
                out[i] = p[s:e]
            a = b
        return out

    def _read(self, gates: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        steps, begin = int(sizes.max()), np.cumsum(sizes) - sizes
        states = np.empty((len(gates), 2 * HIDDEN), np.float32)
        for k, side in enumerate("fb"):
            h = c = np.zeros((len(sizes), HIDDEN), np.float32)
            w, bias = self.w[f"h{side}"], self.w[f"c{side}"]
            for t in range(steps):
                # pages come by size: those that still have blocks are the last ones
                live = int(np.searchsorted(sizes, t, "right"))
                at = begin[live:] + (t if side == "f" else sizes[live:] - 1 - t)
                z = gates[at, 4 * HIDDEN * k : 4 * HIDDEN * (k + 1)] + h[-len(at) :] @ w + bias
                s = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
                c = s[:, HIDDEN : 2 * HIDDEN] * c[-len(at) :] + s[:, :HIDDEN] * np.tanh(z[:, 3 * HIDDEN :])
                h = s[:, 2 * HIDDEN :] * np.tanh(c)
                states[at, HIDDEN * k : HIDDEN * (k + 1)] = h
        return 1 / (1 + np.exp(-(states @ self.w["o"] + self.w["p"])[:, 0]))

    # Training: back-propagation through time over batches of pages of like size.

    def fit(self, pages: list[list[Block]], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = 11) -> Labeller:
        rng = np.random.default_rng(seed)
        inputs = []
        for blocks in pages:
            x = np.zeros((len(blocks), PATH_BINS + WORD_BINS + RATIOS), np.float32)
            for i, b in enumerate(blocks):
                bins = path_bins(b.path)
                x[i, bins] = 1 / np.sqrt(max(1, len(bins)))
            x[:, PATH_BINS : PATH_BINS + WORD_BINS] = word_vectors([b.text for b in blocks])
            x[:, -RATIOS:] = ratios(blocks)
            inputs.append(x)
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        square = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for epoch in range(epochs):
            for b in rng.permutation(len(batches)).tolist():
                step += 1
                grads = self._gradients([inputs[i] for i in batches[b]], [labels[i] for i in batches[b]], rng)
                rate = RATE * (1 - epoch / epochs)
                norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 5.0 / max(norm, 1e-9)) + 1e-5 * self.w[k]
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.99 * square[k] + 0.01 * g * g
                    self.w[k] = (self.w[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        self.paths.clear()
        return self

    def _gradients(self, xs: list[np.ndarray], ys: list[np.ndarray], rng: np.random.Generator) -> dict[str, np.ndarray]:
        sizes = np.array([len(x) for x in xs])
        steps, n = int(sizes.max()), len(xs)
        grid = np.zeros((2, steps, n, xs[0].shape[1]), np.float32)
        mask, want = np.zeros((steps, n), np.float32), np.zeros((steps, n), np.float32)
        for i, x in enumerate(xs):
            # some inputs are blanked, so that no single class name decides
            x = x * (rng.random(x.shape) > 0.1)
            if rng.random() < 0.25:
                x[:, :PATH_BINS] = 0
            grid[0, : len(x), i], grid[1, : len(x), i] = x, x[::-1]
            mask[: len(x), i], want[: len(x), i] = 1, ys[i]
        kept, states = [], []
        for k, side in enumerate("fb"):
            h = c = np.zeros((n, HIDDEN), np.float32)
            gates = grid[k] @ self.w[f"x{side}"] + self.w[f"c{side}"]
            log, hs = [], np.zeros((steps, n, HIDDEN), np.float32)
            for t in range(steps):
                z = gates[t] + h @ self.w[f"h{side}"]
                s, g = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN])), np.tanh(z[:, 3 * HIDDEN :])
                c_new = s[:, HIDDEN : 2 * HIDDEN] * c + s[:, :HIDDEN] * g
                log.append((h, c, s, g, c_new))
                c = c_new
                h = s[:, 2 * HIDDEN :] * np.tanh(c)
                hs[t] = h
            kept.append(log)
            states.append(hs)
        back = np.zeros_like(states[1])
        for i, m in enumerate(sizes.tolist()):
            back[:m, i] = states[1][:m, i][::-1]
        both = np.concatenate([states[0], back], axis=2)
        p = 1 / (1 + np.exp(-(both @ self.w["o"] + self.w["p"])[..., 0]))
        d = (p - want) * mask / mask.sum()
        grads = {"o": (both * d[..., None]).sum((0, 1))[:, None], "p": np.array([d.sum()], np.float32)}
        d_both = d[..., None] * self.w["o"][:, 0]
        d_back = np.zeros_like(back)
        for i, m in enumerate(sizes.tolist()):
            d_back[:m, i] = d_both[:m, i, HIDDEN:][::-1]
        for k, side, d_hs in ((0, "f", d_both[..., :HIDDEN]), (1, "b", d_back)):
            d_h = d_c = np.zeros((n, HIDDEN), np.float32)
            d_gates = np.zeros((steps, n, 4 * HIDDEN), np.float32)
            d_w = np.zeros_like(self.w[f"h{side}"])
            for t in reversed(range(steps)):
                h, c, s, g, c_new = kept[k][t]
                d_h = d_h + d_hs[t]
                tc = np.tanh(c_new)
                i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
                d_c = d_c + d_h * o * (1 - tc**2)
                dz = np.concatenate([d_c * g * i * (1 - i), d_c * c * f * (1 - f), d_h * tc * o * (1 - o), d_c * i * (1 - g**2)], axis=1) * mask[t][:, None]
                d_gates[t] = dz
                d_w += h.T @ dz
                d_h, d_c = dz @ self.w[f"h{side}"].T, d_c * f
            flat = d_gates.reshape(-1, 4 * HIDDEN)
            grads[f"x{side}"] = grid[k].reshape(-1, grid.shape[-1]).T @ flat
            grads[f"c{side}"], grads[f"h{side}"] = flat.sum(0), d_w
        return grads


# Training pages. A block's label stands before its text, as one of two private characters.

YES, NO = "\ue001", "\ue000"
# Words by which page authors name parts of pages, and words that stand in them.
_NAMES = {
    "nav": "nav navbar menu navigation topnav main-menu site-nav breadcrumb breadcrumbs tabs",
    "header": "header masthead top site-header logo branding topbar banner-top",
    "ad": "ad ads advert advertisement sponsored promo sponsor banner adbox ad-slot",
    "side": "sidebar aside related widget recommended trending popular more-stories rail links",
    "notice": "notice cookie-notice cookie consent gdpr alert newsletter subscribe popup modal paywall disclaimer warning",
    "form": "form search login signup contact searchform",
    "comments": "comments comment-list comment discussion replies disqus responses commentlist reader-comments",
    "footer": "footer site-footer bottom copyright colophon legal foot",
    "share": "share social sharing toolbar meta tags pagination pager",
    "body": "article post content entry story article-body post-content entry-content main text body-text page-content news",
}
_SAID = {
    "nav": "Home|About us|Contact|News|Products|Blog|Sports|Politics|Log in|Shop",
    "header": "Welcome|The daily paper|Search|My account|Skip to content",
    "ad": "Advertisement|Sponsored|Buy now and save 20%|Special offer|Click here for our best deals",
    "side": "Related articles|Most read|You may also like|Trending now|Recent posts|Archives",
    "notice": "We use cookies to improve this site. Accept all cookies.|Subscribe to our newsletter|By using this site you accept our privacy policy.|Please enable JavaScript|This site uses cookies",
    "form": "Email|Password|Name|Send|Search|Your message|Submit|Log in|Choose a country",
    "comments": "Reply|Comments|Leave a comment|Posted by|3 days ago|Report|Great post, thanks!|I disagree with this.",
    "footer": "© 2024 All rights reserved|Privacy policy|Terms of use|Imprint|Contact|Powered by",
    "share": "Share|Tweet|Print|Next|Previous|Tags|Share on social media|1 2 3",
}


def synthetic_page(rng: random.Random) -> str:
    """A page of some layout; every block of text begins with YES (article) or NO."""
    syllables = ["".join(rng.choice("bcdfghjklmnprstvwz" if i % 2 == 0 else "aeiouéäöñ") for i in range(rng.randint(1, 4))) for _ in range(40)]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    named, plain = rng.random() < 0.75, rng.random() < 0.5

    def words(n: int) -> str:
        out = [word() for _ in range(n)]
        for i in range(0, n, rng.randint(4, 9)):
            out[i] = out[i].capitalize()
            if i:
                out[i - 1] += rng.choice(".,.")
        return " ".join(out) + rng.choice(["", ".", "."])

    def name(kind: str, sure: bool = False) -> str:
        if not (named or sure):
            return f' class="{word()}"' if plain else ""
        label = rng.choice(_NAMES[kind].split())
        if rng.random() < 0.3:
            label += rng.choice(["-", "_", " "]) + rng.choice(["wrap", "box", "inner", "1", "block", "container"])
        return f' {rng.choice(["class", "class", "id"])}="{label}"'

    def inline(text: str, links: float = 0.15) -> str:
        parts = text.split(" ")
        if len(parts) > 3 and rng.random() < 0.4:
            i = rng.randrange(1, len(parts) - 1)
            tag = "a href='/x'" if rng.random() < links * 2 else rng.choice(["b", "i", "em", "strong", "span"])
            parts[i] = f"<{tag}>{parts[i]}</{tag.split()[0]}>"
        return " ".join(parts)

    def close(tag: str) -> str:
        return "" if tag in ("p", "li", "td") and rng.random() < 0.1 else f"</{tag}>"

    def said(kind: str) -> str:
        return rng.choice(_SAID[kind].split("|")) if rng.random() < 0.4 else words(rng.randint(1, 6))

    def listing(kind: str, n: int, tag: str | None = None, sure: bool = False) -> str:
        tag = tag or rng.choice(["div", "div", "ul", "section"])
        style = rng.randrange(3)
        items = []
        for _ in range(n):
            text = NO + said(kind)
            items.append((f"<li><a href='/{word()}'>{text}</a>{close('li')}", f"<a href='#'>{text}</a><br>", f"<div><a href='/'>{text}</a></div>")[style])
        inner = "".join(items)
        if style == 0 and tag != "ul":
            inner = f"<ul>{inner}</ul>"
        return f"<{tag}{name(kind, sure)}>{inner}</{tag}>"

    def prose(kind: str, n: int, tag: str, longest: int, sure: bool = False) -> str:
        inner = []
        for _ in range(n):
            text = NO + (said(kind) if rng.random() < 0.4 else inline(words(rng.randint(3, longest))))
            t = rng.choice(["p", "p", "div", "span"])
            inner.append(f"<{t}>{text}</{t}>" + ("<br>" if t == "span" else ""))
        head = f"<h{rng.randint(2, 4)}>{NO}{said(kind)}</h{rng.randint(2, 4)}>" if rng.random() < 0.4 else ""
        if n == 1 and rng.random() < 0.6:
            return f"<{tag}{name(kind, sure)}>{NO}{inline(words(rng.randint(3, longest)))}</{tag}>"
        return f"<{tag}{name(kind, sure)}>{head}{''.join(inner)}</{tag}>"

    def form() -> str:
        options = "".join(f"<option>{NO}{word()}</option>" for _ in range(rng.randint(0, 4)))
        tag = "form" if rng.random() < 0.8 else "div"
        return f"<{tag}{name('form', tag == 'div')}><label>{NO}{said('form')}</label><input name=q>{f'<select>{options}</select>' if options else ''}<button>{NO}{said('form')}</button></{tag}>"

    def comments() -> str:
        tag = rng.choice(["div", "section", "ol", "div"])
        one = "li" if tag == "ol" else rng.choice(["div", "article", "p"])
        items = []
        for _ in range(rng.randint(1, 6)):
            body = inline(words(rng.randint(4, 60)))
            who = f"<div>{NO}{words(2)}</div>" if rng.random() < 0.6 else ""
            items.append(f"<{one}{name('comments') if rng.random() < 0.6 else ''}>{who}<p>{NO}{body}</p></{one}>" if one != "p" else f"<p>{NO}{body}</p>")
        head = f"<h3>{NO}{rng.choice(['Comments', 'Discussion', words(2), '3 comments'])}</h3>" if rng.random() < 0.7 else ""
        return f"<{tag}{name('comments', True)}>{head}{''.join(items)}</{tag}>"

    def boilerplate(where: str) -> str:
        kind = rng.choice({"top": ["nav", "nav", "header", "ad", "notice", "form"], "in": ["ad", "share", "side", "notice"], "end": ["footer", "footer", "side", "ad", "share", "comments", "form", "notice", "nav"]}[where])
        sure = where == "in" or rng.random() < 0.5
        if kind == "nav":
            return listing("nav", rng.randint(2, 9), rng.choice(["nav", "nav", "div", "header"]), sure)
        if kind == "form":
            return form()
        if kind == "comments":
            return comments()
        if kind in ("side", "share"):
            tag = rng.choice(["aside", "div"]) if kind == "side" else "div"
            return listing(kind, rng.randint(1, 6), tag, sure) if rng.random() < 0.7 else prose(kind, rng.randint(1, 4), tag, 25, True)
        tag = {"header": "header", "footer": "footer"}.get(kind, "div") if rng.random() < 0.7 else "div"
        return prose(kind, rng.randint(1, 3), tag, 30, sure or tag == "div")

    def article() -> str:
        out = []
        if rng.random() < 0.85:
            out.append(f"<h1>{YES}{words(rng.randint(2, 14))}</h1>")
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9, 14])):
            r = rng.random()
            if r < 0.8:
                tag = "p" if rng.random() < 0.9 else "div"
                out.append(f"<{tag}>{YES}{inline(words(rng.choice([1, 3, 8, 20, 40, 80])))}{rng.choice(['', '<br>'])}{close(tag)}")
            elif r < 0.86:
                out.append(f"<h2>{YES}{words(rng.randint(1, 6))}</h2>")
            elif r < 0.92:
                tag = rng.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{YES}{inline(words(rng.randint(2, 15)))}{close('li')}" for _ in range(rng.randint(2, 5))) + f"</{tag}>")
            elif r < 0.95:
                out.append(f"<blockquote><p>{YES}{words(rng.randint(5, 30))}</p></blockquote>")
            elif r < 0.97:
                out.append("<table>" + "".join(f"<tr><td>{YES}{words(2)}</td><td>{YES}{words(1)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            else:
                out.append(boilerplate("in"))
        if not any(YES in x for x in out):
            out.append(f"<p>{YES}{words(rng.randint(3, 40))}</p>")
        if rng.random() < 0.12:
            out.append(comments())
        tag = rng.choice(["article", "article", "main", "div", "section", "div"])
        body = f"<{tag}{name('body') if tag != 'article' or rng.random() < 0.3 else ''}>{''.join(out)}</{tag}>"
        for _ in range(rng.randint(0, 2)):
            body = f"<div{name('body') if rng.random() < 0.3 else ''}>{body}</div>"
        return body

    top = [boilerplate("top") for _ in range(rng.randint(0, 4))]
    if rng.random() < 0.6:
        top.insert(0, listing("nav", rng.randint(3, 9), "nav"))
    if rng.random() < 0.5:
        top.append(prose("ad", 1, "div", 20, True))
    end = [boilerplate("end") for _ in range(rng.randint(0, 4))]
    if rng.random() < 0.5:
        end.append(prose("footer", 1, "footer", 25))
    if rng.random() < 0.2:
        top.append(prose("side", rng.randint(1, 4), "aside", 25, True))
    head = f"<head><title>{words(5)}</title><style>p{{}}</style><script>var t='</p>';</script></head>"
    return f"<!DOCTYPE html><html>{head}<body>{''.join(top)}<!-- {word()} -->{article()}{''.join(end)}{'</body></html>' if rng.random() < 0.9 else ''}"


def labelled(page: str) -> tuple[list[Block], np.ndarray]:
    """Blocks of a synthetic page without the label characters, and the labels."""
    blocks, labels = [], []
    for b in blocks_of(page):
        text = b.text.replace(YES, "").replace(NO, "").strip()
        if text:
            blocks.append(Block(b.path, text, b.linked))
            labels.append(YES in b.text)
    return blocks, np.array(labels, np.float32)


@lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES, seed: int = 3) -> Labeller:
    """The labeller, trained once in a process; the same each time."""
    rng = random.Random(seed)
    drawn = [labelled(synthetic_page(rng)) for _ in range(pages)]
    drawn = [(b, y) for b, y in drawn if b]
    return Labeller().fit([b for b, _ in drawn], [y for _, y in drawn])


def main_text(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    The text of the blocks labelled as article, in page order, joined by two line ends;
    empty if there are none. A null html is empty; rows are not grouped, so repeated rows
    give repeated results; an empty table gives none; other columns are ignored.
    """
    require(pages, ("page_id", "url", "html"))
    shared = pages.sparkSession.sparkContext.broadcast(labeller or trained())  # weights: of fixed size

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8(batch.column(2))
            texts: list[str] = []
            for i, j in passes(offsets):
                cut = [blocks_of(x) for x in batch.column(2).slice(i, j - i).to_pylist()]
                for blocks, p in zip(cut, shared.value.label(cut), strict=True):
                    texts.append("\n\n".join(b.text for b, yes in zip(blocks, (p >= 0.5).tolist(), strict=True) if yes))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
