"""Operator 7: main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks of text at block-level tags. A block's vector
counts its hashed tag path (tags, and words of class, id and role, of all open
elements, the innermost apart), its hashed words, and a few lengths and link
shares. A numpy bidirectional LSTM reads the whole sequence of a page's blocks
and labels each as main text or not; no block is dropped otherwise.

The labeller is trained here, on pages composed at random from a grammar of
layouts (``compose``: containers with many kinds of names, menus, headers,
footers, sidebars, notices, adverts, forms and comments around and inside an
article of invented words); the pages to extract are never trained on. Training
has a fixed size; weights travel as a broadcast of some hundred KB.

Defined results: null and empty html give an empty text; scripts, styles,
templates, comments and the head never give blocks; an unclosed head ends at the
first tag or text that cannot stand in it; unclosed tags end with their parents; a tag that never ends takes the rest of the page;
repeated rows and null ids are extracted alike; a block whose score is exactly even is no main text; long and deeply nested pages take
time in proportion to their length; other columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.textnum import Words

HIDDEN, PATH, INNER, WORDS, EXTRA = 16, 64, 32, 16, 8
PAGES, EPOCHS, BATCH, RATE, SEED = 2500, 6, 25, 0.01, 3
GROUP_PAGES = 256

#: HTML elements that stand inside a line.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is raw, up to their end tag or the end of the page, and never text of the page.
RAW_TAGS = frozenset("script style textarea iframe title".split())
#: Elements whose content is markup that is never shown as text of the page.
HIDDEN_TAGS = frozenset("template svg select".split())
#: Tags that cannot stand in an svg and end it.
_ENDS_SVG = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup "
    "table tt u ul var".split()
)
#: Tags that can stand in a select; others end one that no end tag of its own ends.
_IN_SELECT = frozenset("option optgroup hr button legend selectedcontent".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW_TAGS | HIDDEN_TAGS}
_STARTS = {tag: re.compile(rf"<{tag}(?=[\s/>])", re.I) for tag in HIDDEN_TAGS}
#: Tags that may stand in a head, besides hidden ones.
_IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript template".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, tag, whether it closes, attributes) of each piece of markup in page order; comments and whole raw or hidden
    elements have no tag. A hidden element is whole if its end tag comes before another start tag of its kind; others are
    opened like any element, and ``blocks`` decides where they end.

    One pass: whatever a search passes over is not searched again. A tag ends at the first > outside of quoted values, or,
    if the page has none, at the first > of all; markup that never ends takes the rest of the page.
    """
    at, strict = 0, True
    ahead: dict[str, re.Match | None] = {}

    def end_tag(tag: str, i: int) -> re.Match | None:
        """The tag's next end tag from i on."""
        if tag not in ahead or ahead[tag] and ahead[tag].start() < i:
            ahead[tag] = _ENDS[tag].search(page, i)
        return ahead[tag]

    def tag_end(i: int) -> int:
        """One past the > of the tag whose attributes begin at i; 0 if there is none."""
        nonlocal strict
        while strict:
            m = _STOP.search(page, i)
            if not m:
                strict = False
            elif m[0] == ">":
                return m.end()
            else:
                k = m.start() - 1
                while page[k].isspace():
                    k -= 1
                # a quote that follows no = is a character like any other
                i = page.find(m[0], m.end()) + 1 if page[k] == "=" else m.end()
                strict = i > 0
        return page.find(">", begin) + 1

    while (begin := page.find("<", at)) >= 0:
        after = page[begin + 1 : begin + 2]
        closes = after == "/"
        m = _NAME.match(page, begin + 1 + closes)
        if m:
            tag, end = m[0].lower(), tag_end(m.end()) or len(page)
            attributes = page[m.end() : end - 1] if page[end - 1] == ">" else page[m.end() : end]
            if not closes and (tag in RAW_TAGS or tag in HIDDEN_TAGS):
                if tag == "svg" and attributes.endswith("/"):
                    tag = ""
                else:
                    stop = end_tag(tag, end)
                    if tag in RAW_TAGS or stop and not _STARTS[tag].search(page, end, stop.start()):
                        end, tag = (page.find(">", stop.end()) + 1 if stop else 0) or len(page), ""
            yield begin, end, tag, closes, attributes
        elif after in ("!", "?", "/") and after:
            close = page.find("-->", begin + 2) + 3 if page.startswith("!--", begin + 1) else page.find(">", begin) + 1
            end = close if close > 2 or close > 0 and page[close - 1] == ">" else len(page)
            yield begin, end, "", False, ""
        else:
            at = begin + 1
            continue
        at = end


_slots: dict[tuple[str, ...], tuple[np.ndarray, np.ndarray]] = {}


def _token_vectors(tokens: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """What an element adds to the path vector, and its vector as the innermost one."""
    got = _slots.get(tokens)
    if got is None:
        if len(_slots) > 20_000:
            _slots.clear()
        got = _slots[tokens] = np.zeros(PATH, np.float32), np.zeros(INNER, np.float32)
        for t in tokens:
            for out, h in zip(got, (zlib.crc32(t.encode()), zlib.crc32(f"|{t}".encode()))):
                out[h % len(out)] += 1 if h & 1 << 20 else -1
    return got


class Element:
    """An open element: its tag, its parent, and the vectors of its path and of the innermost block element."""

    __slots__ = ("tag", "parent", "path", "inner")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.parent = tag, parent
        found = _NAMES.findall(attributes) if "=" in attributes else ()
        path, inner = _token_vectors((tag, *(f".{w}" for parts in found for w in _SPLIT.split("".join(parts).lower()) if w)))
        self.path = parent.path + path if parent else path
        self.inner = parent.inner if tag in INLINE and parent else np.zeros(INNER, np.float32) if tag in INLINE else inner

    def open_tags(self) -> list[str]:
        out, e = [], self
        while e:
            out.append(e.tag)
            e = e.parent
        return out


class Open:
    """The open elements; finding the one that an end tag closes takes no walk over the others."""

    def __init__(self):
        self.stack: list[Element] = []
        self.of_tag: dict[str, list[int]] = {}
        self.block: list[int] = []

    def top(self) -> Element | None:
        return self.stack[-1] if self.stack else None

    def push(self, tag: str, attributes: str) -> None:
        self.of_tag.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.block.append(len(self.stack))
        self.stack.append(Element(tag, attributes, self.top()))

    def close(self, tag: str) -> None:
        """The innermost open element of the tag ends, and all inside of it."""
        if self.of_tag.get(tag):
            stop = self.of_tag[tag][-1]
            while len(self.stack) > stop:
                gone = self.stack.pop()
                self.of_tag[gone.tag].pop()
                if gone.tag not in INLINE:
                    self.block.pop()

    def innermost_block(self) -> str | None:
        return self.stack[self.block[-1]].tag if self.block else None


def blocks(page: str) -> list[tuple[Element | None, str, int]]:
    """(innermost open element, text, characters inside links) of each leaf block in page order; white space is single."""
    out, text, linked, at, head, now = [], [], 0, 0, False, Open()

    def end() -> None:
        nonlocal linked
        if text:
            whole = "".join(text)
            whole = " ".join((entities.unescape(whole) if "&" in whole else whole).split())
            if whole:
                out.append((now.top(), whole, linked))
            text.clear()
        linked = 0

    def take(stop: int) -> None:
        nonlocal linked
        if any(now.of_tag.get(hidden) for hidden in HIDDEN_TAGS):
            return
        text.append(page[at:stop])
        linked += (stop - at) * bool(now.of_tag.get("a"))

    for begin, after, tag, closes, attributes in tags(page):
        between = begin > at
        if head and (between and not page[at:begin].isspace() or tag and (tag in ("html", "body", "br") if closes else tag not in _IN_HEAD)):
            head = False
            now.close("head")
        if between and not head:
            take(begin)
        at = after
        if tag == "br":
            text.append(" ")
        if not tag or tag in ("br", "img", "wbr"):
            continue
        if tag == "head":
            head = not closes
        if not closes:
            while tag in _ENDS_SVG and now.of_tag.get("svg"):
                now.close("svg")
            while tag not in _IN_SELECT and tag not in INLINE and now.of_tag.get("select"):
                now.close("select")
        if tag not in INLINE:
            end()
        if closes:
            now.close(tag)
        elif tag not in VOID and not (attributes.endswith("/") and now.of_tag.get("svg")):
            if tag in _CLOSES_P:
                if now.innermost_block() == "p":
                    now.close("p")
            elif tag in ("li", "dt", "dd", "option", "tr", "td", "th") and now.stack and now.stack[-1].tag == tag:
                now.close(tag)
            now.push(tag, attributes)
    if head:
        now.close("head")
    if at < len(page):
        take(len(page))
    end()
    return out


def vectors(found: list[tuple[Element | None, str, int]]) -> np.ndarray:
    """A vector for each block."""
    out = np.zeros((len(found), PATH + INNER + WORDS + EXTRA), np.float32)
    if not found:
        return out
    nothing = np.zeros(PATH, np.float32), np.zeros(INNER, np.float32)
    for k, part in enumerate((slice(0, PATH), slice(PATH, PATH + INNER))):
        out[:, part] = np.clip(np.stack([((e.path, e.inner) if e else nothing)[k] for e, _, _ in found]), -3, 3)
    words = Words(pa.array([t for _, t, _ in found]), lower=True)
    row = np.repeat(np.arange(len(found)), words.counts)
    h = words.hashes[0]
    sign = np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
    spread = np.bincount(row * WORDS + (h % np.uint64(WORDS)).astype(np.int64), weights=sign, minlength=len(found) * WORDS)
    count = words.counts.astype(float)
    out[:, PATH + INNER : -EXTRA] = spread.reshape(-1, WORDS) / np.sqrt(np.maximum(1, count))[:, None]
    size = np.array([len(t) for _, t, _ in found], float)
    ends = np.array([t[-1] in ".!?:;\"')" for _, t, _ in found], float)
    commas = np.array([t.count(",") + t.count(".") for _, t, _ in found], float)
    linked = np.array([a for *_, a in found], float)
    out[:, -EXTRA:] = np.stack(
        [np.log1p(count) / 3, np.log1p(size) / 4, np.minimum(1, linked / size), ends, commas / np.maximum(1, count), count < 4, count > 20, np.ones(len(found))], axis=1
    )
    return out


def new_weights(inputs: int, hidden: int = HIDDEN, seed: int = SEED) -> dict[str, np.ndarray]:
    rng, w = np.random.default_rng(seed), {}
    for d in "fb":
        w[f"w{d}"] = (rng.normal(size=(inputs, 4 * hidden)) / np.sqrt(inputs)).astype(np.float32)
        w[f"u{d}"] = (rng.normal(size=(hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        w[f"b{d}"] = np.repeat([1.0, 0.0, 0.0, 0.0], hidden).astype(np.float32)
    w["o"], w["c"] = (rng.normal(size=2 * hidden) * 0.3).astype(np.float32), np.zeros(1, np.float32)
    return w


def _lstm(x: np.ndarray, w: dict, d: str, kept: list | None = None) -> np.ndarray:
    """x: (steps, pages, inputs). Hidden states (steps, pages, hidden)."""
    u, hidden = w[f"u{d}"], w[f"u{d}"].shape[0]
    a = x @ w[f"w{d}"] + w[f"b{d}"]
    h = c = np.zeros((x.shape[1], hidden), np.float32)
    out = np.empty((len(x), *h.shape), np.float32)
    for t in range(len(x)):
        g = a[t] + h @ u
        s = 0.5 * np.tanh(0.5 * g[:, : 3 * hidden]) + 0.5
        f, i, o, m = s[:, :hidden], s[:, hidden : 2 * hidden], s[:, 2 * hidden :], np.tanh(g[:, 3 * hidden :])
        c_new = f * c + i * m
        squeezed = np.tanh(c_new)
        if kept is not None:
            kept.append((h, c, f, i, o, m, squeezed))
        h, c = o * squeezed, c_new
        out[t] = h
    return out


def _back(x: np.ndarray, w: dict, d: str, kept: list, dh_all: np.ndarray, g: dict) -> None:
    u, carry, dc = w[f"u{d}"], 0.0, 0.0
    da_all, du = np.empty((*dh_all.shape[:2], u.shape[1]), np.float32), np.zeros_like(u)
    for t in range(len(x) - 1, -1, -1):
        h, c, f, i, o, m, squeezed = kept[t]
        dh = dh_all[t] + carry
        dc = dc + dh * o * (1 - squeezed * squeezed)
        da = np.concatenate([dc * c * f * (1 - f), dc * m * i * (1 - i), dh * squeezed * o * (1 - o), dc * i * (1 - m * m)], axis=1)
        da_all[t], dc = da, dc * f
        du += h.T @ da
        carry = da @ u.T
    flat = da_all.reshape(-1, u.shape[1])
    g[f"u{d}"], g[f"w{d}"], g[f"b{d}"] = du, x.reshape(-1, x.shape[2]).T @ flat, flat.sum(axis=0)


def logits(x: np.ndarray, sizes: np.ndarray, w: dict, kept: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x: (steps, pages, inputs), pages of the given sizes from step 0 on. The backward pass starts at each page's own end."""
    step = np.arange(len(x))[:, None]
    turn = np.where(step < sizes, sizes - 1 - step, step)
    page = np.arange(x.shape[1])[None, :]
    hf = _lstm(x, w, "f", kept[0] if kept else None)
    hb = _lstm(x[turn, page], w, "b", kept[1] if kept else None)[turn, page]
    hidden = hf.shape[2]
    return hf @ w["o"][:hidden] + hb @ w["o"][hidden:] + w["c"], hf, hb


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in pages])
    x = np.zeros((int(sizes.max()), len(pages), pages[0].shape[1]), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
    return x, sizes


def gradients(x: np.ndarray, sizes: np.ndarray, slope, w: dict) -> dict[str, np.ndarray]:
    """Of a loss whose slope by each logit is slope(logits), 0 beyond the pages' ends."""
    kept: tuple[list, list] = ([], [])
    s, hf, hb = logits(x, sizes, w, kept)
    d, hidden, g = slope(s), hf.shape[2], {}
    g["c"], g["o"] = np.array([d.sum()]), np.concatenate([np.einsum("tn,tnh->h", d, hf), np.einsum("tn,tnh->h", d, hb)])
    step, page = np.arange(len(x))[:, None], np.arange(x.shape[1])[None, :]
    turn = np.where(step < sizes, sizes - 1 - step, step)
    _back(x, w, "f", kept[0], d[..., None] * w["o"][:hidden], g)
    _back(x[turn, page], w, "b", kept[1], (d[..., None] * w["o"][hidden:])[turn, page], g)
    return g


#: Usual names of page parts, by part.
MAIN_NAMES = "content post entry article story main body text post-content entry-content article-body page single".split()
OTHER_NAMES = {
    "menu": "nav menu navbar navigation topnav breadcrumb breadcrumbs tabs pagination pager toc links".split(),
    "header": "header masthead banner topbar site-header logo branding search".split(),
    "footer": "footer site-footer colophon copyright legal bottom credits".split(),
    "side": "sidebar aside widget related recommended trending popular tags author-box rail".split(),
    "notice": "cookie consent notice gdpr alert modal popup overlay newsletter subscribe paywall disclaimer".split(),
    "advert": "ad ads advert advertisement sponsored sponsor promo promotion banner-ad adsense".split(),
    "share": "share social sharing follow buttons".split(),
    "comments": "comments comment reply replies respond discussion comment-list thread".split(),
}
#: Usual words of page parts.
OTHER_WORDS = (
    "home about contact login register search menu news privacy policy terms cookies accept subscribe newsletter copyright all rights reserved "
    "share tweet comments reply says read more related sponsored advertisement next previous follow us sign in email address submit"
).split()


def compose(rng: random.Random) -> tuple[str, list[bool]]:
    """A random page and, for each of its blocks in order, whether it is main text."""
    syllables = [rng.choice("bcdfghjklmnprstvw") + rng.choice("aeiouéäó") for _ in range(30)]
    known = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(150)]

    def word() -> str:
        return known[int(150 * rng.random())]

    def sentence(n: int) -> str:
        return (" ".join(word() for _ in range(n)) + rng.choice([".", ".", ".", ",", "!", ""])).capitalize()

    def prose() -> str:
        n = rng.choices([1, 2, 4, 10, 30, 80, 150], [0.08, 0.08, 0.12, 0.22, 0.25, 0.2, 0.05])[0]
        whole = " ".join(sentence(min(n, 12)) for _ in range(max(1, n // 12)))
        if rng.random() < 0.2:
            junk = rng.choice([["###", "***", "&amp;&amp;", "$$$"], ["!!"], [" |"], [" |"]])
            whole = " ".join(w + rng.choice(junk) for w in whole.split())
        if rng.random() < 0.25:
            whole = f"<b>{whole}</b>" if rng.random() < 0.5 else f"<b>{whole}<br>"
        if rng.random() < 0.15:
            whole += f' <a href="/{word()}">{word()} {word()}</a> {word()}'
        return whole

    def short() -> str:
        n = rng.randrange(1, 7)
        return " ".join(rng.choice(OTHER_WORDS) if rng.random() < 0.4 else word() for _ in range(n))

    def named(part: str, tags: list[str]) -> tuple[str, str]:
        tag = rng.choice(tags)
        if tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.6:
            return f"<{tag}>", f"</{tag}>"
        name = rng.choice(OTHER_NAMES[part])
        return f'<{tag} {rng.choice(["class", "id"])}="{name}{rng.choice(["", " " + word(), "-" + word()])}">', f"</{tag}>"

    out, flags = [], []

    def other(part: str) -> None:
        tags = {"menu": ["nav", "div", "ul", "nav"], "header": ["header", "div"], "footer": ["footer", "div", "footer"], "side": ["aside", "div", "section"]}.get(part, ["div", "section", "aside", "div"])
        a, b = named(part, tags)
        out.append(a)
        if part in ("side", "comments", "notice", "share", "advert") and rng.random() < 0.35:
            tag = rng.choice(["h2", "h3", "h4", "h5", "p", "div", "strong"])
            out.append(f"<{tag}>{short().capitalize()}</{tag}>" + ("<hr>" if tag == "strong" else ""))
            flags.append(False)
        if part in ("menu", "side", "share") and rng.random() < 0.8:
            n = rng.randrange(2, 9)
            tag = "ul" if not a.startswith("<ul") else ""
            items = "".join(f'<li><a href="/{word()}">{word() if rng.random() < 0.6 else short()}</a></li>' for _ in range(n))
            out.append(f"<ul>{items}</ul>" if tag else items)
            flags.extend([False] * n)
        elif part == "comments" or part in ("notice", "advert", "footer", "header", "side") and rng.random() < 0.35:
            for _ in range(rng.randrange(1, 5)):
                tag = rng.choice(["p", "div", "li", "p"])
                out.append(f"<{tag}>{prose() if rng.random() < 0.7 else short()}</{tag}>")
                flags.append(False)
        else:
            whole = f"&copy; {rng.choice(['', f'{rng.randrange(1995, 2030)} '])}{short()}{rng.choice([' &middot; ', '. '])}{sentence(5)}" if part == "footer" else sentence(rng.randrange(2, 12)) if rng.random() < 0.6 else short()
            tag = rng.choice(["p", "div", "small", "span", "p"])
            out.append(f"<{tag}>{whole}</{tag}>" if rng.random() < 0.4 else whole)
            flags.append(False)
        out.append(b)

    def form() -> None:
        out.append(f'<form{rng.choice(["", f" class={word()}"])}><label>{short()}</label><input name="q"><button>{short()}</button></form>')
        flags.extend([False, False])

    def maybe(parts: list[str], p: float) -> None:
        for part in parts:
            if rng.random() < p:
                form() if part == "form" else other(part)

    maybe(["notice", "header", "menu", "form", "menu", "advert", "side"], 0.4)
    style = rng.random()
    if style < 0.4:
        a, b = "<article>", "</article>"
    elif style < 0.55:
        a, b = "<main>", "</main>"
    else:
        a, b = f'<{rng.choice(["div", "section", "article", "main"])} {rng.choice(["class", "id"])}="{rng.choice(MAIN_NAMES)}{rng.choice(["", " " + word()])}">', ""
        b = f"</{a[1:].split()[0]}>"
    outer = rng.random()
    if outer < 0.3:
        a, b = f'<div class="{rng.choice(["wrapper", "container", "row", "page", word()])}">' + a, b + "</div>"
    out.append(a)
    if rng.random() < 0.85:
        tag = rng.choice(["h1", "h1", "h2"])
        out.append(f"<{tag}>{sentence(rng.randrange(1, 12))}</{tag}>")
        flags.append(True)
    close_p = rng.random() < 0.8
    for _ in range(rng.choice([1, 2, 3, 5, 8, 14, 25, 50])):
        kind = rng.random()
        if kind < 0.8:
            out.append(f"<p>{prose()}" + ("</p>" if close_p or rng.random() < 0.5 else ""))
            flags.append(True)
        elif kind < 0.86:
            tag = rng.choice(["h2", "h3", "blockquote", "pre"])
            out.append(f"<{tag}>{sentence(rng.randrange(1, 12))}</{tag}>")
            flags.append(True)
        elif kind < 0.91:
            n = rng.randrange(1, 6)
            tag = rng.choice(["ul", "ol"])
            out.append(f"<{tag}>" + "".join(f"<li>{sentence(rng.randrange(1, 15))}</li>" for _ in range(n)) + f"</{tag}>")
            flags.extend([True] * n)
        else:
            maybe(["advert", "share", "notice", "side", "form"], 0.25)
    maybe(["share", "comments"], 0.12)
    out.append(b)
    maybe(["share", "side", "comments", "form", "advert", "notice", "footer"], 0.4)
    page = f"<html><head><title>{sentence(5)}</title><style>p{{}}</style></head><body>{''.join(out)}" + ("</body></html>" if rng.random() < 0.8 else "")
    return page, flags


@functools.cache
def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    rng, plain = np.random.default_rng(seed), random.Random(seed)
    samples = []
    while len(samples) < pages:
        page, flags = compose(plain)
        found = blocks(page)
        if found and len(found) == len(flags):
            samples.append((vectors(found), np.array(flags, np.float32)))
    w = new_weights(samples[0][0].shape[1], seed=seed)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    steps, total = 0, epochs * -(-pages // BATCH)
    for _ in range(epochs):
        # pages of like length share a batch, so little of it is padding
        order = np.argsort(np.array([len(f) for _, f in samples]) * rng.uniform(0.8, 1.2, pages))
        for a in rng.permutation(range(0, pages, BATCH)):
            part = [samples[k] for k in order[a : a + BATCH]]
            x, sizes = _padded([v for v, _ in part])
            y, inside = np.zeros(x.shape[:2], np.float32), np.arange(len(x))[:, None] < sizes
            for k, (_, f) in enumerate(part):
                y[: len(f), k] = f
            g = gradients(x, sizes, lambda s: ((1 / (1 + np.exp(-s)) - y) * inside / inside.sum()).astype(np.float32), w)  # noqa: B023
            steps += 1
            rate = RATE * (1 - steps / (total + 1))
            norm = float(np.sqrt(sum((v * v).sum() for v in g.values())))
            for k, v in g.items():
                v = v * min(1.0, 1.0 / (norm + 1e-9))
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                w[k] -= rate * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8)
    return w


def labelled(pages: list[str], w: dict) -> list[list[tuple[str, bool]]]:
    """Blocks of each page and whether each is main text."""
    found = [blocks(p) for p in pages]
    flat = vectors([b for f in found for b in f])
    stops = np.cumsum([len(f) for f in found])
    flags: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = [k for k in sorted(range(len(pages)), key=lambda k: len(found[k])) if found[k]]
    while order:  # pages of like length together
        part = [order.pop()]
        while order and len(part) < 64 and 2 * len(found[order[-1]]) + 16 >= len(found[part[0]]):
            part.append(order.pop())
        x, sizes = _padded([flat[stops[k] - len(found[k]) : stops[k]] for k in part])
        s = logits(x, sizes, w)[0]
        for column, k in enumerate(part):
            flags[k] = s[: len(found[k]), column] > 0
    return [[(b[1], bool(y)) for b, y in zip(f, g)] for f, g in zip(found, flags)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: dict | None = None) -> DataFrame:
    """page_id, url, text: main blocks of each page, joined by line feeds."""
    shared = pages.sparkSession.sparkContext.broadcast(weights or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, GROUP_PAGES):
                batch = whole.slice(a, GROUP_PAGES)
                texts = ["\n".join(t for t, main in page if main) for page in labelled([p or "" for p in batch.column(2).to_pylist()], w)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    at = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return at.mapInArrow(run, "page_id long, url string, text string")
