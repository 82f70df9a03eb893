"""Main text of web pages: a recurrent block labeller over leaf sequences.

A page becomes the sequence of its leaf blocks. Each has vectors of its tag path (tags, class and id words; common ones
in slots of their own, others hashed) and of its hashed words, and a few numbers (length, share of link text, place). A bidirectional LSTM in
numpy reads the whole sequence and labels every block, so that each verdict sees the whole document. The model
is trained here, on pages written by a seeded generator of many layouts; no page of a table is used to learn.

Defined results: a null or empty page has an empty text; markup that breaks off is read as far as it goes;
scripts, styles, titles, text areas and comments never become blocks; repeated rows give equal rows; an empty table gives an empty table; columns
other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as _html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A comment, a tag with its attributes (a quote counts right after an equals sign only, as HTML has it), or a declaration.
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]|=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>"'][^\s>]*)?)*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S
)
_ATTR = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]*)))?""")
_NAMES = {"class", "id", "role"}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Elements whose content is no text (with where it ends), those within a line, and those without content.
RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I | re.A) for t in ("script", "style", "title", "textarea")}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label img br input".split())
INLINE |= set("svg g text tspan math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mtable mtr mtd mpadded mphantom menclose merror semantics annotation annotation-xml".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "td", "th", "tr"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "option": {"option"}} | dict.fromkeys(("noscript", "template", "iframe", "object", "canvas"), set())
SCOPE = {"ul", "ol", "dl", "table", "body", "article", "section", "div", "blockquote", "td", "nav", "aside", "main", "form"}
#: Tags and class words with a slot of their own in the path vector; others share slots by their hash.
KNOWN_TAGS = "html body div p article section nav header footer aside main form ul ol li table tr td th h1 h2 h3 h4 blockquote pre figure figcaption dl dt dd button label".split()
KNOWN_WORDS = (
    "nav menu navbar breadcrumb topbar header masthead sidebar widget related recommended popular trending tags ad ads advert advertisement banner promo sponsored sponsor "
    "cookie cookies consent notice alert popup modal gdpr warning search login subscribe newsletter signup comment reply comments commentlist discussion responses replies disqus "
    "share social author meta pagination footer copyright bottom legal text par lead post article entry story content body main page container wrapper site dialog"
).split()
KNOWN = {t: i for i, t in enumerate([*("T:" + t for t in KNOWN_TAGS), *("L:" + t for t in KNOWN_TAGS), *("C:" + w for w in KNOWN_WORDS)])}
SHARED, WORDS, NUMBERS, HIDDEN = 64, 48, 8, 20
PATH = len(KNOWN) + SHARED


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    link_chars: int


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks in page order: decoded, white space made one space, trimmed, never empty."""
    page = page or ""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[Block] = []
    held: list[str] = []
    links, link_chars, at = 0, 0, 0
    names: dict[str, tuple[str, ...]] = {}

    def flush() -> None:
        nonlocal link_chars
        if held:
            text = " ".join(_html.unescape("".join(held)).split())
            if text:
                out.append(Block(tuple(x for _, own in stack for x in own) + ("L:" + (stack[-1][0] if stack else "none"),), text, link_chars))
            held.clear()
        link_chars = 0

    def close(tag: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                del stack[i:]
                return

    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            held.append(text)
            if links:
                link_chars += len(text)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in INLINE:
                flush()
                close(tag)
            continue
        if tag in RAW and not m[3].endswith("/"):
            end = RAW[tag].search(page, at)
            at = end.start() if end else len(page)
            flush()
            continue
        if tag == "a":
            links += 1
            continue
        if tag in INLINE:
            if tag == "br":
                held.append(" ")
            continue
        flush()
        links = 0
        if tag in VOID:
            continue
        shut = CLOSES.get(tag, {"p"})
        while stack and stack[-1][0] in shut:
            stack.pop()
        if tag in CLOSES and tag != "p":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in SCOPE and stack[i][0] not in shut:
                    break
                if stack[i][0] in shut:
                    del stack[i:]
                    break
        raw = m[3]
        key = tag + raw
        own = names.get(key)
        if own is None:
            words = [w.lower() for a in _ATTR.finditer(raw) if a[1].lower() in _NAMES for w in _WORD.findall(a[2] or a[3] or a[4] or "")]
            own = names[key] = ("T:" + tag, *("C:" + w for w in words))
        stack.append((tag, own))
    flush()
    return out


@lru_cache(maxsize=200_000)
def _slot(token: str) -> int:
    """The place of a path token."""
    own = KNOWN.get(token)
    return own if own is not None else len(KNOWN) + zlib.crc32(token.encode("utf-8", "surrogatepass")) % SHARED


def features(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), PATH + WORDS + NUMBERS), np.float32)
    n = len(blocks)
    for i, b in enumerate(blocks):
        for t in set(b.path):
            x[i, _slot(t)] = 1
        words = b.text.lower().split()
        hashed = np.bincount([zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS for w in words], minlength=WORDS)
        x[i, PATH : PATH + WORDS] = np.sqrt(hashed / len(words))
        size = len(b.text)
        x[i, PATH + WORDS :] = (1, np.log1p(len(words)) / 4, min(1.0, b.link_chars / size), i / n, 1 / (1 + i), 1 / (n - i), b.text[-1] in ".!?…:\"'", np.log1p(n) / 5)
    return x


class Labeller:
    """A bidirectional LSTM with one logit per block. Weights: per direction (input, recurrent, bias), and the output layer."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        d = PATH + WORDS + NUMBERS
        self.w = {}
        for s in "fb":
            self.w["x" + s] = rng.normal(0, 0.15, (d, 4 * HIDDEN)).astype(np.float32)
            self.w["h" + s] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.w["b" + s] = bias
        self.w["o"] = rng.normal(0, 0.3, (2 * HIDDEN, 1)).astype(np.float32)
        self.w["c"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, s: str, keep: bool):
        """x: (time, batch, d); padding leaves the state as it was."""
        steps, size, _ = x.shape
        pre = x.reshape(steps * size, -1) @ self.w["x" + s] + self.w["b" + s]
        pre = pre.reshape(steps, size, -1)
        h, c = np.zeros((size, HIDDEN), np.float32), np.zeros((size, HIDDEN), np.float32)
        out, saved = np.zeros((steps, size, HIDDEN), np.float32), []
        for t in range(steps) if s == "f" else range(steps - 1, -1, -1):
            g = pre[t] + h @ self.w["h" + s]
            sig = 1 / (1 + np.exp(-np.clip(g[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = sig[:, :HIDDEN], sig[:, HIDDEN : 2 * HIDDEN], sig[:, 2 * HIDDEN :]
            u = np.tanh(g[:, 3 * HIDDEN :])
            c2 = f * c + i * u
            tc = np.tanh(c2)
            m = mask[t][:, None]
            h2 = o * tc
            if keep:
                saved.append((t, i, f, o, u, c, tc, h, m))
            c, h = np.where(m, c2, c), np.where(m, h2, h)
            out[t] = h
        return out, saved

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, s, False)[0] for s in "fb"], axis=2)
        return (both @ self.w["o"])[..., 0] + self.w["c"][0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        runs = {s: self._run(x, mask, s, True) for s in "fb"}
        both = np.concatenate([runs[s][0] for s in "fb"], axis=2)
        z = (both @ self.w["o"])[..., 0] + self.w["c"][0]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        total = mask.sum()
        loss = float(-(np.log(np.where(y > 0.5, p, 1 - p) + 1e-9) * mask).sum() / total)
        dz = ((p - y) * mask / total).astype(np.float32)
        grad = {"o": np.einsum("tbh,tb->h", both, dz)[:, None], "c": np.array([dz.sum()], np.float32)}
        dboth = dz[..., None] * self.w["o"][:, 0]
        for k, s in enumerate("fb"):
            dout = dboth[..., k * HIDDEN : (k + 1) * HIDDEN]
            dh, dc = np.zeros(dout.shape[1:], np.float32), np.zeros(dout.shape[1:], np.float32)
            dpre, gh = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(self.w["h" + s])
            for t, i, f, o, u, c, tc, h, m in reversed(runs[s][1]):
                dh = dh + dout[t]
                on, dhm = m, np.where(m, dh, 0)
                dct = np.where(on, dc, 0) + dhm * o * (1 - tc**2)
                g = np.concatenate([dct * u * i * (1 - i), dct * c * f * (1 - f), dhm * tc * o * (1 - o), dct * i * (1 - u**2)], axis=1)
                dpre[t] = g
                gh += h.T @ g
                dh = np.where(on, g @ self.w["h" + s].T, dh)
                dc = np.where(on, dct * f, dc)
            flat = dpre.reshape(-1, 4 * HIDDEN)
            grad["x" + s], grad["h" + s], grad["b" + s] = x.reshape(-1, x.shape[2]).T @ flat, gh, flat.sum(axis=0)
        return loss, grad

    def verdicts(self, pages: list[np.ndarray], most: int = 20_000) -> list[np.ndarray]:
        """Per page the logit of every block. Pages of like length run together, `most` blocks at a time or one page."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            n = max(1, min(len(order), most // len(pages[order[-1]])))
            part, order = order[-n:], order[:-n]
            for i, v in zip(part, self.logits(*_padded([pages[i] for i in part])).T):
                out[i] = v[: len(pages[i])]
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for i, p in enumerate(pages):
        x[: len(p), i] = p
        mask[: len(p), i] = True
    return x, mask


class _Writer:
    """Pages of many layouts in made-up words; each leaf begins with a mark that says whether it is main text."""

    MAIN, REST = "\x01", "\x02"

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.syllables = [a + b for a in ("", "b", "c", "d", "f", "l", "m", "n", "r", "s", "t", "th", "sch", "qu") for b in ("a", "e", "i", "o", "u", "an", "er", "in", "ion", "ung", "é", "ñ", "ü")]

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choices(self.syllables, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
        return " ".join(out).capitalize() + r.choice([".", ".", ".", "", "!", ":"])

    def cls(self, *names: str) -> str:
        r = self.r
        name = r.choice(names)
        name = r.choice([name, name, f"{name}-{r.choice(['box', 'area', 'wrap', 'inner', '1', 'main', 'block'])}", f"site-{name}", f"{name} {self.words(1, 1).strip('.!:').lower()}"])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def leaf(self, mark: str, low: int, high: int, cue: tuple[str, ...] = ()) -> str:
        text = self.words(low, high)
        if cue and self.r.random() < 0.5:
            text = self.r.choice(cue) + " " + text
        return mark + text

    def heading(self, cue: tuple[str, ...]) -> str:
        tag = self.r.choice(["h2", "h3", "h4"])
        return f"<{tag}>{self.leaf(self.REST, 1, 4, cue)}</{tag}>"

    def links(self, tag: str = "li") -> str:
        n = self.r.randint(1, 9)
        items = "".join(f'<{tag}><a href="/x">{self.leaf(self.REST, 1, 3)}</a></{tag}>' for _ in range(n))
        return f"<ul>{items}</ul>" if tag == "li" else items

    def rest(self) -> str:
        """A piece of a page that is not main text."""
        r, m = self.r, self.REST
        p = lambda low=3, high=25, cue=(): f"<p>{self.leaf(m, low, high, cue)}</p>"
        kind = r.randrange(12)
        if kind == 0:
            return r.choice([f"<nav{self.cls('nav', 'menu', '') if r.random() < 0.4 else ''}>{self.links()}</nav>", f"<div{self.cls('nav', 'menu', 'navbar', 'breadcrumb', 'topbar')}>{self.links(r.choice(['li', 'span', 'div']))}</div>"])
        if kind == 1:
            return f"<header{self.cls('header', 'masthead') if r.random() < 0.4 else ''}><{r.choice(['h1', 'h2', 'div', 'p'])}>{self.leaf(m, 1, 8)}</div>{self.links() if r.random() < 0.6 else ''}</header>"
        if kind == 2:
            return f"<aside>{f'<h3>{self.leaf(m, 1, 4)}</h3>' if r.random() < 0.6 else ''}{r.choice([self.links(), p(5, 40), p() + p(5, 60)])}</aside>"
        if kind == 3:
            return f"<div{self.cls('sidebar', 'widget', 'related', 'recommended', 'popular', 'trending', 'tags')}>{self.heading(('Related', 'More', 'Popular'))}{r.choice([self.links(), p(5, 40)])}</div>"
        if kind in (4, 5):
            body = r.choice([self.leaf(m, 1, 30), p(2, 30), f"<span>{self.leaf(m, 2, 20)}</span>", f"<h3>{self.leaf(m, 2, 6)}</h3>{p()}"])
            return f"<{(t := r.choice(['div', 'div', 'section', 'aside']))}{self.cls('ad', 'ads', 'advert', 'advertisement', 'banner', 'promo', 'sponsored', 'sponsor')}>{body}</{t}>"
        if kind == 6:
            return f"<div{self.cls('cookie', 'cookies', 'consent', 'notice', 'alert', 'popup', 'modal', 'gdpr', 'warning')}{r.choice(['', ' role=\"alert\"', ' role=\"dialog\"'])}>{r.choice([self.leaf(m, 4, 40, ('We use cookies', 'This site uses cookies')), p(4, 40, ('We use cookies',))])}{f'<button>{self.leaf(m, 1, 2)}</button>' if r.random() < 0.6 else ''}</div>"
        if kind == 7:
            return f"<form action=\"/s\"{self.cls('search', 'login', 'subscribe', 'newsletter', 'signup') if r.random() < 0.5 else ''}>{p(2, 15) if r.random() < 0.6 else self.leaf(m, 1, 6)}<label>{self.leaf(m, 1, 4)}</label><input name=q><button>{self.leaf(m, 1, 2)}</button></form>"
        if kind in (8, 9):
            each = lambda: f"<{(t := r.choice(['div', 'div', 'li', 'article', 'p']))}{self.cls('comment', 'reply')}>{p(1, 3) if r.random() < 0.5 and t != 'p' else ''}{r.choice([p(2, 50), self.leaf(m, 2, 50)])}</{t}>"
            return f"<{(t := r.choice(['section', 'div', 'div', 'ol']))}{self.cls('comments', 'commentlist', 'discussion', 'responses', 'replies', 'disqus')}>{self.heading(('Comments',)) if r.random() < 0.7 else ''}{''.join(each() if r.random() < 0.8 else p(2, 50) for _ in range(r.randint(1, 6)))}</{t}>"
        if kind == 10:
            return f"<div{self.cls('share', 'social', 'newsletter', 'subscribe', 'login', 'author', 'meta', 'pagination')}>{r.choice([self.leaf(m, 1, 12), self.links('span'), p(1, 15)])}</div>"
        return self.footer()

    def footer(self) -> str:
        r, m = self.r, self.REST
        body = r.choice([self.leaf(m, 3, 30, ("&copy; x.example",)), f"<p>{self.leaf(m, 3, 30, ('&copy; x.example',))}</p>", self.links(), f"<div>{self.leaf(m, 2, 20)}</div>{self.links()}"])
        return r.choice([f"<footer>{body}</footer>", f"<footer>{body}</footer>", f"<footer{self.cls('footer')}>{body}</footer>", f"<div{self.cls('footer', 'copyright', 'bottom', 'legal')}>{body}</div>"])

    def main_block(self) -> str:
        r, m = self.r, self.MAIN
        kind = r.random()
        text = lambda low=1, high=120: self.leaf(m, low, high)
        if kind < 0.72:
            inner = text(1, r.choice([3, 12, 60, 160]))
            if r.random() < 0.2:
                inner = f"{inner} <a href='/y'>{self.words(1, 4)}</a> {self.words(1, 10)}"
            if r.random() < 0.12:
                inner = m + self.r.choice(["All rights reserved.", "Subscribe", "Advertisement", "Comments", "&copy; 2020", "Cookie policy", "License, version 3."]) + " " + (self.words(1, 8) if r.random() < 0.5 else "")
            return r.choice([f"<p>{inner}</p>", f"<p>{inner}</p>", f"<p>{inner}<br>", f"<p><b>{inner}<br>", f"<div>{inner}</div>", f"<p{self.cls('text', 'par', 'lead')}>{inner}</p>"])
        if kind < 0.82:
            return f"<{(t := r.choice(['h2', 'h3', 'h4']))}>{text(1, 8)}</{t}>"
        if kind < 0.9:
            t = r.choice(["ul", "ol"])
            return f"<{t}>" + "".join(f"<li>{text(1, 25)}</li>" for _ in range(r.randint(1, 6))) + f"</{t}>"
        if kind < 0.94:
            return f"<blockquote>{r.choice([f'<p>{text()}</p>', text()])}</blockquote>"
        if kind < 0.97:
            return "<table>" + "".join(f"<tr><td>{text(1, 4)}</td><td>{text(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        return r.choice([f"<pre>{text(1, 30)}</pre>", f"<figure><figcaption>{text(1, 15)}</figcaption></figure>", f"<dl><dt>{text(1, 3)}</dt><dd>{text(2, 20)}</dd></dl>"])

    def page(self) -> str:
        r = self.r
        n = r.choice([1, 1, 2, 2, 3, 5, 8, 12, 20, 30])
        body = [self.main_block() for _ in range(n)]
        if r.random() < 0.7:
            title = f"<{(t := r.choice(['h1', 'h1', 'h1', 'h2']))}>{self.leaf(self.MAIN, 1, 12)}</{t}>"
            body.insert(0, f"<header>{title}</header>" if r.random() < 0.1 else title)
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            body.insert(r.randint(0, len(body)), self.rest())
        inner = "".join(body)
        wrap = r.random()
        if wrap < 0.5:
            main = f"<article{self.cls('post', 'article', 'entry', 'story') if r.random() < 0.3 else ''}>{inner}</article>"
        elif wrap < 0.65:
            main = f"<main>{inner}</main>"
        elif wrap < 0.9:
            main = f"<div{self.cls('content', 'post', 'article', 'entry', 'story', 'body', 'text', 'main')}>{inner}</div>"
        else:
            main = f"<section>{inner}</section>"
        if r.random() < 0.3:
            main = f"<{(t := r.choice(['main', 'div', 'section']))}{self.cls('main', 'page', 'container', 'wrapper') if r.random() < 0.6 else ''}>{''.join(self.rest() for _ in range(r.choice([0, 0, 1])))}{main}{''.join(self.rest() for _ in range(r.choice([0, 0, 1])))}</{t}>"
        before = "".join(self.rest() for _ in range(r.choice([0, 1, 2, 3, 4])))
        after = "".join(self.rest() for _ in range(r.choice([0, 0, 1, 2, 3]))) + (self.footer() if r.random() < 0.7 else "")
        page = f"<!DOCTYPE html><html><head><title>x</title></head><body>{before}{main}{after}"
        return page + ("</body></html>" if r.random() < 0.85 else "")


def sample(n: int, seed: int) -> list[tuple[list[Block], np.ndarray]]:
    """n written pages: blocks without their marks, and 1.0 for main text."""
    writer, out = _Writer(seed), []
    for _ in range(n):
        blocks = blocks_of(writer.page())
        y = np.array([b.text.startswith(_Writer.MAIN) for b in blocks], np.float32)
        clean = [Block(b.path, b.text.replace(_Writer.MAIN, "").replace(_Writer.REST, "").strip() or "x", b.link_chars) for b in blocks]
        out.append((clean, y))
    return out


@lru_cache(maxsize=1)
def trained(n_pages: int = 2500, epochs: int = 6, seed: int = 11) -> Labeller:
    """The labeller of production: Adam over written pages, the same on every run."""
    data = [(features(b), y) for b, y in sample(n_pages, seed) if b]
    model, rng = Labeller(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    v = {k: np.zeros_like(x) for k, x in model.w.items()}
    step, size = 0, 32
    total = epochs * -(-len(data) // size)
    for _ in range(epochs):
        order = sorted(rng.permutation(len(data)).tolist(), key=lambda i: len(data[i][0]) // 8)
        batches = [order[i : i + size] for i in range(0, len(order), size)]
        for k in rng.permutation(len(batches)):
            x, mask = _padded([data[i][0] for i in batches[k]])
            y = np.zeros(mask.shape, np.float32)
            for j, i in enumerate(batches[k]):
                y[: len(data[i][1]), j] = data[i][1]
            _, grad = model.gradients(x, mask, y)
            step += 1
            rate = 0.01 * (1 - step / total) + 0.0005
            for name, g in grad.items():
                g = np.clip(g, -1, 1)
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                model.w[name] = (model.w[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def main_text(page: str | None, model: Labeller) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    return "\n\n".join(b.text for b, z in zip(blocks, model.verdicts([features(blocks)])[0]) if z > 0)


def _extractor(model: Labeller):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                blocks = [blocks_of(h) for h in b.column("html").to_pylist()]
                verdicts = model.verdicts([features(x) if x else np.zeros((0, PATH + WORDS + NUMBERS), np.float32) for x in blocks])
                texts = ["\n\n".join(x.text for x, z in zip(bs, v) if z > 0) for bs, v in zip(blocks, verdicts)]
                n = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), n], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """One row per page: page_id, url, text (main text, empty if none), n_chars (its code points)."""
    run = _extractor(model or trained())
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
