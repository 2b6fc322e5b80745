"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks: runs of text between the tags that break a
block. Every block becomes a vector of its hashed tag path (tags, classes, ids
and roles of all open elements), its hashed words and a few sizes. A bidirectional LSTM reads the
blocks of the whole page in order, so each decision sees the whole document,
and tells main text from the rest.

The network is plain numpy, small and of a fixed size. It is trained from a fixed seed on pages
written by ``sample_page``: site furniture of many kinds around and inside articles under
many names. The weights are kept beside this module; ``python -m stowage.llm.pages`` trains them anew.

A page is cut in one pass over its characters, so broken pages of any size take time in proportion:
a tag without end is text, an element knows the names of all above it from its parent, and open
elements are found by name.

Edge cases. Null, empty and blank pages have an empty text. Unclosed and
stray tags, comments, raw text elements and bare ``<`` do no harm. Pages of
any length are read whole. Repeated rows, and rows that share a page_id or have none, are labelled each;
an empty table gives an empty result. Extra columns are ignored, also those with names of the result.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

#: Parts of a block's vector: hashed path, hashed words, sizes. Units of a direction.
PATH, WORDS, SIZES, UNITS = 320, 32, 4, 20
#: Of the path's part, what the two innermost elements have for themselves.
INNER = 64
#: Pages and passes of training.
PAGES, PASSES = 2000, 9
WEIGHTS = Path(__file__).with_name("block_lstm.npz")
#: Bytes of pages that are labelled together.
TOGETHER = 4 << 20

#: Elements of HTML, by what they do to the text around them; fixed values of the format.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea svg math object select canvas audio video".split())
#: What an opening tag ends, up to the nearest of its containers.
ENDS = {
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
#: What can end a tag, or begin a value in which a > doesn't.
ENDING = re.compile(r"""=\s*(["'])|>""")
NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: A paragraph ends before a block, but not one around these.
AROUND = {"div", "article", "main", "section", "body", "li", "td", "blockquote", "aside", "form", "header", "footer", "nav"}
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=\d)")


def names(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag and the words of its class, id and role."""
    return _names(tag, attributes) if len(attributes) < 200 else _names.__wrapped__(tag, attributes)


@lru_cache(maxsize=10_000)
def _names(tag: str, attributes: str) -> tuple[str, ...]:
    out = [tag]
    for _, a, b, c in NAMES.findall(attributes):
        value = re.sub(r"([a-z])([A-Z])", r"\1-\2", a or b or c).lower()
        out += ["." + w for w in SPLIT.split(value) if w]
    return tuple(out)


class Element:
    """The hashed names of an open element and of all above it, and the names of the innermost two."""

    __slots__ = ("names", "up", "vector")

    def __init__(self, names: tuple[str, ...], up: Element | None) -> None:
        self.names, self.up = names, up
        self.vector = up.vector if up else np.zeros(PATH - INNER, bool)
        if up and names == up.names:
            return
        bits = [zlib.crc32(n.encode()) % (PATH - INNER) for n in names]
        if not self.vector[bits].all():  # what is the same as above is shared
            self.vector = self.vector.copy()
            self.vector[bits] = True

    def path(self) -> np.ndarray:
        out = np.zeros(PATH, np.float32)
        out[: PATH - INNER] = self.vector
        for depth, element in enumerate((self, self.up)):
            for name in element.names if element else ():
                out[PATH - INNER + zlib.crc32(f"{depth}{name}".encode()) % INNER] = 1
        return out


TOP = Element((), None)


class Block:
    """Text with single spaces, its innermost element, and characters inside links."""

    __slots__ = ("element", "linked", "text")

    def __init__(self, element: Element, text: str, linked: int) -> None:
        self.element, self.text, self.linked = element, text, linked


class Open:
    """The open elements, with their places by name."""

    def __init__(self) -> None:
        self.all: list[tuple[str, Element]] = []
        self.at: dict[str, list[int]] = {}
        self.blocks = [-1]

    def push(self, tag: str, element: Element) -> None:
        self.at.setdefault(tag, []).append(len(self.all))
        if tag not in INLINE:
            self.blocks.append(len(self.all))
        self.all.append((tag, element))

    def cut(self, length: int) -> None:
        while len(self.all) > length:
            tag, _ = self.all.pop()
            self.at[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()

    def last(self, tags) -> int:
        """The place of the innermost of these, or -1."""
        best, at = -1, self.at
        for t in tags:
            if (own := at.get(t)) and own[-1] > best:
                best = own[-1]
        return best

    def close(self, tags: set, until: set) -> None:
        """Closes the innermost of ``tags`` unless one of ``until`` is inside it."""
        if (at := self.last(tags)) >= 0 and at > self.last(until):
            self.cut(at)

    def element(self) -> Element:
        return self.all[-1][1] if self.all else TOP


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Place, end, whether it closes, name and attributes of every tag; comments and declarations have no name."""
    at, last, quoted = 0, page.rfind(">"), True
    while 0 <= (lt := page.find("<", at)) <= last:
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = len(page) if stop < 0 else stop + 3
            yield lt, at, False, "", ""
        elif page[lt + 1] in "!?":
            at = page.find(">", lt) + 1
            yield lt, at, False, "", ""
        elif m := TAG.match(page, lt):
            pos, gt = m.end(), -1
            while quoted and (e := ENDING.search(page, pos)):
                if not e[1]:
                    gt = e.start()
                    break
                stop = page.find(e[1], e.end())
                pos = e.end() if stop < 0 else stop + 1
            if gt < 0:  # a value without end: from here on, the first > ends a tag
                quoted, gt = False, page.find(">", m.end())
            at = gt + 1
            yield lt, at, bool(m[1]), m[2].lower(), page[m.end() : gt]
        else:
            at = lt + 1


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    if not page:
        return out
    open_, held, linked, at, skip = Open(), [], 0, 0, ""

    def flush() -> None:
        nonlocal linked
        if not held:
            return
        text = " ".join(_html.unescape("".join(held)).split())
        if text:
            out.append(Block(open_.element(), text, linked))
        held.clear()
        linked = 0

    for start, stop, closes, tag, attributes in tags(page):
        if skip:  # raw text goes on to its own end tag
            if closes and tag == skip:
                skip = ""
            at = stop
            continue
        if start > at:
            held.append(page[at:start])
            linked += start - at if open_.at.get("a") else 0
        at = stop
        if not tag:
            continue
        if closes:
            if tag not in INLINE:
                flush()
            # an inline element ends inside its block only
            if (k := open_.last((tag,))) > (open_.blocks[-1] if tag in INLINE else -1):
                open_.cut(k)
            continue
        empty = tag in VOID or attributes.endswith("/")
        if tag in RAW and not empty and tag not in ("select", "object"):
            skip = tag
            continue
        if tag == "br":
            held.append(" ")
        elif tag not in INLINE:
            flush()
            if tag in ENDS:
                open_.close(*ENDS[tag])
            elif tag not in VOID:
                open_.close({"p"}, AROUND)
        if not empty:
            own = names(tag, attributes)
            open_.push(tag, open_.element() if tag in INLINE and len(own) == 1 else Element(own, open_.element()))
    if not skip:
        held.append(page[at:])
        linked += len(page) - at if open_.at.get("a") else 0
    flush()
    return out


def vectors(page: list[Block]) -> np.ndarray:
    """One row for each block."""
    out = np.zeros((len(page), PATH + WORDS + SIZES), np.float32)
    element, path = None, None
    for i, b in enumerate(page):
        if b.element is not element:
            element, path = b.element, b.element.path()
        out[i, :PATH] = path
        words = b.text.lower().split()
        at = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words)) % WORDS
        out[i, PATH : PATH + WORDS] = np.sqrt(np.bincount(at, minlength=WORDS) / len(words))
        n = len(b.text)
        out[i, PATH + WORDS :] = np.log1p(n) / 8, min(1, b.linked / n), min(1, 10 * sum(b.text.count(c) for c in ".,;:!?") / n), np.log1p(len(words)) / 6
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        n, u = PATH + WORDS + SIZES, UNITS
        self.p = {}
        for d in "fb":
            self.p["w" + d] = (rng.standard_normal((n, 4 * u)) / np.sqrt(n)).astype(np.float32)
            self.p["r" + d] = (rng.standard_normal((u, 4 * u)) / np.sqrt(u)).astype(np.float32)
            bias = np.zeros(4 * u, np.float32)
            bias[u : 2 * u] = 1  # forget gates open
            self.p["c" + d] = bias
        self.p["o"] = (rng.standard_normal(2 * u) / np.sqrt(2 * u)).astype(np.float32)
        self.p["s"] = np.zeros(1, np.float32)

    def into(self, x: np.ndarray, d: str) -> np.ndarray:
        """What the blocks give to the gates."""
        return x @ self.p["w" + d] + self.p["c" + d]

    def _pass(self, into: np.ndarray, mask: np.ndarray, d: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """Hidden states by page and step, and what the way back needs."""
        b, t, _ = into.shape
        u = UNITS
        h, c = np.zeros((b, u), np.float32), np.zeros((b, u), np.float32)
        out, kept = np.zeros((b, t, u), np.float32), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = into[:, k] + h @ self.p["r" + d]
            gates = sigmoid(z[:, : 3 * u])
            i, f, o, g = gates[:, :u], gates[:, u : 2 * u], gates[:, 2 * u :], np.tanh(z[:, 3 * u :])
            m = mask[:, k : k + 1]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if keep:
                kept.append((k, i, f, o, g, c, h, tc))
            c, h = np.where(m, c2, c), np.where(m, o * tc, h)
            out[:, k] = h
        return out, kept

    def forward(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probabilities of main text, by page and step."""
        return self.chances({d: self.into(x, d) for d in "fb"}, mask)

    def chances(self, into: dict[str, np.ndarray], mask: np.ndarray) -> np.ndarray:
        h = np.concatenate([self._pass(into[d], mask, d)[0] for d in "fb"], axis=2)
        return sigmoid(h @ self.p["o"] + self.p["s"])

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        u = UNITS
        runs = {d: self._pass(self.into(x, d), mask, d, keep=True) for d in "fb"}
        h = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        delta = (sigmoid(h @ self.p["o"] + self.p["s"]) - y) * mask / mask.sum()
        g = {"o": np.einsum("bt,btu->u", delta, h), "s": np.array([delta.sum()])}
        for n, d in enumerate("fb"):
            above = delta[:, :, None] * self.p["o"][n * u : (n + 1) * u]
            dz_all = np.zeros((*x.shape[:2], 4 * u), np.float32)
            dh, dc = np.zeros((len(x), u), np.float32), np.zeros((len(x), u), np.float32)
            dr = np.zeros_like(self.p["r" + d])
            for k, i, f, o, gg, c, hh, tc in reversed(runs[d][1]):
                m = mask[:, k : k + 1]
                dh = dh + above[:, k]
                own = dc + dh * o * (1 - tc**2)
                dz = np.concatenate([own * gg * i * (1 - i), own * c * f * (1 - f), dh * tc * o * (1 - o), own * i * (1 - gg**2)], axis=1) * m
                dz_all[:, k] = dz
                dr += hh.T @ dz
                dh = np.where(m, dz @ self.p["r" + d].T, dh)
                dc = np.where(m, own * f, dc)
            g["r" + d] = dr
            g["w" + d] = np.einsum("btn,btz->nz", x, dz_all, optimize=True)
            g["c" + d] = dz_all.sum(axis=(0, 1))
        return g

    def projected(self, pages: list[list[Block]]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """What the blocks of pages give to the gates of both directions, and which steps are there."""
        t = max(map(len, pages))
        out, mask = {d: np.zeros((len(pages), t, 4 * UNITS), np.float32) for d in "fb"}, np.zeros((len(pages), t), bool)
        for i, page in enumerate(pages):
            mask[i, : len(page)] = True
            for lo in range(0, len(page), 1024):
                x = vectors(page[lo : lo + 1024])
                for d in "fb":
                    out[d][i, lo : lo + len(x)] = self.into(x, d)
        return out, mask

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, which of its blocks are main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            # pages of like length go together, so many that the padded cells stay few
            size = max(1, min(64, 4096 // len(pages[order[min(at + 63, len(order) - 1)]])))
            part = order[at : at + size]
            # a long page's vectors never stand there all at once
            p = self.chances(*self.projected([pages[i] for i in part]))
            for k, i in enumerate(part):
                out[i] = p[k, : len(pages[i])] >= 0.5
            at += size
        return out


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, rows))
    x, mask = np.zeros((len(rows), t, rows[0].shape[1]), np.float32), np.zeros((len(rows), t), bool)
    for i, r in enumerate(rows):
        x[i, : len(r)], mask[i, : len(r)] = r, True
    return x, mask


#: Names under which sites keep the parts of a page.
MAIN = "content post entry story article-body post-content entry-content main-content body-text article story-body post-body page-content text prose".split()
#: Names that tell nothing, or stand on parts of either.
NEUTRAL = "lead intro first text title headline subtitle summary item row inner block".split()
SUFFIXES = "container wrapper wrap box inner area block".split()
FURNITURE = {
    "nav": "menu nav navbar main-menu navigation breadcrumbs breadcrumb pagination toc tabs links".split(),
    "header": "header site-header masthead top topbar page-header branding banner logo".split(),
    "footer": "footer site-footer bottom copyright colophon legal page-footer".split(),
    "aside": "sidebar side widget related recommended rail trending popular tags meta author-box more right-col".split(),
    "ad": "ad ads advert advertisement sponsored promo sponsor banner-ad ad-slot commercial partner".split(),
    "notice": "cookie cookie-notice notice consent gdpr alert popup modal overlay paywall newsletter subscribe signup warning disclaimer".split(),
    "form": "search login contact-form signup-form newsletter-form search-form form".split(),
    "comments": "comments comment comment-list discussion replies respond responses disqus thread reactions".split(),
    "share": "share social sharing follow buttons share-bar".split(),
}
#: Those that also stand between the paragraphs of an article.
INSIDE = ("ad", "ad", "ad", "share", "notice", "aside", "form", "comments")


def sample_page(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A page and the main text of its blocks: an article under one of many names, with furniture around and inside it."""
    letters = np.array(list("abcdefghijklmnoprstuvwéüñ"))
    pool = ["".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(150)]
    pick = lambda x: x[int(rng.integers(len(x)))]

    def words(lo: int, hi: int) -> str:
        out = [pick(pool) for _ in range(int(rng.integers(lo, hi)))]
        for k in range(0, len(out), 9):
            out[k] = out[k].capitalize()
            out[min(len(out) - 1, k + 8)] += pick([".", ".", ",", ""])
        return " ".join(out)

    def suffixed(name: str) -> str:
        return f"{name}-{pick(SUFFIXES)}" if rng.random() < 0.25 else name

    def invented() -> str:
        """A name that tells nothing, as every site has its own."""
        return "-".join("".join(rng.choice(letters[:16], rng.integers(2, 9))) for _ in range(int(rng.integers(1, 4))))

    def named() -> str:
        return f' class="{pick(NEUTRAL) if rng.random() < 0.5 else invented()}"' if rng.random() < 0.2 else ""

    main: list[str] = []
    length = lambda: (1, 9) if rng.random() < 0.25 else (8, 90)

    def put(text: str) -> str:
        main.append(" ".join(text.split()))
        return text

    def furniture(kinds: tuple[str, ...] = tuple(FURNITURE)) -> str:
        kind = pick(kinds)
        own = suffixed(pick(FURNITURE[kind]))
        if rng.random() < 0.2:
            own = f"{own}-{invented()}" if rng.random() < 0.5 else f"{invented()}-{own}"
        attr = f'{pick(["class", "class", "id"])}="{own}{pick(["", " " + pick(["box", "wrap", "clearfix", "block"])])}"' if rng.random() < 0.8 else ""
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        if tag is None or (attr and rng.random() < 0.4):
            tag = pick(["div", "div", "section", "aside", "ul"] if kind not in ("nav", "header", "footer") else ["div"])
            attr = attr or f'class="{own}"'
        inner = []
        for _ in range(int(rng.integers(1, 6 if kind != "comments" else 9))):
            text, how = words(*pick([(1, 4), (2, 12), (6, 60)])), rng.random()
            if tag == "ul" or (kind in ("nav", "share") and how < 0.7):
                inner.append(f'<li><a href="/x">{text}</a></li>')
            elif kind == "form":
                inner.append(pick([f"<label>{text}</label><input name=q>", f"<button>{text}</button>", f"<p>{text}</p>", f"<select><option>{text}<option>{words(1, 3)}</select>"]))
            elif kind == "comments":
                inner.append(pick([f'<div class="comment"><span class="author">{words(1, 3)}</span><p>{text}</p></div>', f"<li><p>{text}</p></li>", f"<p>{text}</p>", f"<h3>{words(1, 4)}</h3>"]))
            else:
                inner.append(pick([f"<p>{text}</p>", text, f"<h3>{text}</h3>", f'<a href="#">{text}</a> ', f"<span>{text}</span>", f"<div>{text}</div>"]))
        body = "".join(inner)
        return f"<{tag} {attr}>{'<ul>' + body + '</ul>' if '<li>' in body and tag != 'ul' else body}</{tag}>"

    def article() -> str:
        out = []
        if rng.random() < 0.8:
            title = put(words(2, 12))
            out.append(f"<h1{named()}>{title}</h1>" if rng.random() < 0.8 else f"<header><h1>{title}</h1></header>")
        for _ in range(int(rng.integers(1, 9))):
            how = rng.random()
            if how < 0.62:
                text = words(*length())
                text = put(text)
                if rng.random() < 0.2:
                    text = f"<b>{text}" if rng.random() < 0.5 else f"<em>{text}</em><br>"
                out.append(f"<p{named()}>{text}{'</p>' if rng.random() < 0.85 else ''}")
            elif how < 0.72:
                out.append(f"<h{(k := int(rng.integers(2, 5)))}>{put(words(1, 9))}</h{k}>")
            elif how < 0.79:
                kind = pick(["ul", "ul", "ol"])
                out.append(f"<{kind}{named()}>" + "".join(f"<li>{put(words(1, 30))}</li>" for _ in range(int(rng.integers(1, 7)))) + f"</{kind}>")
            elif how < 0.83:
                out.append(f"<blockquote><p>{put(words(4, 40))}</p></blockquote>")
            elif how < 0.86:
                cell = lambda tag: f"<{tag}>{put(words(1, 6))}</{tag}>"
                columns, lines = int(rng.integers(2, 5)), int(rng.integers(2, 6))
                out.append(f"<table{named()}>" + "".join("<tr>" + "".join(cell("th" if k == 0 and lines > 2 else "td") for _ in range(columns)) + "</tr>" for k in range(lines)) + "</table>")
            elif how < 0.89:
                out.append(f"<pre>{put(words(3, 30))}</pre>" if rng.random() < 0.5 else f"<figure><img src=a><figcaption>{put(words(2, 12))}</figcaption></figure>")
            elif how < 0.92:
                text = put(words(*length()))
                out.append(f"<div{named()}>{text}</div>" if rng.random() < 0.5 else f"{text}<br><br>" if out and not out[-1].endswith("<br>") and out[-1].endswith(">") and "<p" not in out[-1] else f"<p>{text}</p>")
            else:
                out.append(furniture(INSIDE))
        return "".join(out)

    def named_main() -> str:
        how = rng.random()
        own = suffixed(pick(MAIN)) if how < 0.6 else invented() if how < 0.75 else f"{invented()}-{pick(MAIN)}" if how < 0.9 else f"{invented()} {pick(MAIN)}"
        return f' {pick(["class", "class", "id"])}="{own}"'

    middle = article()
    for depth in range(int(pick([0, 1, 1, 1, 2, 2, 3]))):  # containers, innermost first
        tag = pick(["article", "article", "main", "div", "div", "section"])
        attr = named_main() if tag in ("div", "section") and depth == 0 or rng.random() < 0.5 else ""
        middle = f"<{tag}{attr}>{middle}</{tag}>"
    if rng.random() < 0.08:  # a page laid out as a table
        side = f'<td class="{suffixed(pick(FURNITURE[pick(["nav", "aside", "ad"])]))}">' + "".join(pick([f'<a href="/x">{words(1, 4)}</a><br>', f"<p>{words(1, 8)}</p>"]) for _ in range(int(rng.integers(1, 6)))) + "</td>"
        cells = [side, f"<td{named_main() if rng.random() < 0.8 else ''}>{middle}</td>"]
        middle = f"<table><tr>{''.join(cells if rng.random() < 0.6 else cells[::-1])}</tr></table>"
    before, after = "".join(furniture() for _ in range(int(rng.integers(0, 4)))), "".join(furniture() for _ in range(int(rng.integers(0, 4))))
    if rng.random() < 0.3:
        middle = f'<div class="{pick(["wrapper", "container", "page", "row", "site", "layout"])}">{middle}{furniture() if rng.random() < 0.5 else ""}</div>'
    return f"<html><head><title>{words(1, 8)}</title></head><body>{before}{middle}{after}</body></html>", main


def trained(pages: int = PAGES, passes: int = PASSES, seed: int = 11) -> Labeller:
    """The labeller, fitted to generated pages by Adam."""
    rng = np.random.default_rng(seed)
    data = []
    for _ in range(pages):
        page, main = sample_page(rng)
        own, left = blocks(page), list(main)
        y = np.zeros(len(own), np.float32)
        for i, b in enumerate(own):  # generated main texts stand in order, and are not furniture by chance
            if left and b.text == left[0]:
                y[i] = 1
                left.pop(0)
        data.append((vectors(own), y))
    # pages of like length go together, so that little is padded
    data = sorted((d for d in data if len(d[0])), key=lambda d: len(d[0]))
    groups = [data[at : at + 24] for at in range(0, len(data), 24)]
    net = Labeller()
    m, v, k = {n: 0.0 for n in net.p}, {n: 0.0 for n in net.p}, 0
    for epoch in range(passes):
        for part in (groups[i] for i in rng.permutation(len(groups))):
            x, mask = padded([p[0] for p in part])
            y = np.zeros(mask.shape, np.float32)
            for i, p in enumerate(part):
                y[i, : len(p[1])] = p[1]
            k += 1
            rate = 0.01 * (0.5 if epoch >= passes // 2 else 1) * (0.3 if epoch == passes - 1 else 1)
            for n, g in net.gradient(x, mask, y).items():
                m[n] = 0.9 * m[n] + 0.1 * g
                v[n] = 0.999 * v[n] + 0.001 * g**2
                net.p[n] = (net.p[n] - rate * (m[n] / (1 - 0.9**k)) / (np.sqrt(v[n] / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
    return net


@lru_cache(maxsize=1)
def kept() -> Labeller:
    """The labeller with the weights beside this module."""
    net = Labeller()
    with np.load(WEIGHTS) as file:
        net.p = {name: file[name].astype(np.float32) for name in net.p}
    return net


def main_text(pages: DataFrame, net: Labeller | None = None) -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks, n_main_blocks`` for every page; main blocks are joined by an empty line."""
    spark = pages.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(net or kept())  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Labeller = sent.value
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:  # so many pages at a time as have some megabytes
                stop = max(at + 1, min(at + 256, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TOGETHER, "right"))))
                part = batch.slice(at, stop - at)
                cut_ = [blocks(h.as_py()) for h in part.column(2)]
                chosen = own.label(cut_)
                texts = ["\n\n".join(b.text for b, yes in zip(p, y, strict=True) if yes) for p, y in zip(cut_, chosen, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(p) for p in cut_], pa.int64()), pa.array([int(y.sum()) for y in chosen], pa.int64())],
                    names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main_blocks"],
                )
                at = stop

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_main_blocks long")


def op2_block_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **{name: p.astype(np.float16) for name, p in trained().p.items()})
