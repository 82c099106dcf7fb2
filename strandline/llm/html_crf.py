"""HTML extraction: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks: runs of text that no block element begins or ends in. Each block has
features of its ancestors' tags and class and id words, and of its text; the field labels the
sequence content or not, is trained on labelled pages by the gradient of its log-likelihood (forward-
backward) and decoded by Viterbi. The content blocks, in page order, are the main text.

The labelled pages come from ``labelled_pages``, a seeded generator of page layouts with known
content; training takes some seconds, happens once in a process, and its result is what tasks get.

Character references are decoded, text by text; white space inside a block becomes one space; scripts,
styles, comments, templates and the head are never text. Attributes are read by name, and only class, id
and role are looked at: an element that is not shown (hidden, aria-hidden, by its style) is judged like any other.

Work is row by row in Arrow batches, without a shuffle; memory is bounded by the longest page.

Defined results: null or empty html gives the empty text; markup that never closes is read as far as
it goes; repeated rows repeat their results; a null url stays null; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import filled, map_rows, strings

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("script style noscript template head title svg iframe object textarea select".split())
RAW = frozenset("script style textarea title iframe".split())
#: An opening tag closes these open elements, if they are innermost apart from inline ones.
CLOSES = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
} | {t: {"p"} for t in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*>?", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMING = frozenset(("class", "id", "role"))  # attributes whose words tell what an element is for
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    path: tuple[str, ...]  # "tag" or "tag.word.word" of each ancestor, outermost first
    text: str
    link: float  # share of the text's characters in links


def leaf_blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order, those without text left out."""
    blocks: list[Block] = []
    stack: list[str] = []  # tag names
    path: list[str] = []  # of block elements, with class and id words
    raw: list[str] = []
    linked = unseen = links = at = 0
    lost: list[bool] = []  # whether the open element hides its text

    def flush() -> None:
        nonlocal raw, linked
        if raw:
            text = " ".join("".join(raw).split())
            if text:
                blocks.append(Block(tuple(path), text, min(1.0, linked / len(text))))
        raw, linked = [], 0

    def leave(n: int) -> None:
        """Close open elements down to depth n."""
        nonlocal unseen, links
        while len(stack) > n:
            tag, gone = stack.pop(), lost.pop()
            if tag not in INLINE:
                flush()
                path.pop()
            unseen -= gone
            links -= tag == "a"

    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at and not unseen:
            raw.append(entities.unescape(page[at : m.start()]))  # each text by itself: a reference ends where it does
            if links:
                linked += len(raw[-1])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in stack:
                depth = len(stack) - 1 - stack[::-1].index(tag)
                if tag not in INLINE or all(t in INLINE for t in stack[depth:]):
                    leave(depth)
            elif tag == "p":
                flush()
            continue
        attributes = m[3] or ""
        if closes := CLOSES.get(tag):
            depth = len(stack)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] in closes:
                    depth = k
                elif stack[k] not in INLINE:
                    break
            leave(depth)
        if tag == "br":
            raw.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        gone = tag in UNSEEN
        if tag not in INLINE:
            flush()
            words = [w.lower() for name, *value in ATTRIBUTE.findall(attributes) if name.lower() in NAMING for w in NAME.findall("".join(value))] if attributes else []
            path.append(".".join([tag, *words]))
        stack.append(tag)
        lost.append(gone)
        unseen += gone
        links += tag == "a"
        if tag in RAW:  # its text ends at its own end tag only
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = end.start() if end else len(page)
    if at < len(page) and not unseen:
        raw.append(entities.unescape(page[at:]))
    leave(0)
    flush()
    return blocks


def path_features(path: tuple[str, ...]) -> list[str]:
    out = set()
    inner = ""  # marks what stands within an article or a main element
    for step in path:
        tag, *words = step.split(".")
        out.add(f"in:{tag}{inner}")
        if tag in ("article", "main"):
            inner = "'"
        out.update(f"w:{w}" for w in words)
        out.update(f"w:{w[:n]}-" for w in words for n in (4, 6) if len(w) > n)
    for step in path[-2:]:  # what is said near the text counts beside what is said far out
        tag, *words = step.split(".")
        out.add(f"near:{tag}")
        out.update(f"near:{w[:6]}" for w in words)
    if path:
        out.add(f"leaf:{path[-1].partition('.')[0]}{inner}")
    out.update(f"over:{a.partition('.')[0]}>{b.partition('.')[0]}{inner}" for a, b in zip(path[-2:], path[-1:]))
    return sorted(out)


def text_features(b: Block) -> list[str]:
    n = len(b.text)
    out = [f"long:{min(7, n.bit_length() - 1)}", f"link:{int(b.link * 3.999)}"]
    if b.text[-1] in ".!?…":
        out.append("stop")
    if "©" in b.text:
        out.append("copyright")
    if b.text.count("|") * 20 > n:
        out.append("bars")
    return out


@dataclass
class Field:
    """Log-linear weights: index of each feature, weights (features, 2), transitions (3, 2): from
    not, content and the page's start."""

    index: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray

    def __post_init__(self):
        self.of_path: dict[tuple[str, ...], tuple[float, float]] = {}
        self.pairs = {f: (float(self.weights[i, 0]), float(self.weights[i, 1])) for f, i in self.index.items()}

    def __getstate__(self):
        return {"index": self.index, "weights": self.weights, "moves": self.moves}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def _sum(self, features: list[str]) -> tuple[float, float]:
        got = [p for f in features if (p := self.pairs.get(f))]
        return sum(p[0] for p in got), sum(p[1] for p in got)

    def label(self, blocks: list[Block]) -> list[int]:
        """Viterbi: the best labelling of the page's blocks."""
        (n0, n1), (c0, c1), (s0, s1) = self.moves.tolist()
        back = []
        a = b = None
        for block in blocks:
            if (p := self.of_path.get(block.path)) is None:
                if len(self.of_path) > 50_000:
                    self.of_path.clear()
                p = self.of_path[block.path] = self._sum(path_features(block.path))
            t = self._sum(text_features(block))
            e0, e1 = p[0] + t[0], p[1] + t[1]
            if a is None:
                a, b = s0 + e0, s1 + e1
                continue
            from0, from1 = (a + n0, b + c0), (a + n1, b + c1)
            back.append((from0[1] > from0[0], from1[1] > from1[0]))
            a, b = max(from0) + e0, max(from1) + e1
        if a is None:
            return []
        out = [int(b > a)]
        for step in reversed(back):
            out.append(int(step[out[-1]]))
        return out[::-1]

    def text(self, page: str) -> str:
        blocks = leaf_blocks(page)
        return "\n".join(b.text for b, y in zip(blocks, self.label(blocks), strict=True) if y)


def fit(pages: list[tuple[list[Block], list[int]]], steps: int = 120, rate: float = 0.5, penalty: float = 3e-4) -> Field:
    """Maximum likelihood by AdaGrad over all pages at once. Pages stand longest first, so that the
    forward and backward passes run over a shrinking head of them, and blocks of equal features are one row."""
    pages = sorted(pages, key=lambda page: -len(page[0]))
    index: dict[str, int] = {}
    kinds: dict[tuple[str, ...], int] = {}
    of_path = lru_cache(maxsize=None)(path_features)
    kind = np.array([kinds.setdefault((*of_path(b.path), *text_features(b)), len(kinds)) for blocks, _ in pages for b in blocks])
    rows = [[index.setdefault(f, len(index)) for f in fs] for fs in kinds]
    flat = np.array([f for r in rows for f in r])
    place = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    sizes = np.array([len(blocks) for blocks, _ in pages])
    n, length = len(pages), int(sizes[0])
    heads = (sizes[:, None] > np.arange(length)).sum(0).tolist()  # pages that have a block i
    real = np.arange(length)[None] < sizes[:, None]
    onehot = np.zeros((n, length, 2))
    onehot[real] = np.eye(2)[np.concatenate([np.asarray(y, int) for _, y in pages])]
    pairs = np.einsum("kia,kib->ab", onehot[:, :-1], onehot[:, 1:])
    last = np.arange(n), sizes - 1
    w, moves = np.zeros((len(index), 2)), np.zeros((3, 2))
    sw, sm = np.full_like(w, 1e-8), np.full_like(moves, 1e-8)
    e, fwd, bwd = np.zeros((n, length, 2)), np.zeros((n, length, 2)), np.zeros((n, length, 2))
    for _ in range(steps):
        e[real] = np.stack([np.bincount(place, w[flat, y], len(rows)) for y in (0, 1)], -1)[kind]
        fwd[:, 0] = moves[2] + e[:, 0]
        for i in range(1, length):
            h = heads[i]
            fwd[:h, i] = np.logaddexp(fwd[:h, i - 1, :1] + moves[0], fwd[:h, i - 1, 1:] + moves[1]) + e[:h, i]
        for i in range(length - 2, -1, -1):
            h = heads[i + 1]
            nxt = bwd[:h, i + 1] + e[:h, i + 1]
            bwd[:h, i] = np.logaddexp(nxt[:, :1] + moves[:2, 0], nxt[:, 1:] + moves[:2, 1])
        z = np.logaddexp(fwd[last][:, 0], fwd[last][:, 1])
        p = np.exp(np.clip(fwd + bwd - z[:, None, None], -60, 0)) * real[..., None]
        q = (fwd[:, :-1, :, None] + moves[None, None, :2] + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])[real[:, 1:]]
        joint = np.exp(np.clip(q, -60, 0)).sum(0)
        r = (onehot - p)[real]
        by_kind = [np.bincount(kind, r[:, y], len(rows)) for y in (0, 1)]
        gw = np.stack([np.bincount(flat, x[place], len(index)) for x in by_kind], -1) / n - penalty * w
        gm = np.concatenate([pairs - joint, (onehot[:, 0] - p[:, 0]).sum(0)[None]]) / n - penalty * moves
        sw += gw**2
        sm += gm**2
        w += rate * gw / np.sqrt(sw)
        moves += rate * gm / np.sqrt(sm)
    return Field(index, w, moves)


def labelled_pages(n: int, seed: int = 0) -> list[tuple[str, str]]:
    """Generated pages and their main text: varied layouts of article, menus, headers, footers,
    sidebars, notices, adverts, forms and reader comments, some badly closed."""
    rng = random.Random(seed)
    pick, chance = rng.choice, lambda p: rng.random() < p
    parts = "a ber che de en for go ha in ja ke li mo no or pa que re sa the un ver wo xi ya zu ä é ñ".split()

    def words(a: int, b: int) -> str:
        return " ".join("".join(pick(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b)))

    def sentence(a: int = 4, b: int = 40) -> str:
        if chance(0.08):
            return words(1, 2).capitalize() + pick([".", ""])
        if chance(0.06):
            return " | ".join(words(1, 1) for _ in range(rng.randint(3, 20)))
        return (". ".join(words(a, b).capitalize() for _ in range(rng.randint(1, 3)))) + pick([".", ".", "", "?"])

    def links(a: int, b: int) -> list[str]:
        return [f'<a href="/{words(1, 1)}">{words(1, 3)}</a>' for _ in range(rng.randint(a, b))]

    def menu(tag: str, cls: str) -> str:
        inner = pick([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in links(3, 8)) + "</ul>", lambda: " | ".join(links(3, 8)), lambda: "".join(f"<div>{x}</div>" for x in links(2, 6))])()
        return f"<{tag}{cls}>{inner}</{tag}>"

    def cells() -> str:
        """A menu laid out as a table, across or down, without a name."""
        items = links(3, 8)
        rows = [items] if chance(0.5) else [[x] for x in items]
        return "<table>" + "".join("<tr>" + "".join(f"<td>{x}</td>" for x in row) + "</tr>" for row in rows) + "</table>"

    def attr(*names: str, role: str = "") -> str:
        if role and chance(0.15):
            return f' role="{role}"'
        return f' {pick(["class", "class", "id"])}="{pick(names)}"'

    def aside(kinds: int = 12) -> str:
        kind = rng.randrange(kinds)
        text = pick([sentence(3, 20), words(2, 8)])
        if kind == 11:
            return cells()
        if kind == 0:
            return menu("nav", "" if chance(0.6) else attr("main-nav", "menu", "breadcrumbs"))
        if kind == 1:
            return menu("div", attr("menu", "nav", "navbar", "navigation", "breadcrumb", "toc", "pagination", role="navigation"))
        if kind == 2:
            return f'<{(t := pick(["div", "div", "section", "ins"]))}{attr("ad", "ads", "advert", "advertisement", "sponsored", "banner", "promo", "ad-slot")}>{pick(["", "<p>"])}{text}</{t}>'
        if kind == 3:
            return f"<aside{pick(['', attr('sidebar', 'related', 'widget')])}><h3>{words(1, 3)}</h3><p>{text}</p>{menu('div', '') if chance(0.5) else ''}</aside>"
        if kind == 4:
            return f'<div{attr("sidebar", "side", "related", "widget", "recommended", "share", "social", role="complementary")}><h4>{words(1, 3)}</h4>{"".join(f"<p>{sentence(3, 15)}</p>" for _ in range(rng.randint(0, 3)))}{menu("div", "")}</div>'
        if kind == 5:
            return f'<div{attr("cookie", "cookie-notice", "cookie-banner", "notice", "consent", "alert", "newsletter", "popup", "gdpr", "modal")}><p>{text}</p><button>{words(1, 2)}</button></div>'
        if kind == 6:
            return f'<form action="/s"><label>{words(1, 3)}</label><input name="q"><p>{text}</p><button>{words(1, 1)}</button></form>'
        if kind == 7:
            return f'<section{attr("comments", "comment-list", "responses", "disqus_thread", "replies", "user-comments")}><h2>{words(1, 2)}</h2>' + "".join(f'<{(t := pick(["div", "article", "li"]))} class="comment"><b>{words(1, 2)}</b><p>{sentence(3, 25)}</p></{t}>' for _ in range(rng.randint(1, 5))) + "</section>"
        if kind == 8 and chance(0.5):
            return f'<{(t := pick(["ol", "ul"]))}{attr("commentlist", "comments", "comment-list")}>' + "".join(f"<li>{pick(['', words(1, 2) + ': '])}{sentence(3, 25)}</li>" for _ in range(rng.randint(1, 5))) + f"</{t}>"
        if kind == 8:
            return f'<div{attr("comments", "comment", "reply", "reader-comments", "discussion")}>' + "".join(f"<p>{sentence(3, 25)}</p>" for _ in range(rng.randint(1, 5))) + "</div>"
        if kind == 9:
            return f'<p{attr("notice", "ad", "meta", "byline", "tags", "disclaimer", "share")}>{text}</p>'
        return f'<{(t := pick(["p", "div"]))}{attr("advert", "sponsored", "promo", "caption-ad", "subscribe")}>{text}</{t}>'

    def paragraph() -> tuple[str, list[str]]:
        kind = rng.randrange(12)
        s = sentence()
        if kind < 6:
            return f"<p>{s}</p>" if chance(0.85) else f"<p><b>{s}<br>", [s]
        if kind == 6:
            h = words(2, 8).capitalize()
            return f"<h2>{h}</h2><p>{s}</p>", [h, s]
        if kind == 7:
            a, b = words(1, 12), words(2, 15)
            return pick([(f'<p>{a} <a href="/x">{b}</a> {s}</p>', [f"{a} {b} {s}"]), (f'<p>{a} <a href="/x">{b}</a>.</p>', [f"{a} {b}."])])
        if kind == 8:
            items = [sentence(2, 12) for _ in range(rng.randint(2, 4))]
            t = pick(["ul", "ol"])
            return f"<{t}>" + "".join(f"<li>{x}</li>" for x in items) + f"</{t}>", items
        if kind == 9:
            return f"<blockquote><p>{s}</p></blockquote>", [s]
        if kind == 10:
            data = [words(1, 3) for _ in range(4)]
            told = [f'<a href="/x">{x}</a>' if chance(0.1) else x for x in data]
            return "<table><tr>" + "".join(f"<td>{x}</td>" for x in told[:2]) + "</tr><tr>" + "".join(f"<td>{x}</td>" for x in told[2:]) + "</tr></table>", data
        return f"<div>{s}</div>" if chance(0.5) else f"<p class=\"{pick(['lead', 'text', 'intro', 'para'])}\">{s}</p>", [s]

    out = []
    for _ in range(n):
        title = words(2, 10).capitalize()
        body, texts = "", []
        inside = pick([0.0, 0.08, 0.3])
        if chance(0.8):
            body, texts = f"<h1>{title}</h1>", [title]
        bare = chance(0.3)  # little but the text: no menus, no headers, short pages
        if bare and chance(0.7):
            body, texts = "", []
        for _ in range(rng.choice([1, 1, 2, 2, 3, 5, 10]) if bare else rng.randint(1, 14)):
            h, t = paragraph()
            body += h
            texts += t
            if chance(inside):
                body += aside(11)  # a table in the text is the text's
        box = pick(["article", "article", "article", "main", "main", "div", "div", "section", "td"])
        cls = attr("content", "post", "entry-content", "article", "article-body", "main", "story", "text", "post-body", role="main") if box in ("div", "section", "td") and chance(0.7) or chance(0.3) else ""
        if chance(0.15):  # a byline above, tags below
            body = f"<header>{body[: body.index('</h1>') + 5]}<p class=\"byline\">{words(2, 4)}</p></header>{body[body.index('</h1>') + 5 :]}" if body.startswith("<h1>") else body
            body += pick(["", f"<footer>{words(1, 4)}</footer>", f'<p class="tags">{words(1, 4)}</p>'])
        shell = f"<{box}{cls}>{body}</{box}>"
        if chance(0.4 if bare else 0.08):  # nothing around the text but the body itself
            shell = body
        elif box == "td":
            beside = f"<td>{cells()}</td>" if not bare and chance(0.4) else ""
            shell = f"<table><tr>{beside}{shell}</tr></table>"
        if chance(0.3):
            shell = f"<div{attr('container', 'wrapper', 'page', 'row')}>{shell}{aside() if chance(0.4) else ''}</div>"
        before = after = ""
        if bare and chance(0.7):
            out.append((pick([shell, f"<body>{shell}</body>", f"<html><head><title>{title}</title></head><body>{shell}</body></html>"]), "\n".join(texts)))
            continue
        if chance(0.5):
            before += f'<header{pick(["", attr("header", "site-header", "masthead", "top")])}>{pick([f"<h1>{words(1, 4)}</h1>", f"<h1>{links(1, 1)[0]}</h1>", f"<div>{words(1, 5)}</div>", ""])}{menu("nav", "") if chance(0.6) else words(1, 6)}</header>'
        elif chance(0.3):
            before += f'<div{attr("header", "site-header", "masthead", "topbar", role="banner")}><p>{words(1, 6)}</p></div>'
        before += "".join(aside() for _ in range(rng.randint(0, 3)))
        after = "".join(aside() for _ in range(rng.randint(0, 3)))
        if chance(0.75):
            after += f"<footer{pick(['', '', attr('footer', 'site-footer')])}>{pick(['&copy; ', ''])}{words(1, 4)}{pick([' &middot; ', ' '])}{sentence(3, 15)}</footer>"
        elif chance(0.5):
            after += f'<div{attr("footer", "bottom", "copyright", "legal", "site-footer", role="contentinfo")}>&copy; {words(2, 10)}</div>'
        page = f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{before}<!-- c -->{shell}{after}' + pick(["</body></html>", ""])
        out.append((page, "\n".join(texts)))
    return out


def gold_labels(blocks: list[Block], main: str) -> list[int]:
    """1 for the blocks that are the main text's lines, in order."""
    lines, k, out = main.split("\n"), 0, []
    for b in blocks:
        hit = k < len(lines) and b.text == lines[k]
        k += hit
        out.append(int(hit))
    return out


@lru_cache(maxsize=1)
def standard_field(n: int = 1400, seed: int = 11) -> Field:
    """The field trained on the generated pages; fitted once in a process."""
    pages = []
    for page, main in labelled_pages(n, seed):
        blocks = leaf_blocks(page)
        pages.append((blocks, gold_labels(blocks, main)))
    return fit(pages)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Field | None = None) -> DataFrame:
    """id_col, url_col, text (main text, blocks joined by a line feed), n_chars (its code points)."""
    model = model or standard_field()
    kinds = pages.schema[id_col].dataType.simpleString(), pages.schema[url_col].dataType.simpleString()

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [model.text(h) for h in strings(batch.column(2))]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["__id", "__url", "text", "n_chars"])

        return one

    out = map_rows(pages.select(F.col(id_col), F.col(url_col), filled(html_col).alias("h")), make, f"__id {kinds[0]}, __url {kinds[1]}, text string, n_chars long")
    return out.withColumnRenamed("__id", id_col).withColumnRenamed("__url", url_col)
