"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is read into blocks of text with their ancestors. Features are the tags, classes and ids of the ancestors, and
length, links and punctuation of the text. The field is trained in numpy on ``labelled_pages``, pages composed here with
a label for every block, and decoded by Viterbi.

Defined cases: null or empty html has the empty text; broken markup is read as far as it goes; a very long page is read
whole in one pass; repeated rows are read each; a null page_id or url stays null; of labels of equal chance a block takes 0; an
empty table gives no rows; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sievework.llm.common import table

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul noscript template button select label".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag closes open elements of these kinds, up to a container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
CONTAINERS = frozenset("ul ol dl table select div section article body".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")


def blocks(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(ancestors, text, share of the text in links) of every leaf block with text; an ancestor is its tag and its names."""
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, str]] = []
    pieces: list[str] = []
    in_link, linked, at = False, 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                out.append((tuple(x[1] for x in stack), text, min(1.0, linked / len(text))))
            pieces.clear()
        linked = 0

    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            pieces.append(piece)
            if in_link:
                linked += len(piece.strip())
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        if name == "br":
            pieces.append(" ")
        elif name == "a":
            in_link = not (m[2] or m[5])
        elif name in BLOCKS:
            flush()
            if m[2] or m[5]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            else:
                if stack and stack[-1][0] == "p":
                    stack.pop()
                if shut := CLOSES.get(name):
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] in shut:
                            del stack[i:]
                            break
                        if stack[i][0] in CONTAINERS:
                            break
                if name not in VOID:
                    attributes = m[4] or m[7] or ""
                    names = " ".join(x.strip("\"'") for x in NAMES.findall(attributes)) if "=" in attributes else ""
                    stack.append((name, f"{name} {names}" if names else name))
    if at < len(page):
        pieces.append(page[at:])
    flush()
    return out


def place_features(ancestors: tuple[str, ...]) -> set[str]:
    out = {f"own {ancestors[-1].split(' ')[0]}"} if ancestors else {"own none"}
    for a in ancestors:
        tag, _, names = a.partition(" ")
        out.add(f"in {tag}")
        out.update(f"name {p.lower().removesuffix('s')}" for p in PARTS.findall(names))
    if not out & {"in article", "in main"}:
        out.add("no article")
    return out


def text_features(text: str, links: float) -> list[str]:
    n = text.count(" ") + 1
    return [
        f"words {min(6, n.bit_length())}", f"links {round(links * 3)}", f"end {text[-1] if text[-1] in '.!?:…' else '-'}",
        *(["rights"] if "©" in text or "copyright" in text.lower() else []), *(["bar"] if "|" in text or "·" in text else []),
    ]


WORDS = "lorem dolor amet sed elit magna quis nostrud ab über señor être ça the of and to in on der die le la el que with from over under light water stone green".split()


def labelled_pages(n: int, seed: int = 11) -> list[list[tuple[tuple[str, ...], str, float, int]]]:
    """Composed pages as blocks with a label, 1 for main text; the label of a block is set by the part it was written in."""
    rnd = random.Random(seed)

    def sentence(a: int, b: int) -> str:
        return " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(a, b))).capitalize() + rnd.choice([".", ".", ".", "!", "?", ""])

    def prose() -> str:
        return " ".join(sentence(3, 18) for _ in range(rnd.choice([1, 1, 2, 4, 8])))

    def link() -> str:
        return f'<a href="/x">{sentence(1, 3)}</a>'

    def named(tag: str, names: str, inner: str) -> str:
        return f'<{tag} {rnd.choice(["class", "class", "id"])}="{names}">{inner}</{tag}>'

    def junk() -> str:
        kind = rnd.choice("nav menu ad ad notice form sidebar header footer share related crumbs comments".split())
        items = "".join(f"<li>{link()}</li>" for _ in range(rnd.randint(2, 7)))
        some = "".join(f"<p>{prose()}</p>" for _ in range(rnd.randint(1, 3)))
        if kind == "nav":
            return rnd.choice([f"<nav><ul>{items}</ul></nav>", f"<nav>{link()} {link()} {link()}</nav>"])
        if kind == "menu":
            return named(rnd.choice(["div", "ul"]), rnd.choice(["menu", "main-menu", "topnav", "navigation", "navbar"]), items)
        if kind == "ad":
            return named(rnd.choice(["div", "aside", "section"]), rnd.choice(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot"]), rnd.choice([prose(), some]))
        if kind == "notice":
            return named("div", rnd.choice(["notice", "cookie-notice", "consent", "alert", "cookie-banner", "message", "popup", "gdpr"]), prose() + rnd.choice(["", "<button>Accept</button>"]))
        if kind == "form":
            return f"<form{rnd.choice(['', ' class=search', ' class=newsletter'])}><label>{sentence(1, 4)}</label><input><p>{prose()}</p><button>{sentence(1, 2)}</button></form>"
        if kind == "sidebar":
            return rnd.choice([f"<aside>{some}<ul>{items}</ul></aside>", named("div", rnd.choice(["sidebar", "side", "widget", "right-rail"]), f"<h3>{sentence(1, 3)}</h3>{some}")])
        if kind == "header":
            return rnd.choice([f"<header><h2>{sentence(1, 4)}</h2><p>{sentence(2, 6)}</p></header>", named("div", rnd.choice(["header", "site-header", "masthead"]), f"<p>{prose()}</p>")])
        if kind == "footer":
            inner = rnd.choice([f"&copy; site.example &middot; {prose()}", f"<p>Copyright 2020 {sentence(2, 5)}</p>", f"<p>{prose()}</p>", f"<ul>{items}</ul>"])
            return rnd.choice([f"<footer>{inner}</footer>", named("div", rnd.choice(["footer", "site-footer", "copyright"]), inner)])
        if kind == "comments":
            return named(rnd.choice(["div", "section", "ol"]), rnd.choice(["comments", "comment-list", "reader-comments", "discussion", "replies", "responses"]), "".join(named("div", "comment", f"<p>{prose()}</p>") for _ in range(rnd.randint(1, 4))))
        return named("div", rnd.choice({"share": ["share", "social", "share-buttons"], "related": ["related", "recommended", "read-more", "popular"], "crumbs": ["breadcrumb", "breadcrumbs", "pagination", "tags", "byline-links"]}[kind]), rnd.choice([f"<ul>{items}</ul>", link() + link(), some]))

    def body() -> str:
        parts = [f"<h1>{sentence(2, 10)}</h1>"] * (rnd.random() < 0.9)
        for _ in range(rnd.choice([1, 2, 3, 5, 9])):
            parts.append(rnd.choices([f"<p>{prose()}</p>", f"<p>{prose()} {link()} {sentence(2, 9)}</p>", f"<h2>{sentence(1, 6)}</h2>", f"<ul><li>{sentence(1, 9)}</li><li>{prose()}</li></ul>", f"<blockquote>{prose()}</blockquote>", f"<p><b>{sentence(1, 6)}<br><p>{prose()}</p>", f"<table><tr><td>{sentence(1, 4)}</td><td>{sentence(1, 4)}</td></tr></table>", f"<pre>{prose()}</pre>", f"<p>{sentence(1, 2)}</p>", f"<figure><figcaption>{sentence(2, 8)}</figcaption></figure>"], [9, 3, 2, 2, 1, 2, 1, 1, 2, 1])[0])
        return "".join(parts)

    out = []
    for _ in range(n):
        marked: list[tuple[str, int]] = []
        shell = rnd.choice(["article", "article", "main", "div", "div", "section", "none"])
        names = rnd.choice(["content", "post", "entry-content", "article-body", "story", "main", "text", "post-body"])
        start = {"div": f'<div class="{names}">', "section": f'<section id="{names}">', "none": ""}.get(shell, f"<{shell}>")
        end = "" if shell == "none" else f"</{shell}>"
        for _ in range(rnd.randint(0, 4)):
            marked.append((junk(), 0))
        marked.append((start, 0))
        for _ in range(rnd.randint(1, 3)):
            marked.append((body(), 1))
            if rnd.random() < 0.3:
                marked.append((junk(), 0))
        marked.append((end, 0))
        for _ in range(rnd.randint(0, 4)):
            marked.append((junk(), 0))
        # The labels are found by reading the page once as it is and once with all main text marked.
        page = "<html><head><title>t</title></head><body>" + "".join(x for x, _ in marked)
        told = "<html><head><title>t</title></head><body>" + "".join(re.sub(r">(?=[^<])", ">\x02", x) if y else x for x, y in marked)
        out.append([(a, t, s, int("\x02" in u)) for (a, t, s), (_, u, _) in zip(blocks(page), blocks(told), strict=True)])
    return out


class Field:
    """Weights of a two-state chain: per feature, per start, and per step from one label to the next."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.w = np.zeros((0, 2))
        self.start, self.step = np.zeros(2), np.zeros((2, 2))
        self.places: dict[tuple[str, ...], np.ndarray] = {}

    def emissions(self, page: list[tuple]) -> np.ndarray:
        out = np.zeros((len(page), 2))
        if len(self.places) > 50_000:
            self.places.clear()
        for i, (place, text, links, *_) in enumerate(page):
            if (e := self.places.get(place)) is None:
                e = self.places[place] = self.w[[self.index[f] for f in place_features(place) if f in self.index]].sum(0)
            out[i] = e + self.w[[self.index[f] for f in text_features(text, links) if f in self.index]].sum(0)
        return out

    def fit(self, pages: list[list[tuple]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-4) -> Field:
        """Adagrad on the log-likelihood, one page at a time; the expectations are by forward and backward sums."""
        feats = [[sorted(place_features(a) | set(text_features(t, s))) for a, t, s, _ in p] for p in pages]
        for f in sorted({f for p in feats for x in p for f in x}):
            self.index[f] = len(self.index)
        self.w = np.zeros((len(self.index), 2))
        gw, gs, gt = np.full_like(self.w, 1e-2), np.full(2, 1e-2), np.full((2, 2), 1e-2)
        data = [([np.array([self.index[f] for f in x]) for x in fs], np.array([y for *_, y in p])) for fs, p in zip(feats, pages, strict=True) if p]
        rnd = np.random.default_rng(0)
        for _ in range(rounds):
            for k in rnd.permutation(len(data)):
                ids, y = data[k]
                e = np.array([self.w[x].sum(0) for x in ids])
                n = len(y)
                a, b = np.zeros((n, 2)), np.zeros((n, 2))
                a[0] = self.start + e[0]
                for i in range(1, n):
                    a[i] = np.logaddexp(a[i - 1][0] + self.step[0], a[i - 1][1] + self.step[1]) + e[i]
                for i in range(n - 2, -1, -1):
                    x = self.step + e[i + 1] + b[i + 1]
                    b[i] = np.logaddexp(x[:, 0], x[:, 1])
                z = np.logaddexp(*a[-1])
                p = np.exp(a + b - z)
                d = np.eye(2)[y] - p
                ds, dt = d[0], np.zeros((2, 2))
                for i in range(1, n):
                    dt -= np.exp(a[i - 1][:, None] + self.step + e[i] + b[i] - z)
                    dt[y[i - 1], y[i]] += 1
                flat, grad = np.concatenate(ids), np.repeat(d, [len(x) for x in ids], axis=0)
                g = np.zeros_like(self.w)
                np.add.at(g, flat, grad)
                g -= decay * self.w
                for w, h, own in ((self.w, gw, g), (self.start, gs, ds), (self.step, gt, dt)):
                    h += own * own
                    w += rate * own / np.sqrt(h)
        return self

    def viterbi(self, page: list[tuple]) -> list[int]:
        if not page:
            return []
        e, back = self.emissions(page).tolist(), []
        (s0, s1), ((t00, t01), (t10, t11)) = self.start.tolist(), self.step.tolist()
        v0, v1 = s0 + e[0][0], s1 + e[0][1]
        for e0, e1 in e[1:]:
            back.append((v1 + t10 > v0 + t00, v1 + t11 > v0 + t01))
            v0, v1 = max(v0 + t00, v1 + t10) + e0, max(v0 + t01, v1 + t11) + e1
        out = [int(v1 > v0)]
        for came in reversed(back):
            out.append(int(came[out[-1]]))
        return out[::-1]

    def main_text(self, page: str) -> str:
        found = blocks(page)
        return "\n\n".join(t for (_, t, _), y in zip(found, self.viterbi(found), strict=True) if y)


@lru_cache(maxsize=1)
def trained(n: int = 300) -> Field:
    return Field().fit(labelled_pages(n))


def extract(pages: DataFrame, model: Field) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    own = Field()
    own.index, own.w, own.start, own.step = model.index, model.w, model.start, model.step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                out = [own.main_text(h.as_py() or "") for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), trained())
