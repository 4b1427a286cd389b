"""Main text of HTML pages by a tree-structured graphical model over the DOM.

Every node has a hidden state: boilerplate, content, or mixed (a container of both). Potentials between parent and
child, and each node's evidence from its own features, are trained from labelled pages; sum-product messages go from
the leaves up and from the root down and give every run of text its marginal of being content. Levels of all trees of
a batch are handled together by numpy."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, read_table
from .dom import Page, read

BOILER, CONTENT, MIXED = 0, 1, 2
#: Training pages made by rule, and the seed of their words and layouts.
PAGES, SEED = 500, 11
#: Runs of at least this marginal are content.
LEAST = 0.5
#: Pages whose trees are solved together.
TOGETHER = 256

TAGS = tuple("#root #text html head body div section main article header footer nav aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tr td th blockquote pre figure figcaption address fieldset label button details summary center menu dialog".split())
#: Families of class, id and role words.
CUES = tuple(
    re.compile(p)
    for p in (
        r"\bnav|menu|navbar|topnav|navigation|breadcrumb|pagination|pager|skip",
        r"masthead|site-?header|page-?header|topbar|top-bar|\bbanner\b|\blogo|brand|^ ?header\b",
        r"footer|copyright|legal|colophon|imprint|bottom-?bar",
        r"sidebar|side-?bar|\baside|\brail|widget|complementary|secondary",
        r"(?:^|[\s_-])(?:ads?|advert\w*|adslot|adbox|sponsor\w*|promo\w*|dfp|outbrain|taboola)(?:$|[\s_\d-])|advert|sponsor|promot",
        r"cookie|consent|gdpr|notice|alert|modal|popup|overlay|toast|privacy|paywall|dialog|hidden-element",
        r"comment|repl(?:y|ies)|respond|disqus|discussion|reader-|feedback",
        r"\bform|search|login|sign-?in|sign-?up|subscri|newsletter|contact|register",
        r"related|recommend|trending|popular|more-|see-also|read-next|latest|teaser",
        r"share|social|follow|tweet|facebook|print",
        r"author|byline|meta\b|dateline|tags?\b|categor",
        r"article|\bpost|entry|story|\bcontent|\bbody|prose|\btext|\bmain|article-?body|articlebody",
        r"headline|\btitle",
        r"caption|figure|quote|intro|lead|summary|abstract",
    )
)
_WIDTHS = {"tag": len(TAGS) + 1, "parent": len(TAGS) + 1, "grand": len(TAGS) + 1, "cue": 2 * len(CUES) + 2, "length": 8, "links": 6, "stops": 4, "children": 5, "place": 5, "text_in": (len(TAGS) + 1) * 4}
_AT, _n = {}, 0
for _k, _w in _WIDTHS.items():
    _AT[_k], _n = _n, _n + _w
WIDTH = _n
_TAG = {t: i for i, t in enumerate(TAGS)}


@cache
def _cues(text: str) -> tuple[int, ...]:
    return tuple(i for i, p in enumerate(CUES) if p.search(text)) if text else ()


def features(page: Page) -> list[list[int]]:
    """The active features of each node, as numbers below WIDTH."""
    n = len(page.tag)
    length, linked, stops, children = [len(t) for t in page.text], list(page.linked), [0] * n, [0] * n
    for i in range(n):
        if page.text[i]:
            stops[i] = page.text[i].count(".") + page.text[i].count(",") + page.text[i].count("!") + page.text[i].count("?")
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        length[p] += length[i]
        linked[p] += linked[i]
        stops[p] += stops[i]
        children[p] += 1
    total, before = length[0] or 1, 0
    other = len(TAGS)
    tag = [_TAG.get(t, other) for t in page.tag]
    out = []
    for i in range(n):
        p = page.parent[i]
        g = page.parent[p] if p >= 0 else -1
        size = length[i]
        bin_ = min(7, size.bit_length() // 2 + (size > 0)) if size < 8192 else 7
        link = linked[i] / size if size else 0
        row = [tag[i], _AT["parent"] + (tag[p] if p >= 0 else other), _AT["grand"] + (tag[g] if g >= 0 else other), _AT["length"] + bin_, _AT["links"] + min(5, int(link * 5.01)), _AT["stops"] + min(3, int(100 * stops[i] / size) if size else 0), _AT["children"] + min(4, children[i].bit_length()), _AT["place"] + min(4, 5 * before // total), _AT["text_in"] + 4 * tag[i] + min(3, bin_ // 2)]
        cues = _cues(page.cue[i])
        row += [_AT["cue"] + 1 + c for c in cues] or [_AT["cue"]]
        if p >= 0:
            above = _cues(page.cue[p]) + (_cues(page.cue[g]) if g >= 0 and page.tag[i] == "#text" else ())
            row += [_AT["cue"] + 1 + len(CUES) + c for c in dict.fromkeys(above)]
        before += len(page.text[i])
        out.append(row)
    return out


class Trees:
    """Many pages as one forest: features, parents, kinds (0 for runs of text) and levels of all nodes."""

    def __init__(self, pages: list[Page]):
        first, rows, parent, level = 0, [], [], []
        for page in pages:
            rows += features(page)
            depth: list[int] = []
            for p in page.parent:
                depth.append(depth[p] + 1 if p >= 0 else 0)
                parent.append(p + first if p >= 0 else -1)
            level += depth
            first += len(page.tag)
        self.parent, depth_of = np.array(parent, np.int64), np.array(level, np.int64)
        order = np.argsort(depth_of, kind="stable")
        cuts = np.searchsorted(depth_of[order], np.arange(depth_of.max(initial=0) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.kind = np.fromiter((t != "#text" for p in pages for t in p.tag), np.int64, len(parent))
        many = np.fromiter(map(len, rows), np.int64, len(rows))
        self.active = np.fromiter((x for r in rows for x in r), np.int64, int(many.sum()))  # all nodes' features in turn
        self.owner, self.first = np.repeat(np.arange(len(rows)), many), np.cumsum(many) - many


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


class Model:
    """Log potentials: of a node's state by its features, of the root's state, and of the states of parent and child,
    one table for runs of text and one for elements."""

    def __init__(self, weights: np.ndarray, root: np.ndarray, pair: np.ndarray):
        self.weights, self.root, self.pair = weights, root, pair

    def evidence(self, t: Trees) -> np.ndarray:
        return np.add.reduceat(self.weights[t.active], t.first, axis=0)

    def messages(self, t: Trees) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each node's belief from below, its message to the parent, and its belief from above."""
        up = self.evidence(t)
        message, down = np.zeros_like(up), np.zeros_like(up)
        for own in reversed(t.levels[1:]):
            message[own] = _log_sum(self.pair[t.kind[own]] + up[own][:, None, :], 2)
            np.add.at(up, t.parent[own], message[own])
        down[t.levels[0]] = self.root
        for own in t.levels[1:]:
            p = t.parent[own]
            down[own] = _log_sum(self.pair[t.kind[own]] + (down[p] + up[p] - message[own])[:, :, None], 1)
        return up, message, down

    def marginals(self, t: Trees) -> np.ndarray:
        """Each node's probabilities of the three states, by messages up and down."""
        up, _, down = self.messages(t)
        both = up + down
        return np.exp(both - _log_sum(both, 1)[:, None])


def states(page: Page) -> np.ndarray:
    """A labelled page's states: runs by the nearest label above, containers by the runs below them."""
    n = len(page.tag)
    label = list(page.label)
    below = [set() for _ in range(n)]
    for i in range(1, n):
        label[i] = label[i] or label[page.parent[i]]
    for i in range(n - 1, 0, -1):
        if page.tag[i] == "#text":
            below[i].add(CONTENT if label[i] == "content" else BOILER)
        below[page.parent[i]] |= below[i]
    return np.array([MIXED if len(b) > 1 else next(iter(b), CONTENT if label[i] == "content" else BOILER) for i, b in enumerate(below)])


def train(pages: list[str], rounds: int = 130, rate: float = 0.25, ridge: float = 1e-5) -> Model:
    """Maximizes the likelihood of the labelled trees (Adam, full batches): the gradient of each potential is how often
    the labels show it less how often the model's own marginals do, so that what a page's nodes say together is not
    counted twice. Deterministic."""
    read_pages = [read(h) for h in pages]
    t = Trees(read_pages)
    y = np.concatenate([states(p) for p in read_pages])
    n, one = len(y), np.eye(3)[y]
    at, node = t.active, t.owner
    child = np.flatnonzero(t.parent >= 0)
    p, kind, roots = t.parent[child], t.kind[child], t.parent < 0
    m = Model(np.zeros((WIDTH, 3)), np.zeros(3), np.zeros((2, 3, 3)))
    seen = np.zeros((2, 3, 3))
    np.add.at(seen, (kind, y[p], y[child]), 1)
    values = [m.weights, m.root, m.pair]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for r in range(1, rounds + 1):
        up, message, down = m.messages(t)
        both = up + down
        g = one - np.exp(both - _log_sum(both, 1)[:, None])
        joint = m.pair[kind] + (down[p] + up[p] - message[child])[:, :, None] + up[child][:, None, :]
        joint = np.exp(joint - _log_sum(joint.reshape(-1, 9), 1)[:, None, None])
        expected = np.stack([joint[kind == k].sum(0) for k in (0, 1)])
        steps = [np.stack([np.bincount(at, g[node, c], WIDTH) for c in range(3)], 1), g[roots].sum(0), seen - expected]
        for v, s, a, b in zip(values, steps, first, second, strict=True):
            s = ridge * v - s / n
            a += 0.1 * (s - a)
            b += 0.02 * (s * s - b)
            v -= rate * (a / (1 - 0.9**r)) / (np.sqrt(b / (1 - 0.98**r)) + 1e-8)
    return m


def labelled_pages(pages: int = PAGES, seed: int = SEED) -> list[str]:
    """Training pages made by rule: random layouts of articles and of what stands around them, each part labelled."""
    rng = random.Random(seed)
    syllables = "ta re mo li sen ka du vor ni pel ash tor em qui lan fer os un bri che".split()
    pick, some = rng.choice, lambda p: rng.random() < p
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(2, 14).capitalize() + rng.choice(("", ",", "")) + " " + words(1, 6) + rng.choice((".", ".", "!", "?"))
    short = lambda: pick((words(1, 2).capitalize() + ".", words(1, 1), " | ".join(word() for _ in range(rng.randint(2, 9))), words(1, 3).upper() + "!!", f"{rng.randint(1, 9999)} {word()}*** {word()}%%%"))
    prose = lambda a, b: " ".join(sentence() for _ in range(rng.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'

    def wrap(tag: str, inner: str, name: str = "", label: str = "", attribute: str = "class") -> str:
        named = f' {attribute}="{name}"' if name else ""
        return f"<{tag}{named}{f' data-label={label}' if label else ''}>{inner}</{tag}>"

    def links(a: int, b: int) -> str:
        form = pick(("ul", "ul", "plain", "ol", "p"))
        many = [link() for _ in range(rng.randint(a, b))]
        if form in ("ul", "ol"):
            return wrap(form, "".join(wrap("li", x) for x in many))
        return wrap("p", " | ".join(many)) if form == "p" else " ".join(many)

    def boiler() -> list[tuple[str, str]]:
        """Parts around the article: (where, html)."""
        b = "boiler"
        out = [("top", wrap(*pick((("nav", links(3, 9), "", b), ("div", links(3, 9), pick(("nav", "menu", "navbar main-menu", "topnav")), b), ("ul", "".join(wrap("li", link()) for _ in range(5)), pick(("menu", "nav-list", "navigation")), b)))))]
        if some(0.5):
            out.insert(0, ("top", wrap(*pick((("header", wrap("h1", link()) + wrap("p", words(2, 6)), pick(("", "site-header")), b), ("div", wrap("h2", words(1, 3)) + words(2, 5), pick(("masthead", "header", "topbar", "logo")), b), ("header", words(2, 8) + links(2, 5), "", b))))))
        for _ in range(rng.randint(0, 3)):
            out.append((pick(("top", "mid", "in", "in", "end")), wrap(pick(("div", "div", "aside", "section")), pick((prose(1, 3), wrap("p", prose(1, 3)), words(2, 8) + link())), pick(("ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "banner-ad", "promotion-box")), b)))
        if some(0.4):
            out.append((pick(("top", "end")), wrap(pick(("div", "section", "aside", "dialog")), pick((wrap("p", prose(1, 2)) + wrap("button", words(1, 2)), wrap("p", prose(1, 3)), prose(1, 2), prose(1, 1) + " " + link())), pick(("cookie-notice", "cookie-banner", "consent", "gdpr-notice", "notice", "alert", "site-notice", "modal", "privacy-notice")), b, pick(("class", "id")))))
        if some(0.5):
            out.append((pick(("top", "mid", "end")), wrap(*pick((("aside", wrap("h3", words(1, 3)) + pick((links(3, 8), wrap("p", prose(1, 3)))), pick(("", "sidebar", "widget")), b), ("div", wrap("h3", words(1, 3)) + pick((links(3, 8), wrap("p", prose(1, 3)), prose(1, 2))), pick(("sidebar", "side-bar", "widget", "right-rail", "secondary")), b))))))
        if some(0.5):
            said = "".join(wrap(pick(("div", "li", "article")), pick((wrap("b", word()) + " ", wrap("span", word()) + " ", "")) + pick((prose(1, 3), wrap("p", prose(1, 4)))), pick(("comment", "comment-body", "reply", "comment"))) for _ in range(rng.randint(1, 5)))
            out.append((pick(("in_end", "mid", "end")), wrap(pick(("section", "div", "ol", "aside")), wrap("h3", words(1, 2)) + said, pick(("comments", "comment-list", "reader-comments", "disqus", "responses replies", "discussion")), b, pick(("class", "id")))))
        if some(0.4):
            out.append((pick(("top", "in_end", "mid", "end")), wrap("form", wrap("label", words(1, 3)) + '<input type="text">' + wrap("button", word()) + (wrap("p", prose(1, 1)) if some(0.4) else ""), pick(("", "search", "newsletter", "login", "subscribe-form")), b)))
        if some(0.4):
            out.append((pick(("in_end", "mid", "end")), wrap(pick(("div", "section", "aside", "nav")), wrap("h3", words(1, 3)) + links(2, 6), pick(("related", "related-posts", "recommended", "more-stories", "trending")), b)))
        if some(0.3):
            out.append((pick(("in_end", "in", "mid")), wrap(pick(("div", "ul")), " ".join(link() for _ in range(3)), pick(("share", "social", "share-buttons", "social-links")), b)))
        if some(0.3):
            out.append(("top", wrap(pick(("div", "nav", "ol")), " &gt; ".join(link() for _ in range(3)), pick(("breadcrumb", "breadcrumbs", "breadcrumb-trail")), b)))
        if some(0.9):
            out.append(("last", wrap(*pick((("footer", pick((f"&copy; {word()}.example.net &middot; {prose(1, 2)}", wrap("p", "&copy; 2020 " + words(2, 6)) + links(2, 5), prose(1, 3), links(2, 6))), pick(("", "site-footer")), b), ("div", wrap("p", "&copy; " + words(2, 8)) + links(1, 4), pick(("footer", "copyright", "site-footer legal", "bottom-bar")), b, pick(("class", "id"))))))))
        return out

    def article() -> list[str]:
        parts = [wrap(pick(("h1", "h1", "h2")), words(2, 10).capitalize() + pick((".", "")))] if some(0.9) else []
        if parts and some(0.25):
            parts = [wrap(pick(("header", "div")), parts[0] + (wrap("p", prose(1, 1)) if some(0.4) else ""), pick(("", "entry-header", "article-header post-title")))]
        plain = some(0.3)
        for _ in range(rng.randint(1, 14)):
            if plain:
                parts.append(wrap("p", pick((prose, lambda *_: short()))(1, 5)))
                continue
            kind = rng.random()
            if kind < 0.72:
                p = prose(1, 8) if some(0.7) else pick((sentence, short))()
                if some(0.2):
                    p = p.replace(" ", f" <a href=x>{word()}</a> ", 1)
                parts.append(pick((wrap("p", p), wrap("p", p), f"<p>{p}", f"<p><b>{p}<br>", wrap("div", p, pick(("", "paragraph", "text"))), f"<p>{p}<br><br>{prose(1, 2)}</p>")))
            elif kind < 0.8:
                parts.append(wrap(pick(("h2", "h3", "h4")), words(1, 6)))
            elif kind < 0.87:
                parts.append(wrap(pick(("ul", "ol")), "".join(wrap("li", pick((words(1, 8), sentence()))) for _ in range(rng.randint(2, 6)))))
            elif kind < 0.91:
                parts.append(wrap("blockquote", pick((prose(1, 3), wrap("p", prose(1, 2))))))
            elif kind < 0.94:
                parts.append(wrap("table", "".join(wrap("tr", "".join(wrap("td", words(1, 3)) for _ in range(3))) for _ in range(rng.randint(1, 4)))))
            elif kind < 0.97:
                parts.append(wrap("figure", "<img src=x>" + wrap("figcaption", words(3, 10))))
            else:
                parts.append(wrap("pre", words(3, 20)))
        return parts

    out = []
    for _ in range(pages):
        around = boiler()
        body = article()
        for where, h in around:
            if where == "in":
                body.insert(rng.randint(min(1, len(body)), len(body)), h)
            elif where == "in_end":
                body.append(h)
        if some(0.15):
            body.append(wrap(pick(("footer", "footer", "div")), words(1, 3) + " " + link(), pick(("entry-footer", "article-footer", "post-footer")), "boiler"))
        if some(0.2):
            body.insert(min(1, len(body)), wrap(pick(("p", "div")), pick(("By ", "")) + words(1, 4) + pick(("", " " + link(), ", 2020")), pick(("byline", "author", "dateline", "post-meta", "entry-meta"))))
        tag, name = pick((("article", ""), ("article", ""), ("article", "post"), ("div", "content"), ("div", "article-body"), ("div", "post-content entry-content"), ("main", ""), ("section", "story"), ("div", "entry"), ("td", "main-text"), ("div", "text")))
        main = wrap(tag, "".join(body), name, "content", pick(("class", "class", "id")))
        if tag == "td":
            main = wrap("table", wrap("tr", main))
        elif some(0.35):
            main = wrap(*pick((("main", main), ("div", main, "container"), ("div", main, "wrapper", "", "id"), ("section", main))))
        join = lambda place: "".join(h for where, h in around if where == place)  # noqa: B023, E731
        page = join("top") + main + join("mid") + join("end") + join("last")
        if some(0.03):
            page = join("top") + join("last")
        layout = rng.random()
        if layout < 0.08:  # no container at all
            page = (join("top") if some(0.4) else "") + "".join(body) + (join("last") if some(0.5) else "")
            out.append(f"<html><head><title>{words(2, 6)}</title></head><body data-label=content>{page}</body></html>")
            continue
        if layout < 0.16:  # a table lays out the page
            side = wrap("td", links(2, 6), pick(("menu", "nav", "sidebar", "")), "boiler")
            foot = wrap("tr", wrap("td", pick((words(2, 6), links(1, 4), "&copy; " + words(1, 5))), pick(("footer", "copyright", "bottom")), "boiler"))
            rows = wrap("tr", pick(("", side)) + wrap("td", "".join(body), pick(("content", "main", "text", "")), "content") + pick(("", "", side))) + pick(("", foot))
            page = join("top") + wrap("table", rows) + (join("last") if some(0.5) else "")
        elif some(0.4):
            page = wrap("div", page, pick(("page", "wrapper", "container", "site")), "", pick(("class", "id")))
        out.append(f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{page}</body></html>")
    return out


@cache
def model() -> Model:
    """The model of the training pages; trained once in a process, the same in all."""
    return train(labelled_pages())


def extract(htmls: list[str | None], trained: Model) -> list[str]:
    """The main text of each page: runs of content in page order, joined by line ends; empty for null and for pages
    without content."""
    out = []
    for a in range(0, len(htmls), TOGETHER):
        pages = [read(h or "") for h in htmls[a : a + TOGETHER]]
        p = trained.marginals(Trees(pages))[:, CONTENT].tolist()
        at = 0
        for page in pages:
            out.append("\n".join(t for t, x in zip(page.text, p[at : at + len(page.text)], strict=True) if t and x >= LEAST))
            at += len(page.text)
    return out


def extract_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Adds the main text of every page (empty for null html, and where nothing is content) as `out`, which replaces a
    column of that name. Pages are handled in place, whole, whatever their length; no rows move. Rows that repeat get
    the same text each; an empty table stays empty; other columns pass through."""
    df = df if out == html else df.drop(out)
    trained = model()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = extract(b.column(html).to_pylist(), trained)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], [*b.schema.names, out])

    return mapped(df, batches, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page of the table, with its length in code points."""
    return extract_text(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op1_html": op1_html}
ORACLES: dict[str, str] = {}
