"""Main-text extraction with a tree-structured graphical model over DOM nodes.

Every block element is a node with a label, content or not. Unary potentials come from its tag, its
class and id words and its text; potentials between parent and child depend on the kind of child.
Sum-product messages go up from the leaves and down from the root, for all pages of a slice together,
one depth at a time, and give each node's marginal of being content. The weights are learned by
maximum likelihood from labelled pages: `labelled_pages` composes them from common page parts, each
block with its label.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick

# Elements of HTML by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style template head title iframe svg canvas audio video".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input nobr noscript object map math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder mstyle semantics annotation".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "p": ("article", "aside", "blockquote", "body", "div", "footer", "form", "header", "li", "main", "nav", "section", "table", "td", "th")}
TAGS = "html body article main section div p heading list item nav header footer aside form control table cell blockquote pre figure definition other".split()
TAG_OF = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "ul": "list", "ol": "list", "menu": "list", "dl": "list", "li": "item", "dt": "definition", "dd": "definition", "tr": "table", "thead": "table", "tbody": "table", "td": "cell", "th": "cell", "button": "control", "select": "control", "option": "control", "textarea": "control", "fieldset": "form", "legend": "form", "figcaption": "figure"}
# Words of class, id and role attributes, by what they say.
SAYS = {
    "content": "content article post entry body text story main page paragraph prose markdown blog news single hentry articlebody",
    "navigation": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc skip sitemap links",
    "header": "header masthead banner topbar logo branding head top hero",
    "footer": "footer foot bottom copyright legal colophon contentinfo",
    "side": "sidebar side aside widget widgets rail complementary secondary tags tagcloud",
    "advert": "ad ads adv advert advertisement advertising sponsor sponsored promo promoted promotion adsense banner",
    "notice": "notice cookie cookies consent gdpr alert alertdialog warning popup modal overlay announcement toast subscribe newsletter paywall message",
    "comment": "comment comments commentlist reply replies respond discussion disqus reader readers feedback review reviews",
    "form": "form search searchbox login signin signup register subscription contact poll survey",
    "related": "related share sharing social follow recommended recommendations more popular trending readmore author byline bio meta",
}
SAID = {w: k for k, words in SAYS.items() for w in words.split()}
NUMBERS = ["bias", "hidden", "links", "no_links", "short", "long", "empty"]
FEATURES = [*TAGS, *SAYS, *NUMBERS]
PLACE = {k: i for i, k in enumerate(FEATURES)}
KINDS = ["section", "text", "heading", "item", "marked", "root", "header", "top"]
KIND_OF = {"header": 6, "aside": 4, "nav": 4, "footer": 4, "form": 4, "control": 4, "p": 1, "blockquote": 1, "pre": 1, "cell": 1, "figure": 1, "definition": 1, "heading": 2, "item": 3, "list": 3}
SPACE = re.compile(r"[\s\x00]+")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Dom(HTMLParser):
    """Block elements of one page in page order, and its text blocks with the node each stands in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.marks, self.hidden = ["html"], [-1], [()], [False]
        self.stack: list[tuple[str, int]] = [("html", 0)]
        self.open = Counter(["html"])  # how many of each tag stand on the stack: no scan for one that doesn't
        self.links = 0
        self.skip: list[str] = []  # open elements without content: the head, or a script, style, drawing...
        self.blocks: list[tuple[int, str]] = []
        self.link_chars = [0]
        self.own: list[str] = []

    def cut(self) -> None:
        if self.own:
            text = SPACE.sub(" ", "".join(self.own)).strip()
            self.own = []
            if text:
                self.blocks.append((self.stack[-1][1], text))

    def shut(self, at: int) -> None:
        self.cut()
        self.open.subtract(t for t, _ in self.stack[at:])
        del self.stack[at:]

    def implied(self, names: tuple[str, ...], scope: tuple[str, ...]) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if not any(self.open[n] for n in names):
                return
            if self.stack[i][0] in names:
                # An outer one of them may end as well, as a row does with its cell.
                self.shut(i)
            elif self.stack[i][0] in scope:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skip and self.skip[-1] == "head":
            if tag in IN_HEAD:
                if tag not in VOID:
                    self.skip.append(tag)
                return
            if tag in ("head", "html"):
                return
            self.skip = []  # the head ends where something begins that can't stand in it
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.append(tag)
            return
        if tag == "body" and self.open["body"]:
            return
        if tag in SKIPPED:
            self.skip = [tag]
            return
        if tag in INLINE:
            if tag in ("br", "img", "wbr"):
                self.own.append(" " if tag == "br" else "")
            elif tag == "a":
                self.links += 1
            return
        if tag == "html":
            return
        if tag in CLOSES_P:
            self.implied(("p",), SCOPES["p"])
        if tag in CLOSED_BY:
            self.implied(CLOSED_BY[tag], SCOPES[tag])
        self.cut()
        self.links = 0
        if tag in VOID:
            return
        said, hidden = [], self.hidden[self.stack[-1][1]]
        for k, v in attrs:
            if k in ("class", "id", "role", "itemprop", "aria-label"):
                for w in WORD.findall(v or ""):
                    if s := SAID.get(w.lower()):
                        said.append(s)
            elif k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and UNSEEN.search(v or ""):
                hidden = True
        self.tags.append(tag)
        self.parents.append(self.stack[-1][1])
        self.marks.append(tuple(said))
        self.hidden.append(hidden)
        self.link_chars.append(0)
        self.stack.append((tag, len(self.tags) - 1))
        self.open[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            elif self.skip[0] in ("head", "title") and tag in ("head", "html", "body"):
                self.skip = []
            return
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in INLINE or tag in VOID or tag in ("html", "body"):
            if tag == "body":
                self.cut()
            return
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                self.links = 0
                return self.shut(i)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        before = len(self.skip)
        self.handle_starttag(tag, attrs)
        if tag not in VOID and len(self.skip) > before:
            self.skip.pop()

    def handle_data(self, data: str) -> None:
        if self.skip == ["head"] and data.strip():
            self.skip = []
        if not self.skip:
            self.own.append(data)
            if self.links:
                self.link_chars[self.stack[-1][1]] += len(data.strip())


def parsed(html: str | None) -> Dom:
    d = Dom()
    d.feed(html or "")
    d.close()
    d.cut()
    return d


class Forest:
    """The nodes of many pages: features, parents and depth levels."""

    def __init__(self, doms: list[Dom]):
        sizes = [len(d.tags) for d in doms]
        self.first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        n = int(self.first[-1])
        shift = np.repeat(self.first[:-1], sizes)
        self.parent = np.array([p for d in doms for p in d.parents], np.int64)
        root = self.parent < 0
        self.parent = np.where(root, -1, self.parent + shift)
        self.x = np.zeros((n, len(FEATURES)))
        self.kind = np.zeros(n, np.int64)
        chars, links = np.zeros(n), np.zeros(n)
        for d, lo in zip(doms, self.first.tolist(), strict=False):
            for i, (tag, marks) in enumerate(zip(d.tags, d.marks, strict=True)):
                name = TAG_OF.get(tag, tag)
                at = lo + i
                self.x[at, PLACE.get(name, PLACE["other"])] = 1
                for m in marks:
                    self.x[at, PLACE[m]] = 1
                self.kind[at] = 5 if i == 0 else 4 if marks and "content" not in marks else KIND_OF.get(name, 0)
                if 1 <= self.kind[at] <= 3 and d.tags[d.parents[i]] in ("html", "body"):
                    self.kind[at] = 7  # stands in no container
                self.x[at, PLACE["hidden"]] = d.hidden[i]
                links[at] = d.link_chars[i]
            for i, text in d.blocks:
                chars[lo + i] += len(text)
        self.levels = [np.flatnonzero(root)]
        kids = np.argsort(self.parent, kind="stable")
        lo, hi = np.searchsorted(self.parent[kids], np.arange(n)), np.searchsorted(self.parent[kids], np.arange(n), side="right")
        while len(level := self.levels[-1]):
            count = hi[level] - lo[level]
            ends = np.cumsum(count)
            self.levels.append(kids[np.repeat(lo[level] - (ends - count), count) + np.arange(ends[-1])] if ends[-1] else np.zeros(0, np.int64))
        self.levels.pop()
        for level in self.levels[:0:-1]:  # totals of subtrees
            for v in (chars, links):
                np.add.at(v, self.parent[level], v[level])
        density = np.minimum(links / np.maximum(chars, 1), 1)
        numbers = {"bias": 1, "links": density, "no_links": (density == 0) & (chars > 0), "short": (chars > 0) & (chars < 40), "long": chars > 300, "empty": chars == 0}
        for k, v in numbers.items():
            self.x[:, PLACE[k]] = v


def log_sum(a: np.ndarray) -> np.ndarray:
    m = a.max(axis=-1)
    return m + np.log(np.exp(a - m[..., None]).sum(axis=-1))


def sum_product(f: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of nodes (n, 2) and of parent-child pairs (n, parent, child), and log partition sums of
    the pages' roots. unary: (n, 2) log potentials; pair: (kind, parent, child)."""
    up = unary.copy()
    sent = np.zeros_like(unary)  # message of each node to its parent
    for level in f.levels[:0:-1]:
        sent[level] = log_sum(pair[f.kind[level]] + up[level][:, None, :])
        np.add.at(up, f.parent[level], sent[level])
    down = np.zeros_like(unary)
    edge = np.zeros((len(unary), 2, 2))
    for level in f.levels[1:]:
        p = f.parent[level]
        rest = up[p] + down[p] - sent[level]  # all that the parent knows but for this child
        joint = pair[f.kind[level]] + rest[:, :, None]
        down[level] = log_sum(np.swapaxes(joint, 1, 2))
        joint = joint + up[level][:, None, :]
        edge[level] = np.exp(joint - log_sum(joint.reshape(len(level), 4))[:, None, None])
    belief = up + down
    node = np.exp(belief - log_sum(belief)[:, None])
    return node, edge, log_sum(up[f.levels[0]]) if f.levels else np.zeros(0)


class Model:
    def __init__(self) -> None:
        self.w, self.pair = np.zeros(len(FEATURES)), np.zeros((len(KINDS), 2, 2))

    def unary(self, f: Forest) -> np.ndarray:
        return np.stack([np.zeros(len(f.x)), f.x @ self.w], axis=1)

    def marginals(self, f: Forest) -> np.ndarray:
        return sum_product(f, self.unary(f), self.pair)[0][:, 1] if len(f.x) else np.zeros(0)


def fit(doms: list[Dom], labels: list[list[int]], rounds: int = 200, rate: float = 0.15, decay: float = 0.0001) -> Model:
    """Maximum likelihood with Adam; labels: 1 or 0 for every node of every page."""
    f, m = Forest(doms), Model()
    y = np.array([v for own in labels for v in own], np.int64)
    child = f.parent >= 0
    kind, both = f.kind[child], np.stack([y[f.parent[child]], y[child]], axis=1)
    seen = np.zeros_like(m.pair)
    np.add.at(seen, (kind, both[:, 0], both[:, 1]), 1)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (m.w, m.pair)]
    pages = max(len(doms), 1)
    for step in range(1, rounds + 1):
        node, edge, _ = sum_product(f, m.unary(f), m.pair)
        meant = np.zeros_like(m.pair)
        np.add.at(meant, kind, edge[child])
        for p, g, (a, b) in zip((m.w, m.pair), (f.x.T @ (node[:, 1] - y) / pages + decay * m.w, (meant - seen) / pages + decay * m.pair), moments, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return m


def labelled_pages(n: int = 500, seed: int = 11) -> list[tuple[str, list[str]]]:
    """Pages of many layouts with the blocks of their main text, composed from a seed."""
    r = np.random.default_rng(seed)
    syllables = "ta re mo li shu ka den or ent ver na qui sol um".split()

    def words(k: int) -> str:
        picks = r.integers(0, len(syllables), (max(1, k), 3))
        return " ".join("".join(syllables[i] for i in p[: 1 + p[0] % 3]) for p in picks.tolist())

    def sentence(lo: int = 4, hi: int = 18) -> str:
        return words(int(r.integers(lo, hi))).capitalize() + str(r.choice([".", ".", ".", "!", "?"]))

    def prose(lo: int = 1, hi: int = 6) -> str:
        how = r.random()
        if how < 0.1:  # main text may be poor: repeated words, bars, symbols
            return " ".join([words(1).capitalize()] * int(r.integers(2, 60)))
        if how < 0.2:
            return str(r.choice([" | ", "### ", "$$$ ", ", "])).join(words(int(r.integers(2, 40))).split())
        return " ".join(sentence() for _ in range(int(r.integers(lo, hi))))

    def menu() -> str:
        items = [f'<a href="/{words(1)}">{words(int(r.integers(1, 3)))}</a>' for _ in range(int(r.integers(2, 9)))]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if r.random() < 0.7 else " | ".join(items)

    def wrap(names: list[str], inner: str, tags: tuple[str, ...] = ("div", "section")) -> str:
        tag = str(r.choice(tags))
        how = r.random()
        mark = f' class="{r.choice(names)}"' if how < 0.7 else f' id="{r.choice(names)}"' if tag in ("div", "section") else ""
        return f"<{tag}{mark}>{inner}</{tag}>"

    def block(inner: str) -> str:
        return f"<p>{inner}</p>" if r.random() < 0.6 else inner

    junk = {
        "nav": lambda: f"<nav>{menu()}</nav>" if r.random() < 0.6 else wrap(["nav", "menu", "main-menu", "breadcrumbs", "top-nav"], menu()),
        "header": lambda: wrap(["header", "site-header", "masthead"], f"<h1>{words(2)}</h1>" * int(r.random() < 0.4) + block(words(5)) + menu() * int(r.random() < 0.4), ("header", "div")),
        "ad": lambda: wrap(["ad", "ads", "advert", "ad-box", "sponsored", "promo"], block(prose(1, 4)), ("div", "aside", "section")),
        "notice": lambda: wrap(["notice", "cookie-notice", "alert", "consent", "newsletter"], block(prose(1, 3)) + "<button>OK</button>" * int(r.random() < 0.5)),
        "form": lambda: f'<form><label>{words(2)}</label><input name="q">{block(sentence())}<button>{words(1)}</button></form>' if r.random() < 0.7 else wrap(["search", "login", "signup"], f"<form>{words(2)}<select><option>{words(1)}<option>{words(1)}</select></form>"),
        "side": lambda: wrap(["sidebar", "widget", "side"], f"<h3>{words(2)}</h3>" * int(r.random() < 0.6) + (menu() if r.random() < 0.6 else block(prose(1, 4))), ("aside", "aside", "div")),
        "comments": lambda: wrap(["comments", "comment-list", "discussion"], f"<h3>{words(2)}</h3>" * int(r.random() < 0.6) + "".join(wrap(["comment", "reply"], f"<p>{prose(1, 4)}</p>", ("div", "li", "article", "section")) for _ in range(int(r.integers(1, 5)))), ("section", "div")),
        "related": lambda: wrap(["related", "share", "social", "recommended"], f"<h3>{words(2)}</h3>" + menu()),
        "footer": lambda: wrap(["footer", "site-footer", "copyright"], block(f"&copy; {words(2)} &middot; " + prose(1, 4)), ("footer", "footer", "div")),
    }

    def story() -> tuple[str, list[str]]:
        out, blocks = [], []
        plain = r.random() < 0.1  # paragraphs may be nothing but divs
        mixed = r.choice([0.0, 0.05, 0.4])  # how often something else stands between blocks

        def say(html: str, text: str) -> None:
            out.append(html)
            blocks.append(text)

        if r.random() < 0.85:
            t = words(int(r.integers(3, 10)))
            tag = r.choice(["h1", "h1", "h2"])
            how = r.random()
            say(f"<header{' class=entry-header' * int(how < 0.06)}><{tag}>{t}</{tag}></header>" if how < 0.2 else f"<{tag}>{t}</{tag}>", t)
        for _ in range(int(r.integers(1, 12)) if r.random() < 0.8 else 2):
            kind, t = r.random(), prose(1, 7)
            if kind < 0.62:
                say(f"<div>{t}</div>" if plain else str(r.choice([f"<p>{t}</p>", f"<p>{t}", f"<p><b>{t}<br>", f"<p>{t} <i></i></p>"])), t)
            elif kind < 0.7:
                t = words(3)
                say(f"<h2>{t}</h2>", t)
            elif kind < 0.78:
                own = [sentence(2, 8) for _ in range(int(r.integers(2, 5)))]
                out.append("<ul>" + "".join(f"<li>{x}</li>" for x in own) + "</ul>")
                blocks.extend(own)
            elif kind < 0.84:
                say(f"<blockquote>{t}</blockquote>", t)
            elif kind < 0.88:
                say(f"<pre>{t}</pre>", t)
            elif kind < 0.93:
                a, b = words(2), words(1)
                out.append(f"<table><tr><td>{a}</td><td>{b}</td></tr></table>")
                blocks.extend([a, b])
            else:
                t = sentence(1, 4)
                say(f"<p>{t}</p>", t)
            if r.random() < mixed:
                out.append(junk[str(r.choice(["ad", "notice", "form", "side", "related"]))]())
            if r.random() < 0.04:
                out.append(str(r.choice([f"<p hidden>{t}</p>", f'<div style="display: none"><p>{t}</p></div>', f'<div aria-hidden="true">{t}</div>'])))
        return "".join(out), blocks

    pages = []
    for _ in range(n):
        inner, blocks = story()
        form = r.random()
        if form < 0.45:
            body = f"<article>{inner}</article>"
        elif form < 0.6:
            more = "".join(junk[k]() for k in ("related", "side", "comments", "notice") if r.random() < 0.2)
            body = f"<main>{inner}{more}</main>"
        elif form < 0.8:
            body = wrap(["content", "post", "article-body", "entry-content", "story"], inner, ("div", "div", "section"))
        elif form < 0.92:
            deep = int(r.integers(1, 4))  # divs that say nothing
            body = "<div>" * deep + inner + "</div>" * deep
        else:
            body = inner
        before = [junk[k]() for k in ("header", "nav", "ad", "notice", "form") if r.random() < 0.45]
        after = [junk[k]() for k in ("comments", "related", "side", "ad", "form", "footer") if r.random() < 0.45]
        if r.random() < 0.15:
            before, after = [], []
        tail = "</body></html>" if r.random() < 0.9 else ""
        pages.append((f"<!DOCTYPE html><html><head><title>{words(4)}</title></head><body>{''.join(before)}<!-- x -->{body}{''.join(after)}{tail}", blocks))
    return pages


def node_labels(d: Dom, blocks: list[str]) -> list[int]:
    """Labels of a page's nodes from its main blocks, matched in order. A node with text of its own is
    content if all of it is. Of the others, the innermost one around all main blocks is, those in it that
    hold main blocks are, and those around it that hold nothing else; never the page as a whole."""
    n, k = len(d.tags), 0
    own, good, total = [-1] * n, [0] * n, [0] * n
    for node, text in d.blocks:
        hit = k < len(blocks) and text == SPACE.sub(" ", blocks[k]).strip()
        k += hit
        own[node] = int(hit) if own[node] < 0 else min(own[node], int(hit))
        good[node] += hit
        total[node] += 1
    for i in range(n - 1, 0, -1):
        good[d.parents[i]] += good[i]
        total[d.parents[i]] += total[i]
    inner = max((i for i in range(n) if good[i] == k), default=0) if k else -1
    whole = ("html", "body")
    return [o if o >= 0 else int(t not in whole and g > 0 and (g < k or i == inner or g == c)) for i, (o, t, g, c) in enumerate(zip(own, d.tags, good, total, strict=True))]


def learn(pages: list[tuple[str, list[str]]] | None = None) -> Model:
    """A model from labelled pages (html, main blocks); without any, from those of `labelled_pages`."""
    pages = labelled_pages() if pages is None else pages
    doms = [parsed(h) for h, _ in pages]
    return fit(doms, [node_labels(d, b) for d, (_, b) in zip(doms, pages, strict=True)])


def main_texts(pages: list[str | None], model: Model) -> list[str]:
    doms = [parsed(h) for h in pages]
    forest = Forest(doms)
    content = model.marginals(forest) >= 0.5
    return ["\n".join(t for node, t in d.blocks if content[lo + node]) for d, lo in zip(doms, forest.first.tolist(), strict=False)]


#: Pages, or characters of html, of one numpy pass.
PASS_PAGES, PASS_CHARS = 500, 8_000_000


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page.

    The whole html is parsed; null and empty html, and pages without main text, give an empty text. The
    text inside script, style, template, title, svg, iframe, canvas, audio and video is never main text
    (none of it stands on the page); all else is for the model to tell.
    Broken markup is read as browsers mostly do. Rows are taken one by one: repeated rows each give a
    row, null ids and urls stay null, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column("html").to_pylist()
            lo = 0
            while lo < len(html):
                hi, size = lo, 0
                while hi < len(html) and hi - lo < PASS_PAGES and (hi == lo or size < PASS_CHARS):
                    size += len(html[hi] or "")
                    hi += 1
                texts = main_texts(html[lo:hi], model)
                yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(lo, hi - lo), batch.column("url").slice(lo, hi - lo), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
                lo = hi

    return pick(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
