"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements. Every node is content or not: its own features (tag, words of class, id and
role, amounts of text and links) and a potential between parent and child decide. Sum-product messages pass upward
and then downward through all trees of a batch at once, level by level, and give each node's exact marginal. Weights
are trained by the exact gradient of the likelihood on labelled pages, which `labelled_pages` builds: no table of
labelled pages exists, so pages of many layouts are generated with the label of every block.

Text of a block goes to its nearest block element. Blocks of nodes with a marginal of 0.5 or more are the main text.
Defined results: null and empty input gives no text, input without markup its whole text; broken markup closes as
browsers do, and is read in time in proportion to its length (see Tokens); paragraphs in a noscript element are judged
like those beside it; repeated rows give equal results; only the named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of HTML: elements without content, raw text elements, block elements, and what ends an open element.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title".split())
FOREIGN = {"svg", "math"}  # here and inside, a slash closes an element
#: Elements with a node of their own that can stand within a paragraph; what is in them is judged like other blocks.
NODES = set("template iframe select datalist noscript".split())
OPTIONS = {"option": {"option"}, "optgroup": {"option", "optgroup"}}  # open elements that an opening one ends
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile("""[>"']""")
#: Tags of a page that no bracket outside quotes may end, before quotes count as other characters in the rest of it.
BROKEN_TAGS = 16
ATTRIBUTE = re.compile(r"""(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none""", re.IGNORECASE)
NAME = re.compile(r"[a-z]+")
FEATURES = 2048
KINDS = 4  # of potentials between parent and child, by the child's tag
KEEP = 0.5
#: Elements that set some text of a page apart.
HOLDERS = set("article aside div dl footer form header main menu nav ol section table ul".split())
#: Nodes deeper than this become siblings of the deepest ones, as browsers do; no text is lost.
DEEPEST = 512


class Tokens:
    """Comments and tags of a page, each found once, so that reading takes time in proportion whatever never closes.

    A tag ends at the first bracket outside quotes or, if there is none, at the first bracket; a quote that is never
    closed is a character like others. What no bracket follows is text; a comment that never closes takes the rest.
    """

    def __init__(self, source: str):
        self.source = source
        self.last = source.rfind(">")
        self.lone: set[str] = set()  # quotes that don't come any more
        self.broken = 0

    def tag_end(self, at: int) -> int:
        """The place of the bracket that ends the tag; one follows."""
        source, place = self.source, at
        while self.broken < BROKEN_TAGS and place <= self.last:
            place = STOP.search(source, place).start()
            quote = source[place]
            if quote == ">":
                return place
            over = -1 if quote in self.lone else source.find(quote, place + 1)
            if over < 0:
                self.lone.add(quote)
            place = max(place, over) + 1
        self.broken += 1
        return source.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """Start, end, tag (empty for other markup), whether it closes, and attributes of the next one."""
        source = self.source
        while (at := source.find("<", at)) >= 0:
            if source.startswith("<!--", at):
                over = source.find("-->", at + 4)
                return at, over + 3 if over >= 0 else len(source), "", False, ""
            if at > self.last:
                at = at + 1
            elif source[at + 1] in "!?":
                return at, source.find(">", at) + 1, "", False, ""
            elif m := TAG.match(source, at):
                over = self.tag_end(m.end())
                return at, over + 1, m[2].lower(), bool(m[1]), source[m.end() : over]
            else:
                at = at + 1
        return None


class Open:
    """The open elements: (tag, nearest block node), with the places of each tag, so that looking one up costs nothing."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = [("#root", 0)]
        self.places: dict[str, list[int]] = {}
        self.blocks = 0  # open elements that have a node

    def push(self, tag: str, node: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.blocks += tag in BLOCKS or tag in NODES
        self.stack.append((tag, node))

    def close(self, size: int) -> None:
        """Close all elements but the first `size`."""
        while len(self.stack) > size:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            self.blocks -= tag in BLOCKS or tag in NODES

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these tags, 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close_implied(self, tag: str) -> None:
        """Close what an opening block element ends by itself."""
        closes, stops = ENDS.get(tag, set()) | ({"p"} if tag in BLOCKS else set()), STOPS.get(tag, set())
        walls = stops if tag in ENDS else {"table", "button"}
        while (at := self.last(*closes)) > self.last(*walls):
            self.close(at)
            if tag not in ENDS or self.stack[-1][0] in stops:
                break


class Page:
    """The tree of one page: of each node the parent, tag, attributes and text; and the text blocks in page order."""

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.depth: list[int] = [0]
        self.tag: list[str] = ["#root"]
        self.names: list[str] = [""]
        self.label: list[int] = [0]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links
        self.read(source)

    def add(self, parent: int, tag: str, attributes: str) -> int:
        names, label = [], 0
        for a in ATTRIBUTE.finditer(attributes):
            value = a[2] or a[3] or a[4] or ""
            if a[1].lower() == "data-y":
                label = int(value == "1")
            else:
                names.append(value.lower())
        if tag == "template" or HIDDEN.search(attributes):
            names.append("hidden")
        if self.depth[parent] >= DEEPEST:
            parent = self.parent[parent]
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tag.append(tag)
        self.names.append(" ".join(names))
        self.label.append(label)
        return len(self.parent) - 1

    def read(self, source: str) -> None:
        opened = Open()
        stack, places = opened.stack, opened.places
        buffer: list[str] = []
        links = at = 0

        def flush() -> None:
            nonlocal links
            if buffer and (text := " ".join("".join(buffer).split())):
                self.blocks.append((stack[-1][1], text, links))
            buffer.clear()
            links = 0

        def put(text: str) -> None:
            nonlocal links
            if text:
                text = html.unescape(text)
                buffer.append(text)
                if places.get("a"):
                    links += len(text)

        end, tokens = len(source), Tokens(source)
        while at < end:
            token = tokens.next(at)
            if token is None:
                put(source[at:])
                break
            put(source[at : token[0]])
            _, at, tag, closing, attributes = token
            if not tag:
                continue
            block = tag in BLOCKS or tag in NODES
            if closing:
                if where := opened.last(tag):
                    if opened.blocks and any(t in BLOCKS or t in NODES for t, _ in stack[where:]):
                        flush()
                    opened.close(where)
                continue
            if tag in RAW:
                over = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(source, at)
                at = over.end() if over else end
                continue
            if attributes.endswith("/") and (tag in FOREIGN or opened.last(*FOREIGN)):
                continue
            if tag in OPTIONS:
                buffer.append(" ")
                while stack[-1][0] in OPTIONS[tag]:
                    opened.close(len(stack) - 1)
            if tag in VOID:
                if tag == "hr":
                    flush()
                else:
                    buffer.append(" " if tag == "br" else "")
                continue
            if block:
                flush()
                if stack[-1][0] == "noscript":  # only text straight in it is its own
                    opened.close(len(stack) - 1)
                opened.close_implied(tag)
                opened.push(tag, self.add(stack[-1][1], tag, attributes))
            else:
                opened.push(tag, stack[-1][1])
        flush()
        if HOLDERS.isdisjoint(self.tag):  # nothing is set apart from the text: what holds it is judged as an article
            self.tag[next((self.tag.index(t) for t in ("body", "html") if t in self.tag), 0)] = "article"


@functools.cache
def slot(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


def kind(tag: str) -> int:
    return 1 if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote") else 2 if tag in ("li", "ul", "ol", "td", "tr", "table", "tbody", "dd", "dt", "dl") else 3 if tag in ("div", "section") else 0


class Forest:
    """The trees of several pages, level by level, with the features of every node."""

    def __init__(self, pages: list[Page]):
        parent, level, kinds, rows, columns, labels, starts = [], [], [], [], [], [], []
        for page in pages:
            base, n = len(parent), len(page.parent)
            starts.append(base)
            own, link = [0] * n, [0] * n
            for node, text, links in page.blocks:
                own[node] += len(text)
                link[node] += links
            all_own, all_link = own[:], link[:]
            for i in range(n - 1, 0, -1):
                all_own[page.parent[i]] += all_own[i]
                all_link[page.parent[i]] += all_link[i]
            whole = max(1, all_own[0])
            level += page.depth
            for i in range(n):
                up = page.parent[i]
                parent.append(base + up if i else -1)
                kinds.append(kind(page.tag[i]))
                share = all_link[i] / max(1, all_own[i])
                found = {
                    "bias", f"tag {page.tag[i]}", f"up {page.tag[up] if i else ''}",
                    f"own {min(9, own[i].bit_length())}", f"own {own[i] > 0} {page.tag[i]}", f"links {round(share * 4)}",
                    f"part {round(all_own[i] / whole * 4)}", f"links {round(share * 4)} {page.tag[i]}",
                    *(f"name {w}" for w in NAME.findall(page.names[i])),
                }
                columns += [slot(f) for f in found]
                rows += [base + i] * len(found)
            labels += page.label
        self.parent, self.level, self.kinds = np.array(parent, int), np.array(level, int), np.array(kinds, int)
        self.rows, self.columns, self.labels = np.array(rows, int), np.array(columns, int), np.array(labels, int)
        self.starts = starts
        order = np.argsort(self.level, kind="stable")
        self.levels = np.split(order, np.searchsorted(self.level[order], np.arange(1, int(self.level.max(initial=0)) + 1)))[1:]


class Model:
    def __init__(self):
        self.weights = np.zeros(FEATURES)  # for content
        self.ties = np.zeros((KINDS, 2, 2))  # child's kind, parent's label, child's label

    def marginals(self, forest: Forest) -> tuple[np.ndarray, np.ndarray, float]:
        """P(content) of each node, P(parent's label, child's label) of each node but roots, and log Z."""
        n = len(forest.parent)
        field = np.zeros((n, 2))
        field[:, 1] = np.bincount(forest.rows, self.weights[forest.columns], n)
        ties = self.ties[forest.kinds]
        inward, message = field.copy(), np.zeros((n, 2))
        for nodes in reversed(forest.levels):  # upward: what a child says of its parent's label
            said = ties[nodes] + inward[nodes][:, None, :]
            message[nodes] = np.logaddexp(said[..., 0], said[..., 1])
            np.add.at(inward, forest.parent[nodes], message[nodes])
        belief, pair = inward.copy(), np.zeros((n, 2, 2))
        for nodes in forest.levels:  # downward: what the rest of the tree says of a child's label
            up = belief[forest.parent[nodes]] - message[nodes]
            joint = up[:, :, None] + ties[nodes] + inward[nodes][:, None, :]
            total = np.logaddexp.reduce(joint.reshape(-1, 4), 1)
            pair[nodes] = np.exp(joint - total[:, None, None])
            belief[nodes] = np.logaddexp(joint[:, 0], joint[:, 1])
        top = np.logaddexp(belief[:, 0], belief[:, 1])
        roots = forest.parent < 0
        return np.exp(belief[:, 1] - top), pair, float(top[roots].sum())

    def fit(self, forest: Forest, steps: int = 150, rate: float = 0.1, decay: float = 0.3) -> float:
        """Adam on the exact likelihood; returns the last log-likelihood."""
        y, inner = forest.labels, forest.parent >= 0
        held = np.bincount(forest.columns, y[forest.rows].astype(float), FEATURES)
        tied = np.zeros_like(self.ties)
        np.add.at(tied, (forest.kinds[inner], y[forest.parent[inner]], y[inner]), 1)
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.weights, self.ties)]
        value = 0.0
        for t in range(1, steps + 1):
            p, pair, z = self.marginals(forest)
            expected = np.zeros_like(self.ties)
            np.add.at(expected, forest.kinds[inner], pair[inner])
            value = float(self.weights @ held + (self.ties * tied).sum() - z)
            grads = (
                held - np.bincount(forest.columns, p[forest.rows], FEATURES) - decay * self.weights,
                tied - expected - decay * self.ties,
            )
            for x, g, (m, v) in zip((self.weights, self.ties), grads, state, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return value

    def texts(self, sources: list[str]) -> list[str]:
        pages = [Page(s) for s in sources]
        forest = Forest(pages)
        content = self.marginals(forest)[0] >= KEEP
        return ["\n\n".join(t for i, t, _ in p.blocks if content[s + i]) for p, s in zip(pages, forest.starts, strict=True)]


def labelled_pages(n: int, seed: int = 7) -> list[str]:
    """Pages of many layouts; data-y marks the nodes that are content."""
    rng = random.Random(seed)
    pick = rng.choice
    say = lambda a, b: " ".join("".join(rng.choices("aeinorst", k=rng.randrange(2, 9))) for _ in range(rng.randint(a, b)))
    some = lambda a, b, make: "".join(make() for _ in range(rng.randint(a, b)))
    named = lambda tag, words: f'{tag} {pick(["class", "id"])}="{pick(words)}{pick(["", " box", "-wrap", " block", "1"])}"'
    links = lambda: f"<ul>{some(2, 8, lambda: f'<li><a href=/x>{say(1, 3)}</a></li>')}</ul>"
    plain = lambda: f"<p>{say(3, 60)}</p>"

    def noise() -> str:
        ad = ["ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "sponsor"]
        note = ["cookie", "cookie-notice", "consent", "notice", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe"]
        side = ["sidebar", "side", "widget", "related", "recommended", "popular", "trending"]
        talk = ["comments", "comment", "comment-list", "replies", "discussion", "respond"]
        menu = ["menu", "nav", "navigation", "navbar", "breadcrumb", "breadcrumbs", "pagination", "share", "social", "tags"]
        end = ["footer", "copyright", "legal", "site-footer"]
        top = ["header", "masthead", "topbar", "site-header", "logo"]
        return pick([
            lambda: f"<nav>{links()}</nav>", lambda: f"<header><h1>{say(1, 4)}</h1>{pick(['', links()])}</header>",
            lambda: f"<footer>{pick([plain(), '&copy; ' + say(2, 9), links()])}</footer>",
            lambda: f"<aside>{pick(['', f'<h3>{say(1, 4)}</h3>'])}{pick([plain(), links()])}</aside>",
            lambda: f"<{named('div', ad)}>{pick([say(3, 25), plain(), f'<a href=/x>{say(2, 9)}</a>'])}</div>",
            lambda: f"<{named('div', note)}>{pick([say(4, 25), plain()])}<button>{say(1, 2)}</button></div>",
            lambda: f"<form>{pick(['', f'<label>{say(1, 3)}</label>'])}<input name=q><button>{say(1, 2)}</button>{pick(['', plain()])}</form>",
            lambda: f"<{named('div', side)}><h3>{say(1, 4)}</h3>{pick([links(), plain()])}</div>",
            lambda: f"<{named(pick(['section', 'div']), talk)}><h3>{say(1, 3)}</h3>{some(1, 5, lambda: pick([lambda: f'<div class=comment><p>{say(5, 50)}</p></div>', plain])())}</{'div'}>",
            lambda: f"<ol {pick(['class', 'id'])}=\"{pick(talk)}\">{some(1, 4, lambda: f'<li><p>{say(5, 50)}</p></li>')}</ol>",
            lambda: f"<{named('div', menu)}>{links()}</div>", lambda: f"<{named('div', end)}>{say(3, 20)}</div>",
            lambda: f"<{named('div', top)}>{pick([f'<h1>{say(1, 4)}</h1>', say(1, 5), links()])}</div>",
            lambda: f"<ul {pick(['class', 'id'])}=\"{pick(menu)}\">{some(2, 6, lambda: f'<li><a href=/x>{say(1, 3)}</a></li>')}</ul>",
            lambda: f"<div role={pick(['navigation', 'banner', 'contentinfo', 'complementary', 'search', 'alert', 'dialog'])}>{pick([links(), plain()])}</div>",
            lambda: f"<dialog>{plain()}</dialog>", lambda: f"<button>{say(1, 3)}</button>", lambda: f"<noscript>{say(3, 15)}</noscript>",
            lambda: f"<div>{links()}</div>",
        ])()

    def block() -> str:
        text = lambda: pick([say(1, 90), f"{say(2, 20)} <a href=/y>{say(1, 4)}</a> {say(2, 30)}", f"<b>{say(1, 20)}</b>"])
        return pick([
            *[lambda: f"<p data-y=1>{text()}</p>"] * 6, lambda: f"<p data-y=1><b>{say(3, 30)}<br><p data-y=1>{say(4, 50)}</p>",
            lambda: f"<h{(k := rng.randint(2, 4))} data-y=1>{say(1, 8)}</h{k}>",
            lambda: f"<ul data-y=1>{some(2, 5, lambda: f'<li data-y=1>{text()}</li>')}</ul>",
            lambda: f"<ol data-y=1>{some(2, 5, lambda: f'<li data-y=1>{text()}</li>')}</ol>",
            lambda: f"<blockquote data-y=1><p data-y=1>{text()}</p></blockquote>", lambda: f"<pre data-y=1>{say(3, 20)}</pre>",
            lambda: f"<p data-y=1><a href=/y>{say(3, 30)}</a></p>", lambda: f"<p data-y=1>{say(100, 1200)}</p>", lambda: f"<div data-y=1>{text()}</div>", lambda: f"<div data-y=1><p data-y=1>{text()}</p></div>",
            lambda: f"<section data-y=1><h2 data-y=1>{say(1, 6)}</h2><p data-y=1>{text()}</p></section>",
            lambda: f"<table data-y=1><tr data-y=1>{some(2, 3, lambda: f'<td data-y=1>{say(1, 8)}</td>')}</tr></table>",
            lambda: f"<figure data-y=1><img src=i><figcaption data-y=1>{say(2, 9)}</figcaption></figure>",
        ])()

    def page() -> str:
        body = f"<h1 data-y=1>{say(2, 10)}</h1>" * (rng.random() < 0.8) + some(1, 9, block)
        if rng.random() < 0.25:  # many short paragraphs
            body += some(5, 60, lambda: f"<p data-y=1>{say(1, 4)}</p>")
        if rng.random() < 0.3:
            body = f"{body}{noise()}{some(0, 3, block)}"
        lines = lambda: f"{say(5, 80)}{some(0, 5, lambda: f'<br><br>{say(5, 80)}')}"
        bare = rng.random()
        if bare < 0.35:  # nothing tells where the article is
            if rng.random() < 0.3:
                body = f"<h1 data-y=1>{say(2, 10)}</h1>" * (rng.random() < 0.5) + lines()
            frame = lambda b: pick([b, f"<div data-y=1>{b}</div>", f"<div data-y=1><div data-y=1>{b}</div></div>"])
            if bare < 0.06:  # a table for the layout
                side = f"<td>{pick([links(), noise()])}</td>"
                top = pick(["", f"<tr><td colspan=2>{pick([noise(), links()])}</td></tr>"])
                row = pick([side + f"<td data-y=1>{body}</td>", f"<td data-y=1>{body}</td>" + side])
                return f"<html><body>{pick(['', noise()])}<table>{top}<tr>{row}</tr></table>{some(0, 2, noise)}</body></html>"
            body = frame(body)
            label = "" if body.startswith("<div") else " data-y=1"
            return f"<html><head><title>{say(1, 5)}</title></head><body{label}>{some(0, 4, noise)}{body}{some(0, 4, noise)}</body></html>"
        main = ["content", "post", "entry", "article", "story", "article-body", "main", "text", "post-content", "entry-content", "body"]
        for wrap in range(rng.randint(1, 2)):
            body = pick([
                *[lambda b: f"<article data-y=1>{b}</article>"] * 3, lambda b: f"<main data-y=1>{b}</main>",
                lambda b: f"<{named('div', main)} data-y=1>{b}</div>", lambda b: f"<section data-y=1>{b}</section>",
            ])(body)
        if rng.random() < 0.3:
            body = f"<div {pick(['', 'class=wrapper', 'id=page', 'class=container'])}>{some(0, 2, noise)}{body}{some(0, 2, noise)}</div>"
        return f"<html><head><title>{say(1, 5)}</title></head><body>{some(0, 4, noise)}{body}{some(0, 4, noise)}</body></html>"

    return [page() for _ in range(n)]


@functools.cache
def trained(pages: int = 600, seed: int = 7) -> Model:
    model = Model()
    model.fit(Forest([Page(p) for p in labelled_pages(pages, seed)]))
    return model


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(
    df: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group: int = 64
) -> DataFrame:
    """One row per row of df: id, url, main text and its code points. `group` pages pass messages together."""
    held = df.sparkSession.sparkContext.broadcast(model)
    source = df.select(
        df[id_col].cast("long").alias("id"), F.coalesce(df[html_col], F.lit("")).alias("text"), df[url_col].alias("url")
    )
    fields = common.arrow_schema(df.sparkSession, SCHEMA)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(common.BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(1).to_pylist()
            out = [t for at in range(0, len(bodies), group) for t in held.value.texts(bodies[at : at + group])]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(2), "text": out, "n_chars": [len(t) for t in out]}, schema=fields)

    return source.mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"), trained())
