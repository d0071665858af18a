"""Main text of web pages by sum-product inference on the DOM tree.

Every block element is a variable with three states: content, boilerplate, or the frame
that holds both. Its evidence is what can be seen of it alone: tag, words of class, id and role, amount of own text, share of links, sentence
endings. A parent and a child share a potential. Messages go from the leaves to the root
and back, and a block of text is kept where its element's marginal for content is over a half.
All tables are counted on labelled pages (``training_pages``), with smoothing.

A null or empty page, or one without content, gives an empty text. Unclosed and unknown
tags, stray ends and pages cut off in the middle are read as far as they go. Pages of any
length are read whole, in time linear in their length. Rows that repeat are handled alike,
an empty table gives no rows, and a marginal of exactly a half is no content. Input columns
may have any names; those named like the output columns are replaced.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import inner, spread

# How HTML's elements behave.
# RAW elements are left out up to their end tag. TO_END ones without an end tag reach to the
# end of the page; of others without one only the tag is left out.
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "object", "title", "select")
TO_END = frozenset({"script", "style", "textarea"})
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img br picture source input link meta base area col embed param track".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends an open element of the second set, up to one of the third.
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

_QUOTED = r"""(?:"[^"]*"|'[^']*'|[^'">])*"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<end>/)?(?P<tag>[a-z][^\s/>]*)(?P<rest>{_QUOTED})>|<[!?/][^>]*(?:>|\Z)|<[a-z][^>]*\Z", re.I | re.S)
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")


#: Elements nested deeper are read as neighbours at this depth, as browsers do.
MAX_DEPTH = 512

REPEATED = frozenset({"li", "dt", "dd", "tr", "td"})
#: Share of training articles that end in a list of links.
REFERENCES = 0.0

#: Frame, content, boilerplate.
STATES = (0, 1, 2)


class Node:
    __slots__ = ("tag", "names", "parent", "own", "linked", "blocks", "ended", "truth")

    def __init__(self, tag: str, names: tuple[str, ...], parent: int, truth: int):
        self.tag, self.names, self.parent, self.truth = tag, names, parent, truth
        self.own = self.linked = self.blocks = self.ended = 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements in page order, each after its parent, and (element, text) blocks."""
    nodes, blocks = [Node("#root", (), -1, 0)], []
    stack, text, links, n_linked = [0], [], 0, 0
    opened: Counter = Counter()  # elements of a tag on the stack, so that no end searches it in vain

    def flush() -> None:
        nonlocal n_linked
        joined = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if joined:
            node = nodes[stack[-1]]
            node.own += len(joined)
            node.linked += min(n_linked, len(joined))
            node.blocks += 1
            node.ended += joined[-1] in ".!?…:;\"'”»)"
            blocks.append((stack[-1], joined))
        n_linked = 0

    def close_to(depth: int) -> None:
        flush()
        opened.subtract(nodes[i].tag for i in stack[depth:])
        del stack[depth:]

    at, unended = 0, set()
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if links:
                n_linked += len(piece)
        at = m.end()
        if not (tag := m["tag"]):
            continue
        tag = tag.lower()
        if tag in RAW and not m["end"]:
            if tag in ("select", "textarea"):
                text.append(" ")
            if tag in ("svg", "math") and m["rest"].endswith("/"):
                continue
            if tag not in unended and (end := _ENDS[tag].search(page, at)):
                at = end.end()
            elif tag in TO_END:
                at = len(page)
            else:
                unended.add(tag)
            continue
        if tag == "head":  # what belongs there is RAW or void; anything else begins the body
            flush()
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if m["end"] else 1
            elif tag == "br":
                text.append(" ")
            continue
        if m["end"]:
            if opened[tag] > 0:
                close_to(next(i for i in range(len(stack) - 1, 0, -1) if nodes[stack[i]].tag == tag))
            else:
                flush()
            continue
        flush()
        links = 0
        if tag in ENDS_P and nodes[stack[-1]].tag == "p":
            close_to(len(stack) - 1)
        if tag in CLOSES and any(opened[t] > 0 for t in CLOSES[tag][0]):
            ends, within = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].tag in within:
                    break
                if nodes[stack[i]].tag in ends:
                    close_to(i)
        if tag in VOID:
            continue
        names = tuple(w for x in _NAMES.findall(m["rest"]) for w in _SPLIT.split("".join(x).lower()) if w) if m["rest"] else ()
        if len(stack) > MAX_DEPTH:
            close_to(MAX_DEPTH)
        nodes.append(Node(tag, names, stack[-1], 1 if "data-content=1" in m["rest"] else 2 if "data-content=0" in m["rest"] else 0))
        stack.append(len(nodes) - 1)
        opened[tag] += 1
    if at < len(page):
        text.append(page[at:])
    flush()
    return nodes, blocks


def _evidence(nodes: list[Node]) -> list[list[tuple[str, object]]]:
    """What is seen of every element alone, with the text and links below it."""
    total, linked = [n.own for n in nodes], [n.linked for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        total[nodes[i].parent] += total[i]
        linked[nodes[i].parent] += linked[i]
    out = []
    for n, t, k in zip(nodes, total, linked):
        seen: list[tuple[str, object]] = [("tag", n.tag), ("own", min(4, n.own.bit_length() // 2) if n.own else -1)]
        if t:
            seen.append(("links", min(3, 4 * k // t)))
        if n.blocks:
            seen.append(("ended", n.ended * 2 >= n.blocks))
        seen += (("name", w) for w in dict.fromkeys(n.names))
        out.append(seen)
    return out


class Model:
    """Log potentials of an element and of a parent with its child."""

    def __init__(self, pages: list[str]):
        seen: dict[int, Counter] = {y: Counter() for y in STATES}
        kinds: dict[str, set] = defaultdict(set)
        pairs = Counter({(a, b): 1 for a in STATES for b in STATES})
        for page in pages:
            nodes, _ = parse(page)
            label = [0] * len(nodes)
            for i, (node, found) in enumerate(zip(nodes, _evidence(nodes))):
                if i:
                    label[i] = node.truth or label[node.parent]
                    pairs[label[node.parent], label[i]] += 1
                for what in found:
                    seen[label[i]][what] += 1
                    kinds[what[0]].add(what[1])
        totals = {(y, k): sum(c for w, c in seen[y].items() if w[0] == k) for y in STATES for k in kinds}

        def log_p(y: int, what: tuple) -> float:
            few = 0.05 if what[0] == "name" else 0.5
            return math.log((seen[y][what] + few) / (totals[y, what[0]] + few * (len(kinds[what[0]]) + 1)))

        def weight(y: int, what: tuple) -> float:
            # evidence of one element is not independent, so all but names count for less
            return max(-7.0, log_p(y, what) - max(log_p(z, what) for z in STATES)) * (1.0 if what[0] == "name" else 0.6)

        # evidence that was never seen says nothing
        self.weight = {w: tuple(weight(y, w) for y in STATES) for z in STATES for w in seen[z]}
        self.follow = tuple(tuple(pairs[a, b] / sum(pairs[a, z] for z in STATES) for b in STATES) for a in STATES)

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of every element, by messages up and down the tree."""
        (f00, f01, f02), (f10, f11, f12), (f20, f21, f22) = self.follow
        up, sent = [], []  # evidence and messages of the children so far; message to the parent
        alike = Counter((n.parent, n.tag) for n in nodes if n.tag in REPEATED)
        for n, found in zip(nodes, _evidence(nodes)):
            logs = [self.weight[w] for w in found if w in self.weight]
            # the items of a list look alike for one reason, so together they count once
            share = alike.get((n.parent, n.tag), 1)
            sums = [sum(x) / share for x in zip(*logs)] if logs else [0.0, 0.0, 0.0]
            top = max(sums)
            up.append([math.exp(x - top) + 1e-12 for x in sums])
            sent.append((1.0, 1.0, 1.0))
        for i in range(len(nodes) - 1, 0, -1):
            a, b, c = up[i]
            m = (f00 * a + f01 * b + f02 * c, f10 * a + f11 * b + f12 * c, f20 * a + f21 * b + f22 * c)
            t = sum(m)
            sent[i] = m = (m[0] / t, m[1] / t, m[2] / t)
            p = up[nodes[i].parent]
            p[0] *= m[0]
            p[1] *= m[1]
            p[2] *= m[2]
            t = sum(p)
            p[0], p[1], p[2] = p[0] / t + 1e-12, p[1] / t + 1e-12, p[2] / t + 1e-12
        belief = [(1.0, 0.0, 0.0)] * len(nodes)  # the root is the frame
        for i in range(1, len(nodes)):
            # what the parent knows without this child
            x, y, z = (q / m for q, m in zip(belief[nodes[i].parent], sent[i]))
            a, b, c = up[i]
            a, b, c = a * (x * f00 + y * f10 + z * f20), b * (x * f01 + y * f11 + z * f21), c * (x * f02 + y * f12 + z * f22)
            t = a + b + c
            belief[i] = (a / t, b / t, c / t)
        return [b[1] for b in belief]

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        nodes, blocks = parse(page)
        if not blocks:
            return ""
        keep = self.marginals(nodes)
        return "\n\n".join(t for i, t in blocks if keep[i] > 0.5)


def training_pages(n: int = 1500, seed: int = 11) -> list[str]:
    """Labelled pages of many layouts; ``data-content`` marks an element and what is below
    it, up to another mark. Texts are drawn letters, so that only structure teaches."""
    rng = random.Random(seed)
    pick, chance = rng.choice, rng.random

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(1, 9))) for _ in range(rng.randint(low, high)))

    def sentences(low: int, high: int) -> str:
        return " ".join(words(2, 16).capitalize() + pick(("." if chance() < 0.9 else "", ".", "!", "?")) for _ in range(rng.randint(low, high)))

    def links(low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(rng.randint(low, high))) + "</ul>"

    def named(*names: str) -> str:
        return "" if chance() < 0.1 else f' {pick(("class", "id"))}="{pick(names)}"'

    def linked(share: float) -> str:
        """Sentences some of whose words are links."""
        return " ".join(f'<a href="/{w}">{w}</a>' if chance() < share else w for w in (words(1, 6) for _ in range(rng.randint(2, 12)))) + pick((".", ".", "!", ""))

    def references() -> str:
        kind = pick(("ul", "ol"))
        items = (pick((f'<a href="/{i}">{words(2, 9)}</a>', f'{words(1, 4)} <a href="/{i}">{words(2, 7)}</a>.', f'<a href="/{i}">{words(2, 7)}</a> {words(1, 6)}')) for i in range(rng.randint(1, 8)))
        return (f"<h2>{words(1, 2)}</h2>" if chance() < 0.6 else "") + f"<{kind}>" + "".join(f"<li>{x}</li>" for x in items) + f"</{kind}>"

    def paragraph() -> str:
        if link_rich and chance() < link_rich:
            return pick((lambda: f"<p>{linked(rng.random())}</p>", lambda: f"<p>{linked(0.4)} {sentences(1, 3)}", lambda: f'<p><a href="/x">{words(2, 12)}</a></p>', references))()
        kind = chance()
        if kind < 0.72:
            return f"<p{named('text', 'lead', '', '') if chance() < 0.1 else ''}>{sentences(1, 9) if chance() < 0.85 else words(1, 3) + pick(('.', ''))}" + ("</p>" if chance() < 0.8 else "")
        if kind < 0.78:
            return f"<p><b>{sentences(1, 3)}<br>"
        if kind < 0.84:
            return f"<{(h := pick(('h2', 'h3', 'h4')))}>{words(2, 7)}</{h}>"
        if kind < 0.88:
            return f"<blockquote>{pick(('<p>' + sentences(1, 3) + '</p>', sentences(1, 3)))}</blockquote>"
        if kind < 0.92:
            return "<ul>" + "".join(f"<li>{sentences(1, 1)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.94:
            return "<pre>" + words(5, 30) + "</pre>"
        if kind < 0.97:
            return f"<figure><figcaption>{sentences(1, 1)}</figcaption></figure>"
        return "<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 4)}</td></tr>" for _ in range(3)) + "</table>"

    def notice() -> str:
        tag = pick(("div", "div", "section", "aside"))
        return f"<{tag}{named('cookie-banner', 'cookie-notice', 'consent', 'gdpr', 'notice', 'alert', 'popup', 'modal', 'overlay')} data-content=0><p>{sentences(1, 3)}</p>{pick(('<button>' + words(1, 1) + '</button>', ''))}</{tag}>"

    def advert() -> str:
        tag = pick(("div", "div", "div", "aside", "section"))
        inner = pick((sentences(1, 2), f"<p>{sentences(1, 2)}</p>", f'<a href="/x">{words(2, 6)}</a>'))
        return f"<{tag}{named('ad', 'ad', 'ads', 'advert', 'advertisement', 'ad-slot', 'banner', 'promo', 'sponsored', 'sponsor')} data-content=0>{inner}</{tag}>"

    def form() -> str:
        return f"<form{named('newsletter', 'subscribe', 'search', 'login', 'signup', 'contact')} data-content=0><p>{words(2, 9)}</p><label>{words(1, 2)}</label><input><button>{words(1, 2)}</button></form>"

    def menu() -> str:
        tag = pick(("nav", "nav", "nav", "div", "ul"))
        return f"<{tag}{named('nav', 'menu', 'navbar', 'navigation', 'breadcrumb', 'breadcrumbs', 'topbar', 'pagination', 'toc') if tag != 'nav' or chance() < 0.4 else ''} data-content=0>{links(3, 9)}</{tag}>"

    def sidebar() -> str:
        tag = pick(("aside", "div", "section"))
        return f"<{tag}{named('sidebar', 'side', 'related', 'widget', 'recommended', 'trending', 'popular', 'share', 'social', 'author', 'tags')} data-content=0><h3>{words(1, 3)}</h3>{pick((links(2, 6), '<p>' + sentences(1, 2) + '</p>', links(1, 3) + '<p>' + words(2, 8) + '</p>'))}</{tag}>"

    def comments() -> str:
        tag, one = pick(("div", "section", "div")), pick(("div", "li", "article"))
        many = "".join(f"<{one}{named('comment', 'reply', 'comment-body', 'response')}><p>{sentences(1, 4)}</p></{one}>" for _ in range(rng.randint(1, 5)))
        return f"<{tag}{named('comments', 'comments', 'comment-list', 'discussion', 'disqus', 'responses', 'replies')} data-content=0><h2>{words(1, 2)}</h2>{many}{form() if chance() < 0.3 else ''}</{tag}>"

    def head() -> str:
        tag = pick(("header", "header", "div"))
        return f"<{tag}{named('header', 'masthead', 'top', 'site-header', 'logo', 'brand')} data-content=0>{pick(('<h1>' + words(1, 3) + '</h1>', '<p>' + words(1, 6) + '</p>', words(1, 4)))}{menu() if chance() < 0.5 else ''}</{tag}>"

    def foot() -> str:
        tag = pick(("footer", "footer", "footer", "div"))
        return f"<{tag}{named('footer', 'site-footer', 'copyright', 'legal', 'bottom') if tag == 'div' or chance() < 0.3 else ''} data-content=0>{pick(('&copy; ' + sentences(1, 1), '<p>' + sentences(1, 2) + '</p>', links(2, 5) + '<p>' + words(2, 6) + '</p>'))}</{tag}>"

    def article() -> str:
        body = [f"<h1>{words(2, 10)}</h1>" if chance() < 0.85 else ""]
        if chance() < 0.15:
            body = [f"<header><h1>{words(2, 9)}</h1></header>"]
        for _ in range(pick((0, 1, 2, 3, 4, 6, 9, 14)) + (not body[0])):
            body.append(paragraph())
            if chance() < 0.05:
                body.append(pick((advert, sidebar, form))())
        if chance() < REFERENCES:
            body.append(references())
        if chance() < 0.08:  # no element of its own
            return "".join(x if "data-content" in x.partition(">")[0] else re.sub(r"^<(\w+)", r"<\1 data-content=1", x) for x in body)
        inner = "".join(body) + (comments() if chance() < 0.1 else "")
        kind = chance()
        if kind < 0.55:
            return f"<article{named('post', 'article', 'entry', 'story') if chance() < 0.3 else ''} data-content=1>{inner}</article>"
        if kind < 0.7:
            return f"<main data-content=1>{inner}</main>"
        return f'<{(t := pick(("div", "div", "section")))} {pick(("class", "id"))}="{pick(("content", "main", "article", "post", "entry-content", "article-body", "post-content", "story", "main-content", "text", "body-text"))}" data-content=1>{inner}</{t}>'

    pages = []
    for _ in range(n):
        # every second page has articles with links, up to nearly every paragraph of one
        link_rich = pick((0.0, 0.0, 0.0, 0.15, 0.35, 0.7))
        before = [f() for f, p in ((head, 0.45), (menu, 0.7), (notice, 0.3), (advert, 0.5), (sidebar, 0.15), (form, 0.1)) if chance() < p]
        after = [f() for f, p in ((sidebar, 0.3), (comments, 0.35), (advert, 0.2), (form, 0.2), (notice, 0.15), (foot, 0.85)) if chance() < p]
        rng.shuffle(before)
        main, wrap = article(), pick(("", "", "", "container", "wrapper", "page", "layout"))
        middle = "".join(before) + main + "".join(after)
        page = f'<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body>{f"<div class={wrap}>{middle}</div>" if wrap else middle}</body></html>'
        pages.append(page if chance() < 0.9 else page[: int(len(page) * rng.uniform(0.8, 1.0))])
    return pages


@lru_cache(maxsize=1)
def trained() -> Model:
    return Model(training_pages())


def _extract_map(at: int, model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.text(x.as_py()) for x in batch.column(at)]
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            names = [c for i, c in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return run


def extract(pages: DataFrame, model: Model | None = None, html_column: str = "html") -> DataFrame:
    """The columns of ``pages`` with the html replaced by ``text`` and ``n_chars``."""
    rows, column = inner(pages.drop(*(c for c in ("text", "n_chars") if c != html_column)))
    names = [c for c in pages.columns if c.lower() not in ("text", "n_chars", html_column.lower())]
    page = column[html_column]
    shape = StructType([*(f for f in rows.schema.fields if f.name != page), StructField("text", StringType()), StructField("n_chars", LongType())])
    source = spread(rows.withColumn(page, F.col(page).cast("string")))
    return source.mapInArrow(_extract_map(rows.columns.index(page), model or trained()), shape).toDF(*names, "text", "n_chars")
