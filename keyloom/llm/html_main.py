"""HTML extraction: gradient-boosted trees over DOM nodes, and a decoding that follows the tree.

The trees learn from pages that are composed here, by a fixed seed, from many layouts, so which node is article and
which is not is known. A page's nodes are decoded together: a node can be kept only within kept ancestors, and of all
such choices the most likely one is taken.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.boosted_trees import BoostedTrees
from keyloom.llm.common import byte_slices, small_batches, text_of

#: Composed pages that the trees are trained on.
TRAINING_PAGES = 700

# Fixed values of HTML: elements without content, elements whose content is no text, elements that start a new block,
# and what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
HIDDEN = frozenset("head script style noscript template iframe svg math textarea title xmp noembed noframes select option button".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul head".split()
)
CLOSES_P = BLOCK - frozenset("html body head td th tr tbody thead tfoot option optgroup legend summary li dd dt".split()) | frozenset("li dd dt".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:@][-\w:.@]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_BLANK = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "index", "start", "end", "depth")

    def __init__(self, tag: str, attrs: str, parent: Node | None, index: int, start: int):
        self.tag, self.attrs, self.parent, self.index, self.start = tag, attrs, parent, index, start
        self.children: list[Node] = []
        self.depth = parent.depth + 1 if parent else 0
        self.end = start
        if parent:
            parent.children.append(self)


def parse(page: str) -> tuple[list[Node], list[tuple[int, str | None]]]:
    """Block nodes in page order, and pieces (node, text) in page order; a piece without text ends a block.

    Inline elements are not nodes, except that links mark their pieces (node + a fraction kept apart in ``links``).
    Broken markup is read as browsers do in the common cases: unclosed and crossed tags, missing end tags, an end of
    the page anywhere.
    """
    root = Node("html", "", None, 0, 0)
    nodes, pieces, at = [root], [], root
    links: list[bool] = []
    in_link, pos, n = 0, 0, len(page)
    while pos < n:
        m = _TOKEN.search(page, pos)
        stop = m.start() if m else n
        if stop > pos:
            pieces.append((at.index, page[pos:stop]))
            links.append(in_link > 0)
        if not m:
            break
        pos = m.end() if m.end() > m.start() else m.start() + 1
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                in_link = 0
            elif tag == "br":
                pieces.append((at.index, None))
                links.append(False)
            elif tag in BLOCK and tag not in ("html", "body"):
                up = at
                while up is not root and up.tag != tag and not (up.tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot")):
                    up = up.parent
                if up is not root and up.tag == tag:
                    at = up.parent
                    in_link = 0
                pieces.append((at.index, None))
                links.append(False)
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
            if tag in ("title", "textarea") or tag not in BLOCK:
                pos = close.end() if close else n
                continue
        if tag == "a":
            in_link = 1
        if tag in ("br", "hr"):
            pieces.append((at.index, None))
            links.append(False)
        if tag in VOID:
            if tag in ("img", "input"):
                at.attrs += f" \x00{tag}"
            continue
        if tag not in BLOCK and tag not in ("select", "button", "option", "label"):
            continue
        if tag in ("html", "body") and tag in (x.tag for x in nodes[:3]):
            continue
        if tag in CLOSES_P:
            up = at
            while up is not root and up.tag not in ("p", "td", "th", "table", "div", "article", "section", "li", "body"):
                up = up.parent
            if up.tag == "p":
                at = up.parent
        if tag in CLOSES:
            closed, within = CLOSES[tag]
            up = at
            while up is not root and up.tag not in within and up.tag not in closed.split():
                up = up.parent
            if up.tag in closed.split() and up is not root:
                at = up.parent
                if tag == "tr" and at.tag == "tr":
                    at = at.parent
        if re.fullmatch(r"h[1-6]", tag) and re.fullmatch(r"h[1-6]", at.tag):
            at = at.parent
        if tag == "body" and at.tag == "head":
            at = at.parent or root
        at = Node(tag, m[3] or "", at, len(nodes), m.start())
        nodes.append(at)
        pieces.append((at.index, None))
        links.append(False)
    return nodes, [(i, t, k) for (i, t), k in zip(pieces, links, strict=True)]


# Words in class, id and role attributes, by what they hint at.
HINTS = {
    "menu": "nav menu menubar navbar breadcrumb breadcrumbs toc tabs pagination pager skip",
    "head": "header masthead topbar banner logo branding hero",
    "foot": "footer foot colophon copyright legal bottom",
    "side": "sidebar aside side rail widget widgets complementary column secondary",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promoted promotion banner adbox dfp outbrain taboola partner",
    "notice": "cookie cookies consent notice gdpr privacy alert popup modal overlay dialog warning message disclaimer",
    "comment": "comment comments reply replies discussion disqus respond reviews review",
    "share": "share social sharing follow like tweet facebook twitter tools toolbar",
    "related": "related recommended more popular trending also next prev latest readmore recirc teaser",
    "form": "form login signup subscribe newsletter search subscription register contact",
    "article": "article content main post entry body story text page prose blog articlebody contentinfo copy",
}
_HINT_OF = {w: k for k, name in enumerate(HINTS) for w in HINTS[name].split()}
N_HINTS = len(HINTS)
TAGS = ("html body", "div", "article main", "section", "p", "h1 h2", "h3 h4 h5 h6", "ul ol menu dl dir", "li dt dd", "nav", "header hgroup", "footer", "aside", "form fieldset select label button option legend dialog details", "table tbody thead tfoot tr td th", "blockquote pre figure figcaption", "head")
_TAG_OF = {t: k for k, group in enumerate(TAGS) for t in group.split()}
N_FEATURES = 4 * len(TAGS) + 2 * N_HINTS + 26


@lru_cache(maxsize=4096)
def _hints(attrs: str) -> tuple[int, ...]:
    found = set()
    for name, value in _ATTRIBUTE.findall(attrs):
        if name.lower() in ("class", "id", "role", "itemprop", "aria-label", "data-type"):
            spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
            found |= {_HINT_OF[w] for w in re.findall(r"[a-z]+", spaced) if w in _HINT_OF}
    return tuple(sorted(found))


def features(nodes: list[Node], pieces: list[tuple[int, str | None, bool]]) -> np.ndarray:
    """A row per node: tags and hints of the node and above, subtree densities, depth, place and sibling statistics."""
    n = len(nodes)
    own = np.zeros((n, 6))  # characters, linked characters, words, stops, pieces, line breaks
    for i, t, link in pieces:
        row = own[i]
        if t is None:
            row[5] += 1
            continue
        size = len(t) - t.count(" ") if len(t) < 20 else len(t)
        if t.isspace():
            continue
        row[0] += size
        row[1] += size * link
        row[2] += t.count(" ") + 1
        row[3] += t.count(".") + t.count(",")
        row[4] += 1
    parent = np.array([x.parent.index if x.parent else -1 for x in nodes])
    tag = np.array([_TAG_OF.get(x.tag, 1) for x in nodes])
    counts = np.zeros((n, 4))  # below: nodes, paragraphs, list items, inputs and images
    counts[:, 0] = 1
    counts[:, 1], counts[:, 2] = tag == 4, tag == 8
    counts[:, 3] = [x.attrs.count("\x00") + (x.tag in ("select", "button", "label")) for x in nodes]
    total = own.copy()
    hints = np.zeros((n, N_HINTS))
    for i, x in enumerate(nodes):
        if x.attrs:
            hints[i, list(_hints(x.attrs.split("\x00")[0]))] = 1
    for i in range(n - 1, 0, -1):
        total[parent[i]] += total[i]
        counts[parent[i]] += counts[i]
    above, tags_above = np.zeros((n, N_HINTS)), np.zeros((n, len(TAGS)))
    for i in range(1, n):
        p = parent[i]
        above[i] = np.maximum(above[p], hints[p])
        tags_above[i] = tags_above[p]
        tags_above[i, tag[p]] = 1
    siblings = np.array([len(x.parent.children) if x.parent else 1 for x in nodes])
    place = np.zeros(n)
    for x in nodes:
        for k, c in enumerate(x.children):
            place[c.index] = k
    up = np.maximum(parent, 0)
    beside = (total[up] - total) / np.maximum(siblings - 1, 1)[:, None]
    page = np.maximum(total[0], 1)
    before = np.cumsum(own[:, 0]) - own[:, 0]
    eye = np.eye(len(TAGS))
    tag_below = np.zeros((n, len(TAGS)))
    for i in range(n - 1, 0, -1):
        tag_below[parent[i]] = np.maximum(tag_below[parent[i]], tag_below[i])
        tag_below[parent[i], tag[i]] = 1
    rest = [
        np.log1p(total[:, 0]), np.log1p(total[:, 2]), total[:, 1] / np.maximum(total[:, 0], 1), total[:, 3] / np.maximum(total[:, 2], 1), total[:, 0] / counts[:, 0],
        total[:, 0] / page[0], total[:, 2] / np.maximum(total[:, 4], 1), np.log1p(own[:, 0]), own[:, 1] / np.maximum(own[:, 0], 1), own[:, 2],
        counts[:, 0], counts[:, 1], counts[:, 2], counts[:, 3], counts[:, 1] / counts[:, 0], counts[:, 2] / counts[:, 0],
        np.array([x.depth for x in nodes]), siblings, place, place / siblings, np.log1p(beside[:, 0]), beside[:, 1] / np.maximum(beside[:, 0], 1),
        total[:, 0] / np.maximum(total[up, 0], 1), before / page[0], counts[up, 1] / counts[up, 0], np.log1p(total[up, 0]),
    ]
    return np.column_stack([eye[tag], eye[tag[up]], tags_above, tag_below, hints, above, *rest])


def decode(nodes: list[Node], margin: np.ndarray) -> np.ndarray:
    """Which nodes are kept in the likeliest choice in which no node is kept below one that is not."""
    n = len(nodes)
    yes, no = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
    drop, keep = no.copy(), yes.copy()
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent.index
        drop[p] += drop[i]
        keep[p] += max(drop[i], keep[i])
    kept = np.zeros(n, bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[nodes[i].parent.index] and keep[i] >= drop[i]
    return kept


def text_of_kept(nodes: list[Node], pieces: list[tuple[int, str | None, bool]], kept: np.ndarray) -> str:
    blocks, now = [], []
    last = -1
    for i, t, _ in [*pieces, (-2, None, False)]:
        if t is None or i != last:
            if now:
                block = _BLANK.sub(" ", html.unescape("".join(now))).strip()
                if block:
                    blocks.append(block)
                now = []
            last = i
        if t is not None and kept[i] and nodes[i].tag not in HIDDEN:
            now.append(t)
    return "\n".join(blocks)


# ---- composed training pages ----------------------------------------------------------------------------------------


def _words(rng: random.Random, n: int, stop: bool = True) -> str:
    out = []
    for k in range(n):
        w = "".join(rng.choice("etaoinshrdlucmfwypvbgk") for _ in range(rng.choice((2, 3, 4, 5, 7, 9))))
        out.append(w.capitalize() if k == 0 else w + (rng.choice((",", ".")) if stop and rng.random() < 0.12 else ""))
    return " ".join(out) + ("." if stop else "")


def compose(seed: int) -> tuple[str, str]:
    """A page and the same page with its article's block tags marked by the attribute data-main."""
    rng = random.Random(seed)
    mark = " data-main"

    def attrs(kind: str, p: float = 0.75) -> str:
        if rng.random() > p:
            return rng.choice(("", "", f' class="c{rng.randrange(99)}"', f' id="b{rng.randrange(99)}"'))
        words = HINTS[kind].split()
        value = rng.choice(words)
        if rng.random() < 0.4:
            value += rng.choice(("-", " ", "_")) + rng.choice(("box", "wrap", "inner", "area", "list", "x1", "block"))
        return rng.choice((' class="{}"', " class='{}'", ' id="{}"')).format(value)

    def link() -> str:
        return f'<a href="/{rng.randrange(999)}">{_words(rng, rng.choice((1, 1, 2, 3)), False)}</a>'

    def links(n: int) -> str:
        style = rng.randrange(3)
        if style == 0:
            return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>"
        if style == 1:
            return rng.choice((" | ", " ", " &middot; ")).join(link() for _ in range(n))
        return "<ul>" + "".join(f"<li>{link()}" for _ in range(n)) + "</ul>"

    def small(n_low: int, n_high: int) -> str:
        text = _words(rng, rng.randint(n_low, n_high))
        return rng.choice((text, f"<p>{text}</p>", f"<p>{text}", f"<span>{text}</span>"))

    def other(kind: str) -> str:
        if kind == "menu":
            tag = rng.choice(("nav", "nav", "div", "ul"))
            return f"<nav{attrs(kind)}>{links(rng.randint(3, 9))}</nav>" if tag == "nav" else f"<div{attrs(kind, 0.9)}>{links(rng.randint(3, 9))}</div>"
        if kind == "head":
            inner = rng.choice((f"<h1>{_words(rng, 2, False)}</h1>", f"<h2>{_words(rng, 3, False)}</h2>", small(2, 6))) + (links(rng.randint(3, 6)) if rng.random() < 0.6 else "") + (small(3, 12) if rng.random() < 0.4 else "")
            return f"<header{attrs(kind)}>{inner}</header>" if rng.random() < 0.7 else f"<div{attrs(kind, 0.95)}>{inner}</div>"
        if kind == "foot":
            inner = f"&copy; {rng.randint(1999, 2030)} {_words(rng, rng.randint(1, 30))}" + (links(rng.randint(2, 6)) if rng.random() < 0.5 else "") + (small(5, 40) if rng.random() < 0.5 else "")
            return f"<footer{attrs(kind)}>{inner}</footer>" if rng.random() < 0.75 else f"<div{attrs(kind, 0.95)}>{inner}</div>"
        if kind == "side":
            inner = "".join(f"<h3>{_words(rng, 2, False)}</h3>{rng.choice((links(rng.randint(2, 7)), small(5, 50)))}" for _ in range(rng.randint(1, 3)))
            return f"<aside{attrs(kind)}>{inner}</aside>" if rng.random() < 0.65 else f"<div{attrs(kind, 0.95)}>{inner}</div>"
        if kind == "form":
            return f"<form{attrs(kind, 0.5)}><label>{_words(rng, 2, False)}</label><input name=q><button>{_words(rng, 1, False)}</button>{small(3, 12) if rng.random() < 0.5 else ''}</form>"
        if kind == "comment":
            one = lambda: f"<{rng.choice(('div', 'li', 'article'))}{attrs(kind, 0.7)}>" + rng.choice((f"<p>{_words(rng, rng.randint(4, 60))}</p>", _words(rng, rng.randint(4, 60))))
            body = "".join((o := one()) + f"</{o[1 : o.index('>')].split()[0]}>" for _ in range(rng.randint(1, 5)))
            tag = rng.choice(("section", "div", "div", "ol"))
            return f"<{tag}{attrs(kind, 1)}>{'<h3>' + _words(rng, 2, False) + '</h3>' if rng.random() < 0.6 else ''}{body}</{tag}>"
        if kind in ("share", "related"):
            tag = rng.choice(("div", "section", "ul"))
            return f"<{tag}{attrs(kind, 0.95)}>{'<h3>' + _words(rng, 2, False) + '</h3>' if rng.random() < 0.4 else ''}{links(rng.randint(2, 6))}</{tag}>"
        tag = rng.choice(("div", "div", "section", "p", "aside"))  # adverts and notices
        inner = _words(rng, rng.randint(3, 40)) if tag == "p" or rng.random() < 0.6 else small(4, 40)
        return f"<{tag}{attrs(kind, 1)}>{inner}{link() if rng.random() < 0.4 else ''}{'<button>' + _words(rng, 1, False) + '</button>' if kind == 'notice' and rng.random() < 0.4 else ''}</{tag}>"

    def paragraph() -> str:
        n = rng.choice((1, 2, 4, 8, 20, 40, 60, 90, 140))
        words = _words(rng, n)
        if rng.random() < 0.25 and n > 8:
            cut = words.split(" ")
            cut.insert(rng.randrange(len(cut)), rng.choice((link(), "<b>" + _words(rng, 2, False) + "</b>", "<br>", "&amp;", "<em>so</em>")))
            words = " ".join(cut)
        kind = rng.random()
        if kind < 0.75:
            return f"<p{mark}>{words}" + ("</p>" if rng.random() < 0.85 else "")
        if kind < 0.8:
            return f"<p{mark}><b>{words}<br>"
        if kind < 0.85:
            return f"<h{(h := rng.choice((2, 3)))}{mark}>{_words(rng, rng.randint(1, 6), False)}</h{h}>"
        if kind < 0.9:
            return f"<ul{mark}>" + "".join(f"<li{mark}>{_words(rng, rng.randint(2, 15))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.93:
            return f"<blockquote{mark}>{words}</blockquote>"
        if kind < 0.95:
            return f"<table{mark}><tr{mark}>" + "".join(f"<td{mark}>{_words(rng, 2, False)}</td>" for _ in range(3)) + "</tr></table>"
        return f"<div{mark}>{words}</div>"

    body = [paragraph() for _ in range(rng.choice((1, 2, 3, 5, 8, 14)))]
    for kind in ("advert", "share", "related", "notice", "form", "comment"):  # within the article's element
        if rng.random() < (0.3 if kind == "advert" else 0.12):
            body.insert(rng.randint(0, len(body)) if kind == "advert" else len(body), other(kind))
    title = f"<h1{mark}>{_words(rng, rng.randint(2, 10), False)}</h1>" if rng.random() < 0.8 else ""
    tag = rng.choice(("article", "article", "article", "main", "div", "div", "section", "td"))
    inside = title + "".join(body)
    if tag == "td":
        article = f"<table{mark}><tr{mark}><td{attrs('menu', 0.3)}>{links(4)}</td><td{mark}>{inside}</td></tr></table>"
    else:
        article = f"<{tag}{mark}{attrs('article', 0.5 if tag == 'article' else 0.85)}>{inside}</{tag}>"
    if rng.random() < 0.3:
        article = f"<div{mark}{attrs('article', 0.3)}>{article}</div>"
    front = [k for k in ("notice", "head", "menu", "advert", "form", "share") if rng.random() < (0.75 if k in ("head", "menu") else 0.45 if k == "advert" else 0.2)]
    back = [k for k in ("share", "advert", "related", "comment", "side", "form", "foot", "notice") if rng.random() < (0.85 if k == "foot" else 0.3)]
    if rng.random() < 0.3:
        rng.shuffle(front)
    if rng.random() < 0.2 and "side" not in back:
        front.append("side")
    inner = "".join(other(k) for k in front) + article + "".join(other(k) for k in back)
    if rng.random() < 0.3:
        inner = f"<div{mark}{rng.choice(('', ' id=wrapper', ' class=container'))}>{inner}</div>"
    page = f"<!DOCTYPE html><html{mark}><head><title>{_words(rng, 3, False)}</title><style>p{{margin:0}}</style><script>var a='<p>';</script></head><body{mark}>{inner}"
    page += "</body></html>" if rng.random() < 0.8 else ""
    return page.replace(mark, ""), page


def train(pages: int = TRAINING_PAGES) -> BoostedTrees:
    rows, wanted = [], []
    for seed in range(pages):
        plain, marked = compose(seed)
        nodes, pieces = parse(plain)
        known = [x.index == 0 or "data-main" in x.attrs for x in parse(marked)[0]]
        if len(known) == len(nodes):
            rows.append(features(nodes, pieces))
            wanted.append(known)
    return BoostedTrees().fit(np.concatenate(rows), np.concatenate(wanted).astype(float))


@lru_cache(maxsize=1)
def trained() -> BoostedTrees:
    return train()


def extract_all(pages: list[str], model: BoostedTrees) -> list[str]:
    parsed = [parse(p) for p in pages]
    rows = [features(*p) for p in parsed]
    if not rows:
        return []
    margin = model.margin(np.concatenate(rows))
    out, at = [], 0
    for nodes, pieces in parsed:
        out.append(text_of_kept(nodes, pieces, decode(nodes, margin[at : at + len(nodes)])))
        at += len(nodes)
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row: the article's blocks, one per line.

    A null or empty page has the empty text; repeated rows give equal rows; no other column is read. The model (some
    tens of kilobytes) is a broadcast.
    """
    spark = pages.sparkSession
    small_batches(spark, 500)
    model = spark.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_slices(whole, "html", 1 << 20):
                texts = extract_all(b.column("html").to_pylist(), model.value)
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    return read.mapInArrow(run, "page_id long, url string, text string, n_chars long")
