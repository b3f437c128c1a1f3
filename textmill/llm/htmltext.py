"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read as a sequence of text blocks with their open elements. A logistic classifier gives each block a cost for
either label: its log-odds, from the text (length, links, stops, digits, capitals), the holding element, and what the
enclosing elements and their names say: of elements inside an article what they say by themselves, as an aside, a form or comments in it
are no part of it, and apart from that what stands around it. These costs are terminal capacities. Page neighbours, weighted by their distance in the element
tree, and blocks of one parent are joined by smoothness edges; their capacities follow from how often such blocks
share a label. The minimum cut separates content from boilerplate, so edges can turn a block that the classifier is
unsure of. Blocks whose terminals outweigh all their edges are folded into their neighbours first, which is exact; the
rest goes through augmenting paths.

Classifier and capacities are fitted here: on invented pages, whose labels are known, and on blocks of a bounded sample of
pages (``SAMPLE`` pages by hash of the key, of each at most ``SAMPLE_CHARS`` code points, read by the driver) that lie in semantic elements; each block counts twice,
once with the names of elements hidden, so that texts teach as much as names. Where elements say all, as on the given pages, the result is the classifier's and the edges
turn nothing; they matter where names are missing.

Defined results: null and empty pages, and pages without content, have an empty text; an open comment, script or style runs to the end
of the page; elements that are hidden (the attribute hidden, or a style without display) are no text at all; equal pages have equal texts; ties are boilerplate; columns of the input that are not kept don't matter, kept ones whose
names clash with an output column give way to it; an empty table trains on invented pages alone and gives no rows.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textmill.llm.shared import map_text, sample_texts

SAMPLE = 400
SAMPLE_CHARS = 1 << 16
#: Element and class names by role.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("hr".split())
INLINE_VOID = frozenset("area base br col embed img input link meta param source track wbr".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("article aside body div footer form header html li main nav ol section table td th ul blockquote dl".split())
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
CONTENT_TAGS = frozenset(("article", "main"))
BOILER_TAGS = frozenset(("nav", "footer", "aside", "form", "menu", "dialog", "head", "title", "fieldset"))
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus dropdown footer gdpr hidden masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination popup promo promoted recommended related replies respond share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split()
)
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object|textarea|select|button)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>|([^<]++|<)", re.S | re.I,
)
NAMES = re.compile(r"class|id|role|style|hidden", re.I)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORDS = re.compile(r"[a-z]+")
STOPS = re.compile(r"[.!?;:,]")
HIDING = re.compile(r"display\s*:\s*none")
#: What an element says of the text in it.
CONTENT, BOILER_TAG, BOILER_NAME, BOILER_ROLE, CONTENT_NAME, FORM, HIDDEN = (1 << i for i in range(7))
BOILER = BOILER_TAG | BOILER_NAME | BOILER_ROLE | FORM
TEXT_FEATURES = 9
FEATURES = TEXT_FEATURES + 12
#: Ridge of the classifier on what texts and what elements say, the largest cost of a block, and edge capacities: largest, share of the log-odds.
RIDGE, ELEMENT_RIDGE, COST, STRONGEST, SHARE = 2e-3, 1e-5, 8.0, 2.5, 0.5
#: Edge kinds: page neighbours by distance in the element tree (0 to DISTANCES - 1 and more), then blocks of one parent; then the same between blocks whose elements say different things.
DISTANCES = 6
KINDS = DISTANCES + 1


@dataclass
class Block:
    """A run of text.

    ``says`` is what the open elements say, ``below`` what those say that lie inside the outermost article, ``last`` what the innermost that says anything says,
    ``apart`` the tree distance to the block before.
    """

    text: str
    links: int
    tag: str
    parent: int
    apart: int
    says: int
    below: int
    last: int


@dataclass
class Model:
    weights: np.ndarray
    capacities: np.ndarray


def role(tag: str, attributes: str, inside: bool) -> int:
    """What an element says; a header inside content says nothing."""
    says = 0
    if tag == "form":
        says |= FORM
    elif tag in BOILER_TAGS or tag == "header" and not inside:
        says |= BOILER_TAG
    if tag in CONTENT_TAGS:
        says |= CONTENT
    if not attributes or not NAMES.search(attributes):
        return says
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            words = WORDS.findall(value)
            if not BOILER_WORDS.isdisjoint(words):
                says |= BOILER_NAME
            elif not CONTENT_WORDS.isdisjoint(words):
                says |= CONTENT_NAME
        elif name == "role" and value in BOILER_ROLES or name == "aria-hidden" and value == "true":
            says |= BOILER_ROLE
        elif name == "hidden" or name == "style" and HIDING.search(value):
            says |= HIDDEN
    return says


@dataclass
class Open:
    """An open element: its tag and number, and what it and the elements around it say."""

    tag: str
    number: int
    says: int
    below: int
    last: int


def read_blocks(page: str) -> list[Block]:
    blocks: list[Block] = []
    stack = [Open("", 0, 0, 0, 0)]
    text: list[str] = []
    number = links = 0
    link_from = -1
    hushed, nested = "", 0  # the hidden element within a block, and how often it is open
    depth = low = 1  # of the block before, and the least since

    def flush() -> None:
        nonlocal links, link_from, depth, low
        if text:
            joined = "".join(text)
            if link_from >= 0:
                links += len(joined) - link_from
                link_from = 0
            whole = " ".join(entities.unescape(joined).split())
            if whole:
                top = stack[-1]
                parent = stack[-2].number if len(stack) > 1 else 0
                blocks.append(Block(whole, links, top.tag, parent, depth + len(stack) - 2 * low, top.says, top.below, top.last))
                depth = low = len(stack)
            text.clear()
        links = 0

    def close(at: int) -> None:
        nonlocal low, nested
        del stack[at:]
        low = min(low, len(stack))
        nested = 0

    for m in TOKEN.finditer(page):
        if (piece := m[5]) is not None:
            if not nested and not stack[-1].says & HIDDEN:
                text.append(piece)
            continue
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag not in BLOCKS:
            if nested:
                nested += (-1 if m[2] else 1) if tag == hushed else 0
            elif m[4] and not m[2] and tag not in INLINE_VOID and not m[4].endswith("/") and role(tag, m[4], True) & HIDDEN:
                hushed, nested = tag, 1
            elif tag == "a":
                at = sum(map(len, text))
                if m[2]:
                    if link_from >= 0:
                        links += at - link_from
                    link_from = -1
                elif link_from < 0:
                    link_from = at
            elif tag == "br":
                text.append(" ")
            continue
        flush()
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            link_from = -1
            continue
        for closed in CLOSES.get(tag, ()):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == closed:
                    close(i)
                    break
                if stack[i].tag in SCOPES:
                    break
        if tag not in VOID and not m[4].endswith("/"):
            number += 1
            around = stack[-1]
            inside = around.says & CONTENT > 0
            says = role(tag, m[4], inside)
            stack.append(Open(tag, number, around.says | says, around.below | says if inside else 0, says or around.last))
    flush()
    return blocks


def known(block: Block) -> int:
    """What semantic elements say of a block: 1 content, -1 boilerplate, 0 nothing, or an article inside of something else."""
    if block.says & CONTENT:
        return -1 if block.below & BOILER else 0 if block.says & BOILER else 1
    return -1 if block.says & BOILER else 0


def features(blocks: list[Block], hidden: bool = False) -> np.ndarray:
    """``hidden``: as if no element said anything."""
    rows = []
    article = not hidden and any(b.says & CONTENT for b in blocks)
    for b in blocks:
        n = len(b.text)
        says, below, last = (0, 0, 0) if hidden else (b.says, b.below, b.last)
        inside = says & CONTENT > 0
        # in an article what its elements say, and what stands around it; elsewhere all that is said
        own, around = (below, says & ~below) if inside else (says, 0)
        told = (own & (BOILER_TAG | FORM) > 0, own & BOILER_NAME > 0, own & BOILER_ROLE > 0)
        # outside, a name or a form that holds something with another name may hold the whole page
        outside = (own & BOILER_TAG > 0 or last & FORM > 0, last & BOILER_NAME > 0, own & BOILER_ROLE > 0, own & BOILER_NAME > 0 and not last & BOILER_NAME)
        rows.append((
            1.0, np.log(n) / 4, min(1.0, b.links / n), min(1.0, 30 * len(STOPS.findall(b.text)) / n), b.tag[:1] == "h" and b.tag[1:].isdigit(),
            b.tag in ("li", "td", "th"), b.tag in ("p", "blockquote", "pre"), sum(map(b.text.count, "0123456789")) / n, b.text.isupper(),
            inside, *(inside and t for t in told), *(not inside and t for t in outside), around & BOILER_TAG > 0, around & (BOILER_NAME | BOILER_ROLE) > 0,
            last & CONTENT_NAME > 0 and not own & BOILER, article and not inside,
        ))
    return np.array(rows, float).reshape(-1, FEATURES)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 30) -> np.ndarray:
    """Newton's method on the likelihood of balanced classes with a ridge, which is small on what elements say: that outweighs the text."""
    weights = np.zeros(x.shape[1])
    ridge = np.where(np.arange(x.shape[1]) < TEXT_FEATURES, RIDGE, ELEMENT_RIDGE)
    share = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (share * (y - p)) - ridge * weights
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        weights += np.linalg.solve(hessian, gradient)
    return weights


def joined(blocks: list[Block], hidden: bool = False) -> list[tuple[int, int, int]]:
    """Edges (block, block, kind): page neighbours, and blocks of one parent in their order with others between them. ``hidden``: as if no element said anything."""

    def crossing(i: int, j: int) -> int:
        return 0 if hidden or (blocks[i].says, blocks[i].below) == (blocks[j].says, blocks[j].below) else KINDS

    edges = [(i - 1, i, min(blocks[i].apart, DISTANCES - 1) + crossing(i - 1, i)) for i in range(1, len(blocks))]
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if last.get(b.parent, i - 1) < i - 1:
            edges.append((last[b.parent], i, DISTANCES + crossing(last[b.parent], i)))
        last[b.parent] = i
    return edges


#: Names that invented pages give to what is no part of an article.
STRANGE = ("comments", "comment", "commentlist", "replies", "respond", "advert", "ad", "advertisement", "newsletter", "subscribe", "related", "recommended", "sidebar", "share", "sharing", "social", "promo", "sponsored", "cookie", "notice", "pagination", "tags")


def invented(rng: random.Random) -> tuple[str, set[str]]:
    """A page and the texts of its content blocks; names of elements say what they hold, or nothing."""
    word = lambda: "".join(rng.choice("bdfglmnprstk") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    some = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: some(3, 14).capitalize() + rng.choice([".", ".", ", " + some(2, 6) + ".", "?", "!"])
    content: set[str] = set()
    plain = rng.random() < 0.4

    def text(a: int, b: int) -> str:
        made = " ".join(sentence() for _ in range(rng.randint(a, b)))
        content.add(made)
        return made

    def named(names: str) -> str:
        return "" if plain else f' {rng.choice(["class", "id"])}="{rng.choice(["", "site-", "x-"])}{rng.choice(names.split())}"'

    def tag(name: str, body: str, names: str) -> str:
        name = "div" if plain else rng.choice([name, "div"])
        return f"<{name}{named(names) if name == 'div' else ''}>{body}</{name}>"

    links = lambda n: "".join(f'<li><a href="/{word()}">{some(1, 3)}</a></li>' for _ in range(n))
    extras = [
        lambda: tag("aside", "".join(f"<p>{sentence()}</p>" for _ in range(rng.randint(1, 3))), "sidebar widget related"),
        lambda: f"<div{named('ad advert banner promo')}>{' '.join(sentence() for _ in range(rng.randint(1, 3)))}</div>",
        lambda: f"<div{named('cookie notice consent')}><p>{sentence()}</p><button>OK</button></div>",
        lambda: tag("form", f"<label>{some(1, 2)}</label><input name=q>{some(1, 3)}", "subscribe newsletter signup"),
        lambda: f"<ul{named('share social tags pagination')}>{links(rng.randint(2, 5))}</ul>",
    ]
    said = lambda: " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 5])))
    prose = lambda: said() if rng.random() < 0.35 else "".join(f"<p>{said()}</p>" for _ in range(rng.randint(1, 4)))
    wrapped = lambda inner: f'<div class="{rng.choice(["body", "content", "inner", "text", "wrap"])}">{inner}</div>' if rng.random() < 0.3 else inner
    # what stands in an article and is no part of it; these say so by their tag, their name or their role
    strangers = [
        lambda: f"<{(t := rng.choice(['aside', 'footer', 'form', 'nav', 'menu']))}>{wrapped(prose())}</{t}>",
        lambda: f'<{(t := rng.choice(["div", "section", "ul", "ol"]))} {rng.choice(["class", "id"])}="{rng.choice(["", "post-", "the "])}{rng.choice(STRANGE)}">{wrapped(prose())}</{t}>',
        lambda: f'<div role="{rng.choice(["complementary", "navigation", "contentinfo", "form"])}">{wrapped(prose())}</div>',
        lambda: f'<section class="comments"><article class="{rng.choice(["comment", "reply", ""])}">{prose()}</article></section>',
    ]
    body = [f"<h1>{text(1, 1)}</h1>"]
    for _ in range(rng.randint(1, 9)):
        kind = rng.random()
        if kind < 0.75:
            body.append(f"<p>{text(1, 6)}</p>")
        elif kind < 0.85:
            body.append(f"<h2>{text(1, 1)}</h2>")
        elif kind < 0.95:
            body.append("<ul>" + "".join(f"<li>{text(1, 2)}</li>" for _ in range(rng.randint(2, 4))) + "</ul>")
        else:
            body.append(rng.choice(extras)())
    comments = f"<section{named('comments replies disqus')}>" + "".join(f"<p>{sentence()}</p>" for _ in range(rng.randint(1, 3))) + "</section>"
    inside = comments if not plain and rng.random() < 0.2 else ""
    if not plain and rng.random() < 0.6:
        for _ in range(rng.randint(1, 3)):
            body.insert(rng.choice([0, 1, rng.randint(0, len(body)), len(body)]), rng.choice(strangers)())
    article = tag("article" if not plain and rng.random() < 0.5 else rng.choice(["article", "main"]), "".join(body) + inside, "content post entry story")
    beside = f"<aside><article>{prose()}</article></aside>" if not plain and rng.random() < 0.15 else ""
    after = comments if not plain and not inside and rng.random() < 0.3 else ""
    top = tag("header", some(1, 4), "masthead banner") + tag("nav", f"<ul>{links(rng.randint(3, 8))}</ul>", "menu navigation navbar")
    around = [rng.choice(extras)() for _ in range(rng.randint(0, 3))]
    cut = rng.randint(0, len(around))
    whole = f"{top}{''.join(around[:cut])}{article}{after}{beside}{''.join(around[cut:])}{tag('footer', '&copy; ' + some(2, 8), 'footer')}"
    if rng.random() < 0.3:
        whole = f'<div class="{rng.choice(["page", "content", "wrap", "page has-sidebar"])}">{whole}</div>'
    elif rng.random() < 0.1:
        whole = f"<form id=page>{whole}</form>"
    return f"<html><head><title>{some(2, 6)}</title></head><body>{whole}</body></html>", content


def train(pages: list[str], invented_pages: int = 400, seed: int = 7) -> Model:
    """From blocks of ``pages`` in semantic elements and all blocks of invented pages, each with names seen and hidden."""
    rng = random.Random(seed)
    told = [([b for b in blocks], [known(b) for b in blocks]) for blocks in map(read_blocks, pages)]
    for _ in range(invented_pages):
        page, content = invented(rng)
        blocks = read_blocks(page)
        told.append((blocks, [1 if b.text in content else -1 for b in blocks]))
    x, y = [], []
    same, differ = np.ones(2 * KINDS), np.ones(2 * KINDS)
    for blocks, label in told:
        use = np.array(label, int) != 0
        for hidden in (False, True):
            x.append(features(blocks, hidden)[use])
            y.append(np.array(label, int)[use] > 0)
        # how blocks agree whatever their elements say, and across what they say
        for i, j, kind in joined(blocks, True) + [e for e in joined(blocks) if e[2] >= KINDS]:
            if label[i] and label[j]:
                (same if label[i] == label[j] else differ)[kind] += 1
    capacities = np.clip(SHARE * np.log(same / differ), 0.0, STRONGEST)
    return Model(logistic(np.concatenate(x), np.concatenate(y).astype(float)), capacities)


def minimum_cut(excess: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source. excess: source minus sink capacity of each node."""
    n = len(excess)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    left = list(excess)
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is None and not -(room := sum(near[i].values())) < left[i] <= room:
            side[i] = left[i] > 0
            for j, w in near[i].items():
                left[j] += w if side[i] else -w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    core = [i for i in range(n) if side[i] is None]
    if not core:
        return [bool(s) for s in side]
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in core}
    room[source], room[sink] = {}, {}
    for i in core:
        if left[i] > 0:
            room[source][i], room[i][source] = left[i], 0.0
        elif left[i] < 0:
            room[i][sink], room[sink][i] = -left[i], 0.0
    while True:
        came = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            i = queue.popleft()
            for j, w in room[i].items():
                if w > 1e-12 and j not in came:
                    came[j] = i
                    queue.append(j)
        if sink not in came:
            return [bool(s) if s is not None else i in came for i, s in enumerate(side)]
        path, j = [], sink
        while j != source:
            path.append((came[j], j))
            j = came[j]
        flow = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= flow
            room[b][a] += flow


def costs(blocks: list[Block], model: Model, hidden: bool = False) -> list[float]:
    """The log-odds of content."""
    return np.clip(features(blocks, hidden) @ model.weights, -COST, COST).tolist()


def cut(blocks: list[Block], model: Model, hidden: bool = False) -> list[bool]:
    """Which blocks are content."""
    return minimum_cut(costs(blocks, model, hidden), [(i, j, float(model.capacities[kind])) for i, j, kind in joined(blocks, hidden)])


def main_text(page: str, model: Model) -> tuple[str, int, int, int]:
    """The text, the number of blocks, how many are content, and how many the edges have turned."""
    blocks = read_blocks(page)
    if not blocks:
        return "", 0, 0, 0
    keep = cut(blocks, model)
    chosen = [b.text for b, k in zip(blocks, keep) if k]
    turned = sum((c > 0) != k for c, k in zip(costs(blocks, model), keep))
    return "\n".join(chosen), len(blocks), len(chosen), turned


def fit(df: DataFrame, html: str = "html", key: str = "page_id", sample: int = SAMPLE) -> Model:
    """Trains on at most ``sample`` pages, the first by hash of the key."""
    return train(sample_texts(df, html, key, sample, SAMPLE_CHARS))


def extract(df: DataFrame, model: Model, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` and text, n_chars, n_blocks, n_content, n_turned (blocks that the edges have turned against the classifier)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        fitted = shared.value

        def block(column: pa.Array) -> list:
            made = [main_text(p or "", fitted) for p in column.to_pylist()]
            counts = [pa.array([m[i] for m in made], pa.int64()) for i in (1, 2, 3)]
            return [pa.array([m[0] for m in made], pa.string()), pa.array([len(m[0]) for m in made], pa.int64()), *counts]

        return block

    return map_text(df, make, "text string, n_chars long, n_blocks long, n_content long, n_turned long", html, list(keep))
