"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

A page is parsed into its elements (implied end tags are supplied) in one pass that reads nothing twice. Every element
that isn't inline, and every inline one with a class, id or role, gets features: what its tag and attribute tokens (and those of its ancestors)
meant in training, subtree density, link share, depth, and how it compares with its
siblings. Gradient-boosted trees give the log-odds that its text is article text. Decoding
labels elements from the root down as above the article, in it, or out of it; an
element out of the article has no descendant in it, and the best-scoring labelling without such a
contradiction is found exactly by dynamic programming over the tree.

Pages have no labels, so the trees learn from what page authors mark up: on a bounded sample (SAMPLE_PAGES) of pages,
text in <article> or <main> is positive, that in elements of the names below negative. Each sampled page is learned in several disguises: containers
renamed, its own texts repeated as sidebars, notices, forms, comments and inline adverts, and within the article as headings, lists, tables, quotes, figures and
plain wrappers, so that neither a name nor a kind of element decides by itself.

Defined results: a null or empty page has an empty text; a page without any article text too; repeated rows get equal results;
without a page to learn from texts are empty; unclosed and stray tags are allowed; other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps

SAMPLE_PAGES = 400
TREES, DEPTH, RATE, BINS = 60, 4, 0.2, 32
#: Cost of entering the article, or of leaving it inside, in log-odds.
SWITCH = 2.0

# Elements of HTML by their part in the layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg select button object".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("article aside body div html li main nav section table td th tr ul ol dl form footer header blockquote figure".split())
#: What authors call the article, and what isn't part of it.
ARTICLE_TAGS = frozenset("article main".split())
ARTICLE_TOKENS = frozenset("content main post entry story article-body post-content entry-content".split())
OTHER_TAGS = frozenset("nav header footer aside form menu dialog".split())
OTHER_TOKENS = frozenset(
    "ad ads advert advertisement sponsored promo banner sidebar menu nav navbar navigation breadcrumb breadcrumbs header footer comments comment comment-list respond "
    "cookie cookies consent notice alert newsletter subscribe signup share social related widget popup modal pagination login search copyright".split()
)

# All quantifiers are possessive, so a match or a failure looks at each character once.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_NAMED = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)


_ENDS = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW}


def markup(source: str, ends: Callable[[str, str, int], int]) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" or "", name, attributes) of each tag and (start, end, "", "", "") of each comment or declaration.

    Nothing is read twice: once an attribute's quote doesn't end, quotes no longer count in the rest of the page; behind the last > no tag is looked for.
    ends(name, attributes, end) tells where to go on behind an opening tag.
    """
    at, last, quotes = source.find("<"), source.rfind(">"), True
    while at >= 0:
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            end = len(source) if end < 0 else end + 3
            yield at, end, "", "", ""
            at = source.find("<", end)
            continue
        if at > last:
            at = source.find("<!--", at)  # all that may still be markup
            continue
        if source.startswith(("<!", "<?"), at):
            end = source.find(">", at) + 1
            yield at, end, "", "", ""
            at = source.find("<", end)
            continue
        tag = _TAG.match(source, at)
        if not tag:
            at = source.find("<", at + 1)
            continue
        rest = _REST.match(source, tag.end()) if quotes else None
        if rest:
            end, attributes = rest.end(), rest.group(1)
        else:
            quotes = False
            end = source.find(">", tag.end()) + 1
            if not end:  # the name has run over the last >
                at = source.find("<", at + 1)
                continue
            attributes = source[tag.end() : end - 1]
        name = tag.group(2).lower()
        yield at, end, tag.group(1), name, attributes
        at = source.find("<", end if tag.group(1) else ends(name, attributes, end))


class Page:
    """The elements of a page that aren't inline or have a name, in page order, and the text pieces of each.

    pieces: (element, text, in a link) and (None, "", False) wherever a block ends.
    """

    def __init__(self, source: str):
        self.tag, self.tokens, self.parent, self.depth = ["#root"], [()], [-1], [0]
        self.pieces: list[tuple] = []
        self.stack: list[tuple[str, int]] = [("#root", 0)]  # open elements; inline ones without a name with the element they are in
        self.where: dict[str, list[int]] = {}  # places in the stack of each open name
        self.scopes: list[int] = []
        self.links, self.at = 0, 0
        endless: set[str] = set()

        def ends(name: str, attributes: str, end: int) -> int:
            """Behind the content of an element that is skipped with it, if it has an end."""
            self.at = end
            if name in RAW and not attributes.endswith("/") and name not in endless:
                closing = _ENDS[name].search(source, end)
                if closing:
                    self.at = closing.end()
                else:
                    endless.add(name)
            return self.at

        for start, end, close, name, attributes in markup(source, ends):
            self._text(source[self.at : start])
            self.at = end
            if name == "br":
                self.pieces.append((self.stack[-1][1], " ", self.links > 0))
            if not name or name in RAW and not close:
                continue
            if close:
                if self.where.get(name) and self._pop(self.where[name][-1]):
                    self.pieces.append((None, "", False))
            else:
                self._open(name, attributes)
        self._text(source[self.at :])

    def _text(self, text: str) -> None:
        if text:
            self.pieces.append((self.stack[-1][1], " " if text.isspace() else html.unescape(text), self.links > 0))

    def _pop(self, place: int) -> bool:
        """Closes all open elements from a place in the stack on; whether one of them isn't inline."""
        block = False
        while len(self.stack) > place:
            name, _ = self.stack.pop()
            self.where[name].pop()
            if self.scopes and self.scopes[-1] == len(self.stack):
                self.scopes.pop()
            self.links -= name == "a"
            block |= name not in INLINE
        return block

    def _open(self, name: str, attributes: str) -> None:
        closes = CLOSES_SAME.get(name) or ({"p"} if name in CLOSES_P else ())
        place = max((self.where[c][-1] for c in closes if self.where.get(c)), default=-1)
        if place > 0 and not (self.scopes and self.scopes[-1] > place):
            self._pop(place)
        inline = name in INLINE
        if not inline:
            self.pieces.append((None, "", False))
        if name in VOID or inline and attributes.endswith("/"):
            return
        words = [w for m in _NAMED.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split()] if attributes else ()
        element = self.stack[-1][1]
        if not inline or words:
            self.tag.append(name)
            self.tokens.append(tuple(words))
            self.parent.append(element)
            self.depth.append(self.depth[element] + 1)
            element = len(self.tag) - 1
        self.where.setdefault(name, []).append(len(self.stack))
        if name in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append((name, element))
        self.links += name == "a"

    def text(self, keep: list[bool]) -> str:
        """The kept elements' blocks, joined by an empty line."""
        blocks, held = [], []
        for owner, text, _ in self.pieces:
            if owner is None:
                if held:
                    blocks.append(" ".join("".join(held).split()))
                    held = []
            elif keep[owner]:
                held.append(text)
        if held:
            blocks.append(" ".join("".join(held).split()))
        return "\n\n".join(b for b in blocks if b)


FEATURES = 24


class Odds:
    """Smoothed log-odds of tags and attribute tokens in training."""

    def __init__(self, seen: list[tuple[list[str], float, float]]):
        yes, no = Counter(), Counter()
        for names, y, w in seen:
            for n in names:
                yes[n] += y * w
                no[n] += (1 - y) * w
        self.of = {n: float(np.log((yes[n] + 1) / (no[n] + 1))) for n in {*yes, *no}}

    def __call__(self, names: list[str]) -> list[float]:
        return [self.of.get(n, 0.0) for n in names]


def names(page: Page, k: int) -> list[str]:
    return [page.tag[k], *(f".{t}" for t in page.tokens[k])]


def features(page: Page, odds: Odds) -> tuple[np.ndarray, np.ndarray]:
    """(features of each element, characters of text that each owns itself)."""
    n = len(page.tag)
    own, link, marks, count, blocks = (np.zeros(n) for _ in range(5))
    before = np.zeros(n)
    met = 0
    for owner, text, linked in page.pieces:
        if owner is not None:
            size = len(text.strip())
            if not own[owner]:
                before[owner] = met
            own[owner] += size
            link[owner] += size * linked
            marks[owner] += text.count(",") + text.count(".")
            count[owner] += text.count(" ")
            met += size
    parent, depth = page.parent, page.depth
    tree, tree_link, tree_marks, tree_words, tree_nodes = own.copy(), link.copy(), marks.copy(), count.copy(), np.ones(n)
    kids: list[list[int]] = [[] for _ in range(n)]
    for k in range(n - 1, 0, -1):
        p = parent[k]
        kids[p].append(k)
        for x in (tree, tree_link, tree_marks, tree_words, tree_nodes):
            x[p] += x[k]
        if own[k] and (not blocks[p] or before[k] < before[p]):
            blocks[p] = 1
    place, same = np.zeros(n, int), np.ones(n)
    for x in kids:
        x.reverse()
        tags = Counter(page.tag[k] for k in x)
        for at, k in enumerate(x):
            place[k], same[k] = at, tags[page.tag[k]] / len(x)
    total = max(1.0, tree[0])
    x = np.zeros((n, FEATURES))
    low, high, token = np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(n):
        p = max(0, parent[k])
        of = odds(names(page, k))
        token[k] = max(of[1:], key=abs, default=0.0)
        low[k] = min([low[p], *of]) if k else 0.0
        high[k] = max([high[p], *of]) if k else 0.0
        mates = kids[p] if k else [0]
        at = place[k]
        prev, nxt = (mates[at - 1] if at else -1), (mates[at + 1] if at + 1 < len(mates) else -1)
        x[k] = (
            of[0], token[k], low[p], high[p], low[k], high[k],
            depth[k], np.log1p(own[k]), np.log1p(tree[k]), np.log1p(tree_nodes[k]),
            tree[k] / tree_nodes[k], tree_link[k] / max(1.0, tree[k]), tree_marks[k] / max(1.0, tree_words[k]), tree_words[k] / tree_nodes[k],
            tree[k] / total, tree[k] / max(1.0, tree[p]), len(mates), at / len(mates), same[k], len(kids[k]),
            np.log1p(tree[prev]) if prev >= 0 else -1.0, np.log1p(tree[nxt]) if nxt >= 0 else -1.0, token[p], k / n,
        )
    return x, own


class Boosted:
    """Gradient-boosted trees of fixed depth on binned features, for the log-loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._bins(x)
        z, self.trees = np.zeros(len(x)), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            g, h = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-4)
            feature, cut, node = np.zeros(2**DEPTH, int), np.full(2**DEPTH, BINS), np.ones(len(x), int)
            for level in range(DEPTH):
                first, width = 2**level, 2**level
                local = node - first
                best = np.zeros(width)
                for j in range(b.shape[1]):
                    code = local * BINS + b[:, j]
                    gg, hh = (np.cumsum(np.bincount(code, v, width * BINS).reshape(width, BINS), axis=1) for v in (g, h))
                    gain = gg**2 / (hh + 1) + (gg[:, -1:] - gg) ** 2 / (hh[:, -1:] - hh + 1) - gg[:, -1:] ** 2 / (hh[:, -1:] + 1)
                    at = gain[:, :-1].argmax(1)
                    value = gain[np.arange(width), at]
                    won = value > best + 1e-9
                    best[won] = value[won]
                    feature[first : first + width][won], cut[first : first + width][won] = j, at[won]
                node = 2 * node + (b[np.arange(len(x)), feature[node]] > cut[node])
            leaf = node - 2**DEPTH
            out = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
            z += out[leaf]
            self.trees.append((feature, cut, out))

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, z, rows = self._bins(x), np.zeros(len(x)), np.arange(len(x))
        for feature, cut, out in self.trees:
            node = np.ones(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + (b[rows, feature[node]] > cut[node])
            z += out[node - 2**DEPTH]
        return z


def teacher(page: Page) -> np.ndarray:
    """Whether each element is article text by its own and its ancestors' names: 1, 0, or -1 above any named one."""
    state = np.full(len(page.tag), -1)
    for k in range(len(page.tag)):
        before = state[page.parent[k]] if k else -1
        tokens = set(page.tokens[k])
        if page.tag[k] in OTHER_TAGS or tokens & OTHER_TOKENS:
            state[k] = 0
        elif before != 0 and (page.tag[k] in ARTICLE_TAGS or tokens & ARTICLE_TOKENS):
            state[k] = 1
        else:
            state[k] = before
    return state


def disguises(source: str, rng: random.Random) -> list[str]:
    """The page, and the page with other names, with more of what surrounds articles, and with more of what they hold."""
    swap = lambda s, tag, new: re.sub(rf"<{tag}(?=[\s>])", f"<{new}", re.sub(rf"</{tag}>", f"</{new.split()[0]}>", s))
    token = rng.choice(sorted(ARTICLE_TOKENS))
    plainly = lambda s: swap(swap(swap(s, "article", f'div class="{token}"'), "nav", 'div class="menu"'), "footer", 'div class="footer"')
    texts = [t for t in re.findall(r">([^<>]{20,400})<", source)] or ["Read more"]
    any_text = lambda n=400: rng.choice(texts)[: rng.choice([n, n // 3 + 10])]
    some = lambda n: "".join(f"<p>{any_text()}</p>" for _ in range(n))
    many = lambda tag, n: "".join(f"<{tag}>{any_text(80)}</{tag}>" for _ in range(n))
    named = lambda: rng.choice(["", "", f' class="n{rng.randrange(40)}"', f' id="n{rng.randrange(40)}"'])  # noqa: E731  a name that means nothing
    extra = [
        lambda: f'<aside class="sidebar">{some(rng.randint(1, 3))}</aside>',
        lambda: f'<div class="{rng.choice(["cookie notice", "notice", "cookie-notice cookie", "alert notice"])}"><p>{rng.choice(texts)}</p></div>',
        lambda: f'<form action="/s"><label>{rng.choice(texts)[:40]}</label><input type="text"><p>{rng.choice(texts)[:60]}</p></form>',
        lambda: f'<{(t := rng.choice(["section", "div"]))} id="comments" class="{rng.choice(["comments", "comment-list", "comments"])}"><h2>Comments</h2>' + "".join(f'<div class="comment">{some(1)}</div>' for _ in range(rng.randint(1, 4))) + f"</{t}>",
        lambda: f'<div class="{rng.choice(["ad", "advert", "sponsored", "promo", "banner"])}">{some(1)}</div>',
        lambda: f'<ul class="{rng.choice(["share", "related", "breadcrumb", "social", "menu"])}">' + "".join(f'<li><a href="#">{rng.choice(texts)[:30]}</a></li>' for _ in range(3)) + "</ul>",
        lambda: f'<{(t := rng.choice(["span", "small", "a", "em"]))} class="{rng.choice(sorted(OTHER_TOKENS))} {rng.choice(sorted(OTHER_TOKENS))}">{any_text(60)}</{t}>',
    ]
    held = [
        lambda: f"<h{(k := rng.randint(2, 4))}{named()}>{any_text(60)}</h{k}>",
        lambda: f"<{(t := rng.choice(['ul', 'ol']))}{named()}>{many('li', rng.randint(1, 5))}</{t}>",
        lambda: f"<ul><li><p>{any_text()}</p></li><li><a href='/x'>{any_text(60)}</a></li></ul>",
        lambda: f"<table{named()}><tr>{many('th', 2)}</tr>" + "".join(f"<tr>{many('td', 2)}</tr>" for _ in range(rng.randint(1, 3))) + "</table>",
        lambda: f"<blockquote{named()}>{some(rng.randint(1, 2))}</blockquote>",
        lambda: f"<figure{named()}><img src='i.png'><figcaption>{any_text(90)}</figcaption></figure>",
        lambda: f"<div{named()}>{any_text()}</div>",
        lambda: f"<div{named()}>{some(rng.randint(1, 2))}</div>",
        lambda: f"<section{named()}><h2>{any_text(60)}</h2>{some(rng.randint(1, 2))}</section>",
        lambda: f"<section>{any_text()}</section>",
        lambda: f"<dl{named()}>" + "".join(f"<dt>{any_text(30)}</dt><dd>{any_text(120)}</dd>" for _ in range(rng.randint(1, 3))) + "</dl>",
        lambda: f"<{(t := rng.choice(['pre', 'blockquote', 'address', 'details']))}{named()}>{any_text()}</{t}>",
        lambda: f"<p{named()}>{any_text(90)} <{(t := rng.choice(['span', 'a', 'em', 'b', 'small']))}{named() or ' class=x'}>{any_text(60)}</{t}> {any_text(90)}</p>",
    ]

    def rich(s: str) -> str:
        """More of what articles hold, between and around their paragraphs."""
        bounds = re.search(r"<(article|main)[\s>].*</\1>", s, re.S)
        spots = [m.end() for m in re.finditer("</p>|</h1>", s[: bounds.end()]) if m.end() > bounds.start()] if bounds else []
        for spot in sorted(rng.sample(spots, min(rng.randint(1, 4), len(spots))), reverse=True):
            s = s[:spot] + "".join(rng.choice(held)() for _ in range(rng.randint(1, 2))) + s[spot:]
        return s

    out = [source, rich(source), plainly(rich(source))]
    for base in (rich(source), plainly(rich(source)) if rng.random() < 0.7 else plainly(source)):
        add = lambda: "".join(rng.choice(extra)() for _ in range(rng.randint(1, 2)))
        full = re.sub(r"(<body[^>]*>)", lambda m: m[1] + f"<header><h2>{rng.choice(texts)[:50]}</h2></header>" + add(), base, count=1)
        spots = [m.start() if rng.random() < 0.5 else m.end() for m in re.finditer(r"</p>", full)]
        for spot in sorted(rng.sample(spots, min(3, len(spots))), reverse=True):
            full = full[:spot] + (extra[6] if full.startswith("</p>", spot) else rng.choice(extra))() + full[spot:]
        end = re.search(r"</article>|<footer|<div class=\"footer\"", full)
        if end:
            full = full[: end.start()] + extra[3]() + full[end.start() :]
        out.append(full)
    return out


class Extractor:
    def __init__(self, sources: list[str]):
        rng, pages = random.Random(0), []
        for s in sources:
            pages += [Page(v) for v in disguises(s, rng)]
        marks = [teacher(p) for p in pages]
        self.odds = Odds([(names(p, k), float(m[k] == 1), 1.0) for p, m in zip(pages, marks) for k in range(len(p.tag)) if m[k] >= 0])
        x, y, w = [], [], []
        for page, mark in zip(pages, marks):
            f, own = features(page, self.odds)
            x.append(f)
            y.append((mark == 1).astype(float))
            w.append(np.where(own > 0, 1.0, 0.3))
        self.trees = Boosted(np.concatenate(x), np.concatenate(y), np.concatenate(w)) if pages else None

    def texts(self, sources: list[str | None]) -> list[str]:
        if self.trees is None:
            return [""] * len(sources)
        pages = [Page(s or "") for s in sources]
        seen = [features(p, self.odds) for p in pages]
        margin = self.trees.margin(np.concatenate([f for f, _ in seen])) if pages else np.empty(0)
        out, at = [], 0
        for page, (f, own) in zip(pages, seen):
            out.append(page.text(decode(page.parent, margin[at : at + len(f)], own)))
            at += len(f)
        return out


def decode(parent: list[int], margin: np.ndarray, own: np.ndarray) -> list[bool]:
    """Whether each element is in the article, by the best labelling: above -> above, in, out; in -> in, out; out -> out."""
    n = len(parent)
    gain = (np.clip(margin, -6, 6) * np.where(own > 0, 1 + np.log1p(own), 0.2)).tolist()
    # Sums over children of the best score below, by the element's own label.
    above, inside, outside = [0.0] * n, [0.0] * n, [0.0] * n
    choice_above, choice_inside = [0] * n, [0] * n
    for k in range(n - 1, -1, -1):
        a, i, o = above[k] - gain[k], inside[k] + gain[k], outside[k] - gain[k]
        options = (a, i - SWITCH, o)
        best = max(range(3), key=lambda c: (options[c], c))
        choice_above[k] = best
        choice_inside[k] = 1 if i >= o - SWITCH else 2
        if k:
            p = parent[k]
            above[p] += options[best]
            inside[p] += max(i, o - SWITCH)
            outside[p] += o
    label = [0] * n
    for k in range(n):
        before = label[parent[k]] if k else 0
        label[k] = choice_above[k] if before == 0 else choice_inside[k] if before == 1 else 2
    return [v == 1 for v in label]


def fit(pages: DataFrame, limit: int = SAMPLE_PAGES) -> Extractor:
    """Learns from at most `limit` pages (page_id, html), chosen by a hash of the id."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).where("length(html) > 0")
    total = rows.count()
    share = int(min(1.0, limit / max(1, total)) * 1_000_003) + 1
    got = rows.where(F.pmod(F.xxhash64("page_id", F.lit(5)), F.lit(1_000_003)) < share).orderBy("page_id", "html").limit(limit).collect()
    return Extractor([r.html for r in got])


def extract(pages: DataFrame, model: Extractor) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "html", 1 << 20):
                texts = model.texts(batch.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
