"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree.

A page is read by tags into leaf blocks: stretches of text with no border of a block element inside. A block's
features are the tags and the words of classes and ids of its ancestors, and its text: length, links, signs, cue words.
The field has two labels, article text or not, learnt by exact gradients (forward and backward sums) and decoded by
Viterbi's rule.

Labelled pages are those that mark their article (``article`` or ``main``); what lies in it, outside menus, forms and
the like, is text. Since marks are rare on the web, each labelled page is also laid out anew in containers of other
kinds, its blocks keeping their labels, so that the field learns from classes and text and not from one tag.

A null, empty or text-free page gives an empty text. Pages are told apart by nothing, so null and repeated ids give
a row each; other columns are left aside. Empty table: no rows. A page may have any length.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

#: Fixed values of the markup language: elements within a line, without an end tag, with contents that are no text.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("head iframe math noscript object script style svg template textarea title".split())
RAW = set("script style textarea title".split())
#: What an opening tag closes: (these, up to the nearest of those).
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
#: Words that tell of what is around an article, if a short block has them.
CUES = set("accept ad advertisement advertising archives categories comment comments contact cookie cookies copyright copy email follow home imprint login menu more newsletter next policy posted powered previous privacy read related reply reserved rights search share sign sponsored subscribe tags terms topics trending".split())

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
WORD = re.compile(r"[^\W\d_]+")


class Node:
    """An open element: its tag, all features of it and its ancestors, and their score once it is asked for."""

    __slots__ = ("features", "new", "parent", "score", "tag")

    def __init__(self, tag: str, parent: Node | None, attributes: str):
        names = {"t:" + tag}
        if attributes:
            for _, *values in NAMED.findall(attributes):
                names |= {"c:" + w for w in PARTS.findall(CAMEL.sub(" ", "".join(values)).lower())}
        self.tag, self.parent, self.score = tag, parent, None
        self.new = names - parent.features if parent else names
        self.features = parent.features | names if parent else frozenset(names)


def blocks(page: str) -> Iterator[tuple[int, str, int, Node]]:
    """(place in the page, text, characters in links, innermost block element) of each leaf block with text."""
    root = Node("html", None, "")
    stack, texts, start, links, linked, place = [root], [], 0, 0, 0, 0
    n, find = len(page), TAG.search

    def block():
        nonlocal texts, linked
        text = " ".join("".join(texts).split())
        found = (start, text, min(linked, len(text)), stack[-1]) if text else None
        texts, linked = [], 0
        return found

    while place < n:
        m = find(page, place)
        end = m.start() if m else n
        if end > place:
            if not texts:
                start = place
            text = page[place:end]
            if "&" in text:
                text = entities.unescape(text)
            texts.append(text)
            if links:
                linked += len(text.strip())
        if not m:
            break
        place = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing = name.lower(), m[1] or m[4]
        if name in SILENT and not closing:
            if name == "head":
                continue
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, place)
            if stop:
                place = stop.end()
            elif name in RAW:
                place = n
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            elif name == "br" or name == "img":
                texts.append(" ")
            continue
        if found := block():
            yield found
        links = 0
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
            continue
        if name in VOID or name in ("html", "head", "body"):
            continue
        if name in CLOSES:
            these, limits = CLOSES[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in limits:
                    break
                if stack[k].tag in these:
                    del stack[k:]
                    break
        elif stack[-1].tag == "p":
            stack.pop()
        stack.append(Node(name, stack[-1], (m[3] or m[6] or "")))
    if found := block():
        yield found


def text_features(text: str, linked: int, tag: str) -> list[str]:
    words, n = text.count(" ") + 1, len(text)
    size = 0 if words < 3 else 1 if words < 6 else 2 if words < 11 else 3 if words < 21 else 4 if words < 51 else 5
    link = 0 if not linked else 1 if 3 * linked < n else 2 if 3 * linked < 2 * n else 3
    out = ["bias", f"p:{tag}", f"size:{size}", f"link:{link}", f"end:{text[-1] in '.!?…'}", f"commas:{min(3, text.count(','))}"]
    if text[0] in "©®™":
        out.append("sign")
    if size < 4:
        out += {"w:" + w for w in WORD.findall(text.lower()) if w in CUES}
    return out


class Field:
    """Weights of article text against the rest, by feature, and of the step from label to label."""

    def __init__(self, weights: dict[str, float], steps: np.ndarray, first: float):
        self.weights, self.steps, self.first = weights, [[float(x) for x in r] for r in steps], float(first)

    def _ancestors(self, node: Node) -> float:
        new, at = [], node
        while at is not None and at.score is None:
            new.append(at)
            at = at.parent
        score = at.score if at else 0.0
        for x in reversed(new):
            score = x.score = score + sum(self.weights.get(f, 0.0) for f in x.new)
        return score

    def decode(self, scores: list[float]) -> list[bool]:
        """The likeliest labels of a chain of blocks (Viterbi); of ties a block is not text."""
        (s00, s01), (s10, s11) = self.steps
        back, no, yes = [], 0.0, self.first
        for k, e in enumerate(scores):
            if k:
                a, b = yes + s10 > no + s00, yes + s11 > no + s01
                no, yes = (yes + s10 if a else no + s00), (yes + s11 if b else no + s01)
                back.append((a, b))
            yes += e
        label, out = yes > no, []
        for a, b in reversed(back):
            out.append(label)
            label = b if label else a
        return [*out, label][::-1] if scores else []

    def extract(self, page: str | None) -> str:
        found = list(blocks(page or ""))
        get = self.weights.get
        scores = [self._ancestors(node) + sum(get(f, 0.0) for f in text_features(text, linked, node.tag)) for _, text, linked, node in found]
        return "\n\n".join(text for (_, text, _, _), keep in zip(found, self.decode(scores), strict=True) if keep)


def chain_sums(e: np.ndarray, length: np.ndarray, steps: np.ndarray, first: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of padded chains with scores e of label 1: log partition sums, chances of label 1, expected steps (2 x 2)."""
    n, t = e.shape
    alpha, beta = np.zeros((t, n, 2)), np.zeros((t, n, 2))
    alpha[0, :, 1] = first + e[:, 0]
    for k in range(1, t):
        x = np.logaddexp(alpha[k - 1, :, 0:1] + steps[0], alpha[k - 1, :, 1:2] + steps[1])
        x[:, 1] += e[:, k]
        alpha[k] = np.where((k < length)[:, None], x, alpha[k - 1])
    total = np.logaddexp(alpha[-1, :, 0], alpha[-1, :, 1])
    expected = np.zeros((2, 2))
    for k in range(t - 2, -1, -1):
        y = beta[k + 1].copy()
        y[:, 1] += e[:, k + 1]
        inside = (k + 1 < length)[:, None]
        pair = alpha[k][:, :, None] + steps[None] + y[:, None, :] - total[:, None, None]
        expected += np.where(inside[:, :, None], np.exp(np.minimum(pair, 0)), 0).sum(0)
        beta[k] = np.where(inside, np.logaddexp(steps[:, 0] + y[:, 0:1], steps[:, 1] + y[:, 1:2]), 0)
    chance = np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - total, 0)).T
    return total, chance, expected


def train(chains: list[list[tuple[list[str], int]]], rounds: int = 120, rate: float = 0.2, penalty: float = 0.002) -> Field:
    """A field from labelled chains of (features, label), by full gradients with adaptive steps (Adam)."""
    chains = [c for c in chains if c]
    names = {f: k for k, f in enumerate(sorted({f for c in chains for fs, _ in c for f in fs}))}
    if not chains:
        return Field({}, np.zeros((2, 2)), 0.0)
    length = np.array([len(c) for c in chains])
    t = int(length.max())
    inside = np.arange(t)[None] < length[:, None]
    flat = [x for c in chains for x in c]
    ids = np.array([names[f] for fs, _ in flat for f in fs])
    owner = np.repeat(np.arange(len(flat)), [len(fs) for fs, _ in flat])
    label = np.zeros(inside.shape)
    label[inside] = [y for _, y in flat]
    seen = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            seen[a, b] = ((label[:, :-1] == a) & (label[:, 1:] == b) & inside[:, 1:]).sum()
    k = len(names)
    w, m, v = np.zeros(k + 5), np.zeros(k + 5), np.zeros(k + 5)
    for step in range(1, rounds + 1):
        e = np.zeros(inside.shape)
        e[inside] = np.bincount(owner, w[ids], len(flat))
        _, chance, expected = chain_sums(e, length, w[k : k + 4].reshape(2, 2), w[k + 4])
        off = (label - chance)[inside]
        g = np.concatenate([np.bincount(ids, off[owner], k), (seen - expected).ravel(), [(label[:, 0] - chance[:, 0]).sum()]]) / len(chains) - penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field({f: float(w[i]) for f, i in names.items()}, w[k : k + 4].reshape(2, 2), w[k + 4])


MARKED = re.compile(r"<(article|main)\b[^>]*>(.*?)(?:</\1\s*>|\Z)", re.S | re.I)
#: Elements and words of classes that are no article text wherever they stand.
AROUND = set("t:nav t:header t:footer t:aside t:form t:button t:select c:comment c:comments c:ad c:ads c:advert c:sidebar c:share c:related c:notice c:cookie c:newsletter".split())
#: Containers that labelled pages are laid out in.
INSIDE = [
    "article", "main", "section", "div class=content", "div id=content", "div class=post", "div class=entry-content", "div class=article-body", "div id=main", "div class=story", "div class=text", "div role=main", "td class=main",
    "div class=page-content", "section class=article", "div class=post-body", "div",
]
OUTSIDE = {
    "before": ["nav", "header", "div class=menu", "ul class=nav", "div class=navbar", "div id=header", "div class=breadcrumb", "div class=topbar", "div class=cookie-notice", "div id=cookie-banner", "div class=notice", "div role=alert", "div class=ad", "div class=banner-ad", "div class=advert", "form class=search", "div class=site-header", "div class=masthead"],
    "between": ["aside", "div class=ad", "div class=advertisement", "div class=sponsored", "div class=promo", "figure class=ad", "div class=newsletter", "form", "div class=share", "div class=social", "div class=related", "aside class=sidebar", "div class=ads"],
    "after": ["footer", "aside", "div class=sidebar", "div id=sidebar", "div class=widget", "div class=comments", "section id=comments", "div class=comment-list", "ol class=commentlist", "div class=comment", "div class=footer", "div id=footer", "div class=copyright", "div class=related-posts", "div class=recommended", "form class=newsletter", "div class=subscribe", "div class=tags", "div class=share-buttons", "section class=comments", "section class=reader-comments", "div class=disclaimer", "div class=popup", "div class=modal"],
}
LINES = ["Home", "About us", "Contact", "Sign in", "Subscribe to our newsletter", "We use cookies to improve this site. Accept all cookies.", "Advertisement", "Sponsored", "Share this", "Read more", "Related posts", "Comments", "Reply", "Search", "All rights reserved.", "Privacy policy", "Terms of use", "Follow us", "Previous", "Next", "Leave a comment"]


def labelled(page: str) -> list[tuple[list[str], int, str, int]]:
    """(features, label, text, linked) of each block of a page that marks its article; none of another page."""
    spans = [m.span(2) for m in MARKED.finditer(page)]
    out = []
    for place, text, linked, node in blocks(page) if spans else ():
        inside = any(a <= place < b for a, b in spans) and not node.features & AROUND
        out.append(([*node.features, *text_features(text, linked, node.tag)], int(inside), text, linked))
    return out


def laid_out(r: random.Random, texts: list[str], others: list[tuple[str, int]]) -> str:
    """A page of these texts and others, with label marks: what lies between U+0001 and U+0002 is text."""
    safe = entities.escape

    def wrap(kind: str, inner: str) -> str:
        name, _, rest = kind.partition(" ")
        body = f"<{kind}>{inner}</{name}>"
        return f"<table><tr>{body}</tr></table>" if name == "td" else body

    def other() -> str:
        if r.random() < 0.5 or not others:
            lines = [(x, len(x) * r.randrange(2)) for x in r.sample(LINES, r.randint(1, 4))]
        else:
            lines = [r.choice(others) for _ in range(r.randint(1, 4))]
        if texts and r.random() < 0.4:
            lines += [(r.choice(texts), 0)]  # reader comments and adverts read like articles
        item, link = r.choice(["p", "li", "div", "span"]), r.random() < 0.7
        return "".join(f"<{item}>" + (f'<a href="/x">{safe(x)}</a>' if linked and link else safe(x)) + f"</{item}>" for x, linked in lines)

    around = lambda where, most: "".join(wrap(r.choice(OUTSIDE[where]), other()) for _ in range(r.randint(0, most)))
    heading = r.choice(["h1", "h1", "h2"])
    item = r.choice(["p", "p", "p", "div", "blockquote", "li"])
    parts = [f"\x01<{heading}>{safe(texts[0])}</{heading}>\x02"] if texts else []
    for x in texts[1:]:
        parts.append("\x01" + wrap(item, safe(x)) + "\x02")
        if r.random() < 0.08:
            parts.append(around("between", 1))
    if r.random() < 0.3:
        parts.append(around("after", 2))
    inner = wrap(r.choice(INSIDE), "".join(parts))
    if r.random() < 0.5:
        inner = wrap(r.choice(["div class=wrapper", "div id=page", "div class=container", "main"]), inner)
    if r.random() < 0.3:
        inner = around("before", 2) + inner + around("after", 3)
        return "<body>" + wrap(r.choice(["div class=wrapper", "div id=page", "div class=container", "div"]), inner)
    return "<body>" + around("before", 3) + inner + around("after", 4)


def chains_of(pages: list[str], layouts: int = 4, seed: int = 7) -> list[list[tuple[list[str], int]]]:
    """Labelled chains: the marked pages as they are, and each in some other layouts."""
    r, out = random.Random(seed), []
    for page in pages:
        found = labelled(page)
        texts = [x for _, y, x, _ in found if y]
        if not texts:
            continue
        out.append([(fs, y) for fs, y, _, _ in found])
        others = [(x, linked) for _, y, x, linked in found if not y]
        for _ in range(layouts):
            some = texts[:1] + texts[1:][: r.randint(1, 12)]
            page = laid_out(r, some, others)
            clean, spans, at = [], [], 0
            for piece in re.split("([\x01\x02])", page):
                if piece == "\x01":
                    spans.append([at, at])
                elif piece == "\x02":
                    spans[-1][1] = at
                else:
                    clean.append(piece)
                    at += len(piece)
            chain = []
            for place, text, linked, node in blocks("".join(clean)):
                chain.append(([*node.features, *text_features(text, linked, node.tag)], int(any(a <= place < b for a, b in spans))))
            out.append(chain)
    return out


def fit(pages: DataFrame, rows: int = 300, layouts: int = 6, longest: int = 100_000) -> Field:
    """A field from at most so many pages of at most so many bytes that mark their article, chosen by a hash of the whole page."""
    short = pages.select(F.col("html").cast("string").alias("html")).filter(F.octet_length("html") <= longest)
    marked = short.filter(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    marked = marked.withColumn("h", F.xxhash64("html"))
    share = 1 << 20  # of all hashes in so many parts, those parts that are expected to hold four times the rows: no task sends many
    few = marked.filter(F.pmod("h", F.lit(share)) < -(-4 * rows * share // max(1, marked.count())))
    some = few.orderBy("h", "html").limit(rows).select("html").collect()
    return train(chains_of(list(dict.fromkeys(r.html for r in some)), layouts))


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars): the article of each page, blocks parted by an empty line."""
    field = field or fit(pages)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [field.extract(p) for p in b.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_batches(given, run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
