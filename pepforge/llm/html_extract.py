"""Operator 6, HTML extraction: minimum-cut labelling of a page's blocks.

A page is split into blocks of text at block-level tags. A logistic classifier of each block's text and structure (length, links, marks,
tag, what stands beside it) gives the log-odds of being content; they become the capacities of its terminal edges (what it costs to
label it otherwise). Smoothness edges join adjacent blocks and blocks that follow each other in one container, the stronger the nearer
they are in the DOM. The minimum cut, found by maximum flow, is the labelling of least total cost; blocks on the content side are the
main text, in page order.

Containers that tell what they hold (``article`` against ``nav``, ``footer``, ... or telling class names) are two features among the
others, whose weights are learned like theirs; nothing but the classifier's log-odds goes into the terminal edges. A container that is
named like a side part, but holds most of the page and its heading, is a frame and tells nothing.

The classifier is trained by numpy on a sample: at most ``max_blocks`` blocks of each of at most ``max_pages`` pages, chosen by a hash of
page_id, whose containers tell; these are the labels. Each block of the sample is learned twice, once with the two features blank, so
that text and structure are learned for themselves: on a page without telling containers they decide alone.

Blocks without visible text are none; scripts, styles, templates, comments, form fields and hidden elements have no text. Only what
holds no markup (scripts, styles, titles, text areas, frames, noscript) reaches to the end of the page if it isn't closed. Buttons,
selections, objects, drawings and formulas that aren't closed in their container end with it or before the next block-level tag in it,
whichever comes first; templates end with their container.

Defined results: null or empty html gives an empty text; text outside any tag is a block; unclosed and stray tags are tolerated;
repeated rows are extracted each by itself; very long pages are extracted whole; an empty table gives an empty result. Other columns pass
through unchanged, but those named text or n_chars, in any case, are replaced. Rows with a null page_id are extracted but not trained on.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Set

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, small_batches, table
from .flow import Network

#: Comments, tags with their attributes (a value without quotes may hold quotes, a quote that nothing closes is a letter), declarations.
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>=]+|=\s*(?>\"[^\"]*\"|'[^']*'|[^\s>]*))*+)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
#: Elements whose content is no markup: it ends at the closing tag or, without one, with the page.
RAW_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in "script style textarea title noscript iframe".split()}
#: Elements that aren't shown but hold markup, and those of them that ``/>`` closes.
UNSHOWN = frozenset("svg math object select button template".split())
FOREIGN = frozenset("svg math object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the second kind ends where one of the first begins.
ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
P_ENDERS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
FORMATS = INLINE - {"a"}
#: Before these ends an element of UNSHOWN (but template, which may hold any) that has no closing tag in its container.
ENDERS = P_ENDERS | UNSHOWN | {t for t in ENDS if t != "option"}
BAD_TAGS = frozenset("nav footer aside form menu dialog head".split())
BAD_NAMES = re.compile(r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menubar|breadcrumbs?|foot|footer|header|masthead|topbar|toolbar|side|sidebar|aside|rail|widgets?|cookies?|consent|gdpr|notice|notification|alert|banner|popup|modal|overlay|ads?|advert|adverts|advertisement|adbox|sponsor|sponsored|promo|promotion|comments?|commentlist|disqus|respond|replies|reply|share|sharing|social|related|recommended|newsletter|subscribe|subscription|signup|login|search|form|pagination|pager|tags|meta|legal|copyright|skip|contentinfo|complementary|search|hidden|sr-only|visually-hidden)(?:$|[\s_-])|adsbygoogle|cookie|comment|advert|sponsor|newsletter|sidebar|navbar|footer", re.I)
GOOD_NAMES = re.compile(r"(?:^|[\s_-])(?:article|articlebody|article-body|main|content|main-content|post|post-body|entry|entry-content|story|story-body|body|text|page-content)(?:$|[\s_-])|articleBody", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
N_FEATURES = 14
#: How much a telling container counts against the other features, all of which are around 1.
TELLING = 3.0
#: Costs of labelling adjacent blocks differently, and those that follow each other in one container.
NEIGHBOURS, SIBLINGS = 1.0, 1.5
#: The most that the classifier's log-odds count, so that no block outweighs all others.
MOST_COST = 4.0
#: The share of a page's text from which a container is a frame rather than a part.
FRAME = 0.9


class Block:
    __slots__ = ("text", "n_link", "path", "hint", "tag")

    def __init__(self, text: str, n_link: int, path: tuple[int, ...], hint: int, tag: str):
        self.text, self.n_link, self.path, self.hint, self.tag = text, n_link, path, hint, tag


def hint_of(tag: str, attributes: str, inherited: int, in_article: bool) -> tuple[int, bool]:
    """1: the element says that it is content, -1: that it isn't, -2: that it isn't shown, else what holds around it; whether its names
    alone say that it isn't."""
    if inherited == -2:
        return -2, False
    names = ""
    for name, *value in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), "".join(value)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return -2, False
        if name in ("class", "id", "role", "itemprop"):
            names += f" {value}"
    if tag in BAD_TAGS or tag == "header" and not in_article:
        return -1, False
    if names and tag not in ("html", "body") and BAD_NAMES.search(names) and not (tag in ("article", "main") or in_article and tag == "header"):
        return -1, True
    if tag in ("article", "main") or names and tag != "html" and tag != "body" and GOOD_NAMES.search(names):
        return (1 if inherited != -1 else -1), False
    return inherited, False


def blocks_of(html: str | None) -> list[Block]:
    """The page's blocks in order. path: the numbers of the open containers."""
    if not html:
        return []
    out, unclosed, frames = parsed(html, frozenset())
    return parsed(html, unclosed, frames)[0] if unclosed or frames else out


def parsed(html: str, short: Set[int], frames: Set[int] = frozenset()) -> tuple[list[Block], set[int], set[int]]:
    """The blocks, the numbers of the elements of UNSHOWN without a closing tag, and those of frames that are named like side parts.
    short: those of the former that end before a block. frames: elements whose names don't count."""
    out: list[Block] = []
    unclosed: set[int] = set()
    named: dict[int, int] = {}  # characters in elements that are named like side parts
    leading: set[int] = set()  # those that hold a page's heading or main part
    stack: list[tuple[str, int, int]] = []  # tag, number, hint
    pieces: list[str] = []
    n_link = at = 0
    links = articles = 0

    def flush() -> None:
        nonlocal n_link
        if pieces:
            text = " ".join("".join(pieces).split())
            hint = stack[-1][2] if stack else 0
            if text and hint != -2:
                for s in stack if named else ():
                    if s[1] in named:
                        named[s[1]] += len(text)
                holders = [s for s in stack if s[0] not in FORMATS and s[0] != "p" and s[0] not in HEADINGS]
                tag = next((s[0] for s in reversed(stack) if s[0] not in INLINE), "")
                out.append(Block(text, min(n_link, len(text)), tuple(s[1] for s in holders), hint, tag))
            pieces.clear()
        n_link = 0

    def said(raw: str) -> None:
        nonlocal n_link
        if raw:
            text = entities.unescape(raw)
            pieces.append(text)
            if links:
                n_link += len(" ".join(text.split()))

    def close(i: int, closed: int = 0) -> None:
        """Takes the elements from the i-th on off the stack; closed: how many of them have a closing tag."""
        nonlocal links, articles
        for tag, _, _ in stack[i:]:
            links -= tag == "a"
            articles -= tag in ("article", "main")
        unclosed.update(number for tag, number, _ in stack[i + closed :] if tag in UNSHOWN)
        del stack[i:]

    while m := TOKEN.search(html, at):
        said(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag in INLINE:
                        if all(s[0] in INLINE or s[0] in UNSHOWN for s in stack[i:]):
                            if any(s[0] in UNSHOWN for s in stack[i:]):
                                flush()
                            close(i)
                    else:
                        close(i, 1)
                    break
            continue
        empty = m[3].rstrip().endswith("/")
        if tag in RAW_ENDS:
            flush()
            if not (empty and any(s[0] in FOREIGN for s in stack)):
                end = RAW_ENDS[tag].search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag not in INLINE:
            flush()
            if short and tag in ENDERS:
                for i, s in enumerate(stack):
                    if s[1] in short and s[0] != "template":
                        close(i)
                        break
            if tag in P_ENDERS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        close(i)
                        break
                    if stack[i][0] not in FORMATS and stack[i][0] != "a":
                        break
            if tag in ENDS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ENDS[tag].split():
                        close(i)
                        break
                    if stack[i][0] in ("ul", "ol", "dl", "table", "tbody", "thead", "select"):
                        break
        number = m.start() + 1
        if tag in VOID or empty and tag not in P_ENDERS and tag not in INLINE and (tag not in UNSHOWN or tag in FOREIGN or number in short):
            continue
        around = stack[-1][2] if stack else 0
        hint, by_name = (-2, False) if tag in UNSHOWN else hint_of(tag, m[3], around, articles > 0)
        if by_name:
            if number in frames:
                hint = around
            else:
                named[number] = 0
        if named and (tag in ("h1", "main") or tag == "article" and not BAD_NAMES.search(m[3])):
            leading.update(s[1] for s in stack if s[1] in named)
        stack.append((tag, number, hint))
        links += tag == "a"
        articles += tag in ("article", "main")
    said(html[at:])
    flush()
    close(0)
    whole = sum(len(b.text) for b in out)
    return out, unclosed, {n for n in leading if named[n] >= FRAME * whole > 0}


def features(blocks: list[Block]) -> np.ndarray:
    """By block: what its text, its tag, the blocks beside it and its container say."""
    x = np.zeros((len(blocks), N_FEATURES))
    for i, b in enumerate(blocks):
        n = len(b.text)
        words = b.text.count(" ") + 1
        x[i, :8] = (b.n_link / n, np.log1p(words) / 4, words < 5, b.tag == "p", b.tag in HEADINGS, b.tag in ("li", "td", "a"), b.text[-1] in ".!?:…", sum(map(b.text.count, ",.;")) / words)
    x[1:, 8], x[:-1, 9] = x[:-1, 1], x[1:, 1]  # how long the blocks before and after are
    x[1:, 10] = x[:-1, 0]
    x[:, 11] = [TELLING * (b.hint > 0) for b in blocks]
    x[:, 12] = [TELLING * (b.hint < 0) for b in blocks]
    x[:, 13] = 1
    return x


def trained(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.1, ridge: float = 1e-3) -> np.ndarray:
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        g = x.T @ (weight * (p - y)) + ridge * w * (np.arange(len(w)) != N_FEATURES - 1)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def examples(html: str | None, max_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """At most max_blocks features and labels of blocks whose containers tell, evenly over the page; each once so, once as if they didn't."""
    blocks = blocks_of(html)
    x = features(blocks)
    known = np.flatnonzero([b.hint for b in blocks])
    known = known[np.linspace(0, len(known) - 1, min(len(known), max_blocks // 2)).astype(int)] if len(known) else known
    seen, blank = x[known], x[known]
    blank[:, 11:13] = 0
    return np.concatenate([seen, blank]), np.array([blocks[i].hint > 0 for i in known] * 2, float)


def fit(pages: DataFrame, max_pages: int = 1500, max_blocks: int = 200, seed: int = 5) -> np.ndarray:
    """The classifier's weights; without examples of both kinds, none (then nothing is content)."""
    small_batches(pages.sparkSession)
    chosen = pages.select("page_id").filter("page_id IS NOT NULL").distinct().orderBy(F.xxhash64(F.col("page_id"), F.lit(seed)), "page_id").limit(max_pages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [examples(h, max_blocks) for h in b.html]
            yield pd.DataFrame({"x": [x.astype(np.float32).tobytes() for x, _ in found], "y": [y.astype(np.int8).tobytes() for _, y in found]})

    rows = pages.select("page_id", F.col("html").cast("string").alias("html")).join(F.broadcast(chosen), "page_id", "left_semi").groupBy("page_id").agg(F.min("html").alias("html"))
    read = rows.select("html").mapInPandas(run, "x binary, y binary").toPandas().sort_values(["x", "y"])
    x = np.concatenate([*(np.frombuffer(v, np.float32).reshape(-1, N_FEATURES) for v in read.x), np.zeros((0, N_FEATURES))]).astype(float)
    y = np.concatenate([*(np.frombuffer(v, np.int8) for v in read.y), np.zeros(0)])
    if not (0 < y.sum() < len(y)):
        return np.zeros(N_FEATURES)
    return trained(x, y)


def block_costs(blocks: list[Block], weights: np.ndarray) -> np.ndarray:
    """The classifier's log-odds of being content."""
    return np.clip(features(blocks) @ weights, -MOST_COST, MOST_COST)


def labelled(blocks: list[Block], weights: np.ndarray) -> list[bool]:
    """Which blocks are content."""
    cost = block_costs(blocks, weights).tolist()
    n = len(blocks)
    net = Network(n + 2)
    last: dict[int, int] = {}
    for i, (b, c) in enumerate(zip(blocks, cost, strict=True)):
        net.join(n, i, c) if c > 0 else net.join(i, n + 1, -c)
        if i:
            shared = sum(x == y for x, y in zip(b.path, blocks[i - 1].path, strict=False))
            apart = len(b.path) + len(blocks[i - 1].path) - 2 * shared
            net.join(i - 1, i, NEIGHBOURS / (1 + apart), NEIGHBOURS / (1 + apart))
        holder = b.path[-1] if b.path else 0
        if holder in last:
            net.join(last[holder], i, SIBLINGS, SIBLINGS)
        last[holder] = i
    return net.source_side(n, n + 1)[:n]


def main_text(html: str | None, weights: np.ndarray) -> str:
    blocks = blocks_of(html)
    return " ".join(b.text for b, good in zip(blocks, labelled(blocks, weights), strict=True) if good) if blocks else ""


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """pages with text, the main text of html, and n_chars."""
    weights = fit(pages) if weights is None else weights
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda h: main_text(h, weights), na_action=None).astype(object)

    (new,) = fresh(pages, "main_text")
    keep = [quoted(c) for c in pages.columns if c.lower() not in ("text", "n_chars")]
    found = pages.withColumn(new, run(F.col("html").cast("string")))
    return found.select(*keep, F.col(new).alias("text"), F.length(new).cast("long").alias("n_chars"))


def op6_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
