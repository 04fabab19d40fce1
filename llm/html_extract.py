"""Main text of web pages by tag-path ratios.

A page is a sequence of text blocks, each with its path of tags from the root. For each path the page's blocks
give two ratios: characters a block and punctuation marks a block. Each is fused with its smoothed value over the
page's order, both are fused into one score, and paths whose score reaches a share of the page's mean are content.
Class and id words are a factor of the score, no ban: where all of a page's text has such a name, nothing changes.
The common element of the passing blocks is the article's; generic elements in it whose own scores fail are left out.

Parsing and scoring take time and memory in proportion to the page: elements are numbered in page order and know
their parent, paths are shared, and sums go up and marks go down the numbering.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OTHER_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/<>]*)")
_STOP, _QUOTE_OR_STOP = re.compile(r"[<>]"), re.compile(r"[<>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f\v ]+")
_MARKS = re.compile(r"[.,;:!?…。，、！？；：¿¡]")

# Fixed values of HTML: elements without content, raw text, blocks, and elements that never hold an article's text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head script style template noscript nav footer aside button select textarea option dialog menu iframe object svg math canvas audio video map title".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
LIMIT_OF_CLOSING = frozenset("ul ol dl table body article main section div td".split())
MAY_BE_CLOSED = frozenset("p li dt dd tr td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that declare an article, and those that are parts of one and never hold it whole.
DECLARED = frozenset("article main".split())
PARTS = HEADINGS | frozenset("p pre blockquote ul ol dl li dt dd figure figcaption table caption thead tbody tfoot tr section details summary address hgroup header".split())
ROLES = frozenset("navigation banner contentinfo complementary dialog alert menu menubar".split())
# Words of class and id values that name other parts of a page than its article.
OTHER_PARTS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|notice\w*|alert\w*|popup|modal|overlay|"
    r"nav\w*|menu\w*|breadcrumb\w*|(?<!article-)(?<!entry-)(?<!post-)(?<!content-)header|masthead|topbar|footer|foot|copyright|sidebar\w*|side|aside|widget\w*|related|recommend\w*|"
    r"share\w*|sharing|social\w*|subscribe|subscription|newsletter|signup|login|form|search|comment\w*|disqus|replies|reply|respond|"
    r"reader-?\w*|reaction\w*|tags|toc|pagination|pager|skip\w*|hidden|meta|byline-?tools)(?=$|[\s_-])", re.I)
# Words that tell what a container has beside its article, and words for what readers wrote below it.
BESIDE = re.compile(r"(?:^|(?<=[\s_-]))(?:has|no|with|without)[_-]+\w+", re.I)
OF_READERS = re.compile(r"(?:^|[\s_-])(?:comment\w*|disqus|replies|reply|respond|reader-?\w*|reaction\w*)(?=$|[\s_-])", re.I)
#: What an element's name or kind says: a word for another part, a word for readers' texts, never an article's.
NAMED, READERS, HARD = 1, 2, 3
# Parameters of the scores: factors of names and of the outermost article or main element, share of the mean score that passes, share of the article's
# density below which an element at its edge is another part, and the width of the smoothing.
FACTOR = {NAMED: 0.05, READERS: 0.002}
DECLARED_FACTOR = 20.0
LEAST_FACTOR = 1e-9
PASSING, WEAK = 0.15, 0.25
SMOOTHING = (0.06, 0.24, 0.4, 0.24, 0.06)
# Elements without a meaning of their own; only these and named ones leave an article for a low score.
GENERIC = frozenset("div form center font fieldset".split())


@dataclass
class Page:
    """Elements, numbered in page order after the root 0, and blocks of text, each with its element and link characters."""

    tag: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [0])
    path: list[int] = field(default_factory=lambda: [0])
    kind: list[int] = field(default_factory=lambda: [0])
    factor: list[float] = field(default_factory=lambda: [1.0])
    element: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)

    def ends(self) -> list[int]:
        """The last element within each element."""
        last = list(range(len(self.tag)))
        for e in range(len(last) - 1, 0, -1):
            last[self.parent[e]] = max(last[self.parent[e]], last[e])
        return last

    def ancestors(self, e: int) -> list[int]:
        """The root, ..., ``e``."""
        out = [e]
        while e:
            e = self.parent[e]
            out.append(e)
        return out[::-1]


def _banned(tag: str, attributes: str) -> int:
    if tag in NEVER:
        return HARD
    if tag in ("body", "html", "article", "main"):
        return 0
    kind = NAMED if tag == "form" else 0
    if not attributes.strip():
        return kind
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            words = BESIDE.sub("", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value))
            if OTHER_PARTS.search(words):
                kind = max(kind, READERS if OF_READERS.search(words) else NAMED)
        if name == "role" and value.lower() in ("search", "form"):
            kind = max(kind, NAMED)
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return HARD
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return HARD
    return kind


class _Tags:
    """Finds the end of a tag. Quotes that are never closed, or hold a tag that runs on, count as plain characters."""

    def __init__(self, page: str):
        self.page, self.last, self.failed = page, {q: page.rfind(q) for q in "\"'"}, set()

    def end(self, at: int) -> tuple[int, int]:
        """End of the attributes that begin at ``at``, and where the page goes on."""
        quotes, here = [], at
        while (found := _QUOTE_OR_STOP.search(self.page, here)) is not None:
            mark, place = found[0], found.start()
            if mark == ">":
                return place, place + 1
            # No quote is followed twice, so all searches together are linear.
            if mark == "<" or place in self.failed or place >= self.last[mark]:
                break
            quotes.append(place)
            here = self.page.index(mark, place + 1) + 1
        self.failed.update(quotes)
        found = _STOP.search(self.page, at)
        if found is None:
            return len(self.page), len(self.page)
        return found.start(), found.start() + (found[0] == ">")


@dataclass
class _Open:
    """An open block: its inline elements by tag, each hard or not, and open elements that a like one would close."""

    element: int
    hard: bool
    near: dict[str, int]
    inline: dict[str, list[bool]] = field(default_factory=dict)


def parse(text: str) -> Page:
    """The page's elements and blocks in order, from one pass over its tags; unclosed and stray tags are mended."""
    page, tags, paths = Page(), _Tags(text), {}
    stack = [_Open(0, False, {})]
    opened: dict[str, list[int]] = {}
    parts: list[str] = []
    linked = links = hard = 0

    def flush():
        nonlocal linked
        block = _SPACE.sub(" ", "".join(parts)).strip()
        if block:
            page.element.append(stack[-1].element)
            page.text.append(block)
            page.linked.append(linked)
        parts.clear()
        linked = 0

    def close_to(k: int):
        nonlocal links, hard
        flush()
        while len(stack) > k:
            block = stack.pop()
            opened[page.tag[block.element]].pop()
            hard -= block.hard + sum(sum(flags) for flags in block.inline.values())
            links -= len(block.inline.get("a", ()))

    def say(raw: str):
        nonlocal linked
        if hard:
            return
        raw = html.unescape(raw) if "&" in raw else raw
        parts.append(raw)
        if links:
            linked += len(raw.strip())

    at, end = 0, len(text)
    while at < end:
        less = text.find("<", at)
        if less < 0:
            say(text[at:])
            break
        name = _NAME.match(text, less)
        other = None if name else _OTHER_MARKUP.match(text, less)
        if name is None and other is None:
            say(text[at:less + 1])
            at = less + 1
            continue
        if less > at:
            say(text[at:less])
        if other is not None:
            if other[0].startswith("<![CDATA["):
                say(html.escape(other[0][9:].removesuffix("]]>")))
            at = other.end()
            continue
        stop, at = tags.end(name.end())
        attributes, tag = text[name.end():stop], name[2].lower()
        if name[1]:
            if tag in INLINE:
                flags = stack[-1].inline.get(tag)
                if flags:
                    hard -= flags.pop()
                    links -= tag == "a"
            elif opened.get(tag):
                close_to(opened[tag][-1])
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
            closes = SELF_CLOSING.get(tag, ())
            near = stack[-1].near
            k = max((near[t] for t in (*closes, "p") if t in near and not (t == "p" and tag in VOID)), default=0)
            if k:
                close_to(k)
        if tag in VOID or attributes.rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}[\s/>]|\Z", re.I).search(text, at)
            tail = text.find(">", close.end() - 1) if close.end() > close.start() else end
            at = end if tail < 0 else max(tail + 1, close.end())
            continue
        kind = _banned(tag, attributes)
        if tag in INLINE:
            stack[-1].inline.setdefault(tag, []).append(kind == HARD)
            links += tag == "a"
        else:
            above = stack[-1].element
            page.tag.append(tag)
            page.parent.append(above)
            page.path.append(paths.setdefault((page.path[above], tag, kind), len(paths) + 1))
            page.kind.append(kind)
            raised = DECLARED_FACTOR if tag in DECLARED and not any(map(opened.get, DECLARED)) else 1.0
            page.factor.append(max(LEAST_FACTOR, page.factor[above] * FACTOR.get(kind, raised)))
            near = {} if tag in LIMIT_OF_CLOSING else stack[-1].near
            if tag in MAY_BE_CLOSED:
                near = {**near, tag: len(stack)}
            opened.setdefault(tag, []).append(len(stack))
            stack.append(_Open(len(page.tag) - 1, kind == HARD, near))
        hard += kind == HARD
    flush()
    return page


def _smooth(values: list[float]) -> list[float]:
    """Weighted mean over two neighbours on each side."""
    out = []
    for k in range(len(values)):
        near = [(values[k + d], SMOOTHING[d + 2]) for d in range(-2, 3) if 0 <= k + d < len(values)]
        out.append(sum(v * w for v, w in near) / sum(w for _, w in near))
    return out


def _ratios(page: Page) -> tuple[list[float], list[float]]:
    """A score for each block from the ratios of its path, and one from its own text alone."""
    plain = [max(0, len(t) - a) for t, a in zip(page.text, page.linked, strict=True)]
    marks = [len(_MARKS.findall(t)) if p else 0 for t, p in zip(page.text, plain, strict=True)]
    path = [page.path[e] for e in page.element]
    factor = [page.factor[e] for e in page.element]
    sums: dict[int, list[float]] = {}
    for p, a, b in zip(path, plain, marks, strict=True):
        s = sums.setdefault(p, [0, 0, 0])
        s[0], s[1], s[2] = s[0] + a, s[1] + b, s[2] + 1
    fused = []
    for which in (0, 1):
        ratio = [sums[p][which] / sums[p][2] for p in path]
        fused.append([(a * b) ** 0.5 for a, b in zip(ratio, _smooth(ratio), strict=True)])
    by_block = [a * (b + 0.1) * f for a, b, f in zip(*fused, factor, strict=True)]
    by_path: dict[int, float] = {}
    for p, s in zip(path, by_block, strict=True):
        by_path[p] = by_path.get(p, 0) + s
    own = [a * (b + 0.1) * f for a, b, f in zip(plain, marks, factor, strict=True)]
    return [by_path[p] / sums[p][2] for p in path], own


def _container(page: Page, chosen: list[int]) -> int:
    """The smallest element that holds all of ``chosen`` blocks; the root for the page itself.

    It is no part of an article (a paragraph, quote, list, table or section), no single block of text, and
    nothing below an article or main element.
    """
    held = [page.element[k] for k in chosen]
    first, last = page.ancestors(min(held)), page.ancestors(max(held))
    k = next((k for k, (a, b) in enumerate(zip(first, last, strict=False)) if a != b), min(len(first), len(last))) - 1
    if k and all(e == first[k] for e in held):
        k -= page.tag[first[k]] not in DECLARED
    while k and page.tag[first[k]] in PARTS:
        k -= 1
    return next((e for e in first[:k + 1] if page.tag[e] in DECLARED), first[k])


def _other_parts(page: Page, inside: list[int], passing: list[bool], own: list[float], container: int) -> set[int]:
    """Blocks in generic or named elements below ``container`` that are no part of its article.

    Such an element holds no passing block, or lies before or after all others and its text's mean score is
    below a share of the container's; both means are over characters. An element that stands for a paragraph,
    with a block on the path of one that scores well itself, stays.
    """
    n = len(page.tag)
    score, weight, passed = [0.0] * n, [0.0] * n, [0] * n
    for k in inside:
        e, w = page.element[k], len(page.text[k]) * page.factor[page.element[k]]
        score[e], weight[e], passed[e] = score[e] + own[k] * w, weight[e] + w, passed[e] + passing[k]
    for e in range(n - 1, 0, -1):
        p = page.parent[e]
        score[p], weight[p], passed[p] = score[p] + score[e], weight[p] + weight[e], passed[p] + passed[e]
    least = WEAK * score[container] / weight[container] if weight[container] else 0.0
    good = {page.path[page.element[k]] for k in inside if passing[k] and own[k] >= least}
    paragraphs = {page.element[k] for k in inside if page.path[page.element[k]] in good}
    weak = [0] * n
    for e in range(container + 1, n):
        weak[e] = weak[page.parent[e]]
        if not weak[e] and (page.tag[e] in GENERIC or page.kind[e]) and (
                not passed[e] or e not in paragraphs and weight[e] and score[e] / weight[e] < least):
            weak[e] = e
    strong = [k for k in inside if passing[k] and not weak[page.element[k]]]
    edges = (strong[0], strong[-1]) if strong else (-1, len(page.text))
    return {k for k in inside if (e := weak[page.element[k]]) and (not passed[e] or not edges[0] < k < edges[1])}


def content_blocks(page: Page, ratios=_ratios) -> list[int]:
    """The blocks of the article, by their place.

    A path passes if its score reaches a share of the mean score over the page's characters. The passing blocks
    and a heading just before them give the article's element. Its other blocks come along, but for other parts
    and for link lists away from the article's blocks. Text that is only in named elements counts as an article if
    it has a heading, two blocks of prose or a declared article.
    """
    if not page.text:
        return []
    score, own = ratios(page)
    weight = [len(t) * page.factor[e] for t, e in zip(page.text, page.element, strict=True)]
    least = PASSING * sum(s * w for s, w in zip(score, weight, strict=True)) / sum(weight)
    linky = [a * 2 > len(t) for t, a in zip(page.text, page.linked, strict=True)]
    passing = [s >= least and not y for s, y in zip(score, linky, strict=True)]
    chosen = [k for k, ok in enumerate(passing) if ok]
    if not chosen:
        return []
    parts = _other_parts(page, list(range(len(page.text))), passing, own, 0)
    chosen = [k for k in chosen if k not in parts] or chosen
    heads = [k for k in range(max(0, chosen[0] - 3), chosen[0])
             if page.tag[page.element[k]] in HEADINGS and not page.kind[page.element[k]] and k not in parts]
    container = _container(page, [*heads[-1:], *chosen])
    last = page.ends()[container]
    inside = [k for k, e in enumerate(page.element) if container <= e <= last]
    parts = _other_parts(page, inside, passing, own, container)
    inside = [k for k in inside if k not in parts]
    # Lists of links are the article's own in a declared article, beside its blocks, and between them.
    declared = any(page.tag[e] in DECLARED for e in page.ancestors(container))
    beside = [False] * len(page.tag)
    for k in chosen:
        e = page.element[k]
        if page.tag[e] in PARTS and page.tag[page.parent[e]] not in ("", "body", "html"):
            beside[page.parent[e]] = True
    for e in range(1, len(beside)):
        beside[e] = beside[e] or beside[page.parent[e]]
    out = [k for k in inside if not linky[k] or declared or chosen[0] < k < chosen[-1] or beside[page.element[k]]]
    if all(page.factor[page.element[k]] < 1 for k in out):
        heading = [page.tag[page.element[k]] in HEADINGS for k in out]
        prose = sum(not h and not linky[k] and _MARKS.search(page.text[k]) is not None for h, k in zip(heading, out, strict=True))
        if prose < 2 and not any(heading) and not declared:
            return []
    return out


def main_text(page: str | None) -> str:
    """The article of a page: blocks in page order, one to a line; empty for null and empty pages."""
    parsed = parse(page or "")
    return "\n".join(parsed.text[k] for k in content_blocks(parsed))


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """All columns of ``pages`` and the main text of the whole html; a column named ``text_col`` is replaced.

    Null and empty pages, and pages without an article, give an empty text. Rows are independent of each other.
    """
    kept = [c for c in pages.columns if c != text_col]
    names = [f"_{k}" for k in range(len(kept))]
    at = kept.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x.as_py()) for x in batch.column(at)]
            yield pa.record_batch([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, "_text"])

    inner = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)])
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema), "_text string"])
    return inner.mapInArrow(run, schema).select(
        *[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], F.col("_text").alias(text_col))
