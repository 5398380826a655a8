"""HTML extraction by line-block distribution.

A page becomes a list of lines, one for each block of text in page order, each with its length. Lines of markup that is
no article text (menus, page headers and footers, sidebars, notices, adverts, forms, reader comments, scripts and
styles) count with length 0, as do lines that are mostly links. Lengths are summed over windows of three lines, over
the whole page. A surge is where the sum reaches the threshold (80 characters, or the greatest sum if that is less)
after nothing, a dive where it falls back to nothing; the stretch between with the most text is where the article is.

If most of that stretch's text lies in an article or main element, the article is what the page declares as such, and
all its lines stay but those of the markup named above. Otherwise (no such element, or a teaser or an empty one) the
article is what lies between all surges and dives, without what is declared elsewhere, and with the lines around: those
of the innermost container that holds the stretch, so that a short title or a last line that furniture cuts off stays.

Character references are decoded, white space inside a block (a line break included) becomes one space, blocks are
joined by one newline, and nothing else is dropped or cut. Cells of a table row are one block. A formula's text is
text; its annotations are not.

Defined cases: null or empty html gives an empty text; markup that doesn't close is closed by the end of the page; a
``<`` that opens no tag is text; repeated rows keep a row each; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*+)>"
    r"|<[!?/][^>]*>|(?P<text>[^<]+)|<",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Element and class names of HTML pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template svg object select canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
#: Parts of a formula that are not its text.
FORMULA_RAW = frozenset("annotation annotation-xml text".split())
CONTAINERS = frozenset("article body center div html main section table td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("head nav footer aside form menu dialog button search".split())
PAGE_PART = frozenset("header".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb"
    " breadcrumbs sidebar aside footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription"
    " signup login share sharing social related recommended comment comments disqus respond replies pagination pager toolbar widget skip"
    " copyright masthead form search".split()
)
#: Words that a part's name has beside those.
PART_WORDS = frozenset(
    "area article bar block body bottom box btn button buttons card center column container content desktop entry global group header holder icon icons"
    " inline inner item items left link links list main mobile module outer page panel post posts primary right row secondary section site slot small"
    " sticky thread title top unit wrap wrapper zone".split()
)
PAGE_MARKS = frozenset("header topbar".split())
MARK_BEGINNINGS = tuple("comment sidebar advert cookie newsletter breadcrumb navbar navigation sponsor footer".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}
WINDOW, SURGE = 3, 80
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Names that say what a part has or lacks, not what it is.
LAYOUT = re.compile(r"\b(?:has|with|without|no|is)-\S+|\S+-(?:free|open|closed|enabled|disabled)\b", re.I)


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)} if text.strip() else {}


def named_as_furniture(names: str, in_article: bool) -> bool:
    """Whether class names and an id name a part without article text.

    Within an article each word of a name must tell of one (``related-posts``, but not ``related-work``).
    """
    for name in LAYOUT.sub(" ", names).split():
        words = {x.lower() for x in NAME.findall(name)}
        marks = {x for x in words if x in MARKS or x.startswith(MARK_BEGINNINGS) or not in_article and x in PAGE_MARKS}
        if marks and not (in_article and any(not x.isdigit() and x not in PART_WORDS for x in words - marks)):
            return True
    return False


def unwanted(name: str, attrs: dict[str, str], in_article: bool, by_class: bool) -> bool:
    """Whether an element holds no article text."""
    if name in DROPPED or name in PAGE_PART and not in_article or "hidden" in attrs:
        return True
    if attrs.get("role", "").lower() in ROLES or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if not by_class or name in ("html", "body", "main") or name == "article" and not in_article:
        return False
    own = "" if name in HEADINGS else attrs.get("id", "")  # a heading's id is made of its words
    return named_as_furniture(f"{attrs.get('class', '')} {own}", in_article)


@dataclass(slots=True)
class Line:
    text: str
    #: As article text: none for furniture and for lines that are mostly links.
    length: int
    marked: bool
    #: Whether in an article or main element.
    declared: bool
    node: int


@dataclass
class Page:
    """Lines, and the elements they lie in: numbered as they open, 0 the page; ``last`` the last that opened in each."""

    lines: list[Line] = field(default_factory=list)
    kind: list[str] = field(default_factory=lambda: ["html"])
    parent: list[int] = field(default_factory=lambda: [0])
    last: list[int] = field(default_factory=lambda: [0])

    def container(self, first: int, last: int) -> int:
        """The innermost container of two elements, the one of less number first."""
        node = first
        while node and (self.last[node] < last or self.kind[node] not in CONTAINERS):
            node = self.parent[node]
        return node


def parsed(text: str, by_class: bool = True) -> Page:
    page = Page()
    stack: list[tuple[str, bool, bool, int]] = []  # name, dropped here, article here, number
    dropped = articles = links = formulas = 0
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            line = " ".join("".join(parts).split())
            if line:
                length = 0 if dropped or linked * 2 > len(line) else len(line)
                page.lines.append(Line(line, length, dropped > 0, articles > 0, stack[-1][3] if stack else 0))
        parts, linked = [], 0

    def pop() -> None:
        nonlocal dropped, articles, links, formulas
        name, was_dropped, was_article, node = stack.pop()
        page.last[node] = len(page.kind) - 1
        dropped -= was_dropped
        articles -= was_article
        links -= name == "a"
        formulas -= name == "math"

    at, end, match = 0, len(text), TOKEN.match
    while at < end:
        m = match(text, at)
        at = m.end()
        plain = m["text"]
        if plain is not None or m.end() == m.start() + 1:
            plain = entities.unescape(m[0])
            parts.append(plain)
            if links:
                linked += len(plain)
            continue
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name = name.lower()
        closing = m["end"] or m["end2"]
        if name == "br":
            parts.append(" ")
            continue
        if name in ("td", "th"):
            parts.append(" ")
        if name in BLOCK:
            flush()
        if closing:
            if any(x[0] == name for x in stack):
                if name in BLOCK or name in ("td", "th"):
                    while stack[-1][0] != name:
                        pop()
                    pop()
                else:
                    last = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)
                    if not any(x[0] in BLOCK for x in stack[last + 1 :]):
                        while len(stack) > last:
                            pop()
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if (name == "svg" or formulas) and attrs.endswith("/"):  # the only raw elements that a tag may close itself
            continue
        if name in RAW or formulas and name in FORMULA_RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(text, at)
            at = close.end() if close else end
            continue
        if name in VOID or attrs.endswith("/") and name not in BLOCK:
            continue
        if name == "body":  # a head that is not closed ends here
            while stack and stack[-1][0] != "html":
                pop()
        if name in BLOCK and name not in ("li", "dt", "dd", "tr", "body", "html"):
            while stack and stack[-1][0] not in BLOCK and stack[-1][0] not in ("td", "th") and any(x[0] == "p" for x in stack):
                pop()
            if stack and stack[-1][0] == "p":
                pop()
        if stack and stack[-1][0] in CLOSES.get(name, ()):
            pop()
        drops = not dropped and unwanted(name, attributes(attrs), articles > 0, by_class)
        holds = not dropped and not drops and name in ("article", "main")
        page.kind.append(name)
        page.parent.append(stack[-1][3] if stack else 0)
        page.last.append(0)
        stack.append((name, drops, holds, len(page.kind) - 1))
        dropped += drops
        articles += holds
        links += name == "a"
        formulas += name == "math"
    flush()
    while stack:
        pop()
    page.last[0] = len(page.kind) - 1
    return page


def stretches(lengths: Sequence[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """(first line, line after the last) of what lies between the surges and dives of the windows' sums."""
    totals = [0]
    for length in lengths:
        totals.append(totals[-1] + length)
    n = len(lengths)
    sums = [totals[min(i + window, n)] - totals[i] for i in range(n)]
    if not any(sums):
        return []
    surge = min(surge, max(sums))
    found, at = [], 0
    while at < n:
        if sums[at] < surge:
            at += 1
            continue
        dive = at
        while dive < n and sums[dive]:
            dive += 1
        found.append((at, dive))
        at = dive
    return found


def kept_lines(page: Page) -> list[str]:
    """The article's lines."""
    lines = page.lines
    found = stretches([x.length for x in lines])
    if not found:  # nothing but links and furniture: what an article declares
        return [x.text for x in lines if x.declared and not x.marked]
    best = max(found, key=lambda x: sum(y.length for y in lines[slice(*x)]))
    article = [x for x in lines[slice(*best)] if x.length]
    declared = sum(x.length for x in article if x.declared)
    if declared * 2 >= sum(x.length for x in article):
        return [x.text for x in lines if x.declared and not x.marked]
    nodes = [x.node for x in article if not x.declared]
    low = page.container(min(nodes), max(nodes))
    inside = [False] * len(lines)
    for first, dive in found:
        inside[first:dive] = [True] * (dive - first)
    return [x.text for x, between in zip(lines, inside, strict=True) if x.length and not x.declared and (between or low <= x.node <= page.last[low])]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(kept_lines(parsed(page)) or kept_lines(parsed(page, by_class=False)))


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    kept = pages.select("page_id", "url", "html")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            columns = [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return kept.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
