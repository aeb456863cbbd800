"""Main text of HTML pages by tag-path ratios.

A page becomes a list of text nodes, each with its root-to-leaf tag path (element names, classes and ids). Per path the
page's text length, punctuation and tags are added up; text a tag and punctuation a tag are its ratios. Ratios are
lessened by what the words of the path's classes say about its role (PRIOR for each), smoothed over the paths before and
after it in page order, and fused into one score; menus, headers, footers, asides, forms and scripts are no content
whatever their ratios.

Paths are judged by the unit they belong to: the outermost article or main element, elsewhere the nearest branch (div,
section, td ...). A unit's score is that of its best path, and units that reach SHARE of the best unit's score are
content. If the best unit is an article, units outside articles are not: what surrounds it may have long texts, too. So an
article gives way only to a unit that is better in several respects: no class, id or heading tells that it is something else
(readers' comments, notices), its score is OUTDONE times as high, and it comes first or has the title. A
unit that is content keeps all its text, however short, but for parts that their own classes mark as something else.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import kind_of, table

#: Share of the best unit's score that a unit needs, weight of each neighbour in smoothing, and factor of a telling class.
SHARE, SMOOTH, PRIOR = 0.25, 0.1, 0.002

# Fixed values of HTML: raw-text elements, void elements, inline elements, what a start tag closes.
RAW = ("script", "style", "textarea", "noscript", "template", "svg", "iframe")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img math semantics mrow mi mn mo ms mtext mfrac msqrt mroot msup msub msubsup munder mover munderover".split())
CLOSES_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BRANCHES = frozenset("html body main article section div td blockquote".split())
NOT_CONTENT = frozenset("head nav header footer aside form button select dialog menu title script style".split())
#: Words that whole classes, ids and roles of such parts are made of: cookie-notice, but not has-sidebar.
NOT_CONTENT_WORDS = re.compile(
    r"(?:(?:^|[_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menus?|breadcrumbs?|header|masthead|footer|side-?bar|comments?|disqus|replies|respond|cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|share|sharing|social|related|widget|contentinfo|complementary|search|form)(?=$|[_-]))+",
    re.I,
)
#: Parts of hyphenated names that tell of readers' words or of notices, unless a part says that they are only allowed or left out.
TELLING_PARTS = frozenset("comment comments commentlist disqus reply replies respond notice notices disclaimer legal cookie cookies consent gdpr newsletter sponsor sponsored".split())
MERELY = frozenset("no not has with without open opened closed allow allowed enabled disabled".split())
#: Headings of readers' words.
READERS = re.compile(r"(?:\(?\d+\)?\s+)?(?:(?:reader|user|visitor)s?['’]?s?\s+)?(?:comments?|replies|responses to)\b.{0,40}|(?:leave|post|write|add) an?\s+(?:reply|comment)\b.{0,20}|join the (?:conversation|discussion)\b.{0,20}", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset(("article", "main"))
#: How many times an article's score a unit outside must reach to be the content instead.
OUTDONE = 4

#: Attributes; a quote that is never closed is a character like others. Nothing is tried twice, so time is linear.
_INSIDE = r"(?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<svg\b(?>[^>\"'/]+|\"[^\"]*\"|'[^']*'|/(?!>)|[\"'])*+/>|<(" + "|".join(RAW) + r")\b[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)(" + _INSIDE + r")(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)(?=\s|$)", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。、]")


def _tells(word: str, name: str) -> bool:
    """Whether a class, id or role says that its element is no content. An article is only what its name begins with."""
    parts = re.split(r"[-_]+", word)
    if name in CONTENT:
        return name == "article" and parts[0] in ("comment", "reply")
    return bool(NOT_CONTENT_WORDS.fullmatch(word)) or not (TELLING_PARTS.isdisjoint(parts) or MERELY.intersection(parts))


def _role(name: str, attributes: str) -> tuple[str, bool, bool]:
    """The path step of a start tag, whether what it holds can't be content, and whether its classes say so."""
    step, never, told = name, name in NOT_CONTENT, False
    if attributes.strip():
        for kind, a, b, c, hidden in _ATTRIBUTE.findall(attributes):
            value, kind = (a or b or c).lower(), kind.lower()
            if hidden or (kind == "aria-hidden" and value == "true") or (kind == "style" and re.search(r"display\s*:\s*none", value)):
                never = True
            elif kind in ("class", "id", "role"):
                step += "." + ".".join(value.split())
                told |= name not in ("html", "body") and any(_tells(word, name) for word in value.split())
    return step, never, told


@dataclass
class Path:
    """One tag path of a page, reached from its parent by a step, with what the page has on it."""

    name: str
    parent: int
    unit: int
    inside: bool
    never: bool
    told: int
    tags: int = 0
    chars: int = 0
    marks: int = 0


def text_nodes(page: str) -> tuple[list[list], list[Path]]:
    """[block number, path, text] of each text node in page order; the paths.

    A p ends where the next block begins, as in a browser; end tags that nothing opened are ignored. Paths are kept as
    places in a list, so deep pages cost no more than others of their length.
    """
    nodes: list[list] = []
    paths = [Path("", 0, 0, False, False, 0)]
    place: dict[tuple[int, str], int] = {}
    stack: list[tuple[str, int]] = []  # name, path
    opened: Counter[str] = Counter()
    block = at = 0

    def add(text: str) -> None:
        if text.strip():
            nodes.append([block, stack[-1][1] if stack else 0, html.unescape(text)])
        elif text and nodes and nodes[-1][0] == block:
            nodes[-1][2] += " "

    def close(names: tuple[str, ...], within: frozenset[str]) -> None:
        if not any(opened[x] for x in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                opened.subtract(x for x, _ in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in within:
                return

    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if m[2]:
            block += name not in INLINE
            close((name,), frozenset())
        elif name:  # what isn't shown doesn't part blocks
            if name == "br":
                add(" ")
                continue
            if name not in INLINE:
                block += 1
                close(("p",), BRANCHES)
                if name in CLOSES_ITSELF:
                    close(CLOSES_ITSELF[name], frozenset(("ul", "ol", "dl", "table", "select")))
            step, never, told = _role(name, m[4] or "")
            above = stack[-1][1] if stack else 0
            here = place.setdefault((above, step), len(paths))
            if here == len(paths):
                up = paths[above]
                own = not up.inside and (name in CONTENT or name in BRANCHES)
                paths.append(Path(name, above, here if own else up.unit, up.inside or name in CONTENT, up.never or never, up.told + told))
            paths[here].tags += 1
            if name not in VOID and not (m[4] or "").endswith("/"):
                stack.append((name, here))
                opened[name] += 1
    add(page[at:])
    return nodes, paths


def _told_by_headings(nodes: list[list], paths: list[Path]) -> None:
    """A div or section of its own path that has a heading of readers' words is told, with all that it holds."""
    told = set()
    for _, at, text in nodes:
        above = paths[at].parent
        if paths[at].name in HEADINGS and paths[above].name in ("div", "section", "aside") and paths[above].tags == 1 and READERS.fullmatch(" ".join(text.split())):
            told.add(above)
    more = [0] * len(paths)
    for x in range(1, len(paths)) if told else ():  # parents come before their children
        more[x] = more[paths[x].parent] + (x in told)
        paths[x].told += more[x]


def _outdone(article: int, other: int, units: dict[int, float], paths: list[Path], listed: list[int]) -> bool:
    """Whether a unit outside articles is the content although there is an article: it isn't told to be something else, has
    far better ratios, and stands before the article or has the page's title."""
    if paths[article].told:
        return True
    of_other = [x for x in listed if paths[x].unit == other]
    first = next(x for x in listed if paths[x].unit in (article, other))
    title = any(paths[x].name == "h1" for x in of_other)
    return not paths[other].told and units[other] >= OUTDONE * units[article] and (title or paths[first].unit == other)


def _content_paths(nodes: list[list], paths: list[Path]) -> set[int]:
    _told_by_headings(nodes, paths)
    order: dict[int, None] = {}  # in page order
    for _, at, text in nodes:
        if not paths[at].never:
            order[at] = None
            paths[at].chars += len(text.strip())
            paths[at].marks += len(_PUNCTUATION.findall(text))
    listed = list(order)
    lessened = [PRIOR ** min(40, paths[x].told) / max(1, paths[x].tags) for x in listed]  # before smoothing: a sidebar lifts no neighbour
    ratios = [(paths[x].chars * less, paths[x].marks * less) for x, less in zip(listed, lessened, strict=True)]
    units: dict[int, float] = {}
    for i, x in enumerate(listed):
        near = ratios[max(0, i - 1) : i] + ratios[i + 1 : i + 2]
        text, marks = ((1 - SMOOTH * len(near)) * ratios[i][k] + SMOOTH * sum(r[k] for r in near) for k in (0, 1))
        unit = paths[x].unit
        units[unit] = max(units.get(unit, 0.0), text * (1 + marks))
    best = max(units, key=units.get, default=0)
    article = max((u for u in units if paths[u].inside), key=units.get, default=best)
    if article != best and not paths[best].inside and not _outdone(article, best, units, paths, listed):
        best = article
    good = {u for u, score in units.items() if score >= SHARE * units[best] and paths[u].inside >= paths[best].inside}
    held = [False] * len(paths)  # all that the best unit holds belongs to it
    for x in range(1, len(paths)):  # parents come before their children
        held[x] = x == best or held[paths[x].parent]
    # classes inside a unit tell what of it is something else
    return {x for x in listed if (paths[x].unit in good and paths[x].told <= paths[paths[x].unit].told) or (held[x] and paths[x].told <= paths[best].told)}


def main_text(page: str | None) -> str:
    """Content blocks of the page, white space folded, joined by newlines; empty if there are none."""
    nodes, paths = text_nodes(page or "")
    content = _content_paths(nodes, paths)
    blocks: dict[int, list[str]] = {}
    for block, path, text in nodes:
        if path in content:
            blocks.setdefault(block, []).append(text)
    return "\n".join(t for t in (" ".join("".join(b).split()) for b in blocks.values()) if t)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row; null and empty html give an empty text.

    Repeated rows each get a row; an empty table gives an empty result. Of units with equal scores the first in page
    order is the best. Only the three columns are read; ids may be of any type.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract, f"page_id {kind_of(rows, 'page_id')}, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
