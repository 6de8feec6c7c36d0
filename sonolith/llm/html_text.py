"""Operator 3: main text of web pages by two-pass block rules."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sonolith.llm.textops import trimmed
from sonolith.session import table

# Stop words of the languages in scope.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be been but by can could did do for from had has have he her him his how
    i if in into is it its more my no not of on one or our out she so some than that the their them then there they this
    to up was we were what when which who will with would you your
    aber als am auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einen einer er es für hat ich
    ihr im ist ja kann man mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir
    wird zu zum zur
    au aux avec ce cette comme dans de des du elle en est et eu il je la le les leur lui mais ne nous on ou où par pas plus
    pour qu que qui sa se ses son sur tu un une vous y
    al como con cuando del desde donde el ella en entre era es esta este ha hay la las lo los me mi muy no nos o para pero
    por porque que se si sin sobre su sus también te todo un una y ya""".split()
)
#: Elements that end a block, that hold no text of a page, and whose content is no main text.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section
    summary table tbody td tfoot th thead title tr ul""".split()
)
RAW = "script|style|noscript|template|textarea|svg|math|iframe|object|canvas|audio|video|select|title"
SIDE = frozenset("nav header footer aside menu dialog button fieldset search label input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose blocks mostly follow each other in one box.
FLOW = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd tr td th option".split())
#: Words of class, id and role that mark what is no main text.
SIDE_NAMES = re.compile(
    r"(?:ad|ads|adv|advert\w*|adbox|adslot|adsby\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice\w*|alert|"
    r"nav\w*|menu\w*|breadcrumbs?|sidebar|side|aside|rail|widget\w*|footer|header|masthead|topbar|toolbar|"
    r"comments?|commentlist|disqus|respond|replies|reactions|discussion|share|sharing|social|related|recommend\w*|"
    r"newsletter|subscri\w+|signup|login|popup|modal|overlay|pager|pagination|skip|search|form|contentinfo|complementary|navigation)"
)
#: Words that say no more than where or in what box something is: a name is of no main text if it has one of the words
#: above and otherwise only these. So `reader-comments` is, and `comments-open` or `has-sidebar` is not.
PLACES = frozenset(
    """area bar block bottom box button buttons container global group inner item items left link links list main outer
    page panel post posts primary reader right row secondary section site slot thread top unit user wrap wrapper""".split()
)
#: Elements that names do not mark as no main text.
NEVER_SIDE = frozenset("html body main article".split())
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|articlebody|post|entry|story|main|content|body|text)(?=$|[\s_-])")
#: Attributes up to the end of a tag. A quote opens a value only after an equals sign, and only if the value ends where
#: an attribute can end; else it is a character like any other, so an unbalanced one does not swallow what follows.
_ATTRIBUTES = r"""((?:[^>"'=]++|=\s*+(?:"[^"]*+"(?=[\s/>]|\Z)|'[^']*+'(?=[\s/>]|\Z))|["'=])*+)"""
#: Possessive throughout: each token is found without going back, so a page takes time in proportion to its length.
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<({RAW})(?=[\s/>]){_ATTRIBUTES}(?:(?<=/)>|>.*?(?:</\1\s*+>|\Z)|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*+){_ATTRIBUTES}(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?![\w-])(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
EDGE = re.compile(r"^\W+|\W+$")

#: Thresholds: words of a short and of a long block, shares of stop words, share of link characters.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS = 10, 25, 0.08, 0.2, 0.4
#: Scores from which a block is main text or none in the first pass; what markup adds inside and outside the part of a
#: page that holds its prose; how much farther a neighbour counts whose label the markup speaks against.
KEEP, DROP, INSIDE, OUTSIDE, FARTHER = 2, -2, 1, -2, 3


@dataclass
class Block:
    """A run of text between block borders. side: whether it lies in an element of no main text; box: the innermost
    element around it that is marked as main text (0: none); mark: the innermost one that a name marks as none."""

    text: str
    link_chars: int
    side: bool
    box: int
    heading: bool
    mark: int = 0

    def __post_init__(self) -> None:
        words = self.text.split()
        self.words = len(words)
        self.links = self.link_chars / max(1, sum(map(len, words)))
        self.stop = sum(EDGE.sub("", w.lower()) in STOP_WORDS for w in words) / max(1, self.words)

    @property
    def prose(self) -> bool:
        """Whether it reads as running text: long with some stop words, or with many."""
        return not self.heading and self.links <= LINKS and (self.words >= LONG and self.stop >= STOP_LOW or self.words >= SHORT and self.stop >= STOP_HIGH)


@dataclass
class Page:
    """Blocks in order; boxes of main text as (whether an article, box around it), marks as (mark around it, whether it
    holds a main element, an article); the first of both stands for none."""

    blocks: list[Block]
    boxes: list[tuple[bool, int]]
    marks: list[list]


def _side_name(value: str) -> bool:
    """Whether one of the names in a lower-case class, id or role is one of no main text, as a whole."""
    for name in value.split():
        words = [w for w in re.split(r"[_-]+", name) if w]
        side = [bool(SIDE_NAMES.fullmatch(w)) for w in words]
        if any(side) and all(s or w in PLACES or w.isdigit() for s, w in zip(side, words, strict=True)):
            return True
    return False


def _names(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is hidden, whether a name marks it as no main text, whether as main text."""
    hidden, side, main = False, tag == "form", tag in ("article", "main")
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values).lower(), name.lower()
        if name == "style":
            hidden |= bool(HIDDEN.search(value))
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value == "true"
        else:
            side |= tag not in NEVER_SIDE and _side_name(value)
            main |= tag in ("div", "section", "td") and bool(MAIN_NAMES.search(value))
    return hidden, side, main and not side


def parse(page: str) -> Page:
    """The page's blocks. An end tag closes what is open inside its element; one that opens nothing is dropped, and so is
    a tag that the page's end cuts off. A header in an article or main element is a part of it."""
    found = Page([], [(False, 0)], [[0, False, False]])
    stack: list[tuple[str, bool, int, int]] = [("", False, 0, 0)]  # of elements that can hold blocks: tag, side, box, mark
    opened: Counter[str] = Counter()
    parts: list[str] = []
    links, anchor, heading, breaks = 0, False, False, 0

    def close() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            _, side, box, mark = stack[-1]
            found.blocks.append(Block(text, min(links, len(text)), side, box, heading, mark))
        parts.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links, breaks
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            if anchor:
                links += len("".join(text.split()))
            if not text.isspace():
                breaks = 0

    def pop() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    def push(tag: str, marks: tuple[bool, bool, bool]) -> None:
        _, side, box, mark = stack[-1]
        hidden, named, main = marks
        side = side or hidden or tag in SIDE and not (tag == "header" and box and found.boxes[box][0])
        if tag in ("main", "article") and not side:
            found.marks[mark][1 if tag == "main" else 2] = True
        if named:
            found.marks.append([mark, False, False])
            mark = len(found.marks) - 1
        if main:
            found.boxes.append((tag == "article", box))
            box = len(found.boxes) - 1
        stack.append((tag, side, box, mark))
        opened[tag] += 1

    at = 0
    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        if m[1] is not None or m[4] is None:
            continue
        ending, tag, attributes = bool(m[3]), m[4].lower(), m[5]
        if tag == "a":
            anchor = not ending
        elif tag == "br":
            parts.append(" ")
            breaks += 1
            if breaks == 2:
                close()
        elif tag in BLOCKS or tag in SIDE and tag not in VOID or tag in ("span", "center") and not ending and ATTRIBUTE.search(attributes):
            marks = (False, False, False) if ending or tag == "span" and not attributes else _names(tag, attributes)
            if tag == "span" and not any(marks):
                continue
            close()
            breaks = 0
            if tag in FLOW and not any(marks):
                heading = tag[0] == "h" and not ending
                anchor = anchor and tag not in ("p", "li")
                if stack[-1][0] == tag:
                    pop()
                continue
            heading = False
            if ending:
                while opened[tag] and pop() != tag:
                    pass
                anchor = False
            elif tag not in VOID:
                push(tag, marks)
        elif tag == "span" and ending and stack[-1][0] == "span":
            close()
            pop()
    add(page[at:] if not re.match(r"<[a-zA-Z/!]", page[at:]) else "")
    close()
    return found


def _mass(found: list[Block]) -> int:
    return sum(b.words for b in found if b.prose)


def _settle_marks(page: Page) -> None:
    """Makes the blocks side that a name marks, but not those of a name around a main element; nor, where an article
    outside all such names has no text, of one around an article; nor those of names, if these hold most of the page and
    no other block is prose or in a box of main text."""
    for mark in range(len(page.marks) - 1, 0, -1):
        up, main, article = page.marks[mark]
        page.marks[up][1] |= main
        page.marks[up][2] |= article

    def hit(articles: bool) -> list[bool]:
        out = [False]
        for up, holds_main, holds_article in page.marks[1:]:
            out.append(out[up] or not (holds_main or articles and holds_article))
        return out

    marked, article = hit(False), _articles(page)
    if not any(article[b.box] and not b.side and not marked[b.mark] for b in page.blocks):
        marked = hit(True)
    free = [b for b in page.blocks if not b.side]
    rest = [b for b in free if not marked[b.mark]]
    if _mass(rest) == 0 and not any(b.box for b in rest) and _mass(free) * 2 > sum(b.words for b in free):
        return
    for b in page.blocks:
        b.side = b.side or marked[b.mark]


def _articles(page: Page) -> list[bool]:
    """By box, whether it is an article or in one."""
    out = [False]
    for article, up in page.boxes[1:]:
        out.append(article or out[up])
    return out


def _inside(page: Page) -> list[bool] | None:
    """By block, whether it lies in the part of the page that is marked as main text and holds half of the prose or more:
    articles, else other boxes of main text; None if there is no such part. Articles in an article that has prose of its
    own are comments on it."""
    article, nested, outer = _articles(page), [False], [0]
    for k, (own, up) in enumerate(page.boxes[1:], 1):
        outer.append(outer[up] or (k if own else 0))  # the outermost article
        nested.append(nested[up] or own and article[up])
    prose = {outer[b.box] for b in page.blocks if b.prose and not b.side and not nested[b.box]}
    free = [b for b in page.blocks if not b.side]
    mass = _mass if any(b.prose for b in free) else lambda bs: sum(b.words for b in bs if b.links <= LINKS)
    for part in (
        [article[b.box] and not (nested[b.box] and outer[b.box] in prose) for b in page.blocks],
        [b.box > 0 and not all_articles for b, all_articles in zip(page.blocks, _only_articles(page), strict=True)],
    ):
        held = mass([b for b, i in zip(page.blocks, part, strict=True) if i and not b.side])
        if held and held * 2 >= mass(free):
            return part
    return None


def _only_articles(page: Page) -> list[bool]:
    """By block, whether all boxes around it are articles."""
    only = [True]
    for article, up in page.boxes[1:]:
        only.append(article and only[up])
    return [only[b.box] for b in page.blocks]


def classify(page: Page) -> list[bool]:
    """Whether each block is main text.

    First pass: a block's score by its text - 3 for long prose with many stop words, 2 for other prose, -3 for one that is
    mostly links, -2 for one of middling length with few stop words, 0 for short ones, headings and what is between -
    and by markup: INSIDE or OUTSIDE, where a part of the page is marked as main text and holds most prose. Blocks of
    KEEP and more are main text, of DROP and less none, the others stay open; side blocks are none.
    Second pass: an open block takes the label of the nearest decided block before or after it in the same part of the
    page, where a neighbour whose label the markup speaks against is FARTHER times as far; at the same distance that of
    the markup, without markup that after it for a heading, else none. In a part without decided blocks the markup
    decides, and a page without any is main text.
    """
    _settle_marks(page)
    found, inside = page.blocks, _inside(page)
    label: list[bool | None] = []
    for k, b in enumerate(found):
        if b.links > LINKS and not (inside and inside[k] and b.words > LONG):
            score = -3
        elif b.prose:
            score = 3 if b.words >= LONG and b.stop >= STOP_HIGH else 2
        elif b.heading or b.words < SHORT or b.stop >= STOP_LOW or b.words >= LONG:
            score = 0
        else:
            score = -2
        if inside:
            score += INSIDE if inside[k] else OUTSIDE
        label.append(False if b.side or score <= DROP else True if score >= KEEP else None)
    out = [bool(x) for x in label]
    for part in (True, False) if inside else (None,):
        # side blocks say nothing of the text around them where the markup tells what that is
        own = [k for k, b in enumerate(found) if part is None or inside[k] == part and not b.side]
        _inherit(found, label, own, part, out)
    return out


def _inherit(found: list[Block], label: list[bool | None], own: list[int], prior: bool | None, out: list[bool]) -> None:
    """Sets out for the open blocks of own, by their decided neighbours."""
    after: list[int | None] = [None] * (len(own) + 1)
    for i in range(len(own) - 1, -1, -1):
        after[i] = i if label[own[i]] is not None else after[i + 1]
    before: int | None = None
    for i, k in enumerate(own):
        if label[k] is not None:
            before = i
            continue
        near = []
        for j in (before, after[i]):
            if j is not None:
                said = bool(label[own[j]])
                near.append((abs(i - j) * (FARTHER if prior is not None and said != prior else 1), said))
        least = min((d for d, _ in near), default=0)
        said = {x for d, x in near if d == least}
        if not said:
            out[k] = prior is not False
        elif len(said) == 1:
            out[k] = said.pop()
        else:
            out[k] = prior if prior is not None else found[k].heading and near[-1][1]


def main_text(page: str | None) -> str:
    """Main text of a page: its blocks of main text, one a line."""
    parsed = parse(page or "")
    keep = classify(parsed)
    return "\n".join(b.text for b, k in zip(parsed.blocks, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each page, from its whole html.

    Null or empty html, or none of it main text: empty text, 0. Repeated rows, null page_id and null url stay as they
    are; other columns are not read. An empty table gives no rows. Narrow: no shuffle.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(trimmed(run), "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; cases as in extract()."""
    return extract(table(spark, sf_dir, "pages"))
