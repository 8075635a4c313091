"""Main text of web pages: flat text blocks classified by their neighbourhood.

A page is cut into blocks at block-level tags. The words and the link density of a block and of
the blocks before and after it, and the kind of element it stands in, go into a decision tree that
was trained on a small labelled table of blocks.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm.common import fresh_name, with_text_columns

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav "
    "ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
# What these hold is no text of the page.
SILENT_TAGS = frozenset(
    "script style noscript template svg math iframe object canvas audio video head title "
    "textarea select button".split()
)
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog header".split())
ARTICLE_TAGS = frozenset(("article", "main"))
# End tags that HTML lets out: a start tag closes the open elements first named, but none outside the
# nearest open element of those named second.
CELLS = frozenset(("td", "th"))
ROWS = CELLS | {"tr", "caption", "colgroup"}
ROW_GROUPS = ROWS | {"tbody", "thead", "tfoot"}
TERMS = frozenset(("dd", "dt"))
OUTER = BLOCK_TAGS - {"address", "div", "p"}
LISTS = frozenset(("select", "datalist"))
IMPLIED_ENDS = {
    "li": (frozenset(("li",)), OUTER - {"li"}),
    **dict.fromkeys(TERMS, (TERMS, OUTER - TERMS)),
    "option": (frozenset(("option",)), LISTS | {"optgroup"}),
    "optgroup": (frozenset(("option", "optgroup")), LISTS),
    **dict.fromkeys(CELLS, (CELLS | {"caption", "colgroup"}, frozenset(("table",)))),
    "tr": (ROWS, frozenset(("table",))),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (ROW_GROUPS, frozenset(("table",)))),
}
# All that a head may hold; anything else ends it.
HEAD_TAGS = frozenset("head base link meta title style script noscript template".split())
NOT_P = BLOCK_TAGS - {"p"}
BOILERPLATE_NAME = re.compile(
    r"(?:nav(?:bar|igation)?|menu|breadcrumbs?|header|masthead|footer|sidebar|aside|"
    r"ads?|advert(?:isement|ising|s)?|banner|promo(?:tion)?|sponsor(?:ed)?|cookies?|consent|notice|"
    r"alert|popup|modal|overlay|newsletter|subscribe|signup|login|comments?|replies|disqus|"
    r"respond|share|sharing|social|related|recommended|widget|toolbar|pagination|pager|tags|"
    r"copyright|legal|disclaimer|skip)\d*"
)
# With one of these in it, a name tells what an element has, lacks or looks like, not what it is.
STATE_NAMES = frozenset(
    "has have having with without no not non is hide hides hidden show shows one two both layout open "
    "opened close closed active visible enable enabled disable disabled".split()
)
# An element is of the frame by its class or id only if it holds no more of the page's words than the
# first share, or than the second one where the page's first heading is in it; but what readers say
# may be longer than the article.
MOST_WORDS, MOST_WITH_HEADING = 0.6, 0.2
READERS_NAME = re.compile(r"comments?|replies|disqus|respond")
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert menu menubar".split()
)
FEATURES = [
    "words", "links", "words_before", "links_before", "words_after", "links_after", "place", "heading",
]
# Values of "place": in an element of the frame of a page, in none that tells, in an article.
FRAME, OPEN, ARTICLE = 0, 1, 2

# The labelled table: features as above, then 1 if the block belongs to the main text.
LABELLED = [
    (85, 0.00, 12, 0.0, 60, 0.00, 2, 0, 1), (40, 0.00, 85, 0.0, 30, 0.00, 2, 0, 1),
    (9, 0.00, 1, 1.00, 85, 0.0, 2, 1, 1), (1, 0.00, 40, 0.0, 22, 0.0, 2, 0, 1),
    (2, 0.00, 60, 0.0, 6, 0.10, 2, 0, 1), (130, 0.05, 40, 0.0, 0, 0.0, 2, 0, 1),
    (25, 0.20, 50, 0.0, 45, 0.0, 2, 0, 1), (6, 1.00, 50, 0.0, 45, 0.0, 2, 0, 1),
    (3, 0.00, 0, 0.0, 0, 0.00, 2, 1, 1), (12, 0.50, 33, 0.1, 28, 0.0, 2, 0, 1),
    (1, 1.00, 0, 0.0, 1, 1.00, 0, 0, 0), (1, 1.00, 1, 1.0, 1, 1.00, 0, 0, 0),
    (2, 1.00, 1, 1.0, 9, 0.00, 0, 0, 0), (9, 0.00, 1, 1.0, 8, 0.00, 0, 0, 0),
    (14, 0.00, 1, 1.0, 10, 0.0, 0, 0, 0), (11, 0.00, 70, 0.0, 0, 0.0, 0, 0, 0),
    (8, 0.30, 55, 0.0, 0, 0.00, 0, 0, 0), (45, 0.00, 70, 0.0, 30, 0.0, 0, 0, 0),
    (30, 0.00, 45, 0.0, 5, 0.00, 0, 0, 0), (60, 0.02, 9, 0.0, 50, 0.0, 0, 0, 0),
    (5, 0.00, 20, 0.0, 1, 0.00, 0, 0, 0), (35, 0.00, 60, 0.0, 0, 0.0, 0, 0, 0),
    (12, 1.00, 60, 0.0, 2, 1.00, 0, 0, 0), (70, 0.00, 30, 0.0, 4, 0.0, 0, 0, 0),
    (90, 0.00, 8, 0.0, 70, 0.0, 1, 0, 1), (70, 0.01, 90, 0.0, 40, 0.0, 1, 0, 1),
    (40, 0.05, 70, 0.0, 6, 0.00, 1, 0, 1), (28, 0.00, 40, 0.0, 35, 0.0, 1, 0, 1),
    (18, 0.00, 25, 0.0, 60, 0.0, 1, 0, 1), (8, 0.00, 3, 1.0, 80, 0.0, 1, 1, 1),
    (5, 0.00, 60, 0.0, 55, 0.0, 1, 0, 1), (3, 0.00, 45, 0.0, 90, 0.0, 1, 1, 1),
    (22, 0.10, 3, 1.0, 30, 0.0, 1, 0, 1), (120, 0.00, 0, 0.0, 0, 0.0, 1, 0, 1),
    (4, 1.00, 3, 1.0, 2, 1.00, 1, 0, 0), (2, 1.00, 0, 0.0, 3, 1.00, 1, 0, 0),
    (6, 0.80, 2, 1.0, 40, 0.0, 1, 0, 0), (7, 0.00, 2, 1.0, 3, 1.00, 1, 0, 0),
    (3, 0.00, 4, 1.0, 2, 0.50, 1, 0, 0), (5, 0.00, 6, 0.0, 4, 0.00, 1, 0, 0),
    (25, 0.90, 10, 0.8, 12, 0.9, 1, 0, 0), (15, 0.70, 50, 0.0, 4, 1.00, 1, 0, 0),
    (40, 0.80, 5, 1.0, 6, 1.00, 1, 0, 0), (6, 0.00, 3, 0.5, 0, 0.00, 1, 0, 0),
    (1, 0.00, 3, 0.0, 2, 0.00, 2, 0, 1), (8, 0.00, 75, 0.0, 12, 0.0, 2, 0, 1),
    (12, 0.00, 8, 0.0, 9, 0.0, 2, 0, 1), (4, 0.00, 2, 0.0, 11, 0.0, 2, 0, 1),
    (9, 0.00, 1, 0.0, 11, 0.0, 2, 0, 1), (15, 0.00, 6, 0.0, 0, 0.0, 2, 0, 1),
    (300, 0.00, 5, 0.0, 3, 0.0, 2, 0, 1), (11, 1.00, 8, 0.0, 7, 0.0, 2, 0, 1),
    (2, 1.00, 1, 1.0, 1, 1.0, 2, 0, 1), (6, 0.80, 9, 0.0, 3, 0.5, 2, 0, 1),
    (7, 0.00, 0, 0.0, 4, 0.0, 2, 0, 1), (20, 0.60, 14, 0.0, 0, 0.0, 2, 0, 1),
    (180, 0.00, 90, 0.0, 75, 0.0, 0, 0, 0), (95, 0.00, 60, 0.0, 40, 0.0, 0, 0, 0),
    (50, 0.00, 40, 0.0, 120, 0.0, 0, 0, 0), (4, 0.00, 30, 0.0, 65, 0.0, 0, 1, 0),
    (33, 0.10, 70, 0.0, 80, 0.0, 0, 0, 0), (2, 0.00, 80, 0.0, 25, 0.0, 0, 1, 0),
]
DEPTH = 6


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    article: bool = False
    boilerplate: bool = False
    heading: bool = False
    within: set[int] = field(default_factory=set)


@dataclass
class Named:
    """An element whose class or id names the frame of a page: its words, whether the page's first
    heading or its main part is in it, and whether it is named after readers."""

    readers: bool
    words: int = 0
    heading: bool = False

    def counts(self, words: int) -> bool:
        """Whether it is of the frame of a page of so many words."""
        most = MOST_WITH_HEADING if self.heading else MOST_WORDS
        return self.readers and not self.heading or self.words <= most * words


def frame_words(names: str) -> set[str]:
    """The words in the classes and ids ``names`` that say that their element is of the frame of a page.
    What follows "--" is a variant of the element that is named before."""
    found: set[str] = set()
    for name in names.lower().split():
        words = re.split(r"[_-]+", re.sub(r"side[_-]bar", "sidebar", name.partition("--")[0]))
        if STATE_NAMES.isdisjoint(words):
            found.update(filter(BOILERPLATE_NAME.fullmatch, words))
    return found


class Blocks(HTMLParser):
    """The text blocks of a page, in its order. Character references are decoded."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, bool, bool, bool, bool]] = []
        # All elements with names of the frame, and the open ones among them.
        self.named: list[Named] = []
        self.within: list[int] = []
        self.words = 0
        # Where the open elements of each name stand in ``open``.
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.silent = self.articles = self.boilerplate = self.links = 0
        self.block = Block()

    def cut(self) -> None:
        if self.block.parts:
            self.blocks.append(self.block)
        self.block = Block()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in HEAD_TAGS:
            self.close_head()
        if tag in BLOCK_TAGS:
            self.cut()
            self.close_paragraph()
        elif tag == "br":
            self.handle_data(" ")
        if tag in VOID_TAGS:
            return
        if tag in IMPLIED_ENDS:
            self.close_implied(*IMPLIED_ENDS[tag])
        values = dict(attrs)
        names = f"{values.get('class') or ''} {values.get('id') or ''}"
        # The header of an article holds its title, that of a page does not.
        framed = tag in BOILERPLATE_TAGS and not (tag == "header" and self.articles)
        telling = frame_words(names) if tag not in ("html", "body", "article", "main") else set()
        framed |= (values.get("role") or "").lower() in ROLES
        hidden = "hidden" in values or values.get("aria-hidden") == "true"
        hidden |= "display:none" in (values.get("style") or "").replace(" ", "").lower()
        silent = tag in SILENT_TAGS or hidden
        self.places[tag].append(len(self.open))
        if tag in ("h1", "main"):
            for one in self.within:
                self.named[one].heading = True
        if telling:
            self.within.append(len(self.named))
            self.named.append(Named(any(map(READERS_NAME.match, names.lower().split()))))
        self.open.append((tag, silent, framed, tag in ARTICLE_TAGS, bool(telling)))
        self.silent += silent
        self.boilerplate += framed
        self.articles += tag in ARTICLE_TAGS
        self.links += tag == "a"

    def last(self, names: Iterable[str]) -> int:
        """The place of the innermost open element of ``names``, -1 if there is none."""
        return max((self.places[name][-1] for name in names if self.places.get(name)), default=-1)

    def close_from(self, place: int) -> None:
        """Close the open element at ``place`` and all inside it."""
        while len(self.open) > place:
            name, silent, framed, article, telling = self.open.pop()
            if telling:
                self.within.pop()
            self.places[name].pop()
            self.silent -= silent
            self.boilerplate -= framed
            self.articles -= article
            self.links -= name == "a"

    def close_head(self) -> None:
        if self.places["head"]:
            self.close_from(self.places["head"][0])

    def close_paragraph(self) -> None:
        """A block element ends the paragraph it would stand in."""
        own = self.places["p"]
        if own and own[-1] > self.last(NOT_P):
            self.close_from(own[-1])

    def close_implied(self, names: frozenset[str], within: frozenset[str]) -> None:
        places = [self.places[name][-1] for name in names if self.places.get(name)]
        if places:
            edge = self.last(within)
            places = [place for place in places if place > edge]
        if places:
            self.close_from(min(places))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.cut()
        if self.places.get(tag):
            self.close_from(self.places[tag][-1])

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and not data.isspace():
            self.close_head()
        if self.silent:
            return
        block = self.block
        if not data.isspace():
            block.article |= self.articles > 0
            block.boilerplate |= self.boilerplate > 0
            block.within.update(self.within)
            words = len(data.split())
            self.words += words
            for one in self.within:
                self.named[one].words += words
            block.heading |= any(name in ("h1", "h2", "h3", "h4", "h5", "h6") for name, *_ in self.open[-3:])
            if self.links:
                block.linked += words
        block.parts.append(data)


def page_blocks(html: str) -> list[tuple]:
    """(text, *features) of every block of a page that holds text."""
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.cut()
    rows = []
    frames = {place for place, one in enumerate(parser.named) if one.counts(parser.words)}
    for block in parser.blocks:
        block.boilerplate |= not frames.isdisjoint(block.within)
        words = "".join(block.parts).split()
        if words:
            rows.append((" ".join(words), len(words), block.linked / len(words), block))
    sizes = [(0, 0.0), *((words, links) for _, words, links, _ in rows), (0, 0.0)]
    return [
        (text, words, links, *sizes[place], *sizes[place + 2],
         FRAME if block.boilerplate else ARTICLE if block.article else OPEN, int(block.heading))
        for place, (text, words, links, block) in enumerate(rows)
    ]


def train(spark: SparkSession, labelled: list[tuple] = LABELLED) -> DecisionTreeClassificationModel:
    """A decision tree for blocks, from a small labelled table."""
    rows = spark.createDataFrame(
        [tuple(map(float, row)) for row in labelled], [*FEATURES, "label"]
    )
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(rows)
    return DecisionTreeClassifier(
        featuresCol="vector", labelCol="label", maxDepth=DEPTH, seed=1
    ).fit(vectors)


def as_condition(model: DecisionTreeClassificationModel, block: Column) -> Column:
    """The tree as one expression over the features of ``block``."""

    def walk(node) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            return F.lit(node.prediction() == 1.0)
        split = node.split()
        left = block[FEATURES[split.featureIndex()]] <= split.threshold()
        return F.when(left, walk(node.leftChild())).otherwise(walk(node.rightChild()))

    return walk(model._call_java("rootNode"))


def extract(
    pages: DataFrame,
    model: DecisionTreeClassificationModel,
    html_col: str = "html",
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``text`` (chosen blocks joined by two line feeds, empty if none) and ``n_chars`` to the
    columns ``keep`` (all but the html if none are named). Null html counts as empty, what is no
    html as one block. Columns of the same names are replaced."""
    made = ("text", "n_chars")
    keep = [
        name for name in (keep or pages.columns) if name != html_col and name.lower() not in made
    ]
    blocks_col = fresh_name([*keep, *made], "_blocks")
    fields = ", ".join(f"{name}: double" for name in FEATURES)
    names = ["text", *FEATURES]

    def cut(texts: list[str]) -> list:
        return [
            [
                [dict(zip(names, (row[0], *map(float, row[1:])), strict=True)) for row in page_blocks(html)]
                for html in texts
            ]
        ]

    kind = f"array<struct<text: string, {fields}>>"
    found = with_text_columns(pages, html_col, keep, {blocks_col: kind}, cut)
    chosen = F.filter(blocks_col, lambda block: as_condition(model, block))
    text = F.array_join(F.transform(chosen, lambda block: block["text"]), "\n\n")
    return found.select(*keep, text.alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("long")
    )
