"""Main text of HTML pages by text density of lines.

A page is fed to the standard library's streaming parser.  Its events build
lines: a block element, a line break or a cell begins a new one, white space
within a line becomes one blank, and a line counts the characters of its text,
those of them inside links, and its tags.  A line's score is its text-to-tag
ratio less its links.  Scores are smoothed along the page with a Gaussian
kernel and parted by a threshold into content and the rest; neighbouring
content lines make the regions that are returned.

What a page says about its own parts corrects the scores: text in elements or
roles that hold no article (scripts, styles, menus, headers of pages, footers,
sidebars, forms and the like, or class and id names that say advert, notice,
comment or share) scores 0 and is no candidate (inside an article only those names
do so that no article has for its own parts), and a line in what a page marks
as its article has a prior: the whole threshold if it has a character of text to
every two tags, as a paragraph of one letter has, and in proportion below that.  So an article's short lines are
content, lines that are mostly tags or links are not for standing in one, and
dense text outside of it is content too.  An article's own header is content.

Defined cases: a null or empty page, or one without content, has an empty
text; pages of any length are read whole; broken markup is read as the parser
reads it, an element that isn't closed ends with its parent; repeated rows are
read each for itself; null ids and urls stay null; further columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import map_batches

# Element and attribute names as HTML and its users have them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas audio video head title".split())
APART = frozenset("nav header footer aside form button select textarea dialog menu".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|adverts|banner|breadcrumb|breadcrumbs|comment|comments|commentlist|consent|cookie|cookies|copyright|disqus|discussion|footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|pager|pagination|popup|promo|promoted|related|replies|reply|respond|share|sharing|sidebar|signup|social|sponsor|sponsored|subscribe|toolbar|topbar|widget)(?:$|[\s_-])",
    re.I,
)
#: Of these names, those that an article's own parts may have too: a recipe's menu, a legal notice.
OWN = re.compile(r"(?:^|[\s_-])(?:banner|discussion|menu|notice|notices|pager|related|share|sharing|social|toolbar|widget)(?:$|[\s_-])", re.I)
WHITE = re.compile(r"\s+")

#: Width of the Gaussian in lines, and the share of the scores' deviation that content exceeds.
SIGMA, SHARE = 1.0, 0.5


class Lines(HTMLParser):
    """Lines of a page: [text parts, link characters, tags, in an article, apart from it]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []  # name, apart, article
        self.count: Counter[str] = Counter()
        self.raw = self.apart = self.article = self.links = 0
        self.lines: list[list] = []
        self.fresh()

    def parse_marked_section(self, i, report=1):
        """``<![`` begins a comment up to the next ``>``, whatever follows it; the base class refuses most of these."""
        return self.parse_bogus_comment(i)

    def fresh(self) -> None:
        self.line = [[], 0, 0, False, False]
        self.lines.append(self.line)

    def break_line(self) -> None:
        if self.line[0]:
            self.fresh()

    def says_apart(self, tag: str, attrs) -> bool:
        if tag in APART:
            return not (tag == "header" and self.article)
        if tag in ("body", "html", "article", "main"):
            return False
        own = dict(attrs)
        if (own.get("role") or "").lower() in ROLES or "hidden" in own or (own.get("aria-hidden") or "").lower() == "true":
            return True
        if re.search(r"display\s*:\s*none", own.get("style") or "", re.I):
            return True
        names = " ".join(own.get(x) or "" for x in ("class", "id"))
        return bool(NAMES.search(OWN.sub(" ", names) if self.article else names))

    def handle_starttag(self, tag, attrs):
        self.line[2] += 1
        if tag not in IN_HEAD and not (self.count["template"] or self.count["noscript"]):
            self.end("head")  # a page may leave out </head> and <body>
        if tag in BLOCK:
            if tag in ENDS_P:
                self.end("p", within=("article", "div", "section", "td", "th", "li", "body", "main", "blockquote"))
            elif tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
                kind = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
                for name in kind:
                    self.end(name, within=("ul", "ol", "dl", "table", "select", "menu") if tag not in ("td", "th") else ("tr", "table"))
            self.break_line()
        if tag in VOID:
            return
        apart = tag not in RAW and self.says_apart(tag, attrs)
        article = tag in ("article", "main")
        self.open.append((tag, apart, article))
        self.count[tag] += 1
        self.raw += tag in RAW
        self.apart += apart
        self.article += article
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.line[2] += 1
        if tag in BLOCK:
            self.break_line()
        self.end(tag)

    def end(self, tag: str, within: tuple[str, ...] = ()) -> None:
        """End the nearest open element of that name, and what is open in it; nothing, at once, if none is open."""
        if not self.count[tag]:
            return
        for at in range(len(self.open) - 1, -1, -1):
            name = self.open[at][0]
            if name == tag:
                for gone, apart, article in self.open[at:]:
                    self.count[gone] -= 1
                    self.raw -= gone in RAW
                    self.apart -= apart
                    self.article -= article
                    self.links -= gone == "a"
                del self.open[at:]
                return
            if name in within:
                return

    def handle_data(self, data):
        if self.raw:
            return
        if not self.line[0] and not data.strip():
            return
        apart = self.apart > 0
        if self.line[0] and self.line[4] != apart:
            self.fresh()
        self.line[0].append(data)
        self.line[1] += len(data) if self.links else 0
        self.line[3], self.line[4] = self.article > 0, apart


def smooth(score: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Scores averaged along the page with Gaussian weights; the weights at the page's ends add up to 1 too."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma**2))
    return np.convolve(score, kernel)[reach : reach + len(score)] / np.convolve(np.ones(len(score)), kernel)[reach : reach + len(score)]


def extract(html: str | None) -> tuple[str, int]:
    """(main text, number of content regions) of one page."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    lines = [(WHITE.sub(" ", "".join(parts)).strip(), links, tags, article, apart) for parts, links, tags, article, apart in parser.lines]
    lines = [x for x in lines if x[0]]
    if not lines:
        return "", 0
    score = np.array([0.0 if apart else max(0, len(text) - links) / max(1, tags) for text, links, tags, _, apart in lines])
    soft = smooth(score)
    least = SHARE * soft.std()
    prior = least * np.minimum(2 * score, 1) * np.array([x[3] for x in lines])
    content = (soft + prior > least) & np.array([not x[4] for x in lines])
    content &= np.array([2 * links <= len(text) for text, links, *_ in lines])
    regions = int((content[1:] & ~content[:-1]).sum() + content[0])
    return "\n".join(x[0] for x, use in zip(lines, content, strict=True) if use), regions


def _extract(batches):
    for batch in batches:
        found = [extract(html) for html in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int32())], ["id", "url", "text", "n_regions"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars, n_regions) of every page."""
    kind = dict(pages.dtypes)
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    found = map_batches(own, _extract, f"id {kind[id_col]}, url {kind[url_col]}, text string, n_regions int")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("bigint").alias("n_chars"), "n_regions")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op6_main_text": op6_main_text}
#: Parsing is not SQL's; tests hold the text against pages whose article is known.
ORACLE_SQL: dict[str, str] = {}
