"""Main text of web pages from streaming parser events and smoothed text-to-tag ratios.

The standard library's parser streams events; block-level tags cut the text into lines, each with
its characters outside links, its tags and the container it stands in. What lies inside navigation,
scripts, adverts, comments and the like is never text, and an inline element that is no text, such as
a button or a picture, doesn't cut its line. The ratio of plain characters to tags, where linked
characters count for nothing, is smoothed over neighbouring lines with a Gaussian and
clustered around a threshold. Containers whose characters lie mostly in the high cluster are
content, and all their lines are kept in page order. An article or main element, where a page has
one, bounds the choice; as content is likely there, a tenth of the threshold is enough in it. Cells of
a table in an article are judged with the section around them.

A form is dropped whole, unless it wraps the page: it holds an article, a main element or most of the text.

Cases: a null, empty or text-free page gives an empty string. Unclosed and misnested tags end with
their nearest open container, an unclosed comment with the page. Repeated rows are kept. An empty table gives an empty table. Other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import small_batches, spread

# Elements by their part in a page, and words of class, id and role names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# never text, block-level and inline; a form is judged when the page is read
NEVER_BLOCK = frozenset("head title nav footer aside fieldset dialog menu".split())
NEVER_INLINE = frozenset(
    "script style noscript template svg annotation annotation-xml iframe object canvas audio video button select option textarea label datalist map".split()
)
NEVER_TEXT = NEVER_BLOCK | NEVER_INLINE
CONTAINER = frozenset("html body main article section div td th header details figure blockquote center form".split())
BLOCK = CONTAINER | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre table thead tbody tfoot tr caption figcaption hr address summary hgroup search".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "li", "dt", "dd", "figcaption", "summary"} | {"form", "nav", "footer", "aside"}
_BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|footer|foot|"
    r"cookie\w*|consent|notice|alert|gdpr|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|"
    r"comments?|commentlist|respond|reply|replies|discussion|disqus|related|recommend\w*|widget|toolbar|pagination|pager|skip|search\w*|"
    r"contentinfo|complementary|dialog|form)(?=$|[\s_-])",
    re.IGNORECASE,
)
# in an article only a whole name counts, or one with the word for a piece of layout
_LAYOUT = re.compile(
    r"[\s_-](?:area|bar|block|box|button|buttons|container|content|form|icons?|inner|left|links?|list|menu|nav|outer|panel|right|section|slot|title|unit|widget|wrap|wrapper)$",
    re.IGNORECASE,
)
# names of a state say what a page has, not what an element is
_STATE = re.compile(r"(?:has|no|not|is|with|without)-.*|.*-(?:open|opened|closed|enabled|disabled|on|off|hidden|visible|active)", re.IGNORECASE)
# what may stand in a head; anything else ends it
_IN_HEAD = frozenset("title style script noscript template head".split())
# an article's own header holds its title
_PAGE_HEADER = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar)(?=$|[\s_-])", re.IGNORECASE)
# ids of these name a place to link to, not a part of the page
_LINK_TARGETS = frozenset("h1 h2 h3 h4 h5 h6 a span".split())
_MARKUP = re.compile("<[a-zA-Z/!?]")
# an article of this name is a reader's
_COMMENT = re.compile(r"(?:comments?|commentlist|reply|replies|respond|discussion|disqus)", re.IGNORECASE)
#: Lines over which ratios are smoothed; what of the threshold is enough in an article.
SIGMA, IN_ARTICLE = 2.0, 0.1
#: A line of an article this long is text though it is a link, as an entry of a list of sources is; and how many lines
#: may stand between a headline and the article behind it.
LINKED_TEXT, HEADLINE_LINES = 60, 3


class Line:
    __slots__ = ("text", "tags", "plain", "region", "inside", "form", "headline")

    def __init__(self, text: str, tags: int, plain: int, region: int, inside: bool, form: int, headline: bool):
        self.text, self.tags, self.plain, self.region, self.inside, self.form, self.headline = text, tags, plain, region, inside, form, headline


class LineParser(HTMLParser):
    """Lines of text with their containers; elements that are never text are skipped whole."""

    def __init__(self, by_name: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.by_name = by_name
        self.section_of: list[int] = [0]
        self.lines: list[Line] = []
        self.open: list[str] = []
        # how often a tag is open, in all and since the last container: an end tag without a start costs nothing
        self.count: Counter[str] = Counter()
        self.scopes: list[Counter[str]] = [Counter()]
        self.regions: list[int] = [0]
        self.forms: list[int] = []
        self.wrapping: set[int] = set()
        self.wide: list[int] = [0]
        self.made, self.skip_at, self.links, self.inside = 0, -1, 0, 0
        self.parts: list[str] = []
        self.tags = self.linked = self.headline = 0

    def cut(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                form = self.forms[0] if self.forms else 0
                inside = self.inside > 0
                plain = len(text) if inside and len(text) >= LINKED_TEXT else max(0, len(text) - self.linked)
                self.lines.append(Line(text, self.tags, plain, self.regions[-1], inside, form, self.headline > 0))
                self.tags = self.linked = 0
            self.parts = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skip_at >= 0 and self.open[self.skip_at] == "head" and (
            tag == "body" or (len(self.open) == self.skip_at + 1 and tag not in VOID and tag not in _IN_HEAD)
        ):
            self.pop_to(self.skip_at)
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            elif tag == "hr":
                self.cut()
            self.tags += 1
            return
        if tag in CLOSES_P and "p" in self.open[-6:]:
            self.close_p()
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option") and self.open and self.open[-1] == tag:
            self.pop_to(len(self.open) - 1)
        if tag == "form" and self.forms:
            return  # forms don't nest
        self.push(tag)
        if self.skip_at >= 0:
            return
        if tag in BLOCK:
            self.cut()
        self.tags += 1
        if tag in NEVER_TEXT or self.boilerplate(tag, attrs):
            if tag in BLOCK or tag in NEVER_BLOCK:
                self.cut()
            self.skip_at = len(self.open) - 1
            return
        if tag == "a":
            self.links += 1
        elif tag == "h1":
            self.headline += 1
        elif tag in CONTAINER:
            self.made += 1
            # a cell or figure of an article is judged with the section that it stands in, a cell not with its table's wrapper
            at = self.regions[-1]
            if not self.inside or tag in ("article", "main", "section", "div"):
                self.section_of.append(self.made)
            else:
                self.section_of.append(self.section_of[at] if tag not in ("td", "th") else self.wide[-1])
            self.regions.append(self.made)
            if tag == "form":
                self.forms.append(self.made)
            elif tag in ("article", "main"):
                self.inside += 1
                self.wrapping.update(self.forms)
            if tag in ("article", "main", "section"):
                self.wide.append(self.made)

    def push(self, tag: str) -> None:
        self.open.append(tag)
        self.count[tag] += 1
        if tag in CONTAINER or tag in NEVER_TEXT:
            self.scopes.append(Counter())
        else:
            self.scopes[-1][tag] += 1

    def boilerplate(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag == "header":
            return not self.inside
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return True
            if not self.by_name or name not in ("class", "id", "role") or not value or tag in ("html", "body", "main"):
                continue
            if tag == "article":
                if any(_COMMENT.fullmatch(_LAYOUT.sub("", token)) for token in value.split()):
                    return True
                continue
            if name == "id" and (tag in _LINK_TARGETS or (tag == "section" and self.inside)):
                continue
            for token in value.split():
                if name == "class" and _STATE.fullmatch(token):
                    continue
                if self.inside:
                    if _BOILERPLATE.fullmatch(token) or (_LAYOUT.search(token) and _BOILERPLATE.fullmatch(_LAYOUT.sub("", token))):
                        return True
                elif _BOILERPLATE.search(token) or _PAGE_HEADER.search(token):
                    return True
        return False

    def close_p(self) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k] == "p":
                self.pop_to(k)
                return
            if self.open[k] in CONTAINER or self.open[k] in NEVER_TEXT:
                return

    def handle_endtag(self, tag: str) -> None:
        # an end tag doesn't reach out of a container or skipped element unless it is of that kind itself
        far = tag in CONTAINER or tag in NEVER_TEXT
        if not (self.count if far else self.scopes[-1])[tag]:
            return
        k = len(self.open) - 1
        while self.open[k] != tag:
            k -= 1
        self.pop_to(k)

    def pop_to(self, k: int) -> None:
        while len(self.open) > k:
            tag = self.open.pop()
            self.count[tag] -= 1
            if tag in CONTAINER or tag in NEVER_TEXT:
                self.scopes.pop()
            else:
                self.scopes[-1][tag] -= 1
            if self.skip_at >= 0:
                if len(self.open) == self.skip_at:
                    self.skip_at = -1
                continue
            self.tags += 1
            if tag in BLOCK:
                self.cut()
            if tag == "a":
                self.links = max(0, self.links - 1)
            elif tag == "h1":
                self.headline -= 1
            elif tag in CONTAINER:
                region = self.regions.pop()
                if self.wide[-1] == region:
                    self.wide.pop()
                if tag == "form":
                    self.forms.pop()
                self.inside -= tag in ("article", "main")

    def handle_data(self, data: str) -> None:
        if self.skip_at < 0:
            self.parts.append(data)
            if self.links:
                self.linked += len(" ".join(data.split()))

    def finish(self) -> list[Line]:
        """The page's lines without those of forms that don't wrap it."""
        # what the parser holds back is unfinished: a comment or tag to the page's end, or a tag with an odd quote
        while _MARKUP.match(self.rawdata) and not self.cdata_elem:
            end = -1 if self.rawdata.startswith("<!--") else self.rawdata.find(">")
            self.rawdata = self.rawdata[end + 1 :] if end >= 0 else ""
            self.goahead(False)
        self.close()
        self.cut()
        held = Counter()
        for x in self.lines:
            held[x.form] += x.plain
        whole = sum(held.values())
        self.wrapping |= {form for form, n in held.items() if not form or 2 * n > whole}
        return [x for x in self.lines if x.form in self.wrapping]


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios averaged with Gaussian weights of the neighbours that there are."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def threshold(level: np.ndarray) -> float:
    """The cut between two clusters of levels, where their means balance; zero if they hardly differ."""
    cut = level.mean()
    for _ in range(32):
        high, low = level[level > cut], level[level <= cut]
        if not len(high) or not len(low):
            return 0.0
        new = (high.mean() + low.mean()) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    # one cluster only: lines that hardly differ are content or not together
    return float(cut) if level.max() > 2 * max(level.min(), 1e-9) else 0.0


def content_lines(ratios: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Lines in the high cluster of the smoothed ratios; ``inside`` tells lines of an article."""
    level = smoothed(ratios)
    return level >= threshold(level) * np.where(inside, IN_ARTICLE, 1.0)


def main_text(html: str | None) -> str:
    """The content blocks of a page, each with single spaces, joined by an empty line."""
    parser = LineParser()
    parser.feed(html or "")
    lines = parser.finish()
    if not lines and html:
        # no name may take the whole page
        parser = LineParser(by_name=False)
        parser.feed(html)
        lines = parser.finish()
    if not lines:
        return ""
    high = content_lines(np.array([x.plain / max(1, x.tags) for x in lines]), np.array([x.inside for x in lines]))
    sections: dict[int, list[int]] = {}
    for x, good in zip(lines, high, strict=True):
        seen = sections.setdefault(parser.section_of[x.region], [0, 0, 0])
        seen[0] += len(x.text)
        seen[1] += len(x.text) * bool(good)
        seen[2] += x.plain
    # next to prose the smoothing lifts a short list of links too
    kept = {r for r, (n, good, plain) in sections.items() if 2 * good >= n and 2 * plain >= n}
    chosen = [x for x in lines if parser.section_of[x.region] in kept]
    title: list[Line] = []
    if any(x.inside for x in lines):
        first = next(k for k, x in enumerate(lines) if x.inside)
        if not any(x.headline for x in lines if x.inside):
            title = [x for x in lines[max(0, first - HEADLINE_LINES) : first] if x.headline][-1:]
        chosen = [x for x in chosen if x.inside]
    if not chosen:
        pool = [x for x in lines if x.inside] or lines
        most = max((parser.section_of[x.region] for x in pool), key=lambda r: (sections[r][2], -r))
        chosen = [x for x in pool if parser.section_of[x.region] == most]
    return "\n\n".join(x.text for x in title + chosen)


def extract_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` of ``pages(page_id, url, html)``."""
    small_batches(pages.sparkSession, 256)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h.as_py()) for h in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return spread(rows).mapInArrow(extract, "page_id long, url string, text string")
