"""Main text of web pages from the events of the standard library's parser.

Parser events are folded into lines, one per block of the page. Each line has a text-to-tag ratio; the ratios are smoothed
with a Gaussian kernel and lines above one standard deviation are content. Regions (articles, else main parts, else the
containers of the text) that hold content lines are kept whole, without the elements that are furniture by their name, role
or class.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody "
                   "td tfoot th thead tr ul".split())
FURNITURE = frozenset("head script style noscript template nav aside footer form button select textarea iframe object svg math canvas "
                      "menu dialog search audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
MARKS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
                  "breadcrumbs sidebar footer masthead comment comments reply replies disqus cookie cookies consent gdpr notice notices "
                  "newsletter subscribe signup paywall related share sharing social popup modal overlay pagination pager".split())
RADIUS, SIGMA = 2, 1.0


class PageLines(HTMLParser):
    """Lines as ``[text, tags, region, furniture]``; a region is the number of the element that holds the line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool]] = []
        self.open: list[tuple[str, bool, int, int]] = []  # name, furniture, region, rank of the region
        self.regions, self.text, self.tags = 0, [], 0
        self.best_rank = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text or self.tags:
            _, furniture, region, rank = self.open[-1] if self.open else ("", False, 0, 0)
            if text and not furniture:
                self.best_rank = max(self.best_rank, rank)
            self.lines.append((text, self.tags, region, furniture, rank))
        self.text, self.tags = [], 0

    def _pop(self, at: int) -> None:
        self._flush()
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            for i in range(len(self.open) - 1, -1, -1):  # a block ends an open paragraph, a list item the one before
                name = self.open[i][0]
                if name == "p" or name == tag == "li":
                    self._pop(i)
                    break
                if name in BLOCKS:
                    break
            self._flush()
        self.tags += 1
        if tag in VOID:
            if tag in ("br", "hr"):
                self.text.append(" ")
            return
        _, furniture, region, rank = self.open[-1] if self.open else ("", False, 0, 0)
        if not furniture:
            furniture = tag in FURNITURE or tag == "header" and rank < 3 or self._marked(tag, attrs)
            own = 3 if tag == "article" else 2 if tag == "main" else 1 if tag in ("div", "section", "td", "body") and rank < 2 else 0
            if own and (own > rank or own == rank == 1):
                self.regions += 1
                region, rank = self.regions, own
        self.open.append((tag, furniture, region, rank))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag in BLOCKS or self.open[i][1]:
                    self._pop(i)
                else:
                    del self.open[i:]
                return
            if tag not in BLOCKS and self.open[i][0] in BLOCKS:
                return  # a stray end tag does not leave its block

    def handle_data(self, data):
        self.text.append(data)

    @staticmethod
    def _marked(tag: str, attrs) -> bool:
        if tag in ("html", "body", "article", "main"):
            names = [v for k, v in attrs if k == "class" and v and tag == "article"]
            return any(t in ("comment", "reply", "ad", "advert") for v in names for t in re.split(r"[^a-z0-9]+", v.lower()))
        for k, v in attrs:
            if k == "hidden" or k == "aria-hidden" and v == "true" or k == "role" and (v or "").lower() in ROLES:
                return True
            if k in ("class", "id") and v and not MARKS.isdisjoint(re.split(r"[^a-z0-9]+", v.lower())):
                return True
        return False


def smooth(values: list[float]) -> list[float]:
    """Gaussian smoothing; at the ends the kernel is cut and weighed again."""
    kernel = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(values)):
        w = s = 0.0
        for k, g in enumerate(kernel, i - RADIUS):
            if 0 <= k < len(values):
                w += g
                s += g * values[k]
        out.append(s / w)
    return out


def main_text(html: str | None) -> str:
    """The blocks of the content regions, joined by an empty line."""
    parser = PageLines()
    parser.feed(html or "")
    if re.match(r"<[a-zA-Z/!?]", parser.rawdata):  # a tag or comment that the page's end cuts off is no text
        parser.rawdata = ""
    parser.close()
    parser._flush()
    lines = parser.lines
    if not any(t and not furniture for t, _, _, furniture, _ in lines):
        return ""
    ratios = smooth([len(t) / max(1, n) for t, n, _, _, _ in lines])
    mean = sum(ratios) / len(ratios)
    threshold = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    best: dict[int, float] = {}
    for (t, _, region, furniture, rank), r in zip(lines, ratios):
        if t and not furniture and rank == parser.best_rank:
            best[region] = max(best.get(region, 0.0), r)
    content = {region for region, r in best.items() if r >= threshold} or {max(best, key=best.get)}
    return "\n\n".join(t for t, _, region, furniture, _ in lines if t and not furniture and region in content)


def _texts(pages: pa.Array) -> pa.Array:
    texts = [main_text(p.as_py()) for p in pages]
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["text", "n_chars"])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (its code points) in place of ``html_col``.

    Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in page
    order by two line feeds. Defined cases: a null or empty page and one without content give an empty text; a page cut off
    anywhere is read to its end; unclosed elements end with their parent; plain text is one block; rows and other columns
    are kept as they are, but input columns named ``text`` or ``n_chars`` are replaced; an empty table stays empty.
    """
    udf = arrow_udf(_texts, "struct<text string, n_chars long>")
    return pages.withColumn("_page", udf(F.col(html_col).cast("string"))) \
        .withColumns({"text": F.col("_page.text"), "n_chars": F.col("_page.n_chars")}) \
        .drop("_page", *([html_col] if html_col not in ("text", "n_chars") else []))
