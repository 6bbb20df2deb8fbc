"""Main text of HTML pages: parser events to lines, text-to-tag ratios, smoothing, clusters."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Standard deviation, in lines, of the Gaussian that smooths the ratios, and the share of
#: the page's weighted mean ratio that a content line must reach.
SIGMA, SHARE = 1.0, 0.35
#: The share of the high lines' text from which those outside articles stay, and the
#: characters of text a control from which a form is not furniture.
FAIR, PER_CONTROL = 0.25, 100
#: On a page without an article or main element, an element that only its name bars is content
#: if it holds this many times the text of the rest and this much text a line.
LIFT, PER_LINE = 10, 100

#: The elements of the HTML standard by what they do to text.
BLOCKS = frozenset(
    "address article aside blockquote body button canvas caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript object ol optgroup option p pre search "
    "section select summary table tbody td template textarea tfoot th thead title tr ul video audio iframe svg math script style".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript iframe object svg math canvas audio video select textarea head title datalist noframes noembed".split())
CHROME = frozenset("nav header footer aside menu button dialog search fieldset".split())
CONTENT = frozenset("article main".split())
CONTROLS = frozenset("input select textarea button".split())
#: Elements that may stand in a head; any other ends it.
HEAD = frozenset("html head base basefont bgsound link meta script style template noscript noframes title".split())
#: Elements that end when one of the listed parents' next children start.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
          "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
#: Elements that hold lines, rather than being one.
BOXES = frozenset("div section article main td center details dd blockquote".split())
SCOPES = frozenset("table ul ol dl td th body html article section div main".split())
#: Words that, as a part of a class, id or role, mark an element as page furniture.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion popup modal overlay cookie cookies consent gdpr notice notices "
    "alert subscribe subscription newsletter signup login nav navbar navigation menu menus breadcrumb breadcrumbs toolbar sidebar side aside rail widget widgets footer "
    "masthead pagination pager share sharing social related recommended recommendations comment comments commentlist respond disqus replies "
    "contentinfo complementary search searchbox disclaimer copyright topbar skip".split())
#: Of these, the words that also bar an article element; a page's other classes there name its theme.
REPLIES = frozenset("comment comments commentlist respond disqus replies related recommended recommendations".split())
#: Words in a name that say where an element is, not what it is.
NEUTRAL = frozenset(
    "area bar block body bottom box btn button buttons col column container content desktop element fixed floating form frame global group head header heading "
    "holder icon icons inline inner item items left link links list main mobile module outer page pane panel position post posts primary region right row secondary "
    "section site slot small sticky text thread title top unit user wrap wrapper".split())
#: Words that make a name speak of furniture beside the element, or of something else.
JOINING = frozenset("and at by for from has in no not of on or the to with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARTS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Line:
    """One block of text in page order."""

    text: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0
    region: int = 0
    box: int = 0
    form: int = 0
    hard: bool = False
    soft: int = 0
    heading: bool = False


class Lines(HTMLParser):
    """Turns parser events into lines: a block element begins and ends one.

    A line keeps its pieces, how many tags it holds, how many of its characters are link
    text, the innermost element around it that holds lines, the outermost article or main element around it (0: none), and whether page
    furniture encloses it: ``hard`` by element or as reader comments, ``soft`` (the number of the
    outermost such element) by class, id, role or a hidden flag. Furniture inside a line of
    other text, or before it, is left out of the line. It also keeps the form around it (0: none, or one around an
    article or main element that holds the line), and ``controls`` those of each form. An article lifts soft marks around it, such as those of a
    wrapper that is named after the sidebar it also holds.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.stack = [Line()], []
        self.silent = self.hard = self.soft = self.inside = self.links = self.region = self.n_boxes = 0
        self.boxes, self.forms, self.controls = [0], [0], [0]
        self.soft_now = self.n_soft = 0
        self.last = [0]  # by box: the largest number of a box inside it
        self.at = defaultdict(list)  # by tag: positions in the stack
        self.blocks = []  # positions of block elements in the stack

    def _break(self):
        now = self.lines[-1]
        if now.text or now.tags:
            self.lines.append(Line())

    def _count(self, marks: tuple[int, ...], by: int):
        self.silent += by * marks[0]
        self.hard += by * marks[1]
        self.soft += by * marks[2]
        self.inside += by * marks[3]
        self.links += by * marks[4]

    def _pop(self, to: int):
        while len(self.stack) > to:
            tag, marks = self.stack.pop()
            self.at[tag].pop()
            self._count(marks, -1)
            self.soft_now = marks[5]
            if tag in BLOCKS:
                self.blocks.pop()
            if tag in BOXES:
                self.last[self.boxes.pop()] = self.n_boxes
            if tag == "form" or marks[3]:
                self.forms.pop()

    def _end_head(self, whole: bool):
        """End an open head whose end tag is left out; if not ``whole``, only one with nothing open in it."""
        if not self.silent:
            return
        names = [t for t, _ in (self.stack if whole else self.stack[-1:])]
        if "head" in names and "template" not in names:
            self._break()
            self._pop(len(self.stack) - len(names) + names.index("head"))

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD:
            self._end_head(tag in ("body", "frameset"))
        if tag in CONTROLS and not self.hard and self.soft <= 0 and not any(k == "type" and (v or "").lower() == "hidden" for k, v in attrs):
            self.controls[self.forms[-1]] += 1
        if tag in BLOCKS:
            self._break()
            self._imply(tag)
        elif tag == "br":
            self.lines[-1].text.append(" ")
        self.lines[-1].tags += 1
        if tag in VOID:
            return
        named = self._named(tag, attrs)
        # a page header is furniture; the header of an article holds its title
        hard = tag in CHROME and not (tag == "header" and self.inside) or not REPLIES.isdisjoint(named)
        content = tag in CONTENT and not hard
        soft = -self.soft if content and not self.hard else int(bool(named) and tag not in CONTENT)
        if content and not self.inside:
            self.region += 1
        marks = (tag in SILENT, hard, soft, content, tag == "a", self.soft_now)
        if soft > 0 and self.soft <= 0:
            self.n_soft += 1
            self.soft_now = self.n_soft
        if tag in BOXES:
            self.n_boxes += 1
            self.boxes.append(self.n_boxes)
            self.last.append(self.n_boxes)
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.at[tag].append(len(self.stack))
        if tag == "form":
            self.controls.append(0)
        if tag == "form" or content:
            self.forms.append(0 if content else len(self.controls) - 1)
        self.stack.append((tag, marks))
        self._count(marks, 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.at[tag]:
            if tag == "p":
                self._break()
            return
        at = self.at[tag][-1]
        if tag not in BLOCKS and self.blocks and self.blocks[-1] > at:
            return
        self.lines[-1].tags += 1
        self._pop(at)
        if tag in BLOCKS:
            self._break()

    def _imply(self, tag: str):
        """End what a new block ends by rule: an open paragraph, a list item, a cell."""
        ends = CLOSES.get(tag, ())
        scope = max((self.at[t][-1] for t in SCOPES if t not in ends and self.at[t]), default=-1)
        if self.at["p"] and self.at["p"][-1] > scope:
            scope = self.at["p"][-1] - 1
        above = [self.at[t][k] for t in ("p", *ends) if (k := bisect_right(self.at[t], scope)) < len(self.at[t])]
        if above:
            self._pop(min(above))

    @staticmethod
    def _named(tag, attrs) -> set[str]:
        """The words of furniture in an element's class, id and role; a word if it is hidden.

        Each name counts as a whole: its last word that is not neutral must be furniture
        (``site-footer``, ``cookie-notice-box``, not ``share-price-report``), and no word may
        join it to something else (``side-by-side``, ``with-sidebar``).
        """
        found = set()
        for name, value in attrs:
            hides = name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)
            if name in ("hidden", "inert") or (name == "aria-hidden" and value == "true") or hides:
                found.add("hidden")
            elif name in ("class", "id", "role") and value and tag not in ("body", "html"):
                for token in value.split():
                    parts = _PARTS.findall(_CAMEL.sub(" ", token).lower())
                    telling = [w for w in parts if w not in NEUTRAL and not w.isdigit()]
                    if telling and telling[-1] in FURNITURE and JOINING.isdisjoint(parts):
                        found.add(telling[-1])
        return found

    def handle_data(self, data):
        if data.strip() and self.stack and self.stack[-1][0] == "head":
            self._end_head(False)
        if self.silent:
            return
        now = self.lines[-1]
        if data.strip():
            hard, soft = self.hard > 0, self.soft_now if self.soft > 0 else 0
            if any(t.strip() for t in now.text):
                if (hard or soft) and not (now.hard or now.soft):
                    return
                if (now.hard or now.soft) and not (hard or soft):
                    now.text.clear()
                    now.linked = now.box = now.form = 0
            now.hard, now.soft = hard, soft
            now.box, now.form = now.box or self.boxes[-1], now.form or self.forms[-1]
            now.region = self.region if self.inside else 0
            now.heading = now.heading or bool(self.blocks) and self.stack[self.blocks[-1]][0] in HEADINGS
        now.text.append(data)
        if self.links:
            now.linked += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios under a Gaussian of ``sigma`` lines, weights renewed at both ends."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel)[reach:reach + len(ratios)]
    return full(ratios) / full(np.ones(len(ratios)))


def spread(high: np.ndarray, plain: np.ndarray, length: np.ndarray, box: np.ndarray) -> np.ndarray:
    """The high lines and those of ``plain`` that belong to them."""
    # a cluster is a run of high lines; short lines between two of its lines belong to it
    high, at = high.copy(), np.flatnonzero(high)
    for a, b in zip(at, at[1:]):
        if b - a <= 1 + math.ceil(3 * SIGMA):
            high[a:b] |= plain[a:b]
    # so do the other lines of a box that is mostly content
    n = int(box.max()) + 1
    of_box, of_high = np.bincount(box, length * plain, n), np.bincount(box, length * (plain & high), n)
    whole = (np.bincount(box, high, n) > 0) & (2 * of_high >= of_box)
    whole[0] = False
    return high | plain & whole[box]


def trimmed(high: np.ndarray, core: np.ndarray, box: np.ndarray, last: np.ndarray, heading: np.ndarray) -> np.ndarray:
    """``high`` without the lines that only smoothing raised: those that neither lie between two
    core lines of their run, nor in or under the box of the nearest one, nor are headings before it."""
    at = np.arange(len(high))
    run = np.cumsum(~high)
    before = np.maximum.accumulate(np.where(core, at, -1))
    after = np.minimum.accumulate(np.where(core, at, len(at))[::-1])[::-1]
    has_before = (before >= 0) & (run[before] == run)
    has_after = (after < len(at)) & (run[np.minimum(after, len(at) - 1)] == run)

    def within(k):
        return (box[k] == box) | (box[k] > 0) & (box >= box[k]) & (box <= last[box[k]])

    near = has_before & within(before) | has_after & (heading | within(np.minimum(after, len(at) - 1)))
    return high & (has_before & has_after | near)


def main_lines(html: str | None) -> list[str]:
    """The content lines of one page in order, white space folded; none for null or empty."""
    if not html:
        return []
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser._pop(0)
    lines = [(" ".join("".join(x.text).split()), x) for x in parser.lines]
    lines = [(t, x) for t, x in lines if t]
    if not lines:
        return []
    hard, soft = np.array([x.hard for _, x in lines]), np.array([x.soft for _, x in lines])
    region = np.array([x.region for _, x in lines])
    length = np.array([len(t) for t, _ in lines], float)
    own = np.array([max(0, len(t) - x.linked) for t, x in lines])
    free = ~hard & (soft == 0)
    if not parser.region:
        inside, count = np.bincount(soft, own * ~hard), np.bincount(soft, ~hard)
        lifted = (inside >= LIFT * inside[0]) & (inside >= PER_LINE * np.maximum(count, 1))
        lifted[0] = False
        free |= ~hard & lifted[soft]
    own = own * free
    form = np.array([x.form for _, x in lines])
    # a form with little text a control is furniture
    text = np.bincount(form, own, len(parser.controls))
    free &= (form == 0) | (text >= PER_CONTROL * np.array(parser.controls))[form]
    ratio = np.array([max(0, len(t) - 2 * x.linked) / max(1, x.tags) for t, x in lines]) * free
    level = smoothed(ratio) if len(ratio) > 1 else ratio
    threshold = SHARE * np.average(level, weights=np.where(free, length, 0) + 1e-9)
    high = free & (level >= threshold) & (ratio > 0)
    plain, box = free & (length > 2 * np.array([x.linked for _, x in lines])), np.array([x.box for _, x in lines])
    named = np.unique(region[high & (region > 0)])
    # clusters that fall into an article or main element stand for the whole element; those
    # outside of them stay beside it if they hold a fair share of the text
    out = trimmed(high & (region == 0), free & (ratio >= threshold), box, np.array(parser.last), np.array([x.heading for _, x in lines]))
    if length[out].sum() < FAIR * length[high].sum():
        out &= False
    high = spread(out, plain & (region == 0), length, box) | free & np.isin(region, named)
    return [t for keep, (t, _) in zip(high, lines) if keep]


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), text: str = "text") -> DataFrame:
    """``keep`` and the main text of every page, one row per input row.

    Blocks are joined in page order by a line feed; null, empty and contentless pages give
    the empty text. Repeated rows stay; other columns are not read; an empty table gives no
    rows. Pages are parsed whole, one at a time, where they lie: nothing is shuffled.
    """
    schema = T.StructType([pages.schema[k] for k in keep] + [T.StructField(text, T.StringType())])

    def run(batches):
        for pdf in batches:
            out = pdf.iloc[:, :-1].copy()
            out.columns = list(keep)
            out[text] = pd.Series(["\n".join(main_lines(h if isinstance(h, str) else None)) for h in pdf.iloc[:, -1]], index=pdf.index, dtype=object)
            yield out

    return pages.select(*keep, F.col(html).alias("_html")).mapInPandas(run, schema)
