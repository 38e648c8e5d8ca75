"""Main text of HTML pages, from the events of the standard library's streaming parser.

Each block of text is a line with a text-to-tag ratio: its characters over the tags met in it. The ratios
are smoothed by a Gaussian along the page and split in two clusters by a threshold halfway between the
clusters' means; the lines above are content, and content alone chooses regions. A content line brings in its section (the
innermost article, main, section, div, cell or body); where most content lies in article or main elements, those that hold
content are the regions, and a main is one region if it has content beside its articles. Structure adds and vetoes only: a region's
short lines are added, as are those between its first and last content line and headings just before; lines inside
elements that the page itself marks as menu, header, footer, sidebar, notice, advert, form, script, style or comments count as
ratio 0 and don't belong to the result. Without content no element has a result, whatever its name.
Marks by class or id are whole names or compounds of known parts; they don't count where they would hide the main or only
article, nor for an id that is a word of the text (as "search") inside an article, if most text there has a high ratio.
The regions' lines are joined in page order.

Nulls and edges: a null or empty page has the empty text; text outside any element counts as the body's; unclosed
elements end with what holds them; repeated rows give equal texts; an empty table gives an empty one. Incoming columns named
like a result are dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Element and class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
HIDDEN = frozenset("aside button canvas datalist dialog footer form head iframe input label math menu nav noscript object option script select style svg template textarea title".split())
#: What stands within a line and is never text: it's dropped without ending the line.
SILENT = HIDDEN - BLOCKS - {"head"}
MARKS = frozenset("ad ads adsense advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus disclaimer footer gdpr login menu modal nav navbar navigation newsletter notice pagination pager popup promo promoted related replies search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
HEADERS = frozenset("header masthead site-header page-header top-bar topbar".split())
#: A name with a mark is one too if it has nothing but marks and these.
PARTS = frozenset("area bar block bottom box btn button buttons center col column container desktop fixed form global group icon icons inner item items left link links list main mobile overlay page panel post posts primary right row secondary section site slot small text top unit wrap wrapper".split())
REPLIES = frozenset("comment comments disqus replies".split())
#: Such an id may be a heading's own word.
WORDS = frozenset("login menu navigation notice related search share sharing skip social".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
ARTICLE = ("article", "main")
#: An element of the key's kind ends at a new one of these, unless a container stands between.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What a line belongs to where no article or main element holds it.
SECTIONS = frozenset("article body div main section td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article aside blockquote body div dl fieldset figure footer form header main nav ol section table td th ul".split())


#: Why an element hides: it does for certain, by a class or id, by an id that may be a word of the text, as readers' comments.
FIRM, NAMED, WORD, READERS = 1, 2, 3, 4


def named(k: str, name: str) -> int:
    """How far a class or id (k) tells that its element isn't main text."""
    parts = {w for w in re.split(r"[^a-z0-9]+", name) if w and not w.isdigit()}
    if name not in HEADERS and not (parts & MARKS and parts <= MARKS | PARTS):
        return 0
    return READERS if parts & REPLIES else WORD if k == "id" and name in WORDS else NAMED


class Lines(HTMLParser):
    """The page's blocks: words, tags met, and the innermost open element of each; elements form a tree by `parent`."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # name, whether it hides, number
        self.hides = self.silent = self.number = self.tags = 0
        self.parts: list[str] = []
        self.lines: list[tuple[str, int, bool, int]] = []
        self.names, self.parent = ["body"], [0]
        self.mark = [0]  # why an element hides
        self.count: Counter[str] = Counter()  # open elements by name, so that no end is sought in vain

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.hides > 0, self.open[-1][2] if self.open else 0))
        self.parts, self.tags = [], 0

    def pop_to(self, k: int) -> None:
        for name, h, _ in self.open[k:]:
            self.hides -= h
            self.silent -= name in SILENT
            self.count[name] -= 1
        del self.open[k:]

    def hidden(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag in HIDDEN or (tag == "header" and not any(self.count[n] for n in ARTICLE)):
            return FIRM
        if tag in ("body", "html"):
            return 0
        why = set()
        for k, v in attrs:
            if not v or k not in ("class", "id", "role", "aria-hidden", "hidden", "style"):
                if k == "hidden":
                    return FIRM
                continue
            v = v.lower()
            if k in ("class", "id"):
                why |= {named(k, w) for w in v.split()}
            if (k == "role" and v in ROLES) or (k == "aria-hidden" and v == "true") or (k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v)):
                return FIRM
        return next((w for w in (READERS, NAMED, WORD) if w in why), 0)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in VOID:
            if tag in ("br", "hr"):
                self.parts.append(" ")
            return
        if tag in BLOCKS:
            self.end_line()
            self.close_implied(tag)
        if tag == "body" or (tag in ARTICLE and self.hides and any(h and n in ("head", "nav", "header", "title") for n, h, _ in self.open)):
            self.pop_to(next((i for i, (n, h, _) in enumerate(self.open) if h), len(self.open)))
        why = self.hidden(tag, attrs)
        hide = why > 0
        if hide and tag not in BLOCKS and tag not in SILENT:
            self.end_line()
        self.mark.append(why)
        self.number += 1
        self.hides += hide
        self.names.append(tag)
        self.parent.append(self.open[-1][2] if self.open else 0)
        self.count[tag] += 1
        self.silent += tag in SILENT
        self.open.append((tag, hide, self.number))

    def close_implied(self, tag: str) -> None:
        ends = ENDS.get(tag, {"p"})
        if not any(self.count[n] for n in ends):
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in ends:
                return self.pop_to(k)
            if self.open[k][0] in CONTAINERS and not (tag in ("tr", "td", "th", "li", "dt", "dd") and self.open[k][0] in ends):
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        if not self.count[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if self.open[k][1] and tag not in BLOCKS and tag not in SILENT:
                    self.end_line()
                return self.pop_to(k)
            if tag not in CONTAINERS and tag not in ("html", "body", "head") and self.open[k][0] in CONTAINERS:
                return

    def handle_data(self, data):
        if not self.silent and not (self.hides and data.isspace()):
            self.parts.append(data)


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight


def threshold(x: np.ndarray) -> float:
    """Halfway between the means of the two clusters into which it splits x."""
    t = float(x.mean())
    for _ in range(50):
        low, high = x[x <= t], x[x > t]
        if not len(low) or not len(high):
            break
        new = (low.mean() + high.mean()) / 2
        if abs(new - t) < 1e-9:
            break
        t = float(new)
    return t


def below(p: Lines, marked: list[bool]) -> list[bool]:
    """Whether an element or one that holds it is marked."""
    for n in range(1, len(marked)):
        marked[n] = marked[n] or marked[p.parent[n]]
    return marked


def unmarked(p: Lines) -> None:
    """Takes back marks by name of what holds a main element, or an article on a page that shows neither elsewhere."""
    if not any(m in (NAMED, WORD) for m in p.mark):
        return
    firm, hid = below(p, [m in (FIRM, READERS) for m in p.mark]), below(p, [m > 0 for m in p.mark])
    main, either = ([name in names and not f for name, f in zip(p.names, firm, strict=True)] for names in (("main",), ARTICLE))
    shown = any(e and not h for e, h in zip(either, hid, strict=True))
    for holds in (main, either):
        for n in range(len(holds) - 1, 0, -1):
            holds[p.parent[n]] |= holds[n]
    p.mark = [0 if m in (NAMED, WORD) and (a or (e and not shown)) else m for m, a, e in zip(p.mark, main, either, strict=True)]


def overruled(p: Lines, limit: float) -> bool:
    """Takes back marks by a word inside an article or main element where most of the text has a high smoothed ratio."""
    inside = below(p, [n in ARTICLE for n in p.names])
    words = [n for n, m in enumerate(p.mark) if m == WORD and inside[n]]
    if not words:
        return False
    smooth = smoothed(np.array([len(text) / max(1, tags) for text, tags, _, _ in p.lines]))
    all_, high = [0] * len(p.mark), [0] * len(p.mark)
    for (text, _, _, n), x in zip(p.lines, smooth, strict=True):
        all_[n] += len(text)
        high[n] += len(text) if x >= limit else 0
    for n in range(len(all_) - 1, 0, -1):
        all_[p.parent[n]] += all_[n]
        high[p.parent[n]] += high[n]
    back = {n for n in words if 2 * high[n] > all_[n]}
    p.mark = [0 if n in back else m for n, m in enumerate(p.mark)]
    return bool(back)


def classed(ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Which lines are content, and the threshold; a line of ratio 0 never is."""
    smooth = smoothed(ratios)
    limit = threshold(smooth)
    content = (smooth >= limit) & (ratios > 0)
    if not content.any() and (ratios > 0).any():
        content = (ratios > 0) & (smooth >= smooth[ratios > 0].max())
    return content, limit


def regions(p: Lines, content: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Which lines belong to the regions that the content lines choose, vetoed ones included.

    Outside article and main elements only seeds choose: content whose own ratio is above the threshold too, not just its neighbours'.
    """
    if not content.any():
        return content
    # an element's number is above its parent's
    section, article, main = [0] * len(p.names), [0] * len(p.names), [0] * len(p.names)
    for n in range(1, len(p.names)):
        up, name = p.parent[n], p.names[n]
        section[n] = n if name in SECTIONS else section[up]
        article[n] = article[up] or (n if name == "article" else 0)
        main[n] = main[up] or (n if name == "main" else 0)
    of = np.array([n for _, _, _, n in p.lines])
    size = np.array([len(text) for text, _, _, _ in p.lines]) * content
    section, article, main = np.array(section)[of], np.array(article)[of], np.array(main)[of]
    beside = np.unique(main[content & (main > 0) & (article == 0)])  # main elements with content beside their articles
    element = np.where(np.isin(main, beside) & (main > 0), main, np.where(article > 0, article, main))
    marked = element > 0
    taken = marked & np.isin(element, np.unique(element[content]))
    if 2 * size[marked].sum() >= size.sum():
        return taken
    free = np.flatnonzero((seeds if (seeds & ~marked).any() else content) & ~marked)
    taken |= ~marked & np.isin(section, np.unique(section[free]))
    # what lies between, inside the innermost element that holds all of it
    held = np.bincount(of[free], minlength=len(p.names)).tolist()
    for n in range(len(held) - 1, 0, -1):
        held[p.parent[n]] += held[n]
    common = max(n for n, k in enumerate(held) if k == len(free))
    inside = below(p, [n == common for n in range(len(p.names))]) if common else [True] * len(p.names)
    first, last = free[0], free[-1]
    between = np.arange(first, last + 1)
    taken[between] |= np.array(inside)[of[between]] & ~marked[between]
    while first and p.names[of[first - 1]] in HEADINGS:
        first -= 1
        taken[first] = True
    return taken


def main_text(html: str | None) -> str:
    p = Lines()
    p.feed(html or "")
    p.close()
    p.end_line()
    if not p.lines:
        return ""
    unmarked(p)
    for last in (False, True):
        hid = below(p, [m > 0 for m in p.mark])
        p.lines = [(text, tags, hid[n], n) for text, tags, _, n in p.lines]
        ratios = np.array([0.0 if hide else len(text) / max(1, tags) for text, tags, hide, _ in p.lines])
        content, limit = classed(ratios)
        if last or not overruled(p, limit):
            break
    return " ".join(text for (text, _, hide, _), use in zip(p.lines, regions(p, content, content & (ratios >= limit)), strict=True) if use and not hide)


def extract(pages: DataFrame) -> DataFrame:
    """pages(html, ...) with text and n_chars."""
    keep = [c for c in pages.columns if c not in ("text", "n_chars")]

    def f(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return pages.select(keep).mapInArrow(f, T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
