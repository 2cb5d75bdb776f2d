"""HTML extraction by line-block distribution: markup is stripped to lines (one a block element), weighted text
lengths are summed over sliding windows of lines, and the text between the first surge and the last dive of that
curve is kept.

What the markup says is only a weight of a line's length, so it moves the curve and decides nothing by itself:
text within <article> or <main> counts for more, text within a form or an element whose class speaks of menus,
adverts, notices, comments and the like for a fiftieth, a row of bare links likewise. The heaviest window gives
the weight of the main text; lighter lines between surge and dive are the valleys and go. A wrapper whose class
misleads makes the whole curve lower and changes nothing. The range between surge and dive is closed over the
containers that hold its long lines, so that short closing paragraphs stay, and short lines of other containers
at its ends go. One pass in Arrow batches; a page is judged on its own.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import pieces, table

#: Lines in a window; the length of a window at the surge; the length of a line that speaks for its container.
WINDOW, SURGE, LONG = 3, 120, 80
#: A window is above the dive with this share of the heaviest one, or with SURGE.
DIVE = 0.125
#: Weights: within <article>, within <main>, beside the text by class, within a form, a row of links; of
#: a title, where containers are compared.
ARTICLE, MAIN, ASIDE, FORM, LINKS, TITLE = 20.0, 4.0, 0.02, 0.002, 0.02, 5
#: Lines that are all link, one after another, from which they are a menu; the share of link in each.
MENU_LINES, LINK_SHARE = 3, 0.9
# Element names by what they do to the text.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
#: Never text of an article, whatever is in them.
WITHOUT_TEXT = {
    "head", "nav", "footer", "aside", "menu", "dialog", "noscript", "template", "svg", "math", "canvas", "object", "audio", "video", "map",
    "select", "button", "datalist", "label",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTAINERS = {"article", "aside", "body", "center", "details", "dialog", "div", "fieldset", "footer", "form", "header", "html", "main", "nav", "search", "section"}
BLOCK = CONTAINERS | HEADINGS | {
    "address", "blockquote", "caption", "dd", "dir", "dl", "dt", "figcaption", "figure", "head", "hgroup", "hr", "legend", "li", "menu", "ol",
    "optgroup", "option", "p", "pre", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Words of a class or an id that say that an element isn't the article's; the last line only outside of an article.
ASIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion",
    "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar",
    "footer", "sidebar", "rail", "widget", "related", "recommended", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup",
    "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "paywall", "share", "sharing", "social", "comment",
    "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion", "copyright", "disclaimer", "search", "skip",
}
TOP_WORDS = {"header", "masthead", "banner"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar"}
#: Elements whose class says nothing of what stands in them.
PLAIN = {"html", "body", "article", "main"} | HEADINGS

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_SPACE, _WORDS = re.compile(r"\s+"), re.compile(r"[^a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|$)", re.IGNORECASE | re.ASCII) for name in RAW}


class Line(NamedTuple):
    text: str
    weight: float
    home: int  # the container around it
    heading: str
    link: float  # the share of it that is link


def _tag_end(html: str, pos: int) -> tuple[int, list[tuple[str, str]]]:
    """The place after the > of a tag whose name ends at pos (-1 if the page ends first), and its attributes. A >
    within a quoted value is part of that value, however long it is."""
    found = []
    while True:
        m = _ATTRIBUTE.match(html, pos)
        if m is None:
            break
        found.append((m[1].lower(), (m[2] or m[3] or m[4] or "").strip().lower()))
        pos = m.end()
    end = html.find(">", pos)
    return (end + 1 if end >= 0 else -1), found


def _weight(name: str, attributes: list[tuple[str, str]], named: bool) -> float:
    """The weight that an element gives to the text in it."""
    if name in WITHOUT_TEXT or name == "header" and not named:
        return 0.0
    weight = FORM if name in ("form", "fieldset") else 1.0
    for key, value in attributes if name not in PLAIN else ():
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
            return 0.0
        if key == "role" and value in ROLES:
            weight = min(weight, ASIDE)
        elif key in ("class", "id"):
            words = _WORDS.split(value)
            if not ASIDE_WORDS.isdisjoint(words) or not named and not TOP_WORDS.isdisjoint(words):
                weight = min(weight, ASIDE)
    return weight


def lines_of(html: str) -> list[Line]:
    """The lines with text, in page order."""
    lines: list[Line] = []
    words: list[str] = []
    stack: list[tuple[str, float, int]] = []  # (name, weight within, container within)
    open_names: Counter[str] = Counter()
    linked, made = 0, 0

    def flush():
        nonlocal linked
        raw = "".join(words)
        words.clear()
        text = _SPACE.sub(" ", unescape(raw)).strip()
        if text:
            name, weight, home = stack[-1] if stack else ("", 1.0, 0)
            heading = next((h for h in HEADINGS if open_names[h]), "")
            if open_names["article"]:
                weight *= ARTICLE
            elif open_names["main"]:
                weight *= ARTICLE if heading == "h1" else MAIN
            lines.append(Line(text, weight, home, heading, linked / max(1, len(raw))))
        linked = 0

    def pop():
        open_names[stack.pop()[0]] -= 1

    def say(text: str):
        nonlocal linked
        words.append(text)
        if open_names["a"]:
            linked += len(text)

    pos, n = 0, len(html)
    while pos < n:
        lt = html.find("<", pos)
        if lt < 0 or lt + 1 >= n:
            say(html[pos:])
            break
        say(html[pos:lt])
        nxt = html[lt + 1]
        if nxt in "!?":
            end = html.find("-->", lt + 4) + 3 if html.startswith("<!--", lt) else html.find(">", lt) + 1
            pos = end if end > lt else n
            continue
        closing = nxt == "/"
        m = _NAME.match(html, lt + 1 + closing)
        if not m:
            if closing:
                pos = html.find(">", lt) + 1 or n
            else:
                say("<")
                pos = lt + 1
            continue
        name = m[0].lower()
        pos, attributes = _tag_end(html, m.end())
        if pos < 0:
            break  # the page ends inside a tag
        if name in BLOCK:
            flush()
        elif name == "br":
            words.append(" ")
        if closing:
            if open_names[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in RAW:
            close = _RAW_END[name].search(html, pos)
            pos = (html.find(">", close.end()) + 1 or n) if close else n
            continue
        if name in VOID or html[pos - 2] == "/" and name not in BLOCK:
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and (open_names["p"] or open_names[name]):
            # Such elements end where the next begins.
            fence = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}.get(name, ())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name or stack[k][0] == "p":
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in fence or stack[k][0] in BLOCK:
                    break
        _, weight, home = stack[-1] if stack else ("", 1.0, 0)
        weight *= _weight(name, attributes, bool(open_names["article"] or open_names["main"]))
        if name in CONTAINERS and (name in ("article", "main") or not open_names["article"]):
            made += 1
            home = made
        stack.append((name, weight, home))
        open_names[name] += 1
    flush()
    return lines


def weighted(lines: list[Line]) -> list[float]:
    """The weights of lines, those of a menu without a name lowered."""
    weights = [x.weight for x in lines]
    start = 0
    for i in range(len(lines) + 1):
        if i < len(lines) and lines[i].link >= LINK_SHARE and weights[i] <= MAIN:
            continue
        if i - start >= MENU_LINES:
            weights[start:i] = [w * LINKS for w in weights[start:i]]
        start = i + 1
    return weights


def windows(curve: list) -> list:
    """The sums of WINDOW lines from each line on."""
    return [sum(curve[i : i + WINDOW]) for i in range(len(curve))]


def base_of(lines: list[Line], weights: list[float], sizes: list[int]) -> tuple[float, int]:
    """The weight and the container of the main text, both from the heaviest window. Lowered lines have a say only
    where the rest has no window as long as a surge, and they have one or a title; (0, 0) if there is no text."""
    full = windows([w * s if w >= 1 else 0 for w, s in zip(weights, sizes, strict=True)])
    low = windows([w * s if w < 1 else 0 for w, s in zip(weights, sizes, strict=True)])
    at = max(range(len(lines)), key=full.__getitem__, default=0)
    lowered = max(range(len(lines)), key=low.__getitem__, default=0)

    def length(start: int, lower: bool) -> int:
        return sum(sizes[i] for i in range(start, min(start + WINDOW, len(lines))) if weights[i] and (weights[i] < 1) == lower)

    titled = any(x.heading == "h1" and w for x, w in zip(lines[lowered : lowered + WINDOW], low[lowered : lowered + WINDOW], strict=True))
    if length(at, False) < SURGE and (titled or length(lowered, True) >= SURGE):
        at, curve = lowered, [w * s if w < 1 else 0 for w, s in zip(weights, sizes, strict=True)]
    else:
        curve = [w * s if w >= 1 else 0 for w, s in zip(weights, sizes, strict=True)]
    within = [i for i in range(at, min(at + WINDOW, len(lines))) if curve[i]]
    if not within:
        return 0.0, 0
    by_home: Counter[int] = Counter()
    for i in within:
        by_home[lines[i].home] += curve[i] * (TITLE if lines[i].heading == "h1" else 1)
    return weights[max(within, key=curve.__getitem__)], by_home.most_common(1)[0][0]


def extract(html: str | None) -> str:
    """The main text of a page, its blocks joined by one newline; empty if there is none."""
    if not html:
        return ""
    lines = lines_of(html)
    weights = weighted(lines)
    sizes = [len(x.text) for x in lines]
    base, main = base_of(lines, weights, sizes)
    if not base:
        return ""
    own = [i for i in range(len(lines)) if weights[i] >= base]
    window = windows([s if w >= base else 0 for s, w in zip(sizes, weights, strict=True)])
    dive = min(SURGE, max(window) * DIVE)
    above = [i for i, x in enumerate(window) if x >= dive]
    first, last = above[0], min(above[-1] + WINDOW, len(lines)) - 1
    inside = [i for i in own if first <= i <= last]
    # The containers that speak for the text; their lines are its text up to their ends.
    homes = {lines[i].home for i in inside if sizes[i] >= LONG} | {main}
    ours = [i for i in own if lines[i].home in homes]
    first, last = min(first, ours[0]), max(last, ours[-1])
    opening = next((i for i in own if first <= i <= ours[-1] and lines[i].heading == "h1"), first)
    if all(sizes[i] < SURGE or lines[i].home != main for i in own if first <= i < opening):
        first = opening  # what stands before the title isn't part of it
    kept = [i for i in own if first <= i <= last]
    strange = lambda i: lines[i].home not in homes and not lines[i].heading
    while kept and strange(kept[0]):
        kept.pop(0)
    while kept and strange(kept[-1]):
        kept.pop()
    return "\n".join(lines[i].text for i in kept)


def extract_pages(pages: DataFrame, html_col: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The carried columns, text and n_chars (code points). A null or empty page has the empty text; repeated
    rows get equal texts; of equal windows the first is the heaviest; the whole page is read, whatever its length.
    Other columns, whatever their names, aren't read; an empty table gives an empty one."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch, "h"):
                texts = [extract(h) for h in part.column("h").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["row", "text", "n_chars"])

    packed = pages.select(F.struct(*[pages[c] for c in carry]).alias("row"), pages[html_col].alias("h"))
    out = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, text string, n_chars long")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in carry], "text", "n_chars")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    return extract_pages(table(spark, sf_dir, "pages"))
