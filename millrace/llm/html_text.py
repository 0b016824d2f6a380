"""Main text of web pages by the distribution of line lengths.

Markup is stripped to lines, one a block; what stands in menus, headers, footers, notices,
forms and the like leaves lines of length 0, and so do mere links. Lengths are summed over sliding windows of lines:
a window whose sum dives to 0 parts the page, and the text between two such points is kept if the sum surges in it.
Markup only weighs: characters inside an element that names the content count more, and those outside it less.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The elements of HTML by what they do to text.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title svg math iframe object canvas audio video head".split())
SCRIPTS = {"script", "style"}
FURNITURE = set("nav footer aside form button select dialog menu".split())
CONTENT = set("article main".split())
FURNITURE_NAMES = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer "
    "header masthead menu menubar modal nav navbar navigation newsletter notice notices notification popup promo promoted promotion related "
    "respond sidebar sidebars share sharing signup skip social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
#: Words that say where furniture stands or how it is built, not what it is about.
PLACES = set(
    "site page main top bottom left right box block container wrapper wrap section area list item items inner outer bar panel column col row unit slot "
    "global primary secondary sticky fixed floating inline link links icon icons button buttons text label title body content holder module group region "
    "post posts article articles entry story stories form overlay mobile desktop small large mini the my user reader alert policy strip zone".split()
)
_ABOUT_OTHERS = {"with", "without", "has", "no", "js"}  # "has-sidebar" is what stands beside a sidebar
FURNITURE_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog menu menubar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: A slash that ends an element at once, not an unquoted address.
_SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*$""")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
#: Lines in a window.
WINDOW = 3
#: Characters that a window of a stretch must reach, if any of the page does.
SURGE = 60
#: What a character counts inside an element that names the content, and outside it on a page that has one.
INSIDE, OUTSIDE = SURGE, 1 / 8
#: A line with a larger share in links has length 0; an element whose name only hints at furniture is some if it has as much.
LINKED = 0.5
#: Outside content, such an element is furniture too if it has fewer characters.
HINTED = 80
#: Elements whose end tag may be left out: what begins after them, and in which elements it begins within them instead.
_P_ENDS = set("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section table ul".split())
_CELL_ENDS = set("td th tr tbody tfoot".split())
IMPLIED_ENDS = {
    "p": (_P_ENDS, ()), "li": ({"li"}, ("ul", "ol", "menu")), "dt": ({"dt", "dd"}, ("dl",)), "dd": ({"dt", "dd"}, ("dl",)),
    "td": (_CELL_ENDS, ("table",)), "th": (_CELL_ENDS, ("table",)), "tr": (_CELL_ENDS - {"td", "th"}, ("table",)),
}


def _is_furniture(name: str, attributes: str, in_content: bool) -> bool | None:
    """Whether an element is furniture; None where its class or id says so in one word beside others of another kind."""
    if name in FURNITURE or (name == "header" and not in_content):
        return True
    if not attributes or name in CONTENT or name in ("html", "body"):
        return False
    if _HIDDEN.search(attributes):
        return True
    hinted = False
    for kind, *values in _NAMES.findall(attributes):
        if kind.lower() == "role":
            if not FURNITURE_ROLES.isdisjoint("".join(values).lower().split()):
                return True
            continue
        names = FURNITURE_NAMES - {"header"} if in_content else FURNITURE_NAMES
        for given in "".join(values).split():
            words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", given).lower()) if w]
            if not words or words[0] in _ABOUT_OTHERS or words[-1] == "free" or names.isdisjoint(words):
                continue
            if all(w in FURNITURE_NAMES or w in PLACES for w in words):
                return True
            hinted = True
    return None if hinted else False


def lines_of(page: str) -> list[tuple[str, bool, float]]:
    """(text, in a content element, share of it in links) of every block, in page order; furniture as empty texts."""
    lines: list[tuple[str, bool, float]] = []
    held: list[str] = []
    linked = links = at = 0
    open_content: list[str] = []
    open_links = 0
    skipped = ""
    inner: Counter[str] = Counter()  # open elements within the skipped one
    outer: Counter[str] = Counter()  # those around it
    hints: list[tuple[str, int, int]] = []  # elements that may be furniture: name, how many of it are open, first line

    def judge(first: int) -> None:
        """Drops the lines of a hinted element that has few characters or is mostly links."""
        inside, size = bool(open_content), sum(len(x) for x, _, _ in lines[first:])
        if sum(len(x) * share for x, _, share in lines[first:]) > LINKED * size or (not inside and size < HINTED):
            lines[first:] = [("", False, 0.0)] * WINDOW

    def end(gap: bool = False) -> None:
        nonlocal held, linked, links
        text = " ".join("".join(held).split())
        share = min(1.0, linked / max(1, len(text)))
        menu = links > 1 and share > LINKED and not open_content  # several links in one line
        if text and not menu:
            lines.append((text, bool(open_content), share))
        if gap or menu:
            lines.extend([("", False, 0.0)] * WINDOW)
        held, linked, links = [], 0, 0

    for token in _TOKEN.finditer(page):
        if token.start() < at:
            continue
        if not skipped and token.start() > at:
            chunk = html.unescape(page[at : token.start()])
            held.append(chunk)
            linked += len(chunk) if open_links else 0
        at = token.end()
        name = (token[2] or "").lower()
        if not name:
            if token[0].startswith("<![CDATA[") and not skipped:
                held.append(token[0][9:].removesuffix("]]>"))
            continue
        closing, void = bool(token[1]), name in VOID or bool(_SELF_CLOSED.search(token[3]))
        if skipped:
            ends, within = IMPLIED_ENDS.get(skipped, ((), ()))
            if not closing and ((name in CONTENT and not open_content) or (name in ends and not any(inner[x] for x in within))):
                skipped = ""
            elif closing and inner[name] == 0 and name == skipped:
                skipped = ""
                continue
            elif closing and inner[name] == 0 and outer[name] > 0 and (name != "p" or skipped in INLINE):
                skipped = ""  # the end of an element around it
            else:
                if name in RAW and not closing and not void and (found := re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)):
                    at = found.end()
                elif not void:
                    inner[name] = max(0, inner[name] + (-1 if closing else 1))
                continue
        if name in RAW and not closing and not void:
            if name not in INLINE:
                end()
            found = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            if found:
                at = found.end()
            elif name in SCRIPTS:
                at = len(page)  # as browsers read it
            elif name in ("title", "textarea"):  # never closed: the text up to the next tag is what it names
                at = max(at, page.find("<", at)) if "<" in page[at:] else len(page)
            continue
        if name in INLINE:
            if name == "a":
                open_links = 0 if closing else 1
                links += open_links
            if not closing and not void and _is_furniture(name, token[3], bool(open_content)):
                skipped, inner = name, Counter()
            continue
        open_links = 0
        furniture = not closing and not void and _is_furniture(name, token[3], bool(open_content))
        if furniture:
            end(gap=True)
            skipped, inner = name, Counter()
            continue
        end(gap=name in CONTENT and not closing and not open_content)
        if not void:
            outer[name] = max(0, outer[name] + (-1 if closing else 1))
        while hints and hints[-1][0] == name and outer[name] < hints[-1][1]:
            judge(hints.pop()[2])
        if furniture is None:
            hints.append((name, outer[name], len(lines)))
        if name in CONTENT:
            if closing:
                while open_content and open_content.pop() != name:
                    pass
                if not open_content:
                    lines.extend([("", False, 0.0)] * WINDOW)
            else:
                open_content.append(name)
    if at < len(page) and not skipped:
        held.append(html.unescape(page[at:]))
    end()
    while hints:
        judge(hints.pop()[2])
    return lines


def main_text(page: str | None) -> str:
    """The article's blocks, joined by one space; "" if there are none. Stretches that surge alike are all kept."""
    lines = lines_of(page or "")
    named = any(inside for _, inside, _ in lines)
    lengths = [0.0 if share > LINKED else len(text) * (INSIDE if inside else OUTSIDE if named else 1) for text, inside, share in lines]
    sums = [sum(lengths[k : k + WINDOW]) for k in range(max(1, len(lengths) - WINDOW + 1))]
    surge = min(SURGE, max(sums))
    dives = [False] * (len(lines) + 1)
    for k, total in enumerate(sums):
        if total == 0:
            dives[k : k + WINDOW] = [True] * min(WINDOW, len(lines) - k)
    dives[-1:] = [True]
    kept: list[str] = []
    begun = 0
    for k, dive in enumerate(dives):
        if dive:
            if begun < k and max(sums[max(0, begun - WINDOW + 1) : k]) >= surge:
                # Links at the ends of a stretch stay where the page names them as content, as those amid its text do.
                first, last = begun, k
                while first < last and not lengths[first] and not lines[first][1]:
                    first += 1
                while first < last and not lengths[last - 1] and not lines[last - 1][1]:
                    last -= 1
                kept += [text for text, _, _ in lines[first:last] if text]
            begun = k + 1
    return " ".join(kept)


def page_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page, from the whole html.

    Null and empty html, and pages without main text, give an empty text. Repeated rows are
    each returned; an empty table gives no rows; columns other than url are ignored, a missing url is null.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(x) for x in batch["_html"]]
            yield pd.DataFrame({"page_id": batch["_id"].astype("Int64"), "url": batch["_url"], "text": text, "n_chars": [len(x) for x in text]})

    url = F.col("url") if "url" in pages.columns else F.lit(None)
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), url.cast("string").alias("_url"), F.col(html_col).alias("_html"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
