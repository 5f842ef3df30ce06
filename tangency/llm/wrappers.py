"""Main text of web pages by wrappers inferred for each host.

A wrapper is a union-free regular expression over page structure: elements in order, each required or optional (?) and single or repeated (+),
with text slots.  It is inferred by alignment.  A page's elements are folded (adjacent repetitions of one to three siblings become a
repeated group); two such expressions are aligned by their longest common subsequence of element signatures (tag, class, id, role); what only one of them
has becomes optional, a run that the other repeats joins its group, what both have is aligned inside, and differing text becomes a slot.  Sibling lists of over ``LOOP`` items
become one repeated group of optional items (each keeps what it is told to be, their order is not told), so a wrapper is no larger than its host's distinct elements.

How it runs.  Pages of one host and one folded shape have one expression; tasks add up what their slots hold, and partial sums meet by (host, shape).
Distinct shapes are aligned in the order of their text, first in ``SALTS`` parts of a host, streamed, then part by part.  So a host with a third of all
pages is many small groups, and the wrapper does not depend on partitions or the order of rows.

Every page is then matched against its host's expression, item by item, and the item decides what its text is (``judged``):

* The article is the host's ``article`` elements (of nested ones the outer, the inner are comments; those in ``main`` before others; beside one with an h1 no teasers), with the h1 before them if they have none, else ``main``, else the element that gathers
  most slot text outside links, not further in than where its h1 is.
* Cut are tags (nav, footer, aside, form, ...), roles, hidden elements and elements with a class such as ``site-footer`` or ``comments``, or an id made of such words only (``related-work`` is the slug of a
  heading).  A mark is part of an element's signature, so marked and unmarked elements are never one item.  Such marks do not count on html, body, the article, an element
  that holds the article, or one that holds h1 and over half of all text; nor do ``no-sidebar``, ``has-sidebar``, ``comments-open``.  Of headers inside the article the headings stay.
* Outside ``article`` and ``main`` elements, repeated groups and lists that are mostly links are cut, and so is a slot with one text on ``DISTINCT`` different pages at
  least and on nine in ten of a host's, where a page has that very text; but not if such slots are the larger part of the article (copies of one page).

A page for which its host's wrapper leaves nothing is its own wrapper.  Nulls: null html is the empty page and gives ''; a null url is the host ''.  Cut-off pages, unclosed elements and stray ends are read as
browsers do; a tag that never ends takes the rest of the page.  Elements over ``DEPTH`` deep are siblings at that depth.  Repeated rows are extracted each.  A page without elements is its text.  Reading is linear in the page.
"""

from __future__ import annotations

import hashlib
import html as html_
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tangency.llm.common import map_arrow, partitions, rows, slices, texts_of, written

DISTINCT = 5  # different pages that tell a constant slot
SENT_BYTES = 32 << 20  # wrappers are sent to all tasks up to this size, else joined
DEPTH = 64
LOOP = 32
HELD_BITS = 1 << 29  # of a table for the longest common subsequence that is held at once
SALTS = 256
KNOWN = 20_000  # elements whose meaning a task remembers
HELD = 300_000  # items of shapes that a task holds or remembers
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[\"'>]")
_ATTR = re.compile(r"""([^\s=/>"']++)\s*+(?:=\s*+("[^"]*"|'[^']*'|[^\s>"']\S*+)?)?""")
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "object", "canvas", "video", "audio"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul"}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
_P_SCOPE = {"article", "main", "section", "div", "td", "th", "li", "body", "blockquote", "aside", "header", "footer", "nav", "form"}
_OUT_TAGS = {"nav", "footer", "aside", "form", "head", "button", "select", "dialog", "menu", "fieldset"}
_OUT_ROLES = {"navigation", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
_OUT_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "alert", "alerts", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "consent", "cookie", "cookies", "copyright",
    "disqus", "footer", "form", "gdpr", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promoted",
    "promotion", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar",
}
_HEADER_WORDS = {"header", "masthead", "topbar", "banner"}
_WHOLE_WORDS = {"widget", "widgets"}
_OUT_STARTS, _OUT_ENDS = ("comment", "advert", "sidebar", "cookie", "newsletter", "breadcrumb"), ("footer", "sidebar", "navbar", "menu", "comments", "nav")
_NOT_SO = {"no", "not", "non", "has", "have", "with", "without", "open", "closed", "close", "collapsed", "enabled", "disabled", "free", "off", "on"}
#: What an id of page furniture is made of, beside the words above; an id with any other part is the slug of a heading.
_PLAIN_WORDS = {
    "area", "articles", "banner", "bar", "block", "bottom", "box", "btn", "button", "buttons", "center", "col", "column", "container", "content", "div", "embed", "float", "global", "google", "gpt", "header", "holder",
    "inner", "item", "items", "large", "left", "link", "links", "list", "lower", "main", "mobile", "outer", "page", "pages", "panel", "popular", "post", "posts", "primary", "region", "right", "row", "secondary", "section", "site",
    "slot", "small", "stories", "sub", "thread", "tools", "top", "unit", "upper", "widget", "wide", "wrap", "wrapper", "zone",
}
_PLAIN_ENOUGH = {"ad", "ads", "adsense", "advert", "advertisement", "adverts", "comment", "comments", "disqus", "replies", "respond"}  # on elements that carry slugs
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_SLUG_TAGS = {"h1", "h2", "h3", "h4", "h5", "h6", "section", "p", "li", "dt", "dd", "td", "th", "tr", "table", "figure", "blockquote", "pre", "a", "span"}
_OF_ARTICLE = {"article", "post", "entry", "story", "content"}
CUT, HEADER = 1, 2  # how an element is marked
_MARKED = {0: "!plain", CUT: "!cut", HEADER: "!header"}
_BY_TAG = {t: CUT for t in _OUT_TAGS} | {"header": HEADER}

# -------------------------------------------------------------------------------------------------------- reading


def _marks(words: Iterable[str]) -> int:
    """How an element with these classes and this id is marked."""
    found = 0
    for token in words:
        parts = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
        if not parts or _NOT_SO.intersection(parts):
            continue
        if parts[0] in _OUT_WORDS or parts[-1] in _OUT_WORDS or len(parts) == 1 and parts[0] in _WHOLE_WORDS:
            return CUT
        if parts[0].startswith(_OUT_STARTS) or parts[-1].endswith(_OUT_ENDS):
            return CUT
        if (parts[0] in _HEADER_WORDS or parts[-1] in _HEADER_WORDS) and not _OF_ARTICLE.intersection(parts):
            found = HEADER
    return found


def _id_marks(tag: str, id_: str) -> int:
    """How an id marks its element.  Slugs of headings are the commonest ids, so all its parts must be words of page furniture, elements that carry slugs are marked as comments and adverts only, and headings never."""
    parts = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", id_).lower())
    if tag in _SLUG_TAGS:
        return CUT if tag not in _HEADINGS and set(parts) <= _PLAIN_WORDS | _PLAIN_ENOUGH and _PLAIN_ENOUGH.intersection(parts) else 0
    if set(parts) <= _PLAIN_WORDS | _OUT_WORDS | _HEADER_WORDS | _WHOLE_WORDS or len(parts) == 1:
        return _marks([id_])
    return 0


def _element(tag: str, attrs: str) -> tuple[str, int]:
    """Signature of an element, its mark being part of it, and how it is marked."""
    own = CUT if tag in _OUT_TAGS else HEADER if tag == "header" else 0
    a: dict[str, str] = {}
    for k, v in _ATTR.findall(attrs):
        a.setdefault(k.lower(), v.strip("\"'"))
    cls, id_, role = a.get("class", "").split(), a.get("id", "").strip(), a.get("role", "").strip().lower()
    if "hidden" in a or "display:none" in a.get("style", "").lower().replace(" ", "") or a.get("aria-hidden", "").strip().lower() == "true" or role in _OUT_ROLES:
        own = CUT
    elif tag not in ("html", "body"):
        found = own, _marks(cls), _id_marks(tag, id_), HEADER if role == "banner" else 0
        own = CUT if CUT in found else HEADER if HEADER in found else 0
    id_ = "" if re.search(r"\d", id_) else id_  # numbered ids name one element of one page
    kept = " ".join(c for c in cls if not re.search(r"\d{2}", c))
    return tag + "".join(f"{m}{x}" for m, x in ((".", kept), ("#", id_), ("@", role)) if x) + (_MARKED[own] if own != _BY_TAG.get(tag, 0) else ""), own


class Page:
    """Elements of a page in order (a parent comes before its children), and its texts in order, each with its element; -1 is a border of blocks."""

    def __init__(self) -> None:
        self.tags, self.sigs, self.marks, self.kids = ["#root"], ["#root"], [0], [[]]
        self.texts: list[tuple[int, str]] = []
        self.chars, self.linked, self.said = [0], [0], [[]]


def _tag_end(page: str, at: int, unclosed: set[str]) -> int:
    """Where the tag's > is, quoted values passed over, or the page's length."""
    while True:
        m = _STOP.search(page, at)
        if not m:
            return len(page)
        k = m.start()
        if page[k] == ">":
            return k
        before = k - 1
        while page[before].isspace():
            before -= 1
        at = k + 1
        if page[before] == "=" and page[k] not in unclosed:
            end = page.find(page[k], at)
            if end < 0:
                unclosed.add(page[k])
            else:
                at = end + 1


def read_page(page: str, known: dict | None = None) -> Page:
    known = {} if known is None else known
    out = Page()
    stack, names, links = [0], {}, 0  # names: depths at which elements of a tag are open
    unclosed: set[str] = set()
    at = 0

    def said(text: str) -> None:
        if text:
            e = stack[-1]
            plain = html_.unescape(text) if "&" in text else text
            out.texts.append((e, plain))
            size = 0 if plain.isspace() else len(plain)
            out.chars[e] += size
            out.linked[e] += size if links else 0
            out.said[e].append(plain)

    def close(depth: int) -> None:
        if any(out.tags[e] not in _INLINE for e in stack[depth:]):
            out.texts.append((-1, "\n"))
        for e in stack[depth:]:
            names[out.tags[e]].pop()
        del stack[depth:]

    def deepest(tags: Iterable[str]) -> int:
        return max((names[t][-1] for t in tags if names.get(t)), default=0)

    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            said(page[at:])
            break
        m = _NAME.match(page, lt)
        if not m:
            if page.startswith("<!--", lt):
                said(page[at:lt])
                end = page.find("-->", lt + 4)
                at = end + 3 if end >= 0 else len(page)
            elif page[lt + 1 : lt + 2] in ("!", "?"):
                said(page[at:lt])
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else len(page)
            else:
                said(page[at : lt + 1])
                at = lt + 1
            continue
        said(page[at:lt])
        end = _tag_end(page, m.end(), unclosed)
        at = end + 1
        if end == len(page):
            break
        tag = m[1].lower()
        if page[lt + 1] == "/":
            if tag == "a":
                links = max(0, links - 1)
            if names.get(tag):
                close(names[tag][-1])
            elif tag not in _INLINE:
                out.texts.append((-1, "\n"))
            continue
        if tag in _RAW:
            raw = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = _tag_end(page, raw.end(), unclosed) + 1 if raw else len(page)
            continue
        if tag in ("br", "hr"):
            out.texts.append((-1, "\n"))
            continue
        attrs = page[m.end() : end]
        if tag in _VOID or attrs.endswith("/") and tag not in _INLINE and tag not in _ENDS_P and tag != "p":
            continue
        element = known.get((tag, attrs))
        if element is None:
            element = _element(tag, attrs)
            if len(attrs) < 200:
                if len(known) > KNOWN:
                    known.clear()
                known[tag, attrs] = element
        sig, mark = element
        if tag in _INLINE:
            if tag == "a":
                links += 1
            if not mark:
                continue
        else:
            if tag in _ENDS_P:
                links = 0
            shut = _CLOSES.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
            depth = deepest(shut)
            if depth and depth >= deepest(_SCOPE.get(tag, _P_SCOPE)):
                close(depth)
            out.texts.append((-1, "\n"))
        e = len(out.tags)
        if len(stack) >= DEPTH:
            mark, sig = mark or out.marks[stack[-1]], sig if mark or not out.marks[stack[-1]] else f"{sig}{_MARKED[out.marks[stack[-1]]]}"
        out.kids[stack[min(len(stack), DEPTH) - 1]].append(e)
        out.tags.append(tag)
        out.sigs.append(sig)
        out.marks.append(mark)
        out.kids.append([])
        out.chars.append(0)
        out.linked.append(0)
        out.said.append([])
        names.setdefault(tag, []).append(len(stack))
        stack.append(e)
    return out


# ------------------------------------------------------------------------------------------------------ wrappers

# An item of a wrapper: signature, optional, repeated, items, pages, slot text, link text, constant, mark, page marks; of a single page also its elements.
# Page marks are hashes of ``DISTINCT`` different pages of a constant slot, so that copies of a page count once.  A group has the signature "(a b)", a loop "(*)".
SIG, OPT, REP, KIDS, PAGES, CHARS, LINKED, SAME, OUT, MARKS, NODES = range(11)
ANY = "(*)"


def _slot(said: str) -> str:
    """What tells one slot text from another, its length and a hash of the whole; none for no text."""
    said = " ".join(said.split())
    return f"{len(said)}:{hashlib.blake2b(said.encode('utf-8', 'replace'), digest_size=8).hexdigest()}" if said else ""


def items_of(page: Page, text: str) -> list[list]:
    """The folded items of one page, marked by its hash, under one root."""
    mark = hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest()
    made: list = [None] * len(page.tags)
    for e in range(len(page.tags) - 1, -1, -1):
        slot = _slot("".join(page.said[e]))
        made[e] = [page.sigs[e], False, False, fold([made[k] for k in page.kids[e]]), 1, page.chars[e], page.linked[e], slot, page.marks[e], [mark] if slot else [], [e]]
    return [made[0]]


def fold(items: list[list]) -> list[list]:
    """Adjacent repetitions as one repeated item, or group of two or three."""
    for period in (1, 2, 3):
        out: list[list] = []
        i = 0
        while i < len(items):
            sigs = [x[SIG] for x in items[i : i + period]]
            n = 1
            while len(sigs) == period and [x[SIG] for x in items[i + n * period : i + (n + 1) * period]] == sigs:
                n += 1
            if n > 1:
                together = items[i : i + period]
                for k in range(1, n):
                    together = [join(a, b, False) for a, b in zip(together, items[i + k * period : i + (k + 1) * period], strict=True)]
                if period == 1:
                    together[0][REP] = True
                    out += together
                else:
                    out.append(_group(together))
                i += n * period
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _group(members: list[list], sig: str = "") -> list:
    return [sig or f"({' '.join(x[SIG] for x in members)})", False, True, members, max(x[PAGES] for x in members), 0, 0, "", 0, [], []]


def join(a: list, b: list, pages: bool = True) -> list:
    """Two items of one signature, aligned inside; ``pages``: of different pages."""
    same = a[SAME] if a[SAME] == b[SAME] else None
    marks = sorted({*a[MARKS], *b[MARKS]})[:DISTINCT] if same else []
    count = a[PAGES] + b[PAGES] if pages else max(a[PAGES], b[PAGES])
    a[NODES].extend(b[NODES])
    return [a[SIG], a[OPT] or b[OPT], a[REP] or b[REP], align(a[KIDS], b[KIDS], pages), count, a[CHARS] + b[CHARS], a[LINKED] + b[LINKED], same, max(a[OUT], b[OUT]), marks, a[NODES]]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence."""
    if a == b:
        return [(i, i) for i in range(len(a))]
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    inner = _longest(a[head : len(a) - tail], b[head : len(b) - tail])
    return [(i, i) for i in range(head)] + [(i + head, j + head) for i, j in inner] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def _rows(x: list[str], y: list[str]) -> Iterator[int]:
    """For each start of ``x`` a number whose bit j is 0 where one more of ``y`` makes the common subsequence longer."""
    at: dict[str, int] = {}
    for j, s in enumerate(y):
        at[s] = at.get(s, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    for s in x:
        same = row & at.get(s, 0)
        row = ((row + same) | (row - same)) & full
        yield row


def _longest(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """By bit vectors, a row for each item of ``x``; beyond ``HELD_BITS`` of rows halves are solved apart (Hirschberg), with the same length."""
    n, m = len(x), len(y)
    if not n or not m:
        return []
    if n > 1 and n * m > HELD_BITS:
        half = n // 2
        *_, front = _rows(x[:half], y)
        *_, back = _rows(x[:half - 1 : -1], y[::-1])
        lengths = [0]
        for j in range(m):
            lengths.append(lengths[-1] + (not front >> j & 1))
        best, at, behind = -1, 0, sum(not back >> j & 1 for j in range(m))
        for j in range(m + 1):
            if lengths[j] + behind > best:
                best, at = lengths[j] + behind, j
            behind -= j < m and not back >> (m - 1 - j) & 1
        return _longest(x[:half], y[:at]) + [(i + half, j + at) for i, j in _longest(x[half:], y[at:])]
    kept = list(_rows(x, y))
    out, i, j = [], n - 1, m - 1
    while i >= 0 and j >= 0:
        if kept[i] >> j & 1:
            j -= 1
        elif i and not kept[i - 1] >> j & 1:
            i -= 1
        else:
            out.append((i, j))
            i, j = i - 1, j - 1
    return out[::-1]


def regrouped(items: list[list], other: list[list]) -> list[list]:
    """Runs of ``items`` that ``other`` has as a repeated group, as that group."""
    for g in other:
        if g[SIG][0] == "(" and g[SIG] != ANY and all(x[SIG] != g[SIG] for x in items):
            sigs = [x[SIG] for x in g[KIDS]]
            for i in range(len(items) - len(sigs) + 1):
                if [x[SIG] for x in items[i : i + len(sigs)]] == sigs:
                    items = [*items[:i], _group(items[i : i + len(sigs)]), *items[i + len(sigs) :]]
                    break
    return items


def looped(items: list[list], pages: bool) -> list[list]:
    """One repeated group of optional items, a signature each."""
    kinds: dict[str, list] = {}
    todo = list(reversed(items))
    while todo:
        x = todo.pop()
        if x[SIG][0] == "(":
            todo += reversed(x[KIDS])
        elif x[SIG] in kinds:
            kinds[x[SIG]] = join(kinds[x[SIG]], x, pages)
        else:
            kinds[x[SIG]] = x
    return [_group([[x[SIG], True, *x[REP:]] for _, x in sorted(kinds.items())], ANY)]


def align(a: list[list], b: list[list], pages: bool = True) -> list[list]:
    """Common items are joined, the rest is optional."""
    if not a and not b:
        return []
    if any(x[SIG] == ANY for x in (*a, *b)):
        return looped([*a, *b], pages)
    a, b = regrouped(a, b), regrouped(b, a)
    out, i, j = [], 0, 0
    for p, q in [*common([x[SIG] for x in a], [x[SIG] for x in b]), (len(a), len(b))]:
        out += [[x[SIG], True, *x[REP:]] for x in (*a[i:p], *b[j:q])]
        if p < len(a):
            out.append(join(a[p], b[q], pages))
        i, j = p + 1, q + 1
    return looped(out, pages) if len(out) > LOOP else out


def matched(items: list[list], places: list[list], kept: bool = False) -> Iterator[tuple[list, list]]:
    """Items of a page in order, each with its item of the judged expression; one that the expression has no place for is kept if it is in ``kept`` text and has no mark."""
    if any(x[SIG] == ANY for x in places):
        of = {x[SIG]: x for g in places for x in (g[KIDS] if g[SIG] == ANY else [g])}
        again, found = items, [places[0] if x[SIG][0] == "(" else of.get(x[SIG]) for x in items]
    else:
        again = regrouped(items, places)
        at = dict(common([x[SIG] for x in again], [x[SIG] for x in places]))
        found = [places[at[i]] if i in at else None for i in range(len(again))]
    for x, w in zip(again, found, strict=True):
        if w is None:
            w = [x[SIG], False, False, [], kept and not x[OUT], ""]
        yield x, w
        yield from matched(x[KIDS], places if w[SIG] == ANY else w[KIDS], w[KEPT])


def as_expression(items: list[list]) -> str:
    """A wrapper for people: its union-free expression."""
    out = []
    for x in items:
        slot = "" if not x[CHARS] else " #text"
        inner = as_expression(x[KIDS])
        body = f"{inner}" if x[SIG].startswith("(") else f"<{x[SIG].partition('!')[0]}>{slot}{' ' + inner if inner else ''}"
        out.append(f"({body}){'+' if x[REP] else ''}{'?' if x[OPT] else ''}")
    return " ".join(out)


def shape(items: list[list]) -> str:
    """Structure of folded items without what they hold."""
    bare = lambda xs: [[x[SIG], int(x[REP]), x[OUT], bare(x[KIDS])] for x in xs]
    return json.dumps(bare(items), separators=(",", ":"))


def summed(a: list[list], b: list[list]) -> list[list]:
    """What the slots of pages of one shape hold."""
    out = []
    for x, y in zip(a, b, strict=True):
        same = x[SAME] if x[SAME] == y[SAME] else None
        marks = sorted({*x[MARKS], *y[MARKS]})[:DISTINCT] if same else []
        out.append([x[SIG], x[OPT], x[REP], summed(x[KIDS], y[KIDS]), x[PAGES] + y[PAGES], x[CHARS] + y[CHARS], x[LINKED] + y[LINKED], same, x[OUT], marks, []])
    return out


def wrapper_of(pages: list[str]) -> list[list]:
    """The wrapper of pages of one host."""
    shapes: dict[str, list] = {}
    for p in pages:
        one = items_of(read_page(p), p)
        key = shape(one)
        shapes[key] = summed(shapes[key], one) if key in shapes else one
    out: list[list] | None = None
    for _, one in sorted(shapes.items()):
        out = one if out is None else align(out, one)
    return out or []


# ------------------------------------------------------------------------------------------------------ judgement


def _tag(x: list) -> str:
    return re.split(r"[.#@!]", x[SIG], maxsplit=1)[0]


class Judge:
    """Decides which items of a wrapper are article text."""

    def __init__(self, wrapper: list[list]) -> None:
        self.size: dict[int, tuple[int, int, bool, bool]] = {}
        for x in wrapper:
            self._measure(x)
        self.all = sum(self.size[id(x)][0] for x in wrapper)
        self.pages = max((x[PAGES] for x in wrapper), default=0)

    def _measure(self, x: list) -> tuple[int, int, bool, bool]:
        """Text, link text, whether there is an article or main element inside, whether an h1 is there."""
        text, linked, main, h1 = x[CHARS], x[LINKED], False, _tag(x) == "h1" and x[CHARS] > 0
        for k in x[KIDS]:
            t, l, m, h = self._measure(k)
            text, linked, main, h1 = text + t, linked + l, main or m or self.is_main(k) and t > 0 and k[OUT] != CUT, h1 or h
        if x[OUT] == CUT and _tag(x) in ("nav", "footer", "aside"):
            main = False  # teasers
        self.size[id(x)] = text, linked, main, h1
        return self.size[id(x)]

    @staticmethod
    def is_main(x: list) -> bool:
        return _tag(x) in ("article", "main") or "@main" in x[SIG]

    def cut(self, x: list) -> bool:
        """Whether the element's mark counts."""
        text, _, main, h1 = self.size[id(x)]
        if not x[OUT] or _tag(x) in ("html", "body") or self.is_main(x) and x[OUT] != CUT:
            return False
        return not (main or h1 and 2 * text > self.all and _tag(x) not in ("nav", "footer", "aside", "head"))

    def weight(self, x: list) -> int:
        if self.cut(x):
            return 0
        own = max(0, x[CHARS] - 2 * x[LINKED])
        return own + sum(map(self.weight, x[KIDS]))

    def _mains(self, items: list[list], want: str) -> list[list]:
        """Outermost elements of a kind that hold text."""
        out = []
        for x in items:
            if self.cut(x):
                continue
            is_one = _tag(x) == "article" if want == "article" else _tag(x) == "main" or "@main" in x[SIG]
            if is_one and self.size[id(x)][0] > 0:
                inner = self._mains(x[KIDS], want)
                if self.weight(x) > sum(map(self.weight, inner)) or not inner:
                    out.append(x)
                else:
                    out += inner
            else:
                out += self._mains(x[KIDS], want)
        return out

    def regions(self, wrapper: list[list]) -> tuple[list[list], bool]:
        """The items that are the article, and whether they are article or main elements."""
        mains = self._mains(wrapper, "main")
        inner = self._mains(mains, "article")
        found = inner or mains or self._mains(wrapper, "article")
        if found:
            titled = [x for x in found if self.size[id(x)][3]]
            if titled:
                most = max(map(self.weight, titled))
                return [x for x in found if self.size[id(x)][3] or not self.teaser(x, most)], True
            # the headline may stand before the article: in main, or with a text of its own on each page
            return [*self._headlines(mains if inner else wrapper, found, bool(inner)), *found], True
        at = wrapper[0]
        while at[KIDS]:
            top = max(at[KIDS], key=self.weight)
            w = self.weight(top)
            others = [x for x in at[KIDS] if x is not top and not self.cut(x)]
            if not w or w < 0.6 * self.weight(at) or top[REP] or _tag(top) in {"p", "li", "td", *_HEADINGS} or any(self.size[id(x)][3] and not self.fixed(x) for x in others):
                break
            at = top
        return [at], False

    def teaser(self, x: list, most: int) -> bool:
        """Whether an article beside one with an h1 is a teaser or a comment: one of many, short beside it, mostly links or with linked headings."""
        text, linked, *_ = self.size[id(x)]
        todo, said, to_links = list(x[KIDS]), 0, 0
        while todo:
            k = todo.pop()
            if _tag(k) in _HEADINGS:
                said, to_links = said + self.size[id(k)][0], to_links + self.size[id(k)][1]
            todo += k[KIDS]
        return x[REP] or 2 * linked >= text or said > 0 and 2 * to_links >= said or 4 * self.weight(x) < most

    def _headlines(self, items: list[list], found: list[list], in_main: bool) -> list[list]:
        """h1 elements outside the articles."""
        regions, out, todo = {id(x) for x in found}, [], list(reversed(items))
        while todo:
            x = todo.pop()
            if id(x) in regions or x[OUT] == CUT and self.cut(x):
                continue
            if _tag(x) == "h1" and self.size[id(x)][0] > 0 and not self.fixed(x) and (in_main or x[PAGES] > 1 and x[SAME] is None):
                out.append(x)
            todo += reversed(x[KIDS])
        return out

    def fixed(self, x: list) -> bool:
        return bool(x[SAME]) and len(x[MARKS]) >= DISTINCT and 10 * x[PAGES] >= 9 * self.pages


def judged(wrapper: list[list]) -> list[list]:
    """The expression with what its items are: [signature, optional, repeated, items, kept, constant]."""
    if not wrapper:
        return []
    judge = Judge(wrapper)
    regions, elements = judge.regions(wrapper)
    inside_of = {id(x) for x in regions}
    holding: set[int] = set()

    def holds(x: list) -> bool:
        below = [holds(k) for k in x[KIDS]]
        if any(below):
            holding.add(id(x))
        return any(below) or id(x) in inside_of

    for x in wrapper:
        holds(x)
    size = {True: 0, False: 0}

    def look(items, inside, headings):
        out = []
        for x in items:
            here = inside or id(x) in inside_of
            kept, only = here, headings
            if judge.cut(x) and id(x) not in inside_of and id(x) not in holding or inside and elements and _tag(x) == "article" and id(x) not in inside_of:
                if here and elements and x[OUT] == HEADER:
                    only = True
                else:
                    out.append([x[SIG], x[OPT], x[REP], silent(x[KIDS]), False, ""])
                    continue
            text, linked, *_ = judge.size[id(x)]
            if inside and not elements and (x[REP] or _tag(x) in ("ul", "ol", "dl")) and 10 * linked >= 6 * text > 0:
                out.append([x[SIG], x[OPT], x[REP], silent(x[KIDS]), False, ""])
                continue
            within = only and _tag(x) in _HEADINGS
            constant = x[SAME] if here and not elements and judge.fixed(x) else ""
            if here:
                size[bool(constant)] += x[CHARS]
            out.append([x[SIG], x[OPT], x[REP], look(x[KIDS], here, only and not within), kept and (not only or within), constant])
        return out

    def silent(items):
        return [[x[SIG], x[OPT], x[REP], silent(x[KIDS]), False, ""] for x in items]

    out = look(wrapper, False, False)
    if size[True] >= size[False]:
        todo = list(out)
        while todo:
            x = todo.pop()
            x[5] = ""
            todo += x[KIDS]
    return out


KEPT, CONSTANT = 4, 5


class Extractor:
    """Main texts of pages; how shapes match expressions is remembered."""

    def __init__(self) -> None:
        self.elements: dict = {}
        self.known: dict[tuple[str, str], list[tuple[bool, str]]] = {}
        self.held = 0

    def _meaning(self, items: list[list], place: list[list], key: tuple[str, str] | None) -> list[tuple[bool, str]]:
        """For each element item in order whether its text is kept, and its constant."""
        told = self.known.get(key) if key else None
        if told is None:
            told = [(w[KEPT], w[CONSTANT]) for x, w in matched(items, place) if x[SIG][0] != "("]
            if key:
                if self.held > HELD:
                    self.known.clear()
                    self.held = 0
                self.known[key] = told
                self.held += len(told) + len(key[1]) // 64
        return told

    def __call__(self, text: str, place: list[list] | None, host: str | None = None) -> str:
        page = read_page(text, self.elements)
        items = items_of(page, text)
        out = self._text(page, items, self._meaning(items, place, None if host is None else (host, shape(items)))) if place else ""
        if not out and any(page.chars):  # a page that its host's wrapper does not fit
            out = self._text(page, items, self._meaning(items, judged(items), None))
        return out

    @staticmethod
    def _text(page: Page, items: list[list], meaning: list[tuple[bool, str]]) -> str:
        kept = [False] * len(page.tags)
        for x, (keep, constant) in zip(elements_of(items), meaning, strict=True):
            if keep:
                for e in x[NODES]:
                    kept[e] = not constant or _slot("".join(page.said[e])) != constant
        return " ".join("".join(t for e, t in page.texts if e < 0 or kept[e]).split())


def elements_of(items: list[list]) -> Iterator[list]:
    """Items in order, without groups."""
    for x in items:
        if x[SIG][0] != "(":
            yield x
        yield from elements_of(x[KIDS])


def extract(page: str, place: list[list] | None) -> str:
    """The text of the page's main slots, blocks joined by one space."""
    return Extractor()(page, place)


# --------------------------------------------------------------------------------------------------------- Spark


def host_of(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper, place) as JSON: the wrappers of all hosts from all pages, and what their items are."""
    shapes = pa.schema([("host", pa.string()), ("shape", pa.string()), ("items", pa.string())])
    out = pa.schema([("host", pa.string()), ("items", pa.string())])
    n = partitions(pages.sparkSession)

    def partial(batches):
        held: dict[tuple[str, str], list] = {}
        known: dict = {}
        size = 0
        for batch in slices(batches):
            for host, t in zip(batch.column(0).to_pylist(), texts_of(batch, "html"), strict=True):
                text = t.decode("utf-8", "replace")
                one = items_of(read_page(text, known), text)
                key = host, shape(one)
                if key not in held:
                    size += 1 + key[1].count("[") // 2
                held[key] = summed(held[key], one) if key in held else summed_alone(one)
                if size > HELD:
                    yield from sent(held)
                    held, size = {}, 0
        yield from sent(held)

    def sent(held):
        keys = list(held)
        for s in range(0, len(keys), 500):
            part = keys[s : s + 500]
            yield rows(shapes, [k[0] for k in part], [k[1] for k in part], [json.dumps(held[k]) for k in part])

    def together(batches, merge):
        """Rows of one host in order, merged one after the other."""
        host = now = None
        for batch in batches:
            done_hosts, done = [], []
            for h, *_, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one = json.loads(items)
                if h == host:
                    now = merge(now, one)
                else:
                    if now is not None:
                        done_hosts.append(host)
                        done.append(json.dumps(now))
                    host, now = h, one
            yield rows(out, done_hosts, done)
        if now is not None:
            yield rows(out, [host], [json.dumps(now)])

    def one_shape(batches):
        key = now = None
        for batch in batches:
            done = []
            for h, s, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one = json.loads(items)
                if (h, s) == key:
                    now = summed(now, one)
                else:
                    if now is not None:
                        done.append((*key, json.dumps(now)))
                    key, now = (h, s), one
            if done:
                yield rows(shapes, *map(list, zip(*done, strict=True)))
        if now is not None:
            yield rows(shapes, [key[0]], [key[1]], [json.dumps(now)])

    by_shape = map_arrow(pages.select(host_of("url").alias("host"), "html"), partial, "host string, shape string, items string")
    by_shape = map_arrow(by_shape.repartition(n, "host", "shape").sortWithinPartitions("host", "shape"), one_shape, "host string, shape string, items string")
    salted = by_shape.withColumn("salt", F.pmod(F.xxhash64("shape"), F.lit(SALTS)))

    def parts(batches):
        """Parts of hosts, told apart by host and salt."""

        def keyed():
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([f"{s}\n{h}" for h, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], pa.string()), batch.column(3)], names=["host", "items"])

        yield from together(keyed(), align)

    first = map_arrow(salted.select("host", "salt", "shape", "items").repartition(n, "host", "salt").sortWithinPartitions("host", "salt", "shape"), parts, "host string, items string")
    split = first.select(F.regexp_extract("host", r"(?s)^-?\d+\n(.*)$", 1).alias("host"), F.substring_index("host", "\n", 1).cast("int").alias("salt"), "items")
    whole = split.repartition(n, "host").sortWithinPartitions("host", "salt")

    def places(batches):
        done = pa.schema([("host", pa.string()), ("wrapper", pa.string()), ("place", pa.string())])
        for batch in together(batches, align):
            w = batch.column(1).to_pylist()
            yield rows(done, batch.column(0), w, [json.dumps(judged(json.loads(x))) for x in w])

    return map_arrow(whole.select("host", "salt", "items"), places, "host string, wrapper string, place string")


def summed_alone(items: list[list]) -> list[list]:
    """Items of a page without its elements."""
    return [[*x[:KIDS], summed_alone(x[KIDS]), *x[PAGES:NODES], []] for x in items]


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row."""
    places = written(infer(pages), "wrappers").select("host", "place")
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    ddl = "page_id long, url string, text string, n_chars long"
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of("url").alias("host"))
    size = places.agg(F.sum(F.length("host") + F.length("place"))).first()[0] or 0
    sent = size <= SENT_BYTES
    shared = pages.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in places.toLocalIterator()} if sent else {})  # SENT_BYTES at most
    keyed = own.withColumn("place", F.lit(None).cast("string")) if sent else own.join(places, "host", "left").select(*own.columns, "place")

    def run(batches):
        of, read, extractor = shared.value, {}, Extractor()
        for batch in slices(batches):
            url, texts = batch.column(1).to_pylist(), []
            for t, host, place in zip(texts_of(batch, "html"), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if host not in read:
                    if len(read) > 1000:
                        read.clear()
                    read[host] = json.loads(place or of.get(host) or "[]")
                texts.append(extractor(t.decode("utf-8", "replace"), read[host], host))
            yield rows(out, batch.column(0), url, texts, [len(t) for t in texts])

    return map_arrow(keyed, run, ddl)
