"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: the starts and ends of its elements, named by their path, and its
words, named by path and word; those in menus and footers too.  Pages of one host are dealt at random to
blocks of about ``BLOCK`` pages, so that no host, however large, is gathered, and each block deduces
its template.  A token's occurrence vector says how often it stands on each page of the block; tokens
with equal vectors on at least ``LEAST`` pages and a ``SHARE`` of the block make an equivalence class.  A
class of at least two tokens is valid if they come in one order on every page, and nests in the
template if all of it stands in one and the same gap of every larger class.  What valid classes leave
open are the slots.  Template elements that stand once on a page hold slots; the main slots are those
of the innermost one that holds at least 1 - ``MASS`` of the block's slot text.  Of their text, blocks in
navigation, forms, adverts, comments and the like (by element or role, or by class or id unless they
hold most of the open text) go, and blocks of nothing but words of the template too; the rest is the main text.

Where that leaves no text, and on hosts with fewer than ``LEAST`` pages, a page relies on its own: the
text within article or main elements where these hold most of it, else all that stands in the
innermost container of at least 1 - ``MASS`` of the page's open text.

Defined cases: null and empty html give an empty text; a null or odd url is a host of its own
kind; a tag that never ends is text; a page is read in time in line with its length, however its tags nest
or break off; repeated rows count as pages; an empty table gives an empty result; other columns are
kept, whatever their names, but for one named like the result.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect, bisect_left
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wardline.llm.common import save

LEAST, SHARE, MASS = 4, 0.3, 0.2
BLOCK, SURE = 64, 12  # pages of a block; pages times words of a class that are no accident

# Fixed values of HTML: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: An element closes an open one of these kinds, up to the container named.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
DROPPED = frozenset("head nav footer aside form script style noscript template svg math button select textarea iframe dialog menu object canvas title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = re.compile(
    r"ads?|adv|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|"
    r"sidebar|widget|related|recommended|share|sharing|social|comments?|commentlist|disqus|replies|reply|respond|menu|nav|navbar|navigation|breadcrumbs?|footer|"
    r"masthead|toolbar|pagination|pager|login|signup|search|skip|copyright|legal|disclaimer",
    re.I,
)
#: Parts of a class or id that may stand beside one of NAMES without changing what it says.
PLACES = re.compile(r"site|page|main|global|list|area|box|bar|wrap|wrapper|container|section|block|slot|unit|left|right|top|bottom|links?|items?|inner|outer|form|\d+", re.I)
UNSEEN = frozenset("head title button select option textarea template svg math canvas object iframe".split())  # no slot's text
SLOTS = frozenset("html body main article section div center td".split())  # elements that can be a page's main slot
TEXTS = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())  # never dropped by name
HEADS = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
MARKED = re.compile("<[!?]")
MARKS = re.compile("[>\"']")
DIGITS = re.compile("&#0*([0-9]{1,8})[0-9]*")
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


class Element:
    """An element; ``path`` names it and all around it, ``box`` is the nearest block element, itself included."""

    __slots__ = ("tag", "path", "dropped", "main", "above", "named", "depth", "slots", "box", "unseen")

    def __init__(self, tag: str, attributes: str, above: Element | None):
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        name = f"{found.get('class', '')} {found.get('id', '')}".strip()
        role = found.get("role", "").lower()
        self.tag, self.above = tag, above
        self.path = hashlib.blake2b((above.path if above else b"") + f"{tag}.{name}".encode("utf-8", "replace"), digest_size=16).digest()
        self.depth = above.depth + 1 if above else 0
        self.slots = (above.slots if above else 0) + (tag in SLOTS or above is None)
        self.box = above.box if tag in INLINE else self
        self.unseen = tag in UNSEEN or bool(above and above.unseen)  # titles, scripts, form controls: no part of any slot
        self.main = bool(above and above.main) or tag in ("article", "main") or role in ("main", "article") or found.get("itemprop") == "articleBody"
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        head = (tag == "header" or bool(name and HEADS.search(name))) and not self.main
        self.named = bool(name) and tag not in TEXTS and any(map(is_named, name.split()))  # its name speaks against it
        self.dropped = bool(above and above.dropped) or tag in DROPPED or role in ROLES or hidden or head


def is_named(token: str) -> bool:
    """Whether a whole class or id says that its element is no main text: has-sidebar and related-work do not."""
    parts = [p for p in re.split("[-_]+", token) if p]
    named = [bool(NAMES.fullmatch(p)) for p in parts]
    return any(named) and all(n or PLACES.fullmatch(p) for n, p in zip(named, parts, strict=True))


def plain(text: str) -> str:
    """The text with its character references decoded; numbers of any length too."""
    try:
        return entities.unescape(text)
    except ValueError:  # more digits than Python turns into a number; eight already say that it is no character
        return entities.unescape(DIGITS.sub(r"&#\1", text))


class TagEnds:
    """Where the tags of a page end: at the first '>' outside quotes.  One pass from the end knows it for every place."""

    def __init__(self, page: str):
        self.marks = [m.start() for m in MARKS.finditer(page)]
        self.ends = [-1] * (len(self.marks) + 1)
        later = {'"': -1, "'": -1}  # the next quote of each kind
        for k in range(len(self.marks) - 1, -1, -1):
            mark = page[self.marks[k]]
            if mark == ">":
                self.ends[k] = self.marks[k]
            else:
                self.ends[k] = self.ends[later[mark] + 1] if later[mark] >= 0 else -1
                later[mark] = k

    def __call__(self, at: int) -> int:
        """Place of the '>' of a tag whose attributes start here; -1 if it never ends."""
        return self.ends[bisect_left(self.marks, at)]


def page_events(page: str) -> list[tuple[str, str, Element]]:
    """(sign, text, element) in page order: '<' an element starts, '>' it ends, '' a text block in it."""
    stack = [Element("", "", None)]  # an element's depth is its place here
    places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of each kind
    events: list[tuple[str, str, Element]] = []
    run: list[str] = []
    home = stack[0]  # the block element whose text is running

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                events.append(("", text, home))

    def pop(k: int) -> None:
        events.extend((">", "", e) for e in reversed(stack[k:]))
        for e in stack[k:]:
            places[e.tag].pop()
        del stack[k:]

    def innermost(kinds) -> int:
        return max((places[t][-1] for t in kinds if places[t]), default=0)

    def close(kinds, within) -> None:
        k = innermost(kinds)
        if k > innermost(within):
            pop(k)

    tag_end, end = TagEnds(page), len(page)
    last = page.rfind(">")
    text_at = at = 0  # where the running text starts; where to look for a tag

    while True:
        at = page.find("<", at)
        stop = at if at >= 0 else end
        found, after = None, -1  # the tag's name; the place after the tag, if it is one
        if at >= 0 and page.startswith("<!--", at):
            after = page.find("-->", at + 4) + 3
            after = after if after > 2 else end
        elif 0 <= at < last:
            if page[at + 1] in "!?":
                after = page.find(">", at) + 1
            elif found := NAME.match(page, at + 1):
                after = tag_end(found.end()) + 1
        if at >= 0 and after <= 0:  # no tag: its '<' is text, and so is one within its name
            inner = MARKED.search(page, at + 1, found.end()) if found else None
            at = inner.start() if inner else found.end() if found else at + 1
            continue
        if stop > text_at and (home.dropped or not stack[-1].dropped):
            run.append(plain(page[text_at:stop]))
        if at < 0:
            break
        opens, text_at, at = page[at + 1] != "/", after, after
        if not found:
            continue
        tag, attributes = found[1].lower(), page[found.end() : after - 1]
        if not opens:
            if places[tag]:
                if tag not in INLINE:
                    flush()
                k = places[tag][-1]
                if tag not in INLINE or stack[-1].box.depth < k:
                    pop(k)
                home = stack[-1].box
            continue
        if tag not in INLINE and tag != "br":
            flush()
            if tag in ENDS_P:
                close({"p"}, frozenset({"article", "div", "section", "td", "th", "li", "body", "main", "blockquote"}))
            if tag in CLOSES:
                close(*CLOSES[tag])
        if tag == "br":
            run.append(" ")
        new = Element(tag, attributes, stack[-1])
        events.append(("<", "", new))
        if tag in RAW:
            raw_end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = page.find(">", raw_end.end()) + 1 if raw_end else 0
            text_at = at = at or end
        elif tag not in VOID and not attributes.endswith("/"):
            places[tag].append(new.depth)
            stack.append(new)
        home = stack[-1].box
    flush()
    return events


def elements(events: list[tuple[str, str, Element]]) -> list[Element]:
    """All elements of a page, those around others first."""
    if not events:
        return []
    first = events[0][2]
    return [first.above or first, *(e for sign, _, e in events if sign == "<")]


def held_by(page: list[Element], texts: list[tuple[str, Element]]) -> Counter:
    """Characters of the texts that each element holds, all that stands in it included."""
    held: Counter = Counter()
    for text, e in texts:
        held[e] += len(text)
    for e in reversed(page):
        if e.above is not None and held[e]:
            held[e.above] += held[e]
    return held


def spoken_against(page: list[Element], held: Counter, total: int, inside: set[Element] | None = None) -> set[Element]:
    """Elements in one (of those ``inside``) whose name speaks against it and which does not hold most of the text."""
    found: set[Element] = set()
    for e in page:
        if e.above in found or (e.named and (inside is None or e in inside) and 2 * held[e] <= total):
            found.add(e)
    return found


# ---------------------------------------------------------------- templates


def page_tokens(events: list[tuple[str, str, Element]]) -> list[tuple[str, bytes]]:
    """The page's tokens in order: (sign or word, path)."""
    out: list[tuple[str, bytes]] = []
    for sign, text, e in events:
        if sign:
            out.append((sign, e.path))
        else:
            out.extend((word, e.path) for word in text.split())
    return out


class Template:
    """What deduction finds in a block of pages: valid classes as ordered lists of tokens, outer ones first."""

    def __init__(self, pages: list[list[tuple[str, bytes]]]):
        self.classes: list[tuple[tuple[str, bytes], ...]] = []
        self.words: set[tuple[str, bytes]] = set()  # (word, path)
        self.elements: set[bytes] = set()  # paths of elements that stand once on a page
        least = max(LEAST, SHARE * len(pages))
        counts = [Counter(p) for p in pages]
        support = Counter(t for c in counts for t in c)
        alike = defaultdict(list)
        for token, n in support.items():
            if n >= least:
                alike[tuple(c[token] for c in counts)].append(token)
        large = sorted((k for k in alike.items() if len(k[1]) > 1), key=lambda k: (-sum(x > 0 for x in k[0]), -len(k[1]), min(k[1])))
        number = {token: k for k, (_, tokens) in enumerate(large) for token in tokens}
        places = []  # of each page: the tokens and positions of each class
        for p in pages:
            found: dict[int, list] = defaultdict(list)
            for at, token in enumerate(p):
                if token in number:
                    found[number[token]].append((token, at))
            places.append(found)
        valid: list[tuple[int, int]] = []  # (class, size)
        for k, (vector, tokens) in enumerate(large):
            size = len(tokens)
            order = next(tuple(t for t, _ in f[k][:size]) for f in places if k in f)
            if set(order) != set(tokens) or any(tuple(t for t, _ in f[k]) != order * n for f, n in zip(places, vector, strict=True) if n):
                continue
            if not all(self.nested(places, k, size, outer, outer_size) for outer, outer_size in valid):
                continue
            valid.append((k, size))
            self.classes.append(order)
            words = [t for t in order if t[0] not in "<>"]
            if len(words) > 1 and len(words) * sum(n > 0 for n in vector) >= SURE:
                self.words.update(words)
            if max(vector) == 1:
                self.elements.update(path for sign, path in order if sign == "<")

    @staticmethod
    def nested(places: list[dict], k: int, size: int, outer: int, outer_size: int) -> bool:
        """Whether each occurrence of class k stands in one gap of the outer class, the same everywhere."""
        gaps = set()
        for found in places:
            if k not in found or outer not in found:
                continue
            ends = [at for _, at in found[outer]]
            at = [bisect(ends, x) for _, x in found[k]]
            if any(at[i] != at[i + size - 1] for i in range(0, len(at), size)):
                return False
            gaps.update(0 if x in (0, len(ends)) else x % outer_size or outer_size for x in at)
        return len(gaps - {0}) <= 1 and not (0 in gaps and len(gaps) > 1)


def main_element(pages: list[list[tuple[str, str, Element]]], template: Template) -> bytes | None:
    """Path of the innermost template element that holds nearly all slot text of the pages."""
    mass: Counter = Counter()
    depth: dict[bytes, int] = {}
    total = 0
    for events in pages:
        open_ = [(text, e) for text, e in remaining(events, template) if not e.unseen]
        total += sum(len(text) for text, _ in open_)
        for e, n in held_by(elements(events), open_).items():
            if n and e.path in template.elements:
                mass[e.path] += n
                depth[e.path] = e.depth
    held = [path for path, n in mass.items() if n >= (1 - MASS) * total]
    return max(held, key=lambda p: (depth[p], p)) if held else None


def block_texts(pages: list[str | None]) -> list[str]:
    """Main texts of the pages of a block."""
    events = [page_events(p or "") for p in pages]
    if len(pages) < LEAST:
        return [own_text(e) for e in events]
    template = Template([page_tokens(e) for e in events])
    slot = main_element(events, template)
    return [slot_text(e, template, slot) or own_text(e, template) for e in events]


def slot_text(events: list[tuple[str, str, Element]], template: Template, slot: bytes | None) -> str:
    """Text of a page's main slots; empty if the page has no such slot."""
    page, slot_of = elements(events), {}
    for e in page:
        slot_of[e] = e if e.path == slot else slot_of.get(e.above)
    kept = [(text, e) for text, e in remaining(events, template) if slot_of[e] and (slot_of[e].dropped or not e.dropped)]
    inside = {e for e in page if slot_of[e] and slot_of[e] is not e}
    gone = spoken_against(page, held_by(page, kept), sum(len(text) for text, _ in kept), inside)
    return " ".join(text for text, e in kept if e not in gone)


def remaining(events: list[tuple[str, str, Element]], template: Template | None) -> list[tuple[str, Element]]:
    """Text blocks that have more than words of the template; sentences are left whole."""
    known = template.words if template else ()
    return [(text, e) for sign, text, e in events if not sign and not (known and all((w, e.path) in known for w in text.split()))]


def own_text(events: list[tuple[str, str, Element]], template: Template | None = None) -> str:
    """Main text of a page by its own blocks."""
    kept = [(text, e) for text, e in remaining(events, template) if not e.dropped]
    page = elements(events)
    gone = spoken_against(page, held_by(page, kept), sum(len(text) for text, _ in kept))
    kept = [b for b in kept if b[1] not in gone]  # a container of most open text is no notice
    total = sum(len(text) for text, _ in kept)
    if 2 * sum(len(text) for text, e in kept if e.main) > total:
        kept = [b for b in kept if b[1].main]
    elif kept:  # no article of most text: the innermost container of nearly all open text, with all it holds
        held = held_by(page, kept)
        slot = max((e for e in page if (e.tag in SLOTS or e.above is None) and held[e] >= (1 - MASS) * total), key=lambda e: e.slots)
        within: set[Element] = set()
        for e in page:
            if e is slot or e.above in within:
                within.add(e)
        kept = [b for b in kept if b[1] in within]
    return " ".join(text for text, _ in kept)


def main_text(pages: DataFrame, into: str = "text") -> DataFrame:
    """``pages`` (page_id, url, html, ...) with the main text in column ``into``."""
    host = F.xxhash64(F.coalesce(F.lower(F.regexp_extract(F.col("url"), HOST, 1)), F.lit("")))
    rows = pages.select(host.alias("host"), F.struct(*pages.columns).alias("row"))
    blocks = save(rows.groupBy("host").agg(F.greatest(F.lit(1), F.round(F.count(F.lit(1)) / BLOCK)).cast("int").alias("blocks")))
    dealt = rows.join(blocks, "host").withColumn("block", F.pmod(F.xxhash64("row.page_id", "row.url", "row.html"), "blocks"))

    at = pages.columns.index("html")

    def texts(part: pa.Table) -> pa.Table:
        found = block_texts(pc.struct_field(part["row"], [at]).to_pylist())
        return pa.table({"row": part["row"], "found": pa.array(found, pa.string())})

    out = dealt.groupBy("host", "block").applyInArrow(texts, StructType([StructField("row", pages.schema), StructField("found", StringType())]))
    return out.select(*(F.col("row")[c].alias(c) for c in pages.columns if c != into), F.col("found").alias(into))
