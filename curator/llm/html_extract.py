"""HTML extraction by wrapper induction.

Pages of one host share a template. For every host a wrapper is grown from several pages (five parts of the host give
their least key each, those far from the host's usual size only where a part has no others): the first is its draft,
each further one is aligned with it by simple tree matching, and what has no place there yet is added. Each page of the
host is aligned with the wrapper, which gives its blocks the slots of the wrapper's blocks. Over
all pages of the host the texts in each slot are counted: a text that most pages have in a slot is constant there and
becomes template; slots whose text varies are content. Menus and adverts vary too, so blocks in elements that are
something other than content by their kind (nav, footer, ...) are never content, and if a page has an article or main
element, content lies in it. Names (class="ad") are weak signs: a heading, an article or most of the page's text
outweighs them, and a form around the page isn't one to fill in.

Pages are parsed once, to a scratch table of blocks; counting and choosing are DataFrame work. A host with a third of
all pages is counted by slot and text with partial aggregates. Drafts go to the pages by broadcast while they are small;
beyond that pages are dealt by host, a large host's in parts, and each part follows a row with the drafts.

Edge cases: null and empty html give an empty text; markup that isn't closed or nested properly is read as browsers
would, roughly; a null url is a host of its own; repeated rows are extracted each by itself; a host of a few pages has
no constants; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, scratch_scope, spread, written

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<(/?)([a-zA-Z][^\s/><]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>|[^<]+|<", re.S)
#: A "<" that is text; the start of a tag; what decides where it ends.
_BARE, _NAME, _ENDS = re.compile("<(?:(?!)(x)(x)(x))?"), re.compile(r"</?[a-zA-Z][^\s/><]*+"), re.compile("[>\"']")
#: What ends the text of a raw element: these hold no markup, whatever they look like.
_LITERAL = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I) for tag in ("script", "style", "noscript", "iframe", "textarea", "title")}
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Their text is never shown as text.
RAW = frozenset("script style noscript template svg math iframe object textarea select option button head title canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that say that they aren't content.
ASIDE = frozenset("nav footer aside form menu dialog".split())
#: Words of class, id and role that say so. One says it if its name holds nothing else but such words and NEUTRAL ones.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar discussion respond replies share sharing social related recommended newsletter subscribe subscription popup modal overlay widget login signup pagination pager toolbar search contentinfo complementary tags".split()
)
NEUTRAL = frozenset(
    "area bar block bottom box buttons container form group icons inner item items left links list mobile outer panel posts articles stories right section site slot sticky sub top wrap wrapper primary secondary global main main js is the and row col column sm md lg xl desktop holder module unit".split()
)
#: Words that say so in longer names too: their own text is what readers wrote.
COMMENTS = frozenset("comment comments disqus".split())
#: Words with which a name is about the rest of the page.
_ABOUT = frozenset("has no with without open closed enabled disabled".split())
#: Pages that a host's wrapper grows from, at most.
DRAFTS = 5
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    __slots__ = ("tag", "label", "children", "parent", "text", "links", "aside", "slot", "seen", "key")

    def __init__(self, tag: str, label: str, parent: Node | None, aside: int):
        self.tag, self.label, self.parent, self.aside = tag, label, parent, aside
        self.children: list[Node] = []
        self.text: str | None = None
        #: Texts that a wrapper's leaf has had in the pages that it grew from.
        self.seen: set[str] = set()
        self.links = 0
        self.slot = -1
        self.key = 0


#: How an element says that it isn't content: by a name, by its kind, or as readers' comments.
NAMED, OF_KIND, OF_READERS = 1, 2, 3


def _named(value: str) -> int:
    out = 0
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if _ABOUT.isdisjoint(words):
            if not COMMENTS.isdisjoint(words):
                return OF_READERS
            if not MARKS.isdisjoint(words) and all(w in MARKS or w in NEUTRAL for w in words):
                out = NAMED
    return out


def _declared(tag: str, attributes: str, in_article: bool) -> tuple[str, int]:
    """The label by which nodes are aligned, and how the element says that it isn't content (0 if it doesn't)."""
    aside = OF_KIND if tag in ASIDE or (tag == "header" and not in_article) else 0
    label = tag
    if attributes and tag not in ("html", "body"):
        for name, value in _ATTRIBUTE.findall(attributes):
            name = name.lower()
            value = value.strip("\"'")
            if name == "class":
                label += "." + value
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                aside = max(aside, OF_KIND)
            else:
                own = _named(value)
                if own == OF_READERS or tag not in ("article", "main"):
                    aside = max(aside, own)
    return label, aside


def _ends_raw(raw: str, tag: str, end: bool) -> bool:
    """Whether a tag ends an open element that may go without its end tag."""
    if raw == "head":
        return tag == "body" or (tag in BLOCKS and tag != "html" and not end) or (tag == "html" and end)
    if raw == "option":
        return tag == "option" and not end or (end and tag in ("datalist", "optgroup", "select")) or (tag in BLOCKS and tag != "hr")
    return False


class TagEnds:
    """Which tags of a page have an end: from any place outside of quotes the next sign decides, so all are told in one pass."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.places = [m.start() for m in _ENDS.finditer(page)]
        self.ends = [False] * (len(self.places) + 1)
        later: dict[str, int] = {}
        for k in range(len(self.places) - 1, -1, -1):
            sign = page[self.places[k]]
            if sign == ">":
                self.ends[k] = True
            else:
                self.ends[k] = sign in later and self.ends[later[sign] + 1]
                later[sign] = k

    def has(self, at: int) -> bool:
        """Whether what begins there is anything but a tag without an end."""
        name = _NAME.match(self.page, at)
        return name is None or self.ends[bisect_left(self.places, name.end())]


def parse(page: str) -> Node:
    """The tree of block elements; leaves with text are blocks of text, whatever inline markup they hold."""
    root = here = Node("html", "html", None, 0)
    pieces: list[str] = []
    linked = link_depth = 0
    skip: str | None = None
    skip_depth = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                leaf = Node("#text", "#text", here, 0)
                leaf.text, leaf.links = text, linked
                leaf.seen.add(text)
                here.children.append(leaf)
            pieces.clear()
        linked = 0

    opened: Counter[str] = Counter()  # of here and what it is in, by tag

    def leave(node: Node) -> Node:
        opened[node.tag] -= 1
        return node.parent

    at_char, last, tag_ends = 0, page.rfind(">"), None
    while at_char < len(page):
        tag_like = page.startswith("<", at_char) and not page.startswith("<!--", at_char)
        bare = tag_like and (at_char > last or (tag_ends is not None and not tag_ends.has(at_char)))
        token = (_BARE if bare else _TOKEN).match(page, at_char)
        if not bare and token[0] == "<" and tag_ends is None:
            tag_ends = TagEnds(page)
        at_char = token.end()
        tag = token[2]
        if tag is None:
            whole = token[0]
            if skip is None and not (whole.startswith(("<!", "<?")) and len(whole) > 2):
                pieces.append(whole)
                if link_depth:
                    linked += len(whole)
            continue
        tag = tag.lower()
        if tag in _LITERAL and not token[1] and not token[3].endswith("/"):
            at_char = _LITERAL[tag].search(page, at_char).end()
            continue
        if skip is not None:
            if _ends_raw(skip, tag, bool(token[1])):
                skip = None  # the tag itself is read below
            else:
                if tag == skip:
                    skip_depth += -1 if token[1] else (0 if token[3].endswith("/") else 1)
                    if skip_depth <= 0:
                        skip = None
                continue
        if tag in RAW:
            if not token[1] and not token[3].endswith("/"):
                skip, skip_depth = tag, 1
            continue
        if tag not in BLOCKS:
            if tag == "a":
                link_depth = 0 if token[1] else 1
            elif tag == "br":
                pieces.append(" ")
            continue
        flush()
        link_depth = 0
        if token[1]:
            if opened[tag] > 0:
                while here.tag != tag:
                    here = leave(here)
                here = leave(here)
            continue
        if tag in ("html", "body"):
            continue
        while here.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or (here.tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th")):
            here = leave(here)
        label, aside = _declared(tag, token[3], opened["article"] > 0)
        node = Node(tag, label, here, aside)
        here.children.append(node)
        if tag not in VOID:
            here = node
            opened[tag] += 1
    flush()
    return root


#: Pairs of children from which an alignment works on classes of children and on whole rows at a time, and cells that it holds at once.
_PAIRS, _CELLS = 20_000, 4_000_000
#: How deep below two nodes their subtrees are compared to align them.
_DEEP = 60
#: Results that a host's matching keeps; beyond, it starts anew.
_KEPT = 200_000


class Matching:
    """Simple tree matching of pages with one wrapper: children are aligned in order so that the matched subtrees are
    largest; texts that are equal count twice.

    A page's subtrees get keys: equal ones for equal shapes with equal texts, where all texts that the wrapper hasn't
    seen count as one. What a subtree of the wrapper shares with one of the page depends on its key alone, so it is
    computed once for all pages.
    """

    def __init__(self, wrapper: Node) -> None:
        self.wrapper = wrapper
        self._texts: set[str] = set()
        stack = [wrapper]
        while stack:
            node = stack.pop()
            self._texts |= node.seen
            stack += node.children
        self._forget()

    def _forget(self) -> None:
        self._keys: dict[tuple, int] = {}
        self._high: list[int] = []
        self._weights: dict[tuple[int, int], int] = {}
        self._equal: dict[tuple[int, int], bool] = {}

    def keyed(self, page: Node) -> None:
        if len(self._keys) + len(self._weights) + len(self._equal) > _KEPT:
            self._forget()
        order, stack = [], [page]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += node.children
        for node in reversed(order):
            children = tuple([x.key for x in node.children])
            shape = (node.label, children, node.text if node.text in self._texts else None)
            key = self._keys.get(shape)
            if key is None:
                key = self._keys[shape] = len(self._high)
                self._high.append(1 + max((self._high[x] for x in children), default=0))
            node.key = key

    def equal(self, a: Node, b: Node) -> bool:
        key = id(a), b.key
        known = self._equal.get(key)
        if known is None:
            known = a.label == b.label and len(a.children) == len(b.children) and (b.text is None or b.text in a.seen) and self._high[b.key] <= _DEEP
            known = self._equal[key] = known and all(self.equal(x, y) for x, y in zip(a.children, b.children))
        return known

    def weight(self, a: Node, b: Node) -> int:
        if a.label != b.label:
            return 0
        key = id(a), b.key
        known = self._weights.get(key)
        if known is None:
            known = 1 + (b.text is not None and b.text in a.seen)
            if a.children and b.children and self._high[b.key] <= _DEEP:
                known += sum(self.weight(x, y) for x, y in self.pairs(a.children, b.children))
            self._weights[key] = known
        return known

    def pairs(self, left: list[Node], right: list[Node]) -> list[tuple[Node, Node]]:
        """Which of these children match, in order. Equal ones at both ends match: no alignment weighs more."""
        lo, most = 0, min(len(left), len(right))
        while lo < most and self.equal(left[lo], right[lo]):
            lo += 1
        hi = 0
        while hi < most - lo and self.equal(left[-1 - hi], right[-1 - hi]):
            hi += 1
        a, b = left[lo : len(left) - hi], right[lo : len(right) - hi]
        middle = self._by_weight(a, b) if len(a) * len(b) <= _PAIRS else self._by_rows(a, b)
        return [*zip(left[:lo], right[:lo]), *middle, *(zip(left[len(left) - hi :], right[len(right) - hi :]) if hi else ())]

    def _by_weight(self, a: list[Node], b: list[Node]) -> list[tuple[Node, Node]]:
        n, m = len(a), len(b)
        if not n or not m:
            return []
        if n == m == 1:
            return [(a[0], b[0])] if a[0].label == b[0].label else []
        own = [[self.weight(x, y) for y in b] for x in a]
        size = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            row, below, weights = size[i], size[i + 1], own[i]
            for j in range(m - 1, -1, -1):
                best = below[j] if below[j] >= row[j + 1] else row[j + 1]
                w = weights[j]
                row[j] = w + below[j + 1] if w and w + below[j + 1] > best else best
        out, i, j = [], 0, 0
        while i < n and j < m:
            if own[i][j] and size[i][j] == own[i][j] + size[i + 1][j + 1]:
                out.append((a[i], b[j]))
                i, j = i + 1, j + 1
            elif size[i][j] == size[i + 1][j]:
                i += 1
            else:
                j += 1
        return out

    def _by_rows(self, a: list[Node], b: list[Node]) -> list[tuple[Node, Node]]:
        """As _by_weight for long lists, with the same weight: children of equal keys weigh the same, a row of the table is one operation, and tables beyond _CELLS are halved."""
        shared: set[str] = set()  # texts of the page's children that the wrapper knows: nodes of the wrapper are alike if they differ in others alone
        stack = list(b)
        while stack:
            node = stack.pop()
            if node.text is not None and node.text in self._texts:
                shared.add(node.text)
            stack += node.children
        kinds: dict[tuple, int] = {}
        rows = np.array([_kind(x, shared, kinds) for x in a])
        columns = np.array([x.key for x in b])
        (_, some_a, rows), (_, some_b, columns) = (np.unique(x, return_index=True, return_inverse=True) for x in (rows, columns))
        weights = np.array([[self.weight(a[i], b[j]) for j in some_b] for i in some_a], np.int64)
        return [(a[i], b[j]) for i, j in aligned(rows, columns, weights)]


def _kind(root: Node, shared: set[str], kinds: dict[tuple, int]) -> int:
    """A number for what a wrapper's subtree is like, as far as these texts tell."""
    order, stack, known = [], [root], {}
    while stack:
        node = stack.pop()
        order.append(node)
        stack += node.children
    for node in reversed(order):
        shape = (node.label, tuple([known[id(x)] for x in node.children]), frozenset(node.seen & shared))
        known[id(node)] = kinds.setdefault(shape, len(kinds))
    return known[id(root)]


def _row(last: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The best totals of the first columns, by their number, with one more row: weights of 0 are no match, and add nothing."""
    best = last.copy()
    np.maximum(best[1:], last[:-1] + weights, out=best[1:])
    return np.maximum.accumulate(best)


def aligned(rows: np.ndarray, columns: np.ndarray, weights: np.ndarray) -> list[tuple[int, int]]:
    """Places of the heaviest alignment in order of two lists of classes; weights of 0 don't match.

    Children at an end of both lists match if neither weighs more with any other: whatever else an alignment pairs one
    of them with may be put in the other's place. What is left between the ends goes through the table.
    """
    out: list[tuple[int, int]] = []
    weights = weights.astype(np.int32)
    best = (weights > 0) & (weights >= weights.max(axis=1, keepdims=True)) & (weights >= weights.max(axis=0, keepdims=True))
    stack = [(0, len(rows), 0, len(columns))]
    while stack:
        top, end, left, right = stack.pop()
        k = min(end - top, right - left)
        at_start = best[rows[top : top + k], columns[left : left + k]]
        lo = k if at_start.all() else int(np.argmin(at_start))
        at_end = best[rows[end - k + lo : end], columns[right - k + lo : right]][::-1]
        hi = k - lo if at_end.all() else int(np.argmin(at_end))
        out += zip(range(top, top + lo), range(left, left + lo))
        out += zip(range(end - hi, end), range(right - hi, right))
        top, end, left, right = top + lo, end - hi, left + lo, right - hi
        n, m = end - top, right - left
        if not n or not m:
            continue
        halve = n > 1 and (n + 1) * (m + 1) > _CELLS
        ahead, back = columns[left:right], columns[left:right][::-1]
        known: dict[tuple[int, bool], np.ndarray] = {}

        def of(i: int, own: np.ndarray, few: bool = len(weights) * m <= _CELLS) -> np.ndarray:
            """A row's weights; with few classes each is looked up once."""
            key = int(rows[i]), own is ahead
            found = known.get(key)
            if found is None:
                found = weights[rows[i]].take(own)
                if few:
                    known[key] = found
            return found

        if halve:
            middle = top + n // 2
            above = below = np.zeros(m + 1, np.int32)
            for i in range(top, middle):
                above = _row(above, of(i, ahead))
            for i in range(end - 1, middle - 1, -1):  # rows and columns from their ends
                below = _row(below, of(i, back))
            cut = left + int(np.argmax(above + below[::-1]))
            stack += [(middle, end, cut, right), (top, middle, left, cut)]
            continue
        size = np.zeros((n + 1, m + 1), np.int32)  # by the number of columns from the end
        for i in range(n - 1, -1, -1):
            size[i] = _row(size[i + 1], of(top + i, back))
        i = j = 0
        while i < n and j < m:
            w = weights[rows[top + i], ahead[j]]
            if w and size[i, m - j] == w + size[i + 1, m - j - 1]:
                out.append((top + i, left + j))
                i, j = i + 1, j + 1
            elif size[i, m - j] == size[i + 1, m - j]:
                i += 1
            else:
                j += 1
    return sorted(out)


def match_trees(matching: Matching, page: Node, grow: bool = False) -> int:
    """Gives the page's nodes the slots of the wrapper's that they match; if it is to grow, what has no match is added to it."""
    total = 0
    matching.keyed(page)
    stack = [(matching.wrapper, page)]
    while stack:
        a, b = stack.pop()
        b.slot = a.slot
        if grow and b.text is not None:
            a.seen.add(b.text)
        total += 1
        if not b.children:
            continue
        found = matching.pairs(a.children, b.children)
        stack += found
        if grow:
            theirs = {id(y): x for x, y in found}
            places = {id(x): i for i, x in enumerate(a.children)}
            new: list[list[Node]] = [[] for _ in range(len(a.children) + 1)]
            at = 0
            for y in b.children:
                if id(y) in theirs:
                    at = places[id(theirs[id(y)])] + 1
                else:
                    new[at].append(y)
            a.children = [x for i in range(len(new)) for x in (*new[i], *a.children[i : i + 1])]
    return total


def grown(pages: list[str]) -> Matching:
    """The matching with the wrapper of these pages of a host."""
    wrapper = Node("html", "html", None, 0)
    for page in pages:
        match_trees(Matching(wrapper), parse(page), grow=True)
    return Matching(numbered(wrapper))


def numbered(root: Node) -> Node:
    stack, n = [root], 0
    while stack:
        node = stack.pop()
        node.slot = n
        n += 1
        stack += reversed(node.children)
    return root


def _held(root: Node) -> dict[int, tuple[int, int]]:
    """For each element: the characters of its texts that aren't links, and what it holds (1: an h1, 2: an article or main, 4: main)."""
    order, stack, out = [], [root], {}
    while stack:
        node = stack.pop()
        order.append(node)
        stack += node.children
    for node in reversed(order):
        chars = len(node.text) - min(node.links, len(node.text)) if node.text is not None else 0
        holds = 0
        for x in node.children:
            own, inside = out[id(x)]
            chars += own
            holds |= inside
        if node.tag == "h1":
            holds |= 1
        elif node.tag == "main":
            holds |= 6
        elif node.tag == "article" and node.aside != OF_READERS:
            holds |= 2
        out[id(node)] = chars, holds
    return out


def _is_aside(node: Node, inside: bool, chars: int, holds: int, whole: int) -> bool:
    """Whether an element that says so isn't content: names are weak signs, which a heading, an article or most of the page's text outweigh."""
    if node.aside == OF_READERS:
        return not holds & 5 and 20 * chars < 19 * whole
    if inside and node.aside == OF_KIND and node.tag != "form":
        return True
    if holds & 2:
        return False
    if node.aside == NAMED:
        return not holds & 1 and 2 * chars <= whole
    return node.tag != "form" or 2 * chars <= whole


def blocks_of(root: Node) -> list[tuple[int, int, bool, str]]:
    """(slot, hash, in an article, text) of the page's blocks that may be content, in page order."""
    found: list[tuple[Node, bool]] = []
    held = _held(root)
    whole = held[id(root)][0]
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        if node.text is not None:
            found.append((node, inside))
            continue
        if node.aside and _is_aside(node, inside, *held[id(node)], whole):
            continue
        inside = inside or node.tag in ("article", "main")
        stack += [(child, inside) for child in reversed(node.children)]
    if any(inside for _, inside in found):
        found = [x for x in found if x[1]]
    else:  # lists of links are menus, whatever they are called
        found = [x for x in found if 2 * x[0].links < len(x[0].text)]
    return [(node.slot, xxhash.xxh3_64_intdigest(node.text) - (1 << 63), inside, node.text) for node, inside in found]


def _small(df: DataFrame, column, most: int) -> DataFrame:
    """df to be broadcast if the sizes of its rows add up to less than a bound."""
    total = df.agg(F.sum(column)).first()[0] or 0
    return F.broadcast(df) if total <= most else df


def extract_text(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", share: float = 0.8, least_pages: int = 10, broadcast_bytes: int = 32 << 20
) -> DataFrame:
    """key, url, text and n_chars of every row of pages."""
    with scratch_scope():
        parsed, template = _parsed(pages, key, url, html, share, least_pages, broadcast_bytes)
    template = _small(template, F.size("_h_template") * 16 + 64, broadcast_bytes)
    stay = F.filter("_h_blocks", lambda b: F.col("_h_template").isNull() | ~F.array_contains(F.col("_h_template"), F.struct(b["slot"].alias("slot"), b["hash"].alias("hash"))))
    text = F.array_join(F.transform(stay, lambda b: b["text"]), "\n")
    return parsed.join(template, "_h_host", "left").select(F.col("_h_key").alias(key), F.col("_h_url").alias(url), text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))


#: Pages that follow one copy of their host's drafts, where these aren't broadcast.
FOLLOW = 2000


def _with_drafts(rows: DataFrame, drafts: DataFrame, usual: DataFrame) -> DataFrame:
    """rows dealt by host, those of a large host in parts, each part behind a row with the host's drafts."""
    parts = usual.select("_h_host", F.ceil(F.col("_h_n") / FOLLOW).cast("int").alias("_h_parts"))
    dealt = rows.join(parts, "_h_host", "left").withColumn("_h_part", F.pmod(F.xxhash64("_h_key", "_h_html"), F.coalesce("_h_parts", F.lit(1))).cast("int")).drop("_h_parts")
    heads = drafts.join(parts, "_h_host").select("_h_host", "_h_drafts", F.explode(F.sequence(F.lit(0), F.col("_h_parts") - 1)).alias("_h_part"))
    every = dealt.unionByName(heads, allowMissingColumns=True)
    ordered = every.repartition("_h_host", "_h_part").sortWithinPartitions("_h_host", "_h_part", F.col("_h_drafts").isNull())
    return ordered.select("_h_key", "_h_url", "_h_host", "_h_html", "_h_drafts")


def _parsed(pages: DataFrame, key: str, url: str, html: str, share: float, least_pages: int, broadcast_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Two tables: each page with its blocks, and of each host the ones that are constant in its different pages."""
    spark = pages.sparkSession
    host = F.coalesce(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))
    rows = spread(pages.select(F.col(key).alias("_h_key"), F.col(url).alias("_h_url"), host.alias("_h_host"), F.col(html).alias("_h_html")))
    size = F.octet_length("_h_html")
    usual = written(rows.where("_h_html is not null").groupBy("_h_host").agg(F.percentile_approx(size, 0.5).alias("_h_usual"), F.count(F.lit(1)).alias("_h_n")))
    usual = _small(usual, F.octet_length("_h_host") + 64, broadcast_bytes)
    sized = rows.where("_h_html is not null").select("_h_key", "_h_host", "_h_html").join(usual, "_h_host").withColumn("_h_part", F.pmod(F.xxhash64("_h_key", "_h_html"), F.lit(DRAFTS)))
    far = (size * 3 < F.col("_h_usual")) | (size > F.col("_h_usual") * 3)
    chosen = sized.groupBy("_h_host", "_h_part").agg(F.min_by(F.struct(far.alias("far"), "_h_part", F.col("_h_html").alias("html")), F.struct(far, "_h_key", F.xxhash64("_h_html"))).alias("_h_draft"))
    ordered = F.sort_array(F.collect_list("_h_draft"))
    near = F.filter(ordered, lambda d: ~d["far"])
    drafts = written(chosen.groupBy("_h_host").agg(F.transform(F.when(F.size(near) > 0, near).otherwise(ordered), lambda d: d["html"]).alias("_h_drafts")))
    total = drafts.agg(F.sum(F.aggregate("_h_drafts", F.lit(0).cast("bigint"), lambda a, d: a + F.octet_length(d)) + 64)).first()[0] or 0
    by_host = None
    if total <= broadcast_bytes:
        by_host = spark.sparkContext.broadcast({r["_h_host"]: list(r["_h_drafts"]) for r in drafts.toArrow().to_pylist()})
        aligned = rows.withColumn("_h_drafts", F.lit(None).cast("array<string>"))
    else:
        aligned = _with_drafts(rows, drafts, usual)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Matching] = {}
        block = pa.struct([("slot", pa.int32()), ("hash", pa.int64()), ("inside", pa.bool_()), ("text", pa.string())])
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                out, at = [], []
                for i, (name, page, drafts) in enumerate(zip(*(part.column(i).to_pylist() for i in (2, 3, 4)))):
                    if drafts is not None:
                        known = {name: grown(drafts)}
                        continue
                    at.append(i)
                    if page is None:
                        out.append([])
                        continue
                    if name not in known:
                        if len(known) >= 1000:
                            known.clear()
                        known[name] = grown(by_host.value[name])
                    tree = parse(page)
                    match_trees(known[name], tree)
                    out.append([dict(zip(("slot", "hash", "inside", "text"), b)) for b in blocks_of(tree)])
                keys = [c.take(pa.array(at, pa.int64())) for c in part.columns[:3]]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(out, pa.list_(block))], names=["_h_key", "_h_url", "_h_host", "_h_blocks"])

    kind = pages.schema[key].dataType.simpleString()
    schema = f"_h_key {kind}, _h_url string, _h_host string, _h_blocks array<struct<slot:int,hash:bigint,inside:boolean,text:string>>"
    parsed = kept(aligned.mapInArrow(run, schema))
    # pages of equal blocks are one: copies of a page don't make it a template
    own = F.transform("_h_blocks", lambda b: F.struct(b["slot"].alias("slot"), b["hash"].alias("hash")))
    distinct = parsed.select("_h_host", own.alias("_h_own")).groupBy("_h_host", F.xxhash64("_h_own").alias("_h_a"), F.hash("_h_own").alias("_h_c")).agg(F.first("_h_own").alias("_h_own"))
    distinct = written(distinct.select("_h_host", "_h_own"))
    sizes = distinct.groupBy("_h_host").agg(F.count(F.lit(1)).alias("_h_pages")).where(F.col("_h_pages") >= least_pages)
    texts = distinct.select("_h_host", F.explode(F.array_distinct("_h_own")).alias("_h_b")).where("_h_b.slot >= 0")
    counts = texts.groupBy("_h_host", "_h_b.slot", "_h_b.hash").agg(F.count(F.lit(1)).alias("_h_n"))
    constants = counts.where(F.col("_h_n") >= least_pages * share).join(sizes, "_h_host").where(F.col("_h_n") >= share * F.col("_h_pages"))
    return parsed, kept(constants.groupBy("_h_host").agg(F.collect_list(F.struct("slot", "hash")).alias("_h_template")))
