"""Main text of web pages by wrapper induction per host.

Every page is parsed into a tree whose equal siblings are folded into one
repeating node.  The most frequent tree of a host is its wrapper; other pages of
the host are aligned to it by simple tree matching, which gives each node a slot.
A slot whose text is the same on nearly all pages of different content is
template, and so is a block outside the article that nearly all pages have at
its slot, whatever its siblings hold.  Varying slots are content, outside the
article too, unless they stand in a menu, header, footer, side column, advert,
notice, form or comment region by tag or class.  Only where a host has too few
pages to tell, blocks outside the article go if the article holds at least as
much text.

Three passes parse the pages; between them only per-host aggregates move, all by
partial aggregation, so a host may hold any share of the pages.

Defined results: null or empty html gives an empty text; a null or odd url is
the host ''; repeated rows are extracted each and count once as content; an
empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint, map_batches

#: Share of a slot's different pages that must agree for it to be template, and how many pages it takes.
CONSTANT_SHARE, MIN_PAGES = 0.9, 5
#: Share of link characters from which a block outside any article is a menu.
MAX_LINKS = 0.6
#: Bytes of the per-host wrappers up to which they are broadcast.
MAX_BROADCAST_BYTES = 16 << 20

# Element names by role.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
                    "samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BOILER_TAGS = frozenset("nav footer aside form head script style noscript template iframe button select menu dialog svg "
                         "object canvas textarea title xmp noembed noframes input option datalist".split())
_CONTENT_TAGS = frozenset(("article", "main"))
_BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidenav menu nav navbar "
    "navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices notification alert newsletter subscribe "
    "subscription signup login popup modal overlay share sharing social related recommended recommendations trending widget "
    "comment comments commentlist disqus respond reply replies pagination pager toolbar skip masthead complementary contentinfo "
    "search toc".split())
#: First words of class names that tell of the layout around an element ("has-sidebar"), not of its role.
_LAYOUT_WORDS = frozenset("has no not with without hide hides show shows".split())
_HEADER_WORDS = frozenset("header topbar".split())
# Which open element a start tag ends, and where the search for it stops.
_ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
         "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
         "tbody": ("tr td th thead tbody", "table"), "tfoot": ("tr td th thead tbody", "table")}
_KEEPS_P = _INLINE | frozenset("area base link meta script style noscript template source track input button select textarea iframe "
                               "svg object canvas embed option param title".split())

_TAG = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[A-Za-z][^>]*>", re.S)
#: The alternatives of ``_TAG`` without quoted attributes.
_PLAIN = re.compile(r"<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*>|</?[A-Za-z][^>]*>", re.S)
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_TOKEN = re.compile(r"[A-Za-z]+")
_NAME = re.compile(r"</?[A-Za-z][^\s/>]*+")
_QUOTED = re.compile(r"\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)")


HELD = 2


class _Tags:
    """Tags of a page one after the other, in time that grows with its length whatever its quotes.

    A tag whose quotes leave no ``>`` outside is read again as plain text up to the next one.  Where such a reading
    has failed, so does every other that is outside quotes at the same place; that is kept, so that each of the
    few possible readings runs to the end of the page once.
    """

    def __init__(self, source: str):
        self.source, self.last, self.failed = source, source.rfind(">"), []

    def next(self, pos: int) -> re.Match | None:
        """The first tag, comment or declaration from ``pos`` on."""
        while True:
            at = self.source.find("<", pos)
            if at < 0:
                return None
            if at > self.last:                   # only an open comment can still match
                at = self.source.find("<!--", at)
                return None if at < 0 else _PLAIN.match(self.source, at)
            name = _NAME.match(self.source, at) if self.failed else None
            fails = name is not None and any(self._outside(name.end(), starts, ends) for starts, ends in self.failed)
            m = (_PLAIN if fails else _TAG).match(self.source, at)
            if m is not None:
                if not fails and m.re is _TAG and m[2] is None and self.source[at + 1] not in "!?":
                    self._remember(at)
                return m
            pos = at + 1

    @staticmethod
    def _outside(at: int, starts: list[int], ends: list[int]) -> bool:
        """Whether a failed reading (first the end of its name, then its quotes) was outside quotes at ``at``."""
        k = bisect_right(starts, at)
        return k > 0 and at >= ends[k - 1]

    def _remember(self, at: int) -> None:
        pos = _NAME.match(self.source, at).end()
        starts, ends = [pos], [pos]
        while (m := _QUOTED.search(self.source, pos)) is not None:
            starts.append(m.start())
            ends.append(m.end())
            pos = m.end()
        self.failed.append((starts, ends))


class Page:
    """Folded tree and text blocks of one page.

    ``parents`` and ``labels`` describe the folded nodes; ``blocks`` holds
    (node, text, share of link characters, boilerplate, inside an article:
    ``HELD`` for an article inside a region that only its class marks).
    """

    __slots__ = ("parents", "labels", "blocks", "_child", "has_content")

    def __init__(self, source: str | None):
        self.parents, self.labels = [-1], ["#"]
        self._child: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str, float, bool, int]] = []
        self.has_content = False
        if source:
            self._parse(source)

    def _node(self, parent: int, label: str) -> int:
        key = (parent, label)
        node = self._child.get(key)
        if node is None:
            node = self._child[key] = len(self.labels)
            self.parents.append(parent)
            self.labels.append(label)
        return node

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int, bool, int, bool]] = [("#", 0, False, False, False)]
        text: list[str] = []
        linked, in_link, at = 0, False, 0

        def flush() -> None:
            nonlocal linked
            if text:
                words = " ".join(entities.unescape("".join(text)).split())
                if words:
                    _, node, boiler, content, _ = stack[-1]
                    self.blocks.append((node, words, min(1.0, linked / len(words)), boiler, content))
                text.clear()
            linked = 0

        def add(piece: str) -> None:
            nonlocal linked
            if piece:
                text.append(piece)
                if in_link:
                    linked += len(piece)

        pos, size, tags = 0, len(source), _Tags(source)
        opened: Counter = Counter()              # open elements by tag: a search for one that is not open is left out

        def close(k: int) -> None:
            for name, *_ in stack[k:]:
                opened[name] -= 1
            del stack[k:]

        while True:
            m = tags.next(pos)
            if m is None:
                add(source[at:])
                break
            add(source[at:m.start()])
            at = pos = m.end()
            tag = m[2] if m.re is _TAG else None
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if tag in _INLINE:
                    if tag == "a":
                        in_link = False
                    if stack[-1][0] != "." + tag:
                        continue
                    flush()
                    close(len(stack) - 1)
                    continue
                for k in range(len(stack) - 1 if opened[tag] else 0, 0, -1):
                    if stack[k][0] == tag:
                        flush()
                        in_link = False
                        close(k)
                        break
                continue
            names = [[w.lower() for w in _TOKEN.findall(x)] for _, v in _ATTR.findall(m[3]) for x in v.split()] if m[3] else ()
            words = {w for x in names for w in x}
            roles = {w for x in names if x and (len(x) == 1 or x[0] not in _LAYOUT_WORDS) for w in x}
            marked = not _BOILER_WORDS.isdisjoint(roles)
            if tag in _INLINE and not (marked and tag not in _VOID):
                if tag == "br":
                    text.append(" ")
                elif tag == "a":
                    in_link = True
                continue
            flush()
            if tag not in _KEEPS_P and stack[-1][0] == "p":
                close(len(stack) - 1)
            if tag in _ENDS:
                closes, stops = (x.split() for x in _ENDS[tag])
                for k in range(len(stack) - 1 if any(opened[x] for x in closes) else 0, 0, -1):
                    if stack[k][0] in stops:
                        break
                    if stack[k][0] in closes:
                        close(k)
                        break
            if tag in _RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, pos)
                at = pos = end.end() if end else size
                continue
            if tag in _VOID:
                continue
            _, parent, boiler, content, by_class = stack[-1]
            head = not content and (tag == "header" or not _HEADER_WORDS.isdisjoint(roles))
            starts = tag in _CONTENT_TAGS or "articlebody" in words or "main" in words and tag in ("div", "section")
            by_tag = tag in _BOILER_TAGS or head
            by_class = (by_class or not boiler) and not by_tag and (by_class or marked and tag not in ("html", "body", "article", "main"))
            boiler = boiler or by_class or by_tag
            if starts and not content and by_class and not marked:
                boiler, content, by_class = False, HELD, False
            elif starts and not content and not boiler:
                content = self.has_content = True
            label = tag + ("." + "-".join(sorted(words)) if words else "")
            name = "." + tag if tag in _INLINE else tag
            stack.append((name, self._node(parent, label), boiler, content, by_class))
            opened[name] += 1
        flush()

    def skeleton(self) -> str:
        """The folded tree as text: parent and label of each node, a line each (labels hold no white space)."""
        return "\n".join(f"{p}:{x}" for p, x in zip(self.parents[1:], self.labels[1:]))


def _tree(skeleton: str) -> tuple[list[str], list[list[int]], list[int]]:
    labels, children, parents = ["#"], [[]], [-1]
    for part in skeleton.split("\n") if skeleton else ():
        p, label = part.split(":", 1)
        labels.append(label)
        children.append([])
        parents.append(int(p))
        children[int(p)].append(len(labels) - 1)
    return labels, children, parents


_NO_MATCH = (0, [])


@lru_cache(maxsize=4096)
def align(wrapper: str, page: str) -> tuple[int, ...]:
    """Slot of every node of ``page``: the matched wrapper node, or -1.

    Simple tree matching: roots match if their tags do (more if the labels are
    equal), and children match in order with the greatest total.
    """
    if wrapper == page:
        return tuple(range(page.count("\n") + 2 if page else 1))
    a_labels, a_children, _ = _tree(wrapper)
    b_labels, b_children, _ = _tree(page)
    tags_a, tags_b = [x.split(".")[0] for x in a_labels], [x.split(".")[0] for x in b_labels]
    best: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    todo = [(0, 0)]
    while todo:                                  # children first: trees may be deeper than calls can nest
        i, j = todo[-1]
        left, right = a_children[i], b_children[j]
        ahead = [] if (i, j) in best else [(c, d) for c in left for d in right if tags_a[c] == tags_b[d] and (c, d) not in best]
        if ahead or (i, j) in best:
            if ahead:
                todo += ahead
            else:
                todo.pop()
            continue
        table = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for x, c in enumerate(left, 1):
            for y, d in enumerate(right, 1):
                table[x][y] = max(table[x - 1][y], table[x][y - 1], table[x - 1][y - 1] + best.get((c, d), _NO_MATCH)[0])
        x, y, pairs = len(left), len(right), []
        while x and y:
            if table[x][y] == table[x - 1][y]:
                x -= 1
            elif table[x][y] == table[x][y - 1]:
                y -= 1
            else:
                x, y = x - 1, y - 1
                pairs.append((left[x], right[y]))
        best[i, j] = (table[-1][-1] + 1 + (a_labels[i] == b_labels[j]), pairs)
        todo.pop()
    slots, todo = [-1] * len(b_labels), [(0, 0)]
    while todo:
        i, j = todo.pop()
        slots[j] = i
        todo += best[i, j][1]
    return tuple(slots)


def _candidates(page: Page) -> Iterator[tuple[int, str, bool]]:
    """(node, text, inside an article) of the blocks that no tag or class excludes and that are no menus.

    ``HELD`` articles count where no other article is and they hold at least half of the text.
    """
    blocks = [(n, t, content) for n, t, links, boiler, content in page.blocks if not boiler and (content or links < MAX_LINKS)]
    held = sum(len(t) for _, t, content in blocks if content == HELD)
    use_held = held and not page.has_content and 2 * held >= sum(len(t) for _, t, _ in blocks)
    for node, text, content in blocks:
        if content != HELD or use_held:
            yield node, text, bool(content)


def _line(slot: int, text: str) -> int:
    """Hash of a block's text at its slot."""
    raw = f"{slot}:{text}".encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def _kept(page: Page, slots: tuple[int, ...], constant: frozenset, judged: frozenset, lines: frozenset) -> Iterator[str]:
    """Texts of the blocks that are neither excluded nor template."""
    blocks = list(_candidates(page))
    inside = sum(len(t) for _, t, content in blocks if content)
    only_article = page.has_content and 2 * inside >= sum(len(t) for _, t, _ in blocks)
    for node, text, content in blocks:
        slot = slots[node] if slots else -1
        if slot in constant:
            continue
        if content or (slot in judged or not only_article) and not (lines and _line(slot, text) in lines):
            yield text


def _slots(page: Page, wrapper: str | None) -> tuple[int, ...]:
    return align(wrapper, page.skeleton()) if wrapper is not None else (-1,) * len(page.labels)


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): the most frequent folded tree of every host."""
    trees = map_batches(pages.select(host_of("url").alias("host"), "html"),
                        lambda hosts, sources: [(h, Page(s).skeleton()) for h, s in zip(hosts, sources)],
                        "host string, tree string")
    return (trees.groupBy("host", "tree").count()
            .groupBy("host").agg(F.max_by("tree", F.struct("count", "tree")).alias("wrapper")))


def templates(pages: DataFrame, hosts: DataFrame, share: float = CONSTANT_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, wrapper, constant, judged, lines): the template slots of every host, the slots of enough pages, and template blocks."""
    def rows(names: list, found: list, sources: list) -> list[tuple]:
        out = []
        for host, wrapper, source in zip(names, found, sources):
            page = Page(source)
            slots, texts, lines = _slots(page, wrapper), {}, set()
            for node, text, content in _candidates(page):
                if slots[node] >= 0:
                    texts.setdefault(slots[node], []).append(text)
                    if not content:
                        lines.add((slots[node], _line(slots[node], text)))
            joined = {s: "\n".join(t) for s, t in texts.items()}
            whole = "\n\n".join(joined.values())
            out += [(host, s, t, None, whole) for s, t in joined.items()]
            out += [(host, s, None, x, whole) for s, x in lines]
        return out

    keyed = pages.select(host_of("url").alias("host"), "html").join(hosts, "host")
    seen = map_batches(keyed.select("host", "wrapper", "html"), rows, "host string, slot int, text string, line long, page string").select(
        "host", "slot", F.xxhash64("text").alias("text"), "line", F.xxhash64("page").alias("page"))
    counts = checkpoint(seen.groupBy("host", "slot", "text", "line", "page").agg(F.lit(1).alias("one"))
                        .groupBy("host", "slot", "text", "line").agg(F.count("*").alias("n")))
    totals = broadcast_if_small(counts.where("line is null").groupBy("host", "slot").agg(F.sum("n").alias("all"), F.max("n").alias("top"))
                                .where(F.col("all") >= min_pages))
    slots = totals.groupBy("host").agg(F.collect_list(F.when(F.col("top") >= share * F.col("all"), F.col("slot"))).alias("constant"),
                                       F.collect_list("slot").alias("judged"))
    lines = (counts.where(F.col("line").isNotNull() & (F.col("n") >= share * min_pages)).join(totals, ["host", "slot"])
             .where(F.col("n") >= share * F.col("all")).groupBy("host").agg(F.collect_list("line").alias("lines")))
    return hosts.join(slots, "host", "left").join(lines, "host", "left")


def _small(hosts: DataFrame, column: str) -> DataFrame:
    """``hosts`` cut by a checkpoint: broadcast if its trees hold at most ``MAX_BROADCAST_BYTES``, else joined by a shuffle."""
    hosts = checkpoint(hosts)
    size = hosts.agg(F.sum(F.octet_length(column) + F.octet_length("host") + 100).alias("n")).first()["n"] or 0
    return F.broadcast(hosts) if size <= MAX_BROADCAST_BYTES else hosts


def extract(pages: DataFrame, share: float = CONSTANT_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    model = _small(templates(pages, _small(wrappers(pages), "wrapper"), share, min_pages), "wrapper")
    keyed = pages.select("page_id", "url", "html", host_of("url").alias("host")).join(model, "host", "left")

    def rows(ids: list, urls: list, sources: list, found: list, *sets: list) -> list[tuple]:
        out = []
        for page_id, url, source, wrapper, *known in zip(ids, urls, sources, found, *sets):
            page = Page(source)
            constant, judged, lines = (frozenset(x or ()) for x in known)
            slots = _slots(page, wrapper) if judged else ()
            text = "\n\n".join(_kept(page, slots, constant, judged, lines))
            out.append((page_id, url, text, len(text)))
        return out

    return map_batches(keyed.select("page_id", "url", "html", "wrapper", "constant", "judged", "lines"), rows,
                       "page_id long, url string, text string, n_chars long")
