"""Main text of HTML pages by differencing each page against its nearest neighbours.

A page becomes lines, one per block of visible text, with what the markup says of each: inside
an article or main element or not, and inside an element whose class or id names an advert, a
sidebar, comments and the like or not. What HTML itself says isn't text or isn't the page's
(scripts, forms, navigation, footers, hidden parts) makes no lines.

Pages of one host are put in the order of their URL paths and aligned, line by line, with the
nearest ones by longest common subsequence: those that share the longer start of the path come
first, then those that are fewer places away. A page is paired with the nearest one that isn't a
copy of it, and lines that both share are deleted. Markup breaks the ties that one pair leaves:

* Lines in the flow of an article may be passages that two articles share. They are deleted only
  where all of the nearest pages that aren't copies share them, and three at least.
* Of the lines outside, none is kept where there is such a flow.
* Lines under a telling class or id go, unless nothing else would be left.

Two pages are copies if they share half of what they have beside the lines of most pages in
reach, or if what differs between them is itself alike: half of the runs of three words in it.

Distribution. Pages are dealt by ranges of (host, path), so a host with a third of all pages
takes many partitions. The ranges come from a pass over the URLs alone; the first and last pages
of each range, as many as a page looks at on one side, are also sent to the ranges beside it, so
every page meets the neighbours it has in the whole order and the result doesn't depend on the
number of ranges. A task holds that many pages at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator

import html as htmllib
import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .urldigest import split_url

#: Elements whose content is never part of the main text.
DROPPED = frozenset("head script style noscript template nav footer aside form button select option datalist textarea iframe svg canvas object audio video dialog menu".split())
#: Elements whose content is text up to their own end tag.
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"))
#: End tags that a new block implies.
IMPLIED = {"p": BLOCKS, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",))}
#: Words that make a class or id tell of what isn't main text.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead comment comments respond disqus cookie cookies consent gdpr notice notices alert newsletter subscribe subscription paywall share sharing social related recommended popup modal overlay widget toolbar pagination pager login signin signup skip hidden".split())
#: Words that may stand beside them in such a name; any other word (share-price, has-sidebar) makes it tell nothing.
BESIDE = frozenset("area article articles bar blog body bottom box block button buttons container content entry fixed footer form global header inner item items js left link links list main mobile page panel post posts primary prompt reader right row secondary section site slot sticky text thread top unit user wrap wrapper".split())
PAGE_MARKS = frozenset(("header",))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())

_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ATTR = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>=`]+))?""")
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}

#: Flags of lines.
IN_ROOT, MARKED = 1, 2


def _tag_end(text: str, at: int) -> int:
    """Where the tag that begins before ``at`` ends: the first > outside quotes, or the first at all."""
    plain = text.find(">", at)
    if plain < 0:
        return -1
    i = at
    while True:
        end = text.find(">", i)
        if end < 0:
            return plain
        quote = min((q for q in (text.find('"', i, end), text.find("'", i, end)) if q >= 0), default=-1)
        if quote < 0:
            return end
        close = text.find(text[quote], quote + 1)
        if close < 0:
            return plain
        i = close + 1


def _telling(name: str, in_root: bool) -> bool:
    """Whether a class or id, as a whole, names what isn't main text."""
    words = {w.lower() for w in _WORDS.findall(name)}
    marks = MARKS if in_root else MARKS | PAGE_MARKS
    return not words.isdisjoint(marks) and words <= marks | BESIDE


def _judged(attrs: str, in_root: bool) -> tuple[bool, bool]:
    """What attributes say of an element: that it is hidden or no text by its role, or by its class or id."""
    gone = marked = False
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            marked = marked or any(_telling(name, in_root) for name in value.split())
        elif key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            gone = True
    return gone, marked


def page_lines(text: str) -> list[tuple[str, int]]:
    """The lines of a page that may be main text, each with its flags, in page order.

    One pass over the tags; an end tag finds the element that it closes by name, so the time is
    linear in the page, however deep it is and whatever doesn't match.
    """
    lines: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, int, int]] = []  # name, dropped, in root, marked: counts with this element
    opened: dict[str, list[int]] = {}  # by name, the places of open elements in the stack
    dropped = root = marks = 0

    def end_block() -> None:
        nonlocal parts
        if parts:
            line = " ".join(htmllib.unescape("".join(parts)).split())
            if line:
                lines.append((line, IN_ROOT * bool(root) | MARKED * bool(marks)))
            parts = []

    def close(depth: int) -> None:
        nonlocal dropped, root, marks
        while len(stack) > depth:
            name, d, r, m = stack.pop()
            opened[name].pop()
            dropped, root, marks = dropped - d, root - r, marks - m

    at, n = 0, len(text)
    while at < n:
        lt = text.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not dropped:
            parts.append(text[at:lt])
        if lt == n:
            break
        if text.startswith("<!--", lt):
            end = text.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if text[lt + 1 : lt + 2] in ("!", "?"):
            end = text.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _NAME.match(text, lt + 1)
        if not m:
            if not dropped:
                parts.append("<")
            at = lt + 1
            continue
        end = _tag_end(text, m.end())
        if end < 0:
            break
        name, attrs, at = m[0].lower(), text[m.end() : end], end + 1
        if name[0] == "/":
            name = name[1:]
            if name in BLOCKS:
                end_block()
            elif name in ("td", "th") and not dropped:
                parts.append(" ")
            if opened.get(name):
                depth = opened[name][-1]
                if name in ("td", "th") or any(r or m for _, _, r, m in stack[depth:]):
                    end_block()
                close(depth)
            continue
        if name in BLOCKS:
            end_block()
        while stack and stack[-1][0] in IMPLIED and name in IMPLIED[stack[-1][0]]:
            end_block()
            close(len(stack) - 1)
        if name in VOID or attrs.endswith("/") and name in ("svg", "path", "math"):
            continue
        is_root = name in ("article", "main")
        gone, marked = _judged(attrs, bool(root)) if attrs and name not in ("html", "body") else (False, False)
        gone = gone or name in DROPPED or name == "header" and not root
        # The page's own article isn't judged by its class; one inside it may be a comment.
        marked = marked and not gone and not (name == "main" or name == "article" and not root)
        if name in RAW:
            found = _RAW_END[name].search(text, at)
            at = n if not found else (text.find(">", found.end()) + 1 or n)
            continue
        if gone or marked or is_root or name in BLOCKS or name in ("td", "th") or opened.get(name):
            if marked or is_root:
                end_block()
            opened.setdefault(name, []).append(len(stack))
            stack.append((name, int(gone), int(is_root and not gone), int(marked)))
            dropped, root, marks = dropped + gone, root + (is_root and not gone), marks + marked
    end_block()
    return lines


def lcs_shared(a: list, b: list) -> list[bool]:
    """Which items of ``a`` a longest common subsequence of both takes."""
    shared = [False] * len(a)
    low, top_a, top_b = 0, len(a), len(b)
    while low < top_a and low < top_b and a[low] == b[low]:
        shared[low] = True
        low += 1
    while top_a > low and top_b > low and a[top_a - 1] == b[top_b - 1]:
        top_a, top_b = top_a - 1, top_b - 1
        shared[top_a] = True
    both = set(a[low:top_a]) & set(b[low:top_b])
    at = [i for i in range(low, top_a) if a[i] in both]
    other = [x for x in b[low:top_b] if x in both]
    if not at:
        return shared
    for i in _chain([a[i] for i in at], other):
        shared[at[i]] = True
    return shared


#: Bits of a table that an alignment may keep; a larger one is cut in two.
TABLE_BITS = 1 << 24


def _rows(a: list, b: list) -> Iterator[int]:
    """For each start of ``a``, from the empty one on: bit j is 0 where the length of the longest
    common subsequence with the starts of ``b`` grows with item j."""
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    yield v
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list, b: list) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` with all starts of ``b``, the empty one first."""
    for last in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(last.to_bytes((len(b) + 7) // 8, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def _chain(a: list, b: list) -> list[int]:
    """The places in ``a`` of a longest common subsequence of both, in memory linear in their lengths."""
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) > TABLE_BITS and a1 - a0 > 1:
            mid = (a0 + a1) // 2
            both = _lengths(a[a0:mid], b[b0:b1]) + _lengths(a[mid:a1][::-1], b[b0:b1][::-1])[::-1]
            cut = b0 + int(both.argmax())
            todo += [(mid, a1, cut, b1), (a0, mid, b0, cut)]
            continue
        rows, i, j = list(_rows(a[a0:a1], b[b0:b1])), a1 - a0, b1 - b0
        length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
        found = []
        while i and j:
            if a[a0 + i - 1] == b[b0 + j - 1]:
                found.append(a0 + i - 1)
                i, j = i - 1, j - 1
            elif length(i - 1, j) >= length(i, j - 1):
                i -= 1
            else:
                j -= 1
        out += found[::-1]
    return out


#: Pages on either side, in the order of paths, that a page is compared with.
REACH = 8
#: Pages that must share a line of an article before it counts as the site's.
WITNESSES = 3
#: Share of what two pages have beside the lines of most pages, or of the runs of ``RUN`` words in
#: what differs between them, from which they are copies.
COPY_SHARE, RUN = 0.5, 3
#: Share of the pages in reach that have the lines of most pages.
MOST = 0.75


def _runs(lines: frozenset[str]) -> set[tuple[str, ...]]:
    out = set()
    for line in lines:
        words = line.split()
        out.update(tuple(words[i : i + RUN]) for i in range(max(1, len(words) - RUN + 1)))
    return out


class Page:
    """A page's lines with their flags."""

    def __init__(self, lines: list[str], flags: bytes):
        self.lines, self.flags, self.has = lines, flags, frozenset(lines)

    def copies(self, other: Page, most: frozenset[str]) -> bool:
        """Whether the pages share half of what the one with less has beside ``most``, the lines of
        most pages, or whether what differs between them is itself alike."""
        if self.has.isdisjoint(other.has):
            return not self.has and not other.has
        size = lambda lines: sum(map(len, lines))
        mine, its = self.has - most, other.has - most
        if size(mine & its) >= COPY_SHARE * min(size(mine), size(its)):
            return True
        mine, its = _runs(mine - other.has), _runs(its - self.has)
        return len(mine & its) >= COPY_SHARE * min(len(mine), len(its))

    def text(self, near: list[Page]) -> str:
        """The lines that stay, given the other pages in reach, nearest first."""
        flow = [i for i, f in enumerate(self.flags) if f == IN_ROOT] or [i for i, f in enumerate(self.flags) if f & IN_ROOT]
        may = frozenset(self.lines[i] for i in flow)
        if flow and (len(near) < WITNESSES or may.isdisjoint(near[0].has)):
            return "\n".join(self.lines[i] for i in flow)
        counts = Counter(line for p in near for line in p.has)
        most = frozenset(line for line, n in counts.items() if n >= MOST * len(near))
        others = (p for p in near if not self.copies(p, most))
        if flow:
            gone = self._on_all(may, others)
            return "\n".join(self.lines[i] for i in flow if not gone[i])
        pair = next(others, None)
        shared = lcs_shared(self.lines, pair.lines) if pair else [False] * len(self.lines)
        own = [i for i, s in enumerate(shared) if not s]
        return "\n".join(self.lines[i] for i in ([i for i in own if not self.flags[i] & MARKED] or own))

    def _on_all(self, may: frozenset[str], others: Iterator[Page]) -> list[bool]:
        """Which lines, ``may`` among them, are aligned with one of each of the others, if they are enough."""
        asked = []
        for p in others if may else ():
            may &= p.has
            asked.append(p)
            if not may:
                break
        if not may or len(asked) < WITNESSES:
            return [False] * len(self.lines)
        return [all(s) for s in zip(*(lcs_shared(self.lines, p.lines) for p in asked))]


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


_KEY = "host string, path string, page_id long, uid long"


def _key_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = [split_url(u) for u in b.column("url").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), b.column("page_id"), b.column("_uid")], names=["host", "path", "page_id", "uid"])


def _order(key: tuple) -> tuple:
    host, path, page_id, uid = key
    return host, path, page_id is not None, page_id or 0, uid


def _ends_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range: its first rows and its last, as many as a page looks at on one side."""
    first: list[tuple] = []
    last: deque[tuple] = deque(maxlen=REACH)
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("host", "path", "page_id", "uid"))):
            if len(first) < REACH:
                first.append(row)
            last.append(row)
    if first:
        part = TaskContext.get().partitionId()
        rows = [(part, False, *r) for r in first] + [(part, True, *r) for r in last]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["part", "last", "host", "path", "page_id", "uid"])


def _plan(rows: list[tuple]) -> tuple[list[tuple], dict[int, list[int]]]:
    """The last key of each range in their order, and for the rows near a border the other ranges they go to."""
    firsts: dict[int, list[tuple]] = {}
    lasts: dict[int, list[tuple]] = {}
    for part, last, *key in rows:
        (lasts if last else firsts).setdefault(part, []).append(_order(tuple(key)))
    for keys in (*firsts.values(), *lasts.values()):
        keys.sort()
    parts, sent = sorted(lasts, key=lambda p: lasts[p][-1]), {}
    for i in range(len(parts)):
        for step, keys in ((1, lasts), (-1, firsts)):
            to, left = i + step, REACH
            while left and 0 <= to < len(parts):
                # A range further off sees as many fewer rows of this one as lie between.
                mine = keys[parts[i]]
                for key in mine[-left:] if step == 1 else mine[:left]:
                    sent.setdefault(key[-1], []).append(to)
                left -= min(left, len(firsts[parts[to]]))
                to += step
    return [lasts[p][-1] for p in parts], sent


def _parse_task(plan: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, sent = plan.value
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            rows, size = [], 0
            for page_id, uid, url, html in zip(b.column("page_id").to_pylist(), b.column("_uid").to_pylist(), b.column("url").to_pylist(), b.column("html")):
                key = (*split_url(url), page_id, uid)
                lines = page_lines(html.as_py() or "")
                body = pack("\n".join(t for t, _ in lines).encode("utf-8", "surrogatepass"))
                row = (*key, url, body, bytes(f for _, f in lines))
                block = min(bisect_left(ends, _order(key)), len(ends) - 1)
                rows.append((block, False, *row))
                rows += [(to, True, *row) for to in sent.get(uid, ())]
                size += len(body)
                if size > 32_000_000:
                    yield _dealt(rows)
                    rows, size = [], 0
            if rows:
                yield _dealt(rows)

    return run


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()))], names=["block", "halo", "host", "path", "page_id", "uid", "url", "body", "flags"])


def near_pages(rows: list[tuple], at: int) -> list[Page]:
    """The pages of one host around place ``at`` of rows (host, path, page, ...) in reach, nearest first."""
    host, path = rows[at][:2]
    near = []
    for step in (-1, 1):
        for k in range(1, REACH + 1):
            i = at + step * k
            if not 0 <= i < len(rows) or rows[i][0] != host:
                break
            near.append((-_common(path, rows[i][1]), k, step, i))
    return [rows[i][2] for *_, i in sorted(near)]


def _diff_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    held: deque[tuple] = deque()
    out: list[tuple] = []
    size = 0

    def told(at: int) -> None:
        nonlocal size
        host, path, page, halo, page_id, uid, url = held[at]
        if not halo:
            text = page.text(near_pages(held, at))
            out.append((uid, page_id, url, text, len(text)))
            size += len(text)

    at = 0  # the place in ``held`` of the page that is next
    for b in batches:
        for halo, host, path, page_id, uid, url, body, flags in zip(*(b.column(c).to_pylist() for c in ("halo", "host", "path", "page_id", "uid", "url", "body", "flags"))):
            lines = unpack(body).decode("utf-8", "surrogatepass")
            held.append((host, path, Page(lines.split("\n") if lines else [], flags), halo, page_id, uid, url))
            if len(held) - at > REACH:
                told(at)
                at += 1
            if at > REACH:
                held.popleft()
                at -= 1
            if len(out) == 500 or size > 8_000_000:
                yield _out(out)
                out, size = [], 0
    for at in range(at, len(held)):
        told(at)
    if out:
        yield _out(out)


def _out(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["uid", "page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per page: uid, page_id, url, text (empty if none) and n_chars, its code points.

    Null html is an empty page; a null url, or one without ``://``, belongs to the empty host.
    Pages with equal URLs follow each other in the order of page_id (nulls first), repeated
    rows in the order they are read. Only page_id, url and html are read. Lines are joined by
    line feeds; white space inside one is a single space.
    """
    spark = pages.sparkSession
    base.ship_package(spark)
    n = partitions or base.partitions_for(spark)
    rows = base.with_uid(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")))
    keys = rows.select("page_id", "_uid", "url").mapInArrow(_key_task, _KEY)
    order = [F.col("host"), F.col("path"), F.col("page_id").isNotNull(), F.col("page_id"), F.col("uid")]
    ranges = keys.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ends = ranges.mapInArrow(_ends_task, f"part int, last boolean, {_KEY}").collect()  # 16 rows per range
    if not ends:
        return spark.createDataFrame([], "uid long, page_id long, url string, text string, n_chars long")
    plan = _plan([tuple(r) for r in ends])
    dealt = rows.mapInArrow(_parse_task(spark.sparkContext.broadcast(plan)), "block int, halo boolean, host string, path string, page_id long, uid long, url string, body binary, flags binary")
    ends = plan[0]
    dealt = dealt.repartitionById(len(ends), "block").sortWithinPartitions(*order)
    return dealt.select("halo", "host", "path", "page_id", "uid", "url", "body", "flags").mapInArrow(_diff_task, "uid long, page_id long, url string, text string, n_chars long")
