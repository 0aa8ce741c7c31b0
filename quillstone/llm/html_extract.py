"""Main text of web pages: nearest-URL page differencing, with markup to protect articles and to settle what varies.

Every page is parsed into lines, one for each block, in page order. The pages of a host are ordered by URL path, and each page
is aligned by the longest common subsequence of lines with whichever neighbour in that order shares the longer beginning of
the path (the one before it in a tie). Lines outside of articles and main elements that the neighbour shares are the site's and
are deleted: menus, headers, footers, notices, whether or not markup names them, also on pages that have an article. Markup
settles the rest. A line within an article is the page's whatever its neighbours say, for two articles may quote the same
passage. A line that no neighbour shares is deleted only if an element or class marks it as a menu, header, footer, sidebar,
notice, advert, form, script or comment: adverts, comments and menus vary from page to page. Lines of a main element that are
in no article are deleted where the two nearest pages that differ, at most two away on either side, both share them: what
one page shares may be a quotation. With fewer than two such pages they stay.

Pages that say the same (equal lines but for the marked ones) are copies of one page: repeated rows, twins by query string,
print or mobile address. Where they follow each other they are one run, whose neighbours are the pages before and after it.
So no page is compared with its copy, which would delete all of its lines.

Neighbours meet without a global sort in one task: (host, path, id) is dealt into ranges, each a partition. A first pass over
digests of the lines finds the runs at the ends of all ranges, and so the pages that a range needs of others, however many
copies lie between; these are sent to it as guests. Hosts may hold any share of the pages. Extracted lines are shuffled once,
pages are parsed twice.

Defined results. Null and empty html: empty text. A null or broken URL counts as the empty host and its own text as path.
Repeated rows are extracted once each; equal URLs are ordered by id, then by the digest of their lines. A host with one
page, or with copies of one, has nothing to compare. Copies have the counts of deleted lines of the first of them. Unclosed elements end where their container ends. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import re
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import pick, range_starts, shuffle_partitions

#: Elements by what they mean for the lines in them.
UNREAD = frozenset("script style head template noscript iframe object svg math canvas audio video select textarea title".split())
MARKED = frozenset("nav footer aside form button dialog menu".split())
BODY = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words of a class, id or role that mark an element as not the article's own text.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|banner|breadcrumb|breadcrumbs|comment|comments|consent|cookie|cookies|footer|header|masthead|menu|nav|navbar|navigation|newsletter"
    r"|notice|popup|promo|promoted|related|share|sharing|sidebar|social|sponsor|sponsored|subscribe|toolbar|widget|complementary|contentinfo|search)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: White space as the contract's blocks know it.
SPACE = re.compile(r"\s+")
OPEN, ARTICLE, SITE, MAIN = 0, 1, 2, 3
#: Results in a batch at most.
SLICE = 1000


class Lines(HTMLParser):
    """Collects (kind, text) of a page's blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, int]] = []  # name, unread, marked, body (OPEN, MAIN or ARTICLE): each of it or what holds it
        self.parts: list[str] = []
        self.lines: list[tuple[int, str]] = []
        self.kind = OPEN

    def state(self) -> tuple[bool, bool, int]:
        return self.stack[-1][1:] if self.stack else (False, False, OPEN)

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        self.parts.clear()
        if text:
            _, marked, body = self.state()
            self.lines.append((SITE if marked else body, text))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
        if tag in VOID:
            return
        if tag in ("p", "li", "td", "tr", "option", "dt", "dd"):
            self.close_open(tag)
        unread, marked, body = self.state()
        # an article's own header holds its title; a page's holds the site's
        named = any(k in ("class", "id", "role") and v and MARKS.search(v) for k, v in attrs)
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        marked = marked or tag in MARKED or tag == "header" and not body or named and tag not in BODY and tag not in ("html", "body") or hidden
        body = ARTICLE if tag == "article" else MAIN if tag == "main" and body == OPEN else body
        self.stack.append((tag, unread or tag in UNREAD, marked, body))

    def close_open(self, tag: str) -> None:
        """An element of these kinds ends an open one like it in the same container."""
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name == tag:
                self.flush()
                del self.stack[k:]
                return
            if name in BLOCK:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name == tag:
                del self.stack[k:]
                return
            if name in BODY or name in MARKED or name in ("body", "header"):
                if tag not in BODY | MARKED | {"body", "header", "html"}:
                    return

    def handle_data(self, data: str) -> None:
        if not self.state()[0]:
            self.parts.append(data)


def lines_of(html: str | None) -> list[tuple[int, str]]:
    """The page's blocks; marked ones stay in the list, for differencing to see the page as it is."""
    if not html:
        return []
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.lines


def address(url: str | None) -> tuple[str, str]:
    """Host, lower case without www or m, and path without query and fragment."""
    if not url:
        return "", ""
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)", url)
    if not m:
        return "", url
    host = re.sub(r"^(?:www|m)\.", "", m[1].rpartition("@")[2].lower())
    return host, m[2].rstrip("/") or "/"


def sort_key(page_id: object, url: str | None) -> str:
    """Orders by host, then path, then id; a null id comes first."""
    host, path = address(url)
    last = f"{page_id:020d}" if isinstance(page_id, int) else "" if page_id is None else str(page_id)
    return f"{host}\x01{path}\x01{last}"


def nearness(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def shared(own: list[str], other: list[str]) -> set[int]:
    """Indexes in ``own`` of a longest common subsequence of lines, equal beginnings and ends first."""
    head = 0
    while head < min(len(own), len(other)) and own[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(len(own), len(other)) - head and own[-1 - tail] == other[-1 - tail]:
        tail += 1
    found = {*range(head), *range(len(own) - tail, len(own))}
    a, b = own[head : len(own) - tail], other[head : len(other) - tail]
    common = set(a) & set(b)
    ka, kb = [i for i, x in enumerate(a) if x in common], [i for i, x in enumerate(b) if x in common]
    # Hunt and Szymanski: a longest increasing chain of matching places, in memory that follows the matches
    where: dict[str, list[int]] = {}
    for j in kb:
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    from bisect import bisect_left

    for i in ka:
        for j in reversed(where[a[i]]):
            k = bisect_left(ends, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            else:
                ends[k], chains[k] = j, link
    link = chains[-1] if chains else None
    while link:
        found.add(head + link[0])
        link = link[1]
    return found


def settled(lines: list[tuple[int, str]], neighbour: list[tuple[int, str]] | None, witnesses: list[list[tuple[int, str]]] = ()) -> tuple[str, int, int]:
    """The text, and how many lines were deleted because neighbours share them, and by markup alone."""
    common: set[int] = set()
    outside = [k for k, (kind, _) in enumerate(lines) if kind in (OPEN, SITE)]
    if neighbour and outside:
        common |= {outside[i] for i in shared([lines[k][1] for k in outside], [t for kind, t in neighbour if kind in (OPEN, SITE)])}
    main_lines = [k for k, (kind, _) in enumerate(lines) if kind == MAIN]
    if len(witnesses) == 2 and main_lines:
        one, two = (shared([lines[k][1] for k in main_lines], [t for kind, t in w if kind in (OPEN, MAIN)]) for w in witnesses)
        common |= {main_lines[i] for i in one & two}
    marked = [k for k, (kind, _) in enumerate(lines) if kind == SITE and k not in common]
    deleted = common.union(marked)
    return "\n".join(text for k, (_, text) in enumerate(lines) if k not in deleted), len(common), len(marked)


#: Runs of equal pages that a range is told of at each of its ends, and that a page's neighbours are looked for in.
EDGE, REACH = 4, 2
DEALT = "page_id {}, url string, key string, digest string, lines string, range int, guest boolean"


def digest_of(lines: list[tuple[int, str]]) -> str:
    """The same for pages that say the same, whatever menus and notices the markup names."""
    return xxhash.xxh3_128_hexdigest("\n".join(text for kind, text in lines if kind != SITE))


def host_of(key: str) -> str:
    return key.partition("\x01")[0]


def keys_only(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for i, url in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                keys.append(sort_key(i, url))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], names=["key"])

    return pages.select("page_id", "url").mapInArrow(run, "key string")


def place_of(starts: list[str], key: str) -> int:
    return max(0, bisect.bisect_right(starts, key) - 1)


def ends_of_ranges(pages: DataFrame, starts: list[str]) -> dict[int, list[tuple[str, str, str, str]]]:
    """For each range its first and last runs of equal pages, in order: host, digest, key of the first page and of the last."""
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for i, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                keys.append(sort_key(i, url))
                found.append(digest_of(lines_of(html)))
            ranges = [place_of(starts, k) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string()), pa.array(ranges, pa.int32())], names=["key", "digest", "range"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list[list] = []
        last: deque[list] = deque(maxlen=EDGE)
        place, n = None, 0
        for batch in batches:
            for key, digest, place in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if last and last[-1][1] == digest and host_of(last[-1][2]) == host_of(key):
                    last[-1][3] = key
                    continue
                last.append([n, digest, key, key])
                n += 1
                if len(first) < EDGE:
                    first.append(last[-1])
        found = first + [x for x in last if x[0] >= len(first)]
        columns = list(zip(*found, strict=True)) if found else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array([place] * len(found), pa.int32()), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)]], names=["range", "n", "digest", "low", "high"])

    ordered = pages.mapInArrow(digests, "key string, digest string, range int").repartitionById(max(1, len(starts)), F.col("range")).sortWithinPartitions("key", "digest")
    runs: dict[int, list[tuple[str, str, str, str]]] = {}
    for r in sorted(ordered.mapInArrow(ends, "range int, n bigint, digest string, low string, high string").collect()):  # 2 x EDGE rows a range
        runs.setdefault(r["range"], []).append((host_of(r["low"]), r["digest"], r["low"], r["high"]))
    return runs


def guests_of(runs: dict[int, list[tuple[str, str, str, str]]]) -> dict[tuple[str, str], list[int]]:
    """From a page's key and digest to the other ranges that must see it: of the runs next to a range, the pages next to it."""
    guests: dict[tuple[str, str], list[int]] = {}
    ranges = sorted(runs)
    for at, r in enumerate(ranges):
        before = ((host, digest, high) for s in reversed(ranges[:at]) for host, digest, _, high in reversed(runs[s]))
        after = ((host, digest, low) for s in ranges[at + 1 :] for host, digest, low, _ in runs[s])
        for own, others in ((runs[r][0][0], before), (runs[r][-1][0], after)):
            seen: list[str] = []
            for host, digest, key in others:
                if host != own:
                    break
                if seen and seen[-1] == digest:
                    continue
                # the first may be the beginning or the end of the range's own run
                if len(seen) > REACH:
                    break
                seen.append(digest)
                guests.setdefault((key, digest), []).append(r)
    return guests


def dealt(pages: DataFrame, starts: list[str], guests: dict[tuple[str, str], list[int]]) -> DataFrame:
    """Each page with its key (orders by host, then path, then id), digest and lines (JSON, a list of [kind, text]), for its range and as a guest for others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, (i, url, html) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                key, lines = sort_key(i, url), lines_of(html)
                digest, text = digest_of(lines), json.dumps(lines, ensure_ascii=False, separators=(",", ":"))
                rows.append((k, key, digest, text, place_of(starts, key), False))
                rows += [(k, key, digest, text, r, True) for r in guests.get((key, digest), ())]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            which = pa.array(columns[0], pa.int64())
            out = [pa.array(c, t) for c, t in zip(columns[1:], (pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), *out], names=["page_id", "url", "key", "digest", "lines", "range", "guest"])

    return pages.mapInArrow(run, DEALT.format(pages.schema["page_id"].dataType.simpleString()))


class Run:
    """Pages of a host that follow each other and say the same: their lines once, and what tells them apart."""

    def __init__(self, host: str, digest: str, path: str, lines: str):
        self.host, self.digest, self.first, self.last = host, digest, path, path
        self.lines: list[tuple[int, str]] = json.loads(lines)
        self.pages: list[tuple[object, str | None, str]] = []


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_shared and n_marked (lines that differencing deleted, and markup alone)."""
    spark = pages.sparkSession
    src = pick(pages, page_id=id_col, url=url_col, html=html_col).withColumns({"url": F.col("url").cast("string"), "html": F.col("html").cast("string")})
    starts = range_starts(keys_only(src), "key", shuffle_partitions(spark))
    # a range's ends travel by a pass over digests: how far its neighbours are isn't known where pages repeat
    guests = guests_of(ends_of_ranges(src, starts))
    ordered = dealt(src, starts, guests).repartitionById(max(1, len(starts)), F.col("range")).sortWithinPartitions("key", "digest").select("page_id", "url", "key", "digest", "lines", "guest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: deque[Run] = deque()  # up to REACH runs that are done, then those that wait for REACH runs after them
        kind, done = None, 0

        def results(at: int) -> Iterator[pa.RecordBatch]:
            own = near[at]
            before = [r for r in list(near)[max(0, at - REACH) : at][::-1] if r.host == own.host]
            after = [r for r in list(near)[at + 1 : at + 1 + REACH] if r.host == own.host]
            witnesses: list[Run] = []
            for r in sorted([*enumerate(before), *enumerate(after)], key=lambda x: x[0]):
                if r[1].digest not in {own.digest, *(w.digest for w in witnesses)}:
                    witnesses.append(r[1])
            texts: dict[bool, tuple[str, int, int]] = {}
            for start in range(0, len(own.pages), SLICE):
                rows = []
                for i, url, path in own.pages[start : start + SLICE]:
                    later = bool(after) and (not before or nearness(after[0].first, path) > nearness(before[0].last, path))
                    if later not in texts:
                        best = after[0] if later else before[0] if before else None
                        texts[later] = settled(own.lines, best.lines if best else None, [r.lines for r in witnesses[:2]])
                    rows.append((i, url, texts[later][0], len(texts[later][0]), *texts[later][1:]))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.string(), pa.string(), *[pa.int64()] * 3), strict=True)], names=["page_id", "url", "text", "n_chars", "n_shared", "n_marked"])
            own.pages.clear()

        for batch in batches:
            kind = batch.schema.field(0).type
            for i, url, key, digest, lines, guest in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                host, path, _ = key.split("\x01", 2)
                if not near or near[-1].host != host or near[-1].digest != digest:
                    near.append(Run(host, digest, path, lines))
                    if len(near) - 1 - done > REACH:
                        yield from results(done)
                        done += 1
                    if done > REACH:
                        near.popleft()
                        done -= 1
                near[-1].last = path
                if not guest:
                    near[-1].pages.append((i, url, path))
        for at in range(done, len(near)):
            yield from results(at)

    return ordered.mapInArrow(run, f"page_id {src.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint, n_shared bigint, n_marked bigint")
