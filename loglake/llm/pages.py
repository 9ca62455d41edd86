"""Main text of web pages by differencing each page with the one of the nearest URL.

A page is read as lines: one per block, character references decoded, white space as one blank. Pages are sorted by host
and path; each is paired with the neighbour on its host whose path has the longest beginning in common with its own (of
equals the nearer one, then the one before). The lines of both are aligned by a longest common subsequence, and lines
they share are deleted: that is the template. Two lines are equal if their elements and words are; lines in elements
that name themselves as no part of the article (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments) are equal if their elements are, as their words differ from page to page.

Differencing alone cannot give the article: a lonely page has no pair, and passages of the article itself repeat on
other pages. So an exact check follows. Lines of self-named elements go even where no pair shares them; where a page marks its
article (``article``, else ``main``), the lines inside stay though a pair shares them, and all lines outside go. A neighbour that has
most of the page's text is a copy, not a template, and the next one is taken.

Only hashes of lines are sorted and compared. Pages meet their verdicts again by a hash of the whole row.

Null html is empty and gives an empty text; a null url, or one without ``://``, is paired with nothing. Rows that repeat a
page are each given its text; equal URLs are neighbours like others. Pages of any length are read whole. An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loglake.llm.shared import stored, table

#: A neighbour with more than this share of a page's words is a copy of it.
COPY_SHARE = 0.6
#: Neighbours looked at on either side, and pages compared by one group.
REACH = 2
GROUP_PAGES = 512
#: Cells of one alignment table kept at once, in bits; longer pairs of pages are split.
TABLE_BITS = 1 << 27

#: Elements by their part in a page.
_NO_TEXT = frozenset("script style noscript template iframe svg canvas object audio video title select textarea xmp noembed".split())
_RAW = re.compile(r"script|style|title|textarea|xmp|iframe|noembed|noscript|template", re.IGNORECASE)
_ASIDE = frozenset("nav footer aside form dialog menu button head".split())
_ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar footer cookie cookies consent notice popup modal newsletter subscribe share sharing social related comment "
    "comments disqus widget toolbar pagination contentinfo complementary search alert".split()
)
_HEADER_NAMES = frozenset("header masthead topbar".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BLOCKS = _HEADINGS | frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul "
    "option optgroup caption".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_WHOLE_PAGE = frozenset("html body article main".split())

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+[^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""",
    re.DOTALL,
)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z0-9]+")

#: Where a line stands.
PLAIN, ASIDE, MAIN, ARTICLE = range(4)
#: (place, elements, words) of a line.
Line = tuple[int, str, str]


class _Open:
    """An open element: its name, and what it makes of the lines inside."""

    __slots__ = ("aside", "header", "name", "place", "shown")

    def __init__(self, name: str, rest: str, above: _Open | None):
        self.name = name
        words: set[str] = set()
        if "=" in rest and name not in _WHOLE_PAGE:
            for _, a, b, c in _NAMED.findall(rest):
                words.update(_WORDS.findall((a or b or c).lower()))
        self.place = above.place if above else PLAIN
        if name == "article" or (name == "main" and self.place != ARTICLE):
            self.place = ARTICLE if name == "article" else MAIN
        self.aside = bool(above and above.aside) or name in _ASIDE or not words.isdisjoint(_ASIDE_NAMES)
        self.header = bool(above and above.header) or name == "header" or not words.isdisjoint(_HEADER_NAMES)
        self.shown = f"{above.shown}>{name}" if above and above.name not in ("html", "body") else name


def lines(html: str) -> list[Line]:
    """The lines of a page, one per block with text."""
    found: list[Line] = []
    stack: list[_Open] = []
    buffer: list[str] = []
    at = 0

    def flush() -> None:
        if not buffer:
            return
        words = " ".join("".join(buffer).split())
        buffer.clear()
        if not words:
            return
        top = next((e for e in reversed(stack) if e.name in _BLOCKS), None)
        inner = stack[-1] if stack else None
        if inner is None:
            found.append((PLAIN, "", words))
            return
        # A header names the page or, inside the article, holds its title.
        titled = inner.place != PLAIN and top is not None and top.name in _HEADINGS
        aside = inner.aside or (inner.header and not titled)
        found.append((ASIDE if aside else inner.place, top.shown if top else "", words))

    while at < len(html):
        tag = _MARKUP.search(html, at)
        until = tag.start() if tag else len(html)
        if until > at:
            text = html[at:until]
            buffer.append(unescape(text) if "&" in text else text)
        if not tag:
            break
        at = tag.end()
        name = tag["name"]
        if name is None:
            continue
        name = name.lower()
        if name in _BLOCKS:
            flush()
        if tag["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
        elif name in _NO_TEXT:
            if not tag["rest"].endswith("/") or _RAW.fullmatch(name):
                at = _past(html, at, name)
        elif name == "br":
            buffer.append(" ")
        elif name not in _VOID:
            if name in _BLOCKS:
                # A block ends an open paragraph and what inline elements were left open.
                while stack and (stack[-1].name == "p" or stack[-1].name not in _BLOCKS):
                    stack.pop()
            elif len(stack) > 1000:
                continue
            stack.append(_Open(name, tag["rest"], stack[-1] if stack else None))
    flush()
    return found


def _past(html: str, at: int, name: str) -> int:
    """Where an element without text ends."""
    end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.IGNORECASE).search(html, at)
    return end.end() if end else len(html)


def line_key(line: Line) -> int:
    """Equal for equal lines: elements alone where they name themselves aside, else elements and words."""
    place, elements, words = line
    raw = f"{elements}\n" if place == ASIDE else f"{elements}\n{words}"
    return xxhash.xxh64_intdigest(raw) - (1 << 63)


def main_text(found: Sequence[Line], shared: Sequence[int] = ()) -> str:
    """The lines that remain once shared ones are deleted, and the check by elements is made."""
    places = {line[0] for line in found}
    if ARTICLE in places or MAIN in places:
        best = ARTICLE if ARTICLE in places else MAIN
        return "\n".join(words for place, _, words in found if place == best)
    gone = set(shared)
    return "\n".join(words for i, (place, _, words) in enumerate(found) if place == PLAIN and i not in gone)


# --- alignment ------------------------------------------------------------------------------


def _rows(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Per line of ``a`` a row of bits over ``b``: a 0 wherever the longest common subsequence grows by one."""
    where: dict[int, int] = {}
    for j, key in enumerate(b):
        where[key] = where.get(key, 0) | 1 << j
    full, row, rows = (1 << len(b)) - 1, (1 << len(b)) - 1, []
    for key in a:
        hit = row & where.get(key, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    return rows


def _lengths(row: int, n: int) -> list[int]:
    out, length = [0], 0
    for bit in reversed(bin(row | 1 << n)[3:]):
        length += bit == "0"
        out.append(length)
    return out


def _last_row(a: Sequence[int], b: Sequence[int]) -> int:
    where: dict[int, int] = {}
    for j, key in enumerate(b):
        where[key] = where.get(key, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for key in a:
        hit = row & where.get(key, 0)
        row = ((row + hit) | (row - hit)) & full
    return row


def common(a: Sequence[int], b: Sequence[int], bits: int = TABLE_BITS) -> list[int]:
    """Places in ``a`` of a longest common subsequence of both, in memory of at most about ``bits``."""
    first, last_a, last_b = 0, len(a), len(b)
    while first < min(last_a, last_b) and a[first] == b[first]:
        first += 1
    while min(last_a, last_b) > first and a[last_a - 1] == b[last_b - 1]:
        last_a, last_b = last_a - 1, last_b - 1
    edges = [*range(first), *range(last_a, len(a))]
    both = set(a[first:last_a]) & set(b[first:last_b])
    places = [i for i in range(first, last_a) if a[i] in both]
    inner_a, inner_b = [a[i] for i in places], [k for k in b[first:last_b] if k in both]
    return sorted(edges + [places[i] for i in _inner(inner_a, inner_b, bits)])


def _inner(a: list[int], b: list[int], bits: int) -> list[int]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > bits:
        # Halve one side, and cut the other where both halves together have most in common.
        half = len(a) // 2
        ahead = _lengths(_last_row(a[:half], b), len(b))
        behind = _lengths(_last_row(a[half:][::-1], b[::-1]), len(b))[::-1]
        cut = max(range(len(b) + 1), key=lambda j: ahead[j] + behind[j])
        return _inner(a[:half], b[:cut], bits) + [half + i for i in _inner(a[half:], b[cut:], bits)]
    rows, out = _rows(a, b), []
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                out.append(i)
    return out[::-1]


# --- pairs ----------------------------------------------------------------------------------


def url_parts(url: str | None) -> tuple[str, str]:
    """Host and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest).group()
    return host.lower(), re.match(r"[^?#]*", rest[len(host) :]).group()


_NEIGHBOUR = "key string, host string, path string, lines array<bigint>, sizes array<int>"
_NEIGHBOUR_TYPES = pa.schema(
    [("key", pa.string()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))]
)


def _keyed(pages: DataFrame) -> DataFrame:
    html = F.coalesce(pages["html"], F.lit(""))
    whole = F.concat_ws("\n", pages["page_id"].cast("string"), F.coalesce(pages["url"], F.lit("")), html)
    return pages.select("page_id", "url", html.alias("html"), F.sha2(whole, 256).alias("key"))


def line_hashes(pages: DataFrame) -> DataFrame:
    """``(key, host, path, lines, sizes)`` of every page with a host: 12 bytes a line instead of the page."""

    def read(batches):
        for batch in batches:
            rows = []
            for key, url, html in zip(batch.column("key"), batch.column("url"), batch.column("html"), strict=True):
                host, path = url_parts(url.as_py())
                if host:
                    found = lines(html.as_py())
                    rows.append({
                        "key": key.as_py(), "host": host, "path": path, "lines": [line_key(x) for x in found],
                        "sizes": [0 if x[0] == ASIDE else len(x[2]) for x in found],
                    })
            yield pa.RecordBatch.from_pylist(rows, _NEIGHBOUR_TYPES)

    return _keyed(pages).select("key", "url", "html").mapInArrow(read, _NEIGHBOUR)


def _shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def shared_lines(page: dict, near: Sequence[tuple[int, dict]]) -> list[int]:
    """Places of a page's lines that its nearest neighbour shares; ``near`` holds (distance, page) of its host."""
    order = sorted(near, key=lambda x: (-_shared_prefix(page["path"], x[1]["path"]), abs(x[0]), x[0]))
    total = sum(page["sizes"])
    for _, other in order:
        places = common(page["lines"], other["lines"])
        if sum(page["sizes"][i] for i in places) <= COPY_SHARE * total:
            return places
    return []


def template_lines(hashes: DataFrame) -> DataFrame:
    """``(key, shared)``: per page the places of lines shared with the page of the nearest URL.

    Pages are numbered in the order of host and path; groups of consecutive numbers are compared together, with
    the first and last few pages of the groups next to them. A host of any size is so dealt evenly.
    """
    order = ["host", "path", "key"]
    distinct = hashes.dropDuplicates(["key"])
    ranged = distinct.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_pages = stored(
        ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "page-lines", "zstd"
    )
    # One row per partition.
    parts = sorted_pages.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    bases = parts.select("part", (F.coalesce(before, F.lit(0)) - F.col("least")).alias("base"))
    number = F.col("base") + F.col("at")
    placed = sorted_pages.join(bases, "part").withColumn("number", number).drop("part", "at", "base")
    group, place = F.floor(F.col("number") / GROUP_PAGES), F.col("number") % GROUP_PAGES
    groups = F.array(
        group, F.when(place < REACH, group - 1), F.when(place >= GROUP_PAGES - REACH, group + 1)
    )
    dealt = placed.withColumn("own", group).withColumn("group", F.explode(F.array_compact(groups)))

    def compare(batches):
        rows = (row for batch in batches for row in batch.to_pylist())
        for group, members in groupby(rows, key=lambda r: r["group"]):
            members = list(members)
            out = []
            for i, page in enumerate(members):
                if page["own"] == group:
                    near = [
                        (d, members[i + d])
                        for d in range(-REACH, REACH + 1)
                        if d and 0 <= i + d < len(members) and members[i + d]["host"] == page["host"]
                    ]
                    out.append((page["key"], shared_lines(page, near)))
            keys, shared = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(shared, pa.list_(pa.int32()))], ["key", "shared"])

    dealt = dealt.repartition("group").sortWithinPartitions("group", "number")
    return stored(dealt.mapInArrow(compare, "key string, shared array<int>"), "page-templates")


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` for every page."""
    found = template_lines(line_hashes(pages))

    def cut(batches):
        for batch in batches:
            shared = batch.column("shared")
            texts = [main_text(lines(html.as_py()), shared[i].as_py() or ()) for i, html in enumerate(batch.column("html"))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = _keyed(pages).join(found, "key", "left").select("page_id", "url", "html", "shared")
    kinds = dict(pages.dtypes)
    return rows.mapInArrow(cut, f"page_id {kinds['page_id']}, url string, text string")


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


#: For pages that mark their article by one element without others set aside in it, as those of the given tables do.
OP12_SQL = r"""
WITH inner_html AS (
    SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS inside FROM pages
), blocks AS (
    SELECT page_id, url, regexp_split_to_array(inside, '</?(?:p|h1|h2|h3|ul|ol|li|div)>') AS raw FROM inner_html
), texts AS (
    SELECT page_id, url, array_to_string(list_filter(list_transform(raw, lambda b: trim(regexp_replace(
        regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(
            b, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
            '&quot;?', '"', 'g'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'),
        '\s+', ' ', 'g'))), lambda b: b <> ''), chr(10)) AS text
    FROM blocks
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts
"""
