"""Main text of HTML pages by nearest-URL page differencing.

Pages stand in the order of (host, path, id). Each page is paired with the nearest pages of its host before and
after it whose lines are not its own, the one whose path shares the longer prefix with its own first. All text
lines of both, the frame's too, are aligned by longest common subsequence, and lines that align are the site's
frame and go. The result is the same however the rows are dealt: pages are parsed twice, first for a digest of
their lines only, from which the bounds of the ranges are taken, and the pages that stand next to a bound are also
sent to the range beside. What the driver holds of this is a few keys for each range; there are at most MOST_RANGES,
however many pages, as a range is walked page by page and may be of any size.

Differencing alone can't tell a paragraph that two articles share from a menu that two pages share, nor an advert
that only one page has. So the mark-up has a say on the rest: what it names as frame (navigation, page headers,
footers, asides, forms, adverts, notices, reader comments) goes even if no neighbour has it, and if a page has an
article (or main), the rest of the page is frame. Inside an article a line that aligns stays if the mark-up calls
it text (a paragraph, heading or table row), however short it is and however many neighbours have it.
A neighbour that shares the article's h1 or a line of LONG words or more in it tells the same story; the lines it
shares say nothing about the frame, so only the other neighbour counts, if any.
An element of the frame ends with its own end tag; without one, before the next block that is no list
or with its parent. Void elements are never frame. Inside an article whole class names and roles
count, parts of them and ids don't, and an inline element never cuts a paragraph.

Nulls and ties: a null page is empty; a page without URL has no partner; pages of the same URL are
neighbours. A partner that has all lines of a page doesn't count. Ids of any type, null too, come back as they were.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tidemark.llm.common import short_batches, spread, staged

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)>""", re.S)
NAMES = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "object", "select"))
#: What follows their start tag is code up to the page's end if they have no end tag.
CODE = frozenset(("script", "style"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Attributes of a tag like <nav/>, which holds nothing; not of <nav class=a/>.
EMPTY = re.compile(r"""(?:^|[\s"'])/\Z""")
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody thead tfoot tr ul caption".split()
)
#: Elements and words in class, id or role that mark the frame of a page.
FRAME_TAGS = frozenset(("nav", "aside", "footer", "form", "header", "button", "dialog", "menu"))
FRAME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo cookie cookies consent notice notices alert popup modal sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead topbar comment comments disqus replies responses share sharing social related recommended subscribe newsletter login signup search toolbar widget pagination pager".split()
)
HEADER_WORDS = frozenset(("header",))
SPACES = re.compile(r"[\s_-]+")
#: Elements whose end tag may be missing: the next of their kind ends them, or a block, or their parent.
LOOSE = frozenset(("p", "li", "dt", "dd", "tr", "td", "th"))
#: Pages tell the same story if they share an article's line of so many words.
LONG = 20
#: So the driver never holds more than four keys for each of these.
MOST_RANGES = 20_000
#: Tables of so many cells are kept whole.
SMALL = 1 << 22
#: Blocks whose lines are text by their mark-up.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre tr dd figcaption".split())
#: Where a line stands: in an element of the frame, outside articles, inside one, inside one in a block of PROSE, in its h1.
FRAME, OUTSIDE, INSIDE, TEXT, TITLE = -1, 0, 1, 2, 3
LISTS = frozenset(("ul", "ol", "li", "dl", "dt", "dd"))
TABLE = frozenset(("table", "caption", "tbody", "thead", "tfoot", "tr", "td", "th"))
#: Where the search for an open element stops: at any of SPECIAL for an inline element, at SCOPE for others.
SPECIAL = BLOCKS | {"td", "th", "menu", "button"}
SCOPE = frozenset(("table", "caption", "td", "th"))
#: The open elements that a start tag ends, and where the search for them stops.
SIBLINGS = (
    {"li": (frozenset(("li",)), BLOCKS - {"address", "div", "p"})}
    | dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), BLOCKS - {"address", "div", "p"}))
    | dict.fromkeys(("td", "th"), (frozenset(("td", "th")), frozenset(("tr", "table"))))
    | {"tr": (frozenset(("tr",)), frozenset(("table",)))}
    | dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset(("tbody", "thead", "tfoot")), frozenset(("table",))))
)


def frame(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in FRAME_TAGS and not (inside_article and tag == "header"):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    names = [(m[1].lower(), (m[2] or m[3] or m[4] or "").lower()) for m in NAMES.finditer(attributes)]
    if inside_article:  # ids are anchors there, and parts of names say what a section is about
        return any(not FRAME_WORDS.isdisjoint(x.split()) for k, x in names if k != "id")
    words = {w for _, x in names for w in SPACES.split(x)}
    return not FRAME_WORDS.isdisjoint(words) or not HEADER_WORDS.isdisjoint(words)


def tokens_of(page: str) -> list[tuple[str, str, bool, str]]:
    """(text before, tag, whether it is an end tag, attributes) of each tag, then the last text. Raw elements that end are left out."""
    out, text, at = [], "", 0
    while m := TOKEN.search(page, at):
        text += page[at : m.start()]
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW:
            if closing or EMPTY.search(m[3]):
                continue
            if end := re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at):
                at = end.end()
                continue
            if tag in CODE:
                at = len(page)
                break
        out.append((text, tag, closing, m[3]))
        text = ""
    return [*out, (text + page[at:], "", False, "")]


def ends_of(tokens: list[tuple[str, str, bool, str]]) -> dict[int, tuple[int, int]]:
    """From the number of each start tag to those of the first tag outside its element and of the tag that ends its text.

    A loose element (LOOSE) ends before the next of its kind or with its parent, any other with its own end tag. If it has
    none it ends before the next block that is no list, or with its parent: what else follows is not known to be its own.
    """
    ends: dict[int, tuple[int, int]] = {}
    stack: list[tuple[str, int]] = []
    number: Counter[str] = Counter()  # of open elements of a name
    last: dict[int, int] = {}  # where unended elements must end
    plain = [i for i, (_, tag, closing, _) in enumerate(tokens) if tag in BLOCKS and tag not in LISTS and not closing]

    def close(names: frozenset[str], stops: frozenset[str], i: int, own: bool) -> None:
        if not any(number[x] for x in names):
            return
        k = len(stack) - 1
        while k >= 0 and stack[k][0] not in names:
            if stack[k][0] in stops:
                return
            k -= 1
        for name, j in stack[k:] if k >= 0 else ():
            number[name] -= 1
            last[j] = i
        if k >= 0:
            if own:
                ends[stack[k][1]] = (i + 1, i)
            del stack[k:]

    for i, (_, tag, closing, attributes) in enumerate(tokens):
        if not tag or tag in VOID and closing:
            continue
        if closing:
            close(frozenset((tag,)), frozenset(("table",)) if tag in TABLE else SCOPE if tag in SPECIAL else SPECIAL, i, True)
            continue
        if tag in BLOCKS:
            close(frozenset(("p",)), SCOPE, i, False)
        if tag in SIBLINGS:
            close(*SIBLINGS[tag], i, False)
        if tag not in VOID and not EMPTY.search(attributes):
            stack.append((tag, i))
            number[tag] += 1
    for i, (_, tag, closing, attributes) in enumerate(tokens):
        if tag and not closing and i not in ends:
            end = last.get(i, len(tokens))
            if tag not in LOOSE:
                k = bisect_right(plain, i)
                end = min(end, plain[k] if k < len(plain) else end)
            ends[i] = (end, end)
    return ends


def lines_of(page: str) -> tuple[list[tuple[str, int]], bool]:
    """The page's text lines, each with where it stands (FRAME to TITLE); whether there is an article."""
    out: list[tuple[str, int]] = []
    words: list[str] = []
    articles = until = 0  # until: the first tag outside the element of the frame that is open
    hidden = main = -1  # the last tag before which text is in that element, and in an element whose role is main
    any_article, block, at = False, "", 0  # block: the one that began last, if it is open
    tokens = tokens_of(page)
    ends = ends_of(tokens)

    def end_line() -> None:
        if words:
            if line := " ".join(html.unescape("".join(words)).split()):
                out.append((line, FRAME if at <= hidden else OUTSIDE if not articles and at > main else TITLE if block == "h1" else TEXT if block in PROSE else INSIDE))
            words.clear()

    for at, (text, tag, closing, attributes) in enumerate(tokens):  # noqa: B007
        if text:
            words.append(text)
        if at == hidden or at < hidden and tag in BLOCKS:
            end_line()
        if at < until or not tag:
            continue
        if tag in BLOCKS:
            end_line()
            block = "" if closing else tag
        elif tag in ("br", "td", "th"):
            words.append(" ")
        #: An article within or after another may be frame, as a reader's comment is.
        comment = tag == "article" and any_article and not closing and frame(tag, attributes, True)
        inline = (articles or at <= main) and block in PROSE and tag not in BLOCKS and tag not in FRAME_TAGS and tag not in RAW
        if not comment and tag in ("article", "main"):
            articles = max(0, articles - 1) if closing else articles + 1
            any_article = True
        elif not comment and not closing and attributes and tag in BLOCKS and re.search(r"""\brole\s*=\s*["']?(?:main|article)\b""", attributes, re.I):
            any_article, main = True, max(main, ends[at][1])
        elif not closing and tag not in VOID and not inline and not EMPTY.search(attributes) and (comment or tag in RAW or frame(tag, attributes, articles > 0 or at <= main)):
            end_line()
            until, hidden = ends[at]
    at = len(tokens)
    end_line()
    return out, any_article


def alignment(a: list[str], b: list[str]) -> list[int]:
    """Positions in a of a longest common subsequence of a and b.

    A row of the table of lengths is the bits of a whole number: bit j is off where b[j] adds to the length. Small tables
    are walked back from their end; large ones are halved where the halves' lengths add up to most, so memory is linear.
    """
    if not a or not b:
        return []
    full = (1 << len(b)) - 1

    def rows(left: list[str], right: list[str]) -> list[int] | int:
        where: dict[str, int] = {}
        for j, x in enumerate(right):
            where[x] = where.get(x, 0) | 1 << j
        row, out = full, [full]
        for x in left:
            both = row & where.get(x, 0)
            row = (row + both | row - both) & full
            if small:
                out.append(row)
        return out if small else row

    small = len(a) * len(b) <= SMALL or len(a) == 1
    if small:
        table, found, i, j = rows(a, b), [], len(a), len(b)
        length = lambda i, j: (~table[i] & (1 << j) - 1).bit_count()
        while i and j:
            here = length(i, j)
            if length(i - 1, j) == here:
                i -= 1
            elif length(i, j - 1) == here:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append(i)
        return found[::-1]
    half = len(a) // 2
    lengths = lambda row: [0, *accumulate(x == "0" for x in f"{row:0{len(b)}b}"[::-1])]
    ahead, behind = lengths(rows(a[:half], b)), lengths(rows(a[half:][::-1], b[::-1]))[::-1]
    cut = max(range(len(b) + 1), key=lambda j: ahead[j] + behind[j])
    return [*alignment(a[:half], b[:cut]), *[half + i for i in alignment(a[half:], b[cut:])]]


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of a longest common subsequence of lines. Lines that the other page hasn't are left out first."""
    in_a, in_b = set(a), set(b)
    places, right = [i for i, x in enumerate(a) if x in in_b], [x for x in b if x in in_a]
    left = [a[i] for i in places]
    most = min(len(left), len(right))
    head = next((k for k in range(most) if left[k] != right[k]), most)
    tail = next((k for k in range(most - head) if left[-1 - k] != right[-1 - k]), most - head)
    middle = alignment(left[head : len(left) - tail], right[head : len(right) - tail])
    return {*places[:head], *places[len(places) - tail :], *[places[head + i] for i in middle]}


Page = tuple[list[tuple[str, int]], bool]


def main_text(own: Page, *partners: Page) -> tuple[str, int, int]:
    """What stays of a page, and how many lines went because they align and because of the mark-up alone; its partners, the nearest first."""
    lines, has_article = own
    shared = [c for c in (common_lines([x for x, _ in lines], [x for x, _ in p[0]]) for p in partners[: 2 if has_article else 1]) if len(c) < len(lines)]
    if has_article:
        shared = [c for c in shared if not any(lines[i][1] == TITLE or lines[i][1] > OUTSIDE and len(lines[i][0].split()) >= LONG for i in c)]
    near = shared[0] if shared else set()
    gone = {k for k in near if lines[k][1] not in (TEXT, TITLE)}
    named = {k for k, (_, place) in enumerate(lines) if k not in gone and (place == FRAME or place == OUTSIDE and has_article)}
    return "\n\n".join(x for k, (x, _) in enumerate(lines) if k not in gone and k not in named), len(gone), len(named)


def prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


ORDER = ("host", "path", "id", "html_hash")
KEY = "host string, path string, id string, html_hash long"


def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The keys of ORDER of each page, with a hash of its lines."""
    for b in batches:
        yield b[[*ORDER]].assign(lines_hash=[xxhash.xxh64_intdigest(repr(lines_of(page))) - (1 << 63) for page in b["html"]])


def ends_of_range(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a sorted range of keys: the first page of its first and second run of pages with the same lines, and the last page of its last and last but one."""
    rows = [p for p in parts if len(p)]
    if not rows:
        return
    rows = pd.concat(rows, ignore_index=True)
    heads = [0, *(rows.index[1:][((rows["host"] != rows["host"].shift()) | (rows["lines_hash"] != rows["lines_hash"].shift()))[1:]]).tolist()]
    ends = [*[k - 1 for k in heads[1:]], len(rows) - 1]
    picked = rows.loc[[*heads[:2], *ends[-2:][::-1]]]
    yield picked.assign(place=[f"first{k}" for k in range(len(heads[:2]))] + [f"last{k}" for k in range(len(ends[-2:]))], bound="\0".join(map(str, rows.loc[0, [*ORDER]])))


def bounds_and_halos(keys: DataFrame, ranges: int) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """The first key of each range, in order; and for keys that a neighbouring range needs too, the numbers of those ranges."""
    kind = f"{KEY}, lines_hash long, place string, bound string"
    at = keys.repartitionByRange(ranges, *ORDER).sortWithinPartitions(*ORDER).mapInPandas(ends_of_range, kind)
    found: dict[str, dict[str, tuple]] = {}
    for r in at.collect():  # at most four rows for each range
        found.setdefault(r["bound"], {})[r["place"]] = (tuple(r[c] for c in ORDER), r["lines_hash"])
    parts = sorted(found.values(), key=lambda x: x["first0"][0])
    halos: dict[tuple, list[int]] = {}

    def look(order: range, edge: str, others: str) -> None:
        """For each range, in order, the nearest page behind its edge that is of the edge's host and has other lines. A range that is one run like the edge's passes on what it found itself."""
        found: tuple | None = None
        for k, q in zip(order[1:], order):
            (host, *_), lines = parts[k][edge]
            last, second = parts[q][f"{others}0"], parts[q].get(f"{others}1")
            if last[0][0] != host:
                found = None
            elif last[1] != lines:
                found = last[0]
            elif second:
                found = second[0] if second[0][0] == host else None
            if found:
                halos.setdefault(found, []).append(k)

    look(range(len(parts)), "first0", "last")
    look(range(len(parts))[::-1], "last0", "first")
    return [p["first0"][0] for p in parts], halos


def differenced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walks a task's ranges in order, neighbours of a host with the same lines as one run, with the run before and the run after at hand."""
    before = here = None  # (range and host, path of the last page, lines, (id, url, path) of each page to return)

    def results(after):
        host, _, own, pages = here
        near = [x for x in (before, after) if x is not None and host[1] and x[0] == host]
        for key, url, path in pages:
            nearest = sorted(near, key=lambda x: -prefix(x[1], path))
            yield (key, url, *main_text(own, *[x[2] for x in nearest]))

    columns = ["id", "url", "text", "n_shared", "n_marked"]
    for b in batches:
        out = []
        for key, url, number, halo, host, path, page in zip(b["id"], b["url"], b["range"], b["halo"], b["host"], b["path"], b["html"], strict=True):
            own, row = lines_of(page), [] if halo else [(key, url, path)]
            if here is not None and here[0] == (number, host) and here[2] == own:
                here = (here[0], path, own, here[3])
                here[3].extend(row)
                continue
            after = ((number, host), path, own, row)
            if here is not None:
                out += results(after)
                here = (*here[:3], [])
            before, here = here, after
        if out:
            yield pd.DataFrame(out, columns=columns)
    if here is not None and here[3]:
        yield pd.DataFrame(list(results(None)), columns=columns)


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", per_task: int = 5_000) -> DataFrame:
    """page_id, url and text of every page, n_shared (lines that differencing deleted) and n_marked (lines that only the mark-up did)."""
    spark = pages.sparkSession
    short_batches(spark, 200)
    kind = pages.schema[id_col].dataType
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    #: An id travels as a string with a mark, so that null and every whole number come back as they were.
    name = F.coalesce(F.concat(F.lit("+"), F.col(id_col).cast("string")), F.lit("-"))
    html_ = F.coalesce(F.col(html_col), F.lit(""))
    cut = pages.select(name.alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"), F.xxhash64(html_).alias("html_hash"), html_.alias("html"))
    keys = staged(cut.select(*ORDER, "html").mapInPandas(digests, f"{KEY}, lines_hash long"))
    n = min(spread(spark, keys.count(), per_task), MOST_RANGES)
    bounds, halos = bounds_and_halos(keys, n)

    @F.pandas_udf(ArrayType(IntegerType()))
    def ranges(host: pd.Series, path: pd.Series, key: pd.Series, html_hash: pd.Series) -> pd.Series:
        """A page's own range first, then those that need it as a neighbour."""
        rows = list(zip(host, path, key, html_hash, strict=True))
        return pd.Series([[bisect_right(bounds, r) - 1, *halos.get(r, ())] for r in rows], dtype="object")

    dealt = cut.select("*", F.posexplode(ranges(*ORDER)).alias("halo", "range")).withColumn("halo", F.col("halo") > 0)
    ordered = dealt.repartition(n, "range").sortWithinPartitions("range", *ORDER).select("id", "url", "range", "halo", "host", "path", "html")
    out = ordered.mapInPandas(differenced, "id string, url string, text string, n_shared long, n_marked long")
    key = F.when(F.col("id") != "-", F.expr("substring(id, 2)")).cast(kind)
    return out.select(key.alias("page_id"), "url", "text", "n_shared", "n_marked")
