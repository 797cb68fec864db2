"""Main text of web pages by nearest-URL page differencing.

A page is read once into text lines (one for each block) that are inside an article or main element, open
(in the body at large), or of the frame: menus, headers, footers, sidebars, notices, adverts, forms and
reader comments by tag, role, class or id. An article or main element ends the frames by class, id or form
around it, which can be wrappers of the page, but not those of comments, teasers and adverts.

Pages are put in order of host and URL path and differenced with the neighbour on their host whose path is
nearest and that isn't a copy: all lines of the two, whatever their marks, are aligned by longest common
subsequence, and shared ones are deleted. A check follows, of what was deleted and of what is left.
Deleted lines come back where the neighbour says too little: a line of a marked article, which can be a
passage that two articles share, stays deleted only as part of elements with a class or id of their own, of
which all lines are shared with the neighbours on both sides (notices and adverts that no name tells); an
open line stays deleted unless the neighbour on the other side is in its folder and lacks it. The first and
the last page of a host have two neighbours on one side. Of the lines that are left those of the frame go
(menus that differ from page to page) and, where an article is marked, open ones."""

import hashlib
import html as entities
import os
import re
from bisect import bisect_left
from collections import deque
from itertools import chain
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._shared import save, session, slices, table

#: A page of which more than this part of the text is shared is a copy of its neighbour, which then tells nothing.
COPY = 0.8
#: Elements inside an article hold at most this part of it, or they aren't deleted.
PART = 0.5
#: Longest common subsequences of pages with more pairs of equal lines than this are found by bits.
PAIRS = 1 << 20
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""\b(class|id|role|itemprop|hidden)\b\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "title", "object", "canvas", "audio", "video", "math", "xmp", "noembed", "noframes"}
_RAW_END = {x: re.compile(rf"</{x}\b[^>]*>?", re.I) for x in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_FRAME = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "head", "fieldset"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "button", "head"}
_CLASSES = {
    "nav", "navbar", "navigation", "menu", "sidebar", "aside", "footer", "header", "masthead", "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent",
    "notice", "notices", "alert", "comment", "comments", "reply", "replies", "disqus", "social", "share", "sharing", "related", "breadcrumb", "breadcrumbs", "newsletter", "subscribe", "signup", "login", "search", "popup", "modal", "toolbar",
    "pagination", "pager", "copyright", "widget", "contentinfo", "complementary", "hidden",
}
FRAME, OPEN, INSIDE = 0, 1, 2
#: Elements that can be a notice or advert inside an article; headings, items, cells and quotes are its own.
_UNITS = {"div", "section", "p", "ul", "ol", "address"}
_DIGITS = re.compile(r"\d+")


#: First parts of a class name that tell of something else on the page, and parts that also name the head of an article.
_ABOUT = {"with", "without", "has", "have", "no", "is"}
_HEADS = {"header", "masthead", "banner"}
#: Frames that hold articles of their own (comments, teasers), so that an article within doesn't end them.
_HOLDERS = {"comment", "comments", "reply", "replies", "disqus", "related", "promo", "sponsor", "sponsored", "ad", "ads", "advert", "adverts", "advertisement", "widget"}
NO, SOFT, FIRM = 0, 1, 2


def _named(value: str, inside: bool) -> int:
    """How a class or id marks a frame. Outside articles a name counts as a whole or by its last part; what
    else holds such a part is left to the differencing. Inside, any part counts but those of an article's head."""
    found = NO
    for name in value.strip("\"'").lower().split():
        parts = [x for x in _SPLIT.split(name) if x]
        if not parts or parts[0] in _ABOUT:
            continue
        told = _CLASSES.intersection(parts if inside else parts[-1:])
        if inside and len(parts) > 1:
            told -= _HEADS
        if told:
            found = max(found, FIRM if not _HOLDERS.isdisjoint(told) else SOFT)
    return found


def _frame(name: str, attrs: str, inside: bool = False) -> int:
    """FIRM, SOFT (an article or main element within ends it) or NO."""
    if name in _FRAME:
        return SOFT if name == "form" else FIRM
    if not attrs or name in ("html", "body", "article", "main"):
        return NO
    found = NO
    for m in _ATTR.finditer(attrs):
        kind = m[1].lower()
        if kind in ("class", "id"):
            found = max(found, _named(m[2] or "", inside))
        elif kind == "hidden" and not m[2] or not _CLASSES.isdisjoint(_SPLIT.split((m[2] or "").lower())):
            return FIRM
    return found


def _unit(name: str, attrs: str) -> str:
    """What elements of one kind inside an article have in common: tag, class and id without digits; "" if they have neither."""
    if name not in _UNITS or not attrs:
        return ""
    told = [f"{m[1].lower()}={m[2]}" for m in _ATTR.finditer(attrs) if m[1].lower() in ("class", "id") and (m[2] or "").strip("\"'").strip()]
    return _DIGITS.sub("", " ".join([name, *told])) if told else ""


def lines(page: str) -> list[tuple[int, str]]:
    """(FRAME, OPEN or INSIDE, text) of each block that has text, in page order; linear in the page's length."""
    return [(kind, line) for kind, line, _ in blocks(page)]


def blocks(page: str) -> list[tuple[int, str, str]]:
    """The same with the innermost element inside the article that has a class or id of its own ("": none)."""
    out: list[tuple[int, str, str]] = []
    text: list[str] = []
    stack: list[str] = []
    frames: list[tuple[int, int]] = []
    insides: list[int] = []
    ended: list[int] = []  # articles that end the soft frames around them
    units: list[tuple[int, str]] = []

    def framed() -> bool:
        return bool(frames) and frames[-1][0] > (ended[-1] if ended else -1)

    def flush():
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            if line:
                out.append((FRAME if framed() else INSIDE if insides else OPEN, line, units[-1][1] if units else ""))
            text.clear()

    def pop(to: int):
        del stack[to:]
        while frames and frames[-1][0] >= to:
            frames.pop()
        while ended and ended[-1] >= to:
            ended.pop()
        while insides and insides[-1] >= to:
            insides.pop()
        while units and units[-1][0] >= to:
            units.pop()

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text.append(page[at:])
            break
        if lt > at:
            text.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        tag = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if not tag:
            text.append("<")
            at = lt + 1
            continue
        at, name = tag.end(), tag[2].lower()
        if tag[1]:
            if name in _BLOCK:
                flush()
            if name in stack:
                pop(len(stack) - 1 - stack[::-1].index(name))
            continue
        if name in _RAW:
            if not tag[3].endswith("/"):
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else n
            continue
        if name in _BLOCK:
            flush()
            if "p" in stack:
                pop(len(stack) - 1 - stack[::-1].index("p"))
        elif name == "br":
            text.append(" ")
        if name in _VOID or tag[3].endswith("/"):
            continue
        if name in ("li", "tr", "td", "th", "dd", "dt", "option") and stack and stack[-1] == name:
            pop(len(stack) - 1)
        how = _frame(name, tag[3], bool(insides))
        if how:
            frames.append((len(stack), how))
        elif name in ("article", "main"):
            if framed() and all(kind == SOFT for place, kind in frames if place > (ended[-1] if ended else -1)):
                ended.append(len(stack))
            insides.append(len(stack))
        elif insides and (unit := _unit(name, tag[3])):
            units.append((len(stack), unit))
        stack.append(name)
    flush()
    return out


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence of a and b (Hunt and Szymanski)."""
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    if sum(len(where.get(x, ())) for x in a) > PAIRS:
        return shared_by_bits(a, where, len(b))
    tails: list[int] = []
    ends: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(tails, j)
            link = (i, ends[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                ends.append(link)
            else:
                tails[k] = j
                ends[k] = link
    out, link = [], ends[-1] if ends else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def shared_by_bits(a: list[int], where: dict[int, list[int]], n: int) -> list[int]:
    """The same for lines that are repeated many times, a row of n bits for each line of a (Hyyro). Of the rows
    one in about a root of their number is kept, and those between are made again on the way back."""
    full = (1 << n) - 1
    kept: dict[int, int] = {}

    def mask(x: int) -> int:
        if x in kept:
            return kept[x]
        found = where.get(x, ())
        bits = bytearray(n // 8 + 1 if found else 0)
        for j in found:
            bits[j >> 3] |= 1 << (j & 7)
        made = int.from_bytes(bits, "little")
        if len(found) > 64:
            kept[x] = made
        return made

    def below(row: int, x: int) -> int:
        u = row & mask(x)
        return ((row + u) | (row - u)) & full

    step = max(1, int(len(a) ** 0.5))
    row, rows = full, []
    for i, x in enumerate(a):
        if i % step == 0:
            rows.append(row)
        row = below(row, x)
    out, at = [], n
    for start in range((len(rows) - 1) * step, -1, -step):
        part = [rows.pop()]
        for x in a[start : start + step]:
            part.append(below(part[-1], x))
        for i in range(len(part) - 2, -1, -1):
            at = (~part[i + 1] & ((1 << at) - 1)).bit_length()
            if not at:
                return out[::-1]
            if part[i] >> (at - 1) & 1:
                out.append(start + i)
                at -= 1
    return out[::-1]


def _hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode(errors="replace"), digest_size=8).digest(), "little", signed=True)


def _url(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").removeprefix("www."), parts.path
    except ValueError:
        return "", url or ""


def folder(path: str) -> str:
    return path.rstrip("/").rpartition("/")[0]


def gone_lines(path: str, mine: list[int], sizes: list[int], numbers: list[int], units: list[int], near: list[tuple[str, list[int]]]) -> list[int]:
    """Numbers of the text's lines that differencing deletes and the check doesn't bring back.

    mine, sizes: hashes and lengths of all lines of the page; numbers: their places in its text, -1 if they
    aren't part of it; units: -1 for open lines, 0 for lines of the article, above for its elements with a
    class or id; near: paths and lines of the neighbours, two at most."""
    text = [i for i, k in enumerate(numbers) if k >= 0]
    size = sum(sizes[i] for i in text)
    found = []
    for other, theirs in sorted(near, key=lambda x: -len(os.path.commonprefix([path, x[0]]))):
        shared = set(shared_lines(mine, theirs))
        if sum(sizes[i] for i in text if i in shared) <= COPY * size:
            found.append((other, shared))
    if not found:
        return []
    gone = [i for i in text if i in found[0][1]]
    marked = bool(gone) and units[gone[0]] >= 0
    if len(found) > 1 and (marked or folder(found[1][0]) == folder(path)):
        gone = [i for i in gone if i in found[1][1]]
    if marked:
        own = {0, *(units[i] for i in set(text).difference(gone))}
        gone = [i for i in gone if units[i] not in own]
        if len(found) < 2 or sum(sizes[i] for i in gone) > PART * size:
            return []
    return [numbers[i] for i in gone]


_PARSED = "id {0}, url string, host string, path string, lines array<string>, hashes array<long>, sizes array<int>, numbers array<int>, units array<int>"


def _parsed(batches):
    for batch in batches:
        for part in slices(batch, "html"):
            rows = []
            for url, page in zip(part.column("url").to_pylist(), part.column("html").to_pylist()):
                found = blocks(page or "")
                main = INSIDE if any(kind == INSIDE for kind, _, _ in found) else OPEN
                names = {"": 0} if main == INSIDE else {}
                text, numbers, units = [], [], []
                for kind, line, unit in found:
                    numbers.append(len(text) if kind == main else -1)
                    units.append(names.setdefault(unit, len(names)) if kind == main == INSIDE else -1)
                    if kind == main:
                        text.append(line)
                rows.append((*_url(url), text, [_hash(x) for _, x, _ in found], [len(x) for _, x, _ in found], numbers, units))
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["id", "url", "host", "path", "lines", "hashes", "sizes", "numbers", "units"])


def neighbours(host: str, around: list[tuple | None]) -> list[tuple[str, list[int]]]:
    """(path, hashes) of the pages before and after on the host, of (host, path, hashes, ...) two and one before, one and two
    after; the first and the last page of a host have two on one side."""
    two, one, next_, second = (x if x and x[0] == host else None for x in around)
    near = [x for x in (one, next_) if x]
    if len(near) == 1 and (far := two if one else second):
        near.append(far)
    return [(x[1], x[2]) for x in near]


_PAGE = ["host", "path", "hashes", "sizes", "numbers", "units"]
_DIFFERENCED = "key long, host string, path string, hashes array<long>, sizes array<int>, numbers array<int>, units array<int>, gone array<int>, part int, nth long"
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 4, pa.int32(), pa.int64()]


def _differenced(batches):
    """Differences the pages of a sorted partition. Its first and last two have neighbours in others and get no
    result (NULL); they and the two next to them keep their lines, other pages of which lines go only their result."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = [x.split()[0] for x in _DIFFERENCED.split(", ")]
    pages = (page for batch in batches for page in zip(*(batch.column(c).to_pylist() for c in (*_PAGE, "key"))))
    window, out = deque([None] * 4, 9), []

    def made():
        cols = list(zip(*out)) if out else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names)

    for n, page in enumerate(chain(pages, [None] * 4), -4):
        window.append(page)
        if n < 0:
            continue
        *mine, key = window[4]
        around = [window[i] for i in (2, 3, 5, 6)]
        gone = None if None in around else gone_lines(*mine[1:], neighbours(mine[0], around))
        edge = window[0] is None or window[8] is None
        out.append((key, *(mine if edge else [None] * len(mine)), gone, part, n))
        if len(out) == 2000:
            yield made()
            out.clear()
    yield made()


def _edges(batches):
    for batch in batches:
        out = []
        for key, around, *mine in zip(*(batch.column(c).to_pylist() for c in ("key", "around", *_PAGE))):
            at = {x["step"]: (x["host"], x["path"], x["hashes"]) for x in around}
            out.append((key, gone_lines(*mine[1:], neighbours(mine[0], [at.get(i) for i in (-2, -1, 1, 2)]))))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([g for _, g in out], pa.list_(pa.int32()))], ["key", "gone"])


def main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, url, text, n_chars), one row per row of pages, repeated rows too.

    text: the main text, "" if there is none or html is null; n_chars: its code points. Hosts are compared without "www."; a null or broken URL
    belongs to the host "". Pages with equal URL and lines are one page when neighbours are sought, whatever their ids; ties
    between two equally near neighbours go to the earlier. Other columns are not read.

    The text of every page is what differencing and its check leave of its lines.

    The order over all pages is a range-partitioned sort of line hashes, so that a host with a third of all
    pages is cut like any other. Pages are differenced where they are sorted; only the two at each end of a
    partition are joined by row numbers from partition counts. Texts are written once; they are shuffled only
    if the pages with lines to delete are too many to be sent to every task."""
    session(pages)
    kind = pages.schema[id_column].dataType.simpleString()
    src = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    parsed = save(src.mapInArrow(_parsed, _PARSED.format(kind)))
    key = F.xxhash64("url", F.array_join("lines", "\n"), "hashes", "numbers", "units")
    light = parsed.select(key.alias("key"), "host", "path", "hashes", "sizes", "numbers", "units").dropDuplicates(["key"])
    ordered = light.repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key")
    done = save(ordered.mapInArrow(_differenced, _DIFFERENCED))
    start, starts = 0, []
    for r in sorted(done.groupBy("part").count().collect()):
        starts.append((r["part"], start))
        start += r["count"]
    first = pages.sparkSession.createDataFrame(starts, "part int, start long")
    edges = done.where("hashes IS NOT NULL").join(F.broadcast(first), "part").withColumn("place", F.col("start") + F.col("nth"))
    steps = edges.where("gone IS NULL").select("key", *_PAGE, "place", F.explode(F.expr("array(-2, -1, 1, 2)")).alias("step"))
    near = edges.select("place", F.struct("host", "path", "hashes").alias("page"))
    met = steps.withColumn("place", F.col("place") + F.col("step")).join(near, "place").groupBy("key").agg(
        *(F.first(c).alias(c) for c in _PAGE), F.collect_list(F.struct("step", "page.host", "page.path", "page.hashes")).alias("around")
    )
    gone = save(done.select("key", "gone").unionByName(met.mapInArrow(_edges, "key long, gone array<int>")).where("size(gone) > 0"))
    left = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.array_contains("gone", i)))
    out = parsed.withColumn("key", key).join(gone, "key", "left").select("id", "url", F.array_join(left, " ").alias("text"))
    return out.select(F.col("id").alias(id_column), F.col("url").alias(url_column), "text", F.length("text").cast("long").alias("n_chars"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
