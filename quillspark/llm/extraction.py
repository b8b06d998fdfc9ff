"""HTML main text by nearest-URL page differencing.

Each page becomes lines (blocks of text). Pages of a host are put in the order of their URL paths; each is paired with the nearer of
the last page before and the first page behind whose lines aren't all the same as its own (longest common path, then the earlier one). The lines of a pair are aligned by a
longest common subsequence, and lines that both have are deleted: menus, notices and footers repeat from page to page. Two exact
rules on the markup go with it, since pages also share sentences and have boilerplate of their own, which no other page has: lines inside
an article or main element are never deleted by differencing, and are the whole text where there is such an element; lines inside
elements whose name or class marks them as boilerplate are dropped.

A host with more than its share of all pages is cut into ranges of path and id, so that no task holds a whole host. Each range is also
given the nearest different pages beyond its edges, found by a pass over such hosts before; so pairs don't depend on the cuts. Within a
part pages stream in order, and a run of pages with equal lines is held with the page before it.

Null html gives an empty text, a null url a host of its own. Repeated pages are copies, which are never differenced with each other.
An empty table gives an empty result. Whole pages are read. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.llm.common import SLICE_BYTES, sliced, written

#: A part of a host has about so many pages, or the PARTS-th of all pages where that is more; so there are PARTS heavy hosts at most.
PART_PAGES, PARTS = 500, 10_000

# Fixed values of HTML: elements by what they do to text.
RAW = "script|style|noscript|template|textarea|title|iframe|svg|select|object|xmp|noembed|noframes"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul".split())
SPACE = frozenset("br td th wbr img input button".split())
MAIN = frozenset(["article", "main"])
BOILERPLATE = frozenset("nav aside footer form head menu button dialog search audio video canvas datalist label".split())
#: Parts of class and id names, and roles, that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner banners cookie cookies consent gdpr notice notices alert "
    "alerts popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side widget widgets related recommended share sharing "
    "social footer masthead topbar comment comments commentlist reply replies discussion disqus respond pagination pager toolbar skip search complementary contentinfo navigation dialog".split()
)
#: Marks that are words of plain prose too: they count only in names made of marks and of such words for parts of a page alone.
WEAK = frozenset("side related recommended notice notices alert alerts share sharing search skip banner banners discussion reply replies promotion promoted widget widgets social subscribe dialog overlay popup".split())
PARTS_OF_PAGES = frozenset("area article articles bar block bottom box button buttons col column container content group icon icons inner item items left link links list main media page pane panel post posts right section site slot text title top unit wrap wrapper".split())
_CLOSED_BY_SAME = {"p": "p", "li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "option": "option", "td": "th", "th": "td"}

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>(?:.*?</(?P=raw)\s*>|.*\Z)|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>", re.S | re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?until)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)


@dataclass
class Line:
    text: str
    boilerplate: bool
    main: bool


def _marked(rest: str) -> bool:
    if "=" not in rest and "hidden" not in rest:
        return False
    for m in _NAMES.finditer(rest):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = {x.lower() for x in _PIECES.findall(name)}
            found = parts & MARKS
            if found and (found - WEAK or parts <= MARKS | PARTS_OF_PAGES):
                return True
    return bool(_HIDDEN.search(rest))


def lines_of(html: str | None) -> list[Line]:
    """The page's blocks of text in order, blanks collapsed, with what the markup says of them."""
    html, out, buffer, at = html or "", [], [], 0
    stack: list[tuple[str, bool, bool]] = []  # tag, inside boilerplate, inside main

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            _, drop, main = stack[-1] if stack else ("", False, False)
            out.append(Line(text, drop, main))

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            piece = html[at : m.start()]
            buffer.append(entities.unescape(piece) if "&" in piece else piece)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in SPACE:
            buffer.append(" ")
        if m["end"]:
            if tag in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag not in BLOCK and (stack[k][1], stack[k][2]) != (stack[-1][1], stack[-1][2]):
                        flush()
                    del stack[k:]
                    break
            continue
        if tag in VOID:
            if tag in BLOCK:
                flush()
            continue
        if tag in BLOCK:
            flush()
            same = _CLOSED_BY_SAME.get(tag)
            if stack and same and stack[-1][0] in (tag, same):
                stack.pop()
            elif tag in BLOCK and tag not in ("tr", "li", "option"):  # a block ends an open paragraph, with what is open inside it
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] in BLOCK:
                        break
        _, drop, main = stack[-1] if stack else ("", False, False)
        mark = tag in BOILERPLATE or (tag == "header" and not main) or (tag not in ("html", "body") and _marked(m["rest"]))
        if mark and not drop and tag not in BLOCK:
            flush()
        stack.append((tag, drop or mark, main or (tag in MAIN and not drop) or ("main" in m["rest"] and bool(re.search(r"role\s*=\s*[\"']?main\b", m["rest"], re.I)))))
    if at < len(html):
        buffer.append(entities.unescape(html[at:]))
    flush()
    return out


def common(a: list[int], b: list[int]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    both = set(a) & set(b)
    x, y = [(i, h) for i, h in enumerate(a) if h in both], [h for h in b if h in both]
    found, low = set(), 0
    while low < min(len(x), len(y)) and x[low][1] == y[low]:
        found.add(x[low][0])
        low += 1
    x, y = x[low:], y[low:]
    while x and y and x[-1][1] == y[-1]:
        found.add(x.pop()[0])
        y.pop()
    return found | _align(x, y)


def _align(x: list[tuple[int, int]], y: list[int]) -> set[int]:
    """By halves (Hirschberg), so that memory stays linear in the lines."""
    if not x or not y:
        return set()
    if len(x) == 1:
        return {x[0][0]} if x[0][1] in y else set()
    half = len(x) // 2
    left, right = lengths([h for _, h in x[:half]], y), lengths([h for _, h in x[half:]][::-1], y[::-1])
    cut = int(np.argmax(left + right[::-1]))
    return _align(x[:half], y[:cut]) | _align(x[half:], y[cut:])


def lengths(x: list[int], y: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of x with each prefix of y.

    One bit of a large integer stands for each line of y, and a line of x updates all of them by an addition, so that 64 comparisons are
    one step of the machine.
    """
    places: dict[int, list[int]] = {}
    for j, h in enumerate(y):
        places.setdefault(h, []).append(j)

    @lru_cache(maxsize=64)
    def matches(h: int) -> int:
        bits = np.zeros(len(y), np.uint8)
        bits[places[h]] = 1
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    full = (1 << len(y)) - 1
    open_ = full
    for h in x:
        if h in places:
            own = open_ & matches(h)
            open_ = ((open_ + own) | (open_ - own)) & full
    bits = np.unpackbits(np.frombuffer(open_.to_bytes(-(-len(y) // 8), "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


_HASHED = "keys array<bigint>, kinds binary, body binary"


def _nearness(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _kept(page: dict, near: dict | None) -> list[str]:
    """The lines that stay, after differencing and the rules on the markup."""
    texts = zlib.decompress(page["body"]).decode("utf-8", "surrogatepass").split("\n")
    kinds = page["kinds"]
    gone = common(page["keys"], near["keys"]) if near is not None else set()
    has_main = any(k & 2 for k in kinds)
    return [t for i, (t, k) in enumerate(zip(texts, kinds)) if not k & 1 and (k & 2 or not has_main and i not in gone)]


def _place(path: str, page_id: object) -> tuple:
    """A page's place in its host, in Spark's order: a null id comes first."""
    return path, page_id is not None, page_id


def _edges(light: DataFrame) -> DataFrame:
    """What a part of a host sees of the others: the last page before it and the first one behind it with other lines than its own edge.

    Of each part its first and last page count, and the first and last one that differ from these; the driver holds their hashes only,
    which are as many as parts.
    """
    c, spark = F.col, light.sparkSession
    light = written(light.withColumn("sig", F.xxhash64("keys", F.size("keys"))), "light")
    order, page = F.struct("path", "page_id", "url"), F.struct("path", "keys", "sig")
    outer = written(light.groupBy("host", "part").agg(F.min_by(page, order).alias("first"), F.max_by(page, order).alias("last")), "outer")
    known = outer.select(c("host").alias("h"), c("part").alias("p"), c("first.sig").alias("f"), c("last.sig").alias("l"))
    inner = light.join(F.broadcast(known), (c("host") == c("h")) & (c("part") == c("p"))).groupBy("host", "part")
    inner = inner.agg(F.min_by(page, F.when(c("sig") != c("f"), order)).alias("second"), F.max_by(page, F.when(c("sig") != c("l"), order)).alias("other"))
    ends = written(outer.join(inner, ["host", "part"]), "ends")
    names = ("first", "second", "last", "other")
    parts = ends.select("host", "part", *[c(f"{x}.sig").alias(x) for x in names]).collect()
    found = []
    for side, near, far, own in ((-1, "last", "other", "first"), (1, "first", "second", "last")):
        host = a = b = None  # (sig, part, end) of the nearest page so far, and of the nearest one that differs from it
        for r in sorted(parts, key=lambda r: (r["host"], -side * r["part"])):
            if r["host"] != host:
                host, a, b = r["host"], None, None
            seen = a if a is None or a[0] != r[own] else b
            if seen is not None:
                found.append((host, r["part"], side, seen[1], seen[2]))
            new = (r[near], r["part"], near)
            b = (r[far], r["part"], far) if r[far] is not None else a if a is not None and a[0] != new[0] else b
            a = new
    wanted = spark.createDataFrame(found, "host string, part int, side int, of int, end string")
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("end"), c(f"{x}.path").alias("path"), c(f"{x}.keys").alias("keys")) for x in names])).alias("x")
    long = ends.select(c("host").alias("h"), c("part").alias("p"), each).select("h", "p", "x.*").withColumnRenamed("end", "e")
    return long.join(F.broadcast(wanted), (c("h") == c("host")) & (c("p") == c("of")) & (c("e") == c("end"))).select("host", "part", "side", "path", "keys")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"), F.col(html).alias("html"))

    sizes = rows.groupBy("host").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    part = max(PART_PAGES, -(-total // PARTS))
    heavy = written(sizes.where(F.col("n") > part).select(F.col("host").alias("heavy_host")), "heavy")
    # About one page of each part is drawn as its start; the result doesn't depend on which.
    drawn = rows.select("host", "path", "page_id").join(F.broadcast(heavy), F.col("host") == F.col("heavy_host"), "left_semi").where(F.rand(7) * part < 1).collect()
    starts: dict[str, list[tuple]] = {}
    for r in drawn:
        starts.setdefault(r["host"], []).append(_place(r["path"], r["page_id"]))
    sent = spark.sparkContext.broadcast({h: sorted(x) for h, x in starts.items()})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = sent.value
        for batch in sliced(batches, 4):
            keys, kinds, bodies = [], [], []
            for page in batch.column(4).to_pylist():
                lines = lines_of(page)
                keys.append([xxhash.xxh3_64_intdigest(x.text.encode("utf-8", "surrogatepass")) - 2**63 for x in lines])
                kinds.append(bytes(x.boilerplate + 2 * x.main for x in lines))
                # Boilerplate takes part in the alignment by its hash alone.
                bodies.append(zlib.compress("\n".join("" if x.boilerplate else x.text for x in lines).encode("utf-8", "surrogatepass"), 1))
            ids, hosts, paths = (batch.column(k).to_pylist() for k in (0, 2, 3))
            parts = [bisect_right(starts[h], _place(p, i)) if h in starts else 0 for i, h, p in zip(ids, hosts, paths)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(keys, pa.list_(pa.int64())), pa.array(kinds, pa.binary()), pa.array(bodies, pa.binary()), pa.array(parts, pa.int32())], names=["page_id", "url", "host", "path", "keys", "kinds", "body", "part"])

    kind = rows.schema["page_id"].dataType.simpleString()
    parse = lambda pages: pages.mapInArrow(read, f"page_id {kind}, url string, host string, path string, {_HASHED}, part int")
    dealt = parse(rows).withColumn("side", F.lit(0))
    if starts:
        split = rows.join(F.broadcast(heavy), F.col("host") == F.col("heavy_host"), "left_semi")
        edges = _edges(parse(split).select("host", "part", "path", "page_id", "url", "keys"))
        absent = {"page_id": kind, "url": "string", "kinds": "binary", "body": "binary"}
        dealt = dealt.unionByName(edges.withColumns({k: F.lit(None).cast(t) for k, t in absent.items()}))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "host", "part").sortWithinPartitions("host", "part", "side", "path", "page_id", "url")

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pages: list[tuple[dict, list[str]]]) -> pa.RecordBatch:
            texts = ["\n\n".join(kept) for _, kept in pages]
            return pa.RecordBatch.from_arrays([pa.array([p["page_id"] for p, _ in pages], id_type), pa.array([p["url"] for p, _ in pages], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

        def paired(before: dict | None, run: list[dict], after: dict | None) -> Iterator[tuple[dict, list[str]]]:
            near = [x for x in (before, after) if x is not None]
            for page in run:
                if page["side"] == 0:
                    yield page, _kept(page, max(near, key=lambda x: _nearness(x["path"], page["path"]), default=None))

        def rows_of() -> Iterator[tuple[dict, list[str]]]:
            before, run, same = None, [], {}
            for batch in batches:
                for page in batch.to_pylist():
                    here = bool(run) and (run[0]["host"], run[0]["part"]) == (page["host"], page["part"])
                    if here and run[0]["keys"] == page["keys"]:
                        # Equal pages of a run share what they have in common, so that only their ids and urls add up.
                        page["keys"], body = run[0]["keys"], (page["kinds"], page["body"])
                        page["kinds"], page["body"] = same.setdefault(body, body)
                        run.append(page)
                        continue
                    yield from paired(before, run, page if here else None)
                    before, run, same = run[-1] if here else None, [page], {(page["kinds"], page["body"]): (page["kinds"], page["body"])}
            yield from paired(before, run, None)

        id_type, done, size = arrow_id, [], 0
        for row in rows_of():
            done.append(row)
            size += 100 + sum(map(len, row[1]))
            if size > SLICE_BYTES:
                yield out(done)
                done, size = [], 0
        yield out(done)

    arrow_id = to_arrow_type(rows.schema["page_id"].dataType)
    return dealt.mapInArrow(difference, f"page_id {kind}, url string, text string, n_chars bigint")
