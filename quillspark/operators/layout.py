"""Positioned text of pages: items to runs and lines, footers, markers, columns and sections.

Items are (doc, page, i, x, w, h, baseline, str): i is their order on the page. Work is done by document and page, which are small and many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.classify import first_match
from quillspark.operators.study import anchored
from quillspark.staging import staged

# Shares of a page's height, tolerances, and the patterns of markers in normalised text.
FOOTER_ZONE, FOOTER_DEFAULT, RIGHT_COLUMN, MARKER_HEIGHT = 0.86, 0.93, 0.4, 0.95
MARKERS = [
    ("QUESTIONARIO DE PERCEPCAO", "end"),
    (r"^QUESTAO DISCURSIVA\s*(\d{1,2})?\b", "essay"),
    (r"^QUESTAO\s+(\d{1,2})\b", "objective"),
    (r"^TEXTO PARA (?:(?:AS )?QUESTO?E?S?|(?:A )?QUESTAO)\s+(.+)$", "shared"),
    (r"^AREA LIVRE\b|^RASCUNHO\b", "stop"),
]


def positioned(items: DataFrame) -> DataFrame:
    """Items that aren't blank, with their top and bottom."""
    return items.where(F.col("str").rlike(r"\S")).withColumn("top", F.col("baseline") - 0.9 * F.col("h")).withColumn("bottom", F.col("baseline") + 0.25 * F.col("h"))


def _on_line() -> Window:
    return Window.partitionBy("doc", "page", "baseline").orderBy("x", "i")


def runs(items: DataFrame) -> DataFrame:
    """doc, page, baseline, run, n, x0 and x1: a new run begins where the gap is at least max(3, 0.7 of the incoming item's height)."""
    end = F.lag(F.col("x") + F.col("w")).over(_on_line())
    new = F.coalesce((F.col("x") - end >= F.greatest(F.lit(3.0), 0.7 * F.col("h"))).cast("int"), F.lit(1))
    rows = items.withColumn("new", new).withColumn("run", F.sum("new").over(_on_line()))
    return rows.groupBy("doc", "page", "baseline", "run").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"))


def joined(items: DataFrame) -> DataFrame:
    """doc, page, baseline and text: items from left to right, with a blank where there is a visible gap and none yet."""
    line = _on_line()
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(line) > 0.15 * F.col("h")
    blank = F.endswith(F.lag("str").over(line), F.lit(" ")) | F.startswith(F.col("str"), F.lit(" "))
    pieces = items.withColumn("piece", F.concat(F.when(gap & ~blank, " ").otherwise(""), F.col("str")))
    each = F.sort_array(F.collect_list(F.struct("x", "i", "piece")))
    return pieces.groupBy("doc", "page", "baseline").agg(each.alias("p")).select("doc", "page", "baseline", T.squeeze(F.array_join(F.transform("p", lambda p: p["piece"]), "")).alias("text"))


def page_heights(items: DataFrame) -> DataFrame:
    """doc, page, h and n: how many items of each height a page has; of heights there are few."""
    return items.groupBy("doc", "page", "h").agg(F.count("*").alias("n"))


def frames(items: DataFrame, height: float, heights: DataFrame | None = None) -> DataFrame:
    """doc, page, footer_top and footer_text: footers are elements of the lower zone that repeat, by text without digits and by place, on
    at least three pages and a quarter of the document's. With ``heights`` (``page_heights``) the items need not be more than the low ones."""
    signature = F.left(F.regexp_replace(T.marker_norm(F.col("str")), r"[0-9\s]", ""), F.lit(30))
    low = items.where(F.col("top") >= FOOTER_ZONE * height).withColumn("signature", signature).withColumn("place", T.round_half_up(F.col("top") / 4))
    pages = (items if heights is None else heights).select("doc", "page").distinct()
    many = pages.groupBy("doc").agg(F.count("*").alias("pages"))
    often = low.groupBy("doc", "signature", "place").agg(F.countDistinct("page").alias("n")).join(many, "doc").where(F.col("n") >= F.greatest(F.lit(3.0), 0.25 * F.col("pages")))
    feet = low.join(often.select("doc", "signature", "place"), ["doc", "signature", "place"])
    texts = F.transform(F.sort_array(F.collect_list(F.struct("i", "str"))), lambda x: x["str"])
    feet = feet.groupBy("doc", "page").agg((F.min("top") - 3).alias("top"), F.array_join(texts, " ").alias("footer_text"))
    return pages.join(feet, ["doc", "page"], "left").select("doc", "page", F.coalesce("top", F.lit(FOOTER_DEFAULT * height)).alias("footer_top"), F.coalesce("footer_text", F.lit("")).alias("footer_text"))


def median_height(heights: DataFrame) -> DataFrame:
    """doc and body: the upper median of the items' heights, from ``page_heights``."""
    counts = heights.groupBy("doc", "h").agg(F.sum("n").alias("n"))
    upward = Window.partitionBy("doc").orderBy("h")
    counts = counts.withColumn("upto", F.sum("n").over(upward)).withColumn("all", F.sum("n").over(Window.partitionBy("doc")))
    return counts.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("doc").agg(F.min("h").alias("body"))


def markers(items: DataFrame, height: float, framed: DataFrame | None = None, decode: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc, page, i, x, top, kind, num and nums of the marker items above the footers; headings of small print don't count.

    ``framed`` are the frames where the caller has them. With ``decode``, an item that is no marker is looked at once more in its decoded
    form: a short heading may be in glyph ids although its font wasn't decoded on the page.
    """
    return framed_markers(items, height, framed, decode)[1]


def framed_markers(items: DataFrame, height: float, framed: DataFrame | None = None, decode: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Staged frames, and ``markers``. The items are gone through twice, for their heights and for the few that matter."""
    norm = F.col("norm") if "norm" in items.columns else T.marker_norm(F.col("str"))
    heights = staged(page_heights(items))
    # Every marker's norm has one of these words; for text in ASCII that shows without its norm.
    has = lambda text: reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in ("QUEST", "TEXTO", "AREA", "RASCUNHO")])
    may = lambda text: (F.octet_length(text) != F.length(text)) | has(F.upper(text))
    told = lambda n: F.struct(n.alias("norm"), F.when(has(n), first_match(n, MARKERS)).alias("kind"))
    found = T.let(norm, told) if "norm" in items.columns else F.when(may(F.col("str")), T.let(norm, told))
    if decode is not None:
        again = T.let(decode(F.col("str")), lambda text: F.when(may(text), T.let(T.marker_norm(text), told)))
        found = T.let(found, lambda m: F.when(m["kind"].isNotNull(), m).otherwise(again))
    # Markers and low items are few; they are told apart once and staged, and the items aren't gone through again.
    low = F.col("top") >= FOOTER_ZONE * height
    few = items.withColumn("m", found).where(F.col("m.kind").isNotNull() | low) if framed is None else items.withColumn("m", found).where(F.col("m.kind").isNotNull())
    few = staged(few.select("doc", "page", "i", "x", "h", "top", "str", "m.norm", "m.kind"))
    framed = staged(frames(few, height, heights)) if framed is None else framed
    rows = few.where("kind IS NOT NULL").join(framed, ["doc", "page"]).join(median_height(heights), "doc")
    rows = rows.where((F.col("top") < F.col("footer_top")) & (F.col("kind").isin("stop", "end") | (F.col("h") >= MARKER_HEIGHT * F.col("body"))))
    pattern = {kind: p for p, kind in MARKERS}
    num = F.when(F.col("kind") == "essay", F.regexp_extract("norm", pattern["essay"], 1)).when(F.col("kind") == "objective", F.regexp_extract("norm", pattern["objective"], 1))
    nums = F.when(F.col("kind") == "shared", T.number_list(F.regexp_extract("norm", pattern["shared"], 1)))
    return framed, rows.select("doc", "page", "i", "x", "top", "kind", num.try_cast("int").alias("num"), nums.alias("nums"))


def columns(found: DataFrame, width: float) -> DataFrame:
    """doc, page and split: where the right column begins, null for pages of one column."""
    right = ~F.col("kind").isin("stop", "end") & (F.col("x") > RIGHT_COLUMN * width)
    return found.groupBy("doc", "page").agg((F.min(F.when(right, F.col("x"))) - 8).alias("split"))


def margins(found: DataFrame) -> DataFrame:
    """doc, left_margin and content_top, from the markers that open blocks; a document without them has 0 for both."""
    opens = ~F.col("kind").isin("stop", "end")
    low = lambda c, less: F.coalesce(F.min(F.when(opens, F.col(c))) - less, F.lit(0.0))
    return found.groupBy("doc").agg(low("x", 8).alias("left_margin"), low("top", 4).alias("content_top"))


def cover_ranges(text: Column) -> Column:
    """A struct of specific_from, specific_to and essays from a cover's normalised text; null where it has no table.

    The specific part begins where its range says, or behind the range of the general part.
    """
    own, both = r"COMPONENTE ESPECIFICO(?: DA AREA)?[:/]?\s*", r"(\d{1,2})\s*A\s*(\d{1,2})"
    specific = lambda k: F.regexp_extract(text, rf"{own}OBJETIVAS\s+{both}", k).try_cast("int")
    general = F.regexp_extract(text, rf"FORMACAO GERAL[:/]?\s*OBJETIVAS\s+{both}", 2).try_cast("int")
    essay = lambda k: F.regexp_extract(text, rf"{own}DISCURSIVAS?\s+D(\d)(?:\s*A\s*D(\d))?", k).try_cast("int")
    first, last = essay(1), F.coalesce(essay(2), essay(1))
    essays = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    begin = F.coalesce(specific(1), general + 1)
    return F.when(begin.isNotNull(), F.struct(begin.alias("specific_from"), specific(2).alias("specific_to"), essays.alias("essays")))


def sections(found: DataFrame, pages: DataFrame, covers: DataFrame) -> DataFrame:
    """doc, page, i, kind, num and section of the opening markers."""
    return sectioned(found.where(~F.col("kind").isin("stop", "end")), pages, covers).select("doc", "page", "i", "kind", "num", "section")


def sectioned(found: DataFrame, pages: DataFrame, covers: DataFrame) -> DataFrame:
    """Rows that open blocks with their section: by the footer of their page where any footer of the document names the general part, else
    by the cover's ranges, else specific. ``covers`` has doc and cover."""
    general = F.contains(F.regexp_replace(T.marker_norm(F.col("footer_text")), r"\s", ""), F.lit("FORMACAOGERAL"))
    marked = pages.select("doc", "page", general.alias("general"))
    named = marked.groupBy("doc").agg(F.bool_or("general").alias("named"))
    rows = found.join(marked, ["doc", "page"]).join(named, "doc").join(covers, "doc", "left")
    cover, start = F.col("cover"), F.col("cover.specific_from")
    by_cover = F.when(F.col("kind") == "essay", F.array_contains(cover["essays"], F.col("num"))).when(F.col("kind") == "objective", F.col("num") >= start).otherwise(F.array_min("nums") >= start)
    specific = F.when(F.col("named"), ~F.col("general")).when(cover.isNotNull(), F.coalesce(by_cover, F.lit(False))).otherwise(True)
    return rows.select(*found.columns, F.when(specific, "specific").otherwise("general").alias("section"))


def segments(found: DataFrame, pages: DataFrame, width: float) -> DataFrame:
    """doc, block, kind, num, page, col, x0, x1, y0 and y1: the areas of each block in reading order (page, column, height).

    A marker opens a block, a stop closes it, an end closes the document; a block goes on in the next column and page. Pages before the
    first opening marker have no areas, nor do strips that are less than 4 high. ``pages`` are the frames.
    """
    return areas(reading(found, pages, width))


def areas(rows: DataFrame) -> DataFrame:
    """The areas of ``reading``'s rows."""
    open_ = ~F.col("ended") & ~F.col("now.kind").isin("stop", "end")
    return rows.where(open_ & (F.col("y1") - F.col("y0") >= 4)).select("doc", "block", "now.kind", "now.num", "page", "col", "x0", "x1", "y0", "y1")


def opened(rows: DataFrame) -> DataFrame:
    """doc, block, kind, num, nums, page and i of the markers among ``reading``'s rows that open a block, with areas or without."""
    return rows.where(~F.col("ended") & ~F.col("kind").isin("stop", "end")).select("doc", "block", "kind", "num", "nums", "page", "i")


def reading(found: DataFrame, pages: DataFrame, width: float) -> DataFrame:
    """Columns and markers in reading order, each with its strip of the page, the block it belongs to and whether the document has ended."""
    c = F.col
    none = lambda kind: F.lit(None).cast(kind)
    empty = pages.select("doc", "page", F.lit(-1).alias("i"), none("double").alias("x"), none("double").alias("top"), none("string").alias("kind"), none("int").alias("num"), none("array<int>").alias("nums"), "footer_top")
    nums = c("nums") if "nums" in found.columns else none("array<int>").alias("nums")
    rows = empty.unionByName(found.select("doc", "page", "i", "x", "top", "kind", "num", nums, none("double").alias("footer_top")))
    opens = c("kind").isNotNull() & ~c("kind").isin("stop", "end")
    of_doc, of_page = Window.partitionBy("doc"), Window.partitionBy("doc", "page")
    least = lambda column, holds=opens: F.min(F.when(holds, c(column)))
    margin, content = F.coalesce(least("x").over(of_doc) - 8, F.lit(0.0)), F.coalesce(least("top").over(of_doc) - 4, F.lit(0.0))
    rows = rows.withColumn("left_margin", margin).withColumn("content_top", content).withColumn("first_page", least("page").over(of_doc)).where("page >= first_page")
    rows = rows.withColumn("split", least("x", opens & (c("x") > RIGHT_COLUMN * width)).over(of_page) - 8).withColumn("footer_top", F.max("footer_top").over(of_page))
    right = F.lit(width) - c("left_margin")
    column = lambda k, x0, x1: F.struct(F.lit(k).alias("col"), x0.alias("x0"), x1.alias("x1"))
    two = F.array(column(0, c("left_margin"), c("split")), column(1, c("split"), right))
    rows = rows.withColumn("c", F.explode(F.when(c("split").isNotNull(), two).otherwise(F.array(column(0, c("left_margin"), right)))))
    rows = rows.select("doc", "page", "c.*", "split", "footer_top", "i", "x", "kind", "num", "nums", F.coalesce(c("top") - 2, c("content_top")).alias("y0"))
    rows = rows.where(c("kind").isNull() | c("split").isNull() | ((c("x") >= c("x0") - 2) & (c("x") < c("x1") - 20))).withColumn("order", c("kind").isNotNull())
    order = Window.partitionBy("doc").orderBy("page", "col", "order", "y0", "i")
    in_column = Window.partitionBy("doc", "page", "col").orderBy("order", "y0", "i")
    rows = rows.withColumn("y1", F.coalesce(F.lead("y0").over(in_column), c("footer_top")))
    now = F.last(F.when(c("kind").isNotNull(), F.struct("kind", "num")), ignorenulls=True).over(order)
    return rows.withColumn("now", now).withColumn("block", F.count(F.when(opens, 1)).over(order)).withColumn("ended", F.count(F.when(c("kind") == "end", 1)).over(order) > 0)


def contained(items: DataFrame, areas: DataFrame) -> DataFrame:
    """The items that lie in an area of their page, with its columns: by height with small tolerances, by width with their centre."""
    c, centre = F.col, F.col("x") + F.least(F.col("w"), F.lit(20.0)) / 2
    met = items.join(areas, ["doc", "page"])
    return met.where((c("top") >= c("y0") - 1) & (c("bottom") <= c("y1") + 2) & (centre >= c("x0")) & (centre < c("x1")))


def repair_ligatures(text: Column) -> Column:
    """Joins words that were cut behind ti, tt or ft."""
    return F.regexp_replace(text, r"([a-zà-ú])(ti|tt|ft) (?=[a-zà-ú])", "$1$2")


def repaired(texts: DataFrame, by: str, text: str) -> DataFrame:
    """Texts with their ligatures repaired in groups that hold at least as many broken ones as they have rows."""
    broken = F.regexp_count(F.col(text), F.lit(r"[a-zà-ú](?:ti|tt|ft) (?=[a-zà-ú])"))
    gate = texts.groupBy(F.col(by).alias("of")).agg((F.sum(broken) >= F.count("*")).alias("repair"))
    return texts.join(gate, F.col(by).eqNullSafe(F.col("of")), "left").withColumn(text, F.when(F.col("repair"), repair_ligatures(F.col(text))).otherwise(F.col(text))).drop("of", "repair")


#: Code points that are normalised on their way here, and the glyph ids they stood for.
NORMALISED = {0x3B: 0x37E, 0xB7: 0x387, 0x2B9: 0x374}
#: Glyphs that a table may have; it goes into expressions.
MOST_GLYPHS = 4096


def glyph_decoder(glyphs: DataFrame) -> Callable[[Column], Column]:
    """A function that decodes glyph ids by a table (code int, text string) of at most MOST_GLYPHS rows, such as a lookup file.

    Every character is looked up by its code point, in one pass: those that the table gives one character are translated, those of several
    characters go by way of private characters. A blank stays, normalised code points count as the glyph they stood for, control characters
    that the table doesn't know are dropped, and others stay.
    """
    rows = glyphs.select("code", "text").where("code IS NOT NULL AND text IS NOT NULL").limit(MOST_GLYPHS + 1).collect()
    if len(rows) > MOST_GLYPHS:
        raise ValueError(f"a table of more than {MOST_GLYPHS} glyphs")
    known = {r["code"]: r["text"] for r in rows}
    of = {code: text for code, text in known.items() if code not in (0x20, *NORMALISED)}
    of |= {code: known[real] for code, real in NORMALISED.items() if real in known}
    of |= {code: "" for code in range(0x20) if code not in of}
    several = {code: chr(0xE000 + k) for k, code in enumerate(sorted(c for c, t in of.items() if len(t) > 1))}
    single = {code: several.get(code, text) for code, text in of.items() if text}
    source = "".join(map(chr, single)) + "".join(chr(c) for c, t in of.items() if not t)

    def decode(text: Column) -> Column:
        text = F.translate(text, source, "".join(single.values()))
        for code, mark in several.items():
            text = F.replace(text, F.lit(mark), F.lit(of[code]))
        return text

    return decode


def decoded(items: DataFrame, decode: Callable[[Column], Column]) -> DataFrame:
    """Items with their text decoded where their font is in glyph ids on the page, and without leaked glyphs elsewhere.

    A font is in glyph ids if at least half of its characters on the page, and three of them, are control characters or of the code points
    in which glyph ids come.
    """
    bare = F.regexp_replace("str", T.BLANK, "")
    font = Window.partitionBy("doc", "page", "font")
    rows = items.withColumn("chars", F.sum(F.length(bare)).over(font)).withColumn("odd", F.sum(F.regexp_count(bare, F.lit(r"[\x00-\x1F\u0100-\u03FF]"))).over(font))
    glyph_ids = (F.col("chars") >= 3) & (F.col("odd") >= 0.5 * F.col("chars"))
    return rows.withColumn("str", F.when(glyph_ids, decode(F.col("str"))).otherwise(leaked_glyphs(F.col("str")))).drop("chars", "odd")


def page_runs(items: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """doc, page, i, x, w, h, baseline, top, bottom and str of the runs that the items of a page make.

    Lines first: from top to bottom an item joins the line whose first baseline is within the tolerance. Then, from left to right, a run
    ends where a gap is at least max(3, 0.7 of the next item's height), and a blank comes between items of a run with a visible gap and
    no blank yet. A run has its line's baseline; i counts runs in reading order. The anchors of the streamed pass are the windows' keys.
    """
    kept = items.where(F.col("str").rlike(rf"[^{T.BLANK[1:]}")).select("doc", "page", F.col("i").cast("long").alias("i"), "x", "w", "h", "baseline", "str")
    lines = anchored(kept, ["doc", "page"], "baseline", tolerance, ["x", "i"])
    line = Window.partitionBy("doc", "page", "grp")
    order = line.orderBy("x", "baseline", "i")
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(order)
    blank = F.endswith(F.lag("str").over(order), F.lit(" ")) | F.startswith("str", F.lit(" "))
    rows = lines.withColumn("new", F.coalesce(gap >= F.greatest(F.lit(3.0), 0.7 * F.col("h")), F.lit(True)))
    rows = rows.withColumn("piece", F.concat(F.when(~F.col("new") & (gap > 0.15 * F.col("h")) & ~blank, " ").otherwise(""), "str"))
    rows = rows.withColumn("run", F.count(F.when(F.col("new"), 1)).over(order)).withColumn("line", F.min("baseline").over(line))
    pieces = F.sort_array(F.collect_list(F.struct("x", "baseline", "i", "piece")))
    end = F.max_by(F.col("x") + F.col("w"), F.struct("x", "baseline", "i"))
    runs_ = rows.groupBy("doc", "page", "grp", "run").agg(F.min("x").alias("x"), end.alias("end"), F.max("h").alias("h"), F.first("line").alias("baseline"), pieces.alias("p"))
    place = (F.col("grp").cast("long") * (1 << 20) + F.col("run")).alias("i")
    text = T.squeeze(F.array_join(F.transform("p", lambda p: p["piece"]), "")).alias("str")
    runs_ = runs_.select("doc", "page", place, "x", (F.col("end") - F.col("x")).alias("w"), "h", "baseline", text)
    return runs_.withColumn("top", F.col("baseline") - 0.9 * F.col("h")).withColumn("bottom", F.col("baseline") + 0.25 * F.col("h"))


def assembled(rows: DataFrame, by: list[str], order: list[str], tolerance: float = 2.0, column: float = 400.0, reach: float | None = 300.0) -> DataFrame:
    """The rows (page, baseline, x and others) with line, a number from 0 for each key: lines put together in reading order.

    A row joins the first line, of those opened so far, of its page whose first baseline is within the tolerance and whose first x is less
    than ``column`` away, if it begins right of that x less ``reach``; otherwise it opens a line. Without ``reach`` every row opens
    one. A task goes once through its rows in order, and forgets the lines of a page when the next one begins (rows come page by page),
    so that it holds a page's anchors and nothing of the rows.
    """
    names = rows.columns
    at = [names.index(c) for c in (*by, "page", "baseline", "x")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, page, count, open_ = None, None, 0, []
        for batch in batches:
            out = []
            for *key, number, baseline, x in zip(*(batch.column(k).to_pylist() for k in at), strict=True):
                if key != last:
                    last, page, count, open_ = key, number, 0, []
                elif number != page:
                    page, open_ = number, []
                met = next((line for line in open_ if abs(line[0] - baseline) <= tolerance and abs(line[1] - x) < column), None)
                if met is None or reach is None or x <= met[1] - reach:
                    met = (baseline, x, count)
                    open_.append(met)
                    count += 1
                out.append(met[2])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*names, "line"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(*by).sortWithinPartitions(*by, "page", *order).mapInArrow(run, f"{kinds}, line bigint")


def line_texts(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, page, line and text of ``assembled`` rows, from left to right."""
    each = F.sort_array(F.collect_list(F.struct("x", "place", "str")))
    texts = rows.groupBy(*by, "line").agg(F.min("page").alias("page"), each.alias("p"))
    return texts.select(*by, "page", "line", T.squeeze(F.array_join(F.transform("p", lambda p: p["str"]), " ")).alias("text"))


def leaked_glyphs(text: Column) -> Column:
    """Characters of partly mapped fonts as what they stand for."""
    return F.replace(F.translate(text, "ĚĴͳ", " (-"), F.lit("Į"), F.lit("fi"))
