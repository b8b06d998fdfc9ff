"""Lines of documents across a host: quality rules by line frequency, and site-relative line removal. DataFrame functions only.

A line is normalised (lower case, blanks collapsed and trimmed) and hashed to 64 bits; lines without a word take no part. Documents
of a host that have the same text are one page under several ids and count once, so that exact copies are not boilerplate.

The lines over a limit are looked up in one array for each host of at most HOST_LINES such lines. The table of arrays is written, so
that Spark broadcasts it only while its size is below spark.sql.autoBroadcastJoinThreshold and otherwise joins by host, where a hot host
can be split. Hosts with more lines over the limit get an array for each page instead, of the page's own lines alone, by a join on host
and line; the result is the same.

Nulls: a null text has no words and no lines, a null host is a host of its own, any id is passed on. Repeated rows each get a row.
Ties do not arise: a count must exceed its limit. Empty tables give empty results. Whole texts are read; no hash depends on a text's
length. Extra columns are ignored by ``quality`` and kept by ``keep_quality`` and ``without_boilerplate``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import BLANKS, packed, text_or_empty, unpacked, written

BLANK_CHARS = " \t\n\x0b\x0c\r"

#: Quality rules: a line is above its limit in over LINE_DOCS pages of a host; a document is depleted when less than LEAST_LEFT of its
#: words are on other lines.
LINE_DOCS, LEAST_LEFT = 20, 0.3
#: The base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Line removal: a line is boilerplate in over PAGES pages of a host that are also over SHARE of it.
PAGES, SHARE = 5, 0.05
#: Lines over a limit that one array of a host holds.
HOST_LINES = 4096


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK_CHARS))


def _words(text: Column) -> Column:
    """Words in order; the empty array for none."""
    bare = _trimmed(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANKS))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    """Hash of the normalised line, null for a line without a word."""
    bare = _trimmed(line)
    return F.when(bare != "", F.xxhash64(F.lower(F.regexp_replace(bare, BLANKS, " "))))


def _page(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def _pages(rows: DataFrame) -> DataFrame:
    """host, page and its distinct line keys, from rows with text and host."""
    body = text_or_empty("text")
    return rows.select("host", _page(body).alias("page"), F.array_distinct(F.array_compact(F.transform(_lines(body), _key))).alias("keys"))


def lines_above(rows: DataFrame, least: int, share: float) -> DataFrame:
    """Written table of host and key: the lines in over ``least`` pages and over ``share`` of the pages of their host."""
    pages = _pages(rows)
    counts = pages.select("host", "page", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count_distinct("page").alias("n")).where(F.col("n") > least)
    if share > 0:
        sizes = pages.groupBy(F.col("host").alias("of")).agg(F.count_distinct("page").alias("pages"))
        counts = counts.join(sizes, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > share * F.col("pages"))
    return written(counts.select("host", "key"), "lines")


def _with_above(rows: DataFrame, least: int, share: float) -> DataFrame:
    """Adds above, an array of line keys that holds those of the row's lines that are over the limit, to rows with text and host."""
    above = lines_above(rows, least, share)
    sizes = written(above.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("n")), "sizes")
    heavy = sizes.where(F.col("n") > HOST_LINES).select("of")
    on_host = F.col("host").eqNullSafe(F.col("of"))
    some = heavy.limit(1).count() > 0
    light = above.join(heavy, on_host, "left_anti") if some else above
    arrays = written(light.groupBy(F.col("host").alias("of")).agg(F.sort_array(F.collect_list("key")).alias("of_host")), "arrays")
    out = rows.join(arrays, on_host, "left").drop("of").withColumnRenamed("of_host", "above")
    if some:
        keys = _pages(rows.join(heavy, on_host, "left_semi")).distinct().select("host", "page", F.explode("keys").alias("key"))
        keyed = above.select(F.col("host").alias("of"), F.col("key").alias("over"))
        own = keys.join(keyed, on_host & (F.col("key") == F.col("over"))).groupBy(F.col("host").alias("of"), F.col("page").alias("of_page")).agg(F.collect_list("key").alias("of_own"))
        own = written(own, "own")
        out = out.join(own, on_host & (_page(text_or_empty("text")) == F.col("of_page")), "left")
        out = out.withColumn("above", F.coalesce("above", "of_own")).drop("of", "of_page", "of_own")
    return out.withColumn("above", F.coalesce("above", F.array().cast("array<bigint>")))


def _kept_lines(text: Column) -> Column:
    """The lines that are not over the limit."""
    return F.filter(_lines(text), lambda x: ~F.coalesce(F.array_contains("above", _key(x)), F.lit(False)))


def _measured(df: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, left (the text without lines over the limit) and n_removed, the words on these."""
    df = df.withColumn("body", text_or_empty("text"))
    text = F.col("body")
    bare = text
    for c in BLANK_CHARS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    own = F.filter(_lines(text), lambda x: _trimmed(x) != "")
    df = df.withColumn("words", _words(text)).withColumn("own", own).withColumn("left", F.when(F.size("above") > 0, F.array_join(_kept_lines(text), "\n")).otherwise(text))
    df = df.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("own") - F.size(F.array_distinct("own"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("above") > 0, F.size("words") - F.size(_words(F.col("left")))).otherwise(0).cast("long").alias("n_removed"),
    ).drop("own")
    word = lambda i: F.get("words", i)
    windows = F.transform("words", lambda w, i: F.xxhash64(w, word(i + 1), word(i + 2)))
    df = df.withColumn("windows", F.when(F.col("n_words") >= 3, F.slice(windows, 1, F.greatest(F.size("words") - 2, F.lit(1)))).otherwise(F.array().cast("array<bigint>")))
    # Most texts repeat no window. In the others equal hashes become neighbours, and are compared by their words.
    ordered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("ordered", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), ordered)).drop("windows")

    def same(a: Column, b: Column) -> Column:
        equal = [word(a["i"] + k) == word(b["i"] + k) for k in range(3)]
        return F.coalesce((a["h"] == b["h"]) & equal[0] & equal[1] & equal[2], F.lit(False))

    twice = F.filter("ordered", lambda p, i: same(p, F.get("ordered", i + 1)) | ((i > 0) & same(p, F.get("ordered", F.greatest(i - 1, F.lit(0))))))
    df = df.withColumn("places", F.sort_array(F.transform(twice, lambda p: p["i"].cast("long")))).drop("ordered", "words", "body")
    steps = F.transform("places", lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("places", i + 1) - p, F.lit(3).cast("long"))))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("places")


def _judged(rows: DataFrame, least: int, least_left: float) -> DataFrame:
    df = _measured(_with_above(rows, least, 0.0))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    depleted = F.col("n_words") - F.col("n_removed") < least_left * F.col("n_words")
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", least: int = LINE_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(host).cast("string").alias("host"))
    return _judged(rows, least, least_left).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed")


def keep_quality(docs: DataFrame, text: str = "text", host: str = "source", least: int = LINE_DOCS, least_left: float = LEAST_LEFT, size: str | None = None) -> DataFrame:
    """The documents that the rules keep, all columns as they are but for the text, which loses its lines over the limit.

    ``size`` names a column with the text's length, which then follows it.
    """
    judged = _judged(packed(docs, text=F.col(text), host=F.col(host).cast("string")), least, least_left)
    # The task's number keeps the filter above the measuring: pushed below, it would hold each measure many times over.
    judged = judged.select("row", "kept", "left", "n_removed", F.spark_partition_id().alias("task")).where("kept AND task >= 0")
    return unpacked(judged, docs, **_shortened(docs, F.col("n_removed") > 0, F.col("left"), text, size))


def _shortened(docs: DataFrame, changed: Column, left: Column, text: str, size: str | None) -> dict[str, Column]:
    """The text and its length, where they change."""
    out = {text: F.when(changed, left).otherwise(F.col("row")[text])}
    if size:
        out[size] = F.when(changed, F.length(left).cast(docs.schema[size].dataType)).otherwise(F.col("row")[size])
    return out


def without_boilerplate(docs: DataFrame, text: str = "text", host: str = "source", least: int = PAGES, share: float = SHARE, counts: tuple[str, str] | None = None, size: str | None = None) -> DataFrame:
    """The documents with their text less the lines over the host's boilerplate ratio, all other columns as they are.

    ``counts`` names two more columns: how many lines each text had, and how many it lost. ``size`` names a column with the text's length,
    which then follows it. A null text stays null, and a text that loses all its lines becomes empty.
    """
    df = _with_above(packed(docs, text=F.col(text), host=F.col(host).cast("string")), least, share)
    some = (F.size("above") > 0) & F.col("text").isNotNull()
    df = df.withColumn("had", F.coalesce(F.size(_lines(F.col("text"))), F.lit(0)).cast("long")).withColumn("kept", F.when(some, _kept_lines(F.col("text"))))
    df = df.withColumn("lost", F.when(some, F.col("had") - F.size("kept")).otherwise(0).cast("long"))
    replaced = _shortened(docs, F.col("lost") > 0, F.array_join("kept", "\n"), text, size)
    out = [(replaced[c] if c in replaced else F.col("row")[c]).alias(c) for c in docs.columns]
    return df.select(*out, *([F.col("had").alias(counts[0]), F.col("lost").alias(counts[1])] if counts else []))
