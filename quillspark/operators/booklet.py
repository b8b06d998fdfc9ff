"""Booklets to questions: one staged plan from the items of pages to a table with every attribute of a question.

    items -> fonts decoded -> runs -> ligatures -> frames, markers -> blocks -> lines -> statement and alternatives
          -> answers, shared texts, topics, format, corrections

Runs, frames and markers feed several later steps and are staged, so that each is computed once. Rows are keyed by document and page up
to the blocks, and by document and block from there on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import classify, layout, questions, study
from quillspark.staging import staged

# Upper-case words of negative commands, and such words in any case.
NEGATIVE, NEGATIVE_FOLDED = ["INCORRETA", "INCORRETO", "EXCETO", "NÃO", "FALSA", "ERRADA"], ["incorreta", "exceto"]
_BROKEN = r"[a-zà-ú](?:ti|tt|ft) (?=[a-zà-ú])"


@dataclass(frozen=True)
class Lookups:
    """Tables beside the items: exams (doc, exam, year), answers (doc, num, answer; null: annulled, no row: unknown), keywords (topic, ord, grp,
    pos, regex) with a fallback for each group, glyphs (code, text), corrections by id and images (path, w, h)."""

    exams: DataFrame
    answers: DataFrame
    keywords: DataFrame
    fallback: dict[str, str]
    glyphs: DataFrame
    overrides: DataFrame | None = None
    images: DataFrame | None = None
    negative: tuple[list[str], list[str]] = (NEGATIVE, NEGATIVE_FOLDED)


def runs(items: DataFrame, decode: Callable[[Column], Column]) -> DataFrame:
    """Staged runs of the items (doc, page, i, font, x, w, h, baseline, str) with norm.

    Ligatures are repaired in documents with at least as many broken ones as pages.
    """
    found = layout.page_runs(layout.decoded(items, decode))
    own = Window.partitionBy("doc")  # one pass over the runs; a join would make them twice
    repair = F.sum("broken").over(own) >= F.size(F.collect_set("page").over(own))
    rows = found.withColumn("broken", F.regexp_count("str", F.lit(_BROKEN))).withColumn("repair", repair)
    rows = rows.withColumn("str", F.when(F.col("repair"), layout.repair_ligatures(F.col("str"))).otherwise(F.col("str")))
    return staged(rows.drop("broken", "repair").withColumn("norm", T.marker_norm(F.col("str"))))


def covers(found: DataFrame) -> DataFrame:
    """doc and cover: the ranges on the first page, whose words may be parted behind TI."""
    first = found.groupBy(F.col("doc").alias("of")).agg(F.min("page").alias("first"))
    rows = found.join(first, (F.col("doc") == F.col("of")) & (F.col("page") == F.col("first")))
    each = F.transform(F.sort_array(F.collect_list(F.struct("i", "norm"))), lambda x: x["norm"])
    text = F.regexp_replace(F.array_join(each, " "), "TI (?=[A-Z])", "TI")
    return rows.groupBy("doc").agg(text.alias("text")).select("doc", layout.cover_ranges(F.col("text")).alias("cover"))


def blocks(found: DataFrame, framed: DataFrame, read: DataFrame) -> DataFrame:
    """doc, block, kind, num, nums, page, i and section. Essays without a number are numbered before their section is looked up."""
    opened = layout.opened(read)
    order = Window.partitionBy("doc").orderBy("block")
    essays = F.count(F.when((F.col("kind") == "essay") & F.col("num").isNull(), 1)).over(order).cast("int")
    opened = opened.withColumn("num", F.coalesce("num", F.when(F.col("kind") == "essay", essays)))
    return layout.sectioned(opened, framed, covers(found))


def lines(found: DataFrame, read: DataFrame, reach: float | None) -> DataFrame:
    """doc, block and lines, the texts of a block's lines in reading order."""
    areas = layout.areas(read).select("doc", "page", "block", "col", "x0", "x1", "y0", "y1")
    inside = layout.contained(found, areas).select("doc", "block", "page", "col", "y0", F.col("i").alias("place"), "x", "baseline", "str")
    put = layout.assembled(inside, ["doc", "block"], ["col", "y0", "place"], reach=reach)
    each = F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])
    return layout.line_texts(put, ["doc", "block"]).groupBy("doc", "block").agg(each.alias("lines"))


def _statement(parts: DataFrame) -> DataFrame:
    """Statement and alternatives; the heading's own line, or its words before the statement, are left out."""
    heading = F.get("lines", F.lit(0))
    body = F.when(T.marker_norm(heading).rlike("^QUEST"), F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))).otherwise(F.col("lines"))
    split = questions.split_question(body)
    essay = F.regexp_replace(F.array_join("lines", "\n"), r"(?i)^QUEST\S+ DISCURSIVA\s*\d*\s*", "")
    none = F.array().cast("array<string>")
    rows = parts.withColumn("split", F.when(F.col("kind") == "objective", split))
    statement = F.regexp_replace(F.when(F.col("kind") == "objective", F.col("split.statement")).otherwise(essay), r"(?i)^QUEST\S+\s+\d+\s*", "")
    return rows.withColumn("statement", statement).withColumn("texts", F.coalesce("split.alternatives", none)).drop("split")


def shared_by_question(rows: DataFrame) -> DataFrame:
    """of_doc, of_num, shared_texts and shared_text: the shared blocks that name an objective question, in the order of the blocks."""
    each = rows.where("kind = 'shared'").select("doc", "block", "id", F.array_join("lines", " ").alias("text"), F.explode(F.array_distinct("nums")).alias("num"))
    ordered = F.sort_array(F.collect_list(F.struct("block", "id", "text")))
    return each.groupBy(F.col("doc").alias("of_doc"), F.col("num").alias("of_num")).agg(F.transform(ordered, lambda x: x["id"]).alias("shared_texts"), F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("shared_text"))


def parse(items: DataFrame, tables: Lookups, width: float, height: float, reach: float | None = None) -> DataFrame:
    """Staged blocks with their texts: doc, block, id, exam, year, kind, num, nums, section, page, img and lines.

    ``reach`` is that of ``layout.assembled``. The published rule bounds a run's x by a line's x, which is set only after all lines are
    made, so that no run ever joins a line; None gives that.
    """
    decode = layout.glyph_decoder(tables.glyphs)
    found = runs(items, decode)
    framed = staged(layout.frames(found, height))
    marked = layout.markers(found, height, framed, decode)
    read = staged(layout.reading(marked, framed, width))
    rows = blocks(found, framed, read).join(lines(found, read, reach), ["doc", "block"], "left").join(tables.exams, "doc")
    rows = rows.withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))
    nums = F.when(F.col("kind") == "shared", F.col("nums")).otherwise(F.array("num"))
    rows = rows.withColumn("id", questions.identifier(F.col("exam"), F.col("kind"), nums))
    path = F.concat(F.lit("img/"), "exam", F.lit("/"), F.substring("id", F.length("exam") + 2, F.length("id")), F.lit(".webp"))
    return staged(rows.withColumn("img", path).select("doc", "block", "id", "exam", "year", "kind", "num", "nums", "section", "page", "img", "lines"))


def question_table(rows: DataFrame, tables: Lookups) -> DataFrame:
    """A row for each question of ``parse``'s blocks, with all its attributes; corrections replace what they name, at last."""
    asked = _statement(rows.where("kind <> 'shared'"))
    shared = shared_by_question(rows)
    asked = asked.join(shared, (F.col("doc") == F.col("of_doc")) & (F.col("num") == F.col("of_num")) & (F.col("kind") == "objective"), "left")
    key = tables.answers.select(F.col("doc").alias("key_doc"), F.col("num").alias("key_num"), "answer", F.lit(True).alias("known"))
    asked = asked.join(key, (F.col("doc") == F.col("key_doc")) & (F.col("num") == F.col("key_num")) & (F.col("kind") == "objective"), "left")
    letters = F.transform("texts", lambda t, k: F.struct(F.substring(F.lit("ABCDE"), k + 1, F.lit(1)).alias("letter"), t.alias("text")))
    asked = asked.select(
        "doc", "block", "id", F.col("exam").alias("exam_id"), "year", "kind", "num", "section", "page", "img", "statement", letters.alias("alternatives"), "texts", "answer",
        (F.coalesce("known", F.lit(False)) & F.col("answer").isNull()).alias("annulled"),
        F.coalesce("shared_texts", F.array().cast("array<string>")).alias("shared_texts"),
        F.when(F.col("kind") == "objective", questions.detect_format(F.col("statement"), F.col("texts"))).otherwise("essay").alias("format"),
        ((F.col("kind") == "objective") & classify.negative(F.col("statement"), *tables.negative)).alias("negative"),
        T.fold(F.concat_ws(" ", "shared_text", "statement", F.array_join("texts", " "))).alias("folded"),
    )
    asked = staged(asked)
    texts = asked.select(F.struct("doc", "block").alias("id"), F.col("section").alias("grp"), "folded")
    topics = classify.topics_by_table(texts, tables.keywords, tables.fallback).select(F.col("id").alias("of"), "topics")
    out = asked.join(topics, F.struct("doc", "block") == F.col("of")).drop("of", "folded", "texts")
    sizes = tables.images.select(F.col("path").alias("img"), "w", "h") if tables.images is not None else None
    out = out.join(sizes, "img", "left") if sizes is not None else out.withColumns({"w": F.lit(None).cast("int"), "h": F.lit(None).cast("int")})
    return out if tables.overrides is None else corrected(out, tables.overrides)


def corrected(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rows with the attributes that a row of ``overrides`` of the same id names in place of their own."""
    named = [c for c in overrides.columns if c != "id" and c in rows.columns]
    other = overrides.select(F.col("id").alias("of"), *[F.col(c).alias(f"new_{c}") for c in named])
    met = rows.join(other, F.col("id") == F.col("of"), "left")
    return met.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in named else F.col(c) for c in rows.columns])
