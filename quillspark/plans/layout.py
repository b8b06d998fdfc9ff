"""Layout of pages. The words of a turn stand in for a page's items, eight to a line, with headings and footers put in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import layout
from quillspark.plans.registry import query
from quillspark.session import table

WIDTH, HEIGHT = 560.0, 800.0


def _items(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    words = turns.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.posexplode(F.split("text", " ")).alias("i", "s"))
    i, page, two = F.col("i"), F.col("page"), lambda n: F.lpad(n.cast("string"), 2, "0")
    text = F.when(i % 40 == 0, F.concat(F.lit("Questão "), two(1 + (page * 7 + F.floor(i / 40)) % 35))).when(i % 97 == 13, "Rascunho").when(i % 61 == 30, F.concat(F.lit("Texto para as questões 0"), (1 + i % 7).cast("string"), F.lit(" a 09"))).otherwise(F.col("s"))
    words = words.withColumn("str", text)
    size, real = F.length("str"), lambda c: c.cast("double")
    items = words.select("doc", "page", "i", real(10 + (i % 8) * 60 + size % 5).alias("x"), real(size * 6).alias("w"), real(10 + i % 3).alias("h"), real(20 + 14 * F.floor(i / 8)).alias("baseline"), "str")
    feet = turns.where("turn % 2 = 0").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page")).distinct()
    feet = feet.select("doc", "page", F.lit(-1).alias("i"), F.lit(250.0).alias("x"), F.lit(60.0).alias("w"), F.lit(9.0).alias("h"), F.lit(780.0).alias("baseline"), F.concat(F.lit("Formação geral "), F.col("page").cast("string")).alias("str"))
    return layout.positioned(items.unionByName(feet))


_I = r"""w AS (SELECT conv_id AS doc, turn AS page, unnest(ws) AS s, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations)),
t AS (SELECT doc, page, i, CASE WHEN i % 40 = 0 THEN 'Questão ' || lpad(CAST(1 + (page * 7 + i // 40) % 35 AS VARCHAR), 2, '0') WHEN i % 97 = 13 THEN 'Rascunho' WHEN i % 61 = 30 THEN 'Texto para as questões 0' || (1 + i % 7) || ' a 09' ELSE s END AS str FROM w),
a AS (SELECT doc, page, CAST(i AS INTEGER) AS i, CAST(10 + (i % 8) * 60 + length(str) % 5 AS DOUBLE) AS x, CAST(length(str) * 6 AS DOUBLE) AS w, CAST(10 + i % 3 AS DOUBLE) AS h, CAST(20 + 14 * (i // 8) AS DOUBLE) AS baseline, str FROM t
  UNION ALL SELECT DISTINCT conv_id, turn, -1, 250::DOUBLE, 60::DOUBLE, 9::DOUBLE, 780::DOUBLE, 'Formação geral ' || turn FROM conversations WHERE turn % 2 = 0),
items AS (SELECT *, baseline - 0.9::DOUBLE * h AS top, baseline + 0.25::DOUBLE * h AS bottom, upper(replace(trim(regexp_replace(strip_accents(lower(str)), '\s+', ' ', 'g')), 'ß', 'ss')) AS norm FROM a WHERE regexp_matches(str, '\S'))"""

_F = r"""low AS (SELECT *, left(regexp_replace(norm, '[0-9\s]', '', 'g'), 30) AS sig, floor(top / 4 + 0.5) AS place FROM items WHERE top >= 0.86::DOUBLE * 800),
pages AS (SELECT DISTINCT doc, page FROM items), many AS (SELECT doc, count(*) AS pages FROM pages GROUP BY doc),
often AS (SELECT doc, sig, place FROM low JOIN many USING (doc) GROUP BY doc, sig, place, pages HAVING count(DISTINCT page) >= greatest(3, 0.25 * pages)),
feet AS (SELECT doc, page, min(top) - 3 AS top, string_agg(str, ' ' ORDER BY i) AS footer_text FROM low JOIN often USING (doc, sig, place) GROUP BY doc, page),
frames AS (SELECT p.doc, p.page, coalesce(f.top, 0.93::DOUBLE * 800) AS footer_top, coalesce(f.footer_text, '') AS footer_text FROM pages p LEFT JOIN feet f USING (doc, page))"""

_M = r"""body AS (SELECT doc, (list(h ORDER BY h))[1 + count(*) // 2] AS body FROM items GROUP BY doc),
kinds AS (SELECT *, CASE WHEN contains(norm, 'QUESTIONARIO DE PERCEPCAO') THEN 'end' WHEN regexp_matches(norm, '^QUESTAO DISCURSIVA\s*(\d{1,2})?\b') THEN 'essay' WHEN regexp_matches(norm, '^QUESTAO\s+(\d{1,2})\b') THEN 'objective'
  WHEN regexp_matches(norm, '^TEXTO PARA (?:(?:AS )?QUESTO?E?S?|(?:A )?QUESTAO)\s+(.+)$') THEN 'shared' WHEN regexp_matches(norm, '^AREA LIVRE\b|^RASCUNHO\b') THEN 'stop' END AS kind FROM items),
markers AS (SELECT doc, page, i, x, top, kind, CASE WHEN kind = 'objective' THEN TRY_CAST(regexp_extract(norm, '^QUESTAO\s+(\d{1,2})\b', 1) AS INTEGER) END AS num,
  CASE WHEN kind = 'shared' THEN CAST(regexp_extract(norm, '(\d{1,2})\s*A\s*(\d{1,2})', 1) AS INTEGER) END AS first_num FROM kinds JOIN frames USING (doc, page) JOIN body USING (doc) WHERE kind IS NOT NULL AND top < footer_top AND (kind IN ('stop', 'end') OR h >= 0.95::DOUBLE * body))"""


@query(f"WITH {_I} SELECT doc, page, i, x, top, bottom, str FROM items")
def positioned_items(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("doc", "page", "i", "x", "top", "bottom", "str")


@query(f"""WITH {_I}, n AS (SELECT *, CASE WHEN x - lag(x + w) OVER l < greatest(3, 0.7::DOUBLE * h) THEN 0 ELSE 1 END AS new FROM items WINDOW l AS (PARTITION BY doc, page, baseline ORDER BY x, i)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc, page, baseline ORDER BY x, i) AS run FROM n) SELECT doc, page, baseline, CAST(run AS BIGINT) AS run, count(*) AS n, min(x) AS x0, max(x + w) AS x1 FROM r GROUP BY doc, page, baseline, run""")
def text_runs(spark: SparkSession, d: str) -> DataFrame:
    return layout.runs(_items(spark, d))


@query(rf"""WITH {_I}, p AS (SELECT doc, page, baseline, x, i, CASE WHEN x - lag(x + w) OVER l > 0.15::DOUBLE * h AND NOT suffix(lag(str) OVER l, ' ') AND NOT prefix(str, ' ') THEN ' ' ELSE '' END || str AS piece FROM items WINDOW l AS (PARTITION BY doc, page, baseline ORDER BY x, i))
SELECT doc, page, baseline, trim(regexp_replace(string_agg(piece, '' ORDER BY x, i), '\s+', ' ', 'g')) AS text FROM p GROUP BY doc, page, baseline""")
def joined_items(spark: SparkSession, d: str) -> DataFrame:
    return layout.joined(_items(spark, d))


@query(f"WITH {_I}, {_F} SELECT * FROM frames")
def page_frames(spark: SparkSession, d: str) -> DataFrame:
    return layout.frames(_items(spark, d), HEIGHT)


@query(f"WITH {_I}, {_F}, {_M} SELECT * FROM markers")
def page_markers(spark: SparkSession, d: str) -> DataFrame:
    return layout.markers(_items(spark, d), HEIGHT).select("doc", "page", "i", "x", "top", "kind", "num", F.get("nums", F.lit(0)).alias("first_num"))


def _marked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, frames and markers."""
    items = _items(spark, d)
    return items, *layout.framed_markers(items, HEIGHT)


@query(f"WITH {_I}, {_F}, {_M} SELECT doc, page, min(x) FILTER (kind NOT IN ('stop', 'end') AND x > 0.4::DOUBLE * 560) - 8 AS split FROM markers GROUP BY doc, page")
def page_columns(spark: SparkSession, d: str) -> DataFrame:
    return layout.columns(layout.markers(_items(spark, d), HEIGHT), WIDTH)


@query(f"WITH {_I}, {_F}, {_M} SELECT doc, coalesce(min(x) FILTER (kind NOT IN ('stop', 'end')) - 8, 0) AS left_margin, coalesce(min(top) FILTER (kind NOT IN ('stop', 'end')) - 4, 0) AS content_top FROM markers GROUP BY doc")
def page_margins(spark: SparkSession, d: str) -> DataFrame:
    return layout.margins(layout.markers(_items(spark, d), HEIGHT))


_COVER = "CASE WHEN conv_id % 3 = 0 THEN 'FORMACAO GERAL/OBJETIVAS 1 A ' || (5 + conv_id % 4) WHEN conv_id % 3 = 1 THEN 'COMPONENTE ESPECIFICO: OBJETIVAS ' || (9 + conv_id % 5) || ' A 35' END"


def _covers(spark: SparkSession, d: str) -> DataFrame:
    k, word = F.col("conv_id"), lambda c: c.cast("string")
    text = F.when(k % 3 == 0, F.concat(F.lit("FORMACAO GERAL/OBJETIVAS 1 A "), word(5 + k % 4))).when(k % 3 == 1, F.concat(F.lit("COMPONENTE ESPECIFICO: OBJETIVAS "), word(9 + k % 5), F.lit(" A 35")))
    return table(spark, d, "conversations").select("conv_id").distinct().select(F.col("conv_id").alias("doc"), layout.cover_ranges(text).alias("cover"))


@query(f"""WITH {_I}, {_F}, {_M}, g AS (SELECT doc, page, contains(replace(upper(strip_accents(lower(footer_text))), ' ', ''), 'FORMACAOGERAL') AS general FROM frames), n AS (SELECT doc, bool_or(general) AS named FROM g GROUP BY doc),
c AS (SELECT conv_id AS doc, CASE WHEN conv_id % 3 = 0 THEN 6 + conv_id % 4 WHEN conv_id % 3 = 1 THEN 9 + conv_id % 5 END AS start FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT doc, page, i, kind, num, CASE WHEN CASE WHEN named THEN NOT general WHEN start IS NULL THEN true ELSE coalesce(num, first_num) >= start END THEN 'specific' ELSE 'general' END AS section
FROM markers JOIN g USING (doc, page) JOIN n USING (doc) JOIN c USING (doc) WHERE kind NOT IN ('stop', 'end')""")
def block_sections(spark: SparkSession, d: str) -> DataFrame:
    _, framed, marks = _marked(spark, d)
    return layout.sections(marks, framed, _covers(spark, d))


_S = f"""{_M}, fp AS (SELECT doc, min(page) AS first_page FROM markers WHERE kind IN ('objective', 'essay', 'shared') GROUP BY doc),
mg AS (SELECT doc, coalesce(min(x) FILTER (kind NOT IN ('stop', 'end')) - 8, 0) AS lm, coalesce(min(top) FILTER (kind NOT IN ('stop', 'end')) - 4, 0) AS ct FROM markers GROUP BY doc),
sp AS (SELECT doc, page, min(x) FILTER (kind NOT IN ('stop', 'end') AND x > 0.4::DOUBLE * 560) - 8 AS split FROM markers GROUP BY doc, page),
pc AS (SELECT doc, page, footer_top, lm, ct, split FROM frames JOIN fp USING (doc) JOIN mg USING (doc) LEFT JOIN sp USING (doc, page) WHERE page >= first_page),
cl AS (SELECT doc, page, footer_top, ct, split, 0 AS col, lm AS x0, coalesce(split, 560 - lm) AS x1 FROM pc UNION ALL SELECT doc, page, footer_top, ct, split, 1, split, 560 - lm FROM pc WHERE split IS NOT NULL),
ev AS (SELECT doc, page, col, x0, x1, footer_top, 0 AS ord, ct AS y0, -1 AS i, NULL AS kind, NULL::INTEGER AS num FROM cl
  UNION ALL SELECT m.doc, m.page, col, x0, x1, footer_top, 1, m.top - 2, m.i, m.kind, m.num FROM markers m JOIN cl ON m.doc = cl.doc AND m.page = cl.page AND (split IS NULL OR (m.x >= x0 - 2 AND m.x < x1 - 20))),
st AS (SELECT *, coalesce(lead(y0) OVER (PARTITION BY doc, page, col ORDER BY ord, y0, i), footer_top) AS y1, last_value(CASE WHEN kind IS NOT NULL THEN {{'kind': kind, 'num': num}} END IGNORE NULLS) OVER r AS now,
  count(*) FILTER (kind NOT IN ('stop', 'end')) OVER r AS block, count(*) FILTER (kind = 'end') OVER r AS ended FROM ev WINDOW r AS (PARTITION BY doc ORDER BY page, col, ord, y0, i)),
segs AS (SELECT doc, block, now.kind AS kind, now.num AS num, page, col, x0, x1, y0, y1 FROM st WHERE ended = 0 AND now.kind NOT IN ('stop', 'end') AND y1 - y0 >= 4)"""


@query(f"WITH {_I}, {_F}, {_S} SELECT * FROM segs")
def block_segments(spark: SparkSession, d: str) -> DataFrame:
    _, framed, marks = _marked(spark, d)
    return layout.segments(marks, framed, WIDTH)


@query(f"WITH {_I}, {_F}, {_S} SELECT doc, page, i, block FROM items JOIN segs s USING (doc, page) WHERE top >= y0 - 1 AND bottom <= y1 + 2 AND x + least(w, 20) / 2 >= x0 AND x + least(w, 20) / 2 < x1")
def block_items(spark: SparkSession, d: str) -> DataFrame:
    """Items by the block in whose areas they lie."""
    items, framed, marks = _marked(spark, d)
    areas = layout.segments(marks, framed, WIDTH).select("doc", "page", "block", "x0", "x1", "y0", "y1")
    return layout.contained(items, areas).select("doc", "page", "i", "block")


_CUT = r"list_transform(ws, lambda w, i: w || CASE WHEN i = len(ws) OR (regexp_matches(w, '[a-zà-ú](ti|tt|ft)$') AND regexp_matches(ws[i + 1], '^[a-zà-ú]')) THEN '' ELSE ' ' END)"


@query(
    rf"""WITH b AS (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '([a-z])ti([a-z])', '\1ti \2', 'g') ELSE text END AS text FROM documents), w AS (SELECT *, string_split(text, ' ') AS ws FROM b),
j AS (SELECT *, array_to_string({_CUT}, '') AS joined FROM w), g AS (SELECT source, sum(length(text) - length(joined)) >= count(*) AS repair FROM j GROUP BY source)
SELECT doc_id, CASE WHEN repair THEN joined ELSE text END AS text FROM j JOIN g USING (source)"""
)
def ligature_repair(spark: SparkSession, d: str) -> DataFrame:
    """Words that were cut behind ti in every other document are joined where a source has at least as many as documents."""
    cut = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", "([a-z])ti([a-z])", "$1ti $2")).otherwise(F.col("text"))
    return layout.repaired(table(spark, d, "documents").select("doc_id", "source", cut.alias("text")), "source", "text").select("doc_id", "text")


@query("SELECT doc_id, replace(replace(replace(replace(regexp_replace(text, '(a)(n)', '\\1Į\\2', 'g'), 'Ě', ' '), 'Į', 'fi'), 'Ĵ', '('), 'ͳ', '-') AS text FROM documents")
def leaked_glyphs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", layout.leaked_glyphs(F.regexp_replace("text", "(a)(n)", "$1Į$2")).alias("text"))
