"""Booklets end to end. The words of conversations stand in for the items of pages: six to a line, in one column or two, with headings,
letters of alternatives, footers and covers put in between, uneven baselines, and fonts in glyph ids on some pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import booklet, classify, layout
from quillspark.plans.layout import _CUT, _F, _S
from quillspark.plans.questions import _FORMAT
from quillspark.plans.registry import query
from quillspark.session import table

WIDTH, HEIGHT = 560.0, 800.0
#: Glyph ids of the stand-in font: letters moved up by this, and one glyph of two letters.
SHIFT, LIGATURE = 0x210, 0x2A0
_PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_GLYPHS = "".join(chr(ord(c) + SHIFT) for c in _PLAIN)

#: Topics of two groups with patterns in order; one pattern can't match and keeps its place.
KEYWORDS = {
    ("specific", "able"): ["thble", "er(ble|tion)", "on", "re\\b", "(an|in)ble", "inment", "nte?", "th"],
    ("specific", "action"): ["thtion", "\x08erment", "onment", "retion", "an", "ention", "ing\\b", "ation"],
    ("general", "german"): ["nicht", "der", "und", "en", "ver|ger", "te?r", "sch", "ein"],
    ("general", "romance"): ["mente", "con", "eau", "la", "el\\b", "qu[ei]", "ar?", "de"],
}
FALLBACK = {"specific": "action", "general": "romance"}


def encoded(text: Column) -> Column:
    return F.concat(F.translate(F.replace(text, F.lit("ti"), F.lit(chr(LIGATURE))), _PLAIN, _GLYPHS), F.lit("\x01"))


def glyphs(spark: SparkSession) -> DataFrame:
    """The stand-in font's table, by its rule."""
    letters = spark.createDataFrame([(ord(c) + SHIFT, c) for c in _PLAIN] + [(LIGATURE, "ti"), (3, " ")], "code int, text string")
    return letters


def keywords(spark: SparkSession) -> DataFrame:
    rows = [(t, k, g, i, w) for k, ((g, t), words) in enumerate(KEYWORDS.items()) for i, w in enumerate(words)]
    return spark.createDataFrame(rows, "topic string, ord int, grp string, pos int, regex string")


def items(spark: SparkSession, d: str) -> DataFrame:
    """doc, page, i, font, x, w, h, baseline and str."""
    turns = table(spark, d, "conversations")
    c, i, k, two = F.col, F.col("i"), F.col("k"), lambda n: F.lpad(n.cast("string"), 2, "0")
    rows = turns.select(c("conv_id").alias("doc"), c("turn").alias("page"), F.posexplode(F.split("text", " ")).alias("i", "s"))
    rows = rows.withColumn("L", F.floor(i / 6).cast("int")).withColumn("s6", i % 6).withColumn("G", F.floor(c("L") / 7).cast("int")).withColumn("g7", c("L") % 7)
    rows = rows.withColumn("right", (c("doc") % 3 == 0) & (c("L") >= 10)).withColumn("k", (c("page") + c("G")) % 9).withColumn("num", 1 + (c("page") * 3 + c("G")) % 35)
    head, mark = c("g7") == 0, (c("g7") >= 2) & (c("s6") == 0)
    first = F.when(k == 0, "QUESTÃO DISCURSIVA").when(k == 4, "TEXTO PARA AS QUESTÕES").when(k == 7, "RASCUNHO").otherwise("QUESTÃO")
    second = F.when((k == 0) & (c("page") % 2 == 1), "3").when(k == 4, F.concat(two(c("num")), F.lit(" a "), two(c("num") + 2))).when(k.isin(0, 7), c("s")).otherwise(two(c("num")))
    own = F.when(c("doc") % 5 == 0, F.regexp_replace("s", "([a-z])ti([a-z])", "$1ti $2")).otherwise(c("s"))
    text = F.when(head & (c("s6") == 0), first).when(head & (c("s6") == 1), second).when(mark, F.substring(F.lit("ABCDE"), c("g7") - 1, F.lit(1))).otherwise(own)
    rows = rows.withColumn("str", text)
    glyph = ((c("doc") + c("page")) % 4 == 0) & (i % 3 == 1) | ((c("doc") + c("page")) % 5 == 0) & (i % 84 == 0)
    text = F.when(glyph, encoded(c("str"))).when(i % 41 == 5, F.concat("str", F.lit("Ě"))).otherwise(c("str"))
    real = lambda x: x.cast("double")
    row = F.when(c("right"), c("L") - 10).otherwise(c("L")) % 45
    base = real(60 + 13 * row) + real((i * 7) % 3 - 1) * 0.9 + F.when(i % 29 == 0, 1.5).otherwise(0.0)
    width = F.when(mark, 10.0).when(head & (c("s6") < 2), 38.0).when((i * 5) % 7 == 3, 30.0).otherwise(38.0)
    size = F.when(head, 11.0).when(i % 50 == 7, 9.0).otherwise(10.0)
    words = rows.select("doc", "page", "i", F.concat(F.lit("f"), (i % 3).cast("string")).alias("font"), real(40 + c("right").cast("int") * 260 + c("s6") * 40).alias("x"), width.alias("w"), size.alias("h"), base.alias("baseline"), text.alias("str"))
    pages = turns.select(c("conv_id").alias("doc"), c("turn").alias("page")).distinct()

    def put(where: str, i: int, x: float, w: float, baseline: float, text: str) -> DataFrame:
        return pages.where(where).select("doc", "page", F.lit(i).alias("i"), F.lit("g").alias("font"), F.lit(x).alias("x"), F.lit(w).alias("w"), F.lit(9.0).alias("h"), F.lit(baseline).alias("baseline"), F.lit(text).alias("str"))

    for place in _PUT:
        words = words.unionByName(put(*place))
    return words


_PUT = [
    ("page % 2 = 0", -1, 250.0, 60.0, 780.0, "Formação geral"),
    ("page = 0 AND doc % 2 = 1", -4, 40.0, 200.0, 30.0, "Componente Específico: Objeti"),
    ("page = 0 AND doc % 2 = 1", -3, 250.0, 60.0, 30.0, "vas 09 a 35"),
    ("page = 0 AND doc % 2 = 1", -2, 40.0, 250.0, 45.0, "Componente Específico: Discursivas D3 a D5"),
]


def lookups(spark: SparkSession, d: str) -> booklet.Lookups:
    c = F.col
    docs = table(spark, d, "conversations").select(c("conv_id").alias("doc")).distinct()
    year = (2014 + c("doc") % 10).cast("int")
    exams = docs.select("doc", F.concat_ws("-", year.cast("string"), F.concat(F.lit("c"), c("doc").cast("string"))).alias("exam"), year.alias("year"))
    nums = docs.select("doc", F.explode(F.sequence(F.lit(1), F.lit(35))).alias("num")).where("num % 13 <> 0")
    answers = nums.select("doc", "num", F.when(c("num") % 11 != 0, F.substring(F.lit("ABCDE"), (1 + (c("doc") + c("num")) % 5).cast("int"), F.lit(1))).alias("answer"))
    ids = exams.where("doc % 10 = 1").select(F.concat("exam", F.lit("-q04")).alias("id"))
    overrides = ids.select("id", F.array(F.lit("ethics"), F.lit("able")).alias("topics"), F.lit("calculation").alias("format"))
    images = exams.where("doc % 4 = 1").select(F.concat(F.lit("img/"), "exam", F.lit("/q04.webp")).alias("path"), F.lit(1150).alias("w"), (300 + c("doc") % 7).cast("int").alias("h"))
    return booklet.Lookups(exams, answers, keywords(spark), FALLBACK, glyphs(spark), overrides, images, (["NOT", "EXCEPT", "FALSE"], ["nicht", "never", "ing"]))


# SQL: each step from the one before, with folds over lists where the order of rows decides.

_NORM = r"upper(replace(trim(regexp_replace(strip_accents(lower({0})), '\s+', ' ', 'g')), 'ß', 'ss'))"
_DECODED = rf"replace(regexp_replace(replace(translate({{0}}, '{_GLYPHS}', '{_PLAIN}'), chr({LIGATURE}), 'ti'), '[\x01-\x02\x04-\x1F]', '', 'g'), chr(3), ' ')"
_KIND = r"""CASE WHEN contains({0}, 'QUESTIONARIO DE PERCEPCAO') THEN 'end' WHEN regexp_matches({0}, '^QUESTAO DISCURSIVA\s*(\d{{1,2}})?\b') THEN 'essay' WHEN regexp_matches({0}, '^QUESTAO\s+(\d{{1,2}})\b') THEN 'objective'
  WHEN regexp_matches({0}, '^TEXTO PARA (?:(?:AS )?QUESTO?E?S?|(?:A )?QUESTAO)\s+(.+)$') THEN 'shared' WHEN regexp_matches({0}, '^AREA LIVRE\b|^RASCUNHO\b') THEN 'stop' END"""
_ENCODED = f"translate(replace(str, 'ti', chr({LIGATURE})), '{_PLAIN}', '{_GLYPHS}') || chr(1)"
_PUTS = " UNION ALL ".join(f"SELECT doc, page, {i}, 'g', {x}::DOUBLE, {w}::DOUBLE, 9::DOUBLE, {b}::DOUBLE, '{t}' FROM (SELECT DISTINCT conv_id AS doc, turn AS page FROM conversations) WHERE {where}" for where, i, x, w, b, t in _PUT)

_ITEMS = rf"""w0 AS (SELECT conv_id AS doc, turn AS page, unnest(ws) AS s, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations)),
w1 AS (SELECT *, i // 6 AS L, i % 6 AS s6, i // 42 AS G, (i // 6) % 7 AS g7, doc % 3 = 0 AND i // 6 >= 10 AS "right", (page + i // 42) % 9 AS k, 1 + (page * 3 + i // 42) % 35 AS num FROM w0),
w2 AS (SELECT *, CASE WHEN g7 = 0 AND s6 = 0 THEN CASE k WHEN 0 THEN 'QUESTÃO DISCURSIVA' WHEN 4 THEN 'TEXTO PARA AS QUESTÕES' WHEN 7 THEN 'RASCUNHO' ELSE 'QUESTÃO' END
  WHEN g7 = 0 AND s6 = 1 THEN CASE WHEN k = 0 AND page % 2 = 1 THEN '3' WHEN k = 4 THEN lpad(CAST(num AS VARCHAR), 2, '0') || ' a ' || lpad(CAST(num + 2 AS VARCHAR), 2, '0') WHEN k IN (0, 7) THEN s ELSE lpad(CAST(num AS VARCHAR), 2, '0') END
  WHEN g7 >= 2 AND s6 = 0 THEN substr('ABCDE', CAST(g7 - 1 AS INTEGER), 1) WHEN doc % 5 = 0 THEN regexp_replace(s, '([a-z])ti([a-z])', '\1ti \2', 'g') ELSE s END AS str FROM w1),
w3 AS (SELECT doc, page, CAST(i AS BIGINT) AS i, 'f' || i % 3 AS font, CAST(40 + CASE WHEN "right" THEN 260 ELSE 0 END + s6 * 40 AS DOUBLE) AS x,
  CAST(CASE WHEN g7 >= 2 AND s6 = 0 THEN 10 WHEN g7 = 0 AND s6 < 2 THEN 38 WHEN (i * 5) % 7 = 3 THEN 30 ELSE 38 END AS DOUBLE) AS w, CAST(CASE WHEN g7 = 0 THEN 11 WHEN i % 50 = 7 THEN 9 ELSE 10 END AS DOUBLE) AS h,
  CAST(60 + 13 * (CASE WHEN "right" THEN L - 10 ELSE L END % 45) AS DOUBLE) + CAST((i * 7) % 3 - 1 AS DOUBLE) * 0.9::DOUBLE + CASE WHEN i % 29 = 0 THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END AS baseline,
  CASE WHEN (doc + page) % 4 = 0 AND i % 3 = 1 OR (doc + page) % 5 = 0 AND i % 84 = 0 THEN {_ENCODED} WHEN i % 41 = 5 THEN str || 'Ě' ELSE str END AS str FROM w2),
raw AS (SELECT * FROM w3 UNION ALL {_PUTS})"""

_RUNS = rf"""ft AS (SELECT *, sum(length(bare)) OVER f AS chars, sum(length(bare) - length(regexp_replace(bare, '[\x01-\x1F\x{{0100}}-\x{{03FF}}]', '', 'g'))) OVER f AS odd FROM (SELECT *, regexp_replace(str, '\s', '', 'g') AS bare FROM raw) WINDOW f AS (PARTITION BY doc, page, font)),
dc AS (SELECT doc, page, i, x, w, h, baseline, CASE WHEN chars >= 3 AND odd >= 0.5 * chars THEN {_DECODED.format("str")} ELSE replace(replace(replace(replace(str, 'Ě', ' '), 'Į', 'fi'), 'Ĵ', '('), 'ͳ', '-') END AS str FROM ft),
pg AS (SELECT doc, page, list({{'b': baseline, 'x': x, 'i': i, 'w': w, 'h': h, 'str': str}} ORDER BY baseline, x, i) AS its FROM dc WHERE regexp_matches(str, '\S') GROUP BY doc, page),
gr AS (SELECT doc, page, its, list_reduce(list_transform(its, lambda e: e.b), lambda acc, b: {{'a': CASE WHEN acc.a IS NULL OR b - acc.a > 2 THEN b ELSE acc.a END, 'n': acc.n + CASE WHEN acc.a IS NULL OR b - acc.a > 2 THEN 1 ELSE 0 END,
  'out': list_append(acc.out, acc.n + CASE WHEN acc.a IS NULL OR b - acc.a > 2 THEN 1 ELSE 0 END)}}, {{'a': NULL::DOUBLE, 'n': -1, 'out': []::INTEGER[]}}).out AS grps FROM pg),
un AS (SELECT doc, page, e.b AS b, e.x AS x, e.i AS i, e.w AS w, e.h AS h, e.str AS str, grp FROM (SELECT doc, page, unnest(its) AS e, unnest(grps) AS grp FROM gr)),
gp AS (SELECT *, x - lag(x + w) OVER o AS gap, suffix(lag(str) OVER o, ' ') OR prefix(str, ' ') AS blank, min(b) OVER (PARTITION BY doc, page, grp) AS line FROM un WINDOW o AS (PARTITION BY doc, page, grp ORDER BY x, b, i)),
rn AS (SELECT *, coalesce(gap >= greatest(3, 0.7::DOUBLE * h), true) AS new FROM gp),
ru AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY doc, page, grp ORDER BY x, b, i) AS run FROM rn),
rs AS (SELECT doc, page, CAST(grp AS BIGINT) * 1048576 + run AS i, min(x) AS x, last(x + w ORDER BY x, b, i) - min(x) AS w, max(h) AS h, min(line) AS baseline,
  trim(regexp_replace(string_agg(CASE WHEN NOT new AND gap > 0.15::DOUBLE * h AND NOT blank THEN ' ' ELSE '' END || str, '' ORDER BY x, b, i), '\s+', ' ', 'g')) AS str FROM ru GROUP BY doc, page, grp, run)"""

_REPAIRED = rf"""jn AS (SELECT *, array_to_string({_CUT}, '') AS joined FROM (SELECT *, string_split(str, ' ') AS ws FROM rs)),
gt AS (SELECT doc, sum(length(str) - length(joined)) >= count(DISTINCT page) AS repair FROM jn GROUP BY doc),
fx AS (SELECT doc, page, i, x, w, h, baseline, CASE WHEN repair THEN joined ELSE str END AS str, baseline - 0.9::DOUBLE * h AS top, baseline + 0.25::DOUBLE * h AS bottom FROM jn JOIN gt USING (doc)),
nm AS (SELECT *, {_NORM.format("str")} AS n, {_NORM.format(_DECODED.format("str"))} AS again FROM fx),
items AS (SELECT doc, page, i, x, w, h, baseline, str, top, bottom, CASE WHEN {_KIND.format("n")} IS NULL AND {_KIND.format("again")} IS NOT NULL THEN again ELSE n END AS norm FROM nm)"""

_BLOCKS = r"""ob AS (SELECT st.doc, st.block, st.kind, st.page, st.i, CASE WHEN st.kind = 'essay' THEN TRY_CAST(regexp_extract(norm, '^QUESTAO DISCURSIVA\s*(\d{1,2})?\b', 1) AS INTEGER) ELSE st.num END AS num, norm FROM st JOIN items USING (doc, page, i) WHERE st.kind NOT IN ('stop', 'end') AND st.ended = 0),
nb AS (SELECT doc, block, kind, page, CASE WHEN kind = 'essay' THEN coalesce(num, CAST(count(*) FILTER (kind = 'essay' AND num IS NULL) OVER (PARTITION BY doc ORDER BY block) AS INTEGER)) ELSE num END AS num,
  CASE WHEN kind = 'shared' THEN CAST(regexp_extract(norm, '(\d{1,2})\s*A\s*(\d{1,2})', 1) AS INTEGER) END AS n1, CASE WHEN kind = 'shared' THEN CAST(regexp_extract(norm, '(\d{1,2})\s*A\s*(\d{1,2})', 2) AS INTEGER) END AS n2 FROM ob),
gn AS (SELECT doc, page, contains(replace(upper(strip_accents(lower(footer_text))), ' ', ''), 'FORMACAOGERAL') AS general FROM frames), na AS (SELECT doc, bool_or(general) AS named FROM gn GROUP BY doc),
cv AS (SELECT doc, regexp_replace(string_agg(norm, ' ' ORDER BY i), 'TI ([A-Z])', 'TI\1', 'g') AS t FROM items JOIN (SELECT doc, min(page) AS page FROM items GROUP BY doc) USING (doc, page) GROUP BY doc),
cr AS (SELECT doc, regexp_matches(t, 'COMPONENTE ESPECIFICO: OBJETIVAS 09 A 35') AS covered FROM cv),
bl AS (SELECT doc, block, kind, page, num, n1, n2, CASE WHEN CASE WHEN named THEN NOT general WHEN covered THEN CASE kind WHEN 'essay' THEN num BETWEEN 3 AND 5 WHEN 'objective' THEN num >= 9 ELSE n1 >= 9 END ELSE true END THEN 'specific' ELSE 'general' END AS section
  FROM nb JOIN gn USING (doc, page) JOIN na USING (doc) JOIN cr USING (doc)),
ls AS (SELECT s.doc, s.block, row_number() OVER (PARTITION BY s.doc, s.block ORDER BY page, col, y0, i) - 1 AS pos, str AS line FROM items JOIN segs s USING (doc, page) WHERE top >= y0 - 1 AND bottom <= y1 + 2 AND x + least(w, 20) / 2 >= x0 AND x + least(w, 20) / 2 < x1)"""

_PARTS = rf"""bd AS (SELECT ls.doc, ls.block, pos, line, regexp_extract(line, '^([A-E])(?:\s|$)', 1) AS k FROM ls JOIN bl USING (doc, block) WHERE kind = 'objective' AND NOT (pos = 0 AND regexp_matches({_NORM.format("line")}, '^QUEST'))),
af AS (SELECT doc, block, pos, k, min(pos) FILTER (k = 'B') OVER w AS b, min(pos) FILTER (k = 'C') OVER w AS c, min(pos) FILTER (k = 'D') OVER w AS d, min(pos) FILTER (k = 'E') OVER w AS e
  FROM bd WHERE k <> '' WINDOW w AS (PARTITION BY doc, block ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
rw AS (SELECT a.doc, a.block, a.pos AS a, a.b, b.c, c.d, d.e FROM af a JOIN af b ON b.doc = a.doc AND b.block = a.block AND b.pos = a.b JOIN af c ON c.doc = a.doc AND c.block = a.block AND c.pos = b.c JOIN af d ON d.doc = a.doc AND d.block = a.block AND d.pos = c.d WHERE a.k = 'A'),
fw AS (SELECT * FROM rw QUALIFY row_number() OVER (PARTITION BY doc, block ORDER BY a DESC) = 1),
mw AS (SELECT bd.doc, bd.block, pos, line, CASE WHEN a IS NULL OR pos < a THEN 0 WHEN pos < b THEN 1 WHEN pos < c THEN 2 WHEN pos < d THEN 3 WHEN e IS NULL OR pos < e THEN 4 ELSE 5 END AS part, pos IN (a, b, c, d, e) AS head FROM bd LEFT JOIN fw USING (doc, block)),
pw AS (SELECT doc, block, part, CASE WHEN part = 0 THEN string_agg(line, chr(10) ORDER BY pos) ELSE trim(regexp_replace(string_agg(CASE WHEN head THEN regexp_replace(line, '^[A-E]\s*', '') ELSE line END, ' ' ORDER BY pos), '\s+', ' ', 'g')) END AS t FROM mw GROUP BY doc, block, part),
sp2 AS (SELECT doc, block, coalesce(max(t) FILTER (part = 0), '') AS statement, coalesce(list(t ORDER BY part) FILTER (part > 0), []) AS alternatives FROM pw GROUP BY doc, block),
wh AS (SELECT doc, block, string_agg(line, chr(10) ORDER BY pos) AS t, string_agg(line, ' ' ORDER BY pos) AS flat FROM ls GROUP BY doc, block),
ex AS (SELECT DISTINCT conv_id AS doc, (2014 + conv_id % 10) || '-c' || conv_id AS exam_id, CAST(2014 + conv_id % 10 AS INTEGER) AS year FROM conversations),
sh AS (SELECT bl.doc, bl.block, exam_id || '-t' || array_to_string(list_transform(range(n1, n2 + 1), lambda n: lpad(CAST(n AS VARCHAR), 2, '0')), '-') AS id, coalesce(flat, '') AS flat, unnest(range(n1, n2 + 1)) AS num FROM bl JOIN ex USING (doc) LEFT JOIN wh USING (doc, block) WHERE kind = 'shared'),
sq AS (SELECT doc, num, string_agg(id, ',' ORDER BY block) AS shared_texts, string_agg(flat, ' ' ORDER BY block) AS shared_text FROM sh GROUP BY doc, num),
qs AS (SELECT bl.doc, bl.block, bl.kind, bl.num, bl.section, bl.page, exam_id, year, exam_id || CASE bl.kind WHEN 'objective' THEN '-q' || lpad(CAST(bl.num AS VARCHAR), 2, '0') ELSE '-d' || bl.num END AS id,
  regexp_replace(CASE WHEN bl.kind = 'objective' THEN coalesce(sp2.statement, '') ELSE regexp_replace(coalesce(wh.t, ''), '(?i)^QUEST\S+ DISCURSIVA\s*\d*\s*', '') END, '(?i)^QUEST\S+\s+\d+\s*', '') AS statement,
  CAST(coalesce(sp2.alternatives, []) AS VARCHAR[]) AS alternatives, CASE WHEN bl.kind = 'objective' THEN shared_texts END AS shared_texts, CASE WHEN bl.kind = 'objective' THEN shared_text END AS shared_text
  FROM bl JOIN ex USING (doc) LEFT JOIN sp2 USING (doc, block) LEFT JOIN wh USING (doc, block) LEFT JOIN sq ON sq.doc = bl.doc AND sq.num = bl.num WHERE bl.kind <> 'shared')"""


def _score(topic: str, words: list[str]) -> str:
    terms = [f"{3.0 if i < 6 else 2.0}::DOUBLE * pow(least(3, len(regexp_extract_all(folded, '(^|[^a-z]){w}')))::DOUBLE, 0.7::DOUBLE)" for i, w in enumerate(words)]
    return f"({' + '.join(terms)}) AS s_{topic}"


_SCORES = ", ".join(_score(t, [w.replace("\x08", "\\x08") for w in words]) for (_, t), words in KEYWORDS.items())
_LISTED = ", ".join(f"{{'t': '{t}', 'g': '{g}', 'o': {k}, 's': s_{t}}}" for k, (g, t) in enumerate(KEYWORDS))
_TOPICS = f"""tx AS (SELECT doc, block, section, strip_accents(lower(concat_ws(' ', shared_text, statement, array_to_string(alternatives, ' ')))) AS folded FROM qs),
sc AS (SELECT doc, block, section, {_SCORES} FROM tx), us AS (SELECT doc, block, section, unnest([{_LISTED}]) AS v FROM sc),
rk AS (SELECT doc, block, v.t AS t, v.s AS s, row_number() OVER o AS r, first_value(v.s) OVER o AS top FROM us WHERE v.s > 0 AND v.g = section WINDOW o AS (PARTITION BY doc, block ORDER BY v.s DESC, v.o)),
tp AS (SELECT doc, block, string_agg(t, '+' ORDER BY r) AS topics FROM rk WHERE r = 1 OR (r = 2 AND s >= 0.6::DOUBLE * top AND s >= 4) GROUP BY doc, block)"""

_LINES_SQL = f"WITH {_ITEMS}, {_RUNS}"
_ALL = f"WITH {_ITEMS}, {_RUNS}, {_REPAIRED}, {_F}, {_S}, {_BLOCKS}, {_PARTS}, {_TOPICS}"


@query(f"{_LINES_SQL} SELECT doc, page, i, x, w, h, baseline, str FROM rs")
def decoded_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of all pages: fonts decoded by their share of glyph ids, lines by their first baseline, runs by gaps within a line."""
    found = layout.page_runs(layout.decoded(items(spark, d), layout.glyph_decoder(glyphs(spark))))
    return found.select("doc", "page", "i", "x", "w", "h", "baseline", "str")


_FIRST_FIT = """list_reduce(its, lambda acc, e: CASE WHEN len(list_filter(acc.open, lambda l: abs(l.b - e.baseline) <= 2 AND abs(l.x - e.x) < 400)) = 0 OR e.x <= list_filter(acc.open, lambda l: abs(l.b - e.baseline) <= 2 AND abs(l.x - e.x) < 400)[1].x - 300
  THEN {'open': list_append(acc.open, {'b': e.baseline, 'x': e.x, 'n': CAST(len(acc.open) AS BIGINT)}), 'out': list_append(acc.out, CAST(len(acc.open) AS BIGINT))}
  ELSE {'open': acc.open, 'out': list_append(acc.out, list_filter(acc.open, lambda l: abs(l.b - e.baseline) <= 2 AND abs(l.x - e.x) < 400)[1].n)} END, {'open': []::STRUCT(b DOUBLE, x DOUBLE, n BIGINT)[], 'out': []::BIGINT[]}).out"""


@query(
    f"""{_LINES_SQL}, la AS (SELECT doc, page, list({{'baseline': baseline, 'x': x, 'i': i, 'str': str}} ORDER BY i) AS its FROM rs GROUP BY doc, page),
lb AS (SELECT doc, page, unnest(its) AS e, unnest({_FIRST_FIT}) AS line FROM la)
SELECT doc, page, line, trim(regexp_replace(string_agg(e.str, ' ' ORDER BY e.x, e.i), '\\s+', ' ', 'g')) AS text FROM lb GROUP BY doc, page, line"""
)
def assembled_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of all pages, each put together from runs by first fit to the lines opened so far."""
    found = layout.page_runs(layout.decoded(items(spark, d), layout.glyph_decoder(glyphs(spark))))
    rows = found.select("doc", F.col("page").alias("of_page"), "page", F.col("i").alias("place"), "x", "baseline", "str")
    put = layout.line_texts(layout.assembled(rows, ["doc", "of_page"], ["place"]), ["doc", "of_page"])
    return put.select("doc", F.col("of_page").alias("page"), "line", "text")


_IN = "CASE WHEN kind = 'objective' THEN {} ELSE {} END"


@query(
    rf"""{_ALL}, ky AS (SELECT DISTINCT conv_id AS doc, unnest(range(1, 36)) AS num FROM conversations),
an AS (SELECT doc, num, CASE WHEN num % 11 <> 0 THEN substr('ABCDE', CAST(1 + (doc + num) % 5 AS INTEGER), 1) END AS answer, true AS known FROM ky WHERE num % 13 <> 0),
n AS (SELECT *, strip_accents(lower(statement)) AS f, list_transform(alternatives, lambda a: strip_accents(lower(a))) AS plain FROM qs),
o AS (SELECT n.*, {_IN.format(_FORMAT, "'essay'")} AS fmt, kind = 'objective' AND (regexp_matches(right(statement, 400), '\b(NOT|EXCEPT|FALSE)\b') OR regexp_matches(strip_accents(lower(right(statement, 400))), '\b(nicht|never|ing)\b')) AS negative FROM n)
SELECT o.id, exam_id, year, kind, o.num, section, page, 'img/' || exam_id || '/' || substr(o.id, length(exam_id) + 2) || '.webp' AS img,
  CAST(CASE WHEN o.doc % 4 = 1 AND o.id = exam_id || '-q04' THEN 1150 END AS INTEGER) AS w, CAST(CASE WHEN o.doc % 4 = 1 AND o.id = exam_id || '-q04' THEN 300 + o.doc % 7 END AS INTEGER) AS h, statement,
  array_to_string(list_transform(alternatives, lambda a, i: substr('ABCDE', CAST(i AS INTEGER), 1) || ':' || a), '|') AS alternatives, CASE WHEN kind = 'objective' THEN answer END AS answer, kind = 'objective' AND coalesce(known, false) AND answer IS NULL AS annulled,
  coalesce(shared_texts, '') AS shared_texts, CASE WHEN o.doc % 10 = 1 AND o.id = exam_id || '-q04' THEN 'ethics+able' ELSE coalesce(topics, CASE section WHEN 'specific' THEN 'action' ELSE 'romance' END) END AS topics,
  CASE WHEN o.doc % 10 = 1 AND o.id = exam_id || '-q04' THEN 'calculation' ELSE fmt END AS format, negative
FROM o LEFT JOIN tp USING (doc, block) LEFT JOIN an ON an.doc = o.doc AND an.num = o.num"""
)
def booklet_questions(spark: SparkSession, d: str) -> DataFrame:
    """Every question of every booklet with all its attributes, from the items of the pages on."""
    tables = lookups(spark, d)
    rows = booklet.question_table(booklet.parse(items(spark, d), tables, WIDTH, HEIGHT), tables)
    flat = F.array_join(F.transform("alternatives", lambda a: F.concat_ws(":", a["letter"], a["text"])), "|").alias("alternatives")
    return rows.select("id", "exam_id", "year", "kind", "num", "section", "page", "img", "w", "h", "statement", flat, "answer", "annulled", F.array_join("shared_texts", ",").alias("shared_texts"), F.array_join("topics", "+").alias("topics"), "format", "negative")


@query(
    f"""WITH tx AS (SELECT doc_id AS doc, 0 AS block, CASE WHEN lang IN ('en', 'de') THEN 'specific' ELSE 'general' END AS section, strip_accents(lower(text)) AS folded FROM documents),
{_TOPICS[_TOPICS.index("sc AS") :]} SELECT doc AS doc_id, coalesce(topics, CASE section WHEN 'specific' THEN 'action' ELSE 'romance' END) AS topics FROM tx LEFT JOIN tp USING (doc, block)"""
)
def topics_of_group(spark: SparkSession, d: str) -> DataFrame:
    """Topics of whole documents by a table of keywords, among those of the document's own group."""
    group = F.when(F.col("lang").isin("en", "de"), "specific").otherwise("general")
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), group.alias("grp"), T.fold(F.col("text")).alias("folded"))
    return classify.topics_by_table(texts, keywords(spark), FALLBACK).select(F.col("id").alias("doc_id"), F.array_join("topics", "+").alias("topics"))
