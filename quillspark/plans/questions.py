"""Questions made from documents: a phrase before the text makes the statement, and eight sets of alternatives take turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import questions, search, statistics, study
from quillspark.plans.registry import query
from quillspark.session import table

PHRASES = ["", "Avalie. ", "Considere. ", "Associe. ", "Observe o trecho de código. ", "Calcule. ", "Leia o texto. ", ""]
ALTERNATIVES = [
    ["As asserções I e II são proposições verdadeiras, e a II é uma justificativa da I.", "As asserções I e II são verdadeiras, mas a II não justifica.", "A asserção I é uma proposição verdadeira, e a II é uma proposição falsa.", "A asserção I é uma proposição falsa, e a II é uma proposição verdadeira.", "As asserções I e II são proposições falsas."],
    ["I, apenas.", "I e III, apenas.", "I, II e III", "II.", "outra"],
    ["V - F - V", "V, V, F", "F F V.", "V–V–V", "F,F,F"],
    ["1 - a", "2 - b", "AB, CD, EF", "I - x", "IV – 2"],
    ["uma", "duas", "três", "quatro", "cinco"],
    ["12,5 m", "3", "40 %", "5 kV", "6 × 2"],
    ["uma", "duas", "três", "quatro", "cinco"],
    [],
]


def _of(values: list, k: Column) -> Column:
    lit = lambda x: F.array(*map(F.lit, x)).cast("array<string>") if isinstance(x, list) else F.lit(x)
    return F.get(F.array(*map(lit, values)), (k % len(values)).cast("int"))


def _sql(values: list) -> str:
    return "[" + ", ".join(_sql(x) if isinstance(x, list) else f"'{x}'" for x in values) + "]"


def _questions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", "lang", "source", F.concat(_of(PHRASES, k), F.col("text")).alias("statement"), _of(ALTERNATIVES, k).alias("alternatives"))


_Q = f"q AS (SELECT doc_id, lang, source, ({_sql(PHRASES)})[1 + doc_id % 8] || text AS statement, CAST({_sql(ALTERNATIVES)} AS VARCHAR[][])[1 + doc_id % 8] AS alternatives FROM documents)"


def _most(condition: str) -> str:
    return f"(len(alternatives) > 0 AND len(list_filter(alternatives, lambda a: {condition})) >= len(alternatives) - 1)"


def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_FORMAT = f"""CASE WHEN len(list_filter(plain, lambda a: contains(a, 'as assercoes i e ii'))) > 0 OR (regexp_matches(statement, '\\bPORQUE\\b') AND contains(f, 'assercoes')) THEN 'assertion-reason'
WHEN {_most(f"regexp_matches(a, {_re(questions.ROMAN)})")} THEN 'statements' WHEN {_most(f"regexp_matches(a, {_re(questions.TRUE_FALSE)})")} THEN 'true-false' WHEN {_most(f"regexp_matches(a, {_re(questions.MATCHING)})")} THEN 'matching'
WHEN regexp_matches(f, {_re(questions.CODE_PHRASE)}) OR len(list_distinct(regexp_extract_all(f, {_re(questions.CODE_SYNTAX)}))) >= 2 OR len(list_filter(plain, lambda a: regexp_matches(a, {_re(questions.CODE_ALTERNATIVE)}))) >= 2 THEN 'code'
WHEN {_most(f"regexp_matches(a, {_re(questions.NUMERIC)}) AND regexp_matches(a, '[0-9]')")} THEN 'calculation' WHEN regexp_matches(f, {_re(questions.INTERPRETED)}) THEN 'interpretation' ELSE 'conceptual' END"""
_FORMATS = f"{_Q}, n AS (SELECT *, strip_accents(lower(statement)) AS f, list_transform(alternatives, lambda a: strip_accents(lower(a))) AS plain FROM q), x AS (SELECT *, {_FORMAT} AS format FROM n)"


def _formats(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).withColumn("format", questions.detect_format(F.col("statement"), F.col("alternatives")))


@query(f"WITH {_FORMATS} SELECT doc_id, format FROM x")
def format_detect(spark: SparkSession, d: str) -> DataFrame:
    return _formats(spark, d).select("doc_id", "format")


@query(f"WITH {_FORMATS} SELECT format, count(*) AS n FROM x GROUP BY format")
def format_totals(spark: SparkSession, d: str) -> DataFrame:
    return _formats(spark, d).groupBy("format").agg(F.count("*").alias("n"))


@query(
    rf"""WITH {_Q}, a AS (SELECT doc_id, trim(regexp_replace(regexp_replace(alternatives[1 + doc_id % 4], '[.,]|apenas', '', 'g'), '\s+', ' ', 'g')) AS t FROM q WHERE len(alternatives) > 0 AND doc_id % 8 = 1 OR doc_id % 8 = 4)
SELECT CAST(len(list_filter(string_split_regex(t, '\s*(?:,|e)\s*'), lambda x: x <> '')) AS INTEGER) AS statements, count(*) AS n FROM a WHERE t <> '' GROUP BY statements"""
)
def statement_counts(spark: SparkSession, d: str) -> DataFrame:
    """Statements that the answers name, by the rule that only `e` parts them."""
    k = F.col("doc_id")
    rows = _questions(spark, d).where((k % 8).isin(1, 4)).select(questions.statement_count(F.get("alternatives", (k % 4).cast("int"))).alias("statements"))
    return rows.where("statements IS NOT NULL").groupBy("statements").agg(F.count("*").alias("n"))


_OUTCOME = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{k}'" for p, k in questions.OUTCOMES)


@query(rf"WITH {_Q}, a AS (SELECT regexp_replace(strip_accents(lower(alternatives[1 + (doc_id // 8) % 5])), '[\s,]', '', 'g') AS t FROM q WHERE doc_id % 8 IN (0, 4)) SELECT CASE {_OUTCOME} ELSE 'other' END AS outcome, count(*) AS n FROM a GROUP BY outcome")
def assertion_outcomes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    rows = _questions(spark, d).where((k % 8).isin(0, 4))
    return rows.groupBy(questions.outcome(F.get("alternatives", (F.floor(k / 8) % 5).cast("int"))).alias("outcome")).agg(F.count("*").alias("n"))


@query(
    rf"""WITH {_Q}, s AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS shared FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT doc_id, source || '-' || CASE doc_id % 3 WHEN 0 THEN 'q' || lpad(CAST(1 + doc_id % 35 AS VARCHAR), 2, '0') WHEN 1 THEN 'd' || (1 + doc_id % 35) ELSE 't' || lpad(CAST(1 + doc_id % 35 AS VARCHAR), 2, '0') || '-' || lpad(CAST(2 + doc_id % 35 AS VARCHAR), 2, '0') END AS id,
  upper(left(source, 1)) || substr(source, 2) AS title, concat_ws(' ', shared, statement, array_to_string(alternatives, ' ')) AS classified, strip_accents(lower(concat_ws(' ', statement, array_to_string(alternatives, ' '), shared))) AS searched
FROM q LEFT JOIN s ON q.doc_id = s.conv_id"""
)
def question_rows(spark: SparkSession, d: str) -> DataFrame:
    """Identifier, title, and the texts that are classified and searched, with the shared text of the same number."""
    turns = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    shared = turns.select("conv_id", F.array_join(F.transform("t", lambda t: t["text"]), " ").alias("shared"))
    rows = _questions(spark, d).join(shared, F.col("doc_id") == F.col("conv_id"), "left")
    k, alternatives = F.col("doc_id"), F.array_join("alternatives", " ")
    kind, num = F.when(k % 3 == 0, "objective").when(k % 3 == 1, "essay").otherwise("shared"), (1 + k % 35).cast("int")
    nums = F.when(k % 3 == 2, F.array(num, num + 1)).otherwise(F.array(num))
    return rows.select("doc_id", questions.identifier(F.col("source"), kind, nums).alias("id"), questions.title(F.col("source"), {}).alias("title"), F.concat_ws(" ", "shared", "statement", alternatives).alias("classified"), T.fold(F.concat_ws(" ", "statement", alternatives, "shared")).alias("searched"))


_LETTERS = "ABCDEFG"
_LINES = rf"""w AS (SELECT doc_id, string_split_regex(trim(text), '\s+') AS ws FROM documents), l AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM w),
n AS (SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN substr('{_LETTERS}', CAST(1 + (doc_id + pos * (pos // 3) + length(w)) % 7 AS INTEGER), 1) || ' ' ELSE '' END || w AS line FROM l),
s AS (SELECT doc_id, pos, line, regexp_extract(line, '^([A-E])(?:\s|$)', 1) AS k FROM n)"""


@query(
    rf"""WITH {_LINES}, after AS (SELECT doc_id, pos, k, min(pos) FILTER (k = 'B') OVER w AS b, min(pos) FILTER (k = 'C') OVER w AS c, min(pos) FILTER (k = 'D') OVER w AS d, min(pos) FILTER (k = 'E') OVER w AS e
  FROM s WHERE k <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
r AS (SELECT a.doc_id, a.pos AS a, a.b, b.c, c.d, d.e FROM after a JOIN after b ON b.doc_id = a.doc_id AND b.pos = a.b JOIN after c ON c.doc_id = a.doc_id AND c.pos = b.c JOIN after d ON d.doc_id = a.doc_id AND d.pos = c.d WHERE a.k = 'A'),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) = 1),
m AS (SELECT s.doc_id, pos, line, CASE WHEN a IS NULL OR pos < a THEN 0 WHEN pos < b THEN 1 WHEN pos < c THEN 2 WHEN pos < d THEN 3 WHEN e IS NULL OR pos < e THEN 4 ELSE 5 END AS part, pos IN (a, b, c, d, e) AS head FROM s LEFT JOIN f USING (doc_id)),
p AS (SELECT doc_id, part, CASE WHEN part = 0 THEN string_agg(line, chr(10) ORDER BY pos) ELSE trim(string_agg(CASE WHEN head THEN regexp_replace(line, '^[A-E]\s*', '') ELSE line END, ' ' ORDER BY pos)) END AS t FROM m GROUP BY doc_id, part)
SELECT doc_id, coalesce(max(t) FILTER (part = 0), '') AS statement, coalesce(string_agg(t, '|' ORDER BY part) FILTER (part > 0), '') AS alternatives FROM p GROUP BY doc_id"""
)
def question_parts(spark: SparkSession, d: str) -> DataFrame:
    """Statement and alternatives of texts with a word to a line, of which every third begins with a letter."""
    docs = table(spark, d, "documents").select("doc_id", F.split(F.regexp_replace("text", r"^\s+|\s+$", ""), r"\s+").alias("ws"))
    letter = lambda w, i: F.substring(F.lit(_LETTERS), (1 + (F.col("doc_id") + i * F.floor(i / 3) + F.length(w)) % 7).cast("int"), F.lit(1))
    lines = F.transform("ws", lambda w, i: F.when(i % 3 == 0, F.concat(letter(w, i), F.lit(" "), w)).otherwise(w))
    parts = docs.select("doc_id", lines.alias("lines")).select("doc_id", questions.split_question(F.col("lines")).alias("q"))
    return parts.select("doc_id", "q.statement", F.array_join("q.alternatives", "|").alias("alternatives"))


@query(
    """WITH o AS (SELECT o_custkey, CASE WHEN o_orderkey % 7 > 0 THEN substr('ABCDE', CAST(1 + o_orderkey % 5 AS INTEGER), 1) END AS answer FROM orders)
SELECT c_custkey, count(*) FILTER (answer = 'A') AS n_a, count(*) FILTER (answer = 'B') AS n_b, count(*) FILTER (answer = 'C') AS n_c, count(*) FILTER (answer = 'D') AS n_d, count(*) FILTER (answer = 'E') AS n_e, count(answer) AS n FROM customer LEFT JOIN o ON c_custkey = o_custkey GROUP BY c_custkey"""
)
def letter_grid(spark: SparkSession, d: str) -> DataFrame:
    """Answers by letter for every customer, as exams; those without answers have zeros."""
    k = F.col("o_orderkey")
    answer = F.when(k % 7 > 0, F.substring(F.lit("ABCDE"), (1 + k % 5).cast("int"), F.lit(1)))
    return statistics.letter_grid(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), answer.alias("answer")), "c_custkey", "answer", list("ABCDE"))


@query(
    """WITH s AS (SELECT vec_id, unnest([vec_id, vec_id * 2, 1000000000]) AS doc, unnest([0, 1, 2]) AS pos FROM embeddings)
SELECT vec_id, string_agg(coalesce(left(text, 12), ''), '|' ORDER BY pos) AS texts FROM s LEFT JOIN documents ON doc = doc_id GROUP BY vec_id"""
)
def texts_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Texts of a list of ids, in the list's order; an unknown id gives an empty text."""
    k = F.col("vec_id")
    ids = table(spark, d, "embeddings").select("vec_id", F.posexplode_outer(F.array(k, k * 2, F.lit(1_000_000_000).cast("long"))).alias("pos", "doc"))
    met = ids.join(table(spark, d, "documents").select("doc_id", F.left("text", F.lit(12)).alias("t")), F.col("doc") == F.col("doc_id"), "left")
    each = F.sort_array(F.collect_list(F.struct("pos", F.coalesce("t", F.lit("")).alias("t"))))
    return met.groupBy("vec_id").agg(each.alias("x")).select("vec_id", F.array_join(F.transform("x", lambda x: x["t"]), "|").alias("texts"))


@query("SELECT c_custkey, n_name || ' (' || r_name || ')' AS label FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dimension_labels(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat("n_name", F.lit(" ("), "r_name", F.lit(")")).alias("label"))


@query("SELECT user_id, event_id, lag(event_id) OVER w AS previous, lead(event_id) OVER w AS following FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def session_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return study.neighbours(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"], "event_id")


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS text FROM documents")
def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.escape(F.col("text")).alias("text"))


_URL = "CASE page_id % 6 WHEN 0 THEN '/provas/' || y || '/12_ciencia_da_computacao.pdf' WHEN 1 THEN '/' || y || '_pv_bacharelado_engenharia_software_' || page_id % 4 || '.pdf' WHEN 2 THEN '/' || y || '_GB_1_a_3_fisica_licenciatura.pdf' WHEN 3 THEN '/gabaritos/' || y || '/gab_design_' || page_id % 3 || '.pdf' WHEN 4 THEN '/' || y || '_pv_superampliada.pdf' ELSE '/' || y || '_discursiva_design%20novo+.PDF' END"
_FILES = f"f AS (SELECT page_id AS seq, y AS year, url || {_URL} AS url, page_id % 6 AS k, page_id FROM (SELECT page_id, 2014 + page_id % 10 AS y, regexp_extract(url, '^https?://[^/]+') AS url FROM pages))"


def _files(spark: SparkSession, d: str, first: int = 2014, last: int = 2023) -> DataFrame:
    """Files of the years asked for."""
    k, y = F.col("page_id"), F.col("year").cast("string")
    tail = [F.concat(F.lit("/provas/"), y, F.lit("/12_ciencia_da_computacao.pdf")), F.concat(F.lit("/"), y, F.lit("_pv_bacharelado_engenharia_software_"), (k % 4).cast("string"), F.lit(".pdf")), F.concat(F.lit("/"), y, F.lit("_GB_1_a_3_fisica_licenciatura.pdf")), F.concat(F.lit("/gabaritos/"), y, F.lit("/gab_design_"), (k % 3).cast("string"), F.lit(".pdf")), F.concat(F.lit("/"), y, F.lit("_pv_superampliada.pdf")), F.concat(F.lit("/"), y, F.lit("_discursiva_design%20novo+.PDF"))]
    rows = table(spark, d, "pages").withColumn("year", 2014 + k % 10).where(F.col("year").between(first, last))
    return rows.select(k.alias("seq"), "year", F.concat(F.regexp_extract("url", "^https?://[^/]+", 0), F.get(F.array(*tail), (k % 6).cast("int"))).alias("url"))


_DESCRIBED = f"""{_FILES}, g AS (SELECT seq, year, CASE k WHEN 0 THEN '12_ciencia_da_computacao.pdf' WHEN 1 THEN year || '_pv_bacharelado_engenharia_software_' || page_id % 4 || '.pdf' WHEN 2 THEN year || '_GB_1_a_3_fisica_licenciatura.pdf' WHEN 3 THEN 'gab_design_' || page_id % 3 || '.pdf' ELSE year || '_discursiva_design novo+.PDF' END AS file,
CASE k WHEN 0 THEN 'exam' WHEN 1 THEN 'exam' WHEN 2 THEN 'answerKey' WHEN 3 THEN 'answerKey' ELSE 'answerGuide' END AS type, CAST(CASE WHEN k <> 2 THEN 1 END AS INTEGER) AS booklet, CAST(CASE WHEN k = 2 THEN 1 END AS INTEGER) AS range_from, CAST(CASE WHEN k = 2 THEN 3 END AS INTEGER) AS range_to,
CASE k WHEN 0 THEN 'ciencia_da_computacao' WHEN 1 THEN 'engenharia_de_software' WHEN 2 THEN 'a_fisica_licenciatura' WHEN 3 THEN 'design' ELSE 'design novo+' END AS course, k < 2 AS computing, CASE k WHEN 2 THEN 'teaching' ELSE 'bachelor' END AS modality FROM f WHERE k <> 4)"""


@query(f"WITH {_DESCRIBED} SELECT * FROM g WHERE year BETWEEN 2015 AND 2021")
def file_descriptors(spark: SparkSession, d: str) -> DataFrame:
    return questions.describe_files(_files(spark, d, 2015, 2021))


@query(
    f"""WITH {_DESCRIBED}, r AS (SELECT *, row_number() OVER (PARTITION BY year, course, type ORDER BY CASE WHEN booklet = 1 THEN 0 WHEN range_from = 1 THEN 1 ELSE 2 END, seq) AS rank FROM g WHERE modality = 'bachelor')
SELECT year, course, bool_or(computing) AS computing, max(file) FILTER (rank = 1 AND type = 'exam') AS exam, max(file) FILTER (rank = 1 AND type = 'answerKey') AS "answerKey", max(file) FILTER (rank = 1 AND type = 'answerGuide') AS "answerGuide", max(file) FILTER (rank = 1 AND type = 'testMap') AS "testMap" FROM r GROUP BY year, course"""
)
def exam_selection(spark: SparkSession, d: str) -> DataFrame:
    return questions.select_exams(questions.describe_files(_files(spark, d)))


_FACETS = "FROM documents LEFT JOIN labels USING (doc_id)"


@query(
    f"""SELECT doc_id, lang, source {_FACETS} WHERE coalesce(quality, 1) <> 0 AND doc_id % 3 <> 1 AND list_has_any([source, 'size' || n_chars % 5], ['src3', 'size1', 'size2']) AND toxic IS NOT NULL AND contains(strip_accents(lower(text)), 'er')
ORDER BY md5(CAST(doc_id AS VARCHAR) || ':11'), doc_id LIMIT 60"""
)
def faceted_search(spark: SparkSession, d: str) -> DataFrame:
    """The first 60 hits of a filter by kind, topics, flags and terms in shuffled order; annulled questions never appear."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = docs.join(labels.select("doc_id", "quality"), "doc_id", "left").withColumn("annulled", F.col("quality") == 0)
    rows = rows.withColumn("kind", F.when(F.col("doc_id") % 3 == 1, "essay").otherwise("objective")).withColumn("topics", F.array("source", F.concat(F.lit("size"), (F.col("n_chars") % 5).cast("string"))))
    spec = search.FilterSpec(overlap={"topics": ["src3", "size1", "size2"]}, kind="objective", flagged=True, terms="ER", seed=11)
    return search.filtered(rows, spec, T.fold(F.col("text")), "doc_id", labels).select("doc_id", "lang", "source").limit(60)


_A = """a AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type <> 'error' THEN value >= 34.59 END AS ok, value FROM events)"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    hard = F.when(F.col("value") > 50, "hard").otherwise("easy")
    return table(spark, d, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("question"), F.when(F.col("event_type") != "error", F.col("value") >= 34.59).alias("ok"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.array("event_type", hard).alias("topics"))


@query(f"""WITH {_A}, m AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 10), t AS (SELECT user_id, ok, unnest([event_type, CASE WHEN value > 50 THEN 'hard' ELSE 'easy' END]) AS topic FROM m)
SELECT user_id AS "user", topic, count(*) AS n, count(*) FILTER (ok) AS "right", floor(100.0 * count(*) FILTER (ok) / count(*) + 0.5) AS pct FROM t GROUP BY user_id, topic""")
def mock_topics(spark: SparkSession, d: str) -> DataFrame:
    """A mock exam of each user's first ten questions by topic; a blank answer counts as wrong."""
    first = statistics.top_k(_answers(spark, d), ["user"], [F.asc("at"), F.asc("seq")], 10)
    return study.by_topic(first, "user")


@query(f"""WITH {_A}, l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1), t AS (SELECT ok, unnest([event_type, CASE WHEN value > 50 THEN 'hard' ELSE 'easy' END]) AS topic FROM l WHERE ok IS NOT NULL)
SELECT topic, count(*) AS n, count(*) FILTER (ok) AS "right", floor(100.0 * count(*) FILTER (ok) / count(*) + 0.5) AS pct FROM t GROUP BY topic""")
def accuracy_by_topics(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of the latest attempts, each counted once for every topic of its question."""
    last = study.latest(_answers(spark, d), "user", "question").where("ok IS NOT NULL")
    return study.by_topic(last)


@query(
    """WITH w AS (SELECT quality, unnest(list_distinct(list_filter(string_split_regex(regexp_replace(strip_accents(lower(text)), '[^a-z\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 5))) AS word FROM documents JOIN labels USING (doc_id)),
c AS (SELECT word, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality <> 1) AS poor FROM w GROUP BY word), t AS (SELECT sum(good) AS g, sum(poor) AS p FROM c),
o AS (SELECT word, good, poor, floor((ln((good + 0.5) / (g - good + 0.5)) - ln((poor + 0.5) / (p - poor + 0.5))) * 100 + 0.5) / 100 AS log_odds FROM c, t WHERE good + poor >= 6),
a AS (SELECT 'correct' AS side, * FROM o WHERE good >= 4 AND log_odds > 0 ORDER BY log_odds DESC, word LIMIT 18), b AS (SELECT 'distractor' AS side, * FROM o WHERE poor >= 6 AND log_odds < 0 ORDER BY log_odds, word LIMIT 18)
SELECT * FROM a UNION ALL SELECT * FROM b"""
)
def vocabulary_extremes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    odds = statistics.log_odds(statistics.document_words(docs, T.words(F.col("text")), "quality"), F.col("quality") == 1)
    return statistics.extremes(odds)
