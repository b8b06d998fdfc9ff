"""Statistics and searches on questions with alternatives. The first turn of a conversation is a statement, the next five are its
alternatives, of which one is correct."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import answers, questions, search, statistics
from quillspark.plans.corpus import STOP
from quillspark.plans.registry import query
from quillspark.session import table
from quillspark.sources import readers
from quillspark.staging import scratch

#: Words that stand in for absolute ones; several have fewer than five letters.
LISTED = ["all", "the", "ing", "and", "nicht", "der", "que", "with", "thing"]


def alternatives(spark: SparkSession, d: str) -> DataFrame:
    """q, i, text and correct; questions have two alternatives at least."""
    c = F.col
    rows = table(spark, d, "conversations").where("turn BETWEEN 1 AND 5").select(c("conv_id").alias("q"), (c("turn") - 1).alias("i"), "text")
    rows = rows.withColumn("k", F.count("*").over(Window.partitionBy("q"))).where("k >= 2")
    return rows.select("q", "i", "text", (c("i") == c("q") % c("k")).alias("correct"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    """q, exam, section, topics, format, kind, annulled and text (statement and alternatives)."""
    c = F.col
    turns = table(spark, d, "conversations").where("turn <= 5")
    each = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"])
    rows = turns.groupBy(c("conv_id").alias("q")).agg(each.alias("t")).where(F.size("t") >= 3)
    name = lambda letter, k: F.concat(F.lit(letter), k.cast("string"))
    return rows.select(
        "q", name("e", c("q") % 5).alias("exam"), F.when(c("q") % 7 < 3, "general").otherwise("specific").alias("section"), F.array(name("t", c("q") % 3), name("t", 3 + c("q") % 2), name("t", c("q") % 3)).alias("topics"),
        F.when(c("q") % 4 == 0, "statements").otherwise("conceptual").alias("format"), F.when(c("q") % 6 == 5, "essay").otherwise("objective").alias("kind"), (c("q") % 11 == 3).alias("annulled"), F.array_join("t", " ").alias("text"),
    )


def spelled(spark: SparkSession, d: str) -> DataFrame:
    """word and ord: the words of all questions as they are spelled, in order."""
    each = F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ-]{5,}"), F.lit(0))
    return asked(spark, d).select("q", F.posexplode(each).alias("pos", "word")).select("word", F.struct("q", "pos").alias("ord"))


_A = """t AS (SELECT conv_id AS q, turn, text FROM conversations WHERE turn <= 5), n AS (SELECT q, count(*) FILTER (turn > 0) AS k FROM t GROUP BY q HAVING count(*) FILTER (turn > 0) >= 2),
a AS (SELECT q, turn - 1 AS i, text, turn - 1 = q % k AS correct FROM t JOIN n USING (q) WHERE turn > 0),
q AS (SELECT q, 'e' || q % 5 AS exam, CASE WHEN q % 7 < 3 THEN 'general' ELSE 'specific' END AS section, ['t' || q % 3, 't' || (3 + q % 2)] AS topics, CASE WHEN q % 4 = 0 THEN 'statements' ELSE 'conceptual' END AS format,
  CASE WHEN q % 6 = 5 THEN 'essay' ELSE 'objective' END AS kind, q % 11 = 3 AS annulled, string_agg(text, ' ' ORDER BY turn) AS text FROM t JOIN n USING (q) GROUP BY q)"""
_W = r"list_distinct(list_filter(string_split_regex(regexp_replace(strip_accents(lower(text)), '[^a-z\s-]', ' ', 'g'), '\s+'), lambda w: length(w) >= 5 AND w NOT IN ('there', 'which', 'these')))"
_D = r"""s AS (SELECT q, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ-]{5,}')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[a-zà-ÿ-]{5,}'), 1) AS pos FROM q),
m AS (SELECT strip_accents(word) AS folded, word AS spelling FROM (SELECT word, count(*) AS c, min((q, pos)) AS first FROM s GROUP BY word) QUALIFY row_number() OVER (PARTITION BY folded ORDER BY c DESC, first) = 1)"""


@query(
    f"""WITH {_A}, {_D}, w AS (SELECT correct, unnest({_W}) AS word FROM a), c AS (SELECT word, count(*) FILTER (correct) AS good, count(*) FILTER (NOT correct) AS poor FROM w GROUP BY word), z AS (SELECT sum(good) AS g, sum(poor) AS p FROM c),
o AS (SELECT word, good, poor, floor((ln((good + 0.5) / (g - good + 0.5)) - ln((poor + 0.5) / (p - poor + 0.5))) * 100 + 0.5) / 100 AS log_odds FROM c, z WHERE good + poor >= 6),
b AS (SELECT * FROM (SELECT 'correct' AS side, * FROM o WHERE good >= 4 AND log_odds > 0 ORDER BY log_odds DESC, word LIMIT 18) UNION ALL SELECT * FROM (SELECT 'distractor' AS side, * FROM o WHERE poor >= 6 AND log_odds < 0 ORDER BY log_odds, word LIMIT 18))
SELECT side, coalesce(spelling, word) AS word, good, poor, log_odds FROM b LEFT JOIN m ON word = folded"""
)
def vocabulary_of_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """The words that speak most for correct alternatives and for distractors, as they are spelled."""
    words = statistics.document_words(alternatives(spark, d), T.words(F.col("text"), STOP), "correct")
    return statistics.displayed(statistics.extremes(statistics.log_odds(words, F.col("correct"))), "word", spelled(spark, d))


@query(
    f"""WITH {_A}, {_D}, w AS (SELECT q, topics, unnest({_W}) AS word FROM q), f AS (SELECT word, count(*) AS df FROM w GROUP BY word), u AS (SELECT unnest(topics) AS topic, word FROM w),
c AS (SELECT topic, word, count(*) AS c FROM u GROUP BY ALL), z AS (SELECT topic, count(*) AS n FROM (SELECT unnest(topics) AS topic FROM q) GROUP BY topic),
x AS (SELECT topic, word, c, floor(c / n * ln((SELECT count(*) FROM q) / df) * 1000000 + 0.5) / 1000000 AS weight FROM c JOIN z USING (topic) JOIN f USING (word) WHERE c >= 2 AND c / n >= 0.12),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY weight DESC, word) AS INTEGER) AS rank FROM x)
SELECT topic, coalesce(spelling, word) AS word, c, weight, rank FROM r LEFT JOIN m ON word = folded WHERE rank <= 12"""
)
def terms_of_topics(spark: SparkSession, d: str) -> DataFrame:
    """The terms of each topic, as they are spelled; a question has several topics."""
    rows = asked(spark, d)
    words = rows.select("topics", F.explode(F.array_distinct(T.words(F.col("text"), STOP))).alias("word"))
    frequency = words.groupBy("word").agg(F.count("*").alias("df"))
    each = words.select("word", F.explode(F.array_distinct("topics")).alias("topic"))
    sizes = rows.select(F.explode(F.array_distinct("topics")).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))
    found = statistics.topic_terms(each, "topic", sizes, frequency=frequency, whole=rows.agg(F.count("*").alias("whole")))
    return statistics.displayed(found, "word", spelled(spark, d))


_H = "[" + ", ".join(f"CASE WHEN regexp_matches(strip_accents(lower(text)), '\\b{w}\\b') THEN '{w}' END" for w in LISTED) + "]"


@query(
    f"""WITH {_A}, h AS (SELECT correct, len(list_filter({_H}, lambda w: w IS NOT NULL)) > 0 AS hit FROM a), c AS (SELECT count(*) FILTER (correct) AS correct, count(*) FILTER (NOT correct) AS distractors, count(*) FILTER (correct AND hit) AS x, count(*) FILTER (NOT correct AND hit) AS y FROM h)
SELECT CASE WHEN correct = 0 THEN 0.0 ELSE floor(100.0 * x / correct * 10.0 + 0.5) / 10.0 END AS correct_pct, CASE WHEN distractors = 0 THEN 0.0 ELSE floor(100.0 * y / distractors * 10.0 + 0.5) / 10.0 END AS distractor_pct, correct, distractors FROM c"""
)
def absolute_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """How often correct alternatives and distractors have a listed word, each alternative counted once."""
    return statistics.alternative_rates(alternatives(spark, d), statistics.whole_words(F.col("text"), LISTED))


@query(f"WITH {_A}, h AS (SELECT correct, unnest(list_filter({_H}, lambda w: w IS NOT NULL)) AS word FROM a) SELECT word, count(*) FILTER (correct) AS correct, count(*) FILTER (NOT correct) AS distractor FROM h GROUP BY word HAVING count(*) >= 3")
def absolute_alternative_words(spark: SparkSession, d: str) -> DataFrame:
    return statistics.alternative_words(alternatives(spark, d), statistics.whole_words(F.col("text"), LISTED))


_TOPICS, _EXAMS = [f"t{k}" for k in range(7)], [f"e{k}" for k in range(7)]


@query(f"WITH {_A}, u AS (SELECT exam, unnest(topics) AS topic FROM q) SELECT topic, count(*) AS n, " + ", ".join(f"count(*) FILTER (exam = '{e}') AS n_{e}" for e in _EXAMS) + " FROM u GROUP BY topic")
def topics_by_exam(spark: SparkSession, d: str) -> DataFrame:
    """Questions of each topic by exam; two of the seven topics and exams have none."""
    return statistics.topic_pivot(asked(spark, d), _TOPICS, _EXAMS)


_FORMATS = ["assertion-reason", "statements", "true-false", "matching", "code", "calculation", "interpretation", "conceptual"]
_DIMENSIONS = [("exam", e, f"Exam {e}", k, True) for k, e in enumerate(_EXAMS)] + [("section", s, s.title(), k, True) for k, s in enumerate(["specific", "general", "other"])]
_DIMENSIONS += [("topic", t, f"Topic {t}", k, False) for k, t in enumerate(_TOPICS)] + [("format", f, f.title(), k, False) for k, f in enumerate(_FORMATS)]


@query(
    f"""WITH {_A}, p AS (SELECT * FROM q WHERE NOT annulled AND kind = 'objective'), c AS (SELECT 'exam' AS facet, exam AS value, count(*) AS n FROM p GROUP BY exam UNION ALL SELECT 'section', section, count(*) FROM p GROUP BY section
UNION ALL SELECT 'format', format, count(*) FROM p GROUP BY format UNION ALL SELECT 'topic', topic, count(*) FROM (SELECT unnest(topics) AS topic FROM p) GROUP BY topic),
d(facet, value, label, ord, shown) AS (VALUES {', '.join(f"('{f}', '{v}', '{x}', {k}, {s})" for f, v, x, k, s in _DIMENSIONS)})
SELECT d.facet, d.value, label, CAST(ord AS INTEGER) AS ord, coalesce(n, 0) AS n FROM d LEFT JOIN c ON d.facet = c.facet AND d.value = c.value WHERE coalesce(n, 0) > 0 OR shown"""
)
def facets_with_zeros(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all facets over questions that aren't annulled; exams and sections without questions stay, topics and formats don't."""
    rows = asked(spark, d).where("NOT annulled AND kind = 'objective'")
    dimensions = spark.createDataFrame(_DIMENSIONS, "facet string, value string, label string, ord int, shown boolean")
    return search.facet_table(rows, dimensions, {"exam": "exam", "section": "section", "topic": "topics", "format": "format"})


@query("SELECT doc_id, length(f) AS n FROM (SELECT doc_id, strip_accents(lower(text)) AS f FROM documents) WHERE contains(f, 'ention') AND contains(f, 'able') AND contains(f, 'en')")
def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """Texts that hold all terms, by an index of runs of characters that is built from all documents first."""
    path = scratch(spark, "index")
    search.build_index(table(spark, d, "documents"), "doc_id", "text", path)
    return search.search_index(spark, path, "Ention áble EN").select(F.col("key").alias("doc_id"), F.length("folded").cast("long").alias("n"))


@query(
    """WITH e AS (SELECT n_nationkey AS id, n_name AS title FROM nation), c AS (SELECT c_nationkey AS id, list({'id': c_custkey, 'name': c_name, 'marks': [c_mktsegment, c_name]} ORDER BY c_custkey) AS l FROM customer GROUP BY c_nationkey),
s AS (SELECT s_nationkey AS id, list({'id': s_suppkey, 'text': s_name} ORDER BY s_suppkey) AS l FROM supplier GROUP BY s_nationkey)
SELECT CAST(e.id AS INTEGER) AS exam_id, CAST(to_json({'exam_id': e.id, 'title': title, 'questions': coalesce(c.l, []), 'sharedTexts': coalesce(s.l, [])}) AS VARCHAR) AS body FROM e LEFT JOIN c USING (id) LEFT JOIN s USING (id)"""
)
def nested_bundle(spark: SparkSession, d: str) -> DataFrame:
    """A JSON document for each nation with its customers and suppliers nested, as an exam's with its questions and texts."""
    c = F.col
    exams = table(spark, d, "nation").select(c("n_nationkey").alias("exam_id"), c("n_name").alias("title"))
    rows = table(spark, d, "customer").select(c("c_nationkey").alias("exam_id"), c("c_custkey").alias("id"), c("c_name").alias("name"), F.array("c_mktsegment", "c_name").alias("marks"))
    return readers.bundle(exams, rows, table(spark, d, "supplier").select(c("s_nationkey").alias("exam_id"), c("s_suppkey").alias("id"), c("s_name").alias("text")))


@query(
    """WITH u AS (SELECT user_id, count(*) AS n, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS f FROM events GROUP BY user_id)
SELECT user_id AS "user", CAST(CASE WHEN user_id % 7 = 0 THEN 2 WHEN user_id % 5 = 0 THEN 2 ELSE 3 END AS INTEGER) AS version, CASE WHEN user_id % 7 = 0 OR user_id % 3 = 0 THEN 'exam' ELSE 'random' END AS "order",
CASE WHEN user_id % 7 = 0 THEN '' ELSE 'day ' || n END AS "examDate", CASE WHEN user_id % 7 = 0 THEN 0 ELSE CAST(f > 0 AS INTEGER) END AS flags, CAST(0 AS INTEGER) AS mocks FROM u"""
)
def states_over_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Saved states made from each user's events, merged over a new state: some lack fields, some can't be read."""
    c = F.col
    sums = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(c("event_type") == "click").alias("f"))
    filters = F.when(c("user_id") % 3 != 0, F.struct(F.lit("random").alias("order")))
    whole = F.struct(F.when(c("user_id") % 5 != 0, 3).alias("version"), F.when(c("f") > 0, F.create_map(F.lit("q1"), F.lit(True))).alias("flagged"), filters.alias("filters"), F.concat(F.lit("day "), c("n").cast("string")).alias("examDate"))
    states = sums.select("user_id", F.when(c("user_id") % 7 == 0, "{not json").otherwise(F.to_json(whole)).alias("body"))
    got = readers.merged_states(states, "user_id", "body")
    return got.select("user", "version", F.col("filters.order").alias("order"), "examDate", F.size("flagged").alias("flags"), F.size("mockExams").alias("mocks"))


@query(
    r"""WITH u AS (SELECT page_id AS seq, y AS year, host || CASE WHEN page_id % 4 = 0 THEN '/provas/' || y || '/12_ciencia_da_computacao.pdf' WHEN page_id % 4 = 1 THEN '/gabaritos/' || y || '/gab_' || page_id % 3 || '_ciencias_computacao.pdf' WHEN page_id % 4 = 2 THEN '/' || y || '_PV_' || page_id % 3 || '_engenharia_software.pdf'
  WHEN y % 3 = 0 THEN '/' || y || '_discursiva_engenharia_software.pdf' ELSE '/' || y || '_gb_' || page_id % 3 || '_a_4_engenharia_de_software.pdf' END AS url FROM (SELECT page_id, CAST(2014 + (page_id // 4) % 10 AS BIGINT) AS y, regexp_extract(url, '^https?://[^/]+') AS host FROM pages)),
f AS (SELECT *, lower(regexp_extract(url, '[^/]+$')) AS name, regexp_extract(url, '[^/]+$') AS file FROM u),
g AS (SELECT seq, year, file, CASE WHEN contains(url, '/provas/') OR regexp_matches(name, '(^|_)pv(_|$)') THEN 'exam' WHEN regexp_matches(name, 'discursiva') THEN 'answerGuide' ELSE 'answerKey' END AS type, CASE WHEN regexp_matches(name, 'ciencias?_(da_)?computacao') THEN 'ciencia_da_computacao' ELSE 'engenharia_de_software' END AS course,
  TRY_CAST(regexp_extract(name, '_(?:pv|gb)_(\d+)_a_\d+', 1) AS INTEGER) AS first, TRY_CAST(regexp_extract(name, '_(?:pv|gb)_(\d+)_[^a]', 1) AS INTEGER) AS single FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY year, course, type ORDER BY CASE WHEN first IS NULL AND coalesce(single, 1) = 1 THEN 0 WHEN first = 1 THEN 1 ELSE 2 END, seq) AS rank FROM g),
s AS (SELECT year, course, max(file) FILTER (rank = 1 AND type = 'exam') AS exam, max(file) FILTER (rank = 1 AND type = 'answerKey') AS key FROM r GROUP BY year, course)
SELECT year, course, exam, key AS "answerKey" FROM s WHERE exam IS NOT NULL AND key IS NOT NULL"""
)
def chosen_exams(spark: SparkSession, d: str) -> DataFrame:
    """Computing exams that have both files, by year and course: every fourth page stands for a booklet or a key of its course."""
    k, y, c = F.col("page_id"), F.col("year").cast("string"), lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    three = (k % 3).cast("string")
    forms = [c("/provas/", y, "/12_ciencia_da_computacao.pdf"), c("/gabaritos/", y, "/gab_", three, "_ciencias_computacao.pdf"), c("/", y, "_PV_", three, "_engenharia_software.pdf"), c("/", y, "_gb_", three, "_a_4_engenharia_de_software.pdf"), c("/", y, "_discursiva_engenharia_software.pdf")]
    tail = F.get(F.array(*forms), (k % 4 + ((k % 4 == 3) & (F.col("year") % 3 == 0)).cast("int")).cast("int"))
    rows = table(spark, d, "pages").withColumn("year", 2014 + F.floor(k / 4) % 10)
    files = rows.select(k.alias("seq"), "year", F.concat(F.regexp_extract("url", "^https?://[^/]+", 0), tail).alias("url"))
    return questions.chosen_exams(questions.select_exams(questions.describe_files(files))).select("year", "course", "exam", "answerKey")


_COURSES = ["ciencia_da_computacao", "engenharia_de_software", "design_grafico"]
_NAMES = {"ciencia_da_computacao": "Ciência da Computação"}


@query(
    f"""WITH o AS (SELECT o_orderkey AS k, ({_COURSES})[1 + o_orderkey % 3] AS course, 2014 + o_orderkey % 9 AS year, 1 + o_orderkey % 40 AS num, CASE WHEN o_orderkey % 4 = 0 THEN 'essay' ELSE 'objective' END AS kind, o_orderpriority FROM orders)
SELECT k AS id, CASE kind WHEN 'essay' THEN 'Discursiva ' || num ELSE 'Questão ' || lpad(CAST(num AS VARCHAR), 2, '0') END AS question_label, CASE WHEN k % 2 = 0 THEN 'Formação Geral' ELSE 'Componente Específico' END AS section_label,
CASE course WHEN 'ciencia_da_computacao' THEN 'Ciência da Computação' WHEN 'engenharia_de_software' THEN 'Engenharia De Software' ELSE 'Design Grafico' END || ' (' || year || ')' AS exam_label, CASE course WHEN 'ciencia_da_computacao' THEN 'CC' WHEN 'engenharia_de_software' THEN 'ES' ELSE 'Design Grafico' END AS short_label,
CASE WHEN kind = 'essay' OR o_orderpriority LIKE '5%' THEN 'Discursiva' ELSE substr(o_orderpriority, 3) END AS format_label FROM o"""
)
def question_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of orders as questions; formats are priorities, of which essays and the lowest have no label."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("id"), F.get(F.array(*map(F.lit, _COURSES)), (k % 3).cast("int")).alias("course"), (2014 + k % 9).alias("year"), (1 + k % 40).alias("num"), F.when(k % 4 == 0, "essay").otherwise("objective").alias("kind"), F.when(k % 2 == 0, "general").otherwise("specific").alias("section"), "o_orderpriority")
    rows = rows.withColumn("format", F.when(F.col("kind") == "objective", F.col("o_orderpriority")))
    formats = table(spark, d, "orders").where("o_orderpriority NOT LIKE '5%'").groupBy(F.col("o_orderpriority").alias("format")).agg(F.first(F.expr("substr(o_orderpriority, 3)")).alias("label"))
    return questions.labels(rows, _NAMES, formats)


@query(
    r"""WITH a AS (SELECT doc_id AS file, list_filter(string_split_regex(regexp_replace(translate(text, 'abcdefghijklmno', 'ABCDEABCDE*ABCD'), '[^A-E*\s]', '', 'g'), '\s+'), lambda t: t <> '') AS ws FROM documents)
SELECT file, CAST(i AS INTEGER) AS num, CASE WHEN t <> '*' THEN t END AS answer FROM (SELECT file, unnest(ws) AS t, generate_subscripts(ws, 1) AS i FROM a)"""
)
def manual_answers(spark: SparkSession, d: str) -> DataFrame:
    """Keys written by hand, made from the letters of each text's words."""
    letters = F.regexp_replace(F.translate("text", "abcdefghijklmno", "ABCDEABCDE*ABCD"), r"[^A-E*\s]", "")
    return answers.manual_key(table(spark, d, "documents").select(F.col("doc_id").alias("file"), letters.alias("answers")))


@query("SELECT o_orderkey, replace(replace(replace(format('{:,.2f}', floor(o_totalprice * 100 + 0.5) / 100), ',', '#'), '.', ','), '#', '.') AS price, replace(format('{:,}', o_custkey), ',', '.') || CASE WHEN o_custkey = 1 THEN ' questão' ELSE ' questões' END AS label FROM orders")
def number_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", T.brazilian(F.col("o_totalprice"), 2).alias("price"), T.plural(F.col("o_custkey"), "questão", "questões").alias("label"))
