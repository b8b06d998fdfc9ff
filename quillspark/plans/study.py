"""Queries over events, orders, embeddings and other tables that stand in for attempts, exams and positioned text."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import statistics, study
from quillspark.plans.registry import query
from quillspark.session import table

#: An attempt is right from this value on (the fixtures' median).
RIGHT = 34.59


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("question"), (F.col("value") >= RIGHT).alias("ok"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


_A = 'a AS (SELECT user_id AS "user", event_type AS question, value >= 34.59 AS ok, ts AS tm, event_id AS seq FROM events)'
_L = f'{_A}, l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY "user", question ORDER BY tm DESC, seq DESC) = 1)'


@query(f'WITH {_L} SELECT "user", question, ok, seq FROM l')
def latest_attempt(spark: SparkSession, d: str) -> DataFrame:
    return study.latest(_attempts(spark, d), "user", "question").select("user", "question", "ok", "seq")


@query(f"""WITH {_L}, g AS (SELECT "user", question FROM (SELECT DISTINCT "user" FROM a) u, (SELECT DISTINCT question FROM a) q)
SELECT "user", question, CASE WHEN seq IS NULL THEN 'new' WHEN ok IS NULL THEN 'answered' WHEN ok THEN 'right' ELSE 'wrong' END AS status FROM g LEFT JOIN l USING ("user", question)""")
def status_of(spark: SparkSession, d: str) -> DataFrame:
    attempts = _attempts(spark, d)
    grid = attempts.select("user").distinct().crossJoin(attempts.select("question").distinct())  # as many rows as the result
    last = study.latest(attempts, "user", "question")
    return grid.join(last, ["user", "question"], "left").select("user", "question", study.status(F.col("ok"), F.col("seq").isNotNull()).alias("status"))


@query(f"""WITH {_L}, d AS (SELECT "user", count(DISTINCT CAST(tm AS DATE)) AS days FROM a GROUP BY "user"),
s AS (SELECT "user", count(*) AS answered, count(*) FILTER (ok) AS right_ FROM l WHERE ok IS NOT NULL GROUP BY "user")
SELECT "user", coalesce(answered, 0) AS answered, coalesce(right_, 0) AS "right", days FROM d LEFT JOIN s USING ("user")""")
def user_stats(spark: SparkSession, d: str) -> DataFrame:
    return study.user_stats(_attempts(spark, d))


_ACC = """SELECT {by}, count(*) AS n, count(*) FILTER (ok) AS "right", floor(100.0 * count(*) FILTER (ok) / count(*) + 0.5) AS pct FROM {t} GROUP BY {by} HAVING count(*) >= {least}"""


@query(f"WITH {_L} " + _ACC.format(by="question", t="l", least=3))
def accuracy_by_topic(spark: SparkSession, d: str) -> DataFrame:
    return study.accuracy(study.latest(_attempts(spark, d), "user", "question"), "question", 3)


@query(f"WITH {_L} " + _ACC.format(by="format", t="(SELECT *, CASE WHEN question IN ('click', 'view') THEN 'passive' ELSE 'active' END AS format FROM l)", least=2))
def accuracy_by_format(spark: SparkSession, d: str) -> DataFrame:
    last = study.latest(_attempts(spark, d), "user", "question")
    return study.accuracy(last.withColumn("format", F.when(F.col("question").isin("click", "view"), "passive").otherwise("active")), "format", 2)


@query(f"WITH {_L}, s AS ({_ACC.format(by='question', t='l', least=3)}) SELECT question, n, \"right\", pct FROM s ORDER BY \"right\" / n, question LIMIT 1")
def weakest_topic(spark: SparkSession, d: str) -> DataFrame:
    return study.weakest(study.accuracy(study.latest(_attempts(spark, d), "user", "question"), "question", 3), "question")


@query(f"""WITH {_L}, g AS (SELECT DISTINCT question FROM a), u AS (SELECT count(DISTINCT "user") AS total FROM a), s AS (SELECT question, count(*) AS done, count(*) FILTER (ok) AS r FROM l GROUP BY question)
SELECT question, total, coalesce(done, 0) AS done, coalesce(r, 0) AS "right" FROM g LEFT JOIN s USING (question), u""")
def exam_progress(spark: SparkSession, d: str) -> DataFrame:
    attempts = _attempts(spark, d)
    total = attempts.agg(F.countDistinct("user").alias("total"))
    return study.progress(attempts.select("question").distinct().crossJoin(F.broadcast(total)), study.latest(attempts, "user", "question"), "question")


@query(f"""WITH {_A} SELECT "user", count(*) AS n, count(*) FILTER (ok) AS "right" FROM a WHERE "user" IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) GROUP BY "user" """)
def known_attempts(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("user"))
    return _attempts(spark, d).join(known, "user", "left_semi").groupBy("user").agg(F.count("*").alias("n"), F.count_if("ok").alias("right"))


@query(f"""WITH {_A}, i AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY tm, seq) <= 10)
SELECT "user", count(*) AS total, count(*) FILTER (ok) AS correct, count(*) FILTER (question = 'purchase') AS n_purchase, count(*) FILTER (question = 'purchase' AND ok) AS ok_purchase FROM i GROUP BY "user" """)
def mock_report(spark: SparkSession, d: str) -> DataFrame:
    first = statistics.top_k(_attempts(spark, d), ["user"], [F.asc("at"), F.asc("seq")], 10)
    bought = F.col("question") == "purchase"
    return first.groupBy("user").agg(F.count("*").alias("total"), F.count_if("ok").alias("correct"), F.count_if(bought).alias("n_purchase"), F.count_if(bought & F.col("ok")).alias("ok_purchase"))


@query(f"""WITH {_A}, i AS (SELECT *, CAST(row_number() OVER (PARTITION BY "user" ORDER BY tm, seq) AS INTEGER) AS rank FROM a QUALIFY rank <= 10) SELECT "user", seq, rank FROM i WHERE NOT ok""")
def mistakes(spark: SparkSession, d: str) -> DataFrame:
    return statistics.top_k(_attempts(spark, d), ["user"], [F.asc("at"), F.asc("seq")], 10).where(~F.col("ok")).select("user", "seq", "rank")


@query("""WITH o AS (SELECT user_id, event_id, event_type, ts FROM events),
b AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER w AS block, last_value(CASE WHEN event_type = 'signup' THEN 1 WHEN event_type = 'error' THEN 0 END IGNORE NULLS) OVER w AS open FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, block, count(*) AS n, min(event_id) AS first_id FROM b WHERE open = 1 GROUP BY user_id, block""")
def marker_segments(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    rows = study.marker_segments(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"], kind == "signup", kind == "error")
    return rows.groupBy("user_id", "block").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS header FROM events")
def asof_header(spark: SparkSession, d: str) -> DataFrame:
    return study.last_before(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"], F.col("event_type") == "signup", "event_id").select("event_id", "header")


@query("SELECT event_id, CASE WHEN event_type <> 'view' THEN event_id ELSE count(*) FILTER (event_type = 'view') OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS filled FROM events")
def fill_sequence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", F.when(F.col("event_type") != "view", F.col("event_id")).alias("number"))
    return study.fill_sequence(rows, "user_id", ["ts", "event_id"], "number").select("event_id", "filled")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) < 7200 THEN 0 ELSE 1 END AS n FROM events),
r AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM o) SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS n FROM r GROUP BY user_id, run""")
def gap_runs(spark: SparkSession, d: str) -> DataFrame:
    return study.gap_runs(table(spark, d, "events").select("user_id", "ts"), "user_id", "ts", 7200).select("user_id", "run", "n")


@query("""WITH s AS (SELECT event_type, min(ts) AS a, min(ts) + INTERVAL 7 DAY AS b FROM events GROUP BY event_type)
SELECT e.event_type, count(*) AS n FROM events e JOIN s ON e.event_type = s.event_type AND e.ts >= s.a AND e.ts < s.b GROUP BY e.event_type""")
def range_containment(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_type", "ts")
    segments = events.groupBy("event_type").agg(F.min("ts").alias("a")).withColumn("b", F.col("a") + F.expr("INTERVAL 7 DAYS"))
    return events.join(segments, "event_type").where((F.col("ts") >= F.col("a")) & (F.col("ts") < F.col("b"))).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS id, s.s_suppkey AS nearest, s.d AS distance FROM (SELECT c_custkey, s_suppkey, abs(s_acctbal - c_acctbal) AS d FROM customer, supplier) s
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) = 1""")
def nearest_match(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    return study.nearest(left, table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("y")))


@query("""WITH p AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS x FROM embeddings),
r AS (SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS g FROM p WHERE x > 0),
s AS (SELECT vec_id, min(i) AS f, max(i) AS l, count(*) AS n FROM r GROUP BY vec_id, g),
k AS (SELECT vec_id, min(f) FILTER (n >= 2) AS a, max(l) FILTER (n >= 2) AS b FROM s GROUP BY vec_id)
SELECT vec_id, CAST(f AS INTEGER) AS first, CAST(l AS INTEGER) AS last FROM s JOIN k USING (vec_id) WHERE f >= a AND l <= b""")
def islands_trimmed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.explode(study.islands(F.col("embedding"), 2)).alias("r"))
    return rows.select("vec_id", "r.first", "r.last")


@query("""WITH p AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS x FROM embeddings),
r AS (SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS g FROM p WHERE x > 1.25),
s AS (SELECT vec_id, min(i) AS a, max(i) AS b FROM r GROUP BY vec_id, g),
o AS (SELECT *, row_number() OVER w AS k, lag(b) OVER w AS pb, lead(a) OVER w AS na FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY a)),
l AS (SELECT vec_id, max(k) AS k FROM o WHERE pb IS NULL OR b - a >= 1 OR a - pb <= 6 GROUP BY vec_id),
f AS (SELECT o.vec_id, min(o.k) AS k, any_value(l.k) AS z FROM o JOIN l ON o.vec_id = l.vec_id AND o.k <= l.k WHERE o.k = l.k OR b - a >= 1 OR na - b <= 6 GROUP BY o.vec_id)
SELECT e.vec_id, CAST(coalesce(x.a, -1) AS INTEGER) AS first, CAST(coalesce(y.b, -1) AS INTEGER) AS last FROM embeddings e LEFT JOIN f USING (vec_id)
LEFT JOIN o x ON x.vec_id = f.vec_id AND x.k = f.k LEFT JOIN o y ON y.vec_id = f.vec_id AND y.k = f.z""")
def content_ranges(spark: SparkSession, d: str) -> DataFrame:
    ink = F.transform("embedding", lambda x: x - F.lit(1.25))
    return table(spark, d, "embeddings").select("vec_id", study.content_range(ink, 1, 6).alias("r")).select("vec_id", "r.first", "r.last")


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x > 1.5)) > 0 AS ink, len(list_filter(embedding, lambda x: x > 0)) AS n FROM embeddings")
def ink_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.exists("embedding", lambda x: x > 1.5).alias("ink"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("n"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def letter_distribution(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY o_orderpriority")
def topic_exam_pivot(spark: SparkSession, d: str) -> DataFrame:
    return statistics.pivot_counts(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("""WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT greatest(max(n), 1) AS top FROM c)
SELECT o_orderpriority, o_orderstatus, n, CAST(CASE WHEN n = 0 THEN 0 WHEN n / top <= 0.33 THEN 1 WHEN n / top <= 0.66 THEN 2 ELSE 3 END AS INTEGER) AS bucket FROM c, t""")
def heat_table(spark: SparkSession, d: str) -> DataFrame:
    return statistics.heat(letter_distribution(spark, d), "n")


@query("WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderpriority, o_totalprice AS upper_median, n FROM r WHERE i = n // 2")
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    return statistics.upper_median(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")


@query(r"""WITH c AS (SELECT conv_id, list(length(text) ORDER BY turn) AS ls FROM conversations GROUP BY conv_id HAVING count(*) >= 4),
r AS (SELECT ls[2] = list_max(ls) AS lo, ls[2] = list_min(ls) AS sh, 1.0::DOUBLE / len(ls) AS ch FROM c),
s AS (SELECT count(*) AS n, count(*) FILTER (lo) AS a, count(*) FILTER (sh) AS b, sum(ch) AS c FROM r)
SELECT n, floor(100.0 * a / n * 10.0 + 0.5) / 10.0 AS longest_pct, floor(100.0 * b / n * 10.0 + 0.5) / 10.0 AS shortest_pct, floor(100.0 * c / n * 10.0 + 0.5) / 10.0 AS chance_pct FROM s""")
def longest_alternative(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("t")).where(F.size("t") >= 4)
    lengths = turns.select(F.transform("t", lambda x: x["n"]).alias("ls"))
    return statistics.length_rank(lengths, F.col("ls"), F.get("ls", F.lit(1)))


_MS = "CAST(floor(o_totalprice * 100) AS BIGINT)"


@query(f"""WITH s AS (SELECT o_orderkey, greatest(0, CAST(floor({_MS} / 1000.0 + 0.5) AS BIGINT)) AS s FROM orders)
SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST((s % 3600) // 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS duration FROM s""")
def duration_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", T.duration(F.floor(F.col("o_totalprice") * 100).cast("long")).alias("duration"))


@query("""WITH t AS (SELECT o_orderkey, lpad(CAST(1 + o_orderkey % 31 AS VARCHAR), 2, '0') || '/' || strftime(o_orderdate, '%m/%Y') AS typed FROM orders)
SELECT o_orderkey, typed, CAST(try_strptime(typed, '%d/%m/%Y') AS DATE) AS day FROM t""")
def date_strict(spark: SparkSession, d: str) -> DataFrame:
    typed = F.concat(F.lpad((1 + F.col("o_orderkey") % 31).cast("string"), 2, "0"), F.lit("/"), F.date_format("o_orderdate", "MM/yyyy"))
    return table(spark, d, "orders").select("o_orderkey", typed.alias("typed"), T.strict_date(typed).alias("day"))


@query("""WITH u AS (SELECT count(*) AS unseen FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL)
SELECT o_orderkey, CAST(ceil((epoch(date_trunc('day', o_orderdate)) + 43200 - 820454400) / 86400.0) AS BIGINT) AS days,
CAST(greatest(1, ceil(unseen / ceil((epoch(date_trunc('day', o_orderdate)) + 43200 - 820454400) / 86400.0))) AS BIGINT) AS pace FROM orders, u WHERE o_orderdate >= TIMESTAMP '1996-01-02'""")
def exam_pace(spark: SparkSession, d: str) -> DataFrame:
    now = int(datetime.datetime(1996, 1, 1, tzinfo=datetime.timezone.utc).timestamp())
    unseen = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").agg(F.count("*").alias("unseen"))
    noon = F.date_trunc("day", "o_orderdate").cast("long") + 43_200
    days = F.ceil((noon - now) / 86_400.0)
    orders = table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1996-01-02").cast("timestamp"))
    return orders.crossJoin(F.broadcast(unseen)).select("o_orderkey", days.cast("long").alias("days"), F.greatest(F.lit(1), F.ceil(F.col("unseen") / days)).cast("long").alias("pace"))


@query("SELECT 'q' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '-' || CAST(l_orderkey AS VARCHAR) AS id, l_quantity FROM lineitem")
def composite_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.concat(F.lit("q"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit("-"), F.col("l_orderkey").cast("string")).alias("id"), "l_quantity")


@query("SELECT doc_id, quality IS NOT NULL AS key_present, CASE WHEN toxic = 0 THEN quality END AS answer FROM documents LEFT JOIN labels USING (doc_id)")
def answer_join(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.select("doc_id", F.col("quality").isNotNull().alias("key_present"), F.when(F.col("toxic") == 0, F.col("quality")).alias("answer"))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id, quality IS NULL AS unknown, coalesce(toxic = 1, false) AS annulled FROM documents LEFT JOIN labels USING (doc_id)")
def answer_state(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.select("doc_id", F.col("quality").isNull().alias("unknown"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("annulled"))


@query("SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'xx' END, d.lang) AS lang, coalesce(CASE WHEN l.quality = 0 THEN 'poor' END, d.source) AS source FROM documents d LEFT JOIN labels l USING (doc_id)")
def override_coalesce(spark: SparkSession, d: str) -> DataFrame:
    overrides = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "xx").alias("o_lang"), F.when(F.col("quality") == 0, "poor").alias("o_source"))
    return table(spark, d, "documents").join(overrides, "doc_id", "left").select("doc_id", F.coalesce("o_lang", "lang").alias("lang"), F.coalesce("o_source", "source").alias("source"))


@query("""WITH s AS (SELECT conv_id, unnest(list(turn)) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT c.conv_id, c.turn, length(c.text) AS n FROM conversations c JOIN s USING (conv_id, turn)""")
def shared_text_join(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    shared = turns.where("role = 'user'").groupBy("conv_id").agg(F.collect_list("turn").alias("nums")).select("conv_id", F.explode("nums").alias("turn"))
    return turns.join(shared, ["conv_id", "turn"]).select("conv_id", "turn", F.length("text").cast("long").alias("n"))


@query("""WITH c AS (SELECT source, sum(len(regexp_extract_all(text, '\\|'))) AS hits, count(*) AS docs FROM documents GROUP BY source)
SELECT doc_id, CASE WHEN hits >= docs THEN replace(text, ' | ', ' ') ELSE text END AS text FROM documents JOIN c USING (source)""".replace("\\\\", "\\"))
def conditional_repair(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    gate = docs.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"\|"))).alias("hits"), F.count("*").alias("docs"))
    return docs.join(gate, "source").select("doc_id", F.when(F.col("hits") >= F.col("docs"), F.replace("text", F.lit(" | "), F.lit(" "))).otherwise(F.col("text")).alias("text"))


@query("""WITH c AS (SELECT source, sum(length(text)) AS n, sum(length(text) - length(regexp_replace(text, '[éèêç]', '', 'g'))) AS hits FROM documents GROUP BY source)
SELECT doc_id, hits >= 3 AND hits >= 0.05 * n AS flagged FROM documents JOIN c USING (source)""")
def group_ratio_flag(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    sums = docs.groupBy("source").agg(F.sum(F.length("text")).alias("n"), F.sum(F.length("text") - F.length(F.translate("text", "éèêç", ""))).alias("hits"))
    return docs.drop("text").join(sums, "source").select("doc_id", ((F.col("hits") >= 3) & (F.col("hits") >= 0.05 * F.col("n"))).alias("flagged"))


@query("SELECT doc_id, translate(text, 'éèêç', 'eeec') AS text FROM documents")
def char_decode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.translate("text", "éèêç", "eeec").alias("text"))


@query("""WITH RECURSIVE o AS (SELECT o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS i FROM orders WHERE o_totalprice IS NOT NULL),
g AS (SELECT o_custkey, v, i, v AS anchor, 0 AS grp FROM o WHERE i = 1 UNION ALL
SELECT o.o_custkey, o.v, o.i, CASE WHEN o.v - g.anchor > 5000.0 THEN o.v ELSE g.anchor END, g.grp + CASE WHEN o.v - g.anchor > 5000.0 THEN 1 ELSE 0 END FROM g JOIN o ON o.o_custkey = g.o_custkey AND o.i = g.i + 1)
SELECT o_custkey, v AS price, grp FROM g""")
def anchor_group(spark: SparkSession, d: str) -> DataFrame:
    prices = table(spark, d, "orders").select("o_custkey", F.col("o_totalprice").alias("price"))
    return study.anchored(prices, ["o_custkey"], "price", 5000.0)


_LETTERS = {"signup": "A", "click": "B", "view": "C", "purchase": "D", "error": "E"}


@query(f"""WITH RECURSIVE r AS (SELECT user_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _LETTERS.items())} END AS l, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT user_id, max(i) AS i, 1 AS n FROM r WHERE l = 'A' GROUP BY user_id UNION ALL
SELECT r.user_id, r.i, s.n + CASE WHEN r.l = substr('ABCDE', s.n + 1, 1) THEN 1 ELSE 0 END FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1),
m AS (SELECT user_id, max(n) AS n FROM s GROUP BY user_id)
SELECT user_id, CASE WHEN n >= 2 THEN substr('ABCDE', 1, n) END AS found FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN m USING (user_id)""")
def ordered_subsequence(spark: SparkSession, d: str) -> DataFrame:
    """Letters of a user's events in order of time."""
    letters = F.element_at(F.create_map(*[F.lit(x) for p in _LETTERS.items() for x in p]), F.col("event_type"))
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", letters.alias("letter"))
    return study.in_order(rows, "user_id", ["ts", "event_id"], "letter", "ABCDE", 2)
