"""Queries over documents and labels: vocabularies, classification by lexicon, formats, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import classify, search, statistics
from quillspark.plans.registry import query
from quillspark.session import table

#: Words of the fixtures' invented prose that stand in for a lexicon.
STOP = ["there", "which", "these"]
ABSOLUTE = ["always", "never", "nicht", "thing", "mente", "thent", "ering", "thtion"]

_FOLD = "strip_accents(lower(text))"
_TOKENS = rf"list_filter(string_split_regex(regexp_replace({_FOLD}, '[^a-z\s-]', ' ', 'g'), '\s+'), lambda w: length(w) >= 5)"
_KEPT = rf"list_filter({_TOKENS}, lambda w: w NOT IN ('there', 'which', 'these'))"
#: Rounding with halves upwards on the binary double.
_PCT = "CASE WHEN {b} = 0 THEN 0.0 ELSE floor(100.0 * {a} / {b} * 10.0 + 0.5) / 10.0 END"


def _tokens():
    return T.words(F.col("text"), STOP)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")


@query(
    f"""
WITH w AS (SELECT quality, unnest(list_distinct({_KEPT})) AS word FROM documents JOIN labels USING (doc_id)),
     c AS (SELECT word, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality <> 1) AS poor FROM w GROUP BY word),
     t AS (SELECT sum(good) AS g, sum(poor) AS p FROM c)
SELECT word, good, poor, floor((ln((good + 0.5) / (g - good + 0.5)) - ln((poor + 0.5) / (p - poor + 0.5))) * 100 + 0.5) / 100 AS log_odds
FROM c, t WHERE good + poor >= 6
"""
)
def vocabulary_log_odds(spark: SparkSession, d: str) -> DataFrame:
    words = statistics.document_words(_labelled(spark, d), _tokens(), "quality")
    return statistics.log_odds(words, F.col("quality") == 1)


@query(
    f"""
WITH w AS (SELECT lang, unnest(list_distinct({_KEPT})) AS word FROM documents),
     c AS (SELECT lang, word, count(*) AS c FROM w GROUP BY ALL),
     f AS (SELECT word, sum(c) AS df FROM c GROUP BY word),
     n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT sum(n) AS whole FROM n),
     s AS (SELECT lang, word, c, floor((c / n * ln(whole / df)) * 1000000 + 0.5) / 1000000 AS weight
           FROM c JOIN n USING (lang) JOIN f USING (word), t WHERE c >= 2 AND c / n >= 0.12)
SELECT lang, word, c, weight, CAST(row_number() OVER (PARTITION BY lang ORDER BY weight DESC, word) AS INTEGER) AS rank
FROM s QUALIFY rank <= 12
"""
)
def topic_terms_tfidf(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    words = statistics.document_words(docs, _tokens(), "lang")
    return statistics.topic_terms(words, "lang", docs.groupBy("lang").agg(F.count("*").alias("n")))


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct({_KEPT})) AS word FROM documents) GROUP BY word HAVING count(*) >= 6")
def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return statistics.document_frequency(statistics.document_words(table(spark, d, "documents"), _tokens()), 6)


@query(
    r"""
WITH t AS (SELECT doc_id, string_split_regex(text, '[^\p{L}]+') AS ws FROM documents),
     u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM t),
     c AS (SELECT strip_accents(lower(word)) AS folded, word, count(*) AS n, min((doc_id, pos)) AS first FROM u WHERE length(word) >= 3 GROUP BY ALL)
SELECT folded, word, n FROM c QUALIFY row_number() OVER (PARTITION BY folded ORDER BY n DESC, first) = 1
"""
)
def accent_mode(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", r"[^\p{L}]+")).alias("pos", "word"))
    tokens = tokens.where(F.length("word") >= 3).select("word", F.struct("doc_id", "pos").alias("ord"))
    return statistics.spelling_mode(tokens)


_LIST = ", ".join(f"'{w}'" for w in ABSOLUTE)


@query(
    f"""
WITH w AS (SELECT quality = 1 AS good, list_has_any({_KEPT}, [{_LIST}]) AS hit FROM documents JOIN labels USING (doc_id)),
     c AS (SELECT count(*) FILTER (good AND hit) AS good_hits, count(*) FILTER (good) AS good, count(*) FILTER (NOT good AND hit) AS poor_hits, count(*) FILTER (NOT good) AS poor FROM w)
SELECT *, {_PCT.format(a="good_hits", b="good")} AS good_pct, {_PCT.format(a="poor_hits", b="poor")} AS poor_pct FROM c
"""
)
def absolute_rates(spark: SparkSession, d: str) -> DataFrame:
    return statistics.presence_rates(_labelled(spark, d), _tokens(), F.col("quality") == 1, ABSOLUTE)


@query(
    f"""
WITH w AS (SELECT quality = 1 AS good, unnest(list_intersect({_KEPT}, [{_LIST}])) AS word FROM documents JOIN labels USING (doc_id))
SELECT word, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS poor FROM w GROUP BY word HAVING count(*) >= 3
"""
)
def absolute_words(spark: SparkSession, d: str) -> DataFrame:
    return statistics.presence_counts(_labelled(spark, d), _tokens(), F.col("quality") == 1, ABSOLUTE)


@query(f"SELECT doc_id, len({_TOKENS}) AS all_words, len({_KEPT}) AS kept_words, len({_TOKENS}) - len({_KEPT}) AS stopped FROM documents")
def stopword_filter(spark: SparkSession, d: str) -> DataFrame:
    n, kept = F.size(T.words(F.col("text"))).cast("long"), F.size(_tokens()).cast("long")
    return table(spark, d, "documents").select("doc_id", n.alias("all_words"), kept.alias("kept_words"), (n - kept).alias("stopped"))


@query(f"SELECT doc_id, array_to_string({_TOKENS}, ' ') AS words FROM documents")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(T.words(F.col("text")), " ").alias("words"))


@query(f"SELECT doc_id, {_FOLD} AS folded FROM documents")
def accent_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query(rf"SELECT doc_id, upper(trim(regexp_replace(replace({_FOLD}, 'ß', 'ss'), '[\s\x{{00A0}}]+', ' ', 'g'))) AS marker FROM documents")
def marker_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.marker_norm(F.col("text")).alias("marker"))


@query(
    rf"""
WITH t AS (SELECT lang, unnest(list_distinct({_KEPT})) AS word FROM documents WHERE lang IN ('de', 'fr'))
SELECT word, CAST(max(CAST(lang = 'de' AS INTEGER)) AS INTEGER) AS in_de, CAST(max(CAST(lang = 'fr' AS INTEGER)) AS INTEGER) AS in_fr FROM t GROUP BY word
"""
)
def word_union(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("lang").isin("de", "fr"))
    words = statistics.document_words(docs, _tokens(), "lang")
    return words.groupBy("word").agg(*[F.max((F.col("lang") == x).cast("int")).alias(f"in_{x}") for x in ("de", "fr")])


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("lang", "source").distinct()


@query("SELECT count(*) AS total, count(*) FILTER (lang = 'en') AS n_en, count(*) FILTER (n_chars >= 1000) AS n_long, count(DISTINCT source) AS n_sources FROM documents")
def corpus_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.count("*").alias("total"), F.count_if(F.col("lang") == "en").alias("n_en"), F.count_if(F.col("n_chars") >= 1000).alias("n_long"), F.countDistinct("source").alias("n_sources"))


@query(
    r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
     s AS (SELECT doc_id, left(regexp_replace(strip_accents(lower(line)), '[0-9\s]', '', 'g'), 30) AS signature FROM l)
SELECT signature, count(DISTINCT doc_id) AS n FROM s WHERE signature <> '' GROUP BY signature
HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id) >= 0.005 * (SELECT count(*) FROM documents)
"""
)
def repeated_elements(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return statistics.repeated_lines(lines, "doc_id", 3, 0.005)


#: A fixture lexicon: topics with keyword patterns in order; the first six weigh more.
LEXICON = classify.Lexicon(
    {
        "able": ["thble", "erble", "onble", "reble", "anble", "inble", "nteble", "tible"],
        "action": ["thtion", "ertion", "ontion", "retion", "antion", "ention", "intion", "ation"],
        "german": ["nicht", "heit", "keit", "schaft", "lich", "ung", "schei", "ein"],
        "romance": ["mente", "cion", "eaux", "ment", "elle", "ique", "ario", "que"],
    },
    fallback="none",
)


def _score_sql() -> str:
    parts = []
    for topic, words in LEXICON.topics.items():
        terms = [f"{3.0 if i < 6 else 2.0} * pow(least(3, len(regexp_extract_all(f, '(^|[^a-z]){w}'))), 0.7)" for i, w in enumerate(words)]
        parts.append(f"floor(({' + '.join(terms)}) * 1000000 + 0.5) / 1000000 AS s_{topic}")
    return f"SELECT doc_id, {', '.join(parts)} FROM (SELECT doc_id, {_FOLD} AS f FROM documents)"


@query(_score_sql())
def topic_scores(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))
    docs = texts.select("doc_id", "folded", LEXICON.found(F.col("folded")).alias("found"))
    return docs.select("doc_id", *[T.round_half_up(s, 6).alias(f"s_{t}") for t, s in LEXICON.scores(F.col("folded"), F.col("found")).items()])


@query(
    f"""
WITH s AS ({_score_sql()}),
     u AS (SELECT doc_id, unnest([{{'t': 'able', 'o': 0, 's': s_able}}, {{'t': 'action', 'o': 1, 's': s_action}}, {{'t': 'german', 'o': 2, 's': s_german}}, {{'t': 'romance', 'o': 3, 's': s_romance}}]) AS x FROM s),
     r AS (SELECT doc_id, x.t AS topic, x.s AS score, row_number() OVER w AS rank, first_value(x.s) OVER w AS top FROM u WHERE x.s > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY x.s DESC, x.o)),
     k AS (SELECT doc_id, list(topic ORDER BY rank) AS topics FROM r WHERE rank = 1 OR (rank = 2 AND score >= 0.6 * top AND score >= 4) GROUP BY doc_id)
SELECT doc_id, coalesce(array_to_string(topics, '+'), 'none') AS topics FROM documents LEFT JOIN k USING (doc_id)
"""
)
def topic_classify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(LEXICON.classify(T.fold(F.col("text")), 6), "+").alias("topics"))


@query(r"SELECT conv_id, turn, regexp_matches(right(text, 400), '\b(NOT|EXCEPT|FALSE)\b') OR regexp_matches(strip_accents(lower(text)), 'nicht|never|ththno') AS negative FROM conversations")
def negative_command(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", classify.negative(F.col("text"), ["NOT", "EXCEPT", "FALSE"], ["nicht", "never", "ththno"], everywhere=True).alias("negative"))


@query(r"SELECT role, count(*) FILTER (regexp_matches(right(text, 400), '\b(NOT|EXCEPT|FALSE)\b') OR regexp_matches(strip_accents(lower(text)), 'nicht|never|ththno')) AS n FROM conversations GROUP BY role")
def negative_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("role").agg(F.count_if(classify.negative(F.col("text"), ["NOT", "EXCEPT", "FALSE"], ["nicht", "never", "ththno"], everywhere=True)).alias("n"))


@query("SELECT format, count(*) AS n FROM (SELECT CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END AS format FROM documents) GROUP BY format")
def format_counts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("n_chars") < 200, "short").when(F.col("n_chars") < 2000, "medium").otherwise("long")
    return table(spark, d, "documents").groupBy(kind.alias("format")).agg(F.count("*").alias("n"))


# Search, facets and samples


@query(f"SELECT doc_id, lang FROM documents WHERE contains({_FOLD}, 'ention') AND contains({_FOLD}, 'able')")
def search_all_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(search.all_terms(T.fold(F.col("text")), "Ention  áble")).select("doc_id", "lang")


_STATUS = "CASE WHEN quality IS NULL THEN 'new' WHEN quality = 1 THEN 'right' ELSE 'wrong' END"


@query(f"SELECT doc_id, lang, source, {_STATUS} AS status FROM documents LEFT JOIN labels USING (doc_id) WHERE lang IN ('en', 'de') AND source IN ('src1', 'src2', 'src3', 'src4') AND {_STATUS} IN ('right', 'wrong') AND contains({_FOLD}, 'er')")
def faceted_filter(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("quality").isNull(), "new").when(F.col("quality") == 1, "right").otherwise("wrong")
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumn("status", status)
    spec = search.FilterSpec(any_of={"lang": ["en", "de"], "source": ["src1", "src2", "src3", "src4"], "status": ["right", "wrong"]}, terms="er")
    return search.apply(docs, spec, T.fold(F.col("text"))).select("doc_id", "lang", "source", "status")


@query("SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    return search.facets(table(spark, d, "documents"), ["lang", "source"])


@query(f"SELECT c.conv_id, string_agg(strip_accents(lower(text)), ' ' ORDER BY turn) AS search_text FROM conversations c GROUP BY c.conv_id")
def search_text(spark: SparkSession, d: str) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", T.fold(F.array_join(F.transform("turns", lambda t: t["text"]), " ")).alias("search_text"))


@query(
    r"""
WITH s AS (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]') AS ss FROM documents),
     p AS (SELECT doc_id, coalesce(list_filter(ss, lambda x: length(trim(x)) > 60 AND NOT contains(lower(x), 'licensed'))[1], ss[1], '') AS s FROM s),
     t AS (SELECT doc_id, trim(regexp_replace(s, '\s+', ' ', 'g')) AS s FROM p)
SELECT doc_id, CASE WHEN length(s) > 240 THEN regexp_replace(left(s, 237), '\s\S*$', '') || '…' ELSE s END AS excerpt FROM t
"""
)
def excerpt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", search.excerpt(F.col("text"), "licensed").alias("excerpt"))


@query("SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id LIMIT 30")
def shuffle_sample(spark: SparkSession, d: str) -> DataFrame:
    return search.sample(table(spark, d, "documents").select("doc_id"), "doc_id", 42, 30)


@query(f"SELECT doc_id, {_STATUS} AS status FROM documents LEFT JOIN labels USING (doc_id) ORDER BY ({_STATUS} = 'new') DESC, md5(CAST(doc_id AS VARCHAR) || ':7'), doc_id LIMIT 40")
def priority_sample(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("quality").isNull(), "new").when(F.col("quality") == 1, "right").otherwise("wrong")
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", status.alias("status"))
    return search.sample(docs, "doc_id", 7, 40, first=F.col("status") == "new")


@query("WITH n AS (SELECT count(*) AS n FROM documents) SELECT doc_id, lang FROM documents, n QUALIFY row_number() OVER (ORDER BY doc_id) - 1 = (19999 * 7919) % n")
def daily_pick(spark: SparkSession, d: str) -> DataFrame:
    return search.daily(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 19_999)


@query("WITH r AS (SELECT source, doc_id, n_chars, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM documents) SELECT * FROM r WHERE rank <= 5")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    return statistics.top_k(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 5)
