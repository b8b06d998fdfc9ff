"""Queries over pages: links, URL descriptors, dictionary lookups, answer keys in text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.classify import first_match
from quillspark.plans.registry import query
from quillspark.session import table


@query("SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS link FROM pages")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("link"))


@query("""WITH c AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS section, count(*) AS n FROM orders GROUP BY ALL)
SELECT year, section, coalesce(n, 0) AS n FROM (SELECT DISTINCT year FROM c) y CROSS JOIN (SELECT DISTINCT section FROM c) s LEFT JOIN c USING (year, section)""")
def discover_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every year with every section, and what was found there, which may be nothing."""
    found = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("section")).agg(F.count("*").alias("n"))
    grid = found.select("year").distinct().crossJoin(found.select("section").distinct())
    return grid.join(found, ["year", "section"], "left").select("year", "section", F.coalesce("n", F.lit(0)).alias("n"))


_KIND = r"CASE WHEN contains(url, 'utm_source=feed') THEN 'feed' WHEN contains(url, '.html') THEN 'html' WHEN contains(url, '#') THEN 'frag' WHEN contains(url, '?') THEN 'query' WHEN suffix(url, '/') THEN 'slash' ELSE 'plain' END"
KINDS = [("utm_source=feed", "feed"), (r"\.html", "html"), ("#", "frag"), (r"\?", "query"), ("/$", "slash")]


def _described(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(url, r"^https?://([^/]+)", 1).alias("host"), F.regexp_extract(url, r"^https?://[^/]+/([a-z]{2})/", 1).alias("lang"), F.regexp_extract(url, r"^https?://[^/]+/[a-z]{2}/(\d+)", 1).try_cast("int").alias("number"), first_match(url, KINDS, "plain").alias("kind"))


_DESCRIBED = rf"SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]{{2}})/', 1) AS lang, TRY_CAST(regexp_extract(url, '^https?://[^/]+/[a-z]{{2}}/(\d+)', 1) AS INTEGER) AS number, {_KIND} AS kind FROM pages"


@query(_DESCRIBED)
def url_descriptor(spark: SparkSession, d: str) -> DataFrame:
    return _described(spark, d)


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^https?://([^/]+)', 1), '^(www|m|blog)\.', ''), '\.(com|net|org)$', ''), 'example', ''), '[.-]+', ' ', 'g')) AS slug FROM pages")
def slug_cleanup(spark: SparkSession, d: str) -> DataFrame:
    slug = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    for pattern, to in ((r"^(www|m|blog)\.", ""), (r"\.(com|net|org)$", ""), ("example", ""), ("[.-]+", " ")):
        slug = F.regexp_replace(slug, pattern, to)
    return table(spark, d, "pages").select("page_id", F.trim(slug).alias("slug"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(url, '//www\.') THEN 'main' WHEN regexp_matches(url, '//m\.') THEN 'mobile' WHEN regexp_matches(url, '//blog\.') THEN 'blog' WHEN regexp_matches(url, 'bets|casino') THEN 'spam' ELSE 'other' END AS category FROM pages")
def first_match_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", first_match(F.col("url"), [(r"//www\.", "main"), (r"//m\.", "mobile"), (r"//blog\.", "blog"), ("bets|casino", "spam")], "other").alias("category"))


@query(f"WITH u AS ({_DESCRIBED}) SELECT host, lang, page_id, kind FROM u QUALIFY row_number() OVER (PARTITION BY host, lang ORDER BY CASE kind WHEN 'plain' THEN 0 WHEN 'html' THEN 1 WHEN 'slash' THEN 2 ELSE 3 END, page_id) = 1")
def pick_best(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("kind") == "plain", 0).when(F.col("kind") == "html", 1).when(F.col("kind") == "slash", 2).otherwise(3)
    best = F.min_by(F.struct("page_id", "kind"), F.struct(rank, "page_id")).alias("best")
    return _described(spark, d).groupBy("host", "lang").agg(best).select("host", "lang", "best.page_id", "best.kind")


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '(\d{1,2})[^\d]+(\d{1,2})') THEN 'many' ELSE 'one' END AS shape, CAST(list_sum(list_transform(regexp_extract_all(url, '\b(\d{1,2})\b', 1), lambda x: CAST(x AS INTEGER))) AS BIGINT) AS total FROM pages""")
def num_list(spark: SparkSession, d: str) -> DataFrame:
    each = T.number_list(F.col("url"))
    shape = F.when(F.col("url").rlike(r"(\d{1,2})[^\d]+(\d{1,2})"), "many").otherwise("one")
    total = T.let(each, lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)))
    return table(spark, d, "pages").select("page_id", shape.alias("shape"), total.alias("total"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), m AS (SELECT doc_id, upper(strip_accents(lower(trim(line)))) AS m FROM l)
SELECT doc_id, CASE WHEN starts_with(m, 'THE ') THEN 'objective' WHEN starts_with(m, 'IN ') THEN 'essay' WHEN contains(m, 'LICENSED') THEN 'stop' END AS marker, count(*) AS n
FROM m WHERE starts_with(m, 'THE ') OR starts_with(m, 'IN ') OR contains(m, 'LICENSED') GROUP BY ALL""")
def line_markers(spark: SparkSession, d: str) -> DataFrame:
    # A text is folded once; of its lines only those that may be markers are told apart.
    may = lambda line: line.rlike(rf"^{T.BLANK}*(?:THE|IN){T.BLANK}|LICENSED")
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.filter(F.split(F.upper(T.fold(F.col("text"))), "\n"), may)).alias("line"))
    marker = T.let(T.squeeze(F.col("line")), lambda norm: first_match(norm, [("^THE ", "objective"), ("^IN ", "essay"), ("LICENSED", "stop")]))
    return lines.select("doc_id", marker.alias("marker")).where("marker IS NOT NULL").groupBy("doc_id", "marker").agg(F.count("*").alias("n"))


# Answer keys: the text of a benchmark item read as a key, its words as answers


_KEY = r"SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS num FROM (SELECT item_id, string_split_regex(trim(text), '\s+') AS ws FROM benchmark)"


@query(rf"SELECT item_id, CAST(num AS INTEGER) AS num, CASE WHEN regexp_matches(upper(left(w, 1)), '^[A-E]$') THEN upper(left(w, 1)) END AS answer FROM ({_KEY})")
def manual_key(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("pos", "w"))
    letter = F.upper(F.left("w", F.lit(1)))
    return words.select("item_id", (F.col("pos") + 1).alias("num"), F.when(letter.rlike("^[A-E]$"), letter).alias("answer"))
