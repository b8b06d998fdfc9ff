"""Small tables on which a query was wrong, or did less than its whole job."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.operators import answers, booklet, classify, layout, search, study
from quillspark.plans import registry

TALK = "conv_id long, turn int, role string, text string"


@pytest.fixture
def same_as_sql(spark, tmp_path):
    """Rows of a query over given tables, once they are those of its SQL."""

    def run(name, **tables):
        con = duckdb.connect()
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        df, there = registry.queries()[name](spark, str(tmp_path)), con.sql(registry.oracle_sql()[name])
        assert sorted(df.columns) == sorted(there.columns)
        mine = sorted((tuple(r[c] for c in there.columns) for r in df.collect()), key=repr)
        assert mine == sorted(there.fetchall(), key=repr)
        return mine

    return run


FAR = [(1, 0, "user", "Nicht so. " + "a b " * 200), (2, 0, "user", "xnever1 " + "a b " * 200), (3, 0, "user", "NOT " + "a b " * 200), (4, 0, "user", None)]


def test_negative_words_count_in_the_whole_text(same_as_sql):
    assert same_as_sql("negative_command", conversations=(FAR, TALK)) == [(1, 0, True), (2, 0, True), (3, 0, False), (4, 0, None)]


def test_negative_words_of_the_whole_text_are_counted(same_as_sql):
    assert same_as_sql("negative_count", conversations=(FAR, TALK)) == [("user", 2)]


def test_nearest_goes_through_a_range_once(spark):
    left = spark.range(400).selectExpr("id", "CAST(pmod(hash(id), 997) AS DOUBLE) AS x")
    right = spark.range(90).selectExpr("id AS key", "CAST(pmod(hash(id, 1), 500) * 2 AS DOUBLE) AS y")
    found = study.nearest(left, right)
    assert "UNBOUNDED FOLLOWING" not in found._jdf.queryExecution().toString().upper().replace("UNBOUNDEDFOLLOWING", "UNBOUNDED FOLLOWING")
    points = [(r["y"], r["key"]) for r in right.collect()]
    want = {r["id"]: min((abs(y - r["x"]), key) for y, key in points) for r in left.collect()}
    assert {r["id"]: (r["distance"], r["nearest"]) for r in found.collect()} == want


LEXICON = classify.Lexicon({"one": ["ment", "mente", "me", "an"], "two": ["que", "m", "el|xx", "anel"]}, "none")
TEXTS = [("mente mental me an-anel que,que que que el",), ("\nanel xx1an ament\u00e9mente _me 0que",), ("",), (None,), ("xel ael",)]


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_literal_keywords_are_counted_in_one_pass(spark):
    texts = spark.createDataFrame(TEXTS, "f string")
    by_one = {t: sum(F.lit(3.0) * F.pow(F.least(F.lit(3), F.regexp_count("f", F.lit(f"(^|[^a-z]){w}"))), F.lit(0.7)) for w in ws) for t, ws in LEXICON.topics.items()}
    found = texts.select("f", LEXICON.found(F.col("f")).alias("found"))
    mine = found.select(*[s.alias(t) for t, s in LEXICON.scores(F.col("f"), F.col("found")).items()])
    assert [tuple(r) for r in mine.collect()] == [tuple(r) for r in texts.select(*[s.alias(t) for t, s in by_one.items()]).collect()]
    assert optimized(mine).count("regexp_extract_all") == 2  # all literals, and the one pattern


def test_a_text_is_folded_once_for_its_topics(spark):
    named = classify.Lexicon({"one": ["ment", "mente"], "two": ["que", "an"]}, "none")
    df = spark.createDataFrame(TEXTS, "f string").select(named.classify(F.lower("f")).alias("t"))
    assert [r["t"] for r in df.collect()] == [["two", "one"], ["two", "one"], ["none"], ["one", "two"], ["none"]]
    assert optimized(df).count("lower(f") == 1


def test_texts_are_not_shuffled_for_their_topics(spark):
    keywords = spark.createDataFrame([("t", 0, "g", 0, "an"), ("t", 0, "g", 1, "b(c|d)"), ("u", 1, "g", 0, "an"), ("v", 2, None, 0, "an")], "topic string, ord int, grp string, pos int, regex string")
    texts = spark.createDataFrame([(1, "g", "an anb bc"), (2, "g", "xan"), (3, "g", None), (4, None, "an"), (1, "g", "an")], "id int, grp string, folded string")
    found = classify.topics_by_table(texts, keywords, {"g": "u"})
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # the keywords
    assert sorted((r["id"], tuple(r["topics"])) for r in found.collect()) == [(1, ("t", "u")), (1, ("t",)), (2, ("u",)), (3, ("u",)), (4, ())]
    counts = classify.keyword_counts(texts.where("id = 1 AND folded <> 'an'"), keywords)
    assert sorted(tuple(r) for r in counts.collect()) == [(1, "t", 0, 0, 2), (1, "t", 0, 1, 1), (1, "u", 1, 0, 2)]


def test_a_text_is_folded_once_for_its_lines(spark, tmp_path):
    texts = ["The one\n  tHé two\n IN x\nThe\nthe \nThem\nx Licenséd\nin  licensed", "", None, "the licensed b\nIné a\nTHE\tx\nlicenſed"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.queries()["line_markers"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == [(0, "essay", 2), (0, "objective", 2), (0, "stop", 1), (3, "objective", 2), (3, "stop", 1)]
    assert optimized(found).count("octet_length(") == 1


def test_the_index_shuffles_no_postings(spark, tmp_path):
    texts = [(1, "abcd abc"), (2, None), (3, "xabc"), (4, "\U0001f600bc"), (5, "ab")]
    search.build_index(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), "doc_id", "text", str(tmp_path))
    found = spark.read.parquet(f"{tmp_path}/postings").collect()
    assert {r["gram"]: list(r["keys"]) for r in found} == {"abc": [1, 3], "bcd": [1], "cd ": [1], "d a": [1], " ab": [1], "xab": [3], "\U0001f600bc": [4]}
    assert [r["gram"] for r in found] == sorted(r["gram"] for r in found)


def test_keys_of_files_need_one_shuffle(spark):
    found = registry.queries()["key_strategy"](spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    rows = [("g", 1, " 1  2  30"), ("g", 2, "A  * E"), ("g", 3, "x B"), ("n", 1, "QUESTAO 1 A"), ("e", 1, None)]
    hand = [("h", 7, "A"), ("h", 7, None), ("h", 7, "A")]
    files = spark.createDataFrame([(f,) for f in "gnhez"], "file string")
    got = answers.best_key(files, spark.createDataFrame(hand, "file string, num int, answer string"), spark.createDataFrame(rows, "file string, row int, text string"))
    want = [("e", "grid", None, None), ("g", "grid", 1, "A"), ("g", "grid", 2, None), ("h", "manual", 7, "A"), ("h", "manual", 7, "A"), ("h", "manual", 7, None), ("n", "grid", None, None), ("z", "none", None, None)]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def page_items(spark):
    """Three pages of a document with footers that repeat, and a heading on each."""
    rows = [(1, p, i, 10.0 + i, 30.0, h, b, s) for p in range(3) for i, (h, b, s) in enumerate([(10.0, 50.0, f"Questão 0{p + 1}"), (10.0, 80.0, "an item"), (9.0, 100.0, "RASCUNHO\u00a0x"), (8.0, 780.0, f"foot {p}"), (8.0, 775.0, f"no foot {p}" if p else "x")])]
    return layout.positioned(spark.createDataFrame(rows, "doc int, page int, i int, x double, w double, h double, baseline double, str string"))


def test_frames_and_markers_need_few_of_the_items(spark):
    items = page_items(spark)
    framed, marks = layout.framed_markers(items, 800.0)
    assert sorted(map(tuple, framed.collect())) == sorted(map(tuple, layout.frames(items, 800.0).collect()))
    got = [(r["page"], r["kind"], r["num"]) for r in marks.orderBy("page", "i").collect()]
    assert got == [(p, k, n) for p in range(3) for k, n in (("objective", p + 1), ("stop", None))]


def test_margins_read_no_items_again(spark):
    assert "posexplode" not in optimized(registry.queries()["page_margins"](spark, "/root/testdata/sf0.001"))


def test_sections_of_blocks_read_no_items_again(spark):
    found = registry.queries()["block_sections"](spark, "/root/testdata/sf0.001")
    assert "Generate" not in optimized(found).replace("Generate explode(sequence", "")


def test_runs_of_booklets_are_made_once(spark, monkeypatch):
    monkeypatch.setattr(booklet, "staged", lambda df: df)
    rows = [(d, p, i, "f", 10.0 + 100 * i, 30.0, 10.0, 50.0, f"multi plo {i}" if d else "multiplo") for d in (0, 1) for p in (0, 1) for i in (0, 1)]
    items = spark.createDataFrame(rows + [(2, p, 0, "f", 10.0, 30.0, 10.0, 50.0, "x" if p else "multi plo") for p in (0, 1)], "doc int, page int, i int, font string, x double, w double, h double, baseline double, str string")
    found = booklet.runs(items, lambda text: text)
    assert "Join" not in optimized(found) and optimized(found).count("MapInArrow") == 1
    assert {(r["doc"], r["str"]) for r in found.collect()} == {(0, "multiplo"), (1, "multiplo 0"), (1, "multiplo 1"), (2, "x"), (2, "multi plo")}
