"""Spellings, facets, the index, bundles, states and snapshots on small rows."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import answers, questions, search, statistics
from quillspark.sources import readers
from quillspark.streaming import attempts as stream


def test_words_are_shown_as_they_are_spelled_most(spark):
    tokens = spark.createDataFrame([("ordenação", 1), ("ordenacao", 2), ("ordenação", 3), ("fila", 4), ("fíla", 5), ("other", 6)], "word string, ord int")
    terms = spark.createDataFrame([("ordenacao", 3), ("fila", 2), ("none", 1)], "word string, n int")
    got = statistics.displayed(terms, "word", tokens)
    assert got.columns == ["word", "n"] and {tuple(r) for r in got.collect()} == {("ordenação", 3), ("fila", 2), ("none", 1)}


def test_alternatives_count_once_and_their_words_each(spark):
    rows = spark.createDataFrame([("Todos e só", True), ("nunca, TODOS", False), ("nuncamais", False), ("nada", True)], "text string, correct boolean")
    hits = statistics.whole_words(F.col("text"), ["todos", "nunca", "so"])
    assert statistics.alternative_rates(rows, hits).first().asDict() == {"correct_pct": 50.0, "distractor_pct": 50.0, "correct": 2, "distractors": 2}
    assert {tuple(r) for r in statistics.alternative_words(rows, hits, 1).collect()} == {("todos", 1, 1), ("so", 1, 0), ("nunca", 0, 1)}


def test_zeros_stay_where_they_are_shown(spark):
    rows = spark.createDataFrame([("a", ["x", "y", "x"]), ("b", ["x"]), ("b", []), (None, None)], "exam string, topics array<string>")
    dims = spark.createDataFrame([("exam", "a", "A", 0, True), ("exam", "b", "B", 1, True), ("exam", "c", "C", 2, True), ("topic", "x", "X", 0, False), ("topic", "z", "Z", 1, False)], "facet string, value string, label string, ord int, shown boolean")
    got = search.facet_table(rows, dims, {"exam": "exam", "topic": "topics"}).collect()
    assert {(r["facet"], r["value"], r["label"], r["ord"], r["n"]) for r in got} == {("exam", "a", "A", 0, 1), ("exam", "b", "B", 1, 2), ("exam", "c", "C", 2, 0), ("topic", "x", "X", 0, 2)}


def test_topics_count_once_by_exam_and_empty_ones_go(spark):
    rows = spark.createDataFrame([("a", ["x", "x", "y"]), ("b", ["x", "w"])], "exam string, topics array<string>")
    assert {tuple(r) for r in statistics.topic_pivot(rows, ["x", "y", "z"], ["a", "b", "c"]).collect()} == {("x", 2, 1, 1, 0), ("y", 1, 1, 0, 0)}


def test_the_index_finds_what_contains_finds(spark, tmp_path):
    rng = random.Random(7)
    texts = [(k, "".join(rng.choices("abcÁç \n", k=rng.randrange(60)))) for k in range(150)] + [(900, None), (901, ""), (902, "%_\\ a.c")]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    search.build_index(docs, "doc_id", "text", str(tmp_path))
    for query in ("abc", "áb ca", "abca bc", "a", "", "zzz", "cab  ÇA", "_\\ a.c"):
        want = {r["doc_id"] for r in docs.where("text IS NOT NULL").where(search.all_terms(T.fold(F.col("text")), query)).collect()}
        assert {r["key"] for r in search.search_index(spark, str(tmp_path), query).collect() if r["folded"] is not None} == want, query


def test_bundles_nest_and_come_back(spark, tmp_path):
    exams = spark.createDataFrame([("e1", 2021), ("e2", 2022)], "exam_id string, year int")
    rows = spark.createDataFrame([("e1", "q2", ["b"]), ("e1", "q1", ["a", "é"])], "exam_id string, id string, topics array<string>")
    texts = spark.createDataFrame([("e1", "t", 'say "x"\n')], "exam_id string, id string, text string")
    found = readers.bundle(exams, rows, texts)
    body = {r["exam_id"]: json.loads(r["body"]) for r in found.collect()}
    assert body["e1"] == {"exam_id": "e1", "year": 2021, "questions": [{"id": "q1", "topics": ["a", "é"]}, {"id": "q2", "topics": ["b"]}], "sharedTexts": [{"id": "t", "text": 'say "x"\n'}]}
    assert body["e2"]["questions"] == [] and body["e2"]["sharedTexts"] == []
    readers.write_bundles(found, str(tmp_path / "b"))
    back = readers.read_bundles(spark, str(tmp_path / "b"), "exam_id string, year int, title string, questions array<struct<id:string,topics:array<string>>>, notes array<string>").orderBy("exam_id").collect()
    assert [(r["exam_id"], r["title"], [q["id"] for q in r["questions"]], r["notes"]) for r in back] == [("e1", None, ["q1", "q2"], []), ("e2", None, [], [])]


def test_states_are_merged_over_a_new_one(spark):
    states = [("a", json.dumps({"version": 2, "flagged": {"q": True}, "filters": {"kind": "all"}, "attempts": {"q": [{"choice": "A", "ok": None}]}})), ("b", "{broken"), ("c", None), ("d", "{}")]
    got = {r["user"]: r for r in readers.merged_states(spark.createDataFrame(states, "user string, body string"), "user", "body").collect()}
    assert got["a"]["flagged"] == {"q": True} and got["a"]["filters"]["kind"] == "all" and got["a"]["attempts"]["q"][0]["choice"] == "A" and got["a"]["examDate"] == ""
    for user in "bcd":
        assert (got[user]["version"], got[user]["attempts"], got[user]["mockExams"], got[user]["session"], got[user]["filters"]["kind"], got[user]["drafts"]) == (2, {}, [], None, "objective", {})


def test_a_snapshot_stays_whole_and_compact(spark, tmp_path):
    kind = "user string, question string, ok boolean, at timestamp, seq long"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    assert stream.read_snapshot(spark, out, kind).count() == 0
    batches = [[(f"u{k % 7}", f"q{k % 5}", k % 2 == 0, k) for k in range(60)], [("u1", "q1", None, 100), ("u1", "q1", True, 99), ("u9", "q9", True, 5)], [("u1", "q1", False, 3)]]
    last, seen = {}, 0
    for rows in batches:
        frame = spark.createDataFrame([(u, q, ok, k) for u, q, ok, k in rows], "user string, question string, ok boolean, k long").select("user", "question", "ok", F.timestamp_seconds("k").alias("at"), F.col("k").alias("seq"))
        frame.coalesce(1).write.mode("append").parquet(source)
        stream.keep_snapshot(spark.readStream.schema(kind).parquet(source), out, str(tmp_path / "cp"), buckets=4).awaitTermination()
        for u, q, ok, k in rows:
            if (u, q) not in last or k >= last[u, q][1]:
                last[u, q] = (ok, k)
        got = stream.read_snapshot(spark, out, kind).collect()
        assert {(r["user"], r["question"]): (r["ok"], r["seq"]) for r in got} == last and len(got) == len(last)
        seen += 1
    assert len(list((tmp_path / "out" / "manifest").iterdir())) == 2
    named = {(p.parent.name, p.name) for p in (tmp_path / "out" / "rows").glob("version=*/bucket=*")}
    assert len(named) <= 8


def test_labels_and_numbers(spark):
    rows = spark.createDataFrame([(1, "objective", 7, "general", 2021, "ciencia_da_computacao", "code"), (2, "essay", 3, "specific", 2014, "design_grafico", "essay")], "id int, kind string, num int, section string, year int, course string, format string")
    formats = spark.createDataFrame([("code", "Código")], "format string, label string")
    got = {r["id"]: tuple(r)[1:] for r in questions.labels(rows, {"ciencia_da_computacao": "Ciência da Computação"}, formats).collect()}
    assert got[1] == ("Questão 07", "Formação Geral", "Ciência da Computação (2021)", "CC", "Código")
    assert got[2] == ("Discursiva 3", "Componente Específico", "Design Grafico (2014)", "Design Grafico", "Discursiva")
    row = spark.range(1).select(T.brazilian(F.lit(1234567.891), 1).alias("a"), T.plural(F.lit(1), "dia", "dias").alias("b"), T.plural(F.lit(1200), "dia", "dias").alias("c"), T.brazilian(F.lit(-2.5)).alias("d")).first()
    assert tuple(row) == ("1.234.567,9", "1 dia", "1.200 dias", "-2")


def test_keys_by_hand(spark):
    listed = spark.createDataFrame([("f", " A  *\nC"), ("g", ""), ("h", None)], "file string, answers string")
    assert sorted(tuple(r) for r in answers.manual_key(listed).collect()) == [("f", 1, "A"), ("f", 2, None), ("f", 3, "C")]


def test_scratch_paths_are_cleared(spark):
    from pathlib import Path

    from quillspark import staging

    path = staging.scratch(spark, "x")
    spark.range(3).write.parquet(path)
    assert Path(path).exists()
    staging.clear(spark)
    assert not Path(path).exists()
    assert staging.staged(spark.range(5).selectExpr("id * 2 AS v")).agg(F.sum("v")).first()[0] == 20


def test_word_lists_of_portuguese_exams(spark):
    from quillspark.functions import portuguese

    row = spark.range(1).select(F.lit("A seguir, considere os sistemas de informações: árvores-B, ÁRVORES e apenas memória").alias("t"))
    got = row.select(T.words(F.col("t"), portuguese.STOP_WORDS).alias("w"), statistics.whole_words(F.col("t"), portuguese.ABSOLUTE_WORDS).alias("h")).first()
    assert got["w"] == ["arvores-b", "arvores", "memoria"] and got["h"] == ["apenas"]
    assert len(set(portuguese.STOP_WORDS)) == 145 and len(portuguese.ABSOLUTE_WORDS) == 19
