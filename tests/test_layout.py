"""Answer keys, layout and questions on rows made by hand."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import answers, layout, questions, search, statistics


def one(spark, column, *values):
    names = [f"c{k}" for k in range(len(values))]
    return spark.createDataFrame([values], names).select(column(*map(F.col, names)).alias("x")).first()["x"]


def test_formats_in_their_order(spark):
    cases = [
        ("assertion-reason", "x", ["As asserções I e II são proposições falsas."]),
        ("assertion-reason", "As asserções PORQUE", ["a", "b"]),
        ("statements", "x", ["I, apenas.", "I e  II", "I, II e III.", "V", "nada"]),
        ("true-false", "x", ["V - F - V", "F,F,V.", "V V V", "VFV", "F–V–F"]),
        ("matching", "x", ["1 - A", "2 – b", "AB, CD, EF.", "IV - x", "3) c"]),
        ("code", "Observe o código a seguir", ["a", "b"]),
        ("code", "int a=1; int b=2", ["a", "b"]),
        ("conceptual", "return", ["a", "b"]),
        ("calculation", "x", ["12,5", "3 m", "40 %", "1/2", "seis"]),
        ("interpretation", "Com base na figura", ["a", "b"]),
        ("conceptual", "figuras", []),
    ]
    rows = spark.createDataFrame([(k, s, a) for k, s, a in cases], "want string, s string, a array<string>")
    found = rows.select("want", questions.detect_format(F.col("s"), F.col("a")).alias("got")).collect()
    assert [r["got"] for r in found] == [r["want"] for r in found]


def test_statements_are_counted_by_e_alone(spark):
    texts = {"I, II e III": 2, "I, apenas.": 1, "I e II e IV": 3, ",": None}
    for text, n in texts.items():
        assert one(spark, questions.statement_count, text) == n
    assert one(spark, lambda c: questions.statement_count(c, corrected=True), "I, II e III") == 3


def test_keys(spark):
    rows = [(1, k, f"QUESTAO 0{k} {'ABCDE'[k % 5]}") for k in range(1, 6)] + [(1, 9, "QUESTAO 02 ANULADA"), (1, 10, "QUESTAO 03 *")]
    rows += [(2, k, f"{k} {'ABCDE'[k % 5]}") for k in range(1, 6)] + [(3, 0, "1  2  3"), (3, 1, "A  B  C"), (3, 2, "   *"), (3, 3, "4 5 6"), (3, 4, "D E")]
    frame = spark.createDataFrame(rows, "file long, row long, text string")
    files = spark.createDataFrame([(k,) for k in range(1, 6)], "file long")
    manual = spark.createDataFrame([(5, 1, None)], "file long, num int, answer string")
    found = {}
    for r in answers.best_key(files, manual, frame).collect():
        found.setdefault((r["file"], r["method"]), {})[r["num"]] = r["answer"]
    assert found[1, "list"] == {1: "B", 2: None, 3: "D", 4: "E", 5: "A"}
    assert found[2, "pairs"] == {1: "B", 2: "C", 3: "D", 4: "E", 5: "A"}
    assert found[3, "grid"] == {1: "A", 2: None, 3: "C", 4: "D", 5: "E"}
    assert found[4, "none"] == {None: None} and found[5, "manual"] == {1: None}


def test_cover_ranges(spark):
    whole = "FORMACAO GERAL/OBJETIVAS 1 A 8 COMPONENTE ESPECIFICO: OBJETIVAS 09 A 35 COMPONENTE ESPECIFICO: DISCURSIVAS D3 A D5"
    assert tuple(one(spark, layout.cover_ranges, whole)) == (9, 35, [3, 4, 5])
    assert tuple(one(spark, layout.cover_ranges, "FORMACAO GERAL OBJETIVAS 1 A 8")) == (9, None, [])
    assert one(spark, layout.cover_ranges, "nothing") is None


def test_markers_and_text_repairs(spark):
    items = [(1, 1, 0, 10.0, 50.0, 10.0, 20.0, "Questão 07"), (1, 1, 1, 10.0, 50.0, 5.0, 40.0, "Questão 08"), (1, 1, 2, 300.0, 50.0, 10.0, 60.0, "Questão Discursiva 3"), (1, 1, 3, 10.0, 50.0, 4.0, 80.0, "Rascunho"), (1, 1, 4, 10.0, 50.0, 10.0, 100.0, "Texto para as questões 31 a 33"), (1, 1, 5, 10.0, 5.0, 10.0, 790.0, "Questão 09")]
    frame = layout.positioned(spark.createDataFrame(items, "doc int, page int, i int, x double, w double, h double, baseline double, str string"))
    found = {r["i"]: (r["kind"], r["num"], r["nums"]) for r in layout.markers(frame, 800.0).collect()}
    assert found == {0: ("objective", 7, None), 2: ("essay", 3, None), 3: ("stop", None, None), 4: ("shared", None, [31, 32, 33])}
    assert layout.columns(layout.markers(frame, 800.0), 560.0).first()["split"] == 292.0
    assert one(spark, layout.repair_ligatures, "objeti vas e matt er, ti po") == "objetivas e matter, ti po"
    assert one(spark, layout.leaked_glyphs, "aĚbĮcĴdͳ") == "a bfic(d-"


def test_files_and_their_choice(spark):
    urls = ["/2019/provas/x", "/a/2021_PV_2_engenharia_da_computacao.pdf", "/a/2021_pv_1_a_3_engenharia_da_computacao.pdf", "/gabaritos/2021/letras_lic.pdf", "/a/2021_GB_nutricao_alta_05.pdf", "/a/2021_pv_nvda.pdf", "/a/2021_outra.pdf"]
    files = spark.createDataFrame([(k, 2021, u) for k, u in enumerate(urls)], "seq long, year int, url string")
    found = {r["seq"]: r for r in questions.describe_files(files).collect()}
    assert sorted(found) == [1, 2, 3, 4]
    assert (found[1]["course"], found[1]["booklet"], found[1]["type"]) == ("engenharia_da_computacao", 2, "exam")
    assert (found[2]["booklet"], found[2]["range_from"], found[2]["range_to"]) == (None, 1, 3)
    assert found[3]["modality"] == "teaching" and (found[4]["course"], found[4]["type"]) == ("nutricao", "answerKey")
    best = {r["course"]: r for r in questions.select_exams(questions.describe_files(files)).collect()}
    assert best["engenharia_da_computacao"]["exam"] == "2021_pv_1_a_3_engenharia_da_computacao.pdf" and best["nutricao"]["exam"] is None


@pytest.mark.parametrize("limit", [20_000, 3])
def test_places_by_counting(spark, monkeypatch, limit):
    monkeypatch.setattr(statistics, "RANKED", limit)
    monkeypatch.setattr(statistics, "BINS", 4)
    rng = random.Random(2)
    rows = [(g, float(rng.choice([0, 1, 1, 1, 5, 1000, rng.random()]))) for g in "abc" for _ in range(rng.randint(1, 60))]
    frame = spark.createDataFrame(rows, "g string, v double")
    found = {r["g"]: (r["upper_median"], r["n"]) for r in statistics.upper_median(frame, "g", "v").collect()}
    for g in "abc":
        own = sorted(v for k, v in rows if k == g)
        assert found[g] == (own[len(own) // 2], len(own))
    keys = spark.createDataFrame([(k * 7,) for k in range(50)], "k long")
    assert search.daily(keys, "k", 3).first()["k"] == 3 * 7919 % 50 * 7 and search.daily(keys.limit(0), "k", 3).count() == 0


def test_filter_by_every_facet(spark):
    rows = [(1, "objective", None, ["a", "b"], "uma ÁRVORE"), (2, "objective", True, ["a"], "arvore"), (3, "essay", False, ["a"], "arvore"), (4, "objective", False, ["c"], "arvore"), (5, "objective", False, ["a"], "folha"), (6, "objective", False, ["b"], "arvore")]
    frame = spark.createDataFrame(rows, "id int, kind string, annulled boolean, topics array<string>, text string")
    flags = spark.createDataFrame([(1,), (6,)], "id int")
    spec = search.FilterSpec(overlap={"topics": ["a", "b"]}, kind="objective", flagged=True, terms="árvore", seed=1)
    from quillspark.functions.text import fold

    assert {r["id"] for r in search.filtered(frame, spec, fold(F.col("text")), "id", flags).collect()} == {1, 6}


def test_blocks_go_on_over_columns_and_pages_until_a_stop_or_the_end(spark):
    kind = "doc int, page int, i int, x double, top double, kind string, num int"
    marks = [(1, 2, 0, 20.0, 50.0, "objective", 1), (1, 2, 1, 300.0, 80.0, "objective", 2), (1, 2, 2, 300.0, 200.0, "stop", None), (1, 4, 0, 20.0, 90.0, "essay", None), (1, 4, 1, 20.0, 300.0, "end", None), (1, 4, 2, 20.0, 400.0, "objective", 9)]
    pages = spark.createDataFrame([(1, p, 700.0) for p in range(1, 6)], "doc int, page int, footer_top double")
    found = layout.segments(spark.createDataFrame(marks, kind), pages, 600.0).orderBy("block", "page", "col").collect()
    got = [(r["block"], r["kind"], r["num"], r["page"], r["col"], r["x0"], r["x1"], r["y0"], r["y1"]) for r in found]
    assert got == [
        (1, "objective", 1, 2, 0, 12.0, 292.0, 48.0, 700.0),
        (1, "objective", 1, 2, 1, 292.0, 588.0, 46.0, 78.0),
        (2, "objective", 2, 2, 1, 292.0, 588.0, 78.0, 198.0),
        (3, "essay", None, 4, 0, 12.0, 588.0, 88.0, 298.0),
    ]
    items = spark.createDataFrame([(1, 2, 0, 290.0, 10.0, 100.0, 110.0), (1, 2, 1, 270.0, 90.0, 47.0, 60.0), (1, 2, 2, 12.0, 5.0, 690.0, 703.0), (1, 3, 0, 50.0, 5.0, 100.0, 110.0)], "doc int, page int, i int, x double, w double, top double, bottom double")
    inside = layout.contained(items, layout.segments(spark.createDataFrame(marks, kind), pages, 600.0)).select("i", "block").collect()
    assert sorted(map(tuple, inside)) == [(0, 2), (1, 1)]


def _split(lines):
    marks = [x[0] if x[:1] in tuple("ABCDE") and (len(x) == 1 or x[1].isspace()) else "" for x in lines]
    for start in reversed([k for k, m in enumerate(marks) if m == "A"]):
        places = [start]
        for k in range(start + 1, len(lines)):
            if len(places) < 5 and marks[k] == "ABCDE"[len(places)]:
                places.append(k)
        if len(places) >= 4:
            ends = [*places[1:], len(lines)]
            return "\n".join(lines[:start]), [" ".join(" ".join([lines[a][1:].lstrip(), *lines[a + 1 : b]]).split()) for a, b in zip(places, ends, strict=True)]
    return "\n".join(lines), []


def test_questions_split_as_a_loop_would(spark):
    rng = random.Random(5)
    cases = [[], ["A"], ["A x", "B y", "C z", "D w"], ["A x", "B", "C", "D", "E", "A y", "B", "C"], ["x", "A 1", "more", "B 2", "B 3", "C", "D 4", "E 5", "E 6"]]
    cases += [[rng.choice(["A one", "B two", "C", "D four", "E  five", "word", "Also", "B2"]) for _ in range(rng.randrange(30))] for _ in range(200)]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, lines array<string>").select("k", questions.split_question(F.col("lines")).alias("q")).orderBy("k").collect()
    assert [(r["q"]["statement"], r["q"]["alternatives"]) for r in rows] == [_split(c) for c in cases]


def test_ligatures_are_repaired_where_many_are_broken(spark):
    rows = [("a", "solu ti bati do"), ("a", "aft er"), ("b", "bati do"), ("b", "ok"), (None, "ati b")]
    got = layout.repaired(spark.createDataFrame(rows, "s string, t string"), "s", "t").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [("a", "solu ti batido"), ("a", "after"), ("b", "bati do"), ("b", "ok"), (None, "atib")]))


def test_letters_of_groups_without_answers_are_zero(spark):
    groups, answers_ = spark.createDataFrame([(1,), (2,)], "g int"), spark.createDataFrame([(1, "A"), (1, None), (1, "C"), (1, "A")], "g int, a string")
    got = statistics.letter_grid(groups, answers_, "g", "a", list("ABC")).orderBy("g").collect()
    assert [tuple(r) for r in got] == [(1, 2, 0, 1, 3), (2, 0, 0, 0, 0)]
