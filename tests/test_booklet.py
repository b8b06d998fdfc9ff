"""Pages to questions on items made by hand, and against plain loops."""

from __future__ import annotations

import json
import random
import re

from pyspark.sql import functions as F

from quillspark.operators import booklet, classify, layout
from quillspark.sources import readers

ITEMS = "doc int, page int, i int, font string, x double, w double, h double, baseline double, str string"
GLYPHS = [(3, " "), (0x141, "d"), (0x142, "e"), (0x143, "ti"), (0x144, "Q"), (0x145, "U"), (0x146, "S"), (0x147, "T"), (0x148, "A"), (0x149, "O"), (0x37E, "E"), (101, "?")]


def table(spark):
    return spark.createDataFrame(GLYPHS, "code int, text string")


def test_glyphs_one_to_one_several_and_dropped(spark, tmp_path):
    (tmp_path / "glyphs.json").write_text("".join(json.dumps({"code": c, "text": t}) + "\n" for c, t in GLYPHS))
    decode = layout.glyph_decoder(readers.lookup(spark, str(tmp_path / "glyphs.json"), "code int, text string"))
    cases = {"Łł": "de", "aŃb": "atib", "\x03\x01\x02x": " x", ";": "E", "·": "·", "e": "?", " ": " ", "ŃŃ": "titi", "Ι": "Ι"}
    rows = spark.createDataFrame(list(cases.items()), "s string, want string")
    assert [(r["got"], r["want"]) for r in rows.select(decode(F.col("s")).alias("got"), "want").collect() if r["got"] != r["want"]] == []


def test_fonts_are_decoded_by_their_share_of_glyph_ids(spark):
    decode = layout.glyph_decoder(table(spark))
    rows = [(1, 1, 0, "a", "Łłł"), (1, 1, 1, "a", "xy"), (1, 1, 2, "b", "Łłxyz"), (1, 1, 3, "c", "Łł"), (1, 2, 4, "b", "Łłx"), (1, 1, 5, "d", "ĚdoisĮ")]
    items = spark.createDataFrame(rows, "doc int, page int, i int, font string, str string")
    got = {r["i"]: r["str"] for r in layout.decoded(items, decode).collect()}
    # font b is mostly plain on page 1 and mostly glyph ids on page 2; c has too few characters; d isn't in glyph ids, its leaked ones go
    assert got == {0: "dee", 1: "xy", 2: "Łłxyz", 3: "Łł", 4: "dex", 5: " doisfi"}


def test_a_marker_is_tried_again_decoded(spark):
    decode = layout.glyph_decoder(table(spark))
    heading = "ńŅ;ņŇňŉ 07"  # QUESTAO 07 in glyph ids, in a font that stays as it is
    rows = [(1, 1, 0, 10.0, 50.0, 10.0, 20.0, heading), (1, 1, 1, 10.0, 50.0, 10.0, 50.0, "text"), (1, 1, 2, 10.0, 50.0, 10.0, 60.0, "text")]
    items = layout.positioned(spark.createDataFrame(rows, "doc int, page int, i int, x double, w double, h double, baseline double, str string"))
    assert layout.markers(items, 800.0).count() == 0
    assert [(r["kind"], r["num"]) for r in layout.markers(items, 800.0, decode=decode).collect()] == [("objective", 7)]


def test_lines_by_their_first_baseline_and_runs_by_gaps(spark):
    base = [100.0, 101.5, 104.5, 200.0, 202.0, 204.0]  # 1.5 apart share a line, 3 apart don't; of 0, 2, 4 the last begins a line
    rows = [(1, 1, k, "f", 10.0 + 50 * k, 48.0, 10.0, b, f"s{k}") for k, b in enumerate(base)] + [(1, 1, 9, "f", 400.0, 10.0, 10.0, 100.0, "far"), (1, 1, 10, "f", 5.0, 1.0, 10.0, 100.0, "  ")]
    got = layout.page_runs(spark.createDataFrame(rows, ITEMS)).orderBy("i").collect()
    assert [(r["str"], r["baseline"], r["x"], r["w"]) for r in got] == [("s0 s1", 100.0, 10.0, 98.0), ("far", 100.0, 400.0, 10.0), ("s2", 104.5, 110.0, 48.0), ("s3 s4", 200.0, 160.0, 98.0), ("s5", 204.0, 260.0, 48.0)]


def test_lines_are_assembled_as_a_loop_would(spark):
    rng = random.Random(8)
    rows = [(k, page, i, float(rng.choice([0, 40, 120, 350, 500, 790])), 100.0 + rng.choice([0, 1, 1.5, 2, 3, 4.5, 30]), f"r{i}") for k in range(12) for page in range(3) for i in range(rng.randrange(40))]
    want = []
    for key in range(12):
        lines = []
        for _, page, i, x, b, s in (r for r in rows if r[0] == key):
            met = next((n for n, line in enumerate(lines) if line[0] == page and abs(line[1] - b) <= 2 and abs(line[2] - x) < 400), None)
            if met is None or x <= lines[met][2] - 300:
                lines.append((page, b, x))
                met = len(lines) - 1
            want.append((key, page, i, met))
    frame = spark.createDataFrame(rows, "k int, page int, place int, x double, baseline double, str string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        got = [(r["k"], r["page"], r["place"], r["line"]) for r in layout.assembled(frame, ["k"], ["place"]).collect()]
        alone = layout.assembled(frame, ["k"], ["place"], reach=None).groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("line").alias("m")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted(want) and all(r["n"] == r["m"] for r in alone)


KEYWORDS = {
    "one": ("x", ["algo(ritmo)?s?", "\\btcp", "a\\*", "wi-?fi", "\x08dead", "p(a|b)c", "late", "busca (larga|funda)"]),
    "two": ("x", ["(rede|no)s?", "java\\b", "io", "alg", "ordem|fila", "ei", "dado", "c\\+\\+"]),
    "three": ("y", ["lei\\b", "agua", "terra"]),
}


def plain_topics(text, group, fallback):
    scores = []
    for k, (topic, (own, words)) in enumerate(KEYWORDS.items()):
        score = sum((3 if i < 6 else 2) * min(3, n) ** 0.7 for i, w in enumerate(words) if (n := len(re.findall(f"(?:^|[^a-z]){w}", text))))
        if own == group and score > 0:
            scores.append((-score, k, topic))
    scores.sort()
    return [t for i, (s, _, t) in enumerate(scores[:2]) if i == 0 or (-s >= 0.6 * -scores[0][0] and -s >= 4)] or [fallback[group]]


def test_topics_by_table_equal_the_patterns_one_by_one(spark):
    rng = random.Random(3)
    parts = ["algo", "algoritmos", "tcp", "a*", "wifi", "wi-fi", "pac", "late", "busca", "larga", "redes", "java", "javas", "io", "ordem", "fila", "lei", "leis", "agua", "c++", "zz", "9", "-", "dado", "x"]
    texts = [(k, rng.choice("xy"), " ".join(rng.choices(parts, k=rng.randrange(12)))) for k in range(300)] + [(900, "x", ""), (901, "y", None)]
    fallback = {"x": "none-x", "y": "none-y"}
    rows = [(t, k, g, i, w) for k, (t, (g, words)) in enumerate(KEYWORDS.items()) for i, w in enumerate(words)]
    keywords = spark.createDataFrame(rows, "topic string, ord int, grp string, pos int, regex string")
    index = {r["regex"]: r["key"] for r in classify.keyword_index(keywords).collect()}
    assert (index["algo(ritmo)?s?"], index["\\btcp"], index["a\\*"], index["wi-?fi"], index["ordem|fila"], index["\x08dead"], index["(rede|no)s?"]) == ("algo", "tcp", "a", "wi", "", "", "")
    got = classify.topics_by_table(spark.createDataFrame(texts, "id int, grp string, folded string"), keywords, fallback).collect()
    assert {r["id"]: r["topics"] for r in got} == {k: plain_topics(t or "", g, fallback) for k, g, t in texts}


def test_a_booklet_from_items_to_questions(spark):
    def line(page, y, *parts, h=10.0):
        return [(page, x, y, h, s) for x, s in parts]

    pages = [
        *line(1, 30.0, (40.0, "Componente Específico: Objeti"), (300.0, "vas 02 a 03")),
        *line(1, 45.0, (40.0, "Componente Específico: Discursivas D2")),
        *line(2, 50.0, (40.0, "Texto para as questões 01 a 02")),
        *line(2, 65.0, (40.0, "shared words")),
        *line(2, 90.0, (40.0, "QUESTÃO 01")),
        *line(2, 105.0, (40.0, "Qual lei"), (180.0, "é a certa?")),
        *[x for k, c in enumerate("ABCD") for x in line(2, 120.0 + 15 * k, (40.0, c), (60.0, f"{c.lower()} text"))],
        *line(2, 190.0, (40.0, "RASCUNHO")),
        *line(2, 200.0, (40.0, "not kept")),
        *line(3, 50.0, (40.0, "QUESTÃO DISCURSIVA")),
        *line(3, 65.0, (40.0, "Explique.")),
        *line(3, 90.0, (40.0, "QUESTÃO 02")),
        *line(3, 105.0, (40.0, "Assinale a INCORRETA.")),
        *line(3, 130.0, (40.0, "QUESTÃO DISCURSIVA")),
        *line(3, 145.0, (40.0, "algoritmos e tcp")),
        *line(3, 200.0, (40.0, "QUESTIONÁRIO DE PERCEPÇÃO")),
        *line(3, 215.0, (40.0, "QUESTÃO 09")),
    ]
    rows = [(1, p, k, "f", x, 6.0 * len(s), h, y, s) for k, (p, x, y, h, s) in enumerate(pages)]
    keywords = spark.createDataFrame([(t, k, {"x": "specific", "y": "general"}[g], i, w) for k, (t, (g, words)) in enumerate(KEYWORDS.items()) for i, w in enumerate(words)], "topic string, ord int, grp string, pos int, regex string")
    tables = booklet.Lookups(
        spark.createDataFrame([(1, "2021-x", 2021)], "doc int, exam string, year int"),
        spark.createDataFrame([(1, 1, "B"), (1, 2, None)], "doc int, num int, answer string"),
        keywords,
        {"specific": "two", "general": "three"},
        table(spark),
        spark.createDataFrame([("2021-x-d1", ["fixed"])], "id string, topics array<string>"),
        spark.createDataFrame([("img/2021-x/q01.webp", 10, 20)], "path string, w int, h int"),
    )
    found = booklet.question_table(booklet.parse(spark.createDataFrame(rows, ITEMS), tables, 560.0, 800.0), tables).collect()
    got = {r["id"]: r for r in found}
    assert sorted(got) == ["2021-x-d1", "2021-x-d2", "2021-x-q01", "2021-x-q02"]
    q1, q2, d1, d2 = (got[f"2021-x-{k}"] for k in ("q01", "q02", "d1", "d2"))
    assert q1["statement"] == "Qual lei\né a certa?" and [tuple(a) for a in q1["alternatives"]] == [(c, f"{c.lower()} text") for c in "ABCD"]
    assert (q1["section"], q1["answer"], q1["annulled"], q1["topics"], q1["w"], q1["page"], q1["img"]) == ("general", "B", False, ["three"], 10, 2, "img/2021-x/q01.webp")
    assert q1["shared_texts"] == q2["shared_texts"] == ["2021-x-t01-02"] and d1["shared_texts"] == []
    assert (q2["section"], q2["answer"], q2["annulled"], q2["negative"], q2["alternatives"], q2["topics"], q2["format"]) == ("specific", None, True, True, [], ["two"], "conceptual")
    assert (d1["section"], d1["topics"], d1["format"], d1["statement"], d1["annulled"]) == ("general", ["fixed"], "essay", "Explique.", False)
    assert (d2["section"], d2["topics"], d2["num"], d2["negative"]) == ("specific", ["one"], 2, False)
    joined = booklet.question_table(booklet.parse(spark.createDataFrame(rows, ITEMS), tables, 560.0, 800.0, reach=300.0), tables).where("id = '2021-x-q01'").first()
    assert joined["statement"] == "Qual lei é a certa?" and joined["alternatives"] == q1["alternatives"]
