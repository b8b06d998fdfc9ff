from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from quillspark.functions.text import fold
from quillspark.operators import search, statistics, study
from quillspark.operators.classify import Lexicon, first_match, negative


def test_anchor_groups_are_not_transitive(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 2.0), (1, 4.0), (1, 4.5), (2, 7.0)], "k int, v double")
    assert sorted((r["k"], r["v"], r["grp"]) for r in study.anchored(df, ["k"], "v", 2.0).collect()) == [(1, 0.0, 0), (1, 2.0, 0), (1, 4.0, 1), (1, 4.5, 1), (2, 7.0, 0)]


def run_of(letters, least=4):
    """From the last A on, the greedy run of letters in order."""
    n = 0
    for x in letters[len(letters) - 1 - letters[::-1].index("A") :] if "A" in letters else []:
        n += n < 5 and x == "ABCDE"[n]
    return "ABCDE"[:n] if n >= least else None


def test_ordered_subsequence_starts_at_last_first_letter(spark):
    cases = [list("ABCABCDE"), list("ABXCDY"), list("BCDE"), list("ABC"), list("AEBDCD")]
    assert [run_of(c) for c in cases] == ["ABCDE", "ABCD", None, None, "ABCD"]
    rows = spark.createDataFrame([(k, i, x) for k, c in enumerate(cases) for i, x in enumerate(c)], "u int, t int, l string")
    assert sorted(map(tuple, study.in_order(rows, "u", ["t"], "l", "ABCDE", 4).collect())) == [(k, run_of(c)) for k, c in enumerate(cases)]


def test_islands_trim_only_edges(spark):
    df = spark.createDataFrame([([1, 0, 1, 1, 0, 1, 0, 1, 1, 0, 1],), ([1],), ([0, 0],), ([1, 1],)], "v array<int>")
    found = [[tuple(x) for x in r["r"]] for r in df.select(study.islands(F.col("v"), 2).alias("r")).collect()]
    assert found == [[(2, 3), (5, 5), (7, 8)], [], [], [(0, 1)]]


def test_content_range_drops_far_specks(spark):
    def loop(on, tiny, apart):
        groups = []
        for i, x in enumerate(on):
            if x and groups and i - groups[-1][1] <= 1:
                groups[-1][1] = i
            elif x:
                groups.append([i, i])
        small = lambda g: g[1] - g[0] < tiny
        while len(groups) > 1 and small(groups[-1]) and groups[-1][0] - groups[-2][1] > apart:
            groups.pop()
        while len(groups) > 1 and small(groups[0]) and groups[1][0] - groups[0][1] > apart:
            groups.pop(0)
        return (groups[0][0], groups[-1][1]) if groups else (-1, -1)

    rng = random.Random(5)
    cases = [[], [0], [1], [1, 0, 0, 0, 1], *[[int(rng.random() < share) for _ in range(40)] for share in (0.1, 0.2, 0.4) for _ in range(30)]]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, v array<int>")
    for tiny, apart in ((1, 2), (2, 4)):
        got = {r["i"]: (r["r"]["first"], r["r"]["last"]) for r in df.select("i", study.content_range(F.col("v"), tiny, apart).alias("r")).collect()}
        assert got == {i: loop(c, tiny, apart) for i, c in enumerate(cases)}


def test_anchored_rows_carry_their_group_over_batches(spark):
    rng = random.Random(3)
    rows = [(k, float(rng.randrange(40 * n))) for k, n in ((None, 5), (1, 9), (2, 300)) for _ in range(n)]
    want = []
    for k in (None, 1, 2):
        anchor, group = None, -1
        for v in sorted(v for key, v in rows if key == k):
            if anchor is None or v - anchor > 25:
                anchor, group = v, group + 1
            want.append((k, v, group))
    df = spark.createDataFrame([*rows, (1, None)], "k int, v double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = [tuple(r) for r in study.anchored(df, ["k"], "v", 25.0).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=str) == sorted(want, key=str)
    assert study.anchored(df.limit(0), ["k"], "v", 25.0).count() == 0


def test_letters_in_order_like_the_fold(spark):
    rng = random.Random(4)
    cases = {k: [rng.choice("ABCDEX") for _ in range(n)] for k, n in enumerate([1, 3, 8, 20, 40, 60, 60, 60])}
    rows = spark.createDataFrame([(k, i, x) for k, c in cases.items() for i, x in enumerate(c)], "u int, t int, l string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(map(tuple, study.in_order(rows, "u", ["t"], "l", "ABCDE", 2).collect())) == [(k, run_of(c, 2)) for k, c in cases.items()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert study.in_order(rows.limit(0), "u", ["t"], "l", "ABCDE", 2).count() == 0


def test_nearest_ties_and_edges(spark):
    left = spark.createDataFrame([(1, 0.0), (2, 5.0), (3, 100.0), (4, -50.0)], "id long, x double")
    right = spark.createDataFrame([(10, 4.0), (11, 6.0), (9, 6.0), (12, -1.0)], "key long, y double")
    assert {r["id"]: (r["nearest"], r["distance"]) for r in study.nearest(left, right).collect()} == {1: (12, 1.0), 2: (9, 1.0), 3: (9, 94.0), 4: (12, 49.0)}
    assert [r["nearest"] for r in study.nearest(left, right.limit(0)).collect()] == [None] * 4


def test_latest_attempt_breaks_ties_by_sequence(spark):
    df = spark.createDataFrame([("u", "q", True, 1, 1), ("u", "q", False, 1, 2), ("u", "p", None, 5, 3)], "user string, question string, ok boolean, at long, seq long")
    assert {(r["question"], r["ok"]) for r in study.latest(df, "user", "question").collect()} == {("q", False), ("p", None)}


def test_user_stats_count_days_of_unscored_attempts(spark):
    df = spark.sql("SELECT 'u' AS user, 'q' AS question, CAST(NULL AS boolean) AS ok, timestamp'2024-01-01 23:30:00' AS at, 1 AS seq UNION ALL SELECT 'u', 'p', true, timestamp'2024-01-02 00:30:00', 2")
    assert study.user_stats(df).first().asDict() == {"user": "u", "answered": 1, "right": 1, "days": 2}


def test_lexicon_weights_and_second_topic(spark):
    lexicon = Lexicon({"a": ["x1", "x2", "x3", "x4", "x5", "x6", "late"], "b": ["beta"]}, "none")
    df = spark.createDataFrame([("late late late late",), ("x1 x1 beta beta",), ("nothing",), ("beta",)], "t string")
    got = df.select(lexicon.scores(F.col("t"))["a"].alias("s"), lexicon.classify(F.col("t")).alias("c")).collect()
    assert abs(got[0]["s"] - 2 * 3**0.7) < 1e-12 and got[0]["c"] == ["a"]
    assert got[1]["c"] == ["a", "b"] and got[2]["c"] == ["none"] and got[3]["c"] == ["b"]


def test_first_match_keeps_order(spark):
    df = spark.createDataFrame([("ab",), ("b",), ("",)], "t string")
    assert [r["o"] for r in df.select(first_match(F.col("t"), [("a", "first"), ("b", "second")]).alias("o")).collect()] == ["first", "second", None]


def test_negative_needs_a_whole_ascii_word(spark):
    df = spark.createDataFrame([("éNOT x",), ("KNOT",), ("a NOT",)], "t string")
    assert [r["o"] for r in df.select(negative(F.col("t"), ["NOT"], ["zzz"]).alias("o")).collect()] == [True, False, True]


def test_all_terms_are_folded_substrings(spark):
    df = spark.createDataFrame([("Ação rápida",), ("acao",)], "t string")
    assert [r["o"] for r in df.select(search.all_terms(fold(F.col("t")), "AÇÃO rap").alias("o")).collect()] == [True, False]


def test_negative_looks_at_the_end_alone(spark):
    cases = [("Incorreta " + "x" * 400, False), ("x" * 400 + " incorretá", True), ("x" * 395 + "incorretas", False), ("x" * 399 + "incorreta", False), ("EXCETO", True)]
    df = spark.createDataFrame(cases, "t string, want boolean")
    assert all(r["o"] == r["want"] for r in df.select("want", negative(F.col("t"), ["EXCETO"], ["incorreta", "exceto"]).alias("o")).collect())


def test_log_odds_are_against_the_other_words(spark):
    """Of 10 good words 4 are w, of 20 poor ones 9: ln(4.5 / 6.5) - ln(9.5 / 11.5) = -0.1767."""
    words = spark.createDataFrame([("w", True)] * 4 + [("x", True)] * 6 + [("w", False)] * 9 + [("y", False)] * 11, "word string, good boolean")
    got = {r["word"]: r["log_odds"] for r in statistics.log_odds(words, F.col("good")).collect()}
    assert got["w"] == -0.18 and got["x"] == round(math.log(6.5 / 4.5) - math.log(0.5 / 20.5), 2)


def test_chance_is_one_of_the_alternatives(spark):
    """Three of four alternatives are the longest: one taken blindly is the answer in a quarter of the cases."""
    df = spark.createDataFrame([([5, 5, 5, 2], 5), ([1, 2, 3, 4], 2)], "l array<int>, own int")
    assert statistics.length_rank(df, F.col("l"), F.col("own")).first().asDict() == {"n": 2, "longest_pct": 50.0, "shortest_pct": 0.0, "chance_pct": 25.0}


def test_log_odds_of_even_words_is_zero(spark):
    words = spark.createDataFrame([("w", True)] * 3 + [("w", False)] * 3, "word string, good boolean")
    row = statistics.log_odds(words.select("word", "good"), F.col("good")).first()
    assert (row["good"], row["poor"], row["log_odds"]) == (3, 3, 0.0)


def test_spelling_mode_ties_go_to_first(spark):
    df = spark.createDataFrame([("É", 2), ("e", 1)], "word string, ord long")
    assert statistics.spelling_mode(df).first()["word"] == "e"


def test_marker_segments_drop_rows_outside(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "open"), (1, 3, "x"), (1, 4, "stop"), (1, 5, "x"), (1, 6, "open")], "u int, t int, k string")
    got = study.marker_segments(df, "u", ["t"], F.col("k") == "open", F.col("k") == "stop").orderBy("t").collect()
    assert [(r["t"], r["block"]) for r in got] == [(2, 1), (3, 1), (6, 2)]
