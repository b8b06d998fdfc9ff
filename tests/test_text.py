from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_fold_matches_decomposition(spark):
    values = ["Ção É", "ÜBER ñ", "á", "日本", "", None, "Å ﬁ", "straße"]
    bare = lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFD", s) if not "̀" <= c <= "ͯ").lower()
    assert column(spark, values, T.fold) == [bare(v) for v in values]


def test_marker_norm_squeezes_all_blanks(spark):
    assert column(spark, [" questão  1﻿", "\t\n", None], T.marker_norm) == ["QUESTAO 1", "", None]


def test_words(spark):
    assert column(spark, ["Entre os gráficos, banco-dados 42!", "", None], lambda c: T.words(c, ["entre"])) == [["graficos", "banco-dados"], [], None]


@pytest.mark.parametrize(("value", "digits", "expected"), [(-2.5, 0, -2.0), (0.285, 2, 0.28), (2.5, 0, 3.0), (1.005, 2, 1.0)])
def test_round_half_up_on_binary_doubles(spark, value, digits, expected):
    assert spark.range(1).select(T.round_half_up(F.lit(value), digits).alias("o")).first()["o"] == expected


def test_percent_of_nothing_is_zero(spark):
    assert spark.range(1).select(T.percent(F.lit(3), F.lit(0)).alias("o")).first()["o"] == 0.0


def test_duration(spark):
    df = spark.createDataFrame([(0, -5), (1, 61_499), (2, 61_500), (3, 3_600_000), (4, 0)], "i int, v long")
    assert [r["o"] for r in df.select("i", T.duration(F.col("v")).alias("o")).orderBy("i").collect()] == ["0:00", "1:01", "1:02", "1:00:00", "0:00"]


def test_strict_date(spark):
    found = column(spark, ["05/12/2026", "31/02/2026", "5/12/2026", "x", None], T.strict_date)
    assert [str(x) for x in found] == ["2026-12-05", "None", "None", "None", "None"]


def test_number_list(spark):
    assert column(spark, ["9 a 12", "33 a 31", "1, 2 e 15", "none", None], T.number_list) == [[9, 10, 11, 12], [], [1, 2, 15], [], None]
