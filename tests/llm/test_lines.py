from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import BLANKS, documents, odd_rows

from pyspark.sql import functions as F

from quillspark.llm import lines


def key(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line.strip(BLANKS)).lower()


def above(rows, least, share):
    seen, pages = defaultdict(set), defaultdict(set)
    for _, t, h in rows:
        pages[h].add(t or "")
        for line in (t or "").split("\n"):
            if key(line):
                seen[h, key(line)].add(t)
    return {k for k, v in seen.items() if len(v) > least and len(v) > share * len(pages[k[0]])}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def measures(text, gone, host):
    text = text or ""
    w, own = words(text), [x for x in text.split("\n") if x.strip(BLANKS)]
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    removed = sum(len(words(x)) for x in text.split("\n") if (host, key(x)) in gone)
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(own) - len(set(own)), len(again), failed, not failed and not len(w) - removed < 0.3 * len(w), removed


def rows_with_lines():
    rows = odd_rows()
    rows += [(200 + i, "\n".join(["Site  Menu one two", f"own {i} " + " ".join(f"q{i}x{k}" for k in range(60)), "site menu ONE two"]), "s0" if i < 20 else None) for i in range(24)]
    rows += [(300 + i, "\n".join(f"common line number {k} " + "of many words " * 4 for k in range(5)) + f"\n#tail {i} %", "s4") for i in range(9)]
    rows += [(400, "a b c a b c a b", "s0"), (401, "x y " * 40, "s0"), (402, "same\nsame\n same", "s0")]
    return rows


@pytest.mark.parametrize("limit", [4096, 0, 2])
def test_quality_against_brute_force(spark, monkeypatch, limit):
    rows = rows_with_lines()
    gone = above(rows, 3, 0)
    assert gone
    monkeypatch.setattr(lines, "HOST_LINES", limit)
    found = lines.quality(documents(spark, rows), least=3).collect()
    expected = sorted(((i, *measures(t, gone, h)) for i, t, h in rows), key=repr)
    assert sorted((tuple(r) for r in found), key=repr) == expected
    kept = lines.keep_quality(documents(spark, rows), least=3)
    assert kept.columns == documents(spark, []).columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(((i, "\n".join(x for x in t.split("\n") if (h, key(x)) not in gone)) for i, t, h in rows if measures(t, gone, h)[6]), key=repr)


def test_line_removal_against_brute_force(spark):
    rows = rows_with_lines()
    gone = above(rows, 3, 0.1)
    docs = documents(spark, rows)
    found = lines.without_boilerplate(docs, least=3, share=0.1, counts=("n_lines", "n_dropped")).select("doc_id", "text", "n_lines", "n_dropped").collect()
    expected = []
    for i, t, h in rows:
        own = [] if t is None else t.split("\n")
        left = [x for x in own if (h, key(x)) not in gone]
        expected.append((i, None if t is None else "\n".join(left), len(own), len(own) - len(left)))
    assert sorted((tuple(r) for r in found), key=repr) == sorted(expected, key=repr)


def test_copies_are_one_page(spark):
    rows = [(i, "the same page\nagain", "h") for i in range(50)]
    assert all(r["n_dropped"] == 0 for r in lines.without_boilerplate(documents(spark, rows), counts=("n_lines", "n_dropped")).collect())


def test_empty_tables(spark):
    assert lines.quality(documents(spark, [])).count() == 0
    assert lines.without_boilerplate(documents(spark, [])).count() == 0


def test_names_of_the_caller_stay(spark):
    names = ["row", "above", "kept", "left", "had", "lost", "host", "words", "__kept", "__dropped", "of"]
    rows = [(1, "some words", "h", *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    assert [tuple(r) for r in lines.without_boilerplate(docs).collect()] == rows
    assert lines.keep_quality(docs).columns == docs.columns and lines.keep_quality(docs).count() == 0


def test_distinct_words_of_a_long_text_repeat_no_window(spark):
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda x: x.cast("string")), " ")
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.concat(text, F.lit(" 7 8 9 10 x")).alias("text"), F.lit("h").alias("source"))
    found = lines.quality(docs).first()
    assert (found["n_words"], found["n_repeat_words"]) == (200_005, 8)
