from __future__ import annotations

import hashlib
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import documents, lower, odd_rows

from quillspark.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text, items):
    words, hit, ids = WORD.findall(lower(text)), set(), set()
    for item, t in items:
        own = WORD.findall(lower(t))
        for a in range(max(1, len(own) - 9) if own else 0):
            win = own[a : a + 10]
            for b in range(len(words) - len(win) + 1):
                if words[b : b + len(win)] == win:
                    hit.update(range(b, b + len(win)))
                    ids.add(item)
    names = sorted(str(i) for i in ids if i is not None)
    return len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


ITEMS = lambda rows: [(1, rows[3][1]), (20, rows[8][1][:40]), (3, "Short One"), (4, ""), (5, None), (6, "!!"), (3, rows[3][1])]


@pytest.mark.parametrize(("block", "most"), [(10_000_000, D.MOST_FILTER), (200, D.MOST_FILTER), (200, 9)])
def test_against_brute_force(spark, block, most):
    rows = odd_rows()
    rows += [(900, "A short! ONE here " + rows[3][1].upper(), "s0")]
    items = ITEMS(rows)
    found = D.contamination(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block, most_filter=most).collect()
    assert len(found) == len(rows)
    expected = sorted(((i, *plain(t, items)) for i, t, _ in rows), key=repr)
    assert sorted((tuple(r)[:6] for r in found), key=repr) == expected
    texts = dict((i, t) for i, t, _ in rows)
    for r in found:
        for span in r["char_spans"]:
            assert WORD.fullmatch(lower(texts[r["doc_id"]])[span["start"]]) and span["end"] <= len(texts[r["doc_id"]])


def test_decontaminate_keeps_columns_and_clean_rows(spark):
    rows = odd_rows()
    docs = documents(spark, rows)
    items = spark.createDataFrame(ITEMS(rows), "item_id long, text string")
    left = D.decontaminate(docs, items)
    assert left.columns == docs.columns
    clean = [(i, t) for i, t, _ in rows if not plain(t, ITEMS(rows))[4]]
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted(clean, key=repr)


@pytest.mark.parametrize("block", [10_000_000, 200])
def test_names_of_the_caller_stay(spark, block):
    names = ["__hits", "row", "spans", "id", "whole", "items", "n_words"]
    docs = spark.createDataFrame([(i, "a b c d e f g h i j k" if i else "other words", *names) for i in range(3)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    items = spark.createDataFrame([(1, "x a b c d e f g h i j y"), (2, "b c d e f g h i j k " * 12)], "item_id long, text string")
    left = D.decontaminate(docs, items, block_bytes=block)
    assert [tuple(r) for r in left.collect()] == [(0, "other words", *names)] and left.columns == docs.columns


def test_empty_tables(spark):
    docs, none = documents(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(docs, none).count() == 0
    assert not any(r["contaminated"] for r in D.contamination(documents(spark, odd_rows()), none).collect())


def test_the_filter_of_tasks_holds_every_window(spark):
    """Slices of the filter, set by tasks, are the filter of all windows set one after another."""
    texts = [t for _, t in ITEMS(odd_rows())] + ["one two three"] * 3
    items = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item_id long, text string").repartition(3)
    for bits, slice_bytes in ((4096, 64), (4096, 1 << 20), (100, 3)):
        sieve = D.sieve_of(items, "text", 10, bits, slice_bytes)
        want, sizes = set(), set()
        for t in texts:
            if own := D.words_of(t):
                sizes.add(min(10, len(own)))
                want.update(D.places(own, min(10, len(own)), sieve.bits).tolist())
        assert {k for k in range(sieve.bits) if sieve.field[k >> 3] >> (k & 7) & 1} == want and sieve.sizes == sorted(sizes)
        assert all(sieve.may_hit(D.words_of("x " + t)) for t in texts if D.words_of(t))
    assert not D.sieve_of(items.limit(0), "text", 10, 64).may_hit([b"a"])
