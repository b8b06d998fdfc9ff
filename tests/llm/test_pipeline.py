"""The pipeline's run against a brute-force version of all its stages."""

from __future__ import annotations

import random
import sys
from collections import defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import documents
from test_decontamination import plain as contaminated
from test_lines import above, key, measures
from test_near import shingle_set
from tokenizers import Tokenizer

from quillspark.llm import lines
from quillspark.llm.queries import tokenizer_path


def without(rows, gone):
    return [(i, t if t is None else "\n".join(x for x in t.split("\n") if (h, key(x)) not in gone), h) for i, t, h in rows]


def one_of_each(rows):
    sets = [shingle_set(t) for _, t, _ in rows]
    parent = [*range(len(rows))]

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= 75 * (len(a) + len(sets[j]) - common):
                parent[top(i)] = top(j)
    groups = defaultdict(list)
    for i, row in enumerate(rows):
        groups[top(i) if sets[i] else (i,)].append(row)
    return [min(own, key=lambda r: (r[0] is None, r[0] or 0)) for own in groups.values()]


def plain_run(rows, items):
    gone = above(rows, lines.LINE_DOCS, 0)
    rows = without([r for r in rows if measures(r[1], gone, r[2])[6]], gone)
    rows = without(rows, above(rows, lines.PAGES, lines.SHARE))
    rows = one_of_each(rows)
    return [r for r in rows if not contaminated(r[1], items)[4]]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(900)}"
    rows = []
    for i in range(70):
        host = f"s{i % 2}"
        own = [" ".join(word() for _ in range(rng.randint(6, 14))) for _ in range(rng.randint(7, 12))]
        own.insert(0, "Site  MENU home about" if host == "s0" else f"unique top {i}")
        if i % 5 == 0:
            own.append("share this page with your friends")
        rows.append((i, "\n".join(own), host))
    for i in range(12):  # near copies of three documents, in a chain
        text = rows[rng.randrange(3)][1].split(" ")
        text[rng.randrange(len(text))] = "changed"
        rows.append((100 + i, " ".join(text), "s1"))
    items = [(1, " ".join(rows[30][1].split()[9:24])), (2, "a b"), (3, None)]
    rows += [(200, "short", "s0"), (201, None, None), (202, "", "s1"), (203, "x y z " * 40, "s0"), (None, "\n".join(" ".join(word() for _ in range(9)) for _ in range(9)), "s1"), rows[50], rows[50], rows[51]]
    rows.append((204, rows[52][1] + "\n" + items[0][1].upper().replace(" ", ", "), None))
    return rows, items


@pytest.mark.parametrize("seed", [1, 2])
def test_a_run_against_brute_force(spark, tmp_path, seed):
    import corpus_pipeline

    rows, items = corpus(seed)
    docs = documents(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = plain_run(rows, items)
    assert 30 < len(want) < len(rows) - 8
    left = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns, name
        left.write.parquet(str(tmp_path / f"stage{k}"))
        left = spark.read.parquet(str(tmp_path / f"stage{k}"))
    got = left.collect()
    assert sorted(((r["doc_id"], r["text"], r["source"]) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r["n_chars"] == len(r["text"]) for r in got) and {r["sig"] for r in got} == {"b"}
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokens = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t, _ in want}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        assert r["doc_tokens"] == tokens[r["doc_id"]]
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(tokens)
    for spans, size in [(v, tokens[k]) for k, v in pieces.items()] + [(v, 2048 if k < max(sequences) else None) for k, v in sequences.items()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert size is None or at == size


def test_a_run_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
