from __future__ import annotations

import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import documents, lower, odd_rows

from quillspark.llm import near


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))) if w else frozenset()


def plain(rows):
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
                parent[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i, (name, _, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(name)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((name, len(sets[i]), least[top(i)] if sets[i] else name) for i, (name, _, _) in enumerate(rows)), key=repr)


def copies(seed):
    """Chains and clusters of near copies around the threshold, over a common passage."""
    rng = random.Random(seed)
    words = [f"v{k}" for k in range(400)]
    passage, rows = rng.choices(words, k=30), []
    for base in range(6):
        ids = rng.sample(range(1000), 14)
        text = rng.choices(words, k=rng.choice([8, 40, 120]))
        for k in range(14):
            own = [*text]
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(words)
            if k % 3 == 0:
                text = own  # a chain
            if k % 5 == 4:
                own = passage + own
            rows.append((1000 * (base + 1) + ids[k], " ".join(own), "s"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(near, "MOST_BROADCAST", 0)
    rows = odd_rows() + copies(seed)
    found = near.components(documents(spark, rows)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == plain(rows)


@pytest.mark.parametrize("cost", [None, 1e6])
def test_links_across_the_parts_of_a_shingle(spark, monkeypatch, cost):
    monkeypatch.setattr(near, "PART", 1)
    if cost:  # each class is alone in its part
        monkeypatch.setattr(near, "sketch_of", lambda marks: np.full(1 << near.SKETCH_BITS, cost))
    rows = odd_rows() + copies(4)
    found = near.components(documents(spark, rows)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == plain(rows)


def test_one_of_each(spark):
    rows = odd_rows() + copies(3)
    docs = documents(spark, rows)
    left = near.one_of_each(docs)
    assert left.columns == docs.columns
    got = left.collect()
    component = {}
    for (name, n, c), _ in zip(plain(rows), rows, strict=True):
        component[name] = (n, c)
    kept = [component[r["doc_id"]] for r in got]
    full = [c for n, c in kept if n]
    assert len(full) == len(set(full)) == len({c for _, n, c in plain(rows) if n})
    assert sum(1 for n, _ in kept if not n) == sum(1 for _, t, _ in rows if not shingle_set(t))


def test_empty_table(spark):
    assert near.components(documents(spark, [])).count() == 0


def test_a_shared_passage_makes_no_pairs(spark):
    """Texts that are three quarters one passage and link with nothing: rows grow with their number, not with its square."""
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(40)]
    met = []
    for n in (60, 120):
        rows = [(i, " ".join(passage + [f"own{i}x{k}" for k in range(10)]), "s") for i in range(n)]
        docs = documents(spark, rows)
        marks = near.signed(docs, "doc_id", "text")
        found = near.shared_rows(near.prefixes(docs, "text", spark.sparkContext.broadcast(near.sketch_of(marks))))
        none = spark.createDataFrame([], "sig long, root long")
        met.append(near.meetings(found, none).count())
        assert sorted(tuple(r) for r in near.components(docs).collect()) == [(i, 46, i) for i in range(n)]
    assert met[1] <= 4 * 120, met


def test_shingles_of_many_texts_are_those_of_each():
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 30))) for _ in range(200)] + [None]
    together = near.shingles(texts)
    for t, own in zip(texts, together, strict=True):
        assert (own == near.shingles([t])[0]).all() and len(own) == len(shingle_set(t or ""))


def test_word_hashes_tell_words_apart():
    rng = random.Random(4)
    words = list({"".join(rng.choices("abé日 x"[:4] + "z", k=rng.choice([1, 2, 7, 8, 9, 16, 17, 300]))) for _ in range(3000)}) + ["a" * 255, "a" * 256, "a" * 257, "a" * 264]
    h, counts = near.word_hashes([" ".join(words), None, "", " \x0b ", "Zz zZ"])
    assert counts.tolist() == [len(words), 0, 0, 0, 2] and len(set(h[: len(words)].tolist())) == len(set(words)) and h[-1] == h[-2]
    assert h[0] == near.word_hashes(["\t" + words[0]])[0][0]


def test_names_of_the_caller_stay(spark):
    names = ["mark", "__mark", "row", "keep_id", "id", "sig"]
    docs = spark.createDataFrame([(i, f"a b c d e f {i // 2}", *names) for i in range(4)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    left = near.one_of_each(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {0, 2} and left.first()["mark"] == "mark"


def test_prefix_lengthens_with_cost():
    own = np.arange(1, 101, dtype=np.uint64) << np.uint64(64 - near.SKETCH_BITS)
    excess = np.zeros(1 << near.SKETCH_BITS)
    tokens, _, shared = near.prefix(own, excess)
    assert (len(tokens), shared) == (26, 1)
    excess[:] = 5.0
    tokens, _, shared = near.prefix(own, excess)
    assert shared == near.MOST_SHARED and len(tokens) == 25 + shared


def test_texts_put_together_from_passages(spark):
    """Texts of 10 of 20 passages: right, and a passage counts once where it brings texts together, whatever its length."""
    rng = random.Random(3)
    parts = [[f"p{i}w{k}" for k in range(40)] for i in range(20)]
    picks = [rng.sample(range(20), 10) for _ in range(120)]
    picks += [p[:9] + [19 - p[9]] for p in picks[:10]] + picks[10:14]
    rows = [(i, " ".join(w for p in own for w in parts[p]), "s") for i, own in enumerate(picks)]
    docs = documents(spark, rows)
    assert sorted((tuple(r) for r in near.components(docs).collect()), key=repr) == plain(rows)
    marks = near.signed(docs, "doc_id", "text")
    found = near.shared_rows(near.prefixes(docs, "text", spark.sparkContext.broadcast(near.sketch_of(marks))))
    met = near.meetings(found, spark.createDataFrame([], "sig long, root long")).selectExpr("count(*) AS n", "sum(weight) AS w").first()
    assert met["w"] > 5 * met["n"], met
