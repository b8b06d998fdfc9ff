"""Centroids, tensored MinHash and resampling against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import documents, lower, odd_rows
from test_near import copies, shingle_set

from quillspark.llm import centroids, minhash, near, resampling

VECTORS = "vec_id long, embedding array<double>, x string, dots string, cluster string, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c", "d") for i, v in rows], VECTORS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_clusters(rows, clusters, rounds, width, scale=1024):
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) and abs(scale * c) < (1 << 27) - 1 for c in v)]
    middle = [x for _, x in sorted(kept, key=lambda r: (sha(f"3:{'null' if r[0] is None else r[0]}"), r[1]))[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(middle)) for _, x in kept]

    for _ in range(rounds):
        found = assign()
        for k in range(len(middle)):
            own = [x for (_, x), (_, j) in zip(kept, found, strict=True) if j == k]
            if own:
                middle[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = assign() if middle else []
    inertia = Counter()
    for d, k in found:
        inertia[k] += d
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), sha(",".join(map(str, middle[k])))) for (i, _), (d, k) in zip(kept, found, strict=True)), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(centroids, "SLICE", 7)
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(rng.choice([-1, 0, 1]), 0.2) for _ in range(6)]) for i in range(120)]
    rows += [rows[3]] * 30 + [(None, rows[5][1]), (200, None), (201, []), (202, [1.0] * 5), (203, [1.0, None] * 3), (204, [math.nan] * 6), (205, [math.inf] * 6), (206, [1e300] * 6), (207, [-0.0] * 6), (208, [130_000.0] * 6)]
    rng.shuffle(rows)
    got = centroids.cluster(vectors(spark, rows), clusters=5, rounds=4, dimensions=6)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_clusters(rows, 5, 4, 6)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    got = centroids.cluster(vectors(spark, rows), clusters=8, rounds=3, dimensions=2)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_clusters(rows, 8, 3, 2)
    assert centroids.cluster(vectors(spark, []), dimensions=2).count() == 0
    assert centroids.cluster(vectors(spark, [(1, None)]), dimensions=2).columns == got.columns


def test_unmoved_centroids_cost_no_round(spark, monkeypatch):
    calls = []
    own = centroids.assigned
    monkeypatch.setattr(centroids, "assigned", lambda *a: calls.append(1) or own(*a))
    rows = [(i, [float(i % 2), 0.0]) for i in range(10)]
    assert sorted((tuple(r) for r in centroids.cluster(vectors(spark, rows), clusters=2, rounds=10, dimensions=2).collect()), key=repr) == plain_clusters(rows, 2, 10, 2)
    assert len(calls) < 5


def plain_components(rows, percent):
    sets = [shingle_set(t) for _, t, _ in rows]
    parent = [*range(len(rows))]

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i, (name, _, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(name)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    out = [(name, len(sets[i]), least[top(i)] if sets[i] else name) for i, (name, _, _) in enumerate(rows)]
    return sorted(((*r, r[0] == r[2]) for r in out), key=repr)


@pytest.mark.parametrize(("seed", "crowd"), [(1, minhash.CROWD), (2, 0), (3, 40)])
def test_near_copies_against_brute_force(spark, seed, crowd):
    rows = odd_rows() + copies(seed)
    got = minhash.dedup(documents(spark, rows), crowd=crowd).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_components(rows, 85)


def test_texts_of_one_template_make_no_pairs(spark):
    """Three quarters are shared, and nothing links: crowded keys go to the exact join, and the pairs looked at stay few."""
    passage, seen = [f"p{k}" for k in range(60)], []
    for n in (60, 120):
        rows = [(i, " ".join(passage + [f"own{i}x{k}" for k in range(14)]), "s") for i in range(n)]
        docs = documents(spark, rows)
        assert all(r["component_id"] == r["doc_id"] for r in minhash.dedup(docs).collect())
        marks = minhash.signed(docs, "doc_id", "text")
        rest, crowded = minhash.left_over(minhash.met(minhash.keys(marks)), spark.createDataFrame([], "sig long, root long"))
        seen.append((rest.count(), crowded.count()))
    assert seen[1][1] == 120 and seen[1][0] <= 4 * 120, seen


def test_tables_miss_as_seldom_as_said():
    """Pairs at 0.85: all of 3,000 meet in a table; far pairs seldom do."""
    rng = np.random.default_rng(4)
    hits = far = 0
    for _ in range(300):
        both = rng.integers(0, 1 << 64, 340, np.uint64)
        sets = [np.unique(np.concatenate([both, rng.integers(0, 1 << 64, 30, np.uint64)])) for _ in range(4)]
        other = np.unique(np.concatenate([both[:40], rng.integers(0, 1 << 64, 330, np.uint64)]))
        h = minhash.halves([*sets, other]).reshape(5, 2, minhash.HALVES)
        meet = lambda a, b: bool((h[a, 0] == h[b, 0]).any() and (h[a, 1] == h[b, 1]).any())
        hits += sum(meet(a, b) for a in range(4) for b in range(a))
        far += meet(0, 4)
    assert hits == 1800 and far < 15


def test_halves_of_many_sets_are_those_of_each(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 64, n, np.uint64)) for n in (1, 6, 50, 900, 7, 300)]
    whole = minhash.halves(sets)
    monkeypatch.setattr(minhash, "CHUNK", 64)
    assert (minhash.halves(sets) == whole).all()
    assert all((minhash.halves([s])[0] == w).all() for s, w in zip(sets, whole, strict=True))


def test_met_streams_over_batches(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(12), rng.randrange(9)) for _ in range(60)] + [(50, 1), (51, 1), (51, 1)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = sorted(tuple(r) for r in minhash.met(spark.createDataFrame(rows, "key long, sig long")).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {}
    for k, s in rows:
        groups.setdefault(k, set()).add(s)
    assert got == sorted((k, s, min(g)) for k, g in groups.items() if len(g) > 1 for s in g)


def test_no_documents(spark):
    assert minhash.dedup(documents(spark, [])).count() == 0
    assert minhash.dedup(documents(spark, [(1, None, "s"), (2, "", "s")])).collect() == minhash.dedup(documents(spark, [(1, "", "s"), (2, " ", "s")])).collect()


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def plain_draw(rows, target, percent, least, buckets, longest, seed):
    runs = lambda ws: [" ".join(ws[a : a + k]) for k in range(1, longest + 1) for a in range(len(ws) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode("utf-8", "surrogatepass")) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in runs(words(x))) for texts in ([r[1] for r in rows], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    out, open_ = [], []
    for k, (name, text, _) in enumerate(rows):
        own = runs(words(text))
        weight = sum(gain(bucket(f)) for f in own)
        h = int(sha(f"{seed}:{'null' if name is None else name}")[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([name, len(own), weight, score, None])
        if len(words(text)) >= least:
            open_.append(k)
    open_.sort(key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    for rank, k in enumerate(open_[: len(open_) * percent // 100]):
        out[k][4] = rank + 1
    return out


@pytest.mark.parametrize(("longest", "bits", "percent"), [(1, 12, 50), (2, 5, 100), (3, 8, 10)])
def test_resampling_against_brute_force(spark, longest, bits, percent):
    rows = odd_rows(seed=longest, n=60) + [(-5, "w1 w2 w3 w4 w5 w6 w7 w8", "s"), (1 << 40, "w1 W1 Été w5 w6 w7", "s")]
    target = ["w1 w2 Été, w3", None, "", "x w59 w59"]
    docs = documents(spark, rows)
    goal = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = [list(r) for r in resampling.resample(docs, goal, percent=percent, least_words=5, buckets=50, longest=longest, seed=7, bits=bits).collect()]
    assert sorted(got, key=repr) == sorted(plain_draw(rows, target, percent, 5, 50, longest, 7), key=repr)


def test_nothing_to_draw_from(spark):
    goal = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(documents(spark, []), goal).count() == 0
    short = documents(spark, [(1, "a b", "s"), (2, None, "s")])
    assert all(r["rank"] is None for r in resampling.resample(short, goal).collect())


def test_places_of_equal_and_extreme_keys(spark):
    """One key on all rows; keys over the whole range of a long, with nulls last."""
    from quillspark.llm.common import written

    rows = written(spark.createDataFrame([(5, 1)] * 200 + [(5, 0)] * 100, "a long, b long"), "t")
    got = resampling.radix_places(rows, [("a", True), ("b", False)]).collect()
    assert sorted(r["place"] for r in got) == [*range(300)] and {r["b"] for r in got if r["place"] < 100} == {0}
    edge = [-(2**63), 2**63 - 1, 0, -1, 1, None, 2**40, None]
    rows = written(spark.createDataFrame([(v, k) for k, v in enumerate(edge)], "a long, k long"), "t")
    for down in (True, False):
        got = [r["a"] for r in resampling.radix_places(rows, [("a", down), ("k", False)], bits=13).orderBy("place").collect()]
        assert got == sorted([v for v in edge if v is not None], reverse=down) + [None, None]


def test_similarity_is_a_parameter_of_the_join(spark):
    rows = copies(2)
    _, labels = near.classes(documents(spark, rows), percent=85)
    linked = {r["sig"] for r in labels.collect()}
    want = {near._signature(near.shingles([t])[0]) for (_, t, _), r in zip(rows, [0] * len(rows), strict=True)}
    assert linked <= want and len(linked) > 1
