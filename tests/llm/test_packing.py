from __future__ import annotations

import random
import sys
import zlib
from collections import defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import documents, odd_rows

from quillspark.llm import packing
from quillspark.llm.queries import tokenizer_path


@pytest.mark.parametrize("mixture", [None, {"s0": 1.0, "s1": 1.0, "s2": 6.0}])
def test_pieces_hold_each_id_once(spark, mixture):
    rows = odd_rows()
    found = packing.pack(documents(spark, rows), tokenizer_path(), mixture=mixture).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    expected = defaultdict(int)
    for i, t, s in rows:
        expected[i, s, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()] += 1
    pieces = defaultdict(list)
    for r in found:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        pieces[r["doc_id"], r["source"], r["doc_tokens"]].append((r["start"], r["ids"]))
    for (i, s, body), n in expected.items():
        own = pieces[i, s, len(body) // 4]
        spans = [(a, a + len(b) // 4) for a, b in own]
        assert sum(b - a for a, b in spans) == n * len(body) // 4
        assert all(body[4 * a : 4 * a + len(b)] == b for a, b in own)
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, own in sequences.items():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == 2048 or k == max(sequences)


def test_windows_hold_target_proportions():
    sizes = [100_000, 37_000, 900_000, 5_000]
    plan = packing.Schedule(sizes)
    table = plan.before(0, plan.windows - 1)
    share = np.arange(len(table))[:, None] * 2048 * np.array(sizes) / sum(sizes)
    inside = slice(0, -1)  # the last window is short
    assert np.abs(table[inside] - share[inside]).max() < 1.0 + 1e-9
    assert (np.diff(table, axis=0) >= 0).all() and (table[-1] == sizes).all()
    assert (np.diff(table[:-1].sum(axis=1)) == 2048).all()


def test_small_sources_share_a_queue(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma"], k=40)), f"tiny{i}") for i in range(60)] + [(100 + i, "delta " * 3000, "big") for i in range(9)]
    found = packing.pack(documents(spark, rows), tokenizer_path(), with_ids=False).collect()
    assert {r["doc_id"] for r in found} == {i for i, _, _ in rows}


def test_encoder_equals_the_tokenizer():
    encode, tokenizer = packing.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    rng = random.Random(4)
    letters = "aB1é ßÀ'.,%s_\n\t İΣσς½²ª×÷µÿ<|>́日٣’ don't fi ﬁ Ⅷ"
    for _ in range(3000):
        t = "".join(rng.choices(letters, k=rng.randint(0, 20))) + rng.choice(["", " <|endoftext|>x", " I'LL."])
        assert np.frombuffer(encode([t])[0], "<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_empty_table(spark):
    assert packing.pack(documents(spark, []), tokenizer_path()).count() == 0


def walked(sizes, weights, length):
    """Deficit round robin, window by window: each queue is owed its share, gets the whole tokens of what it is owed, and the largest deficits the rest."""
    left, share = list(sizes), [Fraction(w) for w in weights]
    start, done, table = 0, [0] * len(sizes), [[0] * len(sizes)]
    phases = []
    while any(left):
        active = [q for q, x in enumerate(left) if x and share[q]] or [q for q, x in enumerate(left) if x]
        rate = {q: share[q] or Fraction(left[q]) for q in active}
        time = min(left[q] / rate[q] for q in active)
        take = [min(left[q], int(time * rate[q])) if q in rate else 0 for q in range(len(left))]
        phases.append(take)
        left = [a - b for a, b in zip(left, take)]
    while start < sum(sizes):
        start = min(start + length, sum(sizes))
        row, rest = [0] * len(sizes), start
        for take in phases:
            total = sum(take)
            level = min(rest, total)
            rest -= level
            owed = [Fraction(level * t, total) for t in take]
            got = [int(x) for x in owed]
            for q in sorted(range(len(take)), key=lambda q: (got[q] - owed[q], q))[: level - sum(got)]:
                got[q] += 1
            row = [a + b for a, b in zip(row, got)]
        table.append(row)
    return np.array(table)


@pytest.mark.parametrize("weights", [None, [1, 5, 2, 1]])
def test_schedule_equals_a_walk(weights):
    sizes = [1_000, 370, 9_001, 53]
    plan = packing.Schedule(sizes, weights, 64)
    assert (plan.before(0, plan.windows - 1) == walked(sizes, weights or sizes, 64)).all()


def test_very_large_schedules_are_exact():
    sizes = [18_000_000_000_000, 6_999_999_999_999, 3]
    plan = packing.Schedule(sizes)
    table = plan.before(plan.windows // 2, plan.windows // 2 + 3)
    assert (np.diff(table.sum(axis=1)) == 2048).all()
    assert np.abs(np.diff(table[:, 0]) - 2048 * 0.72).max() <= 2
    edges, windows, offsets = plan.pieces(0, 9_000_000_000_000, 5_000)
    assert edges[0] == 9_000_000_000_000 and edges[-1] == 9_000_000_005_000 and (np.diff(windows) > 0).all() and (offsets >= 0).all()


def test_small_sources_are_mixed(spark, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH_ROWS", 40)
    rows = [(i, "delta " * 300, "big") for i in range(900)] + [(1000 + i, "alpha " * 100, f"tiny{i // 20}") for i in range(60)]
    found = packing.pack(documents(spark, rows), tokenizer_path(), with_ids=False, length=512).collect()
    places = defaultdict(list)
    for r in found:
        if r["doc_id"] >= 1000:
            places[(r["doc_id"] - 1000) // 20].append(r["sequence_id"])
    last = max(r["sequence_id"] for r in found)
    for own in places.values():  # each source is spread over the whole
        assert all(sum(k * last / 4 <= x <= (k + 1) * last / 4 for x in own) >= len(own) / 8 for k in range(4))


def test_each_source_keeps_its_weight(spark):
    """A source far below 1/MAX_QUEUES of the tokens, and one of a weight far below the other's, have their shares in every window."""
    plan = packing.Schedule([4_000_000, 4_000_000], [1.0, 4e-7])
    assert len(plan.phases) == 2 and plan.phases[0][2] == [4_000_000, 1]
    rows = [(i, "alpha " * 4000, "big") for i in range(400)] + [(1000, "beta " * 2500, "small"), (1001, "gamma " * 2500, None), (1002, "delta", "other")]
    found = packing.pack(documents(spark, rows), tokenizer_path(), with_ids=True, mixture={"big": 1.0, "small": 1.0, None: 2.0}).collect()
    first = defaultdict(int)
    for r in found:
        if r["sequence_id"] == 0:
            first[r["source"]] += r["length"]
    assert dict(first) == {"big": 512, "small": 512, None: 1024}
    assert max(r["sequence_id"] for r in found) == next(r["sequence_id"] for r in found if r["source"] == "other")
