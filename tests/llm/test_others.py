"""Extraction, personal data, archives, sharding, toxicity and the pipeline."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
import sys
import time
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import documents, odd_rows

from quillspark.llm import extraction, pii, sharding, toxicity, warc

PAGES = "page_id long, url string, html string, host string, part string, keys string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES)


def test_extraction_by_markup(spark):
    html = "<title>t</title><nav><a href='/x>y'>Menu</a></nav><div class='ad-box'>Buy</div><article><h1>Head &amp; so</h1><p><b>One\n two<br>three<p>Four&nbsp;five<aside>No</aside><section class='comments'><p>me too</p></section></article><footer>&copy;</footer>"
    found = {r["page_id"]: r for r in extraction.extract(pages(spark, [(1, "http://h/a", html), (2, None, None), (3, "http://h/b", ""), (4, "http://h/c", "<p>5 < 6 &am &lt;"), (None, "http://h/c", html)])).collect()}
    assert found[1]["text"] == "Head & so\n\nOne two three\n\nFour five" and found[1]["n_chars"] == len(found[1]["text"])
    assert found[2]["text"] == "" and found[3]["text"] == "" and found[4]["text"] == "5 < 6 &am <" and found[None]["text"] == found[1]["text"]


def test_names_of_article_blocks_are_no_marks():
    """Marks that are plain words count in names of marks and parts of pages alone; formulas are text."""
    text = lambda inner: [x.text for x in extraction.lines_of(f"<article>{inner}<p>end</p></article>") if not x.boilerplate]
    for name in ("related-work", "side-by-side", "skip-lists", "noticeable", "search-algorithms share-of-votes", "bannerman"):
        assert text(f"<div class='{name}'>kept</div>") == ["kept", "end"], name
    for name in ("related-links", "side", "sideColumn", "share-buttons", "reader-comments", "x ad-slot", "site-search", "cookie-whatever", "newsletter"):
        assert text(f"<div class='{name}'>gone</div>") == ["end"], name
    assert text("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == ["so x=2 holds", "end"]


def test_extraction_by_differencing(spark):
    page = lambda k: f"<div><p>Site title</p><p>Home</p><p>Body {k} is its own</p><p>Contact us</p></div>"
    rows = [(k, f"http://h/en/{k}", page(k)) for k in range(5)] + [(9, "http://other/en/1", page(1)), (10, "http://twin/a", page(1)), (11, "http://twin/b", page(1))]
    found = {r["page_id"]: r["text"] for r in extraction.extract(pages(spark, rows)).collect()}
    assert all(found[k] == f"Body {k} is its own" for k in range(5))
    assert found[9].startswith("Site title") and found[10] == found[11] == found[9]


def test_neighbours_do_not_depend_on_parts_or_copies(spark, monkeypatch):
    rng = random.Random(6)
    page = lambda k, menu: f"<div><p>Site</p><p>Menu {menu}</p><p>Body {k}</p></div>"
    rows = []
    for k in range(60):
        path, body = f"/{rng.choice('ab')}{k // 6}/{k:03}", k - k % rng.choice([1, 1, 5, 30])
        rows.append((k, f"http://h{path}", page(body, path[1:3])))
    rows += [(100 + k, f"http://c/{k:02}", page(0 if k < 25 else 1, "x")) for k in range(26)] + [(None, "http://h/a1/1", page(7, "a1"))]

    def nearest(row):
        path = row[1][8:]
        ordered = sorted((r for r in rows if r[1][7] == row[1][7]), key=lambda r: (r[1], r[0] is not None, r[0]))
        at = ordered.index(row)
        sides = [next((r for r in x if r[2] != row[2]), None) for x in (ordered[:at][::-1], ordered[at + 1 :])]
        near = max((r for r in sides if r), key=lambda r: extraction._nearness(r[1][8:], path))
        mine, its = (re.findall("<p>(.*?)</p>", r[2]) for r in (row, near))
        return "\n\n".join(x for x in mine if x not in its)

    expected = {r[0]: nearest(r) for r in rows}
    for size in (10**6, 3, 1):
        monkeypatch.setattr(extraction, "PART_PAGES", size)
        assert {r["page_id"]: r["text"] for r in extraction.extract(pages(spark, rows)).collect()} == expected
    assert expected[100] == "Body 0"


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = (rng.choices(range(5), k=rng.randint(0, 12)) for _ in range(2))
        places = sorted(extraction.common(a, b))
        table = [[0] * (len(b) + 1)]
        for x in a:
            row = [0]
            for j, y in enumerate(b, 1):
                row.append(table[-1][j - 1] + 1 if x == y else max(table[-1][j], row[-1]))
            table.append(row)
        assert len(places) == table[-1][-1] and extraction.lengths(a, b).tolist() == table[-1]
        rest = iter(b)
        assert all(any(x == y for y in rest) for x in (a[i] for i in places))


def test_long_pages_are_aligned_soon():
    rng = random.Random(5)
    a, b = rng.sample(range(30_000), 30_000), rng.sample(range(30_000), 30_000)
    began = time.time()
    assert 300 < len(extraction.common(a, b)) < 400  # about 2 * sqrt(n)
    few = extraction.common(rng.choices(range(3), k=20_000), rng.choices(range(3), k=20_000))
    assert len(few) > 13_000 and time.time() - began < 60


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def valid(kind, body):
    d = re.sub("[^0-9]", "", body)
    luhn = sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": all(int(x) <= 255 for x in body.split(".")) if kind == "ip" else None, "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]


def test_personal_data_against_brute_force(spark):
    rng = random.Random(5)
    bits = ["a@b.c", "_d@e-f.g.h", "x@y", "@", ".", "1.2.3.4", "256.1.1.1", "0010.2.3.4.5.6.7.8", "4539 1488 0343 6467", "4539148803436467", "4539-1488-0343-6468", "+1 (988) 555-2485", "+12", "+1 234 567 8901 23456789", "é", "日", " ", " ", "\n", "-", "_", "word", "user [at] mail (dot) example", "12", "3"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 14))), "s") for i in range(250)] + odd_rows() + [(901, "9" * 40_000 + "a" * 40_000 + "@" + "b." * 9_000, "s")]
    found = pii.find(documents(spark, rows)).collect()
    expected = []
    for i, t, _ in rows:
        spans = sorted((m.start(), k, m.end(), name) for k, (name, p) in enumerate(PATTERNS) for m in re.finditer(p, t or "") if (name != "ip" or len(m[0]) < 400) and valid(name, m[0]))
        n = Counter(s[3] for s in spans)
        expected.append((i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in found), key=repr) == sorted(expected, key=repr)
    for r in found:
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert len(spans) == r["n_spans"] and sum(r[f"n_{k}"] for k in pii.KINDS) == r["n_spans"] - sum(1 for x in spans if x[0] == "secret") or r["n_spans"] > sum(r[f"n_{k}"] for k in pii.KINDS)
    assert pii.find(documents(spark, [])).count() == 0


def tokens_and_words(n):
    rng = random.Random(11)
    word = lambda k: "".join(rng.choices("aeioulmnrst", k=k))
    rows = []
    for i in range(n):
        own = [word(rng.randint(2, 24)) for _ in range(40)]
        if i % 3 == 0:
            own[7] = f'token = "{rng.randbytes(20).hex()}"'
        if i % 7 == 0:
            own[9] = f"call +1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)} now"
        if i % 11 == 0:
            own[20] = f"seen {rng.randint(10**7, 10**8)} times"
        rows.append((i, " ".join(own), "s"))
    return rows


def test_trees_add_what_base_patterns_miss(spark):
    model = pii.learn(documents(spark, tokens_and_words(240)))
    assert model.precision["secret"] >= 0.95 and set(model.thresholds) == {"secret"}  # base spans are no proposals, in training either
    key = "0123456789abcdef0123456789abcdef01234567"
    rows = [(1, f"lost {key} here"), (2, "auslanderbehordenangelegenheit and counterrevolutionaries"), (3, "ring +49 (030) 1234-567 or a@b.co"), (4, f"password: {key}")]
    found = {r["doc_id"]: r for r in pii.find(documents(spark, [(i, t, "s") for i, t in rows]), model=model).collect()}
    assert found[1]["spans"] == "secret:5:45" and found[2]["spans"] == "" and found[4]["spans"] == "secret:10:50"
    assert found[3]["spans"] == "phone:5:23,email:27:33"
    without = pii.find(documents(spark, [(1, rows[0][1], "s")]), model=pii.Model(0.0, [])).first()
    assert without["spans"] == ""  # the trees decide


def test_overlapping_spans_are_resolved_by_probability(spark):
    spans = [(0, 5, 0.9), (3, 8, 0.95), (7, 9, 0.5), (9, 12, 0.5), (10, 11, 0.5), (20, 30, 0.1)]
    df = spark.createDataFrame([([(a, 0, b, "k", p) for a, b, p in spans],), ([],)], f"x {pii._SCORED}")
    kept = [[(r["start"], r["end"]) for r in x[0]] for x in df.select(pii._resolved(F.col("x"))).collect()]
    assert kept == [[(3, 8), (9, 12), (20, 30)], []]


def test_many_spans_in_one_text(spark):
    model = pii.learn(documents(spark, tokens_and_words(120)))
    text = " ".join(["a@b.cd"] * 60_000 + ["0123456789abcdef0123456789abcdef01234567"] * 20_000)
    began = time.time()
    found = pii.find(documents(spark, [(1, text, "s")]), model=model).first()
    assert (found["n_email"], found["n_secret"], found["n_spans"]) == (60_000, 20_000, 80_000)
    assert time.time() - began < 90


def test_redaction_keeps_the_rest(spark):
    docs = documents(spark, [(1, "é mail a@b.co now", "s"), (2, None, "s"), (3, "clean", "s")]).withColumnsRenamed({"own": "base", "n": "spans", "token": "body", "shard": "row"})
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert got == {1: "é mail <email> now", 2: None, 3: "clean"} and pii.redact(docs).columns == docs.columns


def test_boosting_separates_counts():
    import numpy as np

    x = {n: np.zeros(4, np.int64) for n in pii.BINS} | {"digits": np.array([0, 1, 5, 6]), "plus": np.array([0, 1, 0, 1])}
    positive, total = np.array([0.0, 90.0, 0.0, 99.0]), np.array([100.0, 100.0, 100.0, 100.0])
    model = pii.boost(x, positive, total)
    score = model.predict(x)
    kinds = np.array(["phone", "phone", "phone", "phone"])
    pii.calibrate(model, score, kinds, positive, total)
    assert score[3] > model.thresholds["phone"] > score[0] and score[1] < model.thresholds["phone"]
    assert [p for _, p in model.steps] == sorted(p for _, p in model.steps) and model.precision == {"phone": 0.99}


@pytest.mark.parametrize("segment", [65_536, 50])
def test_archives_round_trip(spark, segment, tmp_path):
    rng = random.Random(6)
    nasty = ["WARC/1.1\r\n", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "é日😀", "\r\n\r\n\r\n\r\n", "WARC", "/1.1\r\n", "0\r\n\r\n", "plain text "]
    rows = [(i, f"http://h/{i}\r\nX: y", "".join(rng.choices(nasty, k=rng.randint(0, 200)))) for i in range(40)]
    rows += [(100 + i, None, "same " * 300) for i in range(5)] + [(200 + i, "u", "tiny") for i in range(3)] + [(300, "u", None), (None, "u", "same " * 300), (104, None, "same " * 300)]
    warc.write_archives(pages(spark, rows), str(tmp_path / "w"), segment_bytes=segment)
    found = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(found) == len(rows) and all(r["complete"] for r in found)
    whole = Counter((None if i is None else str(i), (h or "").encode()) for i, _, h in rows if not ((h or "").startswith("same") and i != 104))
    assert Counter((r["page"], bytes(r["payload"])) for r in found if r["record_type"] == "response") == whole
    twins = [r for r in found if r["record_type"] == "revisit"]
    assert {(r["page"], r["refers_to"]) for r in twins} == {(None, "104"), *((str(100 + i), "104") for i in range(4))}
    sha = hashlib.sha1(("same " * 300).encode()).hexdigest()
    assert all(r["payload_digest"] == sha and r["payload_bytes"] == 1500 for r in twins)


def test_archives_of_others(spark, tmp_path):
    """Bytes that are no text, a body that holds whole records, other types, LF only in bodies, hex digests, no page ids."""
    png = b"\x89PNG\r\n\x1a\n\xff\xfe" * 50
    inner = b"see WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n end"

    def record(kind, body, *more, version=b"WARC/1.0"):
        head = [b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:uuid:%d>" % len(body), b"WARC-Date: 2020-01-01T00:00:00Z", *more, b"Content-Length: %d" % len(body)]
        return version + b"\r\n" + b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n"
    sha = hashlib.sha1(png).hexdigest().encode()
    data = record(b"warcinfo", b"software: WARC/1.1 tools") + record(b"response", http + png, b"WARC-Payload-Digest: sha1:" + sha, b"WARC-Target-URI: http://a/") + record(b"request", b"GET / HTTP/1.1\r\n\r\n") + record(b"response", http + inner, version=b"WARC/1.1") + record(b"resource", b"plain\n\n")
    data += record(b"response", http + png)[:-300]
    for name in ("a.warc.gz", "b.warc"):
        (tmp_path / name).write_bytes(b"".join(gzip.compress(x) for x in (data[:5000], data[5000:])) if name.endswith("gz") else data)
        found = warc.read_archives(spark, str(tmp_path / name)).collect()
        whole = [bytes(r["payload"]) for r in found if r["complete"]]
        assert sorted(whole) == sorted([png, inner, b"plain\n\n"]) and len(found) == 4
        assert [r["url"] for r in found if bytes(r["payload"]) == png and r["complete"]] == ["http://a/"]


def test_records_have_the_fields_that_the_format_asks_for(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "same " * 300) for i in range(3)] + [(9, "http://h/9", "other " * 40_000)]
    warc.write_archives(pages(spark, rows), str(tmp_path / "w"), date="2024-05-01T00:00:00Z")
    text = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("*.gz")).decode()
    heads = [dict(x.split(": ", 1) for x in h.split("\r\n")[1:]) for h in re.findall(r"WARC/1\.1\r\n(?s:.*?)(?=\r\n\r\n)", text)]
    assert all(h["WARC-Date"] == "2024-05-01T00:00:00Z" and h["WARC-Record-ID"] and h["WARC-Target-URI"] for h in heads)
    assert len({h["WARC-Record-ID"] for h in heads}) == len(heads)
    owner = next(h for h in heads if h.get("X-Page-ID") == "2")
    twins = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert len(twins) == 2 and all(h["WARC-Refers-To"] == owner["WARC-Record-ID"] for h in twins)
    assert sum(h["WARC-Type"] == "continuation" for h in heads) == 3


def test_damaged_segments_are_not_complete(spark):
    assert warc.unchunked(warc.chunked(b"abc" * 10, 4)) == b"abc" * 10
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nab")
    assert warc.archive(pages(spark, [])).count() == 0


def test_sharding_law(spark):
    rows = odd_rows(n=400)
    found = sharding.shard_documents(documents(spark, rows), sharding.even_tree(40), sharding.even_tree(41)).collect()
    assert len(found) == len(rows)
    assert all(r["grown_shard"] in (r["shard"], 40) for r in found) and any(r["grown_shard"] == 40 for r in found)
    texts = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == texts
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == [*range(len(v))] for v in slots.values())
    assert sharding.shard_documents(documents(spark, []), sharding.even_tree(4)).count() == 0


def test_sharding_weights(spark):
    keys = documents(spark, [(i, "", "s") for i in range(6000)])
    tree = [sharding.Leaf(i, i // 2, i // 4, 3.0 if i == 1 else 1.0) for i in range(8)]
    lighter = [sharding.Leaf(x.shard, x.rack, x.region, 1.0) for x in tree]
    a = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(keys, tree).collect()}
    b = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(keys, lighter).collect()}
    assert abs(sum(v == 1 for v in a.values()) / 6000 - 0.3) < 0.03
    # Region 0 (shards 0 to 3) holds the changed leaf: keys leave it, and no key moves within the other region.
    assert all(a[k] == b[k] for k in a if a[k] > 3)
    assert all(b[k] > 3 or b[k] // 2 == a[k] // 2 or a[k] // 2 == 0 for k in a if a[k] <= 3)


def test_descent_draws_nodes(spark):
    """Each level's place follows from draws among the children of the chosen node alone."""
    tree = [sharding.Leaf(i, i // 2, i // 4, 1.0 + i % 3) for i in range(8)]
    keys = documents(spark, [(i, "", "s") for i in range(8000)])
    found = sharding.shard_documents(keys, tree).collect()
    whole = sum(x.weight for x in tree)
    for leaf in tree:
        assert abs(sum(r["shard"] == leaf.shard for r in found) / len(found) - leaf.weight / whole) < 0.02
        assert all((r["rack"], r["region"]) == (leaf.rack, leaf.region) for r in found if r["shard"] == leaf.shard)
    more = sharding.shard_documents(keys, tree, [*tree, sharding.Leaf(8, 4, 2)]).collect()
    assert all(r["grown_shard"] in (r["shard"], 8) for r in more)
    # A heavier shard in region 1 moves keys into region 1 only, and there into its own rack only.
    heavier = [sharding.Leaf(x.shard, x.rack, x.region, 9.0 if x.shard == 7 else x.weight) for x in tree]
    for a, b in zip(sorted(found, key=lambda r: r["doc_id"]), sorted(sharding.shard_documents(keys, heavier).collect(), key=lambda r: r["doc_id"])):
        assert a["shard"] == b["shard"] or b["region"] == 1
        assert a["region"] == 0 or a["shard"] == b["shard"] or b["rack"] == 3


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bdgklm" for b in "aeiou" for c in ("na", "ro", "ti", "su")]
    rows, labels = [], []
    for i in range(600):
        own = rng.choices(words, k=rng.randint(20, 60))
        bad = i % 6 == 0
        if bad:
            own[rng.randrange(len(own))] = "vexo" + rng.choice(words)
        rows.append((i, " ".join(own), "s"))
        labels.append((i, int(i % 5 > 0), int(bad)))
    docs = documents(spark, [*rows, (None, None, None), (700, "", "s")])
    known = spark.createDataFrame([x for x in labels if x[0] % 2] + [x for x in labels if x[0] % 4 == 0] + [(None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.learn(docs, known)).collect()}
    assert len(found) == 602 and not found[None]["toxic"] and not found[700]["toxic"]
    held = [x for x in labels if x[0] % 4 == 2]
    right = sum(bool(x[2]) == found[x[0]]["toxic"] for x in held)
    assert right >= 0.95 * len(held)
    nothing = toxicity.learn(docs, known.limit(0))
    assert not any(r["toxic"] for r in toxicity.score(docs, nothing).collect())


def test_a_fold_is_not_seen_by_its_features(spark):
    """Words that occur in one fold's rows alone are chosen for the other folds only."""
    docs = [(i, f"common{i % 3} " + ("marker " if i % 2 else "plain ") * 3) for i in range(300)]
    folds = {r["doc_id"]: r["f"] for r in spark.range(300).select(F.col("id").alias("doc_id"), toxicity._fold(F.col("id")).alias("f")).collect()}
    docs = [(i, t + (f" only{'xyz'[folds[i]]}" if i % 2 else "")) for i, t in docs]
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in docs], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = toxicity.sample(frame, labels, "doc_id", "text", 300, {"toxic": F.col("toxic") == 1})
    lists = toxicity.choose(rows, 50, 1)
    word = lambda w: toxicity.word_features(w)[0]
    for fold in range(toxicity.FOLDS):
        only = word("only" + "xyz"[fold])
        assert only in lists[-1] and only not in lists[fold] and only in lists[(fold + 1) % 3]
        assert word("marker") in lists[fold]


def test_chain_feeds_earlier_probabilities(spark):
    """A later category that equals the earlier one, and whose own features say nothing, is told by the earlier probability alone."""
    import numpy as np

    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 600)
    rows = np.flatnonzero(y)
    data = toxicity.Data(rows, np.zeros(len(rows), np.int64), np.zeros((600, toxicity.N_RATIOS)), np.ones(600), 1)
    folds = np.arange(600) % toxicity.FOLDS
    chain = toxicity.train(toxicity.Chain(["a", "b"], [1]), data, np.column_stack([y, y]), folds, [np.array([0])] * (toxicity.FOLDS + 1))
    plain = [toxicity.fit(data, data.dense, y.astype(float), folds != f) for f in range(toxicity.FOLDS)]
    expected = np.zeros(600)
    for f, model in enumerate(plain):
        expected[folds == f] = toxicity._sigmoid(model.logits(data, data.dense))[folds == f]
    assert np.allclose(chain.out_of_fold[:, 0], expected) and len(chain.models[1].dense) == toxicity.N_RATIOS + 1
    assert chain.models[1].dense[-1] > 0 and ((chain.predict(data)[:, 1] > chain.thresholds[1]) == y).all()


def test_capitals_of_the_whole_text_count():
    text = "quiet words " * 500 + "SHOUTED ÉΣ " * 900
    assert toxicity.Features([])(text)[1][3] == sum(c.isupper() for c in text) / len(text)
    far = "x" * toxicity._BLOCK + "AB🄰"
    assert toxicity.capitals(far) == 3 and toxicity.capitals("") == 0


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    rows = [(i, f"document {i} " + " ".join(f"w{(i * 7 + k * k) % 500}x{k}" for k in range(80)), f"s{i % 2}") for i in range(30)]
    rows += [(100, rows[4][1], "s0"), (101, None, None), (102, "too short", "s0")]
    docs = documents(spark, rows)
    items = spark.createDataFrame([(1, " ".join(rows[7][1].split()[5:30]))], "item_id long, text string")
    path = "/tmp/quillspark-test-" + hashlib.md5(repr(rows).encode()).hexdigest()
    items.write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, path)
        assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i in range(30) if i != 7}
    packed = corpus_pipeline.run(spark, path)
    assert {r["doc_id"] for r in packed.collect()} == {i for i in range(30) if i != 7}


def test_a_sample_is_bounded_where_ids_repeat(spark):
    """One id on 3,000 documents and on labels that differ makes one row of the sample."""
    docs = documents(spark, [(1, f"text {k % 2}", "s") for k in range(3000)] + [(k, f"t {k}", "s") for k in range(2, 40)])
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (1, 0, 1)] + [(k, k % 2, 0) for k in range(2, 40)], "doc_id long, quality int, toxic int")
    rows = toxicity.sample(docs, labels, "doc_id", "text", 100, toxicity.conditions()).collect()
    assert len(rows) == len({r["key"] for r in rows}) <= 39 and [r["y"] for r in rows if r["key"] == 1] in ([], [[1, 1, 1]])
    assert toxicity.score(docs, toxicity.learn(docs, labels, size=100)).count() == 3038


def test_a_repeated_row_is_dealt_out(spark):
    docs = documents(spark, [(7, "same", "s")] * 5000 + [(8, "x", "s")])
    rows = sharding.shard_documents(docs, sharding.even_tree(3)).collect()
    own = sorted(r["slot"] for r in rows if r["doc_id"] == 7)
    assert len(rows) == 5001 and len({r["shard"] for r in rows if r["doc_id"] == 7}) == 1
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == [*range(sum(1 for r in rows if r["shard"] == shard))]
    assert len(own) == 5000


def test_long_strings_are_proposed(spark):
    rows = spark.createDataFrame([("key=" + "aB3" * 300 + " " + "x" * 15 + " " + "y" * 16,)], "t string")
    found = rows.select(F.regexp_extract_all("t", F.lit(pii.LOOSE["string"][0]), F.lit(0)).alias("x")).first()["x"]
    assert found == ["key=" + "aB3" * 300, "y" * 16]


def test_trees_find_what_is_announced_elsewhere(spark):
    """Numbers of one form that are called telephone numbers most of the time are found where nothing announces them; others are left."""
    rng = random.Random(12)
    number = lambda: f"0{rng.randrange(100, 999)} {rng.randrange(1000, 9999)} {rng.randrange(100, 999)}"
    order = lambda: f"{rng.randrange(10**7, 10**8)}"
    rows = [(k, f"some words {k} tel: {number()} and more, no. {order()} of them, mail x{k}@a.example", "s") for k in range(300)]
    rows += [(1000 + k, f"write {number()} down {k}", "s") for k in range(5)]
    docs = documents(spark, rows)
    model = pii.learn(docs)
    assert set(model.thresholds) == {"phone"} and model.precision["phone"] >= pii.PRECISION
    found = {r["doc_id"]: r["spans"] for r in pii.find(docs, model=model).collect()}
    for k in range(5):
        at = rows[300 + k][1].index("0")
        assert found[1000 + k] == f"phone:{at}:{at + 13}"
    for k, text, _ in rows[:300]:
        a, m = text.index("tel: ") + 5, text.index("mail ") + 5
        assert found[k] == f"phone:{a}:{a + 13},email:{m}:{len(text)}"
    told = {r["kind"]: (r["n_base"], r["n_found"]) for r in pii.recall(docs, model).collect()}
    assert told == {"email": (300, 0)}
    plus = documents(spark, [(1, f"call +{number()}", "s"), (2, f"x +4{number()} y", "s")])
    assert {r["kind"]: r["n_base"] for r in pii.recall(plus, model).collect()} == {"phone": 2}
