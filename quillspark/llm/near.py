"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

A document's set is its distinct 5-word shingles; two documents link when 100 * intersection >= 75 * union. Documents with equal sets
are one class, and the work is done on classes.

Prefixes. Shingles are ordered by their estimated frequency, rare first, from a sketch of fixed size over all documents (any order
that all documents share gives right results; a good one gives few candidates). Two sets that link share at least l of the first
n - ceil(0.75 n) + l shingles. A document whose short prefix would meet many others takes a longer one: l is chosen between 1 and
MOST_SHARED by the cost of its lists and of the candidates that share l of them, and a pair is verified when it shares min(l, l') in
the prefixes that its two sizes require.

Components without all pairs. First each prefix shingle pairs its documents with one pivot only, the document in which it stands
foremost; these pairs are verified and give components. Then only pairs of documents in different components are left to look at:
shingles whose documents are all in one component are done, and in the others pairs come from documents outside the shingle's
largest component against the rest, by sizes and positions. Pairs that pass are verified against the whole sets, so that no link
between two components is lost, while the members of a large group of near copies are never paired with each other.

Nulls: a null text has an empty set, which links with nothing; a null id is passed on, and is no component's id unless all its ids
are null. Repeated rows are copies like any others. An empty table gives an empty result. Texts are shingled whole. Extra columns are
ignored by ``components`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import packed, passing, sliced, unpacked, written

SHINGLE = 5
#: Similarity in hundredths.
PERCENT = 75
MOST_SHARED = 4
#: Cells of the frequency sketch: fixed, so that what the driver and the executors hold of it is 2 MB at any size of the corpus.
SKETCH_BITS = 18
#: A shingle that is expected in more documents is dealt out in parts of about so many.
PART = 50_000
#: Candidate ids are broadcast up to so many bytes, and joined by a shuffle beyond.
MOST_BROADCAST = 32 << 20
#: Tasks whose sketches are summed up by one task of the next round.
SUMMED = 64
#: Ratio of neighbouring size buckets.
BUCKET = 1.05

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: What stays of eight bytes of which the first 0 to 8 belong to a word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed one by one.
_LONG = 256


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the texts' words in order, and how many each text has; eight bytes of all words are mixed in at once."""
    bodies = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    body = b"\n".join(bodies).translate(_FOLD) + b"\n" * 8
    blank = _BLANK[np.frombuffer(body, np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    edges = edges if blank[0] else np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    eights = np.ndarray((len(body) - 7,), "<u8", body, strides=(1,))
    size = ends - starts
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    on, at = np.arange(len(size)), 0
    while len(on) and at < _LONG:
        left = size[on] - at
        x = h[on] ^ (eights[starts[on] + at] & _FIRST[np.minimum(left, 8)])
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        h[on] = x
        on, at = on[left > 8], at + 8
    for k in on.tolist():
        h[k] = xxhash.xxh3_64_intdigest(body[starts[k] : ends[k]])
    offsets = np.cumsum([0] + [len(b) + 1 for b in bodies])
    return h, np.diff(np.searchsorted(starts, offsets))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k word hashes."""
    s = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        s *= np.uint64(0x9E3779B97F4A7C15)
        s ^= h[j : len(h) - k + 1 + j]
        s ^= s >> np.uint64(29)
        s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    return s


def _distinct(s: np.ndarray) -> np.ndarray:
    s = np.sort(s)
    new = s[1:] != s[:-1]
    return s if new.all() else s[np.concatenate([[True], new])]


def shingles(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles. All words of the texts are hashed together, and runs across texts are left out."""
    h, counts = word_hashes(texts)
    runs = _mixed(h, SHINGLE) if len(h) >= SHINGLE else h[:0]
    out, at = [], 0
    for n in counts.tolist():
        if n >= SHINGLE:
            out.append(_distinct(runs[at : at + n - SHINGLE + 1]))
        else:
            out.append(_mixed(h[at : at + n], n) if n else h[:0])
        at += n
    return out


def _signature(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - 2**63


def _cells(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def signed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per row: doc_id, mark (a hash of the text), n, sig; and per task one row with n = -1 and its part of the sketch."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen, kind = np.zeros(1 << SKETCH_BITS, np.int32), set(), None
        for batch in sliced(batches, 2):
            kind, sets = batch.schema.field(0).type, shingles(batch.column(2).to_pylist())
            sigs = [*map(_signature, sets)]
            new = dict(zip(sigs, sets, strict=True))
            fresh = [own for sig, own in new.items() if sig not in seen]
            seen.update(new)
            if fresh:
                sketch += np.bincount(_cells(np.concatenate(fresh)), minlength=len(sketch)).astype(np.int32)
            yield _signed_batch(batch.column(0), batch.column(1), [*map(len, sets)], sigs, [None] * len(sets))
        if kind is not None:
            yield _signed_batch(pa.nulls(1, kind), pa.nulls(1, pa.int64()), [-1], [0], [_pressed(sketch)])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return written(rows.mapInArrow(run, f"doc_id {kind}, mark bigint, n bigint, sig bigint, cells binary"), "signed")


def _signed_batch(ids: pa.Array, marks: pa.Array, sizes: list[int], sigs: list[int], cells: list[bytes | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, marks, pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()), pa.array(cells, pa.binary())], names=["doc_id", "mark", "n", "sig", "cells"])


def _pressed(sketch: np.ndarray) -> bytes:
    return zlib.compress(sketch.astype("<i8").tobytes(), 1)


def _sum_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column(0).to_pylist():
            part = np.frombuffer(zlib.decompress(x), "<i8")
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([_pressed(total)], pa.binary())], names=["cells"])


def sketch_of(marks: DataFrame) -> np.ndarray:
    """How many documents' shingles fall into each cell, less what chance alone puts there."""
    parts = marks.where("n < 0").select("cells").mapInArrow(_sum_cells, "cells binary")
    n = parts.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // SUMMED)
        parts = parts.repartition(n).mapInArrow(_sum_cells, "cells binary")
    total = parts.collect()
    if not total:
        return np.zeros(1 << SKETCH_BITS)
    cells = np.frombuffer(zlib.decompress(total[0]["cells"]), "<i8").astype(np.float64)
    mean = cells.mean()
    return np.maximum(0.0, cells - mean - 4 * np.sqrt(mean) - 1)


def prefix(own: np.ndarray, excess: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, int]:
    """The prefix of a set: its shingles in order, their expected frequencies, and how many a partner has to share."""
    n = len(own)
    cost = excess[_cells(own)]
    least = n - -(-percent * n // 100)
    rare = np.flatnonzero(cost == 0)
    if len(rare) > least:  # a prefix of rare shingles costs nothing
        rare = rare[: least + 1]
        return own[rare], cost[rare], 1
    order = np.argsort(cost, kind="stable")  # the set is sorted, which settles ties
    cost = cost[order]
    run = np.cumsum(cost)
    most = min(MOST_SHARED, n - least)
    shared = min(range(1, most + 1), key=lambda k: (run[least + k - 1] * (1 + 4 / k), k))
    length = least + shared
    return own[order[:length]], cost[:length], shared


#: meta holds pos, n and shared, so that rows go through the shuffle small and sort by their place.
_ROWS = "token bigint, part int, sig bigint, meta bigint"
_N_BITS, _SHARED_BITS = 30, 3


def prefixes(docs: DataFrame, text: str, excess: Broadcast, percent: int = PERCENT) -> DataFrame:
    """A row for each prefix shingle of each class: token, part (0 where the shingle isn't dealt out), sig and meta."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = excess.value, set()
        for batch in sliced(batches, 0):
            tokens, costs, heads = [], [], []
            for own in shingles(batch.column(0).to_pylist()):
                sig = _signature(own)
                if not len(own) or sig in seen:
                    continue
                seen.add(sig)
                found, cost, shared = prefix(own, sketch, percent)
                tokens.append(found)
                costs.append(cost)
                heads.append((len(found), sig, len(own) << _SHARED_BITS | shared))
            if not tokens:
                continue
            lengths, sigs, low = (np.array(x, np.int64) for x in zip(*heads, strict=True))
            sig = np.repeat(sigs, lengths)
            pos = np.arange(len(sig)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            parts = np.maximum(1, np.ceil(np.concatenate(costs) / PART)).astype(np.int64)
            part = np.where(parts > 1, 1 + (sig & 0x7FFFFFFF) % parts, 0).astype(np.int32)
            meta = pos << (_N_BITS + _SHARED_BITS) | np.repeat(low, lengths)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(part), pa.array(sig), pa.array(meta)], names=[x.split()[0] for x in _ROWS.split(", ")])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, _ROWS)


def _placed(meta: np.ndarray) -> list[np.ndarray]:
    """n, pos and shared of meta."""
    n, shared = meta >> _SHARED_BITS & ((1 << _N_BITS) - 1), meta & ((1 << _SHARED_BITS) - 1)
    return [x.astype(np.int32) for x in (n, meta >> (_N_BITS + _SHARED_BITS), shared)]


_SHARED = "token bigint, part int, sig bigint, n int, pos int, shared int, pivot bigint, pivot_n int, pivot_pos int, pivot_shared int"


def shared_rows(rows: DataFrame) -> DataFrame:
    """The rows of shingles with two classes or more, each with its part's pivot: the class in which it stands foremost.

    A class alone in its part of a shingle stays if any other part has a class. Rows arrive sorted by shingle, so that a task streams through them and holds one batch, whatever the size of a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None  # the last row, if it may still be alone
        pivot: np.ndarray | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], axis=1)
            before = held if held is not None else pivot
            if before is not None:
                table = np.concatenate([before[None, :], table])
            again = np.zeros(len(table), bool)  # copies of a class from several tasks
            again[1:] = (table[1:, :3] == table[:-1, :3]).all(axis=1)
            table = table[~again]
            new = np.ones(len(table), bool)
            new[1:] = (table[1:, :2] != table[:-1, :2]).any(axis=1)
            first = np.maximum.accumulate(np.where(new, np.arange(len(table)), 0))
            pivots = table[first]
            if pivot is not None:
                same = first == 0
                pivots[same] = pivot
            sizes = np.bincount(first, minlength=len(table))
            out = (sizes[first] > 1) | (table[:, 1] > 0)
            carried = pivot is not None and held is None
            if carried:
                out[first == 0] = True
                out[0] = False  # given out with an earlier batch
            last = first[-1]
            alone = last == len(table) - 1 and not (carried and last == 0) and table[last, 1] == 0
            if alone:
                out[-1] = False
                held, pivot = table[-1], None
                pivot = table[-1]
            else:
                held, pivot = None, pivots[-1]
            keep = np.flatnonzero(out)
            if len(keep):
                columns = [table[keep, 0], table[keep, 1].astype(np.int32), table[keep, 2], *_placed(table[keep, 3]), pivots[keep, 2], *_placed(pivots[keep, 3])]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=[x.split()[0] for x in _SHARED.split(", ")])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "token", "part").sortWithinPartitions("token", "part", "meta", "sig")
    found = written(dealt.mapInArrow(run, _SHARED), "shared")
    dealt_out = found.where("part > 0")
    several = dealt_out.groupBy("token").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).where("low <> high").select("token")
    return found.where("part = 0").unionByName(written(dealt_out.join(several, "token", "left_semi"), "dealt").select(*found.columns))


def _overlap(a: Column, b: Column, percent: int) -> Column:
    """The least intersection of linked sets of these sizes."""
    return F.ceil(F.lit(percent) * (a.cast("long") + b) / F.lit(100 + percent) - F.lit(1e-9)).cast("int")


def _within(n: Column, pos: Column, overlap: Column, shared: Column) -> Column:
    return pos <= n - overlap + shared - 1


def _may_link(n1: Column, pos1: Column, s1: Column, n2: Column, pos2: Column, s2: Column, percent: int) -> Column:
    """Whether a shingle at these places lies in the prefixes that the two sizes require."""
    need, shared = _overlap(n1, n2, percent), F.least(s1, s2)
    sizes = (100 * n1 >= percent * n2) & (100 * n2 >= percent * n1)
    return sizes & _within(n1, pos1, need, shared) & _within(n2, pos2, need, shared)


def star_pairs(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of classes with their shingles' pivots, and of pivots of a shingle's parts."""
    c = F.col
    near = rows.where((c("sig") != c("pivot")) & _may_link(c("n"), c("pos"), c("shared"), c("pivot_n"), c("pivot_pos"), c("pivot_shared"), percent))
    pairs = near.select(F.least("sig", "pivot").alias("a"), F.greatest("sig", "pivot").alias("b"))
    heads = rows.where("part > 0 OR sig = pivot").select("token", "part", "pivot").distinct()
    split = heads.groupBy("token").agg(F.max("part").alias("parts"), F.min("pivot").alias("head")).where("parts > 0")
    across = heads.join(split.select(c("token").alias("t"), "head"), c("token") == c("t")).where("pivot <> head")
    return pairs.union(across.select(F.least("pivot", "head"), F.greatest("pivot", "head"))).distinct()


def heads_of(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Written table of sig, n, the length of its prefix, and those of its prefix shingles that other classes have in theirs."""
    c = F.col
    out = rows.groupBy("sig").agg(F.first("n").alias("n"), F.first("shared").alias("shared"), F.collect_set("token").alias("tokens"))
    length = c("n") - F.ceil(percent * c("n") / F.lit(100.0) - 1e-9).cast("int") + c("shared")
    return written(out.select("sig", "n", length.alias("length"), "tokens"), "heads")


def likely(pairs: DataFrame, heads: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose prefixes share as much as a link requires.

    Of two linked sets, let a's prefix end first in the common order. At most n - length of the intersection lies behind a's prefix,
    and the rest lies in both prefixes; so they share length - n + overlap for one of the two at least.
    """
    c = F.col
    side = lambda k: heads.select(*[c(x).alias(f"{x}_{k}") for x in ("sig", "n", "length", "tokens")])
    both = pairs.join(side("a"), c("a") == c("sig_a")).join(side("b"), c("b") == c("sig_b"))
    overlap = _overlap(c("n_a"), c("n_b"), percent)
    need = F.least(c("length_a") - c("n_a"), c("length_b") - c("n_b")) + overlap
    sizes = (100 * c("n_a") >= percent * c("n_b")) & (100 * c("n_b") >= percent * c("n_a"))
    return both.where(sizes & (F.size(F.array_intersect("tokens_a", "tokens_b")) >= need)).select("a", "b")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()


def sets_of(docs: DataFrame, marks: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Written table of sig and its set, for the wanted classes, each taken from one of its documents."""
    ids = marks.where("n > 0").groupBy("sig").agg(F.min(F.struct("mark", "doc_id")).alias("one"))
    ids = written(ids.join(wanted, "sig", "left_semi").select("sig", "one.mark", "one.doc_id"), "wanted")
    rows = docs.select(F.col(doc_id).alias("own_id"), F.xxhash64(F.col(text)).alias("own_mark"), F.col(text).alias("text"))
    size = ids.agg(F.sum(F.lit(32) + F.coalesce(F.octet_length(F.col("doc_id").cast("string")), F.lit(0))).alias("n")).first()["n"] or 0
    few = size <= MOST_BROADCAST
    picked = rows.join(F.broadcast(ids) if few else ids, (F.col("own_mark") == F.col("mark")) & F.col("own_id").eqNullSafe(F.col("doc_id"))).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0):
            own = shingles(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([_signature(s) for s in own], pa.int64()), pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64()))], names=["sig", "own"])

    found = picked.mapInArrow(run, "sig bigint, own array<bigint>")
    return written(found, "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those pairs (a, b) that link."""
    once = sets.dropDuplicates(["sig"]) if sets.groupBy("sig").count().where("count > 1").limit(1).count() else sets
    left = pairs.join(once.select(F.col("sig").alias("a"), F.col("own").alias("own_a")), "a")
    both = left.join(once.select(F.col("sig").alias("b"), F.col("own").alias("own_b")), "b")
    common = F.size(F.array_intersect("own_a", "own_b"))
    return both.where(100 * common >= percent * (F.size("own_a") + F.size("own_b") - common)).select("a", "b")


def connected(links: DataFrame) -> DataFrame:
    """Written table of sig and root, the least class that it reaches, for all classes that have links."""
    with passing(links.sparkSession) as keep:
        both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
        labels = written(both.groupBy(F.col("a").alias("sig")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "labels")
        while True:
            step = both.join(labels.select(F.col("sig").alias("b"), "root"), "b").groupBy(F.col("a").alias("sig")).agg(F.min("root").alias("near"))
            moved = labels.join(step, "sig").select("sig", F.least("root", "near").alias("next"), "root")
            # A label is a class whose own label is at least as small: jump there.
            jump = labels.select(F.col("sig").alias("next"), F.col("root").alias("far"))
            moved = written(moved.join(jump, "next", "left").select("sig", F.least("next", "far").alias("next"), "root"), "labels")
            labels = moved.select("sig", F.col("next").alias("root"))
            if not moved.where("next <> root").limit(1).count():
                return keep(written(labels, "component"))


def meetings(rows: DataFrame, labels: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row (sig0, sig1, need, weight) for each prefix shingle, or passage of ``weight`` of them with equal lists, in which two classes of
    different components meet and may link.

    Of the intersection of a pair, all that lies before the end of the prefix that ends first is in both prefixes, and the rest is behind
    that prefix. So it has at most suffix + open members for one of the two: the shingles behind its prefix, and those of its prefix that
    other components have too. A class for which this is less than a link requires is not able to link by its own prefix, and two such
    classes never meet; a passage that many otherwise different texts share doesn't bring them together.
    """
    c = F.col
    rows = rows.select("token", "sig", "n", "pos", "shared").join(labels, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    rows = written(rows, "rooted")
    mixed = rows.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    rows = written(rows.join(written(mixed, "mixed"), "token", "left_semi"), "open")
    most = rows.groupBy(c("sig").alias("of")).agg((F.ceil(percent * F.first("n") / F.lit(100.0) - 1e-9).cast("int") - F.first("shared") + F.count("*")).alias("most"))
    rows = rows.join(written(most, "most"), c("sig") == c("of")).drop("of")

    def bucket(n: Column) -> Column:
        return F.floor(F.ln(n.cast("double")) / F.lit(float(np.log(BUCKET))) + 1e-9).cast("int")

    # The smaller set of a pair stands in its own size's bucket, the larger one in those of all sizes it may meet at this place.
    small = rows.where(_within(c("n"), c("pos"), _overlap(c("n"), c("n"), percent), c("shared"))).withColumn("bucket", bucket(c("n")))
    small = small.withColumn("able", _overlap(c("n"), c("n"), percent) <= c("most"))
    low = F.ceil(percent * c("n") / F.lit(100.0) - 1e-9).cast("int")
    large = rows.withColumn("bucket", F.explode(F.sequence(bucket(low), bucket(c("n")))))
    least = F.greatest(low, F.ceil(F.pow(F.lit(BUCKET), c("bucket")) - 1e-6).cast("int"))
    large = large.where(_within(c("n"), c("pos"), _overlap(least, c("n"), percent), c("shared"))).withColumn("able", _overlap(least, c("n"), percent) <= c("most"))
    sides = small.withColumn("side", F.lit(0)).unionByName(large.withColumn("side", F.lit(1))).drop("most")
    sides = written(sides, "sides")
    counts = sides.groupBy("token", "bucket", "root").agg(F.count("*").alias("rows"), F.min("side").alias("low"), F.max("side").alias("high"), F.max("able").alias("able"))
    groups = counts.groupBy("token", "bucket").agg(F.max_by("root", F.struct("rows", "root")).alias("main"), F.count("*").alias("roots"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("able").alias("any"))
    groups = written(groups.where("roots > 1 AND low = 0 AND high = 1 AND any").select("token", "bucket", "main"), "groups")
    sides = written(sides.join(groups, ["token", "bucket"]).withColumn("minor", c("root") != c("main")).drop("main"), "minor")
    sides = passages(sides)

    def side(k: int, minor: bool | None, able: bool | None) -> DataFrame:
        out = sides.where(c("side") == k)
        for name, value in (("minor", minor), ("able", able)):
            out = out if value is None else out.where(c(name) == F.lit(value))
        return out.select("token", "bucket", *[c(x).alias(f"{x}{k}") for x in ("sig", "n", "pos", "shared", "root", "weight")])

    fits = (c("root0") != c("root1")) & (F.struct("n0", "sig0") < F.struct("n1", "sig1")) & _may_link(c("n0"), c("pos0"), c("shared0"), c("n1"), c("pos1"), c("shared1"), percent)
    met = None
    # One of the two is outside the group's largest component, and one of the two is able to link.
    for minor, able in product((True, False), (True, False)):
        x, y = side(0, minor, able), side(1, None if minor else True, None if able else True)
        pairs = x.join(y, (x["token"] == y["token"]) & (x["bucket"] == y["bucket"]) & fits).select("sig0", "sig1", F.least("shared0", "shared1").alias("need"), c("weight0").alias("weight"))
        met = pairs if met is None else met.union(pairs)
    return met


def passages(sides: DataFrame) -> DataFrame:
    """The rows (token, bucket, sig, side, pos and others) with weight, as a written table.

    Shingles of a passage stand in the same classes: of those with equal lists one stands for all, with their number as its weight, and at
    the foremost of their places in each class. So a passage that many texts share counts once, and no pair is lost: one that any of
    the shingles would let meet is met.
    """
    same = [F.bit_xor(F.xxhash64("sig", "side", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    lists = sides.groupBy("token", "bucket").agg(F.count("*").alias("size"), *same)
    lists = written(lists, "lists")
    heads = lists.groupBy("bucket", "size", "x1", "x2").agg(F.min("token").alias("head"), F.count("*").alias("weight")).where("weight > 1")
    heads = written(lists.join(heads, ["bucket", "size", "x1", "x2"]).select("token", "bucket", "head", "weight"), "heads_of_passages")
    alone = sides.join(heads.select("token", "bucket"), ["token", "bucket"], "left_anti").withColumn("weight", F.lit(1).cast("long"))
    rest = [x for x in sides.columns if x not in ("token", "bucket", "sig", "side", "pos")]
    many = sides.join(heads, ["token", "bucket"]).groupBy(F.col("head").alias("token"), "bucket", "sig", "side").agg(F.min("pos").alias("pos"), *[F.first(x).alias(x) for x in (*rest, "weight")])
    return written(alone.unionByName(many), "units")


def left_pairs(rows: DataFrame, labels: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs of classes in different components that share enough of their prefixes."""
    enough = meetings(rows, labels, percent).groupBy("sig0", "sig1").agg(F.sum("weight").alias("met"), F.min("need").alias("need")).where("met >= need")
    return enough.select(F.least("sig0", "sig1").alias("a"), F.greatest("sig0", "sig1").alias("b"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Marks (doc_id, mark, n, sig), one row per document, and labels (sig, root) of all classes that have links."""
    spark = docs.sparkSession
    with passing(spark) as keep:
        marks = keep(signed(docs, doc_id, text))
        excess = spark.sparkContext.broadcast(sketch_of(marks))
        rows = shared_rows(prefixes(docs, text, excess, percent))
        heads = heads_of(rows, percent)
        first = written(likely(star_pairs(rows, percent), heads, percent), "stars")
        with passing(spark) as keep_links:
            links = keep_links(written(verified(first, sets_of(docs, marks, ends_of(first), doc_id, text), percent), "linked"))
        labels = keep(connected(links))
        with passing(spark) as keep_rest:
            rest = likely(left_pairs(rows, labels, percent), heads, percent).join(first.select(F.col("a").alias("x"), F.col("b").alias("y")), (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left_anti")
            rest = keep_rest(written(rest, "rest"))
        links = written(links.union(verified(rest, sets_of(docs, marks, ends_of(rest), doc_id, text), percent)), "all_links")
        labels = keep(connected(links))
    return marks.where("n >= 0").drop("cells"), labels


def _rooted(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    marks, labels = classes(docs, doc_id, text)
    return rooted(marks, labels)


def rooted(marks: DataFrame, labels: DataFrame) -> DataFrame:
    """Written table of the marks with the root of their class, itself where it has no links."""
    rows = marks.join(labels, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    return written(rows, "rooted_docs")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    return named(_rooted(docs, doc_id, text))


def named(rows: DataFrame) -> DataFrame:
    """Per row of ``rooted``: doc_id, n_shingles and the least doc_id of its component."""
    first = written(rows.where("n > 0").groupBy(F.col("root").alias("of")).agg(F.min("doc_id").alias("component")), "first")
    alone = F.col("n") == 0
    return rows.join(first, (F.col("root") == F.col("of")) & ~alone, "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns as they are, less all but the first of each component, by id and then by a hash of the text.

    Documents without words link with nothing and all stay. Of rows with the same id and text one stays.
    """
    rows = _rooted(docs, doc_id, text)
    first = rows.where("n > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "mark")).alias("one"))
    keep = first.select("one.doc_id", "one.mark").union(rows.where("n = 0").select("doc_id", "mark").distinct())
    keep = written(keep.select(F.col("doc_id").alias("keep_id"), F.col("mark").alias("keep_mark")), "kept")
    same = (F.col("mark") == F.col("keep_mark")) & F.col("id").eqNullSafe(F.col("keep_id"))
    left = packed(docs, id=F.col(doc_id), mark=F.xxhash64(F.col(text))).join(keep, same, "left_semi")
    again = rows.where("n > 0").groupBy("doc_id", "mark").count().where("count > 1").select(F.col("doc_id").alias("keep_id"), F.col("mark").alias("keep_mark"))
    again = written(again, "again")
    if again.limit(1).count():
        once = left.join(again, same, "left_semi").groupBy("id", "mark").agg(F.first("row").alias("row"))
        left = left.join(again, same, "left_anti").select("row").union(once.select("row"))
    return unpacked(left, docs)
