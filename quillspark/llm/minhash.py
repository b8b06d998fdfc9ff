"""MinHash near-dedup by tensored banding, and the components of its links.

A document's set is its distinct 5-word shingles; two documents link when 100 * intersection >= 85 * union. Documents with equal sets
are one class, and the work is done on classes.

Tensored banding. There are HALVES collections of HASHES min-hashes on either side, left and right, and a table for each pair of a left
and a right collection: its key puts the two collections together. So HALVES**2 tables with keys of 2 * HASHES min-hashes come from
2 * HALVES * HASHES of them, where tables of their own would take HALVES times as many. Two sets of similarity s miss each other
in all tables with a chance of about 2 * (1 - s**HASHES)**HALVES: 9 in a million at 0.85. Links below are confirmed on the full sets.

No key's classes are paired with each other. A task streams through its keys in order and pairs the classes of a key with its pivot, the
first; these pairs are verified, and give components. Then only keys with classes of several components are left. Classes outside a
key's largest component are paired with its other classes where that makes few pairs. A key where it makes more than CROWD pairs (texts
that share a long passage or a template, and don't link) hands its classes over to the exact join by rare prefixes of ``near``, at the
same similarity: two classes that meet in a crowded key are both among them, so that no pair that a table has found is left out, and
pairs of two such classes need no look in other keys.

Sets of fewer than LEAST shingles can't be that similar without being equal, and need no tables.

Nulls: a null text has an empty set, which links with nothing; a null id is passed on, and is no component's id unless all its ids are
null. Repeated rows are copies like any others; all of a kept id's rows are kept. An empty table gives an empty result. Texts are
shingled whole. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import near
from quillspark.llm.common import passing, sliced, written

PERCENT = 85
#: Min-hashes of a collection, and collections of a side.
HASHES, HALVES = 3, 13
#: Pairs of a key's classes that are looked at one by one.
CROWD = 256
#: The smallest sets that can link with a different one: k shingles shared of k + 1.
LEAST = next(k for k in range(1, 101) if 100 * k >= PERCENT * (k + 1))
#: Shingles that are hashed at once, in the processor's cache.
CHUNK = 1 << 16

_RNG = np.random.default_rng(85)
_A = _RNG.integers(0, 1 << 63, 2 * HALVES * HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, 2 * HALVES * HASHES, np.uint64) * np.uint64(2)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def halves(sets: list[np.ndarray]) -> np.ndarray:
    """The collections' hashes of sets that aren't empty: (set, side * HALVES + collection)."""
    out = np.empty((len(sets), 2 * HALVES), np.uint64)
    start = 0
    while start < len(sets):
        end, n = start, 0
        while end < len(sets) and (end == start or n + len(sets[end]) <= CHUNK):
            n += len(sets[end])
            end += 1
        least = np.full((end - start, len(_A)), np.iinfo(np.uint64).max)
        for at in range(0, n, CHUNK):  # a set longer than a chunk stands alone
            flat = np.concatenate(sets[start:end])[at : at + CHUNK] if n > CHUNK else np.concatenate(sets[start:end])
            edges = np.zeros(1, np.int64) if n > CHUNK else np.cumsum([0] + [len(s) for s in sets[start : end - 1]])
            work = np.empty_like(flat)
            for k, (a, b) in enumerate(zip(_A, _B, strict=True)):
                np.multiply(flat, a, out=work)
                work += b
                np.minimum(least[:, k], np.minimum.reduceat(work, edges), out=least[:, k])
        parts = least.reshape(end - start, 2 * HALVES, HASHES)
        h = np.full(parts.shape[:2], 0x9E3779B97F4A7C15, np.uint64)
        for k in range(HASHES):
            h = _mix(h ^ parts[:, :, k])
        out[start:end] = h
        start = end
    return out


def signed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Written table, per row: doc_id, mark (a hash of the text), n, sig, and halves where a task meets a set first that can link."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in sliced(batches, 2):
            sets = near.shingles(batch.column(2).to_pylist())
            sigs = [near._signature(s) for s in sets]
            first = {}
            for k, (sig, own) in enumerate(zip(sigs, sets, strict=True)):
                if len(own) >= LEAST and sig not in seen:
                    seen.add(sig)
                    first[k] = len(first)
            hashed = halves([sets[k] for k in first])
            cells = [hashed[first[k]].tobytes() if k in first else None for k in range(len(sets))]
            columns = [batch.column(0), batch.column(1), pa.array([*map(len, sets)], pa.int64()), pa.array(sigs, pa.int64()), pa.array(cells, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "n", "sig", "halves"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return written(rows.mapInArrow(run, f"doc_id {kind}, mark bigint, n bigint, sig bigint, halves binary"), "signed")


def keys(marks: DataFrame) -> DataFrame:
    """A row (key, sig) for each table of each class, several where several tasks met it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _mix(np.arange(1, HALVES * HALVES + 1, dtype=np.uint64)).reshape(1, HALVES, HALVES)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                h = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, 2, HALVES)
                key = _mix(_mix(h[:, 0, :, None] ^ tables) ^ h[:, 1, None, :])
                sig = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), HALVES * HALVES)
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(sig)], names=["key", "sig"])

    return marks.where("halves IS NOT NULL").select("sig", "halves").mapInArrow(run, "key bigint, sig bigint")


def met(rows: DataFrame) -> DataFrame:
    """Written table of the rows whose key has several classes, with the key's pivot: its least class.

    Rows arrive sorted, so that a task streams through its keys and holds one batch and one row, whatever the size of a key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: np.ndarray | None = None  # the row before: key, sig, pivot
        told = True  # whether it was given out
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1)
            if last is not None:
                table = np.concatenate([last[None, :2], table])
            again = np.zeros(len(table), bool)
            again[1:] = (table[1:] == table[:-1]).all(axis=1)
            table = table[~again]
            new = np.ones(len(table), bool)
            new[1:] = table[1:, 0] != table[:-1, 0]
            first = np.maximum.accumulate(np.where(new, np.arange(len(table)), 0))
            pivot = table[first, 1]
            if last is not None:
                pivot[first == 0] = last[2]
            several = np.bincount(first, minlength=len(table))[first] > 1
            out = several.copy()
            if last is not None:
                if told:
                    out[first == 0] = True
                    out[0] = False
            end = len(table) - 1
            told = bool(out[end]) or (end == 0 and last is not None and told)
            last = np.array([table[end, 0], table[end, 1], pivot[end]])
            at = np.flatnonzero(out)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(table[at, 0]), pa.array(table[at, 1]), pa.array(pivot[at])], names=["key", "sig", "pivot"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartition(n, "key").sortWithinPartitions("key", "sig").mapInArrow(run, "key bigint, sig bigint, pivot bigint"), "met")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def left_over(rows: DataFrame, labels: DataFrame, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Written tables of pairs (a, b) of different components to look at, and of the classes sig of crowded keys, whose own pairs aren't."""
    rows = rows.select("key", "sig").join(labels, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    rows = written(rows, "rooted")
    counts = rows.groupBy("key", "root").agg(F.count("*").alias("rows"))
    largest = counts.groupBy("key").agg(F.max_by("root", F.struct("rows", "root")).alias("main"), F.max("rows").alias("most"), F.sum("rows").alias("all"))
    open_ = written(largest.where("most < all").select("key", "main", ((F.col("all") - F.col("most")) * F.col("all") > crowd).alias("crowded")), "open")
    rows = written(rows.join(open_, "key"), "open_rows")
    crowds = written(rows.where("crowded").select("sig").distinct(), "crowded")
    few = rows.where("NOT crowded").join(crowds.select("sig", F.lit(True).alias("handed")), "sig", "left")
    few = written(few.select("key", "sig", "root", "main", F.coalesce("handed", F.lit(False)).alias("handed")), "few")
    minor = few.where("root <> main").select("key", F.col("sig").alias("x"), F.col("root").alias("own"), F.col("handed").alias("also"))
    met = minor.join(few.select("key", F.col("sig").alias("y"), "root", "handed"), "key").where("own <> root AND NOT (handed AND also)")
    return written(met.select(*_ordered("x", "y")).distinct(), "rest"), crowds


def documents_of(docs: DataFrame, marks: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Written table (doc_id, text) with a document for each of the wanted classes."""
    ids = marks.where("n > 0").groupBy("sig").agg(F.min(F.struct("mark", "doc_id")).alias("one")).join(wanted, "sig", "left_semi")
    ids = written(ids.select("one.mark", "one.doc_id"), "wanted")
    rows = docs.select(F.col(doc_id).alias("own_id"), F.xxhash64(F.col(text)).alias("own_mark"), F.col(text).alias("text"))
    found = rows.join(ids, (F.col("own_mark") == F.col("mark")) & F.col("own_id").eqNullSafe(F.col("doc_id")), "left_semi")
    return written(found.select(F.col("own_id").alias("doc_id"), "text"), "documents")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Marks (doc_id, mark, n, sig), one row per document, and labels (sig, root) of all classes that have links."""
    spark = docs.sparkSession
    with passing(spark) as keep:
        marks = keep(signed(docs, doc_id, text))
        rows = met(keys(marks))
        first = written(rows.where("sig <> pivot").select(*_ordered("sig", "pivot")).distinct(), "stars")
        with passing(spark) as keep_links:
            links = keep_links(written(near.verified(first, near.sets_of(docs, marks, near.ends_of(first), doc_id, text), PERCENT), "linked"))
        with passing(spark) as keep_rest:
            rest, crowded = left_over(rows, near.connected(links), crowd)
            rest = keep_rest(written(rest.join(first, ["a", "b"], "left_anti"), "unseen"))
            keep_rest(crowded)
        if crowded.limit(1).count():
            with passing(spark) as keep_links:
                _, exact = near.classes(documents_of(docs, marks, crowded, doc_id, text), percent=PERCENT)
                links = keep_links(written(links.union(exact.where("sig <> root").select(F.col("sig").alias("a"), F.col("root").alias("b"))), "linked"))
        links = links.union(near.verified(rest, near.sets_of(docs, marks, near.ends_of(rest), doc_id, text), PERCENT))
        labels = keep(near.connected(written(links, "all_links")))
    return marks.drop("halves"), labels


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id that links reach) and kept (doc_id is that)."""
    rows = near.rooted(*classes(docs, doc_id, text, crowd))
    return near.named(rows).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
