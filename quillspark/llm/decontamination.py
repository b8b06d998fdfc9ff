"""Benchmark decontamination with one Aho-Corasick automaton over normalised test questions and answers.

Texts are lower-cased in A-Z and cut into words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A window is WINDOW consecutive words of
an item; an item of fewer words, but not none, is one window. The automaton runs over word numbers (0 for a word of no item), so
each document is scanned once; hits come back as word positions, which map to code points of the original text.

A benchmark of more than BLOCK_BYTES of text makes an automaton for each block of items, as one of all items would outgrow a worker. Then
a first pass looks every window of the documents up in a filter of all windows' hashes (FILTER_BITS bits for each, MOST_FILTER bytes at
most, set by tasks), and only documents that pass, few but the contaminated ones, meet the automata. So the documents are read once
for those that pass and once for the others, however large the benchmark is. Where the filter's bound leaves fewer bits than wanted, more
clean documents pass and meet the automata too, which changes nothing in the result.

Null texts and ids: a null text has no words; a null item id takes part as a window source and is left out of id lists.
Empty tables: no documents give no rows, no items give clean rows. Repeated rows each get a row; ties do not arise.
Long texts are scanned whole. Extra columns are ignored by ``contamination`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from quillspark.llm.common import folded, sliced, written

WINDOW = 10
#: Items go to the executors in blocks of so many bytes of text at most; each block is one automaton.
BLOCK_BYTES = 8_000_000
FILTER_BITS = 16
#: Bytes of the filter at most, and of a slice of it that one task sets. In a filter that would have to be larger more texts pass.
MOST_FILTER, FILTER_SLICE = 128 << 20, 4 << 20

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # the same words before A-Z is folded
_FOLD = bytes(ord(chr(b).lower()) if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Normalised words, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Matcher:
    """One automaton over the windows of a block of items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        self.names = [name for name, _ in items]
        for i, (_, text) in enumerate(items):
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words_of(text))
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(ids[at : at + window], set()).add(i)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for words, own in owners.items():
            self.automaton.add_word(words, (len(words), tuple(sorted(own))))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str | None]]:
        """(first word, last word) of each occurrence of a window, and the names of the items that have any of these."""
        if self.empty or not words:
            return [], []
        ids = tuple([*map(self.number.get, words, [0] * len(words))])
        if not any(ids):
            return [], []
        spans, own = [], set()
        for end, (n, owners) in self.automaton.iter(ids):
            spans.append((end - n + 1, end))
            own.add(owners)
        return spans, [self.names[i] for i in {i for owners in own for i in owners}]


_MATCHERS: dict[str, Matcher] = {}


def _matcher(block: Broadcast, name: str, window: int) -> Matcher:
    """Built once per Python worker."""
    if name not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[name] = Matcher(block.value, window)
    return _MATCHERS[name]


def item_blocks(spark: SparkSession, items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of a checked size; a larger benchmark makes more blocks, never a larger one, but for single longer items."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = 1 if total <= block_bytes else int(total // (block_bytes // 2)) + 1
    if blocks > 1:
        rows = written(rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))), "benchmark")
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.col("block") == b).drop("block")
        yield [(r["item"], r["text"]) for r in part.toLocalIterator()]


class Filter:
    """A bit for each of many hashes of windows; what isn't set occurs in no item."""

    def __init__(self, field: np.ndarray, sizes: list[int]) -> None:
        self.field, self.bits, self.sizes = field, 8 * len(field), sizes

    def may_hit(self, words: list[bytes]) -> bool:
        for n in self.sizes:
            at = places(words, n, self.bits)
            if (self.field[at >> 3] >> (at & 7).astype(np.uint8) & 1).any():
                return True
        return False


def places(words: list[bytes], n: int, bits: int) -> np.ndarray:
    """The bits of all runs of n words."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    s = np.full(max(0, len(h) - n + 1), n, np.uint64)
    for j in range(n if len(s) else 0):
        s = (s ^ h[j : len(h) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(29)
    return (s % np.uint64(bits)).astype(np.int64)


def sieve_of(items: DataFrame, text: str, window: int, bits: int, slice_bytes: int = FILTER_SLICE) -> Filter:
    """The filter of all items' windows. Tasks hash the windows, and a task for each slice of the filter sets its bits; the driver puts
    the slices together, which have as many bytes as the filter, and so a fixed bound."""
    slices = -(-bits // (8 * slice_bytes))
    size = -(-bits // (8 * slices))  # bytes of a slice
    bits = 8 * size * slices

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0):
            own = [w for t in batch.column(0).to_pylist() if (w := words_of(t))]
            at = np.concatenate([np.zeros(0, np.int64), *[places(w, min(window, len(w)), bits) for w in own]])
            n = np.repeat(np.array([min(window, len(w)) for w in own], np.int32), [len(w) - min(window, len(w)) + 1 for w in own])
            yield pa.RecordBatch.from_arrays([pa.array((at // (8 * size)).astype(np.int32)), pa.array(at % (8 * size)), pa.array(n)], names=["slice", "at", "n"])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, which, sizes = np.zeros(size, np.uint8), None, set()
        for batch in batches:
            if batch.num_rows:
                at = batch.column(1).to_numpy()
                np.bitwise_or.at(field, at >> 3, (1 << (at & 7)).astype(np.uint8))
                which = batch.column(0)[0].as_py()
                sizes.update(batch.column(2).unique().to_pylist())
        if which is not None:
            yield pa.RecordBatch.from_arrays([pa.array([which], pa.int32()), pa.array([sorted(sizes)], pa.list_(pa.int32())), pa.array([field.tobytes()], pa.binary())], names=["slice", "sizes", "field"])

    rows = items.select(F.col(text).alias("text")).mapInArrow(hashed, "slice int, at bigint, n int")
    parts = rows.repartitionById(slices, F.col("slice")).mapInArrow(built, "slice int, sizes array<int>, field binary")
    field, sizes = np.zeros(size * slices, np.uint8), set()
    for r in parts.toLocalIterator():
        field[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["field"], np.uint8)
        sizes.update(r["sizes"])
    return Filter(field, sorted(sizes))


_SPAN = StructType([StructField(k, LongType()) for k in ("first", "last", "start", "end")])
_FOUND = StructType([StructField("n_words", LongType()), StructField("spans", ArrayType(_SPAN)), StructField("items", ArrayType(StringType()))])
_KINDS = [pa.int64(), pa.list_(pa.struct([pa.field(k, pa.int64()) for k in ("first", "last", "start", "end")])), pa.list_(pa.string())]


def _found(text: str | None, matcher: Matcher) -> tuple[int, list[dict], list[str | None]]:
    """Word count, hits merged where they touch or overlap (words, inclusive, and code points), and items."""
    words = words_of(text)
    spans, items = matcher.hits(words)
    if not spans:
        return len(words), [], []
    where = [m.span() for m in _WORD.finditer(text)]
    merged = union([(a, b + 1) for a, b in spans])
    return len(words), [{"first": a, "last": b - 1, "start": where[a][0], "end": where[b - 1][1]} for a, b in merged], items


def _with(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
    """The batch's columns but its first one, the text, with what was found in it."""
    return pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array([f[k] for f in found], _KINDS[k]) for k in range(3))], names=[*batch.schema.names[1:], *_FOUND.names])


def _scan(rows: DataFrame, sent: Broadcast, name: str, window: int) -> DataFrame:
    """What one block's automaton finds in the first column, beside the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(sent, name, window)
        for batch in sliced(batches, 0):
            yield _with(batch, [_found(t, matcher) for t in batch.column(0).to_pylist()])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[1:], *_FOUND.fields]))


def scan(rows: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, most_filter: int = MOST_FILTER) -> DataFrame:
    """n_words, spans and items of the texts in the first column, beside the other columns."""
    spark = rows.sparkSession
    blocks = item_blocks(spark, items, item_id, item_text, block_bytes)
    first, second = next(blocks), next(blocks, None)
    send = spark.sparkContext.broadcast
    if second is None:
        return _scan(rows, send(first), uuid.uuid4().hex, window)
    # A window begins with a word, which has two characters at least with what parts it from the next one.
    wanted = FILTER_BITS * (items.agg(F.sum(F.length(item_text))).first()[0] or 0) // 2
    sieve = sieve_of(items, item_text, window, max(64, min(wanted, 8 * most_filter)))
    filtered = send(sieve)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0):
            yield batch.filter(pa.array([filtered.value.may_hit(words_of(t)) for t in batch.column(0).to_pylist()], pa.bool_()))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0):
            words = [*map(words_of, batch.column(0).to_pylist())]
            clean = [not filtered.value.may_hit(w) for w in words]
            yield _with(batch.filter(pa.array(clean, pa.bool_())), [(len(w), [], []) for w, c in zip(words, clean, strict=True) if c])

    text, *rest = rows.columns
    some = written(rows.mapInArrow(passed, rows.schema).select(F.monotonically_increasing_id().alias("id"), F.struct(*rows.columns).alias("row")), "passed")
    whole = None
    for block in chain([first, second], blocks):
        found = written(_scan(some.select(F.col("row")[text].alias("text"), "id"), send(block), uuid.uuid4().hex, window), "hits")
        whole = found if whole is None else whole.unionByName(found)
    each = whole.groupBy("id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    hit = some.join(each, "id").select(*[F.col("row")[c].alias(c) for c in rest], *_FOUND.names)
    return hit.unionByName(rows.mapInArrow(others, StructType([*rows.schema.fields[1:], *_FOUND.fields])))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and char_spans, the merged hits in code points."""
    rows = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))
    found = scan(rows, items, **how)
    # Hits of several automata may overlap: they are merged in order, each from where those before it end.
    names = F.sort_array(F.array_distinct(F.filter("items", lambda i: i.isNotNull())))
    spans = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["first"].alias("first"), s["last"].alias("last"))))
    kind = "array<struct<start:bigint,end:bigint,first:bigint,last:bigint>>"
    done = F.struct(*[F.lit(2**62).alias(n) for n in ("start", "end", "first", "last")])
    none = F.struct(*[F.lit(-1).cast("long").alias(n) for n in ("start", "end", "first", "last")])

    def step(held: Column, s: Column) -> tuple[Column, Column]:
        apart = s["first"] > held["last"] + 1
        longer = F.struct(held["start"].alias("start"), F.greatest(held["end"], s["end"]).alias("end"), held["first"].alias("first"), F.greatest(held["last"], s["last"]).alias("last"))
        return F.when(apart | (held["first"] < 0), s).otherwise(longer), F.when(apart & (held["first"] >= 0), F.array(held)).otherwise(F.array().cast(kind))

    merged = F.when(F.size("spans") > 1, folded(F.concat(spans, F.array(done).cast(kind)), none, step, kind)).otherwise(spans)
    df = found.select("doc_id", "n_words", merged.alias("spans"), names.alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    chars = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return df.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), chars.alias("char_spans"))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", **how) -> DataFrame:
    """The documents, all columns as they are, without those in which a window of the benchmark occurs."""
    others = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row")
    found = scan(docs.select(F.col(text).alias("text"), others, F.col(text).alias("whole")), items, **how).where(F.size("spans") == 0)
    return found.select(*[F.col("whole").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open spans merged where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
