"""Mixture-controlled packing: deficit round-robin over source queues fills every window to target token proportions.

A document becomes its token ids and an end id. The documents of a source form a queue, in the order of the input's parts. A window
is one sequence. Each window owes each queue its share of the tokens; what a window can't give in whole tokens stays as the queue's
deficit, below one token, and is paid in later windows: after w windows a queue has had the whole tokens of its share of all tokens
so far, and the tokens left over go to the queues with the largest deficits. So the state after any number of windows follows from
the queues' totals alone, in exact integer arithmetic: every task finds the windows of its own documents, deficits carry across
windows and partitions, and no task walks the schedule from its start. When a queue with more than its natural share runs dry,
a new phase deals the rest by the weights of the others.

Sequences are full but for the last one. A source with less than 1/MAX_QUEUES of all tokens shares one queue with the others of that
kind, as its share would be a few tokens a window. That queue is in order of how far each document lies in its own source (turned by a
hash of the source, so that sources of one document spread out too): so every stretch of it holds its sources in their proportions.
A source to which a mixture gives a weight has a queue of its own whatever its size, and its exact weight; sources without one come when
those have run dry.

Null text: only the end id. Null source: a source of its own. Null or repeated ids: each row is packed. An empty table gives an
empty result. Texts are encoded whole. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import sliced, written

LENGTH = 2048
END_ID = 1
#: Sources with at least 1/MAX_QUEUES of all tokens have their own queue, so that there are as many at most.
MAX_QUEUES = 256
#: Words whose ids a Python worker remembers.
CACHE_WORDS = 500_000
#: Windows whose shares are computed together.
BLOCK = 256
#: Rows of the shared queue that are summed up in one group, about.
STRETCH_ROWS = 50_000


#: The text rules of a tokenizer under which words can be encoded apart: fixed values of its file.
LOWER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}

#: Words of letters, digits and marks on which lower case and the split are plain; no apostrophe and no special token.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!\"#$%&()*+,\-./:;=?@\[\\\]^`{}~]+")
_PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class _Memory(dict):
    """A dict that computes what it lacks."""

    def __init__(self, compute) -> None:
        super().__init__()
        self.compute = compute

    def __missing__(self, key: str) -> bytes:
        found = self[key] = self.compute(key)
        return found


class Encoder:
    """Token ids by words. Where the tokenizer's rules are those above, no token spans a blank, so that a text's ids are those of its
    blank-separated pieces, and those of a plain piece are those of its runs of letters, single digits and runs of marks."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        self.apart = rules["normalizer"] == LOWER and rules["pre_tokenizer"].get("pretokenizers", [None])[0] == SPLIT and rules["post_processor"] is None
        self.code = "H" if self.tokenizer.get_vocab_size() <= 65536 else "I"
        self.kind = np.dtype(self.code).newbyteorder("<")
        self.model = self.tokenizer.model
        bytes_of = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = dict(zip([b for b in range(256) if b not in bytes_of], range(256, 512)))  # the byte alphabet's stand-ins
        self.parts, self.words = _Memory(self._part), _Memory(self._word)

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _part(self, part: str) -> bytes:
        return self._packed([t.id for t in self.model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(self.letters))])

    def _word(self, word: str) -> bytes:
        stem = word[:-1] if word[-1:] in (".", ",") else word
        if stem.isalpha() and max(stem) <= "ÿ":  # the common case of the next one
            found = self.parts[stem.lower()]
            return found if stem is word else found + self.parts[word[-1]]
        if _PLAIN.fullmatch(word):
            return b"".join([self.parts[x] for x in _PARTS.findall(word.lower())])
        return self._packed(self.tokenizer.encode(word, add_special_tokens=False).ids) if word else b""

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.apart:
            return [self._packed(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        for memory in (self.words, self.parts):
            if len(memory) > CACHE_WORDS:
                memory.clear()
        get = self.words.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) for t in texts]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(docs: DataFrame, tokenizer: str, doc_id: str, text: str, source: str, end_id: int) -> DataFrame:
    """Per row: part, doc_id, source, n, before (tokens of the same source earlier in the part) and ids, as a written table."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, so_far = encoder(tokenizer), {}
        part = TaskContext.get().partitionId()
        end = np.array([end_id], encode.kind).tobytes()
        for batch in sliced(batches, 2):
            ids = [x + end for x in encode([t or "" for t in batch.column(2).to_pylist()])]
            counts = [len(x) // encode.kind.itemsize for x in ids]
            before = []
            for s, n in zip(batch.column(1).to_pylist(), counts, strict=True):
                before.append(so_far.get(s, 0))
                so_far[s] = before[-1] + n
            columns = [pa.array([part] * len(ids), pa.int64()), batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(before, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "source", "n", "before", "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return written(rows.mapInArrow(run, f"part bigint, doc_id {kind}, source string, n bigint, before bigint, ids binary"), "encoded")


class Schedule:
    """Which tokens of each queue lie in which window."""

    def __init__(self, totals: list[int], weights: list[float] | None = None, length: int = LENGTH) -> None:
        self.length, self.totals = length, totals
        left = [*totals]
        share = [Fraction(max(w, 0.0)) for w in weights] if weights else [Fraction(t) for t in totals]
        #: (tokens before, tokens of each queue before, tokens of each queue)
        self.phases: list[tuple[int, list[int], list[int]]] = []
        start, done = 0, [0] * len(totals)
        while any(left):
            active = [q for q, x in enumerate(left) if x and share[q]] or [q for q, x in enumerate(left) if x]
            rate = {q: share[q] or Fraction(left[q]) for q in active}
            time = min(Fraction(left[q]) / rate[q] for q in active)
            take = [min(left[q], int(time * rate[q])) if q in rate else 0 for q in range(len(left))]
            self.phases.append((start, [*done], take))
            start += sum(take)
            done = [a + b for a, b in zip(done, take, strict=True)]
            left = [a - b for a, b in zip(left, take, strict=True)]
        self.total = start
        self.windows = -(-start // length)
        self.blocks: dict[int, np.ndarray] = {}

    def _block(self, k: int) -> np.ndarray:
        """Tokens of each queue before windows k * BLOCK .. k * BLOCK + BLOCK, in two dimensions."""
        if k not in self.blocks:
            if len(self.blocks) >= 512:
                self.blocks.clear()
            out = np.zeros((BLOCK + 1, len(self.totals)), np.int64)
            for start, _, take in self.phases:
                total = sum(take)
                levels = [min(max(w * self.length - start, 0), total) for w in range(k * BLOCK, k * BLOCK + BLOCK + 1)]
                base = [divmod(levels[0] * t, total) for t in take]
                # Products of tokens and totals leave 64 bits for very large corpora: exact integers of any size there.
                kind = np.int64 if total * (levels[-1] - levels[0] + 1) < 2**62 else object
                more = np.array([x - levels[0] for x in levels], kind)[:, None]
                scaled = np.array([r for _, r in base], kind)[None, :] + more * np.array(take, kind)[None, :]
                whole, deficit = scaled // total, scaled % total
                whole = whole.astype(np.int64) + np.array([f for f, _ in base], np.int64)[None, :]
                over = np.array(levels, np.int64) - whole.sum(axis=1)
                rank = np.argsort(np.argsort(-deficit, axis=1, kind="stable"), axis=1, kind="stable")
                out += whole + (rank < over[:, None])
            self.blocks[k] = out
        return self.blocks[k]

    def before(self, first: int, last: int) -> np.ndarray:
        """Tokens of each queue before windows first .. last + 1."""
        parts = [self._block(k)[(first - k * BLOCK if k == first // BLOCK else 0) : BLOCK] for k in range(first // BLOCK, (last + 1) // BLOCK + 1)]
        return np.concatenate(parts)[: last + 2 - first]

    def _window(self, queue: int, token: int) -> int:
        """The window of a token of a queue, two off at most."""
        for start, done, take in self.phases:
            if done[queue] <= token < done[queue] + take[queue]:
                return (start + (token - done[queue]) * sum(take) // take[queue]) // self.length
        raise IndexError(token)

    def pieces(self, queue: int, token: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges of the pieces of tokens [token, token + n), with their windows and offsets there."""
        low = max(0, self._window(queue, token) - 2)
        high = min(self.windows - 1, self._window(queue, token + n - 1) + 2)
        table = self.before(low, high)
        own = table[:, queue]
        a = int(np.searchsorted(own, token, "right")) - 1
        b = int(np.searchsorted(own, token + n, "left"))
        cuts = own[a : b + 1].copy()
        cuts[0], cuts[-1] = token, token + n
        used = np.flatnonzero(np.diff(cuts))
        at = a + used
        lower = (table[at + 1, :queue] - table[at, :queue]).sum(axis=1)
        return np.append(cuts[used], token + n), low + at, lower + cuts[used] - own[at]


def queues_of(rows: DataFrame, length: int, mixture: dict[str, float] | None) -> tuple[list[str | None], list[int], list[float] | None]:
    """Names of the sources with a queue of their own, then the totals of all queues, the shared one last, and their weights."""
    totals = rows.groupBy("source").agg(F.sum("n").alias("n"))
    whole = totals.agg(F.sum("n").alias("n")).first()["n"] or 0
    if not whole:
        return [], [], None
    wanted = {s: float(w) for s, w in (mixture or {}).items() if w > 0}
    own = F.col("n") * MAX_QUEUES >= whole
    if wanted:  # each has a weight of its own to keep
        own = own | F.col("source").isin(*[s for s in wanted if s is not None]) | (F.col("source").isNull() & F.lit(None in wanted))
    large = [(r["source"], r["n"]) for r in totals.where(own).collect()]
    large.sort(key=lambda x: (x[0] not in wanted, -x[1], x[0] is None, x[0] or ""))
    rest = whole - sum(n for _, n in large)
    while rest and large and large[-1][0] not in wanted and rest * length < whole:
        rest += large.pop()[1]
    names, sizes = [s for s, _ in large], [n for _, n in large] + [rest] * (rest > 0)
    return names, sizes, [wanted.get(s, 0.0) for s in names] + [0.0] * (rest > 0) if wanted else None


def queued(rows: DataFrame, names: list[str | None], shared: bool) -> DataFrame:
    """doc_id, source, queue, token (where the document starts in its queue), n and ids."""
    queue = F.lit(len(names))
    for k, name in enumerate(names):
        queue = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(k)).otherwise(queue)
    sums = rows.groupBy("part", "source").agg(F.sum("n").alias("n"))
    # A group of the window holds one row for each part of the input.
    parts = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("part").alias("of_part"), F.col("source").alias("of"), queue.alias("queue"), F.coalesce(F.sum("n").over(parts), F.lit(0)).alias("base"), "n")
    totals = sums.groupBy(F.col("of").alias("of_total")).agg(F.sum("n").alias("total"))
    sums = sums.join(totals, F.col("of").eqNullSafe(F.col("of_total"))) if shared else sums.withColumn("total", F.lit(None).cast("long"))
    sums = written(sums.select("of_part", "of", "queue", "base", "total"), "queues")
    placed = rows.join(sums, (F.col("part") == F.col("of_part")) & F.col("source").eqNullSafe(F.col("of")))
    placed = placed.select("part", "doc_id", "source", "queue", (F.col("base") + F.col("before")).alias("token"), "n", "ids", "total")
    out = ["doc_id", "source", "queue", "token", "n", "ids"]
    if not shared:
        return placed.select(out)
    # Stretches of the shared queue, each of about as many tokens of every source.
    small = placed.where(F.col("queue") == len(names))
    turn = F.shiftrightunsigned(F.xxhash64("source"), 11) * F.lit(2.0**-53)
    small = small.withColumn("far", (F.col("token") + F.col("n") / 2) / F.col("total") + turn).withColumn("far", F.col("far") - F.floor("far"))
    stretches = max(1, -(-rows.count() // STRETCH_ROWS))
    small = written(small.withColumn("stretch", F.floor(F.col("far") * stretches)), "small")
    inside = Window.partitionBy("stretch").orderBy("far", "source", "part", "token").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    bases = small.groupBy("stretch").agg(F.sum("n").alias("n")).select(F.col("stretch").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row for each stretch
    small = small.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(bases, F.col("stretch") == F.col("of"))
    return placed.where(F.col("queue") < len(names)).select(out).unionByName(small.withColumn("token", F.col("base") + F.col("inside")).select(out))


def pack(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", length: int = LENGTH, end_id: int = END_ID, mixture: dict[str, float] | None = None, with_ids: bool = True) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and, if wanted, source and ids (unsigned 32-bit).

    The documents are encoded once, into a table in the shared folder; queue positions are sums over its parts, so that the ids never
    go through a shuffle while the sums of parts and sources are small, and are joined by part and source where they aren't. Documents
    of the shared queue are sorted by stretches of it.
    ``mixture`` maps sources to weights; without it the corpus' own proportions hold throughout.
    """
    rows = encoded(docs, tokenizer, doc_id, text, source, end_id)
    names, sizes, weights = queues_of(rows, length, mixture)
    placed = queued(rows, names, len(sizes) > len(names))
    kind = placed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Schedule(sizes, weights, length)
        for batch in batches:
            rows_of, starts, counts, crcs, tokens, windows, offsets, bodies = [], [], [], [], [], [], [], []
            columns = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
            for i, (q, token, n, ids) in enumerate(zip(*columns, strict=True)):
                edges, where, offset = plan.pieces(q, token, n)
                body = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4").tobytes()
                marks = ((edges - token) * 4).tolist()
                pieces = [body[a:b] for a, b in zip(marks, marks[1:])]
                crcs += map(zlib.crc32, pieces)
                if with_ids:
                    bodies += pieces
                rows_of.append(np.full(len(where), i, np.int64))
                starts.append(edges[:-1] - token)
                counts.append(np.diff(edges))
                tokens.append(np.full(len(where), n, np.int64))
                windows.append(where)
                offsets.append(offset)
            if not rows_of:
                continue
            take = pa.array(np.concatenate(rows_of))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), pa.array(np.concatenate(starts)), pa.array(np.concatenate(counts)), pa.array(crcs, pa.int64()), pa.array(np.concatenate(tokens)), pa.array(np.concatenate(windows)), pa.array(np.concatenate(offsets)), *([batch.column(1).take(take), pa.array(bodies, pa.binary())] if with_ids else [])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["source", "ids"] if with_ids else [])],
            )

    return placed.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", source string, ids binary" * with_ids)
