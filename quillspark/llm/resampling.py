"""Importance resampling towards a target distribution: hashed n-gram weights from arrays, then a distributed LSD radix sort for the ranks.

A document's features are its runs of 1 to ``longest`` words, each counted in a bucket by its CRC-32. Two passes over the text: the
first adds up the buckets' counts of the corpus (and of the target texts), the second adds each document's gains, looked up in one array
of ``buckets`` whole numbers, which is all that the driver and the executors hold of the corpus. A document's score is its weight plus
Gumbel noise from a hash of its id, so that the highest scores are a draw without replacement by weight.

Ranks. Scores and ids form a composite key, which is cut into digits of DIGIT_BITS bits. For each digit, from the least significant, a
stable counting-sort pass follows: rows lie in blocks of equal size in the order so far; a task goes once through its block and counts
each digit's rows, which gives a row's rank among its block's rows of that digit; the counts' prefix sums over (digit, block) give where
those rows start in the whole; start plus rank is the row's place, and place / block size the block that it moves to. So blocks stay
equal whatever the keys are, no task holds more than a block's stream and one counter a digit, and the last pass' places are the ranks.
Each pass starts from a written table, so a lost executor costs a part of one pass.

Nulls: null text has no words; a null id is hashed as the word null and comes last among ties. Rows of equal score and id keep an order
fixed by their place in the input. Without eligible documents nothing is drawn, without target texts the target counts are zero. An
empty table gives an empty result. Texts are read whole. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import passing, sliced, written

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Bits of a digit: a pass keeps 2**DIGIT_BITS counters a task and collects as many totals.
DIGIT_BITS = 12
#: Rows of a block at most; there are as many blocks as shuffle partitions at least.
BLOCK_ROWS = 1 << 20

#: Bytes of words (digits, lower-case letters, all beyond ASCII) stay, A-Z are lowered, the rest are blanks.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def features(text: bytes | None, longest: int) -> tuple[list[int], int]:
    """CRC-32 of each run of 1 to ``longest`` words, and the number of words."""
    words = (text or b"").translate(_WORD).split()
    found = [*map(crc32, words)]
    for k in range(2, longest + 1):
        found += map(crc32, map(b" ".join, zip(*[words[i:] for i in range(k)], strict=False)))
    return found, len(words)


def bucket_counts(texts: DataFrame, text: str, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features fall into each bucket: tasks send their own sums, which Spark adds up by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in sliced(batches, 0):
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                own = np.array(features(t, longest)[0], np.int64)
                if len(own):
                    total += np.bincount(own % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    sums = texts.select(F.col(text).alias("text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # one row a bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The buckets' log ratios of smoothed target and source shares, in thousandths, rounded down."""
    n = len(source)
    all_s, all_t = float(source.sum() + n), float(target.sum() + n)
    return np.array([floor(1000 * log(float(t + 1) * all_s / (float(s + 1) * all_t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_features, weight, score."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in sliced(batches, 1):
            words, sizes, weights = [], [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                own, n = features(t, longest)
                words.append(n)
                sizes.append(len(own))
                weights.append(int(gain[np.array(own, np.int64) % len(gain)].sum()) if own else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, sizes, weights))], names=["doc_id", "n_words", "n_features", "weight"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")
    return found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def _digits(rows: DataFrame, keys: Sequence[tuple[str, bool]], bits: int) -> list[tuple[int, int, bool, int | None]]:
    """The passes, least significant first: number of the key, its base, whether it descends, and the shift (none: a null or not)."""
    found = rows.agg(*[f(name).alias(f"{kind}_{i}") for i, (name, _) in enumerate(keys) for kind, f in (("low", F.min), ("high", F.max), ("nulls", lambda n: F.count_if(F.col(n).isNull())))]).first()
    out = []
    for i in reversed(range(len(keys))):
        low, high, down = found[f"low_{i}"], found[f"high_{i}"], keys[i][1]
        if low is not None:
            out += [(i, high if down else low, down, shift) for shift in range(0, (high - low).bit_length(), bits)]
            out += [(i, 0, False, None)] * (found[f"nulls_{i}"] > 0)
    return out


def _digit(values: pa.Array, bits: int, base: int, down: bool, shift: int | None) -> np.ndarray:
    if shift is None:
        return values.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
    own = values.fill_null(base).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    base = np.array([base], np.int64).view(np.uint64)
    off = base - own if down else own - base  # modulo 2**64
    return (off >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _counting(bits: int, key: int, base: int, down: bool, shift: int | None):
    """A task's part of a pass: each row's digit, and its rank among the block's rows of that digit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            digit = _digit(batch.column(key), bits, base, down, shift)
            order = np.argsort(digit, kind="stable")
            own = np.bincount(digit, minlength=len(counts))
            first = np.cumsum(own) - own
            rank = np.empty(len(digit), np.int64)
            rank[order] = np.arange(len(digit)) - first[digit[order]] + counts[digit[order]]
            counts += own
            keep = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(digit.astype(np.int32)), pa.array(rank)], names=[*keep, "digit", "rank"])

    return run


def radix_places(rows: DataFrame, keys: Sequence[tuple[str, bool]], bits: int = DIGIT_BITS) -> DataFrame:
    """The rows of a written table with ``place``, from 0 without gaps in the order of the long columns ``keys`` (name, descending), nulls last.

    Rows of equal keys keep an order that the table's own row numbers fix.
    """
    spark = rows.sparkSession
    names = [k for k, _ in keys]
    rest = [c for c in rows.columns if c not in names]
    n = rows.count()
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BLOCK_ROWS))
    size = max(1, -(-n // blocks))
    with passing(spark) as keep:
        numbered = written(rows.select(*names, *rest, F.monotonically_increasing_id().alias("place")), "numbered")
        placed = numbered.withColumn("block", F.pmod(F.xxhash64("place"), F.lit(blocks)).cast("int"))
        digits = _digits(numbered, keys, bits) or [(0, 0, False, None)]
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema.fields[:-1])
        for digit in digits:
            dealt = placed.select(*names, *rest, "block", "place").repartitionById(blocks, F.col("block")).sortWithinPartitions("place")
            counted = written(dealt.mapInArrow(_counting(bits, *digit), f"{kinds}, block int, digit int, rank bigint"), "counted")
            counts = counted.groupBy("digit", "block").agg(F.count("*").alias("n"))
            bases, base = [], 0
            for r in counts.groupBy("digit").agg(F.sum("n").alias("n")).orderBy("digit").collect():  # one row a digit at most
                bases.append((r["digit"], base))
                base += r["n"]
            if not bases:
                return keep(counted).select(*rows.columns, F.lit(0).cast("long").alias("place"))
            before = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
            starts = counts.select("digit", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
            starts = starts.join(F.broadcast(spark.createDataFrame(bases, "digit int, base bigint")), "digit").select("digit", "block", (F.col("base") + F.col("earlier")).alias("start"))
            placed = counted.join(starts, ["digit", "block"]).withColumn("place", F.col("start") + F.col("rank"))
            placed = placed.select(*names, *rest, "place", F.floor(F.col("place") / F.lit(size)).cast("int").alias("block"))
        keep(counted)
        return placed.select(*rows.columns, "place")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    seed: int = SEED,
    doc_id: str = "doc_id",
    text: str = "text",
    bits: int = DIGIT_BITS,
) -> DataFrame:
    """Per document: doc_id (a whole number), n_features, weight, score and rank; rank counts from 1 among the drawn ``percent`` of the
    documents with ``least_words`` words or more, and is null for the others."""
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, text, buckets, longest))
    with passing(spark) as keep:
        rows = keep(written(scored(docs, gain, longest, seed, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("long")), "scored"))
        open_ = F.col("n_words") >= least_words
        n = rows.where(open_).count() * percent // 100
        placed = radix_places(rows.where(open_).drop("n_words"), [("score", True), ("doc_id", False)], bits)
        out = ["doc_id", "n_features", "weight", "score"]
        ranked = placed.select(*out, F.when(F.col("place") < n, F.col("place") + 1).alias("rank"))
        ranked = keep(written(ranked, "ranked"))
    return ranked.unionByName(rows.where(~open_).select(*out, F.lit(None).cast("long").alias("rank")))
