"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text, and rows, that Python works on at once. Spark itself bounds an Arrow batch by spark.sql.execution.arrow.maxBytesPerBatch.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 1024

#: Blanks of the word rule: a word is a run of anything else.
BLANKS = r"[\x20\x09-\x0D]+"

_PATHS = "quillspark_paths"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about SLICE_BYTES of the column, one row at least, without a copy."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(sizes[start - 1]) if start else 0
            end = int(np.searchsorted(sizes, before + SLICE_BYTES, "right"))
            end = min(max(end, start + 1), start + SLICE_ROWS, batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Where it is unset, a local session gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/quillspark-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: its files outlive executors, and later steps start from them."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.quillspark_path = path
    spark.__dict__.setdefault(_PATHS, []).append(path)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are deleted at the end, but for those that the given function was called on."""
    paths, kept = spark.__dict__.setdefault(_PATHS, []), set()
    start = len(paths)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.quillspark_path)
        return df

    try:
        yield keep
    finally:
        for path in [x for x in paths[start:] if x not in kept]:
            _remove(spark, path)
            paths.remove(path)


def discard(df: DataFrame) -> None:
    """Delete one table of ``written`` that no later step reads."""
    spark, path = df.sparkSession, df.quillspark_path
    _remove(spark, path)
    spark.__dict__[_PATHS].remove(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that the operators have written in this session; call it once their results have been used."""
    for path in spark.__dict__.pop(_PATHS, []):
        _remove(spark, path)


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The given columns beside the whole row as one struct named row, so that no name of the caller's can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def unpacked(df: DataFrame, docs: DataFrame, **replaced: Column) -> DataFrame:
    """The rows of ``packed`` as they were, with some columns replaced."""
    return df.select(*[replaced[c].alias(c) if c in replaced else F.col("row")[c].alias(c) for c in docs.columns])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_array(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` in order; an empty array for none."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def folded(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """Entries that a fold over the items gives out: ``step`` maps the state and an item to the next state and an array of type ``kind``.

    An array that grows within a fold is copied at each step. The items are therefore folded in blocks of about the root of their
    number, so that long arrays cost n * sqrt(n) copies of a few bytes rather than n * n.
    """
    none = F.array().cast(kind)

    def one(s: Column, x: Column) -> Column:
        state, out = step(s["state"], x)
        return F.struct(state.alias("state"), F.concat(s["out"], out).alias("out"))

    def block(s: Column, b: Column) -> Column:
        return bound(F.aggregate(b, F.struct(s["state"].alias("state"), none.alias("out")), one), lambda inner: F.struct(inner["state"].alias("state"), F.concat(s["out"], inner["out"]).alias("out")))

    def whole(items: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(items).cast("double"))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(items), width), lambda at: F.slice(items, at, width))
        return F.when(F.size(items) > 0, F.aggregate(blocks, F.struct(start.alias("state"), none.alias("out")), block, lambda s: s["out"])).otherwise(none)

    return bound(items, whole)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
