"""Faceted filters, all-terms search, facet counts, excerpts and reproducible samples."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import fold, let
from quillspark.operators.statistics import at_place


@dataclass(frozen=True)
class FilterSpec:
    """Columns with their allowed values (none: any), array columns with values of which one must be there, and terms that must all occur."""

    any_of: dict[str, list[str]] = field(default_factory=dict)
    terms: str = ""
    overlap: dict[str, list[str]] = field(default_factory=dict)
    kind: str = "all"
    flagged: bool = False
    seed: int | None = None


def all_terms(folded: Column, query: str) -> Column:
    """Every blank-separated term of the query, folded, is a substring."""
    terms = [fold(F.lit(t)) for t in query.split()]
    return reduce(Column.__and__, [F.contains(folded, t) for t in terms], F.lit(True))


def apply(df: DataFrame, spec: FilterSpec, folded: Column) -> DataFrame:
    for column, values in spec.any_of.items():
        if values:
            df = df.where(F.col(column).isin(*values))
    return df.where(all_terms(folded, spec.terms))


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by value of each column, in one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def excerpt(text: Column, boilerplate: str) -> Column:
    """The first sentence over 60 characters without boilerplate, else the first; cut at a word after 237 characters."""

    def choose(found: Column) -> Column:
        good = F.filter(found, lambda s: (F.length(F.trim(s)) > 60) & ~F.contains(F.lower(s), F.lit(boilerplate)))
        return F.coalesce(F.get(good, F.lit(0)), F.get(found, F.lit(0)), F.lit(""))

    def cut(s: Column) -> Column:
        return F.when(F.length(s) > 240, F.concat(F.regexp_replace(F.left(s, F.lit(237)), r"\s\S*$", ""), F.lit("…"))).otherwise(s)

    return let(F.trim(F.regexp_replace(let(F.regexp_extract_all(text, F.lit(r"(?:^|(?<=[.!?]))[^.!?]++[.!?]"), F.lit(0)), choose), r"\s+", " ")), cut)


def sample(df: DataFrame, key: str, seed: int, n: int, first: Column | None = None) -> DataFrame:
    """n rows in a shuffled order that depends on the seed and the key alone; rows where ``first`` holds come before others."""
    order = [F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), F.col(key)]
    return df.orderBy(*([F.desc(first.cast("int"))] if first is not None else []), *order).limit(n)


def daily(df: DataFrame, key: str, day: int) -> DataFrame:
    """The rows whose numeric key is at place (day * 7919) mod n in the order of the keys, found by counting ranges of keys."""
    found = at_place(df.select(F.lit(0).alias("all"), key), "all", key, F.pmod(F.lit(day * 7919), F.col("n")))
    return df.join(found.select(F.col(key).cast(df.schema[key].dataType).alias("found")), F.col(key) == F.col("found"), "left_semi")


def filtered(df: DataFrame, spec: FilterSpec, folded: Column, key: str, flags: DataFrame | None = None) -> DataFrame:
    """Rows that pass every facet of the filter: kind, values, overlap of topics, flags (rows of ``flags`` by key), and all terms.

    Rows are never annulled. With a seed they are put in a shuffled order that depends on it and the key alone.
    """
    out = df.where(~F.coalesce(F.col("annulled"), F.lit(False)))
    if spec.kind != "all":
        out = out.where(F.col("kind") == spec.kind)
    for column, values in spec.overlap.items():
        if values:
            out = out.where(F.arrays_overlap(column, F.array(*map(F.lit, values))))
    if spec.flagged and flags is not None:
        out = out.join(flags.select(key), key, "left_semi")
    out = apply(out, spec, folded)
    return out if spec.seed is None else out.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{spec.seed}"))), key)


def facet_table(rows: DataFrame, dimensions: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The dimensions (facet, value, label, ord, shown) with n: how many rows have the value, in one pass over the rows.

    ``columns`` names each facet's column; an array counts once for each of its distinct values. A value that no row has stays with 0 where
    it is ``shown``, and is left out elsewhere. Counts don't depend on what a filter has chosen among the facets.
    """

    def pairs(facet: str, column: str) -> Column:
        values = F.col(column) if rows.schema[column].dataType.typeName() == "array" else F.array(column)
        return F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(facet).alias("facet"), v.cast("string").alias("value")))

    counts = rows.select(F.explode(F.concat(*[pairs(*x) for x in columns.items()])).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))
    met = dimensions.join(counts, ["facet", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return met.where("n > 0 OR shown").drop("shown")


GRAM = 3


#: Code points of texts that make a segment of postings, at least; one text is never parted.
SEGMENT = 1 << 21


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (gram, keys) of batches of (key, folded): for each segment of texts its runs in order, each with the keys of its texts."""
    for batch in batches:
        texts, kind, begin, size = batch.column(1).to_pylist(), batch.schema.field(0).type, 0, 0
        for k, text in enumerate(texts):
            size += len(text or "")
            if size >= SEGMENT or k + 1 == len(texts):
                gram, ends, of = _postings(texts[begin : k + 1])
                keys = batch.column(0).slice(begin, k + 1 - begin).take(pa.array(of))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys)
                yield pa.RecordBatch.from_arrays([pa.array(gram, pa.string()), lists.cast(pa.list_(kind))], names=["gram", "keys"])
                begin, size = k + 1, 0


def _postings(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct runs of GRAM characters, where each one's places end (from 0 on), and the places of the texts that have it."""
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le"), np.uint32)
    of = np.repeat(np.arange(len(texts)), [len(t or "") for t in texts])
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    letters = np.flatnonzero(seen)  # numbered, so that a run and its text fit into one number
    number = np.zeros(0x110000, np.int64)
    number[letters] = np.arange(len(letters))
    points, n = number[points], max(len(points) - GRAM + 1, 0)
    code = np.zeros(n, np.int64)
    for j in range(GRAM):
        code = code * max(len(letters), 1) + points[j : j + n]
    whole = of[:n] == of[GRAM - 1 : GRAM - 1 + n]
    runs, code = np.unique(code[whole], return_inverse=True)
    met = np.unique(code * len(texts) + of[:n][whole])
    run, text = np.divmod(met, max(len(texts), 1))
    ends = np.searchsorted(run, np.arange(len(runs) + 1))
    parts = [letters[runs // max(len(letters), 1) ** (GRAM - 1 - j) % max(len(letters), 1)] for j in range(GRAM)]
    return ["".join(map(chr, p)) for p in zip(*(p.tolist() for p in parts), strict=True)], ends, text


def build_index(df: DataFrame, key: str, text: str, path: str) -> None:
    """Write a search index below ``path``: the folded texts by key, and for each run of GRAM characters the keys of the texts that have it.

    Each task writes postings of its own texts, segment by segment, so that nothing is shuffled and a run's keys are put together for one
    segment at a time. Runs are sorted within a segment, so that a search skips pages of other runs.
    """
    spark = df.sparkSession
    df.select(F.col(key).alias("key"), fold(F.col(text)).alias("folded")).write.mode("overwrite").parquet(f"{path}/texts")
    texts = spark.read.parquet(f"{path}/texts")
    postings = texts.select("key", "folded").mapInArrow(_segments, f"gram string, keys array<{texts.schema['key'].dataType.simpleString()}>")
    postings.write.mode("overwrite").parquet(f"{path}/postings")


def search_index(spark: SparkSession, path: str, query: str) -> DataFrame:
    """key and folded of the texts that hold every term of the query as a substring.

    Texts that lack any run of the terms' characters aren't read for the terms. Terms shorter than a run are looked for in what is left.
    """
    texts = spark.read.parquet(f"{path}/texts")
    terms = [r["t"] for r in spark.createDataFrame([(t,) for t in query.split()], "t string").select(fold(F.col("t")).alias("t")).collect()]
    wanted = sorted({t[i : i + GRAM] for t in terms for i in range(len(t) - GRAM + 1)})
    if wanted:
        have = spark.read.parquet(f"{path}/postings").where(F.col("gram").isin(*wanted)).select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
        texts = texts.join(have.where(F.col("n") == len(wanted)).select("key"), "key", "left_semi")
    return texts.where(reduce(Column.__and__, [F.contains("folded", F.lit(t)) for t in terms], F.lit(True)))
