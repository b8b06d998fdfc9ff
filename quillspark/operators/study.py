"""The attempt log: latest attempts, accuracy, progress, mock exams. Aggregates with structs in place of windows where one row wins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import let, percent


def latest(attempts: DataFrame, *keys: str) -> DataFrame:
    """The last attempt of each key by (at, seq); partial aggregation keeps one row per key before the shuffle."""
    rest = [c for c in attempts.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct("at", "seq")).alias("best")
    return attempts.groupBy(*keys).agg(best).select(*keys, *[F.col(f"best.{c}").alias(c) for c in rest])


def status(ok: Column, answered: Column) -> Column:
    """new without an attempt, else by the last one: right, wrong, or answered where it can't be told."""
    return F.when(~answered, "new").when(ok.isNull(), "answered").when(ok, "right").otherwise("wrong")


def user_stats(attempts: DataFrame) -> DataFrame:
    """Answered and right by the last attempt of each question, and distinct study days (UTC) over all attempts."""
    days = attempts.groupBy("user").agg(F.countDistinct(F.to_date("at")).alias("days"))
    last = latest(attempts, "user", "question")
    sums = last.where(F.col("ok").isNotNull()).groupBy("user").agg(F.count("*").alias("answered"), F.count_if("ok").alias("right"))
    return days.join(sums, "user", "left").select("user", F.coalesce("answered", F.lit(0)).alias("answered"), F.coalesce("right", F.lit(0)).alias("right"), "days")


def accuracy(last: DataFrame, by: str, least: int = 1) -> DataFrame:
    out = last.where(F.col("ok").isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.count_if("ok").alias("right")).where(F.col("n") >= least)
    return out.withColumn("pct", percent(F.col("right"), F.col("n"), 0))


def weakest(accuracies: DataFrame, by: str) -> DataFrame:
    """The row with the least ratio, ties by name."""
    return accuracies.orderBy(F.col("right") / F.col("n"), by).limit(1)


def progress(groups: DataFrame, last: DataFrame, by: str) -> DataFrame:
    """Per group how many questions there are, are done, and are right."""
    seen = last.groupBy(by).agg(F.count("*").alias("done"), F.count_if("ok").alias("right"))
    out = groups.join(seen, by, "left")
    return out.select(by, "total", F.coalesce("done", F.lit(0)).alias("done"), F.coalesce("right", F.lit(0)).alias("right"))


def gap_runs(events: DataFrame, by: str, at: str, seconds: int) -> DataFrame:
    """Runs of rows with less than ``seconds`` between neighbours: number, start, end and size."""
    w = Window.partitionBy(by).orderBy(at)
    now = F.col(at).cast("timestamp").cast("long")
    new = F.coalesce((now - F.lag(now).over(w) >= seconds).cast("int"), F.lit(1))
    rows = events.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return rows.groupBy(by, "run").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"))


def marker_segments(events: DataFrame, by: str, order: list[str], opens: Column, stops: Column) -> DataFrame:
    """Rows inside blocks: an opening row starts one, a stopping row closes it, rows outside are dropped; with the block's number."""
    w = Window.partitionBy(by).orderBy(*order)
    mark = F.when(opens, F.lit(1)).when(stops, F.lit(0))
    rows = events.withColumn("block", F.count(F.when(opens, 1)).over(w)).withColumn("open", F.last(mark, ignorenulls=True).over(w))
    return rows.where(F.col("open") == 1).drop("open")


def last_before(events: DataFrame, by: str, order: list[str], header: Column, value: str) -> DataFrame:
    """Each row with the value of the last header row at or before it."""
    w = Window.partitionBy(by).orderBy(*order)
    return events.withColumn("header", F.last(F.when(header, F.col(value)), ignorenulls=True).over(w))


def fill_sequence(rows: DataFrame, by: str, order: list[str], number: str) -> DataFrame:
    """Numbers where there are some, else a running count of the rows without one."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("filled", F.coalesce(F.col(number), F.count(F.when(F.col(number).isNull(), 1)).over(w)))


def _runs(array: Column) -> Column:
    """Runs of positive values in an array as (first, last): where they begin and where they end, in order."""

    def ends(on: Column) -> Column:
        places = lambda by: F.filter(F.transform(on, lambda x, i: F.when(x & ~F.coalesce(F.get(on, i + by), F.lit(False)), i)), lambda i: i.isNotNull())
        firsts = F.filter(F.transform(on, lambda x, i: F.when(x & ((i == 0) | ~F.get(on, F.greatest(i - 1, F.lit(0)))), i)), lambda i: i.isNotNull())
        return let(places(1), lambda lasts: F.transform(firsts, lambda first, k: F.struct(first.alias("first"), F.get(lasts, k).alias("last"))))

    return let(F.transform(array, lambda x: F.coalesce(x > 0, F.lit(False))), ends)


def islands(array: Column, tiny: int) -> Column:
    """Runs of positive values in an array as (first, last), without runs shorter than ``tiny`` at either end.

    The ends are trimmed until a run is long enough.
    """

    def trimmed(runs: Column) -> Column:
        long = F.transform(F.filter(F.transform(runs, lambda r, i: F.struct(i.alias("i"), (r["last"] - r["first"] + 1 >= tiny).alias("ok"))), lambda x: x["ok"]), lambda x: x["i"])
        return F.when(F.size(long) == 0, F.array().cast("array<struct<first:int,last:int>>")).otherwise(F.slice(runs, F.array_min(long) + 1, F.array_max(long) - F.array_min(long) + 1))

    return let(_runs(array), trimmed)


def content_range(array: Column, tiny: int, apart: int) -> Column:
    """(first, last) place of the content: runs of positive values, but for small ones far from the rest at either end; (-1, -1) for none.

    A run is small if it ends less than ``tiny`` behind its start, and far if more than ``apart`` lies between it and its neighbour. The end
    is trimmed first; one run always stays.
    """

    def kept(runs: Column, last: Column) -> Column:
        small = lambda r: r["last"] - r["first"] < tiny
        stays = F.transform(runs, lambda r, i: (i >= last) | ~small(r) | (F.get(runs, i + 1)["first"] - r["last"] <= apart))
        return F.struct(F.get(runs, F.array_position(stays, True).cast("int") - 1)["first"].alias("first"), F.get(runs, last)["last"].alias("last"))

    def ends(runs: Column) -> Column:
        far = lambda r, i: (i > 0) & (r["last"] - r["first"] < tiny) & (r["first"] - F.get(runs, F.greatest(i - 1, F.lit(0)))["last"] > apart)
        last = F.array_max(F.transform(runs, lambda r, i: F.when(~far(r, i), i)))
        return F.when(F.size(runs) > 0, let(last, lambda k: kept(runs, k))).otherwise(F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last")))

    return let(_runs(array), ends)


def anchored(rows: DataFrame, by: list[str], value: str, tolerance: float, then: Sequence[str] = ()) -> DataFrame:
    """The rows with grp: groups of sorted values, where a value joins the group whose first value is within the tolerance.

    A group's first value decides, not its neighbours, so that no window says it. A task goes once through its rows, sorted by value and
    then by ``then``, and keeps one value at a time; nothing is collected by key. Null values are dropped.
    """
    kept = rows.withColumn(value, F.col(value).cast("double")).where(F.col(value).isNotNull())
    names = kept.columns
    keys, at = [names.index(k) for k in by], names.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, anchor, group = None, 0.0, 0
        for batch in batches:
            out = []
            for *key, v in zip(*(batch.column(k).to_pylist() for k in (*keys, at)), strict=True):
                if key != last:
                    last, anchor, group = key, v, 0
                elif v - anchor > tolerance:
                    anchor, group = v, group + 1
                out.append(group)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*names, "grp"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.repartition(*by).sortWithinPartitions(*by, value, *then).mapInArrow(run, f"{kinds}, grp int")


def in_order(rows: DataFrame, by: str, order: list[str], letter: str, alphabet: str, least: int) -> DataFrame:
    """by and found: from a key's last first letter on, the letters of the alphabet in order, each at its first place behind the one before.

    Null below ``least`` letters. A task goes once through its sorted rows and keeps one number: how many letters the run has that began at
    the last first letter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, kind = None, 0, None
        name = lambda: alphabet[:n] if n >= least else None
        for batch in batches:
            keys, found = [], []
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if kind is not None and key != last:
                    keys.append(last)
                    found.append(name())
                    n = 0
                last, kind = key, batch.schema.field(0).type
                n = 1 if x == alphabet[0] else n + 1 if 0 < n < len(alphabet) and x == alphabet[n] else n
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(found, pa.string())], names=[by, "found"])
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], kind), pa.array([name()], pa.string())], names=[by, "found"])

    kind = rows.schema[by].dataType.simpleString()
    dealt = rows.repartition(by).sortWithinPartitions(by, *order).select(by, F.col(letter).alias("letter"))
    return dealt.mapInArrow(run, f"`{by}` {kind}, found string")


def nearest(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each left row (id, x) the right key (key, y) at the least distance, ties by the lowest key.

    Both sides meet in value ranges, where the nearest points below and above are carried over by windows; the edges of the ranges,
    as many as there are cores, fill in for neighbours in other ranges. No product of the sides is formed.
    """
    wanted = max(1, left.sparkSession.sparkContext.defaultParallelism)
    # Ranges of about equally many points; their bounds need not be exact.
    shares = [k / wanted for k in range(1, wanted)]
    bounds = sorted(set(right.approxQuantile("y", shares, 0.5 / wanted))) if shares else []
    n = len(bounds) + 1
    bucket = lambda c: F.lit(0) + sum((F.col(c) >= b).cast("int") for b in bounds)
    points = right.groupBy("y").agg(F.min("key").alias("key")).withColumn("b", bucket("y"))
    edges = points.groupBy("b").agg(F.min_by(F.struct("y", "key"), "y").alias("first"), F.max_by(F.struct("y", "key"), "y").alias("last")).collect()  # n rows at most
    edges.sort(key=lambda r: r["b"])
    before, after = {}, {}
    for b in range(n):
        before[b] = next((r["last"] for r in reversed(edges) if r["b"] < b), None)
        after[b] = next((r["first"] for r in edges if r["b"] > b), None)
    spark = left.sparkSession
    kind = right.schema["key"].dataType.simpleString()
    sides = spark.createDataFrame([(b, before[b], after[b]) for b in range(n)], f"b int, before struct<y:double,key:{kind}>, after struct<y:double,key:{kind}>")
    both = points.select("b", F.col("y").alias("v"), F.struct("y", "key").alias("p"), F.lit(None).cast(left.schema["id"].dataType).alias("id"), F.lit(0).alias("kind")).unionByName(
        left.select(bucket("x").alias("b"), F.col("x").alias("v"), F.lit(None).cast(f"struct<y:double,key:{kind}>").alias("p"), "id", F.lit(1).alias("kind"))
    )
    # Both windows run from their sorted start to the row, so that each row costs the same; up to the end of a range, every row would go
    # through the rest of it again. Points come before the left rows of their value either way.
    upto = lambda order: Window.partitionBy("b").orderBy(order, "kind").rowsBetween(Window.unboundedPreceding, 0)
    low, high = (F.last("p", ignorenulls=True).over(upto(order)) for order in (F.asc("v"), F.desc("v")))
    rows = both.withColumn("low", low).withColumn("high", high).where("kind = 1").join(F.broadcast(sides), "b")
    near = F.filter(F.array(F.coalesce("low", "before"), F.coalesce("high", "after")), lambda p: p.isNotNull())
    best = F.array_min(F.transform(near, lambda p: F.struct(F.abs(p["y"] - F.col("v")).alias("distance"), p["key"].alias("key"))))
    return rows.withColumn("best", best).select("id", F.col("best.key").alias("nearest"), F.col("best.distance").alias("distance"))


def by_topic(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows counted once for each of their topics: n, right and their share in percent."""
    each = rows.select(*keys, "ok", F.explode("topics").alias("topic")).groupBy(*keys, "topic").agg(F.count("*").alias("n"), F.count_if("ok").alias("right"))
    return each.withColumn("pct", percent(F.col("right"), F.col("n"), 0))


def neighbours(rows: DataFrame, by: str, order: list[str], key: str) -> DataFrame:
    """Each row's key with the one before and the one behind it."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.select(by, key, F.lag(key).over(w).alias("previous"), F.lead(key).over(w).alias("following"))
