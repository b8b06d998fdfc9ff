"""The attempt log as a stream: late and repeated attempts, daily activity, and the latest attempt of each question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillspark.operators.study import latest


def clean(attempts: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each attempt once, by user and sequence; state is dropped behind the watermark."""
    return attempts.withWatermark("at", late).dropDuplicatesWithinWatermark(["user", "seq"])


def daily_activity(attempts: DataFrame, late: str = "2 hours") -> DataFrame:
    """Attempts and right answers by user and UTC day, given out once a day is over."""
    days = attempts.withWatermark("at", late).groupBy("user", F.window("at", "1 day").alias("day"))
    return days.agg(F.count("*").alias("n"), F.count_if("ok").alias("right")).select("user", F.to_date("day.start").alias("day"), "n", "right")


def keep_latest(attempts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Add each batch's latest attempts below ``path``; a batch that is repeated replaces itself, and no batch is written again later."""

    def add(batch: DataFrame, epoch: int) -> None:
        latest(batch, "user", "question").select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return attempts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The latest attempt of each question over all batches that ``keep_latest`` has added."""
    return latest(spark.read.parquet(path).drop("batch"), "user", "question")


def keep_snapshot(attempts: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keep the latest attempt of each question below ``path`` as a snapshot that is always whole and compact.

    The stream's own state holds the latest attempt by user and question, and a batch gives out the changed ones. They are merged into the
    buckets of the snapshot that they fall into; a bucket's new version replaces the old one when the batch's manifest names it. A batch
    that is repeated writes the same versions again, and versions that neither of the last two manifests names are deleted.
    """
    rest = [c for c in attempts.columns if c not in ("user", "question")]
    best = F.max_by(F.struct(*rest), F.struct("at", "seq")).alias("best")
    last = attempts.groupBy("user", "question").agg(best).select("user", "question", *[F.col(f"best.{c}").alias(c) for c in rest])

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        changed = batch.withColumn("bucket", F.pmod(F.xxhash64("user", "question"), F.lit(buckets)).cast("int")).persist()
        touched = sorted(r["bucket"] for r in changed.select("bucket").distinct().collect())  # as many as buckets at most
        manifests = _manifests(spark, path)
        earlier = [e for e in manifests if e < epoch]
        now = dict(manifests[max(earlier)]) if earlier else {}
        old = [_bucket(path, b, now[b]) for b in touched if b in now]
        rows = changed.drop("bucket")
        if old:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(*old))
        if touched:
            whole = latest(rows, "user", "question").select(*batch.columns).withColumn("bucket", F.pmod(F.xxhash64("user", "question"), F.lit(buckets)).cast("int"))
            whole.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/version={epoch}")
        now.update(dict.fromkeys(touched, epoch))
        spark.createDataFrame([*now.items()], "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/epoch={epoch}")
        changed.unpersist()
        _forget(spark, path, {**manifests, epoch: now})

    return last.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _bucket(path: str, bucket: int, version: int) -> str:
    return f"{path}/rows/version={version}/bucket={bucket}"


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _children(spark: SparkSession, path: str) -> list[str]:
    system, place = _files(spark, path)
    return [x.getPath().getName() for x in system.listStatus(place)] if system.exists(place) else []


def _manifests(spark: SparkSession, path: str) -> dict[int, dict[int, int]]:
    """For each batch that ended, and is kept, the version of every bucket."""
    epochs = [int(x.partition("=")[2]) for x in _children(spark, f"{path}/manifest") if x.startswith("epoch=") and "_SUCCESS" in _children(spark, f"{path}/manifest/{x}")]
    return {e: {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version long").parquet(f"{path}/manifest/epoch={e}").collect()} for e in epochs}


def _forget(spark: SparkSession, path: str, manifests: dict[int, dict[int, int]]) -> None:
    """Delete what the last two manifests don't name."""
    kept = sorted(manifests)[-2:]
    named = {(v, b) for e in kept for b, v in manifests[e].items()}
    gone = [f"{path}/manifest/epoch={e}" for e in manifests if e not in kept]
    for version in _children(spark, f"{path}/rows"):
        buckets = [x for x in _children(spark, f"{path}/rows/{version}") if x.startswith("bucket=")]
        gone += [f"{path}/rows/{version}/{b}" for b in buckets if (int(version.partition("=")[2]), int(b.partition("=")[2])) not in named]
    for x in gone:
        system, place = _files(spark, x)
        system.delete(place, True)


def read_snapshot(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The latest attempt of each question, as of the last batch that ended: one version of each bucket is read and nothing is compared."""
    manifests = _manifests(spark, path)
    last = manifests[max(manifests)] if manifests else {}
    paths = [_bucket(path, b, v) for b, v in last.items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
