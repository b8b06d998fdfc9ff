"""Lookups, image headers, saved study states and dataset bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTEMPT = "array<struct<choice:string,ok:boolean,at:bigint,mode:string,ms:bigint>>"
STATE = f"version int, attempts map<string,{ATTEMPT}>, flagged map<string,boolean>, examDate string"
OLD_ATTEMPT = "array<struct<r:string,ok:boolean,t:bigint,m:string,ms:bigint>>"
OLD_STATE = f"v int, respostas map<string,{OLD_ATTEMPT}>, marcadas map<string,boolean>, dataProva string"


def lookup(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A dictionary table of JSON lines; the schema is given, never inferred."""
    return spark.read.schema(schema).json(path)


def images(spark: SparkSession, path: str, pattern: str = "*.webp") -> DataFrame:
    """Path, width and height of WebP files; only the first 30 bytes of each go on."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    size = webp_size(F.substring("content", 1, 30))
    return files.select("path", size.alias("size")).select("path", "size.width", "size.height")


def _byte(content: Column, i: int) -> Column:
    """Byte i of the content, from 0."""
    return F.conv(F.hex(F.substring(content, i + 1, 1)), 16, 10).cast("int")


def webp_size(content: Column) -> Column:
    """Width and height from the first chunk, null for other files."""
    b = lambda i: _byte(content, i)
    tag = F.substring(content, 13, 4).cast("string")
    lossy = (b(26) + (b(27) % 64) * 256, b(28) + (b(29) % 64) * 256)
    bits = b(21) + b(22) * 256 + b(23) * 65_536 + b(24).cast("long") * 16_777_216
    lossless = (bits % 16_384 + 1, F.floor(bits / 16_384) % 16_384 + 1)
    extended = (b(24) + b(25) * 256 + b(26) * 65_536 + 1, b(27) + b(28) * 256 + b(29) * 65_536 + 1)

    def pick(k: int) -> Column:
        return F.when(tag == "VP8 ", lossy[k]).when(tag == "VP8L", lossless[k]).when(tag == "VP8X", extended[k]).cast("int")

    riff = (F.substring(content, 1, 4).cast("string") == "RIFF") & (F.length(content) >= 30)
    return F.when(riff, F.struct(pick(0).alias("width"), pick(1).alias("height")))


def study_attempts(states: DataFrame, user: str, body: str, renames: dict[str, str] | None = None) -> DataFrame:
    """Attempts of saved states (JSON text), one row each with its place in the log; states of the first version are migrated.

    The first version has other keys, and question ids in which ``renames`` are made, in order, at their first occurrence.
    """
    now, old = F.from_json(body, STATE), F.from_json(body, OLD_STATE)
    migrated = F.transform_values(old["respostas"], lambda k, v: F.transform(v, lambda a: F.struct(a["r"].alias("choice"), a["ok"].alias("ok"), a["t"].alias("at"), a["m"].alias("mode"), a["ms"].alias("ms"))))

    def renamed(key: Column) -> Column:
        for pattern, to in (renames or {}).items():
            place = F.instr(key, pattern)
            key = F.when(place > 0, F.concat(F.substring(key, F.lit(1), place - 1), F.lit(to), F.substring(key, place + len(pattern), F.length(key)))).otherwise(key)
        return key

    migrated = F.transform_keys(migrated, lambda k, v: renamed(k))
    attempts = F.when(F.coalesce(now["version"], F.lit(0)) >= 2, now["attempts"]).otherwise(F.coalesce(migrated, now["attempts"]))
    rows = states.select(F.col(user).alias("user"), F.explode(attempts).alias("question", "log")).select("user", "question", F.posexplode("log").alias("seq", "a"))
    return rows.select("user", "question", "a.choice", "a.ok", F.timestamp_millis("a.at").alias("at"), "a.mode", "a.ms", "seq")


#: Fields of a saved state with their types and what a new state has there.
FIELDS = {
    "version": ("int", "2"), "attempts": (f"map<string,{ATTEMPT}>", "map()"), "flagged": ("map<string,boolean>", "map()"), "drafts": ("map<string,string>", "map()"),
    "mockExams": ("array<struct<id:string,at:bigint,title:string,ids:array<string>,choices:map<string,string>,duration:bigint,limit:bigint,correct:int,total:int>>", "array()"),
    "session": ("struct<ids:array<string>,idx:int,origin:string>", "null"), "filters": ("struct<exams:array<string>,sections:array<string>,topics:array<string>,formats:array<string>,status:string,kind:string,search:string,order:string>",
    "named_struct('exams', array(), 'sections', array(), 'topics', array(), 'formats', array(), 'status', 'all', 'kind', 'objective', 'search', '', 'order', 'exam')"), "examDate": ("string", "''"),
}


def merged_states(states: DataFrame, user: str, body: str) -> DataFrame:
    """user and the fields of saved states (JSON text), merged over those of a new state: a field that the text lacks, or a text that can't be
    read, has the new state's value."""
    found = F.from_json(body, ", ".join(f"{k} {kind}" for k, (kind, _) in FIELDS.items()))
    rows = states.select(F.col(user).alias("user"), found.alias("s"))
    return rows.select("user", *[F.coalesce(F.col("s")[k], F.expr(f"CAST({new} AS {kind})")).alias(k) for k, (kind, new) in FIELDS.items()])


def bundle(exams: DataFrame, questions: DataFrame, texts: DataFrame, exam_id: str = "exam_id", order: str = "id") -> DataFrame:
    """exam_id and body: one JSON document an exam, with its attributes, questions and shared texts nested, each in order of ``order``."""

    def nested(rows: DataFrame, name: str) -> DataFrame:
        own = F.struct(*[c for c in rows.columns if c not in (exam_id, order)])
        each = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), own.alias("own")))), lambda x: F.struct(x[order].alias(order), *[x["own"][c].alias(c) for c in rows.columns if c not in (exam_id, order)]))
        return rows.groupBy(exam_id).agg(each.alias(name))

    met = exams.join(nested(questions, "questions"), exam_id, "left").join(nested(texts, "sharedTexts"), exam_id, "left")
    met = met.withColumn("questions", F.coalesce("questions", F.array().cast(met.schema["questions"].dataType))).withColumn("sharedTexts", F.coalesce("sharedTexts", F.array().cast(met.schema["sharedTexts"].dataType)))
    return met.select(exam_id, F.to_json(F.struct(*met.columns)).alias("body"))


def write_bundles(found: DataFrame, path: str) -> None:
    """One JSON document a line."""
    found.select(F.col("body").alias("value")).write.mode("overwrite").text(path)


def read_bundles(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The documents of ``write_bundles`` by a given schema; fields that a document lacks are null, and lists of it empty."""
    rows = spark.read.schema(schema).json(path)
    empty = lambda f: F.coalesce(f.name, F.array().cast(f.dataType)).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name)
    return rows.select(*[empty(f) for f in rows.schema.fields])


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet table for each entity below ``path``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def warnings(questions: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Questions without an answer, by exam: how many and the first few numbers."""
    missing = questions.join(answers, keys, "left_anti")
    first = F.array_sort(F.collect_set("num"))
    return missing.groupBy(*[k for k in keys if k != "num"]).agg(F.count("*").alias("n"), first.alias("nums"))
