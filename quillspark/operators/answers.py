"""Answer keys in positioned text: lists, pairs and grids, and which of them a file has. Rows are (file, row, text), normalised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import let

# The forms of an answer, and of a row that holds a number and its answer.
ANSWER = r"^([A-E]|\*+|ANULAD[AO])$"
LIST = r"^QUESTAO\s+(\d{1,2})\s+([A-E]|\*+|ANULAD[AO])\b"
PAIR = r"^(\d{1,2})\s+([A-E]|\*+|ANULAD[AO])$"
#: A list or pairs with fewer answers aren't taken for one.
LEAST = 5


def answer(token: Column) -> Column:
    """The letter, or null for an annulled question."""
    return F.when(token.rlike("^[A-E]$"), token)


def numbered(rows: DataFrame, pattern: str) -> DataFrame:
    """file, num and answer of the rows of a form; the last row of a number wins."""
    part = lambda k: F.regexp_extract("text", pattern, k)
    found = rows.where(F.col("text").rlike(pattern)).select("file", "row", part(1).cast("int").alias("num"), answer(part(2)).alias("answer"))
    return found.groupBy("file", "num").agg(F.max_by(F.struct("answer"), "row").alias("last")).select("file", "num", "last.answer")


def tokens(rows: DataFrame) -> DataFrame:
    """file, row, pos, t and cx: the blank-separated tokens with their centres, in characters."""
    each = rows.select("file", "row", F.posexplode(F.split("text", " ")).alias("pos", "t"))
    before = Window.partitionBy("file", "row").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("t") + 1).over(before), F.lit(0))
    return each.withColumn("cx", start + F.length("t") / 2).where("t <> ''")


def grid_key(found: DataFrame) -> DataFrame:
    """file, num and answer from tokens: below a row of numbers, each answer belongs to the number with the nearest centre.

    The first answer of a number counts, unless one of them annuls it. Answers meet the numbers of their own header row alone.
    """
    numeric = F.col("t").rlike(r"^\d{1,2}$")
    kinds = found.groupBy("file", "row").agg(((F.count("*") >= 3) & F.bool_and(numeric)).alias("numbers"))
    upward = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    kinds = kinds.withColumn("header", F.last(F.when(F.col("numbers"), F.col("row")), ignorenulls=True).over(upward))
    placed = found.join(kinds, ["file", "row"])
    heads = placed.where("numbers").select(F.col("file").alias("of"), F.col("row").alias("head"), F.col("pos").alias("column"), F.col("t").cast("int").alias("num"), F.col("cx").alias("middle"))
    below = placed.where(~F.col("numbers") & F.col("header").isNotNull() & F.col("t").rlike(ANSWER))
    met = below.join(heads, (F.col("file") == F.col("of")) & (F.col("header") == F.col("head")))
    near = met.groupBy("file", "row", "pos", "t").agg(F.min_by("num", F.struct(F.abs(F.col("middle") - F.col("cx")), "column")).alias("num"))
    given = near.withColumn("answer", answer(F.col("t")))
    first = F.min_by("answer", F.struct("row", "pos"))
    return given.groupBy("file", "num").agg(F.when(F.bool_or(F.col("answer").isNull()), None).otherwise(first).alias("answer"))


def _below_numbers(text: Column) -> Column:
    """Structs of num, answer and pos: the answers of a line by the nearest numbers of the header line above it, as ``grid_key`` has them.

    Lines keep their tokens to themselves, and a file's window hands on the last header.
    """
    part = F.aggregate(
        F.split(text, " "),
        F.struct(F.lit(0).alias("start"), F.lit(0).alias("pos"), F.array().cast("array<struct<pos:int,t:string,cx:double>>").alias("out")),
        lambda acc, t: F.struct(
            (acc["start"] + F.length(t) + 1).alias("start"),
            (acc["pos"] + 1).alias("pos"),
            F.when(t == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["pos"].alias("pos"), t.alias("t"), (acc["start"] + F.length(t) / 2).alias("cx"))))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    numbers = lambda line: (F.size(line) >= 3) & F.forall(line, lambda x: x["t"].rlike(r"^\d{1,2}$"))
    heads = let(part, lambda line: F.when(numbers(line), F.transform(line, lambda x: F.struct(x["cx"].alias("cx"), x["pos"].alias("pos"), x["t"].cast("int").alias("num")))))
    # A line of numbers has no answers itself: none of its tokens has an answer's form.
    header = F.last(heads, ignorenulls=True).over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    near = lambda x, head: F.array_min(F.transform(head, lambda h: F.struct(F.abs(h["cx"] - x["cx"]).alias("d"), h["pos"].alias("pos"), h["num"].alias("num"))))["num"]
    given = F.filter(part, lambda x: x["t"].rlike(ANSWER))
    return let(header, lambda head: F.when(head.isNotNull(), F.transform(given, lambda x: F.struct(near(x, head).alias("num"), answer(x["t"]).alias("answer"), x["pos"].alias("pos")))))


def best_key(files: DataFrame, manual: DataFrame, rows: DataFrame) -> DataFrame:
    """file, method, num and answer: the manual key of a file if there is one, none for a file without text, else a list or pairs with
    enough answers, else the grid. A file without answers keeps one row without a number."""
    by_hand = manual.select("file", F.struct("num", "answer").alias("manual"))
    return best_of(rows.select("file", "row", "text", F.lit(True).alias("typed")).unionByName(by_hand, True).unionByName(files.select("file"), True))


def best_of(rows: DataFrame) -> DataFrame:
    """``best_key`` from one table (file, row, text, typed, manual): a row may be a line of text (``typed``), have an answer by hand (num and
    answer; null for none), both, or neither.

    The rows are dealt by file once, unless they come so, and all steps go on from there: windows count what decides a file's method, and only answers of the
    method that was chosen are put together.
    """

    def form(pattern: str) -> Column:
        part = lambda k: F.regexp_extract("text", pattern, k)
        return F.when(F.col("typed") & F.col("text").rlike(pattern), F.struct(part(1).try_cast("int").alias("num"), answer(part(2)).alias("answer")))

    own = Window.partitionBy("file")
    dealt = rows.select("file", "row", "text", F.coalesce("typed", F.lit(False)).alias("typed"), "manual")
    dealt = dealt.withColumn("list", form(LIST)).withColumn("pair", form(PAIR))
    distinct = lambda c: F.size(F.collect_set(f"{c}.num").over(own))
    counts = {"n_manual": F.count("manual").over(own), "n_rows": F.count(F.when(F.col("typed"), 1)).over(own), "n_list": distinct("list"), "n_pair": distinct("pair")}
    method = F.when(F.col("n_manual") > 0, "manual").when(F.col("n_rows") == 0, "none").when(F.col("n_list") >= LEAST, "list").when(F.col("n_pair") >= LEAST, "pairs").otherwise("grid")
    chosen = dealt.withColumns(counts).select("file", "row", "list", "pair", "manual", F.when(F.col("typed") & (method == "grid"), F.col("text")).alias("text"), method.alias("method"))
    chosen = chosen.withColumn("grid", _below_numbers(F.col("text")))
    one = lambda c: F.array(F.struct(c["num"].alias("num"), c["answer"].alias("answer"), F.lit(0).alias("pos")))
    given = F.when(F.col("method") == "grid", F.col("grid"))
    for name, column in (("manual", "manual"), ("list", "list"), ("pairs", "pair")):
        given = F.when((F.col("method") == name) & F.col(column).isNotNull(), one(F.col(column))).otherwise(given)
    each = chosen.select("file", "row", "method", F.explode_outer(given).alias("g"))
    value = F.struct("g.answer")
    hand = F.collect_list(F.when(F.col("method") == "manual", F.when(F.col("g").isNotNull(), value)))  # as often as it was written
    last, first = F.max_by(value, "row"), F.min_by(value, F.struct("row", "g.pos"))
    grid = F.when(F.bool_or(F.col("g.answer").isNull()), F.struct(F.lit(None).cast("string").alias("answer"))).otherwise(first)
    answers_ = F.when(F.col("method") == "manual", hand).when(F.col("method") == "grid", F.array(grid)).otherwise(F.array(last))
    found = each.groupBy("file", "method", F.col("g").isNotNull().alias("there"), F.col("g.num").alias("num")).agg(answers_.alias("a"))
    found = found.withColumn("any", F.max("there").over(Window.partitionBy("file"))).where("there = any")
    return found.select("file", "method", "num", F.explode_outer("a").alias("a")).select("file", "method", "num", F.when(F.col("num").isNotNull() | F.col("a").isNotNull(), F.col("a.answer")).alias("answer"))


def manual_key(listed: DataFrame) -> DataFrame:
    """file, num and answer of keys that were written down by hand (file, answers): blank-separated answers from question 1 on, `*` for an
    annulled question."""
    each = listed.select("file", F.posexplode(F.filter(F.split("answers", r"\s+"), lambda t: t != "")).alias("i", "t"))
    return each.select("file", (F.col("i") + 1).alias("num"), F.when(F.col("t") != "*", F.col("t")).alias("answer"))
