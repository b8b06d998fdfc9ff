"""Corpus statistics: vocabularies, distributions, pivots. One aggregation each; totals are one-row frames that broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import fold, let, percent, round_half_up


def document_words(df: DataFrame, tokens: Column, *keys: str) -> DataFrame:
    """One row per key and distinct word of a document."""
    return df.select(*keys, F.explode(F.array_distinct(tokens)).alias("word"))


def log_odds(words: DataFrame, positive: Column, least: int = 6) -> DataFrame:
    """Smoothed log-odds of words between positive and other documents, rounded before use: a word's count on a side against that of the side's other words."""
    counts = words.groupBy("word").agg(F.count_if(positive).alias("good"), F.count_if(~positive).alias("poor"))
    totals = counts.agg(F.sum("good").alias("all_good"), F.sum("poor").alias("all_poor"))
    side = lambda n: F.ln((F.col(n) + 0.5) / (F.col(f"all_{n}") - F.col(n) + 0.5))
    odds = side("good") - side("poor")
    kept = counts.where(F.col("good") + F.col("poor") >= least)
    return kept.crossJoin(F.broadcast(totals)).select("word", "good", "poor", round_half_up(odds, 2).alias("log_odds"))


def document_frequency(words: DataFrame, least: int = 1) -> DataFrame:
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def topic_terms(words: DataFrame, topic: str, sizes: DataFrame, least: int = 2, share: float = 0.12, k: int = 12, frequency: DataFrame | None = None, whole: DataFrame | None = None) -> DataFrame:
    """Top words of each topic by (count / size) * ln(N / document frequency); ``sizes`` has topic and n.

    Where documents have several topics, ``frequency`` (word, df) and ``whole`` (one row) count each document once.
    """
    counts = words.groupBy(topic, "word").agg(F.count("*").alias("c"))
    frequency = counts.groupBy("word").agg(F.sum("c").alias("df")) if frequency is None else frequency
    whole = sizes.agg(F.sum("n").alias("whole")) if whole is None else whole
    kept = counts.join(F.broadcast(sizes), topic).where((F.col("c") >= least) & (F.col("c") / F.col("n") >= share))
    scored = kept.join(frequency, "word").crossJoin(F.broadcast(whole))
    scored = scored.withColumn("weight", round_half_up(F.col("c") / F.col("n") * F.ln(F.col("whole") / F.col("df")), 6))
    return top_k(scored, [topic], [F.desc("weight"), F.asc("word")], k).select(topic, "word", "c", "weight", "rank")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank from 1; Spark limits each group before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def spelling_mode(tokens: DataFrame) -> DataFrame:
    """For each folded word its most frequent spelling; ties go to the first seen. ``tokens`` has word and ord."""
    counts = tokens.groupBy(fold(F.col("word")).alias("folded"), "word").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    best = F.min_by(F.struct("word", "n"), F.struct(-F.col("n"), "first"))
    return counts.groupBy("folded").agg(best.alias("best")).select("folded", "best.word", "best.n")


def displayed(terms: DataFrame, column: str, tokens: DataFrame) -> DataFrame:
    """The terms with the folded words of a column in their most frequent spelling; a word that ``tokens`` (word, ord) lack stays.

    Spellings are counted before they are folded, and those of other words than the terms' go before the best is chosen: the dictionary
    is as small as the terms, which are few, since they are the top of a statistic.
    """
    counts = tokens.groupBy("word").agg(F.count("*").alias("n"), F.min("ord").alias("first")).withColumn("folded", fold(F.col("word")))
    counts = counts.join(terms.select(F.col(column).alias("folded")).distinct(), "folded", "left_semi")
    best = counts.groupBy("folded").agg(F.min_by("word", F.struct(-F.col("n"), "first")).alias("spelling"))
    met = terms.join(best, F.col(column) == F.col("folded"), "left")
    return met.select(*[F.coalesce("spelling", column).alias(column) if c == column else F.col(c) for c in terms.columns])


def whole_words(text: Column, listed: list[str]) -> Column:
    """The listed words that a text has, whole and folded, each once."""
    return let(fold(text), lambda f: F.filter(F.array(*[F.when(f.rlike(rf"\b{w}\b"), F.lit(w)) for w in listed]), lambda w: w.isNotNull()))


def alternative_rates(alternatives: DataFrame, hits: Column) -> DataFrame:
    """Of the correct alternatives and of the distractors, how many there are and the share that has any of the listed words."""
    rows = alternatives.select("correct", (F.size(hits) > 0).alias("hit"))
    out = rows.agg(*[F.count_if(c).alias(n) for n, c in (("correct", F.col("correct")), ("distractors", ~F.col("correct")), ("a", F.col("correct") & F.col("hit")), ("b", ~F.col("correct") & F.col("hit")))])
    return out.select(percent(F.col("a"), F.col("correct")).alias("correct_pct"), percent(F.col("b"), F.col("distractors")).alias("distractor_pct"), "correct", "distractors")


def alternative_words(alternatives: DataFrame, hits: Column, least: int = 3) -> DataFrame:
    """For each listed word how many correct alternatives and distractors have it."""
    each = alternatives.select("correct", F.explode(hits).alias("word")).groupBy("word").agg(F.count_if("correct").alias("correct"), F.count_if(~F.col("correct")).alias("distractor"))
    return each.where(F.col("correct") + F.col("distractor") >= least)


def topic_pivot(rows: DataFrame, topics: list[str], exams: list[str]) -> DataFrame:
    """topic, n and a count for each exam, zero where there are none: rows (exam, topics) count once for each topic; topics without rows are
    left out, and so are those that aren't listed."""
    each = rows.select("exam", F.explode(F.array_distinct("topics")).alias("topic")).where(F.col("topic").isin(*topics))
    return each.groupBy("topic").agg(F.count("*").alias("n"), *[F.count_if(F.col("exam") == e).alias(f"n_{e}") for e in exams])


def presence_rates(df: DataFrame, tokens: Column, positive: Column, listed: list[str]) -> DataFrame:
    """Share of positive and of other documents with at least one of the listed words."""
    hit = F.arrays_overlap(tokens, F.array(*map(F.lit, listed)))
    out = df.agg(
        F.count_if(positive & hit).alias("good_hits"), F.count_if(positive).alias("good"), F.count_if(~positive & hit).alias("poor_hits"), F.count_if(~positive).alias("poor")
    )
    return out.select("*", percent(F.col("good_hits"), F.col("good")).alias("good_pct"), percent(F.col("poor_hits"), F.col("poor")).alias("poor_pct"))


def presence_counts(df: DataFrame, tokens: Column, positive: Column, listed: list[str], least: int = 3) -> DataFrame:
    """For each listed word in how many positive and other documents it occurs."""
    hits = df.select(positive.alias("positive"), F.explode(F.array_intersect(tokens, F.array(*map(F.lit, listed)))).alias("word"))
    counts = hits.groupBy("word").agg(F.count_if("positive").alias("good"), F.count_if(~F.col("positive")).alias("poor"))
    return counts.where(F.col("good") + F.col("poor") >= least)


def pivot_counts(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts with a column for each value, zero where there are none."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v.lower().replace('-', '_').replace(' ', '_')}") for v in values])


def letter_grid(groups: DataFrame, answers: DataFrame, by: str, letter: str, letters: list[str]) -> DataFrame:
    """Counts of each letter and of all for every group, zero for groups without answers; null answers don't count."""
    names = [f"n_{x.lower()}" for x in letters]
    counts = pivot_counts(answers, by, letter, letters).join(answers.groupBy(by).agg(F.count(letter).alias("n")), by)
    return groups.join(counts, by, "left").select(by, *[F.coalesce(c, F.lit(0)).alias(c) for c in [*names, "n"]])


def heat(counts: DataFrame, n: str) -> DataFrame:
    """Bucket 0 for none, then 1 to 3 by thirds of the table's maximum (at least 1)."""
    top = counts.agg(F.greatest(F.max(n), F.lit(1)).alias("top"))
    ratio = F.col(n) / F.col("top")
    bucket = F.when(F.col(n) == 0, 0).when(ratio <= 0.33, 1).when(ratio <= 0.66, 2).otherwise(3)
    return counts.crossJoin(F.broadcast(top)).withColumn("bucket", bucket).drop("top")


#: Bins of a value's range that are counted in one round, and rows that are ranked in one group at most, but for equal values.
BINS, RANKED = 1024, 20_000


def at_place(df: DataFrame, by: str, value: str, place: Column) -> DataFrame:
    """by, value and n: the value at ``place``, an expression of the group's size n, in the order of each group's numeric values.

    Rounds of counts narrow each group down to the bin that holds the place, so that no group is sorted whole.
    """
    rows = df.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    state = rows.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).withColumn("place", place.cast("long")).withColumn("inside", F.col("n"))
    while True:
        left = state.where((F.col("inside") > RANKED) & (F.col("high") > F.col("low")))
        if not left.limit(1).count():
            break
        span = state.select("g", "low", "high", "place", "n")
        held = rows.join(span, "g").where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
        bin_ = F.least(F.floor(F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1))
        counts = held.groupBy("g", F.coalesce(bin_, F.lit(0)).alias("bin")).agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("c"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("before", before).join(span.select("g", "place", "n"), "g").where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("c")))
        state = counts.select("g", F.col("a").alias("low"), F.col("b").alias("high"), "n", (F.col("place") - F.col("before")).alias("place"), F.col("c").alias("inside"))
    held = rows.join(state, "g").where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
    # Equal values are one row with a count.
    counts = held.groupBy("g", "v").agg(F.count("*").alias("c"), F.first("place").alias("place"), F.first("n").alias("n"))
    upto = F.sum("c").over(Window.partitionBy("g").orderBy("v"))
    found = counts.withColumn("upto", upto).where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("c")))
    return found.select(F.col("g").alias(by), F.col("v").alias(value), "n")


def upper_median(df: DataFrame, by: str, value: str) -> DataFrame:
    """sorted[floor(n / 2)] of each group."""
    return at_place(df, by, value, F.floor(F.col("n") / 2)).select(by, F.col(value).alias("upper_median"), "n")


def repeated_lines(lines: DataFrame, document: str, least: int, share: float) -> DataFrame:
    """Signatures (folded, no digits or blanks, 30 characters) in at least max(least, share of documents) distinct documents."""
    signature = F.substring(F.regexp_replace(fold(F.col("line")), r"[0-9\s]", ""), 1, 30)
    n = lines.select(document).distinct().agg(F.count("*").alias("docs"))
    counts = lines.select(document, signature.alias("signature")).where("signature <> ''").groupBy("signature").agg(F.countDistinct(document).alias("n"))
    return counts.crossJoin(F.broadcast(n)).where((F.col("n") >= least) & (F.col("n") >= share * F.col("docs"))).select("signature", "n")


def length_rank(df: DataFrame, lengths: Column, own: Column) -> DataFrame:
    """How often the answer is the longest or the shortest of its alternatives, ties included, and how often one taken blindly is the answer."""
    top, low = F.array_max(lengths), F.array_min(lengths)
    rows = df.select((own == top).alias("longest"), (own == low).alias("shortest"), (1 / F.size(lengths)).alias("chance"))
    out = rows.agg(F.count("*").alias("n"), F.count_if("longest").alias("longest"), F.count_if("shortest").alias("shortest"), F.sum("chance").alias("chance"))
    return out.select("n", percent(F.col("longest"), F.col("n")).alias("longest_pct"), percent(F.col("shortest"), F.col("n")).alias("shortest_pct"), percent(F.col("chance"), F.col("n")).alias("chance_pct"))


def extremes(odds: DataFrame, k: int = 18, good: int = 4, poor: int = 6) -> DataFrame:
    """The words that speak most for correct alternatives and for distractors; ties by the word."""
    top = odds.where((F.col("good") >= good) & (F.col("log_odds") > 0)).orderBy(F.desc("log_odds"), "word").limit(k)
    low = odds.where((F.col("poor") >= poor) & (F.col("log_odds") < 0)).orderBy("log_odds", "word").limit(k)
    return top.select(F.lit("correct").alias("side"), "*").unionByName(low.select(F.lit("distractor").alias("side"), "*"))
