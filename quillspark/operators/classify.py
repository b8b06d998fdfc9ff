"""Topics by weighted keywords, formats by an ordered cascade, negative commands. All expressions, with literal patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import fold, let, round_half_up

#: Positions below this weigh 3, later ones 2; a keyword counts up to three times, to the power of 0.7.
HEAVY = 6
#: A keyword that is no pattern.
_LITERAL = re.compile("[a-z]+")


@dataclass(frozen=True)
class Lexicon:
    """Topics in order, each with keyword patterns in order, for folded text."""

    topics: dict[str, list[str]]
    fallback: str

    def found(self, folded: Column) -> Column:
        """The longest literal keyword at each beginning of a word, each behind a blank, by one pass over the text.

        All literal keywords that match at a place are beginnings of the longest one.
        """
        words = sorted({w for ws in self.topics.values() for w in ws if _LITERAL.fullmatch(w)}, key=lambda w: (w[0], -len(w), w))
        by_letter = [f"{k}(?:{'|'.join(w[1:] for w in ws)})" for k, ws in groupby(words, key=lambda w: w[0])]
        hits = F.regexp_extract_all(folded, F.lit(rf"(?<![a-z])(?:{'|'.join(by_letter)})"), F.lit(0)) if words else F.array().cast("array<string>")
        return F.concat(F.lit(" "), F.array_join(hits, " "))

    def scores(self, folded: Column, found: Column | None = None) -> dict[str, Column]:
        """A column for each topic; ``found`` may be given where it has been computed once."""
        found = self.found(folded) if found is None else found

        def count(w: str) -> Column:
            if not _LITERAL.fullmatch(w):
                return F.regexp_count(folded, F.lit(f"(^|[^a-z]){w}"))
            return (F.length(found) - F.length(F.replace(found, F.lit(f" {w}"), F.lit("")))) / F.lit(len(w) + 1)

        def score(words: list[str]) -> Column:
            terms = [F.lit(3.0 if i < HEAVY else 2.0) * F.pow(F.least(F.lit(3.0), count(w)), F.lit(0.7)) for i, w in enumerate(words)]
            return reduce(Column.__add__, terms)

        return {t: score(words) for t, words in self.topics.items()}

    def classify(self, folded: Column, digits: int | None = None) -> Column:
        """The best topic, and the second where it has 0.6 of the best score and at least 4; ties by the lexicon's order."""

        def ranked(text: Column, found: Column) -> Column:
            each = [F.struct((-(round_half_up(s, digits) if digits else s)).alias("low"), F.lit(i).alias("ord"), F.lit(t).alias("topic")) for i, (t, s) in enumerate(self.scores(text, found).items())]
            return F.filter(F.array_sort(F.array(*each)), lambda x: x["low"] < 0)

        best = lambda r: F.coalesce(_best_two(r), F.array(F.lit(self.fallback)))
        return let(folded, lambda text: let(self.found(text), lambda found: let(ranked(text, found), best)))


def first_match(value: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first pattern that matches."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(value.rlike(pattern), label).otherwise(out)
    return out


def negative(text: Column, words: list[str], folded_words: list[str], tail: int = 400, everywhere: bool = False) -> Column:
    """Upper-case words, or words of any case and accent, whole by ASCII rules, in the last ``tail`` characters.

    With ``everywhere`` the words of any case count in the whole text, and inside other words.
    """
    whole = lambda listed: rf"(?<![A-Za-z0-9_])({'|'.join(listed)})(?![A-Za-z0-9_])"
    end = F.right(text, F.lit(tail))
    folded = fold(text).rlike("|".join(folded_words)) if everywhere else fold(end).rlike(whole(folded_words))
    return end.rlike(whole(words)) | folded


#: Letters of a keyword's literal beginning that serve as its key in the index.
KEY = 4


def keyword_index(keywords: DataFrame) -> DataFrame:
    """The keywords (topic, ord, grp, pos, regex) with key: the literal letters, at most KEY, with which every match begins.

    Letters that may be left out aren't taken; a keyword with a bar outside brackets, or that begins with anything else, has an empty key
    and is tried on every text. Keywords that can never match keep their positions, and so the weights of those behind them.
    """
    bare = F.regexp_replace("regex", r"^\\b", "")
    literal = F.regexp_extract(bare, rf"^((?:[a-z](?![?*{{|])){{1,{KEY}}})", 1)
    return keywords.withColumn("key", F.when(F.regexp_replace("regex", r"\([^()]*\)", "").contains("|"), "").otherwise(literal))


def _listed(keywords: DataFrame) -> DataFrame:
    """grp and listed: a row with all keywords of a group, of which texts of the group get a copy."""
    literal = F.col("regex").rlike("^[a-z]+$").alias("literal")
    each = F.struct("topic", "ord", "pos", "regex", literal, F.concat(F.lit(" "), "key").alias("key"))
    return F.broadcast(keyword_index(keywords).groupBy("grp").agg(F.collect_list(each).alias("listed")))


def _counted(folded: Column, listed: Column) -> Column:
    """Structs of topic, ord, pos and n of the keywords that occur. A keyword is looked for by its literal beginning in the letters of the
    text, in which every word stands behind a blank; patterns that may match are then counted in the text itself."""

    def counts(letters: Column) -> Column:
        literal = lambda k: (F.length(letters) - F.length(F.replace(letters, F.concat(F.lit(" "), k["regex"]), F.lit("")))) / (F.length(k["regex"]) + 1)
        n = lambda k: F.when(k["literal"], literal(k).cast("int")).otherwise(F.regexp_count(folded, F.concat(F.lit("(^|[^a-z])"), k["regex"])))
        may = F.filter(listed, lambda k: F.contains(letters, k["key"]))
        return F.filter(F.transform(may, lambda k: F.struct(k["topic"].alias("topic"), k["ord"].alias("ord"), k["pos"].alias("pos"), n(k).alias("n"))), lambda k: k["n"] > 0)

    return let(F.concat(F.lit(" "), F.regexp_replace(folded, "[^a-z]+", " ")), counts)


def keyword_counts(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """id, topic, ord, pos and n: how often each keyword of a text's own group occurs in it. ``texts`` has id, grp and folded (text)."""
    met = texts.join(_listed(keywords), "grp").select("id", F.explode(_counted(F.col("folded"), F.col("listed"))).alias("k"))
    return met.select("id", "k.topic", "k.ord", "k.pos", "k.n")


def topics_by_table(texts: DataFrame, keywords: DataFrame, fallback: dict[str, str]) -> DataFrame:
    """id and topics of texts (id, grp, folded): the best topic of the text's group, and the second where it has 0.6 of the best score and
    at least 4; ties by ord. A text without any keyword has its group's fallback, and none without a group. No text is shuffled."""
    term = lambda k: F.when(k["pos"] < HEAVY, 3.0).otherwise(2.0) * F.pow(F.least(F.lit(3), k["n"]).cast("double"), F.lit(0.7))

    def score(found: Column, topic: Column) -> Column:
        own = F.filter(found, lambda k: k["topic"].eqNullSafe(topic["topic"]) & k["ord"].eqNullSafe(topic["ord"]))
        terms = F.array_sort(F.transform(own, lambda k: F.struct(k["pos"].alias("pos"), term(k).alias("t"))))
        return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x["t"])  # in the order of the keywords

    def ranked(found: Column) -> Column:
        names = F.array_distinct(F.transform(found, lambda k: F.struct(k["topic"].alias("topic"), k["ord"].alias("ord"))))
        return F.array_sort(F.transform(names, lambda t: F.struct((-score(found, t)).alias("low"), t["ord"].alias("ord"), t["topic"].alias("topic"))))

    of_group = F.lit(None).cast("string")
    for group, topic in fallback.items():
        of_group = F.when(F.col("grp") == group, topic).otherwise(of_group)
    met = texts.join(_listed(keywords), "grp", "left")
    best = let(_counted(F.col("folded"), F.col("listed")), lambda found: let(ranked(found), _best_two))
    return met.select("id", F.coalesce(best, F.when(of_group.isNotNull(), F.array(of_group)), F.array().cast("array<string>")).alias("topics"))


def _best_two(r: Column) -> Column:
    best, second = F.get(r, F.lit(0)), F.get(r, F.lit(1))
    both = (-second["low"] >= 4) & (-second["low"] >= 0.6 * -best["low"])
    return F.when(both, F.array(best["topic"], second["topic"])).when(best.isNotNull(), F.array(best["topic"]))
