"""Text and number helpers as column expressions, with the semantics that exam texts need."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All blanks of Unicode that count as white space, with the byte order mark.
BLANK = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


@cache
def _fold_table() -> tuple[str, str]:
    """Characters whose decomposition without combining marks is one other character, built from the Unicode database."""
    pairs = []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        c = chr(code)
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if not "\u0300" <= x <= "\u036f")
        if len(bare) == 1 and bare != c:
            pairs.append((c, bare))
    marks = "".join(map(chr, range(0x300, 0x370)))  # at the end, without a counterpart: they go
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(text: Column) -> Column:
    """Lower case without accents: the search and matching form of a text."""
    source, target = _fold_table()
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.lower(F.translate(text, source, target)))


def squeeze(text: Column) -> Column:
    """Runs of blanks to one, and none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, f"{BLANK}+", " "), r"^ | $", "")


def marker_norm(text: Column) -> Column:
    """Folded and squeezed upper case, in which line markers are looked for."""
    return F.upper(squeeze(fold(text)))


def words(text: Column, stop: list[str] | None = None, least: int = 5) -> Column:
    """Folded words of at least ``least`` letters that aren't stop words, in order."""
    tokens = F.split(fold(text), r"(?:[^a-z-])+")
    kept = F.filter(tokens, lambda w: F.length(w) >= least)
    return kept if not stop else F.filter(kept, lambda w: ~w.isin(*stop))


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Halves go towards plus infinity, on the binary double."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """part of whole in percent, 0 where whole is 0."""
    share = round_half_up(100.0 * part / F.when(whole != 0, whole), digits)
    return F.coalesce(share, F.lit(0.0))


def duration(ms: Column) -> Column:
    """h:mm:ss, or m:ss below an hour; seconds rounded, never negative."""
    s = F.greatest(F.lit(0).cast("long"), F.floor(ms / 1000.0 + 0.5).cast("long"))
    hours, minutes, seconds = F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), s % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(hours > 0, F.concat_ws(":", hours.cast("string"), two(minutes), two(seconds))).otherwise(F.concat_ws(":", minutes.cast("string"), two(seconds)))


def brazilian(value: Column, digits: int = 0) -> Column:
    """A number with points between thousands and a comma before its decimals, as many as ``digits``."""
    return F.translate(F.format_number(round_half_up(value.cast("double"), digits), digits), ",.", ".,")


def plural(n: Column, one: str, many: str) -> Column:
    """The number with the word for one or for many."""
    return F.concat(brazilian(n), F.lit(" "), F.when(n == 1, one).otherwise(many))


def strict_date(text: Column) -> Column:
    """dd/mm/yyyy as a date; null for other forms and for days that don't exist."""
    return F.when(text.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(text, "dd/MM/yyyy"))


def number_list(text: Column) -> Column:
    """Numbers of a marker: `N a M` as a range (empty if it descends), else all numbers of one or two digits."""
    low = F.regexp_extract(text, r"(\d{1,2})\s*[aA]\s*(\d{1,2})", 1)
    high = F.regexp_extract(text, r"(\d{1,2})\s*[aA]\s*(\d{1,2})", 2)
    a, b = low.try_cast("int"), high.try_cast("int")
    span = F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    each = F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{1,2})\b"), F.lit(1)), lambda x: x.cast("int"))
    return F.when(low != "", span).otherwise(each)


def escape(text: Column) -> Column:
    """The five characters that mark up HTML as their references."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text
