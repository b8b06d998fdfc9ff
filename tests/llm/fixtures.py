from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, sig string, kept string, part string, token string, own string, n string, root string, queue string"


def documents(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "a", "b", "c", "d", "e", "f", "g", "h", "i") for i, t, s in rows], SCHEMA)


def odd_rows(seed=3, n=40):
    """Nulls in each column, empty and long texts, ties, repeated rows."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Été,", "ß", "don't", "x.", "日本"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 90))).replace(" w7 ", "\n"), f"s{i % 3}") for i in range(n)]
    rows += [(n, None, "s0"), (None, "null id " + rows[0][1], "s1"), (n + 1, "", None), (n + 2, " \n\t ", "s2"), (n + 3, rows[5][1], None), rows[6], rows[6], (n + 4, rows[6][1], "s0"), (n + 5, " ".join(rng.choices(words, k=30_000)), "s0"), (n + 6, "short", "s9")]
    return rows


BLANKS = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
