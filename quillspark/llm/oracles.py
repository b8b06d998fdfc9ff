"""SQL for the operators that an independent engine can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op8_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS sha FROM p),
     o AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY sha, n) END AS owner FROM d)
SELECT page_id, n AS payload_bytes, sha AS payload_digest,
       CASE WHEN owner IS NULL OR owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN owner <> page_id THEN owner END AS refers_to,
       true AS complete
FROM o
"""

#: Lines over a limit, as lists by host. Braces are filled with the least number of pages and the least share.
_ABOVE = """
     d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
     l AS (SELECT doc_id, host, text AS page, unnest(string_split(text, chr(10))) AS line FROM d),
     k AS (SELECT *, lower(regexp_replace(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS key FROM l),
     h AS (SELECT host, count(DISTINCT text) AS pages FROM d GROUP BY host),
     f AS (SELECT k.host, k.key FROM k JOIN h ON k.host = h.host WHERE k.key <> ''
           GROUP BY k.host, k.key, h.pages HAVING count(DISTINCT page) > {least} AND count(DISTINCT page) > {share} * h.pages)
"""

ORACLES["op6_quality"] = (
    "WITH"
    + _ABOVE.format(least=20, share=0)
    + """,
     w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d),
     t AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
           FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
     r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM t) WHERE c > 1),
     c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (VALUES (0), (1), (2)) AS s(j) GROUP BY doc_id),
     u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM k WHERE key <> '' GROUP BY doc_id),
     x AS (SELECT k.doc_id, sum(len(list_filter(string_split_regex(k.line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) AS n
           FROM k JOIN f ON k.host = f.host AND k.key = f.key GROUP BY k.doc_id),
     m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
                  CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
                  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                  CAST(coalesce(u.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
                  CAST(coalesce(x.n, 0) AS BIGINT) AS n_removed
           FROM w LEFT JOIN u USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)),
     b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_words - n_removed < 0.3 * n_words) AS kept, n_removed
FROM b
"""
)

ORACLES["op7_line_dedup"] = (
    "WITH"
    + _ABOVE.format(least=5, share=0.05)
    + """,
     g AS (SELECT host, list(key) AS keys FROM f GROUP BY host),
     n AS (SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS lines, coalesce(g.keys, []) AS keys FROM d LEFT JOIN g USING (host)),
     q AS (SELECT *, list_filter(lines, lambda x: NOT list_contains(keys, lower(regexp_replace(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+', ' ', 'g')))) AS own FROM n)
SELECT doc_id, array_to_string(own, chr(10)) AS text, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(own) AS BIGINT) AS n_dropped
FROM q
"""
)

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op1_decontamination"] = f"""
WITH i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
     v AS (SELECT item_id, array_to_string(ws[k:k + 9], ' ') AS g, 10 AS n FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 8)) AS k FROM i WHERE len(ws) >= 10)
           UNION SELECT item_id, array_to_string(ws, ' '), len(ws) FROM i WHERE len(ws) BETWEEN 1 AND 9),
     d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
     p AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM v) WHERE len(ws) >= n),
     h AS (SELECT p.doc_id, p.k, p.n, v.item_id FROM (SELECT doc_id, k, n, array_to_string(ws[k:k + n - 1], ' ') AS g FROM p) p JOIN v ON p.g = v.g AND p.n = v.n),
     w AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS j FROM h) GROUP BY doc_id),
     s AS (SELECT doc_id, list(DISTINCT CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(list_sort(ids), ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w USING (doc_id) LEFT JOIN s USING (doc_id)
"""

#: Links of documents by their 5-word shingles. The brace is filled with the similarity in hundredths.
_COMPONENTS = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
     g AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS k FROM d WHERE len(ws) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
     c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
     l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= {{percent}} * (p.n + q.n - c)),
     r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id{{more}} FROM (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) LEFT JOIN n USING (doc_id)
"""

ORACLES["op4_ngram_join"] = _COMPONENTS.format(percent=75, more="")
ORACLES["op12_minhash"] = _COMPONENTS.format(percent=85, more=", doc_id = component_id AS kept")


def _clustering(clusters: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> str:
    """The rounds written out one after another, each from all components."""
    parts = [
        f"""v AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
      FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS (SELECT r AS k, x AS c FROM v WHERE r < {clusters})",
    ]
    for i in range(rounds + 1):
        parts.append(f"d{i} AS (SELECT vec_id, r, x, k, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{i})")
        parts.append(f"a{i} AS (SELECT vec_id, r, x, min_by(k, d * {clusters} + k) AS k, CAST(min(d) AS BIGINT) AS d FROM d{i} GROUP BY vec_id, r, x)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT k, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, unnest(x) AS v, unnest(range(1, 65)) AS i FROM a{i}) GROUP BY k, i)")
            parts.append(f"m{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{i} GROUP BY k)")
            parts.append(f"c{i + 1} AS (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))")
    return f"""
WITH {', '.join(parts)}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (k)
"""


ORACLES["op11_centroids"] = _clustering()

#: CRC-32 over a word's bytes, with its table made from the polynomial.
ORACLES["op13_resampling"] = f"""
WITH t AS (SELECT list(list_reduce(list_prepend(CAST(b AS BIGINT), range(8)), lambda a, i: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY b) AS crc FROM range(256) r(b)),
     d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
     q AS (SELECT regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
     u AS (SELECT doc_id, unnest(ws) AS w FROM d),
     b AS (SELECT unnest(ws) AS w FROM q),
     h AS (SELECT w, hex(w) AS x FROM (SELECT w FROM u UNION SELECT w FROM b)),
     z AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))), lambda a, y: xor(a >> 8, crc[(xor(a, y) & 255) + 1])), 4294967295) % 10000 AS k FROM h, t),
     s AS (SELECT k, count(*) AS n FROM u JOIN z USING (w) GROUP BY k),
     e AS (SELECT k, count(*) AS n FROM b JOIN z USING (w) GROUP BY k),
     f AS (SELECT (SELECT sum(n) FROM s) AS s, (SELECT coalesce(sum(n), 0) FROM e) AS t),
     g AS (SELECT k, CAST(floor(1000 * ln(CAST(coalesce(e.n, 0) + 1 AS DOUBLE) * (f.s + 10000) / (CAST(s.n + 1 AS DOUBLE) * (f.t + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN e USING (k), f),
     w AS (SELECT doc_id, sum(gain) AS weight FROM u JOIN z USING (w) JOIN g USING (k) GROUP BY doc_id),
     o AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                  CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
           FROM d LEFT JOIN w USING (doc_id)),
     r AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS m FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * m // 100 THEN place END AS rank FROM r
"""
