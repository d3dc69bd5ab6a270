"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

#: Kind, pattern, group with the value, least code points, as this engine reads them: no lookahead, letters in either case spelt out.
_SECRETS = [
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", 0, 30),
    ("prefixed", r"(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{16,})", 0, 20),
]


def _kind(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT rid, {rank} AS rank, '{kind}' AS kind, hit, pos AS s, pos + length(hit) AS e, val FROM (
  SELECT rid, hits[i] AS hit, vals[i] AS val,
   CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + COALESCE(list_sum(list_transform(hits[1:i-1], lambda g: length(g))), 0) AS BIGINT) AS pos
  FROM (SELECT rid, hits, vals, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT rid, regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', {group}) AS vals, string_split_regex(t, '{p}') AS gaps FROM docs)))
 WHERE length(val) >= {least}"""


SECRET_SCAN = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source, COALESCE(text, '') AS t FROM documents),
spans AS MATERIALIZED ({" UNION ALL ".join(_kind(i, *d) for i, d in enumerate(_SECRETS))}),
judged AS (SELECT rid, sha256(val) AS h, len(list_distinct(string_split(val, ''))) >= 6 AND regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]')
   AND NOT regexp_matches(val, '(?i)example|sample|changeme|placeholder|dummy|xxxx|your[_-]?|123456|abcdef') AS random FROM spans),
owners AS (SELECT h, count(DISTINCT COALESCE('=' || source, '')) AS n_owners, count(*) AS n_repositories FROM (SELECT DISTINCT h, source, doc_id FROM judged JOIN docs USING (rid)) GROUP BY h),
per_row AS (SELECT rid, count(*) FILTER (WHERE random AND n_owners <= 2 AND n_repositories <= 20) AS n_live, count(*) FILTER (WHERE n_owners > 2 OR n_repositories > 20) AS n_shared,
   max(n_owners) AS max_owners, max(n_repositories) AS max_repositories FROM judged JOIN owners USING (h) GROUP BY rid),
texts AS (SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
   COALESCE(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE rank < 3), '') AS base,
   string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM spans GROUP BY rid)
SELECT doc_id, CAST(COALESCE(n_assign, 0) AS BIGINT) AS n_assign, CAST(COALESCE(n_access, 0) AS BIGINT) AS n_access, CAST(COALESCE(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(COALESCE(base, '')) AS base_sha256, COALESCE(texts.spans, '') AS spans, CAST(COALESCE(n_live, 0) AS BIGINT) AS n_live,
  CAST(COALESCE(n_shared, 0) AS BIGINT) AS n_shared, CAST(COALESCE(max_owners, 0) AS BIGINT) AS max_owners, CAST(COALESCE(max_repositories, 0) AS BIGINT) AS max_repositories
FROM docs LEFT JOIN texts USING (rid) LEFT JOIN per_row USING (rid)
"""


QUALITY = r"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, COALESCE(text, '') AS t,
   regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS MATERIALIZED (SELECT rid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM docs),
win AS (SELECT rid, i, x, (x, lead(x, 1) OVER p, lead(x, 2) OVER p, lead(x, 3) OVER p, lead(x, 4) OVER p) AS g, lead(x, 4) OVER p IS NOT NULL AS whole
   FROM word WINDOW p AS (PARTITION BY rid ORDER BY i)),
many AS (SELECT rid, g FROM win WHERE whole GROUP BY rid, g HAVING count(*) > 1),
hit AS (SELECT rid, i FROM win JOIN many USING (rid, g) WHERE whole),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM hit, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid),
line AS (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM docs),
lines AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
words AS (SELECT rid, sum(length(x)) AS chars, count(*) FILTER (WHERE regexp_matches(x, '\p{Lu}') AND NOT regexp_matches(x, '[a-z]') AND regexp_matches(x, '[A-Z]') AND strlen(x) > 1) AS up FROM word GROUP BY rid),
stut AS (SELECT rid, count(*) FILTER (WHERE x = before) AS n FROM (SELECT rid, x, lag(x) OVER (PARTITION BY rid ORDER BY i) AS before FROM word) GROUP BY rid),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(chars, 0) AS BIGINT) AS word_chars,
   CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(COALESCE(lines.dup, 0) AS BIGINT) AS n_dup_lines,
   CAST(COALESCE(rep.n, 0) AS BIGINT) AS n_repeat_words, COALESCE(lines.n, 0) AS n_lines, COALESCE(up, 0) AS up, COALESCE(stut.n, 0) AS stutter
   FROM docs LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN words USING (rid) LEFT JOIN stut USING (rid)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words) AND NOT (2 * n_dup_lines > n_lines) AND word_chars BETWEEN 2 * n_words AND 15 * n_words
  AND NOT (n_words > 1 AND 10 * stutter > 3 * n_words) AND NOT (2 * up > n_words) AS kept
FROM judged
"""

SUBSTRING_DEDUP = r"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT rid, doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h
   FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50)),
low AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
gone AS (SELECT DISTINCT rid, i + k AS i FROM win JOIN low USING (h), (SELECT unnest(range(0, 50)) AS k) WHERE first < doc_id),
word AS (SELECT rid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM docs),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY i) AS s FROM word ANTI JOIN gone USING (rid, i) GROUP BY rid),
n AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(s, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid) LEFT JOIN n USING (rid)
"""

#: CRC-32 of a word's UTF-8 bytes, by the table of its polynomial.
RESAMPLING = r"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
aim AS (SELECT unnest(regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM benchmark),
word AS MATERIALIZED (SELECT rid, unnest(w) AS x FROM docs),
crc AS MATERIALIZED (SELECT list(CAST(list_reduce([n] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS BIGINT) ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n)),
hashed AS MATERIALIZED (SELECT x, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(h), 2), lambda i: CAST('0x' || h[i:i + 1] AS BIGINT)),
   lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS k FROM (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM word UNION SELECT x FROM aim)), crc),
s AS (SELECT k, count(*) AS s FROM word JOIN hashed USING (x) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM aim JOIN hashed USING (x) GROUP BY k),
gain AS (SELECT k, CAST(floor(1000 * ln((COALESCE(t, 0) + 1)::DOUBLE * ((SELECT COALESCE(sum(s), 0) FROM s) + 10000)::DOUBLE / ((COALESCE(s, 0) + 1)::DOUBLE * ((SELECT COALESCE(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS g
   FROM (SELECT DISTINCT k FROM hashed) LEFT JOIN s USING (k) LEFT JOIN t USING (k)),
weighed AS (SELECT rid, sum(g) AS weight FROM word JOIN hashed USING (x) JOIN gain USING (k) GROUP BY rid),
scored AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(COALESCE(weight, 0) AS BIGINT) AS weight,
   CAST(COALESCE(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || COALESCE(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5)::DOUBLE / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM docs LEFT JOIN weighed USING (rid)),
drawn AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM scored LEFT JOIN drawn USING (rid)
"""

FILL_IN_MIDDLE = r"""
WITH docs AS (SELECT doc_id, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM docs),
parts AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
