"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from .quality import RULES, STOP_WORDS

_WORD = r"[^\x20\x09-\x0D]+"


def _rule(rule) -> str:
    tests = [f"{rule.whole} > 0"]
    if rule.low is not None:
        tests.append(f"1000 * {rule.part} >= {rule.low} * {rule.whole}")
    if rule.high is not None:
        tests.append(f"1000 * {rule.part} <= {rule.high} * {rule.whole}")
    return "(" + " AND ".join(tests) + ")"


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

OP2 = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l
  FROM documents
), windows AS (
  SELECT doc_id, i, (w[i], w[i + 1], w[i + 2]) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base)
), again AS (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS place
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM again GROUP BY doc_id
), counted AS (
  SELECT b.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words, len(l) AS n_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…) *$'))) AS n_cut_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals
  FROM base b LEFT JOIN repeated r ON r.doc_id = b.doc_id
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(_rule(r) for r in RULES)} AS kept
FROM judged
"""

OP6 = """
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rule, rule_host, rule_path, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), fitting AS (
  SELECT page_id, rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS place
  FROM split s JOIN rules r
    ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path)
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM split s LEFT JOIN fitting f ON f.page_id = s.page_id AND f.place = 1
"""

# lines, their stretches and templates as text; the operator's defaults are written out
OP1 = r"""
WITH lines AS (
  SELECT doc_id, text, i - 1 AS line, string_split(text, chr(10))[i] AS line_text
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
), words AS (
  SELECT doc_id, text, line, regexp_extract_all(line_text, '[^\x20\x09-\x0D]+') AS w FROM lines
), marked AS (
  SELECT doc_id, text, line, w, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS m
  FROM words WHERE len(w) > 0
), tokens AS (
  SELECT doc_id, text, line, len(m) AS n, len(list_filter(m, lambda x: x <> '<*>')) AS plain,
         CASE WHEN len(m) < 4 AND len(list_filter(m, lambda x: x <> '<*>')) = 0 THEN w ELSE m END AS t
  FROM marked
), parsed AS (
  SELECT *, [t[1], t[2]] AS lead,
         [t[3 + CAST(floor(greatest(n - 2, 0) * i / 4) AS INT):2 + CAST(floor(greatest(n - 2, 0) * (i + 1) / 4) AS INT)]
          FOR i IN range(0, 4)] AS s
  FROM tokens
), uses AS (
  SELECT text, doc_id, line, n, lead, CASE WHEN n < 4 THEN 10 ELSE 3 END AS least,
         unnest(CASE WHEN n >= 12 THEN
           [{'open': -1, 'rest': s}, {'open': 0, 'rest': s[2:4]}, {'open': 1, 'rest': [s[1], s[3], s[4]]},
            {'open': 2, 'rest': [s[1], s[2], s[4]]}, {'open': 3, 'rest': s[1:3]}]
         ELSE [{'open': -1, 'rest': s}] END) AS template
  FROM parsed
  UNION ALL
  SELECT text, doc_id, line, n, lead, 10, unnest([{'open': 1 + i, 'rest': [t[:i - 1], t[i + 1:]]} FOR i IN range(3, n + 1)])
  FROM parsed WHERE n > 4 AND n < 12 AND plain > 1
), wide AS (
  SELECT n, lead, template, least, arg_min(text, doc_id) AS first
  FROM uses GROUP BY n, lead, template, least HAVING count(DISTINCT text) >= least
), gone AS (
  SELECT DISTINCT u.text, u.line FROM uses u
  JOIN wide w ON u.n = w.n AND u.lead = w.lead AND u.template = w.template AND u.least = w.least WHERE u.text <> w.first
), dropped AS (
  SELECT text, list(line) AS numbers FROM gone GROUP BY text
)
SELECT d.doc_id, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines,
       CAST(coalesce(len(g.numbers), 0) AS BIGINT) AS n_dropped,
       sha256(array_to_string(list_filter(string_split(d.text, chr(10)),
              lambda x, i: NOT list_contains(coalesce(g.numbers, []), i - 1)), chr(10))) AS kept_sha256
FROM documents d LEFT JOIN dropped g ON g.text = d.text
"""

OP11 = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores
  WHERE same AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

# crc32 byte by byte, from its table of 256 remainders
OP12 = r"""
WITH step AS (
  SELECT list(list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t
  FROM (SELECT unnest(range(0, 256)) AS b)
), texts AS (
  SELECT 0 AS target, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), split AS (
  SELECT target, doc_id, row_number() OVER () AS row,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
), grams AS (
  SELECT target, doc_id, row, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT target, doc_id, row, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM split CROSS JOIN (SELECT unnest([1, 2, 3]) AS n))
), distinct_grams AS (
  SELECT gram, regexp_extract_all(hex(encode(gram)), '..') AS bytes FROM (SELECT DISTINCT gram FROM grams)
), hashed AS (
  SELECT gram, xor(list_reduce(list_transform(bytes, lambda x: CAST('0x' || x AS BIGINT)),
                               lambda c, x: xor(t[1 + (xor(c, x) & 255)], c >> 8), 4294967295), 4294967295) % 10000 AS bucket
  FROM distinct_grams CROSS JOIN step
), features AS (
  SELECT target, doc_id, row, bucket FROM grams JOIN hashed USING (gram)
), counted AS (
  SELECT bucket, count(*) FILTER (target = 0) AS s, count(*) FILTER (target = 1) AS t FROM features GROUP BY bucket
), sums AS (
  SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM counted
), gain AS (
  SELECT bucket, floor(1000 * ln((CAST(t AS DOUBLE) + 1) * CAST(all_s + 10000 AS DOUBLE)
                                 / ((CAST(s AS DOUBLE) + 1) * CAST(all_t + 10000 AS DOUBLE)))) AS gain
  FROM counted CROSS JOIN sums
), weights AS (
  SELECT row, count(*) AS n, sum(gain) AS weight FROM features JOIN gain USING (bucket) WHERE target = 0 GROUP BY row
), scored AS (
  SELECT doc_id, row, len(w) AS n_words, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
                                                         / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM split LEFT JOIN weights USING (row) WHERE target = 0
), ordered AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS fit FROM scored WHERE n_words >= 20
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
       CASE WHEN place <= 5 * fit // 100 THEN place END AS rank
FROM scored LEFT JOIN ordered USING (row)
"""

ORACLES = {
    "op11_hard_negatives": OP11,
    "op12_importance_resampling": OP12,
    "op1_line_dedup": OP1,
    "op2_quality_rules": OP2,
    "op6_url_filter": OP6,
}
