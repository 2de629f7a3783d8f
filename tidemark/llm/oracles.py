"""DuckDB SQL that gives the rows of queries, where SQL can express them on whole tables."""

from __future__ import annotations

from .line_rules import BOILERPLATE

OP2 = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         (source_size * 2)::DOUBLE AS cap, (sum(source_size) OVER ())::BIGINT * 150 / 100.0::DOUBLE AS budget FROM per
), filled AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place FROM weighed
), targets AS (
  SELECT source, source_size,
         CASE WHEN level * weight < cap THEN (SELECT f.level FROM filled f WHERE f.level * f.weight < f.cap ORDER BY f.place LIMIT 1) * weight ELSE cap END AS target
  FROM filled
), groups AS (
  SELECT source, size, sum(size)::BIGINT AS words, sqrt(sqrt(greatest(size, 1)::DOUBLE)) AS measure FROM sizes GROUP BY source, size
), tried AS (
  SELECT g.source, g.size, g.measure, (t.target - 2 * coalesce(sum(g.words) OVER (PARTITION BY g.source ORDER BY g.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / nullif(sum(g.words * g.measure) OVER (PARTITION BY g.source ORDER BY g.size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level
  FROM groups g JOIN targets t ON g.source IS NOT DISTINCT FROM t.source
), levels AS (
  SELECT source, arg_max(level, size) AS level FROM tried WHERE level * measure < 2 GROUP BY source
), parts AS (
  SELECT t.source, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN l.level ELSE 0 END AS level FROM targets t LEFT JOIN levels l ON t.source IS NOT DISTINCT FROM l.source
), counted AS (
  SELECT s.doc_id, s.source, s.size, p.source_size, p.target, floor(least(coalesce(p.level * sqrt(sqrt(greatest(s.size, 1)::DOUBLE)), 2.0::DOUBLE), 2.0::DOUBLE) * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE AS c,
         (('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM sizes s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
), ranked AS (
  SELECT *, floor(c)::BIGINT AS whole, c - floor(c) AS p, u * (1 - (c - floor(c))) / (u * (1 - (c - floor(c))) + (c - floor(c)) * (1 - u)) AS v,
         target - (sum(floor(c)::BIGINT * size) OVER (PARTITION BY source))::BIGINT AS wanted FROM counted
), summed AS (
  SELECT source, v, sum(size) AS words FROM ranked WHERE p > 0 GROUP BY source, v
), upto AS (
  SELECT source, v, (sum(words) OVER (PARTITION BY source ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE - words / 2.0::DOUBLE AS middle FROM summed
)
SELECT r.doc_id, r.size, r.source_size, r.target,
       (r.whole + CASE WHEN t.middle < r.wanted THEN 1 ELSE 0 END) * r.size AS taken
FROM ranked r LEFT JOIN upto t ON r.source IS NOT DISTINCT FROM t.source AND r.v = t.v AND r.p > 0
"""

OP7 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT row_id, unnest(range(1, len(ws) - 6)) AS place, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS gram FROM docs WHERE len(ws) >= 8
), twice AS (
  SELECT row_id, place FROM (SELECT *, count(*) OVER (PARTITION BY row_id, gram) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT row_id, sum(least(8, coalesce(following - place, 8)))::BIGINT AS n_repeat_words FROM (SELECT *, lead(place) OVER (PARTITION BY row_id ORDER BY place) AS following FROM twice) GROUP BY row_id
), lines AS (
  SELECT row_id, line, count(*) AS times FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2
), split AS (
  SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS parts FROM lines
), judged AS (
  SELECT row_id, times, length(array_to_string(parts, '')) AS chars,
         len(regexp_extract_all(line, '[#*$%&|<>]')) * 10 >= len(parts) * 5
         OR len(regexp_extract_all(line, '!!')) * 10 >= greatest(len(parts) * 4, 20)
         OR len(regexp_extract_all(line, '[|»›→•·]')) * 10 >= greatest(len(parts) * 2, 20)
         OR (len(parts) >= 10 AND len(list_distinct(parts)) * 10 <= len(parts) * 3)
         OR (len(parts) >= 40 AND NOT regexp_matches(line, '[.!?…]'))
         OR regexp_matches(lower(line), '{boilerplate}') AS fails
  FROM split
), by_doc AS (
  SELECT row_id, (sum(times) - count(*))::BIGINT AS n_dup_lines, coalesce(sum(chars) FILTER (NOT fails), 0)::BIGINT AS chars_left FROM judged GROUP BY row_id
), counted AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(chars_left, 0) AS chars_left
  FROM docs LEFT JOIN covered USING (row_id) LEFT JOIN by_doc USING (row_id)
), failed AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * chars_left >= 50 * word_chars AS kept FROM failed
""".replace("{boilerplate}", BOILERPLATE)

OP10 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), grams AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS gs FROM docs
), sized AS (
  SELECT doc_id, len(gs)::BIGINT AS n_shingles, gs FROM grams
), flat AS (
  SELECT doc_id, n_shingles AS n, unnest(gs) AS g FROM sized
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common WHERE 100 * c >= 75 * (nx + ny - c)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sized
  UNION
  SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON r.other = b.x
)
SELECT s.doc_id, s.n_shingles, min(r.other) AS component_id FROM sized s JOIN reach r USING (doc_id) GROUP BY 1, 2
"""


def _pack_sql(buckets: int = 16, budget: int = 65_536) -> str:
    """The dynamic program as one common table a bucket: the least padding of the first j bins."""
    step = """
{name} AS (
  SELECT e.j, min({{'c': p.c + e.len * (e.docs - p.docs) - (e.toks - p.toks), 'i': p.j}}) AS m FROM bins e JOIN {source} p ON p.j < e.j GROUP BY e.j
), {name}_at AS (
  SELECT 0::BIGINT AS j, 0::HUGEINT AS c, 0::HUGEINT AS docs, 0::HUGEINT AS toks UNION ALL SELECT j, m.c, docs, toks FROM {name} JOIN bins USING (j)
)"""
    steps = ["d1 AS (SELECT j, {'c': len * docs - toks, 'i': 0::BIGINT} AS m FROM bins), d1_at AS (SELECT 0::BIGINT AS j, 0::HUGEINT AS c, 0::HUGEINT AS docs, 0::HUGEINT AS toks UNION ALL SELECT j, m.c, docs, toks FROM d1 JOIN bins USING (j))"]
    steps += [step.format(name=f"d{k}", source=f"d{k - 1}_at").strip() for k in range(2, buckets + 1)]
    program = " UNION ALL ".join(f"SELECT {k}::BIGINT AS k, j, m.c AS c, m.i AS i FROM d{k}" for k in range(1, buckets + 1))
    return rf"""
WITH RECURSIVE lengths AS (
  SELECT doc_id, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS length FROM documents
), binned AS (
  SELECT *, length AS bin,
         (('0x' || substr(md5('pack:' || coalesce(doc_id::VARCHAR, 'null:' || md5(text))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM lengths
), counted AS (
  SELECT bin::HUGEINT AS len, count(*)::HUGEINT AS n FROM binned WHERE bin > 0 GROUP BY bin
), bins AS (
  SELECT row_number() OVER w AS j, len, (sum(n) OVER w)::HUGEINT AS docs, (sum(n * len) OVER w)::HUGEINT AS toks FROM counted WINDOW w AS (ORDER BY len)
), {", ".join(steps)}, program AS ({program}), trace AS (
  SELECT k, j FROM (SELECT k, j FROM program WHERE j = (SELECT max(j) FROM bins) ORDER BY c, k LIMIT 1)
  UNION ALL
  SELECT t.k - 1, p.i FROM trace t JOIN program p ON p.k = t.k AND p.j = t.j WHERE p.i > 0
), edges AS (
  SELECT len::BIGINT AS boundary FROM trace JOIN bins USING (j) UNION SELECT 0 WHERE EXISTS (SELECT 1 FROM binned WHERE bin = 0)
), numbered AS (
  SELECT boundary, (row_number() OVER (ORDER BY boundary) - 1)::INTEGER AS bucket, greatest(1, {budget} // greatest(1, boundary)) AS room FROM edges
), placed AS (
  SELECT b.*, (SELECT min(boundary) FROM edges WHERE boundary >= b.bin) AS boundary FROM binned b
), positioned AS (
  SELECT *, row_number() OVER (PARTITION BY boundary ORDER BY u, doc_id, length) - 1 AS position FROM placed JOIN numbered USING (boundary)
)
SELECT doc_id, length, bucket, boundary, position // room AS batch, (position % room)::INTEGER AS slot, boundary - length AS padding FROM positioned
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_pack_length_buckets": _pack_sql(), "op2_mix_pareto_sample": OP2, "op7_line_rules": OP7, "op10_signature_tree_join": OP10}
