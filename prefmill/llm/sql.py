"""SQL statements (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

from prefmill.llm.mixing import MAX_REPEATS, SEED, WEIGHTS

WORDS = r"[^\x20\x09-\x0D]+"

_WEIGHTS = ", ".join(f"{float(w)}" for w in WEIGHTS)

OP1 = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) AS size,
    ('0x' || substr(md5('{SEED}:' || coalesce('k' || doc_id::VARCHAR, 't' || coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ([{_WEIGHTS}])[((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % {len(WEIGHTS)}) + 1]::DOUBLE AS w,
    source_size::DOUBLE * {MAX_REPEATS} AS cap FROM s
), l AS (
  SELECT *, cap / w AS ratio,
    (sum(source_size) OVER ()
     - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT source, source_size,
    least(cap, w * (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio)) AS target FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t
), r AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.passes, target - passes * source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, h) AS here
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (passes + CASE WHEN rest > 0 AND (upto <= rest OR (upto - here <= rest AND upto - rest < rest - (upto - here)))
    THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) AS n,
    min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, n = 1 AS kept, sha256(t) AS text_sha256 FROM g
"""

SQL = {"op1_mixing": OP1, "op8_content_sort": OP8}
