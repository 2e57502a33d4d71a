"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

OP8 = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""

#: The slots of a period by recursion over time, then a lookup per block.
OP2 = """
WITH RECURSIVE counts AS (
  SELECT coalesce('s' || source, 'null') AS k, count(*) AS n FROM documents GROUP BY 1
), total AS (
  SELECT sum(sqrt(n::DOUBLE)) AS s, greatest(1000.0::DOUBLE, ceil(32.0::DOUBLE * sum(sqrt(n::DOUBLE)) / min(sqrt(n::DOUBLE)))) AS slots FROM counts
), weights AS (
  SELECT k, n, greatest(1, CAST(floor(slots * sqrt(n::DOUBLE) / s + 0.5) AS BIGINT)) AS w
  FROM counts, total
), per AS (
  SELECT CAST(sum(w) AS BIGINT) AS q, list(k ORDER BY k) AS ks, list(w ORDER BY k) AS ws FROM weights
), sched AS (
  SELECT -1::BIGINT AS slot, list_transform(ws, lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick FROM per
  UNION ALL
  SELECT slot, list_transform(range(1, len(done) + 1), lambda i: done[i] + (i = p)::BIGINT), p
  FROM (
    SELECT slot + 1 AS slot, done,
      list_min(list_transform(
        list_filter(range(1, len(done) + 1), lambda i: done[i] * q // ws[i] <= slot + 1),
        lambda i: {'d': ((done[i] + 1) * q + ws[i] - 1) // ws[i], 'r': done[i] * q // ws[i], 'i': i})).i AS p
    FROM sched, per WHERE slot + 1 < q
  )
), slots AS (
  SELECT ks[pick] AS k, slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS place
  FROM sched, per WHERE slot >= 0
), docs AS (
  SELECT doc_id, source, coalesce('s' || source, 'null') AS k,
         row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS r
  FROM documents
), blocks AS (
  SELECT d.*, w.w, per.q, r // 16 AS b FROM docs d JOIN weights w ON d.k = w.k CROSS JOIN per
)
SELECT b.doc_id, b.source, b.w AS source_weight, b.q AS period, 0::BIGINT AS epoch, b.b AS block,
       b.b * b.q // b.w AS release, ((b.b + 1) * b.q + b.w - 1) // b.w AS deadline,
       b.b // b.w * b.q + s.slot AS slot, b.r % 16 AS place
FROM blocks b JOIN slots s ON s.k = b.k AND s.place = b.b % b.w
"""


OP12 = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM sizes),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY 1, 2
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf CROSS JOIN total GROUP BY term, nd
), scores AS (
  SELECT a.item_id, tf.doc_id,
         CAST(sum(a.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * s.n * t.nd) // t.l)))) AS BIGINT) AS score
  FROM asked a JOIN tf USING (term) JOIN weights w USING (term) JOIN sizes s ON s.doc_id = tf.doc_id CROSS JOIN total t
  GROUP BY 1, 2
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": OP2, "op8_exact_dedup": OP8, "op12_lexical_search": OP12}
