"""DuckDB SQL equivalents of the registered queries (the correctness gate).

Built from CTE fragments so that each query's SQL states the same semantics
independently of the Spark code: sentence split with UNNEST, bisection and
greedy packing as recursive CTEs, statistics with plain scalar functions.
"""

from __future__ import annotations

from sliceforge.config import MODEL_CONFIGS
from sliceforge.functions.text import WS_CLASS_JAVA, ws_chars_sql
from sliceforge.functions.tokens import TOKEN_PATTERN_JAVA

WS = ws_chars_sql()

# The oracle's own patterns: RE2 has neither look-behind nor possessive runs, and
# a slip in an engine pattern must not be on both sides.
LOSSLESS = rf"(?s).*?[.!?]+(?:[{WS_CLASS_JAVA}]+|\z)|.+"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def cnt(expr: str) -> str:
    """C2 in DuckDB."""
    return f"len(regexp_extract_all({expr}, {q(TOKEN_PATTERN_JAVA)}))"


def norm_cte(table: str = "documents", id_col: str = "doc_id", text_col: str = "text", prefix: str = "documents") -> str:
    return (
        f"norm AS (SELECT CAST({id_col} AS VARCHAR) AS doc_id, "
        f"'{prefix}/' || CAST({id_col} AS VARCHAR) || '.txt' AS path, "
        f"regexp_replace({text_col}, '\\r\\n?', chr(10), 'g') AS text FROM {table})"
    )


def mixed_norm() -> str:
    """Documents with the keyed replacements of the failure queries."""
    key = f"({_hash8('md5(CAST(doc_id AS VARCHAR))')} % 11)"
    ends = "regexp_replace(text, '\\r\\n?', chr(10), 'g')"
    return (
        "norm AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'documents/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, "
        f"CASE WHEN {key} = 0 THEN ' ' || chr(9) || chr(10) || ' ' WHEN {key} = 1 THEN '...' WHEN {key} = 2 THEN NULL "
        f"WHEN {key} IN (3, 4) THEN replace({ends}, ' ', chr(10)) ELSE {ends} END AS text FROM documents)"
    )


def ok_cte() -> str:
    """Documents that pass the blank check."""
    return f"okdocs AS (SELECT * FROM norm WHERE trim(text, {WS}) <> '')"


def sentences_cte(splitter: str = "dot", src: str = "okdocs") -> str:
    """``sent(doc_id, i, s)``: T1 (dot), T2 (lossless) or T3 (punct)."""
    if splitter == "dot":
        return (
            f"sent AS (SELECT n.doc_id, u.i, trim(u.x, {WS}) || '.' AS s "
            f"FROM {src} n, unnest(string_split(n.text, '.')) WITH ORDINALITY AS u(x, i) "
            f"WHERE trim(u.x, {WS}) <> '')"
        )
    if splitter == "lossless":
        return (
            f"sent AS (SELECT n.doc_id, u.i, u.x AS s "
            f"FROM {src} n, unnest(regexp_extract_all(n.text, {q(LOSSLESS)})) WITH ORDINALITY AS u(x, i))"
        )
    if splitter == "punct":
        # RE2 has no look-behind: mark each split point with chr(1) first.
        marked = f"regexp_replace(n.text, {q('([.!?])[' + WS_CLASS_JAVA + ']+')}, '\\1' || chr(1), 'g')"
        return (
            f"sent AS (SELECT n.doc_id, u.i, trim(u.x, {WS}) AS s "
            f"FROM {src} n, unnest(string_split({marked}, chr(1))) WITH ORDINALITY AS u(x, i) "
            f"WHERE trim(u.x, {WS}) <> '')"
        )
    raise ValueError(splitter)


def _cut(t: str) -> str:
    half = f"substr({t}, 2, length({t}) // 2)"
    return (
        f"(CASE WHEN regexp_matches({half}, '[{WS_CLASS_JAVA}]') "
        f"THEN 1 + length(regexp_extract({half}, '(?s)^(.*)[{WS_CLASS_JAVA}]', 1)) "
        f"ELSE length({t}) // 2 END)"
    )


def greedy_ctes(limit: int, order: str = "reference") -> str:
    """T4 + T5 over ``sent``: ``ch(doc_id, number, text)``."""
    direction = "DESC" if order == "reference" else "ASC"
    cut = _cut("b.t")
    return f"""
bis(doc_id, i, path, t, n) AS (
  SELECT doc_id, i, '', s, {cnt('s')} FROM sent
  UNION ALL
  SELECT doc_id, i, path || d, part, {cnt('part')} FROM (
    SELECT b.doc_id, b.i, b.path, v.d,
      CASE v.d WHEN '0' THEN trim(substr(b.t, 1, {cut}), {WS})
               ELSE trim(substr(b.t, {cut} + 1), {WS}) END AS part
    FROM bis b, (VALUES ('0'), ('1')) v(d)
    WHERE b.n > {limit} AND length(b.t) >= 2) x
  WHERE part <> ''),
leaves AS MATERIALIZED (
  SELECT doc_id, t, n, row_number() OVER (PARTITION BY doc_id ORDER BY i, path {direction}) AS k
  FROM bis WHERE n <= {limit} OR length(t) < 2),
pk(doc_id, k, c, used) AS (
  SELECT doc_id, k, 1, n FROM leaves WHERE k = 1
  UNION ALL
  SELECT l.doc_id, l.k,
    CASE WHEN p.used + l.n > {limit} THEN p.c + 1 ELSE p.c END,
    CASE WHEN p.used + l.n > {limit} THEN l.n ELSE p.used + l.n END
  FROM pk p JOIN leaves l ON l.doc_id = p.doc_id AND l.k = p.k + 1),
ch AS (
  SELECT l.doc_id, p.c AS number, string_agg(l.t, '' ORDER BY l.k) AS text
  FROM leaves l JOIN pk p ON l.doc_id = p.doc_id AND l.k = p.k
  GROUP BY l.doc_id, p.c)"""


def chunk_base(limit: int, order: str = "reference", splitter: str = "dot", table: str = "documents",
               id_col: str = "doc_id", text_col: str = "text", prefix: str = "documents", norm: str | None = None) -> str:
    """``WITH RECURSIVE norm, okdocs, sent, bis, leaves, pk, ch`` (no final SELECT)."""
    return (
        "WITH RECURSIVE\n"
        + (norm or norm_cte(table, id_col, text_col, prefix)) + ",\n"
        + ok_cte() + ",\n"
        + sentences_cte(splitter) + ",\n"
        + greedy_ctes(limit, order)
    )


CHUNK_SELECT = (
    "SELECT doc_id || '-chunk-' || CAST(number AS VARCHAR) AS id, doc_id, CAST(number AS BIGINT) AS number, "
    f"CAST({cnt('text')} AS BIGINT) AS tokens, md5(text) AS content_hash, CAST(length(text) AS BIGINT) AS character_count "
    "FROM ch"
)


def chunks_sql(limit: int, order: str = "reference", splitter: str = "dot", **src) -> str:
    return chunk_base(limit, order, splitter, **src) + "\n" + CHUNK_SELECT


def sentences_sql(splitter: str) -> str:
    return (
        "WITH " + norm_cte() + ",\n" + ok_cte() + ",\n" + sentences_cte(splitter) + "\n"
        f"SELECT doc_id, CAST(i AS BIGINT) AS i, md5(s) AS sentence_md5, CAST(length(s) AS BIGINT) AS chars, "
        f"CAST({cnt('s')} AS BIGINT) AS tokens FROM sent"
    )


def token_counts_sql() -> str:
    return (
        "WITH " + norm_cte() + "\n"
        f"SELECT doc_id, CAST({cnt('text')} AS BIGINT) AS tokens, "
        "CAST(length(text) AS BIGINT) AS total_chars FROM norm"
    )


def chunk_agg_cte() -> str:
    """Per-document totals and list checksums over ``ch`` (A1, A2, A10)."""
    return (
        "agg AS (SELECT doc_id, count(*) AS total_chunks, "
        f"sum({cnt('text')}) AS total_tokens, max(number) AS current_chunk, "
        "md5(string_agg(doc_id || '-chunk-' || CAST(number AS VARCHAR), ',' ORDER BY number)) AS chunk_ids_md5, "
        f"md5(string_agg(doc_id || '-chunk-' || CAST(number AS VARCHAR) || ':' || CAST({cnt('text')} AS VARCHAR) "
        "|| ':' || md5(text) || ':' || CAST(length(text) AS VARCHAR), ',' ORDER BY number)) AS chunk_list_md5 "
        "FROM ch GROUP BY doc_id)"
    )


def document_info_sql(limit: int, model_name: str = "gpt-4") -> str:
    return (
        chunk_base(limit) + ",\n" + chunk_agg_cte() + "\n"
        "SELECT n.doc_id AS id, n.doc_id || '.txt' AS filename, "
        "n.doc_id || '/source/' || n.doc_id || '.txt' AS original_path, "
        "CAST(a.total_chunks AS BIGINT) AS total_chunks, CAST(a.total_tokens AS BIGINT) AS total_tokens, "
        "CAST(length(n.text) AS BIGINT) AS total_chars, "
        "CAST(length(n.text) - length(replace(n.text, chr(10), '')) + 1 AS BIGINT) AS total_lines, "
        f"'{model_name}' AS model_name, CAST({limit} AS BIGINT) AS token_limit, md5(n.text) AS md5_hash, "
        "CAST(strlen(n.text) AS BIGINT) AS file_size, a.chunk_list_md5 "
        "FROM norm n JOIN agg a ON a.doc_id = n.doc_id"
    )


def state_cte() -> str:
    """Every document with its error, totals and state."""
    return (
        "st AS (SELECT n.doc_id, "
        f"CASE WHEN coalesce(trim(n.text, {WS}), '') = '' THEN 'File ' || n.path || ' is empty.' "
        "WHEN a.doc_id IS NULL THEN 'No chunks created for file ' || n.path || '.' END AS error_message, "
        "a.total_chunks, a.total_tokens, a.current_chunk, a.chunk_ids_md5 "
        "FROM norm n LEFT JOIN agg a ON a.doc_id = n.doc_id)"
    )


def processing_state_sql(limit: int, norm: str | None = None) -> str:
    return (
        chunk_base(limit, norm=norm) + ",\n" + chunk_agg_cte() + ",\n" + state_cte() + "\n"
        "SELECT doc_id, CAST(coalesce(current_chunk, 0) AS BIGINT) AS current_chunk, "
        "CAST(coalesce(total_chunks, 0) AS BIGINT) AS processed_count, "
        "coalesce(chunk_ids_md5, md5('')) AS processed_chunks_md5, "
        "error_message IS NULL AS is_complete, error_message FROM st"
    )


def import_summary_sql(limit: int, norm: str | None = None) -> str:
    return (
        chunk_base(limit, norm=norm) + ",\n" + chunk_agg_cte() + ",\n" + state_cte() + "\n"
        "SELECT CAST(count(*) AS BIGINT) AS total_files, "
        "CAST(count(*) FILTER (WHERE error_message IS NULL) AS BIGINT) AS processed_files, "
        "CAST(count(*) FILTER (WHERE error_message IS NOT NULL) AS BIGINT) AS failed_files, "
        "CAST(coalesce(sum(total_chunks), 0) AS BIGINT) AS total_chunks, "
        "CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens FROM st"
    )


def verify_ctes(extra_word: str = "extra") -> str:
    """Clean chunks, document totals, corrupted store, listed-vs-stored join."""
    letter = "regexp_extract(text, '^[^\\p{L}]*(\\p{L})', 1)"
    return f""",
clean AS (SELECT doc_id, number, doc_id || '-chunk-' || CAST(number AS VARCHAR) AS id, text,
  {cnt('text')} AS tokens, md5(text) AS content_hash FROM ch),
info AS (SELECT doc_id, sum(tokens) AS doc_total FROM clean GROUP BY doc_id),
keyed AS (SELECT *, ('0x' || substr(md5(id), 1, 8))::BIGINT % 97 AS r FROM clean),
stored AS (SELECT id, doc_id,
  CASE WHEN r = 1 AND {letter} <> ''
       THEN regexp_replace(text, '^([^\\p{{L}}]*)\\p{{L}}', '\\1' || CASE WHEN {letter} = 'Q' THEN 'Z' ELSE 'Q' END)
       WHEN r = 2 THEN text || ' {extra_word}' ELSE text END AS text
  FROM keyed WHERE r <> 0),
j AS (SELECT c.doc_id, c.number, c.tokens, c.content_hash, s.id IS NULL AS missing,
  {cnt('s.text')} AS tokens_now, md5(s.text) AS hash_now
  FROM clean c LEFT JOIN stored s ON s.id = c.id AND s.doc_id = c.doc_id)"""


def _verify_mode_select(mode: str) -> str:
    if mode == "strict":
        rc = ("CASE WHEN missing THEN 'missing' WHEN tokens_now <> tokens THEN 'token mismatch' "
              "WHEN hash_now <> content_hash THEN 'hash mismatch' END")
    else:
        rc = "CASE WHEN missing THEN 'missing' END"
    agg = (f"SELECT j.doc_id, arg_min({rc}, number) FILTER (WHERE {rc} IS NOT NULL) AS first_reason, "
           "sum(tokens_now) AS sum_now FROM j GROUP BY j.doc_id")
    if mode == "lenient":
        final = "first_reason"
    else:
        final = "coalesce(first_reason, CASE WHEN sum_now IS NULL OR sum_now <> i.doc_total THEN 'total mismatch' END)"
    return (f"SELECT a.doc_id, {final} IS NULL AS is_valid, {final} AS reason "
            f"FROM ({agg}) a JOIN info i ON i.doc_id = a.doc_id")


def verify_sql(limit: int, mode: str) -> str:
    return chunk_base(limit) + verify_ctes() + "\n" + _verify_mode_select(mode)


def reimport_verify_sql(limit: int) -> str:
    """Run 0 against its damaged store; run 1 has the same documents, undamaged."""
    norm = (
        "norm AS (SELECT md5('documents/' || CAST(doc_id AS VARCHAR) || '.txt|r1#0') AS doc_id, "
        "md5('documents/' || CAST(doc_id AS VARCHAR) || '.txt|r2#1') AS again, 'documents/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, "
        "regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM documents)"
    )
    return (
        chunk_base(limit, norm=norm) + verify_ctes() + "\n"
        f"SELECT CAST(0 AS BIGINT) AS run_seq, * FROM ({_verify_mode_select('strict')}) v "
        "UNION ALL SELECT 1, n.again, TRUE, NULL FROM norm n JOIN info i ON i.doc_id = n.doc_id"
    )


def lookup_chunk_sql(limit: int) -> str:
    return chunks_sql(limit) + " WHERE id IN (SELECT CAST(doc_id AS VARCHAR) || '-chunk-1' FROM labels)"


def lookup_document_sql(limit: int) -> str:
    return (
        f"SELECT id, filename, total_chunks, total_tokens, md5_hash FROM ({document_info_sql(limit)}) d "
        "WHERE id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)"
    )


def document_models_sql(factor: float) -> str:
    names = sorted(MODEL_CONFIGS)
    rows = ", ".join(f"({i}, '{n}', CAST({int(MODEL_CONFIGS[n]['tokens'] * factor)} AS BIGINT))" for i, n in enumerate(names))
    return (
        "WITH " + norm_cte() + f", models(k, model_name, token_limit) AS (VALUES {rows})\n"
        f"SELECT doc_id, model_name, token_limit, CAST({cnt('text')} AS BIGINT) AS tokens, {cnt('text')} <= token_limit AS fits "
        f"FROM norm JOIN models ON k = {_hash8('md5(doc_id)')} % {len(names)}"
    )


def verification_summary_sql(limit: int) -> str:
    parts = [f"SELECT '{m}' AS mode, * FROM ({_verify_mode_select(m)})" for m in ("strict", "lenient", "token")]
    body = " UNION ALL ".join(f"({p})" for p in parts)
    return (chunk_base(limit) + verify_ctes() + "\n"
            f"SELECT mode, CAST(count(*) FILTER (WHERE is_valid) AS BIGINT) AS valid, "
            f"CAST(count(*) FILTER (WHERE NOT is_valid) AS BIGINT) AS invalid FROM ({body}) v GROUP BY mode")


def _hash8(expr: str) -> str:
    return f"('0x' || substr({expr}, 1, 8))::BIGINT"


def versions_sql(limit: int, run_id: str = "r1") -> str:
    return (chunk_base(limit) + ",\n" + chunk_agg_cte() + "\n"
            f"SELECT md5('{run_id}|' || n.doc_id || '|version') AS version_id, md5(n.text) AS content_hash, "
            "CAST(NULL AS VARCHAR) AS parent_version_id, CAST(NULL AS VARCHAR) AS changes_description, n.doc_id "
            "FROM norm n JOIN agg a ON a.doc_id = n.doc_id")


def processing_runs_sql(limit: int, run_id: str = "r1", manifest_id: str = "m", model_name: str = "gpt-4") -> str:
    return (chunk_base(limit) + ",\n" + chunk_agg_cte() + "\n"
            f"SELECT md5('{run_id}|' || doc_id || '|processing') AS processing_id, '{manifest_id}' AS manifest_id, "
            f"md5('{run_id}|' || doc_id || '|version') AS version_id, doc_id, "
            "CAST(total_chunks AS BIGINT) AS chunk_id_count, chunk_ids_md5, 'completed' AS status, "
            "CAST(total_tokens AS BIGINT) AS total_tokens, CAST(total_chunks AS BIGINT) AS total_chunks, "
            f"'{model_name}' AS model_name, CAST({limit} AS BIGINT) AS token_limit, CAST(0.0 AS DOUBLE) AS duration "
            "FROM agg")


def hash_xor_sql(md5: str) -> str:
    """Exclusive or of whole MD5s, as 32 hex digits."""
    half = lambda a: f"lpad(lower(to_hex(bit_xor(('0x' || substr({md5}, {a}, 16))::UBIGINT))), 16, '0')"
    return f"{half(1)} || {half(17)}"


def _two_runs(limit: int) -> str:
    """``e``: entries of documents (run r1), then benchmark items (run r2), of one manifest."""
    norm = (
        "norm AS ("
        "SELECT 'documents:' || CAST(doc_id AS VARCHAR) AS doc_id, CAST(doc_id AS VARCHAR) AS raw_id, 0 AS run_seq, 'r1' AS run_id, "
        "'documents/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM documents "
        "UNION ALL "
        "SELECT 'benchmark:' || CAST(item_id AS VARCHAR), CAST(item_id AS VARCHAR), 1, 'r2', "
        "'benchmark/' || CAST(item_id AS VARCHAR) || '.txt', regexp_replace(text, '\\r\\n?', chr(10), 'g') FROM benchmark)"
    )
    return (chunk_base(limit, norm=norm) + ",\n" + chunk_agg_cte() + ",\n"
            "e AS (SELECT n.raw_id, n.run_seq, n.run_id, md5(n.text) AS content_hash, a.total_chunks, a.total_tokens "
            "FROM norm n JOIN agg a ON a.doc_id = n.doc_id)\n")


def manifest_entries_sql(limit: int) -> str:
    """A4, one row per document and run."""
    return (_two_runs(limit) + "SELECT md5('manifest|r1') AS manifest_id, CAST(run_seq AS BIGINT) AS run_seq, raw_id AS doc_id, content_hash, "
            "md5(run_id || '|' || raw_id || '|version') AS version_id, CAST(total_chunks AS BIGINT) AS total_chunks, "
            "CAST(total_tokens AS BIGINT) AS total_tokens FROM e")


def manifest_append_sql(limit: int, model_name: str = "gpt-4") -> str:
    """V7 / A3: the header over both runs."""
    return (_two_runs(limit) + "SELECT md5('manifest|r1') AS manifest_id, CAST(count(*) AS BIGINT) AS document_count, "
            "CAST(sum(total_chunks) AS BIGINT) AS total_chunks, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, "
            f"'{model_name}' AS model_name, "
            "(SELECT md5(run_id || '|' || raw_id || '|version') FROM e ORDER BY run_seq DESC, raw_id DESC LIMIT 1) AS latest_version_id, "
            f"{hash_xor_sql('content_hash')} AS content_hashes_xor FROM e")


def sentence_strategy_ctes(limit: int) -> str:
    """Strategy B (T7-T10) over ``sent``: ``ch(doc_id, number, text)``, numbers from 0."""
    wsplit = f"string_split_regex(s.s, '[{WS_CLASS_JAVA}]+')"
    cand = "substr(c.w, c.start, c.pos + 1 - c.start + 1)"
    return f"""
sn AS MATERIALIZED (SELECT doc_id, i, s, {cnt('s')} AS n FROM sent),
words AS MATERIALIZED (
  SELECT s.doc_id, s.i, u.j, u.w, {cnt("u.w || ' '")} AS wn
  FROM sn s, unnest({wsplit}) WITH ORDINALITY AS u(w, j)
  WHERE s.n > {limit} AND u.w <> ''),
wp(doc_id, i, j, kind, g, used) AS (
  SELECT doc_id, i, j,
    CASE WHEN wn > {limit} THEN 'C' ELSE 'N' END,
    CASE WHEN wn > {limit} THEN NULL ELSE j END,
    CASE WHEN wn > {limit} THEN 0 ELSE wn END
  FROM words WHERE j = 1
  UNION ALL
  SELECT w.doc_id, w.i, w.j,
    CASE WHEN p.used + w.wn > {limit} THEN (CASE WHEN p.g IS NOT NULL THEN 'N' ELSE 'C' END)
         ELSE (CASE WHEN p.g IS NOT NULL THEN 'A' ELSE 'N' END) END,
    CASE WHEN p.used + w.wn > {limit} THEN (CASE WHEN p.g IS NOT NULL THEN w.j ELSE NULL END)
         ELSE coalesce(p.g, w.j) END,
    CASE WHEN p.used + w.wn > {limit} THEN (CASE WHEN p.g IS NOT NULL THEN w.wn ELSE 0 END)
         ELSE p.used + w.wn END
  FROM wp p JOIN words w ON w.doc_id = p.doc_id AND w.i = p.i AND w.j = p.j + 1),
cw AS (SELECT w.doc_id, w.i, w.j, w.w FROM wp JOIN words w USING (doc_id, i, j) WHERE wp.kind = 'C'),
cs(doc_id, i, j, w, pos, start, sub, piece) AS (
  SELECT doc_id, i, j, w, 0, 1, 0, CAST(NULL AS VARCHAR) FROM cw
  UNION ALL
  SELECT c.doc_id, c.i, c.j, c.w, c.pos + 1,
    CASE WHEN {cnt(cand)} > {limit} THEN (CASE WHEN c.pos + 1 > c.start THEN c.pos + 1 ELSE c.pos + 2 END) ELSE c.start END,
    CASE WHEN {cnt(cand)} > {limit} AND c.pos + 1 > c.start THEN c.sub + 1 ELSE c.sub END,
    CASE WHEN {cnt(cand)} > {limit} AND c.pos + 1 > c.start THEN substr(c.w, c.start, c.pos + 1 - c.start) END
  FROM cs c WHERE c.pos < length(c.w)),
pieces AS (
  SELECT doc_id, i, g AS pj, 0 AS sub, string_agg(w.w, ' ' ORDER BY j) AS t
  FROM wp JOIN words w USING (doc_id, i, j) WHERE wp.kind IN ('N', 'A') GROUP BY doc_id, i, g
  UNION ALL
  SELECT doc_id, i, j, sub, piece FROM cs WHERE piece IS NOT NULL
  UNION ALL
  SELECT doc_id, i, j, sub + 1, substr(w, start) FROM cs WHERE pos = length(w) AND start <= length(w)),
items AS MATERIALIZED (
  SELECT doc_id, kind, t, n, row_number() OVER (PARTITION BY doc_id ORDER BY i, pj, sub) AS k FROM (
    SELECT doc_id, i, 0 AS pj, 0 AS sub, 'S' AS kind, s AS t, n FROM sn WHERE n <= {limit}
    UNION ALL
    SELECT doc_id, i, pj, sub, 'W', t, 0 FROM pieces) x),
pk(doc_id, k, c, used, open) AS (
  SELECT doc_id, k, 0, CASE WHEN kind = 'S' THEN n ELSE 0 END, kind = 'S' FROM items WHERE k = 1
  UNION ALL
  SELECT it.doc_id, it.k,
    CASE WHEN it.kind = 'S' AND p.open AND p.used + it.n <= {limit} THEN p.c ELSE p.c + 1 END,
    CASE WHEN it.kind = 'W' THEN 0 WHEN p.open AND p.used + it.n <= {limit} THEN p.used + it.n ELSE it.n END,
    it.kind = 'S'
  FROM pk p JOIN items it ON it.doc_id = p.doc_id AND it.k = p.k + 1),
ch AS (
  SELECT it.doc_id, p.c AS number, string_agg(it.t, ' ' ORDER BY it.k) AS text
  FROM items it JOIN pk p ON it.doc_id = p.doc_id AND it.k = p.k
  GROUP BY it.doc_id, p.c)"""


def sentence_chunks_sql(limit: int) -> str:
    return ("WITH RECURSIVE\n" + norm_cte() + ",\n" + ok_cte() + ",\n" + sentences_cte("punct") + ",\n"
            + sentence_strategy_ctes(limit) + "\n" + CHUNK_SELECT)


def _k(expr: str, mod: int) -> str:
    return f"({_hash8('md5(' + expr + ')')} % {mod})"


def records_base(limit: int) -> str:
    return (chunk_base(limit) + ",\n"
            "rec AS MATERIALIZED (SELECT doc_id || '-chunk-' || CAST(number AS VARCHAR) AS id, doc_id, number, "
            f"CAST({cnt('text')} AS INTEGER) AS tokens, md5(text) AS content_hash, CAST(length(text) AS BIGINT) AS chars FROM ch)")


def records_update_sql(limit: int) -> str:
    return (records_base(limit) + ",\n"
            "chg AS (SELECT r.id, g.s AS seq, md5(r.id || '|v' || CAST(g.s AS VARCHAR)) AS version_id "
            f"FROM rec r, generate_series(1, 2) g(s) WHERE g.s <= {_k('r.id', 3)}),\n"
            "hist AS (SELECT id, md5('created|' || id) AS version_id, CAST(NULL AS VARCHAR) AS parent FROM rec "
            "UNION ALL SELECT id, version_id, CASE WHEN seq = 1 THEN md5('created|' || id) "
            "ELSE md5(id || '|v' || CAST(seq - 1 AS VARCHAR)) END FROM chg),\n"
            "hagg AS (SELECT id, count(*) AS history_count, "
            f"{hash_xor_sql('link')} AS history_xor "
            "FROM (SELECT *, md5(version_id || '|' || coalesce(parent, '')) AS link FROM hist) l GROUP BY id),\n"
            "fin AS (SELECT id, max(seq) AS n FROM chg GROUP BY id)\n"
            "SELECT r.id, coalesce(md5(r.id || '|v' || CAST(f.n AS VARCHAR)), md5('created|' || r.id)) AS version_id, "
            "CAST(CASE WHEN f.n >= 2 THEN r.tokens + 1 ELSE r.tokens END AS BIGINT) AS tokens, "
            "CASE WHEN f.n = 1 THEN substr(r.content_hash, 1, 6) WHEN f.n = 2 THEN substr(r.content_hash, 7, 6) END AS topic, "
            "CASE WHEN f.n >= 1 THEN 'reviewed' END AS status, "
            "CASE WHEN f.n >= 1 THEN substr(r.content_hash, 13, 4) END AS entity_kind, "
            "CASE WHEN f.n >= 2 THEN CAST(-1 AS BIGINT) ELSE r.chars END AS character_count, "
            "CAST(h.history_count AS BIGINT) AS history_count, h.history_xor "
            "FROM rec r LEFT JOIN fin f ON f.id = r.id JOIN hagg h ON h.id = r.id")


def records_delete_sql(limit: int) -> str:
    return (records_base(limit) + ",\n"
            f"del AS (SELECT id FROM rec WHERE {_k('id', 5)} = 0 "
            f"UNION ALL SELECT id || '-gone' FROM rec WHERE {_k('id', 7)} = 0)\n"
            "SELECT r.id, r.doc_id, CAST(r.number AS BIGINT) AS number, md5('created|' || r.id) AS version_id "
            "FROM rec r WHERE r.id NOT IN (SELECT id FROM del)")


def document_upsert_sql(limit: int) -> str:
    entry = ("array_to_string(list_sort(list_transform(map_entries(fields), lambda e: e.key || '=' || e.value)), ',')")
    return (records_base(limit) + ",\n"
            "ent AS (SELECT doc_id, id AS chunk_id, MAP {'number': CAST(number AS VARCHAR), "
            "'tokens': CAST(tokens AS VARCHAR), 'content_hash': content_hash} AS fields FROM rec),\n"
            "docs AS (SELECT DISTINCT doc_id FROM rec),\n"
            "upd AS (SELECT d.doc_id, g.s AS seq, d.doc_id || '-chunk-' || CAST(g.s * 2 AS VARCHAR) AS chunk_id, "
            "MAP {'reviewed': CAST(g.s AS VARCHAR), 'tokens': '0'} AS fields "
            f"FROM docs d, generate_series(1, 2) g(s) WHERE g.s <= {_k('d.doc_id', 3)}),\n"
            "lastu AS (SELECT doc_id, chunk_id, arg_max(fields, seq) AS nf FROM upd GROUP BY doc_id, chunk_id),\n"
            "m AS (SELECT coalesce(e.doc_id, u.doc_id) AS doc_id, coalesce(e.chunk_id, u.chunk_id) AS chunk_id, "
            "CASE WHEN e.fields IS NULL THEN u.nf WHEN u.nf IS NULL THEN e.fields ELSE map_concat(e.fields, u.nf) END AS fields "
            "FROM ent e FULL OUTER JOIN lastu u ON e.doc_id = u.doc_id AND e.chunk_id = u.chunk_id)\n"
            f"SELECT doc_id, chunk_id, {entry} AS fields_text FROM m")


def records_apply_sql(limit: int) -> str:
    """Two batches in turn: what they do to each record, in closed form."""
    return (records_base(limit) + ",\n"
            "all_records AS (SELECT id, doc_id, number, tokens, content_hash, "
            f"{_k('id', 3)} AS n, {_k('id', 5)} = 0 AS gone_first, false AS added, md5('created|' || id) AS v0 FROM rec "
            "UNION ALL SELECT doc_id || '-summary', doc_id, 0, 0, NULL, 0, false, true, md5('summary|' || doc_id) "
            f"FROM rec WHERE number = 1 AND {_k('doc_id', 7)} = 1),\n"
            f"fin AS (SELECT *, CASE WHEN n > 0 THEN md5(id || '|v' || CAST(n AS VARCHAR)) ELSE v0 END AS va, {_k('id', 4)} = 1 AS again "
            f"FROM all_records WHERE NOT gone_first AND {_k('id', 9)} <> 0),\n"
            "hist AS (SELECT id, v0 AS version_id, '' AS parent FROM fin "
            "UNION ALL SELECT id, md5(id || '|v1'), v0 FROM fin WHERE n >= 1 "
            "UNION ALL SELECT id, md5(id || '|v2'), md5(id || '|v1') FROM fin WHERE n >= 2 "
            "UNION ALL SELECT id, md5(id || '|w1'), va FROM fin WHERE again),\n"
            f"hagg AS (SELECT id, count(*) AS history_count, {hash_xor_sql('link')} AS history_xor "
            "FROM (SELECT *, md5(version_id || '|' || parent) AS link FROM hist) l GROUP BY id)\n"
            "SELECT f.id, doc_id, CASE WHEN again THEN md5(f.id || '|w1') ELSE va END AS version_id, CAST(number AS BIGINT) AS number, "
            "CAST(CASE WHEN again THEN 1 WHEN n = 2 THEN tokens + 1 ELSE tokens END AS BIGINT) AS tokens, "
            "CASE n WHEN 1 THEN substr(content_hash, 1, 6) WHEN 2 THEN substr(content_hash, 7, 6) END AS topic, "
            "CASE WHEN n >= 1 THEN 'reviewed' END AS status, CASE WHEN again THEN 'second' END AS note, "
            "CASE WHEN added THEN 'summary' END AS kind, CAST(h.history_count AS BIGINT) AS history_count, h.history_xor "
            "FROM fin f JOIN hagg h ON h.id = f.id")


def documents_apply_sql(limit: int) -> str:
    entry = ("array_to_string(list_sort(list_transform(map_entries(fields), lambda e: e.key || '=' || e.value)), ',')")
    merge = ("SELECT coalesce(e.doc_id, u.doc_id) AS doc_id, coalesce(e.chunk_id, u.chunk_id) AS chunk_id, "
             "CASE WHEN e.fields IS NULL THEN u.fields WHEN u.fields IS NULL THEN e.fields ELSE map_concat(e.fields, u.fields) END AS fields "
             "FROM {0} e FULL OUTER JOIN {1} u ON e.doc_id = u.doc_id AND e.chunk_id = u.chunk_id")
    return (records_base(limit) + ",\n"
            "ent AS (SELECT doc_id, id AS chunk_id, MAP {'number': CAST(number AS VARCHAR), "
            "'tokens': CAST(tokens AS VARCHAR), 'content_hash': content_hash} AS fields FROM rec),\n"
            f"docs AS (SELECT DISTINCT doc_id, {_k('doc_id', 3)} AS n, {_k('doc_id', 2)} = 0 AS again FROM rec),\n"
            "one AS (SELECT doc_id, doc_id || '-chunk-' || CAST(s * 2 AS VARCHAR) AS chunk_id, "
            "MAP {'reviewed': CAST(s AS VARCHAR), 'tokens': '0'} AS fields FROM docs, generate_series(1, 2) g(s) WHERE s <= n),\n"
            f"m1 AS ({merge.format('ent', 'one')}),\n"
            "two AS (SELECT doc_id, doc_id || '-chunk-' || CAST(s + 1 AS VARCHAR) AS chunk_id, MAP {'second': CAST(s AS VARCHAR)} AS fields "
            "FROM docs, generate_series(1, 2) g(s) WHERE again),\n"
            f"m2 AS ({merge.format('m1', 'two')})\n"
            f"SELECT doc_id, chunk_id, CAST(NULL AS VARCHAR) AS version_id, {entry} AS fields_text FROM m2 "
            "UNION ALL SELECT doc_id, '', CASE WHEN again THEN md5(doc_id || '|ew2') WHEN n > 0 THEN md5(doc_id || '|dv' || CAST(n AS VARCHAR)) "
            "ELSE md5('r1|' || doc_id || '|version') END, NULL FROM docs")


def import_journal_sql(limit: int) -> str:
    """States of run 0 (documents), 1 (nothing: fails) and 2 (benchmark items)."""
    total = lambda c: f"(SELECT CAST({c} AS BIGINT) FROM e WHERE run_seq = "
    row = lambda v, seq, status, error, done, of: (
        f"SELECT CAST({v} AS BIGINT) AS version, CAST({seq} AS BIGINT) AS run_seq, CAST(1 AS BIGINT) AS attempt, 'r{seq + 1}' AS run_id, "
        f"'{status}' AS status, {error} AS error, {done} AS has_duration, "
        + ", ".join(f"{total(c)}{of}) AS {name}" if of is not None else f"CAST(-1 AS BIGINT) AS {name}"
                    for c, name in (("count(*)", "document_count"), ("sum(total_chunks)", "total_chunks"), ("sum(total_tokens)", "total_tokens")))
    )
    rows = [
        row(0, 0, "processing", "''", "false", None), row(1, 0, "completed", "''", "true", 0),
        row(2, 1, "processing", "''", "false", None), row(3, 1, "failed", "'ValueError: No documents to import'", "true", None),
        row(4, 2, "processing", "''", "false", None), row(5, 2, "completed", "''", "true", 1),
    ]
    return _two_runs(limit) + "\nUNION ALL ".join(rows)


def concurrent_imports_sql(limit: int) -> str:
    return (_two_runs(limit) + "SELECT CAST(count(*) AS BIGINT) AS document_count, CAST(sum(total_chunks) AS BIGINT) AS total_chunks, "
            f"CAST(sum(total_tokens) AS BIGINT) AS total_tokens, {hash_xor_sql('content_hash')} AS content_hashes_xor, "
            "CAST(count(*) AS BIGINT) AS entries, CAST(count(*) AS BIGINT) AS documents, CAST(sum(total_tokens) AS BIGINT) AS entry_tokens, "
            "CAST(sum(total_chunks) AS BIGINT) AS chunk_rows, CAST(sum(total_tokens) AS BIGINT) AS chunk_tokens FROM e")


def rule_encode_sql() -> str:
    toks = f"regexp_extract_all(text, {q(TOKEN_PATTERN_JAVA)})"
    ids_text = f"array_to_string(list_transform({toks}, lambda x: md5(x)), ' ')"
    return ("WITH " + norm_cte() + "\n"
            f"SELECT doc_id, CAST(len({toks}) AS BIGINT) AS n_ids, md5({ids_text}) AS decoded_ids_md5, "
            f"md5(list_extract({toks}, 1)) AS first_id FROM norm")


def vocabulary_decode_sql() -> str:
    toks = f"regexp_extract_all(text, {q(TOKEN_PATTERN_JAVA)})"
    return ("WITH " + norm_cte() + "\n"
            f"SELECT doc_id, md5(array_to_string({toks}, ' ')) AS decoded_md5, CAST(len({toks}) AS BIGINT) AS n_tokens FROM norm")


def vocabulary_ids_sql() -> str:
    toks = f"regexp_extract_all(text, {q(TOKEN_PATTERN_JAVA)})"
    return ("WITH " + norm_cte() + f""",
toks AS (SELECT doc_id, {toks} AS t FROM norm),
vocab AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id
          FROM (SELECT DISTINCT unnest(t) AS token FROM toks)),
occ AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM toks),
enc AS (SELECT doc_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS ids FROM occ JOIN vocab USING (token) GROUP BY doc_id)
SELECT toks.doc_id, CAST(len(t) AS BIGINT) AS n_ids, md5(coalesce(ids, '')) AS ids_md5, md5(array_to_string(t, ' ')) AS decoded_md5
FROM toks LEFT JOIN enc ON toks.doc_id = enc.doc_id""")


def vocabulary_extended_sql() -> str:
    toks = lambda source: f"SELECT DISTINCT unnest(regexp_extract_all(text, {q(TOKEN_PATTERN_JAVA)})) AS token FROM {source}"
    return ("WITH " + norm_cte() + f""",
earlier AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM ({toks("norm")})),
later AS ({toks("(SELECT text FROM conversations UNION ALL SELECT text FROM benchmark)")}),
added AS (SELECT token, (SELECT count(*) FROM earlier) + row_number() OVER (ORDER BY token) - 1 AS id
          FROM later WHERE token NOT IN (SELECT token FROM earlier))
SELECT token, CAST(id AS BIGINT) AS id, CAST(0 AS BIGINT) AS version FROM earlier
UNION ALL SELECT token, CAST(id AS BIGINT) AS id, CAST(1 AS BIGINT) AS version FROM added""")
