"""The queries of this subpackage, with production parameters over whole tables, and DuckDB SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, html_text, langid, mtree, packing, quality, secret_scan, sharding, simhash, spm
from .common import table


def op1_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, k=10)


def op2_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op4_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality.quality_rules(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def op6_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_conversations(rows.unionByName(chat.fixture(spark))))


def op7_lattice_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode_documents(table(spark, sf_dir, "documents"))


def op8_family_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 40)


def op10_bilstm_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mtree_topk,
        op2_nnls_packing,
        op3_simhash_bktree,
        op4_secret_ownership,
        op5_quality_rules,
        op6_chat_template,
        op7_lattice_pieces,
        op8_family_svm,
        op9_feistel_shards,
        op10_bilstm_blocks,
    )
}

# -- DuckDB SQL for the same rows ---------------------------------------------
_TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT * FROM (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s) WHERE rank <= 10"""


def _quality_sql() -> str:
    """The rule table as SQL over metrics counted with list functions."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END"
    metrics = {
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "stop_ratio": ratio("n_stop", "n_words"),
        "letter_word_ratio": ratio("n_letters", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "bullet_line_ratio": ratio("n_bullets", "n_lines"),
        "ellipsis_line_ratio": ratio("n_dots", "n_lines"),
    }
    broken = []
    for r in quality.RULES:
        tests = [f"({r.metric}) < {r.least!r}" for _ in [0] if r.least is not None] + [f"({r.metric}) > {r.most!r}" for _ in [0] if r.most is not None]
        broken.append(f"CASE WHEN {' OR '.join(tests)} THEN '{r.name}' END")
    return f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
  wins AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 1)) AS i)),
  again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) WHERE c > 1),
  covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(3) r(k) GROUP BY doc_id),
  m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS n_stop,
    len(list_filter(ws, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_letters, len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*[-*•]'))) AS n_bullets,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$'))) AS n_dots FROM w LEFT JOIN covered USING (doc_id)),
  r AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in metrics.items())} FROM m),
  f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', {", ".join(broken)}) AS failed_rules FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM f"""


def _chat_sql() -> str:
    """Digests straight from the turns; escaped lengths by the same replacements."""
    t = chat.TEMPLATE
    quote = lambda v: "'" + v.replace("'", "''") + "'"

    def escaped(col: str) -> str:
        out = f"replace({col}, '&', '&amp;')"
        for i, c in enumerate(t.controls):
            out = f"replace({out}, {quote(c)}, '&c{i};')"
        return out

    role = f"replace(replace({escaped('role')}, ']', '&b;'), chr(10), '&n;')"
    fixed = len(t.opening.replace("{role}", "")) + len(t.closing)
    moves = ", ".join(f"({quote(a)}, {quote(b)})" for a, b, _ in t.transitions)
    order = "ORDER BY turn NULLS FIRST, role, text"
    said = "</s>[INST] ok [/INST]"
    return f"""WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{said}' UNION ALL SELECT -7, 1, 'assistant', '{said}'),
  steps AS (SELECT *, (coalesce(lag(role) OVER (PARTITION BY conv_id {order}), 'start'), role) IN ({moves}) AS fine,
    row_number() OVER (PARTITION BY conv_id {order}) = count(*) OVER (PARTITION BY conv_id) AS last FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({fixed} + length({role}) + length({escaped('text')}))::BIGINT AS formatted_chars,
  bool_and(fine) AND bool_or(last AND role = 'assistant') AS valid, count(*) FILTER (NOT fine) AS bad_turns FROM steps GROUP BY conv_id"""


def _secrets_sql() -> str:
    """Positions as sums of the lengths between and of matches; ownership by distinct counts of values."""
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    every = {**secret_scan.PATTERNS, "owned": (secret_scan.WIDE, 0, 20)}
    parts = []
    for k, name in enumerate(secret_scan.KINDS):
        pattern, group, least = every[name]
        p = quote(pattern)
        value = f"regexp_extract(v, {p}, {group})" if group else "v"
        parts.append(
            f"""SELECT doc_id, source, {k} AS kind, s AS start, s + length(v) AS stop, {value} AS secret FROM (
    SELECT doc_id, source, found[i] AS v, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS s
    FROM (SELECT doc_id, source, string_split_regex(coalesce(text, ''), {p}) AS gaps, regexp_extract_all(coalesce(text, ''), {p}) AS found FROM documents), LATERAL (SELECT unnest(range(1, len(found) + 1)) AS i))
  WHERE length({value}) >= {least}"""
        )
    names = ", ".join(quote(k) for k in secret_scan.KINDS)
    told = f"string_agg([{names}][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop)"
    return f"""WITH hits AS ({" UNION ALL ".join(parts)}),
  each AS (SELECT * FROM hits h WHERE kind < 3 OR (regexp_matches(secret, '[0-9]') AND regexp_matches(secret, '[A-Za-z]')
    AND NOT EXISTS (SELECT 1 FROM hits b WHERE b.doc_id = h.doc_id AND b.kind < 3 AND b.start < h.stop AND h.start < b.stop))),
  known AS (SELECT secret, count(DISTINCT source) <= 1 AND count(DISTINCT doc_id) <= 3 AS live FROM each GROUP BY secret),
  judged AS (SELECT each.*, live FROM each JOIN known USING (secret)),
  by_doc AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    {told} FILTER (kind < 3) AS base, {told} FILTER (kind < 3 OR live) AS spans, count(*) FILTER (live) AS n_owned, count(*) FILTER (NOT live) AS n_copied FROM judged GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned, coalesce(n_copied, 0) AS n_copied FROM documents LEFT JOIN by_doc USING (doc_id)"""


def _crc_table() -> list[int]:
    """The sixteen steps of CRC-32 by half bytes, from its polynomial."""
    out = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


def _shards_sql(n_shards: int = 40, seed: int = 17) -> str:
    """Row numbers by plain order; the network as a recursive query, a round a step; CRC-32 over half bytes, low one first."""
    nibbles = "list_transform(string_split(regexp_replace(hex(encode(text)), '(.)(.)', '\\2\\1', 'g'), ''), lambda x: instr('0123456789ABCDEF', x) - 1)"
    crc = f"CASE WHEN coalesce(text, '') = '' THEN 0 ELSE xor(list_reduce({nibbles}, lambda a, x: xor(a // 16, {_crc_table()}[xor(a, x) % 16 + 1]), 4294967295::BIGINT), 4294967295) END"
    keys = ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(sharding.round_keys(seed)))
    p = sharding.PRIME
    half = "(CASE WHEN i % 2 = 0 THEN r ELSE l END * ka + kb)"
    mixed = f"((({half} % {p}) * ({half} % {p}) + kc) % {p})"
    return f"""WITH RECURSIVE keys(i, ka, kb, kc) AS (VALUES {keys}),
  narrow AS (SELECT doc_id, (16 + coalesce(strlen(text), 0))::BIGINT AS size, ({crc})::BIGINT AS text_crc32 FROM documents),
  numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_number FROM narrow),
  size AS (SELECT n, floor(sqrt(n - 1))::BIGINT + 1 AS a FROM (SELECT count(*) AS n FROM documents)),
  grid AS (SELECT n, a, (n + a - 1) // a AS b FROM size),
  walk AS (SELECT row_number, row_number % a AS l, row_number // a AS r, 0 AS k FROM numbered, grid
    UNION ALL SELECT row_number, CASE WHEN k < {sharding.ROUNDS} AND k % 2 = 0 THEN (l + {mixed}) % a ELSE l END, CASE WHEN k < {sharding.ROUNDS} AND k % 2 = 1 THEN (r + {mixed}) % b ELSE r END,
      CASE WHEN k = {sharding.ROUNDS} THEN 0 ELSE k + 1 END FROM walk JOIN keys ON i = k % {sharding.ROUNDS}, grid WHERE k < {sharding.ROUNDS} OR l + r * a >= n),
  placed AS (SELECT row_number, l + r * a AS place FROM walk, grid WHERE k = {sharding.ROUNDS} AND l + r * a < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place % {n_shards})::INT AS shard, place // {n_shards} AS slot, NULL::INT AS grown_shard, row_number FROM numbered JOIN placed USING (row_number)"""


ORACLE_SQL: dict[str, str] = {"op1_mtree_topk": _TOP_K, "op4_secret_ownership": _secrets_sql(), "op5_quality_rules": _quality_sql(), "op6_chat_template": _chat_sql(), "op9_feistel_shards": _shards_sql()}
