"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = {
    "op1_secret_scan": ("secret_scan", "op1"),
    "op2_chat_format": ("chat_format", "op2"),
    "op3_toxicity": ("toxicity", "op3"),
    "op4_quality_discriminant": ("quality", "op4"),
    "op5_imatch": ("imatch", "op5"),
    "op6_best_fit_packing": ("packing", "op6"),
    "op7_media_copies": ("media", "op7"),
    "op8_bpe_rank_array": ("bpe", "op8"),
    "op9_warc_index_merge": ("warc", "op9"),
    "op10_ngram_jaccard_join": ("jaccard_join", "op10"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f".{module}", __package__), function) for name, (module, function) in MODULES.items()}


#: Control strings of chat_format in a regular expression, longest first.
MARKS = r"<</SYS>>|\[ANSWER\]|<<SYS>>|\[/INST\]|\[/ROLE\]|\[INST\]|\[ROLE\]|</s>|<s>"

ORACLES = {
    "op2_chat_format": rf"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) t),
written AS (SELECT *, length(regexp_replace(text, '(\\*)({MARKS})', '\1\1\\\2', 'g')) AS n, CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 14
    ELSE 21 + length(regexp_replace(role, '(\\*)({MARKS})', '\1\1\\\2', 'g')) END AS around,
  regexp_matches(text, '{MARKS}') OR (role NOT IN ('system', 'user', 'assistant') AND regexp_matches(role, '{MARKS}')) AS escaped FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(n + around))::BIGINT AS formatted_chars, count(*) FILTER (escaped) AS escaped_turns FROM written GROUP BY conv_id""",
    "op9_warc_index_merge": """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM d LEFT JOIN f USING (payload_digest)""",
    "op10_ngram_jaccard_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 3 THEN [array_to_string(a, ' ')] ELSE list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 90 * (na.n + nb.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a""",
}


def oracle_sql() -> dict[str, str]:
    """What SQL can express in reasonable time on whole tables; the rest is tested against brute force."""
    return dict(ORACLES)
