"""Check SQL (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op5_chat_format"] = r"""
WITH turns AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
    SELECT *,
        length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), ']', '&rsqb;'))
        + CASE role WHEN 'system' THEN 16 - 1 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 6 + length(role) + 1 + 7 END AS shown
    FROM turns
), whole AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS digest,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
        sum(shown)::BIGINT AS formatted_chars
    FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(digest) AS turns_sha256, length(learned)::BIGINT AS loss_chars,
    sha256(learned) AS loss_sha256, formatted_chars
FROM whole
"""

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_SHINGLES = """list_distinct(CASE WHEN len(w) = 0 THEN []
        ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')) END)"""

#: Documents and items that share a benchmark item's shingles to 0.8 or more.
ORACLES["op9_decontamination"] = f"""
WITH items AS (
    SELECT item_id, unnest(s) AS shingle, len(s) AS n_shingles
    FROM (SELECT item_id, {_SHINGLES} AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark))
), docs AS (
    SELECT doc_id, unnest({_SHINGLES}) AS shingle FROM (SELECT doc_id, {_WORDS} AS w FROM documents)
)
SELECT doc_id, item_id, count(*) AS n_shared, n_shingles, count(*) / n_shingles AS containment
FROM docs JOIN items USING (shingle)
GROUP BY doc_id, item_id, n_shingles
HAVING count(*) / n_shingles >= 0.8
"""
