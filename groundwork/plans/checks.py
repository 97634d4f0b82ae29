"""SQL for queries whose rules need look-ahead or folds: the same rows by marking what a look-ahead would see, and by recursion."""

from __future__ import annotations

from groundwork.functions.redact import LIMIT, MASK
from groundwork.operators.analyses import SCHEMA_TEXT
from groundwork.operators.chunks import TOTAL, chunk_chars
from groundwork.plans.derive import ALIASES_SQL, LINKS_SQL
from groundwork.plans.runs import _NORM
from groundwork.plans.text import _CLEAN

QUERIES: dict = {}

_BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
#: A full stop before a digit is marked as chr(1) while sentences are cut.
_SENTENCES = r"""sentences AS (SELECT doc_id, list_transform(list_filter(regexp_extract_all(regexp_replace(text, '\.([0-9])', chr(1) || '\1', 'g'), '[^。！？!?\n.]*(?:\n|[。！？!?]+|\.|$)'), lambda s: s <> ''), lambda s: replace(s, chr(1), '.')) AS parts, text FROM {src})"""
_BARE = f"list_filter(list_transform(parts, lambda s: trim(s, {_BLANKS})), lambda s: s <> '')"


def _chunked(max_chars: int) -> str:
    """chunked (doc_id, chunk_index, chunk_total, chunk): greedy packing, one piece of each document in every step."""
    return (
        _CLEAN.format(text="text", src="documents").strip()
        + f", cut AS (SELECT doc_id, left(text, {TOTAL}) AS text FROM cleaned), "
        + _SENTENCES.format(src="cut")
        + f""", pieces AS (SELECT doc_id, flatten(list_transform({_BARE}, lambda s: list_transform(range(0, (length(s) - 1) // {max_chars} + 1), lambda i: substr(s, CAST(i * {max_chars} + 1 AS BIGINT), {max_chars})))) AS ps FROM sentences),
sized AS (SELECT doc_id, unnest(list_transform(ps, lambda p: length(p))) AS n, generate_subscripts(ps, 1) AS i FROM pieces),
steps AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS first, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS last, CAST(NULL AS BIGINT) AS ended FROM pieces
UNION ALL SELECT s.doc_id, z.i, CASE WHEN z.i > s.first AND size + n > {max_chars} THEN CASE WHEN last + n <= {max_chars} THEN z.i - 1 ELSE z.i END ELSE s.first END,
CASE WHEN z.i > s.first AND size + n > {max_chars} THEN CASE WHEN last + n <= {max_chars} THEN last + n ELSE n END ELSE size + n END, n, CASE WHEN z.i > s.first AND size + n > {max_chars} THEN s.first END
FROM steps s JOIN sized z ON z.doc_id = s.doc_id AND z.i = s.i + 1),
bounds AS (SELECT doc_id, ended AS first, i - 1 AS last FROM steps WHERE ended IS NOT NULL UNION ALL SELECT doc_id, arg_max(first, i), max(i) FROM steps GROUP BY doc_id HAVING max(i) > 0),
chunked AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY last) - 1 AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS chunk_total, array_to_string(list_slice(ps, first, last), '') AS chunk FROM bounds JOIN pieces USING (doc_id))"""
    )


_NUMBERS = r"""blanked AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?\s*%') AS percents, regexp_extract_all(regexp_replace(text, '[0-9]+(?:\.[0-9]+)?\s*%', ' ', 'g'), '[0-9]+(?:\.[0-9]+)?') AS plain FROM documents),
tokens AS (SELECT doc_id, unnest(list_concat(percents, plain)) AS raw, generate_subscripts(list_concat(percents, plain), 1) - 1 AS ord, len(percents) AS n FROM blanked),
numbers AS (SELECT doc_id, CAST(ord AS INTEGER) AS ord, raw, CAST(TRY_CAST(regexp_extract(raw, '^[0-9.]+') AS DECIMAL(38,10)) AS DOUBLE) AS value, CASE WHEN ord < n THEN 'percent' ELSE 'plain' END AS kind, CAST(1 AS BIGINT) AS scale, false AS fuzzy FROM tokens)"""


# What the redaction looks for, without its look-ahead.
_KEYS = r"(?i)((?:api[-_]?key|access[-_]?token|refresh[-_]?token|token|secret|password|passwd|cookie|authorization|signature)\s*[=:]\s*)"


def _scrubbed(text: str) -> str:
    """Values that the last pattern leaves alone are marked as chr(2), which its values can't begin with."""
    out = rf"regexp_replace({text}, 'sk-[A-Za-z0-9_\-]{{8,}}', '{MASK}', 'g')"
    out = rf"regexp_replace({out}, '(?i)(bearer)(\s+)([A-Za-z0-9._\-]{{8,}})', '\1\2{MASK}', 'g')"
    out = rf"regexp_replace({out}, '{_KEYS}((?:bearer|basic|token)\b)', '\1' || chr(2) || '\2', 'g')"
    return rf"""replace(regexp_replace({out}, '{_KEYS}([^\s,;''"\x02]{{4,}})', '\1{MASK}', 'g'), chr(2), '')"""


def _masks(text: str) -> str:
    return f"(length({text}) - length(replace({text}, '{MASK}', ''))) // {len(MASK)}"


_PROMPT = f"'Analyse the text below and answer in JSON.' || chr(10) || CASE WHEN chunk_total > 1 THEN 'Part ' || (chunk_index + 1) || ' of ' || chunk_total || ' of a long text: analyse this part only.' || chr(10) ELSE '' END || chr(10) || 'Fields: {SCHEMA_TEXT}' || chr(10) || chr(10) || '<<<CONTENT' || chr(10) || chunk || chr(10) || 'CONTENT>>>'"

ORACLE_SQL = {
    "p16_sentences": f"WITH {_SENTENCES.format(src='documents')} SELECT doc_id, CAST(len({_BARE}) AS BIGINT) AS n_sentences, array_to_string(parts, '') = text AS lossless FROM sentences",
    "k3_chunks": f"WITH RECURSIVE {_chunked(2000)} SELECT doc_id, chunk_index, chunk_total, chunk FROM chunked",
    "k4_prompts": f"WITH RECURSIVE {_chunked(chunk_chars())}, p AS (SELECT *, {_PROMPT} AS prompt FROM chunked) SELECT doc_id || ':' || chunk_index AS prompt_id, chunk_index AS part, length(prompt) AS n_chars, contains(prompt, 'Part ') AS has_place FROM p",
    "g2_numbers": f"WITH {_NUMBERS} SELECT * FROM numbers",
    "f5_key_numbers": f"WITH {_NUMBERS} SELECT doc_id, count(*) FILTER (WHERE kind = 'percent' OR scale > 1 OR value IS NULL OR abs(value) >= 10) AS n_key FROM numbers GROUP BY doc_id",
    "p21_redact": f"""WITH t AS (SELECT doc_id, regexp_replace(text, '["'']', '', 'g') AS text FROM documents), s AS (SELECT doc_id, text, {_scrubbed('text')} AS done FROM t) SELECT doc_id, {_masks('done')} - {_masks('text')} AS redaction_hits, length(done) AS n_chars FROM s""",
    "p22_mask_columns": f"WITH s AS (SELECT *, {_scrubbed('text')} AS done FROM conversations) SELECT conv_id, turn, {_scrubbed('role')} AS role, CASE WHEN length(done) > {LIMIT} THEN left(done, {LIMIT}) || '...<truncated ' || (length(done) - {LIMIT}) || ' chars>' ELSE done END AS user_text, '{MASK}' AS api_key_hint, 'plain' AS content_id FROM s",
    "d11_apply_merges": f"""WITH {ALIASES_SQL}, {LINKS_SQL}, g AS (SELECT s.id AS s, t.id AS t, t.canonical_name AS tn, s.canonical_name AS sn FROM nation JOIN entities s ON s.id = CAST(n_nationkey AS VARCHAR) JOIN entities t ON t.id = CAST(n_nationkey + 1 AS VARCHAR) WHERE n_nationkey % 2 = 0),
f AS (SELECT s, t, tn, sn AS surface FROM g UNION SELECT s, t, tn, alias FROM g JOIN aliases ON entity_id = s),
o AS (SELECT f.*, CASE WHEN surface = tn OR a.entity_id = t THEN 'owned' WHEN a.entity_id IS NULL OR a.entity_id = s THEN 'to_move' ELSE 'conflict' END AS label FROM f LEFT JOIN aliases a ON a.alias = surface),
m AS (SELECT * FROM o WHERE label <> 'conflict'), kept AS (SELECT entity_id, alias FROM aliases a WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.s = a.entity_id AND m.surface = a.alias)),
na AS (SELECT * FROM kept UNION ALL SELECT DISTINCT t, surface FROM m WHERE surface <> tn AND surface NOT IN (SELECT alias FROM kept)),
nl AS (SELECT entity_id, count(*) AS n FROM (SELECT DISTINCT content_id, coalesce(g.t, entity_id) AS entity_id FROM links LEFT JOIN g ON g.s = entity_id) GROUP BY entity_id)
SELECT e.id AS entity_id, canonical_name, coalesce((SELECT string_agg(alias, '|' ORDER BY alias) FROM na WHERE na.entity_id = e.id), '') AS aliases, coalesce(n, 0) AS n_links FROM entities e LEFT JOIN nl ON nl.entity_id = e.id
WHERE e.id NOT IN (SELECT s FROM g) OR e.id IN (SELECT s FROM o WHERE label = 'conflict')""",
    "k16_steps": f"WITH {_CLEAN.format(text='text', src='documents').strip()}, h AS (SELECT doc_id, doc_id % 8 = 6 AS bad, min(doc_id) OVER (PARTITION BY lang, {_NORM}) <> doc_id AS twin FROM documents) SELECT h.doc_id, CASE WHEN twin THEN 3 WHEN bad THEN 6 ELSE 13 END AS n_steps, CASE WHEN twin THEN 'deduplicate' WHEN bad THEN 'analyze' ELSE 'complete' END AS last_step, CASE WHEN bad AND NOT twin THEN 'LLM_INVALID_OUTPUT' END AS error_type, CASE WHEN NOT twin THEN CAST(length(left(c.text, {TOTAL})) AS VARCHAR) END AS n_chars, CASE WHEN bad AND NOT twin THEN 'analyze' END AS failed_step FROM h JOIN cleaned c USING (doc_id)",
    "k15_recovery": "SELECT doc_id, CASE WHEN doc_id % 8 = 6 THEN 'failed' ELSE 'completed' END AS outcome, CASE WHEN doc_id % 8 = 6 THEN 'LLM_INVALID_OUTPUT' END AS error_type FROM documents WHERE doc_id % 3 = 0",
}
