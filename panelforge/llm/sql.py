"""SQL of conversation repair, chat formatting and vector codes."""

from __future__ import annotations

from panelforge.llm import chat_format, vector_codes

_CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295)"
)

#: Conversation repair: layers of (conversation, row, state) with the least cost, audit and what it says, row by row.
OP11_SQL = f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations
),
src AS (SELECT *, {_CRC32} % 20 AS kind FROM named),
dam AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM src WHERE kind <> 0
),
r AS (
  SELECT *, left(role, 1) AS ini, regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') AS solid,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM dam
),
f AS (
  SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair,
    CASE WHEN solid = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM r
),
opt(p, ini, edit, q, cost, said) AS (VALUES
  (0, 's', 'K', 1, 0, NULL), (0, 'u', 'K', 2, 0, NULL), (1, 'u', 'K', 2, 0, NULL), (2, 'a', 'K', 3, 0, NULL), (3, 'u', 'K', 2, 0, NULL),
  (0, NULL, 'R', 2, 3, 'user'), (1, NULL, 'R', 2, 3, 'user'), (2, NULL, 'R', 3, 3, 'assistant'), (3, NULL, 'R', 2, 3, 'user'),
  (0, NULL, 'D', 0, 4, NULL), (1, NULL, 'D', 1, 4, NULL), (2, NULL, 'D', 2, 4, NULL), (3, NULL, 'D', 3, 4, NULL)
),
ins(p, q, cost, audit, said) AS (VALUES
  (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
  (0, 2, 3, 'I', 'user:\n'), (1, 2, 3, 'I', 'user:\n'), (3, 2, 3, 'I', 'user:\n'), (2, 3, 3, 'I', 'assistant:\n'),
  (0, 3, 6, 'II', 'user:\nassistant:\n'), (1, 3, 6, 'II', 'user:\nassistant:\n')
),
ids AS (SELECT DISTINCT conv_id FROM conversations),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, q AS st, {{'cost': cost, 'audit': audit, 'said': said}} AS b FROM ids, ins WHERE p = 0
  UNION ALL
  SELECT f.conv_id, f.i, n.q, min({{
    'cost': CAST(w.b.cost + o.cost + CASE WHEN f.fault = 'truncated' AND o.edit <> 'D' THEN 3 ELSE 0 END + n.cost AS INTEGER),
    'audit': w.b.audit || o.edit || n.audit,
    'said': w.b.said || CASE WHEN o.edit = 'D' THEN '' ELSE coalesce(o.said, f.role) || ':' || f.text || chr(10) END || n.said
  }})
  FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
    JOIN opt o ON o.p = w.st AND coalesce(o.ini = f.ini, true) AND (o.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
    JOIN ins n ON n.p = o.q
  GROUP BY 1, 2, 3
),
told AS (
  SELECT ids.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(f.i) AS n
  FROM ids LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM ids.conv_id GROUP BY 1
),
best AS (SELECT conv_id, i, min(b) AS b FROM walk WHERE st IN (0, 3) GROUP BY 1, 2)
SELECT t.conv_id, gaps, blank, duplicate, truncated, illegal, CAST(b.cost AS BIGINT) AS cost, b.audit AS audit, sha256(left(b.said, greatest(len(b.said) - 1, 0))) AS repaired_sha256
FROM told t JOIN best ON best.conv_id IS NOT DISTINCT FROM t.conv_id AND best.i = t.n
"""


def _escaped(text: str) -> str:
    at = f"replace({text}, '&', '&amp;')"
    for mark in chat_format.CHAT.controls():
        at = f"replace({at}, '{mark}', '{chat_format.ENTITIES[mark[0]]}{mark[1:]}')"
    return at


_MARKS = " ".join(f"WHEN '{role}' THEN {len(t.before) + len(t.after)}" for role, t in chat_format.CHAT.roles.items())
_OTHER = len(chat_format.CHAT.other.before) + len(chat_format.CHAT.other.after) + len(chat_format.CHAT.named)
_STEPS = ", ".join(f"'{a}>{b}'" for a, b in (("", "system"), ("", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")))

#: Chat formatting: what formatting and reading back must give, from the turns themselves.
OP12_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
),
t AS (
  SELECT *, row_number() OVER w AS i, coalesce(lag(role) OVER w, '') || '>' || role AS step,
    len({_escaped("text")}) + CASE role {_MARKS} ELSE {_OTHER} + len({_escaped("role")}) END AS n
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, {_escaped("text")})
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars, bool_and(step IN ({_STEPS})) AND arg_max(role, i) = 'assistant' AS valid
FROM t GROUP BY conv_id
"""


def _codes() -> str:
    parts, entries = vector_codes.PARTS, vector_codes.ENTRIES
    steps = [
        f"""
WITH v0 AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, len(embedding) AS n, list_transform(embedding, lambda x: floor({vector_codes.SCALE} * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE len(embedding) > 0 AND len(embedding) % {parts} = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
v AS (
  SELECT row_number() OVER (ORDER BY rid) AS rid, vec_id, label, n, x FROM v0
  WHERE n = (SELECT n FROM v0 GROUP BY n ORDER BY count(*) DESC, n LIMIT 1)
),
y AS MATERIALIZED (SELECT rid, part, list_slice(x, part * n // {parts} + 1, (part + 1) * n // {parts}) AS y FROM v, range({parts}) p(part)),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, y FROM y WHERE rid <= {entries})"""
    ]
    for k in range(vector_codes.ROUNDS + 1):
        steps.append(
            f"""
a{k} AS MATERIALIZED (
  SELECT rid, part, min({{'d': list_inner_product(y.y, y.y) - 2 * list_inner_product(y.y, b.y) + list_inner_product(b.y, b.y), 'entry': b.entry}}) AS m
  FROM y JOIN b{k} b USING (part) GROUP BY 1, 2
)"""
        )
        if k < vector_codes.ROUNDS:
            steps.append(
                f"""
b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(n.y, b.y) AS y FROM b{k} b LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY j) AS y FROM (
      SELECT part, a{k}.m.entry AS entry, j, floor(sum(y.y[j]) / count(*)) AS mean FROM a{k} JOIN y USING (rid, part), unnest(range(1, len(y.y) + 1)) u(j) GROUP BY 1, 2, 3
    ) GROUP BY 1, 2
  ) n ON n.part = b.part AND n.entry = b.entry
)"""
            )
    last = vector_codes.ROUNDS
    steps.append(
        f"""
codes AS (SELECT rid, string_agg(format('{{:02x}}', m.entry), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{last} GROUP BY 1),
book AS (SELECT sha256(string_agg(CAST(CAST(y[j] AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, j)) AS h FROM b{last}, unnest(range(1, len(y) + 1)) u(j))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM book) AS codebooks_sha256
FROM codes JOIN v USING (rid)"""
    )
    return ",".join(steps[:-1]) + "," + steps[-1]


#: Vector codes: every round compares every part with every entry.
OP13_SQL = _codes()
