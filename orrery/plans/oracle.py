"""DuckDB SQL for the queries of plans.queries."""

from __future__ import annotations

import string

from .. import fixed
from .queries import ANSWER_TEXTS, STORED_ANSWERS


def _q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _pick(key: str, *values: str | None) -> str:
    arms = " ".join(f"WHEN {key} % {len(values)} = {i} THEN {_q(v)}" for i, v in enumerate(values))
    return f"CASE {arms} END"


def _filled(text: str, **parts: str) -> str:
    """SQL of a text with named fields; a field with a format is printed with it."""
    out = []
    for plain, field, spec, _ in string.Formatter().parse(text):
        out += [_q(plain)] if plain else []
        out += [f"printf('%{spec}', {parts[field]})" if spec else f"({parts[field]})::VARCHAR"] if field else []
    return "(" + " || ".join(out) + ")"


P = """p AS (SELECT vec_id, i, embedding[2 * i + 1]::DOUBLE AS x, embedding[2 * i + 2]::DOUBLE AS y
  FROM (SELECT vec_id, embedding, unnest(range(3 + vec_id % 8)) AS i FROM embeddings))"""
A = f"""{P},
a AS (SELECT b.vec_id, b.i AS arc, (b.x - o.x) * (c.y - o.y) - (b.y - o.y) * (c.x - o.x) AS det
  FROM p b JOIN p c ON c.vec_id = b.vec_id AND c.i = b.i + 1 JOIN p o ON o.vec_id = b.vec_id AND o.i = 0 WHERE b.i >= 1)"""
TURN = "CASE WHEN det > 0 THEN 'counterclockwise' ELSE 'clockwise' END"
PATH = "CASE WHEN bool_and(det > 0) THEN 'counterclockwise' WHEN NOT bool_or(det > 0) THEN 'clockwise' ELSE 'neither' END"
LABELS = f"{A}, l AS (SELECT vec_id, {PATH} AS label FROM a GROUP BY vec_id)"
ANSWER = r"regexp_extract_all(lower({}), '\b(counterclockwise|clockwise|neither)\b', 1)[-1]"
#: Means of shapes: points have their first pair, the others all of their pairs in order.
S = f"""{P}, s AS (SELECT vec_id, list(x ORDER BY i) AS xs, list(y ORDER BY i) AS ys FROM p GROUP BY vec_id),
m AS (SELECT vec_id, len(xs) AS n, CASE WHEN vec_id % 4 = 0 THEN xs[1] ELSE list_sum(xs) / len(xs) END AS x,
  CASE WHEN vec_id % 4 = 0 THEN ys[1] ELSE list_sum(ys) / len(ys) END AS y FROM s)"""
STORED = f"lower(regexp_replace({_pick('vec_id', *STORED_ANSWERS)}, '^\\s+|\\s+$', '', 'g'))"
T = f"""{LABELS}, t AS (SELECT vec_id, 3 + vec_id % 8 AS n, {ANSWER.format(_pick('vec_id', *ANSWER_TEXTS))} AS predicted,
  CASE WHEN {STORED} IN ('clockwise', 'counterclockwise', 'neither') THEN {STORED} ELSE label END AS truth FROM l)"""
GUESS = f"""g AS (SELECT event_id, {ANSWER.format(_pick('event_id', *ANSWER_TEXTS))} AS predicted,
  {_pick('event_id', 'clockwise', 'neither', 'counterclockwise')} AS truth FROM events)"""
M = f"""{LABELS}, q AS (SELECT vec_id, n0 AS n, n0 - CASE WHEN vec_id % 10 = 1 THEN 1 ELSE 0 END AS names, label,
  CASE WHEN vec_id % 2 = 0 THEN 'neither' ELSE 'clockwise' END AS answer
  FROM (SELECT vec_id, label, CASE WHEN vec_id % 15 = 0 THEN 2 ELSE 3 + vec_id % 8 END AS n0 FROM l)),
k AS (SELECT *, n < 3 OR n <> names AS malformed FROM q)"""
N = "chr(10)"
POINT = "'(' || printf('%.2f', x) || ', ' || printf('%.2f', y) || ')'"
PAIR = "'[' || {0}.x || ', ' || {0}.y || ']'"
#: Records as messages: what both pipelines begin with, the trace of the first, the calls and results of the second.
MESSAGES = f"""{M},
o AS (SELECT k.vec_id, k.n, k.label FROM k WHERE NOT malformed),
arc AS (SELECT b.vec_id, b.i AS arc, b.x - c.x AS bx, b.y - c.y AS "by", d.x - c.x AS cx, d.y - c.y AS cy, {PAIR.format("c")} AS center, {PAIR.format("b")} AS b, {PAIR.format("d")} AS c
  FROM o JOIN p b USING (vec_id) JOIN p d ON d.vec_id = b.vec_id AND d.i = b.i + 1 JOIN p c ON c.vec_id = b.vec_id AND c.i = 0 WHERE b.i >= 1),
det AS (SELECT *, bx * cy - "by" * cx AS det FROM arc), turned AS (SELECT *, {TURN} AS turn FROM det),
line AS (SELECT vec_id, arc, {_filled(fixed.TRACE_ARC, i="arc", j="arc + 1", b="'P' || (arc + 1)", c="'P' || (arc + 2)", bx="bx", by='"by"', cx="cx", cy="cy", det="det", label="turn")} AS line FROM turned),
place AS (SELECT vec_id, i, {POINT} AS point, '"P' || (i + 1) || '"' AS name, '{{"longitude": ' || round(x, 6) || ', "latitude": ' || round(y, 6) || '}}' AS found FROM o JOIN p USING (vec_id)),
asked AS (SELECT vec_id, '{{"place_names": [' || string_agg(name, ', ' ORDER BY i) || ']}}' AS ask, '{{' || string_agg(name || ': ' || found, ', ' ORDER BY i) || '}}' AS geo,
  string_agg({_filled(fixed.TRACE_WAYPOINT, i="i", name="'P' || (i + 1)", point="point")}, {N} ORDER BY i) FILTER (i > 0) AS ways, max({_filled(fixed.TRACE_CENTER, name="'P1'", point="point")}) FILTER (i = 0) AS center FROM place GROUP BY vec_id),
told AS (SELECT vec_id, string_agg(line, {N} ORDER BY arc) AS lines, string_agg(turn, ', ' ORDER BY arc) AS turns FROM turned JOIN line USING (vec_id, arc) GROUP BY vec_id),
v(pipeline) AS (VALUES (1), (2)),
m AS (
  SELECT vec_id, pipeline, 0 AS pos, 'system' AS role, CASE pipeline WHEN 1 THEN {_q(fixed.SYSTEM_BASE + fixed.SYSTEM_REASON)} ELSE {_q(fixed.SYSTEM_BASE + fixed.SYSTEM_TOOL)} END AS content, NULL AS name, NULL AS call_name, NULL AS call_arguments FROM o, v
  UNION ALL SELECT vec_id, pipeline, 1, 'user', 'Q' || vec_id, NULL, NULL, NULL FROM o, v
  UNION ALL SELECT vec_id, pipeline, 2, 'assistant', NULL, NULL, 'geocode', ask FROM o JOIN asked USING (vec_id), v
  UNION ALL SELECT vec_id, pipeline, 3, 'tool', geo, 'geocode', NULL, NULL FROM o JOIN asked USING (vec_id), v
  UNION ALL SELECT vec_id, 1, 4, 'assistant', {_q(fixed.TRACE_HEAD)} || {N} || center || {N} || ways || {N} || {N} || lines || {N} || {N} || {_filled(fixed.TRACE_END, n="n - 2", label="label")}, NULL, NULL, NULL
    FROM o JOIN asked USING (vec_id) JOIN told USING (vec_id)
  UNION ALL SELECT vec_id, 2, 2 + 2 * arc, 'assistant', CASE arc WHEN 1 THEN {_filled(fixed.PREFACE_FIRST, a="'P1'", b="'P2'", c="'P3'")} ELSE {_filled(fixed.PREFACE_NEXT, a="'P1'", b="'P' || (arc + 1)", c="'P' || (arc + 2)")} END,
    NULL, 'cyclic_order', '{{"center": ' || center || ', "point_b": ' || b || ', "point_c": ' || c || '}}' FROM arc
  UNION ALL SELECT vec_id, 2, 3 + 2 * arc, 'tool', '{{"result": "' || turn || '"}}', 'cyclic_order', NULL, NULL FROM turned
  UNION ALL SELECT vec_id, 2, 2 * n, 'assistant', {_filled(fixed.SUMMARY, n="n - 2", a="'P1'", labels="turns", whether=f"CASE label WHEN 'neither' THEN {_q(fixed.DISAGREE)} ELSE {_q(fixed.AGREE)} END", label="label")}, NULL, NULL, NULL
    FROM o JOIN told USING (vec_id))"""
#: Questions of a balanced run: cells of n and answer, and where their ids begin.
def _grid(per_n: int) -> str:
    return f"""(SELECT n, answer, size, sum(size) OVER (ORDER BY n, nr) - size AS first FROM (
  SELECT n, nr, answer, CASE n WHEN 3 THEN {per_n // 2} ELSE {per_n // 3} END AS size
  FROM range(3, 11) r(n), (VALUES (0, 'clockwise'), (1, 'counterclockwise'), (2, 'neither')) a(nr, answer) WHERE n > 3 OR nr < 2))"""


OWN = "customer JOIN nation ON c_nationkey = n_nationkey"
FOUND = """'{"longitude":' || n_nationkey::DOUBLE || ',"latitude":' || n_regionkey::DOUBLE || '}'"""
SHOWN = "role || '|>' || chr(10) || text || chr(10)"

ORACLE: dict[str, str] = {
    "cyclic_label": f"WITH {LABELS} SELECT vec_id, label FROM l",
    "cyclic_label_relational": f"WITH {LABELS} SELECT vec_id, label FROM l",
    "pairwise_arcs": f"WITH {A} SELECT vec_id, arc, round(det, 9) AS det, {TURN} AS label FROM a",
    "cyclic_label_window": f"""
WITH o AS (SELECT o_custkey, epoch(o_orderdate) / 86400 AS x, o_totalprice / 1000 AS y, row_number() OVER w AS k FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
a AS (SELECT b.o_custkey, (b.x - o.x) * (c.y - o.y) - (b.y - o.y) * (c.x - o.x) AS det
  FROM o b JOIN o c ON c.o_custkey = b.o_custkey AND c.k = b.k + 1 JOIN o ON o.o_custkey = b.o_custkey AND o.k = 1 WHERE b.k > 1)
SELECT o_custkey, count(*) AS arcs, {PATH} AS label FROM a GROUP BY o_custkey""",
    "rep_point": f"WITH {S} SELECT vec_id, round(x, 9) AS x, round(y, 9) AS y FROM m",
    "angular_sort": f"""
WITH {P}, c AS (SELECT vec_id, list_sum(list(x ORDER BY i)) / count(*) AS mx, list_sum(list(y ORDER BY i)) / count(*) AS my FROM p GROUP BY vec_id)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY atan2(y - my, x - mx), x, y) - 1 AS pos, x, y FROM p JOIN c USING (vec_id)""",
    "angle_gaps": f"""
WITH {P}, d AS (SELECT vec_id, atan2(y, x) - lag(atan2(y, x)) OVER (PARTITION BY vec_id ORDER BY atan2(y, x)) AS d FROM p)
SELECT vec_id, round(max(d), 9) AS widest, round(min(d), 9) AS narrowest FROM d GROUP BY vec_id""",
    "geocode_map": f"""
WITH {P}, e AS (SELECT vec_id, n_name AS name, min(i) AS first, arg_max(x, i) AS x, arg_max(y, i) AS y
  FROM p JOIN nation ON n_nationkey = (vec_id + i) % 5 GROUP BY vec_id, n_name)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY first) - 1 AS pos, name, round(x, 6) AS longitude, round(y, 6) AS latitude FROM e""",
    "geometry_infer_validate": f"""
WITH g AS (SELECT vec_id, vec_id % 5 AS n, {_pick('vec_id', 'auto', 'point', 'line', 'polygon', 'blob', 'auto')} AS given FROM embeddings),
h AS (SELECT vec_id, n, CASE WHEN given <> 'auto' THEN given WHEN n = 1 THEN 'point' WHEN n = 2 THEN 'line' ELSE 'polygon' END AS type FROM g)
SELECT vec_id, type, CASE WHEN vec_id % 7 = 0 THEN 'name is empty' WHEN type NOT IN ('point', 'line', 'polygon') THEN 'unknown type'
  WHEN type = 'point' AND n <> 1 THEN 'a point has one pair' WHEN type = 'line' AND n < 2 THEN 'a line has two pairs at least'
  WHEN type = 'polygon' AND n < 3 THEN 'a polygon has three pairs at least' END AS error FROM h""",
    "name_lookup": """
WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN n_name
    WHEN c_custkey % 3 = 1 THEN list_aggregate(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1:1]) || w[2:]), 'string_agg', ' ')
    ELSE 'New ' || n_name END AS wanted FROM customer JOIN nation ON c_nationkey = n_nationkey),
l AS (SELECT lower(n_name) AS low, arg_min(n_name, n_nationkey) AS any_name FROM nation GROUP BY 1)
SELECT c_custkey, wanted, coalesce(n.n_name, any_name) AS found FROM r LEFT JOIN nation n ON n.n_name = wanted LEFT JOIN l ON low = lower(wanted)""",
    "store_listing": f"""
WITH {S} SELECT 'g' || vec_id AS name, {_pick('vec_id', 'point', 'line', 'polygon', 'polygon')} AS type,
  n + CASE WHEN vec_id % 4 = 3 THEN 1 ELSE 0 END AS n_points, round(x, 9) AS x, round(y, 9) AS y, '' AS error FROM m""",
    "answer_extract": f"SELECT event_id, {ANSWER.format(_pick('event_id', *ANSWER_TEXTS))} AS answer FROM events",
    "ground_truth": f"WITH {T} SELECT vec_id, truth FROM t",
    "reward_table": f"""
WITH {T} SELECT vec_id, predicted, truth, CASE WHEN predicted = truth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS correctness,
  CASE WHEN predicted IS NULL THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END AS format,
  CASE WHEN predicted = truth THEN 1.25::DOUBLE WHEN predicted IS NULL THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END AS reward FROM t""",
    "scorecard": f"""
WITH {T}, d(level, key) AS (VALUES ('all', ''), ('class', 'clockwise'), ('class', 'counterclockwise'), ('class', 'neither')),
r AS (SELECT 'all' AS level, '' AS key, predicted, truth FROM t UNION ALL SELECT 'class', truth, predicted, truth FROM t UNION ALL SELECT 'n', n::VARCHAR, predicted, truth FROM t),
c AS (SELECT level, key, count(*) AS total, count(*) FILTER (predicted = truth) AS correct, count(*) FILTER (predicted IS NULL) AS failures FROM r GROUP BY ALL)
SELECT level, key, coalesce(total, 0) AS total, coalesce(correct, 0) AS correct, coalesce(failures, 0) AS failures,
  CASE WHEN total > 0 THEN correct::DOUBLE / total END AS accuracy FROM d FULL JOIN c USING (level, key)""",
    "running_accuracy": f"""
WITH {GUESS}, c AS (SELECT row_number() OVER w AS total, count(*) FILTER (predicted = truth) OVER w AS correct FROM g WINDOW w AS (ORDER BY event_id))
SELECT total // 8 AS batches, total, correct, correct::DOUBLE / total AS accuracy FROM c WHERE total % 80 = 0""",
    "sampled_accuracy": f"""
WITH {GUESS} SELECT count(*) AS total, count(*) FILTER (predicted = truth) AS correct, count(*) FILTER (predicted IS NULL) AS failures
FROM (SELECT * FROM g ORDER BY event_id LIMIT 50)""",
    "malformed_rows": f"""
WITH {M}, w AS (SELECT malformed, NOT malformed AND label <> answer AS wrong FROM k)
SELECT count(*) AS total, count(*) FILTER (malformed) AS malformed, count(*) FILTER (wrong) AS mislabelled,
  2 * count(*) FILTER (wrong) AS disagreements, count(*) FILTER (malformed) + 2 * count(*) FILTER (wrong) AS inconsistent FROM w""",
    "conversation_records": f"""
WITH {M}, j AS (SELECT vec_id, string_agg({TURN}, ', ' ORDER BY arc) AS arcs FROM a GROUP BY vec_id)
SELECT vec_id AS question_id, pipeline::INTEGER AS pipeline, CASE WHEN pipeline = 1 THEN 5 ELSE 2 * n + 1 END AS n_messages, answer AS expected_answer, label AS derived,
  CASE WHEN pipeline = 2 THEN 'The ' || (n - 2) || ' pairwise arcs around P1 are: ' || arcs || '. Since ' ||
    CASE WHEN label = 'neither' THEN 'they disagree' ELSE 'they all agree' END || ', the overall path is **' || label || '**.' END AS closing
FROM k JOIN j USING (vec_id) CROSS JOIN (VALUES (1), (2)) v(pipeline) WHERE NOT malformed""",
    "pipeline_fanout": """
SELECT conv_id, turn, pipeline::INTEGER AS pipeline, pipeline::BIGINT AS n_tools, pipeline = 2 AS with_tool
FROM conversations CROSS JOIN (VALUES (1), (2)) v(pipeline)""",
    "prompt_messages": f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM conversations)
SELECT conv_id, coalesce(string_agg('<|' || {SHOWN}, '' ORDER BY turn, role, text) FILTER (back > 1), '') || '<|assistant|>' || chr(10) AS prompt FROM r GROUP BY conv_id""",
    "display_messages": """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos, role, text AS content
FROM conversations WHERE role IN ('user', 'assistant') AND text <> ''""",
    "role_counts": "SELECT role, count(*) AS n FROM conversations GROUP BY role",
    "template_fill": """
SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Around ' || r_name || ', which way does the path ' || n_name || ' to {} turn?'
  ELSE 'Which way does the path ' || n_name || ' to {} turn, seen from ' || r_name || '?' END AS question
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "arc_summary": f"WITH {A} SELECT vec_id, string_agg({TURN}, ', ' ORDER BY arc) AS arcs FROM a GROUP BY vec_id",
    "roles_struct": "SELECT r_regionkey, 0 AS center, 1 AS b, 2 AS c FROM region",
    "tool_call_extract": r"""
SELECT event_id, 1::BIGINT AS n_calls, event_type AS name, '{"k": ' || regexp_extract(props, '(-?\d+)\}', 1) || '}' AS arguments, 'hi  bye' AS narration FROM events""",
    "tool_dispatch": f"""
WITH {A} SELECT vec_id, CASE WHEN vec_id % 3 = 2 THEN 'teleport' ELSE 'cyclic_order' END AS name,
  CASE WHEN vec_id % 3 = 2 THEN '{{"error":"unknown tool teleport"}}' ELSE '{{"result":"' || {TURN} || '"}}' END AS result FROM a WHERE arc = 1""",
    "coord_parse": """
WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_tax AS b, l_orderkey % 6 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 END::BIGINT AS n,
  CASE WHEN k < 4 THEN a END AS x0, CASE WHEN k < 4 THEN b END AS y0, CASE k WHEN 0 THEN b WHEN 2 THEN b WHEN 3 THEN a END AS x1,
  CASE k WHEN 4 THEN 'not a number: ' || a || ' b' WHEN 5 THEN 'not a pair: 1 2 3' END AS error FROM l""",
    "peak_per_key": "SELECT user_id, max(value) AS peak FROM events GROUP BY user_id",
    "peak_verdict": """
WITH p AS (SELECT user_id, max(value) AS peak FROM events GROUP BY user_id),
m AS (SELECT coalesce(sum(peak), 0) / 8 AS mean FROM p WHERE user_id BETWEEN 0 AND 7)
SELECT user_id, peak, user_id BETWEEN 0 AND 7 AS assigned, round(mean, 6) AS mean,
  CASE WHEN user_id BETWEEN 0 AND 7 AND mean > 0 AND peak > 1.5 * mean THEN 'high' WHEN user_id NOT BETWEEN 0 AND 7 AND peak > 500 THEN 'unexpected' ELSE 'ok' END AS verdict
FROM p CROSS JOIN m""",
    "headroom_verdict": """
SELECT o_orderkey, CASE WHEN 4 - o_totalprice / 100000 > 2 THEN 'safe' WHEN 4 - o_totalprice / 100000 > 0 THEN 'tight' ELSE 'oom' END AS verdict FROM orders""",
    "conditional_totals": """
WITH c AS (SELECT l_returnflag, sum(l_quantity) AS total, coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0) AS chosen FROM lineitem GROUP BY l_returnflag)
SELECT *, chosen / total AS share FROM c""",
    "stream_peak": "SELECT user_id, max(value) AS peak FROM events GROUP BY user_id",
    "first_rows": "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 5",
    "jsonl_roundtrip": "SELECT * FROM conversations",
    "store_additions": """
WITH n AS (SELECT vec_id AS seq, coalesce(n_name, 'g' || vec_id % 100) AS name, n_name IS NOT NULL AS taken,
    CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 3 + vec_id % 8 + CASE WHEN vec_id % 4 = 3 THEN 1 ELSE 0 END END AS k
  FROM embeddings LEFT JOIN nation ON n_nationkey = vec_id % 50)
SELECT seq, name, CASE WHEN k = 1 THEN 'point' WHEN k = 2 THEN 'line' ELSE 'polygon' END AS type,
  CASE WHEN taken OR seq > min(seq) OVER (PARTITION BY name) THEN 'name is taken' ELSE '' END AS error FROM n""",
    "generated_labels": f"SELECT unnest(range(first::BIGINT, (first + size)::BIGINT)) AS question_id, n, answer, answer AS derived FROM {_grid(4000)}",
    "generator_counts": f"""
SELECT 'train' AS split, n, answer, size::BIGINT AS questions, first::BIGINT AS first, (first + size - 1)::BIGINT AS last FROM {_grid(4000)}
UNION ALL SELECT 'val_balanced', n, answer, size::BIGINT, first::BIGINT, (first + size - 1)::BIGINT FROM {_grid(1000)}
UNION ALL SELECT 'val_natural', n, '', 1000, 1000 * (n - 3), 1000 * (n - 2) - 1 FROM range(3, 11) r(n)""",
    "record_messages": f"WITH {MESSAGES} SELECT vec_id AS question_id, pipeline::INTEGER AS pipeline, pos::BIGINT AS pos, role, content, name, call_name, call_arguments FROM m",
    "record_meta": f"""
WITH {M} SELECT vec_id AS question_id, pipeline::INTEGER AS pipeline, CASE pipeline WHEN 1 THEN {_q(fixed.TOOLS[1])} ELSE {_q(fixed.TOOLS[2])} END AS tools, answer AS expected_answer, n,
  array_to_string(list_transform(range(1, n + 1), lambda i: 'P' || i), ',') AS names, 'point' AS kind, answer AS stored FROM k, (VALUES (1), (2)) v(pipeline) WHERE NOT malformed""",
    "record_prompts": f"WITH {M} SELECT 'P1' AS centre, n, 2 * n AS messages, 'tool' AS last_role, answer AS expected_answer FROM k WHERE NOT malformed",
    "fallback_prompts": f"""
WITH {M} SELECT vec_id AS question_id, pipeline::INTEGER AS pipeline, '<|system|>' || {N} || CASE pipeline WHEN 1 THEN {_q(fixed.SYSTEM_BASE + fixed.SYSTEM_REASON + fixed.TOOL_LISTS[1])}
  ELSE {_q(fixed.SYSTEM_BASE + fixed.SYSTEM_TOOL + fixed.TOOL_LISTS[2])} END || {N} || '<|user|>' || {N} || 'Q' || vec_id || {N} || '<|assistant|>' || {N} AS prompt
FROM k, (VALUES (1), (2)) v(pipeline) WHERE NOT malformed""",
    "reward_join": f"""
WITH {M}, r AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'train' ELSE 'val' END AS split, vec_id AS question_id, pipeline::INTEGER AS pipeline, n, answer AS truth,
  {ANSWER.format(_pick('(vec_id + pipeline)', *ANSWER_TEXTS))} AS predicted FROM k, (VALUES (1), (2)) v(pipeline) WHERE NOT malformed AND vec_id % 3 <> 0)
SELECT *, CASE WHEN predicted = truth THEN 1.25::DOUBLE WHEN predicted IS NULL THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END AS reward FROM r""",
    "split_records": f"""
WITH {M} SELECT CASE WHEN vec_id % 2 = 0 THEN 'train' ELSE 'val' END AS split, vec_id AS question_id, pipeline::INTEGER AS pipeline, CASE WHEN pipeline = 1 THEN 5 ELSE 2 * n + 1 END AS n_messages,
  'Q' || vec_id AS question, answer AS expected_answer FROM k, (VALUES (1), (2)) v(pipeline) WHERE NOT malformed""",
    "store_roundtrip": """
SELECT n_name || CASE n_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' "q"' WHEN 2 THEN '\\' ELSE ' é' END AS name, n_nationkey::BIGINT - (n_nationkey > 4)::BIGINT AS seq, 'line' AS type,
  n_nationkey / 4 AS x0, n_regionkey::DOUBLE AS y0, -n_nationkey / 4 AS x1, 0.5::DOUBLE AS y1 FROM nation WHERE n_nationkey <> 4""",
    "csv_names": """SELECT p_name || ', "x"' AS name FROM part""",
    "templates_json": """
SELECT 3::BIGINT AS n, row_number() OVER (ORDER BY r_regionkey) - 1 AS template_id, r_name || ' "{}: {} to {}?"' AS fmt, '2,0,1' AS ord FROM region
UNION ALL SELECT 4, row_number() OVER (ORDER BY n_nationkey) - 1, n_name || ' "{} {} {} {} {}"', '0,1,1,2,3' FROM nation""",
    "metric_log": """
SELECT role, step * count(*) AS value, run, step::BIGINT AS batch FROM conversations CROSS JOIN (VALUES ('a', 1), ('a', 2), ('b/1', 1)) t(run, step) GROUP BY role, run, step""",
    "partitioned_parquet": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
    "tool_geocode": f"""SELECT c_custkey, '{{"' || n_name || '":' || {FOUND} || ',"' || lower(n_name) || '":' || {FOUND} || ',"Nowhere":{{"error":"unknown place Nowhere"}}}}' AS result FROM {OWN}""",
    "tool_loop": f"""
WITH t AS (SELECT c_custkey, n_name, {FOUND} AS found, c_custkey % 7 = 5 AS mute, c_custkey % 3 AS k FROM {OWN})
SELECT c_custkey AS conv_id, CASE WHEN mute OR k = 0 THEN 2 ELSE 3 END::BIGINT AS turns, NOT mute AND k = 2 AS stopped,
  CASE WHEN mute THEN 'no completion' WHEN k = 2 THEN 'calls left' ELSE 'answered' END AS outcome,
  CASE WHEN mute THEN 3 WHEN k = 0 THEN 4 WHEN k = 1 THEN 6 ELSE 7 END::BIGINT AS n_messages,
  CASE WHEN mute THEN '{{"' || n_name || '":' || found || '}}' WHEN k = 0 THEN 'Done: {{"' || n_name || '":' || found || '}}' WHEN k = 1 THEN 'Done: {{"result":"counterclockwise"}}' ELSE '{{"error":"unknown tool fly"}}' END AS last,
  CASE WHEN mute THEN 'call_1_0' WHEN k = 2 THEN 'call_5_0' ELSE '' END AS call_id FROM t""",
    "headroom_all": """
WITH s AS (SELECT * FROM (VALUES ('F'), ('O'), ('none')) v(status) UNION SELECT o_orderstatus FROM orders)
SELECT s.status, coalesce(bool_and(8 - o_totalprice / 100000 > 2), true) AS safe FROM s LEFT JOIN orders ON o_orderstatus IS NOT DISTINCT FROM s.status GROUP BY s.status""",
    "device_lines": "SELECT (l_orderkey % 4)::INTEGER AS gpu_idx, max(l_extendedprice) AS peak FROM lineitem WHERE l_orderkey % 5 > 1 GROUP BY 1",
    "rep_point_exact": "SELECT vec_id, (2 * (vec_id % 17) / 8)::DOUBLE / 4 AS x, (2 * (vec_id % 17) / 8)::DOUBLE / 4 AS y FROM embeddings",
    "tool_call_table": r"""
WITH e AS (SELECT event_id, event_type AS t, '{"k": ' || regexp_extract(props, '(-?\d+)\}', 1) || '}' AS p, CASE event_id % 3 WHEN 0 THEN 'a  b  c' ELSE 'd' END AS narration FROM events WHERE event_id % 3 < 2)
SELECT event_id, 0::BIGINT AS position, t AS name, p AS arguments, narration FROM e
UNION ALL SELECT event_id, 1, 'geocode', '{"place_names": ["' || t || ' {"]}', narration FROM e WHERE event_id % 3 = 0""",
    "tool_call_batches": """
WITH c AS (SELECT event_id, event_type AS name, false AS second FROM events WHERE event_id % 3 < 2 UNION ALL SELECT event_id, 'geocode', true FROM events WHERE event_id % 3 = 0)
SELECT name, second, count(*) AS calls, count(DISTINCT event_id) AS texts FROM c GROUP BY ALL""",
    "tool_functions": f"""
WITH a AS (SELECT c_custkey, unnest([0, 1, 2]) AS position, unnest([n_name, lower(n_name), 'Nowhere']) AS name, n_nationkey, n_regionkey FROM {OWN})
SELECT c_custkey, position::BIGINT AS position, name, CASE WHEN position < 2 THEN n_nationkey::DOUBLE END AS longitude, CASE WHEN position < 2 THEN n_regionkey::DOUBLE END AS latitude,
  CASE WHEN position = 2 THEN 'unknown place Nowhere' END AS error,
  CASE WHEN position < 2 AND n_regionkey > 2 THEN 'counterclockwise' ELSE 'clockwise' END AS turn FROM a""",
    "tool_schemas": """
SELECT vec_id, CASE WHEN vec_id % 11 >= 8 THEN 'geocode' ELSE 'cyclic_order' END AS name,
  CASE vec_id % 11 WHEN 0 THEN '{"result":"clockwise"}' ELSE '{"error":"bad arguments: ' ||
    ['center has fewer than 2 items', 'point_b has more than 2 items', 'point_c holds an item that is no number', 'center is no array', 'point_b is missing', 'arguments are no object', 'arguments are no object',
     'place_names holds an item that is no string', 'place_names is no array', 'place_names is missing'][vec_id % 11] || '"}' END AS result FROM embeddings""",
    "ordered_export": "SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS line FROM conversations",
    "token_stream": """
WITH c AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS whole, count(*) AS n, max(text) FILTER (turn = 0) AS head FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 2 ELSE n END AS pieces, CASE WHEN conv_id % 3 = 0 THEN head || '<|end|>' ELSE whole END AS text, CASE WHEN conv_id % 3 = 0 THEN 'marker' ELSE 'silence' END AS ended FROM c""",
    "stream_progress": "SELECT count(*)::BIGINT AS rows, 3::BIGINT AS batches, true AS timed, max(value) AS highest FROM events",
    "natural_labels": "SELECT n, 1000 AS questions, 1000 AS right, n AS names FROM range(3, 11) r(n)",
    "marker_calls": "SELECT event_id, '<<CALL>>' AS opening, '<<END>>' AS closing, event_type AS name, 'x  y <tool_call>{}</tool_call>' AS narration FROM events",
    "memory_units": "SELECT o_orderkey, o_orderkey / 1024 AS gib, printf('%.2f', o_totalprice / 1024) AS shown FROM orders",
    "missing_columns": "SELECT count(*) AS rows, 'missing columns [''answer'', ''geometries'', ''location_names'', ''question'', ''question_id'']; found [''doc_id'', ''quality'', ''toxic'']' AS said FROM labels",
}
ORACLE["accuracy_report"] = f"""
WITH card AS ({ORACLE["scorecard"]}),
s AS (SELECT *, CASE WHEN total > 0 THEN printf('%d/%d = %.1f%%', correct, total, 100 * accuracy) ELSE '0/0 (no examples)' END AS share FROM card),
l AS (
  SELECT 0 AS a, 0 AS b, repeat('-', 40) AS text UNION ALL SELECT 1, 0, 'total     ' || total FROM s WHERE level = 'all'
  UNION ALL SELECT 2, 0, 'accuracy  ' || CASE WHEN total > 0 THEN share ELSE 'N/A' END FROM s WHERE level = 'all'
  UNION ALL SELECT 3, 0, 'no answer ' || failures FROM s WHERE level = 'all'
  UNION ALL SELECT 4, CASE key WHEN 'clockwise' THEN 0 WHEN 'counterclockwise' THEN 1 ELSE 2 END, '  ' || rpad(key, 17, ' ') || share FROM s WHERE level = 'class'
  UNION ALL SELECT 5, key::INTEGER, '  n = ' || rpad(key, 13, ' ') || share FROM s WHERE level = 'n')
SELECT row_number() OVER (ORDER BY a, b) - 1 AS line, text FROM l"""
