"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

import string

from .chat import Template

OP1 = """
WITH v AS (
  SELECT row_number() OVER () AS nr, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (SELECT nr, vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
s AS (
  SELECT q.nr, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) / (q.norm * c.norm) AS score
  FROM n q JOIN n c ON q.nr <> c.nr AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY nr ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 5
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _either_case(words: str) -> str:
    """A pattern of words for ASCII letters in either case; the dialect's own flag takes other letters, too."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: Kinds of spans in their order, with patterns in DuckDB's dialect; letters of the first part of assign in either case.
_SECRETS = {
    "assign": f"(?:{_either_case('password|passwd|secret|token|api_?key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[0-9A-Z]{12}[0-9A-Z]*",
    "hex": "[a-f0-9]{32}[a-f0-9]*",
    "keyid": "A(?:SIA|IDA|ROA)[0-9A-Z]{12}[0-9A-Z]*",
    "blob": "[+/0-9A-Za-z]{40}[+/0-9A-Za-z]*",
    "endpoint": r"https?://[-.:_0-9A-Za-z]+|[-0-9A-Za-z]+(?:[.][-0-9A-Za-z]+)*[.]amazonaws[.]com",
}


def _op6() -> str:
    kinds = []
    for nr, (kind, pattern) in enumerate(_SECRETS.items()):
        pattern = _quoted(pattern)
        kept = {"assign": f"length(regexp_extract(w, {pattern}, 1)) >= 8", "blob": "length(w) = 40"}.get(kind, "true")
        kinds.append(f"""
SELECT doc_id, {nr} AS nr, '{kind}' AS kind, s AS start, s + length(w) AS "end" FROM (
  SELECT doc_id, unnest(ws) AS w, unnest(list_transform(range(1, len(ws) + 1), lambda i:
    coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(ws[1:i - 1], lambda g: length(g))), 0))) AS s
  FROM (SELECT doc_id, regexp_extract_all(t, {pattern}) AS ws, string_split_regex(t, {pattern}) AS gaps FROM d)
) WHERE {kept}""")
    def near(*k: str) -> str:
        of = f"kind IN ({', '.join(map(_quoted, k))})"
        return f"""(coalesce(max(CASE WHEN {of} THEN "end" END) OVER (PARTITION BY doc_id ORDER BY start) >= start - 256, false)
    OR coalesce(min(CASE WHEN {of} THEN start END) OVER (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= "end" + 256, false))"""

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS ({" UNION ALL ".join(kinds)}),
linked AS (SELECT *, {near("access", "keyid")} AS id_near, {near("assign", "blob")} AS secret_near FROM parts),
kept AS (SELECT *, kind || ':' || start::BIGINT || ':' || "end"::BIGINT AS shown FROM linked
  WHERE nr < 3 OR (kind = 'keyid' AND secret_near) OR (kind = 'blob' AND id_near) OR (kind = 'endpoint' AND id_near AND secret_near))
SELECT d.doc_id, count(*) FILTER (nr = 0) AS n_assign, count(*) FILTER (nr = 1) AS n_access, count(*) FILTER (nr = 2) AS n_hex,
  sha256(coalesce(string_agg(shown, ',' ORDER BY start, nr) FILTER (nr < 3), '')) AS base_sha256,
  coalesce(string_agg(shown, ',' ORDER BY start, nr), '') AS spans
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id GROUP BY d.doc_id
"""


OP6 = _op6()


def _op7() -> str:
    t = Template()

    def grown(col: str, role: bool) -> str:
        """Code points of a text with its control strings escaped."""
        text = f"replace({col}, {_quoted(t.escape)}, {_quoted(t.escape + 'e')})"
        for c in t.controls:
            text = f"replace({text}, {_quoted(c)}, {_quoted(t.escape + 'A')})"
        return f"length({text})" + (f" + length({col}) - length(replace({col}, chr(10), ''))" if role else "")

    marks = len(t.open) + len(t.after_role) + len(t.close)
    return f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({marks} + {grown("role", True)} + {grown("text", False)})::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""


OP7 = _op7()

OP9 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos
  FROM documents WHERE text IS NOT NULL
), n AS (
  SELECT doc_id, pos, trim(line, ' ') AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM l WHERE trim(line, ' ') <> ''
), w AS (
  SELECT a.doc_id, a.i, a.pos AS pos1, b.pos AS pos2, a.line || chr(10) || b.line AS key FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.i = a.i + 1
  UNION ALL SELECT doc_id, i, pos, pos, line FROM n WHERE len(string_split_regex(line, '\s+')) >= 50
), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS k FROM w),
gone AS (SELECT doc_id, pos1 AS pos FROM r WHERE k > 1 UNION SELECT doc_id, pos2 FROM r WHERE k > 1),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL) AS text, count(*) AS n_lines, count(gone.pos) AS n_deleted
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_deleted, 0) AS n_deleted
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def _op11(within: int = 5, over: int = 4) -> str:
    """A tree of 16 within each source and one over the sources, for 16 ** within rows of a source and 16 ** over sources."""

    def field(value: str) -> str:
        return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"

    lowered = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    parts = [f"""leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot FROM (
  SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN crc % 5 = 0 THEN {leaf(lowered)} END AS claimed
  FROM (SELECT documents.*, crc32 AS crc FROM documents LEFT JOIN crcs USING (doc_id))))""", "n0 AS (SELECT source AS k, spot AS i, leaf AS h FROM leaves)"]
    for level in range(1, within + over + 1):
        if level == within + 1:
            parts.append(f"subroots AS (SELECT k AS source, h AS subroot, row_number() OVER (ORDER BY k NULLS FIRST) - 1 AS nr FROM n{within})")
            parts.append(f"m{within} AS (SELECT '' AS k, nr AS i, subroot AS h FROM subroots)")
        below = f"m{within}" if level == within + 1 else f"n{level - 1}"
        parts.append(f"g{level} AS (SELECT k, i // 16 AS i, string_agg(h, '' ORDER BY i) AS s, i // 16 = 0 AND count(*) = 1 AS alone FROM {below} GROUP BY k, i // 16)")
        parts.append(f"n{level} AS (SELECT k, i, CASE WHEN alone THEN s ELSE sha256(s) END AS h FROM g{level})")
    parts.append("f0 AS (SELECT doc_id, leaf, subroot, spot, nr, leaves.source, coalesce(claimed, leaf) AS fold, '' AS proof FROM leaves JOIN subroots ON leaves.source IS NOT DISTINCT FROM subroots.source)")
    for level in range(1, within + over + 1):
        place, step = ("spot", 16 ** (level - 1)) if level <= within else ("nr", 16 ** (level - within - 1))
        key = "f.source" if level <= within else "''"
        left, right = f"s[1:64 * (({place} // {step}) % 16)]", f"s[64 * (({place} // {step}) % 16) + 65:]"
        left = f"CASE WHEN ({place} // {step}) % 16 = 0 THEN '' ELSE {left} END"
        parts.append(f"""f{level} AS (SELECT f.* EXCLUDE (fold, proof), CASE WHEN alone THEN fold ELSE sha256({left} || fold || {right}) END AS fold, CASE WHEN alone THEN proof ELSE proof || {left} || {right} END AS proof
  FROM f{level - 1} f JOIN g{level} ON k IS NOT DISTINCT FROM {key} AND i = {place} // {16 * step})""")
    crcs = _crc32("SELECT DISTINCT doc_id, doc_id::VARCHAR AS v FROM documents WHERE doc_id IS NOT NULL")
    return f"""WITH {crcs}, {", ".join(parts)}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified FROM f{within + over} CROSS JOIN n{within + over}"""


def _crc32(values: str) -> str:
    """crcs (doc_id, crc32) of texts (doc_id, v) of ASCII, by the polynomial, a character and then a bit at a time."""
    return f"""crcs AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(v) + 1), lambda i: ascii(v[i])::BIGINT)),
  lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) AS crc32 FROM ({values}))"""


OP11 = _op11()

OP13 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS i, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS j,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
o AS (SELECT *, substring(t, 1, i) AS p, substring(t, i + 1, j - i) AS m, substring(t, j + 1, n) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM o
"""
