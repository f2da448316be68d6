"""The strategies again, for checking: DuckDB over every pair of a catalog ``cat``, written without the Spark plans.

Nothing here joins on features or cuts candidates: each CTE compares all guarded pairs.  Over the documents, whose pairs are too
many for that, pairs are scored from what they share (``documents``).
"""

from __future__ import annotations

from tessera.functions.names import LONG_FORMS, SPELLINGS, SYNONYMS
from tessera.operators.strategy_values import FACTORIES, KEYWORDS, OPENERS, SEQUENCE, STATEMENTS, SURFACE, WEIGHTS


def literal(value) -> str:
    """A Python value as DuckDB SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, tuple) and len(value) == 3 and isinstance(value[2], bool):
        return f"{{'name': {literal(value[0])}, 'type': {literal(value[1])}, 'optional': {literal(value[2])}}}"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    return str(value)


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _table(name: str, entries: dict) -> str:
    return f"{name}(k, v) AS (VALUES {', '.join(f'({literal(k)}, {literal(v)})' for k, v in entries.items())})"


_APART = "coalesce({0} >= {1} AND {2} >= {1} AND greatest({0}, {2}) / least({0}, {2}) > 3, false)"
_UNLIKE = " OR ".join((
    "coalesce(greatest(x.body_lines, y.body_lines) < 3 AND x.body_lines IS NOT NULL AND y.body_lines IS NOT NULL, false)",
    _APART.format("x.body_lines", 3, "y.body_lines"), "coalesce(abs(len(x.params) - len(y.params)) > 2, false)", _APART.format("x.cyclomatic_complexity", 1, "y.cyclomatic_complexity"),
))
_DIFFERENT = "NOT coalesce(x.file || ':' || x.line = y.file || ':' || y.line, false) AND (x.file IS DISTINCT FROM y.file OR coalesce(x.qualified_name, x.name) IS DISTINCT FROM coalesce(y.qualified_name, y.name))"
_PAIRS = f"pairs AS (SELECT x.id AS a, y.id AS b FROM cat x JOIN cat y ON x.id < y.id WHERE {_DIFFERENT} AND NOT ({_UNLIKE}))"


def guard(which: str, cat: str) -> str:
    test = {"different": _DIFFERENT, "unlike": f"NOT ({_UNLIKE})"}[which]
    return f"WITH {cat} SELECT x.id AS a, y.id AS b FROM cat x JOIN cat y ON x.id < y.id AND len(x.params) IS NOT DISTINCT FROM len(y.params) WHERE {test}"


def _two(columns: str, where: str = "true") -> str:
    return f"SELECT a, b, {columns} FROM pairs JOIN cat x ON x.id = a JOIN cat y ON y.id = b WHERE {where}"


def _jaccard(p: str, q: str) -> str:
    return f"coalesce(len(list_intersect({p}, {q})) / nullif(CAST(len(list_distinct(list_concat({p}, {q}))) AS DOUBLE), 0), 0)"


def _grams(k: int, tokens: str) -> str:
    return f"list_transform(range(1, len({tokens}) - {k - 2}), lambda i: array_to_string({tokens}[i:i + {k - 1}], '|'))"


def _lcs(name: str, source: str) -> str:
    """CTEs: name(a, b, l), the longest common subsequence of lists p and q of source(a, b, p, q), a row of the table at a time."""
    row = f"list_transform(range(1, len(q) + 1), lambda j: CASE WHEN q[j] = p[i + 1] THEN r[j] + 1 ELSE r[j + 1] END)"
    return f"""{name}_dp(a, b, p, q, i, r) AS (SELECT a, b, p, q, 0, list_transform(range(0, len(q) + 1), lambda j: 0) FROM {source}
  UNION ALL SELECT a, b, p, q, i + 1, list_concat([0], list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j]))) FROM (SELECT *, {row} AS c FROM {name}_dp WHERE i < len(p))),
{name} AS (SELECT a, b, r[len(q) + 1] AS l FROM {name}_dp WHERE i = len(p))"""


def _cosine(name: str, features: str, threshold: float, extra: str = "true") -> str:
    """CTEs over features(id, f, x), all pairs."""
    return f"""{name}_n AS (SELECT id, sqrt(sum(x * x)) AS n FROM {features} GROUP BY id),
{name} AS (SELECT a, b, s AS score FROM (SELECT a, b, (SELECT sum(u.x * v.x) FROM {features} u JOIN {features} v ON u.f = v.f WHERE u.id = a AND v.id = b) / nullif((SELECT n FROM {name}_n WHERE id = a) * (SELECT n FROM {name}_n WHERE id = b), 0) AS s FROM pairs) t WHERE round(s, 12) >= {threshold} AND {extra})"""


_split = "regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g')"
_words = f"list_distinct(list_filter(regexp_split_to_array(lower({_split}), '[^a-z0-9]+'), lambda t: t <> ''))"

_CTES = {
    "fuzzy_name": f"""{_table('syn', SYNONYMS)}, {_table('longer', LONG_FORMS)}, fz_names AS (SELECT id, name, {_words.format('name')} AS t FROM cat),
fz_long AS (SELECT id, list_distinct(list(coalesce(v, w))) AS t FROM (SELECT id, unnest(t) AS w FROM fz_names) LEFT JOIN longer ON w = k GROUP BY id),
fz_in AS (SELECT a, b, string_split(x.name, '') AS p, string_split(y.name, '') AS q FROM pairs JOIN cat x ON x.id = a JOIN cat y ON y.id = b), {_lcs('fz_lcs', 'fz_in')},
fz_only AS (SELECT a, b, list_filter(x.t, lambda w: NOT list_contains(y.t, w)) AS p, list_filter(y.t, lambda w: NOT list_contains(x.t, w)) AS q FROM pairs JOIN fz_names x ON x.id = a JOIN fz_names y ON y.id = b),
fz_left AS (SELECT a, b, v, count(*) AS n FROM (SELECT a, b, unnest(p) AS w FROM fz_only) JOIN syn ON w = k GROUP BY ALL), fz_right AS (SELECT a, b, v, count(*) AS n FROM (SELECT a, b, unnest(q) AS w FROM fz_only) JOIN syn ON w = k GROUP BY ALL),
fz_syn AS (SELECT a, b, sum(least(l.n, r.n)) AS m FROM fz_left l JOIN fz_right r USING (a, b, v) GROUP BY ALL),
fz_score AS (SELECT p.a, p.b, 0.3 * 2.0 * l / (len(x.name) + len(y.name)) + 0.4 * {_jaccard('x.t', 'y.t')}
  + 0.2 * CASE WHEN len(o.p) > 0 AND len(o.q) > 0 THEN 0.3 * coalesce(m, 0) / least(len(o.p), len(o.q)) ELSE 0 END
  + 0.1 * greatest(0, least(0.2, 0.4 * ({_jaccard('g.t', 'h.t')} - {_jaccard('x.t', 'y.t')}))) AS score
  FROM pairs p JOIN fz_names x ON x.id = p.a JOIN fz_names y ON y.id = p.b JOIN fz_lcs c ON c.a = p.a AND c.b = p.b JOIN fz_only o ON o.a = p.a AND o.b = p.b JOIN fz_long g ON g.id = p.a JOIN fz_long h ON h.id = p.b LEFT JOIN fz_syn s ON s.a = p.a AND s.b = p.b),
fuzzy_name AS (SELECT a, b, CAST(score AS DOUBLE) AS score FROM fz_score WHERE round(score, 12) >= 0.5)""",
    "signature_match": f"""{_table('spell', SPELLINGS)}, sg_raw AS (SELECT DISTINCT t FROM (SELECT p.type AS t FROM cat, unnest(params) u(p) UNION ALL SELECT return_type FROM cat) WHERE t <> ''),
sg_bare AS (SELECT t, regexp_replace(lower(trim(t)), '[<\\[].*?[>\\]]', '', 'g') AS s FROM sg_raw),
sg_one AS (SELECT t, regexp_replace(CASE WHEN contains(s, '|') THEN coalesce(list_filter(list_transform(string_split(s, '|'), lambda z: trim(z)), lambda z: z NOT IN ('null', 'none', 'undefined', 'void', ''))[1], 'void') ELSE s END, '[^a-z]', '', 'g') AS s FROM sg_bare),
sg_type AS (SELECT t, CASE WHEN s = '' THEN 'any' ELSE coalesce(v, s) END AS n FROM sg_one LEFT JOIN spell ON s = k),
sg_par AS (SELECT id, i, params[i].name AS nm, coalesce(n, 'any') AS ty FROM (SELECT id, params, unnest(range(1, len(params) + 1)) AS i FROM cat) LEFT JOIN sg_type ON t = params[i].type),
sg_f AS (SELECT id, len(params) AS n, len(list_filter(params, lambda p: p.optional)) AS opt, (SELECT count(*) FROM sg_par p WHERE p.id = c.id AND ty <> 'any') AS typed, coalesce((SELECT n FROM sg_type WHERE t = return_type), '') AS ret FROM cat c),
sg_at AS (SELECT a, b, avg(CASE WHEN p.ty IS NOT DISTINCT FROM q.ty THEN 1.0 WHEN p.ty = 'any' OR q.ty = 'any' THEN 0.5 WHEN coalesce(p.ty, '') = '' OR coalesce(q.ty, '') = '' THEN 0.3 ELSE 0 END) AS ty,
  avg(CASE WHEN coalesce(p.nm, '') = '' AND coalesce(q.nm, '') = '' THEN 0.5 WHEN coalesce(p.nm, '') = '' OR coalesce(q.nm, '') = '' THEN 0 ELSE {_jaccard(_words.format('p.nm'), _words.format('q.nm'))} END) AS nm
  FROM (SELECT a, b, unnest(range(1, greatest(x.n, y.n) + 1)) AS i FROM pairs JOIN sg_f x ON x.id = a JOIN sg_f y ON y.id = b) t LEFT JOIN sg_par p ON p.id = a AND p.i = t.i LEFT JOIN sg_par q ON q.id = b AND q.i = t.i GROUP BY a, b),
sg_parts AS (SELECT p.a, p.b, CASE WHEN x.n = y.n AND x.opt = y.opt THEN 1.0 WHEN abs(x.n - y.n) = 1 THEN 0.5 WHEN x.n = y.n THEN 0.75 ELSE 0 END AS arity,
  CASE WHEN x.typed = 0 AND y.typed = 0 THEN 0.4 WHEN x.n = 0 OR y.n = 0 THEN 0 ELSE ty END AS ty,
  CASE WHEN x.ret = '' AND y.ret = '' THEN 0.5 WHEN x.ret = '' OR y.ret = '' THEN 0.3 WHEN x.ret = y.ret THEN 1.0 WHEN 'any' IN (x.ret, y.ret) THEN 0.5 ELSE 0 END AS ret,
  CASE WHEN x.n = 0 AND y.n = 0 THEN 1.0 WHEN x.n = 0 OR y.n = 0 THEN 0 ELSE nm END AS nm FROM pairs p JOIN sg_f x ON x.id = p.a JOIN sg_f y ON y.id = p.b LEFT JOIN sg_at t ON t.a = p.a AND t.b = p.b),
signature_match AS (SELECT a, b, score FROM (SELECT a, b, CAST((0.3 * arity + 0.3 * ty + 0.2 * ret + 0.2 * nm) * CASE WHEN ty <= 0.5 AND ret <= 0.5 THEN 0.5 ELSE 1 END AS DOUBLE) AS score FROM sg_parts) WHERE round(score, 12) >= 0.7)""",
    "token_clone": f"""tc_seq AS (SELECT id, token_sequence AS raw, list_transform(token_sequence, lambda t: CASE WHEN t IN {_in(KEYWORDS)} THEN t ELSE '_ID' END) AS norm FROM cat WHERE len(token_sequence) >= 10),
token_clone AS (SELECT a, b, CASE WHEN x.raw = y.raw THEN 1 ELSE 2 END AS clone_type, CASE WHEN x.raw = y.raw THEN 1.0 ELSE 0.9 END::DOUBLE AS score FROM pairs JOIN tc_seq x ON x.id = a JOIN tc_seq y ON y.id = b WHERE x.norm = y.norm)""",
    "ast_similarity": f"""as_in AS ({_two('x.token_sequence AS p, y.token_sequence AS q', 'len(x.token_sequence) >= 10 AND len(y.token_sequence) >= 10')}), {_lcs('as_lcs', 'as_in')},
as_score AS (SELECT i.a, i.b, {_jaccard(_grams(3, 'p'), _grams(3, 'q'))} AS j3, {_jaccard(_grams(5, 'p'), _grams(5, 'q'))} AS j5, 2.0 * l / (len(p) + len(q)) AS lcs, coalesce(x.ast_fingerprint = y.ast_fingerprint, false) AS same
  FROM as_in i JOIN as_lcs c ON c.a = i.a AND c.b = i.b JOIN cat x ON x.id = i.a JOIN cat y ON y.id = i.b),
ast_similarity AS (SELECT a, b, CASE WHEN same THEN 1.0 ELSE 0.3 * j3 + 0.3 * j5 + 0.4 * lcs END::DOUBLE AS score FROM as_score WHERE same OR ((j3 + j5) / 2 >= 0.4 AND round(0.3 * j3 + 0.3 * j5 + 0.4 * lcs, 12) >= 0.6))""",
    "metric_similarity": f"""mt AS (SELECT id, [coalesce(body_lines, end_line - line + 1), cyclomatic_complexity, len(params), len(token_sequence), len(list_filter(token_sequence, lambda t: t IN {_in(OPENERS)})), len(list_distinct(token_sequence))] AS m FROM cat),
mt_gap AS (SELECT a, b, list_filter(list_transform(range(1, 7), lambda k: abs(x.m[k] - y.m[k]) / greatest(x.m[k], y.m[k], 1)::DOUBLE), lambda g: g IS NOT NULL) AS g FROM pairs JOIN mt x ON x.id = a JOIN mt y ON y.id = b WHERE coalesce(x.m[1], 3) >= 3 AND coalesce(y.m[1], 3) >= 3),
metric_similarity AS (SELECT a, b, round(1 - list_avg(g), 4) AS score FROM mt_gap WHERE len(g) >= 3 AND round(1 - list_avg(g), 4) >= 0.9)""",
    "tfidf_index": f"""ti_tok AS (SELECT id, t, count(*) AS c FROM cat, unnest(token_sequence) u(t) GROUP BY ALL), ti_idf AS (SELECT t, ln((SELECT count(*) FROM cat) / count(*)::DOUBLE) AS idf FROM ti_tok GROUP BY t),
ti_f AS (SELECT id, t AS f, c * idf AS x FROM ti_tok JOIN ti_idf USING (t)), {_cosine('ti', 'ti_f', 0.5)},
tfidf_index AS (SELECT a, b, score FROM ti WHERE round((SELECT sum(idf) FROM ti_tok u JOIN ti_tok v USING (t) JOIN ti_idf USING (t) WHERE u.id = a AND v.id = b), 12) >= 0.5)""",
    "winnowing": f"""wn_h AS (SELECT id, list_transform(list_transform(range(1, len(token_sequence) - 3), lambda i: sha256(array_to_string(token_sequence[i:i + 4], chr(0)))), lambda h: translate(h[1], '89abcdef01234567', '0123456789abcdef') || h[2:16]) AS h FROM cat),
wn AS (SELECT id, list_distinct(CASE WHEN len(h) < 4 THEN h ELSE list_transform(range(1, len(h) - 2), lambda i: list_min(h[i:i + 3])) END) AS f FROM wn_h),
winnowing AS (SELECT a, b, s AS score FROM (SELECT a, b, greatest({_jaccard('x.f', 'y.f')}, len(list_intersect(x.f, y.f)) / nullif(least(len(x.f), len(y.f)), 0)::DOUBLE) AS s FROM pairs JOIN wn x ON x.id = a JOIN wn y ON y.id = b) WHERE s >= 0.4)""",
    "lsh_ast": f"lsh_ast AS (SELECT a, b, s AS score FROM ({_two('list_distinct(x.token_sequence) AS p, list_distinct(y.token_sequence) AS q, ' + _jaccard('x.token_sequence', 'y.token_sequence') + ' AS s')}) WHERE len(p) >= 5 AND len(q) >= 5 AND s >= 0.75)",
    "theta": f"theta AS (SELECT a, b, s AS score FROM ({_two(_jaccard('x.token_sequence', 'y.token_sequence') + ' AS s')}) WHERE s >= 0.4)",
    "bag_of_ast": f"ba_f AS (SELECT id, t AS f, count(*) AS x FROM cat, unnest(token_sequence) u(t) GROUP BY ALL), {_cosine('bag_of_ast', 'ba_f', 0.85)}",
    "pdg_semantic": f"""pd_tok AS (SELECT id, i, token_sequence[i] AS t FROM (SELECT id, token_sequence, unnest(range(1, len(token_sequence) + 1)) AS i FROM cat)),
pd_at AS (SELECT id, i, t, sum(CASE WHEN t IN {_in(STATEMENTS)} THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS blk FROM pd_tok),
pd_b AS (SELECT id, blk, string_agg(t, '|' ORDER BY i) AS body, first(t ORDER BY i) AS head FROM pd_at GROUP BY id, blk),
pd AS (SELECT id, list_distinct(list(body || '#' || p || '#' || n)) AS f FROM (SELECT id, body, coalesce(lag(head) OVER w, '_START') AS p, coalesce(lead(head) OVER w, '_END') AS n FROM pd_b WINDOW w AS (PARTITION BY id ORDER BY blk)) GROUP BY id),
pdg_semantic AS (SELECT a, b, s AS score FROM (SELECT a, b, {_jaccard('x.f', 'y.f')} AS s FROM pairs JOIN pd x ON x.id = a JOIN pd y ON y.id = b) WHERE s >= 0.4)""",
    "code_embedding": f"ce_f AS (SELECT id, f, count(*) AS x FROM (SELECT id, unnest(list_concat({', '.join(_grams(k, 'token_sequence') for k in (3, 4, 5))})) AS f FROM cat) GROUP BY ALL), {_cosine('code_embedding', 'ce_f', 0.5)}",
    "llm_semantic": """lg AS (SELECT grp, confidence, functions, i, j FROM (SELECT *, unnest(range(1, len(functions))) AS i FROM grps) t, range(2, len(functions) + 1) r(j) WHERE i < j),
llm_semantic AS (SELECT least(functions[i], functions[j]) AS a, greatest(functions[i], functions[j]) AS b, CASE confidence WHEN 'HIGH' THEN 0.95 WHEN 'MEDIUM' THEN 0.7 WHEN 'LOW' THEN 0.4 ELSE 0.5 END::DOUBLE AS score FROM lg)""",
}


def strategy(name: str, cat: str, columns: str = "a, b, round(score, 4) AS score") -> str:
    return f"WITH RECURSIVE {cat}, {_PAIRS}, {_CTES[name]} SELECT {columns} FROM {name}"


def fused(query: str, cat: str) -> str:
    """A query over merged, cat and truth, from CTEs cat, truth and grps."""
    parts = {k: v for k, v in _CTES.items() if k != "theta"}
    found = " UNION ALL ".join(f"SELECT a, b, '{name}' AS strategy, round(score, 4) AS score FROM {name}" for name in parts)
    weight = _table("weight", WEIGHTS)
    has = lambda name: f"list_contains(names, '{name}')"
    count = lambda names: f"len(list_filter(names, lambda z: z IN {_in(names)}))"
    return f"""WITH RECURSIVE {cat}, {_PAIRS}, {', '.join(parts.values())}, {weight}, sig AS ({found}),
best AS (SELECT a, b, strategy, max(score) AS s, coalesce(max(v), 0.5) AS w FROM sig LEFT JOIN weight ON strategy = k GROUP BY a, b, strategy),
sums AS (SELECT a, b, least(1, sum(w::DOUBLE * s) / sum(w::DOUBLE)) AS mean, count(*) AS n, list(strategy) AS names, max(s) FILTER (WHERE strategy = 'token_clone') AS clone, max(s) FILTER (WHERE strategy = 'ast_similarity') AS ast FROM best GROUP BY a, b),
pen AS (SELECT *, CASE WHEN n = 1 AND {has('signature_match')} THEN 0.7 * mean WHEN n > 1 AND {count(SURFACE)} = n THEN 0.6 * mean ELSE mean END AS c, n - greatest(0, {count(SEQUENCE)} - 2) AS effective FROM sums),
steps AS (SELECT *, CASE WHEN c >= 0.8 THEN 3 WHEN c >= 0.55 THEN 2 WHEN c >= 0.35 THEN 1 ELSE 0 END AS step FROM pen),
rung AS (SELECT *, CASE WHEN effective >= 3 AND c >= 0.5 THEN 3 WHEN n = 1 AND coalesce(clone, 0) < 0.99 THEN least(step, 2) ELSE step END AS r FROM steps),
merged AS (SELECT a, b, round(c, 3) AS composite, n, effective, ['LOW', 'MEDIUM', 'HIGH'][r] AS confidence, names,
  CASE WHEN clone >= 0.99 THEN 'Type 1 (exact clone)' WHEN clone IS NOT NULL OR ast >= 0.95 THEN 'Type 2 (renamed clone)' WHEN ast IS NOT NULL THEN 'Type 3 (near-miss clone)'
    WHEN {has('llm_semantic')} THEN 'Type 4 (semantic clone)' WHEN {has('signature_match')} AND {has('fuzzy_name')} THEN 'Type 3 (near-miss clone)' ELSE 'Type 4 (semantic clone)' END AS clone_type,
  ['REVIEW', 'INVESTIGATE', 'CONSOLIDATE'][r] AS action, CASE WHEN r = 3 AND clone IS NOT NULL THEN 'immediate' ELSE ['low', 'normal', 'high'][r] END AS urgency FROM rung WHERE r > 0)
{query}"""


SUMMARY = """SELECT 'total' AS what, 'all' AS value, count(*) AS n FROM merged HAVING count(*) > 0 UNION ALL SELECT 'confidence', confidence, count(*) FROM merged GROUP BY confidence UNION ALL SELECT 'clone_type', clone_type, count(*) FROM merged GROUP BY clone_type
UNION ALL SELECT 'action', action, count(*) FROM merged GROUP BY action UNION ALL SELECT 'multi_signal', 'yes', count(*) FROM merged WHERE n >= 2 HAVING count(*) > 0 UNION ALL SELECT 'defense_depth', 'yes', count(*) FROM merged WHERE n >= 3 HAVING count(*) > 0
UNION ALL SELECT 'strategy', s, count(*) FROM merged, unnest(names) u(s) GROUP BY s"""

EVALUATE = """, floors(floor, least) AS (VALUES ('LOW', 1), ('MEDIUM', 2), ('HIGH', 3)), det AS (SELECT floor, a, b FROM floors, merged WHERE list_position(['LOW', 'MEDIUM', 'HIGH'], confidence) >= least),
clones AS (SELECT 'all' AS kind, a, b FROM truth WHERE is_clone UNION ALL SELECT coalesce(CAST(clone_type AS VARCHAR), 'unknown'), a, b FROM truth WHERE is_clone),
hits AS (SELECT f.floor, c.kind, count(d.a) AS tp, count(*) - count(d.a) AS fn FROM floors f CROSS JOIN clones c LEFT JOIN det d ON d.floor = f.floor AND d.a = c.a AND d.b = c.b GROUP BY ALL),
wrong AS (SELECT f.floor, count(d.a) AS fp FROM floors f LEFT JOIN (SELECT * FROM det ANTI JOIN clones USING (a, b)) d ON d.floor = f.floor GROUP BY f.floor),
rates AS (SELECT floor, kind, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS r FROM hits JOIN wrong USING (floor))
SELECT floor, kind, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM rates"""

SUPPRESS = f"""SELECT a, b, confidence FROM merged JOIN cat x ON x.id = a JOIN cat y ON y.id = b WHERE NOT coalesce(x.name LIKE '%SelfContained' AND y.name LIKE '%SelfContained', false)
AND NOT coalesce(x.file LIKE '%storage-error%' AND y.file LIKE '%storage-error%' AND x.name IN {_in(FACTORIES)} AND y.name IN {_in(FACTORIES)}, false)
AND NOT coalesce(regexp_matches(x.name, '^(create|get|update|delete)') AND regexp_matches(y.name, '^(create|get|update|delete)') AND x.name <> y.name AND composite < 0.95 AND x.end_line - x.line < 10 AND y.end_line - y.line < 10, false)"""

#: Documents as a catalog: words, lines, and the class of equal ones (its least id stands for it).
_DOCUMENTS = """raw AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> '') AS ws, len(string_split(text, chr(10))) AS n_lines FROM documents),
cls AS (SELECT min(doc_id) AS id, ws, n_lines, count(*) AS n FROM raw GROUP BY ws, n_lines)"""
_LINES = "NOT coalesce(p.n_lines < 3 AND q.n_lines < 3, false) AND NOT coalesce(p.n_lines >= 3 AND q.n_lines >= 3 AND greatest(p.n_lines, q.n_lines) > 3 * least(p.n_lines, q.n_lines), false)"


def _runs(k: int) -> str:
    return f"list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i:i + {k - 1}], '|'))"


#: What a document is compared by; ``id, f`` and, in f's counts, ``x``.
_BY = {
    "words": "SELECT id, unnest(ws) AS f FROM cls", "runs": f"SELECT id, unnest(list_concat({', '.join(_runs(k) for k in (3, 4, 5))})) AS f FROM cls",
    "prints": "SELECT id, unnest(f) AS f FROM (SELECT id, CASE WHEN len(h) < 4 THEN h ELSE list_transform(range(1, len(h) - 2), lambda i: list_min(h[i:i + 3])) END AS f FROM (SELECT id, list_transform(list_transform(range(1, len(ws) - 3), lambda i: sha256(array_to_string(ws[i:i + 4], chr(0)))), lambda h: translate(h[1], '89abcdef01234567', '0123456789abcdef') || h[2:16]) AS h FROM cls))",
    "sentences": """SELECT id, body || '#' || coalesce(lag(head) OVER w, '_START') || '#' || coalesce(lead(head) OVER w, '_END') AS f FROM (SELECT id, blk, string_agg(t, '|' ORDER BY i) AS body, first(t ORDER BY i) AS head
  FROM (SELECT id, i, t, sum(CASE WHEN regexp_matches(t, '^[A-Z]') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS blk FROM (SELECT id, ws[i] AS t, i FROM (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS i FROM cls))) GROUP BY id, blk) WINDOW w AS (PARTITION BY id ORDER BY blk)""",
}


def documents(by: str, score: str, where: str, least: int = 1, weigh: str = "x") -> str:
    """Pairs of document classes that share a feature; ``score`` over c, dot, na, nb, p2, q2 (squared norms) and shared (idf)."""
    return f"""WITH {_DOCUMENTS}, f0 AS (SELECT id, f, count(*) AS x FROM ({_BY[by]}) GROUP BY ALL), df AS (SELECT f, ln((SELECT count(*) FROM documents) / sum(n)::DOUBLE) AS idf FROM f0 JOIN cls USING (id) GROUP BY f),
f1 AS (SELECT id, f, {weigh} AS x, idf FROM f0 JOIN df USING (f)), s AS (SELECT id, count(*) AS k, sum(x * x) AS x2 FROM f1 GROUP BY id HAVING count(*) >= {least}),
met AS (SELECT u.id AS a, v.id AS b, count(*) AS c, sum(u.x * v.x) AS dot, sum(u.idf) AS shared FROM f1 u JOIN f1 v ON u.f = v.f AND u.id < v.id GROUP BY ALL),
pairs AS (SELECT a, b, p.n AS n_a, q.n AS n_b, shared, CAST({score} AS DOUBLE) AS score FROM (SELECT met.*, g.k AS na, h.k AS nb, g.x2 AS p2, h.x2 AS q2 FROM met JOIN s g ON g.id = a JOIN s h ON h.id = b) JOIN cls p ON p.id = a JOIN cls q ON q.id = b WHERE {_LINES})
SELECT a, b, n_a, n_b, round(score, 4) AS score FROM pairs WHERE {where}"""


JACCARD = "c / (na + nb - c)::DOUBLE"
COSINE = "dot / sqrt(p2 * q2)"
#: Each document with the class of equal words and the class of equal words but for those that renaming touches.
CLONES = f"""WITH {_DOCUMENTS}, k AS (SELECT doc_id, ws, list_transform(ws, lambda t: CASE WHEN t IN {_in(KEYWORDS)} THEN t ELSE '_ID' END) AS r FROM raw WHERE len(ws) >= 10),
one AS (SELECT ws, min(doc_id) AS m, count(*) AS n FROM k GROUP BY ws), two AS (SELECT r, min(doc_id) AS m, count(*) AS n FROM k GROUP BY r)
SELECT k.doc_id, one.m AS exact_class, one.n AS exact_members, two.m AS renamed_class, two.n AS renamed_members FROM k JOIN one ON k.ws = one.ws JOIN two ON k.r = two.r"""
#: Each document with its class and the class's size.
MEMBERS = f"WITH {_DOCUMENTS} SELECT doc_id, id AS class_id, n AS members FROM raw JOIN cls ON raw.ws IS NOT DISTINCT FROM cls.ws AND raw.n_lines IS NOT DISTINCT FROM cls.n_lines"
#: Documents by lines, words, opening words and vocabulary; equal ones are one vector.
METRICS = f"""WITH {_DOCUMENTS}, v AS (SELECT min(id) AS id, [l, t, o, w] AS m, sum(n)::BIGINT AS n FROM (SELECT id, n, n_lines AS l, len(ws) AS t, len(list_filter(ws, lambda t: t IN {_in(OPENERS)})) AS o, len(list_distinct(ws)) AS w FROM cls) WHERE coalesce(l, 3) >= 3 AND t IS NOT NULL GROUP BY l, t, o, w),
g AS (SELECT p.id AS a, q.id AS b, p.n AS n_a, q.n AS n_b, 1 - list_avg(list_transform(range(1, 5), lambda k: abs(p.m[k] - q.m[k]) / greatest(p.m[k], q.m[k], 1)::DOUBLE)) AS s FROM v p JOIN v q ON p.id < q.id)
SELECT a, b, n_a, n_b, round(s, 4) AS score FROM g WHERE round(s, 4) >= 0.9"""
#: Cosine of word counts of benchmark items, all pairs.
COSINES = """WITH w AS (SELECT item_id AS id, w, count(*) AS x FROM (SELECT item_id, unnest(regexp_split_to_array(text, '[ \\t\\n\\r]+')) AS w FROM benchmark) WHERE w <> '' GROUP BY ALL), n AS (SELECT id, sqrt(sum(x * x)) AS n FROM w GROUP BY id),
met AS (SELECT x.id AS a, y.id AS b, sum(x.x * y.x) AS dot FROM w x JOIN w y ON x.w = y.w AND x.id < y.id GROUP BY ALL)
SELECT a, b, round(dot / (p.n * q.n), 4) AS score FROM met JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE round(dot / (p.n * q.n), 12) >= 0.3"""
#: Parts as functions: distinct names, and distinct signatures of parameters and result.
_PARTS = """part_names AS (SELECT p_type || ' ' || p_name AS name, count(*) AS n FROM part GROUP BY ALL), cat AS (SELECT row_number() OVER (ORDER BY name) AS id, name, n, CAST(NULL AS VARCHAR) AS file, CAST(NULL AS VARCHAR) AS qualified_name, CAST(NULL AS BIGINT) AS line, CAST(NULL AS BIGINT) AS body_lines, CAST(NULL AS VARCHAR[]) AS params, CAST(NULL AS BIGINT) AS cyclomatic_complexity FROM part_names)"""
NAMES = f"WITH RECURSIVE {_PARTS}, {_PAIRS}, {_CTES['fuzzy_name']} SELECT x.name AS p, y.name AS q, x.n AS n_p, y.n AS n_q, round(score, 4) AS score FROM fuzzy_name JOIN cat x ON x.id = a JOIN cat y ON y.id = b"
_SIGNED = """sizes AS (SELECT p_name, p_type, p_size % 3 AS k, p_brand FROM part), made AS (SELECT list_transform(range(1, k + 2), lambda i: {'name': string_split(p_name, ' ')[CAST(i % 2 + 1 AS INTEGER)], 'type': CASE WHEN i = 1 THEN p_type ELSE 'string' END, 'optional': i > 2}) AS params, CASE WHEN p_brand < 'Brand#15' THEN 'list' ELSE 'int' END AS return_type FROM sizes),
signs AS (SELECT params, return_type, count(*) AS n FROM made GROUP BY ALL), cat AS (SELECT row_number() OVER (ORDER BY params, return_type) AS id, params, return_type, n, CAST(NULL AS VARCHAR) AS file, CAST(id AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS qualified_name, CAST(NULL AS BIGINT) AS line, CAST(NULL AS BIGINT) AS body_lines, CAST(NULL AS BIGINT) AS cyclomatic_complexity FROM signs)"""
_SHOWN = "array_to_string(list_transform({0}.params, lambda v: v.name || ':' || v.type), ',') || '>' || {0}.return_type"
SIGNATURES = f"WITH RECURSIVE {_SIGNED}, {_PAIRS}, {_CTES['signature_match']} SELECT least({_SHOWN.format('x')}, {_SHOWN.format('y')}) AS p, greatest({_SHOWN.format('x')}, {_SHOWN.format('y')}) AS q, x.n * y.n AS links, round(score, 4) AS score FROM signature_match JOIN cat x ON x.id = a JOIN cat y ON y.id = b"

#: Exact Jaccard of the word sets of all document classes, over all pairs that share a word, and every other member of a class with its least.
WORD_SETS = f"""WITH {_DOCUMENTS}, w AS (SELECT DISTINCT id, w FROM (SELECT id, unnest(ws) AS w FROM cls)), s AS (SELECT id, count(*) AS k FROM w GROUP BY id HAVING count(*) >= 5),
met AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM w x JOIN w y ON x.w = y.w AND x.id < y.id GROUP BY ALL)
SELECT a, b, p.n AS n_a, q.n AS n_b, round(c / (g.k + h.k - c)::DOUBLE, 4) AS score FROM met JOIN s g ON g.id = a JOIN s h ON h.id = b JOIN cls p ON p.id = a JOIN cls q ON q.id = b WHERE 4 * c >= 3 * (g.k + h.k - c)
UNION ALL SELECT cls.id, doc_id, n, 1, 1.0 FROM raw JOIN cls ON raw.ws = cls.ws AND raw.n_lines = cls.n_lines JOIN s ON s.id = cls.id WHERE doc_id <> cls.id"""
#: Longest common subsequence of consecutive turns' words.
TURNS = f"""WITH RECURSIVE turns AS (SELECT conv_id, turn, regexp_split_to_array(text, '[ \\t\\n\\r]+') AS w FROM conversations),
met AS (SELECT x.conv_id AS a, x.turn AS b, x.w AS p, y.w AS q FROM turns x JOIN turns y ON x.conv_id = y.conv_id AND x.turn + 1 = y.turn), {_lcs('l', 'met')}
SELECT a AS conv_id, b AS turn, round(2.0 * l / (len(p) + len(q)), 4) AS lcs FROM l JOIN met USING (a, b)"""
