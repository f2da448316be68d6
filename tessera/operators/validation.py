"""Declarative validators: extraction, routing and line rules over text tables, and verification receipts."""

from __future__ import annotations

from tessera.plans.dialect import REGISTRY, SparkDialect

plan = REGISTRY.plan


def lines(d: SparkDialect, table: str, key: str, text: str = "text") -> str:
    """CTE ln(id, pos, item)."""
    return f"ln AS (SELECT {key} AS id, pos, item FROM {d.rows(key, d.lines(text), d.table(table))} x)"


def bead(d: SparkDialect) -> str:
    """A markdown record built from an order, for the field extractors."""
    s = "string" if d.name == "spark" else "varchar"
    return f"concat('**BeadID:** B-', cast(o_orderkey AS {s}), chr(10), '**Status:** ', lower(o_orderstatus), chr(10), '**Scope:** a/b.py, (none), - src/x', cast(o_custkey % 7 AS {s}), '.ts', chr(10), '## Notes', chr(10), '| k | ', o_orderpriority, ' |')"


@plan("src_04_markdown_fields")
def markdown_fields(d):
    return f"""WITH b AS (SELECT o_orderkey, {bead(d)} AS md FROM {d.table('orders')} o)
SELECT o_orderkey, {d.extract('md', '(?m)^\\*\\*BeadID:\\*\\* *(.*)$')} AS bead_id, {d.extract('md', '(?m)^\\*\\*Status:\\*\\* *(.*)$')} AS status, coalesce(nullif({d.extract('md', '(?m)^\\*\\*Owner:\\*\\* *(.*)$')}, ''), 'unassigned') AS owner FROM b"""


@plan("src_05_scope_files")
def scope_files(d):
    scope = d.extract("md", "(?m)^\\*\\*Scope:\\*\\* *(.*)$")
    return f"""WITH b AS (SELECT o_orderkey, {bead(d)} AS md FROM {d.table('orders')} o), p AS (SELECT o_orderkey, pos, item FROM {d.rows('o_orderkey', d.words(scope, ','), 'b')} x)
SELECT o_orderkey, pos, trim({d.replace('trim(item)', '^[-*] ', '')}) AS file FROM p WHERE trim(item) <> '(none)'"""


@plan("src_09_heading_blocks")
def heading_blocks(d):
    return f"WITH b AS (SELECT o_orderkey, {bead(d)} AS md FROM {d.table('orders')} o) SELECT o_orderkey, pos, cast(length(item) AS bigint) AS n FROM {d.rows('o_orderkey', d.words('md', '(?m)^## '), 'b')} x"


@plan("src_10_table_rows")
def table_rows(d):
    return f"WITH b AS (SELECT o_orderkey, {bead(d)} AS md FROM {d.table('orders')} o) SELECT o_orderkey, trim({d.extract('md', '(?m)^\\|([^|]*)\\|')}) AS k, trim({d.extract('md', '(?m)^\\|[^|]*\\|([^|]*)\\|')}) AS v FROM b"


@plan("src_11_convention_map")
def convention_map(d):
    text = "concat('### ', p_brand, chr(10), 'scope: ', p_type, ',', p_name)"
    return f"WITH c AS (SELECT p_partkey, {text} AS md FROM {d.table('part')} p), s AS (SELECT p_partkey, {d.extract('md', '(?m)^### (.*)$')} AS convention, {d.extract('md', '(?m)^scope: (.*)$')} AS scope FROM c) SELECT p_partkey, convention, trim(item) AS scope_dir FROM {d.rows('p_partkey, convention', d.words('scope', ','), 's')} x"


@plan("src_02_jsonl")
def jsonl(d):
    """Well-formed rows of a JSON column; the rest is counted apart."""
    return f"SELECT event_id, cast({d.json('props', '$.k')} AS bigint) AS k FROM {d.table('events')} e WHERE {d.json('props', '$.k')} IS NOT NULL"


@plan("fn_21_stem_convention")
def stem_convention(d):
    stem = d.replace(d.extract("url", "([^/?#]+)(?:[?#].*)?$"), "\\.[A-Za-z0-9]+$", "")
    return f"SELECT page_id, stem, CASE WHEN {d.matches('stem', '^[a-z0-9]+(-[a-z0-9]+)+$')} THEN 'kebab' WHEN {d.matches('stem', '^[a-z0-9]+(_[a-z0-9]+)+$')} THEN 'snake' WHEN {d.matches('stem', '^[A-Z]')} THEN 'pascal' WHEN {d.matches('stem', '^[a-z]+[A-Z]')} THEN 'camel' ELSE 'plain' END AS convention FROM (SELECT page_id, {stem} AS stem FROM {d.table('pages')} p) t"


@plan("fn_23_vendor_filter")
def vendor(d):
    return f"SELECT page_id FROM {d.table('pages')} p WHERE NOT {d.matches('url', '(^|/)(vendor|node_modules|dist|www[.])')}"


@plan("fn_24_enum_and_decimal")
def enum_decimal(d):
    return f"SELECT o_orderkey, o_orderstatus IN ('F', 'O') AS known, {d.matches('o_orderpriority', '^[0-9]+-')} AS numbered FROM {d.table('orders')} o"


@plan("flt_11_block_fields")
def block_fields(d):
    return f"SELECT conv_id, turn, role = 'assistant' AND length(text) < 20 AS too_short, role = 'user' AND NOT {d.matches('text', '[.?!]$')} AS no_end FROM {d.table('conversations')} c"


@plan("flt_14_section_markers")
def section_markers(d):
    return f"SELECT page_id, {d.extract('html', '<h1>([^<]*)</h1>')} AS title, {d.matches('html', '<h1>[^<]{20,}')} AS long_title FROM {d.table('pages')} p"


@plan("flt_15_runner_output")
def runner_output(d):
    return f"""WITH {lines(d, 'documents', 'doc_id')}, c AS (SELECT id, pos, item, lag(item, 1) OVER w AS a, lag(item, 2) OVER w AS b FROM ln WINDOW w AS (PARTITION BY id ORDER BY pos))
SELECT id, count(CASE WHEN length(coalesce(a, '')) > 100 OR length(coalesce(b, '')) > 100 THEN 1 END) AS n_context, count(*) AS n FROM c WHERE length(item) < 40 GROUP BY id"""


@plan("flt_16_rule_tree")
def rule_tree(d):
    return f"SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'act' WHEN o_totalprice > 300000 THEN 'probe' WHEN o_orderstatus = 'P' THEN 'sense' WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'categorise' ELSE 'analyse' END AS label FROM {d.table('orders')} o"


@plan("flt_18_receipts")
def receipts(d):
    return f"""WITH e AS (SELECT DISTINCT o_orderkey FROM {d.table('orders')} o), r AS (SELECT l_orderkey, count(*) AS n FROM {d.table('lineitem')} l GROUP BY l_orderkey)
SELECT CASE WHEN n IS NULL THEN 'missing' WHEN n > 7 THEN 'excess' ELSE 'valid' END AS state, count(*) AS n FROM e LEFT JOIN r ON o_orderkey = l_orderkey GROUP BY 1"""


@plan("flt_19_inventory")
def inventory(d):
    return f"SELECT source, count(*) AS counted, count(DISTINCT doc_id) AS unique_ids, count(*) = count(DISTINCT doc_id) AS consistent FROM {d.table('documents')} x GROUP BY source"


@plan("flt_21_observations")
def observations(d):
    return f"SELECT doc_id, text = '' AS empty, {d.contains('text', d.text('the '))} AS has, {d.matches('text', '[0-9]{3}')} AS matched, {d.size(d.all_matches('text', 'rights reserved'))} = 1 AS exactly_one FROM {d.table('documents')} x"


@plan("jn_14_anti")
def anti(d):
    return f"SELECT doc_id FROM {d.table('documents')} x WHERE NOT EXISTS (SELECT 1 FROM {d.table('labels')} l WHERE l.doc_id = x.doc_id)"


@plan("jn_15_semi")
def semi(d):
    return f"SELECT doc_id, lang FROM {d.table('documents')} x WHERE EXISTS (SELECT 1 FROM {d.table('labels')} l WHERE l.doc_id = x.doc_id AND quality = 1)"


@plan("jn_18_siblings")
def siblings(d):
    """Pages of a directory that were not themselves touched."""
    folder = d.replace(d.replace("url", "[?#].*$", ""), "/[^/]*$", "")
    return f"""WITH p AS (SELECT page_id, {folder} AS dir FROM {d.table('pages')} x), t AS (SELECT DISTINCT dir FROM p WHERE page_id % 10 = 0)
SELECT p.page_id, p.dir FROM p JOIN t ON p.dir = t.dir WHERE p.page_id % 10 <> 0"""


@plan("jn_16_requirement_checks")
def requirement_checks(d):
    """Requirements with the checks that name them, and their status."""
    return f"""WITH req AS (SELECT n_nationkey AS rid FROM {d.table('nation')} n), c AS (SELECT s_suppkey AS cid, s_nationkey AS rid, CASE WHEN s_acctbal < 0 THEN 'FAIL' WHEN s_acctbal < 2000 THEN 'INCONCLUSIVE' ELSE 'PASS' END AS verdict FROM {d.table('supplier')} s)
SELECT req.rid, count(cid) AS n_checks, count(CASE WHEN verdict = 'PASS' THEN 1 END) AS n_pass FROM req LEFT JOIN c ON req.rid = c.rid GROUP BY req.rid"""


@plan("agg_34_verdict_lattice")
def lattice(d):
    return f"""WITH c AS (SELECT s_nationkey AS rid, CASE WHEN s_acctbal < 0 THEN 'FAIL' WHEN s_acctbal < 2000 THEN 'INCONCLUSIVE' ELSE 'PASS' END AS verdict FROM {d.table('supplier')} s)
SELECT rid, CASE WHEN max(CASE WHEN verdict = 'FAIL' THEN 1 ELSE 0 END) = 1 THEN 'FAIL' WHEN max(CASE WHEN verdict = 'INCONCLUSIVE' THEN 1 ELSE 0 END) = 1 THEN 'INCONCLUSIVE' ELSE 'PASS' END AS verdict FROM c GROUP BY rid"""


@plan("agg_35_requirement_status")
def requirement_status(d):
    return f"""WITH r AS (SELECT n_nationkey AS rid, count(s_suppkey) AS n, min(s_acctbal) AS worst FROM {d.table('nation')} n LEFT JOIN {d.table('supplier')} s ON n_nationkey = s_nationkey GROUP BY n_nationkey)
SELECT rid, CASE WHEN n = 0 THEN 'UNCOVERED' WHEN worst < 0 THEN 'VIOLATED' WHEN worst < 1000 THEN 'UNPROVEN' ELSE 'SATISFIED' END AS status FROM r"""


@plan("snk_05_dead_letters")
def dead_letters(d):
    """Rows that break a constraint of the store go to the reject side, with the reason."""
    return f"SELECT event_id, CASE WHEN value < 0.1 THEN 'range' WHEN event_type NOT IN ('error', 'view', 'signup', 'purchase', 'click') THEN 'kind' END AS reason FROM {d.table('events')} e WHERE value < 0.1 OR event_type NOT IN ('error', 'view', 'signup', 'purchase', 'click')"


@plan("snk_03_review_append")
def review_append(d):
    return f"SELECT doc_id, quality FROM {d.table('labels')} l WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {d.table('benchmark')} b WHERE b.item_id = l.doc_id)"
