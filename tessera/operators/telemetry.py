"""Quality telemetry: budgets, convergence, noise, hazards and stress yields as declarative plans.

A task is a customer, a bead an order; status, priority and lines play the bead's fields.  Divisions that the budget
arithmetic truncates to two places are truncated here too.
"""

from __future__ import annotations

from tessera.plans.dialect import REGISTRY, SparkDialect

plan = REGISTRY.plan

def trunc2(x: str) -> str:
    return f"floor(({x}) * 100 + 0.0000001) / 100"


def beads(d: SparkDialect) -> str:
    """CTE bead(task, id, status, domain, l0, l1, l2, turbulence, has_field) and per(task, ...): one row per task."""
    return f"""lines AS (SELECT l_orderkey, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS l0, count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS l1, count(CASE WHEN l_tax > 0.06 THEN 1 END) AS l2 FROM {d.table('lineitem')} l GROUP BY l_orderkey),
bead AS (SELECT o_custkey AS task, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'wip' ELSE 'stuck' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'chaotic' WHEN '2-HIGH' THEN 'complex' WHEN '3-MEDIUM' THEN 'complicated' ELSE 'clear' END AS domain,
  coalesce(l0, 0) AS l0, coalesce(l1, 0) AS l1, coalesce(l2, 0) AS l2, coalesce(l0 + l1 + l2, 0) AS turbulence, CASE WHEN l0 IS NULL THEN 0 ELSE 1 END AS has_field FROM {d.table('orders')} o LEFT JOIN lines ON o_orderkey = l_orderkey),
per AS (SELECT task, count(*) AS total, count(CASE WHEN status = 'completed' THEN 1 END) AS completed, count(CASE WHEN status = 'wip' THEN 1 END) AS wip, count(CASE WHEN status = 'stuck' THEN 1 END) AS stuck,
  count(CASE WHEN domain = 'complicated' THEN 1 END) AS n_complicated, count(CASE WHEN domain = 'complex' THEN 1 END) AS n_complex, count(CASE WHEN domain = 'chaotic' THEN 1 END) AS n_chaotic, count(CASE WHEN domain = 'clear' THEN 1 END) AS n_clear,
  cast(sum(l0) AS bigint) AS s0, cast(sum(l1) AS bigint) AS s1, cast(sum(l2) AS bigint) AS s2, cast(sum(turbulence) AS bigint) AS turbulence, count(CASE WHEN status = 'completed' AND has_field = 1 AND turbulence = 0 THEN 1 END) AS quiet FROM bead GROUP BY task)"""


@plan("src_06_turbulence_map")
def turbulence_map(d):
    """A positional map field and its reading back."""
    body = "concat('**Turbulence:** {L0: ', cast(l_linenumber AS varchar(9)), ', L1: ', cast(cast(l_quantity AS bigint) AS varchar(9)), '}')".replace("varchar(9)", "string" if d.name == "spark" else "varchar")
    return f"""SELECT l_orderkey, l_linenumber, sum(cast({d.extract(body, 'L0: *([0-9]+)')} AS bigint) * 1) AS l0, cast(max({d.extract(body, 'L1: *([0-9]+)')}) AS bigint) AS l1 FROM {d.table('lineitem')} l GROUP BY l_orderkey, l_linenumber""".replace("sum(cast(", "max(cast(").replace(" AS bigint) * 1) AS l0", " AS bigint)) AS l0")


def passes(d: SparkDialect) -> str:
    """CTE pass(grp, id, rn, d0..d3, verdict): review passes of a group; four dimensions of 1 to 5."""
    return f"pass AS (SELECT l_orderkey AS grp, l_linenumber AS id, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS bigint) AS rn, 1 + l_linenumber % 5 AS d0, 1 + l_partkey % 5 AS d1, 1 + l_suppkey % 5 AS d2, 1 + cast(l_quantity AS bigint) % 5 AS d3, l_returnflag AS verdict FROM {d.table('lineitem')} l)"


@plan("jn_10_parent_child")
def parent_child(d):
    return f"WITH {passes(d)} SELECT y.grp, y.rn, y.verdict, x.verdict AS parent_verdict FROM pass y LEFT JOIN pass x ON x.grp = y.grp AND x.rn = y.rn - 1"


@plan("jn_11_first_two")
def first_two(d):
    return f"WITH {passes(d)} SELECT grp, max(CASE WHEN rn = 1 THEN verdict END) AS first_verdict, max(CASE WHEN rn = 2 THEN verdict END) AS second_verdict FROM pass WHERE rn <= 2 GROUP BY grp HAVING count(*) = 2"


@plan("jn_12_pairs_within")
def pairs_within(d):
    return f"WITH {passes(d)} SELECT x.grp, count(*) AS n_pairs FROM pass x JOIN pass y ON x.grp = y.grp AND x.rn < y.rn GROUP BY x.grp"


@plan("agg_31_ledger_seed")
def ledger_seed(d):
    """Records numbered by nested ordinals."""
    s = "string" if d.name == "spark" else "varchar"
    return f"""SELECT o_custkey, concat('HDL-', cast(o_custkey AS {s}), '-CA', cast(ca AS {s}), '-UCA', cast(uca AS {s})) AS id FROM (SELECT o_custkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ca, row_number() OVER (PARTITION BY o_custkey, o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS uca FROM {d.table('orders')} o JOIN {d.table('lineitem')} l ON o_orderkey = l_orderkey) t"""


@plan("agg_32_repeated_fingerprints")
def repeated_fingerprints(d):
    return f"SELECT concat(lang, ':', substr(text, 1, 40)) AS fingerprint, count(*) AS n FROM {d.table('documents')} x GROUP BY concat(lang, ':', substr(text, 1, 40)) HAVING count(*) > 1"


@plan("agg_33_stress_yield")
def stress_yield(d):
    return f"SELECT p_type, {trunc2('count(CASE WHEN p_size > 25 THEN 1 END) / cast(count(*) AS double)')} AS stress_yield FROM {d.table('part')} p GROUP BY p_type"


@plan("agg_36_first_pass")
def first_pass(d):
    """First-pass rate per level, the product end to end, and the bottleneck with those within 0.05 of it."""
    return f"""WITH r AS (SELECT o_orderpriority AS level, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) / cast(count(*) AS double) AS rate FROM {d.table('orders')} o GROUP BY o_orderpriority)
SELECT level, round(rate, 4) AS rate, round(exp((SELECT sum(ln(rate)) FROM r)), 4) AS end_to_end, rate <= (SELECT min(rate) FROM r) + 0.05 AS bottleneck FROM r"""


@plan("agg_40_dominant_domain")
def dominant(d):
    return f"WITH {beads(d)}, n AS (SELECT task, domain, count(*) AS c FROM bead GROUP BY task, domain), r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY c DESC, CASE domain WHEN 'clear' THEN 0 WHEN 'complicated' THEN 1 WHEN 'complex' THEN 2 ELSE 3 END) AS k FROM n) SELECT task, domain FROM r WHERE k = 1"


@plan("fn_26_sampling_seed")
def sampling_seed(d):
    s = "string" if d.name == "spark" else "varchar"
    h = f"substr({d.sha(f'cast(o_orderkey AS {s})')}, 1, 8)"
    n = f"cast(conv({h}, 16, 10) AS bigint)" if d.name == "spark" else f"CAST(('0x' || {h}) AS BIGINT)"
    return f"SELECT o_orderkey, round({n} / cast(4294967295 AS double), 6) AS seed FROM {d.table('orders')} o"


@plan("fn_27_nines")
def nines(d):
    return f"SELECT source, CASE WHEN rate < 1 THEN round(-log10(1 - rate), 4) END AS nines FROM (SELECT source, avg(CASE WHEN n_chars > 200 THEN 1.0 ELSE 0.0 END) AS rate FROM {d.table('documents')} x GROUP BY source) t"
