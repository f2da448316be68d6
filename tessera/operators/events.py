"""Event store, findings, control loops and ledgers as declarative plans.

The synthetic ``events`` play the event store: the user is the bead, user_id mod 10 the workstream; errors are
failures and purchases completions.  "Now" is always a parameter; by default it is the last timestamp of the data.
"""

from __future__ import annotations

from tessera.plans.dialect import REGISTRY, SparkDialect

plan = REGISTRY.plan


def store(d: SparkDialect) -> str:
    """CTE ev(event_id, ws, bead, us, kind, value, k)."""
    return f"""ev AS (SELECT event_id, user_id % 10 AS ws, user_id AS bead, {d.micros('ts')} AS us, CASE event_type WHEN 'error' THEN 'bead_failed' WHEN 'purchase' THEN 'bead_completed'
  WHEN 'signup' THEN 'bead_escalated' WHEN 'view' THEN 'bead_retried' ELSE 'bead_noted' END AS kind, value, cast({d.json('props', '$.k')} AS bigint) AS k FROM {d.table('events')} e),
now AS (SELECT max(us) AS us FROM ev)"""


@plan("agg_01_stuck_task")
def stuck_task(d, least: int = 3):
    return f"WITH {store(d)} SELECT ws, bead, count(*) AS retries FROM ev WHERE kind = 'bead_retried' GROUP BY ws, bead HAVING count(*) >= {least}"


@plan("agg_02_oscillating")
def oscillating(d, least: int = 3):
    """Beads that came to an end, well or badly, three times or more in all."""
    return f"""WITH {store(d)} SELECT bead, count(CASE WHEN kind = 'bead_completed' THEN 1 END) AS completed, count(CASE WHEN kind = 'bead_failed' THEN 1 END) AS failed FROM ev
WHERE kind IN ('bead_completed', 'bead_failed') GROUP BY bead HAVING count(*) >= {least}"""


@plan("agg_06_review_disagreement")
def disagreement(d):
    return f"WITH {store(d)} SELECT bead, count(*) AS n FROM ev WHERE kind = 'bead_failed' AND k IS NOT NULL AND k <> 0 GROUP BY bead HAVING count(*) >= 3"


@plan("agg_08_cost_map")
def cost_map(d):
    """A session's cost, shared equally by its beads, duplicates counted: an order's price over its lines' parts."""
    return f"""WITH n AS (SELECT l_orderkey, count(*) AS n FROM {d.table('lineitem')} l GROUP BY l_orderkey)
SELECT l_partkey, round(sum(o_totalprice / n), 2) AS cost FROM {d.table('lineitem')} l JOIN n ON l.l_orderkey = n.l_orderkey JOIN {d.table('orders')} o ON l.l_orderkey = o.o_orderkey GROUP BY l_partkey"""


@plan("agg_09_completion_rate")
def completion_rate(d):
    return f"""SELECT ws, dispatched, done, round(coalesce(done / cast(nullif(dispatched, 0) AS double), 0), 4) AS rate FROM (SELECT user_id % 10 AS ws, count(DISTINCT CASE WHEN event_type = 'signup' THEN user_id END) AS dispatched,
count(DISTINCT CASE WHEN event_type = 'purchase' AND value > 50 THEN user_id END) AS done FROM {d.table('events')} e GROUP BY user_id % 10) t"""


@plan("agg_11_log_stats")
def log_stats(d):
    return f"""SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, round(avg(value), 4) AS mean, max(value) AS most, count(CASE WHEN {d.matches('props', '"k": [0-9]$|"k": [0-9]}')} THEN 1 END) AS n_tagged FROM {d.table('events')} e GROUP BY event_type"""


@plan("agg_12_budget_check")
def budget_check(d):
    return f"""SELECT c_custkey, round(spent, 2) AS spent, CASE WHEN spent >= ceiling THEN 'exceeded' WHEN spent >= 0.8 * ceiling THEN 'warning' ELSE 'normal' END AS state
FROM (SELECT c_custkey, coalesce(sum(o_totalprice), 0) AS spent, 2000000.0 AS ceiling FROM {d.table('customer')} c LEFT JOIN {d.table('orders')} o ON c.c_custkey = o.o_custkey GROUP BY c_custkey) t"""


@plan("win_01_latest_journal")
def latest_journal(d, n: int = 3):
    return f"SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM {d.table('conversations')} c) t WHERE k <= {n}"


@plan("win_03_failure_breaker")
def breaker(d, failures: int = 3, seconds: int = 3600):
    """At least ``failures`` in the trailing window (strict bound); a tripped breaker stays tripped."""
    return f"""WITH {store(d)}, f AS (SELECT bead, event_id, us, count(*) OVER (PARTITION BY bead ORDER BY us RANGE BETWEEN {seconds * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS n FROM ev WHERE kind = 'bead_failed')
SELECT bead, event_id, n, max(CASE WHEN n >= {failures} THEN 1 ELSE 0 END) OVER (PARTITION BY bead ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tripped FROM f"""


@plan("win_16_failure_streak")
def failure_streak(d):
    """Runs of failures, ended by a success: alert at three, degraded from five on."""
    return f"""WITH {store(d)}, g AS (SELECT bead, event_id, us, kind, sum(CASE WHEN kind = 'bead_completed' THEN 1 ELSE 0 END) OVER (PARTITION BY bead ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM ev WHERE kind IN ('bead_failed', 'bead_completed')),
s AS (SELECT bead, event_id, cast(row_number() OVER (PARTITION BY bead, island ORDER BY us, event_id) AS bigint) AS streak FROM g WHERE kind = 'bead_failed')
SELECT bead, event_id, streak, CASE WHEN streak = 3 THEN 'alert' WHEN streak >= 5 THEN 'degraded' ELSE 'ok' END AS state FROM s"""


@plan("win_11_clean_streak")
def clean_streak(d):
    """Longest run of events without a failure, by bead."""
    return f"""WITH {store(d)}, g AS (SELECT bead, kind, sum(CASE WHEN kind = 'bead_failed' THEN 1 ELSE 0 END) OVER (PARTITION BY bead ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM ev)
SELECT bead, max(n) AS longest FROM (SELECT bead, island, count(CASE WHEN kind <> 'bead_failed' THEN 1 END) AS n FROM g GROUP BY bead, island) t GROUP BY bead"""


@plan("ord_03_event_query")
def event_query(d):
    """The last 20 failures of each workstream, newest first."""
    return f"WITH {store(d)} SELECT ws, event_id, us, k FROM (SELECT ws, event_id, us, cast(row_number() OVER (PARTITION BY ws ORDER BY us DESC, event_id DESC) AS bigint) AS k FROM ev WHERE kind = 'bead_failed') t WHERE k <= 20"


@plan("ord_05_established_first")
def established_first(d):
    return f"SELECT s_suppkey, cast(row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_acctbal >= 5000 THEN 0 ELSE 1 END, s_suppkey) AS bigint) AS place FROM {d.table('supplier')} s"


@plan("set_01_pair_sets")
def pair_sets(d):
    return f"""SELECT 'both' AS part, user_id FROM (SELECT user_id FROM {d.table('events')} a WHERE event_type = 'error' INTERSECT SELECT user_id FROM {d.table('events')} b WHERE event_type = 'purchase') t
UNION ALL SELECT 'left', user_id FROM (SELECT user_id FROM {d.table('events')} a WHERE event_type = 'error' AND value > 150 EXCEPT SELECT user_id FROM {d.table('events')} b WHERE event_type = 'purchase' AND value > 150) u"""


@plan("set_02_union_catalogs")
def union_catalogs(d):
    return f"SELECT 'document' AS kind, doc_id AS id, source AS place FROM {d.table('documents')} a UNION ALL SELECT 'page', page_id, url FROM {d.table('pages')} b UNION ALL SELECT 'item', item_id, NULL FROM {d.table('benchmark')} c"


@plan("set_03_unordered_pairs")
def unordered_pairs(d):
    return f"SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM {d.table('lineitem')} l"


@plan("set_04_distinct")
def distinct(d):
    return f"SELECT DISTINCT source, lang FROM {d.table('documents')} x"


@plan("str_02_exactly_once")
def exactly_once(d):
    """First by event id, then first by idempotency key; keyless events are set apart, not collapsed."""
    return f"""WITH {store(d)}, keyed AS (SELECT *, CASE WHEN k % 10 = 0 THEN NULL ELSE concat(cast(bead AS varchar(20)), ':', cast(k AS varchar(20))) END AS idem FROM ev),
one AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY us) AS r FROM keyed), two AS (SELECT *, row_number() OVER (PARTITION BY idem ORDER BY us, event_id) AS q FROM one WHERE r = 1)
SELECT event_id, idem, CASE WHEN idem IS NULL THEN 'dead_letter' WHEN q = 1 THEN 'stored' ELSE 'ignored' END AS fate FROM two"""


@plan("str_01_ingest")
def ingest(d):
    """Batch twin of the inbox ingest: what each hour's batch stores, and what it ignores."""
    return f"""WITH {store(d)}, r AS (SELECT cast(floor(us / 3600000000.0) AS bigint) AS hour, row_number() OVER (PARTITION BY bead, k ORDER BY us, event_id) AS q FROM ev)
SELECT hour, count(*) AS n_read, count(CASE WHEN q = 1 THEN 1 END) AS n_stored FROM r GROUP BY hour"""


@plan("str_03_value_tier")
def value_tier(d):
    return f"""WITH {store(d)} SELECT CASE WHEN kind IN ('bead_failed', 'bead_escalated') THEN 'enriched' WHEN kind IN ('bead_completed', 'bead_retried') THEN 'condensed' ELSE 'logged' END AS level, count(*) AS n FROM ev GROUP BY 1"""


@plan("jn_06_stale_join")
def stale_join(d):
    return f"""WITH {store(d)}, agents AS (SELECT bead, max(us) AS beat FROM ev WHERE kind = 'bead_noted' GROUP BY bead), tasks AS (SELECT event_id, bead, us FROM ev WHERE kind = 'bead_escalated')
SELECT event_id, t.bead FROM tasks t JOIN agents a ON t.bead = a.bead WHERE a.beat < t.us"""


@plan("str_12_late_corrections")
def late_corrections(d):
    """Escapes confirmed later are summed beside an immutable ledger."""
    return f"""WITH {store(d)}, base AS (SELECT bead, count(*) AS n FROM ev WHERE kind = 'bead_completed' GROUP BY bead), late AS (SELECT bead, count(*) AS n FROM ev WHERE kind = 'bead_failed' AND k > 50 GROUP BY bead)
SELECT b.bead, b.n AS n_done, coalesce(l.n, 0) AS n_escapes FROM base b LEFT JOIN late l ON b.bead = l.bead"""


@plan("snk_07_category_split")
def category_split(d):
    return f"SELECT doc_id, lang, source FROM (SELECT doc_id, lang, source, count(*) OVER (PARTITION BY lang, source) AS n FROM {d.table('documents')} x) t WHERE n >= 3"


@plan("jn_asof_state")
def asof_state(d):
    """The bead's last completion as of each failure."""
    return f"""WITH {store(d)}, w AS (SELECT bead, event_id, us, kind, max(CASE WHEN kind = 'bead_completed' THEN us END) OVER (PARTITION BY bead ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS done_us FROM ev WHERE kind IN ('bead_failed', 'bead_completed'))
SELECT bead, event_id, coalesce(done_us, -1) AS done_us FROM w WHERE kind = 'bead_failed'"""


@plan("fn_25_idempotency_key")
def idempotency_key(d):
    """The 31-multiplier string hash in signed base 36, folded without overflow."""
    body = "concat(cast(event_id AS varchar(20)), ':', event_type)".replace("varchar(20)", "string") if d.name == "spark" else "concat(CAST(event_id AS VARCHAR), ':', event_type)"
    if d.name == "spark":
        h = f"cast(java_method('java.util.Objects', 'hashCode', {body}) AS bigint)"
        base = "lower(conv(cast(abs(h) AS string), 10, 36))"
        return f"SELECT event_id, concat(CASE WHEN h < 0 THEN '-' ELSE '' END, {base}) AS idem FROM (SELECT event_id, {h} AS h FROM {d.table('events')} e) t"
    h = f"list_reduce(list_transform(string_split({body}, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda a, c: (a * 31 + c) % 4294967296, 0::BIGINT)"
    digit = "substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((abs(h) // power(36, {0})::BIGINT) % 36 AS BIGINT) + 1, 1)"
    whole = " || ".join(digit.format(k) for k in range(6, -1, -1))
    return f"SELECT event_id, (CASE WHEN h < 0 THEN '-' ELSE '' END) || coalesce(nullif(ltrim({whole}, '0'), ''), '0') AS idem FROM (SELECT event_id, CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS h FROM (SELECT event_id, {h} AS u FROM events) x) t"
