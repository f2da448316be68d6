"""Control charts, rolling budgets, trends and drift as window plans over daily series."""

from __future__ import annotations

from tessera.plans.dialect import REGISTRY, SparkDialect

plan = REGISTRY.plan


def daily(d: SparkDialect) -> str:
    """CTE day(kind, t, v): events per kind and day."""
    return f"day AS (SELECT event_type AS kind, {d.day('ts')} AS t, cast(count(*) AS double) AS v FROM {d.table('events')} e GROUP BY event_type, {d.day('ts')})"


@plan("win_07_control_limits")
def limits(d):
    """Mean and population sigma of each series, with one, two and three sigma limits."""
    return f"WITH {daily(d)} SELECT kind, t, v, round(avg(v) OVER w, 4) AS mean, round(stddev_pop(v) OVER w, 4) AS sigma, round(avg(v) OVER w + 3 * stddev_pop(v) OVER w, 4) AS ucl, round(avg(v) OVER w - 3 * stddev_pop(v) OVER w, 4) AS lcl FROM day WINDOW w AS (PARTITION BY kind)"


@plan("win_08_western_electric")
def western_electric(d):
    """1 beyond 3 sigma; 2 of 3 beyond 2; 4 of 5 beyond 1; 8 on one side."""
    part = lambda n, s: f"sum(CASE WHEN z {s} THEN 1 ELSE 0 END) OVER (PARTITION BY kind ORDER BY t ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
    return f"""WITH {daily(d)}, z AS (SELECT kind, t, (v - avg(v) OVER (PARTITION BY kind)) / nullif(stddev_pop(v) OVER (PARTITION BY kind), 0) AS z FROM day)
SELECT kind, t, abs(z) > 3 AS rule_1, {part(2, '> 2')} >= 2 OR {part(2, '< -2')} >= 2 AS rule_2, {part(4, '> 1')} >= 4 OR {part(4, '< -1')} >= 4 AS rule_3, {part(7, '> 0')} >= 8 OR {part(7, '< 0')} >= 8 AS rule_4 FROM z"""


@plan("win_09_moving_range")
def moving_range(d):
    """Sigma from the mean moving range over 1.128; fewer than three points are insufficient."""
    return f"WITH {daily(d)}, r AS (SELECT kind, v, abs(v - lag(v) OVER (PARTITION BY kind ORDER BY t)) AS mr FROM day) SELECT kind, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(avg(mr) / 1.128, 4) END AS sigma FROM r GROUP BY kind"


@plan("win_12_trend_bands")
def trend(d):
    return f"WITH {daily(d)}, r AS (SELECT kind, t, v / nullif(lag(v) OVER (PARTITION BY kind ORDER BY t), 0) - 1 AS delta FROM day) SELECT kind, t, CASE WHEN delta IS NULL THEN 'none' WHEN delta <= -0.2 THEN 'alarm' WHEN delta < -0.1 THEN 'declining' WHEN delta > 0.1 THEN 'improving' ELSE 'stable' END AS trend FROM r"


@plan("win_15_lindy_rates")
def lindy(d):
    """Running catch rate of each stressor and its jumps of more than 0.2."""
    return f"""WITH a AS (SELECT l_suppkey AS sid, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_returnflag, l_shipdate, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS caught FROM {d.table('lineitem')} l),
r AS (SELECT sid, caught, cast(row_number() OVER w AS bigint) AS n, sum(caught) OVER w AS c FROM a WINDOW w AS (PARTITION BY sid ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_returnflag, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT sid, n, round(c / cast(n AS double), 4) AS rate, CASE WHEN n >= 20 AND c * 1.0 / n < 0.1 THEN 'retired' WHEN n >= 10 THEN 'established' ELSE 'probation' END AS status FROM r"""


@plan("win_streaming_twin")
def sliding(d):
    """Batch twin of the sliding-window stream: failures per hour window, three or more."""
    return f"""WITH e AS (SELECT user_id % 10 AS ws, cast(floor({d.micros('ts')} / 3600000000.0) AS bigint) AS hour FROM {d.table('events')} x WHERE event_type = 'error') SELECT ws, hour, count(*) AS n FROM e GROUP BY ws, hour HAVING count(*) >= 3"""
