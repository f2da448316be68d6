"""Rules of telemetry, events, findings and files, as functions of DataFrames, with their own thresholds.

``over_tables`` registers them over the given tables, with oracles written apart; the tests hold them against rows worked out by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.terms import terms_in


#: Greatest complexity weight, floor of a healthy and of a depleted budget.
FLOORS = ((0.2, 0.90, 0.60), (0.5, 0.75, 0.50), (0.8, 0.60, 0.35), (999, 0.50, 0.25))
#: Least age of work in progress that is blocked, in seconds; turbulence a finished bead may have.
BLOCKED_AGE, TURBULENCE = 3600, 6
#: Of each signal, where it is skill based and where knowledge based.
SIGNALS = {
    "turbulence": ("< 1.0", "> 3.0"), "zero_rate": ("> 0.80", "< 0.50"), "latency": ("< 60", "> 300"), "escalations": ("= 0", "> 2"),
}
CONVERGING, STABLE, STUCK_ENTROPY, BUDGET_MULTIPLE = 0.50, 0.20, 1.0, 2
#: Applications until a stressor is established, retired without a catch, retired once established; change that is told.
ESTABLISHED, RETIRED, RETIRED_LATE, RATE_CHANGE = 3, 5, 10, 0.20
#: Statuses that may follow a status.
TRANSITIONS = {
    "pending": "running blocked", "running": "submitted blocked stuck", "submitted": "verified blocked stuck escalated", "verified": "proven blocked stuck escalated",
    "proven": "hardened merged blocked stuck escalated", "hardened": "reliability-proven merged blocked stuck escalated", "reliability-proven": "merged blocked stuck escalated",
    "blocked": "pending running", "stuck": "pending running", "escalated": "pending running",
}


def truncated(x: str) -> str:
    """Two decimals, the rest cut off; the guard keeps what binary fractions put just below a step."""
    return f"floor(({x}) * 100 + 1e-9) / 100"


# -- budgets ------------------------------------------------------------------------------------------------------
def complexity_weight(mix: DataFrame) -> DataFrame:
    """(task, weight) of (task, clear, complicated, complex, chaotic)."""
    total = "(clear + complicated + complex + chaotic)"
    return mix.selectExpr("task", f"CASE WHEN {total} = 0 THEN 0D ELSE {truncated(f'(0.5D * complicated + complex + 1.5D * chaotic) / {total}')} END AS weight")


def floors(weights: DataFrame) -> DataFrame:
    """(task, healthy, depleted): the floors of the first step that the weight does not pass."""
    steps = lambda k: "CASE " + " ".join(f"WHEN weight <= {f[0]}D THEN {f[k]}D" for f in FLOORS) + " ELSE 0.5D END"
    return weights.selectExpr("task", f"{steps(1)} AS healthy", f"{steps(2)} AS depleted")


def budget_state(tasks: DataFrame) -> DataFrame:
    """(task, state) of (task, rate, escapes, turbulence, completed, healthy, depleted): depletion is tested first."""
    return tasks.selectExpr("task", f"CASE WHEN rate < depleted OR escapes > 1 OR (completed > 0 AND turbulence > {TURBULENCE} * completed) THEN 'depleted' WHEN rate >= healthy AND escapes = 0 THEN 'healthy' ELSE 'warning' END AS state")


def hard_stop(tasks: DataFrame) -> DataFrame:
    return tasks.selectExpr("task", f"coalesce(NOT lint, false) OR coalesce(NOT types, false) OR critical > 0 OR stuck > 0 OR (blocked > 0 AND age > {BLOCKED_AGE}) AS stopped")


#: Statuses of beads that are completed, and of those at work; levels of a bead's turbulence.
COMPLETED, AT_WORK = ("merged", "hardened", "reliability-proven", "verified", "proven"), ("running", "submitted")
TURBULENT = ("l0", "l1", "l2", "l2_5", "l2_75")


def quality_budget(beads: DataFrame) -> DataFrame:
    """One row a task of its beads (task, bead, status, domain and ``TURBULENT``, null where a bead tells none): counts by status and domain,
    turbulence by level, the first bead of the greatest turbulence above 0, rates cut to two decimals, weight and state."""
    done, work = (f"status IN ({', '.join(repr(x) for x in names)})" for names in (COMPLETED, AT_WORK))
    turbulence = " + ".join(f"coalesce({c}, 0)" for c in TURBULENT)
    known = beads.withColumn("told", F.expr(" OR ".join(f"{c} IS NOT NULL" for c in TURBULENT))).withColumn("turb", F.expr(turbulence))
    sums = known.groupBy("task").agg(
        F.count(F.lit(1)).alias("total"), F.expr(f"count_if({done}) AS completed"), F.expr(f"count_if({work}) AS wip"), F.expr("count_if(status = 'stuck') AS stuck"), F.expr("count_if(status = 'blocked') AS blocked"),
        *[F.expr(f"count_if(domain = '{d}') AS {d}") for d in ("clear", "complicated", "complex", "chaotic")], *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TURBULENT],
        F.expr(f"count_if(told AND turb = 0 AND {done}) AS zero"), F.sum("turb").alias("turbulence"), F.max(F.when(F.col("turb") > 0, F.struct("turb", (-F.col("bead")).alias("b")))).alias("worst"),
    )
    rates = sums.withColumn("rate", F.expr(f"CASE WHEN completed > 0 THEN {truncated('zero / cast(completed AS double)')} ELSE 0D END")).withColumn("per_bead", F.expr(f"CASE WHEN completed > 0 THEN {truncated('turbulence / cast(completed AS double)')} END"))
    weighed = rates.join(complexity_weight(sums), "task")
    stated = weighed.join(floors(weighed.select("task", "weight")), "task").withColumn("escapes", F.lit(0))
    return stated.join(budget_state(stated), "task").selectExpr(
        "task", "total", "completed", "wip", "stuck", "blocked", "clear", "complicated", "complex", "chaotic", *TURBULENT, "turbulence", "-worst.b AS worst_bead", "rate", "per_bead", "weight", "state"
    )


# -- modes and convergence ----------------------------------------------------------------------------------------
def execution_mode(tasks: DataFrame) -> DataFrame:
    """(task, mode, confidence): four signals vote; four alike are sure, three fairly, and otherwise it is by rule."""
    votes = "array(" + ", ".join(f"CASE WHEN {s} {skill} THEN 'skill_based' WHEN {s} {knowledge} THEN 'knowledge_based' ELSE 'rule_based' END" for s, (skill, knowledge) in SIGNALS.items()) + ")"
    counted = tasks.withColumn("votes", F.expr(votes)).withColumn("most", F.expr("array_max(transform(votes, v -> struct(size(filter(votes, w -> w = v)) AS n, v AS mode)))"))
    return counted.selectExpr("task", "CASE WHEN most.n >= 3 THEN most.mode ELSE 'rule_based' END AS mode", "CASE most.n WHEN 4 THEN 'high' WHEN 3 THEN 'medium' ELSE 'low' END AS confidence")


def severity_trend(cycles: DataFrame) -> DataFrame:
    """(cycle, trend) of (cycle, before, now): the gravest severities compared; unknown ones count nothing."""
    worst = lambda c: f"coalesce(array_max(transform({c}, s -> coalesce(5 - nullif(array_position(array('P1', 'P2', 'P3', 'P4'), s), 0), 0))), 0)"
    return cycles.selectExpr("cycle", f"CASE WHEN coalesce(size(before), 0) = 0 OR {worst('now')} = {worst('before')} THEN 'stable' WHEN {worst('now')} > {worst('before')} THEN 'escalating' ELSE 'declining' END AS trend")


def entropy(cycles: DataFrame) -> DataFrame:
    """(cycle, entropy) of the categories of findings, in bits; 0 without any."""
    shares = "transform(array_distinct(categories), c -> size(filter(categories, d -> d = c)) / cast(size(categories) AS double))"
    return cycles.selectExpr("cycle", f"round(coalesce(-aggregate({shares}, 0D, (s, p) -> s + p * log2(p)), 0D), 3) + 0D AS entropy")


def convergence(cycles: DataFrame) -> DataFrame:
    """(cycle, rate, state, recommendation): new evidence first, then severity, then entropy."""
    rate = "CASE WHEN fresh + repeated > 0 THEN fresh / cast(fresh + repeated AS double) ELSE 0D END"
    state = f"""CASE WHEN rate >= {CONVERGING} AND trend <> 'escalating' THEN 'converging' WHEN trend = 'escalating' THEN 'diverging'
      WHEN rate < {STABLE} AND entropy < {STUCK_ENTROPY} THEN 'stuck' WHEN rate < {STABLE} AND trend = 'stable' THEN 'stable' ELSE 'stuck' END"""
    advice = f"CASE state WHEN 'converging' THEN 'continue' WHEN 'stable' THEN 'stop_early' WHEN 'diverging' THEN 'change_approach' ELSE CASE WHEN cycle < {BUDGET_MULTIPLE} * budget THEN 'extend_budget' ELSE 'change_approach' END END"
    return cycles.withColumn("rate", F.expr(rate)).withColumn("state", F.expr(state)).selectExpr("id", "round(rate, 3) AS rate", "state", f"{advice} AS recommendation")


def convergence_summary(log: DataFrame) -> DataFrame:
    """(task, n, dominant): escalations and their commonest reason, the first one of equals; reasons that are null only count."""
    reasons = log.groupBy("task", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    best = F.max(F.when(F.col("reason").isNotNull(), F.struct("n", (-F.col("at")).alias("at"), "reason")))
    return reasons.groupBy("task").agg(F.sum("n").alias("n"), best.alias("b")).selectExpr("task", "n", "b.reason AS dominant")


def convergence_yield(tasks: DataFrame) -> DataFrame:
    """(task, yield): early stops over all cycles, or over the outcomes where no cycle is known."""
    loops = "CASE WHEN cycles > 0 THEN cycles ELSE stops + extensions + changes END"
    return tasks.selectExpr("task", f"CASE WHEN {loops} > 0 THEN round(stops / cast({loops} AS double), 3) ELSE 0D END AS yield")


# -- review passes ------------------------------------------------------------------------------------------------
DIMENSIONS = ("evidence", "impact", "familiarity", "confidence")


def distance(x: str = "x", y: str = "y") -> str:
    """Of two readings: four dimensions and the bucket of the base rate, each 3 where unknown."""
    return "sqrt(cast(" + " + ".join(f"pow(coalesce({x}.{d}, 3) - coalesce({y}.{d}, 3), 2)" for d in (*DIMENSIONS, "bucket")) + " AS double))"


def noise(passes: DataFrame) -> DataFrame:
    """(noise_index, agreement, n) over the first two blind passes of each group: mean distance, null if it is exactly 0."""
    blind = passes.where("grp IS NOT NULL AND mode = 'blind_first'").withColumn("k", F.row_number().over(Window.partitionBy("grp").orderBy("id"))).where("k <= 2")
    met = blind.where("k = 1").alias("x").join(blind.where("k = 2").alias("y"), "grp").selectExpr(f"{distance()} AS d", "coalesce(x.decision = y.decision, false) AS same")
    return met.agg(F.expr("nullif(round(avg(d), 3), 0) AS noise_index"), F.expr("round(count_if(same) / count(1), 3) AS agreement"), F.count(F.lit(1)).alias("n"))


def map_convergence(passes: DataFrame) -> DataFrame:
    """(bead, convergence): 1 / (1 + mean distance of all pairs of a bead's passes); 1 for a single pass."""
    x, y = passes.alias("x"), passes.alias("y")
    pairs = x.join(y, F.expr("x.bead = y.bead AND x.id < y.id")).selectExpr("x.bead AS bead", f"{distance()} AS d").groupBy("bead").agg(F.avg("d").alias("d"))
    return passes.select("bead").distinct().join(pairs, "bead", "left").selectExpr("bead", "round(1 / (1 + coalesce(d, 0D)), 3) AS convergence")


def map_distances(passes: DataFrame) -> DataFrame:
    """(a, b, d): the distance of all pairs of a bead's passes."""
    return passes.alias("x").join(passes.alias("y"), F.expr("x.bead = y.bead AND x.id < y.id")).selectExpr("x.id AS a", "y.id AS b", f"round({distance()}, 3) AS d")


def anchoring(passes: DataFrame, shift: int = 2) -> DataFrame:
    """(n, drifted, rate): exposed passes that moved by ``shift`` or more toward the anchor on some dimension."""
    moved = " OR ".join(f"(abs(coalesce(e.{d}, 3) - coalesce(e.anchor_{d}, 3)) < abs(coalesce(b.{d}, 3) - coalesce(e.anchor_{d}, 3)) AND abs(coalesce(e.{d}, 3) - coalesce(b.{d}, 3)) >= {shift})" for d in DIMENSIONS[:3])
    met = passes.where("parent IS NOT NULL").alias("e").join(passes.alias("b"), F.expr("e.parent = b.id"), "left").selectExpr(f"b.id IS NOT NULL AND ({moved}) AS drifted")
    return met.agg(F.count(F.lit(1)).alias("n"), F.expr("count_if(drifted) AS drifted"), F.expr("round(count_if(drifted) / nullif(count(1), 0), 3) AS rate"))


def advice(counts: DataFrame) -> DataFrame:
    """(task, advice) of (task, flips, divergence, drift, unbacked)."""
    return counts.selectExpr("task", "CASE WHEN flips > 0 OR (divergence > 0 AND drift > 0) THEN 're-review recommended' WHEN divergence > 0 OR drift > 0 OR unbacked > 0 THEN 'second arbiter pass recommended' ELSE 'no action' END AS advice")


def frequency_coverage(judgments: DataFrame) -> DataFrame:
    """(coverage, unbacked): judgments with a count behind them, and grave ones without although there is a class to count in."""
    return judgments.agg(F.expr("round(count(hits) / nullif(count(1), 0), 3) AS coverage"), F.expr("count_if(severity = 'high' AND hits IS NULL AND coalesce(class_state = 'available', false)) AS unbacked"))


# -- hazards, stressors -------------------------------------------------------------------------------------------
#: Rows of a partition of ``by_key``.
ROWS = 1 << 19


def by_key(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt out by their key, over partitions in proportion to their number."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, rows.count() // ROWS + 1), key)


def hazards(records: DataFrame) -> DataFrame:
    """(task, beads, n, without, risky, escaped, open, state) of ledger records.

    Tasks are dealt out over as many partitions as the records fill, so what one of them aggregates does not grow with the table.
    """
    flags = records.selectExpr("task", "bead", "coalesce(size(defenses), 0) = 0 AS bare", "risk = 'high' AS high", "status = 'escaped' AS gone", "status = 'open' AS left")
    sums = by_key(flags, "task").groupBy("task").agg(
        F.countDistinct("bead").alias("beads"), F.count(F.lit(1)).alias("n"), F.expr("count_if(bare) AS without"), F.expr("count_if(high) AS risky"), F.expr("count_if(gone) AS escaped"), F.expr("count_if(left) AS open"),
    )
    return sums.selectExpr("*", "CASE WHEN without > 0 AND risky > 0 THEN 'depleted' WHEN without > 0 OR escaped > 0 OR open > 0 THEN 'warning' ELSE 'healthy' END AS state")


def open_hazards(records: DataFrame) -> DataFrame:
    """Records without controls, or caught only after the fact."""
    return records.where("coalesce(size(controls), 0) = 0 OR layer = 'escaped'").select("id")


def harvest(applied: DataFrame, library: DataFrame) -> DataFrame:
    """(name, id): caught stressors that the library lacks, by id and by name whatever the case; numbered on from its greatest.

    The first of equal names counts.  Numbers come from counts within ranges of the order, so no task holds all rows.
    """
    known = library.select(F.lower("name").alias("key")).distinct()
    caught = applied.where("result = 'caught'").join(library.select(F.col("id").alias("stressor")), "stressor", "left_anti").withColumn("key", F.lower(F.trim("target")))
    fresh = caught.join(known, "key", "left_anti").groupBy("key").agg(F.min(F.struct("at", "target")).alias("f")).select("f.at", "f.target").withColumn("cell", F.expr("at div 1000"))
    cells = fresh.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    # one row a thousand new names: the only rows that a single task orders
    before = cells.select("cell", F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    greatest = library.agg(F.coalesce(F.max(F.expr("cast(nullif(regexp_extract(id, '^STR-([0-9]+)', 1), '') AS int)")), F.lit(0)).alias("top")).scalar()
    within = F.row_number().over(Window.partitionBy("cell").orderBy("at"))
    return fresh.join(before, "cell").select(F.col("target").alias("name"), F.format_string("STR-%03d", greatest + F.col("before") + within).alias("id"))


def lifecycle(applied: DataFrame) -> DataFrame:
    """(stressor, n, caught, rate, status, changes) by windows over each stressor's applications in order.

    A stressor is established at its third application or later, once it has a catch, unless five went by without one:
    then it is retired.  Later retirement needs a rate that rounds to nothing.  ``changes``: steps of the rate above 0.2.
    """
    order = Window.partitionBy("stressor").orderBy("at")
    rows = applied.where("result <> 'not_applicable'").withColumn("n", F.row_number().over(order)).withColumn("c", F.sum(F.expr("int(result = 'caught')")).over(order))
    rows = rows.withColumn("rate", F.expr("round(c / cast(n AS double), 4)")).withColumn("step", F.abs(F.col("rate") - F.lag("rate").over(order)))
    out = rows.groupBy("stressor").agg(
        F.max("n").alias("n"), F.max("c").cast("int").alias("caught"), F.max_by("rate", "n").alias("rate"), F.expr(f"count_if(round(step, 9) > {RATE_CHANGE})").alias("changes"),
        F.expr(f"min(CASE WHEN n >= {ESTABLISHED} AND rate > 0 THEN n END)").alias("up"), F.expr(f"min(CASE WHEN n >= {RETIRED} AND rate = 0 THEN n END)").alias("out"), F.expr(f"max(CASE WHEN n >= {RETIRED_LATE} AND rate = 0 AND c > 0 THEN n END)").alias("late"),
    )
    status = "CASE WHEN up IS NOT NULL AND (out IS NULL OR up < out) THEN CASE WHEN late IS NOT NULL THEN 'retired' ELSE 'established' END WHEN out IS NOT NULL THEN 'retired' ELSE 'provisional' END"
    return out.selectExpr("stressor", "n", "caught", "rate", f"{status} AS status", "changes")


def applicable(beads: DataFrame, library: DataFrame) -> DataFrame:
    """(bead, stressor): stressors for a bead's domain and tags; an empty list asks for nothing, retired ones never apply.

    The library is a table of rules: it rides along as one value.
    """
    rules = library.where("status <> 'retired'").agg(F.collect_list(F.struct("stressor", "domains", "tags")).alias("r")).scalar()
    fits = "filter(rules, r -> (size(r.domains) = 0 OR array_contains(r.domains, domain)) AND (size(r.tags) = 0 OR arrays_overlap(r.tags, tags)))"
    return beads.withColumn("rules", rules).select("bead", F.explode(F.expr(fits)).alias("r")).select("bead", "r.stressor")


def simplicity(beads: DataFrame) -> DataFrame:
    """(bead, coefficient, verdict): the problem's size over the solution's."""
    problem = "2 * files + CASE domain WHEN 'ESSENTIAL' THEN 3 ELSE 1 END + CASE cynefin WHEN 'clear' THEN 1 WHEN 'complicated' THEN 2 ELSE 3 END + criteria"
    out = beads.selectExpr("bead", f"cast({problem} AS double) / nullif(lines + 3 * abstractions + 2 * dependencies + 2 * nesting + branches, 0) AS c")
    return out.selectExpr("bead", "round(c, 4) AS coefficient", "CASE WHEN c IS NULL OR c >= 0.5 THEN 'PASS' WHEN c >= 0.3 THEN 'WARNING' ELSE 'BLOCKING' END AS verdict")


def rolling_budget(tasks: DataFrame) -> DataFrame:
    """(task, rate, escapes, high, state) over the last ten tasks that are no older than thirty days; escapes of the last three.

    A frame of ten rows is a bounded list; what is too old in it is left out.
    """
    order = Window.partitionBy("system").orderBy("day", "task")
    held = F.collect_list(F.struct("day", "quiet", "escapes", "high")).over(order.rowsBetween(-9, 0))
    rows = tasks.withColumn("held", held).withColumn("held", F.expr("filter(held, h -> h.day > day - 30)"))
    out = rows.selectExpr("task", "aggregate(held, 0D, (s, h) -> s + int(h.quiet)) / size(held) AS rate", "aggregate(slice(held, greatest(1, size(held) - 2), 3), 0, (s, h) -> s + h.escapes) AS escapes", "size(filter(held, h -> h.high)) AS high")
    return out.selectExpr("task", "round(rate, 4) AS rate", "escapes", "high", "CASE WHEN rate < 0.5 OR escapes > 1 OR high >= 2 THEN 'depleted' WHEN rate >= 0.7 AND escapes = 0 THEN 'healthy' ELSE 'warning' END AS state")


# -- events and findings ------------------------------------------------------------------------------------------
def rising_escalation(findings: DataFrame, share: float = 0.5) -> DataFrame:
    """(workstream, escalated, n) where more than ``share`` of what is neither archived nor suppressed is escalated."""
    sums = findings.where("state NOT IN ('archived', 'suppressed')").groupBy("workstream").agg(F.expr("count_if(state = 'escalated') AS escalated"), F.count(F.lit(1)).alias("n"))
    return sums.where(f"escalated > {share} * n")


def queue_starvation(events: DataFrame, ledger: DataFrame, now: int, minutes: int = 30) -> DataFrame:
    """(workstream, idle): minutes without an event, of workstreams whose ledger has no bead at work."""
    last = events.groupBy("workstream").agg(F.max("minute").alias("last")).selectExpr("workstream", f"{now} - last AS idle").where(f"idle >= {minutes}")
    busy = ledger.where("exists(map_values(beads), s -> s NOT IN ('completed', 'failed', 'cancelled'))").select("workstream")
    return last.join(busy, "workstream", "left_anti")


def low_confidence_flood(findings: DataFrame, count: int = 10, confidence: float = 0.5) -> DataFrame:
    return findings.where(f"state = 'open' AND confidence < {confidence}").groupBy("workstream").agg(F.count(F.lit(1)).alias("n")).where(f"n > {count}")


def boundary(findings: DataFrame) -> DataFrame:
    """(id, kind) of (id, scope, mission): whether a finding lies within, beside or outside what it was looked for in."""
    inside = "startswith(scope, CASE WHEN endswith(mission, '/') THEN mission ELSE concat(mission, '/') END) OR scope = mission"
    root = lambda c: f"get(filter(split({c}, '/'), p -> p <> ''), 0)"
    return findings.selectExpr("id", f"CASE WHEN coalesce(scope, '') = '' THEN 'novel' WHEN {inside} THEN 'in_scope' WHEN {root('scope')} = {root('mission')} THEN 'adjacent' ELSE 'boundary_crossing' END AS kind")


def promotion(findings: DataFrame, patterns: DataFrame, workstreams: int, confidence: float = 0.7) -> DataFrame:
    """(id, promoted, why): open, in scope, sure, anchored, within the mission, and known by two words of a pattern.

    Until there are more than ten workstreams no pattern is asked for.  The words of all patterns are looked for in one pass over the
    evidence, and meet their patterns by word.
    """
    words = patterns.where("confidence >= 0.5").select("pattern", F.explode(F.array_distinct(F.split(F.lower("description"), "\\s+"))).alias("term")).where("length(term) > 3")
    met = terms_in(findings.select("id", F.lower("evidence").alias("text")), words).join(words, "term").groupBy("id", "pattern").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    known = findings.join(met.select("id", F.lit(True).alias("known")).distinct(), "id", "left")
    why = f"""CASE WHEN state <> 'open' THEN 'state' WHEN kind <> 'in_scope' THEN 'kind' WHEN confidence < {confidence} THEN 'confidence' WHEN coalesce(size(refs), 0) = 0 THEN 'anchor'
      WHEN coalesce(scope, '') <> '' AND NOT startswith(scope, mission) THEN 'scope' WHEN NOT coalesce(known, false) AND {workstreams} > 10 THEN 'pattern' END"""
    return known.withColumn("why", F.expr(why)).selectExpr("id", "why IS NULL AS promoted", "why")


# -- files --------------------------------------------------------------------------------------------------------
def _ends(*names: str) -> str:
    return "(" + " OR ".join(f"endswith(base, '{n}')" for n in names) + ")"


_BEAD, _ADVERSARIAL = "path rlike 'docs/sdlc/active/.*/beads/.*[.]md$'", "(path rlike 'docs/sdlc/active/.*/adversarial/' OR endswith(base, '-aqs.md'))"
#: Checks in their order, each with what a file is like that gets it.
ROUTES = (
    ("aqs-artifact", _ADVERSARIAL), ("bead-status", f"{_BEAD} AND NOT {_ADVERSARIAL}"), ("domain-vocabulary", "contains(path, 'docs/sdlc/active/')"),
    ("consistency", "base = 'feature-matrix.md' OR contains(base, 'convention-report') OR contains(content, '## Convention Enforcement Report')"), ("hardening-report", "base = 'hardening-report.md'"),
    ("decision-trace", f"{_BEAD} AND NOT endswith(base, '-decision-trace.md') AND NOT {_ADVERSARIAL} AND base <> 'hardening-report.md'"),
    ("safety-constraints", "ext NOT IN ('md', 'json', 'yaml', 'yml', 'txt', 'toml', 'ini', 'cfg', 'conf', 'lock', 'sum')"), ("ast-checks", "ext IN ('ts', 'tsx', 'js', 'jsx')"), ("eslint-disable", "ext IN ('ts', 'tsx', 'js', 'jsx')"),
    ("quality-budget", _ends("quality-budget.yaml")), ("hazard-ledger", _ends("hazard-defense-ledger.yaml")), ("stress-session", _ends("stress-session.yaml")),
    ("decision-noise", _ends("decision-noise-summary.yaml")), ("mode-convergence", _ends("mode-convergence-summary.yaml")), ("phase-transition", "base = 'state.md'"),
)
VENDOR = "path rlike '/(node_modules|dist|build|[.]git|__pycache__|[.]next|vendor|[.]cache|[.]turbo)/'"


def routed(files: DataFrame) -> DataFrame:
    """(path, place, check): the checks of each file in order; none for vendor files and files without a path.  One scan."""
    known = files.where(f"coalesce(path, '') <> '' AND NOT ({VENDOR})").withColumn("base", F.expr("element_at(split(path, '/'), -1)")).withColumn("ext", F.expr("element_at(split(base, '[.]'), -1)"))
    checks = "array(" + ", ".join(f"CASE WHEN coalesce({when}, false) THEN named_struct('place', {k}, 'check', '{name}') END" for k, (name, when) in enumerate(ROUTES, 1)) + ")"
    return known.select("path", F.explode(F.filter(F.expr(checks), lambda c: c.isNotNull())).alias("c")).select("path", "c.place", "c.check")


def transitions(beads: DataFrame) -> DataFrame:
    """(bead, move): whether each bead's status may follow its earlier one; evolving beads may go from verified to merged."""
    table = "map(" + ", ".join(f"'{k}', array({', '.join(repr(w) for w in v.split())})" for k, v in TRANSITIONS.items()) + ")"
    legal = f"before IS NULL OR before = '' OR before = status OR coalesce(array_contains({table}[before], status), false) OR (before = 'verified' AND status = 'merged' AND type <=> 'evolve')"
    return beads.selectExpr("bead", f"CASE WHEN {legal} THEN 'legal' ELSE 'illegal' END AS move")


def swallowed(files: DataFrame) -> DataFrame:
    """(path, rule): handlers that are empty, hold a comment only, or pass."""
    rules = (("empty", "catch\\\\s*([(][^)]*[)])?\\\\s*[{]\\\\s*[}]"), ("comment", "catch\\\\s*([(][^)]*[)])?\\\\s*[{]\\\\s*(//[^\\\\n]*|/[*].*[*]/)\\\\s*[}]"), ("pass", "(?m)^\\\\s*except(\\\\s+\\\\w+)?:\\\\s*\\\\n\\\\s*pass\\\\s*$"))
    found = "array(" + ", ".join(f"CASE WHEN content rlike '{p}' THEN '{name}' END" for name, p in rules) + ")"
    return files.select("path", F.explode(F.filter(F.expr(found), lambda r: r.isNotNull())).alias("rule"))


def justified(files: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(path, line, score) of suppressing comments: 2 with a reason and a ticket or an end, 1 with a reason, 0 with neither.

    Those of 0 whose fingerprint (path, trimmed line, hash of the lines around it) is allowed go.
    """
    lines = files.select("path", F.split("content", "\n").alias("all")).select("path", "all", F.posexplode("all").alias("k", "text")).where("text LIKE '%eslint-disable%' AND text NOT LIKE '%eslint-enable%'")
    around = "sha2(array_join(slice(all, greatest(k, 1), CASE WHEN k = 0 THEN 2 ELSE 3 END), '\\n'), 256)"
    score = "CASE WHEN text rlike 'eslint-disable.*--\\\\s*.{10,};\\\\s*(tracked in |expires )' THEN 2 WHEN text rlike 'eslint-disable.*--\\\\s*.{10,}' THEN 1 ELSE 0 END"
    out = lines.selectExpr("path", "k + 1 AS line", f"{score} AS score", f"sha2(concat(path, trim(text), {around}), 256) AS print")
    if allowed is not None:
        out = out.join(allowed.select("print", F.lit(0).alias("score")), ["print", "score"], "left_anti")
    return out.select("path", "line", "score")


