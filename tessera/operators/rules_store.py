"""Rules of the store and its ledgers, of drift over windows of tasks, and definitions in six languages.

As in ``rules``: functions of DataFrames, registered over the given tables in ``over_tables``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranks import placed

#: What a finished level moves a bead from and to; statuses in their order.
LEVELS = {"L0": ("running", "submitted"), "L1": ("submitted", "verified"), "L2": ("verified", "proven"), "L2.5": ("proven", "hardened"), "L2.75": ("hardened", "reliability-proven")}
ORDER = ("running", "submitted", "verified", "proven", "hardened", "reliability-proven")
#: Columns of the ledger that an update may name.
LEDGER = ("branch", "mission_id", "scope_region", "active_beads", "latest_commit")
PRUNE_HOURS = 24


def swap(updates: DataFrame) -> DataFrame:
    """(bead, action, status): an expected status is compared first, unknown ones are errors, what is already there is
    skipped, and otherwise a bead moves only from where its level begins."""
    table = lambda k: "map(" + ", ".join(f"'{level}', '{pair[k]}'" for level, pair in LEVELS.items()) + ")[level]"
    place = lambda c: f"array_position(array({', '.join(repr(s) for s in ORDER)}), {c})"
    moves = updates.withColumn("from", F.expr(table(0))).withColumn("to", F.expr(table(1)))
    action = f"""CASE WHEN to IS NULL THEN 'unknown level' WHEN expected IS NOT NULL AND NOT status <=> expected THEN 'mismatch' WHEN coalesce({place('status')}, 0) = 0 THEN 'unknown status'
      WHEN {place('status')} >= {place('to')} THEN 'skipped' WHEN expected IS NULL AND status <> `from` THEN 'mismatch' ELSE 'advanced' END"""
    return moves.withColumn("action", F.expr(action)).selectExpr("bead", "action", "CASE WHEN action = 'advanced' THEN to ELSE status END AS status")


def prunable(tasks: DataFrame, clones: DataFrame) -> DataFrame:
    """Clones that no task at work refers to, and that are synced for some task or older than a day."""
    sums = tasks.where("clone IS NOT NULL").groupBy("clone").agg(F.expr("count_if(level IS NOT NULL) AS own"), F.expr("count_if(status NOT IN ('completed', 'cancelled')) AS active"), F.expr("count_if(synced) AS synced"))
    return clones.join(sums, "clone").where(f"own > 0 AND active = 0 AND (synced > 0 OR hours > {PRUNE_HOURS})").select("clone")


def appended(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """The ledger after an append: final rows whose task it does not hold; of a task's rows the first."""
    first = rows.where("status = 'final' AND task IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy("task").orderBy("at"))).where("k = 1")
    fresh = first.join(ledger.select("task"), "task", "left_anti")
    return ledger.unionByName(fresh.select(*ledger.columns))


def merged_ledger(ledger: DataFrame, updates: DataFrame) -> DataFrame:
    """The ledger after partial updates (workstream, column, value, at): allowed columns only, the last value of each; a
    touched row is dated by its last update."""
    last = updates.where(F.col("column").isin(*LEDGER)).groupBy("workstream", "column").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))
    wide = last.groupBy("workstream").agg(*[F.max(F.when(F.col("column") == c, F.struct("value"))).alias(c) for c in LEDGER], F.max("at").alias("at"))
    new = wide.select("workstream", *[F.col(c).alias(f"new_{c}") for c in LEDGER], "at")
    joined = ledger.join(new, "workstream", "left")
    return joined.select("workstream", *[F.when(F.col(f"new_{c}").isNotNull(), F.col(f"new_{c}.value")).otherwise(F.col(c)).alias(c) for c in LEDGER], F.coalesce("at", "updated").alias("updated"))


def packet(ledger: DataFrame, journal: DataFrame, findings: DataFrame) -> DataFrame:
    """(workstream, branch, entries, open): a ledger row with its last three journal entries, newest first, and its open findings by salience.

    Entries are cut to three before they are gathered; open findings are capped at a hundred where they are made.
    """
    latest = journal.withColumn("k", F.row_number().over(Window.partitionBy("workstream").orderBy(F.desc("at"), "entry"))).where("k <= 3").groupBy("workstream").agg(F.sort_array(F.collect_list(F.struct("k", "entry"))).alias("e"))
    ranked = findings.where("state = 'open'").withColumn("k", F.row_number().over(Window.partitionBy("workstream").orderBy(F.desc("salience"), "finding"))).where("k <= 100").groupBy("workstream").agg(F.sort_array(F.collect_list(F.struct("k", "finding"))).alias("f"))
    return ledger.join(latest, "workstream", "left").join(ranked, "workstream", "left").selectExpr("workstream", "branch", "array_join(coalesce(e.entry, array()), ' ') AS entries", "array_join(coalesce(f.finding, array()), ' ') AS open")


# -- drift --------------------------------------------------------------------------------------------------------
#: Indicators of a task and the direction that is a sign of drift.
INDICATORS = {"clear_rate": 1, "fast_rate": 1, "depth": -1, "skip_rate": 1, "healthy_for": 1}


def deviance(tasks: DataFrame) -> DataFrame:
    """(task, signs, alert): of five indicators, how many moved the wrong way between the ten tasks before the last ten and those."""
    order = Window.partitionBy("system").orderBy("task")
    now, then = order.rowsBetween(-9, 0), order.rowsBetween(-19, -10)
    whole = F.count(F.lit(1)).over(then) == 10
    signs = sum(F.when(whole & ((F.avg(c).over(now) - F.avg(c).over(then)) * way > 1e-12), 1).otherwise(0) for c, way in INDICATORS.items())
    return tasks.withColumn("signs", signs).selectExpr("task", "signs", "CASE WHEN signs >= 3 THEN 'RED' WHEN signs = 2 THEN 'YELLOW' ELSE 'NONE' END AS alert")


def protection(tasks: DataFrame) -> DataFrame:
    """(task, ratio, status): protecting beads over all beads of the last ten tasks; an alert is a third task in a row below 0.2."""
    order = Window.partitionBy("system").orderBy("task")
    last = order.rowsBetween(-9, 0)
    rows = tasks.withColumn("ratio", F.sum("protecting").over(last) / F.sum("beads").over(last)).withColumn("low", F.expr("int(ratio < 0.2)"))
    rows = rows.withColumn("run", F.sum("low").over(order.rowsBetween(-2, 0)))
    return rows.selectExpr("task", "round(ratio, 4) AS ratio", "CASE WHEN run = 3 THEN 'ALERT' WHEN low = 1 THEN 'WARNING' ELSE 'HEALTHY' END AS status")


# -- definitions --------------------------------------------------------------------------------------------------
#: How a line opens a definition, by language; the name is the last group that matched.
DEFINITIONS = {
    "typescript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+(\w+)|^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>|^\s+(?:(?:public|private|protected|static|async)\s+)+(\w+)\s*\(",
    "python": r"^\s*(?:async\s+)?def\s+(\w+)\s*\(", "go": r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*[\[(]", "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)",
    "java": r"^\s*(?:(?:public|private|protected|static|final|synchronized)\s+)+[\w<>\[\], ]+\s+(\w+)\s*\(", "ruby": r"^\s*def\s+(?:self\.)?(\w+[?!]?)",
}
#: What a definition's reach is, by language, from its indentation, the words before its name, and the name; the first that holds.
REACH = {
    "typescript": "CASE WHEN array_contains(before, 'default') AND get(before, 0) = 'export' THEN 'default' WHEN get(before, 0) = 'export' THEN 'named' WHEN get(before, 0) IN ('public', 'private', 'protected') THEN 'method' ELSE 'internal' END",
    "python": "CASE WHEN indent >= 4 THEN 'method' WHEN indent = 0 AND startswith(name, '_') AND NOT startswith(name, '__') AND length(name) > 1 THEN 'internal' ELSE 'module_level' END",
    "go": "CASE WHEN startswith(ltrim(substr(text, 5)), '(') THEN 'method' WHEN left(name, 1) = upper(left(name, 1)) AND left(name, 1) <> lower(left(name, 1)) THEN 'named' ELSE 'internal' END",
    "rust": "CASE WHEN indent > 0 THEN 'method' WHEN get(before, 0) = 'pub' THEN 'named' ELSE 'internal' END",
    "java": "CASE WHEN array_contains(before, 'public') THEN 'named' WHEN arrays_overlap(before, array('private', 'protected')) THEN 'internal' ELSE 'method' END",
    "ruby": "'internal'",
}
_NO_NAMES = "('if', 'for', 'while', 'switch', 'catch', 'return', 'new', 'else')"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def definitions(files: DataFrame, around: int = 1) -> DataFrame:
    """(path, name, line, end_line, body_lines, export_type, context) of files (path, language, content): a definition ends
    where the next line that opens one begins, whether or not that one has a usable name."""
    found = "CASE language " + " ".join(f"WHEN '{k}' THEN regexp_extract_all(text, {_q(p)}, 0)" for k, p in DEFINITIONS.items()) + " END"
    groups = {k: p.count("(") - p.count("(?:") - p.count(r"\(") for k, p in DEFINITIONS.items()}
    names = "CASE language " + " ".join(f"WHEN '{k}' THEN coalesce({', '.join(f'nullif(regexp_extract(text, {_q(p)}, {g}), {chr(39) * 2})' for g in range(1, groups[k] + 1))})" for k, p in DEFINITIONS.items()) + " END"
    kinds = "CASE language " + " ".join(f"WHEN '{k}' THEN {rule}" for k, rule in REACH.items()) + " END"
    lines = files.select("path", "language", F.split("content", "\n").alias("all")).select("path", "language", "all", F.size("all").alias("total"), F.posexplode("all").alias("k", "text"))
    opened = lines.where(F.size(F.expr(found)) > 0).withColumn("end_line", F.lead("k", 1).over(Window.partitionBy("path").orderBy("k")))
    out = opened.withColumn("name", F.expr(names)).where(f"name IS NOT NULL AND name NOT IN {_NO_NAMES}").withColumn("end_line", F.coalesce("end_line", "total"))
    out = out.withColumn("indent", F.expr("length(text) - length(ltrim(replace(text, '\\t', ' ')))")).withColumn("before", F.expr("filter(split(substring_index(text, name, 1), '[^A-Za-z]+'), w -> w <> '')"))
    return out.selectExpr("path", "name", "k + 1 AS line", "end_line", "greatest(1, end_line - k) AS body_lines", f"{kinds} AS export_type", f"array_join(slice(all, greatest(1, k + 1 - {around}), k + 1 + {around} - greatest(1, k + 1 - {around}) + 1), '\\n') AS context")


# -- gates, reviews, reports --------------------------------------------------------------------------------------
#: Rank of an artifact's status; findings that a passing review may not leave open.
RANKS = {"partial": 1, "ready": 2, "active": 2, "final": 3}
GRAVE = ("CRITICAL", "MATERIAL")


def gates(artifacts: DataFrame) -> DataFrame:
    """(gate, passed): an artifact's status must be known and of the least rank, a field filled, nothing open, and its task in the ledger, as far as the gate asks."""
    rank = lambda c: "coalesce(map(" + ", ".join(f"'{k}', {v}" for k, v in RANKS.items()) + f")[{c}], 0)"
    return artifacts.selectExpr("gate", f"coalesce({rank('status')} > 0 AND {rank('status')} >= {rank('least')}, false) AND coalesce(field <> '', false) AND open = 0 AND (NOT asks_ledger OR in_ledger) AS passed")


def review_problems(reviews: DataFrame, claims: DataFrame, files: DataFrame, findings: DataFrame) -> DataFrame:
    """(review, problem): claims on files that are not there, beyond their end or with another hash, unknown verdicts, and passes with a grave finding unresolved."""
    sized = files.selectExpr("path", "sha2(content, 256) AS hash", "size(split(rtrim('\\n', content), '\\n', -1)) AS n")
    cited = claims.join(sized, "path", "left").selectExpr("review", "CASE WHEN line < 1 THEN 'line' WHEN hash IS NULL THEN 'untracked' WHEN line > n THEN 'outside' WHEN claimed <> hash THEN 'hash' END AS problem").where("problem IS NOT NULL")
    verdicts = reviews.where("verdict NOT IN ('PASS', 'FAIL', 'INCONCLUSIVE')").selectExpr("review", "'verdict' AS problem")
    grave = findings.where(F.col("severity").isin(*GRAVE) & (F.col("disposition") == "UNRESOLVED"))
    passed = reviews.where("verdict = 'PASS'").join(grave.select("review"), "review", "left_semi").selectExpr("review", "'unresolved' AS problem")
    return cited.unionByName(verdicts).unionByName(passed).distinct()


def noise_band(runs: DataFrame) -> DataFrame:
    """(bead, overlap, noise): shared findings of a first run and a second one, of all that either has."""
    share = "100D * size(array_intersect(one, two)) / nullif(size(array_union(one, two)), 0)"
    return runs.selectExpr("bead", f"round(coalesce({share}, 100D), 2) AS overlap").selectExpr("bead", "overlap", "CASE WHEN overlap > 80 THEN 'LOW' WHEN overlap >= 50 THEN 'MODERATE' ELSE 'HIGH' END AS noise")


def report(merged: DataFrame) -> DataFrame:
    """(place, line): a Markdown report of fused pairs: counts, clone types by number, then the pairs of each confidence.

    Lines are numbered by section and rank, so they are made where their pairs are; only writing them in one file puts
    them in one task.
    """
    head = [(0, 0, "# Duplicate functions"), (1, 0, "| Metric | Value |"), (3, 0, "| Clone type | Count |"), *[(10 * k, 0, f"## {c}") for k, c in enumerate(("HIGH", "MEDIUM", "LOW"), 1)]]
    fixed = merged.sparkSession.createDataFrame(head, "section int, rank int, line string")
    total = merged.agg(F.count(F.lit(1)).alias("n"), F.expr("count_if(n >= 2) AS m"), F.expr("count_if(n >= 3) AS d"))
    sums = total.select(F.posexplode(F.expr("array(concat('| Pairs | ', n, ' |'), concat('| Several signals | ', m, ' |'), concat('| Three signals or more | ', d, ' |'))")).alias("rank", "line")).selectExpr("2 AS section", "rank", "line")
    kinds = merged.groupBy("clone_type").agg(F.count(F.lit(1)).alias("c")).selectExpr("4 AS section", "cast(row_number() OVER (ORDER BY c DESC, clone_type) AS int) AS rank", "concat('| ', clone_type, ' | ', c, ' |') AS line")
    ranked = placed(merged.select("a", "b", "composite", "n", "confidence", "action"), ["confidence"], [F.col("composite").desc(), F.col("n").desc(), F.col("a"), F.col("b")])
    pairs = ranked.selectExpr("10 * array_position(array('HIGH', 'MEDIUM', 'LOW'), confidence) + 1 AS section", "cast(before + 1 AS int) AS rank", "concat('- ', a, ' and ', b, ': ', composite, ' by ', n, ', ', lower(action)) AS line")
    return fixed.unionByName(sums).unionByName(kinds).unionByName(pairs.selectExpr("cast(section AS int) AS section", "rank", "line"))


