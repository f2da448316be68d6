"""Rules over code, files, receipts and the event store's tables, with their own word lists and limits.

As in ``rules``: functions of DataFrames, registered over the given tables in ``over_tables``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.terms import terms_in
from tessera.operators.strategy_values import KEYWORDS, STATEMENTS

#: Operators and punctuation of code.
OPERATORS = "=== !== == != <= >= => && || << >> ?? ?. ++ -- - + * / % & | ^ ~ < > ! = ? :".split()
PUNCTUATION = "( ) { } [ ] ; , .".split()


def _lexer() -> str:
    """One pattern with a group for each kind of token (string, number, identifier, operator, punctuation); blanks and comments
    match without a group.  Longer operators come first, and a number is not the head of a word."""
    escaped = lambda marks: "|".join("".join("[" + c + "]" if c not in "^[]" else "\\" + c for c in m) for m in sorted(marks, key=lambda m: (-len(m), m)))
    digits = "[0-9]+"
    kinds = (
        "|".join(f"{q}(?:[^{q}\\\\]|\\\\.)*{q}" for q in "\"'`"),
        f"(?<![A-Za-z0-9_$])(?:0[xbo][0-9A-Fa-f]+|{digits}(?:[.]{digits})?(?:[Ee][-+]?{digits})?)(?![A-Za-z0-9_$])",
        "(?<![A-Za-z0-9_])[A-Za-z_$][A-Za-z0-9_$]*", escaped(OPERATORS), escaped(PUNCTUATION),
    )
    ignored = ("[ \\t\\r\\n\\f]+", "(?://|#)[^\\n]*", "/[*].*?(?:[*]/|\\z)")
    return "|".join((*ignored, *(f"({k})" for k in kinds)))


TOKEN = _lexer()


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def code_tokens(sources: DataFrame) -> DataFrame:
    """(id, tokens): structs (type, value) of code, without blanks and comments."""
    kinds = ("string", "number", "identifier", "operator", "punctuation")
    p = _quoted("(?s)" + TOKEN)
    at = lambda k: f"regexp_extract(t, {p}, {k})"
    words = ", ".join(f"'{w}'" for w in KEYWORDS)
    kind = "CASE " + " ".join(f"WHEN {at(k)} <> '' THEN " + (f"CASE WHEN t IN ({words}) THEN 'keyword' ELSE 'identifier' END" if name == "identifier" else f"'{name}'") for k, name in enumerate(kinds, 1)) + " END"
    every = f"transform(regexp_extract_all(code, {p}, 0), t -> named_struct('type', {kind}, 'value', t))"
    return sources.selectExpr("id", f"filter({every}, t -> t.type IS NOT NULL) AS tokens")


def normalised(tokens: DataFrame) -> DataFrame:
    """(id, names): tokens with identifiers, strings and numbers renamed."""
    return tokens.selectExpr("id", "transform(tokens, t -> CASE t.type WHEN 'identifier' THEN '_ID' WHEN 'string' THEN '_STR' WHEN 'number' THEN '_NUM' ELSE t.value END) AS names")


def blocks(sequences: DataFrame, opens: str | None = None) -> DataFrame:
    """(id, place, block): statement blocks; what stands before the first boundary is one of its own.

    ``opens`` says whether the token at i begins a block; the fixed words of statements do, unless it is given.
    """
    opens = opens or f"array_contains(array({', '.join(repr(w) for w in STATEMENTS)}), token_sequence[i])"
    starts = f"filter(transform(token_sequence, (t, i) -> i), i -> i = 0 OR {opens})"
    cut = "transform(at, (s, k) -> array_join(slice(token_sequence, s + 1, coalesce(get(at, k + 1), size(token_sequence)) - s), ' '))"
    return sequences.withColumn("at", F.expr(starts)).select("id", F.posexplode(F.expr(cut)).alias("place", "block"))


def longest_directory(files: DataFrame, table: DataFrame) -> DataFrame:
    """(path, convention) of the longest directory that the path contains; of equally long ones the first by name.

    One automaton of all directories runs over each path, whatever their number; what it finds meets the table by name.
    """
    paths = files.select("path").distinct()
    met = terms_in(paths, table, id="path", text="path", term="dir").withColumnsRenamed({"id": "path", "term": "dir"}).join(table, "dir")
    return met.groupBy("path").agg(F.min(F.struct((-F.length("dir")).alias("n"), "dir", "convention")).alias("best")).join(files.select("path"), "path").selectExpr("path", "best.convention AS convention")


# -- source smells ------------------------------------------------------------------------------------------------
def smells(files: DataFrame) -> DataFrame:
    """(path, smell, detail): casts, imports that the body does not name, sources without a test, exports of files that no other names.

    Files meet by name: stems are looked up in the words of all other files, not in every file's text.  Both sides of a join grow with
    the files, though what is derived from narrow columns is estimated as small: so they are merged, and none is sent whole.
    """
    base = files.withColumn("name", F.expr("element_at(split(path, '/'), -1)")).withColumn("ext", F.regexp_extract("name", r"(\.[^.]*)$", 1)).withColumn("stem", F.expr("left(name, length(name) - length(ext))"))
    casts = base.selectExpr("path", "'type_safety' AS smell", "cast(size(split(content, 'as any', -1)) - 1 AS string) AS detail").where("detail <> '0'")
    head = r"(?s)\A(?:[ \t]*(?:import [^\n]*)?(?:\n|\z))*"
    named = base.withColumn("head", F.regexp_extract("content", head, 0)).withColumn("body", F.expr("substring(content, length(head) + 1)"))
    names = named.select("path", "body", F.explode(F.expr("flatten(transform(regexp_extract_all(head, 'import\\\\s+[{]([^}]+)[}]', 1), g -> split(g, ',')))")).alias("n")).selectExpr("path", "body", "trim(element_at(split(trim(n), '\\\\s+as\\\\s+'), -1)) AS n")
    unused = names.where("n <> '' AND NOT array_contains(split(body, '[^A-Za-z0-9_$]+'), n)").selectExpr("path", "'import_anomaly' AS smell", "n AS detail")
    tests = base.where("stem LIKE '%.test' OR stem LIKE '%.spec'").selectExpr("left(stem, length(stem) - 5) AS stem", "ext").distinct()
    untested = base.where("NOT (stem LIKE '%.test' OR stem LIKE '%.spec')").join(tests.hint("merge"), ["stem", "ext"], "left_anti").selectExpr("path", "'missing_test' AS smell", "stem AS detail")
    words = base.select(F.col("path").alias("other"), F.explode(F.expr("array_distinct(split(content, '[^A-Za-z0-9_$-]+'))")).alias("stem")).where("stem <> ''")
    used = base.select("path", "stem").join(words.hint("merge"), "stem").where("path <> other").select("path").distinct()
    dead = base.join(used.hint("merge"), "path", "left_anti").select("path", F.lit("dead_export").alias("smell"), F.explode(F.expr("regexp_extract_all(content, 'export\\\\s+(?:function|const|class|type|interface|enum)\\\\s+(\\\\w+)', 1)")).alias("detail"))
    return casts.unionByName(unused).unionByName(untested).unionByName(dead)


# -- artifacts ----------------------------------------------------------------------------------------------------
#: Words that drift from the vocabulary, by where they stand.
DRIFT = (
    ("domain", "correctness robustness performance reliability", "(?im)(domain|domains tested|domains activated).*\\b{}\\b"), ("confidence", "Probable Certain Uncertain Possible Confirmed", "(?m)[*][*]Confidence:[*][*].*\\b{}\\b"),
    ("verdict", "PASSED FAILED APPROVED REJECTED CLEAN DIRTY", "(?s)(?=.*(Adversarial Quality Report|AQS Report)).*\\b{}\\b"),
)
#: Top-level fields of each kind of artifact, statuses it may have, reasons of sampling.
ARTIFACTS = {
    "quality-budget": ("schema_version task_id artifact_status cynefin_mix beads corrections metrics timing escapes", "partial ready final"),
    "hazard-defense-ledger": ("schema_version task_id artifact_status stpa_required summary records", "seeded active final"),
    "stress-session": ("schema_version task_id artifact_status sampling_reason selection stressors_applied harvest subtraction_log summary", "planned active final"),
    "decision-noise-summary": ("schema_version task_id artifact_status metrics escalations", "partial final"),
    "mode-convergence-summary": ("schema_version task_id artifact_status execution_mode summary", "partial final"),
}
#: Sections of a hardening report.
SECTIONS = ("Observability Profile", "Premortem Analysis", "Pre-Clean Results", "Instrumentation Summary", "Edge Case Tests Generated", "Red Team Findings", "Post-Clean Results", "WYSIATI Coverage Sweep", "Evidence Ledger", "Verdict")
MAX_ARTIFACT = 102_400


def vocabulary(files: DataFrame) -> DataFrame:
    """(path, kind, word) of words that drift; one pass over the texts."""
    found = ", ".join(f"CASE WHEN content rlike {_quoted(pattern.format(w))} THEN named_struct('kind', '{kind}', 'word', '{w}') END" for kind, words, pattern in DRIFT for w in words.split())
    return files.select("path", F.explode(F.filter(F.expr(f"array({found})"), lambda f: f.isNotNull())).alias("f")).select("path", "f.kind", "f.word")


def incomplete(files: DataFrame) -> DataFrame:
    """(path, problem): fields that an artifact of its kind lacks, and a status that it may not have."""
    kinds = " ".join(f"WHEN path LIKE '%{k}.yaml' THEN array({', '.join(repr(f) for f in fields.split())})" for k, (fields, _) in ARTIFACTS.items())
    allowed = " ".join(f"WHEN path LIKE '%{k}.yaml' THEN array({', '.join(repr(s) for s in states.split())})" for k, (_, states) in ARTIFACTS.items())
    known = files.withColumn("need", F.expr(f"CASE {kinds} END")).withColumn("allowed", F.expr(f"CASE {allowed} END")).where("need IS NOT NULL")
    status = known.withColumn("has", F.expr("regexp_extract_all(coalesce(content, ''), '(?m)^([a-z_]+):', 1)")).withColumn("status", F.expr("nullif(trim(regexp_extract(coalesce(content, ''), '(?m)^artifact_status: *([^\\\\n]*)', 1)), '')"))
    problems = "concat(transform(array_except(need, has), f -> concat('missing ', f)), CASE WHEN status IS NOT NULL AND NOT array_contains(allowed, status) THEN array(concat('status ', status)) ELSE array() END)"
    return status.select("path", F.explode(F.expr(problems)).alias("problem"))


def report_problems(files: DataFrame) -> DataFrame:
    """(path, problem) of hardening reports: sections that lack, ledgers of fewer than three lines, no verdict."""
    missing = f"transform(filter(array({', '.join(repr(s) for s in SECTIONS)}), s -> NOT content rlike concat('(?m)^## ', s)), s -> concat('missing ', s))"
    short = lambda s: f"CASE WHEN content rlike '(?m)^## {s}' AND size(split(regexp_extract(content, '(?ms)^(## {s}.*?)(?=^## |\\\\z)', 1), '\\n', -1)) - 1 < 2 THEN array('empty {s}') ELSE array() END"
    verdict = "CASE WHEN NOT content rlike 'reliability-proven|escalated' THEN array('no verdict') ELSE array() END"
    return files.select("path", F.explode(F.expr(f"concat({missing}, {short('Evidence Ledger')}, {short('WYSIATI Coverage Sweep')}, {verdict})")).alias("problem"))


def artifact_status(files: DataFrame) -> DataFrame:
    """(path, status): the first of missing, outside, oversized, empty, malformed and stale that holds, else valid."""
    malformed = "NOT (content rlike '(?m)^## Cross-Model Review:' AND content rlike '(?m)^### Findings' AND content rlike '(?m)^### Summary' AND contains(content, '| # | Severity |'))"
    return files.selectExpr(
        "path",
        f"""CASE WHEN content IS NULL THEN 'MISSING' WHEN project IS NOT NULL AND NOT startswith(path, concat(project, '/')) THEN 'PATH_VIOLATION' WHEN octet_length(content) > {MAX_ARTIFACT} THEN 'OVERSIZED'
        WHEN trim(translate(content, '\\n\\t', '  ')) = '' THEN 'EMPTY' WHEN {malformed} THEN 'MALFORMED' WHEN checksum IS NOT NULL AND checksum <> sha2(content, 256) THEN 'STALE' ELSE 'VALID' END AS status""",
    )


def observed(outputs: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """(id, passed, why): what a command's output was to show; the limit on its size is tested first."""
    hits = "regexp_extract_all(output, value, {0})"
    held = f"""CASE kind WHEN 'empty' THEN output = '' WHEN 'contains' THEN contains(output, value) WHEN 'regex' THEN output rlike value
      WHEN 'test_count_regex' THEN size({hits.format(0)}) = 1 AND coalesce(try_cast(get({hits.format(1)}, 0) AS int) >= least, false) ELSE false END"""
    out = outputs.selectExpr("id", f"octet_length(output) > {limit} AS over", f"coalesce({held}, false) AS held")
    return out.selectExpr("id", "NOT over AND held AS passed", "CASE WHEN over THEN 'VERIFY_OUTPUT_LIMIT' WHEN NOT held THEN 'VERIFY_OBSERVATION_FAILED' END AS why")


#: What assigns a secret, and what logs.
SECRET = "(?i)(password|secret|token|api_key|apikey|credential|private_key|auth_key|access_key)\\s*="
LOG = "(?i)(log[.]|logger[.]|console[.]log|console[.]error|console[.]warn|print[(]|printf[(]|logging[.]|System[.]out[.]print|NSLog[(])"


def secrets_near_logs(files: DataFrame, reach: int = 10, secret: str = SECRET, log: str = LOG) -> DataFrame:
    """(path, secret, log): lines that assign a secret within ``reach`` lines of a line that logs, by neighbouring cells."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("k", "text")).withColumn("line", F.col("k") + 1)
    width = reach + 1
    x = lines.where(f"text rlike {_quoted(secret)}").selectExpr("path", "line AS secret", f"explode(array(line div {width} - 1, line div {width}, line div {width} + 1)) AS cell")
    y = lines.where(f"text rlike {_quoted(log)}").selectExpr("path", "line AS log", f"line div {width} AS cell")
    return x.join(y, ["path", "cell"]).where(f"abs(secret - log) <= {reach}").select("path", "secret", "log")


# -- store --------------------------------------------------------------------------------------------------------
#: Seconds without a heartbeat after which a claim is stale, by domain.
HEARTBEATS = {"clear": 300, "complicated": 900, "complex": 1800, "chaotic": 300, "confusion": 900}
STALE_AFTER, SALIENCE, DAYS, CEILING = 300, 0.05, 30, 50.0


def archive(findings: DataFrame, today: str) -> DataFrame:
    """(id, state): open findings below the least salience, or untouched for more than thirty days, are archived."""
    return findings.selectExpr("id", f"CASE WHEN state = 'open' AND (salience < {SALIENCE} OR updated < timestamp '{today}' - interval {DAYS} days) THEN 'archived' ELSE state END AS state")


def recover(tasks: DataFrame, agents: DataFrame, now: str, thresholds: dict[str, int] | None = None) -> DataFrame:
    """(id, status, retries) of claimed tasks whose owner's heartbeat is missing or too old for the task's domain."""
    table = "map(" + ", ".join(f"'{k}', {v}" for k, v in (thresholds or HEARTBEATS).items()) + ")"
    limit = f"coalesce({table}[lower(trim(get_json_object(description, '$.cynefin_domain')))], {STALE_AFTER})"
    stale = tasks.where("status = 'claimed' AND level IS NOT NULL").join(agents.selectExpr("id AS owner", "heartbeat"), "owner").where(f"heartbeat IS NULL OR unix_timestamp(timestamp '{now}') - unix_timestamp(try_to_timestamp(heartbeat, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")) > {limit} OR try_to_timestamp(heartbeat, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") IS NULL")
    return stale.selectExpr("id", "CASE WHEN coalesce(retries, 0) < most THEN 'pending' ELSE 'needs_review' END AS status", "CASE WHEN coalesce(retries, 0) < most THEN coalesce(retries, 0) + 1 ELSE coalesce(retries, 0) END AS retries")


def work(tasks: DataFrame, costs: DataFrame) -> DataFrame:
    """(mission, answer) of each mission's tasks: 'work' if a task is due whose bead costs less than the ceiling; 'synthesize' if none is due and all that have a bead are done and synced; else 'none'."""
    known = tasks.join(costs, "bead", "left").withColumn("due", F.expr("level IS NOT NULL AND (status IN ('pending', 'needs_review') OR (status = 'completed' AND NOT synced))"))
    sums = known.groupBy("mission").agg(
        F.expr("count_if(due) AS due"), F.expr(f"count_if(due AND NOT coalesce(cost >= {CEILING}, false)) AS open"), F.expr("count_if(level IS NOT NULL AND bead IS NOT NULL) AS beads"),
        F.expr("count_if(level IS NOT NULL AND bead IS NOT NULL AND status IN ('completed', 'cancelled') AND synced) AS done"),
    )
    return sums.selectExpr("mission", "CASE WHEN open > 0 THEN 'work' WHEN due = 0 AND beads > 0 AND done = beads THEN 'synthesize' ELSE 'none' END AS answer")


def lifecycle_of_findings(actions: DataFrame) -> DataFrame:
    """(finding, state, salience): actions in order; only suppressed findings resurface, and come back at full salience."""
    order = Window.partitionBy("finding").orderBy("at")
    states = "CASE action WHEN 'promote' THEN 'promoted' WHEN 'suppress' THEN 'suppressed' WHEN 'defer' THEN 'deferred' WHEN 'resurface' THEN 'open' ELSE 'open' END"
    kept = actions.withColumn("before", F.lag("action").over(order)).where("action <> 'resurface' OR before = 'suppress'")
    last = kept.groupBy("finding").agg(F.max_by(F.expr(states), "at").alias("state"), F.max_by(F.when(F.col("action").isin("defer", "resurface", "open"), F.expr("CASE action WHEN 'defer' THEN 0.1D WHEN 'resurface' THEN 1D ELSE salience END")), F.when(F.col("action").isin("defer", "resurface", "open"), F.col("at"))).alias("salience"))
    return last
