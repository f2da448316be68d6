"""Rules over rows whose results were worked out by hand: each case covers a rule's branches and ties."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions.names import long_words, type_of, words_of_name
from tessera.operators.rules import advice, anchoring, applicable, boundary, budget_state, complexity_weight, convergence, convergence_summary, convergence_yield, distance, entropy, execution_mode, floors, frequency_coverage, hard_stop, harvest, hazards, justified, lifecycle, low_confidence_flood, map_convergence, noise, open_hazards, promotion, queue_starvation, rising_escalation, rolling_budget, routed, severity_trend, simplicity, swallowed, transitions
from tessera.operators.rules_text import ARTIFACTS, SECTIONS, archive, artifact_status, blocks, code_tokens, incomplete, lifecycle_of_findings, longest_directory, normalised, observed, recover, report_problems, secrets_near_logs, smells, vocabulary, work
from tessera.operators import udf_operators as U
from tessera.operators.strategies import grams, winnowed
from tessera.operators.rules_store import appended, definitions, deviance, gates, merged_ledger, noise_band, packet, protection, prunable, report, review_problems, swap

CASES: dict[str, tuple] = {}


def cases(name, columns, rows, rule, expected, want, doubles=""):
    CASES[name] = (columns, rows, rule, [c.strip().strip('"') for c in expected.split(",")], want)


cases("agg_14_complexity_weight", "task int, clear int, complicated int, complex int, chaotic int", [(1, 0, 0, 0, 0), (2, 2, 1, 0, 0), (3, 0, 0, 0, 3), (4, 1, 1, 1, 0), (5, 0, 7, 0, 0)], complexity_weight, "task, weight", [(1, 0.0), (2, 0.16), (3, 1.5), (4, 0.5), (5, 0.5)], "weight")
cases("agg_15_threshold_lookup", "task int, weight double", [(1, 0.0), (2, 0.2), (3, 0.21), (4, 0.5), (5, 0.8), (6, 0.81), (7, 1000.0)], floors, "task, healthy, depleted", [(1, 0.9, 0.6), (2, 0.9, 0.6), (3, 0.75, 0.5), (4, 0.75, 0.5), (5, 0.6, 0.35), (6, 0.5, 0.25), (7, 0.5, 0.5)], "healthy depleted")
cases(
    "agg_16_budget_state", "task int, rate double, escapes int, turbulence int, completed int, healthy double, depleted double",
    [(1, 0.9, 0, 0, 3, 0.9, 0.6), (2, 0.9, 1, 0, 3, 0.9, 0.6), (3, 0.95, 2, 0, 3, 0.9, 0.6), (4, 0.59, 0, 0, 3, 0.9, 0.6), (5, 0.6, 0, 0, 3, 0.9, 0.6), (6, 1.0, 0, 19, 3, 0.9, 0.6), (7, 1.0, 0, 18, 3, 0.9, 0.6), (8, 1.0, 0, 99, 0, 0.9, 0.6)],
    budget_state, "task, state", [(1, "healthy"), (2, "warning"), (3, "depleted"), (4, "depleted"), (5, "warning"), (6, "depleted"), (7, "healthy"), (8, "healthy")],
)
cases(
    "agg_17_hard_stops", "task int, lint boolean, types boolean, critical int, stuck int, blocked int, age int",
    [(1, True, True, 0, 0, 0, 9999), (2, False, True, 0, 0, 0, 0), (3, True, False, 0, 0, 0, 0), (4, True, True, 1, 0, 0, 0), (5, True, True, 0, 1, 0, 0), (6, True, True, 0, 0, 1, 3600), (7, True, True, 0, 0, 1, 3601), (8, None, None, 0, 0, 0, 0)],
    hard_stop, "task, stopped", [(1, False), (2, True), (3, True), (4, True), (5, True), (6, False), (7, True), (8, False)],
)
cases(
    "agg_18_mode_vote", "task int, turbulence double, zero_rate double, latency double, escalations int",
    [(1, 0.5, 0.9, 30.0, 0), (2, 1.0, 0.9, 30.0, 0), (3, 1.0, 0.8, 30.0, 0), (4, 4.0, 0.4, 301.0, 3), (5, 3.0, 0.5, 300.0, 2), (6, 4.0, 0.4, 301.0, 2), (7, 0.5, 0.4, 100.0, 0)],
    execution_mode, "task, mode, confidence", [(1, "skill_based", "high"), (2, "skill_based", "medium"), (3, "rule_based", "low"), (4, "knowledge_based", "high"), (5, "rule_based", "high"), (6, "knowledge_based", "medium"), (7, "rule_based", "low")],
)
cases(
    "agg_19_severity_trend", "cycle int, before array<string>, now array<string>",
    [(1, [], ["P1"]), (2, ["P2", "P3"], ["P1", "P3"]), (3, ["P1"], ["P4"]), (4, ["P2"], ["P2", "P4"]), (5, ["P3"], []), (6, ["odd"], ["P4"]), (7, None, ["P1"])],
    severity_trend, "cycle, trend", [(1, "stable"), (2, "escalating"), (3, "declining"), (4, "stable"), (5, "declining"), (6, "escalating"), (7, "stable")],
)
cases("agg_20_entropy", "cycle int, categories array<string>", [(1, ["s", "s", "f"]), (2, []), (3, ["a"]), (4, ["a", "b"]), (5, ["a", "b", "c", "d"])], entropy, "cycle, entropy", [(1, 0.918), (2, 0.0), (3, 0.0), (4, 1.0), (5, 2.0)], "entropy")
cases(
    "agg_21_convergence_state", "id int, fresh int, repeated int, trend string, entropy double, budget int, cycle int",
    [(1, 5, 5, "stable", 2.0, 3, 1), (2, 5, 5, "escalating", 2.0, 3, 1), (3, 1, 9, "stable", 0.5, 3, 5), (4, 1, 9, "stable", 0.5, 3, 6), (5, 1, 9, "stable", 1.0, 3, 1), (6, 1, 9, "declining", 1.5, 3, 1), (7, 2, 8, "stable", 0.1, 3, 1), (8, 0, 0, "stable", 1.0, 3, 1)],
    convergence, "id, rate, state, recommendation",
    [(1, 0.5, "converging", "continue"), (2, 0.5, "diverging", "change_approach"), (3, 0.1, "stuck", "extend_budget"), (4, 0.1, "stuck", "change_approach"), (5, 0.1, "stable", "stop_early"), (6, 0.1, "stuck", "extend_budget"), (7, 0.2, "stuck", "extend_budget"), (8, 0.0, "stable", "stop_early")], "rate",
)
cases("agg_22_convergence_summary", "task int, at bigint, reason string", [(1, 1, "coupling"), (1, 2, "ambiguity"), (1, 3, "ambiguity"), (2, 1, "b"), (2, 2, "a"), (3, 1, None), (3, 2, None)], convergence_summary, "task, n, dominant", [(1, 3, "ambiguity"), (2, 2, "b"), (3, 2, None)])
cases("agg_23_convergence_yield", "task int, cycles int, stops int, extensions int, changes int", [(1, 3, 1, 0, 0), (2, 0, 1, 1, 1), (3, 0, 0, 0, 0), (4, 7, 2, 9, 9)], convergence_yield, "task, yield", [(1, 0.333), (2, 0.333), (3, 0.0), (4, 0.286)], "yield")
_PASS = "id int, bead string, grp string, mode string, parent int, evidence int, impact int, familiarity int, confidence int, bucket int, decision string, anchor_evidence int, anchor_impact int, anchor_familiarity int"
_PASSES = [
    (1, "b1", "g1", "blind_first", None, 4, 3, 3, 3, None, "pass", None, None, None), (2, "b1", "g1", "blind_first", None, 1, 3, 3, 3, 3, "fail", None, None, None), (3, "b1", "g1", "blind_first", None, 5, 5, 5, 5, 5, "pass", None, None, None),
    (4, "b2", "g2", "blind_first", None, 2, 2, None, 3, 2, "pass", None, None, None), (5, "b2", "g2", "exposed", 4, 4, 2, 3, 3, 2, "pass", 5, None, None), (6, "b2", "g2", "blind_first", None, 2, 2, 3, 3, 2, "pass", None, None, None),
    (7, "b3", None, "exposed", 1, 4, 1, 3, 3, 3, "fail", 1, 3, None), (8, "b3", None, "exposed", 99, 1, 1, 1, 1, 1, "fail", 1, 1, 1), (9, "b4", None, "blind_first", None, 3, 3, 3, 3, 3, None, None, None, None),
]
cases("agg_24_map_distance", _PASS, _PASSES, lambda p: p.alias("x").join(p.alias("y"), F.expr("x.bead = y.bead AND x.id < y.id")).selectExpr("x.id AS a", "y.id AS b", f"round({distance()}, 3) AS d"), "a, b, d", [(1, 2, 3.0), (1, 3, 4.123), (2, 3, 5.657), (4, 5, 2.0), (4, 6, 0.0), (5, 6, 2.0), (7, 8, 4.583)], "d")
cases("agg_25_noise_index", _PASS, _PASSES, lambda p: noise(p).select("noise_index", "n"), "noise_index, n", [(1.5, 2)], "noise_index")
cases("agg_26_agreement", _PASS, _PASSES, lambda p: map_convergence(p).crossJoin(noise(p).select("agreement")), "bead, convergence, agreement", [("b1", 0.19, 0.5), ("b2", 0.429, 0.5), ("b3", 0.179, 0.5), ("b4", 1.0, 0.5)], "convergence agreement")
cases("agg_27_anchoring_drift", _PASS, _PASSES, anchoring, "n, drifted, rate", [(3, 1, 0.333)], "rate")
cases("agg_29_escalation_advice", "task int, flips int, divergence int, drift int, unbacked int", [(1, 1, 0, 0, 0), (2, 0, 1, 1, 0), (3, 0, 1, 0, 0), (4, 0, 0, 1, 0), (5, 0, 0, 0, 1), (6, 0, 0, 0, 0)], advice, "task, advice", [(1, "re-review recommended"), (2, "re-review recommended"), (3, "second arbiter pass recommended"), (4, "second arbiter pass recommended"), (5, "second arbiter pass recommended"), (6, "no action")])
cases("agg_28_frequency_coverage", "severity string, hits int, class_state string", [("high", 3, "available"), ("high", None, "available"), ("high", None, None), ("low", None, "available"), ("low", 0, None), ("high", None, "unknown")], frequency_coverage, "coverage, unbacked", [(0.333, 1)], "coverage")
_STRESSORS = [("s1", [], [], "established"), ("s2", ["complex"], [], "provisional"), ("s3", [], ["io", "net"], "established"), ("s4", ["clear"], ["io"], "established"), ("s5", [], [], "retired")]
cases(
    "jn_13_stressor_applicability", "bead string, domain string, tags array<string>", [("a", "complex", ["io"]), ("b", "clear", ["ui"]), ("c", "clear", ["io"]), ("d", "chaotic", [])],
    lambda b: applicable(b, b.sparkSession.createDataFrame(_STRESSORS, "stressor string, domains array<string>, tags array<string>, status string")), "bead, stressor",
    [("a", "s1"), ("a", "s2"), ("a", "s3"), ("b", "s1"), ("c", "s1"), ("c", "s3"), ("c", "s4"), ("d", "s1")],
)
cases(
    "agg_30_hazard_summary", "task int, bead string, defenses array<string>, risk string, status string",
    [(1, "a", ["x"], "low", "open"), (1, "a", ["y"], "high", "closed"), (2, "a", [], "high", "closed"), (3, "a", None, "low", "closed"), (3, "b", ["z"], "low", "escaped"), (4, "a", ["z"], "high", "closed")],
    hazards, "task, beads, n, without, risky, escaped, open, state", [(1, 1, 2, 0, 1, 0, 1, "warning"), (2, 1, 1, 1, 1, 0, 0, "depleted"), (3, 2, 2, 1, 0, 1, 0, "warning"), (4, 1, 1, 0, 1, 0, 0, "healthy")],
)
cases("flt_23_open_hazards", "id int, controls array<string>, layer string", [(1, [], "L1"), (2, None, "L2"), (3, ["c"], "escaped"), (4, ["c"], "L1"), (5, ["c"], None)], open_hazards, "id", [(1,), (2,), (3,)])
_LIBRARY = [("STR-007", "Slow disk"), ("STR-012", "No network"), ("custom", "Odd one")]
cases(
    "agg_39_harvest", "at bigint, stressor string, result string, target string",
    [(1, "STR-NEW-1", "caught", "Full queue"), (2, "STR-NEW-2", "caught", " full QUEUE "), (3, "STR-012", "caught", "Known id"), (4, "STR-NEW-3", "missed", "Missed"), (5, "STR-NEW-4", "caught", "slow DISK"), (1500, "other", "caught", "Clock skew")],
    lambda applied: harvest(applied, applied.sparkSession.createDataFrame(_LIBRARY, "id string, name string")), "name, id", [("Full queue", "STR-013"), ("Clock skew", "STR-014")],
)
_USED = {"s1": "caught missed caught missed", "s2": "missed missed missed missed missed caught", "s3": "missed missed", "s4": "missed missed missed caught", "s5": "caught not_applicable caught"}
cases(
    "win_15_lindy_lifecycle", "stressor string, at int, result string", [(s, k, r) for s, results in _USED.items() for k, r in enumerate(results.split())],
    lifecycle, "stressor, n, caught, rate, status, changes",
    [("s1", 4, 2, 0.5, "established", 1), ("s2", 6, 1, 0.1667, "retired", 0), ("s3", 2, 0, 0.0, "provisional", 0), ("s4", 4, 1, 0.25, "established", 1), ("s5", 2, 2, 1.0, "provisional", 0)], "rate",
)
cases(
    "agg_37_simplicity", "bead int, files int, domain string, cynefin string, criteria int, lines int, abstractions int, dependencies int, nesting int, branches int",
    [(1, 1, "ESSENTIAL", "complex", 2, 10, 1, 1, 1, 3), (2, 2, "ACCIDENTAL", "clear", 1, 14, 0, 0, 0, 0), (3, 1, "ESSENTIAL", "clear", 0, 20, 0, 0, 0, 0), (4, 1, "ACCIDENTAL", "complicated", 0, 100, 2, 1, 2, 9), (5, 1, "ACCIDENTAL", "clear", 0, 0, 0, 0, 0, 0)],
    simplicity, "bead, coefficient, verdict", [(1, 0.5, "PASS"), (2, 0.5, "PASS"), (3, 0.3, "WARNING"), (4, 0.0413, "BLOCKING"), (5, None, "PASS")], "coefficient",
)
cases(
    "win_10_rolling_budget", "system string, task int, day int, quiet boolean, escapes int, high boolean",
    [("s", 1, 0, True, 0, False), ("s", 2, 10, False, 1, False), ("s", 3, 20, True, 0, False), ("s", 4, 30, True, 0, True), ("s", 5, 31, True, 0, True), ("s", 6, 70, True, 2, False), ("t", 7, 0, False, 0, False)],
    rolling_budget, "task, rate, escapes, high, state",
    [(1, 1.0, 0, 0, "healthy"), (2, 0.5, 1, 0, "warning"), (3, 0.6667, 1, 0, "warning"), (4, 0.6667, 1, 1, "warning"), (5, 0.75, 0, 2, "depleted"), (6, 1.0, 2, 0, "depleted"), (7, 0.0, 0, 0, "depleted")], "rate",
)
cases("agg_03_rising_escalation", "workstream string, state string", [("a", "escalated"), ("a", "open"), ("b", "escalated"), ("b", "escalated"), ("b", "open"), ("b", "archived"), ("b", "suppressed"), ("c", "archived")], rising_escalation, "workstream, escalated, n", [("b", 2, 3)])
cases(
    "agg_04_queue_starvation", "workstream string, minute bigint", [("a", 60), ("a", 70), ("b", 69), ("c", 71), ("d", 1)],
    lambda e: queue_starvation(e, e.sparkSession.createDataFrame([("a", {"x": "completed", "y": "failed"}), ("b", {"x": "running"}), ("c", {})], "workstream string, beads map<string,string>"), 100), "workstream, idle", [("a", 30), ("d", 99)],
)
cases("agg_05_low_confidence_flood", "workstream string, state string, confidence double", [("a", "open", 0.4)] * 11 + [("b", "open", 0.4)] * 10 + [("b", "open", 0.5), ("c", "closed", 0.1)] + [("d", "open", 0.49)] * 12, low_confidence_flood, "workstream, n", [("a", 11), ("d", 12)])
cases(
    "flt_04_boundary", "id int, scope string, mission string", [(1, None, "src/run"), (2, "", "src/run"), (3, "src/run/a.ts", "src/run"), (4, "src/run", "src/run"), (5, "src/runner/a.ts", "src/run"), (6, "lib/a.ts", "src/run"), (7, "src/x", "src/run/"), (8, "/src/x", "src/run")],
    boundary, "id, kind", [(1, "novel"), (2, "novel"), (3, "in_scope"), (4, "in_scope"), (5, "adjacent"), (6, "boundary_crossing"), (7, "adjacent"), (8, "adjacent")],
)
_FILES = [
    ("src/a.ts", ""), ("docs/sdlc/active/t1/beads/b1.md", ""), ("docs/sdlc/active/t1/beads/b1-decision-trace.md", ""), ("docs/sdlc/active/t1/adversarial/r.md", ""), ("app/node_modules/x/a.js", ""),
    ("x/feature-matrix.md", ""), ("notes.md", "## Convention Enforcement Report"), ("t/quality-budget.yaml", ""), ("state.md", ""), ("run.py", None), (None, "x"), ("Makefile", ""),
]
cases(
    "flt_06_routing", "path string, content string", _FILES, routed, "path, place, \"check\"",
    [("src/a.ts", 7, "safety-constraints"), ("src/a.ts", 8, "ast-checks"), ("src/a.ts", 9, "eslint-disable"), ("docs/sdlc/active/t1/beads/b1.md", 2, "bead-status"), ("docs/sdlc/active/t1/beads/b1.md", 3, "domain-vocabulary"), ("docs/sdlc/active/t1/beads/b1.md", 6, "decision-trace"),
     ("docs/sdlc/active/t1/beads/b1-decision-trace.md", 2, "bead-status"), ("docs/sdlc/active/t1/beads/b1-decision-trace.md", 3, "domain-vocabulary"), ("docs/sdlc/active/t1/adversarial/r.md", 1, "aqs-artifact"), ("docs/sdlc/active/t1/adversarial/r.md", 3, "domain-vocabulary"),
     ("x/feature-matrix.md", 4, "consistency"), ("notes.md", 4, "consistency"), ("t/quality-budget.yaml", 10, "quality-budget"), ("state.md", 15, "phase-transition"), ("run.py", 7, "safety-constraints"), ("Makefile", 7, "safety-constraints")],
)
cases(
    "flt_07_transitions", "bead int, before string, status string, type string",
    [(1, "pending", "running", None), (2, "pending", "submitted", None), (3, "verified", "merged", "evolve"), (4, "verified", "merged", "fix"), (5, "proven", "merged", None), (6, None, "merged", None), (7, "stuck", "stuck", None), (8, "blocked", "verified", None), (9, "escalated", "pending", None), (10, "merged", "pending", None), (11, "hardened", "reliability-proven", None), (12, "verified", "hardened", None)],
    transitions, "bead, move", [(k, "illegal" if k in (2, 4, 8, 10, 12) else "legal") for k in range(1, 13)],
)
cases(
    "flt_08_empty_catch", "path string, content string",
    [("a", "try {} catch (e) { }"), ("b", "catch { // later\n }"), ("c", "catch (e) { /* no */ }"), ("d", "try:\n  f()\nexcept ValueError:\n    pass\n"), ("e", "except:\n    raise"), ("f", "catch (e) { log(e) }"), ("g", None)],
    swallowed, "path, rule", [("a", "empty"), ("b", "comment"), ("c", "comment"), ("d", "pass")],
)
_COMMENTS = "// eslint-disable-next-line a -- because it must be so; tracked in DEBT-1\n/* eslint-disable b -- long enough reason */\n// eslint-disable-line c\n// eslint-enable c\n// eslint-disable d -- short; expires 2030"
cases("flt_13_suppressions", "path string, content string", [("a.ts", _COMMENTS), ("b.ts", "// eslint-disable-line x"), ("c.ts", "")], justified, "path, line, score", [("a.ts", 1, 2), ("a.ts", 2, 1), ("a.ts", 3, 0), ("a.ts", 5, 1), ("b.ts", 1, 0)])
_PATTERNS = [("p1", "null pointer guard missing", 0.6), ("p2", "race condition lock", 0.4)]
cases(
    "flt_05_promotion", "id int, state string, kind string, confidence double, refs array<string>, scope string, mission string, evidence string",
    [(1, "open", "in_scope", 0.9, ["a:1"], "src/a", "src", "A NULL pointer here"), (2, "open", "in_scope", 0.9, ["a:1"], None, "src", "only a pointer"), (3, "closed", "in_scope", 0.9, ["a:1"], None, "src", ""), (4, "open", "adjacent", 0.9, ["a:1"], None, "src", ""), (5, "open", "in_scope", 0.69, ["a:1"], None, "src", ""), (6, "open", "in_scope", 0.8, [], None, "src", ""), (7, "open", "in_scope", 0.8, ["a:1"], "lib/a", "src", ""), (8, "open", "in_scope", 0.8, ["a:1"], None, "src", "race condition lock")],
    lambda f: promotion(f, f.sparkSession.createDataFrame(_PATTERNS, "pattern string, description string, confidence double"), 11), "id, promoted, why",
    [(1, True, None), (2, False, "pattern"), (3, False, "state"), (4, False, "kind"), (5, False, "confidence"), (6, False, "anchor"), (7, False, "scope"), (8, False, "pattern")],
)
_CODE = [(1, "if (a1 >= 0x1F) { // note\n return \"x\\\"y\" + 'z'; }"), (2, "# only\n/* none */"), (3, "def f(n): return n * 2.5e3 # end"), (4, None)]
_TOKENS = {1: "if keyword|( punctuation|a1 identifier|>= operator|0x1F number|) punctuation|{ punctuation|return keyword|\"x\\\"y\" string|+ operator|'z' string|; punctuation|} punctuation", 3: "def keyword|f identifier|( punctuation|n identifier|) punctuation|: operator|return keyword|n identifier|* operator|2.5e3 number"}
cases("fn_02_code_tokens", "id int, code string", _CODE, lambda s: code_tokens(s).select("id", F.posexplode("tokens").alias("place", "t")).select("id", "place", "t.type", "t.value"), "id, place, type, value", [(i, k, *reversed(t.rsplit(" ", 1))) for i, ts in _TOKENS.items() for k, t in enumerate(ts.split("|"))])
cases("fn_03_normalised_tokens", "id int, code string", _CODE, lambda s: normalised(code_tokens(s)).selectExpr("id", "array_join(names, ' ') AS names"), "id, names", [(1, "if ( _ID >= _NUM ) { return _STR + _STR ; }"), (2, ""), (3, "def _ID ( _ID ) : return _ID * _NUM"), (4, None)])
cases("fn_09_blocks", "id int, token_sequence array<string>", [(1, "arg FunctionDef Name If Compare Return".split()), (2, []), (3, ["Return"]), (4, None)], blocks, "id, place, block", [(1, 0, "arg"), (1, 1, "FunctionDef Name"), (1, 2, "If Compare"), (1, 3, "Return"), (3, 0, "Return")])
cases(
    "fn_14_normalize_type", "id int, raw string", [(1, "Optional[int]"), (2, "string | null"), (3, ""), (4, None), (5, "List[Dict[str, Any]]"), (6, "Promise<User>"), (7, "null | undefined"), (8, " Array<string> "), (9, "Iterator[int]"), (10, "MyType2"), (11, "???")],
    lambda t: t.select("id", type_of(F.col("raw")).alias("norm")), "id, norm", [(1, ""), (2, "string"), (3, "any"), (4, "any"), (5, "array"), (6, "promise"), (7, "void"), (8, "array"), (9, "array"), (10, "mytype"), (11, "any")],
)
cases("fn_15_abbreviations", "id int, name string", [(1, "fmtDateStr"), (2, "getUserCfg"), (3, "XMLParser"), (4, "init_db-conn")], lambda t: t.select("id", F.array_join(long_words(words_of_name(F.col("name"))), " ").alias("words")), "id, words", [(1, "format date string"), (2, "get user config"), (3, "xml parser"), (4, "initialize database connection")])
cases("fn_08_winnow", "id int, token_sequence array<string>", [(1, list("abcdefg")), (2, list("abcd")), (3, list("aaaaaaaaa"))], lambda t: t.selectExpr("id", f"size({winnowed()}) AS n", f"size({grams(5)}) AS n_grams"), "id, n, n_grams", [(1, 3, 3), (2, 0, 0), (3, 1, 5)])
cases("fn_22_longest_directory", "path string", [("src/app/a.ts",), ("src/a.ts",), ("lib/b.py",), ("none.md",), ("ab/cd",)], lambda f: longest_directory(f, f.sparkSession.createDataFrame([("src", "kebab"), ("src/app", "camel"), ("lib", "snake"), ("cd", "later"), ("ab", "first")], "dir string, convention string")), "path, convention", [("src/app/a.ts", "camel"), ("src/a.ts", "kebab"), ("lib/b.py", "snake"), ("ab/cd", "first")])
cases(
    "fn_28_source_smells", "path string, content string",
    [("src/a.ts", "import { x, y as z } from './b'\n\nexport const q = x as any\nlet w = 1 as any"), ("src/b.ts", "export function x() {}\nexport class B {}"), ("src/a.test.ts", "run('a')"), ("src/c.ts", "")],
    smells, "path, smell, detail", [("src/a.ts", "type_safety", "2"), ("src/a.ts", "import_anomaly", "z"), ("src/b.ts", "missing_test", "b"), ("src/c.ts", "missing_test", "c")],
)
cases(
    "flt_09_vocabulary", "path string, content string",
    [("a", "Domains tested: Security, Robustness"), ("b", "**Confidence:** Probable"), ("c", "AQS Report\nverdict: PASSED"), ("d", "verdict: PASSED"), ("e", "robustness\ndomain: security"), ("f", None)],
    vocabulary, "path, kind, word", [("a", "domain", "robustness"), ("b", "confidence", "Probable"), ("c", "verdict", "PASSED")],
)
cases(
    "flt_10_required_sections", "path string, content string",
    [("t/mode-convergence-summary.yaml", "schema_version: 1\ntask_id: t\nartifact_status: final\nexecution_mode:\n  x: 1\nsummary:\n"), ("t/decision-noise-summary.yaml", "schema_version: 1\ntask_id: t\nartifact_status: ready\n"), ("t/hazard-defense-ledger.yaml", None), ("notes.yaml", "")],
    incomplete, "path, problem",
    [("t/decision-noise-summary.yaml", "missing metrics"), ("t/decision-noise-summary.yaml", "missing escalations"), ("t/decision-noise-summary.yaml", "status ready"), *[("t/hazard-defense-ledger.yaml", f"missing {f}") for f in ARTIFACTS["hazard-defense-ledger"][0].split()]],
)
_REPORT = "".join(f"## {s}\nline one\nline two\n" for s in SECTIONS)
cases(
    "flt_12_report_sections", "path string, content string",
    [("a", _REPORT + "reliability-proven"), ("b", _REPORT), ("c", _REPORT.replace("## Evidence Ledger\nline one\nline two\n", "## Evidence Ledger\n") + "escalated"), ("d", _REPORT.replace("## Verdict", "# Verdict") + "escalated")],
    report_problems, "path, problem", [("b", "no verdict"), ("c", "empty Evidence Ledger"), ("d", "missing Verdict")],
)
_REVIEW = "## Cross-Model Review: x\n### Findings\n| # | Severity |\n### Summary\n"
cases(
    "flt_20_artifact_ladder", "path string, project string, content string, checksum string",
    [("p/a", "p", None, None), ("q/a", "p", _REVIEW, None), ("p/b", "p", "x" * 102_401, None), ("p/c", "p", " \n\t ", None), ("p/d", "p", "## Cross-Model Review: x", None), ("p/e", "p", _REVIEW, "00"), ("p/f", "p", _REVIEW, None), ("p/g", None, "x" * 102_400, None)],
    artifact_status, "path, status", [("p/a", "MISSING"), ("q/a", "PATH_VIOLATION"), ("p/b", "OVERSIZED"), ("p/c", "EMPTY"), ("p/d", "MALFORMED"), ("p/e", "STALE"), ("p/f", "VALID"), ("p/g", "MALFORMED")],
)
cases(
    "flt_21_observation", "id int, kind string, output string, value string, least int",
    [(1, "empty", "", None, None), (2, "empty", " ", None, None), (3, "contains", "all ok", "ok", None), (4, "regex", "12 passed", "[0-9]+ passed", None), (5, "test_count_regex", "12 passed", "([0-9]+) passed", 12), (6, "test_count_regex", "12 passed, 3 passed", "([0-9]+) passed", 1), (7, "test_count_regex", "12 passed", "([0-9]+) passed", 13), (8, "other", "x", "x", None), (9, "contains", "o" * 1_048_577, "o", None)],
    observed, "id, passed, why", [(k, True, None) if k in (1, 3, 4, 5) else (k, False, "VERIFY_OUTPUT_LIMIT" if k == 9 else "VERIFY_OBSERVATION_FAILED") for k in range(1, 10)],
)
_LINES = lambda *at: "\n".join(dict(at).get(k, "") for k in range(1, 40))
cases("jn_07_line_proximity", "path string, content string", [("a", _LINES((1, "password = x"), (11, "logger.info(1)"))), ("b", _LINES((1, "token=1"), (12, "print(2)"))), ("c", _LINES((30, "API_KEY = 2"), (21, "console.log(1)"), (35, "print(3)"))), ("d", None)], secrets_near_logs, "path, secret, log", [("a", 1, 11), ("c", 30, 21), ("c", 30, 35)])
cases("str_07_archive", "id int, state string, salience double, updated string", [(1, "open", 0.04, "2026-01-31"), (2, "open", 0.05, "2026-01-31"), (3, "open", 0.9, "2026-01-01"), (4, "open", 0.9, "2026-01-02"), (5, "promoted", 0.0, "2020-01-01")], lambda f: archive(f.withColumn("updated", F.to_timestamp("updated")), "2026-02-01 00:00:00"), "id, state", [(1, "archived"), (2, "open"), (3, "archived"), (4, "open"), (5, "promoted")])
cases(
    "str_08_stale_claims", "id int, status string, level string, owner string, retries int, most int, description string",
    [(1, "claimed", "L0", "a", 0, 3, None), (2, "claimed", "L0", "b", 3, 3, None), (3, "claimed", "L0", "c", None, 3, '{"cynefin_domain": " Complex "}'), (4, "claimed", "L0", "c", 1, 3, "{}"), (5, "pending", "L0", "a", 0, 3, None), (6, "claimed", None, "a", 0, 3, None), (7, "claimed", "L0", "d", 1, 3, None), (8, "claimed", "L0", "nobody", 0, 3, None)],
    lambda t: recover(t, t.sparkSession.createDataFrame([("a", "2026-01-01T00:00:00Z"), ("b", None), ("c", "2026-01-01T00:51:00Z"), ("d", "soon")], "id string, heartbeat string"), "2026-01-01 01:00:00", {"complex": 600}), "id, status, retries", [(1, "pending", 1), (2, "needs_review", 3), (4, "pending", 2), (7, "pending", 2)],
)
_TASKS = "mission int, bead string, level string, status string, synced boolean"
cases(
    "str_09_work_detection", _TASKS,
    [(1, "a", "L0", "pending", False), (2, "dear", "L0", "pending", False), (3, "a", "L0", "completed", True), (3, "b", "L0", "cancelled", True), (4, "a", "L0", "completed", True), (4, "b", "L0", "running", False), (5, "a", None, "pending", False), (6, "a", "L0", "completed", False)],
    lambda t: work(t, t.sparkSession.createDataFrame([("dear", 50.0), ("a", 49.9)], "bead string, cost double")), "mission, answer", [(1, "work"), (2, "none"), (3, "synthesize"), (4, "none"), (5, "none"), (6, "work")],
)
cases(
    "str_06_finding_lifecycle", "finding int, at int, action string, salience double",
    [(1, 1, "open", 0.6), (1, 2, "suppress", None), (1, 3, "resurface", None), (2, 1, "open", 0.7), (2, 2, "resurface", None), (3, 1, "open", 0.5), (3, 2, "defer", None), (4, 1, "open", 0.5), (4, 2, "promote", None), (5, 1, "open", 0.3), (5, 2, "suppress", None)],
    lifecycle_of_findings, "finding, state, salience", [(1, "open", 1.0), (2, "open", 0.7), (3, "deferred", 0.1), (4, "promoted", 0.5), (5, "suppressed", 0.3)], "salience",
)
_RECORDS = [{"file": "a.py", "name": "f", "line": 1}, {"file": "b.py", "name": "g", "line": 2, "params": [{"name": "x", "type": "int"}]}]
cases(
    "str_13_status_swap", "bead int, level string, status string, expected string",
    [(1, "L0", "running", None), (2, "L1", "running", None), (3, "L1", "verified", None), (4, "L1", "proven", "submitted"), (5, "L1", "submitted", "submitted"), (6, "L9", "running", None), (7, "L2", "odd", None), (8, "L2", "odd", "odd"), (9, "L2", "running", "running"), (10, "L2.75", "hardened", None)],
    swap, "bead, action, status",
    [(1, "advanced", "submitted"), (2, "mismatch", "running"), (3, "skipped", "verified"), (4, "mismatch", "proven"), (5, "advanced", "verified"), (6, "unknown level", "running"), (7, "unknown status", "odd"), (8, "unknown status", "odd"), (9, "advanced", "proven"), (10, "advanced", "reliability-proven")],
)
cases(
    "str_10_clone_pruning", "clone string, level string, status string, synced boolean",
    [("a", "L0", "completed", True), ("b", "L0", "completed", False), ("c", "L0", "completed", False), ("d", "L0", "running", True), ("d", "L0", "completed", True), ("e", None, "completed", True), ("f", "L0", "cancelled", True), (None, "L0", "completed", True)],
    lambda t: prunable(t, t.sparkSession.createDataFrame([("a", 1), ("b", 24), ("c", 25), ("d", 99), ("e", 99), ("g", 99)], "clone string, hours int")), "clone", [("a",), ("c",)],
)
cases(
    "snk_02_append_once", "task string, status string, value int, at int", [("t1", "final", 9, 1), ("t2", "ready", 2, 1), ("t3", "final", 4, 2), ("t3", "final", 3, 1), (None, "final", 5, 1), ("t4", "final", 6, 1)],
    lambda rows: appended(rows.sparkSession.createDataFrame([("t1", 1), ("t0", 0)], "task string, value int"), rows), "task, value", [("t0", 0), ("t1", 1), ("t3", 3), ("t4", 6)],
)
cases(
    "str_04_ledger_update", "workstream string, column string, value string, at string", [("a", "branch", "dev", "3"), ("a", "branch", "old", "2"), ("a", "repo", "evil", "9"), ("b", "mission_id", None, "4"), ("z", "branch", "x", "1")],
    lambda u: merged_ledger(u.sparkSession.createDataFrame([("a", "main", "m1", None, "{}", "c1", "1"), ("b", "main", "m2", "s", "{}", "c2", "1"), ("c", "main", "m3", "s", "{}", "c3", "1")], "workstream string, branch string, mission_id string, scope_region string, active_beads string, latest_commit string, updated string"), u),
    "workstream, branch, mission_id, scope_region, active_beads, latest_commit, updated", [("a", "dev", "m1", None, "{}", "c1", "3"), ("b", "main", None, "s", "{}", "c2", "4"), ("c", "main", "m3", "s", "{}", "c3", "1")],
)
cases(
    "str_05_rehydrate", "workstream string, entry string, at int", [("a", "e1", 1), ("a", "e2", 2), ("a", "e3", 3), ("a", "e4", 4), ("b", "e5", 1), ("x", "e6", 1)],
    lambda j: packet(j.sparkSession.createDataFrame([("a", "main"), ("b", "dev"), ("c", "new")], "workstream string, branch string"), j, j.sparkSession.createDataFrame([("a", "f1", "open", 0.2), ("a", "f2", "open", 0.9), ("a", "f3", "closed", 1.0), ("c", "f4", "open", 0.5)], "workstream string, finding string, state string, salience double")),
    "workstream, branch, entries, open", [("a", "main", "e4 e3 e2", "f2 f1"), ("b", "dev", "e5", ""), ("c", "new", "", "f4")],
)
cases(
    "win_13_deviance", "system string, task int, clear_rate double, fast_rate double, depth double, skip_rate double, healthy_for double",
    [("s", k, 0.1 * (k > 10), 0.5, 3.0 - (k > 10), 0.0 if k < 20 else 1.0, 1.0) for k in range(1, 21)] + [("t", k, 1.0 * k, 1.0, 1.0, 1.0, 1.0) for k in range(1, 13)],
    lambda t: deviance(t).where("task >= 11"), "task, signs, alert",
    [(11, 0, "NONE"), (12, 0, "NONE"), *[(k, 0, "NONE") for k in range(11, 20)], (20, 3, "RED")],
)
cases(
    "win_14_protection_ratio", "system string, task int, protecting int, beads int", [("s", 1, 1, 4), ("s", 2, 0, 1), ("s", 3, 0, 1), ("s", 4, 0, 1), ("s", 5, 0, 1), ("s", 6, 5, 5)],
    protection, "task, ratio, status", [(1, 0.25, "HEALTHY"), (2, 0.2, "HEALTHY"), (3, 0.1667, "WARNING"), (4, 0.1429, "WARNING"), (5, 0.125, "ALERT"), (6, 0.4615, "HEALTHY")], "ratio",
)
_SOURCES = [
    ("a.ts", "typescript", "import x\nexport default function main() {\n  run()\n}\nexport const go = async (a) => a\nclass A {\n  private async step(n) {\n  }\n}"),
    ("b.py", "python", "def f(a):\n    return a\n\nasync def _g():\n    pass\nclass C:\n    def m(self):\n        pass"), ("c.go", "go", "func (s *S) Run() {}\nfunc Open() {}\nfunc shut() {}"),
    ("d.rs", "rust", "pub async fn open() {}\nfn shut() {}\n    fn inner() {}"), ("E.java", "java", "class E {\n  public static int sum(int a) { }\n  private void hide() { }\n}"), ("f.rb", "ruby", "def ok?\nend\ndef self.make\nend"), ("g.txt", None, "def f(a):"), ("h.py", "python", None),
]
_DEFINED = [
    ("a.ts", "main", 2, 4, 3, "default"), ("a.ts", "go", 5, 6, 2, "named"), ("a.ts", "step", 7, 9, 3, "method"), ("b.py", "f", 1, 3, 3, "module_level"), ("b.py", "_g", 4, 6, 3, "internal"), ("b.py", "m", 7, 8, 2, "method"),
    ("c.go", "Run", 1, 1, 1, "method"), ("c.go", "Open", 2, 2, 1, "named"), ("c.go", "shut", 3, 3, 1, "internal"), ("d.rs", "open", 1, 1, 1, "named"), ("d.rs", "shut", 2, 2, 1, "internal"), ("d.rs", "inner", 3, 3, 1, "method"),
    ("E.java", "sum", 2, 2, 1, "named"), ("E.java", "hide", 3, 4, 2, "internal"), ("f.rb", "ok?", 1, 2, 2, "internal"), ("f.rb", "make", 3, 4, 2, "internal"),
]
_FILES = "path string, language string, content string"
cases("fn_18_definitions", _FILES, _SOURCES, lambda f: definitions(f).select("path", "name", "line", "end_line", "body_lines"), "path, name, line, end_line, body_lines", [d[:5] for d in _DEFINED])
cases("fn_20_export_type", _FILES, _SOURCES, lambda f: definitions(f).select("path", "name", "export_type"), "path, name, export_type", [(d[0], d[1], d[5]) for d in _DEFINED])
cases(
    "flt_17_phase_gates", "gate int, status string, least string, field string, open int, asks_ledger boolean, in_ledger boolean",
    [(1, "final", "ready", "x", 0, False, False), (2, "active", "ready", "x", 0, False, False), (3, "partial", "ready", "x", 0, False, False), (4, "odd", "partial", "x", 0, False, False), (5, None, "partial", "x", 0, False, False), (6, "final", "final", "", 0, False, False), (7, "final", "final", "x", 1, False, False), (8, "final", "final", "x", 0, True, False), (9, "final", "final", "x", 0, True, True)],
    gates, "gate, passed", [(k, k in (1, 2, 9)) for k in range(1, 10)],
)
_HASH = "87428fc522803d31065e7bce3cf03fe475096631e5e07bbd7a0fde60c4cf25c7"  # of "a\n"
cases(
    "flt_22_review_results", "review int, verdict string", [(1, "PASS"), (2, "PASS"), (3, "MAYBE"), (4, "FAIL"), (5, "PASS")],
    lambda r: review_problems(
        r, r.sparkSession.createDataFrame([(1, "a", 1, _HASH), (2, "a", 2, _HASH), (3, "b", 1, _HASH), (4, "a", 0, _HASH), (4, "a", 1, "00")], "review int, path string, line int, claimed string"), r.sparkSession.createDataFrame([("a", "a\n")], "path string, content string"),
        r.sparkSession.createDataFrame([(5, "CRITICAL", "UNRESOLVED"), (1, "MATERIAL", "RESOLVED"), (1, "MINOR", "UNRESOLVED"), (4, "CRITICAL", "UNRESOLVED")], "review int, severity string, disposition string"),
    ),
    "review, problem", [(2, "outside"), (3, "untracked"), (3, "verdict"), (4, "line"), (4, "hash"), (5, "unresolved")],
)
cases("agg_38_noise_bands", "bead int, one array<string>, two array<string>", [(1, list("abcde"), list("abcde")), (2, list("abcde"), list("abcd")), (3, list("ab"), list("a")), (4, list("abc"), list("ad")), (5, [], [])], noise_band, "bead, overlap, noise", [(1, 100.0, "LOW"), (2, 80.0, "MODERATE"), (3, 50.0, "MODERATE"), (4, 25.0, "HIGH"), (5, 100.0, "LOW")], "overlap")
cases(
    "snk_04_report", "a int, b int, composite double, n int, confidence string, clone_type string, action string",
    [(1, 2, 0.9, 3, "HIGH", "Type 1 (exact clone)", "CONSOLIDATE"), (3, 4, 0.95, 2, "HIGH", "Type 2 (renamed clone)", "CONSOLIDATE"), (5, 6, 0.4, 1, "LOW", "Type 2 (renamed clone)", "REVIEW")],
    report, "section, rank, line",
    [(0, 0, "# Duplicate functions"), (1, 0, "| Metric | Value |"), (2, 0, "| Pairs | 3 |"), (2, 1, "| Several signals | 2 |"), (2, 2, "| Three signals or more | 1 |"), (3, 0, "| Clone type | Count |"), (4, 1, "| Type 2 (renamed clone) | 2 |"), (4, 2, "| Type 1 (exact clone) | 1 |"),
     (10, 0, "## HIGH"), (11, 1, "- 3 and 4: 0.95 by 2, consolidate"), (11, 2, "- 1 and 2: 0.9 by 3, consolidate"), (20, 0, "## MEDIUM"), (30, 0, "## LOW"), (31, 1, "- 5 and 6: 0.4 by 1, review")],
)
cases("fn_29_strict_json", "id int, text string", [(1, '{"b": 1, "a": [2]}'), (2, '{"a": 1, "a": 2}'), (3, "[[[[[[[[[1]]]]]]]]]"), (4, "[[[[[[[[1]]]]]]]]"), (5, "NaN"), (6, None), (7, "{"), (8, '{"a": {"c": 1, "b": "x"}}'), (9, '"' + "x" * 100_000 + '"')], U.strict, "id, valid, reason, canonical",
      [(1, True, None, '{"a":[2],"b":1}'), (2, False, "duplicate", None), (3, False, "depth", None), (4, True, None, "[[[[[[[[1]]]]]]]]"), (5, False, "number", None), (6, False, "length", None), (7, False, "syntax", None), (8, True, None, '{"a":{"b":"x","c":1}}'), (9, False, "length", None)])
cases("fn_30_json_subset", "id int, want string, have string", [(1, '{"a": {"b": 1}}', '{"a": {"b": 1, "c": 2}, "d": 3}'), (2, '{"a": [1]}', '{"a": [1, 2]}'), (3, '{"a": 1}', '{"a": true}'), (4, "{}", "{}"), (5, '{"a": null}', "{}"), (6, "[1]", "[1]"), (7, '{"a": 1}', "[1]")], U.subset, "id, held", [(1, True), (2, False), (3, False), (4, True), (5, False), (6, True), (7, False)])


def plain(rows) -> list[str]:
    def one(x):
        return None if x is None else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    return sorted(str([one(x) for x in row]) for row in rows)


@pytest.mark.parametrize("name", sorted(CASES))
def test_rule_by_hand(spark, name):
    columns, rows, rule, expected, want = CASES[name]
    got = rule(spark.createDataFrame(rows, columns))
    assert sorted(got.columns) == sorted(expected)
    assert plain(tuple(r[c] for c in expected) for r in got.collect()) == plain(want)
