"""Incremental secret scan over content-addressed blobs, with DataFrame and SQL functions only.

Every version of every path is addressed by the SHA-256 of its text.  The ledger holds one row for each blob and
rule version that has been scanned; a scan reads only blobs for which that pair is unseen, each once however many
paths or versions hold it, and findings are joined back to all paths.

Defined results: a null text is the empty blob; repeated rows are repeated paths and each gets its findings; spans of equal
start come in the order of ``RULES``; a long text is matched in one task; an empty table gives an empty result; other
columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise

RULE_VERSION = "2"
#: (kind, pattern, tested group, least characters of that group): leftmost non-overlapping matches per kind;
#: those whose tested group is shorter are dropped.  The first three are the base rules.
RULES = (
    ("assign", """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
)
BASE_KINDS = ("assign", "access", "hex")
_NONE = "cast(array() AS array<struct<start:int,kind:int,end:int>>)"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hits(kind: int, text: str) -> str:
    """Structs (gap, len, tested) of one rule: each match with the text before it; the last one is the rest of the text."""
    _, pattern, group, _ = RULES[kind]
    p = _literal(pattern)
    return f"""
    CASE WHEN NOT ({text} rlike {p}) THEN cast(array() AS array<struct<gap:int,len:int,tested:int>>) ELSE
    zip_with(split({text}, {p}, -1), zip_with(regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group}), (m, t) -> named_struct('len', length(m), 'tested', length(t))),
      (g, m) -> named_struct('gap', length(g), 'len', m.len, 'tested', m.tested)) END"""


def scan_text(blobs: DataFrame, text: str = "text") -> DataFrame:
    """(blob, found): the spans of all rules by start, then by rule; code points, end exclusive.

    Matches and the parts between them are rows, and sums over them are positions, so a text with very many matches
    costs a sort of them; only blobs with a match are shuffled, without their text.
    """
    hits = materialise(blobs.select("blob", F.array(*[F.expr(_hits(k, f"`{text}`")) for k in range(len(RULES))]).alias("hits")), "secret-hits")
    rows = hits.select("blob", F.posexplode("hits").alias("kind", "own")).select("blob", "kind", F.posexplode("own").alias("k", "h")).repartition("blob")
    before = Window.partitionBy("blob", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.coalesce(F.sum(F.col("h.gap") + F.coalesce("h.len", F.lit(0))).over(before), F.lit(0)) + F.col("h.gap")).cast("int")
    least = F.array(*[F.lit(r[3]) for r in RULES])[F.col("kind")]
    spans = rows.select("blob", "kind", "h", start.alias("start")).where(F.col("h.tested") >= least).select("blob", F.struct("start", "kind", (F.col("start") + F.col("h.len")).alias("end")).alias("span"))
    found = spans.groupBy("blob").agg(F.array_sort(F.collect_list("span")).alias("found"))
    return hits.select("blob").join(found, "blob", "left").select("blob", F.coalesce("found", F.expr(_NONE)).alias("found"))


def address(versions: DataFrame, text: str = "text") -> DataFrame:
    """``versions`` with ``blob``, the SHA-256 of the text."""
    return versions.withColumn(text, F.coalesce(F.col(f"`{text}`"), F.lit(""))).withColumn("blob", F.unhex(F.sha2(F.col(f"`{text}`").cast("binary"), 256)))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """New ledger rows (blob, rule_version, found) for the blobs of ``versions`` whose pair is not in ``ledger``."""
    blobs = address(versions, text).groupBy("blob").agg(F.first(F.col(f"`{text}`")).alias(text))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob")
        blobs = blobs.join(seen, "blob", "left_anti")
    return scan_text(blobs, text).select("blob", F.lit(rule_version).alias("rule_version"), "found")


def findings_by_path(paths: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """``paths`` (with ``blob``) and ``found``; only blobs with findings travel, and the join is one that Spark can split."""
    hits = ledger.where((F.col("rule_version") == rule_version) & (F.size("found") > 0)).select("blob", "found")
    return paths.join(hits, "blob", "left").withColumn("found", F.coalesce("found", F.expr(_NONE)))


def digest(found: str = "found") -> list:
    """Counts and joined spans of ``found``."""
    names = ", ".join(f"'{r[0]}'" for r in RULES)
    joined = f"array_join(transform({{0}}, s -> concat_ws(':', array({names})[s.kind], s.start, s.end)), ',')"
    base = f"filter({found}, s -> s.kind < {len(BASE_KINDS)})"
    return [
        *[F.expr(f"cast(size(filter({found}, s -> s.kind = {k})) AS bigint)").alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)],
        F.sha2(F.expr(joined.format(base)).cast("binary"), 256).alias("base_sha256"),
        F.expr(joined.format(found)).alias("spans"),
    ]


def scan(versions: DataFrame, path: str = "doc_id", text: str = "text", ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings by path, ledger with the new rows).  Append the second's new rows to a stored ledger to keep it."""
    columns = versions.select(path, text)
    fresh = materialise(scan_unseen(columns, ledger, text), "secret-ledger")
    whole = fresh if ledger is None else ledger.select(*fresh.columns).unionByName(fresh)
    paths = address(columns, text).select(path, "blob")
    return findings_by_path(paths, whole), whole
