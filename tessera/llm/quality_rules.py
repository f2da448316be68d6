"""Host-level quality rules, with DataFrame and SQL functions only.

Each text is measured once.  Every rule's failures are counted by host (``source``), a host's failure rate is
shrunk toward the corpus rate with an empirical beta prior (method of moments over hosts), and a host whose
shrunk rate of any rule exceeds ``max_rate`` is rejected; its verdict is joined back to its documents.

The prior's strength is held between ``PRIOR_MIN`` and ``PRIOR_MAX`` documents: with hosts that hardly vary the estimate
grows without bound (every host gets the corpus rate, however many documents speak against it), with hosts of rates 0 and
1 only it vanishes.

Defined results: a null text has no words and fails the base rule; a null source belongs to no host, so only the
document's own base rule counts; repeated rows count as often as they occur; a long text is one row's arrays (about forty
bytes a word); an empty table gives an empty result; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.75
#: The strength of the prior (alpha + beta, in documents) stays between these.
PRIOR_MIN, PRIOR_MAX = 2.0, 1000.0
RULES = ("short", "repeated", "symbols", "duplicate_lines", "word_length")
_SPACE = "[\\x20\\x09-\\x0D]+"


def _measures(text: str) -> list[Column]:
    """Arrays first, in a projection of their own: what follows refers to them, and Spark keeps them apart."""
    return [
        F.expr(f"filter(split({text}, '{_SPACE.replace(chr(92), chr(92) * 2)}', -1), w -> w != '')").alias("_q_words"),
        F.expr(f"filter(split({text}, '\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("_q_lines"),
        F.expr(f"length({text}) - length(translate({text}, '#*$%&|<>', ''))").cast("long").alias("n_symbols"),
    ]


#: Windows of three words as (hash, position), sorted; a window that equals a neighbour there occurs twice or more.
_SORTED = """
CASE WHEN size(_q_words) < 3 THEN array() ELSE
 sort_array(transform(sequence(0, size(_q_words) - 3), i -> struct(
   xxhash64(get(_q_words, i), get(_q_words, i + 1), get(_q_words, i + 2)) AS h, i AS i))) END
"""
_REPEATED = """
sort_array(transform(filter(_q_sorted, (x, j) -> (j > 0 AND get(_q_sorted, j - 1).h = x.h)
   OR coalesce(get(_q_sorted, j + 1).h = x.h, false)), x -> x.i))
"""
_COVERED = """
aggregate(_q_repeated, named_struct('last', -3, 'n', 0L),
  (a, p) -> named_struct('last', p, 'n', a.n + least(3, p - a.last)), a -> a.n)
"""


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` as c0, c1, ..., the counts and ``rules``, an array of failures in the order of ``RULES``.

    ``_q_row`` keeps the optimizer from pushing a filter that uses it below the counts, where the arrays would be built
    again for each of their elements.
    """
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    keep = [F.col(c) for c in inner.columns]
    body = f"coalesce(c{docs.columns.index(text)}, '')"
    first = inner.select(*keep, *_measures(body))
    second = first.select("*", F.expr(_SORTED.replace("array()", "cast(array() AS array<struct<h:bigint,i:int>>)")).alias("_q_sorted"))
    third = second.select("*", F.expr(_REPEATED).alias("_q_repeated"))
    counted = third.select(
        *keep,
        F.expr("cast(size(_q_words) AS bigint)").alias("n_words"),
        F.expr("aggregate(_q_words, 0L, (a, w) -> a + length(w))").alias("word_chars"),
        "n_symbols",
        F.expr("cast(size(_q_lines) - size(array_distinct(_q_lines)) AS bigint)").alias("n_dup_lines"),
        F.expr("cast(size(_q_lines) AS bigint)").alias("n_text_lines"),
        F.expr(_COVERED).alias("n_repeat_words"),
        F.monotonically_increasing_id().alias("_q_row"),
    )
    return counted.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")).withColumn(
        "rules",
        F.expr(f"""array(n_words < {MIN_WORDS}, 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words, 5 * n_symbols > n_words AND n_words > 0,
          2 * n_dup_lines > n_text_lines, n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words))"""),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_text_lines", "n_repeat_words", "base_failed", "rules")


def host_verdicts(measured: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: ``host``, ``n`` documents, ``rates`` shrunk by rule, ``host_rejected``.

    A host's documents are summed before the shuffle, so a host with a third of all rows costs one row per task.
    The prior comes from sums over hosts: mean m and weighted variance v of the rates give strength
    m (1 - m) / v - 1, held in [PRIOR_MIN, PRIOR_MAX]; alpha = m * strength.
    """
    n_rules = len(RULES)
    counts = (
        measured.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("rules")[k]).alias(f"f{k}") for k in range(n_rules)])
    )
    counts = materialise(counts, "quality-hosts")
    total = counts.agg(F.sum("n").alias("n"), *[F.sum(f"f{k}").alias(f"f{k}") for k in range(n_rules)], *[F.sum(F.col(f"f{k}").cast("double") * F.col(f"f{k}") / F.col("n")).alias(f"s{k}") for k in range(n_rules)])
    prior = total.select(
        F.array(
            *[
                F.expr(f"""named_struct('m', coalesce(f{k} / n, 0D), 'strength', CASE WHEN coalesce(s{k} / n - pow(f{k} / n, 2), 0D) <= 1e-12 THEN {PRIOR_MAX}D
                   ELSE greatest({PRIOR_MIN}D, least({PRIOR_MAX}D, (f{k} / n) * (1 - f{k} / n) / (s{k} / n - pow(f{k} / n, 2)) - 1)) END)""")
                for k in range(n_rules)
            ]
        ).alias("prior")
    )
    rated = counts.withColumn("_q_prior", prior.scalar()).withColumn(
        "rates",
        F.array(*[F.expr(f"(f{k} + _q_prior[{k}].m * _q_prior[{k}].strength) / (n + _q_prior[{k}].strength)") for k in range(n_rules)]),
    )
    return rated.select("host", "n", "rates", F.exists("rates", lambda r: r > max_rate).alias("host_rejected"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE, keep: list[str] | None = None, out: str = "quality") -> DataFrame:
    """The columns ``keep`` of ``docs`` (all if not given), then the struct ``out`` of the measures, host_rejected and kept.

    Rows are measured once; what is kept of them is written down between the two passes.
    """
    keep = docs.columns if keep is None else keep
    at = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    needed = dict.fromkeys([at[host], *[at[c] for c in keep]])
    measured = materialise(measure(docs, text).select(*needed, *MEASURES), "quality-measures")
    verdicts = host_verdicts(measured, at[host], max_rate).select(F.col("host").alias("_q_host"), F.col("host_rejected").alias("_q_rejected"))
    joined = measured.join(verdicts, F.col(at[host]) == F.col("_q_host"), "left").withColumn("host_rejected", F.coalesce("_q_rejected", F.lit(False)))
    joined = joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
    return joined.select(*[F.col(at[c]).alias(c) for c in keep], F.struct(*MEASURES, "host_rejected", "kept").alias(out))


def filter_documents(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``: the base rule's test, then the host's verdict.

    Rows are measured once; those that pass the base rule are written down whole, of the others only what hosts need.
    """
    at = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    passed = ~F.col("base_failed") & (F.col("_q_row") >= 0)
    whole = [F.when(passed, F.col(c)).alias(c) for c in at.values()]
    measured = materialise(measure(docs, text).select(*whole, F.col(at[host]).alias("_q_source"), "rules", "base_failed"), "quality-measures")
    verdicts = host_verdicts(measured, "_q_source", max_rate).where("host_rejected").select(F.col("host").alias("_q_host"))
    passed = measured.where(~F.col("base_failed")).join(verdicts, F.col("_q_source") == F.col("_q_host"), "left_anti")
    return passed.select(*[F.col(k).alias(c) for c, k in at.items()])
