"""Operators that Catalyst expressions cannot say: sequence alignment, edit ratio, source trees, strict JSON, lifecycles.

All run on Arrow batches, and only on rows that cheap joins have let through.
"""

from __future__ import annotations

import ast
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.names import lcs_length
from tessera.operators import strategies_sql as oracle
from tessera.plans.dialect import REGISTRY


def _lcs(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([2.0 * lcs_length(x, y) / (len(x) + len(y)) if x or y else 0.0 for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


_FUNCTIONS = "file string, name string, line int, end_line int, n_params int, complexity int, docstring string, export_type string, fingerprint string"


#: Characters of a source that are parsed at a time, and the lines at which one may be cut.
PIECE = 1 << 18
_TOP = re.compile(r"^(?:def|class|async|@)", re.MULTILINE)


def trees_of(source: str) -> Iterator[tuple[int, ast.Module]]:
    """(lines before, tree) of the pieces of a source; an error if any does not parse.

    A source is cut before a definition at its left edge.  A piece that ends within a string, a bracket or a decorated definition does not
    parse, and ends at a later definition, each time further on.
    """
    source = source.replace("\r\n", "\n").replace("\r", "\n")
    start, lines, size, step = 0, 0, PIECE, 1
    while start < len(source):
        cut = _TOP.search(source, start + size)
        end = cut.start() if cut else len(source)
        try:
            tree = ast.parse(source[start:end])
        except SyntaxError:
            if end == len(source):
                raise
            size, step = end - start + step, 2 * step
            continue
        yield lines, tree
        lines += source.count("\n", start, end)
        start, size, step = end, PIECE, 1


def functions_of(path: str, source: str | None) -> Iterator[tuple]:
    """One row per Python function; names are renamed in order of appearance for the fingerprint.

    A source of several pieces is parsed twice: it gives no row unless all of it parses.
    """
    source = source or ""
    try:
        if len(source) > PIECE:
            for _ in trees_of(source):
                pass
        for lines, tree in trees_of(source):
            yield from _functions_in(path, tree, lines)
    except (SyntaxError, ValueError):
        return


def _functions_in(path: str, tree: ast.Module, lines: int) -> Iterator[tuple]:
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            names: dict[str, str] = {}
            kinds = []
            complexity = 1
            for inner in ast.walk(node):
                kinds.append(type(inner).__name__)
                if isinstance(inner, (ast.Name, ast.arg)):
                    own = inner.id if isinstance(inner, ast.Name) else inner.arg
                    kinds.append(names.setdefault(own, f"_v{len(names)}"))
                if isinstance(inner, (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension)):
                    complexity += 1
                elif isinstance(inner, ast.BoolOp):
                    complexity += len(inner.values) - 1
            export = "private" if node.name.startswith("_") else "public"
            arguments = node.args
            n = len(arguments.args) + len(arguments.posonlyargs) + len(arguments.kwonlyargs)
            yield path, node.name, lines + node.lineno, lines + node.end_lineno, n, complexity, ast.get_docstring(node), export, hashlib.sha256(" ".join(kinds).encode()).hexdigest()


def extract_functions(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """The functions in a table of Python sources; sources that do not parse give none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _FUNCTIONS.split(", ")]
        for frame in frames:
            found = (r for p, s in zip(frame["path"], frame["content"]) for r in functions_of(p, s))
            for rows in itertools.batched(found, 10_000):
                yield pd.DataFrame(rows, columns=columns)

    return files.select(F.col(path).alias("path"), F.col(content).cast("string").alias("content")).mapInPandas(run, _FUNCTIONS)


def strict_json(text: str | None, depth: int = 8, length: int = 100_000) -> tuple[bool, str | None, str | None]:
    """(valid, reason, canonical form): duplicate keys, deep nesting, non-finite numbers and long inputs are refused."""
    if text is None or len(text) > length:
        return False, "length", None

    def pairs(items: list) -> dict:
        keys = [k for k, _ in items]
        if len(set(keys)) != len(keys):
            raise KeyError("duplicate")
        return dict(items)

    def refuse(name: str):
        raise OverflowError(name)

    def level(x) -> int:
        return 1 + max((level(y) for y in (x.values() if isinstance(x, dict) else x)), default=0) if isinstance(x, (dict, list)) else 0

    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_constant=refuse)
    except KeyError:
        return False, "duplicate", None
    except OverflowError:
        return False, "number", None
    except (ValueError, RecursionError):
        return False, "syntax", None
    if level(value) > depth:
        return False, "depth", None
    return True, None, json.dumps(value, sort_keys=True, separators=(",", ":"))


def is_subset(want, have) -> bool:
    """Objects are compared key by key, everything else by equality."""
    if isinstance(want, dict):
        return isinstance(have, dict) and all(k in have and is_subset(v, have[k]) for k, v in want.items())
    return type(want) is type(have) and want == have


def _strict(texts: pa.Array) -> pa.Array:
    rows = [strict_json(t) for t in texts.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["valid", "reason", "canonical"])


def strict(texts: DataFrame) -> DataFrame:
    """(id, valid, reason, canonical) of texts (id, text)."""
    return texts.select("id", F.arrow_udf(_strict, "struct<valid: boolean, reason: string, canonical: string>")("text").alias("r")).select("id", "r.valid", "r.reason", "r.canonical")


def subset(pairs: DataFrame) -> DataFrame:
    """(id, held) of pairs of JSON texts (id, want, have): whether all that is wanted is had."""

    def held(want: pa.Array, have: pa.Array) -> pa.Array:
        return pa.array([is_subset(json.loads(x), json.loads(y)) for x, y in zip(want.to_pylist(), have.to_pylist())])

    return pairs.select("id", F.arrow_udf(held, "boolean")("want", "have").alias("held"))


@REGISTRY.frame("fn_12_lcs", oracle.TURNS)
def lcs(spark: SparkSession, folder: str) -> DataFrame:
    """LCS similarity of consecutive turns' words."""
    turns = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", F.split("text", "[ \\t\\n\\r]+").alias("w"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(F.arrow_udf(_lcs, "double")("w", "v"), 4).alias("lcs"))
