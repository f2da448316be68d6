"""A synthetic catalog with its truth: clones of four types and decoys, from a seed."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

from . import samples

_NODES = "FunctionDef arguments arg Assign Name Call Attribute For If Compare Constant Return Expr While BinOp AugAssign Try Raise With Subscript List Dict".split()
_VERBS, _NOUNS = "load read parse count merge sort check build send render".split(), "user order item file report queue token event batch page".split()


def generated(spark: SparkSession, seed: int = 42, pairs: int = 10, decoys: int = 10) -> tuple[DataFrame, DataFrame]:
    """(catalog, truth): ``pairs`` of each type, type 2 renamed, type 3 with statements changed, type 4 rewritten."""
    rng = random.Random(seed)
    rows, truth = [], []

    def add(name: str, tokens: list[str], params: list[tuple], kind: str) -> int:
        k = len(rows)
        rows.append((k, f"m{k}.py", name, name, 1, 12, 12, params, kind, 3, None, tokens))
        return k

    def name() -> str:
        return rng.choice(_VERBS) + rng.choice(_NOUNS).title() + rng.choice(_NOUNS).title()

    for clone_type in (1, 2, 3, 4):
        for _ in range(pairs):
            tokens = ["FunctionDef", *[rng.choice(_NODES) for _ in range(rng.randint(25, 40))]]
            params = [(rng.choice(_NOUNS), "str", False)]
            first = name()
            a = add(first, tokens, params, "list")
            other = list(tokens)
            if clone_type == 3:
                other[len(other) // 2 : len(other) // 2] = ["If", "Compare", "Continue"]
            elif clone_type == 4:
                other = ["FunctionDef", *[rng.choice(_NODES) for _ in range(len(tokens) - 1)]]
            b = add(first if clone_type in (1, 4) else first.replace(first[:2], "do", 1), other, params, "list")
            truth.append((a, b, clone_type, True))
    for _ in range(decoys):
        k = add(name(), ["FunctionDef", *[rng.choice(_NODES) for _ in range(rng.randint(25, 40))]], [(rng.choice(_NOUNS), rng.choice(["int", "dict"]), False)], rng.choice(["int", "dict"]))
        truth.append((0, k, None, False))
    return spark.createDataFrame(rows, samples.CATALOG), spark.createDataFrame(truth, "a bigint, b bigint, clone_type int, is_clone boolean")
