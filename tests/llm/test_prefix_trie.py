"""Prefix tries against plain dictionaries of prefixes."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import prefix_trie as T
from tessera.llm.q_conversations import rebuilt

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain(rows: list[tuple], splice: bool) -> list[tuple]:
    """Every prefix of every conversation in a dictionary; subtrees by looking at all nodes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    if splice:
        heads = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        own = {c: own.get(int(c / 20) * 20, [])[: heads[c]] + v[heads[c] :] for c, v in own.items()}
    members = defaultdict(list)
    for c, v in own.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    out = []
    for p, convs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        leaf = lambda q: not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in members)
        words = lambda q: len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(own[c]) == len(p)))
        out.append((
            min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), sum(len(q) == len(p) + 1 for q in under), sum(map(leaf, under)),
            sum((len(members[q]) - 1) * words(q) for q in under), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def talk(seed: int, convs: int, branches: int, most: int) -> list[tuple]:
    """Conversations over few turns, so that prefixes are shared; copies, nulls, ties, repeated rows and gaps in between."""
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        if c % 7 == 3:
            continue
        for turn in range(rng.randint(1, most)):
            k = rng.randrange(branches)
            rows.append((c, turn if k else None, rng.choice(["user", "assistant", None]) if k == 1 else "user", rng.choice(["", None, "a  b\tc"]) if k == 2 else f"text {k}\n of turn"))
        if c % 5 == 0:
            rows += [(c, 1, "user", "tied"), (c, 1, "user", "tied"), (c, 1, "system", "tied too")]
    rows += [(700 + c, t, "user", f"copy {t}") for c in range(40) for t in range(5)]
    return rows + [(None, 0, "user", "nobody's"), (-20, 0, "user", "text 1\n of turn"), (-3, 5, "user", "minus")]


def found(spark, rows, splice=True):
    seqs = T.sequences(spark.createDataFrame(rows, SCHEMA))
    out = T.trie(rebuilt(seqs) if splice else seqs)
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[c] for c in columns) for r in out.collect()), key=str)


@pytest.mark.parametrize(("seed", "convs", "branches", "most", "least", "block", "stretch"), [(1, 60, 3, 6, 4096, 1 << 19, 1 << 16), (2, 90, 4, 5, 6, 40, 7), (3, 40, 2, 9, 3, 1, 1)])
def test_equals_plain_reading(spark, monkeypatch, seed, convs, branches, most, least, block, stretch):
    """At any share of a heavy prefix, size of a block and length of a stretch of ids."""
    monkeypatch.setattr(T, "LEAST", least)
    monkeypatch.setattr(T, "SHARE", 0.001)
    monkeypatch.setattr(T, "BLOCK", block)
    monkeypatch.setattr(T, "STRETCH", stretch)
    rows = talk(seed, convs, branches, most)
    assert found(spark, rows) == plain(rows, True)


def test_without_rebuilding_and_by_shuffled_upper_nodes(spark, monkeypatch):
    monkeypatch.setattr(T, "LEAST", 5)
    monkeypatch.setattr(T, "SHARE", 0.001)
    monkeypatch.setattr(T, "FEW", 0)
    rows = talk(5, 50, 3, 6)
    assert found(spark, rows, splice=False) == plain(rows, False)


def test_edges(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []
    # conversation 23 has one turn, takes three from the absent 20, and is left with none
    only = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    assert found(spark, [(only, 0, "user", "gone")]) == [(only, 0, None, 1, 0, 1, 0, hashlib.sha256(str(only).encode()).hexdigest())]
    long = [(20, t, "user", f"turn {t}") for t in range(3000)]
    got = found(spark, long)
    assert len(got) == 3001 and all(r[3] == 1 and r[5] == 1 and r[6] == 0 for r in got)
    extra = spark.createDataFrame([(1, 0, "u", "t", "x")], SCHEMA + ", labels string")
    assert T.trie(T.sequences(extra)).count() == 2


def test_louds_of_a_random_tree():
    rng = random.Random(4)
    degrees, open_ = [3], 3
    while open_:
        d = rng.choice([0, 0, 1, 2, 3]) if len(degrees) < 200 else 0
        degrees.append(d)
        open_ += d - 1
    trie = T.Louds(np.array(degrees))
    assert trie.degrees().tolist() == degrees
    assert trie.parents().tolist() == [v for v, d in enumerate(degrees) for _ in range(d)]


def test_digests_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(T, "STRETCH", 100)
    ids = list(range(-50, 5000))
    pairs = spark.createDataFrame([(b"hot" if k % 3 else b"k%d" % (k % 7), k) for k in ids], "key binary, id bigint")
    got = {bytes(r["key"]): (r["first"], r["n"], r["sha"]) for r in T.digests(pairs).collect()}
    for key in got:
        own = [k for k in ids if (b"hot" if k % 3 else b"k%d" % (k % 7)) == key]
        assert got[key] == (own[0], len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest())
