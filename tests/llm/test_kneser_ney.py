"""The character models against plain dictionaries of n-grams."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np

from tessera.llm.language_id import ORDER, Model


def plain_scores(counts: dict[str, int], words: list[str]) -> list[float]:
    """Interpolated Kneser-Ney over ``^word$``: counts at the top order and for n-grams that begin a word, else left neighbours."""
    raw = [Counter() for _ in range(ORDER + 1)]
    for word, times in counts.items():
        s = "^" + word + "$"
        for i in range(1, len(s)):
            for n in range(1, ORDER + 1):
                if i >= n - 1:
                    raw[n][s[i - n + 1 : i + 1]] += times
    table: list[dict] = [{} for _ in range(ORDER + 1)]
    discount = [0.0] * (ORDER + 1)
    for n in range(1, ORDER + 1):
        left = Counter(g[1:] for g in raw[n + 1]) if n < ORDER else Counter()
        amount = {g: c if n == ORDER or g[0] == "^" else max(1, left[g]) for g, c in raw[n].items()}
        once, twice = (sum(a == k for a in amount.values()) for k in (1, 2))
        discount[n] = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
        table[n] = amount
    mass, kinds = [defaultdict(float) for _ in range(ORDER + 1)], [Counter() for _ in range(ORDER + 1)]
    for n in range(1, ORDER + 1):
        for g, a in table[n].items():
            mass[n][g[:-1]] += a
            kinds[n][g[:-1]] += 1
    out = []
    for word in words:
        s, total = "^" + word + "$", 0.0
        for i in range(1, len(s)):
            p = 1 / 2048
            for n in range(1, ORDER + 1):
                context = s[i - n + 1 : i]
                if i >= n - 1 and mass[n].get(context):
                    p = max(table[n].get(context + s[i], 0) - discount[n], 0) / mass[n][context] + discount[n] * kinds[n][context] / mass[n][context] * p
            total += math.log(max(p, 1e-12))
        out.append(total)
    return out


def test_probabilities_equal_plain_dictionaries():
    rng = random.Random(1)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 8)))
    counts = {"aa": Counter(word("abcde") for _ in range(400)), "bb": Counter(word("cdefgü") for _ in range(300)), "cc": Counter(["one", "two", "two"])}
    words = [word("abcdefgüz") for _ in range(200)] + ["one", "two", "x", "abcab"]
    got = Model(counts).score(words)
    for k, lang in enumerate(sorted(counts)):
        np.testing.assert_allclose(got[:, k], plain_scores(counts[lang], words), rtol=1e-9)


def test_ties_go_to_the_language_that_sorts_first():
    model = Model({"b": {"word": 3}, "a": {"word": 3}})
    scores = model.score(["word", "other"])
    assert model.languages == ["a", "b"] and (scores[:, 0] == scores[:, 1]).all()
