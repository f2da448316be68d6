"""Language identification with interpolated Kneser-Ney character models.

A text is its words: runs of letters, lower-cased.  Each language has one model of order ``ORDER`` over the characters
of a word with boundary marks; contexts stay within the word, so a word's log-probability is a property of the word
and each distinct word of a batch is scored once, whatever its count.  N-grams of all languages are 64-bit hashes in
one sorted array per order, with a column per language for the discounted probability and for the back-off weight.

A text gets the language of the lowest cross-entropy per character.  The score is the posterior over languages under
a temperature, fitted on labelled texts that the counts do not use; ``rejected`` marks texts whose cross-entropy lies
above nearly all (``REJECT_QUANTILE``) of that language's such texts, by a margin.

The models are fitted on a bounded sample: labelled rows whose hash falls below sample_per_language over the
language's row count, about ``SAMPLE`` rows of each (all rows of a smaller one), so the driver's part does not grow
with the corpus; prediction covers every row.

Defined results: a null text or one without a letter is ``und`` with score 0; rows with null lang are never learned
from; without any labelled row all texts are ``und``; equal entropies go to the language that sorts first; repeated
rows predict alike; superscripts, fractions and letter-like numerals are no letters; a long text is scored in one task, by
its distinct words; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix64, slices

ORDER = 5
SAMPLE = 1500
MAX_LANGUAGES = 1000
REJECT_QUANTILE, REJECT_MARGIN = 0.995, 0.5
_LETTERS = re.compile(r"[^\W\d_]+")
_START, _END = 2, 3
_MUL = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    words = _LETTERS.findall(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    return [part for w in words for part in "".join(c if c.isalpha() else " " for c in w).split()]  # superscripts, fractions, numerals


def grams(words: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(word number of each predicted character, hashes of its n-grams by order, whether such an n-gram exists there).

    Word w becomes START, its characters, END; an n-gram that would begin before START does not exist.
    """
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    span = sizes + 2
    ends = np.cumsum(span)
    flat = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    first = ends - span
    flat[first], flat[ends - 1] = _START, _END
    inner = np.ones(len(flat), dtype=bool)
    inner[first], inner[ends - 1] = False, False
    flat[inner] = codes
    place = np.arange(len(flat)) - np.repeat(first, span)
    predicted = np.flatnonzero(place > 0)
    word = np.repeat(np.arange(len(words)), span)[predicted]
    place = place[predicted]
    hashes, there = [], []
    value = np.zeros(len(predicted), dtype=np.uint64)
    for n in range(1, ORDER + 1):
        here = place >= n - 1
        back = np.where(here, predicted - (n - 1), 0)
        value = np.where(here, mix64(value * _MUL + flat[back] + np.uint64(n)), value)
        hashes.append(value)
        there.append(here)
    return word, hashes, there


def contexts(words: list[str]) -> list[np.ndarray]:
    """Hashes of the context of each predicted character by order: the n-gram without its last character."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    span = sizes + 1
    ends = np.cumsum(span)
    first = ends - span
    flat = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    inner = np.ones(len(flat), dtype=bool)
    inner[first] = False
    flat[first] = _START
    flat[inner] = codes
    place = np.arange(len(flat)) - np.repeat(first, span)
    at = np.arange(len(flat))
    value = np.zeros(len(flat), dtype=np.uint64)
    out = []
    for n in range(2, ORDER + 1):
        here = place >= n - 2
        value = np.where(here, mix64(value * _MUL + flat[np.where(here, at - (n - 2), 0)] + np.uint64(n + 64)), value)
        out.append(value)
    return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, whether there) of keys in a sorted array."""
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys


class Model:
    """Kneser-Ney models of several languages over word counts {language: {word: count}}."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.languages = sorted(counts)
        width = len(self.languages)
        parts: list[list] = [[] for _ in range(ORDER)]
        for k, lang in enumerate(self.languages):
            words = sorted(counts[lang])
            if not words:
                continue
            word, hashes, there = grams(words)
            ctx = contexts(words)
            weight = np.array([counts[lang][w] for w in words], dtype=np.float64)[word]
            for n in range(ORDER):
                here = there[n]
                keys, first, inverse = np.unique(hashes[n][here], return_index=True, return_inverse=True)
                total = np.bincount(inverse, weights=weight[here], minlength=len(keys))
                context = ctx[n - 1][here][first] if n else np.zeros(len(keys), dtype=np.uint64)
                shorter = hashes[n - 1][here][first] if n else None
                parts[n].append((k, keys, total, context, shorter))
                # n-grams that start a word have no left neighbour: they keep their counts below the top order
                starts = np.zeros(len(keys), dtype=bool)
                position = np.flatnonzero(here)[first]
                starts[:] = self._at_start(words, word, position, n + 1)
                parts[n][-1] += (starts,)
        self.keys, self.value, self.contexts, self.backoff = [], [], [], []
        for n in range(ORDER):
            all_keys = np.unique(np.concatenate([p[1] for p in parts[n]])) if parts[n] else np.empty(0, np.uint64)
            all_ctx = np.unique(np.concatenate([p[3] for p in parts[n]])) if parts[n] else np.empty(0, np.uint64)
            value, backoff = np.zeros((len(all_keys), width)), np.ones((len(all_ctx), width))
            for k, keys, total, context, _, starts in parts[n]:
                if n + 1 < ORDER:
                    higher = next(p for p in parts[n + 1] if p[0] == k)
                    unique, number = np.unique(higher[4], return_counts=True)
                    row, there = _find(unique, keys)
                    amount = np.where(starts, total, np.where(there, number[row] if len(unique) else 0, 0)).astype(np.float64)
                    amount = np.where(amount > 0, amount, 1.0)
                else:
                    amount = total
                once, twice = (amount == 1).sum(), (amount == 2).sum()
                discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
                group, inverse = np.unique(context, return_inverse=True)
                mass = np.bincount(inverse, weights=amount)
                kinds = np.bincount(inverse)
                value[np.searchsorted(all_keys, keys), k] = np.maximum(amount - discount, 0) / mass[inverse]
                backoff[np.searchsorted(all_ctx, group), k] = discount * kinds / mass
            self.keys.append(all_keys)
            self.value.append(value)
            self.contexts.append(all_ctx)
            self.backoff.append(backoff)
        self.floor = 1.0 / 2048
        self.temperature, self.limits = 1.0, np.full(width, np.inf)

    @staticmethod
    def _at_start(words: list[str], word: np.ndarray, position: np.ndarray, n: int) -> np.ndarray:
        first = np.concatenate(([0], np.flatnonzero(np.diff(word)) + 1)) if len(word) else np.empty(0, np.int64)
        offset = position - first[np.searchsorted(first, position, side="right") - 1] + 1
        return offset == n - 1

    def score(self, words: list[str]) -> np.ndarray:
        """Natural log-probability of each word in each language."""
        out = np.zeros((len(words), len(self.languages)))
        if not words:
            return out
        word, hashes, there = grams(words)
        ctx = contexts(words)
        row, seen = _find(self.keys[0], hashes[0])
        lone = self.backoff[0][0] if len(self.backoff[0]) else np.ones(len(self.languages))
        p = np.where(seen[:, None], self.value[0][row] if len(self.keys[0]) else 0.0, 0.0) + lone * self.floor
        for n in range(1, ORDER):
            at, known = _find(self.contexts[n], ctx[n - 1])
            known &= there[n]
            if not known.any():
                continue
            own = np.flatnonzero(known)
            row, seen = _find(self.keys[n], hashes[n][own])
            p[own] = np.where(seen[:, None], self.value[n][row], 0.0) + self.backoff[n][at[own]] * p[own]
        logs = np.log(np.maximum(p, 1e-12))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(word, weights=logs[:, k], minlength=len(words))
        return out

    def posterior(self, entropy: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of texts with cross-entropies by language; the evidence of a text levels off with its length."""
        logit = -entropy * self.temperature * np.sqrt(np.minimum(length, 400.0))[:, None]
        logit -= logit.max(axis=1, keepdims=True)
        odds = np.exp(logit)
        return odds / odds.sum(axis=1, keepdims=True)

    def calibrate(self, entropy: np.ndarray, length: np.ndarray, lang: list[str]) -> None:
        """Temperature of the highest likelihood, and each language's limit of cross-entropy."""
        truth = np.array([self.languages.index(x) for x in lang], dtype=np.int64)
        if not len(truth):
            return
        losses = []
        grid = np.exp2(np.arange(-4.0, 5.0, 0.5))
        for t in grid:
            self.temperature = t
            losses.append(-np.log(np.maximum(self.posterior(entropy, length)[np.arange(len(truth)), truth], 1e-9)).mean())
        self.temperature = float(grid[int(np.argmin(losses))])
        for k in range(len(self.languages)):
            own = entropy[truth == k, k]
            if len(own):
                self.limits[k] = np.quantile(own, REJECT_QUANTILE) + REJECT_MARGIN


class Scorer:
    """Cross-entropies of texts; keeps the scores of words that it has met, up to a bound."""

    LIMIT = 250_000

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.logs = np.empty((0, len(self.model.languages)))
        self.sizes = np.empty(0)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy by language, characters scored) of each text; zero characters where there is no letter."""
        if len(self.index) > self.LIMIT:
            self.reset()
        index, known = self.index, len(self.index)
        codes, counts = [], []
        for text in texts:
            words = words_of(text)
            counts.append(len(words))
            codes.extend([index.setdefault(w, len(index)) for w in words])
        fresh = list(index)[known:]
        if fresh:
            self.logs = np.concatenate((self.logs, self.model.score(fresh)))
            self.sizes = np.concatenate((self.sizes, [len(w) + 1.0 for w in fresh]))
        codes = np.array(codes, dtype=np.int64)
        cut = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        sums = np.concatenate((np.zeros((1, self.logs.shape[1])), np.cumsum(self.logs[codes], axis=0)))
        length = np.concatenate(([0.0], np.cumsum(self.sizes[codes])))
        length = np.diff(length[cut])
        entropy = -(sums[cut[1:]] - sums[cut[:-1]]) / np.maximum(length, 1.0)[:, None]
        return entropy, length


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        counts: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.update((lang, w) for w in words_of(text))
        if counts:
            lang, word = zip(*counts)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])


def fit(labelled: DataFrame, key: Column, sample_per_language: int = SAMPLE) -> Model:
    """A model of ``labelled`` (lang, text); ``key`` draws the sample and its calibration tenth."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").withColumn("_h", F.pmod(F.xxhash64(key), F.lit(1_000_003)))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Model({})
    spark = labelled.sparkSession
    bounds = spark.createDataFrame([(k, int(min(1.0, sample_per_language / n) * 1_000_003)) for k, n in sizes.items()], "lang string, _bound bigint")
    drawn = rows.join(F.broadcast(bounds), "lang").where("_h < _bound").withColumn("_fold", F.pmod(F.xxhash64("_h", F.lit(7)), F.lit(10)))
    counted = drawn.where("_fold > 0").select("lang", "text").mapInArrow(_word_counts, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {k: {} for k in sizes}
    for lang, word, n in zip(*(c.to_pylist() for c in counted.toArrow().columns)):
        counts[lang][word] = n
    model = Model({k: v for k, v in counts.items() if v})
    if not model.languages:
        return model
    held = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in slices(batches):
            entropy, length = scorer.entropies(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(length), pa.array(list(entropy), pa.list_(pa.float64()))], names=["lang", "length", "entropy"])

    tested = drawn.where("_fold = 0").select("lang", "text").mapInArrow(measure, "lang string, length double, entropy array<double>").where("length > 0").toArrow()
    known = [i for i, x in enumerate(tested.column(0).to_pylist()) if x in set(model.languages)]
    if known:
        model.calibrate(np.array(tested.column(2).to_pylist())[known], tested.column(1).to_numpy()[known], [tested.column(0)[i].as_py() for i in known])
    return model


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, lang_pred, score, entropy, rejected) for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        scorer = Scorer(own)
        names = np.array([*own.languages, "und"], dtype=object)
        for batch in slices(batches):
            n = batch.num_rows
            if own.languages:
                entropy, length = scorer.entropies(batch.column(1).to_pylist())
                best = entropy.argmin(axis=1)
                least = entropy[np.arange(n), best]
                score = own.posterior(entropy, length)[np.arange(n), best]
                rejected = least > own.limits[best]
                empty = length == 0
            else:
                best, least, score, rejected, empty = np.zeros(n, int), np.zeros(n), np.zeros(n), np.zeros(n, bool), np.ones(n, bool)
            lang = names[np.where(empty, len(own.languages), best)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang.tolist(), pa.string()), pa.array(np.where(empty, 0.0, np.clip(score, 0, 1))), pa.array(np.where(empty, np.nan, least), mask=empty), pa.array(rejected | empty)],
                names=["doc", "lang_pred", "score", "entropy", "rejected"],
            )

    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc bigint, lang_pred string, score double, entropy double, rejected boolean")
