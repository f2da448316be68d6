"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND.

Passages are windows of a document's words, twice ``stride`` long and ``stride`` apart, where ``stride`` is at least
the longest item, so that some passage holds any item whole.  Postings hold BM25 weights divided by the item's score
for itself, so one threshold serves all items.  Of every passage all items at or above the threshold are retrieved,
then verified: the passage must hold enough of the question's word triples and of the answer's words, or enough of the
item's triples as a whole, so that an item without its last sentence is found too.

The search skips what cannot reach the threshold, never what can: words are split into common and essential ones so
that no item reaches half the threshold on common words alone; a passage whose essential words' greatest weights sum
below the other half, or whose words' block maxima stay below the threshold in every block of items, is passed over
(bounds for all passages of a batch at once); the rest go through WAND with per-block maxima.

Items are dealt by hash into shards of about ``MAX_INDEX_BYTES`` of text (one shard for a small benchmark), with lengths
and document frequencies over all items, so that a score does not depend on the shards.  One shard's index at a time is
built and broadcast, and every document is searched against each.

Defined results: null or wordless texts and items match nothing; repeated rows match alike; an empty table gives an
empty result; a row without doc_id is searched too; every distinct text of an item_id, null included, is an item of its
own and reported under that item_id; of equal scores for one item the first passage is reported; a long text is searched
in one task, passage by passage; other columns are passed over or, in ``filter_documents``, kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices

K1, B = 1.2, 0.75
THRESHOLD = 0.5
QUESTION_OVERLAP, ANSWER_OVERLAP, ITEM_OVERLAP = 0.5, 0.5, 0.6
MIN_STRIDE = 32
BLOCK = 16
ITEM_BLOCK = 2
MAX_INDEX_BYTES = 8 << 20
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.?!]\s+|\n")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence is the answer; without a sentence end before it, the last quarter of the words is."""
    cut = max((m.end() for m in _SENTENCE.finditer(text.rstrip())), default=0)
    question, answer = words_of(text[:cut]), words_of(text[cut:])
    if not question or not answer:
        both = question + answer
        at = max(1, len(both) - max(1, len(both) // 4)) if len(both) > 1 else len(both)
        question, answer = both[:at], both[at:]
    return question, answer


def triples(words: list[str]) -> set[tuple[str, ...]]:
    n = min(3, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def overlaps(passage: list[str], question: list[str], answer: list[str]) -> tuple[float, float, float]:
    """Shares of the question's triples, the answer's words and the item's triples that the passage has; an empty part is had."""
    want = triples(question)
    n = min(3, len(question))
    have = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)} if n else set()
    q = len(want & have) / len(want) if want else 1.0
    a = set(answer)
    both = triples(question + answer)
    return q, (len(a & set(passage)) / len(a) if a else 1.0), len(both & triples(passage)) / len(both) if len(passage) > 2 and both else 0.0


class Index:
    """Inverted index of items: postings by item number in blocks of ``BLOCK``, each with its greatest weight."""

    def __init__(self, items: list[tuple[int | None, str]], frequency: dict[str, int] | None = None, n_items: int | None = None, mean_length: float | None = None, stride: int | None = None):
        items = sorted(((i, t) for i, t in items if words_of(t)), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        bags = [Counter(words_of(t)) for _, t in items]
        self.ids = [i for i, _ in items]
        self.parts = [question_and_answer(t) for _, t in items]
        lengths = [sum(b.values()) for b in bags]
        n = n_items if n_items is not None else len(items)
        mean = mean_length if mean_length is not None else sum(lengths) / max(1, len(lengths))
        df = frequency if frequency is not None else Counter(w for b in bags for w in b)
        self.stride = stride if stride is not None else max([MIN_STRIDE, *lengths])
        weights = []
        for bag, length in zip(bags, lengths):
            own = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * length / mean)) for w, c in bag.items()}
            whole = sum(own.values())
            weights.append({w: v / whole for w, v in own.items()})
        self.terms: dict[str, int] = {w: k for k, w in enumerate(sorted({w for b in bags for w in b}))}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for k, own in enumerate(weights):
            for w, v in own.items():
                postings[self.terms[w]].append((k, v))
        self.items = [[k for k, _ in p] for p in postings]
        self.weights = [[v for _, v in p] for p in postings]
        self.block_max = [[max(v[a : a + BLOCK]) for a in range(0, len(v), BLOCK)] for v in self.weights]
        self.most = np.array([max(v) for v in self.weights] + [0.0])
        # Common words: the most frequent first, as long as no item gathers half the threshold from them.
        gathered = np.zeros(len(items))
        essential = np.ones(len(self.terms) + 1, dtype=bool)
        for k in sorted(range(len(self.terms)), key=lambda k: (-len(self.items[k]), k)):
            after = gathered[self.items[k]] + self.weights[k]
            if after.max() < THRESHOLD / 2:
                gathered[self.items[k]] = after
                essential[k] = False
        self.essential_most = np.where(essential, self.most, 0.0)
        self._block_bounds()

    def search(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All (item number, score) with score >= threshold for a set of terms: WAND with block maxima."""
        cursors = [[self.items[t][0], 0, t] for t in terms]
        out = []
        slack = threshold - 1e-9
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.most[c[2]]
                if bound >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block_bound = 0.0
            ends = []
            for c in cursors[: pivot + 1]:
                at = self._seek(c[2], c[1], item)
                if at < len(self.items[c[2]]):
                    block_bound += self.block_max[c[2]][at // BLOCK]
                    ends.append(self.items[c[2]][min(len(self.items[c[2]]), (at // BLOCK + 1) * BLOCK) - 1] + 1)
            if block_bound < slack:
                to = min(ends) if ends else item + 1
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                self._advance(cursors, pivot, max(to, item + 1))
                continue
            if cursors[0][0] == item:
                score = sum(self.weights[c[2]][c[1]] for c in cursors[: pivot + 1])
                if score >= slack:
                    out.append((item, float(score)))
                self._advance(cursors, pivot, item + 1)
            else:
                self._advance(cursors, pivot, item)
        return out

    def _seek(self, term: int, at: int, item: int) -> int:
        own = self.items[term]
        while at < len(own) and own[at] < item:
            end = (at // BLOCK + 1) * BLOCK
            at = end if end < len(own) and own[end - 1] < item else at + 1
        return at

    def _advance(self, cursors: list, pivot: int, item: int) -> None:
        for c in cursors[: pivot + 1]:
            if c[0] < item:
                c[1] = self._seek(c[2], c[1], item)
                c[0] = self.items[c[2]][c[1]] if c[1] < len(self.items[c[2]]) else -1
        cursors[:] = [c for c in cursors if c[0] >= 0]

    def _block_bounds(self) -> None:
        """Per term the greatest weight in each block of ``ITEM_BLOCK`` consecutive items, as runs of (block, weight)."""
        blocks, weights, at = [], [], [0]
        for own, values in zip(self.items, self.weights):
            most: dict[int, float] = {}
            for k, w in zip(own, values):
                most[k // ITEM_BLOCK] = max(w, most.get(k // ITEM_BLOCK, 0.0))
            blocks.extend(most)
            weights.extend(most.values())
            at.append(len(blocks))
        self.bound_block, self.bound_weight, self.bound_at = np.array(blocks, dtype=np.int64), np.array(weights), np.array(at, dtype=np.int64)
        self.n_blocks = len(self.ids) // ITEM_BLOCK + 1

    def open_passages(self, texts: list[list[str]]) -> list[tuple[int, int, np.ndarray]]:
        """(text number, first word, distinct terms) of the passages that could reach the threshold, of all texts at once.

        A passage stays if its essential words' greatest weights reach half the threshold and, for some block of items,
        the block maxima of its words reach the threshold.
        """
        none, stride = len(self.terms), self.stride
        known = self.terms
        lengths = np.array([len(w) for w in texts], dtype=np.int64)
        flat = np.fromiter((known.get(w, none) for words in texts for w in words), dtype=np.int64, count=int(lengths.sum()))
        counts = np.maximum(1, -(-(lengths - stride) // stride))
        base = np.cumsum(counts) - counts
        place = (np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)) // stride
        held = flat < none
        flat, place = flat[held], place[held]
        first, most = np.repeat(base, lengths)[held], np.repeat(counts, lengths)[held]
        here, before = place < most, place >= 1
        pair = np.unique(np.concatenate(((first + place)[here] * none + flat[here], (first + place - 1)[before] * none + flat[before])))
        passage, term = pair // none, pair % none
        if not len(pair):
            return []
        bound = np.bincount(passage, weights=self.essential_most[term])
        stay = bound[passage] >= THRESHOLD / 2 - 1e-9
        passage, term = passage[stay], term[stay]
        out = []
        edges = np.concatenate(([0], np.flatnonzero(np.diff(passage)) + 1, [len(passage)])) if len(passage) else np.zeros(1, dtype=np.int64)
        for a in range(0, len(edges) - 1, 512):
            own = edges[a : a + 513]
            part, number = term[own[0] : own[-1]], np.repeat(np.arange(len(own) - 1), np.diff(own))
            span = self.bound_at[part + 1] - self.bound_at[part]
            at = np.repeat(self.bound_at[part] - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
            sums = np.bincount(np.repeat(number, span) * self.n_blocks + self.bound_block[at], weights=self.bound_weight[at], minlength=(len(own) - 1) * self.n_blocks)
            for k in np.flatnonzero((sums.reshape(-1, self.n_blocks) >= THRESHOLD - 1e-9).any(axis=1)):
                which = int(passage[own[k]])
                text = int(np.searchsorted(base, which, side="right")) - 1
                out.append((text, (which - int(base[text])) * stride, term[own[k] : own[k + 1]]))
        return out

    def matches_of(self, texts: list[str | None]) -> list[list[tuple[int, float, float, float, int]]]:
        """Per text (item_id, score, question overlap, answer overlap, first word of the passage): the best passage per item."""
        words = [words_of(t) for t in texts]
        best: list[dict[int, tuple]] = [{} for _ in texts]
        if self.ids:
            for text, start, own in self.open_passages(words):
                passage = None
                for number, score in self.search(own.tolist()):
                    passage = passage or words[text][start : start + 2 * self.stride]
                    q, a, both = overlaps(passage, *self.parts[number])
                    if (q >= QUESTION_OVERLAP and a >= ANSWER_OVERLAP) or both >= ITEM_OVERLAP:
                        found = (round(score, 6), q, a, -start)
                        if number not in best[text] or found > best[text][number]:
                            best[text][number] = found
        return [[(self.ids[k], s, q, a, -at) for k, (s, q, a, at) in sorted(found.items())] for found in best]

    def matches(self, text: str | None) -> list[tuple[int, float, float, float, int]]:
        return self.matches_of([text])[0]


_SCHEMA = "doc bigint, item_id bigint, score double, question_overlap double, answer_overlap double, first_word bigint"


def _search(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        for batch in slices(batches):
            rows = [(doc, *m) for doc, own in zip(batch.column(0).to_pylist(), found.matches_of(batch.column(1).to_pylist())) for m in own]
            if rows:
                names = [c.split()[0] for c in _SCHEMA.split(", ")]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def _tokens(text: pa.Array) -> pa.Array:
    return pa.array([words_of(t) for t in text.to_pylist()], pa.list_(pa.string()))


def indexes(items: DataFrame, item_id: str = "item_id", text: str = "text", max_bytes: int = MAX_INDEX_BYTES) -> Iterator[Index]:
    """The shards' indexes, one at a time: each of about ``max_bytes`` of text, with counts over all items."""
    rows = items.select(F.col(f"`{item_id}`").cast("bigint").alias("item"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL").distinct()
    rows = rows.withColumn("tokens", F.arrow_udf(_tokens, "array<string>")("text")).where(F.size("tokens") > 0)
    size, n, mean, longest = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1)), F.avg(F.size("tokens")), F.max(F.size("tokens"))).first()
    shards = max(1, math.ceil((size or 0) / max_bytes))
    bags = rows.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(shards)))
    terms = bags.select("shard", F.explode(F.array_distinct("tokens")).alias("w"))
    frequency = terms.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    for k in range(shards):
        own = terms.where(F.col("shard") == k).select("w").distinct().join(frequency, "w").collect()
        texts = bags.where(F.col("shard") == k).select("item", "text").collect()
        yield Index([(r["item"], r["text"]) for r in texts], {r["w"]: r["df"] for r in own}, n, mean, max(MIN_STRIDE, longest or 0))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, item_id, score, question_overlap, answer_overlap, first_word): every verified match of every row."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text"))
    out = None
    for index in indexes(items):
        part = rows.mapInArrow(_search(context.broadcast(index)), _SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def filter_documents(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with no verified match."""
    context = docs.sparkSession.sparkContext
    out = docs
    for index in indexes(items):
        held = context.broadcast(index)

        @F.arrow_udf("boolean")
        def clean(texts: pa.Array) -> pa.Array:
            found = held.value
            cut = pa.RecordBatch.from_arrays([texts], names=["text"])
            return pa.array([not own for part in slices([cut]) for own in found.matches_of(part.column(0).to_pylist())], pa.bool_())

        out = out.where(clean(F.col(f"`{text}`")))
    return out
