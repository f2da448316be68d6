"""Token counts by rank-synchronous array merging of a byte-pair vocabulary with word ends.

A batch's distinct pre-tokens lie as one ragged numpy array of symbols.  Each round looks up the rank of every adjacent
pair, takes the lowest rank of each sequence, and merges all its occurrences in all sequences at once; a sequence
whose pairs have no rank is done, and its surviving symbols are its tokens.  Sequences above ``LONG`` symbols are kept as
linked arrays, where a round touches only the occurrences of one rank, so that a text of one endless word takes
time in proportion to its length.  Both give what merging one pair at a time, lowest rank and leftmost first, gives:
where a merged symbol could take part in a pair of a lower rank, only the leftmost occurrence is merged in a round.

Edges: a null text is empty and has no tokens; repeated rows are counted each; white space alone has no tokens;
begin and end strings that stand in a text count as one token each, as the library does by default; a null id stays
null.  Columns of any other name are left out of the result.  Counts need no shuffle: a document is one row of one task.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices

#: Above this many bytes a pre-token is merged on linked arrays.
LONG = 2048
#: Entries of the memo of chunks that a worker keeps, and the longest that it keeps; neither changes a result.
MEMO, MEMO_CHARS = 500_000, 64
#: Characters that are cut into pre-tokens at one time; cuts fall on white space only.
PIECE = 1 << 20

_NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free letter from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else spare))
        spare += b not in shown
    return out


class Merges:
    """A vocabulary's merge table as sorted arrays."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            whole = json.load(f)
        model, vocab = whole["model"], whole["model"]["vocab"]
        end = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in letters], dtype=np.int64)
        self.size = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.product = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = self.left * self.size + self.right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        least = np.full(self.size, _NONE)
        np.minimum.at(least, self.left, np.arange(len(pairs)))
        np.minimum.at(least, self.right, np.arange(len(pairs)))
        #: Whether all occurrences of a rank may be merged at once: nothing of a lower rank can arise from them.
        self.together = least[self.product] > np.arange(len(pairs))
        self.specials = [t["content"] for t in whole.get("added_tokens", []) if t.get("special")]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``_NONE`` where there is none."""
        if not len(self.keys):
            return np.full(len(a), _NONE)
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token (none of them empty)."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        out = np.ones(len(words), dtype=np.int64)
        for k in np.flatnonzero(sizes > LONG):
            out[k] = self._count_long(words[k])
        short = np.flatnonzero((sizes > 1) & (sizes <= LONG))
        if len(short):
            out[short] = self._count_ragged([words[k] for k in short], sizes[short])
        return out

    def _symbols(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        symbols = self.first[flat]
        symbols[ends - 1] = self.last[flat[ends - 1]]
        return symbols

    def _count_ragged(self, words: list[bytes], sizes: np.ndarray) -> np.ndarray:
        out = np.empty(len(words), dtype=np.int64)
        ids = np.arange(len(words))
        symbols = self._symbols(np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum(sizes))
        while len(ids):
            starts = np.cumsum(sizes) - sizes
            rank = np.full(len(symbols), _NONE)
            rank[:-1] = self.rank(symbols[:-1], symbols[1:])
            rank[starts + sizes - 1] = _NONE
            low = np.minimum.reduceat(rank, starts)
            open_ = low != _NONE
            out[ids[~open_]] = sizes[~open_]
            own = np.repeat(low, sizes)
            hit = np.flatnonzero((rank == own) & (own != _NONE))
            if not len(hit):
                break
            hit = hit[_apart(hit[1:] == hit[:-1] + 1)]
            sequence = np.searchsorted(starts, hit, side="right") - 1
            lead = np.r_[True, sequence[1:] != sequence[:-1]]
            keep = self.together[rank[hit]] | lead
            hit, sequence = hit[keep], sequence[keep]
            symbols[hit] = self.product[rank[hit]]
            live = np.repeat(open_, sizes)
            live[hit + 1] = False
            sizes = (sizes - np.bincount(sequence, minlength=len(sizes)))[open_]
            symbols, ids = symbols[live], ids[open_]
        return out

    def _count_long(self, word: bytes) -> int:
        n = len(word)
        symbols = self._symbols(np.frombuffer(word, dtype=np.uint8), np.array([n]))
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n + 1, dtype=bool)
        alive[n] = False
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def offer(at: np.ndarray, rank: np.ndarray) -> None:
            at, rank = at[rank != _NONE], rank[rank != _NONE]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else np.empty(0, dtype=np.int64)
            for r, some in zip(rank[cuts].tolist(), np.split(at, cuts[1:]) if len(cuts) else []):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(some)

        offer(np.arange(n - 1), self.rank(symbols[:-1], symbols[1:]))
        left = n
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (after[at] < n)]
            at = at[(symbols[at] == self.left[r]) & (symbols[after[at]] == self.right[r])]
            at = at[_apart(after[at[:-1]] == at[1:])] if len(at) else at
            if not len(at):
                continue
            if not self.together[r] and len(at) > 1:
                waiting[r] = [at[1:]]
                heapq.heappush(heap, r)
                at = at[:1]
            gone = after[at]
            symbols[at] = self.product[r]
            alive[gone] = False
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            left -= len(at)
            near = np.unique(np.concatenate([at, before[at][before[at] >= 0]]))
            near = near[after[near] < n]
            offer(near, self.rank(symbols[near], symbols[after[near]]))
        return left


def _apart(touching: np.ndarray) -> np.ndarray:
    """Of ordered hits, where ``touching[k]`` says that hit k + 1 starts in hit k: every other one of each run."""
    at = np.arange(len(touching) + 1)
    run = np.maximum.accumulate(np.where(np.r_[True, ~touching], at, 0))
    return (at - run) % 2 == 0


#: The split of the vocabulary, a fixed value; its white space is Unicode's White_Space and nothing else.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PRE = regex.compile(rf"\p{{L}}++|'(?:[stmd]|re|ve|ll)|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
#: What ``str.split`` takes for white space although Unicode does not.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_WHITE = re.compile(f"[{_SPACE}]+")
_CUT = re.compile(r"[ \n\t\r]")


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of about ``PIECE`` characters, cut before white space."""
    at = 0
    while len(text) - at > PIECE:
        cut = _CUT.search(text, at + PIECE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def lowered(text: str) -> str:
    """NFC, then lower case letter by letter (a capital sigma has one small form wherever it stands)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Counter:
    """Counts texts; keeps the counts of short chunks between white space that it has met."""

    def __init__(self, merges: Merges):
        self.merges, self.memo = merges, {}
        self.specials = re.compile("|".join(map(re.escape, merges.specials))) if merges.specials else None

    def _chunks(self, text: str) -> tuple[list[str], int]:
        """The text between white space (no pre-token reaches over it), and how many special strings stand in it."""
        if self.specials and "<" in text and len(parts := self.specials.split(text)) > 1:
            return list(chain.from_iterable(self._chunks(p)[0] for p in parts)), len(parts) - 1
        text = lowered(text)
        return (list(filter(None, _WHITE.split(text))) if _SEPARATORS.search(text) else text.split()), 0

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; pre-tokens of a batch are merged together, a piece of a long text at a time."""
        out = [0] * len(texts)
        batch: list[tuple[int, list[str]]] = []
        held = 0
        for k, text in enumerate(texts):
            for piece in pieces(text or ""):
                chunks, specials = self._chunks(piece)
                out[k] += specials
                batch.append((k, chunks))
                held += len(piece)
                if held >= PIECE:
                    self._settle(batch, out)
                    batch, held = [], 0
        self._settle(batch, out)
        return out

    def _settle(self, batch: list[tuple[int, list[str]]], out: list[int]) -> None:
        new = list(set(chain.from_iterable(c for _, c in batch)).difference(self.memo))
        split = [(c,) if c.isalpha() else _PRE.findall(c) for c in new]
        words = list(set(chain.from_iterable(split)))
        tokens = dict(zip(words, self.merges.count([w.encode() for w in words]).tolist()))
        self.memo.update((c, sum(map(tokens.__getitem__, s))) for c, s in zip(new, split))
        for k, chunks in batch:
            out[k] += sum(map(self.memo.__getitem__, chunks))
        if len(self.memo) > MEMO:
            self.memo.clear()
        else:
            for c in new:
                if len(c) > MEMO_CHARS:
                    del self.memo[c]


def count(docs: DataFrame, file: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_bytes, n_tokens) of every text, with the vocabulary in ``file`` (read on the driver, of fixed size)."""
    held = docs.sparkSession.sparkContext.broadcast(Merges(file))
    schema = "doc bigint, n_bytes bigint, n_tokens bigint"

    def run(batches):
        counter = Counter(held.value)
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            sizes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(counter.counts(texts), pa.int64())], ["doc", "n_bytes", "n_tokens"])

    return docs.select(F.col(id).cast("bigint").alias("doc"), F.col(text).alias("text")).mapInArrow(run, schema)
