"""SentencePiece encoding and decoding: Viterbi over a double-array trie of pieces with log scores.

Pieces and special kinds come from a SentencePiece model file, whose path is a parameter; nothing is trained.  A
unigram model's own scores serve as they are.  A BPE model gives merge ranks instead of log scores; a piece of rank r
then scores -ln(r + 2), up to a constant what Zipf's law gives its frequency.

Text is escaped as the library does with an identity normaliser: a leading space marker is added and spaces become
markers.  A character without a piece is an unknown node, ten below the lowest score, and is written as byte pieces.
When no piece holds a newline, or a marker after another character (both are tested), the best path of a text is the
best paths of its chunks, cut at those places; each distinct chunk is solved once, all of one length at a time.
Scores are multiples of 2**-16, so sums are exact and equal paths tie; of these the one with the longest last piece wins.

Defined results: a null or empty text has no ids; decoding gives back every text but for U+2581 itself, which
becomes a space; repeated rows encode alike; a text without spaces is one chunk, solved in linear time (30 microseconds a
byte); an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, utf8

MARKER = "▁".encode()
UNKNOWN_PENALTY = 10.0
_CHUNK = re.compile(rb"\n| *[^ \n]+| +")


#: Fixed value: the model file's number for a unigram model, which is also its default.
UNIGRAM = 1


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message: integers or, for the rest, bytes."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    at = 0
    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


def model_type(proto: bytes) -> int:
    """The type that a model file states: field 3 of its trainer's specification, field 2."""
    kind = UNIGRAM
    for number, value in _fields(proto):
        if number == 2:
            kind = next((v for n, v in _fields(value) if n == 3), kind)
    return kind


class DoubleArray:
    """A trie of byte strings: the child of state s by byte c is t = base[s] + c + 1 if check[t] == s."""

    def __init__(self, words: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for word, number in words.items():
            node = 0
            for c in word:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    value.append(-1)
                node = children[node][c]
            value[node] = number
        size = 4 * len(children) + 65_536
        base, check, leaf = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = np.ones(size, dtype=bool)
        free[0] = False
        queue, low, cursor = [(0, 0)], 257, 300
        for node, state in queue:  # grows while it is walked: breadth first
            leaf[state] = value[node]
            if not children[node]:
                continue
            codes = np.fromiter(sorted(children[node]), dtype=np.int64) + 1
            if len(codes) == 1:  # fills the holes that wider nodes leave
                while not free[low]:
                    low += 1
                at = low - int(codes[0])
            else:
                begin = cursor
                while True:  # the first place, among the free ones from the cursor on, where all children fit
                    open_ = begin + np.flatnonzero(free[begin : begin + 2048])
                    fit = free[(open_ - codes[0])[:, None] + codes].all(axis=1)
                    if fit.any():
                        at = int(open_[int(fit.argmax())] - codes[0])
                        break
                    begin += 2048
                if begin > cursor:
                    cursor = begin
            if at + 5000 >= size:
                base, check, leaf = (np.concatenate((x, np.full(size, fill, np.int32))) for x, fill in ((base, 0), (check, -1), (leaf, -1)))
                free = np.concatenate((free, np.ones(size, dtype=bool)))
                size *= 2
            base[state] = at
            free[at + codes] = False
            check[at + codes] = state
            queue.extend((children[node][c - 1], at + c) for c in codes.tolist())
        used = int(np.flatnonzero(~free).max()) + 258
        self.base, self.check, self.leaf = base[:used], check[:used], leaf[:used]


class Codec:
    """Pieces, their scores and their trie."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i).encode() for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        scores = np.array([model.get_score(i) for i in range(n)], dtype=np.float64)
        if model_type(model.serialized_model_proto()) != UNIGRAM:
            order = sorted(plain, key=lambda i: (-scores[i], i))
            scores = np.zeros(n)
            scores[order] = -np.log(np.arange(len(order)) + 2.0)
        self.scores = np.round(scores * 65536) / 65536
        self.unknown_score = self.scores[plain].min() - UNKNOWN_PENALTY
        self.byte_ids = np.full(256, model.unk_id(), dtype=np.int32)
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(pieces[i][3:-1], 16)] = i
        self.trie = DoubleArray({pieces[i]: i for i in plain})
        surface = [b""] * n
        for i in plain:
            surface[i] = pieces[i].replace(MARKER, b" ")
        for b in range(256):
            if model.is_byte(int(self.byte_ids[b])):
                surface[self.byte_ids[b]] = bytes([b])
        self.is_byte = np.zeros(n, dtype=bool)
        self.is_byte[[i for i in range(n) if model.is_byte(i)]] = True
        self.surface = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.surface_at = np.concatenate(([0], np.cumsum([len(s) for s in surface]))).astype(np.int64)
        inside = [pieces[i] for i in plain if MARKER in _lstrip(pieces[i]) or b"\n" in pieces[i]]
        self.separable = not inside

    # -- one length at a time ---------------------------------------------------------------------------------
    def _solve(self, data: np.ndarray) -> list[np.ndarray]:
        """The ids of each row of a matrix of escaped UTF-8 bytes."""
        count, length = data.shape
        best = np.full((length + 1, count), -np.inf)
        best[0] = 0
        piece = np.full((length + 1, count), -1, dtype=np.int32)
        start = np.zeros((length + 1, count), dtype=np.int32)
        trie, scores = self.trie, self.scores
        lead = (data & 0xC0) != 0x80
        width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        for s in range(length):
            rows = np.flatnonzero(lead[:, s] & np.isfinite(best[s]))
            if not len(rows):
                continue
            state = np.zeros(len(rows), dtype=np.int64)
            alive = rows
            single = np.zeros(count, dtype=bool)
            for e in range(s, length):
                to = trie.base[state] + data[alive, e].astype(np.int64) + 1
                ok = trie.check[to] == state
                alive, state = alive[ok], to[ok]
                if not len(alive):
                    break
                found = trie.leaf[state]
                term = found >= 0
                if term.any():
                    own, ids = alive[term], found[term]
                    score = best[s, own] + scores[ids]
                    better = score > best[e + 1, own]
                    own, ids = own[better], ids[better]
                    best[e + 1, own] = score[better]
                    piece[e + 1, own] = ids
                    start[e + 1, own] = s
                    single[alive[term][width[alive[term], s] == e + 1 - s]] = True
            rest = rows[~single[rows]]
            if len(rest):
                end = s + width[rest, s]
                score = best[s, rest] + self.unknown_score
                better = score > best[end, rest]
                rest, end = rest[better], end[better]
                best[end, rest] = score[better]
                piece[end, rest] = -1
                start[end, rest] = s
        out = []
        for r in range(count):
            at, ids = length, []
            while at > 0:
                s = start[at, r]
                if piece[at, r] >= 0:
                    ids.append(piece[at, r])
                else:
                    ids.extend(self.byte_ids[data[r, s:at]][::-1])
                at = s
            out.append(np.array(ids[::-1], dtype=np.int32))
        return out

    def solve(self, chunks: list[bytes]) -> list[np.ndarray]:
        """The ids of each chunk; spaces in chunks stand for markers."""
        escaped = [c.replace(b" ", MARKER) for c in chunks]
        by: dict[int, list[int]] = {}
        for k, c in enumerate(escaped):
            by.setdefault(len(c), []).append(k)
        out: list = [None] * len(chunks)
        for length, own in by.items():
            step = max(1, 400_000 // max(1, length))
            for a in range(0, len(own), step):
                part = own[a : a + step]
                data = np.frombuffer(b"".join(escaped[k] for k in part), dtype=np.uint8).reshape(len(part), length)
                for k, ids in zip(part, self._solve(data)):
                    out[k] = ids
        return out

    def chunks(self, text: bytes) -> list[bytes]:
        """The text with its leading space, cut where no piece reaches across."""
        if not text:
            return []
        whole = b" " + text.replace(MARKER, b" ")
        return _CHUNK.findall(whole) if self.separable else [whole]

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids in self.solve(self.chunks(text.encode())) for i in ids]

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """Surface bytes of a run of ids, with the leading space still there."""
        return gather(self.surface, self.surface_at[ids], self.surface_at[ids + 1] - self.surface_at[ids])

    def decode(self, ids: list[int]) -> str:
        data = self.decode_bytes(np.array(ids, dtype=np.int64)).tobytes() if len(ids) else b""
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def _lstrip(piece: bytes) -> bytes:
    while piece.startswith(MARKER):
        piece = piece[len(MARKER) :]
    return piece


def gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[at : at + size], one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(at - (ends - size), size) + np.arange(total)]


class Batcher:
    """Encodes batches of texts; keeps the ids of the chunks that it has solved, up to a bound."""

    LIMIT = 250_000

    def __init__(self, codec: Codec):
        self.codec = codec
        self.reset()

    def reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.at, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each text has)."""
        if len(self.index) > self.LIMIT:
            self.reset()
        known = len(self.index)
        index = self.index
        codes, counts = [], []
        for text in texts:
            parts = self.codec.chunks(text)
            counts.append(len(parts))
            codes.extend([index.setdefault(c, len(index)) for c in parts])
        fresh = list(index)[known:] if len(index) > known else []
        if fresh:
            ids = self.codec.solve(fresh)
            size = np.array([len(i) for i in ids], dtype=np.int64)
            at = len(self.flat) + np.concatenate(([0], np.cumsum(size)[:-1]))
            self.flat = np.concatenate((self.flat, *ids))
            self.at, self.size = np.concatenate((self.at, at)), np.concatenate((self.size, size))
        codes = np.array(codes, dtype=np.int64)
        flat = gather(self.flat, self.at[codes], self.size[codes])
        edge = np.concatenate(([0], np.cumsum(self.size[codes])))
        cut = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        return flat, np.diff(edge[cut])


def _encode(codec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Batcher(codec.value)
        for batch in slices(batches):
            texts = [t or b"" for t in utf8(batch)]
            flat, counts = own.encode(texts)
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            is_byte = np.concatenate(([0], np.cumsum(own.codec.is_byte[flat])))
            surface = own.codec.decode_bytes(flat.astype(np.int64)).tobytes()
            sizes = own.codec.surface_at[flat.astype(np.int64) + 1] - own.codec.surface_at[flat]
            edge = np.concatenate(([0], np.cumsum(sizes)))[offsets]
            same = [surface[a + (b > a) : b] == t for a, b, t in zip(edge[:-1].tolist(), edge[1:].tolist(), texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(counts), pa.array(np.diff(is_byte[offsets])), pa.array(same)],
                names=["doc", "ids", "n_ids", "n_byte_ids", "round_trip"],
            )

    return run


def encode(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, ids, n_ids, n_byte_ids, round_trip) for every row; the codec, as large as its vocabulary, is broadcast."""
    codec = docs.sparkSession.sparkContext.broadcast(Codec(model_file))
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_encode(codec), "doc bigint, ids array<int>, n_ids bigint, n_byte_ids bigint, round_trip boolean")


def decode(encoded: DataFrame, model_file: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``text`` decoded from its ids."""
    codec = encoded.sparkSession.sparkContext.broadcast(Codec(model_file))

    @F.arrow_udf("string")
    def back(column: pa.Array) -> pa.Array:
        return pa.array([codec.value.decode(x) if x is not None else None for x in column.to_pylist()], pa.string())

    return encoded.withColumn("text", back(F.col(ids)))
