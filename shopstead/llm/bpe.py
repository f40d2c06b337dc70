"""Byte-level BPE as a monoid: pieces are encoded in halves, neighbours joined by re-encoding a growing window."""

from __future__ import annotations

import base64
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import documents, mapped, rows_of

#: Bytes that are merged directly; longer pieces are halved.
LEAF = 24
#: Pieces that a worker remembers before it forgets those it has not met since as many others; characters of a text whose
#: matches are taken at once, and matches that are taken together of a longer one.
REMEMBERED, LONG, PART = 300_000, 200_000, 50_000


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Plain byte-pair merges, lowest rank first, leftmost on ties; a heap keeps long pieces at n log n."""
    if piece in ranks:
        return [piece]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) <= LEAF:
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapify(heap)
    while heap:
        _, i, size = heappop(heap)
        j = after[i] if parts[i] else n
        if j >= n or len(parts[i]) + len(parts[j]) != size:
            continue  # one side has changed since
        parts[i] += parts[j]
        parts[j] = b""
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
    return [p for p in parts if p]


class Codec:
    """Encodes and decodes with a rank file and a splitting pattern; one for each worker process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.pattern = regex.compile(pattern)
        self.split = self.pattern.findall
        self.fits = lru_cache(100_000)(self._fits)
        self.known = _Known(self)
        self.names = [str(i) for i in range(len(self.bytes_of))]

    def _fits(self, a: bytes, b: bytes) -> bool:
        """Whether two tokens can stand side by side: their bytes, encoded alone, give the same two tokens. A sequence
        in which every neighbouring pair fits is the encoding of its bytes."""
        return merge(a + b, self.ranks) == [a, b]

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """Encoding of the concatenation of two encoded strings: the window around the border doubles until the tokens
        outside it fit what is inside, which proves that they stay."""
        k = 2
        while True:
            keep, rest = left[:-k], right[k:]
            window = merge(b"".join(left[-k:]) + b"".join(right[:k]), self.ranks)
            if (not keep or self.fits(keep[-1], window[0])) and (not rest or self.fits(window[-1], rest[0])):
                return keep + window + rest
            k *= 2

    def tree(self, piece: bytes) -> list[bytes]:
        if len(piece) <= LEAF:
            return merge(piece, self.ranks)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def pieces(self, text: str):
        """Lists of the pattern's matches in a text, in order."""
        if len(text) <= LONG:
            yield self.split(text)
            return
        matches = self.pattern.finditer(text)
        while part := [m[1] if self.pattern.groups == 1 else m[0] for m in islice(matches, PART)]:
            yield part

    def piece(self, piece: str) -> tuple[int, ...]:
        return tuple(self.ranks[t] for t in self.tree(piece.encode("utf-8", "surrogatepass")))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text. The matches of a long one are taken PART at a time, whatever the pattern, so that they
        are never held together; ids only need concatenation."""
        known, parts = self.known, []
        for part in self.pieces(text):
            parts.append(np.fromiter(chain.from_iterable(map(known.__getitem__, part)), np.int32))
            if len(known) > REMEMBERED:
                known.turn()
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def decode(self, ids) -> bytes:
        """Bytes of a sequence of ids; concatenation is all the tree has to do."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Known(dict):
    """Ids of pieces in two generations: those met since the last turn, and those of the turn before, which come back
    when they are met again. Frequent pieces so are never worked out anew, and memory is bounded by both."""

    def __init__(self, codec: Codec):
        self.codec, self.before = codec, {}

    def __missing__(self, piece: str):
        ids = self.before.get(piece)
        if ids is None:
            ids = self.codec.piece(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def turn(self):
        self.before = dict(self)
        self.clear()


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    with open(path, "rb") as f:
        return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def _lists(ids: list[np.ndarray], sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.concatenate(ids)))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) for every row of docs, by the rank file at path, without special tokens.

    Null and empty texts have no ids. Repeated rows give repeated results. A text of any length is worked through in
    parts, so memory follows the ids of one batch. Extra columns are left behind. The rank file is read once in each
    worker; it must be at the same path there.
    """

    def run(batches):
        c = codec(path, pattern)
        for doc_ids, texts in rows_of(batches, ("doc_id", "text")):
            for a in range(0, len(texts), 500):
                ids = [c.encode(t) for t in texts[a : a + 500]]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a : a + 500], pa.int64()), pa.array(sizes), _lists(ids, sizes)], names=["doc_id", "n_tokens", "ids"])

    return mapped(documents(docs), run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, digest=None, columns: str = "decoded binary", keep_ids: bool = True) -> DataFrame:
    """encoded with the bytes of its ids as column decoded; with digest, a function of (ids, bytes), the values of
    `columns` instead."""
    schema = [f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema if f.name != "ids" or keep_ids]
    names = [s.split(" ")[0] for s in schema]
    new = [c.strip().split(" ")[0] for c in columns.split(",")]

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(batch.schema.get_field_index("ids"))
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            out = []
            for s, e in zip(offsets[:-1], offsets[1:]):
                ids = values[s:e].tolist()
                data = c.decode(ids)
                out.append(digest(ids, data) if digest else (data,))
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, zip(*out))], names=[*names, *new])

    return mapped(encoded, run, ", ".join([*schema, columns]))


def round_trip(docs: DataFrame, path: str, pattern: str, digest, columns: str, keep_ids: bool = True) -> DataFrame:
    """What decode(encode(docs)) gives with digest, in one pass, so that ids need not leave the worker to be decoded."""
    new = [c.strip().split(" ")[0] for c in columns.split(",")]

    def run(batches):
        c = codec(path, pattern)
        for doc_ids, texts in rows_of(batches, ("doc_id", "text")):
            for a in range(0, len(texts), 500):
                ids, out = [], []
                for text in texts[a : a + 500]:
                    ids.append(c.encode(text))
                    plain = ids[-1].tolist()
                    out.append(digest(plain, c.decode(plain)))
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                kept = [("ids", _lists(ids, sizes))] if keep_ids else []
                named = [("doc_id", pa.array(doc_ids[a : a + 500], pa.int64())), ("n_tokens", pa.array(sizes)), *kept, *zip(new, map(pa.array, zip(*out)))]
                yield pa.RecordBatch.from_arrays([x for _, x in named], names=[n for n, _ in named])

    return mapped(documents(docs), run, f"doc_id long, n_tokens long, {'ids array<int>, ' if keep_ids else ''}{columns}")
