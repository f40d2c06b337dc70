"""Repeated substrings across a corpus by bucket-pointer refinement of suffixes in q-gram buckets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOBS, blob_batch, chunks_of, dealt, dropped, mapped, marked, mix64, n_buckets, packed, split_by_bucket, stored, unpacked
from .rolling import Rolling

#: Bytes of the q-grams of the initial buckets.
Q = 24
#: Unresolved suffixes of one bucket that a task takes whole; the windows of larger ones are dealt out by their hash.
SPLIT = 8_000
#: Records of a bucket that a task refines at once, and windows that it combines before, and takes after, they are dealt.
HELD, WINDOWS = 400_000, 400_000
#: Characters that a task samples at once: some 20 arrays of 8 bytes a character are in memory meanwhile.
CHUNK = 400_000
_CHARS = 16_000_000
_PLACE = np.uint64((1 << 30) - 1)
WINDOW = np.dtype([("w", "<u8"), ("d", "<i8"), ("m", "<i8"), ("p", "<i4")])


def suffix_type(length: int) -> np.dtype:
    """A sampled suffix; the number of windows that sample it and its place in their span are at most `length`."""
    small = "u1" if length < 256 else "<u4"
    return np.dtype([("t", "<u4"), ("s", "<u8"), ("d", "<i8"), ("m", "<i8"), ("p", "<i4"), ("n", small), ("o", small)])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values."""
    n = len(values)
    pad = -n % width
    v = np.r_[values, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))].reshape(-1, width)
    ahead = np.minimum.accumulate(v, axis=1).ravel()
    behind = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def sampled(ids: list[int], marks: list[int], texts: list[bytes], length: int):
    """A record for each sampled suffix of the texts, with the 64-bit hash of its first Q bytes (or `length`, if less).

    Each window of `length` bytes samples the suffix at its least Q-gram (leftmost on ties), so equal windows sample at
    the same place in them. A record stands for the n windows, starting at p, that sample one suffix; s is the hash of
    all bytes they span and o where the suffix lies in the span.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.r_[0, np.cumsum(sizes)]
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, suffix_type(length))
    rolling = Rolling(data)
    q = min(Q, length)
    grams = rolling.grams(q)
    least = _least((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), length - q + 1)
    at = (least & _PLACE).astype(np.int64)
    ok = np.zeros(len(at) + 1, np.int32)  # windows inside one document
    full = sizes >= length
    np.add.at(ok, starts[:-1][full], 1)
    np.add.at(ok, (starts[1:] - length + 1)[full], -1)
    inside = np.cumsum(ok[:-1]) > 0
    new = np.r_[True, (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])]
    owner_start = np.zeros(len(at), bool)
    owner_start[starts[:-1][full]] = True
    first = np.flatnonzero((new | owner_start) & inside)
    ends = np.flatnonzero(np.r_[(new | owner_start)[1:], True])
    last = ends[np.searchsorted(ends, first)]
    doc = np.searchsorted(starts, first, side="right") - 1
    rec = np.empty(len(first), suffix_type(length))
    h = mix64(grams[at[first]])  # least hashes are small ones: unmixed, their upper bits fill few buckets
    rec["t"] = h & np.uint64(0xFFFFFFFF)
    rec["n"], rec["o"] = last - first + 1, at[first] - first
    rec["s"] = rolling.slices(first, last + length) + rec["o"].astype(np.uint64)
    rec["d"], rec["m"], rec["p"] = np.array(ids, np.int64)[doc], np.array(marks, np.int64)[doc], first - starts[doc]
    return h, rec


def _firsts(rec: np.ndarray, *keys: np.ndarray):
    """Order that sorts by keys, document, place; and for each record in it, where its group starts."""
    order = np.lexsort((rec["p"], rec["m"], rec["d"], *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)[np.cumsum(new) - 1]


def _later(rec: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sorted records that lie elsewhere than the first of their group."""
    return (rec["d"] != rec["d"][first]) | (rec["m"] != rec["m"][first]) | (rec["p"] != rec["p"][first])


def merged(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, end: np.ndarray):
    """The union of byte ranges, as maximal ranges of each document: (doc_id, mark, start, end)."""
    order = np.lexsort((end, start, mark, doc))
    doc, mark, start, end = doc[order], mark[order], start[order], end[order]
    base = np.r_[0, np.cumsum((doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]))] * np.int64(1 << 32) if len(doc) else np.zeros(0, np.int64)
    s, e = start + base, np.maximum.accumulate(end + base)
    new = np.r_[True, s[1:] > e[:-1]] if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(doc) - 1] if len(doc) else first
    return doc[first], mark[first], start[first], e[last] - base[last]


RANGES = "doc_id long, mark long, start long, end long, key long, n int"


def _ranges(doc, mark, start, end, key=None, n=None) -> pa.RecordBatch:
    null = pa.nulls(len(doc), pa.int64())
    cols = [pa.array(np.asarray(x, np.int64)) for x in (doc, mark, start, end)]
    return pa.RecordBatch.from_arrays([*cols, null if key is None else pa.array(key), null.cast(pa.int32()) if n is None else pa.array(n.astype(np.int32))], names=["doc_id", "mark", "start", "end", "key", "n"])


def _first_pass(docs: DataFrame, length: int) -> DataFrame:
    """Ranges that are known to repeat (key null), and suffixes whose bucket must be refined by their bytes (key)."""
    nb, suffix = n_buckets(docs, _CHARS), suffix_type(length)

    def deal(batches):
        for ids, marks, texts in chunks_of(batches, ("doc_id", "mark", "text"), "text", CHUNK):
            h, rec = sampled(ids, marks, [t.encode("utf-8", "surrogatepass") for t in texts], length)
            if not len(rec):
                continue
            order, first = _firsts(rec, h, rec["s"])
            h, rec = h[order], rec[order]
            known = _later(rec, first)  # an earlier equal span in this very chunk: combined before the shuffle
            r = rec[known]
            found = merged(r["d"], r["m"], r["p"].astype(np.int64), r["p"].astype(np.int64) + r["n"] - 1 + length)
            rest = rec[~known]
            blobs = list(split_by_bucket(h[~known], nb, rest))
            if len(r):
                blobs.append((nb + int(found[0][0]) % nb, np.column_stack(found).tobytes()))
            yield blob_batch(blobs)

    def refine(batches):
        def whole():
            """(bucket, records, whether they are all it has); a bucket of more than HELD records comes in several parts."""
            now, held, size, cut = None, [], 0, False
            for batch in batches:
                for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if b >= nb:
                        yield b, blob, True
                        continue
                    full = size + len(blob) > HELD * suffix.itemsize
                    if held and (b != now or full):
                        cut = cut or b == now
                        yield now, b"".join(held), not cut
                        held, size = [], 0
                    cut = cut and b == now
                    now = b
                    held.append(blob)
                    size += len(blob)
            if held:
                yield now, b"".join(held), not cut

        for b, blob, all_ in whole():
            if b >= nb:
                yield _ranges(*np.frombuffer(blob, np.int64).reshape(-1, 4).T)
                continue
            rec = np.frombuffer(blob, suffix)
            if all_:
                t = np.sort(rec["t"])
                rec = rec[np.isin(rec["t"], np.unique(t[1:][t[1:] == t[:-1]]))]
                if not len(rec):
                    continue
            order, first = _firsts(rec, rec["t"], rec["s"])
            rec = rec[order]
            known = _later(rec, first)
            r = rec[known]
            yield _ranges(r["d"], r["m"], r["p"], r["p"].astype(np.int64) + r["n"] - 1 + length)
            heads = rec[~known]
            new = np.r_[True, heads["t"][1:] != heads["t"][:-1]]
            group = np.cumsum(new) - 1
            open_ = (np.bincount(group) > 1)[group] | (not all_)  # a lone one may have its like in another part
            r = heads[open_]
            key = (np.int64(b) << np.int64(32)) | r["t"].astype(np.int64)
            yield _ranges(r["d"], r["m"], r["p"], r["p"].astype(np.int64) + r["n"] - 1 + length, key, r["n"])

    return mapped(dealt(mapped(docs.where("doc_id is not null"), deal, BLOBS), 2 * nb), refine, RANGES)


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of keys in sorted order, and which keys are alone in theirs."""
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    bucket = np.empty(len(keys), np.int64)
    bucket[order] = np.cumsum(new) - 1
    lone = np.empty(len(keys), bool)
    lone[order] = new & np.r_[new[1:], True]
    return bucket, lone


def _any_within(flags: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
    """Whether any of flags[at .. at + reach] holds."""
    seen = np.r_[0, np.cumsum(flags)]
    return seen[at + reach + 1] > seen[at]


def refined(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket-pointer refinement: which windows data[at : at + length] have a like, and the bucket of each of those.

    Every suffix is in the bucket of its q-gram. A round sorts suffixes by their own bucket and that of the suffix a depth
    further on, which makes the depth twice as much; its new numbers serve as pointers in the next round, whatever windows
    ask for them. A window that holds a suffix alone in its bucket is settled and asks for nothing any more.
    """
    depth = min(Q, length)
    bucket, lone = _ranked(Rolling(data).grams(depth))
    left = np.flatnonzero(~_any_within(lone, at, length - depth)) if len(at) else np.zeros(0, np.int64)
    while depth < length and len(left):
        deeper = min(2 * depth, length)
        asked = np.zeros(len(data) + 1, np.int32)
        np.add.at(asked, at[left], 1)
        np.add.at(asked, at[left] + length - deeper + 1, -1)
        asked = np.flatnonzero(np.cumsum(asked) > 0)
        number, alone = _ranked((bucket[asked] << 32) | bucket[asked + deeper - depth])
        bucket[asked] = number
        lone = np.zeros(len(data), bool)
        lone[asked] = alone
        depth = deeper
        left = left[~_any_within(lone, at[left], length - depth)]
    return left, bucket[at[left]]


#: What is dealt out for refinement: spans of a bucket (kind 0, key is the bucket), windows (1, key is their part), and
#: ranges that are known by then (2).
DEALT = "kind int, key long, doc_id long, mark long, start long, n int, data binary"


def _windows(spans):
    """A record for each window of spans (doc_id, mark, start, n, bytes), the bytes of all, and where windows start."""
    doc, mark, start, n, data = zip(*spans)
    at = np.r_[0, np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))][:-1]
    n = np.array(n, np.int64)
    own = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(own)) - np.repeat(np.r_[0, np.cumsum(n)][:-1], n)
    rec = np.empty(len(own), WINDOW)
    rec["d"], rec["m"], rec["p"] = np.array(doc, np.int64)[own], np.array(mark, np.int64)[own], np.array(start, np.int64)[own] + step
    return rec, np.frombuffer(b"".join(data), np.uint8), at[own] + step


def _split(rec: np.ndarray, length: int):
    """The ranges of windows that equal an earlier one, and the first window of each kind."""
    order, first = _firsts(rec, rec["w"])
    rec = rec[order]
    known = _later(rec, first)
    r = rec[known]
    start = r["p"].astype(np.int64)
    return merged(r["d"], r["m"], start, start + length), rec[~known]


def _solved(spans, length: int):
    """The ranges of windows of spans that equal an earlier one. Equal windows sample equal suffixes, so spans of
    several buckets may be refined together."""
    rec, data, at = _windows(spans)
    left, bucket = refined(data, at, length)
    rec = rec[left]
    rec["w"] = bucket.astype(np.uint64)
    return _split(rec, length)[0]


def _spread(docs: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """DEALT: spans of buckets up to SPLIT as they are; of larger buckets every window once, in parts by its hash, which
    is what its bucket number would be in the end, after each task has combined the equal ones it has seen."""
    hot = open_.groupBy("key").agg(F.count("*").alias("spans"), F.sum("n").alias("windows")).where(F.col("spans") > SPLIT)
    hot = stored(hot.select("key", "windows"), "hot")
    parts = int((hot.agg(F.sum("windows")).first()[0] or 0) // WINDOWS) + 1
    known = open_.join(hot.select("key", F.lit(True).alias("hot")), "key", "left")
    wanted = known.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("key", "start", "end", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("spans"))

    def batch_of(*values):
        kinds = (pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(values, kinds)], names=["kind", "key", "doc_id", "mark", "start", "n", "data"])

    def combined(spans):
        rec, data, at = _windows(spans)
        rec["w"] = Rolling(data).slices(at, at + length)
        (doc, mark, start, end), rest = _split(rec, length)
        if len(doc):
            yield batch_of([2] * len(doc), doc, doc, mark, start, (end - start).astype(np.int32), [None] * len(doc))
        key, data = zip(*split_by_bucket(np.ascontiguousarray(rest["w"]), parts, rest))
        none = [None] * len(key)
        yield batch_of([1] * len(key), key, none, none, none, none, data)

    def cut(batches):
        held, size = [], 0
        for batch in batches:
            out = []
            for i, m, z, spans in zip(*(c.to_pylist() for c in batch.columns)):
                data = unpacked(z)
                for x in spans:
                    span = (i, m, x["start"], x["n"], data[x["start"] : x["end"]])
                    assert len(span[-1]) == x["n"] - 1 + length
                    if x["hot"]:
                        held.append(span)
                        size += x["n"]
                        if size >= WINDOWS:
                            yield from combined(held)
                            held, size = [], 0
                    else:
                        out.append((0, x["key"], *span))
            if out:
                yield batch_of(*zip(*out))
        if held:
            yield from combined(held)

    texts = docs.select("doc_id", "mark", packed("text").alias("z")).join(wanted, ["doc_id", "mark"]).select("doc_id", "mark", "z", "spans")
    return mapped(texts, cut, DEALT)


def _refined(docs: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """Ranges that repeat among the suffixes left open: those of a bucket, or of a part of windows, are refined at once."""

    def run(batches):
        held, blobs, last = [], [], None

        def solved():
            if held:
                yield _ranges(*_solved(held, length))
            if blobs:
                yield _ranges(*_split(np.frombuffer(b"".join(blobs), WINDOW), length)[0])
            held.clear()
            blobs.clear()

        for batch in batches:
            known = []
            for kind, key, doc, mark, start, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (kind, key) != last and (blobs or len(held) >= SPLIT):
                    yield from solved()
                last = (kind, key)
                if kind == 0:
                    held.append((doc, mark, start, n, data))
                elif kind == 1:
                    blobs.append(data)
                else:
                    known.append((doc, mark, start, start + n))
            if known:
                yield _ranges(*zip(*known))
        yield from solved()

    return mapped(_spread(docs, open_, length).repartition("kind", "key").sortWithinPartitions("kind", "key"), run, RANGES)


def repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, mark, spans): for each document of docs (see marked) that has any, the byte ranges covered by strings of
    `length` bytes that also start earlier (in a smaller doc_id, or further up in the same document).

    1. Every window of `length` bytes samples the suffix at its least q-gram; sampled suffixes go into buckets by q-gram.
       A suffix that is alone in its bucket settles all windows that sampled it.
    2. Buckets are refined by the whole span around the suffix, what precedes and what follows: equal spans but the
       first repeat outright. Chunks do so before the shuffle, so a passage that many documents share leaves each chunk
       once.
    3. Where several spans are left, all their suffixes are ranked by bucket-pointer refinement (see refined), down to
       `length` bytes; the windows of large buckets are dealt out by the hash of their bytes, each once.
    """
    found = stored(_first_pass(docs, length), "suffixes")
    open_ = found.where("key is not null")
    again = stored(_refined(docs, open_, length), "refined")
    ranges = found.where("key is null").unionByName(again).select("doc_id", "mark", F.struct("start", "end").alias("range"))
    return ranges.groupBy("doc_id", "mark").agg(F.collect_list("range").alias("spans"))


def cut_repeats(docs: DataFrame, length: int = 100, digest=None, columns: str = "kept binary, spans array<struct<start:bigint,end:bigint>>") -> DataFrame:
    """doc_id, kept (the UTF-8 bytes left, concatenated) and spans (what was removed) for every row of docs; with digest,
    a function of (bytes, kept, spans), the values of `columns` instead.

    Null and empty texts keep nothing and lose nothing, nor do texts shorter than `length` lose any. Rows without doc_id
    stay whole and are not compared; rows that repeat a doc_id with the same text do not count against each other,
    those with another text are documents of their own, in the order of the texts' hashes. Empty tables give empty results; extra columns are left behind.
    `length` is any number of bytes from 1.
    """
    if length < 1:
        raise ValueError("length must be 1 or more")
    docs = marked(docs)
    names = [c.split(" ")[0] for c in columns.split(", ")]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            out, ids = [], batch.column(0)
            for z, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = unpacked(z)
                start = np.fromiter((x["start"] for x in spans or ()), np.int64)
                end = np.fromiter((x["end"] for x in spans or ()), np.int64)
                zero = np.zeros(len(start), np.int64)
                _, _, s, e = merged(zero, zero, start, end)
                gone = list(zip(s.tolist(), e.tolist()))
                kept = b"".join(data[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(data)]))
                out.append(digest(data, kept, gone) if digest else (kept, [{"start": a, "end": b} for a, b in gone]))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in zip(*out))] if digest else [ids, pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", *names])

    joined = docs.select("doc_id", "mark", packed("text").alias("z")).join(repeats(docs, length), ["doc_id", "mark"], "left").select("doc_id", "z", "spans")
    return mapped(joined, run, f"doc_id long, {columns}")
