"""Benchmark decontamination: a positional inverted index of the documents, asked for the phrases of the items."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks_of, documents, dropped, group_starts, mapped, pieces, rows_of, stored
from .rolling import Rolling

#: Bytes of words (fixed by the contract: no ASCII character but 0-9 and a-z, once A-Z are lower-cased, and all others).
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 32
#: Characters of documents in a block of the index; item words in a broadcast; possible places that are looked at together.
BLOCK, SHARD, PLACES = 6_000_000, 200_000, 1_000_000
#: Words of an item in one row of its phrases.
PIECE = 2000


def terms_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and where each text starts among them (with the end as last)."""
    terms, counts = [], []
    for s, e in pieces(texts):
        each = [t.encode("utf-8", "surrogatepass") for t in texts[s:e]]
        data = np.frombuffer(b" ".join(each), np.uint8)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = _WORD[data]
        turns = np.flatnonzero(np.diff(inside))
        first, last = turns[::2], turns[1::2]
        terms.append(Rolling(_LOW[data]).slices(first, last))
        ends = np.cumsum([len(t) + 1 for t in each])
        counts.append(np.diff(np.searchsorted(first, ends), prepend=0))
    counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return (np.concatenate(terms) if terms else np.zeros(0, np.uint64)), np.r_[0, np.cumsum(counts)]


INDEX = "doc_ids array<long>, n_words array<int>, terms binary, counts binary, places binary"


def _narrow(values: np.ndarray) -> bytes:
    """32-bit numbers under zstandard, the high bytes of all first: gaps between places are small."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _wide(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def index(docs: DataFrame) -> DataFrame:
    """The stored index: a row for each block of documents, with the words of all its texts.

    A block has its distinct terms in ascending order, how often each occurs, and the places (numbers of words within
    the block) of each in turn, as gaps. Lists never cross blocks, so a frequent word is spread over all of them, and a
    phrase, which never crosses documents, is found within one.
    """

    def run(batches):
        for ids, texts in chunks_of(batches, ("doc_id", "text"), "text", BLOCK):
            terms, cuts = terms_of(texts)
            order = np.argsort(terms, kind="stable")
            first = group_starts(terms[order])
            gaps = np.diff(order, prepend=0).astype(np.uint32)
            row = [ids, np.diff(cuts).astype(np.int32), terms[order][first].tobytes(), _narrow(np.diff(np.r_[first, len(order)])), _narrow(gaps)]
            kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["doc_ids", "n_words", "terms", "counts", "places"])

    return stored(mapped(documents(docs), run, INDEX), "index")


class Block:
    """One row of the index, with lists that can be searched: `keys` has list number * words + place, ascending."""

    def __init__(self, n_words, terms: bytes, counts: bytes, places: bytes):
        self.cuts = np.r_[0, np.cumsum(np.asarray(n_words, np.int64))]
        self.words = max(1, int(self.cuts[-1]))
        self.terms = np.frombuffer(terms, np.uint64)
        self.counts = _wide(counts).astype(np.int64)
        self.starts = np.r_[0, np.cumsum(self.counts)]
        # gaps wrap where a list ends
        self.places = np.cumsum(_wide(places).view("<i4"), dtype=np.int64)
        self.keys = np.repeat(np.arange(len(self.terms)), self.counts) * self.words + self.places

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, place, side="right") - 1

    def next(self, lists: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first place in each list at or after the given one; the number of words where there is none."""
        at = np.searchsorted(self.keys, lists * self.words + np.minimum(place, self.words - 1))
        found = self.keys[np.minimum(at, len(self.keys) - 1)]
        good = (place < self.words) & (at < len(self.keys)) & (found // self.words == lists)
        return np.where(good, found % self.words, self.words)

    def matches(self, grams: np.ndarray, sizes: np.ndarray, slop: int):
        """(gram, first word, last word) of the places of each gram (rows of terms, `sizes` of them each), in slices."""
        width = grams.shape[1]
        lists = np.minimum(np.searchsorted(self.terms, grams), max(0, len(self.terms) - 1))
        known = self.terms[lists] == grams if len(self.terms) else np.zeros(grams.shape, bool)
        used = np.arange(width) < sizes[:, None]
        alive = np.flatnonzero((known | ~used).all(1))
        many = np.where(used[alive], self.counts[lists[alive]], np.iinfo(np.int64).max) if len(alive) else np.zeros((0, width), np.int64)
        order = np.argsort(many, axis=1, kind="stable")
        rarest = order[:, 0]
        n = many[np.arange(len(alive)), rarest]
        ends = np.cumsum(n) * (slop + 1)
        at = 0
        while at < len(alive):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PLACES, side="right")))
            rows = alive[at:to]
            yield from self._intersected(lists[rows], sizes[rows], order[at:to], rarest[at:to], n[at:to], slop, rows)
            at = to

    def _intersected(self, lists, sizes, order, rarest, n, slop, names):
        """Starts by the places of the rarest term, thinned out by the other lists, the rarest first."""
        far = int(n.sum())
        for low in range(0, far, PLACES):  # one frequent gram alone may have more places than fit
            row = np.repeat(np.arange(len(n)), n)[low : low + PLACES]
            nth = np.arange(far)[low : low + PLACES] - np.repeat(np.cumsum(n) - n, n)[low : low + PLACES]
            place = self.places[self.starts[lists[row, rarest[row]]] + nth]
            start = (place - rarest[row])[:, None] - np.arange(slop + 1)
            key = np.unique(np.repeat(row, slop + 1) * (2 * self.words) + start.ravel() + self.words // 2 + slop + order.shape[1]) if slop else None
            if slop:
                row, start = key // (2 * self.words), key % (2 * self.words) - self.words // 2 - slop - order.shape[1]
            else:
                start = start[:, 0]
            good = (start >= 0) & (start + sizes[row] <= self.words)
            row, start = row[good], start[good]
            for k in range(0 if slop else 1, order.shape[1]):
                column = order[row, k]
                used = column < sizes[row]
                reach = self.next(lists[row, column], start + column)
                good = ~used | (reach <= start + column + np.where(column > 0, slop, 0))
                row, start = row[good], start[good]
                if not len(row):
                    break
            end = start.copy()
            if slop:  # the terms in order, each at its first place after the one before
                for k in range(1, order.shape[1]):
                    end = np.where(k < sizes[row], self.next(lists[row, np.minimum(k, sizes[row] - 1)], end + 1), end)
                good = end < start + sizes[row] + slop
                row, start, end = row[good], start[good], end[good]
            else:
                end = start + sizes[row] - 1
            good = (end < self.words) & (self.doc_of(start) == self.doc_of(np.minimum(end, self.words - 1)))
            yield names[row[good]], start[good], end[good]


def _shards(spark, items: DataFrame, width: int) -> list:
    """Broadcasts of (grams, sizes, items of each gram) with some SHARD words of items each, one driver-side at a time.

    A gram is `width` words of an item in a row, or all of a shorter one; grams that items share are looked up once a shard.
    """

    def run(batches):
        for ids, texts in rows_of(batches, ("item_id", "text")):
            terms, cuts = terms_of(texts)
            rows = [(i, terms[a : min(b, a + PIECE + width - 1)].tobytes()) for i, s, b in zip(ids, cuts[:-1], cuts[1:]) for a in range(s, max(s + 1, b - width + 1), PIECE) if b > s]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.string()), pa.array([z for _, z in rows], pa.binary())], names=["item", "terms"])

    texts = documents(items.withColumn("doc_id", F.col("item_id").cast("string"))).withColumnRenamed("doc_id", "item_id")
    pieces_ = stored(mapped(texts, run, "item string, terms binary").distinct(), "grams")
    n = -(-(pieces_.agg(F.sum(F.length("terms"))).first()[0] or 0) // (8 * SHARD))
    pieces_ = pieces_.withColumn("shard", F.pmod(F.xxhash64("item", "terms"), F.lit(max(1, n))))
    shards = []
    for k in range(n):
        rows = pieces_.where(F.col("shard") == k).toArrow()
        if not rows.num_rows:
            continue
        grams, sizes, names = [], [], []
        for name, data in zip(rows["item"].to_pylist(), rows["terms"].to_pylist()):
            terms = np.frombuffer(data, np.uint64)
            size = min(width, len(terms))
            each = np.lib.stride_tricks.sliding_window_view(terms, size)
            grams.append(np.pad(each, ((0, 0), (0, width - size))))
            sizes.append(np.full(len(each), size))
            names += [name] * len(each)
        grams = np.concatenate([np.concatenate(sizes).astype(np.uint64)[:, None], np.concatenate(grams)], axis=1)
        grams, which = np.unique(grams, axis=0, return_inverse=True)
        by = np.argsort(which.ravel(), kind="stable")
        owners = np.array(names, object)[by]
        shards.append(spark.sparkContext.broadcast((grams[:, 1:].copy(), grams[:, 0].astype(np.int64), np.r_[0, np.cumsum(np.bincount(which.ravel()))], owners)))
    dropped(pieces_)
    return shards


def _found(block: Block, shards: list, slop: int):
    """(shard, grams, first words, last words) of each slice of matches; workers hold one shard of several at a time."""
    for shard in shards:
        value = shard.value
        for gram, start, end in block.matches(value[0], value[1], slop):
            if len(gram):
                yield value, gram, start, end
        if len(shards) > 1:
            shard.__dict__.pop("_value", None)


def _blocks(batches):
    for ids, n_words, *lists in ((row for cols in rows_of(batches, ("doc_ids", "n_words", "terms", "counts", "places")) for row in zip(*cols))):
        yield ids, np.asarray(n_words, np.int64), Block(n_words, *lists)


def matches(indexed: DataFrame, items: DataFrame, width: int = 10, slop: int = 0) -> DataFrame:
    """(doc_id, item_id as string, gram_words, first_word, last_word): where phrases of the items occur in documents.

    A phrase is `width` consecutive words of an item, or all words of a shorter one. It matches where its words follow
    each other in order within `slop` words more than it has: exactly at slop 0, by proximity above. A proximity match
    starts at its first word and ends as early as it can. Words are numbered from 0 in their document.
    """
    shards = _shards(indexed.sparkSession, items, width)

    def run(batches):
        for ids, _, block in _blocks(batches):
            for (_, sizes, ptr, owners), gram, start, end in _found(block, shards, slop):
                doc, n = block.doc_of(start), ptr[gram + 1] - ptr[gram]
                at = np.repeat(np.arange(len(gram)), n)
                item = owners[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + ptr[gram][at]]
                columns = [pa.array([ids[d] for d in doc[at]], pa.int64()), pa.array(list(item), pa.string()), *[pa.array(v[at].astype(np.int64)) for v in (sizes[gram], start - block.cuts[doc], end - block.cuts[doc])]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "gram_words", "first_word", "last_word"])

    return mapped(indexed, run, "doc_id long, item_id string, gram_words long, first_word long, last_word long").distinct()


def contamination(indexed: DataFrame, items: DataFrame, width: int = 10, slop: int = 0) -> DataFrame:
    """doc_id, n_words, n_hit (words inside a match), n_items, items_sha256 and contaminated for every indexed document.

    Null and empty texts have no words and hit nothing; rows that repeat a doc_id are documents of their own, rows without
    doc_id too. Items that repeat an id count once; items without one hit words but are neither counted nor named.
    Empty tables give no rows, or rows without hits; extra columns are left behind.
    """
    shards = _shards(indexed.sparkSession, items, width)

    def run(batches):
        for ids, n_words, block in _blocks(batches):
            edges = np.zeros(block.words + 1, np.int32)
            named = {}
            for (_, _, ptr, owners), gram, start, end in _found(block, shards, slop):
                np.add.at(edges, start, 1)
                np.add.at(edges, end + 1, -1)
                for doc, g in np.unique(np.stack([block.doc_of(start), gram]), axis=1).T.tolist():
                    named.setdefault(doc, set()).update(owners[ptr[g] : ptr[g + 1]])
            covered = np.r_[0, np.cumsum(np.cumsum(edges[:-1]) > 0)]
            hit = covered[block.cuts[1:]] - covered[block.cuts[:-1]]
            named = [sorted(named.get(d, set()) - {None}) for d in range(len(ids))]
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in named]
            columns = [pa.array(ids, pa.int64()), pa.array(n_words), pa.array(hit), pa.array([len(x) for x in named], pa.int64()), pa.array(digest), pa.array(hit > 0)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return mapped(indexed, run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


#: DuckDB SQL for contamination() with its defaults.
CONTAMINATION_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
gram AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS gram
  FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0),
hit AS (
  SELECT r, i, size, item_id
  FROM (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram
    FROM doc, unnest(range(1, len(w) + 1)) t(i), (SELECT DISTINCT size FROM gram) WHERE i + size - 1 <= len(w))
  JOIN gram USING (size, gram)),
words AS (SELECT r, count(DISTINCT i + k) AS n FROM hit, unnest(range(0, size)) t(k) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY encode(item_id::VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""
