"""I-Match fingerprints: terms of a document-frequency band, sorted, hashed over randomised lexicon subsets."""

from __future__ import annotations

import hashlib
import math
import tempfile
from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOBS, blob_batch, bucket_records, chunks_of, dealt, documents, dropped, group_starts, mapped, mix64, n_buckets, pieces, split_by_bucket, stored
from .rolling import Rolling, code_points, lower_ascii, words_of

#: Terms are kept whose share of documents lies in the band, that is ln(5) <= idf <= ln(2000).
BAND = (0.0005, 0.2)
#: Randomised subsets per rate; the rates kept are the three powers of 1/2 around one term a subset.
SUBSETS = 32
#: Terms of one shard of the lexicon (8 bytes each), the most that passes through the driver at once.
SHARD = 2_000_000
_ODD = (mix64(np.arange(1, SUBSETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1))[None, :]


def term_ids(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct term ids (64-bit hashes) of each text; a term is a word in ASCII lower case."""
    out = []
    for s, e in pieces(texts):
        codes, starts = code_points(texts[s:e])
        ws, we = words_of(codes, starts)
        ids = Rolling(lower_ascii(codes)).slices(ws, we)
        at = np.searchsorted(ws, starts)
        out += [np.unique(ids[a:b]) for a, b in zip(at[:-1], at[1:])]
    return out


class Lexicon:
    """Sorted term ids in shards that cover ranges of ids. One shard is used as it comes; several are kept as files in
    the worker's own temporary folder and memory-mapped, so a worker holds none of them whole."""

    def __init__(self, shards: list):
        self.shards = shards  # broadcast variables

    def inside(self, terms: np.ndarray) -> np.ndarray:
        """The terms (sorted) that the lexicon has."""
        cuts = np.searchsorted(terms, _shard_starts(len(self.shards)))
        found = []
        for k, (s, e) in enumerate(zip(cuts, [*cuts[1:], len(terms)])):
            known, part = self._shard(k), terms[s:e]
            if len(known) and len(part):
                at = np.minimum(np.searchsorted(known, part), len(known) - 1)
                found.append(part[known[at] == part])
        return np.concatenate(found) if found else terms[:0]

    def _shard(self, k: int) -> np.ndarray:
        return self.shards[0].value if len(self.shards) == 1 else _mapped_shard(self.shards[k])


def _shard_starts(n: int) -> np.ndarray:
    return np.array([(k << 64) // n for k in range(n)], np.uint64)


@lru_cache(4096)
def _mapped_shard(shard) -> np.ndarray:
    place = tempfile.NamedTemporaryFile(suffix=".npy")
    np.save(place, shard.value)
    place.flush()
    shard.__dict__.pop("_value", None)  # read again from disk if ever needed
    return np.load(place.name, mmap_mode="r")  # the map outlives the file's name


TERM = np.dtype([("t", "<u8"), ("n", "<u4")])


def lexicon(docs: DataFrame, band=BAND, shard: int = SHARD) -> Lexicon:
    """The terms whose document frequency, counted over all documents, lies in the band.

    At most (mean distinct terms a document) / band[0] terms can reach the lower bound, whatever the number of
    documents, so the list keeps its size as the corpus grows: 8 bytes a term, some 3 MB for 200 terms a document. Where
    documents are long and the list is more than a shard, it goes out in shards of ids, one after the other.
    """
    n, nb = docs.count(), n_buckets(docs)

    def count(batches):
        for (texts,) in chunks_of(batches, ("text",), "text", 12_000_000):
            ids, counts = np.unique(np.concatenate(term_ids(texts)), return_counts=True)
            rec = np.empty(len(ids), TERM)
            rec["t"], rec["n"] = ids, counts
            yield blob_batch(split_by_bucket(ids, nb, rec))

    def total(batches):
        for rec in bucket_records(batches, TERM):
            order = np.argsort(rec["t"])
            t, c = rec["t"][order], rec["n"][order].astype(np.int64)
            first = group_starts(t)
            df = np.add.reduceat(c, first)
            keep = (df >= max(2, band[0] * n)) & (df <= max(2, band[1] * n))
            yield pa.RecordBatch.from_arrays([pa.array(t[first][keep].view(np.int64))], names=["term"])

    terms = stored(mapped(dealt(mapped(docs.select("text"), count, BLOBS), nb), total, "term long"), "lexicon")
    k = max(1, -(-terms.count() // shard))
    starts = _shard_starts(k).astype(object).tolist()
    shards = []
    for lo, hi in zip(starts, [*starts[1:], 1 << 64]):
        # ids are unsigned, the column is signed: a range of the one is at most two of the other
        part = [(max(lo, a) - s, min(hi, b) - 1 - s) for a, b, s in ((0, 1 << 63, 0), (1 << 63, 1 << 64, 1 << 64)) if max(lo, a) < min(hi, b)]
        rows = terms.where(reduce(or_, [F.col("term").between(a, b) for a, b in part])).toArrow()
        shards.append(docs.sparkSession.sparkContext.broadcast(np.sort(rows.column("term").to_numpy().view(np.uint64))))
    dropped(terms)
    return Lexicon(shards)


def trace(terms: np.ndarray, known: Lexicon) -> tuple[int, np.ndarray]:
    """The rate exponent and 3 x SUBSETS 16-bit hashes of the sorted distinct terms that each subset keeps (0: none).
    With fewer than 8 terms in the lexicon, all terms of the text count."""
    band = known.inside(terms)
    if len(band) < 8:
        band = terms
    level = max(0, int(np.log2(len(band))) - 1) if len(band) else 0
    out = np.zeros((3, SUBSETS), np.uint16)
    if len(band):
        t = mix64(band)
        draw = t[:, None] * _ODD
        for k in range(3):
            cut = level + k
            inside = (draw >> np.uint64(64 - cut)) == 0 if cut else np.ones(draw.shape, bool)
            sums = (inside * t[:, None]).sum(axis=0, dtype=np.uint64)
            some = inside.any(axis=0)
            out[k] = np.where(some, (mix64(sums) >> np.uint64(48)).astype(np.uint16) | np.uint16(1), np.uint16(0))
    return level, out


def text_of(fingerprint) -> str:
    level, hashes = fingerprint
    return f"{level:02x}" + hashes.astype(">u2").tobytes().hex()


def likeness(a, b) -> float:
    """Share of the subsets, at the finest rate both have, that keep the same terms of both; 1 for equal ones."""
    if a[0] == b[0] and (a[1] == b[1]).all():
        return 1.0
    level = min(a[0], b[0]) + 2
    if level < max(a[0], b[0]):
        return 0.0
    x, y = a[1][level - a[0]], b[1][level - b[0]]
    either = int(((x != 0) | (y != 0)).sum())
    return float(((x == y) & (x != 0)).sum()) / either if either else 0.0


def fingerprints(docs: DataFrame, band=BAND) -> DataFrame:
    """doc_id, fingerprint for every row and whole text of docs. Null and empty texts share one fingerprint; equal
    texts have equal ones. An empty table gives an empty result; extra columns are left behind."""
    docs = documents(docs)
    known = lexicon(docs, band)

    def run(batches):
        for ids, texts in chunks_of(batches, ("doc_id", "text"), "text", 2_000_000):
            out = [text_of(trace(t, known)) for t in term_ids(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return mapped(docs, run, "doc_id long, fingerprint string")


def _bounds_below(value, bounds: list[int]):
    """How many of the sorted bounds a value reaches, by two searches of about the root of their number."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    every, heads = (F.split(F.lit(",".join(map(str, x))), ",").cast("array<long>") for x in (bounds, bounds[::step]))  # a constant
    reached = lambda x: F.size(F.filter(x, lambda b: b <= value))
    before = F.greatest(reached(heads) - 1, F.lit(0)) * step
    return before + reached(F.slice(every, before + 1, F.lit(step)))


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """docs dealt into ranges of doc_id and sorted downwards, each range followed by the head row of the next one
    (copy = 1; after the last range: the first), so that every row's successor comes right after it in its task."""
    ids = docs.where("doc_id is not null")
    bounds = ids.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else []
    bounds = sorted(set(bounds or []))
    part = F.when(F.col("doc_id").isNull(), -1).otherwise(_bounds_below(F.col("doc_id"), bounds))
    placed = docs.withColumn("part", part.cast("int"))
    heads = placed.groupBy("part").agg(F.max("doc_id").alias("doc_id")).orderBy(F.desc("part")).collect()  # a row a range
    to = [(h["doc_id"], heads[i - 1]["part"] if i else heads[-1]["part"]) for i, h in enumerate(heads)]
    if not to:
        return placed.withColumn("copy", F.lit(0))
    edge = docs.sparkSession.createDataFrame(to, "head long, to int")
    copies = placed.join(F.broadcast(edge), F.col("doc_id").eqNullSafe(F.col("head"))).withColumn("part", F.col("to")).drop("head", "to").withColumn("copy", F.lit(1))
    every = placed.withColumn("copy", F.lit(0)).unionByName(copies)
    return every.repartition(max(8, ranges // 2), "part").sortWithinPartitions("part", "copy", F.desc_nulls_last("doc_id"), "text")


def n_ranges(docs: DataFrame) -> int:
    """Ranges of doc_id: one for 4 MB of text, then, since each is a row on the driver, one for 256 MB past 4096. A range
    streams through its task row by row."""
    n = n_buckets(docs)
    return n if n <= 4096 else max(4096, n // 64)


def near_edits(docs: DataFrame, band=BAND) -> DataFrame:
    """Every row of docs with its fingerprint, that of its edited text, and the likeness of the first to the second and
    to the next document's. The edited text has its last floor(n/2) code points replaced by the first as many (or all)
    of the next document in descending doc_id; after the last comes the first, so a lone document is its own next.

    Null texts are empty. Null doc_ids come after all others; equal doc_ids go by text. Rows stay rows when repeated.
    """
    docs = documents(docs)
    known = lexicon(docs, band)
    columns = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def pairs(held):
        rows = held[:-1]
        texts = [r[1] for r in held]
        edits = []
        for (_, text, _), (_, after, _) in zip(rows, held[1:]):
            half = len(text) // 2
            edits.append(text[: len(text) - half] + after[:half])
        marks = [trace(t, known) for t in term_ids(texts)]
        edited = [trace(t, known) for t in term_ids(edits)]
        for i, (row, edit) in enumerate(zip(rows, edits)):
            if row[2]:
                continue
            digest = hashlib.sha256(edit.encode("utf-8", "surrogatepass")).hexdigest()
            yield row[0], len(row[1]), digest, text_of(marks[i]), text_of(edited[i]), likeness(marks[i], edited[i]), likeness(marks[i], marks[i + 1])

    def run(batches):
        held, size, part = [], 0, None

        def flush():
            out = list(pairs(held))
            names = [c.split(" ")[0] for c in columns.split(", ")]
            return [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2))], names=names)] if out else []

        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text", "copy", "part"))):
                if row[3] != part or size > 2_000_000:
                    yield from flush()
                    held = held[-1:] if row[3] == part else []
                    size, part = 0, row[3]
                held.append(row[:3])
                size += len(row[1])
        if held:
            yield from flush()

    return mapped(with_next(docs, n_ranges(docs)).select("doc_id", "text", "copy", "part"), run, columns)
