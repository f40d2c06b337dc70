"""Line dedup: MinHash bands over character shingles, exact Jaccard similarity, one line kept a component."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOBS, blob_batch, chunks_of, dealt, dropped, mapped, marked, mix64, n_buckets, packed, pieces, split_by_bucket, stored, unpacked
from .components import components
from .jaccard import tree_links
from .rolling import Rolling, code_points, is_space, lower_ascii

#: Characters of a shingle; lines link at a Jaccard similarity of NUM / 100 or more.
SHINGLE, NUM = 8, 80
#: BANDS bands of ROWS hashes: a pair at similarity 0.8 meets with probability 1 - (1 - 0.8**4)**10 = 0.995.
BANDS, ROWS = 10, 4
#: Lines with fewer visible characters are left alone: blank ones. Those shorter than a shingle link only when equal.
VISIBLE = 1
_CHARS = 16_000_000
_seeds = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
_XOR, _MUL = (_seeds >> np.uint64(32)).astype(np.uint32), (_seeds & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
BAND, PLACE = np.dtype([("g", "<u8"), ("k", "<u8")]), np.dtype([("k", "<u8"), ("d", "<i8"), ("m", "<i8"), ("l", "<i4")])


class Lines:
    """The lines of some texts: where each starts and ends, its text, its number in it, and a 64-bit key of it."""

    def __init__(self, texts: list[str]):
        self.codes, starts = code_points(texts)
        breaks = np.flatnonzero(self.codes == 10)
        cuts = np.sort(np.r_[starts[:-1], breaks + 1])
        # a text that ends in a line break is followed by a start of its own: an empty last line
        self.start = cuts
        self.text = np.searchsorted(starts[:-1], breaks, side="right") - 1
        order = np.argsort(np.r_[starts[:-1], breaks + 1], kind="stable")
        self.text = np.r_[np.arange(len(texts)), self.text][order]
        regroup = np.argsort(self.text, kind="stable")  # an empty last line and the next text may start at one place
        self.start, self.text = self.start[regroup], self.text[regroup]
        last = np.r_[self.text[1:] != self.text[:-1], True]
        self.end = np.where(last, starts[1:][self.text], np.r_[self.start[1:], 0] - 1)
        first = np.flatnonzero(np.r_[True, self.text[1:] != self.text[:-1]])
        self.number = np.arange(len(self.text)) - np.repeat(first, np.diff(np.r_[first, len(self.text)]))
        seen = np.r_[0, np.cumsum(~is_space(self.codes))]
        self.counts = seen[self.end] - seen[self.start] >= VISIBLE
        self.keys = Rolling(self.codes).slices(self.start, self.end)


def shingles(lines: Lines) -> np.ndarray:
    """A 32-bit hash of each run of SHINGLE characters (fixed constants of the murmur3 finaliser)."""
    codes = lower_ascii(lines.codes)
    n = max(0, len(codes) - SHINGLE + 1)
    h = np.zeros(n, np.uint32)
    for k in range(SHINGLE):
        h *= np.uint32(0x9E3779B1)
        h += codes[k : n + k]
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


def band_keys(lines: Lines, which: np.ndarray) -> np.ndarray:
    """A key for each band of each of the chosen lines."""
    grams = np.r_[shingles(lines), np.zeros(SHINGLE + 1, np.uint32)]
    ranges = np.c_[lines.start[which], lines.end[which] - SHINGLE + 1].ravel()
    least = np.empty((BANDS, ROWS, len(which)), np.uint32)
    spare = np.empty_like(grams)
    for k in range(BANDS * ROWS):
        np.bitwise_xor(grams, _XOR[k], out=spare)
        np.multiply(spare, _MUL[k], out=spare)
        least[k // ROWS, k % ROWS] = np.minimum.reduceat(spare, ranges)[::2]
    out = np.zeros((BANDS, len(which)), np.uint64)
    for r in range(ROWS):
        place = (np.arange(r, BANDS * ROWS, ROWS, dtype=np.uint64) + np.uint64(1)) << np.uint64(32)
        out = mix64(out ^ (least[:, r] + place[:, None]))
    return np.ascontiguousarray(out.T)


#: What the survey finds. FIRST: the first place of a line (key, doc_id, mark, line). REPEAT: a place that an equal line
#: precedes. RIVAL: a line (key) that shares a band with others; `other` is the least of them, mark names them all.
FIRST, REPEAT, RIVAL = range(3)
FOUND = "kind int, key long, other long, doc_id long, mark long, line int"


def _found(kind: int, **cols) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    kinds = (("key", pa.int64()), ("other", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("line", pa.int32()))
    arrays = [pa.array(np.ascontiguousarray(cols[c]).view(np.int64) if t == pa.int64() else cols[c], t) if c in cols else pa.nulls(n, t) for c, t in kinds]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *arrays], names=["kind", *(c for c, _ in kinds)])


def _first_places(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each line, and all others; a row that comes twice has each place once."""
    rec = rec[np.lexsort((rec["l"], rec["m"], rec["d"], rec["k"]))]
    if not len(rec):
        return rec, rec
    new = np.r_[True, rec["k"][1:] != rec["k"][:-1]]
    later = ~new
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    for c in ("d", "m", "l"):
        same = rec[c] == rec[c][first] if c == "d" else same & (rec[c] == rec[c][first])
    return rec[new], rec[later & ~same]


def survey(docs: DataFrame) -> DataFrame:
    """FOUND rows for the lines of docs that are not blank. A chunk passes each line on once, with its first place in
    it, so a line that most documents have is no more than a record a chunk for the task that collects it."""
    nb = n_buckets(docs, _CHARS)

    def deal(batches):
        for ids, texts, marks in chunks_of(batches, ("doc_id", "text", "mark"), "text", 1_000_000):
            keys, bands, places = [], [], []
            for a, b in pieces(texts):
                lines = Lines(texts[a:b])
                use = np.flatnonzero(lines.counts)
                if not len(use):
                    continue
                rec = np.empty(len(use), PLACE)
                rec["k"], rec["l"] = lines.keys[use], lines.number[use]
                rec["d"], rec["m"] = (np.array(x[a:b], np.int64)[lines.text[use]] for x in (ids, marks))
                places.append(rec)
                use = use[lines.end[use] - lines.start[use] >= SHINGLE]
                if not len(use):
                    continue
                at = np.sort(np.unique(lines.keys[use], return_index=True)[1])
                keys.append(lines.keys[use[at]])
                bands.append(band_keys(lines, use[at]))
            if not places:
                continue
            rec = np.empty(0, BAND)
            if keys:
                keys, at = np.unique(np.concatenate(keys), return_index=True)
                rec = np.empty(len(keys) * BANDS, BAND)
                rec["g"], rec["k"] = np.concatenate(bands)[at].ravel(), np.repeat(keys, BANDS)
            first, again = _first_places(np.concatenate(places))
            found = [(nb + b, x) for b, x in split_by_bucket(np.ascontiguousarray(first["k"]), nb, first)]
            if len(again):
                found.append((2 * nb + int(again["k"][0] % np.uint64(nb)), again.tobytes()))
            yield blob_batch([*split_by_bucket(np.ascontiguousarray(rec["g"]), nb, rec), *found])

    def rivals(blobs):
        every = np.frombuffer(b"".join(blobs), BAND)
        groups = []
        part = (every["g"] & np.uint64(7)).astype(np.uint8)  # an eighth of the bands at a time
        for j in range(8):
            rec = every[part == j]
            g, k = np.ascontiguousarray(rec["g"]), np.ascontiguousarray(rec["k"]).view(np.int64)
            order = np.lexsort((k, g))
            g, k = g[order], k[order]
            new = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, bool)
            once = new | np.r_[True, k[1:] != k[:-1]] if len(g) else new  # chunks repeat a line
            g, k, new = g[once], k[once], new[once]
            first = np.flatnonzero(new)
            size = np.diff(np.r_[first, len(k)])
            if not (size > 1).any():
                continue
            name = np.add.reduceat(mix64(k.view(np.uint64)), first)  # bands of the same lines have one name
            some = np.unique(np.where(size > 1, name, 0), return_index=True)[1]
            some = some[size[some] > 1]
            taken = np.isin(np.repeat(np.arange(len(first)), size), some)
            groups.append([x[taken] for x in (k, np.repeat(k[first], size), np.repeat(name, size))])
        for key, least, name in groups:
            yield _found(RIVAL, key=key, other=least, mark=name)

    def meet(batches):
        def solved():
            if now < nb:
                yield from rivals(held)
                return
            first, again = _first_places(np.frombuffer(b"".join(held), PLACE))
            yield _found(FIRST, key=first["k"], doc_id=first["d"], mark=first["m"], line=first["l"])
            yield _found(REPEAT, doc_id=again["d"], mark=again["m"], line=again["l"])

        now, held = None, []
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b >= 2 * nb:
                    rec = np.frombuffer(blob, PLACE)
                    yield _found(REPEAT, doc_id=rec["d"], mark=rec["m"], line=rec["l"])
                    continue
                if b != now and held:
                    yield from solved()
                    held = []
                now = b
                held.append(blob)
        if held:
            yield from solved()

    return mapped(dealt(mapped(docs.where("doc_id is not null"), deal, BLOBS), 3 * nb), meet, FOUND)


def _shingle_sets(items: list[bytes]) -> list[np.ndarray]:
    out = []
    for a, b in pieces(items):
        codes, starts = code_points([x.decode("utf-8", "surrogatepass") for x in items[a:b]])
        grams = Rolling(codes).grams(SHINGLE)
        for s, e in zip(starts[:-1].tolist(), (starts[1:] - SHINGLE + 1).tolist()):
            part = grams[s:e]
            part.sort()
            new = np.empty(len(part), bool)
            new[:1] = True
            np.not_equal(part[1:], part[:-1], out=new[1:])
            out.append(part[new])
    return out


_LOWER = {c: c + 32 for c in range(65, 91)}


def _wanted_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, n, items) as tree_links takes them, for the wanted (key, doc_id, mark, line): here doc_id is the line's
    key and items its text, which is smaller than its shingles."""

    def run(batches):
        for batch in batches:
            out = []
            for z, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = unpacked(z).decode("utf-8", "surrogatepass").split("\n")
                for x in want:
                    text = lines[x["line"]].translate(_LOWER)
                    out.append((x["key"], len(text), text.encode("utf-8", "surrogatepass")))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "n", "items"])

    per_doc = wanted.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("key", "line")).alias("want"))
    texts = docs.select("doc_id", "mark", packed("text").alias("z")).join(per_doc, ["doc_id", "mark"]).select("z", "want")
    return mapped(texts, run, "doc_id long, n long, items binary")


#: Lines of a component of bands that are all compared with each other; those of a larger one, only within their bands.
TOGETHER = 500


def _rivals(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """(id, component) as tree_links takes them. Bands chain lines that are not alike, and the more lines there are, the
    longer the chains: past some size most lines hang together. So a large component falls back into its bands, which
    hold all pairs that are to be compared; a line is then in as many groups as it shares bands with different lines."""
    large = lines.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > TOGETHER).select("component")
    apart = lines.join(large, "component", "left_semi").select(F.col("id").alias("key"))
    bands = shared.join(apart, "key", "left_semi").select(F.col("key").alias("id"), F.col("mark").alias("component")).distinct()
    return lines.join(large, "component", "left_anti").select("id", "component").unionByName(bands)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, lines): numbers of the lines to drop in each document of docs (see marked) that has any. Lines are
    one when equal, or when links of similarity >= 0.8 lead from one to the other; the occurrence with the least
    (doc_id, mark, number) stays."""
    found = stored(survey(docs), "lines")
    firsts = found.where(F.col("kind") == FIRST).select("key", "doc_id", "mark", "line")
    shared = stored(found.where(F.col("kind") == RIVAL).select("key", "other", "mark").distinct(), "bands")
    lines = components(shared.select("key", "other"), "key", "other")
    wanted = lines.select(F.col("id").alias("key")).join(firsts, "key")
    sets = stored(_wanted_lines(docs, wanted), "sets")
    rivals = stored(_rivals(lines, shared), "rivals")
    dropped(lines, shared)
    joined = components(tree_links(sets, rivals, NUM, read=_shingle_sets))
    dropped(sets, rivals)
    # a class keeps its least place; the anti-join goes by place, so a large class is spread over all tasks
    members = stored(joined.select(F.col("id").alias("key"), "component").join(firsts, "key").select("component", "doc_id", "mark", "line"), "members")
    dropped(joined)
    place = ["doc_id", "mark", "line"]
    keeps = members.groupBy("component").agg(F.min(F.struct(*place)).alias("keep")).select("keep.*")
    drops = members.select(*place).join(keeps, place, "left_anti").unionByName(found.where(F.col("kind") == REPEAT).select(*place))
    return drops.groupBy("doc_id", "mark").agg(F.collect_set("line").alias("lines"))


def dedup_lines(docs: DataFrame, digest=None, columns: str = "kept string") -> DataFrame:
    """Every row of docs (all its columns) with `kept`, its text without the lines that repeat_lines drops, and
    n_dropped, their number; with digest, a function of the kept text, the values of `columns` instead of kept.

    Lines end at line feeds; those without visible characters always stay, those shorter than SHINGLE characters are
    compared by equality alone. Null and empty texts stay as
    they are (kept is empty). Rows without doc_id are left whole and not compared. Rows that repeat a doc_id and the
    text lose the same lines, not each other's; those that repeat a doc_id with another text are documents of their own.
    Empty tables give empty results; extra columns pass through, columns of docs that have the names
    of new ones are replaced.
    """
    new = [c.strip().split(" ")[0] for c in columns.split(",")]
    passed = [c for c in docs.columns if c not in (*new, "n_dropped", "text")]
    drops = repeated_lines(marked(docs)).select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), F.col("lines").alias("_lines"))
    texts = docs.select(*passed, F.xxhash64(F.coalesce("text", F.lit(""))).alias("_of"), packed("text").alias("_z"))
    joined = texts.join(drops, (F.col("doc_id") == F.col("_doc")) & (F.col("_of") == F.col("_mark")), "left").select(*passed, "_z", "_lines")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*passed).schema)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            out, n, whole = [], [], []
            for z, lines in zip(batch.column(len(passed)).to_pylist(), batch.column(len(passed) + 1).to_pylist()):
                text = unpacked(z).decode("utf-8", "surrogatepass")
                whole.append(None if z is None else text)
                if lines:
                    gone = set(lines)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
                n.append(len(lines or ()))
                out.append(digest(text) if digest else (text,))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(passed)], pa.array(whole, pa.string()), pa.array(n, pa.int64()), *map(pa.array, zip(*out))], names=[*passed, "text", "n_dropped", *new])

    return mapped(joined, run, f"{schema}, text string, n_dropped long, {columns}")


def kept_sha256(text: str) -> tuple[str]:
    return (hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),)
