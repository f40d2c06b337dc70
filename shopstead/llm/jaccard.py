"""N-gram Jaccard join of documents: exact filters find who could link, signature trees decide who does."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOBS, blob_batch, bucket_records, chunks_of, dealt, dropped, mapped, marked, mix64, n_buckets, packed, pieces, stored, unpacked_chunks
from .components import components
from .rolling import Rolling, code_points, lower_ascii, words_of
from .sigtree import Block, links, overlap

#: Set elements that one side of a block may hold (8 bytes each); larger groups are cut into blocks.
BLOCK = 500_000
#: Sets whose elements are dealt out together: a blob numbers them by 16 bits.
DEALT = 20_000
#: Bytes of items that are read together; small pieces of work are read several at a time.
READ = 250_000
_CHARS = 16_000_000


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams; with fewer words, of the whole sequence as one."""
    codes, starts = code_points(texts)
    ws, we = words_of(codes, starts)
    words = Rolling(lower_ascii(codes)).slices(ws, we)
    at = np.searchsorted(ws, starts)
    line = Rolling(words)
    grams = line.grams(width)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            out.append(line.slices(np.array([a]), np.array([b])))
        else:
            out.append(grams[:0])
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the whole set."""
    a = mix64(s).sum(dtype=np.uint64)
    b = mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


#: Stands for the sets of a chunk that share an element.
_SEVERAL = np.int64(-(1 << 63))


def _deal(ids: list[int], sets: list[np.ndarray], nb: int, combine: bool = False):
    """Blobs of (element, set) by bucket of the element; each starts with the ids of the sets that occur in it and with
    a number for the chunk, where its counts are to meet again.

    combine: an element that several sets of the chunk have is counted for them here, in a blob past bucket nb, and
    dealt once for all of them, so that a shingle of most documents is a record a chunk.
    """
    assert len(ids) < 65_535  # sets of a blob are numbered by 16 bits
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    h = np.concatenate(sets)
    if not len(h):
        return
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    bucket = (((h >> np.uint64(32)) * np.uint64(nb)) >> np.uint64(32)).astype(np.int32)
    names = np.r_[np.array(ids, np.int64), _SEVERAL]
    if combine:
        order = np.argsort(h)
        again = np.r_[False, h[order][1:] == h[order][:-1]]
        several = again | np.r_[again[1:], False]
        counts = np.bincount(owner[order[several]], minlength=len(sets))
        some = np.flatnonzero(counts)
        if len(some):
            yield nb + int(ids[0]) % nb, np.int64(ids[0]).tobytes() + np.c_[names[some], counts[some]].astype(np.int64).tobytes()
        owner[order[several]] = len(sets)
        rest = order[~again]
        h, owner, bucket = h[rest], owner[rest], bucket[rest]
        order = np.lexsort((owner, bucket))
    else:
        order = np.argsort(bucket, kind="stable")
    bucket, owner, low = bucket[order], owner[order], (h[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    for s, e in zip(cuts[:-1], cuts[1:]):
        own = owner[s:e]
        new = np.r_[True, own[1:] != own[:-1]]
        local = (np.cumsum(new) - 1).astype(np.uint16)
        here = names[own[new]]
        yield int(bucket[s]), np.array([len(here), e - s, ids[0]], np.int64).tobytes() + here.tobytes() + low[s:e].tobytes() + local.tobytes()


def _shared_counts(blobs: list[bytes]):
    """Of the sets in one bucket's blobs: how many of their elements occur in another set, too; by chunk."""
    heads = [np.frombuffer(x, np.int64, 3) for x in blobs]
    low = np.concatenate([np.frombuffer(x, np.uint32, n, 24 + 8 * m) for x, (m, n, _) in zip(blobs, heads)])
    base = np.cumsum([0] + [int(h[0]) for h in heads])
    own = np.concatenate([np.frombuffer(x, np.uint16, n, 24 + 8 * m + 4 * n).astype(np.int32) + b for x, (m, n, _), b in zip(blobs, heads, base)])
    order = np.argsort(low, kind="stable")
    low = low[order]
    same = low[1:] == low[:-1]
    shared = np.r_[False, same] | np.r_[same, False]
    counts = np.bincount(own[order][shared], minlength=base[-1])
    for x, (m, _, chunk), b in zip(blobs, heads, base):
        c, names = counts[b : b + m], np.frombuffer(x, np.int64, m, 24)
        some = (c > 0) & (names != _SEVERAL)
        if some.any():
            yield int(chunk), np.c_[names[some], c[some]].astype(np.int64).tobytes()


_COUNTS = "bucket long, blob binary"


def _count_shared(blobs: DataFrame, nb: int) -> DataFrame:
    """(doc_id, shared): how many elements of each set another set has. Counts go back to their chunk as blobs, so that
    the rows between stages number chunks times buckets, not sets times buckets."""

    def count(batches):
        def out(pairs):
            pairs = list(pairs)
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.binary())], names=["bucket", "blob"])

        now, held = None, []
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b >= nb:  # counted in its chunk
                    yield out([(int(np.frombuffer(blob, np.int64, 1)[0]), blob[8:])])
                    continue
                if b != now and held:
                    yield out(_shared_counts(held))
                    held = []
                now = b
                held.append(blob)
        if held:
            yield out(_shared_counts(held))

    def total(batches):
        for pairs in bucket_records(batches, np.int64):
            pairs = pairs.reshape(-1, 2)
            ids, back = np.unique(pairs[:, 0], return_inverse=True)
            sums = np.zeros(len(ids), np.int64)
            np.add.at(sums, back, pairs[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums)], names=["doc_id", "shared"])

    met = mapped(dealt(blobs, 2 * nb), count, _COUNTS)
    back = mapped(met.repartition("bucket").sortWithinPartitions("bucket"), total, "doc_id long, shared long")
    return back.groupBy("doc_id").agg(F.sum("shared").alias("shared"))


def profile(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (set size), k1, k2 (set key), mark (of the text), a row a doc_id: that of its largest set."""

    def keys(batches):
        for ids, texts, marks in chunks_of(batches, ("doc_id", "text", "mark"), "text", 500_000):
            rows = np.array([(i, len(s), *set_key(s), m) for i, s, m in zip(ids, shingle_sets(texts, width), marks)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(5)], names=["doc_id", "n", "k1", "k2", "mark"])

    rows = mapped(docs.where("doc_id is not null"), keys, "doc_id long, n long, k1 long, k2 long, mark long")
    return rows.groupBy("doc_id").agg(F.max(F.struct("n", "k1", "k2", "mark")).alias("set")).select("doc_id", "set.*")


def _dealt_texts(docs: DataFrame, width: int, nb: int) -> DataFrame:
    def deal(batches):
        for ids, texts in chunks_of(batches, ("doc_id", "text"), "text", 8_000_000):
            for a in range(0, len(ids), DEALT):
                part = texts[a : a + DEALT]
                sets = [s for b, e in pieces(part) for s in shingle_sets(part[b:e], width)]
                yield blob_batch(_deal(ids[a : a + DEALT], sets, nb, combine=True))

    return mapped(docs.where("doc_id is not null"), deal, BLOBS)


def _dealt_sets(sets: DataFrame, nb: int) -> DataFrame:
    def deal(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, DEALT):
                part = batch.slice(a, DEALT)
                yield blob_batch(_deal(part.column(0).to_pylist(), [np.frombuffer(x, np.uint64) for x in part.column(1).to_pylist()], nb))

    return mapped(sets.select("doc_id", "items"), deal, BLOBS)


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, items): the sets of the wanted (doc_id, mark), a row each, as the bytes of a sorted array. Texts come
    to the wanted ids compressed, by one shuffle at every size: the ids grow with the corpus, so they are not broadcast."""

    def run(batches):
        for ids, texts in unpacked_chunks(batches, 500_000):
            sets = shingle_sets(texts, width)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "n", "items"])

    texts = docs.select("doc_id", "mark", packed("text").alias("z")).hint("merge").join(wanted, ["doc_id", "mark"])
    once = texts.groupBy("doc_id", "mark").agg(F.first("z").alias("z"))  # a row that comes twice; no shuffle of its own
    return mapped(once.select("doc_id", "z"), run, "doc_id long, n long, items binary")


def _rivals(sets: DataFrame, num: int, den: int, nb: int) -> DataFrame:
    """(id, component): sets that share an element of their prefixes, directly or through others.

    Elements are ordered by the number of sets that have them, rarest first, then by hash. A set's prefix is its first
    n - ceil(n * num / den) + 1 elements: two sets that reach the ratio share one, so links stay inside components.
    Passages that many sets share come last in the order, so they chain few sets together. Sets of whose elements too
    few occur elsewhere are out. Each element links its sets to the least of them, not to each other.
    """

    def frequencies(batches):
        def out(b, blobs):
            heads = [np.frombuffer(x, np.int64, 3) for x in blobs]
            low = np.concatenate([np.frombuffer(x, np.uint32, n, 24 + 8 * m) for x, (m, n, _) in zip(blobs, heads)])
            _, back, df = np.unique(low, return_inverse=True, return_counts=True)
            df = np.minimum(df[back], 65535).astype(np.uint16)
            ends = np.cumsum([0] + [int(h[1]) for h in heads])
            pairs = [(int(h[2]), np.int64(b).tobytes() + x + df[s:e].tobytes()) for x, h, s, e in zip(blobs, heads, ends[:-1], ends[1:])]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.binary())], names=["bucket", "blob"])

        now, held = None, []
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b != now and held:
                    yield out(now, held)
                    held = []
                now = b
                held.append(blob)
        if held:
            yield out(now, held)

    def prefixes(batches):
        def out(blobs):
            ids, elements, dfs = [], [], []
            for x in blobs:
                b, m, n, _ = (int(v) for v in np.frombuffer(x, np.int64, 4))
                at = 32 + 8 * m
                ids.append(np.frombuffer(x, np.int64, m, 32)[np.frombuffer(x, np.uint16, n, at + 4 * n)])
                elements.append((np.uint64(b) << np.uint64(32)) | np.frombuffer(x, np.uint32, n, at).astype(np.uint64))
                dfs.append(np.frombuffer(x, np.uint16, n, at + 6 * n))
            ids, elements, dfs = np.concatenate(ids), np.concatenate(elements), np.concatenate(dfs)
            order = np.lexsort((elements, dfs, ids))
            ids, elements, dfs = ids[order], elements[order], dfs[order]
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            n = np.diff(np.r_[first, len(ids)])
            enough = np.add.reduceat((dfs > 1).astype(np.int64), first) * den >= n * num
            length = np.where(enough, n + (-n * num) // den + 1, 0)
            place = np.arange(len(ids)) - np.repeat(first, n)
            take = (place < np.repeat(length, n)) & (dfs > 1)
            return pa.RecordBatch.from_arrays([pa.array(elements[take].view(np.int64)), pa.array(ids[take])], names=["element", "id"])

        now, held = None, []
        for batch in batches:
            for c, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if c != now and held:
                    yield out(held)
                    held = []
                now = c
                held.append(blob)
        if held:
            yield out(held)

    counted = mapped(dealt(_dealt_sets(sets, nb), nb), frequencies, _COUNTS)
    rows = stored(mapped(counted.repartition("bucket").sortWithinPartitions("bucket"), prefixes, "element long, id long"), "prefixes")
    least = rows.groupBy("element").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = components(rows.join(least, "element").select("id", "least").where("id != least").distinct(), "id", "least")
    found = stored(found, "rivals")
    dropped(rows)
    return found


def stored_sets(items: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in items]


def _solved(placed: DataFrame, num: int, den: int, read) -> DataFrame:
    """(a, b, large) links of pieces of work: rows (component, one, two, side, doc_id, items) of one key are compared
    with each other where one is two, else those of one side with those of the other."""

    def run(batches):
        def solve(key, rows, sets):
            large = LARGE <= key[1] < REST
            if len(rows) == 2:
                (_, a, _), (_, b, _) = rows
                n, common = len(sets[0]) + len(sets[1]), 0
                if den * min(map(len, sets)) >= num * max(map(len, sets)):
                    common = overlap(*sets)
                return [(a, b, large)] if den * common >= num * (n - common) else []
            sides = {}
            for (side, i, _), s in zip(rows, sets):
                ids, kept = sides.setdefault(side, ([], []))
                ids.append(i)
                kept.append(s)
            blocks = [Block(*x) for x in sides.values()]
            return [(a, b, large) for a, b in links(blocks[0], blocks[-1], num, den)]

        def solved(pieces):
            sets = read([items for _, rows in pieces for _, _, items in rows])
            at = 0
            for key, rows in pieces:
                yield from solve(key, rows, sets[at : at + len(rows)])
                at += len(rows)

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "large"])

        now, held, ready, size, out = None, [], [], 0, []

        def whole():
            """Whether the piece at hand has something to compare."""
            return len(held) > 1 and len({side for side, _, _ in held}) == (1 if now[1] == now[2] else 2)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != now:
                    if whole():
                        ready.append((now, held))
                        size += sum(len(items) for _, _, items in held)
                        if size >= READ:
                            out += solved(ready)
                            ready, size = [], 0
                    now, held = row[:3], []
                held.append(row[3:])
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        if whole():
            ready.append((now, held))
        if ready:
            out += solved(ready)
        if out:
            yield batch_of(out)

    keys = ["component", "one", "two"]
    dealt_out = placed.select(*keys, "side", "doc_id", "items").repartition(*keys).sortWithinPartitions(*keys)
    return mapped(dealt_out, run, "a long, b long, large boolean")


#: Groups of up to FEW blocks are compared block by block; larger ones in two passes.
FEW = 4
#: Pieces of work are numbered (one, two): two blocks of a group of few; from LARGE on, a block of a large group and the
#: same again; from REST on, a block of the largest component and a part of what is left over, or, from 2 * REST on, two
#: such parts.
LARGE, REST = 1 << 40, 1 << 41


def tree_links(sets: DataFrame, rivals: DataFrame, num: int, den: int = 100, read=stored_sets) -> DataFrame:
    """(a, b) links that connect what the ratio connects; read turns the items of rows into sorted distinct elements.

    A group of rivals is cut by hash into blocks of some BLOCK elements. Of a group of few blocks each pair is one piece
    of work. A large group is cut in two ways that mix each other's blocks, and each block is compared with itself; that
    connects most of what is alike. What is not in the group's largest component by then is compared with that and
    with itself. A link between two components has an end outside the largest, so none is lost, and in a group of near
    copies the pieces number blocks times parts of what is left over, not blocks squared.
    """
    c = F.col
    none = F.lit(0).cast("long")
    sized = sets.select("doc_id", "n").join(rivals.withColumnRenamed("id", "doc_id"), "doc_id")
    groups = sized.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"), F.count("*").alias("members")).where("members > 1").drop("members")
    mine = stored(sized.join(groups, "component").withColumn("block", F.pmod(F.xxhash64("doc_id"), c("blocks"))), "groups")
    large = mine.where(c("blocks") > FEW)

    def pairs_of(rows, block, blocks, base):
        other = rows.withColumn("other", F.explode(F.sequence(none, blocks - 1)))
        return other.select("doc_id", "component", (F.least(block, "other") + base).alias("one"), (F.greatest(block, "other") + base).alias("two"), block.alias("side"))

    ways = F.array(c("block") + LARGE, F.pmod(F.xxhash64("doc_id", F.lit(1)), c("blocks")) + (LARGE + (LARGE >> 1)))
    twice = large.withColumn("one", F.explode(ways)).select("doc_id", "component", "one", c("one").alias("two"), none.alias("side"))
    first = pairs_of(mine.where(c("blocks") <= FEW), c("block"), c("blocks"), none).unionByName(twice)
    found = stored(_solved(sets.join(first, "doc_id"), num, den, read), "links")
    if large.isEmpty():
        dropped(mine)
        return found.select("a", "b")
    label = F.coalesce("label", "doc_id")
    by_now = components(found.where("large").select("a", "b")).select(c("id").alias("doc_id"), c("component").alias("label"))
    named = stored(large.join(by_now, "doc_id", "left").withColumn("label", label), "labels")
    dropped(by_now, mine)
    count = named.groupBy("component", "label").agg(F.count("*").alias("k"))
    most = count.groupBy("component").agg(F.max_by("label", F.struct("k", "label")).alias("most"))
    sides = stored(named.join(most, "component").withColumn("rest", c("label") != c("most")), "sides")
    cut = sides.where("rest").groupBy("component").agg(F.ceil(F.sum("n") / BLOCK).alias("parts"))
    sides = sides.join(cut, "component").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(2)), c("parts")))
    rest = sides.where("rest")
    left = sides.where("not rest").withColumn("part", F.explode(F.sequence(none, c("parts") - 1)))
    right = rest.withColumn("block", F.explode(F.sequence(none, c("blocks") - 1)))
    again = pairs_of(rest, c("part"), c("parts"), F.lit(2 * REST))
    for k, x in enumerate((left, right)):
        again = again.unionByName(x.select("doc_id", "component", (c("block") + REST).alias("one"), c("part").alias("two"), F.lit(k).cast("long").alias("side")))
    return found.unionByName(_solved(sets.join(again, "doc_id"), num, den, read)).select("a", "b")


def ngram_join(docs: DataFrame, width: int, num: int, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, a row a doc_id: documents link when den * |intersection| >= num * |union| of
    their sets of word n-grams (ASCII lower case; words are runs of no ASCII white space).

    1. Elements are dealt by hash; a document can link only if at least num/den of its elements occur elsewhere.
    2. Of those, equal sets become one, and the same test is made again among what is left; sets that share an element
       of their rarest ones form groups that no link leaves.
    3. In each group signature trees prune by greatest possible overlap, exact intersections decide, and found links
       are merged by distributed connected components.
    No link between different sets is lost; within a group, pairs already connected are not compared again.

    Null or empty texts have no elements, size 0 and component doc_id. Rows that repeat a doc_id count once, as the one
    with the largest set; rows without doc_id are left out, and so are extra columns. Empty tables give empty results.
    """
    docs = marked(docs)
    nb = n_buckets(docs, _CHARS)
    known = stored(profile(docs, width), "profile")
    shared = _count_shared(_dealt_texts(docs, width, nb), nb)
    enough = F.col("shared") * den >= F.col("n") * num
    near = known.join(shared, "doc_id").where(enough)
    classes = stored(near.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "mark")).alias("one")).select("k1", "k2", "one.*"), "classes")
    sets = stored(_sets_of(docs, classes.select("doc_id", "mark"), width), "sets")
    rivals = _rivals(sets, num, den, nb)
    joined = components(tree_links(sets, rivals, num, den))
    dropped(sets, rivals)
    roots = classes.join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("k1", "k2", F.coalesce("component", "doc_id").alias("component_id"))
    return known.join(roots, ["k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
