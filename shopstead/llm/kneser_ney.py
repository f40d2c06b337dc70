"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, memory-mapped."""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOBS, blob_batch, chunks_of, dealt, documents, mapped, mix64, n_buckets, pieces, shared_dir, split_by_bucket
from .rolling import Rolling, code_points, lower_ascii, words_of

#: Stand-ins for the start of a text (only ever a context) and its end (a token like others).
START, END = np.uint64(0x5354415254000001), np.uint64(0x454E440000000001)
#: Characters of text that one shard of the bigram table stands for, and one of the word table.
PAIR_CHARS, WORD_CHARS = 16_000_000, 100_000_000
#: Different bigrams that a task holds while it sums them before the shuffle.
HELD = 1_000_000
#: Characters that a task works on at once.
CHUNK = 1_500_000
#: Contexts that may be spread over all shards, at most: a context left out is less than a millionth of all tokens, so
#: the list stays below 8 MB and no shard gets more than that share on top of its own.
MOST_COMMON = 1_000_000
#: One document in SAMPLED is looked at to find contexts so common that their bigrams are spread over all shards. It
#: decides only where a bigram is kept, never what is counted.
SAMPLED = 64
PAIR = np.dtype([("v", "<u8"), ("w", "<u8"), ("c", "<u4")])
AFTER = np.dtype([("k", "<u8"), ("total", "<u4"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4")])
BEFORE = np.dtype([("k", "<u8"), ("c", "<u4"), ("a", "<u4")])
#: A word's count, number of different words before it, count as context, and numbers of its bigrams seen 1, 2, 3+ times.
STATS = ("c", "a", "total", "n1", "n2", "n3")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """START, the words and END of each text in one array of hashes, and where each text's START is (end as last)."""
    parts, sizes = [], []
    for a, b in pieces(texts):
        codes, starts = code_points(texts[a:b])
        ws, we = words_of(codes, starts)
        parts.append(Rolling(lower_ascii(codes)).slices(ws, we))
        sizes.append(np.diff(np.searchsorted(ws, starts)))
    words, n = np.concatenate(parts), np.concatenate(sizes)
    at = np.r_[0, np.cumsum(n + 2)]
    out = np.empty(at[-1], np.uint64)
    out[at[:-1]], out[at[1:] - 1] = START, END
    out[np.arange(len(words)) + 2 * np.repeat(np.arange(len(n)), n) + 1] = words
    return out, at


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(v * np.uint64(0x9E3779B97F4A7C15) + w)


def shard_of(v: np.ndarray, key: np.ndarray, common: np.ndarray, nb: int) -> np.ndarray:
    """Bigrams go by their context, those of common contexts by their own hash."""
    by = np.where(np.isin(v, common), key, v)
    return (((by >> np.uint64(32)) * np.uint64(nb)) >> np.uint64(32)).astype(np.int32)


def _runs(a: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, mounted or not, and the folder's path in it."""
    if "://" in folder and not folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")


def _save(path: str, **arrays: np.ndarray) -> None:
    """Each array as path.name.npy, whole or not at all: a task that runs again writes the same file anew."""
    store, path = _store(path)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    for name, x in arrays.items():
        part = f"{path}.{name}.{uuid.uuid4().hex}.part"
        with store.open_output_stream(part) as f:
            np.lib.format.write_array_header_1_0(f, np.lib.format.header_data_from_array_1_0(x))
            f.write(np.ascontiguousarray(x).data)
        store.move(part, f"{path}.{name}.npy")


def _common(docs: DataFrame, nb: int) -> np.ndarray:
    """Contexts that make up more than 1 / (8 nb) of a sample; fewer than 8 nb by that, and than MOST_COMMON."""
    most = min(8 * nb, MOST_COMMON)

    def count(batches):
        for (texts,) in chunks_of(batches, ("text",), "text"):
            k, c = np.unique(tokens(texts)[0], return_counts=True)
            often = c > len(texts) / 64
            yield pa.RecordBatch.from_arrays([pa.array(k[often].view(np.int64)), pa.array(c[often])], names=["k", "c"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).select("text")
    rows = mapped(sample, count, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "k").limit(most).collect()
    total = sum(r["c"] for r in rows)
    return np.sort(np.array([r["k"] for r in rows if r["c"] * most > total and r["c"] > 20], np.int64).view(np.uint64))


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3+ from the numbers of things seen 1 to 4 times; safe where those are too few."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1:
        return 0.0, 0.0, 0.0
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.1), i) for i, d in zip((1.0, 2.0, 3.0), raw))


def train(docs: DataFrame) -> dict:
    """Counts docs (doc_id, text) and writes the model to the shared folder; returns its place and constants.

    Each task sums the bigrams of its chunk before the shuffle; a shard sums them over the corpus, is written as sorted
    arrays and passes on what words need: how often and in how many bigrams each occurs. Only a few totals a shard come
    to the driver.
    """
    spark = docs.sparkSession
    nb, nw = max(6, n_buckets(docs, PAIR_CHARS)), max(6, n_buckets(docs, WORD_CHARS))
    folder = f"{shared_dir(spark)}/kneser-ney-{uuid.uuid4().hex}"
    common = _common(docs, nb)

    def pairs(batches):
        def summed(held):
            keys, v, w, c = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(keys)
            runs = _runs(keys[order])
            first = order[runs]
            return keys[first], v[first], w[first], np.add.reduceat(c[order], runs)

        def out(keys, v, w, c):
            shard = shard_of(v, keys, common, nb)
            order = np.lexsort((v, shard))
            shard, v, w, c = shard[order], v[order], w[order], c[order].astype(np.uint32)
            cuts = np.r_[_runs(shard), len(shard)]
            return blob_batch((int(shard[s]), np.int64(e - s).tobytes() + v[s:e].tobytes() + w[s:e].tobytes() + c[s:e].tobytes()) for s, e in zip(cuts[:-1], cuts[1:]))

        held = []
        for (texts,) in chunks_of(batches, ("text",), "text", CHUNK):
            seq, at = tokens(texts)
            first = np.ones(len(seq), bool)
            first[at[1:] - 1] = False  # an END is not a context
            first = np.flatnonzero(first)
            keys, index, counts = np.unique(pair_hash(seq[first], seq[first + 1]), return_index=True, return_counts=True)
            held.append((keys, seq[first[index]], seq[first[index] + 1], counts))
            if sum(len(h[0]) for h in held) > HELD:
                held = [summed(held)]
                if len(held[0][0]) > HELD // 2:
                    yield out(*held[0])
                    held = []
        if held:
            yield out(*summed(held))

    def shard(batches):
        def finish(b, blobs):
            sizes = [int(np.frombuffer(x, np.int64, 1)[0]) for x in blobs]
            v, w = (np.concatenate([np.frombuffer(x, np.uint64, n, 8 + k * 8 * n) for x, n in zip(blobs, sizes)]) for k in (0, 1))
            c = np.concatenate([np.frombuffer(x, np.uint32, n, 8 + 16 * n) for x, n in zip(blobs, sizes)]).astype(np.int64)
            keys = pair_hash(v, w)
            order = np.argsort(keys)
            keys = keys[order]
            runs = _runs(keys)
            keys, c = keys[runs], np.add.reduceat(c[order], runs)
            v, w = v[order[runs]], w[order[runs]]
            large = c >= 65535
            _save(f"{folder}/pairs/{b}", key=keys, count=np.minimum(c, 65535).astype(np.uint16), large_key=keys[large], large_count=c[large])
            by_v = np.argsort(v)
            runs = _runs(v[by_v])
            after = np.zeros(len(runs), AFTER)
            after["k"] = v[by_v][runs]
            for name, x in (("total", c), ("n1", c == 1), ("n2", c == 2), ("n3", c >= 3)):
                after[name] = np.add.reduceat(x[by_v].astype(np.int64), runs)
            by_w = np.argsort(w)
            runs = _runs(w[by_w])
            before = np.zeros(len(runs), BEFORE)
            before["k"] = w[by_w][runs]
            before["c"], before["a"] = np.add.reduceat(c[by_w], runs), np.diff(np.r_[runs, len(by_w)])
            yield 2 * nw, np.array([(c == i).sum() for i in (1, 2, 3, 4)], np.int64).tobytes()
            yield from split_by_bucket(after["k"], nw, after)
            yield from ((nw + i, x) for i, x in split_by_bucket(before["k"], nw, before))

        now, held = None, []
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b != now and held:
                    yield blob_batch(finish(now, held))
                    held = []
                now = b
                held.append(blob)
        if held:
            yield blob_batch(finish(now, held))

    blobs = mapped(docs.select("text"), pairs, BLOBS)
    words = mapped(blobs.repartition(nb, "bucket").sortWithinPartitions("bucket"), shard, BLOBS)

    def table(batches):
        def finish(b, after, before):
            rec = {n: [] for n in ("k", *STATS)}
            for kind, blobs in ((AFTER, after), (BEFORE, before)):
                r = np.frombuffer(b"".join(blobs), kind)
                for n in rec:
                    rec[n].append(r[n].astype(np.uint64 if n == "k" else np.int64) if n in kind.names else np.zeros(len(r), np.int64))
            rec = {n: np.concatenate(x) for n, x in rec.items()}
            order = np.argsort(rec["k"])
            runs = _runs(rec["k"][order])
            out = {n: np.add.reduceat(rec[n][order], runs) for n in STATS}
            out["k"] = rec["k"][order][runs]
            _save(f"{folder}/words/{b}", **out)
            return [int((out["c"] > 0).sum()), int(out["c"].sum()), int(out["a"].sum()), *(int((out["a"] == i).sum()) for i in (1, 2, 3, 4)), int((out["a"] >= 3).sum())]

        now, held, rows = None, ([], []), []
        for batch in batches:
            for word, b, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if b == 2 * nw:  # a shard's numbers of bigrams seen 1 to 4 times
                    rows.append([0] * 8 + np.frombuffer(blob, np.int64).tolist())
                    continue
                if word != now and now is not None:
                    rows.append(finish(now, *held) + [0] * 4)
                    held = ([], [])
                now = word
                held[b >= nw].append(blob)
        if now is not None:
            rows.append(finish(now, *held) + [0] * 4)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64()))], names=["totals"])

    by_word = words.select((F.col("bucket") % nw).alias("word"), "bucket", "blob").repartition(nw, "word").sortWithinPartitions("word", "bucket")
    sums = np.array([r[0] for r in mapped(by_word, table, "totals array<long>").collect()], np.int64).reshape(-1, 12).sum(axis=0)
    totals, seen = sums[:8], sums[8:]
    v, n, kinds, *a_counts, a3 = (int(x) for x in totals)
    low = _discounts(a_counts)
    spare = (low[0] * a_counts[0] + low[1] * a_counts[1] + low[2] * a3) / kinds if kinds else 1.0
    return {"folder": folder, "nb": nb, "nw": nw, "common": common, "V": v, "N": n, "kinds": kinds, "discounts": _discounts(list(seen)), "low": low, "spare": spare}


@lru_cache(4096)
def _mapped(path: str):
    """A memory map of a shard's array (None: no such shard): of the file itself where the shared folder is mounted, else
    of this worker's copy in its own temporary folder, which a worker that starts anew makes again."""
    store, place = _store(path)
    if store.get_file_info(place).type != fs.FileType.File:
        return None
    if store.type_name != "local":
        copy = f"{tempfile.gettempdir()}/{hashlib.sha256(path.encode()).hexdigest()}.npy"
        if not os.path.exists(copy):
            part = f"{copy}.{uuid.uuid4().hex}.part"
            with store.open_input_stream(place) as source, open(part, "wb") as target:
                shutil.copyfileobj(source, target, 1 << 20)
            os.replace(part, copy)
        place = copy
    return np.load(place, mmap_mode="r")


def _look_up(keys: np.ndarray, shards: np.ndarray, folder: str, key: str, values: tuple[str, ...]) -> list[np.ndarray]:
    """Values of keys (0: not there) from shards; keys are looked up in order, so that reads move one way."""
    out = [np.zeros(len(keys), np.int64) for _ in values]
    order = np.lexsort((keys, shards))
    cuts = np.r_[_runs(shards[order]), len(order)]
    for s, e in zip(cuts[:-1], cuts[1:]):
        at = order[s:e]
        path = f"{folder}/{int(shards[at[0]])}"
        have = _mapped(f"{path}.{key}.npy")
        if have is None or not len(have):
            continue
        place = np.minimum(np.searchsorted(have, keys[at]), len(have) - 1)
        hit = have[place] == keys[at]
        for o, name in zip(out, values):
            o[at[hit]] = _mapped(f"{path}.{name}.npy")[place[hit]]
    return out


def probabilities(seq: np.ndarray, at: np.ndarray, model: dict):
    """log10 probability by the model and by add-one counts, and whether it is known, for each token after a START."""
    folder, common = model["folder"], model["common"]
    words, back = np.unique(seq, return_inverse=True)
    shard = (((words >> np.uint64(32)) * np.uint64(model["nw"])) >> np.uint64(32)).astype(np.int32)
    c, a, total, n1, n2, n3 = _look_up(words, shard, f"{folder}/words", "k", STATS)
    first = np.ones(len(seq), bool)
    first[at[1:] - 1] = False
    first = np.flatnonzero(first)
    v, w = back[first], back[first + 1]
    keys = pair_hash(seq[first], seq[first + 1])
    uniq, index, again = np.unique(keys, return_index=True, return_inverse=True)
    shards = shard_of(seq[first[index]], uniq, common, model["nb"])
    (count,) = _look_up(uniq, shards, f"{folder}/pairs", "key", ("count",))
    big = np.flatnonzero(count == 65535)
    if len(big):
        count[big] = _look_up(uniq[big], shards[big], f"{folder}/pairs", "large_key", ("large_count",))[0]
    count = count[again]
    low, high = np.r_[0.0, model["low"]], np.r_[0.0, model["discounts"]]
    uniform = 1.0 / (model["V"] + 1)
    single = (a - low[np.minimum(a, 3)]) / model["kinds"] + model["spare"] * uniform if model["kinds"] else np.full(len(words), uniform)
    weight = high[1] * n1 + high[2] * n2 + high[3] * n3
    t = total[v]
    p = np.where(t > 0, (count - high[np.minimum(count, 3)] + weight[v] * single[w]) / np.maximum(t, 1), single[w])
    base = np.log10((c + 1) / (model["N"] + model["V"] + 1))
    return np.log10(p), base[w], c[w] > 0


def score(docs: DataFrame, train_on: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row and whole text of docs, by a model of
    the rows that train_on holds for (all, unless given).

    Tokens are words in ASCII lower case and one end; null and empty texts have the end alone. An unseen word gets the
    uniform part of the lower order; an unseen context falls back to the lower order. Repeated rows count and score as
    rows of their own. Without training rows every token has probability 1 / 1. Extra columns are left behind; empty
    tables give empty results.
    """
    docs = documents(docs)
    model = train(docs if train_on is None else docs.where(train_on))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")

    def run(batches):
        m = shared.value
        for ids, texts in chunks_of(batches, ("doc_id", "text"), "text", CHUNK):
            seq, at = tokens(texts)
            logs, base, known = probabilities(seq, at, m)
            starts = at[:-1] - np.arange(len(texts))
            n = np.diff(at) - 1
            cols = [pa.array(ids, pa.int64()), pa.array(n), pa.array(np.add.reduceat(known.astype(np.int64), starts)), pa.array(np.full(len(n), m["N"], np.int64)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(logs, starts))]
            yield pa.RecordBatch.from_arrays(cols, names=list(names))

    return mapped(docs, run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
