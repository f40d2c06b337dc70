"""Small helpers shared by the corpus operators: shared-folder tables, packed shuffles, row iteration."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..sources.tables import small_batches

#: Words as every operator here counts them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Text (in characters) that one packed-shuffle bucket should stand for.
CHARS_PER_BUCKET = 4_000_000


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share; one of our own only on a local master (tests)."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _own:
            _own[app] = f"file://{tempfile.mkdtemp(prefix='shopstead-')}"
        base = _own[app]
    return f"{base.rstrip('/')}/shopstead-{app}"


def cleared(spark: SparkSession) -> None:
    """Deletes every table and model that this application keeps in the shared folder. Results are lazy and read them, so
    this comes after the results are written."""
    _delete(spark, shared_dir(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*dfs: DataFrame) -> None:
    """Deletes tables made by stored() that nothing needs any more."""
    for df in dfs:
        spark = df.sparkSession
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            _delete(spark, folder)


@lru_cache(1)
def _libc():
    """The C library, told to give freed arrays of 8 MB or more back to the system (mallopt's fixed numbers: -3 is the
    threshold for maps of their own, -1 that for trimming); None where it is another one."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 8 << 20)
        libc.mallopt(-1, 16 << 20)
        return libc
    except (OSError, AttributeError):
        return None


def released() -> None:
    """Gives free memory of this worker back: idle workers stay beside busy ones for a minute."""
    pa.default_memory_pool().release_unused()
    if _libc():
        _libc().malloc_trim(0)


#: Bytes of a batch that goes back to the JVM, more or less; one row may be larger.
OUT_BYTES = 4 << 20


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow, with results in small batches and memory given back at the end of each task."""

    def lean(batches):
        _libc()
        for batch in run(batches):
            n = batch.num_rows
            step = -(-n // (batch.nbytes // OUT_BYTES + 1)) if n else 1
            for a in range(0, n, step):
                yield batch.slice(a, step)
        del batches
        released()

    return df.mapInArrow(lean, schema)


def documents(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, text (null: empty) and the named extra columns; other columns are left behind."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *extra)


def marked(docs: DataFrame) -> DataFrame:
    """documents() with mark, a hash of the text: rows that share a doc_id but not the text are rows of their own."""
    return documents(docs).withColumn("mark", F.xxhash64("text"))


@F.pandas_udf(BinaryType())
def packed(text: pd.Series) -> pd.Series:
    """UTF-8 bytes under zstandard: a text that is only passed on crosses the shuffle at about half the size."""
    c = zstandard.ZstdCompressor(level=1)
    return pd.Series([None if t is None else c.compress(t.encode("utf-8", "surrogatepass")) for t in text], dtype=object)


def unpacked(z: bytes | None) -> bytes:
    return b"" if z is None else zstandard.ZstdDecompressor().decompress(z)


def n_buckets(docs: DataFrame, chars: int = CHARS_PER_BUCKET) -> int:
    """Buckets for a packed shuffle, in proportion to the corpus; it only sizes partitions, never drops rows."""
    if "n_chars" in docs.columns:
        total = docs.agg(F.sum("n_chars")).first()[0]
    else:
        total = docs.agg(F.sum(F.length("text"))).first()[0]
    return max(8, int((total or 0) // chars) + 1)


def rows_of(batches, columns):
    """Python lists of the columns of each non-empty Arrow batch."""
    for batch in batches:
        if batch.num_rows:
            yield [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]


def chunks_of(batches, columns, text, chars: int = 8_000_000):
    """Like rows_of, but gathers batches until they hold some 8 MB of the text column; one row may be longer."""
    held, size = [[] for _ in columns], 0
    k = columns.index(text)
    for cols in rows_of(batches, columns):
        for row in zip(*cols):
            for have, value in zip(held, row):
                have.append(value)
            size += len(row[k] or "") + 64
            if size >= chars:
                yield held
                held, size = [[] for _ in columns], 0
    if held[0]:
        yield held


def pieces(texts, chars: int = 250_000):
    """(start, end) of runs of texts with some `chars` characters each; one text may be longer. Arrays over a piece stay
    in cache, and a worker's memory follows the piece."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def unpacked_chunks(batches, chars: int):
    """(ids, texts) from batches of doc_id and packed text, in pieces of some `chars` bytes; one text may be longer."""
    ids, texts, size = [], [], 0
    for cols in rows_of(batches, ("doc_id", "z")):
        for i, z in zip(*cols):
            data = unpacked(z)
            ids.append(i)
            texts.append(data.decode("utf-8", "surrogatepass"))
            size += len(data) + 64
            if size >= chars:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def split_by_bucket(h: np.ndarray, nb: int, rec: np.ndarray):
    """Deals records out by the upper half of their 64-bit hash: (bucket, bytes) for each bucket that gets any."""
    bucket = ((h >> np.uint64(32)) * np.uint64(nb)) >> np.uint64(32)
    order = np.argsort(bucket.astype(np.uint32), kind="stable")
    bucket, rec = bucket[order], rec[order]
    cut = np.flatnonzero(np.diff(bucket)) + 1
    starts, ends = np.r_[0, cut], np.r_[cut, len(bucket)]
    for s, e in zip(starts, ends):
        if e > s:
            yield int(bucket[s]), rec[s:e].tobytes()


BLOBS = "bucket int, blob binary"


def blob_batch(items) -> pa.RecordBatch:
    items = list(items)
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in items], pa.int32()), pa.array([x for _, x in items], pa.binary())], names=["bucket", "blob"])


def dealt(blobs: DataFrame, nb: int) -> DataFrame:
    """Brings the blobs of a bucket together, in order; several buckets share a partition."""
    return blobs.repartition(max(8, nb // 2), "bucket").sortWithinPartitions("bucket")


def bucket_records(batches, dtype):
    """All records of one bucket at a time, from batches sorted by bucket."""
    held, now = [], None
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if b != now and held:
                yield np.frombuffer(b"".join(held), dtype)
                held = []
            now = b
            held.append(blob)
    if held:
        yield np.frombuffer(b"".join(held), dtype)


def bucket_runs(batches, columns):
    """(bucket, arrays of the columns) for one bucket at a time, from batches sorted by their first column, the bucket."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, values = batch.column(0).to_numpy(), [batch.column(c).to_numpy() for c in columns]
        for s, e in runs_of(key):
            if key[s] != now and held:
                yield now, [np.concatenate(c) for c in zip(*held)]
                held = []
            now = int(key[s])
            held.append([v[s:e] for v in values])
    if held:
        yield now, [np.concatenate(c) for c in zip(*held)]


def runs_of(key: np.ndarray):
    """(start, end) of each run of equal values."""
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(0, np.int64)
    return zip(cuts[:-1].tolist(), cuts[1:].tolist())


_BLOCK = 1 << 15


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (fixed constants of the splitmix64 finaliser), in blocks that stay in cache."""
    x = np.array(x, np.uint64, order="C", ndmin=1)
    flat = x.reshape(-1)
    spare = np.empty(min(_BLOCK, flat.size), np.uint64)
    for a in range(0, flat.size, _BLOCK):
        part = flat[a : a + _BLOCK]
        s = spare[: len(part)]
        part ^= np.right_shift(part, np.uint64(30), out=s)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        part ^= np.right_shift(part, np.uint64(27), out=s)
        part *= np.uint64(0x94D049BB133111EB)
        part ^= np.right_shift(part, np.uint64(31), out=s)
    return x


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new group starts in columns that are sorted together."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


class Forest:
    """Union-find over 0..n-1 for one task's bounded block; the smallest member is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
