"""Connected components of a link table: buckets of nodes merge what they know and tell each other the rest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_runs, dropped, mapped, mix64, stored

#: Links that one bucket of nodes should stand for, and links that a task merges at once before they are dealt.
PER_BUCKET, CHUNK = 300_000, 500_000
#: Kinds of rows between rounds. OWN: a node of the bucket and its root so far. NEWS: a link found elsewhere. ANSWER: a
#: root's own root, from its home. ASK: another bucket (`root`) has a node whose root is this one; KEPT: the same, heard.
OWN, NEWS, ANSWER, ASK, KEPT = range(5)
ROWS = "bucket int, kind int, id long, root long"


def homes(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def merged_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of links (a, b) and the least id that each reaches by them."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(ids))
    while True:
        p, q = up[x], up[y]
        apart = p != q
        if not apart.any():
            return ids, ids[up]
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        while True:
            higher = up[up]
            if (higher == up).all():
                break
            up = higher


def _batch(bucket, kind, ids, roots) -> pa.RecordBatch:
    n = len(ids)
    bucket = np.full(n, bucket, np.int32) if np.isscalar(bucket) else bucket.astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(n, kind, np.int32)), pa.array(ids), pa.array(roots)], names=["bucket", "kind", "id", "root"])


def _round(now: int, kind: np.ndarray, ids: np.ndarray, roots: np.ndarray, buckets: int):
    """What bucket `now` knows after it has merged its rows, and what it tells others."""
    asks = kind >= ASK
    who, whence = ids[asks], roots[asks]
    links = ~asks
    kind, ids, roots = kind[links], ids[links], roots[links]
    known, top = merged_roots(ids, roots)
    home = homes(known, buckets)
    mine = home == now
    yield _batch(now, OWN, known[mine], top[mine])
    told = ~mine & (known != top) & ~np.isin(known, ids[kind == ANSWER])  # an answer's own home knows the link
    yield _batch(home[told], NEWS, known[told], top[told])
    wanted = np.unique(top[mine])
    wanted = wanted[homes(wanted, buckets) != now]
    wanted = wanted[~np.isin(wanted, roots[kind == OWN])]  # asked for in the round before
    yield _batch(homes(wanted, buckets), ASK, wanted, np.full(len(wanted), now, np.int64))
    if len(who):
        root = top[np.searchsorted(known, who)]
        gone = root != who
        yield _batch(whence[gone], ANSWER, who[gone], root[gone])
        yield _batch(now, KEPT, who[~gone], whence[~gone])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in edges; component is the smallest id reachable.

    Links may repeat, point either way or to themselves; null ends are ignored. Each task first merges the links it
    holds. Nodes then have a home bucket by hash, which keeps a row a node: its root so far. In each round a bucket
    merges all it knows, tells a node's home what it has found out about it, and asks the homes of its roots; a home
    answers when it learns that such a root has a root itself. A hub is asked for once a bucket, whatever the number of
    its links, so no task holds them. A round is one shuffle and is written to the shared folder; only a count comes to
    the driver. It ends when nobody has news. The number of rounds grows with the logarithm of the longest chain.
    """
    both = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    links = stored(both.select(F.col(a).cast("long").alias("id"), F.col(b).cast("long").alias("root")), "links")
    buckets = max(8, links.count() // PER_BUCKET + 1)

    def merge(batches):
        def out():
            ids, roots = merged_roots(*map(np.concatenate, zip(*held)))
            return _batch(homes(ids, buckets), NEWS, ids, roots)

        held = []
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(x) for x, _ in held) > CHUNK:
                yield out()
                held = []
        if held:
            yield out()

    def round_(batches):
        for now, (kind, ids, roots) in bucket_runs(batches, ("kind", "id", "root")):
            yield from _round(now, kind, ids, roots, buckets)

    now = stored(mapped(links, merge, ROWS), "components")
    dropped(links)
    while True:
        after = mapped(now.repartition(buckets, "bucket").sortWithinPartitions("bucket"), round_, ROWS)
        after = stored(after, "components")
        dropped(now)
        now = after
        if now.where(F.col("kind").isin(NEWS, ANSWER, ASK)).isEmpty():
            return now.where(F.col("kind") == OWN).select("id", F.col("root").alias("component"))
