"""Embedding near-dedup by spherical caps: random product codes list-decode each vector to the filters it exceeds."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, dropped, mapped, stored
from .components import components

COSINE = 0.98
#: Vectors a filter should hold and filters a vector should be in, on average; a filter's block of vectors at most.
HELD, LISTED, BLOCK = 32, 16, 1024
#: Filters that a vector is listed in at least, its best ones.
FEWEST = 8
#: A filter's number is (first code word << 20) | second code word.
_WORDS = 1 << 20


class Code:
    """Filters are pairs of unit code words, one for each half of a randomly rotated vector; both halves are random
    but follow from the seed, so every task draws the same ones."""

    def __init__(self, dim: int, expected: float, seed: int = 5):
        rng = np.random.default_rng([seed, dim])
        share = min(0.4, HELD / max(expected, 1.0))
        words = min(_WORDS, max(4, int(np.ceil((LISTED / share) ** 0.5))))
        self.half = max(1, dim // 2)
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        first, second = rng.standard_normal((words, self.half)), rng.standard_normal((words, max(1, dim - self.half)))
        if dim < 2:
            second[:] = 0
        self.first = first / np.linalg.norm(first, axis=1, keepdims=True)
        self.second = second / np.maximum(1e-300, np.linalg.norm(second, axis=1, keepdims=True))
        # the sum of both inner products has variance 2 / dim for a random unit vector
        self.least = NormalDist().inv_cdf(1 - share) * (2 / dim) ** 0.5

    def lists(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the filters whose cap holds it, a search down both sorted halves; a vector that fewer than
        FEWEST caps hold is listed in its best ones."""
        turned = unit @ self.turn
        a = turned[:, : self.half] @ self.first.T
        b = (turned[:, self.half :] @ self.second.T) if turned.shape[1] > self.half else np.zeros((len(unit), len(self.second)))
        oa, ob = np.argsort(-a, axis=1), np.argsort(-b, axis=1)
        out = []
        for i in range(len(unit)):
            x, y = a[i, oa[i]], b[i, ob[i]]
            reach = np.searchsorted(-y, -(self.least - x), side="right")  # how far down the second half goes
            n = int((reach > 0).sum())
            if reach[:n].sum() < FEWEST:
                k = min(FEWEST, len(x)), min(FEWEST, len(y))
                best = np.argsort(-(x[: k[0], None] + y[None, : k[1]]).ravel(), kind="stable")[:FEWEST]
                out.append(np.unique((oa[i, best // k[1]].astype(np.int64) << 20) | ob[i, best % k[1]].astype(np.int64)))
                continue
            reach = reach[:n]
            one = np.repeat(oa[i, :n], reach).astype(np.int64)
            two = np.concatenate([ob[i, :k] for k in reach]).astype(np.int64)
            out.append(np.sort((one << 20) | two))
        return out


def _usable():
    """A label, and a vector of finite components that is not zero."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine & some, F.lit(False))


def _listed(classes: DataFrame) -> DataFrame:
    """classes with the filters of each vector; the code's size follows the largest label, counted over all."""
    sizes = classes.groupBy("label", F.size("embedding").alias("dim")).count().groupBy("dim").agg(F.max("count").alias("most")).collect()
    codes = {r["dim"]: Code(r["dim"], r["most"]) for r in sizes}  # one a vector length
    shared = classes.sparkSession.sparkContext.broadcast(codes)
    names = classes.columns

    def run(batches):
        for batch in batches:
            vectors = batch.column(names.index("embedding")).to_pylist()
            filters: list = [None] * len(vectors)
            for dim in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == dim]
                x = np.array([vectors[i] for i in at], np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for a in range(0, len(at), 256):
                    for i, f in zip(at[a : a + 256], shared.value[dim].lists(x[a : a + 256])):
                        filters[i] = f
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(filters, pa.list_(pa.int64()))], names=[*names, "filters"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return mapped(classes, run, f"{schema}, filters array<long>")


def _common_before(now: int, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which pairs share a filter numbered below this one; that filter counts them, this one does not."""
    a, b = [f[f < now] for f in left], [f[f < now] for f in right]
    common = np.intersect1d(np.concatenate(a), np.concatenate(b)) if a and b else np.zeros(0, np.int64)

    if left is right:  # what only one of them has cannot be common
        values, counts = np.unique(np.concatenate(a), return_counts=True)
        common = values[counts > 1]

    def rows(lists):
        m = np.zeros((len(lists), len(common)), np.float32)
        for i, f in enumerate(lists):
            m[i, np.searchsorted(common, np.intersect1d(common, f, assume_unique=True))] = 1
        return m

    return rows(a) @ rows(b).T > 0 if len(common) else np.zeros((len(left), len(right)), bool)


def block_links(now: int, left, right, cosine: float):
    """left, right: lists of (id, copies, vector, filters). Per vector the linked vectors that this filter counts, and
    links that connect what is linked. Cosines are double precision, of the components as given."""
    same = left is right
    xs = np.array([r[2] for r in left], np.float64)
    ys = xs if same else np.array([r[2] for r in right], np.float64)
    xs = xs / np.abs(xs).max(axis=1, keepdims=True)  # no overflow or underflow in squares
    ys = xs if same else ys / np.abs(ys).max(axis=1, keepdims=True)
    cos = (xs @ ys.T) / np.sqrt(np.outer((xs * xs).sum(1), (ys * ys).sum(1)))
    near = cos >= cosine - 1e-9
    if same:
        near &= ~np.eye(len(xs), dtype=bool)
    edge = np.argwhere(near & (cos < cosine + 1e-9))
    for i, j in edge:  # at the threshold, the plain formula decides
        x, y = np.array(left[i][2], np.float64), np.array(right[j][2], np.float64)
        near[i, j] = float(np.dot(x, y)) / (float(np.dot(x, x)) ** 0.5 * float(np.dot(y, y)) ** 0.5) >= cosine
    if not near.any():
        return [], []
    fl = [np.asarray(r[3]) for r in left]
    fr = fl if same else [np.asarray(r[3]) for r in right]
    near &= ~_common_before(now, fl, fr)
    mx = np.array([r[1] for r in left], np.int64)
    my = mx if same else np.array([r[1] for r in right], np.int64)
    counts = [(left[i][0], int(c)) for i, c in enumerate(near @ my) if c]
    if not same:
        counts += [(right[j][0], int(c)) for j, c in enumerate(near.T @ mx) if c]
    forest, edges = Forest(len(left) if same else len(left) + len(right)), []
    shift = 0 if same else len(left)
    for i in np.flatnonzero(near.any(axis=1)):
        for j in np.flatnonzero(near[i]):
            if forest.union(int(i), shift + int(j)):
                edges.append((left[i][0], right[j][0]))
    return counts, edges


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label).

    Rows link when their labels are equal and not null and the cosine of their vectors is at least `cosine`. Equal
    vectors of a label become one class first. Each class is list-decoded to the caps it lies in, classes meet by
    (label, cap), cosines decide. A pair that shares several caps counts in the first of them. Caps that hold more than
    BLOCK classes are cut by hash into blocks, and each pair of blocks is one piece of work; pairs never leave a task,
    only counts and connecting links do. Caps are random: a pair at the threshold shares none with a chance below
    one in a thousand (measured recall is in the tests), and closer pairs more rarely.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without label, link with nothing,
    as do vectors of different lengths. Rows that repeat a vec_id are vectors of their own. A null vec_id has no
    component unless linked to a row that has one. Extra columns are left behind; empty tables give empty results.
    """
    rows = vectors.select("vec_id", "embedding", "label", F.xxhash64("label", "embedding").alias("mark"), _usable().alias("usable"))
    good = rows.where("usable")
    classes = good.groupBy("label", "mark", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = stored(classes.withColumnRenamed("mark", "rep"), "vectors")  # the 64-bit hash of label and vector names a class
    listed = stored(_listed(classes.select("label", "rep", "copies", "embedding")), "caps")
    flat = listed.withColumn("cap", F.explode("filters")).withColumn("dim", F.size("embedding"))
    sizes = listed.select("label", F.size("embedding").alias("dim"), F.explode("filters").alias("cap")).groupBy("label", "dim", "cap").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select("label", "dim", "cap", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    met = flat.join(sizes, ["label", "dim", "cap"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keys = ["label", "dim", "cap", "one", "two"]
    met = met.select("label", "dim", "cap", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "rep", "copies", "embedding", "filters")

    def run(batches):
        def solve(key, held):
            if key[3] == key[4]:
                side = [r[1:] for r in held]
                return block_links(key[2], side, side, cosine)
            left, right = [r[1:] for r in held if r[0] == key[3]], [r[1:] for r in held if r[0] == key[4]]
            return block_links(key[2], left, right, cosine) if left and right else ([], [])

        def out(found):
            kinds, a, b = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])

        now, held, found = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:5] != now:
                    if len(held) > 1:
                        counts, edges = solve(now, held)
                        found += [("count", *c) for c in counts] + [("link", *e) for e in edges]
                    now, held = row[:5], []
                held.append(row[5:])
            if len(found) > 10_000:
                yield out(found)
                found = []
        if len(held) > 1:
            counts, edges = solve(now, held)
            found += [("count", *c) for c in counts] + [("link", *e) for e in edges]
        if found:
            yield out(found)

    ordered = met.repartition(*keys).sortWithinPartitions(*keys, "rep")
    found = stored(mapped(ordered, run, "kind string, a long, b long"), "links")
    counts = found.where("kind = 'count'").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    joined = components(found.where("kind = 'link'").select("a", "b")).withColumnRenamed("id", "rep")
    known = stored(classes.join(counts, "rep", "left").join(joined, "rep", "left"), "known")
    dropped(classes, listed, found)
    named = known.where("component is not null").groupBy("component").agg(F.min("least").alias("component_id"))
    done = known.join(named, "component", "left")
    done = done.select(F.col("rep").alias("mark"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    linked = good.select("vec_id", "mark").join(done, "mark").select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
