import collections
import math
import re

import pytest

from shopstead.llm import kneser_ney, mixing, quality
from shopstead.llm.queries import op8_lm_scoring, op9_quality_classifier

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


def test_kneser_ney_equals_counting(docs, corpus, empty):
    from pyspark.sql import functions as F

    tok = {i: WORDS.findall((t or "").translate(LOW)) + ["</s>"] for i, t in corpus}
    train = [i for i in tok if i % 2 == 0]
    c = collections.Counter(w for i in train for w in tok[i])
    pairs = collections.Counter(p for i in train for p in zip(["<s>", *tok[i][:-1]], tok[i]))
    before, total, kinds = collections.Counter(w for _, w in pairs), collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
    for (v, _), k in pairs.items():
        total[v] += k
        kinds[v][min(k, 3) - 1] += 1
    of = lambda xs: (0, *kneser_ney._discounts([sum(x == i for x in xs) for i in (1, 2, 3, 4)]))
    high, low = of(pairs.values()), of(before.values())
    spare = sum(low[min(k, 3)] for k in before.values()) / len(pairs)

    def single(w):
        return (before[w] - low[min(before[w], 3)]) / len(pairs) + spare / (len(c) + 1)

    def p(v, w):
        k = pairs[v, w]
        return (k - high[min(k, 3)] + sum(high[i + 1] * kinds[v][i] for i in range(3)) * single(w)) / total[v] if total[v] else single(w)

    for v in [*list(total)[:5], "never seen"]:  # probabilities of all words and one unknown sum to 1
        assert math.isclose(sum(p(v, w) for w in c) + p(v, "\x00"), 1, rel_tol=1e-9)
    n = sum(c.values())
    for r in kneser_ney.score(docs, F.col("doc_id") % 2 == 0).collect():
        t = tok[r.doc_id]
        assert math.isclose(r.score, sum(math.log10(p(v, w)) for v, w in zip(["<s>", *t[:-1]], t)), rel_tol=1e-9)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in t), rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
    assert kneser_ney.score(empty).count() == 0
    assert all(r.score == 0 for r in kneser_ney.score(docs, F.lit(False)).collect())


def test_model_beats_the_base_on_held_out_texts(spark, sf):
    rows = op8_lm_scoring(spark, sf).where("held_out").collect()
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = op9_quality_classifier(spark, sf)
    joined = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = {q: [r.predicted == q for r in joined if r.quality == q] for q in (0, 1)}
    assert sum(right[1]) / len(right[1]) > 0.95 and sum(right[0]) / len(right[0]) > 0.7


def test_classifier_edges(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score == 0.5 and r.predicted == 1 for r in quality.classify(docs, none).collect())
    odd = spark.createDataFrame([(3, None, 0), (None, 1, 0), (0, 0, 0), (9, 1, 0), (9, 1, 0), (24, 0, 0), (27, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, odd).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(empty, odd).count() == 0


def test_scores_do_not_depend_on_the_batch():
    table, bias = quality.train(["good text " * 20, "### $$$ " * 20] * 10, [1, 0] * 10)
    texts = ["good text here", "", "### x", "é" * 50, "ab"]
    together = quality.score_texts(texts, table, bias)
    assert [float(quality.score_texts([t], table, bias)[0]) for t in texts] == pytest.approx(together.tolist(), abs=1e-12)


def water(sizes, weights, share, cap):
    """Reshares every excess by weight until no target is above its cap."""
    budget, fixed = share * sum(sizes), {}
    while True:
        free = [k for k in range(len(sizes)) if k not in fixed]
        if not free:
            return fixed
        level = (budget - sum(fixed.values())) / sum(weights[k] for k in free)
        over = [k for k in free if level * weights[k] > cap * sizes[k] + 1e-9]
        if not over:
            return fixed | {k: level * weights[k] for k in free}
        fixed |= {k: cap * sizes[k] for k in over}


def test_mixing(docs, corpus, empty):
    rows = mixing.mix(docs.unionByName(docs.limit(1))).collect()
    again = mixing.mix(docs.unionByName(docs.limit(1)).repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == len(corpus) + 1
    size = {i: len(WORDS.findall(t or "")) for i, t in corpus}
    assert all(r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"] for r in rows)
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        s = [None, "a", "b", "é"][r.doc_id % 4]
        by[s][0] += r["size"]
        by[s][1] += r.taken
        by[s][2] = r.target
    order = sorted((s for s in by if s is not None)) + [None] * (None in by)
    want = water([by[s][0] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], 1.5, 2.0)
    for k, s in enumerate(order):
        assert math.isclose(by[s][2], want[k], rel_tol=1e-9) and abs(by[s][1] - want[k]) <= 1
    assert mixing.mix(empty).count() == 0


def test_scores_equal_a_plain_sum(spark, sf):
    """op9's scores from the model it learns, by a loop over the words and character n-grams of each whole text."""
    import numpy as np

    from shopstead.llm.rolling import Rolling, code_points

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    table, bias = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))

    def bucket(piece):
        return int(Rolling(code_points([piece])[0]).slices(np.array([0]), np.array([len(piece)]))[0] % np.uint64(quality.BUCKETS))

    def gram(piece):
        return int(Rolling(code_points([piece])[0]).grams(len(piece))[0] % np.uint64(quality.BUCKETS))

    def plain(text):
        found = [bucket(w) for w in WORDS.findall(text)] + [gram(text[k : k + q]) for q in quality.GRAMS for k in range(len(text) - q + 1)]
        return 1 / (1 + math.exp(-(sum(float(table[f]) for f in found) / max(1, len(found)) + bias)))

    some = {r.doc_id: r.text or "" for r in docs.where("n_chars < 1500").collect()}
    got = {r.doc_id: r for r in op9_quality_classifier(spark, sf).collect()}
    assert len(got) == docs.count() and len(some) > 5
    for i, text in some.items():
        assert got[i].score == pytest.approx(plain(text), abs=1e-6) and got[i].predicted == int(got[i].score >= 0.3)
