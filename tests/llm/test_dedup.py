import collections
import hashlib
import random
import re

import numpy as np
import pytest

from shopstead.llm import caps, common, components, imatch, jaccard, lines, sigtree, substrings

LOW = {c: c + 32 for c in range(65, 91)}
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def similar(sets, num):
    return [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]


def shingles(text, width):
    w = WORDS.findall((text or "").translate(LOW))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (10, 11), (11, 11), (5, 5), (20, 10)] + [(100, 100 + k) for k in range(1, 40)] + [(200 + k, 201 + k) for k in range(30)] + [(None, 4)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[3] == 1 and got[20] == 10 and got[5] == 5 and got[139] == 100 and got[230] == 200 and None not in got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("width,num", [(4, 85), (5, 80)])
def test_ngram_join_equals_all_pairs(docs, corpus, empty, width, num):
    sets = [shingles(t, width) for _, t in corpus]
    want = roots(len(sets), similar(sets, num))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.ngram_join(docs.unionByName(docs.limit(2)), width, num).collect()}
    assert got == {i: (len(s), corpus[w][0]) for (i, _), s, w in zip(corpus, sets, want)}
    assert jaccard.ngram_join(empty, width, num).count() == 0


def test_groups_larger_than_a_block(spark, monkeypatch):
    """One near-duplicate group whose blocks meet only through each other."""
    monkeypatch.setattr(jaccard, "BLOCK", 300)
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(base[:40] + [f"x{k // 2}"] + base[41:] + [f"y{k}"])) for k in range(40)]
    sets = [shingles(t, 4) for _, t in rows]
    want = roots(40, similar(sets, 85))
    got = {r.doc_id: r.component_id for r in jaccard.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == dict(enumerate(want))


@pytest.mark.parametrize("block", [200, 1500])
def test_large_groups_keep_every_link(spark, monkeypatch, block):
    """A group of many chains that share a common start: most of it is left over after the first pass."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(4)
    rows = []
    for k in range(12):
        words = [f"w{i}" for i in range(40)] + [f"c{k}x{i}" for i in range(rng.choice([2, 6, 30]))]
        for _ in range(10):
            words[rng.randrange(len(words))] = f"r{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    sets = [shingles(t, 2) for _, t in rows]
    want = roots(len(rows), similar(sets, 80))
    assert 1 < len(set(want)) < len(rows)
    got = {r.doc_id: r.component_id for r in jaccard.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert got == dict(enumerate(want))


def test_tree_finds_every_component():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(60):
        if sets and rng.random() < 0.6:
            s = sets[rng.integers(len(sets))].copy()
            s[: rng.integers(0, max(1, len(s) // 5))] = rng.integers(0, 1 << 60, 1)[0]
        else:
            s = rng.integers(0, 1 << 60, rng.integers(1, 80), dtype=np.uint64)
        sets.append(np.unique(s.astype(np.uint64)))
    plain = [set(s.tolist()) for s in sets]
    want = roots(60, similar(plain, 85))
    x = sigtree.Block(list(range(60)), sets)
    assert roots(60, sigtree.links(x, x, 85, 100)) == want
    a, b = sigtree.Block(list(range(30)), sets[:30]), sigtree.Block(list(range(30, 60)), sets[30:])
    parts = [*sigtree.links(a, a, 85, 100), *sigtree.links(b, b, 85, 100), *sigtree.links(a, b, 85, 100)]
    assert roots(60, parts) == want


def test_lines_equal_all_pairs(docs, corpus, empty):
    first, places = {}, []
    for i, t in corpus:
        for k, x in enumerate((t or "").split("\n")):
            if sum(c not in " \t\n\v\f\r" for c in x) >= lines.VISIBLE:
                places.append((i, k, x))
                first.setdefault(x, (i, k))
    unique = list(first)
    sets = [{y[j : j + 8] for j in range(len(y) - 7)} for y in (x.translate(LOW) for x in unique)]
    root = roots(len(unique), similar(sets, 80))
    index = {x: k for k, x in enumerate(unique)}
    gone = collections.defaultdict(set)
    for i, k, x in places:
        if first[unique[root[index[x]]]] != (i, k):
            gone[i].add(k)
    got = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert any(gone.values())
    for i, t in corpus:
        kept = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone[i])
        assert (got[i].kept, got[i].n_dropped, got[i].text, got[i].spans) == (kept, len(gone[i]), t, "y")
    assert lines.dedup_lines(empty).count() == 0


def test_short_lines_are_compared(spark):
    rows = [(1, "Add to cart\nOK\n\n \nshort"), (2, "OK\nAdd to Cart\n\nok\n \nx"), (3, "x\n你好，欢迎来到我们的商店"), (4, "你好，欢迎来到我们的商店")]
    got = {r.doc_id: r.kept for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "\nok\n \nx", 3: "你好，欢迎来到我们的商店", 4: ""}


def test_line_starts():
    texts = ["", "a\n", "\n\nb", "", "c", "d\n"]
    got = lines.Lines(texts)
    want = [(i, k, x) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n"))]
    text = "".join(texts)
    assert [(int(i), int(k), text[s:e]) for i, k, s, e in zip(got.text, got.number, got.start, got.end)] == want


def brute_repeats(corpus, n):
    seen, out = set(), {}
    for i, t in sorted(corpus):
        data = (t or "").encode()
        cover = bytearray(len(data))
        for p in range(len(data) - n + 1):
            w = data[p : p + n]
            if w in seen:
                cover[p : p + n] = b"\x01" * n
            seen.add(w)
        out[i] = bytes(b for b, c in zip(data, cover) if not c), [m.span() for m in re.finditer(rb"\x01+", bytes(cover))]
    return out


@pytest.mark.parametrize("split", [20_000, 3])
def test_repeats_equal_brute_force(docs, corpus, empty, monkeypatch, split):
    monkeypatch.setattr(substrings, "SPLIT", split)
    monkeypatch.setattr(substrings, "CHUNK", 3000)  # several chunks, so that buckets meet in the shuffle
    got = {r.doc_id: (bytes(r.kept), [(x.start, x.end) for x in r.spans]) for r in substrings.cut_repeats(docs, 100).collect()}
    assert got == brute_repeats(corpus, 100)
    assert substrings.cut_repeats(empty, 100).count() == 0


@pytest.mark.parametrize("length", [1, 20, 300, 400])
def test_repeats_of_other_lengths(spark, length):
    rng = random.Random(length)
    say = lambda n: "".join(rng.choices("abcdé", k=n))
    long, short = say(900), say(40)
    rows = [(0, say(50) + long + say(300)), (1, short + long[100:800] + short), (2, say(length)), (3, long[:length]), (4, long[: length - 1]), (5, "x" * 700)]
    got = {r.doc_id: (bytes(r.kept), [(x.start, x.end) for x in r.spans]) for r in substrings.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length).collect()}
    assert got == brute_repeats(rows, length)
    with pytest.raises(ValueError):
        substrings.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 0)


def test_hot_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SPLIT", 3)
    monkeypatch.setattr(substrings, "HELD", 5)  # buckets are refined in several parts
    monkeypatch.setattr(substrings, "WINDOWS", 500)
    rng = random.Random(8)
    say = lambda n: "".join(rng.choices("abcdefgh", k=n))
    passage = say(60)
    rows = [(i, say(80) + passage + say(80)) for i in range(40)]
    rows += [(40 + i, say(20) + rows[i][1][10:190] + say(20)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (bytes(r.kept), [(x.start, x.end) for x in r.spans]) for r in substrings.cut_repeats(docs, 100).collect()}
    assert got == brute_repeats(rows, 100)
    found = substrings._first_pass(common.marked(docs), 100).where("key is not null").cache()
    dealt = substrings._spread(common.marked(docs), found, 100).where("kind = 1").collect()
    places = [(int(x["d"]), int(x["m"]), int(x["p"])) for r in dealt for x in np.frombuffer(r.data, substrings.WINDOW)]
    assert len({r.key for r in dealt}) > 1
    assert places and len(places) == len(set(places))  # no window goes to two parts


def test_samples_fill_all_buckets():
    text = bytes(random.Random(2).choices(range(97, 123), k=40_000))
    h, rec = substrings.sampled([1], [1], [text], 100)
    sizes = {b: len(x) // rec.itemsize for b, x in substrings.split_by_bucket(h, 16, rec)}
    assert len(sizes) == 16 and max(sizes.values()) < len(rec) / 4


def test_repeated_rows_keep_their_text(spark):
    text = "".join(random.Random(5).choices("abcdefgh", k=500))
    rows = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, len(r.kept)) for r in substrings.cut_repeats(rows, 100).collect())
    assert got == [(-1, 500), (1, 500), (1, 500), (2, 0)]


def test_fingerprints(docs, corpus, empty, spark):
    got = {r.doc_id: r for r in imatch.near_edits(docs).collect()}
    order = sorted((i for i, _ in corpus), reverse=True)
    text = dict(corpus)
    for k, i in enumerate(order):
        a, b = text[i] or "", text[order[(k + 1) % len(order)]] or ""
        half = len(a) // 2
        edit = a[: len(a) - half] + b[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(a), hashlib.sha256(edit.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if a == edit:
            assert got[i].near_edited == 1
    same = collections.defaultdict(set)
    for i, t in corpus:
        same[t or ""].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in same.values())
    plain = {r.doc_id: r.fingerprint for r in imatch.fingerprints(docs).collect()}
    assert plain == {i: r.fingerprint for i, r in got.items()}
    assert imatch.near_edits(empty).count() == 0
    lone = imatch.near_edits(spark.createDataFrame([(None, "x y")], "doc_id long, text string")).collect()
    assert len(lone) == 1 and lone[0].near_next == 1


def vectors():
    rng = np.random.default_rng(0)
    rows = []
    for c in range(40):
        centre = rng.standard_normal(16)
        rows += [(centre + rng.standard_normal(16) * rng.choice([0.0, 0.02, 0.05, 0.08])).astype(np.float32).tolist() for _ in range(6)]
    labels = [k % 3 if k % 17 else None for k in range(len(rows))]
    rows += [None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] * 16, rows[0][:8], [2 * x for x in rows[0]]]
    labels += [0] * 8
    return [(k, v, lab) for k, (v, lab) in enumerate(zip(rows, labels))]


@pytest.mark.parametrize("block", [1024, 4])
def test_caps_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(caps, "BLOCK", block)
    rows = vectors()
    fit = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and lab is not None for _, v, lab in rows]
    pairs = []
    for a in range(len(rows)):
        for b in range(a):
            if fit[a] and fit[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                    pairs.append((b, a))
    want_root, links = roots(len(rows), pairs), collections.Counter(x for p in pairs for x in p)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = {r.vec_id: r for r in caps.near_vectors(df).collect()}
    assert len(got) == len(rows) and len(pairs) > 100
    assert sum(r.n_links for r in got.values()) >= 0.99 * 2 * len(pairs)
    assert all(got[k].n_links <= links[k] for k in got)
    exact = [got[k].component_id == want_root[k] and got[k].kept == (want_root[k] == k) for k in got]
    assert np.mean(exact) >= 0.99
    assert caps.near_vectors(df.limit(0)).count() == 0


def test_rows_of_one_id_and_other_texts(spark):
    """Rows that repeat a doc_id with another text are documents of their own."""
    rng = random.Random(6)
    say = lambda n: "".join(rng.choices("abcdefgh", k=n))
    long, other = say(400), say(30)
    rows = [(1, long), (1, "short"), (2, long[:150] + "yy" + long[200:350]), (3, "x"), (3, "x")]
    got = sorted((r.doc_id, bytes(r.kept).decode()) for r in substrings.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 100).collect())
    assert got == sorted([(1, long), (1, "short"), (2, "yy"), (3, "x"), (3, "x")])
    rows = [(1, f"{long}\n{other}"), (1, say(50)), (2, other + "."), (2, other + ".")]
    got = sorted((r.doc_id, r.kept, r.n_dropped) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, rows[0][1], 0), (1, rows[1][1], 0), (2, "", 1), (2, "", 1)])
    words = [" ".join(say(5) for _ in range(30)) for _ in range(2)]
    rows = [(1, words[0]), (1, "few words"), (2, words[0]), (3, words[1])]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect())
    assert got == [(1, 27, 1), (2, 27, 1), (3, 27, 3)]
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 1.0], 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in caps.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def plain_fingerprint(terms, lexicon):
    """Level and kept terms of each subset at the three rates, by a loop over terms; equal kept terms, equal hashes."""
    band = sorted(t for t in terms if t in lexicon)
    band = band if len(band) >= 8 else sorted(terms)
    level = max(0, len(band).bit_length() - 2) if band else 0
    ids = [int(x) for x in common.mix64(np.array(band, np.uint64))]
    odd = [int(x) for x in imatch._ODD[0]]
    kept = [[tuple(t for t in ids if (t * o % (1 << 64)) >> (64 - level - k) == 0 or level + k == 0) for o in odd] for k in range(3)]
    return level, kept


def plain_likeness(a, b):
    if a == b:
        return 1.0
    level = min(a[0], b[0]) + 2
    if level < max(a[0], b[0]):
        return 0.0
    x, y = a[1][level - a[0]], b[1][level - b[0]]
    either = sum(bool(p or q) for p, q in zip(x, y))
    return sum(bool(p) and p == q for p, q in zip(x, y)) / either if either else 0.0


def test_fingerprints_equal_a_plain_count(docs, corpus):
    ids = {}
    for _, t in corpus:
        for w in WORDS.findall((t or "").translate(LOW)):
            ids[w] = int(imatch.term_ids([w])[0][0])
    terms = {i: {ids[w] for w in WORDS.findall((t or "").translate(LOW))} for i, t in corpus}
    df = collections.Counter(x for s in terms.values() for x in s)
    n = len(corpus)
    lexicon = {x for x, c in df.items() if max(2, 0.0005 * n) <= c <= max(2, 0.2 * n)}
    order, text = sorted(terms, reverse=True), dict(corpus)
    plain = {i: plain_fingerprint(s, lexicon) for i, s in terms.items()}
    got = {r.doc_id: r for r in imatch.near_edits(docs).collect()}
    for k, i in enumerate(order):
        nxt = order[(k + 1) % n]
        a, b = text[i] or "", text[nxt] or ""
        edit = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        edited = plain_fingerprint({int(x) for x in imatch.term_ids([edit])[0]}, lexicon)
        assert got[i].near_next == pytest.approx(plain_likeness(plain[i], plain[nxt])) and got[i].near_edited == pytest.approx(plain_likeness(plain[i], edited))
    for i in order:
        for j in order:
            assert (got[i].fingerprint == got[j].fingerprint) == (plain[i] == plain[j])


def test_lexicon_in_shards(docs, spark):
    base = common.documents(docs)
    whole, cut = imatch.lexicon(base), imatch.lexicon(base, shard=3)
    terms = np.unique(np.concatenate(imatch.term_ids([r.text for r in base.collect()])))
    assert len(cut.shards) > 3 and (whole.inside(terms) == cut.inside(terms)).all() and len(whole.inside(terms))
    again = imatch.lexicon(common.documents(docs.repartition(7)))
    assert (again.inside(terms) == whole.inside(terms)).all()
    got = spark.range(1).select("id").mapInArrow(lambda it: (b for b in it), "id long").count()  # workers map shards, too
    assert got == 1 and imatch._mapped_shard(cut.shards[0]).tolist() == sorted(cut.shards[0].value.tolist())


def test_chained_lines_are_compared_by_bands(spark, monkeypatch):
    """Windows over one text chain by their bands though none is alike (0.77); near copies of some are found all the same."""
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(24_100))
    rows = [text[12 * i : 12 * i + 99] + "x" for i in range(2000)]
    docs = [(i, "\n".join(rows[i * 20 : i * 20 + 20])) for i in range(100)] + [(100, "\n".join(x[:-1] + "y" for x in rows[::100]))]
    seen = []
    whole = lines.tree_links

    def watched(sets, rivals, *args, **kw):
        seen.append(rivals.groupBy("component").count().agg({"count": "max"}).first()[0])
        return whole(sets, rivals, *args, **kw)

    monkeypatch.setattr(lines, "tree_links", watched)
    monkeypatch.setattr(lines, "TOGETHER", 100, raising=False)
    got = {r.doc_id: r.n_dropped for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: 20 if i == 100 else 0 for i in range(101)}
    assert seen[0] <= 100


def test_small_groups_are_read_together(spark, tmp_path):
    """A thousand pairs, a triple and a group of forty are read some hundred at a time, and link as all pairs do."""
    rng = np.random.default_rng(7)
    rows, rivals, groups = [], [], [2] * 1000 + [3, 40]
    for g, k in enumerate(groups):
        base = rng.integers(0, 1 << 62, 40, np.uint64)
        for _ in range(k):
            s = base[: 40 - int(rng.integers(0, 10))].copy()
            s[0] = rng.integers(0, 1 << 62)
            rows.append((len(rows), len(s), bytearray(np.sort(s).tobytes())))
            rivals.append((rows[-1][0], g))
    log = str(tmp_path / "reads")

    def read(items):
        with open(log, "a") as f:
            f.write("x\n")
        return [np.frombuffer(x, np.uint64) for x in items]

    sets = spark.createDataFrame(rows, "doc_id long, n long, items binary")
    found = jaccard.tree_links(sets, spark.createDataFrame(rivals, "id long, component long"), 80, read=read).collect()
    plain = [set(np.frombuffer(x, np.uint64).tolist()) for _, _, x in rows]
    of = np.array([g for _, g in rivals])
    want = [(a, b) for g in range(len(groups)) for ids in [np.flatnonzero(of == g).tolist()] for b in ids for a in ids if a < b and 100 * len(plain[a] & plain[b]) >= 80 * len(plain[a] | plain[b])]
    assert 100 < len(want) and {2 * g for g in range(1000)} - {a for a, _ in want}
    assert roots(len(rows), [(r.a, r.b) for r in found]) == roots(len(rows), want)
    with open(log) as f:
        assert len(f.readlines()) < 100
