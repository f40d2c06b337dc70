"""Spelling variants, decontamination and the prefix trie against plain counts, and their SQL on the small tables."""

import collections
import hashlib
import itertools
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from shopstead.llm import phrases, queries, trie, variants

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


def edits(w):
    """w without each letter in turn, with the place: equal for two words of one length if they differ there only."""
    return {(i, w[:i] + w[i + 1 :]) for i in range(len(w))}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(cut == a for _, cut in edits(b))


def plain_variants(rows, every, least):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= least}
    by = {w: [v for v in n if near(v, w)] for w in n}
    form = {}
    for w, others in by.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(by[w]), n.get(form[w])))
    return out


def got_variants(docs, every, least):
    rows = variants.variants(docs, every, least).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("full", [100, 2])
def test_variants_equal_all_pairs(spark, monkeypatch, full):
    """Few letters, so that halves are shared by many words and their buckets are split down to single letters."""
    monkeypatch.setattr(variants, "FULL", full)
    rng = random.Random(5)
    words = ["".join(rng.choice("abÀÿ") for _ in range(rng.choice([4, 5, 5, 6, 7]))) for _ in range(150)] + ["x" * 3000, "x" * 2999 + "y", "x" * 3001]
    rows = [(k, " ".join(rng.choices(words, k=40)) + rng.choice([" ÉTÉAB.étéab", "-ABCDE abcde_abcdf", " x×y÷z"])) for k in range(60)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (8, None), (9, ""), (10, "ab퟿ cdefg\U0001f600hijkl"), (-3, "abcde " * 5)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, word string, n string").repartition(3)
    assert got_variants(docs, 5, 3) == plain_variants(rows, 5, 3)
    assert got_variants(docs.limit(0), 5, 3) == set()


def test_chains_lead_to_one_root(spark):
    """Counts that double along a chain, and a tie of two forms."""
    said = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "ccccc": 3, "ccccd": 6, "cccce": 6, "fffff": 5, "ffffg": 9}
    rows = [(k, " ".join([w] * c)) for k, (w, c) in enumerate(said.items())]
    got = {r.word: (r.form, r.root) for r in variants.variants(spark.createDataFrame(rows, "doc_id long, text string"), every=1 << 40).collect()}
    assert got["aaaaa"] == ("aaaab", "aabbb") and got["aabbb"] == (None, "aabbb")
    assert got["ccccc"] == ("ccccd", "ccccd") and got["fffff"] == (None, "fffff")


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall((text or "").translate(LOW))


def grams(items, width):
    for i, text in items:
        w = words(text)
        for s in range(max(1, len(w) - width + 1)) if w else ():
            yield i, w[s : s + width]


def plain_matches(text, gram, slop):
    """(first, last) of each place where the gram's words follow each other, each at its first place after the last."""
    w = words(text)
    for s in range(len(w)):
        if w[s] == gram[0]:
            at = s
            for g in gram[1:]:
                at = next((k for k in range(at + 1, len(w)) if w[k] == g), None)
                if at is None:
                    break
            if at is not None and at < s + len(gram) + slop:
                yield s, at


@pytest.fixture(scope="module")
def items():
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["a", "b", "c", "dé", "E1"]) for _ in range(n))
    return [(k, say(rng.choice([2, 5, 9, 14]))) for k in range(12)] + [(3, say(6)), (None, "a b c a a"), (40, None), (41, "?!"), (42, "z"), (43, "the  same")]


@pytest.mark.parametrize("width,slop,shard", [(4, 0, 200_000), (4, 0, 10), (3, 2, 200_000), (3, 3, 10)])
def test_contamination_equals_plain_search(spark, items, monkeypatch, width, slop, shard):
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "PIECE", 3)
    rng = random.Random(width + slop)
    texts = ["".join(rng.choice(["a", "b", "c", "DÉ", "dé", "e1", "zz", "_"]) + rng.choice([" ", "\n", "-", "\x00"]) for _ in range(rng.randint(1, 60))) for _ in range(25)]
    rows = [*enumerate(texts), (5, texts[5]), (None, texts[6]), (90, None), (91, ""), (92, "z"), (93, "z!" * 9000)]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, n_hit int, item_id string").repartition(2)
    bench = spark.createDataFrame([(*r, "d") for r in items], "item_id long, text string, doc_id string")
    all_grams = list(grams(items, width))
    want, found = [], set()
    for i, text in rows:
        hit, names = set(), set()
        for name, gram in all_grams:
            for s, e in plain_matches(text, gram, slop):
                hit |= set(range(s, e + 1))
                names |= {str(name)} - {"None"}
                found.add((i, None if name is None else str(name), len(gram), s, e))
        want.append((i, len(words(text)), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    indexed = phrases.index(docs)
    assert sorted(map(str, map(tuple, phrases.contamination(indexed, bench, width, slop).collect()))) == sorted(map(str, want))
    assert {tuple(r) for r in phrases.matches(indexed, bench, width, slop).collect()} == found
    clean = phrases.contamination(indexed, bench.limit(0), width, slop).collect()
    assert len(clean) == len(rows) and not any(r.contaminated or r.n_items for r in clean)
    assert phrases.contamination(phrases.index(docs.limit(0)), bench, width, slop).count() == 0


def test_many_places_are_looked_at_in_slices(monkeypatch):
    texts = ["a b " * 200, "b a " * 150 + "c"]
    terms, cuts = phrases.terms_of(texts)
    order = np.argsort(terms, kind="stable")
    first = phrases.group_starts(terms[order])
    block = phrases.Block(np.diff(cuts), terms[order][first].tobytes(), phrases._narrow(np.diff(np.r_[first, len(order)])), phrases._narrow(np.diff(order, prepend=0).astype(np.uint32)))
    a, b, c = (phrases.terms_of([x])[0][0] for x in "abc")
    shapes = np.array([[a, b], [b, a], [a, c]], np.uint64), np.array([2, 2, 2])
    whole = lambda slop: {t for part in block.matches(*shapes, slop) for t in zip(*[v.tolist() for v in part])}
    want = whole(0), whole(3)
    assert len(want[0]) == 200 + 199 + 149 + 150 + 1
    monkeypatch.setattr(phrases, "PLACES", 7)
    assert (whole(0), whole(3)) == want


def plain_trie(rows):
    digest = lambda role, text: hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    tokens = lambda node: len(SPACED.findall(node[-1][1])) if node else 0
    out = []
    for node, own_members in members.items():
        below = [v for v in members if v[: len(node)] == node]
        inner = {v[:-1] for v in members if v}
        ends = ",".join(map(str, sorted(c for c in own_members if built[c] == node)))
        out.append((
            min(own_members), len(node), min(members[node[:-1]]) if node else None, len(own_members), sum(v[:-1] == node for v in members if v),
            sum(v not in inner for v in below), sum((len(members[v]) - 1) * tokens(v) for v in below), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


@pytest.mark.parametrize("bits,share", [(12, 1000), (1, 3)])
def test_trie_equals_a_plain_one(spark, monkeypatch, bits, share):
    """Ranges of two turns and ids, few hot keys: conversations, nodes and lists are cut in many parts."""
    monkeypatch.setattr(trie, "BITS", bits)
    monkeypatch.setattr(trie, "SHARE", share)
    rng = random.Random(6)
    rows = []
    for c in [*range(-30, 90), 20 * 10**15 + 3]:
        if rng.random() < 0.8:
            for t in range(rng.choice([1, 2, 3, 5, 40 if c == 60 else 4])):
                rows.append((c, rng.choice([t, t, t, None, t - 1]), rng.choice(["user", "assistant", None, ""]), rng.choice(["hi", "hi there", "a b c", None, "", "x " * 500, "é\n ü"])))
    rows += rows[:9] + [(None, 0, "user", "hi"), (5, None, None, None)]
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, digest string").repartition(3)
    got = [tuple(r) for r in trie.rebuilt_trie(turns).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_trie(rows)))
    assert trie.rebuilt_trie(turns.limit(0)).count() == 0


def test_many_ends_are_one_digest(spark):
    rows = [(c, 0, "user", "same") for c in itertools.chain(range(100, 9000, 20), range(10**9, 10**9 + 100_000, 2000))]
    rows = [(c, *r) for c, *r in rows if zlib.crc32(str(c).encode()) % 4 == 0]
    got = trie.rebuilt_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("depth = 1").collect()
    ids = [c for c, *_ in rows]
    assert [(r.n_convs, r.ends_sha256) for r in got] == [(len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())]


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_decontamination", "op13_prefix_trie"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    want = con.sql(queries.oracle_sql()[name])
    columns = want.columns
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))
