import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, spans string"


@pytest.fixture(scope="session")
def corpus():
    """Small texts with every awkward case: nulls, empty and blank texts, one very long text, exact and near copies,
    repeated lines, ties, and non-ASCII."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 8))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [None, "", " \n\t ", "one", "two words", "A B C", "\U0001f600 x", say(6000)]
    for _ in range(12):
        lines = [say(rng.randint(5, 30)) for _ in range(rng.randint(1, 6))]
        texts.append("\n".join(lines))
    base = [t for t in texts[-6:]]
    texts += base[:3]  # exact copies
    texts += [b + " " + say(1) for b in base]  # near copies
    texts += [b.replace(" ", "  ", 1).upper() for b in base[:2]]
    texts += ["\n".join([texts[9].split("\n")[0], say(12), texts[9].split("\n")[0]]), "é" * 400, "ab " * 200]
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, "en", [None, "a", "b", "é"][i % 4], len(t or ""), 0.0, "x", "y") for i, t in corpus]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
