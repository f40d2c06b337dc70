import base64
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shopstead.llm import bpe, chat

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PLACE = P.path("byte_bpe_50k.tiktoken"), P.PATTERN


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PLACE[0], "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300) | st.text(alphabet="ab \n.é", max_size=400) | st.sampled_from(["a" * 5000, " " * 700 + "x", "=-" * 900, "the" * 500]))
def test_same_ids_as_the_library(oracle, text):
    text = text.encode("utf-8", "ignore").decode()
    c = bpe.codec(*PLACE)
    ids = c.encode(text).tolist()
    assert ids == oracle.encode_ordinary(text)
    assert c.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=60), st.binary(max_size=60))
def test_join_is_a_monoid(left, right):
    c = bpe.codec(*PLACE)
    assert c.join(c.tree(left) if left else [], c.tree(right) if right else []) == bpe.merge(left + right, c.ranks) if left or right else True


def test_forgotten_pieces_come_back(oracle, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    c = bpe.codec(*PLACE)
    for text in ["one two three four five", "one six", "seven eight nine ten one", "one two"]:
        assert c.encode(text).tolist() == oracle.encode_ordinary(text)
    assert len(c.known) <= 8 and len(c.known.before) <= 8


def test_long_texts_are_cut_safely(oracle):
    text = ("word  \n\n next,  line's end\t" * 30_000)[:500_000]
    assert bpe.codec(*PLACE).encode(text).tolist() == oracle.encode_ordinary(text)


def test_long_texts_match_like_short_ones(monkeypatch):
    """A pattern whose matches run over the border of white space, and one with a group."""
    text = "".join(["a.....\n", "..\r\n\n", "word ", "  ", "1!\n"][k % 5] for k in range(400))
    for pattern in (r"[^\s\p{L}\p{N}]+[\r\n]*|\p{L}+|\p{N}|\s+", r"(\p{L}+|[^\p{L}]+)"):
        c = bpe.Codec({bytes([i]): i for i in range(256)}, pattern)
        whole = c.split(text)
        monkeypatch.setattr(bpe, "LONG", 10)
        monkeypatch.setattr(bpe, "PART", 7)
        parts = list(c.pieces(text))
        monkeypatch.undo()
        assert [x for part in parts for x in part] == whole and max(map(len, parts)) == 7
        assert c.encode(text).tolist() == list(text.encode())


def test_round_trip_of_all_rows(docs, corpus, empty, oracle):
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, *PLACE), *PLACE).collect()}
    for i, text in corpus:
        assert list(got[i].ids) == oracle.encode_ordinary(text or "") and bytes(got[i].decoded) == (text or "").encode() and got[i].n_tokens == len(got[i].ids)
    assert bpe.encode(empty, *PLACE).count() == 0


HARD = ["", None, "<|turn|>user<|text|>", "\\<|end|>", "\\\\|", "<\\|", "a\\", "é<|", "\n"]


def test_escape_is_reversible():
    for text in filter(None, HARD):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_chat_is_read_back(spark):
    rows = [(c, t, ["system", "user", "assistant"][t % 3], HARD[(c + t) % len(HARD)], "extra") for c in range(5) for t in range(7)]
    rows += [(9, None, None, None, "extra"), (9, 1, "assistant", "x", "e"), (9, 1, "assistant", "x", "e"), (None, 0, "user", "q", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string").repartition(4)
    formatted = chat.format_turns(df, *PLACE)
    got = {r.conv_id: r for r in chat.read_back(formatted, *PLACE).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        every = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(every.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    # spans tile the conversation
    spans = sorted((r.conv_id, r.start, r.start + len(r.ids)) for r in formatted.where("conv_id = 2").collect())
    assert all(a[2] == b[1] for a, b in zip(spans, spans[1:])) and spans[0][1] == 0
    assert chat.read_back(chat.format_turns(df.limit(0), *PLACE), *PLACE).count() == 0
