"""Chat formatting at token level: segments are encoded apart, reserved ids spliced in, masks are prefix sums."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec
from .common import mapped, rows_of

#: The template: TURN role TEXT text END for each turn. All control strings open with "<|", which escaped content
#: never holds, and stand for reserved ids past the vocabulary, which encoding never gives.
CONTROLS = ("<|turn|>", "<|text|>", "<|end|>")
TRAINED_ROLE = "assistant"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def reserved(c) -> tuple[int, int, int]:
    return tuple(len(c.bytes_of) + 1 + k for k in range(len(CONTROLS)))


def format_turns(conversations: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row a turn: conv_id, turn, ids, start (tokens of the conversation before it), loss_start, loss_end (the span
    of its tokens, counted in the conversation, that bears loss; empty unless the assistant speaks).

    A conversation's ids are its rows' ids in order of start; its mask is the union of the spans. Encoding happens
    before the shuffle, row by row; positions are prefix sums over the conversation. Null role and text are empty,
    a null conv_id is a conversation of its own, null turns come first; equal turns go by role, then text. Repeated
    rows are turns of their own. Extra columns are left behind.
    """

    def run(batches):
        c = codec(path, pattern)
        turn_id, text_id, end_id = reserved(c)
        for conv, turn, role, text in rows_of(batches, ("conv_id", "turn", "role", "text")):
            ids, before, inside = [], [], []
            for r, t in zip(role, text):
                head, body = c.encode(escape(r or "")), c.encode(escape(t or ""))
                ids.append(np.r_[turn_id, head, text_id, body, end_id].astype(np.int32))
                before.append(len(head) + 2)
                inside.append(len(body) if r == TRAINED_ROLE else 0)
            offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(turn, pa.int64()), pa.array(role, pa.string()), pa.array(text, pa.string()), lists, pa.array(before, pa.int32()), pa.array(inside, pa.int32())], names=["conv_id", "turn", "role", "text", "ids", "before", "inside"])

    encoded = mapped(conversations.select("conv_id", "turn", "role", "text"), run, "conv_id long, turn long, role string, text string, ids array<int>, before int, inside int")
    so_far = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.size("ids")).over(so_far), F.lit(0)).cast("long")
    return encoded.withColumn("start", start).select("conv_id", "turn", "ids", "start", (F.col("start") + F.col("before")).alias("loss_start"), (F.col("start") + F.col("before") + F.col("inside")).alias("loss_end"))


class _Reader:
    """Reads one conversation back from its turns' ids and loss spans, keeping only running digests."""

    def __init__(self, c):
        self.c, self.marks = c, reserved(c)
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def text(self, ids) -> str:
        return self.c.decode(ids.tolist()).decode("utf-8", "surrogatepass")

    def add(self, ids: np.ndarray, start: int, loss_start: int, loss_end: int) -> None:
        a, b, e = (int(np.flatnonzero(ids == m)[0]) for m in self.marks)
        role, text = self.text(ids[a + 1 : b]), self.text(ids[b + 1 : e])
        self.turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))
        self.chars += sum(map(len, CONTROLS)) + len(role) + len(text)
        trained = unescape(self.text(ids[loss_start - start : loss_end - start]))
        self.loss.update(trained.encode("utf-8", "surrogatepass"))
        self.loss_chars += len(trained)
        self.n += 1

    def row(self):
        return (self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def read_back(formatted: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of each conversation, recovered from ids and spans alone. A conversation's turns stream through one
    task in order (its digest is sequential by nature), a turn at a time, so memory does not grow with its length."""
    columns = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")

    def run(batches):
        c = codec(path, pattern)
        now, reader, done = None, None, []

        def flush():
            convs, rows = zip(*done)
            return pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), *map(pa.array, zip(*rows))], names=["conv_id", *columns])

        for batch in batches:
            conv, start, a, b = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "start", "loss_start", "loss_end"))
            lists = batch.column(batch.schema.get_field_index("ids"))
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i, key in enumerate(conv):
                if reader is None or key != now:
                    if reader:
                        done.append((now, reader.row()))
                    now, reader = key, _Reader(c)
                reader.add(values[offsets[i] : offsets[i + 1]], start[i], a[i], b[i])
            if len(done) >= 1000:
                yield flush()
                done = []
        if reader:
            done.append((now, reader.row()))
        if done:
            yield flush()

    ordered = formatted.select("conv_id", "start", "loss_start", "loss_end", "ids").repartition("conv_id").sortWithinPartitions("conv_id", "start")
    return mapped(ordered, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
