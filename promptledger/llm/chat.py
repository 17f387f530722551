"""Chat formatting on token level: segments are encoded by themselves, reserved ids mark the turns."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import rows_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splitting pattern of the vocabulary; a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
#: Longest piece given to the encoder at once; pieces are cut at white space, or hard where there is none.
PIECE = 1 << 15

_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """One backslash more between `<` and `|`: no control string, nor any `<|`, is left, and it can be undone."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


#: Stands for a newline in a role, whose own newline ends it; cannot occur in escaped text.
_NEWLINE = "<|newline|>"


def escape_role(role: str) -> str:
    return escape(role).replace("\n", _NEWLINE)


def unescape_role(role: str) -> str:
    return unescape(role.replace(_NEWLINE, "\n"))


class Template:
    """Encodes turns as ids: start, role, newline, text, end, newline. Reserved ids lie above the vocabulary."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        top = max(ranks.values()) + 1
        self.start, self.end = top, top + 1
        self.newline = self.coder.encode_ordinary("\n")

    def encode(self, text: str) -> list[int]:
        if len(text) <= PIECE:
            return self.coder.encode_ordinary(text)
        out, at = [], 0
        while at < len(text):
            cut = min(at + PIECE, len(text))
            if cut < len(text) and (gap := max(text.rfind(" ", at, cut), text.rfind("\n", at, cut))) > at:
                cut = gap
            out += self.coder.encode_ordinary(text[at:cut])
            at = cut
        return out

    def turn(self, role: str, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids of one turn and the runs [from, to) of them that carry loss.

        Segment lengths and their loss flags give the runs by a running sum.
        """
        body = self.encode(escape(text))
        segments = [([self.start], False), (self.encode(escape_role(role)), False), (self.newline, False),
                    (body, role == TRAINED_ROLE), ([self.end], False), (self.newline, False)]
        ends = list(accumulate(len(ids) for ids, _ in segments))
        runs = [(end - len(ids), end) for (ids, loss), end in zip(segments, ends) if loss and ids]
        return [i for ids, _ in segments for i in ids], runs

    def render(self, ids: list[int]) -> str:
        """The formatted text: reserved ids as control strings, all others decoded."""
        out, run = [], []
        for i in ids:
            if i in (self.start, self.end):
                out += [self.coder.decode(run), START if i == self.start else END]
                run = []
            else:
                run.append(i)
        return "".join(out) + self.coder.decode(run)

    def read(self, ids: list[int]) -> tuple[str, str]:
        """Role and text of a turn, from its ids alone."""
        first, last = ids.index(self.start), len(ids) - 1 - ids[::-1].index(self.end)
        body = self.coder.decode_bytes(ids[first + 1:last]).decode("utf-8")
        role, _, text = body.partition("\n")
        return unescape_role(role), unescape(text)

    def loss_text(self, ids: list[int], runs: list[tuple[int, int]]) -> str:
        return "".join(unescape(self.coder.decode(ids[a:b])) for a, b in runs)


@functools.lru_cache(maxsize=2)
def template(vocabulary: str) -> Template:
    return Template(vocabulary)


_TURNS = "conv_id bigint, turn bigint, ord bigint, ids array<int>, loss array<struct<a:int,b:int>>"
_DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def format_turns(conversations: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per turn: `conv_id`, `turn`, `ord`, `ids`, and `loss`, the runs of ids that are trained on.

    A conversation's ids are those of its rows put together by (`turn`, `ord`), nulls first. Turns are encoded
    where they are read, one conversation may therefore be spread over any number of tasks. Only texts of the
    role `assistant` carry loss, without the marks around them. Null roles and texts count as empty. Repeated rows are turns of their own;
    `ord`, a hash of role and text, puts equal turn numbers in a fixed order. An empty table stays empty.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                role.alias("role"), text.alias("text"))

    def run(batches):
        t = template(vocabulary)
        for convs, turns, ords, roles, texts in rows_of(batches, "conv_id", "turn", "ord", "role", "text"):
            made = [t.turn(r, x) for r, x in zip(roles, texts)]
            loss = [[{"a": a, "b": b} for a, b in runs] for _, runs in made]
            yield pa.RecordBatch.from_arrays(
                [pa.array(convs, pa.int64()), pa.array(turns, pa.int64()), pa.array(ords, pa.int64()),
                 pa.array([ids for ids, _ in made], pa.list_(pa.int32())),
                 pa.array(loss, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))],
                names=["conv_id", "turn", "ord", "ids", "loss"])

    return rows.select("conv_id", "turn", F.xxhash64("role", "text").alias("ord"), "role", "text").mapInArrow(run, _TURNS)


def digests(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per conversation, read back from `format_turns`: counts and digests of its turns and of its loss text.

    Rows are dealt by conversation and sorted; a task then passes over its rows once and holds one batch and the
    running digests, so a conversation with a third of all turns costs time but no memory. A digest over a
    sequence leaves no other order; the encoding before it is spread evenly.
    """
    def run(batches):
        t = template(vocabulary)
        now, state = object(), None
        for convs, ids, loss in rows_of(batches, "conv_id", "ids", "loss"):
            done = []
            for conv, i, runs in zip(convs, ids, loss):
                if conv != now:
                    if state:
                        done.append(ended(now, state))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = t.read(i)
                trained = t.loss_text(i, [(x["a"], x["b"]) for x in runs])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(trained)
                state[3].update(trained.encode())
                state[4] += len(t.render(i))
            yield table(done)
        if state:
            yield table([ended(now, state)])

    def ended(conv, s):
        return conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]

    def table(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], names=names)

    order = ["conv_id", "turn", "ord"]
    return turns.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, _DIGESTS)


def token_places(turns: DataFrame) -> DataFrame:
    """`turns` with `first_id`, the place of its ids in the whole conversation: a running sum of the id counts."""
    w = Window.partitionBy("conv_id").orderBy("turn", "ord").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("first_id", F.coalesce(F.sum(F.size("ids")).over(w), F.lit(0)))
