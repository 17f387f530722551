"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

Tokens by bytes is an incidence matrix, one for each vocabulary, in compressed rows. The product of one with the
transpose of the other links tokens that share bytes. Where tokens of both end at the same byte the text falls into
groups; tokens by groups are matrices as well, and their product links the tokens of a group.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import checkpointed
from .arrays import packed, steps, unpacked
from .common import rows_of, text_rows
from .pretokens import SOLID, Memory, looked_up, stretches

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
KINDS = ("overlap", "group", "end")
#: Chunks whose alignment a worker remembers in a generation; links that it holds before it adds them up.
REMEMBERED, COUNTED = 1 << 18, 1 << 21
#: Terms of a product that are added up at once.
TERMS = 1 << 22
#: Id pairs that may be broadcast, some 17 bytes each; beyond it counts meet the documents in a join.
BROADCAST_PAIRS = 1 << 22


_POWERS = 10 ** np.arange(1, 19)


class Csr(NamedTuple):
    """A sparse matrix by rows: those of row i are `columns[starts[i]:starts[i + 1]]`, with their `values`."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def csr(starts: np.ndarray, columns: np.ndarray, width: int) -> Csr:
    return Csr(starts.astype(np.int64), columns.astype(np.int64), np.ones(len(columns), np.int64), width)


def incidence(ends: np.ndarray) -> Csr:
    """Tokens by bytes, of tokens that lie side by side and end at these bytes."""
    n = int(ends[-1]) if len(ends) else 0
    return csr(np.concatenate([[0], ends]), np.arange(n), n)


def membership(groups: np.ndarray, n_groups: int) -> Csr:
    """Tokens by groups: each is in one."""
    return csr(np.arange(len(groups) + 1), groups, n_groups)


def transposed(m: Csr) -> Csr:
    """By counting: the entries of each column in the order of rows."""
    order = np.argsort(m.columns, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(m.columns, minlength=m.width))])
    return Csr(starts, m.rows()[order], m.values[order], len(m.starts) - 1)


def product(x: Csr, y: Csr) -> Csr:
    """Row by row: a row of the product is the sum of the rows of `y` that the row of `x` names, each by its value.

    Many rows are done at once, as many as have `TERMS` terms, so memory does not grow with the text.
    """
    terms = np.diff(y.starts)[x.columns]
    upto = np.concatenate([[0], np.cumsum(terms)])[x.starts]  # terms before each row
    counts, columns, values = [], [], []
    row, n = 0, len(x.starts) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(upto, upto[row] + TERMS, "right")) - 1)
        a, b = int(x.starts[row]), int(x.starts[last])
        size = terms[a:b]
        of = np.repeat(np.arange(a, b), size)
        at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + y.starts[x.columns[of]]
        key = (np.repeat(np.arange(last - row), np.diff(x.starts[row:last + 1]))[of - a]) * y.width + y.columns[at]
        cells, which = np.unique(key, return_inverse=True)
        counts.append(np.bincount(cells // max(y.width, 1), minlength=last - row))
        columns.append(cells % max(y.width, 1))
        values.append(np.bincount(which, weights=x.values[of] * y.values[at], minlength=len(cells)).astype(np.int64))
        row = last
    if not counts:
        return Csr(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), y.width)
    return Csr(np.concatenate([[0], np.cumsum(np.concatenate(counts))]), np.concatenate(columns), np.concatenate(values), y.width)


def shared_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """The bytes at which tokens of both end, in order: the ends of the groups."""
    return np.intersect1d(a_ends, b_ends, assume_unique=True)


def links(a_ends: np.ndarray, b_ends: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The linked tokens (places in A, places in B): with bytes in common, in one group, or with one end."""
    if kind == "group":
        ends = shared_ends(a_ends, b_ends)
        a, b = (membership(np.searchsorted(ends, x), len(ends)) for x in (a_ends, b_ends))
    else:
        a, b = incidence(a_ends), incidence(b_ends)
    got = product(a, transposed(b))
    left, right = got.rows(), got.columns
    if kind == "end":
        same = a_ends[left] == b_ends[right]
        left, right = left[same], right[same]
    return left, right


class Chunk(NamedTuple):
    """An aligned chunk: ids of both and the linked places, as 32-bit numbers."""

    a: bytes
    b: bytes
    left: bytes
    right: bytes


class Sums(NamedTuple):
    """What digests need of a chunk: numbers of tokens, groups and links, the groups as text, and the linked ids, a pair in a number."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups: str
    pairs: bytes


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Encodes chunks with both vocabularies and aligns them."""

    def __init__(self, a: str, b: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.kind = kind
        self.coder_a = Tokenizer.from_file(a)
        self.coder_a.encode_special_tokens = True
        self.coder_b = sentencepiece.SentencePieceProcessor(model_file=b)
        alphabet = byte_alphabet()
        self.bytes_a = [b""] * self.coder_a.get_vocab_size()
        for token, i in self.coder_a.get_vocab().items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        sp = self.coder_b
        self.bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
                        for i in range(sp.vocab_size())]
        self.signed = [f"{i}{x}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for x in ",|;"]
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))

    def most_pairs(self) -> int:
        """How many id pairs can end together: of two such tokens one is an ending of the other."""
        same_a, same_b = (max(Counter(x for x in v if x).values(), default=1) for v in (self.bytes_a, self.bytes_b))
        return sum(map(len, self.bytes_a)) * same_b + sum(map(len, self.bytes_b)) * same_a

    def _aligned(self, chunks: list[str]):
        """Aligned chunks, which a space goes before, side by side, so one product serves them all: those whose tokens
        give back their bytes, the ids of both, the linked places, where chunks begin in each, and their groups."""
        good, (a, a_from), (b, b_from) = self._encoded(chunks)
        a_ends, b_ends = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])
        left, right = links(a_ends, b_ends, self.kind)
        text, group_from = self._group_texts(a, b, a_ends, b_ends, a_from, b_from)
        return good, a, b, left, right, a_from, b_from, np.searchsorted(left, a_from), text, np.diff(group_from).tolist()

    def batch(self, chunks: list[str]) -> list[Chunk | None]:
        """Each chunk aligned; None where the tokens' bytes are not those of the chunk."""
        good, a, b, left, right, a_from, b_from, l_from, _, _ = self._aligned(chunks)
        n = np.diff(l_from)
        raw = [x.astype(np.int32).tobytes() for x in (a, b, left - np.repeat(a_from[:-1], n), right - np.repeat(b_from[:-1], n))]
        cuts = [(4 * x).tolist() for x in (a_from, b_from, l_from)]
        out: list[Chunk | None] = [None] * len(chunks)
        for k, i in enumerate(good):
            (p, q), (u, v), (x, y) = ((c[k], c[k + 1]) for c in cuts)
            out[i] = Chunk(raw[0][p:q], raw[1][u:v], raw[2][x:y], raw[3][x:y])
        return out

    def sums(self, chunks: list[str]) -> list[Sums | None]:
        """What digests need of each chunk; None as in `batch`."""
        good, a, b, left, right, a_from, b_from, l_from, text, n_groups = self._aligned(chunks)
        raw, cuts = ((a[left].astype(np.int64) << 32) | b[right]).tobytes(), (8 * l_from).tolist()
        out: list[Sums | None] = [None] * len(chunks)
        counts = zip(good, np.diff(a_from).tolist(), np.diff(b_from).tolist(), n_groups, np.diff(l_from).tolist(), text, cuts, cuts[1:])
        for i, n_a, n_b, groups, n, name, x, y in counts:
            out[i] = Sums(n_a, n_b, groups, n, name, raw[x:y])
        return out

    def _encoded(self, chunks: list[str]) -> tuple[list[int], tuple, tuple]:
        """The chunks that both vocabularies give back, and for each vocabulary their ids side by side and where chunks begin."""
        raw = [c.encode("utf-8", "surrogatepass") for c in chunks]
        # Chunks that can stand between others are encoded in one go, which costs a third of encoding them one by one.
        order = [i for i, c in enumerate(chunks) if c and c[0] in SOLID and c[-1] in SOLID]
        inner = len(order)
        order += sorted(set(range(len(chunks))) - set(order))
        sizes = np.fromiter((len(raw[i]) + 1 for i in order), np.int64, len(order))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        joined = "".join([f" {chunks[i]}" for i in order[:inner]])
        whole = b"".join([b" " + raw[i] for i in order])
        sides = []
        for encode, names, lengths in ((self.encode_a, self.bytes_a, self.lengths_a), (self.encode_b, self.bytes_b, self.lengths_b)):
            lists = [np.array(encode(joined), np.int32)] if inner else []
            lists += [np.array(encode(f" {chunks[i]}"), np.int32) for i in order[inner:]]
            ids = np.concatenate([np.zeros(0, np.int32), *lists])
            ends = np.concatenate([[0], np.cumsum(lengths[ids])])
            cuts = np.searchsorted(ends, starts)
            if ends[-1] != starts[-1] or (ends[cuts] != starts).any() or b"".join(map(names.__getitem__, ids.tolist())) != whole:
                return self._encoded_singly(chunks, raw)
            sides.append((ids, cuts))
        return order, *sides

    def _encoded_singly(self, chunks: list[str], raw: list[bytes]) -> tuple[list[int], tuple, tuple]:
        """The same where some chunk's tokens are not its bytes: chunk by chunk, without those."""
        good, kept = [], ([], [])
        for i, c in enumerate(chunks):
            ids = self.encode_a(f" {c}"), self.encode_b(f" {c}")
            if all(b"".join(map(names.__getitem__, x)) == b" " + raw[i] for names, x in zip((self.bytes_a, self.bytes_b), ids)):
                good.append(i)
                for held, x in zip(kept, ids):
                    held.append(np.array(x, np.int32))
        return good, *((np.concatenate([np.zeros(0, np.int32), *k]), np.concatenate([[0], np.cumsum([len(x) for x in k])]).astype(np.int64)) for k in kept)

    def encode_a(self, text: str) -> list[int]:
        return self.coder_a.encode_batch_fast([text], add_special_tokens=False)[0].ids  # without offsets

    def encode_b(self, text: str) -> list[int]:
        return self.coder_b.encode(text[1:])  # it adds the space itself

    def _group_texts(self, a, b, a_ends, b_ends, a_from, b_from) -> tuple[list[str], np.ndarray]:
        """Of each chunk the ids of its groups as text, and the number of groups before it."""
        ends = shared_ends(a_ends, b_ends)
        of_a, of_b = np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends)
        # A token of A stands behind the tokens of B of earlier groups, one of B behind those of A of its own as well.
        at_a = np.arange(len(a)) + np.searchsorted(of_b, of_a, "left")
        at_b = np.arange(len(b)) + np.searchsorted(of_a, of_b, "right")
        # An id with the sign behind it: a comma within a group, a bar between its sides, a semicolon at its end.
        ids, sign = np.empty(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
        ids[at_a], ids[at_b] = a, b
        sign[at_a[np.searchsorted(of_a, np.arange(len(ends)), "right") - 1]] = 1
        sign[at_b[np.searchsorted(of_b, np.arange(len(ends)), "right") - 1]] = 2
        whole = "".join(map(self.signed.__getitem__, (3 * ids + sign).tolist()))
        upto = np.concatenate([[0], np.cumsum(2 + np.searchsorted(_POWERS, ids, "right"))])
        cuts = upto[a_from + b_from].tolist()
        return [whole[p:q - 1] for p, q in zip(cuts[:-1], cuts[1:])], np.searchsorted(ends, np.concatenate([[0], a_ends])[a_from], "right")


@functools.lru_cache(maxsize=4)
def _memory(a: str, b: str, kind: str, sums: bool = False) -> Memory:
    aligner = Aligner(a, b, kind)
    return Memory(aligner.sums if sums else aligner.batch, REMEMBERED)


def _chunks(text: str) -> Iterator[list[str]]:
    """The chunks of a text; an empty one has none."""
    return stretches(text) if text else iter(([],))


def _paths(a: str | None, b: str | None) -> tuple[str, str]:
    return a or public_tokenizers.path(VOCABULARY_A), b or public_tokenizers.path(VOCABULARY_B)


def align(docs: DataFrame, *, kind: str = "overlap", a: str | None = None, b: str | None = None) -> DataFrame:
    """`doc_id`, `a_ids`, `b_ids` and `links`, the places (`a`, `b`) of linked tokens, of each text.

    A space and the text are encoded by vocabulary A (a byte-level file of the tokenizers library) and the text by
    B (a sentencepiece model, which adds the space), without special tokens. `kind` says what links two tokens:
    `overlap`, bytes in common; `group`, one group of the cuts both share; `end`, the same last byte. Texts that
    are null or empty, or whose tokens do not give back their bytes, have empty lists. Repeated rows and null ids
    are aligned row by row; other columns are not read; an empty table gives an empty result.

    Nothing moves: a text is cut at spaces that no token reaches across, and each distinct chunk is aligned once.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}")
    a, b = _paths(a, b)

    def run(batches):
        memory = _memory(a, b, kind)
        for ids, texts in rows_of(batches, "doc_id", "text"):
            for doc, found in zip(ids, looked_up(texts, _chunks, memory)):
                n_a, n_b = 0, 0
                got = [c for part in found for c in part]
                if None in got:
                    got = []
                left, right = [], []
                for c in got:
                    left.append(np.frombuffer(c.left, np.int32) + n_a)
                    right.append(np.frombuffer(c.right, np.int32) + n_b)
                    n_a, n_b = n_a + len(c.a) // 4, n_b + len(c.b) // 4
                tokens = [np.frombuffer(b"".join(x), np.int32) for x in ([c.a for c in got], [c.b for c in got])]
                pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int32()) for x in (left, right)], ["a", "b"])
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (*map(pa.array, tokens), pairs)]
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), *lists], names=["doc_id", "a_ids", "b_ids", "links"])

    return text_rows(docs).mapInArrow(run, "doc_id bigint, a_ids array<int>, b_ids array<int>, links array<struct<a:int,b:int>>")


_NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
_READ = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary, pairs binary, times binary"


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    new, first = np.unique(keys[order], return_index=True)
    return new, np.add.reduceat(counts[order], first) if len(new) else np.zeros(0, np.int64)


def _read(docs: DataFrame, a: str, b: str, kind: str) -> DataFrame:
    """A row for each text, with its linked id pairs in `links`; and of each task, in rows of `pairs` and `times`, how often
    it has linked which."""
    def run(batches):
        memory = _memory(a, b, kind, True)
        held, size = [], 0
        total = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def add():
            nonlocal held, size, total
            keys = np.concatenate([total[0], *held])
            total = _added(keys, np.concatenate([total[1], np.ones(len(keys) - len(total[0]), np.int64)]))
            held, size = [], 0

        for ids, texts in rows_of(batches, "doc_id", "text"):
            out = []
            for doc, text, found in zip(ids, texts, looked_up(texts, _chunks, memory)):
                n, sha, first, parts = [0] * 4, hashlib.sha256(), True, []
                whole = bool(text)
                for got in found if whole else ():
                    if None in got:
                        whole = False
                        break
                    n_a, n_b, n_groups, n_links, groups, pairs = zip(*got)
                    n = [x + sum(y) for x, y in zip(n, (n_a, n_b, n_groups, n_links))]
                    sha.update(("" if first else ";").encode() + ";".join(groups).encode())
                    parts.append(b"".join(pairs))
                    first = False
                links = np.sort(np.frombuffer(b"".join(parts) if whole else b"", np.int64))
                out.append((doc, *(n if whole else [0] * 4), sha.hexdigest() if whole else "", packed(steps(links)), None, None))
                held.append(links)
                size += len(links)
                if size >= COUNTED:
                    add()
            yield rows(out)
        add()
        if len(total[0]):
            yield rows([(None, None, None, None, None, None, None, packed(steps(total[0])), packed(total[1]))])

    def rows(out):
        kinds = [pa.int64()] * 5 + [pa.string()] + [pa.binary()] * 3
        names = [c.split()[0] for c in _READ.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 9, kinds)], names=names)

    return text_rows(docs).mapInArrow(run, _READ)


def _counts(read: DataFrame) -> DataFrame:
    """(`a_id`, `b_id`, `n`) over all tasks."""
    def run(batches):
        for pairs, times in rows_of(batches, "pairs", "times"):
            for p, t in zip(pairs, times):
                p = np.cumsum(unpacked(p, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array((p >> 32).astype(np.int32)), pa.array((p & 0xFFFFFFFF).astype(np.int32)),
                                                  pa.array(unpacked(t, np.int64))], names=["a_id", "b_id", "n"])

    each = read.where("links is null").select("pairs", "times").mapInArrow(run, "a_id int, b_id int, n bigint")
    return each.groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, *, kind: str = "end", a: str | None = None, b: str | None = None) -> DataFrame:
    """(`a_id`, `b_id`, `n`): how many links of the whole corpus hold each pair of ids.

    A task passes on each distinct pair once, so what moves is bounded by the vocabularies.
    """
    return _counts(_read(docs, *_paths(a, b), kind))


def digests(docs: DataFrame, *, a: str | None = None, b: str | None = None, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """A row for each row of `docs`: `doc_id`, `n_a`, `n_b`, `n_groups`, `n_links`, `n_best`, `count_sum`, `groups_sha256`.

    Links are tokens that end together. `n_best` are those whose pair of ids is the most frequent of its B id in the
    corpus, ties included, and `count_sum` adds up the corpus counts of all links. `groups_sha256` is the digest of the
    ids by group (`a1,a2|b1;a3|b2`). Rows without tokens, see `align`, have zeros and an empty string.

    The texts are read once; their links are checkpointed, a few bits each, and looked up when all are counted. Of two
    tokens that end together one is an ending of the other, so the vocabularies bound the distinct pairs, however
    large the corpus; up to `broadcast_pairs` the counts are broadcast, beyond it each text's distinct pairs are
    joined with them. Runs jobs when called.
    """
    a, b = _paths(a, b)
    read = checkpointed(_read(docs, a, b, "end"))
    weighted = checkpointed(_counts(read).withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b_id"))))
    rows = read.where("links is not null").select(*_NAMES, "links")
    order = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    if Aligner(a, b, "end").most_pairs() > broadcast_pairs:
        return _joined(rows, weighted).select(*order)
    key = (F.shiftleft(F.col("a_id").cast("long"), 32) + F.col("b_id")).alias("key")
    table = weighted.select(key, "n", "best").orderBy("key").toArrow()
    held = docs.sparkSession.sparkContext.broadcast([table[c].to_numpy() for c in ("key", "n", "best")])

    def run(batches):
        keys, n, best = held.value
        for batch in batches:
            links = [np.cumsum(unpacked(x, np.int64)) for x in batch.column("links").to_pylist()]
            sums = []
            for x in links:
                at = np.searchsorted(keys, x)
                sums.append((int(best[at].sum()), int(n[at].sum())))
            added = [pa.array(c, pa.int64()) for c in (zip(*sums) if sums else ((), ()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in _NAMES), *added], names=[*_NAMES, "n_best", "count_sum"])

    return rows.mapInArrow(run, ", ".join(f"{x} {'string' if x == 'groups_sha256' else 'bigint'}" for x in (*_NAMES, "n_best", "count_sum"))).select(*order)


def _joined(rows: DataFrame, weighted: DataFrame) -> DataFrame:
    """`rows` with `n_best` and `count_sum`, where the counts are too many to broadcast."""
    def run(batches):
        for ids, links in rows_of(batches, "row", "links"):
            for i, x in zip(ids, links):
                pairs, times = np.unique(np.cumsum(unpacked(x, np.int64)), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pairs), i, np.int64)), pa.array((pairs >> 32).astype(np.int32)),
                     pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(times.astype(np.int64))], names=["row", "a_id", "b_id", "times"])

    rows = rows.withColumn("row", F.monotonically_increasing_id())
    each = rows.select("row", "links").mapInArrow(run, "row bigint, a_id int, b_id int, times bigint")
    sums = each.join(weighted, ["a_id", "b_id"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("times") * F.col("n")).alias("sum"))
    return rows.join(sums, "row", "left").withColumns({"n_best": F.coalesce("best", F.lit(0)), "count_sum": F.coalesce("sum", F.lit(0))})
