"""Token ids of texts in ORC files: run-length encoded integers, row indexes, and Bloom filters on the document id."""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import rows_of, text_rows
from .pretokens import Memory, encoded, looked_up, stretches

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Bytes of a stripe, rows between index entries and between looks at the stripe's size, and wrong answers of the Bloom filters.
STRIPE_BYTES, INDEX_ROWS, SIZED_ROWS, BLOOM_FPP = 16 << 20, 1000, 256, 0.01
#: Chunks whose ids a worker remembers in a generation, and ids of a batch that goes back to Spark.
REMEMBERED, BATCH_IDS = 1 << 19, 1 << 21

_FILE = "doc_id bigint, part int, first bigint, n_tokens int, ids array<int>"


@functools.lru_cache(maxsize=2)
def _memory(vocabulary: str) -> Memory:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(vocabulary)
    lengths = np.zeros(max(coder.get_vocab().values(), default=0) + 1, np.int64)
    for token, i in coder.get_vocab().items():
        lengths[i] = len(token)  # a byte-level token has a character for each byte

    def ids_of(text: str) -> list[int]:
        return coder.encode_batch_fast([text], add_special_tokens=False)[0].ids  # without offsets, which nobody asks for

    def make(chunks: list) -> list[bytes]:
        ids, order, ends = encoded(chunks, ids_of, lengths)
        raw, out, at = ids.tobytes(), [b""] * len(chunks), 0
        for i, end in zip(order, (4 * ends).tolist()):
            out[i] = raw[at:end]
            at = end
        return out

    return Memory(make, REMEMBERED)


def _chunks(text: str) -> Iterator[list]:
    """The chunks of a text; the very first, which has no space before it, in a tuple."""
    for n, chunks in enumerate(stretches(text)):
        if not n:
            chunks[0] = (chunks[0],)
        yield chunks


def encode(text: str, vocabulary: str) -> bytes:
    """The ids of a whole text as 32-bit integers.

    Chunks are encoded by themselves, each distinct one once; none of the vocabulary's splits reaches over the
    space they begin with, so the ids are those of the text in one go.
    """
    return next(encode_all([text], vocabulary))


def encode_all(texts: list[str], vocabulary: str) -> Iterator[bytes]:
    """The ids of each text."""
    for found in looked_up(texts, _chunks, _memory(vocabulary)):
        yield b"".join([b"".join(ids) for ids in found])


def write_token_ids(docs: DataFrame, path: str, *, vocabulary: str | None = None, end_id: int = END_ID,
                    stripe_bytes: int = STRIPE_BYTES, index_rows: int = INDEX_ROWS) -> None:
    """Write the ids of all texts to ORC files in `path`, in ascending order of `doc_id`.

    A row holds `doc_id`, the number `part` of its file in the order, `first`, the ids before it in that file,
    `n_tokens` and `ids`, the text's ids with `end_id` behind them. ORC writes the integers run-length encoded,
    keeps the least and greatest `doc_id` of each stripe and of every `index_rows` rows, and a Bloom filter on
    `doc_id`; a reader takes any stripe by itself and skips those without the ids it looks for.

    `vocabulary` is the path of a file of the tokenizers library, there on every executor; by default the public
    byte-level one. No special tokens are added; those written out in a text are what the library makes of them.
    Null and empty texts have the end id alone. Null ids come first; different texts of one id are in the order
    of their hashes, repeated rows are written as often as they are there. An empty table gives files without rows.
    Only `doc_id` and `text` are read.

    Scale: texts, which are smaller than their ids, move once to ranges of ids, split within an id if need be, and
    are encoded where they are written.
    """
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    order = ["doc_id", "hash", "row"]
    rows = text_rows(docs).withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})

    def run(batches):
        part, first = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def batch():
            nonlocal held, size
            ids = np.frombuffer(b"".join(h[2] for h in held), np.int32)
            n = np.array([len(h[2]) // 4 for h in held], np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
            out = pa.RecordBatch.from_arrays(
                [pa.array([h[0] for h in held], pa.int64()), pa.array(np.full(len(held), part, np.int32)),
                 pa.array([h[1] for h in held], pa.int64()), pa.array(n), lists], names=["doc_id", "part", "first", "n_tokens", "ids"])
            held, size = [], 0
            return out

        end = np.int32(end_id).tobytes()
        for ids, texts in rows_of(batches, "doc_id", "text"):
            for doc, found in zip(ids, encode_all(texts, vocabulary)):
                held.append((doc, first, found + end))
                first += len(held[-1][2]) // 4
                size += len(held[-1][2]) // 4
                if size >= BATCH_IDS:
                    yield batch()
        if held:
            yield batch()

    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, _FILE) \
        .write.mode("overwrite").options(**{
            "compression": "zstd", "orc.stripe.size": stripe_bytes, "orc.row.index.stride": index_rows, "orc.rows.between.memory.checks": SIZED_ROWS,
            "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": BLOOM_FPP}).orc(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_FILE).orc(path)


def _placed(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """`rows` with `start`: the ids in the files before theirs, a row a file, and those before them in it."""
    sums = _files(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("all"))
    before = sums.select("part", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(before, "part").withColumn("start", F.col("before") + F.col("first")).drop("before", "first", "part")


def read_token_ids(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """`doc_id`, `start` (ids of all documents before it), `n_tokens` and `ids`, from the files.

    With `doc_ids` only their rows: the condition goes down to the reader, which skips files, stripes and runs of
    rows by their statistics and Bloom filters.
    """
    rows = _files(spark, path)
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(list(doc_ids)))
    return _placed(spark, path, rows).select("doc_id", "start", "n_tokens", "ids")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """`doc_id`, `start`, `n_tokens` and `ids_crc32` of each row, read back from the files."""
    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            values, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            kept = [batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "part", "first")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
                                             names=["doc_id", "part", "first", "n_tokens", "ids_crc32"])

    rows = _files(spark, path).select("doc_id", "part", "first", "ids").mapInArrow(
        run, "doc_id bigint, part int, first bigint, n_tokens bigint, ids_crc32 bigint")
    return _placed(spark, path, rows).select("doc_id", "start", "n_tokens", "ids_crc32")
