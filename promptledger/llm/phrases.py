"""Phrase collocations by set-oriented relational mining of occurrence relations.

The occurrences of a language's frequent groups of k words are a relation (piece, position, group), sorted and
persisted. Joined with itself at adjacent positions it gives the groups of k + 1 words; these are counted, and the
occurrences of the frequent ones alone, by a semi-join, are the next relation.

A relation is stored in blocks, some million positions of one language, a row each; pieces lie whole in a block, and
the end of a piece takes a position, so adjacent positions are of one piece. Rows of a block are sorted, the
merge-join is therefore done where the block is read. What is shuffled is each block's groups with their counts, in
packets by range of a hash, and back to the block those that are frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import checkpointed
from .arrays import packed, steps, unpacked
from .common import rows_of
from .shingles import mixed

#: A phrase counts from so many occurrences on; the longest phrase; rows returned per language.
MIN_COUNT, LONGEST, TOP = 100, 5, 2000
#: A phrase goes if a longer one that holds it reaches this percentage of its occurrences.
ABSORBED_PERCENT = 100
#: Positions of a block, unless a single piece has more; positions that a task gathers before it writes its blocks.
BLOCK, HELD = 1 << 21, 1 << 22
#: Words of the corpus for each range of pairs that is counted by itself.
RANGE = 1 << 21

# The characters that end a piece, and the one of its own between words.
ENDS, TAB = b".,;:!?\n\x0b\x0c\r", b"\t"

#: Ends a piece; no byte of UTF-8 has this value.
_END = b"\xff"
_TABLE = bytes.maketrans(ENDS + TAB, _END * len(ENDS) + b" ")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in order, A-Z lower-cased, with `_END` after each piece."""
    data = (text or "").encode("utf-8", "surrogatepass").lower().translate(_TABLE)
    return (data + _END).replace(_END, b" " + _END + b" ").split()


class _Numbers(dict):
    """Numbers words as they come; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class _Block:
    """Positions of one language that a task has read."""

    def __init__(self):
        self.numbers, self.parts, self.size = _Numbers(), [], 0

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def relation(self) -> tuple[int, np.ndarray, np.ndarray, list[bytes]]:
        """Words, occurrences by rank (0: end of a piece), counts by rank from 1 on, and the words by rank; most frequent first."""
        at = np.concatenate(self.parts)
        counts = np.bincount(at, minlength=len(self.numbers))
        order = np.concatenate([[0], np.argsort(-counts[1:], kind="stable") + 1])
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        names = list(self.numbers)
        return int(counts[1:].sum()), rank[at], counts[order[1:]], [names[i] for i in order[1:]]


_READ = "block bigint, lang string, n bigint, at binary, counts binary, words binary"


def _read(docs: DataFrame) -> DataFrame:
    """Blocks of all words: occurrences, counts and the words themselves.

    A block is numbered by the positions its task has written before; with the task's number in front no number of
    a block plus a place in it occurs twice.
    """
    def run(batches):
        before = TaskContext.get().partitionId() << 40
        blocks: dict[str, _Block] = {}
        held = 0

        def rows(langs: list[str]) -> pa.RecordBatch:
            nonlocal before, held
            out = []
            for lang in langs:
                b = blocks.pop(lang)
                held -= b.size
                n, at, counts, words = b.relation()
                out.append((before, lang, n, packed(at), packed(counts.astype(np.int64)), packed(np.frombuffer(b" ".join(words), np.uint8))))
                before += b.size
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[c.split()[0] for c in _READ.split(", ")])

        for langs, texts in rows_of(batches, "lang", "text"):
            for lang, text in zip(langs, texts):
                words = words_of(text)
                if len(words) == 1:
                    continue
                block = blocks.setdefault(lang, _Block())
                block.add(words)
                held += len(words)
                if block.size >= BLOCK:
                    yield rows([lang])
                elif held >= HELD:
                    yield rows(list(blocks))
        if blocks:
            yield rows(list(blocks))

    lang, text = F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(lang.alias("lang"), text.alias("text")).mapInArrow(run, _READ)


def _words(blocks: DataFrame) -> DataFrame:
    """(`block`, `idx`, `lang`, `word`, `c`): a row for each word of a block."""
    def run(batches):
        for ids, langs, counts, words in rows_of(batches, "block", "lang", "counts", "words"):
            for block, lang, c, w in zip(ids, langs, counts, words):
                c = unpacked(c, np.int64)
                w = unpacked(w, np.uint8).tobytes().split(b" ") if len(c) else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(c), block)), pa.array(np.arange(len(c), dtype=np.int32)), pa.array([lang] * len(c), pa.string()),
                     pa.array(w, pa.binary()).cast(pa.string()), pa.array(c)], names=["block", "idx", "lang", "word", "c"])

    return blocks.select("block", "lang", "counts", "words").mapInArrow(run, "block bigint, idx int, lang string, word string, c bigint")


def adjacent(pos: np.ndarray, group: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge-join of a sorted relation with itself at the next position.

    Returns the places whose next position is there too, and of the pairs (left group, right group) found the
    distinct ones, in order, as one number, with the pair each place has and how often each pair occurs.
    """
    at = np.flatnonzero(pos[1:] == pos[:-1] + 1)
    pairs, which, counts = np.unique(group[at].astype(np.int64) * n_groups + group[at + 1], return_inverse=True, return_counts=True)
    return at, pairs, which, counts


def _frequent(rows: DataFrame, key: list[str], min_count: int) -> DataFrame:
    """The rows of groups that occur often enough in all blocks together, with their sum `f` and the group's `id`.

    A group has a row for each block it is in; its id is the smallest of their places, which no other group has.
    """
    w = Window.partitionBy(*key)
    return rows.select("block", "idx", *key, F.sum("c").over(w).alias("f"), F.min(F.col("block") + F.col("idx")).over(w).alias("id")) \
        .where(F.col("f") >= min_count)


def _kept(frequent: DataFrame) -> DataFrame:
    """For each block, the places of its frequent groups and their ids."""
    return frequent.groupBy("block").agg(F.collect_list(F.struct("idx", "id")).alias("kept"))


_RELATION = "block bigint, pos binary, grp binary, groups binary"


class _Relation:
    """A block of a relation: positions in order, the group at each, and the ids of the groups."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.pos = np.cumsum(unpacked(row["pos"], np.int32), dtype=np.int32)
        self.group, self.ids = unpacked(row["grp"], np.int32), unpacked(row["groups"], np.int64)

    def longer(self, ranges: int):
        """Adjacent groups: the places of their first, the pair at each, each pair's left and right id, its count, and its range."""
        at, pairs, which, counts = adjacent(self.pos, self.group, max(len(self.ids), 1))
        left, right = (self.ids[x] for x in np.divmod(pairs, max(len(self.ids), 1)))
        spread = mixed(mixed(left.view(np.uint64)) ^ right.view(np.uint64)) % np.uint64(ranges)
        return at, which, left, right, counts, spread.astype(np.int64)


def _relation_row(block: int, pos: np.ndarray, group: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    columns = (packed(x) for x in (steps(pos.astype(np.int32)), group.astype(np.int32), ids.astype(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in columns)],
                                      names=["block", "pos", "grp", "groups"])


def _first_relation(blocks: DataFrame, frequent: DataFrame) -> DataFrame:
    """Occurrences of the frequent words: the semi-join of a block's words with them."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rank = unpacked(row["at"], np.int32)
                new = np.full(int(rank.max()) + 1, -1, np.int32)
                new[np.array([k["idx"] for k in row["kept"]], np.int64) + 1] = np.arange(len(row["kept"]), dtype=np.int32)
                group = new[rank]
                pos = np.flatnonzero(group >= 0)
                yield _relation_row(row["block"], pos, group[pos], np.array([k["id"] for k in row["kept"]], np.int64))

    kept = frequent.groupBy("block").agg(F.collect_list(F.struct("idx", "id")).alias("kept"))
    return blocks.select("block", "at").join(kept, "block").mapInArrow(run, _RELATION)


_PACKET = "r int, block bigint, head binary, tail binary, c binary"


def _packets(relation: DataFrame, ranges: int) -> DataFrame:
    """A row for each block and range of pairs: their left and right ids and counts."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                of = _Relation(row)
                _, _, left, right, counts, spread = of.longer(ranges)
                order = np.argsort(spread, kind="stable")
                used, first = np.unique(spread[order], return_index=True)
                out = [(int(r), of.block, packed(steps(left[o])), packed(right[o]), packed(counts[o].astype(np.int64)))
                       for r, o in zip(used.tolist(), np.split(order, first[1:]))]
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["r", "block", "head", "tail", "c"])

    return relation.mapInArrow(run, _PACKET)


_COUNTED = "block bigint, r int, places binary, ids binary, head binary, tail binary, f binary"


def _counted(packets: DataFrame, min_count: int) -> DataFrame:
    """Group-count: the frequent pairs of each range (no block), and for each packet their places in it with their ids.

    An id is the range and a running number. The rows of a range are its pairs, one for each block they are in.
    """
    def run(batches):
        now, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["r"] != now and held:
                    yield from counted(now, held)
                    held = []
                now = row["r"]
                held.append(row)
        if held:
            yield from counted(now, held)

    def counted(r, rows):
        left = np.concatenate([np.cumsum(unpacked(x["head"], np.int64)) for x in rows])
        right = np.concatenate([unpacked(x["tail"], np.int64) for x in rows])
        counts = [unpacked(x["c"], np.int64) for x in rows]
        c = np.concatenate(counts)
        order = np.lexsort((right, left))
        new = np.concatenate([[True], (left[order][1:] != left[order][:-1]) | (right[order][1:] != right[order][:-1])])
        total = np.add.reduceat(c[order], np.flatnonzero(new))
        often = total >= min_count
        ids = np.where(often, (r << 40) + np.cumsum(often) - 1, -1)
        of = np.empty(len(order), np.int64)
        of[order] = ids[np.cumsum(new) - 1]
        out, at = [], 0
        for x, n in zip(rows, map(len, counts)):
            places = np.flatnonzero(of[at:at + n] >= 0)
            if len(places):
                out.append((x["block"], r, packed(steps(places.astype(np.int32))), packed(of[at:at + n][places]), None, None, None))
            at += n
        first = order[np.flatnonzero(new)[often]]
        if len(first):
            out.append((None, r, None, packed(ids[often]), packed(left[first]), packed(right[first]), packed(total[often])))
        kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 5)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(col, k) for col, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in _COUNTED.split(", ")])

    return packets.repartition("r").sortWithinPartitions("r").mapInArrow(run, _COUNTED)


def _groups(counted: DataFrame) -> DataFrame:
    """(`id`, `left`, `right`, `f`) of the frequent pairs."""
    def run(batches):
        for columns in rows_of(batches, "ids", "head", "tail", "f"):
            for row in zip(*columns):
                yield pa.RecordBatch.from_arrays([pa.array(unpacked(x, np.int64)) for x in row], names=["id", "left", "right", "f"])

    return counted.where("block is null").select("ids", "head", "tail", "f").mapInArrow(run, "id bigint, left bigint, right bigint, f bigint")


def _next_relation(relation: DataFrame, counted: DataFrame, ranges: int) -> DataFrame:
    """Occurrences of the frequent pairs: the semi-join of a block's pairs with them."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                of = _Relation(row)
                at, which, left, _, _, spread = of.longer(ranges)
                order = np.argsort(spread, kind="stable")
                first = dict(zip(*(x.tolist() for x in np.unique(spread[order], return_index=True))))
                new, ids = np.full(len(left), -1, np.int32), []
                for k in row["kept"]:
                    pairs = order[np.cumsum(unpacked(k["places"], np.int32)) + first[k["r"]]]
                    new[pairs] = np.arange(len(pairs), dtype=np.int32) + sum(map(len, ids))
                    ids.append(unpacked(k["ids"], np.int64))
                group = new[which]
                yield _relation_row(of.block, of.pos[at][group >= 0], group[group >= 0], np.concatenate(ids))

    kept = counted.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("r", "places", "ids")).alias("kept"))
    return relation.join(kept, "block").mapInArrow(run, _RELATION)


def frequent_phrases(docs: DataFrame, *, min_count: int = MIN_COUNT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(`lang`, `words`, `f`) of all phrases of 1 to `longest` words with `min_count` occurrences, and (`lang`, `n`) of all words.

    Runs jobs when called, a few for each length; relations and frequent groups are checkpointed.
    """
    blocks = checkpointed(_read(docs))
    frequent = checkpointed(_frequent(_words(blocks), ["lang", "word"], min_count))
    group = frequent.where(F.col("id") == F.col("block") + F.col("idx")).select("id", "lang", F.array("word").alias("words"), "f")
    # One number: it says in how many ranges pairs are counted.
    ranges = int(blocks.agg(F.greatest(F.ceil(F.sum("n") / RANGE), F.lit(1))).first()[0] or 1)
    out, relation = [group], checkpointed(_first_relation(blocks, frequent))
    for k in range(2, longest + 1):
        counted = checkpointed(_counted(_packets(relation, ranges), min_count))
        if counted.isEmpty():
            break
        head = group.select(F.col("id").alias("left"), "lang", F.col("words").alias("head"))
        tail = group.select(F.col("id").alias("right"), F.element_at("words", -1).alias("tail"))
        group = checkpointed(_groups(counted).join(head, "left").join(tail, "right").select(
            "id", "lang", F.concat("head", F.array("tail")).alias("words"), "f"))
        out.append(group)
        if k < longest:
            relation = checkpointed(_next_relation(relation, counted, ranges))
    phrases = out[0]
    for g in out[1:]:
        phrases = phrases.union(g)
    return phrases.drop("id"), blocks.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, *, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP,
                 absorbed_percent: int = ABSORBED_PERCENT) -> DataFrame:
    """The best phrases of each language: `lang`, `rank`, `phrase`, `a`, `l`, `r`, `n`, `score`.

    A-Z is lower-cased, texts are split at `.,;:!?` and line ends into pieces and these at spaces and tabs into words;
    phrases lie within a piece. `a` counts a phrase, `n` the words of its language. Of all cuts of a phrase in two the
    one with the smallest floor(1000 a n / (l r)) counts, `l` and `r` being the counts of its parts; ties go to the
    shortest first part. Sums are exact, in decimals of 38 digits. A phrase is left out if a longer one of at least `min_count` that holds it
    occurs `absorbed_percent` of a hundred times as often. Order: score, `a` (both falling), phrase by its bytes.

    A null language is `und`, a null or empty text has no words; repeated rows and ids count as often as they are
    there; a table without words gives no rows. Only `lang` and `text` are read, so other columns do not matter.
    Counts are over all rows: a word that every text holds is one row for each block before anything moves.
    """
    phrases, n = frequent_phrases(docs, min_count=min_count, longest=longest)
    of = phrases.select("lang", F.array_join("words", " ").alias("phrase"), "f")
    several = phrases.where(F.size("words") > 1).select("lang", "words", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"))

    def part(first: str, size: str):
        return F.array_join(F.expr(f"slice(words, {first}, {size})"), " ")

    cuts = several.withColumn("k", F.explode(F.expr("sequence(1, size(words) - 1)"))).select(
        "lang", "phrase", "a", "k", part("1", "k").alias("one"), part("k + 1", "size(words) - k").alias("two"))
    parts = cuts.join(of.select("lang", F.col("phrase").alias("one"), F.col("f").alias("l")), ["lang", "one"]) \
        .join(of.select("lang", F.col("phrase").alias("two"), F.col("f").alias("r")), ["lang", "two"]).join(n, "lang")
    wide = {x: F.col(x).cast("decimal(20,0)") for x in ("a", "n", "l", "r")}
    scored = parts.withColumns({f"wide_{x}": c for x, c in wide.items()}) \
        .withColumn("score", F.expr("cast((1000 * wide_a * wide_n) div (wide_l * wide_r) as bigint)"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min_by(F.struct("score", "l", "r"), F.struct("score", "k")).alias("cut"))

    inner = several.where(F.size("words") > 2).withColumn("size", F.explode(F.expr("sequence(2, size(words) - 1)"))) \
        .withColumn("first", F.explode(F.expr("sequence(1, size(words) - size + 1)"))) \
        .select("lang", part("first", "size").alias("phrase"), F.col("a").alias("longer"))
    absorbed = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = best.join(absorbed, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < absorbed_percent * F.col("a"), F.lit(True)))

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    flat = left.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    return flat.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top) \
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
