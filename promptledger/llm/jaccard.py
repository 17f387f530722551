"""N-gram Jaccard join: texts as points of hashed token-group counts, indexed in tiles and boxes.

A pair links when intersection / union of the shingle sets reaches 3/4, that is when the overlap reaches 3/7 of the
summed sizes. Shingles hash into groups; a text is the point of its group counts. The overlap of two texts is at
most the sum of the smaller coordinates of their points, whatever groups are taken together. That bound is
used three times, from fine to coarse:

1. Tiles. With shingles as the finest coordinates, ordered from rare to common groups, leave out the first quarter
   of a text: the coordinates left cannot sum up to the overlap a link needs. So linked texts share a tile, one of
   their leading coordinates; in the first they share, the coordinates left bound the overlap by themselves. Common passages come last in the order and make no tiles of texts that hold more.
2. Points. Pairs of a tile are compared by 64 coarse coordinates, long texts by more; most fall under the bound.
3. Boxes. Where a tile holds many texts, they are cut into nodes with bounding boxes, the largest coordinates of a
   node's texts; nodes whose boxes stay under the bound are not opened.

What survives is verified on the sets. Texts with equal sets are one point throughout.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpointed
from .common import rows_of, text_rows
from .components import components
from .shingles import mixed, shingle_set, signature

#: Groups whose corpus counts order the coordinates, and in how many pieces those counts travel.
GROUPS, PIECES = 1 << 20, 64
#: Coordinates of a point: the fewest, and the most, which very long texts have.
AXES, MAX_AXES = 64, 1 << 16
#: The most in the cells of a tile, where a text's point is repeated for every tile it is in.
CELL_AXES = 256
#: Texts of a node, and slots of the filter that picks texts for verification.
NODE, SLOTS = 256, 1 << 24
#: Texts of a node in which only the likeliest pairs are tried, and how many each text tries in the largest component.
WIDE_NODE, PICKS = 4096, 3
#: Owner of a set that only rows without an id have.
NO_ID = -(2**63)
#: Larger than four thirds of any size.
NO_SIZE = 1 << 40


def _group(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(44)).astype(np.int64)


def point(shingles: np.ndarray, most: int = MAX_AXES) -> bytes:
    """The group counts of a text: `AXES` coordinates or, for long texts, half as many as its shingles and more.

    One byte each where they fit and four where not. A coordinate of fewer axes is a sum of those of more.
    """
    axes = AXES
    while axes < min(len(shingles) / 2, most):
        axes *= 2
    counts = np.bincount((shingles & np.uint64(axes - 1)).astype(np.int64), minlength=axes)
    wide = bool(counts.max() > 255)
    return bytes([wide]) + counts.astype(np.uint32 if wide else np.uint8).tobytes()


def coordinates(p: bytes, axes: int | None = None) -> np.ndarray:
    """The counts of a point, summed up to `axes` coordinates."""
    counts = np.frombuffer(p, np.uint32 if p[0] else np.uint8, offset=1).astype(np.int32)
    return counts if axes is None else counts.reshape(-1, axes).sum(axis=0)


def unpacked(points: list[bytes]) -> np.ndarray:
    """Points as rows of a matrix of `AXES` columns."""
    if all(len(p) == AXES + 1 for p in points):
        return np.frombuffer(b"".join(points), np.uint8).reshape(-1, AXES + 1)[:, 1:].astype(np.int32)
    return np.stack([coordinates(p, AXES) for p in points])


def overlap_bound(p: bytes, q: bytes) -> int:
    """The sum of the smaller coordinates, by the axes both points have: no less than the overlap."""
    x, y = coordinates(p), coordinates(q)
    axes = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, axes).sum(axis=0), y.reshape(-1, axes).sum(axis=0)).sum())


def _hash() -> Column:
    """A hash of a row's text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _read(docs: DataFrame) -> DataFrame:
    """One row per text (`doc_id`, its `hash`, `n`, `sig`, its `point` and a `rough` one for cells) and, with `piece` set, the group counts of each task."""
    def run(batches):
        counts, held, size = np.zeros(GROUPS, np.int64), [], 0
        for ids, texts, hashes in rows_of(batches, "doc_id", "text", "hash"):
            sets = [shingle_set(t) for t in texts]
            held += [_group(s) for s in sets]
            size += sum(map(len, sets))
            if size > GROUPS:
                counts += np.bincount(np.concatenate(held), minlength=GROUPS)
                held, size = [], 0
            yield rows([None] * len(ids), ids, hashes, [len(s) for s in sets], [signature(s) if len(s) else None for s in sets],
                       [point(s) if len(s) else None for s in sets], [point(s, CELL_AXES) if len(s) else None for s in sets])
        if held:
            counts += np.bincount(np.concatenate(held), minlength=GROUPS)
        parts = counts.reshape(PIECES, -1)
        used = [p for p in range(PIECES) if parts[p].any()]
        yield rows(used, [None] * len(used), [None] * len(used), [None] * len(used), [None] * len(used),
                   [zlib.compress(parts[p].astype(np.int64).tobytes(), 1) for p in used], [None] * len(used))

    def rows(*columns):
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          names=["piece", "doc_id", "hash", "n", "sig", "point", "rough"])

    return text_rows(docs, _hash().alias("hash")).mapInArrow(run, "piece int, doc_id bigint, hash bigint, n bigint, sig bigint, point binary, rough binary")


def _commonness(read: DataFrame) -> np.ndarray:
    """A byte per group that grows with its count in the corpus: `GROUPS` bytes, however large the corpus."""
    def run(batches):
        now, total = None, None
        for pieces, counts in rows_of(batches, "piece", "point"):
            for p, c in zip(pieces, counts):
                if p != now:
                    if now is not None:
                        yield row(now, total)
                    now, total = p, np.zeros(GROUPS // PIECES, np.int64)
                total += np.frombuffer(zlib.decompress(c), np.int64)
        if now is not None:
            yield row(now, total)

    def row(piece, total):
        byte = np.minimum(127, np.floor(np.log2(np.maximum(total, 1)) * 3)).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([byte.tobytes()], pa.binary())],
                                          names=["piece", "byte"])

    parts = read.where("piece is not null").select("piece", "point").repartition("piece").sortWithinPartitions("piece")
    out = np.zeros((PIECES, GROUPS // PIECES), np.uint8)
    for r in parts.mapInArrow(run, "piece int, byte binary").collect():  # PIECES rows at most
        out[r["piece"]] = np.frombuffer(r["byte"], np.uint8)
    return out.ravel()


def _leading(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The coordinates without which the rest cannot sum up to the overlap of a link: a quarter, rarest groups first.

    They come in order, as numbers that sort the same way for all texts.
    """
    keep = len(shingles) // 4 + 1
    order = ((common[_group(shingles)].astype(np.uint64) << np.uint64(56)) | (shingles >> np.uint64(8))).view(np.int64)
    return np.sort(np.partition(order, keep - 1)[:keep] if keep < len(order) else order)


def _tiles(docs: DataFrame, common) -> DataFrame:
    """(`tile`, `sig`, `place`) of the leading coordinates; a task passes each set on once, so copies do not pile up.

    `place` holds the size of the set and how many coordinates are left from this one on, 32 bits each.
    """
    def run(batches):
        seen: set[int] = set()
        for (texts,) in rows_of(batches, "text"):
            tiles, sigs, places = [], [], []
            for t in texts:
                s = shingle_set(t)
                if len(s) and (sig := signature(s)) not in seen:
                    seen.add(sig)
                    tiles.append(_leading(s, common.value))
                    sigs.append(np.full(len(tiles[-1]), sig, np.int64))
                    places.append((len(s) << 32) + len(s) - np.arange(len(tiles[-1]), dtype=np.int64))
            if tiles:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tiles, sigs, places)], names=["tile", "sig", "place"])

    return text_rows(docs).mapInArrow(run, "tile bigint, sig bigint, place bigint")


def _reach(n, left, n_other, left_other) -> np.ndarray:
    """Whether two texts that have this tile, and no earlier one, in common can overlap enough."""
    return 7 * np.minimum(left, left_other) >= 3 * (n + n_other)


def _runs(batches: Iterator, key: int, *names: str) -> Iterator[tuple[np.ndarray, ...]]:
    """Sorted batches as arrays that hold whole runs of equal values in the first `key` columns."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = tuple(np.asarray(batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False)) for n in names)
        same = np.ones(len(now[0]), bool)
        for x in now[:key]:
            same &= x == x[-1]
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut == 0 and held and all(x[-1] == y[-1] for x, y in zip(held[-1][:key], now[:key])):
            held.append(now)  # a long run goes on
            continue
        held.append(tuple(x[:cut] for x in now))
        if sum(len(x[0]) for x in held):
            yield tuple(np.concatenate(x) for x in zip(*held))
        held = [tuple(x[cut:] for x in now)]
    if held and len(held[0][0]):
        yield tuple(np.concatenate(x) for x in zip(*held))


_REMEMBER = 1 << 16


def _shared(tiles: DataFrame) -> DataFrame:
    """Rows (`tile`, `a`, `b`): a pair (tile null) of each text of a tile with its first, and the members (`b` is
    their `place`) of tiles with three texts or more.

    A pair has to be tried in the first tile it shares only, and there the coordinates left bound its overlap.
    Tiles are named by their members here, so those with the same members, such as a family's, are one: a task passes
    on the first, as in the others fewer are left, and `_members` brings the tasks' together.
    """
    def run(batches):
        seen: set[tuple] = set()

        def out(tile, a, b):
            return pa.RecordBatch.from_arrays([pa.array(tile, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                              names=["tile", "a", "b"])

        for tile, sig, place in _runs(batches, 1, "tile", "sig", "place"):
            new = np.concatenate([[True], (tile[1:] != tile[:-1]) | (sig[1:] != sig[:-1])])
            tile, sig, place = tile[new], sig[new], place[new]  # copies read by different tasks
            n, left = place >> 32, place & 0xFFFFFFFF
            first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
            size = np.diff(np.concatenate([first, [len(tile)]]))
            two = first[size == 2]
            two = two[_reach(n[two], left[two], n[two + 1], left[two + 1])]
            pair_a, pair_b, many_t, many_m, many_l = [sig[two]], [sig[two + 1]], [], [], []
            for i, k in zip(first[size > 2].tolist(), size[size > 2].tolist()):
                members = sig[i:i + k]
                key = (k, int(np.bitwise_xor.reduce(members)), int(np.add.reduce(members)))
                if key in seen:
                    continue
                if len(seen) >= _REMEMBER:
                    seen.clear()
                seen.add(key)
                near = np.flatnonzero(_reach(n[i], left[i], n[i + 1:i + k], left[i + 1:i + k])) + 1
                pair_a.append(np.full(len(near), members[0]))
                pair_b.append(members[near])
                many_t.append(np.full(k, _name(*key)))
                many_m.append(members)
                many_l.append(place[i:i + k])
            pairs = np.unique(np.column_stack([np.concatenate(pair_a), np.concatenate(pair_b)]), axis=0)
            if len(pairs):
                yield out(np.array([None] * len(pairs)), pairs[:, 0], pairs[:, 1])
            if many_t:
                yield out(*(np.concatenate(x) for x in (many_t, many_m, many_l)))

    return tiles.repartition("tile").sortWithinPartitions("tile", "sig").mapInArrow(run, "tile bigint, a bigint, b bigint")


def _name(*of: int) -> int:
    """A hash of the members of a tile. Two tiles that should share one would be searched as one, which finds no less."""
    return int(mixed(np.array([hash(of) & 0xFFFFFFFFFFFFFFFF], np.uint64)).view(np.int64)[0])


def _members(shared: DataFrame) -> DataFrame:
    """(`tile`, `sig`, `n`, `left`): each member of the different tiles once, with the most it has left in any of them."""
    places = shared.where("tile is not null").groupBy("tile", F.col("a").alias("sig")).agg(F.max("b").alias("place"))
    return places.select("tile", "sig", F.shiftright("place", 32).alias("n"), F.col("place").bitwiseAND(0xFFFFFFFF).alias("left"))


def _bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs (`a`, `b`) whose sizes and points do not rule a link out, with the sizes and owners of both."""
    kept = ["a", "b", "n_a", "n_b", "doc_a", "doc_b"]

    def side(x: str) -> DataFrame:
        return points.select(F.col("sig").alias(x), F.col("n").alias(f"n_{x}"), F.col("point").alias(f"p_{x}"),
                             F.col("owner").alias(f"doc_{x}"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                p, q = (batch.column(x).to_pylist() for x in ("p_a", "p_b"))
                n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
                may = 7 * np.minimum(unpacked(p), unpacked(q)).sum(axis=1, dtype=np.int64) >= 3 * n
                for i in np.flatnonzero(may).tolist():
                    may[i] = 7 * overlap_bound(p[i], q[i]) >= 3 * n[i]
                yield batch.select(kept).filter(pa.array(may))

    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(_may_link(F.least("n_a", "n_b")))
    return sized.select(*kept, "p_a", "p_b").mapInArrow(run, ", ".join(f"{c} bigint" for c in kept))


def _may_link(overlap: Column) -> Column:
    return 7 * overlap >= 3 * (F.col("n_a") + F.col("n_b"))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(`sig`, `doc`, `s`): the sets of texts whose signatures may be among the wanted (`sig`).

    A bit field of fixed size tells the readers which; it only saves work, the join that follows decides.
    """
    slot = F.shiftrightunsigned("sig", 40)
    bits = wanted.select(F.shiftright(slot, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast((sig >> 40) & 63 as int))").alias("bit"))
    # SLOTS / 64 rows of 12 bytes at most.
    rows = bits.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(SLOTS // 64, np.uint64)
    words[rows["w"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    field = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        words = field.value
        for ids, texts in rows_of(batches, "doc_id", "text"):
            found = []
            for doc, t in zip(ids, texts):
                s = shingle_set(t)
                if len(s):
                    sig = signature(s)
                    at = (sig & 0xFFFFFFFFFFFFFFFF) >> 40
                    if int(words[at >> 6]) >> (at & 63) & 1:
                        found.append((sig, NO_ID if doc is None else doc, s.view(np.int64)))
            if found:
                sig, doc, sets = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(doc, pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                                                 names=["sig", "doc", "s"])

    return text_rows(docs).mapInArrow(run, "sig bigint, doc bigint, s array<bigint>")


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the `_bounded` pairs that link, by their sets. Each set is read from the text that owns it."""
    sides = [pairs.select(F.col(x).alias("sig"), F.col(f"doc_{x}").alias("doc"), F.lit(x == "a").alias("first"), "a", "b", "n_a", "n_b")
             for x in ("a", "b")]
    need = sides[0].union(sides[1])
    both = need.join(_sets(docs, need.select("sig")), ["sig", "doc"]).groupBy("a", "b", "n_a", "n_b").agg(
        F.first(F.when(F.col("first"), F.col("s")), ignorenulls=True).alias("s_a"),
        F.first(F.when(~F.col("first"), F.col("s")), ignorenulls=True).alias("s_b"))
    return checkpointed(both.where(_may_link(F.size(F.array_intersect("s_a", "s_b")))).select("a", "b"))


def _across(members: DataFrame, label: DataFrame, points: DataFrame, likeliest: bool) -> DataFrame:
    """Pairs of a tile's texts that are not connected yet and pass the bound.

    A text goes on only if the next smaller or larger one of its tile has a size it can link with, three quarters to
    four thirds of its own. A tile's texts are cut into nodes by hash; every two nodes of a tile meet in a cell of their own, which is
    opened only if the nodes' boxes pass. With `likeliest` a text is only paired, within its own and larger node,
    with its best partner and the best few in the node's largest component: enough to join families that the first
    links left in parts, before all pairs are listed.
    """
    rows = members.join(label.select(F.col("v").alias("sig"), "label"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    ordered, whole = Window.partitionBy("tile").orderBy("n", "sig"), Window.partitionBy("tile")
    before, behind = F.lag("n", 1, 0).over(ordered), F.lead("n", 1, NO_SIZE).over(ordered)
    rows = rows.select("*", before.alias("before"), behind.alias("behind")).where((4 * F.col("before") >= 3 * F.col("n")) | (3 * F.col("behind") <= 4 * F.col("n")))
    rows = rows.select("tile", "sig", "n", "left", "label", F.min("label").over(whole).alias("lo"), F.max("label").over(whole).alias("hi"),
                       F.ceil(F.count("*").over(whole) / (WIDE_NODE if likeliest else NODE)).cast("int").alias("nodes")).where("lo < hi")
    rows = rows.join(points.select("sig", F.col("rough").alias("point")), "sig")
    rows = rows.withColumn("node", F.pmod(F.xxhash64("sig"), "nodes").cast("int"))
    others = F.array("node") if likeliest else F.sequence(F.lit(0), F.col("nodes") - 1)
    cells = rows.withColumn("other", F.explode(others)).select(
        "tile", F.least("node", "other").alias("i"), F.greatest("node", "other").alias("j"), "node", "sig", "label", "n", "left", "point")

    def run(batches):
        names = ("tile", "i", "j", "node", "sig", "label", "n", "left", "point")
        for tile, i, j, node, sig, label, n, rest, points in _runs(batches, 3, *names):
            new = np.concatenate([[True], (tile[1:] != tile[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            ends = np.concatenate([np.flatnonzero(new), [len(tile)]])
            cells = _Cells(sig, label, n, rest, list(points))
            got = []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                one = np.flatnonzero(node[a:b] == i[a]) + a
                got += cells.likeliest(one) if likeliest else cells.opened(one, one if i[a] == j[a] else np.flatnonzero(node[a:b] == j[a]) + a)
            if got:
                pairs = np.unique(np.concatenate(got), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    ordered = cells.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j")
    return ordered.mapInArrow(run, "a bigint, b bigint")


class _Cells:
    """Rows of some cells, and the pairs of two nodes that pass every bound."""

    def __init__(self, sig, label, n, left, points: list[bytes]):
        self.sig, self.label, self.n, self.left, self.points = sig, label, n, left, points
        self.coarse = unpacked(points)
        self.tried: set[tuple] = set()

    def _partners(self, x: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the rows `y` that may link with row `x`, and their bound over the summed sizes."""
        y = y[_reach(self.n[x], self.left[x], self.n[y], self.left[y])]
        bound = 7 * np.minimum(self.coarse[y], self.coarse[x]).sum(axis=1) / (self.n[y] + self.n[x])
        return y[bound >= 3], bound[bound >= 3]

    def _pairs(self, x: int, y) -> np.ndarray:
        return np.sort([[self.sig[x], self.sig[k]] for k in y], axis=1)

    def opened(self, one: np.ndarray, other: np.ndarray) -> list[np.ndarray]:
        """All pairs between two nodes, or within one."""
        if not len(one) or not len(other):
            return []
        sig, label, n, p = self.sig, self.label, self.n, self.coarse
        box, least = p[other].max(axis=0), n[other].min()
        out = []
        for x in one[7 * np.minimum(p[one], box).sum(axis=1) >= 3 * (n[one] + least)].tolist():
            y = other[(label[other] != label[x]) & ((sig[other] > sig[x]) if one is other else (sig[other] != sig[x]))]
            fine = [k for k in self._partners(x, y)[0].tolist() if self._passes(x, k)]
            if fine:
                out.append(self._pairs(x, fine))
        return out

    def likeliest(self, node: np.ndarray) -> list[np.ndarray]:
        """A few pairs for each row outside the node's largest component."""
        labels, size = np.unique(self.label[node], return_counts=True)
        largest = labels[np.argmax(size)]
        out = []
        for x in node[self.label[node] != largest].tolist():
            y, bound = self._partners(x, node[self.label[node] != self.label[x]])
            y = y[np.argsort(-bound, kind="stable")]
            picked = dict.fromkeys(y[:1].tolist() + y[self.label[y] == largest][:PICKS].tolist())
            fine = [k for k in picked if self._passes(x, k)]
            if fine:
                out.append(self._pairs(x, fine))
        return out

    def _passes(self, x: int, y: int) -> bool:
        """The bound by the cells' axes; a pair that several tiles share is tried once."""
        pair = (min(self.sig[x], self.sig[y]), max(self.sig[x], self.sig[y]))
        if pair in self.tried:
            return False
        self.tried.add(pair)
        return 7 * overlap_bound(self.points[x], self.points[y]) >= 3 * (self.n[x] + self.n[y])


def _placed(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: `doc_id`, its `hash`, `n`, `sig` and the `label` of its component (null: no words)."""
    read = checkpointed(_read(docs))
    texts = read.where("piece is null").select("doc_id", "hash", "n", "sig")
    common = docs.sparkSession.sparkContext.broadcast(_commonness(read))
    shared = checkpointed(_shared(_tiles(docs, common)))
    # Only texts that share a tile go on.
    tiled = shared.select(F.explode(F.when(F.col("tile").isNull(), F.array("a", "b")).otherwise(F.array("a"))).alias("sig")).distinct()
    points = checkpointed(read.where("piece is null and sig is not null").join(tiled, "sig", "left_semi").groupBy("sig").agg(
        F.first("n").alias("n"), F.first("point").alias("point"), F.first("rough").alias("rough"), F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("owner")))
    first = checkpointed(_bounded(shared.where("tile is null").select("a", "b").distinct(), points))
    links = _verified(docs, first)
    label = components(links)
    members = checkpointed(_members(shared))
    tried = first.select("a", "b")
    for likeliest in (True, False):
        rest = _across(members, label, points, likeliest).distinct().join(tried, ["a", "b"], "left_anti")
        rest = checkpointed(_bounded(rest, points))
        if not rest.isEmpty():
            links, tried = links.union(_verified(docs, rest)), tried.union(rest.select("a", "b"))
            label = components(links)

    label = label.select(F.col("v").alias("sig"), "label")
    return texts.join(label, "sig", "left").withColumn("label", F.coalesce("label", "sig"))


def similar_groups(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `n_shingles`, `component_id`.

    Two texts link when their sets of distinct 5-word shingles have an intersection of at least 3/4 of their
    union; `component_id` is the smallest id reachable by links. Words are lower-cased (A-Z) and end at white
    space; a shorter text is one shingle, a null or empty one has no shingles and links with nothing. Repeated
    rows and equal texts link. A null id takes part, but names no component: it is null unless other ids are
    in it. An empty table gives an empty result.

    All links matter only up to connection: in every tile each text is first paired with the tile's first, then the
    likeliest ones of the texts still apart, then all pairs of a tile that these links do not connect. No connection is lost and a family of n near copies
    costs about n pairs; links inside a component that is already connected are not enumerated, so links per document
    are not counted. Runs jobs when called; results between them are checkpointed.
    """
    placed = _placed(docs)
    smallest = placed.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    return placed.join(smallest, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each group of linked texts: that of the smallest id, with all its columns.

    Rows are judged by id and text: different texts under one id are different documents, each in its own group.
    Of the texts of the smallest id in a group that with the smallest signature stays, and of rows with equal id
    and text the smallest by its other columns (maps aside). Texts without words link with nothing; one stays per
    id. Rows without an id cannot be told apart and stay.
    """
    placed = _placed(docs).where("doc_id is not null")
    least = F.min(F.struct("doc_id", "sig", "hash")).alias("least")
    worded = placed.where("label is not null").groupBy("label").agg(least)
    empty = placed.where("label is null").groupBy("doc_id").agg(least)
    stay = checkpointed(worded.select("least.doc_id", "least.hash").union(empty.select("least.doc_id", "least.hash")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", _hash().alias("hash"))
    others = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind and kind != "variant"]
    order = F.struct(F.col("row").getField("text").isNull(), *[F.col("row").getField(c) for c in others])
    kept = rows.where("doc_id is not null").join(stay, ["doc_id", "hash"], "left_semi").groupBy("doc_id", "hash").agg(F.min_by("row", order).alias("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]).unionByName(docs.where("doc_id is null"))
