"""Texts cut where no token of a byte-level or space-marking vocabulary reaches across, and a bounded memory of results."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat

import numpy as np

#: A space between two characters that no version of Unicode counts as white space. Byte-level splitting starts a
#: piece there, and no piece of a space-marking vocabulary has the mark behind another character.
_CUT = re.compile("\x20(?=[!-~\xa1-ᙿ])(?<=[!-~\xa1-ᙿ]\x20)")
#: Characters that are no white space in any version of Unicode; a space between two of them is a place to cut.
SOLID = frozenset(map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x1680)]))
#: Characters of a long text that are cut at once, and of texts whose chunks are looked up together.
STRETCH = 1 << 20


_SOLID_BYTES = bytes([*range(0x20, 0x7F), *range(0xA1, 0x100)])


def _cut(text: str) -> list[str]:
    """The text parted at the places to cut. Where every space is one, which is quickly told for Latin letters, it is
    parted at spaces without looking at their neighbours."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return _CUT.split(text)
    odd = set(raw.translate(None, _SOLID_BYTES))
    if raw[:1] == b" " or raw[-1:] == b" " or b"  " in raw or any(bytes((32, x)) in raw or bytes((x, 32)) in raw for x in odd):
        return _CUT.split(text)
    return text.split(" ")


def stretches(text: str) -> Iterator[list[str]]:
    """The chunks of a text, a list for each stretch of it; the space at which chunks part is left out.

    Put together with a space each they are the text. A stretch without a place to cut is one chunk.
    """
    at = 0
    while True:
        cut = _CUT.search(text, at + STRETCH) if len(text) - at > STRETCH else None
        yield _cut(text[at:cut.start()] if cut else text[at:] if at else text)
        if not cut:
            return
        at = cut.end()


def encoded(chunks: list, encode: Callable[[str], list[int]], lengths: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """The ids of all chunks side by side; the order they are in, and where each ends.

    A chunk has a space before it; one in a tuple has none. Chunks that can stand between others are encoded in one go
    and told apart by the `lengths` of the ids in bytes, which costs a third of encoding them one by one; the others follow.
    """
    order = [i for i, c in enumerate(chunks) if c and c[0] in SOLID and c[-1] in SOLID and type(c) is str]
    inner = [chunks[i] for i in order]
    ids = np.array(encode(" " + " ".join(inner)), np.int32) if inner else np.zeros(0, np.int32)
    want = np.cumsum(np.fromiter((1 + (len(c) if c.isascii() else len(c.encode())) for c in inner), np.int64, len(inner)))
    ends = np.cumsum(lengths[ids])
    cuts = np.searchsorted(ends, want)
    if len(want) and (cuts[-1] + 1 != len(ids) or (ends[cuts] != want).any()):
        order, ids, cuts = [], np.zeros(0, np.int32), np.zeros(0, np.int64)  # ids that are not these bytes
    taken = set(order)
    rest = [i for i in range(len(chunks)) if i not in taken]
    single = [np.array(encode(chunks[i][0] if type(chunks[i]) is tuple else f" {chunks[i]}"), np.int32) for i in rest]
    sizes = np.fromiter(map(len, single), np.int64, len(single))
    return np.concatenate([ids, *single]), order + rest, np.concatenate([cuts + 1, len(ids) + np.cumsum(sizes)]).astype(np.int64)


def looked_up(texts: list[str], parts: Callable[[str], Iterator[list]], memory: "Memory") -> Iterator[Iterator[list]]:
    """For each text the results of its chunks, a list for each stretch; the chunks of many short texts are looked up together."""
    for group in grouped(texts):
        if len(group) > 1 and len(group[-1]) <= STRETCH:
            chunks = [next(parts(t)) for t in group]
            found, at = memory.of(list(chain.from_iterable(chunks))), 0
            for c in chunks:
                yield iter((found[at:at + len(c)],))
                at += len(c)
        else:
            yield from (map(memory.of, parts(t)) for t in group)


def grouped(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts in lists of about `STRETCH` characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= STRETCH:
            yield held
            held, size = [], 0
    if held:
        yield held


#: Stands for a result that is not known yet; a result may be None.
UNKNOWN = object()


class Memory:
    """Results by chunk, of the last chunks that were asked for: two generations, the older one dropped at a time."""

    def __init__(self, make: Callable[[list], list], most: int):
        self.make, self.most = make, most
        self.now: dict = {}
        self.before: dict = {}

    def of(self, chunks: list) -> list:
        """The result of each chunk."""
        if len(self.now) > self.most:
            self.now, self.before = {}, self.now
        now, before = self.now, self.before
        out = list(map(now.get, chunks, repeat(UNKNOWN)))
        holes = [i for i, x in enumerate(out) if x is UNKNOWN]
        if holes:
            missing = {chunks[i] for i in holes}
            new = [c for c in missing if c not in before]
            now.update((c, before[c]) for c in missing if c in before)
            now.update(zip(new, self.make(new)))
            for i in holes:
                out[i] = now[chunks[i]]
        return out
