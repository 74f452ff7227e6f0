"""Cut texts where no token can cross, encode every distinct unit once, and gather the ids of whole texts by offsets.

A unit begins before a space, or before and after a line feed, that has no other white space beside it. Byte-level word patterns and
pieces with a leading word mark never cross such a place, so the units' ids, one after the other, are those of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
REMEMBERED = 800_000  # units
AT_ONCE = 20_000  # units encoded at once
LONGEST = 64  # bytes of a unit that is remembered
SPACE = np.zeros(256, dtype=bool)
SPACE[[*range(9, 14), *range(28, 33)]] = True
PLAIN = re.compile(rb" ?[^\t-\r\x1c- ]+")
WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")  # white space beyond ASCII, in UTF-8


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about SLICE_BYTES, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo, n = 0, len(texts)
    while lo < n:
        before = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, "right")))
        yield lo, hi
        lo = hi


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in batches of about SLICE_BYTES at least, however small they come: what is done once a slice is not done more often."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += batch.nbytes
        if size >= SLICE_BYTES:
            yield pa.concat_batches(some) if len(some) > 1 else batch
            some, size = [], 0
    if some:
        yield pa.concat_batches(some)


def cut(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places in `data`, texts one after the other from `starts` (none empty), at which units begin."""
    space = SPACE[data]
    if np.isin(data, (0xC2, 0xE1, 0xE2, 0xE3)).any():
        for m in WIDE.finditer(data.tobytes()):
            space[m.start() : m.end()] = True
    alone = (data == 32) | (data == 10)
    alone[:1] = alone[-1:] = False
    alone[1:] &= ~space[:-1]
    alone[:-1] &= ~space[1:]
    inner = starts[starts > 0]
    alone[inner] = alone[inner - 1] = False  # the ends of a text have no neighbour; texts are cut there anyway
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[starts] = True
    begins[:-1] |= alone
    begins[1:] |= alone & (data == 10)
    return np.flatnonzero(begins[:-1])


def plain(unit: bytes) -> bool:
    """No white space but, perhaps, one space in front."""
    return PLAIN.fullmatch(unit) is not None and (unit.isascii() or not WIDE.search(unit))


def by_lines(encode: Callable[[list[str]], list[list[int]]], units: list[str], feed: int, lead: str = "", skip: int = 0, run: int = 1000) -> list:
    """Ids of plain units as bytes of 32-bit integers, encoded many at a time with line feeds between them; None for a run whose line feeds
    do not all come back by themselves. `lead` goes before each run, and `skip` ids with it."""
    runs = [units[i : i + run] for i in range(0, len(units), run)]
    out: list = []
    for some, ids in zip(runs, encode([lead + "\n".join(r) for r in runs]), strict=True):
        ids = np.array(ids[skip:], "<u4")
        ends = np.flatnonzero(ids == feed)
        if len(ends) != len(some) - 1:
            out += [None] * len(some)
            continue
        raw, at = ids.tobytes(), [-4, *(ends * 4).tolist(), len(ids) * 4]
        out += [raw[i + 4 : j] for i, j in zip(at[:-1], at[1:], strict=True)]
    return out


class Vocabulary:
    """The bytes of every token."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def spells(self, parts: list[bytes], units: list[bytes]) -> np.ndarray:
        """Whether the tokens of each part give the bytes of its unit."""
        ids = np.frombuffer(b"".join(parts), "<u4")
        n = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) // 4)])
        good = np.diff(ends[bounds]) == np.fromiter(map(len, units), np.int64, len(units))
        if not good.all():
            some = np.flatnonzero(good)
            if len(some):
                good[some] = self.spells([parts[i] for i in some], [units[i] for i in some])
            return good
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends[:-1], n)
        wrong = np.flatnonzero(self.flat[at] != np.frombuffer(b"".join(units), np.uint8))
        good[np.searchsorted(ends[bounds], wrong, "right") - 1] = False
        return good


class Units:
    """Encodes texts by their distinct units, on one or more sides, and remembers short units in Arrow and numpy arrays: some 40 bytes each.

    `encode` gives, for a list of units, a list of (bytes of 32-bit ids of every side) and which units are good."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[list[list[bytes]], np.ndarray]], sides: int = 1, split: bool = True):
        self.encode, self.split = encode, split
        self.units = pa.array([], pa.large_binary())
        self.good = np.zeros(0, dtype=bool)
        self.ids = [np.zeros(0, np.uint16) for _ in range(sides)]
        self.ends = [np.zeros(1, np.int64) for _ in range(sides)]

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct units of `texts` (no nulls); the unit at each place; and where each text's units begin, with the end."""
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        starts = np.unique(offsets[:-1][np.diff(offsets) > 0])
        at = cut(data, starts) if self.split and len(data) else starts
        places = np.append(at, len(data)).astype(np.int64)
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(places), pa.py_buffer(data)]).dictionary_encode()
        return units.dictionary, units.indices.to_numpy(), np.searchsorted(at, offsets)

    def learn(self, units: pa.Array) -> None:
        """Put units that are not known behind the known ones."""
        good, parts = [self.good], [([], []) for _ in self.ids]
        for lo in range(0, len(units), AT_ONCE):
            sides, fine = self.encode(units.slice(lo, AT_ONCE).to_pylist())
            good.append(fine)
            for (ids, sizes), side in zip(parts, sides, strict=True):
                ids.append(np.frombuffer(b"".join(side), "<u4"))
                sizes.append(np.fromiter(map(len, side), np.int64, len(side)) // 4)
        for k, (ids, sizes) in enumerate(parts):
            wide = self.ids[k].dtype == np.uint32 or any(len(x) and x.max() >= 1 << 16 for x in ids)
            self.ids[k] = np.concatenate([self.ids[k], *ids]).astype(np.uint32 if wide else np.uint16)
            self.ends[k] = np.concatenate([self.ends[k], self.ends[k][-1] + np.cumsum(np.concatenate(sizes))])
        self.good = np.concatenate(good)
        self.units = pa.concat_arrays([self.units, units])

    def forget(self, first: int) -> None:
        """Drop long units from `first` on, and the older ones when there are too many."""
        keep = np.ones(len(self.units), dtype=bool)
        keep[first:] = pc.binary_length(self.units.slice(first)).to_numpy() <= LONGEST
        if keep.sum() > REMEMBERED:
            keep[: len(keep) - REMEMBERED // 2] = False
        if keep.all():
            return
        for k, ends in enumerate(self.ends):
            sizes = np.diff(ends)
            self.ids[k] = self.ids[k][np.repeat(keep, sizes)]
            self.ends[k] = np.concatenate([[0], np.cumsum(sizes[keep])])
        self.good, self.units = self.good[keep], self.units.filter(pa.array(keep))

    def texts(self, texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For each side the ids of all texts (no nulls), one after the other, and where each text's begin, with the end; and whether all of a text's units are good."""
        units, which, bounds = self.cut(texts)
        at = pc.index_in(units, value_set=self.units)
        new = at.is_null()
        first = len(self.units)
        place = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = place < 0
        place[missing] = first + np.arange(int(missing.sum()))
        if missing.any():
            self.learn(units.filter(new))
        unit = place[which]
        out = []
        for ids, ends in zip(self.ids, self.ends, strict=True):
            n = (ends[1:] - ends[:-1])[unit]
            upto = np.concatenate([[0], np.cumsum(n)])
            out.append((ids[np.arange(upto[-1]) + np.repeat(ends[unit] - upto[:-1], n)], upto[bounds]))
        bad = np.concatenate([[0], np.cumsum(~self.good[unit])])[bounds]
        good = bad[1:] == bad[:-1]
        self.forget(first)
        return out, good
