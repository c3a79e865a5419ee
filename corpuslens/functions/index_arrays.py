"""Random indexes and their sums in numpy, for whole Arrow batches.

The vectors are those of ``functions.random_index``.  A position is held as a code: position
times two, plus one for +1; ``2 * k`` stands for no position and sorts behind all others.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

try:  # much faster for short texts
    from _md5 import md5
except ImportError:
    from hashlib import md5

# Functions of this module travel to tasks by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DRAWS = 4  # positions from one digest, 8 of its hex digits each
WINDOWS = 1 << 15  # windows encoded at once
PAIRS_OF = 5 << 18  # tokens whose pairs are counted at once
VECTORS = 1 << 10  # vectors summed at once
LISTED = 1 << 13  # lists of contexts put together at once
ENTRIES = 1 << 17  # counted contexts added at once


@dataclass(frozen=True)
class Index:
    """The space of random indexes."""

    k: int
    s: int
    seed: int = 0

    def __post_init__(self):
        if not 0 < self.s <= self.k:
            raise ValueError("need 0 < s <= k")

    @property
    def none(self) -> int:
        return 2 * self.k

    @property
    def kind(self) -> type:
        return np.int16 if self.none < 1 << 15 else np.int32

    def positions(self, signs: list[bytes]) -> np.ndarray:
        """``active_positions`` of each sign, as rows."""
        lead = f"{self.seed}:".encode() if self.seed else b""
        stems = [lead + sign + b":" for sign in signs]
        tails = [str(i).encode() for i in range(math.ceil((2 * self.s + 1) / DRAWS))]
        first = tails[: math.ceil(self.s / DRAWS)]
        digests = b"".join([md5(stem + tail).digest() for stem in stems for tail in first])
        drawn = np.frombuffer(digests, ">u4").reshape(len(signs), DRAWS * len(first))[:, : self.s] % self.k
        out = drawn.astype(np.int64)
        ordered = np.sort(out, axis=1)
        for i in np.flatnonzero((ordered[:, 1:] == ordered[:, :-1]).any(axis=1)):  # some value was drawn twice
            out[i] = self._distinct(stems[i], tails)
        return out

    def _distinct(self, stem: bytes, tails: list[bytes]) -> list[int]:
        drawn = np.frombuffer(b"".join([md5(stem + tail).digest() for tail in tails]), ">u4") % self.k
        used = dict.fromkeys(drawn.tolist())
        if len(used) < self.s:
            unused = [x for x in range(self.k) if x not in used]
            unused.sort(key=lambda x: (md5(stem + f"fill:{x}".encode()).digest(), x))
            used |= dict.fromkeys(unused)
        return list(used)[: self.s]

    def codes(self, signs: pa.Array) -> np.ndarray:
        """A row of codes for each sign, and one without positions for null at the end."""
        positions = self.positions(signs.cast(pa.binary()).to_pylist())
        out = np.full((len(signs) + 1, self.s), self.none, self.kind)
        out[:-1] = positions * 2 + (np.arange(self.s) < self.s // 2)
        return out


def numbered(tokens: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Tokens as numbers into the distinct ones; null has the number behind the last one."""
    if isinstance(tokens, pa.ChunkedArray):
        tokens = tokens.combine_chunks()
    coded = tokens.dictionary_encode()
    return coded.indices.fill_null(len(coded.dictionary)).to_numpy().astype(np.int64), coded.dictionary


def padded(numbers: np.ndarray, lengths: np.ndarray, size: int, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents with `size` blanks around each, and the place of every token."""
    at = np.arange(len(numbers)) + np.repeat(size * np.arange(1, len(lengths) + 1), lengths)
    out = np.full(len(numbers) + size * (len(lengths) + 1), blank, np.int64)
    out[at] = numbers
    return out, at


def lengths_of(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values)


def cell_lists(idx: np.ndarray, values: np.ndarray, lengths: np.ndarray, value: str) -> pa.Array:
    return list_array(pa.StructArray.from_arrays([pa.array(idx.astype(np.int32)), pa.array(values)], ["idx", value]), lengths)


def folded(codes: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, sums and number of the non-zero cells of each row of codes, by position."""
    codes = np.sort(codes, axis=1)
    live = codes < none
    first = live.copy()
    first[:, 1:] &= (codes[:, 1:] >> 1) != (codes[:, :-1] >> 1)
    flat = codes[live]
    starts = np.flatnonzero(first[live])
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(len(codes), np.int64)
    sums = np.add.reduceat((flat & 1).astype(np.int8) * 2 - 1, starts, dtype=np.int32)
    kept = sums != 0
    before = np.concatenate([[0], np.cumsum(kept)])
    ends = np.cumsum(first.sum(axis=1))
    lengths = np.diff(before[np.concatenate([[0], ends])])
    return (flat[starts[kept]] >> 1).astype(np.int32), sums[kept], lengths


def largest_is_one(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each vector divided by its largest absolute value."""
    full = lengths[lengths > 0]
    if not len(full):
        return sums.astype(np.float64)
    top = np.maximum.reduceat(np.abs(sums), np.cumsum(full) - full)
    return sums / np.repeat(top, full)


@dataclass(frozen=True)
class Windows:
    """How the windows of a corpus are encoded; `moves` has the new positions for each offset -size..size."""

    index: Index
    size: int
    include_target: bool = True
    normalise: bool = False
    moves: list[np.ndarray] | None = None

    def parts(self, numbers: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[slice, pa.Array]]:
        """Stretches of tokens, and the cells of their windows."""
        none = self.index.none
        place, at = padded(numbers, lengths, self.size, len(codes) - 1)
        offsets = [d for d in range(-self.size, self.size + 1) if d or self.include_target]
        tables = [codes] * len(offsets)
        if self.moves is not None:
            moved = [np.append(self.moves[d + self.size], self.index.k) for d in offsets]  # no position stays none
            tables = [(to[codes >> 1] * 2 + (codes & 1)).astype(codes.dtype) for to in moved]
        for begin in range(0, len(at), WINDOWS):
            here = at[begin : begin + WINDOWS]
            near = np.concatenate([t[place[here + d]] for t, d in zip(tables, offsets, strict=True)], axis=1)
            idx, sums, sizes = folded(near, none)
            values = largest_is_one(sums, sizes) if self.normalise else sums
            yield slice(begin, begin + len(here)), cell_lists(idx, values, sizes, "w")

    def encode(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``(doc_id, pos, cells)`` from ``(doc_id, tokens)``."""
        for batch in batches:
            lengths = lengths_of(batch.column(1))
            docs, pos = places(lengths)
            numbers, known = numbered(batch.column(1).flatten())
            for part, cells in self.parts(numbers, self.index.codes(known), lengths):
                doc = batch.column(0).take(pa.array(docs[part]))
                yield pa.RecordBatch.from_arrays([doc, pa.array(pos[part]), cells], ["doc_id", "pos", "cells"])

    def examples(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``(doc_id, pos, target, x, y)`` from ``(doc_id, tokens)``: also the label distribution of the target."""
        k, s, none = self.index.k, self.index.s, self.index.none
        for batch in batches:
            lengths, tokens = lengths_of(batch.column(1)), batch.column(1).flatten()
            docs, pos = places(lengths)
            numbers, known = numbered(tokens)
            codes = self.index.codes(known)
            classes = np.sort((codes >> 1) + np.where(codes & 1, 0, k), axis=1)
            for part, x in self.parts(numbers, codes, lengths):
                here = numbers[part]
                sizes = np.where(here < len(known), s, 0)
                idx = classes[here[sizes > 0]].ravel()
                y = cell_lists(idx, np.full(len(idx), 1.0 / s), sizes, "v")
                doc = batch.column(0).take(pa.array(docs[part]))
                arrays = [doc, pa.array(pos[part]), tokens[part.start : part.stop], x, y]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "pos", "target", "x", "y"])


def places(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The document and the position of every token."""
    docs = np.repeat(np.arange(len(lengths)), lengths)
    return docs, runs(lengths).astype(np.int32)


# -- numbers in few bytes -----------------------------------------------------------


def small(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of 0 or more in groups of seven bits, the low ones first, and how many bytes each has."""
    sizes = np.ones(len(numbers), np.int64)
    top = int(numbers.max()) if len(numbers) else 0
    for shift in range(7, max(top.bit_length(), 1), 7):
        sizes += numbers >= 1 << shift
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for i in range(int(sizes.max()) if len(sizes) else 0):
        some = sizes > i
        out[starts[some] + i] = ((numbers[some] >> 7 * i) & 127) | np.where(sizes[some] > i + 1, 128, 0)
    return out, sizes


def unsmall(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    sizes = ends - starts + 1
    out = np.zeros(len(ends), np.int64)
    for i in range(int(sizes.max()) if len(sizes) else 0):
        some = sizes > i
        out[some] |= (data[starts[some] + i].astype(np.int64) & 127) << 7 * i
    return out


def runs(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the lengths, one behind the other."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, ends.buffers()[1], pa.py_buffer(np.ascontiguousarray(data, np.uint8))])


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings or binaries without null, and the end of each, after a 0."""
    ends = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


# -- sums over a corpus -------------------------------------------------------------


@dataclass(frozen=True)
class Contexts:
    """Context vectors: what a stretch of text adds to its words, and the sum of these parts.

    A part is a word's distinct contexts with their counts or, when they are many, the sum of
    their vectors.  `text` holds the contexts one behind the other, and `numbers` their lengths
    and then their counts; without `text`, the steps from cell to cell and then the values.
    """

    index: Index
    size: int
    include_target: bool = True

    @property
    def few(self) -> int:
        """So many contexts take less room than the cells of their sum."""
        return max(self.index.k // 8, 1)

    def parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``(target, text, numbers)`` from ``(tokens)``."""
        held, size = [], 0
        for batch in batches:
            lists = batch.column(0)
            ends = np.cumsum(lengths_of(lists))
            begin = 0
            while begin < len(lists):  # whole documents, so that no more than a stretch is numbered at once
                before = int(ends[begin - 1]) if begin else 0
                end = max(int(np.searchsorted(ends, before + PAIRS_OF - size)), begin + 1)
                held.append(lists.slice(begin, end - begin))
                size += int(ends[min(end, len(lists)) - 1]) - before
                begin = end
                if size >= PAIRS_OF * 3 // 4:
                    yield from self._counted(held)
                    held, size = [], 0
        if size:
            yield from self._counted(held)

    def _counted(self, lists: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        numbers, known = numbered(pa.chunked_array([x.flatten() for x in lists]))
        place, _ = padded(numbers, np.concatenate([lengths_of(x) for x in lists]), self.size, -1)
        null = len(known)
        names = pa.concat_arrays([known, pa.nulls(1, known.type)])
        del numbers, lists
        place = np.concatenate([place, np.full(self.size, -1)])
        stretches = max(1, round((len(place) - self.size) / PAIRS_OF))
        step = -(-(len(place) - self.size) // stretches)
        for begin in range(0, len(place) - self.size, step):
            left = place[begin : min(begin + step, len(place) - self.size)]
            pairs = self._pairs(place, begin, left, null + 1)
            starts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])[: len(pairs)])
            n = np.diff(np.append(starts, len(pairs))).astype(np.int32)
            pairs = pairs[starts]
            target = (pairs // (null + 1)).astype(np.int32)
            ctx = (pairs % (null + 1)).astype(np.int32)
            del pairs, starts
            some = ctx < null  # null has no positions
            target, ctx, n = target[some], ctx[some], n[some]
            many = np.bincount(target, minlength=null + 1) > self.few
            yield from self._listed(names, known, target, ctx, n, many[target])
            yield from self._summed(names, known, target, ctx, n, many[target])

    def _pairs(self, place: np.ndarray, begin: int, left: np.ndarray, base: int) -> np.ndarray:
        """Sorted numbers target * base + context of all pairs whose first word is in `left`."""
        out, at = np.empty((2 * self.size + 1) * len(left), np.int64), 0
        for d in range(0 if self.include_target else 1, self.size + 1):
            right = place[begin + d : begin + d + len(left)]
            both = (left >= 0) & (right >= 0)
            a, b = left[both], right[both]
            for x, y in ((a, b), (b, a))[: 2 if d else 1]:
                np.multiply(x, base, out=out[at : at + len(a)])
                out[at : at + len(a)] += y
                at += len(a)
        out = out[:at]
        out.sort()
        return out

    def _listed(self, names, known, target, ctx, n, many) -> Iterator[pa.RecordBatch]:
        target, ctx, n = target[~many], ctx[~many], n[~many]
        first = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])[: len(target)])
        for begin in range(0, len(first), LISTED):
            starts = first[begin : begin + LISTED]
            part = slice(starts[0], first[begin + LISTED] if begin + LISTED < len(first) else len(target))
            text, ends = raw(known.take(pa.array(ctx[part])))
            lengths = np.diff(ends)
            texts = binaries(text, np.add.reduceat(lengths, starts - starts[0]))
            yield self._rows(names, target[starts], texts, np.diff(np.append(starts, part.stop)), lengths, n[part])

    def _summed(self, names, known, target, ctx, n, many) -> Iterator[pa.RecordBatch]:
        target, ctx, n = target[many], ctx[many], n[many]
        used, ctx = np.unique(ctx, return_inverse=True)
        codes = self.index.codes(known.take(pa.array(used)))
        words, starts = np.unique(target, return_index=True)
        starts = np.append(starts, len(target))
        for begin in range(0, len(words), VECTORS):
            here = words[begin : begin + VECTORS]
            part = slice(starts[begin], starts[begin + len(here)])
            cells = np.zeros(len(here) * self.index.k)
            self.add(cells, np.searchsorted(here, target[part]), codes, ctx[part], n[part])
            rows, idx, w = self.nonzero(cells)
            sizes = np.bincount(rows, minlength=len(here))
            steps = np.diff(idx, prepend=0)
            steps = np.where(runs(sizes) == 0, idx, steps)
            yield self._rows(names, here, pa.nulls(len(here), pa.binary()), sizes, steps, np.where(w < 0, -2 * w - 1, 2 * w))

    def _rows(self, names, words, text, sizes, first, then) -> pa.RecordBatch:
        """Each row's numbers `first`, and behind them its numbers `then`."""
        starts = 2 * (np.cumsum(sizes) - sizes)
        at = np.repeat(starts, sizes) + runs(sizes)
        both = np.zeros(2 * len(first), np.int64)
        both[at], both[at + np.repeat(sizes, sizes)] = first, then
        data, lengths = small(both)
        before = np.concatenate([[0], np.cumsum(lengths)])
        numbers = binaries(data, before[starts + 2 * sizes] - before[starts])
        return pa.RecordBatch.from_arrays([names.take(pa.array(words)), text, numbers], ["target", "text", "numbers"])

    def add(self, cells: np.ndarray, rows: np.ndarray, codes: np.ndarray, ctx: np.ndarray, n: np.ndarray) -> None:
        """Adds the vectors of counted contexts to the rows of a table of cells."""
        for begin in range(0, len(ctx), ENTRIES):
            part = slice(begin, begin + ENTRIES)
            near = codes[ctx[part]]
            at = rows[part, None] * self.index.k + (near >> 1)
            weights = ((near & 1).astype(np.int64) * 2 - 1) * n[part, None]
            cells += np.bincount(at.ravel(), weights.ravel(), len(cells))  # whole numbers below 2**53 are exact

    def nonzero(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = np.flatnonzero(cells)
        rows, idx = np.divmod(found, self.index.k)
        return rows, idx, cells[found].astype(np.int64)

    def totals(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``(target, cells)`` from ``(target, parts)``, without vectors that have no cells."""
        for batch in batches:
            cells = self.total(batch.column(1))
            found = pa.RecordBatch.from_arrays([batch.column(0), cells], ["target", "cells"])
            yield found.filter(pa.array(lengths_of(cells) > 0))

    def total(self, parts: pa.Array) -> pa.Array:
        """The cells ``(idx, w)`` of each word from the list of its parts."""
        words = np.repeat(np.arange(len(parts)), lengths_of(parts))
        text, numbers = parts.flatten().flatten()
        listed = text.is_valid().to_numpy(zero_copy_only=False)
        target, ctx, n = self._contexts(words[listed], text.filter(pa.array(listed)), numbers.filter(pa.array(listed)))
        row, idx, w = self._cells(words[~listed], numbers.filter(pa.array(~listed)))
        which, known = numbered(ctx)
        codes = self.index.codes(known)
        lengths, found = [np.zeros(0, np.int64)], [(np.zeros(0, np.int64),) * 2]
        for begin in range(0, len(parts), VECTORS):
            end = min(begin + VECTORS, len(parts))
            cells = np.zeros((end - begin) * self.index.k)
            some = slice(*np.searchsorted(target, [begin, end]))
            self.add(cells, target[some] - begin, codes, which[some], n[some])
            some = slice(*np.searchsorted(row, [begin, end]))
            if some.stop > some.start:
                cells += np.bincount((row[some] - begin) * self.index.k + idx[some], w[some], len(cells))
            rows, *both = self.nonzero(cells)
            lengths.append(np.bincount(rows, minlength=end - begin))
            found.append(both)
        return cell_lists(*(np.concatenate(x) for x in zip(*found, strict=True)), np.concatenate(lengths), "w")

    def _halves(self, words: np.ndarray, numbers: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What ``_rows`` put together: sizes, the word of each pair of numbers, and the numbers."""
        data, ends = raw(numbers)
        before = np.concatenate([[0], np.cumsum(data < 128)])
        sizes = np.diff(before[ends]) // 2
        both = unsmall(data)
        at = np.repeat(2 * (np.cumsum(sizes) - sizes), sizes) + runs(sizes)
        return sizes, np.repeat(words, sizes), both[at], both[at + np.repeat(sizes, sizes)]

    def _contexts(self, words: np.ndarray, text: pa.Array, numbers: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        _, target, lengths, n = self._halves(words, numbers)
        return target, binaries(raw(text)[0], lengths), n

    def _cells(self, words: np.ndarray, numbers: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes, row, steps, coded = self._halves(words, numbers)
        sums = np.cumsum(steps)
        starts = np.cumsum(sizes) - sizes
        some = sizes > 0
        idx = sums - np.repeat((sums[starts[some]] - steps[starts[some]]), sizes[some])
        return row, idx, np.where(coded & 1, -(coded >> 1) - 1, coded >> 1)


@dataclass(frozen=True)
class Shares:
    """Cells as shares of the largest of k values, zeros included; minus infinity where that is 0."""

    k: int

    def of(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``(key, cells)`` with other values; no vector is empty."""
        for batch in batches:
            lengths = lengths_of(batch.column(1))
            idx, w = (x.to_numpy(zero_copy_only=False) for x in batch.column(1).flatten().flatten())
            top = np.maximum.reduceat(w, np.cumsum(lengths) - lengths) if len(w) else w
            top = np.repeat(np.where(lengths < self.k, np.maximum(top, 0), top), lengths)
            shares = np.where(top == 0, -np.inf, w / np.where(top == 0, 1, top))
            yield pa.RecordBatch.from_arrays([batch.column(0), cell_lists(idx, shares, lengths, "w")], batch.schema.names)


# -- cells as text --------------------------------------------------------------------


def half_up(values: np.ndarray) -> np.ndarray:
    """Whole numbers, halves away from zero."""
    whole = np.trunc(values)
    return (whole + np.sign(values) * (np.abs(values - whole) >= 0.5)).astype(np.int64)


def joined_cells(cells: pa.Array, digits: int) -> pa.Array:
    """``idx:w`` for each cell; fractions are rounded to whole numbers of 10^-digits."""
    flat = cells.flatten()
    idx, w = (x.to_numpy(zero_copy_only=False) for x in flat.flatten())
    w = half_up(w * 10**digits) if digits else w.astype(np.int64)
    low, high = (int(w.min()), int(w.max())) if len(w) else (0, 0)
    span = high - low + 1
    if len(w) and int(idx.max()) < (1 << 62) // span:
        coded = pa.array(idx.astype(np.int64) * span + (w - low)).dictionary_encode()  # each different cell is written once
        idx, w = np.divmod(coded.dictionary.to_numpy(), span)
        w = w + low
    else:
        coded = None
    text = pc.binary_join_element_wise(pa.array(idx).cast(pa.string()), pa.array(w).cast(pa.string()), ":")
    if coded is not None:
        text = text.take(coded.indices)
    joined = pc.binary_join(list_array(text, lengths_of(cells)), " ")
    return pc.if_else(cells.is_valid(), joined, pa.scalar(None, pa.string()))
