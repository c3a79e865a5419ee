"""Spelling variants: words one edit apart, grouped under their frequent form.

``word_counts`` counts the words of all texts, partially in the tasks.  ``near_words`` finds for
each word of a vocabulary the words that differ by one inserted, deleted or replaced code point:

* The vocabulary is sorted twice, by word and by reversed word, and cut into blocks of `BLOCK`
  words, rows of two stored lists.  If two words are one edit apart, they share either the first
  half of the word asked for or, reversed, the second half; so a word is looked up in one stretch
  of either list, and a find of the second that the first has made as well is left out.
* A scan walks down a stretch with one row of the edit matrix for each character, cut to the
  three cells that can be within one edit and coded as a number.  The next word of the list keeps the rows of the
  prefix it shares with the one before (their LCP) and computes only the rows below.  Once no cell
  of a row is within one edit, all words with that prefix are jumped over by binary search.
* Words travel in the order of the list that they are looked up in, so a block's words visit few
  blocks.  The directory has the first and last word of each block, and a block whose common
  prefix exceeds one edit is not visited.  A task reads one row: some words to look up and one
  block.  No group is ever collected, however many words share a beginning, and no pairs are
  made but the finds, which are folded to one row per word and visit.

The directory (one row per `BLOCK` words of the vocabulary) is held by the driver and the tasks.

``forms`` gives each word its form, the most frequent near word, if that is `ratio` times as
frequent, and its root by pointer doubling: counts grow along a chain by `ratio` at least, so
the rounds number the logarithm of the logarithm of the largest count.

Rows: null texts have no words; a null id counts as the empty string; rows with equal ids or
texts all count; equal counts go to the smaller word by code points; a null word is no word; empty
tables give empty results; other columns are not read, whatever their names; texts are read
whole, a long one in portions.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import portions, stored
from corpuslens.operators.layout import task_count

LETTERS = "A-Za-zÀ-ÿ"
NO_LETTER = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")
HELD_WORDS = 1 << 18  # different words a task counts before it passes them on
BLOCK = 2048  # words of a sorted list in one row
ASKED = 256  # words that are looked up in a block by one row
TOP = "\U0010ffff"
FEW = 4  # words that a jump steps over before it searches


def word_counts(
    docs: DataFrame, min_length: int = 1, change: Callable[[str, str], str] | None = None
) -> DataFrame:
    """(word, n): maximal runs of letters, A-Z lower-cased, of at least `min_length` code points.

    `change(doc_id, word)` may replace a word; what it makes shorter than `min_length` is dropped.
    """
    find = re.compile(f"[{LETTERS}]{{{min_length},}}").findall

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode().lower()  # bytes: only A-Z change
                words: Counter[str] = Counter()
                for portion in portions(data, NO_LETTER):
                    words.update(find(portion.decode()))
                if change:
                    for word, n in words.items():
                        word = change(doc_id or "", word)
                        if len(word) >= min_length:
                            held[word] += n
                else:
                    held.update(words)
                if len(held) >= HELD_WORDS:
                    yield packed(held)
                    held.clear()
        yield packed(held)

    def packed(held: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col("doc_id").cast("string"), F.col("text")).mapInArrow(partial, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def with_slips(every: int) -> Callable[[str, str], str]:
    """A typing slip in one of `every` words, decided by the CRC-32 of id and word: it loses a code point."""

    def slip(doc_id: str, word: str) -> str:
        h = crc32(f"{doc_id}:{word}".encode())
        at = h % len(word)
        return word[:at] + word[at + 1 :] if h % every == 0 else word

    return slip


# -- the sorted list -------------------------------------------------------------------


def halves(word: str) -> tuple[int, int]:
    """Lengths of a first and a second part, one of which a word one edit away must share."""
    rest = max(len(word) - 1, 0)
    return rest // 2, rest - rest // 2


def _coded(below: int, same: int, above: int) -> int:
    return min(below, 2) * 9 + min(same, 2) * 3 + min(above, 2)


def _steps() -> list[int]:
    """The row that follows a row, by row * 8 + which of the three characters around are equal."""
    out = []
    for row in range(27):
        below, same, above = row // 9, row // 3 % 3, row % 3
        for equal in range(8):
            left = min(below + (not equal & 1), same + 1)
            middle = min(same + (not equal & 2), above + 1, left + 1)
            out.append(_coded(left, middle, min(above + (not equal & 4), middle + 1)))
    return out


# A row of the edit matrix, cut to the distances of as many characters and of one less and one
# more, each up to 2, is one of 27 numbers; the next one is looked up.
STEPS = _steps()
FAR = _coded(2, 2, 2)  # nothing within one edit
BEFORE = "\0"  # around the word asked for, equal to no letter


def start_row(shared: int) -> int:
    """The row after `shared` equal characters."""
    return _coded(1 if shared else 2, 0, 1)


def next_row(row: int, char: str, padded: str, depth: int) -> int:
    """The row one character further; `depth` characters have been read before, `padded` has BEFORE around it."""
    return STEPS[row * 8 + (char == padded[depth]) + 2 * (char == padded[depth + 1]) + 4 * (char == padded[depth + 2])]


def pad(asked: str) -> str:
    return BEFORE + asked + BEFORE * 4


def may_hold(asked: str, shared: int, prefix: str) -> bool:
    """Whether a word that begins with `prefix` can be within one edit."""
    row, padded = start_row(shared), pad(asked)
    if len(prefix) > len(asked) + 1:
        return False
    for depth in range(shared, len(prefix)):
        row = next_row(row, prefix[depth], padded, depth)
        if row == FAR:
            return False
    return True


def common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def shared_prefixes(words: list[str]) -> list[int]:
    """For each word of a sorted list how much it shares with the one before (its LCP)."""
    return [0, *map(common, words, words[1:])] if words else []


class SortedList:
    """Distinct words in code-point order with their LCPs."""

    def __init__(self, words: list[str], lcp: list[int]):
        self.words, self.lcp = words, lcp

    def near(self, asked: str, shared: int) -> Iterator[int]:
        """Places of the words one edit away among those that share the first `shared` characters."""
        words, lcp, length, padded = self.words, self.lcp, len(asked), pad(asked)
        at = bisect_left(words, asked[:shared])
        end = bisect_right(words, asked[:shared] + TOP, at)
        rows = [start_row(shared)] * (length + 4)
        depth = shared
        while at < end:
            word = words[at]
            row = rows[depth]
            for char in word[depth : length + 2]:
                row = STEPS[row * 8 + (char == padded[depth]) + 2 * (char == padded[depth + 1]) + 4 * (char == padded[depth + 2])]
                depth += 1
                if row == FAR:
                    break
                rows[depth] = row
            if row == FAR or len(word) > length + 1:
                # all words with this prefix are too far: over a few by their LCP, over many by search
                depth = min(depth, length + 2)
                at += 1
                for _ in range(FEW):
                    if at >= end or lcp[at] < depth:
                        break
                    at += 1
                else:
                    at = bisect_right(words, word[:depth] + TOP, at, end)
            else:
                if len(word) >= length - 1 and row // (9, 3, 1)[length - len(word) + 1] % 3 == 1:
                    yield at
                at += 1
            if at < end:
                depth = lcp[at]


# -- the distributed list ----------------------------------------------------------------

LISTS = "backward boolean, words array<string>, lcp array<int>, counts array<long>"
ROUTES = "block long, asked array<string>"  # words as the list has them, perhaps backward
FOUND = "word string, n_near long, near string, near_n long"


def sorted_blocks(vocab: DataFrame) -> DataFrame:
    """(block, backward, words, lcp, counts): both sorted lists in rows of at most `BLOCK` words; stored."""
    sides = F.explode(
        F.array(
            F.struct(F.lit(False).alias("backward"), F.col("word").alias("key")),
            F.struct(F.lit(True).alias("backward"), F.reverse("word").alias("key")),
        )
    )
    ranged = vocab.select(sides.alias("s"), "n").select("s.*", "n").repartitionByRange("backward", "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, words, counts = None, [], []
        for batch in batches:
            for backward, key, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if words and (backward != side or len(words) == BLOCK):
                    yield packed(side, words, counts)
                    words, counts = [], []
                side = backward
                words.append(key)
                counts.append(n)
        if words:
            yield packed(side, words, counts)

    def packed(side, words, counts) -> pa.RecordBatch:
        kinds = [pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        arrays = [pa.array([v], k) for v, k in zip((side, words, shared_prefixes(words), counts), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["backward", "words", "lcp", "counts"])

    rows = ranged.sortWithinPartitions("backward", "key").mapInArrow(cut, LISTS)
    return stored(rows.select(F.monotonically_increasing_id().alias("block"), "*"), "sorted-words")


class Directory:
    """First and last word of each block, by list; which blocks a word has to visit."""

    def __init__(self, rows: list):
        self.sides = {}
        for backward in (False, True):
            own = sorted((r.first, r.last, r.block) for r in rows if r.backward == backward)
            prefixes = [first[: common(first, last)] for first, last, _ in own]
            self.sides[backward] = ([r[0] for r in own], [r[1] for r in own], prefixes, [r[2] for r in own])

    def blocks_for(self, asked: str, backward: bool) -> Iterator[int]:
        firsts, lasts, prefixes, blocks = self.sides[backward]
        shared = halves(asked)[backward]
        begin = bisect_left(lasts, asked[:shared])
        for i in range(begin, bisect_right(firsts, asked[:shared] + TOP, begin)):
            if may_hold(asked, shared, prefixes[i]):
                yield blocks[i]


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n) of the words of `vocab` (distinct word, n) that have near words.

    `near` is the most frequent one, the smallest by code points among equals.
    """
    blocks = sorted_blocks(vocab.where(F.col("word").isNotNull()))
    ends = blocks.select("block", "backward", F.element_at("words", 1).alias("first"), F.element_at("words", -1).alias("last"))
    directory = Directory(ends.collect())  # one row per block

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for backward, words in zip(*batch.columns, strict=True):
                visits: dict[int, list[str]] = {}
                for asked in words.as_py():
                    for block in directory.blocks_for(asked, backward.as_py()):
                        visits.setdefault(block, []).append(asked)
                cut = [(b, v[i : i + ASKED]) for b, v in visits.items() for i in range(0, len(v), ASKED)]
                arrays = [pa.array([b for b, _ in cut], pa.int64()), pa.array([v for _, v in cut], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, ["block", "asked"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                asked, backward, words, lcp, counts = (x.as_py() for x in row)
                found = visit(asked, backward, SortedList(words, lcp), counts)
                names = ["word", "n_near", "near", "near_n"]
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
                columns = list(zip(*found, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def visit(asked: list[str], backward: bool, block: SortedList, counts: list[int]) -> list[tuple]:
        out = []
        for key in asked:
            parts, near = halves(key), []
            word = key[::-1] if backward else key
            for i in block.near(key, parts[backward]):
                other = block.words[i][::-1] if backward else block.words[i]
                if not (backward and other.startswith(word[: parts[0]])):  # the forward list has found it
                    near.append((-counts[i], other))
            if near:
                n, best = min(near)
                out.append((word, len(near), best, -n))
        return out

    spread = task_count(vocab)
    routes = blocks.select("backward", "words").repartition(spread).mapInArrow(route, ROUTES)
    visits = routes.join(blocks, "block").select("asked", "backward", "words", "lcp", "counts").repartition(spread)
    found = visits.mapInArrow(scan, FOUND).groupBy("word")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    folded = found.agg(F.sum("n_near").alias("n_near"), best.alias("_best"))
    return folded.select("word", "n_near", F.col("_best.near").alias("near"), (-F.col("_best.less")).alias("near_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for each (word, form): the end of the chain of forms, which has no cycles."""
    ends = stored(links.select("word", F.col("form").alias("root")), "chains")
    while True:
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = ends.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        moved = stored(moved, "chains")
        ends = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return ends


def forms(vocab: DataFrame, ratio: int = 5) -> DataFrame:
    """`vocab` (distinct word, n) with form, form_n, root and n_near."""
    joined = vocab.join(near_words(vocab), "word", "left")
    take = F.col("near_n") >= ratio * F.col("n")
    formed = joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(take, F.col("near")).alias("form"),
        F.when(take, F.col("near_n")).alias("form_n"),
    )
    formed = stored(formed, "forms")
    ends = roots(formed.where(F.col("form").isNotNull()))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(
    docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, change: Callable[[str, str], str] | None = None
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of `docs` that are long and frequent enough."""
    counted = word_counts(docs, min_length, change).where(F.col("n") >= min_count)
    return forms(stored(counted, "vocabulary"), ratio)
