"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` turns the training texts into index segments.  A segment covers some
thousand neighbouring documents and holds, for every test term that occurs in them, the
sorted list of its positions; documents lie in it one behind the other with a gap, so a
position names document and word at once, and a phrase cannot run over two documents.
Terms that no test item uses are never looked up and have no list.  The index is written
to the shared folder once.

``phrase_matches`` looks for windows of the test items.  In each segment, windows with an
absent term are out at once.  For the others, the list of the window's rarest term (by
counts over all documents) is shifted by the term's offset to starting positions, and
intersected with the shifted lists of the other terms from rare to frequent, until it is
empty or all words have agreed.  What remains are exact matches, so nothing has to be
verified in the texts.  ``proximity_matches`` does the same with shifts that may deviate.

Segments are independent rows of bounded size (one document may exceed it), so nothing is
shuffled but one result row per document, and a term or passage that is in every document
makes no task larger than others.  The distinct test words travel with the task,
and the windows in blocks of at most `BLOCK_WORDS` words; a larger benchmark is matched
block by block.

Rows: null texts have no words; null items no windows; rows with equal ids are different
documents; an item id that is null counts as the empty string in lists of items.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import ascii_lower, stored, unpacked, whole

WORD_RULE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after lower-casing A-Z
WORD_BYTES = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
SEGMENT_WORDS = 1 << 20
BROADCAST_ROWS = 500_000
BLOCK_WORDS = 1 << 22  # test words matched at a time; bounds what travels with a task

SEGMENT = (
    "segment long, doc_ids array<string>, sizes array<int>, terms array<int>, ends array<int>, positions array<int>"
)


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, words) of the items that have words."""
    words = F.regexp_extract_all(ascii_lower("text"), F.lit(WORD_RULE), F.lit(0))
    return items.select("item_id", words.alias("words")).where(F.size("words") > 0)


def windows(items: DataFrame, length: int = WINDOW) -> DataFrame:
    """(words, items): distinct windows of `length` words; a shorter item is one window."""
    last = F.greatest(F.size("words") - length, F.lit(0))
    starts = F.explode(F.sequence(F.lit(0), last))
    cut = item_words(items).select("item_id", "words", starts.alias("start"))
    sliced = cut.select(F.slice("words", F.col("start") + 1, length).alias("words"), F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"))
    return sliced.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


def blocks(rows: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list]:
    """The windows in groups of at most `block_words` words, fetched one by one."""
    held, size = [], 0
    for row in rows.toLocalIterator():
        held.append(row)
        size += len(row.words)
        if size >= block_words:
            yield held
            held, size = [], 0
    if held:
        yield held


def build_index(docs: DataFrame, vocabulary: list[str], segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The stored positional index of `docs` (doc_id, text) for the terms of `vocabulary`.

    A term is its place in `vocabulary`.  ``ends`` says where a term's list ends in
    ``positions``; document k begins behind the sizes of those before it and k gaps.
    """
    numbers = {word.encode(): i for i, word in enumerate(vocabulary)}

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, parts, length = [], [], [], 0
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                words = WORD_BYTES.findall((text.as_py() or b"").lower())  # bytes: only A-Z are changed
                ids.append(doc_id)
                sizes.append(len(words))
                parts.append(np.fromiter((numbers.get(w, -1) for w in words), np.int32, len(words)))
                length += len(words) + 1
                if length >= segment_words:
                    yield pack(ids, sizes, parts)
                    ids, sizes, parts, length = [], [], [], 0
        if ids:
            yield pack(ids, sizes, parts)

    def pack(ids: list, sizes: list, parts: list) -> pa.RecordBatch:
        gap = np.array([-1], np.int32)
        flat = np.concatenate([x for part in parts for x in (part, gap)])
        at = np.flatnonzero(flat >= 0).astype(np.int32)
        order = np.argsort(flat[at], kind="stable")  # positions stay sorted within a term
        terms, counts = np.unique(flat[at], return_counts=True)
        values = [ids, sizes, terms.astype(np.int32), np.cumsum(counts).astype(np.int32), at[order]]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
        arrays = [pa.array([v], pa.list_(k)) for v, k in zip(values, kinds, strict=True)]
        names = ["doc_ids", "sizes", "terms", "ends", "positions"]
        return pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(segments, SEGMENT.split(", ", 1)[1])
    return stored(rows.select(F.monotonically_increasing_id().alias("segment"), "*"), "positions")


def term_counts(index: DataFrame) -> list[tuple[int, int]]:
    """(term, occurrences in all documents): one row per term of the vocabulary."""
    lists = index.select(F.posexplode("terms").alias("i", "term"), "ends")
    before = F.when(F.col("i") > 0, F.element_at("ends", F.greatest(F.col("i"), F.lit(1)))).otherwise(0)
    counted = lists.select("term", (F.element_at("ends", F.col("i") + 1) - before).alias("n"))
    return [(r.term, r.n) for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()]


class Segment:
    """One row of the index as arrays."""

    def __init__(self, row: dict):
        self.terms, self.ends, self.positions, sizes = (np.asarray(row[k], np.int64) for k in ("terms", "ends", "positions", "sizes"))
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(sizes) else sizes

    def present(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.zeros(terms.shape, bool)
        return self.terms[np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)] == terms

    def positions_of(self, term: int) -> np.ndarray:
        i = int(np.searchsorted(self.terms, term))
        return self.positions[self.ends[i - 1] if i else 0 : self.ends[i]]

    def phrase(self, terms: list[int], offsets: list[int]) -> np.ndarray:
        """Starting positions of the phrase; `terms` from rare to frequent."""
        found = self.positions_of(terms[0]) - offsets[0]
        for term, offset in zip(terms[1:], offsets[1:], strict=True):
            if not len(found):
                break
            have = self.positions_of(term)
            place = np.minimum(np.searchsorted(have, found + offset), len(have) - 1)
            found = found[have[place] == found + offset]
        return found

    def near(self, terms: list[int], offsets: list[int], slop: int) -> np.ndarray:
        """Starts by the rarest term for which each other term is at most `slop` off its place."""
        found = self.positions_of(terms[0]) - offsets[0]
        document = np.searchsorted(self.starts, found + offsets[0], "right")
        for term, offset in zip(terms[1:], offsets[1:], strict=True):
            if not len(found):
                break
            have = self.positions_of(term)
            place = np.searchsorted(have, found + offset)
            close = np.zeros(len(found), bool)
            for side in (place - 1, place):
                at = have[np.clip(side, 0, len(have) - 1)]
                close |= (np.abs(at - found - offset) <= slop) & (np.searchsorted(self.starts, at, "right") == document)
            found, document = found[close], document[close]
        return found


def _lookups(block: list, numbers: dict[str, int], counts: dict[int, int]):
    """Windows as term numbers and offsets, each ordered from the rarest term."""
    terms, offsets, lengths, items = [], [], [], []
    for row in block:
        own = [numbers[w] for w in row.words]
        if any(t not in counts for t in own):
            continue  # a word that no document has
        order = sorted(range(len(own)), key=lambda i: (counts[own[i]], own[i], i))
        terms.append([own[i] for i in order])
        offsets.append(order)
        lengths.append(len(own))
        items.append(row.items)
    width = max(lengths, default=1)
    padded = np.array([t + t[:1] * (width - len(t)) for t in terms], np.int64).reshape(-1, width)
    return terms, offsets, lengths, items, padded


def _matches(docs: DataFrame, items: DataFrame, find, schema: str, length: int, block_words: int) -> DataFrame:
    """What `find(segment row, lookups)` returns for each segment and each block of windows."""
    vocabulary = [r.word for r in item_words(items).select(F.explode("words").alias("word")).distinct().toLocalIterator()]
    index = build_index(docs, vocabulary)
    numbers, counts = {w: i for i, w in enumerate(vocabulary)}, dict(term_counts(index))

    def run(block: list) -> DataFrame:
        lookups = _lookups(block, numbers, counts)

        def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.to_dict("records"):
                    yield find(row, Segment(row), lookups)

        return index.mapInPandas(matched, schema)

    parts = [run(block) for block in blocks(windows(items, length), block_words)] or [run([])]
    return functools.reduce(DataFrame.unionByName, parts)


MATCH = "segment long, ordinal int, doc_id string, n_words int, hits array<int>, items array<string>"


def phrase_matches(docs: DataFrame, items: DataFrame, length: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, hits (word numbers inside a match), items.

    Documents without a match have empty arrays.
    """
    found = _phrases(docs, items, length, block_words)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def clean_documents(docs: DataFrame, items: DataFrame, length: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents in which no window of an item occurs.

    Texts are matched under a digest of id and text, so rows with equal ids are told apart.
    The table of contaminated digests is broadcast only when it is counted to be small.
    """
    keyed = docs.select(whole(docs), F.md5(F.concat_ws(":", "doc_id", "text")).alias("_mark"))
    texts = docs.select(F.md5(F.concat_ws(":", "doc_id", "text")).alias("doc_id"), "text")
    hit = _phrases(texts, items, length, block_words).where(F.size("hits") > 0).select(F.col("doc_id").alias("_mark"))
    hit = stored(hit.distinct(), "contaminated")
    small = hit.count() <= BROADCAST_ROWS
    return unpacked(keyed.join(F.broadcast(hit) if small else hit, "_mark", "left_anti"))


def _phrases(docs: DataFrame, items: DataFrame, length: int, block_words: int) -> DataFrame:
    """``phrase_matches`` with ids as text."""

    def find(row: dict, segment: Segment, lookups) -> pd.DataFrame:
        terms, offsets, lengths, items, padded = lookups
        covered = np.zeros(int(segment.starts[-1]) + row["sizes"][-1] + 2, np.int32)
        found: list[set[str]] = [set() for _ in row["sizes"]]
        for w in np.flatnonzero(segment.present(padded).all(axis=1)).tolist() if terms else ():
            starts = segment.phrase(terms[w], offsets[w])
            if len(starts):
                np.add.at(covered, starts, 1)
                np.add.at(covered, starts + lengths[w], -1)
                for k in np.unique(np.searchsorted(segment.starts, starts, "right") - 1).tolist():
                    found[k].update(items[w])
        hit = np.flatnonzero(np.cumsum(covered) > 0)
        owner = np.searchsorted(segment.starts, hit, "right") - 1
        cut = np.searchsorted(owner, np.arange(len(found) + 1))
        hits = [(hit[cut[k] : cut[k + 1]] - segment.starts[k]).astype(np.int32) for k in range(len(found))]
        n = len(found)
        return pd.DataFrame(
            {
                "segment": np.full(n, row["segment"], np.int64),
                "ordinal": np.arange(n, dtype=np.int32),
                "doc_id": pd.Series(row["doc_ids"], dtype=object),
                "n_words": np.array(row["sizes"], np.int32),
                "hits": hits,
                "items": [sorted(x) for x in found],
            }
        )

    # One row per document and block of windows; the hits of all blocks are joined.
    found = _matches(docs, items, find, MATCH, length, block_words).groupBy("segment", "ordinal")
    merged = found.agg(
        F.min("doc_id").alias("doc_id"),
        F.min("n_words").alias("n_words"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return merged.select("doc_id", "n_words", "hits", "items")


NEAR = "doc_id string, item string, position int"


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int, length: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item, position): windows whose words all occur, each at most `slop` words from
    its place relative to the rarest one; `position` is where the window would begin."""

    def find(row: dict, segment: Segment, lookups) -> pd.DataFrame:
        terms, offsets, _, items, padded = lookups
        out = []
        for w in np.flatnonzero(segment.present(padded).all(axis=1)).tolist() if terms else ():
            anchor = offsets[w][0]
            for start in segment.near(terms[w], offsets[w], slop).tolist():
                k = int(np.searchsorted(segment.starts, start + anchor, "right")) - 1
                out += [(row["doc_ids"][k], item, start - int(segment.starts[k])) for item in items[w]]
        frame = pd.DataFrame(out, columns=["doc_id", "item", "position"])
        return frame.astype({"doc_id": object, "item": object, "position": np.int32})

    found = _matches(docs, items, find, NEAR, length, block_words)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "item", "position").distinct()
