"""Ranked lexical search by hashed sketches of maxima, exact to the last rank.

``build_index`` writes the documents with terms as segments of bounded size: the terms of each
document with their counts, and a sketch.  The sketch folds the terms into coordinates by hash
and keeps the largest count of each coordinate.  For one document the impact of a term grows
with its count, so the impact of the largest count is the largest impact, and the sketch need
not be made anew when the corpus statistics change.  Its width follows the document's number of
distinct terms (a power of two, at least four times as many), so long documents are not blurred
more than short ones; counts of 255 or more are read as the limit of the impact.

``search`` looks up a batch of queries: a segment's upper bounds are the sums of the weights
times the impact of the coordinates.  In the order of descending bounds, documents are then
scored exactly from their stored counts, until the next bound is below the lowest score held; a
task holds the best of all its segments, so later segments begin with a high threshold.  What the
tasks hold, `k` rows for each query and task, is ranked at the end.  No bound is below the score
(impacts and weights are not negative, sums are below 2**53 and hence exact in doubles), so
nothing is lost, whatever collides.

A batch has at most `BATCH_TERMS` query terms (one query may exceed it).  Only a batch is held
by the driver and travels with the tasks; a larger set of queries is searched batch by batch.

Rows: a text without terms is no document, a query without terms has no rows; a null text has no
terms.  Rows with equal ids are documents of their own, as are queries; a null id comes after
the others at equal scores.  Empty tables give an empty result; other columns are not read; a
long text is read in portions and is one document, which alone may exceed a segment's size.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import ascii_lower, portions, stored
from corpuslens.session import scratch_path

TERM_RULE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
NO_TERM_BYTE = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
SEGMENT_WORDS = 1 << 18
SEGMENT_DOCS = 2048
FOLD = 4  # coordinates for each distinct term, at least
LEAST_WIDTH = 64
FULL = 255  # a sketch's count that means "this or more"
LIMIT = 1_000_000  # the impact stays below this
BATCH_TERMS = 1 << 14
BOUNDED = 1 << 18  # impacts of documents and coordinates held at once
FIRST_SCORED = 64  # documents scored before the threshold is looked at again

SEGMENT = (
    "n_docs long, n_terms long, ids array<long>, absent array<boolean>, sizes array<long>, terms array<string>, "
    "dfs array<int>, ends array<int>, postings array<int>, tfs array<int>, widths array<int>, sketch binary"
)
FOUND = "item long, doc_id long, score long"


def impact(tf, m):
    """(10**9 tf) div (1000 tf + 20 m) for arrays."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def length_norm(n, docs: int, terms: int):
    """m of documents with n terms, in a corpus of `docs` documents with `terms` terms."""
    return 50 + (50 * n * docs) // terms


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


# -- the index ----------------------------------------------------------------------------


class Builder:
    """Collects documents until they make a segment."""

    def __init__(self):
        self.ids, self.absent, self.parts = [], [], []
        self.numbers = defaultdict(count().__next__)
        self.words = 0

    def add(self, doc_id: int, absent: bool, text: bytes) -> None:
        number = self.numbers.__getitem__
        found = [TERM_BYTES.findall(p) for p in ([text] if len(text) < 1 << 20 else portions(text, NO_TERM_BYTE))]
        parts = [np.fromiter(map(number, words), np.int64, len(words)) for words in found]
        terms = parts[0] if len(parts) == 1 else np.concatenate(parts)
        if len(terms):
            self.ids.append(doc_id)
            self.absent.append(absent)
            self.parts.append(terms)
            self.words += len(terms)

    def full(self) -> bool:
        return self.words >= SEGMENT_WORDS or len(self.ids) >= SEGMENT_DOCS

    def segment(self) -> pa.RecordBatch:
        listed = list(self.numbers)
        order = sorted(range(len(listed)), key=listed.__getitem__)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        terms = [listed[i] for i in order]
        sizes = np.array([len(p) for p in self.parts], np.int64)
        flat = rank[np.concatenate(self.parts)]
        keys, tfs = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(terms) + flat, return_counts=True)
        docs, postings = np.divmod(keys, len(terms))
        distinct = np.bincount(docs, minlength=len(sizes))
        widths = np.maximum(LEAST_WIDTH, 1 << np.ceil(np.log2(FOLD * distinct)).astype(np.int64))
        starts = np.cumsum(widths) - widths
        hashes = hashed(terms)
        sketch = np.zeros(int(widths.sum()), np.uint8)
        np.maximum.at(sketch, starts[docs] + (hashes[postings] & (widths[docs] - 1)), np.minimum(tfs, FULL).astype(np.uint8))
        dfs = np.bincount(postings, minlength=len(terms))
        lists = {
            "ids": (self.ids, pa.int64()), "absent": (self.absent, pa.bool_()), "sizes": (sizes, pa.int64()),
            "terms": ([t.decode() for t in terms], pa.string()), "dfs": (dfs.astype(np.int32), pa.int32()),
            "ends": (np.cumsum(distinct).astype(np.int32), pa.int32()), "postings": (postings.astype(np.int32), pa.int32()),
            "tfs": (tfs.astype(np.int32), pa.int32()), "widths": (widths.astype(np.int32), pa.int32()),
        }
        arrays = [pa.array([len(sizes)], pa.int64()), pa.array([int(sizes.sum())], pa.int64())]
        arrays += [pa.array([v], pa.list_(k)) for v, k in lists.values()] + [pa.array([sketch.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["n_docs", "n_terms", *lists, "sketch"])


def hashed(terms: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, terms), np.int64, len(terms))


def build_index(docs: DataFrame) -> DataFrame:
    """The stored segments of `docs` (doc_id, text)."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Builder()
        for batch in batches:
            ids, absent = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, missing, text in zip(ids, absent, batch.column(2), strict=True):
                held.add(doc_id, missing, (text.as_py() or "").encode().lower())  # bytes: only A-Z change
                if held.full():
                    yield held.segment()
                    held = Builder()
        if held.ids:
            yield held.segment()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull(), "text")
    found = rows.toDF("doc_id", "absent", "text").mapInArrow(segments, SEGMENT)
    return stored(found, "impacts", **{"parquet.block.row.count.limit": "1"})  # readers hold a row group as a whole


# -- the search ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Batch:
    """Queries with the weights of their terms; terms that no document has are left out."""

    items: list[int]
    terms: list[list[int]]  # places in `vocabulary`
    vocabulary: list[str]
    weights: np.ndarray
    docs: int
    words: int
    k: int


class Segment:
    """One row of the index as arrays, and the batch's terms in it."""

    def __init__(self, rows: pa.RecordBatch, place: int, batch: Batch):
        def array(name: str, kind=np.int64) -> np.ndarray:
            return rows.column(name)[place].values.to_numpy(zero_copy_only=False).astype(kind)

        self.ids, self.absent = array("ids"), array("absent", bool)
        self.m = length_norm(array("sizes"), batch.docs, batch.words)
        terms = rows.column("terms")[place].values
        self.places = pc.fill_null(pc.index_in(pa.array(batch.vocabulary, terms.type), value_set=terms), -1).to_numpy().astype(np.int64)
        self.n_terms = len(terms)
        ends = array("ends")
        self.keys = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)) * self.n_terms + array("postings")
        self.tfs = array("tfs")
        self.widths = array("widths")
        self.starts = np.cumsum(self.widths) - self.widths
        self.sketch = np.frombuffer(rows.column("sketch")[place].as_py(), np.uint8)

    def bounds(self, batch: Batch, present: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
        """Upper bounds of all scores, a row for each query."""
        out = np.zeros((len(present), len(self.ids)))
        used = np.unique(np.concatenate(present)) if present else np.zeros(0, np.int64)
        if not len(used):
            return out
        for width in np.unique(self.widths):
            alike = np.flatnonzero(self.widths == width)
            columns, inverse = np.unique(hashes[used] & (width - 1), return_inverse=True)
            at = np.zeros(len(hashes), np.int64)
            at[used] = inverse
            step = max(1, BOUNDED // len(columns))
            for docs in (alike[i : i + step] for i in range(0, len(alike), step)):
                peaks = self.sketch[self.starts[docs][None, :] + columns[:, None]].astype(np.int64)
                impacts = np.where(peaks == FULL, LIMIT, impact(peaks, self.m[docs][None, :])).astype(np.float64)
                for q, terms in enumerate(present):
                    if len(terms):
                        out[q, docs] = batch.weights[terms].astype(np.float64) @ impacts[at[terms]]
        return out

    def scores(self, docs: np.ndarray, places: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of some documents."""
        wanted = docs[:, None] * self.n_terms + places[None, :]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        tf = np.where(self.keys[at] == wanted, self.tfs[at], 0)
        return (impact(tf, self.m[docs][:, None]) * weights[None, :]).sum(1)


class Best:
    """The k best documents so far of one query."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.absent, self.ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def threshold(self) -> int:
        """Scores below cannot enter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, absent: np.ndarray, ids: np.ndarray) -> None:
        scores, absent, ids = (np.concatenate(p) for p in ((self.scores, scores), (self.absent, absent), (self.ids, ids)))
        order = np.lexsort((ids, absent, -scores))[: self.k]
        order = order[scores[order] > 0]
        self.scores, self.absent, self.ids = scores[order], absent[order], ids[order]


def scan(segment: Segment, batch: Batch, hashes: np.ndarray, best: list[Best]) -> int:
    """Adds a segment's documents to the best of each query; returns how many were scored."""
    present = [np.array([t for t in terms if segment.places[t] >= 0], np.int64) for terms in batch.terms]
    scored = 0
    for held, terms, bounds in zip(best, present, segment.bounds(batch, present, hashes), strict=True):
        found = np.flatnonzero(bounds >= held.threshold())
        order = found[np.argsort(-bounds[found], kind="stable")]
        at, step = 0, FIRST_SCORED
        while at < len(order) and bounds[order[at]] >= held.threshold():
            docs = order[at : at + step]
            held.add(segment.scores(docs, segment.places[terms], batch.weights[terms]), segment.absent[docs], segment.ids[docs])
            at, step = at + len(docs), step * 2
        scored += at
    return scored


def document_counts(index: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many documents hold each of the terms; terms that none has are left out."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, wanted = np.zeros(len(vocabulary) + 1, np.int64), pa.array(vocabulary, pa.string())
        for batch in batches:
            for terms, dfs in zip(*batch.columns, strict=True):
                places = pc.fill_null(pc.index_in(terms.values, value_set=wanted), len(vocabulary)).to_numpy()
                np.add.at(total, places, dfs.values.to_numpy())
        held = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([wanted.take(pa.array(held)), pa.array(total[held])], ["term", "df"])

    rows = index.select("terms", "dfs").mapInArrow(counted, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in rows.collect()}  # at most one row per term of the batch


def query_terms(text: Column | str) -> Column:
    """The distinct terms of a text; null for null."""
    return F.array_distinct(F.regexp_extract_all(ascii_lower(text), F.lit(TERM_RULE), F.lit(0)))


def batches_of(items: DataFrame, batch_terms: int) -> Iterator[list]:
    """The queries in groups of at most `batch_terms` terms, fetched one by one."""
    held, size = [], 0
    for row in items.toLocalIterator():
        if held and size + len(row.terms) > batch_terms:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row.terms)
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, k: int, batch_terms: int = BATCH_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 for each item (item_id, text)."""
    spark = docs.sparkSession
    index = build_index(docs)
    n_docs, n_words = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    queries = items.select("item_id", query_terms("text").alias("terms")).where(F.size("terms") > 0)
    queries = stored(queries.select(F.monotonically_increasing_id().alias("item"), "*"), "queries")
    path = scratch_path(spark, "found")
    spark.createDataFrame([], FOUND).write.parquet(path)
    for rows in batches_of(queries.select("item", "terms"), batch_terms) if n_docs else ():
        _found(index, _batch(index, rows, n_docs, n_words, k)).write.mode("append").parquet(path)
    found = spark.read.schema(FOUND).parquet(path)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(queries.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _batch(index: DataFrame, rows: list, n_docs: int, n_words: int, k: int) -> Batch:
    dfs = document_counts(index, sorted({t for r in rows for t in r.terms}))
    vocabulary = sorted(dfs)
    place = {t: i for i, t in enumerate(vocabulary)}
    terms = [[place[t] for t in r.terms if t in place] for r in rows]
    weights = np.array([weight(n_docs, dfs[t]) for t in vocabulary], np.int64)
    return Batch([r.item for r in rows], terms, vocabulary, weights, n_docs, n_words, k)


def _found(index: DataFrame, batch: Batch) -> DataFrame:
    """What the tasks hold at their end: at most k rows for each query and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, hashes = [Best(batch.k) for _ in batch.items], hashed([t.encode() for t in batch.vocabulary])
        for rows in batches:
            for place in range(len(rows)):
                scan(Segment(rows, place, batch), batch, hashes, best)
        items = np.repeat(np.array(batch.items, np.int64), [len(b.scores) for b in best])
        ids = pa.array(np.concatenate([b.ids for b in best]), mask=np.concatenate([b.absent for b in best]))
        scores = np.concatenate([b.scores for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(items), ids, pa.array(scores)], ["item", "doc_id", "score"])

    return index.drop("n_docs", "n_terms", "dfs").mapInArrow(run, FOUND)
