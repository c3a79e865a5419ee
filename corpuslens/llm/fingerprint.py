"""Document fingerprints: quartile digests of hashed byte triplets.

The triplets of neighbouring bytes of a text are hashed into buckets and counted.  The
digest says for each bucket in which quartile of all buckets its count lies (2 bits), and
in front of that the logarithm of the length and the ratios of the quartiles.  Two digests
differ by the distances of their buckets, lengths and ratios; the difference is bounded,
and likeness is 1 minus its share of the bound.

``compare_with_next`` gives every document its successor in descending id order.  The rows
are dealt once to ranges of ids; the first document of a range is sent to the range before
it as well, so each task finds all its pairs itself.  The driver holds one id per range.

Rows: a null text is empty; an empty text has a digest of its own; null ids come last;
rows with one id are ordered by text; a single row is its own successor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 256
LENGTH_BASE = 1.25
CHUNK = 1 << 20  # bytes counted at a time
LENGTH_WEIGHT, LENGTH_BOUND, RATIO_WEIGHT = 2, 24, 4
STEP = np.array([0, 1, 2, 6])  # difference of two buckets by the distance of their quartiles
BOUND = 2 * BUCKETS  # more than unrelated texts differ by; a larger difference counts as this one


def bucket_counts(data: bytes) -> np.ndarray:
    """How often each bucket is hit by a triplet of neighbouring bytes."""
    counts = np.zeros(BUCKETS, np.int64)
    for start in range(0, max(len(data) - 2, 0), CHUNK):
        b = np.frombuffer(data, np.uint8, min(CHUNK + 2, len(data) - start), start).astype(np.uint32)
        code = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(24), minlength=BUCKETS)
    return counts


def fingerprint(data: bytes) -> str:
    """Length (2 hex digits), ratios of the quartiles (2), quartile of each bucket (2 bits each)."""
    counts = bucket_counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    length = min(255, round(np.log(len(data) + 1) / np.log(LENGTH_BASE)))
    ratios = (int(q1 * 15 // q3) << 4 | int(q2 * 15 // q3)) if q3 else 0
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = code[0::4] << 6 | code[1::4] << 4 | code[2::4] << 2 | code[3::4]
    return f"{length:02x}{ratios:02x}{packed.astype(np.uint8).tobytes().hex()}"


def difference(a: str, b: str) -> int:
    """0 for equal fingerprints, `BOUND` at most."""
    x, y = (np.frombuffer(bytes.fromhex(f), np.uint8).astype(np.int16) for f in (a, b))
    total = LENGTH_WEIGHT * min(abs(int(x[0]) - int(y[0])), LENGTH_BOUND)
    total += RATIO_WEIGHT * (abs(int(x[1] >> 4) - int(y[1] >> 4)) + abs(int(x[1] & 15) - int(y[1] & 15)))
    for shift in (0, 2, 4, 6):
        total += int(STEP[np.abs((x[2:] >> shift & 3) - (y[2:] >> shift & 3))].sum())
    return min(total, BOUND)


def likeness(a: str, b: str) -> float:
    return 1.0 if a == b else 1.0 - difference(a, b) / BOUND


@F.pandas_udf(T.StringType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: fingerprint((t or "").encode()))


@F.pandas_udf(T.DoubleType())
def _likeness(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([likeness(a, b) if a and b else None for a, b in zip(left, right, strict=True)], dtype="float64")


def fingerprint_of(text: Column | str) -> Column:
    """The fingerprint of a text column."""
    return _fingerprints(F.col(text) if isinstance(text, str) else text)


def likeness_of(left: Column | str, right: Column | str) -> Column:
    """The likeness, 0 to 1, of two fingerprint columns; null where one is null."""
    return _likeness(left, right)


def edited(text: str, following: str) -> str:
    """`text` with its last third replaced by as many first characters of `following`."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form, and their likeness."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    quantiles = docs.agg(F.percentile_approx("doc_id", F.lit(shares), 10 * parts)).first()[0]
    edges = np.array(sorted(set(quantiles or [])), dtype=np.int64)
    ranges = len(edges) + 2  # the last is for rows without id

    # Ids travel as text where they can be null: pandas would make them floating point.
    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        absent = ids.isna()
        cell = len(edges) - np.searchsorted(edges, ids.fillna("0").astype("int64"), "right")
        return pd.Series(np.where(absent, ranges - 1, cell).astype(np.int32))

    ranged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), range_of(F.col("doc_id").cast("string")).alias("part"))
    heads = ranged.groupBy("part").agg(F.max("doc_id").alias("head")).orderBy("part").collect()  # one row per range
    before = {heads[i].part: heads[i - 1].part for i in range(len(heads))}  # the first follows the last
    sent = docs.sparkSession.createDataFrame(
        [(h.part, h.head, before[h.part]) for h in heads], "part int, head long, previous int"
    )  # one row per range
    marked = ranged.withColumn("fingerprint", fingerprint_of("text")).join(F.broadcast(sent), "part")
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("previous").alias("part"), F.lit(1).alias("guest"))
    to = F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(own, guest)).otherwise(F.array(own)))
    dealt = (
        marked.select(to.alias("to"), F.col("doc_id"), "text", "fingerprint")
        .select("to.*", "doc_id", "text", "fingerprint")
        .repartitionById(ranges, F.col("part"))
        .sortWithinPartitions("guest", F.col("doc_id").desc_nulls_last(), "text")
        .select("guest", F.col("doc_id").cast("string").alias("doc_id"), "text", "fingerprint")
    )

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            out = []
            for guest, doc_id, text, mark in batch.itertuples(index=False):
                if held:
                    out.append(result(*held, text, mark))
                    held = None
                if not guest:
                    held = (doc_id, text, mark)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"doc_id": "Int64"})

    def result(doc_id, text, mark, following, following_mark) -> tuple:
        data = edited(text, following).encode()
        changed = fingerprint(data)
        return (
            None if pd.isna(doc_id) else int(doc_id),
            len(text),
            hashlib.sha256(data).hexdigest(),
            mark,
            changed,
            likeness(mark, changed),
            likeness(mark, following_mark),
        )

    return dealt.mapInPandas(pairs, RESULT)
