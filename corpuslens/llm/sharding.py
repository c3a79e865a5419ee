"""Sharding by histogram sort: shards of near-equal bytes, one exchange of the rows.

Documents are ordered by a 63-bit key, the first 40 bits from the text and the rest from
id and text, so equal texts lie together while a group of copies of any size can still be
cut.  Splitters are found without sorting: tasks count the exact bytes between candidate
keys (probes), the driver adds the few counts and puts new probes only where a splitter
is still open, until each is within its tolerance or at a single key.  Then every row
goes to its place in one exchange.

A shard consists of consecutive blocks, as many in all as there are shuffle partitions, so
that no task sorts a whole shard; slots are numbered by adding the sizes of the blocks
before.  The driver holds one number per probe and block, never anything per row.

Rows: a null text has 0 bytes; rows that agree in id and text share a key and so a shard;
an empty table gives an empty result; added columns replace input columns of their name.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import stored, unpacked, whole

TEXT_BITS, ROW_BITS = 40, 23
PROBES = 4096  # of the first round
REFINED = 64  # per open interval in later rounds
BLOCK_TOLERANCE = 0.25  # of a block; blocks only balance tasks


def byte_size(text: Column | str) -> Column:
    """Bytes of the text in UTF-8 (null: none) plus 1."""
    text = F.col(text) if isinstance(text, str) else text
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc32(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def order_key(doc_id: Column | str, text: Column | str) -> Column:
    """Text first, then id: equal texts are neighbours but have keys of their own."""
    hexed = F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    inner = F.md5(F.concat_ws(":", F.col(doc_id) if isinstance(doc_id, str) else doc_id, hexed))
    high = F.conv(F.substring(hexed, 1, TEXT_BITS // 4), 16, 10).cast("long")
    low = F.conv(F.substring(inner, 1, 6), 16, 10).cast("long")
    return F.shiftleft(high, ROW_BITS).bitwiseOR(F.shiftright(low, 24 - ROW_BITS))


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key) of every document."""
    return docs.select(
        "doc_id", byte_size("text").alias("size"), text_crc32("text").alias("text_crc32"), order_key("doc_id", "text").alias("key")
    )


def count_cells(measured: DataFrame, probes: list[int]) -> pd.DataFrame:
    """Bytes and extreme keys between neighbouring probes, summed over all partitions."""
    edges = np.array(probes, dtype=np.int64)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = np.zeros(len(edges), np.int64)  # every row has a byte at least
        low, high = np.full(len(edges), np.iinfo(np.int64).max), np.full(len(edges), -1, np.int64)
        for batch in batches:
            key, weight = batch["key"].to_numpy(), batch["size"].to_numpy()
            cell = np.searchsorted(edges, key, "right") - 1
            inside = cell >= 0
            key, weight, cell = key[inside], weight[inside], cell[inside]
            np.add.at(size, cell, weight)
            np.minimum.at(low, cell, key)
            np.maximum.at(high, cell, key)
        seen = np.flatnonzero(size)
        yield pd.DataFrame({"cell": seen, "size": size[seen], "low": low[seen], "high": high[seen]})

    counted = measured.select("key", "size").mapInPandas(count, "cell long, size long, low long, high long")
    summed = counted.groupBy("cell").agg(F.sum("size").alias("size"), F.min("low").alias("low"), F.max("high").alias("high"))
    return summed.toPandas().sort_values("cell", ignore_index=True)  # one row per probe at most


def find_splitters(measured: DataFrame, shards: int, blocks: int, tolerance: float = 0.0) -> list[int]:
    """``shards * blocks - 1`` keys; a row belongs to the block with as many keys not above its own.

    `tolerance` is the distance, as a part of a shard, at which the border of a shard is
    near enough; with 0 each border is exact to the key: a key's rows are on the side
    where the middle of their bytes lies.
    """
    parts = shards * blocks
    top = 1 << (TEXT_BITS + ROW_BITS)
    cuts: dict[int, int] = {}
    intervals, steps, total = [(0, top - 1, 0)], PROBES, None  # lowest key, highest key, bytes below
    while intervals:
        probes: list[int] = []
        owner: list[int] = []
        for which, (low, high, _) in enumerate(intervals):
            inner = sorted({low + (high - low + 1) * j // steps for j in range(steps)})
            end = [high + 1] if high + 1 < top else []  # what lies between intervals is nobody's
            probes, owner = probes + inner + end, owner + [which] * len(inner) + [-1] * len(end)
        cells, running = [], [below for _, _, below in intervals]
        for at, size, low, high in count_cells(measured, probes).itertuples(index=False):
            if owner[at] >= 0:
                cells.append((running[owner[at]], int(size), int(low), int(high)))
                running[owner[at]] += int(size)
        if total is None:
            total = running[0]
        begins = [below * parts for below, *_ in cells]
        intervals, steps = [], REFINED
        for i in range(1, parts):
            if i in cuts:
                continue
            if not cells:
                cuts[i] = 0
                continue
            # All counts are integers: bytes are compared as multiples of 1 / parts.
            target = total * i
            below, size, low, high = cells[bisect_right(begins, target) - 1]
            near = total * blocks * tolerance if i % blocks == 0 else total * BLOCK_TOLERANCE
            if low == high:
                cuts[i] = low if (2 * below + size) * parts >= 2 * target else low + 1
            elif target - below * parts <= near:
                cuts[i] = low
            elif (below + size) * parts - target <= near:
                cuts[i] = high + 1
            elif not intervals or intervals[-1] != (low, high, below):
                intervals.append((low, high, below))
    # The borders of blocks stay between the exact borders of their shard.
    borders = [0, *[cuts[s * blocks] for s in range(1, shards)], top]
    return [
        cuts[i] if i % blocks == 0 else min(max(cuts[i], borders[i // blocks]), borders[i // blocks + 1])
        for i in range(1, parts)
    ]


def block_of(splitters: list[int]):
    edges = np.array(splitters, dtype=np.int64)

    @F.pandas_udf("int")
    def block(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, key.to_numpy(), "right").astype(np.int32))

    return block


def place(rows: DataFrame, measured: DataFrame, shards: int, tolerance: float, order: list[str]) -> DataFrame:
    """`rows` (with a column ``key``) plus ``shard`` and ``slot``; the one exchange is here.

    `order` names further columns that settle the order of rows with equal keys.
    """
    spark = rows.sparkSession
    blocks = max(1, math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / shards))
    splitters = find_splitters(measured, shards, blocks, tolerance)
    block = block_of(splitters)
    counted = dict(measured.groupBy(block("key").alias("block")).count().collect())  # one row per block
    starts = []
    for shard in range(shards):
        sizes = [counted.get(shard * blocks + b, 0) for b in range(blocks)]
        starts += [(shard * blocks + b, shard, sum(sizes[:b])) for b in range(blocks)]
    before = spark.createDataFrame(starts, "_block int, shard int, _before long")  # one row per block
    exchanged = rows.withColumn("_block", block("key")).repartitionById(shards * blocks, F.col("_block"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy("key", *order))
    numbered = exchanged.withColumn("_in_block", inside).join(F.broadcast(before), "_block", "left")
    return numbered.withColumn("slot", F.col("_before") + F.col("_in_block") - 1).drop("_block", "_before", "_in_block")


def shard_sizes(docs: DataFrame, shards: int = 8, tolerance: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document."""
    measured = stored(measure(docs), "shard-sizes")
    placed = place(measured, measured, shards, tolerance, ["doc_id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 8, tolerance: float = 0.0) -> DataFrame:
    """The documents with ``shard`` and ``slot``, in slot order inside each block of a shard."""
    measured = stored(docs.select(byte_size("text").alias("size"), order_key("doc_id", "text").alias("key")), "shard-sizes")
    rows = docs.select(whole(docs), order_key("doc_id", "text").alias("key"), F.col("doc_id").alias("_id"))
    placed = place(rows, measured, shards, tolerance, ["_id"])
    return unpacked(placed, shard=F.col("shard"), slot=F.col("slot"))
