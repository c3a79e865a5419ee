"""Helpers shared by the pipeline operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.session import scratch_path

WORD_RULE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """`df` written once to the shared folder and read back.

    Cuts the lineage, survives lost executors, and gives the planner the true size,
    so that later joins broadcast it only when it is below the session's threshold.
    """
    return stored_at(df, label, **options)[0]


def stored_at(df: DataFrame, label: str, **options: str) -> tuple[DataFrame, str]:
    """As ``stored``, with the path, for tables that are removed once nothing reads them any more."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of ``stored_at``; what was derived from them must have been stored before."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def whole(df: DataFrame, name: str = "_doc") -> Column:
    """All columns of `df` as one struct, so that added columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def unpacked(df: DataFrame, name: str = "_doc", **added: Column) -> DataFrame:
    """The struct's columns again, plus `added` ones, which replace columns of the same name."""
    inner = df.schema[name].dataType.names
    lowered = {a.lower() for a in added}
    kept = [F.col(name)[c].alias(c) for c in inner if c.lower() not in lowered]
    return df.select(*kept, *[c.alias(a) for a, c in added.items()])


def hash_key(seed: int, *parts: Column | str) -> Column:
    """A 60-bit number from md5, the same in any SQL engine; null parts are skipped."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(p) if isinstance(p, str) else p for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def words_of(text: Column | str) -> Column:
    """Runs of characters other than ASCII white space, A-Z lower-cased; null for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD_RULE), F.lit(0))


def ascii_lower(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


PREFIX_BLOCK = 256


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def sums_before(numbers: Column) -> Column:
    """For each element the sum of those before it, in two levels so that long arrays stay cheap."""
    blocks = F.transform(
        F.sequence(F.lit(0), (F.size(numbers) / PREFIX_BLOCK).cast("int")),
        lambda b: _sum(F.slice(numbers, b * PREFIX_BLOCK + 1, PREFIX_BLOCK)),
    )
    return let(
        F.struct(numbers.alias("n"), blocks.alias("b")),
        lambda s: F.transform(
            s["n"],
            lambda _, i: _sum(F.slice(s["b"], 1, F.floor(i / PREFIX_BLOCK).cast("int")))
            + _sum(F.slice(s["n"], F.floor(i / PREFIX_BLOCK).cast("int") * PREFIX_BLOCK + 1, i % PREFIX_BLOCK)),
        ),
    )


PORTION_BYTES = 1 << 20


def portions(data: bytes, separator: re.Pattern, size: int = PORTION_BYTES) -> Iterator[bytes]:
    """`data` in slices of about `size` bytes, cut only where `separator` (one byte) matches.

    What a long text is split into then need not exist all at once.
    """
    start = 0
    while len(data) - start > size:
        found = separator.search(data, start + size)
        if not found:
            break
        yield data[start : found.start()]
        start = found.start()
    yield data[start:]
