"""Mergeable sketches of a corpus: numbers of distinct tokens and counts of single tokens.

A sketch is one row per part of the corpus: the number of tokens, the registers of a
distinct count (hashes dealt by their first bits, the most leading zeros of the rest) and the
counters of a count-min sketch.  Registers of two parts merge by their maxima and counters by
their sums, so any union of parts is answered from the stored rows without reading a text
again.  Both arrays hold only cells that are not zero, sorted; their number is bounded by the
sizes chosen, however large the corpus is.

Hashes come from md5, so the same numbers come out in any engine.  A null token counts as a
token of its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.layout import generate

REST_BITS = 48  # of a hash, counted for leading zeros
WORDS_PER_DIGEST = 4


@dataclass(frozen=True)
class Sizes:
    """2**bits registers, and `depth` rows of `width` counters."""

    bits: int = 12
    width: int = 2719
    depth: int = 5
    seed: int = 0

    @staticmethod
    def of(rsd: float, eps: float, delta: float, seed: int = 0) -> Sizes:
        """For a relative error `rsd` of distinct counts, and single counts that exceed the exact
        ones by more than `eps` times all tokens with a probability of at most `delta`."""
        bits = max(4, math.ceil(2 * math.log2(1.04 / rsd)))
        return Sizes(bits, math.ceil(math.e / eps), math.ceil(math.log(1 / delta)), seed)


def _number(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def _digest(token: Column, salt: str) -> Column:
    return F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(token, F.lit("\u0000"))))


def register(token: Column, sizes: Sizes) -> Column:
    """(cell, value): the register of a token and its rank, the leading zeros of the rest plus one."""
    digest = _digest(token, f"d{sizes.seed}")
    rest = _number(digest, 5, REST_BITS // 4)
    rank = REST_BITS + 1 - F.when(rest == 0, F.lit(0)).otherwise(F.length(F.bin(rest)))
    return F.struct((_number(digest, 1, 4) % (1 << sizes.bits)).cast("int").alias("cell"), rank.cast("long").alias("value"))


def counters(token: Column, sizes: Sizes) -> Column:
    """The token's cells, one in each row of the count-min sketch."""
    digests = [_digest(token, f"c{sizes.seed}.{i}") for i in range(-(-sizes.depth // WORDS_PER_DIGEST))]
    hashes = [_number(digests[r // WORDS_PER_DIGEST], 8 * (r % WORDS_PER_DIGEST) + 1, 8) for r in range(sizes.depth)]
    return F.array(*[(h % sizes.width + r * sizes.width).cast("int") for r, h in enumerate(hashes)])


def corpus_sketches(corpus: DataFrame, part: Column, sizes: Sizes = Sizes()) -> DataFrame:
    """``(part, n, registers, counters)``: one row for each value of `part`, from one pass.

    Tokens are counted per part first, so each distinct one is hashed once.
    """
    tokens = generate(corpus.select(part.alias("part"), "tokens"), ["part"], F.posexplode_outer("tokens"), "pos", "token")
    freqs = tokens.groupBy("part", "token").agg(F.count("*").alias("freq"))
    found, cells = register(F.col("token"), sizes), counters(F.col("token"), sizes)
    added = F.transform(cells, lambda c: F.struct(F.lit(False).alias("distinct"), c.alias("cell"), F.col("freq").alias("value")))
    seen = F.array(F.struct(F.lit(True).alias("distinct"), found["cell"].alias("cell"), found["value"].alias("value")))
    return _packed(freqs.select("part", F.inline(F.concat(seen, added))), sizes)


def merge_sketches(sketches: DataFrame, into: Column | None = None, sizes: Sizes = Sizes()) -> DataFrame:
    """The sketches of unions of parts, `into` naming the union of each row (by default one of all)."""
    named = sketches.select((F.lit("all") if into is None else into).alias("part"), "registers", "counters")
    labelled = F.concat(
        F.transform("registers", lambda c: F.struct(F.lit(True).alias("distinct"), c["cell"].alias("cell"), c["value"].alias("value"))),
        F.transform("counters", lambda c: F.struct(F.lit(False).alias("distinct"), c["cell"].alias("cell"), c["value"].alias("value"))),
    )
    return _packed(named.select("part", F.inline(labelled)), sizes)


def _packed(cells: DataFrame, sizes: Sizes) -> DataFrame:
    """Cells of registers by their maxima, of counters by their sums; every token is in the first row of counters once."""
    value = F.when(F.col("distinct"), F.max("value")).otherwise(F.sum("value")).alias("value")
    merged = cells.groupBy("part", "distinct", "cell").agg(value)
    listed = lambda which: F.sort_array(F.collect_list(F.when(which, F.struct("cell", "value"))))
    n = F.sum(F.when(~F.col("distinct") & (F.col("cell") < sizes.width), F.col("value")))
    return merged.groupBy("part").agg(
        F.coalesce(n, F.lit(0)).alias("n"), listed(F.col("distinct")).alias("registers"), listed(~F.col("distinct")).alias("counters")
    )


def distinct_estimate(registers: Column, sizes: Sizes = Sizes()) -> Column:
    """The estimated number of distinct tokens; small numbers are read from the empty registers."""
    m = 1 << sizes.bits
    alpha = {4: 0.673, 5: 0.697, 6: 0.709}.get(sizes.bits, 0.7213 / (1 + 1.079 / m))
    empty = F.lit(m) - F.size(registers)
    harmonic = F.aggregate(registers, empty.cast("double"), lambda total, r: total + F.pow(F.lit(2.0), -r["value"]))
    raw = F.lit(alpha * m * m) / harmonic
    return F.when((raw <= 2.5 * m) & (empty > 0), m * F.log(F.lit(float(m)) / empty)).otherwise(raw)


def count_estimates(words: DataFrame, sketch: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """`words` (token, ...) with ``estimate``, at least the token's count in the one part of `sketch`.

    The counters number at most depth * width, so they are broadcast.
    """
    held = F.broadcast(sketch.select(F.inline("counters")).toDF("_cell", "_value"))
    asked = words.withColumn("_cell", F.explode(counters(F.col("token"), sizes)))
    met = asked.join(held, "_cell", "left")
    return met.groupBy(*words.columns).agg(F.min(F.coalesce("_value", F.lit(0))).alias("estimate"))
