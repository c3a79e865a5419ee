"""Mixing sources to target weights by hash thresholds, without sorting documents.

Every document has a pseudo-random 60-bit key.  A source that shall give fewer words
than it has gives the documents below a threshold; one that shall give more gives every
document once and those below the threshold once more.  Budgets are nested: a larger
budget keeps all that a smaller one kept.

The threshold is found from histograms.  One pass sums words by source and hash bucket;
per source the bucket in which the running sum passes the budget is the only one that is
looked into again, with finer buckets, until it holds a single key.  Each pass shuffles at
most ``2**BUCKET_BITS`` partial sums per source and task, whatever the number of
documents, so a source with a third of all rows costs no more than another.

Rows: a null text has no words; a null source is a source of its own, ranked last; rows
that agree in id and text have one key and are taken together; an empty table gives an
empty mix.  The per-source tables have one row per source; joins with them broadcast only
below the session's threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import WORD_RULE, hash_key, stored, unpacked, whole

KEY_BITS = 60
BUCKET_BITS = 12


def word_count(text: Column | str) -> Column:
    """Number of runs of characters other than ASCII white space, 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RULE)), F.lit(0)).cast("long")


def measure(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, key) of every document; the only scan of the texts."""
    return docs.select("doc_id", "source", word_count("text").alias("size"), hash_key(seed, "doc_id", "text").alias("key"))


def targets(sizes: DataFrame, weights: Sequence[int], share: float, limit: float) -> DataFrame:
    """`sizes` (source, source_size) with `target`.

    Sources by code point, null last, take `weights` in turn and share `share` times all
    words; a target stops at `limit` times its source, the excess goes to the others by
    weight.  With sources ordered by limit per weight, the level at which all water is
    poured is the largest of the levels that assume the first k sources to be full.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.select(
        "source", "source_size", F.element_at(turn, (rank - 1) % len(weights) + 1).alias("_weight"), rank.alias("_rank")
    ).withColumn("_full", F.col("source_size") * F.lit(limit))
    by_need = Window.orderBy(F.col("_full") / F.col("_weight"), "_rank")
    full = F.coalesce(F.sum("_full").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_weight").over(by_need.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything) * F.lit(share)
    level = F.max("_level").over(everything)
    return weighed.withColumn("_level", (budget - full) / left).select(
        "source", "source_size", F.least(F.col("_full"), level * F.col("_weight")).alias("target")
    )


def mixture(measured: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, source_size, target, passes, threshold): a document is taken `passes` times,
    and once more where its key is below `threshold`."""
    sizes = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = stored(
        targets(sizes, weights, share, limit)
        .withColumn("passes", passes)
        .withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size")),
        "mix-targets",
    )
    cuts = thresholds(measured, plan.where("budget > 0").select("source", "budget"))
    found = plan.alias("p").join(cuts.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left")
    return stored(
        found.select("p.source", "source_size", "target", "passes", F.coalesce("threshold", F.lit(0)).alias("threshold")),
        "mix-plan",
    )


def thresholds(measured: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): the words of keys below it come nearest to the source's budget."""
    state = budgets.select("source", "budget", F.lit(0.0).alias("below"), F.lit(0).cast("long").alias("bucket"))
    found, used = [], 0
    while used < KEY_BITS:
        step = min(BUCKET_BITS, KEY_BITS - used)
        inside = measured.alias("m").join(
            state.alias("s"),
            F.col("m.source").eqNullSafe(F.col("s.source")) & (F.shiftright(F.col("m.key"), KEY_BITS - used) == F.col("s.bucket")),
        )
        used += step
        histogram = inside.groupBy("s.source", "budget", "below", F.shiftright("m.key", KEY_BITS - used).alias("bucket")).agg(
            F.sum("m.size").alias("words"), F.min("m.key").alias("low"), F.max("m.key").alias("high")
        )
        # At most 2**BUCKET_BITS rows for each source.
        before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        boundary = histogram.withColumn("before", F.col("below") + F.coalesce(F.sum("words").over(before), F.lit(0))).where(
            (F.col("before") <= F.col("budget")) & (F.col("budget") < F.col("before") + F.col("words"))
        )
        boundary = stored(boundary, "mix-boundary")
        single = F.col("low") == F.col("high")
        taken = (F.col("budget") - F.col("before")) * 2 >= F.col("words")
        found.append(boundary.where(single).select("source", (F.col("low") + taken.cast("long")).alias("threshold")))
        state = boundary.where(~single).select("source", "budget", F.col("before").alias("below"), "bucket")
        if state.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def copies(key: Column) -> Column:
    """How often the mix takes a document, given the joined columns of its source's plan."""
    return F.col("passes") + (key < F.col("threshold")).cast("long")


def mix_sizes(docs: DataFrame, seed: int = 0, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, and the words taken of it."""
    measured = stored(measure(docs, seed), "mix-sizes")
    plan = mixture(measured, **options)
    rows = measured.alias("m").join(plan.alias("p"), F.col("m.source").eqNullSafe(F.col("p.source")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("m.key"))).alias("taken"))


def mix(docs: DataFrame, seed: int = 0, **options) -> DataFrame:
    """The documents of the mix, with their own columns, repeated as often as they are taken."""
    plan = mixture(stored(measure(docs, seed), "mix-sizes"), **options)
    keyed = docs.select(whole(docs), hash_key(seed, "doc_id", "text").alias("_key"))
    rows = keyed.join(plan, F.col("_doc.source").eqNullSafe(plan["source"]))
    times = F.explode(F.array_repeat(F.lit(0), copies(F.col("_key")).cast("int")))
    return unpacked(rows.select("_doc", times.alias("_copy")))
