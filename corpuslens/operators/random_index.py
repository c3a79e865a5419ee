"""Random indexes as tables: index, sparse rows, permutations, noise and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import hashing
from corpuslens.functions import random_index as R
from corpuslens.functions.bijection import Bijection
from corpuslens.operators.layout import generate, place
from corpuslens.operators.lookup import hot_rows, lookup
from corpuslens.operators.ordering import neighbours_by_kind, running_total


def index_signs(signs: DataFrame, k: int, s: int, seed: int = 0, symmetric: bool = True) -> DataFrame:
    """Adds `ri` to a table of distinct signs.

    A small distinct result may sit in one partition while each vector costs many
    hashes, so the signs are spread over all cores first.
    """
    hashed = place(signs, "sign").withColumn("_p", R.active_positions(F.col("sign"), k, s, seed))
    return hashed.withColumn("ri", R.from_positions(F.col("_p"), k, symmetric)).drop("_p")


def to_coo(df: DataFrame, row: str, ri: str = "ri", all_positive: bool = False) -> DataFrame:
    """``(row, idx, v)``: one row per non-zero cell."""
    cells = generate(df, [F.col(row).alias("row")], F.inline_outer(R.sorted_cells(F.col(ri))), "idx", "v")
    value = F.abs("v") if all_positive else F.col("v")
    return cells.select("row", "idx", value.cast("float").alias("v"))


def gather(coo: DataFrame, rows: DataFrame) -> DataFrame:
    """Cells of the wanted rows: ``(pos, row, idx, v)`` for each ``(pos, row)``.

    A row's cells travel as one array; rows that are wanted very often do not meet in one task.
    """
    cells = coo.groupBy(F.col("row").cast("string").alias("key")).agg(F.collect_list(F.struct("idx", "v")).alias("cells"))
    wanted = rows.withColumn("key", F.col("row").cast("string"))
    counts = wanted.groupBy("key").agg(F.count("*").alias("freq"))
    hot = cells.join(hot_rows(counts), "key").select("key", "cells")
    return lookup(wanted, cells, "key", hot, ["pos"], how="inner").select("pos", "row", F.inline("cells"))


def sparse_add(*tables: DataFrame, keys: tuple[str, ...] = ("row",), value: str = "v") -> DataFrame:
    """Element-wise sum of sparse rows; cells that cancel out disappear."""
    stacked = reduce(DataFrame.unionByName, tables)
    return stacked.groupBy(*keys, "idx").agg(F.sum(value).alias(value)).where(F.col(value) != 0)


# -- permutations ------------------------------------------------------------------


def permutation(spark: SparkSession, k: int, seed: int = 0, times: int = 1) -> DataFrame:
    """``(i, src)``: position i takes its value from position src; k rows, each computed by itself.

    `times` gives a power of the permutation, negative ones of its inverse.
    """
    source = Bijection(k, seed).power(F.col("id"), times)
    return spark.range(k).select(F.col("id").cast("int").alias("i"), source.cast("int").alias("src"))


def inverse(perm: DataFrame) -> DataFrame:
    return perm.select(F.col("src").alias("i"), F.col("i").alias("src"))


def power(perm: DataFrame, n: int) -> DataFrame:
    """The permutation applied n times; negative n applies the inverse."""
    step = inverse(perm) if n < 0 else perm
    out = perm.select("i", F.col("i").alias("src"))
    for _ in range(abs(n)):
        out = out.join(F.broadcast(step.select(F.col("i").alias("src"), F.col("src").alias("_next"))), "src").select(
            "i", F.col("_next").alias("src")
        )
    return out


def permute(coo: DataFrame, perm: DataFrame) -> DataFrame:
    """out[i] = v[perm[i]] on sparse rows; `perm` has one row per vector position."""
    moved = F.broadcast(perm.select(F.col("src").alias("idx"), F.col("i").alias("_to")))
    return coo.join(moved, "idx").withColumn("idx", F.col("_to")).select(*coo.columns)


def permute_by(coo: DataFrame, bijection: Bijection, times: int = 1) -> DataFrame:
    """``permute`` without a table: a cell's new position is computed from its old one."""
    return coo.withColumn("idx", bijection.power(F.col("idx"), -times).cast("int"))


def shift_table(spark: SparkSession, k: int, seed: int, reach: int) -> DataFrame:
    """``(offset, idx, to)`` for offsets -reach..reach: (2*reach + 1) * k rows.

    A context token at distance d to the right is permuted d times, to the left with
    the inverse, so offset 0 leaves positions alone.
    """
    moved = Bijection(k, seed)
    steps = [
        F.struct(F.lit(d).alias("offset"), F.col("id").cast("int").alias("idx"), moved.power(F.col("id"), -d).cast("int").alias("to"))
        for d in range(-reach, reach + 1)
    ]
    return spark.range(k).select(F.inline(F.array(*steps)))


# -- noise and samples ----------------------------------------------------------------


def sparse_noise(rows: DataFrame, row: str, k: int, ratio: float, seed: int = 0, max_active: int | None = None) -> DataFrame:
    """Noise cells ``(row, idx, v)``: an even number of positions, half +1 and half -1."""
    active = int(k * ratio) // 2 * 2
    if max_active is not None:
        active = min(active, max_active)
    if active == 0:
        return rows.limit(0).select(F.col(row).alias("row"), F.lit(0).alias("idx"), F.lit(0.0).cast("float").alias("v"))
    ri = R.random_index(F.col(row).cast("string"), k, active, seed, salt="noise")
    return to_coo(rows.select(row, ri.alias("ri")), row)


def add_noise(coo: DataFrame, noise: DataFrame) -> DataFrame:
    """Additive noise; cells that cancel out are dropped."""
    return sparse_add(coo, noise)


def sample_random_indexes(rows: DataFrame, row: str, k: int, s: int, seed: int = 0) -> DataFrame:
    """One draw from the space of all random indexes per row; s is rounded down to even."""
    ri = R.random_index(F.col(row).cast("string"), k, s // 2 * 2, seed, salt="sample")
    return rows.withColumn("ri", ri)


def alias_table(vocab: DataFrame) -> DataFrame:
    """``(id, freq, own, alias, total)``: one slot per id of dense ids 0..n-1 with frequencies.

    A slot stands for `total` units, the sum of all frequencies; its own id has the first `own`
    of them and `alias` the rest, so that each id has freq * n units over all slots, exactly.

    Light ids (freq * n below total) lack units, heavy ones have units to spare.  With both laid
    out one behind the other, a light id is filled up by the heavy one on whose stretch its
    lack begins; a heavy id that is overdrawn at its stretch's end gets the missing units from
    the next one.  This is two running totals and two as-of matches, so no task goes through
    the whole vocabulary, and each of them holds a range of it.
    """
    n, total = vocab.agg(F.count("*"), F.sum("freq")).first()
    scaled = vocab.select("id", "freq", (F.col("freq") * n - total).alias("_spare"))
    light = running_total(scaled.where("_spare < 0").withColumn("_lack", -F.col("_spare")), "id", value="_lack", name="_at")
    heavy = running_total(scaled.where("_spare >= 0"), "id", value="_spare", name="_at")
    light, heavy = (df.select("id", "freq", "_spare", "_at", F.lit(k).alias("_heavy")) for df, k in ((light, False), (heavy, True)))
    both = light.unionByName(heavy)
    # Heavy ids without anything to spare cover nothing, and stand behind their place in line.
    giving = F.col("_heavy") & (F.col("_spare") > 0)
    met = neighbours_by_kind(both, "_at", giving, F.struct("id", "_at"))
    lights = met.where(~F.col("_heavy")).select("id", "freq", (F.col("_spare") + total).alias("own"), F.col("before.id").alias("alias"))
    # The end of a heavy id's stretch, and the first light id that begins there or later.
    ends = met.where(giving).select("id", "freq", F.col("after.id").alias("_next"), (F.col("_at") + F.col("_spare")).alias("_at"))
    starts = light.select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("freq"), F.lit(None).cast("long").alias("_next"), "_at")
    begun = neighbours_by_kind(ends.unionByName(starts).withColumn("_start", F.col("id").isNull()), "_at", F.col("_start"), F.col("_at"))
    lack = F.sum("_lack")
    covered = light.select((-F.col("_spare")).alias("_lack")).agg(F.coalesce(lack, F.lit(0))).scalar()
    # A start exactly at the end comes first in the order, so it is `before`.
    boundary = F.when(F.col("before") == F.col("_at"), F.col("_at")).otherwise(F.coalesce("after", covered))
    over = boundary - F.col("_at")
    heavies = begun.where(~F.col("_start")).select(
        "id", "freq", (total - over).alias("own"), F.when(over > 0, F.col("_next")).otherwise(F.col("id")).alias("alias")
    )
    idle = met.where(F.col("_heavy") & (F.col("_spare") == 0)).select("id", "freq", F.lit(total).alias("own"), F.col("id").alias("alias"))
    return lights.unionByName(heavies).unionByName(idle).withColumn("total", F.lit(total))


def negative_samples(
    targets: DataFrame,
    vocab: DataFrame,
    n: int,
    *key: str,
    dist: str = "unigram",
    exclude_hits: bool = True,
    seed: int = 0,
) -> DataFrame:
    """n noise ids per example with their probability: ``(*key, target, draw, sample, p)``.

    `targets` has `key` columns and `target` ids.  Draws are uniform over the vocabulary, or
    follow the frequencies by an alias table: a uniform slot, joined by equality, and a uniform
    unit of it.  All slots are drawn alike, however skewed the frequencies are.
    """
    draws = targets.select(*key, "target", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    keys = [F.col(c) for c in key]
    chance = hashing.uniform(seed, *keys, F.col("draw"))
    size, total = vocab.agg(F.count("*"), F.sum("freq")).first()
    slot = F.floor(chance * size)
    if dist == "uniform":
        picked = draws.withColumn("sample", slot).withColumn("p", F.lit(1.0) / size)
    elif dist == "unigram":
        table = alias_table(vocab)
        owned = table.select(F.col("id").alias("_slot"), "own", "alias", "freq")
        other = table.select(F.col("id").alias("alias"), F.col("freq").alias("_alias_freq"))
        slots = owned.join(other, "alias")  # aliases are ids of the table
        unit = F.floor(hashing.uniform(seed, *keys, F.col("draw"), F.lit("unit")) * total)
        drawn = draws.withColumns({"_slot": slot, "_unit": unit}).join(slots, "_slot")
        own = F.col("_unit") < F.col("own")
        picked = drawn.select(
            *key, "target", "draw",
            F.when(own, F.col("_slot")).otherwise(F.col("alias")).alias("sample"),
            (F.when(own, F.col("freq")).otherwise(F.col("_alias_freq")) / total).alias("p"),
        )
    else:
        raise ValueError("dist must be 'uniform' or 'unigram'")
    return picked.where(F.col("sample") != F.col("target")) if exclude_hits else picked
