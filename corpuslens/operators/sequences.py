"""Windows, n-grams, slices, repeats: order-dependent operators on token arrays.

Inside a document everything is an array expression (no shuffle, no self-join).
Across documents the order is (document, position): documents get the number of
tokens before them from a running total over one small row per document, and a
token's global position is that start plus its place in the array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.layout import generate, place
from corpuslens.operators.ordering import ordered_index, running_total

BLOCK_TOKENS = 8192


# -- inside one array ------------------------------------------------------------


def window_array(tokens: Column, size: int) -> Column:
    """One struct (left, target, right) per position, cut at the edges."""

    def window(token: Column, i: Column) -> Column:
        left = F.least(i, F.lit(size))
        return F.struct(
            F.slice(tokens, i - left + 1, left).alias("left"),
            token.alias("target"),
            F.slice(tokens, i + 2, size).alias("right"),
        )

    return F.transform(tokens, window)


def ngram_array(tokens: Column, n: int, item: str = "string") -> Column:
    """All contiguous n-grams, none when the array is shorter than n."""
    grams = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.slice(tokens, i, n))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast(f"array<array<{item}>>"))


def shifted_pairs(tokens: Column, distance: int) -> Column:
    """Structs (offset, target, context) for every position and its neighbour to the right."""
    count = F.greatest(F.size(tokens) - distance, F.lit(0))
    return F.zip_with(
        F.slice(tokens, F.lit(1), count),
        F.slice(tokens, F.lit(distance + 1), count),
        lambda a, b: F.struct(F.lit(distance).alias("offset"), a.alias("target"), b.alias("context")),
    )


def context_windows(corpus: DataFrame, size: int) -> DataFrame:
    """``(doc_id, pos, left, target, right)``, one row per token."""
    rows = generate(corpus, ["doc_id"], F.posexplode_outer(window_array(F.col("tokens"), size)), "pos", "w")
    return rows.select("doc_id", "pos", "w.left", "w.target", "w.right")


def context_pairs(corpus: DataFrame, size: int) -> DataFrame:
    """``(doc_id, target, context, offset)`` for all neighbours up to `size` away.

    Each neighbouring pair is generated once and then emitted in both directions.  Documents are
    placed by their key while they are compact, so that pairs can be grouped by it where they are.
    """
    tokens = F.col("tokens")
    ahead = F.flatten(F.array(*[shifted_pairs(tokens, d) for d in range(1, size + 1)]))
    one_way = generate(place(corpus.select("doc_id", "tokens"), "doc_id", growth=4), ["doc_id"], F.inline_outer(ahead), "offset", "target", "context")
    both = F.array(
        F.struct("target", "context", "offset"),
        F.struct(F.col("context").alias("target"), F.col("target").alias("context"), (-F.col("offset")).alias("offset")),
    )
    return one_way.select("doc_id", F.inline(both))


def ngrams(corpus: DataFrame, n: int) -> DataFrame:
    """``(doc_id, i, ngram)``: n-grams inside each sentence."""
    return generate(corpus, ["doc_id"], F.posexplode_outer(ngram_array(F.col("tokens"), n)), "i", "ngram")


def adjacent_pairs(corpus: DataFrame) -> DataFrame:
    """``(doc_id, i, first, second)``: each token with the next one."""
    return ngrams(corpus, 2).select(
        "doc_id", "i", F.col("ngram")[0].alias("first"), F.col("ngram")[1].alias("second")
    )


def ngram_counts(corpus: DataFrame, n: int) -> DataFrame:
    return ngrams(corpus, n).groupBy("ngram").agg(F.count("*").alias("freq"))


def context_target(grams: DataFrame, ngram: str = "ngram") -> DataFrame:
    """Splits n-grams into the first n-1 items and the last one."""
    gram = F.col(ngram)
    return grams.withColumns(
        {"context": F.slice(gram, F.lit(1), F.size(gram) - 1), "target": F.element_at(gram, -1)}
    ).drop(ngram)


def enumerate_within(df: DataFrame, count: str) -> DataFrame:
    """0..c-1 for each row with count c; no row when c is 0."""
    numbers = F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1))
    return df.select("*", F.explode(numbers).alias("i"))


# -- across documents ------------------------------------------------------------


def starts(corpus: DataFrame, *order: str, length: Column | None = None) -> DataFrame:
    """``(order keys, start)``: the number of items in all documents before each one.

    Only keys and lengths are sorted, never the arrays.
    """
    order = order or ("doc_id",)
    length = F.size("tokens") if length is None else length
    lengths = corpus.select(*order, length.cast("long").alias("_n"))
    return running_total(lengths, *order, value="_n", name="start").select(*order, "start")


def with_starts(corpus: DataFrame, *order: str) -> DataFrame:
    """Adds `start`, the global position of each document's first token."""
    order = order or ("doc_id",)
    return corpus.join(starts(corpus, *order), list(order))


def pieces(placed: DataFrame, first: Column, last: Column, lower, upper, items: str = "tokens") -> DataFrame:
    """Cuts placed arrays (with `start`) into parts of numbered global ranges.

    Range r covers the positions lower(r) <= p < upper(r); `first` and `last` bound
    the ranges a row can touch.  Gives ``(range, at, part)``.
    """
    begin, n = F.col("start"), F.size(items)

    def part(r: Column) -> Column:
        at, end = F.greatest(begin, lower(r)), F.least(begin + n, upper(r))
        length = F.greatest(end - at, F.lit(0)).cast("int")
        return F.struct(
            r.alias("range"), at.alias("at"), F.slice(items, (at - begin + 1).cast("int"), length).alias("part")
        )

    # cut inside the row: exploding range numbers would copy the whole array per range
    cut = F.when(n > 0, F.transform(F.sequence(first, last), part))
    return generate(placed, [], F.inline_outer(cut), "range", "at", "part").where(F.size("part") > 0)


def joined_parts(parts: DataFrame, *keys: str) -> DataFrame:
    """Parts of one range put together in order (a range has a bounded length)."""
    return parts.groupBy(*keys).agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda p: p["part"])).alias("tokens")
    )


def blocks(corpus: DataFrame, *order: str, size: int, overlap: int = 0) -> DataFrame:
    """The corpus as one sequence cut into `size` tokens, each followed by `overlap` more.

    Gives ``(range, tokens)`` where block r starts at global position r * size.
    """
    return blocks_placed(with_starts(corpus, *order), size, overlap)


def blocks_placed(placed: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """The same for a corpus that already carries `start`."""
    first = F.greatest(F.floor((F.col("start") - overlap) / size), F.lit(0))
    last = F.floor((F.col("start") + F.size("tokens") - 1) / size)
    parts = pieces(placed, first, last, lambda r: r * size, lambda r: (r + 1) * size + overlap)
    return joined_parts(parts, "range")


def ngrams_flat(corpus: DataFrame, n: int, *order: str, block: int = BLOCK_TOKENS) -> DataFrame:
    """``(idx, ngram)``: n-grams of the whole token sequence, across sentence ends."""
    return ngrams_flat_placed(with_starts(corpus, *order), n, block)


def ngrams_flat_placed(placed: DataFrame, n: int, block: int = BLOCK_TOKENS) -> DataFrame:
    """The same for a corpus that already carries `start`."""
    cut = blocks_placed(placed, block, n - 1)
    grams = generate(cut, ["range"], F.posexplode_outer(ngram_array(F.col("tokens"), n)), "i", "ngram")
    return grams.select((F.col("range") * block + F.col("i")).alias("idx"), "ngram")


# -- rows in order (see also ordering.take) --------------------------------------


def skip(df: DataFrame, n: int | None, *order: Column | str) -> DataFrame:
    """All rows but the first n in ascending `order`; None skips everything.

    Only keys are sorted; the rows stay where they are and are compared with one key.
    """
    if n is None:
        return df.limit(0)
    return df.where(key(order) >= key_at(df, n, *order))


def key(order: tuple[Column | str, ...]) -> Column:
    """The order columns as one comparable value."""
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"_k{i}") for i, c in enumerate(order)])


def key_at(df: DataFrame, n: int, *order: Column | str) -> Column:
    """The key of row number n in ascending `order`, null when there is none."""
    return F.get(keys_at(df, F.array(F.lit(n).cast("long")), *order), F.lit(0))


def keys_at(df: DataFrame, numbers: Column, *order: Column | str) -> Column:
    """The keys of the rows with these numbers, in order, as one array."""
    keys = ordered_index(df.select(key(order).alias("_key")), "_key", name="_idx")
    return keys.where(F.array_contains(numbers, F.col("_idx"))).agg(F.sort_array(F.collect_list("_key"))).scalar()


def row_range(df: DataFrame, start: int, stop: int, *order: Column | str) -> DataFrame:
    """Rows number start..stop-1 in `order`, with their number `idx`."""
    first, after = key_at(df, start, *order), key_at(df, stop, *order)
    inside = df.where((key(order) >= first) & F.coalesce(key(order) < after, F.lit(True)))
    return ordered_index(inside, *order, start=start)


def divide_slices(n: int, k: int = 1, offset: int = 0) -> list[range]:
    """k contiguous ranges of n // k numbers; the last one takes the remainder."""
    if k > n or k < 1:
        raise ValueError(f"cannot divide {n} elements into {k} slices")
    step = n // k
    return [range(offset + i * step, offset + (n if i == k - 1 else (i + 1) * step)) for i in range(k)]


def slice_number(idx: Column, n: Column | int, k: int) -> Column:
    """The slice a row number falls into; same bounds as ``divide_slices``."""
    n = F.lit(n) if isinstance(n, int) else n
    step = F.floor(n / k)
    checked = F.when(step > 0, step).otherwise(F.raise_error(F.lit("more slices than elements")).cast("long"))
    return F.least(F.floor(idx / checked), F.lit(k - 1))


def add_slices(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """Adds the slice number of each row when the table is divided into k ranges."""
    n = df.count()
    if k > n:
        raise ValueError("more slices than elements")
    firsts = keys_at(df, F.lit([r.start for r in divide_slices(n, k)][1:]).cast("array<bigint>"), *order)
    with_key = df.withColumns({"_key": key(order), "_firsts": firsts})
    begun = F.size(F.filter("_firsts", lambda first: first <= F.col("_key")))
    return with_key.withColumn("slice", begun.cast("long")).drop("_key", "_firsts")


def repeat_each(df: DataFrame, n: int) -> DataFrame:
    """Every row n times: 1,1,2,2; `copy` numbers the copies."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("copy")) if n > 0 else (
        df.limit(0).withColumn("copy", F.lit(0))
    )


def repeat_epochs(df: DataFrame, n: int) -> DataFrame:
    """The whole table n times: 1,2,1,2; `epoch` is the leading sort key."""
    return repeat_each(df, n).withColumnRenamed("copy", "epoch")


def chain(*dfs: DataFrame) -> DataFrame:
    """Tables one after the other; `source` is the leading sort key."""
    numbered = [df.withColumn("source", F.lit(i)) for i, df in enumerate(dfs)]
    return reduce(DataFrame.unionByName, numbered)
