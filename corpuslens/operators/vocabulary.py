"""Vocabulary and frequency tables.

Two shapes flow through this module: a corpus ``(doc_id, tokens ARRAY<STRING>)``
and a frequency table ``(token, freq)``; a vocabulary is a frequency table with a
dense ``id``.  Counting always starts with Spark's map-side partial aggregation,
so a token holding a third of the corpus costs one partial row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import hashing, words
from corpuslens.operators import sequences, sketches
from corpuslens.operators.layout import generate
from corpuslens.operators.lookup import hot_rows, lookup
from corpuslens.operators.ordering import ordered_index, take

UNK = "<unk>"
MISSING = ("null", "drop", "unk", "error")


def token_stream(corpus: DataFrame) -> DataFrame:
    """``(doc_id, pos, token)``, one row per token."""
    return generate(corpus, ["doc_id"], F.posexplode_outer("tokens"), "pos", "token")


def word_frequencies(corpus: DataFrame) -> DataFrame:
    """Occurrences of each token."""
    return tokens_only(corpus).groupBy("token").agg(F.count("*").alias("freq"))


def tokens_only(corpus: DataFrame) -> DataFrame:
    return generate(corpus, [], F.posexplode_outer("tokens"), "pos", "token").select("token")


def merge_frequencies(*tables: DataFrame) -> DataFrame:
    """Sum of several frequency tables."""
    return reduce(DataFrame.unionByName, tables).groupBy("token").agg(F.sum("freq").alias("freq"))


def most_common(freqs: DataFrame, k: int) -> DataFrame:
    """The k most frequent tokens; equal counts are ordered by token."""
    return take(freqs, k, F.desc("freq"), F.col("token"))


def least_common(freqs: DataFrame, k: int) -> DataFrame:
    return take(freqs, k, F.col("freq"), F.desc("token"))


def build_vocabulary(freqs: DataFrame, by: str = "freq") -> DataFrame:
    """Dense ids from 0, by falling frequency (`by="freq"`) or by token (`by="token"`)."""
    if by not in ("freq", "token"):
        raise ValueError("by must be 'freq' or 'token'")
    order = [F.desc("freq"), F.col("token")] if by == "freq" else [F.col("token")]
    return ordered_index(freqs, *order, name="id")


def limit_vocabulary(freqs: DataFrame, limit: int, unk: str = UNK, strict_limit: bool = False) -> DataFrame:
    """The `limit` most frequent tokens and one row holding the counts of all others.

    With `strict_limit` the table is cut to `limit` rows again afterwards, which may
    drop the rarest kept token together with its count.
    """
    top = most_common(freqs, limit)
    rest = freqs.agg(
        (F.sum("freq") - F.coalesce(top.agg(F.sum("freq")).scalar(), F.lit(0))).alias("freq")
    ).where("freq > 0").select(F.lit(unk).alias("token"), "freq")
    table = merge_frequencies(top, rest)
    return most_common(table, limit) if strict_limit else table


def replace_oov(corpus: DataFrame, vocab: DataFrame, unk: str = UNK) -> DataFrame:
    """Tokens missing from `vocab` become `unk`; sentences keep their order."""
    known = vocab.select("token", "freq", F.lit(True).alias("known"))
    found = lookup(token_stream(corpus), known.select("token", "known"), "token", hot_rows(known), ["doc_id", "pos"])
    kept = found.withColumn("token", F.when(F.col("known"), F.col("token")).otherwise(unk))
    return regroup(kept, "token", "tokens", corpus)


def regroup(rows: DataFrame, value: str, name: str, corpus: DataFrame) -> DataFrame:
    """Token-level rows back to one array per document (a document fits one row).

    Documents without rows come back with an empty array.
    """
    arrays = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", value))).alias("_t"))
    empty = F.array().cast(f"array<{dict(rows.dtypes)[value]}>")
    return corpus.select("doc_id").join(arrays, "doc_id", "left").select(
        "doc_id", F.coalesce(F.transform("_t", lambda t: t[value]), empty).alias(name)
    )


def frequency_cut(freqs: DataFrame, threshold: int) -> DataFrame:
    """Tokens with at least `threshold` occurrences."""
    return freqs.where(F.col("freq") >= threshold)


def frequency_cut_report(freqs: DataFrame, thresholds: list[int]) -> DataFrame:
    """Survivors and total of several cuts, computed in one pass."""
    counts = [F.count(F.when(F.col("freq") >= t, 1)).alias(f"c{t}") for t in thresholds]
    pairs = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"c{t}").alias("survivors")) for t in thresholds])
    return freqs.agg(F.count("*").alias("total"), *counts).select(F.inline(pairs), "total")


def corpus_stats(corpus: DataFrame, k: int = 10) -> DataFrame:
    """Sentences, words, distinct words, and the k most and least frequent words."""
    freqs = word_frequencies(corpus)
    sentences = corpus.agg(F.count("*").alias("value")).select(
        F.lit("sentences").alias("stat"), F.lit("").alias("token"), "value"
    )
    sizes = freqs.agg(F.sum("freq").alias("w"), F.count("*").alias("u")).select(
        F.inline(
            F.array(
                F.struct(F.lit("total_words").alias("stat"), F.lit("").alias("token"), F.col("w").alias("value")),
                F.struct(F.lit("unique_words").alias("stat"), F.lit("").alias("token"), F.col("u").alias("value")),
            )
        )
    )
    top = most_common(freqs, k).select(F.lit("top").alias("stat"), "token", F.col("freq").alias("value"))
    last = least_common(freqs, k).select(F.lit("last").alias("stat"), "token", F.col("freq").alias("value"))
    return sentences.unionByName(sizes).unionByName(top).unionByName(last)


def rank_frequency(freqs: DataFrame, top: int = 1000) -> DataFrame:
    """Rank, frequency and their decimal logarithms for the `top` most frequent tokens."""
    rank = F.row_number().over(Window.orderBy(F.desc("freq"), F.col("token"))).cast("long")  # over `top` rows
    ranked = most_common(freqs, top).withColumn("rank", rank)
    return ranked.select(
        "rank", "token", "freq", F.log10("rank").alias("log_rank"), F.log10("freq").alias("log_freq")
    )


def stopword_share(freqs: DataFrame) -> DataFrame:
    """Distinct tokens, occurrences and share of stop words and of other words."""
    total = freqs.agg(F.sum("freq")).scalar()
    return (
        freqs.groupBy(words.is_stopword("token").alias("stopword"))
        .agg(F.count("*").alias("tokens"), F.sum("freq").alias("freq"))
        .withColumn("share", F.col("freq") / total)
    )


def unigram_distribution(vocab: DataFrame) -> DataFrame:
    """Probability of each id."""
    total = vocab.agg(F.sum("freq")).scalar()
    return vocab.select("id", "token", (F.col("freq") / total).alias("p"))


def map_frequencies(vocab: DataFrame, freqs: DataFrame) -> DataFrame:
    """``(id, freq)``: frequencies looked up for an existing id table."""
    return vocab.select("id", "token").join(freqs, "token").select("id", "freq")


def encode_ids(
    corpus: DataFrame, vocab: DataFrame, on_missing: str = "error", unk: str = UNK
) -> DataFrame:
    """Tokens to ids, one array per document in token order.

    Unknown tokens raise, become null, are dropped, or take the id of `unk`.
    """
    if on_missing not in MISSING:
        raise ValueError(f"on_missing must be one of {MISSING}")
    found = encode_stream(token_stream(corpus), vocab)
    if on_missing == "drop":
        found = found.where(F.col("id").isNotNull())
    elif on_missing == "unk":
        unk_id = vocab.where(F.col("token") == unk).agg(F.max("id")).scalar()
        found = found.withColumn("id", F.coalesce("id", unk_id))
    elif on_missing == "error":
        message = F.concat(F.lit("not in vocabulary: "), F.col("token"))
        found = found.withColumn("id", F.coalesce("id", F.raise_error(message).cast("long")))
    return regroup(found.select("doc_id", "pos", "id"), "id", "ids", corpus)


def encode_stream(stream: DataFrame, vocab: DataFrame) -> DataFrame:
    """Adds `id` (null when unknown) to token-level rows ``(doc_id, pos, token)``."""
    hot = hot_rows(vocab.select("token", "id", "freq")).select("token", "id")
    return lookup(stream, vocab.select("token", "id"), "token", hot, ["doc_id", "pos"])


def decode_ids(encoded: DataFrame, vocab: DataFrame) -> DataFrame:
    """Ids back to tokens, null where the id does not exist."""
    stream = generate(encoded, ["doc_id"], F.posexplode_outer("ids"), "pos", "key")
    stream = stream.withColumn("key", F.col("key").cast("string"))
    names = vocab.select(F.col("id").cast("string").alias("key"), "token", "freq")
    hot = hot_rows(names).select("key", "token")
    found = lookup(stream, names.select("key", "token"), "key", hot, ["doc_id", "pos"])
    return regroup(found, "token", "tokens", encoded)


def contains(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Rows of `tokens` whose token is in the vocabulary."""
    return tokens.join(vocab.select("token"), "token", "left_semi")


def oov_words(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Distinct tokens that the vocabulary does not know."""
    return tokens.select("token").distinct().join(vocab.select("token"), "token", "left_anti")


def coverage(corpus: DataFrame, vocab: DataFrame) -> DataFrame:
    """Known and total distinct tokens and occurrences of a corpus."""
    freqs = word_frequencies(corpus)
    known = vocab.select("token", F.lit(1).alias("hit"))
    joined = freqs.join(known, "token", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return joined.agg(
        F.sum("hit").alias("known_tokens"),
        F.count("*").alias("tokens"),
        F.sum(F.col("hit") * F.col("freq")).alias("known_words"),
        F.sum("freq").alias("words"),
    ).withColumn("share", F.col("known_words") / F.col("words"))


def new_signs(vocab: DataFrame, new: DataFrame) -> DataFrame:
    """``(token, id)`` for tokens the vocabulary lacks, with ids after its highest one."""
    fresh = ordered_index(oov_words(new, vocab), "token", name="_n")
    last = F.coalesce(vocab.agg(F.max("id")).scalar(), F.lit(-1))
    return fresh.select("token", (last + 1 + F.col("_n")).cast("long").alias("id"))


def add_signs(vocab: DataFrame, new: DataFrame) -> DataFrame:
    """Adds unknown tokens; old ids stay, and adding twice changes nothing."""
    return vocab.select("token", "id").unionByName(new_signs(vocab, new))


def remove_signs(vocab: DataFrame, gone: DataFrame) -> DataFrame:
    """Drops tokens; the ids of the others do not change."""
    return vocab.join(gone.select("token").distinct(), "token", "left_anti")


def drop_probability(freq: Column, total: Column, threshold: float) -> Column:
    """0 for rare tokens, else 1 - sqrt(threshold * total / freq)."""
    cut = F.lit(threshold) * total
    return F.when(freq < cut, F.lit(0.0)).otherwise(1 - F.sqrt(cut / freq))


def subsample(corpus: DataFrame, freqs: DataFrame, threshold: float = 1e-4, seed: int = 0) -> DataFrame:
    """Drops occurrences of frequent tokens at random, the same ones for the same seed.

    The kept rows are decided from (seed, doc_id, pos) alone, so the result does not
    depend on partitioning.
    """
    total = freqs.agg(F.sum("freq")).scalar()
    drop = freqs.select("token", "freq", drop_probability(F.col("freq"), total, threshold).alias("_drop"))
    frequent = drop.where("_drop > 0")  # other tokens are always kept
    found = lookup(
        token_stream(corpus), frequent.select("token", "_drop"), "token",
        hot_rows(drop).where("_drop > 0").select("token", "_drop"), ["doc_id", "pos"],
    )
    chance = hashing.uniform(seed, F.col("doc_id"), F.col("pos"))
    kept = found.where(F.col("_drop").isNull() | (chance >= F.col("_drop")))
    return regroup(kept, "token", "tokens", corpus)


def split_corpus(df: DataFrame, *order: Column | str, train: float = 0.8) -> DataFrame:
    """Adds `split`: the first int(train*N) rows, then half of the rest, then the others."""
    n = df.count()
    n_train = int(train * n)
    numbers = sorted({n_train, n_train + (n - n_train) // 2})
    firsts = sequences.keys_at(df, F.lit(numbers).cast("array<bigint>"), *order)  # keys are sorted, rows stay in place
    keyed = df.withColumns({"_key": sequences.key(order), "_valid": F.get(firsts, F.lit(0)), "_test": F.get(firsts, F.lit(len(numbers) - 1))})
    before = lambda first: F.coalesce(F.col("_key") < F.col(first), F.lit(True))
    split = F.when(before("_valid"), "train").when(before("_test"), "valid").otherwise("test")
    return keyed.withColumn("split", split).drop("_key", "_valid", "_test")


def hash_split(df: DataFrame, key: str, train: float = 0.8, seed: int = 0) -> DataFrame:
    """Same shares, decided per row from a hash of its key: no order, no shuffle."""
    u = hashing.uniform(seed, F.col(key))
    split = F.when(u < train, "train").when(u < train + (1 - train) / 2, "valid").otherwise("test")
    return df.withColumn("split", split)


def approximate_stats(corpus: DataFrame, rsd: float = 0.01) -> DataFrame:
    """Approximate number of distinct tokens and exact number of occurrences in one pass."""
    sizes = sketches.Sizes.of(rsd, eps=1.0, delta=0.5)  # no single counts are asked for
    found = sketches.corpus_sketches(corpus, F.lit("all"), sizes)
    stats = found.agg(F.sum("n").alias("n"), F.flatten(F.collect_list("registers")).alias("r"))  # no or one row
    estimate = F.round(sketches.distinct_estimate(F.col("r"), sizes)).cast("long")
    return stats.select(estimate.alias("approx_unique_words"), F.coalesce("n", F.lit(0)).alias("total_words"))


def heavy_hitters(corpus: DataFrame, share: float = 0.005) -> DataFrame:
    """Tokens whose approximate share of all occurrences is at least `share`.

    Frequent items come from one sketching pass; their counts are exact, taken in a
    second pass over those few candidates (fewer than 2 / share of them).
    """
    stream = tokens_only(corpus)
    total = stream.agg(F.count("*")).scalar()
    found = stream.freqItems(["token"], share / 2).select(F.explode("token_freqItems").alias("token"))
    counts = stream.join(F.broadcast(found), "token", "left_semi").groupBy("token").agg(F.count("*").alias("freq"))
    return counts.where(F.col("freq") >= share * total)
