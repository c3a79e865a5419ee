import math

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import sketches as SK
from corpuslens.operators import vocabulary as V

SIZES = SK.Sizes.of(rsd=0.02, eps=0.01, delta=0.02, seed=3)


@pytest.fixture(scope="module")
def parts(spark, corpus):
    return SK.corpus_sketches(corpus, F.col("doc_id") % 4, SIZES).cache()


def only(df):
    (row,) = df.collect()
    return row.n, [tuple(c) for c in row.registers], [tuple(c) for c in row.counters]


def test_merged_is_the_whole(spark, corpus, parts):
    whole = SK.corpus_sketches(corpus, F.lit("all"), SIZES)
    assert only(SK.merge_sketches(parts, sizes=SIZES)) == only(whole)
    halves = SK.merge_sketches(parts, F.col("part") % 2, SIZES)
    assert halves.count() == 2
    assert only(SK.merge_sketches(halves, sizes=SIZES)) == only(whole)


def test_counts_are_never_low_and_seldom_high(spark, corpus, parts):
    freqs = V.word_frequencies(corpus)
    rows = SK.count_estimates(freqs, SK.merge_sketches(parts, sizes=SIZES), SIZES).collect()
    total = sum(r.freq for r in rows)
    assert all(r.estimate >= r.freq for r in rows)
    assert sum(r.estimate - r.freq > 0.01 * total for r in rows) <= 0.02 * len(rows)
    unknown = spark.createDataFrame([("neverseen",)], "token string")
    assert SK.count_estimates(unknown, SK.merge_sketches(parts, sizes=SIZES), SIZES).first().estimate <= 0.01 * total


@pytest.mark.parametrize("count", [0, 1, 50, 3000, 40_000])
def test_distinct_estimates(spark, count):
    words = spark.range(max(count, 1)).select(F.col("id").alias("doc_id"), F.array(F.concat(F.lit("w"), "id")).alias("tokens"))
    words = words.where(F.lit(count > 0))
    sizes = SK.Sizes(bits=10, width=8, depth=1)
    merged = SK.merge_sketches(SK.corpus_sketches(words, F.col("doc_id") % 7, sizes), sizes=sizes)
    found = merged.select(SK.distinct_estimate(F.col("registers"), sizes)).collect()
    assert found == [] if count == 0 else abs(found[0][0] / count - 1) < 4 * 1.04 / math.sqrt(1 << 10)


def test_stats(spark, corpus):
    found = V.approximate_stats(corpus).first()
    exact = V.word_frequencies(corpus)
    assert found.total_words == exact.agg(F.sum("freq")).first()[0]
    assert abs(found.approx_unique_words - exact.count()) <= 2
    empty = V.approximate_stats(corpus.limit(0)).first()
    assert (empty.approx_unique_words, empty.total_words) == (0, 0)


def test_null_tokens_and_hot_parts(spark):
    rows = [(i, ["the", None] * 20) for i in range(300)] + [(1000, ["rare"]), (1001, None), (1002, [])]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>").withColumn("part", F.when(F.col("doc_id") < 300, "hot"))
    merged = SK.merge_sketches(SK.corpus_sketches(df, F.col("part"), SIZES), sizes=SIZES)
    assert merged.first().n == 12_001
    asked = spark.createDataFrame([("the",), (None,), ("rare",)], "token string")
    assert {r.token: r.estimate for r in SK.count_estimates(asked, merged, SIZES).collect()} == {"the": 6000, None: 6000, "rare": 1}
