from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import random_index as RI


def shares(rows):
    units = Counter()
    for r in rows:
        units[r.id] += r.own
        units[r.alias] += r.total - r.own
        assert 0 <= r.own <= r.total
    return units


@pytest.mark.parametrize(
    "freqs",
    [[5], [1, 1, 1], [1, 2, 3, 4], [1000, 1, 1, 1, 1], [1, 1, 1, 1, 1000], [3, 1, 50, 2, 50, 1, 7, 7, 9, 1, 1], [6, 2, 4, 4, 4], list(range(1, 200))],
)
def test_every_id_has_its_exact_share(spark, freqs):
    vocab = spark.createDataFrame(list(enumerate(freqs)), "id long, freq long")
    rows = RI.alias_table(vocab).collect()
    assert sorted(r.id for r in rows) == list(range(len(freqs)))
    assert shares(rows) == Counter({i: f * len(freqs) for i, f in enumerate(freqs)})


def test_draws_follow_the_frequencies(spark):
    freqs = [700, 200, 60, 30, 9, 1]
    vocab = spark.createDataFrame(list(enumerate(freqs)), "id long, freq long")
    targets = spark.range(20_000).select("id", F.lit(0).cast("long").alias("target"))
    drawn = RI.negative_samples(targets, vocab, 2, "id", exclude_hits=False, seed=3)
    rows = drawn.groupBy("sample", "p").count().collect()
    assert {r.sample: r.p for r in rows} == {i: f / 1000 for i, f in enumerate(freqs)}
    for r in rows:
        want = 40_000 * r.p
        assert abs(r["count"] - want) < 5 * want**0.5
    assert RI.negative_samples(targets, vocab, 2, "id", seed=3).where("sample = 0").count() == 0
