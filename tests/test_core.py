import pytest
from pyspark.sql import functions as F

from corpuslens import session
from corpuslens.operators import vocabulary as V
from corpuslens.operators.lookup import hot_rows, lookup
from corpuslens.operators.ordering import ordered_index, running_total


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_order_does_not_depend_on_partitions(spark, parts):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 5).alias("v")).repartition(parts)
    numbered = ordered_index(rows, F.desc("k"), start=3).collect()
    assert sorted((r.k, r.idx) for r in numbered) == [(k, 1002 - k) for k in range(1000)]
    by_key = {r.k: r for r in running_total(rows, "k", value="v").collect()}
    total = 0
    for k in range(1000):
        assert by_key[k].start == total
        total += by_key[k].v


def test_order_of_nothing(spark):
    assert ordered_index(spark.range(0), "id").collect() == []
    assert running_total(spark.range(0).withColumn("v", F.lit(1)), "id", value="v").collect() == []


def test_lookup_with_hot_key(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("token"))
    table = rows.groupBy("token").agg(F.count("*").alias("freq")).where("token <> 'k1'")
    hot = hot_rows(table)
    assert [r.token for r in hot.collect()] == ["hot"]
    left = lookup(rows, table, "token", hot, ["id"])
    assert left.count() == 3000
    assert {r.token: r.freq for r in left.collect()}["hot"] == 1000
    assert left.where("freq is null").count() == 1
    assert lookup(rows, table, "token", hot, ["id"], how="inner").count() == 2999


def test_checkpoint_folder_comes_from_the_session(spark):
    folder = session.checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir() == folder
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")
    assert session.scratch_path(spark, "x").startswith(folder)


def freqs(spark, **counts):
    return spark.createDataFrame(list(counts.items()), "token string, freq long")


def pairs(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_vocabulary_ids(spark):
    table = freqs(spark, b=5, a=5, c=9, d=1)
    vocab = V.build_vocabulary(table)
    assert pairs(vocab, "token", "id") == {("c", 0), ("a", 1), ("b", 2), ("d", 3)}
    assert pairs(V.build_vocabulary(table, by="token"), "token", "id") == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    added = V.add_signs(vocab, freqs(spark, z=1, c=1, y=1))
    assert pairs(added, "token", "id") == pairs(vocab, "token", "id") | {("y", 4), ("z", 5)}
    assert pairs(V.add_signs(added, freqs(spark, z=1, y=2)), "token", "id") == pairs(added, "token", "id")
    left = V.remove_signs(added, freqs(spark, a=1, y=1))
    assert pairs(left, "token", "id") == {("c", 0), ("b", 2), ("d", 3), ("z", 5)}
    assert pairs(V.add_signs(left, freqs(spark, q=1)), "token", "id") - pairs(left, "token", "id") == {("q", 6)}


def test_limit_vocabulary(spark):
    table = freqs(spark, a=9, b=7, c=2, d=1)
    assert pairs(V.limit_vocabulary(table, 2, "U"), "token", "freq") == {("a", 9), ("b", 7), ("U", 3)}
    assert pairs(V.limit_vocabulary(table, 2, "U", strict_limit=True), "token", "freq") == {("a", 9), ("b", 7)}
    assert pairs(V.limit_vocabulary(table, 9, "U"), "token", "freq") == pairs(table, "token", "freq")


def test_encode_missing(spark):
    docs = spark.createDataFrame([(1, ["a", "x", "b"]), (2, [])], "doc_id long, tokens array<string>")
    vocab = V.build_vocabulary(freqs(spark, a=3, b=2, U=1))
    ids = lambda how: {r.doc_id: r.ids for r in V.encode_ids(docs, vocab, how, "U").collect()}
    assert ids("null") == {1: [0, None, 1], 2: []}
    assert ids("drop") == {1: [0, 1], 2: []}
    assert ids("unk") == {1: [0, 2, 1], 2: []}
    with pytest.raises(Exception, match="not in vocabulary: x"):
        ids("error")
    with pytest.raises(ValueError):
        V.encode_ids(docs, vocab, "other")
    encoded = spark.createDataFrame([(1, [1, 0, 77])], "doc_id long, ids array<long>")
    assert V.decode_ids(encoded, vocab).first().tokens == ["b", "a", None]


def test_subsample_is_repeatable_and_hits_the_frequent(spark, corpus):
    counts = V.word_frequencies(corpus)
    kept = V.subsample(corpus, counts, threshold=0.02, seed=3)
    again = V.subsample(corpus.repartition(7), counts, threshold=0.02, seed=3)
    assert {r.doc_id: r.tokens for r in kept.collect()} == {r.doc_id: r.tokens for r in again.collect()}
    before = {r.token: r.freq for r in counts.collect()}
    after = {r.token: r.freq for r in V.word_frequencies(kept).collect()}
    assert kept.count() == corpus.count()
    assert after["the"] < before["the"] / 2
    total = sum(before.values())
    assert all(after[t] == f for t, f in before.items() if f < 0.02 * total)


def test_heavy_hitters_are_exact(spark, corpus):
    counts = {r.token: r.freq for r in V.word_frequencies(corpus).collect()}
    total = sum(counts.values())
    found = {r.token: r.freq for r in V.heavy_hitters(corpus, share=0.05).collect()}
    assert found == {t: f for t, f in counts.items() if f >= 0.05 * total}
