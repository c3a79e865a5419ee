import pytest
from pyspark.sql import functions as F

from corpuslens.operators import batching as B
from corpuslens.operators import ordering
from corpuslens.operators import sequences as S
from corpuslens.operators import vocabulary as V

SENTENCE = "hello there mr smith welcome back to the world".split()


def flat(corpus):
    return [t for r in corpus.orderBy("doc_id").collect() for t in r.tokens]


def test_windows_of_a_sentence(spark):
    df = spark.createDataFrame([(0, SENTENCE)], "doc_id long, tokens array<string>")
    rows = S.context_windows(df, 2).orderBy("pos").collect()
    assert len(rows) == len(SENTENCE)
    for i, r in enumerate(rows):
        assert (r.left, r.target, r.right) == (SENTENCE[max(0, i - 2):i], SENTENCE[i], SENTENCE[i + 1:i + 3])


def test_pairs_equal_brute_force(corpus):
    want = []
    for r in corpus.collect():
        for i, t in enumerate(r.tokens):
            want += [(r.doc_id, t, r.tokens[j], j - i) for j in range(max(0, i - 3), min(len(r.tokens), i + 4)) if j != i]
    got = [(r.doc_id, r.target, r.context, r.offset) for r in S.context_pairs(corpus, 3).collect()]
    assert sorted(got) == sorted(want)


def test_short_sentence_has_no_ngrams(spark):
    df = spark.createDataFrame([(0, ["hello", "there"]), (1, SENTENCE)], "doc_id long, tokens array<string>")
    rows = S.ngrams(df, 3).collect()
    assert len(rows) == len(SENTENCE) - 2 and {r.doc_id for r in rows} == {1}


@pytest.mark.parametrize("parts", [1, 4, 16])
@pytest.mark.parametrize("block", [3, 5, 1000])
def test_flat_ngrams_equal_brute_force(corpus, parts, block):
    tokens = flat(corpus)
    got = {r.idx: r.ngram for r in S.ngrams_flat(corpus.repartition(parts), 4, block=block).collect()}
    assert got == {i: tokens[i:i + 4] for i in range(len(tokens) - 3)}


def test_take_skip_and_range(spark):
    rows = spark.range(10).withColumn("k", -F.col("id"))
    assert [r.id for r in ordering.take(rows, 3, "k").collect()] == [9, 8, 7]
    assert ordering.take(rows, 50, "k").count() == 10
    assert sorted(r.id for r in S.skip(rows, 7, "id").collect()) == [7, 8, 9]
    assert S.skip(rows, None, "id").count() == 0
    assert sorted(r.id for r in S.row_range(rows, 2, 4, "id").collect()) == [2, 3]
    assert sorted((r.id, r.idx) for r in S.row_range(rows, 8, 40, "id").collect()) == [(8, 8), (9, 9)]
    assert S.skip(rows, 10, "id").count() == 0 and S.skip(rows, 0, "id").count() == 10


def test_rows_in_order_stay_in_place(spark, tmp_path, capsys):
    spark.range(50).select("id", F.lit("text").alias("payload")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for made in (S.skip(df, 3, "id"), S.add_slices(df, 4, "id"), V.split_corpus(df, "id")):
        made.explain()
        lines = capsys.readouterr().out.splitlines()
        main = [line for line in lines if not line.lstrip().startswith(":")]  # subqueries are drawn as branches
        scans = [line for line in lines if "FileScan" in line and "payload" in line]
        assert len(scans) == 1 and scans[0] in main and not any("Exchange" in line for line in main)


def test_slices(spark):
    assert [len(r) for r in S.divide_slices(16, 5)] == [3, 3, 3, 3, 4]
    assert S.divide_slices(49, 3, 51)[-1] == range(83, 100)
    with pytest.raises(ValueError):
        S.divide_slices(2, 3)
    counts = {r["slice"]: r["count"] for r in S.add_slices(spark.range(16), 5, "id").groupBy("slice").count().collect()}
    assert counts == {0: 3, 1: 3, 2: 3, 3: 3, 4: 4}
    with pytest.raises(Exception, match="more slices"):
        S.add_slices(spark.range(2), 3, "id").collect()


def test_repeats(spark):
    rows = spark.range(3)
    assert sorted(r.id for r in S.repeat_each(rows, 2).collect()) == [0, 0, 1, 1, 2, 2]
    assert sorted((r.epoch, r.id) for r in S.repeat_epochs(rows, 2).collect()) == [(e, i) for e in (0, 1) for i in range(3)]
    assert S.repeat_each(rows, 0).count() == 0
    counts = spark.createDataFrame([(c,) for c in (0, 3, 1, 2)], "c int")
    assert sorted((r.c, r.i) for r in S.enumerate_within(counts, "c").collect()) == [(1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)]


def test_batches(spark):
    rows = spark.range(10)
    got = {r.batch: r["items"] for r in B.batch(rows, "id", 4, "id", pad=F.lit(0).cast("long")).collect()}
    assert got == {0: [0, 1, 2, 3], 1: [4, 5, 6, 7], 2: [8, 9, 0, 0]}
    assert {len(r["items"]) for r in B.batch(rows, "id", 4, "id").collect()} == {4, 2}


def test_shuffle_stays_in_its_buffer(spark):
    rows = spark.range(1000).withColumn("idx", F.col("id"))
    moved = B.shuffle(rows, 100, seed=1).collect()
    assert sorted(r.idx for r in moved) == list(range(1000))
    assert all(r.id // 100 == r.idx // 100 for r in moved)
    assert sum(r.id != r.idx for r in moved) > 900
    assert sorted(r.idx for r in B.shuffle_global(spark.range(50), F.col("id")).collect()) == list(range(50))


def stream_tokens(n, batch):
    length = n // batch
    return [list(range(s * length, (s + 1) * length)) for s in range(batch)]


@pytest.mark.parametrize("prob", [None, 0.9])
@pytest.mark.parametrize("targets", [True, False])
def test_parallel_sequences(spark, monkeypatch, prob, targets):
    monkeypatch.setattr(S, "BLOCK_TOKENS", 37)  # several buckets per stream
    docs, n = [], 0
    for i in range(90):
        docs.append((i, [str(n + j) for j in range((i * 13) % 29)]))
        n += len(docs[-1][1])
    df = spark.createDataFrame(docs, "doc_id long, tokens array<string>").repartition(5)
    got = B.parallel_sequences(df, 5, 10, min_len=3, seq_prob=prob, targets=targets, seed=2).collect()
    for stream, want in enumerate(stream_tokens(n, 5)):
        rows = sorted((r for r in got if r.stream == stream), key=lambda r: r.segment)
        joined = [int(t) for r in rows for t in r.inputs]
        assert joined == (want[:-1] if targets else want)
        if targets:
            assert [int(t) for r in rows for t in r.targets] == want[1:]
        lengths = [len(r.inputs) for r in rows]
        assert min(lengths[:-1]) >= (10 if prob is None else 3)
        if prob is not None:
            assert len(set(lengths)) > 2 and 5 < sum(lengths) / len(lengths) < 15
    by_segment = {}
    for r in got:
        by_segment.setdefault(r.segment, set()).add(len(r.inputs))
    assert all(len(v) == 1 for v in by_segment.values())  # one split for all streams


def test_too_few_tokens(spark):
    df = spark.createDataFrame([(0, ["a"])], "doc_id long, tokens array<string>")
    with pytest.raises(ValueError):
        B.parallel_sequences(df, 4, 10)


@pytest.mark.parametrize("flatten", [False, True])
@pytest.mark.parametrize("shuffled", [False, True])
def test_ngram_batches(spark, corpus, flatten, shuffled):
    vocab = V.build_vocabulary(V.word_frequencies(corpus))
    ids = {r.token: r.id for r in vocab.collect()}
    if flatten:
        tokens = [ids[t] for t in flat(corpus)]
        want = [tokens[i:i + 3] for i in range(len(tokens) - 2)]
    else:
        want = [[ids[t] for t in r.tokens[i:i + 3]] for r in corpus.orderBy("doc_id").collect() for i in range(len(r.tokens) - 2)]
    rows = B.ngram_batches(corpus, vocab, 3, epochs=2, batch_size=16, shuffle_rows=shuffled, buffer_size=50, flatten=flatten).collect()
    for epoch in (0, 1):
        batches = sorted((r for r in rows if r.epoch == epoch), key=lambda r: r.batch)
        grams = [g for r in batches for g in r["items"]]
        assert all(len(r["items"]) == 16 for r in batches[:-1])
        assert (sorted(grams) if shuffled else grams) == (sorted(want) if shuffled else want)
        assert not shuffled or grams != want


def test_pairs_of_a_document_are_grouped_in_place(spark, capsys):
    """Two rows may share a key; before, every pair was shuffled."""
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["a", None]), (None, ["c", "c"]), (2, None)], "doc_id long, tokens array<string>")
    listed = S.context_pairs(df, 1).groupBy("doc_id", "target").agg(F.sort_array(F.collect_list("context")).alias("c"), F.count("*").alias("n"))
    assert {(r.doc_id, r.target, tuple(r.c), r.n) for r in listed.collect()} == {
        (1, "a", ("b",), 2), (1, "b", ("a",), 1), (1, None, ("a",), 1), (None, "c", ("c", "c"), 2)
    }
    listed.explain()
    assert "Exchange" not in capsys.readouterr().out.split("Generate")[0]
