import pytest
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators import context as C
from corpuslens.operators import sequences as S
from corpuslens.operators import vocabulary as V
from corpuslens.streaming import incremental as ST

SCHEMA = "doc_id long, tokens array<string>"


@pytest.fixture()
def folder(corpus, tmp_path):
    corpus.repartition(6, "doc_id").write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def key(df):
    return sorted(map(tuple, df.collect()))


def stream(spark, folder):
    return ST.read_documents(spark, folder, SCHEMA, files_per_batch=2)


def test_counts_equal_the_batch_result(spark, corpus, folder, tmp_path):
    state = str(tmp_path / "state")
    read = ST.stream_word_frequencies(stream(spark, folder), state)
    assert key(read(spark)) == key(V.word_frequencies(corpus))
    corpus.limit(0).unionByName(spark.createDataFrame([(99, ["the", "brandnew"])], SCHEMA)).write.mode("append").parquet(folder)
    read = ST.stream_word_frequencies(stream(spark, folder), state)  # goes on where it stopped
    more = corpus.unionByName(spark.createDataFrame([(99, ["the", "brandnew"])], SCHEMA))
    assert key(read(spark)) == key(V.word_frequencies(more))


def test_vectors_equal_the_batch_result(spark, corpus, folder, tmp_path):
    read = ST.stream_context_vectors(stream(spark, folder), str(tmp_path / "state"), 2, 50, 4)
    got = read(spark).select("target", "idx", "w")
    assert key(got) == key(C.accumulate_context_vectors(corpus, 2, 50, 4).select("target", "idx", "w"))


def test_vocabulary_ids_are_dense_and_stable(spark, corpus, folder, tmp_path):
    state = str(tmp_path / "state")
    first = dict(key(ST.stream_vocabulary(stream(spark, folder), state)(spark)))
    tokens = {r.token for r in V.word_frequencies(corpus).collect()}
    assert set(first) == tokens and sorted(first.values()) == list(range(len(tokens)))
    spark.createDataFrame([(99, ["the", "zz", "aa"])], SCHEMA).write.mode("append").parquet(folder)
    second = dict(key(ST.stream_vocabulary(stream(spark, folder), state)(spark)))
    assert {t: i for t, i in second.items() if t in first} == first
    assert second["aa"] == len(first) and second["zz"] == len(first) + 1


def test_state_is_read_as_of_each_batch(spark, corpus, folder, tmp_path):
    running = ST.stream_word_frequencies(stream(spark, folder), str(tmp_path / "state"))
    assert key(running(spark)) == key(V.word_frequencies(corpus)) == key(running.read(spark, 2))
    totals = [running.read(spark, batch).agg(F.sum("freq")).first()[0] for batch in range(3)]
    assert 0 < totals[0] < totals[1] < totals[2]


def take_back_last_commit(state):
    """As if the driver had failed after the batch was written."""
    commits = state / "checkpoint" / "commits"
    last = max((p for p in commits.iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for path in (last, commits / f".{last.name}.crc"):
        path.unlink(missing_ok=True)


def test_replayed_batch_gives_the_same_ids(spark, folder, tmp_path):
    first = key(ST.stream_vocabulary(stream(spark, folder), str(tmp_path / "s"))(spark))
    take_back_last_commit(tmp_path / "s")
    assert key(ST.stream_vocabulary(stream(spark, folder), str(tmp_path / "s"))(spark)) == first


def test_replayed_batch_counts_once(spark, corpus, folder, tmp_path):
    ST.stream_word_frequencies(stream(spark, folder), str(tmp_path / "s"))(spark)
    take_back_last_commit(tmp_path / "s")
    assert key(ST.stream_word_frequencies(stream(spark, folder), str(tmp_path / "s"))(spark)) == key(V.word_frequencies(corpus))


def test_a_stream_without_input(spark, corpus, tmp_path):
    (tmp_path / "in").mkdir()
    empty = ST.stream_word_frequencies(stream(spark, str(tmp_path / "in")), str(tmp_path / "s"))(spark)
    assert empty.collect() == [] and empty.columns == ["token", "freq"]


def test_null_tokens(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a", None, "b"]), (2, None), (3, []), (4, [None, "a"])], SCHEMA)
    rows.write.parquet(str(tmp_path / "in"))
    order = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert order(ST.stream_word_frequencies(stream(spark, str(tmp_path / "in")), str(tmp_path / "a"))(spark)) == order(V.word_frequencies(rows))
    ids = order(ST.stream_vocabulary(stream(spark, str(tmp_path / "in")), str(tmp_path / "b"))(spark))
    assert {t for t, _ in ids} == {"a", "b", None} and sorted(i for _, i in ids) == [0, 1, 2]
    vectors = ST.stream_context_vectors(stream(spark, str(tmp_path / "in")), str(tmp_path / "c"), 1, 20, 4)(spark)
    assert order(vectors) == order(C.accumulate_context_vectors(rows, 1, 20, 4))


def test_rocksdb_state(spark, corpus, folder, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        read = ST.stream_word_frequencies(stream(spark, folder), str(tmp_path / "state"))
        assert key(read(spark)) == key(V.word_frequencies(corpus))
    finally:
        spark.conf.unset(name)


def test_a_running_query_can_be_followed(spark, corpus, folder, tmp_path):
    running = ST.stream_word_frequencies(stream(spark, folder), str(tmp_path / "s"), trigger={"processingTime": "0 seconds"})
    try:
        assert running.query.isActive
        assert key(running(spark)) == key(V.word_frequencies(corpus))
    finally:
        running.query.stop()


def test_stateless_rows(spark, corpus, folder, tmp_path):
    grams = ST.stream_rows(S.ngrams(stream(spark, folder), 3), str(tmp_path / "a"))(spark)
    assert key(grams) == key(S.ngrams(corpus, 3))
    text = lambda df: df.select("doc_id", T.tokenize(F.array_join("tokens", ", ")).alias("t"))
    assert key(ST.stream_rows(text(stream(spark, folder)), str(tmp_path / "b"))(spark)) == key(text(corpus))
