import zlib

import numpy as np
import pytest

from corpuslens.llm import labelled, quality, queries, toxicity

SF = "/root/testdata/sf0.1"


def auc(scores, labels):
    scores, labels = np.asarray(scores), np.asarray(labels)
    good, bad = scores[labels == 1], scores[labels == 0]
    return ((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2) if len(good) and len(bad) else None


def check(spark, query, label, folds, fold, least):
    rows = {r.doc_id: r for r in query(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % folds == fold) for i, r in rows.items())
    known = [(rows[r.doc_id], r[label]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert auc([r.score for r, _ in known], [y for _, y in known]) > least


def test_quality_of_unseen_documents(spark):
    check(spark, queries.op9_score_quality, "quality", 3, 1, 0.99)


def test_toxicity_of_unseen_documents(spark):
    check(spark, queries.op5_score_toxicity, "toxic", 4, 2, 0.8)


ODD = [(1, None), (2, ""), (3, " \n"), (4, "word"), (None, "no id"), (5, "long " * 60_000), (5, "again"), (6, "é😀\x00\x01")]
LABELS = [(4, 1, 0), (5, 0, 1), (5, 1, 1), (99, 1, 1), (None, 0, 0), (6, None, None)]


@pytest.mark.parametrize("query", [queries.op5_score_toxicity, queries.op9_score_quality])
def test_odd_rows(spark, make, query):
    for docs in (ODD, []):
        for labels in (LABELS, [], [(4, 1, 1)], [(i, i % 2, i % 2) for i in range(1, 7)]):
            path = make([(d, t, None, None, None) for d, t in docs])
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
            rows = query(spark, path).collect()
            assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in rows)


def test_labels_of_the_held_out_fold_and_other_columns_do_not_count(spark, make):
    texts = [(i, ("calm words only here " if i % 3 else "awful words insultx here ") + f"t{i} " * (i % 7), "en", "s", 1) for i in range(600)]
    truth = [(i, 1, int(i % 3 == 0)) for i in range(600)]
    lies = [(i, 1, y if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - y) for i, _, y in truth]
    out = []
    for labels in (truth, lies):
        path = make([(d, t, "x" if labels is lies else "en", None, 7) for d, t, *_ in texts])
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        out.append({r.doc_id: (r.score, r.predicted) for r in queries.op5_score_toxicity(spark, path).collect()})
    assert out[0] == out[1]
    assert np.mean([out[0][i][1] == y for i, _, y in truth]) > 0.98


def test_compression_difference():
    rows = [(i % 2, ("dreadful nastyword " if i % 2 else "pleasant kindword ") + f"filler{i} text") for i in range(400)]
    d = toxicity.Dictionaries(rows)
    assert d.difference(b"nastyword") > 2 >= abs(d.difference(b"kindword")) and d.difference(b"unseen") <= 2
    assert toxicity.windows("One, two three.", 1) == [b"one", b"two", b"three"]
    assert toxicity.windows("One, two three.", 5) == [b"one two", b"three"]


def made_words(rng, n):
    return sorted({"".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 8)) for _ in range(n)})


def area_of_new_texts(rng, made, n):
    """Of texts that `made(toxic)` makes: a classifier of n texts of each class, and its area under the curve on others."""
    labels = [1, 0] * n
    model = toxicity.Classifier([(y, i // 2 % 2, made(y)) for i, y in enumerate(labels)])
    return auc(model.scores([made(y) for y in labels[:400]]), labels[:400])


def test_toxic_phrases_of_ordinary_words():
    rng = np.random.default_rng(5)
    words = made_words(rng, 400)
    phrases = [words[i : i + 4] for i in range(0, 24, 4)]

    def made(toxic):
        text, at = list(rng.choice(words, 40)), rng.integers(40)
        return " ".join(text[:at] + (phrases[rng.integers(6)] if toxic else list(rng.choice(words, 4))) + text[at:])

    assert area_of_new_texts(rng, made, 500) > 0.95


def test_many_rare_toxic_words():
    rng = np.random.default_rng(6)
    words, toxic_words = made_words(rng, 150), made_words(rng, 400)

    def made(toxic):
        text = list(rng.choice(words, 40)) + [rng.choice(toxic_words if toxic else words)]
        rng.shuffle(text)
        return " ".join(text)

    assert area_of_new_texts(rng, made, 4000) > 0.9


def test_statistics_of_chunks(monkeypatch):
    text = "Some Words, repeated repeated words. 12 ## é\n" * 500
    whole = quality.statistics(text)
    monkeypatch.setattr(quality, "CHUNK", 1000)
    assert quality.statistics(text) == pytest.approx(whole, abs=1e-9)


def test_logistic_separates():
    x = np.random.default_rng(1).normal(size=(500, 2))
    y = (x[:, 0] > 0).astype(float)
    p = labelled.Logistic(x, y).scores(x)
    assert ((p > 0.5) == (y > 0)).mean() > 0.98


def test_discriminant_equals_the_formula():
    rng = np.random.default_rng(3)
    x = np.c_[rng.normal(size=(300, 3)), np.full(300, 1e9)]
    y = (rng.random(300) < 0.4).astype(int)
    x[y == 1, :3] *= 2
    m = quality.Discriminant(x, y)
    z = m._standard(x)
    pooled = sum(np.cov(z[y == c].T, bias=True) * (y == c).sum() for c in (0, 1)) / 300
    logs = []
    for c in (0, 1):
        own = (1 - quality.POOLED) * np.cov(z[y == c].T, bias=True) + quality.POOLED * pooled
        own = (1 - quality.DIAGONAL) * own + quality.DIAGONAL * np.diag(np.diag(pooled)) + 1e-4 * np.eye(3)
        gap = z - z[y == c].mean(0)
        logs.append(np.log((y == c).mean()) - 0.5 * np.linalg.slogdet(own)[1] - 0.5 * (gap @ np.linalg.inv(own) * gap).sum(1))
    assert m.log_ratio(x) == pytest.approx(logs[1] - logs[0])


def test_the_sample_is_compared_in_tasks(spark, make, monkeypatch):
    """The model is the one that a fit in one process has, and the driver compares no text."""
    texts = [(i, ("calm words only here " if i % 3 else "awful words insultx here ") + f"t{i} " * (i % 7), "en", "s", 1) for i in range(300)]
    path = make(texts)
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    rows = toxicity.labelled_texts(docs, labels, "toxic", 4, 2, {1: 4000, 0: 8000}).orderBy("label", "half", toxicity.F.md5("text")).collect()
    alone = toxicity.Classifier([(r.label, r.half, r.text) for r in rows])
    monkeypatch.setattr(toxicity.Dictionaries, "features", _not_here(toxicity.Dictionaries.features))
    model = toxicity.fit(docs, labels)
    assert model.dictionaries.contents == alone.dictionaries.contents
    assert np.array_equal(model.calibration.weights, alone.calibration.weights)


def _not_here(features):
    import os

    driver = os.getpid()

    def elsewhere(self, text):
        assert os.getpid() != driver
        return features(self, text)

    return elsewhere


def test_texts_are_compared_together(monkeypatch):
    """The features are those of single windows, made by two calls for many texts."""
    rng = np.random.default_rng(9)
    words = made_words(rng, 300)
    texts = [None, "", " \n", "word", "y" * 23, "y" * 24 + " z", "é😀\x00\x01 x"] + [" ".join(rng.choice(words, n)) + ", end." for n in range(1, 40)]
    d = toxicity.Dictionaries([(i % 2, text or "") for i, text in enumerate(texts)])

    def gain(compressors, window, k):
        framed = toxicity.FRAME + b" " + window + b" " + toxicity.FRAME
        return min(max(len(compressors[0].compress(framed)) - len(compressors[k].compress(framed)), toxicity.LOWEST), toxicity.HIGHEST)

    def expected(text):
        found, halves = toxicity.windows(text, 1), toxicity.windows(text, toxicity.PASSAGE_BYTES // 2)
        parts = [b" ".join(halves[i : i + 2]) for i in range(max(len(halves) - 1, min(len(halves), 1)))]
        assert parts == toxicity.passages(text)
        out = [np.log1p(len(found))]
        for gains in ([gain(d.by_word, w, 1) for w in found], [gain(d.by_word, w, 2) for w in found], [gain(d.by_passage, p, 1) for p in parts]):
            counts = np.array([gains.count(v) for v in toxicity.VALUES])
            out += [*np.log1p(counts), *(counts / max(len(gains), 1))[1 - toxicity.LOWEST :], max(gains, default=0), np.log1p((counts * toxicity.VALUES)[toxicity.VALUES >= 2].sum())]
        return out

    calls, made = [], toxicity._gains
    monkeypatch.setattr(toxicity, "_gains", lambda *args: calls.append(1) or made(*args))
    assert np.allclose(d.all_features(texts), [expected(t) for t in texts], rtol=0, atol=1e-12)
    assert len(calls) == 2
    assert d.all_features(texts) == [d.features(t) for t in texts]
