import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from corpuslens.llm import toxicity

from test_decontamination import brute as contamination
from test_mixing_sharding import brute_targets
from test_near_duplicates import brute as near_copies
from test_near_duplicates import shingles

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.stored(stage(spark, out[-1], SF), f"test-{name}"))
    return [df.collect() for df in out], [df.columns for df in out]


def test_columns(stages):
    _, columns = stages
    assert all(c == COLUMNS for c in columns[:-1]) and columns[-1] == [*COLUMNS, "shard", "slot"]


def test_toxicity(spark, stages):
    before, after = stages[0][0], stages[0][1]
    scores = {r.doc_id: r.predicted for r in toxicity.scored(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not scores[r.doc_id]}
    assert 0 < len(before) - len(after) < len(before) / 5


def test_near_duplicates(stages):
    before, after = stages[0][1], stages[0][2]
    kept = {d for d, _, _, k in near_copies([(r.doc_id, r.text) for r in before], 5) if k}
    assert sorted(r.doc_id for r in after) == sorted(kept)
    assert shingles("a b c d e", 5)


def test_decontamination(spark, stages):
    before, after = stages[0][2], stages[0][3]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {r[0] for r in contamination([(r.doc_id, r.text) for r in before], items) if r[-1]}
    assert dirty and sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if r.doc_id not in dirty)


def test_mixing(stages):
    before, after = stages[0][3], stages[0][4]
    size = lambda r: len((r.text or "").split())
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r.source] += size(r)
        largest[r.source] = max(largest[r.source], size(r))
    for r in after:
        taken[r.source] += size(r)
    assert set(Counter(r.doc_id for r in after).values()) <= {1, 2}
    for source, target in brute_targets(sizes).items():
        assert abs(taken[source] - target) <= largest[source] + 1


def test_sharding(stages):
    before, after = stages[0][4], stages[0][5]
    assert Counter((r.doc_id, zlib.crc32((r.text or "").encode())) for r in before) == Counter((r.doc_id, zlib.crc32((r.text or "").encode())) for r in after)
    by = defaultdict(list)
    for r in after:
        by[r.shard].append(r)
    assert sorted(by) == list(range(8)) and all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
    sizes = [sum(len((r.text or "").encode()) + 1 for r in own) for own in by.values()]
    assert max(sizes) - min(sizes) <= 4 * max(len((r.text or "").encode()) for r in after)


def test_odd_documents(spark, make):
    rows = [(1, "same text in both rows here", "en", "a", 1), (1, "same text in both rows here", "en", "a", 1), (None, None, None, None, None), (2, "", "en", None, 0), (None, "no id at all in this one", "en", "b", 9), (3, "w " * 40_000, "en", "a", 80_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (rows, []):
        path = make([r + ("x", 5) for r in docs], schema + ", shard string, _mark int")
        spark.createDataFrame([(1, 1, 0)] if docs else [], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame([(1, "unrelated item")] if docs else [], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        out = corpus_pipeline.run(spark, path)
        assert set(out.columns) == {*COLUMNS, "shard", "_mark", "slot"}
        assert {r.doc_id for r in out.collect()} <= {r[0] for r in docs}
