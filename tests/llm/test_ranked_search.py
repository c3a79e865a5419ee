import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpuslens.llm import queries
from corpuslens.llm import ranked_search as rs

SF = "/root/testdata/sf0.001"


def terms_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def brute(docs, items, k=50):
    counts = [(d, Counter(terms_of(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    size, df = sum(sum(c.values()) for _, c in counts), Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * len(counts)) // size
            score = 0
            for t in set(terms_of(text)) & set(c):
                w = math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


def read(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


def test_documents(spark, db):
    got = rows_of(queries.op13_rank_documents(spark, SF))
    assert got == brute(read(spark, "documents", "doc_id", "text"), read(spark, "benchmark", "item_id", "text"))
    sql = db.execute(queries.ORACLE["op13_rank_documents"])
    names = [c[0] for c in sql.description]
    assert sorted([tuple(r[names.index(c)] for c in ("item_id", "rank", "doc_id", "score")) for r in sql.fetchall()], key=repr) == got


def random_rows(rnd, count, longest=300):
    words = [f"w{i}" for i in range(400)]
    return [(i, " ".join(words[min(int(rnd.expovariate(0.02)), 399)] for _ in range(rnd.randint(0, longest)))) for i in range(count)]


@pytest.mark.parametrize("batch_terms", [1, 40, 1 << 14])
def test_small_segments_and_batches(spark, monkeypatch, batch_terms):
    monkeypatch.setattr(rs, "SEGMENT_DOCS", 7)
    monkeypatch.setattr(rs, "FIRST_SCORED", 2)
    rnd = random.Random(1)
    docs, items = random_rows(rnd, 150), [(f"i{i}", t) for i, t in random_rows(rnd, 6, 20)]
    df, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert rows_of(rs.search(df.repartition(3), asked, 5, batch_terms)) == brute(docs, items, 5)


def test_bounds_hold_and_save_work(spark):
    rnd = random.Random(2)
    docs = random_rows(rnd, 2000, 60) + [(9000, "w1 " * 400 + "w2 " * 255 + "w3 " * 254)]
    builder = rs.Builder()
    for d, t in docs:
        builder.add(d, False, t.encode())
    rows = builder.segment()
    size = rows.column("n_terms")[0].as_py()
    named = sorted({t for _, text in docs for t in terms_of(text)})
    df = Counter(t for _, text in docs for t in set(terms_of(text)))
    weights = np.array([rs.weight(len(builder.ids), df[t]) for t in named])
    asked = [rnd.sample(range(len(named)), 4) for _ in range(30)]
    batch = rs.Batch(list(range(30)), asked, named, weights, len(builder.ids), size, 10)
    segment, hashes = rs.Segment(rows, 0, batch), rs.hashed([t.encode() for t in named])
    every = np.arange(len(builder.ids))
    bounds = segment.bounds(batch, [np.array(a) for a in asked], hashes)
    for a, row in zip(asked, bounds):
        assert (row >= segment.scores(every, segment.places[a], weights[a])).all()
    scored = rs.scan(segment, batch, hashes, [rs.Best(10) for _ in asked])
    assert scored < 0.5 * len(every) * len(asked)


def test_odd_rows(spark, make):
    copy = "the same text of a large group"
    docs = [(1, None), (2, ""), (3, "...!"), (None, "Alpha beta"), (None, "alpha BETA"), (4, "alpha beta"), (4, "alpha beta")]
    docs += [(i, copy) for i in range(100, 400)] + [(7, "beta " * 400_000 + "Straße"), (8, "é alpha1 ٣")]
    items = [("a", "ALPHA beta"), ("a", "ALPHA beta"), ("b", None), ("c", "?"), ("d", "same group"), (None, "straße é"), ("e", "absent")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame(items, "item_id string, text string")
    assert rows_of(rs.search(df, asked, 50)) == brute(docs, items)
    clash = df.selectExpr("*", "1 as item", "2 as Score", "3 as terms", "4 as rank")
    assert rows_of(rs.search(clash, asked.selectExpr("*", "1 as doc_id", "2 as terms"), 3)) == brute(docs, items, 3)
    for a, b in ((df.limit(0), asked), (df, asked.limit(0)), (df.where("doc_id = 3"), asked)):
        empty = rs.search(a, b, 5)
        assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]


def test_a_task_reads_one_segment_at_once(spark, monkeypatch):
    """Each segment is a row group of its own; before, a file's segments were held together."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(rs, "SEGMENT_DOCS", 7)
    df = spark.createDataFrame(random_rows(random.Random(4), 60), "doc_id long, text string").coalesce(1)
    files = [pq.ParquetFile(f.removeprefix("file:")) for f in rs.build_index(df).inputFiles()]
    groups = [f.metadata.row_group(i).num_rows for f in files for i in range(f.metadata.num_row_groups)]
    assert len(groups) > 7 and max(groups) == 1


def test_bounds_in_portions_are_the_same(monkeypatch):
    builder = rs.Builder()
    for d, t in random_rows(random.Random(5), 200):
        builder.add(d, False, t.encode())
    rows = builder.segment()
    named = sorted({t for t in rows.column("terms")[0].as_py()})
    batch = rs.Batch([0, 1], [], named, np.arange(len(named)) + 1, 200, 30000, 5)
    segment, hashes = rs.Segment(rows, 0, batch), rs.hashed([t.encode() for t in named])
    asked = [np.arange(0, len(named), 3), np.arange(1, 9)]
    whole = segment.bounds(batch, asked, hashes)
    monkeypatch.setattr(rs, "BOUNDED", 500)
    assert (segment.bounds(batch, asked, hashes) == whole).all()
