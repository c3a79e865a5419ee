import zlib
from collections import Counter, defaultdict

import pytest

from corpuslens.llm import mixing, queries, sharding
SF = "/root/testdata/sf0.001"

SHARD_SQL = """
with hexed as (
  select doc_id, text, strlen(coalesce(text, '')) + 1 as size, md5(coalesce(text, '')) as digest from documents),
keyed as (
  select doc_id, text, size,
    (('0x' || substr(digest, 1, 10))::bigint << 23) + (('0x' || substr(md5(concat_ws(':', doc_id::varchar, digest)), 1, 6))::bigint >> 1) as key
  from hexed),
grouped as (select key, sum(size) as bytes from keyed group by key),
cumulated as (
  select key, bytes, coalesce(sum(bytes) over (order by key rows between unbounded preceding and 1 preceding), 0) as below,
    sum(bytes) over () as total from grouped),
placed as (select key, least(7, (2 * below + bytes) * 8 // (2 * total))::int as shard from cumulated)
select doc_id, size::bigint as size, 'bytes' as law, shard,
  row_number() over (partition by shard order by key, doc_id) - 1 as slot, null::int as grown_shard
from keyed join placed using (key)
"""


ROWS = [
    (1, "a b c", "en", "x", 5),
    (1, "a b c", "en", "x", 5),
    (2, None, None, None, None),
    (None, "one two", "en", None, 7),
    (3, "", "en", "y", 0),
    (4, " \t\n", "en", "y", 3),
    (5, "w " * 50_000, "en", "z", 100_000),
    *[(i, "the same copy", "en", "x", 13) for i in range(10, 40)],
]


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, limit=2.0):
    ranked = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(ranked)}
    left, out, open_ = share * sum(sizes.values()), {}, set(sizes)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > limit * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: limit * sizes[s] for s in over}
        left -= sum(limit * sizes[s] for s in over)
        open_ -= over
    return out


def check_mix(rows, docs):
    sizes = defaultdict(int)
    source = {}
    for doc_id, text, _, src, _ in docs:
        sizes[src] += len((text or "").split())
        source[doc_id] = src
    want = brute_targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        assert r.target == pytest.approx(want[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
        largest[source[r.doc_id]] = max(largest[source[r.doc_id]], r.size)
    for s, target in want.items():
        assert abs(taken[s] - target) <= 2 * largest[s]
    assert len(rows) == len(docs)


def test_mix_odd_rows(spark, make):
    rows = queries.op1_mix_sources(spark, make(ROWS)).collect()
    check_mix(rows, ROWS)
    again = queries.op1_mix_sources(spark, make(ROWS)).collect()
    assert Counter(rows) == Counter(again)


def test_mix_large(spark, make):
    docs = [(i, "word " * (1 + i * 7 % 23), "en", f"s{min(i % 12, 4)}", 1) for i in range(3000)]
    check_mix(queries.op1_mix_sources(spark, make(docs)).collect(), docs)


def test_mix_repeats_whole_documents(spark, make):
    path = make([r + ("extra", 1) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long, size string, key int")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    wanted = Counter()
    for r in mixing.mix_sizes(docs).collect():
        wanted[r.doc_id] += r.taken
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len((r.text or "").split())
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in wanted.items() if v}


def test_empty(spark, make):
    path = make([])
    assert queries.op1_mix_sources(spark, path).count() == 0
    assert queries.op7_shard_by_bytes(spark, path).count() == 0
    assert mixing.mix(spark.read.parquet(f"{path}/documents.parquet")).count() == 0


def check_shards(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return [sum(r.size for r in by[s]) for s in range(8)]


def test_shards_match_sql(spark, db):
    got = queries.op7_shard_by_bytes(spark, SF).collect()
    check_shards(got)
    want = db.execute(SHARD_SQL).fetchall()
    assert Counter((r.doc_id, r.size, r.law, r.shard, r.slot, r.grown_shard) for r in got) == Counter(want)
    texts = dict(db.execute("select doc_id, text from documents").fetchall())
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got)


def test_shards_of_odd_rows(spark, make):
    rows = queries.op7_shard_by_bytes(spark, make(ROWS)).collect()
    assert len(rows) == len(ROWS)
    check_shards(rows)


def test_a_large_group_of_copies_is_split_evenly(spark, make):
    docs = [(i, "copy of a copy" if i % 3 else f"text {i}", "en", "s", 1) for i in range(6000)]
    sizes = check_shards(queries.op7_shard_by_bytes(spark, make(docs)).collect())
    assert max(sizes) - min(sizes) < 50


def test_tolerance_and_columns(spark, make):
    path = make([r + (7, 8) for r in ROWS * 20], "doc_id long, text string, lang string, source string, n_chars long, shard int, key int")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = sharding.shard_documents(docs, tolerance=0.1)
    assert sorted(out.columns) == sorted([*docs.columns, "slot"])
    assert out.count() == len(ROWS) * 20
