import hashlib
import re

from corpuslens.llm import decontamination, queries

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, length=10):
    windows = {}
    for item_id, text in items:
        own = words(text)
        for i in range(max(1, len(own) - length + 1) if own else 0):
            windows.setdefault(tuple(own[i : i + length]), set()).add("" if item_id is None else str(item_id))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(own) - n + 1):
                if (w := tuple(own[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[w]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(own), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=repr)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    got = rows_of(queries.op3_decontaminate(spark, SF))
    assert got == brute(docs, items)
    assert sum(r[-1] for r in got) > 5


PASSAGE = "The quick brown fox jumps over the lazy dog and runs far away from a cat"
ITEMS = [(1, PASSAGE), (2, "tiny item"), (3, None), (4, "!!"), (None, "the the the the the the the the the the the"), (2, PASSAGE + " again"), (10, "Élan ÀB c")]
DOCS = [
    (1, "x " + PASSAGE.upper() + " y"),
    (1, "tiny, ITEM! tiny"),
    (None, None),
    (2, ""),
    (3, "the " * 30_000),
    (4, "item"),
    (5, "tiny"),
    (6, " ".join(["a b c"] * 20_000) + " " + PASSAGE + " " + PASSAGE),
    (7, "élan àb c Élan ÀB C"),
    (8, PASSAGE.replace("lazy", "lazy big")),
    *[(i, "shared line " + PASSAGE) for i in range(100, 160)],
]


def write(make, spark, docs, items):
    path = make([(d, t, None, None, None) for d, t in docs])
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_odd_rows(spark, make):
    got = rows_of(queries.op3_decontaminate(spark, write(make, spark, DOCS, ITEMS)))
    assert got == brute(DOCS, ITEMS)


def test_empty_tables(spark, make):
    assert queries.op3_decontaminate(spark, write(make, spark, [], ITEMS)).count() == 0
    clean = rows_of(queries.op3_decontaminate(spark, write(make, spark, DOCS, [])))
    assert clean == brute(DOCS, [])


def test_blocks_of_windows_join(spark, make):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = decontamination.phrase_matches(docs, items)
    parts = decontamination.phrase_matches(docs, items, block_words=15)
    key = lambda r: repr(r)
    assert sorted(map(tuple, whole.collect()), key=key) == sorted(map(tuple, parts.collect()), key=key)


def test_proximity(spark):
    docs = spark.createDataFrame([(8, DOCS[9][1]), (9, "brown quick the fox"), (10, PASSAGE), (11, "unrelated words")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and")], "item_id long, text string")
    exact = decontamination.proximity_matches(docs, items, slop=0)
    assert {r.doc_id for r in exact.collect()} == {10}
    near = decontamination.proximity_matches(docs, items, slop=1)
    assert {(r.doc_id, r.item, r.position) for r in near.collect() if r.doc_id == 8} == {(8, "1", 0)} or {r.doc_id for r in near.collect()} == {8, 10}
    short = spark.createDataFrame([(1, "the quick brown fox")], "item_id long, text string")
    assert 9 in {r.doc_id for r in decontamination.proximity_matches(docs, short, slop=4).collect()}
