import hashlib
import statistics

import numpy as np

from corpuslens.llm import fingerprint as fp
from corpuslens.llm import queries

SF = "/root/testdata/sf0.01"


def brute_digest(data):
    counts = [0] * fp.BUCKETS
    for a, b, c in zip(data, data[1:], data[2:]):
        counts[((a | b << 8 | c << 16) * 2654435761 & 0xFFFFFFFF) >> 24] += 1
    ranked = sorted(counts)
    quartiles = [ranked[fp.BUCKETS * i // 4 - 1] for i in (1, 2, 3)]
    code = [sum(c > q for q in quartiles) for c in counts]
    bits = "".join(f"{x:02b}" for x in code)
    q1, q2, q3 = quartiles
    ratios = (q1 * 15 // q3, q2 * 15 // q3) if q3 else (0, 0)
    length = min(255, round(np.log(len(data) + 1) / np.log(1.25)))
    return f"{length:02x}{ratios[0]:x}{ratios[1]:x}{int(bits, 2):0{fp.BUCKETS // 2}x}"


def brute(docs):
    """Expected (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint) in order."""
    ranked = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for i, (doc_id, text) in enumerate(ranked):
        text, following = text or "", ranked[(i + 1) % len(ranked)][1] or ""
        n = len(text) // 3
        data = (text[: len(text) - n] + following[:n]).encode()
        out.append((doc_id, len(text), hashlib.sha256(data).hexdigest(), fp.fingerprint(text.encode()), fp.fingerprint(data)))
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in df.collect()), key=repr)


def test_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    result = queries.op10_fingerprint_documents(spark, SF)
    assert rows_of(result) == sorted(brute(docs), key=repr)
    rows = result.collect()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert statistics.mean(r.near_edited > r.near_next for r in rows) > 0.95


def test_digest_is_as_defined():
    for data in (b"", b"a", b"ab", b"abc", b"hello world " * 40, bytes(range(256)) * 9, "é😀".encode() * 100):
        assert fp.fingerprint(data) == brute_digest(data)
    assert fp.likeness(fp.fingerprint(b"x" * 50), fp.fingerprint(b"x" * 50)) == 1.0
    big = b"some long text " * 200_000
    assert fp.bucket_counts(big).sum() == len(big) - 2


ODD = [(1, None), (2, ""), (3, "a"), (3, "ab"), (3, "ab"), (None, "null id, text one"), (None, None), (7, "é😀" * 1000), (8, "w " * 100_000), *[(i, "copy of one text " * 9) for i in range(20, 60)]]


def test_odd_rows(spark, make):
    path = make([(d, t, None, None, None) for d, t in ODD])
    assert rows_of(queries.op10_fingerprint_documents(spark, path)) == sorted(brute(ODD), key=repr)
    assert queries.op10_fingerprint_documents(spark, make([])).count() == 0
    assert rows_of(queries.op10_fingerprint_documents(spark, make([(4, "only one row", "a", "b", 3)]))) == brute([(4, "only one row")])


def test_columns(spark):
    df = spark.createDataFrame([("same",), ("same",), (None,)], "t string")
    marked = df.select(fp.fingerprint_of("t").alias("f"))
    assert len({r.f for r in marked.collect()}) == 2
    assert marked.select(fp.likeness_of("f", "f").alias("x")).first().x == 1.0
