"""Sums of random indexes in numpy against the column functions and brute force."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.functions import index_arrays as A
from corpuslens.functions import random_index as R
from corpuslens.operators import context as C
from corpuslens.plans.index_queries import joined_cells
from corpuslens.sources import stores

DOCS = [(1, ["a", None, "b", "a"]), (1, ["c"]), (None, ["b", "", "ß"]), (2, []), (3, None), (4, ["a"] * 5)]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(DOCS, "doc_id long, tokens array<string>")


@pytest.mark.parametrize("k,s,seed", [(10, 2, 0), (1000, 10, 0), (20, 18, 5), (10, 10, 1), (40000, 9, 3)])
def test_positions_are_those_of_the_column_function(spark, k, s, seed):
    signs = ["", "ß", "a:1", *(f"w{i}" for i in range(300))]
    rows = spark.createDataFrame([(x,) for x in signs], "x string").select("x", R.active_positions(F.col("x"), k, s, seed).alias("p"))
    want = {r.x: r.p for r in rows.collect()}
    got = A.Index(k, s, seed).positions([x.encode() for x in signs])
    assert {x: p.tolist() for x, p in zip(signs, got, strict=True)} == want


def vector(token, k, s):
    out = np.zeros(k, int)
    if token is not None:
        positions = A.Index(k, s).positions([token.encode()])[0]
        out[positions] = np.where(np.arange(s) < s // 2, 1, -1)
    return out


def near(tokens, i, size, include):
    return [tokens[j] for j in range(max(0, i - size), min(len(tokens), i + size + 1)) if include or j != i]


@pytest.mark.parametrize("include", [True, False])
def test_windows_of_odd_rows(odd, include, monkeypatch):
    got = C.encode_bow(odd, 2, 12, 4, include_target=include).collect()
    want = [(d, i, sum((vector(t, 12, 4) for t in near(ts, i, 2, include)), np.zeros(12, int))) for d, ts in DOCS for i in range(len(ts or []))]
    show = lambda v: tuple((int(i), int(v[i])) for i in np.flatnonzero(v))
    assert Counter((r.doc_id, r.pos, tuple((c.idx, c.w) for c in r.cells)) for r in got) == Counter((d, i, show(v)) for d, i, v in want)


def test_windows_are_encoded_beside_the_rows(odd, capsys):
    """Before, every cell went through several interpreted functions."""
    C.encode_bow(odd, 1, 1000, 10, normalise=True).explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "lambdafunction" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("few", [0, 3, 100])
def test_parts_add_up(spark, odd, few, monkeypatch):
    """Words with few and with many contexts, in stretches that cut documents."""
    index = A.Contexts(A.Index(12, 4), 2)
    monkeypatch.setattr(A.Contexts, "few", few)
    monkeypatch.setattr(A, "PAIRS_OF", 3)
    monkeypatch.setattr(A, "VECTORS", 2)
    monkeypatch.setattr(A, "LISTED", 2)
    batches = [pa.RecordBatch.from_arrays([pa.array([ts for _, ts in part], pa.list_(pa.string()))], ["tokens"]) for part in (DOCS[:2], DOCS[2:])]
    rows = [r for b in index.parts(iter(batches)) for r in b.to_pylist()]
    assert few or not any(r["text"] for r in rows)
    words = sorted({r["target"] for r in rows}, key=str)
    lists = [[{c: r[c] for c in ("text", "numbers")} for r in rows if r["target"] == w] for w in words]
    found = index.total(pa.array(lists, pa.list_(pa.struct([("text", pa.binary()), ("numbers", pa.binary())]))))
    got = {w: {c["idx"]: c["w"] for c in r} for w, r in zip(words, found.to_pylist(), strict=True)}
    want = {}
    for _, ts in DOCS:
        for i, t in enumerate(ts or []):
            want[t] = want.get(t, 0) + sum(vector(x, 12, 4) for x in near(ts, i, 2, True))
    assert got == {t: {int(i): int(v[i]) for i in np.flatnonzero(v)} for t, v in want.items()}


def test_small_numbers():
    numbers = np.array([0, 1, 127, 128, 16383, 16384, 1 << 40, 5])
    data, sizes = A.small(numbers)
    assert sizes.tolist() == [1, 1, 1, 2, 2, 3, 6, 1] and A.unsmall(data).tolist() == numbers.tolist()
    assert A.unsmall(A.small(numbers[:0])[0]).tolist() == []


def test_vectors_that_become_cells_are_not_exchanged(odd, capsys):
    """Before, each cell was sent to its vector as a row."""
    cells = C.accumulate_context_vectors(odd, 2, 12, 4)
    whole, squashed = C.packed(cells), C.packed(C.squash(cells, 12))
    for df in (whole, squashed):
        df.explain()
        assert capsys.readouterr().out.count("Exchange") == 1
    again = cells.select("target", "idx", "w")  # other rows, for which the vectors are put together
    rows = lambda df: {r.target: [tuple(c) for c in r.cells] for r in df.collect()}
    text = C.packed(C.squash(cells, 12)).withColumn("cells", joined_cells("cells", 6))
    assert text.count() == squashed.count() and all(r.cells for r in text.collect())
    assert rows(whole) == rows(C.packed(again)) and rows(squashed) == rows(C.packed(C.squash(again, 12)))


def test_cells_of_stored_vectors_are_not_exchanged(spark, tmp_path, capsys):
    cells = spark.createDataFrame([("a", 0, 4), ("a", 1, -2), ("b", 0, -3)], "target string, idx int, w long")
    freqs = spark.createDataFrame([("a", 2), ("b", 1)], "token string, freq long")
    for _ in range(2):
        stores.append_vectors(cells, freqs, str(tmp_path / "v"))
    stores.append_vectors(cells.where("target = 'b'").withColumn("w", -2 * F.col("w")), freqs, str(tmp_path / "v"))
    found = stores.read_vectors(spark, str(tmp_path / "v"))
    assert {tuple(r) for r in found.collect()} == {("a", 0, 8), ("a", 1, -4)}
    C.packed(found).explain()
    assert "Exchange" not in capsys.readouterr().out.split("Generate")[0]


def test_shares_without_a_positive_value():
    cells = pa.array([[{"idx": 0, "w": -3}], [{"idx": 0, "w": -4}, {"idx": 1, "w": -2}], [{"idx": 0, "w": 4}]])
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"]), cells], ["target", "cells"])
    (got,) = A.Shares(2).of(iter([batch]))
    assert [[c["w"] for c in r] for r in got.column(1).to_pylist()] == [[-np.inf], [2.0, 1.0], [1.0]]


def test_joined_cells(spark):
    kind = "i int, c array<struct<idx:int,w:{}>>"
    rows = [(0, [(3, 1), (10, -2)]), (1, []), (2, None), (3, [(3, 1)]), (4, [(0, 1 << 60), (7, -(1 << 60))])]
    got = {r.i: r.c for r in spark.createDataFrame(rows, kind.format("bigint")).select("i", joined_cells("c").alias("c")).collect()}
    assert got == {0: "3:1 10:-2", 1: "", 2: None, 3: "3:1", 4: f"0:{1 << 60} 7:{-(1 << 60)}"}
    halves = [(0, [(1, 0.0000005), (2, -0.0000015), (3, 0.4999999e-6), (4, 1 / 3), (5, -1.0)])]
    assert spark.createDataFrame(halves, kind.format("double")).select(joined_cells("c", 6)).first()[0] == "1:1 2:-2 3:0 4:333333 5:-1000000"
