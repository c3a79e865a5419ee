import random

import pytest

from corpuslens.llm import near_duplicates as nd
from corpuslens.llm import queries

SF = "/root/testdata/sf0.01"


def shingles(text, width=4):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [w for w in _split((text or "").translate(lower)) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def _split(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return text.split(" ")


def brute(docs, width=4):
    """Rows (doc_id, n, component_id, kept) from all pairs that share a shingle."""
    sets = [shingles(t, width) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    lists = {}
    for i, s in enumerate(sets):
        for x in s:
            lists.setdefault(x, []).append(i)
    seen = set()
    for members in lists.values():
        for k, i in enumerate(members):
            for j in members[:k]:
                if (j, i) not in seen:
                    seen.add((j, i))
                    common = len(sets[i] & sets[j])
                    if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                        root[find(i)] = find(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(docs[i][0])
    out = []
    for i, (doc_id, _) in enumerate(docs):
        ids = [x for x in groups[find(i)] if x is not None]
        component = min(ids) if ids and sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


def test_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.op4_near_duplicates(spark, SF)) == brute(docs)


def varied(words, changes, rng, names):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = next(names)
    return " ".join(out)


def odd_documents():
    rng = random.Random(5)
    names = (f"new{i}" for i in range(10**9))
    word = lambda: f"w{rng.randrange(4000)}"
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "a b c"), (7, "A  B\tC"), (8, "a b c d"), (9, "a b c d e"), (None, "a b c d"), (None, "only here"), (10, "é É"), (10, "é É"), (11, "x y z w v")]
    base = [word() for _ in range(400)]
    docs += [(i, varied(base, rng.randrange(0, 9), rng, names)) for i in range(100, 300)]  # a large group of near copies
    docs += [(i, " ".join(base)) for i in range(300, 360)]  # and copies
    passage = " ".join(word() for _ in range(60))
    docs += [(i, passage + " " + " ".join(word() for _ in range(rng.randrange(5, 60)))) for i in range(400, 640)]  # a shared passage
    chain = [word() for _ in range(200)]
    for i in range(700, 740):  # neighbours are linked, the ends are not
        docs.append((i, " ".join(chain)))
        chain = chain[5:] + [word() for _ in range(5)]
    for i in range(800, 860):  # at the border of the threshold
        own = [word() for _ in range(60)]
        docs += [(2 * i, " ".join(own)), (2 * i + 1, varied(own, 1 + i % 4, rng, names))]
    docs.append((5000, " ".join(word() for _ in range(60_000))))
    docs.append((5001, docs[-1][1] + " and more"))
    return docs


@pytest.mark.parametrize("few", [4, 0])
def test_odd_rows_and_every_path(spark, make, monkeypatch, few):
    """With few = 0 pairs are only left to the last resort: lists over full sets."""
    monkeypatch.setattr(nd, "FEW", few)
    monkeypatch.setattr(nd, "FEW_EXACT", few)
    docs = odd_documents()
    path = make([(d, t, None, None, None) for d, t in docs])
    assert rows_of(queries.op4_near_duplicates(spark, path)) == brute(docs)


def test_empty(spark, make):
    path = make([])
    assert queries.op4_near_duplicates(spark, path).count() == 0
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert nd.deduplicated(docs).count() == 0


def test_one_of_each_group_stays(spark, make):
    docs = odd_documents()
    path = make([(d, t, None, None, None, 1, "x") for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long, n int, mark string")
    table = spark.read.parquet(f"{path}/documents.parquet")
    left = nd.deduplicated(table, width=4)
    assert left.columns == table.columns
    left = left.collect()
    groups = {}
    sets = {}
    for (doc_id, text), row in zip(sorted(docs, key=repr), sorted(docs, key=repr), strict=True):
        sets[repr((doc_id, text))] = shingles(text)
    component = {}
    for doc_id, n, comp, _ in brute(docs):
        component[doc_id] = comp
    for r in left:
        if shingles(r.text) and r.doc_id is not None:
            assert component[r.doc_id] not in groups
            groups[component[r.doc_id]] = r.doc_id
    assert {d for d, t in docs if not shingles(t)} <= {r.doc_id for r in left}
    assert {c for d, c in component.items() if d is not None and c not in (1, 2, 3)} == set(groups)


def test_floor_of():
    assert nd.floor_of(64) < 0.5 * 64 and nd.floor_of(64, miss=1e-3) > nd.floor_of(64)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 7), (200, 201), (202, 201)]
    got = {r.node: r.comp for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 0, 200: 200, 201: 200, 202: 200}


def test_texts_under_one_id_travel_to_their_own_candidates_only(spark, make, monkeypatch):
    rng, names = random.Random(8), (f"new{i}" for i in range(10**9))
    docs = []
    for i in range(60):
        words = [f"t{i}w{j}" for j in range(60)]
        docs += [(None if i % 2 else 7, varied(words, changes, rng, names)) for changes in (0, 1, 1)]
    docs += docs[:1] * 20
    sent, kind = [], type(spark.range(0))

    def counted(df, *args, made=kind.mapInArrow, **named):
        if "role" in df.columns:
            sent.append((df.count(), df.select("a", "part", "node").distinct().count()))
        return made(df, *args, **named)

    monkeypatch.setattr(kind, "mapInArrow", counted)
    path = make([(d, t, None, None, None) for d, t in docs])
    assert rows_of(queries.op4_near_duplicates(spark, path)) == brute(docs)
    assert sent and all(rows == wanted for rows, wanted in sent)


def counted_calls(monkeypatch, name, label=None):
    calls, made = [], getattr(nd, name)

    def counted(*args, **named):
        if label in (None, *args[1:2]):
            calls.append(1)
        return made(*args, **named)

    monkeypatch.setattr(nd, name, counted)
    return calls


def test_components_that_are_stars_already_need_no_round(spark, monkeypatch):
    calls = counted_calls(monkeypatch, "stored_at", "links")
    got = {r.node: r.comp for r in nd.components(spark.createDataFrame([(0, i) for i in range(1, 40)] + [(60, 50)], "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(40)}, 50: 50, 60: 50} and len(calls) == 1


def test_rounds_end_when_they_leave_nearly_as_many_pairs(spark, make, monkeypatch):
    """With FALLING = 0 the second round over full sets tests all pairs that are left."""
    for name in ("FEW", "FEW_EXACT", "FALLING"):
        monkeypatch.setattr(nd, name, 0)
    calls = counted_calls(monkeypatch, "verified")
    docs = odd_documents()
    assert rows_of(queries.op4_near_duplicates(spark, make([(d, t, None, None, None) for d, t in docs]))) == brute(docs)
    assert len(calls) <= 3


def test_near_copies_beyond_the_threshold_are_not_all_paired(spark, make, monkeypatch):
    """The pairs of the lists over full sets grew with the square of such a group."""
    rng, names = random.Random(11), (f"new{i}" for i in range(10**9))
    base, common = [f"b{i}" for i in range(150)], [f"c{i}" for i in range(3)]
    docs = []
    for i in range(240):
        words = varied(base, rng.randrange(8), rng, names).split(" ")
        for at in rng.sample(range(0, 150, 10), rng.randrange(6)):  # edits that others have, too
            words[at] = rng.choice(common)
        docs.append((i, " ".join(words)))
    monkeypatch.setattr(nd, "FEW", 0)
    pairs, made = [], nd.stored

    def counted(df, label):
        out = made(df, label)
        if label == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(nd, "stored", counted)
    assert rows_of(queries.op4_near_duplicates(spark, make([(d, t, None, None, None) for d, t in docs]))) == brute(docs)
    assert sum(pairs[1:]) < len(docs)


@pytest.mark.parametrize("buckets, levels", [(512, 3), (64, 1)])
def test_histograms_bound_the_common_values(spark, monkeypatch, buckets, levels):
    monkeypatch.setattr(nd, "BUCKETS", buckets)
    monkeypatch.setattr(nd, "LEVELS", levels)
    rng = random.Random(12)
    sets = [set(rng.sample(range(400), rng.randrange(50, 300))) | {1000 + i} for i in range(12)]
    values = spark.createDataFrame([(i, len(s), v) for i, s in enumerate(sets) for v in s], "node long, n long, value long")
    rows = {r.node: r for r in nd.index_of(values, nd.F.lit(1), nd.F.lit(1), histogram=True).collect()}
    assert len(rows) == len(sets)
    for a, one in enumerate(sets):
        for b, two in enumerate(sets[:a]):
            x, y = rows[a], rows[b]
            bound = sum(((i & j) & (2**64 - 1)).bit_count() for i, j in zip(x.bits, y.bits, strict=True)) + min(x.over, y.over)
            assert len(one & two) <= bound <= min(x.weight, y.weight)
            assert levels == 1 or bound == len(one & two)  # 400 values in 512 buckets
