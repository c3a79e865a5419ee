import random
import re
import zlib
from collections import Counter

import pytest

from corpuslens.llm import queries
from corpuslens.llm import spelling as sp

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_near(words):
    """The near words of each word, from all words that become equal when a code point goes."""
    forms = {}
    for w in words:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            forms.setdefault(v, set()).add(w)
    return {w: {x for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for x in forms[v] if one_edit(w, x)} for w in words}


def brute_counts(docs, every=199, least=6):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                out[run] += 1
    return out


def brute(counts, ratio=5, min_count=5):
    counts = {w: n for w, n in counts.items() if n >= min_count}
    near, form = brute_near(counts), {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out)


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def random_words(rnd, count, letters="abé", longest=9):
    return sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(0, longest))) for _ in range(count)})


def test_documents(spark, db):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(brute_counts(docs))
    assert len(want) > 100 and any(r[4] for r in want)
    assert rows_of(queries.op11_group_spellings(spark, SF)) == want
    sql = db.execute(queries.ORACLE["op11_group_spellings"])
    places = [[c[0] for c in sql.description].index(c) for c in ("word", "form", "root", "n", "n_near", "form_n")]
    assert sorted(tuple(r[i] for i in places) for r in sql.fetchall()) == want


def test_edit_rows_against_all_prefixes():
    for a in random_words(random.Random(5), 80):
        for b in random_words(random.Random(6), 80):
            assert (not one_edit(a, b)) or sp.may_hold(a, 0, b)
            if sp.common(a, b) >= sp.halves(a)[0]:
                assert list(sp.SortedList([b], [0]).near(a, sp.halves(a)[0])) == ([0] if one_edit(a, b) else [])


def test_a_scan_finds_all_and_jumps():
    words = random_words(random.Random(2), 900)
    near, listed = brute_near(words), sp.SortedList(words, sp.shared_prefixes(words))
    for w in words:
        assert {words[i] for i in listed.near(w, 0)} == near[w]


@pytest.mark.parametrize("block", [3, 50])
def test_near_words_over_many_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(sp, "BLOCK", block)
    monkeypatch.setattr(sp, "ASKED", 7)
    rnd = random.Random(4)
    counts = {w: rnd.randint(1, 9) for w in random_words(rnd, 500)}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.n_near, r.near, r.near_n) for r in sp.near_words(vocab).collect()}
    near = brute_near(counts)
    best = {w: min(x, key=lambda v: (-counts[v], v)) for w, x in near.items() if x}
    assert got == {w: (len(near[w]), b, counts[b]) for w, b in best.items()}


def test_hot_beginning(spark, monkeypatch):
    monkeypatch.setattr(sp, "BLOCK", 40)
    rnd = random.Random(9)
    counts = {"commonbeginning" + w: rnd.choice([5, 6, 40, 900]) for w in random_words(rnd, 400, "abc", 6)}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(sp.forms(vocab)) == brute(counts)


def test_chains(spark):
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625, "zzzzzz": 7, "zzzzzy": 34}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = {r.word: r for r in sp.forms(vocab).collect()}
    assert {rows[w].root for w in counts if w[0] == "a"} == {"abbbbb"}
    assert rows["zzzzzz"].form is None and rows["zzzzzz"].root == "zzzzzz"
    assert rows_of(sp.forms(vocab)) == brute(counts)


def test_odd_rows(spark, make):
    text = "Zürich ZÜRICH zürich x×÷y Abcdef abcdeF abcde abcdefg"
    docs = [(1, None), (1, ""), (None, text), (None, text), (2, "Abcdef " * 50_000), *[(i, text) for i in range(3, 400)]]
    docs += [(7, "q" * 3_000_000)]
    path = make([(d, t, None, None, None) for d, t in docs])
    assert rows_of(queries.op11_group_spellings(spark, path)) == brute(brute_counts(docs))
    assert queries.op11_group_spellings(spark, make([])).count() == 0
    named = spark.createDataFrame([(i, text, "x", 5) for i in range(9)], "doc_id long, text string, word string, N long")
    assert sp.spelling_groups(named).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(sp.spelling_groups(named)) == brute(brute_counts([(i, text) for i in range(9)], every=1 << 60))


def test_portions_and_flushes_change_nothing(spark, monkeypatch):
    docs = [(i, f"alphabet betabet gammas{i % 7} " * 30) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(sp, "HELD_WORDS", 2)
    got = {r.word: r.n for r in sp.word_counts(df, 6, sp.with_slips(7)).collect()}
    assert got == brute_counts(docs, every=7)
