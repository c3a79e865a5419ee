import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpuslens.llm import queries
from corpuslens.llm import token_counts as tc

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
PIECES = ["a", "B", "'", "s", " ", "\n", "1", "é", "É", "́", "̱", "😀", "<|endoftext|>", "<|", "|>"]
PIECES += ["ß", "İ", "Σ", "ﬀ", "字", "\x1c", "\x85", " ", "_", "don't", "THE", "ſ", "ͅ", "\x00", "the "]


@pytest.fixture(scope="module")
def proof():
    return tc.prove(PATH)


def expected(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op12_count_tokens(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_tokens == expected(texts[r.doc_id])
        assert (r.n_bytes, r.over_limit) == (len((texts[r.doc_id] or "").encode()), r.n_tokens > 2048)
        assert 0 <= r.n_direct + r.n_merged <= r.n_tokens
    assert sum(r.n_direct for r in rows) > 0


def test_odd_texts(proof):
    counter, rnd = tc.Counter(proof), random.Random(3)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 30))) for _ in range(5000)]
    texts += ["A<|endoftext|>b", "<|ENDOFTEXT|> <|startoftext|><|endoftext|>", "H̱ ẖ", "a" * 3000, "'" * 300]
    for text in texts:
        assert counter.of(text)[0] == expected(text), text


def test_long_text_is_whole(proof):
    text = "some Words, isn't it é " * 200_000 + "<|endoftext|>"
    assert tc.Counter(proof).of(text)[0] == 200_000 * expected("some Words, isn't it é") + 1


def test_proof_holds_for_each_string(proof):
    byte_level = set(proof.direct)
    assert 30_000 < len(byte_level) < 49_406
    for body in random.Random(1).sample(sorted(byte_level), 2000):
        assert len(LIBRARY.model.tokenize(body)) == 1


def test_a_full_memory_changes_nothing(proof, monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", 3)
    counter = tc.Counter(proof)
    assert counter.of("one two three four five one two")[0] == expected("one two three four five one two")
    assert len(counter) <= 3


def test_odd_rows_and_columns(spark, proof):
    df = spark.createDataFrame(
        [(1, None, "x"), (1, "", "x"), (None, "a b", "x"), (None, "a b", "x"), (2, "the", "x")], "doc_id long, text string, N_TOKENS string"
    )
    out = tc.token_counts(df, proof, 1)
    assert out.columns == ["doc_id", "text", "n_bytes", "n_tokens", "n_direct", "n_merged", "over_limit"]
    assert sorted(r.n_tokens for r in out.collect()) == [0, 0, 1, 2, 2]
    assert sorted(r.over_limit for r in out.collect()) == [False, False, False, True, True]
    assert tc.token_counts(df.limit(0), proof).count() == 0


def test_other_layouts_are_refused():
    with pytest.raises(ValueError):
        tc.prove(public_tokenizers.path("byte_bpe_50k.json"))
