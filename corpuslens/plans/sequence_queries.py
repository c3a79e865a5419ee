"""Registered queries: windows, n-grams, batches and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions.words import words
from corpuslens.operators import batching as B
from corpuslens.operators import sequences as S
from corpuslens.operators import vocabulary as V
from corpuslens.operators.ordering import ordered_index, take
from corpuslens.plans.registry import query, table
from corpuslens.plans.vocabulary_queries import DOCS, FREQ, TOK, VOCAB, corpus, vocab

GLOBAL = f"{TOK}, seq AS (SELECT token, row_number() OVER (ORDER BY doc_id, pos) - 1 AS g FROM tok)"
TURNS = r"""turns AS (SELECT conv_id, turn, conv_id || ':' || turn AS item,
            row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx FROM conversations)"""


def turns(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn")
    return rows.withColumn("item", F.concat_ws(":", "conv_id", "turn"))


def turn_corpus(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", words("text").alias("tokens"))


def spaced(*names: str):
    return {c: F.array_join(F.col(c).cast("array<string>"), " ") for c in names}


@query(
    "q01_context_windows",
    f"""WITH {DOCS}, p AS (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM docs)
        SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, t[i] AS target,
        array_to_string(t[greatest(i - 3, 1):i - 1], ' ') AS "left", array_to_string(t[i + 1:i + 3], ' ') AS "right"
        FROM p""",
)
def context_windows(spark, sf):
    return S.context_windows(corpus(spark, sf), 3).withColumns(spaced("left", "right"))


@query(
    "q02_context_pairs",
    f"""WITH {TOK}, p AS (SELECT a.doc_id, a.token AS target, b.token || ':' || (b.pos - a.pos) AS c
        FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos - 2 AND a.pos + 2 AND a.pos <> b.pos)
        SELECT doc_id, target, string_agg(c, ' ' ORDER BY c) AS contexts FROM p GROUP BY 1, 2""",
)
def context_pairs(spark, sf):
    """One row for each target of a document, with all its contexts and their offsets."""
    pairs = S.context_pairs(corpus(spark, sf), 2).withColumn("c", F.concat_ws(":", "context", "offset"))
    listed = pairs.groupBy("doc_id", "target").agg(F.sort_array(F.collect_list("c")).alias("contexts"))
    return listed.withColumns(spaced("contexts"))


@query(
    "q03_ngrams",
    f"""WITH {DOCS}, p AS (SELECT doc_id, t, unnest(range(1, len(t) - 1)) AS i FROM docs)
        SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, array_to_string(t[i:i + 2], ' ') AS ngram FROM p""",
)
def ngrams(spark, sf):
    return S.ngrams(corpus(spark, sf), 3).withColumns(spaced("ngram"))


@query(
    "q04_ngrams_flat",
    f"""WITH {GLOBAL}, w AS (SELECT g AS idx, token || ' ' || lead(token, 1) OVER o || ' ' || lead(token, 2) OVER o
        || ' ' || lead(token, 3) OVER o AS ngram FROM seq WINDOW o AS (ORDER BY g))
        SELECT idx, ngram FROM w WHERE ngram IS NOT NULL""",
)
def ngrams_flat(spark, sf):
    return S.ngrams_flat(corpus(spark, sf), 4, block=1000).withColumns(spaced("ngram"))


@query(
    "q05_adjacent_pairs",
    f"""WITH {TOK}, w AS (SELECT doc_id, CAST(pos AS INTEGER) AS i, token AS "first",
        lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS "second" FROM tok)
        SELECT * FROM w WHERE "second" IS NOT NULL""",
)
def adjacent_pairs(spark, sf):
    return S.adjacent_pairs(corpus(spark, sf))


@query(
    "q06_ngram_counts",
    f"""WITH {DOCS}, p AS (SELECT t, unnest(range(1, len(t) - 1)) AS i FROM docs)
        SELECT array_to_string(t[i:i + 2], ' ') AS ngram, count(*) AS freq FROM p GROUP BY 1""",
)
def ngram_counts(spark, sf):
    return S.ngram_counts(corpus(spark, sf), 3).withColumns(spaced("ngram"))


@query("q07_flatten", f"WITH {TOK} SELECT doc_id, CAST(pos AS INTEGER) AS pos, token FROM tok")
def flatten(spark, sf):
    return V.token_stream(corpus(spark, sf))


@query("q08_take", "SELECT conv_id, turn, text FROM conversations ORDER BY conv_id, turn LIMIT 100")
def take_rows(spark, sf):
    return take(table(spark, sf, "conversations").select("conv_id", "turn", "text"), 100, "conv_id", "turn")


@query("q09_skip", "SELECT conv_id, turn, text FROM conversations ORDER BY conv_id, turn OFFSET 20")
def skip(spark, sf):
    return S.skip(table(spark, sf, "conversations").select("conv_id", "turn", "text"), 20, "conv_id", "turn")


@query(
    "q10_batch",
    f"""WITH {TURNS} SELECT idx // 32 AS batch, string_agg(item, ' ' ORDER BY idx) ||
        repeat(' pad', 32 - count(*)) AS items FROM turns GROUP BY 1""",
)
def batch(spark, sf):
    return B.batch(turns(spark, sf), "item", 32, "conv_id", "turn", pad=F.lit("pad")).withColumns(spaced("items"))


@query(
    "q11_divide_slices",
    f"""WITH {TURNS} SELECT conv_id, turn,
        least(idx // ((SELECT count(*) FROM turns) // 7), 6) AS slice FROM turns""",
)
def divide_slices(spark, sf):
    return S.add_slices(turns(spark, sf).drop("item"), 7, "conv_id", "turn")


@query("q12_row_range", f"WITH {TURNS} SELECT conv_id, turn, idx FROM turns WHERE idx >= 50 AND idx < 350")
def row_range(spark, sf):
    return S.row_range(turns(spark, sf).drop("item"), 50, 350, "conv_id", "turn")


@query(
    "q13_repeat_each",
    "SELECT conv_id, turn, CAST(c AS INTEGER) AS copy FROM conversations, range(0, 3) r(c)",
)
def repeat_each(spark, sf):
    return S.repeat_each(turns(spark, sf).drop("item"), 3)


@query(
    "q13_repeat_epochs",
    "SELECT conv_id, turn, CAST(c AS INTEGER) AS epoch FROM conversations, range(0, 2) r(c)",
)
def repeat_epochs(spark, sf):
    return S.repeat_epochs(turns(spark, sf).drop("item"), 2)


@query(
    "q14_chain",
    """SELECT item_id AS id, text, 0 AS source FROM benchmark UNION ALL
       SELECT doc_id, text, 1 FROM documents""",
)
def chain(spark, sf):
    first = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return S.chain(first, table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


@query(
    "q15_shuffle",
    f"""WITH {TURNS} SELECT conv_id, turn, (idx // 100) * 100 + row_number() OVER
        (PARTITION BY idx // 100 ORDER BY md5('5:' || idx), idx) - 1 AS idx FROM turns""",
)
def shuffle(spark, sf):
    rows = ordered_index(turns(spark, sf).drop("item"), "conv_id", "turn")
    return B.shuffle(rows, 100, seed=5)


@query(
    "q15_shuffle_global",
    """SELECT doc_id, row_number() OVER (ORDER BY md5('5:' || doc_id), doc_id) - 1 AS idx FROM documents""",
)
def shuffle_global(spark, sf):
    return B.shuffle_global(table(spark, sf, "documents").select("doc_id"), F.col("doc_id"), seed=5)


TURN_SEQ = r"""t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '\p{L}+') AS t FROM conversations),
 u AS (SELECT conv_id, turn, unnest(t) AS token, generate_subscripts(t, 1) AS p FROM t),
 seq AS (SELECT token, row_number() OVER (ORDER BY conv_id, turn, p) - 1 AS g FROM u),
 m AS (SELECT count(*) // 8 AS m FROM seq),
 s AS (SELECT token, g // m AS stream, g % m AS col, m FROM seq, m WHERE g < m * 8),
 n AS (SELECT stream, col, m, token, lead(token) OVER (PARTITION BY stream ORDER BY col) AS nxt FROM s)"""


@query(
    "q16_parallel_sequences",
    f"""WITH {TURN_SEQ} SELECT col // 20 AS segment, stream, string_agg(token, ' ' ORDER BY col) AS inputs,
        string_agg(nxt, ' ' ORDER BY col) AS targets FROM n WHERE col < m - 1 GROUP BY 1, 2""",
)
def parallel_sequences(spark, sf):
    cut = B.parallel_sequences(turn_corpus(spark, sf), 8, 20, "conv_id", "turn")
    return cut.withColumns(spaced("inputs", "targets"))


HASH = "('0x' || substr(md5('1:' || segment{salt}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query(
    "q16_parallel_sequences_random",
    f"""WITH {TURN_SEQ}, k AS (SELECT segment, {HASH.format(salt='')} AS u,
          greatest({HASH.format(salt=" || ':r'")}, 1e-10::DOUBLE) AS u1, {HASH.format(salt=" || ':t'")} AS u2
          FROM m, range(0, m) r(segment)),
        l AS (SELECT segment, greatest(5, CAST(trunc((CASE WHEN u < 0.95::DOUBLE THEN 20 ELSE 10 END)
          + 5 * sqrt(-2 * ln(u1)) * cos(2 * pi() * u2)) AS BIGINT)) AS len FROM k),
        c AS (SELECT segment, CAST(sum(len) OVER (ORDER BY segment) AS BIGINT) - len AS lower, len FROM l)
        SELECT segment, stream, string_agg(token, ' ' ORDER BY col) AS inputs, string_agg(nxt, ' ' ORDER BY col) AS targets
        FROM n ASOF JOIN c ON n.col >= c.lower WHERE col < m - 1 GROUP BY 1, 2""",
)
def parallel_sequences_random(spark, sf):
    cut = B.parallel_sequences(turn_corpus(spark, sf), 8, 20, "conv_id", "turn", min_len=5, seq_prob=0.95, seed=1)
    return cut.withColumns(spaced("inputs", "targets"))


@query(
    "q17_to_ngrams",
    f"""WITH {VOCAB}, e AS (SELECT doc_id, list(id ORDER BY pos) AS t FROM tok JOIN vocab USING (token) GROUP BY doc_id),
        p AS (SELECT doc_id, t, unnest(range(1, len(t) - 3)) AS i FROM e),
        g AS (SELECT array_to_string(t[i:i + 4], ' ') AS ngram,
              row_number() OVER (ORDER BY doc_id, i) - 1 AS idx FROM p)
        SELECT CAST(ep AS INTEGER) AS epoch, idx // 256 AS batch, string_agg(ngram, ' ' ORDER BY idx) AS items
        FROM g, range(0, 2) r(ep) GROUP BY 1, 2""",
)
def to_ngrams(spark, sf):
    batches = B.ngram_batches(
        corpus(spark, sf), vocab(spark, sf), n=5, epochs=2, batch_size=256, shuffle_rows=False
    )
    return batches.withColumn("items", F.array_join(F.flatten("items").cast("array<string>"), " "))


@query(
    "q17_to_ngrams_shuffled",
    f"""WITH {VOCAB}, seq AS (SELECT id, row_number() OVER (ORDER BY doc_id, pos) - 1 AS g FROM tok JOIN vocab USING (token)),
        w AS (SELECT g AS idx, id || ' ' || lead(id, 1) OVER o || ' ' || lead(id, 2) OVER o || ' ' || lead(id, 3) OVER o
              || ' ' || lead(id, 4) OVER o AS ngram FROM seq WINDOW o AS (ORDER BY g)),
        p AS (SELECT ngram, (idx // 10000) * 10000 + row_number() OVER
              (PARTITION BY idx // 10000 ORDER BY md5('3:0:' || idx), idx) - 1 AS spot FROM w WHERE ngram IS NOT NULL)
        SELECT 0 AS epoch, spot // 256 AS batch, string_agg(ngram, ' ' ORDER BY spot) AS items FROM p GROUP BY 2""",
)
def to_ngrams_shuffled(spark, sf):
    batches = B.ngram_batches(
        corpus(spark, sf), vocab(spark, sf), n=5, batch_size=256, buffer_size=10_000, flatten=True, seed=3
    )
    return batches.withColumn("items", F.array_join(F.flatten("items").cast("array<string>"), " "))


@query(
    "q18_context_target",
    f"""WITH {DOCS}, p AS (SELECT doc_id, t, unnest(range(1, len(t) - 3)) AS i FROM docs)
        SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, array_to_string(t[i:i + 3], ' ') AS context, t[i + 4] AS target
        FROM p""",
)
def context_target(spark, sf):
    return S.context_target(S.ngrams(corpus(spark, sf), 5)).withColumns(spaced("context"))


@query(
    "q19_enumerate_within",
    f"""WITH {FREQ} SELECT token, unnest(range(0, freq)) AS i FROM freqs""",
)
def enumerate_within(spark, sf):
    return S.enumerate_within(V.word_frequencies(corpus(spark, sf)), "freq").select("token", "i")
