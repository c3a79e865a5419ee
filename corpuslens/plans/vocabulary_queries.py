"""Registered queries: vocabulary and frequency operators on `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import stopwords
from corpuslens.functions.words import words
from corpuslens.operators import bloom, sketches
from corpuslens.operators import vocabulary as V
from corpuslens.operators.layout import spread_scan
from corpuslens.plans.registry import query, table
from corpuslens.session import scratch_path

DOCS = r"docs AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS t FROM documents)"
TOK = f"{DOCS}, tok AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM docs)"
FREQ = f"{TOK}, freqs AS (SELECT token, count(*) AS freq FROM tok GROUP BY token)"
VOCAB = f"{FREQ}, vocab AS (SELECT token, freq, row_number() OVER (ORDER BY freq DESC, token) - 1 AS id FROM freqs)"
BENCH = (
    r"bench AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS token FROM benchmark)"
)
STOP = "('" + "', '".join(w.replace("'", "''") for w in stopwords.ENGLISH) + "')"


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread_scan(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", words("text").alias("tokens"))


def bench_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), words("text").alias("tokens"))


def freqs(spark: SparkSession, sf: str) -> DataFrame:
    return V.word_frequencies(corpus(spark, sf))


def vocab(spark: SparkSession, sf: str) -> DataFrame:
    return V.build_vocabulary(freqs(spark, sf))


@query("v01_word_frequencies", f"WITH {FREQ} SELECT token, freq FROM freqs")
def word_frequencies(spark, sf):
    return freqs(spark, sf)


@query(
    "v02_merge_frequencies",
    rf"""WITH {FREQ}, more AS (SELECT unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS token
         FROM conversations)
         SELECT token, CAST(sum(n) AS BIGINT) AS freq FROM
         (SELECT token, freq AS n FROM freqs UNION ALL SELECT token, 1 FROM more) GROUP BY token""",
)
def merge_frequencies(spark, sf):
    turns = table(spark, sf, "conversations").select(words("text").alias("tokens"))
    return V.merge_frequencies(freqs(spark, sf), V.word_frequencies(turns))


@query("v03_most_common", f"WITH {FREQ} SELECT token, freq FROM freqs ORDER BY freq DESC, token LIMIT 50")
def most_common(spark, sf):
    return V.most_common(freqs(spark, sf), 50)


@query("v04_build_vocabulary", f"WITH {VOCAB} SELECT token, freq, id FROM vocab")
def build_vocabulary(spark, sf):
    return vocab(spark, sf)


@query(
    "v05_limit_vocabulary",
    f"""WITH {VOCAB} SELECT CASE WHEN id < 5000 THEN token ELSE '<unk>' END AS token,
        CAST(sum(freq) AS BIGINT) AS freq FROM vocab GROUP BY 1""",
)
def limit_vocabulary(spark, sf):
    return V.limit_vocabulary(freqs(spark, sf), 5000)


@query(
    "v06_replace_oov",
    f"""WITH {FREQ} SELECT doc_id, string_agg(CASE WHEN freq >= 5 THEN token ELSE '<unk>' END, ' ' ORDER BY pos)
        AS tokens FROM tok JOIN freqs USING (token) GROUP BY doc_id
        UNION ALL SELECT doc_id, '' FROM docs WHERE len(t) = 0""",
)
def replace_oov(spark, sf):
    known = V.frequency_cut(freqs(spark, sf), 5)
    return V.replace_oov(corpus(spark, sf), known).withColumn("tokens", F.array_join("tokens", " "))


@query(
    "v07_frequency_cut",
    f"""WITH {FREQ} SELECT CAST(c AS INTEGER) AS threshold, count(*) FILTER (freq >= c) AS survivors,
        count(*) AS total FROM freqs, (VALUES (2), (5), (10), (100)) x(c) GROUP BY c""",
)
def frequency_cut(spark, sf):
    return V.frequency_cut_report(freqs(spark, sf), [2, 5, 10, 100])


@query(
    "v08_corpus_stats",
    f"""WITH {FREQ} SELECT 'sentences' AS stat, '' AS token, count(*) AS value FROM docs
        UNION ALL SELECT 'total_words', '', CAST(sum(freq) AS BIGINT) FROM freqs
        UNION ALL SELECT 'unique_words', '', count(*) FROM freqs
        UNION ALL (SELECT 'top', token, freq FROM freqs ORDER BY freq DESC, token LIMIT 10)
        UNION ALL (SELECT 'last', token, freq FROM freqs ORDER BY freq, token DESC LIMIT 10)""",
)
def corpus_stats(spark, sf):
    return V.corpus_stats(corpus(spark, sf))


@query(
    "v09_rank_frequency",
    f"""WITH {VOCAB} SELECT id + 1 AS rank, token, freq, round(log10(id + 1), 9) AS log_rank,
        round(log10(freq), 9) AS log_freq FROM vocab WHERE id < 1000""",
)
def rank_frequency(spark, sf):
    ranked = V.rank_frequency(freqs(spark, sf), 1000)
    return ranked.withColumns({c: F.round(c, 9) for c in ("log_rank", "log_freq")})


@query(
    "v10_stopword_share",
    f"""WITH {FREQ} SELECT token IN {STOP} AS stopword, count(*) AS tokens, CAST(sum(freq) AS BIGINT) AS freq,
        round(sum(freq) / (SELECT sum(freq) FROM freqs), 9) AS share FROM freqs GROUP BY 1""",
)
def stopword_share(spark, sf):
    return V.stopword_share(freqs(spark, sf)).withColumn("share", F.round("share", 9))


@query(
    "v11_unigram_distribution",
    f"WITH {VOCAB} SELECT id, token, round(freq / (SELECT sum(freq) FROM vocab), 12) AS p FROM vocab",
)
def unigram_distribution(spark, sf):
    return V.unigram_distribution(vocab(spark, sf)).withColumn("p", F.round("p", 12))


@query(
    "v12_map_frequencies",
    rf"""WITH {VOCAB}, more AS (SELECT unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS token
         FROM conversations), f AS (SELECT token, count(*) AS freq FROM more GROUP BY token)
         SELECT id, f.freq FROM vocab JOIN f USING (token)""",
)
def map_frequencies(spark, sf):
    turns = table(spark, sf, "conversations").select(words("text").alias("tokens"))
    return V.map_frequencies(vocab(spark, sf), V.word_frequencies(turns))


@query(
    "v13_encode_ids",
    f"""WITH {VOCAB} SELECT doc_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids
        FROM tok JOIN vocab USING (token) GROUP BY doc_id UNION ALL SELECT doc_id, '' FROM docs WHERE len(t) = 0""",
)
def encode_ids(spark, sf):
    encoded = V.encode_ids(corpus(spark, sf), vocab(spark, sf))
    return encoded.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(
    "v13_encode_ids_drop",
    f"""WITH {VOCAB}, {BENCH}, known AS (SELECT token, row_number() OVER (ORDER BY freq DESC, token) - 1 AS id
        FROM freqs JOIN bench USING (token)),
        e AS (SELECT doc_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids
              FROM tok JOIN known USING (token) GROUP BY doc_id)
        SELECT doc_id, coalesce(ids, '') AS ids FROM docs LEFT JOIN e USING (doc_id)""",
)
def encode_ids_drop(spark, sf):
    gold = V.token_stream(bench_corpus(spark, sf))
    known = V.build_vocabulary(V.contains(freqs(spark, sf), gold))
    encoded = V.encode_ids(corpus(spark, sf), known, on_missing="drop")
    return encoded.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(
    "v14_decode_ids",
    """SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '\\p{L}+'), ' ') AS tokens FROM documents""",
)
def decode_ids(spark, sf):
    ids = vocab(spark, sf)
    encoded = V.encode_ids(corpus(spark, sf), ids)
    return V.decode_ids(encoded, ids).withColumn("tokens", F.array_join("tokens", " "))


@query("v15_contains", f"WITH {FREQ}, {BENCH} SELECT token FROM bench WHERE token IN (SELECT token FROM freqs)")
def contains(spark, sf):
    gold = V.token_stream(bench_corpus(spark, sf)).select("token").distinct()
    return V.contains(gold, freqs(spark, sf))


@query("v15_oov_words", f"WITH {FREQ}, {BENCH} SELECT token FROM freqs WHERE token NOT IN (SELECT token FROM bench)")
def oov_words(spark, sf):
    gold = V.token_stream(bench_corpus(spark, sf))
    return V.oov_words(V.token_stream(corpus(spark, sf)), gold.select("token").distinct())


@query(
    "v15_coverage",
    f"""WITH {FREQ}, {BENCH}, j AS (SELECT freq, CASE WHEN token IN (SELECT token FROM bench) THEN 1 ELSE 0 END AS hit
        FROM freqs) SELECT CAST(sum(hit) AS BIGINT) AS known_tokens, count(*) AS tokens,
        CAST(sum(hit * freq) AS BIGINT) AS known_words, CAST(sum(freq) AS BIGINT) AS words,
        round(sum(hit * freq) / sum(freq), 9) AS share FROM j""",
)
def coverage(spark, sf):
    gold = V.token_stream(bench_corpus(spark, sf)).select("token").distinct()
    return V.coverage(corpus(spark, sf), gold).withColumn("share", F.round("share", 9))


FILTER_BITS, FILTER_HASHES = 4096, 3


def bits_sql(token: str = "token") -> str:
    """SQL for the list of a token's bits in the filter."""
    number = lambda at: f"('0x' || substr(md5('0:' || {token}), {at}, 13))::BIGINT"
    return f"list_transform(range({FILTER_HASHES}), lambda i: ({number(1)} % {FILTER_BITS} + i * ({number(14)} % {FILTER_BITS - 1} + 1)) % {FILTER_BITS})"


@query(
    "v15_bloom_membership",
    f"""WITH {TOK}, {BENCH}, held AS (SELECT DISTINCT unnest({bits_sql()}) AS bit FROM bench),
        w AS (SELECT token, unnest({bits_sql()}) AS bit FROM (SELECT DISTINCT token FROM tok)),
        p AS (SELECT token, bool_and(held.bit IS NOT NULL) AS candidate FROM w LEFT JOIN held ON w.bit = held.bit GROUP BY token),
        c AS (SELECT p.token, candidate, bench.token IS NOT NULL AS member FROM p LEFT JOIN bench ON p.token = bench.token)
        SELECT doc_id, count(*) AS tokens, count(*) FILTER (candidate) AS candidates, count(*) FILTER (member) AS members
        FROM tok JOIN c USING (token) GROUP BY doc_id""",
)
def bloom_membership(spark, sf):
    """Tokens of each document, those that a small filter lets through, and those in the dictionary."""
    shape = bloom.Shape(FILTER_BITS, FILTER_HASHES)
    gold = V.token_stream(bench_corpus(spark, sf)).select("token").distinct()
    halves = [bloom.build(gold.where(F.length("token") % 2 == side), "token", shape) for side in (0, 1)]
    both = bloom.merge(halves[0].unionByName(halves[1]), shape)
    counted = V.token_stream(corpus(spark, sf)).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    total = counted.groupBy("doc_id").agg(F.sum("n").alias("tokens"))
    passed = bloom.prune(counted, "token", both, shape).join(gold.withColumn("_in", F.lit(1)), "token", "left")
    kept = passed.groupBy("doc_id").agg(F.sum("n").alias("candidates"), F.sum(F.col("n") * F.coalesce("_in", F.lit(0))).alias("members"))
    return total.join(kept, "doc_id", "left").select("doc_id", "tokens", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("candidates", "members")])


@query(
    "v16_add_signs",
    f"""WITH {FREQ}, {BENCH}, bf AS (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS token
        FROM benchmark), old AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS id
        FROM bf GROUP BY token)
        SELECT token, id FROM old UNION ALL
        SELECT token, (SELECT max(id) FROM old) + row_number() OVER (ORDER BY token) AS id
        FROM freqs WHERE token NOT IN (SELECT token FROM old)""",
)
def add_signs(spark, sf):
    old = V.build_vocabulary(V.word_frequencies(bench_corpus(spark, sf)))
    return V.add_signs(old, V.token_stream(corpus(spark, sf)))


@query("v17_remove_signs", f"WITH {VOCAB} SELECT token, freq, id FROM vocab WHERE token NOT IN {STOP}")
def remove_signs(spark, sf):
    stop = spark.createDataFrame([(w,) for w in stopwords.ENGLISH], "token string")
    return V.remove_signs(vocab(spark, sf), stop)


@query(
    "v18_subsample",
    f"""WITH {FREQ}, n AS (SELECT 0.0001::DOUBLE * sum(freq) AS cut FROM freqs),
        p AS (SELECT token, CASE WHEN freq < cut THEN 0.0 ELSE 1 - sqrt(cut / freq) END AS d FROM freqs, n),
        k AS (SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS tokens FROM tok JOIN p USING (token)
              WHERE ('0x' || substr(md5('7:' || doc_id || ':' || pos), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE >= d
              GROUP BY doc_id)
        SELECT doc_id, coalesce(tokens, '') AS tokens FROM docs LEFT JOIN k USING (doc_id)""",
)
def subsample(spark, sf):
    docs = corpus(spark, sf)
    kept = V.subsample(docs, V.word_frequencies(docs), seed=7)
    return kept.withColumn("tokens", F.array_join("tokens", " "))


@query(
    "v19_split_corpus",
    """WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
       n AS (SELECT count(*) AS n, floor(0.8::DOUBLE * count(*)) AS tr FROM documents)
       SELECT doc_id, CASE WHEN i < tr THEN 'train' WHEN i < tr + floor((n - tr) / 2) THEN 'valid' ELSE 'test' END
       AS split FROM i, n""",
)
def split_corpus(spark, sf):
    return V.split_corpus(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query(
    "v19_hash_split",
    """WITH u AS (SELECT doc_id, ('0x' || substr(md5('3:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
       FROM documents) SELECT doc_id, CASE WHEN u < 0.8::DOUBLE THEN 'train'
       WHEN u < 0.9::DOUBLE THEN 'valid' ELSE 'test' END AS split FROM u""",
)
def hash_split(spark, sf):
    return V.hash_split(table(spark, sf, "documents").select("doc_id"), "doc_id", seed=3)


def registers_sql(words: str, bits: int, name: str = "registers") -> str:
    """SQL for the non-empty registers of the tokens in `words`: (cell, value)."""
    return f"""dg_{name} AS (SELECT md5('d0:' || token) AS h FROM {words}),
        rest_{name} AS (SELECT ('0x' || substr(h, 1, 4))::BIGINT % {1 << bits} AS cell, ('0x' || substr(h, 5, 12))::BIGINT AS r FROM dg_{name}),
        {name} AS (SELECT cell, max(49 - CASE WHEN r = 0 THEN 0 ELSE len(bin(r)) END) AS value FROM rest_{name} GROUP BY cell)"""


def estimate_sql(bits: int, name: str = "registers") -> str:
    """SQL for the number of distinct tokens, from registers of 7 bits at least."""
    m = 1 << bits
    return f"""(SELECT CASE WHEN raw <= {2.5 * m}::DOUBLE AND empty > 0 THEN {m}::DOUBLE * ln({m}::DOUBLE / empty) ELSE raw END FROM
        (SELECT {m} - count(*) AS empty, {0.7213 / (1 + 1.079 / m) * m * m}::DOUBLE / ({m} - count(*) + sum(pow(2.0::DOUBLE, -value))) AS raw FROM {name}))"""


@query(
    "v20_approximate_stats",
    f"""WITH {FREQ}, {registers_sql('freqs', 14)} SELECT CAST(sum(freq) AS BIGINT) AS total_words,
        CAST(round({estimate_sql(14)}) AS BIGINT) AS approx_unique_words, count(*) AS unique_words FROM freqs""",
)
def approximate_stats(spark, sf):
    """The estimate beside the exact number of distinct words."""
    exact = freqs(spark, sf).agg(F.count("*").alias("unique_words"))
    return V.approximate_stats(corpus(spark, sf), 0.01).crossJoin(exact)  # one row each


EPS = 0.0005
COUNTED = sketches.Sizes.of(rsd=0.01, eps=EPS, delta=0.01)


def counter_sql(token: str = "token") -> str:
    """SQL for the list of a token's cells in the count-min sketch."""
    hashes = [f"('0x' || substr(md5('c0.{r // 4}:' || {token}), {8 * (r % 4) + 1}, 8))::BIGINT % {COUNTED.width} + {r * COUNTED.width}" for r in range(COUNTED.depth)]
    return f"[{', '.join(hashes)}]"


def stored_sketches(spark, sf):
    """Sketches of the documents by source, written once and read back."""
    path = scratch_path(spark, "sketches")
    docs = spread_scan(table(spark, sf, "documents").select("doc_id", "text", "source"), "doc_id")
    parts = sketches.corpus_sketches(docs.select("source", words("text").alias("tokens")), F.col("source"), COUNTED)
    parts.write.parquet(path)
    return spark.read.schema(parts.schema).parquet(path)


@query(
    "v20_merged_counts",
    f"""WITH {FREQ}, asked AS (SELECT token, freq, unnest({counter_sql()}) AS cell FROM freqs),
        sketch AS (SELECT cell, sum(freq) AS value FROM asked GROUP BY cell)
        SELECT token, freq, CAST(min(value) AS BIGINT) AS estimate,
          min(value) - freq <= {EPS}::DOUBLE * (SELECT sum(freq) FROM freqs) AS within
        FROM asked JOIN sketch USING (cell) GROUP BY token, freq""",
)
def merged_counts(spark, sf):
    """Counts of all words from the stored sketches of the sources, merged; beside the exact ones."""
    whole = sketches.merge_sketches(stored_sketches(spark, sf), sizes=COUNTED)
    found = sketches.count_estimates(freqs(spark, sf), whole, COUNTED)
    n = whole.select("n").scalar()
    return found.withColumn("within", F.col("estimate") - F.col("freq") <= EPS * n)


@query(
    "v20_merged_distinct",
    rf"""WITH d AS (SELECT source, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS token FROM documents),
        w AS (SELECT 'of ' || source AS part, token, count(*) AS n FROM d GROUP BY 1, 2
              UNION ALL SELECT 'all', token, count(*) FROM d GROUP BY token),
        h AS (SELECT part, md5('d0:' || token) AS h FROM w),
        x AS (SELECT part, ('0x' || substr(h, 1, 4))::BIGINT % {1 << COUNTED.bits} AS cell, ('0x' || substr(h, 5, 12))::BIGINT AS r FROM h),
        allregs AS (SELECT part, cell, max(49 - CASE WHEN r = 0 THEN 0 ELSE len(bin(r)) END) AS value FROM x GROUP BY part, cell),
        exact AS (SELECT part, CAST(sum(n) AS BIGINT) AS n, count(*) AS unique_words FROM w GROUP BY part)
        SELECT part, n, unique_words, CAST(round({estimate_sql(COUNTED.bits, '(FROM allregs WHERE allregs.part = exact.part)')}) AS BIGINT) AS estimate
        FROM exact""",
)
def merged_distinct(spark, sf):
    """Estimated and exact distinct words of each source, and of all by the merged sketch."""
    parts = stored_sketches(spark, sf).withColumn("part", F.concat(F.lit("of "), "part"))
    every = parts.unionByName(sketches.merge_sketches(parts, sizes=COUNTED))
    estimates = every.select("part", "n", F.round(sketches.distinct_estimate(F.col("registers"), COUNTED)).cast("long").alias("estimate"))
    docs = table(spark, sf, "documents").select(F.concat(F.lit("of "), "source").alias("part"), F.explode(words("text")).alias("token")).distinct()
    exact = docs.groupBy("part").agg(F.count("*").alias("unique_words")).unionByName(
        docs.agg(F.lit("all").alias("part"), F.count_distinct("token").alias("unique_words"))
    )
    return estimates.join(exact, "part")


@query(
    "v20_heavy_hitters",
    f"""WITH {FREQ} SELECT token, freq FROM freqs
        WHERE freq >= 0.005::DOUBLE * (SELECT sum(freq) FROM freqs)""",
)
def heavy_hitters(spark, sf):
    return V.heavy_hitters(corpus(spark, sf))
