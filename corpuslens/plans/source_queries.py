"""Registered queries: files written from the tables and read back, and streams over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions.words import words
from corpuslens.operators import context as C
from corpuslens.operators import random_index as RI
from corpuslens.operators import sequences as S
from corpuslens.operators import text as TX
from corpuslens.operators import vocabulary as V
from corpuslens.operators.layout import place
from corpuslens.plans.index_queries import CELLS_SQL, K, RI_SQL, accumulated_sql, vector_rows
from corpuslens.plans.index_queries import S as ACTIVE
from corpuslens.plans.registry import query, table
from corpuslens.plans.text_queries import counted, entities_sql, tokens_sql
from corpuslens.plans.vocabulary_queries import DOCS, FREQ, TOK, VOCAB, corpus, vocab
from corpuslens.session import scratch_path
from corpuslens.sources import readers, stores
from corpuslens.streaming import incremental as ST

SPLIT_NO = "CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END"
SPLIT = "CASE lang WHEN 'en' THEN 'train' WHEN 'de' THEN 'valid' ELSE 'test' END"
PARTS = {"train": "lang = 'en'", "valid": "lang = 'de'", "test": "lang NOT IN ('en', 'de')"}
LINES = rf"""raw AS (SELECT doc_id AS d, {SPLIT_NO} AS sno, {SPLIT} AS split, string_split(text, chr(10)) AS l FROM documents),
  li AS (SELECT d, sno, split, unnest(l) AS line, generate_subscripts(l, 1) AS p FROM raw),
  tk AS (SELECT *, trim(regexp_replace(line, '[\t-\r\x1C-\x20\x{{85}}\p{{Z}}]+', ' ', 'g')) AS tokens FROM li)"""


def written_lines(spark, sf):
    """Document lines as text files, one folder per split, file names in document order."""
    base = scratch_path(spark, "lines")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    for split, condition in PARTS.items():
        part = docs.where(condition).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        part.select("text").write.text(f"{base}/{split}")
    return {split: f"{base}/{split}" for split in PARTS}


def flat(df, column="tokens"):
    return df.withColumn(column, F.array_join(F.col(column).cast("array<string>"), " "))


@query(
    "s01_line_corpus",
    f"""WITH {LINES}, n AS (SELECT row_number() OVER (ORDER BY sno, d, p) - 1 AS doc_id,
        row_number() OVER (PARTITION BY sno ORDER BY d, p) - 1 AS sent_no, split, tokens FROM tk)
        SELECT doc_id, sent_no, split, trim(tokens || ' <eos>') AS tokens FROM n""",
)
def line_corpus(spark, sf):
    return flat(readers.read_line_corpus(spark, written_lines(spark, sf), mark_eos=True))


@query(
    "s01_line_corpus_skip_blank",
    f"""WITH {LINES}, n AS (SELECT row_number() OVER (ORDER BY sno, d, p) - 1 AS doc_id,
        row_number() OVER (PARTITION BY sno ORDER BY d, p) - 1 AS sent_no, split, tokens FROM tk WHERE tokens <> '')
        SELECT doc_id, sent_no, split, tokens FROM n WHERE sent_no < 5000""",
)
def line_corpus_skip_blank(spark, sf):
    return flat(readers.read_line_corpus(spark, written_lines(spark, sf), skip_blank=True, max_samples=5000))


@query(
    "s02_token_stream",
    f"""WITH {TOK}, g AS (SELECT token, row_number() OVER (ORDER BY doc_id, pos) - 1 AS g FROM tok)
        SELECT g // 1000 AS doc_id, string_agg(token, ' ' ORDER BY g) AS tokens FROM g GROUP BY 1""",
)
def token_stream(spark, sf):
    path = scratch_path(spark, "stream")
    lines = corpus(spark, sf).where(F.size("tokens") > 0).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    lines.select(F.array_join("tokens", " ")).write.option("lineSep", " ").text(path)
    return flat(readers.read_token_stream(spark, path))


@query(
    "s03_xml_sentences",
    f"WITH {DOCS} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, array_to_string(t, ' ') AS tokens "
    "FROM docs WHERE len(t) > 0",
)
def xml_sentences(spark, sf):
    path = scratch_path(spark, "xml")
    docs = corpus(spark, sf).where(F.size("tokens") > 0).repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def leaf(t, i):
        """Plain text, a CDATA section, a decimal and a zero-led hexadecimal character reference in turn."""
        rest = F.substring(t, 2, 1 << 30)
        forms = [
            t,
            F.concat(F.lit("<![CDATA["), t, F.lit("]]>")),
            F.concat(F.lit("&#"), F.ascii(t), F.lit(";"), rest),
            F.concat(F.lit("&#x0000000"), F.hex(F.ascii(t)), F.lit(";"), rest),
        ]
        return F.concat(F.lit('<w c5="NN1">'), F.element_at(F.array(*forms), (i % 4 + 1).cast("int")), F.lit(" </w>"))

    leaves = F.array_join(F.transform("tokens", leaf), "<!-- a <w>note</w> -->")
    sentence = F.concat(F.lit('<s n="1"><!-- <w>x</w> & -->'), leaves, F.lit("</s>"))
    docs.select(F.concat(F.lit("<div>"), sentence, F.lit("</div>"))).write.text(f"{path}/part")
    # one more file for each language, whose sentence has no end
    open_end = table(spark, sf, "documents").select("lang", F.lit("<div><s><w>lost</w>")).distinct()
    open_end.write.partitionBy("lang").text(f"{path}/tail")
    # the text sink names its files *.txt
    return flat(readers.read_xml_sentences(spark, path, pattern="*.txt")).drop("path")


def vertical_files(spark, sf):
    path = scratch_path(spark, "vertical")
    # \x93 is a windows-1252 quote; accented letters are written as latin-1 bytes
    docs = table(spark, sf, "documents").select("doc_id", words("text").alias("tokens"))
    latin = F.transform("tokens", lambda t: F.regexp_replace(t, r"[^\x{0}-\x{FF}]", "?"))
    rows = F.transform(latin, lambda t: F.concat(t, F.lit("\x93\tNN\t"), F.upper(F.substring(t, 1, 1))))
    block = F.concat(F.lit('<text id="x">\n<s>\n'), F.array_join(rows, "\n"), F.lit("\n</s>\n</text>"))
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.select(F.encode(block, "ISO-8859-1").cast("string")).write.text(path, compression="gzip")
    return path


VERTICAL = f"""{DOCS}, lat AS (SELECT doc_id, list_transform(t, lambda x: regexp_replace(x, '[^\\x{{0}}-\\x{{FF}}]', '?', 'g')) AS t
    FROM docs)"""


@query(
    "s04_vertical_sentences",
    f"""WITH {VERTICAL} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id,
        array_to_string(list_transform(t, lambda x: x || '“'), ' ') AS tokens FROM lat""",
)
def vertical_sentences(spark, sf):
    return flat(readers.read_vertical_sentences(spark, vertical_files(spark, sf))).drop("path")


PAIRS = r"""b AS (SELECT item_id, regexp_extract_all(text, '\p{L}+') AS t FROM benchmark),
    p AS (SELECT t[i] AS w1, t[i + 1] AS w2, i % 11 AS score, item_id % 2 AS k
          FROM (SELECT item_id, t, unnest(range(1, len(t))) AS i FROM b))"""


def pair_files(spark, sf):
    path = scratch_path(spark, "pairs")
    pairs = S.adjacent_pairs(
        table(spark, sf, "benchmark").select(
            F.col("item_id").alias("doc_id"), F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)).alias("tokens")
        )
    )
    line = F.concat_ws(" ", "first", "second", ((F.col("i") + 1) % 11).cast("string"))
    for part, name in ((0, "sim"), (1, "rel")):
        pairs.where(F.col("doc_id") % 2 == part).select(line).write.text(f"{path}/{name}")
    return f"{path}/sim", f"{path}/rel"


@query(
    "s05_similarity_pairs",
    f"""WITH {PAIRS} SELECT lower(w1) AS w1, lower(w2) AS w2, score::DOUBLE / 10 AS score,
        CASE k WHEN 0 THEN 'sim' ELSE 'rel' END AS relation FROM p""",
)
def similarity_pairs(spark, sf):
    return readers.read_similarity_pairs(spark, *pair_files(spark, sf))


@query(
    "s05_pair_words",
    f"WITH {PAIRS} SELECT DISTINCT unnest([lower(w1), lower(w2)]) AS token FROM p",
)
def pair_words(spark, sf):
    return readers.pair_words(readers.read_similarity_pairs(spark, *pair_files(spark, sf)))


@query(
    "s06_synonym_questions",
    f"""WITH {DOCS}, p AS (SELECT doc_id, t, unnest(range(0, len(t) // 5)) AS b FROM docs),
        q AS (SELECT row_number() OVER (ORDER BY doc_id, b) - 1 AS qid, doc_id, b, t[5 * b + 1:5 * b + 5] AS t FROM p)
        SELECT qid, t[1] AS word, array_to_string(t[2:5], ' ') AS options, CAST((doc_id + b) % 4 AS INTEGER) AS answer FROM q""",
)
def synonym_questions(spark, sf):
    """Every document cut into blocks of five words: a question and its options."""
    path = scratch_path(spark, "questions")
    numbers = F.filter(F.sequence(F.lit(0), F.floor(F.size("tokens") / 5)), lambda b: (b + 1) * 5 <= F.size("tokens"))
    cut = F.transform(numbers, lambda b: F.slice("tokens", (b * 5 + 1).cast("int"), 5))
    docs = corpus(spark, sf).select("doc_id", F.posexplode(cut).alias("b", "w"))
    docs = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "b")
    word = lambda i: F.col("w")[i]
    options = [F.concat(F.lit(f"{letter}. "), word(i + 1)) for i, letter in enumerate("abcd")]
    head = F.concat(F.col("doc_id").cast("string"), F.lit(" "), word(0))
    docs.select(F.concat_ws("\n", head, *options, F.lit(""))).write.text(f"{path}/q")
    letter = F.substring(F.lit("abcd"), ((F.col("doc_id") + F.col("b")) % 4 + 1).cast("int"), F.lit(1))
    docs.select(F.concat_ws(" ", "doc_id", letter)).write.text(f"{path}/a")
    return flat(readers.read_synonym_questions(spark, f"{path}/q", f"{path}/a"), "options")


@query(
    "s07_write_sentences",
    f"WITH {DOCS} SELECT array_to_string(t, ' ') AS sentence FROM docs WHERE len(t) > 1",
)
def write_sentences(spark, sf):
    path = scratch_path(spark, "sentences")
    stores.write_sentences(corpus(spark, sf), path)
    return spark.read.text(path).withColumnRenamed("value", "sentence")


@query(
    "s07_write_sentences_table",
    f"""WITH {DOCS} SELECT doc_id, array_to_string(t, ' ') AS sentence FROM docs WHERE len(t) > 1
        ORDER BY doc_id LIMIT 300""",
)
def write_sentences_table(spark, sf):
    path = scratch_path(spark, "sentences")
    stores.write_sentences(corpus(spark, sf), path, "parquet", max_sentences=300)
    return spark.read.parquet(path)


@query("s08_write_vocabulary", f"WITH {VOCAB} SELECT token, id, freq FROM vocab")
def write_vocabulary(spark, sf):
    path = scratch_path(spark, "vocabulary")
    stores.write_vocabulary(vocab(spark, sf), path)
    return stores.read_vocabulary(spark, path)


@query(
    "s08_bucketed_vocabulary",
    f"""WITH {VOCAB} SELECT doc_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids
        FROM tok JOIN vocab USING (token) GROUP BY doc_id UNION ALL SELECT doc_id, '' FROM docs WHERE len(t) = 0""",
)
def bucketed_vocabulary(spark, sf):
    """Documents encoded by a stored vocabulary that the lookup's join reads bucket by bucket."""
    path = scratch_path(spark, "bucketed")
    stored = stores.write_bucketed_vocabulary(vocab(spark, sf), f"vocabulary_{path[-32:]}", path)
    encoded = V.encode_ids(corpus(spark, sf), stored)
    return encoded.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(
    "s09_write_ngrams",
    f"""WITH {VOCAB}, e AS (SELECT doc_id, list(id ORDER BY pos) AS t FROM tok JOIN vocab USING (token) GROUP BY doc_id),
        p AS (SELECT doc_id, t, unnest(range(1, len(t) - 1)) AS i FROM e)
        SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, array_to_string(t[i:i + 2], ' ') AS ngram, 3 AS n, {SPLIT} AS split
        FROM p JOIN documents USING (doc_id)""",
)
def write_ngrams(spark, sf):
    path = scratch_path(spark, "ngrams")
    encoded = V.encode_ids(corpus(spark, sf), vocab(spark, sf))
    grams = encoded.select("doc_id", F.posexplode(S.ngram_array(F.col("ids"), 3, "bigint")).alias("i", "ngram"))
    splits = table(spark, sf, "documents").select("doc_id", F.expr(SPLIT).alias("split"))
    stores.write_ngrams(grams.join(splits, "doc_id"), path, 3)
    return flat(stores.read_ngrams(spark, path), "ngram")


@query(
    "s10_save_index",
    f"""WITH {VOCAB}, signs AS (SELECT token AS sign, id FROM vocab), {RI_SQL.split('signs AS (SELECT token AS sign FROM freqs),')[1]}
        SELECT ri.sign, any_value(id) AS id, string_agg(idx, ' ' ORDER BY r) FILTER (v > 0) AS pos,
        string_agg(idx, ' ' ORDER BY r) FILTER (v < 0) AS neg, {K} AS dim, {ACTIVE} AS s, 0 AS seed
        FROM ri JOIN signs USING (sign) GROUP BY ri.sign""",
)
def save_index(spark, sf):
    path = scratch_path(spark, "index")
    signs = vocab(spark, sf).select(F.col("token").alias("sign"), "id")
    stores.save_index(RI.index_signs(signs, K, ACTIVE), path, K, ACTIVE)
    loaded = stores.load_index(spark, path).select("sign", "id", "ri.pos", "ri.neg", "ri.dim", "s", "seed")
    return flat(flat(loaded, "pos"), "neg")


@query(
    "s11_append_eval_log",
    """SELECT event_type AS id, user_id AS run, event_id AS epoch, event_id * 10 AS step, value / 100 AS lr,
       CASE event_id % 2 WHEN 0 THEN 'validation' ELSE 'test' END AS dataset, value AS perplexity FROM events""",
)
def append_eval_log(spark, sf):
    path = scratch_path(spark, "log")
    events = table(spark, sf, "events").select(
        F.col("event_type").alias("id"), F.col("user_id").alias("run"), F.col("event_id").alias("epoch"),
        (F.col("event_id") * 10).alias("step"), (F.col("value") / 100).alias("lr"),
        F.when(F.col("event_id") % 2 == 0, "validation").otherwise("test").alias("dataset"),
        F.col("value").alias("perplexity"),
    )
    for dataset in ("validation", "test"):
        stores.append_eval_log(events.where(F.col("dataset") == dataset), path)
    return stores.read_eval_log(spark, path)


@query(
    "s12_append_vectors",
    f"""WITH {accumulated_sql('')}, p AS ({CELLS_SQL}) SELECT p.*, freq FROM p JOIN freqs ON target = token""",
)
def append_vectors(spark, sf):
    path = scratch_path(spark, "vectors")
    docs = corpus(spark, sf)
    for part in (docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")):  # two runs into one table
        stores.append_vectors(C.accumulate_context_vectors(part, 2, K, ACTIVE), V.word_frequencies(part), path)
    counts = stores.read_vector_frequencies(spark, path).withColumnRenamed("token", "target")
    return vector_rows(stores.read_vectors(spark, path)).join(counts, "target")


# -- streams ---------------------------------------------------------------------

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def document_stream(spark, sf, files=4):
    """The documents as several files, which arrive one after the other.

    Each file is one split here, so its rows are dealt over the cores before they are worked on.
    """
    path = scratch_path(spark, "arriving")
    table(spark, sf, "documents").repartition(files, "doc_id").write.parquet(path)
    return place(ST.read_documents(spark, path, DOC_SCHEMA, files_per_batch=1), "doc_id")


def token_arrays(spark, sf, files=4):
    return TX.normalize_corpus(document_stream(spark, sf, files), mode="words")


@query("st1_stream_word_frequencies", f"WITH {FREQ} SELECT token, freq FROM freqs")
def stream_word_frequencies(spark, sf):
    return ST.stream_word_frequencies(token_arrays(spark, sf), scratch_path(spark, "st1"))(spark)


@query(
    "st1_stream_event_types",
    "SELECT event_type AS token, count(*) AS freq FROM events GROUP BY 1",
)
def stream_event_types(spark, sf):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    events = ST.read_documents(spark, sf, schema, "events.parquet").select(F.array("event_type").alias("tokens"))
    return ST.stream_word_frequencies(events, scratch_path(spark, "st1"))(spark)


@query("st2_stream_context_vectors", f"WITH {accumulated_sql('')} {CELLS_SQL}")
def stream_context_vectors(spark, sf):
    read = ST.stream_context_vectors(token_arrays(spark, sf, 2), scratch_path(spark, "st2"), 2, K, ACTIVE)
    return vector_rows(read(spark))


@query(
    "st3_stream_vocabulary",
    f"""WITH {TOK}, f AS (SELECT token, min(doc_id % 4) AS part FROM tok GROUP BY token)
        SELECT token, row_number() OVER (ORDER BY part, token) - 1 AS id FROM f""",
)
def stream_vocabulary(spark, sf):
    """Four runs of one stream, each over the documents that arrived since the last."""
    path, state = scratch_path(spark, "arriving"), scratch_path(spark, "st3")
    for part in range(4):
        table(spark, sf, "documents").where(F.col("doc_id") % 4 == part).write.mode("append").parquet(path)
        tokens = TX.normalize_corpus(place(ST.read_documents(spark, path, DOC_SCHEMA), "doc_id"), mode="words")
        found = ST.stream_vocabulary(tokens, state)(spark)
    return found


@query("st4_stream_ngrams", f"""WITH {DOCS}, p AS (SELECT doc_id, t, unnest(range(1, len(t) - 1)) AS i FROM docs)
        SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, array_to_string(t[i:i + 2], ' ') AS ngram FROM p""")
def stream_ngrams(spark, sf):
    grams = flat(S.ngrams(token_arrays(spark, sf), 3), "ngram")
    return ST.stream_rows(grams, scratch_path(spark, "st4"))(spark)


@query("st4_stream_tokenize", tokens_sql())
def stream_tokenize(spark, sf):
    tokens = flat(TX.tokenize(document_stream(spark, sf), drop_space=True)).select("doc_id", "tokens")
    return ST.stream_rows(tokens, scratch_path(spark, "st4"))(spark)


@query("st4_stream_entities", entities_sql("documents"))
def stream_entities(spark, sf):
    found = TX.extract_entities(document_stream(spark, sf))
    return counted(ST.stream_rows(found, scratch_path(spark, "st4"))(spark))
