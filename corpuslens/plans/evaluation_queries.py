"""Registered queries: vector evaluation and experiment logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions.words import words
from corpuslens.operators import evaluation as E
from corpuslens.operators import random_index as RI
from corpuslens.operators import vocabulary as V
from corpuslens.plans.index_queries import ri_sql
from corpuslens.plans.registry import query, table
from corpuslens.plans.vocabulary_queries import BENCH, bench_corpus

CELLS = "e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings)"
NORMED = f"""{CELLS}, nv AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM e GROUP BY 1)"""


def keyed(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))


@query(
    "e01_word_vectors",
    f"""WITH {BENCH}, signs AS (SELECT token AS sign FROM bench), {ri_sql('signs', '(SELECT count(*) FROM embeddings)', 10)},
        {CELLS} SELECT sign AS row, CAST(j AS INTEGER) AS j, round(sum(ri.v * e.v), 6) AS value
        FROM ri JOIN e ON ri.idx = e.vec_id GROUP BY 1, 2""",
)
def word_vectors(spark, sf):
    signs = V.token_stream(bench_corpus(spark, sf)).select(F.col("token").alias("sign")).distinct()
    embeddings = table(spark, sf, "embeddings")
    coo = RI.to_coo(RI.index_signs(signs, embeddings.count(), 10), "sign")
    matrix = embeddings.select(
        F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("vector")
    )
    return E.word_vectors(coo, matrix).withColumn("value", F.round("value", 6))


@query(
    "e02_l2_normalize",
    f"""WITH {NORMED} SELECT vec_id AS key, CAST(j AS INTEGER) AS j, round(v / n, 9) AS v FROM e JOIN nv USING (vec_id)""",
)
def l2_normalize(spark, sf):
    return E.l2_normalize(keyed(spark, sf)).select("key", F.posexplode("vector").alias("j", "v")).withColumn(
        "v", F.round("v", 9)
    )


@query(
    "e03_cosine_pairs",
    f"""WITH {NORMED}, p AS (SELECT vec_id AS w1, vec_id * 7 % (SELECT count(*) + 20 FROM embeddings) AS w2 FROM embeddings)
        SELECT w1, w2, round(sum(a.v * b.v) / max(x.n) / max(y.n), 9) AS cos FROM p
        JOIN e a ON a.vec_id = w1 JOIN e b ON b.vec_id = w2 AND a.j = b.j
        JOIN nv x ON x.vec_id = w1 JOIN nv y ON y.vec_id = w2 GROUP BY 1, 2""",
)
def cosine_pairs(spark, sf):
    vectors = keyed(spark, sf)
    partners = vectors.count() + 20  # some have no vector
    pairs = vectors.select(F.col("key").alias("w1"), (F.col("key") * 7 % partners).alias("w2"))
    return E.cosine_pairs(pairs, vectors).withColumn("cos", F.round("cos", 9))


QUESTIONS = f"""{NORMED}, q AS (SELECT vec_id AS qid, vec_id AS word, o AS opt, (vec_id * 3 + o * 17 + 1) % (SELECT count(*) + 5 FROM embeddings) AS option,
      CAST(vec_id % 4 AS BIGINT) AS answer FROM embeddings, range(0, 4) r(o)),
      s AS (SELECT qid, opt, option, answer, sum(a.v * b.v) / max(x.n) / max(y.n) AS cos FROM q
      JOIN e a ON a.vec_id = word JOIN e b ON b.vec_id = option AND a.j = b.j
      JOIN nv x ON x.vec_id = word JOIN nv y ON y.vec_id = option GROUP BY 1, 2, 3, 4),
      k AS (SELECT qid, arg_max(option, struct_pack(c := round(cos, 12), o := -opt)) AS predicted,
            any_value(answer) AS answer FROM s GROUP BY qid HAVING count(*) = 4),
      f AS (SELECT k.qid, q.option AS answer, predicted FROM k JOIN q ON q.qid = k.qid AND q.opt = k.answer)"""


def questions(spark, sf):
    key = F.col("key")
    options = keyed(spark, sf).count() + 5  # some have no vector
    return keyed(spark, sf).select(
        key.alias("qid"), key.alias("word"),
        F.array(*[(key * 3 + o * 17 + 1) % options for o in range(4)]).alias("options"),
        (key % 4).cast("int").alias("answer"),
    )


@query("e04_answer_synonyms", f"WITH {QUESTIONS} SELECT qid, qid AS word, answer, predicted FROM f")
def answer_synonyms(spark, sf):
    return E.answer_synonyms(questions(spark, sf), keyed(spark, sf))


@query(
    "e04_synonym_accuracy",
    f"""WITH {QUESTIONS} SELECT count(*) AS questions,
        round(avg(CASE WHEN answer = predicted THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS accuracy FROM f""",
)
def synonym_accuracy(spark, sf):
    return E.synonym_accuracy(questions(spark, sf), keyed(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "e05_spearman",
    r"""WITH d AS (SELECT lang, n_chars AS x, len(regexp_extract_all(lower(text), '\p{L}+')) AS y FROM documents),
       r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / 2.0 AS rx,
             rank() OVER (PARTITION BY lang ORDER BY y) + (count(*) OVER (PARTITION BY lang, y) - 1) / 2.0 AS ry FROM d)
       SELECT lang, count(*) AS n, round(corr(rx::DOUBLE, ry::DOUBLE), 9) AS rho FROM r GROUP BY lang""",
)
def spearman(spark, sf):
    docs = table(spark, sf, "documents").select("lang", F.col("n_chars").alias("x"), F.size(words("text")).alias("y"))
    return E.spearman(docs, "x", "y", "lang").withColumn("rho", F.round("rho", 9))


SQUARINGS = 12


def eigen_sql(start: str) -> str:
    """The two leading eigenvectors (i, x) of the matrix `start` (i, j, v) as e1 and e2: its powers by squaring."""

    def powers(name: str, first: str) -> str:
        out, last = [], first
        for n in range(SQUARINGS):
            new = f"{name}{n}"
            out.append(
                f"""{new}_s AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {last} a JOIN {last} b ON a.j = b.i GROUP BY 1, 2),
      {new} AS MATERIALIZED (SELECT i, j, v / (SELECT sqrt(sum(v * v)) FROM {new}_s) AS v FROM {new}_s)"""
            )
            last = new
        return ", ".join(out) + f""", {name}_c AS (SELECT i, v FROM {last}
            WHERE j = (SELECT j FROM {last} WHERE i = j ORDER BY v DESC, j LIMIT 1)),
          {name}_n AS (SELECT i, v / (SELECT sqrt(sum(v * v)) FROM {name}_c) AS x FROM {name}_c),
          {name}_e AS MATERIALIZED (SELECT i, x * (SELECT sign(arg_max(x, abs(x))) FROM {name}_n) AS x FROM {name}_n)"""

    return f"""{powers('p', start)}, e1 AS (SELECT i, x FROM p_e),
      val AS (SELECT sum(a.x * m.v * b.x) AS l FROM {start} m JOIN e1 a ON m.i = a.i JOIN e1 b ON m.j = b.i),
      rest AS MATERIALIZED (SELECT m.i, m.j, m.v - l * a.x * b.x AS v FROM {start} m, val
        JOIN e1 a ON m.i = a.i JOIN e1 b ON m.j = b.i), {powers('q', 'rest')}, e2 AS (SELECT i, x FROM q_e)"""


PROJECTED = """SELECT vec_id AS key, round(sum(e.v * e1.x), 4) AS x, round(sum(e.v * e2.x), 4) AS y
    FROM e JOIN e1 ON e.j = e1.i JOIN e2 ON e.j = e2.i GROUP BY 1"""


@query(
    "e06_pca",
    f"""WITH {CELLS}, mean AS (SELECT j, avg(v) AS m FROM e GROUP BY j),
        cen AS MATERIALIZED (SELECT vec_id, j, v - m AS v FROM e JOIN mean USING (j)),
        mat AS MATERIALIZED (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM cen a JOIN cen b USING (vec_id) GROUP BY 1, 2),
        {eigen_sql('mat')} {PROJECTED}""",
)
def pca(spark, sf):
    projected = E.pca(keyed(spark, sf), 2)
    return projected.select("key", *[F.round(F.col("projected")[i], 4).alias(c) for i, c in enumerate("xy")])


@query(
    "e07_truncated_svd",
    f"""WITH {CELLS},
        mat AS MATERIALIZED (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2),
        {eigen_sql('mat')} {PROJECTED}""",
)
def truncated_svd(spark, sf):
    projected = E.truncated_svd(keyed(spark, sf), 2)
    return projected.select("key", *[F.round(F.col("projected")[i], 4).alias(c) for i, c in enumerate("xy")])


@query(
    "e07_reconstruction",
    "SELECT vec_id AS key, generate_subscripts(embedding, 1) - 1 AS idx, round(unnest(embedding)::DOUBLE, 4) AS value FROM embeddings",
)
def reconstruction(spark, sf):
    """All components of the randomised decomposition give the vectors again."""
    projected, components, _ = E.randomised_svd(keyed(spark, sf), 1 << 10)
    whole = E.reconstructed(projected, components)
    return whole.select("key", F.posexplode("reconstructed").alias("idx", "value")).select(
        "key", F.col("idx").cast("long").alias("idx"), (F.round("value", 4) + 0.0).alias("value")
    )


@query(
    "e08_value_histogram",
    f"""WITH {CELLS}, b AS (SELECT vec_id AS key, CASE WHEN v < -0.4::DOUBLE THEN 0 WHEN v >= 0.4::DOUBLE THEN 21
        ELSE CAST(floor(20.0::DOUBLE * (v - -0.4::DOUBLE) / (0.4::DOUBLE - -0.4::DOUBLE)) AS BIGINT) + 1 END AS bucket
        FROM e) SELECT key, bucket, count(*) AS n FROM b GROUP BY 1, 2""",
)
def value_histogram(spark, sf):
    return E.value_histogram(keyed(spark, sf), "key", -0.4, 0.4, 20)


@query(
    "e09_perplexity",
    """WITH m AS (SELECT event_type AS dataset, event_id // 128 AS batch, avg(value / 10) AS m FROM events GROUP BY 1, 2)
       SELECT dataset, round(exp(avg(m)), 6) AS perplexity FROM m GROUP BY 1""",
)
def perplexity(spark, sf):
    losses = table(spark, sf, "events").select(
        F.col("event_type").alias("dataset"), F.expr("event_id div 128").alias("batch"), (F.col("value") / 10).alias("loss")
    )
    return E.perplexity(losses, "dataset").withColumn("perplexity", F.round("perplexity", 6))


@query(
    "e10_early_stopping",
    """WITH l AS (SELECT o_custkey % 200 AS id, o_custkey // 200 AS run, o_orderkey AS epoch, o_totalprice / 50000 AS p
       FROM orders),
       i AS (SELECT *, lag(p) OVER w - p AS gain FROM l WINDOW w AS (PARTITION BY id, run ORDER BY epoch)),
       f AS (SELECT *, CASE WHEN gain < 1.0 THEN 1 ELSE 0 END AS fail FROM i),
       s AS (SELECT *, fail = 1 AND lag(fail, 1) OVER w = 1 AND lag(fail, 2) OVER w = 1 AND lag(fail, 3) OVER w = 1 AS stop
             FROM f WINDOW w AS (PARTITION BY id, run ORDER BY epoch)),
       x AS (SELECT id, run, min(epoch) FILTER (stop) AS stop_epoch FROM s GROUP BY 1, 2)
       SELECT id, run, count(*) AS evaluations, any_value(stop_epoch) AS stop_epoch, min(p) AS best
       FROM l JOIN x USING (id, run) WHERE stop_epoch IS NULL OR epoch <= stop_epoch GROUP BY id, run""",
)
def early_stopping(spark, sf):
    log = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 200).alias("id"), F.expr("o_custkey div 200").alias("run"),
        F.col("o_orderkey").alias("epoch"), (F.col("o_totalprice") / 50000).alias("perplexity"),
    )
    return E.early_stopping(log)
