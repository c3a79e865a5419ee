"""Registered queries: random indexes, permutations, context vectors, samples.

Vectors with many cells are returned as one row each, the cells as ``idx:w`` by idx.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import index_arrays as A
from corpuslens.functions import random_index as R
from corpuslens.functions.bijection import Bijection
from corpuslens.operators import context as C
from corpuslens.operators import random_index as RI
from corpuslens.operators import vocabulary as V
from corpuslens.plans.registry import query, table
from corpuslens.plans.vocabulary_queries import DOCS, FREQ, VOCAB, corpus, freqs, vocab

K, S = 1000, 10


def ri_sql(signs: str, k: int = K, s: int = S, lead: str = "", name: str = "ri") -> str:
    """SQL for the active positions of the values in `signs`: (sign, idx, r, v)."""
    digests = -(-(2 * s + 1) // 4)
    return f"""dig_{name} AS (SELECT sign, i, md5('{lead}' || sign || ':' || i) AS h
        FROM (SELECT DISTINCT sign FROM {signs}), range(0, {digests}) x(i)),
      cand_{name} AS (SELECT sign, i * 4 + q AS j, ('0x' || substr(h, CAST(8 * q + 1 AS INTEGER), 8))::BIGINT % {k} AS idx
        FROM dig_{name}, range(0, 4) y(q)),
      drawn_{name} AS (SELECT sign, idx, min(j) AS j FROM cand_{name} GROUP BY 1, 2),
      short_{name} AS (SELECT sign FROM drawn_{name} GROUP BY sign HAVING count(*) < {s}),
      fill_{name} AS (SELECT sign, p AS idx, {4 * digests} + row_number() OVER (PARTITION BY sign
        ORDER BY md5('{lead}' || sign || ':fill:' || p), p) AS j FROM short_{name}, range(0, {k}) z(p)
        WHERE NOT EXISTS (FROM drawn_{name} d WHERE d.sign = short_{name}.sign AND d.idx = p)),
      num_{name} AS (SELECT sign, idx, row_number() OVER (PARTITION BY sign ORDER BY j) AS r
        FROM (SELECT * FROM drawn_{name} UNION ALL SELECT * FROM fill_{name})),
      {name} AS (SELECT sign, idx, r, CASE WHEN r <= {s // 2} THEN 1 ELSE -1 END AS v FROM num_{name} WHERE r <= {s})"""


SIGNS = f"{FREQ}, signs AS (SELECT token AS sign FROM freqs)"
RI_SQL = f"{SIGNS}, {ri_sql('signs')}"


def index(spark, sf):
    signs = freqs(spark, sf).select(F.col("token").alias("sign"))
    return RI.index_signs(signs, K, S)


def joined_cells(cells, digits: int = 0):
    """``idx:w`` for each cell; fractions are rounded to whole numbers of 10^-digits."""
    return F.arrow_udf(lambda c: A.joined_cells(c, digits), "string")(cells)


def text(column: str):
    return F.array_join(F.col(column).cast("array<string>"), " ")


@query(
    "r01_random_index",
    f"""WITH {RI_SQL} SELECT sign, string_agg(idx, ' ' ORDER BY r) FILTER (r <= 5) AS pos,
        string_agg(idx, ' ' ORDER BY r) FILTER (r > 5) AS neg FROM ri GROUP BY sign""",
)
def random_index(spark, sf):
    ri = index(spark, sf).select("sign", "ri.pos", "ri.neg")
    return ri.withColumns({"pos": text("pos"), "neg": text("neg")})


@query(
    "r01_random_index_positive",
    f"""WITH {SIGNS}, {ri_sql('signs', 500, 5, '11:')} SELECT sign, string_agg(idx, ' ' ORDER BY r) AS pos,
        '' AS neg FROM ri GROUP BY sign""",
)
def random_index_positive(spark, sf):
    signs = freqs(spark, sf).select(F.col("token").alias("sign"))
    ri = RI.index_signs(signs, 500, 5, seed=11, symmetric=False).select("sign", "ri.pos", "ri.neg")
    return ri.withColumns({"pos": text("pos"), "neg": text("neg")})


@query(
    "r01_random_index_crowded",
    f"""WITH {SIGNS}, {ri_sql('signs', 20, 18, '5:')} SELECT sign, string_agg(idx, ' ' ORDER BY r) FILTER (r <= 9) AS pos,
        string_agg(idx, ' ' ORDER BY r) FILTER (r > 9) AS neg FROM ri GROUP BY sign""",
)
def random_index_crowded(spark, sf):
    signs = freqs(spark, sf).select(F.col("token").alias("sign"))
    ri = RI.index_signs(signs, 20, 18, seed=5).select("sign", "ri.pos", "ri.neg")
    return ri.withColumns({"pos": text("pos"), "neg": text("neg")})


@query(
    "r02_vector_views",
    f"""WITH {SIGNS}, {ri_sql('signs', 100, 4)},
        c AS (SELECT sign, r, idx, v, CASE WHEN v > 0 THEN idx ELSE idx + 100 END AS cls FROM ri)
        SELECT sign, string_agg(idx || ':' || v, ' ' ORDER BY idx) AS vector,
        string_agg(cls, ' ' ORDER BY r) AS class_indices, string_agg(cls, ' ' ORDER BY cls) AS class_vector,
        string_agg(cls || ':0.25', ' ' ORDER BY cls) AS dist_vector,
        string_agg(idx, ' ' ORDER BY idx) FILTER (v > 0) AS positive,
        string_agg(idx, ' ' ORDER BY idx) FILTER (v < 0) AS negative,
        string_agg(idx, ' ' ORDER BY idx) AS indices, string_agg(v, ' ' ORDER BY idx) AS "values" FROM c GROUP BY sign""",
)
def vector_views(spark, sf):
    k = 100
    signs = freqs(spark, sf).select(F.col("token").alias("sign"))
    rows = RI.index_signs(signs, k, 4)
    ri = F.col("ri")

    def where_active(vector, show):
        return F.array_join(
            F.transform(R.dense_to_sparse(vector), lambda c: F.concat(c["idx"].cast("string"), show(c["v"]))), " "
        )

    whole = lambda v: F.concat(F.lit(":"), v.cast("int").cast("string"))
    share = lambda v: F.concat(F.lit(":"), v.cast("string"))
    bare = lambda v: F.lit("")
    indices, values = R.sorted_indices_values(ri)
    return rows.select(
        "sign",
        where_active(R.to_vector(ri, k), whole).alias("vector"),
        F.array_join(R.class_indices(ri, k).cast("array<string>"), " ").alias("class_indices"),
        where_active(R.class_vector(ri, k), bare).alias("class_vector"),
        where_active(R.dist_vector(ri, k), share).alias("dist_vector"),
        where_active(R.positive_vector(ri, k), bare).alias("positive"),
        where_active(R.negative_vector(ri, k), bare).alias("negative"),
        F.array_join(indices.cast("array<string>"), " ").alias("indices"),
        F.array_join(values.cast("array<int>").cast("array<string>"), " ").alias("values"),
    )


@query(
    "r03_ri_from_indexes",
    f"""WITH {DOCS}, d AS (SELECT doc_id, list_distinct(list_transform(t, lambda x: len(x))) AS l FROM docs),
        s AS (SELECT doc_id, list_sort(l) AS l FROM d)
        SELECT doc_id, array_to_string(l[1:len(l) // 2], ' ') AS pos,
        array_to_string(l[len(l) // 2 + 1:], ' ') AS neg FROM s""",
)
def ri_from_indexes(spark, sf):
    lengths = F.array_sort(F.array_distinct(F.transform("tokens", F.length)))
    ri = corpus(spark, sf).select("doc_id", R.from_positions(lengths, K).alias("ri")).select("doc_id", "ri.pos", "ri.neg")
    return ri.withColumns({"pos": text("pos"), "neg": text("neg")})


@query(
    "r04_to_coo",
    f'WITH {VOCAB}, signs AS (SELECT token AS sign, id FROM vocab), {ri_sql("signs")} '
    "SELECT id AS row, CAST(idx AS INTEGER) AS idx, CAST(v AS FLOAT) AS v FROM ri JOIN signs USING (sign)",
)
def to_coo(spark, sf):
    signs = vocab(spark, sf).select(F.col("token").alias("sign"), "id")
    return RI.to_coo(RI.index_signs(signs, K, S), "id")


@query(
    "r04_gather",
    f"""WITH {VOCAB}, signs AS (SELECT token AS sign, id FROM vocab), {ri_sql("signs")},
        wanted AS (SELECT doc_id, pos, token AS sign FROM tok)
        SELECT doc_id, pos, id AS row, string_agg(idx || ':' || abs(v), ' ' ORDER BY idx) AS cells
        FROM wanted JOIN ri USING (sign) JOIN signs USING (sign) GROUP BY ALL""",
)
def gather(spark, sf):
    ids = vocab(spark, sf)
    coo = RI.to_coo(RI.index_signs(ids.select(F.col("token").alias("sign"), "id"), K, S), "id", all_positive=True)
    encoded = V.encode_ids(corpus(spark, sf), ids)
    rows = encoded.select("doc_id", F.posexplode("ids").alias("pos", "row"))
    found = RI.gather(coo, rows.select(F.struct("doc_id", "pos").alias("pos"), "row"))
    cells = found.groupBy("pos", "row").agg(F.sort_array(F.collect_list(F.struct("idx", F.col("v").cast("int").alias("w")))).alias("cells"))
    return cells.select("pos.doc_id", "pos.pos", "row", joined_cells("cells").alias("cells"))


@query(
    "r05_sparse_add",
    """WITH e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS idx FROM embeddings),
       r AS (SELECT vec_id, CAST(idx AS INTEGER) AS idx, CASE WHEN v > 0.2::FLOAT THEN 1 WHEN v < -0.2::FLOAT THEN -1
             ELSE 0 END AS v FROM e),
       b AS (SELECT vec_id // 2 AS row, idx, v FROM r)
       SELECT row, idx, CAST(sum(v) AS DOUBLE) AS v FROM b GROUP BY row, idx HAVING sum(v) <> 0""",
)
def sparse_add(spark, sf):
    sign = lambda v: F.when(v > F.lit(0.2).cast("float"), 1).when(v < F.lit(-0.2).cast("float"), -1).otherwise(0)
    vectors = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", sign).alias("v"))
    cells = vectors.select(
        F.expr("vec_id div 2").alias("row"), "vec_id", F.inline(R.dense_to_sparse(F.col("v")))
    )
    even, odd = cells.where("vec_id % 2 = 0").drop("vec_id"), cells.where("vec_id % 2 = 1").drop("vec_id")
    return RI.sparse_add(even, odd)


WINDOW_SQL = """w AS (SELECT a.doc_id, a.pos, b.pos - a.pos AS o, b.token AS sign FROM tok a JOIN tok b
      ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos - {w} AND a.pos + {w})"""
PACKED = "string_agg(idx || ':' || w, ' ' ORDER BY idx) AS cells"
DOC_CELLS = f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, {PACKED} FROM c GROUP BY 1, 2"


def window_rows(windows, digits=0):
    """Windows with cells, packed; fractions as whole numbers of 10^-digits."""
    return windows.where(F.size("cells") > 0).withColumn("cells", joined_cells("cells", digits))


@query(
    "r06_encode_bow",
    f"""WITH {RI_SQL}, {WINDOW_SQL.format(w=1)}, c AS (SELECT doc_id, pos, idx, sum(v) AS w FROM w JOIN ri USING (sign)
        GROUP BY 1, 2, 3 HAVING sum(v) <> 0) {DOC_CELLS}""",
)
def encode_bow(spark, sf):
    return window_rows(C.encode_bow(corpus(spark, sf), 1, K, S))


@query(
    "r06_encode_bow_normalised",
    f"""WITH {RI_SQL}, {WINDOW_SQL.format(w=1)}, s AS (SELECT doc_id, pos, idx, sum(v) AS w FROM w JOIN ri USING (sign)
        WHERE o <> 0 GROUP BY 1, 2, 3 HAVING sum(v) <> 0),
        m AS (SELECT doc_id, pos, max(abs(w)) AS m FROM s GROUP BY 1, 2),
        c AS (SELECT doc_id, pos, idx, CAST(round(w::DOUBLE / m * 1000000) AS BIGINT) AS w FROM s JOIN m USING (doc_id, pos))
        {DOC_CELLS}""",
)
def encode_bow_normalised(spark, sf):
    return window_rows(C.encode_bow(corpus(spark, sf), 1, K, S, include_target=False, normalise=True), 6)


def permutation_sql(k: str, seed: int, name: str = "perm") -> str:
    """SQL for the permutation of 0..k-1 as (i, src): six rounds, again while the result is k or more."""
    hashed = lambda digit: f"('0x' || substr(md5('{seed}:' || r || ':' || {digit}), 1, 13))::BIGINT"
    return f"""side_{name} AS (SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS c FROM (
        SELECT {k} AS n, CAST(ceil(sqrt({k})) AS BIGINT) AS a)),
      walk_{name} AS (SELECT i, i AS x, 0 AS r FROM side_{name}, range(0, n) t(i)
        UNION ALL SELECT i, y, CASE WHEN r = 5 AND y >= n THEN 0 ELSE r + 1 END FROM (
          SELECT i, r, n, CASE WHEN r % 2 = 0 THEN ((x // c + {hashed('(x % c)')}) % a) * c + x % c
            ELSE (x // c) * c + (x % c + {hashed('(x // c)')}) % c END AS y FROM walk_{name}, side_{name} WHERE r < 6)),
      {name} AS (SELECT i, x AS src FROM walk_{name} WHERE r = 6)"""


PERM_SQL = f"""{permutation_sql(str(K), 9)},
      lft1 AS (SELECT i AS idx, src AS t FROM perm), rgt1 AS (SELECT src AS idx, i AS t FROM perm)"""


@query(
    "r07_encode_bow_dir",
    f"""WITH RECURSIVE {RI_SQL}, {PERM_SQL}, {WINDOW_SQL.format(w=1)},
        x AS (SELECT doc_id, pos, o, idx, v FROM w JOIN ri USING (sign)),
        p AS (SELECT doc_id, pos, idx, v FROM x WHERE o = 0
              UNION ALL SELECT doc_id, pos, t, v FROM x JOIN lft1 USING (idx) WHERE o < 0
              UNION ALL SELECT doc_id, pos, t, v FROM x JOIN rgt1 USING (idx) WHERE o > 0),
        c AS (SELECT doc_id, pos, idx, sum(v) AS w FROM p GROUP BY 1, 2, 3 HAVING sum(v) <> 0) {DOC_CELLS}""",
)
def encode_bow_dir(spark, sf):
    return window_rows(C.encode_bow_dir(corpus(spark, sf), 1, K, S, perm_seed=9))


@query(
    "r08_encode_bow_order",
    f"""WITH RECURSIVE {RI_SQL}, {PERM_SQL}, lft2 AS (SELECT a.idx, b.t FROM lft1 a JOIN lft1 b ON a.t = b.idx),
        rgt2 AS (SELECT a.idx, b.t FROM rgt1 a JOIN rgt1 b ON a.t = b.idx),
        mv AS (SELECT 0 AS o, src AS idx, src AS t FROM perm UNION ALL SELECT -1, * FROM lft1
               UNION ALL SELECT -2, * FROM lft2 UNION ALL SELECT 1, * FROM rgt1 UNION ALL SELECT 2, * FROM rgt2),
        {WINDOW_SQL.format(w=2)},
        p AS (SELECT doc_id, pos, t AS idx, v FROM w JOIN ri USING (sign) JOIN mv USING (o, idx)),
        c AS (SELECT doc_id, pos, idx, sum(v) AS w FROM p GROUP BY 1, 2, 3 HAVING sum(v) <> 0) {DOC_CELLS}""",
)
def encode_bow_order(spark, sf):
    return window_rows(C.encode_bow_order(corpus(spark, sf), 2, K, S, perm_seed=9))


EMB_SQL = f"""e AS (SELECT vec_id AS row, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS idx
      FROM embeddings), {permutation_sql('(SELECT max(len(embedding)) FROM embeddings)', 9)}"""


def embedding_cells(spark, sf):
    vectors = table(spark, sf, "embeddings")
    cells = vectors.select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("idx", "v"))
    return cells, vectors.agg(F.max(F.size("embedding"))).first()[0]


@query(
    "r09_permutation",
    f"""WITH RECURSIVE {EMB_SQL} SELECT row, CAST(i AS INTEGER) AS idx, v FROM e JOIN perm ON idx = src""",
)
def permutation(spark, sf):
    cells, k = embedding_cells(spark, sf)
    return RI.permute(cells, RI.permutation(spark, k, 9))


@query("r09_permutation_inverse", f"WITH RECURSIVE {EMB_SQL} SELECT row, CAST(src AS INTEGER) AS idx, v FROM e JOIN perm ON idx = i")
def permutation_inverse(spark, sf):
    cells, k = embedding_cells(spark, sf)
    return RI.permute_by(cells, Bijection(k, 9), -1)


@query(
    "r09_permutation_power",
    f"""WITH RECURSIVE {EMB_SQL}, p3 AS (SELECT a.i, c.src FROM perm a JOIN perm b ON a.src = b.i JOIN perm c ON b.src = c.i)
        SELECT row, CAST(p3.i AS INTEGER) AS idx, v FROM e JOIN p3 ON idx = src""",
)
def permutation_power(spark, sf):
    cells, k = embedding_cells(spark, sf)
    return RI.permute_by(cells, Bijection(k, 9), 3)


@query(
    "r09_bijection",
    f"""WITH RECURSIVE {VOCAB}, {permutation_sql('(SELECT count(*) FROM vocab)', 4)}
        SELECT token, id, CAST(p.src AS BIGINT) AS moved, CAST(q.src AS BIGINT) AS moved_twice, id AS back
        FROM vocab JOIN perm p ON id = p.i JOIN perm q ON p.src = q.i""",
)
def bijection(spark, sf):
    """Vocabulary ids under a permutation of all of them, and taken back."""
    ids = vocab(spark, sf).select("token", "id")
    moves = Bijection(ids.count(), 4)
    moved = ids.withColumn("moved", moves.forward(F.col("id"))).withColumn("moved_twice", moves.power(F.col("id"), 2))
    return moved.withColumn("back", moves.inverse(F.col("moved")))


def accumulated_sql(extra: str) -> str:
    return f"""{RI_SQL}, pairs AS (SELECT a.token AS target, b.token AS sign, count(*) AS n FROM tok a JOIN tok b
        ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos - 2 AND a.pos + 2 {extra} GROUP BY 1, 2),
        cells AS (SELECT target, idx, CAST(sum(n * v) AS BIGINT) AS w FROM pairs JOIN ri USING (sign)
                  GROUP BY 1, 2 HAVING sum(n * v) <> 0)"""


CELLS_SQL = f"SELECT target, {PACKED} FROM cells GROUP BY target"


def vector_rows(cells, digits=0):
    return C.packed(cells).withColumn("cells", joined_cells("cells", digits))


@query("r10_context_vectors", f"WITH {accumulated_sql('')} {CELLS_SQL}")
def context_vectors(spark, sf):
    return vector_rows(C.accumulate_context_vectors(corpus(spark, sf), 2, K, S))


@query("r10_context_vectors_no_target", f"WITH {accumulated_sql('AND a.pos <> b.pos')} {CELLS_SQL}")
def context_vectors_no_target(spark, sf):
    return vector_rows(C.accumulate_context_vectors(corpus(spark, sf), 2, K, S, include_target=False))


@query("r10_context_vectors_fast_hash", f"WITH {accumulated_sql('')} {CELLS_SQL}")
def context_vectors_fast_hash(spark, sf):
    return vector_rows(C.accumulate_context_vectors(corpus(spark, sf), 2, K, S, in_place=True))


@query(
    "r11_squash",
    f"""WITH {accumulated_sql('')}, m AS (SELECT target, CASE WHEN count(*) < {K} THEN greatest(max(w), 0) ELSE max(w) END
        AS m FROM cells GROUP BY target),
        q AS (SELECT target, idx, CAST(round(CASE WHEN m = 0 THEN -1.0 ELSE tanh(w::DOUBLE / m) END * 1000000) AS BIGINT) AS w
              FROM cells JOIN m USING (target))
        SELECT target, {PACKED} FROM q GROUP BY target""",
)
def squash(spark, sf):
    return vector_rows(C.squash(C.accumulate_context_vectors(corpus(spark, sf), 2, K, S), K), 6)


@query(
    "r12_training_examples",
    f"""WITH {RI_SQL}, cut AS (SELECT 0.0001::DOUBLE * sum(freq) AS cut FROM freqs),
        dr AS (SELECT token, CASE WHEN freq < cut THEN 0.0 ELSE 1 - sqrt(cut / freq) END AS d FROM freqs, cut),
        kept AS (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos
          FROM tok JOIN dr USING (token)
          WHERE ('0x' || substr(md5('7:' || doc_id || ':' || pos), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE >= d),
        w AS (SELECT a.doc_id, a.pos, b.token AS sign FROM (SELECT doc_id, pos, pos + unnest([-2, -1, 1, 2]) AS at FROM kept) a
              JOIN kept b ON a.doc_id = b.doc_id AND a.at = b.pos),
        s AS (SELECT doc_id, pos, idx, sum(v) AS w FROM w JOIN ri USING (sign) GROUP BY 1, 2, 3 HAVING sum(v) <> 0),
        m AS (SELECT doc_id, pos, max(abs(w)) AS m FROM s GROUP BY 1, 2),
        x AS (SELECT doc_id, pos, string_agg(idx || ':' || CAST(round(w::DOUBLE / m * 1000000) AS BIGINT), ' ' ORDER BY idx) AS x
              FROM s JOIN m USING (doc_id, pos) GROUP BY 1, 2),
        y AS (SELECT sign, string_agg(i || ':100000', ' ' ORDER BY i) AS y
              FROM (SELECT sign, CASE WHEN v > 0 THEN idx ELSE idx + {K} END AS i FROM ri) GROUP BY sign)
        SELECT doc_id, CAST(pos AS INTEGER) AS pos, token AS target, coalesce(x, '') AS x, y
        FROM kept LEFT JOIN x USING (doc_id, pos) JOIN y ON token = sign""",
)
def training_examples(spark, sf):
    examples = C.training_examples(corpus(spark, sf), 2, K, S, seed=7)
    y = F.transform("y", lambda c: F.struct(c["idx"].alias("idx"), c["v"].alias("w")))
    return examples.select("doc_id", "pos", "target", joined_cells("x", 6).alias("x"), joined_cells(y, 6).alias("y"))


@query(
    "r13_sparse_noise",
    f"""WITH ids AS (SELECT CAST(doc_id AS VARCHAR) AS sign FROM documents), {ri_sql('ids', K, 10, 'noise:4:')}
        SELECT CAST(sign AS BIGINT) AS row, CAST(idx AS INTEGER) AS idx, CAST(v AS FLOAT) AS v FROM ri""",
)
def sparse_noise(spark, sf):
    return RI.sparse_noise(table(spark, sf, "documents").select("doc_id"), "doc_id", K, 0.01, seed=4)


@query(
    "r13_additive_noise",
    f"""WITH ids AS (SELECT CAST(doc_id AS VARCHAR) AS sign FROM documents), {ri_sql('ids', 10, 2, 'noise:4:', 'no')},
        {ri_sql('ids', 10, 4)}, u AS (SELECT sign, idx, v FROM ri UNION ALL SELECT sign, idx, v FROM no)
        SELECT CAST(sign AS BIGINT) AS row, CAST(idx AS INTEGER) AS idx, CAST(sum(v) AS DOUBLE) AS v FROM u
        GROUP BY 1, 2 HAVING sum(v) <> 0""",
)
def additive_noise(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("sign"))
    coo = RI.to_coo(RI.index_signs(rows, 10, 4), "doc_id")
    return RI.add_noise(coo, RI.sparse_noise(rows, "doc_id", 10, 0.2, seed=4))


@query(
    "r14_one_hot",
    """SELECT vec_id, array_to_string(list_transform(range(0, (SELECT max(label) + 1 FROM embeddings)),
       lambda i: CASE WHEN i = label THEN 1 ELSE 0 END), '') AS encoded FROM embeddings""",
)
def one_hot(spark, sf):
    vectors = table(spark, sf, "embeddings")
    classes = vectors.agg(F.max("label") + 1).first()[0]
    encoded = R.one_hot(F.col("label"), classes)
    return vectors.select("vec_id", F.array_join(encoded.cast("array<string>"), "").alias("encoded"))


TARGET_SQL = f"""{VOCAB}, ex AS (SELECT doc_id, pos, id AS target FROM tok JOIN vocab USING (token)),
      dr AS (SELECT doc_id, pos, target, d, ('0x' || substr(md5('6:' || doc_id || ':' || pos || ':' || d), 1, 13))::BIGINT
             / 4503599627370496.0::DOUBLE AS u FROM ex, range(0, 2) r(d)),
      z AS (SELECT count(*) AS n, CAST(sum(freq) AS BIGINT) AS total FROM vocab)"""


def examples(spark, sf, ids):
    """Every token of every document as an example."""
    return V.encode_ids(corpus(spark, sf), ids).select("doc_id", F.posexplode("ids").alias("pos", "target"))


@query(
    "r15_negative_samples_uniform",
    f"""WITH {TARGET_SQL} SELECT doc_id, CAST(pos AS INTEGER) AS pos, target, CAST(d AS INTEGER) AS draw, CAST(floor(u * n) AS BIGINT) AS sample,
        1.0::DOUBLE / n AS p FROM dr, z WHERE floor(u * n) <> target""",
)
def negative_samples_uniform(spark, sf):
    ids = vocab(spark, sf)
    return RI.negative_samples(examples(spark, sf, ids), ids, 2, "doc_id", "pos", dist="uniform", seed=6)


ALIAS_SQL = f"""{TARGET_SQL},
      scaled AS (SELECT id, freq, freq * n - total AS spare, n, total FROM vocab, z),
      light AS (SELECT *, coalesce(sum(-spare) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spot FROM scaled WHERE spare < 0),
      heavy AS (SELECT *, coalesce(sum(spare) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spot,
        lead(id) OVER (ORDER BY id) AS next FROM scaled WHERE spare > 0),
      lights AS (SELECT l.id, l.freq, l.spare + l.total AS own, h.id AS alias FROM light l ASOF JOIN heavy h ON l.spot >= h.spot),
      bounds AS (SELECT spot FROM light UNION ALL SELECT sum(-spare)::BIGINT FROM light),
      heavies AS (SELECT h.id, h.freq, h.total - (b.spot - h.spot - h.spare) AS own, CASE WHEN b.spot > h.spot + h.spare THEN h.next ELSE h.id END AS alias
        FROM heavy h ASOF JOIN bounds b ON h.spot + h.spare <= b.spot),
      slots AS (SELECT * FROM lights UNION ALL SELECT * FROM heavies UNION ALL SELECT id, freq, total, id FROM scaled WHERE spare = 0)"""


@query(
    "r15_alias_table",
    f"""WITH {ALIAS_SQL}, shares AS (SELECT id, sum(units) AS units FROM (
          SELECT id, own AS units FROM slots UNION ALL SELECT alias, total - own FROM slots, z) GROUP BY id)
        SELECT s.id, s.freq, CAST(own AS BIGINT) AS own, alias, CAST(units AS BIGINT) AS units FROM slots s JOIN shares USING (id)""",
)
def alias_table(spark, sf):
    """Slots, and the units that each id has over all of them."""
    slots = RI.alias_table(vocab(spark, sf))
    parts = F.array(
        F.struct("id", F.col("own").alias("units")), F.struct(F.col("alias").alias("id"), (F.col("total") - F.col("own")).alias("units"))
    )
    shares = slots.select(F.inline(parts)).groupBy("id").agg(F.sum("units").alias("units"))
    return slots.select("id", "freq", "own", "alias").join(shares, "id")


@query(
    "r15_negative_samples_unigram",
    f"""WITH {ALIAS_SQL}, x AS (SELECT doc_id, pos, target, d, CAST(floor(u * n) AS BIGINT) AS slot, total,
          CAST(floor(('0x' || substr(md5('6:' || doc_id || ':' || pos || ':' || d || ':unit'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * total) AS BIGINT) AS unit
          FROM dr, z),
        picked AS (SELECT x.*, CASE WHEN unit < own THEN s.id ELSE alias END AS sample FROM x JOIN slots s ON slot = s.id)
        SELECT doc_id, CAST(pos AS INTEGER) AS pos, target, CAST(d AS INTEGER) AS draw, sample, round(freq::DOUBLE / total, 12) AS p
        FROM picked JOIN vocab ON sample = vocab.id WHERE sample <> target""",
)
def negative_samples_unigram(spark, sf):
    ids = vocab(spark, sf)
    picked = RI.negative_samples(examples(spark, sf, ids), ids, 2, "doc_id", "pos", seed=6)
    return picked.withColumn("p", F.round("p", 12))


@query(
    "r16_sample_random_indexes",
    f"""WITH ids AS (SELECT CAST(doc_id AS VARCHAR) AS sign FROM documents), {ri_sql('ids', K, 6, 'sample:2:')}
        SELECT CAST(sign AS BIGINT) AS doc_id, string_agg(idx, ' ' ORDER BY r) FILTER (r <= 3) AS pos,
        string_agg(idx, ' ' ORDER BY r) FILTER (r > 3) AS neg FROM ri GROUP BY 1""",
)
def sample_random_indexes(spark, sf):
    drawn = RI.sample_random_indexes(table(spark, sf, "documents").select("doc_id"), "doc_id", K, 7, seed=2)
    return drawn.select("doc_id", "ri.pos", "ri.neg").withColumns({"pos": text("pos"), "neg": text("neg")})
