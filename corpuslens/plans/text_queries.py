"""Registered queries: tokenizer, token classes, cleaning and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import patterns as P
from corpuslens.functions import text as T
from corpuslens.operators import text as TX
from corpuslens.operators import vocabulary as V
from corpuslens.operators.layout import spread_scan
from corpuslens.plans.registry import query, table
from corpuslens.plans.vocabulary_queries import STOP


def sql(pattern: str) -> str:
    """A pattern as SQL literal for a prefix test; lookaheads become consumed text."""
    consumed = P.portable(pattern).replace("(?=", "(?:").replace("(?!@)", r"(?:[^@]|\z)")
    return "'" + consumed.replace("'", "''") + "'"


def begins(pattern: str, column: str = "token") -> str:
    return f"regexp_matches({column}, {sql(f'^(?:{pattern})')})"


# blank-separated tokens: a split both engines agree on
SPLIT = r"""s AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '') AS t FROM documents),
    raw AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM s)"""
DISTINCT = f"{SPLIT}, d AS (SELECT token, count(*) AS n FROM raw GROUP BY token)"


def documents(spark, sf):
    return spread_scan(table(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id")


def raw_corpus(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.filter(F.split("text", "[ \n]+"), lambda t: t != "").alias("tokens")
    )


def raw_counts(spark, sf):
    return V.word_frequencies(raw_corpus(spark, sf)).withColumnRenamed("freq", "n")


# SQL engines without lookaheads match the text that follows as well; these give the match itself.
SMILEY_END = rf"[pPd3][^{P.WORD_CHARS}]"
DOMAIN = rf"(?i:{P.URL_DOMAIN_STEPS}(?::{P.D}{{2,5}})?/?)"
VERSION_END = P.VERSION.replace(r"(?=\P{Nd}|\z)", r"\P{Nd}")


def own_match(kind: str, m: str) -> str:
    """SQL for the match itself, given `m`, which may hold one more character."""
    if kind in ("version", "numeric"):
        return f"CASE WHEN regexp_full_match({m}, {sql(VERSION_END)}) THEN left({m}, length({m}) - 1) ELSE {m} END"
    if kind == "url":
        return f"""CASE WHEN regexp_full_match({m}, {sql(f'(?i:{P.URL_SCHEME})')}) OR regexp_full_match({m}, {sql(DOMAIN)}) THEN {m}
            ELSE left({m}, length({m}) - 1) END"""
    if kind == "emoticon":
        return f"CASE WHEN regexp_matches({m}, {sql(f'^[:=;].*{SMILEY_END}$')}) THEN left({m}, length({m}) - 1) ELSE {m} END"
    return m


def extracted(pattern: str, column: str = "rest") -> str:
    return f"regexp_extract({column}, {sql(f'^(?:{pattern})')})"


def first_token(column: str = "rest") -> str:
    """SQL for the token at the start of a text: the first rule that matches, or one character."""
    own = {
        "URL": own_match("url", extracted(P.URL, column)),
        "NUMERIC": own_match("numeric", extracted(P.NUMERIC, column)),
        "EMOTICON": own_match("emoticon", extracted(P.EMOTICON, column)),
        "CONTRACTION_W1": f"left({column}, 1)",
        "CONTRACTION_W2": f"left({column}, 2)",
        "CONTRACTION_W3": f"regexp_extract({column}, {sql(f'^(?i:([a-z]+)(?:{P.SPLIT_SUFFIX}))')}, 1)",
        "CONTRACTION_W4": f"left({column}, 2)",
    }
    rules = [f"WHEN {begins(p, column)} THEN {own.get(name, extracted(p, column))}" for name, p in P.TOKEN_RULES]
    return "CASE " + " ".join(rules) + f" ELSE left({column}, 1) END"


HYPHENATED = f"CASE WHEN instr(token, chr(173)) = 0 THEN token WHEN token = chr(173) THEN '-' WHEN regexp_matches(token, {sql(T._HYPHENATED)}) THEN replace(token, chr(173), '') ELSE token END"
# A cursor walks every text; the engine carries the rest of the text from step to step.
WALK = f"""walk AS (SELECT doc_id, 0 AS pos, '' AS token, text AS rest FROM documents
      UNION ALL SELECT doc_id, pos + 1, token, substr(rest, length(token) + 1) FROM (
        SELECT doc_id, pos, {first_token()} AS token, rest FROM walk WHERE rest <> '')),
    raw AS (SELECT doc_id, pos, {HYPHENATED} AS token FROM walk WHERE pos > 0 AND NOT {begins(P.SPACES)})"""


def tokens_sql(value: str = "token", where: str = "true", columns: str = "coalesce(tokens, '') AS tokens") -> str:
    return f"""WITH RECURSIVE {WALK}, k AS (SELECT doc_id, string_agg({value}, ' ' ORDER BY pos) AS tokens, count(*) AS n
        FROM raw WHERE {where} GROUP BY doc_id) SELECT doc_id, {columns} FROM documents LEFT JOIN k USING (doc_id)"""


@query("t01_tokenize", tokens_sql(columns="coalesce(n, 0)::INTEGER AS n, coalesce(tokens, '') AS tokens"))
def tokenize(spark, sf):
    tokens = TX.tokenize(documents(spark, sf), drop_space=True)
    return tokens.select("doc_id", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("tokens"))


KIND_SQL = "CASE " + " ".join(f"WHEN {begins(p)} THEN '{name}'" for name, p in P.TOKEN_RULES) + " END"


@query("t02_classify_tokens", f"WITH {DISTINCT} SELECT token, n, {KIND_SQL} AS kind FROM d")
def classify_tokens(spark, sf):
    return TX.classify_tokens(raw_counts(spark, sf))


PREDICATE_SQL = {
    "is_numeric": begins(P.NUMERIC),
    "is_word": begins(P.WORD),
    "is_space": begins(P.SPACES),
    "is_punct": begins(P.PUNCT),
    "is_parens_bracket": begins(P.BRACKET),
    "is_quote": begins(P.QUOTE),
    "is_url": begins(P.URL),
    "is_email": begins(P.EMAIL),
    "is_currency": begins(P.CURRENCY),
    "is_stopword": f"lower(token) IN {STOP}",
    "is_copyright": begins(P.COPYRIGHT),
}


@query(
    "t03_token_predicates",
    f"WITH {DISTINCT} SELECT token, n, " + ", ".join(f"{q} AS {c}" for c, q in PREDICATE_SQL.items()) + " FROM d",
)
def token_predicates(spark, sf):
    counts = raw_counts(spark, sf)
    return counts.select("token", "n", *[fn(F.col("token")).alias(name) for name, fn in T.PREDICATES.items()])


REPLACED = (
    f"CASE WHEN {begins(P.URL)} THEN 'T_URL' WHEN {begins(P.EMAIL)} THEN 'T_EMAIL' "
    f"WHEN {begins(P.CURRENCY)} THEN 'T_CURRENCY' ELSE token END"
)
VALID = f"NOT ({begins(P.PUNCT)} OR {begins(P.SPACES)} OR {begins(P.COPYRIGHT)} OR token IN ('@card', '@ord'))"


def regrouped(value: str, where: str = "true") -> str:
    return f"""WITH {SPLIT}, k AS (SELECT doc_id, string_agg({value}, ' ' ORDER BY pos) AS tokens FROM raw WHERE {where}
        GROUP BY doc_id) SELECT doc_id, coalesce(tokens, '') AS tokens FROM documents LEFT JOIN k USING (doc_id)"""


def joined(df):
    return df.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query("t04_replace_entities", regrouped(REPLACED))
def replace_entities(spark, sf):
    return joined(raw_corpus(spark, sf).withColumn("tokens", T.replace_entities(F.col("tokens"))))


@query("t05_drop_invalid_tokens", regrouped("token", VALID))
def drop_invalid_tokens(spark, sf):
    return joined(raw_corpus(spark, sf).withColumn("tokens", T.drop_invalid_tokens(F.col("tokens"))))


@query(
    "t06_normalize_words",
    r"SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '\p{L}+'), ' ') AS tokens FROM documents",
)
def normalize_words(spark, sf):
    return joined(TX.normalize_corpus(documents(spark, sf), mode="words"))


@query("t06_normalize_split", regrouped(f"lower({REPLACED})", VALID))
def normalize_split(spark, sf):
    return joined(raw_corpus(spark, sf).withColumn("tokens", T.normalize(F.col("tokens"))))


@query("t06_normalize_corpus", tokens_sql(f"lower({REPLACED})", VALID))
def normalize_corpus(spark, sf):
    return joined(TX.normalize_corpus(documents(spark, sf)))


@query("t07_remove_stopwords", regrouped("token", f"lower(token) NOT IN {STOP} AND lower(token) NOT IN ('les', 'der')"))
def remove_stopwords(spark, sf):
    kept = T.remove_stopwords(F.col("tokens"), ("les", "der"))
    return joined(raw_corpus(spark, sf).withColumn("tokens", kept))


KINDS = list(P.ENTITY_KINDS)


def entities_sql(rows: str, kinds=KINDS) -> str:
    """Every match of every kind in `rows` (doc_id, text), counted per document."""
    matches = " UNION ALL ".join(
        f"""SELECT doc_id, '{k}' AS kind, {own_match(k, 'm')} AS value FROM (
        SELECT doc_id, unnest(regexp_extract_all(text, {sql(P.ENTITY_KINDS[k])})) AS m FROM {rows})"""
        for k in kinds
    )
    return f"SELECT doc_id, kind, value, count(*) AS n FROM ({matches}) GROUP BY ALL"


def counted(found):
    return found.groupBy("doc_id", "kind", "value").agg(F.count("*").alias("n"))


@query("t08_extract_entities", entities_sql("documents"))
def extract_entities(spark, sf):
    return counted(TX.extract_entities(documents(spark, sf)))


@query(
    "t08_extract_lookahead_entities",
    entities_sql("(SELECT page_id AS doc_id, concat_ws(' ', url, html) AS text FROM pages)", P.LOOKAHEAD_KINDS),
)
def extract_lookahead_entities(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.concat_ws(" ", "url", "html").alias("text"))
    return counted(TX.extract_entities(spread_scan(pages, "doc_id"), P.LOOKAHEAD_KINDS))


@query(
    "t09_split_contractions",
    "WITH a AS (SELECT doc_id, regexp_replace(replace(replace(text, 'nt ', 'n''t '), 'es ', 'e''s '), "
    + sql(f"(?i)([a-z]+)({P.CONTRACTION}++)")
    + ", '\\1 \\2', 'g') AS text FROM documents), b AS (SELECT doc_id, regexp_replace(text, "
    + sql(f"(?i)\\b(y{P.APOSTROPHE})({P.LETTER}{{3,}})")
    + ", '\\1 \\2', 'g') AS text FROM a) SELECT doc_id, regexp_replace(text, "
    + sql(f"(?i)({P.APOSTROPHE}t)(is|was)")
    + ", '\\1 \\2', 'g') AS text FROM b",
)
def split_contractions(spark, sf):
    # the tables hold few apostrophes, so some word endings are rewritten into contractions
    made = F.replace(F.replace("text", F.lit("nt "), F.lit("n't ")), F.lit("es "), F.lit("e's "))
    return documents(spark, sf).select("doc_id", T.split_contractions(made).alias("text"))


@query(
    "t10_strip_soft_hyphen",
    f"""WITH {DISTINCT}, h AS (SELECT translate(token, 'a', chr(173)) AS token, n FROM d)
        SELECT CASE WHEN token = chr(173) THEN '-' ELSE replace(token, chr(173), '') END AS token,
        CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1""",
)
def strip_soft_hyphen(spark, sf):
    hyphenated = F.translate("token", "a", T.SHY)  # soft hyphens made from a letter
    cleaned = raw_counts(spark, sf).withColumn("token", T.strip_soft_hyphen(hyphenated))
    return cleaned.groupBy("token").agg(F.sum("n").alias("n"))


C1 = "chr(" + ") || chr(".join(str(ord(c)) for c in T.C1_CHARS) + ")"


@query(
    "t11_repair_charset",
    f"""WITH {DISTINCT}, h AS (SELECT n, translate(token, 'aet', chr(147) || chr(129) || chr(133)) AS w FROM d)
        SELECT CASE WHEN regexp_matches(w, '{T.C1_UNDEFINED}') THEN CASE WHEN length(w) > 1
        THEN regexp_replace(w, '{T.NOT_PRINTABLE}', '', 'g') ELSE ' ' END
        ELSE translate(w, {C1}, '{T.CP1252_CHARS}') END AS token, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1""",
)
def repair_charset(spark, sf):
    garbled = F.translate("token", "aet", "\x93\x81\x85")  # bytes of both kinds made from letters
    repaired = raw_counts(spark, sf).withColumn("token", T.repair_charset(garbled))
    return repaired.groupBy("token").agg(F.sum("n").alias("n"))


@query(
    "t12_entity_profile",
    "WITH x AS ("
    + " UNION ALL ".join(
        f"SELECT lang, '{k}' AS kind, len(regexp_extract_all(text, {sql(P.ENTITY_KINDS[k])})) AS n FROM documents"
        for k in KINDS
    )
    + ") SELECT lang, kind, CAST(sum(n) AS BIGINT) AS n FROM x GROUP BY ALL",
)
def entity_profile(spark, sf):
    return TX.entity_profile(documents(spark, sf), "lang")
