"""Secret scans with a trigram inverted index, in DataFrame operations only.

From each rule's pattern the driver derives a Boolean query over trigrams that any match
must contain: alternatives of sets of trigrams, in lower case.  One scan of the texts
writes the postings (trigram, doc_id) of the trigrams that some query asks for; others
could never be looked up.  Intersecting postings gives the candidates of each rule.  A
second scan applies the patterns themselves, each only to its candidates.  A pattern
without mandatory trigrams, such as a run of hex digits, is applied to every text.

A match is greedy, leftmost and non-overlapping; one whose measured group is shorter than
the rule demands is dropped.  Offsets are code points, the end exclusive.

Candidates are joined to the texts by id.  The stored table has a known size: below the
session's threshold Spark broadcasts it, above it is an ordinary join.  No step gathers
more than one document's matches in one place.

Rows: a null text is empty; rows with equal (or null) ids share their candidates, which
only costs time, as every match is verified in its own text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import let, stored, sums_before

MAX_STRINGS = 64  # alternatives followed while a query is derived; beyond it the run of literals ends


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length is measured
    at_least: int = 0


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([_either_case(w) for w in ("password", "passwd", "secret", "token")] + [_either_case("api") + "_?" + _either_case("key")])

# The base kinds, in the order of their report.  A run of hex digits is maximal, so asking
# for 24 at once finds the same runs as taking all and dropping the short ones.
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of trigram sets, one of which every match contains; None: no mandatory ones."""
    alternatives = _required(list(re._parser.parse(pattern)))  # noqa: SLF001
    if frozenset() in alternatives:
        return None
    return sorted(alternatives, key=sorted)


def _required(nodes: list) -> set[frozenset[str]]:
    need: set[frozenset[str]] = {frozenset()}
    run = {""}

    def both(a: set[frozenset[str]], b: set[frozenset[str]]) -> set[frozenset[str]]:
        joined = {x | y for x in a for y in b}
        return {x for x in joined if not any(y < x for y in joined)}  # a superset asks for more than needed

    def close() -> None:
        nonlocal need, run
        need, run = both(need, {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}), {""}

    for node in nodes:
        strings = _strings(node)
        if strings is not None and len(run) * len(strings) <= MAX_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        close()
        if strings is not None:
            run = strings
        else:
            name, value = str(node[0]), node[1]
            if name == "BRANCH":
                inner = set().union(*[_required(list(x)) for x in value[1]])
                need = both(need, inner)
            elif name == "SUBPATTERN":
                need = both(need, _required(list(value[3])))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0]:
                need = both(need, _required(list(value[2])))
    close()
    return need


def _strings(node) -> set[str] | None:
    """All lower-cased strings that a node can match, if they are few."""
    name, value = str(node[0]), node[1]
    if name == "LITERAL":
        return {chr(value).lower()}
    if name == "IN":
        found = set()
        for kind, x in value:
            if str(kind) != "LITERAL":
                return None
            found.add(chr(x).lower())
        return found
    if name == "BRANCH":
        parts = [_sequence(list(x)) for x in value[1]]
    elif name == "SUBPATTERN":
        parts = [_sequence(list(value[3]))]
    elif name == "MAX_REPEAT" and value[:2] == (0, 1):
        parts = [{""}, _sequence(list(value[2]))]
    else:
        return None
    return None if None in parts else set().union(*parts)


def _sequence(nodes: list) -> set[str] | None:
    out = {""}
    for node in nodes:
        strings = _strings(node)
        if strings is None or len(out) * len(strings) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in strings}
    return out


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id): the inverted index of `trigrams`, stored."""
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    folded = docs.select("doc_id", text.alias("_text"))
    present = F.array_compact(F.array(*[F.when(F.contains(F.col("_text"), F.lit(t)), F.lit(t)) for t in trigrams]))
    return stored(folded.select(F.explode(present).alias("trigram"), "doc_id"), "trigrams")


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(doc_id, kinds): the documents that satisfy the rules' queries, by intersecting postings."""
    spark = index.sparkSession
    asked = [
        (kind, i, len(part), t) for kind, parts in queries.items() for i, part in enumerate(parts) for t in sorted(part)
    ]
    terms = spark.createDataFrame(asked, "kind string, part int, need int, trigram string")  # a few rows per rule
    met = (
        index.join(F.broadcast(terms), "trigram")
        .groupBy("doc_id", "kind", "part", "need")
        .agg(F.size(F.collect_set("trigram")).alias("have"))
        .where("have = need")
    )
    return stored(met.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds")), "candidates")


SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def matches_of(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's matches in a text: an array of (start, rank, kind, end)."""
    regex = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    found = F.transform(F.regexp_extract_all(text, regex, F.lit(0)), F.length)
    measured = found if rule.group == 0 else F.transform(F.regexp_extract_all(text, regex, F.lit(rule.group)), F.length)

    def spans(s: Column) -> Column:
        # A match begins after the gaps up to it and the matches before it.
        steps = F.zip_with(F.slice(s["gaps"], 1, F.size(s["found"])), s["found"], lambda g, m: g + m)
        placed = F.zip_with(
            F.zip_with(sums_before(steps), s["gaps"], lambda before, gap: before + gap),
            F.arrays_zip(s["found"].alias("length"), s["measured"].alias("measured")),
            lambda start, m: F.struct(
                start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"),
                (start + m["length"]).alias("end"), m["measured"].alias("measured"),
            ),
        )
        kept = F.filter(placed, lambda p: p["start"].isNotNull() & (p["measured"] >= rule.at_least))
        return F.transform(kept, lambda p: F.struct(p["start"], p["rank"], p["kind"], p["end"]))

    empty = F.array().cast(SPAN)
    located = let(F.struct(gaps.alias("gaps"), found.alias("found"), measured.alias("measured")), spans).cast(SPAN)
    return F.when(F.regexp_like(text, regex), located).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id and ``found``: every match of every rule, by start and then rule."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {kind: q for kind, q in queries.items() if q}
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if indexed:
        index = postings(docs, sorted({t for q in indexed.values() for part in q for t in part}))
        named = candidates(index, indexed).withColumnRenamed("doc_id", "_id")
        texts = texts.join(named, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "kinds")
    empty = F.array().cast(SPAN)
    found = [
        F.when(F.array_contains("kinds", rule.kind), matches_of(F.col("text"), rule, rank)).otherwise(empty)
        if rule.kind in indexed
        else matches_of(F.col("text"), rule, rank)
        for rank, rule in enumerate(rules)
    ]
    return texts.select("doc_id", F.array_sort(F.concat(*found)).alias("found"))


def described(found: Column) -> Column:
    """Matches as ``kind:start:end``, joined by commas."""
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their places, and all places, for each document."""
    found = scan(docs).select("doc_id", "found", F.filter("found", lambda s: s["rank"] < len(BASE)).alias("base"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(described(F.col("base")), 256).alias("base_sha256"), described(F.col("found")).alias("spans")
    )
