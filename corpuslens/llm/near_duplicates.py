"""Near-duplicate groups: bottom-k sketches, inverted lists, exact verification.

A document is the set of its distinct word shingles; documents whose sets have a Jaccard
similarity of at least `THRESHOLD` percent are linked, and groups are the connected
components of the links.

Equal sets (copies) form one class, and everything below works on classes.  One hash
function orders all shingles; a class keeps the `K` smallest as its sketch.  Linked
classes share many retained values: of the K smallest of their union each is in both with
the probability of their similarity, so fewer than `floor_of(K)` common ones occur with a
probability below `MISS`.  Hence a class with fewer values that any other class retains
has no partner, and the others need an entry only in the lists of their rarest values: if
two share at least t of m values, they share one of the m - t + 1 rarest.  Common passages
are in few lists this way.

Candidates from the lists are filtered by the estimate from their union's sketch, and what
is left is verified on full sets, which are made again from the texts: texts travel to
their candidates, never all pairs of a list.  First a list offers only pairs with one
pivot, the member that shares most of its values; linked members fall into one component, and
pairs inside a component need no test.  When few pairs are left between components, all
are tested.  Where many are left (classes that consist of common passages), the lists'
members get a second index over full sets, in which the bounds on common values are exact
and hold without probability; further rounds follow there as long as they link and leave
clearly fewer pairs.  Then all pairs that are left are tested.  Entries of this index carry
a histogram of their class's values by hash; two classes have no more values in common than
the histograms, so near copies beyond the threshold are not paired, though they share lists.

Every stage deals its work by class, list value or (pivot, part of its members), lists are
never gathered, and joins whose one side is hot are left to adaptive execution's splitting.
Tables of candidates are broadcast only up to `BROADCAST_ROWS` rows.

Rows: null and empty texts, and texts of white space only, have empty sets and are linked
with nothing; repeated rows and null ids are allowed, a null id never names a group that
has another.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import remove, stored, stored_at, unpacked, whole

SHINGLE = 4
THRESHOLD = 80  # percent
K = 64
MISS = 1e-9
MEMBERS = 256  # members that meet a pivot in one place
FEW = 0.5  # pairs left for each index entry that may be tested without further rounds
FEW_EXACT = 1  # the same for lists over full sets
FEWEST_LINKS = 50  # rounds go on while one pair in so many is a link
FALLING = 0.9  # and while each leaves at most this share of the pairs that it found,
MOST = 256  # unless more pairs than this are left for each index entry
BUCKETS, LEVELS = 512, 3  # histograms of full sets: buckets, a multiple of 64, and values told apart in each
BROADCAST_ROWS = 500_000
WORDS_HELD = 1 << 20  # word hashes remembered by a task


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS_HELD:
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (a common finaliser), then drops the sign bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def shingle_set(text: bytes | None, hashes: dict, width: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles; A-Z are lower-cased, words split at ASCII white space."""
    words = (text or b"").lower().split()
    n = len(words)
    codes = np.fromiter((hashes[w] for w in words), np.uint64, n)
    if n == 0:
        return np.zeros(0, np.int64)
    size = min(width, n)
    value = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        value = value * np.uint64(0x9E3779B97F4A7C15) + codes[i : n - size + 1 + i]
    return np.unique(_mixed(value))


def floor_of(k: int, threshold: int = THRESHOLD, miss: float = MISS) -> int:
    """The largest t such that k draws, each a hit with the threshold's chance, give fewer than t hits with chance below `miss`."""
    p, total = threshold / 100, 0.0
    for t in range(k + 1):
        total += comb(k, t) * p**t * (1 - p) ** (k - t)
        if total >= miss:
            return t
    return k


def sketches(docs: DataFrame, width: int = SHINGLE, k: int = K) -> DataFrame:
    """doc_id, mark (of the text), n (set size), digest (of the set) and sketch of every row; stored."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            sizes, digests, lows = [], [], []
            for text in batch.column(2).cast(pa.binary()):
                values = shingle_set(text.as_py(), hashes, width)
                sizes.append(len(values))
                digests.append(xxhash.xxh3_128_hexdigest(values.tobytes()) if len(values) else None)
                lows.append(values[:k])
            arrays = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(lows, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "mark", "n", "digest", "sketch"])

    rows = docs.select("doc_id", F.coalesce(F.md5("text"), F.lit("none")).alias("mark"), "text")
    return stored(rows.mapInArrow(made, "doc_id long, mark string, n long, digest string, sketch array<long>"), "sketches")


def classes_of(sketched: DataFrame) -> DataFrame:
    """One row for each distinct set: node, digest, doc (its smallest id), mark (of a text of that id), n, sketch; stored."""
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "mark")).alias("k")
    grouped = sketched.where("n > 0").groupBy("digest").agg(smallest, F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    named = grouped.select("digest", F.col("k.doc_id").alias("doc"), F.col("k.mark").alias("mark"), "n", "sketch")
    return stored(named.select(F.monotonically_increasing_id().alias("node"), "*"), "classes")


def texts_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """`wanted`, whose rows name a text by (doc, mark), with the text; equal rows of `docs` count once."""
    same = F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("_mark") == F.col("mark"))
    keys = wanted.select("doc", "mark").distinct()
    marked = docs.select("doc_id", F.md5("text").alias("_mark"), "text").join(small_or_shuffled(keys), same, "left_semi")
    single = marked.groupBy("doc_id", "_mark").agg(F.first("text").alias("text"))
    return single.join(small_or_shuffled(wanted), same)


def index_of(values: DataFrame, need: Column, need_of_longer: Column, histogram: bool = False) -> DataFrame:
    """(value, node, n, weight, short): entries in the lists of each class's rarest values.

    `values` has (node, n, value); any partner has at least `need` values in common, a
    partner that is not shorter at least `need_of_longer`.  Two linked classes share a list
    in which the shorter one's entry is ``short``.  ``weight`` counts the values that others
    have, too.  ``histogram`` adds where these values fall by hash: bits, whose level l marks
    the buckets of at least l values, and over, the values beyond the last level.
    """
    shared = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    found = values.join(shared, "value")
    entry, added = F.collect_list(F.struct("df", "value")), []
    if histogram:
        bucket = F.pmod("value", F.lit(BUCKETS)).cast("int").alias("bucket")
        found = found.groupBy("node", "n", bucket).agg(entry.alias("part"), F.count("*").alias("c"))
        bit = F.expr("shiftleft(1L, bucket % 64)")
        lane = lambda l, k: F.bit_or(F.when((F.col("c") >= l) & (F.floor(F.col("bucket") / 64) == k), bit).otherwise(F.lit(0)))
        bits = F.array(*[lane(l, k) for l in range(1, LEVELS + 1) for k in range(BUCKETS // 64)])  # noqa: E741
        entry, added = F.flatten(F.collect_list("part")), [bits.alias("bits"), F.sum(F.greatest(F.col("c") - LEVELS, F.lit(0))).alias("over")]
    own = found.groupBy("node", "n").agg(F.sort_array(entry).alias("own"), *added)
    kept = own.columns[3:]
    enough = own.withColumns(
        {"weight": F.size("own"), "_need": need.cast("int"), "_longer": need_of_longer.cast("int")}
    ).where("weight >= _need")
    rarest = F.slice("own", F.lit(1), F.col("weight") - F.col("_need") + 1)
    entries = enough.select("node", "n", "weight", "_longer", *kept, F.posexplode(rarest).alias("i", "e"))
    short = F.col("i") <= F.col("weight") - F.col("_longer")
    return stored(entries.select("e.value", "node", "n", "weight", short.alias("short"), *kept), "lists")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes with edges (a, b), by alternating large and small stars.

    comp is the smallest node.  A round shuffles the edges by node with the minimum
    aggregated before, so a hub is one row per task.  It ends when all edges form stars,
    which is read off the degrees; edges that do from the start need no round.
    """
    links, held = stored_at(edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low < high").distinct(), "links")
    while True:
        both = links.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(
            links.select(F.col("low").alias("u"), F.col("high").alias("v"))
        )
        lower = F.count(F.when(F.col("v") < F.col("u"), 1)).alias("lower")
        degrees = both.groupBy("u").agg(lower, F.count("*").alias("n"))
        if not degrees.where("lower > 1 or lower = 1 and n > 1").agg(F.count("*")).first()[0]:
            break
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = links.join(least, F.col("low") == F.col("u")).select("high", F.col("m").alias("low")).where("low < high")
        near = large.groupBy("high").agg(F.min("low").alias("m"))
        to_least = lambda c: F.struct(F.col(c).alias("high"), F.col("m").alias("low"))
        small = large.join(near, "high").select(F.explode(F.array(to_least("high"), to_least("low"))).alias("e"))
        passed = held
        links, held = stored_at(small.select("e.low", "e.high").where("low < high").distinct(), "links")
        remove(links.sparkSession, passed)  # a round reads the one before only
    roots = links.select(F.col("low").alias("node"), F.col("low").alias("comp")).distinct()
    return links.select(F.col("high").alias("node"), F.col("low").alias("comp")).unionByName(roots)


def small_or_shuffled(df: DataFrame) -> DataFrame:
    """Marked for broadcast when it is counted to be small, else joined by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def likely(pairs: DataFrame, classes: DataFrame, k: int = K, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose union's sketch does not speak against the threshold."""
    one = classes.select(F.col("node").alias("a"), F.col("sketch").alias("_a"), F.col("n").alias("_na"))
    two = classes.select(F.col("node").alias("b"), F.col("sketch").alias("_b"), F.col("n").alias("_nb"))
    rows = pairs.join(one, "a").join(two, "b")
    lowest = F.slice(F.array_sort(F.array_union("_a", "_b")), 1, k)
    common = F.size(F.array_intersect(F.array_intersect("_a", "_b"), lowest))
    complete = F.greatest("_na", "_nb") <= k  # then the sketches are the sets
    need = F.when(complete, F.ceil(F.size(F.array_union("_a", "_b")) * threshold / 100)).otherwise(floor_of(k, threshold))
    common_all = F.when(complete, F.size(F.array_intersect("_a", "_b"))).otherwise(common)
    return rows.where(common_all >= need).select("a", "b")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold; stored.

    Members go to their pivot a in parts of about `MEMBERS`, each part with a copy of the
    pivot's text; a task holds one pivot's set and one batch of texts.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("_parts"))
    dealt, dealt_path = stored_at(pairs.join(parts, "a").select("a", F.pmod(F.hash("b"), F.col("_parts")).alias("part"), "b"), "dealt")
    heads = dealt.select("a", "part").distinct().select("a", "part", F.lit(0).alias("role"), F.col("a").alias("node"))
    members = dealt.select("a", "part", F.lit(1).alias("role"), F.col("b").alias("node"))
    named = heads.unionByName(members).join(classes.select("node", "digest", "doc", "mark"), "node")
    wanted, wanted_path = stored_at(named, "wanted")
    rows = texts_of(wanted, docs).select("a", "part", "role", "node", "digest", "text").repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, place, pivot = _WordHashes(), None, None
        for batch in batches:
            out = ([], [])
            a, part, role, node, digest = (batch.column(i).to_pylist() for i in range(5))
            for i, text in enumerate(batch.column(5).cast(pa.binary())):
                values = shingle_set(text.as_py(), hashes, width)
                if xxhash.xxh3_128_hexdigest(values.tobytes()) != digest[i]:
                    continue  # another row with the same id
                if role[i] == 0:
                    place, pivot = (a[i], part[i]), values
                elif place == (a[i], part[i]):
                    common = len(np.intersect1d(pivot, values, assume_unique=True))
                    if 100 * common >= threshold * (len(pivot) + len(values) - common):
                        out[0].append(a[i])
                        out[1].append(node[i])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    found = stored(rows.mapInArrow(checked, "a long, b long").distinct(), "edges")
    remove(found.sparkSession, dealt_path, wanted_path)
    return found


def _may_reach(threshold: int, exact: bool) -> Column:
    """Whether two entries of one list can belong to linked classes, by sizes, shared values and, if exact, histograms."""
    similar = F.least("n", "na") * 100 >= F.greatest("n", "na") * threshold
    marked = F.when(F.col("n") < F.col("na"), F.col("short")).when(F.col("n") > F.col("na"), F.col("sa"))
    listed = similar & marked.otherwise(F.col("short") & F.col("sa"))
    if not exact:
        return listed
    both = reduce(Column.__add__, [F.bit_count(F.col("bits")[i].bitwiseAND(F.col("ba")[i])) for i in range(LEVELS * BUCKETS // 64)])
    for common in (F.least("weight", "wa"), both + F.least("over", "oa")):  # at most so many
        listed = listed & (common * 100 >= (F.col("n") + F.col("na") - common) * threshold)
    return listed


def linked(
    index: DataFrame, edges: DataFrame | None, classes: DataFrame, docs: DataFrame, width: int, threshold: int, last: bool
) -> tuple[DataFrame, DataFrame | None]:
    """Edges with the components of `edges` and the links that the lists of `index` lead to, and lists that are left.

    `last`: the index is over full sets, and no list is left.  Else one round is made, and
    lists are left where many pairs remain.  Components found by a round go on as stars, so
    that the next one does not start from single links again.
    """
    entries, tested, going, before = index.count(), None, True, None
    while True:
        first = edges is None
        if first:  # every class is a component of its own
            member = index.withColumns({"comp": F.col("node"), "outside": F.lit(True)})
            finish = False
        else:
            comp = components(edges)
            edges = comp.where("node != comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))
            labelled, labelled_path = stored_at(index.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "members")
            lists = _open_lists(labelled)
            cost = lists.agg(F.sum("cost")).first()[0]
            if cost is None:
                return edges, None
            slow = before is not None and cost > FALLING * before and cost <= MOST * entries
            finish = cost <= (FEW_EXACT if last else FEW) * entries or (last and (slow or not going))
            before = cost
            if not finish and not last:
                return edges, lists.select("value")
            member = labelled.join(lists.select("value", "major"), "value").withColumn("outside", F.col("comp") != F.col("major"))
        outside = member.where("outside")
        whole_set = F.col("n") if last else F.least("n", F.lit(K))
        histogram = ["bits", "over"] if last else []
        entry = F.struct((F.col("weight") / whole_set).alias("share"), "weight", F.col("node").alias("m"), "n", "comp", "short", *histogram).alias("p")
        if finish:
            chosen = outside.select("value", entry)
        else:  # the member that shares most of its values, after the first round one outside the largest component
            chosen = outside.groupBy("value").agg(F.max(entry).alias("p"))
        chosen = chosen.select(
            "value", F.col("p.m").alias("a"), F.col("p.n").alias("na"), F.col("p.comp").alias("ca"),
            F.col("p.weight").alias("wa"), F.col("p.short").alias("sa"), *[F.col(f"p.{c}").alias(f"{c[0]}a") for c in histogram],
        )
        met = (F.col("comp") != F.col("ca")) & _may_reach(threshold, last)
        if finish:  # two members outside meet once
            met = met & (~F.col("outside") | (F.col("a") < F.col("node")))
        pairs = member.join(chosen, "value").where(met).select("a", F.col("node").alias("b")).distinct()
        if tested is not None:
            known = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = verified(likely(pairs, classes, threshold=threshold), classes, docs, width, threshold)
        edges = found if first else edges.unionByName(found)
        if not first:
            remove(index.sparkSession, labelled_path)  # the next round labels the members anew
        if finish:
            return edges, None
        going = found.count() * FEWEST_LINKS >= pairs.count() > 0


def _open_lists(member: DataFrame) -> DataFrame:
    """Lists whose members are in several components: (value, major, cost); stored.

    `major` is the component with most members, `cost` the pairs with members outside it.
    """
    shorts = F.count(F.when(F.col("short"), 1)).alias("shorts")
    by_comp = member.groupBy("value", "comp").agg(F.count("*").alias("c"), shorts)
    lists = by_comp.groupBy("value").agg(
        F.sum("c").alias("size"), F.sum("shorts").alias("shorts"), F.max(F.struct("c", "comp", "shorts")).alias("major"),
        F.count("*").alias("comps"),
    ).where("comps > 1 and shorts > 0")
    rest, rest_shorts = F.col("size") - F.col("major.c"), F.col("shorts") - F.col("major.shorts")
    cost = rest * F.col("shorts") + rest_shorts * F.col("size")
    return stored(lists.select("value", F.col("major.comp").alias("major"), cost.alias("cost")), "open")


def links(docs: DataFrame, classes: DataFrame, width: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): edges that connect each component of classes, by verified links or as its star."""
    values = classes.select("node", "n", F.explode("sketch").alias("value"))
    exact = F.ceil(F.col("n") * threshold / 100)
    need = F.when(F.col("n") * 100 <= K * threshold, exact).otherwise(floor_of(K, threshold))
    index = index_of(values, need, need)
    edges, left = linked(index, None, classes, docs, width, threshold, last=False)
    if left is None:
        return edges
    # Full sets for the classes of the lists that are left.
    nodes = index.join(left, "value", "left_semi").select("node").distinct()
    wanted = stored(classes.join(nodes, "node", "left_semi").select("node", "n", "digest", "doc", "mark"), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            digest = batch.column(2).to_pylist()
            held = [shingle_set(text.as_py(), hashes, width) for text in batch.column(3).cast(pa.binary())]
            own = [v if xxhash.xxh3_128_hexdigest(v.tobytes()) == d else v[:0] for v, d in zip(held, digest, strict=True)]
            arrays = [batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "n", "vals"])

    full = texts_of(wanted, docs).select("node", "n", "digest", "text").mapInArrow(sets, "node long, n long, vals array<long>")
    rows = stored(full.select("node", "n", F.explode("vals").alias("value")).distinct(), "values")
    of_longer = F.ceil(F.col("n") * (2 * threshold) / (100 + threshold))
    return linked(index_of(rows, exact, of_longer, histogram=True), edges, classes, docs, width, threshold, last=True)[0]


def groups(docs: DataFrame, width: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, mark, n and (comp, component_id) of every row; rows with empty sets have no comp."""
    sketched = sketches(docs, width)
    classes = classes_of(sketched)
    comp = components(links(docs, classes, width, threshold))
    named = classes.select("node", "digest", "doc").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = named.groupBy("comp").agg(F.min("doc").alias("component_id"))
    by_set = stored(named.join(smallest, "comp").select("digest", "comp", "component_id"), "components")
    return sketched.select("doc_id", "mark", "n", "digest").join(by_set, "digest", "left")


def report(docs: DataFrame, width: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    component = F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return groups(docs, width, threshold).select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def deduplicated(docs: DataFrame, width: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The documents without all but one of each group: the smallest id stays, nulls last, of equal rows one."""
    grouped = stored(groups(docs, width, threshold).select("doc_id", "mark", "comp"), "groups")
    key = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "mark")
    keeper = grouped.where("comp is not null").groupBy("comp").agg(F.min(key).alias("k"), F.count("*").alias("rows")).where("rows > 1")
    inside = grouped.join(keeper, "comp").select("doc_id", "mark", (key == F.col("k")).alias("stays"))
    by_row = inside.groupBy("doc_id", "mark").agg(F.max("stays").alias("stays"), F.count("*").alias("rows"))
    changed = stored(by_row.where("not stays or rows > 1"), "changed")
    keyed = docs.select(whole(docs), F.col("doc_id").alias("_id"), F.coalesce(F.md5("text"), F.lit("none")).alias("_mark"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_mark") == F.col("mark"))
    once = keyed.join(small_or_shuffled(changed.where("not stays").select("doc_id", "mark")), same, "left_anti")
    repeated = changed.where("stays and rows > 1").select("doc_id", "mark")
    if repeated.isEmpty():
        return unpacked(once)
    # Equal rows of one id: the few rows concerned are made one, the others stay in place.
    single = once.join(small_or_shuffled(repeated), same, "left_anti").select("_doc")
    several = once.join(small_or_shuffled(repeated), same, "left_semi").dropDuplicates(["_id", "_mark"]).select("_doc")
    return unpacked(reduce(DataFrame.unionByName, [single, several]))
