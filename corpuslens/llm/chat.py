"""Chat formatting of reply trees, in DataFrame operations only.

Messages form trees: each names the message it replies to.  A path from a root to a leaf
is one possible conversation.  Paths are enumerated by self-joins that double the step:
with the ancestor 1, 2, 4, ... replies above every message known, the paths of all leaves
grow from their ends, twice as long in each round, so a tree of depth d takes log2(d)
rounds and all rounds together write each message of each path once.  Branches are ranked by
the mean score of their messages; the best ones are formatted.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.  Inside roles and
texts a backslash is doubled and ``<|`` becomes ``<\\|`` (in roles also a line break
becomes ``\\n``), so control strings occur only where the template puts them, and the
escape is reversible.  ``loss_spans`` says where assistant texts stand in the formatted
string, in code points, the end exclusive.

A conversation is one string in the result, so its messages meet in one row by contract;
everything else is dealt by message.  Rows: null text and role are empty; a null score
counts as 0; a null conversation id is a conversation of its own; equal turns are ordered
by role and text and all kept; a reply to a missing message starts a tree;
paths that run into a circle of replies are left out.  Nodes are unique in a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import stored, sums_before

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    """No control string is left; `unescaped` gives the text back."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return _unescaped(text, lambda piece: piece)


def escaped_role(role: Column) -> Column:
    """Like a text, and without line breaks, since the first one ends the role."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    return _unescaped(role, lambda piece: F.replace(piece, F.lit("\\n"), F.lit("\n")))


def _unescaped(text: Column, more) -> Column:
    # Between the pairs that stand for a backslash, a single one is always the escape's.
    pieces = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda x: more(F.replace(x, F.lit("<\\|"), F.lit("<|")))), "\\")


def linear_tree(turns: DataFrame) -> DataFrame:
    """Messages of conversations that were stored turn by turn: each replies to the one before.

    (conv_id, node, parent, role, text, score); `node` numbers a conversation's rows.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    node = F.row_number().over(order)
    return turns.select(
        "conv_id", node.cast("long").alias("node"), F.when(node > 1, node - 1).cast("long").alias("parent"),
        "role", "text", F.lit(0.0).alias("score"),
    )


def reply_paths(messages: DataFrame) -> DataFrame:
    """(conv_id, leaf, step, node): every message on the path of every leaf, step 0 at the leaf."""
    links = stored(messages.select("conv_id", "node", "parent"), "chat-links")
    known = links.select("conv_id", F.col("node").alias("parent"))
    jump = stored(  # a reply to a missing message starts a tree
        links.where("parent is not null").alias("l").join(known.alias("k"), _same("l", "k", "parent", "parent"))
        .select("l.conv_id", "l.node", F.col("l.parent").alias("up")),
        "chat-jumps",
    )
    answered = links.where("parent is not null").select("conv_id", F.col("parent").alias("node")).distinct()
    paths = stored(
        links.alias("l").join(answered.alias("a"), _same("l", "a", "node", "node"), "left_anti")
        .select("conv_id", F.col("node").alias("leaf"), F.lit(0).cast("long").alias("step"), "node"),
        "chat-paths",
    )
    # A chain of replies longer than its conversation runs in a circle and has no root.
    longest = links.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    reach = 1  # paths hold the last `reach` messages, jumps lead `reach` replies up
    while reach <= longest and not jump.isEmpty():
        more = paths.alias("p").join(jump.alias("j"), _same("p", "j", "node", "node")).select(
            "p.conv_id", "leaf", (F.col("step") + reach).alias("step"), F.col("up").alias("node")
        )
        paths = stored(paths.unionByName(more), "chat-paths")
        jump = stored(
            jump.alias("a").join(jump.alias("b"), _same("a", "b", "up", "node")).select("a.conv_id", "a.node", "b.up"),
            "chat-jumps",
        )
        reach *= 2
    return paths.alias("p").join(jump.alias("j"), _same("p", "j", "leaf", "node"), "left_anti")


def _same(left: str, right: str, a: str, b: str) -> Column:
    return F.col(f"{left}.conv_id").eqNullSafe(F.col(f"{right}.conv_id")) & (F.col(f"{left}.{a}") == F.col(f"{right}.{b}"))


def ranked_paths(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """The paths with their messages and ``rank``: 1 is the branch with the highest mean score.

    Equal scores: the longer path, then the leaf with the smaller number.  `best` keeps so
    many branches of each conversation, None all.
    """
    placed = messages.alias("m").join(reply_paths(messages).alias("p"), _same("m", "p", "node", "node")).select(
        "m.conv_id", "leaf", "step", "role", "text", F.coalesce(F.col("score"), F.lit(0.0)).alias("score")
    )
    scores = placed.groupBy("conv_id", "leaf").agg(F.avg("score").alias("mean"), F.count("*").alias("n"))
    order = Window.partitionBy("conv_id").orderBy(F.desc("mean"), F.desc("n"), "leaf")
    ranks = scores.withColumn("rank", F.row_number().over(order)).select("conv_id", "leaf", "rank")
    if best is not None:
        ranks = ranks.where(F.col("rank") <= best)
    return placed.alias("m").join(ranks.alias("r"), _same("m", "r", "leaf", "leaf")).select("m.*", "rank")


def formatted(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(conv_id, leaf, rank, formatted, loss_spans): one conversation for each chosen path."""
    turn = F.struct((-F.col("step")).alias("at"), escaped_role(F.coalesce("role", F.lit(""))).alias("role"), escaped(F.col("text")).alias("text"), (F.col("role").eqNullSafe(F.lit(ASSISTANT))).alias("loss"))
    rows = ranked_paths(messages, best).groupBy("conv_id", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"))
    tail = F.lit(f"{END}\n")
    pieces = rows.select(
        "conv_id", "leaf", "rank", "turns",
        F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["text"], tail)), "").alias("formatted"),
        sums_before(F.transform("turns", lambda t: F.length(head(t)) + F.length(t["text"]) + F.length(tail))).alias("begins"),
    )
    spans = F.zip_with(
        "turns",
        "begins",
        lambda t, b: F.struct(
            t["loss"].alias("loss"), (b + F.length(head(t))).alias("start"), (b + F.length(head(t)) + F.length(t["text"])).alias("end")
        ),
    )
    masked = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["end"]))
    return pieces.select("conv_id", "leaf", "rank", "formatted", masked.alias("loss_spans"))


def parsed_turns(text: Column) -> Column:
    """The (role, text) turns of a formatted string, unescaped."""
    whole = F.split(text, r"<\|im_end\|>\n", -1)
    turns = F.transform(F.slice(whole, 1, F.size(whole) - 1), lambda t: F.substr(t, F.lit(len(START) + 1)))
    return F.transform(
        turns,
        lambda t: F.struct(
            unescaped_role(F.substring_index(t, "\n", 1)).alias("role"),
            unescaped(F.substr(t, F.length(F.substring_index(t, "\n", 1)) + 2)).alias("text"),
        ),
    )


def read_back(conversations: DataFrame) -> DataFrame:
    """What formatted conversations hold: turns and the text under the loss mask."""
    under = F.transform(
        "loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))
    )
    rows = conversations.select("conv_id", "formatted", parsed_turns(F.col("formatted")).alias("turns"), under.alias("under"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join("under", "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
