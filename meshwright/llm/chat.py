"""Chat formatting of reply trees, by DataFrame functions only.

``paths`` enumerates root-to-leaf paths by iterative self-joins. A table of jumps holds, for
each message, its ancestor 2^k steps up; joined with itself it gives the jumps of 2^(k+1),
and each round doubles the known part of every path, so a chain of n messages takes log2(n)
rounds. Branches are ranked by the sum of their messages' scores and each chosen one becomes
one conversation.

Template: system ``<<SYS>>..<</SYS>>``, user ``[INST]..[/INST]``, assistant ``<s>..</s>``, any
other role ``<<TURN role>>..<</TURN>>``. Inside texts and roles the character U+241B escapes
itself and the first character of every control string, so no control string is left in a
text and the text comes back exactly. The loss mask covers assistant texts only.

Defined cases: a null text or role is empty; a message whose parent is absent is a root;
messages on a cycle have no root and lie on no path; repeated (conv_id, turn) rows are
messages of their own, ordered by role and text; an empty table gives no rows; a null
conv_id is a conversation of its own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.llm.common import materialize

ESC = "␛"
#: Where a control string starts, and how the first character is written.
ANGLE = r"<(?=s>|/s>|<SYS>>|</SYS>>|<TURN |</TURN>>)"
BRACKET = r"\[(?=INST\]|/INST\])"
FRAMES = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER_CLOSE = "<</TURN>>"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit(ESC), F.lit(ESC + "0"))
    return F.regexp_replace(F.regexp_replace(text, ANGLE, ESC + "1"), BRACKET, ESC + "2")


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit(ESC + "1"), F.lit("<")), F.lit(ESC + "2"), F.lit("["))
    return F.replace(text, F.lit(ESC + "0"), F.lit(ESC))


def role_escape(role: Column) -> Column:
    """As in texts, and a role's own angle brackets end nothing."""
    return F.replace(F.replace(escape(role), F.lit(">"), F.lit(ESC + "3")), F.lit("<"), F.lit(ESC + "1"))


def role_unescape(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(ESC + "3"), F.lit(">")))


def opening(role: Column) -> Column:
    out = F.concat(F.lit("<<TURN "), role_escape(role), F.lit(">>"))
    for name, (start, _) in FRAMES.items():
        out = F.when(role == name, F.lit(start)).otherwise(out)
    return out


def closing(role: Column) -> Column:
    out = F.lit(OTHER_CLOSE)
    for name, (_, stop) in FRAMES.items():
        out = F.when(role == name, F.lit(stop)).otherwise(out)
    return out


def as_tree(rows: DataFrame) -> DataFrame:
    """conv_id, node, parent, score, role, text of linear conversations: each turn answers the last."""
    seen = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select(
        "conv_id", F.row_number().over(seen).cast("long").alias("node"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).select(
        "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        F.lit(0.0).alias("score"), "role", "text",
    )


def paths(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """conv_id, leaf, branch_rank, depth, node: the messages of the best branches, root first.

    ``nodes`` has conv_id, node, parent, score. ``best`` None keeps every branch. Ranks go by
    the path's total score, highest first, then by the smaller leaf.
    """
    conv = F.xxhash64("conv_id", F.col("conv_id").isNull())
    ids = materialize(
        nodes.select(conv.alias("c"), "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "tree"
    )
    there = ids.select("c", F.col("node").alias("parent"))
    up = ids.where("parent IS NOT NULL").join(there, ["c", "parent"], "left_semi").select("c", "node", F.col("parent").alias("anc"))
    # jumps: node -> ancestor and the score of the nodes passed, both ends but the last included
    jumps = materialize(up, "jumps")
    leaves = ids.join(jumps.select("c", F.col("anc").alias("node")), ["c", "node"], "left_anti")
    walked = leaves.select("c", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above"))
    limit = max(1, ids.count()).bit_length() + 1
    for k in range(limit):
        if jumps.isEmpty():
            break
        step = jumps.select("c", "node", "anc")
        more = walked.join(step, ["c", "node"]).select("c", "leaf", F.col("anc").alias("node"), (F.col("above") + (1 << k)).alias("above"))
        walked = materialize(walked.unionByName(more), "walked")
        half = jumps.select("c", F.col("node").alias("anc"), F.col("anc").alias("far"))
        jumps = materialize(jumps.join(half, ["c", "anc"]).select("c", "node", F.col("far").alias("anc")), "jumps")
    scored = walked.join(ids.select("c", "node", "score", F.col("parent")), ["c", "node"])
    whole = scored.groupBy("c", "leaf").agg(F.max("above").alias("length"), F.sum("score").alias("total"))
    if best == 1:
        chosen = whole.groupBy("c").agg(F.max_by(F.struct("leaf", "length", "total"), F.struct("total", -F.col("leaf"))).alias("x")).select(
            "c", "x.leaf", "x.length", "x.total", F.lit(1).alias("branch_rank"))
    else:
        order = [F.desc("total"), F.asc("leaf")]
        pool = whole
        if best is not None:  # the best of a few lots first, so one vast tree is not ranked in one task
            lot = Window.partitionBy("c", F.pmod(F.xxhash64("leaf"), F.lit(64))).orderBy(*order)
            pool = whole.withColumn("lot_rank", F.row_number().over(lot)).where(F.col("lot_rank") <= best).drop("lot_rank")
        pool = pool.withColumn("branch_rank", F.row_number().over(Window.partitionBy("c").orderBy(*order)))
        chosen = pool if best is None else pool.where(F.col("branch_rank") <= best)
    return walked.join(chosen, ["c", "leaf"]).select(
        "c", "leaf", "branch_rank", (F.col("length") - F.col("above")).alias("depth"), "node")


def format_trees(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """One row per chosen branch: conv_id, leaf, branch_rank, formatted, loss_spans.

    ``loss_spans`` are [start, stop) code-point offsets of assistant texts in ``formatted``.
    """
    nodes = materialize(nodes.select("conv_id", "node", "parent", "score", "role", "text"), "nodes")
    texts = nodes.select(
        F.xxhash64("conv_id", F.col("conv_id").isNull()).alias("c"), "conv_id", "node",
        opening(F.coalesce("role", F.lit(""))).alias("a"), escape(F.coalesce("text", F.lit(""))).alias("t"),
        closing(F.coalesce("role", F.lit(""))).alias("b"), (F.coalesce("role", F.lit("")) == "assistant").alias("loss"),
    )
    turns = paths(nodes, best).join(texts, ["c", "node"])
    rows = turns.groupBy("conv_id", "leaf", "branch_rank").agg(
        F.array_sort(F.collect_list(F.struct("depth", "a", "t", "b", "loss"))).alias("turns"))
    size = lambda x: F.length(x["a"]) + F.length(x["t"]) + F.length(x["b"])
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + size(x)).alias("at"),
            F.when(
                x["loss"],
                F.concat(acc["out"], F.array(F.struct(
                    (acc["at"] + F.length(x["a"])).alias("start"), (acc["at"] + F.length(x["a"]) + F.length(x["t"])).alias("stop")))),
            ).otherwise(acc["out"]).alias("out"),
        ),
    )["out"]
    return rows.select(
        "conv_id", "leaf", "branch_rank",
        F.array_join(F.transform("turns", lambda x: F.concat(x["a"], x["t"], x["b"])), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


SPLIT = r"(?<=</s>|\[/INST\]|<</SYS>>|<</TURN>>)"


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""

    def turn(piece: Column) -> Column:
        other_role = role_unescape(F.regexp_extract(piece, r"^<<TURN ([^>]*)>>", 1))
        role, start, stop = other_role, F.length(F.regexp_extract(piece, r"^<<TURN [^>]*>>", 0)), F.lit(len(OTHER_CLOSE))
        for name, (a, b) in FRAMES.items():
            here = F.startswith(piece, F.lit(a))
            role = F.when(here, F.lit(name)).otherwise(role)
            start = F.when(here, F.lit(len(a))).otherwise(start)
            stop = F.when(here, F.lit(len(b))).otherwise(stop)
        text = F.substring(piece, start + 1, F.length(piece) - start - stop)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(F.filter(F.split(formatted, SPLIT), lambda x: x != ""), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["stop"] - s["start"]))), "")
