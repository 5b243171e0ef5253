"""Operators over spans: stitching, root assembly, happens-before groups, loops, gates, diffs."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.durable import written

#: Fixed value: the least gap that lets an order be claimed.
ORDER_GUARD_NS = 100_000_000


def stitch(spans: DataFrame) -> DataFrame:
    """id, root: the head of each span's parent chain, by pointer jumping (log rounds).

    Spans whose chain runs in a circle have no head: their root is the place where the jumps stopped.
    """
    parent = spans.select("id", "parent")
    heads = written(parent.select("id", F.coalesce("parent", "id").alias("head")), "heads")
    for _ in range(heads.count().bit_length() + 1):
        up = heads.select(F.col("id").alias("head"), F.col("head").alias("higher"))
        new = written(heads.join(up, "head", "left").select("id", F.coalesce("higher", "head").alias("root"), "head"), "heads")
        if new.where("root <> head").isEmpty():
            break
        heads = new.select("id", F.col("root").alias("head"))
    return new.select("id", "root")


def assemble_roots(spans: DataFrame) -> DataFrame:
    """flow, n_spans, n_heads, root, synthesized: one parentless span is the root, several get an invented one."""
    heads = spans.groupBy("flow").agg(
        F.count("*").alias("n_spans"), F.count_if(F.col("parent").isNull()).alias("n_heads"), F.min(F.when(F.col("parent").isNull(), F.col("id"))).alias("head"))
    one = F.col("n_heads") == 1
    return heads.select("flow", "n_spans", "n_heads", F.when(one, F.col("head")).alias("root"), (~one).alias("synthesized"))


def post_hoc_groups(children: DataFrame, guard: int = ORDER_GUARD_NS) -> DataFrame:
    """children plus component, block, kind: overlap components, and blocks parted only by gaps over the guard.

    children: flow, parent, id, start_ns, end_ns. One component of one span is sequential, of
    several concurrent; a block of several components is unordered.
    """
    by = Window.partitionBy("flow", "parent").orderBy("start_ns", "id")
    latest = F.max("end_ns").over(by.rowsBetween(Window.unboundedPreceding, -1))
    first = latest.isNull()
    c = children.withColumn("latest", latest)
    c = c.withColumn("component", F.sum((first | (F.col("start_ns") >= F.col("latest"))).cast("int")).over(by))
    c = c.withColumn("block", F.sum((first | (F.col("start_ns") - F.col("latest") > guard)).cast("int")).over(by)).drop("latest")
    block = Window.partitionBy("flow", "parent", "block")
    n, k = F.count("*").over(block), F.size(F.collect_set("component").over(block))
    return c.withColumn("kind", F.when(k > 1, "unordered").when(n > 1, "concurrent").otherwise("sequential"))


def collapse_loops(rows: DataFrame, group: list[str], order: list[str], sig: str) -> DataFrame:
    """group, run, sig, n, multiplicity of runs of equal adjacent signatures."""
    by = Window.partitionBy(*group).orderBy(*order)
    begins = F.lag(sig).over(by).isNull() | (F.lag(sig).over(by) != F.col(sig))
    runs = rows.withColumn("run", F.sum(begins.cast("int")).over(by))
    return runs.groupBy(*group, "run", sig).agg(F.count("*").alias("n")).withColumn("multiplicity", F.when(F.col("n") > 1, "1..*").otherwise("1"))


def effect_gate(golden: DataFrame, observed: DataFrame) -> DataFrame:
    """flow, added, missing, verdict: only effects not in the golden set fail."""
    def sets(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("flow").agg(F.array_sort(F.collect_set("op")).alias(name))
    both = sets(golden, "g").join(sets(observed, "o"), "flow", "full_outer")
    added, missing = F.array_except("o", "g"), F.array_except("g", "o")
    verdict = F.when(F.col("o").isNull(), "skipped").when(F.col("g").isNull(), "ungated").when(F.size(added) > 0, "fail").otherwise("pass")
    return both.select("flow", F.array_join(added, ",").alias("added"), F.array_join(missing, ",").alias("missing"), verdict.alias("verdict"))


def match_children(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, op, k, change: the k-th occurrence of an op on each side belongs together."""
    def nth(df: DataFrame) -> DataFrame:
        return df.withColumn("k", F.row_number().over(Window.partitionBy("key", "op").orderBy("pos")))
    a, b = nth(old).withColumnRenamed("pos", "old_pos"), nth(new).withColumnRenamed("pos", "new_pos")
    both = a.join(b, ["key", "op", "k"], "full_outer")
    return both.withColumn("change", F.when(F.col("old_pos").isNull(), "added").when(F.col("new_pos").isNull(), "removed").otherwise("matched"))


def kept_by_lis(seq: list[int]) -> list[bool]:
    """Which places lie on one longest increasing subsequence."""
    tails, at, before = [], [], [-1] * len(seq)
    for i, x in enumerate(seq):
        k = bisect.bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
            at.append(i)
        else:
            tails[k], at[k] = x, i
        before[i] = at[k - 1] if k else -1
    kept = [False] * len(seq)
    i = at[-1] if at else -1
    while i >= 0:
        kept[i], i = True, before[i]
    return kept


def reordered(matched: DataFrame) -> DataFrame:
    """key, op, k, reordered of matched children: those off the longest increasing subsequence moved."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("old_pos")
        pdf["reordered"] = [not x for x in kept_by_lis(pdf["new_pos"].tolist())]
        return pdf[["key", "op", "k", "reordered"]]

    return matched.where("change = 'matched'").select("key", "op", "k", "old_pos", "new_pos").groupBy("key").applyInPandas(
        run, "key string, op string, k int, reordered boolean")
