"""Canonical trees of traces, and their comparison.

A trace is a table of spans with their parents. Spans get operation keys and tiers, invisible
ones give their children to the nearest visible ancestor, siblings become groups in the order
that times can prove, equal subtrees of a group and equal neighbours fold. Work goes level by
level, deepest first: as many rounds as the tree is deep, each a few joins and aggregates.
Spans that no root reaches (cycles, lost parents) are reported, not dropped silently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.durable import written
from meshwright.functions import spans as S
from meshwright.operators.graph import closure
from meshwright.operators.traces import ORDER_GUARD_NS, kept_by_lis, match_children, post_hoc_groups


def described(spans: DataFrame, allow: tuple[str, ...] = (), pins: dict[str, int] | None = None) -> DataFrame:
    """spans plus op, peer, tier, rule, status and projected attributes, written: the expressions are long."""
    said = S.db_op_table("attrs")
    out = spans.withColumn("__db", F.struct(said[0].alias("op"), said[1].alias("tbl")))  # the statement is read once
    db = (F.col("__db.op"), F.col("__db.tbl"))
    out = out.withColumn("__f", S.features("kind", "attrs", "status", db)).withColumns({
        "op": S.operation("kind", "attrs", "name", db=db), "peer": S.peer_of("kind", "attrs"), "status": S.status_of("status"), "kind": S.effective_kind("kind", "attrs")})
    out = out.withColumn("__c", S.classify(F.col("__f"), "op", pins))
    return written(out.withColumns({"tier": F.col("__c.tier"), "rule": F.col("__c.rule"), "attrs": S.project_attrs("attrs", allow)}).drop("__db", "__f", "__c"), "described")


def levels(spans: DataFrame) -> DataFrame:
    """spans plus depth (0 at a root); spans that no root reaches have none."""
    key = lambda c: F.concat_ws("\u0001", "flow", F.col(c).cast("string"))
    heads = spans.where("parent IS NULL").select("flow", "id")
    edges = spans.where("parent IS NOT NULL").select(key("parent").alias("src"), key("id").alias("dst"))
    below = closure(heads.select(F.lit("").alias("seed"), key("id").alias("node")), edges).select(F.col("node").alias("__key"), "depth")
    depth = F.when(F.col("parent").isNull(), 0).otherwise(F.col("depth"))
    return spans.withColumn("__key", key("id")).join(below, "__key", "left").withColumn("depth", depth).drop("__key")


def unaccounted(spans: DataFrame) -> DataFrame:
    """flow, n_lost, n_twice: spans that no root reaches, and ids that occur more than once."""
    lost = levels(spans).where("depth IS NULL").groupBy("flow").agg(F.count("*").alias("n_lost"))
    twice = spans.groupBy("flow", "id").count().where("count > 1").groupBy("flow").agg(F.count("*").alias("n_twice"))
    return lost.join(twice, "flow", "full_outer").select("flow", F.coalesce("n_lost", F.lit(0)).alias("n_lost"), F.coalesce("n_twice", F.lit(0)).alias("n_twice"))


def contract(spans: DataFrame, most_tier: int = 3) -> DataFrame:
    """Spans of a tier up to ``most_tier`` and roots; a hidden span's children go to its nearest visible ancestor.

    Jumps double, so their rounds are bounded by the number of spans; hidden spans in a circle stay
    lost, as no root reaches them.
    """
    seen = spans.withColumn("visible", (F.col("tier") <= most_tier) | F.col("parent").isNull())
    up = written(seen.select("flow", "id", "parent", "visible"), "up")
    hidden = up.where("NOT visible").select("flow", F.col("id").alias("parent"), F.col("parent").alias("higher"))
    for _ in range(up.count().bit_length() + 1):  # pointer jumping over hidden ancestors
        step = written(up.join(hidden, ["flow", "parent"], "left").select("flow", "id", F.coalesce("higher", "parent").alias("parent"), "visible", F.col("higher").isNotNull().alias("moved")), "up")
        if step.where("moved").isEmpty():
            break
        up = step.drop("moved")
        hidden = up.where("NOT visible").select("flow", F.col("id").alias("parent"), F.col("parent").alias("higher"))
    return seen.where("visible").drop("parent", "visible").join(up.where("visible").select("flow", "id", "parent"), ["flow", "id"])


def canonical(spans: DataFrame, guard: int = ORDER_GUARD_NS) -> DataFrame:
    """flow, id, parent, depth, grp, kind_of_group, multiplicity, sig of the spans kept.

    ``spans``: flow, id, parent, op, kind, peer, tier, status, attrs, start_ns, end_ns. ``sig`` digests a
    whole subtree. Of equal subtrees in a concurrent or unordered group one stays (1..*), and of
    neighbouring equal single groups the first.
    """
    tree = written(levels(spans).where("depth IS NOT NULL"), "tree")
    groups = written(post_hoc_groups(tree.where("parent IS NOT NULL").select("flow", "parent", "id", "start_ns", "end_ns"), guard).select("flow", "parent", "id", F.col("block").alias("grp"), F.col("kind").alias("kind_of_group")), "groups")
    own = F.sha2(F.to_json(F.struct("op", "kind", "peer", "tier", "status", F.array_sort(F.map_entries("attrs")).alias("attrs"))), 256)
    nodes = written(tree.select("flow", "id", "parent", "depth", own.alias("own")).join(groups, ["flow", "parent", "id"], "left"), "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    below = None  # (flow, id, inner): what hangs under a span
    kept = None
    for depth in range(deepest, -1, -1):
        level = nodes.where(F.col("depth") == depth)
        level = level.join(below, ["flow", "id"], "left") if below is not None else level.withColumn("inner", F.lit(None).cast("string"))
        level = written(level.withColumn("sig", F.sha2(F.concat_ws("|", "own", "inner"), 256)), "signed")
        if depth == 0:
            out = level.select("flow", "id", "parent", "depth", "grp", "kind_of_group", F.lit("1").alias("multiplicity"), "sig")
        else:
            same = Window.partitionBy("flow", "parent", "grp", "sig")
            folded = level.withColumns({"n": F.count("*").over(same), "k": F.row_number().over(same.orderBy("id"))}).where("k = 1 OR kind_of_group = 'sequential'")
            alone = folded.where("kind_of_group = 'sequential'")
            order = Window.partitionBy("flow", "parent").orderBy("grp")
            # neighbours: the signature of the group before, groups of several members never equal
            per = folded.groupBy("flow", "parent", "grp").agg(F.when(F.max("kind_of_group") == "sequential", F.max("sig")).alias("g"))
            per = per.withColumn("begins", F.coalesce(F.lag("g").over(order) != F.col("g"), F.lit(True)))
            per = per.withColumn("run", F.sum(F.col("begins").cast("int")).over(order))
            size = Window.partitionBy("flow", "parent", "run")
            per = per.withColumn("times", F.count("*").over(size)).where("begins").select("flow", "parent", "grp", "times")
            out = folded.join(per, ["flow", "parent", "grp"]).select(
                "flow", "id", "parent", "depth", "grp", "kind_of_group", F.when((F.col("n") > 1) | (F.col("times") > 1), "1..*").otherwise("1").alias("multiplicity"), "sig")
            del alone
        out = written(out, "kept")
        kept = out if kept is None else kept.unionByName(out)
        text = F.concat_ws(":", F.lpad(F.col("grp").cast("string"), 9, "0"), "kind_of_group", "sig", "multiplicity")
        below = out.where("parent IS NOT NULL").groupBy("flow", F.col("parent").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(text)), ";").alias("inner"))
    # a span stays only where all its ancestors do
    alive = kept.where("depth = 0")
    result = alive
    for depth in range(1, deepest + 1):
        alive = kept.where(F.col("depth") == depth).join(alive.select("flow", F.col("id").alias("parent")), ["flow", "parent"], "left_semi")
        result = result.unionByName(alive)
    return result


# ---- comparison of canonical traces (rows as the trace reader gives them)

FIELDS = ("op", "kind", "peer", "tier", "status", "error_type", "async")


def _key(*cols: str):
    return F.concat_ws("#", *(F.col(c) if c != "at" else F.array_join(F.transform("at", lambda x: x.cast("string")), ".") for c in cols))


def trace_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """flow, service, path, change, field, old, new, priority of two sets of canonical traces.

    Changes: added, removed, reordered, ordering, cardinality, field, attr. The k-th occurrence of an
    operation under a matched parent belongs to the k-th of the other side.
    """
    def rows(df: DataFrame) -> DataFrame:
        # the parent of [.., group, member] is all but its last two numbers
        up = F.when(F.size("at") >= 2, F.slice("at", 1, F.greatest(F.size("at") - 2, F.lit(0))))
        order = F.when(F.col("concurrent"), "concurrent").when(F.col("unordered"), "unordered").otherwise("sequential")
        return df.withColumns({"up": up, "ordering": order, "many": F.coalesce("multiplicity", F.lit("1")), "path": _key("at")})

    a, b = written(rows(old), "old"), written(rows(new), "new")
    side = lambda df, p: df.select("flow", "service", *(F.col(c).alias(f"{p}_{c}") for c in ("at", "up", "ordering", "many", "path", "attrs", *FIELDS)))
    oa, nb = side(a, "o"), side(b, "n")
    pairs = written(oa.where("size(o_at) = 0").join(nb.where("size(n_at) = 0"), ["flow", "service"]), "pairs")
    all_pairs, changes = pairs, []
    spare = ["flow", "service", "path", "change", "field", "old", "new", "tier"]

    def change(df: DataFrame, kind: str, path: str, tier: str, field: str = "", o=None, n=None) -> DataFrame:
        text = lambda c: F.coalesce(c.cast("string"), F.lit("")) if c is not None else F.lit("")
        return df.select("flow", "service", F.col(path).alias("path"), F.lit(kind).alias("change"), F.lit(field).alias("field"), text(o).alias("old"), text(n).alias("new"), F.col(tier).alias("tier"))

    while not pairs.isEmpty():
        here = pairs.select("flow", "service", F.col("o_at").alias("po"), F.col("n_at").alias("pn"), F.concat_ws("#", "flow", "service", "o_path", "n_path").alias("key"))
        co = oa.join(here, (oa.flow == here.flow) & (oa.service == here.service) & (oa.o_up == here.po)).select("key", oa.flow, oa.service, *[c for c in oa.columns if c.startswith("o_")])
        cn = nb.join(here, (nb.flow == here.flow) & (nb.service == here.service) & (nb.n_up == here.pn)).select("key", nb.flow, nb.service, *[c for c in nb.columns if c.startswith("n_")])
        co, cn = written(co, "co"), written(cn, "cn")
        m = written(match_children(co.select("key", F.col("o_op").alias("op"), F.col("o_at").alias("pos")), cn.select("key", F.col("n_op").alias("op"), F.col("n_at").alias("pos"))), "matched")
        changes.append(change(co.join(m.where("change = 'removed'").select("key", F.col("old_pos").alias("o_at")), ["key", "o_at"], "left_semi"), "removed", "o_path", "o_tier", "op", F.col("o_op")))
        changes.append(change(cn.join(m.where("change = 'added'").select("key", F.col("new_pos").alias("n_at")), ["key", "n_at"], "left_semi"), "added", "n_path", "n_tier", "op", None, F.col("n_op")))
        both = m.where("change = 'matched'").select("key", F.col("old_pos").alias("o_at"), F.col("new_pos").alias("n_at"))
        pairs = written(co.join(both, ["key", "o_at"]).join(cn.drop("flow", "service"), ["key", "n_at"]), "pairs")
        moved = pairs.where("o_ordering = 'sequential' AND n_ordering = 'sequential'").groupBy("key").applyInPandas(_moved, "flow string, service string, n_path string, o_tier int")
        changes.append(change(moved, "reordered", "n_path", "o_tier"))
        pairs = pairs.drop("key")
        all_pairs = all_pairs.unionByName(pairs.select(*all_pairs.columns))
    changes.append(change(all_pairs.where("o_ordering <> n_ordering"), "ordering", "n_path", "n_tier", "", F.col("o_ordering"), F.col("n_ordering")))
    changes.append(change(all_pairs.where("o_many <> n_many"), "cardinality", "n_path", "n_tier", "", F.col("o_many"), F.col("n_many")))
    for f in FIELDS:
        changes.append(change(all_pairs.where(~F.col(f"o_{f}").eqNullSafe(F.col(f"n_{f}"))), "field", "n_path", "n_tier", f, F.col(f"o_{f}"), F.col(f"n_{f}")))
    keys = all_pairs.select("*", F.explode(F.array_union(F.coalesce(F.map_keys("o_attrs"), F.array()), F.coalesce(F.map_keys("n_attrs"), F.array()))).alias("field"))
    vo, vn = F.try_element_at("o_attrs", F.col("field")), F.try_element_at("n_attrs", F.col("field"))
    changes.append(keys.where(~vo.eqNullSafe(vn)).select("flow", "service", F.col("n_path").alias("path"), F.lit("attr").alias("change"), "field", F.coalesce(vo, F.lit("")).alias("old"), F.coalesce(vn, F.lit("")).alias("new"), F.col("n_tier").alias("tier")))
    out = changes[0].select(*spare)
    for c in changes[1:]:
        out = out.unionByName(c.select(*spare))
    contract_op = F.greatest("old", "new").rlike("^(HTTP|RPC|PUBLISH|CONSUME) ")
    priority = F.when(F.col("change").isin("added", "removed") & contract_op | F.col("field").isin("op", "status"), "contract").when(F.col("tier") == 1, "tier1").otherwise("lower")
    return out.withColumn("priority", priority).drop("tier")


def _moved(pdf):
    """Matched sequential children of one pair that lie off the longest increasing run."""
    pdf = pdf.sort_values("o_at", key=lambda s: s.map(tuple))
    rank = {tuple(x): k for k, x in enumerate(sorted(map(tuple, pdf["n_at"])))}
    kept = kept_by_lis([rank[tuple(x)] for x in pdf["n_at"]])
    return pdf.loc[[not k for k in kept], ["flow", "service", "n_path", "o_tier"]]


def effects_of(trace: DataFrame) -> DataFrame:
    """flow, service, effects: the sorted distinct boundary operations of each trace."""
    bus = F.col("op").rlike("^PUBLISH ")
    db = F.col("op").startswith("DB ")
    outbound = F.col("kind") == "client"
    return trace.where(bus | db | outbound).groupBy("flow", "service").agg(F.array_sort(F.collect_set("op")).alias("effects"))


def occurrences(trace: DataFrame, op: str) -> DataFrame:
    """flow, service, n, looped: how often an operation occurs, and whether in a fold."""
    return trace.where(F.col("op") == op).groupBy("flow", "service").agg(F.count("*").alias("n"), F.max(F.coalesce("multiplicity", F.lit("1")) != "1").alias("looped"))


def expect_once(trace: DataFrame, op: str) -> DataFrame:
    """flow, service, ok of every trace: the operation occurs exactly once and not in a fold."""
    every = trace.select("flow", "service").distinct()
    return every.join(occurrences(trace, op), ["flow", "service"], "left").select("flow", "service", F.coalesce((F.col("n") == 1) & ~F.col("looped"), F.lit(False)).alias("ok"))


def agreed(values: DataFrame, column: str):
    """The one value that all rows have, else none; empty values agree with nothing."""
    rows = values.select(column).distinct().limit(2).collect()
    return rows[0][0] if len(rows) == 1 and rows[0][0] else None


def gate_goldens(goldens: DataFrame, observed: DataFrame) -> DataFrame:
    """flow, service, verdict, added, missing of (flow, service, effects) tables; observed also has synthesized.

    Only new effects fail. A golden without a capture, or whose capture had an invented root, is skipped;
    flows without a golden are ungated.
    """
    g, o = goldens.select("flow", "service", F.col("effects").alias("g")), observed.select("flow", "service", F.col("effects").alias("o"), "synthesized")
    both = g.join(o, ["flow", "service"], "full_outer")
    none = F.array().cast("array<string>")
    added, missing = F.array_except(F.coalesce("o", none), F.coalesce("g", none)), F.array_except(F.coalesce("g", none), F.coalesce("o", none))
    verdict = F.when(F.col("g").isNull(), "ungated").when(F.col("o").isNull() | F.col("synthesized"), "skipped").when(F.size(added) > 0, "fail").otherwise("pass")
    return both.select("flow", "service", verdict.alias("verdict"), F.array_sort(added).alias("added"), F.array_sort(missing).alias("missing"))
