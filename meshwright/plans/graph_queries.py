"""Registered queries: closures, rules, deltas, triage, rollup and claims over the commerce graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions import labels as L
from meshwright.operators import deltas, packed, rules
from meshwright.operators.graph import GraphIndex, closure, shortest_paths
from meshwright.plans import bindings as B
from meshwright.plans.registry import register

ALL_ROOTS = "SELECT fqn AS seed FROM roots"
W = "WITH RECURSIVE "
G, GC = B.graph_sql(), B.graph_sql(cyclic=True)
BOTH = B.graph_sql("base", tag="_b") + "," + B.graph_sql("branch", tag="_n")
WRITE = "regexp_matches(dst, '^boundary:db (INSERT|UPDATE|DELETE) ')"
BLIND = "spots.kind NOT IN ('ExternalBoundaryCall','Truncated')"
PKG = "regexp_extract(fqn, '^((?:.*/)?[^./]*)', 1)"


def _seeds(ix: GraphIndex, like: str) -> DataFrame:
    return ix.nodes.where(F.col("fqn").like(like)).select(F.col("fqn").alias("seed"))


@register("roots", W + G + " SELECT fqn FROM roots")
def roots(spark: SparkSession, sf: str) -> DataFrame:
    return B.index(spark, sf).roots()


@register("route_writes", W + G + "," + B.cone_sql(ALL_ROOTS) + f""",
lab AS (SELECT DISTINCT seed, dst FROM cone JOIN eff ON eff.src = cone.node),
bl AS (SELECT DISTINCT seed FROM cone JOIN spots ON spots.site = cone.node WHERE {BLIND})
SELECT r.fqn AS route, count(lab.dst) FILTER (WHERE {WRITE}) AS n_writes, 0::BIGINT AS n_unclassified, r.fqn IN (SELECT seed FROM bl) AS blind
FROM roots r LEFT JOIN lab ON lab.seed = r.fqn GROUP BY r.fqn""")
def route_writes(spark, sf):
    return rules.route_writes(B.index(spark, sf))


@register("io_budget", W + G + "," + B.cone_sql(ALL_ROOTS) + f"""
SELECT seed AS route, count(DISTINCT dst) AS n_writes FROM cone JOIN eff ON eff.src = cone.node WHERE {WRITE} GROUP BY seed HAVING count(DISTINCT dst) > 10""")
def io_budget(spark, sf):
    return rules.route_writes(B.index(spark, sf)).where("n_writes > 10").select("route", "n_writes")


@register("reach_forward", W + G + "," + B.cone_sql("SELECT fqn AS seed FROM nodes WHERE fqn LIKE 'shop/nation.%'") + " SELECT seed, count(*) - 1 AS n_reached FROM cone GROUP BY seed")
def reach_forward(spark, sf):
    ix = B.index(spark, sf)
    seeds = ix.nodes.where("fqn LIKE 'shop/nation.%'").select(F.col("fqn").alias("seed"))
    found = closure(seeds, ix.internal).groupBy("seed").count()
    return seeds.join(found, "seed", "left").select("seed", F.coalesce("count", F.lit(0)).alias("n_reached"))


@register("reach_backward", W + G + ", rev AS (SELECT dst AS src, src AS dst FROM inner_e)," + B.cone_sql("SELECT fqn AS seed FROM nodes WHERE fqn LIKE 'shop/supplier.%'", edges="rev") + " SELECT seed, count(*) - 1 AS n_reaching FROM cone GROUP BY seed")
def reach_backward(spark, sf):
    ix = B.index(spark, sf)
    seeds = ix.nodes.where("fqn LIKE 'shop/supplier.%'").select(F.col("fqn").alias("seed"))
    if ix.packed is not None:
        return packed.counts(seeds, ix.packed.reversed(spark)).select("seed", F.col("n").alias("n_reaching"))
    found = closure(seeds, ix.reversed()).groupBy("seed").count()
    return seeds.join(found, "seed", "left").select("seed", F.coalesce("count", F.lit(0)).alias("n_reaching"))


@register("reach_cyclic", W + GC + """, walk AS (SELECT e.src AS seed, e.dst AS node FROM inner_e e WHERE e.src LIKE 'shop/region.%' OR e.src IN ('shop/nation.N1','shop/nation.N7')
 UNION SELECT w.seed, e.dst FROM walk w JOIN inner_e e ON e.src = w.node)
SELECT seed, count(*) AS n_reached, max(CASE WHEN seed = node THEN 1 ELSE 0 END) AS on_cycle FROM walk GROUP BY seed""")
def reach_cyclic(spark, sf):
    return _cyclic(B.index(spark, sf, cyclic=True), "fqn LIKE 'shop/region.%' OR fqn IN ('shop/nation.N1','shop/nation.N7')")


@register("reach_cyclic_all")
def reach_cyclic_all(spark, sf):
    """From all regions and nations, without an oracle."""
    return _cyclic(B.index(spark, sf, cyclic=True), "fqn LIKE 'shop/region.%' OR fqn LIKE 'shop/nation.%'")


def _cyclic(ix: GraphIndex, which: str) -> DataFrame:
    seeds = ix.nodes.where(which).select(F.col("fqn").alias("seed"))
    if ix.packed is not None:
        return packed.counts(seeds, ix.packed).where("n > 0").select("seed", F.col("n").alias("n_reached"), F.col("on_cycle").cast("int").alias("on_cycle"))
    return closure(seeds, ix.internal).groupBy("seed").agg(F.count("*").alias("n_reached"), F.max((F.col("seed") == F.col("node")).cast("int")).alias("on_cycle"))


@register("entrypoint_cover", W + G + "," + B.cone_sql(ALL_ROOTS) + " SELECT node AS fqn, count(*) AS n_roots, min(seed) AS first_root FROM cone WHERE node LIKE 'shop/supplier.%' GROUP BY node")
def entrypoint_cover(spark, sf):
    ix = B.index(spark, sf)
    cone = ix.cone(ix.roots().withColumnRenamed("fqn", "seed"))
    return cone.where("node LIKE 'shop/supplier.%'").groupBy(F.col("node").alias("fqn")).agg(F.count("*").alias("n_roots"), F.min("seed").alias("first_root"))


@register("effect_reachers", W + G + """, rev AS (SELECT dst AS src, src AS dst FROM inner_e), up AS (SELECT DISTINCT src AS node FROM eff UNION SELECT r.dst FROM up JOIN rev r ON r.src = up.node)
SELECT split_part(split_part(node, '.', 1), '/', 2) AS kind, count(*) AS n FROM up GROUP BY 1""")
def effect_reachers(spark, sf):
    ix = B.index(spark, sf)
    emit = ix.effects.select(F.col("src").alias("node")).distinct()
    known = emit.unionByName(_set_closure(emit, ix.reversed())).distinct()
    return known.groupBy(F.substring_index(F.substring_index("node", ".", 1), "/", -1).alias("kind")).agg(F.count("*").alias("n"))


def _set_closure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that a set reaches: the closure with the set as one seed."""
    tagged = edges.select("src", "dst").unionByName(nodes.select(F.lit("*").alias("src"), F.col("node").alias("dst")))
    spark = nodes.sparkSession
    return closure(spark.range(1).select(F.lit("*").alias("seed")), tagged).select("node")


RULES = """rules AS (SELECT * FROM (VALUES ('r1','shop/customer','shop/supplier',false),('r2','shop/supplier','shop/region',false),('r3','shop/part','shop/region',true),('r4','shop/none','shop/part',false),('r5','entrypoint:*','nothing/here',false),('r6','shop/customer','db UPDATE',false)) v(rule, f, t, proof))"""


def _rules(spark):
    rows = [("r1", "shop/customer", "shop/supplier", False), ("r2", "shop/supplier", "shop/region", False), ("r3", "shop/part", "shop/region", True), ("r4", "shop/none", "shop/part", False), ("r5", "entrypoint:*", "nothing/here", False), ("r6", "shop/customer", "db UPDATE", False)]
    return spark.createDataFrame([(a, [b], [c], d) for a, b, c, d in rows], "rule string, from array<string>, to array<string>, require_proof boolean")


BIND = "({x} = {p} OR (starts_with({x}, {p}) AND NOT regexp_matches(substr({x}, length({p}) + 1, 1), '[A-Za-z0-9_]')))"


@register("must_not_reach", W + G + "," + RULES + """, src AS (SELECT rule, fqn AS seed FROM rules, nodes WHERE """ + BIND.format(x="fqn", p="f") + """ UNION SELECT rule, fqn FROM rules, roots WHERE f = 'entrypoint:*'),
names AS (SELECT fqn AS nm FROM nodes UNION SELECT substr(dst, 10) FROM eff), tgt AS (SELECT DISTINCT rule, nm FROM rules, names WHERE nm = t OR (starts_with(nm, t) AND NOT regexp_matches(substr(nm, length(t) + 1, 1), '[A-Za-z0-9_]'))),
""" + B.cone_sql("SELECT DISTINCT seed FROM src") + f""", hits AS (SELECT seed, node AS nm FROM cone WHERE seed <> node UNION SELECT seed, substr(dst, 10) FROM cone JOIN (SELECT DISTINCT src, dst FROM eff) e ON e.src = node),
wit AS (SELECT s.rule, min([s.seed, h.nm]) AS w FROM src s JOIN hits h USING (seed) JOIN tgt g ON g.rule = s.rule AND g.nm = h.nm GROUP BY s.rule),
bl AS (SELECT DISTINCT rule FROM src JOIN cone USING (seed) JOIN spots ON site = node WHERE {BLIND}),
v AS (SELECT r.rule, proof, CASE WHEN r.rule NOT IN (SELECT rule FROM src) THEN 'INERT' WHEN r.rule NOT IN (SELECT rule FROM tgt) THEN 'UNBINDABLE' WHEN w IS NOT NULL THEN 'REACHABLE' WHEN r.rule IN (SELECT rule FROM bl) THEN 'BLIND' ELSE 'PROVEN' END AS verdict, w FROM rules r LEFT JOIN wit USING (rule))
SELECT rule, verdict, CASE WHEN verdict = 'PROVEN' THEN NULL WHEN verdict = 'REACHABLE' OR proof THEN 'violation' ELSE 'caution' END AS severity, w[1] AS "from", w[2] AS "to" FROM v""")
def must_not_reach(spark, sf):
    return rules.must_not_reach(B.index(spark, sf), _rules(spark))


@register("must_pass_through", W + G + ", way AS (SELECT fqn FROM nodes WHERE fqn LIKE '%0' AND fqn LIKE 'shop/order.%'), ge AS (SELECT * FROM inner_e WHERE dst NOT IN (SELECT fqn FROM way)),"
          + B.cone_sql("SELECT fqn AS seed FROM nodes WHERE fqn LIKE 'shop/customer.C1%'", edges="ge") + " SELECT seed, count(*) AS n_bypassed FROM cone WHERE node LIKE 'shop/part.%' GROUP BY seed")
def must_pass_through(spark, sf):
    return _bypassed(B.index(spark, sf), "shop/customer.C1%")


@register("must_pass_through_all")
def must_pass_through_all(spark, sf):
    """Of all customers; too many seeds for the recursive SQL, so without an oracle."""
    return _bypassed(B.index(spark, sf), "shop/customer.%")


def _bypassed(ix: GraphIndex, like: str) -> DataFrame:
    src = _seeds(ix, like)
    way = ix.nodes.where("fqn LIKE '%0' AND fqn LIKE 'shop/order.%'").select("fqn")
    goal = ix.nodes.where("fqn LIKE 'shop/part.%'").select("fqn")
    if ix.packed is not None:
        at = lambda df, **kw: packed.marks(ix.names, df.select(F.col("fqn").alias("node")), **kw)
        free = src.join(way.withColumnRenamed("fqn", "seed"), "seed", "left_anti")
        found = packed.counts(free, ix.packed, closed=packed.saved(src.sparkSession, at(way)), weights={"n_bypassed": packed.saved(src.sparkSession, at(goal).astype("<i4"))})
        return found.where("n_bypassed > 0").select("seed", "n_bypassed")
    return rules.must_pass_through(ix, src, way, goal).groupBy("seed").agg(F.count("*").alias("n_bypassed"))


@register("no_concurrent_reach", W + G + """ SELECT DISTINCT src AS "from", substr(dst, 10) AS "to" FROM eff WHERE concurrent AND starts_with(dst, 'boundary:db DELETE ')""")
def no_concurrent_reach(spark, sf):
    return rules.concurrent_hits(B.index(spark, sf), "db DELETE")


@register("layering", W + G + """ SELECT DISTINCT src AS "from", dst AS "to" FROM inner_e WHERE (src LIKE 'shop/order.%' AND dst LIKE 'shop/part.%')""")
def layering(spark, sf):
    layers = spark.createDataFrame([("geo", 0, "shop/region"), ("geo2", 1, "shop/nation"), ("people", 2, "shop/customer"), ("sales", 3, "shop/order"), ("goods", 5, "shop/part"), ("makers", 6, "shop/supplier")], "layer string, rank int, prefix string")
    return rules.layering(B.index(spark, sf), layers)


@register("shortest_paths", W + G + """, p AS (SELECT fqn AS seed, fqn AS node, [fqn] AS path FROM nodes WHERE fqn LIKE 'shop/customer.C1%'
 UNION ALL SELECT p.seed, e.dst, list_append(p.path, e.dst) FROM p JOIN inner_e e ON e.src = p.node),
best AS (SELECT seed, node, path, row_number() OVER (PARTITION BY seed, node ORDER BY len(path), path) AS r FROM p)
SELECT seed, node, array_to_string(path, ' > ') AS path FROM best WHERE r = 1""")
def paths(spark, sf):
    return _paths(B.index(spark, sf), "shop/customer.C1%")


@register("shortest_paths_all")
def paths_all(spark, sf):
    """From all customers, without an oracle."""
    return _paths(B.index(spark, sf), "shop/customer.%")


def _paths(ix: GraphIndex, like: str) -> DataFrame:
    if ix.packed is not None:
        return packed.path_texts(_seeds(ix, like), ix.packed, " > ")
    got = shortest_paths(_seeds(ix, like), ix.internal)
    return got.select("seed", "node", F.array_join("path", " > ").alias("path"))


@register("impact_card", W + G + ", rev AS (SELECT dst AS src, src AS dst FROM inner_e)," + B.cone_sql("SELECT fqn AS seed FROM nodes WHERE fqn LIKE 'shop/order.O1_'") + "," + B.cone_sql("SELECT fqn AS seed FROM nodes WHERE fqn LIKE 'shop/order.O1_'", "back", "rev") + """
SELECT n.fqn AS suspect, (SELECT count(*) FROM back b JOIN roots r ON r.fqn = b.node WHERE b.seed = n.fqn) AS n_entrypoints, (SELECT count(*) - 1 FROM back b WHERE b.seed = n.fqn) AS n_callers,
 (SELECT count(DISTINCT e.dst) FROM cone c JOIN eff e ON e.src = c.node WHERE c.seed = n.fqn) AS n_effects, (SELECT count(*) FROM cone c JOIN spots s ON s.site = c.node WHERE c.seed = n.fqn) AS n_spots,
 (SELECT count(*) FROM cone c JOIN spots s ON s.site = c.node WHERE c.seed = n.fqn AND s.kind = 'HighFanOut') > 0 AS over_approximate
FROM nodes n WHERE fqn LIKE 'shop/order.O1_'""")
def impact_card(spark, sf):
    return _cards(B.index(spark, sf), "shop/order.O1_")


@register("impact_card_all")
def impact_card_all(spark, sf):
    """Of all orders, without an oracle."""
    return _cards(B.index(spark, sf), "shop/order.%")


def _cards(ix: GraphIndex, like: str) -> DataFrame:
    seeds = _seeds(ix, like)
    if ix.packed is not None and (got := _packed_cards(ix, seeds)) is not None:
        return got
    cone, back = ix.cone(seeds), ix.cone(seeds, ix.reversed())
    n = lambda df, agg, name: df.groupBy("seed").agg(agg.alias(name))
    at = cone.join(ix.spots.withColumnRenamed("site", "node"), "node")
    parts = [
        n(back.join(ix.roots().withColumnRenamed("fqn", "node"), "node", "left_semi"), F.count("*"), "n_entrypoints"), n(back, F.count("*") - 1, "n_callers"),
        n(cone.join(ix.effects.select(F.col("src").alias("node"), "dst"), "node"), F.countDistinct("dst"), "n_effects"), n(at, F.count("*"), "n_spots"),
        n(at, F.max((F.col("kind") == "HighFanOut").cast("int")), "fan")]
    out = seeds
    for p in parts:
        out = out.join(p, "seed", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("seed").alias("suspect"), *[zero(c) for c in ("n_entrypoints", "n_callers", "n_effects", "n_spots")], (F.coalesce("fan", F.lit(0)) > 0).alias("over_approximate"))


def _packed_cards(ix: GraphIndex, seeds: DataFrame) -> DataFrame | None:
    spark = seeds.sparkSession
    names = packed.names_of(ix.effects.select(F.col("dst").alias("fqn")))
    labels = names and packed.pack(ix.effects, ix.names, names)
    if labels is None:
        return None
    at = lambda df: packed.saved(spark, packed.marks(ix.names, df.select(F.col("site").alias("node")), count=True))
    roots = packed.saved(spark, (packed.has_caller(ix.packed) == 0).astype("<i4"))
    down = packed.counts(seeds, ix.packed, {"n_spots": at(ix.spots), "fan": at(ix.spots.where("kind = 'HighFanOut'"))}, labels=labels)
    up = packed.counts(seeds, ix.packed.reversed(spark), {"n_entrypoints": roots}).select("seed", "n_entrypoints", (F.col("n") - F.col("on_cycle")).alias("n_callers"))
    return down.join(up, "seed").select(F.col("seed").alias("suspect"), "n_entrypoints", "n_callers", F.col("n_labels").alias("n_effects"), "n_spots", (F.col("fan") > 0).alias("over_approximate"))


@register("ground_card", W + G + """ SELECT n.fqn, n.tier, (SELECT count(*) FROM inner_e e WHERE e.dst = n.fqn) AS n_callers, (SELECT count(*) FROM inner_e e WHERE e.src = n.fqn) AS n_callees,
 (SELECT count(*) FROM eff e WHERE e.src = n.fqn) AS n_effects, (SELECT count(*) FROM spots s WHERE s.site = n.fqn) AS n_spots FROM nodes n""")
def ground_card(spark, sf):
    ix = B.index(spark, sf)
    n = lambda df, c, name: df.groupBy(F.col(c).alias("fqn")).agg(F.count("*").alias(name))
    out = ix.nodes
    for part in (n(ix.internal, "dst", "n_callers"), n(ix.internal, "src", "n_callees"), n(ix.effects, "src", "n_effects"), n(ix.spots, "site", "n_spots")):
        out = out.join(part, "fqn", "left")
    return out.fillna(0)


@register("resolve_table", W + G + """ SELECT src AS fqn, substr(dst, 10) AS label, regexp_matches(dst, '<dynamic>') AS possible FROM (SELECT DISTINCT src, dst FROM eff) WHERE split_part(dst, ' ', 3) LIKE 'promo%'""")
def resolve_table(spark, sf):
    e = B.index(spark, sf).effects.select("src", "dst").distinct()
    return e.where(L.fields("dst")[2].startswith("promo")).select(F.col("src").alias("fqn"), F.regexp_replace("dst", "^boundary:", "").alias("label"), L.is_dynamic("dst").alias("possible"))


@register("resolve_frame", """WITH RECURSIVE """ + G + """, q AS (SELECT * FROM (VALUES ('order.O7'),('C1'),('shop/part.P12'),('nothing')) v(frame)),
m AS (SELECT frame, fqn, CASE WHEN fqn = frame THEN 1 ELSE 2 END AS r FROM q JOIN nodes ON fqn = frame OR (ends_with(fqn, frame) AND regexp_matches(substr(fqn, length(fqn) - length(frame), 1), '[.(*/]'))),
b AS (SELECT frame, min(r) AS r FROM m GROUP BY frame), k AS (SELECT m.frame, count(*) AS n, min(fqn) AS fqn FROM m JOIN b ON m.frame = b.frame AND m.r = b.r GROUP BY m.frame)
SELECT q.frame, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'ok' ELSE 'ambiguous' END AS status, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN fqn END AS fqn FROM q LEFT JOIN k USING (frame)""")
def resolve_frame(spark, sf):
    """Exact, then a unique suffix at a token border; suffixes of each symbol make it an equi-join."""
    q = spark.createDataFrame([("order.O7",), ("C1",), ("shop/part.P12",), ("nothing",)], "frame string")
    nodes = B.index(spark, sf).nodes.select("fqn")
    starts = F.filter(F.sequence(F.lit(1), F.length("fqn")), lambda i: (i == 1) | F.substring(F.col("fqn"), i - 1, F.lit(1)).isin(".", "(", "*", "/"))
    cut = nodes.select("fqn", F.explode(starts).alias("i")).select("fqn", F.when(F.col("i") == 1, 1).otherwise(2).alias("r"), F.expr("substring(fqn, i)").alias("frame"))
    m = q.join(cut, "frame")
    best = m.groupBy("frame").agg(F.min("r").alias("r"))
    k = m.join(best, ["frame", "r"]).groupBy("frame").agg(F.count("*").alias("n"), F.min("fqn").alias("fqn"))
    return q.join(k, "frame", "left").select("frame", F.when(F.col("n").isNull(), "unresolved").when(F.col("n") == 1, "ok").otherwise("ambiguous").alias("status"), F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("fqn")).alias("fqn"))


# ---- deltas

def _sides(spark, sf):
    return B.index(spark, sf, "base"), B.index(spark, sf, "branch")


def _diff_sql(cols: str, table: str, where: str = "true") -> str:
    x, y = f"SELECT DISTINCT {cols} FROM {table}_n WHERE {where}", f"SELECT DISTINCT {cols} FROM {table}_b WHERE {where}"
    return f"SELECT '+' AS change, * FROM ({x} EXCEPT {y}) UNION ALL SELECT '-', * FROM ({y} EXCEPT {x})"


@register("graph_diff_nodes", W + BOTH + " " + _diff_sql("fqn", "nodes"))
def graph_diff_nodes(spark, sf):
    a, b = _sides(spark, sf)
    return deltas.set_diff(a.nodes.select("fqn"), b.nodes.select("fqn"))


@register("graph_diff_edges", W + BOTH + " " + _diff_sql("src, dst", "inner_e"))
def graph_diff_edges(spark, sf):
    a, b = _sides(spark, sf)
    return deltas.set_diff(a.internal, b.internal)


@register("graph_diff_effects", W + BOTH + " " + _diff_sql("src, dst", "eff"))
def graph_diff_effects(spark, sf):
    a, b = _sides(spark, sf)
    return deltas.set_diff(a.effects.select("src", "dst"), b.effects.select("src", "dst"))


@register("pkg_deltas", W + BOTH + f", d AS ({_diff_sql('fqn', 'nodes')}) SELECT {PKG} AS package, count(*) FILTER (WHERE change = '+') AS nodes_added, count(*) FILTER (WHERE change = '-') AS nodes_removed FROM d GROUP BY 1")
def pkg_deltas(spark, sf):
    a, b = _sides(spark, sf)
    return deltas.pkg_deltas(deltas.set_diff(a.nodes.select("fqn"), b.nodes.select("fqn")))


@register("change_shape", W + BOTH + f", d AS ({_diff_sql('fqn', 'nodes')}), k AS (SELECT count(DISTINCT {PKG}) AS n FROM d) SELECT n AS n_packages, CASE WHEN n = 0 THEN 'body-only' WHEN n <= 1 THEN 'localized' WHEN n <= 3 THEN 'cross-package' ELSE 'broad' END AS shape FROM k")
def change_shape(spark, sf):
    a, b = _sides(spark, sf)
    k = deltas.set_diff(a.nodes.select("fqn"), b.nodes.select("fqn")).agg(F.countDistinct(L.pkg_of("fqn")).alias("n_packages"))
    return k.select("n_packages", deltas.shape(F.col("n_packages")).alias("shape"))


@register("changed_fns", W + BOTH + f", d AS ({_diff_sql('src, dst', 'inner_e')}) SELECT fqn FROM nodes_n WHERE fqn NOT IN (SELECT fqn FROM nodes_b) OR fqn IN (SELECT src FROM d)")
def changed_fns(spark, sf):
    a, b = _sides(spark, sf)
    return deltas.changed_functions(a.nodes, b.nodes, deltas.set_diff(a.internal, b.internal))


@register("attr_delta", W + BOTH + """, o AS (SELECT src, dst, max(concurrent) AS c, list_sort(list(DISTINCT concurrent)) AS s FROM edges_b GROUP BY src, dst), n AS (SELECT src, dst, max(concurrent) AS c, list_sort(list(DISTINCT concurrent)) AS s FROM edges_n GROUP BY src, dst)
SELECT src, dst, CASE WHEN o.c <> n.c THEN 'concurrent' ELSE 'records' END AS field, array_to_string(list_transform(o.s, lambda x: x::VARCHAR), ',') AS old, array_to_string(list_transform(n.s, lambda x: x::VARCHAR), ',') AS new FROM o JOIN n USING (src, dst) WHERE o.s <> n.s""")
def attr_delta(spark, sf):
    return deltas.attr_delta(B.commerce_edges(spark, sf, "base"), B.commerce_edges(spark, sf, "branch"))


@register("new_write_targets", W + BOTH + f" SELECT DISTINCT substr(dst, 10) AS label FROM eff_n WHERE {WRITE} AND dst NOT IN (SELECT dst FROM eff_b)")
def new_write_targets(spark, sf):
    a, b = _sides(spark, sf)
    own = lambda ix: ix.effects.where(L.is_write("dst")).select(L.write_label("dst").alias("label")).distinct()
    return own(b).join(own(a), "label", "left_anti")


@register("route_io_delta", W + BOTH + "," + B.cone_sql("SELECT fqn AS seed FROM roots_b", "cb", "inner_e_b") + "," + B.cone_sql("SELECT fqn AS seed FROM roots_n", "cn", "inner_e_n") + f""",
wb AS (SELECT DISTINCT seed, substr(dst, 10) AS label FROM cb JOIN eff_b ON src = node WHERE {WRITE}), wn AS (SELECT DISTINCT seed, substr(dst, 10) AS label FROM cn JOIN eff_n ON src = node WHERE {WRITE})
SELECT '+' AS change, * FROM (SELECT * FROM wn EXCEPT SELECT * FROM wb) UNION ALL SELECT '-', * FROM (SELECT * FROM wb EXCEPT SELECT * FROM wn)""")
def route_io_delta(spark, sf):
    def own(ix):
        cone = ix.cone(ix.roots().withColumnRenamed("fqn", "seed"))
        return cone.join(ix.effects.where(L.is_write("dst")).select(F.col("src").alias("node"), L.write_label("dst").alias("label")).distinct(), "node").select("seed", "label").distinct()
    a, b = _sides(spark, sf)
    return deltas.set_diff(own(a), own(b))


@register("contract_changes", W + BOTH + """, s AS (SELECT DISTINCT 'db' AS surface, split_part(dst, ' ', 3) AS name FROM eff_b), n AS (SELECT DISTINCT 'db' AS surface, split_part(dst, ' ', 3) AS name FROM eff_n)
SELECT '+' AS op, *, false AS breaking FROM (SELECT * FROM n EXCEPT SELECT * FROM s) UNION ALL SELECT '-', *, true FROM (SELECT * FROM s EXCEPT SELECT * FROM n)""")
def contract_changes(spark, sf):
    a, b = _sides(spark, sf)
    own = lambda ix: ix.effects.select(L.fields("dst")[0].alias("surface"), L.fields("dst")[2].alias("name"))
    return deltas.contract_diff(own(a), own(b))


@register("reach_existing", W + BOTH + f""", d AS ({_diff_sql('src, dst', 'inner_e')}), rev AS (SELECT dst AS src, src AS dst FROM inner_e_n), site AS (SELECT DISTINCT src AS node FROM d WHERE src IN (SELECT fqn FROM nodes_n)),
up AS (SELECT node FROM site UNION SELECT r.dst FROM up JOIN rev r ON r.src = up.node) SELECT fqn FROM roots_n WHERE fqn IN (SELECT node FROM up) AND fqn IN (SELECT fqn FROM roots_b)""")
def reach_existing(spark, sf):
    a, b = _sides(spark, sf)
    names = packed.names_of(a.nodes.unionByName(b.nodes))
    if names is not None:
        own = [packed.marks(names, x.nodes.select(F.col("fqn").alias("node"))) for x in (a, b)]
        old, new = (packed.pack(x.calls, names, member=packed.saved(spark, m)) for x, m in zip((a, b), own, strict=True))
        if old is not None and new is not None:
            site = packed.changed(old, new) & own[1]
            up = site | packed.set_walk(new.reversed(spark), site.nonzero()[0])
            root = up & own[0] & own[1] & (packed.has_caller(old) == 0) & (packed.has_caller(new) == 0)
            return packed.listed(names, spark, packed.saved(spark, root))
    site = deltas.set_diff(a.internal, b.internal).select(F.col("src").alias("node")).distinct().join(b.nodes.select(F.col("fqn").alias("node")), "node", "left_semi")
    up = site.unionByName(_set_closure(site, b.reversed())).distinct()
    return b.roots().join(up.withColumnRenamed("node", "fqn"), "fqn", "left_semi").join(a.roots(), "fqn", "left_semi")


@register("new_blind_spots", """WITH b AS (SELECT p_brand AS kind, 'P'||p_partkey AS site FROM part WHERE p_size % 7 = 0), n AS (SELECT p_brand AS kind, 'P'||p_partkey AS site FROM part WHERE p_size % 5 = 0)
SELECT * FROM (SELECT * FROM n EXCEPT SELECT * FROM b) WHERE kind <> 'Brand#1'""")
def new_blind_spots(spark, sf):
    own = lambda m: B.t(spark, sf, "part").where(F.col("p_size") % m == 0).select(F.col("p_brand").alias("kind"), F.concat(F.lit("P"), "p_partkey").alias("site")).distinct()
    return own(5).join(own(7), ["kind", "site"], "left_anti").where("kind <> 'Brand#1'")


# ---- rollup and claims

@register("rollup", W + G + f""" SELECT {PKG.replace('fqn', 'src')} AS "from", CASE WHEN dst LIKE 'boundary:%' THEN split_part(substr(dst, 10), ' ', 1) ELSE {PKG.replace('fqn', 'dst')} END AS "to", CASE WHEN dst LIKE 'boundary:%' THEN 'effect' ELSE 'call' END AS kind, count(*) AS n
 FROM (SELECT DISTINCT src, dst FROM edges) WHERE dst LIKE 'boundary:%' OR {PKG.replace('fqn', 'src')} <> {PKG.replace('fqn', 'dst')} GROUP BY ALL""")
def rollup(spark, sf):
    ix = B.index(spark, sf)
    e = ix.internal.unionByName(ix.effects.select("src", "dst").distinct())
    out = L.is_boundary("dst")
    to = F.when(out, L.fields("dst")[0]).otherwise(L.pkg_of("dst"))
    return e.where(out | (L.pkg_of("src") != L.pkg_of("dst"))).groupBy(L.pkg_of("src").alias("from"), to.alias("to"), F.when(out, "effect").otherwise("call").alias("kind")).agg(F.count("*").alias("n"))


@register("claims_degree", W + G + " SELECT dst AS fqn, count(*) AS n_callers, count(*) = 3 AS pass FROM inner_e WHERE dst LIKE 'shop/part.%' GROUP BY dst")
def claims_degree(spark, sf):
    return B.index(spark, sf).internal.where("dst LIKE 'shop/part.%'").groupBy(F.col("dst").alias("fqn")).agg(F.count("*").alias("n_callers"), (F.count("*") == 3).alias("pass"))


@register("claims_edge", W + G + """, c AS (SELECT * FROM (VALUES ('shop/region.R1','shop/nation.N1'),('shop/region.R0','shop/nation.N0'),('shop/nation.N0','shop/region.R0'),('shop/gone','shop/region.R0')) v(f, t))
SELECT f AS "from", t AS "to", CASE WHEN f NOT IN (SELECT fqn FROM nodes) OR t NOT IN (SELECT fqn FROM nodes) THEN 'ERROR' WHEN EXISTS (SELECT 1 FROM inner_e e WHERE e.src = f AND e.dst = t) THEN 'PASS' ELSE 'FAIL' END AS status FROM c""")
def claims_edge(spark, sf):
    ix = B.index(spark, sf)
    c = spark.createDataFrame([("shop/region.R1", "shop/nation.N1"), ("shop/region.R0", "shop/nation.N0"), ("shop/nation.N0", "shop/region.R0"), ("shop/gone", "shop/region.R0")], "from string, to string")
    known = lambda name: ix.nodes.select(F.col("fqn").alias(name), F.lit(True).alias("has_" + name))
    pairs = ix.internal.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.lit(True).alias("there"))
    return c.join(known("from"), "from", "left").join(known("to"), "to", "left").join(pairs, ["from", "to"], "left").select(
        "from", "to", F.when(F.col("has_from").isNull() | F.col("has_to").isNull(), "ERROR").when(F.col("there"), "PASS").otherwise("FAIL").alias("status"))


@register("pattern_liveness", W + G + """, p AS (SELECT * FROM (VALUES ('shop/order'),('shop/ord'),('shop/part.P1'),('db DELETE'),('db')) v(pattern)), nm AS (SELECT fqn AS nm FROM nodes UNION SELECT substr(dst, 10) FROM eff)
SELECT pattern, count(nm) AS n_bound, count(nm) = 0 AS dead FROM p LEFT JOIN nm ON nm = pattern OR (starts_with(nm, pattern) AND NOT regexp_matches(substr(nm, length(pattern) + 1, 1), '[A-Za-z0-9_]')) GROUP BY pattern""")
def pattern_liveness(spark, sf):
    from meshwright.operators.graph import bind

    ix = B.index(spark, sf)
    p = spark.createDataFrame([(x,) for x in ("shop/order", "shop/ord", "shop/part.P1", "db DELETE", "db")], "pattern string")
    names = ix.nodes.select(F.col("fqn").alias("name")).unionByName(ix.effects.select(F.regexp_replace("dst", "^boundary:", "").alias("name"))).distinct()
    n = bind(names, p).groupBy("pattern").agg(F.count("*").alias("n"))
    return p.join(n, "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("n_bound"), F.col("n").isNull().alias("dead"))


@register("triage_zones", W + G + "," + B.cone_sql("SELECT fqn AS seed FROM nodes WHERE fqn LIKE 'shop/order.%'") + """, s AS (SELECT seed, bool_or(site IN (SELECT 'shop/part.P'||p_partkey FROM part WHERE p_size = 14)) AS fresh FROM cone JOIN spots ON site = node WHERE severity <> 'trivial' GROUP BY seed)
SELECT fqn, CASE WHEN fresh THEN 'new-blind' WHEN s.seed IS NOT NULL THEN 'carried' ELSE 'accounted' END AS zone FROM nodes LEFT JOIN s ON s.seed = fqn WHERE fqn LIKE 'shop/order.%'""")
def triage_zones(spark, sf):
    """A function is new-blind with a serious forward spot that base lacks (here: parts of size 14), else carried or accounted."""
    ix = B.index(spark, sf)
    seeds = ix.nodes.where("fqn LIKE 'shop/order.%'").select(F.col("fqn").alias("seed"))
    new = B.t(spark, sf, "part").where("p_size = 14").select(F.concat(F.lit("shop/part.P"), "p_partkey").alias("node"), F.lit(1).alias("new"))
    serious = ix.spots.where("severity <> 'trivial'").select(F.col("site").alias("node")).distinct()
    if ix.packed is not None:
        back, files = ix.packed.reversed(spark), {}
        for name, at in (("any", serious), ("fresh", serious.join(new, "node", "left_semi"))):
            mark = packed.marks(ix.names, at)
            files[name] = packed.saved(spark, mark | packed.set_walk(back, mark.nonzero()[0]))
        zone = F.when(F.col("fresh") == 1, "new-blind").when(F.col("any") == 1, "carried").otherwise("accounted")
        return packed.looked_up(seeds, ix.names, **files).select(F.col("seed").alias("fqn"), zone.alias("zone"))
    s = ix.cone(seeds).join(serious, "node").join(new, "node", "left").groupBy("seed").agg(F.max("new").alias("fresh"), F.lit(1).alias("any"))
    return seeds.join(s, "seed", "left").select(F.col("seed").alias("fqn"), F.when(F.col("fresh") == 1, "new-blind").when(F.col("any") == 1, "carried").otherwise("accounted").alias("zone"))
