"""Views of the driver's tables as graphs, buses, spans and corpora (and the same in SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.operators.graph import GraphIndex

BASE_END, BRANCH_START = "2000-01-01", "1996-01-01"


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _n(prefix: str, key: str):
    return F.concat(F.lit(f"shop/{prefix}"), F.col(key).cast("string"))


def side_orders(spark: SparkSession, sf: str, side: str | None) -> DataFrame:
    o = t(spark, sf, "orders")
    if side == "base":
        return o.where(F.col("o_orderdate") < BASE_END)
    return o.where(F.col("o_orderdate") >= BRANCH_START) if side == "branch" else o


def commerce_nodes(spark: SparkSession, sf: str, side: str | None = None) -> DataFrame:
    """fqn, sig, tier: region > nation > customer > order > part > supplier."""
    parts = [
        (t(spark, sf, "region"), "region.R", "r_regionkey", 1), (t(spark, sf, "nation"), "nation.N", "n_nationkey", 1),
        (t(spark, sf, "customer"), "customer.C", "c_custkey", 2), (side_orders(spark, sf, side), "order.O", "o_orderkey", 2),
        (t(spark, sf, "part"), "part.P", "p_partkey", 3), (t(spark, sf, "supplier"), "supplier.S", "s_suppkey", 3),
    ]
    frames = [df.select(_n(p, k).alias("fqn"), F.lit(tier).alias("tier")) for df, p, k, tier in parts]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _lines(spark: SparkSession, sf: str, side: str | None) -> DataFrame:
    return t(spark, sf, "lineitem").join(side_orders(spark, sf, side).select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")


def commerce_calls(spark: SparkSession, sf: str, side: str | None = None, cyclic: bool = False) -> DataFrame:
    """src, dst, concurrent of first-party calls; order lines are read once for both of theirs."""
    none = F.lit(False).alias("concurrent")
    out = t(spark, sf, "nation").select(_n("region.R", "n_regionkey").alias("src"), _n("nation.N", "n_nationkey").alias("dst"), none)
    out = out.unionByName(t(spark, sf, "customer").select(_n("nation.N", "c_nationkey").alias("src"), _n("customer.C", "c_custkey").alias("dst"), none))
    out = out.unionByName(side_orders(spark, sf, side).select(_n("customer.C", "o_custkey").alias("src"), _n("order.O", "o_orderkey").alias("dst"), none))
    part = _n("part.P", "l_partkey")
    call = lambda src, dst, c: F.struct(src.alias("src"), dst.alias("dst"), c.alias("concurrent"))
    pair = F.array(call(_n("order.O", "l_orderkey"), part, F.col("l_linestatus") == "O"), call(part, _n("supplier.S", "l_suppkey"), F.lit(False)))
    out = out.unionByName(_lines(spark, sf, side).select(F.inline(pair)))
    if cyclic:
        out = out.unionByName(t(spark, sf, "supplier").select(_n("supplier.S", "s_suppkey").alias("src"), _n("nation.N", "s_nationkey").alias("dst"), none))
    return out


def commerce_effects(spark: SparkSession, sf: str, side: str | None = None) -> DataFrame:
    """src, dst, concurrent: one boundary edge per order line."""
    verb = F.when(F.col("l_returnflag") == "N", "INSERT").when(F.col("l_returnflag") == "A", "UPDATE").otherwise("DELETE")
    typed = _lines(spark, sf, side).join(t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand"), "l_partkey")
    return typed.select(
        _n("order.O", "l_orderkey").alias("src"),
        F.concat(F.lit("boundary:db "), verb, F.lit(" "), F.lower("p_type"), F.lit("_"), F.lower(F.replace("p_brand", F.lit(" "), F.lit("_")))).alias("dst"),
        (F.col("l_linestatus") == "O").alias("concurrent"))


def commerce_edges(spark: SparkSession, sf: str, side: str | None = None, cyclic: bool = False) -> DataFrame:
    """src, dst, concurrent; calls and effects."""
    return commerce_calls(spark, sf, side, cyclic).unionByName(commerce_effects(spark, sf, side))


def spots(spark: SparkSession, sf: str) -> DataFrame:
    """site, kind, detail, severity on the parts whose size is divisible by 7."""
    k = F.col("p_partkey") % 4
    kind = F.when(k == 0, "Reflect").when(k == 1, "UnresolvedCall").when(k == 2, "HighFanOut").otherwise("ExternalBoundaryCall")
    return t(spark, sf, "part").where("p_size % 7 = 0").select(
        _n("part.P", "p_partkey").alias("site"), kind.alias("kind"), F.col("p_brand").alias("detail"),
        F.when(F.col("p_partkey") % 5 == 0, "trivial").otherwise("serious").alias("severity"))


def index(spark: SparkSession, sf: str, side: str | None = None, cyclic: bool = False) -> GraphIndex:
    return GraphIndex(commerce_nodes(spark, sf, side), commerce_calls(spark, sf, side, cyclic), spots(spark, sf), commerce_effects(spark, sf, side))


def graph_sql(side: str = "", cyclic: bool = False, tag: str = "") -> str:
    """CTEs nodes, edges, inner_e, eff, spots (suffixed with tag) for DuckDB."""
    when = {"": "true", "base": f"o_orderdate < TIMESTAMP '{BASE_END}'", "branch": f"o_orderdate >= TIMESTAMP '{BRANCH_START}'"}[side]
    cyc = "UNION ALL SELECT 'shop/supplier.S'||s_suppkey, 'shop/nation.N'||s_nationkey, false FROM supplier" if cyclic else ""
    g = tag
    return f"""
ord{g} AS (SELECT * FROM orders WHERE {when}),
li{g} AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM ord{g})),
nodes{g} AS (SELECT 'shop/region.R'||r_regionkey AS fqn, 1 AS tier FROM region UNION ALL SELECT 'shop/nation.N'||n_nationkey, 1 FROM nation
 UNION ALL SELECT 'shop/customer.C'||c_custkey, 2 FROM customer UNION ALL SELECT 'shop/order.O'||o_orderkey, 2 FROM ord{g}
 UNION ALL SELECT 'shop/part.P'||p_partkey, 3 FROM part UNION ALL SELECT 'shop/supplier.S'||s_suppkey, 3 FROM supplier),
edges{g} AS (SELECT 'shop/region.R'||n_regionkey AS src, 'shop/nation.N'||n_nationkey AS dst, false AS concurrent FROM nation
 UNION ALL SELECT 'shop/nation.N'||c_nationkey, 'shop/customer.C'||c_custkey, false FROM customer
 UNION ALL SELECT 'shop/customer.C'||o_custkey, 'shop/order.O'||o_orderkey, false FROM ord{g}
 UNION ALL SELECT 'shop/order.O'||l_orderkey, 'shop/part.P'||l_partkey, l_linestatus = 'O' FROM li{g}
 UNION ALL SELECT 'shop/part.P'||l_partkey, 'shop/supplier.S'||l_suppkey, false FROM li{g} {cyc}
 UNION ALL SELECT 'shop/order.O'||l_orderkey, 'boundary:db '||CASE l_returnflag WHEN 'N' THEN 'INSERT' WHEN 'A' THEN 'UPDATE' ELSE 'DELETE' END||' '||lower(p_type)||'_'||lower(replace(p_brand,' ','_')), l_linestatus = 'O'
  FROM li{g} JOIN part ON l_partkey = p_partkey),
eff{g} AS (SELECT * FROM edges{g} WHERE dst LIKE 'boundary:%'),
inner_e{g} AS (SELECT DISTINCT src, dst FROM edges{g} WHERE dst IN (SELECT fqn FROM nodes{g})),
roots{g} AS (SELECT fqn FROM nodes{g} WHERE fqn NOT IN (SELECT dst FROM inner_e{g})),
spots{g} AS (SELECT 'shop/part.P'||p_partkey AS site, CASE p_partkey % 4 WHEN 0 THEN 'Reflect' WHEN 1 THEN 'UnresolvedCall' WHEN 2 THEN 'HighFanOut' ELSE 'ExternalBoundaryCall' END AS kind,
 p_brand AS detail, CASE WHEN p_partkey % 5 = 0 THEN 'trivial' ELSE 'serious' END AS severity FROM part WHERE p_size % 7 = 0)"""


def cone_sql(seeds: str, name: str = "cone", edges: str = "inner_e") -> str:
    return f"{name} AS (SELECT seed, seed AS node FROM ({seeds}) UNION SELECT c.seed, e.dst FROM {name} c JOIN {edges} e ON e.src = c.node)"


def bus(spark: SparkSession, sf: str) -> DataFrame:
    """service, op, event, fn: even users publish, odd ones consume; errors have no name."""
    return t(spark, sf, "events").select(
        F.concat(F.lit("svc"), F.col("user_id") % 20).alias("service"),
        F.when(F.col("user_id") % 2 == 0, "PUBLISH").otherwise("CONSUME").alias("op"),
        F.when(F.col("event_type") == "error", "<dynamic>").otherwise(F.concat("event_type", F.lit("."), F.col("event_id") % 13)).alias("event"),
        F.concat(F.lit("svc/u.U"), "user_id").alias("fn"))


BUS_SQL = """bus AS (SELECT 'svc'||(user_id % 20) AS service, CASE WHEN user_id % 2 = 0 THEN 'PUBLISH' ELSE 'CONSUME' END AS op,
 CASE WHEN event_type = 'error' THEN '<dynamic>' ELSE event_type||'.'||(event_id % 13) END AS event, 'svc/u.U'||user_id AS fn FROM events)"""


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """flow, service, id, parent, op, start_ns, end_ns: one flow a user and day, its first event the root."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    e = t(spark, sf, "events").select(
        F.concat("user_id", F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("flow"), F.concat(F.lit("svc"), F.col("user_id") % 3).alias("service"),
        F.col("event_id").alias("id"), F.col("event_type").alias("op"), (micros * 1000).alias("start_ns"),
        (micros * 1000 + (F.col("event_id") % 7) * F.lit(3_600_000_000_000)).alias("end_ns"))
    first = e.groupBy("flow").agg(F.min(F.struct("start_ns", "id"))["id"].alias("root"))
    return e.join(first, "flow").select("flow", "service", "id", F.when(F.col("id") != F.col("root"), F.col("root")).alias("parent"), "op", "start_ns", "end_ns")


SPANS_SQL = """ev AS (SELECT user_id||'-'||strftime(ts, '%Y%m%d') AS flow, 'svc'||(user_id % 3) AS service, event_id AS id, event_type AS op, epoch_us(ts)*1000 AS start_ns,
 epoch_us(ts)*1000 + (event_id % 7) * 3600000000000 AS end_ns FROM events),
fst AS (SELECT flow, id AS root FROM (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY start_ns, id) AS r FROM ev) WHERE r = 1),
spans AS (SELECT ev.flow, service, id, CASE WHEN id <> root THEN root END AS parent, op, start_ns, end_ns FROM ev JOIN fst USING (flow))"""
