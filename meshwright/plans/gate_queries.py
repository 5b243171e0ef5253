"""Registered queries of the gate: two versions of a shop, findings, exceptions, contracts, surfaces.

The base has the orders before 1998, the branch those from 1994 on. A customer calls its orders (urgent
ones concurrently in the base, dear ones in the branch); an order writes its year's table, asks a
payment service, or runs a statement that nobody can read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.operators import deltas
from meshwright.operators import policy as P
from meshwright.operators import rules, traces
from meshwright.operators.graph import GraphIndex
from meshwright.plans import bindings as B
from meshwright.plans.registry import register

WHEN = {"base": "o_orderdate < TIMESTAMP '1998-01-01'", "branch": "o_orderdate >= TIMESTAMP '1994-01-01'"}
BESIDE = {"base": "o_orderpriority = '1-URGENT'", "branch": "o_totalprice > 150000"}
LABEL = "CASE o_orderkey % 4 WHEN 0 THEN 'db INSERT y' || year(o_orderdate) WHEN 1 THEN 'pay POST /' || lower(o_orderstatus) || '/' || year(o_orderdate) WHEN 2 THEN 'db exec' ELSE 'db SELECT y' END"


def shop(spark: SparkSession, sf: str, side: str) -> GraphIndex:
    o = B.t(spark, sf, "orders").where(WHEN[side])
    c = B.t(spark, sf, "customer")
    nodes = c.selectExpr("'shop/customer.C' || c_custkey AS fqn").unionByName(o.selectExpr("'shop/order.O' || o_orderkey AS fqn"))
    calls = o.selectExpr("'shop/customer.C' || o_custkey AS src", "'shop/order.O' || o_orderkey AS dst", f"{BESIDE[side]} AS concurrent")
    does = o.selectExpr("'shop/order.O' || o_orderkey AS src", f"'boundary:' || {LABEL} AS dst", "false AS concurrent")
    spots = c.where("c_custkey % 50 = 0" if side == "base" else "c_custkey % 30 = 0").selectExpr("'shop/customer.C' || c_custkey AS site", "'Reflect' AS kind", "'' AS detail")
    return GraphIndex(nodes, calls.unionByName(does), spots)


def shop_sql(side: str) -> str:
    """CTEs own_<side>(cust, ord, label, beside) and spots_<side>(site)."""
    mod = 50 if side == "base" else 30
    return f"""own_{side} AS (SELECT 'shop/customer.C' || o_custkey AS cust, 'shop/order.O' || o_orderkey AS ord, {LABEL} AS label, {BESIDE[side]} AS beside FROM orders WHERE {WHEN[side]}),
spots_{side} AS (SELECT 'shop/customer.C' || c_custkey AS site FROM customer WHERE c_custkey % {mod} = 0)"""


BOTH = "WITH " + shop_sql("base") + ", " + shop_sql("branch")
WRITE = "(label LIKE 'db INSERT %' OR label LIKE 'pay POST %')"


@register("gate_new_writes", BOTH + f" SELECT DISTINCT label FROM own_branch WHERE {WRITE} AND label NOT IN (SELECT label FROM own_base) AND label NOT LIKE 'pay POST /f/%'")
def gate_new_writes(spark, sf) -> DataFrame:
    policy = {"effect_ratchet": {"gate": True, "allow": [{"target": "pay POST /f"}]}}
    return P.new_writes(policy, shop(spark, sf, "base"), shop(spark, sf, "branch"))


@register("gate_new_spots", BOTH + " SELECT 'Reflect' AS kind, site FROM spots_branch WHERE site NOT IN (SELECT site FROM spots_base) AND site <> 'shop/customer.C30'")
def gate_new_spots(spark, sf) -> DataFrame:
    policy = {"blind_spot_ratchet": {"allow": [{"kind": "Reflect", "site": "shop/customer.C30"}, {"kind": "Unsafe", "site": "shop"}]}}
    return P.new_spots(policy, shop(spark, sf, "base").spots, shop(spark, sf, "branch").spots)


@register("edge_attr_delta", BOTH + """, o AS (SELECT cust AS src, substr(ord, -1) AS dst, max(beside) AS c, list_sort(list(DISTINCT beside)) AS s FROM own_base GROUP BY ALL), n AS (SELECT cust AS src, substr(ord, -1) AS dst, max(beside) AS c, list_sort(list(DISTINCT beside)) AS s FROM own_branch GROUP BY ALL)
SELECT src, dst, CASE WHEN o.c <> n.c THEN 'concurrent' ELSE 'records' END AS field, array_to_string(list_transform(o.s, lambda x: x::VARCHAR), ',') AS old, array_to_string(list_transform(n.s, lambda x: x::VARCHAR), ',') AS new FROM o JOIN n USING (src, dst) WHERE o.s <> n.s""")
def edge_attr_delta(spark, sf) -> DataFrame:
    """Calls folded to the last digit of an order, so that a pair has several records."""
    side = lambda s: shop(spark, sf, s).calls.select("src", F.expr("right(dst, 1)").alias("dst"), "concurrent")
    return deltas.attr_delta(side("base"), side("branch"))


@register("route_write_delta", BOTH + f""", b AS (SELECT DISTINCT cust AS route, label FROM own_base WHERE {WRITE}), n AS (SELECT DISTINCT cust AS route, label FROM own_branch WHERE {WRITE})
SELECT '+' AS change, * FROM (SELECT * FROM n EXCEPT SELECT * FROM b) UNION ALL SELECT '-', * FROM (SELECT * FROM b EXCEPT SELECT * FROM n)""")
def route_write_delta(spark, sf) -> DataFrame:
    side = lambda s: P.route_surface(shop(spark, sf, s)).select("route", F.explode("writes").alias("label"))
    return deltas.set_diff(side("base"), side("branch"))


@register("route_surface", BOTH + f""" SELECT r.route, count(DISTINCT label) FILTER (WHERE {WRITE}) AS n_writes, count(DISTINCT label) FILTER (WHERE label = 'db exec') AS n_unclassified,
 r.route IN (SELECT site FROM spots_base) AS blind FROM (SELECT 'shop/customer.C' || c_custkey AS route FROM customer) r LEFT JOIN own_base ON cust = route GROUP BY r.route""")
def route_surface(spark, sf) -> DataFrame:
    return P.route_surface(shop(spark, sf, "base")).select("route", F.size("writes").cast("long").alias("n_writes"), F.size("unclassified").cast("long").alias("n_unclassified"), "blind")


@register("findings_diff", BOTH + f""", b AS (SELECT cust, string_agg(DISTINCT label, ', ' ORDER BY label) AS w, count(DISTINCT label) AS c FROM own_base WHERE {WRITE} GROUP BY cust HAVING count(DISTINCT label) > 4),
n AS (SELECT cust, string_agg(DISTINCT label, ', ' ORDER BY label) AS w, count(DISTINCT label) AS c FROM own_branch WHERE {WRITE} GROUP BY cust HAVING count(DISTINCT label) > 4)
SELECT 'violation' AS severity, n.cust AS "from", n.w IS NOT DISTINCT FROM b.w AS standing FROM n LEFT JOIN b USING (cust)""")
def findings_diff(spark, sf) -> DataFrame:
    """Budget findings new on the branch and standing ones; the writes named are part of their identity."""
    policy = {"io_budget": {"max_writes_per_route": 4}}
    base, branch = (P.budget_findings(shop(spark, sf, s), policy).where("severity = 'violation'") for s in ("base", "branch"))
    return P.findings_diff(base, branch).select("severity", "from", "standing")


@register("contract_delta", BOTH + """, b AS (SELECT DISTINCT 'outbound' AS surface, label AS name FROM own_base WHERE label LIKE 'pay %' UNION SELECT 'entrypoint http', 'GET /' || substr(cust, 14) FROM own_base),
n AS (SELECT DISTINCT 'outbound' AS surface, label AS name FROM own_branch WHERE label LIKE 'pay %' UNION SELECT 'entrypoint http', 'GET /' || substr(cust, 14) FROM own_branch)
SELECT '+' AS op, *, false AS breaking FROM (SELECT * FROM n EXCEPT SELECT * FROM b) UNION ALL SELECT '-', *, true FROM (SELECT * FROM b EXCEPT SELECT * FROM n)""")
def contract_delta(spark, sf) -> DataFrame:
    def side(s: str) -> DataFrame:
        ix = shop(spark, sf, s)
        routes = ix.calls.select(F.lit("http").alias("kind"), F.concat(F.lit("GET /"), F.expr("substr(src, 14)")).alias("name")).distinct()
        return P.contract_surface(ix, routes)

    return deltas.contract_diff(side("base"), side("branch"))


@register("concurrent_below", BOTH + " SELECT DISTINCT ord AS \"from\", label AS \"to\" FROM own_branch WHERE beside AND label LIKE 'pay POST %'")
def concurrent_below(spark, sf) -> DataFrame:
    """Effects below calls that are made concurrently; the effects themselves are not marked."""
    policy = {"no_concurrent_reach": [{"name": "pay", "to": ["pay POST"]}]}
    return P.concurrent_findings(shop(spark, sf, "branch"), policy).where("severity = 'violation'").select("from", "to")


@register("layering_helpers", """SELECT DISTINCT 'shop/region.R' || n_regionkey AS "from", 'shop/customer.C' || c_custkey AS "to" FROM nation JOIN customer ON c_nationkey = n_nationkey
UNION SELECT 'shop/order.O' || l_orderkey, 'x' FROM lineitem WHERE false""")
def layering_helpers(spark, sf) -> DataFrame:
    """Nations have no layer: what regions call through them counts."""
    layers = spark.createDataFrame([("geo", 0, "shop/region"), ("between", 1, "shop/none"), ("people", 2, "shop/customer"), ("sales", 3, "shop/order"), ("goods", 4, "shop/part"), ("makers", 5, "shop/supplier")], "layer string, rank int, prefix string")
    return rules.layering(B.index(spark, sf), layers)


@register("exceptions_audit", """WITH bad AS (SELECT DISTINCT 'shop/order.O' || l_orderkey AS f FROM lineitem)
SELECT 'layering' AS section, 'shop/order.O' || k AS "from", '' AS "to", ('shop/order.O' || k) IN (SELECT f FROM bad) AS live FROM (VALUES (1), (2), (99999999)) v(k)
UNION ALL SELECT 'effect_ratchet', '', t, live FROM (VALUES ('db INSERT', true), ('db MERGE', false)) w(t, live)
UNION ALL SELECT 'blind_spot_ratchet', 'Reflect', 'shop/part', true""")
def exceptions_audit(spark, sf) -> DataFrame:
    policy = {
        "layers": [{"name": n, "packages": [p]} for n, p in (("g", "shop/region"), ("n", "shop/nation"), ("p", "shop/customer"), ("s", "shop/order"), ("x", "shop/none"), ("d", "shop/part"), ("m", "shop/supplier"))],
        "layering": {"allow": [{"from": f"shop/order.O{k}", "to": ""} for k in (1, 2, 99999999)]},
        "effect_ratchet": {"allow": [{"target": "db INSERT"}, {"target": "db MERGE"}]}, "blind_spot_ratchet": {"allow": [{"kind": "Reflect", "site": "shop/part"}]}}
    return P.exceptions_audit(B.index(spark, sf), policy)


@register("scope_escapes", BOTH + """, t AS (SELECT DISTINCT n_name AS package FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN (SELECT cust FROM (SELECT cust, ord FROM own_branch EXCEPT SELECT cust, ord FROM own_base)) d ON d.cust = 'shop/customer.C' || c_custkey)
SELECT package FROM t WHERE package NOT LIKE 'NATION_1%'""")
def scope_escapes(spark, sf) -> DataFrame:
    """Nations whose customers call anew, outside the declared ones."""
    a, b = shop(spark, sf, "base"), shop(spark, sf, "branch")
    moved = deltas.set_diff(a.internal, b.internal).where("change = '+'").select(F.col("src").alias("fqn")).distinct()
    of = B.t(spark, sf, "customer").join(B.t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("'shop/customer.C' || c_custkey AS fqn", "n_name AS package")
    names = [r["n_name"] for r in B.t(spark, sf, "nation").where("n_name LIKE 'NATION_1%'").select("n_name").collect()]
    return P.scope_escapes(moved.join(of, "fqn"), names)


@register("contract_compare", """WITH b AS (SELECT DISTINCT n_regionkey || ' ' || (n_nationkey % 3) AS k FROM nation WHERE n_nationkey < 8), n AS (SELECT DISTINCT n_regionkey || ' ' || (n_nationkey % 3) AS k FROM nation WHERE n_nationkey >= 17)
SELECT '+' AS op, 'publish' AS surface, k AS name, false AS breaking FROM (SELECT * FROM n EXCEPT SELECT * FROM b) UNION ALL SELECT '-', 'publish', k, true FROM (SELECT * FROM b EXCEPT SELECT * FROM n)
UNION ALL SELECT '~', 'dependency', 'http pay', false""")
def contract_compare(spark, sf) -> DataFrame:
    """Two contract documents built from nations: publications come and go, a dependency changes its operations."""
    def doc(where: str, op: str) -> DataFrame:
        events = B.t(spark, sf, "nation").where(where).selectExpr("struct(n_regionkey || ' ' || (n_nationkey % 3) AS event, 1 AS tier) AS e").distinct()
        return events.agg(F.collect_list("e").alias("published")).select(
            F.lit("s").alias("service"), F.lit(None).cast("struct<http:array<struct<method:string,route:string,tier:int>>,consumers:array<struct<event:string,tier:int>>>").alias("entrypoints"), "published",
            F.lit(None).cast("array<struct<event:string,tier:int>>").alias("consumed"), F.array(F.struct(F.lit("pay").alias("peer"), F.lit("http").alias("kind"), F.array(F.lit(op)).alias("ops"), F.lit(1).alias("tier"))).alias("external_dependencies"))

    return P.compare_contracts(doc("n_nationkey < 8", "POST /a"), doc("n_nationkey >= 17", "POST /b"))


@register("many_heads", """WITH e AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS flow, event_id AS id, event_type = 'signup' OR row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y%m%d') ORDER BY ts, event_id) = 1 AS head FROM events)
SELECT flow, count(*) AS n_spans, count(*) FILTER (WHERE head) AS n_heads, CASE WHEN count(*) FILTER (WHERE head) = 1 THEN min(id) FILTER (WHERE head) ELSE -1 END AS root, count(*) FILTER (WHERE head) <> 1 AS synthesized FROM e GROUP BY flow""")
def many_heads(spark, sf) -> DataFrame:
    """Flows in which every sign-up stands alone: several heads get an invented root, written -1."""
    s = B.spans(spark, sf)
    return traces.assemble_roots(s.withColumn("parent", F.when(F.col("op") != "signup", F.col("parent")))).fillna({"root": -1})
