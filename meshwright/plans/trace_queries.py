"""Registered queries: fleets of services, spans, scalar functions, drift and observed effects."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meshwright.functions import labels as L
from meshwright.functions.sqlnorm import sql_normal_form
from meshwright.operators import traces as T
from meshwright.plans import bindings as B
from meshwright.plans.registry import register


def _named(spark, sf):
    return B.bus(spark, sf).where("event <> '<dynamic>'")


def _join(c):
    return F.array_join(F.array_sort(F.collect_set(c)), ",")


@register("chains", "WITH " + B.BUS_SQL + """, p AS (SELECT event, string_agg(DISTINCT service, ',' ORDER BY service) AS producers FROM bus WHERE op = 'PUBLISH' AND event <> '<dynamic>' GROUP BY event),
c AS (SELECT event, string_agg(DISTINCT service, ',' ORDER BY service) AS consumers FROM bus WHERE op = 'CONSUME' AND event NOT IN ('<dynamic>') AND event NOT LIKE 'view%1' GROUP BY event)
SELECT event, producers, consumers, CASE WHEN producers IS NULL THEN 'no-producer' WHEN consumers IS NULL THEN 'no-consumer' ELSE 'closed' END AS state FROM p FULL OUTER JOIN c USING (event)""")
def chains(spark, sf):
    b = _named(spark, sf)
    p = b.where("op = 'PUBLISH'").groupBy("event").agg(_join("service").alias("producers"))
    c = b.where("op = 'CONSUME' AND event NOT LIKE 'view%1'").groupBy("event").agg(_join("service").alias("consumers"))
    return p.join(c, "event", "full_outer").select("event", "producers", "consumers", F.when(F.col("producers").isNull(), "no-producer").when(F.col("consumers").isNull(), "no-consumer").otherwise("closed").alias("state"))


@register("fleet_events", "WITH " + B.BUS_SQL + " SELECT event, count(*) FILTER (WHERE op = 'PUBLISH') AS n_publish, count(*) FILTER (WHERE op = 'CONSUME') AS n_consume, count(DISTINCT service) AS n_services FROM bus GROUP BY event")
def fleet_events(spark, sf):
    return B.bus(spark, sf).groupBy("event").agg(F.count_if(F.col("op") == "PUBLISH").alias("n_publish"), F.count_if(F.col("op") == "CONSUME").alias("n_consume"), F.countDistinct("service").alias("n_services"))


@register("choreography", "WITH " + B.BUS_SQL + """, d AS (SELECT DISTINCT service, op, event FROM bus WHERE event <> '<dynamic>')
SELECT p.service AS "from", c.service AS "to", count(*) AS n_events FROM d p JOIN d c ON p.event = c.event AND p.op = 'PUBLISH' AND c.op = 'CONSUME' GROUP BY ALL""")
def choreography(spark, sf):
    d = _named(spark, sf).select("service", "op", "event").distinct()
    p, c = d.where("op = 'PUBLISH'").select(F.col("service").alias("from"), "event"), d.where("op = 'CONSUME'").select(F.col("service").alias("to"), "event")
    return p.join(c, "event").groupBy("from", "to").agg(F.count("*").alias("n_events"))


@register("system_context", "WITH " + B.BUS_SQL + ", " + B.SPANS_SQL + """, solid AS (SELECT DISTINCT r.service AS f, s.service AS t FROM spans s JOIN spans r ON s.parent = r.id WHERE r.service <> s.service),
dash AS (SELECT DISTINCT 'svc'||(user_id % 3) AS f, 'svc'||(user_id % 5) AS t FROM events WHERE user_id % 3 <> user_id % 5)
SELECT f AS "from", t AS "to", bool_and(dashed) AS dashed FROM (SELECT f, t, false AS dashed FROM solid UNION ALL SELECT f, t, true FROM dash) GROUP BY f, t""")
def system_context(spark, sf):
    s = B.spans(spark, sf)
    solid = s.join(s.select(F.col("id").alias("parent"), F.col("service").alias("from")), "parent").where("`from` <> service").select("from", F.col("service").alias("to"), F.lit(False).alias("dashed"))
    e = B.t(spark, sf, "events").where("user_id % 3 <> user_id % 5")
    dash = e.select(F.concat(F.lit("svc"), F.col("user_id") % 3).alias("from"), F.concat(F.lit("svc"), F.col("user_id") % 5).alias("to"), F.lit(True).alias("dashed"))
    return solid.unionByName(dash).groupBy("from", "to").agg(F.bool_and("dashed").alias("dashed"))


@register("root_assembly", "WITH " + B.SPANS_SQL + " SELECT flow, count(*) AS n_spans, count(*) FILTER (WHERE parent IS NULL) AS n_heads, min(CASE WHEN parent IS NULL THEN id END) AS root, false AS synthesized FROM spans GROUP BY flow")
def root_assembly(spark, sf):
    return T.assemble_roots(B.spans(spark, sf))


@register("stitch_flows", "WITH " + B.SPANS_SQL + ", l AS (SELECT id, lag(id) OVER (PARTITION BY flow ORDER BY start_ns, id) AS parent, first_value(id) OVER (PARTITION BY flow ORDER BY start_ns, id) AS root FROM spans) SELECT id, root FROM l")
def stitch_flows(spark, sf):
    """Each span linked to the one before it in its flow; heads found by pointer jumping."""
    s = B.spans(spark, sf)
    return T.stitch(s.select("id", F.lag("id").over(Window.partitionBy("flow").orderBy("start_ns", "id")).alias("parent")))


GROUPS = B.SPANS_SQL + """, k AS (SELECT * FROM spans WHERE parent IS NOT NULL), l AS (SELECT *, max(end_ns) OVER (PARTITION BY flow, parent ORDER BY start_ns, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM k),
c AS (SELECT *, sum(CASE WHEN latest IS NULL OR start_ns >= latest THEN 1 ELSE 0 END) OVER (PARTITION BY flow, parent ORDER BY start_ns, id) AS component,
 sum(CASE WHEN latest IS NULL OR start_ns - latest > 100000000 THEN 1 ELSE 0 END) OVER (PARTITION BY flow, parent ORDER BY start_ns, id) AS block FROM l)"""


@register("concurrency_groups", "WITH " + GROUPS + """, b AS (SELECT flow, parent, block, count(*) AS n, count(DISTINCT component) AS k FROM c GROUP BY ALL)
SELECT c.flow, c.id, c.component::BIGINT AS component, c.block::BIGINT AS block, CASE WHEN b.k > 1 THEN 'unordered' WHEN b.n > 1 THEN 'concurrent' ELSE 'sequential' END AS kind FROM c JOIN b USING (flow, parent, block)""")
def concurrency_groups(spark, sf):
    return T.post_hoc_groups(B.spans(spark, sf).where("parent IS NOT NULL")).select("flow", "id", "component", "block", "kind")


@register("loop_collapse", "WITH " + B.SPANS_SQL + """, m AS (SELECT *, CASE WHEN lag(op) OVER w IS NULL OR lag(op) OVER w <> op THEN 1 ELSE 0 END AS begins FROM spans WINDOW w AS (PARTITION BY flow ORDER BY start_ns, id)),
r AS (SELECT *, sum(begins) OVER (PARTITION BY flow ORDER BY start_ns, id) AS run FROM m) SELECT flow, run::BIGINT AS run, op, count(*) AS n, CASE WHEN count(*) > 1 THEN '1..*' ELSE '1' END AS multiplicity FROM r GROUP BY flow, run, op""")
def loop_collapse(spark, sf):
    return T.collapse_loops(B.spans(spark, sf), ["flow"], ["start_ns", "id"], "op")


@register("effect_gate", """WITH o AS (SELECT user_id::VARCHAR AS flow, event_type AS op FROM events WHERE ts >= TIMESTAMP '2024-01-20'), g AS (SELECT user_id::VARCHAR AS flow, event_type AS op FROM events WHERE ts < TIMESTAMP '2024-01-06' AND user_id % 10 <> 0),
f AS (SELECT DISTINCT flow FROM o UNION SELECT DISTINCT flow FROM g)
SELECT flow, CASE WHEN flow NOT IN (SELECT flow FROM o) OR flow NOT IN (SELECT flow FROM g) THEN NULL ELSE coalesce((SELECT string_agg(op, ',' ORDER BY op) FROM (SELECT op FROM o WHERE o.flow = f.flow EXCEPT SELECT op FROM g WHERE g.flow = f.flow)), '') END AS added,
 CASE WHEN flow NOT IN (SELECT flow FROM o) OR flow NOT IN (SELECT flow FROM g) THEN NULL ELSE coalesce((SELECT string_agg(op, ',' ORDER BY op) FROM (SELECT op FROM g WHERE g.flow = f.flow EXCEPT SELECT op FROM o WHERE o.flow = f.flow)), '') END AS missing,
 CASE WHEN flow NOT IN (SELECT flow FROM o) THEN 'skipped' WHEN flow NOT IN (SELECT flow FROM g) THEN 'ungated' WHEN EXISTS (SELECT op FROM o WHERE o.flow = f.flow EXCEPT SELECT op FROM g WHERE g.flow = f.flow) THEN 'fail' ELSE 'pass' END AS verdict FROM f""")
def effect_gate(spark, sf):
    return _gate(spark, sf, "user_id % 10 <> 0")


@register("effect_gate_all")
def effect_gate_all(spark, sf):
    """Golden effects of all users: ungated are those without early events. Without an oracle."""
    return _gate(spark, sf, "true")


def _gate(spark, sf, golden):
    e = B.t(spark, sf, "events").select(F.col("user_id").cast("string").alias("flow"), F.col("event_type").alias("op"), "ts", "user_id")
    return T.effect_gate(e.where("ts < TIMESTAMP '2024-01-06'").where(golden), e.where("ts >= TIMESTAMP '2024-01-20'"))


@register("coverage_delta", "WITH " + B.BUS_SQL + " SELECT DISTINCT event FROM bus WHERE op = 'PUBLISH' AND event <> '<dynamic>' AND event NOT IN (SELECT event FROM bus WHERE op = 'CONSUME' AND event NOT LIKE '%.1%')")
def coverage_delta(spark, sf):
    b = _named(spark, sf)
    return b.where("op = 'PUBLISH'").select("event").distinct().join(b.where("op = 'CONSUME' AND event NOT LIKE '%.1%'").select("event"), "event", "left_anti")


SIDES = """e AS (SELECT *, dense_rank() OVER (ORDER BY ts::DATE) AS d FROM events), o AS (SELECT user_id::VARCHAR AS key, event_type AS op, event_id AS pos FROM events WHERE ts < TIMESTAMP '2024-01-10'),
n AS (SELECT user_id::VARCHAR AS key, event_type AS op, event_id AS pos FROM events WHERE ts >= TIMESTAMP '2024-01-20')"""


def _sides(spark, sf):
    e = B.t(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("op"), F.col("event_id").alias("pos"), "ts")
    return e.where("ts < TIMESTAMP '2024-01-10'").drop("ts"), e.where("ts >= TIMESTAMP '2024-01-20'").drop("ts")


@register("trace_diff_match", "WITH " + SIDES + """, a AS (SELECT *, row_number() OVER (PARTITION BY key, op ORDER BY pos) AS k FROM o), b AS (SELECT *, row_number() OVER (PARTITION BY key, op ORDER BY pos) AS k FROM n)
SELECT key, op, k, coalesce(a.pos, -1) AS old_pos, coalesce(b.pos, -1) AS new_pos, CASE WHEN a.pos IS NULL THEN 'added' WHEN b.pos IS NULL THEN 'removed' ELSE 'matched' END AS change FROM a FULL OUTER JOIN b USING (key, op, k)""")
def trace_diff_match(spark, sf):
    return T.match_children(*_sides(spark, sf)).select(
        "key", "op", F.col("k").cast("long").alias("k"), F.coalesce("old_pos", F.lit(-1)).alias("old_pos"), F.coalesce("new_pos", F.lit(-1)).alias("new_pos"), "change")


@register("reorder_lis")
def reorder_lis(spark, sf):
    return T.reordered(T.match_children(*_sides(spark, sf)))


@register("url_template", r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '') AS path FROM pages)
SELECT page_id, array_to_string(list_transform(string_split(path, '/'), lambda s: CASE WHEN regexp_matches(s, '^([0-9]+|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9a-fA-F]{16,})$') THEN '{id}' ELSE s END), '/') AS template FROM p""")
def url_template(spark, sf):
    return B.t(spark, sf, "pages").select("page_id", L.url_template("url").alias("template"))


@register("redact", r"""SELECT event_id, CASE WHEN regexp_matches(v, '^[0-9]+$') THEN '<id>' ELSE v END AS value FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id::VARCHAR ELSE event_type END AS v FROM events)""")
def redact(spark, sf):
    v = F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(F.col("event_type"))
    return B.t(spark, sf, "events").select("event_id", L.redact(v).alias("value"))


@register("destination_normalize", "SELECT event_id, event_type||'.{id}-q.{id}' AS destination FROM events")
def destination_normalize(spark, sf):
    raw = F.concat("event_type", F.lit("."), F.col("user_id"), F.lit("-q."), F.col("event_id"))
    return B.t(spark, sf, "events").select("event_id", L.normalize_destination(raw).alias("destination"))


@register("op_key", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'PUBLISH '||event_type||'.{id}' WHEN 1 THEN 'DB pg SELECT '||event_type WHEN 2 THEN 'HTTP GET peer /u/{id}' ELSE event_type END AS op FROM events""")
def op_key(spark, sf):
    e = B.t(spark, sf, "events")
    m, lit, c = F.col("event_id") % 4, F.lit, F.concat
    attrs = (F.when(m == 0, F.create_map(lit("messaging.system"), lit("kafka"), lit("messaging.operation"), lit("send"), lit("messaging.destination"), c("event_type", lit("."), F.col("user_id"))))
             .when(m == 1, F.create_map(lit("db.system"), lit("pg"), lit("db.operation"), lit("select"), lit("db.table"), F.col("event_type")))
             .when(m == 2, F.create_map(lit("http.method"), lit("get"), lit("net.peer"), lit("peer"), lit("http.route"), c(lit("/u/"), F.col("user_id")))).otherwise(F.create_map(lit("x"), lit("y"))))
    return e.select("event_id", L.op_key(lit("client"), attrs, F.col("event_type")).alias("op"))


@register("sql_normalize", """SELECT l_orderkey * 10 + l_linenumber AS stmt_id, CASE l_returnflag WHEN 'N' THEN 'SELECT * FROM li WHERE k = ? AND q IN (?)' WHEN 'A' THEN 'UPDATE li SET price = ? WHERE k = ?' ELSE 'INSERT INTO li ( k , q ) VALUES (?)' END AS statement,
 CASE l_returnflag WHEN 'N' THEN 'SELECT' WHEN 'A' THEN 'UPDATE' ELSE 'INSERT' END AS op, 'li' AS "table" FROM lineitem""")
def sql_normalize(spark, sf):
    k, q, p = F.col("l_orderkey"), F.col("l_quantity"), F.col("l_extendedprice")
    raw = (F.when(F.col("l_returnflag") == "N", F.concat(F.lit("select * from LI where k = "), k, F.lit(" and q in ("), q, F.lit(", 'a''b', $1) -- tail")))
           .when(F.col("l_returnflag") == "A", F.concat(F.lit("update \"LI\" set price = "), p, F.lit(" /* a /* b */ c */ where k="), k))
           .otherwise(F.concat(F.lit("INSERT INTO li (k, q) VALUES ("), k, F.lit(", "), q, F.lit("), ("), k, F.lit(",1)"))))
    return B.t(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("stmt_id"), sql_normal_form(raw).alias("n")).select("stmt_id", "n.*")


@register("impeach_candidates", "WITH " + B.BUS_SQL + """, o AS (SELECT event, service, count(*) AS n FROM bus WHERE op = 'CONSUME' GROUP BY ALL), s AS (SELECT DISTINCT event FROM bus WHERE op = 'PUBLISH' AND event NOT LIKE 'click%'), b AS (SELECT DISTINCT event FROM bus WHERE event LIKE 'click.1%')
SELECT o.event, o.service, n, CASE WHEN event = '<dynamic>' THEN 'excluded-unnamed' WHEN event IN (SELECT event FROM s) THEN 'reachable' WHEN event IN (SELECT event FROM b) THEN 'excluded-blind' ELSE 'candidate' END AS outcome FROM o""")
def impeach_candidates(spark, sf):
    b = B.bus(spark, sf)
    o = b.where("op = 'CONSUME'").groupBy("event", "service").agg(F.count("*").alias("n"))
    named = b.where("op = 'PUBLISH' AND event NOT LIKE 'click%'").select("event", F.lit(1).alias("s")).distinct()
    blind = b.where("event LIKE 'click.1%'").select("event", F.lit(1).alias("b")).distinct()
    return o.join(named, "event", "left").join(blind, "event", "left").select("event", "service", "n", F.when(F.col("event") == "<dynamic>", "excluded-unnamed").when(F.col("s") == 1, "reachable").when(F.col("b") == 1, "excluded-blind").otherwise("candidate").alias("outcome"))


@register("annotation_grades", """WITH a AS (SELECT DISTINCT user_id AS site, CASE WHEN user_id % 3 = 0 THEN event_type END AS claim FROM events WHERE user_id < 60), w AS (SELECT user_id AS site, event_type AS effect FROM events WHERE ts < TIMESTAMP '2024-01-04' AND user_id % 4 <> 1)
SELECT a.site, a.claim, CASE WHEN count(w.effect) = 0 THEN 'unwitnessed' WHEN a.claim IS NULL THEN 'witnessed' WHEN bool_or(w.effect = a.claim) THEN 'confirmed' ELSE 'unconfirmed' END AS grade FROM a LEFT JOIN w USING (site) GROUP BY a.site, a.claim""")
def annotation_grades(spark, sf):
    return _grades(spark, sf, "user_id < 60", "user_id % 4 <> 1")


@register("annotation_grades_all")
def annotation_grades_all(spark, sf):
    """Sites of all users, witnessed by all early events. Without an oracle."""
    return _grades(spark, sf, "true", "true")


def _grades(spark, sf, sites, witnesses):
    e = B.t(spark, sf, "events")
    a = e.where(sites).select(F.col("user_id").alias("site"), F.when(F.col("user_id") % 3 == 0, F.col("event_type")).alias("claim")).distinct()
    w = e.where("ts < TIMESTAMP '2024-01-04'").where(witnesses).select(F.col("user_id").alias("site"), F.col("event_type").alias("effect"))
    g = a.join(w, "site", "left").groupBy("site", "claim").agg(F.count("effect").alias("n"), F.bool_or(F.col("effect") == F.col("claim")).alias("same"))
    return g.select("site", "claim", F.when(F.col("n") == 0, "unwitnessed").when(F.col("claim").isNull(), "witnessed").when(F.col("same"), "confirmed").otherwise("unconfirmed").alias("grade"))


@register("schema_replay", """WITH m AS (SELECT o_custkey % 50 AS tbl, o_orderdate AS ver, o_orderkey AS pos, o_orderstatus <> 'F' AS creates FROM orders) SELECT 't'||tbl AS tbl, arg_max(creates, ver::VARCHAR||lpad(pos::VARCHAR, 12, '0')) AS alive FROM m GROUP BY tbl""")
def schema_replay(spark, sf):
    """The last CREATE or DROP of each table in replay order decides."""
    m = B.t(spark, sf, "orders").select(F.concat(F.lit("t"), F.col("o_custkey") % 50).alias("tbl"), "o_orderdate", "o_orderkey", (F.col("o_orderstatus") != "F").alias("creates"))
    return m.groupBy("tbl").agg(F.max_by("creates", F.struct("o_orderdate", "o_orderkey")).alias("alive"))


@register("schema_drift", """WITH w AS (SELECT DISTINCT 't'||(l_partkey % 80) AS tbl, CASE l_returnflag WHEN 'N' THEN 'INSERT' WHEN 'A' THEN 'UPDATE' ELSE 'SELECT' END AS op FROM lineitem), alive AS (SELECT DISTINCT 't'||(o_custkey % 50) AS tbl FROM orders)
SELECT 'missing' AS finding, tbl FROM (SELECT DISTINCT tbl FROM w WHERE op <> 'SELECT') WHERE tbl NOT IN (SELECT tbl FROM alive) AND tbl <> 't77' UNION ALL SELECT 'unwritten', tbl FROM alive WHERE tbl NOT IN (SELECT tbl FROM w WHERE op <> 'SELECT')""")
def schema_drift(spark, sf):
    w = B.t(spark, sf, "lineitem").where("l_returnflag IN ('N', 'A')").select(F.concat(F.lit("t"), F.col("l_partkey") % 80).alias("tbl")).distinct()
    alive = B.t(spark, sf, "orders").select(F.concat(F.lit("t"), F.col("o_custkey") % 50).alias("tbl")).distinct()
    return w.join(alive, "tbl", "left_anti").where("tbl <> 't77'").select(F.lit("missing").alias("finding"), "tbl").unionByName(alive.join(w, "tbl", "left_anti").select(F.lit("unwritten").alias("finding"), "tbl"))


@register("transcript_summary", """WITH c AS (SELECT conv_id AS session, turn, role AS tool, length(text) % 3 = 0 AS err FROM conversations), l AS (SELECT *, lag(tool) OVER w AS prev, lag(err) OVER (PARTITION BY session, tool ORDER BY turn) AS prev_err FROM c WINDOW w AS (PARTITION BY session ORDER BY turn))
SELECT session, count(*) AS calls, count(*) FILTER (WHERE err) AS errors, count(*) FILTER (WHERE prev IS NOT NULL AND prev <> tool) AS hops, count(*) FILTER (WHERE NOT err AND prev_err) AS corrections FROM l GROUP BY session""")
def transcript_summary(spark, sf):
    c = B.t(spark, sf, "conversations").select(F.col("conv_id").alias("session"), "turn", F.col("role").alias("tool"), (F.length("text") % 3 == 0).alias("err"))
    w, own = Window.partitionBy("session").orderBy("turn"), Window.partitionBy("session", "tool").orderBy("turn")
    c = c.withColumn("prev", F.lag("tool").over(w)).withColumn("prev_err", F.lag("err").over(own))
    return c.groupBy("session").agg(F.count("*").alias("calls"), F.count_if("err").alias("errors"), F.count_if(F.col("prev") != F.col("tool")).alias("hops"), F.count_if(~F.col("err") & F.col("prev_err")).alias("corrections"))


@register("corpus_digest", """WITH s AS (SELECT conv_id, sha256(string_agg(role||':'||text, '|' ORDER BY turn)) AS h FROM conversations GROUP BY conv_id) SELECT count(DISTINCT h) AS n, sha256(string_agg(DISTINCT h, ',' ORDER BY h)) AS digest FROM s""")
def corpus_digest(spark, sf):
    """Order-free digest of all conversations; digests of sixteen hex ranges are folded, not one list of all."""
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "|")
    h = B.t(spark, sf, "conversations").groupBy("conv_id").agg(F.sha2(one, 256).alias("h")).select("h").distinct()
    return h.agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("digest"))


@register("tier_classify", """SELECT event_id, CASE WHEN event_type IN ('purchase','signup') THEN 1 WHEN value > 50 THEN 2 ELSE 3 END AS tier FROM events""")
def tier_classify(spark, sf):
    return B.t(spark, sf, "events").select("event_id", F.when(F.col("event_type").isin("purchase", "signup"), 1).when(F.col("value") > 50, 2).otherwise(3).alias("tier"))


@register("route_resolve", """SELECT page_id FROM pages WHERE regexp_matches(url, '^[a-z]+://[^/]+/[a-z]+/[0-9]+([?#].*)?$') AND regexp_matches(url, '/(en)/')""")
def route_resolve(spark, sf):
    path = L.url_template("url")
    two = F.size(F.filter(F.split(path, "/"), lambda s: s != "")) == 2
    return B.t(spark, sf, "pages").where(two & path.endswith("/{id}") & L.route_match(F.concat(F.lit("GET "), path), F.lit("get /en/{n}"))).select("page_id")
