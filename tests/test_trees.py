import json

from meshwright.operators import trees as T
from meshwright.sources.documents import read_trace
from meshwright.streaming import flows
from pyspark.sql import functions as F

MS = 1_000_000
SPAN = "flow string, id string, parent string, name string, kind string, status string, attrs map<string,string>, start_ns long, end_ns long"


def sp(i, parent, name, start, end, kind="internal", **attrs):
    return ("f", i, parent, name, kind, "", {k.replace("__", "."): v for k, v in attrs.items()}, start * MS, end * MS)


def test_canonical_tree(spark):
    db = {"db__system": "pg", "db__operation": "insert", "db__sql__table": "t"}
    rows = [sp("r", None, "GET", 0, 9000, "server", http__method="get", http__route="/x/1")]
    rows += [sp(f"l{k}", "r", "w", 1000 + 500 * k, 1100 + 500 * k, "client", **db) for k in range(3)]  # a loop: neighbours fold
    rows += [sp("p1", "r", "a", 4000, 4500, "client", **db), sp("p2", "r", "b", 4100, 4600, "client", peer__service="pay", http__method="post", url__path="/y"), sp("p3", "r", "c", 4200, 4300, "client", **db)]
    rows += [sp("h", "r", "helper", 6000, 7000), sp("hc", "h", "q", 6100, 6200, "producer", messaging__destination="e")]
    lost = [sp("x", "y", "a", 0, 1), sp("y", "x", "b", 0, 1)]
    spans = spark.createDataFrame(rows + lost, SPAN)
    d = T.described(spans)
    assert {r["id"]: (r["op"], r["tier"]) for r in d.collect()}["p2"] == ("HTTP POST pay /y", 1)
    assert [tuple(r) for r in T.unaccounted(spans).collect()] == [("f", 2, 0)]
    c = T.contract(d, most_tier=2)
    assert {r["id"]: r["parent"] for r in c.collect()}["hc"] == "r" and "h" not in {r["id"] for r in c.collect()}
    got = {r["id"]: (r["grp"], r["kind_of_group"], r["multiplicity"]) for r in T.canonical(c).collect()}
    assert got["l0"][1:] == ("sequential", "1..*") and not {"l1", "l2", "x"} & got.keys()
    assert got["p1"][1:] == ("concurrent", "1..*") and got["p2"][1:] == ("concurrent", "1") and "p3" not in got and got["hc"][1] == "sequential"
    late = spark.createDataFrame([(*r[:7], r[7] + 10**12, r[8] + 10**12) for r in rows], SPAN)
    one, two = ({r["sig"] for r in T.canonical(T.contract(T.described(x), 2)).where("depth = 0").collect()} for x in (spans.where("id <> 'x' AND id <> 'y'"), late))
    assert one == two  # times and ids leave no trace


def put(tmp_path, name, root):
    p = tmp_path / name
    p.mkdir()
    (p / "t.json").write_text(json.dumps({"flow": "f", "service": "s", "root": root}))
    return str(p)


def test_trace_diff(spark, tmp_path):
    seq = lambda *xs: [{"members": [x]} for x in xs]
    old = {"op": "HTTP GET /", "kind": "server", "tier": 1, "status": "ok", "children": seq({"op": "a", "tier": 2}, {"op": "b", "tier": 2, "children": seq({"op": "DB pg INSERT t", "tier": 1})}, {"op": "c", "attrs": {"k": "1"}})}
    new = {"op": "HTTP GET /", "kind": "server", "tier": 1, "status": "error", "children": [*seq({"op": "b", "tier": 2, "children": [{"concurrent": True, "multiplicity": "1..*", "members": [{"op": "DB pg INSERT t", "tier": 1}, {"op": "PUBLISH e", "tier": 1}]}]}, {"op": "a", "tier": 2}, {"op": "c", "attrs": {"k": "2"}})]}
    a, b = read_trace(spark, put(tmp_path, "old", old)), read_trace(spark, put(tmp_path, "new", new))
    got = {(r["path"], r["change"], r["field"], r["old"], r["new"], r["priority"]) for r in T.trace_diff(a, b).collect()}
    assert ("", "field", "status", "ok", "error", "contract") in got and ("2.0", "attr", "k", "1", "2", "lower") in got
    assert ("0.0.0.1", "added", "op", "", "PUBLISH e", "contract") in got and ("0.0.0.0", "cardinality", "", "1", "1..*", "tier1") in got
    assert ("0.0.0.0", "ordering", "", "sequential", "concurrent", "tier1") in got and sum(r[1] == "reordered" for r in got) == 1
    assert T.trace_diff(a, a).count() == 0
    eff = T.effects_of(b).first()
    assert eff["effects"] == ["DB pg INSERT t", "PUBLISH e"] and T.expect_once(b, "a").first()["ok"] and not T.expect_once(b, "PUBLISH e").first()["ok"] and not T.expect_once(b, "zz").first()["ok"]
    goldens = spark.createDataFrame([("f", "s", ["DB pg INSERT t"]), ("g", "s", ["x"]), ("h", "s", ["x"])], "flow string, service string, effects array<string>")
    seen = T.effects_of(b).withColumn("synthesized", F.lit(False)).unionByName(spark.createDataFrame([("h", "s", ["y"], True), ("n", "s", ["y"], False)], "flow string, service string, effects array<string>, synthesized boolean"))
    assert {(r["flow"], r["verdict"]) for r in T.gate_goldens(goldens, seen).collect()} == {("f", "fail"), ("g", "skipped"), ("h", "skipped"), ("n", "ungated")}
    assert T.agreed(goldens, "service") == "s" and T.agreed(goldens, "flow") is None


def test_streamed_flows(spark, tmp_path):
    schema = "flow string, service string, id long, parent long, status string, start_ns long, attrs map<string,string>"
    s = 10**9
    rows = [("f", "a", 1, None, "ok", 0, {"m": "1"}), ("f", "a", 2, 1, "error", 3 * s, {}), ("g", "a", 3, None, "ok", 5 * s, {}), ("g", "a", 4, None, "ok", 6 * s, {}), ("f", "a", 5, None, "ok", 60 * s, {}), ("z", "b", 9, None, "ok", 500 * s, {})]
    for k, part in enumerate((rows[:3], rows[3:5], rows[5:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in{k}")
    flows_in = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in*")
    q = flows.complete_flows(flows_in, "10 seconds", "20 seconds").writeStream.format("memory").queryName("flows_done").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    done = {(r["flow"], r["n_spans"], r["n_heads"], r["n_errors"], r["synthesized"]) for r in spark.sql("SELECT * FROM flows_done").collect()}
    assert done == {("f", 2, 1, 1, False), ("g", 2, 2, 0, True), ("f", 1, 1, 0, False)}  # the newest flow is still open
    batch = spark.createDataFrame(rows, schema)
    assert {(r["flow"], r["n_spans"]) for r in flows.whole_flows(batch).collect()} == {("f", 2), ("f", 1), ("g", 2), ("z", 1)}
    assert flows.marker_coverage(batch, "m").agg(F.sum("n_marked")).first()[0] == 1
    assert flows.stale(flows.complete_flows(batch), "5 minutes").where("stale").count() == 3
