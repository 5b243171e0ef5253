from meshwright.functions import labels as L
from meshwright.functions import sqlnorm
from meshwright.functions.sqlnorm import normalize
from meshwright.operators import deltas, rules
from meshwright.operators.graph import GraphIndex, bind, closure, guarded_closure
from meshwright.operators.traces import kept_by_lis, post_hoc_groups, stitch
from pyspark.sql import functions as F


def graph(spark):
    nodes = spark.createDataFrame([(f"a/p.{x}", 1) for x in "ABCDS"], "fqn string, tier int")
    edges = [("A", "B"), ("B", "C"), ("C", "B"), ("A", "B"), ("S", "S"), ("C", "gone")]
    rows = [(f"a/p.{s}", f"a/p.{d}", False) for s, d in edges] + [("a/p.C", "boundary:db INSERT t", True), ("a/p.D", "boundary:bus PUBLISH <dynamic>", False)]
    return GraphIndex(nodes, spark.createDataFrame(rows, "src string, dst string, concurrent boolean"), spark.createDataFrame([("a/p", "Reflect", "d")], "site string, kind string, detail string"))


def test_roots_and_closure(spark):
    ix = graph(spark)
    assert {r[0] for r in ix.roots().collect()} == {"a/p.A", "a/p.D"}  # a self-call disqualifies S
    seeds = spark.createDataFrame([("a/p.B",), ("a/p.A",)], "seed string")
    got = {(r["seed"][-1], r["node"][-1]) for r in closure(seeds, ix.internal).collect()}
    assert got == {("B", "C"), ("B", "B"), ("A", "B"), ("A", "C")}  # B returns on its cycle, A does not
    way = spark.createDataFrame([("a/p.C",)], "fqn string")
    assert {(r["seed"][-1], r["node"][-1]) for r in guarded_closure(seeds, ix.internal, way).collect()} == {("A", "B")}


def test_blind_by_package(spark):
    ix = graph(spark)
    cone = ix.cone(spark.createDataFrame([("a/p.A",)], "seed string"))
    assert ix.blind(cone).count() == 1


def test_labels(spark):
    row = spark.range(1).select(
        L.match_prefix(F.lit("a/p.X"), F.lit("a/p")).alias("m1"), L.match_prefix(F.lit("a/pq"), F.lit("a/p")).alias("m2"),
        L.pkg_of(F.lit("(*x/y/svc.T).M")).alias("pkg"), L.short_name(F.lit("(*x/y/svc.T).M")).alias("short"),
        L.is_write(F.lit("boundary:db INSERT t")).alias("w1"), L.is_write(F.lit("boundary:bus CONSUME e")).alias("w2"), L.is_write(F.lit("boundary:pay POST /x")).alias("w3"),
        L.route_match(F.lit("GET /v1/users/{id}"), F.lit("/users/7")).alias("r1"), L.route_match(F.lit("POST /a"), F.lit("GET /a")).alias("r2"),
        L.url_template(F.lit("http://h/x/123/é?q=1#f")).alias("u"), L.slug(F.lit("Post /Loan!")).alias("s")).first()
    assert row.asDict() == {"m1": True, "m2": False, "pkg": "x/y/svc", "short": "svc.T.M", "w1": True, "w2": False, "w3": True, "r1": True, "r2": False, "u": "/x/{id}/é", "s": "post_loan"}


def test_bind_equals_prefix_match(spark):
    names = spark.createDataFrame([(x,) for x in ("a/p", "a/p.X", "a/pq", "a", "b/é.x")], "name string")
    pats = spark.createDataFrame([(x,) for x in ("a/p", "a", "b/é")], "pattern string")
    equi = {tuple(r) for r in bind(names, pats).select("name", "pattern").collect()}
    loop = {tuple(r) for r in names.crossJoin(pats).where(L.match_prefix("name", "pattern")).collect()}
    assert equi == loop and ("a/pq", "a/p") not in equi


def test_sql_normal_form():
    want = {
        "select a from \"T\" where x = 'it''s' and y in (1,2, $3) -- c": ("SELECT a FROM t WHERE x = ? AND y IN (?)", "SELECT", "t"),
        "/* a /* b */ secret */ UPDATE only s.t SET x=1": ("UPDATE only s . t SET x = ?", "UPDATE", "s"),
        "insert into t values (1,2),(3,4)": ("INSERT INTO t VALUES (?)", "INSERT", "t"),
        "SELECT coalesce(a, 1), coalesce(?, ?, 2) FROM x": ("SELECT coalesce ( a , ? ) , coalesce ( ? , ? , ? ) FROM x", "SELECT", "x"),
        "select * from \"order\" where b like 'x' and c between .5 and 1.5e3": ('SELECT * FROM "order" WHERE b like ? AND c between ? AND ? e3', "SELECT", "order"),
        "DELETE FROM `a``b` WHERE n = $$x ' y$$ AND m = $t$ z $t$": ('DELETE FROM "a`b" WHERE n = ? AND m = ?', "DELETE", "a`b"),
        "select 'open": ("SELECT ?", "SELECT", ""), "a$b$c": ("a ? ?", "a", ""), "COMMIT": ("commit", "commit", ""),
        "merge into acct using src on 1=1": ("MERGE INTO acct USING src ON ? = ?", "MERGE", "acct"), "x'41' 5--3\n+1": ("x ? ? + ?", "x", ""),
    }
    for raw, out in want.items():
        assert normalize(raw) == out, raw
        assert normalize(out[0])[0] == out[0] or "$" in raw or "`" in raw
        assert sqlnorm._scan(raw) == out  # blanking ahead changes nothing
    assert normalize(None) == ("", "", "")


def test_diff_laws(spark):
    a = spark.createDataFrame([("x", "y"), ("x", "z")], "src string, dst string")
    b = spark.createDataFrame([("x", "y"), ("q", "z")], "src string, dst string")
    assert deltas.set_diff(a, a).isEmpty()
    flip = {"+": "-", "-": "+"}
    assert {tuple(r) for r in deltas.set_diff(a, b).collect()} == {(flip[r[0]], *r[1:]) for r in deltas.set_diff(b, a).collect()}


def test_rules_inert_and_unbindable(spark):
    r = spark.createDataFrame([("i", ["zz"], ["a/p.B"], False), ("u", ["a/p.A"], ["zz"], True), ("h", ["a/p.A"], ["db INSERT"], False)], "rule string, from array<string>, to array<string>, require_proof boolean")
    got = {x["rule"]: x["verdict"] for x in rules.must_not_reach(graph(spark), r).collect()}
    assert got == {"i": "INERT", "u": "UNBINDABLE", "h": "REACHABLE"}


def test_traces(spark):
    s = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (9, None)], "id long, parent long")
    assert {tuple(r) for r in stitch(s).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (9, 9)}
    g = 10**9
    k = spark.createDataFrame([("f", 0, 1, 0, 5 * g), ("f", 0, 2, g, 2 * g), ("f", 0, 3, 9 * g, 9 * g + 1), ("f", 0, 4, 9 * g + 2, 10 * g)], "flow string, parent long, id long, start_ns long, end_ns long")
    assert {r["id"]: (r["block"], r["kind"]) for r in post_hoc_groups(k).collect()} == {1: (1, "concurrent"), 2: (1, "concurrent"), 3: (2, "unordered"), 4: (2, "unordered")}
    assert kept_by_lis([2, 0, 1, 3]) == [False, True, True, True] and kept_by_lis([]) == []


def test_small_and_large_walks_agree(spark, monkeypatch):
    import random

    from meshwright.operators import graph as G

    rnd = random.Random(3)
    names = [f"n{k}" for k in range(40)]
    edges = spark.createDataFrame([(rnd.choice(names), rnd.choice(names)) for _ in range(70)], "src string, dst string")
    seeds = spark.createDataFrame([("a", "n1"), ("a", "n2"), ("b", "n3")], "seed string, node string")
    heads = spark.createDataFrame([("n1",), ("n5",)], "seed string")

    def answers():
        return ({tuple(r) for r in G.closure(seeds, edges).collect()}, {tuple(r) for r in G.closure(heads, edges, 2).collect()}, {(r["seed"], r["node"], tuple(r["path"])) for r in G.shortest_paths(heads, edges).collect()})

    small = answers()
    monkeypatch.setattr(G, "SMALL_EDGES", -1)
    assert answers() == small and len(small[0]) > 20


def test_stitching_ends_on_circles(spark):
    s = spark.createDataFrame([(1, None), (2, 1), (7, 8), (8, 9), (9, 7)], "id long, parent long")
    got = {r["id"]: r["root"] for r in stitch(s).collect()}
    assert got[1] == got[2] == 1 and {got[7], got[8], got[9]} <= {7, 8, 9}
