import copy

import pytest
from meshwright.operators import policy as P
from meshwright.operators.graph import GraphIndex
from pyspark.sql import functions as F

EDGES = [("a/api.H", "a/svc.S"), ("a/svc.S", "a/db.W"), ("a/api.R", "a/util.U"), ("a/util.U", "a/db.Q"), ("a/api.H", "a/db.Q"), ("a/api.G", "a/svc.Go")]
EFFECTS = [("a/db.W", "db INSERT t", False), ("a/db.Q", "db SELECT t", False), ("a/svc.Go", "bus PUBLISH <dynamic>", True), ("a/db.Q", "db BeginTx", False), ("a/svc.S", "cache Put", False)]
POLICY = {
    "service": "s", "version": 1, "layers": [{"name": "api", "packages": ["a/api"]}, {"name": "svc", "packages": ["a/svc"]}, {"name": "db", "packages": ["a/db"]}],
    "layering": {"allow": [{"from": "a/api.H", "to": ""}, {"from": "zz", "to": ""}], "roots": []},
    "must_not_reach": [{"name": "ro", "from": ["a/api.R"], "to": ["db INSERT"], "require_proof": True}, {"name": "w", "from": ["entrypoint:*"], "to": ["db INSERT"]}, {"name": "g", "from": ["a/api.G"], "to": ["db INSERT"]}],
    "must_pass_through": [{"name": "via", "from": ["a/api.H"], "to": ["a/db"], "through": ["a/svc"], "allow": []}, {"name": "safe", "from": ["a/api.G"], "to": ["db INSERT"], "through": ["a/svc.S"], "require_proof": True}],
    "no_concurrent_reach": [{"name": "c", "to": ["bus PUBLISH"]}, {"name": "n", "to": ["db INSERT"]}, {"name": "u", "to": ["nope"]}],
    "io_budget": {"max_writes_per_route": 0}, "effect_ratchet": {"gate": True, "allow": [{"target": "db INSERT"}, {"target": "db DELETE"}]}}


def graph(spark, edges=EDGES, effects=EFFECTS, spots=()):
    names = sorted({x for e in edges for x in e} | {e[0] for e in effects})
    rows = [(s, d, False) for s, d in edges] + [(s, "boundary:" + d, c) for s, d, c in effects]
    return GraphIndex(
        spark.createDataFrame([(n, 1) for n in names], "fqn string, tier int"), spark.createDataFrame(rows, "src string, dst string, concurrent boolean"),
        spark.createDataFrame(list(spots), "site string, kind string, detail string"))


def test_suite(spark):
    rows = P.suite(graph(spark), POLICY).collect()
    got = {(r["rule"], r["name"], r["severity"], r["from"], r["to"], r["detail"]) for r in rows}
    assert ("layering", "layering", "violation", "a/api.R", "a/db.Q", "") in got  # through the helper without a layer
    assert not any(r[0] == "layering" and r[3] == "a/api.H" for r in got)  # excused
    assert ("must_not_reach", "w", "violation", "a/api.H", "db INSERT t", "") in got
    assert not any(r[1] == "ro" for r in got) and any(r[:3] == ("must_not_reach", "g", "caution") for r in got)
    assert ("must_pass_through", "via", "violation", "a/api.H", "a/db.Q", "a/api.H > a/db.Q") in got and not any(r[1] == "via" and r[4] == "a/db.W" for r in got)
    assert any(r[:3] == ("must_pass_through", "safe", "violation") and r[4] == "" for r in got)  # blind under proof
    assert ("no_concurrent_reach", "c", "violation", "a/svc.Go", "bus PUBLISH <dynamic>", "") in got
    assert any(r[:3] == ("no_concurrent_reach", "n", "caution") for r in got) and any(r[:3] == ("no_concurrent_reach", "u", "caution") for r in got)
    assert {r[3] for r in got if r[:3] == ("io_budget", "io_budget", "violation")} == {"a/api.H", "a/api.G"}
    assert any(r[0] == "ratchet" for r in got) and sum(r["rule"] == "io_budget" and r["severity"] == "caution" for r in rows) == 2


def test_obligations(spark):
    rows = [("r1", "VIOLATED", "f", "s", "d"), ("r2", "SATISFIED", "f", "s", None), ("r3", "CANT-PROVE", None, None, None), ("r4", "odd", None, None, None)]
    got = P.obligation_findings(spark.createDataFrame(rows, "rule string, status string, fn string, site string, detail string"))
    assert {(r["name"], r["severity"]) for r in got.collect()} == {("r1", "violation"), ("r3", "caution"), ("r4", "caution")}


def test_exceptions(spark):
    live = {(r["section"], r["from"], r["to"]): r["live"] for r in P.exceptions_audit(graph(spark), POLICY).collect()}
    assert live == {("layering", "a/api.H", ""): True, ("layering", "zz", ""): False, ("effect_ratchet", "", "db INSERT"): True, ("effect_ratchet", "", "db DELETE"): False}


def test_review_and_gate(spark):
    base = graph(spark)
    same = P.review(POLICY, base, graph(spark))
    assert same["verdict"] == "NO-STRUCTURAL-SIGNAL" and P.verify_artifact(same, same) == "AUTHENTIC" and P.gate(POLICY, same)["pass"]
    more = graph(spark, [*EDGES, ("a/api.R", "a/svc.N")], [*EFFECTS, ("a/svc.N", "db UPDATE z", False)], [("a/svc.N", "Reflect", "d")])
    entry = lambda names: spark.createDataFrame([("http", n, "f") for n in names], "kind string, name string, fn string")
    out = P.review(POLICY, base, more, (entry(["GET /a", "GET /b"]), entry(["GET /a"])))
    assert out["verdict"] == "BLOCK" and out["new_write_targets"] == ["db UPDATE z"] and out["new_blind_spots"] == [{"kind": "Reflect", "site": "a/svc.N"}]
    assert [c for c in out["contract_changes"] if c["breaking"]] == [{"op": "-", "surface": "entrypoint http", "name": "GET /b", "breaking": True}]
    why = P.gate(POLICY, out, ["a/api"])
    assert not why["pass"] and "out of scope: a/svc" in why["reasons"] and "new write: db UPDATE z" in why["reasons"] and not any("blind spot" in w for w in why["reasons"])
    assert P.verify_artifact(out | {"shape": "x"}, out) == "TAMPERED" and P.verify_artifact(same, out) == "STALE"
    with pytest.raises(ValueError):
        P.verify_stamp("a", "b")
    P.verify_stamp("a", None)


def test_contract_documents(spark):
    from meshwright.sources.shapes import CONTRACT

    def doc(**kw):
        return spark.createDataFrame([tuple(kw.get(f.name) for f in CONTRACT)], CONTRACT)

    a = doc(service="s", entrypoints=([("GET", "/x", 1)], [("e", 1)]), published=[("p", 1)], external_dependencies=[("pay", "http", ["POST /a"], 1), ("old", "rpc", [], 1)])
    b = doc(service="s", entrypoints=([("GET", "/y", 1)], [("e", 1)]), external_dependencies=[("pay", "http", ["POST /b"], 1)])
    got = {tuple(r) for r in P.compare_contracts(a, b).collect()}
    assert got == {("-", "http", "GET /x", True), ("+", "http", "GET /y", False), ("-", "publish", "p", True), ("~", "dependency", "http pay", False), ("-", "dependency", "rpc old", False)}
    with pytest.raises(ValueError):
        P.compare_contracts(a, doc(service="t"))


def test_proposal_holds(spark):
    ix = graph(spark, effects=[e for e in EFFECTS if "dynamic" not in e[1]])
    policy, notes = P.propose(ix, "s")
    assert P.suite(ix, policy).where("severity = 'violation'").count() == 0 and policy["io_budget"] == {"max_writes_per_route": 1}
    assert policy["must_not_reach"][0]["from"] == ["a/api.G", "a/api.R"] and policy["must_pass_through"][0]["through"] == ["a/svc.S"] and policy["no_concurrent_reach"]
    circle = graph(spark, [*EDGES, ("a/db.Q", "a/api.R")])
    assert any("circle" in n for n in P.propose(circle, "s")[1])
    assert copy.deepcopy(policy) and F is not None
