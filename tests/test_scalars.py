import pytest
from meshwright.functions import labels as L
from meshwright.functions import spans as S
from meshwright.functions import symbols as Y
from pyspark.sql import functions as F


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first().asDict(recursive=True)


def attrs(**kv):
    return F.create_map(*(F.lit(x) for k, v in kv.items() for x in (k.replace("__", "."), v))) if kv else F.create_map().cast("map<string,string>")


@pytest.mark.parametrize("kind, kv, name, op, peer", [
    ("producer", {"messaging__destination": "q-123-x", "messaging__system": "sqs"}, "n", "PUBLISH q-{id}-x", "SQS"),
    ("client", {"messaging__destination__name": "t", "messaging__operation__type": "ack"}, "n", "SETTLE t", "Bus"),
    ("internal", {"messaging__destination": "t", "messaging__operation": "receive", "messaging__system": "nats"}, "n", "CONSUME t", "nats"),
    ("server", {"http__method": "get", "http__target": "/a/12?x=1"}, "n", "HTTP GET /a/{id}", ""),
    ("client", {"http__request__method": "post", "url__full": "https://h/v/7", "peer__service": "pay"}, "n", "HTTP POST pay /v/{id}", "pay"),
    ("client", {"rpc__service": "S", "rpc__method": "M"}, "n", "RPC S/M", "S"),
    ("client", {"rpc__system": "grpc", "rpc__method": "S/M"}, "n", "RPC S/M", "S"),
    ("client", {"db__system": "pg", "db__statement": "insert into Loans values (1)", "db__namespace": "main"}, "n", "DB pg INSERT loans", "pg/main"),
    ("internal", {"db__system": "pg", "db__operation": "select", "db__sql__table": "T"}, "n", "DB pg SELECT t", "pg"),
    ("internal", {}, "step", "step", ""),
])
def test_operation_keys(spark, kind, kv, name, op, peer):
    got = one(spark, op=S.operation(F.lit(kind), attrs(**kv), F.lit(name)), peer=S.peer_of(F.lit(kind), attrs(**kv)))
    assert got == {"op": op, "peer": peer}


def test_span_features_and_tiers(spark):
    db = attrs(db__system="pg", db__operation="select")
    got = one(
        spark, a=S.features(F.lit("client"), db, F.lit("error")), b=S.features(F.lit("internal"), attrs(), F.lit("weird")),
        t1=S.classify(S.features(F.lit("client"), db, F.lit("")), F.lit("DB pg SELECT")), t2=S.classify(S.features(F.lit("producer"), attrs(), F.lit("")), F.lit("PUBLISH x"), {"PUB*": 4}),
        k1=S.observed_key(F.lit("client"), F.lit("DB pg INSERT a b")), k2=S.observed_key(F.lit("producer"), F.lit("PUBLISH e")), k3=S.observed_key(F.lit("client"), F.lit("HTTP GET /")),
        e=S.effective_kind(F.lit("internal"), attrs(messaging__destination="x")), p=S.parse_db_key(F.lit("DB pg")),
        m=S.project_attrs(attrs(db__statement="select 1", user__id="77", x="y"), ("user.id", "gone")), d=S.destination_name(F.lit("a.deadbeef1/b"), True), bd=S.bus_destination(F.lit("SETTLE q")))
    assert got["a"] == {"boundary": "outbound-sync", "effect": "read", "origin": "third-party", "fallible": True}
    assert got["b"] == {"boundary": "internal", "effect": "compute", "origin": "first-party", "fallible": False}
    assert got["t1"] == {"tier": 2, "rule": "ext-read"} and got["t2"] == {"tier": 4, "rule": "pin:PUB*"}
    assert (got["k1"], got["k2"], got["k3"]) == ("db INSERT a b", "PUBLISH e", None)
    assert got["e"] == "producer" and got["p"] == {"system": "pg", "operation": "", "table": ""}
    assert got["m"] == {"db.statement": "SELECT ?", "user.id": "<id>"} and got["d"] == "a.{id}/b" and got["bd"] == "q"


def test_symbols(spark):
    got = one(
        spark, a=Y.symbol_key(F.lit("(*x/y/svc.T).M")), b=Y.symbol_key(F.lit("x/y/svc.(*T).M")), c=Y.symbol_key(F.lit("x/y/svc.F")),
        d=Y.symbol_key(F.lit("x/y/svc.F.func1")), e=Y.symbol_key(F.lit("x/y/svc.F$1")), f=Y.symbol_key(F.lit("x/svc.init")), g=Y.symbol_key(F.lit("nope")), h=Y.symbol_key(F.lit("(x/y.v2.T).M")),
        p=Y.closure_parent(F.lit("a.F$12")), q=Y.closure_parent(F.lit("a.F$x")), band=F.array(*(Y.band(F.lit(x)) for x in ("a/testutil", "a/aws/x", "a/orderhandler", "a/repo", "a/di", "a/core"))),
        v=F.array(Y.migration_version(F.lit("V1.10__a.sql")), Y.migration_version(F.lit("V1.9__b.sql")), Y.migration_version(F.lit("x.sql"))),
        n=Y.ddl_name(F.lit(' "Public"."Loans" ')), go=Y.go_name(F.lit("get-user_by.id v2")), names=Y.generated_names(F.lit("X")), cap=Y.cap_list(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2),
        s1=Y.contract_surface(F.lit("boundary:bus PUBLISH a.b")), s2=Y.contract_surface(F.lit("boundary:pay POST /x")), s3=Y.contract_surface(F.lit("boundary:db INSERT t")),
        seam=F.array(*(Y.seam_class(F.lit(k), F.lit(pkg), ("otelsql",), ("statsy",)) for k, pkg in (("ExternalBoundaryCall", "x/otelsql"), ("ExternalBoundaryCall", "a/statsy"), ("ExternalBoundaryCall", "z"), ("HighFanOut", ""), ("Reflect", "")))),
        ext=F.array(Y.external_key(F.lit("http"), F.lit("pay"), F.lit("POST /x")), Y.external_key(F.lit("grpc"), F.lit(""), F.lit("S/M")), Y.external_key(F.lit("blob"), F.lit("b"), F.lit("put"))),
        un=F.array(*(L.unclassified_db(F.lit("boundary:db " + v)) for v in ("INSERT t", "SELECT t", "BeginTx", "SetMaxOpenConns", "Settle", "<dynamic>"))),
        ue=Y.unclassified_effect(F.lit("boundary:cache Do")), rv=F.array(Y.readable_verb(F.lit("db INSERT t")), Y.readable_verb(F.lit("db exec t"))), bin=Y.spot_bin(F.lit("Odd")), peer=Y.boundary_peer(F.lit("boundary:pay GET /")),
        mut=Y.reaches_mutating(F.array(F.lit("db SELECT t"), F.lit("bus PUBLISH e"))), ex=F.array(Y.exception_side(F.lit("a.b"), F.lit("")), Y.exception_side(F.lit("a.b"), F.lit("a")), Y.exception_side(F.lit("ab"), F.lit("a"))))
    same = {"pkg": "x/y/svc", "recv": "T", "ptr": True, "name": "M", "reason": None}
    assert got["a"] == got["b"] == same and got["c"]["name"] == "F" and got["c"]["recv"] == ""
    assert [got[k]["reason"] for k in "defgh"] == ["runtime closure", "synthetic", "package init", "malformed", "ambiguous value method"]
    assert got["p"] == "a.F" and got["q"] is None and got["band"] == ["tests", "provisioning", "transport", "storage", "infrastructure", "application"]
    assert got["v"] == [[1, 10], [1, 9], None] and got["n"] == "loans" and got["go"] == "GetUserByIdV2" and got["names"][4] == "NewXRequest" and got["cap"] == "a; b (+1 more)"
    assert got["s1"] == {"surface": "publish", "name": "a.b"} and got["s2"] == {"surface": "outbound", "name": "pay POST /x"} and got["s3"] is None
    assert got["seam"] == ["masking", "telemetry", "external", "runtime", "unresolved"] and got["ext"] == ["HTTP POST pay /x", "RPC S/M", None]
    assert got["un"] == [False, False, False, False, True, True] and got["ue"] == "cache Do" and got["rv"] == [True, False]
    assert got["bin"] == {"bin": "A", "known": False} and got["peer"] == "pay" and got["mut"] and got["ex"] == [True, True, False]


def test_query_lists_and_resolution(spark):
    assert Y.split_queries("a, b") == ["a", "b"] and Y.split_queries("/a{1,2}/") == ["/a{1,2}/"]
    for bad in ("/a,b", "/a/,/b/"):
        with pytest.raises(ValueError):
            Y.split_queries(bad)
    names = spark.createDataFrame([("(*a/p.T).M",), ("a/p.F",), ("b/p.F",)], "name string")
    queries = spark.createDataFrame([("T.M",), ("p.F",), ("/^a/",), ("zz",)], "query string")
    got = {(r["query"], r["name"], r["outcome"]) for r in Y.resolve(names, queries).collect()}
    assert got == {("T.M", "(*a/p.T).M", "ok"), ("p.F", "a/p.F", "ambiguous"), ("p.F", "b/p.F", "ambiguous"), ("/^a/", "a/p.F", "many"), ("zz", None, "unresolved")}
    rows = spark.createDataFrame([("r2", "violation"), ("r1", "violation"), ("c", "caution")], "rule string, severity string")
    assert Y.verdict_payload(rows, 1).first()[0] == '{"violated":["r1"],"cautions":1,"truncated":true}'
