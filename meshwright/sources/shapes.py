"""Shapes of the documents that are read: Spark schemas, one place for names and types."""

from __future__ import annotations

import re

from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType, MapType, StringType, StructField, StructType

PLAIN = {"string": StringType, "int": IntegerType, "long": LongType, "boolean": BooleanType}


def ddl(text: str) -> StructType:
    """The struct that a column list describes; needs no session, so executors can call it."""
    tokens = re.findall(r"`[^`]+`|\w+|[<>,:]", text)
    at = 0

    def take(*wanted: str) -> str:
        nonlocal at
        if wanted and tokens[at] not in wanted:
            raise ValueError(f"{tokens[at]!r} where {wanted} is expected")
        at += 1
        return tokens[at - 1]

    def kind() -> DataType:
        word = take()
        if word in PLAIN:
            return PLAIN[word]()
        take("<")
        if word == "array":
            out: DataType = ArrayType(kind())
        elif word == "map":
            key = kind()
            take(",")
            out = MapType(key, kind())
        else:
            out = columns()
        take(">")
        return out

    def columns() -> StructType:
        fields = []
        while True:
            name = take().strip("`")
            if tokens[at] == ":":
                take(":")
            fields.append(StructField(name, kind()))
            if at == len(tokens) or tokens[at] != ",":
                return StructType(fields)
            take(",")

    return columns()


SPOT = "kind string, site string, detail string, severity string, package string"
#: Field names and types of the documents.
GRAPH = ddl(f"""
stamp string, tool string, entrypoint string, algo string, caveats array<string>,
nodes array<struct<fqn string, sig string, tier int, package string, fallible boolean, file string, line int, end_line int>>,
edges array<struct<`from` string, `to` string, tier int, boundary string, concurrent boolean, via string>>,
blind_spots array<struct<{SPOT}>>,
obligations array<struct<rule string, kind string, fn string, site string, status string, detail string>>,
effect_order array<struct<fn string, effect string, effect_site string, callee string, callee_site string, always boolean, via string>>,
entrypoints array<struct<kind string, name string, fn string>>,
composition_roots array<string>, omitted_packages array<string>,
frontier struct<markers array<struct<kind string, bin string, site string, owner string, reclaimer_hint string>>, unconfirmed_routes int, coverage string>,
annotations array<struct<site string, kind string, note string, by string, claim string>>""")
ALLOW = "array<struct<`from` string, `to` string, reason string>>"
POLICY = ddl(f"""
service string, version int, substrate string, layers array<struct<name string, packages array<string>>>,
layering struct<allow {ALLOW}, roots array<string>>,
must_not_reach array<struct<name string, `from` array<string>, `to` array<string>, require_proof boolean>>,
must_pass_through array<struct<name string, `from` array<string>, `to` array<string>, through array<string>, require_proof boolean, allow {ALLOW}>>,
no_concurrent_reach array<struct<name string, `to` array<string>, require_proof boolean>>,
io_budget struct<max_writes_per_route int>,
blind_spot_ratchet struct<gate boolean, allow array<struct<kind string, site string, reason string>>>,
effect_ratchet struct<gate boolean, allow array<struct<target string, reason string>>>,
impeachment_gate struct<gate boolean>,
brokers map<string, struct<transport string, delivery string, ordered string, consumers string, dedup string, signed_by string>>""")
CONTRACT = ddl(f"""
service string, schema_version string,
entrypoints struct<http array<struct<method string, route string, tier int>>, consumers array<struct<event string, tier int>>>,
published array<struct<event string, tier int>>, consumed array<struct<event string, tier int>>,
external_dependencies array<struct<peer string, kind string, ops array<string>, tier int>>, blind_spots array<struct<{SPOT}>>""")
CLAIMS = ddl("""claims array<struct<kind string, id string, `from` string, `to` string, fqn string, of string, tier int, eq int,
counterpart_matching string, to_matching string, fn string, name string, entry_kind string>>""")
MANIFEST = ddl("""id string, direction string, tiers boolean, nodes array<struct<id string, graph string, fn string, label string>>,
subgraphs array<struct<id string, title string, nodes array<string>>>,
overlays struct<nodes array<struct<id string, label string, shape string>>, edges array<struct<`from` string, `to` string, label string>>>""")
VIOLATION = "array<struct<rule string, summary string, `from` string, `to` string, detail string>>"
ARTIFACT = ddl(f"""service string, verdict string, shape string, touches array<struct<package string, nodes_added int, nodes_removed int>>,
new_violations {VIOLATION}, contract_changes array<struct<op string, surface string, name string, breaking boolean>>,
io_effects array<struct<op string, effect string, write boolean>>, new_write_targets array<string>, reachable_from array<string>,
new_cautions {VIOLATION}, standing_cautions {VIOLATION}, new_blind_spots array<struct<kind string, site string, detail string>>,
algo string, caveats array<string>, digest string""")
EFFECT_GOLDEN = ddl("schema_version string, flow string, service string, effects array<string>")
TRANSCRIPT = ddl("init boolean, log int, call string, service string, session string, isError boolean, result string")
SPAN = "trace_id string, id string, parent string, name string, kind string, status string, error_type string, start_ns long, end_ns long, attrs map<string,string>, links array<struct<trace_id string, id string>>"
