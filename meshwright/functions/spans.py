"""Column expressions over span attributes: kinds, operation keys, peers, features, tiers.

``attrs`` is a map<string, string> column. Precedence of an operation key: messaging (but on
server spans), then by kind: server spans are inbound HTTP or RPC, clients RPC, then DB, then HTTP,
internal spans DB or their own name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meshwright.functions.labels import UUID, col, is_id, url_template
from meshwright.functions.sqlnorm import sql_normal_form

#: Messaging operations by direction, and names of brokers.
PUBLISHES = ("publish", "send", "create", "produce", "enqueue")
CONSUMES = ("receive", "process", "poll", "deliver", "consume")
SETTLES = ("settle", "ack", "nack", "delete", "complete", "abandon", "reject", "extend")
BROKERS = {"aws_sns": "SNS", "sns": "SNS", "aws_sqs": "SQS", "sqs": "SQS", "kafka": "Kafka", "apache_kafka": "Kafka", "rabbitmq": "RabbitMQ"}
VERBS = ("PUBLISH ", "CONSUME ", "SETTLE ")


def first(attrs: Column | str, *keys: str) -> Column:
    """The first attribute that is there and not empty, else null."""
    return F.coalesce(*(F.nullif(F.try_element_at(col(attrs), F.lit(k)), F.lit("")) for k in keys))


def words(*parts: Column) -> Column:
    """Parts that are there, joined by spaces."""
    return F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts))


def destination(attrs) -> Column:
    return first(attrs, "messaging.destination.name", "messaging.destination")


def is_messaging(kind, attrs) -> Column:
    return (col(kind) != "server") & destination(attrs).isNotNull()


def direction(kind, attrs) -> Column:
    """PUBLISH, CONSUME or SETTLE: by the stated operation, else by the kind."""
    op = F.lower(first(attrs, "messaging.operation.type", "messaging.operation"))
    return (
        F.when(op.isin(*PUBLISHES), "PUBLISH").when(op.isin(*CONSUMES), "CONSUME").when(op.isin(*SETTLES), "SETTLE")
        .when(col(kind) == "consumer", "CONSUME").otherwise("PUBLISH"))


def effective_kind(kind, attrs) -> Column:
    """Messaging spans are producers or consumers by their direction."""
    way = F.when(direction(kind, attrs) == "CONSUME", "consumer").otherwise("producer")
    return F.when(is_messaging(kind, attrs), way).otherwise(col(kind))


def is_short_hex(s) -> Column:
    """8 to 15 hex digits, one of them a decimal digit."""
    return col(s).rlike("^(?=.*[0-9])[0-9a-fA-F]{8,15}$")


def destination_name(dest, short_hex: bool = False) -> Column:
    """UUIDs and id-like tokens between - _ . : / ~ written {id}."""
    held = F.regexp_replace(col(dest), UUID, "{id}")
    parts = F.regexp_extract_all(held, F.lit(r"([-_.:/~]|[^-_.:/~]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda t: F.when(is_id(t) | (is_short_hex(t) if short_hex else F.lit(False)), "{id}").otherwise(t)), "")


def bus_destination(op) -> Column:
    return F.regexp_replace(col(op), "^(PUBLISH|CONSUME|SETTLE) ", "")


def broker_peer(attrs) -> Column:
    system = first(attrs, "messaging.system")
    named = F.try_element_at(F.create_map(*(F.lit(x) for kv in BROKERS.items() for x in kv)), F.lower(system))
    return F.coalesce(named, system, F.lit("Bus"))


def db_system(attrs) -> Column:
    return first(attrs, "db.system", "db.system.name")


def db_statement(attrs) -> Column:
    return first(attrs, "db.statement", "db.query.text")


def db_op_table(attrs) -> tuple[Column, Column]:
    """Operation and table: attributes first, the statement where one is missing."""
    op, table = F.upper(first(attrs, "db.operation", "db.operation.name")), F.lower(first(attrs, "db.sql.table", "db.collection.name"))
    said = sql_normal_form(F.when(op.isNull() | table.isNull(), db_statement(attrs)))
    return F.coalesce(op, F.nullif(said["op"], F.lit(""))), F.coalesce(table, F.nullif(said["table"], F.lit("")))


def db_key(attrs, db: tuple[Column, Column] | None = None) -> Column:
    """``db`` (here and below): operation and table where the caller has them at hand."""
    return words(F.lit("DB"), db_system(attrs), *(db or db_op_table(attrs)))


def db_peer(attrs) -> Column:
    return F.concat_ws("/", db_system(attrs), first(attrs, "db.namespace", "server.address"))


def parse_db_key(op) -> Column:
    """struct<system, operation, table> of a DB key; null for others."""
    f = F.filter(F.split(F.regexp_extract(col(op), "^DB (.*)$", 1), r"\s+"), lambda x: x != "")
    rest = F.when(F.size(f) > 2, F.array_join(F.slice(f, 3, 1 << 20), " ")).otherwise("")
    return F.when(F.startswith(col(op), F.lit("DB ")) & (F.size(f) > 0), F.struct(
        f[0].alias("system"), F.coalesce(F.try_element_at(f, F.lit(2)), F.lit("")).alias("operation"), rest.alias("table")))


def http_key(method, peer, route) -> Column:
    return words(F.lit("HTTP"), method, peer, route)


def http_method(attrs) -> Column:
    return F.upper(first(attrs, "http.request.method", "http.method"))


def http_route(attrs) -> Column:
    return url_template(first(attrs, "http.route", "url.template", "url.path", "http.target", "url.full"))


def rpc_key(attrs) -> Column:
    return F.concat(F.lit("RPC "), F.concat_ws("/", first(attrs, "rpc.service"), first(attrs, "rpc.method")))


def rpc_peer(attrs) -> Column:
    """Service, else what stands before the slash of the method, else the address."""
    head = F.nullif(F.regexp_extract(first(attrs, "rpc.method"), "^([^/]+)/", 1), F.lit(""))
    return F.coalesce(first(attrs, "rpc.service", "peer.service"), head, first(attrs, "server.address", "net.peer.name"))


def is_rpc(attrs) -> Column:
    return first(attrs, "rpc.system", "rpc.system.name", "rpc.service").isNotNull()


def operation(kind, attrs, name, short_hex: bool = False, db: tuple[Column, Column] | None = None) -> Column:
    """Canonical operation key of a span."""
    bus = F.concat(direction(kind, attrs), F.lit(" "), destination_name(destination(attrs), short_hex))
    bare = lambda verb: F.concat(F.lit(verb + " "), F.coalesce(destination_name(destination(attrs), short_hex), F.lit("")))
    is_db, k, db_name = db_system(attrs).isNotNull(), col(kind), db_key(attrs, db)
    peer = first(attrs, "peer.service", "server.address", "net.peer.name")
    server = F.when(is_rpc(attrs), rpc_key(attrs)).otherwise(http_key(http_method(attrs), F.lit(""), http_route(attrs)))
    client = F.when(is_rpc(attrs), rpc_key(attrs)).when(is_db, db_name).otherwise(http_key(http_method(attrs), peer, http_route(attrs)))
    return (
        F.when(is_messaging(kind, attrs), bus).when(k == "server", server).when(k == "client", client)
        .when(k == "producer", bare("PUBLISH")).when(k == "consumer", bare("CONSUME"))
        .when(is_db, db_name).otherwise(col(name)))


def peer_of(kind, attrs) -> Column:
    """The lifeline that a span talks to; empty where there is none."""
    k, db = col(kind), db_system(attrs).isNotNull()
    client = F.when(is_rpc(attrs), rpc_peer(attrs)).when(db, db_peer(attrs)).otherwise(first(attrs, "peer.service", "server.address", "net.peer.name"))
    out = F.when(is_messaging(kind, attrs) | k.isin("producer", "consumer"), broker_peer(attrs)).when(k == "client", client).when((k != "server") & db, db_peer(attrs))
    return F.coalesce(out, F.lit(""))


def db_effect_key(op, table) -> Column:
    return words(F.lit("db"), col(op), col(table))


def bus_effect_key(event) -> Column:
    return F.concat(F.lit("PUBLISH "), col(event))


def observed_key(kind, op) -> Column:
    """The effect a span stands for: its DB key, what a producer publishes, else null."""
    db = parse_db_key(op)
    return F.when(db["operation"] != "", db_effect_key(db["operation"], db["table"])).when(col(kind) == "producer", col(op))


def status_of(status) -> Column:
    return F.when(col(status).isin("ok", "error"), col(status)).otherwise("")


def db_effect(op) -> Column:
    return F.when(F.upper(F.trim(col(op))) == "SELECT", "read").otherwise("mutate")


def features(kind, attrs, status, db: tuple[Column, Column] | None = None) -> Column:
    """struct<boundary, effect, origin, fallible> of a span."""
    op, k = (db or db_op_table(attrs))[0], col(kind)
    inbound, client = k.isin("server", "consumer"), k == "client"
    outside = client | op.isNotNull()
    effect = F.when(inbound, "io").when(k == "producer", "mutate").when(op.isNotNull(), db_effect(op)).when(client, "io").otherwise("compute")
    boundary = F.when(inbound, "inbound").when(k == "producer", "outbound-async").when(outside, "outbound-sync").otherwise("internal")
    origin = F.when(inbound | (k == "producer") | ~outside, "first-party").otherwise("third-party")
    return F.struct(boundary.alias("boundary"), effect.alias("effect"), origin.alias("origin"), (status_of(status) == "error").alias("fallible"))


#: The nine built-in rules in order: name, what a feature must equal, tier.
BUILTIN_TIERS = (
    ("telemetry", {"effect": "telemetry"}, 4), ("publish", {"boundary": "outbound-async"}, 1), ("inbound", {"boundary": "inbound"}, 1),
    ("mutate", {"effect": "mutate"}, 1), ("ext-read", {"boundary": "outbound-sync", "effect": "read"}, 2), ("ext-sync", {"boundary": "outbound-sync"}, 1),
    ("xpkg-fallible", {"boundary": "cross-package", "origin": "first-party", "fallible": True}, 2), ("first-party", {"origin": "first-party"}, 3), ("stdlib", {"origin": "stdlib"}, 4),
)


def classify(f: Column, identity: Column | str, pins: dict[str, int] | None = None, rules: tuple = ()) -> Column:
    """struct<tier, rule> of a feature struct: pins by glob, then given rules, then the built-in ones, else tier 3."""
    from meshwright.functions.labels import glob_match

    out = F.lit(None).cast("struct<tier:int,rule:string>")
    answer = lambda tier, rule: F.struct(F.lit(tier).alias("tier"), F.lit(rule).alias("rule"))
    cases = [(glob_match(glob, identity), answer(tier, f"pin:{glob}")) for glob, tier in sorted((pins or {}).items())]
    for name, match, tier in (*rules, *BUILTIN_TIERS):
        hit = F.lit(True)
        for key, value in match.items():
            hit = hit & (f[key] == F.lit(value))
        cases.append((hit, answer(tier, name)))
    for hit, said in reversed(cases):
        out = F.when(hit, said).otherwise(out)
    return F.coalesce(out, answer(3, "catch-all"))


def project_attrs(attrs, allow: tuple[str, ...] = (), fqn_key: str = "code.function") -> Column:
    """Normal statement, symbol tag and allowed attributes (redacted) as a map."""
    from meshwright.functions.labels import redact

    keep = [k for k in allow if k not in ("db.statement", "db.query.text", fqn_key)]
    statement = F.nullif(sql_normal_form(db_statement(attrs))["statement"], F.lit(""))
    pairs = [(F.lit("db.statement"), statement), (F.lit(fqn_key), first(attrs, fqn_key))]
    pairs += [(F.lit(k), redact(F.try_element_at(col(attrs), F.lit(k)))) for k in keep]
    return F.map_from_entries(F.filter(F.array(*(F.struct(k.alias("key"), v.alias("value")) for k, v in pairs)), lambda e: e["value"].isNotNull()))
