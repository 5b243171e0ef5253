"""Column expressions over symbols, boundary labels, routes, URLs and span attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Verbs and vocabularies of labels.
DML = ("INSERT", "UPDATE", "DELETE", "MERGE", "REPLACE", "UPSERT")
HTTP_WRITES = ("POST", "PUT", "PATCH", "DELETE")
METHOD_NAMED = ("blob", "cache", "rpc")
DISCLOSURE_ONLY = ("ExternalBoundaryCall", "Truncated")
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def match_prefix(s: Column | str, prefix: Column | str) -> Column:
    """Equal, or a prefix that the next identifier byte does not extend."""
    s, prefix = col(s), col(prefix)
    follows = F.substring(s, F.length(prefix) + 1, F.lit(1))
    return F.startswith(s, prefix) & ~F.coalesce(follows.rlike("^[A-Za-z0-9_]$"), F.lit(False))


def boundary_prefixes(s: Column | str) -> Column:
    """All prefixes p of s for which match_prefix(s, p): turns pattern joins into equi-joins."""
    s = col(s)
    at = F.filter(
        F.sequence(F.lit(1), F.length(s)),
        lambda i: (i == F.length(s)) | ~F.substring(s, i + 1, F.lit(1)).rlike("^[A-Za-z0-9_]$"))
    return F.transform(at, lambda i: F.substring(s, F.lit(1), i))


def pkg_of(fqn: Column | str) -> Column:
    """Import path of a symbol: receiver signs and type arguments dropped, up to the first dot after the last slash."""
    plain = F.regexp_replace(F.substring_index(col(fqn), "[", 1), r"[()*]", "")
    return F.regexp_extract(plain, r"^((?:.*/)?[^./]*)", 1)


def short_name(fqn: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(fqn), r"^.*/", ""), r"[()*]", "")


def is_boundary(dst: Column | str) -> Column:
    return F.startswith(col(dst), F.lit("boundary:"))


def is_dynamic(dst: Column | str) -> Column:
    return F.contains(col(dst), F.lit("<dynamic>"))


def fields(dst: Column | str) -> Column:
    """Tokens of a label without its prefix."""
    return F.split(F.regexp_replace(col(dst), "^boundary:", ""), r"\s+")


def is_write(dst: Column | str) -> Column:
    """db: a DML verb; bus: PUBLISH; method-named: never; peers: a writing HTTP method."""
    f = fields(dst)
    kind, verb = f[0], F.upper(F.try_element_at(f, F.lit(2)))
    said = F.when(kind == "db", verb.isin(*DML)).when(kind == "bus", verb == "PUBLISH").when(kind.isin(*METHOD_NAMED), F.lit(False)).otherwise(
        verb.isin(*HTTP_WRITES))
    return is_boundary(dst) & F.coalesce(said, F.lit(False))


def write_label(dst: Column | str) -> Column:
    return F.when(is_write(dst), F.regexp_replace(col(dst), "^boundary:", ""))


def unclassified_db(dst: Column | str) -> Column:
    """A db effect whose verb is no DML, no SELECT and no driver or transaction control."""
    from meshwright.functions.symbols import db_control

    f = fields(dst)
    verb = F.try_element_at(f, F.lit(2))
    return is_boundary(dst) & (F.size(f) >= 2) & (f[0] == "db") & ~F.coalesce(F.upper(verb).isin(*DML, "SELECT") | db_control(verb), F.lit(False))


def glob_match(pattern: str, s: Column | str) -> Column:
    """* stands for any run of characters; all else is literal."""
    import re

    return col(s).rlike("^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$")


def is_id(s: Column | str) -> Column:
    """Digits, a UUID, or 16 and more hex digits."""
    return col(s).rlike(f"^([0-9]+|{UUID}|[0-9a-fA-F]{{16,}})$")


def url_template(url: Column | str) -> Column:
    """Path of a URL with id-like segments written {id}."""
    path = F.regexp_replace(F.regexp_replace(col(url), r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.array_join(F.transform(F.split(path, "/"), lambda s: F.when(is_id(s), F.lit("{id}")).otherwise(s)), "/")


def redact(value: Column | str) -> Column:
    v = col(value)
    return (
        F.when(v.rlike(f"^{UUID}$"), "<uuid>")
        .when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+(Z|[+-][0-9]{2}:[0-9]{2})$"), "<ts>")
        .when(v.rlike("^[0-9]+$"), "<id>").otherwise(v))


def normalize_destination(dest: Column | str) -> Column:
    """UUIDs and id-like tokens between separators become {id}."""
    plain = F.regexp_replace(col(dest), UUID, "{id}")
    return F.regexp_replace(plain, r"(^|(?<=[-_.:/~]))([0-9]+|[0-9a-fA-F]{16,})(?=$|[-_.:/~])", "{id}")


def route_match(entry: Column | str, query: Column | str) -> Column:
    """Methods agree where both are given; the shorter path aligns with the tail of the longer; parameters match anything."""
    method = lambda x: F.upper(F.regexp_extract(x, r"^([A-Za-z]+)\s", 1))
    segs = lambda x: F.filter(F.split(F.regexp_replace(x, r"^[A-Za-z]+\s+", ""), "/"), lambda s: s != "")
    a, b = segs(col(entry)), segs(col(query))
    n = F.least(F.size(a), F.size(b))
    tail = lambda x: F.slice(x, F.size(x) - n + 1, n)
    free = lambda s: s.rlike(r"^([{:<$].*|\*|\.\.\.)$")
    same = F.forall(F.zip_with(tail(a), tail(b), lambda x, y: (x == y) | free(x) | free(y)), lambda ok: ok)
    ma, mb = method(col(entry)), method(col(query))
    return ((ma == "") | (mb == "") | (ma == mb)) & (n > 0) & same


def slug(name: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def op_key(kind: Column | str, attrs: Column | str, name: Column | str) -> Column:
    """Canonical operation of a span: messaging, then rpc, then db, then http, else its name."""
    a = lambda k: F.nullif(F.try_element_at(col(attrs), F.lit(k)), F.lit(""))
    op = a("messaging.operation")
    way = F.when(op.isin("publish", "send", "create"), "PUBLISH").when(op.isin("receive", "process", "deliver"), "CONSUME").when(op == "settle", "SETTLE").when(
        col(kind) == "producer", "PUBLISH").otherwise("CONSUME")
    return (
        F.when(a("messaging.system").isNotNull(), F.concat_ws(" ", way, normalize_destination(a("messaging.destination"))))
        .when(a("rpc.service").isNotNull(), F.concat(F.lit("RPC "), F.concat_ws("/", a("rpc.service"), a("rpc.method"))))
        .when(a("db.system").isNotNull(), F.concat_ws(" ", F.lit("DB"), a("db.system"), F.upper(a("db.operation")), a("db.table")))
        .when(a("http.method").isNotNull(), F.concat_ws(" ", F.lit("HTTP"), F.upper(a("http.method")), a("net.peer"), url_template(F.coalesce(a("http.route"), F.lit("/")))))
        .otherwise(col(name)))
