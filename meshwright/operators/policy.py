"""The fitness suite over a graph index and a checked policy, its audit, and the pre-merge gate.

Findings: rule, severity (violation or caution), name, summary, from, to, detail. Identity of a
finding is (rule, from, to, summary). A policy is a small document: loops over its rules run on
the driver, each rule is one plan. "No path" is only said where nothing hides one: a blind
frontier makes a caution, or a violation under require_proof.
"""

from __future__ import annotations

import copy
import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.durable import written
from meshwright.functions import labels as L
from meshwright.functions import symbols as Y
from meshwright.operators import deltas, rules
from meshwright.operators.graph import GraphIndex, closure, shortest_paths

COLUMNS = ["rule", "severity", "name", "summary", "from", "to", "detail"]
KEY = ["rule", "from", "to", "summary"]


def _finding(df: DataFrame, rule: str, severity, name, summary, from_=None, to=None, detail=None) -> DataFrame:
    text = lambda c: F.coalesce(c, F.lit("")) if c is not None else F.lit("")
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(
        F.lit(rule).alias("rule"), severity.alias("severity"), F.lit(name).alias("name"), summary.alias("summary"),
        text(from_).alias("from"), text(to).alias("to"), text(detail).alias("detail"))


def _all(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    none = like.sparkSession.createDataFrame([], ", ".join(f"`{c}` string" for c in COLUMNS))
    return reduce(lambda a, b: a.unionByName(b), parts, none)


def _rule_table(ix: GraphIndex, section: list[dict]) -> DataFrame:
    rows = [(r["name"], r.get("from") or [], r.get("to") or [], bool(r.get("require_proof"))) for r in section]
    return ix.nodes.sparkSession.createDataFrame(rows, "rule string, `from` array<string>, `to` array<string>, require_proof boolean")


def _excused(frm: str, to: str, allow: list[dict] | None):
    """Whether (from, to) columns match one of a few exceptions; an empty side matches anything."""
    out = F.lit(False)
    for a in allow or []:
        out = out | (Y.exception_side(frm, F.lit(a.get("from") or "")) & Y.exception_side(to, F.lit(a.get("to") or "")))
    return out


def _bind_any(name: str, patterns: list[str]):
    return reduce(lambda a, b: a | b, (L.match_prefix(name, F.lit(p)) for p in patterns), F.lit(False))


def blind_site(ix: GraphIndex, cone: DataFrame) -> DataFrame:
    """seed, site: the first evidence in each (seed, node) cone that something is hidden."""
    out = cone.join(ix.labels.where(L.is_dynamic("label")), "node").select("seed", F.lit(2).alias("o"), F.concat(F.lit("unresolved effect "), "label").alias("site"))
    if ix.spots is not None:
        spots = ix.spots.where(~F.col("kind").isin(*L.DISCLOSURE_ONLY)).select("site", "kind").distinct()
        at = cone.join(spots.withColumnRenamed("site", "node"), "node").select("seed", F.lit(1).alias("o"), F.concat("kind", F.lit(" at "), L.short_name("node")).alias("site"))
        inside = cone.withColumn("pkg", L.pkg_of("node")).join(spots.withColumnRenamed("site", "pkg"), "pkg").select("seed", F.lit(1).alias("o"), F.concat("kind", F.lit(" in "), "pkg").alias("site"))
        out = out.unionByName(at).unionByName(inside)
    return out.groupBy("seed").agg(F.min(F.struct("o", "site"))["site"].alias("site"))


def reach_findings(ix: GraphIndex, policy: dict) -> DataFrame:
    section = policy.get("must_not_reach") or []
    if not section:
        return _all([], ix.nodes)
    table = _rule_table(ix, section)
    got = rules.must_not_reach(ix, table).where("severity IS NOT NULL")
    said = (
        F.when(F.col("verdict") == "INERT", F.lit("no source binds: the rule says nothing")).when(F.col("verdict") == "UNBINDABLE", F.lit("no target binds: the rule says nothing"))
        .when(F.col("verdict") == "REACHABLE", F.concat(L.short_name("from"), F.lit(" reaches "), "to"))
        .otherwise(F.lit("no path found, but the frontier is blind")))
    return got.select(
        F.lit("must_not_reach").alias("rule"), "severity", F.col("rule").alias("name"), F.concat("rule", F.lit(": "), said).alias("summary"),
        F.coalesce("from", F.lit("")).alias("from"), F.coalesce("to", F.lit("")).alias("to"), F.lit("").alias("detail"))


def pass_findings(ix: GraphIndex, policy: dict) -> DataFrame:
    """Every (source, target) that a source reaches around the waypoints, with its shortest path."""
    parts = []
    for rule in policy.get("must_pass_through") or []:
        proof = "violation" if rule.get("require_proof") else "caution"
        table = _rule_table(ix, [rule])
        one = ix.nodes.sparkSession.range(1)
        label = f"{rule['name']}: "
        src = written(rules.sources(ix, table).select("seed"), "sources")
        targets = written(rules.targets_of(ix, table).select("target"), "targets")
        if src.isEmpty() or targets.isEmpty():
            which = "source" if src.isEmpty() else "target"
            parts.append(_finding(one, "must_pass_through", proof, rule["name"], F.lit(f"{label}no {which} binds: the rule says nothing")))
            continue
        free = src.where(~_bind_any("seed", rule["through"]))
        edges = ix.internal.where(~_bind_any("dst", rule["through"]))
        cone = written(closure(free, edges).select("seed", "node").unionByName(free.select("seed", F.col("seed").alias("node"))).distinct(), "cone")
        to_node = cone.where("seed <> node").join(targets.withColumnRenamed("target", "node"), "node", "left_semi").select("seed", "node", F.col("node").alias("target"))
        to_label = cone.join(ix.labels.join(targets.withColumnRenamed("target", "label"), "label", "left_semi"), "node").select("seed", "node", F.col("label").alias("target"))
        hits = written(to_node.unionByName(to_label).where(~_excused("seed", "target", rule.get("allow"))), "hits")
        if not hits.isEmpty():
            # paths only among nodes that some hit of theirs lies behind
            wanted = hits.select("node").distinct().withColumnRenamed("node", "seed")
            useful = closure(wanted, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select(F.col("node").alias("dst")).unionByName(wanted.select(F.col("seed").alias("dst"))).distinct()
            paths = shortest_paths(hits.select("seed").distinct(), edges.join(useful, "dst", "left_semi").select("src", "dst"))
            best = hits.join(paths, ["seed", "node"]).withColumn("path", F.when(F.col("node") == F.col("target"), F.col("path")).otherwise(F.concat("path", F.array("target"))))
            best = best.groupBy("seed", "target").agg(F.min_by("path", F.struct(F.size("path"), "path")).alias("path"))
            through = ", ".join(p.rsplit("/", 1)[-1] for p in rule["through"])
            parts.append(_finding(
                best, "must_pass_through", "violation", rule["name"],
                F.concat(F.lit(label), L.short_name("seed"), F.lit(" reaches "), L.short_name("target"), F.lit(f" without passing {through}")), F.col("seed"), F.col("target"), F.array_join("path", " > ")))
        else:
            blind = blind_site(ix, cone).orderBy("seed").limit(1)
            parts.append(_finding(blind, "must_pass_through", proof, rule["name"], F.concat(F.lit(f"{label}no way around found, but the frontier is blind ("), "site", F.lit(")")), F.col("seed")))
    return _all(parts, ix.nodes)


def concurrent_findings(ix: GraphIndex, policy: dict) -> DataFrame:
    """Targets under concurrency: one cone of everything started concurrently, shared by all rules."""
    section = policy.get("no_concurrent_reach") or []
    if not section:
        return _all([], ix.nodes)
    spark = ix.nodes.sparkSession
    begun = ix.concurrent.select(F.col("dst").alias("node")).distinct().join(ix.nodes.select(F.col("fqn").alias("node")), "node", "left_semi").select(F.lit("*").alias("seed"), "node")
    cone = written(closure(begun, ix.internal).select("seed", "node").unionByName(begun).distinct(), "cone")
    direct = written(ix.effects.where("concurrent").select(F.col("src").alias("from"), F.substring("dst", 10, 1 << 20).alias("to")).distinct(), "direct")
    inside = cone.join(ix.labels, "node").select(F.col("node").alias("from"), F.col("label").alias("to"))
    reached = written(direct.unionByName(inside).unionByName(cone.select(F.lit("").alias("from"), F.col("node").alias("to"))).distinct(), "reached")
    hidden = direct.where(L.is_dynamic("to")).select(F.concat(F.lit("unresolved effect "), "to").alias("site")).unionByName(blind_site(ix, cone).select("site"))
    if ix.spots is not None:
        hidden = hidden.unionByName(ix.spots.where("kind = 'ConcurrentDispatch'").select(F.concat(F.lit("ConcurrentDispatch at "), "site").alias("site")))
    hidden = hidden.agg(F.min("site").alias("site")).where("site IS NOT NULL")
    parts = []
    for rule in section:
        proof = "violation" if rule.get("require_proof") else "caution"
        label = f"{rule['name']}: "
        if rules.targets_of(ix, _rule_table(ix, [rule])).isEmpty():
            parts.append(_finding(spark.range(1), "no_concurrent_reach", proof, rule["name"], F.lit(f"{label}no target binds: the rule says nothing")))
            continue
        hits = reached.where(_bind_any("to", rule["to"]))
        parts.append(_finding(hits, "no_concurrent_reach", "violation", rule["name"], F.concat(F.lit(label), F.col("to"), F.lit(" runs concurrently")), F.col("from"), F.col("to")))
        if hits.isEmpty():
            parts.append(_finding(hidden, "no_concurrent_reach", proof, rule["name"], F.concat(F.lit(f"{label}nothing found, but the frontier is blind ("), "site", F.lit(")"))))
    return _all(parts, ix.nodes)


def layer_findings(ix: GraphIndex, policy: dict) -> DataFrame:
    if policy.get("layering") is None:
        return _all([], ix.nodes)
    table = [(layer["name"], k, p) for k, layer in enumerate(policy["layers"]) for p in layer["packages"]]
    layers = ix.nodes.sparkSession.createDataFrame(table, "layer string, rank int, prefix string")
    bad = rules.layering(ix, layers, tuple(policy["layering"].get("roots") or ())).where(~_excused("from", "to", policy["layering"].get("allow")))
    return _finding(bad, "layering", "violation", "layering", F.concat(L.pkg_of("from"), F.lit(" calls "), L.pkg_of("to"), F.lit(" across layers")), F.col("from"), F.col("to"))


def route_surface(ix: GraphIndex, policy: dict | None = None) -> DataFrame:
    """route, writes, unclassified, unclassified_effects (sorted arrays), blind of every root outside the composition roots."""
    roots = ix.roots().withColumnRenamed("fqn", "seed")
    for r in ((policy or {}).get("layering") or {}).get("roots") or []:
        roots = roots.where(~L.match_prefix(L.pkg_of("seed"), F.lit(r)))
    cone = written(ix.cone(roots), "cone")
    label = F.concat(F.lit("boundary:"), F.col("label"))
    seen = cone.join(ix.labels, "node").select("seed", "label").distinct()
    per = seen.groupBy("seed").agg(*(
        F.array_sort(F.collect_list(F.when(c, F.col("label")))).alias(n)
        for n, c in (("writes", L.is_write(label)), ("unclassified", L.unclassified_db(label)), ("unclassified_effects", Y.unclassified_effect(label).isNotNull()))))
    none = F.array().cast("array<string>")
    blind = ix.blind(cone).withColumn("b", F.lit(True))
    return roots.join(per, "seed", "left").join(blind, "seed", "left").select(
        F.col("seed").alias("route"), *(F.coalesce(n, none).alias(n) for n in ("writes", "unclassified", "unclassified_effects")), F.coalesce("b", F.lit(False)).alias("blind"))


def budget_findings(ix: GraphIndex, policy: dict, surface: DataFrame | None = None) -> DataFrame:
    if policy.get("io_budget") is None:
        return _all([], ix.nodes)
    most = policy["io_budget"].get("max_writes_per_route") or 0
    routes = route_surface(ix, policy) if surface is None else surface
    n = F.size("writes").cast("string")
    over = _finding(routes.where(F.size("writes") > most), "io_budget", "violation", "io_budget",
                    F.concat(L.short_name("route"), F.lit(" reaches "), n, F.lit(f" writes over a budget of {most}: "), F.array_join("writes", ", ")), F.col("route"))
    total = routes.agg(
        F.count("*").alias("n"), F.count_if(F.size("unclassified") > 0).alias("u"), F.count_if(F.size("unclassified_effects") > 0).alias("e"), F.count_if("blind").alias("b"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("unclassified")))).alias("ul"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("unclassified_effects")))).alias("el"))
    said = F.array(
        F.when(F.col("n") == 0, F.lit("the budget binds no route")),
        F.when(F.col("u") > 0, F.concat(F.lit("not enforceable on "), F.col("u").cast("string"), F.lit(" routes: unreadable db effects "), F.array_join("ul", ", "))),
        F.when(F.col("e") > 0, F.concat(F.lit("not enforceable on "), F.col("e").cast("string"), F.lit(" routes: effects without an operation "), F.array_join("el", ", "))),
        F.when(F.col("b") > 0, F.concat(F.lit("a lower bound on "), F.col("b").cast("string"), F.lit(" routes: the frontier is blind"))))
    notes = total.select(F.explode(F.array_compact(said)).alias("s"))
    return over.unionByName(_finding(notes, "io_budget", "caution", "io_budget", F.col("s")))


def obligation_findings(obligations: DataFrame) -> DataFrame:
    """VIOLATED is a violation, SATISFIED nothing, all else (also unknown words) a caution."""
    bad = obligations.where("status <> 'SATISFIED'")
    severity = F.when(F.col("status") == "VIOLATED", "violation").otherwise("caution")
    return bad.select(
        F.lit("obligation").alias("rule"), severity.alias("severity"), F.col("rule").alias("name"),
        F.concat_ws(": ", "rule", F.concat_ws(" ", "status", F.coalesce("detail", F.lit("")))).alias("summary"),
        F.coalesce("fn", F.lit("")).alias("from"), F.coalesce("site", F.lit("")).alias("to"), F.lit("").alias("detail"))


def ratchet_findings(ix: GraphIndex, policy: dict) -> DataFrame:
    """A gated write ratchet without a gated blind-spot ratchet can be walked around."""
    parts = []
    if gates(policy, "effect_ratchet") and not gates(policy, "blind_spot_ratchet"):
        parts.append(_finding(ix.nodes.sparkSession.range(1), "ratchet", "caution", "effect_ratchet", F.lit("writes are gated but blind spots are not: a hidden write passes")))
    return _all(parts, ix.nodes)


def gates(policy: dict, section: str) -> bool:
    """Whether a ratchet or the impeachment section blocks."""
    return bool((policy.get(section) or {}).get("gate"))


def suite(ix: GraphIndex, policy: dict, obligations: DataFrame | None = None) -> DataFrame:
    """All findings in their order: rule, violations first, then by place and text."""
    parts = [f(ix, policy) for f in (layer_findings, reach_findings, pass_findings, concurrent_findings, budget_findings, ratchet_findings)]
    if obligations is not None:
        parts.append(obligation_findings(obligations))
    return _all(parts, ix.nodes).dropDuplicates([*KEY, "severity"]).orderBy(F.desc("severity"), "rule", "from", "to", "summary")


def findings_diff(base: DataFrame, branch: DataFrame) -> DataFrame:
    """Findings of the branch, ``standing`` where the base has the same."""
    there = base.select(*KEY).distinct().withColumn("standing", F.lit(True))
    return branch.join(there, KEY, "left").withColumn("standing", F.coalesce("standing", F.lit(False)))


def without_exceptions(policy: dict) -> dict:
    out = copy.deepcopy(policy)
    (out.get("layering") or {}).pop("allow", None)
    for rule in out.get("must_pass_through") or []:
        rule.pop("allow", None)
    return out


def exceptions_audit(ix: GraphIndex, policy: dict) -> DataFrame:
    """section, from, to, live: whether each exception still excuses or admits something."""
    spark = ix.nodes.sparkSession
    bare = without_exceptions(policy)
    parts = []
    sections = [("layering", layer_findings, (policy.get("layering") or {}).get("allow") or [], None)]
    sections += [(f"must_pass_through {r['name']}", pass_findings, r.get("allow") or [], r["name"]) for r in policy.get("must_pass_through") or []]
    for section, find, allow, name in sections:
        if not allow:
            continue
        only = bare if name is None else bare | {"must_pass_through": [r for r in bare["must_pass_through"] if r["name"] == name]}
        full = policy if name is None else policy | {"must_pass_through": [r for r in policy["must_pass_through"] if r["name"] == name]}
        held = written(find(ix, only).join(find(ix, full).select(*KEY), KEY, "left_anti").select("from", "to"), "held")
        for a in allow:
            hit = held.where(_excused("from", "to", [a])).agg((F.count("*") > 0).alias("live"))
            parts.append(hit.select(F.lit(section).alias("section"), F.lit(a.get("from") or "").alias("from"), F.lit(a.get("to") or "").alias("to"), "live"))
    for a in (policy.get("blind_spot_ratchet") or {}).get("allow") or []:
        spots = ix.spots if ix.spots is not None else spark.createDataFrame([], "kind string, site string")
        hit = spots.where((F.lit(a.get("kind") or "") == "") | (F.col("kind") == (a.get("kind") or ""))).where(L.match_prefix("site", F.lit(a["site"]))).agg((F.count("*") > 0).alias("live"))
        parts.append(hit.select(F.lit("blind_spot_ratchet").alias("section"), F.lit(a.get("kind") or "").alias("from"), F.lit(a["site"]).alias("to"), "live"))
    for a in (policy.get("effect_ratchet") or {}).get("allow") or []:
        hit = ix.labels.where(L.is_write(F.concat(F.lit("boundary:"), "label")) & L.match_prefix("label", F.lit(a["target"]))).agg((F.count("*") > 0).alias("live"))
        parts.append(hit.select(F.lit("effect_ratchet").alias("section"), F.lit("").alias("from"), F.lit(a["target"]).alias("to"), "live"))
    none = spark.createDataFrame([], "section string, `from` string, `to` string, live boolean")
    return reduce(lambda a, b: a.unionByName(b), parts, none)


# ---- deltas that a gate looks at


def new_spots(policy: dict, base: DataFrame, branch: DataFrame) -> DataFrame:
    """(kind, site) of the branch that the base lacks and the ratchet does not admit."""
    out = branch.select("kind", "site").distinct().join(base.select("kind", "site"), ["kind", "site"], "left_anti").where("kind <> 'ImpeachmentSeam'")
    for a in (policy.get("blind_spot_ratchet") or {}).get("allow") or []:
        out = out.where(~(((F.lit(a.get("kind") or "") == "") | (F.col("kind") == (a.get("kind") or ""))) & L.match_prefix("site", F.lit(a["site"]))))
    return out


def new_writes(policy: dict, base: GraphIndex, branch: GraphIndex) -> DataFrame:
    """label: writes of the branch that the base lacks and the ratchet does not admit."""
    write = lambda ix: ix.labels.where(L.is_write(F.concat(F.lit("boundary:"), "label"))).select("label").distinct()
    out = write(branch).join(write(base), "label", "left_anti")
    for a in (policy.get("effect_ratchet") or {}).get("allow") or []:
        out = out.where(~L.match_prefix("label", F.lit(a["target"])))
    return out


def contract_surface(ix: GraphIndex, entrypoints: DataFrame | None = None) -> DataFrame:
    """(surface, name): what others see: named routes, publications, consumptions, outbound calls."""
    out = ix.labels.select(Y.contract_surface(F.concat(F.lit("boundary:"), "label")).alias("c")).where("c IS NOT NULL").select("c.surface", "c.name")
    if entrypoints is not None:
        routes = entrypoints.where("kind IN ('http', 'consumer') AND name <> ''").select(F.concat(F.lit("entrypoint "), "kind").alias("surface"), "name")
        # a consumer route and its CONSUME effect are one thing
        out = out.join(routes.where("surface = 'entrypoint consumer'").select(F.lit("consume").alias("surface"), "name"), ["surface", "name"], "left_anti").unionByName(routes)
    return out.distinct()


def compare_contracts(base: DataFrame, branch: DataFrame) -> DataFrame:
    """op, surface, name, breaking of two contract documents of one service.

    Routes, publications and consumptions that go are breaking; dependencies never are, and one
    whose operations changed is ``~``.
    """
    def rows(c: DataFrame) -> DataFrame:
        none = F.array().cast("array<struct<surface:string,name:string,sig:string>>")
        row = lambda s, n, sig=F.lit(""): F.struct(F.lit(s).alias("surface"), n.alias("name"), sig.alias("sig"))
        lists = [
            F.transform("entrypoints.http", lambda x: row("http", F.concat_ws(" ", x["method"], x["route"]))), F.transform("entrypoints.consumers", lambda x: row("consumer", x["event"])),
            F.transform("published", lambda x: row("publish", x["event"])), F.transform("consumed", lambda x: row("consume", x["event"])),
            F.transform("external_dependencies", lambda x: row("dependency", F.concat_ws(" ", x["kind"], x["peer"]), F.array_join(F.array_sort(x["ops"]), ",")))]
        return c.select(F.explode(F.concat(*(F.coalesce(x, none) for x in lists))).alias("x")).select("x.*").distinct()

    services = base.select("service").unionByName(branch.select("service")).distinct().collect()  # two rows
    if len(services) > 1:
        raise ValueError(f"contracts of different services: {', '.join(sorted(str(s[0]) for s in services))}")
    both = rows(base).alias("a").join(rows(branch).alias("b"), ["surface", "name"], "full_outer")
    op = F.when(F.col("a.sig").isNull(), "+").when(F.col("b.sig").isNull(), "-").when(F.col("a.sig") != F.col("b.sig"), "~")
    return both.select(op.alias("op"), "surface", "name", ((op == "-") & (F.col("surface") != "dependency")).alias("breaking")).where("op IS NOT NULL")


def label_drift(base: GraphIndex, branch: GraphIndex) -> DataFrame:
    """base, branch: how many unreadable db labels each side has."""
    count = lambda ix, n: ix.labels.where(L.unclassified_db(F.concat(F.lit("boundary:"), "label"))).agg(F.count_distinct("label").alias(n))
    return count(base, "base").join(count(branch, "branch"), F.lit(True))  # one row each


def scope_escapes(touched: DataFrame, scope: list[str]) -> DataFrame:
    """package: touched packages outside the declared scope."""
    return touched.select("package").distinct().where(~_bind_any("package", scope)) if scope else touched.select("package").limit(0)


def digest(document: dict) -> str:
    """sha256 of a document in canonical JSON without its digest."""
    return hashlib.sha256(json.dumps({k: v for k, v in document.items() if k != "digest"}, indent=2, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def review(policy: dict, base: GraphIndex, branch: GraphIndex, entrypoints: tuple[DataFrame, DataFrame] | None = None, cap: int | None = None) -> dict:
    """The review artifact of a branch: deltas, findings, verdict and digest.

    What it lists is what a person reads: findings and changes, collected in sorted order; ``cap``
    bounds each list and says how many more there are.
    """
    nodes = written(deltas.set_diff(base.nodes.select("fqn"), branch.nodes.select("fqn")), "nodes")
    edges = written(deltas.set_diff(base.internal, branch.internal), "edges")
    effects = written(deltas.set_diff(base.labels, branch.labels), "effects")
    found = written(findings_diff(suite(base, policy), suite(branch, policy)), "findings")
    surfaces = [contract_surface(ix, e) for ix, e in zip((base, branch), entrypoints or (None, None), strict=True)]
    contract = written(deltas.contract_diff(*surfaces), "contract")
    spots = written(new_spots(policy, base.spots, branch.spots), "spots") if base.spots is not None and branch.spots is not None else None
    writes = written(new_writes(policy, base, branch), "writes")

    def listed(df: DataFrame | None) -> list[dict]:
        if df is None:
            return []
        rows = [r.asDict() for r in (df.orderBy(*df.columns) if cap is None else df.orderBy(*df.columns).limit(cap)).collect()]
        more = 0 if cap is None or len(rows) < cap else df.count() - cap
        return [*rows, {"more": more}] if more else rows

    packages = deltas.pkg_deltas(nodes)
    drift = label_drift(base, branch).first().asDict()
    violations = found.where("severity = 'violation' AND NOT standing").drop("severity", "standing")
    touched = written(nodes.select(L.pkg_of("fqn").alias("package")).unionByName(edges.select(L.pkg_of("src").alias("package"))).unionByName(effects.select(L.pkg_of("node").alias("package"))).distinct(), "touched")
    out = {
        "service": policy["service"], "shape": touched.agg(F.count("*").alias("n")).select(deltas.shape(F.col("n"))).first()[0],
        "touches": listed(packages), "new_violations": listed(violations), "new_cautions": listed(found.where("severity = 'caution' AND NOT standing").drop("severity", "standing")),
        "standing_cautions": listed(found.where("severity = 'caution' AND standing").drop("severity", "standing")), "contract_changes": listed(contract),
        "io_effects": listed(effects.select(F.col("change").alias("op"), F.col("label").alias("effect")).distinct()), "new_blind_spots": listed(spots), "new_write_targets": [r["label"] if "label" in r else r for r in listed(writes)],
        "db_label_drift": drift if drift["base"] != drift["branch"] else None, "touched": [r["package"] if "package" in r else r for r in listed(touched)]}
    breaking = any(c.get("breaking") for c in out["contract_changes"])
    blocked = out["new_violations"] or breaking or gates(policy, "blind_spot_ratchet") and out["new_blind_spots"] or gates(policy, "effect_ratchet") and out["new_write_targets"]
    quiet = not any(out[k] for k in ("touched", "contract_changes", "new_cautions", "new_blind_spots", "new_write_targets", "db_label_drift"))
    out["verdict"] = "BLOCK" if blocked else "NO-STRUCTURAL-SIGNAL" if quiet else "STRUCTURALLY-CLEAR"
    out["digest"] = digest(out)
    return out


def verify_artifact(claimed: dict, fresh: dict) -> str:
    """TAMPERED where the body does not have its digest, STALE where a new review differs, else AUTHENTIC."""
    if digest(claimed) != claimed.get("digest"):
        return "TAMPERED"
    return "AUTHENTIC" if fresh["digest"] == claimed["digest"] else "STALE"


def gate(policy: dict, artifact: dict, scope: list[str] | None = None, impeached: list[str] | None = None) -> dict:
    """pass and the reasons against it."""
    def inside(package: str) -> bool:
        return any(package == s or package.startswith(s) and not (package[len(s)].isalnum() or package[len(s)] == "_") for s in scope or [])

    why = [f"violation: {v.get('summary', v)}" for v in artifact["new_violations"]]
    why += [f"breaking: {c['surface']} {c['name']}" for c in artifact["contract_changes"] if c.get("breaking")]
    if scope:
        why += [f"out of scope: {p}" for p in artifact["touched"] if not inside(p)]
    if gates(policy, "blind_spot_ratchet"):
        why += [f"new blind spot: {s.get('kind')} at {s.get('site')}" for s in artifact["new_blind_spots"]]
    if gates(policy, "effect_ratchet"):
        why += [f"new write: {w}" for w in artifact["new_write_targets"]]
    if gates(policy, "impeachment_gate"):
        why += [f"impeached: {x}" for x in impeached or []]
    return {"pass": not why, "reasons": why, "verdict": artifact["verdict"]}


def verify_stamp(stamp: str | None, expected: str | None) -> None:
    if expected is not None and stamp != expected:
        raise ValueError(f"the graph's stamp is {stamp!r}, {expected!r} is expected")


# ---- proposals: a policy that holds today


def propose(ix: GraphIndex, service: str, passes: int = 3, few: int = 5) -> tuple[dict, list[str]]:
    """(policy, notes): layers, read-only routes, concurrency, budget and open ratchets, all measured; then re-checked."""
    notes, policy = [], {"service": service, "version": 1}
    pkgs = ix.internal.select(L.pkg_of("src").alias("src"), L.pkg_of("dst").alias("dst")).where("src <> dst").distinct()
    depth = package_depths(ix, pkgs)
    if depth is None:
        notes.append("layers: packages call each other in a circle")
    else:
        levels = {}
        for r in depth.orderBy("depth", "package").collect():  # packages, not nodes
            levels.setdefault(r["depth"], []).append(r["package"])
        policy["layers"] = [{"name": f"layer{k}", "packages": levels[k]} for k in sorted(levels)]
        policy["layering"] = {"allow": [], "roots": []}
    surface = written(route_surface(ix), "surface")
    quiet = surface.where("size(writes) = 0 AND size(unclassified) = 0").orderBy("route")
    readers = [r["route"] for r in quiet.select("route").limit(101).collect()]
    if readers and len(readers) <= 100:
        policy["must_not_reach"] = [{"name": "read-only", "from": readers, "to": [f"db {v}" for v in L.DML]}]
    elif readers:
        notes.append("read-only: more than 100 routes write nothing; name them by a package")
    most = surface.agg(F.max(F.size("writes"))).first()[0]
    policy["io_budget"] = {"max_writes_per_route": most or 0}
    under = concurrent_findings(ix, policy | {"no_concurrent_reach": [{"name": "x", "to": [f"db {v}" for v in L.DML] + ["bus PUBLISH"]}]})
    if under.where("severity = 'violation'").isEmpty() and under.where("summary LIKE '%blind%'").isEmpty():
        policy["no_concurrent_reach"] = [{"name": "no-concurrent-writes", "to": [f"db {v}" for v in L.DML]}]
    else:
        notes.append("concurrency: something writes, or is hidden, under concurrency")
    waypoint = propose_waypoint(ix)
    if waypoint:
        policy["must_pass_through"] = [{"name": "guard", "from": ["entrypoint:*"], "to": [f"db {v}" for v in L.DML], "through": [waypoint]}]
    if ix.spots is not None:
        policy["blind_spot_ratchet"] = {"gate": False, "allow": [{"kind": r["kind"], "site": r["site"]} for r in ix.spots.select("kind", "site").distinct().orderBy("kind", "site").limit(10_000).collect()]}
    writes = ix.labels.where(L.is_write(F.concat(F.lit("boundary:"), "label"))).select("label").distinct().orderBy("label").limit(10_000)
    policy["effect_ratchet"] = {"gate": False, "allow": [{"target": r["label"]} for r in writes.collect()]}
    for _ in range(passes):
        left = suite(ix, policy).where("severity = 'violation'").limit(few * 20).collect()
        if not left:
            break
        for rule in sorted({(r["rule"], r["name"]) for r in left}):
            mine = [r for r in left if (r["rule"], r["name"]) == rule]
            if rule[0] == "layering" and len(mine) <= few:
                policy["layering"]["allow"] += [{"from": r["from"], "to": r["to"], "reason": "as found"} for r in mine]
            else:
                notes.append(f"{rule[0]} {rule[1]}: dropped, it does not hold today")
                if rule[0] == "layering":
                    policy.pop("layering"), policy.pop("layers")
                else:
                    policy[rule[0]] = [r for r in policy[rule[0]] if r["name"] != rule[1]]
    return policy, notes


def package_depths(ix: GraphIndex, pkgs: DataFrame) -> DataFrame | None:
    """package, depth: the longest descent to a package from one that nobody calls; none on a circle."""
    all_ = ix.nodes.select(L.pkg_of("fqn").alias("package")).distinct()
    now = written(all_.select("package", F.lit(0).alias("depth")), "depths")
    for _ in range(all_.count() + 1):
        step = now.join(pkgs.withColumnRenamed("src", "package"), "package").select(F.col("dst").alias("package"), (F.col("depth") + 1).alias("depth"))
        new = written(now.unionByName(step).groupBy("package").agg(F.max("depth").alias("depth")), "depths")
        if new.join(now, ["package", "depth"], "left_anti").isEmpty():
            return new
        now = new
    return None


def propose_waypoint(ix: GraphIndex, tries: int = 20) -> str | None:
    """The first node, no root and no writer, without which no root reaches a database write."""
    writers = ix.labels.where(L.is_write(F.concat(F.lit("boundary:"), "label")) & F.startswith("label", F.lit("db "))).select(F.col("node").alias("fqn")).distinct()
    roots = ix.roots().select(F.lit("*").alias("seed"), F.col("fqn").alias("node"))
    onto = closure(writers.select(F.lit("*").alias("seed"), F.col("fqn").alias("node")), ix.reversed()).select(F.col("node").alias("fqn"))
    calls = ix.internal.groupBy(F.col("src").alias("fqn")).agg(F.count("*").alias("c"))
    good = onto.join(ix.roots(), "fqn", "left_anti").join(writers, "fqn", "left_anti").join(calls, "fqn").orderBy(F.desc("c"), "fqn").limit(tries)
    for r in good.collect():  # a few candidates, each one guarded closure
        edges = ix.internal.where(F.col("dst") != r["fqn"])
        free = closure(roots, edges).select(F.col("node").alias("fqn"))
        if free.join(writers, "fqn", "left_semi").isEmpty():
            return r["fqn"]
    return None
