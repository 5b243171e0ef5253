"""Texts of results: canonical JSON, SARIF, Mermaid flowcharts and sequence diagrams, cards.

Everything is a pure function of its input in a total order; what a cap leaves out is counted.
Renderers take what a person can read: rows are collected sorted, at most one more than the cap.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.functions import labels as L
from meshwright.functions import symbols as Y
from meshwright.operators.graph import GraphIndex, closure

ORDERS = {
    "nodes": ("fqn", "sig"), "edges": ("from", "to", "boundary", "tier", "concurrent", "via"), "blind_spots": ("site", "kind", "detail"), "entrypoints": ("kind", "name", "fn"),
    "obligations": ("rule", "fn", "site"), "effect_order": ("fn", "effect", "effect_site", "callee", "callee_site"), "annotations": ("site", "kind", "note")}


def canonical_json(value: object) -> str:
    """Two spaces, sorted keys, no escapes beyond JSON's own, one newline at the end."""
    return json.dumps(value, indent=2, ensure_ascii=False, sort_keys=True) + "\n"


def sorted_graph(graph: dict) -> dict:
    """A graph document with every list in its order and equal edge records once."""
    out = {k: v for k, v in graph.items() if v not in (None, [], "")}
    for key, by in ORDERS.items():
        if key in out:
            rows = {json.dumps(r, sort_keys=True): r for r in out[key]}.values() if key == "edges" else out[key]
            out[key] = sorted(rows, key=lambda r: tuple(str(r.get(k) or "") for k in by))
    out.setdefault("nodes", [])
    return out


def write_graph(graph: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as out:
        out.write(canonical_json(sorted_graph(graph)))


def is_current(path: str, document: dict) -> bool:
    """Whether a committed document is byte for byte what would be written."""
    try:
        with open(path, encoding="utf-8") as f:
            return f.read() == canonical_json(document)
    except FileNotFoundError:
        return False


def first_divergence(want: str, got: str) -> str:
    """The first line in which two texts differ; empty where none does."""
    a, b = want.split("\n"), got.split("\n")
    for k in range(max(len(a), len(b))):
        x, y = (t[k] if k < len(t) else "(end)" for t in (a, b))
        if x != y:
            return f"line {k + 1}:\n- {x}\n+ {y}"
    return ""


def capped(df: DataFrame, cap: int) -> tuple[list, int]:
    """The first rows of a sorted table and how many more there are."""
    rows = df.limit(cap + 1).collect()
    return rows[:cap], 0 if len(rows) <= cap else df.count() - cap


def sarif(findings: DataFrame, caveats: list[str] | None = None, tool: str = "meshwright", cap: int = 5000) -> str:
    """Findings as SARIF 2.1.0; ``to`` that reads file:line is a place."""
    rows, more = capped(findings.orderBy(F.desc("severity"), "rule", "from", "to", "summary"), cap)
    results = []
    for r in rows:
        one = {"ruleId": r["rule"], "level": "error" if r["severity"] == "violation" else "warning", "message": {"text": r["summary"]}}
        place = re.fullmatch(r"(.+\.\w+):(\d+)(?::\d+)?", r["to"] or "")
        if place:
            one["locations"] = [{"physicalLocation": {"artifactLocation": {"uri": place[1]}, "region": {"startLine": int(place[2])}}}]
        results.append(one)
    notes = [*(caveats or []), *([f"{more} more findings are left out"] if more else [])]
    run = {"tool": {"driver": {"name": tool, "rules": [{"id": x} for x in sorted({r["rule"] for r in rows})]}}, "results": results}
    if notes:
        run["invocations"] = [{"executionSuccessful": True, "toolExecutionNotifications": [{"level": "note", "message": {"text": n}} for n in notes]}]
    return canonical_json({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]})


# ---- flowcharts


def _quoted(text: str) -> str:
    return '"' + text.replace('"', "#quot;").replace("<", "&lt;").replace(">", "&gt;") + '"'


class _Ids(dict):
    def __missing__(self, key: str) -> str:
        self[key] = f"n{len(self)}"
        return self[key]


def flowchart(ix: GraphIndex, names: DataFrame | None = None, max_nodes: int = 300, max_tier: int | None = None, direction: str = "LR") -> str:
    """Nodes, calls and effects, all or those of ``names`` (column fqn); above the cap, only the roots."""
    nodes = ix.nodes if names is None else ix.nodes.join(names.select("fqn").distinct(), "fqn", "left_semi")
    if max_tier is not None:
        nodes = nodes.where(F.col("tier") <= max_tier)
    rows, more = capped(nodes.select("fqn").distinct().orderBy("fqn"), max_nodes)
    if more:
        heads, hidden = capped(ix.roots().join(nodes.select("fqn"), "fqn", "left_semi").orderBy("fqn"), max_nodes)
        lines = [f"flowchart {direction}", f"  %% {len(rows) + more} nodes are over the cap of {max_nodes}: entrypoints only"]
        lines += [f"  n{k}[{_quoted(r['fqn'].rsplit('/', 1)[-1])}]" for k, r in enumerate(heads)]
        return "\n".join([*lines, *([f"  %% {hidden} more entrypoints"] if hidden else [])]) + "\n"
    kept = nodes.select("fqn").distinct()
    calls = ix.internal.join(kept.withColumnRenamed("fqn", "src"), "src", "left_semi").join(kept.withColumnRenamed("fqn", "dst"), "dst", "left_semi").select("src", "dst").orderBy("src", "dst").collect()
    effects = ix.labels.join(kept.withColumnRenamed("fqn", "node"), "node", "left_semi").orderBy("node", "label").collect()
    spots = [] if ix.spots is None else ix.spots.select("site", "kind").distinct().join(kept.withColumnRenamed("fqn", "site"), "site", "left_semi").orderBy("site", "kind").collect()
    ids = _Ids()
    lines = [f"flowchart {direction}"] + [f"  {ids[r['fqn']]}[{_quoted(r['fqn'].rsplit('/', 1)[-1])}]" for r in rows]
    lines += [f"  {ids['=' + x]}[({_quoted(x)})]" for x in sorted({r["label"] for r in effects})]
    lines += [f"  {ids[r['src']]} --> {ids[r['dst']]}" for r in calls] + [f"  {ids[r['node']]} ==> {ids['=' + r['label']]}" for r in effects]
    lines += [f"  {ids[r['site']]} -.- {ids['?' + r['site'] + r['kind']]}{{{{{_quoted(r['kind'])}}}}}" for r in spots]
    return "\n".join(lines) + "\n"


def focused(ix: GraphIndex, queries: list[str], **options) -> str:
    """The flowchart of resolved names; a name that is unknown or ambiguous is an error."""
    q = ix.nodes.sparkSession.createDataFrame([(x,) for x in queries], "query string")
    got = Y.resolve(ix.nodes.select(F.col("fqn").alias("name")), q)
    bad = got.where("outcome IN ('unresolved', 'ambiguous')").orderBy("query", "name").first()
    if bad:
        raise ValueError(f"{bad['query']}: {bad['outcome']}")
    return flowchart(ix, got.select(F.col("name").alias("fqn")), **options)


def rooted(ix: GraphIndex, root: str, **options) -> str:
    """The flowchart of all that a root reaches."""
    seed = ix.nodes.where(F.col("fqn") == root).select(F.col("fqn").alias("seed"))
    return flowchart(ix, closure(seed, ix.internal).select(F.col("node").alias("fqn")).unionByName(seed.withColumnRenamed("seed", "fqn")), **options)


def diff_chart(base: GraphIndex, branch: GraphIndex, max_changes: int = 300) -> str:
    """Added and removed nodes and calls of a branch, with the kept ends of changed calls."""
    def sides(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
        both = a.distinct().withColumn("a", F.lit(True)).join(b.distinct().withColumn("b", F.lit(True)), cols, "full_outer")
        return both.select(*cols, F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("kept").alias("state"))

    nodes = sides(base.nodes.select("fqn"), branch.nodes.select("fqn"), ["fqn"]).where("state <> 'kept'").orderBy("fqn")
    calls = sides(base.internal, branch.internal, ["src", "dst"]).where("state <> 'kept'").orderBy("src", "dst")
    (n, n_more), (c, c_more) = capped(nodes, max_changes), capped(calls, max_changes)
    ids, state = _Ids(), {r["fqn"]: r["state"] for r in n}
    names = sorted(set(state) | {x for r in c for x in (r["src"], r["dst"])})
    lines = ["flowchart LR"] + [f"  {ids[x]}[{_quoted(x.rsplit('/', 1)[-1])}]:::{state.get(x, 'kept')}" for x in names]
    lines += [f"  {ids[r['src']]} {'-->' if r['state'] == 'added' else '-.->'}|{r['state']}| {ids[r['dst']]}" for r in c]
    lines += ["  classDef added fill:#cfc", "  classDef removed fill:#fcc", "  classDef kept fill:#eee"]
    return "\n".join([*lines, *([f"  %% {n_more} more nodes, {c_more} more calls"] if n_more or c_more else [])]) + "\n"


def package_chart(ix: GraphIndex, max_edges: int = 300) -> str:
    """Packages by lane, and how many calls go between them."""
    pairs = ix.internal.select(L.pkg_of("src").alias("a"), L.pkg_of("dst").alias("b")).where("a <> b").groupBy("a", "b").count().orderBy("a", "b")
    rows, more = capped(pairs, max_edges)
    packages = ix.nodes.select(L.pkg_of("fqn").alias("p")).distinct().select("p", Y.band("p").alias("band")).orderBy("band", "p").limit(10 * max_edges).collect()
    ids, lines = _Ids(), ["flowchart TB"]
    for lane in dict.fromkeys(r["band"] for r in packages):
        lines += [f"  subgraph {lane}", *(f"    {ids[r['p']]}[{_quoted(r['p'])}]" for r in packages if r["band"] == lane), "  end"]
    lines += [f"  {ids[r['a']]} -->|{r['count']}| {ids[r['b']]}" for r in rows]
    return "\n".join([*lines, *([f"  %% {more} more pairs"] if more else [])]) + "\n"


def sequence(trace: DataFrame, across: bool = False) -> str:
    """The sequence diagram of one canonical trace (rows of the trace reader)."""
    rows = trace.orderBy("at").collect()  # one trace
    at = {tuple(r["at"]): r for r in rows}
    own = lambda r: r["own_service"] or r["service"] if across else r["service"]
    ids, lines = _Ids(), ["sequenceDiagram"]
    for r in rows:
        key = tuple(r["at"])
        up = at.get(key[:-2]) if len(key) >= 2 else None
        caller = own(up) if up else "caller"
        callee = r["peer"] or own(r)
        mark = "-)" if r["async"] or (r["op"] or "").startswith("PUBLISH ") else "->>"
        note = f" [{r['multiplicity']}]" if r["multiplicity"] not in (None, "1") else ""
        note += " [par]" if r["concurrent"] else " [any order]" if r["unordered"] else ""
        lines.append(f"  {ids[caller]}{mark}{ids[callee]}: {r['op']}{note}" + (" ✗" if r["status"] == "error" else ""))
    heads = [f"  participant {v} as {k}" for k, v in ids.items()]
    return "\n".join([lines[0], *heads, *lines[1:]]) + "\n"


def service_graph(edges: DataFrame, cap: int = 500) -> str:
    """A flowchart of (src, dst, label) between services, each triple once."""
    rows, more = capped(edges.select("src", "dst", "label").distinct().orderBy("src", "dst", "label"), cap)
    ids = _Ids()
    names = sorted({x for r in rows for x in (r["src"], r["dst"])})
    lines = ["flowchart LR", *(f"  {ids[x]}[{_quoted(x)}]" for x in names), *(f"  {ids[r['src']]} -->|{_quoted(r['label'])}| {ids[r['dst']]}" for r in rows)]
    return "\n".join([*lines, *([f"  %% {more} more"] if more else [])]) + "\n"


# ---- texts


def table_text(title: str, df: DataFrame, order: list[str], cap: int = 100) -> str:
    """A Markdown table of a report: title, sorted rows, what is left out."""
    rows, more = capped(df.orderBy(*order), cap)
    head = "| " + " | ".join(df.columns) + " |\n|" + "-|" * len(df.columns)
    body = ["| " + " | ".join(str(x if x is not None else "").replace("|", "\\|") for x in r) + " |" for r in rows]
    return "\n".join([f"## {title}", "", head, *body, *([f"(+{more} more)"] if more else [])]) + "\n"


def artifact_text(artifact: dict) -> str:
    """The review artifact for a reader."""
    lines = [f"{artifact['service']}: {artifact['verdict']} ({artifact['shape']})"]
    for key, title in (("new_violations", "New violations"), ("new_cautions", "New cautions"), ("contract_changes", "Contract"), ("io_effects", "Effects"), ("new_blind_spots", "New blind spots"), ("new_write_targets", "New writes")):
        rows = artifact.get(key) or []
        if rows:
            lines += [f"{title}:"] + ["  " + (" ".join(str(v) for v in r.values() if v not in (None, "", False)) if isinstance(r, dict) else str(r)) for r in rows]
    return "\n".join([*lines, f"digest {artifact['digest']}"]) + "\n"


def gate_text(result: dict) -> str:
    return "\n".join([("PASS" if result["pass"] else "BLOCK") + f" ({result['verdict']})", *(f"  {r}" for r in result["reasons"])]) + "\n"


# ---- diagrams from manifests


def manifest_chart(manifest: dict, graphs: dict[str, GraphIndex]) -> str:
    """Calls among the nodes that a manifest names, drawn solid, and its overlays, dashed.

    Repeated ids, unknown or ambiguous names, graphs that nothing uses and overlay edges that say what a
    call already says are errors.
    """
    ids = [n["id"] for n in manifest["nodes"]] + [n["id"] for n in (manifest.get("overlays") or {}).get("nodes") or []]
    if len(set(ids)) != len(ids):
        raise ValueError("an id is given twice")
    unused = set(graphs) - {n["graph"] for n in manifest["nodes"]}
    if unused:
        raise ValueError(f"no node is of {', '.join(sorted(unused))}")
    drawn, of = set(), {}
    for name, ix in sorted(graphs.items()):
        mine = [n for n in manifest["nodes"] if n["graph"] == name]
        q = ix.nodes.sparkSession.createDataFrame([(n["fn"],) for n in mine], "query string")
        found = Y.resolve(ix.nodes.select(F.col("fqn").alias("name")), q).collect()
        for r in found:
            if r["outcome"] != "ok":
                raise ValueError(f"{r['query']}: {r['outcome']}")
        names = {r["query"]: r["name"] for r in found}
        of[name] = {names[n["fn"]]: n["id"] for n in mine}
        kept = ix.nodes.sparkSession.createDataFrame([(x,) for x in of[name]], "x string")
        pairs = ix.internal.join(F.broadcast(kept.withColumnRenamed("x", "src")), "src", "left_semi").join(F.broadcast(kept.withColumnRenamed("x", "dst")), "dst", "left_semi")
        drawn |= {(of[name][r["src"]], of[name][r["dst"]]) for r in pairs.collect()}
    over = (manifest.get("overlays") or {}).get("edges") or []
    for e in over:
        if (e["from"], e["to"]) in drawn:
            raise ValueError(f"{e['from']} to {e['to']} is a call already")
        if not {e["from"], e["to"]} <= set(ids):
            raise ValueError(f"{e['from']} to {e['to']}: no such node")
    lines = [f"flowchart {manifest.get('direction') or 'LR'}", f"  %% {manifest['id']}"]
    inside = {x: g for g in manifest.get("subgraphs") or [] for x in g["nodes"]}
    lines += [f"  {n['id']}[{_quoted(n['label'])}]" for n in manifest["nodes"] if n["id"] not in inside]
    for g in manifest.get("subgraphs") or []:
        lines += [f"  subgraph {g['id']}[{_quoted(g.get('title') or g['id'])}]", *(f"    {n['id']}[{_quoted(n['label'])}]" for n in manifest["nodes"] if n["id"] in g["nodes"]), "  end"]
    lines += [f"  {n['id']}([{_quoted(n.get('label') or n['id'])}])" for n in (manifest.get("overlays") or {}).get("nodes") or []]
    lines += [f"  {a} --> {b}" for a, b in sorted(drawn)] + [f"  {e['from']} -.->{'|' + _quoted(e['label']) + '|' if e.get('label') else ''} {e['to']}" for e in over]
    return "\n".join(lines) + "\n"


def check_diagram(markdown: str, generated: str, manifest_id: str) -> None:
    """An error unless the fenced block of a manifest in a Markdown text is the generated one."""
    for block in re.findall(r"```mermaid\n(.*?)```", markdown, re.S):
        if f"%% {manifest_id}\n" in block:
            if block != generated:
                raise ValueError(f"{manifest_id} is out of date: {first_divergence(block, generated)}")
            return
    raise ValueError(f"{manifest_id} is not in the file")
