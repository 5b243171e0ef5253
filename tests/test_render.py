import json

import pytest
from meshwright import render as R
from test_policy import EDGES, EFFECTS, POLICY, graph


def test_documents(tmp_path):
    g = {"nodes": [{"fqn": "b"}, {"fqn": "a"}], "edges": [{"from": "b", "to": "a"}, {"from": "a", "to": "b"}, {"to": "a", "from": "b"}], "caveats": []}
    path = str(tmp_path / "g.json")
    R.write_graph(g, path)
    doc = R.sorted_graph(g)
    assert [e["from"] for e in doc["edges"]] == ["a", "b"] and "caveats" not in doc and R.is_current(path, doc) and not R.is_current(path, g) and not R.is_current(path + "x", doc)
    assert R.canonical_json({"b": "<é>", "a": 1}) == '{\n  "a": 1,\n  "b": "<é>"\n}\n'
    assert R.first_divergence("a\nb", "a\nc") == "line 2:\n- b\n+ c" and R.first_divergence("a", "a") == "" and "(end)" in R.first_divergence("a", "a\nb")


def test_charts(spark):
    ix = graph(spark, spots=[("a/db.W", "Reflect", "d")])
    chart = R.flowchart(ix)
    assert chart.startswith("flowchart LR\n") and chart.count("-->") == len(EDGES) and chart.count("==>") == len(EFFECTS) and "{{" in chart and "&lt;dynamic&gt;" in chart
    assert "over the cap" in R.flowchart(ix, max_nodes=3) and chart == R.flowchart(ix)
    assert "svc.S" in R.rooted(ix, "a/api.H") and "util.U" not in R.rooted(ix, "a/api.H") and "api.G" in R.focused(ix, ["api.G"])
    with pytest.raises(ValueError, match="unresolved"):
        R.focused(ix, ["zz"])
    diff = R.diff_chart(ix, graph(spark, [*EDGES[1:], ("a/api.R", "a/new.N")]))
    assert ":::added" in diff and "|removed|" in diff and "subgraph storage" not in R.package_chart(ix) and "subgraph transport" in R.package_chart(ix)
    rows = spark.createDataFrame([("layering", "violation", "s1", "f", "x/y.go:12"), ("io_budget", "caution", "s2", "f", "")], "rule string, severity string, summary string, `from` string, `to` string")
    out = json.loads(R.sarif(rows, ["algo"], cap=1))["runs"][0]
    assert out["results"][0]["locations"][0]["physicalLocation"]["region"]["startLine"] == 12 and len(out["invocations"][0]["toolExecutionNotifications"]) == 2
    assert "(+1 more)" in R.table_text("t", rows, ["rule"], 1) and "n0 -->|" in R.service_graph(spark.createDataFrame([("a", "b", "x"), ("a", "b", "x")], "src string, dst string, label string"))


def test_manifests_and_texts(spark):
    ix = graph(spark)
    m = {"id": "m1", "direction": "TB", "nodes": [{"id": "h", "graph": "g", "fn": "api.H", "label": "H"}, {"id": "s", "graph": "g", "fn": "svc.S", "label": "S"}], "subgraphs": [{"id": "x", "nodes": ["s"]}], "overlays": {"nodes": [{"id": "o"}], "edges": [{"from": "s", "to": "o", "label": "later"}]}}
    text = R.manifest_chart(m, {"g": ix})
    assert "  h --> s\n" in text and '-.->|"later"| o' in text
    R.check_diagram(f"x\n```mermaid\n{text}```\n", text, "m1")
    for bad, why in ((m | {"overlays": {"edges": [{"from": "h", "to": "s"}]}}, "already"), (m | {"nodes": m["nodes"] * 2}, "twice")):
        with pytest.raises(ValueError, match=why):
            R.manifest_chart(bad, {"g": ix})
    for md in ("", f"```mermaid\n{text}x\n```"):
        with pytest.raises(ValueError, match="m1"):
            R.check_diagram(md, text, "m1")
    art = {"service": "s", "verdict": "BLOCK", "shape": "broad", "new_violations": [{"rule": "r", "summary": "x"}], "contract_changes": [], "new_write_targets": ["db INSERT t"], "digest": "d"}
    assert "New writes:\n  db INSERT t" in R.artifact_text(art) and R.gate_text({"pass": False, "verdict": "BLOCK", "reasons": ["why"]}) == "BLOCK (BLOCK)\n  why\n" and POLICY
    trace = spark.createDataFrame([("f", "s", [], "HTTP GET /", "server", "", None, "ok", False, False, False, None), ("f", "s", [0, 0], "PUBLISH e", "producer", "Bus", None, "error", False, True, False, "1..*")],
                                  "flow string, service string, at array<int>, op string, kind string, peer string, own_service string, status string, async boolean, concurrent boolean, unordered boolean, multiplicity string")
    assert R.sequence(trace).splitlines()[-1] == "  n1-)n2: PUBLISH e [1..*] [par] ✗"
