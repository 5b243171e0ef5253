"""Spans of OTLP/JSON exports as a DataFrame.

A file may hold one export, several one after another (or one a line), or an array of them;
keys may be written in camel or snake case, and spans may stand under the older scope name. A
file with text but without an export fails the query. Resource attributes service.name, code stamp and
provenance go to each span that lacks them. Times stay whole nanoseconds; what is no number is 0.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from meshwright.sources import shapes
from meshwright.sources.documents import BadDocument, read_whole

#: Numbers of span kinds and of statuses.
KINDS = {2: "server", 3: "client", 4: "producer", 5: "consumer"}
STATUS = {1: "ok", 2: "error"}
FOLDED = ("service.name", "code.stamp", "capture.provenance")


def _plain(value: object) -> object:
    """Objects with keys in lower case and without underscores; two spellings of one key are an error."""
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            key = k.replace("_", "").lower()
            if key in out:
                raise BadDocument(f"two spellings of {key}")
            out[key] = _plain(v)
        return out
    return [_plain(v) for v in value] if isinstance(value, list) else value


def integer(raw: object) -> int | None:
    """A whole number of 64 bits, given as a number or as text; else none."""
    try:
        out = int(raw) if isinstance(raw, str | int) and not isinstance(raw, bool) else None
    except ValueError:
        return None
    return out if out is not None and -(1 << 63) <= out < 1 << 63 else None


def text_of(value: object) -> str:
    """The text of a typed attribute value."""
    if not isinstance(value, dict):
        return ""
    if value.get("stringvalue") is not None:
        return str(value["stringvalue"])
    if value.get("intvalue") is not None:
        n = integer(value["intvalue"])
        return "" if n is None else str(n)
    if value.get("boolvalue") is not None:
        return "true" if value["boolvalue"] else "false"
    if value.get("doublevalue") is not None:
        return f"{value['doublevalue']:g}"
    rest = {k: v for k, v in value.items() if v is not None}
    return json.dumps(next(iter(rest.values()))) if rest else ""


def _attrs(items: object) -> dict[str, str]:
    return {kv.get("key", ""): text_of(kv.get("value")) for kv in items or []}


def exports(text: str) -> Iterator[dict]:
    """The export requests of a text."""
    decoder, at, n = json.JSONDecoder(), 0, len(text)
    while True:
        while at < n and text[at] in " \t\r\n":
            at += 1
        if at == n:
            return
        try:
            value, at = decoder.raw_decode(text, at)
        except json.JSONDecodeError as e:
            raise BadDocument(f"no JSON: {e}") from e
        yield from (_plain(v) for v in (value if isinstance(value, list) else [value]))


def spans_of(text: str) -> Iterator[dict]:
    seen = False
    for export in exports(text):
        if not isinstance(export, dict) or "resourcespans" not in export:
            raise BadDocument("no resourceSpans")
        seen = True
        for resource in export["resourcespans"] or []:
            shared = _attrs((resource.get("resource") or {}).get("attributes"))
            for scope in [*(resource.get("scopespans") or []), *(resource.get("instrumentationlibraryspans") or [])]:
                for s in scope.get("spans") or []:
                    attrs = {k: shared[k] for k in FOLDED if shared.get(k)} | _attrs(s.get("attributes"))
                    status = STATUS.get((s.get("status") or {}).get("code"), "")
                    yield {
                        "trace_id": s.get("traceid") or "", "id": s.get("spanid") or "", "parent": s.get("parentspanid") or None, "name": s.get("name") or "",
                        "kind": KINDS.get(s.get("kind"), "internal"), "status": status, "error_type": (attrs.get("error.type") or "error") if status == "error" else "",
                        "start_ns": integer(s.get("starttimeunixnano")) or 0, "end_ns": integer(s.get("endtimeunixnano")) or 0, "attrs": list(attrs.items()),
                        "links": [{"trace_id": x.get("traceid") or "", "id": x.get("spanid") or ""} for x in s.get("links") or []]}
    if text.strip() and not seen:
        raise BadDocument("no export request")


def read_otlp(spark: SparkSession, path: str) -> DataFrame:
    """Spans of a file or of every JSON file of a folder, with their file."""
    schema = "file string, " + shapes.SPAN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(shapes.ddl(schema))
        for batch in batches:
            for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True):
                try:
                    rows = [{"file": file, **s} for s in spans_of(text or "")]
                except BadDocument as e:
                    raise BadDocument(f"{file}: {e}") from e
                for at in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 4096], arrow)

    return read_whole(spark, path).mapInArrow(run, schema)
