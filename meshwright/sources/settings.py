"""Settings of an analysis: found upwards from a folder, strict keys, JSON or flat YAML."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from meshwright.sources.documents import BadDocument

NAMES = ("meshwright.json", "meshwright.yaml")


@dataclass
class Settings:
    """What an analysis may be told."""

    service: str = ""
    order_guard_ms: int = 100
    high_fan_out: int = 8
    max_render_nodes: int = 300
    short_hex_ids: bool = False
    allow_attrs: list[str] = field(default_factory=list)
    pins: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for f in fields(self):
            want = {"str": str, "int": int, "bool": bool}.get(f.type, list if f.type.startswith("list") else dict)
            value = getattr(self, f.name)
            if not isinstance(value, want) or want is int and isinstance(value, bool):
                raise BadDocument(f"{f.name}: {f.type} is expected")
        if self.order_guard_ms < 0 or self.high_fan_out < 1 or self.max_render_nodes < 1:
            raise BadDocument("a limit is out of range")
        if any(t not in (1, 2, 3, 4) for t in self.pins.values()):
            raise BadDocument("pins: tiers are 1 to 4")


def discover(start: str) -> str | None:
    """The nearest folder, from start upwards, that holds settings."""
    here = Path(start).resolve()
    return next((str(d) for d in (here, *here.parents) if any((d / n).is_file() for n in NAMES)), None)


def parse(text: str) -> Settings:
    """JSON, or lines of key: value where values are JSON or plain text. Unknown keys are errors."""
    if text.lstrip().startswith("{"):
        got = json.loads(text)
    else:
        got = {}
        for line in text.splitlines():
            line = line.split(" #")[0].rstrip()
            if not line or line.startswith("#"):
                continue
            key, colon, value = line.partition(":")
            if not colon or key != key.strip() or key in got:
                raise BadDocument(f"not understood: {line!r}")
            try:
                got[key] = json.loads(value)
            except json.JSONDecodeError:
                got[key] = value.strip()
    unknown = set(got) - {f.name for f in fields(Settings)}
    if unknown:
        raise BadDocument(f"unknown keys: {', '.join(sorted(unknown))}")
    return Settings(**got)


def load(folder: str) -> Settings:
    return parse(next((Path(folder) / n).read_text() for n in NAMES if (Path(folder) / n).is_file()))
