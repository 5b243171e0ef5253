"""Literal-free normal form of SQL text, by a vectorised (Arrow batch) UDF.

Literals, numbers and placeholders become ``?``; comments go (block comments nest); words of the
keyword list are upper case, others lower; quoted identifiers lose their quotes where the bare
form would read the same. Tokens are joined by single spaces, and only the lists after IN and
VALUES collapse: ``coalesce(?, ?)`` keeps its arguments. Literals are blanked first, so that the
few shapes of a large table are scanned once each and then looked up.

A character beyond ASCII outside quotes is a token of its own. Null and empty text give empty parts.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

#: Words written in upper case.
KEYWORDS = {
    "SELECT", "INSERT", "UPDATE", "DELETE", "FROM", "INTO", "WHERE", "VALUES", "SET", "AND", "OR", "IN", "JOIN", "LEFT", "RIGHT", "INNER",
    "OUTER", "ON", "AS", "ORDER", "BY", "GROUP", "HAVING", "LIMIT", "OFFSET", "RETURNING", "NULL", "IS", "NOT", "MERGE", "UPSERT", "REPLACE", "USING",
}
#: Words between UPDATE and its table.
UPDATE_QUALIFIERS = {"only", "low_priority", "ignore"}

STRING = r"'(?:\\.?|''|[^'\\])*(?:'|\Z)"
QUOTED = r'"(?:""|[^"])*"?|`(?:``|[^`])*`?'
TAG = r"\$(?:[A-Za-z_][A-Za-z0-9_]*)?\$"
TOKEN = re.compile(
    rf"(?P<skip>[ \t\n\r]+|--[^\n]*)|(?P<block>/\*)|(?P<value>{STRING}|(?P<tag>{TAG}).*?(?P=tag)|(?<![A-Za-z0-9_]){TAG}.*|[$:@][A-Za-z0-9_]*|\?|\.?[0-9][0-9.]*)"
    rf"|(?P<quoted>{QUOTED})|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<sign>.)", re.S)
#: What may be blanked ahead of scanning: each match is a whole token wherever it stands.
BLANK = re.compile(rf"--[^\n]*|{STRING}|{QUOTED}|(?<![A-Za-z0-9_$:@.])[0-9][0-9.]*", re.S)
HARD = re.compile(rf"/\*|{TAG}")
BLOCK_EDGE = re.compile(r"/\*|\*/")
LIST = r"\(\s*\?(?:\s*,\s*\?)*\s*\)"
IN_LIST = re.compile(rf"\bIN\s*{LIST}")
VALUES_LISTS = re.compile(rf"\bVALUES\s*{LIST}(?:\s*,\s*{LIST})*")


def _identifier(text: str) -> str:
    """A quoted identifier bare where it can be, else in double quotes."""
    q = text[0]
    body = text[1:-1] if len(text) > 1 and text[-1] == q else text[1:]
    low = body.replace(q + q, q).lower()
    if re.fullmatch(r"[a-z_][a-z0-9_]*", low) and low.upper() not in KEYWORDS:
        return low
    return '"' + low.replace('"', '""') + '"'


def tokenize(raw: str) -> list[str]:
    out, at = [], 0
    while at < len(raw):
        m = TOKEN.match(raw, at)
        at, text = m.end(), m.group()
        if m["block"]:
            depth = 1
            while depth:
                edge = BLOCK_EDGE.search(raw, at)
                if edge is None:  # an open comment eats the rest
                    return out
                depth += 1 if edge.group() == "/*" else -1
                at = edge.end()
        elif m["value"]:
            out.append("?")
        elif m["quoted"]:
            out.append(_identifier(text))
        elif m["word"]:
            up = text.upper()
            out.append(up if up in KEYWORDS else text.lower())
        elif m["sign"]:
            out.append(text)
    return out


def _table_at(tokens: list[str], at: int) -> str | None:
    """The table that a token names: a lower-case word or a quoted identifier."""
    if at >= len(tokens):
        return None
    token = tokens[at]
    if len(token) > 1 and token[0] == '"':
        return token[1:-1].replace('""', '"')
    return token if re.match(r"[a-z_]", token) else None


def _operation(tokens: list[str]) -> tuple[str, str]:
    op = tokens[0] if tokens else ""
    if op == "UPDATE":
        at = next((i for i, t in enumerate(tokens) if i and t not in UPDATE_QUALIFIERS), len(tokens))
        return op, _table_at(tokens, at) or ""
    ahead = {"SELECT": {"FROM"}}.get(op, {"INTO", "FROM"} if op in {"INSERT", "DELETE", "MERGE", "REPLACE", "UPSERT"} else set())
    found = (_table_at(tokens, i + 1) for i, t in enumerate(tokens) if t in ahead)
    return op, next((t for t in found if t is not None), "")


def _scan(raw: str) -> tuple[str, str, str]:
    tokens = tokenize(raw)
    text = VALUES_LISTS.sub("VALUES (?)", IN_LIST.sub("IN (?)", " ".join(tokens)))
    return (re.sub(r"\s+", " ", text).strip(), *_operation(tokens))


def _blank(m: re.Match) -> str:
    text = m.group()
    return " " if text[0] == "-" else text if text[0] in "\"`" else "?"


_shapes: dict[str, tuple[str, str, str]] = {}


def normalize(raw: str | None) -> tuple[str, str, str]:
    """(statement, operation, primary table)."""
    if not raw:
        return "", "", ""
    if HARD.search(raw):
        return _scan(raw)
    shape = BLANK.sub(_blank, raw)
    found = _shapes.get(shape)
    if found is None:
        if len(_shapes) >= 10_000:
            _shapes.clear()
        found = _shapes[shape] = _scan(shape)
    return found


def _batch(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([normalize(x) for x in raw], columns=["statement", "op", "table"])


def sql_normal_form(raw):
    """Column struct<statement, op, table> of a column of SQL text."""
    return F.pandas_udf(_batch, "statement string, op string, table string")(raw)
