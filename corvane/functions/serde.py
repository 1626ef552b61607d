"""Units as JSON, and envelopes that carry their kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import SCORES

CHUNK, FACT, ROW = "chunk", "graph_fact", "structured_row"
POSITION = "struct<start_byte:int,end_byte:int,page:int,section:array<string>>"
#: What each kind holds, by the names that its JSON has.
SCHEMAS = {
    CHUNK: f"id string, source_doc_id string, source_uri string, text string, vector array<float>, scores {SCORES}, position {POSITION}, token_count int, parent_id string, window_text string, context_prefix string, metadata variant",
    FACT: f"id string, source_doc_id string, source_uri string, subject string, predicate string, object string, scores {SCORES}, metadata variant",
    ROW: f"id string, source_doc_id string, source_uri string, scores {SCORES}, columns map<string,string>, metadata variant",
}
#: Columns whose JSON names differ.
RENAMED = {"unit_id": "id"}
#: Fields that are written even when they are empty.
ALWAYS = {"id", "source_doc_id", "text", "subject", "predicate", "object", "columns"}


def _fields(kind: str) -> list[tuple[str, str]]:
    out, depth, part = [], 0, ""
    for c in SCHEMAS[kind] + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, dtype = part.strip().partition(" ")
            out.append((name, dtype))
            part = ""
        else:
            part += c
    return out


def unit_json(kind: str, columns: list[str]) -> Column:
    """A unit's JSON from its row; empty optional fields are left out."""
    have = {RENAMED.get(c, c): c for c in columns}
    parts = []
    for name, dtype in _fields(kind):
        if name not in have:
            continue
        value = F.col(have[name]).cast(dtype)
        if name not in ALWAYS:
            empty = F.size(value) == 0 if dtype.startswith("array") else value == "" if dtype == "string" else value == 0 if dtype == "int" else F.lit(False)
            value = F.when(~F.coalesce(empty, F.lit(False)), value)
        parts.append(value.alias(name))
    return F.to_json(F.struct(*parts))


def wrap(kind: str, columns: list[str]) -> Column:
    """An envelope (type, data) around a unit."""
    if kind not in SCHEMAS:
        raise ValueError(f"unknown unit type {kind}")
    return F.struct(F.lit(kind).alias("type"), unit_json(kind, columns).alias("data"))


def unwrap(envelope: Column, kind: str) -> Column:
    """The unit in an envelope of that kind; null for other kinds, an error for unknown ones."""
    if kind not in SCHEMAS:
        raise ValueError(f"unknown unit type {kind}")
    held = F.from_json(envelope["data"], SCHEMAS[kind])
    known = envelope["type"].isin(list(SCHEMAS))
    return F.when(envelope["type"] == kind, held).when(~known, F.raise_error(F.concat(F.lit("unknown unit type "), envelope["type"])).cast(held_type(kind)))


def held_type(kind: str) -> str:
    return "struct<" + ",".join(f"{n}:{t}" for n, t in _fields(kind)) + ">"
