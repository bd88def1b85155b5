"""Chat formatting with tool-call linking.

Input rows are messages (conv_id, turn, role, text). A message whose text is a JSON object may carry
``tool_calls`` (a list of ``{"id", "name", "arguments"}``, or the ``{"function": {...}}`` form); a message of role ``tool`` carries
``{"tool_call_id", "content"}``. Calls and results are hash-joined by conversation and identifier, put in topological
order, call arguments are validated against the tools' schemas, and every message is serialised as canonical JSON
(sorted keys, no spaces, no escapes but those JSON requires).

Output: one row for each message, so that a conversation of any length is never gathered. Sorting a conversation by
(place, depth, turn, message_id) gives the order: a message comes after all it depends on (a result on its call, a
call on earlier results it names as ``{"$ref": id}`` in its arguments), else by turn. ``status`` is ``ok``,
``orphan_result`` (no such call), ``unanswered_call``, ``invalid_arguments``, ``unknown_tool``, ``malformed``, or
``cycle`` (it depends on itself; such messages keep their own turn). Of several, the first in the list cycle, malformed, orphan_result,
unknown_tool, invalid_arguments, unanswered_call counts.

Rows: null texts are empty content; null roles become ``user``; a null conv_id is a conversation of its own kind and
links nothing; repeated rows are kept, each with its row; of several calls with one identifier the one of the
smallest turn is linked (ties: the smaller message_id); an empty table gives no rows; other columns are ignored. Only rows that
look like tool messages (text starts with ``{``, or role ``tool``) take part in joins.
"""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch, sized

_LOADED = "struct<calls array<struct<id string, name string, refs array<string>, valid boolean, known boolean>>, result string, malformed boolean, json string>"
_TYPES = {"string": str, "object": dict, "array": list, "boolean": bool}


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def valid(value: Any, schema: Any) -> bool:
    """Whether a value fits a JSON schema of type, enum, const, properties, required, additionalProperties, items and bounds."""
    if schema is True or schema == {}:
        return True
    if not isinstance(schema, dict):
        return False
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in (kinds if isinstance(kinds, list) else [kinds])):
        return False
    if "enum" in schema and value not in schema["enum"] or "const" in schema and value != schema["const"]:
        return False
    if isinstance(value, dict):
        props = schema.get("properties", {})
        if any(k not in value for k in schema.get("required", [])):
            return False
        extra = schema.get("additionalProperties", True)
        return all(valid(v, props[k]) if k in props else extra is not False and valid(v, extra) for k, v in value.items())
    if isinstance(value, list):
        return schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)) and all(valid(v, schema.get("items", True)) for v in value)
    if isinstance(value, str):
        return schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value))
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return schema.get("minimum", value) <= value <= schema.get("maximum", value)
    return True


def _is(value: Any, kind: str) -> bool:
    if kind == "null":
        return value is None
    if kind in ("number", "integer"):
        return not isinstance(value, bool) and isinstance(value, (int, float) if kind == "number" else int)
    return kind in _TYPES and isinstance(value, _TYPES[kind])


def _refs(value: Any) -> list[str]:
    if isinstance(value, dict):
        own = [value["$ref"]] if set(value) == {"$ref"} and isinstance(value["$ref"], str) else []
        return own + [r for v in value.values() for r in _refs(v)]
    return [r for v in value for r in _refs(v)] if isinstance(value, list) else []


def _reject(name: str) -> Any:
    raise ValueError(name)


def _finite(text: str) -> float:
    x = float(text)
    return x if abs(x) < float("inf") else _reject(text)


def _read(text: str) -> Any:
    """A JSON value that can be written again and walked through: finite numbers, valid Unicode, not too many levels."""
    value = json.loads(text, parse_constant=_reject, parse_float=_finite)
    canonical(value).encode()
    _refs(value)
    return value


def load(role: str | None, text: str | None, schemas: dict[str, Any]) -> dict[str, Any]:
    """A message's calls, the call that it answers, and its canonical JSON.

    A tool message, or one that names ``tool_calls``, is malformed and kept as plain content where its JSON cannot be read,
    written again or walked through (no JSON, numbers beyond double precision, lone surrogates, too many levels).
    """
    role, text = role or "user", text or ""
    plain = {"calls": [], "result": None, "malformed": False, "json": canonical({"role": role, "content": text})}
    if role != "tool" and not text.lstrip().startswith("{"):
        return plain
    broken = plain | {"malformed": role == "tool" or '"tool_calls"' in text}
    try:
        body = _read(text)
        if not isinstance(body, dict) or not ("tool_call_id" in body if role == "tool" else isinstance(body.get("tool_calls"), list)):
            return plain | {"malformed": role == "tool"}
        return _tool_message(role, body, schemas)
    except (ValueError, RecursionError):
        return broken


def _tool_message(role: str, body: dict[str, Any], schemas: dict[str, Any]) -> dict[str, Any]:
    if role == "tool":
        key = body["tool_call_id"]
        known = isinstance(key, str)
        return {"calls": [], "result": key if known else None, "malformed": not known, "json": canonical({"role": role, **body})}
    calls, clean, bad = [], [], False
    for call in body["tool_calls"]:
        inner = call.get("function", call) if isinstance(call, dict) else None
        if not isinstance(inner, dict) or not isinstance(call.get("id"), str) or not isinstance(inner.get("name"), str):
            bad = True
            clean.append(call)
            continue
        args = inner.get("arguments", {})
        if isinstance(args, str):
            try:
                args = _read(args)
            except (ValueError, RecursionError):
                bad = True
        schema = schemas.get(inner["name"])
        filled = isinstance(args, dict)
        calls.append({"id": call["id"], "name": inner["name"], "refs": _refs(args), "known": schema is not None or not schemas, "valid": filled and (schema is None or valid(args, schema))})
        clean.append({"id": call["id"], "name": inner["name"], "arguments": args})
    return {"calls": calls, "result": None, "malformed": bad, "json": canonical({"role": role, **body, "tool_calls": clean})}


def format_chats(messages: DataFrame, schemas: dict[str, Any] | None = None) -> DataFrame:
    """(conv_id, turn, message_id, place, depth, role, status, json), one row for each message."""
    scratch, known = Scratch(messages.sparkSession, "chat"), dict(schemas or {})

    @F.arrow_udf(_LOADED)
    def parse(role: pa.Array, text: pa.Array) -> pa.Array:
        call = pa.struct([("id", pa.string()), ("name", pa.string()), ("refs", pa.list_(pa.string())), ("valid", pa.bool_()), ("known", pa.bool_())])
        kind = pa.struct([("calls", pa.list_(call)), ("result", pa.string()), ("malformed", pa.bool_()), ("json", pa.string())])
        return pa.array([load(r, t, known) for r, t in zip(role.to_pylist(), text.to_pylist(), strict=True)], kind)

    m = messages.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    m = m.select("conv_id", "turn", F.xxhash64("conv_id", "turn", "role", "text").alias("message_id"), F.coalesce("role", F.lit("user")).alias("role"), parse("role", "text").alias("p"))
    m = scratch.cut(m.select("conv_id", "turn", "message_id", "role", "p.*"))
    linkable = m.where("conv_id is not null and (size(calls) > 0 or result is not null)")

    calls = linkable.select("conv_id", "turn", "message_id", F.explode("calls").alias("c"))
    owner = calls.groupBy("conv_id", F.col("c.id").alias("id")).agg(F.min(F.struct(F.coalesce("turn", F.lit(-1)).alias("turn"), "message_id")).alias("o"))
    owner = owner.select("conv_id", "id", F.col("o.message_id").alias("to"))
    results = linkable.where("result is not null").select("conv_id", "message_id", F.col("result").alias("id")).distinct()
    answers = scratch.cut(results.join(owner, ["conv_id", "id"], "left").select("conv_id", "message_id", "id", "to"))
    first_answer = answers.where("to is not null").groupBy("conv_id", "id").agg(F.min("message_id").alias("by"))
    needs = calls.select("conv_id", "message_id", "c.id").distinct().join(first_answer.select("conv_id", "id"), ["conv_id", "id"], "left_anti")
    open_calls = needs.groupBy("conv_id", "message_id").agg(F.lit(True).alias("open"))
    named = calls.select("conv_id", "message_id", F.explode("c.refs").alias("id")).distinct()
    edges = answers.where("to is not null").select("conv_id", F.col("message_id").alias("a"), F.col("to").alias("b"))
    edges = edges.union(named.join(first_answer, ["conv_id", "id"]).select("conv_id", F.col("message_id").alias("a"), F.col("by").alias("b")))
    edges = scratch.cut(edges.distinct())
    placed = _places(linkable.select("conv_id", "turn", "message_id"), edges, scratch)

    orphan = answers.groupBy("conv_id", "message_id").agg(F.max(F.col("to").isNull()).alias("orphan"))
    extra = placed.join(orphan, ["conv_id", "message_id"], "left").join(open_calls, ["conv_id", "message_id"], "left")
    extra = scratch.cut(extra)
    out = m.join(sized(extra, extra.count()), ["conv_id", "message_id"], "left")
    status = F.when(F.col("cyclic"), "cycle").when(F.col("malformed"), "malformed").when(F.col("orphan"), "orphan_result")
    status = status.when(F.exists("calls", lambda c: ~c["known"]), "unknown_tool").when(F.exists("calls", lambda c: ~c["valid"]), "invalid_arguments")
    status = status.when(F.col("open"), "unanswered_call").otherwise("ok")
    return out.select("conv_id", "turn", "message_id", F.coalesce("place", "turn").alias("place"), F.coalesce("depth", F.lit(0)).alias("depth"), "role", status.alias("status"), "json")


def _places(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Topological places by rounds: each settles the messages all of whose dependencies are settled.

    place is the largest turn among a message and all it depends on, depth the longest chain to it at that place.
    """
    n = nodes.groupBy("conv_id", "message_id").agg(F.min("turn").alias("turn"))
    left = edges.select("conv_id", "a", "b")
    waiting = left.select("conv_id", F.col("a").alias("message_id")).distinct()
    done = scratch.cut(n.join(waiting, ["conv_id", "message_id"], "left_anti").select("conv_id", "message_id", F.col("turn").alias("place"), F.lit(0).alias("depth"), F.lit(False).alias("cyclic")))
    todo = scratch.cut(n.join(waiting, ["conv_id", "message_id"], "left_semi"))
    while not todo.isEmpty():
        below = left.join(done.select("conv_id", F.col("message_id").alias("b"), "place", "depth"), ["conv_id", "b"], "left")
        ready = below.groupBy("conv_id", F.col("a").alias("message_id")).agg(F.bool_and(F.col("depth").isNotNull()).alias("ok"), F.max(F.struct("place", "depth")).alias("top"))
        at = F.greatest("turn", "top.place")
        settled = todo.join(ready.where("ok"), ["conv_id", "message_id"]).select("conv_id", "message_id", at.alias("place"), F.when(F.col("top.place") == at, F.col("top.depth") + 1).otherwise(0).alias("depth"), F.lit(False).alias("cyclic"))
        settled = scratch.cut(settled)
        if settled.isEmpty():
            loop = todo.select("conv_id", "message_id", F.col("turn").alias("place"), F.lit(0).alias("depth"), F.lit(True).alias("cyclic"))
            return done.union(loop)
        rest = scratch.cut(todo.join(settled, ["conv_id", "message_id"], "left_anti"))
        done, todo = scratch.cut(done.union(settled)), rest
    return done
