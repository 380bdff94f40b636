"""Tool calls and results of conversations: linked, ordered, checked and written as canonical JSON."""

from __future__ import annotations

import json
import math
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import written

#: Kinds of JSON values a schema may name.
_KINDS = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "null": lambda v: v is None,
}


#: Keywords that :func:`faults` checks, and those that say nothing about validity.
_CHECKED = frozenset(
    "type enum const minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern required "
    "properties additionalProperties minProperties maxProperties items minItems maxItems uniqueItems anyOf oneOf allOf "
    "not".split()
)
_NOTES = frozenset("title description default examples deprecated readOnly writeOnly $schema $id $comment".split())


def checked_schema(schema: object, path: str) -> None:
    """Refuse a schema that uses a keyword, type or form that :func:`faults` does not know."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{path}: not a schema")
    unknown = sorted(set(schema) - _CHECKED - _NOTES)
    if unknown:
        raise ValueError(f"{path}: keywords that are not checked: {', '.join(unknown)}")
    kinds = schema.get("type", [])
    for kind in kinds if isinstance(kinds, list) else [kinds]:
        if not isinstance(kind, str) or kind not in _KINDS:
            raise ValueError(f"{path}: unknown type {kind!r}")
    if "pattern" in schema:
        try:
            re.compile(schema["pattern"])
        except (re.error, TypeError) as error:
            raise ValueError(f"{path}: pattern: {error}") from error
    step = schema.get("multipleOf", 1)
    if isinstance(step, bool) or not isinstance(step, (int, float)) or not 0 < step < math.inf:
        raise ValueError(f"{path}: multipleOf must be a number above 0")
    if not isinstance(schema.get("properties", {}), dict):
        raise ValueError(f"{path}: properties must be an object")
    for key in ("anyOf", "oneOf", "allOf", "required", "enum"):
        if not isinstance(schema.get(key, []), list):
            raise ValueError(f"{path}: {key} must be a list")
    for name, part in schema.get("properties", {}).items():
        checked_schema(part, f"{path}.{name}")
    for key in ("additionalProperties", "items", "not"):
        if key in schema:
            checked_schema(schema[key], f"{path}.{key}")
    for key in ("anyOf", "oneOf", "allOf"):
        for n, part in enumerate(schema.get(key, [])):
            checked_schema(part, f"{path}.{key}[{n}]")


def _same(a: object, b: object) -> bool:
    """Equal as JSON: true is not 1, and 1 is 1.0."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return a == b


def faults(value: object, schema: dict | bool, path: str = "$") -> list[str]:
    """What in ``value`` breaks ``schema``, by the keywords of ``_CHECKED``."""
    if isinstance(schema, bool):
        return [] if schema else [f"{path}: not allowed"]
    kinds = schema.get("type")
    if kinds is not None and not any(_KINDS[k](value) for k in (kinds if isinstance(kinds, list) else [kinds])):
        return [f"{path}: not {' or '.join(kinds) if isinstance(kinds, list) else kinds}"]
    found = []
    if "enum" in schema and not any(_same(value, e) for e in schema["enum"]):
        found.append(f"{path}: not in enum")
    if "const" in schema and not _same(value, schema["const"]):
        found.append(f"{path}: not the constant")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            found.append(f"{path}: below minimum")
        if "maximum" in schema and value > schema["maximum"]:
            found.append(f"{path}: above maximum")
        if "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"]:
            found.append(f"{path}: not above minimum")
        if "exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"]:
            found.append(f"{path}: not below maximum")
        if "multipleOf" in schema and not (math.isfinite(value) and not Fraction(str(value)) % Fraction(str(schema["multipleOf"]))):
            found.append(f"{path}: not a multiple")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            found.append(f"{path}: too short")
        if "maxLength" in schema and len(value) > schema["maxLength"]:
            found.append(f"{path}: too long")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            found.append(f"{path}: not in pattern")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        other = schema.get("additionalProperties", True)
        found += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if other is False:
            found += [f"{path}.{k}: unknown" for k in sorted(value) if k not in known]
        if not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", len(value)):
            found.append(f"{path}: number of properties")
        for k in sorted(value):
            if k in known or other is not False:
                found += faults(value[k], known.get(k, other), f"{path}.{k}")
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            found.append(f"{path}: number of items")
        if schema.get("uniqueItems") and any(_same(a, b) for n, a in enumerate(value) for b in value[:n]):
            found.append(f"{path}: repeated items")
        for n, item in enumerate(value):
            found += faults(item, schema.get("items", True), f"{path}[{n}]")
    for part in schema.get("allOf", []):
        found += faults(value, part, path)
    if "anyOf" in schema and all(faults(value, part, path) for part in schema["anyOf"]):
        found.append(f"{path}: in none of anyOf")
    if "oneOf" in schema and sum(not faults(value, part, path) for part in schema["oneOf"]) != 1:
        found.append(f"{path}: not in exactly one of oneOf")
    if "not" in schema and not faults(value, schema["not"], path):
        found.append(f"{path}: in not")
    return found


def canonical(value: object) -> str:
    """JSON with sorted keys and without spare white space; not-a-number is refused.

    Half surrogate pairs, which no text file can hold, are escaped with all other non-ASCII.
    """
    made = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    if any("\ud800" <= c <= "\udfff" for c in made):
        return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return made


def check_arguments(tool: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[object, str | None]:
    """The parsed arguments (or the raw text) and the first fault, null if valid.

    A number beyond the range of doubles is a fault: it has no canonical form.
    """
    try:
        value = json.loads(arguments if arguments is not None else "", parse_constant=_refuse, parse_float=_finite, parse_int=_whole)
    except OverflowError:
        return arguments, "arguments: number out of range"
    except (ValueError, RecursionError):
        return arguments, "arguments: not JSON"
    if tool not in schemas:
        return value, "tool: unknown"
    found = faults(value, schemas[tool])
    return value, found[0] if found else None


def _refuse(name: str) -> None:
    raise ValueError(name)


def _finite(digits: str) -> float:
    value = float(digits)
    if math.isinf(value):
        raise OverflowError(digits)
    return value


def _whole(digits: str) -> int:
    value = int(digits)
    float(value)  # raises OverflowError
    return value


def levels(calls: DataFrame) -> DataFrame:
    """Depth of every call below the call it follows: conversation, call_id, level, broken.

    ``calls`` has distinct (conversation, call_id) and ``after``, the call whose result it uses.
    Pointers to the call before are doubled: each round joins every open pointer with the pointer
    it leads to, so a chain of n calls takes about log2 n rounds. ``broken`` says ``dangling`` for a
    call that follows one that is not there (level 0), ``cycle`` for calls on or behind a cycle
    (level null).
    """
    known = calls.select("conversation", F.col("call_id").alias("after"), F.lit(True).alias("there"))
    state = calls.join(known, ["conversation", "after"], "left").select(
        "conversation", "call_id",
        F.when(F.col("there"), F.col("after")).alias("up"),
        F.when(F.col("there"), 1).otherwise(0).cast("bigint").alias("level"),
        F.when(F.col("after").isNotNull() & F.col("there").isNull(), F.lit("dangling")).alias("broken"),
    )
    state = written(state, "call-levels")
    total = state.count()
    reach = 1
    while reach <= total and not state.where("up is not null").isEmpty():
        above = state.select(
            "conversation", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more")
        )
        state = written(
            state.join(above, ["conversation", "up"], "left").select(
                "conversation", "call_id", F.col("next").alias("up"),
                (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"), "broken",
            ),
            "call-levels",
        )
        reach *= 2
    open_still = F.col("up").isNotNull()
    return state.select(
        "conversation", "call_id",
        F.when(~open_still, F.col("level")).alias("level"),
        F.when(open_still, F.lit("cycle")).otherwise(F.col("broken")).alias("broken"),
    )


def link_calls(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per message with its link, level, faults and canonical line.

    ``messages`` has conversation, turn, role, kind (``call``, ``result`` or other), call_id, after,
    tool, arguments, content. Calls and results are joined by (conversation, call_id) through one
    row per identifier, so repeated identifiers are counted on both sides (``n_calls``,
    ``n_results``) and never paired with each other. A result has the level of its call.

    ``fault`` names, first of: a missing identifier, a result without call, a call without result,
    an identifier used twice, a cycle, a call it follows that is not there, arguments that are no
    JSON, an unknown tool, the first breach of the tool's schema. Messages sorted by (conversation,
    level, kind, turn) within a conversation stand in an order in which every call precedes its
    results and the calls that follow it; messages of other kinds have no level and no fault. Nulls
    in any column are kept; repeated rows stay; an empty table gives no rows. A schema with a
    keyword that the check does not know is refused before the job.
    """
    for name, schema in schemas.items():
        checked_schema(schema, name)
    marked = messages.select(
        "conversation", "turn", "role", "kind", "call_id", "after", "tool", "arguments", "content"
    )
    ids = marked.where("kind in ('call', 'result') and call_id is not null and conversation is not null")
    nodes = written(
        ids.groupBy("conversation", "call_id").agg(
            F.count_if(F.col("kind") == "call").alias("n_calls"),
            F.count_if(F.col("kind") == "result").alias("n_results"),
            F.min(F.when(F.col("kind") == "call", F.struct("turn", "after"))).alias("call"),
        ),
        "call-nodes",
    )
    calls = nodes.where("n_calls > 0").select("conversation", "call_id", F.col("call.after").alias("after"))
    linked = nodes.drop("call").join(levels(calls), ["conversation", "call_id"], "left")
    joined = marked.join(written(linked, "call-links"), ["conversation", "call_id"], "left")

    @F.pandas_udf("line string, argument_fault string")
    def lines(role: pd.Series, kind: pd.Series, call_id: pd.Series, tool: pd.Series, arguments: pd.Series, content: pd.Series) -> pd.DataFrame:
        made = []
        for r, k, i, t, a, c in zip(role, kind, call_id, tool, arguments, content):
            if k == "call":
                value, fault = check_arguments(t, a, schemas)
                made.append((canonical({"arguments": value, "id": i, "role": r, "tool": t}), fault))
            elif k == "result":
                made.append((canonical({"content": c, "id": i, "role": r}), None))
            else:
                made.append((canonical({"content": c, "role": r}), None))
        return pd.DataFrame(made, columns=["line", "argument_fault"])

    out = joined.withColumn("_made", lines("role", "kind", "call_id", "tool", "arguments", "content"))
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    fault = (
        F.when((call | result) & F.col("n_calls").isNull(), "identifier: missing")
        .when(result & (F.col("n_calls") == 0), "result: no call")
        .when(call & (F.col("n_results") == 0), "call: no result")
        .when((call | result) & ((F.col("n_calls") > 1) | (F.col("n_results") > 1)), "identifier: used twice")
        .when((call | result) & F.col("broken").isNotNull(), F.col("broken"))
        .when(call, F.col("_made.argument_fault"))
    )
    return out.select(
        "conversation", "turn", "role", "kind", "call_id",
        F.when(call | result, F.col("n_calls")).alias("n_calls"),
        F.when(call | result, F.col("n_results")).alias("n_results"),
        F.when(call | result, F.col("level")).alias("level"),
        fault.alias("fault"),
        F.col("_made.argument_fault").alias("argument_fault"),
        F.col("_made.line").alias("line"),
    )
