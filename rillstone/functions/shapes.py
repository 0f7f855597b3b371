"""Checking JSON values against a schema: the draft's vocabulary that the canonical objects use, and three extensions of it."""

from __future__ import annotations

import re
from typing import Any

from rillstone.functions.strictjson import canonical, kind_of

_TYPES = {"integer": lambda v: type(v) is int, "number": lambda v: kind_of(v) == "number", "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None, "array": lambda v: isinstance(v, list), "object": lambda v: isinstance(v, dict)}


def errors(value: Any, schema: Any, root: Any = None, at: str = "$") -> list[str]:
    """``path: rule`` of everything in a value that breaks the schema; an empty list means valid. Patterns must match whole strings only where they
    are anchored; true and 1 differ, as do 1 and 1.0."""
    root = schema if root is None else root
    if schema is True:
        return []
    if schema is False:
        return [f"{at}: false"]
    out: list[str] = []
    say = lambda rule, bad: out.append(f"{at}: {rule}") if bad else None
    fits = lambda s: not errors(value, s, root, at)
    for rule, arg in schema.items():
        if rule == "$ref":
            target = root
            for part in arg.removeprefix("#").strip("/").split("/"):
                target = target[part.replace("~1", "/").replace("~0", "~")] if part else target
            out += errors(value, target, root, at)
        elif rule == "type":
            say(rule, not any(_TYPES[t](value) for t in ([arg] if isinstance(arg, str) else arg)))
        elif rule == "const":
            say(rule, canonical(value) != canonical(arg))
        elif rule == "enum":
            say(rule, canonical(value) not in map(canonical, arg))
        elif rule == "allOf":
            for s in arg:
                out += errors(value, s, root, at)
        elif rule in ("anyOf", "oneOf"):
            n = sum(map(fits, arg))
            say(rule, n == 0 or (rule == "oneOf" and n > 1))
        elif rule == "not":
            say(rule, fits(arg))
        elif rule == "if":
            branch = schema.get("then" if fits(arg) else "else")
            if branch is not None:
                out += errors(value, branch, root, at)
        elif isinstance(value, str):
            size = {"minLength": len(value) < arg, "maxLength": len(value) > arg} if rule in ("minLength", "maxLength") else {}
            say(rule, size.get(rule, False))
            if rule == "pattern":
                say(rule, re.search(arg.replace("$", r"\Z") if arg.endswith("$") else arg, value) is None)
        elif kind_of(value) == "number" and rule in ("minimum", "maximum"):
            say(rule, value < arg if rule == "minimum" else value > arg)
        elif isinstance(value, list):
            if rule == "items":
                for i, x in enumerate(value):
                    out += errors(x, arg, root, f"{at}[{i}]")
            elif rule in ("minItems", "maxItems"):
                say(rule, len(value) < arg if rule == "minItems" else len(value) > arg)
            elif rule == "uniqueItems":
                say(rule, arg and len({canonical(x) for x in value}) < len(value))
            elif rule == "x-uniqueBy":
                say(rule, len({canonical(x.get(arg)) for x in value if isinstance(x, dict)}) < len(value))
        elif isinstance(value, dict):
            if rule == "required":
                out += [f"{at}.{n}: required" for n in arg if n not in value]
            elif rule == "properties":
                for n, s in arg.items():
                    if n in value:
                        out += errors(value[n], s, root, f"{at}.{n}")
            elif rule == "additionalProperties":
                for n in value:
                    if n not in schema.get("properties", {}):
                        out += errors(value[n], arg, root, f"{at}.{n}")
            elif rule == "propertyNames":
                for n in value:
                    out += errors(n, arg, root, f"{at}.{n}")
            elif rule in ("minProperties", "maxProperties"):
                say(rule, len(value) < arg if rule == "minProperties" else len(value) > arg)
            elif rule == "x-equalCardinality":
                say(rule, len({len(_dig(value, p) or []) for p in arg}) > 1)
            elif rule == "x-derivationCardinality":
                many = len(_dig(value, arg.get("items", "source_record_ids")) or []) > 1
                say(rule, _dig(value, arg.get("field", "provenance.derivation")) != arg["many" if many else "one"])
    return out


def _dig(value: Any, path: str) -> Any:
    for part in path.split("."):
        value = value.get(part) if isinstance(value, dict) else None
    return value
