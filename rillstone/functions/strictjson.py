"""Strict JSON: RFC 8259 texts with names unique per object and finite numbers."""

from __future__ import annotations

import json
import math
from typing import Any


class StrictError(ValueError):
    """The text is no strict JSON."""


def _pairs(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise StrictError("duplicate name")
    return out


def _constant(word: str) -> Any:
    raise StrictError(word)


def _float(digits: str) -> float:
    x = float(digits)
    if not math.isfinite(x):
        raise StrictError("number not finite")
    return x


_decoder = json.JSONDecoder(object_pairs_hook=_pairs, parse_constant=_constant, parse_float=_float)


def strict_loads(text: str) -> Any:
    """Parse or raise ValueError; nesting too deep for the parser counts as an error, too."""
    try:
        return _decoder.decode(text)
    except RecursionError as e:
        raise StrictError("nested too deeply") from e


def kind_of(value: Any) -> str:
    """JSON type name; bool is not a number."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (int, float)):
        return "number"
    return "array" if isinstance(value, list) else "object"


def canonical(value: Any) -> str:
    """Sorted keys, no blanks, ASCII only."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def tolerant_loads(text: str | None) -> Any:
    """Parse, or None where that fails."""
    if text is None:
        return None
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None
