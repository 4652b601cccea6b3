"""Loose values of outside documents made into what a plan needs."""

from __future__ import annotations

import json
import re


def as_text(value, default: str | None = None) -> str | None:
    """A text: trimmed, lists joined by commas, objects as sorted JSON; empty ones are the default."""
    if value is None:
        return default
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, dict):
        return json.dumps(value, sort_keys=True, default=str)
    if isinstance(value, (list, tuple, set)):
        value = ", ".join(t for t in (as_text(v) for v in value) if t)
    return str(value).strip() or default


def as_int(value, default: int | None = None) -> int | None:
    """A whole number, cut off after the point; of an object the first of value, max_cycle, n and count."""
    if isinstance(value, dict):
        return next((as_int(value[k], default) for k in ("value", "max_cycle", "n", "count") if k in value), default)
    if isinstance(value, bool) or value is None:
        return default
    try:
        return int(float(value))
    except (TypeError, ValueError, OverflowError):
        return default


def as_texts(value) -> list[str]:
    """The texts of a list, of an object's values, or of one value; empty ones are left out."""
    if isinstance(value, dict):
        return [t for v in value.values() for t in as_texts(v)]
    if isinstance(value, (list, tuple, set)):
        return [t for t in (as_text(v) for v in value) if t]
    one = as_text(value)
    return [one] if one else []


def as_object(value) -> dict:
    """An object, or a JSON text of one; anything else is empty."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            return {}
    return dict(value) if isinstance(value, dict) else {}


_FENCE = re.compile(r"```[a-zA-Z0-9_+-]*[ \t]*\n(.*?)```", re.S)


def unfenced(text: str) -> str:
    """The first fenced block of a text, else the text."""
    found = _FENCE.search(text.strip())
    return (found.group(1) if found else text).strip()


def embedded_object(text: str) -> dict:
    """The JSON object that a text is, fences or words around it left out."""
    inner = unfenced(text) if text.strip().startswith("```") else text.strip()
    try:
        found = json.loads(inner)
    except ValueError:
        part = re.search(r"\{.*\}", inner, re.S)
        if not part:
            raise
        found = json.loads(part.group(0))
    if not isinstance(found, dict):
        raise ValueError("not an object")
    return found
