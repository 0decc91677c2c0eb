"""Rules on column names: safe names, key and country names, roles."""

from __future__ import annotations

import re
from collections.abc import Iterable

from sluice.functions import fixed


def safe_name(name: str) -> str:
    """Lower-case snake form of a header, never empty and never led by a digit."""
    words = re.findall(r"[^\W_]+", str(name).lower())
    joined = "_".join(words) or "column"
    return f"c_{joined}" if joined[0].isdigit() else joined


def safe_names(names: Iterable[str]) -> list[str]:
    """Safe names for a whole header; a clash takes the next free number."""
    taken: dict[str, None] = {}
    for name in names:
        base = safe_name(name)
        candidates = (base if i == 1 else f"{base}_{i}" for i in range(1, len(taken) + 2))
        taken[next(c for c in candidates if c not in taken)] = None
    return list(taken)


def is_key_name(name: str) -> bool:
    return name.lower().rpartition("_")[2] in fixed.KEY_WORDS


def is_country_name(name: str) -> bool:
    return any(word in name.lower() for word in fixed.COUNTRY_WORDS)


def is_date_name(name: str) -> bool:
    lowered = name.lower()
    return "date" in lowered or lowered.endswith("_at")


def role_of(name: str, inferred_type: str) -> str:
    """What a column is used for, from its name and inferred type."""
    lowered = name.lower()
    if is_key_name(lowered):
        return "key"
    for role, words in fixed.ROLE_WORDS:
        if any(word in lowered for word in words):
            return role
    if inferred_type == "email" or "email" in lowered:
        return "email"
    if inferred_type == "datetime" or is_date_name(lowered):
        return "date"
    if any(word in lowered for word in fixed.FREE_TEXT_WORDS):
        return "free_text"
    return "country" if is_country_name(lowered) else "default"
