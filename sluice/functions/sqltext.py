"""Literals for SQL expression text.

The rules are written as SQL expressions: one string is one call into the JVM and
one parse, where the same tree built from ``Column`` objects takes dozens of calls.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def text(value: str) -> str:
    """A string literal, whatever characters it holds."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return "'" + "".join(ch if ch.isprintable() or ch == " " else f"\\u{ord(ch):04x}" for ch in escaped) + "'"


def pattern(value: str) -> str:
    """A regular expression, taken as it stands."""
    return f"r'{value}'"


def double(value: float | None) -> str:
    """A literal that reads back as exactly this DOUBLE."""
    return "CAST(NULL AS DOUBLE)" if value is None else f"CAST('{value!r}' AS DOUBLE)"


def texts(values: Iterable[str]) -> str:
    return ", ".join(text(value) for value in values)


def mapping(pairs: Mapping[str, str]) -> str:
    return f"map({', '.join(f'{text(k)}, {text(v)}' for k, v in pairs.items())})"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
