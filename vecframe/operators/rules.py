"""Request rules: suspicious text, and redaction of metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name and case-insensitive pattern of each rule.
RULES = (
    ("sql_injection", "(?i)(union|select|insert|update|delete|drop|alter|create|exec|execute)"),
    ("xss", "(?i)(script|javascript|onload|onerror|onclick|onmouseover)"),
    ("path_traversal", r"(?i)(\.\.|/etc|/proc|/usr|/var|/bin|/sbin)"),
    ("command_injection", r"(?i)(;|\||&|`|\$|>|<|\{|\})"),
)


def broken_rules(text: Column, enabled: tuple[str, ...] | None = None) -> Column:
    """array<string>: the names of the rules that a text breaks; none for a null."""
    cells = [F.when(text.rlike(p), n) for n, p in RULES if enabled is None or n in enabled]
    return F.filter(F.array(*cells), lambda x: x.isNotNull()) if cells else F.array().cast("array<string>")


def redact(metadata: Column, keys: list[str], mark: str = "[REDACTED]") -> Column:
    """A string map with the values of some keys covered."""
    return F.transform_values(metadata, lambda k, v: F.when(F.lower(k).isin([x.lower() for x in keys]), F.lit(mark)).otherwise(v))
