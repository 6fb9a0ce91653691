"""Metadata filters: a tree of conditions compiled to one boolean Column.

Dialect A is the engine: groups (AND, OR, NOT) of conditions on fields, fifteen
operators.  The other dialects (typed match, request conditions, document
style, exact map) are translated to it.  A compiled filter is used in `where`
before distances are computed, and has no third truth value: a missing key
makes every operator but `nexists` false, and absent metadata all of them.

Fields come from typed columns (which reach Parquet statistics), from a
MAP<STRING,STRING>, or from a VARIANT.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Operators and groups of the filter language.
OPERATORS = ("eq", "ne", "gt", "ge", "lt", "le", "in", "nin", "contains", "ncontains", "startswith", "endswith", "regex", "exists", "nexists")
LOGICAL = ("and", "or", "not")
MAX_DEPTH, MAX_CONDITIONS, MAX_PATTERN = 10, 100, 1000


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: Any = None


@dataclass(frozen=True)
class Group:
    operator: str
    conditions: tuple[Condition, ...] = ()
    groups: tuple[Group, ...] = ()


def parse(tree: dict) -> Group:
    """From {logical_operator, conditions: [{field, operator, value}], groups: [...]}."""
    return Group(
        str(tree.get("logical_operator", "")).lower(),
        tuple(Condition(c.get("field", ""), str(c.get("operator", "")).lower(), c.get("value")) for c in tree.get("conditions") or ()),
        tuple(parse(g) for g in tree.get("groups") or ()),
    )


def validate(root: Group | None, max_depth: int = MAX_DEPTH, max_conditions: int = MAX_CONDITIONS) -> None:
    """ValueError for a filter that may not run."""
    if root is None:
        raise ValueError("a filter needs a root group")
    total = 0

    def visit(g: Group, depth: int) -> None:
        nonlocal total
        if depth > max_depth:
            raise ValueError(f"groups are nested deeper than {max_depth}")
        if g.operator not in LOGICAL:
            raise ValueError(f"unknown logical operator: {g.operator!r}")
        for c in g.conditions:
            total += 1
            if not c.field:
                raise ValueError("a condition needs a field")
            if c.operator not in OPERATORS:
                raise ValueError(f"unknown operator: {c.operator!r}")
            if c.value is None and c.operator not in ("exists", "nexists"):
                raise ValueError(f"{c.operator} needs a value")
        for x in g.groups:
            visit(x, depth + 1)

    visit(root, 1)
    if total > max_conditions:
        raise ValueError(f"more than {max_conditions} conditions")


def printed(x: Column) -> Column:
    """A double as the shortest decimal text, whole numbers without a point."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e18)
    return F.when(whole, x.cast("bigint").cast("string")).otherwise(x.cast("string"))


@dataclass(frozen=True)
class Value:
    """A field: whether it is there, its number (NULL if it isn't one), its printed text, its text (NULL if it isn't one)."""

    exists: Column
    number: Column
    printed: Column
    text: Column
    plain: Column | None = None  # a typed column itself, and its kind
    kind: str = ""


class TypedFields:
    """Fields are columns; numbers, booleans and strings keep their types; NULL is a missing key."""

    def __init__(self, df: DataFrame, columns: dict[str, str] | None = None):
        self.types = dict(df.dtypes)
        self.columns = columns or {c: c for c in df.columns}

    def get(self, name: str) -> Value:
        none = F.lit(None)
        if name not in self.columns:
            return Value(F.lit(False), none.cast("double"), none.cast("string"), none.cast("string"))
        c, kind = F.col(self.columns[name]), self.types[self.columns[name]]
        if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
            n = c.cast("double")
            return Value(c.isNotNull(), n, printed(n), none.cast("string"), c, "float" if kind in ("float", "double") else "int")
        if kind == "string":
            return Value(c.isNotNull(), none.cast("double"), c, c, c, "string")
        return Value(c.isNotNull(), none.cast("double"), c.cast("string"), none.cast("string"))


class MapFields:
    """Fields of a MAP<STRING,STRING>: every value is a string."""

    def __init__(self, column: str = "metadata"):
        self.map = F.col(column)

    def get(self, name: str) -> Value:
        v = F.try_element_at(self.map, F.lit(name))
        there = F.coalesce(F.map_contains_key(self.map, F.lit(name)), F.lit(False))
        return Value(there, F.lit(None).cast("double"), v, v)


class VariantFields:
    """Fields of a VARIANT object: numbers are numbers, strings strings."""

    def __init__(self, column: str = "metadata"):
        self.variant = F.col(column)

    def get(self, name: str) -> Value:
        path = f"$['{name}']" if not re.fullmatch(r"\w+", name) else f"$.{name}"
        v = F.try_variant_get(self.variant, path, "variant")
        kind = F.schema_of_variant(v)
        numeric = kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$")
        number = F.when(numeric, F.try_variant_get(self.variant, path, "double"))
        text = F.when(kind == "STRING", F.try_variant_get(self.variant, path, "string"))
        shown = F.when(numeric, printed(number)).otherwise(F.try_variant_get(self.variant, path, "string"))
        return Value(v.isNotNull() & F.coalesce(kind != "VOID", F.lit(True)), number, shown, text)


def _literal(x: Any) -> tuple[float | None, str]:
    """A filter value as a number, if it is one, and printed."""
    if isinstance(x, bool):
        return None, "true" if x else "false"
    if isinstance(x, (int, float)):
        return float(x), str(int(x)) if float(x).is_integer() and abs(x) < 1e18 else repr(float(x))
    return None, str(x)


def _equal(v: Value, x: Any) -> Column:
    n, s = _literal(x)
    same = v.printed == s
    return F.when(v.number.isNotNull(), v.number == n).otherwise(same) if n is not None else same


def _greater(v: Value, x: Any) -> Column:
    n, s = _literal(x)
    above = v.printed > s
    return F.when(v.number.isNotNull(), v.number > n).otherwise(above) if n is not None else above


#: What RE2 has not: look-around, back references, atomic groups and possessive repeats.
_BEYOND = re.compile(r"\(\?[=!<>]|\\[1-9]|\\k<|[*+?}]\+")


def usable_pattern(p: Any) -> bool:
    if not isinstance(p, str) or len(p) > MAX_PATTERN or (_BEYOND.search(p) and "(?P<" not in p):
        return False
    try:
        re.compile(p)
    except re.error:
        return False
    return True


def _direct(v: Value, op: str, x: Any) -> Column | None:
    """The plain comparison of a typed column with a value of its kind, which a scan can take over; None if there is none."""
    items = list(x) if isinstance(x, (list, tuple)) else [x]
    if v.plain is None or not items or op in ("regex", "exists", "nexists") or (op in ("in", "nin")) != isinstance(x, (list, tuple)):
        return None
    if v.kind == "string":
        if not all(isinstance(i, str) for i in items):
            return None
    elif op in ("contains", "ncontains", "startswith", "endswith") or not all(isinstance(i, (int, float)) and not isinstance(i, bool) and (v.kind == "float" or float(i).is_integer() and abs(i) < 1 << 62) for i in items):
        return None
    else:
        items = [float(i) if v.kind == "float" else int(i) for i in items]
    c, y = v.plain, items[0]
    return {
        "eq": lambda: c == y,
        "ne": lambda: c != y,
        "gt": lambda: c > y,
        "ge": lambda: c >= y,
        "lt": lambda: c < y,
        "le": lambda: c <= y,
        "in": lambda: c.isin(items),
        "nin": lambda: ~c.isin(items),
        "contains": lambda: c.contains(y),
        "ncontains": lambda: ~c.contains(y),
        "startswith": lambda: c.startswith(y),
        "endswith": lambda: c.endswith(y),
    }[op]()


def condition(c: Condition, fields, regex: bool = True, strict: bool = False) -> Column:
    v, x, op = fields.get(c.field), c.value, c.operator
    if op == "exists":
        return F.coalesce(v.exists, F.lit(False))
    if op == "nexists":
        return ~F.coalesce(v.exists, F.lit(False))
    ordered_text = strict and v.kind == "string" and op in ("gt", "ge", "lt", "le")
    if not ordered_text and (plain := _direct(v, op, x)) is not None:
        return v.plain.isNotNull() & plain  # false AND NULL is false, so no third value
    text = lambda f: F.coalesce(f, F.lit(False))
    if op in ("in", "nin"):
        if isinstance(x, (list, tuple)):
            hit = F.lit(False)
            for item in x:
                hit = hit | F.coalesce(_equal(v, item), F.lit(False))
        else:
            hit = F.lit(False)
        got = hit if op == "in" else ~hit
    elif op in ("eq", "ne"):
        same = text(_equal(v, x))
        if strict:
            n = _literal(x)[0]
            same = same & (v.number.isNotNull() if n is not None else v.text.isNotNull() if isinstance(x, str) else F.lit(True))
        got = same if op == "eq" else ~same
    elif op in ("gt", "ge", "lt", "le"):
        more, same = text(_greater(v, x)), text(_equal(v, x))
        got = {"gt": more, "ge": more | same, "lt": ~(more | same), "le": ~more}[op]
        if strict:
            bad = v.exists & v.number.isNull() if _literal(x)[0] is not None else v.exists
            got = F.when(bad, F.raise_error(F.lit(f"{c.field}: {op} needs numbers")).cast("boolean")).otherwise(got)
    elif op in ("contains", "ncontains"):
        hit = text(F.contains(v.text, F.lit(x))) if isinstance(x, str) else F.lit(False)
        got = hit if op == "contains" else ~hit
    elif op in ("startswith", "endswith"):
        f = F.startswith if op == "startswith" else F.endswith
        got = text(f(v.text, F.lit(x))) if isinstance(x, str) else F.lit(False)
    elif op == "regex":
        got = text(v.text.rlike(x)) if regex and usable_pattern(x) else F.lit(False)
    else:
        raise ValueError(f"unknown operator: {op}")
    return F.coalesce(v.exists, F.lit(False)) & got


def compile_filter(root: Group | None, fields, metadata: Column | None = None, regex: bool = True, strict: bool = False) -> Column:
    """The filter as a Column without NULLs; no group: true.  `metadata`: the column without which all is false."""
    if root is None:
        return F.lit(True)
    validate(root)

    def group(g: Group) -> Column:
        parts = [condition(c, fields, regex, strict) for c in g.conditions] + [group(x) for x in g.groups]
        every, some = F.lit(True), F.lit(False)
        for p in parts:
            every, some = every & p, some | p
        return {"and": every, "or": some, "not": ~every}[g.operator]

    got = group(root)
    return F.coalesce(metadata.isNotNull(), F.lit(False)) & got if metadata is not None else got


# -- other dialects, to groups

#: The operators of the typed match and of request conditions.
MATCH = {"=": "eq", "!=": "ne", ">": "gt", "<": "lt", ">=": "ge", "<=": "le", "in": "in", "contains": "contains", "startswith": "startswith", "endswith": "endswith"}
REQUEST = {"=": "eq", "!=": "ne", ">": "gt", "<": "lt", ">=": "ge", "<=": "le", "in": "in", "not_in": "nin", "contains": "contains", "not_contains": "ncontains"}
DOCUMENT = {"$eq": "eq", "$ne": "ne", "$gt": "gt", "$gte": "ge", "$lt": "lt", "$lte": "le", "$in": "in", "$nin": "nin"}


def from_match(conditions: list[tuple[str, str, Any]], logic: str = "and") -> Group:
    """Typed match; compile it with strict=True."""
    return Group(logic.lower(), tuple(Condition(f, MATCH[op], v) for f, op, v in conditions))


def from_request(conditions: list[dict]) -> Group:
    """Request conditions {key, operator, value}, checked and joined by AND."""
    if len(conditions) > MAX_CONDITIONS:
        raise ValueError(f"more than {MAX_CONDITIONS} conditions")
    out = []
    for c in conditions:
        key, op, value = c.get("key", ""), c.get("operator", ""), c.get("value", "")
        if not re.fullmatch(r"[A-Za-z0-9_.\-]{1,256}", key):
            raise ValueError(f"bad key: {key!r}")
        if op not in REQUEST:
            raise ValueError(f"unknown operator: {op!r}")
        if len(str(value)) > 1024 or re.search(r"<script>|javascript:", str(value), re.I):
            raise ValueError("bad value")
        if op in ("in", "not_in") and isinstance(value, str):
            value = [x.strip() for x in value.split(",")]
        out.append(Condition(key, REQUEST[op], value))
    return Group("and", tuple(out))


def from_document(tree: dict, prefix: str = "metadata.") -> Group:
    """{"metadata.a": 1, "metadata.b": {"$gte": 2}}, all of it."""
    out = []
    for key, value in tree.items():
        name = key.removeprefix(prefix)
        if isinstance(value, dict):
            out += [Condition(name, DOCUMENT[op], x) for op, x in value.items()]
        else:
            out.append(Condition(name, "eq", value))
    return Group("and", tuple(out))


def from_map(values: dict[str, str]) -> Group:
    return Group("and", tuple(Condition(k, "eq", v) for k, v in values.items()))


def operator_catalogue(spark: SparkSession) -> DataFrame:
    kinds = {"exists": "presence", "nexists": "presence", "in": "list", "nin": "list", "gt": "order", "ge": "order", "lt": "order", "le": "order", "eq": "equality", "ne": "equality"}
    return spark.createDataFrame([(o, kinds.get(o, "text")) for o in OPERATORS], "operator string, kind string")
