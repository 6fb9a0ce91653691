"""Row and request checks, metadata schemas, and the split into rows and rejects."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DIM = 10_000
#: What each protocol takes.
PROTOCOL_DIMS = {"http": 10_000, "websocket": 10_000, "grpc": 50_000, "redis": 1_000}
ID = r"^[A-Za-z0-9_.\-]{1,128}$"


def reject_reason(id_: Column, data: Column, min_dim: int = 1, max_dim: int = MAX_DIM, bounds: tuple[float, float] | None = None) -> Column:
    """NULL for a good row, else the first thing wrong with it."""
    bad = F.exists(data, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = F.when(id_.isNull() | (F.length(id_) == 0), "empty id").when(data.isNull() | (F.size(data) == 0), "empty vector").when(bad, "not finite").when((F.size(data) < min_dim) | (F.size(data) > max_dim), "dimension")
    if bounds:
        out = out.when(F.exists(data, lambda x: (x < bounds[0]) | (x > bounds[1])), "value range")
    return out


def split(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and rejects with it."""
    marked = df.withColumn("reject_reason", reason)
    return marked.where("reject_reason is null").drop("reject_reason"), marked.where("reject_reason is not null")


def protocol_reason(protocol: str, id_: Column, data: Column, metadata: Column | None = None) -> Column:
    if protocol not in PROTOCOL_DIMS:
        raise ValueError(f"unknown protocol: {protocol}")
    base = reject_reason(id_, data, max_dim=PROTOCOL_DIMS[protocol])
    if protocol == "http" and metadata is not None:
        return F.coalesce(base, F.when(metadata.isNull(), "metadata"))
    return base


def valid_id(id_: Column) -> Column:
    return F.coalesce(id_.rlike(ID), F.lit(False))


def check_request(k: int | None = None, threshold: float | None = None, clusters: list[str] | None = None, batch: int | None = None, max_k: int = 1000) -> None:
    if k is not None and not 1 <= k <= max_k:
        raise ValueError(f"k must be 1 to {max_k}")
    if threshold is not None and not 0 <= threshold <= 1e6:
        raise ValueError("threshold must be 0 to 1000000")
    if clusters is not None and (len(clusters) > 100 or any(not re.fullmatch(r"[A-Za-z0-9_.\-]{1,64}", c) for c in clusters)):
        raise ValueError("bad cluster ids")
    if batch is not None and batch > 100:
        raise ValueError("a batch has at most 100 queries")


@dataclass(frozen=True)
class Rule:
    """One field of a metadata schema."""

    type: str
    required: bool = False
    default: Any = None
    min: float | None = None
    max: float | None = None
    enum: tuple = ()


def _printed(x: Any) -> str:
    """An enum value as metadata prints it."""
    if isinstance(x, bool):
        return "true" if x else "false"
    return str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)


_KINDS = {"string": "^STRING$", "int": "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL.*,0.*)$", "float": "^(DOUBLE|FLOAT|DECIMAL.*|BIGINT|INT)$", "bool": "^BOOLEAN$", "array": "^ARRAY.*$", "object": "^OBJECT.*$"}


def schema_errors(metadata: Column, rules: dict[str, Rule], strict: bool = False, enforce_required: bool = True) -> Column:
    """array<string> of what a VARIANT object breaks; strict also forbids other keys."""
    out = []
    for name, rule in rules.items():
        path = f"$.{name}"
        v = F.try_variant_get(metadata, path, "variant")
        kind, text = F.schema_of_variant(v), F.try_variant_get(metadata, path, "string")
        number = F.try_variant_get(metadata, path, "double")
        if rule.type == "datetime":
            fits = F.try_to_timestamp(text).isNotNull() | kind.rlike("^(BIGINT|TIMESTAMP.*)$")
        else:
            fits = kind.rlike(_KINDS[rule.type])
        out.append(F.when(v.isNotNull() & ~fits, f"{name}: type"))
        if rule.required and enforce_required:
            out.append(F.when(v.isNull(), f"{name}: required"))
        size = F.octet_length(text).cast("double") if rule.type == "string" else number
        if rule.min is not None:
            out.append(F.when(v.isNotNull() & fits & (size < rule.min), f"{name}: min"))
        if rule.max is not None:
            out.append(F.when(v.isNotNull() & fits & (size > rule.max), f"{name}: max"))
        if rule.enum:
            out.append(F.when(v.isNotNull() & ~text.isin([_printed(x) for x in rule.enum]), f"{name}: enum"))
    if strict:
        keys = F.map_keys(F.try_variant_get(metadata, "$", "map<string,variant>"))
        extra = F.filter(keys, lambda k: ~k.isin(list(rules)))
        out.append(F.when(F.size(extra) > 0, F.concat(F.element_at(F.array_sort(extra), 1), F.lit(": unknown"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull()) if out else F.array().cast("array<string>")


def schema_errors_typed(columns: dict[str, tuple[Column, Rule]]) -> Column:
    """schema_errors() for metadata in typed columns."""
    out = []
    for name, (c, rule) in columns.items():
        size = F.octet_length(c).cast("double") if rule.type == "string" else c.cast("double")
        if rule.required:
            out.append(F.when(c.isNull(), f"{name}: required"))
        if rule.min is not None:
            out.append(F.when(size < rule.min, f"{name}: min"))
        if rule.max is not None:
            out.append(F.when(size > rule.max, f"{name}: max"))
        if rule.enum:
            out.append(F.when(~c.cast("string").isin([_printed(x) for x in rule.enum]), f"{name}: enum"))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def get_int(metadata: Column, key: str) -> Column:
    n = F.try_variant_get(metadata, f"$.{key}", "double")
    return F.when(F.schema_of_variant(F.try_variant_get(metadata, f"$.{key}", "variant")).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("bigint"))


def get_string(metadata: Column, key: str) -> Column:
    return F.when(F.schema_of_variant(F.try_variant_get(metadata, f"$.{key}", "variant")) == "STRING", F.try_variant_get(metadata, f"$.{key}", "string"))


def get_float(metadata: Column, key: str) -> Column:
    return F.when(F.schema_of_variant(F.try_variant_get(metadata, f"$.{key}", "variant")).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(metadata, f"$.{key}", "double"))


def get_bool(metadata: Column, key: str) -> Column:
    return F.when(F.schema_of_variant(F.try_variant_get(metadata, f"$.{key}", "variant")) == "BOOLEAN", F.try_variant_get(metadata, f"$.{key}", "boolean"))


def set_keys(metadata: Column, values: dict[str, str]) -> Column:
    """A string map with keys set; the last one wins."""
    names = list(values)
    kept = F.map_filter(metadata, lambda k, _: ~k.isin(names))
    return F.map_concat(kept, F.create_map(*(F.lit(x) for kv in values.items() for x in kv)))


def delete_keys(metadata: Column, keys: list[str]) -> Column:
    return F.map_filter(metadata, lambda k, _: ~k.isin(keys))


def size_estimate(id_: Column, data: Column, keys: Column) -> Column:
    """4 + id + 4 + 4 per number + (4 + 16 per key) + 12 bytes."""
    return (F.octet_length(id_) + 4 * F.size(data) + 16 * keys + 24).cast("bigint")
