"""Metadata filters: a small tree, compiled to a two-valued Column or to semi-joins with an exploded index."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as a number: no white space, suffix, underscore or hexadecimal.
NUMBER = r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"


@dataclass(frozen=True)
class Always:
    """No filter: every row."""


@dataclass(frozen=True)
class Exact:
    key: str
    value: str


@dataclass(frozen=True)
class Range:
    """op is one of ge, le, gt, lt, or None for the key's presence alone."""

    key: str
    op: str | None = None
    bound: str = ""


@dataclass(frozen=True)
class In:
    key: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class And:
    parts: tuple = ()


@dataclass(frozen=True)
class Or:
    parts: tuple = ()


@dataclass(frozen=True)
class Not:
    part: object


def number(x: Column) -> Column:
    """The value as a double, null where it isn't a number."""
    return F.when(x.rlike(NUMBER), x.try_cast("double"))


def _compare(x, bound, op: str):
    return {"ge": lambda: x >= bound, "le": lambda: x <= bound, "gt": lambda: x > bound, "lt": lambda: x < bound}[op]()


def _in_range(value: Column, f: Range) -> Column:
    """Numbers where both are, else text by its bytes; NaN compares with nothing."""
    if f.op is None:
        return value.isNotNull()
    n, b = number(value), number(F.lit(f.bound))
    numeric = F.coalesce(_compare(n, b, f.op) & ~F.isnan(n) & ~F.isnan(b), F.lit(False))
    return F.coalesce(F.when(value.rlike(NUMBER) & F.lit(f.bound).rlike(NUMBER), numeric).otherwise(_compare(value, F.lit(f.bound), f.op)), F.lit(False))


def compiled(f, metadata: Column) -> Column:
    """True or false, never null: a missing key is false, and its negation true."""
    match f:
        case Always():
            return F.lit(True)
        case Exact(key, value):
            return F.coalesce(metadata[key] == value, F.lit(False))
        case Range(key):
            return F.coalesce(_in_range(metadata[key], f), F.lit(False))
        case In(key, values):
            return F.coalesce(metadata[key].isin(*values), F.lit(False)) if values else F.lit(False)
        case And(parts):
            return reduce(lambda a, b: a & b, (compiled(p, metadata) for p in parts), F.lit(True))
        case Or(parts):
            return reduce(lambda a, b: a | b, (compiled(p, metadata) for p in parts), F.lit(False))
        case Not(part):
            return ~compiled(part, metadata)
    raise TypeError(f"not a filter: {f!r}")


def exploded_index(docs: DataFrame) -> DataFrame:
    """(doc_id, key, value) of all metadata."""
    return docs.select("doc_id", F.explode("metadata").alias("key", "value"))


def matching_ids(f, docs: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """doc_id of the rows that a filter keeps, by the exploded index: and = semi-joins, or = union, not = anti-join."""
    index = exploded_index(docs) if index is None else index
    alive = docs.select("doc_id")
    match f:
        case Always():
            return alive
        case Exact(key, value):
            return index.where((F.col("key") == key) & (F.col("value") == value)).select("doc_id").distinct()
        case Range(key):
            return index.where((F.col("key") == key) & _in_range(F.col("value"), f)).select("doc_id").distinct()
        case In(key, values):
            return index.where((F.col("key") == key) & (F.col("value").isin(*values) if values else F.lit(False))).select("doc_id").distinct()
        case And(parts):
            return reduce(lambda a, p: a.join(matching_ids(p, docs, index), "doc_id", "left_semi"), parts, alive)
        case Or(parts):
            return reduce(lambda a, p: a.unionByName(matching_ids(p, docs, index)), parts, alive.where(F.lit(False))).distinct()
        case Not(part):
            return alive.join(matching_ids(part, docs, index), "doc_id", "left_anti")
    raise TypeError(f"not a filter: {f!r}")


def from_legacy(pairs: dict[str, str], f=None):
    """An exact-match map, and-ed in key order with a filter."""
    parts = tuple(Exact(k, pairs[k]) for k in sorted(pairs))
    if not parts:
        return f if f is not None else Always()
    return And(parts if f is None else (*parts, f))


def oversampling(f) -> int:
    """How many times k a search that filters afterwards fetches."""
    match f:
        case Exact():
            return 2
        case Range():
            return 5
        case In(_, values):
            return 3 if len(values) <= 2 else 5 if len(values) <= 5 else 8
        case And(parts):
            return min(map(oversampling, parts), default=1)
        case Or(parts):
            return max(2, min(20, 2 * (sum(map(oversampling, parts)) // len(parts)))) if parts else 1
        case Not(part):
            return max(10, min(50, 50 // oversampling(part)))
    return 1


def search_width(k: int, f=None, namespace: bool = False) -> int:
    factor = oversampling(f if f is not None else Always())
    return min(k * (min(factor * 4, 10) if namespace else factor), 10_000) if k <= 10_000 else math.inf


def of_tenant(results: DataFrame, tenant: str, id_: str = "id") -> DataFrame:
    """Rows whose id reads `tenant:...`."""
    return results.where(F.col(id_).startswith(f"{tenant}:"))


def scope(tenant: Column, namespace: Column, filter_text: Column) -> Column:
    """One number for what a cached search depends on beside its vector; nulls differ from empty texts."""
    return F.xxhash64(F.struct(tenant.isNull(), tenant, namespace.isNull(), namespace, filter_text.isNull(), filter_text))
