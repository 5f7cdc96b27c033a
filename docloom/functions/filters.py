"""Metadata filter language compiled to Columns, so it pushes into the scan.

``{"field": value}`` means equality, a list means membership, and a dict holds
operators: ``$eq $ne $in $gte $lte $contains``.  Conditions are conjunctive.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

DIALECTS = {
    "full": {"$eq", "$ne", "$in", "$gte", "$lte", "$contains", "list", "scalar"},
    "vector": {"$eq", "$ne", "$in", "$gte", "$lte", "scalar"},
    "scalar": {"scalar"},
}


def _member(c: Column, values: list[Any]) -> Column:
    known = [v for v in values if v is not None]
    hit = F.coalesce(c.isin(known), F.lit(False)) if known else F.lit(False)
    return hit | c.isNull() if None in values else hit


def _one(c: Column, op: str, v: Any) -> Column:
    if op == "$eq":
        return c.eqNullSafe(F.lit(v))
    if op == "$ne":
        return ~c.eqNullSafe(F.lit(v))
    if op == "$in":
        return _member(c, list(v))
    if op == "$gte":
        return F.coalesce(c >= F.lit(v), F.lit(False))
    if op == "$lte":
        return F.coalesce(c <= F.lit(v), F.lit(False))
    if op == "$contains":
        return F.contains(F.coalesce(c.cast("string"), F.lit("None")), F.lit(str(v)))
    raise ValueError(f"unknown filter operator: {op}")


def compile_filters(
    filters: dict[str, Any] | None,
    dialect: str = "full",
    columns: list[str] | None = None,
) -> Column:
    """Return one boolean Column.  A field missing from ``columns`` behaves as
    null, as it does for a row without that key."""
    allowed = DIALECTS[dialect]
    terms: list[Column] = []
    for field, cond in (filters or {}).items():
        c = F.col(field) if columns is None or field in columns else F.lit(None).cast("string")
        if isinstance(cond, dict):
            for op, v in cond.items():
                if op not in allowed:
                    raise ValueError(f"{op} is not part of the {dialect} filter dialect")
                terms.append(_one(c, op, v))
        elif isinstance(cond, (list, tuple, set)):
            if "list" not in allowed:
                raise ValueError(f"list membership is not part of the {dialect} filter dialect")
            terms.append(_member(c, list(cond)))
        else:
            terms.append(c.eqNullSafe(F.lit(cond)))
    return reduce(lambda a, b: a & b, terms, F.lit(True))
