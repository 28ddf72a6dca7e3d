"""First-match rules, written as nested JSON, compiled to one expression."""

from __future__ import annotations

import ast
import json
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    "<": operator.lt, "<=": operator.le, ">": operator.gt,
    ">=": operator.ge, "=": operator.eq, "==": operator.eq,
}
_RULE = re.compile(r"\s*(default|others|in|>=|<=|==|>|<|=)\s*(.*)$")


def condition(dim: str, rule: str) -> Column:
    found = _RULE.match(rule)
    if not found:
        raise ValueError(f"unknown rule {rule!r}")
    op, text = found.groups()
    if op in ("default", "others"):
        return F.lit(True)
    value = ast.literal_eval(text)
    return F.col(dim).isin(list(value)) if op == "in" else _COMPARE[op](F.col(dim), F.lit(value))


def route(spec: dict | str, columns: dict[str, str] | None = None) -> Column:
    """Target label of the first matching rule at every level, else null.

    A matched rule with a nested spec decides inside it: no fall-through.
    ``columns`` maps dimension names of the rules to column names.
    """
    if isinstance(spec, str):
        spec = json.loads(spec)
    dim = spec["filter_dim"]
    if dim is None:
        first = spec["filter_entries"][0]["entry"]
        return route(first, columns) if isinstance(first, dict) else F.lit(first)
    name = (columns or {}).get(dim, dim)
    result = F.lit(None).cast("string")
    for item in reversed(spec["filter_entries"]):
        target = item["entry"]
        value = route(target, columns) if isinstance(target, dict) else F.lit(target)
        result = F.when(condition(name, item["rule"]), value).otherwise(result)
    return result


def spec_from_config(target: str, leaf_counts=None, flop_bound=None) -> dict:
    """Rules for one target from its leaf-count set and work bounds."""
    rules = []
    if leaf_counts is not None:
        rules.append(("leaf_node_no", f"in{list(leaf_counts)}"))
    if flop_bound is not None:
        low, high = flop_bound
        rules += [("FLOPs", f">={low}")] if low is not None else []
        rules += [("FLOPs", f"<{high}")] if high is not None else []
    entry: dict | str = target
    for dim, rule in reversed(rules):
        entry = {"filter_dim": dim, "filter_entries": [{"rule": rule, "entry": entry}]}
    if isinstance(entry, str):
        entry = {"filter_dim": None, "filter_entries": [{"rule": "default", "entry": target}]}
    return entry
