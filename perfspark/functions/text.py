"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MARK = "\u0001"


def regex_groups(text: Column, pattern: str, groups: int) -> Column:
    """All groups of the first match as an array; a group without text is null,
    and the array is empty when the pattern does not fit.

    The pattern runs once per row: the match is rewritten as its groups with a
    separator and split again.
    """
    whole = f"^(?s:.*?)(?:{pattern})(?s:.*)$"
    joined = _MARK.join(f"${i + 1}" for i in range(groups))
    rewritten = F.regexp_replace(text, whole, _MARK + joined)
    # Without a match there is no separator, so nothing is left after the first.
    return F.transform(
        F.slice(F.split(rewritten, _MARK), 2, groups), lambda c: F.nullif(c, F.lit(""))
    )


def with_groups(df: DataFrame, text: str | Column, pattern: str, names: list[str]) -> DataFrame:
    """Add one text column per group of the pattern."""
    column = F.col(text) if isinstance(text, str) else text
    out = df.withColumn("__g", regex_groups(column, pattern, len(names)))
    return out.withColumns({n: F.get("__g", F.lit(i)) for i, n in enumerate(names)}).drop("__g")
