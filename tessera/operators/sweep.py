"""Span nesting: for each span the innermost other one that encloses it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def owners(starts: list[int], ends: list[int]) -> list[int | None]:
    """For each span, the place of its owner: by start and then longest first, the last one before it that still runs at
    its start. Of equal spans the one given earlier is the outer one. Each span is pushed and popped once."""
    out: list[int | None] = [None] * len(starts)
    stack: list[int] = []
    for i in sorted(range(len(starts)), key=lambda i: (starts[i], -ends[i], i)):
        while stack and ends[stack[-1]] <= starts[i]:
            stack.pop()
        out[i] = stack[-1] if stack else None
        stack.append(i)
    return out


def innermost_enclosing(spans: DataFrame, group: str, key: str, start: str, end: str) -> DataFrame:
    """group, key, owner (null: none). A group is one file's declarations, in the order of key."""

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, ignore_index=True)
        keys = pdf[key].tolist()
        return pdf[[group, key]].assign(owner=[None if o is None else keys[o] for o in owners(pdf[start].tolist(), pdf[end].tolist())])

    kinds = dict(spans.dtypes)
    return spans.select(group, key, start, end).groupBy(group).applyInPandas(sweep, f"{group} {kinds[group]}, {key} {kinds[key]}, owner {kinds[key]}")
