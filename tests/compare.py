"""Order-free comparison of Spark rows with DuckDB rows."""

from __future__ import annotations

import math
from decimal import Decimal


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        return round(float(x), 9)
    return str(x)


def rows(columns: list[str], values) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str([plain(v[i]) for i in order]) for v in values)


def same(df, relation) -> None:
    assert sorted(df.columns) == sorted(relation.columns)
    assert rows(df.columns, df.collect()) == rows(relation.columns, relation.fetchall())
