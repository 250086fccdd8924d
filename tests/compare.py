"""Rows of two engines in a form that can be compared."""

from decimal import Decimal

import pandas as pd


def plain(x):
    if x is None or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return bool(x)
    if isinstance(x, (float, Decimal)) or "float" in type(x).__name__:
        return round(float(x), 6)
    if "int" in type(x).__name__:
        return float(x)  # pandas turns integers beside nulls into floats
    if hasattr(x, "__len__") and not isinstance(x, (str, bytes)):
        return [plain(y) for y in x]
    return x


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(([plain(v) for v in r] for r in zip(*(frame[c] for c in columns), strict=True)), key=repr)
