"""Boxes and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double precision and order of position."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_bytes(a: Column) -> Column:
    """Memory of a row with a vector at most, if its numbers have up to eight bytes; a null vector has none."""
    return F.coalesce(F.size(a), F.lit(0)).cast("long") * 8 + 64


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes (struct of x1, y1, x2, y2) over their union; 0 for boxes without area."""
    side = lambda box, lo, hi: F.greatest(F.lit(0.0), box[hi] - box[lo])
    area = lambda box: side(box, "x1", "x2") * side(box, "y1", "y2")
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def band(x: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    """Label of the first limit that x lies below."""
    out = None
    for limit, label in steps:
        out = F.when(x < limit, label) if out is None else out.when(x < limit, label)
    return out.otherwise(rest)
