"""Points in polygons, met in the cells of a grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Corners up to which a polygon's edges become columns, so that the test of a pair is compiled.
FLAT_CORNERS = 16


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a simple polygon: an array of (x, y) corners, the last joined to the first.

    A ray to the right crosses an odd number of edges; of points on an edge those of
    left and lower edges count as inside, so polygons that share an edge share no point.
    """
    edges = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crossed = F.filter(edges, lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"]))
    return F.size(crossed) % 2 == 1


def _edges(ring: Column, corners: int) -> dict[str, Column]:
    """Start, end and extent of each edge as columns; of those that a ring has not all are null, of level ones the height is."""
    at = lambda i: F.get(ring, F.lit(i) % F.size(ring))
    out = {}
    for i in range(corners):
        there = lambda c: F.when(F.size(ring) > i, c)  # noqa: B023, E731
        a, b = at(i), at(i + 1)
        out |= {f"__ax{i}": there(a["x"]), f"__ay{i}": there(a["y"]), f"__by{i}": there(b["y"]), f"__dx{i}": there(b["x"] - a["x"]), f"__dy{i}": there(F.nullif(b["y"] - a["y"], F.lit(0.0)))}
    return out


def _inside_flat(x: Column, y: Column, corners: int) -> Column:
    """``inside`` by the columns of ``_edges``: the same products in the same order."""
    crossed = [((F.col(f"__ay{i}") > y) != (F.col(f"__by{i}") > y)) & (x < F.col(f"__dx{i}") * (y - F.col(f"__ay{i}")) / F.col(f"__dy{i}") + F.col(f"__ax{i}")) for i in range(corners)]
    return reduce(lambda n, c: n + c, [F.when(c, 1).otherwise(0) for c in crossed]) % 2 == 1


def contains_join(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Pairs of a point (``x, y`` and other columns) and a polygon (``ring`` and other columns) that holds it.

    A polygon is sent to each cell of its bounding box, a point to its own: an
    equi-join on the cell.  Both sides are dealt by cell to a fixed number of tasks: by
    their bytes they would be broadcast, or coalesced, and the pairs left to the few tasks
    that read the points.  Columns of the two sides must have different names; points with a null and
    polygons of fewer than three corners are in no pair.
    """
    at = lambda c: F.floor(c / F.lit(cell)).cast("long")
    low = lambda axis: at(F.array_min(F.transform("ring", lambda p: p[axis])))
    high = lambda axis: at(F.array_max(F.transform("ring", lambda p: p[axis])))
    polygons = polygons.where("size(ring) >= 3")
    corners = polygons.agg(F.max(F.size("ring"))).first()[0] or 3
    flat = corners <= FLAT_CORNERS
    covered = polygons.withColumn("__cx", F.explode(F.sequence(low("x"), high("x")))).withColumn("__cy", F.explode(F.sequence(low("y"), high("y"))))
    placed = points.where("x IS NOT NULL AND y IS NOT NULL").withColumns({"__cx": at(F.col("x")), "__cy": at(F.col("y"))})
    spark = points.sparkSession
    tasks = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = lambda df: df.repartition(tasks, "__cx", "__cy")
    if not flat:
        return dealt(placed).join(dealt(covered).hint("merge"), ["__cx", "__cy"]).where(inside(F.col("x"), F.col("y"), F.col("ring"))).drop("__cx", "__cy")
    edges = _edges(F.col("ring"), corners)
    covered = dealt(covered.withColumns(edges))
    return dealt(placed).join(covered.hint("merge"), ["__cx", "__cy"]).where(_inside_flat(F.col("x"), F.col("y"), corners)).drop("__cx", "__cy", *edges)
