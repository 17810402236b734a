"""Terrain operators on a cell table (tile, row, col, elev).

A raster is cut into square blocks; a cell on a block border is also sent to the neighbour
block it touches, so every stencil is computed inside one block. One exchange by
(tile, row block, column block) serves the windows along rows and along columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitgauge.operators.quantiles import exact_quantiles


def blocked(cells: DataFrame, size: int = 256, halo: int = 1) -> DataFrame:
    """Cells with their block and copies in the blocks that need them as a border."""

    def blocks(axis: str) -> Column:
        own, pos = F.floor(F.col(axis) / size), F.pmod(F.col(axis), F.lit(size))
        return F.array_compact(F.array(own, F.when(pos < halo, own - 1), F.when(pos >= size - halo, own + 1)))

    out = cells.select("*", F.explode(blocks("row")).alias("_rb")).select("*", F.explode(blocks("col")).alias("_cb"))
    out = out.withColumn("_own", (F.floor(F.col("row") / size) == F.col("_rb")) & (F.floor(F.col("col") / size) == F.col("_cb")))
    return out.repartition("tile", "_rb", "_cb")


def _derivative(z: str, axis: str, across: str) -> Column:
    """Central difference along ``axis``, one-sided at an edge, 0 for a single cell."""
    w = Window.partitionBy("tile", "_rb", "_cb", across).orderBy(axis)
    nxt = F.when(F.lead(axis).over(w) == F.col(axis) + 1, F.lead(z).over(w))
    prv = F.when(F.lag(axis).over(w) == F.col(axis) - 1, F.lag(z).over(w))
    here = F.col(z)
    return (F.when(nxt.isNotNull() & prv.isNotNull(), (nxt - prv) / 2.0).when(nxt.isNotNull(), nxt - here)
            .when(prv.isNotNull(), here - prv).otherwise(0.0))


def slope(cells: DataFrame, res_x: float = 1.0, res_y: float = 1.0, size: int = 256) -> DataFrame:
    """Slope in degrees of every cell."""
    b = blocked(cells, size)
    b = b.withColumn("_dx", _derivative("elev", "col", "row")).withColumn("_dy", _derivative("elev", "row", "col"))
    gx, gy = F.col("_dx") / res_x, F.col("_dy") / res_y
    own = b.where("_own").select(*cells.columns, F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))).alias("slope_deg"))
    return own


def relief(cells: DataFrame, size: int = 256) -> DataFrame:
    """Highest minus lowest elevation of the 3x3 neighbourhood, in two one-dimensional passes."""
    b = blocked(cells, size)
    along = Window.partitionBy("tile", "_rb", "_cb", "row").orderBy("col").rangeBetween(-1, 1)
    b = b.withColumns({"_hi": F.max("elev").over(along), "_lo": F.min("elev").over(along)})
    across = Window.partitionBy("tile", "_rb", "_cb", "col").orderBy("row").rangeBetween(-1, 1)
    b = b.withColumns({"_hi3": F.max("_hi").over(across), "_lo3": F.min("_lo").over(across)})
    return b.where("_own").select(*cells.columns, (F.col("_hi3") - F.col("_lo3")).alias("relief"))


def summary(cells: DataFrame, value: str, by: Sequence[str] = ("tile",), over: Sequence[float] = (), below: Sequence[float] = (),
            cell_area: float | None = None, probs: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Moments, exact percentiles, shares above and below thresholds, and the area below zero."""
    v = F.col(value)
    agg = [F.count(v).alias("n_cells"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.avg(v).alias("mean_value"),
           F.stddev_pop(v).alias("std_value")]
    agg += [(F.avg((v > t).cast("double")) * 100.0).alias(f"pct_over_{i}") for i, t in enumerate(over)]
    agg += [(F.avg((v < t).cast("double")) * 100.0).alias(f"pct_below_{i}") for i, t in enumerate(below)]
    if cell_area is not None:
        agg.append((F.count_if(v < 0) * cell_area).alias("area_below_zero"))
    q = exact_quantiles(cells, value, probs, by).groupBy(*by).agg(*[
        F.max(F.when(F.col("prob") == float(p), F.col("quantile"))).alias(f"p{round(p * 100):02d}") for p in probs])
    return cells.groupBy(*by).agg(*agg).join(q, list(by))
