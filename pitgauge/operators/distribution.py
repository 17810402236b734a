"""Two samples compared by their whole distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgauge.operators.prefix import running_sums
from pitgauge.session import cut_lineage

#: Factor of the large-sample Kolmogorov-Smirnov limit at a level of 1 percent.
LEVEL_1 = 1.628


def ks_distance(samples: DataFrame, value: str, first: str, by: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """(by..., n_first, n_second, distance, differs): the largest gap between the two samples' distribution functions, per group.

    ``first`` is a boolean column: true for the one sample, false for the other. Equal values are one counted row, combined map-side; the counts are summed in the order of group
    and value over ranges of the whole table (``prefix.running_sums``), so no task sees a whole group. Nulls of either column are left out, NaN is the
    greatest value. ``distance`` and ``differs`` (beyond the 1 percent limit) are null where a sample is empty.
    """
    side = F.col(first)
    known = samples.where(F.col(value).isNotNull() & side.isNotNull())
    counts = cut_lineage(known.groupBy(*by, F.col(value).alias("_v")).agg(F.count_if(side).alias("_a"), F.count_if(~side).alias("_b")))
    reached = cut_lineage(running_sums(counts, [*[F.col(c) for c in by], F.col("_v")], {"_sa": F.col("_a"), "_sb": F.col("_b")}, parts))
    ends = reached.groupBy(*by).agg(*[f(F.col(c) - F.col(o)).cast("long").alias(n) for f, c, o, n in ((F.min, "_sa", "_a", "_a0"), (F.min, "_sb", "_b", "_b0"))],
                                    F.sum("_a").alias("n_first"), F.sum("_b").alias("n_second"))
    if by:
        named = ends.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], "_a0", "_b0", "n_first", "n_second")
        same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
        rows = reached.select(*by, "_sa", "_sb").join(named, same)
    else:
        start = ends.first()
        rows = reached.select("_sa", "_sb", *[F.lit(start[c]).cast("long").alias(c) for c in ("_a0", "_b0", "n_first", "n_second")])
    gap = F.abs(F.try_divide(F.col("_sa") - F.col("_a0"), F.col("n_first")) - F.try_divide(F.col("_sb") - F.col("_b0"), F.col("n_second")))
    out = rows.groupBy(*by).agg(F.max("n_first").alias("n_first"), F.max("n_second").alias("n_second"), F.max(gap).alias("distance"))
    limit = LEVEL_1 * F.sqrt(F.try_divide((F.col("n_first") + F.col("n_second")).cast("double"), F.col("n_first").cast("double") * F.col("n_second")))
    return out.withColumn("differs", F.col("distance") > limit)
