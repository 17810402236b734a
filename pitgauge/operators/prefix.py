"""Running sums over a whole ordered table, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pitgauge.session import cut_lineage


def running_sums(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column], parts: int | None = None) -> DataFrame:
    """``df`` with, for each name of ``sums``, the sum of its values (longs) over all rows up to and with this one in the order.

    Rows are dealt by ranges of the order and sorted, each task sums its own range batch by batch, and the totals of the ranges (one row
    each) are added in front. Rows of equal order come in any order among themselves, in one range. ``df`` should be a written
    table, as the ranges are sampled first. A null value counts 0; an empty table stays empty.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names, kept = list(sums), df.columns
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.LongType()) for n in ("_part", *names)]])
    arrow = to_arrow_schema(schema)
    keys = [f"_o{i}" for i in range(len(order))]
    placed = (df.select("*", *[c.alias(k) for c, k in zip(order, keys)], *[F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(f"_v{i}") for i, c in enumerate(sums.values())])
              .repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop(*keys))
    width = len(kept)

    def run(batches):
        part, before = TaskContext.get().partitionId(), np.zeros(len(names), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(j).cast(arrow.field(j).type) for j in range(width)] + [pa.array(np.full(batch.num_rows, part, dtype=np.int64))]
            for i in range(len(names)):
                total = before[i] + np.cumsum(batch.column(width + i).to_numpy())
                before[i] = total[-1]
                columns.append(pa.array(total))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    plain = [F.col(f"`{c}`").alias(f"c{j}") for j, c in enumerate(kept)]
    summed = cut_lineage(placed.select(*plain, *[f"_v{i}" for i in range(len(names))]).mapInArrow(run, schema))
    ends = summed.groupBy("_part").agg(*[F.max(n).alias(n) if len(names) == 0 else F.max_by(n, names[0]).alias(n) for n in names])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    starts = ends.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(n).over(ahead), F.lit(0).cast("long")).alias(f"_s{i}") for i, n in enumerate(names)])
    joined = summed.join(F.broadcast(starts), F.col("_part") == F.col("_p"))
    return joined.select(*[F.col(f"`{c}`") for c in kept], *[(F.col(n) + F.col(f"_s{i}")).alias(n) for i, n in enumerate(names)])
