"""Structured Streaming jobs over live readings: latest state, trend, alerts, board, daily roll-up.

State is Spark's own: aggregates, deduplication and keyed state functions below a query's checkpoint. What a job emits is written per
micro-batch as plain Parquet (``batch=<n>``), so a replayed batch writes the same folder again; the current table is the newest row of each key.
Calling a job again with its path goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pitgauge.functions import scoring as S
from pitgauge.schemas import decisions
from pitgauge.session import scratch_path

HISTORY = 12
DAY_MS = 86_400_000


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything that is available now, batch by batch, then stop; the ended query, for its progress."""
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).foreachBatch(each).start())
    q.awaitTermination()
    return q


class Emitted:
    """What a query has emitted so far: one folder per micro-batch."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)  # so that there is an empty table before the first batch

    def write(self, batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={n}")

    def rows(self) -> DataFrame:
        """All rows with their ``batch``."""
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])).parquet(self.path)

    def newest(self, keys: Sequence[str]) -> DataFrame:
        """The row of each key that was emitted last."""
        packed = F.max_by(F.struct(*[c for c in self.schema.names if c not in keys]), F.col("batch"))
        return self.rows().groupBy(*keys).agg(packed.alias("s")).select(*keys, "s.*")


def emit(stream: DataFrame, path: str, mode: str, shape: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> Emitted:
    """Run a query over what is available and keep what it emits, in the form ``shape`` gives it."""
    out = Emitted(stream.sparkSession, f"{path}/rows", shape(stream).schema)
    run_available(stream, lambda batch, n: out.write(shape(batch), n), f"{path}/checkpoint", mode)
    return out


def latest_state(stream: DataFrame, path: str, order: list[str], key: str = "zone_id") -> DataFrame:
    """The latest reading per zone: an aggregate in the state store, combined map-side; changed zones are emitted."""
    packed = F.max_by(F.struct(*[c for c in stream.columns if c != key]), F.struct(*order))
    return emit(stream.groupBy(key).agg(packed.alias("s")).select(key, "s.*"), f"{path}/latest", "update").newest([key])


STATE = "micros array<long>, event_id array<long>, score array<double>"


def newest_history(expire_ms: int, shape: Callable[[int, list], pd.DataFrame], nothing: Callable[[int], pd.DataFrame]) -> Callable:
    """Keyed state function: the newest readings of a zone as ``shape`` gives them, ``nothing`` once the zone expires."""

    def update(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield nothing(key[0])
            return
        kept = list(zip(*state.get)) if state.exists else []
        for pdf in chunks:  # Arrow chunks: memory does not grow with the group
            new = pdf.nlargest(HISTORY, ["micros", "event_id"])
            kept += zip(new["micros"].tolist(), new["event_id"].tolist(), new["score"].tolist())
            kept = sorted(kept)[-HISTORY:]
        state.update(tuple(list(x) for x in zip(*kept)))
        state.setTimeoutTimestamp(max(kept[-1][0] // 1000 + expire_ms, state.getCurrentWatermarkMs() + 1))
        yield shape(key[0], kept)

    return update


def _keyed(stream: DataFrame, update: Callable, schema: str, delay: str) -> DataFrame:
    """``stream`` has (zone_id, micros, event_id, score, event_time). A zone that a third of all readings come from is read in chunks."""
    rows = stream.select("zone_id", "micros", "event_id", "score", "event_time").withWatermark("event_time", delay)
    return rows.groupBy("zone_id").applyInPandasWithState(update, schema, STATE, "update", GroupStateTimeout.EventTimeTimeout)


HISTORY_SCHEMA = f"zone_id long, {STATE}"


def score_history(stream: DataFrame, path: str, delay: str = "30 days", expire_days: int = 60) -> DataFrame:
    """The last twelve scores per zone, oldest first, from keyed state.

    A zone without a reading for ``expire_days`` of event time loses its state and its row. Readings more than ``delay`` behind the newest ones of earlier
    batches come too late to be used.
    """
    make = lambda zone, kept: pd.DataFrame({"zone_id": [zone], **{n: [[r[i] for r in kept]] for i, n in enumerate(("micros", "event_id", "score"))}})
    update = newest_history(expire_days * DAY_MS, make, lambda zone: make(zone, []))
    return emit(_keyed(stream, update, HISTORY_SCHEMA, delay), f"{path}/history", "update").newest(["zone_id"]).where(F.size("score") > 0)


def trend_now(history: DataFrame) -> DataFrame:
    """Trend and rapid flag of each zone from its kept history."""
    n = F.size("score")
    c, b, a = (F.get("score", n - k) for k in (1, 2, 3))  # null where there are fewer
    rapid = ((b - a >= 8) & (c - b >= 8)) | (c - a >= 25)
    trend = F.when(n < 3, "stable").when(rapid, "rapidly_increasing").when(c > a, "rising").otherwise("stable")
    rows = history.where(n > 0).select("zone_id", n.cast("long").alias("n_history"), c.alias("last"), trend.alias("trend"))
    return rows.select("zone_id", "n_history", F.col("last").alias("score"), "trend", (F.col("trend") == "rapidly_increasing").alias("rapid"))


TREND_SCHEMA = "zone_id long, n_history long, score double, trend string, rapid boolean"


def _trend(scores: list[float]) -> str:
    if len(scores) < 3:
        return "stable"
    a, b, c = scores[-3:]
    if (b - a >= 8 and c - b >= 8) or c - a >= 25:
        return "rapidly_increasing"
    return "rising" if c > a else "stable"


def _trend_row(zone: int, kept: list) -> pd.DataFrame:
    t = _trend([s for *_, s in kept])
    return pd.DataFrame({"zone_id": [zone], "n_history": [len(kept)], "score": [kept[-1][2] if kept else None], "trend": [t], "rapid": [t == "rapidly_increasing"]})


def trend_by_state(stream: DataFrame, delay: str = "30 days", expire_days: int = 60) -> DataFrame:
    """The trend as a keyed state operator: one updated row per zone and trigger; ``n_history`` 0 marks a zone whose state has expired."""
    return _keyed(stream, newest_history(expire_days * DAY_MS, _trend_row, lambda zone: _trend_row(zone, [])), TREND_SCHEMA, delay)


def trend_state(stream: DataFrame, path: str, delay: str = "30 days", expire_days: int = 60) -> DataFrame:
    """The newest trend of each zone that has not expired."""
    return emit(trend_by_state(stream, delay, expire_days), f"{path}/trend", "update").newest(["zone_id"]).where("n_history > 0")


def alerts(scored: DataFrame, path: str, window: str = "30 days", key: str = "zone_id") -> DataFrame:
    """High and Critical readings with the first decision: one alert per zone and band within ``window`` of event time.

    An alert's state goes once the watermark is ``window`` past it, so a zone that is hot again later is reported again: ``raised_at`` tells them apart.
    """
    spark = scored.sparkSession
    first = decisions(spark).where("pos = 0").select("band", "message", "action")
    named = F.concat(F.lit("Zone "), F.col(key).cast("string"))
    hot = scored.select(key, "event_time", S.score_band("score").alias("band")).where(F.col("band").isin("High", "Critical"))
    once = hot.withWatermark("event_time", window).dropDuplicatesWithinWatermark([key, "band"])
    found = emit(once.select(key, "band", F.col("event_time").alias("raised_at")), f"{path}/alerts", "append").rows()
    return found.join(first, "band").select(key, "band", F.replace("message", F.lit("{zone}"), named).alias("summary"), "action", "raised_at")


CHANGE_SCHEMA = "zone_id long, old_score double, score double"


def _board_change(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A zone's latest score before and after a batch, if a later reading came."""
    old = newest = state.get if state.exists else None
    for pdf in chunks:
        top = pdf.nlargest(1, ["micros", "event_id"])
        row = (int(top["micros"].iloc[0]), int(top["event_id"].iloc[0]), float(top["score"].iloc[0]))
        newest = row if newest is None or row[:2] > tuple(newest[:2]) else newest
    if newest is not old:
        state.update(tuple(newest))
        yield pd.DataFrame({"zone_id": [key[0]], "old_score": [None if old is None else old[2]], "score": [newest[2]]}).astype({"old_score": "float64"})


def _counters(score: str, sign: int) -> dict[str, Column]:
    """What a zone with this score adds to the board; nothing without a score."""
    band, known = S.band_upper(S.score_band(score)), F.col(score).isNotNull()
    tests = {"n_critical": band == "CRITICAL", "n_high": band == "HIGH", "n_moderate": band == "MODERATE", "n_low": band.isin("LOW", "VERY_LOW"), "n_zones": F.lit(True)}
    out = {c: F.when(known & t, F.lit(sign)).otherwise(0).cast("long") for c, t in tests.items()}
    return out | {"confidence": F.when(known, sign * S.confidence_pct(F.col(score) / 100.0)).otherwise(0).cast("long")}


def board_per_batch(stream: DataFrame, path: str) -> DataFrame:
    """Board counters kept by change: each batch adds one row, minus the old band and plus the new one of the zones that changed, and the board is their sum."""
    rows = stream.select("zone_id", "micros", "event_id", "score")
    changes = rows.groupBy("zone_id").applyInPandasWithState(_board_change, CHANGE_SCHEMA, "micros long, event_id long, score double", "update", GroupStateTimeout.NoTimeout)

    def deltas(batch: DataFrame) -> DataFrame:
        plus, minus = _counters("score", 1), _counters("old_score", -1)
        return batch.agg(*[F.coalesce(F.sum(plus[c] + minus[c]), F.lit(0)).cast("long").alias(c) for c in plus])

    sums = emit(changes, f"{path}/board", "update", deltas).rows()
    names = ("n_critical", "n_high", "n_moderate", "n_low", "n_zones")
    total = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in (*names, "confidence")])
    mean = F.when(F.col("n_zones") > 0, F.col("confidence") / F.col("n_zones")).otherwise(0.0)
    status = F.when(F.col("n_critical") > 0, "CRITICAL_ALERT").when(F.col("n_high") > 0, "HIGH_ALERT").otherwise("NORMAL_OPERATIONS")
    return total.select(*names, F.floor(mean + 0.5).cast("long").alias("confidence_pct"), F.lit(0).cast("long").alias("people_in_hazard"), status.alias("status"))


def split_late(stream: DataFrame, event_time: str, path: str, delay: str) -> tuple[DataFrame, DataFrame]:
    """The readings in time as a stream, and the late ones as a table.

    A reading is late if its day had ended ``delay`` before the newest reading of earlier batches: the row that an event-time window would drop.
    The newest time of each batch is one written row, so a replayed batch splits alike.
    """
    spark = stream.sparkSession
    seen = Emitted(spark, f"{path}/seen", T.StructType([T.StructField("newest", T.TimestampType())]))
    parts = [Emitted(spark, f"{path}/{name}", stream.schema) for name in ("in-time", "late")]

    def route(batch: DataFrame, n: int) -> None:
        newest = seen.rows().where(F.col("batch") < n).agg(F.max("newest")).first()[0]
        late = F.coalesce(F.window(event_time, "1 day")["end"] <= F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}"), F.lit(False))
        flagged = batch.withColumn("_late", late)
        for part, rows in zip(parts, (flagged.where("not _late"), flagged.where("_late"))):
            part.write(rows.drop("_late"), n)
        seen.write(batch.agg(F.max(event_time).cast("timestamp").alias("newest")), n)

    run_available(stream, route, f"{path}/route-checkpoint")
    # no limit of files: what one batch has routed is taken together, or its newest rows could make its others late
    return spark.readStream.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(parts[0].path), parts[1].rows()


class Rollup:
    """Readings per zone and day: the days in time, and the late readings beside them."""

    def __init__(self, days: Emitted, late: DataFrame, query: StreamingQuery):
        self.days, self.late, self.query = days, late, query

    def closed(self) -> DataFrame:
        """Append mode: each day once, after the watermark has passed its end."""
        return self.days.rows().select("zone_id", "day", "n", "total", "top")

    def whole(self) -> DataFrame:
        """Update mode: every reading, late ones added to their day."""
        parts = self.days.newest(["zone_id", "day"]).unionByName(self.late.select("zone_id", "day", "n", "total", "top"))
        return parts.groupBy("zone_id", "day").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("top").alias("top"))


def _parts(value: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("top")]


def daily_rollup(stream: DataFrame, event_time: str, path: str, value: str = "score", delay: str = "2 days", mode: str = "update") -> Rollup:
    """Readings per zone and day (UTC) as (n, total, top) by event-time windows; state is dropped once the watermark passes a day.

    Readings that come after that are not lost: ``late`` has them per zone, day and batch. In ``append`` mode a day is emitted once, when it is closed;
    in ``update`` mode each batch emits the days that it changed.
    """
    rows = stream.select("zone_id", F.col(event_time).alias("at"), F.col(value).alias("_v"))
    in_time, late = split_late(rows, "at", path, delay)
    days = in_time.withWatermark("at", delay).groupBy("zone_id", F.window("at", "1 day").alias("w")).agg(*_parts("_v"))
    days = days.select("zone_id", F.to_date("w.start").alias("day"), "n", "total", "top")
    out = Emitted(stream.sparkSession, f"{path}/days", days.schema)
    query = run_available(days, out.write, f"{path}/days-checkpoint", mode)
    return Rollup(out, late.groupBy("zone_id", F.to_date("at").alias("day"), F.col("batch").alias("batch_id")).agg(*_parts("_v")), query)


def new_run_path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"stream-{name}")
