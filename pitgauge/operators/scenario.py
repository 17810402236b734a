"""What-if runs over a stored panel: scenarios are a table, derived columns are recomputed."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitgauge.functions import scoring as S
from pitgauge.operators import windows as W
from pitgauge.operators.chain import recompute
from pitgauge.operators.setops import digest
from pitgauge.schemas import ENUMS
from pitgauge.session import cut_lineage

BASELINE = "none"
TASK_ROWS = 200_000


def template_windows(series: DataFrame, templates: DataFrame) -> DataFrame:
    """Days, total and largest day of each template window, by expansion to days and an equi-join."""
    days = templates.select("template_id", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    return series.join(days, "day").groupBy("template_id").agg(
        F.count(F.lit(1)).alias("n_days"), F.sum("value").alias("window_total"), F.max("value").alias("window_max_day"))


def template_profiles(series: DataFrame, templates: DataFrame) -> DataFrame:
    """Daily values of each template in order; an array holds at most the days of its window."""
    days = templates.select("template_id", F.posexplode(F.sequence("first_day", "last_day")).alias("pos", "day"))
    hit = days.join(series.select("day", "value"), "day", "left")
    packed = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("value", F.lit(0.0)).alias("value"))))
    return hit.groupBy("template_id").agg(F.transform(packed, lambda x: x["value"]).alias("profile"))


def check_scenarios(scenarios: DataFrame, zones: DataFrame) -> None:
    """Unknown kinds and zones fail before anything is run."""
    known = ENUMS["scenario_kind"]
    bad = scenarios.agg(F.min(F.when(~F.col("kind").isin(known), F.col("kind")))).first()[0]
    if bad is not None:
        raise ValueError(f"unknown scenario kind {bad!r}; expected one of {known}")
    lost = scenarios.where(F.col("zone_id").isNotNull()).join(zones.select(F.col("_zone").alias("zone_id")), "zone_id", "left_anti").agg(F.min("zone_id")).first()[0]
    if lost is not None:
        raise ValueError(f"unknown zone {lost!r} in the scenario table")


def overlay(s: Column, day: Column) -> Column:
    """Rain added on ``day`` by scenario struct ``s``; 0 outside its window.

    A template shorter than the window adds nothing after its end, one that is longer is cut.
    """
    k = day - s["start_day"] + 1
    inside = k.between(1, s["duration_days"])
    peak = F.coalesce(s["params"]["peak_mm"], F.lit(100.0))
    added = (
        F.when(s["kind"].isin("rainfall_storm", "combined"), S.triangular_profile(k, s["duration_days"], peak))
        .when(s["kind"] == "prolonged_rain", F.coalesce(s["params"]["daily_mm"], F.lit(20.0)))
        .when(s["kind"] == "historical_rain",
              F.coalesce(F.get(s["profile"], k - 1), F.lit(0.0)) * F.coalesce(s["params"]["scale"], F.lit(1.0))))
    return F.when(inside, F.coalesce(added, F.lit(0.0))).otherwise(0.0)


def surged_ppv(s: Column, day: Column) -> Column:
    """Vibration inside the window times the multiplier, capped, on event days of blastable zones."""
    k = day - s["start_day"] + 1
    hit = (s["kind"].isin("blast_surge", "combined") & k.between(1, s["duration_days"])
           & F.col("blast_occurs") & F.col("blastable"))
    return F.when(hit, F.least(F.col("ppv") * F.coalesce(s["params"]["ppv_mult"], F.lit(1.5)), F.lit(100.0))).otherwise(F.col("ppv"))


def expand(panel: DataFrame, scenarios: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Panel rows repeated for every scenario that concerns their zone, as struct column ``s``.

    Site-wide scenarios are first listed once per zone (a table of zones x scenarios, as many rows as there
    are runs), so the panel meets its scenarios in one equi-join on the zone, for any number of either.
    """
    zones = panel.select(F.col("zone_id").cast("string").alias("_zone")).distinct()
    check_scenarios(scenarios, zones)
    if profiles is not None:
        scenarios = scenarios.join(profiles, "template_id", "left")
    else:
        scenarios = scenarios.withColumn("profile", F.lit(None).cast("array<double>"))
    fields = F.struct("scenario_id", "kind", "zone_id", "start_day", "duration_days", "params", "profile")
    table = scenarios.select(F.col("zone_id").alias("_own"), fields.alias("s"))
    own = table.where(F.col("_own").isNotNull()).select(F.col("_own").alias("_zone"), "s")
    everywhere = zones.join(table.where(F.col("_own").isNull()).select("s"), F.lit(True)).select("_zone", "s")
    return panel.withColumn("_zone", F.col("zone_id").cast("string")).join(own.unionByName(everywhere), "_zone").drop("_zone")


def _dealt(df: DataFrame, rows: int, keys: Sequence[str]) -> DataFrame:
    """Whole groups of ``keys`` in as many partitions as keep each near ``TASK_ROWS`` of the ``rows``, on small tables in one for each core.

    With the number given, they aren't merged again by their compressed size, which says little about the sorts of the chain's windows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(ceil(rows / TASK_ROWS), min(cores, ceil(rows / 5_000)), 2), *keys)


def run(panel: DataFrame, scenarios: DataFrame, profiles: DataFrame | None = None,
        keys: Sequence[str] = W.SERIES) -> DataFrame:
    """All scenarios at once: overlay the drivers, recompute the chain, with the baseline beside it.

    The baseline is the panel recomputed without any overlay, whether the table lists it or not. It is attached to the panel's
    rows before they are repeated, so it reaches every run without a join. The repeated panel is exchanged once, by series
    and scenario, so the runs of one zone are spread over tasks. The panel is written first: its rows, and the most that the scenarios can
    make of them, set the number of tasks, so that the memory of one does not grow with the tables.
    """
    panel = cut_lineage(panel)
    rows = panel.count()
    day = F.col("day_idx")
    base = {"base_rain": "rainfall_mm", "base_ppv": "ppv", "base_fos": "fos", "base_score": "instability_score", "base_label": "risk_label", "base_density": "density"}
    based = recompute(_dealt(panel, rows, keys), keys).select(*panel.columns, *[F.col(c).alias(n) for n, c in base.items()])
    x = expand(based, scenarios, profiles).withColumns({"scenario_id": F.col("s.scenario_id"), "kind_of_run": F.col("s.kind"),
                                                       "start_day": F.col("s.start_day"), "duration_days": F.col("s.duration_days")})
    x = x.withColumns({"rainfall_mm": F.col("rainfall_mm") + overlay(F.col("s"), day), "ppv": surged_ppv(F.col("s"), day)}).drop("s")
    return recompute(_dealt(x, rows * scenarios.count(), [*keys, "scenario_id"]), [*keys, "scenario_id"])


def summarize(runs: DataFrame, keys: Sequence[str] = W.SERIES) -> DataFrame:
    """Measures per scenario and series against its baseline; ties go to the earliest day."""
    d_fos = F.round(F.col("fos") - F.col("base_fos"), 9)
    d_score = F.col("instability_score") - F.col("base_score")
    day, hot = F.col("day_idx"), ["high", "critical"]
    worst = F.min_by(F.struct(day.alias("day"), F.col("risk_label").alias("label")),
                     F.struct(F.negate(F.col("instability_score")), day))
    agg = runs.groupBy("scenario_id", *keys).agg(
        F.min("base_fos").alias("baseline_min_fos"), F.min("fos").alias("scenario_min_fos"),
        F.min(d_fos).alias("fos_divergence_min"), F.min_by(day, F.struct(d_fos, day)).alias("divergence_day"),
        F.count_if(F.abs(d_fos) > 0.01).alias("days_diverging"),
        F.max("base_score").alias("baseline_peak"), F.max("instability_score").alias("scenario_peak"),
        F.count_if(F.col("base_label").isin(hot)).alias("baseline_days_hot"),
        F.count_if(F.col("risk_label").isin(hot)).alias("scenario_days_hot"),
        F.min(F.when(F.abs(d_score) > 1.0, day)).alias("first_response_day"), worst.alias("_w"),
        F.max("growth_mm").alias("peak_growth"), F.max("pore_kpa").alias("peak_pore_kpa"),
        F.max("groundwater_proxy").alias("max_proxy"),
        F.max((F.col("crack_severity") == "critical") & F.col("water_filled")).alias("open_crack_branch"))
    return agg.withColumns({
        "delta_min_fos": F.col("scenario_min_fos") - F.col("baseline_min_fos"),
        "delta_peak": F.col("scenario_peak") - F.col("baseline_peak"),
        "worst_day": F.col("_w.day"), "worst_day_risk": F.col("_w.label")}).drop("_w")


def compare(summary: DataFrame) -> DataFrame:
    """One row per scenario over all its series."""
    return summary.groupBy("scenario_id").agg(
        F.count(F.lit(1)).alias("n_series"), F.max("scenario_peak").alias("peak_score"), F.max("delta_peak").alias("max_delta_peak"),
        F.min("scenario_min_fos").alias("min_fos"), F.sum("scenario_days_hot").alias("days_hot"),
        F.max("peak_growth").alias("peak_growth"), F.max("max_proxy").alias("max_proxy"),
        F.min("first_response_day").alias("onset_day"))


def trajectory(runs: DataFrame, max_points: int, keys: Sequence[str] = W.SERIES) -> DataFrame:
    """Evenly spaced days of every run beside the baseline."""
    cols = ["scenario_id", *keys, "day_idx", "fos", "instability_score", "risk_label", "base_fos"]
    return W.decimate(runs.select(*cols), max_points, ["scenario_id", *keys])


def gates(runs: DataFrame) -> DataFrame:
    """Checks a set of runs must pass, as (gate, checked_rows, failed_rows)."""
    same = F.abs(F.col("fos") - F.col("base_fos")) <= 1e-12
    before = (F.col("day_idx") < F.col("start_day")) & (F.col("kind_of_run") != BASELINE)
    no_op = (F.col("kind_of_run") == "blast_surge") & ~F.col("blastable")
    wetter = F.col("kind_of_run").isin("rainfall_storm", "prolonged_rain", "historical_rain")
    rules = [
        ("baseline_replays_itself", F.col("kind_of_run") == BASELINE, same),
        ("unchanged_before_start", before, same),
        ("surge_skips_unblasted_zones", no_op, same),
        ("more_rain_never_safer", wetter, F.col("fos") <= F.col("base_fos") + 1e-9),
        ("fos_is_finite", F.lit(True), F.col("fos").isNotNull() & ~F.isnan("fos")),
    ]
    sums = runs.agg(*[c for i, (_, scope, ok) in enumerate(rules) for c in (
        F.count_if(scope).alias(f"n{i}"), F.count_if(scope & ~F.coalesce(ok, F.lit(False))).alias(f"f{i}"))])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("gate"), F.col(f"n{i}").alias("checked_rows"), F.col(f"f{i}").alias("failed_rows"))
        for i, (name, _, _) in enumerate(rules)])))


def edge_gates(panel: DataFrame, runs: DataFrame, template_days: int) -> DataFrame:
    """Scenarios at the edge of what the table allows, by their names: a gate fails for each row that is wrong and each row of the panel that is missing.

    ``scale0``: a template scaled to nothing is the baseline. ``start0``: a run may start on the first day. ``overrun``: one that ends
    after the panel has the panel's days. ``surge``: vibration of zones without blasting is untouched. ``short_template``: days of the window
    after the template's ``template_days`` get no rain. ``unknown_kind``: a kind that is not on the list raises before anything runs.
    """
    known = F.col("fos").isNotNull() & ~F.isnan("fos")
    padded = F.col("day_idx") - F.col("start_day") + 1 > template_days
    rules = {"scale0": F.abs(F.col("fos") - F.col("base_fos")) <= 1e-12, "start0": known, "overrun": known,
             "surge": F.col("blastable") | (F.col("ppv") == F.col("base_ppv")),
             "short_template": known & (~padded | (F.col("rainfall_mm") == F.col("base_rain")))}
    wrong = F.lit(False)
    for name, ok in rules.items():
        wrong = F.when(F.col("scenario_id") == name, ~F.coalesce(ok, F.lit(False))).otherwise(wrong)
    seen = runs.where(F.col("scenario_id").isin(list(rules))).groupBy("scenario_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(wrong).alias("_bad"))
    spark = panel.sparkSession
    names = spark.createDataFrame([(n,) for n in rules], "scenario_id string")
    all_rows = panel.agg(F.count(F.lit(1)).alias("checked_rows"))
    out = names.join(seen, "scenario_id", "left").withColumn("checked_rows", all_rows.scalar()).select(
        F.col("scenario_id").alias("gate"), "checked_rows", (F.coalesce("_bad", F.lit(0)) + F.abs(F.col("checked_rows") - F.coalesce("_n", F.lit(0)))).alias("failed_rows"))
    try:
        check_scenarios(runs.select(F.lit("no such kind").alias("kind"), F.lit(None).cast("string").alias("zone_id")).limit(1), panel.select(F.col("zone_id").cast("string").alias("_zone")))
        missed = 1
    except ValueError:
        missed = 0
    return out.unionByName(spark.createDataFrame([("unknown_kind", 1, missed)], "gate string, checked_rows bigint, failed_rows bigint"))


def dose_gate(runs: DataFrame, doses: dict[str, float], keys: Sequence[str] = W.SERIES) -> DataFrame:
    """A ladder of scenarios: with each step up in dose no series gets a higher least stability or a lower peak score."""
    dose = F.create_map(*[F.lit(x) for pair in doses.items() for x in pair])[F.col("scenario_id")]
    per = runs.withColumn("_dose", dose).where("_dose is not null").groupBy(*keys, "_dose").agg(F.min("fos").alias("_f"), F.max("instability_score").alias("_p"))
    up = Window.partitionBy(*keys).orderBy("_dose")
    steps = per.select("_f", "_p", F.lag("_f").over(up).alias("_lf"), F.lag("_p").over(up).alias("_lp")).where("_lf is not null")
    bad = (F.col("_f") > F.col("_lf") + 1e-9) | (F.col("_p") < F.col("_lp") - 1e-9)
    return steps.agg(F.count(F.lit(1)).alias("checked_rows"), F.count_if(bad).alias("failed_rows")).withColumn("gate", F.lit("dose_response"))


def continuity_gate(runs: DataFrame, keys: Sequence[str] = W.SERIES) -> DataFrame:
    """Every run starts with the baseline's crack density and grows by no less over all its days, those after the overlay included."""
    ws = W.series_window([*keys, "scenario_id"])
    up = lambda c: F.greatest(F.col(c) - F.lag(c).over(ws), F.lit(0.0))
    rows = runs.where(F.col("kind_of_run") != BASELINE).select("scenario_id", *keys, "density", "base_density", up("density").alias("_u"), up("base_density").alias("_b"), F.lag("density").over(ws).isNull().alias("_first"))
    per = rows.groupBy("scenario_id", *keys).agg(F.coalesce(F.sum("_u"), F.lit(0.0)).alias("_u"), F.coalesce(F.sum("_b"), F.lit(0.0)).alias("_b"),
                                                 F.max(F.when(F.col("_first"), F.abs(F.col("density") - F.col("base_density")))).alias("_d"))
    ok = (F.col("_u") >= F.col("_b") - 1e-9) & (F.col("_d") <= 1e-9)
    return per.agg(F.count(F.lit(1)).alias("checked_rows"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed_rows")).withColumn("gate", F.lit("crack_continuity"))


def determinism_gate(one: DataFrame, two: DataFrame) -> DataFrame:
    """Two computations of the same scenarios have the same rows: digests by scenario are compared, no rows are joined."""
    cols = [c for c in one.columns if c != "scenario_id" and dict(one.dtypes)[c] in ("double", "string", "boolean", "bigint", "int")]
    a, b = (digest(x.select("scenario_id", *cols), ["scenario_id"]) for x in (one, two))
    both = a.withColumnRenamed("digest", "_a").join(b.withColumnRenamed("digest", "_b"), "scenario_id", "full")
    return both.agg(F.count(F.lit(1)).alias("checked_rows"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("failed_rows")).withColumn("gate", F.lit("determinism"))
