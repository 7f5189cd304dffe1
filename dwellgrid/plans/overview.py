"""Building overviews composed from the rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions.clock import Window, whole, window_start
from dwellgrid.functions.measures import occupied
from dwellgrid.operators.hourly import COUNTS, hourly_counts
from dwellgrid.operators.rates import utilization_by_floor_windows
from dwellgrid.usage import Usage


def data_overview(usage: Usage) -> DataFrame:
    """Floor rates of the last 7 and 30 days side by side, every floor listed."""
    return utilization_by_floor_windows(usage, (7, 30))


def overview(usage: Usage, days: int = 14, peaks: int = 3) -> DataFrame:
    """One row: floors with the highest and the lowest floor rate, and the peak hours of the highest.

    ``peak_hours`` lists the hours of the highest floor with the largest event rate over the whole history as
    ``HH:mm (rate%)``.  The window's rate and the history's peaks come from one roll-up per floor and hour.  Floors
    without events in the window take no part; equal rates go to the smaller floor.
    """
    inside = F.col("ts") >= window_start(usage.events, Window(days=whole(days, "days")), usage.at)
    counts = {
        **COUNTS,
        "window_events": inside.cast("int"),
        "window_occupied": F.when(inside, occupied()).otherwise(0),
    }
    hours = hourly_counts(usage, ["floor_n"], None, counts)
    observed = "CASE WHEN window_events > 0 THEN CAST(window_occupied > 0 AS INT) END"
    rated = hours.selectExpr(
        "floor_n",
        "hour",
        f"round(avg({observed}) OVER (PARTITION BY floor_n) * 100, 1) AS rate",
        "round(n_occupied / n_events * 100, 1) AS hour_rate",
    ).selectExpr("*", "row_number() OVER (PARTITION BY floor_n ORDER BY hour_rate DESC, hour) AS place")
    floors = (
        rated.where(f"place <= {whole(peaks, 'peaks')} AND rate IS NOT NULL")
        .groupBy("floor_n")
        .agg(
            F.max("rate").alias("rate"),
            F.expr("listagg(concat(date_format(hour, 'HH:mm'), ' (', hour_rate, '%)'), ', ') "
                   "WITHIN GROUP (ORDER BY place) AS peaks"),
        )
    )
    return floors.agg(
        F.expr("max_by(struct(floor_n, rate, peaks), struct(rate, -floor_n)) AS best"),
        F.expr("min_by(struct(floor_n, rate), struct(rate, floor_n)) AS worst"),
    ).selectExpr(
        "best.floor_n AS best_floor",
        "best.rate AS best_rate_percent",
        "worst.floor_n AS worst_floor",
        "worst.rate AS worst_rate_percent",
        "best.peaks AS peak_hours",
    )
