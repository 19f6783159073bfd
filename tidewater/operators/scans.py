"""Date-bounded scans of the log. Bounds are literals, so they reach the Parquet reader; where the log
is partitioned by year and month, the months of the window are named too and prune directories."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from ..config import LOOKBACK_DAYS, feature_window, target_window


def between(tx: DataFrame, start: date | None, end: date) -> DataFrame:
    """Rows with start <= t_dat < end; no lower bound if start is None."""
    rows = tx.filter(F.col("t_dat") < F.lit(end))
    if start is not None:
        rows = rows.filter(F.col("t_dat") >= F.lit(start))
    if {"t_year", "t_month"} <= set(tx.columns):
        month = F.col("t_year") * 12 + F.col("t_month")
        rows = rows.filter(month <= end.year * 12 + end.month)
        if start is not None:
            rows = rows.filter(month >= start.year * 12 + start.month)
    return rows


def window_scan(tx: DataFrame, as_of: date, days: int = LOOKBACK_DAYS) -> DataFrame:
    return between(tx, *feature_window(as_of, days))


def target_scan(tx: DataFrame, as_of: date) -> DataFrame:
    return between(tx, *target_window(as_of))


def history_scan(tx: DataFrame, as_of: date) -> DataFrame:
    return between(tx, None, as_of)


def merged(rows: DataFrame, table: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """A join with a table that grows with the data, sorted and merged. The planner judges a table by the
    size of its compressed columns and would broadcast millions of rows, all of which the driver holds."""
    return rows.join(table.hint("merge"), keys, how)


def of_population(rows: DataFrame, population: DataFrame | None) -> DataFrame:
    """Semi-join before anything is aggregated; None means every customer."""
    return rows if population is None else rows.join(population.select("customer_key"), "customer_key", "left_semi")
