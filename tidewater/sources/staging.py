"""Tables that are written once for a Spark application and read by many queries."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import Catalog
from ..config import LOOKBACK_DAYS
from ..operators.scans import window_scan

#: Rows of a month that one task writes.
ROWS_PER_FILE = 4_000_000
_staged: dict[tuple, object] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. One is made only
    where none is set and all executors are on this machine (tests); on a cluster a local folder would
    lose files silently, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        spark.sparkContext.setCheckpointDir(root)
    return root if "://" in root or root.startswith("file:") else f"file://{root}"


def write_log(tx: DataFrame, path: str, rows: int) -> None:
    """The log by month, within a month by customer, and within files by customer and day. A month goes to
    as many tasks as its share of ``rows`` asks for."""
    months = tx.select("*", F.year("t_dat").cast("short").alias("t_year"), F.month("t_dat").cast("byte").alias("t_month"))
    parts = max(1, rows // (12 * ROWS_PER_FILE))
    dealt = months.repartition("t_year", "t_month", F.pmod(F.hash("customer_key"), F.lit(parts)))
    dealt.sortWithinPartitions("t_year", "t_month", "customer_key", "t_dat").write.partitionBy("t_year", "t_month").option("compression", "zstd").mode("overwrite").parquet(path)


def _stamp(spark: SparkSession, root: str) -> tuple:
    files = [f"{root}/{t}.parquet" for t in ("orders", "lineitem", "part", "customer")]
    return (spark.sparkContext.applicationId, root, *(os.path.getmtime(f) if os.path.exists(f) else None for f in files))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` through a new table in the shared folder: its rows are fixed, whoever reads them again."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(spark: SparkSession, root: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` made of the tables in ``root``: built and written when first asked for."""
    key = (*_stamp(spark, root), name)
    if key not in _staged:
        _staged[key] = written(build(), f"staged-{name}")
    return _staged[key]


def staged_window(spark: SparkSession, root: str, cat: Catalog, as_of: date, days: int = LOOKBACK_DAYS) -> Catalog:
    """``cat`` with nothing in its log but the window before ``as_of``, written once by customer: what all
    features and strategies of a cutoff read, each several times."""

    def build() -> DataFrame:
        rows = window_scan(cat.tx, as_of, days).drop("t_year", "t_month")
        parts = max(1, rows.count() // ROWS_PER_FILE)
        return rows.repartition(parts, "customer_key").sortWithinPartitions("customer_key", "t_dat")

    return replace(cat, tx=staged(spark, root, f"window-{as_of}-{days}", build))


def staged_star_schema(spark: SparkSession, root: str) -> Catalog:
    """``Catalog.from_star_schema`` with its three tables written to the shared folder when first asked
    for: the join of orders and lines is done once, and a query reads the months of its window. Tables of
    a folder are taken not to change while the application runs, unless their files do."""
    key = _stamp(spark, root)
    if key not in _staged:
        cat = Catalog.from_star_schema(spark, root)
        path = f"{shared_root(spark)}/staged-{uuid.uuid4().hex}"
        write_log(cat.tx, f"{path}/transactions", spark.read.parquet(f"{root}/lineitem.parquet").count())
        for name in ("articles", "customers"):
            getattr(cat, name).write.option("compression", "zstd").parquet(f"{path}/{name}")
        _staged[key] = Catalog.from_parquet(spark, path)
    return _staged[key]
