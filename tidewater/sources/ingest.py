"""CSV files to typed Parquet tables, and their verification."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import customer_key

TRANSACTIONS = "t_dat date, customer_id string, article_id int, price float, sales_channel_id byte"
CUSTOMERS = "customer_id string, FN float, Active float, club_member_status string, fashion_news_frequency string, age float, postal_code string"
#: Columns of the articles file that are numbers; any other is text.
ARTICLE_NUMBERS = ("article_id", "product_code", "product_type_no", "graphical_appearance_no", "colour_group_code", "perceived_colour_value_id", "perceived_colour_master_id", "department_no", "index_group_no", "section_no", "garment_group_no")
FILES = {"transactions": "transactions_train.csv", "customers": "customers.csv", "articles": "articles.csv"}


def missing_files(folder: str) -> list[str]:
    return [f for f in FILES.values() if not os.path.exists(os.path.join(folder, f))]


def require_files(folder: str) -> None:
    if absent := missing_files(folder):
        raise SystemExit(f"{folder} lacks {', '.join(absent)}")


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def ingest_transactions(spark: SparkSession, path: str, out: str) -> None:
    rows = _csv(spark, path, TRANSACTIONS).select(
        "t_dat", customer_key(F.col("customer_id")).alias("customer_key"), "article_id", "price", "sales_channel_id",
        F.year("t_dat").cast("short").alias("t_year"), F.month("t_dat").cast("byte").alias("t_month"),
    )
    # a month goes to several tasks, by customer, so that none writes a whole month alone
    spread = rows.repartition("t_year", "t_month", F.pmod(F.hash("customer_key"), F.lit(16)))
    spread.sortWithinPartitions("t_dat", "customer_key").write.partitionBy("t_year", "t_month").option("compression", "zstd").mode("overwrite").parquet(out)


def ingest_customers(spark: SparkSession, path: str, out: str, map_out: str) -> None:
    rows = _csv(spark, path, CUSTOMERS).withColumn("customer_key", customer_key(F.col("customer_id")))
    rows.select("customer_key", "age", F.col("FN").alias("fn"), F.col("Active").alias("active"), "club_member_status", "fashion_news_frequency", "postal_code").write.option("compression", "zstd").mode("overwrite").parquet(out)
    rows.select("customer_id", "customer_key").write.option("compression", "zstd").mode("overwrite").parquet(map_out)


def ingest_articles(spark: SparkSession, path: str, out: str) -> None:
    """Every column of the file; the header names them, and their types don't depend on the data."""
    names = spark.read.option("header", True).csv(path).columns  # reads the first line
    _csv(spark, path, ", ".join(f"`{c}` {'int' if c in ARTICLE_NUMBERS else 'string'}" for c in names)).write.option("compression", "zstd").mode("overwrite").parquet(out)


def ingest(spark: SparkSession, raw: str, out: str) -> dict:
    require_files(raw)
    ingest_transactions(spark, f"{raw}/{FILES['transactions']}", f"{out}/transactions")
    ingest_customers(spark, f"{raw}/{FILES['customers']}", f"{out}/customers", f"{out}/customer_id_map")
    ingest_articles(spark, f"{raw}/{FILES['articles']}", f"{out}/articles")
    return verify(spark.read.parquet(f"{out}/transactions"), spark.read.parquet(f"{out}/customer_id_map")).first().asDict()


def log_facts(tx: DataFrame) -> DataFrame:
    return tx.agg(F.count("*").alias("n_rows"), F.countDistinct("customer_key").alias("n_customers"), F.countDistinct("article_id").alias("n_articles"), F.min("t_dat").alias("first_day"), F.max("t_dat").alias("last_day"))


def verify(tx: DataFrame, id_map: DataFrame) -> DataFrame:
    """One row of facts; raises if two ids share a key or an id has two."""
    ids = id_map.agg(F.countDistinct("customer_id").alias("ids"), F.countDistinct("customer_key").alias("keys"), F.countDistinct("customer_id", "customer_key").alias("pairs")).first()
    if not ids.ids == ids.keys == ids.pairs:
        raise ValueError(f"customer keys aren't one to one: {ids.ids} ids, {ids.keys} keys")
    return log_facts(tx)
