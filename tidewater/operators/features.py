"""Feature blocks at a point in time, and the one function that assembles feature rows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from ..catalog import Catalog
from ..config import LOOKBACK_DAYS
from ..functions.scalars import count_if, days_before, exact_avg, share_of
from .scans import merged, of_population, window_scan

CATEGORICAL = ["product_group_name", "index_group_name", "garment_group_name", "club_member_status", "fashion_news_frequency"]
NON_FEATURES = ["customer_key", "article_id", "label", "week"]
ZERO_FILLED = ["ca_n_purchases", "cg_n_purchases", "cg_share", "ca_share_of_purchases", "cpc_n_purchases", "cpc_n_variants", "cpc_share"]


def _since(as_of: date, days: int):
    return F.col("t_dat") >= F.lit(as_of - timedelta(days=days))


def customer_recency(cat: Catalog, as_of: date, lookback: int = LOOKBACK_DAYS, population: DataFrame | None = None) -> DataFrame:
    rows = of_population(window_scan(cat.tx, as_of, lookback), population)
    return rows.groupBy("customer_key").agg(
        F.count("*").alias("n_purchases"), F.countDistinct("article_id").alias("n_unique_items"), F.countDistinct("t_dat").alias("n_active_days"),
        exact_avg("price").alias("avg_price"), F.max("price").alias("max_price"), F.round(F.stddev_pop("price"), 6).alias("std_price"),
        F.max("t_dat").alias("last_purchase_date"), days_before(as_of, F.max("t_dat")).alias("days_since_last"), days_before(as_of, F.min("t_dat")).alias("days_since_first"),
        count_if(_since(as_of, 7)).alias("n_purchases_7d"), count_if(_since(as_of, 30)).alias("n_purchases_30d"),
        (F.sum(F.col("sales_channel_id").cast("long") - 1).cast("double") / F.count("sales_channel_id")).alias("online_ratio"),
    )


def article_popularity(cat: Catalog, as_of: date, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """Over all customers, always: its counts and percentile are catalogue-wide. The percentile needs
    one order over the articles sold in the window, a list that is bounded by the catalogue."""
    week, earlier = count_if(_since(as_of, 7)), count_if(_since(as_of, 14) & ~_since(as_of, 7))
    blocks = window_scan(cat.tx, as_of, lookback).groupBy("article_id").agg(
        F.count("*").alias("n_sold"), F.countDistinct("customer_key").alias("n_buyers"), exact_avg("price").alias("avg_price"),
        F.min("price").alias("min_price"), F.max("price").alias("max_price"),
        (1.0 - F.min("price").cast("double") / F.nullif(F.max("price").cast("double"), F.lit(0.0))).alias("max_discount"),
        count_if(_since(as_of, 1)).alias("n_sold_1d"), week.alias("n_sold_7d"), count_if(_since(as_of, 30)).alias("n_sold_30d"),
        days_before(as_of, F.min("t_dat")).alias("days_since_first_sale"), days_before(as_of, F.max("t_dat")).alias("days_since_last_sale"),
        ((week + 1).cast("double") / (earlier + 1)).alias("trend_ratio"),
    )
    return blocks.withColumn("price_pctile", F.percent_rank().over(Window.orderBy("avg_price")))


def customer_article_affinity(cat: Catalog, as_of: date, lookback: int = LOOKBACK_DAYS, population: DataFrame | None = None) -> DataFrame:
    rows = of_population(window_scan(cat.tx, as_of, lookback), population)
    counts = rows.groupBy("customer_key", "article_id").agg(F.count("*").alias("ca_n_purchases"), days_before(as_of, F.max("t_dat")).alias("ca_days_since_last"), F.min("price").alias("ca_min_price_paid"))
    return counts.withColumn("ca_share_of_purchases", share_of("customer_key", "ca_n_purchases"))


def _with_article(cat: Catalog, as_of: date, lookback: int, population: DataFrame | None, column: str) -> DataFrame:
    rows = of_population(window_scan(cat.tx, as_of, lookback), population)
    return merged(rows, cat.articles.select("article_id", column), "article_id")


def customer_productcode_affinity(cat: Catalog, as_of: date, lookback: int = LOOKBACK_DAYS, population: DataFrame | None = None) -> DataFrame:
    rows = _with_article(cat, as_of, lookback, population, "product_code")
    counts = rows.groupBy("customer_key", "product_code").agg(F.count("*").alias("cpc_n_purchases"), F.countDistinct("article_id").alias("cpc_n_variants"), days_before(as_of, F.max("t_dat")).alias("cpc_days_since_last"))
    return counts.withColumn("cpc_share", share_of("customer_key", "cpc_n_purchases"))


def customer_group(cat: Catalog, as_of: date, lookback: int = LOOKBACK_DAYS, population: DataFrame | None = None) -> DataFrame:
    rows = _with_article(cat, as_of, lookback, population, "product_group_name")
    counts = rows.groupBy("customer_key", "product_group_name").agg(F.count("*").alias("cg_n_purchases"), days_before(as_of, F.max("t_dat")).alias("cg_days_since_last"))
    return counts.withColumn("cg_share", share_of("customer_key", "cg_n_purchases"))


@dataclass(frozen=True)
class FeatureSources:
    customer: DataFrame
    article: DataFrame
    affinity: DataFrame
    category: DataFrame
    product_code: DataFrame

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(k, getattr(self, k)) for k in self.__dataclass_fields__]


def offline_sources(cat: Catalog, as_of: date, lookback: int = LOOKBACK_DAYS, population: DataFrame | None = None) -> FeatureSources:
    window = (cat, as_of, lookback)
    return FeatureSources(customer_recency(*window, population), article_popularity(*window), customer_article_affinity(*window, population), customer_group(*window, population), customer_productcode_affinity(*window, population))


def assemble(candidates: DataFrame, sources: FeatureSources, cat: Catalog) -> DataFrame:
    """Candidates and all their features; unmatched counts and shares are 0, anything else unmatched
    stays null. Rows come in no order; sinks sort. No block is broadcast."""
    customer = sources.customer.select(
        "customer_key", "n_purchases", "n_unique_items", "n_active_days", F.col("avg_price").alias("cust_avg_price"), F.col("max_price").alias("cust_max_price"),
        F.col("std_price").alias("cust_std_price"), "days_since_last", "days_since_first", "n_purchases_7d", "n_purchases_30d", "online_ratio",
    )
    person = cat.customers.select("customer_key", "age", "fn", "active", "club_member_status", "fashion_news_frequency")
    article = sources.article.select(
        "article_id", "n_sold", "n_buyers", F.col("avg_price").alias("art_avg_price"), "max_discount", "n_sold_1d", "n_sold_7d", "n_sold_30d",
        "days_since_first_sale", "days_since_last_sale", "trend_ratio", "price_pctile",
    )
    attributes = cat.articles.select("article_id", "product_code", "product_group_name", "index_group_name", "garment_group_name", "product_type_no", "section_no", "department_no", "perceived_colour_value_id", "graphical_appearance_no")
    blocks = [
        (attributes, ["article_id"]), (article, ["article_id"]), (customer, ["customer_key"]), (person, ["customer_key"]),
        (sources.affinity.drop("ca_min_price_paid"), ["customer_key", "article_id"]),
        (sources.category, ["customer_key", "product_group_name"]), (sources.product_code, ["customer_key", "product_code"]),
    ]
    joined = candidates
    for block, keys in blocks:
        joined = merged(joined, block, keys, "left")
    spread = F.nullif(F.col("cust_std_price"), F.lit(0.0))
    derived = joined.withColumn("price_ratio", F.col("art_avg_price") / F.nullif(F.col("cust_avg_price"), F.lit(0.0))).withColumn("price_z", (F.col("art_avg_price") - F.col("cust_avg_price")) / spread)
    return derived.fillna(0, ZERO_FILLED).drop("product_code")


def build_features(candidates: DataFrame, cat: Catalog, as_of: date, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    population = candidates.select("customer_key").distinct()
    return assemble(candidates, offline_sources(cat, as_of, lookback, population), cat)


def feature_columns(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c not in NON_FEATURES]


def downcast(frame: DataFrame) -> DataFrame:
    """Doubles to floats."""
    return frame.select(*[F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes])
