"""The three base tables as an explicit value: no operator looks tables up by name."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators.scans import between


@dataclass(frozen=True)
class Catalog:
    tx: DataFrame  # t_dat, customer_key, article_id, price, sales_channel_id[, t_year, t_month]
    articles: DataFrame
    customers: DataFrame

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> Catalog:
        """What ``sources.ingest`` writes."""
        return cls(*(spark.read.parquet(f"{root}/{name}") for name in ("transactions", "articles", "customers")))

    @classmethod
    def from_star_schema(cls, spark: SparkSession, root: str) -> Catalog:
        """The same three tables over orders, lineitem, part and customer."""
        read = lambda name: spark.read.parquet(f"{root}/{name}.parquet")
        lines = read("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
        orders = read("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("t_dat"))
        tx = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
            "t_dat", F.col("o_custkey").alias("customer_key"), F.col("l_partkey").cast("int").alias("article_id"),
            F.col("l_extendedprice").alias("price"), (1 + F.col("l_linenumber") % 2).cast("int").alias("sales_channel_id"),
        )
        key, name = F.col("p_partkey"), F.split("p_name", " ")
        articles = read("part").select(
            key.cast("int").alias("article_id"), F.floor(key / 8).alias("product_code"), F.col("p_type").alias("product_group_name"),
            F.col("p_brand").alias("index_group_name"), F.coalesce(F.get(name, 1), F.lit("")).alias("garment_group_name"), F.col("p_size").alias("product_type_no"),
            (F.col("p_size") % 10).alias("section_no"), (key % 50).alias("department_no"), (key % 8).alias("perceived_colour_value_id"),
            (key % 30).alias("graphical_appearance_no"), F.col("p_name").alias("prod_name"), F.col("p_type").alias("product_type_name"),
            name[0].alias("colour_group_name"), F.col("p_name").alias("detail_desc"),
        )
        c, nation = F.col("c_custkey"), F.col("c_nationkey")
        customers = read("customer").select(
            c.alias("customer_key"), F.lpad(F.lower(F.hex(c)), 64, "0").alias("customer_id"),
            F.when(c % 13 != 0, (16 + (c * 7) % 70).cast("double")).alias("age"), F.when(nation % 3 == 0, F.lit(1.0)).alias("fn"),
            F.when(nation % 5 == 0, F.lit(1.0)).alias("active"), F.col("c_mktsegment").alias("club_member_status"),
            F.when(nation % 3 == 0, "Regularly").when(nation % 3 == 1, "Monthly").otherwise("NONE").alias("fashion_news_frequency"),
        )
        return cls(tx, articles, customers)

    def truncated(self, as_of: date) -> Catalog:
        """The log as it stood at ``as_of``: what a leakage test compares against."""
        return replace(self, tx=self.tx.filter(F.col("t_dat") < F.lit(as_of)))

    def buyers(self, start: date, end: date) -> DataFrame:
        return between(self.tx, start, end).select("customer_key").distinct()

    def register_views(self) -> None:
        """For SQL users: the views transactions, articles and customers."""
        for name, frame in (("transactions", self.tx), ("articles", self.articles), ("customers", self.customers)):
            frame.createOrReplaceTempView(name)
