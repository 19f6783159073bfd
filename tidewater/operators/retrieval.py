"""Retrieval strategies. Each gives the long contract: customer_key, article_id, source, rank (from 1),
score (comparable only within a source)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..catalog import Catalog
from ..config import LOOKBACK_DAYS
from ..functions.scalars import age_bucket, days_before, ranked
from .scans import merged, of_population, window_scan

LONG = "customer_key long, article_id int, source string, rank long, score double"


def normalize(frame: DataFrame, source: str) -> DataFrame:
    return frame.select(F.col("customer_key").cast("long"), F.col("article_id").cast("int"), F.lit(source).alias("source"), F.col("rank").cast("long"), F.col("score").cast("double"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _top(frame: DataFrame, n: int, source: str, *order) -> DataFrame:
    return normalize(frame.withColumn("rank", ranked("customer_key", *order)).filter(F.col("rank") <= n), source)


def repurchase(cat: Catalog, population: DataFrame | None, as_of: date, n: int = 30, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    rows = of_population(window_scan(cat.tx, as_of, lookback), population)
    owned = rows.groupBy("customer_key", "article_id").agg(F.count("*").alias("score"), F.max("t_dat").alias("last"))
    return _top(owned, n, "r1_repurchase", F.desc("last"), F.desc("score"), F.asc("article_id"))


def age_popularity_table(cat: Catalog, as_of: date, n: int = 200, days: int = 7) -> DataFrame:
    """age_bucket, article_id, score, rank."""
    buckets = cat.customers.select("customer_key", age_bucket(F.col("age")).alias("age_bucket"))
    sold = merged(window_scan(cat.tx, as_of, days), buckets, "customer_key").groupBy("age_bucket", "article_id").agg(F.count("*").alias("score"))
    return sold.withColumn("rank", ranked("age_bucket", F.desc("score"), F.asc("article_id"))).filter(F.col("rank") <= n)


def age_popularity(cat: Catalog, population: DataFrame, as_of: date, n: int = 30, days: int = 7) -> DataFrame:
    """Customers that the customer table lacks get nothing."""
    people = of_population(cat.customers.select("customer_key", age_bucket(F.col("age")).alias("age_bucket")), population)
    return normalize(people.join(age_popularity_table(cat, as_of, n, days), "age_bucket"), "r2_popularity")


def global_popularity_table(cat: Catalog, as_of: date, n: int = 400, days: int = 7) -> DataFrame:
    """article_id, score, rank: a top-k first, so that only n rows are ever ranked in one place."""
    top = window_scan(cat.tx, as_of, days).groupBy("article_id").agg(F.count("*").alias("score")).orderBy(F.desc("score"), "article_id").limit(n)
    return top.withColumn("one", F.lit(1)).withColumn("rank", ranked("one", F.desc("score"), F.asc("article_id"))).drop("one")


def global_popularity(cat: Catalog, population: DataFrame, as_of: date, n: int = 30, days: int = 7) -> DataFrame:
    """The list is one row with an array of n entries, so each customer's rows come from a generator."""
    listed = global_popularity_table(cat, as_of, n, days).agg(F.sort_array(F.collect_list(F.struct("rank", "article_id", "score"))).alias("list"))
    rows = population.select("customer_key", F.lit(1).alias("one")).join(F.broadcast(listed.withColumn("one", F.lit(1))), "one")
    return normalize(rows.select("customer_key", F.inline("list")), "r2b_global")


def item_neighbours(cat: Catalog, as_of: date, lookback: int = LOOKBACK_DAYS, n_neighbours: int = 40, min_co: int = 3) -> DataFrame:
    """article_id, neighbour, sim. Rows of a basket (customer and day) are added up by article before
    the self-join; a pair then counts the product of both, as single rows would."""
    rows = window_scan(cat.tx, as_of, lookback)
    basket = rows.groupBy("customer_key", "t_dat", "article_id").agg(F.count("*").alias("m"))
    left, right = (basket.select("customer_key", "t_dat", F.col("article_id").alias(a), F.col("m").alias(f"m_{a}")) for a in ("i", "j"))
    pairs = left.join(right, ["customer_key", "t_dat"]).filter("i < j").groupBy("i", "j").agg(F.sum(F.col("m_i") * F.col("m_j")).alias("co")).filter(F.col("co") >= min_co)
    sold = rows.groupBy("article_id").agg(F.count("*").alias("n"))
    sims = pairs.join(sold.select(F.col("article_id").alias("i"), F.col("n").alias("n_i")), "i").join(sold.select(F.col("article_id").alias("j"), F.col("n").alias("n_j")), "j")
    sims = sims.withColumn("sim", F.col("co") / F.sqrt(F.col("n_i").cast("double") * F.col("n_j")))
    both = sims.select("sim", F.inline(F.array(F.struct(F.col("i").alias("article_id"), F.col("j").alias("neighbour")), F.struct(F.col("j").alias("article_id"), F.col("i").alias("neighbour")))))
    return both.withColumn("r", ranked("article_id", F.desc(F.round("sim", 12)), F.asc("neighbour"))).filter(F.col("r") <= n_neighbours).select("article_id", "neighbour", "sim")


def item_knn(cat: Catalog, population: DataFrame, as_of: date, n: int = 50, lookback: int = LOOKBACK_DAYS, seed_lookback: int = LOOKBACK_DAYS, n_seeds: int = 20, n_neighbours: int = 40, min_co: int = 3, source: str = "r3_item_knn") -> DataFrame:
    rows = of_population(window_scan(cat.tx, as_of, seed_lookback), population)
    seeds = rows.groupBy("customer_key", "article_id").agg(F.max("t_dat").alias("last")).withColumn("seed_rank", ranked("customer_key", F.desc("last"), F.asc("article_id"))).filter(F.col("seed_rank") <= n_seeds)
    near = item_neighbours(cat, as_of, lookback, n_neighbours, min_co)
    scored = seeds.join(near, "article_id").groupBy("customer_key", F.col("neighbour").alias("article_id")).agg(F.round(F.sum(F.col("sim") / F.col("seed_rank")), 12).alias("score"))
    return _top(scored, n, source, F.desc("score"), F.asc("article_id"))


def last_item_knn(cat: Catalog, population: DataFrame, as_of: date, n: int = 100, **settings) -> DataFrame:
    return item_knn(cat, population, as_of, n, **({"n_seeds": 1, "n_neighbours": 60, "source": "r3_last_knn"} | settings))


def category(cat: Catalog, population: DataFrame | None, as_of: date, n: int = 30, lookback: int = LOOKBACK_DAYS, days: int = 7, n_groups: int = 3, n_per_group: int = 20) -> DataFrame:
    groups = cat.articles.select("article_id", "product_group_name")
    liked = merged(of_population(window_scan(cat.tx, as_of, lookback), population), groups, "article_id").groupBy("customer_key", "product_group_name").agg(F.count("*").alias("g"))
    liked = liked.withColumn("r", ranked("customer_key", F.desc("g"), F.asc("product_group_name"))).filter(F.col("r") <= n_groups)
    sold = merged(window_scan(cat.tx, as_of, days), groups, "article_id").groupBy("product_group_name", "article_id").agg(F.count("*").alias("p"))
    sold = sold.withColumn("r", ranked("product_group_name", F.desc("p"), F.asc("article_id"))).filter(F.col("r") <= n_per_group)
    scored = liked.drop("r").join(sold.drop("r"), "product_group_name").withColumn("score", F.col("g") * F.col("p"))
    return _top(scored, n, "r5_category", F.desc("score"), F.asc("article_id"))


def product_variant(cat: Catalog, population: DataFrame | None, as_of: date, n: int = 50, lookback: int = LOOKBACK_DAYS, days: int = 14) -> DataFrame:
    codes = cat.articles.select("article_id", "product_code")
    owned = merged(of_population(window_scan(cat.tx, as_of, lookback), population), codes, "article_id").groupBy("customer_key", "product_code").agg(F.count("*").alias("n_owned"), days_before(as_of, F.max("t_dat")).alias("days"))
    sold = merged(window_scan(cat.tx, as_of, days), codes, "article_id").groupBy("product_code", "article_id").agg(F.count("*").alias("n_sold"))
    scored = merged(owned, sold, "product_code").withColumn("score", (F.col("n_sold") * F.col("n_owned")).cast("double") / (1 + F.col("days")))
    return _top(scored, n, "r6_product_variant", F.desc("score"), F.asc("article_id"))


Strategy = Callable[[Catalog, DataFrame, date], DataFrame]
#: Strategies that propose candidates, with their budgets.
GENERATORS: dict[str, Strategy] = {
    "r1_repurchase": lambda cat, pop, as_of: repurchase(cat, pop, as_of, 50),
    "r2_popularity": lambda cat, pop, as_of: age_popularity(cat, pop, as_of, 200),
    "r2b_global": lambda cat, pop, as_of: global_popularity(cat, pop, as_of, 400),
    "r5_category": lambda cat, pop, as_of: category(cat, pop, as_of, 100),
    "r6_product_variant": lambda cat, pop, as_of: product_variant(cat, pop, as_of, 150),
}
#: Strategies that only describe candidates of the others.
ANNOTATORS: dict[str, Strategy] = {}


def retrieve(cat: Catalog, population: DataFrame, as_of: date, strategies: dict[str, Strategy] | None = None) -> DataFrame:
    return union([f(cat, population, as_of) for f in (GENERATORS if strategies is None else strategies).values()])
