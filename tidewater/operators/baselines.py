"""Baselines: bestsellers, repurchase, padding, implicit matrix factorisation, exact vector search."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..catalog import Catalog
from ..config import LOOKBACK_DAYS, TOP_K
from ..functions.scalars import dot, ranked
from ..sources.staging import written
from .retrieval import age_popularity_table, global_popularity_table, normalize, repurchase
from .scans import of_population, window_scan


def top_articles(cat: Catalog, as_of: date, days: int = 7, k: int = TOP_K) -> DataFrame:
    """article_id, rank."""
    return global_popularity_table(cat, as_of, k, days).select("article_id", F.col("rank").cast("long"))


def top_articles_by_age_bucket(cat: Catalog, as_of: date, days: int = 7, k: int = TOP_K) -> DataFrame:
    return age_popularity_table(cat, as_of, k, days).select("age_bucket", "article_id", F.col("rank").cast("long"))


def repurchase_lists(cat: Catalog, population: DataFrame, as_of: date, lookback: int = LOOKBACK_DAYS, k: int = TOP_K) -> DataFrame:
    return repurchase(cat, population, as_of, k, lookback).select("customer_key", "article_id", F.col("rank").alias("pos"))


def pad(preds: DataFrame, population: DataFrame, filler: DataFrame, k: int = TOP_K) -> DataFrame:
    """customer_key, article_id, pos: the first k of each customer's predictions, then fillers
    (article_id, rank) that aren't among these, cut to k. Lists may stay short."""
    own = preds.filter(F.col("pos") <= k).join(population.select("customer_key"), "customer_key", "left_semi")
    listed = filler.agg(F.sort_array(F.collect_list(F.struct("rank", "article_id"))).alias("fill")).withColumn("one", F.lit(1))
    mine = own.groupBy("customer_key").agg(F.sort_array(F.collect_list(F.struct("pos", "article_id"))).alias("own"))
    people = population.select("customer_key", F.lit(1).alias("one")).join(mine, "customer_key", "left").join(F.broadcast(listed), "one")
    first = F.coalesce(F.transform("own", lambda x: x["article_id"]), F.array().cast("array<int>"))
    rest = F.transform(F.col("fill"), lambda x: x["article_id"])
    whole = F.slice(F.concat(first, F.filter(rest, lambda a: ~F.array_contains(first, a))), F.lit(1), F.lit(k))
    return people.select("customer_key", F.posexplode(whole).alias("pos", "article_id")).select("customer_key", "article_id", (F.col("pos") + 1).cast("long").alias("pos"))


def b2(cat: Catalog, population: DataFrame, as_of: date, k: int = TOP_K) -> DataFrame:
    return pad(repurchase_lists(cat, population, as_of, k=k), population, top_articles(cat, as_of, k=k), k)


def interactions(cat: Catalog, population: DataFrame | None, as_of: date, lookback: int = 365) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(user, item, rating) with dense integer indices, and both index tables."""
    counts = of_population(window_scan(cat.tx, as_of, lookback), population).groupBy("customer_key", "article_id").agg(F.count("*").cast("float").alias("rating"))

    def index(column: str, name: str) -> DataFrame:
        # dense over partitions: position in the partition plus the sizes of the partitions before
        # written, as a lost executor mustn't number rows anew between two reads
        ordered = written(counts.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column).withColumn("_at", F.monotonically_increasing_id()), f"index-{name}")
        part = F.shiftright("_at", 33)
        sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
        before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        return ordered.withColumn("part", part).join(F.broadcast(before), "part").select(column, (F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before")).cast("int").alias(name))

    users, items = index("customer_key", "user"), index("article_id", "item")
    return counts.join(users, "customer_key").join(items, "article_id").select("user", "item", "rating"), users, items


def fit_als(ratings: DataFrame, rank: int = 128, reg: float = 0.05, alpha: float = 40.0, iterations: int = 15, seed: int = 42) -> ALSModel:
    return ALS(userCol="user", itemCol="item", ratingCol="rating", implicitPrefs=True, rank=rank, regParam=reg, alpha=alpha, maxIter=iterations, seed=seed).fit(ratings)


def recommend_als(model: ALSModel, users: DataFrame, items: DataFrame, population: DataFrame, n: int = 50) -> DataFrame:
    """Long contract; known customers only, bought articles included; score = n - position."""
    known = users.join(population.select("customer_key"), "customer_key", "left_semi")
    found = model.recommendForUserSubset(known.select("user"), n).select("user", F.posexplode("recommendations").alias("i", "r"))
    rows = found.select("user", "i", F.col("r.item").alias("item")).join(known, "user").join(items, "item")
    return normalize(rows.withColumn("rank", F.col("i") + 1).withColumn("score", F.lit(n) - F.col("i")), "r4_als")


#: Query vectors that are broadcast at once.
BLOCK_QUERIES = 10_000


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, id_col: str, vector_col: str, block: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, id, rank, score: exact inner product of a stated set of queries against all vectors. At
    most ``block`` queries are broadcast at once, and each block reads the vectors once; a task keeps the
    best ``k`` of its part for each query before anything is shuffled."""
    blocks = max(1, -(-queries.count() // block))
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("_q"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("_v"))

    def one(b: int) -> DataFrame:
        mine = F.broadcast(asked.filter(F.pmod(F.hash("query_id"), F.lit(blocks)) == b))
        return rows.join(mine, F.lit(True)).select("query_id", "id", F.round(dot("_q", "_v"), 6).alias("score"))

    scored = reduce(DataFrame.unionByName, map(one, range(blocks)))
    return scored.withColumn("rank", ranked("query_id", F.desc("score"), F.asc("id"))).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def save_factors(model: ALSModel, items: DataFrame, root: str) -> None:
    """The model, and its item factors by article id: what serving needs to score and to search."""
    model.write().overwrite().save(f"{root}/als")
    factors = model.itemFactors.withColumnRenamed("id", "item").join(items, "item").select("article_id", F.col("features").alias("factor"))
    factors.write.option("compression", "zstd").mode("overwrite").parquet(f"{root}/item_factors")


def load_factors(spark: SparkSession, root: str) -> tuple[ALSModel, DataFrame]:
    """The model and article_id, factor."""
    return ALSModel.load(f"{root}/als"), spark.read.parquet(f"{root}/item_factors")


def similar_articles(factors: DataFrame, articles: DataFrame, k: int) -> DataFrame:
    """query_id, id, rank, score: the articles whose factors have the largest inner product with those of
    each of ``articles`` (article_id)."""
    return vector_top_k(factors.join(articles.select("article_id"), "article_id", "left_semi"), factors, k, "article_id", "factor")
