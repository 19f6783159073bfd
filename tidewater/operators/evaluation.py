"""Ground truth, ranking metrics, segments, error analysis, ablations. Predictions are long:
customer_key, article_id, pos (from 1)."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..catalog import Catalog
from ..config import TOP_K
from ..functions.scalars import days_before, ranked
from .scans import history_scan, of_population, target_scan, window_scan


def ground_truth(cat: Catalog, as_of: date) -> DataFrame:
    """customer_key, article_id bought in the target week, once each."""
    return target_scan(cat.tx, as_of).select("customer_key", "article_id").distinct()


def truth_lists(truth: DataFrame) -> DataFrame:
    return truth.groupBy("customer_key").agg(F.sort_array(F.collect_set("article_id")).alias("articles"))


def eval_customers(cat: Catalog, as_of: date) -> DataFrame:
    return target_scan(cat.tx, as_of).select("customer_key").distinct()


def _hits(preds: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    return preds.filter(F.col("pos") <= k).join(truth, ["customer_key", "article_id"], "left_semi")


def _per_customer(truth: DataFrame, gained: DataFrame, population: DataFrame | None) -> DataFrame:
    """customer_key, n_truth (0 without truth) and the columns of ``gained``."""
    sizes = truth.groupBy("customer_key").agg(F.countDistinct("article_id").alias("n_truth"))
    people = sizes if population is None else population.select("customer_key").join(sizes, "customer_key", "left").fillna(0, ["n_truth"])
    return people.join(gained, "customer_key", "left")


def average_precision(truth: DataFrame, preds: DataFrame, k: int = TOP_K, population: DataFrame | None = None) -> DataFrame:
    """customer_key, ap. A repeated prediction takes its position but counts once; without truth 0."""
    first = _hits(preds, truth, k).groupBy("customer_key", "article_id").agg(F.min("pos").alias("pos"))
    gain = first.withColumn("hit", ranked("customer_key", F.asc("pos"))).groupBy("customer_key").agg(F.sum(F.col("hit").cast("double") / F.col("pos")).alias("gain"))
    ap = F.when(F.col("n_truth") > 0, F.coalesce("gain", F.lit(0.0)) / F.least("n_truth", F.lit(k))).otherwise(0.0)
    return _per_customer(truth, gain, population).select("customer_key", F.round(ap, 12).alias("ap"))


def mean_average_precision(truth: DataFrame, preds: DataFrame, k: int = TOP_K, population: DataFrame | None = None) -> DataFrame:
    return average_precision(truth, preds, k, population).agg(F.coalesce(F.round(F.avg("ap"), 9), F.lit(0.0)).alias("map"))


def recall(truth: DataFrame, preds: DataFrame, k: int = TOP_K) -> DataFrame:
    """customer_key, recall; customers without truth have no row."""
    found = _hits(preds, truth, k).groupBy("customer_key").agg(F.countDistinct("article_id").alias("found"))
    return _per_customer(truth, found, None).select("customer_key", (F.coalesce("found", F.lit(0)).cast("double") / F.col("n_truth")).alias("recall"))


def mean_recall(truth: DataFrame, preds: DataFrame, k: int = TOP_K) -> DataFrame:
    return recall(truth, preds, k).agg(F.round(F.avg("recall"), 9).alias("recall"))


def _discount(pos: Column) -> Column:
    return 1.0 / F.log2(pos + 1)


def ndcg(truth: DataFrame, preds: DataFrame, k: int = TOP_K, population: DataFrame | None = None) -> DataFrame:
    """customer_key, ndcg: binary gains, repeated predictions each count."""
    gain = _hits(preds, truth, k).groupBy("customer_key").agg(F.sum(_discount(F.col("pos"))).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_truth").cast("int"), F.lit(k))), F.lit(0.0), lambda s, i: s + _discount(i))
    value = F.when(F.col("n_truth") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0)
    return _per_customer(truth, gain, population).select("customer_key", F.round(value, 9).alias("ndcg"))


def coverage(population: DataFrame, preds: DataFrame) -> DataFrame:
    """Share of customers with at least one prediction."""
    served = population.join(preds.select("customer_key").distinct().withColumn("served", F.lit(1)), "customer_key", "left")
    return served.agg((F.count("served").cast("double") / F.count("*")).alias("coverage"))


def evaluate(truth: DataFrame, preds: DataFrame, k: int = TOP_K) -> DataFrame:
    """One row: map, recall, coverage. Customers without predictions count as empty lists."""
    per = average_precision(truth, preds, k).join(recall(truth, preds, k), "customer_key").join(preds.select("customer_key").distinct().withColumn("served", F.lit(1)), "customer_key", "left")
    return per.agg(F.round(F.avg("ap"), 9).alias("map"), F.round(F.avg("recall"), 9).alias("recall"), (F.count("served").cast("double") / F.count("*")).alias("coverage"))


def check_lengths(truths: list, predictions: list) -> None:
    """For callers that hold lists: both must cover the same customers."""
    if len(truths) != len(predictions):
        raise ValueError(f"{len(truths)} truth lists but {len(predictions)} prediction lists")


def recency_segment(recency: Column) -> Column:
    return F.when(recency.isNull(), "0 never purchased").when(recency <= 7, "1 active <=7d").when(recency <= 30, "2 active 8-30d").when(recency <= 90, "3 active 31-90d").otherwise("4 dormant >90d")


def customer_segments(cat: Catalog, population: DataFrame, as_of: date) -> DataFrame:
    prior = of_population(history_scan(cat.tx, as_of), population).groupBy("customer_key").agg(F.count("*").alias("n_prior"), days_before(as_of, F.max("t_dat")).alias("recency"))
    rows = population.select("customer_key").join(prior, "customer_key", "left").join(cat.customers.select("customer_key", "age"), "customer_key", "left").fillna(0, ["n_prior"])
    n, age = F.col("n_prior"), F.col("age")
    return rows.select(
        "customer_key", "n_prior", "recency", "age", recency_segment(F.col("recency")).alias("recency_segment"),
        F.when(n == 0, "0 none").when(n <= 5, "1 low (1-5)").when(n <= 20, "2 mid (6-20)").when(n <= 60, "3 high (21-60)").otherwise("4 very high (60+)").alias("frequency_segment"),
        F.when(age.isNull(), "unknown").when(age < 25, "<25").when(age < 35, "25-34").when(age < 50, "35-49").otherwise("50+").alias("age_segment"),
    )


def segment_table(segments: DataFrame, column: str, ap_model: DataFrame, ap_b2: DataFrame) -> DataFrame:
    rows = segments.select("customer_key", column).join(ap_model.withColumnRenamed("ap", "m"), "customer_key").join(ap_b2.withColumnRenamed("ap", "b"), "customer_key")
    table = rows.groupBy(column).agg(F.count("*").alias("customers"), F.avg("m").alias("m"), F.avg("b").alias("b"))
    lift = F.round(F.col("m") / F.nullif(F.round("b", 12), F.lit(0.0)) - 1, 3)
    return table.select(column, "customers", F.round("m", 5).alias("map_model"), F.round("b", 5).alias("map_b2"), lift.alias("lift"))


def popularity_deciles(cat: Catalog, as_of: date, truth: DataFrame, preds: DataFrame) -> DataFrame:
    """Purchases of the target week by the item's decile of 30-day sales (0: unsold). Deciles cut the
    catalogue's sold articles, ordered by sales and id, which are ranked in one place."""
    sold = window_scan(cat.tx, as_of, 30).groupBy("article_id").agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(1))
    r, n = F.row_number().over(everything.orderBy("n", "article_id")), F.count("*").over(everything)
    decile = F.greatest(F.lit(1), F.ceil((r - 1) * 10 / F.greatest(n - 1, F.lit(1)))).cast("long")
    rows = truth.join(sold.select("article_id", decile.alias("decile")), "article_id", "left").fillna(0, ["decile"])
    rows = rows.join(preds.select("customer_key", "article_id").distinct().withColumn("hit", F.lit(1)), ["customer_key", "article_id"], "left")
    table = rows.groupBy("decile").agg(F.count("*").alias("purchases"), F.count("hit").alias("hits"))
    total = F.sum("purchases").over(Window.partitionBy(F.lit(1)))
    return table.select("decile", "purchases", F.round(F.col("hits") / F.col("purchases"), 6).alias("hit_rate"), F.round(F.col("purchases") / total, 6).alias("share_of_truth"))


def diversity(cat: Catalog, preds: DataFrame) -> DataFrame:
    """One row: distinct items, catalogue coverage, entropy of categories in bits and its maximum,
    share of the item that is recommended most."""
    items = preds.groupBy("article_id").agg(F.count("*").alias("n")).join(cat.articles.select("article_id", "product_group_name"), "article_id", "left").fillna("unknown", ["product_group_name"])
    totals = items.agg(F.count("*").alias("distinct_items_recommended"), F.max("n").alias("top"), F.sum("n").alias("total"))
    groups = items.groupBy("product_group_name").agg(F.sum("n").alias("g"))
    p = F.col("g") / F.col("total")
    entropy = groups.join(F.broadcast(totals.select("total")), F.lit(True)).agg(F.round(-F.sum(p * F.log2(p)), 6).alias("category_entropy_bits"), F.round(F.log2(F.count("*")), 6).alias("max_category_entropy_bits"))
    size = cat.articles.agg(F.count("*").alias("catalogue"))
    one = totals.join(F.broadcast(entropy), F.lit(True)).join(F.broadcast(size), F.lit(True))  # one row each
    return one.select("distinct_items_recommended", F.round(F.col("distinct_items_recommended") / F.col("catalogue"), 6).alias("catalogue_coverage"), "category_entropy_bits", "max_category_entropy_bits", F.round(F.col("top") / F.col("total"), 6).alias("most_recommended_item_share"))


def labelled(name: str, value, frame: DataFrame) -> DataFrame:
    return frame.select(F.lit(value).alias(name), *frame.columns)


def recall_table(truth: DataFrame, named: list[tuple[str, object, DataFrame]]) -> DataFrame:
    """(label, value, recall@k frames) stacked."""
    return reduce(DataFrame.unionByName, [labelled(name, value, frame) for name, value, frame in named])


def mean_ap_by(per_week: DataFrame) -> DataFrame:
    """One row of ``customers``, ``map_model``, ``map_b2`` and ``lift`` (null if B2 hits nothing) of
    customer_key, m, b."""
    maps = per_week.agg(F.count("*").alias("customers"), F.round(F.avg("m"), 9).alias("map_model"), F.round(F.avg("b"), 9).alias("map_b2"))
    return maps.withColumn("lift", F.round(F.col("map_model") / F.nullif(F.col("map_b2"), F.lit(0.0)) - 1, 3))


def evaluate_week(truth: DataFrame, model: DataFrame, b2: DataFrame, k: int = TOP_K) -> DataFrame:
    """A model's lists against B2's, over the buyers of a week."""
    ap = lambda preds, name: average_precision(truth, preds, k).withColumnRenamed("ap", name)
    return mean_ap_by(ap(model, "m").join(ap(b2, "b"), "customer_key"))


def sampled(population: DataFrame, n: int | None, seed: int = 0) -> DataFrame:
    """``n`` customers, the same for one seed on any partitioning; all if None."""
    return population if n is None else population.orderBy(F.xxhash64(F.lit(seed), "customer_key"), "customer_key").limit(n)


def budget_sweep(truth: DataFrame, scored: DataFrame, budgets: list[int], k: int = TOP_K) -> DataFrame:
    """budget, recall, map: of the first ``budget`` candidates of each customer the share of purchases
    among them, and the MAP of the ``k`` best by score. ``scored``: customer_key, article_id, cand_rank,
    score; built once, at the largest budget."""

    def one(budget: int) -> DataFrame:
        held = scored.filter(F.col("cand_rank") <= budget)
        best = held.withColumn("pos", ranked("customer_key", F.desc("score"), F.asc("article_id"))).filter(F.col("pos") <= k)
        found = recall(truth, held.withColumn("pos", F.col("cand_rank")), budget).join(average_precision(truth, best, k), "customer_key")
        return found.agg(F.round(F.avg("recall"), 9).alias("recall"), F.round(F.avg("ap"), 9).alias("map")).select(F.lit(budget).cast("long").alias("budget"), "recall", "map")

    return reduce(DataFrame.unionByName, map(one, budgets))


def source_report(truth: DataFrame, population: DataFrame, long: DataFrame, sources: list[str], k: int = 300) -> DataFrame:
    """source, recall, coverage of each strategy's own list."""

    def one(source: str) -> DataFrame:
        mine = long.filter(F.col("source") == source).select("customer_key", "article_id", F.col("rank").alias("pos"))
        return mean_recall(truth, mine, k).join(F.broadcast(coverage(population, mine)), F.lit(True)).select(F.lit(source).alias("source"), "recall", "coverage")

    return reduce(DataFrame.unionByName, map(one, sources))
