"""Serving snapshot: tables precomputed for one as_of, batch recommendation from them, parity with the
offline path, console tables and service figures."""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import Catalog
from ..config import ABSENT_RANK, ABSENT_SCORE, TOP_K, target_window
from ..functions.scalars import age_bucket, days_before, linear_percentiles, ranked
from ..sources.reports import read_json, write_json
from . import features, retrieval
from .features import FeatureSources, assemble, offline_sources
from .fusion import build_candidates
from .scans import history_scan, target_scan

BLOCKS = ("customer", "article", "affinity", "category", "product_code")
RETRIEVAL = ("repurchase", "popularity_age", "popularity_global", "category_candidates", "variants")


def all_customers(cat: Catalog) -> DataFrame:
    """Every customer of the log, whenever they bought."""
    return cat.tx.select("customer_key").distinct()


def snapshot_tables(cat: Catalog, as_of: date) -> dict[str, DataFrame]:
    sources = offline_sources(cat, as_of)
    tables = {f"features_{name}": frame for name, frame in sources.items()}
    tables["repurchase"] = retrieval.repurchase(cat, None, as_of, 50)
    tables["popularity_age"] = retrieval.age_popularity_table(cat, as_of, 200)
    tables["popularity_global"] = retrieval.global_popularity_table(cat, as_of, 400)
    tables["category_candidates"] = retrieval.category(cat, None, as_of, 100)
    tables["variants"] = retrieval.product_variant(cat, None, as_of, 150)
    tables["articles"] = cat.articles.select("article_id", "product_code", *features.CATEGORICAL[:3], "product_type_no", "section_no", "department_no", "perceived_colour_value_id", "graphical_appearance_no")
    tables["customers"] = cat.customers.select("customer_key", "age", "fn", "active", "club_member_status", "fashion_news_frequency")
    return tables


def demo_tables(cat: Catalog, as_of: date) -> dict[str, DataFrame]:
    """For the console only: these read the target week, so no request path may join them."""
    start, end = target_window(as_of)
    buyers = cat.buyers(start, end)
    truth = target_scan(cat.tx, as_of).groupBy("customer_key", "article_id").agg(F.count("*").alias("n"))
    past = history_scan(cat.tx, as_of).join(buyers, "customer_key", "left_semi")
    history = past.withColumn("rn", ranked("customer_key", F.desc("t_dat"), F.asc("article_id"), F.asc("price"))).filter("rn <= 40").select("customer_key", "article_id", "t_dat", "price")
    articles = cat.articles.select("article_id", "prod_name", "product_type_name", "colour_group_name", "product_group_name", "index_group_name", "detail_desc")
    prior = past.groupBy("customer_key").agg(F.count("*").alias("n_prior"), days_before(as_of, F.max("t_dat")).alias("recency"))
    people = buyers.join(prior, "customer_key", "left").join(cat.customers.select("customer_key", "age"), "customer_key", "left").fillna(0, ["n_prior"])
    recency = F.col("recency")
    segment = F.when(recency.isNull(), "never purchased").when(recency <= 7, "active <=7d").when(recency <= 30, "active 8-30d").when(recency <= 90, "active 31-90d").otherwise("dormant >90d")
    return {"demo_truth": truth, "demo_history": history, "demo_articles": articles, "demo_segments": people.withColumn("recency_segment", segment)}


def write_snapshot(cat: Catalog, as_of: date, root: str, with_demo: bool = False, **facts) -> None:
    for name, frame in snapshot_tables(cat, as_of).items():
        # a range of customers for each file, in order, so a lookup by key opens one and skips row groups
        keys = [c for c in ("customer_key", "article_id") if c in frame.columns]
        ordered = frame.repartitionByRange("customer_key").sortWithinPartitions(*keys) if "customer_key" in frame.columns else frame
        ordered.write.option("compression", "zstd").mode("overwrite").parquet(f"{root}/{name}")
    if with_demo:
        for name, frame in demo_tables(cat, as_of).items():
            frame.write.option("compression", "zstd").mode("overwrite").parquet(f"{root}/demo/{name}")
    write_json(f"{root}/meta.json", {"as_of": as_of.isoformat(), **facts})


@dataclass(frozen=True)
class Snapshot:
    tables: dict[str, DataFrame]
    as_of: date

    @classmethod
    def open(cls, spark: SparkSession, root: str, in_memory: bool = False) -> Snapshot:
        names = [f"features_{b}" for b in BLOCKS] + [*RETRIEVAL, "articles", "customers"]
        tables = {n: spark.read.parquet(f"{root}/{n}") for n in names}
        return cls({n: t.cache() for n, t in tables.items()} if in_memory else tables, date.fromisoformat(read_json(f"{root}/meta.json")["as_of"]))

    @classmethod
    def lazy(cls, cat: Catalog, as_of: date) -> Snapshot:
        return cls(snapshot_tables(cat, as_of), as_of)

    def lookup(self, name: str, customer_key: int) -> DataFrame:
        """One customer's rows of a table: the key reaches the reader, which skips all other files."""
        return self.tables[name].filter(F.col("customer_key") == customer_key)

    def sources(self, population: DataFrame | None = None) -> FeatureSources:
        def block(name: str) -> DataFrame:
            frame = self.tables[f"features_{name}"]
            return frame.join(population.select("customer_key"), "customer_key", "left_semi") if population is not None and "customer_key" in frame.columns else frame

        return FeatureSources(*map(block, BLOCKS))

    def retrieve(self, population: DataFrame, n: int = 300) -> DataFrame:
        """Candidates of a set of customers from the five retrieval tables."""
        mine = lambda name: self.tables[name].join(population.select("customer_key"), "customer_key", "left_semi")
        people = population.select("customer_key").join(self.tables["customers"].select("customer_key", age_bucket(F.col("age")).alias("age_bucket")), "customer_key")
        by_age = retrieval.normalize(people.join(self.tables["popularity_age"], "age_bucket"), "r2_popularity")
        listed = self.tables["popularity_global"].agg(F.collect_list(F.struct("rank", "article_id", "score")).alias("list")).withColumn("one", F.lit(1))
        by_all = retrieval.normalize(population.select("customer_key", F.lit(1).alias("one")).join(F.broadcast(listed), "one").select("customer_key", F.inline("list")), "r2b_global")
        long = retrieval.union([mine("repurchase"), by_age, by_all, mine("category_candidates"), mine("variants")])
        return build_candidates(long, list(retrieval.GENERATORS), n)

    def features(self, population: DataFrame, n: int = 300) -> DataFrame:
        cat = Catalog(None, self.tables["articles"], self.tables["customers"])
        return assemble(self.retrieve(population, n).drop("cand_rank"), self.sources(population), cat)

    def recommend(self, population: DataFrame, score, k: int = TOP_K, n: int = 300) -> DataFrame:
        from .ranking import top_k

        return top_k(score(features.downcast(self.features(population, n))), k)


def patch_missing(frame: DataFrame, wanted: list[str]) -> tuple[DataFrame, list[str]]:
    """Adds wanted features that the frame lacks, with the value of an absent rank or score, and says
    which they were."""
    absent = [c for c in wanted if c not in frame.columns]
    return frame.select("*", *[F.lit(ABSENT_RANK if c.startswith("rank_") else ABSENT_SCORE).alias(c) for c in absent]), absent


def b2_serve(repurchase: DataFrame, popularity: DataFrame, population: DataFrame, k: int = TOP_K) -> DataFrame:
    """customer_key, article_id, pos: repurchases first, then bestsellers that aren't among them."""
    own = repurchase.filter(F.col("rank") <= k).select("customer_key", "article_id", F.col("rank").cast("long").alias("r"))
    everyone = popularity.agg(F.collect_list(F.struct("article_id", "rank")).alias("list")).withColumn("one", F.lit(1))
    fill = population.select("customer_key", F.lit(1).alias("one")).join(F.broadcast(everyone), "one").select("customer_key", F.inline("list")).join(own, ["customer_key", "article_id"], "left_anti")
    both = own.unionByName(fill.select("customer_key", "article_id", (F.col("rank") + 1000).cast("long").alias("r")))
    return both.withColumn("pos", ranked("customer_key", F.asc("r"), F.asc("article_id")).cast("long")).filter(F.col("pos") <= k).select("customer_key", "article_id", "pos")


def target_articles(tables: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """article_id, n_sold of everything a console can show, most sold first."""
    shown = reduce(DataFrame.union, [tables[n].select("article_id") for n in ("demo_truth", "demo_history", "popularity_global", "popularity_age", "category_candidates", "variants", "repurchase")]).distinct()
    rows = shown.join(tables["features_article"].select("article_id", "n_sold"), "article_id", "left").select("article_id", F.coalesce("n_sold", F.lit(0)).alias("n_sold"))
    ordered = rows.orderBy(F.desc("n_sold"), "article_id")
    return ordered.limit(limit) if limit else ordered


def demo_customers(segments: DataFrame, n: int, segment: str | None = None, seed: int = 0) -> DataFrame:
    """A random sample, of one segment if named."""
    rows = segments if segment is None else segments.filter(F.col("recency_segment") == segment)
    return rows.orderBy(F.rand(seed)).limit(n)


def demo_segment_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("recency_segment").agg(F.count("*").alias("customers"))


def explain_recommendations(top: DataFrame, candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Per recommended article: position, sources that proposed it, whether it was bought."""
    from .fusion import attribution

    rows = top.join(attribution(candidates, list(retrieval.GENERATORS)), ["customer_key", "article_id"], "left")
    hits = truth.select("customer_key", "article_id").distinct().withColumn("hit", F.lit(True))
    return rows.join(hits, ["customer_key", "article_id"], "left").select("customer_key", "article_id", "pos", "sources", F.coalesce("hit", F.lit(False)).alias("hit"))


def recent_history(history: DataFrame, n: int = 15) -> DataFrame:
    """customer_key, article_id, t_dat, price, rn: the last ``n`` purchases of each customer."""
    order = (F.desc("t_dat"), F.asc("article_id"), F.asc("price"))
    return history.withColumn("rn", ranked("customer_key", *order).cast("long")).filter(F.col("rn") <= n)


def explain_customers(top: DataFrame, truth: DataFrame, history: DataFrame, b2: DataFrame, k: int = TOP_K) -> DataFrame:
    """One row for each customer of ``top``: ap (over the whole truth), n_truth, hits, and as lists in
    order: the articles recommended, the last purchases and B2's list."""
    from .evaluation import average_precision

    def listed(rows: DataFrame, order: str, name: str) -> DataFrame:
        pairs = F.sort_array(F.collect_list(F.struct(order, "article_id")))
        return rows.groupBy("customer_key").agg(F.transform(pairs, lambda x: x["article_id"]).alias(name))

    bought = truth.select("customer_key", "article_id").distinct()
    people = top.select("customer_key").distinct()
    per = average_precision(bought, top, k, people)
    hits = top.filter(F.col("pos") <= k).select("customer_key", "article_id").distinct().join(bought, ["customer_key", "article_id"], "left_semi").groupBy("customer_key").agg(F.count("*").alias("hits"))
    size = bought.groupBy("customer_key").agg(F.count("*").alias("n_truth"))
    rows = people.join(per, "customer_key", "left").join(size, "customer_key", "left").join(hits, "customer_key", "left").fillna(0, ["ap", "n_truth", "hits"])
    for more, order, name in ((top, "pos", "recommended"), (recent_history(history), "rn", "recent"), (b2, "pos", "b2")):
        rows = rows.join(listed(more, order, name), "customer_key", "left").withColumn(name, F.coalesce(name, F.array().cast("array<int>")))
    return rows


def list_parity(a: DataFrame, b: DataFrame, k: int = TOP_K) -> DataFrame:
    """One row: mean overlap of two sets of top-k lists, and the share of customers with equal lists."""
    lists = lambda f, name: f.groupBy("customer_key").agg(F.sort_array(F.collect_list(F.struct("pos", "article_id"))).alias(name))
    ids = lambda c: F.transform(c, lambda x: x["article_id"])
    both = lists(a, "a").join(lists(b, "b"), "customer_key")
    return both.agg(F.avg(F.size(F.array_intersect(ids(F.col("a")), ids(F.col("b")))) / F.lit(k)).alias("overlap"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("identical"))


def path_parity(offline: DataFrame, online: DataFrame, truth: DataFrame, k: int = TOP_K) -> DataFrame:
    """One row: customers, map_offline, map_online, overlap, identical, of the lists that the offline path
    and a reopened snapshot give the same customers."""
    from .evaluation import mean_average_precision

    maps = [mean_average_precision(truth, lists, k).select(F.col("map").alias(name)) for lists, name in ((offline, "map_offline"), (online, "map_online"))]
    people = offline.agg(F.countDistinct("customer_key").alias("customers"))
    one = reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), [people, *maps, list_parity(offline, online, k)])  # one row each
    return one.select("customers", "map_offline", "map_online", "overlap", "identical")


def serving_bench(snap: Snapshot, population: DataFrame, score, budgets: list[int], runs: int = 3, k: int = TOP_K) -> list[dict]:
    """For each candidate budget the seconds that a batch recommendation takes: n, p50, p95, p99, max."""
    out = []
    for budget in budgets:
        seconds = []
        for _ in range(runs):
            began = time.perf_counter()
            snap.recommend(population, score, k, budget).write.format("noop").mode("overwrite").save()
            seconds.append((time.perf_counter() - began,))
        facts = latency_percentiles(population.sparkSession.createDataFrame(seconds, "seconds double"), "seconds").first().asDict()
        out.append({"budget": budget, **facts})
    return out


def compression_curve(snap: Snapshot, population: DataFrame, truth: DataFrame, ranker, sizes: list[int], runs: int = 1, n: int = 300) -> list[dict]:
    """For each prefix of the model's trees its MAP and the seconds that it takes."""
    from .evaluation import mean_average_precision

    out = []
    for trees in sizes:
        score = ranker.truncated(trees)
        quality = mean_average_precision(truth, snap.recommend(population, score, n=n)).first()["map"]
        out.append({"trees": trees, "map": quality, "p50": serving_bench(snap, population, score, [n], runs)[0]["p50"]})
    return out


def latency_percentiles(samples: DataFrame, column: str, *by: str) -> DataFrame:
    p = linear_percentiles(column, [0.5, 0.95, 0.99])
    return samples.groupBy(*by).agg(F.count(column).alias("n"), *[F.round(p[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))], F.max(column).alias("max"))
