"""Named queries over the star-schema tables: one for each operator, at a fixed as_of."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import Catalog
from ..functions.scalars import customer_key, image_path
from ..operators import baselines, evaluation as ev, features as ft, fusion, ranking, retrieval as rt, snapshot as sn
from ..operators.scans import window_scan
from ..sources.ingest import log_facts
from ..sources.staging import shared_root, staged, staged_star_schema, staged_window

AS_OF = date(2001, 7, 1)
SOURCES = list(rt.GENERATORS)
_HISTORY = 3000


class _Context:
    """What several queries share, each part built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.cat = staged_star_schema(spark, sf_dir)

    @property
    def win(self) -> Catalog:
        """The log of the last 90 days before the cutoff."""
        return staged_window(self.spark, self.sf_dir, self.cat, AS_OF)

    @property
    def pop(self) -> DataFrame:
        return staged(self.spark, self.sf_dir, f"population-{AS_OF}", lambda: ev.eval_customers(self.cat, AS_OF))

    @property
    def truth(self) -> DataFrame:
        return staged(self.spark, self.sf_dir, f"truth-{AS_OF}", lambda: ev.ground_truth(self.cat, AS_OF))

    @property
    def long(self) -> DataFrame:
        return rt.retrieve(self.win, self.pop, AS_OF)

    @property
    def cand(self) -> DataFrame:
        return fusion.build_candidates(self.long, SOURCES)

    @property
    def b2(self) -> DataFrame:
        return baselines.b2(self.win, self.pop, AS_OF)

    def one(self, source: str) -> DataFrame:
        return rt.GENERATORS[source](self.win, self.pop, AS_OF)

    @property
    def labelled(self) -> DataFrame:
        return ranking.label_candidates(self.cand, self.truth)

    @property
    def ap_b2(self) -> DataFrame:
        return ev.average_precision(self.truth, self.b2)


def _as_pos(frame: DataFrame, rank: str) -> DataFrame:
    return frame.select("customer_key", "article_id", F.col(rank).alias("pos"))


def _knn(x: _Context, f, **settings) -> DataFrame:
    return f(x.cat, x.pop, AS_OF, lookback=_HISTORY, seed_lookback=_HISTORY, min_co=2, **settings)


def _recall_curve(x: _Context) -> DataFrame:
    fused = _as_pos(fusion.fuse(x.long), "cand_rank")
    return ev.recall_table(x.truth, [("budget", F.lit(k).cast("long"), ev.mean_recall(x.truth, fused, k)) for k in (12, 50, 100, 200, 300, 500)])


def _recall_by_source(x: _Context) -> DataFrame:
    return ev.recall_table(x.truth, [("source", s, ev.mean_recall(x.truth, _as_pos(x.one(s), "rank"), 300)) for s in SOURCES])


def _leave_one_out(x: _Context) -> DataFrame:
    rest = lambda s: _as_pos(fusion.fuse(x.long.filter(F.col("source") != s)), "cand_rank")
    return ev.recall_table(x.truth, [("without", s, ev.mean_recall(x.truth, rest(s), 300)) for s in SOURCES])


def _by_counts(rows: DataFrame) -> DataFrame:
    """A model that SQL can state: what a customer bought, then what everybody buys."""
    return rows.withColumn("score", F.col("score_r2b_global") + 10 * F.col("score_r1_repurchase"))


def _budget_sweep(x: _Context) -> DataFrame:
    return ev.budget_sweep(x.truth, _by_counts(x.cand), [50, 100, 200, 300])


def _weeks() -> list[date]:
    return [AS_OF - timedelta(days=7 * i) for i in range(3)]


def _rolling(x: _Context) -> DataFrame:
    def week(as_of: date) -> DataFrame:
        pop = ev.eval_customers(x.cat, as_of)
        return ev.mean_average_precision(ev.ground_truth(x.cat, as_of), baselines.b2(x.cat, pop, as_of)).select(F.lit(as_of).alias("as_of"), "map")

    return reduce(DataFrame.unionByName, map(week, _weeks()))


def _rolling_model(x: _Context) -> DataFrame:
    def week(as_of: date) -> DataFrame:
        pop = ev.eval_customers(x.cat, as_of)
        model = ranking.top_k(_by_counts(fusion.build_candidates(rt.retrieve(x.cat, pop, as_of), SOURCES)))
        return ev.labelled("as_of", as_of, ev.evaluate_week(ev.ground_truth(x.cat, as_of), model, baselines.b2(x.cat, pop, as_of)))

    return reduce(DataFrame.unionByName, map(week, _weeks()))


def _segment_table(x: _Context) -> DataFrame:
    model = ev.average_precision(x.truth, _as_pos(x.cand, "cand_rank"))
    return ev.segment_table(ev.customer_segments(x.cat, x.pop, AS_OF), "recency_segment", model, x.ap_b2)


def _assembled(x: _Context) -> DataFrame:
    return ft.assemble(x.cand.drop("cand_rank"), ft.offline_sources(x.win, AS_OF, population=x.pop), x.cat)


def _attribution(x: _Context) -> DataFrame:
    cand = x.cand
    rows = sn.explain_recommendations(_as_pos(cand, "cand_rank").filter("pos <= 12"), cand, x.truth)
    return rows.withColumn("sources", F.array_join("sources", ","))


def _partitioned_scan(x: _Context) -> DataFrame:
    rows = window_scan(x.cat.tx, AS_OF)
    return rows.groupBy(F.col("t_month").cast("int").alias("t_month")).agg(F.count("*").alias("n"), F.sum(F.col("price").cast("decimal(18,2)")).cast("double").alias("revenue"))


def _b2_serve(x: _Context) -> DataFrame:
    return sn.b2_serve(x.one("r1_repurchase"), rt.global_popularity_table(x.win, AS_OF), x.pop)


def _target_articles(x: _Context) -> DataFrame:
    return sn.target_articles(sn.snapshot_tables(x.win, AS_OF) | sn.demo_tables(x.cat, AS_OF))


def _snapshot(x: _Context) -> sn.Snapshot:
    """Written, and opened again."""
    root = f"{shared_root(x.spark)}/snapshot-{uuid.uuid4().hex}"
    sn.write_snapshot(x.win, AS_OF, root)
    return sn.Snapshot.open(x.spark, root)


def _parity(x: _Context) -> DataFrame:
    offline, online = (ranking.top_k(_by_counts(rows)) for rows in (x.cand, _snapshot(x).retrieve(x.pop)))
    return sn.path_parity(offline, online, x.truth)


def _recent(x: _Context) -> DataFrame:
    return sn.recent_history(sn.demo_tables(x.cat, AS_OF)["demo_history"])


def _explain(x: _Context) -> DataFrame:
    top = _as_pos(x.cand, "cand_rank").filter("pos <= 12")
    rows = sn.explain_customers(top, x.truth, sn.demo_tables(x.cat, AS_OF)["demo_history"], x.b2)
    return rows.select("customer_key", "ap", "n_truth", "hits", *[F.array_join(c, ",").alias(c) for c in ("recommended", "recent", "b2")])


def _vectors(x: _Context) -> DataFrame:
    vectors = x.spark.read.parquet(f"{x.sf_dir}/embeddings.parquet")
    return baselines.vector_top_k(vectors.filter("vec_id % 100 = 0"), vectors, 10, "vec_id", "embedding")


def _als(x: _Context) -> DataFrame:
    ratings, users, items = baselines.interactions(x.cat, None, AS_OF)
    return baselines.recommend_als(baselines.fit_als(ratings, rank=16, iterations=5), users, items, x.pop, 50)


def _trained(x: _Context) -> ranking.PointwiseGbt:
    week = AS_OF - timedelta(days=7)
    return ranking.PointwiseGbt().fit(ranking.build_training_set(x.cat, week))


def _ranker(x: _Context) -> DataFrame:
    return ranking.predict_week(x.cat, AS_OF, _trained(x).score)


def _listwise(x: _Context) -> DataFrame:
    """The listwise ranker with its own settings, trained on the week before."""
    model = ranking.LambdaMart().fit(ranking.build_training_set(x.cat, AS_OF - timedelta(days=7)))
    return ranking.predict_week(x.cat, AS_OF, model.score)


def _tree_sweep(x: _Context) -> DataFrame:
    """Every prefix of the ranker with its own settings."""
    ranker = _trained(x)
    return ranking.tree_sweep(x.cat, ranker, AS_OF - timedelta(days=7), AS_OF, list(range(1, ranker.settings["maxIter"] + 1)))


_QUERIES: dict[str, Callable[[_Context], DataFrame]] = {
    "customer_recency": lambda x: ft.customer_recency(x.win, AS_OF, population=x.pop),
    "article_popularity": lambda x: ft.article_popularity(x.win, AS_OF),
    "customer_article_affinity": lambda x: ft.customer_article_affinity(x.win, AS_OF, population=x.pop),
    "customer_productcode_affinity": lambda x: ft.customer_productcode_affinity(x.win, AS_OF, population=x.pop),
    "customer_group": lambda x: ft.customer_group(x.win, AS_OF, population=x.pop),
    "r1_repurchase": lambda x: x.one("r1_repurchase"),
    "r2_age_popularity": lambda x: rt.age_popularity_table(x.win, AS_OF).withColumn("rank", F.col("rank").cast("long")),
    "r2_popularity": lambda x: x.one("r2_popularity"),
    "r2b_global": lambda x: x.one("r2b_global"),
    "r3_item_knn": lambda x: _knn(x, rt.item_knn),
    "r3_last_knn": lambda x: _knn(x, rt.last_item_knn),
    "r5_category": lambda x: x.one("r5_category"),
    "r6_product_variant": lambda x: x.one("r6_product_variant"),
    "rrf_fuse": lambda x: fusion.fuse(x.long),
    "rrf_fuse_weighted": lambda x: fusion.fuse(x.long, {"r1_repurchase": 2.5, "r2b_global": 0.5}),
    "build_candidates": lambda x: x.cand,
    "candidate_lists": lambda x: fusion.candidate_lists(fusion.fuse(x.long), 50).select("customer_key", F.posexplode("articles").alias("i", "article_id")).select("customer_key", (F.col("i") + 1).cast("long").alias("cand_rank"), "article_id"),
    "recall_by_source": _recall_by_source,
    "recall_curve": _recall_curve,
    "recall_leave_one_out": _leave_one_out,
    "b0_bestsellers": lambda x: baselines.top_articles(x.win, AS_OF),
    "b0_age_buckets": lambda x: baselines.top_articles_by_age_bucket(x.win, AS_OF),
    "b1_repurchase": lambda x: baselines.repurchase_lists(x.win, x.pop, AS_OF),
    "b2_pad": lambda x: x.b2,
    "b2_serve": _b2_serve,
    "b2_evaluate": lambda x: ev.evaluate(x.truth, x.b2),
    "ground_truth": lambda x: x.truth,
    "label_candidates": lambda x: x.labelled.select("customer_key", "article_id", "label"),
    "downsample_negatives": lambda x: ranking.downsample_negatives(x.labelled).select("customer_key", "article_id", "label"),
    "group_sizes": lambda x: ranking.group_sizes(x.cand),
    "ap_at_12": lambda x: x.ap_b2,
    "map_at_12": lambda x: ev.mean_average_precision(x.truth, x.b2),
    "recall_at_12": lambda x: ev.recall(x.truth, x.b2),
    "ndcg_at_12": lambda x: ev.ndcg(x.truth, x.b2),
    "customer_segments": lambda x: ev.customer_segments(x.cat, x.pop, AS_OF),
    "segment_table": _segment_table,
    "popularity_deciles": lambda x: ev.popularity_deciles(x.win, AS_OF, x.truth, x.b2),
    "diversity": lambda x: ev.diversity(x.cat, x.b2),
    "assemble_features": _assembled,
    "rolling_b2": _rolling,
    "rolling_model": _rolling_model,
    "budget_sweep": _budget_sweep,
    "demo_truth": lambda x: sn.demo_tables(x.cat, AS_OF)["demo_truth"],
    "demo_history": lambda x: sn.demo_tables(x.cat, AS_OF)["demo_history"],
    "demo_articles": lambda x: sn.demo_tables(x.cat, AS_OF)["demo_articles"],
    "demo_segments": lambda x: sn.demo_tables(x.cat, AS_OF)["demo_segments"],
    "target_articles": _target_articles,
    "source_attribution": _attribution,
    "snapshot_parity": _parity,
    "recent_history": _recent,
    "explain_customers": _explain,
    "segment_counts": lambda x: sn.demo_segment_counts(sn.demo_tables(x.cat, AS_OF)["demo_segments"]),
    "truth_lists": lambda x: ev.truth_lists(x.truth).select("customer_key", F.array_join("articles", ",").alias("articles")),
    "image_paths": lambda x: x.cat.articles.select("article_id", image_path(F.col("article_id")).alias("path")),
    "recall_report": lambda x: ev.source_report(x.truth, x.pop, x.long, SOURCES),
    "verify_ingest": lambda x: log_facts(x.cat.tx),
    "customer_key": lambda x: x.cat.customers.select(F.col("customer_key").alias("expected"), customer_key(F.col("customer_id")).alias("customer_key")),
    "partitioned_scan": _partitioned_scan,
    "vector_topk_ip": _vectors,
    "latency_percentiles": lambda x: sn.latency_percentiles(x.spark.read.parquet(f"{x.sf_dir}/events.parquet"), "value", "event_type"),
    "als_topk": _als,
    "ranker_topk": _ranker,
    "listwise_topk": _listwise,
    "tree_sweep": _tree_sweep,
}


def _query(build: Callable[[_Context], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(_Context(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(build) for name, build in _QUERIES.items()}
