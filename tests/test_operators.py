"""Retrieval, fusion, padding, sampling and parity on small tables, leakage on the driver's."""

import math
import os
from datetime import date
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidewater.catalog import Catalog
from tidewater.operators import baselines, evaluation as ev, features, fusion, ranking, retrieval, snapshot
from tidewater.plans import queries, sql

DATA = "/root/testdata/sf0.01"
AS_OF = date(2001, 7, 1)
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def log(spark, rows):
    tx = spark.createDataFrame([(date(2020, 1, d), c, a, 1.0, 1) for d, c, a in rows], "t_dat date, customer_key long, article_id int, price double, sales_channel_id int")
    articles = spark.createDataFrame([(a, a // 10, f"g{a // 100}") for a in {r[2] for r in rows}], "article_id int, product_code long, product_group_name string")
    customers = spark.createDataFrame([(c, None if c == 1 else 20.0 + c) for c in {r[1] for r in rows}], "customer_key long, age double")
    return Catalog(tx, articles, customers), customers.select("customer_key")


def found(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_strategies(spark):
    cat, pop = log(spark, [(1, 1, 101), (1, 1, 102), (2, 1, 101), (2, 1, 102), (3, 2, 101), (3, 2, 102), (9, 3, 205), (10, 3, 206)])
    day = date(2020, 1, 11)
    assert found(retrieval.repurchase(cat, pop, day, 2).filter("customer_key = 1"), "rank", "article_id", "score") == [(1, 101, 2.0), (2, 102, 2.0)]
    assert found(retrieval.global_popularity(cat, pop, day, 3, 30).filter("customer_key = 3"), "rank", "article_id") == [(1, 101), (2, 102), (3, 205)]
    # customer 1 has no age, so the bucket of 30, alone
    assert found(retrieval.age_popularity(cat, pop, day, 9, 30).filter("customer_key = 1"), "rank", "article_id", "score") == [(1, 101, 2.0), (2, 102, 2.0)]
    # three baskets hold 101 and 102, which sold three times each
    assert found(retrieval.item_neighbours(cat, day, min_co=3), "article_id", "neighbour", "sim") == [(101, 102, 1.0), (102, 101, 1.0)]
    assert found(retrieval.item_knn(cat, pop, day, min_co=3).filter("customer_key = 2"), "article_id", "score") == [(101, 0.5), (102, 1.0)]
    assert found(retrieval.category(cat, pop, day, days=5).filter("customer_key = 3"), "article_id", "score") == [(205, 2.0), (206, 2.0)]
    assert found(retrieval.product_variant(cat, pop, day, days=5).filter("customer_key = 3"), "article_id", "score") == [(205, 1.0), (206, 1.0)]


def test_basket_repeats_multiply(spark):
    cat, _ = log(spark, [(1, 1, 101), (1, 1, 101), (1, 1, 102)])
    assert found(retrieval.item_neighbours(cat, date(2020, 1, 5), min_co=2), "article_id", "sim") == [(101, pytest.approx(2 / 2**0.5)), (102, pytest.approx(2 / 2**0.5))]


def test_fusion_ties_weights_and_annotators(spark):
    rows = [(1, 7, "a", 1, 1.0), (1, 5, "b", 1, 1.0), (1, 5, "c", 3, 9.0), (1, 6, "c", 1, 1.0)]
    long = spark.createDataFrame(rows, retrieval.LONG)
    assert [r.article_id for r in fusion.fuse(long.filter("source != 'c'")).orderBy("cand_rank").collect()] == [5, 7]
    assert [r.article_id for r in fusion.fuse(long, {"a": 3.0}).orderBy("cand_rank").collect()] == [7, 5, 6]
    wide = fusion.build_candidates(long.filter("source != 'c'"), ["a", "b", "c"], annotated=long.filter("source = 'c'")).orderBy("article_id").collect()
    assert [(r.article_id, r.n_sources, r.rank_c, r.score_c, r.rank_a) for r in wide] == [(5, 2, 3, 9.0, 9999), (7, 1, 9999, 0.0, 1)]


def test_pad(spark):
    pop = spark.createDataFrame([(1,), (2,)], "customer_key long")
    preds = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (9, 5, 1)], "customer_key long, article_id int, pos long")
    filler = spark.createDataFrame([(11, 1), (20, 2), (21, 3)], "article_id int, rank long")
    assert found(baselines.pad(preds, pop, filler, 4), "customer_key", "pos", "article_id") == [(1, 1, 10), (1, 2, 11), (1, 3, 20), (1, 4, 21), (2, 1, 11), (2, 2, 20), (2, 3, 21)]
    assert found(baselines.pad(preds, pop, filler, 1), "customer_key", "article_id") == [(1, 10), (2, 11)]


def test_negative_sampling(spark):
    rows = [(c, a, int(a == 1 and c != 3)) for c in (1, 2, 3) for a in range(1, 60)]
    out = ranking.downsample_negatives(spark.createDataFrame(rows, "customer_key long, article_id int, label int"), 5).collect()
    assert {r.customer_key for r in out} == {1, 2} and sum(r.label for r in out) == 2 and len(out) == 12


def test_registered_ranker_has_the_defaults(monkeypatch):
    seen = {}
    monkeypatch.setattr(ranking, "build_training_set", lambda cat, as_of, **settings: seen.update(settings))
    monkeypatch.setattr(ranking, "predict_week", lambda cat, as_of, score, **settings: seen.update(settings))
    monkeypatch.setattr(ranking.PointwiseGbt, "fit", lambda self, rows: seen.update(self.settings) or self)
    queries._ranker(SimpleNamespace(cat=None))
    assert seen == ranking.PointwiseGbt().settings


def test_registered_sweep_has_every_prefix_of_the_defaults(monkeypatch):
    seen = {}
    monkeypatch.setattr(ranking, "build_training_set", lambda cat, as_of, **settings: None)
    monkeypatch.setattr(ranking.PointwiseGbt, "fit", lambda self, rows: self)
    monkeypatch.setattr(ranking, "tree_sweep", lambda cat, ranker, trained_on, select_on, sizes: seen.update(settings=ranker.settings, sizes=list(sizes)))
    queries._tree_sweep(SimpleNamespace(cat=None))
    own = ranking.PointwiseGbt().settings
    assert seen == {"settings": own, "sizes": list(range(1, own["maxIter"] + 1))}


@pytest.mark.parametrize("kind", [ranking.PointwiseGbt, ranking.LambdaMart])
def test_sweep_equals_each_prefix_alone(spark, monkeypatch, kind):
    """With ties, a buyer without candidates, a purchase that is no candidate, and more trees than there are."""
    rows = [(c, a, int((a * c) % 5 == 0), float((a * 7 + c * 3) % 4), None if a % 3 else float(a * c % 5 == 0)) for c in range(1, 5) for a in range(1, 20)]
    frame = spark.createDataFrame(rows, "customer_key long, article_id int, label int, x double, y double")
    model = kind(trees=4, depth=2, step=0.3).fit(frame)
    cat, _ = log(spark, [(8, 1, 5), (8, 1, 10), (9, 2, 18), (9, 2, 3), (8, 3, 2), (8, 3, 99), (9, 8, 1)])
    monkeypatch.setattr(ranking, "_feature_rows", lambda cat, as_of: frame.drop("label"))
    truth, sizes = ev.ground_truth(cat, date(2020, 1, 8)), [1, 2, 3, 4, 6]
    alone = {n: ev.mean_average_precision(truth, ranking.top_k(model.truncated(n)(frame.drop("label")))).first()["map"] for n in sizes}
    swept = ranking.tree_sweep(cat, model, date(2020, 1, 1), date(2020, 1, 8), sizes)
    assert {r.trees: r.map for r in swept.collect()} == alone and max(alone.values()) > 0
    assert max(r.relative for r in swept.collect()) == 1.0
    nothing = ranking.tree_sweep(cat, model, date(2020, 1, 1), date(2020, 2, 8), [1, 2]).collect()
    assert sorted((r.trees, r.map, r.relative) for r in nothing) == [(1, 0.0, None), (2, 0.0, None)]


def test_listwise_gradients(spark):
    """Against pairs written out: three candidates, one bought, and a customer who bought nothing."""
    rows = [(1, 10, 0, 2.0), (1, 11, 1, 1.0), (1, 12, 0, 0.5), (2, 10, 0, 0.0)]
    got = {(r.customer_key, r.article_id): (r["lambda"], r.weight) for r in ranking.listwise_gradients(spark.createDataFrame(rows, "customer_key long, article_id int, label int, score double"), 2).collect()}
    gain = [1.0, 1 / math.log2(3), 0.0]
    up, low = 1 / (1 + math.exp(1.0 - 2.0)), 1 / (1 + math.exp(1.0 - 0.5))
    a, b = up * (gain[0] - gain[1]), low * (gain[1] - gain[2])
    wa, wb = up * (1 - up) * (gain[0] - gain[1]), low * (1 - low) * (gain[1] - gain[2])
    expected = {(1, 10): (-a, wa), (1, 11): (a + b, wa + wb), (1, 12): (-b, wb), (2, 10): (0.0, 0.0)}
    assert {k: pytest.approx(v) for k, v in expected.items()} == got


def test_listwise_ranker(spark, tmp_path):
    """Learns an order that holds within lists only, and is the same after a round trip."""
    rows = [(c, a, int(a == (c * 3) % 7), float(c * 100 + (5 if a == (c * 3) % 7 else a % 5)), None if a % 2 else 1.0, float(a == (c * 3) % 7) + a % 3) for c in range(20) for a in range(7)]
    frame = spark.createDataFrame(rows, "customer_key long, article_id int, label int, x double, y double, z double")
    model = ranking.LambdaMart(trees=4, depth=3, step=0.5).fit(frame)
    truth = frame.filter("label = 1").select("customer_key", "article_id")
    quality = lambda m, n: ev.mean_average_precision(truth, ranking.top_k(m.truncated(n)(frame))).first()["map"]
    assert quality(model, 4) > max(quality(model, 0), 0.6) and model.importance()[0][1] > 0
    model.save(str(tmp_path), ["x", "y", "z"])
    again, columns = ranking.LambdaMart.load(str(tmp_path))
    assert columns == ["x", "y", "z"] and sorted(r.score for r in again.score(frame).collect()) == sorted(r.score for r in model.score(frame).collect())


def test_serving_bench_and_compression(spark):
    cat, pop = log(spark, [(d, c, 100 + (c + d) % 5) for c in (1, 2, 3) for d in range(1, 10)])
    extra = {n: F.lit(1) for n in ("product_type_no", "section_no", "department_no", "perceived_colour_value_id", "graphical_appearance_no")}
    articles = cat.articles.withColumns(extra | {n: F.lit("x") for n in features.CATEGORICAL[1:3]})
    customers = cat.customers.withColumns({n: F.lit(1.0) for n in ("fn", "active")} | {n: F.lit("x") for n in features.CATEGORICAL[3:]})
    snap = snapshot.Snapshot.lazy(Catalog(cat.tx, articles, customers), date(2020, 1, 8))
    facts = snapshot.serving_bench(snap, pop, lambda rows: rows.withColumn("score", F.col("rrf_score")), [2, 5], 1)
    assert [f["budget"] for f in facts] == [2, 5] and all(0 < f["p50"] <= f["max"] + 1e-6 for f in facts)
    truth = spark.createDataFrame([(1, 101), (2, 104)], "customer_key long, article_id int")
    ranker = SimpleNamespace(truncated=lambda n: lambda rows: rows.withColumn("score", F.col("rrf_score") * n))
    curve = snapshot.compression_curve(snap, pop, truth, ranker, [1, 0])
    assert [c["trees"] for c in curve] == [1, 0] and all(0 <= c["map"] <= 1 and c["p50"] > 0 for c in curve)


def test_parity_of_lists_and_percentiles(spark):
    a = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "customer_key long, article_id int, pos long")
    b = spark.createDataFrame([(1, 6, 1), (1, 7, 2)], "customer_key long, article_id int, pos long")
    r = snapshot.list_parity(a, b, 2).first()
    assert (r.overlap, r.identical) == (0.5, 0.0)
    p = snapshot.latency_percentiles(spark.range(1, 102).withColumn("v", F.col("id").cast("double")), "v").first()
    assert (p.p50, p.p95, p.max) == (51.0, 96.0, 101.0)


@needs_data
def test_no_leakage(spark):
    cat = Catalog.from_star_schema(spark, DATA)
    assert cat.tx.filter(F.col("t_dat") >= F.lit(AS_OF)).count() > 0
    pop = ev.eval_customers(cat, AS_OF)

    def rows(c):
        long = retrieval.retrieve(c, pop, AS_OF)
        cand = fusion.build_candidates(long, list(retrieval.GENERATORS), 50).drop("cand_rank")
        frame = features.assemble(cand, features.offline_sources(c, AS_OF, population=pop), c)
        return sorted(map(repr, frame.select(*sorted(frame.columns)).collect()))

    assert rows(cat) == rows(cat.truncated(AS_OF))


@needs_data
@pytest.mark.parametrize("name", ["article_popularity", "r3_item_knn", "build_candidates", "ndcg_at_12", "downsample_negatives"])
def test_same_rows_on_any_partitioning(spark, name):
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(tuple(sorted(map(repr, queries.queries()[name](spark, DATA).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


@needs_data
@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem", "events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    expected = con.sql(sql.oracle_sql()[name])
    got = queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)
    as_rows = lambda names, rows: sorted(repr(tuple(dict(zip(names, r, strict=True))[c] for c in columns)) for r in rows)
    assert as_rows(got.columns, map(tuple, got.collect())) == as_rows(expected.columns, expected.fetchall())
