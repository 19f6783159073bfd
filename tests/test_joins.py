"""Joins with tables that grow with the data: none of them is broadcast, however small it is compressed."""

import re
from datetime import date

import pytest

from tidewater.catalog import Catalog
from tidewater.operators import features, ranking, retrieval
from tidewater.sources.staging import written

DAY = date(2020, 1, 11)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def broadcasts(frame):
    return len(re.findall(r"BroadcastHashJoin|BroadcastNestedLoopJoin", plan(frame)))


@pytest.fixture(scope="module")
def cat(spark):
    tx = spark.createDataFrame([(date(2020, 1, d), c, a, float(a), 1) for d, c, a in [(1, 1, 101), (1, 1, 102), (9, 2, 205), (10, 3, 101)]], "t_dat date, customer_key long, article_id int, price double, sales_channel_id int")
    names = "product_group_name string, index_group_name string, garment_group_name string"
    numbers = ["product_type_no", "section_no", "department_no", "perceived_colour_value_id", "graphical_appearance_no"]
    articles = spark.createDataFrame([(a, a // 10, f"g{a // 100}", "i", "m", 1, 2, 3, 4, 5) for a in (101, 102, 205)], f"article_id int, product_code long, {names}, " + ", ".join(f"{n} int" for n in numbers))
    customers = spark.createDataFrame([(c, 20.0 + c, 1.0, 1.0, "A", "N") for c in (1, 2, 3)], "customer_key long, age double, fn double, active double, club_member_status string, fashion_news_frequency string")
    return Catalog(*(written(x, "joins") for x in (tx, articles, customers)))


def test_lookups_of_articles_and_customers_are_not_broadcast(cat):
    for frame in (
        retrieval.age_popularity_table(cat, DAY), retrieval.product_variant(cat, None, DAY),
        features.customer_group(cat, DAY), features.customer_productcode_affinity(cat, DAY),
    ):
        assert broadcasts(frame) == 0
    # the best of each group are a bounded list; articles are looked up twice
    assert broadcasts(retrieval.category(cat, None, DAY)) <= 1


def test_features_are_assembled_without_broadcasts(spark, cat):
    rows = [(1, 101, 0.5), (2, 102, 0.25), (3, 999, 0.1), (4, 205, 0.1)]
    candidates = written(spark.createDataFrame(rows, "customer_key long, article_id int, rrf_score double"), "joins")
    made = features.assemble(candidates, features.offline_sources(cat, DAY), cat)
    assert broadcasts(made) == 0
    got = {(r.customer_key, r.article_id): r for r in made.collect()}
    assert sorted(got) == [(a, b) for a, b, _ in rows]
    assert (got[1, 101].ca_n_purchases, got[1, 101].cpc_n_variants, got[1, 101].cg_n_purchases, got[1, 101].n_buyers, got[1, 101].age) == (1, 2, 2, 2, 21.0)
    assert (got[3, 999].product_group_name, got[3, 999].n_purchases, got[3, 999].ca_n_purchases, got[4, 205].age, got[4, 205].n_sold) == (None, 1, 0, None, 1)


def test_listwise_gradients_are_not_broadcast(spark):
    rows = written(spark.createDataFrame([(1, 7, 1, 0.0), (1, 8, 0, 0.0)], "customer_key long, article_id int, label int, score double"), "joins")
    made = ranking.listwise_gradients(rows)
    assert broadcasts(made) == 0
    assert {(r.article_id, r["lambda"] > 0) for r in made.collect()} == {(7, True), (8, False)}


def test_training_rows_are_read_not_made_anew(spark, cat):
    """A ranker passes over its rows many times; none of the steps that made them is in its plans."""
    rows = ranking.build_training_set(cat, date(2020, 1, 8))
    assert not re.search("Join|Window|Aggregate|Exchange", plan(rows))
    assert {(r.customer_key, r.article_id, r.label) for r in rows.filter("label = 1").collect()} == {(3, 101, 1)}
