"""Hand-computed ranking metrics."""

import math

import pytest
from pyspark.sql import functions as F

from tidewater.operators import evaluation as ev


def frames(spark, truths, preds):
    truth = spark.createDataFrame([(c, a) for c, t in enumerate(truths) for a in t], "customer_key long, article_id int")
    made = spark.createDataFrame([(c, a, i + 1) for c, p in enumerate(preds) for i, a in enumerate(p)], "customer_key long, article_id int, pos long")
    return truth, made, spark.createDataFrame([(c,) for c in range(len(truths))], "customer_key long")


@pytest.mark.parametrize(
    ("truth", "pred", "expected"),
    [
        ([1], [2, 1, 3], 0.5),
        ([1, 2], [1, 3, 2], (1 + 2 / 3) / 2),
        ([1, 2], [1, 1, 2], (1 + 2 / 3) / 2),
        ([1], [1, 9], 1.0),
        (list(range(15)), list(range(12)), 1.0),
        ([1], [*range(100, 112), 1], 0.0),
        ([], [1], 0.0),
        ([1], [], 0.0),
        ([40, 80, 60], [7, 80, 9, 60, 5, 40], (1 / 2 + 2 / 4 + 3 / 6) / 3),
        ([40, 80], [*range(11), 80, 40], 1 / 12 / 2),
        ([5, 5, 6], [6, 5, 5, 6], 1.0),
    ],
)
def test_average_precision(spark, truth, pred, expected):
    t, p, pop = frames(spark, [truth], [pred])
    assert ev.average_precision(t, p, population=pop).first().ap == pytest.approx(expected, abs=1e-9)


def test_map_counts_empty_truth(spark):
    t, p, pop = frames(spark, [[1], [1], [1]], [[1, 2], [2, 1], [3, 4]])
    assert ev.mean_average_precision(t, p, population=pop).first()["map"] == pytest.approx(0.5)
    t, p, pop = frames(spark, [[1], []], [[1], [1]])
    assert ev.mean_average_precision(t, p, population=pop).first()["map"] == pytest.approx(0.5)
    t, p, pop = frames(spark, [], [])
    assert ev.mean_average_precision(t, p, population=pop).first()["map"] == 0.0
    with pytest.raises(ValueError):
        ev.check_lengths([[1]], [])


def test_recall(spark):
    t, p, _ = frames(spark, [[1, 2, 3, 4], []], [[1, 2, 9], [1]])
    assert ev.mean_recall(t, p).first().recall == pytest.approx(0.5)
    t, p, _ = frames(spark, [[1]], [[2, 1]])
    assert ev.mean_recall(t, p, 1).first().recall == 0.0


def test_ndcg(spark):
    for truth, pred, expected in (([1], [2, 1], 1 / math.log2(3)), ([1, 2], [1, 2], 1.0), ([1], [2], 0.0), ([1, 2], [1, 1], 1.0)):
        t, p, _ = frames(spark, [truth], [pred])
        assert ev.ndcg(t, p).first().ndcg == pytest.approx(expected)


def test_ndcg_of_more_purchases_than_places(spark):
    """Of five purchases three places can hold three; the list finds two, at its first and third place."""
    t, p, _ = frames(spark, [[21, 22, 23, 24, 25]], [[23, 99, 21, 22]])
    expected = (1 + 1 / 2) / (1 + 1 / math.log2(3) + 1 / 2)
    assert ev.ndcg(t, p, 3).first().ndcg == pytest.approx(expected, abs=1e-8)


def test_evaluate_counts_unserved_customers(spark):
    t, p, _ = frames(spark, [[31], [32], [33, 34]], [[31], [], [9, 34]])
    r = ev.evaluate(t, p).first()
    assert (r.map, r.recall, r.coverage) == (pytest.approx((1 + 0 + 1 / 4) / 3), pytest.approx((1 + 0 + 1 / 2) / 3), pytest.approx(2 / 3))


def test_budget_sweep_and_week(spark):
    """A wider budget finds more, and lets a high score in that lies behind it."""
    truth = spark.createDataFrame([(1, 50), (2, 60)], "customer_key long, article_id int")
    scored = spark.createDataFrame([(1, 51, 1, 2.0), (1, 50, 2, 3.0), (2, 60, 1, 1.0), (2, 61, 2, 5.0)], "customer_key long, article_id int, cand_rank long, score double")
    assert [tuple(r) for r in ev.budget_sweep(truth, scored, [1, 2]).orderBy("budget").collect()] == [(1, 0.5, 0.5), (2, 1.0, 0.75)]
    lists = lambda rows: spark.createDataFrame(rows, "customer_key long, article_id int, pos long")
    week = ev.evaluate_week(truth, lists([(1, 50, 1), (2, 60, 1)]), lists([(1, 50, 2), (2, 61, 1)])).first()
    assert (week.customers, week.map_model, week.map_b2, week.lift) == (2, 1.0, 0.25, 3.0)
    people = spark.range(50).select(F.col("id").alias("customer_key"))
    assert ev.sampled(people, 7, 3).collect() == ev.sampled(people.repartition(5), 7, 3).collect() and ev.sampled(people, None).count() == 50
