"""A small shop from CSV files to snapshot. Its days, prices and counts are made up here and worked out by
hand: two buyers of cups and a lamp in spring, a third who comes in the target week."""

import hashlib
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidewater.catalog import Catalog
from tidewater.operators import baselines, evaluation, features, ranking, snapshot
from tidewater.sources import ingest, reports, staging

OPENED = date(2021, 3, 1)
CUT = OPENED + timedelta(days=40)  # 10 April
PEOPLE = {name: hashlib.sha256(name.encode()).hexdigest() for name in ("ann", "bo", "cy")}
CUP, MUG, LAMP, RUG = 7001, 7002, 7105, 7203
#: (days after opening, buyer, article, price, channel); day 40 and later is the target week or beyond
SALES = [
    *[(3, "ann", CUP, 0.5, 1)] * 2, (3, "ann", LAMP, 4.0, 2), (12, "bo", CUP, 0.25, 2), (34, "ann", MUG, 1.5, 2), (36, "bo", LAMP, 3.0, 1), (39, "bo", CUP, 0.75, 1),
    (40, "cy", RUG, 9.0, 2), (44, "ann", CUP, 0.5, 1), (46, "ann", CUP, 0.5, 1), (47, "bo", RUG, 9.0, 2),
]


def key(name):
    return int(PEOPLE[name][-15:], 16)


@pytest.fixture(scope="module")
def cat(spark, tmp_path_factory):
    raw, out = tmp_path_factory.mktemp("raw"), tmp_path_factory.mktemp("out")
    people = [f"{i},1.0,,ACTIVE,Monthly,{age},P{n}" for n, (i, age) in enumerate(zip(PEOPLE.values(), (31, 58, ""), strict=True))]
    (raw / "customers.csv").write_text("\n".join(["customer_id,FN,Active,club_member_status,fashion_news_frequency,age,postal_code", *people]) + "\n")
    head = "article_id,product_code,prod_name,product_type_no,product_type_name,product_group_name,graphical_appearance_no,perceived_colour_value_id,department_no,index_group_name,section_no,garment_group_name,colour_group_name,detail_desc"
    goods = [f"{a},{a // 100},{n},{a % 9},{n},{g},{a % 5},2,{a % 4},Home,11,{g} things,white,a {n}" for a, n, g in ((CUP, "cup", "Table"), (MUG, "mug", "Table"), (LAMP, "lamp", "Light"), (RUG, "rug", "Floor"))]
    (raw / "articles.csv").write_text("\n".join([head, *goods]) + "\n")
    sales = [f"{OPENED + timedelta(days=d)},{PEOPLE[b]},{a},{p},{c}" for d, b, a, p, c in SALES]
    (raw / "transactions_train.csv").write_text("\n".join(["t_dat,customer_id,article_id,price,sales_channel_id", *sales]) + "\n")
    facts = ingest.ingest(spark, str(raw), str(out))
    assert facts == {"n_rows": 11, "n_customers": 3, "n_articles": 4, "first_day": OPENED + timedelta(days=3), "last_day": OPENED + timedelta(days=47)}
    return Catalog.from_parquet(spark, str(out))


def test_types_and_keys(cat):
    assert dict(cat.tx.drop("t_year", "t_month").dtypes) == {"t_dat": "date", "customer_key": "bigint", "article_id": "int", "price": "float", "sales_channel_id": "tinyint"}
    kinds = dict(cat.articles.dtypes)
    assert {c for c, t in kinds.items() if t == "int"} == {c for c in kinds if c in ingest.ARTICLE_NUMBERS} and kinds["prod_name"] == "string"
    got = {r.customer_key: r for r in cat.customers.collect()}
    assert set(got) == {key(n) for n in PEOPLE} and max(got) < 2**60
    assert got[key("cy")].age is None and got[key("ann")].fn == 1.0 and got[key("bo")].active is None


def test_truth_is_the_target_week(cat):
    assert {(r.customer_key, r.article_id) for r in evaluation.ground_truth(cat, CUT).collect()} == {(key("cy"), RUG), (key("ann"), CUP)}
    assert {r.customer_key: r.articles for r in evaluation.truth_lists(evaluation.ground_truth(cat, CUT)).collect()} == {key("cy"): [RUG], key("ann"): [CUP]}


def test_features_end_before_the_cut(cat):
    ann, bo = (features.customer_recency(cat, CUT).filter(F.col("customer_key") == key(n)).first() for n in ("ann", "bo"))
    assert (ann.n_purchases, ann.n_unique_items, ann.n_active_days, ann.days_since_last, ann.days_since_first, ann.n_purchases_7d) == (4, 3, 2, 6, 37, 1)
    assert (ann.avg_price, ann.max_price, ann.online_ratio) == (1.625, 4.0, 0.5)
    assert (bo.n_purchases, bo.n_purchases_7d, bo.n_purchases_30d, bo.days_since_last) == (3, 2, 3, 1)
    goods = {r.article_id: r for r in features.article_popularity(cat, CUT).collect()}
    assert set(goods) == {CUP, MUG, LAMP}
    cup = goods[CUP]
    assert (cup.n_sold, cup.n_buyers, cup.n_sold_1d, cup.n_sold_7d, cup.days_since_last_sale) == (4, 2, 1, 1, 1)
    assert cup.avg_price == 0.5 and cup.max_discount == pytest.approx(1 - 0.25 / 0.75) and cup.trend_ratio == 2.0
    assert [goods[a].price_pctile for a in (CUP, MUG, LAMP)] == [0.0, 0.5, 1.0]
    own = {(r.customer_key, r.article_id): r for r in features.customer_article_affinity(cat, CUT).collect()}
    assert set(own) == {(key("ann"), CUP), (key("ann"), LAMP), (key("ann"), MUG), (key("bo"), CUP), (key("bo"), LAMP)}
    assert (own[key("ann"), CUP].ca_n_purchases, own[key("ann"), CUP].ca_share_of_purchases, own[key("bo"), CUP].ca_min_price_paid) == (2, 0.5, 0.25)
    code = {(r.customer_key, r.product_code): r for r in features.customer_productcode_affinity(cat, CUT).collect()}
    assert (code[key("ann"), 70].cpc_n_purchases, code[key("ann"), 70].cpc_n_variants, code[key("ann"), 70].cpc_days_since_last) == (3, 2, 6)


def test_partitions_are_pruned(cat):
    plan = features.window_scan(cat.tx, CUT, 7)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "t_month" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_catalog_as_views(spark, cat):
    cat.register_views()
    assert spark.sql("SELECT count(*) FROM transactions JOIN articles USING (article_id) JOIN customers USING (customer_key)").first()[0] == len(SALES)


@pytest.fixture(scope="module")
def snap(spark, cat, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("snap"))
    snapshot.write_snapshot(cat, CUT, root, with_demo=True, rows=len(SALES))
    return snapshot.Snapshot.open(spark, root), root


def test_snapshot_round_trip(spark, cat, snap):
    snap, root = snap
    people = snapshot.all_customers(cat)
    assert snap.as_of == CUT and snap.sources().customer.agg(F.min("days_since_last")).first()[0] >= 1
    rows = snap.features(people)
    patched, absent = snapshot.patch_missing(rows, [*features.feature_columns(rows), "rank_other"])
    assert absent == ["rank_other"] and patched.first().rank_other == 9999
    assert reports.read_json(f"{root}/meta.json") == {"as_of": str(CUT), "rows": len(SALES)} == reports.read_json(f"file://{root}/meta.json")
    one = snap.lookup("repurchase", key("bo"))
    assert [r.article_id for r in one.orderBy("rank").collect()] == [CUP, LAMP] and "PushedFilters: [IsNotNull(customer_key), EqualTo(customer_key" in one._jdf.queryExecution().executedPlan().toString()
    kept = snapshot.Snapshot.open(spark, root, in_memory=True)
    assert sorted(map(repr, kept.features(people).collect())) == sorted(map(repr, rows.collect()))


def test_both_paths_give_the_same_features(cat, snap):
    """Every feature of every candidate, from the log and from the reopened snapshot; none has to be patched."""
    from tidewater.operators import fusion, retrieval

    people = cat.customers.select("customer_key")
    wide = fusion.build_candidates(retrieval.retrieve(cat, people, CUT), list(retrieval.GENERATORS)).drop("cand_rank")
    offline, online = features.build_features(wide, cat, CUT), snap[0].features(people)
    assert set(features.feature_columns(offline)) == set(features.feature_columns(online)) and len(features.feature_columns(offline)) >= 38
    columns = sorted(offline.columns)
    assert sorted(map(repr, offline.select(columns).collect())) == sorted(map(repr, online.select(columns).collect()))
    assert snapshot.patch_missing(online, features.feature_columns(offline))[1] == []


def test_console_lists(cat, snap):
    segments = snapshot.demo_tables(cat, CUT)["demo_segments"]
    assert {r.recency_segment: r.customers for r in snapshot.demo_segment_counts(segments).collect()} == {"never purchased": 1, "active <=7d": 1}
    assert [r.customer_key for r in snapshot.demo_customers(segments, 5, "never purchased").collect()] == [key("cy")]
    assert snapshot.demo_customers(segments, 1).count() == 1


def test_factors_are_saved_and_searched(spark, cat, tmp_path):
    ratings, users, items = baselines.interactions(cat, None, CUT)
    model = baselines.fit_als(ratings, rank=3, iterations=4)
    baselines.save_factors(model, items, str(tmp_path))
    again, factors = baselines.load_factors(spark, str(tmp_path))
    people = cat.customers.select("customer_key")
    lists = lambda m: sorted(map(tuple, baselines.recommend_als(m, users, items, people, 2).collect()))
    assert lists(again) == lists(model) and {r[0] for r in lists(model)} == {key("ann"), key("bo")}
    near = baselines.similar_articles(factors, cat.articles.filter(F.col("article_id") == CUP), 3).orderBy("rank").collect()
    vectors = {r.article_id: r.factor for r in factors.collect()}
    dots = sorted(((-round(sum(a * b for a, b in zip(vectors[CUP], v, strict=True)), 6), i) for i, v in vectors.items()))
    assert [(r.id, r.rank) for r in near] == [(i, n + 1) for n, (_, i) in enumerate(dots)]


def test_vector_search_in_blocks(spark):
    rows = [(i, [float((i * 7 + k * k) % 11) for k in range(4)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    asked = vectors.filter("id % 5 = 0")
    whole = baselines.vector_top_k(asked, vectors, 4, "id", "v")
    assert sorted(map(tuple, baselines.vector_top_k(asked, vectors, 4, "id", "v", block=5).collect())) == sorted(map(tuple, whole.collect()))
    for q, found in ((0, whole.filter("query_id = 0").orderBy("rank").collect()), (35, whole.filter("query_id = 35").orderBy("rank").collect())):
        assert [r.id for r in found] == [i for _, i in sorted((-sum(a * b for a, b in zip(rows[q][1], v, strict=True)), i) for i, v in rows)][:4]


def test_ranker_is_saved_with_its_columns(spark, tmp_path):
    rows = spark.createDataFrame([(i % 9, i, int(i % 4 == 0), float(i % 4), None if i % 5 else 1.0) for i in range(80)], "customer_key long, article_id int, label int, a double, b double")
    model = ranking.PointwiseGbt(trees=3, depth=2).fit(rows)
    columns = features.feature_columns(rows)
    model.save(str(tmp_path), columns)
    again, wanted = ranking.PointwiseGbt.load(str(tmp_path))
    assert wanted == columns == ["a", "b"] and again.settings == model.settings
    assert sorted(r.score for r in again.score(rows).collect()) == sorted(r.score for r in model.score(rows).collect())
    assert model.importance()[0][0] == "a" and sum(g for _, g in model.importance()) == pytest.approx(1.0)


def test_staged_tables_are_written_once(spark):
    built = []

    def build():
        built.append(1)
        return spark.range(5).toDF("x")

    first, second = (staging.staged(spark, "/no/such/root", "five", build) for _ in range(2))
    assert len(built) == 1 and first is second and first.count() == 5


def test_guards_and_reports(spark, tmp_path):
    with pytest.raises(SystemExit):
        ingest.require_files(str(tmp_path))
    tx = spark.createDataFrame([(OPENED, 1, 1)], "t_dat date, customer_key long, article_id int")
    with pytest.raises(ValueError):
        ingest.verify(tx, spark.createDataFrame([("x", 4), ("y", 4)], "customer_id string, customer_key long"))
    path = str(tmp_path / "report.md")
    reports.write_report(path, "first")
    with open(path, "a") as f:
        f.write("by hand\n")
    reports.write_report(path, reports.markdown_table(["n"], [(2,)]))
    text = open(path).read()
    assert "by hand" in text and "first" not in text and "| 2 |" in text
