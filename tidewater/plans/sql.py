"""Oracle SQL. Every text is complete; shared parts are common table expressions over the raw tables."""

from __future__ import annotations

import re

AS_OF = "DATE '2001-07-01'"
_SOURCES = ["r1_repurchase", "r2_popularity", "r2b_global", "r5_category", "r6_product_variant"]

_PARTS = {
    "tx": """SELECT CAST(o.o_orderdate AS DATE) AS t_dat, o.o_custkey AS customer_key, CAST(l.l_partkey AS INT) AS article_id,
        l.l_extendedprice AS price, CAST(1 + l.l_linenumber % 2 AS INT) AS sales_channel_id FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "art": """SELECT CAST(p_partkey AS INT) AS article_id, CAST(FLOOR(p_partkey / 8.0) AS BIGINT) AS product_code, p_type AS product_group_name, p_brand AS index_group_name,
        split_part(p_name, ' ', 2) AS garment_group_name, p_size AS product_type_no, p_size % 10 AS section_no, p_partkey % 50 AS department_no,
        p_partkey % 8 AS perceived_colour_value_id, p_partkey % 30 AS graphical_appearance_no, p_name AS prod_name, p_type AS product_type_name,
        split_part(p_name, ' ', 1) AS colour_group_name, p_name AS detail_desc FROM part""",
    "cust": """SELECT c_custkey AS customer_key, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(16 + (c_custkey * 7) % 70 AS DOUBLE) END AS age,
        CASE WHEN c_nationkey % 3 = 0 THEN CAST(1 AS DOUBLE) END AS fn, CASE WHEN c_nationkey % 5 = 0 THEN CAST(1 AS DOUBLE) END AS active,
        c_mktsegment AS club_member_status, CASE c_nationkey % 3 WHEN 0 THEN 'Regularly' WHEN 1 THEN 'Monthly' ELSE 'NONE' END AS fashion_news_frequency FROM customer""",
    "pop": "SELECT DISTINCT customer_key FROM tx WHERE t_dat >= @ AND t_dat < @ + 7",
    "w90": "SELECT * FROM tx WHERE t_dat < @ AND t_dat >= @ - 90",
    "p90": "SELECT * FROM w90 WHERE customer_key IN (SELECT customer_key FROM pop)",
    "w7": "SELECT * FROM tx WHERE t_dat < @ AND t_dat >= @ - 7",
    "truth": "SELECT DISTINCT customer_key, article_id FROM tx WHERE t_dat >= @ AND t_dat < @ + 7",
    "f1": """SELECT customer_key, count(*) AS n_purchases, count(DISTINCT article_id) AS n_unique_items, count(DISTINCT t_dat) AS n_active_days,
        CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_price, max(price) AS max_price, round(stddev_pop(price), 6) AS std_price, max(t_dat) AS last_purchase_date,
        date_diff('day', max(t_dat), @) AS days_since_last, date_diff('day', min(t_dat), @) AS days_since_first, count(*) FILTER (WHERE t_dat >= @ - 7) AS n_purchases_7d,
        count(*) FILTER (WHERE t_dat >= @ - 30) AS n_purchases_30d, CAST(sum(sales_channel_id - 1) AS DOUBLE) / count(*) AS online_ratio FROM p90 GROUP BY 1""",
    "f2a": """SELECT article_id, count(*) AS n_sold, count(DISTINCT customer_key) AS n_buyers, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_price, min(price) AS min_price,
        max(price) AS max_price, 1.0 - min(price) / nullif(max(price), 0) AS max_discount, count(*) FILTER (WHERE t_dat >= @ - 1) AS n_sold_1d, count(*) FILTER (WHERE t_dat >= @ - 7) AS n_sold_7d,
        count(*) FILTER (WHERE t_dat >= @ - 30) AS n_sold_30d, date_diff('day', min(t_dat), @) AS days_since_first_sale, date_diff('day', max(t_dat), @) AS days_since_last_sale,
        CAST(count(*) FILTER (WHERE t_dat >= @ - 7) + 1 AS DOUBLE) / (count(*) FILTER (WHERE t_dat >= @ - 14 AND t_dat < @ - 7) + 1) AS trend_ratio FROM w90 GROUP BY 1""",
    "f2": "SELECT *, percent_rank() OVER (ORDER BY avg_price) AS price_pctile FROM f2a",
    "f3": """SELECT customer_key, article_id, count(*) AS ca_n_purchases, date_diff('day', max(t_dat), @) AS ca_days_since_last, min(price) AS ca_min_price_paid,
        CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY customer_key) AS ca_share_of_purchases FROM p90 GROUP BY 1, 2""",
    "f4": """SELECT customer_key, product_code, count(*) AS cpc_n_purchases, count(DISTINCT p90.article_id) AS cpc_n_variants, date_diff('day', max(t_dat), @) AS cpc_days_since_last,
        CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY customer_key) AS cpc_share FROM p90 JOIN art USING (article_id) GROUP BY 1, 2""",
    "f5": """SELECT customer_key, product_group_name, count(*) AS cg_n_purchases, date_diff('day', max(t_dat), @) AS cg_days_since_last,
        CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY customer_key) AS cg_share FROM p90 JOIN art USING (article_id) GROUP BY 1, 2""",
    "r1": """SELECT customer_key, article_id, 'r1_repurchase' AS source, rank, CAST(n AS DOUBLE) AS score FROM (SELECT customer_key, article_id, count(*) AS n,
        row_number() OVER (PARTITION BY customer_key ORDER BY max(t_dat) DESC, count(*) DESC, article_id) AS rank FROM p90 GROUP BY 1, 2) WHERE rank <= 50""",
    "bucket": "SELECT customer_key, CAST(floor(coalesce(age, 30) / 10) AS BIGINT) AS age_bucket FROM cust",
    "r2t": """SELECT * FROM (SELECT age_bucket, article_id, count(*) AS score, row_number() OVER (PARTITION BY age_bucket ORDER BY count(*) DESC, article_id) AS rank
        FROM w7 JOIN bucket USING (customer_key) GROUP BY 1, 2) WHERE rank <= 200""",
    "r2": "SELECT customer_key, article_id, 'r2_popularity' AS source, rank, CAST(score AS DOUBLE) AS score FROM pop JOIN bucket USING (customer_key) JOIN r2t USING (age_bucket)",
    "r2bt": "SELECT * FROM (SELECT article_id, count(*) AS score, row_number() OVER (ORDER BY count(*) DESC, article_id) AS rank FROM w7 GROUP BY 1) WHERE rank <= 400",
    "r2b": "SELECT customer_key, article_id, 'r2b_global' AS source, rank, CAST(score AS DOUBLE) AS score FROM pop CROSS JOIN r2bt",
    "hist": "SELECT * FROM tx WHERE t_dat < @ AND t_dat >= @ - 3000",
    "co": """SELECT a.article_id AS i, b.article_id AS j, count(*) AS co FROM hist a JOIN hist b ON a.customer_key = b.customer_key AND a.t_dat = b.t_dat AND a.article_id < b.article_id
        GROUP BY 1, 2 HAVING count(*) >= 2""",
    "sold": "SELECT article_id, count(*) AS n FROM hist GROUP BY 1",
    "sims": "SELECT i, j, co / sqrt(CAST(x.n AS DOUBLE) * y.n) AS sim FROM co JOIN sold x ON x.article_id = i JOIN sold y ON y.article_id = j",
    "edges": "SELECT i AS article_id, j AS neighbour, sim FROM sims UNION ALL SELECT j, i, sim FROM sims",
    "seeds": """SELECT customer_key, article_id, row_number() OVER (PARTITION BY customer_key ORDER BY max(t_dat) DESC, article_id) AS seed_rank
        FROM hist WHERE customer_key IN (SELECT customer_key FROM pop) GROUP BY 1, 2""",
    "near": "SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY round(sim, 12) DESC, neighbour) AS r FROM edges",
    "r5g": """SELECT * FROM (SELECT customer_key, product_group_name, count(*) AS g, row_number() OVER (PARTITION BY customer_key ORDER BY count(*) DESC, product_group_name) AS r
        FROM p90 JOIN art USING (article_id) GROUP BY 1, 2) WHERE r <= 3""",
    "r5p": """SELECT * FROM (SELECT product_group_name, article_id, count(*) AS p, row_number() OVER (PARTITION BY product_group_name ORDER BY count(*) DESC, article_id) AS r
        FROM w7 JOIN art USING (article_id) GROUP BY 1, 2) WHERE r <= 20""",
    "r5": """SELECT customer_key, article_id, 'r5_category' AS source, rank, CAST(s AS DOUBLE) AS score FROM (SELECT customer_key, article_id, g * p AS s,
        row_number() OVER (PARTITION BY customer_key ORDER BY g * p DESC, article_id) AS rank FROM r5g JOIN r5p USING (product_group_name)) WHERE rank <= 100""",
    "r6o": "SELECT customer_key, product_code, count(*) AS n_owned, date_diff('day', max(t_dat), @) AS days FROM p90 JOIN art USING (article_id) GROUP BY 1, 2",
    "r6s": "SELECT product_code, article_id, count(*) AS n_sold FROM tx JOIN art USING (article_id) WHERE t_dat < @ AND t_dat >= @ - 14 GROUP BY 1, 2",
    "r6": """SELECT customer_key, article_id, 'r6_product_variant' AS source, rank, s AS score FROM (SELECT customer_key, article_id, CAST(n_sold * n_owned AS DOUBLE) / (1 + days) AS s,
        row_number() OVER (PARTITION BY customer_key ORDER BY CAST(n_sold * n_owned AS DOUBLE) / (1 + days) DESC, article_id) AS rank FROM r6o JOIN r6s USING (product_code)) WHERE rank <= 150""",
    "long": "SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r2b UNION ALL SELECT * FROM r5 UNION ALL SELECT * FROM r6",
    "wide": "SELECT customer_key, article_id, round(sum(1.0::DOUBLE / (60.0::DOUBLE + rank)), 12) AS rrf_score, count(DISTINCT source) AS n_sources, "
    + ", ".join(f"coalesce(max(CASE WHEN source = '{s}' THEN rank END), 9999) AS rank_{s}, coalesce(max(CASE WHEN source = '{s}' THEN score END), 0) AS score_{s}" for s in _SOURCES)
    + " FROM long GROUP BY 1, 2",
    "cand": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_key ORDER BY rrf_score DESC, article_id) AS cand_rank FROM wide) WHERE cand_rank <= 300",
    "labelled": "SELECT c.*, CASE WHEN t.article_id IS NULL THEN 0 ELSE 1 END AS label FROM cand c LEFT JOIN truth t ON t.customer_key = c.customer_key AND t.article_id = c.article_id",
    "model": "SELECT customer_key, article_id, cand_rank AS pos FROM cand WHERE cand_rank <= 12",
    "b2all": """SELECT customer_key, article_id, rank AS r FROM r1 WHERE rank <= 12 UNION ALL SELECT p.customer_key, f.article_id, f.rank + 1000 FROM pop p CROSS JOIN r2bt f
        WHERE f.rank <= 12 AND NOT EXISTS (SELECT 1 FROM r1 o WHERE o.rank <= 12 AND o.customer_key = p.customer_key AND o.article_id = f.article_id)""",
    "b2": "SELECT customer_key, article_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY customer_key ORDER BY r) AS pos FROM b2all) WHERE pos <= 12",
    "nt": "SELECT customer_key, count(*) AS n_truth FROM truth GROUP BY 1",
    "ap_b2": """SELECT n.customer_key, round(coalesce(g, 0) / least(n_truth, 12), 12) AS ap FROM nt n LEFT JOIN (SELECT customer_key, sum(CAST(hit AS DOUBLE) / pos) AS g FROM
        (SELECT customer_key, pos, row_number() OVER (PARTITION BY customer_key ORDER BY pos) AS hit FROM b2 SEMI JOIN truth USING (customer_key, article_id)) GROUP BY 1) h ON h.customer_key = n.customer_key""",
    "ap_model": """SELECT n.customer_key, round(coalesce(g, 0) / least(n_truth, 12), 12) AS ap FROM nt n LEFT JOIN (SELECT customer_key, sum(CAST(hit AS DOUBLE) / pos) AS g FROM
        (SELECT customer_key, pos, row_number() OVER (PARTITION BY customer_key ORDER BY pos) AS hit FROM model SEMI JOIN truth USING (customer_key, article_id)) GROUP BY 1) h ON h.customer_key = n.customer_key""",
    "counted": "SELECT *, score_r2b_global + 10 * score_r1_repurchase AS score FROM cand",
    "by_counts": "SELECT customer_key, article_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY customer_key ORDER BY score DESC, article_id) AS pos FROM counted) WHERE pos <= 12",
    "ap_counts": """SELECT n.customer_key, round(coalesce(g, 0) / least(n_truth, 12), 12) AS ap FROM nt n LEFT JOIN (SELECT customer_key, sum(CAST(hit AS DOUBLE) / pos) AS g FROM
        (SELECT customer_key, pos, row_number() OVER (PARTITION BY customer_key ORDER BY pos) AS hit FROM by_counts SEMI JOIN truth USING (customer_key, article_id)) GROUP BY 1) h ON h.customer_key = n.customer_key""",
    "prior": "SELECT customer_key, count(*) AS n_prior, date_diff('day', max(t_dat), @) AS recency FROM tx WHERE t_dat < @ AND customer_key IN (SELECT customer_key FROM pop) GROUP BY 1",
    "seg": """SELECT p.customer_key, coalesce(n_prior, 0) AS n_prior, recency, age,
        CASE WHEN recency IS NULL THEN '0 never purchased' WHEN recency <= 7 THEN '1 active <=7d' WHEN recency <= 30 THEN '2 active 8-30d' WHEN recency <= 90 THEN '3 active 31-90d' ELSE '4 dormant >90d' END AS recency_segment,
        CASE WHEN coalesce(n_prior, 0) = 0 THEN '0 none' WHEN n_prior <= 5 THEN '1 low (1-5)' WHEN n_prior <= 20 THEN '2 mid (6-20)' WHEN n_prior <= 60 THEN '3 high (21-60)' ELSE '4 very high (60+)' END AS frequency_segment,
        CASE WHEN age IS NULL THEN 'unknown' WHEN age < 25 THEN '<25' WHEN age < 35 THEN '25-34' WHEN age < 50 THEN '35-49' ELSE '50+' END AS age_segment
        FROM pop p LEFT JOIN prior USING (customer_key) LEFT JOIN cust USING (customer_key)""",
    "dec": """SELECT article_id, CAST(greatest(1, ceil((r - 1) * 10.0 / greatest(m - 1, 1))) AS BIGINT) AS decile FROM (SELECT article_id, row_number() OVER (ORDER BY count(*), article_id) AS r, count(*) OVER () AS m
        FROM tx WHERE t_dat < @ AND t_dat >= @ - 30 GROUP BY 1)""",
}


_ONLINE = {
    "p90": "SELECT * FROM w90",
    "r1": _PARTS["r1"].replace("FROM p90", "FROM w90") + " AND customer_key IN (SELECT customer_key FROM pop)",
    "r5g": _PARTS["r5g"].replace("FROM p90", "FROM w90"),
    "r5": _PARTS["r5"] + " AND customer_key IN (SELECT customer_key FROM pop)",
    "r6o": _PARTS["r6o"].replace("FROM p90", "FROM w90"),
    "r6": _PARTS["r6"] + " AND customer_key IN (SELECT customer_key FROM pop)",
}


def complete(body: str, as_of: str = AS_OF, parts: dict[str, str] = _PARTS) -> str:
    """``body`` with the parts that it names, and those that these name, in order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in parts:
            if name not in needed and re.search(rf"\b(FROM|JOIN|UNION ALL SELECT \* FROM)\s+{name}\b", text):
                visit(parts[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    named = ",\n".join(f"{n} AS ({parts[n]})" for n in needed)
    return (f"WITH {named}\n{body}" if named else body).replace("@", as_of)


_LONG = "customer_key, article_id, source, rank, score"
_KNN = """SELECT customer_key, article_id, '{source}' AS source, rank, score FROM (SELECT customer_key, article_id, score, row_number() OVER (PARTITION BY customer_key ORDER BY score DESC, article_id) AS rank
    FROM (SELECT customer_key, neighbour AS article_id, round(sum(sim / seed_rank), 12) AS score FROM seeds JOIN near USING (article_id) WHERE r <= {near} AND seed_rank <= {seeds} GROUP BY 1, 2)) WHERE rank <= {n}"""
_RECALL = "SELECT {label} AS {name}, round(avg(coalesce(found, 0) / CAST(n_truth AS DOUBLE)), 9) AS recall FROM nt LEFT JOIN (SELECT customer_key, count(DISTINCT article_id) AS found FROM ({preds}) WHERE pos <= {k} AND (customer_key, article_id) IN (SELECT (customer_key, article_id) FROM truth) GROUP BY 1) USING (customer_key)"
_FUSED = "SELECT customer_key, article_id, row_number() OVER (PARTITION BY customer_key ORDER BY round(sum(1.0::DOUBLE / (60.0::DOUBLE + rank)), 12) DESC, article_id) AS pos FROM long WHERE source <> '{without}' GROUP BY 1, 2"
_FEATURES = """c.customer_key, c.article_id, c.rrf_score, c.n_sources, cu.n_purchases, cu.n_unique_items, cu.n_active_days, cu.avg_price AS cust_avg_price, cu.max_price AS cust_max_price, cu.std_price AS cust_std_price,
    cu.days_since_last, cu.days_since_first, cu.n_purchases_7d, cu.n_purchases_30d, cu.online_ratio, cm.age, cm.fn, cm.active, cm.club_member_status, cm.fashion_news_frequency, ar.n_sold, ar.n_buyers, ar.avg_price AS art_avg_price,
    ar.max_discount, ar.n_sold_1d, ar.n_sold_7d, ar.n_sold_30d, ar.days_since_first_sale, ar.days_since_last_sale, ar.trend_ratio, ar.price_pctile, coalesce(af.ca_n_purchases, 0) AS ca_n_purchases, af.ca_days_since_last,
    coalesce(af.ca_share_of_purchases, 0) AS ca_share_of_purchases, coalesce(cg.cg_n_purchases, 0) AS cg_n_purchases, cg.cg_days_since_last, coalesce(cg.cg_share, 0) AS cg_share, coalesce(pc.cpc_n_purchases, 0) AS cpc_n_purchases,
    coalesce(pc.cpc_n_variants, 0) AS cpc_n_variants, pc.cpc_days_since_last, coalesce(pc.cpc_share, 0) AS cpc_share, a.product_group_name, a.index_group_name, a.garment_group_name, a.product_type_no, a.section_no, a.department_no,
    a.perceived_colour_value_id, a.graphical_appearance_no, ar.avg_price / nullif(cu.avg_price, 0) AS price_ratio, (ar.avg_price - cu.avg_price) / nullif(cu.std_price, 0) AS price_z""" + "".join(f", c.rank_{s}, c.score_{s}" for s in _SOURCES)
_HISTORY = "SELECT customer_key, article_id, t_dat, price FROM (SELECT *, row_number() OVER (PARTITION BY customer_key ORDER BY t_dat DESC, article_id, price) AS rn FROM tx WHERE t_dat < @ AND customer_key IN (SELECT customer_key FROM pop)) WHERE rn <= 40"
_ROLLING = """WITH tx AS ({tx}), weeks AS (SELECT unnest([DATE '2001-06-17', DATE '2001-06-24', DATE '2001-07-01']) AS d),
    truth AS (SELECT DISTINCT d, customer_key, article_id FROM weeks JOIN tx ON t_dat >= d AND t_dat < d + 7), pop AS (SELECT DISTINCT d, customer_key FROM truth),
    r1 AS (SELECT d, customer_key, article_id, row_number() OVER (PARTITION BY d, customer_key ORDER BY max(t_dat) DESC, count(*) DESC, article_id) AS rank FROM pop JOIN tx USING (customer_key) WHERE t_dat < d AND t_dat >= d - 90 GROUP BY 1, 2, 3),
    top AS (SELECT d, article_id, row_number() OVER (PARTITION BY d ORDER BY count(*) DESC, article_id) AS rank FROM weeks JOIN tx ON t_dat < d AND t_dat >= d - 7 GROUP BY 1, 2),
    own AS (SELECT * FROM r1 WHERE rank <= 12), b AS (SELECT d, customer_key, article_id, rank AS r FROM own UNION ALL SELECT p.d, p.customer_key, t.article_id, t.rank + 1000 FROM pop p JOIN top t ON t.d = p.d AND t.rank <= 12
      WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.d = p.d AND o.customer_key = p.customer_key AND o.article_id = t.article_id)),
    b2 AS (SELECT d, customer_key, article_id, row_number() OVER (PARTITION BY d, customer_key ORDER BY r) AS pos FROM b),
    h AS (SELECT d, customer_key, pos, row_number() OVER (PARTITION BY d, customer_key ORDER BY pos) AS hit FROM b2 SEMI JOIN truth USING (d, customer_key, article_id) WHERE pos <= 12),
    g AS (SELECT d, customer_key, sum(CAST(hit AS DOUBLE) / pos) AS g FROM h GROUP BY 1, 2), n AS (SELECT d, customer_key, count(*) AS n FROM truth GROUP BY 1, 2)
    SELECT d AS as_of, round(avg(round(coalesce(g, 0) / least(n, 12), 12)), 9) AS map FROM n LEFT JOIN g USING (d, customer_key) GROUP BY 1"""
_BUDGET = """SELECT CAST({k} AS BIGINT) AS budget, round(avg(coalesce(found, 0) / CAST(n_truth AS DOUBLE)), 9) AS recall, round(avg(round(coalesce(g, 0) / least(n_truth, 12), 12)), 9) AS map FROM nt
    LEFT JOIN (SELECT customer_key, count(*) AS found FROM counted SEMI JOIN truth USING (customer_key, article_id) WHERE cand_rank <= {k} GROUP BY 1) f USING (customer_key)
    LEFT JOIN (SELECT customer_key, sum(CAST(hit AS DOUBLE) / pos) AS g FROM (SELECT customer_key, pos, row_number() OVER (PARTITION BY customer_key ORDER BY pos) AS hit FROM
      (SELECT customer_key, article_id, row_number() OVER (PARTITION BY customer_key ORDER BY score DESC, article_id) AS pos FROM counted WHERE cand_rank <= {k}) SEMI JOIN truth USING (customer_key, article_id) WHERE pos <= 12)
      GROUP BY 1) h USING (customer_key)"""
_WEEK = """SELECT *, round(map_model / nullif(map_b2, 0) - 1, 3) AS lift FROM (SELECT @ AS as_of, count(*) AS customers, round(avg(m.ap), 9) AS map_model, round(avg(b.ap), 9) AS map_b2
    FROM ap_counts m JOIN ap_b2 b USING (customer_key))"""
_LISTED = "(SELECT customer_key, string_agg(article_id, ',' ORDER BY {order}) AS {name} FROM {rows} GROUP BY 1)"
_NEG = "(customer_key * 7919 + article_id * CAST(104729 AS BIGINT)) % 1000003"

_BODIES = {
    "customer_recency": "SELECT * FROM f1",
    "article_popularity": "SELECT * FROM f2",
    "customer_article_affinity": "SELECT * FROM f3",
    "customer_productcode_affinity": "SELECT * FROM f4",
    "customer_group": "SELECT * FROM f5",
    "r1_repurchase": f"SELECT {_LONG} FROM r1",
    "r2_age_popularity": "SELECT age_bucket, article_id, score, rank FROM r2t",
    "r2_popularity": f"SELECT {_LONG} FROM r2",
    "r2b_global": f"SELECT {_LONG} FROM r2b",
    "r3_item_knn": _KNN.format(source="r3_item_knn", near=40, seeds=20, n=50),
    "r3_last_knn": _KNN.format(source="r3_last_knn", near=60, seeds=1, n=100),
    "r5_category": f"SELECT {_LONG} FROM r5",
    "r6_product_variant": f"SELECT {_LONG} FROM r6",
    "rrf_fuse": "SELECT customer_key, article_id, rrf_score, row_number() OVER (PARTITION BY customer_key ORDER BY rrf_score DESC, article_id) AS cand_rank FROM wide",
    "rrf_fuse_weighted": """SELECT customer_key, article_id, s AS rrf_score, row_number() OVER (PARTITION BY customer_key ORDER BY s DESC, article_id) AS cand_rank FROM (SELECT customer_key, article_id,
        round(sum(CASE source WHEN 'r1_repurchase' THEN 2.5::DOUBLE WHEN 'r2b_global' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END / (60.0::DOUBLE + rank)), 12) AS s FROM long GROUP BY 1, 2)""",
    "build_candidates": "SELECT * FROM cand",
    "candidate_lists": "SELECT customer_key, cand_rank, article_id FROM cand WHERE cand_rank <= 50",
    "recall_by_source": " UNION ALL ".join(_RECALL.format(label=f"'{s}'", name="source", preds=f"SELECT customer_key, article_id, rank AS pos FROM {t}", k=300) for s, t in zip(_SOURCES, ("r1", "r2", "r2b", "r5", "r6"), strict=True)),
    "recall_curve": " UNION ALL ".join(_RECALL.format(label=f"CAST({k} AS BIGINT)", name="budget", preds=_FUSED.format(without=""), k=k) for k in (12, 50, 100, 200, 300, 500)),
    "recall_leave_one_out": " UNION ALL ".join(_RECALL.format(label=f"'{s}'", name="without", preds=_FUSED.format(without=s), k=300) for s in _SOURCES),
    "b0_bestsellers": "SELECT article_id, rank FROM r2bt WHERE rank <= 12",
    "b0_age_buckets": "SELECT age_bucket, article_id, rank FROM r2t WHERE rank <= 12",
    "b1_repurchase": "SELECT customer_key, article_id, rank AS pos FROM r1 WHERE rank <= 12",
    "b2_pad": "SELECT * FROM b2",
    "b2_serve": """SELECT customer_key, article_id, pos FROM (SELECT customer_key, article_id, row_number() OVER (PARTITION BY customer_key ORDER BY r, article_id) AS pos FROM (SELECT customer_key, article_id, rank AS r FROM r1 WHERE rank <= 12
        UNION ALL SELECT p.customer_key, f.article_id, f.rank + 1000 FROM pop p CROSS JOIN r2bt f WHERE NOT EXISTS (SELECT 1 FROM r1 o WHERE o.rank <= 12 AND o.customer_key = p.customer_key AND o.article_id = f.article_id))) WHERE pos <= 12""",
    "b2_evaluate": """SELECT (SELECT round(avg(ap), 9) FROM ap_b2) AS map, (SELECT recall FROM (""" + _RECALL.format(label="1", name="x", preds="SELECT * FROM b2", k=12) + """)) AS recall, (SELECT count(DISTINCT customer_key) FROM b2) / CAST(count(*) AS DOUBLE) AS coverage FROM pop""",
    "ground_truth": "SELECT * FROM truth",
    "label_candidates": "SELECT customer_key, article_id, label FROM labelled",
    "downsample_negatives": f"""SELECT customer_key, article_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_NEG}, customer_key, article_id) AS r, (SELECT count(*) FROM labelled WHERE label = 1) AS p
        FROM labelled WHERE customer_key IN (SELECT customer_key FROM labelled WHERE label = 1)) WHERE label = 1 OR r <= 20 * p""",
    "group_sizes": "SELECT customer_key, count(*) AS size FROM cand GROUP BY 1",
    "ap_at_12": "SELECT * FROM ap_b2",
    "map_at_12": "SELECT round(avg(ap), 9) AS map FROM ap_b2",
    "recall_at_12": "SELECT customer_key, coalesce(found, 0) / CAST(n_truth AS DOUBLE) AS recall FROM nt LEFT JOIN (SELECT customer_key, count(DISTINCT article_id) AS found FROM b2 SEMI JOIN truth USING (customer_key, article_id) GROUP BY 1) USING (customer_key)",
    "ndcg_at_12": """SELECT customer_key, round(coalesce(g, 0) / list_sum(list_transform(range(1, CAST(least(n_truth, 12) AS BIGINT) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 9) AS ndcg FROM nt
        LEFT JOIN (SELECT customer_key, sum(1.0::DOUBLE / log2(pos + 1)) AS g FROM b2 SEMI JOIN truth USING (customer_key, article_id) GROUP BY 1) USING (customer_key)""",
    "customer_segments": "SELECT * FROM seg",
    "segment_table": """SELECT recency_segment, count(*) AS customers, round(avg(m.ap), 5) AS map_model, round(avg(b.ap), 5) AS map_b2, round(avg(m.ap) / nullif(round(avg(b.ap), 12), 0) - 1, 3) AS lift
        FROM seg JOIN ap_model m USING (customer_key) JOIN ap_b2 b USING (customer_key) GROUP BY 1""",
    "popularity_deciles": """SELECT decile, purchases, round(hits / CAST(purchases AS DOUBLE), 6) AS hit_rate, round(purchases / CAST(sum(purchases) OVER () AS DOUBLE), 6) AS share_of_truth FROM
        (SELECT coalesce(decile, 0) AS decile, count(*) AS purchases, count(h.article_id) AS hits FROM truth t LEFT JOIN dec USING (article_id) LEFT JOIN b2 h ON h.customer_key = t.customer_key AND h.article_id = t.article_id GROUP BY 1)""",
    "diversity": """SELECT count(*) AS distinct_items_recommended, round(count(*) / CAST((SELECT count(*) FROM art) AS DOUBLE), 6) AS catalogue_coverage,
        (SELECT round(-sum(p * log2(p)), 6) FROM (SELECT count(*) / CAST((SELECT count(*) FROM b2) AS DOUBLE) AS p FROM b2 JOIN art USING (article_id) GROUP BY product_group_name)) AS category_entropy_bits,
        (SELECT round(log2(count(DISTINCT product_group_name)), 6) FROM b2 JOIN art USING (article_id)) AS max_category_entropy_bits, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS most_recommended_item_share
        FROM (SELECT article_id, count(*) AS n FROM b2 GROUP BY 1)""",
    "assemble_features": f"""SELECT {_FEATURES} FROM cand c LEFT JOIN f1 cu ON cu.customer_key = c.customer_key LEFT JOIN cust cm ON cm.customer_key = c.customer_key LEFT JOIN f2 ar ON ar.article_id = c.article_id
        LEFT JOIN f3 af ON af.customer_key = c.customer_key AND af.article_id = c.article_id LEFT JOIN art a ON a.article_id = c.article_id LEFT JOIN f5 cg ON cg.customer_key = c.customer_key AND cg.product_group_name = a.product_group_name
        LEFT JOIN f4 pc ON pc.customer_key = c.customer_key AND pc.product_code = a.product_code""",
    "budget_sweep": " UNION ALL ".join(_BUDGET.format(k=k) for k in (50, 100, 200, 300)),
    "demo_truth": "SELECT customer_key, article_id, count(*) AS n FROM tx WHERE t_dat >= @ AND t_dat < @ + 7 GROUP BY 1, 2",
    "demo_history": _HISTORY,
    "demo_articles": "SELECT article_id, prod_name, product_type_name, colour_group_name, product_group_name, index_group_name, detail_desc FROM art",
    "demo_segments": """SELECT customer_key, coalesce(n_prior, 0) AS n_prior, recency, age, CASE WHEN recency IS NULL THEN 'never purchased' WHEN recency <= 7 THEN 'active <=7d' WHEN recency <= 30 THEN 'active 8-30d'
        WHEN recency <= 90 THEN 'active 31-90d' ELSE 'dormant >90d' END AS recency_segment FROM pop LEFT JOIN prior USING (customer_key) LEFT JOIN cust USING (customer_key)""",
    "source_attribution": "SELECT customer_key, article_id, cand_rank AS pos, concat_ws(',', " + ", ".join(f"CASE WHEN rank_{s} <> 9999 THEN '{s}' END" for s in _SOURCES) + ") AS sources, label = 1 AS hit FROM labelled WHERE cand_rank <= 12",
    "verify_ingest": "SELECT count(*) AS n_rows, count(DISTINCT customer_key) AS n_customers, count(DISTINCT article_id) AS n_articles, min(t_dat) AS first_day, max(t_dat) AS last_day FROM tx",
    "customer_key": "SELECT c_custkey AS expected, CAST('0x' || right(lpad(lower(hex(c_custkey)), 64, '0'), 15) AS BIGINT) AS customer_key FROM customer",
    "partitioned_scan": "SELECT CAST(month(t_dat) AS INT) AS t_month, count(*) AS n, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM w90 GROUP BY 1",
    "vector_topk_ip": """SELECT query_id, id, score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) DESC, e.vec_id) AS rank
        FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 100 = 0) WHERE rank <= 10""",
    "latency_percentiles": "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max FROM events GROUP BY 1",
    "target_articles": f"""SELECT s.article_id, coalesce(f.n_sold, 0) AS n_sold FROM (SELECT article_id FROM truth UNION SELECT article_id FROM ({_HISTORY}) UNION SELECT article_id FROM r2bt UNION SELECT article_id FROM r2t UNION SELECT article_id FROM
        (SELECT *, row_number() OVER (PARTITION BY customer_key ORDER BY g * p DESC, article_id) AS rank FROM (SELECT * FROM (SELECT customer_key, product_group_name, count(*) AS g, row_number() OVER (PARTITION BY customer_key ORDER BY count(*) DESC, product_group_name) AS r
         FROM w90 JOIN art USING (article_id) GROUP BY 1, 2) WHERE r <= 3) g JOIN (SELECT product_group_name, article_id, p FROM r5p) USING (product_group_name)) WHERE rank <= 100
        UNION SELECT article_id FROM (SELECT *, row_number() OVER (PARTITION BY customer_key ORDER BY CAST(n_sold * n_owned AS DOUBLE) / (1 + days) DESC, article_id) AS rank FROM (SELECT customer_key, product_code, count(*) AS n_owned, date_diff('day', max(t_dat), @) AS days FROM w90 JOIN art USING (article_id) GROUP BY 1, 2)
         JOIN r6s USING (product_code)) WHERE rank <= 150
        UNION SELECT article_id FROM (SELECT customer_key, article_id, row_number() OVER (PARTITION BY customer_key ORDER BY max(t_dat) DESC, count(*) DESC, article_id) AS rank FROM w90 GROUP BY 1, 2) WHERE rank <= 50) s LEFT JOIN f2 f USING (article_id)""",
    "recent_history": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_key ORDER BY t_dat DESC, article_id, price) AS rn FROM ({_HISTORY})) WHERE rn <= 15",
    "explain_customers": f"""SELECT p.customer_key, coalesce(ap, 0) AS ap, coalesce(n_truth, 0) AS n_truth, coalesce(hits, 0) AS hits, coalesce(recommended, '') AS recommended, coalesce(recent, '') AS recent, coalesce(b2, '') AS b2
        FROM (SELECT DISTINCT customer_key FROM model) p LEFT JOIN ap_model USING (customer_key) LEFT JOIN nt USING (customer_key)
        LEFT JOIN (SELECT customer_key, count(*) AS hits FROM model SEMI JOIN truth USING (customer_key, article_id) GROUP BY 1) USING (customer_key)
        LEFT JOIN {_LISTED.format(order="pos", name="recommended", rows="model")} USING (customer_key) LEFT JOIN {_LISTED.format(order="pos", name="b2", rows="b2")} USING (customer_key)
        LEFT JOIN {_LISTED.format(order="rn", name="recent", rows=f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_key ORDER BY t_dat DESC, article_id, price) AS rn FROM ({_HISTORY})) WHERE rn <= 15)")} USING (customer_key)""",
    "segment_counts": "SELECT recency_segment, count(*) AS customers FROM (SELECT CASE WHEN recency IS NULL THEN 'never purchased' WHEN recency <= 7 THEN 'active <=7d' WHEN recency <= 30 THEN 'active 8-30d' WHEN recency <= 90 THEN 'active 31-90d' ELSE 'dormant >90d' END AS recency_segment FROM pop LEFT JOIN prior USING (customer_key)) GROUP BY 1",
    "truth_lists": "SELECT customer_key, string_agg(article_id, ',' ORDER BY article_id) AS articles FROM truth GROUP BY 1",
    "image_paths": "SELECT article_id, 'images/' || left(lpad(CAST(article_id AS VARCHAR), 10, '0'), 3) || '/' || lpad(CAST(article_id AS VARCHAR), 10, '0') || '.jpg' AS path FROM art",
    "recall_report": " UNION ALL ".join(
        f"SELECT '{s}' AS source, (SELECT recall FROM ({_RECALL.format(label='1', name='x', preds=f'SELECT customer_key, article_id, rank AS pos FROM {t}', k=300)})) AS recall, count(o.customer_key) / CAST(count(*) AS DOUBLE) AS coverage FROM pop p LEFT JOIN (SELECT DISTINCT customer_key FROM {t}) o ON o.customer_key = p.customer_key"
        for s, t in zip(_SOURCES, ("r1", "r2", "r2b", "r5", "r6"), strict=True)
    ),
}


def _parity() -> str:
    """The offline lists and those of tables over all customers, and how they agree."""
    lists = "SELECT customer_key, string_agg(article_id, ',' ORDER BY pos) AS list, list(article_id) AS items FROM by_counts GROUP BY 1"
    offline, online = complete(lists), complete(lists, parts=_PARTS | _ONLINE)
    maps = [complete("SELECT round(avg(ap), 9) AS m FROM ap_counts", parts=p) for p in (_PARTS, _PARTS | _ONLINE)]
    return f"""SELECT count(*) AS customers, (SELECT m FROM ({maps[0]})) AS map_offline, (SELECT m FROM ({maps[1]})) AS map_online, avg(len(list_intersect(a.items, b.items)) / CAST(12 AS DOUBLE)) AS overlap,
        avg(CASE WHEN a.list = b.list THEN CAST(1 AS DOUBLE) ELSE 0 END) AS identical FROM ({offline}) a JOIN ({online}) b USING (customer_key)"""


def oracle_sql() -> dict[str, str]:
    weeks = [f"DATE '2001-{d}'" for d in ("07-01", "06-24", "06-17")]
    rolling = " UNION ALL ".join(f"SELECT * FROM ({complete(_WEEK, w)})" for w in weeks)
    return {name: complete(body) for name, body in _BODIES.items()} | {"rolling_b2": _ROLLING.format(tx=_PARTS["tx"]), "rolling_model": rolling, "snapshot_parity": _parity()}
