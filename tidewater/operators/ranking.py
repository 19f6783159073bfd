"""Labels, negative sampling, training sets, ranker, prediction, tree sweep."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce
from typing import Protocol

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import DataFrame, functions as F

from ..catalog import Catalog
from ..config import NEGATIVES_PER_POSITIVE, TOP_K
from ..functions.scalars import ranked
from ..sources.reports import read_json, write_json
from ..sources.staging import written
from . import evaluation, features
from .retrieval import GENERATORS, retrieve
from .fusion import build_candidates
from .scans import merged

_HASH_RANGE = 1_000_003  # a prime


def label_candidates(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """label: 1 if bought in the target week."""
    return candidates.join(truth.select("customer_key", "article_id").distinct().withColumn("label", F.lit(1)), ["customer_key", "article_id"], "left").fillna(0, ["label"])


def downsample_negatives(labelled: DataFrame, ratio: int = NEGATIVES_PER_POSITIVE) -> DataFrame:
    """Customers with a positive; all their positives, and over the whole frame ``ratio`` negatives
    for each positive, those with the smallest hash. The cut is found on a histogram of hashes (as
    many rows as there are hash classes), so no order over all negatives is needed."""
    buyers = labelled.filter("label = 1").select("customer_key").distinct()
    rows = labelled.join(buyers, "customer_key", "left_semi").withColumn("_h", (F.col("customer_key") * 7919 + F.col("article_id").cast("long") * 104729) % _HASH_RANGE)
    classes = rows.groupBy(F.when(F.col("label") == 0, F.floor(F.col("_h") / 1000)).alias("c")).agg(F.count("*").alias("n")).collect()
    left = ratio * sum(r.n for r in classes if r.c is None)
    edge = _HASH_RANGE
    for r in sorted((r for r in classes if r.c is not None), key=lambda r: r.c):
        if r.n > left:
            edge = r.c
            break
        left -= r.n
    c = F.floor(F.col("_h") / 1000)
    whole = rows.filter((F.col("label") == 1) | (c < edge))
    part = rows.filter((F.col("label") == 0) & (c == edge)).orderBy("_h", "customer_key", "article_id").limit(left)
    return whole.unionByName(part).drop("_h")


def build_training_set(cat: Catalog, as_of: date, ratio: int = NEGATIVES_PER_POSITIVE, n_candidates: int = 300) -> DataFrame:
    """Each step is written: sampling reads the candidates three times and a ranker reads the rows once for
    every pass, and a plan that holds all steps, each time anew, is more than the driver has memory for."""
    population = written(evaluation.eval_customers(cat, as_of), "training-population")
    wide = build_candidates(retrieve(cat, population, as_of), list(GENERATORS), n_candidates)
    labelled = written(label_candidates(wide, evaluation.ground_truth(cat, as_of)), "training-candidates")
    rows = written(downsample_negatives(labelled, ratio), "training-sample")
    return written(features.downcast(features.assemble(rows.drop("cand_rank"), features.offline_sources(cat, as_of, population=population), cat)), "training-rows")


def build_multiweek_training_set(cat: Catalog, weeks: list[date], **settings) -> DataFrame:
    """Each week with its own as_of, told apart by ``week``."""
    return reduce(DataFrame.unionByName, [build_training_set(cat, w, **settings).withColumn("week", F.lit(w)) for w in weeks])


def group_sizes(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*(keys or ("customer_key",))).agg(F.count("*").alias("size"))


class Ranker(Protocol):
    """What the pipeline needs of a ranking backend."""

    def fit(self, rows: DataFrame) -> Ranker: ...

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds ``score``."""


class PointwiseGbt:
    """Boosted trees on the label: a pointwise objective, not a listwise one, so its metrics aren't
    comparable with those of a LambdaRank model. Missing values become a sentinel and a flag."""

    def __init__(self, trees: int = 20, depth: int = 5, step: float = 0.1, subsample: float = 0.8, seed: int = 42):
        self.settings = {"maxIter": trees, "maxDepth": depth, "stepSize": step, "subsamplingRate": subsample, "seed": seed}
        self.model: PipelineModel | None = None

    def _numeric(self, rows: DataFrame) -> tuple[DataFrame, list[str]]:
        names = [c for c in features.feature_columns(rows) if c not in features.CATEGORICAL and dict(rows.dtypes)[c] != "string"]
        filled = rows.withColumns({f"_{c}": F.coalesce(F.col(c).cast("double"), F.lit(-999.0)) for c in names} | {f"_na_{c}": F.col(c).isNull().cast("double") for c in names})
        return filled, [f"_{c}" for c in names] + [f"_na_{c}" for c in names]

    def fit(self, rows: DataFrame) -> PointwiseGbt:
        filled, names = self._numeric(rows)
        filled = filled.persist()  # boosting reads the rows once for each level of each tree
        indexed = [c for c in features.CATEGORICAL if c in rows.columns]
        largest = max([2, *filled.agg(*[F.countDistinct(c) for c in indexed]).first()]) if indexed else 2
        stages = [StringIndexer(inputCols=indexed, outputCols=[f"_{c}" for c in indexed], handleInvalid="keep")] if indexed else []
        stages += [VectorAssembler(inputCols=names + [f"_{c}" for c in indexed], outputCol="_features"), GBTClassifier(labelCol="label", featuresCol="_features", maxBins=max(32, largest + 2), **self.settings)]
        self.model = Pipeline(stages=stages).fit(filled)
        filled.unpersist()
        return self

    def score(self, rows: DataFrame) -> DataFrame:
        out = self.model.transform(self._numeric(rows)[0]).withColumn("score", vector_to_array("probability")[1])
        return out.select(*rows.columns, "score")

    def prefixes(self, rows: DataFrame, sizes: list[int]) -> DataFrame:
        """Adds, for each n of ``sizes``, the score by the model's first n trees as ``_score_n``; the rows pass
        each tree once."""
        *before, boosted = self.model.stages
        out = PipelineModel(before).transform(self._numeric(rows)[0])
        weights = list(boosted.treeWeights)[: max(sizes)]
        for k, tree in enumerate(boosted.trees[: len(weights)]):
            tree.setPredictionCol(f"_t{k}")
            out = tree.transform(out)
        out = out.withColumn("_votes", F.array(*[F.col(f"_t{k}") * w for k, w in enumerate(weights)]))
        total = lambda n: sum((F.get("_votes", F.lit(k)) for k in range(min(n, len(weights)))), F.lit(0.0))
        return out.select(*rows.columns, *[total(n).alias(f"_score_{n}") for n in sizes])

    def truncated(self, trees: int) -> Callable[[DataFrame], DataFrame]:
        """The model's first trees only, as a scoring function."""
        return lambda rows: self.prefixes(rows, [trees]).withColumnRenamed(f"_score_{trees}", "score")

    def importance(self) -> list[tuple[str, float]]:
        """(column, gain as a share of all gain), the largest first; the indicator of a missing value bears
        the name of its column and a mark."""
        names = self.model.stages[-2].getInputCols()
        gains = self.model.stages[-1].featureImportances.toArray().tolist()
        return sorted(((n[1:], g) for n, g in zip(names, gains, strict=True)), key=lambda x: (-x[1], x[0]))

    def save(self, root: str, columns: list[str]) -> None:
        """The model, and beside it the columns that it wants."""
        self.model.write().overwrite().save(f"{root}/model")
        write_json(f"{root}/features.json", {"features": columns, "settings": self.settings})

    @classmethod
    def load(cls, root: str) -> tuple[PointwiseGbt, list[str]]:
        facts = read_json(f"{root}/features.json")
        out = cls()
        out.settings, out.model = facts["settings"], PipelineModel.load(f"{root}/model")
        return out, facts["features"]


def listwise_gradients(rows: DataFrame, k: int = TOP_K) -> DataFrame:
    """Adds ``lambda`` and ``weight`` to rows (customer_key, article_id, label, score): the sums, over all
    pairs of a bought and another candidate of the customer, of the pair's logistic gradient and its
    derivative, each times the NDCG@k that swapping the two would change. A customer's candidates, at
    most the candidate budget, are one list; places come from the score, ties from the article."""
    entry = F.struct((-F.col("score")).alias("minus"), "article_id", F.col("label").cast("double").alias("y"), "score")
    lists = rows.groupBy("customer_key").agg(F.sort_array(F.collect_list(entry)).alias("all"))
    placed = F.transform("all", lambda x, i: F.struct(x["article_id"].alias("article_id"), x["y"].alias("y"), x["score"].alias("score"), F.when(i < k, 1.0 / F.log2(i + 2)).otherwise(0.0).alias("d")))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.greatest(F.lit(1), F.aggregate("all", F.lit(0.0), lambda s, x: s + x["y"]).cast("int")))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    # written between generators, so that no lambda works a list out again for every candidate
    lists = lists.select("customer_key", F.inline(F.array(F.struct(placed.alias("list"), ideal.alias("ideal")))))

    def per_candidate(x):
        def add(s, o):
            pair = x["y"] != o["y"]
            sign = x["y"] - o["y"]
            rho = 1.0 / (1.0 + F.exp(sign * (x["score"] - o["score"])))
            change = F.abs(x["d"] - o["d"]) / F.col("ideal")
            return F.struct((s["g"] + F.when(pair, sign * rho * change).otherwise(0.0)).alias("g"), (s["h"] + F.when(pair, rho * (1.0 - rho) * change).otherwise(0.0)).alias("h"))

        sums = F.aggregate("list", F.struct(F.lit(0.0).alias("g"), F.lit(0.0).alias("h")), add)
        return F.struct(x["article_id"].alias("article_id"), sums["g"].alias("lambda"), sums["h"].alias("weight"))

    found = lists.select("customer_key", F.explode(F.transform("list", per_candidate)).alias("c")).select("customer_key", "c.*")
    return merged(rows, found, ["customer_key", "article_id"])


class LambdaMart(PointwiseGbt):
    """Boosted regression trees on the gradients of a listwise objective (NDCG@k), with Newton steps in the
    leaves. A tree is MLlib's; the gradients are DataFrame functions over each customer's list. Rows need
    customer_key, article_id (once for each customer) and label."""

    def __init__(self, trees: int = 20, depth: int = 5, step: float = 0.1, k: int = TOP_K, seed: int = 42):
        self.settings = {"trees": trees, "depth": depth, "step": step, "k": k, "seed": seed}
        self.before: PipelineModel | None = None
        self.trees: list[tuple[DecisionTreeRegressionModel, dict[float, float]]] = []

    def fit(self, rows: DataFrame) -> LambdaMart:
        s = self.settings
        filled, names = self._numeric(rows)
        indexed = [c for c in features.CATEGORICAL if c in rows.columns]
        largest = max([2, *filled.agg(*[F.countDistinct(c) for c in indexed]).first()]) if indexed else 2
        stages = [StringIndexer(inputCols=indexed, outputCols=[f"_{c}" for c in indexed], handleInvalid="keep")] if indexed else []
        stages += [VectorAssembler(inputCols=names + [f"_{c}" for c in indexed], outputCol="_features")]
        self.before = Pipeline(stages=stages).fit(filled)
        # the rows and each round's scores are written: a round reads them more than once
        held = written(self.before.transform(filled).select("customer_key", "article_id", "label", "_features"), "lambdamart-rows")
        scores = written(held.select("customer_key", "article_id", "label", F.lit(0.0).alias("score")), "lambdamart-scores")
        self.trees = []
        for n in range(s["trees"]):
            graded = written(listwise_gradients(scores, s["k"]).drop("label"), "lambdamart-gradients")
            work = merged(held, graded, ["customer_key", "article_id"])
            tree = DecisionTreeRegressor(featuresCol="_features", labelCol="lambda", maxDepth=s["depth"], maxBins=max(32, largest + 2), minInstancesPerNode=1, seed=s["seed"] + n, leafCol="_leaf").fit(work)
            leaves = tree.transform(work).groupBy("_leaf").agg(F.sum("lambda").alias("g"), F.sum("weight").alias("h")).collect()  # at most 2 ** depth
            values = {r["_leaf"]: s["step"] * r.g / (r.h + 1e-9) if r.h else 0.0 for r in leaves}
            self.trees.append((tree, values))
            scores = written(self._stepped(work, tree, values).select("customer_key", "article_id", "label", "score"), "lambdamart-scores")
        return self

    @staticmethod
    def _stepped(rows: DataFrame, tree: DecisionTreeRegressionModel, values: dict[float, float]) -> DataFrame:
        table = F.create_map(*[F.lit(x) for leaf, v in sorted(values.items()) for x in (float(leaf), float(v))])
        out = tree.transform(rows.drop("prediction", "_leaf"))
        return out.withColumn("score", F.col("score") + F.coalesce(F.try_element_at(table, F.col("_leaf")), F.lit(0.0))).drop("prediction", "_leaf")

    def prefixes(self, rows: DataFrame, sizes: list[int]) -> DataFrame:
        out = self.before.transform(self._numeric(rows)[0]).withColumn("score", F.lit(0.0))
        for n in range(max(sizes) + 1):
            if 0 < n <= len(self.trees):
                out = self._stepped(out, *self.trees[n - 1])
            if n in sizes:
                out = out.withColumn(f"_score_{n}", F.col("score"))
        return out.select(*rows.columns, *[f"_score_{n}" for n in sizes])

    def score(self, rows: DataFrame) -> DataFrame:
        return self.truncated(len(self.trees))(rows)

    def importance(self) -> list[tuple[str, float]]:
        names = self.before.stages[-1].getInputCols()
        total = [0.0] * len(names)
        for tree, _ in self.trees:
            for i, g in enumerate(tree.featureImportances.toArray().tolist()):
                total[i] += g / max(1, len(self.trees))
        return sorted(((n[1:], g) for n, g in zip(names, total, strict=True)), key=lambda x: (-x[1], x[0]))

    def save(self, root: str, columns: list[str]) -> None:
        self.before.write().overwrite().save(f"{root}/before")
        for n, (tree, _) in enumerate(self.trees):
            tree.write().overwrite().save(f"{root}/tree-{n}")
        write_json(f"{root}/features.json", {"features": columns, "settings": self.settings, "leaves": [sorted(v.items()) for _, v in self.trees]})

    @classmethod
    def load(cls, root: str) -> tuple[LambdaMart, list[str]]:
        facts = read_json(f"{root}/features.json")
        out = cls(**facts["settings"])
        out.before = PipelineModel.load(f"{root}/before")
        out.trees = [(DecisionTreeRegressionModel.load(f"{root}/tree-{n}"), dict(map(tuple, v))) for n, v in enumerate(facts["leaves"])]
        return out, facts["features"]


def top_k(scored: DataFrame, k: int = TOP_K) -> DataFrame:
    """customer_key, article_id, pos."""
    return scored.withColumn("pos", ranked("customer_key", F.desc("score"), F.asc("article_id")).cast("long")).filter(F.col("pos") <= k).select("customer_key", "article_id", "pos")


def predict_week(cat: Catalog, as_of: date, score: Callable[[DataFrame], DataFrame], k: int = TOP_K, n_candidates: int = 300, population: DataFrame | None = None) -> DataFrame:
    return top_k(score(_feature_rows(cat, as_of, n_candidates, population)), k)


def _feature_rows(cat: Catalog, as_of: date, n_candidates: int = 300, population: DataFrame | None = None) -> DataFrame:
    """All candidates of ``population``, by default of the buyers of the target week, with their features."""
    population = written(evaluation.eval_customers(cat, as_of), "predicted-population") if population is None else population
    wide = written(build_candidates(retrieve(cat, population, as_of), list(GENERATORS), n_candidates).drop("cand_rank"), "predicted-candidates")
    return features.downcast(features.assemble(wide, features.offline_sources(cat, as_of, population=population), cat))


def _places(scored: DataFrame, truth: DataFrame, sizes: list[int]) -> DataFrame:
    """trees, customer_key, article_id, pos: the places of the bought candidates in the order of ``top_k``, by
    each prefix. A place is one more than the customer's candidates before it, so nothing is sorted."""
    names = [f"_score_{n}" for n in sizes]
    bought = merged(scored, truth, ["customer_key", "article_id"], "left_semi").select("customer_key", F.col("article_id").alias("_bought"), *[F.col(c).alias(f"_b{c}") for c in names])
    pairs = merged(scored, bought, "customer_key")
    before = [F.count_if((F.col(c) > F.col(f"_b{c}")) | ((F.col(c) == F.col(f"_b{c}")) & (F.col("article_id") < F.col("_bought")))) for c in names]
    found = pairs.groupBy("customer_key", "_bought").agg(*[(n + 1).alias(c) for n, c in zip(before, names, strict=True)])
    places = F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("trees"), F.col(c).alias("pos")) for n, c in zip(sizes, names, strict=True)]))
    return found.select("customer_key", F.col("_bought").alias("article_id"), places.alias("p")).select("p.trees", "customer_key", "article_id", "p.pos")


def tree_sweep(cat: Catalog, ranker: PointwiseGbt, trained_on: date, select_on: date, sizes: list[int]) -> DataFrame:
    """trees, map, relative: model prefixes judged on a later week than any they learnt from."""
    if select_on <= trained_on:
        raise ValueError("trees have to be selected on a week after the training week")
    sizes = sorted(set(sizes))
    truth = written(evaluation.ground_truth(cat, select_on), "sweep-truth")
    # all candidates are scored by all prefixes in one pass, and the places of the bought ones found in another;
    # the driver has no room for a plan that holds the features and all trees
    scored = ranker.prefixes(written(_feature_rows(cat, select_on), "sweep-rows"), sizes)
    scored = written(scored.select("customer_key", "article_id", *[f"_score_{n}" for n in sizes]), "sweep-scores")
    preds = written(_places(scored, truth, sizes), "sweep-places")
    every = truth.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n).cast("long") for n in sizes])).alias("trees"))
    # a customer's list by one prefix is a list of its own
    own = F.struct("trees", "customer_key").alias("customer_key")
    aps = evaluation.average_precision(truth.join(F.broadcast(every)).select(own, "article_id"), preds.select(own, "article_id", "pos"))
    maps = aps.groupBy(F.col("customer_key.trees").alias("trees")).agg(F.round(F.avg("ap"), 9).alias("map"))
    table = written(every.join(maps, "trees", "left").fillna(0.0, ["map"]), "sweep")
    best = table.agg(F.max("map").alias("best"))
    return table.join(F.broadcast(best), F.lit(True)).select("trees", "map", (F.col("map") / F.nullif(F.col("best"), F.lit(0.0))).alias("relative"))
