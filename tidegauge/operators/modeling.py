"""Preprocessing, candidate classifiers, stratified cross-validation and importances on Spark ML."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import expr as X
from tidegauge.functions.expr import col, cols, to_long
from tidegauge.functions.frames import attach
from tidegauge.functions.ordering import number_by_hash, quantiles
from tidegauge.operators.evaluation import argmax_class, macro_auc, macro_metrics
from tidegauge.session import cut_lineage, together

SEED = 42
FOLDS = 5
PREFIX = "x_"
#: Rows of a task in boosting: a round is a job for each level, which over fewer rows is little but the start of its tasks.
TASK_ROWS = 1 << 15
METRICS = ("accuracy", "macro_precision", "macro_recall", "macro_f1", "macro_roc_auc")


def preprocessing_stats(train: DataFrame, features, keys=()) -> DataFrame:
    """keys, feature, median, mean, sd: exact medians, then mean and population sd after imputing them."""
    features = list(features)
    medians = quantiles(to_long(train, features, keys), [*keys, "feature"], "value", [0.5]).select(*cols(keys), "feature", F.col("q")[0].alias("_median"))
    # One row per key, so that the moments of all features come from one scan without a row per feature.
    medians = medians.groupBy(*cols(keys)).agg(*[F.max(F.when(F.col("feature") == f, F.col("_median"))).alias(f"_m{i}") for i, f in enumerate(features)])
    rows = train.select(*cols(keys), *[col(f).cast("double").alias(f"_v{i}") for i, f in enumerate(features)])
    rows = rows.join(F.broadcast(medians), list(keys)) if keys else attach(rows, medians)
    filled = [F.coalesce(f"_v{i}", f"_m{i}") for i in range(len(features))]
    found = F.array(*[F.struct(F.lit(f).alias("feature"), F.max(f"_m{i}").alias("median"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"))
                      for i, (f, v) in enumerate(zip(features, filled))])
    return rows.groupBy(*cols(keys)).agg(found.alias("_found")).select(*cols(keys), F.inline("_found")).filter("median IS NOT NULL")


def _stats(rows, features) -> dict[str, tuple[float, float, float]]:
    found = {r["feature"]: (r["median"], r["mean"], r["sd"]) for r in rows}
    if not features:
        raise ValueError("a model needs at least one feature column of numbers")
    return {f: found[f] for f in features}


def _fitted(train: DataFrame, features) -> dict[str, tuple[float, float, float]]:
    return _stats(preprocessing_stats(train, features).collect(), features)


@dataclass(frozen=True)
class Basics:
    """What all models of the same training rows share: median, mean and sd of each feature, and the rows of each class."""

    stats: dict[str, tuple[float, float, float]]
    counts: dict

    def weights(self) -> dict:
        """class: n_total / (n_classes * n)."""
        return {c: sum(self.counts.values()) / (len(self.counts) * n) for c, n in self.counts.items()}


def _class_counts(df: DataFrame, label: str, keys=()) -> DataFrame:
    return df.groupBy(*cols(keys), col(label).cast("int").alias("class")).agg(F.count("*").alias("n")).filter("class IS NOT NULL")


def basics(train: DataFrame, features, label: str) -> Basics:
    """The numbers that models of one training table share, found once for all of them."""
    known = train.filter(col(label).cast("int").isNotNull())
    return Basics(_fitted(known, features), {r["class"]: r["n"] for r in _class_counts(train, label).collect()})


def basics_without_fold(data: DataFrame, features, label: str, folds: int) -> dict[int, Basics]:
    """For each fold the numbers of the rows outside it; one set of passes for all folds."""
    without = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda i: i != F.col("fold"))).alias("_without")
    rows = data.filter(col(label).cast("int").isNotNull()).select(*cols(features), without)
    stats = preprocessing_stats(rows, features, ["_without"]).collect()
    counts = _class_counts(data, label, ["fold"]).collect()
    out = {}
    for i in range(folds):
        n: dict = {}
        for r in counts:
            if r["fold"] != i:
                n[r["class"]] = n.get(r["class"], 0) + r["n"]
        out[i] = Basics(_stats([r for r in stats if r["_without"] == i], features), n)
    return out


def _all_features(cands, features) -> list[str]:
    return list(dict.fromkeys([*features, *(f for c in cands for f in c.features)]))


def prepared(name: str, stats: tuple[float, float, float], scale: bool) -> str:
    """SQL text that imputes (and standardises) one feature with fitted numbers."""
    median, mean, sd = stats
    quoted = "`" + name.replace("`", "``") + "`"
    filled = f"coalesce(CAST({quoted} AS DOUBLE), {median!r}D)"
    return f"({filled} - {mean!r}D) / {(sd or 1.0)!r}D" if scale else filled


def preprocessor(stats: dict[str, tuple[float, float, float]], features, scale: bool) -> list:
    """Stages of fitted numbers: median imputation, optional standardising, and one vector in feature order."""
    exprs = ", ".join(f"{prepared(f, s, scale)} AS `{PREFIX}{f}`" for f, s in ((f, stats[f]) for f in features))
    return [SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__"),
            VectorAssembler(inputCols=[PREFIX + f for f in features], outputCol="_features")]


def preprocess(df: DataFrame, train: DataFrame, features, scale: bool = True) -> DataFrame:
    """The features imputed (and standardised) with numbers fitted on `train`."""
    stats = _fitted(train, features)
    return df.withColumns({f: F.expr(prepared(f, s, scale)) for f, s in stats.items()})


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """class, n, weight = n_total / (n_classes * n)."""
    counts = df.groupBy(col(label).alias("class")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"), F.count("*").alias("_k"))
    return attach(counts, total).select("class", "n", (F.col("_t") / (F.col("_k") * F.col("n"))).alias("weight"))


def with_weights(df: DataFrame, label: str, weights: DataFrame, out: str = "_weight") -> DataFrame:
    """Adds the balanced weight of each row's class; one number per class becomes a literal."""
    return _weighted(df, label, {r["class"]: r["weight"] for r in weights.collect()}, out)


def _weighted(df: DataFrame, label: str, known: dict, out: str = "_weight") -> DataFrame:
    return df.withColumn(out, F.element_at(F.create_map(*[F.lit(x) for p in known.items() for x in p]), col(label)))


def majority_scores(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """test with yhat = the most frequent training class (the smallest on a tie) and its constant 0/1 score for class 1."""
    top = train.groupBy(col(label).alias("c")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "c").limit(1)
    out = attach(test, top.select(F.col("c").alias("yhat")))
    return out.withColumn("score", (F.col("yhat") == 1).cast("double"))


@dataclass(frozen=True)
class Candidate:
    """One fixed configuration: kind, whether inputs are standardised, estimator settings, and its own
    features where it does not take all of them."""

    name: str
    kind: str
    scale: bool = False
    balanced: bool = True
    settings: dict = field(default_factory=dict)
    features: tuple = ()


def candidates(trees: int = 200, depth: int = 20, rounds: int = 150) -> list[Candidate]:
    """The three compared configurations, none of them tuned."""
    return [
        Candidate("logistic_regression", "logistic", scale=True, settings={"maxIter": 2000}),
        Candidate("random_forest", "forest", settings={"numTrees": trees, "maxDepth": depth}),
        Candidate("gradient_boosting", "boosting", balanced=False, settings={"maxIter": rounds, "maxDepth": 5, "stepSize": 0.1}),
    ]


def _estimator(c: Candidate, label: str, weight_total: float):
    base = {"featuresCol": "_features", "labelCol": label, **c.settings}
    if c.balanced:
        base["weightCol"] = "_weight"
    if c.kind == "logistic":
        # The penalty 1/sum(weights) on an averaged loss equals a unit penalty on a summed loss.
        return LogisticRegression(regParam=1.0 / weight_total, standardization=False, **base)
    if c.kind == "forest":
        return RandomForestClassifier(seed=SEED, **base)
    if c.kind == "tree":
        return DecisionTreeClassifier(seed=SEED, **base)
    raise ValueError(f"Unknown kind: {c.kind}")


def fit(c: Candidate, train: DataFrame, features, label: str, codes, shared: Basics | None = None) -> PipelineModel:
    """Every learned number comes from `train`; its rows must carry all classes 0..k-1. `shared` is what basics() found for these rows."""
    features = list(c.features or features)
    # Every fit reads its rows several times.
    data = train.select(*cols(features), col(label).cast("int").alias(label)).filter(col(label).isNotNull()).persist()
    try:
        shared = shared or basics(data, features, label)
        stages = preprocessor(shared.stats, features, c.scale)
        if c.kind != "boosting":
            rows = _weighted(data, label, shared.weights()) if c.balanced else data
            # Balanced weights add up to the row count.
            return Pipeline(stages=[*stages, _estimator(c, label, float(sum(shared.counts.values())))]).fit(rows)
        ready = Pipeline(stages=stages).fit(data)
        vectors = ready.transform(data).select("_features", label).coalesce(max(1, -(-sum(shared.counts.values()) // TASK_ROWS)))

        def boost(code):
            one = GBTClassifier(featuresCol="_features", labelCol="_one", predictionCol=f"_pred_{code}", seed=SEED, **c.settings)
            one = one.setProbabilityCol(f"_prob_{code}").setRawPredictionCol(f"_raw_{code}")
            return one.fit(vectors.withColumn("_one", (col(label) == code).cast("double")))

        return PipelineModel(stages=[*ready.stages, *together(train.sparkSession, [partial(boost, code) for code in codes])])
    finally:
        data.unpersist()


def probabilities(df: DataFrame, model: PipelineModel, codes, out: str = "p") -> DataFrame:
    """The input columns plus one probability array in class order."""
    scored = model.transform(df)
    if "probability" in scored.columns:
        p = vector_to_array("probability")
    else:
        raw = F.array(*[vector_to_array(f"_prob_{c}")[1] for c in codes])
        total = F.aggregate(raw, F.lit(0.0), lambda s, v: s + v)
        p = F.transform(raw, lambda v: X.ratio0(v, total))
    return scored.withColumn(out, p).select(*cols(df.columns), out)


def with_folds(df: DataFrame, label: str, key: str, folds: int = FOLDS, seed: int = SEED, out: str = "fold") -> DataFrame:
    """Stratified, shuffled fold numbers 0..folds-1, the same ones every time."""
    data = df.withColumn("_h", F.concat(X.hash_order(col(key), seed), F.lit("-"), col(key).cast("string")))
    return number_by_hash(data, [label], "_h", "_r").withColumn(out, ((F.col("_r") - 1) % folds).cast("int")).drop("_h", "_r")


def cross_validate(df: DataFrame, cands, features, label: str, key: str, codes, folds: int = FOLDS, parallel: int = 4) -> DataFrame:
    """candidate, position, fold and the metrics of every fold.

    Models are fitted from a few driver threads so that short fits share the cluster;
    fold scores of all candidates are evaluated together as one keyed table.
    """
    features = list(features)
    every = _all_features(cands, features)
    data = with_folds(df.select(*cols(every), col(label).cast("int").alias(label), col(key)), label, key, folds).persist()
    smallest = data.groupBy(col(label)).count().agg(F.min("count"), F.count("*")).first()
    if smallest[0] is None or smallest[0] < folds or smallest[1] != len(list(codes)):
        raise ValueError(f"Cross-validation needs all classes and at least {folds} rows per class")

    shared = basics_without_fold(data, every, label, folds)

    def score(position, c, i) -> DataFrame:
        model = fit(c, data.filter(F.col("fold") != i), features, label, codes, shared[i])
        return probabilities(data.filter(F.col("fold") == i), model, codes).select(
            F.lit(c.name).alias("candidate"), F.lit(position).alias("position"), F.lit(i).alias("fold"), col(label).alias("_y"), "p")

    tasks = [partial(score, position, c, i) for position, c in enumerate(cands) for i in range(folds)]
    scored = reduce(DataFrame.unionByName, together(df.sparkSession, tasks, parallel))
    # Scored once, then read by every metric; the written copy outlives any executor.
    scored = cut_lineage(argmax_class(scored, "p", codes, "_yhat"))
    data.unpersist()
    keys = ["candidate", "position", "fold"]
    return macro_metrics(scored, "_y", "_yhat", codes, keys).join(
        macro_auc(scored, "_y", "p", codes, keys).drop("macro_average_precision"), keys)


def cv_summary(folds: DataFrame, metrics=METRICS) -> DataFrame:
    """candidate, position, and mean and population sd of each metric over the folds."""
    return folds.groupBy("candidate", "position").agg(
        *[e for m in metrics for e in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_sd"))])


def select_best(summary: DataFrame, metric: str = "macro_f1_mean", among=None) -> DataFrame:
    """The candidate with the highest mean score, the earlier one on a tie."""
    rows = summary if among is None else summary.filter(F.col("candidate").isin(list(among)))
    return rows.orderBy(F.col(metric).desc(), "position").limit(1).select("candidate", F.col(metric).alias("score"))


def fit_and_score(cands, train: DataFrame, test: DataFrame, features, label: str, codes):
    """Fit every candidate on all of train; returns models and one scored test table keyed by candidate."""
    scored, shared = None, basics(train, _all_features(cands, features), label)
    fitted = together(train.sparkSession, [partial(fit, c, train, features, label, codes, shared) for c in cands])
    models = {c.name: model for c, model in zip(cands, fitted)}
    for c in cands:
        part = probabilities(test, models[c.name], codes).withColumn("candidate", F.lit(c.name))
        scored = part if scored is None else scored.unionByName(part)
    return models, scored


def permuted_rows(df: DataFrame, key: str, features, repeats: int = 10, seed: int = SEED) -> DataFrame:
    """(rep, feature) copies of the rows in which that feature's values are shuffled.

    Row number n by key takes the value of row number n by hash. Both numberings and
    the join are keyed by (rep, number), so no group is larger than one row pair.
    """
    features = list(features)
    base = number_by_hash(df.withColumn("_k", X.hash_order(col(key), "base")), [], "_k", "_n").drop("_k")
    reps = df.select(*cols(features), col(key).alias("_key"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep"))
    reps = reps.withColumn("_h", X.hash_order(F.concat_ws("-", F.col("_key").cast("string"), F.col("rep").cast("string")), seed))
    donors = number_by_hash(reps, ["rep"], "_h", "_n").select("rep", "_n", *[col(f).alias(f"_new_{f}") for f in features])
    joined = base.join(donors, "_n")
    kept = [c for c in base.columns if c not in (*features, "_n")]
    copies = F.array(*[F.struct(F.lit(f).alias("permuted"), *[col(f"_new_{g}" if g == f else g).alias(g) for g in features]) for f in features])
    return joined.select(*cols(kept), "rep", F.inline(copies))


def permutation_importance(model: PipelineModel, validation: DataFrame, features, label: str, key: str, codes,
                           repeats: int = 10, seed: int = SEED) -> DataFrame:
    """feature, drop_mean, drop_sd of macro F1. All copies are scored and counted in one job."""
    def f1(df: DataFrame, keys) -> DataFrame:
        scored = argmax_class(probabilities(df, model, codes), "p", codes, "_yhat")
        return macro_metrics(scored, label, "_yhat", codes, keys).select(*cols(keys), "macro_f1")

    base = f1(validation, []).withColumnRenamed("macro_f1", "_base")
    rows = attach(f1(permuted_rows(validation, key, features, repeats, seed), ["permuted", "rep"]), base)
    drop = F.col("_base") - F.col("macro_f1")
    return rows.groupBy(F.col("permuted").alias("feature")).agg(F.avg(drop).alias("drop_mean"), F.stddev_pop(drop).alias("drop_sd"))


def impurity_importance(model: PipelineModel, spark, features) -> DataFrame:
    """feature, importance of a fitted tree or forest."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, values)), "feature string, importance double")
