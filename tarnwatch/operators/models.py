"""Training, scoring, evaluation and explanation of classifiers on ``pyspark.ml``."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (GBTClassifier, LinearSVC, MultilayerPerceptronClassifier, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import Evaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.functions.columns import count_if, lookup, ratio, safe_corr
from tarnwatch.operators.quality import rank_in_class
from tarnwatch.operators.scan import running

ALGORITHMS = ["random_forest", "boosted_trees", "svm", "neural_network"]
#: Training rows of a cached partition at most; a file or two read as few partitions would train on few cores.
PART_ROWS = 250_000


# --- training -----------------------------------------------------------------------------

def estimator(algorithm: str, features: int, classes: int, seed: int = 42, **params) -> Estimator:
    """Classifier for an algorithm name; ``label`` and ``features`` are its input columns."""
    if algorithm == "random_forest":
        return RandomForestClassifier(seed=seed, **{"numTrees": 50, "maxDepth": 8, **params})
    if algorithm == "boosted_trees":
        trees = GBTClassifier(seed=seed, **{"maxIter": 20, **params})
        return trees if classes <= 2 else OneVsRest(classifier=trees)
    if algorithm == "svm":
        svm = LinearSVC(**{"maxIter": 50, "regParam": 0.01, **params})
        return svm if classes <= 2 else OneVsRest(classifier=svm)
    if algorithm == "neural_network":
        return MultilayerPerceptronClassifier(seed=seed, layers=[features, max(8, 2 * features), classes],
                                              **{"maxIter": 60, **params})
    raise ValueError(f"Unsupported algorithm: {algorithm}")


def label_index(df: DataFrame, label: str) -> list:
    """Distinct classes in order. Every model here holds a number of weights or leaves for each class, so the list is the lesser part of it."""
    return sorted(r[0] for r in df.select(label).distinct().collect())


def indexed(df: DataFrame, label: str, classes: list) -> DataFrame:
    return df.withColumn("label", lookup(F.col(label), {c: float(i) for i, c in enumerate(classes)}))


def model_pipeline(algorithm: str, columns: list[str], classes: int, seed: int = 42, **params) -> Pipeline:
    stages = [VectorAssembler(inputCols=columns, outputCol="raw_features", handleInvalid="error"),
              StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)]
    return Pipeline(stages=[*stages, estimator(algorithm, len(columns), classes, seed, **params)])


def spread_rows(df: DataFrame) -> DataFrame:
    """The same rows over enough partitions for ``PART_ROWS`` each; rows that have them already stay where they are."""
    parts = -(-df.count() // PART_ROWS)
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def train_models(df: DataFrame, label: str, columns: list[str], algorithms=None, classes: list | None = None,
                 seed: int = 42, params: dict | None = None) -> dict[str, PipelineModel]:
    """Fitted pipelines by algorithm name."""
    unknown = [a for a in algorithms or [] if a not in ALGORITHMS]
    if unknown:
        raise ValueError(f"Unsupported algorithm: {unknown[0]}")
    classes = classes or label_index(df, label)
    # every algorithm passes over the rows many times
    data = spread_rows(indexed(df, label, classes).select("label", *columns)).persist(StorageLevel.MEMORY_AND_DISK)
    fitted = {a: model_pipeline(a, columns, len(classes), seed, **(params or {}).get(a, {})).fit(data)
              for a in algorithms or ALGORITHMS}
    data.unpersist()
    return fitted


class MacroF1(Evaluator):
    """Macro-averaged F1 from confusion counts."""

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(classification_metrics(dataset).first()["f1_macro"])

    def isLargerBetter(self) -> bool:
        return True


def tune_and_cross_validate(df: DataFrame, label: str, columns: list[str], algorithm: str, grid: dict[str, list],
                            id_col: str, folds: int = 5, seed: int = 42) -> tuple[CrossValidatorModel, DataFrame]:
    """Grid search over repeatable folds; returns the fitted search and (params, accuracy and macro F1 mean and deviation)."""
    classes = label_index(df, label)
    fold = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(folds)).cast("int")
    data = indexed(df, label, classes).withColumn("fold", fold)
    pipeline = model_pipeline(algorithm, columns, len(classes), seed)
    classifier = pipeline.getStages()[-1]
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(classifier.getParam(name), values)
    maps = builder.build()
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    judges = {"accuracy": MulticlassClassificationEvaluator(metricName="accuracy"), "f1_macro": MacroF1()}
    found = {m: np.zeros((folds, len(maps))) for m in judges}
    for f in range(folds):  # every model is fitted once and judged by both measures
        rest, aside = data.where(F.col("fold") != f), data.where(F.col("fold") == f)
        for i, model in enumerate(pipeline.fit(rest, maps)):
            predicted = model.transform(aside)
            for m, judge in judges.items():
                found[m][f, i] = judge.evaluate(predicted)
    scores = {m: (x.mean(axis=0), x.std(axis=0)) for m, x in found.items()}
    best = int(np.argmax(scores["f1_macro"][0]))
    fitted = CrossValidatorModel(pipeline.fit(data, maps[best]), [float(x) for x in scores["f1_macro"][0]], [],
                                 [float(x) for x in scores["f1_macro"][1]])
    data.unpersist()
    rows = []
    for i, m in enumerate(maps):
        text = ", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda kv: kv[0].name))
        rows.append((text, *[float(scores[m][part][i]) for m in judges for part in (0, 1)]))
    table = df.sparkSession.createDataFrame(
        rows, "params string, accuracy_mean double, accuracy_std double, f1_macro_mean double, f1_macro_std double")
    return fitted, table


def class_scores(predicted: DataFrame) -> Column:
    """Array of per-class scores: probabilities where the model has them, else a softmax of raw scores."""
    if "probability" in predicted.columns:
        return vector_to_array("probability")
    raw = vector_to_array("rawPrediction")
    top = F.array_max(raw)
    powers = F.transform(raw, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def score_batch(model: Transformer, df: DataFrame, classes: list, version: str, benign: str = "normal",
                importance: dict[str, float] | None = None) -> DataFrame:
    """Prediction rows: is_malicious, attack_type, confidence, importance and model version."""
    out = model.transform(df)
    name = F.element_at(F.array(*map(F.lit, classes)), F.col("prediction").cast("int") + 1)
    weights = (F.create_map(*[F.lit(x) for pair in importance.items() for x in pair]) if importance
               else F.expr("CAST(map() AS map<string,double>)"))
    return out.select("record_id", "ts", (name != benign).alias("is_malicious"),
                      F.when(name != benign, name).alias("attack_type"),
                      F.array_max(class_scores(out)).alias("confidence_score"),
                      weights.alias("feature_importance"), F.lit(version).alias("model_version"))


# --- evaluation -------------------------------------------------------------------------------

def confusion_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class: tp, fp, fn, tn, precision, recall, specificity, f1 and support."""
    counts = confusion_counts(pred, label, prediction)
    same = F.col("label") == F.col("prediction")
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("label").alias("cls"), F.when(same, F.col("n")).otherwise(0).alias("tp"),
                 F.when(~same, F.col("n")).otherwise(0).alias("fn"), F.lit(0).cast("long").alias("fp"), F.col("n").alias("all")),
        F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fn"),
                 F.when(~same, F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("all")))).alias("s")).select("s.*")
    # the table has one row per class from here on
    per = sides.groupBy(F.col("cls").alias("label")).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "all")])
    total = F.sum("all").over(Window.partitionBy())
    per = per.withColumn("tn", total - F.col("tp") - F.col("fp") - F.col("fn"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return per.select("label", "tp", "fp", "fn", "tn", precision.alias("precision"), recall.alias("recall"),
                      ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"),
                      ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
                      F.col("all").alias("support"))


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy and macro, micro and weighted precision, recall and F1."""
    m = confusion_matrix(pred, label, prediction)
    names = ("precision", "recall", "f1")
    micro = ratio(F.sum("tp"), F.sum("support"))
    return m.agg(micro.alias("accuracy"), *[F.avg(c).alias(f"{c}_macro") for c in names],
                 *[micro.alias(f"{c}_micro") for c in names],
                 *[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"{c}_weighted") for c in names])


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class precision, recall, f1 and support, then macro and weighted averages."""
    m = confusion_matrix(pred, label, prediction)
    rows = m.select(F.col("label").cast("string").alias("name"), "precision", "recall", "f1", "support")
    macro = m.agg(F.lit("macro avg").alias("name"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")],
                  F.sum("support").alias("support"))
    weighted = m.agg(F.lit("weighted avg").alias("name"), *[
        ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in ("precision", "recall", "f1")],
        F.sum("support").alias("support"))
    return rows.unionByName(macro).unionByName(weighted)


def roc_pr_points(scored: DataFrame, keys: list[str] = [], label: str = "label", score: str = "score") -> DataFrame:
    """One row per distinct score (descending): cumulative counts, fpr, tpr, precision, recall.

    Rows are counted per score first; running counts are two-level over score ranges.
    """
    pos = F.col(label).cast("boolean")
    per = scored.groupBy(*keys, F.col(score).cast("double").alias("threshold")).agg(
        count_if(pos).alias("p"), count_if(~pos).alias("n")).withColumn("_o", -F.col("threshold"))
    run = running(per, keys, ["_o"], F.floor(F.col("_o") * 256).cast("long"),
                  {"cum_p": ("sum", F.col("p")), "cum_n": ("sum", F.col("n"))})
    totals = per.groupBy(*keys).agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    if keys:
        joined = run.join(totals, keys)
    else:
        t = totals.first()
        joined = run.withColumns({"positives": F.lit(t["positives"] or 0), "negatives": F.lit(t["negatives"] or 0)})
    return joined.select(*keys, "threshold", "p", "n", "cum_p", "cum_n", "positives", "negatives",
                         ratio(F.col("cum_n"), F.col("negatives")).alias("fpr"), ratio(F.col("cum_p"), F.col("positives")).alias("tpr"),
                         ratio(F.col("cum_p"), F.col("cum_p") + F.col("cum_n")).alias("precision"),
                         ratio(F.col("cum_p"), F.col("positives")).alias("recall"))


def roc_pr_summary(points: DataFrame, keys: list[str] = []) -> DataFrame:
    """Area under the ROC curve (trapezoid) and average precision per key."""
    strip = F.col("n") * (2.0 * F.col("cum_p") - F.col("p")) / 2
    return points.groupBy(*keys).agg(
        ratio(F.sum(strip), F.max("positives") * F.max("negatives").cast("double")).alias("auc"),
        ratio(F.sum(F.col("p") * F.col("precision")), F.max("positives")).alias("average_precision"))


def one_vs_rest(scored: DataFrame, classes: list, label: str = "label", scores: str = "scores") -> DataFrame:
    """Long form (class, label, score) of per-class score arrays, for multi-class curves."""
    parts = F.array(*[F.struct(F.lit(c).alias("cls"), (F.col(label) == c).alias("label"),
                               F.element_at(F.col(scores), i + 1).alias("score")) for i, c in enumerate(classes)])
    return scored.select(F.explode(parts).alias("r")).select("r.*")


def compare_models(results: DataFrame) -> DataFrame:
    """Models without an error, ranked by macro F1, then speed, then memory (one row per model)."""
    ok = results.where("error IS NULL")
    every = Window.partitionBy()
    best_first = every.orderBy(F.desc("f1_macro"), "inference_time", "memory_mb", "model_name")
    return ok.withColumns({
        "rank": F.row_number().over(best_first),
        "fastest": F.col("inference_time") == F.min("inference_time").over(every),
        "smallest": F.col("memory_mb") == F.min("memory_mb").over(every)})


def select_best(results: DataFrame) -> DataFrame:
    return compare_models(results).where("rank = 1")


# --- explanation --------------------------------------------------------------------------------

def intrinsic_importance(model: PipelineModel, columns: list[str]) -> dict[str, float]:
    """Importance the model itself exposes, scaled to sum to one."""
    last = model.stages[-1]
    parts = last.models if hasattr(last, "models") else [last]
    values = [0.0] * len(columns)
    for part in parts:
        if hasattr(part, "featureImportances"):
            weights = part.featureImportances.toArray()
        elif hasattr(part, "coefficientMatrix"):
            weights = abs(part.coefficientMatrix.toArray()).mean(axis=0)
        elif hasattr(part, "coefficients"):
            weights = abs(part.coefficients.toArray())
        else:
            raise ValueError("the model exposes no intrinsic importance")
        values = [v + float(w) for v, w in zip(values, weights)]
    total = sum(values) or 1.0
    return dict(zip(columns, (v / total for v in values)))


def permutation_importance(model: PipelineModel, df: DataFrame, label: str, columns: list[str], id_col: str,
                           sample: int | None = None, seed: int = 42) -> DataFrame:
    """(feature, importance): accuracy lost when one column is shuffled over all rows.

    All features are scored in one pass over the rows repeated once per feature. A
    caller may ask for a sample of rows (smallest hashes of the id) instead.
    """
    df = df if sample is None else df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(sample)
    ranked = rank_in_class(df.withColumn("_all", F.lit(0)), "_all", id_col, seed)
    base = ranked.select(id_col, label, "_rank", *columns)
    others = rank_in_class(base.withColumn("_all", F.lit(0)).drop("_rank"), "_all", id_col, seed + 1).select(
        F.col("_rank"), *[F.col(c).alias(f"_s_{c}") for c in columns])
    paired = base.join(others, "_rank")
    repeated = paired.withColumn("feature", F.explode(F.array(*map(F.lit, ["", *columns]))))
    swapped = repeated.withColumns({c: F.when(F.col("feature") == c, F.col(f"_s_{c}")).otherwise(F.col(c)) for c in columns})
    right = (model.transform(swapped).groupBy("feature")
             .agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy")))
    whole = F.max(F.when(F.col("feature") == "", F.col("accuracy"))).over(Window.partitionBy())
    return right.withColumn("importance", whole - F.col("accuracy")).where("feature <> ''").select("feature", "importance")


def compare_importance(importances: DataFrame, top: int = 10) -> DataFrame:
    """Agreement of every method pair over (method, feature, importance) rows.

    Inputs have one row per method and feature, so windows here are tiny.
    """
    strength = Window.partitionBy("method").orderBy(F.desc(F.abs("importance")), "feature")
    placed = importances.withColumn("place", F.row_number().over(strength))
    a = placed.select(F.col("method").alias("method_a"), "feature", F.col("importance").alias("x"), F.col("place").alias("pa"))
    b = placed.select(F.col("method").alias("method_b"), "feature", F.col("importance").alias("y"), F.col("place").alias("pb"))
    pairs = a.join(b, "feature").where("method_a < method_b")

    def mean_rank(c):
        part = Window.partitionBy("method_a", "method_b")
        ties = F.count("*").over(Window.partitionBy("method_a", "method_b", c))
        return F.rank().over(part.orderBy(c)) + (ties - 1) / 2

    ranked = pairs.withColumns({"rx": mean_rank("x"), "ry": mean_rank("y")})
    return ranked.groupBy("method_a", "method_b").agg(
        safe_corr("x", "y").alias("pearson"), safe_corr("rx", "ry").alias("spearman"),
        (count_if((F.col("pa") <= top) & (F.col("pb") <= top)) / float(top)).alias("top_overlap"))


def importance_concentration(importances: DataFrame, top: int = 10) -> DataFrame:
    """(method, concentration, concentrated): share of the top five within the top features."""
    place = F.row_number().over(Window.partitionBy("method").orderBy(F.desc(F.abs("importance")), "feature"))
    size = F.abs("importance")
    return (importances.withColumn("place", place).where(F.col("place") <= top).groupBy("method")
            .agg(ratio(F.sum(F.when(F.col("place") <= 5, size).otherwise(0.0)), F.sum(size)).alias("concentration"))
            .withColumn("concentrated", F.col("concentration") > 0.8))


def agreement_advice(comparison: DataFrame) -> DataFrame:
    """One row: mean top-feature overlap and what it suggests."""
    mean = F.avg("top_overlap")
    # fixed values: limits and texts
    return comparison.agg(mean.alias("agreement"), F.when(
        mean < 0.5, "Low agreement between analysis methods. Consider investigating feature stability.").when(
        mean > 0.8, "High agreement between analysis methods indicates robust feature importance.").alias("advice"))


def importance_rows(predictions: DataFrame) -> DataFrame:
    return predictions.select("record_id", "is_malicious", F.explode("feature_importance").alias("feature", "importance"))


def importance_from_predictions(predictions: DataFrame, top: int = 15) -> DataFrame:
    """Mean importance per feature, overall and by class, with its spread; most important first."""
    v = F.col("importance")
    return importance_rows(predictions).groupBy("feature").agg(
        F.avg(v).alias("importance"), F.coalesce(F.avg(F.when(F.col("is_malicious"), v)), F.lit(0.0)).alias("malicious"),
        F.coalesce(F.avg(F.when(~F.col("is_malicious"), v)), F.lit(0.0)).alias("benign"),
        F.stddev_samp(v).alias("spread")).orderBy(F.desc("importance"), "feature").limit(top)


def importance_stability(predictions: DataFrame, top: int = 10) -> DataFrame:
    return importance_rows(predictions).groupBy("feature").agg(F.stddev_samp("importance").alias("spread")).orderBy(
        "spread", "feature").limit(top)


def importance_correlation(predictions: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, correlation) between the importances of the given features; a missing entry counts as 0."""
    wide = predictions.select(*[F.coalesce(F.try_element_at("feature_importance", F.lit(f)), F.lit(0.0)).alias(f"f{i}")
                                for i, f in enumerate(features)])
    pairs = list(itertools.combinations(range(len(features)), 2))
    row = wide.agg(*[safe_corr(f"f{i}", f"f{j}").alias(f"r{n}") for n, (i, j) in enumerate(pairs)])
    entries = F.array(*[F.struct(F.lit(features[i]).alias("a"), F.lit(features[j]).alias("b"),
                                 F.col(f"r{n}").alias("correlation")) for n, (i, j) in enumerate(pairs)])
    return row.select(F.explode(entries).alias("e")).select("e.*")


def train_test_split(sources: list[DataFrame], id_col: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Concatenated sources with ``split`` = train / test; the number of test rows is exact."""
    both = sources[0]
    for df in sources[1:]:
        both = both.unionByName(df, allowMissingColumns=True)
    wanted = round(both.count() * test_share)
    ranked = rank_in_class(both.withColumn("_all", F.lit(0)), "_all", id_col, seed)
    return ranked.withColumn("split", F.when(F.col("_rank") <= wanted, "test").otherwise("train")).drop("_rank", "_all")
