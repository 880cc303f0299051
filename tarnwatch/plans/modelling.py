"""Queries on training, scoring, evaluation and explanation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwatch.functions import net
from tarnwatch.operators import models as M
from tarnwatch.plans.support import Book, rounded
from tarnwatch.plans.views import duck, predictions, traffic

book = Book()
add = book.add
COLUMNS = ["packet_size", "duration", "protocol_encoded", "destination_port", "k"]
CLASSES = ["dos", "normal", "other"]
SMALL = {"random_forest": {"numTrees": 10, "maxDepth": 5}, "boosted_trees": {"maxIter": 4, "maxDepth": 4},
         "svm": {"maxIter": 10}, "neural_network": {"maxIter": 20}}


def features_of(df):
    kind = F.expr("CASE WHEN attack_type IS NULL THEN 'normal' WHEN attack_type IN ('DoS', 'DDoS') THEN 'dos' ELSE 'other' END")
    t = df.withColumn("protocol_encoded", net.flow_protocol_code("protocol")).withColumn("kind", kind)
    return t.select("record_id", "ts", "kind", *[F.col(c).cast("double").alias(c) for c in COLUMNS])


def training_rows(s, d):
    return features_of(traffic(s, d))


def _trained(s, d):
    data = M.train_test_split([training_rows(s, d)], "record_id", 0.25)
    train, test = data.where("split = 'train'"), M.indexed(data.where("split = 'test'"), "kind", CLASSES)
    fitted = M.train_models(train, "kind", COLUMNS, classes=CLASSES, params=SMALL)
    out = None
    for name, model in fitted.items():
        part = M.classification_metrics(model.transform(test)).select(F.lit(name).alias("algorithm"), "accuracy", "f1_macro")
        out = part if out is None else out.unionByName(part)
    return rounded(out)


def _forest(s, d):
    return M.train_models(training_rows(s, d), "kind", COLUMNS, ["random_forest"], CLASSES, params=SMALL)["random_forest"]


def _scored(s, d):
    model = _forest(s, d)
    return M.score_batch(model, training_rows(s, d), CLASSES, "rf-2.0.0", importance=M.intrinsic_importance(model, COLUMNS)).select(
        "record_id", "is_malicious", "attack_type", "confidence_score", "model_version")


add("train_models", _trained)
add("tune_and_cross_validate", lambda s, d: M.tune_and_cross_validate(
    training_rows(s, d), "kind", COLUMNS, "random_forest", {"numTrees": [3, 6]}, "record_id", folds=2)[1])
add("score_batch", _scored)
add("intrinsic_importance", lambda s, d: s.createDataFrame(
    list(M.intrinsic_importance(_forest(s, d), COLUMNS).items()), "feature string, importance double"))
add("permutation_importance", lambda s, d: M.permutation_importance(
    _forest(s, d), M.indexed(training_rows(s, d), "kind", CLASSES), "label", COLUMNS, "record_id"))

# --- evaluation on given predictions -------------------------------------------------------------


def _graded(s, d):
    """True class against a prediction that errs where the record number says so."""
    truth = F.coalesce("attack_type", F.lit("normal"))
    said = F.when(F.col("k") % 7 == 0, F.lit("normal")).when(F.col("k") % 11 == 0, F.lit("DoS")).otherwise(truth)
    return traffic(s, d).select("record_id", truth.alias("label"), said.alias("prediction"), "confidence_score", "is_malicious")


_GR = """gr AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'normal' WHEN k % 11 = 0 THEN 'DoS' ELSE label END AS prediction FROM (SELECT *, coalesce(attack_type, 'normal') AS label FROM traffic)),
  cl AS (SELECT DISTINCT label AS c FROM gr), tt AS (SELECT count(*) AS n FROM gr),
  cm AS (SELECT c AS label, (SELECT count(*) FROM gr WHERE label = c AND prediction = c) AS tp, (SELECT count(*) FROM gr WHERE label <> c AND prediction = c) AS fp,
     (SELECT count(*) FROM gr WHERE label = c AND prediction <> c) AS fn, (SELECT count(*) FROM gr WHERE label <> c AND prediction <> c) AS tn FROM cl),
  me AS (SELECT *, tp + fn AS support, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END AS r,
     CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END AS f, tn / (tn + fp)::DOUBLE AS sp FROM cm)"""
add("confusion_matrix", lambda s, d: rounded(M.confusion_matrix(_graded(s, d))),
    duck("traffic", f"""WITH {_GR} SELECT label, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(sp, 6) AS specificity, round(f, 6) AS f1, support FROM me"""))
_MICRO = "round(sum(tp) / sum(support)::DOUBLE, 6)"
add("classification_metrics", lambda s, d: rounded(M.classification_metrics(_graded(s, d))),
    duck("traffic", f"""WITH {_GR} SELECT {_MICRO} AS accuracy, round(avg(p), 6) AS precision_macro, round(avg(r), 6) AS recall_macro, round(avg(f), 6) AS f1_macro,
      {_MICRO} AS precision_micro, {_MICRO} AS recall_micro, {_MICRO} AS f1_micro, round(sum(p * support) / sum(support)::DOUBLE, 6) AS precision_weighted,
      round(sum(r * support) / sum(support)::DOUBLE, 6) AS recall_weighted, round(sum(f * support) / sum(support)::DOUBLE, 6) AS f1_weighted FROM me"""))
add("classification_report", lambda s, d: rounded(M.classification_report(_graded(s, d))),
    duck("traffic", f"""WITH {_GR} SELECT label AS name, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM me
      UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(support)::BIGINT FROM me
      UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support)::DOUBLE, 6), round(sum(r * support) / sum(support)::DOUBLE, 6),
        round(sum(f * support) / sum(support)::DOUBLE, 6), sum(support)::BIGINT FROM me"""))


def _binary(s, d):
    return predictions(s, d).select(F.col("is_malicious").alias("label"), F.round(
        F.col("confidence_score") * F.when(F.col("is_malicious"), 1.0).otherwise(0.8), 6).alias("score"))


_ROC = """sc AS (SELECT is_malicious AS y, round(confidence_score * CASE WHEN is_malicious THEN 1.0 ELSE 0.8 END::DOUBLE, 6) AS s FROM predictions),
  ps AS (SELECT s, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n FROM sc GROUP BY 1),
  cu AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM ps WINDOW w AS (ORDER BY s DESC)),
  pt AS (SELECT s, cn / tn::DOUBLE AS fpr, cp / tp::DOUBLE AS tpr, cp / (cp + cn)::DOUBLE AS pre FROM cu),
  lg AS (SELECT *, coalesce(lag(fpr) OVER (ORDER BY s DESC), 0) AS lf, coalesce(lag(tpr) OVER (ORDER BY s DESC), 0) AS lt FROM pt)"""
add("roc_pr_curves",
    lambda s, d: rounded(M.roc_pr_points(_binary(s, d)).select("threshold", "fpr", "tpr", "precision", "recall")),
    duck("predictions", f"WITH {_ROC} SELECT s AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(pre, 6) AS precision, round(tpr, 6) AS recall FROM pt"))
add("roc_auc", lambda s, d: rounded(M.roc_pr_summary(M.roc_pr_points(_binary(s, d)))),
    duck("predictions", f"WITH {_ROC} SELECT round(sum((fpr - lf) * (tpr + lt) / 2), 6) AS auc, round(sum((tpr - lt) * pre), 6) AS average_precision FROM lg"))


def _multi(s, d):
    kind = F.expr("CASE WHEN attack_type IS NULL THEN 'normal' WHEN attack_type IN ('DoS', 'DDoS') THEN 'dos' ELSE 'other' END")
    k = F.col("k").cast("double")
    return traffic(s, d).select(kind.alias("label"), F.array(k / 100, F.col("destination_port") / 500.0, F.lit(1.0) - k / 200).alias("scores"))


add("roc_auc_one_vs_rest",
    lambda s, d: rounded(M.roc_pr_summary(M.roc_pr_points(M.one_vs_rest(_multi(s, d), CLASSES), ["cls"]), ["cls"])),
    duck("traffic", """WITH kd AS (SELECT CASE WHEN attack_type IS NULL THEN 'normal' WHEN attack_type IN ('DoS', 'DDoS') THEN 'dos' ELSE 'other' END AS y, k, destination_port FROM traffic),
      sc AS (SELECT unnest(['dos','normal','other']) AS cls, y, unnest([k::DOUBLE / 100, destination_port / 500.0::DOUBLE, 1.0 - k::DOUBLE / 200]) AS s FROM kd),
      ps AS (SELECT cls, s, count(*) FILTER (WHERE y = cls) AS p, count(*) FILTER (WHERE y <> cls) AS n FROM sc GROUP BY 1, 2),
      cu AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY cls) AS tp, sum(n) OVER (PARTITION BY cls) AS tn FROM ps WINDOW w AS (PARTITION BY cls ORDER BY s DESC)),
      pt AS (SELECT cls, s, cn / tn::DOUBLE AS fpr, cp / tp::DOUBLE AS tpr, cp / (cp + cn)::DOUBLE AS pre FROM cu),
      lg AS (SELECT *, coalesce(lag(fpr) OVER (PARTITION BY cls ORDER BY s DESC), 0) AS lf, coalesce(lag(tpr) OVER (PARTITION BY cls ORDER BY s DESC), 0) AS lt FROM pt)
      SELECT cls, round(sum((fpr - lf) * (tpr + lt) / 2), 6) AS auc, round(sum((tpr - lt) * pre), 6) AS average_precision FROM lg GROUP BY 1"""))


def _results(s, d):
    return predictions(s, d).groupBy(F.concat_ws("-", "model_version", F.pmod("record_id", F.lit(4)).cast("string")).alias("model_name")).agg(
        F.avg("confidence_score").alias("f1_macro"), F.avg("processing_time_ms").alias("inference_time"),
        F.count("*").cast("double").alias("memory_mb")).withColumn("error", F.when(F.col("model_name").endswith("-3"), "failed"))


add("compare_models", lambda s, d: rounded(M.compare_models(_results(s, d)).drop("error")),
    duck("predictions", """WITH r AS (SELECT model_version || '-' || record_id % 4 AS model_name, avg(confidence_score) AS f1_macro, avg(processing_time_ms) AS inference_time,
        count(*)::DOUBLE AS memory_mb FROM predictions GROUP BY 1), o AS (SELECT * FROM r WHERE model_name NOT LIKE '%-3')
      SELECT model_name, round(f1_macro, 6) AS f1_macro, round(inference_time, 6) AS inference_time, memory_mb,
        row_number() OVER (ORDER BY f1_macro DESC, inference_time, memory_mb, model_name)::INT AS rank, inference_time = min(inference_time) OVER () AS fastest,
        memory_mb = min(memory_mb) OVER () AS smallest FROM o"""))

# --- explanation over given importances -------------------------------------------------------------

FEATURES = ["packet_size", "duration", "port", "flags", "hour", "protocol"]


def _explained(s, d):
    value = {"packet_size": F.col("packet_size") / 10000, "duration": F.col("duration") / 5, "port": F.col("destination_port") / 500.0,
             "flags": F.length("flags_csv") / F.lit(20.0), "hour": F.hour("ts") / F.lit(24.0)}
    pairs = [x for n, v in value.items() for x in (F.lit(n), v)]
    with_protocol = F.create_map(*pairs, F.lit("protocol"), F.col("k") / F.lit(100.0))
    return traffic(s, d).select("record_id", "is_malicious", F.when(F.col("record_id") % 4 != 0, with_protocol).otherwise(
        F.create_map(*pairs)).alias("feature_importance"))


_EX = """ex AS (SELECT record_id, is_malicious, unnest(['packet_size','duration','port','flags','hour','protocol']) AS feature,
   unnest([packet_size / 10000.0::DOUBLE, duration / 5, destination_port / 500.0::DOUBLE, length(flags_csv) / 20.0::DOUBLE, hour(ts) / 24.0::DOUBLE,
     CASE WHEN record_id % 4 <> 0 THEN k / 100.0::DOUBLE END]) AS v FROM traffic), ev AS (SELECT * FROM ex WHERE v IS NOT NULL)"""
add("importance_from_predictions", lambda s, d: rounded(M.importance_from_predictions(_explained(s, d))),
    duck("traffic", f"""WITH {_EX} SELECT feature, round(avg(v), 6) AS importance, round(coalesce(avg(v) FILTER (WHERE is_malicious), 0), 6) AS malicious,
      round(coalesce(avg(v) FILTER (WHERE NOT is_malicious), 0), 6) AS benign, round(stddev_samp(v), 6) AS spread FROM ev GROUP BY 1"""))
add("importance_stability", lambda s, d: rounded(M.importance_stability(_explained(s, d), 4)),
    duck("traffic", f"WITH {_EX} SELECT feature, round(stddev_samp(v), 6) AS spread FROM ev GROUP BY 1 ORDER BY stddev_samp(v), feature LIMIT 4"))
add("importance_correlation", lambda s, d: rounded(M.importance_correlation(_explained(s, d), FEATURES)),
    duck("traffic", f"""WITH {_EX}, w AS (SELECT record_id, feature, coalesce(v, 0) AS v, list_position(['packet_size','duration','port','flags','hour','protocol'], feature) AS o FROM ex)
      SELECT a.feature AS a, b.feature AS b, round(corr(a.v, b.v), 6) AS correlation FROM w a JOIN w b ON a.record_id = b.record_id AND a.o < b.o GROUP BY 1, 2"""))


def _methods(s, d):
    """Mean importance per (method, feature): model version stands in for the method."""
    rows = M.importance_rows(_explained(s, d)).join(traffic(s, d).select("record_id", "protocol"), "record_id")
    return rows.groupBy(F.col("protocol").alias("method"), "feature").agg(F.avg("importance").alias("importance"))


_ME = f"{_EX}, mi AS (SELECT protocol AS method, feature, avg(v) AS x FROM ev JOIN traffic USING (record_id) GROUP BY 1, 2), mp AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY abs(x) DESC, feature) AS place FROM mi)"
_CI = f"""{_ME}, jn AS (SELECT a.method AS ma, b.method AS mb, a.x AS x, b.x AS y, a.place AS pa, b.place AS pb FROM mp a JOIN mp b ON a.feature = b.feature AND a.method < b.method),
  rk AS (SELECT *, rank() OVER (PARTITION BY ma, mb ORDER BY x) AS rx, rank() OVER (PARTITION BY ma, mb ORDER BY y) AS ry FROM jn),
  ci AS (SELECT ma AS method_a, mb AS method_b, corr(x, y) AS pearson, corr(rx, ry) AS spearman, count(*) FILTER (WHERE pa <= 3 AND pb <= 3) / 3.0::DOUBLE AS ov FROM rk GROUP BY 1, 2)"""
add("compare_importance", lambda s, d: rounded(M.compare_importance(_methods(s, d), 3)),
    duck("traffic", f"WITH {_CI} SELECT method_a, method_b, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(ov, 6) AS top_overlap FROM ci"))
add("importance_agreement", lambda s, d: rounded(M.agreement_advice(M.compare_importance(_methods(s, d), 3))),
    duck("traffic", f"""WITH {_CI} SELECT round(avg(ov), 6) AS agreement, CASE WHEN avg(ov) < 0.5 THEN 'Low agreement between analysis methods. Consider investigating feature stability.'
      WHEN avg(ov) > 0.8 THEN 'High agreement between analysis methods indicates robust feature importance.' END AS advice FROM ci"""))
add("importance_concentration", lambda s, d: rounded(M.importance_concentration(_methods(s, d))),
    duck("traffic", f"""WITH {_ME} SELECT method, round(sum(CASE WHEN place <= 5 THEN abs(x) ELSE 0 END) / sum(abs(x)), 6) AS concentration,
      sum(CASE WHEN place <= 5 THEN abs(x) ELSE 0 END) / sum(abs(x)) > 0.8 AS concentrated FROM mp WHERE place <= 10 GROUP BY 1"""))
add("train_test_split_counts",
    lambda s, d: M.train_test_split([training_rows(s, d).where("record_id % 2 = 0"), training_rows(s, d).where("record_id % 2 = 1")], "record_id")
    .groupBy("split").agg(F.count("*").alias("n")),
    duck("traffic", "SELECT 'test' AS split, round(count(*) * 0.2)::BIGINT AS n FROM traffic UNION ALL SELECT 'train', count(*) - round(count(*) * 0.2)::BIGINT FROM traffic"))

QUERIES, ORACLE = book.queries, book.oracle
