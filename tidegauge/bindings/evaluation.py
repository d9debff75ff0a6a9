"""I: classifier evaluation on scored rows derived from lineitem."""

from pyspark.sql import functions as F

from tidegauge.bindings.association import auc_sql
from tidegauge.bindings.common import CLASSES, LINES_SQL, lines
from tidegauge.bindings.registry import query
from tidegauge.operators import evaluation as I

# Three class weights per line, normalised to probabilities.
WEIGHTS = "l_quantity + 1 AS w0, l_extendedprice / 2000 + 1 AS w1, 300 * (l_discount + l_tax) + 1 AS w2"
SCORED_SQL = f"""SELECT cls AS y, cls3 AS pred, w0 / (w0 + w1 + w2) AS p0, w1 / (w0 + w1 + w2) AS p1, w2 / (w0 + w1 + w2) AS p2, y AS b
  FROM (SELECT *, CASE WHEN w0 >= w1 AND w0 >= w2 THEN 0 WHEN w1 >= w2 THEN 1 ELSE 2 END AS cls3 FROM (SELECT *, {WEIGHTS} FROM ({LINES_SQL})))"""


def scored(t):
    w0, w1, w2 = F.col("l_quantity") + 1, F.col("l_extendedprice") / 2000 + 1, F.lit(300) * (F.col("l_discount") + F.col("l_tax")) + 1
    s = w0 + w1 + w2
    # The class goes by the weights: after the division two different weights may be equal.
    df = I.argmax_class(lines(t).withColumn("_w", F.array(w0, w1, w2)), "_w", CLASSES, "pred")
    return df.select(F.col("cls").alias("y"), F.array(w0 / s, w1 / s, w2 / s).alias("p"), F.col("y").alias("b"), "pred")


def binary(t):
    return scored(t).select("b", F.col("p")[1].alias("score"), (F.col("p")[1] > 0.35).cast("int").alias("bhat"))


BINARY_SQL = f"SELECT b, p1 AS score, CAST(p1 > 0.35 AS INTEGER) AS bhat FROM ({SCORED_SQL})"
MATRIX_SQL = f"""SELECT a.c AS actual, p.c AS predicted, count(s.y) AS n FROM (VALUES (0), (1), (2)) AS a(c) CROSS JOIN (VALUES (0), (1), (2)) AS p(c)
  LEFT JOIN ({SCORED_SQL}) s ON s.y = a.c AND s.pred = p.c GROUP BY ALL"""
PER_CLASS_SQL = f"""SELECT class, coalesce(tp / nullif(CAST(pr AS DOUBLE), 0), 0) AS precision, coalesce(tp / nullif(CAST(ac AS DOUBLE), 0), 0) AS recall,
  coalesce(2 * tp / nullif(CAST(pr + ac AS DOUBLE), 0), 0) AS f1, ac AS support FROM (SELECT c AS class, CAST(sum(n) FILTER (actual = c AND predicted = c) AS BIGINT) AS tp,
  CAST(sum(n) FILTER (actual = c) AS BIGINT) AS ac, CAST(sum(n) FILTER (predicted = c) AS BIGINT) AS pr FROM ({MATRIX_SQL}), (VALUES (0), (1), (2)) AS k(c) GROUP BY c)"""


@query("i01_accuracy", f"SELECT avg(CAST(y = pred AS INTEGER)) AS accuracy FROM ({SCORED_SQL})", "accuracy")
def _(t):
    return I.accuracy(scored(t), "y", "pred")


@query("i02_confusion", MATRIX_SQL)
def _(t):
    return I.confusion(scored(t), "y", "pred", CLASSES)


BINARY_METRICS_SQL = f"""SELECT count(*) AS n, avg(CAST(b = bhat AS INTEGER)) AS accuracy,
  coalesce(count(*) FILTER (b = 1 AND bhat = 1) / nullif(CAST(count(*) FILTER (bhat = 1) AS DOUBLE), 0), 0) AS precision,
  coalesce(count(*) FILTER (b = 1 AND bhat = 1) / nullif(CAST(count(*) FILTER (b = 1) AS DOUBLE), 0), 0) AS recall,
  coalesce(2 * count(*) FILTER (b = 1 AND bhat = 1) / nullif(CAST(count(*) FILTER (b = 1) + count(*) FILTER (bhat = 1) AS DOUBLE), 0), 0) AS f1 FROM ({BINARY_SQL})"""


@query("i03_binary_metrics", BINARY_METRICS_SQL, "accuracy precision recall f1")
def _(t):
    return I.binary_metrics(binary(t), "b", "bhat")


@query("i04_roc_auc", f"SELECT auc AS roc_auc FROM ({auc_sql(f'(SELECT 1 AS one, * FROM ({BINARY_SQL}))', 'one', 'score', 'b = 1')})", "roc_auc")
def _(t):
    return I.roc_auc(binary(t), "b", "score")


def ap_sql(source: str, keys: str, score: str, positive: str) -> str:
    """Average precision: step sum over distinct thresholds, highest first."""
    return f"""SELECT {keys}, sum(p * tp / seen) / sum(p) AS ap FROM (SELECT *, sum(p) OVER (PARTITION BY {keys} ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp,
  sum(n) OVER (PARTITION BY {keys} ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS seen FROM (SELECT {keys}, {score} AS s, CAST(count(*) FILTER ({positive}) AS DOUBLE) AS p,
  CAST(count(*) AS DOUBLE) AS n FROM {source} GROUP BY ALL)) GROUP BY {keys}"""


@query("i05_average_precision", f"SELECT ap AS average_precision FROM ({ap_sql(f'(SELECT 1 AS one, * FROM ({BINARY_SQL}))', 'one', 'score', 'b = 1')})", "average_precision")
def _(t):
    return I.average_precision(binary(t), "b", "score")


@query("i03_binary_report", f"""SELECT m.*, a.auc AS roc_auc, p.ap AS average_precision FROM ({BINARY_METRICS_SQL}) m,
  ({auc_sql(f'(SELECT 1 AS one, * FROM ({BINARY_SQL}))', 'one', 'score', 'b = 1')}) a, ({ap_sql(f'(SELECT 1 AS one, * FROM ({BINARY_SQL}))', 'one', 'score', 'b = 1')}) p""",
       "accuracy precision recall f1 roc_auc average_precision")
def _(t):
    return I.binary_metrics(binary(t), "b", "bhat", "score")


MACRO_SQL = f"""SELECT (SELECT avg(CAST(y = pred AS INTEGER)) FROM ({SCORED_SQL})) AS accuracy, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM ({PER_CLASS_SQL})"""


@query("i06_macro_metrics", MACRO_SQL, "accuracy macro_precision macro_recall macro_f1")
def _(t):
    return I.macro_metrics(scored(t), "y", "pred", CLASSES)


OVR_SOURCE = f"(SELECT y, k.class, CASE k.class WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS s0 FROM ({SCORED_SQL}), (VALUES (0), (1), (2)) AS k(class))"
OVR_SQL = f"SELECT a.class, a.auc AS roc_auc, p.ap AS average_precision FROM ({auc_sql(OVR_SOURCE, 'class', 's0', 'y = class')}) a JOIN ({ap_sql(OVR_SOURCE, 'class', 's0', 'y = class')}) p USING (class)"


@query("i07_class_auc", OVR_SQL, "roc_auc average_precision")
def _(t):
    return I.class_auc(scored(t), "y", "p", CLASSES)


@query("i07_i12_macro_auc_ap", f"SELECT avg(roc_auc) AS macro_roc_auc, avg(average_precision) AS macro_average_precision FROM ({OVR_SQL})", "macro_roc_auc macro_average_precision")
def _(t):
    return I.macro_auc(scored(t), "y", "p", CLASSES)


@query("i07_missing_class", "SELECT CAST(NULL AS DOUBLE) AS macro_roc_auc, CAST(NULL AS DOUBLE) AS macro_average_precision WHERE (SELECT count(*) FROM lineitem) > 0")
def _(t):
    return I.macro_auc(scored(t).filter("y <> 2"), "y", "p", CLASSES)


@query("i08_class_report", f"""WITH c AS ({PER_CLASS_SQL}) SELECT CAST(class AS VARCHAR) AS label, precision, recall, f1, support FROM c
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM c
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM c""",
       "precision recall f1")
def _(t):
    return I.class_report(scored(t), "y", "pred", CLASSES)


LOSS_SQL = f"""SELECT avg(power(p0 - CAST(y = 0 AS INTEGER), 2) + power(p1 - CAST(y = 1 AS INTEGER), 2) + power(p2 - CAST(y = 2 AS INTEGER), 2)) AS brier_sum,
  -avg(ln(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)) AS log_loss FROM ({SCORED_SQL})"""


@query("i09_i10_probability_losses", LOSS_SQL, "brier_sum log_loss")
def _(t):
    return I.probability_losses(scored(t), "y", "p", CLASSES)


@query("i11_reliability", f"""SELECT b / 10 AS lower, (b + 1) / 10 AS upper, count(*) AS n, avg(c) AS mean_confidence, avg(CAST(y = pred AS INTEGER)) AS observed_accuracy
  FROM (SELECT y, pred, greatest(p0, p1, p2) AS c, CAST(len(list_filter([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[], lambda e: greatest(p0, p1, p2) >= e)) AS DOUBLE) AS b FROM ({SCORED_SQL}))
  GROUP BY b""", "lower upper mean_confidence observed_accuracy")
def _(t):
    return I.reliability(scored(t), "y", "p", CLASSES, yhat="pred")


@query("i13_argmax", f"SELECT y, pred, count(*) AS n FROM ({SCORED_SQL}) GROUP BY ALL")
def _(t):
    return scored(t).groupBy("y", "pred").agg(F.count("*").alias("n"))


@query("i14_evaluation", f"""SELECT (SELECT count(*) FROM lineitem) AS rows_evaluated, CAST(0 AS BIGINT) AS bad_probabilities, m.*, (SELECT avg(roc_auc) FROM ({OVR_SQL})) AS macro_roc_auc,
  (SELECT avg(average_precision) FROM ({OVR_SQL})) AS macro_average_precision, l.*, false AS independent_test FROM ({MACRO_SQL}) m, ({LOSS_SQL}) l""",
       "accuracy macro_precision macro_recall macro_f1 macro_roc_auc macro_average_precision brier_sum log_loss")
def _(t):
    return I.evaluate(scored(t), "y", "pred", "p", CLASSES)
