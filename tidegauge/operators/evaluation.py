"""Classifier evaluation from scored rows: y, yhat and a probability array in class order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import expr as X
from tidegauge.functions.expr import col, cols
from tidegauge.functions.frames import attach, grid, zero_fill
from tidegauge.functions.ordering import prefix_sums
from tidegauge.operators.contracts import bad_probabilities

RELIABILITY_BINS = 10
LOG_CLIP = 2.220446049250313e-16  # spacing of doubles at 1


def accuracy(df: DataFrame, y: str, yhat: str, keys=()) -> DataFrame:
    return df.groupBy(*cols(keys)).agg(F.avg((col(y) == col(yhat)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, y: str, yhat: str, codes, keys=()) -> DataFrame:
    """actual, predicted, n; zero-filled over the codebook when there are no extra keys."""
    counts = df.groupBy(*cols(keys), col(y).alias("actual"), col(yhat).alias("predicted")).agg(F.count("*").alias("n"))
    if keys:
        return counts
    frame = grid(df.sparkSession, actual=list(codes), predicted=list(codes))
    return zero_fill(counts, frame, ["actual", "predicted"], ["n"])


def _f1(tp: Column, actual: Column, predicted: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 from counts; 0 where a divisor is 0."""
    return X.ratio0(tp, predicted), X.ratio0(tp, actual), X.ratio0(2 * tp, actual + predicted)


def class_scores(matrix: DataFrame, codes, keys=()) -> DataFrame:
    """keys, class, precision, recall, f1, support from a confusion table."""
    per = matrix.groupBy(*cols(keys)).agg(F.array(*[F.struct(
        F.lit(c).alias("class"),
        F.sum(F.when((F.col("actual") == c) & (F.col("predicted") == c), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("actual") == c, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("predicted") == c, F.col("n")).otherwise(0)).alias("predicted")) for c in codes]).alias("r"))
    per = per.select(*cols(keys), F.inline("r"))
    precision, recall, f1 = _f1(F.col("tp"), F.col("support"), F.col("predicted"))
    return per.select(*cols(keys), "class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def binary_metrics(df: DataFrame, y: str, yhat: str, score: str | None = None, keys=()) -> DataFrame:
    """keys, n, accuracy, precision, recall, f1 of class 1, and with a score roc_auc and average_precision."""
    def count(test):
        return F.count_if(test)

    tp, pos, pred = count((col(y) == 1) & (col(yhat) == 1)), count(col(y) == 1), count(col(yhat) == 1)
    t = df.groupBy(*cols(keys)).agg(F.count("*").alias("n"), F.avg((col(y) == col(yhat)).cast("double")).alias("accuracy"),
                                    tp.alias("_tp"), pos.alias("_pos"), pred.alias("_pred"))
    precision, recall, f1 = _f1(F.col("_tp"), F.col("_pos"), F.col("_pred"))
    out = t.select(*cols(keys), "n", "accuracy", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))
    if score is None:
        return out
    curve = score_metrics(df.select(*cols(keys), F.lit(1).alias("_one"), (col(y) == 1).cast("int").alias("_y"), col(score).alias("_s")),
                          [*keys, "_one"], "_y", "_s").drop("_one")
    return out.join(curve, list(keys), "left") if keys else attach(out, curve)


def score_tally(df: DataFrame, keys, score: str, positives: dict[str, Column]) -> DataFrame:
    """Per distinct score: total rows and positives of each named target."""
    agg = [F.count("*").alias("_all"), *[F.sum(c.cast("int")).cast("bigint").alias(n) for n, c in positives.items()]]
    return df.filter(col(score).isNotNull()).groupBy(*cols(keys), col(score).alias("_score")).agg(*agg)


def auc_from_tally(tally: DataFrame, keys, positives) -> DataFrame:
    """keys, one column per positive name: area under the ROC curve, ties counted half; null for one class only."""
    run = prefix_sums(tally, keys, "_score", ["_all", *positives])
    parts = []
    for n in positives:
        below = F.col("below__all") - F.col(f"below_{n}")
        same = F.col("_all") - F.col(n)
        parts += [F.sum(F.col(n) * (below + 0.5 * same)).alias(f"_a_{n}"), F.sum(F.col(n)).alias(f"_p_{n}")]
    t = run.groupBy(*cols(keys)).agg(F.sum("_all").alias("_t"), *parts)
    return t.select(*cols(keys), *[X.ratio(F.col(f"_a_{n}"), F.col(f"_p_{n}").cast("double") * (F.col("_t") - F.col(f"_p_{n}"))).alias(n)
                                   for n in positives])


def score_metrics(df: DataFrame, keys, y: str, score: str) -> DataFrame:
    """keys, roc_auc, average_precision of a 0/1 target.

    Both come from one ascending pass over the distinct scores: what lies at or
    above a threshold is the key's total less what lies below it. Average precision
    is the step sum over distinct thresholds from the highest. Undefined is null.
    """
    tally = score_tally(df, keys, score, {"_pos": col(y) == 1})
    # The totals come with the prefix sums, so that the rows are scanned and counted once.
    run = prefix_sums(tally, keys, "_score", ["_all", "_pos"])
    p, below = F.col("_pos"), F.col("below__all") - F.col("below__pos")
    step = p * (F.col("total__pos") - F.col("below__pos")) / (F.col("total__all") - F.col("below__all"))
    t = run.groupBy(*cols(keys)).agg(F.max("total__all").alias("_t"), F.max("total__pos").alias("_p"), F.sum(step).alias("_s"),
                                     F.sum(p * (below + 0.5 * (F.col("_all") - p))).alias("_a"))
    return t.select(*cols(keys), X.ratio(F.col("_a"), F.col("_p").cast("double") * (F.col("_t") - F.col("_p"))).alias("roc_auc"),
                    X.ratio(F.col("_s"), F.col("_p")).alias("average_precision"))


def _single(df: DataFrame, y: str, score: str) -> DataFrame:
    rows = df.select(F.lit(1).alias("_one"), (col(y) == 1).cast("int").alias("_y"), col(score).alias("_s"))
    return score_metrics(rows, ["_one"], "_y", "_s")


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    return _single(df, y, score).select("roc_auc")


def average_precision(df: DataFrame, y: str, score: str) -> DataFrame:
    return _single(df, y, score).select("average_precision")


def macro_metrics(df: DataFrame, y: str, yhat: str, codes, keys=()) -> DataFrame:
    """keys, accuracy and macro precision, recall, F1 over all listed classes."""
    matrix = confusion(df, y, yhat, codes, keys)
    hits = matrix.groupBy(*cols(keys)).agg(
        X.ratio(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
    macro = class_scores(matrix, codes, keys).groupBy(*cols(keys)).agg(
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")])
    return hits.join(macro, list(keys)) if keys else attach(hits, macro)


def class_report(df: DataFrame, y: str, yhat: str, codes, keys=()) -> DataFrame:
    """keys, label, precision, recall, f1, support per class, then macro and weighted averages."""
    per = class_scores(confusion(df, y, yhat, codes, keys), codes, keys)
    rows = per.select(*cols(keys), F.col("class").cast("string").alias("label"), "precision", "recall", "f1", "support")
    measures, grouped = ("precision", "recall", "f1"), per.groupBy(*cols(keys))
    macro = grouped.agg(F.lit("macro avg").alias("label"), *[F.avg(m).alias(m) for m in measures], F.sum("support").alias("support"))
    weighted = grouped.agg(F.lit("weighted avg").alias("label"),
                           *[X.ratio0(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in measures],
                           F.sum("support").alias("support"))
    return rows.unionByName(macro).unionByName(weighted)


def _per_class(df: DataFrame, y: str, p: str, codes, keys) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("class"), col(p)[i].alias("_s"), (col(y) == c).cast("int").alias("_y"))
                      for i, c in enumerate(codes)])
    return df.select(*cols(keys), F.inline(cells))


def class_auc(df: DataFrame, y: str, p: str, codes, keys=()) -> DataFrame:
    """keys, class, roc_auc, average_precision one-vs-rest."""
    return score_metrics(_per_class(df, y, p, codes, keys), [*keys, "class"], "_y", "_s")


def macro_auc(df: DataFrame, y: str, p: str, codes, keys=()) -> DataFrame:
    """keys, macro_roc_auc, macro_average_precision; null if a class is missing in y."""
    per = class_auc(df, y, p, codes, keys)
    whole = F.count("roc_auc") == len(codes)
    return per.groupBy(*cols(keys)).agg(F.when(whole, F.avg("roc_auc")).alias("macro_roc_auc"),
                                        F.when(whole, F.avg("average_precision")).alias("macro_average_precision"))


def probability_losses(df: DataFrame, y: str, p: str, codes) -> DataFrame:
    """One row: multiclass Brier sum (over classes, not divided) and log loss."""
    codes = list(codes)
    brier = sum(((col(p)[i] - (col(y) == c).cast("double")) * (col(p)[i] - (col(y) == c).cast("double"))
                 for i, c in enumerate(codes)), F.lit(0.0))
    own = reduce(lambda acc, ic: F.when(col(y) == ic[1], col(p)[ic[0]]).otherwise(acc), enumerate(codes), F.lit(None).cast("double"))
    clipped = F.least(F.lit(1.0 - LOG_CLIP), F.greatest(F.lit(LOG_CLIP), own))
    return df.agg(F.avg(brier).alias("brier_sum"), (-F.avg(F.ln(clipped))).alias("log_loss"))


def argmax_class(df: DataFrame, p: str, codes, out: str = "yhat") -> DataFrame:
    """Class of the largest probability, the lowest index on a tie."""
    at = F.array_position(col(p), F.array_max(col(p))).cast("int")
    return df.withColumn(out, F.element_at(F.array(*[F.lit(c) for c in codes]), at))


def reliability(df: DataFrame, y: str, p: str, codes, bins: int = RELIABILITY_BINS, yhat: str | None = None) -> DataFrame:
    """lower, upper, n, mean_confidence, observed_accuracy of the top label (or of `yhat`); empty bins are omitted.

    A bin holds lower <= confidence < upper, the last one includes its upper edge.
    """
    labelled = argmax_class(df, p, codes, "_yhat") if yhat is None else df.withColumn("_yhat", col(yhat))
    scored = labelled.select(F.array_max(col(p)).alias("c"), (F.col("_yhat") == col(y)).alias("ok"))
    index = sum(((F.col("c") >= F.lit(i / bins)).cast("int") for i in range(1, bins)), F.lit(0))
    lower = F.array(*[F.lit(i / bins) for i in range(bins)])[F.col("_b")]
    upper = F.array(*[F.lit((i + 1) / bins) for i in range(bins)])[F.col("_b")]
    return scored.groupBy(index.alias("_b")).agg(
        F.count("*").alias("n"), F.avg("c").alias("mean_confidence"), F.avg(F.col("ok").cast("double")).alias("observed_accuracy"),
    ).select(lower.alias("lower"), upper.alias("upper"), "n", "mean_confidence", "observed_accuracy")


def evaluate(df: DataFrame, y: str, yhat: str, p: str, codes) -> DataFrame:
    """One row with every scalar: accuracy, macro scores, AUC, AP, Brier sum, log loss and the row count."""
    macro = macro_metrics(df, y, yhat, codes)
    out = df.agg(F.count("*").alias("rows_evaluated"), F.count_if(bad_probabilities(p, len(codes))).alias("bad_probabilities"))
    for part in (macro, macro_auc(df, y, p, codes), probability_losses(df, y, p, codes)):
        out = attach(out, part)
    return out.withColumn("independent_test", F.lit(False))
