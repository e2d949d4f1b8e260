"""Curves and histograms of scores and of errors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.functions.scalars import inverse_normal
from gridtide.operators.scoring import outcome_bucket, score_counts
from gridtide.plans.attach import attach
from gridtide.plans.running import running_sums
from gridtide.plans.timeline import SeriesFrame, SeriesOrder, windowed, with_index


def _with_totals(ranked: DataFrame, by: Sequence[str]) -> DataFrame:
    totals = ranked.groupBy(*by).agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    return attach(ranked, totals, by)


def _share(top: str, bottom: str) -> Column:
    return F.try_divide(F.col(top).cast("double"), F.col(bottom).cast("double"))


def roc_curve(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """False and true positive rate at every distinct score, and the origin with no threshold."""
    points = _with_totals(score_counts(df, y, p, by), by).select(
        *by, F.col("score").alias("threshold"), _share("fp", "_neg").alias("fpr"), _share("tp", "_pos").alias("tpr"))
    return points.unionByName(_one_per_group(points, by, threshold=None, fpr=0.0, tpr=0.0))


def _one_per_group(points: DataFrame, by: Sequence[str], **values) -> DataFrame:
    spark = points.sparkSession
    groups = points.select(*by).distinct() if by else spark.range(1).select()
    return groups.select(*by, *(F.lit(v).cast("double").alias(n) for n, v in values.items()))


def pr_curve(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at every distinct score, and the point (recall 0, precision 1)."""
    points = _with_totals(score_counts(df, y, p, by), by).select(
        *by, F.col("score").alias("threshold"),
        F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")).alias("precision"),
        _share("tp", "_pos").alias("recall"))
    return points.unionByName(_one_per_group(points, by, threshold=None, precision=1.0, recall=0.0))


def pr_auc(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area under the precision-recall curve, and the share of positives as its baseline.

    A point only needs the point one score higher, whose counts are its own less its own group.
    """
    ranked = _with_totals(score_counts(df, y, p, by), by)
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    before = F.coalesce(F.try_divide(tp0.cast("double"), (tp0 + fp0).cast("double")), F.lit(1.0))
    now = F.col("tp") / (F.col("tp") + F.col("fp"))
    area = F.sum(F.try_divide(F.col("pos").cast("double"), F.col("_pos").cast("double")) * (before + now) / 2)
    share = F.sum("pos") / (F.sum("pos") + F.sum("neg"))
    return ranked.groupBy(*by).agg(area.alias("pr_auc"), share.alias("baseline"))


def evenly(low: float, high: float, n: int) -> list[float]:
    """n numbers from low to high with equal steps."""
    step = (high - low) / (n - 1)
    return [low + i * step for i in range(n - 1)] + [high]


def threshold_sweep(df: DataFrame, y: str = "y", p: str = "p", thresholds: Sequence[float] | None = None,
                    by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 when scores at or above each threshold count as positive.

    A row only adds to one group, the number of thresholds it reaches; the thresholds then sum groups.
    """
    levels = sorted(thresholds or evenly(0.1, 0.9, 50))
    reached = reduce(lambda a, t: a + (F.col(p) >= t).cast("int"), levels, F.lit(0))
    groups = df.groupBy(*by, reached.alias("_reached")).agg(
        F.sum((F.col(y) == 1).cast("long")).alias("_pos"), F.count(F.lit(1)).alias("_n"))
    table = F.array(*(F.struct(F.lit(i + 1).alias("place"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(levels)))
    # At most 51 groups, each repeated for the 50 thresholds.
    spread = groups.withColumn("_level", F.explode(table)).withColumn("_hit", F.col("_reached") >= F.col("_level.place"))
    tp = F.sum(F.when(F.col("_hit"), F.col("_pos")).otherwise(0)).cast("double")
    called = F.sum(F.when(F.col("_hit"), F.col("_n")).otherwise(0)).cast("double")
    pos = F.sum("_pos").cast("double")

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return spread.groupBy(*by, F.col("_level.threshold").alias("threshold")).agg(
        ratio(tp, called).alias("precision"), ratio(tp, pos).alias("recall"), ratio(2 * tp, called + pos).alias("f1"))


def calibration_curve(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Mean score and share of positives per right-closed bin of equal width, empty bins left out."""
    place = F.greatest(F.lit(0), F.ceil(F.col(p) * bins).cast("int") - 1)
    return df.groupBy(*by, F.least(place, F.lit(bins - 1)).alias("bin")).agg(
        F.avg(p).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("fraction_positive"), F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = (), *, name: str = "bin") -> DataFrame:
    """Rows per bin of equal width between the lowest and highest value; the last bin is closed."""
    ends = df.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    placed = df.crossJoin(F.broadcast(ends))  # one row
    place = F.least(F.lit(bins - 1), F.floor(
        F.coalesce(F.try_divide(F.col(value) - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0)) * bins).cast("int"))
    width = (F.max("_high") - F.max("_low")) / bins
    return placed.filter(F.col(value).isNotNull()).groupBy(*by, place.alias(name)).agg(
        F.count(F.lit(1)).alias("n"), (F.max("_low") + F.col(name) * width).alias("bin_low"),
        (F.max("_low") + (F.col(name) + 1) * width).alias("bin_high"))


def probability_histogram(df: DataFrame, p: str = "p", bins: int = 50) -> DataFrame:
    return histogram(df, p, bins)


def outcome_histogram(df: DataFrame, y: str = "y", p: str = "p", bins: int = 30) -> DataFrame:
    """Scores per outcome (TP, FP, FN, TN), all on the same bins."""
    return histogram(df.withColumn("outcome", outcome_bucket(F.col(y), F.col(p))), p, bins, by=["outcome"])


# ---- residuals -----------------------------------------------------------------------------------

def residuals(df: DataFrame, y: str = "y_true", pred: str = "y_pred") -> DataFrame:
    return df.withColumn("residual", F.col(y) - F.col(pred))


def rolling_window_size(n: int) -> int:
    return max(20, n // 20)


def _full_mean(value: Column, window: int, name: str):
    """The mean of the last `window` rows where all of them have a value."""
    def columns(w):
        frame = w.rowsBetween(1 - window, 0)
        return {name: F.when(F.count(value).over(frame) == window, F.avg(value).over(frame))}

    return columns


def rolling_residual_mean(df: DataFrame, window: int = 20, *, residual: str = "residual", order: SeriesOrder) -> DataFrame:
    """Mean residual of the last `window` rows, full windows only."""
    return windowed(df, _full_mean(F.col(residual), window, "rolling_mean"), order=order, lookback=window - 1)


def rolling_rmse(df: DataFrame, window: int = 20, *, residual: str = "residual", order: SeriesOrder) -> DataFrame:
    """RMSE of every full window, numbered by the position of the window's first row."""
    square = F.col(residual) * F.col(residual)
    frame = SeriesFrame.open(df, order, lookback=window - 1).index("_idx").with_columns(_full_mean(square, window, "_mse"))
    full = frame.close().filter(F.col("_mse").isNotNull())
    return full.select(*order.keys, (F.col("_idx") - (window - 1)).alias("window_start"), F.sqrt("_mse").alias("rolling_rmse"))


def residual_histogram(df: DataFrame, residual: str = "residual", bins: int = 50) -> DataFrame:
    return histogram(df, residual, bins)


def qq_points(df: DataFrame, residual: str = "residual", *, tie: Sequence[str] = ()) -> DataFrame:
    """Sorted residuals against normal quantiles of evenly spaced shares from 0.01 to 0.99."""
    known = df.filter(F.col(residual).isNotNull()).select(residual, *tie)
    ranked = running_sums(known, [F.col(residual), *(F.col(t) for t in tie)], {"rank": F.lit(1).cast("long")})
    n = ranked.agg(F.count(F.lit(1)).alias("_n"))
    share = F.when(F.col("_n") == 1, 0.01).otherwise(
        0.01 + (F.col("rank") - 1) * (0.98 / F.greatest(F.col("_n") - 1, F.lit(1))))
    return ranked.crossJoin(F.broadcast(n)).select("rank", F.col(residual), inverse_normal(share).alias("theoretical"))


def error_by_magnitude(df: DataFrame, y: str = "y_true", residual: str = "residual", edges: int = 10) -> DataFrame:
    """Mean absolute error per bin of the true value's size.

    The edges lie evenly from the smallest to the largest size and bins are closed on the left, so the
    largest size falls outside the last bin.
    """
    size = F.abs(F.col(y))
    ends = df.agg(F.min(size).alias("_low"), F.max(size).alias("_high"))
    step = (F.col("_high") - F.col("_low")) / (edges - 1)
    place = F.when(F.col("_high") > F.col("_low"), F.floor((size - F.col("_low")) / step).cast("int") + 1)
    binned = df.crossJoin(F.broadcast(ends)).withColumns({"bin": place, "_step": step})
    centre = F.max("_low") + (F.col("bin") - 0.5) * F.max("_step")
    return binned.filter((F.col("bin") < edges) & F.col(residual).isNotNull()).groupBy("bin").agg(
        centre.alias("bin_center"), F.avg(F.abs(F.col(residual))).alias("mae"), F.count(F.lit(1)).alias("n"))


def prediction_timeline(df: DataFrame, y: str, pred: str, *, order: SeriesOrder, threshold: float | None = None) -> DataFrame:
    """Position, true value and prediction per row; with a threshold the hard label too."""
    rows = with_index(df, order)
    label = [] if threshold is None else [(F.col(pred) > threshold).cast("int").alias("label")]
    return rows.select(*order.columns(), "idx", F.col(y), F.col(pred), *label)
