"""Forward-looking targets, chronological splits, folds and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridtide.functions import windows as X
from gridtide.plans.attach import join_on, per_series
from gridtide.plans.running import running_sums
from gridtide.plans.timeline import DAILY, SeriesFrame, SeriesOrder, windowed

TASKS = ("sign", "sign_3class", "price", "volatility")


def forward_return(df: DataFrame, *, price: str = "price", horizon: int = 1, name: str = "ret_fwd",
                   order: SeriesOrder = DAILY) -> DataFrame:
    """The one-row return that ends `horizon` rows ahead; NULL where the series has ended."""
    def ahead(w: WindowSpec) -> dict[str, Column]:
        return {name: F.try_divide(X.lead(price, w, horizon), F.lead(price, horizon - 1).over(w)) - 1}

    return windowed(df, ahead, order=order, lookahead=horizon)


def target_of(task: str, ret: Column, flat_threshold: float = 0.001) -> Column:
    """The target of a task from the forward return; a missing return stays missing."""
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}; use one of {TASKS}")
    if task == "sign":
        return F.when(ret.isNotNull(), (ret > 0).cast("int"))
    if task == "sign_3class":
        return F.when(ret > flat_threshold, 2).when(ret < -flat_threshold, 0).when(ret.isNotNull(), 1)
    return F.abs(ret) if task == "volatility" else ret


def build_targets(df: DataFrame, task: str = "sign", *, price: str = "price", horizon: int = 1,
                  flat_threshold: float = 0.001, order: SeriesOrder = DAILY) -> DataFrame:
    """Add `ret_fwd` and `y_target`."""
    rows = forward_return(df, price=price, horizon=horizon, order=order)
    return rows.withColumn("y_target", target_of(task, F.col("ret_fwd"), flat_threshold))


def drop_unlabelled(df: DataFrame, columns: Sequence[str] = ("y_target", "ret_fwd")) -> DataFrame:
    return df.na.drop("any", subset=list(columns))


def _places(df: DataFrame, order: SeriesOrder) -> DataFrame:
    """Rows with their position `idx` and the length `_n` of their series."""
    placed = order.cut(SeriesFrame.open(df, order).index("idx").close())
    return per_series(placed, {"_n": F.count(F.lit(1))}, order)


def _share(size: float) -> Column:
    return F.floor(F.col("_n") * F.lit(float(size)))


def split_chronological(df: DataFrame, test_size: float = 0.15, val_size: float = 0.15, *, by: str = "index",
                        order: SeriesOrder = DAILY) -> DataFrame:
    """Add `idx` and `split`: the last rows of a series are the test, those before it the validation.

    `by="date"` counts over all series together, so every series is cut at the same dates.
    """
    if by == "date":
        return _split_by_date(df, test_size, val_size, order)
    placed = _places(df, order)
    n_train = F.col("_n") - _share(test_size) - _share(val_size)
    split = F.when(F.col("idx") < n_train, "train").when(F.col("idx") < n_train + _share(val_size), "val").otherwise("test")
    return placed.withColumn("split", split).drop("_n")


def _split_by_date(df: DataFrame, test_size: float, val_size: float, order: SeriesOrder) -> DataFrame:
    per_time = running_sums(df.groupBy(order.ts).agg(F.count(F.lit(1)).alias("_rows")), [F.col(order.ts)],
                            {"_seen": F.col("_rows")})
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    n_train = F.col("_n") - _share(test_size) - _share(val_size)
    bounds = per_time.crossJoin(F.broadcast(total)).agg(
        F.min(F.when(F.col("_seen") > n_train, F.col(order.ts))).alias("_val_from"),
        F.min(F.when(F.col("_seen") > n_train + _share(val_size), F.col(order.ts))).alias("_test_from"))
    rows = with_places(df, order).crossJoin(F.broadcast(bounds))
    split = (F.when(F.col(order.ts) < F.col("_val_from"), "train")
             .when(F.col(order.ts) < F.col("_test_from"), "val").otherwise("test"))
    return rows.withColumn("split", split).drop("_val_from", "_test_from")


def with_places(df: DataFrame, order: SeriesOrder) -> DataFrame:
    return SeriesFrame.open(df, order).index("idx").close()


def split_rolling_window(df: DataFrame, train_size: float, test_size: float = 0.15, val_size: float = 0.15, *,
                         order: SeriesOrder = DAILY) -> DataFrame:
    """A training window of fixed size, then validation and test; rows outside have a NULL split.

    The window starts at the first row, or further left of the end if it would overrun the series.
    """
    if train_size + test_size + val_size > 1 + 1e-9:
        raise ValueError("not enough rows for this rolling window: the sizes add up to more than the series")
    placed = _places(df, order)
    n_train, n_val, n_test = _share(train_size), _share(val_size), _share(test_size)
    start = F.least(F.lit(0), F.col("_n") - n_train - n_val - n_test)
    at = F.col("idx") - start
    split = (F.when((at >= 0) & (at < n_train), "train").when((at >= n_train) & (at < n_train + n_val), "val")
             .when((at >= n_train + n_val) & (at < n_train + n_val + n_test), "test"))
    return placed.withColumn("split", split).drop("_n")


def time_series_folds(df: DataFrame, folds: int = 5, *, order: SeriesOrder = DAILY) -> DataFrame:
    """Add `idx` and `fold`: 0 for rows only ever trained on, k for the test rows of fold k.

    Fold k trains on all rows with a lower fold number.
    """
    placed = _places(df, order)
    size = F.floor(F.col("_n") / (folds + 1))
    first = F.col("_n") - size * folds
    fold = F.when(F.col("idx") < first, F.lit(0).cast("long")).otherwise(F.floor((F.col("idx") - first) / size) + 1)
    return placed.withColumn("fold", fold).drop("_n")


def union_splits(df: DataFrame, splits: Sequence[str] = ("train", "val"), *, split: str = "split") -> DataFrame:
    """The rows of several splits together."""
    return df.filter(F.col(split).isin(*splits))


def split_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, "split").agg(F.count(F.lit(1)).alias("n"))


def balance_downsample(df: DataFrame, *, label: str = "y_target", key: Sequence[str] = ("series_id", "trade_date"),
                       seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """Every class cut to the size of the smallest one, in a repeatable random choice.

    Rows without a label are dropped first: they are no class. The rows of a class are ranked by a hash
    of their key: counts per range of the hash say how many rows to take from each range, and ranks are
    needed only inside a range.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in key)))
    rows = df.filter(F.col(label).isNotNull()).withColumn("_digest", digest).withColumn("_slot", F.substring("_digest", 1, 4))
    groups = [*by, label]
    slots = rows.groupBy(*groups, "_slot").agg(F.count(F.lit(1)).alias("_rows"))
    sizes = slots.groupBy(*groups).agg(F.sum("_rows").alias("_size"))
    least = sizes.groupBy(*by).agg(F.min("_size").alias("_take"))
    w = Window.partitionBy(*groups).orderBy("_slot")
    ranked = slots.withColumn("_before", F.sum("_rows").over(w) - F.col("_rows"))
    ranked = join_on(ranked, least, by)
    wanted = ranked.filter(F.col("_before") < F.col("_take")).withColumn("_left", F.col("_take") - F.col("_before"))
    kept = join_on(rows, wanted.select(*groups, "_slot", "_left"), [*groups, "_slot"])
    place = F.row_number().over(Window.partitionBy(*groups, "_slot").orderBy("_digest", *key))
    return kept.withColumn("_place", place).filter(F.col("_place") <= F.col("_left")).drop(
        "_digest", "_slot", "_left", "_place")
