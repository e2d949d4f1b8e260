"""From a raw market table to a labelled, split, scaled and sequenced dataset in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.operators import cleaning, features, scaling, sequences, targets
from gridtide.plans.timeline import DAILY, SeriesOrder
from gridtide.session import cut
from gridtide.sources.market import CORE

NOT_FEATURES = ("has_real_price", "ret_fwd", "y_target", "split", "idx")


@dataclass(frozen=True)
class Dataset:
    """Rows with `split`, `ret_fwd`, `y_target` and features; `seq` too where sequences were asked for."""

    rows: DataFrame
    features: tuple[str, ...]
    task: str
    order: SeriesOrder = DAILY


def feature_columns(df: DataFrame, order: SeriesOrder = DAILY) -> tuple[str, ...]:
    taken = {*NOT_FEATURES, *order.columns()}
    return tuple(f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in taken)


def make_dataset(df: DataFrame, task: str = "sign", *, features_version: int = 2, seq_len: int | None = None,
                 test_size: float = 0.15, val_size: float = 0.15, scaler: str | None = "standard",
                 balance: bool | str = False, drop_flat: bool = True, impute: bool = False, flat_threshold: float = 0.001,
                 horizon: int = 1, seed: int = 42, split_by: str = "index", validate: bool = True, order: SeriesOrder = DAILY) -> Dataset:
    """Clean, derive features, label, split, balance, scale and sequence.

    Version 2 drops incomplete rows; version 1 flags real prices, fills gaps for the features and
    keeps the flagged rows. Scaling and zero prices only use training rows, and sequences never cross
    a split. Balancing drops training rows only, or rows of each split with `balance="all"`. With
    `validate`, rows without a time and repeated times of a series are refused (BadData) before anything
    is built on them; the features themselves can't hold missing or infinite values.
    """
    if validate:
        cleaning.assert_quality(df.select(*order.columns()), (), order)
    order = order.resolved(df)
    if features_version == 1:
        rows = cleaning.real_price_flag(df)
        rows = order.cut(cleaning.forward_fill(rows, CORE, order))
        rows = order.cut(targets.split_chronological(rows, test_size, val_size, by=split_by, order=order))
        rows = cleaning.replace_zero_price_train_only(rows, order=order)
        rows = order.cut(features.feature_frame_v1(rows.drop("split", "idx"), order=order))
        rows = cleaning.filter_real_price(rows)
    elif features_version == 2:
        rows = df
        if impute:
            rows = order.cut(cleaning.forward_fill(rows, CORE, order))
        rows = order.cut(cleaning.clean_market(rows, drop_flat=drop_flat, order=order))
        rows = order.cut(features.feature_frame_v2(rows, order=order))
    else:
        raise ValueError(f"features_version must be 1 or 2, got {features_version}")
    names = feature_columns(rows, order)
    rows = targets.build_targets(rows, task, horizon=horizon, flat_threshold=flat_threshold, order=order)
    rows = order.cut(targets.drop_unlabelled(rows))
    rows = order.cut(targets.split_chronological(rows, test_size, val_size, by=split_by, order=order))
    if scaler:
        scale = {"standard": scaling.standard_scale, "minmax": scaling.minmax_scale}[scaler]
        rows = scale(rows, names, order=order)
    if seq_len is not None and seq_len > 1:
        rows = sequences.sequences_same(order.cut(rows), names, seq_len, order=order)
    if balance and task in ("sign", "sign_3class"):
        rows = cut(rows)  # counted, ranked and joined below
        if balance == "all":
            rows = targets.balance_downsample(rows, key=order.columns(), seed=seed, by=["split"])
        else:
            train = targets.balance_downsample(rows.filter(F.col("split") == "train"), key=order.columns(), seed=seed)
            rows = train.unionByName(rows.filter(F.col("split") != "train"))
    return Dataset(rows, names, task, order)
