"""Forecasting models fitted by Spark: MLlib estimators and regressions from aggregates."""
