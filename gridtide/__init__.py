"""gridtide: windowed analytics, back-tests and model scoring over many market series with PySpark."""

from gridtide.plans.timeline import DAILY, SeriesFrame, SeriesOrder
from gridtide.session import build_session, cut, scratch_dir

__all__ = ["DAILY", "SeriesFrame", "SeriesOrder", "build_session", "cut", "scratch_dir"]
