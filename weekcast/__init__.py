"""Weekly sales forecasting as Spark DataFrame operators."""

from weekcast.spec import SeriesSpec
from weekcast.session import build_session

__all__ = ["SeriesSpec", "build_session"]
