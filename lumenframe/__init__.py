"""lumenframe: DataFrame-to-DataFrame analytics operators for Apache Spark."""

from lumenframe.session import get_spark

__all__ = ["get_spark"]
