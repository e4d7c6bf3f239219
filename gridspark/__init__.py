"""Gridded-field and time-series analytics on Spark DataFrames."""

from gridspark.session import get_session

__all__ = ["get_session"]
