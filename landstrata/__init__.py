"""Geospatial feature layers on Spark DataFrames."""

from landstrata.session import build_session

__all__ = ["build_session"]
