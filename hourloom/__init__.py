"""Hourly sensor-series analytics as Spark DataFrame jobs."""

from .config import CleanSettings, FeatureSettings, ScaleSettings

__all__ = ["CleanSettings", "FeatureSettings", "ScaleSettings"]
