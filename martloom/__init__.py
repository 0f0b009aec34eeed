"""Retail analytics marts expressed as composable Spark DataFrame operators."""

from martloom.config import MartConfig

__all__ = ["MartConfig"]
