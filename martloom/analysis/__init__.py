"""Analyses beyond the shipped reports: exploration, cohorts, delivery, geography, payments, finance."""

from martloom.analysis import (  # noqa: F401 - register
    cohort, delivery, eda, finance, geo, payments, primitives, quality,
)
from martloom.analysis.common import ANALYSES

__all__ = ["ANALYSES"]
