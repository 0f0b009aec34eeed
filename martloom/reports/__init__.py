"""Report queries that read one stored mart each."""

from martloom.reports import advanced, customer, financial, operational  # noqa: F401 - register
from martloom.reports.common import REPORTS

__all__ = ["REPORTS"]
