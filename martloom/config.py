"""Settings shared by every mart: the analysis date and the business thresholds."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MartConfig:
    """``as_of`` replaces "today", so that a rebuild of the same data gives the same rows."""

    as_of: dt.date
    churn_days: int = 180
    cac: float = 50.0
    customer_key: str = "customer_unique_id"

    @property
    def today(self) -> Column:
        return F.lit(self.as_of)

    @property
    def now(self) -> Column:
        """Last microsecond of the analysis day, for the future-date guard."""
        end = dt.datetime.combine(self.as_of, dt.time.max)
        return F.lit(end.isoformat(sep=" ")).cast("timestamp_ntz")
