"""Positions of instants on a regular grid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Instants ``anchor + k * step``, both in microseconds since 1970 UTC."""

    step_us: int
    anchor_us: int = 0

    def __post_init__(self) -> None:
        if self.step_us <= 0:
            raise ValueError("the interval must be positive")

    def _at(self, time: Column) -> Column:
        return F.unix_micros(time.cast("timestamp"))

    def aligned(self, time: Column) -> Column:
        return F.pmod(self._at(time) - self.anchor_us, F.lit(self.step_us)) == 0

    def steps_between(self, earlier: Column, later: Column) -> Column:
        """Whole steps, rounded down also for negative distances."""
        distance = self._at(later) - self._at(earlier)
        return ((distance - F.pmod(distance, F.lit(self.step_us))) / self.step_us).cast("bigint")

    def offset(self, time: Column, steps: Column) -> Column:
        return F.timestamp_micros(self._at(time) + steps * self.step_us)
