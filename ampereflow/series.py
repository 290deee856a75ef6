"""What distinguishes a load series from a price series; operators are written once for both."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Series:
    """``keys`` name an entity, ``time`` its instant and ``value`` what is forecast."""

    name: str
    keys: tuple[str, ...]
    value: str
    time: str = "timestamp"

    @property
    def row(self) -> tuple[str, ...]:
        return (*self.keys, self.time)


#: Power in floating point, and prices in decimals with their currency.
LOAD = Series("load", ("consumer_id",), "value_mw")
PRICE = Series("price", ("market_id", "currency"), "amount_per_mwh")
