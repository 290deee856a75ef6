"""Record schemas and the rules that a record must satisfy, as Spark types and columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

AMOUNT = T.DecimalType(28, 10)
MONEY = T.StructType([T.StructField("amount", AMOUNT), T.StructField("currency", T.StringType())])
ENERGY_PRICE = T.StructType([T.StructField("amount_per_mwh", AMOUNT), T.StructField("currency", T.StringType())])
DIAGNOSTIC = T.StructType([T.StructField(n, T.StringType()) for n in ("code", "message", "severity", "field_name")])


def _of(**fields: T.DataType | str) -> T.StructType:
    simple = {"s": T.StringType(), "t": T.TimestampType(), "d": T.DoubleType(), "n": T.DecimalType(28, 10), "i": T.IntegerType(), "day": T.DateType()}
    return T.StructType([T.StructField(k, simple.get(v, v) if isinstance(v, str) else v) for k, v in fields.items()])


RECORDS = {
    "consumption": _of(consumer_id="s", timestamp="t", value_mw="d"),
    "weather": _of(location_id="s", timestamp="t", temperature_c="d", solar_irradiance_w_m2="d", precipitation_mm="d"),
    "hydro": _of(resource_id="s", timestamp="t", reservoir_level_m="d", river_flow_m3_s="d", available_generation_mw="d"),
    "generation_availability": _of(asset_id="s", timestamp="t", status="s", available_capacity_mw="d", total_capacity_mw="d"),
    "market_price": _of(market_id="s", timestamp="t", price=ENERGY_PRICE, volume_mwh="d"),
    "news_event": _of(event_id="s", timestamp="t", headline="s", summary="s", category="s", severity="s"),
    "load_forecast_point": _of(forecast_run_id="s", consumer_id="s", generated_at="t", target_timestamp="t", value_mw="d"),
    "price_forecast_point": _of(forecast_run_id="s", market_id="s", generated_at="t", target_timestamp="t", price=ENERGY_PRICE),
    "regulatory_constraint": _of(constraint_id="s", constraint_type="s", description="s", effective_from="day", effective_to="day", minimum_value="n", maximum_value="n", unit="s", currency="s", source_document_id="s"),
    "risk_assessment": _of(assessment_id="s", assessed_at="t", delivery_timestamp="t", risk_score="d", expected_margin=MONEY, price_volatility="d", expected_balancing_penalty=MONEY, value_at_risk=MONEY, notes="s"),
    "market_bid": _of(bid_id="s", created_at="t", delivery_timestamp="t", side="s", quantity_mw="d", limit_price=ENERGY_PRICE),
    "market_clearing": _of(bid_id="s", delivery_timestamp="t", cleared_at="t", status="s", cleared_quantity_mw="d", clearing_price=ENERGY_PRICE),
    "settlement": _of(settlement_id="s", period_start="t", period_end="t", delivered_energy_mwh="d", revenue=MONEY, procurement_cost=MONEY, balancing_cost=MONEY, profit=MONEY),
    "dead_letter": _of(record_id="s", failed_at="t", source_name="s", adapter_name="s", diagnostics=T.ArrayType(DIAGNOSTIC), payload_reference="s", correlation_id="s"),
    "document_chunk": _of(document_id="s", chunk_id="s", ordinal="i", text="s", page_number="i"),
    "chunk_embedding": _of(document_id="s", chunk_id="s", vector=T.ArrayType(T.DoubleType())),
}
#: Any character that counts as blank at the ends of a text.
BLANK = r"[\s\x1c-\x1f\x85   -     　]"


#: The same characters one by one.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.trim(text, F.lit(BLANKS))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def non_empty(text: Column) -> Column:
    return F.coalesce(stripped(text) != "", F.lit(False))


def non_negative(x: Column) -> Column:
    return F.coalesce((x >= 0) & finite(x), F.lit(False))


def positive(x: Column) -> Column:
    return F.coalesce((x > 0) & finite(x), F.lit(False))


def unit_interval(x: Column) -> Column:
    return F.coalesce((x >= 0) & (x <= 1) & ~F.isnan(x), F.lit(False))


def currency_code(code: Column) -> Column:
    return F.coalesce(code.rlike(r"\A[A-Z]{3}\z"), F.lit(False))


def vector(v: Column) -> Column:
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & finite(x)), F.lit(False))


def availability_holds(available: Column, total: Column) -> Column:
    """Available capacity is at most the total where a total is given."""
    return total.isNull() | (available <= total)


def constraint_holds(start: Column, end: Column, low: Column, high: Column) -> Column:
    """An end is not before the start, and a maximum not below a minimum, where both are given."""
    return F.coalesce(end >= start, F.lit(True)) & F.coalesce(high >= low, F.lit(True))


def clearing_holds(status: Column, price: Column) -> Column:
    """A price is given unless the bid was rejected."""
    return (status == "rejected") | price.isNotNull()


def settlement_holds(start: Column, end: Column, *currencies: Column) -> Column:
    """The period has a positive length and all amounts one currency."""
    return (end > start) & (F.size(F.array_distinct(F.array(*currencies))) == 1)


def dead_letter_holds(diagnostics: Column) -> Column:
    return F.coalesce(F.size(diagnostics) >= 1, F.lit(False))
