from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ampereflow.errors import InvalidRequestError
from ampereflow.functions.grid import Grid
from ampereflow.operators import features, forecast, horizon, regression, validation
from ampereflow.series import LOAD, PRICE

T0 = datetime(2026, 1, 10)


def history(spark, values, consumer="c"):
    return spark.createDataFrame([(consumer, T0 + timedelta(hours=h), float(v)) for h, v in values.items()], "consumer_id string, timestamp timestamp_ntz, value_mw double")


def training(spark, rows, series=LOAD):
    if series == LOAD:
        return spark.createDataFrame([("c", T0 + timedelta(hours=i), float(a), float(b), float(y)) for i, (a, b, y) in enumerate(rows)], "consumer_id string, timestamp timestamp_ntz, lag_24h double, lag_168h double, target double")
    return spark.createDataFrame([("m", "AMD", T0 + timedelta(hours=i), Decimal(a), Decimal(b), Decimal(y)) for i, (a, b, y) in enumerate(rows)], "market_id string, currency string, timestamp timestamp_ntz, lag_24h decimal(18,2), lag_168h decimal(18,2), target decimal(18,2)")


def test_exact_lags_only(spark):
    rows = features.lag_features(history(spark, {0: 1, 1: 2, 24: 3, 25.5: 4, 48: 5}), LOAD).orderBy("timestamp").collect()
    assert [(r.lag_24h, r.target) for r in rows] == [(1.0, 3.0), (3.0, 5.0)]
    both = features.lag_features(history(spark, {0: 1, 144: 2, 168: 3, 169: 4}), LOAD, (24, 168)).collect()
    assert [(r.lag_24h, r.lag_168h, r.target) for r in both] == [(2.0, 1.0, 3.0)]
    assert features.lag_features(history(spark, {0: 1}), LOAD).count() == 0


def test_lags_do_not_cross_entities_and_need_one_shuffle(spark):
    mixed = history(spark, {0: 1}).union(history(spark, {24: 2}, "d"))
    found = features.lag_features(mixed, LOAD, (24, 168))
    assert found.count() == 0
    plan = features.lag_features(mixed, LOAD, (24, 168))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_split_is_by_time(spark):
    rows = features.split(history(spark, {0: 1, 1: 2, 2: 3}), LOAD, "2026-01-10 01:00:00").orderBy("timestamp").collect()
    assert [r.part for r in rows] == ["train", "evaluation", "evaluation"]


def test_one_feature_fit(spark):
    fit = regression.fit_one(training(spark, [(1, 0, 5), (2, 0, 3)]), LOAD).first()
    assert (fit.slope, fit.intercept, fit.status) == (-2.0, 7.0, "ok")
    assert regression.fit_one(training(spark, [(1, 0, 5)]), LOAD).first().status == "insufficient"
    assert regression.fit_one(training(spark, [(1, 0, 5), (1, 0, 7)]), LOAD).first().status == "singular"


def test_two_feature_fit(spark):
    fit = regression.fit_two(training(spark, [(a, b, 3 * a + 5 * b + 2) for a, b in ((1, 1), (2, 1), (1, 2), (2, 2))]), LOAD).first()
    assert (fit.b1, fit.b2, fit.intercept, fit.status) == (pytest.approx(3), pytest.approx(5), pytest.approx(2), "ok")
    assert regression.fit_two(training(spark, [(1, 2, 1), (2, 4, 2), (3, 6, 3)]), LOAD).first().status == "singular"
    assert regression.fit_two(training(spark, [(1, 2, 1), (2, 1, 2)]), LOAD).first().status == "insufficient"
    near = training(spark, [(1, 3.3, 1), (2, 6.6, 2), (3, 9.9, 3)])
    assert regression.fit_two(near, LOAD, tolerance=1e-9).first().status == "singular"


def test_decimal_fits_are_exact(spark):
    design = [("1", "0"), ("0", "1"), ("1", "1"), ("2", "3")]
    rows = training(spark, [(a, b, str(Decimal("1.5") * Decimal(a) - Decimal("0.25") * Decimal(b) + 4)) for a, b in design], PRICE)
    fit = regression.fit_decimal(rows, PRICE, ("lag_24h", "lag_168h")).first()
    assert (Decimal(fit.b1), Decimal(fit.b2), Decimal(fit.intercept), fit.status) == (Decimal("1.5"), Decimal("-0.25"), Decimal(4), "ok")
    one = regression.fit_decimal(training(spark, [("0.10", "0", "0.30"), ("0.20", "0", "0.50")], PRICE), PRICE).first()
    assert (Decimal(one.slope), Decimal(one.intercept)) == (Decimal(2), Decimal("0.1"))
    assert regression.fit_decimal(training(spark, [("1", "2", "1"), ("2", "4", "2"), ("3", "6", "3")], PRICE), PRICE, ("lag_24h", "lag_168h")).first().status == "singular"
    assert regression.fit_decimal(training(spark, [("1", "2", "1")], PRICE), PRICE).first().status == "insufficient"


def test_predictions_errors_and_alignment(spark):
    rows = training(spark, [(1, 0, 5), (2, 0, 3), (9, 0, 0)])
    fit = regression.fit_one(rows.filter("lag_24h < 9"), LOAD)
    cases = regression.predict(fit, rows, LOAD)
    assert sorted(r.predicted for r in cases.collect()) == [-11.0, 3.0, 5.0]
    assert regression.mean_absolute_error(cases, LOAD).first().mae == pytest.approx(11 / 3)
    same = regression.compare({"a": cases, "b": cases.withColumn("predicted", F.col("actual"))}, LOAD).first()
    assert (same.n, same.mae_a, same.mae_b, same.misaligned) == (3, pytest.approx(11 / 3), 0.0, 0)
    assert regression.compare({"a": cases, "b": cases.limit(2)}, LOAD).first().misaligned == 1
    assert regression.compare({"a": cases, "b": cases.union(cases)}, LOAD).first().misaligned == 3
    other = cases.withColumn("actual", F.col("actual") + F.when(F.col("actual") == 0, 1.0).otherwise(0.0))
    assert regression.compare({"a": cases, "b": other}, LOAD).first().misaligned == 1


def test_price_errors_are_summed_as_decimals(spark):
    cases = spark.createDataFrame([("m", "AMD", T0, Decimal("0.10"), Decimal("0.20")), ("m", "AMD", T0 + timedelta(days=1), Decimal("0.30"), Decimal("0.10"))], "market_id string, currency string, timestamp timestamp_ntz, predicted decimal(18,2), actual decimal(18,2)")
    assert regression.mean_absolute_error(cases, PRICE).first().mae == Decimal("0.15")


def test_prices_stay_decimals(spark):
    """Fits, predictions and errors of prices against plain decimals; doubles would differ in the last digits."""
    rng = __import__("random").Random(5)
    points = [(Decimal(rng.randrange(10**7)) / 100, Decimal(rng.randrange(10**7)) / 100, Decimal(rng.randrange(10**9)) / 100) for _ in range(40)]
    rows = training(spark, [tuple(map(str, p)) for p in points], PRICE)
    n = Decimal(40)
    ma, my = sum(p[0] for p in points) / n, sum(p[2] for p in points) / n
    slope = sum((p[0] - ma) * (p[2] - my) for p in points) / sum((p[0] - ma) ** 2 for p in points)
    intercept = my - slope * ma
    fit = regression.fit(rows, PRICE)
    assert abs(Decimal(fit.first().slope) - slope) < Decimal("1e-20")
    found = regression.predict(fit, rows, PRICE)
    assert dict(found.dtypes)["predicted"] == "decimal(30,12)"
    got = {r.actual: r.predicted for r in found.collect()}
    assert all(abs(got[p[2]] - (intercept + slope * p[0])) < Decimal("1e-8") for p in points)
    mae = regression.mean_absolute_error(found, PRICE).first().mae
    assert isinstance(mae, Decimal) and abs(mae - sum(abs(intercept + slope * p[0] - p[2]) for p in points) / n) < Decimal("1e-8")
    compared = regression.compare({"a": found, "b": found}, PRICE).first()
    assert (compared.mae_a, compared.misaligned) == (mae, 0)
    huge = fit.withColumn("slope", F.lit("1e30"))
    assert regression.predict(huge, rows, PRICE).first().predicted is None  # refused by the strict form


def test_forecasts(spark):
    past = history(spark, {0: 4, 1: 5, 2: 6, 168 - 24: 7, 3: 1}).union(history(spark, {2: 9}))
    targets = spark.createDataFrame([("c", T0 + timedelta(hours=h)) for h in (24, 24, 26, 30, 168)], "consumer_id string, timestamp timestamp_ntz")
    found = forecast.persistence(targets, past, LOAD).orderBy("timestamp").collect()
    assert [(r.predicted, r.status) for r in found] == [(4.0, "ok"), (4.0, "ok"), (None, "duplicate"), (None, "missing"), (7.0, "ok")]
    with pytest.raises(InvalidRequestError):
        forecast.require_forecast(forecast.persistence(targets, past, LOAD))
    fit = spark.createDataFrame([("c", 9, 1.0, -3.0, 2.0, "ok")], "consumer_id string, n bigint, b1 double, b2 double, intercept double, status string")
    found = forecast.ols(targets, past, fit, LOAD).orderBy("timestamp").collect()
    assert [r.status for r in found] == ["missing_168h", "missing_168h", "duplicate_24h", "missing_24h", "negative"]
    sound = forecast.ols(targets, past, fit.withColumn("intercept", F.lit(20.0)), LOAD).filter("status = 'ok'").first()
    assert sound.predicted == 20 + 7 - 3 * 4
    assert forecast.ols(targets, past, fit.limit(0), LOAD).filter("status = 'unfitted'").count() == 1
    now = datetime(2026, 1, 1, tzinfo=timezone.utc)
    forecast.check_request(past, targets, LOAD, {"consumer_id": "c"}, "run", now)
    east = timezone(timedelta(hours=4))
    for frame, name, run, made in ((targets.limit(0), "c", "run", now), (targets, "d", "run", now), (targets, "c", " ", now), (targets, "c", "run", now.replace(tzinfo=None)), (targets, "c", "run", now.astimezone(east)), (targets, " ", "run", now)):
        with pytest.raises(InvalidRequestError):
            forecast.check_request(past, frame, LOAD, {"consumer_id": name}, run, made)


def test_horizon_is_half_open_and_pushed_down(spark, tmp_path):
    history(spark, {0: 1, 1: 2, 2: 3}).write.parquet(str(tmp_path / "h"))
    stored = spark.read.parquet(str(tmp_path / "h"))
    found = horizon.within(stored, "2026-01-10 00:00:00", "2026-01-10 02:00:00", consumer_id="c")
    assert sorted(r.value_mw for r in found.collect()) == [1.0, 2.0]
    assert "GreaterThanOrEqual(timestamp" in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(InvalidRequestError):
        horizon.within(stored, "2026-01-10", "2026-01-10")


def test_issues_and_gaps(spark):
    grid = Grid(3_600_000_000)
    rows = history(spark, {0: 1, 1: 2, 4: 3, 4.5: 1, 6: 1}).union(history(spark, {1: 2})).withColumn("pos", F.monotonically_increasing_id())
    judged = validation.issues(rows, grid)
    assert sorted((str(r.timestamp)[11:16], r.issue) for r in judged.filter("issue is not null").collect()) == [("01:00", "duplicate"), ("01:00", "duplicate"), ("04:30", "misaligned")]
    found = validation.gaps(judged.filter("issue is null"), grid).orderBy("first_missing").collect()
    assert [(str(r.first_missing)[11:16], str(r.last_missing)[11:16], r.missing, r.message) for r in found] == [("01:00", "03:00", 3, "3 intervals are missing"), ("05:00", "05:00", 1, "1 interval is missing")]
    assert validation.issues(rows).filter("issue = 'misaligned'").count() == 0


@pytest.mark.parametrize("bucket", [1, 2, 1024])
def test_neighbours_across_buckets(spark, monkeypatch, bucket):
    monkeypatch.setattr(validation, "BUCKET", bucket)
    hours = [0, 1, 2, 5, 6, 40, 41, 100]
    rows = history(spark, {h: 1 for h in hours}).union(history(spark, {3: 1, 50: 1}, "d"))
    found = validation.gaps(rows, Grid(3_600_000_000)).collect()
    expected = [("c", b - a - 1) for a, b in zip(hours, hours[1:]) if b - a > 1] + [("d", 46)]
    assert sorted((r.consumer_id, r.missing) for r in found) == sorted(expected)
    order = spark.createDataFrame([("c", T0 + timedelta(hours=h), i * 100) for i, h in enumerate([0, 1, 3, 2, 2, 5])], "consumer_id string, timestamp timestamp_ntz, pos bigint")
    assert [(r.pos, r.violation) for r in validation.chronology(order).collect()] == [(300, "out_of_order")]


def test_strict_checks(spark):
    rows = history(spark, {0: 1, 2: 2, 1: 3}).withColumn("pos", F.when(F.hour("timestamp") == 0, 1).when(F.hour("timestamp") == 2, 2).otherwise(3))
    with pytest.raises(InvalidRequestError, match="out of order"):
        validation.require_chronology(rows, LOAD)
    repeated = rows.filter("pos < 3").union(rows.filter("pos = 2").withColumn("pos", F.lit(3)))
    with pytest.raises(InvalidRequestError, match="repeat"):
        validation.require_chronology(repeated, LOAD)
    with pytest.raises(InvalidRequestError):
        validation.require_unique(repeated, LOAD)
    with pytest.raises(InvalidRequestError):
        validation.require_one_entity(rows.union(rows.withColumn("consumer_id", F.lit("d"))), LOAD)
    validation.require_chronology(rows.filter("pos < 3"), LOAD)
    validation.require_unique(rows, LOAD)
    validation.require_one_entity(rows, LOAD)


def test_grid_steps_round_down(spark):
    grid = Grid(3_600_000_000, anchor_us=1_800_000_000)
    t = "2026-01-10 00:30:00"
    row = spark.sql(f"SELECT timestamp_ntz'{t}' AS a, timestamp_ntz'2026-01-09 23:00:00' AS b").select(grid.aligned(F.col("a")).alias("x"), grid.steps_between(F.col("a"), F.col("b")).alias("n"), grid.offset(F.col("a"), F.lit(-1)).cast("timestamp_ntz").alias("o")).first()
    assert (row.x, row.n, str(row.o)) == (True, -2, "2026-01-09 23:30:00")
    with pytest.raises(ValueError):
        Grid(0)
