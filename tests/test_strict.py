from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ampereflow.errors import InvalidRequestError
from ampereflow.plans import strict
from ampereflow.series import LOAD, PRICE

T0 = datetime(2026, 1, 1)


def rows(spark, values, consumer="c"):
    data = [(consumer, T0 + timedelta(hours=h), i, float(a), float(b), float(y)) for i, (h, a, b, y) in enumerate(values)]
    return spark.createDataFrame(data, "consumer_id string, timestamp timestamp_ntz, pos int, lag_24h double, lag_168h double, target double")


GOOD = [(0, 1, 1, 10), (1, 2, 1, 13), (2, 1, 2, 15), (3, 2, 2, 18)]


def refuses(text, call):
    with pytest.raises(InvalidRequestError, match=text):
        call()


def test_chain_for_one_consumer(spark):
    train, evaluation = strict.split(rows(spark, GOOD), LOAD, "2026-01-01 03:00:00")
    one, two = strict.fit(train, LOAD), strict.fit(train, LOAD, 2)
    assert (round(two.first().b1, 9), round(two.first().b2, 9), round(two.first().intercept, 9)) == (3, 5, 2)
    cases = {"a": strict.predict(one, evaluation, LOAD), "b": strict.predict(two, evaluation, LOAD)}
    found = strict.compare(cases, LOAD).first()
    assert found.n == 1 and found.mae_b == pytest.approx(0) and strict.mean_absolute_error(cases["a"], LOAD).first().n == 1


def test_order_of_checks(spark):
    good, empty = rows(spark, GOOD), rows(spark, [])
    mixed = good.union(rows(spark, [(9, 1, 1, 1)], "d"))
    backwards = rows(spark, [(1, 1, 1, 1), (0, 2, 1, 2), (5, 1, 2, 3)])
    equal = rows(spark, [(1, 1, 1, 1), (1, 2, 1, 2), (5, 1, 2, 3)])
    refuses("no rows", lambda: strict.split(empty, LOAD, "2026-01-01"))
    refuses("more than one", lambda: strict.split(mixed, LOAD, "2026-01-01"))
    refuses("out of order", lambda: strict.split(backwards, LOAD, "2026-01-01"))
    refuses("repeat", lambda: strict.split(equal, LOAD, "2026-01-01"))
    refuses("before", lambda: strict.split(good, LOAD, "2025-01-01"))
    refuses("after", lambda: strict.split(good, LOAD, "2027-01-01"))
    refuses("too few", lambda: strict.fit(rows(spark, GOOD[:1]), LOAD))
    refuses("too few", lambda: strict.fit(rows(spark, GOOD[:2]), LOAD, 2))
    refuses("singular", lambda: strict.fit(rows(spark, [(0, 1, 1, 1), (1, 1, 1, 2)]), LOAD))
    refuses("singular", lambda: strict.fit(rows(spark, [(0, 1, 2, 1), (1, 2, 4, 2), (2, 3, 6, 9)]), LOAD, 2))
    bad_fit = strict.fit(good, LOAD).withColumn("slope", F.lit(float("nan")))
    refuses("fit is not finite", lambda: strict.predict(bad_fit, mixed, LOAD))
    refuses("no rows", lambda: strict.predict(bad_fit, empty, LOAD))
    priced = lambda f: f.withColumn("market_id", F.col("consumer_id")).withColumn("currency", F.lit("AMD"))
    refuses("more than one", lambda: strict.predict(priced(bad_fit), priced(mixed), PRICE))
    refuses("more than one", lambda: strict.lag_rows(mixed.withColumn("value_mw", F.lit(1.0)), LOAD))
    refuses("more than once", lambda: strict.lag_rows(equal.withColumn("value_mw", F.lit(1.0)), LOAD))
    assert strict.lag_rows(empty.withColumn("value_mw", F.lit(1.0)), LOAD).count() == 0
    cases = strict.predict(strict.fit(good, LOAD), good, LOAD)
    refuses("empty", lambda: strict.compare({"a": cases, "b": cases.limit(0)}, LOAD))
    refuses("length", lambda: strict.compare({"a": cases, "b": cases.limit(2)}, LOAD))
    refuses("more than one", lambda: strict.compare({"a": cases, "b": cases.withColumn("consumer_id", F.lit("d"))}, LOAD))
    refuses("aligned", lambda: strict.compare({"a": cases, "b": cases.withColumn("actual", F.col("actual") + 1)}, LOAD))
    refuses("no cases", lambda: strict.mean_absolute_error(cases.limit(0), LOAD))
    strict.mean_absolute_error(cases.union(cases.withColumn("consumer_id", F.lit("d"))), LOAD, persistence=True)
    refuses("more than one", lambda: strict.mean_absolute_error(cases.union(cases.withColumn("consumer_id", F.lit("d"))), LOAD))
