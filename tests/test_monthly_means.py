"""Monthly means that lie halfway between two numbers of four decimals, against sums in the order of events."""

import datetime
import math
import random

import pytest

import __spark_entry__ as entry
from terraspark.operators import aggregates as A
from terraspark.plans.fixtures import r5


@pytest.fixture(scope="module")
def halves(spark, tmp_path_factory):
    """Eight values of two decimals for each month, so that every second mean or so is a tie; rows lie in no order."""
    rng = random.Random(11)
    rows = [(i, datetime.datetime(2024, 1, 1 + i % 12, 12), i // 96, "view", rng.randrange(30000) / 100) for i in range(60 * 96)]
    at = str(tmp_path_factory.mktemp("events"))
    values: dict = {}
    for i, ts, user, _, v in rows:
        values.setdefault((user, ts.day), []).append(v)
    rng.shuffle(rows)
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{at}/events.parquet")
    want = {}
    for k, vs in values.items():
        total = 0.0
        for v in vs:
            total += v
        want[k] = math.floor(total / len(vs) * 10000 + 0.5) / 10000
    return at, want


def test_means_add_up_in_the_order_of_events(spark, halves):
    at, want = halves
    assert {(r["sample"], r["month"]): r["t"] for r in r5(spark, at).collect()} == want


def test_year_adds_up_in_the_order_of_months(spark, halves):
    at, want = halves
    got = {r["sample"]: r["p"] for r in entry.queries()["agg05_annual_sum"](spark, at).collect()}
    for user in {u for u, _ in want}:
        total = 0.0
        for month in range(1, 13):
            total += max(want[user, month] - 5, 0.0)
        assert got[user] == round(min(total, 65535))
    # 0.1 + 0.2 + 0.3 is above 0.6 from the left only: the sum of the year would be a tie from the right
    rows = [(n, m, v) for n, order in enumerate(((3, 2, 1, 4), (4, 1, 2, 3))) for m, v in sorted(zip((1, 2, 3, 4), (0.1, 0.2, 0.3, 0.9)), key=lambda r: order.index(r[0]))]
    out = A.annual_sum(spark.createDataFrame(rows, "n int, month int, v double").coalesce(1), ["n"], "v", "p", order="month").collect()
    assert {r["p"] for r in out} == {round(0.1 + 0.2 + 0.3 + 0.9)}


def test_mean_of_months_adds_up_in_their_order(spark, halves):
    at, want = halves
    got = {r["sample"]: (r["mean"], r["warm"]) for r in entry.queries()["agg14_month_array"](spark, at).collect()}
    for user in {u for u, _ in want}:
        total, months = 0.0, [want[user, m] for m in range(1, 13)]
        for t in months:
            total += t
        assert got[user] == (math.floor(total / 120.0 * 1000 + 0.25), math.floor(max(months) * 0.1 * 1000 + 0.25))
