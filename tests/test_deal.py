"""Joins on few keys: dealt by id, and equal to the plain join."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatt.functions.columns import round_half_up
from tidewatt.operators import dispatch, tables


def tasks_of(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


@pytest.fixture
def shuffled(spark):
    """Joins by shuffles, as on tables beyond the broadcast limit."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k in keys:
        spark.conf.set(k, "-1")
    yield spark
    for k in keys:
        spark.conf.unset(k)


def test_one_key_is_dealt_to_many_tasks(shuffled, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    ids = [*range(200), 7, 7, None, None]
    many = shuffled.createDataFrame([(k, "a") for k in ids] + [(1, "b"), (2, None)], "id long, zone string")
    each = shuffled.createDataFrame([("a", t) for t in range(50)] + [("b", 99), ("c", 1), (None, 2)], "zone string, t long")
    dealt = tables.deal(many, each, ["zone"], "id")
    plain = many.join(each, "zone")
    assert Counter(dealt.select("id", "zone", "t").collect()) == Counter(plain.select("id", "zone", "t").collect())
    assert dealt.groupBy("id").agg(F.count_distinct("_part").alias("n")).where("n > 1").count() == 0
    assert tasks_of(dealt) > 10
    once = tables.deal(many, each, ["zone"], "id", distinct=True)
    assert Counter(once.select("id", "zone", "t").collect()) == Counter(many.distinct().join(each, "zone").select("id", "zone", "t").collect())
    assert tables.deal(many, each.limit(0), ["zone"], "id").count() == 0 == tables.deal(many.limit(0), each, ["zone"], "id").count()


def fleet(spark):
    assets = spark.createDataFrame([(k, "z", 10.0 + (k or 0), 20.0 + 2 * (k or 0), 0.95, 0.95, 0.05, 0.95, 0.5, 1.5, 2.0) for k in [*range(60), 5, None]],
                                   "asset_id long, series_id string, power_mw double, energy_mwh double, eta_charge double, eta_discharge double, "
                                   "soc_min_frac double, soc_max_frac double, soc_init_frac double, max_cycles_per_day double, degradation_eur_per_mwh double")
    slot = F.col("id")
    prices = spark.range(192).select(F.lit("z").alias("series_id"), F.timestamp_seconds(1704067200 + 900 * slot).cast("timestamp_ntz").alias("ts"),
                                     (50 + 30 * F.sin(slot / 9.0)).alias("price"))
    return assets, prices.withColumn("day", F.to_date("ts"))


def test_schedules_of_one_spec_are_many_tasks(shuffled):
    assets, prices = fleet(shuffled)
    s = dispatch.fleet_dispatch(prices, assets)
    assert s.count() == 192 * 62
    assert tasks_of(s) > 4


def test_checks_move_no_schedule_rows(shuffled):
    assets, prices = fleet(shuffled)
    s = dispatch.fleet_dispatch(prices, assets)
    plan = dispatch.check_schedule(s)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(asset_id" not in plan
    dealt, plain = (sorted(map(str, dispatch.check_schedule(x).collect())) for x in (s, s.drop("_part")))
    assert dealt == plain


def test_subscriptions_of_one_event_are_many_tasks(shuffled):
    events = shuffled.createDataFrame([("e", None, k) for k in range(3)] + [("e", "o", 9), ("f", "o", 4)], "event string, owner string, delivered_at long")
    rows = [(f"s{k}", ["o", "p", None][k % 3], f"u{k}", "e,f" if k % 2 else "e", f"h{k}", int(k % 7 == 0)) for k in range(100)]
    subs = shuffled.createDataFrame([*rows, *rows[:9]], "id string, owner string, url string, events string, secret_hash string, disabled int")
    found = tables.fanout_subscriptions(events, subs)
    wanted = Counter((e, o, t, s) for e, o, t in events.collect() for s, owner, _, listed, _, off in set(rows)
                     if not off and e in listed.split(",") and (o is None or o == owner))
    assert Counter((r.event, r.owner, r.delivered_at, r.subscription_id) for r in found.collect()) == wanted
    assert tasks_of(found) > 8


@pytest.mark.parametrize("places", [0, 4, 6, 9])
def test_rounding_is_that_of_round(spark, places):
    r = random.Random(places)
    x = [None, 0.0, -0.0, math.nan, math.inf, -math.inf, 1e300, 5e-324, -4e-7, -5e-7, 5e-7, 0.8015625, -0.8015625, 999999.9999995, 1e6, 123456789.1234565, 1.0000005]
    for _ in range(3000):
        k = r.randint(-10**12, 10**12)
        x += [k / 1e6, (2 * k + 1) / 2e6, math.nextafter((2 * k + 1) / 2e6, 1e9), r.uniform(-1e7, 1e7), r.gauss(0, 1e-5), k / 2**r.randint(1, 60)]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    text = lambda c: (c + F.lit(0.0)).cast("string")
    assert df.where(~text(round_half_up("x", places)).eqNullSafe(text(F.round("x", places)))).count() == 0


@pytest.mark.parametrize("name", ["j5", "j4_naive"])
def test_naive_plans_move_no_rows(shuffled, name):
    from tidewatt.plans import q_dispatch
    found = getattr(q_dispatch, name)(shuffled, "/root/testdata/sf0.001")
    assert "Exchange hashpartitioning(asset_id" not in found._jdf.queryExecution().executedPlan().toString()
    assert tasks_of(found) > 4
