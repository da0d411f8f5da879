"""The skew-safe helpers against plain windows, with one key holding most of the rows."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evidloom.operators import skew


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    data = [
        ("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", start + dt.timedelta(minutes=rng.randrange(20000)), i,
         rng.choice([None, "a", "b"]), float(rng.choice([1, 1, 1, rng.random()])))
        for i in range(1200)
    ]
    return spark.createDataFrame(data, "key string, at timestamp, id int, tag string, value double").cache()


def test_lag_and_lead(rows):
    w = Window.partitionBy("key").orderBy("at", "id")
    want = rows.select("id", F.lag("tag").over(w).alias("p"), F.lead("id").over(w).alias("n"))
    lagged = skew.lag_rows(rows, ["key"], ["at", "id"], F.to_date("at"), ["tag"])
    both = skew.lead_rows(lagged, ["key"], ["at", "id"], F.to_date("at"), ["id"]).select(
        "id", F.col("prev.tag").alias("p"), F.col("next.id").alias("n"))
    assert sorted(both.collect(), key=repr) == sorted(want.collect(), key=repr)


def test_row_numbers(rows):
    w = Window.partitionBy("key").orderBy("at", "id")
    want = {r.id: r.n for r in rows.select("id", F.row_number().over(w).alias("n")).collect()}
    got = {r.id: r.row_no for r in skew.number_rows(rows, ["key"], ["at", "id"], F.to_date("at")).collect()}
    assert got == want


def test_attach_groups_keeps_null_keys(rows):
    got = skew.attach_groups(rows, ["tag"], n=F.count(F.lit(1)))
    assert got.count() == rows.count()
    assert got.where("tag IS NULL").select("n").distinct().count() == 1


def test_salted_join(spark, rows):
    other = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3)], "key string, x int")
    want = sorted(rows.join(other, "key").select("id", "x").collect())
    assert sorted(skew.salted_join(rows, other, ["key"], ["id"], 7).select("id", "x").collect()) == want


@pytest.mark.parametrize("splits", [2, 64])
def test_exact_percentiles(rows, splits):
    got = {r.key: r for r in skew.exact_percentiles(rows, ["key"], "value", {"p50": .5, "p99": .99}, splits).collect()}
    data = {}
    for r in rows.collect():
        data.setdefault(r.key, []).append(r.value)
    for k, values in data.items():
        assert got[k].n == len(values)
        assert got[k].p50 == pytest.approx(np.percentile(values, 50))
        assert got[k].p99 == pytest.approx(np.percentile(values, 99))


def test_exact_percentiles_without_keys(rows):
    r = skew.exact_percentiles(rows, [], "value", {"p95": .95}).first()
    assert r.p95 == pytest.approx(np.percentile([x.value for x in rows.collect()], 95))


def test_percentile_cuts_are_written_once(rows):
    """Ranks and range totals must not see two evaluations of a sketch, which may differ."""
    for keys in (["key"], []):
        plan = skew.exact_percentiles(rows, keys, "value", {"p50": .5})._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile_approx" not in plan
