"""Bags, out-of-bag votes and permutations of the forest."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasol.operators import forest as T
from terrasol.operators import ranks as R


def test_ranks_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(R, "RANGE_ROWS", 7)
    rows = [("a" if i % 3 else None, i * 7919 % 101, i) for i in range(100)] + [("b", 5, 1)] * 9
    df = spark.createDataFrame(rows, "g string, v int, w int").repartition(6)
    got = sorted((r["rank"], r.v, r.n) for r in R.ranked(df, ["v"]).collect())
    assert got == [(i, v, 109) for i, v in enumerate(sorted(r[1] for r in rows))]
    per = R.ranked(df, ["v", "w"], by=("g",)).collect()
    for g in ("a", None, "b"):
        mine = sorted((r["rank"], r.v) for r in per if r.g == g)
        assert mine == [(i, v) for i, v in enumerate(sorted(r[1] for r in rows if r[0] == g))]
    heavy = R.ranked(spark.createDataFrame([(3, 2), (1, 5), (2, 1)], "v int, w bigint"), ["v"], weight="w").collect()
    assert sorted((r.v, r["rank"], r.n) for r in heavy) == [(1, 0, 8), (2, 5, 8), (3, 6, 8)]
    assert R.ranked(df.limit(0), ["v"]).count() == 0


def test_permutation_is_the_same_at_any_partitioning(spark, monkeypatch):
    monkeypatch.setattr(R, "RANGE_ROWS", 16)
    df = spark.createDataFrame([(i, i * 3) for i in range(200)], "key int, v int")
    one, two = (dict(map(tuple, R.permuted(d, ["v"], "key", 5).select("v", "_p_v").collect())) for d in (df.coalesce(1), df.repartition(13)))
    by_hash = sorted(range(200), key=lambda k: hashlib.md5(f"5:{k}".encode()).hexdigest())
    assert one == two == {3 * i: 3 * by_hash[i] for i in range(200)}
    assert R.permuted(df, ["v"], "key", 6).where("v = _p_v").count() < 10


def test_poisson_counts():
    for rate in (0.3, 1.0, 40.0):
        bounds = T.poisson_limits(rate)
        shares = [(b - a) / 2**32 for a, b in zip([0, *bounds], bounds)]
        assert abs(sum(k * p for k, p in enumerate(shares)) - rate) < 1e-5 and abs(shares[0] - math.exp(-rate)) < 1e-8


@pytest.fixture(scope="module")
def points(spark):
    # class 1 above the line; a second feature says nothing
    rows = [(i, int(i * 37 % 400 > 300), i * 37 % 400 / 400, i * 91 % 400 / 400) for i in range(400)]
    return spark.createDataFrame(rows + [(400, 1, None, 0.5), (401, None, 0.5, 0.5)], "key int, label int, x double, noise double")


def test_bags_votes_and_importance(spark, points):
    forest = T.train_bagged(points, ["x", "noise"], trees=12, depth=4)
    draws = points.na.drop().select("label", *(T.times_drawn(F.col("key"), F.col("label"), t, forest.limits).alias(f"t{t}") for t in range(12))).collect()
    mean = [sum(r[t + 1] for r in draws if r.label == k) / 12 for k in (0, 1) for t in range(12)]
    assert all(abs(sum(mean[12 * k : 12 * k + 12]) / 200 - 1) < 0.1 for k in (0, 1))  # classes weigh alike in the bags
    votes = T.oob_votes(forest, points).collect()
    assert len(votes) == 400
    unseen = {k.key: k for k in points.na.drop().select("key", *(T.times_drawn(F.col("key"), F.col("label"), t, forest.limits).alias(f"t{t}") for t in range(12))).collect()}
    assert all(r.votes == sum(unseen[r.key][t + 1] == 0 for t in range(12)) for r in votes)
    error = T.oob_error(T.oob_votes(forest, points)).first()
    assert error.brier < 0.05 and error.accuracy > 0.93 and error.n == sum(r.votes > 0 for r in votes)
    importance = {r.feature: r.importance for r in T.oob_importance(forest, points).collect()}
    assert importance["x"] > 0.2 and abs(importance["noise"]) < 0.05
    again = T.train_bagged(points.repartition(5), ["x", "noise"], trees=12, depth=4)
    assert {(r.key, r.votes) for r in T.oob_votes(again, points).collect()} == {(r.key, r.votes) for r in votes}


def test_all_trees_share_their_passes(spark, points):
    def jobs(trees):
        spark.sparkContext.setJobGroup(f"trees{trees}", "")
        T.train_bagged(points, ["x", "noise"], trees=trees, depth=3)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trees{trees}"))

    few, many = jobs(2), jobs(10)
    spark.sparkContext._jsc.clearJobGroup()
    assert many <= few + 6  # a tree may have a level more, never jobs of its own


def test_bagged_trees_split_where_the_gain_is_greatest(spark):
    rows = [(i, int(i * 37 % 60 > 40) if i % 9 else 1, float(i * 37 % 60 // 6)) for i in range(300)]
    forest = T.train_bagged(spark.createDataFrame(rows, "key int, label int, x double"), ["x"], trees=5, depth=1)
    draws = T.bag_draws([str(r[0]) for r in rows], np.array([r[1] for r in rows]), 5, forest.limits, 42)
    df = spark.createDataFrame(rows, "key int, label int, x double")
    asked = df.select("key", F.array(*(T.times_drawn(F.col("key"), F.col("label"), t, forest.limits) for t in range(5))).alias("d")).orderBy("key").collect()
    assert [list(r.d) for r in asked] == draws.tolist()
    gini = lambda some: 2 * sum(w for w, y in some if y) * sum(w for w, y in some if not y) / max(sum(w for w, _ in some), 1)
    for t in range(5):
        bag = [(int(d[t]), r[1], r[2]) for d, r in zip(draws, rows)]
        loss = {b: gini([(w, y) for w, y, x in bag if x <= b]) + gini([(w, y) for w, y, x in bag if x > b]) for b in range(9)}
        best = min(loss, key=loss.get)
        assert forest.split[t, 0] == 0 and forest.bounds[0][forest.upto[t, 0]] == best
        left = [(w, y) for w, y, x in bag if x <= best]
        assert abs(forest.p[t, 1] - sum(w for w, y in left if y) / sum(w for w, _ in left)) < 1e-12
