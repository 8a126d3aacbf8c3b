"""Medians of shuffled groups and random signs: the drawn distribution against all shuffles, closed forms, and edge cases."""

import itertools
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import resampling, stats


def test_every_order_is_equally_likely():
    seen = Counter()
    for rep in range(12_000):
        drawn = resampling.Arrangement((2, 3), np.random.default_rng([5, rep]))
        places = tuple(drawn.place(0, k) for k in (1, 0)) + tuple(drawn.place(1, k) for k in (2, 0, 1))
        assert sorted(places) == [*range(5)] and places[1] < places[0] and places[3] < places[4] < places[2]
        seen[places] += 1
    assert len(seen) == 10
    # chi-squared with 9 degrees of freedom: 27.9 is its 0.999 quantile
    assert sum((n - 1_200) ** 2 / 1_200 for n in seen.values()) < 27.9


def test_order_statistics_of_large_groups_have_their_moments():
    n, k = 10_000_000_000, 4_000_000_000
    places = [resampling.Arrangement((k, n - k), np.random.default_rng([1, r])).place(0, k // 2 - 1) for r in range(2_000)]
    # the j-th least of k places out of n: mean j (n + 1) / (k + 1)
    j = k // 2
    mean = j * (n + 1) / (k + 1) - 1
    sd = (j * (n + 1) * (n - k) * (k + 1 - j) / ((k + 1) ** 2 * (k + 2))) ** 0.5
    assert abs(np.mean(places) - mean) < 4 * sd / 2_000**0.5
    assert np.std(places) == pytest.approx(sd, rel=0.08)


def test_medians_follow_all_shuffles_and_all_signs(spark):
    v, g = [1.0, 1.0, 2.5, 4.0, 7.0, 7.5, 9.0], [True, False, True, False, True, False, False]
    df = spark.createDataFrame([*zip(g, v)], "g boolean, v double").repartition(3)
    observed, shuffled = resampling.group_medians(df, 6_000, 3)
    assert observed.first().observed == statistics.median([1.0, 2.5, 7.0]) - statistics.median([1.0, 4.0, 7.5, 9.0])
    got = Counter(r.s for r in shuffled.collect())
    every = Counter()
    for chosen in itertools.combinations(range(7), 3):
        every[statistics.median(v[i] for i in chosen) - statistics.median(v[i] for i in range(7) if i not in chosen)] += 1 / 35
    assert {*got} == {*every} and all(abs(got[s] / 6_000 - p) < 4.5 * (p / 6_000) ** 0.5 for s, p in every.items())

    d = [-3.0, 1.0, 1.0, 2.0, -0.5, 0.0]
    observed, signed = resampling.signed_medians(spark.createDataFrame([(x,) for x in d], "v double"), 6_000, 3)
    assert observed.first().observed == statistics.median(d)
    got, every = Counter(r.s for r in signed.collect()), Counter()
    for signs in itertools.product((-1, 1), repeat=6):
        every[statistics.median(s * x for s, x in zip(signs, d))] += 1 / 64
    assert {*got} == {*every} and all(abs(got[s] / 6_000 - p) < 4.5 * (p / 6_000) ** 0.5 for s, p in every.items())


def test_missing_groups_nulls_and_empty_tables(spark):
    rows = [(None, 5.0), (True, None), (True, 1.0), (True, 2.0)]
    df = spark.createDataFrame(rows, "g boolean, v double")
    assert tuple(stats.permutation_median_test(df, F.col("g"), "v", 9, 1).first()) == (None, 0, 0.1)
    assert stats.permutation_median_test(df.where("v > 9"), F.col("g"), "v", 9, 1).count() == 0
    assert stats.sign_flip_test(df.where("v > 9"), "v", 9).count() == 0
    assert tuple(stats.sign_flip_test(df.where("v = 1"), "v", 9).first()) == (1.0, 9, 1.0)
    same = {tuple(stats.permutation_median_test(df.selectExpr("v > 1 as g", "v").repartition(k), F.col("g"), "v", 99, 4).first()) for k in (1, 5)}
    assert len(same) == 1
