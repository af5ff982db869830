"""P-values of the paired tests and the imputation check, against tables and brute force."""

import itertools
import math
from statistics import NormalDist

import numpy as np
import pytest
from basalt.functions import distributions as D
from basalt.functions.ordered import running_sums
from basalt.operators import clean, stats
from pyspark.sql import functions as F


def values(spark, rows, columns, **exprs):
    df = spark.createDataFrame(rows, columns)
    return df.select(*df.columns, *[e.alias(n) for n, e in exprs.items()]).collect()


def test_distribution_functions(spark):
    for r in values(spark, [(z,) for z in (-9.0, -2.5, -0.3, 0.0, 1e-9, 0.7, 1.96, 2.99, 3.01, 6.0, 12.0)], "z double", p=D.normal_tail(F.col("z"))):
        assert r.p == pytest.approx(0.5 * math.erfc(r.z / math.sqrt(2)), rel=1e-10)
    for r in values(spark, [(p,) for p in (1e-12, 0.001, 0.2, 0.5, 0.9, 0.99999)], "p double", z=D.normal_quantile(F.col("p"))):
        assert r.z == pytest.approx(-NormalDist().inv_cdf(r.p), abs=1e-7)
    for r in values(spark, [(x,) for x in (0.05, 0.5, 1.0, 3.7, 30.0, 4000.0)], "x double", g=D.log_gamma(F.col("x")), d=D.digamma(F.col("x"))):
        assert r.g == pytest.approx(math.lgamma(r.x), rel=1e-10, abs=1e-10)
        assert r.d == pytest.approx((math.lgamma(r.x * (1 + 1e-6)) - math.lgamma(r.x * (1 - 1e-6))) / (2e-6 * r.x), rel=1e-5, abs=1e-5)
    # Two-sided critical values of Student's t from the usual table.
    table = [(12.706, 1.0, 0.05), (4.303, 2.0, 0.05), (2.228, 10.0, 0.05), (3.169, 10.0, 0.01), (2.042, 30.0, 0.05), (4.587, 10.0, 0.001), (1.98, 120.0, 0.05), (0.0, 5.0, 1.0)]
    for r in values(spark, table, "t double, n double, told double", p=D.t_two_sided(F.col("t"), F.col("n"))):
        assert r.p == pytest.approx(r.told, rel=2e-3)
    # Kolmogorov's distribution: 5 % at 1.3581, 1 % at 1.6276, and the median 0.8276.
    for r in values(spark, [(1.3581, 0.05), (1.6276, 0.01), (0.82757, 0.5), (0.1, 1.0), (0.9999, 0.27015), (1.0001, 0.2698), (9.0, 0.0)], "x double, told double", p=D.kolmogorov_tail(F.col("x"))):
        assert r.p == pytest.approx(r.told, abs=2e-4)


def brute_signed_rank(d):
    d = [x for x in d if x]
    order = sorted(abs(x) for x in d)
    rank = {a: (order.index(a) + 1 + len(order) - order[::-1].index(a)) / 2 for a in order}
    w = sum(rank[abs(x)] for x in d if x > 0)
    ways = sum(sum(r for r, s in zip((rank[abs(x)] for x in d), signs, strict=True) if s) >= w for signs in itertools.product((0, 1), repeat=len(d)))
    return w, ways / 2 ** len(d)


@pytest.mark.parametrize("parts", [1, 9])
def test_wilcoxon_against_all_sign_patterns(spark, parts):
    rng = np.random.default_rng(1)
    groups = {n: (rng.integers(-4, 6, n) if n % 2 else rng.normal(0.3, 1, n).round(3)).tolist() for n in (5, 6, 9, 12, 15, 16)} | {2: [1.0, 2.0], 3: [0.0] * 8}
    groups[20] = [*range(1, 19), -19, -20]
    rows = [(g if g != 9 else None, float(10 + i), float(10 + i + x)) for g, d in groups.items() for i, x in enumerate(d)] + [(5, None, 1.0)]
    got = {r.g: r for r in stats.wilcoxon_test(spark.createDataFrame(rows, "g int, a double, b double").repartition(parts), "a", "b", by=("g",)).collect()}
    for g, d in groups.items():
        r = got[g if g != 9 else None]
        d = [round(x, 6) for x in d]
        assert r.n_pairs == len(d) and r.n == sum(x != 0 for x in d) and r.mean_lift == pytest.approx(sum(d) / len(d), abs=1e-4)
        if r.n < 5:
            assert (r.w_plus, r.p_value, r.effect_size_r, r.significance) == (0.0, 0.5, 0.0, "insufficient")
            continue
        w, p = brute_signed_rank(d)
        assert r.w_plus == pytest.approx(w) and r.p_value == pytest.approx(p, abs=1e-6)
        assert r.effect_size_r == pytest.approx(abs(NormalDist().inv_cdf(1 - p)) / math.sqrt(r.n) if 0 < p < 1 else 0, abs=2e-3)
        assert r.significance == ("***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else "ns")
    one = stats.wilcoxon_test(spark.createDataFrame([(0.0, float(x)) for x in groups[20]], "a double, b double"), "a", "b").first()
    assert (one.n, one.p_value) == (20, got[20].p_value)


def test_wilcoxon_exact_and_normal_agree_at_the_limit(spark):
    rng = np.random.default_rng(2)
    d = rng.normal(0.2, 1, 51).round(4).tolist()
    frame = lambda x: spark.createDataFrame([(0.0, v) for v in x], "a double, b double")
    exact, normal = (stats.wilcoxon_test(frame(x), "a", "b").first() for x in (d[:50], d))
    assert exact.n == 50 and normal.n == 51 and abs(exact.p_value - normal.p_value) < 0.03


def test_paired_t(spark):
    rows = [("same", 2.0, 2.0)] * 4 + [("shift", float(i), i + 0.5) for i in range(6)] + [("one", 1.0, 2.0), ("noisy", 10.0, 12.0), ("noisy", 11.0, 12.0), ("noisy", 9.0, 12.0), ("noisy", 10.0, 10.5), ("noisy", None, 1.0)]
    rows += [("worse", 5.0 + i % 3, 2.0 + i % 2) for i in range(12)]
    out = {r.g: r for r in stats.paired_t_test(spark.createDataFrame(rows, "g string, a double, b double"), "a", "b", by=("g",)).collect()}
    assert (out["same"].p_value, out["same"].verdict) == (1.0, "no difference shown")
    assert (out["shift"].p_value, out["shift"].is_significant, out["shift"].verdict) == (0.0, True, "b is better")
    assert out["one"].p_value == 1.0 and out["one"].t is None
    d = np.array([2.0, 1.0, 3.0, 0.5])
    t = d.mean() / (d.std(ddof=1) / 2)
    assert out["noisy"].n == 4 and out["noisy"].t == pytest.approx(t, abs=1e-4) and out["noisy"].p_value == pytest.approx(stats.t_p(t, 3), abs=1e-6)
    assert out["noisy"].b_wins == 4 and out["noisy"].lift_pct == pytest.approx(100 * d.mean() / 10, abs=0.01)
    assert (out["worse"].is_significant, out["worse"].verdict) == (False, "b is worse")


def test_paired_t_is_the_same_for_any_partitioning(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(1e3, 7, (5000, 2))], "a double, b double")
    assert len({tuple(stats.paired_t_test(df.repartition(n), "a", "b").first()) for n in (1, 3, 16)}) == 1


@pytest.mark.parametrize("parts", [1, 8])
def test_running_sums_in_groups(spark, parts):
    rng = np.random.default_rng(5)
    told = {(g, v): int(n) for g, v, n in zip(rng.choice(["a", "b", "c"], 3000, p=[0.9, 0.09, 0.01]), rng.integers(0, 10**6, 3000).tolist(), rng.integers(1, 9, 3000), strict=True)}
    rows = [(None if g == "c" else str(g), v if v > 300 else None, n) for (g, v), n in told.items()]
    rows = list({(g, v): (g, v, n) for g, v, n in rows}.values())
    got = running_sums(spark.createDataFrame(rows, "g string, v long, n long").repartition(parts), "v", ["n"], by=("g",)).collect()
    assert len(got) == len(rows)
    for r in got:
        own = [x for x in rows if x[0] == r.g]
        assert r.n_total == sum(x[2] for x in own)
        assert r.n_before == sum(x[2] for x in own if (-1 if x[1] is None else x[1]) < (-1 if r.v is None else r.v))


def test_imputation_check_in_one_pass(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3)).round(3)
    rows = [(float(a), None if i % 50 == 0 else float(b), None if i % 2 else float(c), None if i > 8 else 1.0, None) for i, (a, b, c) in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, few double, none double")
    out = {r.column_name: r for r in clean.Imputer.fit(df, df.columns).check(df).collect()}
    assert sorted(out) == ["a", "b", "c"]  # the others have ten values at most
    for c, i in (("a", 0), ("b", 1), ("c", 2)):
        valid = np.sort([r[i] for r in rows if r[i] is not None])
        filled = np.sort([r[i] if r[i] is not None else float(np.median(valid)) for r in rows])
        at = np.unique(filled)
        gap = np.abs(np.searchsorted(valid, at, "right") / len(valid) - np.searchsorted(filled, at, "right") / len(filled)).max()
        assert out[c].ks_stat == pytest.approx(gap, abs=1e-4) and out[c].n_valid == len(valid) and out[c].n_filled == 400
        assert out[c].p_value == pytest.approx(clean.ks_p_value(gap, len(valid), 400), abs=1e-3)
        assert out[c].is_preserved == (c != "c")
