import math
import random
import statistics

from opsight.operators.quantiles import order_statistics


def test_every_group_size_matches_sorted_lists(spark):
    random.seed(7)
    groups = {
        f"g{n}": [round(random.choice([1, -1]) * random.lognormvariate(3, 3), 3) for _ in range(n)]
        for n in [*range(1, 70), 100, 259, 300]
    }
    groups["equal"] = [5.0] * 41
    groups["zero"] = [0.0, -0.0, 0.0]
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    rows = rows.unionByName(spark.createDataFrame([("g1", None), ("g2", float("nan"))], "k string, v double"))
    for rule in ("nearest", "ceiling"):
        found = {r["k"]: r for r in order_statistics(rows, ["k"], "v", p95=rule).collect()}
        assert set(found) == set(groups)
        for key, values in groups.items():
            ordered, n = sorted(values), len(values)
            at = round((n - 1) * 0.95) if rule == "nearest" else max(0, math.ceil(0.95 * n) - 1)
            row = found[key]
            assert row["count"] == n
            assert row["p95"] == ordered[at], key
            assert math.isclose(row["median"], statistics.median(ordered), rel_tol=1e-12, abs_tol=1e-12)
            assert (row["minimum"], row["maximum"]) == (ordered[0], ordered[-1])
            assert math.isclose(row["total"], sum(values), rel_tol=1e-9, abs_tol=1e-9)


def test_weights_and_no_keys(spark):
    rows = spark.createDataFrame([(1.0, 3), (2.0, 1), (9.0, 1)], "v double, n int")
    row = order_statistics(rows, [], "v", weight="n").first()
    assert (row["count"], row["median"], row["p95"], row["total"]) == (5, 1.0, 9.0, 14.0)


def test_no_values_give_no_group(spark):
    assert order_statistics(spark.createDataFrame([], "k string, v double"), ["k"], "v").count() == 0


def test_one_group_with_most_rows_is_spread_over_buckets(spark):
    rows = spark.range(100_000).selectExpr("'hot' as k", "id / 7.0 as v")
    row = order_statistics(rows, ["k"], "v").first()
    assert row["count"] == 100_000
    assert math.isclose(row["median"], 99_999 / 2 / 7)
    assert math.isclose(row["p95"], round(99_999 * 0.95) / 7)


def test_one_bucket_with_all_values_is_cut_until_it_is_small(spark, monkeypatch):
    """All durations lie within 0.1 percent; with tiny limits several rounds are needed."""
    from opsight.operators import quantiles

    rounds = []
    sliced = quantiles._sliced
    monkeypatch.setattr(quantiles, "_sliced", lambda *args: rounds.append(1) or sliced(*args))
    rows = spark.range(60_000).selectExpr("'hot' as k", "1000 + id / 1e5 as v").unionByName(spark.createDataFrame([("few", 3.0), ("few", 1.0)], "k string, v double"))
    values = sorted(1000 + n / 1e5 for n in range(60_000))
    for most, slices, least in ((10_000, 4096, 1), (50, 16, 3)):
        rounds.clear()
        monkeypatch.setattr(quantiles, "MOST_SORTED_VALUES", most)
        monkeypatch.setattr(quantiles, "SLICES", slices)
        found = {r["k"]: r for r in order_statistics(rows, ["k"], "v").collect()}
        assert len(rounds) >= least
        assert (found["hot"]["count"], found["few"]["median"], found["few"]["p95"]) == (60_000, 2.0, 3.0)
        assert math.isclose(found["hot"]["median"], (values[29_999] + values[30_000]) / 2, rel_tol=1e-15)
        assert found["hot"]["p95"] == values[round(59_999 * 0.95)]
