"""Order statistics by narrowing against NumPy and plain sorting."""

import random

import numpy as np
import pytest

from cohortkit.operators import selection as S
from cohortkit.operators.scores import rank_qcut_score


def tables(seed):
    r = np.random.default_rng(seed)
    n = 4000
    yield r.normal(size=n)
    yield np.where(r.random(n) < .4, 7.0, np.round(r.exponential(size=n), 2))   # one value on a large share of rows
    yield np.concatenate([np.zeros(n - 3), [1e300, -1e300, 5e-324]])
    yield np.arange(5.0)
    yield np.full(9, 2.5)


@pytest.mark.parametrize("few,accuracy", [(2000, 10_000), (3, 50)])
def test_quantiles(spark, monkeypatch, few, accuracy):
    monkeypatch.setattr(S, "FEW", few)
    monkeypatch.setattr(S, "ACCURACY", accuracy)
    probs = [0.0, 0.013, 0.25, 0.5, 0.9, 0.99, 1.0]
    for x in tables(1):
        y = np.random.default_rng(2).permutation(x) * 2
        df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, float("nan"))], "x double, `y z` double")
        got = S.quantiles(df, ["x", "y z"], probs)
        with np.errstate(over="ignore", invalid="ignore"):
            assert got["x"] == pytest.approx(np.quantile(x, probs).tolist(), rel=1e-12)
            assert got["y z"] == pytest.approx(np.quantile(y, probs).tolist(), rel=1e-12)
    assert S.quantiles(df.limit(0), ["x"], [0.5]) == {"x": [None]}


@pytest.mark.parametrize("few", [2000, 2])
def test_rank_bins(spark, monkeypatch, few):
    monkeypatch.setattr(S, "FEW", few)
    r = random.Random(3)
    names = list({r.choice(["é", "c", "c", "10", "A b"]) + str(r.randrange(900)) for _ in range(600)})
    rows = [(i, r.choice([1.0, 1.0, 2.0, 5.5, None, float("nan")])) for i in names]
    df = spark.createDataFrame(rows, "customer_id string, x double")
    got = {x.customer_id: x.s for x in rank_qcut_score(df, "x", "s").collect()}
    key = lambda t: (t[1] is not None, t[1] != t[1] if t[1] is not None else False, t[1] or 0, t[0].encode())
    n = len(rows)
    want = {t[0]: max(1, -(-5 * i // (n - 1))) for i, t in enumerate(sorted(rows, key=key))}
    assert got == want


def test_rank_bins_of_one_customer_and_none(spark):
    df = spark.createDataFrame([("a", 1.0)], "customer_id string, x double")
    assert [r.s for r in rank_qcut_score(df, "x", "s").collect()] == [1]
    assert rank_qcut_score(df.limit(0), "x", "s").count() == 0


def test_no_exchange_of_the_table(spark):
    df = spark.range(5000).selectExpr("CAST(id AS STRING) AS customer_id", "CAST(id % 7 AS DOUBLE) AS x")
    plan = rank_qcut_score(df, "x", "s")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
