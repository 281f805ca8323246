"""Hand-table tests for the traps listed in the survey (day floors, qcut
bins, rule tables, ABC edges, interval edges, return-rate steps, NaN)."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cohortkit.functions.core import whole_days
from cohortkit.operators import clean as C
from cohortkit.operators import scores as S
from cohortkit.operators import series as T


def test_days_floor(spark):
    base = datetime(2020, 1, 2)
    rows = [(base, base - timedelta(hours=5)), (base, base), (base, base + timedelta(hours=23, minutes=59, seconds=59)),
            (base, base + timedelta(hours=24))]
    df = spark.createDataFrame(rows, "s timestamp_ntz, e timestamp_ntz")
    assert [r[0] for r in df.select(whole_days("s", "e")).collect()] == [-1, 0, 0, 1]


def test_qcut12_sizes(spark):
    df = spark.createDataFrame([(str(i).zfill(2), float(i)) for i in range(1, 13)], "customer_id string, x double")
    s1 = S.qcut_score(df, "x", "s").collect()
    assert sorted(Counter(r.s for r in s1).values()) == sorted([3, 2, 2, 2, 3])
    assert [Counter(r.s for r in s1)[b] for b in range(1, 6)] == [3, 2, 2, 2, 3]
    s2 = S.rank_qcut_score(df, "x", "s").collect()
    assert [Counter(r.s for r in s2)[b] for b in range(1, 6)] == [3, 2, 2, 2, 3]


def test_qcut_ties_raise_and_collapse(spark):
    vals = [1.0] * 8 + [2.0, 3.0]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(vals)], "customer_id string, x double")
    with pytest.raises(Exception):
        S.qcut_score(df, "x", "s").collect()
    got = {r.x: r.s for r in S.qcut_score(df, "x", "s", on_ties="collapse").collect()}
    assert got[1.0] == 1 and got[2.0] == got[3.0] == 2  # edges 1,1,1,1,1.2,3


def test_rank_score_ties_by_customer_id(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 1.0), ("d", 1.0), ("e", 1.0)], "customer_id string, x double")
    got = {r.customer_id: r.s for r in S.rank_qcut_score(df, "x", "s").collect()}
    assert [got[c] for c in "abcde"] == [1, 2, 3, 4, 5]


def _codes(spark):
    codes = [f"{r}{f}{m}" for r in range(1, 6) for f in range(1, 6) for m in range(1, 6)]
    return spark.createDataFrame([(c,) for c in codes], "RFM_Score string")


def test_codes125_first_match(spark):
    got = Counter(r.segment for r in S.assign_segment(_codes(spark)).collect())
    assert got == {"Potential Customers": 36, "Recent Customers": 24, "Non Active": 9, "Champions": 8,
                   "Loyal Customers": 8, "Potential Loyalists": 8, "Occasional Customers": 8, "Nearly Lost": 7,
                   "Need Attention": 6, "New Customers": 6, "Risky Customers": 4, "Other": 1}
    other = [r.RFM_Score for r in S.assign_segment(_codes(spark)).collect() if r.segment == "Other"]
    assert other == ["315"]


def test_codes125_last_match(spark):
    got = Counter(r.segment for r in S.assign_segment(_codes(spark), S.APP_RULES, mode="last", match="prefix",
                                                      default=S.APP_DEFAULT).collect())
    assert got == {"Loyal Customers": 45, "At Risk": 22, "Other / Unassigned": 22, "New Customers": 12, "Lost": 8,
                   "Cant Lose Them": 8, "Big Spenders": 8}


def test_replace_keeps_code(spark):
    df = spark.createDataFrame([("315",), ("555",)], "RFM_Score string")
    got = {r.RFM_Score: r.segment for r in S.assign_segment(df, S.SCRIPT_RULES, match="search", default=None).collect()}
    assert got == {"315": "315", "555": "Champions"}


def _orders(spark, rows):
    return spark.createDataFrame(rows, "customer_id string, order_total double")


def test_abc_edges(spark):
    got = {r.customer_id: r.segment for r in S.abc(_orders(spark, [("a", 80.0), ("b", 15.0), ("c", 5.0)])).collect()}
    assert got == {"a": "A", "b": "B", "c": "C"}
    zero = S.abc(_orders(spark, [("a", 0.0), ("b", 0.0)])).collect()
    assert {r.segment for r in zero} == {"C"} and {r.cumulative_pct for r in zero} == {0.0}
    one = S.abc(_orders(spark, [("a", 10.0)])).collect()
    assert one[0].segment == "A" and one[0].cumulative_pct == 1.0


def test_interval_edges(spark):
    pts = [datetime(2020, 1, 1), datetime(2020, 1, 3, 12), datetime(2020, 1, 6), datetime(2020, 1, 8, 12),
           datetime(2020, 1, 11), datetime(2019, 12, 31)]
    df = spark.createDataFrame([(str(i), str(i), t, 1.0) for i, t in enumerate(pts)],
                               "customer_id string, order_id string, order_date timestamp_ntz, order_total double")
    t0 = int((datetime(2020, 1, 1) - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    bounds = spark.createDataFrame([(t0, 10 * 86_400_000_000, 4)], "_t0 long, _span long, _n int")
    got = {r.customer_id: r.interval for r in T.assign_interval(df, bounds).collect()}
    assert [got.get(str(i)) for i in range(6)] == [0, 0, 1, 2, 3, None]


def test_return_rate_steps(spark):
    rates = [0.0, 0.02, 0.021, 0.05, 0.051, 0.1, 0.2, 0.21]
    df = spark.createDataFrame([(r,) for r in rates], "r double")
    got = [round(x[0], 6) for x in df.select(T.return_rate_score(F.col("r"))).collect()]
    assert got == [9.0, 8.5, 7.79, 7.5, 6.245, 6.0, 4.0, 2.0]


def test_returns_only_interval(spark):
    rows = [("c", "1", datetime(2020, 1, 2), -5.0, 0, datetime(2020, 1, 5)),
            ("c", "2", datetime(2020, 1, 3), -7.0, 0, datetime(2020, 1, 5))]
    df = spark.createDataFrame(rows, "customer_id string, order_id string, order_date timestamp_ntz, "
                                     "order_total double, interval int, interval_end timestamp_ntz")
    r = T.lrfms_long(df, 3, compute_s=True).collect()[0]
    assert (r.L, r.R, r.F, r.M, r.S) == (0.0, 0.0, 0.0, 0.0, 2.0)


def test_month_gap_carry_forward(spark):
    rows = [("c", "1", datetime(2020, 1, 10), 5.0), ("c", "2", datetime(2020, 4, 20), 7.0)]
    o = spark.createDataFrame(rows, "customer_id string, order_id string, order_date timestamp_ntz, order_total double")
    m = T.monthly_lrfm(o)
    filled = {r.month.month: r for r in T.fill_series(T.month_spine(m), m).collect()}
    assert sorted(filled) == [1, 2, 3, 4]
    assert filled[2].F == 0.0 and filled[2].R_prime == 50.0  # Jan 10 -> Feb 29 end
    assert filled[1].R_prime == 21.0 and filled[4].R_prime == 10.0


def test_nan_rows(spark):
    vals = [None, float("nan"), -1.0, 0.0, 1.0]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(vals)], "customer_id string, order_total double")
    from cohortkit.functions.core import nan_to_null
    df = df.withColumn("order_total", nan_to_null("order_total"))
    assert [r.customer_id for r in C.drop_negative_rows(df).collect()] == ["0", "1", "3", "4"]
    assert [r.customer_id for r in C.strip_zero_total(df).collect()] == ["4"]
    assert [r.customer_id for r in C.strip_zero_total(df, returns_mode=True).collect()] == ["0", "1", "2", "4"]
