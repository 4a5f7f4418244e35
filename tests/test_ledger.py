"""Ledger operators on the reference's small frames (FIXTURES.md goldens)."""

import datetime as dt

import pytest

from conftest import CACHE_ROWS, CHART_ROWS, ledger_df
from ledgerlens.functions import exprs as X
from ledgerlens.operators import aggregates as A
from ledgerlens.operators import filters as FL
from ledgerlens.operators import profile as PR
from ledgerlens.operators import series as S
from ledgerlens.sources.ledger import MissingColumnsError, validate_columns


def test_category_parse(spark):
    df = spark.createDataFrame([("RENT_HOUSING",), ("A_B_C",), ("NOUNDERSCORE",), ("A_",),
                                ("_A",), (None,)], "c string")
    got = df.select(X.parent_category("c").alias("p"), X.subcategory("c").alias("s")).collect()
    assert [(r.p, r.s) for r in got] == [
        ("HOUSING", "RENT"), ("C", "A_B"), ("OTHER", "NOUNDERSCORE"), ("", "A"),
        ("A", ""), (None, None)]


def test_cents_rounds_like_python(spark):
    vals = [2806.625, 2.675, 0.125, 616.6666666, 1241.665, -3.335]
    got = [r.v for r in spark.createDataFrame([(v,) for v in vals], "x double")
           .select(X.cents("x").alias("v")).collect()]
    assert got == [round(v, 2) for v in vals]


def test_currency_text(spark):
    got = [r.v for r in spark.createDataFrame([(1850.0,), (-5200.5,), (0.125,)], "x double")
           .select(X.currency("x").alias("v")).collect()]
    assert got == ["$1,850.00", "-$5,200.50", "$0.12"]


def test_missing_columns(spark):
    with pytest.raises(MissingColumnsError):
        validate_columns(spark.createDataFrame([(1,)], "user_id int"))


def test_profile_alice(spark):
    prof = {r.user_id: r for r in PR.profiles(ledger_df(spark, CACHE_ROWS)).collect()}
    a = prof["usr_001"]
    assert a.n_rows == 6 and a.user_name == "Alice"
    assert (a.first_date, a.last_date) == (dt.date(2025, 1, 1), dt.date(2025, 3, 15))
    assert float(a.total_expense) == 1850 and float(a.total_income_signed) == -10000
    assert a.avg_monthly_spend == 616.67
    assert [(c.name, float(c.total)) for c in a.top_categories] == [("HOUSING", 1600), ("FOOD", 250)]


def test_avg_monthly_half_even(spark):
    # 22453 spread over 8 months -> mean 2806.625 -> 2806.62 (not .63)
    rows = [("u", "U", f"2025-{m:02d}-01", 2806, "RENT_HOUSING", "M") for m in range(5, 12)]
    rows.append(("u", "U", "2025-12-31", 22453 - 7 * 2806, "RENT_HOUSING", "M"))
    r = S.avg_monthly_spend(ledger_df(spark, rows)).collect()[0]
    assert r.avg_monthly_spend == 2806.62


def test_monthly_trend_and_rolling(spark):
    t = S.monthly_trend(ledger_df(spark, CHART_ROWS), months=6).orderBy("month").collect()
    assert [float(r.total) for r in t] == [1600, 250, 1875, 1700]
    assert [r.label for r in t] == ["Jan 2025", "Feb 2025", "Mar 2025", "Apr 2025"]
    assert t[0].avg3 == 1600 and t[1].avg3 == 925
    assert t[2].avg3 == pytest.approx(1241.6666666) and t[3].avg3 == 1275


def test_trend_needs_three_months_for_avg(spark):
    t = S.monthly_trend(ledger_df(spark, CHART_ROWS), months=1).collect()
    assert all(r.avg3 is None for r in t)


def test_trend_category_filter_zero_fills(spark):
    t = S.monthly_trend(ledger_df(spark, CHART_ROWS), months=6, category="food") \
        .orderBy("month").collect()
    assert [float(r.total) for r in t] == [100, 250, 0, 200]
    assert t[0].title == "Monthly Spending Trend — Food"


def test_income_vs_expense(spark):
    t = S.income_vs_expense(ledger_df(spark, CHART_ROWS), months=6).orderBy("month").collect()
    assert [float(r.income) for r in t] == [5000, 5000, 0, 5000]
    assert [float(r.net) for r in t] == [3400, 4750, -1875, 3300]


def test_breakdown_top2_other_last(spark):
    b = A.category_breakdown(ledger_df(spark, CHART_ROWS), "all", 2).orderBy("slice_order").collect()
    assert [(r.category, float(r.amount)) for r in b] == [
        ("HOUSING", 4500), ("FOOD", 550), ("Other", 375)]
    assert b[-1].is_other and sum(r.pct for r in b) == pytest.approx(100)


def test_breakdown_period_and_no_other(spark):
    b = A.category_breakdown(ledger_df(spark, CHART_ROWS), "last_1_month", 7).collect()
    # cutoff 2025-03-20 inclusive: 75 ENT, 1500 HOUSING, 200 FOOD
    assert sorted((r.category, float(r.amount)) for r in b) == [
        ("ENTERTAINMENT", 75), ("FOOD", 200), ("HOUSING", 1500)]
    assert not any(r.is_other for r in b)


def test_breakdown_rejects_negative_top_n(spark):
    with pytest.raises(ValueError):
        A.category_breakdown(ledger_df(spark, CHART_ROWS), "all", -1)


def test_lookback_keeps_income_reference(spark):
    # an income row sets the reference date: cutoff = 2025-05-31 - 1 month = 2025-04-30
    rows = CHART_ROWS + [("usr_test", "Test User", "2025-05-31", -10, "REFUND_INCOME", "Shop")]
    r = FL.lookback_rows(ledger_df(spark, rows), 1).collect()
    assert [x.transaction_date for x in r] == [dt.date(2025, 5, 31)]
    assert r[0].cutoff_date == dt.date(2025, 4, 30)


def test_owners_without_data(spark):
    rows = CACHE_ROWS + [("usr_003", "Carol", "2025-03-01", -100, "REFUND_INCOME", "Shop")]
    none = S.owners_without_data(ledger_df(spark, rows), 1).collect()
    assert [r.user_id for r in none] == ["usr_003"]


def test_text_summary(spark):
    t = {r.user_id: r.text_summary for r in PR.text_summaries(ledger_df(spark, CACHE_ROWS)).collect()}
    lines = t["usr_001"].split("\n")
    assert lines[0] == "Total rows: 6"
    assert lines[2] == "Total expenses: $1,850.00 (4 transactions)"
    assert lines[3] == "Total income: $10,000.00 (2 transactions)"
    assert lines[4] == "Top expense categories: HOUSING ($1,600.00), FOOD ($250.00)"
    assert lines[-1] == "Most recent transaction: 2025-03-15"


def test_data_summary_keys(spark):
    rows = PR.summary_rows(ledger_df(spark, CACHE_ROWS)).collect()
    ds = {(r.user_id, r.key): r.value for r in rows}
    assert ds[("usr_001", "total_expense")] == 1850.0
    assert ds[("usr_001", "total_income")] == 10000.0
    assert ds[("usr_001", "avg_expense")] == 462.5
    assert ds[("usr_001", "month_2025_02")] == 250.0
    assert ds[("usr_001", "category_FOOD")] == 250.0
    assert ds[("usr_001", "merchant_AvalonBay")] == 1600.0
    text = {(r.user_id, r.key): r.text for r in rows}
    assert (text[("usr_001", "date_range_start")], text[("usr_001", "date_range_end")]) == ("2025-01-01", "2025-03-15")


def test_plan_pushes_owner_filter(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger_df(spark, CACHE_ROWS).write.parquet(path)
    from ledgerlens.sources.ledger import load_parquet
    plan = FL.for_user(load_parquet(spark, path), "usr_001").select("transaction_amount") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,usr_001)]" in plan


def test_csv_loader_and_dq(spark, tmp_path):
    from ledgerlens.sources.ledger import dq_counts, load_csv
    p = tmp_path / "tx.csv"
    p.write_text("merchant_name,user_id,user_name,transaction_date,transaction_amount,"
                 "transaction_category_detail,extra\n"
                 "AvalonBay,usr_1,A,2025-05-01,1850,RENT_HOUSING,x\n"
                 "Employer,usr_1,A,2025-05-02,-5200,SALARY_INCOME,y\n"
                 "Shop,usr_1,A,not-a-date,12.5,,z\n")
    df = load_csv(spark, str(p), mode="permissive")
    assert df.columns[:3] == ["user_id", "user_name", "transaction_date"]
    rows = df.collect()
    assert float(rows[0].transaction_amount) == 1850 and rows[2].transaction_date is None
    raw = spark.read.option("header", True).csv(str(p))
    dq = dq_counts(raw).collect()[0]
    assert (dq.n_rows, dq.bad_dates, dq.bad_amounts, dq.null_categories) == (3, 1, 0, 1)


def test_bad_rows_go_to_quarantine(spark, tmp_path):
    from ledgerlens.sources.ledger import load_with_quarantine
    p = tmp_path / "tx.csv"
    p.write_text("user_id,user_name,transaction_date,transaction_amount,transaction_category_detail,merchant_name,note\n"
                 "usr_1,A,2025-05-01,18.505,X_Y,m,a\nusr_1,A,2025-05-01 10:30:00,-5,,m,b\n"
                 "usr_1,A,not-a-date,1,X_Y,m,c\nusr_1,A,2025-05-01,12x,X_Y,m,d\n,A,2025-13-01,,X_Y,m,e\n")
    raw = spark.read.option("header", True).csv(str(p))
    good, bad = load_with_quarantine(raw, str(tmp_path / "out"))
    rows = {r.note: r for r in good.collect()}
    assert set(rows) == {"a", "b"} and float(rows["a"].transaction_amount) == 18.505
    assert str(rows["b"].transaction_time) == "2025-05-01 10:30:00" and str(rows["b"].transaction_date) == "2025-05-01"
    assert {r.note: r.reason for r in bad.collect()} == {
        "c": "bad date: not-a-date", "d": "bad amount: 12x", "e": "no owner; bad date: 2025-13-01; no amount"}
    assert {r.note: r.raw_amount for r in bad.collect()}["d"] == "12x"
    good, bad = load_with_quarantine(raw.where("note = 'a'"), str(tmp_path / "clean"))
    assert good.count() == 1 and bad.count() == 0


def test_text_summary_without_merchant_column(spark):
    df = ledger_df(spark, CACHE_ROWS).drop("merchant_name")
    t = {r.user_id: r.text_summary for r in PR.text_summaries(df).collect()}
    assert "Top merchants" not in t["usr_001"]
