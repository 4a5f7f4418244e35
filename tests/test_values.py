"""Values keep what the source has: amounts, times, ids, number texts; model
arguments cannot fail a job."""

import datetime as dt
import math
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F


def _csv(spark, tmp_path, rows):
    path = tmp_path / "ledger.csv"
    head = "user_id,user_name,transaction_date,transaction_amount,transaction_category_detail,merchant_name"
    path.write_text("\n".join([head, *rows]) + "\n")
    return str(path)


def test_loader_keeps_decimals_and_times(spark, tmp_path):
    from ledgerlens.operators import filters as FL
    from ledgerlens.sources import ledger as S
    path = _csv(spark, tmp_path, ["u1,A,2025-05-01 13:45:00,12.345,X_FOOD,M",
                                  "u1,A,2025-02-01 13:44:59,0.004,X_FOOD,M",
                                  "u1,A,2025-02-01 13:45:00,-3,X_FOOD,M"])
    df = S.load_csv(spark, path)
    got = {float(r.transaction_amount): r for r in df.collect()}
    assert set(got) == {12.345, 0.004, -3.0}
    assert got[12.345].transaction_time == dt.datetime(2025, 5, 1, 13, 45)
    assert got[12.345].transaction_date == dt.date(2025, 5, 1)
    assert FL.expenses(df).count() == 2                       # 0.004 is still an expense
    kept = {float(r.transaction_amount) for r in FL.lookback_rows(df, 3).collect()}
    assert kept == {12.345, -3.0}                             # one second before the cut-off goes
    fixed = FL.lookback_rows(df, 1, reference_date=dt.datetime(2025, 3, 1)).collect()
    assert len(fixed) == 3


def test_request_ids_do_not_collide(spark, tmp_path):
    from ledgerlens.sources import derived as D
    rows = [(c, t, "user", "hello") for c in (1, 2, 3) for t in range(150)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string") \
        .write.parquet(str(tmp_path / "conversations.parquet"))
    assert D.requests(spark, str(tmp_path)).select("request_id").distinct().count() == 450


def test_float_text_is_python_repr(spark):
    from ledgerlens.functions import exprs as X
    values = [m * 10.0 ** e for e in range(-12, 22) for m in (1.0, 1.5, -2.25, 1.2345678901234567)]
    values += [1e300, 1.5e-300, 0.0, 1e16, 123456789.125, 0.0001, 0.00012345678912345, math.inf, -math.inf, math.nan]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.py_float_text("v").alias("t"))
    # (a JDK before 19 may print one digit too many of a 17-digit number: same value)
    wrong = [(r.v, r.t) for r in df.collect()
             if r.t != repr(r.v) and not (len(r.t) > 17 and float(r.t) == r.v)]
    assert not wrong, wrong[:10]


def test_bad_tool_arguments_are_error_rows(spark):
    from ledgerlens.operators import llm_tables as L
    trend, cat, inc = list(L.TOOLS)
    calls = [(trend, '{"months": "six"}', False), (trend, '{"months": 6.0}', True), (trend, "[1]", False),
             (trend, '{"months": null}', False), (trend, '{"months": 2.5}', False),
             (cat, '{"period": null}', False), (cat, '{"top_n": "x"}', False), (cat, "{}", True),
             (inc, '{"months": 3, "show_net_line": null}', True), ("plot_pie", "{}", False)]
    assert {trend, cat, inc} == {"plot_monthly_spending_trend", "plot_category_breakdown", "plot_income_vs_expense"}
    df = spark.createDataFrame([(i, [(str(i), n, a)]) for i, (n, a, _) in enumerate(calls)],
                               "request_id long, tool_calls array<struct<id:string,name:string,arguments:string>>")
    got = {r.request_id: r for r in L.route_tool_calls(df).collect()}
    for i, (name, args, ok) in enumerate(calls):
        assert got[i].success is ok, (name, args)
    assert got[1].months == 6 and got[0].error == L.BAD_ARGUMENTS
    assert got[8].show_net_line is False and got[9].error == "Unknown tool: plot_pie"
    from ledgerlens.plans.log_queries import n_charts_expr
    counted = df.select("request_id", n_charts_expr().alias("n")).collect()
    assert {r.request_id for r in counted if r.n} == {i for i, c in enumerate(calls) if c[2]}


def test_checkpoint_folder_is_demanded_on_a_cluster():
    from ledgerlens.session import ensure_checkpoint_dir
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    stub = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(stub)


def test_money_of_a_chart_uses_loaded_amounts(spark, tmp_path):
    from ledgerlens.sources import ledger as S
    path = _csv(spark, tmp_path, ["u1,A,2025-05-01,0.005,X_FOOD,M", "u1,A,2025-05-02,0.005,X_FOOD,M"])
    total = S.load_csv(spark, path).agg(F.sum("transaction_amount")).first()[0]
    assert float(total) == 0.01
