"""Stored cards, the band join of numbers, exact quantiles, the single-owner
path and windows before rollups."""

import random
from decimal import Decimal

import pandas as pd
import pytest
from conftest import CACHE_ROWS, SF, ledger_df
from pyspark.sql import functions as F


def _executed(df):
    """The final adaptive plan of this frame's own execution."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def _near(n, a):
    return abs(n - a) / max(abs(a), 1.0) < 0.05


def test_band_join_equals_all_pairs(spark):
    from ledgerlens.operators import grounding as GR
    rng = random.Random(5)
    actuals = [(f"o{i % 4}", rng.choice([0.0, 0.5, 0.97, 1.0, 1.04, round(10 ** rng.uniform(-2, 6), 2), -3.5]))
               for i in range(120)]
    numbers = []
    for i in range(1500):
        o, a = rng.choice(actuals)
        n = rng.choice([a * 1.05, a * 0.95, a / 0.95, a / 1.05, a + 0.05, a - 0.05, a * rng.uniform(0.9, 1.1),
                        round(10 ** rng.uniform(-2, 6), 2)])
        numbers.append((i, o, 0, abs(float(n))))
    n = spark.createDataFrame(numbers, "answer long, user_id string, pos int, n double")
    a = spark.createDataFrame(actuals, "user_id string, value double")
    got = {r.answer for r in GR.ungrounded_numbers(n, a, "answer", "user_id").collect()}
    assert got == {i for i, o, _, v in numbers if not any(_near(v, x) for p, x in actuals if p == o)}
    assert 100 < len(got) < 1400


def test_number_flags_of_an_owner_with_many_categories(spark):
    """100,000 categories of one owner: no row of the plan holds them as an array."""
    from ledgerlens import columns as C
    from ledgerlens.operators import grounding as GR
    from ledgerlens.operators import profile as PR
    ledger = spark.range(100000).select(
        F.lit("usr_1").alias(C.USER), F.lit("A").alias(C.NAME), F.lit("2025-01-05").cast("date").alias(C.DATE),
        (F.col("id") * 1000 + 10000000).cast("decimal(18,2)").alias(C.AMOUNT),
        F.concat(F.lit("X_C"), F.col("id")).alias(C.CATEGORY), F.lit("m").alias(C.MERCHANT))
    answers = spark.createDataFrame([(1, "usr_1", "It was $55,000,000 and $17.55, not 3000."), (2, "usr_1", "Nothing")],
                                    "answer long, user_id string, response string")
    actuals = PR.actual_rows(ledger)
    flags = GR.number_flags(answers, actuals, "answer")
    assert [(r.answer, r.number_flags) for r in flags.collect()] == [
        (1, ["UNGROUNDED_NUMBER:17.55", "UNGROUNDED_NUMBER:17.55", "UNGROUNDED_NUMBER:3000.0"])]
    assert "collect_list" not in actuals._jdf.queryExecution().optimizedPlan().toString()


def test_refresh_of_stored_cards_equals_a_rebuild(spark):
    from ledgerlens.operators import profile as PR
    from ledgerlens.plans.card_store import CardStore
    rows = [*CACHE_ROWS, ("usr_003", "Cy", "2025-01-02", 7, "X_FOOD", "m"), ("usr_001", "Alicia", "2025-04-02", 9, None, None)]
    store = CardStore(spark, buckets=4)
    store.refresh(ledger_df(spark, rows[:5]))
    store.refresh(ledger_df(spark, rows[5:]))
    got = {r.user_id: r.asDict(True) for r in store.cards().collect()}
    want = {r.user_id: r.asDict(True) for r in PR.owner_cards(ledger_df(spark, rows)).collect()}
    assert got == want and len(got) == 3


def test_requests_join_stored_cards_without_an_exchange_of_cards(spark):
    from ledgerlens.plans.card_store import CardStore, request_profiles
    store = CardStore(spark, buckets=4)
    store.refresh(ledger_df(spark, CACHE_ROWS))
    requests = spark.createDataFrame([(i, "usr_00%d" % (i % 3)) for i in range(9)], "request_id long, user_id string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = request_profiles(requests, store.cards()).select("request_id", "user_id", "total_expense")
        plan = _executed(joined)
        assert joined.count() == 6
        assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1    # the requests
        assert "Bucketed: true" in plan
        # merging the stored facts and making cards does not shuffle by owner again
        from ledgerlens.operators import profile as PR
        merged = _executed(PR.merged_facts(store.facts()))
        assert "Exchange" not in merged
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("rows", [1, 2, 3, 4, 7, 400])
def test_describe_equals_pandas(spark, rows):
    from ledgerlens.operators import aggregates as A
    rng = random.Random(rows)
    amounts = [Decimal(rng.randint(-500000, 500000)) / 100 for _ in range(rows)]
    amounts += amounts[:2]                                               # equal amounts
    made = [("hot", "A", "2025-01-01", a, "X_Y", "m") for a in amounts] + [("one", "B", "2025-01-01", 5, "X_Y", "m")]
    got = {r.user_id: r for r in A.amount_describe(ledger_df(spark, made)).collect()}
    want = pd.Series([float(a) for a in amounts]).describe()
    r = got["hot"]
    assert (r.n, float(r.min_amount), float(r.max_amount)) == (want["count"], want["min"], want["max"])
    for name, key in (("p25", "25%"), ("p50", "50%"), ("p75", "75%")):
        assert float(getattr(r, name)) == pytest.approx(want[key], abs=1e-9)
    assert r.std_amount == pytest.approx(want["std"], abs=0.0051) and r.mean_amount == pytest.approx(want["mean"], abs=0.0051)
    assert got["one"].std_amount is None and float(got["one"].p50) == 5


def test_quantiles_sort_no_owner_in_one_task(spark):
    from ledgerlens.operators import aggregates as A
    plan = A.amount_quantiles(ledger_df(spark, CACHE_ROWS))._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
    # amounts are only ordered within a band
    order = [line for line in plan.splitlines() if "windowspecdefinition" in line and "transaction_amount" in line]
    assert order and all("band" in line for line in order)


def test_one_owner_reaches_the_scan(spark):
    import __spark_entry__ as E
    from ledgerlens.sources.ledger import driver_ledger, owner_key
    plan = E.queries()["owner_rows"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,1)" in plan and "o_custkey" in plan.split("PushedFilters: [")[1] + plan
    assert [owner_key(x) for x in ("usr_12", "usr_012", "usr_x1", "12", "usr_", "usr_-1")] == [12] + [None] * 5
    assert driver_ledger(spark, SF, owner="usr_x1").count() == 0
    everyone = driver_ledger(spark, SF)
    assert driver_ledger(spark, SF, owner="usr_1").count() == everyone.where("user_id = 'usr_1'").count() > 0


def test_windows_cut_before_the_rollup(spark):
    """The date filter lies below the aggregate of the series, not above it."""
    import __spark_entry__ as E
    for name in ("monthly_trend", "income_vs_expense", "category_breakdown", "monthly_trend_category"):
        plan = E.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        lines = plan.splitlines()
        depth = {i: len(line) - len(line.lstrip(" :+-")) for i, line in enumerate(lines)}
        cut = [i for i, line in enumerate(lines) if "ref_date" in line and ("Join" in line or "Filter" in line)
               and ">=" in line]
        rollup = [i for i, line in enumerate(lines) if line.lstrip(" :+-").startswith("Aggregate") and "sum(" in line]
        assert cut and rollup, name
        assert min(depth[i] for i in cut) > max(depth[i] for i in rollup[:1]), name


def test_absent_profiles(spark):
    from ledgerlens.operators import profile as PR
    from ledgerlens.plans.card_store import with_absent
    ids = spark.createDataFrame([("usr_001",), ("usr_009",)], "user_id string")
    got = {r.user_id: r for r in with_absent(ids, PR.owner_cards(ledger_df(spark, CACHE_ROWS))).collect()}
    r = got["usr_009"]
    assert (r.user_name, r.total_transactions, r.avg_monthly_spend, r.date_range_start) == ("Unknown", 0, 0.0, None)
    assert r.profile_text == "No cached profile available for this user."
    assert r.text_summary == "No transactions found for this user."
    assert got["usr_001"].total_transactions == 6 and got["usr_001"].text_summary.startswith("Total rows: 6")
