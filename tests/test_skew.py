"""A hot owner holding a third of all rows: results stay whole and equal
the straightforward formulations."""

import datetime as dt
import random

from pyspark.sql import functions as F

from conftest import ledger_df
from ledgerlens.operators import aggregates as A
from ledgerlens.operators import profile as PR
from ledgerlens.operators import series as S


def _skewed(spark, n=3000):
    rnd = random.Random(11)
    cats = [f"S{i}_P{j}" for i in range(3) for j in range(9)]
    rows = []
    for i in range(n):
        owner = "usr_hot" if i % 3 == 0 else f"usr_{i % 97}"
        day = dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(700))
        amt = rnd.choice([-1, 1, 1, 1]) * rnd.randrange(1, 50000) / 100
        rows.append((owner, owner.upper(), day.isoformat(), amt, rnd.choice(cats), f"m{rnd.randrange(60)}"))
    return ledger_df(spark, rows)


def test_card_matches_direct_aggregates_under_skew(spark):
    L = _skewed(spark)
    card = {r.user_id: r for r in PR.owner_cards(L).collect()}
    hot = card["usr_hot"]
    assert hot.n_rows == 1000
    direct = {(r.user_id, r.parent_category): float(r.total_expense)
              for r in A.category_totals(L).collect()}
    assert {(u, c.name): float(c.total) for u, r in card.items() for c in r.categories} == direct
    top = [(r.merchant_name, float(r.total_expense)) for r in
           A.top_merchants(L, 10).where("user_id = 'usr_hot'").orderBy("rank").collect()]
    assert [(c.name, float(c.total)) for c in hot.top_merchants] == top
    months = {(r.user_id, r.month): float(r.expense) for r in S.monthly_spend(L).collect()}
    assert {(u, m.month): float(m.expense) for u, r in card.items() for m in r.months} == months


def test_breakdown_under_skew_sums_to_window_total(spark):
    L = _skewed(spark)
    b = sorted(A.category_breakdown(L, "last_6_months", 3).where("user_id = 'usr_hot'").collect(),
               key=lambda r: r.slice_order)
    assert len(b) == 4 and [r.is_other for r in b] == [False, False, False, True]
    ref = L.where("user_id = 'usr_hot'").agg(F.max("transaction_date")).collect()[0][0]
    want = L.where(f"user_id = 'usr_hot' and transaction_amount > 0 and "
                   f"transaction_date >= add_months(date'{ref.isoformat()}', -6)") \
        .agg(F.sum("transaction_amount")).collect()[0][0]
    assert float(b[0].total) == float(want)
    assert sum(float(r.amount) for r in b) == float(want)
