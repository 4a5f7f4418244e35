"""How much the owner facts move: rows and shuffles of the shared steps."""

import re

from conftest import CACHE_ROWS, SF, ledger_df
from test_plans import _final_plan

from ledgerlens.operators import profile as PR


def _plan_without_broadcast(spark, query):
    import __spark_entry__ as E
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return _final_plan(E.queries()[query](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _shuffled_twice_by_facts(plan):
    # four joins of two sides, the aggregate by (owner, grain, key), one shuffle by owner
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 10
    assert re.search(r"Exchange hashpartitioning\(o_custkey#\d+L", plan)
    assert re.search(r"Exchange hashpartitioning\(l_orderkey#\d+L", plan)


def test_text_summary_shuffles_by_owner_once(spark):
    _shuffled_twice_by_facts(_plan_without_broadcast(spark, "text_summary"))


def test_data_summary_shuffles_by_owner_once(spark):
    _shuffled_twice_by_facts(_plan_without_broadcast(spark, "data_summary"))


def test_facts_below_the_owner_are_expenses(spark):
    rows = [*CACHE_ROWS, ("usr_003", None, "2025-01-02", -7, None, None), ("usr_003", "Cy", "2025-01-02", 5, None, None)]
    facts = PR.owner_facts(ledger_df(spark, rows)).collect()
    assert not [f for f in facts if f.grain != "owner" and (f.n_expense == 0 or f.n_expense != f.n_rows)]
    owners = {(f.user_id, f.user_name): (f.n_rows, f.n_income, str(f.first_date)) for f in facts if f.grain == "owner"}
    assert owners == {("usr_001", "Alice"): (6, 2, "2025-01-01"), ("usr_002", "Bob"): (2, 1, "2025-01-10"),
                      ("usr_003", None): (1, 1, "2025-01-02"), ("usr_003", "Cy"): (1, 0, "2025-01-02")}
    months = {(f.user_id, str(f.month)): float(f.sum_expense) for f in facts if f.grain == "month"}
    assert months == {("usr_001", "2025-01-01"): 100, ("usr_001", "2025-02-01"): 250, ("usr_001", "2025-03-01"): 1500,
                      ("usr_002", "2025-01-01"): 300, ("usr_003", "2025-01-01"): 5}
    # the category of usr_003's expense is null: a row of its grain, with a null key
    assert [(f.parent_category, f.merchant_name) for f in facts if f.user_id == "usr_003" and f.grain == "parent"] == [(None, None)]


def test_card_of_several_names_and_null_keys(spark):
    rows = [*CACHE_ROWS, ("usr_001", "Alicia", "2025-04-02", 9, None, None), ("usr_004", None, "2025-04-02", -1, "A_B", "m")]
    card = {r.user_id: r for r in PR.owner_cards(ledger_df(spark, rows)).collect()}
    assert (card["usr_001"].user_name, card["usr_001"].n_rows, float(card["usr_001"].total_expense)) == ("Alice", 7, 1859)
    assert len(card["usr_001"].months) == 4 and len(card["usr_001"].categories) == 2
    assert (card["usr_004"].n_income, card["usr_004"].categories, card["usr_004"].months) == (1, [], [])
