"""Registered ledger queries over the driver tables: (spark, sf_dir) -> DataFrame.

Money leaves as DOUBLE (exact decimal sums cast once), counts as BIGINT,
every computed column aliased to the same name as in the oracle SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import columns as C
from ..functions import exprs as X
from ..operators import aggregates as A
from ..operators import filters as FL
from ..operators import profile as P
from ..operators import series as S
from ..sources import derived as D
from ..session import ensure_checkpoint_dir
from ..sources.ledger import driver_ledger, driver_names, load_with_quarantine
from .card_store import CardStore, with_absent
from .card_store import request_profiles as request_cards
from .store import once

TREND_CATEGORY = "brand#13"   # filter argument; compared upper-cased (Q14)


def _money(*names):
    return [F.col(n).cast("double").alias(n) for n in names]


def roster(spark: SparkSession, d: str) -> DataFrame:
    return A.roster(driver_ledger(spark, d, need=()), driver_names(spark, d))


def available_users(spark: SparkSession, d: str) -> DataFrame:
    L = driver_ledger(spark, d, need=())
    return L.groupBy(C.USER).agg(F.count(F.lit(1)).alias("n_transactions"))


def category_parse(spark: SparkSession, d: str) -> DataFrame:
    L = driver_ledger(spark, d, need=(C.CATEGORY,))
    return (L.groupBy(C.CATEGORY).agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn(C.PARENT, X.parent_category(C.CATEGORY))
            .withColumn(C.SUBCATEGORY, X.subcategory(C.CATEGORY)))


def lookback_rows(spark: SparkSession, d: str) -> DataFrame:
    months = FL.period_months("last_3_months")
    out = driver_ledger(spark, d, rows=lambda facts: FL.lookback_rows(facts, months))
    return out.select(C.USER, C.NAME, C.DATE, *_money(C.AMOUNT), C.CATEGORY, C.MERCHANT,
                      "ref_date", "cutoff_date")


def expense_rows(spark: SparkSession, d: str) -> DataFrame:
    L = driver_ledger(spark, d, need=(C.CATEGORY, C.MERCHANT))
    return FL.expenses(L).select(C.USER, C.DATE, *_money(C.AMOUNT), C.CATEGORY, C.MERCHANT)


def income_rows(spark: SparkSession, d: str) -> DataFrame:
    L = driver_ledger(spark, d, need=(C.CATEGORY, C.MERCHANT))
    return FL.incomes(L).select(C.USER, C.DATE, *_money(C.AMOUNT), C.CATEGORY, C.MERCHANT)


def sign_split(spark: SparkSession, d: str) -> DataFrame:
    out = A.sign_split(driver_ledger(spark, d, need=()))
    return out.select(C.USER, "is_expense", *_money("total"), "n")


def totals(spark: SparkSession, d: str) -> DataFrame:
    t = A.owner_totals(driver_ledger(spark, d, need=()), driver_names(spark, d))
    return t.select(
        C.USER, C.NAME, "n_rows", "n_expense", "n_income",
        *_money("total_expense"),
        F.abs(F.col("total_income_signed")).cast("double").alias("total_income"),
        F.col("total_income_signed").cast("double").alias("total_income_signed"),
        (F.abs(F.col("total_income_signed")) - F.col("total_expense")).cast("double").alias("net"),
        "avg_expense", "first_date", "last_date")


def amount_describe(spark: SparkSession, d: str) -> DataFrame:
    t = A.amount_describe(driver_ledger(spark, d, need=()))
    return t.select(C.USER, "n", *_money("total", "min_amount", "max_amount", "p25", "p50", "p75"),
                    "mean_amount", "std_amount")


def category_totals(spark: SparkSession, d: str) -> DataFrame:
    t = A.category_totals(driver_ledger(spark, d, need=(C.CATEGORY,)))
    return t.select(C.USER, C.PARENT, *_money("total_expense"), "n_transactions")


def top_categories(spark: SparkSession, d: str) -> DataFrame:
    t = A.top_categories(driver_ledger(spark, d, need=(C.CATEGORY,)), 5)
    return t.select(C.USER, C.PARENT, *_money("total_expense"), F.col("rank").cast("bigint"))


def merchant_totals(spark: SparkSession, d: str) -> DataFrame:
    t = A.merchant_totals(driver_ledger(spark, d, need=(C.MERCHANT,)))
    return t.select(C.USER, C.MERCHANT, *_money("total_expense"), "n_transactions")


def top_merchants(spark: SparkSession, d: str) -> DataFrame:
    t = A.top_merchants(driver_ledger(spark, d, need=(C.MERCHANT,)), 10)
    return t.select(C.USER, C.MERCHANT, *_money("total_expense"), F.col("rank").cast("bigint"))


def _within(months: int):
    """Cuts the facts to each owner's window before a dimension is joined."""
    return None if months >= FL.ALL_MONTHS else lambda facts: FL.lookback_rows(facts, months)


def _breakdown(spark, d, period, top_n):
    rows = driver_ledger(spark, d, need=(C.CATEGORY,), rows=_within(FL.period_months(period)))
    b = A.category_breakdown(rows, period, top_n)
    return b.select(C.USER, "category", "is_other", *_money("amount", "total"),
                    F.col("slice_order").cast("bigint"), "pct", "show_label", "legend")


def category_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return _breakdown(spark, d, "last_3_months", 7)


def category_breakdown_all(spark: SparkSession, d: str) -> DataFrame:
    return _breakdown(spark, d, "all", 2)


def monthly_spend(spark: SparkSession, d: str) -> DataFrame:
    m = S.monthly_spend(driver_ledger(spark, d, need=()))
    return m.select(C.USER, C.MONTH, "month_key", *_money("expense"))


def _trend(spark, d, months, category):
    need = (C.CATEGORY,) if category else ()
    t = S.monthly_trend(driver_ledger(spark, d, need=need, rows=_within(months)), months, category)
    return t.select(C.USER, C.MONTH, "label", *_money("total"), "avg3", "title")


def monthly_trend(spark: SparkSession, d: str) -> DataFrame:
    return _trend(spark, d, 6, None)


def monthly_trend_category(spark: SparkSession, d: str) -> DataFrame:
    return _trend(spark, d, 6, TREND_CATEGORY)


def income_vs_expense(spark: SparkSession, d: str) -> DataFrame:
    t = S.income_vs_expense(driver_ledger(spark, d, need=(), rows=_within(6)), 6, True)
    return t.select(C.USER, C.MONTH, "label", *_money("income", "expense", "net"))


def avg_monthly_spend(spark: SparkSession, d: str) -> DataFrame:
    return S.avg_monthly_spend(driver_ledger(spark, d, need=()))


def users_without_data(spark: SparkSession, d: str) -> DataFrame:
    L = driver_ledger(spark, d, need=())
    none = S.owners_without_data(L, FL.period_months("last_1_month"))
    return P.no_data_answers(none, driver_names(spark, d))


PROFILE_NEEDS = (C.NAME, C.CATEGORY)    # profiles read no merchant: no supplier join


def user_profile(spark: SparkSession, d: str) -> DataFrame:
    return P.flat_profiles(P.profiles(driver_ledger(spark, d, need=PROFILE_NEEDS)))


def profile_text(spark: SparkSession, d: str) -> DataFrame:
    prof = P.profiles(driver_ledger(spark, d, need=PROFILE_NEEDS))
    return prof.select(C.USER, P.profile_text(prof).alias("profile_text"))


def fallback_answer(spark: SparkSession, d: str) -> DataFrame:
    prof = P.profiles(driver_ledger(spark, d, need=PROFILE_NEEDS))
    return prof.select(C.USER, P.fallback_text().alias("fallback_answer"))


def profile_card(spark: SparkSession, d: str) -> DataFrame:
    """The profile card — metrics in always-absolute currency."""
    prof = P.profiles(driver_ledger(spark, d, need=PROFILE_NEEDS))
    return prof.select(
        C.USER, F.col("n_rows").alias("total_transactions"),
        X.currency_abs(X.cents("total_income_signed")).alias("income"),
        X.currency_abs(X.cents("total_expense")).alias("expenses"),
        X.currency_abs("avg_monthly_spend").alias("avg_monthly_spend"),
        F.concat(F.lit("Data: "), F.date_format("first_date", "yyyy-MM-dd"), F.lit(" to "),
                 F.date_format("last_date", "yyyy-MM-dd")).alias("caption"),
        F.array_join(F.transform("top_categories", lambda c: F.concat(
            F.lit("- "), c["name"], F.lit(": "), X.currency_abs(c["total"]))), "\n")
        .alias("top_categories"))


def text_summary(spark: SparkSession, d: str) -> DataFrame:
    return P.text_summaries(driver_ledger(spark, d))


def data_summary(spark: SparkSession, d: str) -> DataFrame:
    return P.summary_rows(driver_ledger(spark, d))


#: The owner of the single-owner path.
ONE_OWNER = "usr_1"


def owner_rows(spark: SparkSession, d: str) -> DataFrame:
    """one owner's rows."""
    L = driver_ledger(spark, d, owner=ONE_OWNER)
    return L.select(C.USER, C.NAME, C.DATE, *_money(C.AMOUNT), C.CATEGORY, C.MERCHANT)


def stored_cards(spark: SparkSession, d: str) -> DataFrame:
    """The owner cards of these tables, stored once a session."""
    def build():
        store = CardStore(spark)
        store.refresh(driver_ledger(spark, d))
        return store
    inputs = [f"{d}/{t}.parquet" for t in ("lineitem", "orders", "customer", "part", "supplier")]
    return once(spark, "card_store", inputs, build).cards()


def request_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Every request with its owner's stored profile."""
    r = request_cards(D.requests(spark, d).select("request_id", C.USER), stored_cards(spark, d))
    return r.select(
        "request_id", C.USER, C.NAME, F.col("n_rows").alias("total_transactions"),
        F.date_format("last_date", "yyyy-MM-dd").alias("date_range_end"), "avg_monthly_spend",
        X.cents(F.col("total_expense")).alias("total_expense"))


def quarantine(spark: SparkSession, d: str) -> DataFrame:
    """The event feed split into ledger rows and rejected rows, in one
    pass; both sides are read back here."""
    folder = f"{ensure_checkpoint_dir(spark)}/tables/feed-{uuid.uuid4().hex}"
    good, bad = load_with_quarantine(D.event_feed(spark, d), folder)
    cols = ["event_id", C.USER, C.DATE, F.col(C.AMOUNT).cast("double").alias(C.AMOUNT)]
    return good.select(*cols, F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select(*cols, "reason"))


def absent_profiles(spark: SparkSession, d: str) -> DataFrame:
    """A13, A15, M1 with their empty forms: a profile for every customer and
    every owner that a request names, with ledger rows or without."""
    ids = driver_names(spark, d).select(C.USER).unionAll(D.requests(spark, d).select(C.USER)).distinct()
    return with_absent(ids, stored_cards(spark, d))


def hashed_ids(spark: SparkSession, d: str) -> DataFrame:
    u = driver_ledger(spark, d, need=()).select(C.USER).distinct()
    return u.select(C.USER, X.hash_user_id(C.USER).alias("user_id_hash"))


QUERIES = {
    "roster": roster,
    "available_users": available_users,
    "category_parse": category_parse,
    "lookback_rows": lookback_rows,
    "expense_rows": expense_rows,
    "income_rows": income_rows,
    "sign_split": sign_split,
    "totals": totals,
    "amount_describe": amount_describe,
    "category_totals": category_totals,
    "top_categories": top_categories,
    "merchant_totals": merchant_totals,
    "top_merchants": top_merchants,
    "category_breakdown": category_breakdown,
    "category_breakdown_all": category_breakdown_all,
    "monthly_spend": monthly_spend,
    "monthly_trend": monthly_trend,
    "monthly_trend_category": monthly_trend_category,
    "income_vs_expense": income_vs_expense,
    "avg_monthly_spend": avg_monthly_spend,
    "users_without_data": users_without_data,
    "user_profile": user_profile,
    "profile_text": profile_text,
    "fallback_answer": fallback_answer,
    "profile_card": profile_card,
    "text_summary": text_summary,
    "data_summary": data_summary,
    "hashed_ids": hashed_ids,
    "owner_rows": owner_rows,
    "request_profiles": request_profiles,
    "absent_profiles": absent_profiles,
    "quarantine": quarantine,
}
