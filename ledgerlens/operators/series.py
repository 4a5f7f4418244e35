"""Monthly series: zero-filled months, 3-month rolling mean, income vs expense.

The month spine is generated per owner from the *monthly aggregate* (at
most one row per owner-month), between the first and last month that still
has rows, so empty months inside the range read 0 and no month outside it
appears (Q5). Filling is join-free: each owner's few monthly values become a
small map that the exploded spine looks up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import columns as C
from ..functions import exprs as X
from . import aggregates as A
from . import filters as FL


def zero_filled_months(monthly: DataFrame, values: list[str]) -> DataFrame:
    """(owner, month, *values) -> every month between the owner's first and
    last month, missing months = 0. Values stay exact decimals."""
    entry = F.struct(*[F.col(v) for v in values])
    g = monthly.groupBy(C.USER).agg(
        F.min(C.MONTH).alias("lo"), F.max(C.MONTH).alias("hi"),
        F.map_from_entries(F.collect_list(F.struct(F.col(C.MONTH), entry))).alias("vals"))
    spine = g.select(C.USER, "vals", F.explode(
        F.sequence("lo", "hi", F.expr("interval 1 month"))).alias(C.MONTH))
    got = F.element_at(F.col("vals"), F.col(C.MONTH))
    return spine.select(C.USER, C.MONTH, *[
        F.coalesce(got.getField(v), F.lit(0).cast(C.MONEY_TYPE)).alias(v) for v in values])


def _monthly(df: DataFrame, aggs: dict) -> DataFrame:
    return (df.groupBy(C.USER, F.trunc(C.DAY, "MM").alias(C.MONTH))
            .agg(*[e.alias(n) for n, e in aggs.items()]))


def monthly_spend(ledger: DataFrame) -> DataFrame:
    """Zero-filled monthly expense over all of an owner's expense rows (A3);
    one shuffle, at the month grain."""
    m = _monthly(FL.expenses(ledger).withColumnRenamed(C.DATE, C.DAY), {"expense": F.sum(C.AMOUNT)})
    return (zero_filled_months(m, ["expense"])
            .withColumn("month_key", X.month_key(C.MONTH)))


def monthly_trend(ledger: DataFrame, months: int = 1, category: str | None = None) -> DataFrame:
    """Lookback -> expenses -> optional parent filter -> zero-filled
    months -> 3-month rolling mean (min_periods=1), only when the series has
    at least 3 months; the mean is left unrounded (Q13)."""
    rows = FL.expenses(FL.window(ledger, months))
    if category:
        rows = FL.in_parent(rows.withColumn(C.PARENT, X.parent_category(C.CATEGORY)), category)
    m = _monthly(rows.withColumnRenamed(C.DATE, C.DAY), {"total": F.sum(C.AMOUNT)})
    filled = zero_filled_months(m, ["total"])
    w_all = Window.partitionBy(C.USER)
    w3 = Window.partitionBy(C.USER).orderBy(C.MONTH).rowsBetween(-2, 0)
    avg3 = F.sum("total").over(w3).cast("double") / F.count(F.lit(1)).over(w3)
    title = "Monthly Spending Trend" + (f" — {category.title()}" if category else "")
    return (filled
            .withColumn("label", X.month_label(C.MONTH))
            .withColumn("avg3", F.when(F.count(F.lit(1)).over(w_all) >= 3, avg3))
            .withColumn("title", F.lit(title)))


def income_vs_expense(ledger: DataFrame, months: int = 6, show_net_line: bool = True) -> DataFrame:
    """Both signs in one pass per month; the spine spans all remaining
    rows of the window (income, expense or zero amounts)."""
    x = F.col(C.AMOUNT)
    zero = F.lit(0).cast(C.MONEY_TYPE)
    m = _monthly(FL.window(ledger, months).withColumnRenamed(C.DATE, C.DAY), {
        "income": F.coalesce(-F.sum(F.when(x < 0, x)), zero),
        "expense": F.coalesce(F.sum(F.when(x > 0, x)), zero),
    })
    out = (zero_filled_months(m, ["income", "expense"])
           .withColumn("label", X.month_label(C.MONTH)))
    if show_net_line:
        out = out.withColumn("net", F.col("income") - F.col("expense"))
    return out


def avg_monthly_spend(ledger: DataFrame) -> DataFrame:
    """A9 in closed form (no spine needed)."""
    return (A.owner_totals(ledger)
            .select(C.USER, A.avg_monthly_spend_expr().alias("avg_monthly_spend")))


def owners_without_data(ledger: DataFrame, months: int, expense_only: bool = True,
                        category: str | None = None) -> DataFrame:
    """C4: owners whose chart window holds no (expense) rows -> 'no data',
    with the date range of all their rows."""
    r = A.daily_rollup(ledger, bool(category))
    r = r.withColumn("ref_date", F.max(C.DAY).over(Window.partitionBy(C.USER)))
    hit = F.col("n_expense") > 0 if expense_only else F.col("n_rows") > 0
    if category:
        hit = hit & (F.col(C.PARENT) == F.lit(category.upper()))
    hit = hit & (F.col(C.DAY) >= FL.cutoff_expr("ref_date", months))
    return (r.groupBy(C.USER).agg(F.count_if(hit).alias("n_hits"),
                                  F.min(C.DAY).alias("first_date"), F.max(C.DAY).alias("last_date"))
            .where(F.col("n_hits") == 0).drop("n_hits"))
