"""Per-owner aggregates, rankings and the category breakdown.

Scale notes: every aggregate is a partial+final hash aggregate, so an owner
holding a third of all rows still only contributes one partial row per map
task. Per-owner windows run on *aggregated* tables whose size per owner is
bounded by (days x parent categories) or (#merchants after a partial
top-k), never on raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import columns as C
from ..functions import exprs as X
from . import filters as FL


def _exp():
    return F.col(C.AMOUNT) > 0


def _inc():
    return F.col(C.AMOUNT) < 0


def daily_rollup(ledger: DataFrame, by_parent: bool = True) -> DataFrame:
    """(owner, day, parent) -> expense/income sums and row counts; without
    ``by_parent`` (owner, day), for series that read no category. A hot owner
    shrinks to at most days x parents rows before any per-owner step sees it.
    """
    keys = [C.USER, F.col(C.DATE).alias(C.DAY)]
    if by_parent:
        keys.append(X.parent_category(C.CATEGORY).alias(C.PARENT))
    return (ledger.groupBy(*keys)
            .agg(F.sum(F.when(_exp(), F.col(C.AMOUNT))).alias("expense"),
                 F.sum(F.when(_inc(), F.col(C.AMOUNT))).alias("income"),
                 F.count_if(_exp()).alias("n_expense"),
                 F.count_if(_inc()).alias("n_income"),
                 F.count(F.lit(1)).alias("n_rows")))


def ranked(df: DataFrame, part: str, value: str, name: str, k: int | None = None,
           rank_col: str = "rank") -> DataFrame:
    """Rank within ``part`` by value desc, name asc (a total order, Q10).

    With ``k`` the ``row_number() <= k`` filter plans as a WindowGroupLimit,
    which also runs partially before the shuffle.
    """
    w = Window.partitionBy(part).orderBy(F.col(value).desc(), F.col(name).asc())
    out = df.withColumn(rank_col, F.row_number().over(w))
    return out if k is None else out.where(F.col(rank_col) <= k)


# --- A1 / T1 ---------------------------------------------------------------

def category_totals(ledger: DataFrame) -> DataFrame:
    """Expense per (owner, parent category); null parents are dropped (Q11)."""
    return (FL.expenses(ledger)
            .withColumn(C.PARENT, X.parent_category(C.CATEGORY))
            .where(F.col(C.PARENT).isNotNull())
            .groupBy(C.USER, C.PARENT)
            .agg(F.sum(C.AMOUNT).alias("total_expense"),
                 F.count(F.lit(1)).alias("n_transactions")))


def top_categories(ledger: DataFrame, k: int = 5) -> DataFrame:
    return ranked(category_totals(ledger), C.USER, "total_expense", C.PARENT, k)


# --- A2 / T2 ---------------------------------------------------------------

def merchant_totals(ledger: DataFrame) -> DataFrame:
    return (FL.expenses(ledger).where(F.col(C.MERCHANT).isNotNull())
            .groupBy(C.USER, C.MERCHANT)
            .agg(F.sum(C.AMOUNT).alias("total_expense"),
                 F.count(F.lit(1)).alias("n_transactions")))


def top_merchants(ledger: DataFrame, k: int = 10) -> DataFrame:
    return ranked(merchant_totals(ledger), C.USER, "total_expense", C.MERCHANT, k)


# --- A5-A8, A10, A17, A18 --------------------------------------------------

def owner_totals(ledger: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One conditional-aggregate pass: totals, counts, mean, date ranges.

    ``names``: an (owner, name) table with one row per owner, joined after the
    aggregate, which then stays hash-based; without it the name is the
    smallest one among the owner's rows."""
    sum_exp = F.sum(F.when(_exp(), F.col(C.AMOUNT)))
    sum_inc = F.sum(F.when(_inc(), F.col(C.AMOUNT)))
    n_exp = F.count_if(_exp())
    name = [F.min(C.NAME).alias(C.NAME)] if names is None else []
    out = ledger.groupBy(C.USER).agg(
        *name,
        F.count(F.lit(1)).alias("n_rows"),
        n_exp.alias("n_expense"),
        F.count_if(_inc()).alias("n_income"),
        F.coalesce(sum_exp, F.lit(0).cast(C.MONEY_TYPE)).alias("total_expense"),
        F.coalesce(sum_inc, F.lit(0).cast(C.MONEY_TYPE)).alias("total_income_signed"),
        F.min(C.DATE).alias("first_date"),
        F.max(C.DATE).alias("last_date"),
        F.min(F.when(_exp(), F.col(C.DATE))).alias("first_expense_date"),
        F.max(F.when(_exp(), F.col(C.DATE))).alias("last_expense_date"),
    ).withColumn(
        "avg_expense",
        F.when(F.col("n_expense") > 0,
               X.cents(F.col("total_expense").cast("double") / F.col("n_expense")))
        .otherwise(F.lit(0.0)))
    return out if names is None else out.join(names, C.USER)


def avg_monthly_spend_expr() -> "F.Column":
    """Mean of the zero-filled monthly expense series (Q6), in closed form:
    total expense / calendar months between first and last expense."""
    months = (F.months_between(F.trunc("last_expense_date", "MM"),
                               F.trunc("first_expense_date", "MM")).cast("int") + 1)
    return F.when(F.col("n_expense") > 0,
                  X.cents(F.col("total_expense").cast("double") / months)) \
        .otherwise(F.lit(0.0))


def sign_split(ledger: DataFrame) -> DataFrame:
    """groupby(amount > 0).agg(sum, count), per owner."""
    return (ledger.groupBy(C.USER, (F.col(C.AMOUNT) > 0).alias("is_expense"))
            .agg(F.sum(C.AMOUNT).alias("total"), F.count(F.lit(1)).alias("n")))


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def amount_band(amount) -> "F.Column":
    """A band number that rises with the amount: 64 bands for each factor e of
    its size, so an owner has a few thousand at most, whatever the rows."""
    size = F.floor(F.log1p(F.abs(amount).cast("double")) * 64)
    return F.when(amount < 0, -1 - size).otherwise(size).cast("bigint")


def amount_quantiles(ledger: DataFrame, quantiles: dict[str, float] = QUARTILES) -> DataFrame:
    """Exact quantiles of the amounts per owner, interpolated linearly between
    the two order statistics around (n - 1) q.

    No owner's amounts are sorted in one task. Amounts are counted by (owner,
    band, amount) with map-side combine; running counts over an owner's bands
    (a few thousand rows) tell which bands hold the wanted positions; only
    those bands are scanned in order of amount, each in its own partition."""
    hist = (ledger.where(F.col(C.AMOUNT).isNotNull())
            .groupBy(C.USER, amount_band(F.col(C.AMOUNT)).alias("band"), C.AMOUNT)
            .agg(F.count(F.lit(1)).alias("n")))
    bands = hist.groupBy(C.USER, "band").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(C.USER)
    bands = (bands.withColumn("upto", F.sum("n").over(w.orderBy("band").rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("rows", F.sum("n").over(w)))
    # positions from 0: the order statistics below and above (n - 1) q
    place = {k: (F.col("rows") - 1) * F.lit(q) for k, q in quantiles.items()}
    wanted = F.array(*[f(p).cast("bigint") for p in place.values() for f in (F.floor, F.ceil)])
    held = bands.select(C.USER, "band", (F.col("upto") - F.col("n")).alias("before"), "upto", "rows",
                        F.explode(F.array_distinct(wanted)).alias("position")).where(
        (F.col("position") >= F.col("before")) & (F.col("position") < F.col("upto")))
    w_band = Window.partitionBy(C.USER, "band").orderBy(C.AMOUNT).rowsBetween(Window.unboundedPreceding, 0)
    inside = hist.join(held.select(C.USER, "band").distinct(), [C.USER, "band"], "left_semi") \
        .withColumn("_upto", F.sum("n").over(w_band))
    at = held.join(inside.select(C.USER, "band", C.AMOUNT, "_upto", "n"), [C.USER, "band"]).where(
        (F.col("position") - F.col("before") < F.col("_upto"))
        & (F.col("position") - F.col("before") >= F.col("_upto") - F.col("n")))

    def value(position):
        return F.max(F.when(F.col("position") == position.cast("bigint"), F.col(C.AMOUNT)))

    got = at.groupBy(C.USER, "rows").agg(*[
        f(place[k]).alias(f"{k}_{side}") for k in quantiles
        for side, f in (("low", lambda p: value(F.floor(p))), ("high", lambda p: value(F.ceil(p))))])
    share = {k: (p - F.floor(p)).cast("decimal(9,6)") for k, p in place.items()}
    return got.select(C.USER, *[
        (F.col(f"{k}_low") + (F.col(f"{k}_high") - F.col(f"{k}_low")) * share[k]).alias(k) for k in quantiles])


def amount_describe(ledger: DataFrame) -> DataFrame:
    """Whole-owner total and describe figures (A18): count, total, mean,
    standard deviation (divisor n - 1; null for one row), minimum, quartiles,
    maximum. The deviation comes from exact sums of amounts and squares."""
    x = F.col(C.AMOUNT)
    sums = ledger.groupBy(C.USER).agg(
        F.count(x).alias("n"),
        F.sum(x).alias("total"),
        F.sum((x * x).cast("decimal(38,4)")).alias("_squares"),
        F.min(x).alias("min_amount"),
        F.max(x).alias("max_amount"))
    n, total = F.col("n"), F.col("total").cast("double")
    variance = (F.col("_squares").cast("double") - total * total / n) / (n - 1)
    out = sums.withColumn("mean_amount", X.cents(total / n)).withColumn(
        "std_amount", F.when(n > 1, X.cents(F.sqrt(F.greatest(variance, F.lit(0.0)))))).drop("_squares")
    return out.join(amount_quantiles(ledger), C.USER, "left")


def roster(ledger: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Distinct (owner, name) sorted by name, with the 'name (id)' label.
    ``names``: an (owner, name) table to join the distinct owners with."""
    pairs = (ledger.select(C.USER, C.NAME).distinct() if names is None
             else ledger.select(C.USER).distinct().join(names, C.USER))
    return (pairs
            .withColumn("label", F.concat(F.col(C.NAME), F.lit(" ("), F.col(C.USER), F.lit(")")))
            .orderBy(C.NAME, C.USER))


# --- C2 / T3 / U1 / A16 / F9 -----------------------------------------------

def category_breakdown(ledger: DataFrame, period: str = "last_3_months",
                       top_n: int = 7) -> DataFrame:
    """Top-n parent categories + one trailing 'Other' bucket, with shares.

    Output per owner: (category, amount, pct, show_label, is_other, slice_order,
    total, legend). Owners without expenses in the window produce no rows.
    """
    if top_n < 0:
        raise ValueError("top_n must be >= 0")
    totals = category_totals(FL.window(ledger, FL.period_months(period))).withColumnRenamed("total_expense", "amount").drop("n_transactions")
    w_user = Window.partitionBy(C.USER)
    rk = (ranked(totals, C.USER, "amount", C.PARENT)
          .withColumn("n_categories", F.count(F.lit(1)).over(w_user)))
    is_other = (F.col("n_categories") > top_n) & (F.col("rank") > top_n)
    bucketed = (rk.withColumn("is_other", is_other)
                .withColumn("category", F.when(is_other, F.lit("Other")).otherwise(F.col(C.PARENT)))
                .groupBy(C.USER, "category", "is_other")
                .agg(F.sum("amount").alias("amount"), F.min("rank").alias("slice_order")))
    total = F.sum("amount").over(w_user)
    pct = F.col("amount").cast("double") / F.col("total").cast("double") * 100
    return (bucketed.withColumn("total", total)
            .withColumn("pct", pct)
            .withColumn("show_label", F.col("pct") >= 5)
            .withColumn("legend", F.concat(
                F.col("category"), F.lit("  ("), F.format_number(F.col("pct"), 1),
                F.lit("%, "), X.currency(F.col("amount")), F.lit(")"))))
