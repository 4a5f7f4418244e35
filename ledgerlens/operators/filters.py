"""Row filters: owner slice, sign, parent category, per-owner lookback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import columns as C
from ..functions import exprs as X
from ..functions.patterns import DEFAULT_PERIOD_MONTHS, PERIOD_MONTHS


def with_categories(df: DataFrame) -> DataFrame:
    """Add parent_category / subcategory (computed once, native expressions)."""
    return (df.withColumn(C.PARENT, X.parent_category(C.CATEGORY))
              .withColumn(C.SUBCATEGORY, X.subcategory(C.CATEGORY)))


#: Months of the period 'all': longer than any ledger.
ALL_MONTHS = 999


def for_user(df: DataFrame, user_id: str) -> DataFrame:
    """Single-owner slice; an equality Catalyst pushes into the parquet scan."""
    return df.where(F.col(C.USER) == F.lit(user_id))


def expenses(df: DataFrame) -> DataFrame:
    return df.where(F.col(C.AMOUNT) > 0)


def incomes(df: DataFrame) -> DataFrame:
    return df.where(F.col(C.AMOUNT) < 0)


def period_months(period: str) -> int:
    """Named period -> months; unknown names fall back to 3, 'all' is 999."""
    return PERIOD_MONTHS.get(period, DEFAULT_PERIOD_MONTHS)


def in_parent(df: DataFrame, category: str | None, parent_col: str = C.PARENT) -> DataFrame:
    """Parent-category filter; None or '' means no filter."""
    if not category:
        return df
    return df.where(F.col(parent_col) == F.lit(category.upper()))


def cutoff_expr(ref_col: str, months: int):
    """ref - N calendar months, clamped to month end; a time of day is kept."""
    return F.col(ref_col) - F.make_ym_interval(F.lit(0), F.lit(int(months)))


def lookback_rows(ledger: DataFrame, months: int, reference_date=None) -> DataFrame:
    """Rows within N months of each owner's latest row (income included), or
    of ``reference_date`` (a date or timestamp) where one is given. Rows with
    a time (``transaction_time``) are compared by it.

    The reference date is a per-owner max computed by a partial/final
    aggregate (map-side combine, so a hot owner costs one row per task), then
    joined back; AQE turns the join into a broadcast when the per-owner table
    is small, and splits a skewed owner partition otherwise.
    """
    at = C.TIME if C.TIME in ledger.columns else C.DATE
    if reference_date is not None:
        rows = ledger.withColumn("ref_date", F.lit(reference_date).cast(dict(ledger.dtypes)[at]))
    else:
        refs = ledger.groupBy(C.USER).agg(F.max(at).alias("ref_date"))
        rows = ledger.join(refs, C.USER)
    return (rows.where(F.col(at) >= cutoff_expr("ref_date", months))
            .withColumn("cutoff_date", cutoff_expr("ref_date", months)))


def window(ledger: DataFrame, months: int) -> DataFrame:
    """The rows within N months of the owner's latest row, before anything is
    added up: the latest day of each owner is one small aggregate joined to the
    facts, so rows before the cutoff are not shuffled for the rollup. A ledger
    that was cut already (it has ``cutoff_date``) is taken as it is."""
    if months >= ALL_MONTHS or "cutoff_date" in ledger.columns:
        return ledger
    return lookback_rows(ledger, months)
