"""Owner profile, text summary, verified-number summary and answer templates.

All are built from bounded per-owner pieces: one conditional-aggregate row
per owner plus top-k lists (k <= 10) gathered with ``collect_list`` after the
top-k filter, so no owner's raw rows are ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import columns as C
from ..functions import exprs as X
from . import aggregates as A

# --- FIXED VALUES: answer templates (must equal the reference texts) --------
FALLBACK_TEMPLATE = (
    "⚠️ I'm currently experiencing connectivity issues with the AI service, "
    "but here's what I can tell you from your data:\n\n"
    "**Financial Overview for {name}**\n"
    "• Period: {start} to {end}\n"
    "• Total Income: {income}\n"
    "• Total Expenses: {expense}\n"
    "• Net Savings: {net}\n"
    "• Top Spending: {top}\n"
    "• Average Monthly Spend: {avg}\n\n"
    "Please try again shortly for a more detailed analysis."
)
NO_DATA_TEMPLATE = (
    "No transactions found for your query, {name}. "
    "Your transaction history spans {start} to {end}. "
    "Here are some suggestions:\n"
    "• Try asking about a different time period (e.g., 'last 3 months')\n"
    "• Ask for a general overview: 'What did I spend the most on?'\n"
    "• Check a specific category: 'How much did I spend on food?'"
)


NO_ROWS_TEXT = "No transactions found for this user."
NO_PROFILE_TEXT = "No cached profile available for this user."


def fill(template: str, **cols: Column) -> Column:
    """Fill ``{name}`` slots of a fixed template with string columns."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        key, _, rest = tail.partition("}")
        if pre:
            parts.append(F.lit(pre))
        parts.append(cols[key])
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


MONEY_SUM = "decimal(28,2)"
_TOP_T = f"array<struct<rank:int,name:string,total:{MONEY_SUM}>>"

ALL_GRAINS = ("parent", "merchant", "month")
_GRAIN_COL = {"parent": C.PARENT, "merchant": C.MERCHANT, "month": C.MONTH}


def owner_facts(ledger: DataFrame, grains=ALL_GRAINS, names: bool = True, together: bool = False,
                apart: tuple[str, ...] = ()) -> DataFrame:
    """One pass over the facts: a row per owner (and name) with all measures,
    and rows per (owner, parent), (owner, merchant), (owner, month), as far as
    requested, of the owner's expenses. Without ``names`` an owner with several
    names is one row of the owner grain. Rows that differ in the columns
    ``apart`` are not added up. A ledger may bring its parent categories.

    ``together``: an owner's rows lie in one partition (``ledger.owner_ledger``).
    Then nothing is shuffled here: the grains are exploded, since Spark takes
    the rows of an Expand for scattered.

    A single Expand (the unpivot) + partial/final aggregate replaces separate
    scans of the ledger (each a multi-way join at scale). An owner's rows hardly
    combine before the shuffle, so its rows are kept small: one key column for
    all grains, no income rows and no dates below the owner grain (no card reads
    them there). The owner name is a grouping key of the owner grain, not a
    min(): a string aggregation buffer would force a sort-based aggregate over
    all expanded rows."""
    parent = F.col(C.PARENT) if C.PARENT in ledger.columns else X.parent_category(C.CATEGORY)
    key = {"owner": F.lit(None), "parent": parent, "merchant": F.col(C.MERCHANT), "month": F.trunc(C.DATE, "MM")}
    ids = [C.USER, C.NAME, C.DATE, C.AMOUNT, *apart]
    if together:
        entries = [F.struct(F.lit(g).alias("grain"), key[g].cast("string").alias("key")) for g in ("owner", *grains)]
        rows = ledger.select(*ids, F.inline(F.array(*entries)))
    else:
        rows = ledger.select(*ids, *[key[g].cast("string").alias(g) for g in ("owner", *grains)]) \
            .unpivot(ids, ["owner", *grains], "grain", "key")
    is_owner, exp, inc = F.col("grain") == "owner", F.col(C.AMOUNT) > 0, F.col(C.AMOUNT) < 0
    rows = (rows.where(is_owner | exp)
            .withColumn(C.DATE, F.when(is_owner, F.col(C.DATE)))
            .withColumn(C.NAME, F.when(is_owner, F.col(C.NAME))))
    owner = [C.USER, C.NAME, *apart] if names else [C.USER, *apart]
    g = rows.groupBy(*owner, "grain", "key").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(exp).alias("n_expense"),
        F.count_if(inc).alias("n_income"),
        F.sum(F.when(exp, F.col(C.AMOUNT))).alias("sum_expense"),
        F.sum(F.when(inc, F.col(C.AMOUNT))).alias("sum_income"),
        F.min(C.DATE).alias("first_date"),
        F.max(C.DATE).alias("last_date"),
        F.min(F.when(exp, F.col(C.DATE))).alias("first_expense_date"),
        F.max(F.when(exp, F.col(C.DATE))).alias("last_expense_date"))
    keys = [F.when(F.col("grain") == gname, F.col("key")).cast("date" if c == C.MONTH else "string").alias(c)
            for gname, c in _GRAIN_COL.items()]             # absent grains: typed null keys
    return g.select(*owner, *keys, *MERGE, "grain")


#: Measures of ``owner_facts`` and how those of several parts of the rows merge.
MERGE = {"n_rows": F.sum, "n_expense": F.sum, "n_income": F.sum, "sum_expense": F.sum, "sum_income": F.sum,
         "first_date": F.min, "last_date": F.max, "first_expense_date": F.min, "last_expense_date": F.max}
FACT_KEYS = [C.USER, C.NAME, C.PARENT, C.MERCHANT, C.MONTH, "grain"]


def merged_facts(parts: DataFrame, keys: list[str] = FACT_KEYS) -> DataFrame:
    """The facts of all rows from the facts of disjoint parts of them (days,
    months, batches): every measure is a sum, a minimum or a maximum."""
    return parts.groupBy(*keys).agg(*[
        how(c).cast(parts.schema[c].dataType).alias(c) for c, how in MERGE.items()])


def owner_cards(ledger: DataFrame, grains=ALL_GRAINS) -> DataFrame:
    """Everything the profile, the text summary and the verified numbers
    need, as ONE row per owner (``cards_of``), in one pass over the ledger."""
    return cards_of(owner_facts(ledger, grains), grains)


def cards_of(facts: DataFrame, grains=ALL_GRAINS) -> DataFrame:
    """One row per owner from ``owner_facts``: totals, top-5
    categories, all category totals, top-10 merchants and the zero-filled
    monthly expense series (lists of absent grains are empty). Every list is
    bounded (k, the category taxonomy, the months between first and last
    expense)."""
    f = facts.where((F.col("grain") == "owner") | (F.col("n_expense") > 0))
    if "merchant" in grains:
        # Only merchant rows share a window partition: the other grains' keys
        # are null there, and rows of other grains are a partition each. So the
        # filter is the bare rank test that Spark plans as a partial and a
        # final group limit, and a hot owner's merchants are cut before the
        # shuffle, not sorted in one task.
        w = Window.partitionBy(C.USER, "grain", C.NAME, C.PARENT, C.MONTH).orderBy(
            F.col("sum_expense").desc(), F.col(C.MERCHANT).asc())
        f = (f.where((F.col("grain") != "merchant") | F.col(C.MERCHANT).isNotNull())
              .withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= 10))
    else:
        f = f.withColumn("_rank", F.lit(1))
    is_owner = F.col("grain") == "owner"

    def owner(agg, c):
        # an owner id with several names has several owner-grain rows
        return agg(F.when(is_owner, F.col(c)))

    card = f.groupBy(C.USER).agg(
        owner(F.min, C.NAME).alias(C.NAME),
        owner(F.sum, "n_rows").alias("n_rows"),
        owner(F.sum, "n_expense").alias("n_expense"),
        owner(F.sum, "n_income").alias("n_income"),
        F.coalesce(owner(F.sum, "sum_expense"), F.lit(0).cast(MONEY_SUM)).alias("total_expense"),
        F.coalesce(owner(F.sum, "sum_income"), F.lit(0).cast(MONEY_SUM)).alias("total_income_signed"),
        owner(F.min, "first_date").alias("first_date"),
        owner(F.max, "last_date").alias("last_date"),
        owner(F.min, "first_expense_date").alias("first_expense_date"),
        owner(F.max, "last_expense_date").alias("last_expense_date"),
        F.sort_array(F.collect_list(F.when(
            (F.col("grain") == "parent") & F.col(C.PARENT).isNotNull(),
            F.struct((-F.col("sum_expense")).alias("order"), F.col(C.PARENT).alias("name"),
                     F.col("sum_expense").alias("total"))))).alias("categories"),
        F.sort_array(F.collect_list(F.when(
            F.col("grain") == "merchant",
            F.struct(F.col("_rank").alias("rank"), F.col(C.MERCHANT).alias("name"),
                     F.col("sum_expense").alias("total"))))).alias("top_merchants"),
        F.collect_list(F.when(F.col("grain") == "month", F.struct(
            F.col(C.MONTH).alias("month"), F.col("sum_expense").alias("expense")))).alias("_months"))
    lo, hi = F.array_min(F.transform("_months", lambda m: m["month"])), \
        F.array_max(F.transform("_months", lambda m: m["month"]))
    vals = F.map_from_entries(F.col("_months"))
    months = F.when(F.size("_months") > 0, F.transform(
        F.sequence(lo, hi, F.expr("interval 1 month")),
        lambda m: F.struct(m.alias("month"), F.coalesce(F.element_at(vals, m),
                                                        F.lit(0).cast(MONEY_SUM)).alias("expense")))
    ).otherwise(F.array().cast(f"array<struct<month:date,expense:{MONEY_SUM}>>"))
    return (card.withColumn("months", months).drop("_months")
                .withColumn("avg_expense", F.when(
                    F.col("n_expense") > 0,
                    X.cents(F.col("total_expense").cast("double") / F.col("n_expense")))
                    .otherwise(F.lit(0.0)))
                .withColumn("avg_monthly_spend", A.avg_monthly_spend_expr())
                .withColumn("categories", F.transform("categories", lambda c, i: F.struct(
                    (i + 1).alias("rank"), c["name"].alias("name"), c["total"].alias("total"))).cast(_TOP_T))
                .withColumn("top_categories", F.slice("categories", 1, 5))
                .withColumn("top_merchants", F.col("top_merchants").cast(_TOP_T)))


def profiles(ledger: DataFrame) -> DataFrame:
    """One row per owner; top_categories = array<struct<rank,name,total>>."""
    return owner_cards(ledger, ("parent",))


def _cat_text(arr: Column, n: int | None = None) -> Column:
    a = arr if n is None else F.slice(arr, 1, n)
    return F.array_join(F.transform(a, lambda c: F.concat(
        c["name"], F.lit(" ("), X.currency(c["total"]), F.lit(")"))), ", ")


def flat_profiles(prof: DataFrame) -> DataFrame:
    """Profile with nested fields flattened for comparison/export."""
    return prof.select(
        C.USER, C.NAME,
        F.date_format("first_date", "yyyy-MM-dd").alias("date_range_start"),
        F.date_format("last_date", "yyyy-MM-dd").alias("date_range_end"),
        F.col("n_rows").alias("total_transactions"),
        _cat_text(F.col("top_categories")).alias("top_categories"),
        F.col("avg_monthly_spend"),
        X.cents(F.col("total_income_signed")).alias("total_income"),
        X.cents(F.col("total_expense")).alias("total_expense"))


def profile_text(prof: DataFrame) -> Column:
    """M1: the profile block injected into the model context."""
    lines = [
        F.concat(F.lit("User: "), F.col(C.NAME)),
        F.concat(F.lit("Data range: "), F.date_format("first_date", "yyyy-MM-dd"),
                 F.lit(" to "), F.date_format("last_date", "yyyy-MM-dd")),
        F.concat(F.lit("Total transactions: "), F.col("n_rows").cast("string")),
        F.concat(F.lit("Average monthly spending: "), X.currency("avg_monthly_spend")),
        F.concat(F.lit("Total income: "),
                 X.currency(F.abs(X.cents(F.col("total_income_signed"))))),
        F.concat(F.lit("Total expenses: "), X.currency(X.cents(F.col("total_expense")))),
        F.when(F.size("top_categories") > 0,
               F.concat(F.lit("Top spending categories: "), _cat_text(F.col("top_categories")))),
    ]
    return F.concat_ws("\n", *lines)


def fallback_text() -> Column:
    """M5: answer used when the model call failed (over profile columns)."""
    income = F.abs(F.col("total_income_signed"))
    return fill(
        FALLBACK_TEMPLATE,
        name=F.coalesce(F.col(C.NAME), F.lit("you")),
        start=F.date_format("first_date", "yyyy-MM-dd"),
        end=F.date_format("last_date", "yyyy-MM-dd"),
        income=X.currency(income),
        expense=X.currency(F.col("total_expense")),
        net=X.currency(income - F.col("total_expense")),
        top=_cat_text(F.col("top_categories"), 3),
        avg=X.currency(F.col("avg_monthly_spend")))


def summary_text(has_merchants: bool = True) -> Column:
    """A15 text over card columns: rows, range, totals, tops, latest date."""
    def money_list(arr):
        return F.array_join(F.transform(arr, lambda c: F.concat(
            c["name"], F.lit(" ($"), F.format_number(c["total"], 2), F.lit(")"))), ", ")

    has_exp = F.col("n_expense") > 0
    mers = F.col("top_merchants") if has_merchants else F.array().cast(_TOP_T)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Total rows: "), F.col("n_rows").cast("string")),
        F.concat(F.lit("Date range: "), F.date_format("first_date", "yyyy-MM-dd"),
                 F.lit(" to "), F.date_format("last_date", "yyyy-MM-dd")),
        F.concat(F.lit("Total expenses: $"), F.format_number(F.col("total_expense"), 2),
                 F.lit(" ("), F.col("n_expense").cast("string"), F.lit(" transactions)")),
        F.concat(F.lit("Total income: $"), F.format_number(F.abs(F.col("total_income_signed")), 2),
                 F.lit(" ("), F.col("n_income").cast("string"), F.lit(" transactions)")),
        F.when(has_exp, F.concat(F.lit("Top expense categories: "),
                                 money_list(F.col("top_categories")))),
        F.when(has_exp & (F.size(mers) > 0),
               F.concat(F.lit("Top merchants by spend: "), money_list(mers))),
        F.concat(F.lit("Most recent transaction: "), F.date_format("last_date", "yyyy-MM-dd")),
    )


def text_summaries(ledger: DataFrame) -> DataFrame:
    """The data-summary block per owner."""
    has_merchants = C.MERCHANT in ledger.columns          # F10: plan-time guard
    led = ledger if has_merchants else ledger.withColumn(C.MERCHANT, F.lit(None).cast("string"))
    # one shuffle by owner for the merchants' ranks and the owner's lists
    grains = ("parent", "merchant")
    return cards_of(owner_facts(led, grains).repartition(C.USER), grains).select(
        C.USER, summary_text(has_merchants).alias("text_summary"))


def data_summary_map() -> Column:
    """A14 as the field of a result record: key -> text (amounts with two
    decimals), over card columns."""
    def kv(k, v):
        return F.struct(k.alias("key"), v.alias("value"))

    def amount(v):
        return F.call_function("format_number", v, F.lit("0.00"))

    head = F.array(
        kv(F.lit("total_expense"), amount(X.cents(F.col("total_expense")))),
        kv(F.lit("total_income"), amount(X.cents(F.abs(F.col("total_income_signed"))))),
        kv(F.lit("transaction_count"), F.col("n_rows").cast("string")),
        kv(F.lit("avg_expense"), amount(F.col("avg_expense"))),
        kv(F.lit("date_range_start"), F.date_format("first_date", "yyyy-MM-dd")),
        kv(F.lit("date_range_end"), F.date_format("last_date", "yyyy-MM-dd")))
    cats = F.transform("categories", lambda c: kv(
        F.concat(F.lit("category_"), c["name"]), amount(X.cents(c["total"]))))
    months = F.transform("months", lambda m: kv(
        F.concat(F.lit("month_"), X.month_key(m["month"])), amount(X.cents(m["expense"]))))
    mers = F.transform("top_merchants", lambda c: kv(
        F.concat(F.lit("merchant_"), c["name"]), amount(X.cents(c["total"]))))
    return F.map_from_entries(F.concat(head, cats, months, mers))


def summary_rows(ledger: DataFrame | None = None, facts: DataFrame | None = None,
                 together: bool = False) -> DataFrame:
    """A14 as rows (owner, key, value, text): totals, count, mean expense, the
    date range (text, no value), category_*, zero-filled month_YYYY_MM,
    merchant_* (top 10). One pass over the ledger, or none where its ``facts``
    (``owner_facts`` of all grains) are given (``together``: in a table bucketed
    by owner, which is not shuffled again); every row of the facts gives its own
    entries, so no row holds an owner's lists."""
    place = [C.USER, "grain", C.PARENT]                   # keys of all steps below: one shuffle for them
    if facts is None:
        has_merchants = C.MERCHANT in ledger.columns      # F10: plan-time guard
        led = ledger if has_merchants else ledger.withColumn(C.MERCHANT, F.lit(None).cast("string"))
        f = owner_facts(led, ALL_GRAINS, names=False).repartition(*place)
    else:                                                 # an owner's names are one row
        f = merged_facts(facts if together else facts.repartition(*place), [k for k in FACT_KEYS if k != C.NAME])
    f = f.where((F.col("grain") == "owner") | (F.col("n_expense") > 0))
    f = f.where((F.col("grain") != "merchant") | F.col(C.MERCHANT).isNotNull())
    f = f.where((F.col("grain") != "parent") | F.col(C.PARENT).isNotNull())
    # months up to the owner's next month with an expense are 0
    w_next = Window.partitionBy(C.USER, "grain", C.PARENT, C.MERCHANT).orderBy(C.MONTH)
    f = f.withColumn("_next", F.lead(C.MONTH).over(w_next))
    # bare rank test: a group limit before the window (see cards_of)
    w = Window.partitionBy(C.USER, "grain", C.PARENT, C.MONTH).orderBy(
        F.col("sum_expense").desc(), F.col(C.MERCHANT).asc())
    f = f.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= 10)

    def entry(key, value, text=None):
        return F.struct(key.alias("key"), (F.lit(None) if value is None else value).cast("double").alias("value"),
                        (F.lit(None).cast("string") if text is None else text).alias("text"))

    spent = X.cents(F.col("sum_expense"))
    n = F.col("n_expense")
    owner = F.array(
        entry(F.lit("total_expense"), X.cents(F.coalesce("sum_expense", F.lit(0).cast(MONEY_SUM)))),
        entry(F.lit("total_income"), X.cents(F.abs(F.coalesce("sum_income", F.lit(0).cast(MONEY_SUM))))),
        entry(F.lit("transaction_count"), F.col("n_rows")),
        entry(F.lit("avg_expense"), F.when(n > 0, X.cents(F.col("sum_expense").cast("double") / n))
              .otherwise(F.lit(0.0))),
        entry(F.lit("date_range_start"), None, F.date_format("first_date", "yyyy-MM-dd")),
        entry(F.lit("date_range_end"), None, F.date_format("last_date", "yyyy-MM-dd")))
    last = F.coalesce(F.add_months("_next", -1), F.col(C.MONTH))
    months = F.transform(F.sequence(F.col(C.MONTH), last.cast("date"), F.expr("interval 1 month")), lambda m, i: entry(
        F.concat(F.lit("month_"), X.month_key(m)), F.when(i == 0, spent).otherwise(F.lit(0.0))))
    entries = (F.when(F.col("grain") == "owner", owner)
               .when(F.col("grain") == "parent", F.array(entry(F.concat(F.lit("category_"), F.col(C.PARENT)), spent)))
               .when(F.col("grain") == "merchant",
                     F.array(entry(F.concat(F.lit("merchant_"), F.col(C.MERCHANT)), spent)))
               .otherwise(months))
    return f.select(C.USER, F.explode(entries).alias("e")).select(C.USER, "e.key", "e.value", "e.text")


def actual_rows(ledger: DataFrame | None = None, facts: DataFrame | None = None,
                together: bool = False) -> DataFrame:
    """The verified numbers as rows (owner, value)."""
    return summary_rows(ledger, facts, together).where(F.col("value").isNotNull()).select(C.USER, "value")


def no_data_answers(owners: DataFrame, names: DataFrame) -> DataFrame:
    """M7 text for owners whose requested window is empty: rows of
    ``series.owners_without_data`` and an (owner, name) table."""
    return owners.join(names, C.USER).select(
        C.USER,
        fill(NO_DATA_TEMPLATE, name=F.col(C.NAME),
             start=F.date_format("first_date", "yyyy-MM-dd"),
             end=F.date_format("last_date", "yyyy-MM-dd")).alias("response"),
        F.lit("NO_DATA_FOR_QUERY").alias("flag"))
