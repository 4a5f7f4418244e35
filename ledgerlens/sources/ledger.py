"""Ledger sources: CSV/parquet loaders and the view over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import columns as C
from ..functions import exprs as X


class MissingColumnsError(ValueError):
    pass


def validate_columns(df: DataFrame, required=tuple(C.LEDGER_COLUMNS)) -> DataFrame:
    """Plan-time check of required column names (no job is run)."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise MissingColumnsError(f"Missing required columns: {set(missing)}")
    return df


def _typed(df: DataFrame, mode: str = "strict") -> DataFrame:
    """Cast to the ledger types; ``transaction_time`` keeps the time of day beside
    the day, amounts keep up to 8 decimals. ``strict`` fails on bad dates/amounts (ANSI
    cast), ``permissive`` turns them into nulls (see ``dq_counts``)."""
    cast = (lambda c, t: F.col(c).cast(t)) if mode == "strict" else \
        (lambda c, t: F.expr(f"try_cast(`{c}` as {t})"))
    return df.select(
        F.col(C.USER).cast("string").alias(C.USER),
        F.col(C.NAME).cast("string").alias(C.NAME),
        cast(C.DATE, "timestamp_ntz").cast("date").alias(C.DATE),
        cast(C.AMOUNT, C.LOADED_MONEY_TYPE).alias(C.AMOUNT),
        F.col(C.CATEGORY).cast("string").alias(C.CATEGORY),
        F.col(C.MERCHANT).cast("string").alias(C.MERCHANT),
        cast(C.DATE, "timestamp_ntz").alias(C.TIME),
    )


def load_csv(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """Header CSV read as text (no schema inference pass over the data),
    required names checked, then cast. Extra columns and any order accepted."""
    raw = (spark.read.option("header", True).option("inferSchema", False)
           .option("nullValue", "").csv(path))
    return _typed(validate_columns(raw), mode)


def load_parquet(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    return _typed(validate_columns(spark.read.parquet(path)), mode)


def dq_counts(raw: DataFrame) -> DataFrame:
    """Rows whose date/amount do not parse, and rows without a category."""
    return raw.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(C.DATE).isNotNull()
                   & F.expr(f"try_cast(`{C.DATE}` as date)").isNull()).alias("bad_dates"),
        F.count_if(F.col(C.AMOUNT).isNotNull()
                   & F.expr(f"try_cast(`{C.AMOUNT}` as {C.LOADED_MONEY_TYPE})").isNull()).alias("bad_amounts"),
        F.count_if(F.expr(f"try_cast(`{C.AMOUNT}` as double) <> "
                          f"cast(try_cast(`{C.AMOUNT}` as {C.LOADED_MONEY_TYPE}) as double)")).alias("rounded_amounts"),
        F.count_if(F.col(C.CATEGORY).isNull()).alias("null_categories"),
    )


def judged(raw: DataFrame) -> DataFrame:
    """Raw rows (text columns) with the typed ledger columns, ``accepted`` and
    ``reason``: why a row is not taken. A missing owner, a date or an amount that
    does not parse rejects a row; so does a missing date or amount."""
    validate_columns(raw)
    extra = [c for c in raw.columns if c not in C.LEDGER_COLUMNS]
    given = raw.select(*C.LEDGER_COLUMNS, *extra)
    date, amount = F.col(C.DATE).cast("string"), F.col(C.AMOUNT).cast("string")
    parsed = given.withColumn("_time", date.try_cast("timestamp_ntz")) \
        .withColumn("_amount", amount.try_cast(C.LOADED_MONEY_TYPE))
    reason = F.concat_ws("; ", *[
        F.when(F.col(C.USER).isNull(), F.lit("no owner")),
        F.when(date.isNull(), F.lit("no date")).when(F.col("_time").isNull(), F.concat(F.lit("bad date: "), date)),
        F.when(amount.isNull(), F.lit("no amount"))
        .when(F.col("_amount").isNull(), F.concat(F.lit("bad amount: "), amount))])
    return parsed.select(
        F.col(C.USER).cast("string").alias(C.USER), F.col(C.NAME).cast("string").alias(C.NAME),
        F.col("_time").cast("date").alias(C.DATE), F.col("_amount").alias(C.AMOUNT),
        F.col(C.CATEGORY).cast("string").alias(C.CATEGORY), F.col(C.MERCHANT).cast("string").alias(C.MERCHANT),
        F.col("_time").alias(C.TIME), *extra, (reason == "").alias("accepted"), F.nullif(reason, F.lit("")).alias("reason"),
        date.alias("raw_date"), amount.alias("raw_amount"))


def load_with_quarantine(raw: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(ledger rows, rejected rows with their reason): raw rows are read and
    judged once and written to two partitions of one table."""
    rows = judged(raw).withColumn("accepted", F.col("accepted").cast("string"))
    rows.write.mode("overwrite").partitionBy("accepted").parquet(folder)
    both = raw.sparkSession.read.schema(rows.schema).parquet(folder)
    return (both.where("accepted = 'true'").drop("accepted", "reason", "raw_date", "raw_amount"),
            both.where("accepted = 'false'").drop("accepted"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def owner_id(key: str) -> Column:
    return F.concat(F.lit("usr_"), F.col(key).cast("string")).alias(C.USER)


def owner_key(user_id: str) -> int | None:
    """The customer key of an owner id, or None: the inverse of ``owner_id``."""
    key = user_id.removeprefix("usr_")
    return int(key) if user_id.startswith("usr_") and key.isdecimal() and str(int(key)) == key else None


def _line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey",
        F.when(F.col("l_returnflag") == "R", -price).otherwise(price).alias("signed"))


def _part_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.col("p_type"), F.lit("_"), F.upper(F.col("p_brand"))).alias(C.CATEGORY))


def driver_ledger(spark: SparkSession, sf_dir: str, need=(C.NAME, C.CATEGORY, C.MERCHANT), rows=None,
                  owner: str | None = None) -> DataFrame:
    """Ledger rows from the TPC-H-like tables: one row per line item.

    owner = order customer, date = order date, amount = extended price
    (negative for returned lines, i.e. income/refund), category =
    ``<part type>_<BRAND#nn>``, merchant = supplier name.

    Dimension joins are added only for the columns a query needs: Spark does
    not drop an inner join nobody reads from, and at 100 TB each one is a
    full shuffle of the side it joins. So categories and merchants
    are joined to the line items before these meet the orders: no owner id is
    shuffled with them until the names are joined. Keys are complete
    foreign keys, so the row set does not change.

    ``rows`` (frame of owner, date and amount -> frame) filters the facts before
    any dimension is joined; columns that it adds are kept. ``owner`` keeps one
    owner's rows (F1): the id is turned back into its key, so the test is one on
    a stored column and reaches the scan.
    """
    li = _line_items(spark, sf_dir)
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if owner is not None:
        key = owner_key(owner)
        od = od.where(F.lit(False) if key is None else F.col("o_custkey") == key)

    def named(df):
        cu = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias(C.NAME))
        return df.join(cu, F.col("o_custkey") == F.col("c_custkey")) if C.NAME in need else df

    def described(df):
        if C.CATEGORY in need:
            pa = _part_categories(spark, sf_dir)
            df = df.join(pa, F.col("l_partkey") == F.col("p_partkey"))
        if C.MERCHANT in need:
            su = read_table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias(C.MERCHANT))
            df = df.join(su, F.col("l_suppkey") == F.col("s_suppkey"))
        return df

    cut = rows is not None or owner is not None
    if not cut:
        li = described(li)
    df = li.join(od, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_partkey", "l_suppkey", "o_custkey", owner_id("o_custkey"),
        F.col("o_orderdate").cast("date").alias(C.DATE), F.col("signed").cast(C.MONEY_TYPE).alias(C.AMOUNT),
        *[c for c in (C.CATEGORY, C.MERCHANT) if c in need and not cut])
    facts = df.columns
    if rows is not None:
        df = rows(df)
    added = [c for c in df.columns if c not in facts]
    if cut:
        df = described(named(df))
    else:
        df = named(df)
    text = [F.col(c) if c in need else F.lit(None).cast("string").alias(c) for c in (C.NAME, C.CATEGORY, C.MERCHANT)]
    return df.select(C.USER, text[0], C.DATE, C.AMOUNT, *text[1:], *added)


#: Number of the supplier row that gives a ledger row its merchant; null: none.
COPY = "copy"
#: Key of the owner of a ledger row whose owner's rows are dealt out; null: they lie together.
DEALT = "dealt_owner"
#: An owner with more orders than this has its rows dealt out.
HOT_ORDERS = 100_000


def hot_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer keys with more than ``HOT_ORDERS`` orders: few, whatever the size."""
    od = read_table(spark, sf_dir, "orders").where(F.col("o_custkey").isNotNull())
    return od.groupBy("o_custkey").count().where(F.col("count") > HOT_ORDERS).select("o_custkey")


def owner_ledger(spark: SparkSession, sf_dir: str, hot: DataFrame, buckets: int) -> DataFrame:
    """The rows of ``driver_ledger`` with and without merchants in one pass, an
    owner's rows together: (customer key as the owner, name (null), date, amount,
    parent category, merchant, ``COPY``, ``DEALT``), in ``buckets`` hash partitions
    by the first. ``rows_of_owners`` takes such rows, or facts of them, apart.

    Without merchants the ledger has each line once (``first_copies``); with
    them, once for each row of its supplier (``COPY`` is not null). Lines meet
    parts and orders by shuffles of short rows: the parent category for the
    category, the day for the time, the merchant last. The shuffle by customer
    key is the last one; aggregates by owner need none. The rows of ``hot``
    owners (``hot_owners``) are dealt out by order, so no partition has all of them.
    """
    pa = _part_categories(spark, sf_dir).select("p_partkey", X.parent_category(C.CATEGORY).alias(C.PARENT))
    cu = read_table(spark, sf_dir, "customer").select("c_custkey")
    od = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias(C.DATE))
    od = (od.join(cu, F.col("o_custkey") == F.col("c_custkey"))
          .join(hot.select(F.col("o_custkey").alias(DEALT)), F.col("o_custkey") == F.col(DEALT), "left"))
    su = read_table(spark, sf_dir, "supplier").where(F.col("s_suppkey").isNotNull()).select(
        "s_suppkey", F.col("s_name").alias(C.MERCHANT),
        F.row_number().over(Window.partitionBy("s_suppkey").orderBy("s_name")).alias(COPY))
    df = (_line_items(spark, sf_dir).join(pa, F.col("l_partkey") == F.col("p_partkey"))
          .join(od, F.col("l_orderkey") == F.col("o_orderkey"))
          .join(su, F.col("l_suppkey") == F.col("s_suppkey"), "left"))
    place = F.when(F.col(DEALT).isNull(), F.col("o_custkey")) \
        .otherwise(F.pmod(F.xxhash64("l_orderkey"), F.lit(4 * buckets)))
    return df.select(place.alias(C.USER), F.lit(None).cast("string").alias(C.NAME), C.DATE,
                     F.col("signed").cast(C.MONEY_TYPE).alias(C.AMOUNT), C.PARENT, C.MERCHANT, COPY, DEALT) \
        .repartition(buckets, C.USER)


def first_copies() -> Column:
    """The rows of ``owner_ledger`` that make up the ledger without merchants."""
    return F.coalesce(COPY, F.lit(1)) == 1


def rows_of_owners(df: DataFrame, make) -> DataFrame:
    """``make(rows, together)`` over rows of ``owner_ledger`` or facts of them: once
    for the owners whose rows lie together, once for those dealt out, whose rows
    are shuffled. Customer keys become owner ids in the result."""
    lie = make(df.where(F.col(DEALT).isNull()), True)
    dealt = make(df.where(F.col(DEALT).isNotNull()).withColumn(C.USER, F.col(DEALT)), False)
    return lie.unionByName(dealt).withColumn(C.USER, owner_id(C.USER))


def driver_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(owner, name) of every customer."""
    cu = read_table(spark, sf_dir, "customer")
    return cu.select(owner_id("c_custkey"), F.col("c_name").alias(C.NAME))


def roster_users(ledger: DataFrame) -> DataFrame:
    """Distinct owners."""
    return ledger.select(C.USER).distinct()
