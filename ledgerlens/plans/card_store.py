"""Stored owner cards (J2): the per-owner profile as a table that requests read.

Two tables, both bucketed and sorted by owner in the folder that
``spark.checkpoint.dir`` names (or one that is given):

* facts  the additive facts of each batch of ledger rows (``owner_facts``), one
         append per batch (a day, a month). They merge by sum, minimum, maximum.
* cards  one row per owner, made from the merged facts. The facts are read by
         bucket, so neither merging them nor making the cards shuffles the
         owner's grain rows between machines again.

A refresh aggregates only the new rows, appends their facts and makes new cards
of the owners in them; cards of all other owners are copied. Requests join the
cards by owner: only the request side is shuffled, into the cards' buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import columns as C
from ..functions import exprs as X
from ..operators import profile as PR
from ..session import ensure_checkpoint_dir


class CardStore:
    """Facts and cards under one folder; tables are registered in the session's
    catalog under names of their own. There are as many buckets as the session
    has shuffle partitions, unless a number is given."""

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        self.name = f"owner_{uuid.uuid4().hex}"
        self.own_folder = folder is None
        self.folder = folder or f"{ensure_checkpoint_dir(spark)}/tables/{self.name}"
        self.version = 0

    def _write(self, rows: DataFrame, table: str, mode: str) -> None:
        (rows.write.mode(mode).format("parquet").option("path", f"{self.folder}/{table}")
         .bucketBy(self.buckets, C.USER).sortBy(C.USER).saveAsTable(f"{self.name}_{table}"))

    def facts(self) -> DataFrame:
        return self.spark.table(f"{self.name}_facts")

    def cards(self) -> DataFrame:
        return self.spark.table(f"{self.name}_cards_{self.version}")

    def refresh(self, ledger: DataFrame) -> DataFrame:
        """Add a batch of ledger rows; the new cards. The first batch builds."""
        new = PR.owner_facts(ledger)
        self._write(new.repartition(self.buckets, C.USER), "facts", "append")
        if self.version == 0:
            # the facts of one batch are merged already
            facts = self.facts() if self.own_folder else PR.merged_facts(self.facts())
            made = PR.cards_of(facts)
        else:
            touched = new.select(C.USER).distinct()
            again = PR.cards_of(PR.merged_facts(self.facts().join(touched, C.USER, "left_semi")))
            made = self.cards().join(touched, C.USER, "left_anti").unionByName(again)
        self._write(made, f"cards_{self.version + 1}", "errorifexists")
        self.version += 1
        return self.cards()


def request_profiles(requests: DataFrame, cards: DataFrame) -> DataFrame:
    """Each request with its owner's stored profile."""
    return requests.join(cards, C.USER)


def with_absent(ids: DataFrame, cards: DataFrame, has_merchants: bool = True) -> DataFrame:
    """A13, A15, M1 for every owner id of ``ids``: where an owner has no rows,
    the empty profile and the texts that say so."""
    rows = ids.join(cards, C.USER, "left")
    there = F.col("n_rows").isNotNull()
    return (rows.withColumn("text_summary", F.when(there, PR.summary_text(has_merchants))
                            .otherwise(F.lit(PR.NO_ROWS_TEXT)))
            .withColumn("profile_text", F.when(there, PR.profile_text(rows)).otherwise(F.lit(PR.NO_PROFILE_TEXT)))
            .select(C.USER, F.coalesce(C.NAME, F.lit("Unknown")).alias(C.NAME),
                    F.date_format("first_date", "yyyy-MM-dd").alias("date_range_start"),
                    F.date_format("last_date", "yyyy-MM-dd").alias("date_range_end"),
                    F.coalesce("n_rows", F.lit(0)).alias("total_transactions"),
                    F.coalesce(F.size("top_categories"), F.lit(0)).cast("bigint").alias("n_top_categories"),
                    F.coalesce("avg_monthly_spend", F.lit(0.0)).alias("avg_monthly_spend"),
                    F.coalesce(X.cents(F.col("total_income_signed")), F.lit(0.0)).alias("total_income"),
                    F.coalesce(X.cents(F.col("total_expense")), F.lit(0.0)).alias("total_expense"),
                    "profile_text", "text_summary"))
