"""Profile cache carried from batch to batch.

The state is a table of the owners that have been answered, one row each, in a
folder for the batch that first answered them. A batch's requests hit the cache
if an earlier batch holds the owner, or an earlier request of the same batch
does. Afterwards the batch adds the owners that are new; nothing is rewritten.
A batch that runs again reads the folders before its own and replaces its own,
so a retry after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sequences as Q

STATE = "batch int, owner string"


def merge_batch(answered: DataFrame, folder: str, batch: int, key: str = "user_id", ts: str = "ts",
                tie: str = "request_id") -> DataFrame:
    """The batch's rows with ``cache_hit``; the state gains its owners. Batches
    are numbered from 0 and come in order of time."""
    spark = answered.sparkSession
    rows = Q.cache_hits(answered, key, ts, tie)
    if batch == 0:
        known = spark.createDataFrame([], "owner string")
    else:
        known = spark.read.schema(STATE).option("basePath", folder).parquet(
            *[f"{folder}/batch={b}" for b in range(batch)]).select("owner")
    new = answered.select(F.col(key).alias("owner")).distinct().join(known, "owner", "left_anti")
    new.write.mode("overwrite").parquet(f"{folder}/batch={batch}")
    held = known.withColumnRenamed("owner", key).withColumn("_held", F.lit(True))
    return (rows.join(held, key, "left")
            .withColumn("cache_hit", F.col("cache_hit") | F.coalesce("_held", F.lit(False))).drop("_held"))
